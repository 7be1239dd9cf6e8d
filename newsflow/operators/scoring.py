"""M5: the opaque per-row model call at an Arrow-batched pandas seam. The
payload is cut to ``max_chars`` code points (F8) *before* the Python boundary,
so only the columns the model needs cross it.

``score_batches`` is the plain call. ``score_resumable`` is for models that
are slow to load, slow to run or fail on some rows: a model is loaded once per
Python worker, a row it fails on is set aside with its trace, and what is
scored is journalled part by part, so a run that was stopped goes on with the
rows that are left.
"""

from __future__ import annotations

import math
import traceback
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keyed_table import KeyedTable

Score = Callable[[pd.Series], pd.DataFrame]
ATTEMPTS = T.StructType([T.StructField("err", T.StringType()), T.StructField("trace", T.StringType())])


def score_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
                  key_col: str = "url_hash", text_col: str = "text",
                  max_chars: int | None = 2200) -> DataFrame:
    """Apply ``fn`` (pandas batch -> pandas batch with ``schema``) to
    (key, inputs) batches; ``inputs`` is the truncated text."""
    inputs = F.substring(text_col, 1, max_chars) if max_chars else F.col(text_col)
    slim = df.select(key_col, inputs.alias("inputs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)

    return slim.mapInPandas(run, schema=schema)


def length_model(pdf: pd.DataFrame) -> pd.DataFrame:
    """A stand-in model: character count of the input and a length class."""
    n = pdf["inputs"].fillna("").str.len()
    return pd.DataFrame({"url_hash": pdf["url_hash"], "n_chars": n.astype("int64"),
                         "label": n.map(lambda x: "long" if x >= 1000 else "short")})


# ------------------------------------------------------------ resumable runs
_RESIDENT: dict[str, Score] = {}     # of this worker: the model of the last run it served


def _resident(name: str, load: Callable[[], Score]) -> Score:
    if name not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[name] = load()
    return _RESIDENT[name]


def attempted(df: DataFrame, key_col: str, inputs: Column, load: Callable[[], Score], outputs: T.StructType) -> DataFrame:
    """(key, outputs, err, trace) for every row. A batch that fails is scored
    row by row, and the rows that fail get NULL outputs, the message and the
    trace. ``load`` runs once per Python worker."""
    name, columns = uuid.uuid4().hex, outputs.fieldNames()

    def one(score: Score, inputs: pd.Series) -> pd.DataFrame:
        try:
            out = score(inputs)[columns].reset_index(drop=True)
            if len(out) != len(inputs):
                raise ValueError(f"{len(out)} results for {len(inputs)} rows")
            return out.assign(err=None, trace=None)
        except Exception as failure:  # noqa: BLE001 - any failure of the model belongs to its rows
            if len(inputs) == 1:
                return pd.DataFrame({**{c: [None] for c in columns}, "err": [f"{type(failure).__name__}: {failure}"],
                                     "trace": [traceback.format_exc()]})
            return pd.concat([one(score, inputs.iloc[i:i + 1]) for i in range(len(inputs))], ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = _resident(name, load)
        for pdf in batches:
            if len(pdf):
                out = one(score, pdf["inputs"]).astype(object)
                out.insert(0, key_col, pdf[key_col].reset_index(drop=True))
                yield out.where(out.notna(), None)

    kind = df.select(key_col).schema[0]
    return df.select(key_col, inputs.alias("inputs")).mapInPandas(run, T.StructType([kind, *outputs.fields, *ATTEMPTS.fields]))


def score_resumable(df: DataFrame, load: Callable[[], Score], outputs: str, path: str, key_col: str = "url_hash",
                    inputs: str | Column = "text", run_id: int = 0, parts: int = 8, only: Iterable[int] | None = None,
                    buckets: int = 64) -> tuple[DataFrame, DataFrame]:
    """(scored, quarantine) of everything under ``path``, after the rows of
    ``df`` (unique keys) that are not there yet have been scored.

    The rows are dealt by key over ``parts`` parts; a finished part is a
    version of the journal, a keyed table of all attempts. A run that is
    started again with its ``run_id`` skips its finished parts, and no run
    scores a key that is in the journal: neither one that succeeded nor one
    in quarantine. Use another ``run_id`` for new rows. ``only`` restricts
    the call to some parts, to share a run among jobs one after the other."""
    spark: SparkSession = df.sparkSession
    fields = T.StructType.fromDDL(outputs)
    key = df.select(key_col).schema[0]
    journal = KeyedTable(spark, f"{path}/journal", key_col, T.StructType([key, *fields.fields, *ATTEMPTS.fields]), buckets)
    finished = KeyedTable(spark, f"{path}/parts", "part", "part string", 1)
    inputs = F.col(inputs) if isinstance(inputs, str) else inputs
    part = F.pmod(F.xxhash64(key_col, F.lit(3)), F.lit(parts))
    past = {r.part for r in finished.read().collect()}         # one row per part of a run
    for p in sorted(set(range(parts)) if only is None else set(only)):
        name = f"{run_id}:{p} of {parts}"
        if name in past:
            continue
        rows = df.where(F.col(key_col).isNotNull() & (part == p)).select(key_col, inputs.alias("_inputs"))
        left = rows.join(journal.read().select(key_col), key_col, "left_anti")
        version = max(journal.versions(), default=-1) + 1
        journal.append(version, attempted(left, key_col, F.col("_inputs"), load, fields))
        finished.append(max(finished.versions(), default=-1) + 1, spark.createDataFrame([(name,)], "part string"))
    done = journal.read()
    return (done.where("err IS NULL").select(key_col, *fields.fieldNames()),
            done.where("err IS NOT NULL").select(key_col, "err", "trace"))


def naive_bayes_scorer(model: dict, most: int = 500_000, digits: int = 6, weighed: bool = False) -> Callable[[], Score]:
    """A ``load`` for the library's naive Bayes (``text.nb_train``): (pred,
    score) as ``nb_classify`` gives them. The inputs are token arrays, and the
    model travels as one broadcast of at most ``most`` tokens; a larger one is
    refused. With ``weighed`` the inputs are what ``text.nb_weighed`` gives,
    the workers hold the classes only and the vocabulary has no bound."""
    weights = model["weights"]
    spark = weights.sparkSession
    rows = [] if weighed else weights.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} tokens; use text.nb_weighed")
    classes = [tuple(c) for c in model["classes"].first()[0]]
    shared = spark.sparkContext.broadcast(({r.token: dict(r.weights) for r in rows}, classes, math.log(model["alpha"])))

    def load() -> Score:
        known, classes, log_alpha = shared.value

        def counted(toks) -> tuple[float, list[list[float]]]:
            """The number of known tokens, and what each adds to each class."""
            counts = Counter(t for t in toks if t in known)
            return sum(counts.values()), [[f * known[t].get(label, 0.0) for t, f in counts.items()] for label, _, _ in classes]

        def given(array) -> tuple[float, list[list[float]]]:
            table = np.asarray([] if array is None else array, np.float64).reshape(-1, 1 + len(classes))
            return table[:, 0].sum(), (table[:, 1:] * table[:, :1]).T.tolist()

        def one(x) -> tuple[str, float]:
            n, terms = (given if weighed else counted)(x)
            best = [(-round(float(log_prior + n * (log_alpha - log_norm) + math.fsum(seen)), digits), label)
                    for (label, log_prior, log_norm), seen in zip(classes, terms)]
            minus, label = min(best, key=lambda x: (x[0], x[1] is None, 0 if x[1] is None else x[1]))      # the NULL class last
            return label, -minus

        def score(inputs: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([one(x) for x in inputs], columns=["pred", "score"], dtype=object)
        return score
    return load

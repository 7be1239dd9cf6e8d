"""Resumable scoring: poison rows, restarts, and the resident model."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsflow.functions.text import tokens
from newsflow.operators import scoring as Sc
from newsflow.operators import text as Tx
from newsflow.session import scratch_path


def counting_model(folder):
    """Writes a file per load and per scored row (tests run on one machine)."""
    def load():
        import tempfile
        tempfile.mkstemp(prefix="load-", dir=folder)

        def score(inputs):
            if (inputs == "poison").any():
                raise RuntimeError("cannot read this")
            for _ in inputs:
                tempfile.mkstemp(prefix="row-", dir=folder)
            return pd.DataFrame({"n": inputs.str.len().astype("int64"), "kind": ["x"] * len(inputs)})
        return score
    return load


def files(folder, kind):
    return sum(f.startswith(kind) for f in os.listdir(folder))


def test_poison_rows_and_a_restart(spark, tmp_path):
    docs = [(f"k{i}", "poison" if i % 13 == 5 else "t" * i) for i in range(60)] + [(None, "no key")]
    df = spark.createDataFrame(docs, "url_hash string, text string")
    path, load = scratch_path(spark, "t-score"), counting_model(str(tmp_path))
    args = dict(outputs="n long, kind string", path=path, parts=4, buckets=8)
    poison = {k for k, t in docs if t == "poison"}
    Sc.score_resumable(df, load, only=(0, 2), **args)                          # stopped after two parts
    half = files(tmp_path, "row-")
    assert 0 < half < 60
    good, bad = Sc.score_resumable(df, load, **args)
    assert {r.url_hash: (r.n, r.kind) for r in good.collect()} == {k: (len(t), "x") for k, t in docs if k and k not in poison}
    assert {r.url_hash for r in bad.collect()} == poison
    assert all(r.err == "RuntimeError: cannot read this" and "Traceback" in r.trace for r in bad.collect())
    rows = files(tmp_path, "row-")
    assert rows == 60 - len(poison)                                            # no row scored twice
    Sc.score_resumable(df, load, **args)                                       # all parts are there
    more = df.unionByName(spark.createDataFrame([("new", "abc"), ("newer", "poison")], df.schema))
    good, bad = Sc.score_resumable(more, load, run_id=1, **args)
    assert files(tmp_path, "row-") == rows + 1 and good.count() == rows + 1 and bad.count() == len(poison) + 1


def test_a_model_is_loaded_once_per_worker_and_run(spark, tmp_path):
    df = spark.range(200).select(F.concat(F.lit("k"), "id").alias("url_hash"), F.lit("abc").alias("text")).repartition(40)
    out = Sc.attempted(df, "url_hash", F.col("text"), counting_model(str(tmp_path)), Sc.T.StructType.fromDDL("n long, kind string"))
    assert out.where("n = 3 AND err IS NULL").count() == 200
    assert 1 <= files(tmp_path, "load-") <= 8                                  # 40 tasks, 4 workers at a time


def test_wrong_number_of_results(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "url_hash string, text string")
    load = lambda: lambda inputs: pd.DataFrame({"n": [1] * (2 if len(inputs) == 1 else 1)})
    out = Sc.attempted(df.coalesce(1), "url_hash", F.col("text"), load, Sc.T.StructType.fromDDL("n long"))
    assert {(r.url_hash, r.n, r.err) for r in out.collect()} == {(k, None, "ValueError: 2 results for 1 rows") for k in "ab"}


def test_resident_naive_bayes_equals_the_join(spark):
    train = spark.createDataFrame([(1, "sun sun rain", "a"), (2, "rain snow", "b"), (3, "sun", "a")], "doc_id long, text string, k string")
    model = Tx.nb_train(train, "k")
    docs = spark.createDataFrame([(5, "sun rain snow snow"), (6, "nothing known"), (7, "")], "doc_id long, text string")
    good, bad = Sc.score_resumable(docs, Sc.naive_bayes_scorer(model), "pred string, score double", scratch_path(spark, "t-nb"),
                                   "doc_id", tokens("text"), parts=2)
    assert sorted(map(tuple, good.collect())) == sorted(map(tuple, Tx.nb_classify(docs, model).collect())) and bad.count() == 0
    with pytest.raises(ValueError):
        Sc.naive_bayes_scorer(model, most=1)

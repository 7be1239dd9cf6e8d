"""Language identification: averaged hashed subword embeddings under a linear
softmax, trained by stochastic gradient descent in numpy.

Subwords are the 2- to 4-byte grams of a text's letters (ASCII lower-cased,
every other ASCII byte is a word border, a border may begin or end a gram),
hashed into ``BUCKETS`` rows of an embedding table. A text is the mean of its
grams' embeddings; a linear layer and a softmax over the learned languages
follow. As everything before the softmax is linear, prediction adds up one
row of per-language weights per gram and divides by their number, over the
whole text, in windows of bounded size.

Training uses a bounded, documented sample: at most ``per_class`` labelled
documents of each language, those with the least hash of their id (of those
with one id, the least hash of the text; equal texts of one id count once),
whole texts; gram counts are made in tasks and only they reach the driver. A part
of the sample is kept from the descent to calibrate: one temperature is
fitted to it by likelihood, and the rejection threshold is the
``reject_quantile`` quantile of the calibrated confidence in its true
languages, so about that share of proper documents would be rejected, but
never more than a quarter above an even guess (``1 / languages + 0.25``): a
text that the model is that sure of is not rejected, whatever the sample
says.

Defined results: a text that is NULL or has no letter gets ``und`` with
score 0 and is rejected; ties go to the language that sorts first; rows,
repeated ones included, are scored one by one; other columns pass through.
One learned language always scores 1; without any labelled text every text
is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, utf8_of, worker_cache

BUCKETS = 1 << 15
DIM = 12
GRAMS = (2, 3, 4)
PER_CLASS = 800          # labelled documents of a language that training reads
MAX_CLASSES = 1000
WINDOW = 1 << 17         # bytes of text worked on at a time
UND = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def _grams(folded: np.ndarray, upto: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start positions below ``upto``, buckets) of the grams of each length."""
    border = folded == 32
    wide = folded.astype(np.uint32)
    for n in GRAMS:
        m = min(len(folded) - n + 1, upto)
        if m <= 0:
            continue
        ok = ~(border[:m] & border[1:m + 1]) if n == 2 else ~border[1:m + 1]
        value = wide[:m] | (wide[1:m + 1] << np.uint32(8))
        for i in range(2, n):
            value |= wide[i:m + i] << np.uint32(8 * i)
            if i < n - 1:
                ok &= ~border[i:m + i]
        at = np.flatnonzero(ok)
        value = (value[at] + np.uint32(n)) * np.uint32(2654435761)
        yield at, (value >> np.uint32(32 - 15)).astype(np.int32)


def _laid_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with a border before every document and at the end, and
    the positions of these borders."""
    n = len(offsets) - 1
    starts = offsets + np.arange(n + 1)
    out = np.full(len(data) + n + 1, 32, np.uint8)
    for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        np.take(_FOLD, data[lo:hi], out=out[lo + i + 1:hi + i + 1])
    return out, starts


def gram_sums(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the table's rows over the grams of each text, numbers of grams)."""
    folded, starts = _laid_out(data, offsets)
    n = len(offsets) - 1
    sums, counts = np.zeros((n, table.shape[1])), np.zeros(n, np.int64)
    for lo in range(0, int(starts[-1]), WINDOW):
        hi = min(lo + WINDOW, int(starts[-1]))
        first, last = np.searchsorted(starts, [lo, hi], side="right") - 1  # documents in the window
        last = min(last, n - 1)
        edges = np.clip(starts[first:last + 2], lo, hi) - lo
        for at, bucket in _grams(folded[lo:hi + max(GRAMS) - 1], hi - lo):
            cuts = np.searchsorted(at, edges)
            upto = np.vstack([np.zeros((1, table.shape[1])), np.cumsum(table[bucket], axis=0, dtype=np.float64)])
            sums[first:last + 1] += upto[cuts[1:]] - upto[cuts[:-1]]
            counts[first:last + 1] += np.diff(cuts)
    return sums, counts


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, how often each occurs) of one whole text."""
    data = np.frombuffer(text.encode(), np.uint8)
    folded, _ = _laid_out(data, np.array([0, len(data)]))
    total = np.zeros(BUCKETS, np.int64)
    for lo in range(0, len(folded), WINDOW):
        for _, bucket in _grams(folded[lo:lo + WINDOW + max(GRAMS) - 1], WINDOW):
            total += np.bincount(bucket, minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found, total[found]


@dataclass
class Model:
    classes: list[str]
    weights: np.ndarray      # BUCKETS x classes: embedding times linear layer
    bias: np.ndarray
    temperature: float
    threshold: float

    def score(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        logits = sums / np.maximum(counts, 1)[:, None] + self.bias
        return softmax(logits / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (bucket, count) in enumerate(rows):
        if len(bucket):
            x[i, bucket] = count / count.sum()
    return x


def descend(rows, y: np.ndarray, n_classes: int, epochs: int = 12, batch: int = 32,
            rate: float = 4.0, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Stochastic gradient descent on the mean log loss, with a rate that
    falls linearly to zero; (embedding times linear layer, bias)."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    lin = rng.normal(0, 0.5, (DIM, n_classes)).astype(np.float32)
    bias = np.zeros(n_classes, np.float32)
    steps, step = epochs * -(-len(y) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            some = order[lo:lo + batch]
            now = np.float32(rate * (1 - step / steps))
            step += 1
            x = _dense([rows[i] for i in some])
            mean = x @ emb
            err = softmax(mean @ lin + bias)
            err[np.arange(len(some)), y[some]] -= 1
            err /= len(some)
            back = err @ lin.T
            lin -= now * (mean.T @ err)
            bias -= now * err.sum(axis=0)
            emb -= (now * 50) * (x.T @ back)  # a gram is a small part of a mean
    return (emb @ lin).astype(np.float32), bias.astype(np.float64)


def calibrate(logits: np.ndarray, y: np.ndarray, reject_quantile: float) -> tuple[float, float]:
    """(temperature of least log loss, threshold on the confidence)."""
    if not len(y):
        return 1.0, 0.0
    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()
    t = min(np.geomspace(0.05, 20, 121).tolist(), key=loss)
    sure = softmax(logits / t)[np.arange(len(y)), y]
    return t, float(min(np.quantile(sure, reject_quantile), 1 / logits.shape[1] + 0.25))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, out = batch.column("text"), []
        for i in range(len(texts)):
            bucket, count = gram_counts(texts[i].as_py() or "")
            out.append((bucket.astype("<i4").tobytes(), count.astype("<f4").tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("h"), batch.column("t"), batch.column("lang"), pa.array([o[0] for o in out], pa.binary()),
             pa.array([o[1] for o in out], pa.binary())], names=["h", "t", "lang", "bucket", "count"])


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_class: int = PER_CLASS, reject_quantile: float = 0.001) -> Model:
    """Fit a model to a bounded sample of labelled documents."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
                       F.xxhash64(F.col(id_col), F.lit(17)).alias("h"), F.xxhash64(text_col).alias("t"))
    # the sample is named by hash thresholds per language, found on narrow columns
    nth = Window.partitionBy("lang").orderBy("h", "t")
    last = (rows.select("lang", "h", "t").withColumn("n", F.dense_rank().over(nth)).where(F.col("n") <= per_class)
            .groupBy("lang").agg(F.max("h").alias("h"), F.max_by("t", F.col("n")).alias("t")).limit(MAX_CLASSES + 1).collect())
    if len(last) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} languages")
    if not last:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    taken = F.lit(False)
    for r in last:
        taken = taken | ((F.col("lang") == r.lang) & ((F.col("h") < r.h) | ((F.col("h") == r.h) & (F.col("t") <= r.t))))
    sample = (rows.where(taken).dropDuplicates(["lang", "h", "t"])
              .mapInArrow(_count_batches, "h long, t long, lang string, bucket binary, count binary").collect())
    sample.sort(key=lambda r: (r.h, r.t, r.lang))
    classes = sorted({r.lang for r in sample})
    x = [(np.frombuffer(r.bucket, "<i4"), np.frombuffer(r["count"], "<f4")) for r in sample]
    y = np.array([classes.index(r.lang) for r in sample])
    kept = np.arange(len(y)) % 5 == 4  # for the calibration
    if not kept.any() or len(set(y[~kept])) < len(classes):
        kept[:] = False
    fit = np.flatnonzero(~kept)
    weights, bias = descend([x[i] for i in fit], y[fit], len(classes))
    held = np.flatnonzero(kept)
    logits = np.array([(weights[b] * (c / c.sum())[:, None]).sum(axis=0) + bias if len(b) else bias
                       for b, c in (x[i] for i in held)]).reshape(len(held), len(classes))
    return Model(classes, weights, bias, *calibrate(logits, y[held], reject_quantile))


def _identify(model, text_col: str, letters_col: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("langid")
        m: Model = model.value
        names = np.array([*m.classes, UND], dtype=object)
        for batch in batches:
            data, offsets = utf8_of(batch.column(text_col))
            sums, counts = gram_sums(data, offsets, m.weights)
            letters = batch.column(letters_col).to_numpy(zero_copy_only=False).astype(bool)
            if m.classes:
                p = m.score(sums, counts)
                best, score = p.argmax(axis=1), p.max(axis=1)
            else:
                best, score, letters = np.zeros(len(counts), int), np.zeros(len(counts)), letters & False
            best, score = np.where(letters, best, len(m.classes)), np.where(letters, np.round(score, 6), 0.0)
            found = pa.StructArray.from_arrays(
                [pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(~letters | (score < m.threshold))],
                names=["lang_pred", "score", "rejected"])
            kept = [c for c in batch.schema.names if c != letters_col]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), found], names=[*kept, out])
    return run


def identify(docs: DataFrame, model: Model, text_col: str = "text", out: str = "lang_id") -> DataFrame:
    """Adds the struct ``out``: lang_pred, score (calibrated confidence, 0 to
    1), rejected. The model is broadcast; its size is BUCKETS x languages."""
    spark: SparkSession = docs.sparkSession
    letters, = fresh(docs, "has_letter")
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.StructType([
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType())]))])
    marked = docs.withColumn(letters, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    return marked.mapInArrow(_identify(spark.sparkContext.broadcast(model), text_col, letters, out), schema)

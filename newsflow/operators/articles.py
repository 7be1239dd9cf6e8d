"""Article assembly from late, unordered model results (SRC2, J1, J8,
F10-F13, SNK3-SNK5).

The reference reads a row, adds one field and writes the whole row back,
so two results racing on one article can lose a field. Here every result
becomes a *patch* (url_hash, field values, arrival time); patches are
reduced per article with ``max_by`` over the arrival order of the rows
that carry the field, then merged field-wise into the base rows. The
result is the same whatever order the results arrive in, and applying
the same patches twice gives the same rows (idempotent).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

TASKS = ("classification", "summary")


def inference_tasks(articles: DataFrame, tasks: Iterable[str] = TASKS,
                    prefix: str = "results") -> DataFrame:
    """SNK5/F12: two requests per article; the output location is the last
    path segment of the result object's URI."""
    t = F.explode(F.array(*[F.lit(x) for x in tasks])).alias("task")
    x = articles.select("url_hash", t)
    uri = F.concat_ws("/", F.lit(prefix), F.col("task"),
                      F.concat(F.md5(F.concat_ws(":", "url_hash", "task")), F.lit(".out")))
    return x.select(F.element_at(F.split(uri, "/"), -1).alias("output_location"), "url_hash", "task")


def page_articles(parsed: DataFrame, keywords: DataFrame, tasks: Iterable[str] = TASKS) -> DataFrame:
    """E1 as one job: parsed pages (one row per url_hash) become article rows
    with their keywords (url_hash, rank, gram), the model payload and the
    output location of each task as ``<task>_location``."""
    from .pages import payload
    words = keywords.groupBy("url_hash").agg(F.array_sort(F.collect_list(F.struct("rank", "gram"))).alias("_k")).select(
        "url_hash", F.transform("_k", lambda k: k["gram"]).alias("keywords"))
    places = inference_tasks(parsed, tasks).groupBy("url_hash").agg(
        *[F.max(F.when(F.col("task") == t, F.col("output_location"))).alias(f"{t}_location") for t in tasks])
    return (parsed.drop("text").join(words, "url_hash", "left").join(payload(parsed), "url_hash").join(places, "url_hash"))


def extract_tags(results: DataFrame, body_col: str = "body") -> DataFrame:
    """SRC2/F10: label of every element of a classification result -> tags."""
    parsed = F.from_json(F.col(body_col), schemas.CLASSIFICATION_RESULT)
    return results.withColumn("tags", F.transform(parsed, lambda e: e["label"]))


def extract_summary(results: DataFrame, body_col: str = "body") -> DataFrame:
    """SRC2/F11: summary_text of the first element (NULL if the array is
    empty: the reference fails on it and writes nothing)."""
    parsed = F.from_json(F.col(body_col), schemas.SUMMARY_RESULT)
    return results.withColumn("summary", F.try_element_at(parsed, F.lit(1))["summary_text"])


def result_to_article(results: DataFrame, tasks: DataFrame, articles: DataFrame) -> DataFrame:
    """Result -> task (by output location) -> article (by url_hash)."""
    return (results.join(tasks, "output_location")
            .join(articles.select("url_hash", "title"), "url_hash"))


def result_patches(class_results: DataFrame, summary_results: DataFrame,
                   tasks: DataFrame) -> DataFrame:
    """Both result feeds as patches (url_hash, tags, summary, arrived_at)."""
    c = extract_tags(class_results).join(tasks.select("output_location", "url_hash"), "output_location")
    s = extract_summary(summary_results).join(tasks.select("output_location", "url_hash"), "output_location")
    s = s.where(F.col("summary").isNotNull())
    c = c.select("url_hash", "output_location", "tags", F.lit(None).cast("string").alias("summary"),
                 "arrived_at")
    s = s.select("url_hash", "output_location", F.lit(None).cast("array<string>").alias("tags"),
                 "summary", "arrived_at")
    return c.unionByName(s)


def reduce_patches(patches: DataFrame, fields: Iterable[str] = ("tags", "summary"),
                   order_col: str = "arrived_at", tie_col: str = "output_location") -> DataFrame:
    """Latest value of each field per article among the patches carrying
    it (partial aggregation: a hot article is reduced map-side)."""
    aggs = []
    for f in fields:
        order = F.when(F.col(f).isNotNull(), F.struct(order_col, tie_col))
        aggs.append(F.max_by(f, order).alias(f))
    # a patch that carries no value (an unreadable result) moves no time
    carries = F.lit(False)
    for f in fields:
        carries = carries | F.col(f).isNotNull()
    aggs.append(F.max(F.when(carries, F.col(order_col))).alias(order_col))
    return patches.groupBy("url_hash").agg(*aggs)


def upsert_merge(base: DataFrame, patch: DataFrame, key: str = "url_hash",
                 order_col: str | None = None) -> DataFrame:
    """SNK4/J8: field-wise merge; a patch value replaces the base value,
    a NULL patch value keeps it; keys only in the patch are inserted.
    Several patches of one key are reduced first, per field: the value of
    greatest ``order_col`` among the patches that carry the field (greatest
    value on ties, and where there is no order)."""
    pcols = [c for c in patch.columns if c not in (key, order_col)]
    order = [F.col(order_col)] if order_col else []

    def rank(c):
        value = F.to_json(F.struct(c)) if isinstance(patch.schema[c].dataType, T.MapType) else F.col(c)
        return F.when(F.col(c).isNotNull(), F.struct(*order, value.alias("v")))

    patch = patch.groupBy(key).agg(*[F.max_by(c, rank(c)).alias(c) for c in pcols]) if pcols else patch.select(key).distinct()
    b = base.select(key, *[F.col(c).alias(f"_b_{c}") for c in base.columns if c != key])
    p = patch.select(key, *[F.col(c).alias(f"_p_{c}") for c in pcols])
    j = b.join(p, key, "full_outer")
    out = [F.col(key)]
    for c in base.columns:
        if c == key:
            continue
        out.append(F.coalesce(f"_p_{c}", f"_b_{c}").alias(c) if c in pcols else F.col(f"_b_{c}").alias(c))
    out += [F.col(f"_p_{c}").alias(c) for c in pcols if c not in base.columns]
    return j.select(*out)


def metadata_merge(base: DataFrame, class_results: DataFrame, summary_results: DataFrame,
                   tasks: DataFrame, indexed_col: str = "indexed_at") -> DataFrame:
    """Articles with the latest tags and summary from their results;
    indexed_at = arrival of the newest result applied. Results for unknown
    articles are dropped (the reference's lookup fails)."""
    red = reduce_patches(result_patches(class_results, summary_results, tasks))
    red = red.withColumnRenamed("arrived_at", indexed_col)
    red = red.join(base.select("url_hash"), "url_hash", "left_semi")
    if indexed_col in base.columns:  # an older result does not turn the time back
        known = base.select("url_hash", F.col(indexed_col).alias("_known"))
        red = (red.join(known, "url_hash").withColumn(indexed_col, F.greatest(indexed_col, "_known")).drop("_known"))
    return upsert_merge(base, red)


def upsert_replace(base: DataFrame, updates: DataFrame, key: str = "url_hash",
                   order_col: str | None = None) -> DataFrame:
    """SNK3: whole-row replace by key; attributes missing from the new row
    are lost, as in a key-value put. Without ``order_col`` any update beats
    the base row; with it the greatest ``order_col`` (compared in its own
    type) wins over base and update rows alike, updates first on ties, so
    the result does not depend on the order in which updates arrive. What
    still ties is decided by a hash of the row.

    The winners are picked on (key, order, hash) alone; bodies meet them in
    one join, so whole rows are never sorted or carried through the
    aggregate."""
    cols = base.columns
    own = order_col is not None and order_col in cols
    rows = base.select(*cols, F.lit(0).alias("_src"), *([F.col(order_col).alias("_ord")] if own else []))
    new = updates.select(*cols, F.lit(1).alias("_src"),
                         *([F.col(order_col).alias("_ord")] if order_col else []))
    allrows = rows.unionByName(new, allowMissingColumns=True)
    hashed = [F.to_json(F.struct(c)) if isinstance(base.schema[c].dataType, T.MapType) else F.col(c) for c in cols]
    allrows = allrows.withColumn("_hash", F.xxhash64(*hashed))
    order = ["_ord", "_src", "_hash"] if own else ["_src", "_ord", "_hash"] if order_col else ["_src", "_hash"]
    best = allrows.groupBy(key).agg(F.max(F.struct(*order)).alias("_best"))
    won = allrows.join(best, key).where(F.struct(*order).eqNullSafe(F.col("_best")))
    # rows equal in all columns are one row
    return won.select(*cols, "_src").dropDuplicates([key]).select(*cols)


def put_versioned(rows: DataFrame, path: str, version: int) -> str:
    """SNK1-SNK4 as a batch write: the complete table of a version under
    ``path/v=<version>``. A version is written once and becomes visible with
    its success mark; a repeated run writes the same version again."""
    target = f"{path.rstrip('/')}/v={version}"
    rows.write.mode("overwrite").parquet(target)
    return target

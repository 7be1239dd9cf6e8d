"""Link-graph expansion (G1-G5, T2, U3, A6 on the frontier).

``bfs_frontier`` is level-synchronous breadth-first search over an edge
table. Only the newest level (the frontier) meets the edges; what it reaches
is reduced to one row per URL hash and anti-joined with everything known
(visited, or target of a visited redirect). The seed that a URL is reached
from travels with it as a number that follows (seed position, tag); when
several parents reach a URL in the same level, the least seed wins, which is
first-in-first-out order of a crawler's queue. The visit budget counts
distinct visits and is cut inside a level by (seed_pos, url_hash).

Tables: links (one row per source: what it links to, and its redirect
targets) are bucketed by source hash, visits by URL hash, so a level joins its
frontier with the links and its new URLs with all that is known bucket by
bucket: neither the links nor the visits are shuffled in any level. The one
exchange of a level carries (URL hash, number), reduced before it; the number
holds kind, level and seed in this order, so the reduction is the minimum of a
long. URLs, tags and positions meet the hashes once, at the end.

A job takes several levels, as a row stream: a level's rows give out
themselves and, the newest ones, their links, so every level reads the one
before it once: two joins and one exchange to a level. Jobs begin with one
level and double while they find at most ``LIGHT`` rows; a job that finds more
is followed by one of a single level, so that a walk that grows is cut at its
budget. Jobs append to the visits, one file per bucket each; every
``COMPACT_EVERY`` jobs they are written anew, as one file per bucket.

The tables are external ones under the session's shared checkpoint folder,
dropped from the catalog at the end: a lost executor costs one job at most.
Bucketed joins need no statistics. There is a bucket for every ``PER_BUCKET``
links, ``spark.sql.shuffle.partitions`` at most and ``LEAST`` at least: a walk
of many small levels pays for the tasks and the planning of every level, not
for its rows, so a level names one table of links and one of visits, without
partitions to list, and the levels after a light job are not compiled into
whole stages. The driver receives counts only. Only the budget cut (at most ``max_visits`` rows per
partition) passes through a single ordered task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import ensure_checkpoint_dir, materialize, scratch_path

LIGHT = 100_000        # visits of a job up to which the next one takes twice its levels
COMPACT_EVERY = 6      # jobs
PER_BUCKET, LEAST = 100_000, 4     # links of a bucket, buckets
LEVEL, BARRED, REACHED = 1 << 47, 1 << 61, 1 << 62     # in a mark, above the seed


class _Bucketed:
    """An external table bucketed by a column, and as many partitions of a
    shuffle by it."""

    def __init__(self, spark: SparkSession, name: str, key: str, buckets: int, partition: str | None = None):
        self.spark, self.key, self.buckets, self.partition = spark, key, buckets, partition
        self.path = scratch_path(spark, name)
        self.name = f"newsflow_{name.replace('-', '_')}_{uuid.uuid4().hex}"

    def dealt(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.buckets, self.key)

    def append(self, df: DataFrame) -> None:
        """``df`` must already be dealt by the key."""
        w = df.write.mode("append").option("path", self.path).bucketBy(self.buckets, self.key).sortBy(self.key)
        (w.partitionBy(self.partition) if self.partition else w).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def files(self, spark: SparkSession, schema) -> DataFrame:
        """The rows without the table, which may be dropped."""
        return spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def next_level(state: str, links: str, known: list[str]) -> str:
    """SQL for one more level of (url_hash, mark, fresh), relations given by
    name or in parentheses. mark is kind << 61 | level << 47 | seed; kinds are
    visited, barred and reached, in this order, so the least mark of a hash
    says what becomes of it: what is only reached is visited, and fresh. Fresh
    rows that a table of known hashes has go."""
    none = "CAST(array() AS ARRAY<STRING>)"
    rows = (f"concat(array(named_struct('h', s.url_hash, 'm', s.mark)), "
            f"transform(coalesce(l.dst_hashes, {none}), d -> named_struct('h', d, 'm', s.mark + {REACHED + LEVEL})), "
            f"transform(coalesce(l.final_hashes, {none}), d -> named_struct('h', d, 'm', {BARRED})))")
    anti = "".join(f" LEFT ANTI JOIN {k} k{i} ON r.url_hash = k{i}.url_hash AND r.fresh" for i, k in enumerate(known))
    return f"""SELECT r.* FROM (
  SELECT url_hash, if(m >= {REACHED}, m - {REACHED}, m) AS mark, m >= {REACHED} AS fresh FROM (
    SELECT e.h AS url_hash, min(e.m) AS m FROM (
      SELECT explode({rows}) AS e FROM {state} s LEFT JOIN {links} l ON s.url_hash = l.src_hash AND s.fresh)
    GROUP BY e.h)) r{anti}"""


def walk_sql(start: str, steps: int, links: str, known: list[str]) -> str:
    """SQL for some levels from ``start``, each a name for the next one."""
    levels = [f"s0 AS ({start})"] + [f"s{i + 1} AS ({next_level(f's{i}', links, known)})" for i in range(steps)]
    return f"WITH {', '.join(levels)} SELECT * FROM s{steps}"


def bucket_count(links: int, most: int) -> int:
    """Buckets for so many links, ``most`` of them at most."""
    return min(most, max(LEAST, -(-links // PER_BUCKET)))


def bfs_frontier(seeds: DataFrame, edges: DataFrame, seen: DataFrame | None = None,
                 max_visits: int | None = 500, max_depth: int | None = None,
                 aliases: DataFrame | None = None, levels_per_job: int = 12) -> DataFrame:
    """(url_hash, url, tag, seed_pos, depth) of every visit.

    seeds: (tag, url, seed_pos); edges: (src_url, dst_url), URLs already
    canonical; seen: optional (url_hash) stored from earlier runs (G5),
    never visited and never expanded; aliases: optional (url, final_url),
    canonical: the redirect target of a visited URL counts as seen from the
    next level on (G3), while one that is reached in the same level, or
    before, is visited as well. levels_per_job: the most levels of a job
    (they are one statement, and Spark's analyser gives up beyond some twenty).
    """
    spark = seeds.sparkSession
    ensure_checkpoint_dir(spark)

    # seeds in the order of (position, tag); an increasing id follows a sort
    seeds = seeds.select("url", "tag", F.col("seed_pos").cast("int").alias("seed_pos"))
    numbered = materialize(seeds.select("seed_pos", "tag").distinct().orderBy("seed_pos", "tag")
                           .withColumn("seed", F.monotonically_increasing_id()), "bfs-seeds")
    same = seeds["seed_pos"].eqNullSafe(numbered["seed_pos"]) & seeds["tag"].eqNullSafe(numbered["tag"])
    first = seeds.join(numbered, same).select(F.md5("url").alias("url_hash"), "url", "seed")
    pairs = edges.where(F.col("src_url").isNotNull() & F.col("dst_url").isNotNull()).select(
        F.md5("src_url").alias("src_hash"), F.md5("dst_url").alias("url_hash"), F.col("dst_url").alias("url"))
    if seen is not None:
        pairs = pairs.join(seen.select("url_hash"), "url_hash", "left_anti")
        first = first.join(seen.select("url_hash"), "url_hash", "left_anti")
    pairs = materialize(pairs, "bfs-pairs")
    buckets = bucket_count(pairs.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))

    # a chain of bucketed joins leaves adaptive execution nothing to adapt, and
    # it would plan the rest of the chain anew after every level
    chain = spark.newSession()
    chain.conf.set("spark.sql.adaptive.enabled", "false")
    chain.conf.set("spark.sql.shuffle.partitions", str(buckets))
    links = _Bucketed(chain, "bfs-links", "src_hash", buckets)
    visits, appended = _Bucketed(chain, "bfs-visits", "url_hash", buckets), 0
    out_links = pairs.select("src_hash", F.col("url_hash").alias("dst"), F.lit(None).cast("string").alias("final"))
    if aliases is not None:
        out_links = out_links.unionByName(aliases.where("url <> final_url").select(
            F.md5("url").alias("src_hash"), F.lit(None).cast("string").alias("dst"), F.md5("final_url").alias("final")))
    links.append(links.dealt(out_links).groupBy("src_hash").agg(F.collect_set("dst").alias("dst_hashes"),
                                                                 F.collect_set("final").alias("final_hashes")))
    level = F.shiftright("mark", 47).bitwiseAND(F.lit((1 << 14) - 1)).cast("int")
    visited = F.col("mark") < BARRED

    def write(state: DataFrame, job: int, base: int) -> None:
        visits.append(state.select("url_hash", F.col("mark").bitwiseAND(F.lit(LEVEL - 1)).alias("seed"), visited.alias("visited"),
                                   (level + base).alias("depth"), F.col("fresh"), F.lit(job).alias("job")))

    def found(job: int, depth: int) -> tuple[int, int]:
        """(rows that a job visited, those of them in its last level)."""
        rows = visits.read().where((F.col("job") == job) & F.col("visited"))
        return tuple(rows.agg(F.count(F.lit(1)), F.count_if(F.col("depth") == depth)).first())

    write(visits.dealt(first).groupBy("url_hash").agg(F.min("seed").alias("mark")).withColumn("fresh", F.lit(True)), 0, 0)
    job = depth = 0
    steps = 1
    new = n_visited = n = found(0, 0)[0]
    while n and (max_depth is None or depth < max_depth) and (max_visits is None or n_visited < max_visits):
        steps = min(steps, levels_per_job) if max_depth is None else min(steps, levels_per_job, max_depth - depth)
        appended += 1
        if appended > COMPACT_EVERY:
            old, visits, appended = visits, _Bucketed(chain, "bfs-visits", "url_hash", buckets), 1
            visits.append(old.read())
            old.drop()
        start = (f"SELECT url_hash, seed AS mark, true AS fresh FROM {visits.name} "
                 f"WHERE job = {job} AND visited AND depth = {depth}")
        chain.conf.set("spark.sql.codegen.wholeStage", str(new > LIGHT).lower())
        state = chain.sql(walk_sql(start, steps, links.name, [visits.name]))
        job += 1
        # the frontier's own rows, of level 0, are there already
        write(state.where(~visited | (level > 0)), job, depth)
        depth += steps
        new, n = found(job, depth)
        n_visited += new
        steps = 2 * steps if new <= LIGHT else 1

    schema = "url_hash string, seed long, visited boolean, depth int"
    out = visits.files(spark, schema).where("visited").select("url_hash", "seed", "depth")
    for t in (links, visits):
        t.drop()
    if max_visits is not None and n_visited > max_visits:
        # the budget cut inside the last level: (depth, seed_pos, url_hash)
        ranked = out.join(numbered, "seed").orderBy("depth", F.asc("seed_pos"), "url_hash").limit(max_visits)
        out = materialize(ranked.select("url_hash", "seed", "depth"), "bfs-cut")
    urls = pairs.select("url_hash", "url").unionByName(first.select("url_hash", "url")).distinct()
    return (out.join(urls, "url_hash").join(numbered, "seed")
            .select("url_hash", "url", "tag", "seed_pos", F.col("depth").cast("int").alias("depth")))


def redirects(crawl: DataFrame) -> DataFrame:
    """(url, final_url) of the crawl records that were redirected, canonical."""
    both = crawl.where(F.col("real_url").isNotNull()).select(
        U.canonical_url("url").alias("url"), U.canonical_url("real_url").alias("final_url"))
    return both.where(F.col("url") != F.col("final_url")).distinct()


def seen_with_redirects(crawl: DataFrame) -> DataFrame:
    """Hashes of the requested URLs and of the final URLs they were
    redirected to (both canonical)."""
    req = crawl.select(U.canonical_url("url").alias("url"))
    red = crawl.where(F.col("real_url").isNotNull()).select(U.canonical_url("real_url").alias("url"))
    return req.unionByName(red).distinct().select(F.md5("url").alias("url_hash"), "url")


def unseen(candidates: DataFrame, seen: DataFrame, url_col: str = "url") -> DataFrame:
    """Candidate URLs whose hash is not in the stored seen set."""
    c = candidates.select(F.md5(url_col).alias("url_hash"), F.col(url_col).alias("url")).distinct()
    return c.join(seen.select("url_hash"), "url_hash", "left_anti")

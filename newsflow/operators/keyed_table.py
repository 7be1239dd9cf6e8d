"""Tables by key whose upserts touch only the buckets of their keys (SNK3,
SNK4), and the set of URLs seen in all runs (G5, A6).

A ``KeyedTable`` is Parquet in hash buckets of its key:
``<path>/data/w=<version>/<bucket>/`` holds what a version wrote and
``<path>/manifest/<version>.json`` names the folders of every bucket. A
version reads the buckets that its rows fall into, writes them anew (or adds
files, for rows with new keys) and then publishes its manifest; the folders of
all other buckets are named again, not rewritten. Until the manifest is there
readers see the version before. A version that exists is never written again,
so a repeated run changes nothing, and one that failed half-way overwrites its
own folder.

A ``SeenSet`` is a keyed table of hashes with a Bloom filter to each bucket.
Candidates meet the filter of their bucket first; only buckets in which a
candidate may be known are read, for an exact anti join. New hashes are added
as files and set in the filters (bitwise or); a filter that has become too
full is made anew, larger, from its bucket. Both are work of one task per
bucket: hashes spread evenly, so choose the number of buckets such that one of
them, and its part of a run, is a task's worth.

The driver handles names of buckets and folders only. One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .articles import upsert_merge, upsert_replace

FOLDERS = 16          # of a bucket, before added files are put together
FILTER_BITS = 16      # of a filter, to every hash in its bucket
FILTER_LEAST = 1 << 12
FILTER_HASHES = 6


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, schema: str | T.StructType, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._bucket = "_bucket"
        while self._bucket in {c.lower() for c in self.schema.fieldNames()}:
            self._bucket = "_" + self._bucket

    # -------------------------------------------------------------- manifest
    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/manifest")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict[int, list[str]]:
        """Bucket to the folders that hold it, at a version (the newest)."""
        past = [v for v in self.versions() if version is None or v <= version]
        if not past:
            return {}
        row = self.spark.read.text(f"{self.path}/manifest/{past[-1]}.json", wholetext=True).first()
        return {int(b): folders for b, folders in json.loads(row[0]).items()}

    def _publish(self, version: int, folders: dict[int, list[str]]) -> None:
        """The file appears under its name when it is complete."""
        fs, draft = self._fs(f"{self.path}/manifest/_{version}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({str(b): folders[b] for b in sorted(folders)}).encode()))
        out.close()
        if not fs.rename(draft, draft.getParent().suffix(f"/{version}.json")):
            raise RuntimeError(f"{self.path}: version {version} could not be published")

    # ------------------------------------------------------------------ read
    def bucket_of(self, key: str | Column | None = None) -> Column:
        return F.pmod(F.xxhash64(self.key if key is None else key), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows at a version (the newest), of some buckets (all)."""
        folders = self.manifest(version)
        wanted = sorted(folders if buckets is None else set(buckets) & set(folders))
        paths = [f"{self.path}/{f}" for b in wanted for f in folders[b]]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that rows fall into, at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket_of().alias("b")).distinct().collect())

    # ----------------------------------------------------------------- write
    def _write(self, version: int, rows: DataFrame, replaced: Iterable[int]) -> list[int]:
        """Write rows by bucket and publish: ``replaced`` buckets hold only
        them from now on, other buckets hold them as well."""
        target = f"data/w={version}"
        marked = rows.select(*self.schema.fieldNames()).withColumn(self._bucket, self.bucket_of())
        (marked.repartition(self._bucket).write.mode("overwrite").partitionBy(self._bucket).parquet(f"{self.path}/{target}"))
        fs, p = self._fs(f"{self.path}/{target}")
        names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
        written = sorted(int(n.split("=")[1]) for n in names if n.startswith(self._bucket + "="))
        folders = {b: f for b, f in self.manifest().items() if b not in set(replaced)}
        for b in written:
            folders[b] = [*folders.get(b, []), f"{target}/{self._bucket}={b}"]
        self._publish(version, folders)
        return written

    def _is_next(self, version: int) -> bool:
        """Whether a version is to be written; one that exists is not."""
        past = self.versions()
        if version not in past and past and version < past[-1]:
            raise ValueError("versions are written in order")
        return version not in past

    def put(self, version: int, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Write the buckets of ``rows`` as ``merge(what they hold, rows)``;
        the buckets that were written (none if the version exists)."""
        if not self._is_next(version):
            return []
        rows = materialize(rows, "keyed-rows")
        buckets = self.touched(rows)
        return self._write(version, merge(self.read(buckets=buckets), rows), buckets)

    def append(self, version: int, rows: DataFrame) -> list[int]:
        """Add rows, whose keys are new, as files; a bucket of ``FOLDERS``
        folders is put together on the way."""
        if not self._is_next(version):
            return []
        rows = materialize(rows.select(*self.schema.fieldNames()), "keyed-rows")
        full = {b for b, folders in self.manifest().items() if len(folders) >= FOLDERS}
        together = sorted(full & set(self.touched(rows)))
        return self._write(version, rows.unionByName(self.read(buckets=together)) if together else rows, together)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove the older manifests and the folders that the newest ``keep``
        versions do not name; readers of older versions must be done."""
        past = self.versions()
        named = {f for v in past[-keep:] for folders in self.manifest(v).values() for f in folders}
        fs, data = self._fs(f"{self.path}/data")
        gone = []
        for w in fs.listStatus(data) if fs.exists(data) else []:
            if past and int(w.getPath().getName()[2:]) > past[-1]:
                continue          # of a version that is being written
            for b in fs.listStatus(w.getPath()):
                name = f"data/{w.getPath().getName()}/{b.getPath().getName()}"
                if b.isDirectory() and name not in named:
                    fs.delete(b.getPath(), True)
                    gone.append(name)
        for v in past[:-keep]:
            fs.delete(self._fs(f"{self.path}/manifest/{v}.json")[1], False)
        return sorted(gone)


def merge_into(table: KeyedTable, version: int, patch: DataFrame, order_col: str | None = None) -> list[int]:
    """SNK4: ``upsert_merge`` of a patch into a keyed table."""
    def merge(base: DataFrame, new: DataFrame) -> DataFrame:
        out = upsert_merge(base, new, table.key, order_col)
        lacking = [c for c in table.schema.fieldNames() if c not in out.columns]
        return out.withColumns({c: F.lit(None).cast(table.schema[c].dataType) for c in lacking}) if lacking else out
    return table.put(version, patch, merge)


def replace_into(table: KeyedTable, version: int, rows: DataFrame, order_col: str | None = None) -> list[int]:
    """SNK3: ``upsert_replace`` of whole rows into a keyed table."""
    return table.put(version, rows, lambda base, new: upsert_replace(base, new, table.key, order_col))


# ------------------------------------------------------------------ seen set
def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """Bits of hashes in a filter of a power of two of bits."""
    h = h.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[:, None] + step[:, None] * np.arange(FILTER_HASHES, dtype=np.uint64)) & np.uint64(bits - 1)


def _filled(h: np.ndarray, filter_: np.ndarray) -> np.ndarray:
    at = _places(h, len(filter_) * 8).ravel()
    np.bitwise_or.at(filter_, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))
    return filter_


def _may_hold(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _places(h, len(filter_) * 8)
    return ((filter_[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _bits_for(n: int) -> int:
    return max(FILTER_LEAST, 1 << (max(n * FILTER_BITS, 1) - 1).bit_length())


FILTERS = "bucket int, n long, bits binary"


class SeenSet:
    """(url_hash) of all runs; ``key`` may name another column of strings."""

    def __init__(self, spark: SparkSession, path: str, key: str = "url_hash", buckets: int = 64):
        self.spark, self.key = spark, key
        self.keys = KeyedTable(spark, f"{path.rstrip('/')}/keys", key, f"`{key}` string", buckets)
        self.filters = KeyedTable(spark, f"{path.rstrip('/')}/filters", "bucket", FILTERS, max(1, buckets // 16))

    def read(self) -> DataFrame:
        return self.keys.read()

    def _hashed(self, rows: DataFrame) -> DataFrame:
        return rows.select(self.key, self.keys.bucket_of().alias("bucket"), F.xxhash64(self.key, F.lit(7)).alias("h"))

    def probe(self, candidates: DataFrame, version: int | None = None) -> DataFrame:
        """(key, bucket, h, maybe) of the different candidates: whether the
        filter of their bucket holds them."""
        schema = T.StructType([T.StructField(self.key, T.StringType()), *T.StructType.fromDDL(
            "bucket int, h long, maybe boolean").fields])

        def meet(rows: pa.Table, filters: pa.Table) -> pa.Table:
            maybe = np.zeros(rows.num_rows, bool)
            if filters.num_rows and rows.num_rows:
                held = np.frombuffer(filters["bits"][0].as_py(), np.uint8)
                maybe = _may_hold(held, rows["h"].combine_chunks().to_numpy())
            return rows.append_column("maybe", pa.array(maybe))

        rows = self._hashed(candidates.where(F.col(self.key).isNotNull()).select(self.key).distinct())
        filters = self.filters.read(version)
        return rows.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(meet, schema)

    def add(self, version: int, candidates: DataFrame) -> DataFrame:
        """Candidates (key) that no earlier version has, which are seen from
        this version on. The same call again gives the same rows and writes
        nothing."""
        before = version - 1
        probed = materialize(self.probe(candidates, before), "seen-probe")
        doubtful = sorted(r[0] for r in probed.where("maybe").select("bucket").distinct().collect())
        known = self.keys.read(before, doubtful)
        new = materialize(probed.where("NOT maybe").unionByName(
            probed.where("maybe").join(known, self.key, "left_anti")).select(self.key, "bucket", "h"), "seen-new")
        self.keys.append(version, new.select(self.key))
        if version not in self.filters.versions():
            self._refill(version, new)
        return new.select(self.key)

    def _refill(self, version: int, new: DataFrame) -> None:
        added = new.groupBy("bucket").agg(F.count(F.lit(1)).alias("more"))
        held = self.filters.read(version - 1).select("bucket", "n", (F.length("bits") * 8).alias("size"))
        sizes = added.join(held, "bucket", "left").select(
            "bucket", (F.col("more") + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("size", F.lit(0)).alias("size"))
        full = [r.bucket for r in sizes.collect() if r.size < r.n * FILTER_BITS // 2]     # one row per bucket
        whole = self._hashed(self.keys.read(version, full)) if full else None
        rows = new.select("bucket", "h").where(~F.col("bucket").isin(full)) if full else new.select("bucket", "h")
        if whole is not None:
            rows = rows.unionByName(whole.select("bucket", "h"))

        def fill(keys: pa.Table, filters: pa.Table) -> pa.Table:
            if not keys.num_rows:
                return pa.table({"bucket": pa.array([], pa.int32()), "n": pa.array([], pa.int64()), "bits": pa.array([], pa.binary())})
            h, bucket = keys["h"].combine_chunks().to_numpy(), keys["bucket"][0].as_py()
            if bucket in anew or not filters.num_rows:
                n, start = len(h), np.zeros(_bits_for(2 * len(h)) // 8, np.uint8)
            else:
                n = filters["n"][0].as_py() + len(h)
                start = np.frombuffer(filters["bits"][0].as_py(), np.uint8).copy()
            return pa.table({"bucket": pa.array([bucket], pa.int32()), "n": pa.array([n], pa.int64()),
                             "bits": pa.array([_filled(h, start).tobytes()], pa.binary())})

        anew = set(full)
        filled = rows.groupBy("bucket").cogroup(self.filters.read(version - 1).groupBy("bucket")).applyInArrow(fill, FILTERS)
        replace_into(self.filters, version, filled)

"""Readers (SRC1-SRC5)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

TEST_TABLES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One supplied parquet table; Catalyst prunes columns and pushes filters
    into this scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: raw pages kept as parquet (url_hash, url, html)."""
    return spark.read.schema(schemas.RAW_PAGES).parquet(path)


def read_html_files(spark: SparkSession, path: str, urls: DataFrame | None = None) -> DataFrame:
    """SRC1 from loose HTML objects: one file per page, the key is the file
    name, bodies decoded as UTF-8 on the executors. ``urls`` (url_hash, url)
    names the pages; without it their URL is NULL."""
    raw = spark.read.format("binaryFile").load(path)
    pages = raw.select(F.element_at(F.split("path", "/"), -1).alias("url_hash"), F.decode("content", "UTF-8").alias("html"))
    if urls is None:
        return pages.select("url_hash", F.lit(None).cast("string").alias("url"), "html")
    return pages.join(urls.select("url_hash", "url"), "url_hash", "left").select("url_hash", "url", "html")


def read_result_json(spark: SparkSession, path: str, element_schema) -> DataFrame:
    """SRC2: inference result objects, each a JSON array, read with a declared
    schema; output_location is the object's last path segment (F12)."""
    from pyspark.sql import types as T
    raw = spark.read.text(path, wholetext=True).withColumn("_path", F.input_file_name())
    return raw.select(
        F.element_at(F.split("_path", "/"), -1).alias("output_location"),
        F.from_json("value", T.ArrayType(element_schema)).alias("result"))


def parse_result_body(df: DataFrame, element_schema, body_col: str = "body") -> DataFrame:
    """SRC2 on a table of JSON texts: declared-schema ``from_json``."""
    from pyspark.sql import types as T
    return df.withColumn("result", F.from_json(F.col(body_col), T.ArrayType(element_schema)))

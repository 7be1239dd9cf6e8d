"""File readers (SRC1, SRC2) on files written here."""

import json

from newsflow import schemas
from newsflow.sources import tables as S


def test_html_files_and_raw_pages(spark, tmp_path):
    (tmp_path / "html").mkdir()
    for key, body in (("h1", "<title>é</title>"), ("h2", "x")):
        (tmp_path / "html" / key).write_bytes(body.encode())
    urls = spark.createDataFrame([("h1", "http://a/")], "url_hash string, url string")
    got = {tuple(r) for r in S.read_html_files(spark, str(tmp_path / "html"), urls).collect()}
    assert got == {("h1", "http://a/", "<title>é</title>"), ("h2", None, "x")}
    assert {r.url for r in S.read_html_files(spark, str(tmp_path / "html")).collect()} == {None}
    S.read_html_files(spark, str(tmp_path / "html"), urls).write.parquet(str(tmp_path / "raw"))
    assert {tuple(r) for r in S.read_raw_pages(spark, str(tmp_path / "raw")).collect()} == got


def test_result_json(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "x.out").write_text(json.dumps([{"summary_text": "s\nt"}]))
    (tmp_path / "r" / "y.out").write_text("[]")
    element = schemas.SUMMARY_RESULT.elementType if hasattr(schemas.SUMMARY_RESULT, "elementType") else "summary_text string"
    if isinstance(element, str):
        from pyspark.sql import types as T
        element = T.StructType.fromDDL(element)
    got = {r.output_location: [x.summary_text for x in r.result] for r in S.read_result_json(spark, str(tmp_path / "r"), element).collect()}
    assert got == {"x.out": ["s\nt"], "y.out": []}
    body = spark.createDataFrame([("[{\"summary_text\": \"a\"}]",)], "body string")
    assert S.parse_result_body(body, element).first().result[0].summary_text == "a"

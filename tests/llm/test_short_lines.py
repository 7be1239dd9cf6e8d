"""Line dedup on exact copies of lines too short for the edit join."""

import corpus_pipeline as C
from newsflow.llm import line_dedup as L
from newsflow.llm.queries import op1_line_dedup

LONG = "a line that is long enough to be compared"
DOCS = [(1, LONG + "\nLes.\n\nown"), (2, LONG + "\nLes.\n\nown"), (3, LONG + "\n\n   "), (4, "Les.\n\nnew"), (5, "\n\n"), (6, ""),
        (7, None), (8, "Les"), (9, "own\nown"), (None, "new\nlast")]


def test_a_copy_leaves_no_residue(spark):
    stage = dict(C.STAGES)["line dedup"]
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = {r.doc_id: r.text for r in stage(spark, df, "").collect()}
    assert got == {1: DOCS[0][1], 4: "\nnew", 5: "\n\n", 6: "", 7: None, 8: "Les", None: "last"}


def test_short_copies_are_reported(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.removed_lines, r.kept_in) for r in op1_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: ([], []), 2: ([0, 1, 3], [1, 1, 1]), 3: ([0], [1]), 4: ([0], [1]), 5: ([], []), 6: ([], []), 7: ([], []),
                   8: ([], []), 9: ([0, 1], [1, 1]), None: ([0], [4])}

"""The pipeline's stages on a small table, each against a plain version of
its decision over what the stage before it kept."""

import base64

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline as C
from newsflow.llm.queries import VOCAB
from newsflow.session import materialize

from .test_lines_mixing import brute, documents
from .test_simhash_langid import labelled, plain_components, plain_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lang_id string, fp long, topic string"


def test_stages(spark):
    langs = {i: (t, lang) for i, t, lang in labelled(240, 6)}
    rows = [(i + 1000, t, lang, f"s{i % 3}", len(t), "kept", i, "kept") for i, (t, lang) in langs.items()]
    rows += [(i, t, None, None, 0, "kept", 0, "kept") for i, t in documents()[:40]]
    rows += [(5000, None, None, None, None, None, None, None), (5001, "123 ...", "xa", "s0", 1, "kept", 1, "kept")]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = materialize(C.keep_known_languages(spark, docs, ""), "t")
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {5000, 5001} and len([i for i in ids if i >= 1000]) > 230

    lines = materialize(C.drop_repeated_lines(spark, kept, ""), "t")
    _, texts = brute([(r.doc_id, r.text) for r in kept.collect()])
    assert lines.columns == docs.columns and {r.doc_id: r.text for r in lines.collect()} == texts

    single = materialize(C.drop_near_duplicates(spark, lines, ""), "t")
    prints = [(i, plain_fingerprint(t, 4)) for i, t in sorted(texts.items(), key=str)]
    assert single.columns == docs.columns
    assert {r.doc_id for r in single.collect()} == set(plain_components(prints, 4))

    mixed = materialize(C.mix_sources(spark, single, ""), "t")
    all_words = sum(len((r.text or "").split()) for r in single.collect())
    taken = sum(len((r.text or "").split()) for r in mixed.collect())
    assert mixed.columns == docs.columns and mixed.join(single, "doc_id", "left_anti").count() == 0
    assert abs(taken / all_words - C.MIX_SHARE) < 0.12

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(VOCAB), "rb"))}
    public = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = C.encode_bytes(spark, mixed, "").collect()
    source = {r.doc_id: r.text for r in mixed.collect()}
    assert len(coded) == len(source)
    for r in coded:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == public.encode_ordinary(source[r.doc_id] or "")


def test_stages_on_no_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in C.STAGES:
        docs_out = stage(spark, docs, "")
        assert docs_out.collect() == [], name


def test_run_applies_the_stages_in_use(spark, tmp_path):
    """``run`` over a folder equals its stages one after the other, each over
    what the one before it kept."""
    langs = {i: (t, lang) for i, t, lang in labelled(150, 6)}
    rows = [(i + 1000, t, lang, f"s{i % 3}", len(t)) for i, (t, lang) in langs.items()]
    rows += [(i + 5000, t, lang, "copy", len(t)) for i, (t, lang) in list(langs.items())[:10]]
    rows += [(9000, None, None, None, None), (9001, "", "xa", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in C.STAGES:
        now = materialize(stage(spark, now, str(tmp_path)), "t")
        kept.append({r.doc_id for r in now.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(kept, kept[1:])) and len(kept[-1]) > 20
    assert not {i + 5000 for i in range(10)} & kept[1] and not {9000, 9001} & kept[0]
    got = {r.doc_id: (r.n_tokens, bytes(r.ids)) for r in C.run(spark, str(tmp_path)).collect()}
    assert got == {r.doc_id: (r.n_tokens, bytes(r.ids)) for r in now.collect()}

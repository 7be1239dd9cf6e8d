"""Training-data operators on Spark: line and document near-duplicate
detection, language identification, vector search, tokenisation, sharding,
chat formatting, source mixing and exact repeated-passage removal.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""

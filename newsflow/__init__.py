"""newsflow: news-corpus table and stream jobs on Spark DataFrames.

Layout
------
functions/  column expressions (URLs, HTML, tokens, records)
sources/    readers, test-table bindings, sinks (versioned upserts)
operators/  DataFrame-in / DataFrame-out jobs (history, recommend, pages, ...)
plans/      the registered queries and their DuckDB oracle SQL
streaming/  Structured Streaming versions of the jobs
"""

__version__ = "0.1.0"

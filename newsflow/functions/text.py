"""Token expressions for the text jobs (M1-M4, M6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_RE = r"[\p{L}\p{N}_]+"
SENTENCE_SPLIT_RE = r"[.!?\n]+"

# English stop words removed before forming 1- and 2-grams.
STOP_WORDS = [
    "a", "about", "after", "all", "also", "am", "an", "and", "any", "are", "as", "at",
    "be", "because", "been", "before", "being", "between", "both", "but", "by",
    "can", "could", "did", "do", "does", "doing", "down", "during", "each", "few",
    "for", "from", "further", "had", "has", "have", "having", "he", "her", "here",
    "hers", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "itself",
    "just", "me", "more", "most", "my", "no", "nor", "not", "now", "of", "off", "on",
    "once", "only", "or", "other", "our", "ours", "out", "over", "own", "same", "she",
    "should", "so", "some", "such", "than", "that", "the", "their", "theirs", "them",
    "then", "there", "these", "they", "this", "those", "through", "to", "too", "under",
    "until", "up", "very", "was", "we", "were", "what", "when", "where", "which",
    "while", "who", "whom", "why", "will", "with", "would", "you", "your", "yours",
]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c) -> Column:
    """Lower-cased Unicode word tokens, in order."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(TOKEN_RE), 0)


def content_tokens(c, stop_words=None) -> Column:
    """Tokens without stop words; the membership test plans as a hash-set
    lookup (InSet), not a scan of the word list."""
    stop = list(STOP_WORDS if stop_words is None else stop_words)
    return F.filter(tokens(c), lambda t: ~t.isin(stop))


def ngrams_1_2(toks) -> Column:
    """1-grams followed by adjacent 2-grams of a token array (linear: the
    array is zipped with itself shifted by one). Pass a column, not a
    tokenising expression, so the tokens are computed once."""
    t = _c(toks)
    pairs = F.arrays_zip(t.alias("a"), F.slice(t, 2, F.greatest(F.size(t), F.lit(1))).alias("b"))
    pairs = F.filter(pairs, lambda p: p["b"].isNotNull())
    return F.concat(t, F.transform(pairs, lambda p: F.concat(p["a"], F.lit(" "), p["b"])))


def sentences(c) -> Column:
    """Trimmed, non-empty sentences in order."""
    parts = F.transform(F.split(_c(c), SENTENCE_SPLIT_RE), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


"""Line dedup: exact and near-duplicate lines by a segment-partition edit join.

A line is a near duplicate of another when their edit distance (code points)
is at most ``allowed(length of the shorter)``: one edit per ``EDIT_CHARS``
characters (5 %) at every length, and on short lines one per ten characters
up to two. Lines under ``MIN_CHARS`` characters have no near duplicates; with
``every_line`` their exact copies go too (blank lines separate and are never
copies), without it they are left alone. Lines
in the same class (connected by links, copies included) are reduced to the
first occurrence by (document id, line number).

* Segments: a line of length l < ``LONG`` is cut into allowed(l) + 1 even
  segments. That many edits cannot touch every segment, so a line within the
  distance contains one of them unchanged, near the same place.
* Probes: every line looks for indexed lines under ``LONG`` of its own length
  and of up to allowed(LONG - 1) less, with the substrings that can be that
  segment: of the segment's length, and within the shift that the edits before
  and after it leave (the multi-match-aware windows).
* Longer lines (t edits) are cut into t + 1 even segments too, of ``GRAM +
  WINDOW - 1`` characters or more. A segment is filed under the gram of least
  hash in its first window, a line is looked up under the grams of least hash
  in all its windows: an unchanged segment names the same gram in both. Keys
  name the gram, a class of lengths and a stretch of places; a pair goes on
  where its lengths and places fit the edits that a segment leaves before and
  after itself (the multi-match-aware windows), and where the characters that
  follow are nearly the same ones: of the segments that t edits leave unchanged
  one is such that it and the next l - 1 hold at most l - 1 edits for every l
  (the last one before which there are as many edits as segments). A row
  carries the counts of the characters in ``NEXT`` segments from its gram on,
  modulo 4, in Gray code: an edit changes two bits at most.
* Filters: a first pass gathers the filed keys in a Bloom filter (and those
  filed more than once in another), a second one gives out the rows that are
  looked up under keys that another line may have filed, a third one the
  filed rows that were looked up or filed twice. A filter of the places where
  lines come first keeps copies out. Filters have a fixed bound: where it would
  leave less than ``PASS_BITS`` bits for a filed key, the keys are handled in
  passes, a share of the grams of longer lines and of the lengths and segments
  of the others in each, and the rows of a pass go when its pairs are written.
* Verification: lines that meet under a key are compared by a banded
  bit-parallel edit distance, after their common ends are taken off. Longer
  lines first give the pairs whose lengths and places fit; a pair is given
  its texts once.

In Spark: keys travel to the filters packed, in slices of the key space; rows
are three longs (key, line, place), written once; then the filters go. The
lower half of a longer line's key is its character counts there: keys are told
apart by the upper half, which lets more rows pass and loses none. Keys with more than about
``GROUP`` lines are dealt over blocks, every two blocks meeting in one task, so
no task holds a whole hot group; for lines under ``LONG`` tasks give out
verified links only, never candidate pairs. The set of lines that meet is
broadcast while it has at most ``BROADCAST_ROWS`` rows and joined by shuffle
beyond that.

Defined results: a NULL text has no lines; an empty text has one empty line;
lines are separated by line feeds only; a document all of whose lines go (with
``every_line``: one that loses lines and has only blank ones left) is dropped
by ``dedup_lines``; NULL ids come last in the order; documents with
one id are ordered by a hash of their text, and rows repeated as a whole are
cut alike; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize
from . import bloom
from .common import fresh, key_runs, worker_cache
from .components import components

MAX_EDITS = 2                # of one per MIN_CHARS characters
MIN_CHARS = 10
EDIT_CHARS = 20              # one edit per so many characters, without a bound
LONG = 80                    # lines whose segments are filed by a gram of theirs
GRAM, WINDOW = 13, 4         # a window of 16 characters is in every segment
NEXT = 3                     # segments whose characters are counted from a gram on
FILTER_BLOCKS = 1 << 23      # 64 MB a filter
FILTER_BITS = 16             # per filed key, while the bound allows
PASS_BITS = 8                # at least; else there are more passes
CLASSES = 1.3                # ratio of the lengths of a class, over 1 + 1 / EDIT_CHARS
STRETCH = 8                  # a stretch of places is so many times the edits of its class
CHUNK = 1 << 16              # characters or pairs worked on at once
GROUP = 1000                 # lines of a key compared in one task
BROADCAST_ROWS = 4_000_000   # longs: 32 MB
HOT_KEYS = 1_000_000         # keys with more than GROUP lines, broadcast up to here
ROWS_OUT = 1 << 18           # rows of an output batch


def allowed(length: int) -> int:
    return max(min(MAX_EDITS, length // MIN_CHARS), length // EDIT_CHARS)


def segments(length: int) -> list[tuple[int, int]]:
    """(start, size) of the even segments of an indexed line."""
    parts = allowed(length) + 1
    size, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = size + (i >= parts - longer)
        out.append((at, n))
        at += n
    return out


_PLANS: dict[tuple, list[tuple[int, int, int, int]]] = {}
WHOLE = 0, 1                 # the first of one pass


def probes(length: int, share: tuple[int, int] = WHOLE) -> list[tuple[int, int, int, int]]:
    """(seed, start, size, indexed) of all substrings a line is filed or
    looked up under. The seed names indexed length and segment; a probe for
    its own length at a segment's own place is the filed entry itself. A pass
    has a share of the seeds."""
    if (length, share) in _PLANS:
        return _PLANS[length, share]
    out = []
    for less in range(allowed(LONG - 1) + 1):
        other = length - less
        if not MIN_CHARS <= other < LONG or less > allowed(other):
            continue
        edits = allowed(other)
        for i, (p, n) in enumerate(segments(other)):
            lo = max(p - i, p + less - (edits - i), 0)
            hi = min(p + i, p + less + (edits - i), length - n)
            if ((other * 8 + i) * _ODD % (1 << 64) >> 32) % share[1] == share[0]:
                out += [(other * 8 + i, at, n, int(less == 0 and at == p)) for at in range(lo, hi + 1)]
    if len(_PLANS) < 100_000:
        _PLANS[length, share] = out
    return out


# least lengths of the classes of long lines, up to what a string can hold
_EDGES = np.unique((LONG * CLASSES ** np.arange(72)).astype(np.int64))
_SHIFTS = np.array([allowed(int(n) - 1) for n in _EDGES[1:]])   # most edits in a class


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_ODD, n, 1 << 64))


def _gram_hashes(points: np.ndarray) -> np.ndarray:
    """Hashes of all runs of 13 code points, from those of 2, 4 and 8."""
    two = points[:-1] * _power(1) + points[1:]
    four = two[:-2] * _power(2) + two[2:]
    eight = four[:-4] * _power(4) + four[4:]
    grams = eight[:-5] * _power(5) + (four[8:-1] * _power(1) + points[12:])
    return (grams ^ (grams >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)


def _least_grams(grams: np.ndarray) -> np.ndarray:
    """Place of the first least gram of every window of 4: the lowest bits
    carry how far it is from the window's start."""
    least = grams & ~np.uint64(3)
    least = np.minimum(least[:-1], least[1:] + np.uint64(1))
    least = np.minimum(least[:-2], least[2:] + np.uint64(2))
    return (least & np.uint64(3)).astype(np.int64) + np.arange(len(least))


def _segment_starts(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, start) of all segments of long lines of these sizes."""
    parts = size // EDIT_CHARS + 1
    line = np.repeat(np.arange(len(size)), parts)
    i = np.arange(len(line)) - np.repeat(np.cumsum(parts) - parts, parts)
    length, longer = size // parts, size % parts
    return line, i * length[line] + np.maximum(i - (parts - longer)[line], 0)


def _segment_of(size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of the segment that holds a place of a long line."""
    parts = size // EDIT_CHARS + 1
    length, even = size // parts, parts - size % parts
    return np.where(at < even * length, at // length, even + (at - even * length) // (length + 1))


def _share(share: tuple[int, int], grams: np.ndarray) -> np.ndarray | slice:
    """Which of the hashed grams are in a pass."""
    return slice(None) if share == WHOLE else (grams >> np.uint64(32)) % np.uint64(share[1]) == np.uint64(share[0])


def anchors(lines: list[str], filed_only: bool = False, share: tuple[int, int] = WHOLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, place, hash, filed) of the grams that are the least of a
    window; filed tells those of the windows that begin a segment. A pass has
    a share of the grams."""
    size = np.array([len(x) for x in lines], np.int64)
    ends = np.cumsum(size)
    points = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4").astype(np.uint64)
    grams = _gram_hashes(points)
    least = _least_grams(grams)
    line, start = _segment_starts(size)
    filed = least[start + (ends - size)[line]]
    if filed_only:
        gram = _mix(grams[filed])
        mine = _share(share, gram)
        line = line[mine]
        return line, filed[mine] - (ends - size)[line], gram[mine], np.ones(len(line), bool)
    inside = np.ones(len(least), bool)      # windows of one line
    for j in range(1, GRAM + WINDOW - 1):
        inside[(ends - j)[ends - j < len(least)]] = False
    at = least[inside]
    at = at[np.r_[True, at[1:] != at[:-1]]]
    of_segment = np.zeros(len(points), bool)
    of_segment[filed] = True
    gram = _mix(grams[at])
    mine = _share(share, gram)
    at, gram = at[mine], gram[mine]
    line = np.repeat(np.arange(len(lines)), size)[at]
    return line, at - (ends - size)[line], gram, of_segment[at]


def anchor_keys(lines: list[str], filed_only: bool = False, share: tuple[int, int] = WHOLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, place, key, filed) of all keys long lines are filed or looked
    up under in a pass."""
    line, at, gram, first = anchors(lines, filed_only, share)
    size = np.array([len(x) for x in lines], np.int64)
    least = np.maximum(-(-size * EDIT_CHARS // (EDIT_CHARS + 1)), LONG)      # of a line within the distance
    own = np.searchsorted(_EDGES, size, side="right") - 1
    below = np.searchsorted(_EDGES, least, side="right") - 1
    out = []

    def keys(kinds, n, place, h, filed):
        shift = _SHIFTS[kinds][n]
        width = STRETCH * shift
        here = place // width
        low, high = np.maximum(place - shift, 0) // width, (place + shift) // width
        salt = kinds.astype(np.uint64)[n] * _power(3) + h
        every = slice(None)
        for stretch, some in ((here, every), (low, np.flatnonzero(low < here)), (high, np.flatnonzero(high > here))):
            key = salt[some] + stretch[some].astype(np.uint64) * _power(5)
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            out.append((n[some], place[some], key ^ (key >> np.uint64(32)), filed[some] & (stretch is here)))
            if filed_only:
                break
    keys(own, line, at, gram, first)
    if not filed_only:
        some = np.flatnonzero((below < own)[line])
        keys(below, line[some], at[some], gram[some], np.zeros(len(some), bool))
    return tuple(np.concatenate(x) for x in zip(*out))


# frequent characters in different lanes, others by their number
_LANES = np.arange(256) % 16
_LANES[[ord(c) for c in " etaoinsrhldcumgpfbywvk.,"]] = [*range(16), *range(15, 6, -1)]
_COUNTED = NEXT * (GRAM + WINDOW - 1) - (WINDOW - 1)     # a gram begins up to 3 characters into its segment
_UPPER = np.uint64(0xFFFFFFFF << 32)


def followers(lines: list[str], line: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The characters from a place of a line on: 16 counts modulo 4 in Gray
    code, in 32 bits."""
    size = np.array([len(x) for x in lines], np.int64)
    ends = np.cumsum(size)
    lane = _LANES[np.frombuffer("".join(lines).encode("utf-32-le"), "<u4") % 256]
    one = np.uint64(1) << (lane % 8 * 8).astype(np.uint64)
    start = (ends - size)[line] + at
    stop = np.minimum(start + _COUNTED, ends[line])
    out = np.zeros(len(line), np.uint64)
    for half in (0, 1):         # eight counts of a byte each: none is over 255
        upto = np.r_[np.uint64(0), np.cumsum(np.where(lane // 8 == half, one, np.uint64(0)))]
        n = upto[stop] - upto[start]
        n = (n ^ (n >> np.uint64(1) & np.uint64(0x0101010101010101))) & np.uint64(0x0303030303030303)
        for shift, mask in ((6, 0x000F000F000F000F), (12, 0x000000FF000000FF), (24, 0xFFFF)):
            n = (n | n >> np.uint64(shift)) & np.uint64(mask)
        out |= n << np.uint64(16 * half)
    return out


def _grouped(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """What is left of keys in the rows, for a filter: the upper half of those
    of longer lines."""
    return np.where(places == 0, keys, _mix(keys & _UPPER))


def edit_distance(a: str, b: str, most: int) -> int:
    """Edit distance, or most + 1 if it is larger: bit-parallel over a band
    of 2 * most + 1 rows that moves down the diagonal."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    n, lo = len(b), 0
    while lo < n and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < n - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[lo:len(a) - end], b[lo:n - end]
    if not b:
        return len(a)
    if len(a) <= most:
        return _full_distance(a, b)
    # bit i of the words is row column + i - most; positive and negative vertical steps
    width = 2 * most + 1
    every = (1 << width) - 1
    up, down = every & ~((1 << most) - 1), 0
    distance, last = most, 1 << (width - 1)
    column, turn = 0, len(a) - most
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    for column in range(len(b)):
        same, first = places.get(b[column], 0), column - most
        same = (same >> first if first >= 0 else same << -first) & every
        diagonal = ((((same & up) + up) ^ up) | same | down) & every
        plus = (down | ~(diagonal | up)) & every
        minus = diagonal & up
        if column < turn:       # down the band's lowest diagonal, where the distance never falls
            distance += not diagonal & last
            if distance > 2 * most:
                return most + 1
        else:                   # then along the last row
            last >>= 1
            distance += bool(plus & last) - bool(minus & last)
        up = (minus | ~((diagonal >> 1) | plus)) & every
        down = (diagonal >> 1) & plus
    return min(distance, most + 1)


def _full_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


# ------------------------------------------------------------------ key rows
def _entries(batches: Iterator[pa.RecordBatch], firsts, share: tuple[int, int], filed_only: bool = False,
             counted: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, line, place, next) for the lines of (texts, hashes of their places)
    whose places may be first ones; the lowest bit of line tells whether the
    entry is a filed one. place and next are 0 for lines under
    ``LONG``; for others place holds the place and, in the lower half, the line's
    length, and next the ``followers``, which are not made without ``counted``.
    All entries of a line in a pass come together."""
    digest = xxhash.xxh64_intdigest

    def given(keys, lines, numbers, texts):
        none = np.zeros(len(keys), np.uint64)
        out = [(np.array(keys, np.uint64), np.array(lines, np.uint64), none, none)]
        if texts:
            line, at, key, filed = anchor_keys(texts, filed_only, share)
            size = np.array([len(x) for x in texts], np.uint64)[line]
            next_ = followers(texts, line, at) if counted else np.zeros(len(key), np.uint64)
            out.append((key, np.array(numbers, np.uint64)[line] | filed.astype(np.uint64), at.astype(np.uint64) << np.uint64(32) | size, next_))
        return tuple(np.concatenate(x) for x in zip(*out))

    worker_cache("lines")
    for batch in batches:
        seen, keys, lines = set(), [], []
        numbers, texts, held = [], [], 0
        places = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        wanted = iter((bloom.contains(firsts.value, places) if firsts else np.ones(len(places), bool)).tolist())
        for text in batch.column(0):
            for line in text.as_py().split("\n"):
                if not next(wanted) or len(line) < MIN_CHARS:
                    continue
                number = digest(line, 42) & ~1
                if number in seen:
                    continue
                seen.add(number)
                for seed, at, n, indexed in probes(len(line), share):
                    if indexed or not filed_only:
                        keys.append(digest(line[at:at + n], seed))
                        lines.append(number | indexed)
                if len(line) >= LONG:
                    numbers.append(number)
                    texts.append(line)
                    held += len(line)
                if held >= CHUNK or len(keys) >= CHUNK:
                    yield given(keys, lines, numbers, texts)
                    keys, lines, numbers, texts, held = [], [], [], [], 0
        if keys or texts:
            yield given(keys, lines, numbers, texts)


def _asked(keys: np.ndarray, lines: np.ndarray, once: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Entries that are looked up under a key that another line may have filed."""
    filed = np.flatnonzero(lines & np.uint64(1))
    asked = np.flatnonzero(bloom.contains(once, keys) & (lines & np.uint64(1) == 0))
    pair = lambda rows: keys[rows] * _power(7) + (lines[rows] & ~np.uint64(1))
    own = np.isin(pair(asked), pair(filed)) & ~bloom.contains(twice, keys[asked])
    return asked[~own]


def _filed_keys(firsts, share):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from bloom.packed(keys for keys, *_ in _entries(batches, firsts, share, filed_only=True, counted=False))
    return run


def _given(keys: np.ndarray, lines: np.ndarray, places: np.ndarray, next_: np.ndarray) -> Iterator[pa.RecordBatch]:
    columns = np.where(places == 0, keys, keys & _UPPER | next_), lines, places
    for lo in range(0, len(columns[0]), ROWS_OUT):
        yield pa.RecordBatch.from_arrays([pa.array(x[lo:lo + ROWS_OUT].view(np.int64)) for x in columns], names=["key", "line", "place"])


def _asked_rows(firsts, share, once, twice):
    """Rows that are looked up under keys that another line may have filed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entries in _entries(batches, firsts, share):
            asked = _asked(*entries[:2], once.value, twice.value)
            yield from _given(*(x[asked] for x in entries))
    return run


def _filed_rows(firsts, share, twice, answered):
    """Filed rows with a key that was filed twice or looked up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entries in _entries(batches, firsts, share, filed_only=True):
            met = bloom.contains(twice.value, entries[0]) | bloom.contains(answered.value, _grouped(entries[0], entries[2]))
            yield from _given(*(x[met] for x in entries))
    return run


def _packed_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from bloom.packed(_grouped(*(b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))) for b in batches)


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a table of longs that was counted; beyond ``most``
    rows the join shuffles."""
    return F.broadcast(df) if df.count() <= most else df


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the lines of a (key, blocks) run: rows (key, side,
    indexed, line, text), where side says in which of the run's two blocks a
    line is (0 and 1: compared across only; 2: compared with all)."""
    for batch in key_runs(batches):
        key, side, indexed, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        texts, found = batch.column(4).to_pylist(), set()
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]).tolist()
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            rows = sorted({(len(texts[i]), int(number[i]), int(side[i]), texts[i]) for i in range(lo, hi)})
            filed = {(int(number[i]), texts[i]) for i in range(lo, hi) if indexed[i]}
            for x, (n, a, s, text) in enumerate(rows):
                if (a, text) not in filed:
                    continue
                y = x
                while y > 0 and rows[y - 1][0] == n:
                    y -= 1                      # an equally long line need not be indexed
                most = allowed(n)
                for m, b, other, longer in rows[y:]:
                    if m - n > most:
                        break
                    if text != longer and (s != other or s == 2) and edit_distance(longer, text, most) <= most:
                        found.add((min((a, text), (b, longer)), max((a, text), (b, longer))))
        if found:
            pairs = [(xxhash.xxh64_intdigest(p[1], 42), xxhash.xxh64_intdigest(q[1], 42)) for p, q in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(c, np.uint64).view(np.int64)) for c in zip(*pairs)], names=["a", "b"])


def _near_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of long lines of a (key, blocks) run whose lengths and places
    and followers are within the distance: rows (key, line, place, next), with
    the side in the free bits of place: 31 (side 1) and 63 (side 2)."""
    for batch in key_runs(batches):
        key, number, place, next_ = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        side = np.where(place < 0, 2, place >> 31 & 1)
        size, at = place & 0x7FFFFFFF, place >> 32 & 0x7FFFFFFF
        indexed, number = (number & 1).astype(bool), number & ~1
        order = np.lexsort((size, key))
        key, side, indexed, number, size, at, next_ = (x[order] for x in (key, side, indexed, number, size, at, next_))
        run = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        most = size // EDIT_CHARS
        by = run << 32 | size
        first, top = np.searchsorted(by, by), np.searchsorted(by, by + most, side="right")
        x = np.flatnonzero(indexed & (top - first > 1))
        found, total = [], np.cumsum((top - first)[x])
        while len(x):
            n = max(1, int(np.searchsorted(total, CHUNK, side="right")))
            now, x, total = x[:n], x[n:], total[n:] - total[n - 1]
            width = (top - first)[now]
            i = np.repeat(now, width)
            j = np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width) + first[i]
            shift, before = at[j] - at[i], _segment_of(size[i], at[i])      # and the edits that may be before and after
            fine = (np.abs(shift) <= before) & (np.abs(size[j] - size[i] - shift) <= most[i] - before)
            fine &= (number[i] != number[j]) & ((side[i] != side[j]) | (side[i] == 2))
            fine &= np.bitwise_count(next_[i] ^ next_[j]) <= 2 * (NEXT - 1)
            i, j = i[fine], j[fine]
            found.append(np.unique(np.stack([np.minimum(number[i], number[j]), np.maximum(number[i], number[j])]), axis=1))
        if found:
            pairs = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def _trigrams(text: str) -> set[str]:
    return {text[i:i + 3] for i in range(len(text) - 2)}


def _verify_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among pairs of long lines: rows (a, b, text, other). An edit
    takes away at most three trigrams of the shorter line."""
    for batch in batches:
        grams, found = {}, []
        for a, b, text, other in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if len(text) > len(other):
                a, b, text, other = b, a, other, text
            most = allowed(len(text))
            for t in (text, other):
                if t not in grams:
                    grams[t] = _trigrams(t)
            if len(grams[text] - grams[other]) <= 3 * most and edit_distance(other, text, most) <= most:
                found.append((min((a, text), (b, other))[1], max((a, text), (b, other))[1]))
        if found:
            pairs = [(xxhash.xxh64_intdigest(p, 42), xxhash.xxh64_intdigest(q, 42)) for p, q in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(c, np.uint64).view(np.int64)) for c in zip(*pairs)], names=["a", "b"])


def _line_number() -> Column:
    return F.col("line").bitwiseAND(F.lit(-2).cast("long"))


def _dealt(rows: DataFrame, hits: DataFrame, *columns: Column) -> DataFrame:
    """(key, columns): a key's lines in blocks; every two blocks, and every
    block with itself, meet once. The columns may tell a row's side."""
    every = max(1, GROUP // 32)     # of the lines one in so many is counted
    many = (hits.where(F.pmod(F.xxhash64(_line_number(), F.lit(6)), F.lit(every)) == 0).groupBy("key")
            .agg((F.count(F.lit(1)) * every).alias("n")).where(F.col("n") > GROUP))
    # the rows are shuffled once, by the keys below
    rows = rows.join(bounded(materialize(many, "hot-keys"), HOT_KEYS), "key", "left")
    blocks = F.coalesce(F.ceil(F.col("n") / GROUP), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(_line_number(), F.lit(5)), blocks).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("int")
    rows = rows.withColumn("side", side).select(
        F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", low, high)).alias("key"), *columns)
    return rows.repartition("key").sortWithinPartitions("key")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(place, line) of every occurrence; place orders them."""
    rows = docs.select(F.col(id_col).isNull().alias("_no_id"), F.col(id_col).alias("_id"),
                       F.xxhash64(text_col).alias("_text"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("_at", "line"))
    return rows.select(F.struct("_no_id", "_id", "_text", "_at").alias("place"), "line")


def links(docs: DataFrame, text_col: str = "text", id_col: str | None = None, firsts: DataFrame | None = None) -> DataFrame:
    """(a, b): all links between different lines, as their XXH64 values.
    ``firsts`` (h) may name the first places of all lines (hashes of a hash of
    id and text, and the line's number): lines are then read there alone."""
    doc = F.xxhash64(id_col, F.xxhash64(text_col)) if id_col else F.xxhash64(text_col)
    numbered = F.sequence(F.lit(0), F.size(F.split(F.col(text_col), "\n", -1)) - 1)
    rows = docs.where(F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.transform(numbered, lambda at: F.xxhash64(doc, at)).alias("places"))
    share = docs.sparkSession.sparkContext.broadcast
    if firsts is not None:
        firsts = share(bloom.fill(firsts.select(F.lit(0).alias("shard"), "h"), bloom.sizes({0: firsts.count()}))[0])
    keys = (docs.agg(F.sum(F.length(text_col))).first()[0] or 0) // EDIT_CHARS
    passes = max(1, -(-keys * PASS_BITS // (64 * FILTER_BLOCKS)))
    blocks = bloom.sliced(keys // passes, FILTER_BLOCKS, FILTER_BITS)
    met, near = [], []
    for at in range(passes):
        hits = _hits(rows, firsts, (at, passes), blocks)
        met.append(materialize(_long_pairs(hits).distinct(), "long-pairs"))
        near.append(_near_links(docs, text_col, hits))
        if passes > 1:      # only what was found is left of a pass
            near[-1] = materialize(near[-1], "near-links")
            discard(hits)
    if firsts:
        firsts.destroy()
    pairs = reduce(DataFrame.unionByName, met)
    if passes > 1:
        pairs = materialize(pairs.distinct(), "long-pairs")
        for table in met:
            discard(table)
    texts = _texts(docs, text_col, pairs.select(F.explode(F.array("a", "b")).alias("number")))
    far = (pairs.join(texts.select(F.col("number").alias("a"), "text"), "a")
           .join(texts.select(F.col("number").alias("b"), F.col("text").alias("other")), "b")
           .select("a", "b", "text", "other").mapInArrow(_verify_pairs, "a long, b long"))
    return reduce(DataFrame.unionByName, near).unionByName(far).distinct()


def _hits(rows: DataFrame, firsts, share: tuple[int, int], blocks: int) -> DataFrame:
    """The rows (key, line, place) of a pass that may meet another one."""
    context = rows.sparkSession.sparkContext
    once, twice = (context.broadcast(bloom.folded(x)) for x in bloom.gather(rows.mapInArrow(_filed_keys(firsts, share), bloom.PACKED), blocks))
    asked = materialize(rows.mapInArrow(_asked_rows(firsts, share, once, twice), "key long, line long, place long"), "asked-rows")
    once.destroy()      # a worker holds what its pass needs
    answered = context.broadcast(bloom.folded(bloom.gather(asked.select("key", "place").mapInArrow(_packed_keys, bloom.PACKED), blocks)[0]))
    filed = materialize(rows.mapInArrow(_filed_rows(firsts, share, twice, answered), "key long, line long, place long"), "filed-rows")
    for shared in (twice, answered):
        shared.destroy()        # the rows are written
    return asked.unionByName(filed)


def _long_pairs(hits: DataFrame) -> DataFrame:
    """(a, b): longer lines that meet near the same place."""
    half = F.lit(0xFFFFFFFF).cast("long")
    long_ = hits.where("place <> 0").select(F.col("key").bitwiseAND(F.bitwise_not(half)).alias("key"), "line", "place",
                                            F.col("key").bitwiseAND(half).alias("next"))
    sided = (F.when(F.col("side") == 2, F.lit(-1 << 63).cast("long")).otherwise(F.col("side").cast("long") * (1 << 31))
             .bitwiseOR(F.col("place")).alias("place"))
    return _dealt(long_, long_, F.col("line"), sided, F.col("next")).mapInArrow(_near_places, "a long, b long")


def _near_links(docs: DataFrame, text_col: str, hits: DataFrame) -> DataFrame:
    """(a, b): links between lines under ``LONG``, looked up or filed there."""
    short = hits.where("place = 0").select("key", F.col("line").bitwiseAND(F.lit(1).cast("long")).alias("indexed"), "line", _line_number().alias("number"))
    texts = _texts(docs, text_col, short.select("number"))
    return _dealt(short.join(texts, "number"), short, *map(F.col, ("side", "indexed", "number", "text"))).mapInArrow(_verify, "a long, b long")


def _texts(docs: DataFrame, text_col: str, numbers: DataFrame) -> DataFrame:
    """(number, text) of the lines with these numbers."""
    numbers = materialize(numbers.distinct(), "hit-lines")
    return materialize(docs.select(F.explode(F.split(F.col(text_col), "\n", -1)).alias("text"))
                       .where(F.length("text") >= MIN_CHARS)
                       .select(F.xxhash64("text").bitwiseAND(F.lit(-2).cast("long")).alias("number"), "text")
                       .join(bounded(numbers), "number", "left_semi").distinct(), "hit-texts")


def _written(line: Column) -> Column:
    """Not blank."""
    return line.rlike(r"(?U)\S")


def _cut(docs: DataFrame, id_col: str, text_col: str, every_line: bool) -> DataFrame:
    """(place, kept, degree, removed) for every occurrence of a line that has
    copies or links: kept is the place of the occurrence that stays."""
    counted = F.length("line") >= MIN_CHARS
    lines = _lines(docs, id_col, text_col).where(counted | _written(F.col("line")) if every_line else counted).select(
        "place", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))
    classes = materialize(lines.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    firsts = classes.select(F.xxhash64(F.xxhash64("first._id", "first._text"), "first._at").alias("h"))
    pairs = materialize(links(docs, text_col, id_col, firsts), "line-links")
    roots = components(pairs)
    degrees = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    linked = materialize(classes.join(roots.join(degrees, "node").withColumnRenamed("node", "h1"), "h1"), "linked")
    kept = linked.groupBy("root").agg(F.min("first").alias("kept"))
    several = (classes.where("n > 1").join(linked.select("h1", "h2"), ["h1", "h2"], "left_anti")
               .select("h1", "h2", F.col("first").alias("kept"), F.lit(0).cast("long").alias("degree"))
               .unionByName(linked.join(kept, "root").select("h1", "h2", "kept", "degree")))
    return lines.join(several, ["h1", "h2"]).select("place", "kept", "degree", (F.col("place") != F.col("kept")).alias("removed"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every_line: bool = False) -> DataFrame:
    """(id, n_lines, n_removed, n_links, removed_lines, kept_in) per document:
    the numbers of the removed lines (from 0) in order, the ids of the
    documents in which their kept lines are, and the number of links of the
    document's lines to different lines."""
    cut = _cut(docs, id_col, text_col, every_line)
    by_doc = cut.groupBy("place._no_id", "place._id", "place._text").agg(
        F.sum("degree").alias("n_links"),
        F.array_sort(F.collect_set(F.when(F.col("removed"), F.struct(F.col("place._at").alias("at"), F.col("kept._id").alias("in"))))).alias("cuts"))
    base = docs.select(F.col(id_col), F.xxhash64(text_col).alias("_text"),
                       F.coalesce(F.size(F.split(F.col(text_col), "\n", -1)), F.lit(0)).alias("n_lines"))
    base = base.withColumn("n_lines", F.greatest("n_lines", F.lit(0)))  # size of NULL is -1 in some settings
    same = base[id_col].eqNullSafe(by_doc["_id"]) & (base["_text"] == by_doc["_text"])
    cuts = F.coalesce(F.col("cuts"), F.array().cast(by_doc.schema["cuts"].dataType))
    return (base.join(by_doc.drop("_no_id"), same, "left")
            .select(base[id_col], "n_lines", F.size(cuts).alias("n_removed"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    F.transform(cuts, lambda c: c["at"]).alias("removed_lines"), F.transform(cuts, lambda c: c["in"]).alias("kept_in")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every_line: bool = False) -> DataFrame:
    """``docs`` without the removed lines; documents that lose every line go."""
    cut = _cut(docs, id_col, text_col, every_line).where("removed")
    key_id, key_text, gone, lines = fresh(docs, "_id", "_text", "gone", "lines")
    by_doc = cut.groupBy(F.col("place._id").alias(key_id), F.col("place._text").alias(key_text)).agg(
        F.collect_set("place._at").alias(gone))
    same = docs[id_col].eqNullSafe(by_doc[key_id]) & (F.xxhash64(docs[text_col]) == by_doc[key_text])
    joined = docs.join(by_doc, same, "left").withColumn(lines, F.split(F.col(text_col), "\n", -1))
    left = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)))
    rest = F.transform(left, lambda i: F.col(lines)[i])
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(rest, "\n"))
    some = F.exists(rest, _written) if every_line else F.size(gone) < F.size(lines)
    kept = joined.where(F.col(gone).isNull() | some)
    return kept.withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in docs.columns])

"""Runs of repeated words, found with an enhanced suffix array.

A run is a stretch of words whose smallest period is q (words q apart are equal), at least twice
as long as q, that neither neighbouring word extends. Every run ends in one branching square: two
equal halves at i and i + q whose continuations differ. In the suffix array such a pair lies in
one LCP interval of depth q, in two of its child intervals. So for each LCP interval every suffix
i outside the largest child looks up ISA[i + q] and ISA[i - q]: a rank inside the interval and
outside the suffix's own child is a branching square (the smaller-children rule bounds the look-ups
by n log n). Squares are then rotated to the left as far as the words stay equal, and squares of
one end and start are merged under the smallest period. Intervals are pairs of bounds from the
nearest smaller LCP values; no tree is built.

Texts are worked on where they lie, with no shuffle; a worker joins the texts of a batch into
pieces of about `PIECE` words, and words of different texts never compare as equal. A longer text
is a piece of its own: memory is in proportion to the longest text times the logarithm of its
longest repeat.

Cases: a null, empty or blank text has no words and no runs, and collapses to ''; repeated rows
give equal results; very long texts are worked on whole; an empty table gives an empty table; other
columns pass through, and an output column replaces one of its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from gridwake.llm.words import let, split_words, upto

PIECE = 1 << 18
RUN = [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]
FOUND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct(RUN))), ("collapsed", pa.string())])


def _groups(fresh: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """For each slot the first slot of its group."""
    return np.maximum.accumulate(np.where(fresh, slots, 0))


def _differs(x: np.ndarray) -> np.ndarray:
    return np.concatenate(([True], x[1:] != x[:-1]))


def suffix_ranks(words: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by doubling, and the ranks by the first 1, 2, 4, … words.

    `words` are equal only within a text; `room` is the number of words from a position to its text's end.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    slots, fresh = np.arange(n), _differs(words[order])
    rank = np.empty(n, np.int64)
    rank[order] = _groups(fresh, slots)
    ranks, step = [rank], 1
    while True:
        slots = slots[~(fresh & np.append(fresh[1:], True))]  # only groups of two or more are sorted again
        if not len(slots):
            return order, ranks
        at = order[slots]
        rest = np.where(room[at] > step, rank[np.minimum(at + step, n - 1)] + 1, 0)
        both = rank[at] * (n + 1) + rest
        by = np.argsort(both, kind="stable")
        at, both = at[by], both[by]
        order[slots] = at
        fresh = _differs(both)
        rank = rank.copy()
        rank[at] = _groups(fresh, slots)
        ranks.append(rank)
        step *= 2


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray], room: np.ndarray) -> np.ndarray:
    """Words that each suffix shares with the one before it in the array."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    slots = np.flatnonzero(~_differs(ranks[0][order]))
    a, b, shared = order[slots - 1], order[slots], np.zeros(len(slots), np.int64)
    limit = np.minimum(room[a], room[b])
    for level in range(len(ranks) - 1, -1, -1):
        rank, inside = ranks[level], shared < limit
        same = inside & (rank[np.where(inside, a + shared, 0)] == rank[np.where(inside, b + shared, 0)])
        shared[same] += 1 << level
    lcp[slots] = shared
    return lcp


def interval_bounds(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First slot and end of the LCP interval that each positive LCP value parts, by nearest smaller values."""
    values = lcp.tolist()
    n = len(values)
    left, right = [0] * n, [n] * n
    stack: list[int] = []
    last = 0  # slot of the last zero
    for r, depth in enumerate(values):
        while stack and values[stack[-1]] > depth:
            right[stack.pop()] = r
        if not depth:
            for s in stack:
                right[s] = r
            stack.clear()
            last = r
            continue
        if not stack:
            left[r] = last
        else:
            top = stack[-1]
            left[r] = left[top] if values[top] == depth else top
        stack.append(r)
    return np.array(left, np.int64), np.array(right, np.int64)


def _spans(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """low[k], low[k] + 1, … (size[k] numbers) for each k in turn."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - size), size)


def branching_squares(order: np.ndarray, lcp: np.ndarray, begin: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and half length of every branching square."""
    n = len(order)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    cut = np.flatnonzero(lcp)
    none = np.zeros(0, np.int64)
    if not len(cut):
        return none, none
    left, right = interval_bounds(lcp)
    left, right = left[cut], right[cut]
    by = np.argsort(left * (n + 1) + right, kind="stable")  # the cuts of one interval together, in order
    cut, left, right = cut[by], left[by], right[by]
    first = _differs(left * (n + 1) + right)
    last = np.append(first[1:], True)
    heads = np.flatnonzero(first)
    # children: one before the first cut of an interval, one from each cut to the next
    low = np.insert(cut, heads, left[heads])
    high = np.insert(np.where(last, right, np.append(cut[1:], 0)), heads, cut[heads])
    starts = heads + np.arange(len(heads))
    size = high - low
    count = np.diff(np.append(starts, len(low)))
    largest = np.repeat(np.maximum.reduceat(size, starts), count) == size
    seen = np.cumsum(largest)
    before = np.repeat(seen[starts] - largest[starts], count)
    small = np.flatnonzero(~(largest & (seen - before == 1)))  # all but the first of the largest
    owner = np.repeat(np.arange(len(heads)), count)[small]
    size = size[small]
    child_low, child_high = np.repeat(low[small], size), np.repeat(high[small], size)
    whole_low, whole_high = np.repeat(left[heads][owner], size), np.repeat(right[heads][owner], size)
    depth = np.repeat(lcp[cut[heads]][owner], size)
    at = order[_spans(low[small], size)]

    def meets(other: np.ndarray, there: np.ndarray) -> np.ndarray:
        r = place[np.where(there, other, 0)]
        return there & (r >= whole_low) & (r < whole_high) & ((r < child_low) | (r >= child_high))

    ahead = meets(at + depth, room[at] > depth)
    behind = meets(at - depth, at - depth >= begin[at])
    start = np.concatenate((at[ahead], at[behind] - depth[behind]))
    half = np.concatenate((depth[ahead], depth[behind]))
    key = np.unique(half * n + start)  # by half length, then start
    return key % n, key // n


def _rotate(words: np.ndarray, start: int, half: int, floor: int) -> int:
    """Start of the leftmost square that rotation reaches."""
    step = 16
    while start > floor:
        low = max(floor, start - step)
        odd = np.flatnonzero(words[low:start] != words[low + half : start + half])
        if len(odd):
            return low + int(odd[-1]) + 1
        start, step = low, step * 2
    return start


def merged_runs(words: np.ndarray, begin: np.ndarray, start: np.ndarray, half: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run of at least `least` words; squares come by half length."""
    for k in range(1, least - 1):  # a short square must rotate to make up `least` words
        if not (half * 2 + k <= least).any():
            break
        ok = (half * 2 + k > least) | (start - k >= begin[start])
        back = np.where(ok & (half * 2 + k <= least), start - k, 0)
        ok &= (half * 2 + k > least) | (words[back] == words[back + half])
        start, half = start[ok], half[ok]
    by_end: dict[int, list[tuple[int, int]]] = {}
    for i, p in zip(start.tolist(), half.tolist(), strict=True):
        known = by_end.setdefault(i + 2 * p, [])
        if any(s <= i and p % q == 0 for s, q in known):
            continue
        known.append((_rotate(words, i, p, int(begin[i])), p))
    return [(s, e, p) for e, found in by_end.items() for s, p in found if e - s >= least]


def find_runs(codes: np.ndarray, sizes: np.ndarray, least: int) -> list[list[tuple[int, int, int]]]:
    """Per text the (start, length, period) of its runs; `codes` are equal where words of one text are equal."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    if not len(codes):
        return found
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    begin = (ends - sizes)[text]
    room = ends[text] - np.arange(len(codes))
    order, ranks = suffix_ranks(codes, room)
    lcp = common_prefixes(order, ranks, room)
    start, half = branching_squares(order, lcp, begin, room)
    for s, e, p in merged_runs(codes, begin, start, half, least):
        found[text[s]].append((s - int(begin[s]), e - s, p))
    for runs in found:
        runs.sort(key=lambda x: (x[0], x[2]))
    return found


def _collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """Words outside runs and of the first period of each, joined by one space."""
    if runs:
        keep = np.ones(len(words), bool)
        for s, n, p in runs:
            keep[s + p : s + n] = False
        words = [words[k] for k in np.flatnonzero(keep).tolist()]
    return b" ".join(words).decode()


def _pieces(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    """Word lists of the texts in pieces of about PIECE words."""
    piece, n = [], 0
    for text in texts:
        words = (text or "").encode().split()  # bytes split at the six ASCII white-space characters
        if piece and n + len(words) > PIECE:
            yield piece
            piece, n = [], 0
        piece.append(words)
        n += len(words)
    if piece:
        yield piece


def _codes(piece: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the words of each text, none used for two texts, and the number of words of each."""
    sizes = np.array([len(words) for words in piece], np.int64)
    ids: dict[bytes, int] = {}
    flat = np.array([ids.setdefault(w, len(ids)) for words in piece for w in words], np.int64)
    return np.repeat(np.arange(len(piece)), sizes) * max(1, len(ids)) + flat, sizes


def detect(df: DataFrame, text: str = "text", least: int = 12, out: str = "found") -> DataFrame:
    """Add `out`: number of words, runs of at least `least` words by start and period, and the collapsed text."""
    kept = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for piece in _pieces(batch.column(text).to_pylist()):
                codes, sizes = _codes(piece)
                for words, found in zip(piece, find_runs(codes, sizes, least), strict=True):
                    runs = [{"start": s, "length": m, "period": p} for s, m, p in found]
                    rows.append({"n_words": len(words), "runs": runs, "collapsed": _collapse(words, found)})
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(rows, FOUND)], [*kept, out])

    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(out, from_arrow_type(FOUND))])
    return df.mapInArrow(run, schema)


def with_period(text: Column, key: Column) -> Column:
    """`text` for most keys; where crc32(key) ends in the decimal 0, its end repeats with a period set by the crc."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def rewritten(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % F.greatest(n, F.lit(1))
        p = F.lit(1) + F.floor((n - a) / (3 + g % 8)).cast("long")
        bounds = F.struct(a.alias("a"), p.alias("p"))
        source = lambda i, x: F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]).cast("int")
        return let(bounds, lambda x: F.array_join(F.transform(upto(F.size(words)), lambda i: F.get(words, source(i, x))), " "))

    return F.when(h % 10 == 0, let(split_words(text), rewritten)).otherwise(text)


def longest(runs: Column) -> Column:
    """Of the runs the longest, ties by smallest start, then period, as (length, -start, -period); null where there is none."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))


def listed(runs: Column) -> Column:
    """`start,length,period` and a line feed for each run, as one string."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


#: Equal words q apart in stretches of six or more: such a stretch is found by equal six-word windows.
ORACLE = r"""
WITH base AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) AS h
  FROM documents
), cut AS (
  SELECT *, len(ws)::BIGINT AS n, h // 10 AS g, (h // 10) % greatest(len(ws), 1) AS a FROM base
), edit AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 THEN list_transform(range(n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE ws END AS ws
  FROM cut
), word AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(n)) AS i FROM edit
), gram AS (
  SELECT doc_id, i, list(w) OVER six AS g6, count(*) OVER six AS m FROM word
  WINDOW six AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)
), pair AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM gram x JOIN gram y ON x.doc_id = y.doc_id AND x.g6 = y.g6 AND x.i < y.i WHERE x.m = 6 AND y.m = 6
), island AS (
  SELECT doc_id, q, min(i) AS s, count(*) + 5 AS same FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pair) GROUP BY doc_id, q, k
), run AS (
  SELECT doc_id, s, same + q AS len, min(q) AS q FROM island WHERE same >= greatest(12 - q, q) GROUP BY doc_id, s, same + q
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM run
), kept AS (
  SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS t FROM word w ANTI JOIN dropped d ON w.doc_id = d.doc_id AND w.i = d.i GROUP BY w.doc_id
), best AS (
  SELECT doc_id, count(*) AS n_runs, arg_max(struct_pack(s := s, len := len, q := q), [len, -s, -q]) AS top,
    sha256(string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q)) AS runs_sha256
  FROM run GROUP BY doc_id
)
SELECT e.doc_id, coalesce(b.n_runs, 0)::BIGINT AS n_runs, b.top.s::BIGINT AS start, b.top.len::BIGINT AS length, b.top.q::BIGINT AS period,
  (1000 * b.top.len // b.top.q)::BIGINT AS exponent_milli, coalesce(b.runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM edit e LEFT JOIN best b ON e.doc_id = b.doc_id LEFT JOIN kept k ON e.doc_id = k.doc_id
"""

"""Quality rules with limits learnt from mergeable quantile sketches.

Each text gets five signals; four ratios of them, in thousandths, are summarised per language and
source. The sketch of a group counts values by their first six binary digits, so it has relative
error 1/32, at most 32 buckets a power of two whatever the number of rows, and merges by adding
counts: sketches of sources add up to those of languages, and these to one of all rows. A group
below `MIN_ROWS` borrows the sketch of its language, and a small language that of all rows.

A limit lies `REACH` spreads outside the quartiles; the spread is the distance of the quartiles,
but at least the metric's own floor. A text is kept if the base rule passes and no ratio is outside.

Only DataFrame functions; signals are staged once (texts are read once), the limits are joined on.

Cases: a null text has no words; a text without words fails the base rule; null languages or
sources form groups of their own; repeated rows each get a row; ties at a limit pass; an empty
table gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwake.llm.words import SPACES, count_without, let, split_words, upto
from gridwake.session import stage

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MIN_ROWS = 200
REACH = 4
#: Ratio in thousandths: (numerator, denominator, least spread, has a lower limit).
RATIOS = {
    "word_length": ("word_chars", "n_words", 200, True),
    "symbols": ("n_symbols", "n_words", 25, False),
    "dup_lines": ("n_dup_lines", "n_lines", 75, False),
    "repeats": ("n_repeat_words", "n_words", 75, False),
}


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found at least twice."""

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def of(found: Column) -> Column:
            again = F.filter(found, lambda x, i: (F.get(found, i - 1)["h"] == x["h"]) | (F.get(found, i + 1)["h"] == x["h"]))
            return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(placed, of)).otherwise(0)

    def windows_of(hashes: Column) -> Column:
        return F.transform(upto(F.size(hashes) - 2), lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows_of(h), covered))


def _line_counts(text: Column) -> Column:
    worded = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    return let(worded, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))


def signals(df: DataFrame, keep: Sequence[Column], text: str = "text") -> DataFrame:
    """`keep` and the signals of each row."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    word_part = let(split_words(body), lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    got = df.select(
        *keep,
        word_part.alias("__w"),
        _line_counts(body).alias("__l"),
        count_without(body, SPACES).cast("long").alias("word_chars"),
        (F.length(body) - count_without(body, SYMBOLS)).cast("long").alias("n_symbols"),
    )
    names = [c for c in got.columns if c not in ("__w", "__l")]
    return got.select(
        *names,
        *[F.col(f"__w.{n}").cast("long").alias(n) for n in ("n_words", "n_repeat_words")],
        *[F.col(f"__l.{n}").cast("long").alias(n) for n in ("n_lines", "n_dup_lines")],
    )


def _ratio(name: str) -> Column:
    top, bottom, _, _ = RATIOS[name]
    return F.when(F.col(bottom) > 0, F.expr(f"1000 * {top} div {bottom}"))


def bucket(value: Column) -> Column:
    """Lower edge of the sketch bucket: the value with all but its first six binary digits cleared."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bucket counts per group and metric; nothing else is kept of the rows."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), _ratio(n).alias("v")) for n in RATIOS])).alias("m")
    return (
        rows.select(*by, each).filter("m.v IS NOT NULL").groupBy(*by, F.col("m.metric").alias("metric"), bucket(F.col("m.v")).alias("edge"))
        .agg(F.count("*").alias("n"))
    )


def merge(sketch: DataFrame, by: Sequence[str]) -> DataFrame:
    return sketch.groupBy(*by, "metric", "edge").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows and lower and upper quartile edge per group and metric."""
    group = Window.partitionBy(*by, "metric")
    upto_here = group.orderBy("edge").rowsBetween(Window.unboundedPreceding, 0)
    run = sketch.select(*by, "metric", "edge", F.sum("n").over(upto_here).alias("below"), F.sum("n").over(group).alias("rows"))
    return run.groupBy(*by, "metric").agg(
        F.max("rows").alias("rows"),
        F.min(F.when(F.col("below") * 4 >= F.col("rows"), F.col("edge"))).alias("q1"),
        F.min(F.when(F.col("below") * 4 >= F.col("rows") * 3, F.col("edge"))).alias("q3"),
    )


def _same(left: str, right: str, names: Sequence[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
    return out


def limits(sketch: DataFrame, by: Sequence[str], min_rows: int = MIN_ROWS, reach: int = REACH) -> DataFrame:
    """One row per group: `<metric>_lo` and `<metric>_hi`, from the finest level with enough rows."""
    levels = [quartiles(merge(sketch, by[:k]) if k < len(by) else sketch, by[:k]) for k in range(len(by), -1, -1)]
    found = levels[0].withColumn("use", F.when(F.col("rows") >= min_rows, F.struct("q1", "q3"))).select(*by, "metric", "use")
    for k, level in zip(range(len(by) - 1, -1, -1), levels[1:]):
        enough = F.lit(True) if k == 0 else F.col("b.rows") >= min_rows
        joined = found.alias("a").join(level.alias("b"), _same("a", "b", [*by[:k], "metric"]), "left")
        found = joined.select(*[F.col(f"a.{n}").alias(n) for n in [*by, "metric"]], F.coalesce("a.use", F.when(enough, F.struct("b.q1", "b.q3"))).alias("use"))
    aggs = []
    for name, (_, _, floor, lower) in RATIOS.items():
        spread = F.greatest(F.col("use.q3") - F.col("use.q1"), F.lit(floor)) * reach
        mine = F.col("metric") == name
        aggs.append(F.max(F.when(mine, F.col("use.q3") + spread)).alias(f"{name}_hi"))
        if lower:
            aggs.append(F.max(F.when(mine, F.col("use.q1") - spread)).alias(f"{name}_lo"))
    return found.groupBy(*by).agg(*aggs)


def judge(df: DataFrame, id_col: str = "doc_id", text: str = "text", by: Sequence[str] = ("lang", "source"), min_words: int = MIN_WORDS, min_rows: int = MIN_ROWS, reach: int = REACH) -> DataFrame:
    """Signals and verdict of every row, under the given id column."""
    groups = [f"__by{k}" for k in range(len(by))]
    rows = stage(signals(df, [F.col(f"`{id_col}`").alias("__id"), *[F.col(f"`{c}`").alias(g) for c, g in zip(by, groups)]], text))
    found = limits(sketches(rows, groups), groups, min_rows, reach)
    joined = rows.alias("r").join(found.alias("t"), _same("r", "t", groups), "left").select("r.*", *[F.col(f"t.{c}") for c in found.columns if c not in groups])
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.lit(True)
    for name, (_, _, _, lower) in RATIOS.items():
        inside = inside & F.coalesce(_ratio(name) <= F.col(f"{name}_hi"), F.lit(True))
        if lower:
            inside = inside & F.coalesce(_ratio(name) >= F.col(f"{name}_lo"), F.lit(True))
    return joined.select(
        F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & inside).alias("kept"),
    )


ORACLE = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS MATERIALIZED (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
dup AS (SELECT r, k FROM wins GROUP BY r, k HAVING count(*) > 1),
cov AS (SELECT r, count(DISTINCT i + j) AS c FROM wins JOIN dup USING (r, k), (SELECT unnest([0, 1, 2]) AS j) GROUP BY r),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
s AS MATERIALIZED (
  SELECT d.r, doc_id, lang, source, len(w)::BIGINT AS n_words,
         (length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(c, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM d LEFT JOIN cov USING (r) LEFT JOIN lines USING (r)),
ratio AS MATERIALIZED (
  SELECT r, 1000 * word_chars // n_words AS word_length, 1000 * n_symbols // n_words AS symbols,
         1000 * n_dup_lines // n_lines AS dup_lines, 1000 * n_repeat_words // n_words AS repeats
  FROM s WHERE n_words > 0),
long AS MATERIALIZED (
  SELECT lang, source, metric, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS edge
  FROM (SELECT s.lang, s.source, unnest(['word_length', 'symbols', 'dup_lines', 'repeats']) AS metric,
               unnest([word_length, symbols, dup_lines, repeats]) AS v FROM ratio JOIN s USING (r))),
lev AS (
  SELECT 2 AS k, lang, source, metric, edge FROM long UNION ALL SELECT 1, lang, NULL, metric, edge FROM long
  UNION ALL SELECT 0, NULL, NULL, metric, edge FROM long),
q AS MATERIALIZED (
  SELECT k, lang, source, metric, count(*) AS n, list_sort(list(edge)) AS e FROM lev GROUP BY ALL),
q2 AS (SELECT k, lang, source, metric, n, e[(n + 3) // 4] AS q1, e[(3 * n + 3) // 4] AS q3 FROM q),
lim AS MATERIALIZED (
  SELECT a.lang, a.source, a.metric,
         CASE WHEN a.n >= 200 THEN a.q1 WHEN b.n >= 200 THEN b.q1 ELSE c.q1 END AS q1,
         CASE WHEN a.n >= 200 THEN a.q3 WHEN b.n >= 200 THEN b.q3 ELSE c.q3 END AS q3
  FROM q2 a JOIN q2 b ON b.k = 1 AND b.lang IS NOT DISTINCT FROM a.lang AND b.metric = a.metric
  JOIN q2 c ON c.k = 0 AND c.metric = a.metric WHERE a.k = 2),
edge AS (
  SELECT lang, source, metric, q3 + 4 * greatest(q3 - q1, floor_) AS hi, CASE WHEN metric = 'word_length' THEN q1 - 4 * greatest(q3 - q1, floor_) ELSE -1 END AS lo
  FROM lim JOIN (VALUES ('word_length', 200), ('symbols', 25), ('dup_lines', 75), ('repeats', 75)) f(metric, floor_) USING (metric)),
bad AS (
  SELECT DISTINCT s.r FROM s JOIN ratio USING (r) JOIN edge ON edge.lang IS NOT DISTINCT FROM s.lang AND edge.source IS NOT DISTINCT FROM s.source
  WHERE CASE metric WHEN 'word_length' THEN word_length > hi OR word_length < lo WHEN 'symbols' THEN symbols > hi
             WHEN 'dup_lines' THEN dup_lines > hi ELSE repeats > hi END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND r NOT IN (SELECT r FROM bad) AS kept
FROM s
"""

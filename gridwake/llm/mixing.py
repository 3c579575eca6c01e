"""Mixing sources to target weights through a tree of budgets.

`levels` name the tree's columns from the root down; each level gives its nodes integer weights. A
node can take at most `max_epochs` times its tokens. The total is shared out from the root: the
children of a node get shares by weight, a child whose share exceeds what it can take is filled
and its surplus goes to its siblings by weight. As a node's own limit is the sum of its leaves',
a shortage leaves a subtree only when all of it is full: siblings come before ancestors. Shares are
whole tokens; the few left by rounding go to the first children in order.

A leaf's budget is so many whole epochs plus a rest. Each epoch has its own seeded order of the
leaf's documents; the last one is cut at the longest prefix whose tokens fit the rest. The order
is cut into 4,096 ranges of the hash: only range totals are summed in order, and only the range
that holds the end of the prefix is sorted, so no leaf is ever ordered in one task.

Only DataFrame functions; texts are read once for their token counts.

Cases: null texts count no tokens; a document without tokens costs nothing and follows its place
in the order; null level values are nodes of their own; rows of equal id stand or fall together;
weights below one count as one; an empty table gives an empty result; other columns pass through
`mix`.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwake.llm.words import split_words
from gridwake.session import stage

RANGE_DIGITS = 3
SEED = "mix-1"


def token_counts(docs: DataFrame, levels: Mapping[str, Column], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`id, text_key, tokens` and the level columns, without the text; tokens are words."""
    return stage(
        docs.select(
            F.col(f"`{id_col}`").cast("long").alias("id"),
            F.xxhash64(f"`{text}`").alias("text_key"),
            F.size(split_words(F.col(f"`{text}`"))).cast("long").alias("tokens"),
            *[value.alias(name) for name, value in levels.items()],
        )
    )


def _same(left: str, right: str, names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
    return out


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add `budget` to rows `parent..., name, w, cap, b`, `b` being the parent's budget (at most the sum of caps)."""
    order = [F.col("cap") / F.col("w"), F.col(name).asc_nulls_first()]
    group = Window.partitionBy(*parent)
    before = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = children.select(
        "*",
        (F.col("b") - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("_b"),
        (F.sum("w").over(group) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("_w"),
        F.row_number().over(group.orderBy(*order)).alias("_k"),
    )
    fits = (F.col("cap") * F.col("_w") <= F.col("w") * F.col("_b")).cast("int")
    rows = rows.withColumn("_full", F.min(fits).over(group.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) == 1)
    filled = F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(group)
    weight = F.sum(F.when(F.col("_full"), 0).otherwise(F.col("w"))).over(group)
    rows = rows.select("*", (F.col("b") - filled).alias("_rest"), weight.alias("_open"), F.sum(F.col("_full").cast("int")).over(group).alias("_n"))
    share = F.when(F.col("_full"), F.col("cap")).otherwise(F.expr("w * _rest div _open"))
    rows = rows.withColumn("_share", share)
    spare = F.col("b") - F.sum("_share").over(group)
    rows = rows.withColumn("budget", F.col("_share") + F.when(~F.col("_full") & (F.col("_k") - F.col("_n") <= spare), 1).otherwise(0))
    return rows.select(*parent, name, "cap", "budget")


def budgets(counts: DataFrame, weights: Mapping[str, Column], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """`budget` and `tokens` of each leaf; the total is `share[0] / share[1]` of all tokens, as far as the caps allow."""
    names = list(weights)
    leaves = counts.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    leaves = stage(leaves.withColumn("cap", F.col("tokens") * max_epochs))
    above = leaves.agg(F.least(F.expr(f"sum(tokens) * {share[0]} div {share[1]}"), F.sum("cap")).alias("b"))
    found = None
    for k, name in enumerate(names):
        level = leaves.groupBy(*names[: k + 1]).agg(F.sum("cap").alias("cap")).withColumn("w", F.greatest(weights[name], F.lit(1)).cast("long"))
        if found is None:
            total = above.withColumn("_one", F.lit(1))
            level = level.withColumn("_one", F.lit(1)).join(total, "_one").drop("_one")  # one row
        else:
            up = names[:k]
            level = level.alias("c").join(found.alias("p"), _same("c", "p", up)).select("c.*", F.col("p.budget").alias("b"))
        found = share_out(level, names[:k], name)
    return found.alias("f").join(leaves.alias("l"), _same("f", "l", names)).select("f.*", "l.tokens").withColumnRenamed("tokens", "leaf_tokens")


def copies(counts: DataFrame, weights: Mapping[str, Column], share: tuple[int, int] = (4, 5), max_epochs: int = 2, seed: str = SEED) -> DataFrame:
    """`counts` with `copies`: how often each row is taken."""
    names = list(weights)
    leaf = stage(budgets(counts, weights, share, max_epochs))
    whole = F.when(F.col("leaf_tokens") > 0, F.expr("budget div leaf_tokens")).otherwise(F.lit(0).cast("long"))
    rows = counts.alias("d").join(leaf.alias("l"), _same("d", "l", names)).select("d.*", "l.budget", "l.leaf_tokens").withColumn("whole", whole)
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("whole").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    rows = stage(rows.select("*", (F.col("budget") - F.col("whole") * F.col("leaf_tokens")).alias("rest"), key.alias("key")).withColumn("range", F.substring("key", 1, RANGE_DIGITS)))
    totals = rows.groupBy(*names, "range").agg(F.sum("tokens").alias("in_range"))
    ahead = Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("*", F.coalesce(F.sum("in_range").over(ahead), F.lit(0)).alias("ahead"))
    placed = rows.alias("d").join(offsets.alias("o"), _same("d", "o", [*names, "range"])).select("d.*", "o.in_range", "o.ahead")
    end = (F.col("ahead") <= F.col("rest")) & (F.col("rest") < F.col("ahead") + F.col("in_range"))
    inside = Window.partitionBy(*names, "range").orderBy("key")
    at_end = placed.filter(end).withColumn("extra", (F.col("ahead") + F.sum("tokens").over(inside) <= F.col("rest")).cast("long"))
    clear = placed.filter(~end).withColumn("extra", (F.col("ahead") + F.col("in_range") <= F.col("rest")).cast("long"))
    both = clear.unionByName(at_end)
    return both.select("id", "text_key", *names, "tokens", (F.col("whole") + F.col("extra")).alias("copies"))


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Column], id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs`, each as often as it is taken."""
    taken = copies(token_counts(docs, levels, id_col, text), weights, **options)
    taken = taken.select(F.col("id").alias("__id"), F.col("text_key").alias("__key"), F.col("copies").alias("__n")).filter("__n > 0").distinct()
    names = docs.columns
    rows = docs.withColumn("__text_key", F.xxhash64(f"`{text}`")).alias("d")
    on = F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("t.__id")) & (F.col("d.__text_key") == F.col("t.__key"))
    out = rows.join(taken.alias("t"), on).select(*[F.col(f"d.`{c}`") for c in names], F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))).alias("__copy"))
    return out.drop("__copy")


def corpus_levels() -> dict[str, Column]:
    """Domain, language and source of `documents`; a domain is read off the number of the source."""
    number = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), r"([0-9]+)$", 1)
    kind = number.try_cast("bigint") % 4
    domain = F.when(number == "", F.lit("other")).when(kind == 0, F.lit("web")).when(kind == 1, F.lit("books")).when(kind == 2, F.lit("news")).otherwise(F.lit("reference"))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def corpus_weights() -> dict[str, Column]:
    def table(name: str, known: dict[str, int]) -> Column:
        out = F.lit(1)
        for value, w in known.items():
            out = F.when(F.col(name) == value, F.lit(w)).otherwise(out)
        return out

    return {
        "domain": table("domain", {"web": 5, "books": 3, "news": 2}),
        "lang": table("lang", {"en": 6, "de": 2, "fr": 2, "es": 2}),
        "source": F.lit(1),
    }


_LEVEL_SQL = """
{name} AS MATERIALIZED (
  SELECT *, CASE WHEN full_ THEN cap ELSE share + CASE WHEN k - n_full <= b - sum(CASE WHEN full_ THEN cap ELSE share END) OVER g THEN 1 ELSE 0 END END AS budget
  FROM (SELECT *, w * (b - filled) // nullif(open_, 0) AS share FROM (
    SELECT *, coalesce(sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER g, 0)::BIGINT AS filled, sum(CASE WHEN full_ THEN 0 ELSE w END) OVER g::BIGINT AS open_,
           sum(full_::INT) OVER g AS n_full
    FROM (SELECT *, min((cap * w_left <= w * b_left)::INT) OVER (PARTITION BY {parent} ORDER BY k) = 1 AS full_ FROM (
      SELECT *, b - coalesce(sum(cap) OVER before, 0)::BIGINT AS b_left, sum(w) OVER g::BIGINT - coalesce(sum(w) OVER before, 0)::BIGINT AS w_left,
             row_number() OVER (PARTITION BY {parent} ORDER BY cap / w, {child} NULLS FIRST) AS k
      FROM ({rows})
      WINDOW g AS (PARTITION BY {parent}), before AS (PARTITION BY {parent} ORDER BY cap / w, {child} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
    WINDOW g AS (PARTITION BY {parent})))
  WINDOW g AS (PARTITION BY {parent}))"""

ORACLE = (
    r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens,
         CASE regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) WHEN '' THEN 'other' ELSE
           CASE regexp_extract(coalesce(source, ''), '([0-9]+)$', 1)::BIGINT % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'news' ELSE 'reference' END END AS domain
  FROM documents),
leaf AS MATERIALIZED (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * 2 AS cap FROM d GROUP BY ALL),"""
    + _LEVEL_SQL.format(
        name="l1", parent="one", child="domain",
        rows="SELECT 1 AS one, domain, sum(cap)::BIGINT AS cap, CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 WHEN 'news' THEN 2 ELSE 1 END::BIGINT AS w, (SELECT least(sum(tokens)::BIGINT * 4 // 5, sum(cap)::BIGINT) FROM leaf) AS b FROM leaf GROUP BY domain",
    )
    + ","
    + _LEVEL_SQL.format(
        name="l2", parent="domain", child="lang",
        rows="SELECT c.*, l1.budget AS b FROM (SELECT domain, lang, sum(cap)::BIGINT AS cap, CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END::BIGINT AS w FROM leaf GROUP BY domain, lang) c JOIN l1 USING (domain)",
    )
    + ","
    + _LEVEL_SQL.format(
        name="l3", parent="domain, lang", child="source",
        rows="SELECT leaf.domain, leaf.lang, leaf.source, leaf.cap, leaf.tokens, 1::BIGINT AS w, l2.budget AS b FROM leaf JOIN l2 ON leaf.domain = l2.domain AND leaf.lang IS NOT DISTINCT FROM l2.lang",
    )
    + """,
e AS MATERIALIZED (
  SELECT d.*, coalesce(l3.budget // nullif(l3.tokens, 0), 0)::BIGINT AS whole, l3.budget - coalesce(l3.budget // nullif(l3.tokens, 0), 0) * l3.tokens AS rest
  FROM d JOIN l3 ON d.domain = l3.domain AND d.lang IS NOT DISTINCT FROM l3.lang AND d.source IS NOT DISTINCT FROM l3.source)
SELECT doc_id, domain, lang, source, tokens,
       (whole + CASE WHEN sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('mix-1|' || whole || '|' || coalesce(doc_id::VARCHAR, ''))) <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM e
"""
)

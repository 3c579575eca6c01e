"""Topic-to-module propagation and rankings of catalogue items.

Rankings are over catalogue items (modules, channels, topics) within a scope: the catalogue
bounds a window partition, whatever the number of runs or rows behind the scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwake.functions.numeric import ratio, ratio0
from gridwake.operators.bootstrap import hash_draw
from gridwake.plans.ordered import dense_index
from gridwake.session import stage

ROLE_OF_MODE = {"producer_only": "publisher", "consumer_only": "subscriber", "bidirectional": None}


def allocation(edges: DataFrame, role: str | None = None) -> DataFrame:
    """Equal split of a topic over its distinct modules: `(topic, module, weight)`."""
    picked = edges if role is None else edges.filter(F.col("role") == role)
    pairs = picked.select("topic", "module").distinct()
    degree = pairs.groupBy("topic").agg(F.count(F.lit(1)).alias("degree"))
    return pairs.join(degree, "topic").select("topic", "module", (F.lit(1.0) / F.col("degree")).alias("weight"), "degree")


def allocate(evidence: DataFrame, alloc: DataFrame, by: Sequence[str], value: str = "evidence", name: str = "score") -> DataFrame:
    j = evidence.join(alloc.select("topic", "module", "weight"), "topic")
    return j.groupBy(*by, "module").agg(F.sum(F.col(value) * F.col("weight")).alias(name))


def _prime_from(n: int) -> int:
    """Smallest prime that is at least `n`."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def random_allocation(topics: DataFrame, edges: DataFrame, seed: int) -> DataFrame:
    """As many modules per topic as the real mapping gives (at least one), drawn by a keyed permutation.

    Modules are numbered by name. With the smallest prime p that is no less than their number, `(a i + b)
    mod p` with a topic's own a and b runs through all numbers once; its first ones below the number of
    modules are the draw. So a topic makes as many rows as it draws, and the modules it doesn't draw
    never meet it.
    """
    modules = edges.select("module").distinct().withColumn("_c", F.substring("module", 1, 2))
    modules = stage(dense_index(modules, [], ["_c"], [F.col("module")], "_i").select("module", "_i"))
    m = modules.count()
    if not m:
        return topics.select("topic", F.lit("").alias("module"), F.lit(1.0).alias("weight")).limit(0)
    p = _prime_from(m)
    real = edges.select("topic", "module").distinct().groupBy("topic").agg(F.count(F.lit(1)).alias("degree"))
    draw = lambda what: hash_draw(F.lit(str(seed)), F.col("topic"), F.lit(what))
    wanted = topics.select("topic").distinct().join(real, "topic", "left").withColumns(
        {"want": F.greatest(F.lit(1), F.coalesce("degree", F.lit(0))).cast("int"), "a": draw("a") % (p - 1) + 1, "b": draw("b") % p}
    )
    tried = F.transform(F.sequence(F.lit(0).cast("long"), F.col("want").cast("long") + (p - m - 1)), lambda i: (F.col("a") * i + F.col("b")) % p)
    numbers = F.slice(F.filter(tried, lambda v: v < m), F.lit(1), F.col("want"))
    drawn = wanted.select("topic", (F.lit(1.0) / F.col("want")).alias("weight"), F.explode(numbers).alias("_i"))
    return drawn.join(modules, "_i").select("topic", "module", "weight")


def propagate(importance: DataFrame, edges: DataFrame, mode: str, by: Sequence[str] = ("scope",), value: str = "value") -> DataFrame:
    """Module scores, share and dense rank for one propagation mode.

    Scores are kept to nine decimals: modules with the same topics must tie whatever the order
    in which their shares were summed.
    """
    if mode == "topic_only":
        scored = importance.select(*by, F.col("topic").alias("module"), F.col(value).alias("score"))
    else:
        scored = allocate(importance, allocation(edges, ROLE_OF_MODE[mode]), by, value)
    scored = scored.withColumn("score", F.round("score", 9))
    return with_share_and_rank(scored.withColumn("mode", F.lit(mode)), [*by, "mode"])


def with_share_and_rank(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*by)
    return scored.withColumns(
        {"share": ratio0(F.col("score"), F.sum("score").over(w)), "rank": F.dense_rank().over(w.orderBy(F.col("score").desc())).cast("long")}
    )


def propagation_checks(importance: DataFrame, edges: DataFrame, mode: str, by: Sequence[str] = ("scope",), value: str = "value") -> DataFrame:
    """Mass per topic before and after propagation; unmapped topics pass nothing on."""
    alloc = allocation(edges, ROLE_OF_MODE[mode])
    sums = alloc.groupBy("topic").agg(F.sum("weight").alias("_w"), F.count(F.lit(1)).alias("module_count"))
    j = importance.join(sums, "topic", "left")
    mapped = F.col("module_count").isNotNull()
    out = F.when(mapped, F.col(value) * F.col("_w")).otherwise(F.lit(0.0))
    return j.select(
        *by, "topic", mapped.alias("mapped"), F.coalesce("module_count", F.lit(0)).cast("long").alias("module_count"),
        F.col(value).alias("input"), out.alias("output"), F.when(mapped, out - F.col(value)).otherwise(F.lit(0.0)).alias("conservation_error"),
    )


def mapping_coverage(topics: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct modules per topic and role, zeros for unmapped topics."""
    def of(role: str) -> Column:
        return F.count_distinct(F.when(F.col("role") == role, F.col("module")))

    per = edges.groupBy("topic").agg(
        of("publisher").alias("publishers"), of("subscriber").alias("subscribers"), F.count_distinct("module").alias("modules")
    )
    out = topics.select("topic").distinct().join(per, "topic", "left").fillna(0)
    return out.withColumns({"has_publisher": F.col("publishers") > 0, "has_subscriber": F.col("subscribers") > 0})


def conservative_rank(df: DataFrame, by: Sequence[str], score: str = "score", tolerance: float = 1e-12) -> DataFrame:
    """Number of items with a score of at least this one (worst place in a tie); NULL without evidence."""
    part = f"PARTITION BY {', '.join(f'`{b}`' for b in by)} " if by else ""
    count = F.expr(f"count(*) OVER ({part}ORDER BY `{score}` DESC RANGE BETWEEN UNBOUNDED PRECEDING AND {tolerance!r}D FOLLOWING)")
    return df.withColumn("_cr", count).withColumn("rank", F.when(F.col(score) > tolerance, F.col("_cr"))).drop("_cr")


def dense_rank_by(df: DataFrame, by: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.dense_rank().over(Window.partitionBy(*by).orderBy(F.col(value).desc())).cast("long"))


def ordinal_rank_by(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def degree_normalized(scores: DataFrame, edges: DataFrame, by: Sequence[str] = ("scope",)) -> DataFrame:
    """Module score over its number of mapped topics (missing: 1), share and dense rank."""
    deg = edges.groupBy("module").agg(F.count_distinct("topic").alias("topics"))
    j = scores.join(deg, "module", "left").withColumn("topics", F.coalesce("topics", F.lit(1)).cast("long"))
    norm = j.withColumn("raw", F.col("score")).withColumn("score", F.col("score") / F.col("topics"))
    return with_share_and_rank(norm, by)


def rank_changes(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    a = before.select(*keys, F.col("rank").alias("rank_before"))
    b = after.select(*keys, F.col("rank").alias("rank_after"))
    return a.join(b, list(keys), "full").withColumn("rank_change", F.col("rank_after") - F.col("rank_before"))


def compare_rankings(a: DataFrame, b: DataFrame, ks: Sequence[int], by: Sequence[str] = ("scope",)) -> DataFrame:
    """Top-k overlap and Jaccard for every k, and Spearman over the common items.

    `a` and `b` hold one score per item; an item's place is its rank by score, then name.
    """
    by = list(by)

    def placed(df: DataFrame, side: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.col("score").desc(), "module")
        return df.select(*by, "module", F.col("score").alias(f"s_{side}"), F.row_number().over(w).alias(f"r_{side}"))

    j = placed(a, "a").join(placed(b, "b"), [*by, "module"], "full")
    aggs = []
    for k in ks:
        in_a, in_b = F.coalesce(F.col("r_a") <= k, F.lit(False)), F.coalesce(F.col("r_b") <= k, F.lit(False))
        aggs += [F.count(F.when(in_a & in_b, 1)).alias(f"both_{k}"), F.count(F.when(in_a | in_b, 1)).alias(f"any_{k}")]
    counts = j.groupBy(*by).agg(*aggs)
    common = j.filter(F.col("s_a").isNotNull() & F.col("s_b").isNotNull())

    def average_rank(col: str) -> Column:
        w = Window.partitionBy(*by)
        ties = F.count(F.lit(1)).over(Window.partitionBy(*by, col))
        return F.rank().over(w.orderBy(F.col(col).desc())) + (ties - 1) / 2.0

    ranked = common.withColumns({"x": average_rank("s_a"), "y": average_rank("s_b")})
    cov = F.covar_pop("x", "y")
    rho = ranked.groupBy(*by).agg(
        F.try_divide(cov, F.stddev_pop("x") * F.stddev_pop("y")).alias("spearman"), F.count(F.lit(1)).alias("common_items")
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(k).cast("long").alias("k"),
                F.col(f"both_{k}").alias("overlap"),
                F.coalesce(ratio(f"both_{k}", f"any_{k}"), F.lit(1.0)).alias("jaccard"),
            )
            for k in ks
        ]
    )
    return counts.select(*by, F.explode(rows).alias("r")).select(*by, "r.*").join(rho, by, "left")


def time_to_topk(window_scores: DataFrame, onset: float, k: int, truth: str = "truth") -> DataFrame:
    """First time at or after the onset at which the true module is among the top k of its window."""
    w = Window.partitionBy("run", "w").orderBy(F.col("score").desc(), "module")
    ranked = window_scores.withColumn("rank", F.row_number().over(w))
    hit = (F.col("module") == F.col(truth)) & (F.col("rank") <= k) & (F.col("t") >= onset)
    return ranked.groupBy("run").agg((F.min(F.when(hit, F.col("t"))) - F.lit(onset)).alias("delay"))


def argmax_row(df: DataFrame, by: Sequence[str], value: str, tie: str) -> DataFrame:
    """The whole row with the largest value per group; ties take the smallest `tie`."""
    rest = [c for c in df.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct(F.col(value), -F.col(tie)))
    return df.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")

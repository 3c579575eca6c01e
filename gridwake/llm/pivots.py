"""Links inside buckets of candidates, without all pairs of a bucket, and classes of linked ids.

Every member of a bucket is compared with the bucket's pivot: its least id, or where only classes
are wanted the member that meets most others in all its buckets. In large buckets the
members it does not reach elect a further pivot among themselves, a fixed number of times. A member
linked to a lower id, in whatever bucket, is settled. The rest is compared with all members of
lower id in its buckets that the triangle inequality does not rule out: if
`|d(p, x) - d(p, y)| > limit` then `d(x, y) > limit`.
So a member with a near member of lower id is linked to some member of lower id. Where only
classes are wanted (`by_class`), two members within the limit always end in one class: after the
rounds, members of different classes are compared whether a pivot reached them or not. Of two
such members at least one lies outside the bucket's largest class, so only these look for
partners, and a large group costs about its size, not its square. Two members meet at most once
in the last comparison, however many buckets they share and however often a bucket names them.

Pivots with very many members are spread by the engine's skew handling: the joins are plain
equi-joins on ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwake.session import stage

#: Members not reached from which a bucket elects one more pivot, and how often at most.
LARGE = 16
ROUNDS = 3
#: Rank of a member that has been a pivot.
_LAST = -(1 << 63)


def _measured(pairs: DataFrame, payload: DataFrame, distance: Callable[[Column, Column], Column]) -> DataFrame:
    """`a, b, d` for distinct pairs."""
    left = payload.select(F.col("id").alias("a"), F.col("data").alias("x"))
    right = payload.select(F.col("id").alias("b"), F.col("data").alias("y"))
    return pairs.select("a", "b").distinct().join(left, "a").join(right, "b").select("a", "b", distance(F.col("x"), F.col("y")).alias("d"))


def shared_members(members: DataFrame) -> DataFrame:
    """The distinct rows of `members(bucket, id)` whose bucket names two ids or more.

    Nearly all buckets name one id. Members are dealt and sorted by bucket once, and what passes is
    found in that order, with one row held back.
    """

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = (np.zeros(0, np.int64), np.zeros(0, np.int64)), None  # a bucket of one id so far; one of several
        for batch in batches:
            if not len(batch):
                continue
            bucket, ids = (np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held))
            change = np.ones(len(bucket), bool)
            change[1:] = bucket[1:] != bucket[:-1]
            start = np.flatnonzero(change)
            group = np.cumsum(change) - 1
            several = np.logical_or.reduceat(ids != ids[start][group], start)
            several[0] |= bucket[0] == known
            last = slice(start[-1], start[-1] + (not several[-1]))
            held, known = (bucket[last], ids[last]), bucket[-1] if several[-1] else None
            on = several[group]
            if on.any():
                yield pa.RecordBatch.from_arrays([pa.array(bucket[on]), pa.array(ids[on])], ["bucket", "id"])

    dealt = members.select("bucket", "id").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(met, "bucket long, id long").dropDuplicates(["bucket", "id"])


def bucket_links(
    members: DataFrame, payload: DataFrame | Callable[[DataFrame], DataFrame], distance: Callable[[Column, Column], Column], limit: float,
    by_class: bool = False, screen: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Links `a < b, d` with `d <= limit` between the ids of `members(bucket, id)`.

    `payload` has one row `id, data` per id, or is a function that gives one for a table of ids; `distance` must be a metric on `data`, and may report
    any value over `2 * limit` as one fixed value over it. `screen` is a necessary condition for a
    link, on the `sketch` column that the payload then has; it thins out the last comparison.
    With `by_class` the links join whatever all links would join, and no more is promised.
    """
    shared = shared_members(members)
    if by_class:
        # whoever meets most members in all its buckets lies in the middle of its group and reaches most of it
        met = stage(shared)
        sized = met.join(met.groupBy("bucket").agg(F.count("*").alias("n")), "bucket")
        shared = met.join(sized.groupBy("id").agg(F.sum("n").alias("rank")), "id").select("bucket", "id", "rank")
    else:
        shared = shared.select("bucket", "id", (-F.col("id")).alias("rank"))
    shared = stage(shared)
    rest = stage(shared.join(_pivots(shared), "bucket").filter("id <> pivot"))
    if not isinstance(payload, DataFrame):
        payload = payload(shared.select("id").distinct())
    found = stage(_measured(_pairs(rest), payload, distance))
    links = [found.filter(F.col("d") <= limit)]
    # near the pivot or not: one row per bucket and member, with the distance to the first pivot
    known = _with_distance(rest, found).select("bucket", "id", "rank", "d")
    open_ = known.filter(F.col("d") > limit).select("bucket", "id", "rank", F.col("d").alias("d1"))
    open_ = stage(open_ if by_class else _unsettled(open_, links[0]))
    if open_.isEmpty():
        return links[0]
    further = []
    for k in range(ROUNDS):
        crowded = open_.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > LARGE).select("bucket")
        crowd = open_.join(crowded, "bucket")
        again = stage(crowd.join(_pivots(crowd), "bucket").filter("id <> pivot"))
        if again.isEmpty():
            break
        # few members are left, so the others' data is not moved
        ids = again.select("id").union(again.select(F.col("pivot").alias("id"))).distinct()
        data = stage(payload.select("id", "data").join(ids, "id", "left_semi"))
        found = stage(_measured(_pairs(again), data, distance))
        near = found.filter(F.col("d") <= limit)
        links.append(near)
        chosen = again.select("bucket", F.col("pivot").alias("id")).distinct()
        further.append(_with_distance(again, found).select("bucket", "id", "d").union(chosen.withColumn("d", F.lit(0.0))).withColumn("round", F.lit(k)))
        reached = _with_distance(again, near).select("bucket", "id")
        left = open_.join(reached, ["bucket", "id"], "left_anti").join(chosen.withColumn("done", F.lit(True)), ["bucket", "id"], "left")
        left = left.select("bucket", "id", F.when(F.col("done"), _LAST).otherwise(F.col("rank")).alias("rank"), "d1")
        open_ = stage(left if by_class else _unsettled(left, near))
    so_far = _union(links)
    if by_class:
        x, y = _apart(known, further, components(so_far))
    else:
        x = open_.select("bucket", "id", F.col("d1").alias("d"))
        y = stage(known.select("bucket", "id", "d").join(x.select("bucket").distinct(), "bucket", "left_semi"))
    about = y.groupBy("id").agg(F.collect_list("bucket").alias("homes"))  # at most the buckets of one member
    if screen:
        about = about.join(payload.select("id", "sketch"), "id")
    # in steps: a plan of all of them is large, and the driver plans it anew after every shuffle
    about = stage(about)
    x, y = x.join(about, "id"), y.join(about, "id")
    left = stage(_measured(stage(_unruled(x, y, limit, by_class, screen)), payload, distance).filter(F.col("d") <= limit))
    return _union([so_far, left]).distinct()


def _unsettled(open_: DataFrame, links: DataFrame) -> DataFrame:
    """Members without a link to a lower id."""
    return open_.join(links.select(F.col("b").alias("id")).distinct(), "id", "left_anti")


def _apart(known: DataFrame, further: list[DataFrame], classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members outside the largest class of their bucket, and all members of buckets that have such, with class and distances to later pivots."""
    named = stage(known.join(classes, "id", "left").select("bucket", "id", "d", F.coalesce("class", "id").alias("class")))
    sizes = named.groupBy("bucket", "class").agg(F.count("*").alias("n"))
    tops = sizes.groupBy("bucket").agg(F.max(F.struct("n", "class")).alias("top"), F.count("*").alias("classes")).filter("classes > 1")
    mixed = named.join(tops, "bucket").select("bucket", "id", "d", "class", (F.col("class") == F.col("top.class")).alias("most"))
    later = [f"d{k + 2}" for k in range(ROUNDS)]
    if further:
        rows = _union(further).groupBy("bucket", "id").agg(*[F.max(F.when(F.col("round") == k, F.col("d"))).alias(n) for k, n in enumerate(later)])
        mixed = mixed.join(rows, ["bucket", "id"], "left")
    else:
        mixed = mixed.select("*", *[F.lit(None).cast("double").alias(n) for n in later])
    mixed = stage(mixed)
    return mixed.filter(~F.col("most")), mixed


def _pivots(shared: DataFrame) -> DataFrame:
    """`bucket, pivot`: the member of highest rank, of equals the one of lowest id."""
    return shared.groupBy("bucket").agg(F.max(F.struct("rank", (-F.col("id")).alias("id"))).alias("top")).select("bucket", (-F.col("top.id")).alias("pivot"))


def _pairs(rest: DataFrame) -> DataFrame:
    return rest.select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b"))


def _with_distance(rest: DataFrame, found: DataFrame) -> DataFrame:
    return rest.withColumns({"a": F.least("pivot", "id"), "b": F.greatest("pivot", "id")}).join(found, ["a", "b"])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.union(more)
    return out


def _unruled(x: DataFrame, y: DataFrame, limit: float, by_class: bool, screen: Callable[[Column, Column], Column] | None) -> DataFrame:
    """Pairs of a member of `x` and another member of its bucket in `y` whose distances to a common pivot differ by at most the limit.

    Distances to the first pivot are cut into cells as wide as the limit, so that only equal and
    adjacent cells meet. By class, only members of different classes meet, and a pair that stands
    on both sides twice is taken once; else a member only looks for lower ids. Two members with
    several buckets (`homes`) in common meet in the least of them: a bucket that rules them out
    rules them out for all.
    """
    width = max(limit, 1e-9)
    cell = F.floor(F.col("d") / width)
    x = x.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1))).alias("x")
    y = y.withColumn("cell", cell).alias("y")
    within = lambda d: F.abs(F.col(f"x.{d}") - F.col(f"y.{d}")) <= limit
    if by_class:
        apart = (F.col("x.class") != F.col("y.class")) & (F.col("y.most") | (F.col("x.id") < F.col("y.id")))
        for k in range(ROUNDS):
            apart = apart & F.coalesce(within(f"d{k + 2}"), F.lit(True))
    else:
        apart = F.col("y.id") < F.col("x.id")
    if screen:
        apart = apart & screen(F.col("x.sketch"), F.col("y.sketch"))
    apart = apart & (F.col("x.bucket") == F.array_min(F.array_intersect("x.homes", "y.homes")))
    near = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.cell") == F.col("y.cell")) & within("d") & apart)
    return near.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """`id, class`: the least id that links lead to, for every id with a link.

    Labels spread along links and then jump to the label of their label; the table of labels is
    staged after every round and nothing but a yes-or-no answer reaches the driver.
    """
    both = stage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stage(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("class")))
    while True:
        offered = both.join(labels.select(F.col("id").alias("b"), "class"), "b").groupBy(F.col("a").alias("id")).agg(F.min("class").alias("offer"))
        lower = labels.join(offered, "id").select("id", F.col("class").alias("old"), F.least("class", "offer").alias("class"))
        jump = labels.select(F.col("id").alias("class"), F.col("class").alias("next"))
        moved = stage(lower.join(jump, "class", "left").select("id", "old", F.least(F.col("class"), F.coalesce("next", "class")).alias("class")))
        labels = moved.select("id", "class")
        if moved.filter("old <> class").isEmpty():
            return labels

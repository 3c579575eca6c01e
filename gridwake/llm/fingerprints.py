"""Document fingerprints by one-permutation MinHash.

Each shingle of five words is hashed once; the top seven bits of the hash name one of 128 bins and
a bin keeps its least hash. An empty bin copies the filled bin that comes first in its own random
order of the bins (optimal densification: each filled bin is equally likely, and independently of
the other empty bins). Of every bin the four lowest bits are stored, 512 bits in all. Two
unrelated bins agree in four bits with chance 1/16, which the estimate takes off again.

Everything is a column expression over one row; no shuffle is needed to fingerprint.

Cases: a null text is the empty text; texts of one to four words have one shingle; a text without
words has the empty fingerprint, which is like (1.0) another empty one and unlike (0.0) any other;
texts with equal words have equal fingerprints. `with_next` puts null ids last, gives repeated ids
one successor (the least text of the next id) and a single document itself; other columns of its
input are dropped.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64

from gridwake.llm.words import let, split_words, upto
from gridwake.plans.ordered import value_cuts, with_range_chunk

SHINGLE = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW_BITS = 4
#: Donors tried one after the other before all filled bins are ranked; a shortcut with the same result.
PROBES = 6


def _order(empty: int, bin_: int) -> int:
    """The engine's `xxhash64(empty, bin)` as a signed number."""
    seed = 42
    for value in (empty, bin_):
        seed = xxh64(struct.pack("<q", value), seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def donors() -> list[int]:
    """The first `PROBES` bins in the order of each bin, one row after the other."""
    return [b for j in range(BINS) for b in sorted(range(BINS), key=lambda b: _order(j, b))[:PROBES]]


def shingles(text: Column) -> Column:
    """One hash per window of five words, or per shorter text that has a word."""

    def windows(h: Column) -> Column:
        places = F.when(F.size(h) > 0, upto(F.greatest(F.size(h) - (SHINGLE - 1), F.lit(1)))).otherwise(upto(F.lit(0)))
        return F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]))

    return let(F.transform(split_words(text), lambda w: F.xxhash64(w)), windows)


def _bin(h: Column) -> Column:
    return F.shiftright(h, 64 - BIN_BITS) + F.lit(BINS // 2).cast("long")


def _packed(values: Column) -> Column:
    """Words of sixteen four-bit values each, from the densified bins."""
    zero, each = F.lit(0).cast("long"), 64 // LOW_BITS

    def word(q: int) -> Column:
        part = F.slice(values, q * each + 1, each)
        return F.aggregate(part, zero, lambda acc, x: F.shiftleft(acc, LOW_BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << LOW_BITS) - 1))))

    return F.array(*[word(q) for q in range(BINS // each)])


def fingerprint(text: Column) -> Column:
    """Eight packed words; null for a text without words."""
    probes = F.lit(donors())

    def least(ordered: Column) -> Column:
        return F.filter(ordered, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(ordered, i - 1))))

    def place(found: Column) -> Column:
        return let(F.transform(found, _bin), lambda bins: F.transform(upto(F.lit(BINS)), lambda j: F.get(found, F.array_position(bins, j.cast("long")).cast("int") - 1)))

    def dense(found: Column, slots: Column) -> Column:
        def ranked(j: Column) -> Column:
            return F.array_min(F.transform(found, lambda h: F.struct(F.xxhash64(j.cast("long"), _bin(h)).alias("o"), h.alias("h"))))["h"]

        return F.transform(slots, lambda h, j: F.coalesce(h, *[F.get(slots, F.get(probes, j * PROBES + t)) for t in range(PROBES)], ranked(j)))

    def of(hashes: Column) -> Column:
        packed = let(least_of(hashes), lambda found: let(place(found), lambda slots: let(dense(found, slots), _packed)))
        return F.when(F.size(hashes) > 0, packed)

    def least_of(hashes: Column) -> Column:
        return let(F.sort_array(hashes), least)

    return let(shingles(F.coalesce(text, F.lit(""))), of)


def as_text(packed: Column) -> Column:
    """Hexadecimal form; '' for a text without words."""
    return F.coalesce(F.array_join(F.transform(packed, lambda w: F.lpad(F.hex(w), 16, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1."""
    low = F.lit(0x1111111111111111)

    def differing(q: int) -> Column:
        x = F.get(a, F.lit(q)).bitwiseXOR(F.get(b, F.lit(q)))
        folded = x
        for k in range(1, LOW_BITS):
            folded = folded.bitwiseOR(F.shiftright(x, k))
        return F.bit_count(folded.bitwiseAND(low))

    wrong = sum((differing(q) for q in range(1, BINS * LOW_BITS // 64)), differing(0))
    chance = 1.0 / (1 << LOW_BITS)
    estimate = F.greatest(F.lit(0.0), ((BINS - wrong) / F.lit(float(BINS)) - chance) / (1.0 - chance))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(estimate)


def neighbours(docs: DataFrame, cuts: list[float] | None = None) -> DataFrame:
    """`id, n, prev, prev_n` per distinct id: the id before it and the longest text there; the first follows the last.

    Only ids and lengths are ordered, in ranges of ids; one row per range goes through one task.
    """
    sizes = docs.groupBy("id").agg(F.max(F.length("text")).alias("n"))
    placed = with_range_chunk(sizes, "id", value_cuts(docs, "id") if cuts is None else cuts)
    placed = placed.withColumn("_chunk", F.coalesce("_chunk", F.lit(float("inf"))))
    own = F.struct("id", "n")
    in_order = [F.col("id").asc_nulls_last()]
    inside = Window.partitionBy("_chunk").orderBy(*in_order)
    ends = placed.groupBy("_chunk").agg(F.max_by(own, F.coalesce(F.col("id"), F.lit((1 << 63) - 1))).alias("last"))
    over = Window.orderBy("_chunk")
    ends = ends.select("_chunk", F.coalesce(F.lag("last").over(over), F.last("last").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    local = placed.select("*", F.lag(own).over(inside).alias("own"))
    return local.join(ends, "_chunk").select("id", F.coalesce("own", "before").alias("p")).select("id", F.col("p.id").alias("prev"), F.col("p.n").alias("prev_n"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`id, text, packed, next_text, next_packed`: each row with what the next document offers.

    `next_text` is cut to a quarter of the longest text of the id, all that an edit needs, so a
    document crosses the network once whole and once in part.
    """
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    known = slim.withColumn("packed", fingerprint(F.col("text")))
    order = neighbours(slim)
    here = known.alias("d").join(order.alias("o"), F.col("d.id").eqNullSafe(F.col("o.id"))).select("d.*", "o.prev", "o.prev_n")
    offered = here.groupBy(F.col("prev").alias("id")).agg(
        F.min(F.struct(F.substring("text", F.lit(1), F.floor(F.col("prev_n") / 4).cast("int")).alias("next_text"), F.col("packed").alias("next_packed"))).alias("next")
    )
    left = here.select("id", "text", "packed").alias("a")
    return left.join(offered.alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")), "left").select("a.*", "b.next.*")


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last quarter (rounded down) replaced by the first as many code points of the next."""
    n = F.length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(next_text, F.lit(1), quarter))

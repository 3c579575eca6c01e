"""Near-duplicate documents by consistent weighted sampling.

A text is its multiset of shingles of five words, weighted by term frequency times inverse
document frequency. Document frequencies of all texts are counted in `2 ** DF_BITS` hashed cells
(each shingle's count is its cell's, less the mean cell), so the table has a fixed size; the
inverse frequency runs from 1 (every text) to 1.25 (one text) in 16 steps: a wider range would let
the few edits of a much copied text outweigh what its copies share. Improved consistent weighted
sampling draws 168 samples per text; their variates are looked up in a table of 65,536 draws by
shingle hash and sample number. 24 bands of seven samples make buckets: of pairs at 0.8 all but
0.4 % share one, at 0.5 one in six. A pair that shares a bucket is kept if its weighted Jaccard
similarity, from the whole multisets, is at least 0.8; classes are the connected components.

Exact copies (equal multisets) are one candidate. Nothing is capped: see `pivots` for large
buckets.

Cases: null and blank texts have no shingle and are copies of each other; texts of one to four
words have one shingle; repeated rows are copies; a class is named by its least id, null ids
count as the least and give a null name only if all are null; an empty table gives an empty
result; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwake.llm.bitmaps import id_bitmap, in_bitmap
from gridwake.llm.pivots import bucket_links, components
from gridwake.llm.shingling import mix, shingle_blocks
from gridwake.session import stage

SIMILARITY = 0.8
BANDS, ROWS = 24, 7
DF_BITS = 18
STEPS = 15
#: Weight of a shingle of one text, relative to one that every text has, less one.
SPAN = 0.25
#: `1 / SPAN * STEPS`: the weight of a shingle is `(UNIT + step) / UNIT`.
UNIT = 60
#: Sketches tell shingles from this step on from more common ones; 64-bit numbers for each of the two.
RARE = 8
COMMON, SELDOM = 4, 16
_DRAWS = 1 << 16
_SLICE = 2048


def cell_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Texts per hashed cell; the table's size is fixed by `DF_BITS`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << DF_BITS, np.int64)
        for batch in batches:
            for block in shingle_blocks(batch.column(0)):
                for grams in block:
                    if len(grams):
                        np.add.at(cells, (np.unique(grams) >> np.uint64(64 - DF_BITS)).astype(np.int64), 1)
        used = np.flatnonzero(cells)
        for k in range(0, len(used), 65_536):
            part = used[k : k + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(cells[part])], ["cell", "n"])

    got = docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cells = np.zeros(1 << DF_BITS, np.int64)
    cells[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return cells


def steps_of(cells: np.ndarray, n_docs: int) -> np.ndarray:
    """Inverse document frequency of each cell as 0 .. `STEPS`; the weight is `1 + SPAN * step / STEPS`."""
    df = np.clip(cells - cells.mean(), 1.0, max(1, n_docs))
    scaled = np.log1p(n_docs / df) / np.log1p(max(1, n_docs))
    return np.clip(np.rint(scaled * STEPS), 0, STEPS).astype(np.uint8)


class Sampler:
    """Consistent weighted samples from tables of fixed size."""

    def __init__(self, samples: int = BANDS * ROWS):
        draw = np.random.Generator(np.random.PCG64(20_240_229))
        self.r = draw.gamma(2.0, 1.0, _DRAWS)
        self.ln_c = np.log(draw.gamma(2.0, 1.0, _DRAWS))
        self.beta = draw.random(_DRAWS)
        self.odd = mix(np.arange(7_001, 7_001 + samples, dtype=np.uint64)) | np.uint64(1)
        self.single = np.concatenate([self.ln_a(np.arange(_DRAWS), np.full(_DRAWS, 1 + SPAN * s / STEPS)) for s in range(STEPS + 1)]).astype(np.float32)

    def level(self, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return np.floor(np.log(weight) / self.r[at] + self.beta[at])

    def ln_a(self, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        r = self.r[at]
        return self.ln_c[at] - r * (self.level(at, weight) - self.beta[at]) - r

    def samples(self, grams: np.ndarray, tf: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """One hash per sample of (shingle, level) of the least draw."""
        k = len(self.odd)
        best, who = np.full(k, np.inf, np.float32), np.zeros(k, np.int64)
        for b in range(0, len(grams), _SLICE):
            g, f, s = grams[b : b + _SLICE], tf[b : b + _SLICE], steps[b : b + _SLICE]
            at = ((self.odd[:, None] * g[None, :]) >> np.uint64(48)).astype(np.int64)
            value = self.single[at + (s.astype(np.int64) * _DRAWS)[None, :]]
            many = np.flatnonzero(f > 1)
            if len(many):
                value[:, many] = self.ln_a(at[:, many], (f[many] * (1 + SPAN * s[many] / STEPS))[None, :])
            least = value.argmin(axis=1)
            low = value[np.arange(k), least]
            better = low < best
            best[better], who[better] = low[better], b + least[better]
        at = ((self.odd * grams[who]) >> np.uint64(48)).astype(np.int64)
        level = self.level(at, tf[who] * (1 + SPAN * steps[who] / STEPS)).astype(np.int64).astype(np.uint64)
        return mix(grams[who] ^ (level * np.uint64(0x9E3779B97F4A7C15)))


def band_keys(samples: np.ndarray) -> np.ndarray:
    keys = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for column in samples.reshape(BANDS, ROWS).T:
        keys = mix(keys + column)
    return keys.view(np.int64)


_SIGNED = "uid long, id long, text_key long, hi long, lo long, bands array<long>, grams binary"


def signatures(docs: DataFrame, shared, id_col: str, text: str) -> DataFrame:
    """Per row: digest of the multiset, band keys, and the multiset as sorted 32-bit hashes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps_by_cell, sampler = shared.value, Sampler()
        for batch in batches:
            done = 0
            for block in shingle_blocks(batch.column(3)):
                hi, lo, bands, sets = [], [], [], []
                for grams in block:
                    u, tf = np.unique(grams, return_counts=True)
                    digest = np.frombuffer(hashlib.blake2b(u.tobytes() + tf.tobytes(), digest_size=16).digest(), np.int64)
                    hi.append(digest[0])
                    lo.append(digest[1])
                    if len(u):
                        s = steps_by_cell[(u >> np.uint64(64 - DF_BITS)).astype(np.int64)]
                        bands.append(band_keys(sampler.samples(u, tf, s)))
                    else:
                        bands.append(np.zeros(0, np.int64))
                    sets.append(np.repeat((u >> np.uint64(32)).astype("<u4"), tf).tobytes())
                at = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(bands)))
                rows = batch.slice(done, len(block))
                done += len(block)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), rows.column(2), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), lists, pa.array(sets, pa.binary())],
                    ["uid", "id", "text_key", "hi", "lo", "bands", "grams"],
                )

    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(f"`{text}`").alias("text_key"), F.col(f"`{text}`").alias("t")
    )
    return rows.mapInArrow(sign, _SIGNED)


def weighted_jaccard(a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> float:
    """Of two sorted multisets of 32-bit hashes; `weights` by the hashes' leading `DF_BITS` bits."""
    (u, f), (v, g) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    cell = lambda x: (x >> (32 - DF_BITS)).astype(np.int64)
    both = float((np.minimum(f[i], g[j]) * weights[cell(u[i])]).sum())
    total = float((f * weights[cell(u)]).sum() + (g * weights[cell(v)]).sum()) - both
    return both / total if total else 1.0


def bit_sketch(grams: np.ndarray, steps: np.ndarray) -> list[int]:
    """Of a multiset of 32-bit hashes: its weight in units of `SPAN / STEPS` (whole numbers), and which bits its common and its rare shingles fall on."""
    step = steps[(grams >> (32 - DF_BITS)).astype(np.int64)]
    out = [int(UNIT * len(grams) + step.sum(dtype=np.int64))]
    for size, part in ((COMMON, grams[step < RARE]), (SELDOM, grams[step >= RARE])):
        bits = np.zeros(64 * size, np.uint8)
        bits[part & np.uint32(64 * size - 1)] = 1
        out += np.packbits(bits, bitorder="little").view("<i8").tolist()
    return out


def may_reach(similarity: float):
    """A condition that pairs of at least this weighted similarity meet.

    Of such a pair the weights of what stands on one side only add up to at most
    `(1 - similarity) / (1 + similarity)` of both weights. Each bit set on one side only stands for
    at least one such shingle, which weighs no less than the lightest of its half of the sketch.
    """
    share = (1 - similarity) / (1 + similarity) + 1e-9

    def screen(a: Column, b: Column) -> Column:
        each = [F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(1, 1 + COMMON + SELDOM)]
        common, seldom = sum(each[1:COMMON], each[0]), sum(each[COMMON + 1 :], each[COMMON])
        return common * UNIT + seldom * (UNIT + RARE) <= (F.get(a, F.lit(0)) + F.get(b, F.lit(0))) * share

    return screen


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """`id, text_key, class_id, kept` per row: the least id of its class; the one row of a class that stays."""
    spark = docs.sparkSession
    cells = cell_counts(docs, text)
    shared = spark.sparkContext.broadcast(steps_of(cells, docs.count()))  # 2 ** DF_BITS bytes
    signed = stage(signatures(docs, shared, id_col, text))
    reps = signed.groupBy("hi", "lo").agg(F.min("uid").alias("rep"))
    chosen = stage(signed.select("uid", "bands").join(reps.select(F.col("rep").alias("uid")), "uid", "left_semi"))
    members = chosen.select(F.explode("bands").alias("bucket"), F.col("uid").alias("id"))

    def payload(ids: DataFrame) -> DataFrame:
        """Multisets and sketches of the texts that share a bucket, and of the few whose bit is set besides; the large table stays where it is."""
        bits = spark.sparkContext.broadcast(id_bitmap(ids.select(F.xxhash64("id").alias("id"))))

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                met = batch.filter(pa.array(in_bitmap(bits.value, batch.column(2).to_numpy())))
                if len(met):
                    sketches = [bit_sketch(np.frombuffer(data, "<u4"), shared.value) for data in met.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([met.column(0), met.column(1), pa.array(sketches, pa.list_(pa.int64()))], ["id", "data", "sketch"])

        rows = signed.select(F.col("uid").alias("id"), F.col("grams").alias("data"), F.xxhash64("uid").alias("hash"))
        return stage(rows.mapInArrow(pick, "id long, data binary, sketch array<long>"))

    @F.pandas_udf("double")
    def distance(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        weights = 1 + SPAN * shared.value / STEPS
        for xs, ys in batches:
            yield pd.Series([1 - weighted_jaccard(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), weights) for x, y in zip(xs, ys)], dtype=float)

    links = stage(bucket_links(members, payload, distance, 1 - similarity + 1e-12, by_class=True, screen=may_reach(similarity)))
    joined = components(links).withColumnRenamed("class", "top")
    # rows -> their representative -> its class; copies of one text count in the reduction before the join
    by_text = reps.join(joined.select(F.col("id").alias("rep"), "top"), "rep", "left").select("hi", "lo", F.coalesce("top", "rep").alias("top"))
    rows = signed.select("uid", "id", "text_key", "hi", "lo").join(by_text, ["hi", "lo"]).select("uid", "id", "text_key", "top")
    names = rows.groupBy("top").agg(F.min("id").alias("class_id"), F.min(F.struct(F.coalesce("id", F.lit(-(1 << 63))), "uid")).alias("first"))
    return rows.join(names.select("top", "class_id", F.col("first.uid").alias("keep")), "top").select("id", "text_key", "class_id", (F.col("uid") == F.col("keep")).alias("kept"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` that stay: one of each class."""
    stay = classes(docs, id_col, text, similarity).filter("kept").select(F.col("id").alias("__id"), F.col("text_key").alias("__key"))
    rows = docs.withColumn("__key", F.xxhash64(f"`{text}`"))
    kept = rows.alias("d").join(stay.alias("s"), F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("s.__id")) & (F.col("d.__key") == F.col("s.__key")), "left_semi")
    return kept.dropDuplicates([id_col, "__key"]).drop("__key")

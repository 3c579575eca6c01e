"""Budgets against a plain water-filling, and odd rows."""

import random

from pyspark.sql import functions as F

from gridwake.llm import mixing


def fill(b, children):
    """children: [(name, weight, cap)] -> {name: share}; exact shares before rounding."""
    open_, out = list(children), {}
    while open_:
        total = sum(w for _, w, _ in open_)
        full = [c for c in open_ if c[2] * total <= c[1] * b]
        if not full:
            return out | {n: b * w / total for n, w, _ in open_}
        n, _, cap = min(full, key=lambda c: (c[2] / c[1], c[0]))
        out[n] = cap
        b -= cap
        open_ = [c for c in open_ if c[0] != n]
    return out


def test_shares(spark):
    draw = random.Random(3)
    rows, want = [], {}
    for p in range(60):
        kids = [(f"k{j}", draw.randint(1, 9), draw.randint(0, 500)) for j in range(draw.randint(1, 8))]
        b = draw.randint(0, sum(c for _, _, c in kids))
        rows += [(p, n, w, c, b) for n, w, c in kids]
        want |= {(p, n): v for n, v in fill(b, kids).items()}
    df = spark.createDataFrame(rows, "p int, n string, w long, cap long, b long")
    got = {(r.p, r.n): r for r in mixing.share_out(df, ["p"], "n").collect()}
    for key, v in want.items():
        assert abs(got[key].budget - v) < 1 + 1e-9 and got[key].budget <= got[key].cap, key
    for p in range(60):
        assert sum(r.budget for k, r in got.items() if k[0] == p) == next(r[4] for r in rows if r[0] == p)


def test_prefix_epochs_and_odd_rows(spark):
    rows = [(k, "w " * (k % 7 + 1), "en" if k % 3 else None, f"src{k % 5}", "x") for k in range(400)]
    rows += [(None, None, "en", None, "x"), (7, "", "en", "src1", "x"), (7, "", "en", "src1", "x"), (9, "long " * 60_000, "fr", "src2", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, copies string")
    counts = mixing.token_counts(df, mixing.corpus_levels())
    taken = mixing.copies(counts, mixing.corpus_weights()).collect()
    assert len(taken) == len(rows)
    leaves = mixing.budgets(counts, mixing.corpus_weights(), (4, 5), 2).collect()
    total = sum(r.tokens for r in taken)
    assert sum(r.budget for r in leaves) == total * 4 // 5
    for leaf in leaves:
        mine = [r for r in taken if (r.domain, r.lang, r.source) == (leaf.domain, leaf.lang, leaf.source)]
        used = sum(r.tokens * r.copies for r in mine)
        longest = max((r.tokens for r in mine), default=0)
        assert used <= leaf.budget and leaf.budget - used <= 2 * longest
        assert max(r.copies for r in mine) - min(r.copies for r in mine) <= 1
    mixed = mixing.mix(df, mixing.corpus_levels(), mixing.corpus_weights())
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r.copies for r in taken)
    assert mixing.mix(df.limit(0), mixing.corpus_levels(), mixing.corpus_weights()).count() == 0
    again = mixing.mix(df, mixing.corpus_levels(), mixing.corpus_weights(), share=(1, 1), max_epochs=1)
    assert again.filter("doc_id is not null and text <> ''").count() == 401

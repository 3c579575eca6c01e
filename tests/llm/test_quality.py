"""Signals and limits of the quality rules on small fixtures; the query itself has SQL."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from gridwake.llm import quality


def signals(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = Counter(zip(words, words[1:], words[2:]))
    again = {k + j for k in range(len(words) - 2) if wins[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_signals(spark):
    draw = random.Random(9)
    texts = [None, "", " \n\t", "a a a a", "a b a b a b", "x\n x\nx\n\nx", "é 日本 # $%\u0085 z", "\x0b\x0c\r", "a " * 30_000]
    texts += ["".join(draw.choice(["a", "b", " ", "\n", "#", "é"]) for _ in range(draw.randint(0, 120))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s")).withColumn("kept", F.lit("x"))
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == signals(t), repr(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and (r.kept is False or not r.base_failed)


def test_limits_follow_their_group_and_merge(spark):
    draw = random.Random(2)
    word = lambda n: "".join(draw.choice("abcdefgh") for _ in range(n))
    text = lambda n, k: " ".join(word(n) for _ in range(k))
    rows = [(k, text(4, 60), "en", "a") for k in range(300)] + [(1000 + k, text(12, 60), "de", "b") for k in range(300)]
    rows += [(2000, text(12, 60), "en", "a"), (2001, text(4, 60), "de", "b"), (2002, text(4, 60), "en", "tiny"), (2003, text(12, 60), "en", "tiny"), (2004, text(4, 60) + " |" * 30, "en", "a")]
    rows += [rows[0], (None, text(4, 60), None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = quality.judge(df).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[k] for k in range(300)) and all(kept[1000 + k] for k in range(300))
    assert (kept[2000], kept[2001], kept[2002], kept[2003], kept[2004]) == (False, False, True, False, False)
    fine = quality.sketches(quality.signals(df, [F.col("lang"), F.col("source")]), ["lang", "source"])
    whole = quality.sketches(quality.signals(df, [F.col("lang")]), ["lang"])
    assert sorted(map(str, quality.merge(fine, ["lang"]).collect())) == sorted(map(str, whole.collect()))
    assert quality.judge(df.limit(0)).count() == 0


def test_bucket_error(spark):
    df = spark.range(0, 200_000, 37).select("id", quality.bucket(F.col("id")).alias("b"))
    assert df.filter("b > id OR (id - b) * 32 > id").count() == 0
    assert df.select("b").distinct().count() < 32 * 18

"""Alignment against byte sets, and link counts against plain dictionaries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from public_tokenizers import path
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from gridwake.llm import alignment
from gridwake.llm.queries import LLM_QUERIES

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")


def test_gallop():
    draw = random.Random(2)
    for _ in range(500):
        n = draw.randint(1, 300)
        short = sorted({*draw.sample(range(1, 400), draw.randint(0, 30)), 400})
        long = sorted({*draw.sample(range(1, 400), n), 400})
        assert alignment.gallop(short, long) == [next(k for k, y in enumerate(long) if y >= x) for x in short]


def test_both_encoders_of_a_agree():
    """Around every code point, and in texts that only the slower one takes."""
    pair = alignment.Pair(open(A, encoding="utf-8").read(), open(B, "rb").read())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f" a{c}1{c} {c}\n{c}'s  {c}b" for c in points[:0x3100] + points[0x3100::23]]
    texts += [" " * n + "a" for n in (1, 1999, 2000, 100_000)] + ["\n \t" * 50_000, "a" * 20_000, "<|endoftext|>" * 9]
    coded = pair.a.encode_batch_fast(texts, add_special_tokens=False)
    assert [pair._a_ids(t) for t in texts] == [c.ids for c in coded]


def plain(texts):
    """Rows by comparing every A token with every B token of its neighbourhood, bytes by bytes."""
    a_lib, b_lib = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    from tokenizers.decoders import ByteLevel

    def a_bytes(i):
        from gridwake.llm.bpe import byte_alphabet

        if i == 50256:
            return b"<|endoftext|>"
        return bytes(byte_alphabet()[c] for c in a_lib.id_to_token(i))

    assert ByteLevel  # the library's own decoder would replace broken characters
    known: dict[int, bytes] = {}
    rows = []
    for text in texts:
        led = (" " + (text or "")).encode()
        a = a_lib.encode(led.decode(), add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        left = [known.setdefault(i, a_bytes(i)) if i not in known else known[i] for i in a]
        right = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_lib.id_to_piece(i)]]
        if not text or b"".join(left) != led or b"".join(right) != led:
            rows.append(([], [], [], []))
            continue
        owner = [k for k, x in enumerate(right) for _ in x]
        links, at = [], 0
        for k, x in enumerate(left):
            links += [(k, m) for m in sorted(set(owner[at : at + len(x)]))]
            at += len(x)
        ends = [set(np.cumsum([len(x) for x in side]).tolist()) for side in (left, right)]
        common = sorted(ends[0] & ends[1])
        groups, i, j, p, q = [], 0, 0, 0, 0
        for end in common:
            s, t = i, j
            while p < end:
                p, i = p + len(left[i]), i + 1
            while q < end:
                q, j = q + len(right[j]), j + 1
            groups.append(",".join(map(str, a[s:i])) + "|" + ",".join(map(str, b[t:j])))
        rows.append((a, b, groups, [(a[k], b[m]) for k, m in links]))
    held, highest = Counter(), defaultdict(int)
    for *_, links in rows:
        held.update(set(links))
    for (i, _), n in held.items():
        highest[i] = max(highest[i], n)
    return [
        (len(a), len(b), len(g), len(x), sum(held[p] == highest[p[0]] for p in x), sum(held[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
        for a, b, g, x in rows
    ]


def shown(df):
    from pyspark.sql import functions as F

    hashed = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return {r[0]: tuple(r)[1:] for r in df.select("k", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", hashed).collect()}


def test_cases(spark):
    texts = [
        "the cat sat", None, "", " ", "  two  spaces ", "a▁b", "<|endoftext|> and </s> <s> <unk> <0x41>", "naïve café 日本語 🎉‍", "x\ty\nz\r\n", "the cat sat",
        "a" * 5000, "word " * 8000, " 　 odd", "ﬁ ligature Å", "0123456789 " * 40, "\x00 nul", "don't we'll",
    ]
    draw = random.Random(4)
    texts += ["".join(draw.choice("ab cé▁日\n.,0T") for _ in range(draw.randint(0, 60))) for _ in range(120)]
    df = spark.createDataFrame([(k, t, "n", 7) for k, t in enumerate(texts)], "k long, text string, n_a string, count_sum int").repartition(5)
    want = dict(enumerate(plain(texts)))
    aligned = alignment.align(df, A, B)
    assert shown(alignment.score_links(aligned)) == want
    assert shown(alignment.score_links(aligned, limit=50)) == want  # many chunks
    assert alignment.score_links(alignment.align(df.limit(0), A, B)).count() == 0


def test_query(spark):
    """The registered query over a whole table."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: x for r, x in zip(docs, plain([r.text for r in docs]), strict=True)}
    got = LLM_QUERIES["op13_alignment"](spark, folder)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got.collect()} == want

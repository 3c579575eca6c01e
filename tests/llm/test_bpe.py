"""The automaton against the tokenizers library."""

import random

import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from gridwake.llm import bpe

NAME = path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(NAME)


@pytest.fixture(scope="module")
def codec():
    return bpe._codec(open(NAME, encoding="utf-8").read())


def _ids(blob):
    return [int.from_bytes(blob[k : k + 4], "little") for k in range(0, len(blob), 4)]


def test_random_texts(lib, codec):
    draw = random.Random(5)
    kinds = ["ab", "abcdefgh ", "the and ing ou \n", "aA1'sé ßñ\t\n  ", "日本語 🎉́​ x", "0123456789 .", "!?#$% ", "'s't're", "   a\u0085b\x1c\x1d"]
    for _ in range(6000):
        text = "".join(draw.choice(draw.choice(kinds)) for _ in range(draw.randint(0, 40)))
        blob = codec[0](text)
        want = lib.encode(text, add_special_tokens=False).ids
        assert _ids(blob) == want, text
        assert codec[1](blob) == lib.decode(want, skip_special_tokens=False)


def test_special_and_repeats(lib, codec):
    for text in ["<|endoftext|>", "a<|endoftext|>b  <|endoftext|><|endoftext|> c", "a" * 3000, " " * 500, "ab" * 999, "<|endoftext"]:
        assert _ids(codec[0](text)) == lib.encode(text, add_special_tokens=False).ids


def test_every_code_point_splits_alike(lib):
    """Around each code point the pattern cuts where the library's pre-tokenizer cuts."""
    words, later, strict = bpe._patterns()
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    wrong = []
    for c in points[: 0x3100] + points[0x3100 :: 97]:
        text = f"a{c}1{c} {c}"
        want = [text[b:e] for _, (b, e) in lib.pre_tokenizer.pre_tokenize_str(text)]
        if (strict if later.search(text) else words).findall(text) != want:
            wrong.append(c)
    assert not wrong, (len(wrong), [hex(ord(c)) for c in wrong[:20]])


def test_frames(spark, lib):
    rows = [(1, "the cat", "x"), (2, None, "x"), (3, "", None), (1, "the cat", "x"), (4, "word " * 20000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = {r.doc_id: r for r in bpe.round_trip(df, NAME).collect()}
    assert _ids(bytes(out[1].ids)) == lib.encode("the cat", add_special_tokens=False).ids
    assert bytes(out[2].ids) == b"" and out[3].decoded == ""
    assert out[4].decoded == "word " * 20000
    assert bpe.round_trip(df.limit(0), NAME).count() == 0
    two = bpe.decode(bpe.encode(df, NAME), NAME).orderBy("doc_id").collect()
    assert [r.decoded for r in two] == ["the cat", "the cat", "", "", "word " * 20000]

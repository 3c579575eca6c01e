"""Surrogates: nothing private stays, entities stay apart and together, clean texts stay."""

import re

from pyspark.sql import functions as F

from gridwake.llm import surrogates
from gridwake.llm.queries import LLM_QUERIES

PATH = "/root/testdata/sf0.01"
PRIVATE = re.compile(r"[^\s@]+@[^\s@]+\.example\.com|\+1 \(\d{3}\) \d{3}-\d{4}|(?<!\d)\d{16}(?!\d)|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])|[0-9a-fA-F]{40}", re.I)


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{PATH}/documents.parquet").collect()}
    got = {r.doc_id: r for r in LLM_QUERIES["op1_surrogates"](spark, PATH).collect()}
    assert got.keys() == docs.keys()
    pairs, back, seen = {}, {}, 0
    for i, text in docs.items():
        old, new = PRIVATE.findall(text), PRIVATE.findall(got[i].text)
        assert len(old) == len(new) == got[i].n_replaced, i
        assert PRIVATE.split(text) == PRIVATE.split(got[i].text)
        for a, b in zip(old, new):
            seen += 1
            assert a not in got[i].text
            assert re.sub(r"\d", "9", re.sub(r"[^\W\d_]", "a", a.split("@")[0])) == re.sub(r"\d", "9", re.sub(r"[^\W\d_]", "a", b.split("@")[0])) or "." in a or len(a) == 40 == len(b)
            assert pairs.setdefault(a.lower(), b.lower()) == b.lower()  # coreference
            assert back.setdefault(b.lower(), a.lower()) == a.lower()  # distinctness
    assert seen > 50


def _one(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r.text for r in surrogates.replace(df, "k").orderBy("doc_id").collect()]


def test_names_gender_script_and_form(spark):
    a, b, c, d, e = _one(
        spark, "Ask Mrs. Mary Smith or Mr. Smith; JOHN SMITH left. Call (212) 555-0147, that is +1 212-555-0147.", "Frau Sabine Weber and Dr. Weber", "Господин Иванов и Анна Петрова",
        "pay 4111 1111 1111 1111 or 4111-1111-1111-1111, SSN 078-05-1120, DE89 3704 0044 0532 0130 00", "version 2.0.1 of 1234 items in 2024-01-05, x@y, MARY had 10.5 km",
    )
    m = re.fullmatch(r"Ask Mrs\. (\S+) (\S+) or Mr\. (\S+); (\S+) (\S+) left\. Call \((\d{3})\) (\d{3})-(\d{4}), that is \+1 (\d{3})-(\d{3})-(\d{4})\.", a)
    assert m and m[2] == m[3] and m[2].upper() == m[5] and m[2] != "Smith" and m.groups()[5:8] == m.groups()[8:] != ("212", "555", "0147")
    assert m[1] in surrogates.FIRST["latin"]["f"] and m[4].title() in surrogates.FIRST["latin"]["m"] and m[1] != "Mary"
    m = re.fullmatch(r"Frau (\S+) (\S+) and Dr\. (\S+)", b)
    assert m[1] in surrogates.FIRST["latin"]["f"] and m[2] == m[3] != "Weber"
    m = re.fullmatch(r"Господин (\S+)ов и (\S+) (\S+)ова", c)
    assert m and m[2] in surrogates.FIRST["cyrillic"]["f"]
    m = re.fullmatch(r"pay (\d{4} \d{4} \d{4} \d{4}) or (\d{4}-\d{4}-\d{4}-\d{4}), SSN (\d{3}-\d{2}-\d{4}), (DE\d\d(?: \w{4}){4} \w\w)", d)
    digits = m[1].replace(" ", "")
    assert digits == m[2].replace("-", "") and digits[0] == "4"
    assert sum(int(x) if k % 2 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(digits)) % 10 == 0
    assert e == "version 2.0.1 of 1234 items in 2024-01-05, x@y, MARY had 10.5 km"


def test_collisions_are_settled(spark):
    names = spark.createDataFrame([("first_f", n.lower()) for n in surrogates.FIRST["latin"]["f"]] + [("first_f", f"x{k}") for k in range(300)] + [("email", f"{a}@b.com") for a in "abcdefghij"], "type string, norm string")
    rows = surrogates.mapping(names.union(names), "k").collect()
    assert len(rows) == len({(r.type, r.surrogate) for r in rows}) == 342
    assert not {(r.type, r.surrogate) for r in rows} & {(r.type, r.norm) for r in rows}


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a.b@c.org", "x"), (3, "a.b@c.org", "x"), (None, "A.B@C.org", None), (4, "1.2.3.4 " * 5_000 + "end", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string").withColumn("n_replaced", F.lit("old"))
    got = surrogates.replace(df, "k").collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].text is None and by[2].text == "" and by[4].n_replaced == 5_000 and by[4].text.endswith(" end") and "1.2.3.4 " not in by[4].text
    assert by[3].text == by[None].text.lower() != "a.b@c.org"
    assert surrogates.replace(df.limit(0), "k").count() == 0

"""The histogram against plain counting."""

from collections import defaultdict

from public_tokenizers import path
from tokenizers import Tokenizer

from gridwake.llm import lengths
from gridwake.llm.queries import LLM_QUERIES

PATH = "/root/testdata/sf0.001"


def test_query_against_brute_force(spark):
    lib = Tokenizer.from_file(path("byte_bpe_50k.json"))
    sizes = defaultdict(list)
    for r in spark.read.parquet(f"{PATH}/documents.parquet").select("source", "text").collect():
        n = len(lib.encode(r.text or "", add_special_tokens=False).ids)
        sizes["source", r.source].append(n)
        sizes["all", None].append(n)
    got = LLM_QUERIES["op8_token_counts"](spark, PATH).collect()
    assert len(got) == sum(len(set(v)) for v in sizes.values())
    for r in got:
        v = sizes[r.scope, r.source]
        over = [x for x in v if x >= r.length]
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (v.count(r.length), len(over), sum(over))
        assert (r.rank, r.truncated_total) == (sum(x <= r.length for x in v), sum(min(x, r.length) for x in v))
        assert (r.total_docs, r.total_tokens) == (len(v), sum(v))


def test_limits_quantiles_and_edges(spark):
    v = [0, 0, 5, 1023, 1024, 1025, 5000, 5000, 70_000]
    df = spark.createDataFrame([(None if k % 2 else "g", n, "x") for k, n in enumerate(v)] + [("g", 3, "y")], "source string, n_tokens long, length string")
    table = lengths.suffix_sums(lengths.histogram(df, ["source"]), ["source"])
    for source in ("g", None):
        mine = [n for k, n in enumerate(v) if (None if k % 2 else "g") == source] + ([3] if source else [])
        rows = {r.context: r for r in lengths.at_limits(table, ["source"], [0, 4, 1024, 100_000]).collect() if r.source == source}
        for c, r in rows.items():
            assert (r.docs_cut, r.tokens_left, r.total_docs) == (sum(n > c for n in mine), sum(min(n, c) for n in mine), len(mine))
        q = next(r for r in lengths.quantile(table, ["source"], [(1, 2), (1, 1)]).collect() if r.source == source)
        assert (q.q1_2, q.q1_1) == (sorted(mine)[(len(mine) + 1) // 2 - 1], max(mine))
    assert lengths.suffix_sums(lengths.histogram(df.limit(0), ["source"]), ["source"]).count() == 0

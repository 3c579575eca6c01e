"""Ranges, hash trees, large JSON objects, versioned and bucketed tables."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from gridwake.queries import QUERIES
from gridwake.sources import annotations as A
from gridwake.sources import integrity as N
from gridwake.sources import tables as Tb


def tree(data, leaf, fan):
    nodes = [hashlib.sha256(data[k : k + leaf]).hexdigest() for k in range(0, max(1, len(data)), leaf)]
    while len(nodes) > 1:
        groups = [nodes[k : k + fan] for k in range(0, len(nodes), fan)]
        nodes = [hashlib.sha256("".join(g).encode()).hexdigest() for g in groups]
    return nodes[0]


def test_hash_tree(spark, tmp_path):
    draw = random.Random(1)
    for k, n in enumerate((1, 9, 10, 11, 95, 1000, 1001, 12_345)):
        (tmp_path / f"f{k}").write_bytes(draw.randbytes(n))
    want = {f.name: (f.stat().st_size, tree(f.read_bytes(), 10, 7)) for f in tmp_path.iterdir()}
    for parts in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        rows = N.hash_manifest(spark, [str(tmp_path)], leaf=10, fan=7).collect()
        assert {r.path.rpartition("/")[2]: (r["size"], r.sha256) for r in rows} == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    plain = {r.path.rpartition("/")[2]: r.sha256 for r in N.hash_manifest(spark, [str(tmp_path)]).collect()}
    assert plain == {f.name: hashlib.sha256(f.read_bytes()).hexdigest() for f in tmp_path.iterdir()}
    before = N.hash_manifest(spark, [str(tmp_path)], leaf=10, fan=7)
    before = spark.createDataFrame(before.collect(), before.schema)
    data = bytearray((tmp_path / "f7").read_bytes())
    data[6000] ^= 1
    (tmp_path / "f7").write_bytes(bytes(data))
    with pytest.raises(ValueError, match="f7"):
        N.assert_unchanged(before, N.hash_manifest(spark, [str(tmp_path)], leaf=10, fan=7))


def test_manifest_of_all_tables(spark):
    """The registered query against the files themselves."""
    folder = "/root/testdata/sf0.001"
    rows = {r.file: (r["size"], r.sha256) for r in QUERIES["a9_hash_manifest"](spark, folder).collect()}
    assert len(rows) == 14
    for name, (size, digest) in rows.items():
        data = open(f"{folder}/{name}", "rb").read()
        assert (size, digest) == (len(data), tree(data, N.LEAF, N.FAN))


def entries_of(spark, path, step):
    return sorted((r.run, json.loads(r.document)) for r in A.read_annotations(spark, str(path), step=step).collect())


def test_object_in_ranges(spark, tmp_path):
    draw = random.Random(7)
    odd = ["plain", 'quote " inside', "back\\slash", "brace } { [ ]", "comma, colon:", "ends with \\", "é日本🎉", "", "\\\"", "\n\t"]
    document = {f"run {k} {draw.choice(odd)}": {"annotations": [{"class": draw.choice(odd), "note": draw.choice(odd) * draw.randint(0, 9), "ranges": [[draw.choice(odd), [[1, 2]]]]}]} for k in range(60)}
    document["empty"] = {}
    (tmp_path / "one").write_text(json.dumps(document, ensure_ascii=False, indent=1), encoding="utf-8")
    (tmp_path / "two").write_text("  \n" + json.dumps({"b\\": [], "c": {"x": "}"}}, separators=(",", ":")))
    (tmp_path / "blank").write_text(" \n")
    (tmp_path / "none").write_text("{ }")
    want = sorted([*document.items(), ("b\\", []), ("c", {"x": "}"})])
    for step in (1, 7, 64, 1 << 20):
        assert entries_of(spark, tmp_path, step) == want


def test_many_runs_are_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "one").write_text(json.dumps({f"r{k}": {"annotations": [{"class": "c", "ranges": []}]} for k in range(100_000)}))
    rows = A.read_annotations(spark, str(tmp_path), step=1 << 16)
    out = rows.withColumn("part", F.spark_partition_id()).agg(F.count("*").alias("n"), F.countDistinct("part").alias("parts")).first()
    assert out.n == 100_000 and out.parts > 1


@pytest.mark.parametrize("text", ["[1]", '"x"', '{"a": {}', '{"a": "b', "{}}", '{"a": 1}]', "7"])
def test_no_object_fails(spark, tmp_path, text):
    (tmp_path / "x").write_text(text)
    for step in (2, 1 << 20):
        with pytest.raises(Exception, match="object|cut off|never opened"):
            A.read_annotations(spark, str(tmp_path), step=step).collect()


def test_versions(spark, tmp_path):
    path = f"{tmp_path}/t"
    old = spark.range(5).withColumn("x", F.lit(1))
    first = Tb.materialize_if_stale(old, path)
    opened = Tb.current_version(spark, path)
    assert Tb.materialize_if_stale(old, path, 5).inputFiles() == first.inputFiles()

    broken = spark.range(3).withColumn("x", F.raise_error(F.lit("no")).cast("int")).withColumn("y", F.lit(1))
    with pytest.raises(Exception, match="no"):
        Tb.materialize_if_stale(broken, path)
    assert Tb.current_version(spark, path) == opened and spark.read.parquet(opened).count() == 5

    wider = Tb.materialize_if_stale(old.withColumn("y", F.lit(2)), path)
    assert wider.columns == ["id", "x", "y"] and Tb.current_version(spark, path) != opened
    assert first.count() == 5  # a reader of the old version goes on
    more = Tb.materialize_if_stale(spark.range(9).withColumn("x", F.lit(1)).withColumn("y", F.lit(2)), path, 9)
    assert more.count() == 9
    assert len(Tb.prune_versions(spark, path, keep=0)) == 3
    assert Tb.materialize_if_stale(wider.limit(0), path).count() == 9  # same columns, no count asked for


def test_lost_version_is_stale(spark, tmp_path):
    path = f"{tmp_path}/t"
    Tb.materialize_if_stale(spark.range(5), path)
    Tb.publish_version(spark, path, "v-gone")
    assert Tb.materialize_if_stale(spark.range(5), path).count() == 5


def test_bucketed_join_has_no_exchange(spark):
    frame = QUERIES["a7_bucketed_join"](spark, "/root/testdata/sf0.001")
    assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()


def test_strict_subset(spark):
    assert N.is_strict_subset(spark.range(3), spark.range(4))
    assert not N.is_strict_subset(spark.range(4), spark.range(4)) and not N.is_strict_subset(spark.range(4), spark.range(3))

"""Stored tables that change: the index of contents, and tables changed in place by key."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from payrecon.sources import hash_index, keyed, manifest

DAY = datetime.datetime(2026, 1, 1)


def at(n):
    return DAY + datetime.timedelta(minutes=n)


def entries(spark, rows):
    return spark.createDataFrame(rows, "sha256 string, first_id string, first_at timestamp").coalesce(1)


def test_index_of_many_tiny_batches(spark, tmp_path):
    """The same answers as from a list of everything, while runs stay few; a batch that is run again sees the others only."""
    rng, path, seen = random.Random(1), str(tmp_path / "index"), {}
    for batch in range(30):
        mine = {f"{rng.randrange(40):02x}{'0' * 6}": (at(rng.randrange(10_000)), f"s{batch}-{i}") for i in range(3)}
        hash_index.merge(spark, path, before=batch, fanout=3, small=8)
        for _ in range(1 + (batch % 7 == 3)):  # now and then a batch is run again
            asked = spark.createDataFrame([(h,) for h in mine], "sha256 string").coalesce(1)
            got = {r.sha256: (r.first_at, r.first_id) for r in hash_index.lookup(path, asked, batch).collect()}
            assert got == {h: min(seen[h]) for h in mine if h in seen}
            hash_index.add(path, entries(spark, [(h, w, t) for h, (t, w) in mine.items()]), batch, small=8)
        for h, v in mine.items():
            seen.setdefault(h, []).append(v)
    runs, folders = hash_index.listed(spark, path)
    assert runs <= 9 and folders <= 150
    stored = {p.name for p in (tmp_path / "index").iterdir()}
    state = manifest.latest(spark, path)[1]
    assert stored == {"_manifests"} | {r["path"] for r in state["runs"]} | {p for p in state["dropped"]}
    assert len([p for p in (tmp_path / "index" / "_manifests").glob("*.json")]) == 2


def test_manifest_refuses_a_second_writer(spark, tmp_path):
    path = str(tmp_path / "t")
    assert manifest.latest(spark, path) == (0, {})
    manifest.swap(spark, path, 0, {"a": 1}, [])
    with pytest.raises(manifest.Conflict):
        manifest.swap(spark, path, 0, {"a": 2}, [])
    assert manifest.latest(spark, path) == (1, {"a": 1, "dropped": []})


def rows(spark, items):
    return spark.createDataFrame([(k, at(t), v) for k, t, v in items], "id string, uploaded_at timestamp, v string")


def test_upsert_writes_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "history")
    content = lambda: {r.id: r.v for r in keyed.read_table(spark, path).collect()}
    buckets = lambda: {b["path"] for b in manifest.latest(spark, path)[1]["buckets"]}
    first = [(f"k{i}", 0, f"v{i}") for i in range(64)] + [(None, 1, "nobody")]
    assert keyed.upsert(path, rows(spark, first), bucket_rows=8) > 8
    want = {k: v for k, _, v in first}
    assert content() == want
    before = buckets()
    change = rows(spark, [("k3", 5, "old"), ("k3", 9, "new"), ("k3", 2, "older"), ("k4", 0, "v4")])
    assert keyed.upsert(path, change, bucket_rows=8) == 1
    want["k3"] = "new"
    assert content() == want and len(before - buckets()) == 1
    version = manifest.latest(spark, path)[0]
    assert keyed.upsert(path, change, bucket_rows=8) == 0 and manifest.latest(spark, path)[0] == version
    more = [(f"n{i}", 3, "x" * i) for i in range(200)]
    keyed.upsert(path, rows(spark, more), bucket_rows=8)
    want |= {k: v for k, _, v in more}
    assert content() == want and manifest.latest(spark, path)[1]["bits"] == 6
    found = keyed.rows_of(spark, path, spark.createDataFrame([("k3",), ("none",), (None,)], "id string"))
    assert [(r.id, r.v) for r in found.collect()] == [("k3", "new")] and len(found.inputFiles()) <= 3
    assert keyed.delete(path, spark.createDataFrame([("k3",), ("k3",), ("none",)], "id string")) == 1
    del want["k3"]
    assert content() == want and keyed.delete(path, spark.createDataFrame([("k3",)], "id string")) == 0
    assert keyed.upsert(path, rows(spark, [(None, 7, "somebody")]), bucket_rows=8) == 1 and content()[None] == "somebody"
    with pytest.raises(ValueError):
        keyed.upsert(path, rows(spark, more).withColumn("extra", F.lit(1)))


def test_a_crash_between_files_and_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    path, items = str(tmp_path / "t"), [(f"k{i}", 0, "a") for i in range(9)]
    keyed.upsert(path, rows(spark, items), bucket_rows=4)

    def crash(*_):
        raise RuntimeError

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(manifest, "swap", crash)
        keyed.upsert(path, rows(spark, [("k1", 1, "b")]), bucket_rows=4)
    assert {r.v for r in keyed.read_table(spark, path).collect()} == {"a"}
    assert keyed.upsert(path, rows(spark, [("k1", 1, "b")]), bucket_rows=4) == 1
    assert sorted(r.v for r in keyed.read_table(spark, path).collect()) == ["a"] * 8 + ["b"]


def test_tables_without_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        keyed.read_table(spark, path)
    assert keyed.upsert(path, rows(spark, [])) == 0 and keyed.read_table(spark, path).collect() == []
    assert keyed.upsert(path, rows(spark, [])) == 0 and keyed.delete(path, spark.createDataFrame([], "id string")) == 0

"""Tables that change by key: equal to a full rewrite, in proportion to the change, and safe with two writers."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from weftline.sources import keyed
from weftline.sources.keyed import CommitConflict, KeyedTable, Lease, LeaseLost, Numbered

SCHEMA = "k int, j string, v long"


def files(folder):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_changes_equal_a_full_rewrite(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "DELTAS", 3)
    monkeypatch.setattr(keyed, "LEAST", 0)
    table, want, draw = KeyedTable(spark, str(tmp_path / "t"), ["k", "j"], 3), {}, random.Random(1)
    assert table.read(SCHEMA).count() == 0
    for turn in range(9):
        puts = {(draw.randrange(30 if turn else 200), draw.choice("ab")): draw.randrange(1000) for _ in range(60 if turn == 0 else 6)}
        gone = {(draw.randrange(30), draw.choice("ab")) for _ in range(3)} - set(puts)
        table.change(spark.createDataFrame([(k, j, v) for (k, j), v in puts.items()], SCHEMA), spark.createDataFrame(list(gone), "k int, j string") if gone else None)
        want = {k: v for k, v in {**want, **puts}.items() if k not in gone}
        assert {(r.k, r.j): r.v for r in table.read(SCHEMA).collect()} == want
    assert {(r.k, r.j): r.v for r in KeyedTable(spark, str(tmp_path / "t"), ["k", "j"], 3).read(SCHEMA).collect()} == want
    table.replace(spark.createDataFrame([(1, "a", 5)], SCHEMA))
    assert [tuple(r) for r in table.read(SCHEMA).collect()] == [(1, "a", 5)]
    table.delete(spark.createDataFrame([(1, "a"), (9, "x")], "k int, j string"))
    assert table.read(SCHEMA).count() == 0


def test_an_append_writes_what_it_adds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "LEAST", 0)
    rows = lambda a, b: spark.range(a, b).select(F.col("id").cast("int").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("j"), F.col("id").alias("v"))
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"])
    table.upsert(rows(0, 10_000))
    before = files(tmp_path)
    table.upsert(rows(10_000, 10_001))
    new = {p: n for p, n in files(tmp_path).items() if p not in before}
    assert len(new) == 1 and sum(new.values()) < sum(before.values()) / 100
    assert set(before) <= set(files(tmp_path)) and table.read(SCHEMA).count() == 10_001
    # Many small changes never cost more than a few times what they changed and the base.
    written = dict(files(tmp_path))
    for i in range(12):
        table.upsert(rows(i, i + 1).withColumn("v", F.lit(-1).cast("long")))
        written |= files(tmp_path)
    assert sum(written.values()) < 2 * sum(before.values()) and table.read(SCHEMA).filter("v = -1").count() == 12


def test_lookups_read_their_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "LEAST", 0)
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], 16)
    table.upsert(spark.range(1000).select(F.col("id").cast("int").alias("k"), F.lit("x").alias("j"), F.col("id").alias("v")))
    table.upsert(spark.createDataFrame([(7, "new", 1)], SCHEMA))
    found = table.lookup(SCHEMA, spark.createDataFrame([(7,), (8,), (5000,)], "k int"))
    assert {(r.k, r.j) for r in found.collect()} == {(7, "new"), (8, "x")}
    plan = table.lookup(SCHEMA, spark.createDataFrame([(7,)], "k int"))._jdf.queryExecution().executedPlan()
    text = plan.toString()
    scans = text.split("PartitionFilters: ")[1:]
    assert len(scans) == 3 and all(s.startswith("[(__bucket#") or s.startswith("[isnotnull(__bucket") for s in scans), text
    files = []

    def visit(node):
        if "FileSourceScan" in node.getClass().getSimpleName():
            files.append(node.selectedPartitions().totalNumberOfFiles() if hasattr(node.selectedPartitions(), "totalNumberOfFiles") else len(node.selectedPartitions()))
        children = node.children()
        for i in range(children.size()):
            visit(children.apply(i))

    visit(plan.inputPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan)
    assert files and sum(files) <= 3  # of 17


def test_two_writers(spark, tmp_path):
    one, two = (KeyedTable(spark, str(tmp_path / "t"), ["k"]) for _ in range(2))
    row = lambda k: spark.createDataFrame([(k, "x", 1)], SCHEMA)
    one.upsert(row(1))
    two.read(SCHEMA)
    one.upsert(row(2))
    before = files(tmp_path)
    with pytest.raises(CommitConflict):
        two.upsert(row(3))
    assert files(tmp_path) == before
    two.read(SCHEMA)
    two.upsert(row(3))
    assert sorted(r.k for r in two.read(SCHEMA).collect()) == [1, 2, 3]


def test_a_lease_is_taken_over(spark, tmp_path):
    first, second = Lease(spark, str(tmp_path / "lease")), Lease(spark, str(tmp_path / "lease"))
    first.take()
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], guard=first.check)
    table.upsert(spark.createDataFrame([(1, "x", 1)], SCHEMA))
    assert second.take() > first.token
    before = files(tmp_path)
    with pytest.raises(LeaseLost, match="WORLD_RUN_TAKEN_OVER"):
        table.upsert(spark.createDataFrame([(2, "x", 1)], SCHEMA))
    assert files(tmp_path) == before and table.read(SCHEMA).count() == 1


def test_a_number_is_put_once(spark, tmp_path):
    won = []

    def race(who):
        if Numbered(spark, str(tmp_path / "n")).put(1, who):
            won.append(who)

    threads = [threading.Thread(target=race, args=(str(i),)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and Numbered(spark, str(tmp_path / "n")).last() == (1, won[0]) and len(os.listdir(tmp_path / "n")) <= 3

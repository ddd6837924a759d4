"""Merges into versioned tables: what counts, snapshots, several writers, repeated batches, streams."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from tessera.sources import versions
from tessera.sources.versions import Change, Outdated, Versions

EDGES = "type string, src string, dst string, n long, quote string, seq long"


def frame(spark, rows):
    return spark.createDataFrame(rows, EDGES)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("type", "src", "dst", "n", "quote")) for r in df.collect()), key=str)


@pytest.mark.parametrize("keep", [True, False])
def test_merges_equal_a_dictionary(spark, tmp_path, keep):
    tables, r, want, seq = Versions(spark, str(tmp_path / "t")), random.Random(3), {}, 0
    for _ in range(4):
        batch = []
        for _ in range(40):
            seq += 1
            row = (r.choice(["SAID", "HAS ROLE/X", "COMPETES"]), r.choice("abcd"), r.choice("xyz") if r.random() < 0.9 else None, r.choice([None, r.randint(1, 9)]), r.choice([None, f"q{seq}"]), seq)
            batch.append(row)
            old = want.get(row[:3], (None, None))
            want[row[:3]] = tuple(b if b is not None or not keep else a for a, b in zip(old, row[3:5], strict=True))
        r.shuffle(batch)
        tables.merge([Change("edges", frame(spark, batch), "type", ["src", "dst"], "seq", keep)])
    assert rows_of(tables.read("edges")) == sorted(((*k, *v) for k, v in want.items()), key=str)
    assert tables.versions() == [1, 2, 3, 4]


def test_snapshots_parts_and_vacuum(spark, tmp_path):
    tables = Versions(spark, str(tmp_path / "t"))
    change = lambda rows: [Change("edges", frame(spark, rows), "type", ["src", "dst"], "seq")]
    tables.merge(change([("A", "a", "b", 1, None, 1), ("B", "a", "b", 1, None, 1)]))
    first = tables.snapshot()
    tables.merge(change([("A", "a", "b", 2, None, 2), ("A", "a", "c", 3, None, 2)]))
    assert rows_of(tables.read("edges", at=first)) == [("A", "a", "b", 1, None), ("B", "a", "b", 1, None)]
    assert rows_of(tables.read("edges", ["A"])) == [("A", "a", "b", 2, None), ("A", "a", "c", 3, None)]
    assert tables.snapshot().tables["edges"]["B"] == first.tables["edges"]["B"]  # untouched partitions stay where they are
    assert tables.vacuum() == 0  # the first folder still holds B
    tables.merge(change([("B", "z", "z", 9, None, 3)]))
    assert tables.vacuum() == 1 and tables.versions() == [3]
    assert rows_of(tables.read("edges")) == [("A", "a", "b", 2, None), ("A", "a", "c", 3, None), ("B", "a", "b", 1, None), ("B", "z", "z", 9, None)]
    assert tables.read("edges", ["nothing"]).collect() == []


def test_appends_and_new_columns(spark, tmp_path):
    tables = Versions(spark, str(tmp_path / "t"))
    said = spark.createDataFrame([("STATEMENT", "s0"), ("STATEMENT", "s0")], "label string, id string")
    for _ in range(2):
        tables.merge([Change("nodes", said, "label")])
    assert tables.read("nodes").count() == 4  # ids may collide: rows are created, not merged
    nodes = spark.createDataFrame([("ORG", "acme", 1)], "label string, name string, n long")
    more = spark.createDataFrame([("ORG", "acme", True)], "label string, name string, inferred boolean")
    tables.merge([Change("orgs", nodes, "label", ["name"])])
    tables.merge([Change("orgs", more, "label", ["name"], keep=True)])
    assert [tuple(r) for r in tables.read("orgs").collect()] == [("ORG", "acme", 1, True)]


def test_writers_do_not_lose_each_others_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    failed = []

    def write(k):
        try:
            for i in range(3):
                Versions(spark, path).merge([Change("edges", frame(spark, [("A", f"w{k}", str(i), i, None, i)]), "type", ["src", "dst"], "seq")])
        except Exception as e:  # told in the main thread
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    tables = Versions(spark, path)
    assert tables.read("edges").count() == 9 and tables.versions() == list(range(1, 10))
    monkeypatch.setattr(versions, "RETRIES", 1)
    monkeypatch.setattr(Versions, "snapshot", lambda self, version=None: versions.Snapshot(8))
    with pytest.raises(Outdated):
        tables.merge([Change("edges", frame(spark, [("A", "late", "x", 1, None, 1)]), "type", ["src", "dst"], "seq")])


def test_streams_merge_each_batch_once(spark, tmp_path):
    source, tables = str(tmp_path / "in"), Versions(spark, str(tmp_path / "t"))
    merge = lambda: versions.merge_available(spark, source, tables, "edges", "type", ["src", "dst"], "seq", str(tmp_path / "c"))
    frame(spark, [("A", "a", "b", 1, "x", 1), ("A", "a", "b", 2, None, 2)]).write.parquet(source)
    merge()
    assert rows_of(tables.read("edges")) == [("A", "a", "b", 2, "x")]
    frame(spark, [("A", "a", "b", None, "y", 3), ("B", "c", "d", 7, None, 4)]).write.mode("append").parquet(source)
    merge()
    merge()
    assert rows_of(tables.read("edges")) == [("A", "a", "b", 2, "y"), ("B", "c", "d", 7, None)]
    version = tables.snapshot().version
    assert tables.merge([Change("edges", frame(spark, [("A", "a", "b", 99, "z", 9)]), "type", ["src", "dst"], "seq")], str(tmp_path / "c"), 0) == version  # a batch that is known
    assert tables.read("edges").filter(F.col("n") == 99).count() == 0

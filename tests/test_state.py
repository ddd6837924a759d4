"""Streams with keyed state against plain Python, over several runs from one checkpoint."""

import random
import time

import pytest
from pyspark.errors import AnalysisException

from tessera.streaming import current_rows, state, upsert_available


def run(spark, source, target, checkpoint, schema, make, once=True):
    state.query_settings(spark)
    stream = make(spark.readStream.schema(schema).parquet(source))
    writer = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    if once:
        writer.trigger(availableNow=True).start().awaitTermination()
        return None
    return writer.trigger(processingTime="200 milliseconds").start()


@pytest.fixture
def places(tmp_path):
    return tuple(str(tmp_path / x) for x in ("in", "out", "check"))


def test_changed_texts_and_known_links(spark, places, tmp_path):
    source, target, checkpoint = places
    schema = "link string, text string, v long"
    r, known, want, v = random.Random(1), {}, [], 0
    first = {}
    for _ in range(3):
        rows = []
        for _ in range(30):
            v += 1
            rows.append((r.choice("abcdef") if r.random() < 0.95 else None, r.choice(["x", "y", None, ""]), v))
        for link, text, n in rows:
            if known.get(link, 0) != (text or ""):
                want.append((link, text, n))
            known[link] = text or ""
            first.setdefault(link, n)
        r.shuffle(rows)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        run(spark, source, target, checkpoint, schema, lambda s: state.new_or_changed(s, ["link"], "text", "v"))
        run(spark, source, str(tmp_path / "new"), str(tmp_path / "check2"), schema, lambda s: state.only_new(s, ["link"], "v"))
    got = sorted(map(tuple, spark.read.parquet(target).collect()), key=str)
    assert got == sorted(want, key=str)
    assert {x["link"]: x["v"] for x in spark.read.parquet(str(tmp_path / "new")).collect()} == first


def until(query, spark, target, n):
    """The rows of target once there are n; the query is stopped then."""
    end = time.time() + 60
    try:
        while time.time() < end:
            try:
                rows = spark.read.parquet(target).collect()
                if len(rows) >= n:
                    return rows
            except AnalysisException:  # nothing is written yet
                pass
            time.sleep(0.3)
        raise AssertionError("the rows didn't come")
    finally:
        query.stop()


def test_rows_go_on_when_there_are_enough(spark, places):
    source, target, checkpoint = places
    schema = "k string, i long"
    begin = lambda: run(spark, source, target, checkpoint, schema, lambda s: state.flushed(s, ["k"], most=10, seconds=3600), once=False)
    spark.createDataFrame([("a", i) for i in range(23)] + [("b", i) for i in range(4)], schema).coalesce(1).write.parquet(source)
    assert sorted((x["k"], x["flush"], x["place"]) for x in until(begin(), spark, target, 20)) == [("a", f, p) for f in (0, 1) for p in range(10)]
    spark.createDataFrame([("a", i) for i in range(23, 31)] + [("b", 4)], schema).coalesce(1).write.mode("append").parquet(source)
    # three held rows of the last run and seven new ones make a group
    rows = [(x["k"], x["i"], x["flush"]) for x in until(begin(), spark, target, 30)]
    assert sorted(i for k, i, f in rows if k == "a") == list(range(30)) and all(k == "a" for k, *_ in rows)
    assert {f for k, i, f in rows if i >= 20} == {2}


def test_held_rows_go_after_their_time(spark, places):
    source, target, checkpoint = places
    schema = "k string, i long"
    spark.createDataFrame([("a", 1), ("a", 2)], schema).coalesce(1).write.parquet(source)
    query = run(spark, source, target, checkpoint, schema, lambda s: state.flushed(s, ["k"], most=10, seconds=1), once=False)
    assert sorted((x["i"], x["flush"], x["place"]) for x in until(query, spark, target, 2)) == [(1, 0, 0), (2, 0, 1)]


def test_of_two_versions_in_one_batch_the_last_counts(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(k, f"v{n}", n) for k in range(20) for n in range(5)]
    random.Random(2).shuffle(rows)
    spark.createDataFrame(rows, "k long, text string, n long").repartition(4).write.parquet(source)
    upsert_available(spark, source, target, str(tmp_path / "c"), ["k"], version="n")
    assert {(r["k"], r["text"]) for r in current_rows(spark, target, ["k"]).collect()} == {(k, "v4") for k in range(20)}

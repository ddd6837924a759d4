"""Runs against brute force, by hand-made texts, and on messy input."""

import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import periodic_runs
from tessera.llm.queries import ORACLE_SQL, op13_periodic_runs


def brute(words):
    n, out = len(words), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out[i, j - i + q] = min(q, out.get((i, j - i + q), q))
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def messy_words(r):
    words = []
    while r.random() < 0.8:
        if r.random() < 0.5:
            words += [r.randint(0, r.choice([1, 2, 5, 50])) for _ in range(r.randint(1, 20))]
        else:
            unit = [r.randint(0, 3) for _ in range(r.randint(1, 20))]
            words += [unit[i % len(unit)] for i in range(r.randint(1, len(unit) * 9))]
    return words


def test_runs_are_all_runs():
    r, total = random.Random(3), 0
    for _ in range(600):
        texts = [messy_words(r) for _ in range(r.randint(1, 5))]
        starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        want = [brute(t) for t in texts]
        assert periodic_runs.runs(np.array(sum(texts, []), np.int64), starts) == want
        total += sum(map(len, want))
    assert total > 1000


@pytest.mark.parametrize("kind", ["one", "two", "long period", "random", "fibonacci"])
def test_very_long_texts_are_quick(kind):
    n = 200_000
    a, b = [0], [0, 1]
    while kind == "fibonacci" and len(b) < n:
        a, b = b, b + a
    words = {"one": np.zeros(n), "two": np.arange(n) % 2, "long period": np.arange(n) % 999, "random": np.random.default_rng(1).integers(0, 3, n), "fibonacci": np.array(b[:n])}[kind].astype(np.int64)
    began = time.time()
    found = periodic_runs.runs(words, np.array([0, n]))[0]
    assert time.time() - began < 60
    if kind in ("one", "two", "long period"):
        assert found == [(0, n, {"one": 1, "two": 2, "long period": 999}[kind])]


def test_detect_on_messy_rows(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "BATCH_WORDS", 50)
    r = random.Random(9)
    texts = [" ".join(map(str, messy_words(r))) for _ in range(80)]
    texts += [None, "", " \t\n", "a", "a a a a a a a", "x " * 6, "\tx\x0bx\x0cx\rx\nx x ", "a b " * 4, "a b " * 3 + "a", "İ Σ " * 3000]
    rows = [(i % 60 if i else None, t, 1, 2, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs long, n_words long, top string")
    got = sorted(((x["doc_id"], x["n_words"], [tuple(y) for y in x["runs"]], x["collapsed"]) for x in periodic_runs.detect(docs).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        words = (t or "").encode().split()
        found = brute(words)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        want.append((i, len(words), found, b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    assert got == sorted(want, key=str)
    assert periodic_runs.summary(periodic_runs.detect(docs.limit(0))).collect() == []


def test_ties_of_the_greatest_exponent(spark):
    docs = spark.createDataFrame([(1, "a b " * 4 + "c d " * 4 + "e e e e e e"), (2, "a b c " * 4 + "x y " * 5)], "doc_id long, text string")
    got = {x["doc_id"]: (x["n_runs"], x["start"], x["length"], x["period"], x["exponent_milli"]) for x in periodic_runs.summary(periodic_runs.detect(docs)).collect()}
    assert got == {1: (3, 16, 6, 1, 6000), 2: (2, 12, 10, 2, 5000)}


def test_repeat_words(spark):
    df = spark.createDataFrame([(" a b\tc d e f g ", 2, 3), ("a b", 0, 1), ("a", 0, 1)], "t string, a long, p long")
    got = [x[0] for x in df.select(periodic_runs.repeat_words(F.col("t"), F.col("a"), F.col("p"))).collect()]
    assert got == ["a b c d e c d", "a a", "a"]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    result = duck.execute(ORACLE_SQL["op13_periodic_runs"])
    columns = [x[0] for x in result.description]
    want = sorted(result.fetchall())
    df = op13_periodic_runs(spark, f"/root/testdata/{sf}")
    assert sorted(tuple(x[c] for c in columns) for x in df.collect()) == want
    assert sum(x[1] for x in want) > 10

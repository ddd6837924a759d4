"""Nearest vectors by blocks against all pairs, and the recall of inverted lists."""

import numpy as np
import pytest

from tessera.functions import vectors
from tessera.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(rows, asked, k):
    out = {}
    for q, x in asked:
        if x is None or not any(x):
            continue
        scored = [(-round(float(np.dot(x, v) / np.sqrt(np.dot(x, x) * np.dot(v, v))), 9), i) for i, v in rows if v is not None and any(v) and i is not None]
        out[q] = [i for _, i in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("block", [1 << 22, 100])
def test_blocks_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", block)
    g = np.random.default_rng(1)
    rows = [(i, [float(x) for x in g.integers(-2, 3, 3)]) for i in range(300)] + [(1000 + i, [1.0, 0.0, 0.0]) for i in range(200)] + [(None, [1.0, 1.0, 1.0]), (2000, None)]
    asked = [(f"q{i}", [float(x) for x in g.integers(-2, 3, 3)]) for i in range(20)] + [("zero", [0.0, 0.0, 0.0]), ("none", None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    q = spark.createDataFrame(asked, "query_id string, embedding array<double>")
    got = {}
    for x in vectors.dense_topk_each(v, q, 7).orderBy("query_id", "score").collect():
        got.setdefault(x["query_id"], []).append((-x["score"], x["vec_id"]))
    assert {k: [i for _, i in sorted(x)] for k, x in got.items()} == brute(rows, asked, 7)
    assert vectors.dense_topk_each(v, q.limit(0), 7).collect() == [] and vectors.dense_topk_each(v.limit(0), q, 7).collect() == []


def test_every_row_is_in_a_list(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    c = vectors.fit_centroids(v, 4)
    assert sorted(x["vec_id"] for x in vectors.nearest_lists(v, c, 1, "vec_id").collect()) == [1, 2, 3]


def test_recall_of_inverted_lists(spark):
    exact, near = ({(x["query_id"], x["vec_id"]) for x in QUERIES[n](spark, SF).collect()} for n in ("dense_topk_each", "inverted_lists_each"))
    assert len(near & exact) >= 0.9 * len(exact)

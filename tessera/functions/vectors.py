"""Nearest vectors of many queries: exactly, by matrix products over blocks of queries, and by inverted lists.

Queries are told to the executors in blocks of BLOCK_BYTES, so no two tables meet row by row. A task multiplies its
batches of vectors with the block and keeps the k best of each query; these few rows are all that is shuffled.

Inverted lists: centroids are fitted on a bounded sample (SAMPLE rows, drawn by a hash of the id), every row goes
into the list of its nearest centroid, lists are partitions of a stored table, and a query reads the lists of its
nearest centroids alone. That may miss neighbours; the exact search stays beside it.

Scores are cosines, rounded to nine digits; of equal ones the smaller id is first. Null vectors and those without
length have no score. All vectors must have one length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.retrieval import _first

BLOCK_BYTES = 4 << 20
SAMPLE = 20_000
ROUNDS = 12


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have a direction, and their vectors scaled to length 1."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    there = np.flatnonzero(~np.asarray(lists.is_null()))
    if not len(there):
        return there, np.zeros((0, 0))
    flat = lists.take(pa.array(there)).flatten()
    matrix = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)).reshape(len(there), -1)
    length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    good = length > 0
    return there[good], matrix[good] / length[good, None]


def _blocks(queries: DataFrame, query: str, column: str) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and unit vectors of the queries, BLOCK_BYTES at a time."""
    ids, rows, size = [], [], 0

    def told() -> tuple[list, np.ndarray]:
        kept, matrix = _unit(pa.array(rows, pa.list_(pa.float64())))
        return [ids[i] for i in kept.tolist()], matrix

    for r in queries.select(query, column).toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        size += 8 * len(r[1] or ())
        if size > BLOCK_BYTES:
            yield told()
            ids, rows, size = [], [], 0
    if ids:
        yield told()


class _Best:
    """The k best of every query so far, by score and then id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.ids, self.scores = k, [[] for _ in range(queries)], [np.zeros(0) for _ in range(queries)]

    def add(self, which: np.ndarray, scores: np.ndarray, ids: list) -> None:
        """scores of ids (sorted) for the queries of these numbers, a row for each query."""
        scores = np.round(scores, 9)
        for q, own in zip(which.tolist(), scores, strict=True):
            known = self.scores[q]
            if len(known) == self.k:
                own_at = np.flatnonzero(own >= known[-1])
            else:
                own_at = np.arange(len(own))
            if not len(own_at):
                continue
            own = own[own_at]
            if len(own) > self.k:  # all above the k-th, and of its equals the first by id
                edge = np.partition(own, len(own) - self.k)[len(own) - self.k]
                above, equal = np.flatnonzero(own > edge), np.flatnonzero(own == edge)
                chosen = np.sort(np.concatenate((above, equal[: self.k - len(above)])))
                own, own_at = own[chosen], own_at[chosen]
            merged = sorted([*zip((-known).tolist(), self.ids[q], strict=True), *zip((-own).tolist(), [ids[i] for i in own_at.tolist()], strict=True)])[: self.k]
            self.ids[q], self.scores[q] = [m[1] for m in merged], np.array([-m[0] for m in merged])


def _sorted(batch: pa.RecordBatch, by: int, vector: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Ids, rows and unit vectors of a batch in the order of its ids; null ids are left out."""
    rows, matrix = _unit(batch.column(vector))
    ids = batch.column(by).to_pylist()
    order = sorted((i for i in range(len(rows)) if ids[rows[i]] is not None), key=lambda i: ids[rows[i]])
    return [ids[rows[i]] for i in order], rows[order], matrix[order]


def dense_topk_each(vectors: DataFrame, queries: DataFrame, k: int, id_: str = "vec_id", column: str = "embedding", query: str = "query_id", probes: DataFrame | None = None) -> DataFrame:
    """(query, id, score): the k nearest vectors of every row (query, column) of queries.

    With probes (query, list), vectors have a column list, and a query meets those of its lists alone.
    """
    spark = vectors.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in [*queries.select(query).schema, *vectors.select(id_).schema]}
    schema = f"`{query}` {kinds[query]}, `{id_}` {kinds[id_]}, score double"
    out = None
    for names, matrix in _blocks(queries, query, column):
        wanted = vectors
        listed = None
        if probes is not None:
            told = probes.join(F.broadcast(spark.createDataFrame([(x,) for x in names], f"`{query}` {kinds[query]}")), query, "left_semi").collect() if names else []  # some lists for each query of the block
            place = {x: i for i, x in enumerate(names)}
            listed = {}
            for r in told:
                listed.setdefault(r["list"], []).append(place[r[query]])
            wanted = vectors.filter(F.col("list").isin(list(listed)))
        shared = spark.sparkContext.broadcast((names, matrix, listed))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, m, by_list = shared.value
            best, schema_ = _Best(len(own), k), None
            for batch in batches:
                schema_ = batch.schema
                ids, rows, v = _sorted(batch, 0, 1)
                if not len(ids):
                    continue
                if by_list is None:
                    best.add(np.arange(len(own)), m @ v.T, ids)
                    continue
                lists = batch.column(2).to_numpy(zero_copy_only=False)[rows]
                for x in np.unique(lists).tolist():
                    at, which = np.flatnonzero(lists == x), np.array(by_list.get(x, []), np.int64)
                    if len(which):
                        best.add(which, m[which] @ v[at].T, [ids[i] for i in at.tolist()])
            if schema_ is not None:
                which = [q for q, x in enumerate(best.ids) for _ in x]
                yield pa.RecordBatch.from_arrays([pa.array([own[q] for q in which]), pa.array([i for x in best.ids for i in x], schema_.field(0).type), pa.array(np.concatenate([*best.scores, np.zeros(0)]))], names=[query, id_, "score"])

        part = wanted.select(id_, column, *(["list"] if probes is not None else [])).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    return _first(out, k, query, id_)


def fit_centroids(vectors: DataFrame, lists: int, id_: str = "vec_id", column: str = "embedding", seed: int = 7) -> np.ndarray:
    """Unit centroids of that many lists, fitted by spherical k-means on the SAMPLE rows with the smallest hashes of their ids."""
    drawn = vectors.select(F.xxhash64(F.lit(seed), id_).alias("h"), id_, column).orderBy("h", id_).limit(SAMPLE).select(column).toArrow()
    _, x = _unit(drawn.column(0))
    if not len(x):
        return np.zeros((0, 0))
    lists = min(lists, len(x))
    centroids = x[np.linspace(0, len(x) - 1, lists).astype(int)]
    for _ in range(ROUNDS):
        nearest = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        length = np.sqrt(np.einsum("ij,ij->i", sums, sums))
        centroids = np.where(length[:, None] > 0, sums / np.maximum(length, 1e-300)[:, None], centroids)
    return centroids


def nearest_lists(vectors: DataFrame, centroids: np.ndarray, n: int, id_: str, column: str = "embedding") -> DataFrame:
    """vectors with a row for each of their n nearest lists, as column list; those without a direction go into list 0."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    schema = vectors.limit(0).withColumn("list", F.lit(0)).schema
    place = vectors.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            found = np.zeros((batch.num_rows, max(1, min(n, len(c)))), np.int32)
            rows, v = _unit(batch.column(place))
            if len(rows) and len(c):
                found[rows] = np.argsort(-(v @ c.T), axis=1, kind="stable")[:, : found.shape[1]]
            again = pa.array(np.repeat(np.arange(batch.num_rows), found.shape[1]))
            yield pa.RecordBatch.from_arrays([*batch.take(again).columns, pa.array(found.ravel())], names=[*batch.schema.names, "list"])

    return vectors.mapInArrow(run, schema)


def probes_for(listed: DataFrame, centroids: np.ndarray, k: int, recall: float = 0.95, id_: str = "vec_id", column: str = "embedding", queries: int = 64, seed: int = 11) -> int:
    """The fewest lists of a query that hold this share of the exact k nearest, measured on so many rows drawn by a hash of the id."""
    drawn = listed.filter(F.col(column).isNotNull()).select(F.col(id_).alias("query_id"), column, F.xxhash64(F.lit(seed), id_).alias("h")).orderBy("h", "query_id").limit(queries).drop("h")
    nearest = dense_topk_each(listed.select(id_, column), drawn, k, id_, column).join(listed.select(id_, F.col("list").alias("of")), id_)
    asked = {r["query_id"]: r[column] for r in drawn.collect()}
    held = []
    for r in nearest.collect():  # k rows for each of the drawn queries
        order = np.argsort(-(np.asarray(asked[r["query_id"]], float) @ centroids.T), kind="stable")
        held.append(int(np.flatnonzero(order == r["of"])[0]) + 1)
    return int(np.quantile(held, recall, method="inverted_cdf")) if held else 1

"""Dense, sparse and hybrid retrieval with exact scores."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine(v: Column, q: Column) -> Column:
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot(v, q) / (F.sqrt(dot(v, v)) * F.sqrt(dot(q, q)))


def dense_topk(vectors: DataFrame, query: list[float], k: int, id_: str = "vec_id", column: str = "embedding", threshold: float | None = None) -> DataFrame:
    """The k nearest by cosine similarity, of those above the threshold if there is one; scores are ranked at nine digits, ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(id_, F.round(cosine(F.col(column), q), 9).alias("score"))
    scored = scored if threshold is None else scored.filter(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), id_).limit(k)


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def _occurrences(column: str, term: str) -> Column:
    return F.size(F.filter(column, lambda x: x == F.lit(term)))


def bm25_topk(docs: DataFrame, terms: list[str], k: int, id_: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best by BM25; only the query's terms leave a document's task, as one row with their counts."""
    terms = sorted(set(terms))
    ws = docs.select(id_, words(text).alias("w"))
    counted = ws.select(id_, F.size("w").alias("dl"), *[_occurrences("w", t).alias(f"t{i}") for i, t in enumerate(terms)])
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"t{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"t{i}"), F.col(f"d{i}")
        score = score + F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    hit = F.greatest(*[F.col(f"t{i}") for i in range(len(terms))], F.lit(0)) > 0
    return counted.filter(hit).crossJoin(F.broadcast(stats)).select(id_, F.round(score, 9).alias("score")).orderBy(F.desc("score"), id_).limit(k)


def postings(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(t, id, dl, f): term, document, its length and the term's occurrences, sorted by term, so a stored table is read by its statistics."""
    ws = docs.select(F.col(id_).alias("id"), words(text).alias("w")).select("id", F.size("w").alias("dl"), F.explode("w").alias("t"))
    return ws.groupBy("id", "dl", "t").agg(F.count("*").alias("f")).select("t", "id", "dl", "f").repartitionByRange("t").sortWithinPartitions("t")


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Number of documents and their mean length."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(words(text))).alias("avgdl"))


def bm25_from(index: DataFrame, stats: DataFrame, terms: list[str], k: int, id_: str = "doc_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """bm25_topk from postings: only those of the query's terms are read."""
    hits = index.filter(F.col("t").isin(sorted(set(terms))))
    df = hits.groupBy("t").agg(F.count("*").alias("df"))  # a row for each term of the query
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = hits.join(F.broadcast(df), "t").crossJoin(F.broadcast(stats)).groupBy(F.col("id").alias(id_)).agg(F.round(F.sum(part), 9).alias("score"))  # one row of statistics
    return scored.orderBy(F.desc("score"), id_).limit(k)


def _first(scored: DataFrame, k: int, query: str, id_: str) -> DataFrame:
    """The k best of every query; the engine cuts each partition to k rows a query before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), id_))
    return scored.withColumn("__r", rank).filter(F.col("__r") <= k).drop("__r")


def bm25_topk_each(docs: DataFrame, queries: DataFrame, k: int, id_: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75, query: str = "query_id") -> DataFrame:
    """bm25_topk for the whole text of every row (query, text) of queries; ids of docs must be unique."""
    asked = queries.select(query, F.explode(F.array_distinct(words(text))).alias("t"))
    ws = docs.select(id_, words(text).alias("w")).select(id_, F.size("w").alias("dl"), "w")
    stats = ws.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = ws.select(id_, "dl", F.explode("w").alias("t")).join(asked.select("t").distinct(), "t", "left_semi").groupBy(id_, "dl", "t").agg(F.count("*").alias("f"))
    df = tf.groupBy("t").agg(F.count("*").alias("df"))
    weights = asked.join(df, "t").crossJoin(F.broadcast(stats))
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = tf.join(weights, "t").groupBy(query, id_).agg(F.round(F.sum(part), 9).alias("score"))
    return _first(scored, k, query, id_)


def reciprocal_ranks_each(lists: list[DataFrame], id_: str, k: int = 60, limit: int = 10, query: str = "query_id") -> DataFrame:
    """reciprocal_ranks within every query."""
    order = Window.partitionBy(query).orderBy(F.desc("score"), id_)
    both = None
    for x in lists:
        ranked = x.select(query, id_, (1.0 / (k + F.row_number().over(order))).alias("r"))
        both = ranked if both is None else both.unionByName(ranked)
    return _first(both.groupBy(query, id_).agg(F.round(F.sum("r"), 9).alias("score")), limit, query, id_)


def weighted_each(lists: list[tuple[DataFrame, float]], id_: str, limit: int = 10, query: str = "query_id") -> DataFrame:
    """weighted within every query."""
    all_, both = Window.partitionBy(query), None
    for x, w in lists:
        low, high = F.min("score").over(all_), F.max("score").over(all_)
        scaled = x.select(query, id_, (F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0) * w).alias("r"))
        both = scaled if both is None else both.unionByName(scaled)
    return _first(both.groupBy(query, id_).agg(F.round(F.sum("r"), 6).alias("score")), limit, query, id_)


def reciprocal_ranks(lists: list[DataFrame], id_: str, k: int = 60, limit: int = 10) -> DataFrame:
    """Fuse short ranked lists (id, score) by the sum of 1 / (k + rank)."""
    order = Window.orderBy(F.desc("score"), id_)  # lists of a few candidates
    ranked = [x.select(id_, (1.0 / (k + F.row_number().over(order))).alias("r")) for x in lists]
    both = ranked[0]
    for other in ranked[1:]:
        both = both.unionByName(other)
    return both.groupBy(id_).agg(F.round(F.sum("r"), 9).alias("score")).orderBy(F.desc("score"), id_).limit(limit)


def weighted(lists: list[tuple[DataFrame, float]], id_: str, limit: int = 10) -> DataFrame:
    """Fuse short lists by weighted scores, each scaled to 0..1 by its least and largest."""
    both = None
    for x, w in lists:
        all_ = Window.partitionBy(F.lit(1))
        low, high = F.min("score").over(all_), F.max("score").over(all_)
        scaled = x.select(id_, (F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0) * w).alias("r"))
        both = scaled if both is None else both.unionByName(scaled)
    return both.groupBy(id_).agg(F.round(F.sum("r"), 6).alias("score")).orderBy(F.desc("score"), id_).limit(limit)


def settings(explicit: dict, stored: dict, defaults: dict) -> dict:
    """Options by precedence: what a caller gives, then what is stored, then the default; None counts as not given."""
    return {k: next((x[k] for x in (explicit, stored) if x.get(k) is not None), v) for k, v in defaults.items()}


def output_fields(wanted: list[str], known: list[str], vector: str, id_: str) -> list[str]:
    """The wanted fields that are known; if none is, all but the vector and the id."""
    return [c for c in wanted if c in known] or [c for c in known if c not in (vector, id_)]


def shown_similarity(distance: Column) -> Column:
    """A distance as a similarity: 1 - d up to 1, beyond that 1 / (1 + d)."""
    return F.when(distance <= 1, 1 - distance).otherwise(1 / (1 + distance))


def dates_in(text: Column | str) -> Column:
    """Distinct ISO dates of a text, in the order of their first place."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b"), F.lit(1)))


def described(df: DataFrame, n: int = 5) -> dict:
    """A collection's fields with types, its number of rows, and n of them."""
    return {"fields": {f.name: f.dataType.simpleString() for f in df.schema}, "rows": df.count(), "sample": [r.asDict() for r in df.limit(n).collect()]}


_TEST = re.compile(r"""\s*metadata\[["'](\w+)["']\]\s*(==|!=|>=|<=|>|<)\s*["']([^"']*)["']\s*""")


def metadata_filter(expression: str, column: str = "metadata") -> Column:
    """A condition such as metadata["k"] == "v" and metadata["d"] >= "2024" over a JSON column; values compare as text."""
    out = F.lit(True)
    for part in re.split(r"(?i)\s+and\s+", expression):
        m = _TEST.fullmatch(part)
        if not m:
            raise ValueError(f"cannot read: {part}")
        value = F.get_json_object(column, f"$.{m[1]}")
        out = out & {"==": value == m[3], "!=": value != m[3], ">=": value >= m[3], "<=": value <= m[3], ">": value > m[3], "<": value < m[3]}[m[2]]
    return out

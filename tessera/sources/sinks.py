"""Writers: view cache with time to live, checkpoints, snapshots, schema documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.graph_tables import Graph


def cache_view(df: DataFrame, path: str, name: str) -> None:
    """Store a view's rows with the time of storing."""
    df.withColumn("cached_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/{name}")


def cached_view(spark: SparkSession, path: str, name: str, ttl_s: int = 3600) -> DataFrame:
    """The stored rows if they are young enough, else none."""
    rows = spark.read.parquet(f"{path}/{name}")
    return rows.filter(F.col("cached_at") >= F.current_timestamp() - F.make_interval(secs=F.lit(ttl_s))).drop("cached_at")


def log_checkpoint(rows: DataFrame, path: str) -> None:
    """Append (key, status, processed_at, ...) rows; the latest counts."""
    rows.write.mode("append").parquet(path)


def checkpoint_state(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c != "key"]
    return rows.groupBy("key").agg(F.max_by(F.struct(*rest), "processed_at").alias("s")).select("key", *[F.col(f"s.{c}").alias(c) for c in rest])


def export_graph(g: Graph, path: str) -> None:
    """Nodes and edges as JSON lines, edges with the names of their ends."""
    g.nodes.write.mode("overwrite").json(f"{path}/nodes")
    ends = g.nodes.select("node_id", "name")
    g.edges.join(ends.toDF("src", "src_name"), "src").join(ends.toDF("dst", "dst_name"), "dst").write.mode("overwrite").json(f"{path}/edges")


def snapshot(df: DataFrame, path: str) -> int:
    """Copy a table and verify the number of rows that were written."""
    df.write.mode("overwrite").parquet(path)
    written, there = df.sparkSession.read.parquet(path).count(), df.count()
    if written != there:
        raise ValueError(f"{written} rows written of {there}")
    return written


def replace_partition(df: DataFrame, path: str, keys: list[str]) -> None:
    """Overwrite only the partitions that df has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def schema_document(g: Graph) -> DataFrame:
    """The graph's labels and types with counts, as one JSON document."""
    part = lambda df, key, name: df.groupBy(key).agg(F.count("*").alias("count")).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("name"), "count"))).alias(name))
    return part(g.nodes, "label", "node_types").crossJoin(part(g.edges, "type", "relationship_types")).select(F.to_json(F.struct("node_types", "relationship_types")).alias("document"))


def write_labelled(rows: DataFrame, path: str, order: str, parts: int = 8) -> None:
    """Texts with their integer labels as CSV, sorted over the files; quotes are escaped once, rows without either are left out."""
    kept = rows.filter("text is not null").withColumn("label", F.col("label").cast("int")).filter("label is not null")
    ordered = kept.repartitionByRange(parts, order).sortWithinPartitions(order).select("text", "label")
    ordered.write.mode("overwrite").option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)


def write_vectors(docs: DataFrame, path: str, embed, size: int, id_: str = "doc_id", text: str = "text") -> None:
    """Chunks of documents with their vectors: embed takes a list of texts and returns as many lists of `size` numbers."""
    from tessera.functions.text import chunk_spans

    chunks = docs.select(id_, text, F.posexplode(chunk_spans(text)).alias("chunk", "s")).select(id_, "chunk", F.expr(f"substring(`{text}`, s.start + 1, s.end - s.start)").alias("text"))

    def run(frames):
        for frame in frames:
            vectors = embed(frame["text"].tolist())
            if any(len(v) != size for v in vectors):
                raise ValueError(f"a vector hasn't {size} numbers")
            yield frame.assign(embedding=vectors)

    kind = chunks.schema[id_].dataType.simpleString()
    chunks.mapInPandas(run, f"`{id_}` {kind}, chunk int, text string, embedding array<float>").write.mode("overwrite").parquet(path)


def restore(spark: SparkSession, path: str, target: str) -> int:
    """Copy a snapshot to where it was taken from, and verify it."""
    return snapshot(spark.read.parquet(path), target)

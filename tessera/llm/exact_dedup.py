"""Exact dedup by content-defined chunk recipes, in DataFrame functions alone.

A normalised text is cut where its content says so: behind the first sentence mark once a chunk has
MIN_CHUNK characters, or at MAX_CHUNK. Equal texts have equal chunks, so a text is known by its recipe, the
ordered list of its chunks' identifiers, and only recipes move, never long texts. An identifier is the
first 64 bits of the chunk's SHA-256; a dictionary over all chunks verifies that no two digests share an
identifier, and if any do, whole digests are compared instead.

Defined results: null counts as empty; all empty texts are one group. Rows with the same doc_id and text
stand for one document each, and the row that stays is known by its doc_id alone, so all rows of its doc_id in
the group are marked as kept; keep_first() has one of them. A null doc_id loses every tie. Very long texts
become long recipes and are never cut off. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_hot, materialise

MIN_CHUNK = 1024
MAX_CHUNK = 8192
WHITE_SPACE = r"[\x20\x09-\x0D]+"
_CHUNK = rf"(?s).{{{MIN_CHUNK - 1},{MAX_CHUNK - 1}}}?[.!?;:。，]|.{{1,{MAX_CHUNK}}}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def chunks(text: Column) -> Column:
    """Content-defined chunks of a normalised text, in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(_CHUNK), F.lit(0))


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, n_points (code points of the text), text_sha256 and the digests of the chunks, in order."""
    base = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"), normalised(F.col("text")).alias("norm"))
    return base.select("doc_id", "n_points", F.sha2("norm", 256).alias("text_sha256"), F.transform(chunks(F.col("norm")), lambda c: F.unhex(F.sha2(c, 256))).alias("digests"))


def chunk_id(digest: Column) -> Column:
    return F.conv(F.hex(F.substring(digest, 1, 8)), 16, -10).cast("long")


def conflicting(rows: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one digest."""
    each = rows.select(F.explode(F.array_distinct("digests")).alias("digest"))
    return each.groupBy(chunk_id(F.col("digest")).alias("id")).agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo != hi").select("id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; see the module for what counts as equal."""
    rows = materialise(recipes(docs), "recipes")
    verified = conflicting(rows).isEmpty()
    rows = rows.withColumn("recipe", F.transform("digests", chunk_id) if verified else F.col("digests"))
    # of equal texts: most code points, then smallest id; a null id counts as larger than any
    rank = F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"))
    groups = rows.groupBy("recipe").agg(F.min(rank).alias("first"), F.count("*").alias("group_size")).select("recipe", F.col("first.i").alias("keep_id"), "group_size", F.col("group_size").alias("n"))
    return join_hot(rows, groups, ["recipe"], rows.count()).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """All columns of one row of each group: of the row that stays, and of rows that are fully equal to it in doc_id and text any one."""
    names = docs.columns
    groups = deduplicate(docs).filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own = {n: F.col(f"c{i}") for i, n in enumerate(names)}
    rows = rows.withColumns({"__own": F.sha2(normalised(own["text"]), 256), "__n": F.length(F.coalesce(own["text"], F.lit("")))})
    rows = rows.join(groups, own["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha")), "left_semi")
    columns = F.struct(*own.values())
    best = rows.groupBy("__own").agg(F.max_by(columns, "__n").alias("row"))
    return best.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])

"""Merges that write: rows of the tables merged into versioned tables batch by batch, and what these hold then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import resolve
from tessera.plans.queries import _REPORT_SQL, _TX, C, _reports, query, table, transactions
from tessera.sources.store import folder
from tessera.sources.versions import Change, Versions


def _tables(spark: SparkSession, name: str) -> Versions:
    return Versions(spark, f"{folder(spark)}/{name}-{uuid.uuid4().hex}")


@query(
    """WITH e AS (SELECT o_orderstatus AS type, 'C' || o_custkey AS src, o_orderpriority AS dst, o_orderkey AS seq, CASE WHEN o_totalprice > 150000 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || '-' || o_orderkey END AS quote, year(o_orderdate) < 1995 AS early FROM orders),
    s AS (SELECT type, src, dst, early, max_by(price, seq) FILTER (price IS NOT NULL) AS price, max_by(quote, seq) FILTER (quote IS NOT NULL) AS quote, max(seq) AS seq FROM e GROUP BY ALL)
    SELECT type, src, dst, coalesce(max(CASE WHEN NOT early THEN price END), max(CASE WHEN early THEN price END)) AS price, coalesce(max(CASE WHEN NOT early THEN quote END), max(CASE WHEN early THEN quote END)) AS quote FROM s GROUP BY ALL"""
)
def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges merged in two batches by ends and type: of every property the last value that is told."""
    price, quote = F.when(C("o_totalprice") > 150000, C("o_totalprice")), F.when(C("o_orderkey") % 3 == 0, F.concat_ws("-", "o_orderpriority", C("o_orderkey").cast("string")))
    rows = table(spark, sf_dir, "orders").select(C("o_orderstatus").alias("type"), F.concat(F.lit("C"), C("o_custkey").cast("string")).alias("src"), C("o_orderpriority").alias("dst"), C("o_orderkey").alias("seq"), price.alias("price"), quote.alias("quote"), (F.year("o_orderdate") < 1995).alias("early"))
    tables = _tables(spark, "edges")
    for number, part in enumerate((rows.filter("early"), rows.filter("not early"))):
        tables.merge([Change("edges", part.drop("early"), "type", ["src", "dst"], "seq", keep=True)], "orders", number)
    return tables.read("edges").select("type", "src", "dst", "price", "quote")


@query(
    """WITH c AS (SELECT l_returnflag AS type, 'P' || l_partkey AS src, 'S' || l_suppkey AS dst, l_linestatus = 'F' AS first, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT type, src, dst, coalesce(max(CASE WHEN NOT first THEN n END), max(n)) AS n, CASE WHEN bool_or(NOT first) THEN 'second' ELSE 'first' END AS method FROM c GROUP BY ALL"""
)
def merged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of co-mentions set by a second batch where it has the edge; others stay."""
    rows = table(spark, sf_dir, "lineitem").groupBy(C("l_returnflag").alias("type"), F.concat(F.lit("P"), C("l_partkey").cast("string")).alias("src"), F.concat(F.lit("S"), C("l_suppkey").cast("string")).alias("dst"), "l_linestatus").agg(F.count("*").alias("n"))
    tables = _tables(spark, "counts")
    for number, (status, method) in enumerate((("F", "first"), ("O", "second"))):
        part = rows.filter(C("l_linestatus") == status).drop("l_linestatus").withColumn("method", F.lit(method))
        tables.merge([Change("edges", part, "type", ["src", "dst"])], "lines", number)
    return tables.read("edges").select("type", "src", "dst", "n", "method")


@query(
    f"""WITH r AS ({_REPORT_SQL}), m AS (SELECT c_custkey, CASE WHEN contains(lower(t), 'operating margin') THEN 'operating_margin' END AS metric, regexp_extract(t, 'margin was ([0-9]+[.][0-9]+%)', 1) AS value FROM r),
    n AS (SELECT c_custkey || '|' || value AS name, metric, CAST(rtrim(value, '%') AS DOUBLE) AS value FROM m WHERE metric IS NOT NULL)
    SELECT 'METRIC' AS label, name, max(value) AS value, '%' AS unit, NULL AS target FROM n GROUP BY name UNION ALL SELECT DISTINCT 'METRIC_DEFINITION', metric, NULL, NULL, NULL FROM n
    UNION ALL SELECT DISTINCT 'SAME_AS', name, NULL, NULL, metric FROM n"""
)
def merged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that name a metric make its node, with value and unit, its definition, and an edge between them, all in one commit."""
    found = _reports(spark, sf_dir).filter(F.contains(F.lower("t"), F.lit("operating margin"))).select(C("c_custkey").cast("string").alias("k"), F.regexp_extract("t", "margin was ([0-9]+[.][0-9]+%)", 1).alias("v"))
    found = found.select(F.concat_ws("|", "k", "v").alias("name"), F.lit("operating_margin").alias("metric"), F.rtrim("v", F.lit("%")).cast("double").alias("value"))
    metrics = found.select(F.lit("METRIC").alias("label"), "name", "value", F.lit("%").alias("unit"), C("value").alias("seq"))
    named = found.select(F.lit("METRIC_DEFINITION").alias("label"), C("metric").alias("name"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(0.0).alias("seq"))
    same = found.select(F.lit("SAME_AS").alias("type"), C("name").alias("src"), C("metric").alias("dst"))
    tables = _tables(spark, "metrics")
    tables.merge([Change("nodes", metrics.unionByName(named), "label", ["name"], "seq"), Change("edges", same, "type", ["src", "dst"])])
    at = tables.snapshot()
    none = lambda kind: F.lit(None).cast(kind)
    nodes = tables.read("nodes", at=at).select("label", "name", "value", "unit", none("string").alias("target"))
    return nodes.unionByName(tables.read("edges", at=at).select(C("type").alias("label"), C("src").alias("name"), none("double").alias("value"), none("string").alias("unit"), C("dst").alias("target")))


@query(
    f"""{_TX}, f AS (SELECT DISTINCT insider, accession, CAST(d AS VARCHAR) AS d, code, shares, symbol FROM t)
    SELECT type, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets, min(md5(src || '>' || dst)) AS digest FROM (
    SELECT 'FILED' AS type, insider AS src, concat_ws('|', accession, d, code, CAST(CAST(shares AS BIGINT) AS VARCHAR)) AS dst FROM f UNION SELECT 'INVOLVES', concat_ws('|', accession, d, code, CAST(CAST(shares AS BIGINT) AS VARCHAR)), symbol FROM f) GROUP BY type"""
)
def merged_insiders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings whose nodes and edges are known by all their properties: merged twice over, they are there once."""
    rows = transactions(spark, sf_dir).select("insider", F.concat_ws("|", "accession", C("d").cast("string"), "code", C("shares").cast("long").cast("string")).alias("filing"), "symbol")
    edges = rows.select(F.lit("FILED").alias("type"), C("insider").alias("src"), C("filing").alias("dst")).union(rows.select(F.lit("INVOLVES"), C("filing"), C("symbol")))
    tables = _tables(spark, "insiders")
    for number in (0, 1):
        tables.merge([Change("edges", edges, "type", ["src", "dst"])], "filings", number)
    found = tables.read("edges")
    return found.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"), F.min(F.md5(F.concat_ws(">", "src", "dst"))).alias("digest"))


@query(
    """SELECT label, id, count(*) AS copies FROM (SELECT 'STATEMENT' AS label, turn || '-' || role AS id FROM conversations UNION ALL SELECT 'STATEMENT', turn || '-' || role FROM conversations WHERE turn = 0) GROUP BY ALL"""
)
def created_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements are created and never merged, so equal ids of several texts stand side by side."""
    rows = table(spark, sf_dir, "conversations").select(F.lit("STATEMENT").alias("label"), F.concat_ws("-", C("turn").cast("string"), "role").alias("id"), "turn")
    tables = _tables(spark, "statements")
    tables.merge([Change("nodes", rows.drop("turn"), "label")], "talks", 0)
    tables.merge([Change("nodes", rows.filter("turn = 0").drop("turn"), "label")], "talks", 1)
    tables.merge([Change("nodes", rows.drop("turn"), "label")], "talks", 1)  # comes again after a failure
    return tables.read("nodes").groupBy("label", "id").agg(F.count("*").alias("copies"))


@query()
def similar_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of names of parts, nations and regions that are like enough or hold one another, none lost."""
    part, nation, region = (table(spark, sf_dir, t) for t in ("part", "nation", "region"))
    names = part.select(F.lower("p_name").alias("plain")).union(nation.select(F.lower("n_name"))).union(region.select(F.lower("r_name"))).distinct().withColumn("kind", F.lit("name"))
    return resolve.similar_names(names, names, ["kind"], 0.85).filter("plain < other").select("plain", "other", F.round("score", 6).alias("score"))

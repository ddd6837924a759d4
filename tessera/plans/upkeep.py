"""Construction, source lists, checkpoints and evaluation, each with the oracle's SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import answers as an
from tessera.functions import evaluation as ev
from tessera.functions import extract as ex
from tessera.functions import resolve as rs
from tessera.functions import text as tx
from tessera.functions.fields import field_query
from tessera.operators import graph as go
from tessera.operators import intervals as iv
from tessera.plans.queries import _PER, _PRED, _REPORT_SQL, _TX, C, _fills, _named, _predictions, _reports, query, table, transactions

# --- spans -------------------------------------------------------------------------------------------------

_SPANS = "WITH s AS (SELECT l_orderkey AS doc, l_returnflag AS kind, CAST(l_quantity AS BIGINT) AS start, CAST(l_quantity AS BIGINT) + CASE l_returnflag WHEN 'A' THEN 20 ELSE 5 END AS \"end\", row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS i FROM lineitem)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span for each order line: long ones for one flag, short ones for the others."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").withColumn("i", F.row_number().over(order))
    start = C("l_quantity").cast("long")
    return rows.select(C("l_orderkey").alias("doc"), C("l_returnflag").alias("kind"), start.alias("start"), (start + F.when(C("l_returnflag") == "A", 20).otherwise(5)).alias("end"), "i")


@query(
    _SPANS + """ SELECT a.doc, a.i, b.start AS outer_start, b.\"end\" AS outer_end FROM s a
    JOIN s b ON a.doc = b.doc AND a.kind = 'N' AND b.kind = 'A' AND a.start >= b.start AND a.\"end\" <= b.\"end\"
    QUALIFY row_number() OVER (PARTITION BY a.doc, a.i ORDER BY b.start, b.\"end\") = 1"""
)
def contained_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spans(spark, sf_dir)
    return iv.contained_first(s.filter("kind = 'N'").drop("kind"), s.filter("kind = 'A'").select("doc", "start", "end"), ["doc"], "i").select("doc", "i", "outer_start", "outer_end")


@query(_SPANS + " SELECT doc, i, start FROM s a WHERE kind = 'R' AND NOT EXISTS (SELECT 1 FROM s b WHERE b.doc = a.doc AND b.kind = 'N' AND a.start < b.\"end\" AND a.\"end\" > b.start)")
def free_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spans(spark, sf_dir)
    return iv.not_overlapping(s.filter("kind = 'R'"), s.filter("kind = 'N'"), ["doc"]).select("doc", "i", "start")


@query(_SPANS + " SELECT b.doc, b.i, count(*) AS n FROM s a JOIN s b ON a.doc = b.doc AND a.kind <> 'A' AND b.kind = 'A' AND a.start >= b.start AND a.start < b.\"end\" GROUP BY ALL")
def points_in_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spans(spark, sf_dir)
    points = s.filter("kind != 'A'").select("doc", C("start").alias("at"))
    return iv.at_points(points, s.filter("kind = 'A'").select("doc", "i", "start", "end"), ["doc"], "at").groupBy("doc", "i").agg(F.count("*").alias("n"))


@query(_SPANS + " SELECT doc, i FROM (SELECT *, max(\"end\") OVER (PARTITION BY doc ORDER BY start, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s) WHERE m IS NULL OR \"end\" > m")
def extending_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.extending(_spans(spark, sf_dir), ["doc"], ["start", "i"]).select("doc", "i")


@query(
    """SELECT conv_id, turn, role, n FROM (SELECT DISTINCT conv_id, turn, role, text, len(regexp_extract_all(text, '[A-Z][a-z]+')) AS n FROM conversations)
    QUALIFY row_number() OVER (PARTITION BY role ORDER BY n DESC, conv_id || '-' || turn || '-' || md5(text)) <= 30"""
)
def richest_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").distinct()
    rows = rows.withColumn("n", F.regexp_count("text", F.lit("[A-Z][a-z]+")).cast("long")).withColumn("o", F.concat_ws("-", C("conv_id").cast("string"), C("turn").cast("string"), F.md5("text")))
    return iv.richest(rows, ["role"], "n", "o", 30).select("conv_id", "turn", "role", "n")


# --- construction ------------------------------------------------------------------------------------------

_BASE = "base AS (SELECT o_custkey AS ticker, year(o_orderdate) AS year, o_orderpriority AS section, o_totalprice AS v, o_orderkey AS k FROM orders WHERE o_orderstatus = 'F'), fresh AS (SELECT o_custkey AS ticker, year(o_orderdate) AS year, o_orderpriority AS section, o_totalprice AS v, o_orderkey AS k FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '1%')"


def _filed(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").filter(C("o_orderstatus") == status)
    return rows.select(C("o_custkey").alias("ticker"), F.year("o_orderdate").cast("long").alias("year"), C("o_orderpriority").alias("section"), C("o_totalprice").alias("v"), C("o_orderkey").alias("k"))


@query(f"WITH {_BASE} SELECT * FROM base b WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.ticker = b.ticker AND f.year = b.year) UNION ALL SELECT * FROM fresh")
def replace_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete and insert: rows of a filing that comes anew make way for it."""
    fresh = _filed(spark, sf_dir, "O").filter(C("section").startswith("1"))
    return _filed(spark, sf_dir, "F").join(fresh.select("ticker", "year").distinct(), ["ticker", "year"], "left_anti").unionByName(fresh)


@query(
    f"""WITH {_BASE}, c AS (SELECT ticker, section, count(*) AS n FROM base GROUP BY ALL), d AS (SELECT ticker, section, count(*) AS n FROM fresh
    GROUP BY ALL) SELECT coalesce(c.ticker, d.ticker) AS ticker, coalesce(c.section, d.section) AS section, coalesce(d.n, c.n) AS n, CASE WHEN d.n IS NULL THEN 'kept' WHEN c.n IS NULL THEN 'added' ELSE 'set' END AS outcome
    FROM c FULL JOIN d ON c.ticker = d.ticker AND c.section = d.section"""
)
def bulk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts merged in one set: known edges get the new count, others are added."""
    count = lambda df: df.groupBy("ticker", "section").agg(F.count("*").alias("n"))
    return go.merge_counts(count(_filed(spark, sf_dir, "F")), count(_filed(spark, sf_dir, "O").filter(C("section").startswith("1"))), ["ticker", "section"], "n")


@query(
    """SELECT ticker || '_' || year || '_' || section AS section_id, max(price) AS price, count(*) AS n
    FROM (SELECT o_custkey AS ticker, coalesce(nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(year(o_orderdate) AS VARCHAR) END, ''), nullif(CASE WHEN o_orderkey % 2 = 0 THEN CAST(year(o_orderdate) + 1 AS VARCHAR) END, ''), CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y') END, 'UNKNOWN') AS year, o_orderpriority AS section, o_totalprice AS price
    FROM orders) GROUP BY ALL"""
)
def section_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section's key, with the first year that is told anywhere."""
    o, k, year = table(spark, sf_dir, "orders"), C("o_orderkey"), F.year("o_orderdate")
    told = go.first_told(F.when(k % 3 == 0, "").otherwise(year.cast("string")), F.when(k % 2 == 0, (year + 1).cast("string")), F.when(k % 5 != 0, F.date_format("o_orderdate", "yyyy")), default="UNKNOWN")
    return o.groupBy(F.concat_ws("_", C("o_custkey").cast("string"), told, "o_orderpriority").alias("section_id")).agg(F.max("o_totalprice").alias("price"), F.count("*").alias("n"))


@query(
    f"""WITH r AS ({_REPORT_SQL}), m AS (SELECT c_custkey, CASE WHEN contains(lower(t), 'operating margin') THEN 'operating_margin' END AS metric, regexp_extract(t, 'margin was ([0-9]+[.][0-9]+%)', 1) AS value
    FROM r) SELECT kind, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT 'METRIC' AS kind, c_custkey || '|' || value AS id FROM m
    UNION ALL SELECT 'METRIC_DEFINITION', metric FROM m UNION ALL SELECT 'SAME_AS', c_custkey || '|' || value || '>' || metric FROM m) GROUP BY kind"""
)
def metric_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text that names a metric makes a node of it, its definition, and an edge between them."""
    rows = _reports(spark, sf_dir).select(C("c_custkey").cast("string").alias("k"), F.when(F.contains(F.lower("t"), F.lit("operating margin")), "operating_margin").alias("metric"), F.regexp_extract("t", "margin was ([0-9]+[.][0-9]+%)", 1).alias("value"))
    return go.metric_rows(rows, "k", "value", "metric").groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query(
    f"""{_TX} SELECT cik, accession, md5(array_to_string(list(line ORDER BY line), ' ')) AS digest, count(*) AS n
    FROM (SELECT cik, accession, concat_ws(' ', 'Insider: ' || insider, 'Issuer: ' || company, 'Code: ' || code, CASE WHEN shares > 25 THEN 'Shares: ' || CAST(CAST(shares AS BIGINT) AS VARCHAR) END, 'Security: ' || security) AS line
    FROM t) GROUP BY ALL"""
)
def insider_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled fragments of a filing in a fixed order; what is missing is skipped."""
    line = ex.labelled_text({"Insider": C("insider"), "Issuer": C("company"), "Code": C("code"), "Shares": F.when(C("shares") > 25, C("shares").cast("long").cast("string")), "Security": C("security")})
    rows = transactions(spark, sf_dir).select("cik", "accession", line.alias("line"))
    return rows.groupBy("cik", "accession").agg(F.md5(F.array_join(F.array_sort(F.collect_list("line")), " ")).alias("digest"), F.count("*").alias("n"))


@query(
    f"""{_TX} SELECT kind AS label, count(*) AS n FROM (SELECT DISTINCT 'PERSON' AS kind, insider AS e FROM t UNION SELECT 'ORG', company FROM t
    UNION SELECT 'DATE', CAST(d AS VARCHAR) FROM t UNION SELECT 'CODE', code FROM t UNION SELECT 'SECURITY', security FROM t) GROUP BY kind"""
)
def insider_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct structured entities of filings by label; a transaction may come again, its entities count once."""
    found = ex.structured_entities(_named(spark, sf_dir, _fills(spark, sf_dir)), {"PERSON": "insider", "ORG": "company", "DATE": "d", "CODE": "code", "SECURITY": "security"})
    return found.groupBy("label").agg(F.count("*").alias("n"))


@query(
    f"""{_TX} SELECT insider, symbol, CASE WHEN acctbal > 5000 THEN 'director' ELSE 'officer' END AS position, count(*) AS filings
    FROM (SELECT DISTINCT t.insider, t.symbol, t.accession, c_acctbal AS acctbal FROM t JOIN customer ON cik = 'C' || c_custkey) GROUP BY ALL
    ORDER BY filings DESC, insider, symbol LIMIT 100"""
)
def holds_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One HOLDS_POSITION for insider and issuer, from the filings that tell it."""
    who = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), C("c_custkey").cast("string")).alias("cik"), F.when(C("c_acctbal") > 5000, "director").otherwise("officer").alias("position"))
    rows = transactions(spark, sf_dir).select("cik", "insider", "symbol", "accession").distinct().join(who, "cik")
    return go.top(rows.groupBy("cik", "insider", "symbol", "position").agg(F.count("*").alias("filings")).drop("cik"), F.desc("filings"), C("insider"), C("symbol"), n=100)


@query("SELECT count(*) AS n FROM (SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice > 1000)")
def parallel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of sections are put one behind the other; what both have counts twice."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    both = o.filter("o_orderstatus = 'F'").unionByName(o.filter("o_totalprice > 1000"))
    return both.agg(F.count("*").alias("n"))


@query()
def resolved_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by an exact name, then a similar one of the sentence, then of the document, else a new entity."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    known = nation.select(C("n_regionkey").alias("doc"), C("n_nationkey").alias("sentence"), C("n_name").alias("name"), F.lit("GPE").alias("label"))
    asked = nation.select(C("n_regionkey").alias("doc"), C("n_nationkey").alias("sentence"), F.concat(C("n_name"), F.lit(" Inc")).alias("ref"))
    asked = asked.union(region.select(C("r_regionkey").alias("doc"), F.lit(0), C("r_name").alias("ref"))).withColumn("sentence", C("sentence").cast("int"))
    return rs.resolve_entities(asked, known, "doc", "sentence").select("doc", "sentence", "ref", "name", "label", "how")


# --- lists of sources --------------------------------------------------------------------------------------


@query("SELECT s, y, q FROM (SELECT DISTINCT n_name AS s FROM nation WHERE n_nationkey < 5), (SELECT unnest(range(2020, 2023)) AS y), (SELECT unnest(range(1, 5)) AS q)")
def work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol, year and quarter; years and quarters are arrays of a row, so nothing is joined."""
    symbols = table(spark, sf_dir, "nation").filter("n_nationkey < 5").select(C("n_name").alias("s")).distinct()
    years, quarters = (F.sequence(F.lit(a).cast("long"), F.lit(b).cast("long")) for a, b in ((2020, 2022), (1, 4)))
    return symbols.select("s", F.explode(years).alias("y")).select("s", "y", F.explode(quarters).alias("q"))


@query(
    """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS filed FROM orders
    WHERE o_orderpriority LIKE '%HIGH' AND o_orderstatus NOT IN ('P', 'X') ORDER BY o_orderdate DESC, o_orderkey LIMIT 10"""
)
def annual_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").filter(C("o_orderpriority").endswith("HIGH") & ~C("o_orderstatus").isin("P", "X"))
    return go.top(rows, F.desc("o_orderdate"), C("o_orderkey"), n=10).select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("filed"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (7, 11) AND o_orderdate >= '1996-01-01' AND o_orderdate <= '1998-12-31' AND NOT (o_orderstatus = 'P' OR o_totalprice > 300000)")
def field_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return o.filter(field_query("o_custkey:(7 OR 11) AND day:[1996-01-01 TO \"1998-12-31 00:00:00\"] AND NOT (o_orderstatus:P OR o_totalprice:>300000)".replace('"', ""), o.schema)).select("o_orderkey")


@query("SELECT event_type, count(*) AS n, min(json_extract_string(props, '$.k')) AS least FROM events WHERE regexp_matches(event_type, '^(click|sign).*') GROUP BY event_type")
def key_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").filter(C("event_type").rlike("^(click|sign).*"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.min(F.get_json_object("props", "$.k")).alias("least"))


@query(
    """SELECT doc_id, 'en/' || strftime(DATE '2020-01-01' + CAST(doc_id % 1000 AS INT), '%Y') || '/' || source || '_' || strftime(DATE '2020-01-01' + CAST(doc_id % 1000 AS INT), '%Y%m%d') || '_' || substring(md5(CAST(doc_id AS VARCHAR)), 1, 8) || '.json' AS path, substring(sha256(coalesce(text, '')), 1, 16) AS cache_key, strftime(DATE '2020-01-01' + CAST(doc_id % 1000 AS INT), '%b %d, %Y') AS shown, strftime(DATE '2020-01-01' + CAST(doc_id % 1000 AS INT), '%a') AS day
    FROM documents WHERE lang = 'en'"""
)
def object_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of stored objects, keys by content, and dates as they are shown."""
    day = F.date_add(F.lit("2020-01-01").cast("date"), (C("doc_id") % 1000).cast("int"))
    path = tx.object_path(F.lit("en"), "source", day, C("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id", path.alias("path"), tx.content_key("text").alias("cache_key"), F.date_format(day, "MMM dd, yyyy").alias("shown"), F.date_format(day, "E").alias("day"))


@query(
    """SELECT count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last, strftime(list_sort(list(ts))[CAST(floor(count(ts) / 2) AS INT) + 1], '%Y-%m-%d %H:%M:%S.%f') AS middle, (count(*) - count(ts))::BIGINT AS missing
    FROM events"""
)
def timestamp_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order statistics of a time from counts of its values; ranks are running sums over blocks of the times."""
    by = table(spark, sf_dir, "events").groupBy("ts").agg(F.count("*").alias("c"))
    totals = by.agg(F.sum("c").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.coalesce(F.sum(F.when(C("ts").isNull(), C("c"))), F.lit(0)).alias("missing"))
    ranked = iv.running(by.filter("ts is not null"), [], [C("ts")], {"before": ("sum", "c")})
    middle = ranked.crossJoin(F.broadcast(totals)).filter(C("before") + C("c") > F.floor((C("n") - C("missing")) / 2)).agg(F.min("ts").alias("middle"))  # one row
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return totals.crossJoin(F.broadcast(middle)).select("n", shown("first").alias("first"), shown("last").alias("last"), shown("middle").alias("middle"), "missing")


@query(
    """SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS duration, sum(CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END)::BIGINT AS errors, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS first, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last
    FROM orders GROUP BY ALL"""
)
def checkpoint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda x: F.to_date(x).cast("string")
    rows = table(spark, sf_dir, "orders").groupBy(C("o_orderstatus").alias("status"))
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("duration"), F.sum((C("o_totalprice") > 400000).cast("long")).alias("errors"), day(F.min("o_orderdate")).alias("first"), day(F.max("o_orderdate")).alias("last"))


@query(
    """SELECT source, count(*) AS n, min(b) AS least, max(b) AS most, list_sort(list(b))[CAST(floor(len(list(b)) / 2) AS INT) + 1] AS upper_median, round(avg(w), 4) AS mean_words
    FROM (SELECT source, strlen(coalesce(text, '')) AS b, len(regexp_extract_all(coalesce(text, ''), '[^\\s]+')) AS w FROM documents) GROUP BY source"""
)
def size_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and words by source; the median from counts of distinct sizes."""
    rows = table(spark, sf_dir, "documents").select("source", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("b"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\s]+")).alias("w"))
    by = rows.groupBy("source", "b").agg(F.count("*").alias("c"), F.sum("w").alias("w"))
    by = by.withColumn("u", F.sum("c").over(Window.partitionBy("source").orderBy("b"))).withColumn("n", F.sum("c").over(Window.partitionBy("source")))
    return by.groupBy("source").agg(F.sum("c").alias("n"), F.min("b").alias("least"), F.max("b").alias("most"), F.min(F.when(C("u") > F.floor(C("n") / 2), C("b"))).alias("upper_median"), F.round(F.sum("w") / F.sum("c"), 4).alias("mean_words"))


# --- evaluation --------------------------------------------------------------------------------------------


@query(
    _PER + """, f AS (SELECT support, p, r, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f
    FROM m) SELECT round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1, round(sum(p * support) / sum(support), 6) AS weighted_precision, round(sum(r * support) / sum(support), 6) AS weighted_recall, round(sum(f * support) / sum(support), 6) AS weighted_f1, (SELECT round(avg(CASE WHEN t = pr THEN 1.0 ELSE 0.0 END), 6)
    FROM p) AS micro_f1 FROM f"""
)
def averaged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.micro_macro(ev.confusion(_predictions(spark, sf_dir)))


@query(
    _PRED + """ SELECT t AS class, count(*) AS support, round(avg(CASE WHEN t = pr THEN 1.0 ELSE 0.0 END), 6) AS accuracy, CASE WHEN sum(CASE WHEN t = pr THEN 1 ELSE 0 END) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS precision
    FROM p GROUP BY t"""
)
def masked_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.masked_metrics(_predictions(spark, sf_dir))


@query(
    """WITH p AS (SELECT p_type AS t, p_brand AS pr FROM part), k AS (SELECT t FROM p GROUP BY t
    ORDER BY count(*) DESC, t LIMIT 3) SELECT t AS \"true\", pr AS pred, count(*) AS cnt FROM p WHERE t IN (SELECT t FROM k) GROUP BY ALL"""
)
def confusion_of_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confusion(an.frequent_classes(table(spark, sf_dir, "part").select(C("p_type").alias("true"), C("p_brand").alias("pred")), 3))


@query(
    _PRED + """ SELECT round(avg(CASE WHEN t <> pr THEN 1.0 ELSE 0.0 END), 6) AS error_rate, round(avg(CASE WHEN t <> pr THEN conf END), 6) AS confidence_of_errors, round(avg(CASE WHEN t = pr THEN conf END), 6) AS confidence_of_hits
    FROM p"""
)
def error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = C("true") != C("pred")
    return _predictions(spark, sf_dir).agg(F.round(F.avg(wrong.cast("double")), 6).alias("error_rate"), F.round(F.avg(F.when(wrong, C("conf"))), 6).alias("confidence_of_errors"), F.round(F.avg(F.when(~wrong, C("conf"))), 6).alias("confidence_of_hits"))


_RUNS = "WITH r AS (SELECT event_id, event_type, value, event_type IN ('click', 'view') AS graph, event_type IN ('view', 'purchase') AS vec, value / 100 AS acc FROM events)"


@query(
    _RUNS + """ SELECT sum(CASE WHEN graph AND NOT vec THEN 1 ELSE 0 END)::BIGINT AS graph_only, sum(CASE WHEN vec AND NOT graph THEN 1 ELSE 0 END)::BIGINT AS vector_only, sum(CASE WHEN vec AND graph THEN 1 ELSE 0 END)::BIGINT AS both, sum(CASE WHEN NOT vec AND NOT graph THEN 1 ELSE 0 END)::BIGINT AS none
    FROM r"""
)
def tool_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = an.tools_used(C("event_type"), {"graph": ["^click$", "^view$"], "vector": ["^view$", "^purchase$"]})
    has = lambda x: F.array_contains("used", x)
    n = lambda x: F.sum(x.cast("long"))
    return table(spark, sf_dir, "events").select(used.alias("used")).agg(n(has("graph") & ~has("vector")).alias("graph_only"), n(has("vector") & ~has("graph")).alias("vector_only"), n(has("graph") & has("vector")).alias("both"), n(F.size("used") == 0).alias("none"))


@query(
    _RUNS + """ SELECT event_type, count(*) AS n, sum(CASE WHEN s >= 0.7 THEN 1 ELSE 0 END)::BIGINT AS passed, round(avg(s), 4) AS score, round(avg(h), 4) AS hallucination
    FROM (SELECT event_type, CASE WHEN graph AND vec THEN 0.9 WHEN event_id % 3 = 0 THEN 0.8 WHEN graph THEN 0.7 ELSE 0.6 END AS h, CASE WHEN event_id % 2 = 0 THEN 0.4 * acc + 0.2 * 0.5 + 0.3 * acc + 0.1 * 1.0 ELSE 0.6 * acc + 0.3 * 0.5 + 0.1 * 1.0 END AS s
    FROM r) GROUP BY event_type"""
)
def run_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of runs, how many pass, and the hallucination heuristic, by type."""
    graph, vec, acc = C("event_type").isin("click", "view"), C("event_type").isin("view", "purchase"), C("value") / 100
    score = an.overall(acc, F.lit(0.5), acc, F.lit(1.0), C("event_id") % 2 == 0)
    rows = table(spark, sf_dir, "events").select("event_type", score.alias("s"), an.hallucination(graph, C("event_id") % 3 == 0, vec).alias("h"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum((C("s") >= 0.7).cast("long")).alias("passed"), F.round(F.avg("s"), 4).alias("score"), F.round(F.avg("h"), 4).alias("hallucination"))


@query("SELECT item_id, md5(substring(text, 1, 50)) AS cut, md5(repeat(text, 10)) AS repeated, md5('!!! ' || text || ' ???') AS wrapped FROM benchmark ORDER BY item_id LIMIT 10")
def robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = go.top(table(spark, sf_dir, "benchmark"), C("item_id"), n=10).withColumn("v", an.robustness_inputs(C("text")))
    return rows.select("item_id", *[F.md5(C("v")[k]).alias(k) for k in ("cut", "repeated", "wrapped")])


@query(
    """SELECT vec_id, best, round(exp(v[best] - m) / list_sum(list_transform(v, lambda x: exp(x - m))), 6) AS p
    FROM (SELECT vec_id, v, list_max(v) AS m, list_position(v, list_max(v)) AS best FROM (SELECT vec_id, CAST(embedding[1:5] AS DOUBLE[]) AS v
    FROM embeddings))"""
)
def softmax_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest class and its probability."""
    v = F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).withColumn("p", an.softmax(C("v")))
    return rows.select("vec_id", F.array_position("v", F.array_max("v")).cast("int").alias("best"), F.round(F.array_max("p"), 6).alias("p"))


@query(
    r"""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS x
    FROM benchmark), g AS (SELECT a.item_id, 's' || a.item_id AS s, a.x, b.x AS y FROM w a
    JOIN w b ON b.item_id = a.item_id + 1), c AS (SELECT item_id, t, sum(p) AS p, sum(q) AS q FROM (SELECT item_id, unnest(x) AS t, 1 AS p, 0 AS q FROM g
    UNION ALL SELECT item_id, unnest(y), 0, 1 FROM g) GROUP BY ALL) SELECT item_id, round(2.0 * sum(least(p, q)) / sum(p + q), 6) AS rouge FROM c
    GROUP BY item_id"""
)
def rouge_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return ev.rouge_n(b.select("item_id", C("text").alias("a")).join(b.select((C("item_id") - 1).alias("item_id"), C("text").alias("b")), "item_id"), 1, "item_id", "a", "b")


@query()
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUGE-L of each benchmark item and the next one."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w"))
    both = b.select("item_id", C("w").alias("a")).join(b.select((C("item_id") - 1).alias("item_id"), C("w").alias("b")), "item_id")
    return both.select("item_id", F.round(an.rouge_l("a", "b"), 6).alias("rouge"))


@query("SELECT conv_id, turn, upper(substring(role, 1, 1)) || substring(role, 2) AS speaker, length(trim(text, E' \\t\\n\\x0b\\f\\r')) AS n FROM conversations WHERE text IS NOT NULL")
def lateral_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The speaker segments of conversations by a table function in SQL."""
    tx.register(spark)
    table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.initcap("role"), F.lit(": "), "text").alias("told")).createOrReplaceTempView("tessera_told")
    return spark.sql("SELECT conv_id, turn, s.speaker, length(s.text) AS n FROM tessera_told, LATERAL speaker_segments_of(told) s")

"""Readers of documents: filings, transcripts, nested insider filings, labelled CSV, feeds."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import section_key

INSIDER_SCHEMA = """accessionNo string, filedAt string, periodOfReport string, documentType string, issuer struct<cik:string,name:string,tradingSymbol:string>,
reportingOwner struct<cik:string,name:string,relationship:struct<isDirector:boolean,isOfficer:boolean,isTenPercentOwner:boolean,officerTitle:string>>,
nonDerivativeTable struct<transactions:array<struct<securityTitle:string,transactionDate:string,coding:struct<code:string>,amounts:struct<shares:double,pricePerShare:double,acquiredDisposedCode:string>>>>,
derivativeTable struct<transactions:array<struct<securityTitle:string,transactionDate:string,coding:struct<code:string>,amounts:struct<shares:double,pricePerShare:double,acquiredDisposedCode:string>,underlyingSecurity:struct<title:string,shares:double>>>>,
footnotes array<struct<id:string,text:string>>, remarks string"""


def listing(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """Paths under a folder, without reading contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return files.filter(F.col("path").endswith(suffix)) if suffix else files


def filings(files: DataFrame) -> DataFrame:
    """Distinct (symbol, year) of paths .../SYMBOL/YYYY/..., sorted."""
    rows = files.select(F.regexp_extract("path", r"/([A-Z0-9.\-]{1,10})/([0-9]{4})/", 1).alias("symbol"), F.regexp_extract("path", r"/([A-Z0-9.\-]{1,10})/([0-9]{4})/", 2).alias("year"))
    return rows.filter("symbol != ''").distinct().orderBy("symbol", "year")


def transcripts(files: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """(symbol, year, quarter) of paths SYMBOL/YYYY.Q.json that are not processed."""
    p = r"/([A-Z0-9.\-]{1,10})/([0-9]{4})\.([1-4])\.json$"
    rows = files.select(*[F.regexp_extract("path", p, i).alias(c) for i, c in enumerate(("symbol", "year", "quarter"), 1)]).filter("symbol != ''").distinct()
    rows = rows if processed is None else rows.join(processed, ["symbol", "year", "quarter"], "left_anti")
    return rows.orderBy("symbol", "year", "quarter")


def sections(files: DataFrame) -> DataFrame:
    """Section ids of a filing's files in reading order; ids without a number come last."""
    ids = files.select(F.regexp_replace(F.regexp_extract("path", r"/([^/]+)\.json$", 1), r"[^A-Za-z0-9]", "").alias("section"), "path")
    number, letter = section_key("section")
    return ids.orderBy(number, letter)


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    schema = "metadata map<string,string>, content string"
    return spark.read.schema(schema).option("multiLine", "true").json(path).select("*", F.input_file_name().alias("path"))


#: A string field of so many characters is taken for the body of a transcript that names none.
LONG_FIELD = 1000


def transcript_of(source: str | None) -> dict | None:
    """Fields of a transcript file: its object, or the first one of its list; the body is content, else transcript, else an object's first long string."""
    try:
        data = json.loads(source or "")
    except ValueError:
        return None
    first = data if isinstance(data, dict) else data[0] if isinstance(data, list) and data else None
    if not isinstance(first, dict):
        return None
    body = next((first[k] for k in ("content", "transcript") if k in first), None)
    if isinstance(data, dict) and not {"content", "transcript"} & first.keys():
        body = next((v for v in first.values() if isinstance(v, str) and len(v) > LONG_FIELD), None)
    if not body or not isinstance(body, str):
        return None
    told = {k: None if first.get(k) is None else str(first[k]) for k in ("symbol", "quarter", "year", "date")}
    return told | {"content": body}


_FIELDS = ("symbol", "quarter", "year", "date", "content")


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in _FIELDS]))
def _transcripts(source: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([transcript_of(x) or dict.fromkeys(_FIELDS) for x in source], columns=_FIELDS)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file with a body; the quarter may be written Q1, q1 or 1."""
    rows = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path).select(_transcripts("value").alias("t")).select("t.*").filter("content is not null")
    return rows.select("symbol", F.regexp_replace(F.upper("quarter"), "Q", "").try_cast("int").alias("quarter"), F.col("year").try_cast("int").alias("year"), "date", "content")


def read_insider(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INSIDER_SCHEMA).option("multiLine", "true").json(path)


def insider_transactions(filings: DataFrame) -> DataFrame:
    """One row for each transaction, derivative or not, with its filing's insider and company; at most one node each."""
    head = ["accessionNo", F.col("issuer.cik").alias("company_cik"), F.col("issuer.tradingSymbol").alias("symbol"), F.col("issuer.name").alias("company"), F.col("reportingOwner.cik").alias("insider_cik"), F.col("reportingOwner.name").alias("insider")]

    def of(table: str, kind: str) -> DataFrame:
        rows = filings.select(*head, F.posexplode(f"{table}.transactions").alias("seq", "t"))
        under = (F.col("t.underlyingSecurity.title"), F.col("t.underlyingSecurity.shares")) if kind == "derivative" else (F.lit(None).cast("string"), F.lit(None).cast("double"))
        return rows.select("accessionNo", "company_cik", "symbol", "company", "insider_cik", "insider", F.lit(kind).alias("transaction_type"), "seq", F.col("t.securityTitle").alias("security_type"), F.col("t.transactionDate").alias("transaction_date"), F.col("t.coding.code").alias("code"), F.col("t.amounts.shares").alias("shares"), F.col("t.amounts.pricePerShare").alias("price_per_share"), F.col("t.amounts.acquiredDisposedCode").alias("acquired_disposed"), under[0].alias("underlying_security"), under[1].alias("underlying_shares"))

    return of("nonDerivativeTable", "non_derivative").unionByName(of("derivativeTable", "derivative"))


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a text column, outer quotes stripped."""
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    if "text" not in rows.columns:
        raise ValueError("no text column")
    return rows.withColumn("text", F.expr("trim(BOTH '\"' FROM text)"))


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row for each link, with its kind by the first rule that fits."""
    rows = pages.withColumn("href", F.explode(F.regexp_extract_all(html, F.lit(r'href="([^"]+)"'), F.lit(1))))
    low = F.lower("href")
    kind = F.when(low.contains("minutes") & low.endswith(".htm"), "minutes_html").when(low.contains("minutes") & low.endswith(".pdf"), "minutes_pdf").when(low.endswith(".pdf"), "statements_pdf").when(low.contains("monetary"), "statements_html").otherwise("other")
    return rows.withColumn("kind", kind)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """A test set: text and integer label, whatever else the CSV has."""
    return read_labelled_csv(spark, path).select("text", F.col("label").try_cast("int").alias("label")).filter("label is not null")


def symbols(spark: SparkSession, path: str) -> DataFrame:
    """Distinct symbols of a JSON array."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("symbol"))
    return rows.filter("symbol is not null").distinct()


def read_json_of(spark: SparkSession, prefixes: list[str]) -> DataFrame:
    """Paths of the JSON files under several prefixes, each once."""
    return listing_of([listing(spark, p, ".json") for p in prefixes])


def listing_of(listings: list[DataFrame]) -> DataFrame:
    both = listings[0]
    for more in listings[1:]:
        both = both.unionByName(more)
    return both.dropDuplicates(["path"])


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS snapshots: title, link, published, category, and whether they are statements or minutes; a link comes once."""
    text = spark.read.text(path, wholetext=True)
    item = text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))).alias("x"))
    field = lambda tag: F.trim(F.regexp_extract("x", rf"(?s)<{tag}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{tag}>", 1))
    rows = item.select(field("title").alias("title"), field("link").alias("link"), field("pubDate").alias("published"), field("category").alias("category")).dropDuplicates(["link"])
    low = F.lower("title")
    return rows.withColumns({"is_statement": low.contains("statement"), "is_minutes": low.contains("minutes")})


def new_filings(found: DataFrame, stored_paths: DataFrame) -> DataFrame:
    """Filings with an accession number and a period whose path isn't stored yet."""
    return found.filter("accessionNo is not null and periodOfReport is not null").join(stored_paths.select("path"), "path", "left_anti")


def absolute_url(base: str, href: str) -> Column:
    """A link as the page at base means it: whole, from the scheme, from the host, or from the page's folder."""
    part = lambda pattern: F.regexp_extract(base, pattern, 1)
    link = F.col(href)
    return (
        F.when(link.rlike("^[A-Za-z]+://"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(part("^([A-Za-z]+:)//"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(part("^([A-Za-z]+://[^/?#]+)"), link))
        .otherwise(F.concat(part("^([A-Za-z]+://[^?#]*/)"), link))
    )


def page_meta(html: str) -> tuple[Column, Column]:
    """Title and published date of a page: of its meta elements the first that names a date, whatever the order of their attributes."""
    metas = F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0))
    dated = F.get(F.filter(metas, lambda m: m.rlike(r"(?i)(?:name|property)=\"[^\"]*(?:date|published)[^\"]*\"")), F.lit(0))
    title = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return title, F.nullif(F.regexp_extract(dated, r"(?i)content=\"([^\"]*)\"", 1), F.lit(""))


def sample(rows: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows drawn by a seeded hash of their keys: the same ones every time."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def meeting(title: Column | str) -> tuple[Column, Column]:
    """Date or range of days, and number, of the meeting that a title names; null where it names none."""
    day = F.regexp_extract(title, rf"(?:{MONTHS})\s+\d{{1,2}}(?:-\d{{1,2}})?,\s+\d{{4}}", 0)
    return F.nullif(day, F.lit("")), F.nullif(F.regexp_extract(title, r"(?i)meeting\s+(\d+)", 1), F.lit(""))

"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, exact_dedup, html_extract, jaccard_join, language_id, line_dedup, mixing, periodic_runs, sharding, token_alignment, token_files, toxicity, url_filter
from tessera.llm.common import table

#: The tree of sources and its weights: the language shares that the mix should have, sources alike within them.
MIX_LEVELS = {"domain": "if(source rlike '[02468]$', 'even', 'odd')", "lang": "lang", "source": "source"}
MIX_WEIGHTS = {("even",): 3, ("odd",): 2} | {(d, k): w for d in ("even", "odd") for k, w in {"en": 4, "de": 2, "fr": 2, "es": 2}.items()}
MIX_SHARE = 0.6
#: A single repeated line of any length is a match, as short boilerplate lines are.
LINE_WORDS = 1
#: Rules of the URL filter: fixed values of its contract.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(table(spark, sf_dir, "documents"), MIX_LEVELS, MIX_WEIGHTS, budget_share=MIX_SHARE, max_epochs=2).drop("text_key")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(table(spark, sf_dir, "documents"), min_words=LINE_WORDS)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokenize(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"), n=4, percent=85)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_texts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all documents, after a tenth of them got a repetition planted by their id."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), periodic_runs.word_count(F.col("text"))
    first = F.expr("g % n")
    planted = table(spark, sf_dir, "documents").select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, n).alias("n"))
    planted = planted.withColumn("first", F.when(F.col("n") > 0, first)).withColumn("period", 1 + F.floor((F.col("n") - F.col("first")) / (3 + F.col("g") % 8)))
    text = F.when(F.col("first").isNull(), F.col("text")).otherwise(periodic_runs.repeat_words(F.col("text"), F.col("first"), F.col("period")))
    return periodic_runs.summary(periodic_runs.detect(planted.select("doc_id", text.alias("text"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_mixing, op3_line_dedup, op4_exact_dedup, op5_html_extract, op6_decontamination, op7_token_files, op8_sharding, op9_jaccard_join, op10_language_id, op11_url_filter, op12_token_alignment, op13_periodic_runs)}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op6_decontamination": r"""
        WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
        win AS (SELECT item, least(10, len(w)) AS n, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' ')) END) AS x FROM item),
        uw AS (SELECT DISTINCT n, x FROM win),
        doc AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
        pos AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM doc, (SELECT DISTINCT n FROM uw) WHERE len(w) >= n),
        occ AS (SELECT p.doc_id, p.n, p.i, u.x FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x FROM pos) p JOIN uw u ON u.x = p.x AND u.n = p.n),
        hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM occ) GROUP BY doc_id),
        its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM occ JOIN win USING (n, x) GROUP BY doc_id)
        SELECT doc.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op13_periodic_runs": r"""
        WITH crc AS (SELECT list_transform(range(256), lambda c: list_reduce(list_concat([c], range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS t),
        d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
              xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))), lambda v, b: xor(t[1 + (xor(v, b) & 255)], v >> 8))) AS h FROM documents, crc),
        a AS (SELECT r, doc_id, w, h, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
        p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
        e AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
        pos AS (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS x FROM e),
        same AS (SELECT u.r, u.i, v.i - u.i AS q FROM pos u JOIN pos v ON u.r = v.r AND u.x = v.x AND u.i < v.i AND 4 * (v.i - u.i) <= u.n),
        island AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM same),
        run AS (SELECT r, start, length, min(q) AS period FROM (SELECT r, q, min(i) AS start, count(*) + q AS length FROM island GROUP BY r, q, k) WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
        best AS (SELECT r, start, length, period, row_number() OVER (PARTITION BY r ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS k FROM run),
        line AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM run GROUP BY r),
        gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run),
        kept AS (SELECT pos.r, string_agg(x, ' ' ORDER BY pos.i) AS s FROM pos ANTI JOIN gone ON pos.r = gone.r AND pos.i = gone.i GROUP BY pos.r)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(line.s, '')) AS runs_sha256, sha256(coalesce(kept.s, '')) AS collapsed_sha256
        FROM e LEFT JOIN line USING (r) LEFT JOIN (SELECT * FROM best WHERE k = 1) b USING (r) LEFT JOIN kept USING (r)""",
}

"""URL filter: rules, and for what no rule covers the ratio of two character language models.

URLs that a rule allows or blocks teach one model each, a Markov model of variable order: the probability of
a character after up to ORDER - 1 others is Witten-Bell smoothed, order by order, so a context counts as much as it
has been seen. A URL's score is the difference of its log-likelihoods under both, divided by its characters and
calibrated to a probability by logistic regression on the URLs of rules, each scored by models of the other
fold. Where no rule fits, a URL of probability MIN_BLOCKED or more is blocked.

A character's probability is known by the ORDER characters that end with it, so models are tables of distinct
n-grams: counts over all URLs, grouped once at the highest order, then order by order from the table before.
URLs meet them by joins; common n-grams, a bounded number, are broadcast. Nothing but the calibration's
histogram (at most two rows for each of 2 * BINS + 1 bins) comes to the driver.

Defined results: a null URL is empty; one without "://" has an empty host and path, so no rule, and is scored
whole. With URLs of one verdict only the method gives that one, with none `allow`, and the score 0.5. A rule is one of
few; of those that fit the longest wins, of equally long ones the first. Repeated rows get the same verdict
each. Very long URLs are scored whole. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_hot, materialise

ORDER = 5
#: Characters that are equally likely where nothing is known.
ALPHABET = 256
MIN_BLOCKED = 0.5
#: Bins of the calibration's histogram on either side of 0, and bins for a difference of 1 in a character's log-likelihood.
BINS, STEPS = 2048, 256
_FIXED_POINT = 1 << 20
_START, _END = "\x02", "\x03"

#: (host, path, verdict); a rule fits its host and all subdomains.
Rule = tuple[str, str, str]


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and the text that the models see: what follows "://", the host in lower case, or all where there is none."""
    url = F.coalesce(url, F.lit(""))
    has = F.contains(url, F.lit("://"))
    rest = F.when(has, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.translate(raw, ascii_uppercase, ascii_lowercase)
    after = F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1)
    path = F.regexp_extract(after, r"^[^?#]*", 0)
    return host, path, F.when(has, F.concat(host, after)).otherwise(url)


def match(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule (host and path together) and its verdict, null where none fits."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))[::-1]:
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found, verdict = F.when(fits, h + p).otherwise(found), F.when(fits, v).otherwise(verdict)
    return found, verdict


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """A row (row, model, gram) for each character of each URL and its end: the order characters that end with it."""
    chars = urls.select("row", "model", F.split(F.concat(F.lit(_START * (order - 1)), "text", F.lit(_END)), "").alias("chars"))
    n = F.size("chars") - (order - 1)
    shifted = [F.slice("chars", F.lit(i + 1), n).alias(f"c{i}") for i in range(order)]
    each = chars.select("row", "model", F.explode(F.arrays_zip(*shifted)).alias("g"))
    return each.select("row", "model", F.concat(*[F.col(f"g.c{i}") for i in range(order)]).alias("gram"))


#: Counts by class and fold; the models: of fold 1, which score fold 0, of fold 0, which score fold 1, and of both.
_COUNTS = ["allow0", "allow1", "block0", "block1"]
_MODELS = [("allow1", "block1"), ("allow0", "block0"), ("allow0 + allow1", "block0 + block1")]


def _ratios(counts: DataFrame, order: int) -> DataFrame:
    """(gram, n, r0, r1, r2): the log-ratio of block to allow of each n-gram's last character under each pair of models, in fixed point."""
    known = None
    columns = [(f"p{m}{c}", F.expr(pair[c])) for m, pair in enumerate(_MODELS) for c in (0, 1)]
    for k in range(1, order + 1):
        own = counts.groupBy(F.expr(f"right(gram, {k})").alias("gram")).agg(*[F.sum(c).alias(c) for c in _COUNTS])
        own = own.select("gram", F.expr(f"left(gram, {k - 1})").alias("context"), F.expr(f"right(gram, {k - 1})").alias("shorter"), *[e.alias(f"n_{p}") for p, e in columns])
        seen = own.groupBy("context").agg(*[F.sum(f"n_{p}").alias(f"all_{p}") for p, _ in columns], *[F.sum((F.col(f"n_{p}") > 0).cast("long")).alias(f"kinds_{p}") for p, _ in columns])
        both = own.join(seen, "context")
        both = both.join(known, "shorter") if known is not None else both.select("*", *[F.lit(1 / ALPHABET).alias(f"q_{p}") for p, _ in columns])
        smooth = [F.when(F.col(f"all_{p}") > 0, (F.col(f"n_{p}") + F.col(f"kinds_{p}") * F.col(f"q_{p}")) / (F.col(f"all_{p}") + F.col(f"kinds_{p}"))).otherwise(F.col(f"q_{p}")) for p, _ in columns]
        known = both.select(F.col("gram").alias("shorter"), *[e.alias(f"q_{p}") for e, (p, _) in zip(smooth, columns, strict=True)])
    ratio = lambda m: F.round((F.log(f"q_p{m}1") - F.log(f"q_p{m}0")) * _FIXED_POINT).cast("long")
    return known.select(F.col("shorter").alias("gram"), *[ratio(m).alias(f"r{m}") for m in range(3)]).join(counts.select("gram", "n"), "gram")


def _calibrated(bins: list[tuple[int, int, int]]) -> tuple[float, float]:
    """Offset and slope of the logistic regression of blocked on the score, from (bin, allowed, blocked)."""
    x, allowed, blocked = (np.array([b[i] for b in bins], float) for i in range(3))
    x = x / STEPS
    if not blocked.sum() or not allowed.sum():
        return (0.0, 0.0) if not len(bins) else (np.inf if blocked.sum() else -np.inf, 0.0)
    w, n = np.zeros(2), allowed + blocked
    rows = np.stack([np.ones_like(x), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ rows, -30, 30)))
        slope = rows @ (n * p - blocked) + 1e-3 * w
        step = np.linalg.solve((rows * (n * p * (1 - p) + 1e-9)) @ rows.T + 1e-3 * np.eye(2), slope)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def judge(pages: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url", order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict and score, the calibrated probability that the URL is one to block, of every row."""
    host, path, text = parts(F.col(url))
    rule, verdict = match(F.col("host"), F.col("path"), rules)
    urls = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), text.alias("text"))
    urls = urls.select("*", rule.alias("rule"), verdict.alias("told"), F.monotonically_increasing_id().alias("row"))
    urls = materialise(urls.withColumn("model", F.when(F.col("told").isNull(), 2).otherwise(F.crc32("text") % 2).cast("int")), "urls")
    grams = _grams(urls.select("row", "text", F.when(F.col("model") == 2, "").otherwise(F.col("told")).alias("t"), "model").withColumn("model", F.concat("t", "model")), order)
    counted = [F.sum((F.col("model") == c).cast("long")).alias(c) for c in _COUNTS]
    counts = materialise(grams.groupBy("gram").agg(F.count("*").alias("n"), *counted), "grams")
    ratios = materialise(_ratios(counts, order), "ratios")
    total = counts.agg(F.sum("n")).first()[0] or 0
    met = join_hot(grams, ratios, ["gram"], total)
    own = F.when(F.endswith("model", F.lit("0")), F.col("r0")).when(F.endswith("model", F.lit("1")), F.col("r1")).otherwise(F.col("r2"))
    scores = met.groupBy("row").agg((F.sum(own) / F.count("*") / _FIXED_POINT).alias("difference"))
    scored = materialise(urls.select("row", "page_id", "host", "path", "rule", "told").join(scores, "row"), "scores")
    place = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.round(F.col("difference") * STEPS).cast("int")))
    bins = scored.filter("told is not null").groupBy(place.alias("b")).agg(F.count_if(F.col("told") == "allow").alias("allowed"), F.count_if(F.col("told") == "block").alias("blocked")).collect()
    offset, slope = _calibrated(sorted(tuple(b) for b in bins))
    score = F.lit(1.0) / (1.0 + F.exp(-(F.lit(offset) + F.lit(slope) * F.col("difference"))))
    no_model = offset == 0 and slope == 0
    method = F.lit("allow") if no_model else F.when(F.col("score") >= MIN_BLOCKED, "block").otherwise("allow")
    return scored.withColumn("score", score).select("page_id", "host", "path", "rule", F.coalesce("told", method).alias("verdict"), "score")


def keep_allowed(pages: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", **options) -> DataFrame:
    """All columns of the pages whose URL is allowed; rows with one page_id stay or go together, if any is blocked, and null ids stay."""
    gone = judge(pages, rules, page_id, **options).filter("verdict = 'block'").select(F.col("page_id").alias("__gone")).distinct()
    return pages.join(gone, pages[page_id] == F.col("__gone"), "left_anti")

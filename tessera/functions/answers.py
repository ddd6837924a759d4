"""Scores and checks of an answering system's runs, and small steps around models."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hallucination(has_sources: Column, hedged: Column, grounded: Column) -> Column:
    """Heuristic score: 0.9 for grounded answers with sources, 0.8 for hedged ones, 0.7 with sources alone, 0.6 for the rest."""
    return F.when(has_sources & grounded, 0.9).when(hedged, 0.8).when(has_sources, 0.7).otherwise(0.6)


def overall(accuracy: Column, coverage: Column, similarity: Column, latency: Column, has_expected: Column) -> Column:
    """Weighted score; without an expected answer its similarity has no weight."""
    full = 0.4 * accuracy + 0.2 * coverage + 0.3 * similarity + 0.1 * latency
    return F.when(has_expected, full).otherwise(0.6 * accuracy + 0.3 * coverage + 0.1 * latency)


def robustness_inputs(text: Column) -> Column:
    """Variants of an input that should not break a model, by name."""
    return F.create_map(F.lit("cut"), F.substring(text, 1, 50), F.lit("repeated"), F.repeat(text, 10), F.lit("wrapped"), F.concat(F.lit("!!! "), text, F.lit(" ???")))


def softmax(scores: Column) -> Column:
    """Probabilities of an array of scores."""
    top = F.array_max(scores)
    weights = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(weights, lambda x: x / F.aggregate(weights, F.lit(0.0), lambda a, y: a + y))


def tools_used(text: Column, patterns: dict[str, Sequence[str]]) -> Column:
    """Names of the tools whose patterns a text meets, in order."""
    return F.array_compact(F.array(*[F.when(F.lower(text).rlike("|".join(ps)), F.lit(name)) for name, ps in patterns.items()]))


def common_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence: the columns of the alignment are bits of one number, a row is a few operations on it."""
    places: dict[str, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    whole = state = (1 << len(b)) - 1
    for x in a:
        hit = state & places.get(x, 0)
        state = (state + hit | state - hit) & whole
    return len(b) - state.bit_count()


@F.pandas_udf(T.DoubleType())
def rouge_l(a: pd.Series, b: pd.Series) -> pd.Series:
    """ROUGE-L F1 of two word arrays, null if either is; 0 if either is empty."""

    def one(x: Sequence[str] | None, y: Sequence[str] | None) -> float | None:
        if x is None or y is None:
            return None
        return 2.0 * common_length(x, y) / (len(x) + len(y)) if len(x) and len(y) else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)


def micro_macro(cells: DataFrame) -> DataFrame:
    """Micro, macro and weighted precision, recall and F1 of a confusion table (true, pred, cnt); 0 where undefined."""
    div = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    hit = F.sum(F.when(F.col("true") == F.col("pred"), F.col("cnt")).otherwise(0))
    t = cells.groupBy(F.col("true").alias("class")).agg(F.sum("cnt").alias("support"), hit.alias("tp"))
    p = cells.groupBy(F.col("pred").alias("class")).agg(F.sum("cnt").alias("predicted"))
    c = t.join(p, "class", "full_outer").na.fill(0, ["support", "tp", "predicted"])
    c = c.withColumns({"p": div(F.col("tp"), F.col("predicted")), "r": div(F.col("tp"), F.col("support"))}).withColumn("f", div(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    weighted = lambda x: F.sum(F.col(x) * F.col("support")) / F.sum("support")
    names = {"p": "precision", "r": "recall", "f": "f1"}
    out = [F.round(F.avg(k), 6).alias(f"macro_{v}") for k, v in names.items()] + [F.round(weighted(k), 6).alias(f"weighted_{v}") for k, v in names.items()]
    return c.agg(*out, F.round(F.sum("tp") / F.sum("predicted"), 6).alias("micro_f1"))


def masked_metrics(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    """Metrics within each true class alone: there precision is 1 or 0 and accuracy is the recall."""
    right = F.avg((F.col(true) == F.col(pred)).cast("double"))
    return df.groupBy(F.col(true).alias("class")).agg(F.count("*").alias("support"), F.round(right, 6).alias("accuracy"), F.when(right > 0, 1.0).otherwise(0.0).alias("precision"))


def frequent_classes(df: DataFrame, n: int, true: str = "true") -> DataFrame:
    """Rows of the n most frequent true classes, for a confusion table of bounded size."""
    top = df.groupBy(F.col(true).alias("__c")).agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), "__c").limit(n).select("__c")
    return df.join(F.broadcast(top), F.col(true) == F.col("__c"), "left_semi")


def exact_quantiles(df: DataFrame, group: str, value: str, qs: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """(group, q, quantile): interpolated quantiles, exact, without gathering a group's values in one task.

    Approximate quantiles bracket each exact one by some 30 ranks or more; rows below are counted, and only those
    within are ordered. Groups too small for that, of 10 x accuracy rows at most, are ordered whole.
    """
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).filter("v is not null")
    off = 3.0 / accuracy
    sketch = [F.percentile_approx("v", [max(0.0, q - off), min(1.0, q + off)], accuracy).alias(f"b{i}") for i, q in enumerate(qs)]
    wide = rows.groupBy("g").agg(F.count("*").alias("n"), *sketch)
    large = lambda c, k, end: F.when(F.col("n") > 10 * accuracy, F.col(c)[k]).otherwise(F.lit(end).cast("double"))
    brackets = wide.select("g", "n", F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), large(f"b{i}", 0, "-Infinity").alias("lo"), large(f"b{i}", 1, "Infinity").alias("hi")) for i, q in enumerate(qs)])).alias("b")).select("g", "n", "b.*")
    met = rows.join(brackets, "g")
    below = met.filter("v < lo").groupBy("g", "q").agg(F.count("*").alias("below"))
    # equal values are one row with their number
    inside = met.filter("v >= lo and v <= hi").groupBy("g", "q", "n", "v").agg(F.count("*").alias("c")).join(below, ["g", "q"], "left")
    upto = F.coalesce("below", F.lit(0)) + F.sum("c").over(Window.partitionBy("g", "q").orderBy("v"))
    rank = F.col("q") * (F.col("n") - 1)
    at = lambda r: F.min(F.when(F.col("upto") > r, F.col("v")))
    ends = inside.withColumn("upto", upto).withColumn("rank", rank).groupBy("g", "q").agg(at(F.floor("rank")).alias("a"), at(F.ceil("rank")).alias("b"), F.first("rank").alias("rank"))
    return ends.select(F.col("g").alias(group), "q", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank"))).alias("quantile"))


_FENCE = re.compile(r"```(?:sql)?\s*(.*?)```", re.S | re.I)


def checked_sql(text: str, limit: int = 50) -> str:
    """A generated SELECT as it may run: without fences, prose before it and a semicolon, and with a limit unless it has one or only counts."""
    fenced = _FENCE.search(text)
    sql = (fenced[1] if fenced else text).strip()
    begin = re.search(r"\b(?:with|select)\b", sql, re.I)
    if not begin:
        raise ValueError("no SELECT")
    sql = sql[begin.start() :].split(";")[0].strip()
    counts = re.match(r"select\s+count\s*\([^)]*\)(?:\s+as\s+\w+)?\s+from\b(?!.*\bgroup\s+by\b)", sql, re.I | re.S)
    return sql if counts or re.search(r"\blimit\s+\d+\s*$", sql, re.I) else f"{sql} LIMIT {limit}"


def self_healing(run, write, question: str, retries: int = 2):
    """run(sql) for what write(question, error) generates; a failure goes back as the next error, so many times."""
    error = None
    for attempt in range(retries + 1):
        try:
            return run(checked_sql(write(question, error)))
        except Exception as e:
            if attempt == retries:
                raise
            error = str(e)

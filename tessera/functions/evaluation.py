"""Classifier metrics and answer scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    return df.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("cnt"))


def per_class(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    """One-vs-rest precision, recall and F1 (0 where undefined) with support."""
    cells = confusion(df, true, pred)
    t = cells.groupBy(F.col("true").alias("class")).agg(F.sum("cnt").alias("support"), F.sum(F.when(F.col("true") == F.col("pred"), F.col("cnt")).otherwise(0)).alias("tp"))
    p = cells.groupBy(F.col("pred").alias("class")).agg(F.sum("cnt").alias("predicted"))
    both = t.join(p, "class", "full_outer").na.fill(0, ["support", "tp", "predicted"])
    div = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    both = both.withColumn("p", div(F.col("tp"), F.col("predicted"))).withColumn("r", div(F.col("tp"), F.col("support")))
    return both.select("class", "support", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(div(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), 6).alias("f1"))


def accuracy_f1(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    """Accuracy, macro and weighted F1."""
    c = per_class(df, true, pred)
    return c.agg(F.sum("support").alias("n"), F.round(F.avg("f1"), 4).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 4).alias("weighted_f1"), F.round(F.sum(F.col("recall") * F.col("support")) / F.sum("support"), 4).alias("accuracy"))


def topk_accuracy(probabilities: DataFrame, k: int, case: str = "case", label: str = "label", p: str = "p", true: str = "true") -> DataFrame:
    """Share of cases whose true label is among the k likeliest; probabilities has a row for each case and label."""
    rank = F.row_number().over(Window.partitionBy(case).orderBy(F.desc(p), label))
    return probabilities.withColumn("k", rank).groupBy(case).agg(F.max(((F.col("k") <= k) & (F.col(label) == F.col(true))).cast("int")).alias("hit")).agg(F.round(F.avg("hit"), 6).alias("accuracy"), F.count("*").alias("n"))


def lower_quantile(values: Column, q: float) -> Column:
    """The element int(q (n - 1)) of the sorted values, not interpolated."""
    s = F.array_sort(values)
    return F.element_at(s, (F.floor(F.lit(q) * (F.size(s) - 1)) + 1).cast("int"))


def upper_median(values: Column) -> Column:
    s = F.array_sort(values)
    return F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))


def length_score(n: Column) -> Column:
    return F.when(n < 50, n / 50.0).when(n <= 500, 1.0).otherwise(F.greatest(F.lit(0.5), 1 - (n - 500) / 1000.0))


def keyword_coverage(answer: Column, phrases: Column) -> Column:
    found = F.size(F.filter(phrases, lambda p: F.contains(F.lower(answer), F.lower(p))))
    return F.when(F.size(phrases) == 0, 0.0).otherwise(found / F.size(phrases))


def rouge_n(pairs: DataFrame, n: int, id_: str, a: str, b: str) -> DataFrame:
    """ROUGE-n F1 of two texts over multisets of word n-grams."""
    ws = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    grams = lambda c: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.array_join(F.slice(c, i, n), " "))).otherwise(F.array().cast("array<string>"))
    held = pairs.select(id_, grams(ws(a)).alias("x"), grams(ws(b)).alias("y"))
    side = lambda c, m: held.select(id_, F.explode(c).alias("g")).groupBy(id_, "g").agg(F.count("*").alias(m))
    shared = side("x", "m").join(side("y", "k"), [id_, "g"]).groupBy(id_).agg(F.sum(F.least("m", "k")).alias("o"))
    total = F.size("x") + F.size("y")
    return held.join(shared, id_, "left").select(id_, F.round(F.when(total == 0, 0.0).otherwise(2.0 * F.coalesce("o", F.lit(0)) / total), 6).alias("rouge"))

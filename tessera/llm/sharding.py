"""Sharding by sampled splitters.

Records are ordered by a hash of their text, then doc_id, so equal texts lie together. A sample drawn in
proportion to record sizes gives the quantiles that split this order into ranges; every record goes to its
range. Ranges that come out overfull are sampled alone and subdivided, until none is; equal rows have a number
of their own, so no range is indivisible. Exact totals of the ranges give each record's exact place. From
places come shards, under one of three laws:

- `bytes`: shard sizes near equal. A group of equal texts stays in one shard unless it has more than SLACK of
  a shard's bytes; then its rows spread over the shards that it covers.
- `rows`: numbers of rows at most one apart.
- `key`: doc_id and the number of shards decide (highest random weight), so one more shard takes rows only
  into itself; grown_shard tells where the row would be then.

A range has RANGE_ROWS rows, or, of very large tables, one in MAX_RANGES of all; the driver holds splitters,
at most OVERSAMPLE keys for each of them.

Defined results: a null text has 0 bytes and size 16. Null ids sort first; ids that aren't integers sort by a
hash. Rows that repeat get slots of their own. Very long texts are one row each and never cut, so a shard may
exceed the others by the size of one. An empty table has no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tessera.llm.common import hash_share, materialise

#: Rows that a range should have, but for tables of more than so many ranges.
RANGE_ROWS = 8192
MAX_RANGES = 150_000
#: Sampled keys for each range.
OVERSAMPLE = 12
#: A range is overfull with more than so many times the rows that it should have.
OVERFULL = 4
SLACK = 0.1
_LOWEST = -(1 << 63)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the sort key of every row."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(F.sha2(text, 256)).alias("h"))


def _weight(shard: int) -> Column:
    return F.xxhash64(F.lit(shard * 0x9E3779B1 + 1), F.col("doc_id"))


def _best(n: int) -> Column:
    """The shard with the highest weight; of a tie the first."""
    pairs = [F.struct(_weight(k).alias("w"), F.lit(-k).alias("s")) for k in range(n)]
    return -(F.greatest(*pairs)["s"] if n > 1 else reduce(lambda a, _: a, pairs)["s"])


def _splitters(rows: DataFrame, n_ranges: int, total: int, seed: int, within: bool = False) -> np.ndarray:
    """Quantiles (h, i, u) of a sample in which a row appears with a chance in proportion to its size, as columns.

    A splitter falls between groups of equal texts; only within overfull ranges it may fall into a group.
    """
    chance = F.col("size") * F.lit(n_ranges * OVERSAMPLE / max(1, total))
    drawn = rows.filter(hash_share(F.xxhash64("h", "i", "u"), seed) < chance).select("h", "i", "u").toArrow()
    keys = np.stack([drawn.column(k).to_numpy() for k in range(3)]) if drawn.num_rows else np.zeros((3, 0), np.int64)
    keys = keys[:, np.lexsort(keys[::-1])]
    at = keys[:, np.unique(np.arange(1, n_ranges) * keys.shape[1] // n_ranges)] if keys.shape[1] else keys
    if not within:
        at[1:] = _LOWEST
    return at


def _united(splitters: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(splitters, axis=1), axis=1)  # sorted by h, then i, then u


def _place(keys: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
    """How many of the sorted keys are not above each of the values, both compared column by column."""
    first, last = np.searchsorted(keys[0], values[0], "left"), np.searchsorted(keys[0], values[0], "right")
    if len(keys) == 1:
        return last
    out = first.copy()
    ties = np.flatnonzero(last > first)
    for at in np.unique(first[ties]):  # keys that some values meet
        own = ties[first[ties] == at]
        some = slice(at, last[own[0]])
        out[own] = at + _place([k[some] for k in keys[1:]], [v[own] for v in values[1:]])
    return out


def _ranges(rows: DataFrame, splitters: np.ndarray) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(list(splitters))

    @F.pandas_udf(IntegerType())
    def place(h: pd.Series, i: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series(_place(shared.value, [h.to_numpy(), i.to_numpy(), u.to_numpy()]).astype(np.int32))

    return rows.withColumn("r", place("h", "i", "u"))


def _divided(rows: DataFrame, n: int, total: int, n_shards: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """rows with their range r, and (r, n, b) of every range: its rows and bytes."""
    target = max(RANGE_ROWS, n // MAX_RANGES)
    splitters = [_splitters(rows, max(1, n // target * 2, min(n, n_shards * 4)), total, seed)]
    while True:
        ranged = materialise(_ranges(rows, _united(splitters)), "ranged")
        totals = materialise(ranged.groupBy("r").agg(F.count("*").alias("n"), F.sum("size").alias("b")), "totals")
        over = totals.filter(F.col("n") > OVERFULL * target)
        weight = over.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
        if not weight["n"]:
            return ranged, totals
        inside = ranged.join(F.broadcast(over.select("r")), "r", "left_semi")  # n / (OVERFULL target) ranges at most
        seed += 1
        splitters.append(_splitters(inside, max(2, weight["n"] // target * 2), weight["b"], seed, within=True))


def shard(docs: DataFrame, n_shards: int = 40, law: str = "bytes", seed: int = 5) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    if law not in ("bytes", "rows", "key"):
        raise ValueError(f"no such law: {law}")
    integral = sizes(docs).schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    key = F.col("doc_id").cast("long") if integral else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    rows = materialise(sizes(docs).withColumns({"i": F.coalesce(key, F.lit(_LOWEST)), "u": F.monotonically_increasing_id()}), "sizes")
    stats = rows.agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()
    n, total = stats["n"], stats["b"] or 0
    ranged, totals = _divided(rows, n, total, n_shards, seed)
    if law == "key":
        placed = ranged.withColumn("shard", _best(n_shards)).withColumn("grown_shard", _best(n_shards + 1))
    else:
        before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range, some MAX_RANGES
        offsets = totals.select("r", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"))
        ordered = Window.partitionBy("r").orderBy("h", "i", "u")
        upto = ordered.rowsBetween(Window.unboundedPreceding, -1)
        placed = ranged.join(offsets, "r").withColumn("n0", F.col("n0") + F.row_number().over(ordered) - 1).withColumn("b0", F.col("b0") + F.coalesce(F.sum("size").over(upto), F.lit(0)))
        if law == "rows":
            target = F.floor((F.col("n0") * n_shards) / F.lit(max(1, n)))
        else:
            group = Window.partitionBy("r", "h")
            whole = F.sum("size").over(group) <= SLACK * total / n_shards
            start = F.when(whole, F.min("b0").over(group)).otherwise(F.col("b0"))
            target = F.floor((start + F.col("size") / 2) * n_shards / F.lit(float(max(1, total)))) if total else F.lit(0)
            target = F.when(whole, F.floor((F.min("b0").over(group) + F.sum("size").over(group) / 2) * n_shards / F.lit(float(max(1, total))))).otherwise(target)
        placed = placed.withColumn("shard", F.least(target, F.lit(n_shards - 1)).cast("int")).withColumn("grown_shard", F.lit(None).cast("int"))
    placed = placed.select("doc_id", "size", "text_crc32", "h", "i", "u", "r", F.col("shard").cast("int").alias("shard"), F.col("grown_shard").cast("int").alias("grown_shard"))
    # slots: rows of the shard in earlier ranges, then the order within the range
    counts = placed.groupBy("shard", "r").agg(F.count("*").alias("n"))
    counts = counts.select(F.col("shard").alias("s2"), F.col("r").alias("r2"), F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    slot = F.row_number().over(Window.partitionBy("r", "shard").orderBy("h", "i", "u"))
    out = placed.withColumn("k", slot).join(counts, (F.col("shard") == F.col("s2")) & (F.col("r") == F.col("r2")))
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("off") + F.col("k") - 1).cast("long").alias("slot"), "grown_shard")

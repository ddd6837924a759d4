"""Mixing sources to target weights, by hierarchical budgets, in DataFrame functions alone.

A token budget goes down a tree of groups (say domain, language, source) in proportion to weights. A node can
take no more than its capacity, the tokens of its subtree times the epochs allowed; what it can't take goes
to its siblings, and only what all siblings together can't take was never given to their parent: budgets go
top-down over capacities that were summed bottom-up, so a shortage is met by siblings before it reaches an
ancestor's siblings. Each leaf then takes whole epochs of its documents and, from one last epoch in an order
seeded for it, the longest prefix of documents whose tokens fit what is left.

Prefixes are found without ordering a leaf in one task: documents fall into buckets by the leading bits of
their seeded order, bucket totals give each bucket's offset, and only within a bucket are rows summed.

Tokens are words between white space; what a tokenizer would make of them isn't counted.

Defined results: null group values form a group named `?`; null weights count as the default weight. Texts
without tokens (null and empty ones too) take no budget and come with each whole epoch, in the last one with
the bucket prefix. Rows with the same doc_id are in the order of their texts' hashes; rows that share both are
rows of their own, each with its share of their copies. A very long text that doesn't fit into what is left
ends its leaf's prefix. Empty input: no rows. Extra columns are kept by mix() and ignored by select().
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise

BUCKET_ROWS = 4096
BIG = "decimal(38,0)"


def n_tokens(text: Column) -> Column:
    """Words between white space (space and \\t to \\r)."""
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.coalesce(words, F.lit(0)).cast("long")


def budgets(totals: DataFrame, levels: list[str], weights: dict[tuple[str, ...], int], budget: int, max_epochs: int, default_weight: int = 1) -> DataFrame:
    """totals has the levels and `tokens` of each leaf; returns levels, tokens and `share`, the leaf's tokens to take.

    weights maps the path of a node (its values from the top) to an integer; others have default_weight. At
    each node the budget is filled into its children: those whose capacity is below their proportion are
    full, in the order of capacity by weight, and the others share the rest in proportion.
    """
    known = F.create_map(*[F.lit(x) for k, v in weights.items() for x in ("\x1f".join(k), v)]) if weights else None
    nodes = totals.withColumn("cap", (F.col("tokens") * max_epochs).cast(BIG))
    root = F.least(F.sum("cap").over(Window.partitionBy(F.lit(1))), F.lit(budget)).cast(BIG)
    given = None
    above: list[str] = []
    for level in levels:
        here = [*above, level]
        children = nodes.groupBy(*here).agg(F.sum("cap").alias("cap"))
        path = F.concat_ws("\x1f", *here)
        weight = F.lit(default_weight) if known is None else F.coalesce(known[path], F.lit(default_weight))
        children = children.withColumn("w", weight.cast(BIG))
        children = children.join(given, above) if above else children.withColumn("given", root)
        # full(i): cap_i * W(i..) <= w_i * (given - C(<i)) in the order of cap/w; weight 0 gets nothing
        order = Window.partitionBy(*above).orderBy(F.col("w") <= 0, F.try_divide("cap", "w"), level) if above else Window.orderBy(F.col("w") <= 0, F.try_divide("cap", "w"), level)
        before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
        children = children.withColumn("c0", F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(BIG)).withColumn("w1", F.sum("w").over(after).cast(BIG))
        left = F.col("given") - F.col("c0")
        children = children.withColumn("full", (F.col("w") > 0) & (F.col("cap") * F.col("w1") <= F.col("w") * left))
        group = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(1))
        taken, open_w = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(F.lit(0).cast(BIG))).over(group), F.sum(F.when(~F.col("full"), F.col("w")).otherwise(F.lit(0).cast(BIG))).over(group)
        rest = F.expr("(given - taken) * w div open_w").cast(BIG)
        children = children.withColumn("taken", taken.cast(BIG)).withColumn("open_w", open_w.cast(BIG))
        given = children.select(*here, F.when(F.col("full"), F.col("cap")).when(F.col("open_w") > 0, rest).otherwise(F.lit(0)).cast(BIG).alias("given"))
        above = here
    return totals.join(given, levels).select(*levels, "tokens", F.col("given").cast("long").alias("share"))


def plan(leaves: dict[tuple[str, ...], int], weights: dict[tuple[str, ...], int], budget: int, max_epochs: int, default_weight: int = 1) -> dict[tuple[str, ...], int]:
    """The same budgets by plain recursion with exact fractions; what tests hold budgets() against."""

    def cap(prefix: tuple[str, ...]) -> int:
        return sum(v * max_epochs for k, v in leaves.items() if k[: len(prefix)] == prefix)

    def fill(prefix: tuple[str, ...], amount: int) -> dict[tuple[str, ...], int]:
        depth = len(prefix)
        if prefix in leaves:
            return {prefix: min(amount, cap(prefix))}
        open_ = {k[: depth + 1] for k in leaves if k[:depth] == prefix}
        caps, w = {k: cap(k) for k in open_}, {k: weights.get(k, default_weight) for k in open_}
        got, left = dict.fromkeys(open_, 0), min(amount, sum(caps.values()))
        open_ = {k for k in open_ if w[k] > 0}
        while open_:
            level = Fraction(left, sum(w[k] for k in open_))
            full = {k for k in open_ if caps[k] <= level * w[k]}
            if not full:
                got |= {k: int(level * w[k]) for k in open_}
                break
            got |= {k: caps[k] for k in full}
            left -= sum(caps[k] for k in full)
            open_ -= full
        return {leaf: v for k in got for leaf, v in fill(k, got[k]).items()}

    return fill((), budget) if leaves else {}


def select(docs: DataFrame, levels: dict[str, str], weights: dict[tuple[str, ...], int], budget_share: float = 0.5, budget: int | None = None, max_epochs: int = 2, seed: int = 17, default_weight: int = 1) -> DataFrame:
    """doc_id, text_key (hash of the text), the levels, n_tokens and copies (whole epochs and the prefix) of the documents taken.

    levels names the tree's columns from the top, each with its SQL expression; the budget is `budget` tokens or
    budget_share of all.
    """
    names = list(levels)
    values = [F.coalesce(F.expr(c).cast("string"), F.lit("?")).alias(n) for n, c in levels.items()]
    small = materialise(docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__key"), *values, n_tokens(F.col("text")).alias("n_tokens")), "mix")
    totals = materialise(small.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs")), "leaves")
    if budget is None:
        whole = totals.agg(F.sum("tokens").alias("n")).first()["n"] or 0
        budget = int(Fraction(str(budget_share)) * whole)
    shares = materialise(budgets(totals.select(*names, "tokens"), names, weights, budget, max_epochs, default_weight), "shares").select(*names, "share", F.expr("if(tokens > 0, share div tokens, 0)").alias("epochs"), F.expr("if(tokens > 0, share % tokens, 0)").alias("rest"))
    # buckets of about BUCKET_ROWS documents by the leading bits of the seeded order, which is uniform
    leaf = totals.join(shares, names).select(*names, "epochs", "rest", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BUCKET_ROWS)).alias("n_buckets"))
    order = F.pmod(F.xxhash64(F.lit(seed), F.col("epochs"), F.col("__id"), F.col("__key")), F.lit(1 << 40))
    rows = small.join(leaf, names).withColumn("o", order).withColumn("k", F.floor(F.col("o") * F.col("n_buckets") / F.lit(1 << 40)))
    per_bucket = rows.groupBy(*names, "k").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("r"))
    running = Window.partitionBy(*names).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    cut = per_bucket.withColumn("base", F.coalesce(F.sum("t").over(running), F.lit(0))).select(*names, "k", F.col("base").alias("base"), (F.col("base") + F.col("t") <= F.col("r")).alias("inside"), (F.col("base") > F.col("r")).alias("beyond"))
    placed = rows.join(cut, [*names, "k"])
    within = Window.partitionBy(*names, "k").orderBy("o", "__id", "__key").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.filter("not inside and not beyond").withColumn("extra", (F.col("base") + F.sum("n_tokens").over(within) <= F.col("rest")).cast("long"))
    sure = placed.filter("inside or beyond").withColumn("extra", F.col("inside").cast("long"))
    both = sure.unionByName(edge).withColumn("copies", F.col("epochs") + F.when(F.col("rest") > 0, F.col("extra")).otherwise(F.lit(0)))
    return both.filter("copies > 0").select(F.col("__id").alias("doc_id"), F.col("__key").alias("text_key"), *names, "n_tokens", "copies")


def mix(docs: DataFrame, levels: dict[str, str], weights: dict[tuple[str, ...], int], **options) -> DataFrame:
    """All columns of the documents taken, each row as often as its copies; docs must be a table that reads the same twice."""
    names = docs.columns
    taken = select(docs, levels, weights, **options).groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.sum("copies").alias("__copies"))
    taken = materialise(taken, "taken")
    held = docs.toDF(*[f"c{i}" for i in range(len(names))])
    place = {n: f"c{i}" for i, n in enumerate(names)}
    held = held.withColumns({"__own": F.col(place["doc_id"]), "__hash": F.xxhash64(place["text"]), "__part": F.spark_partition_id()})
    # rows that share doc_id and text: the copies of all are dealt among them evenly, the first ones getting one more
    per_part = materialise(held.groupBy("__own", "__hash", "__part").agg(F.count("*").alias("n")), "rows")
    several = per_part.groupBy("__own", "__hash").agg(F.sum("n").alias("all")).filter("all > 1")
    same = lambda a, b: F.col(f"{a}.__own").eqNullSafe(F.col(f"{b}.__own")) & (F.col(f"{a}.__hash") == F.col(f"{b}.__hash"))
    before = Window.partitionBy("__own", "__hash").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = per_part.alias("p").join(several.alias("s"), same("p", "s")).select("p.*", "all").withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parts = parts.alias("p").join(taken.alias("t"), F.col("p.__own").eqNullSafe(F.col("t.__id")) & (F.col("p.__hash") == F.col("t.__key")))
    parts = materialise(parts.select("__own", "__hash", "__part", "all", "first", "__copies"), "repeats")
    once = taken.alias("t").join(several.alias("s"), F.col("t.__id").eqNullSafe(F.col("s.__own")) & (F.col("t.__key") == F.col("s.__hash")), "left_anti")
    single = held.join(once, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__key"))).select(*place.values(), "__copies")
    repeats = held.alias("h").join(parts.alias("p"), same("h", "p") & (F.col("h.__part") == F.col("p.__part"))).select(*[f"h.{c}" for c in place.values()], "h.__own", "h.__hash", "h.__part", "all", "first", "__copies")
    ordinal = F.col("first") + F.row_number().over(Window.partitionBy("__own", "__hash", "__part").orderBy(F.lit(1))) - 1
    repeats = repeats.withColumn("__copies", F.expr("__copies div all") + (ordinal < F.expr("__copies % all")).cast("long")).filter("__copies > 0").select(*place.values(), "__copies")
    rows = single.unionByName(repeats).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return rows.select(*[F.col(c).alias(n) for n, c in place.items()])

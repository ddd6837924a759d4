"""Names matched by likeness without loss, and entity references resolved against their sentence, then their document.

The likeness of two names is 2 M / (a + b), M of their a and b characters lying in matching blocks. Between two
blocks some character matches nothing, so there are at most a + b - 2 M + 1 blocks, and at least
3 M - (a + b) - 1 pairs of neighbouring characters are common to both names. A likeness above t so asks for more than
(1.5 t - 1)(a + b) - 1 common pairs, counted with repetition. That makes names sets of pairs, numbered where they
repeat, and a prefix of each set, rarest first, finds all candidates. Names of which one holds the other are found by
the rarest pair of the inner one. Nothing that is like enough is lost; only candidates are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.extract import inferred_label
from tessera.functions.text import fuzzy_ratio, norm
from tessera.sources.store import written

SENTENCE, DOCUMENT = 0.85, 0.90
#: Likeness of names that hold one another.
INSIDE = 0.95
#: Characters of a name that becomes a new entity.
NEW_NAME = 100
#: Below this likeness two short names may have no pair in common.
LEAST = 5 / 6


def name_pairs(names: DataFrame) -> DataFrame:
    """(plain, n, pairs, inner) of each distinct name: its length, its numbered pairs of characters, rarest first, and the one that names holding it are looked up by.

    That one is the rarest pair, the character of a name of one, or nothing at all for the empty name.
    """
    distinct = names.select("plain").filter("plain is not null").distinct()
    chars = distinct.select("plain", F.split("plain", "").alias("c")).withColumn("c", F.when(F.col("plain") == "", F.array().cast("array<string>")).otherwise(F.col("c")))
    m = F.size("c")
    pairs = F.zip_with(F.slice("c", F.lit(1), F.greatest(m - 1, F.lit(0))), F.slice("c", F.lit(2), F.greatest(m - 1, F.lit(0))), lambda x, y: F.concat(x, y))
    each = chars.select("plain", F.posexplode(pairs).alias("at", "pair"))
    again = F.row_number().over(Window.partitionBy("plain", "pair").orderBy("at"))
    each = written(each.select("plain", "pair", F.concat("pair", again.cast("string")).alias("token")), "pairs")
    seen = each.groupBy("token").agg(F.count("*").alias("seen"))
    ordered = each.join(seen, "token").groupBy("plain").agg(F.transform(F.sort_array(F.collect_list(F.struct("seen", "token"))), lambda x: x["token"]).alias("pairs"), F.min(F.struct("seen", "pair")).alias("rare"))
    held = chars.select("plain", m.alias("n"), F.array_distinct("c").alias("chars")).join(ordered, "plain", "left")
    inner = F.when(F.col("n") > 1, F.col("rare.pair")).when(F.col("n") == 1, F.col("plain")).otherwise("")
    return held.select("plain", "n", F.coalesce("pairs", F.array().cast("array<string>")).alias("pairs"), inner.alias("inner"), "chars")


def _common(a: Column, b: Column, threshold: float) -> Column:
    """The least number of common pairs of names of these lengths that are like enough."""
    return F.greatest(F.lit(1), F.floor((1.5 * threshold - 1) * (a + b) - 1 - 1e-9) + 1)


def similar_names(left: DataFrame, right: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, plain, other, score) of all pairs of a left and a right name (plain) with equal keys whose likeness is above the threshold, at least LEAST.

    Names that hold one another score INSIDE. Names are expected in the form that they are compared in; those of
    equal keys come once. Null keys and names meet nothing.
    """
    if threshold < LEAST - 1e-12:
        raise ValueError(f"names less alike than {LEAST:.3f} need not share two characters in a row")
    a, b = (x.select(*keys, "plain").dropna().distinct() for x in (left, right))
    known = written(name_pairs(a.select("plain").union(b.select("plain"))), "names")
    a, b = (x.join(known, "plain") for x in (a, b))
    shortest = threshold / (2 - threshold)  # of the partner's length
    first = F.col("n") - 1 - _common(F.col("n"), shortest * F.col("n"), threshold) + 1
    prefix = lambda x, names: x.filter("n > 1").select(*keys, *names, F.explode(F.slice("pairs", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))).alias("token"))
    other = [F.col("plain").alias("other"), F.col("n").alias("m"), F.col("pairs").alias("pairs2")]
    met = prefix(a, [F.col("plain"), F.col("n"), F.col("pairs")]).join(prefix(b, other), [*keys, "token"])
    # of the prefix tokens that two names share, the first one lists them
    shared = F.array_intersect("pairs", "pairs2")
    close = met.filter(F.least("n", "m") > shortest * F.greatest("n", "m") - 1e-9).filter((F.col("token") == shared[0]) & (F.size(shared) >= _common(F.col("n"), F.col("m"), threshold)))
    close = close.filter(~F.contains("plain", "other") & ~F.contains("other", "plain")).select(*keys, "plain", "other")

    spots = lambda x, name: x.select(*keys, F.col("plain").alias(name), F.explode(F.array_union(F.array_union(F.transform("pairs", lambda t: F.substring(t, 1, 2)), F.col("chars")), F.array(F.lit("")))).alias("inner"))
    inside = spots(a, "plain").join(b.select(*keys, F.col("plain").alias("other"), "inner"), [*keys, "inner"]).filter(F.contains("plain", "other"))
    around = spots(b, "other").join(a.select(*keys, "plain", "inner"), [*keys, "inner"]).filter(F.contains("other", "plain"))
    held = inside.select(*keys, "plain", "other").union(around.select(*keys, "plain", "other")).distinct()
    scored = close.withColumn("score", fuzzy_ratio("plain", "other")).unionByName(held.withColumn("score", F.lit(INSIDE)))
    return scored.filter(F.col("score") > threshold)


def _best(refs: DataFrame, known: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(rid, found, label) of the likest known name above the threshold, of a tie the first by name, then label."""
    scored = similar_names(refs, known, keys, threshold)
    # the first of each name before names meet, and of each reference's names thereafter, both in partial aggregates
    named = known.groupBy(*keys, F.col("plain").alias("other")).agg(F.min(F.struct("name", "label")).alias("x"))
    best = scored.join(named, [*keys, "other"]).groupBy(*keys, "plain").agg(F.min(F.struct((-F.col("score")).alias("s"), "x")).alias("b"))
    return refs.join(best, [*keys, "plain"]).select("rid", F.col("b.x.name").alias("found"), F.col("b.x.label").alias("of"))


def resolve_entities(refs: DataFrame, known: DataFrame, doc: str, sentence: str) -> DataFrame:
    """refs (doc, sentence, ref) with name, label and how: exact, sentence, document or new.

    known has doc, sentence, name and label. An exact name is looked for in the sentence; a similar one there
    above SENTENCE, then anywhere in the document above DOCUMENT. What is left becomes a new entity, cut to
    NEW_NAME characters, with a label told by its words. Null references are dropped.
    """
    distinct = refs.filter("ref is not null").select(doc, sentence, "ref").distinct()
    r = written(distinct.withColumn("plain", norm(F.col("ref"))).withColumn("rid", F.sha2(F.to_json(F.struct(doc, sentence, "ref")), 256)), "references")
    k = written(known.select(doc, sentence, "name", "label").filter("name is not null").withColumn("plain", norm(F.col("name"))).distinct(), "known")
    least = F.min(F.struct("name", "label"))
    exact = r.join(k.groupBy(doc, sentence, "plain").agg(least.alias("x")), [doc, sentence, "plain"]).select("rid", F.col("x.name").alias("name"), F.col("x.label").alias("label"), F.lit("exact").alias("how"))
    rest = r.join(exact, "rid", "left_anti")
    near = written(_best(rest, k, [doc, sentence], SENTENCE).select("rid", F.col("found").alias("name"), F.col("of").alias("label"), F.lit("sentence").alias("how")), "near")
    rest = rest.join(near, "rid", "left_anti")
    far = written(_best(rest, k.drop(sentence).distinct(), [doc], DOCUMENT).select("rid", F.col("found").alias("name"), F.col("of").alias("label"), F.lit("document").alias("how")), "far")
    new = rest.join(far, "rid", "left_anti").select("rid", F.substring("ref", 1, NEW_NAME).alias("name"), inferred_label(F.lower("ref")).alias("label"), F.lit("new").alias("how"))
    found = exact.unionByName(near).unionByName(far).unionByName(new)
    return r.drop("plain").join(found, "rid").drop("rid")

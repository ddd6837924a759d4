"""Exact n-gram Jaccard join by token-combination prefixes, with its connected components.

A document's tokens are the hashes of its distinct word n-grams. Documents with equal sets form one class,
known by its smallest doc_id, so copies never multiply. The tokens have one order for all: rare ones by
hash, then frequent ones. Two sets of the wanted similarity share at least two tokens of prefixes that are
extended by one, so either they share a rare token there, or two frequent ones: rare tokens are indexed
singly, frequent ones in combinations of two. A class with so many frequent tokens that combinations would
multiply is `large`: it and the others index those singly too, and such an entry counts only for pairs with
a large class.

link() finds components. Pairs of a bucket are not all emitted there: first each member meets the bucket's first
one; what those verified links don't yet connect meets across components, so a group of near copies costs about
as many pairs as it has members. Across components only sets of similar sizes meet, and in buckets of more than
SPLIT members of one token only those that share a second token of their prefixes, as similar sets do. pairs()
is the join itself: all links between classes, with no such short cut. Pairs are verified on the whole sets,
and components come from labels that spread along links with pointer jumping.

What is frequent is counted over all documents; it only steers the cost, never the result. A token that passes
as rare has at most two documents in each chunk of CHUNK_TOKENS, or fewer than one in MAX_FREQUENT of all
tokens; its bucket is one run of a sorted partition. Buckets of frequent tokens, and leads with very many
pairs, are split over tasks.

"Equal" and "shared" are by 64-bit hashes of shingles (classes by 128 bits): two different shingles of the same
two documents would have to collide to change a link.

Defined results: a text without words (null and empty ones too) has no tokens and is linked with nothing;
with fewer words than n its whole sequence is its one token. Rows with the same doc_id are one document, known
by the set of each of its texts. A null doc_id is linked with nothing. Very long texts are taken whole. Other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import HOT_SHARE, bounded_batches, give_back, materialise

#: A token is frequent if chunks of documents that have it repeatedly have it so often in all. The list of
#: frequent tokens is broadcast: of more than MAX_FREQUENT, at any corpus size, the most frequent.
MIN_FREQUENT = 6
MAX_FREQUENT = 2_000_000
#: Frequent tokens in a prefix up to which they are combined.
MAX_COMBINED = 10
#: Ids that are broadcast to filter rows; more are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
CHUNK_TOKENS = 6_000_000
CACHE = 150_000
#: Bytes of texts in an Arrow batch, and texts whose words are held at once: with both workers of an executor, tokens should fit.
BATCH_BYTES = 2 << 20
AT_ONCE = 250
#: Members of a token's bucket that meet across components without a second token in common.
SPLIT = 256
SALTS = 64
#: Kinds of entries: rare tokens, single frequent tokens of other and of large classes, combinations.
RARE, SINGLE, LARGE, COMBINED = 0, 1, 2, 3

_FOLD_CASE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SHIFT, _MIX, _PAIR, _SINGLE = np.uint64(31), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> _SHIFT)) * _MIX
    return values ^ (values >> _SHIFT)


def token_sets(texts: list[bytes | None], n: int, cache: _Hashes) -> list[np.ndarray]:
    """The sorted distinct tokens (64-bit) of each text."""
    words = [t.translate(_FOLD_CASE).split() if t else [] for t in texts]
    lengths = [len(ws) for ws in words]
    flat = np.fromiter(map(cache.__getitem__, chain.from_iterable(words)), np.uint64, sum(lengths))
    rolled = flat
    for i in range(1, n):
        rolled = (rolled[: max(0, len(flat) - i)] * _MIX) ^ (rolled[: max(0, len(flat) - i)] >> _SHIFT)
        rolled = rolled + flat[i:]
    rolled = _mixed(rolled)
    out, at = [], 0
    for size in lengths:
        if size >= n:
            out.append(np.unique(rolled[at : at + size - n + 1]))
        elif size:
            short = xxhash.xxh3_64_intdigest(flat[at : at + size].tobytes(), seed=size)
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n tokens with any similar one."""
    return (percent * n + 99) // 100


def index_keys(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """The prefix as rare tokens and single frequent ones, the keys of combinations, and whether the set is large.

    Combinations come in the order of their first token: those of the i-th with all later ones, i from 0.
    """
    if len(tokens) < 2:  # a single token is similar to itself only: the same class
        return tokens[:0], tokens[:0], tokens[:0], False
    length = len(tokens) - needed(len(tokens), percent) + 2
    if len(frequent):
        known = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
        rare, often = tokens[~known][:length], tokens[known]
    else:
        rare, often = tokens[:length], tokens[:0]
    often = often[: length - len(rare)]
    if len(often) > MAX_COMBINED:
        return rare, _mixed(often ^ _SINGLE), often[:0], True
    a, b = np.triu_indices(len(often), 1)
    return rare, _mixed(often ^ _SINGLE), _mixed(often[a] * _PAIR + often[b]), False


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _summaries(docs: DataFrame, n: int) -> DataFrame:
    """A row for each document (size and 128-bit digest of its set), and rows of tokens that a chunk of documents has repeatedly."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, held, seen, size = _Hashes(), [], set(), 0

        def counted() -> pa.RecordBatch:
            values = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held.clear()
            values.sort()  # in place: the largest array of a task
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1])))
            counts = np.diff(first, append=len(values))
            values = values[first]
            often = counts >= 3
            m = int(often.sum())
            none = pa.nulls(m, pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(m, ids_type), none, none, none, pa.array(_signed(values[often])), pa.array(counts[often])], names=names)

        names = ["doc_id", "n", "s1", "s2", "token", "seen"]
        ids_type = pa.int64()
        for batch in batches:
            ids_type = batch.schema.field(0).type
            for low in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(low, AT_ONCE)
                sets = token_sets(part.column(1).cast(pa.binary()).to_pylist(), n, cache)
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                for s, d in zip(sets, digests, strict=True):
                    if len(s) and d not in seen:
                        seen.add(d)
                        held.append(s)
                        size += len(s)
                both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                none = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), none, none], names=names)
                if size > CHUNK_TOKENS:
                    yield counted()
                    seen, size = set(), 0
        yield counted()
        cache.clear()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, s1 long, s2 long, token long, seen long")


def _index(docs: DataFrame, n: int, percent: int, frequent: np.ndarray) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, own = _Hashes(), shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(low, AT_ONCE)
                sets = token_sets(part.column(1).cast(pa.binary()).to_pylist(), n, cache)
                found = [index_keys(s, own, percent) for s in sets]
                lists = []
                for which in (0, 1, 2):
                    ends = np.concatenate(([0], np.cumsum([len(f[which]) for f in found]))).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(np.concatenate([f[which] for f in found])))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), *lists, pa.array([f[3] for f in found], pa.bool_())], names=["id", "n", "rare", "often", "combined", "large"])
        cache.clear()
        give_back()

    return docs.select(F.col("doc_id").alias("id"), "text").mapInArrow(run, f"id {kind}, n long, rare array<long>, often array<long>, combined array<long>, large boolean")


def _rare_buckets(prefixes: DataFrame) -> DataFrame:
    """Entries of rare tokens that several classes have, with the bucket's smallest class: (key, id, n, pos, c, lead_id, lead_n, lead_pos).

    Rows come sorted by key, so a bucket is a run of rows; runs go on over the ends of batches.
    """
    kind = prefixes.schema["id"].dataType.simpleString()
    entries = prefixes.select(F.posexplode("rare").alias("pos", "key"), "id", "n").select("key", "id", F.col("n").cast("int").alias("n"), "pos").repartition("key").sortWithinPartitions("key", "id")
    names = ["key", "id", "n", "pos", "c", "lead_id", "lead_n", "lead_pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def several(t: pa.Table) -> pa.RecordBatch | None:
            keys = t.column(0).to_numpy()
            first = np.concatenate(([True], keys[1:] != keys[:-1]))
            starts = np.flatnonzero(first)
            group = np.cumsum(first) - 1
            wanted = np.flatnonzero(np.diff(np.concatenate((starts, [len(keys)])))[group] > 1)
            if not len(wanted):
                return None
            own, leads = t.take(pa.array(wanted)).combine_chunks(), t.take(pa.array(starts[group[wanted]])).combine_chunks()
            columns = [*own.columns, pa.chunked_array([np.full(len(wanted), RARE, np.int8)]), *leads.columns[1:]]
            return pa.Table.from_arrays(columns, names=names).combine_chunks().to_batches()[0]

        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = t.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last run may go on
            if cut and (out := several(t.slice(0, cut))) is not None:
                yield out
            held = t.slice(cut)
        if held is not None and held.num_rows and (out := several(held)) is not None:
            yield out

    return entries.mapInArrow(run, f"key long, id {kind}, n int, pos int, c byte, lead_id {kind}, lead_n int, lead_pos int")


def _frequent_buckets(prefixes: DataFrame) -> DataFrame:
    """The same of single frequent tokens and combinations; their buckets may be huge, so they are counted before rows meet."""
    single = F.when(F.col("large"), F.lit(LARGE)).otherwise(F.lit(SINGLE)).cast("byte")
    m = F.size("often")
    # the first token of each combination, in the order of index_keys
    firsts = F.flatten(F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.array_repeat(i, m - 1 - i)))
    combined = F.zip_with("combined", firsts, lambda k, i: F.struct(k.alias("key"), F.lit(COMBINED).cast("byte").alias("c"), i.alias("at")))
    singles = F.transform("often", lambda k, i: F.struct(k.alias("key"), single.alias("c"), i.alias("at")))
    entries = F.when(F.col("large"), singles).otherwise(F.concat(combined, singles))
    index = prefixes.filter(m > 0).select("id", "n", F.size("rare").alias("r"), F.explode(entries).alias("e")).select("e.key", "id", F.col("n").cast("int").alias("n"), (F.col("r") + F.col("e.at")).alias("pos"), "e.c")
    buckets = index.groupBy("key").agg(F.count("*").alias("members"), F.min(F.when(F.col("c") != SINGLE, F.struct("id", "n", "pos"))).alias("lead")).filter("members > 1 and lead is not null").select("key", "lead")
    # buckets has a row for each key; adaptive execution splits the partitions of large ones
    return index.join(buckets, "key").select("key", "id", "n", "pos", "c", F.col("lead.id").alias("lead_id"), F.col("lead.n").alias("lead_n"), F.col("lead.pos").alias("lead_pos"))


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is among ids; those are broadcast if they are few enough, else both sides are shuffled."""
    few = ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()


def _verified(pairs: DataFrame, prefixes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose whole sets are similar enough.

    Sets of sizes x and y need an overlap of o = percent (x + y) / (100 + percent). Prefixes were cut two
    beyond what the least overlap of each set alone asks for, so similar sets share two tokens of them, and
    one more for each that o is above the larger of these least overlaps. What passes is verified on the texts.
    """
    kind = pairs.schema["a"].dataType.simpleString()
    known = materialise(_only(prefixes, _both(pairs)).select("id", "n", F.concat("rare", "often").alias("p")), "prefixes")
    sides = pairs.join(known.toDF("b", "nb", "pb"), "b").join(known.toDF("a", "na", "pa"), "a")
    least = lambda x: F.ceil(F.lit(percent) * x / 100)
    overlap = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / (100 + percent))
    enough = overlap - F.greatest(least(F.col("na")), least(F.col("nb"))) + 2
    close = materialise(sides.filter(F.size(F.array_intersect("pa", "pb")) >= enough).select("a", "b"), "close")
    texts = materialise(_only(docs.withColumnRenamed("doc_id", "id"), _both(close)), "texts")
    # a class with very many pairs is dealt over several tasks
    hot = close.groupBy("a").agg(F.count("*").alias("m")).filter(F.col("m") > close.count() // HOT_SHARE).select("a", F.lit(SALTS).alias("of"))
    close = close.join(F.broadcast(hot), "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("of", F.lit(1)))).drop("of")
    leads = close.select("a", "salt").distinct().join(texts.toDF("a", "ta"), "a")
    both = close.join(texts.toDF("b", "tb"), "b").join(leads, ["a", "salt"]).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        last, last_set = None, np.zeros(0, np.uint64)
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist(), strict=True):
                if a != last:
                    last, last_set = a, token_sets([a], n, cache)[0]
                second = token_sets([b], n, cache)[0]
                shared = len(np.intersect1d(last_set, second, assume_unique=True))
                ok.append(shared > 0 and 100 * shared >= percent * (len(last_set) + len(second) - shared))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.mapInArrow(run, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every node of the links (a, b): the smallest node that it reaches."""
    both = materialise(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), "links")
    labels = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("l"), F.lit(True).alias("moved")), "labels")
    while not labels.filter("moved").isEmpty():
        near = both.join(labels.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        step = labels.select("u", F.col("l").alias("l0")).join(near, "u").select("u", "l0", F.least("l0", "m").alias("l1"))
        jump = labels.select(F.col("u").alias("l1"), F.col("l").alias("l2"))
        labels = materialise(step.join(jump, "l1").select("u", F.least("l1", "l2").alias("l"), (F.least("l1", "l2") != F.col("l0")).alias("moved")), "labels")
    return labels.select(F.col("u").alias("id"), F.col("l").alias("label"))


def _classes(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Every row with its set's size and digest; the classes of equal sets by smallest id; their prefixes; their entries in buckets."""
    summary = materialise(_summaries(docs, n), "summary")
    own = summary.filter("n is not null").select("doc_id", "n", "s1", "s2")
    named = own.filter("n > 0 and doc_id is not null")
    classes = materialise(named.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("size")), "classes")
    often = summary.filter("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).filter(F.col("seen") >= MIN_FREQUENT)
    often = often.orderBy(F.desc("seen"), "token").limit(MAX_FREQUENT).select("token").toArrow()
    frequent = np.sort(often.column("token").to_numpy().view(np.uint64)) if often.num_rows else np.zeros(0, np.uint64)
    reps = classes.filter("size > 1").select(F.col("rep").alias("id")).distinct()
    prefixes = materialise(_only(_index(docs, n, percent, frequent), reps), "prefixes")
    shared = materialise(_rare_buckets(prefixes).unionByName(_frequent_buckets(prefixes)), "buckets")
    return own, classes, prefixes, shared


def _fits(percent: int, n1: Column, at1: Column, n2: Column, at2: Column) -> Column:
    """Whether two sets with their first shared token at these positions can still be similar."""
    overlap = F.ceil(F.lit(percent) * (n1 + n2) / (100 + percent))
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) & (at1 <= n1 - overlap) & (at2 <= n2 - overlap)


def _meet(entries: DataFrame, keys: list[str], percent: int, apart: bool) -> DataFrame:
    """Distinct pairs (a, b) of entries (keys, id, n, pos, c, label) with the same keys that can be similar; with apart, of different labels.

    Similar sets have sizes in the same or neighbouring bands, so only those meet.
    """
    col = F.col
    band = F.floor(F.log(col("n")) / F.log(F.lit(100 / percent))) if percent < 100 else col("n")
    side = lambda x: entries.select(*keys, band.cast("long").alias("band"), *[col(c).alias(f"{c}{x}") for c in ("id", "n", "pos", "c", "label")])
    smaller = side("1").withColumn("band", F.explode(F.array(col("band"), col("band") + 1)))
    both = smaller.join(side("2"), [*keys, "band"]).filter((col("n1") < col("n2")) | (col("n1") == col("n2")) & (col("id1") < col("id2")))
    both = both.filter(_fits(percent, col("n1"), col("pos1"), col("n2"), col("pos2")) & ((col("c1") != SINGLE) | (col("c2") != SINGLE)))
    if apart:
        both = both.filter(col("label1") != col("label2"))
    return both.filter(col("id1") != col("id2")).select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).distinct()


def _all_pairs(shared: DataFrame, sizes: DataFrame, prefixes: DataFrame, percent: int, apart: bool) -> DataFrame:
    """The pairs of buckets; sizes has key and m, its members, and c, the largest kind of its entries."""
    split = (F.col("m") > SPLIT) & (F.col("c") != COMBINED)
    tagged = materialise(shared.join(sizes.select("key", split.alias("split")), "key"), "tagged")
    met = _meet(tagged.filter("not split").drop("split"), ["key"], percent, apart)
    large = tagged.filter("split").drop("split")
    if large.isEmpty():
        return met
    # similar sets share two tokens of their prefixes, which were cut one longer for that
    own = _only(prefixes, large.select("id").distinct())
    extended = large.join(own.select("id", F.explode(F.concat("rare", "often")).alias("second")), "id").filter(F.col("second") != F.col("key"))
    return met.union(_meet(extended, ["key", "second"], percent, apart)).distinct()


def link(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: documents link when their sets' Jaccard similarity is percent / 100 or more."""
    bounded_batches(docs.sparkSession, BATCH_BYTES)
    docs = docs.select("doc_id", "text")
    own, classes, prefixes, shared = _classes(docs, n, percent)
    col = F.col
    first = shared.filter((col("id") != col("lead_id")) & _fits(percent, col("n"), col("pos"), col("lead_n"), col("lead_pos"))).select(F.least("id", "lead_id").alias("a"), F.greatest("id", "lead_id").alias("b")).distinct()
    first = materialise(first, "pairs")
    links = materialise(_verified(first, prefixes, docs, n, percent), "verified")
    reached = components(links)
    spread = materialise(shared.join(reached, "id", "left").select("key", "id", "n", "pos", "c", F.coalesce("label", "id").alias("label")), "spread")
    sizes = materialise(spread.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("c").alias("c"), F.count("*").alias("m")).filter(f"lo != hi and c != {SINGLE}").select("key", "m", "c"), "apart")
    # a pair meets in many buckets; it is made distinct and written before the join, which would be pushed below that else
    met = materialise(_all_pairs(spread, sizes, prefixes, percent, True), "met")
    second = materialise(met.join(first, ["a", "b"], "left_anti"), "pairs")
    more = materialise(_verified(second, prefixes, docs, n, percent), "verified")
    if not more.isEmpty():
        reached = components(links.union(more))

    of_class = classes.join(reached.withColumnRenamed("id", "rep"), "rep", "left").select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.coalesce("label", "rep").alias("label"))
    rows = own.join(of_class, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    rows = rows.select("doc_id", "n", F.coalesce("label", "doc_id").alias("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def pairs(docs: DataFrame, n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """The join: every link (a, b), a < b, between classes of equal sets, and the membership (doc_id, class_id) of every row with a set and an id.

    A class is known by its smallest doc_id. All links are listed, so a group of n different near copies has
    about n * n / 2 of them; equal sets are one class and listed by the membership alone.
    """
    bounded_batches(docs.sparkSession, BATCH_BYTES)
    docs = docs.select("doc_id", "text")
    own, classes, prefixes, shared = _classes(docs, n, percent)
    entries = shared.select("key", "id", "n", "pos", "c", F.col("id").alias("label"))
    sizes = materialise(entries.groupBy("key").agg(F.count("*").alias("m"), F.max("c").alias("c")).filter(F.col("c") != SINGLE), "sizes")
    found = materialise(_all_pairs(entries, sizes, prefixes, percent, False), "pairs")
    members = own.filter("n > 0 and doc_id is not null").join(classes.select("s1", "s2", "rep"), ["s1", "s2"]).select("doc_id", F.col("rep").alias("class_id")).distinct()
    return _verified(found, prefixes, docs, n, percent), members


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """All columns of one document of each component, that with the smallest doc_id; null ids stay."""
    gone = link(docs, n, percent).filter("component_id != doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")

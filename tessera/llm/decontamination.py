"""Benchmark decontamination with suffix arrays of the training text.

A shard is a batch of documents. Its words become ids of the benchmark's vocabulary; any other word ends every
match, so suffixes that begin with one are not sorted. The others form the shard's suffix array, built by
prefix doubling, to the depth of the longest benchmark text. Every suffix of every benchmark text is then
found in it by binary search; what it shares with the two entries beside its place is its longest verbatim
match in the shard. Where that is a window or longer, the entries that begin with the window are all its
occurrences. longest_matches() takes the longest match of each item, with its location, over all shards;
find() and report() mark the words of all occurrences, and remove_contaminated() drops the documents.

The benchmark is handed out in blocks of BLOCK_BYTES. A benchmark of one block is matched in a single pass; a
larger one has a pass for each block, whose hits are written before the next block is broadcast, so no
executor holds two.

Defined results: a null or empty text has no words and is clean. An item without words has no window. Items
that repeat are reported each under their id; null ids are ignored. Rows that repeat give equal results. Very
long texts are matched whole. Extra columns are ignored, or kept as they are where rows are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, materialise

#: Separators become spaces and A-Z lower case; bytes of other characters stay.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Benchmark bytes in one block: what is broadcast at once.
BLOCK_BYTES = 16 << 20
#: Words of documents in one suffix array, but for a longer document.
SHARD_WORDS = 1 << 20


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


class Block:
    """Some benchmark items as one sequence of word ids, a 0 behind each, with the window that each position begins."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[str] = []
        flat: list[int] = []
        self.longest = 0
        begins, sizes = [], []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if ids:
                self.items.append(item)
                begins.append(len(flat))
                sizes.append(len(ids))
                flat += [*ids, 0]
                self.longest = max(self.longest, len(ids))
        self.ids = np.array(flat, np.int64)
        self.begins, sizes_ = np.array(begins, np.int64), np.array(sizes, np.int64)
        self.starts = np.flatnonzero(self.ids)
        self.item = np.repeat(np.arange(len(sizes)), sizes_)  # of each start
        self.left = (self.begins + sizes_)[self.item] - self.starts  # words from each start to its item's end
        self.window = np.minimum(window, sizes_)[self.item]


class SuffixArray:
    """The suffixes of a sequence of ids that begin with an id above 0, ordered by their first `depth` ids; a 0 ends a suffix."""

    def __init__(self, ids: np.ndarray, depth: int) -> None:
        self.ids = np.concatenate((ids, np.zeros(1, ids.dtype)))
        stops = np.flatnonzero(self.ids == 0)
        self.positions = self._sorted(stops, depth)

    def _sorted(self, stops: np.ndarray, depth: int) -> np.ndarray:
        """Prefix doubling: groups that agree on so many ids are split by the rank of what follows, and these many again."""
        begin = np.flatnonzero(self.ids)
        order = begin[np.argsort(self.ids[begin], kind="stable")]
        n, length = len(order), 1
        if not n:
            return order
        run = np.zeros(len(self.ids), np.int64)  # ids up to the next 0
        run[begin] = stops[np.searchsorted(stops, begin)] - begin
        first = np.concatenate(([True], self.ids[order[1:]] != self.ids[order[:-1]]))
        rank = np.zeros(len(self.ids) + depth + 1, np.int64)  # 1 + the place where the group begins; 0 ends
        rank[order] = 1 + np.maximum.accumulate(np.where(first, np.arange(n), 0))
        while length < depth:
            alone = first & np.concatenate((first[1:], [True]))
            open_ = np.flatnonzero(~alone & (run[order] >= length))  # whole groups: shorter ones are equal to their end
            if not len(open_):
                break
            some = order[open_]
            ranks, follow = rank[some], rank[some + length]
            by = np.lexsort((follow, ranks))
            some, ranks, follow = some[by], ranks[by], follow[by]
            order[open_] = some
            new = np.concatenate(([True], (ranks[1:] != ranks[:-1]) | (follow[1:] != follow[:-1])))
            first[open_] = new
            rank[some] = 1 + np.maximum.accumulate(np.where(new, open_, 0))
            length *= 2
        return order

    def shared(self, at: np.ndarray, block: Block, starts: np.ndarray, limit: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """Ids that the suffix at each place of the array shares with the block's text from each start, up to the limit."""
        inside = (at >= 0) & (at < len(self.positions))
        here = self.positions[np.where(inside, at, 0)] if len(self.positions) else np.zeros(len(at), np.int64)
        out = np.zeros(len(at), np.int64) if known is None else known.copy()
        todo = np.flatnonzero(inside & (out < limit))
        while len(todo):
            same = self.ids[here[todo] + out[todo]] == block.ids[starts[todo] + out[todo]]
            todo = todo[same]
            out[todo] += 1
            todo = todo[out[todo] < limit[todo]]
        out[~inside] = 0
        return out

    def place(self, block: Block, starts: np.ndarray, limit: np.ndarray, after: bool = False) -> np.ndarray:
        """Binary search of every text (its first `limit` ids): the first entry not below it; with after, the first above all that begin with it."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.positions))
        with_low, with_high = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)  # ids shared with the bounds
        todo = np.flatnonzero(low < high)
        while len(todo):
            middle = (low[todo] + high[todo]) // 2
            own, most = starts[todo], limit[todo]
            n = self.shared(middle, block, own, most, np.minimum(with_low[todo], with_high[todo]))
            ended = n == most
            at = self.positions[middle] + n
            below = np.where(ended, after, self.ids[at] < block.ids[np.minimum(own + n, len(block.ids) - 1)])
            low[todo[below]], with_low[todo[below]] = middle[below] + 1, n[below]
            high[todo[~below]], with_high[todo[~below]] = middle[~below], n[~below]
            todo = todo[low[todo] < high[todo]]
        return low


class Shard:
    """The words of some documents as ids of a block's vocabulary, with their suffix array."""

    def __init__(self, texts: list[list[bytes]], block: Block) -> None:
        lengths = [len(ws) + 1 for ws in texts]  # a 0 behind each text keeps matches within it
        self.starts = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        flat = (w for ws in texts for w in (*ws, b""))
        self.block = block
        self.array = SuffixArray(np.fromiter(map(block.vocabulary.get, flat, repeat(0)), np.int64, int(self.starts[-1])), block.longest)

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every benchmark suffix: the length of its longest match, and a position where it is."""
        block, array = self.block, self.array
        at = array.place(block, block.starts, block.left)
        before, behind = array.shared(at - 1, block, block.starts, block.left), array.shared(at, block, block.starts, block.left)
        if not len(array.positions):
            return before, at
        entry = np.where(before >= behind, at - 1, at)
        return np.maximum(before, behind), array.positions[np.clip(entry, 0, len(array.positions) - 1)]

    def occurrences(self) -> Iterator[tuple[set[int], np.ndarray, int]]:
        """(items, positions, length) of every distinct window that occurs, with all its occurrences."""
        block, array = self.block, self.array
        hit = np.flatnonzero((block.window <= block.left) & (self.longest()[0] >= block.window))
        low = array.place(block, block.starts[hit], block.window[hit])
        high = array.place(block, block.starts[hit], block.window[hit], after=True)
        items: dict[tuple[int, int, int], set[int]] = {}
        for a, b, n, item in zip(low.tolist(), high.tolist(), block.window[hit].tolist(), block.item[hit].tolist(), strict=True):
            items.setdefault((a, b, n), set()).add(item)
        for (a, b, n), own in items.items():
            yield own, array.positions[a:b], n


def _shards(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    """Words of the texts, SHARD_WORDS at once."""
    held: list[list[bytes]] = []
    size = 0
    for t in texts:
        held.append(words_of(t))
        size += len(held[-1])
        if size >= SHARD_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def match(texts: list[bytes | None], block: Block) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """Of each text: its number of words, the ranges of words that are hit, and the items that hit it."""
    out: list[tuple[int, list[tuple[int, int]], list[str]]] = []
    for words in _shards(texts):
        shard = Shard(words, block)
        marks = np.zeros(int(shard.starts[-1]) + 1, np.int32)
        items: dict[int, set[int]] = {}
        for own, positions, n in shard.occurrences():
            np.add.at(marks, positions, 1)
            np.add.at(marks, positions + n, -1)
            for text in np.unique(np.searchsorted(shard.starts, positions, "right") - 1).tolist():
                items.setdefault(text, set()).update(own)
        hit = np.cumsum(marks) > 0
        for k, ws in enumerate(words):
            spans: list[tuple[int, int]] = []
            if k in items:
                edges = np.flatnonzero(np.diff(np.concatenate(([False], hit[shard.starts[k] : shard.starts[k] + len(ws)], [False])).astype(np.int8)))
                spans = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
            out.append((len(ws), spans, sorted({block.items[i] for i in items.get(k, ())})))
    return out


def _blocks(benchmark: DataFrame, window: int) -> Iterator[Block]:
    """The benchmark in blocks of BLOCK_BYTES; the driver holds one at a time. A benchmark without text is one empty block."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("t")).filter("item is not null and t is not null")
    held, size = [], 0
    for r in rows.toLocalIterator():
        text = r["t"].encode()
        if held and size + len(text) > BLOCK_BYTES:
            yield Block(held, window)
            held, size = [], 0
        held.append((r["item"], text))
        size += len(text)
    yield Block(held, window)


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_FOUND = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def _pass(rows: DataFrame, block: Block) -> tuple[DataFrame, object]:
    """The columns of rows but the last, which is the text, with what one block finds; and the broadcast to destroy later."""
    shared = rows.sparkSession.sparkContext.broadcast(block)
    kept = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = match(batch.column(len(kept)).cast(pa.binary()).to_pylist(), own)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array([x[0] for x in found], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in x[1]] for x in found], _SPAN), pa.array([x[2] for x in found], pa.list_(pa.string()))],
                names=[*kept, "n_words", "spans", "items"],
            )

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [_FOUND])
    return rows.mapInArrow(run, schema), shared


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of several blocks, united."""
    for batch in batches:
        out = []
        for spans in batch.column(2).to_pylist():
            joined: list[dict] = []
            for s in sorted((x["start"], x["end"]) for one in spans for x in one):
                if joined and s[0] <= joined[-1]["end"]:
                    joined[-1]["end"] = max(joined[-1]["end"], s[1])
                else:
                    joined.append({"start": s[0], "end": s[1]})
            out.append(joined)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, _SPAN), batch.column(3)], names=["h1", "h2", "spans", "items"])


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep with n_words, spans (word ranges that windows hit) and items of every document."""
    bounded_batches(docs.sparkSession)
    names = {f"k{i}": c for i, c in enumerate(keep)}
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in names.items()], F.col("text").alias("t"))
    blocks = _blocks(benchmark, window)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _pass(rows, first)[0].withColumnsRenamed(names)
    # texts are known by two hashes; each block's hits are written before the next block goes out
    hashes = F.xxhash64("t").alias("h1"), F.xxhash64("t", F.lit(1)).alias("h2")
    hits = []
    for block in _chain(first, second, blocks):
        found, shared = _pass(docs.select(F.col("text").alias("t")).distinct().select(*hashes, "t"), block)
        hits.append(materialise(found.filter(F.size("items") > 0).select("h1", "h2", "spans", "items"), "hits"))
        shared.destroy()
    both = hits[0]
    for more in hits[1:]:
        both = both.unionByName(more)
    both = both.groupBy("h1", "h2").agg(F.collect_list("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    both = both.mapInArrow(_merged, "h1 long, h2 long, spans array<struct<start:int,end:int>>, items array<string>")
    counted = _pass(rows.select(*names, *hashes, "t"), Block([], window))[0].drop("spans", "items").join(both, ["h1", "h2"], "left")
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)"), F.expr("cast(array() as array<string>)")
    return counted.select(*names, "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items")).withColumnsRenamed(names)


def _chain(first: Block, second: Block, rest: Iterator[Block]) -> Iterator[Block]:
    yield first
    yield second
    yield from rest


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return find(docs, benchmark, window).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def longest_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Of every item with a word in common with the documents: its longest verbatim match (length in words), where it begins in the item and in which document, and at which word there.

    Of matches of equal length the one that begins first in the item; of several places of that one any.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t"))
    kind = rows.schema["i"].dataType.simpleString()
    out = None
    for block in _blocks(benchmark, 1):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                at = 0
                for words in _shards(batch.column(1).cast(pa.binary()).to_pylist()):
                    shard = Shard(words, own)
                    length, position = shard.longest()
                    best = np.lexsort((own.starts, -length, own.item))
                    best = best[np.concatenate(([True], own.item[best][1:] != own.item[best][:-1]))] if len(best) else best
                    best = best[length[best] > 0]
                    text = np.searchsorted(shard.starts, position[best], "right") - 1
                    ids = batch.column(0).take(pa.array(at + text, pa.int64()))
                    numbers = [length[best], own.starts[best] - own.begins[own.item[best]], position[best] - shard.starts[text]]
                    yield pa.RecordBatch.from_arrays([pa.array([own.items[k] for k in own.item[best].tolist()], pa.string()), ids, *map(pa.array, numbers)], names=["item_id", "doc_id", "length", "item_start", "doc_start"])
                    at += len(words)

        found = rows.mapInArrow(run, f"item_id string, doc_id {kind}, length long, item_start long, doc_start long")
        best = found.groupBy("item_id").agg(F.min(F.struct((-F.col("length")).alias("n"), "item_start", "doc_id", "doc_start")).alias("b"))
        one = materialise(best.select("item_id", (-F.col("b.n")).alias("length"), "b.item_start", "b.doc_id", "b.doc_start"), "longest")
        shared.destroy()
        out = one if out is None else out.unionByName(one)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """All columns of the documents in which no window of the benchmark occurs."""
    names = docs.columns
    found = find(docs, benchmark, window, keep=tuple(names)).toDF(*[f"c{i}" for i in range(len(names))], "n", "spans", "items")
    return found.filter(F.size("spans") == 0).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])

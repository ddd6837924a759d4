"""Line dedup by winnowing over line hashes.

A window is a shortest run of lines, from a line on or up to a line, that has min_words words. Of each window
the position of the smallest line hash is selected (of equal ones the last), so neighbouring windows mostly
select the same position, and any run of min_words words that two texts share has a selected position in
common. These fingerprints are joined; only those that occur at several positions go on. There a match is
extended to both sides over the line hashes, up to the ends of each window that selected the position, and
counts if the whole of it occurs before: matches are verbatim. Matches that overlap make up the repeated
runs. The first occurrence by (doc_id, line) stays; the lines of later ones are deleted. So a line goes
exactly if it lies in a run of lines with at least min_words words that occurs earlier as well, in the same or
another document.

Fingerprints and windows that are very common are joined by broadcast, all others by a shuffle (join_hot), so no
key's rows meet in one task.

Defined results: lines end at \\n; they are compared without outer white space and must not be blank. A null
text stays null, an empty one empty. Rows with the same doc_id and text are one document and have the same
result; rows that share only the doc_id come in the order of their texts' hashes. A null doc_id comes first.
Very long texts are read whole, in time linear in their lines. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, join_hot, materialise

MIN_WORDS = 8


def runs(words: Sequence[int], min_words: int) -> list[tuple[int, int]]:
    """The distinct shortest runs (begin, end) with min_words words from each line on and up to each line."""
    spans: dict[tuple[int, int], None] = {}
    end = total = 0
    for i, own in enumerate(words):
        while total < min_words and end < len(words):
            total += words[end]
            end += 1
        if total < min_words:
            break
        spans[(i, end)] = None
        total -= own
    begin, total = len(words), 0
    for j in range(len(words), 0, -1):
        while total < min_words and begin > 0:
            begin -= 1
            total += words[begin]
        if total < min_words:
            break
        spans[(begin, j)] = None
        total -= words[j - 1]
    return list(spans)


def fingerprints(text: str, min_words: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(line hash, windows) of every selected position; a window is the hash of all its lines and its range of lines."""
    stripped = [x.strip() for x in text.split("\n")]
    at = [i for i, x in enumerate(stripped) if x]
    hashes = [xxhash.xxh3_64_intdigest(stripped[i]) - (1 << 63) for i in at]
    packed = np.array(hashes, np.int64)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in runs([len(stripped[i].split()) for i in at], min_words):
        if b - a == 1:
            found.setdefault(a, []).append((hashes[a], at[a], at[a] + 1))
        else:
            chosen = b - 1 - int(np.argmin(packed[a:b][::-1]))
            found.setdefault(chosen, []).append((xxhash.xxh3_64_intdigest(packed[a:b].tobytes()) - (1 << 63), at[a], at[b - 1] + 1))
    return [(hashes[p], windows) for p, windows in found.items()]


def repeated(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, tx, b, e): ranges of lines of a text, tx being its hash, that occur earlier as well."""
    spark = docs.sparkSession
    bounded_batches(spark)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("tx"), "text").filter("text != ''")
    kind = keyed.schema["doc_id"].dataType.simpleString()
    window = pa.struct([("wh", pa.int64()), ("b", pa.int32()), ("e", pa.int32())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                found = [(k, *x) for k, t in enumerate(part.column(2).to_pylist()) for x in fingerprints(t, min_words)]
                if found:
                    row = pa.array([x[0] for x in found], pa.int64())
                    flat = [w for x in found for w in x[2]]
                    offsets = pa.array(np.concatenate(([0], np.cumsum([len(x[2]) for x in found]))), pa.int32())
                    each = pa.StructArray.from_arrays([pa.array([w[k] for w in flat], f.type) for k, f in enumerate(window)], fields=list(window))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array([x[1] for x in found], pa.int64()), pa.ListArray.from_arrays(offsets, each)], names=["doc_id", "tx", "fp", "windows"])

    selected = materialise(keyed.mapInArrow(emit, f"doc_id {kind}, tx long, fp long, windows array<struct<wh:long,b:int,e:int>>"), "selected")
    total = selected.count()
    shared = selected.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1")
    extended = materialise(join_hot(selected, shared, ["fp"], total).select("doc_id", "tx", F.explode("windows").alias("w")).select("doc_id", "tx", "w.*"), "extended")
    place = F.struct("doc_id", "tx", "b")
    known = extended.groupBy("wh").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last"))).select("wh", "n", "first")
    met = join_hot(extended, known, ["wh"], extended.count())
    return met.filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "tx", "b", "e")


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text without later repeated runs, n_lines, n_removed of every row."""
    base = docs.select("doc_id", "text")
    kind = base.schema["doc_id"].dataType.simpleString()
    # the ranges of one text, met with it at once
    marks = repeated(base, min_words).groupBy("doc_id", "tx").agg(F.sort_array(F.collect_set(F.struct("b", "e"))).alias("runs")).select(F.col("doc_id").alias("m_id"), F.col("tx").alias("m_tx"), "runs")
    joined = base.join(marks, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.xxhash64("text") == F.col("m_tx")), "left").select("doc_id", "text", "runs")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, gone = [], [], []
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = t.split("\n") if t else []
                if spans:
                    edges = np.zeros(len(lines) + 1, np.int32)
                    for r in spans:
                        edges[r["b"]] += 1
                        edges[r["e"]] -= 1
                    cut = np.cumsum(edges[:-1]) > 0
                    cut &= np.array([bool(x.strip()) for x in lines])
                    t = "\n".join(x for x, c in zip(lines, cut, strict=True) if not c)
                    gone.append(int(cut.sum()))
                else:
                    gone.append(0)
                texts.append(t)
                totals.append(len(lines))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(gone, pa.int64())], names=["doc_id", "text", "n_lines", "n_removed"])

    return joined.mapInArrow(strip, f"doc_id {kind}, text string, n_lines long, n_removed long")

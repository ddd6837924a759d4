"""Periodic run detection: Main-Lorentz divide and conquer on interned word ids.

A run is a stretch of consecutive words in which words q apart are identical, q the smallest such period, that
no neighbouring word extends, and that holds at least MIN_EXPONENT periods and MIN_LENGTH words. Texts are
halved again and again. A run lies within some block whose midpoint it crosses, and holds two periods at
least on one side of it, as it holds four. So the Z-function of the block's right half, and that of its left
half read backwards, show it: Z[p] >= p. What they show is extended to both sides over the whole text, and
of equal intervals the smallest period stays.

The halves of all blocks of a level, of all texts in a batch, take their first steps together in numpy, where
nearly all periods drop out; halves in which some period matches FIRST_STEPS words get a Z-function by the
linear algorithm. A text of n words costs at most O(n log n), whatever its words.

Defined results: a null or empty text has no words and no runs; then the first run's columns are null and both
digests are those of the empty string. Ties of the greatest exponent go to the smallest start, then period.
Repeated rows give a row each, null ids as well. Very long texts are taken whole, one at a time. Other columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches

MIN_LENGTH = 6
MIN_EXPONENT = 4
FIRST_STEPS = 12
#: Words of the texts that are halved together.
BATCH_WORDS = 400_000
CACHE = 1_000_000

_SPACES = r"[\x20\x09-\x0D]+"


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self)
        return value


def _z_function(s: list[int], upto: int) -> list[int]:
    """Z[p] for p below upto: how many words from p on equal those from 0 on."""
    n, z, left, right = len(s), [0] * upto, 0, 0
    for p in range(1, upto):
        k = min(right - p, z[p - left]) if p < right else 0
        while p + k < n and s[k] == s[p + k]:
            k += 1
        z[p] = k
        if p + k > right:
            left, right = p, p + k
    return z


def _squares(ids: np.ndarray, mids: np.ndarray, ends: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(half, p) for all p with Z[p] >= p of each half, read from mids in direction step up to, not including, ends."""
    sizes = (ends - mids) * step // 2
    half = np.repeat(np.arange(len(mids)), sizes)
    p = np.arange(len(half)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    found = [(half[:0], p[:0])]
    tail = half[:0]
    for k in range(FIRST_STEPS):
        at = mids[half] + k * step
        same = ids[at] == ids[at + p * step]
        half, p = half[same], p[same]
        done = p == k + 1
        found.append((half[done], p[done]))
        half, p = half[~done], p[~done]
        if not len(p):
            break
    else:
        tail = np.unique(half)
    for h in tail.tolist():
        s = ids[mids[h] : ends[h]].tolist() if step > 0 else ids[ends[h] + 1 : mids[h] + 1][::-1].tolist()
        z = _z_function(s, len(s) // 2 + 1)
        own = np.array([q for q in range(FIRST_STEPS + 1, len(z)) if z[q] >= q], np.int64)
        found.append((np.full(len(own), h), own))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _extent(ids: np.ndarray, at: int, p: int, low: int, high: int) -> tuple[int, int]:
    """The longest [start, end) with at in it, within [low, high), whose words p apart are identical, as those at at and at + p are."""

    def reach(first: int, limit: int, step: int) -> int:
        """How many words from first on, in direction step, equal those p further on; slices double."""
        count, size = 0, 16
        while count < limit:
            n = min(size, limit - count)
            a = first + count if step > 0 else first - count - n + 1
            differ = np.flatnonzero(ids[a : a + n] != ids[a + p : a + n + p])
            if len(differ):
                return count + int(differ[0] if step > 0 else n - 1 - differ[-1])
            count, size = count + n, size * 2
        return count

    return at - reach(at - 1, at - low, -1), at + reach(at, high - p - at, 1) + p


def runs(ids: np.ndarray, starts: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text, by start and period; text k has the words from starts[k] to starts[k + 1]."""
    firsts, lasts = starts[:-1].tolist(), starts[1:].tolist()
    lows, highs, texts = starts[:-1], starts[1:], np.arange(len(starts) - 1)
    smallest: list[dict[tuple[int, int], int]] = [{} for _ in firsts]
    known: dict[tuple[int, int], list[tuple[int, int]]] = {}  # by text and period: disjoint sorted intervals, as [start, end - period)
    while True:
        large = highs - lows >= MIN_LENGTH
        lows, highs, texts = lows[large], highs[large], texts[large]
        if not len(lows):
            return [sorted((s, n, q) for (s, n), q in own.items()) for own in smallest]
        mids = (lows + highs) // 2
        for left, (half, periods) in ((0, _squares(ids, mids, highs, 1)), (1, _squares(ids, mids - 1, lows - 1, -1))):
            order = np.lexsort((periods, half))
            half, periods = half[order], periods[order]
            at = mids[half] - left * (1 + periods)
            last, shorter = -1, []
            for h, k, q, i in zip(half.tolist(), texts[half].tolist(), periods.tolist(), at.tolist(), strict=True):
                if h != last:
                    last, shorter = h, []
                # a square within a run whose period divides its own has a smaller period
                if any(q % p == 0 and a <= i and i + 2 * q <= b for a, b, p in shorter):
                    continue
                own = known.setdefault((k, q), [])
                place = bisect.bisect_right(own, (i, lasts[k]))
                if place and own[place - 1][1] > i:
                    start, end = own[place - 1][0], own[place - 1][1] + q
                else:
                    start, end = _extent(ids, i, q, firsts[k], lasts[k])
                    own.insert(place, (start, end - q))
                    if end - start >= max(MIN_LENGTH, MIN_EXPONENT * q):
                        key = (start - firsts[k], end - start)
                        smallest[k][key] = min(q, smallest[k].get(key, q))
                shorter.append((start, end, q))
        lows, highs, texts = np.concatenate((lows, mids)), np.concatenate((mids, highs)), np.concatenate((texts, texts))


def _kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] == 0


def repeat_words(text: Column, first: Column, period: Column) -> Column:
    """text as words joined by spaces in which each word i from first on is word first + (i - first) % period."""
    words = F.filter(F.split(text, _SPACES), lambda w: w != "")
    rest = (F.size(words) - first).cast("int")
    copies = F.flatten(F.array_repeat(F.slice(words, first.cast("int") + 1, period.cast("int")), F.ceil(rest / period).cast("int")))
    return F.array_join(F.concat(F.slice(words, F.lit(1), first.cast("int")), F.slice(copies, F.lit(1), rest)), " ")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, _SPACES), lambda w: w != ""))


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All runs of every text: doc_id, n_words, runs (start, length, period; by start, then period) and collapsed, the words that stay.

    A word goes if a run contains it after that run's first period; the others are joined by one space.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind, at_once = rows.schema["doc_id"].dataType.simpleString(), BATCH_WORDS
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def answer(ids: pa.Array, texts: list[list[bytes]], cache: _Ids) -> pa.RecordBatch:
        lengths = np.array([len(t) for t in texts], np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths)))
        if len(cache) > CACHE:
            cache.clear()
        words = np.fromiter((cache[w] for t in texts for w in t), np.int64, int(starts[-1]))
        found = runs(words, starts)
        collapsed = [b" ".join([t[i] for i in np.flatnonzero(_kept(len(t), f)).tolist()] if f else t) for t, f in zip(texts, found, strict=True)]
        ends = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
        flat = np.array([r for f in found for r in f], np.int64).reshape(-1, 3)
        structs = pa.StructArray.from_arrays([pa.array(flat[:, c].copy()) for c in range(3)], fields=list(run_type))
        return pa.RecordBatch.from_arrays([ids, pa.array(lengths), pa.ListArray.from_arrays(pa.array(ends), structs), pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Ids()
        for batch in batches:
            texts, first, size = [], 0, 0
            for i, t in enumerate(batch.column(1).cast(pa.binary())):
                words = (t.as_py() or b"").split()
                if texts and size + len(words) > at_once:
                    yield answer(batch.column(0).slice(first, len(texts)), texts, cache)
                    texts, first, size = [], i, 0
                texts.append(words)
                size += len(words)
            yield answer(batch.column(0).slice(first, len(texts)), texts, cache)

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def summary(found: DataFrame) -> DataFrame:
    """Of what detect() gives: doc_id, n_runs, the run of greatest exponent (start, length, period, exponent_milli) and SHA-256 digests of the runs and of collapsed."""
    better = lambda a, r: (r["length"] * a["period"] > a["length"] * r["period"]) | F.isnull(a["length"])  # noqa: E731  runs come by start, then period
    top = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda a, r: F.when(better(a, r), r).otherwise(a))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

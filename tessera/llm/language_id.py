"""Language identification: multinomial naive Bayes over hashed character n-grams.

The matrix of log-probabilities (buckets x languages) has at most CELLS cells, the more languages the fewer
buckets, and is broadcast. Whole texts are scored in numpy, a batch at a time: the batch's n-grams become one
sparse matrix of counts by text and bucket, whose product with the matrix, plus the log-priors of the
languages, gives the scores. Log-probabilities are held in fixed point, so a score does not depend on how
texts are cut into pieces. As n-grams overlap and depend on each other, the odds of a text are tempered to
those of EVIDENCE independent n-grams; that changes no ranking, only how sure a score is.

Defined results: a null text or one without a letter is `und` with score 0; so is every text when nothing
could be learned. Of a tie the first language by name. Rows that repeat give the same prediction each; a null
doc_id is never held out, but nothing is learned from it. Very long texts are scored whole, PIECE characters
at a time. Other columns of the input are ignored, or kept as they are where rows are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, fold, give_back, hash_share

BUCKET_BITS = 16
#: Cells of the broadcast matrix, four bytes each.
CELLS = 1 << 24
EVIDENCE = 50
ORDERS = (1, 2, 3)
FIXED_POINT = 1024
#: Characters scored at once.
PIECE = 1 << 19
#: Texts whose code points are held at once.
AT_ONCE = 250
BATCH_BYTES = 2 << 20
_SPACE = 32
_LETTERS: list[np.ndarray] = []
_NO_CODES = np.zeros(0, np.uint32)


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # int32, buckets x languages
    priors: np.ndarray  # int64, by language
    bits: int = BUCKET_BITS


def _is_letter() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points, every run of other characters than letters as one space, spaces at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes]
    codes = np.where(letter, codes, np.uint32(_SPACE))
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    return np.concatenate(([np.uint32(_SPACE)], codes[kept], [np.uint32(_SPACE)]))


def _features(codes: np.ndarray, ends: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and start position of each n-gram that ends before its position's end; spaces alone are left out."""
    buckets, starts = [], []
    wide = codes.astype(np.uint64)
    mixed = np.zeros(len(wide), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(wide) < n:
            break
        mixed = (mixed[: len(wide) - n + 1] + wide[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        if n in ORDERS:
            inside = np.arange(n, n + len(mixed)) <= ends[: len(mixed)]
            at = np.flatnonzero(inside & (codes[: len(mixed)] != _SPACE) if n == 1 else inside)
            buckets.append(((mixed[at] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64))
            starts.append(at)
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(starts)


def _pieces(texts: list[np.ndarray], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket and text number of all n-grams of the texts' codes, about PIECE start positions at a time."""
    lengths = np.array([len(c) for c in texts], np.int64)
    codes = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
    text = np.repeat(np.arange(len(texts)), lengths)
    ends = np.cumsum(lengths)[text] if texts else text
    for low in range(0, len(codes), PIECE):
        high = low + PIECE + max(ORDERS) - 1
        buckets, starts = _features(codes[low:high], ends[low:high] - low, bits)
        own = starts < PIECE
        yield buckets[own], text[low + starts[own]]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", max_docs_per_language: int = 3000, alpha: float = 0.5, seed: int = 7) -> LanguageModel:
    """Fit on labelled rows: at most about max_docs_per_language of each language, drawn by a hash of the id.

    n-gram counts are summed on the executors; the driver receives at most CELLS of them, and a number of rows
    for each language, which also makes its prior.
    """
    bounded_batches(docs.sparkSession, BATCH_BYTES)
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l")).filter("t is not null and l is not null")
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((1, 0), np.int32), np.zeros(0, np.int64))
    bits = max(1, min(BUCKET_BITS, (CELLS // len(languages)).bit_length() - 1))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, max_docs_per_language / sizes[k]))])
    drawn = rows.filter(hash_share(F.col("i"), seed) < share[F.col("l")]).select("t", "l")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(1).to_pylist()
            for one in sorted(set(names)):
                total = np.zeros(1 << bits, np.int64)
                for buckets, _ in _pieces([_codes(t) for t, k in zip(batch.column(0).to_pylist(), names, strict=True) if k == one], bits):
                    total += np.bincount(buckets, minlength=1 << bits)
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([one] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["l", "b", "n"])

    counted = drawn.mapInArrow(count, "l string, b long, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((1 << bits, len(languages)), alpha)
    place = {k: i for i, k in enumerate(languages)}
    column = np.fromiter((place[x] for x in counted.column("l").to_pylist()), np.int64, counted.num_rows)
    np.add.at(counts, (counted.column("b").to_numpy(), column), counted.column("n").to_numpy())
    logs = np.log(counts / counts.sum(axis=0))
    logs -= logs.mean(axis=1, keepdims=True)  # the same for all languages: no ranking changes
    priors = np.log(np.array([sizes[k] for k in languages]) / sum(sizes.values()))
    return LanguageModel(languages, np.round(logs * FIXED_POINT).astype(np.int32), np.round(priors * FIXED_POINT).astype(np.int64), bits)


def _score(texts: list[str | None], model: LanguageModel) -> list[tuple[str, float]]:
    """Language and score of each text."""
    out = [("und", 0.0)] * len(texts)
    codes = [_codes(t) if t and model.languages else _NO_CODES for t in texts]
    known = [k for k, c in enumerate(codes) if len(c) > 2]
    totals, n = np.zeros((len(known), len(model.languages)), np.int64), np.zeros(len(known), np.int64)
    for buckets, text in _pieces([codes[k] for k in known], model.bits):
        # the sparse matrix: counts by text and bucket
        cells, times = np.unique(text << model.bits | buckets, return_counts=True)
        rows, columns = cells >> model.bits, cells & (1 << model.bits) - 1
        n += np.bincount(text, minlength=len(known))
        step = max(1, CELLS // max(1, len(model.languages)))
        for low in range(0, len(cells), step):
            own = slice(low, low + step)
            first = np.flatnonzero(np.concatenate(([True], rows[own][1:] != rows[own][:-1])))
            totals[rows[own][first]] += np.add.reduceat(model.weights[columns[own]] * times[own, None], first, axis=0, dtype=np.int64)
    totals += model.priors
    logits = totals / FIXED_POINT / np.maximum(1.0, n / EVIDENCE)[:, None]
    for k, row, best in zip(known, logits, np.argmax(totals, axis=1).tolist() if known else (), strict=True):
        odds = np.exp(row - row.max())
        out[k] = (model.languages[best], float(odds[best] / odds.sum()))
    return out


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep with lang_pred and score for every row; texts are scored whole."""
    spark = docs.sparkSession
    bounded_batches(spark, BATCH_BYTES)
    shared = spark.sparkContext.broadcast((model.languages, model.weights, model.priors, model.bits))
    held = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("t"))
    schema = ", ".join([f"k{i} {held.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))] + ["lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*shared.value)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            found = [x for low in range(0, len(texts), AT_ONCE) for x in _score(texts[low : low + AT_ONCE], own)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*batch.schema.names[: len(keep)], "lang_pred", "score"])
        give_back()

    return held.mapInArrow(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def identify(docs: DataFrame, folds: int = 4, held_out_fold: int = 2, **options) -> DataFrame:
    """Fit on the documents outside the held-out fold and predict all: doc_id, held_out, lang_pred, score."""
    in_fold = F.coalesce(fold("doc_id", folds) == held_out_fold, F.lit(False))
    model = fit(docs.select("doc_id", "text", "lang").filter(~in_fold & F.col("doc_id").isNotNull()), **options)
    return predict(docs, model).select("doc_id", in_fold.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float = 0.5) -> DataFrame:
    """All columns of the documents whose language is told with at least min_score; `und` goes."""
    names = docs.columns
    scored = predict(docs, model, keep=tuple(names))
    rows = scored.toDF(*[f"c{i}" for i in range(len(names))], "p", "s").filter((F.col("p") != "und") & (F.col("s") >= min_score))
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])

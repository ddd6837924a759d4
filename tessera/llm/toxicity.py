"""Toxicity by maximum-scoring segments.

Every token has a log-odds score: how much likelier it is in toxic than in other texts. Its Dirichlet prior
is the rate of the token's five-letter beginning, that one's the rate of its four-letter beginning, and so
on down to the rate of all tokens, so inflected or unseen words borrow from their stem. Other tokens cost a
little. A linear scan then finds all maximal segments of a text. Their extreme-value law, with its scale and
constant from texts that are not toxic, turns scores into significance: above 0 fewer than one such segment is
expected by chance in a text of this length.

The score of a document is a logistic curve over the significance of segments of a second scan, in which a
word scores at its first occurrence alone: its repeats are not independent evidence, though they do make
passages. The law and the curve are fitted on
texts that the tokens' scores don't come from: the labelled texts are dealt into FOLDS, and each is scanned
with the scores that the other folds give.

Defined results: null and empty texts, and texts without a word, have no segment and get the score of a
clean text. Very long texts are scanned whole, in time and memory linear in their words. Rows that repeat get
equal scores; a null doc_id is in no held-out fold. When nothing could be learned, every score is the share of
toxic labels (0 without labels). Other columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, fold, hash_share

WORD = re.compile(r"[^\W\d_]+")
STEMS = (3, 4, 5)
#: Occurrences that the prior weighs.
PRIOR = 4.0
#: What a token without a score costs; any positive value makes the scan drift down between passages.
COST = 0.3
#: Log-odds that a token needs to have a score of its own.
MIN_SCORE = 1.5
#: Toxic texts that must have a token for it to have a score of its own.
MIN_TOXIC = 3
FOLDS = 4
CACHE = 400_000


@dataclass
class ToxicityModel:
    base: float
    terms: dict[str, float] = field(default_factory=dict)  # log-odds by word, and by stem with its length as mark
    scale: float = 1.0
    constant: float = 0.01
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)


class _Scores(dict):
    """Token to score; a token without one of its own takes that of its longest known beginning."""

    def __init__(self, terms: dict[str, float]) -> None:
        self.terms = terms

    def __missing__(self, word: str) -> float:
        if len(self) > CACHE:
            self.clear()
        score = self.terms.get(word)
        if score is None:
            for n in reversed(STEMS):
                if len(word) > n and (score := self.terms.get(f"{n} {word[:n]}")) is not None:
                    break
        self[word] = value = -COST if score is None else score
        return value


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), end exclusive, of a sequence, in linear time.

    Each candidate keeps the running sums at its two ends and a link to the nearest earlier candidate that
    begins lower. A new positive item follows these links, so it passes each candidate between only once, and
    is joined with the one it finds, unless that one's right sum is at least as high.
    """
    sums = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    held: list[tuple[int, int, float, float, int]] = []
    for at in np.flatnonzero(scores > 0).tolist():
        start, end, left, right = at, at + 1, sums[at], sums[at + 1]
        lower = len(held) - 1
        while True:
            while lower >= 0 and held[lower][2] >= left:
                lower = held[lower][4]
            if lower < 0 or held[lower][3] >= right:
                break
            start, _, left, _, before = held[lower]
            del held[lower:]
            lower = before
        held.append((start, end, left, right, lower))
    return [(s, e, float(r - lo)) for s, e, lo, r, _ in held]


Found = list[tuple[int, int, float]]


def _scan(text: str | None, scores: _Scores) -> tuple[np.ndarray, Found, Found]:
    """The tokens' scores, all segments, and those of a scan in which a word scores at its first occurrence alone."""
    words = WORD.findall(text.lower()) if text else []
    values = np.fromiter(map(scores.__getitem__, words), np.float64, len(words))
    if not len(values) or values.max() <= 0:
        return values, [], []
    damped, seen = values.copy(), set()
    for at in np.flatnonzero(values > 0).tolist():
        if words[at] in seen:
            damped[at] = 0.0
        seen.add(words[at])
    found = segments(values)
    return values, found, found if np.array_equal(damped, values) else segments(damped)


def _significance(x: float, n: int, model: ToxicityModel) -> float:
    """Minus the logarithm of the number of segments at least as high as x that are expected by chance among n tokens."""
    return model.scale * x - math.log(max(model.constant * max(n, 1), 1e-12))


def _evidence(scores: list[float], n: int, model: ToxicityModel) -> tuple[float, float]:
    """The most significant segment and, on a log scale, the sum over all significant ones."""
    significant = [g for x in scores if (g := _significance(x, n, model)) > 0]
    return max(significant, default=0.0), math.log1p(sum(significant))


def _curve(model: ToxicityModel, best: float, total: float) -> float:
    a, b, c = model.curve
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * best + c * total))))


def _log_odds(counts: Mapping[str, tuple[int, int]], toxic_words: int, clean_words: int) -> dict[str, float]:
    """Scores of the telling terms among (toxic, clean) counts: posterior rates under the prior of the next shorter stem."""
    rate = toxic_words / (toxic_words + clean_words)
    base = math.log(rate / (1 - rate))
    posterior: dict[str, float] = {}
    told = [w for w, (a, b) in counts.items() if a >= MIN_TOXIC and a * clean_words > 2 * b * toxic_words]
    for term in sorted(told, key=lambda w: (w[1:2] != " ", int(w[0]) if w[1:2] == " " else 0)):  # stems first, short ones before long ones
        a, b = counts[term]
        word, n = (term[2:], int(term[0])) if term[1:2] == " " else (term, 99)
        parent = next((posterior[k] for m in reversed(STEMS) if m < min(n, len(word)) and (k := f"{m} {word[:m]}") in posterior), rate)
        posterior[term] = (a + PRIOR * parent) / (a + b + PRIOR)
    return {w: x for w, p in posterior.items() if (x := math.log(p / max(1 - p, 1e-9)) - base) > MIN_SCORE}


def _law(positive: np.ndarray, others: int, n_segments: int, top: float) -> tuple[float, float]:
    """Scale and constant of the extreme-value law of chance segments.

    positive are the scores above 0 among the tokens of clean texts, others is the number of their other tokens.
    The scale is the root above 0 of E[exp(scale x score)] = 1; one token of the highest score is added, so there
    is a root for texts without any positive token as well. The constant makes the law expect the number of
    segments that there were, all of them at least as high as the lowest positive score.
    """
    scores = np.append(positive, top)

    def excess(scale: float) -> float:
        return float(np.exp(scale * scores).sum()) + others * math.exp(-scale * COST) - others - len(scores)

    low, high = 0.0, 1.0
    while excess(high) <= 0 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) <= 0 else (low, middle)
    scale = max(low, 1e-3)
    return scale, (n_segments + 0.5) / (others + len(scores)) * math.exp(scale * float(scores.min()))


def _terms_of(text: str) -> tuple[set[str], Counter]:
    words = set(WORD.findall(text.lower()))
    return words, Counter(f"{n} {w[:n]}" for w in words for n in STEMS if len(w) > n)


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 16_000, seed: int = 11) -> ToxicityModel:
    """Learn from labelled rows: about max_docs at most, drawn by a hash of the id; copies of a text count once.

    docs has doc_id and text, labels doc_id and toxic. Counts are summed on the executors; the driver receives
    those of the terms that MIN_TOXIC toxic texts of the sample have, so max_docs bounds them.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    marks = labels.select(F.col("doc_id").alias("i"), F.col("toxic").cast("int").alias("y")).filter("y in (0, 1) and i is not null").groupBy("i").agg(F.max("y").alias("y"))
    total = marks.count()
    marks = marks.filter(hash_share(F.col("i"), seed) < min(1.0, max_docs / max(1, total)))
    texts = docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t")).filter("t is not null").join(F.broadcast(marks), "i")
    key = F.xxhash64("t").alias("h")
    rows = texts.groupBy(key).agg(F.first("t").alias("t"), F.max("y").alias("y")).select("t", "y", F.pmod("h", F.lit(FOLDS)).cast("int").alias("f"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[int, tuple[Counter, Counter]] = {}
            for t, y, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, stems = _terms_of(t)
                own = sums.setdefault(f, (Counter(), Counter()))[y]
                own.update(words)
                own.update(stems)
                own[" "] += 1
                own["  "] += len(words)
            for f, (clean, toxic) in sums.items():
                terms = list(clean.keys() | toxic.keys())
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([f] * len(terms), pa.int32()), pa.array([toxic[x] for x in terms], pa.int64()), pa.array([clean[x] for x in terms], pa.int64())], names=["w", "f", "a", "b"])

    of = lambda c, k: F.sum(F.when(F.col("f") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}")
    counted = rows.mapInArrow(count, "w string, f int, a long, b long").groupBy("w").agg(F.sum("a").alias("a"), *[of(c, k) for c in "ab" for k in range(FOLDS)])
    got = counted.filter((F.col("a") >= MIN_TOXIC) | F.col("w").isin(" ", "  ")).collect()
    by_term = {r["w"]: ([r[f"a{k}"] for k in range(FOLDS)], [r[f"b{k}"] for k in range(FOLDS)]) for r in got}
    none = ([0] * FOLDS, [0] * FOLDS)
    toxic, clean = (sum(x) for x in by_term.pop(" ", none))
    in_toxic, in_clean = by_term.pop("  ", none)
    if not sum(in_toxic) or not sum(in_clean):
        base = 1.0 if toxic and not clean else 0.0
        return ToxicityModel(base, curve=(30.0 if base else -30.0, 0.0, 0.0))

    def without(k: int | None) -> dict[str, float]:
        """Scores from all folds but the k-th."""
        rest = lambda x: sum(v for j, v in enumerate(x) if j != k)
        if not rest(in_toxic) or not rest(in_clean):
            return {}
        return _log_odds({w: (rest(a), rest(b)) for w, (a, b) in by_term.items()}, rest(in_toxic), rest(in_clean))

    model = ToxicityModel(toxic / (toxic + clean), without(None))
    crossed = spark.sparkContext.broadcast([without(k) for k in range(FOLDS)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = [_Scores(x) for x in crossed.value]
        for batch in batches:
            out = [(y, *_scan(t, scores[f])) for t, y, f in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            doubles = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int32()), pa.array([len(x[1]) for x in out], pa.int64()), pa.array([x[1][x[1] > 0].tolist() if not x[0] else [] for x in out], doubles), pa.array([len(x[2]) for x in out], pa.int64()), pa.array([[f[2] for f in x[3]] for x in out], doubles)],
                names=["y", "n", "p", "k", "s"],
            )

    scanned = rows.mapInArrow(scan, "y int, n long, p array<double>, k long, s array<double>").toArrow().to_pylist()  # max_docs rows at most
    benign = [r for r in scanned if not r["y"]]
    positive = np.array([x for r in benign for x in r["p"]])
    model.scale, model.constant = _law(positive, sum(r["n"] for r in benign) - len(positive), sum(r["k"] for r in benign), max(model.terms.values(), default=1.0))
    model.curve = _logistic(np.array([(*_evidence(r["s"], r["n"], model), r["y"]) for r in scanned], float))
    return model


def _logistic(points: np.ndarray, ridge: float = 1e-1, rounds: int = 100) -> tuple[float, float, float]:
    """A ridged logistic curve over (best, total) by damped Newton steps; slopes are kept from being negative."""
    x, y = np.column_stack([np.ones(len(points)), points[:, :2]]), points[:, 2]
    scale = np.maximum(x.std(axis=0), 1e-9)
    scale[0] = 1.0
    x = x / scale
    penalty = ridge * np.array([1e-3, 1, 1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + (penalty * w * w).sum() / 2)

    w = np.array([math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 0.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step, size = np.linalg.solve(h, x.T @ (y - p) - penalty * w), 1.0
        while size > 1e-6:
            tried = w + size * step
            tried[1:] = np.maximum(0, tried[1:])
            if loss(tried) < loss(w):
                break
            size /= 2
        else:
            break
        w = tried
    return tuple(float(v) for v in w / scale)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted and every significant passage (token range, raw and normalised score) of each whole text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    held = docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t"))
    passage = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("raw", pa.float64()), ("significance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        scores = _Scores(own.terms)
        for batch in batches:
            points, spans = [], []
            for t in batch.column(1).to_pylist():
                values, found, damped = _scan(t, scores)
                points.append(_curve(own, *_evidence([x for _, _, x in damped], len(values), own)))
                spans.append([{"start": s, "end": e, "raw": x, "significance": g} for s, e, x in found if (g := _significance(x, len(values), own)) > 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(points, pa.float64()), pa.array(spans, pa.list_(passage))], names=["i", "score", "passages"])

    kind = held.schema["i"].dataType.simpleString()
    out = held.mapInArrow(run, f"i {kind}, score double, passages array<struct<start:int,end:int,raw:double,significance:double>>")
    return out.select(F.col("i").alias("doc_id"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")


def detect(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out_fold: int = 1, **options) -> DataFrame:
    """Learn outside the held-out fold, score every text: doc_id, held_out, score, predicted, n_passages."""
    in_fold = F.coalesce(fold("doc_id", folds) == held_out_fold, F.lit(False))
    model = fit(docs, labels.select("doc_id", "toxic").filter(~in_fold), **options)
    return score(docs, model).select("doc_id", in_fold.alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))

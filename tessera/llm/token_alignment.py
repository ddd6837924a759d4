"""Cross-tokenizer alignment by segment deduplication.

Two tokenizers' encodings of a text are cut where tokens of both end at the same byte; all tokens of a group
so made are linked. Texts are split before white space where neither vocabulary has a token that reaches over
(`split_marks` verifies that), so a text's tokens are those of its segments, one after the other. Chunks of
documents become lists of numbers of segments; the chunks' segments meet in a sort by segment, where each
distinct one is tokenised and aligned once, and go back to their chunks, where the documents are composed.

What a pair of ids counts is the number of documents that have it linked. A chunk gives one row for each of its
distinct pairs and keeps which documents have them; the sums come back to the chunk by the pair's number.

A chunk has CHUNK_BYTES of text, or one longer text; nothing larger is held by a task. No key has more than one
row of a chunk, so none is hot. Everything is exact.

Defined results: a text that is null, empty or whose tokens don't give back its bytes (one with U+2581) has no
tokens: all zeros and an empty digest. Repeated rows are documents of their own, with a null id as well. Very
long texts are taken whole; one without white space is one segment. Other columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, give_back, materialise

CHUNK_BYTES = 16 << 20
#: Segments of a task that wait to be sent to their chunks together.
PACK_SEGMENTS = 250_000
#: Segment numbers of the documents that are composed together.
COMPOSE_SEGMENTS = 100_000
#: Segments of a chunk whose texts and pairs are made together.
SLICE_SEGMENTS = 40_000
#: White space before which a text may be split if the vocabularies allow it.
MARKS = " \t\n\x0b\x0c"
_SPACE_SIGN = "▁"


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class _Tokenizers:
    """Both tokenizers with the bytes of their tokens, by id, and the marks before which texts may be split."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        alphabet = _byte_alphabet()
        with open(byte_level, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.space = self.b.piece_to_id(_SPACE_SIGN)
        self.marks = split_marks(self.a_bytes, self.b_bytes)
        kept = "".join(map(re.escape, self.marks))
        # a segment goes on over white space before which texts aren't split
        self.segments = re.compile(rf"\s*\S*(?:[^\S{kept}]\s*\S*)*").findall
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace(_SPACE_SIGN, " ").encode()

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each segment by both; the second one puts a space before each text, which is the segment's own or goes again."""
        first = [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        own = [s[0] == " " for s in segments]
        second = self.b.encode([s[1:] if o else s for s, o in zip(segments, own, strict=True)], num_threads=1)
        return first, [(t or [self.space]) if o else t[1:] for t, o in zip(second, own, strict=True)]


def split_marks(first: list[bytes], second: list[bytes]) -> str:
    """The marks that no token of either has after a byte that isn't white space, nor one of the second after a space, which it puts before each text."""

    def joined(token: bytes, mark: str, space: bool) -> bool:
        text = token.decode("utf-8", "replace")  # broken characters count as no white space
        return any(y == mark and not x.isspace() or space and x + y == " " + mark for x, y in zip(text, text[1:], strict=False))

    return "".join(m for m in MARKS if not any(joined(t, m, False) for t in first) and not any(joined(t, m, m != " ") for t in second))


@functools.lru_cache(maxsize=2)
def _tokenizers(byte_level: str, pieces: str) -> _Tokenizers:
    return _Tokenizers(byte_level, pieces)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers below 2 ** 32 as one compressed value, bytes of equal weight together."""
    sizes = np.array([len(a) for a in arrays], np.uint32)
    flat = np.concatenate([sizes, *[np.asarray(a, np.uint32) for a in arrays]]).astype(np.uint32)
    return zstandard.compress(np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(value: bytes, arrays: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(value), np.uint8).reshape(4, -1)
    flat = np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64)
    return np.split(flat[arrays:], np.cumsum(flat[:arrays])[:-1])


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from first[k] on, sizes[k] of them, for all k."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)


def align(tok: _Tokenizers, segments: list[str]) -> tuple[np.ndarray, ...]:
    """Groups of each segment (-1: tokens don't give back its bytes), tokens of each group by either, and all ids."""
    a, b = tok.encode(segments)
    good = [b"".join([tok.a_bytes[i] for i in x]) == (raw := s.encode("utf-8", "surrogatepass")) == b"".join([tok.b_bytes[i] for i in y]) for s, x, y in zip(segments, a, b, strict=True)]
    a, b = ([i for x, g in zip(t, good, strict=True) if g for i in x] for t in (a, b))
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    ends_a, ends_b = np.cumsum(tok.a_size[a]), np.cumsum(tok.b_size[b])
    cuts = np.intersect1d(ends_a, ends_b)
    in_a, in_b = np.diff(np.searchsorted(ends_a, cuts, "right"), prepend=0), np.diff(np.searchsorted(ends_b, cuts, "right"), prepend=0)
    sizes = np.array([len(s.encode("utf-8", "surrogatepass")) if g else 0 for s, g in zip(segments, good, strict=True)], np.int64)
    groups = np.diff(np.searchsorted(cuts, np.cumsum(sizes), "right"), prepend=0)
    groups[~np.array(good, bool)] = -1
    return groups, in_a, in_b, a, b


def _chunked(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Rows of documents (chunk, ids, codes: packed numbers of their segments) and rows of a chunk's segments (chunk, code, segment)."""
    kind, chunk_bytes = docs.schema["doc_id"].dataType.simpleString(), CHUNK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok = _tokenizers(*paths)
        chunk = TaskContext.get().partitionId() << 32
        names = ["chunk", "ids", "codes", "code", "segment"]
        known: dict[str, int] = {}
        size, ids_type = 0, pa.int64()

        def told(ids: list[pa.Scalar], lengths: list[int], codes: list[int]) -> pa.RecordBatch:
            own = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, ids_type))
            packed = _pack(np.array(lengths, np.int64), np.array(codes, np.int64))
            return pa.RecordBatch.from_arrays([pa.array([chunk]), own, pa.array([packed], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string())], names=names)

        def segments() -> Iterator[pa.RecordBatch]:
            own = list(known)
            for low in range(0, len(own), 50_000):
                part = own[low : low + 50_000]
                m = len(part)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, chunk)), pa.nulls(m, pa.list_(ids_type)), pa.nulls(m, pa.binary()), pa.array(np.arange(low, low + m, dtype=np.int32)), pa.array(part, pa.string())], names=names)

        for batch in batches:
            ids_type = batch.schema.field(0).type
            ids, lengths, codes = [], [], []
            for i, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if size and size + len(text or "") > chunk_bytes:
                    if ids:
                        yield told(ids, lengths, codes)
                    ids, lengths, codes = [], [], []
                    yield from segments()
                    known, size, chunk = {}, 0, chunk + 1
                ids.append(i.as_py())
                own = tok.segments(" " + text) if text and _SPACE_SIGN not in text else []
                before = len(codes)
                codes += [known.setdefault(s, len(known)) for s in own if s]
                lengths.append(len(codes) - before)
                size += len(text or "")
            if ids:
                yield told(ids, lengths, codes)
        yield from segments()
        known = {}
        give_back()

    return docs.mapInArrow(run, f"chunk long, ids array<{kind}>, codes binary, code int, segment string")


def _aligned(segments: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Rows (chunk, packed): alignments of a chunk's segments. Each distinct segment is a run of a sorted partition and is tokenised once."""
    rows, pack_segments = segments.repartition("segment").sortWithinPartitions("segment"), PACK_SEGMENTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizers(*paths)
        held, size, last, last_found = [], 0, None, None

        def sent() -> Iterator[pa.RecordBatch]:
            """What is held, a row for each chunk."""
            chunk, code = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            groups, in_a, in_b, a, b, which = (np.concatenate([h[k] for h in held]) for k in range(2, 8))
            own = np.maximum(groups, 0)
            first = _starts(own)
            first_a, first_b = _starts(in_a), _starts(in_b)
            order = np.argsort(chunk, kind="stable")
            cuts = np.flatnonzero(np.diff(chunk[order])) + 1
            for rows_of in np.split(order, cuts):
                s = which[rows_of]
                g = _ranges(first[s], own[s])
                packed = _pack(code[rows_of], groups[s] + 1, in_a[g], in_b[g], a[_ranges(first_a[g], in_a[g])], b[_ranges(first_b[g], in_b[g])])
                yield pa.RecordBatch.from_arrays([pa.array(chunk[rows_of[:1]]), pa.array([packed], pa.binary())], names=["chunk", "packed"])

        done = 0
        for batch in batches:
            coded = batch.column(2).dictionary_encode()
            distinct, number = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            again = last is not None and distinct[0] == last
            found = align(tok, distinct[again:])
            if again:  # the run goes on over the end of a batch
                found = tuple(np.concatenate((x, y)) for x, y in zip(last_found, found, strict=True))
            tail = int(max(found[0][-1], 0))
            ta, tb = int(found[1][len(found[1]) - tail :].sum()), int(found[2][len(found[2]) - tail :].sum())
            last, last_found = distinct[-1], (found[0][-1:], *(x[len(x) - k :] for x, k in zip(found[1:], (tail, tail, ta, tb), strict=True)))
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), *[x.astype(np.int32) for x in (*found, number + done)]))
            done += len(distinct)
            size += batch.num_rows
            if size >= pack_segments:
                yield from sent()
                held, size, done = [], 0, 0
        if held:
            yield from sent()
            held = []
        give_back()

    return rows.select("chunk", "code", "segment").mapInArrow(run, "chunk long, packed binary")


class _Chunk:
    """The alignments of all segments of a chunk, by code."""

    def __init__(self, packs: list[bytes]) -> None:
        parts = [[x.astype(np.int32) for x in _unpack(p, 6)] for p in packs]
        code, groups, in_a, in_b, a, b = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int32) for k in range(6))
        del parts
        order = np.argsort(code)
        own = np.maximum(groups - 1, 0)
        g = _ranges(_starts(own)[:-1][order], own[order])
        self.bad = groups[order] == 0
        self.groups = own[order]
        self.in_a, self.in_b = in_a[g], in_b[g]
        self.a, self.b = a[_ranges(_starts(in_a)[:-1][g], self.in_a)], b[_ranges(_starts(in_b)[:-1][g], self.in_b)]
        self.segment = np.repeat(np.arange(len(self.groups)), self.groups)

    def totals(self) -> np.ndarray:
        """Tokens of either, groups and links of each segment."""
        m = len(self.groups)
        by = lambda x: np.bincount(self.segment, x, m).astype(np.int64)
        return np.stack([by(self.in_a), by(self.in_b), self.groups, by(self.in_a.astype(np.int64) * self.in_b)])

    def _slices(self) -> Iterator[tuple[int, int, tuple[np.ndarray, ...]]]:
        """Slices of the segments (from, to): of each group there its segment, counted from the slice's first, its tokens, and the ids."""
        first, first_a, first_b = _starts(self.groups), _starts(self.in_a), _starts(self.in_b)
        for low in range(0, len(self.groups), SLICE_SEGMENTS):
            high = min(low + SLICE_SEGMENTS, len(self.groups))
            g = slice(first[low], first[high])
            yield low, high, (self.segment[g] - low, self.in_a[g], self.in_b[g], self.a[first_a[g.start] : first_a[g.stop]], self.b[first_b[g.start] : first_b[g.stop]])

    def texts(self) -> list[str]:
        """The groups of each segment as text."""
        out = [""] * len(self.groups)
        for low, high, own in self._slices():
            for i, line in zip((np.flatnonzero(self.groups[low:high]) + low).tolist(), self._lines(*own), strict=False):
                out[i] = line
        return out

    @staticmethod
    def _lines(of: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[str]:
        """The groups of the segments `of` as one text for each segment that has any."""
        start_a, start_b = _starts(in_a)[:-1], _starts(in_b)[:-1]
        both = np.zeros(len(a) + len(b), np.int64)
        sign = np.zeros(len(both), np.int64)
        at_a, at_b = _ranges(start_a + start_b, in_a), _ranges(start_a + start_b + in_a, in_b)
        both[at_a], both[at_b] = a, b
        sign[start_a + start_b + in_a - 1] = 1
        last = start_a + start_b + in_a + in_b - 1
        sign[last] = 2
        sign[last[np.flatnonzero(np.concatenate((of[1:] != of[:-1], [True])))] if len(of) else last] = 3
        values, which = np.unique(both << 2 | sign, return_inverse=True)
        names = [f"{v >> 2}{',|;\n'[v & 3]}" for v in values.tolist()]
        return "".join([names[i] for i in which.tolist()]).split("\n")

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct linked pairs of the chunk (a << 32 | b), and those of each segment: where they start, their numbers, how often they are linked."""
        parts = [self._pairs(high - low, *own) for low, high, own in self._slices()]
        if not parts:
            none = np.zeros(0, np.int64)
            return none, _starts(none), none, none
        pair = np.unique(np.concatenate([p[0] for p in parts]))
        numbers = np.concatenate([np.searchsorted(pair, own)[number] for own, _, number, _ in parts])
        return pair, _starts(np.concatenate([p[1] for p in parts])), numbers, np.concatenate([p[3] for p in parts])

    @staticmethod
    def _pairs(segments: int, of: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of a slice, and those of each segment: how many, their numbers in order, how often they are linked."""
        group = np.arange(len(in_a))

        def distinct(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keys, times = np.unique(np.repeat(group, sizes) << 32 | ids, return_counts=True)
            return np.bincount(keys >> 32, minlength=len(group)), keys & 0xFFFFFFFF, times

        na, a, ta = distinct(a, in_a)
        nb, b, tb = distinct(b, in_b)
        many = np.repeat(nb, na)  # each a of a group with each b of it
        left, right = np.repeat(np.arange(len(a)), many), _ranges(np.repeat(_starts(nb)[:-1], na), many)
        pair, number = np.unique(a[left] << 32 | b[right], return_inverse=True)
        size = max(1, len(pair))
        keys, back = np.unique(np.repeat(np.repeat(of, na), many) * size + number, return_inverse=True)
        times = np.bincount(back, ta[left] * tb[right], len(keys)).astype(np.int64)
        segment, number = np.divmod(keys, size)
        return pair, np.bincount(segment, minlength=segments), number, times


def _composed(docs: DataFrame, aligned: DataFrame, kind: str) -> DataFrame:
    """A row for each chunk: results of its documents, its pairs, how many documents have each, and which (packed)."""
    at_once = COMPOSE_SEGMENTS

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = _Chunk(right.column("packed").to_pylist())
        totals, texts = chunk.totals(), chunk.texts()
        pair, start, numbers, times = chunk.pairs()
        bad = chunk.bad
        del chunk  # what follows needs no more of it
        per_segment = np.diff(start)
        ids, sums, digests, have = [], [], [], np.zeros(len(pair), np.int64)
        sizes, gaps, often = [], [], []

        def compose(lengths: np.ndarray, codes: np.ndarray) -> None:
            of = np.repeat(np.arange(len(lengths)), lengths)
            gone = np.bincount(of, bad[codes], len(lengths)) > 0
            own = np.stack([np.bincount(of, t[codes], len(lengths)).astype(np.int64) for t in totals]) * ~gone
            sums.append(own)
            at = _starts(lengths).tolist()
            listed = codes.tolist()
            for k, none in enumerate((gone | (lengths == 0)).tolist()):
                digests.append("" if none else hashlib.sha256(";".join([texts[c] for c in listed[at[k] : at[k + 1]]]).encode()).hexdigest())
            keys, repeated = np.unique((of << 32 | codes)[~gone[of]], return_counts=True)
            doc, code = keys >> 32, keys & 0xFFFFFFFF
            entries = _ranges(start[code], per_segment[code])
            full = np.repeat(doc, per_segment[code]) * max(1, len(pair)) + numbers[entries]
            linked, back = np.unique(full, return_inverse=True)
            links = np.bincount(back, times[entries] * np.repeat(repeated, per_segment[code]), len(linked)).astype(np.int64)
            doc, number = np.divmod(linked, max(1, len(pair)))
            have[:] += np.bincount(number, minlength=len(pair))
            each = np.bincount(doc, minlength=len(lengths))
            first = np.zeros(len(number), bool)
            first[_starts(each)[:-1][each > 0]] = True
            sizes.append(each)
            gaps.append(np.where(first, number, np.diff(number, prepend=0)).astype(np.uint32))
            often.append(links.astype(np.uint32))

        for row in range(left.num_rows):
            ids.extend(left.column("ids")[row].as_py())
            lengths, codes = _unpack(left.column("codes")[row].as_py(), 2)
            ends, low = np.cumsum(lengths), 0
            while low < len(lengths):
                before = int(ends[low - 1]) if low else 0
                high = max(low + 1, int(np.searchsorted(ends, before + at_once, "right")))
                compose(lengths[low:high], codes[before : int(ends[high - 1])])
                low = high
        both = np.concatenate(sums, axis=1)
        columns = {"ids": ids, "n_a": both[0], "n_b": both[1], "n_groups": both[2], "n_links": both[3], "digests": digests, "pairs": pair, "docs": have}
        columns |= {"linked": _pack(np.concatenate(sizes), np.concatenate(gaps), np.concatenate(often))}
        types = {"ids": left.schema.field("ids").type, "digests": pa.list_(pa.string()), "linked": pa.binary()}
        del texts, totals, numbers, times, start, sums, sizes, gaps, often
        give_back()
        return pa.table({"chunk": left.column("chunk").slice(0, 1)} | {c: pa.array([v], types.get(c, pa.list_(pa.int64()))) for c, v in columns.items()})

    names = f"chunk long, ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, pairs array<long>, docs array<long>, linked binary"
    return docs.groupBy("chunk").cogroup(aligned.groupBy("chunk")).applyInArrow(run, names)


def link_counts(composed: DataFrame) -> DataFrame:
    """(pair, n_docs, best) of every linked pair of ids, a << 32 | b: in how many documents it is linked, and whether that is the most of its a."""
    pairs = composed.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("p.pairs", "p.docs")
    counts = materialise(pairs.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("n_docs")), "counts")
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("n_docs").alias("most"))  # a row for each id of a vocabulary
    return counts.join(F.broadcast(most), a == F.col("a")).select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def _summed(composed: DataFrame, counts: DataFrame, kind: str) -> DataFrame:
    """The documents' rows with sums over the counts of their links."""
    numbered = composed.select("chunk", F.posexplode("pairs").alias("at", "pair")).join(counts, "pair").select(F.col("chunk").alias("of_chunk"), "at", "n_docs", "best")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = right.num_rows
        value, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at = right.column("at").to_numpy()
        value[at], best[at] = right.column("n_docs").to_numpy(), right.column("best").to_numpy()
        sizes, gaps, often = _unpack(left.column("linked")[0].as_py(), 3)
        of = np.repeat(np.arange(len(sizes)), sizes)
        total = np.cumsum(gaps)
        first = _starts(sizes)[:-1]
        base = np.where(sizes > 0, (total - gaps)[np.minimum(first, max(0, len(gaps) - 1))], 0) if len(gaps) else np.zeros(len(sizes), np.int64)
        number = total - base[of]
        sums = [np.bincount(of, often * x[number], len(sizes)).astype(np.int64) for x in (best, value)]
        own = [left.column(c).combine_chunks().flatten() for c in ("ids", "n_a", "n_b", "n_groups", "n_links", "digests")]
        return pa.Table.from_arrays([*own[:5], pa.array(sums[0]), pa.array(sums[1]), own[5]], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    own = composed.select("chunk", "ids", "n_a", "n_b", "n_groups", "n_links", "digests", "linked")
    return own.groupBy("chunk").cogroup(numbered.groupBy("of_chunk")).applyInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align_documents(docs: DataFrame, byte_level: str, pieces: str, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Both results: a row for each document, as align_texts gives it, and the linked pairs' counts, as link_counts gives them."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    chunked = materialise(_chunked(rows, (byte_level, pieces)), "chunks")
    aligned = _aligned(chunked.filter("segment is not null").select("chunk", "code", "segment"), (byte_level, pieces))
    composed = materialise(_composed(chunked.filter("ids is not null").select("chunk", "ids", "codes"), aligned, kind), "composed")
    counts = link_counts(composed)
    return _summed(composed, counts, kind), counts.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "n_docs", "best")


def align_texts(docs: DataFrame, byte_level: str, pieces: str, **columns) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    return align_documents(docs, byte_level, pieces, **columns)[0]

"""Token files: a wavelet matrix per shard.

Texts become token ids with a given tokenizer, an end id closing each. Shards hold whole documents in
ascending order of doc_id. A shard is one blob: a header, the documents' ids and lengths, and the bit-planes
of a wavelet matrix with their rank directory. Documents, directory and every PLANE_BYTES of a plane are
compressed by themselves, so access(), count() and locate() unpack only the pieces of the planes that they
touch; a whole-shard read unpacks all. Blobs are cells of a Parquet table, since that is what Spark can write
to and read from any store.

Defined results: a null text counts as empty and has the end id alone. Null doc_ids come first; ids of any
atomic type keep it (strings in their binary order). Rows with the same doc_id are in the order of their
texts' hashes; exact repeats stand beside each other. Very long texts are encoded whole. An empty table makes
a table without shards. Ids that `bits` can't hold are refused; other columns of the input are ignored.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from functools import cached_property
from unicodedata import category, is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, shared_dir

MAGIC = b"TWM2"
SHARD_TOKENS = 1 << 20
PARTITION_BYTES = 24 << 20
#: Parts at most; the driver holds a number for each.
MAX_PARTS = 20_000
BLOCK_BITS = 512
#: Bytes of a plane that are compressed together, a multiple of a block.
PLANE_BYTES = 16_384
COLUMNS = "part int, seq int, base long, n_docs long, n_tokens long, first_id {kind}, shard binary"
#: Pieces that a worker remembers, some 200 bytes each; of more, those of at most SHORT characters.
CACHE = 500_000
SHORT = 9
WORDS_AT_ONCE = 400
#: What the encoder's short cuts rely on; any other tokenizer encodes whole texts.
_SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
    "model": {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "ignore_merges": False},
}


def _steady(c: str) -> bool:
    """Whether a character is its own NFC, composes with none before it and has a lower case of one such character."""
    return category(c)[0] != "M" and is_normalized("NFC", c) and len(c.lower()) == 1 and is_normalized("NFC", c.lower())


#: Latin letters, signs and symbols: in texts of these alone NFC changes nothing, before or after lower case.
_STEADY = frozenset(c for c in map(chr, (*range(0x2B0), *range(0x2010, 0x2C00))) if _steady(c))
_RUNS = re.compile(r"[^\W\d_]+|[\W\d_]+")
#: Latin letters, digits and marks without an apostrophe, a combining character or white space.
_SPLITS = re.compile(r"[!-&(-~\u00a1-\u012f\u0131-\u02af]+")


_PRESS = zstandard.ZstdCompressor(level=1)
_unpress = zstandard.ZstdDecompressor().decompress


class PackedPlane:
    """The bytes of a bit-plane, unpacked piece by piece as slices of it are read."""

    def __init__(self, size: int, pieces: Sequence[bytes]) -> None:
        self.size, self.pieces = size, pieces
        self.open: dict[int, np.ndarray] = {}

    def _piece(self, k: int) -> np.ndarray:
        if k not in self.open:
            self.open[k] = np.frombuffer(_unpress(self.pieces[k]), np.uint8)
        return self.open[k]

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at: int | slice) -> np.ndarray | int:
        if not isinstance(at, slice):
            return self._piece(at // PLANE_BYTES)[at % PLANE_BYTES]
        low, high, _ = at.indices(self.size)
        if low >= high:
            return np.zeros(0, np.uint8)
        first = low // PLANE_BYTES
        parts = [self._piece(k) for k in range(first, (high - 1) // PLANE_BYTES + 1)]
        whole = parts[0] if len(parts) == 1 else np.concatenate(parts)
        return whole[low - first * PLANE_BYTES : high - first * PLANE_BYTES]


class WaveletMatrix:
    """Bit-planes from the highest bit; on each level the zeros of the level above come first, then its ones."""

    def __init__(self, size: int, planes: list[np.ndarray | PackedPlane], ones: list[np.ndarray], zeros: list[int]) -> None:
        self.size, self.planes, self.ones, self.zeros = size, planes, ones, zeros

    @classmethod
    def build(cls, tokens: np.ndarray, bits: int) -> WaveletMatrix:
        planes, ones, zeros = [], [], []
        rest = tokens.astype(np.uint16 if bits <= 16 else np.uint32)
        for level in range(bits - 1, -1, -1):
            bit = (rest >> rest.dtype.type(level)) & rest.dtype.type(1)
            flag = bit.astype(bool)
            plane = np.packbits(flag, bitorder="little")
            planes.append(plane)
            ones.append(cls._directory(plane))
            order = np.concatenate((np.flatnonzero(~flag), np.flatnonzero(flag)))
            zeros.append(len(flag) - int(np.count_nonzero(flag)))
            rest = rest.take(order)
        return cls(len(tokens), planes, ones, zeros)

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        """Ones before each block of BLOCK_BITS."""
        step = BLOCK_BITS // 8
        padded = np.zeros(-(-len(plane) // step) * step, np.uint8)
        padded[: len(plane)] = plane
        per_block = np.bitwise_count(padded).reshape(-1, step).sum(axis=1, dtype=np.uint32)
        return np.concatenate(([0], np.cumsum(per_block))).astype(np.uint32)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (i & 7)) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones in the first i bits of a level."""
        block = i // BLOCK_BITS
        inside = self.planes[level][block * BLOCK_BITS // 8 : (i + 7) // 8]
        n = int(self.ones[level][block]) + int(np.bitwise_count(inside).sum())
        return n - (int(inside[-1] >> (i & 7)).bit_count() if i & 7 and len(inside) else 0)

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of this value on a level."""
        sums = self.ones[level].astype(np.int64)
        if not bit:
            sums = np.arange(len(sums)) * BLOCK_BITS - sums
        block = int(np.searchsorted(sums, k, "right")) - 1
        flags = np.unpackbits(self.planes[level][block * BLOCK_BITS // 8 : (block + 1) * BLOCK_BITS // 8], bitorder="little")
        return block * BLOCK_BITS + int(np.flatnonzero(flags == bit)[k - int(sums[block])])

    def access(self, i: int) -> int:
        value = 0
        for level in range(len(self.planes)):
            bit, ahead = self._bit(level, i), self._rank1(level, i)
            value, i = value << 1 | bit, self.zeros[level] + ahead if bit else i - ahead
        return value

    def rank(self, token: int, end: int | None = None) -> int:
        """Occurrences of the token among the first end ids (all by default)."""
        low, high = self._range(token, self.size if end is None else end)
        return high - low

    def _range(self, token: int, high: int) -> tuple[int, int]:
        low = 0
        if token >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self._rank1(level, low), self._rank1(level, high)
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if token >> (len(self.planes) - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def select(self, token: int, k: int) -> int:
        """Position of the token's k-th occurrence, from 0."""
        low, high = self._range(token, self.size)
        if not 0 <= k < high - low:
            raise IndexError(k)
        i = low + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.rank(token))]

    def decode(self) -> np.ndarray:
        """All ids: from the deepest level up, each level's order is undone."""
        rest = np.zeros(self.size, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            flag = np.unpackbits(self.planes[level][:], count=self.size, bitorder="little").astype(bool)
            up = np.empty_like(rest)
            up[np.flatnonzero(~flag)] = rest[: self.zeros[level]]
            up[np.flatnonzero(flag)] = rest[self.zeros[level] :] | rest.dtype.type(1 << (len(self.planes) - 1 - level))
            rest = up
        return rest.astype("<u4")


def _packed(parts: Sequence[bytes]) -> bytes:
    """Number and sizes of the parts, then the parts, each compressed by itself."""
    pressed = [_PRESS.compress(x) for x in parts]
    return struct.pack("<I", len(pressed)) + np.array([len(x) for x in pressed], "<u4").tobytes() + b"".join(pressed)


def _parts(blob: memoryview) -> tuple[list[memoryview], memoryview]:
    """The parts, still compressed, and what follows them."""
    (n,) = struct.unpack_from("<I", blob)
    ends = 4 + 4 * n + np.concatenate(([0], np.cumsum(np.frombuffer(blob, "<u4", n, 4)))).astype(np.int64)
    return [blob[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], blob[int(ends[-1]) :]


def _needed_bits(top: int) -> int:
    return max(1, int(top).bit_length())


def write_shard(ids: pa.Array, lengths: Sequence[int], tokens: np.ndarray, bits: int) -> bytes:
    if len(tokens) and _needed_bits(tokens.max()) > bits:
        raise ValueError(f"token id {int(tokens.max())} needs more than {bits} bits")
    matrix = WaveletMatrix.build(tokens, bits)
    sink = pa.BufferOutputStream()
    documents = pa.RecordBatch.from_arrays([ids, pa.array(lengths, pa.int64())], names=["doc_id", "n_tokens"])
    with pa.ipc.new_stream(sink, documents.schema) as out:
        out.write_batch(documents)
    head = [sink.getvalue().to_pybytes(), np.array(matrix.zeros, "<u4").tobytes(), *(o.astype("<u4").tobytes() for o in matrix.ones)]
    planes = [_packed([p[at : at + PLANE_BYTES].tobytes() for at in range(0, len(p), PLANE_BYTES)]) for p in matrix.planes]
    return MAGIC + struct.pack("<IB", len(tokens), bits) + _packed(head) + b"".join(planes)


class Shard:
    """A written shard; nothing is unpacked before it is asked for."""

    def __init__(self, blob: bytes) -> None:
        if blob[:4] != MAGIC:
            raise ValueError("not a token shard")
        self.size, self.bits = struct.unpack_from("<IB", blob, 4)
        self._head, self._rest = _parts(memoryview(blob)[9:])

    def _unpack(self, k: int) -> bytes:
        return _unpress(self._head[k])

    @cached_property
    def documents(self) -> pa.Table:
        """doc_id and n_tokens."""
        return pa.ipc.open_stream(self._unpack(0)).read_all()

    @cached_property
    def ends(self) -> np.ndarray:
        """End of each document among the shard's tokens."""
        return np.cumsum(self.documents.column(1).to_numpy())

    @cached_property
    def matrix(self) -> WaveletMatrix:
        planes, ones, rest = [], [], self._rest
        for level in range(self.bits):
            pieces, rest = _parts(rest)
            planes.append(PackedPlane(-(-self.size // 8), pieces))
            ones.append(np.frombuffer(self._unpack(2 + level), "<u4"))
        return WaveletMatrix(self.size, planes, ones, np.frombuffer(self._unpack(1), "<u4").tolist())


class Encoder:
    """Exact token ids of a text, with the ids of its pieces between spaces and line ends remembered.

    The tokenizer folds case, collapses white space and splits there before anything else, so pieces can't
    influence each other. It also splits letters from other characters, so a word is encoded without the
    mark behind it, and new words are encoded many at once: every word ends with a token that marks the end.
    Texts with other characters than Latin letters, full stops and commas are split at spaces and line ends alone.
    Case is folded here only in texts of _STEADY characters, which NFC leaves alone; all others go to the
    tokenizer piece by piece as they are, since it composes before it folds. A tokenizer with other settings
    than _SETTINGS encodes whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.top = max(vocabulary.values(), default=0)
        own = json.loads(self.tokenizer.to_str())
        self.special = [x["content"] for x in own["added_tokens"]]
        self.known_settings = all(own[k] == v if not isinstance(v, dict) or k != "model" else v.items() <= own[k].items() for k, v in _SETTINGS.items()) and all(x.startswith("<|") and not any(c.isspace() for c in x) for x in self.special)
        self.closes = np.zeros(self.top + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.letters = {c for c in _STEADY if ord(c) < 0x2B0 and c.isalpha()}
        self.plain = self.letters | set(" \n.,")

    def _learn(self, pieces: list[str]) -> None:
        """Encode each piece by itself."""
        for low in range(0, len(pieces), 20_000):
            part = pieces[low : low + 20_000]
            self.known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True))

    def _learn_words(self, words: list[str]) -> None:
        for low in range(0, len(words), WORDS_AT_ONCE):
            part = words[low : low + WORDS_AT_ONCE]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):  # some word has several parts
                self._learn(part)
                continue
            coded, at = ids.tobytes(), [0, *(4 * ends).tolist()]
            self.known.update((w, coded[at[k] : at[k + 1]]) for k, w in enumerate(part))

    def _prepared(self, text: str | None) -> str:
        """The text with one space between any two pieces that the tokenizer encodes independently of each other."""
        if not text:
            return ""
        used = set(text)
        if used <= _STEADY and "<|" not in text:
            text = text.lower()  # one character at a time, and it makes no special token
            if used <= self.plain and not any(pair in text for pair in ("..", ".,", ",.", ",,")):
                text = text.replace(".", " . ").replace(",", " , ")
        return text.replace("\n", " ")

    def encode(self, texts: list[str | None], end_id: int) -> list[np.ndarray]:
        """The ids of each text and the end id. What is made here has no cycles, so the collector may rest meanwhile."""
        gc.disable()
        try:
            return self._encode(texts, end_id)
        finally:
            gc.enable()

    def _encode(self, texts: list[str | None], end_id: int) -> list[np.ndarray]:
        if not self.known_settings:
            return [np.array([*e.ids, end_id], "<u4") for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        if len(self.known) > CACHE:  # short pieces are the likeliest to come again
            self.known = {w: x for w, x in self.known.items() if len(w) <= SHORT}
            if len(self.known) > CACHE // 2:
                self.known = {"": b""}
        # pieces become numbers of distinct pieces, and only those become Python strings
        lists = pc.split_pattern(pa.array(map(self._prepared, texts), pa.large_string()), " ")
        coded = lists.values.dictionary_encode()
        distinct, which, offsets = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), lists.offsets.to_numpy()
        self._learn_new([w for w in distinct if w not in self.known])
        ids = [self.known[w] for w in distinct]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begins, counts = np.cumsum(sizes) - sizes, sizes[which]
        upto = np.concatenate(([0], np.cumsum(counts)))
        places = np.repeat(begins[which] - upto[:-1], counts) + np.arange(upto[-1])
        ends = upto[offsets[1:]]
        tokens = np.insert(np.frombuffer(b"".join(ids), "<u4")[places], ends, end_id)
        ends += np.arange(1, len(ends) + 1)
        return np.split(tokens, ends[:-1])

    def _learn_new(self, new: list[str]) -> None:
        words = [w for w in new if w.isalpha()]
        if not set("".join(words)) <= self.letters:
            words = [w for w in words if self.letters.issuperset(w)]
        self._learn_words(words)
        if len(words) < len(new):
            # letters and what stands between them are encoded apart, unless an apostrophe or mark joins them
            runs = {w: _RUNS.findall(w) for w in new if w not in self.known and "<|" not in w and _SPLITS.fullmatch(w)}
            parts = set().union(*runs.values()) - self.known.keys()
            self._learn_words([w for w in parts if w.isalpha()])
            self._learn([w for w in parts if not w.isalpha()])
            self.known.update((w, b"".join(map(self.known.__getitem__, r))) for w, r in runs.items())
            self._learn([w for w in new if w not in self.known])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process: what it has learned serves later tasks as well."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, bits: int | None = None) -> None:
    """Write the token shards of docs (doc_id, text) as a table at path.

    Its columns are part, seq, base (ids in the part before the shard), n_docs, n_tokens, first_id and shard.
    bits is what the largest id of the vocabulary needs, unless given.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    width = bits or _needed_bits(max(encoder(tokenizer).top, end_id))
    schema = COLUMNS.format(kind=rows.schema["doc_id"].dataType.simpleString())
    names = [c.split(" ")[0] for c in schema.split(", ")]
    size = rows.agg(F.sum(F.octet_length("text") + 8).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // max(PARTITION_BYTES, size // MAX_PARTS)))
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids: list = []
        held: list[np.ndarray] = []
        size = base = 0
        kind = pa.null()

        def shard() -> pa.RecordBatch:
            all_ids = pa.array(ids, kind)
            blob = write_shard(all_ids, [len(x) for x in held], np.concatenate(held), width)
            numbers = [pa.array([v], t) for v, t in ((part, pa.int32()), (seq, pa.int32()), (base, pa.int64()), (len(held), pa.int64()), (size, pa.int64()))]
            return pa.RecordBatch.from_arrays([*numbers, all_ids.slice(0, 1), pa.array([blob], pa.binary())], names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for i, tokens in zip(batch.column(0).to_pylist(), own.encode(batch.column(1).to_pylist(), end_id), strict=True):
                ids.append(i)
                held.append(tokens.copy())  # without the other texts of the batch
                size += len(tokens)
                if size >= SHARD_TOKENS:
                    yield shard()
                    ids, held, size, seq, base = [], [], 0, seq + 1, base + size
        if held:
            yield shard()

    ordered.mapInArrow(run, schema).write.option("compression", "none").parquet(path)


def _shards(spark: SparkSession, path: str) -> tuple[DataFrame, dict[int, int], str]:
    """The table of shards, the ids of all parts before each (one number for each part), and the type of doc_id."""
    bounded_batches(spark)
    shards = spark.read.parquet(path)
    starts, at = {}, 0
    for r in sorted(shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        starts[r["part"]] = at
        at += r["n"]
    return shards.select("part", "base", "n_tokens", "shard"), starts, shards.schema["first_id"].dataType.simpleString()


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, all from the shards."""
    shards, starts, kind = _shards(spark, path)
    shared = spark.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                shard = Shard(blob.as_py())
                tokens, lengths = shard.matrix.decode(), shard.documents.column(1).to_numpy()
                begins = shard.ends - lengths
                crcs = [zlib.crc32(tokens[b:e].tobytes()) for b, e in zip(begins.tolist(), shard.ends.tolist(), strict=True)]
                ids = shard.documents.column(0).combine_chunks()
                yield pa.RecordBatch.from_arrays([ids, pa.array(begins + (shared.value[part] + base)), pa.array(lengths), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def access(spark: SparkSession, path: str, positions: Sequence[int]) -> DataFrame:
    """(position, token) of these positions among all ids; only shards that hold one are unpacked, piece by piece."""
    shards, starts, _ = _shards(spark, path)
    wanted = np.unique(np.array(positions, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base, n, blob in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), batch.column(3), strict=True):
                first = starts[part] + base
                own = wanted[np.searchsorted(wanted, first) : np.searchsorted(wanted, first + n)]
                if len(own):
                    matrix = Shard(blob.as_py()).matrix
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([matrix.access(i) for i in (own - first).tolist()], pa.int64())], names=["position", "token"])

    return shards.mapInArrow(run, "position long, token long")


def count(spark: SparkSession, path: str, tokens: Sequence[int]) -> DataFrame:
    """(token, n) for each of these tokens: its occurrences in all shards, by ranks alone."""
    shards, _, _ = _shards(spark, path)
    wanted = sorted(set(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(3):
                matrix = Shard(blob.as_py()).matrix
                yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array([matrix.rank(t) for t in wanted], pa.int64())], names=["token", "n"])

    asked = spark.createDataFrame([(t,) for t in wanted], "token long")
    return asked.join(shards.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def locate(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(doc_id, at) of every occurrence of a token: the document and the place within it, from 0."""
    shards, _, kind = _shards(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(3):
                shard = Shard(blob.as_py())
                places = np.array(shard.matrix.occurrences(token), np.int64)
                if len(places):
                    document = np.searchsorted(shard.ends, places, "right")
                    begins = shard.ends - shard.documents.column(1).to_numpy()
                    ids = shard.documents.column(0).combine_chunks().take(pa.array(document))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(places - begins[document])], names=["doc_id", "at"])

    return shards.mapInArrow(run, f"doc_id {kind}, at long")


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write token shards (to path, else into the shared folder) and describe every document from what was written."""
    path = path or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path)

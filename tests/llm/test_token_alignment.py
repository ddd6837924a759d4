"""Alignments of two tokenizers against whole texts encoded one by one, and on messy input."""

import collections
import hashlib
import random

import pytest

from tessera.llm import token_alignment
from tessera.llm.common import table
from tessera.llm.queries import op12_token_alignment, tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(texts):
    """The rows of all texts, each encoded whole."""
    tok = token_alignment._tokenizers(A, B)
    per_text, df = [], collections.Counter()
    for t in texts:
        whole = " " + (t or "")
        a, b = tok.a.encode(whole, add_special_tokens=False).ids, tok.b.encode(t or "")
        if not t or not b"".join(tok.a_bytes[i] for i in a) == whole.encode() == b"".join(tok.b_bytes[i] for i in b):
            per_text.append(None)
            continue
        ends = [[0], [0]]
        for side, ids, size in ((0, a, tok.a_size), (1, b, tok.b_size)):
            for i in ids:
                ends[side].append(ends[side][-1] + int(size[i]))
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = []
        for low, high in zip(cuts, cuts[1:], strict=False):
            own = [[ids[k] for k in range(len(ids)) if low <= e[k] and e[k + 1] <= high] if len(ids) < 300 else ids[e.index(low) : e.index(high)] for ids, e in ((a, ends[0]), (b, ends[1]))]
            groups.append(own)
        links = collections.Counter((x, y) for p, q in groups for x in p for y in q)
        df.update(links.keys())
        per_text.append((len(a), len(b), groups, links))
    most = collections.Counter()
    for (x, _), n in df.items():
        most[x] = max(most[x], n)
    rows = []
    for r in per_text:
        if r is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        na, nb, groups, links = r
        line = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        rows.append((na, nb, len(groups), sum(links.values()), sum(n for (x, y), n in links.items() if df[x, y] == most[x]), sum(n * df[k] for k, n in links.items()), hashlib.sha256(line.encode()).hexdigest()))
    return rows, df, most


def odd_text(r):
    parts = ["the", " ", "  ", "\n", "\n\n", "\t", "\r", "\r\n", "\x0b", "\x0c", "\x85", "\xa0", "　", " ", "\x1c", "\x1f", ";\r", "{\r\n", "word", "Word's", "don't", "123", "ß", "漢字", "é", "é", "😀", "👩‍💻", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "\x00", "ﬁ", "İ", " ", "...", "();", "__", "    ", "﻿", "क्ष", "한국", "​"]
    return "".join(r.choice(parts) for _ in range(r.randint(0, 30)))


def test_texts_may_be_split_at_the_marks():
    tok = token_alignment._tokenizers(A, B)
    assert " " in tok.marks and "\n" in tok.marks
    assert token_alignment.split_marks([b"a b", b"c"], [b"x"]) == "\t\n\x0b\x0c"
    assert token_alignment.split_marks([b"a"], [b" \n", b"x\t"]) == " \x0b\x0c"
    r = random.Random(4)
    for _ in range(3000):
        t = odd_text(r)
        if not t or "▁" in t:
            continue
        segments = [s for s in tok.segments(" " + t) if s]
        assert "".join(segments) == " " + t
        first, second = tok.encode(segments)
        assert sum(first, []) == tok.a.encode(" " + t, add_special_tokens=False).ids, repr(t)
        assert sum(second, []) == tok.b.encode(t), repr(t)


@pytest.mark.parametrize("small", [False, True])
def test_align_documents(spark, monkeypatch, small):
    if small:  # many chunks, packs and parts
        for name, value in (("CHUNK_BYTES", 300), ("PACK_SEGMENTS", 50), ("COMPOSE_SEGMENTS", 40)):
            monkeypatch.setattr(token_alignment, name, value)
    r = random.Random(8)
    texts = [odd_text(r) for _ in range(150)] + [" ".join(r.choice(["alpha", "beta", "gamma.", "Delta", "of", "the"]) for _ in range(r.randint(1, 40))) for _ in range(60)]
    texts += [None, "", " ", "  ", "\n", "▁", "a ▁b", "x" * 5000, "ab " * 3000, texts[5], texts[5], "lone퟿"]
    rows = [(i if i % 7 else None, t, 1, 2, 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a long, chunk long, segment long").repartition(3)
    found, counts = token_alignment.align_documents(docs, A, B)
    want, df, most = brute(texts)
    assert sorted(([x["doc_id"], *[x[c] for c in COLUMNS]] for x in found.collect()), key=str) == sorted(([i, *w] for (i, *_), w in zip(rows, want, strict=True)), key=str)
    assert {(x["a"], x["b"]): (x["n_docs"], x["best"]) for x in counts.collect()} == {k: (n, n == most[k[0]]) for k, n in df.items()}


def test_empty_tables_and_texts(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert token_alignment.align_texts(docs, A, B).collect() == []
    only = spark.createDataFrame([("x", None), ("y", ""), (None, None)], "doc_id string, text string")
    assert sorted((tuple(x) for x in token_alignment.align_texts(only, A, B).collect()), key=str) == sorted([(i, 0, 0, 0, 0, 0, 0, "") for i in ("x", "y", None)], key=str)


def test_query_on_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = table(spark, sf, "documents").select("doc_id", "text").collect()
    want, _, _ = brute([x["text"] for x in rows])
    got = {x["doc_id"]: tuple(x[c] for c in COLUMNS) for x in op12_token_alignment(spark, sf).collect()}
    assert got == {x["doc_id"]: w for x, w in zip(rows, want, strict=True)}


def test_a_chunk_is_composed_in_slices(monkeypatch):
    """Texts and pairs of a chunk's segments come in slices: what is held beside the result doesn't grow with the chunk."""
    import tracemalloc

    import numpy as np

    rng, m = np.random.default_rng(1), 200_000
    groups = rng.integers(0, 4, m)
    in_a, in_b = (rng.integers(1, 4, groups.sum()) for _ in range(2))
    a, b = rng.integers(0, 300, in_a.sum()), rng.integers(0, 300, in_b.sum())
    chunk = token_alignment._Chunk([token_alignment._pack(np.arange(m), groups + 1, in_a, in_b, a, b)])
    tracemalloc.start()
    made = chunk.texts(), chunk.pairs()
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak - held < 60e6
    monkeypatch.setattr(token_alignment, "SLICE_SEGMENTS", m)
    assert made[0] == chunk.texts()
    assert all(np.array_equal(x, y) for x, y in zip(made[1], chunk.pairs(), strict=True))

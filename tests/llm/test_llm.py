"""Training-data operators against brute force, and on messy, repeated and empty input."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import common, decontamination, exact_dedup, html_extract, jaccard_join, language_id, line_dedup, mixing, sharding, token_files, toxicity
from tessera.llm.queries import MIX_LEVELS, MIX_WEIGHTS, op3_line_dedup, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[\x20\x09-\x0D]")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5))) for _ in range(400)]
    texts = []
    for _ in range(120):
        texts.append("\n".join(" ".join(r.choice(vocab) for _ in range(r.randint(1, 25))) + "." for _ in range(r.randint(1, 8))))
    for _ in range(60):  # near copies, copies and shared passages
        t = r.choice(texts[:40]).split(" ")
        for _ in range(r.choice([0, 0, 1, 2, 6])):
            t[r.randrange(len(t))] = r.choice(vocab)
        texts.append(" ".join(t))
    passage = " ".join(r.choice(vocab) for _ in range(60))
    texts += [texts[k] + "\n" + passage for k in range(12)] + ["", None, " \t\n", "Word", "one two", "one  two", "İ Σς", "a " * 3000]
    return [(i, t, r.choice(["en", "de", None]), r.choice(["s1", "s2", None]), 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    # columns whose names clash with inner ones
    return spark.createDataFrame(corpus, DOCS).withColumns({c: F.lit(1) for c in ("i", "t", "n", "k0", "c0", "shard", "score", "copies", "__id", "recipe", "label", "a.b")})


def test_exact_dedup(docs, corpus):
    groups = collections.defaultdict(list)
    for i, t, *_ in corpus:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i))
    want = {i: (min(m)[1], len(m), i == min(m)[1], hashlib.sha256(n.encode()).hexdigest()) for n, m in groups.items() for _, i in m}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.deduplicate(docs).collect()} == want
    assert exact_dedup.keep_first(docs).columns == docs.columns


def test_keep_first_has_one_row_of_each_group(spark):
    rows = [(1, "aa", "x"), (1, "bb", "x"), (2, "bb  ", "x"), (3, "c", "p"), (3, "c", "p"), (3, " c", "q"), (None, None, "n"), (None, "", "n"), (9, "\t", "t")]
    kept = exact_dedup.keep_first(spark.createDataFrame(rows, "doc_id long, text string, __id string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, "aa", "x"), (2, "bb  ", "x"), (3, " c", "q"), (9, "\t", "t")], key=str)


def test_hot_keys_are_joined_by_broadcast(monkeypatch, spark):
    rows = spark.range(1000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("k"), "id")
    keys = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    for share in (1, 10, 10**6):
        monkeypatch.setattr(common, "HOT_SHARE", share)
        got = {(r["id"], r["m"]) for r in common.join_hot(rows, keys, ["k"], 1000).collect()}
        assert got == {(i, 999 if i % 3 == 0 else i) for i in range(1000)}


def test_chunks_make_the_text(spark):
    t = "".join(random.Random(1).choice("ab.漢") for _ in range(30_000))
    row = spark.createDataFrame([(t,)], "t string").select(exact_dedup.chunks(F.col("t")).alias("c")).first()
    assert "".join(row["c"]) == t and max(map(len, row["c"])) <= exact_dedup.MAX_CHUNK


def components(sets, num):
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {d: find(d) for d in sets}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_jaccard_join(docs, corpus, n, percent):
    sets = {}
    for i, t, *_ in corpus:
        w = [x for x in SPACE.split(low(t)) if x]
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link(docs, n, percent).collect()}
    reached = components(sets, percent)
    assert got == {d: (len(s), reached[d]) for d, s in sets.items()}


@pytest.mark.parametrize(("n", "percent", "split"), [(4, 85, 256), (2, 70, 2), (1, 60, 3)])
def test_jaccard_pairs(monkeypatch, docs, corpus, n, percent, split):
    """Every link between classes, also where buckets are split by a second token."""
    monkeypatch.setattr(jaccard_join, "SPLIT", split)
    sets = {}
    for i, t, *_ in corpus:
        w = [x for x in SPACE.split(low(t)) if x]
        if w:
            sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    want = {(a, b) for x, a in first.items() for y, b in first.items() if a < b and x & y and 100 * len(x & y) >= percent * len(x | y)}
    links, members = jaccard_join.pairs(docs, n, percent)
    got = [(r["a"], r["b"]) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {(r["doc_id"], r["class_id"]) for r in members.collect()} == {(i, first[x]) for i, x in sets.items()}
    reached = components({i: set(x) for i, x in sets.items()}, percent)
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.link(docs, n, percent).collect() if r["doc_id"] in sets} == reached


def test_jaccard_many_frequent_tokens(spark):
    """Near copies in plenty: all tokens are frequent, prefixes are combined or taken singly."""
    r = random.Random(2)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 4])):
            w[r.randrange(60)] = f"x{r.randrange(30)}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 2]) for k in range(59)} for i, t in rows}
    got = {x["doc_id"]: x["component_id"] for x in jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string"), 2, 85).collect()}
    assert got == components(sets, 85)


def test_decontamination(spark, docs, corpus):
    items = [(1, corpus[3][1]), (2, "one two"), (10, corpus[50][1]), (3, None), (4, "..."), (5, corpus[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(len(w) - min(10, len(w)) + 1) if w else ():
            windows[tuple(w[k : k + min(10, len(w))])].add(str(i))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontamination.report(docs, bench).collect()}
    for i, t, *_ in corpus:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        assert got[i] == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    clean = decontamination.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {i for i, x in got.items() if not x[4]}


def test_blocks_add_up(monkeypatch, spark, docs, corpus):
    bench = spark.createDataFrame([(k, corpus[k][1]) for k in range(20)], "item_id long, text string")
    whole = sorted(map(str, decontamination.report(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 300)
    assert sorted(map(str, decontamination.report(docs, bench).collect())) == whole


def test_suffix_array_against_sorting():
    r = random.Random(11)
    for _ in range(300):
        ids = np.array([r.choice([0, 1, 1, 2, 3]) for _ in range(r.randint(0, 60))], np.int64)
        depth = r.choice([1, 3, 8, 60])
        array = decontamination.SuffixArray(ids, depth)
        suffix = lambda p: (*ids[p : p + next((k for k, x in enumerate(ids[p:]) if x == 0), len(ids) - p)].tolist(),)
        assert sorted(array.positions.tolist()) == [p for p in range(len(ids)) if ids[p]]
        cut = [suffix(p)[:depth] for p in array.positions.tolist()]
        assert cut == sorted(cut)


def test_longest_matches(spark, corpus):
    """Against every pair of starts."""
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    items = {"1": corpus[3][1], "2": "one two three", "3": " ".join(corpus[5][1].split()[2:9]) + " nowhere " + " ".join(corpus[7][1].split()[:5]), "4": "nowhere"}
    got = {x["item_id"]: x for x in decontamination.longest_matches(spark.createDataFrame(corpus, DOCS), spark.createDataFrame(list(items.items()), "item_id string, text string")).collect()}
    texts = {i: split(t) for i, t, *_ in corpus}
    for item, text in items.items():
        w, best = split(text), (0, 0)
        for a in range(len(w)):
            for d in texts.values():
                for b in range(len(d)):
                    n = next((k for k, (x, y) in enumerate(zip(w[a:], d[b:])) if x != y), min(len(w) - a, len(d) - b))
                    best = max(best, (n, -a))
        if not best[0]:
            assert item not in got
            continue
        x = got[item]
        assert (x["length"], -x["item_start"]) == best
        assert texts[x["doc_id"]][x["doc_start"] : x["doc_start"] + x["length"]] == w[x["item_start"] : x["item_start"] + x["length"]]


def test_line_dedup(docs, corpus):
    """A line goes exactly if it is in a run of enough words that starts earlier, too."""
    least = 8
    rows = [(i, [x.strip() for x in (t or "").split("\n")]) for i, t, *_ in corpus]
    lines = [(i, [(k, x) for k, x in enumerate(ls) if x]) for i, ls in rows]
    first, gone = {}, collections.defaultdict(set)
    for final in (False, True):
        for i, ls in lines:
            for a in range(len(ls)):
                for b in range(a + 1, len(ls) + 1):
                    run = tuple(x for _, x in ls[a:b])
                    if sum(len(x.split()) for x in run) >= least:
                        if not final:
                            first.setdefault(run, (i, a))
                        elif first[run] < (i, a):
                            gone[i] |= {k for k, _ in ls[a:b]}
    got = {r["doc_id"]: r for r in line_dedup.deduplicate(docs).collect()}
    for i, t, *_ in corpus:
        want = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) if t else t
        assert got[i]["text"] == want and got[i]["n_removed"] == len(gone[i])


def test_selected_positions_are_thinned(corpus):
    """Neighbouring windows mostly select the same position, and every window selects one of its own."""
    lines = [f"{k * k % 97} {k}" for k in range(400)]
    found = line_dedup.fingerprints("\n".join(lines), 16)
    assert sum(len(w) for _, w in found) >= 393 and len(found) < 200
    assert all(any(common_hash == h for common_hash in map(line_hash, lines[b:e])) for h, ws in found for _, b, e in ws)


def line_hash(line):
    return xxhash.xxh3_64_intdigest(line.strip()) - (1 << 63)


@pytest.mark.parametrize("share", [1, 10**6])
def test_hot_lines(monkeypatch, spark, share):
    monkeypatch.setattr(common, "HOT_SHARE", share)
    rows = [(k, f"hot line\nown {k}\nshort\nalso short {k % 3}") for k in range(60)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), min_words=2).collect()}
    # "short" alone has too few words, but "short, also short 0" was there before
    assert got == {k: t if k == 0 else f"own {k}\nshort\nalso short {k}" if k < 3 else f"own {k}" for k, t in rows}


def test_short_repeated_lines(spark, tmp_path):
    """The query deletes every later copy of a line, however short and whatever its neighbours."""
    rows = [(1, "one two three four five six\nAll rights reserved.\nseven"), (2, "eight nine ten\nAll rights reserved.\neleven\n\n  All rights reserved. "), (3, "seven\ntwelve"), (4, "All rights reserved."), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in op3_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("eight nine ten\neleven\n", 2), 3: ("twelve", 1), 4: ("", 1), 5: (None, 0)}


def test_token_files(spark, docs, corpus, tmp_path):
    from tokenizers import Tokenizer

    tok, at = Tokenizer.from_file(tokenizer_path()), 0
    got = {r["doc_id"]: r for r in token_files.tokenize(docs, tokenizer_path(), path=str(tmp_path / "t")).collect()}
    for i, t, *_ in corpus:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_no_row_is_lost_in_large_batches(spark):
    """Operators cut Arrow batches into parts: every row must come through."""
    many = spark.range(0, 5000, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words of text"), F.col("id").cast("string"), F.lit("and the end of it")).alias("text"))
    for out in (token_files.tokenize(many, tokenizer_path()), jaccard_join.link(many), line_dedup.deduplicate(many), exact_dedup.deduplicate(many), sharding.shard(many)):
        assert out.select("doc_id").distinct().count() == out.count() == 5000


MARKS = "\u030c\u0331\u0308\u030a\u0301\u0323\u0307\u0327\u0345\u0342\u0313\u3099"
ALPHABETS = {
    "mixed": "aB.,'’ \n\tΣσςÉé\u0301İı漢0²½🙂<|>\x1c\x85ẞﬁ",
    "plain": "abC., \n",
    "joined": "aé._-#,. 12",
    "latin": "aJHTWYjhtwyİẞ .'" + MARKS,
    "greek": "αΙιΩωΣσΥ Ά,ͅ" + MARKS,
    "cyrillic": "иИеЕкКгЫ .Й" + MARKS,
    "others": "가각각かカ\u212b\u2126\u0928\u093c\u09c7\u09be “—€…" + MARKS,
}


@pytest.mark.parametrize("name", ALPHABETS)
def test_pieces_are_exact(name):
    enc, r = token_files.encoder(tokenizer_path()), random.Random(4)
    texts = ["".join(r.choice(ALPHABETS[name]) for _ in range(r.randint(0, 40))) for _ in range(15_000)] + ["<|endoftext|> <|ENDOFTEXT|>", "don't we'll, x's."]
    want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist()[:-1] for x in enc.encode(texts, 1)] == want


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    enc = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Some  Text\n\nand More", " a b", "", None]
    assert not enc.known_settings and token_files.encoder(tokenizer_path()).known_settings
    assert [x.tolist() for x in enc.encode(texts, 7)] == [[*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]


def test_wavelet_matrix():
    tokens = np.random.default_rng(1).integers(0, 300, 600_000).astype("<u4")
    shard = token_files.Shard(token_files.write_shard(pa.array([7, None]), [599_000, 1000], tokens, 16))
    assert shard.documents.to_pydict() == {"doc_id": [7, None], "n_tokens": [599_000, 1000]}
    w = shard.matrix
    assert [w.access(i) for i in (0, 511, 512, 4999)] == tokens[[0, 511, 512, 4999]].tolist()
    assert max(len(p.open) for p in w.planes) < len(w.planes[0].pieces)  # a few pieces were unpacked, not all
    assert (w.decode() == tokens).all() and w.access(599_999) == tokens[-1]
    for t in (0, 17, 299, 70_000):
        places = np.flatnonzero(tokens == t).tolist()
        assert w.rank(t) == len(places) and w.rank(t, 1000) == sum(p < 1000 for p in places) and w.occurrences(t) == places
    with pytest.raises(ValueError):
        token_files.write_shard(pa.array([1]), [1], np.array([70_000], "<u4"), 16)


def test_lookups_in_written_files(monkeypatch, spark, tmp_path):
    """Access, count and locate against the plain ids; ids are strings here, some null."""
    monkeypatch.setattr(token_files, "SHARD_TOKENS", 50)
    r, tok = random.Random(3), token_files.encoder(tokenizer_path()).tokenizer
    rows = [(f"d{k:03d}" if k else None, " ".join(r.choice(["tree", "house", "river", "of"]) for _ in range(r.randint(0, 30)))) for k in range(60)]
    path = str(tmp_path / "t")
    token_files.write(spark.createDataFrame(rows, "doc_id string, text string"), path, tokenizer_path())
    ids = [[*tok.encode(t, add_special_tokens=False).ids, 1] for _, t in rows]  # null first, then in order
    flat = [x for one in ids for x in one]
    assert {x["position"]: x["token"] for x in token_files.access(spark, path, range(0, len(flat), 7)).collect()} == {k: flat[k] for k in range(0, len(flat), 7)}
    tree = ids[1][0]
    assert {x["token"]: x["n"] for x in token_files.count(spark, path, [tree, 1, 99]).collect()} == {t: flat.count(t) for t in (tree, 1, 99)}
    want = sorted((d or "", k) for (d, _), one in zip(rows, ids) for k, x in enumerate(one) if x == tree)
    assert sorted((x["doc_id"] or "", x["at"]) for x in token_files.locate(spark, path, tree).collect()) == want
    assert {x["doc_id"]: x["n_tokens"] for x in token_files.read(spark, path).collect()} == {d: len(one) for (d, _), one in zip(rows, ids)}


@pytest.mark.parametrize("law", ["bytes", "rows", "key"])
def test_sharding(spark, docs, corpus, law):
    big = docs.unionByName(docs)  # repeated rows
    rows = sharding.shard(big, 5, law).collect()
    assert len(rows) == 2 * len(corpus)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
        assert r["size"] == len((corpus[r["doc_id"]][1] or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((corpus[r["doc_id"]][1] or "").encode())
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    if law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    if law == "bytes":
        total = [sum(r["size"] for r in x) for x in by.values()]
        assert max(total) - min(total) <= 2 * 7000
    if law == "key":
        grown = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, 6, "key").collect()}
        assert all(r["grown_shard"] == grown[r["doc_id"]] and r["grown_shard"] in (r["shard"], 5) for r in rows)


def test_overfull_ranges(monkeypatch, spark):
    """Ranges are subdivided until none is overfull, also where all rows are one document."""
    monkeypatch.setattr(sharding, "RANGE_ROWS", 20)
    seen = []
    whole = sharding._divided
    monkeypatch.setattr(sharding, "_divided", lambda *a: seen.append(whole(*a)) or seen[-1])
    for ids in (F.col("id"), F.lit(7)):
        rows = sharding.shard(spark.range(600).select(ids.alias("doc_id"), F.lit("same text").alias("text")), 6).collect()
        counts = collections.Counter(r["shard"] for r in rows)
        assert len(counts) == 6 and max(counts.values()) - min(counts.values()) <= 2
        assert max(r["n"] for r in seen[-1][1].collect()) <= sharding.OVERFULL * 20


def test_places_against_bisection():
    import bisect

    r = random.Random(2)
    pick = lambda: tuple(r.randrange(4) for _ in range(3))
    for _ in range(200):
        keys = sorted({pick() for _ in range(r.randrange(1, 20))})
        values = [pick() for _ in range(30)]
        got = sharding._place([np.array(x) for x in zip(*keys)], [np.array(x) for x in zip(*values)])
        assert got.tolist() == [bisect.bisect_right(keys, v) for v in values]


@pytest.mark.parametrize("law", ["bytes", "rows", "key"])
def test_sharding_by_names(spark, law):
    """Ids that are strings; some null, some repeated."""
    rows = [(f"d{k % 40}" if k % 5 else None, f"text {k % 30}") for k in range(100)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id string, text string"), 4, law).collect()
    by = collections.Counter(r["shard"] for r in got)
    assert collections.Counter((r["doc_id"], r["text_crc32"]) for r in got) == collections.Counter((d, zlib.crc32(t.encode())) for d, t in rows)
    assert all(sorted(r["slot"] for r in got if r["shard"] == k) == list(range(n)) for k, n in by.items())


def test_budgets(spark):
    r = random.Random(3)
    for _ in range(4):
        leaves = {(a, b, c): r.randint(0, 500) for a in "xy" for b in "pq" for c in "123" if r.random() < 0.8}
        weights = {("x",): 3, ("y",): 1, ("x", "p"): 0, ("y", "q"): 5, ("y", "q", "1"): 7}
        for budget in (0, 300, 1500, 10**6):
            totals = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "a string, b string, c string, tokens long")
            got = {(x["a"], x["b"], x["c"]): x["share"] for x in mixing.budgets(totals, ["a", "b", "c"], weights, budget, 2).collect()}
            assert {k: got[k] for k in leaves} == mixing.plan(leaves, weights, budget, 2) | {k: 0 for k in leaves if k not in mixing.plan(leaves, weights, budget, 2)}


def test_mix_prefixes(monkeypatch, spark, docs, corpus):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    taken = mixing.select(docs, MIX_LEVELS, MIX_WEIGHTS, budget_share=0.6).collect()
    words = {i: len([x for x in SPACE.split(t or "") if x]) for i, t, *_ in corpus}
    assert sum(r["n_tokens"] * r["copies"] for r in taken) <= 0.6 * sum(words.values())
    assert all(r["n_tokens"] == words[r["doc_id"]] for r in taken)
    leaves = collections.Counter()
    for i, _, lang, source, _ in corpus:
        leaves[("even" if source and source[-1] in "02468" else "odd", lang or "?", source or "?")] += words[i]
    shares = mixing.plan(dict(leaves), MIX_WEIGHTS, int(0.6 * sum(words.values())), 2)
    got = collections.Counter()
    for r in taken:
        got[(r["domain"], r["lang"], r["source"])] += r["n_tokens"] * r["copies"]
    rest = {k: [words[i] for i, _, lang, s, _ in corpus if (lang or "?", s or "?") == k[1:]] for k in leaves}
    assert all(shares.get(k, 0) - max(rest[k], default=0) <= got[k] <= shares.get(k, 0) for k in leaves)
    mixed = mixing.mix(docs, MIX_LEVELS, MIX_WEIGHTS, budget_share=0.6)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in taken)


def test_repeated_rows_share_their_copies(spark):
    """Equal rows get no more than the budget; which of them come doesn't matter."""
    level = {"source": "source"}
    many = spark.createDataFrame([(1, "w " * 5, "s")] * 20, "doc_id long, text string, source string").repartition(3)
    for share, copies in ((0.5, 10), (0.75, 15), (1.0, 20)):
        assert mixing.mix(many, level, {}, budget_share=share, max_epochs=1).count() == copies
    assert mixing.mix(many, level, {}, budget=175, max_epochs=2).count() == 35


def test_taken_rows_against_brute_force(monkeypatch, spark, corpus):
    """The rows chosen, one by one: whole epochs, then the longest prefix in the seeded order."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    rows = [(i, t, lang, source) for i, t, lang, source, _ in corpus] + [(i, t, lang, source) for i, t, lang, source, _ in corpus[:5]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    seeded = F.pmod(F.xxhash64(F.lit(17), F.col("e"), F.col("doc_id"), F.xxhash64("text")), F.lit(1 << 40))
    orders = {(r["doc_id"], r["e"]): r["o"] for r in df.withColumn("e", F.explode(F.array([F.lit(k).cast("long") for k in range(3)]))).withColumn("o", seeded).collect()}
    words = [len([x for x in SPACE.split(t or "") if x]) for _, t, _, _ in rows]
    leaves = collections.defaultdict(list)
    for (i, _, lang, source), n in zip(rows, words):
        leaves[("even" if source and source[-1] in "02468" else "odd", lang or "?", source or "?")].append((i, n))
    shares = mixing.plan({k: sum(n for _, n in v) for k, v in leaves.items()}, MIX_WEIGHTS, int(0.6 * sum(words)), 2)
    want = collections.Counter()
    for leaf, members in leaves.items():
        total = sum(n for _, n in members)
        epochs, rest = divmod(shares.get(leaf, 0), total) if total else (0, 0)
        for i, _ in members:
            want[i] += epochs
        used = 0
        for i, n in sorted(members, key=lambda x: orders[x[0], epochs]):
            used += n
            if rest and used <= rest:
                want[i] += 1
    got = collections.Counter()
    for r in mixing.select(df, MIX_LEVELS, MIX_WEIGHTS, budget_share=0.6).collect():
        got[r["doc_id"]] += r["copies"]
    assert {i: n for i, n in got.items() if words[i]} == {i: n for i, n in want.items() if n and words[i]}
    assert collections.Counter(r["doc_id"] for r in mixing.mix(df, MIX_LEVELS, MIX_WEIGHTS, budget_share=0.6).collect()) == got


def test_language_id(spark):
    r = random.Random(6)
    make = lambda letters: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(40))
    rows = [(i, make("abcde") if i % 2 else make("cdefg"), "xx" if i % 2 else "yy") for i in range(200)] + [(900, None, "xx"), (901, "12 .", "yy"), (902, "", None)]
    got = {x["doc_id"]: x for x in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    held = [(got[i]["lang_pred"], lang) for i, _, lang in rows[:200] if got[i]["held_out"]]
    assert held and sum(a == b for a, b in held) / len(held) > 0.95
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)


def test_pieces_of_long_texts(monkeypatch):
    model = language_id.LanguageModel(["a", "b"], np.random.default_rng(0).integers(-9, 9, (1 << 16, 2)).astype(np.int32), np.array([3, 5]))
    texts = ["abc d ef " * 500, None, "x", "12", "Éa ß!" * 40, ""]
    whole = language_id._score(texts, model)
    assert [language_id._score([t], model)[0] for t in texts] == whole and [x[0] == "und" for x in whole] == [False, True, False, True, False, True]
    monkeypatch.setattr(language_id, "PIECE", 97)
    monkeypatch.setattr(language_id, "CELLS", 64)
    assert language_id._score(texts, model) == whole


def test_scores_against_brute_force(spark):
    """Naive Bayes by its definition: hashed n-grams counted one by one, priors from the rows."""
    r = random.Random(12)
    rows = [(i, "".join(r.choice("aab cé" if i % 3 else "bcd  x") for _ in range(r.randint(1, 60))), "p" if i % 3 else "q") for i in range(60)]
    rows += [(None, "zzz", "q"), (61, "zzz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("i", "t", "l", "k0", "score", "n")})
    learned = [(t, k) for i, t, k in rows if i is not None and k and zlib.crc32(str(i).encode()) % 4 != 2]

    def grams(text):
        plain = " " + re.sub(r"[^a-zé]+", " ", text).lstrip() + " "
        codes = np.array([ord(c) for c in plain], np.uint32)
        return language_id._features(codes, np.full(len(codes), len(codes)), 16)[0].tolist()

    counts = {k: collections.Counter() for k in "pq"}
    for t, k in learned:
        counts[k].update(grams(t))
    total = {k: sum(c.values()) + 0.5 * 65536 for k, c in counts.items()}
    prior = collections.Counter(k for _, k in learned)
    for x in language_id.identify(docs).collect():
        text = next(t for i, t, _ in rows if i == x["doc_id"])
        g = grams(text)
        if not re.search("[a-zé]", text):
            assert x["lang_pred"] == "und"
            continue
        s = {k: np.log(prior[k] / len(learned)) + sum(np.log((counts[k][b] + 0.5) / total[k]) for b in g) for k in "pq"}
        if abs(s["p"] - s["q"]) > 0.01 * len(g):
            odds = 1 / (1 + np.exp(-abs(s["p"] - s["q"]) / max(1, len(g) / 50)))
            assert x["lang_pred"] == max(s, key=s.get) and abs(x["score"] - odds) < 0.02


def test_many_languages_have_fewer_buckets(monkeypatch, spark):
    monkeypatch.setattr(language_id, "CELLS", 1 << 12)
    rows = [(i, "abcdefghij"[i % 10] * 3 + " word", f"l{i % 10}") for i in range(200)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.weights.shape == (256, 10) and model.bits == 8


def test_toxicity(spark):
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        w, bad = [r.choice(vocab) for _ in range(80)], i % 5 == 0
        if bad:
            for _ in range(4):
                w[r.randrange(80)] = "nastyx" + r.choice(["", "en", "ing", "ly"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (902, "!!"), (903, "word " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x for x in toxicity.detect(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 for x in got.values())
    assert all(got[i]["predicted"] == y for i, y in labels) and all(got[i]["predicted"] == 0 for i in (900, 901, 902, 903))


def test_repeated_passages_are_found(spark):
    """A passage whose words all came before is a passage, too; the document's score doesn't grow with it."""
    model = toxicity.ToxicityModel(0.1, {"bad": 4.0, "worse": 4.0, "worst": 4.0}, curve=(-5.0, 0.5, 0.5))
    plain = " ".join(["word"] * 300)
    rows = [(1, f"{plain} bad worse worst {plain}"), (2, f"{plain} bad worse worst {plain} worst bad worse {plain}")]
    got = {x["doc_id"]: x for x in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [(x["start"], x["end"]) for x in got[1]["passages"]] == [(300, 303)]
    assert [(x["start"], x["end"]) for x in got[2]["passages"]] == [(300, 303), (603, 606)]
    assert got[2]["score"] <= got[1]["score"]


def all_maximal(x):
    """The maximal segments by their definition: the highest one, then those of what is left and right of it."""
    sums = [(x[s:e].sum(), s - e, s, e) for s in range(len(x)) for e in range(s + 1, len(x) + 1)]
    best = max(sums, key=lambda v: (v[0], v[1], -v[2]), default=(0,))
    if best[0] <= 0:
        return []
    s, e = best[2:]
    return all_maximal(x[:s]) + [(len(x[:s]), float(best[0]), e - s)] + [(e + a, v, n) for a, v, n in all_maximal(x[e:])]


def test_segments_are_maximal():
    r = random.Random(9)
    for _ in range(400):
        x = np.array([r.choice([-2.1, -1.3, 1.01, 3.7]) + r.random() / 100 for _ in range(r.randint(1, 16))])
        assert [(s, round(v, 6), e - s) for s, e, v in toxicity.segments(x)] == [(s, round(v, 6), n) for s, v, n in all_maximal(x)]


@pytest.mark.parametrize("pattern", [[1.0, -2.0], [1.0, -0.5], [2.0, -1.0, -1.5, 1.0]])
def test_segments_take_linear_time(pattern):
    begin = time.time()
    toxicity.segments(np.array(pattern * 200_000))
    assert time.time() - begin < 5


def test_extreme_value_law():
    """Chance segments of a random sequence are as many as the law expects."""
    g = np.random.default_rng(3)
    draw = lambda n: np.where(g.random(n) < 0.01, g.choice([2.0, 3.5, 5.0], n), -toxicity.COST)
    x = draw(400_000)
    found = toxicity.segments(x)
    scale, constant = toxicity._law(x[x > 0], int((x <= 0).sum()), len(found), 5.0)
    model = toxicity.ToxicityModel(0.1, {}, scale, constant)
    assert abs(np.exp(scale * x).mean() - 1) < 0.01
    high = [s for _, _, s in toxicity.segments(draw(400_000)) if toxicity._significance(s, 400_000, model) > -4]  # some e^4 expected
    assert 20 < len(high) < 150


def test_clashing_columns_and_null_ids_do_not_change_scores(spark):
    rows = [(i, f"plain words {i} " + ("nasty nastier nastiest " if i % 4 == 0 else "kind ")) for i in range(80)]
    labels = [(i, int(i % 4 == 0)) for i in range(80)]
    rows += [(None, "nasty nastier nastiest"), (3, rows[3][1]), (None, None)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    clash = {c: F.lit(1) for c in ("i", "t", "y", "f", "h", "score", "toxic", "w", "a0", "passages")}
    key = lambda x: str((x["doc_id"], x["score"], x["held_out"], x["n_passages"]))
    one, two = (sorted(map(key, toxicity.detect(d, m).collect())) for d, m in ((docs, marks), (docs.withColumns(clash), marks.withColumns({"text": F.lit("x"), "i": F.lit(2), "y": F.lit(0)}))))
    assert one == two and len(one) == len(rows)


def test_held_out_toxic_documents(spark):
    """Recall and precision on the rows that nothing was learned from."""
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    got = toxicity.detect(read("documents"), read("labels")).filter("held_out").join(read("labels").select("doc_id", "toxic"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    assert n.get((0, 1), 0) <= 0.02 * n[0, 0] and n[1, 1] >= 0.7 * (n[1, 1] + n.get((1, 0), 0))


def test_html(spark):
    page = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav>menu</nav><header>top</header><div class='ad'>buy</div><article><h1>Head &amp; more</h1><p>One\n two<br>three<p>Four <b>bold</b></p><div class='comments'><p>no</p></div><form>f</form></article><footer>foot</footer>"
    plain = "<body><div>Site name</div><div>Story {0} is here</div><p>And {0} more</p><div>Terms</div></body>"
    rows = [(1, "http://h/a/1", page), (2, "http://k/b/1", plain.format("x")), (3, "http://k/b/2", plain.format("y")), (4, "http://k/b/3", plain.format("y")), (5, None, None), (6, "http://h/e", ""), (7, "http://m/1", plain.format("z"))]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "Head & more\nOne two three\nFour bold"
    assert got[2]["text"] == "Story x is here\nAnd x more" and got[3]["text"] == got[4]["text"] == "Story y is here\nAnd y more"
    assert got[5]["text"] == got[6]["text"] == "" and got[6]["n_chars"] == 0
    assert got[7]["text"] == "Site name\nStory z is here\nAnd z more\nTerms"
    styled = "<div class='has-sidebar'><article class='post header-large'><p>kept</p></article><article class='comment'><p>no</p></article></div><div class='sidebar'>no</div>"
    assert html_extract.parse(styled) == (["kept", "no", "no"], [html_extract.MAIN, html_extract.MARKED, html_extract.MARKED])


def test_names_inside_an_article():
    """What an element in an article is called rarely says that it isn't main text; comments, adverts and forms do go."""
    kept = "<section id='share-prices'><p>one</p></section><h2 id='search'>two</h2><p class='notice'>three</p><p>x <span class='tags'>four</span></p><figure><figcaption>five</figcaption></figure><math>six</math><p><label>seven</label></p>"
    gone = "<div class='ad box'>no</div><section id='comments'><p>no</p></section><form>no</form><nav>no</nav><aside>no</aside><script>no</script><footer>no</footer><div role='dialog'>no</div><p>8 <button>no</button></p>"
    lines, kinds = html_extract.parse(f"<article>{kept}{gone}</article>")
    assert [x for x, k in zip(lines, kinds) if k != html_extract.MARKED] == ["one", "two", "three", "x four", "five", "six", "seven", "8"]


@pytest.mark.parametrize("cells", [1 << 26, 20])
def test_alignment_against_brute_force(monkeypatch, cells):
    monkeypatch.setattr(html_extract, "CELLS", cells)
    r = random.Random(1)
    for _ in range(1500):
        a, b = ([r.randrange(4) for _ in range(r.randrange(14))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found, rest = html_extract.common(a, b), iter(b)
        assert len(found) == best[-1][-1] and found == sorted(set(found)) and all(any(a[i] == y for y in rest) for i in found)


def test_very_long_pages_align():
    begin = time.time()
    assert len(html_extract.common([1] * 20_000 + [2], [3] + [1] * 20_000)) == 20_000
    assert time.time() - begin < 10


@pytest.mark.parametrize("limit", [100_000, 0])
def test_pages_against_brute_force(monkeypatch, spark, limit):
    """Every page against its neighbours in the order of host and path, over many partitions, broadcast and shuffled; other columns clash."""
    monkeypatch.setattr(html_extract, "MAX_BROADCAST_PAGES", limit)
    r = random.Random(7)
    words = [f"line {k}" for k in range(12)]
    rows = []
    for i in range(150):
        body = [r.choice(words) for _ in range(r.randint(0, 8))]
        rows.append((i, f"http://{r.choice('ab')}/{r.choice('xyz')}/{i % 40}", "".join(f"<p>{x}</p>" for x in body), body))
    rows += [(900 + k, *rows[k][1:]) for k in range(20)]
    pages = {}
    for _, url, _, body in rows:
        host, path = url[7:].split("/", 1)
        key = (host, tuple(body))
        pages[key] = min(pages.get(key, "/" + path), "/" + path)
    order = sorted((h, p, html_extract_digest(b), b) for (h, b), p in pages.items() if b)
    want = {}
    for k, (h, p, _, body) in enumerate(order):
        near = [order[j] for j in (k - 1, k + 1) if 0 <= j < len(order) and order[j][0] == h]
        nearest = max(near, key=lambda x: html_extract.shared_path(x[1], p), default=None)
        gone = html_extract.common(body, nearest[3]) if nearest else []
        want[h, body] = "\n".join(x for i, x in enumerate(body) if i not in gone)
    df = spark.createDataFrame([x[:3] for x in rows], "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "path", "digest", "cut", "k1", "k2", "salt", "text", "part")}).repartition(7)
    got = {x["page_id"]: x["text"] for x in html_extract.extract(df).collect()}
    assert got == {i: want.get((url[7:8], tuple(body)), "") for i, url, _, body in rows}


def html_extract_digest(lines):
    """The order of pages with one path is that of their digests."""
    hashes = np.array([xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in lines], np.int64)
    return xxhash.xxh3_64_intdigest(hashes.tobytes() + bytes([html_extract.OPEN] * len(lines))) - (1 << 63)


def test_html_lines_beside_an_article(spark):
    """An article element doesn't settle the lines outside it: differencing decides on them."""
    beside = "<body><div>Site name</div><main><p>Main text {0} one</p><p>Main text {0} two</p></main><article><h2>Teaser</h2></article><div>Terms</div></body>"
    inside = "<body><div>Site name</div><article><p>Shared passage</p><p>Own {0}</p></article><div>Terms</div></body>"
    rows = [(1, "http://h/a/1", beside.format("x")), (2, "http://h/a/2", beside.format("y")), (3, "http://k/a/1", inside.format("x")), (4, "http://k/a/2", inside.format("y")), (5, "http://m/1", beside.format("z"))]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Main text x one\nMain text x two\nTeaser" and got[2] == "Main text y one\nMain text y two\nTeaser"
    assert got[3] == "Shared passage\nOwn x" and got[4] == "Shared passage\nOwn y"
    assert got[5] == "Site name\nMain text z one\nMain text z two\nTeaser\nTerms"


EMPTY = {
    "exact_dedup": lambda d, s: exact_dedup.deduplicate(d), "jaccard": lambda d, s: jaccard_join.link(d), "lines": lambda d, s: line_dedup.deduplicate(d), "shard": lambda d, s: sharding.shard(d, 3), "mix": lambda d, s: mixing.mix(d, MIX_LEVELS, MIX_WEIGHTS), "lang": lambda d, s: language_id.identify(d), "tokens": lambda d, s: token_files.tokenize(d, tokenizer_path()),
    "decontaminate": lambda d, s: decontamination.report(d, s.createDataFrame([], "item_id long, text string")), "toxic": lambda d, s: toxicity.detect(d, s.createDataFrame([], "doc_id long, toxic int")), "keep_one": lambda d, s: jaccard_join.keep_one(d), "keep_lang": lambda d, s: language_id.keep_identified(d, language_id.fit(d)),
}


@pytest.mark.parametrize("name", EMPTY)
def test_empty_and_null_rows(spark, name):
    assert EMPTY[name](spark.createDataFrame([], DOCS), spark).count() == 0
    rows = [(None, None, None, None, None), (None, "some text here", None, None, None), (1, None, None, None, None), (1, "some text here", "en", "s1", 3), (1, "some text here", "en", "s1", 3)]
    out = EMPTY[name](spark.createDataFrame(rows, DOCS), spark).collect()
    assert len(out) <= len(rows) * 2 and (name in ("mix", "keep_one", "keep_lang") or len(out) == len(rows))


def test_empty_pages(spark):
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_names_outside_articles_delete_nothing_alone():
    """A name that contains a word for page furniture makes its lines suspect; only elements, roles and whole names mark them."""
    page = '<h1 class="page-header">a</h1><section class="search-algorithms">b</section><div class="related-work">c</div><p id="social-history">d</p><main class="menu-of-the-day">e</main>'
    lines, kinds = html_extract.parse(page)
    assert lines == list("abcde") and html_extract.MARKED not in kinds and kinds.count(html_extract.SUSPECT) == 4
    marked = '<div class="sidebar">a</div><ul id="menu">b</ul><div role="navigation">c</div><aside>d</aside><div hidden>e</div><footer>f</footer>'
    assert set(html_extract.parse(marked)[1]) == {html_extract.MARKED}


def test_unmatched_closing_tags_take_linear_time():
    begin = time.time()
    html_extract.parse("<div>" * 30_000 + "</span>" * 30_000 + "<li>" * 3)
    assert time.time() - begin < 3


def test_differencing_decides_on_pages_without_articles(spark):
    """Precision and recall of main text where only the pages' neighbours tell what is template."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows, want = [], {}
    for h in range(12):
        top, links, end = [f"Site {word()}", f"{word()} {word()}"], [word() for _ in range(6)], [f"Terms of {word()}", "All rights reserved"]
        for i in range(8):
            own = [" ".join(word() for _ in range(r.randint(6, 20))) for _ in range(r.randint(2, 9))]
            promo = f"Read {word()} too" if i % 3 else links[0] + " offer"  # some pages have one of their own
            body = "".join(f"<div>{x}</div>" for x in top) + "<div class='page-nav'>" + "".join(f"<p>{x}</p>" for x in links) + "</div><main>" + "".join(f"<p>{x}</p>" for x in own) + f"</main><div class='site-promo'>{promo}</div>" + "".join(f"<div>{x}</div>" for x in end)
            rows.append((h * 8 + i, f"http://h{h}.example.com/{'ab'[i % 2]}/{i:02d}", f"<html><body>{body}</body></html>"))
            want[h * 8 + i] = own
    got = {x["page_id"]: x["text"].split("\n") for x in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    kept, right, all_main = sum(map(len, got.values())), sum(x in want[i] for i, lines in got.items() for x in lines), sum(map(len, want.values()))
    assert right == all_main  # recall 1: nothing of the main text goes
    assert right / kept > 0.8 and kept - right <= len(rows)  # what stays beside it are promotions that no neighbour shares

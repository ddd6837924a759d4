"""The registered queries' SQL on DuckDB, and the pipeline stage by stage against brute force."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tessera.llm.queries import MIX_SHARE, ORACLE_SQL, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, result = QUERIES[name](spark, SF), duck.execute(ORACLE_SQL[name])
    columns = [x[0] for x in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(str, result.fetchall()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_has_a_row_for_each_input_row(spark, name):
    table = "pages" if "html" in name or "url" in name else "documents"
    rows = QUERIES[name](spark, SF).count()
    whole = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert rows == whole or name == "op2_mixing" and 0 < rows <= whole


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Two languages, copies and near copies, a benchmark passage, texts without a letter, nulls."""
    r = random.Random(21)
    words = {"xx": ["abac", "cade", "beda", "dace", "ecab"], "yy": ["fogu", "guhi", "hofi", "gufo", "ihug"]}
    vocab = {k: ["".join(r.choice(w) for _ in range(2)) + str(n % 7) for n in range(300)] for k, w in words.items()}
    make = lambda lang, n: " ".join(r.choice(vocab[lang]) for _ in range(n))
    rows = []
    for i in range(90):
        lang = "xx" if i % 3 else "yy"
        rows.append([i, make(lang, r.randint(20, 80)), lang, f"src{i % 5}"])
    for i in range(90, 110):  # copies and near copies
        rows.append([i, rows[i - 90][1] + ("" if i % 2 else " tail"), rows[i - 90][2], "src1"])
    items = [(k, make("xx", 15)) for k in range(4)]
    for i in range(110, 116):
        rows.append([i, make("xx", 10) + " " + items[i % 4][1] + " " + make("xx", 10), "xx", "src2"])
    rows += [[116, "12 34 !", "xx", "src0"], [117, None, "xx", "src0"], [118, "", None, None], [5, rows[5][1], rows[5][2], "src0"]]
    path = tmp_path_factory.mktemp("sf")
    docs = [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, items


def test_stages(spark, corpus, tmp_path):
    """Each stage is held against brute force on its own input."""
    from tokenizers import Tokenizer

    path, docs, items = corpus
    kept, given = spark.read.parquet(f"{path}/documents.parquet"), docs
    columns = kept.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept, path).write.parquet(f"{tmp_path}/{number}")
        kept = spark.read.parquet(f"{tmp_path}/{number}")
        got = [tuple(r) for r in kept.collect()]
        if name != "token files":
            assert kept.columns == columns
        if name == "language ID":
            assert Counter(got) == Counter(d for d in given if d[0] not in (116, 117, 118))
        elif name == "near duplicates":
            first = Counter(r[0] for r in got)
            assert Counter(got) == Counter(d for d in given if first[d[0]]) and first == near_copies_gone(given)
        elif name == "decontamination":
            assert Counter(got) == Counter(d for d in given if not contaminated(d[1], items)) and len(got) < len(given)
        elif name == "mixing":
            n = Counter(got)
            words = {d: len([x for x in SPACE.split(d[1]) if x]) for d in given}
            assert set(n) <= set(given) and max(n.values()) <= 2 * max(Counter(given).values())
            budget = int(MIX_SHARE * sum(words.values()))
            assert budget - 3 * max(words.values()) * 12 <= sum(words[d] * k for d, k in n.items()) <= budget
        else:
            tokenizer = Tokenizer.from_file(tokenizer_path())
            start, want = 0, []
            for d in sorted(given, key=lambda d: d[0]):
                ids = np.array([*tokenizer.encode(d[1], add_special_tokens=False).ids, 1], "<u4")
                want.append((d[0], start, len(ids), zlib.crc32(ids.tobytes())))
                start += len(ids)
            assert sorted(got) == sorted(want)
        given = got


def near_copies_gone(docs):
    """Numbers of rows that stay by doc_id: one document of each group linked by 80 % of five-word shingles."""
    sets = {}
    for i, t, *_ in docs:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[b] < label[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a], changed = label[b], True
    return Counter(i for i, *_ in docs if label[i] == i)


def contaminated(text, items):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())
    windows = {tuple(w[k : k + 10]) for _, t in items for w in [split(t)] for k in range(len(w) - 9)}
    w = split(text)
    return any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9))


def test_run_is_the_stages(spark, corpus):
    """run() gives what the stages give one after another; the mixed rows come from a seed."""
    path, docs, _ = corpus
    one, two = (sorted(tuple(r) for r in corpus_pipeline.run(spark, path).collect()) for _ in range(2))
    assert one == two and one and {r[0] for r in one} <= {d[0] for d in docs}
    assert [s for _, s, *_ in sorted(one, key=lambda r: r[1])][0] == 0
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5

"""Graph semantics, order-dependent text functions, sources, sinks and incremental ingestion on small fixtures."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from tessera.functions import extract, retrieval, text
from tessera.functions import vectors as near
from tessera.operators import graph
from tessera.sources import files, sinks
from tessera.sources.graph_tables import Graph
from tessera.streaming import ingest_available


def mini(spark):
    nodes = spark.createDataFrame([("a", "ORG", "Acme", 12), ("b", "ORG", "Beta", 3), ("c", "RISK", "fire", 7), ("d", "PERSON", "Acme", None), ("z", "ORG", "Alone", 1)], "node_id string, label string, name string, mentions long")
    edges = spark.createDataFrame([("1", "a", "b", "CO_MENTIONED", 2), ("2", "a", "a", "CO_MENTIONED", 1), ("3", "a", "c", "EXPOSES_TO_RISK", 3), ("4", "b", "c", "MITIGATES_RISK", 1)], "edge_id string, src string, dst string, type string, cnt long")
    return Graph(nodes, edges)


def test_loops_count_once(spark):
    u = graph.undirected(mini(spark).edges)
    assert u.count() == 7
    assert u.filter("a = 'a'").select(F.countDistinct("edge_id")).first()[0] == 3


def test_isolated_and_ego(spark):
    g = mini(spark)
    assert {r["node_id"] for r in graph.isolated(g).collect()} == {"d", "z"}
    assert {(r["direction"], r["other_name"]) for r in graph.ego(g, "Beta").collect()} == {("in", "Acme"), ("out", "fire")}


def test_path_pattern_counts(spark):
    """Against listed paths, with loops, parallel edges and every type."""
    r = random.Random(4)
    ids, label = "abcdefg", dict(zip("abcdefg", "XXYYZZZ"))
    edges = [(str(k), r.choice(ids), r.choice(ids), r.choice(["s", "t", "u"]), 1) for k in range(16)] + [("l1", "a", "a", "s", 1), ("l2", "a", "a", "t", 1), ("p1", "a", "b", "s", 1), ("p2", "b", "a", "s", 1)]
    g = Graph(spark.createDataFrame([(i, label[i], i, 1) for i in ids], "node_id string, label string, name string, mentions long"), spark.createDataFrame(edges, "edge_id string, src string, dst string, type string, cnt long"))
    rows = [(e, a, b, t) for e, a, b, t, _ in edges] + [(e, b, a, t) for e, a, b, t, _ in edges if a != b]
    for hops in (2, 3):
        paths = [[x] for x in rows]
        for _ in range(hops - 1):
            paths = [p + [x] for p in paths for x in rows if p[-1][2] == x[1] and x[0] not in [y[0] for y in p]]
        want = Counter((label[p[0][1]], label[p[-1][2]], ">".join(x[3] for x in p)) for p in paths)
        got = {(x["start_label"], x["end_label"], x["types"]): x["cnt"] for x in graph.path_pattern_counts(g, hops).collect()}
        assert got == want


def test_names_fan_out_over_labels(spark):
    got = graph.resolve_by_name(spark.createDataFrame([("Acme", "fire")], "src_name string, dst_name string"), mini(spark).nodes)
    assert {(r["src"], r["dst"]) for r in got.collect()} == {("a", "c"), ("d", "c")}


def test_merge_keeps_old_values(spark):
    rows = spark.createDataFrame([("k", 1, "x", 5), ("k", 2, None, 6)], "k string, s int, a string, b int")
    assert graph.merge_props(rows, ["k"], "s").first().asDict() == {"k": "k", "a": "x", "b": 6}
    assert graph.last_wins(rows, ["k"], "s").first()["a"] is None


def test_pairs_keep_self_pairs(spark):
    rows = spark.createDataFrame([(1, 0, "x"), (1, 1, "x"), (1, 2, "y")], "g int, i int, e string").withColumn("l", F.lit("L"))
    got = {(r["source"], r["target"]): r["cnt"] for r in graph.pairs_in_groups(rows, "g", "i", "e", "l").collect()}
    assert got == {("x", "x"): 1, ("x", "y"): 2}


def test_clusters_and_matches():
    assert text.clusters_of(["Apple Inc", "apple", "Pear", "Apple Inc"]) == [0, 0, 1, 0]
    assert text.best_match("acme corp", ["Beta", "ACME Corp", "Acme"]) == "ACME Corp"
    assert text.best_match("qqq", ["Beta"]) is None


def test_spans_overlap_and_cover():
    t = ("word " * 800 + "\n\n") * 4
    spans = text.spans_of(t, 6000, 500)
    assert spans[0]["start"] == 0 and spans[-1]["end"] == len(t)
    assert all(a["end"] > b["start"] > a["start"] for a, b in zip(spans, spans[1:]))
    assert text.spans_of(None) == []


def test_speakers_and_title_case(spark):
    df = spark.createDataFrame([("John O. Smith: hello\nmore\nAnn Lee: bye",)], "t string").select(text.speaker_segments("t").alias("s"), text.title_case(F.lit("o'neil-smith 3m")).alias("n"), text.redact(F.lit("abcdef")).alias("r"))
    row = df.first()
    assert [(x["speaker"], x["text"]) for x in row["s"]] == [("John O. Smith", "hello\nmore"), ("Ann Lee", "bye")]
    assert row["n"] == "O'Neil-Smith 3M" and row["r"] == "**cdef"


def test_metadata_filter(spark):
    df = spark.createDataFrame([('{"k": "a", "d": "2024"}',), ('{"k": "b"}',)], "metadata string")
    assert df.filter(retrieval.metadata_filter('metadata["k"] == "a" and metadata["d"] >= "2020"')).count() == 1


def test_searches_of_many_queries(spark):
    """Each query of a table gets what it gets alone, from its whole text."""
    r = random.Random(2)
    words = ["w%d" % k for k in range(30)]
    docs = spark.createDataFrame([(i, " ".join(r.choices(words, k=r.randint(0, 40)))) for i in range(60)], "doc_id long, text string")
    vectors = spark.createDataFrame([(i, [r.random() for _ in range(4)]) for i in range(60)], "vec_id long, embedding array<float>")
    texts = {i: " ".join(r.choices(words, k=12)) for i in (0, 50, 100)}
    points = {i: [r.random() for _ in range(4)] for i in texts}
    asked = spark.createDataFrame([(i, texts[i], points[i]) for i in texts], "query_id long, text string, embedding array<double>")
    many = [near.dense_topk_each(vectors, asked, 5).withColumnRenamed("vec_id", "id"), retrieval.bm25_topk_each(docs, asked, 5).withColumnRenamed("doc_id", "id")]
    fused = [retrieval.reciprocal_ranks_each(many, "id"), retrieval.weighted_each([(many[0], 0.7), (many[1], 0.3)], "id")]
    rows = [x.collect() for x in many + fused]
    for i in texts:
        one = [retrieval.dense_topk(vectors, points[i], 5).withColumnRenamed("vec_id", "id"), retrieval.bm25_topk(docs, texts[i].split(), 5).withColumnRenamed("doc_id", "id")]
        alone = one + [retrieval.reciprocal_ranks(one, "id"), retrieval.weighted([(one[0], 0.7), (one[1], 0.3)], "id")]
        for got, want in zip(rows, alone, strict=True):
            assert {x["id"]: round(x["score"], 6) for x in got if x["query_id"] == i} == {x["id"]: round(x["score"], 6) for x in want.collect()}


def test_sources(spark, tmp_path):
    base = tmp_path / "ACME" / "2024"
    base.mkdir(parents=True)
    for s in ("10", "1A", "1", "x"):
        (base / f"{s}.json").write_text(json.dumps({"metadata": {"section": s}, "content": f"text {s}"}))
    listed = files.listing(spark, str(tmp_path), ".json")
    assert [tuple(r) for r in files.filings(listed).collect()] == [("ACME", "2024")]
    assert [r["section"] for r in files.sections(listed).collect()] == ["1", "1A", "10", "x"]
    assert {r["content"] for r in files.read_sections(spark, str(base)).collect()} == {"text 10", "text 1A", "text 1", "text x"}
    (tmp_path / "call.json").write_text(json.dumps([{"symbol": "A", "quarter": "q3", "year": "2024", "date": "d", "content": "c"}]))
    assert files.read_transcripts(spark, str(tmp_path / "call.json")).first()["quarter"] == 3
    (tmp_path / "f4.json").write_text(json.dumps({"accessionNo": "1", "issuer": {"cik": "9", "name": "N", "tradingSymbol": "T"}, "reportingOwner": {"cik": "8", "name": "O"}, "nonDerivativeTable": {"transactions": [{"securityTitle": "s", "coding": {"code": "P"}, "amounts": {"shares": 5.0}}]}, "derivativeTable": None}))
    assert [r["code"] for r in files.insider_transactions(files.read_insider(spark, str(tmp_path / "f4.json"))).collect()] == ["P"]


def test_sinks(spark, tmp_path):
    g = mini(spark)
    sinks.cache_view(g.nodes, str(tmp_path), "v")
    assert sinks.cached_view(spark, str(tmp_path), "v").count() == 5
    assert sinks.cached_view(spark, str(tmp_path), "v", ttl_s=-10).count() == 0
    for at, status in ((1, "failed"), (2, "completed")):
        sinks.log_checkpoint(spark.createDataFrame([("k", status, at)], "key string, status string, processed_at int"), str(tmp_path / "cp"))
    assert sinks.checkpoint_state(spark, str(tmp_path / "cp")).first()["status"] == "completed"
    assert sinks.snapshot(g.edges, str(tmp_path / "snap")) == 4
    assert json.loads(sinks.schema_document(g).first()["document"])["node_types"][0] == {"name": "ORG", "count": 3}


def test_incremental_rerun_adds_nothing(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, v string").write.parquet(src)
    ingest_available(spark, src, out, cp, ["id"])
    spark.createDataFrame([(2, "b"), (3, "c")], "id int, v string").write.mode("append").parquet(src)
    ingest_available(spark, src, out, cp, ["id"])
    ingest_available(spark, src, out, str(tmp_path / "cp2"), ["id"])
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def sentence(*tokens):
    return [dict(zip(("i", "text", "lemma", "pos", "dep", "head"), (i, *t), strict=True)) for i, t in enumerate(tokens)]


HEDGED = sentence(("The", "the", "DET", "det", 1), ("company", "company", "NOUN", "nsubj", 2), ("hedges", "hedge", "VERB", "ROOT", 2), ("currency", "currency", "NOUN", "compound", 4), ("risk", "risk", "NOUN", "dobj", 2))
SOLD = sentence(("Acme", "Acme", "PROPN", "nsubj", 1), ("sells", "sell", "VERB", "ROOT", 1), ("in", "in", "ADP", "prep", 1), ("Greater", "Greater", "PROPN", "compound", 4), ("China", "China", "PROPN", "pobj", 2))
EXPOSED = sentence(("We", "we", "PRON", "nsubjpass", 2), ("are", "be", "AUX", "auxpass", 2), ("exposed", "exposed", "VERB", "ROOT", 2), ("to", "to", "ADP", "prep", 2), ("market", "market", "NOUN", "compound", 5), ("swings", "swing", "NOUN", "pobj", 3))


def test_relations_of_parsed_sentences(spark):
    rows = spark.createDataFrame([(1, HEDGED), (2, SOLD), (3, EXPOSED), (4, []), (5, None)], f"id int, tokens {extract.TOKENS}")
    got = {(r["id"], x["type"], x["source"], x["target"]) for r in rows.select("id", extract.relations("tokens").alias("r")).collect() for x in r["r"]}
    assert got == {(1, "MITIGATES_RISK", "The company", "currency risk"), (2, "OPERATES_IN", "Acme", "Greater China"), (2, "SVO_TRIPLE", "Acme", "Greater China"), (3, "EXPOSES_TO_RISK", "We", "market swings")}


def test_quantities_and_titles():
    grown = sentence(("total", "total", "ADJ", "amod", 2), ("cloud", "cloud", "NOUN", "compound", 2), ("revenue", "revenue", "NOUN", "ROOT", 2), ("of", "of", "ADP", "prep", 2), ("$", "$", "SYM", "nmod", 5), ("5", "5", "NUM", "nummod", 2))
    assert extract.quantities_of(grown, [{"text": "$5", "label": "MONEY", "start": 4, "end": 6}])[0] == {"type": "QUANTITY_OF", "source": "cloud total revenue", "target": "$5", "verb": None}
    told = sentence(("Ann", "Ann", "PROPN", "nsubj", 6), (",", ",", "PUNCT", "punct", 0), ("chief", "chief", "ADJ", "amod", 4), ("people", "people", "NOUN", "compound", 4), ("officer", "officer", "NOUN", "appos", 0), (",", ",", "PUNCT", "punct", 0), ("spoke", "speak", "VERB", "ROOT", 6))
    assert [x["target"] for x in extract.titles_of(told, [{"text": "Ann", "label": "PERSON", "start": 0, "end": 1}])] == ["chief people officer"]
    assert extract.titles_of(told, [{"text": "Bob", "label": "PERSON", "start": 6, "end": 7}]) == []


def test_statements_need_a_sentence(spark):
    parts = spark.createDataFrame([(1, "Ann", "I am the CFO here", 0, 20), (1, "Bob", "no sentence", 20, 25), (1, "Cy", "next", 25, 40)], "doc int, speaker string, text string, start int, end int")
    heard = spark.createDataFrame([(1, 7, 0), (1, 8, 19), (1, 9, 25), (2, 1, 3)], "doc int, sentence_id int, start int")
    got = [(r["seq"], r["speaker"], r["sentence_ids"], r["role"]) for r in extract.statements(parts, heard, "doc").orderBy("seq").collect()]
    assert got == [(0, "Ann", [7, 8], "CFO"), (1, "Cy", [9], None)]


def test_extractors_on_nulls_and_case(spark):
    docs = spark.createDataFrame([(1, "Subject to Gdpr and the Clean Air Act of 1990. The reportable segments are Cloud, Devices and Games"), (2, None), (3, "")], "k int, text string")
    got = {(r["k"], r["label"], r["entity"]) for r in extract.entities(docs, "k").collect()}
    assert got == {(1, "REGULATION", "GDPR"), (1, "REGULATION", "Clean Air Act of 1990"), (1, "SEGMENT", "Cloud"), (1, "SEGMENT", "Devices"), (1, "SEGMENT", "Games"), (1, "RISK", "Gdpr And The Clean Air")}
    kept = spark.createDataFrame([("risk", ["DET"]), ("company", ["NOUN", "NOUN"]), ("apple", ["ADJ", "NOUN"]), ("apple", ["DET", "NOUN"])], "root string, pos array<string>")
    assert [r[0] for r in kept.select(extract.is_concept("root", "pos")).collect()] == [True, False, True, False]


def test_filing_rules(spark):
    rows = spark.createDataFrame([("AAPL", "2020"), ("aapl", "2020"), ("AAPL", "1990"), ("TOOLONG", "2020"), (None, "x")], "s string, y string")
    assert [r[0] for r in rows.select(extract.valid_filing("s", "y")).collect()] == [True, False, False, False, False]

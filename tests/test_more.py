"""Field queries, resolution, quantiles, stores, spans, answers and sinks on small fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import answers, extract, resolve, retrieval, text
from tessera.functions.fields import field_query
from tessera.operators import graph, intervals
from tessera.sources import files, sinks, store
from tessera.streaming import changed_texts, current_rows, ingest_available, sessions, upsert_available, windowed_counts


def test_field_queries(spark):
    rows = [
        {"symbol": "ABC", "day": "2024-03-01", "n": 5, "owner": {"name": "Ann Lee"}, "tx": [{"code": "S", "shares": 10.0}, {"code": "P", "shares": 2000.0}]},
        {"symbol": "XYZ", "day": "2023-03-01", "n": 50, "owner": {"name": "Bo"}, "tx": [{"code": "F", "shares": 1.0}]},
        {"symbol": None, "day": None, "n": None, "owner": None, "tx": None},
    ]
    df = spark.createDataFrame(rows, "symbol string, day string, n int, owner struct<name:string>, tx array<struct<code:string,shares:double>>")
    find = lambda q: [i for i, r in enumerate(df.withColumn("hit", field_query(q, df.schema)).collect()) if r["hit"]]
    assert find("symbol:ABC") == [0] and find("NOT symbol:ABC") == [1, 2] and find("symbol:*") == [0, 1] and find("symbol:X*") == [1]
    assert find("day:[2023-01-01 TO 2023-12-31] OR n:<10") == [0, 1] and find("day:[2023-06-01 TO *]") == [0]
    assert find("tx.code:(S OR F) AND tx.shares:>1000") == [0] and find('owner.name:"Ann Lee"') == [0]
    assert find("(symbol:ABC OR symbol:XYZ) AND NOT n:>=50") == [0] and find("") == [0, 1, 2]
    for wrong in ("symbol:", "symbol:ABC n:5", "(symbol:ABC", "nothing:1", "ABC", "owner.age:3"):
        with pytest.raises(ValueError):
            field_query(wrong, df.schema)


def test_entities_are_resolved_step_by_step(spark):
    known = spark.createDataFrame([(1, 1, "Acme Corporation", "ORG"), (1, 1, "fire risk", "RISK"), (1, 2, "Zenith Industries", "ORG"), (2, 1, "Orion", "ORG")], "d int, s int, name string, label string")
    refs = spark.createDataFrame([(1, 1, " acme corporation"), (1, 1, "Acme Corporatoin"), (1, 1, "zenith industries."), (1, 1, "Orion"), (1, 2, "exposure to loss"), (1, 1, None), (1, 1, "x" * 200)], "d int, s int, ref string")
    got = {(r["ref"], r["s"]): (r["name"], r["label"], r["how"]) for r in resolve.resolve_entities(refs, known, "d", "s").collect()}
    assert got == {
        (" acme corporation", 1): ("Acme Corporation", "ORG", "exact"), ("Acme Corporatoin", 1): ("Acme Corporation", "ORG", "sentence"), ("zenith industries.", 1): ("Zenith Industries", "ORG", "document"),
        ("Orion", 1): ("Orion", "CONCEPT", "new"), ("exposure to loss", 2): ("exposure to loss", "RISK", "new"), ("x" * 200, 1): ("x" * 100, "CONCEPT", "new"),
    }


@pytest.mark.parametrize("accuracy", [10, 10_000])
def test_exact_quantiles(spark, accuracy):
    r = random.Random(1)
    rows = [(k % 3, float(r.choice([r.random(), 0.5]))) for k in range(3000)] + [(9, 1.0), (8, None)]
    got = {(x["g"], x["q"]): x["quantile"] for x in answers.exact_quantiles(spark.createDataFrame(rows, "g int, v double"), "g", "v", [0.0, 0.5, 0.95, 1.0], accuracy).collect()}
    for g in (0, 1, 2, 9):
        v = sorted(x for k, x in rows if k == g)
        for q in (0.0, 0.5, 0.95, 1.0):
            rank = q * (len(v) - 1)
            low = int(rank)
            want = v[low] + (v[min(low + 1, len(v) - 1)] - v[low]) * (rank - low)
            assert abs(got[g, q] - want) < 1e-9
    assert (8, 0.5) not in got


def test_rouge_l_and_softmax(spark):
    r, rows = random.Random(2), []
    for _ in range(40):
        rows.append(([r.choice("abc") for _ in range(r.randint(0, 7))], [r.choice("abc") for _ in range(r.randint(0, 7))]))
    got = [x["r"] for x in spark.createDataFrame(rows, "a array<string>, b array<string>").select(answers.rouge_l(F.col("a"), F.col("b")).alias("r")).collect()]
    for (a, b), value in zip(rows, got, strict=True):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert value == (2.0 * best[-1][-1] / (len(a) + len(b)) if a and b else 0.0)


def test_generated_sql():
    assert answers.checked_sql("Here it is:\n```sql\nSELECT a FROM t;\n```") == "SELECT a FROM t LIMIT 50"
    assert answers.checked_sql("select a from t limit 3") == "select a from t limit 3"
    assert answers.checked_sql("SELECT count(*) AS n FROM t") == "SELECT count(*) AS n FROM t"
    assert answers.checked_sql("SELECT a, count(*) FROM t GROUP BY a").endswith("LIMIT 50")
    with pytest.raises(ValueError):
        answers.checked_sql("no query")
    seen = []

    def write(question, error):
        seen.append(error)
        return "select good from t" if error else "select bad from t"

    def run(sql):
        if "bad" in sql:
            raise RuntimeError("no column bad")
        return sql

    assert answers.self_healing(run, write, "q") == "select good from t LIMIT 50" and seen == [None, "no column bad"]
    with pytest.raises(RuntimeError):
        answers.self_healing(run, lambda q, e: "select bad from t", "q")


def test_spans_of_other_keys_do_not_meet(spark):
    s = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 4, 8), (2, 3, 0, 9)], "k int, i int, start int, end int")
    taken = spark.createDataFrame([(1, 5, 9), (3, 0, 9)], "k int, start int, end int")
    assert {r["i"] for r in intervals.not_overlapping(s, taken, ["k"]).collect()} == {1, 3}
    assert {(r["i"], r["outer_start"]) for r in intervals.contained_first(s, taken.union(spark.createDataFrame([(1, 0, 20), (1, 4, 8)], taken.schema)), ["k"], "i").collect()} == {(1, 0), (2, 0)}


def test_stored_tables_are_built_once(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(10).withColumn("type", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))

    one, two = (store.stored(spark, str(tmp_path), "t", make, ["type"]) for _ in range(2))
    assert len(calls) == 1 and one.filter("type = 'a'").count() == 5 and two.count() == 10
    assert "PartitionFilters: [isnotnull(type" in one.filter("type = 'a'")._jdf.queryExecution().toString()
    spark.range(1).write.parquet(str(tmp_path / "input.parquet"))  # the inputs change
    assert store.stored(spark, str(tmp_path), "t", make, ["type"]).count() == 10 and len(calls) == 2
    store.drop(spark, str(tmp_path))
    assert store.stored(spark, str(tmp_path), "t", make, ["type"]).count() == 10 and len(calls) == 3


def test_labelled_sections_come_once(spark):
    known = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long")
    fresh = spark.createDataFrame([("b", 5), ("c", 7)], "k string, n long")
    assert {tuple(r) for r in graph.merge_counts(known, fresh, ["k"], "n").collect()} == {("a", 1, "kept"), ("b", 5, "set"), ("c", 7, "added")}


def test_long_answers_are_split_and_not_cut(spark):
    parts = [f"Sentence number {k} has some words in it." for k in range(60)]
    got = spark.createDataFrame([("Q: " + " ".join(parts),)], "t string").select(text.questions_answers("t").alias("x")).first()["x"]
    assert all(len(x) <= 600 for x in got) and " ".join(got) == " ".join(parts)


def test_html_text_survives_what_is_not_closed(spark):
    page = "<body><nav><ul><li>menu</ul><p>first<div>second</div></body>"
    assert "second" in spark.createDataFrame([(page,)], "h string").select(text.html_text("h").alias("x")).first()["x"]


def test_upserts_replace_what_changed(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").write.parquet(src)
    upsert_available(spark, src, out, cp, ["id"])
    spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string").write.mode("append").parquet(src)
    upsert_available(spark, src, out, cp, ["id"])
    upsert_available(spark, src, out, cp, ["id"])  # nothing new
    assert sorted(tuple(r) for r in current_rows(spark, out, ["id"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_changed_texts_are_done_anew(spark):
    state = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string").withColumn("digest", F.sha2("t", 256))
    rows = spark.createDataFrame([(1, "a"), (2, "c"), (3, None)], "id int, t string")
    assert {r["id"] for r in changed_texts(rows, state, "id", "t").collect()} == {2, 3}


def test_windows_and_sessions(spark):
    rows = spark.createDataFrame([("k", f"2024-01-01 {t}") for t in ("10:05:00", "10:50:00", "11:10:00", "13:00:00")], "k string, t string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r["n"] for r in windowed_counts(rows, "t", "k").collect()) == [1, 1, 2]
    assert sorted(r["n"] for r in sessions(rows, "t", "k").collect()) == [1, 1, 2]


def test_feeds_and_vectors(spark, tmp_path):
    feed = "<rss><item><title>FOMC statement</title><link>http://a/1</link><pubDate>d</pubDate><category>c</category></item><item><title><![CDATA[Minutes of]]></title><link>http://a/2</link></item><item><title>Minutes of</title><link>http://a/2</link></item></rss>"
    (tmp_path / "feed.xml").write_text(feed)
    got = {r["link"]: (r["title"], r["is_statement"], r["is_minutes"]) for r in files.feed_items(spark, str(tmp_path / "feed.xml")).collect()}
    assert got == {"http://a/1": ("FOMC statement", True, False), "http://a/2": ("Minutes of", False, True)}
    docs = spark.createDataFrame([(1, "some text"), (2, "x. " * 3000)], "doc_id long, text string")
    sinks.write_vectors(docs, str(tmp_path / "v"), lambda texts: [[float(len(t)), 1.0] for t in texts], 2)
    back = spark.read.parquet(str(tmp_path / "v"))
    assert back.filter("doc_id = 1").first()["embedding"] == [9.0, 1.0] and back.filter("embedding[0] != length(text)").isEmpty()
    assert sinks.restore(spark, str(tmp_path / "v"), str(tmp_path / "w")) == back.count()


def test_train_files_and_vector_scan(spark, tmp_path):
    rows = spark.createDataFrame([(2, 'say "x", y', 1), (1, "plain", 0), (3, None, 2)], "i int, text string, label int")
    sinks.write_labelled(rows, str(tmp_path / "train"), "i")
    got = files.read_labelled(spark, str(tmp_path / "train"))
    assert [(r["text"], r["label"]) for r in got.orderBy("text").collect()] == [("plain", 0), ('say "x", y', 1)]
    (tmp_path / "symbols.json").write_text(json.dumps(["B", "A", "A"]))
    assert [r["symbol"] for r in files.symbols(spark, str(tmp_path / "symbols.json")).orderBy("symbol").collect()] == ["A", "B"]


def test_ingestion_without_target_adds_all(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    spark.createDataFrame([(1, "a")], "id int, v string").write.parquet(src)
    ingest_available(spark, src, out, cp, ["id"])
    assert spark.read.parquet(out).count() == 1


def test_small_retrieval_helpers(spark):
    assert retrieval.settings({"k": 3, "ranker": None}, {"ranker": "rrf", "x": 1}, {"k": 5, "ranker": "weighted", "alpha": 0.5}) == {"k": 3, "ranker": "rrf", "alpha": 0.5}
    assert retrieval.output_fields(["a", "zz"], ["id", "a", "v"], "v", "id") == ["a"] and retrieval.output_fields(["zz"], ["id", "a", "b", "v"], "v", "id") == ["a", "b"]
    df = spark.createDataFrame([(1, 0.25, "on 2024-01-02, 2023-05-06 and 2024-01-02", [1.0, 0.0]), (2, 3.0, None, [0.0, 1.0])], "id int, d double, t string, v array<double>")
    got = df.select(retrieval.shown_similarity(F.col("d")).alias("s"), retrieval.dates_in("t").alias("t")).collect()
    assert [r["s"] for r in got] == [0.75, 0.25] and got[0]["t"] == ["2024-01-02", "2023-05-06"] and got[1]["t"] is None
    assert [r["id"] for r in retrieval.dense_topk(df, [1.0, 0.0], 5, "id", "v", threshold=0.5).collect()] == [1]
    about = retrieval.described(df.select("id", "d"), 1)
    assert about["fields"] == {"id": "int", "d": "double"} and about["rows"] == 2 and len(about["sample"]) == 1


def test_pages_names_and_samples(spark):
    rows = [("http://a.b/c/d?x", "/p"), ("http://a.b/c/d", "q.pdf"), ("https://a.b/c/", "//x.y/z"), ("http://a.b", "ftp://k/l")]
    got = [r["u"] for r in spark.createDataFrame(rows, "url string, href string").select(files.absolute_url("url", "href").alias("u")).collect()]
    assert got == ["http://a.b/p", "http://a.b/c/q.pdf", "https://x.y/z", "ftp://k/l"]
    pages = spark.createDataFrame([("<title> T </title><meta charset='x'><meta content=\"2025-10-29\" property=\"article:published_time\">",), ("none",)], "h string")
    title, date = files.page_meta("h")
    assert [tuple(r) for r in pages.select(title, date).collect()] == [("T", "2025-10-29"), ("", None)]
    assert spark.createDataFrame([("LEE, ann o'neil-x",)], "n string").select(text.insider_name("n").alias("n")).first()["n"] == "Lee Ann O'Neil-X"
    one, two = (sorted(r["id"] for r in files.sample(spark.range(100).repartition(k), 7, 3, "id").collect()) for k in (2, 5))
    assert one == two and len(one) == 7
    assert [x["target"] for x in extract.titles_before_names("Here is our chief financial officer, Ann. And the weather, Bo.", ["Ann Lee", "Bo Ray"])] == ["chief financial officer"]

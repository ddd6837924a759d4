"""The stored graph builds what a query names, and counts rivals without listing them for each product."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.plans.queries import ORACLE_SQL, QUERIES
from tessera.sources import graph_tables, store
from tessera.sources.graph_tables import Graph, build

SF = "/root/testdata/sf0.001"


@pytest.fixture
def fresh(tmp_path):
    for name in os.listdir(SF):
        os.symlink(f"{SF}/{name}", tmp_path / name)
    return str(tmp_path)


def names(base):
    return {k[2] for k in store._STORED if k[1] == base}


def test_only_named_parts_are_built(spark, fresh):
    QUERIES["temporal_insights"](spark, fresh).collect()
    assert names(fresh) == {"lines", "edges-CO_MENTIONED-ORG-DATE", "nodes-ORG", "nodes-DATE"}
    QUERIES["two_hop_patterns"](spark, fresh).collect()
    QUERIES["load_check"](spark, fresh).collect()
    assert not any("COMPETES_WITH" in n for n in names(fresh))


def test_parts_equal_the_whole(spark):
    g = build(spark, SF)
    whole = Graph(g.nodes, g.edges)
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(g.edge_counts()) == rows(whole.edge_counts())
    assert rows(g.edge_types()) == rows(whole.edge_types())
    assert rows(g.first_edges(3)) == rows(whole.first_edges(3))
    assert rows(g.degrees_of("COMPETES_WITH", "SAID")) == rows(whole.degrees_of("COMPETES_WITH", "SAID"))
    me = g.nodes_of("ORG").filter("name in ('1', '3')")
    ids = [r["node_id"] for r in me.collect()]
    touched = lambda df: rows(df.filter(F.col("src").isin(ids) | F.col("dst").isin(ids)))
    assert touched(g.edges_at(me)) == touched(whole.edges_at(me)) == touched(g.edges)


@pytest.mark.parametrize("most", [0, 1 << 30])
def test_rivals_are_counted_by_lists(spark, fresh, monkeypatch, most):
    """Counts, degrees and the first edges of rivals are those of all pairs, which aren't made for them."""
    g = build(spark, fresh)
    whole = Graph(g.nodes_of("ORG"), g.edges_of("COMPETES_WITH"))
    wanted = whole.edge_counts().first()["n"], sorted(map(tuple, whole.degrees_of().collect())), sorted(map(tuple, whole.first_edges(7).collect()))
    store.drop(spark, fresh)
    monkeypatch.setattr(graph_tables, "PAIRS", max(1, most))
    monkeypatch.setattr(graph_tables.StoredGraph, "_rivals", lambda self: pytest.fail("pairs are listed"))
    g = build(spark, fresh)
    if most == 0:
        monkeypatch.setattr(graph_tables.StoredGraph, "_dealt", lambda self, each: each)  # in as few tasks
    counts = {r["type"]: r["n"] for r in g.edge_counts().collect()}
    assert (counts["COMPETES_WITH"], sorted(map(tuple, g.degrees_of("COMPETES_WITH").collect()))) == wanted[:2]
    assert sorted(map(tuple, g.first_edges(7).filter("type = 'COMPETES_WITH'").collect())) == wanted[2]


def test_paths_through_a_hub_are_counted_not_listed(spark):
    """A node with 3,000 neighbours has nine million paths of two edges."""
    n = 3000
    nodes = spark.range(n + 1).select(F.col("id").cast("string").alias("node_id"), F.when(F.col("id") == 0, "HUB").otherwise("X").alias("label"))
    edges = spark.range(1, n + 1).select(F.col("id").cast("string").alias("edge_id"), F.col("id").cast("string").alias("src"), F.lit("0").alias("dst"), F.lit("t").alias("type"), F.lit(1).alias("cnt"))
    two = {tuple(r) for r in graph.path_pattern_counts(Graph(nodes, edges), 2, "t").collect()}
    assert two == {("X", "X", "t>t", n * (n - 1))}
    assert graph.path_pattern_counts(Graph(nodes, edges), 3, "t").collect() == []


def test_mentions_come_from_stored_pairs(spark, fresh, monkeypatch):
    """Once pairs are counted, nodes, degrees and edges are made without another pass over the lines or the talk."""
    wanted = sorted(map(tuple, build(spark, SF).nodes_of("ORG", "DATE", "PERSON", "PRODUCT").collect()), key=str)
    edges = build(spark, SF).edges_of("CO_MENTIONED")
    ends = edges.select("edge_id", "src").union(edges.select("edge_id", "dst")).distinct().groupBy("src").count()
    degrees = sorted(map(tuple, ends.collect()))
    g = build(spark, fresh)
    g.edges_of("CO_MENTIONED")
    monkeypatch.setattr(graph_tables.StoredGraph, "_lines", lambda self: pytest.fail("lines are read again"))
    monkeypatch.setattr(graph_tables.StoredGraph, "_turns", lambda self: pytest.fail("conversations are read again"))
    assert sorted(map(tuple, g.nodes_of("ORG", "DATE", "PERSON", "PRODUCT").collect()), key=str) == wanted
    assert sorted((r["node_id"], r["degree"]) for r in g.degrees_of("CO_MENTIONED").collect()) == degrees


def test_mentions_count_lines_without_values(spark, tmp_path):
    """Lines whose supplier has no nation, or that have no date, count for the other end of a pair and for the node without an id."""
    for name in os.listdir(SF):
        if name not in ("supplier.parquet", "lineitem.parquet"):
            os.symlink(f"{SF}/{name}", tmp_path / name)
    spark.read.parquet(f"{SF}/supplier.parquet").withColumn("s_nationkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey"))).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_shipdate", F.when(F.col("l_linenumber") != 1, F.col("l_shipdate"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    g = build(spark, str(tmp_path))
    lines = sorted(map(tuple, g.nodes_of("ORG", "GPE", "DATE").collect()), key=str)
    store.drop(spark, str(tmp_path))
    g.edges_of("CO_MENTIONED")
    assert sorted(map(tuple, g.nodes_of("ORG", "GPE", "DATE").collect()), key=str) == lines
    assert sum(node is None for node, *_ in lines) == 2
    whole = Graph(g.nodes, g.edges_of("CO_MENTIONED"))
    assert sorted(map(tuple, g.degrees_of("CO_MENTIONED").collect()), key=str) == sorted(map(tuple, whole.degrees_of().collect()), key=str)


def test_schema_names_builds_no_edges(spark, fresh):
    rows = {tuple(r) for r in QUERIES["schema_names"](spark, fresh).collect()}
    assert not any(n.startswith(("edges", "companies")) for n in names(fresh))
    whole = build(spark, fresh)
    assert {v for k, v in rows if k == "type"} == {r["type"] for r in whole.edges.select("type").distinct().collect()}


@pytest.mark.parametrize("name", ["people_with_roles", "speaker_quotes", "speaker_network", "top_speakers", "statements_by_section"])
def test_speakers_come_from_the_talk_alone(spark, fresh, monkeypatch, name):
    wanted = list(map(tuple, QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(graph_tables.StoredGraph, "_lines", lambda self: pytest.fail("lines are built"))
    assert list(map(tuple, QUERIES[name](spark, fresh).collect())) == wanted != []


def test_people_of_lines_and_talk_are_all_there(spark, fresh):
    g = build(spark, fresh)
    people = {r["node_id"]: r["mentions"] for r in g.nodes_of("PERSON").collect()}
    speakers = {r["node_id"]: r["mentions"] for r in g.nodes_ending("SAID", labels=["PERSON"]).collect()}
    assert {k: n for k, n in people.items() if k[0] == "Q"} == speakers != {}
    assert {k for k in people if k[0] == "C"} == {r["src"] for r in g.edges_of("CO_MENTIONED", touching=["PERSON"]).select(F.when(F.col("src_label") == "PERSON", F.col("src")).otherwise(F.col("dst")).alias("src")).collect()}
    assert {k[0] for k in people} == {"C", "Q"}
    assert {r["label"] for r in g.nodes_ending("SAID").collect()} == {"PERSON", "STATEMENT"}


def test_repeated_turns_count_once(spark, tmp_path):
    for name in os.listdir(SF):
        if name != "conversations.parquet":
            os.symlink(f"{SF}/{name}", tmp_path / name)
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    rows.union(rows).union(rows.withColumn("text", F.concat("text", F.lit(" the")))).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["person"]: r["statements"] for r in QUERIES["people_with_roles"](spark, str(tmp_path)).collect()}
    turns = rows.select(F.concat("role", (F.col("conv_id") % 20).cast("string")).alias("person"), "conv_id", "turn").distinct().groupBy("person").count().collect()
    most = sorted(((r["person"], r["count"]) for r in turns), key=lambda x: (-x[1], x[0]))[:30]
    assert got == dict(most)


@pytest.mark.parametrize("name", ["competitive_landscape", "node_in_out"])
def test_rivals_are_ordered_by_their_ids(spark, tmp_path, name):
    """Ids are text, so S10 comes before S9: the first company of a pair is that of the SQL once keys differ in length."""
    c = duckdb.connect()
    for table in os.listdir(SF):
        if table not in ("supplier.parquet", "lineitem.parquet"):
            os.symlink(f"{SF}/{table}", tmp_path / table)
    spark.read.parquet(f"{SF}/supplier.parquet").withColumn("s_suppkey", F.col("s_suppkey") * 3).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_suppkey", F.col("l_suppkey") * 3).write.parquet(f"{tmp_path}/lineitem.parquet")
    for table in os.listdir(tmp_path):
        path = f"{tmp_path}/{table}"
        c.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = QUERIES[name](spark, str(tmp_path))
    wanted = c.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(wanted) != []
    g = build(spark, str(tmp_path))
    me = g.nodes_of("ORG").filter("name in ('3', '12')")
    rivals = lambda e: {tuple(r) for r in e.filter("type = 'COMPETES_WITH' and (src in ('S3', 'S12') or dst in ('S3', 'S12'))").select("src", "dst", "cnt").collect()}
    assert rivals(g.edges_at(me)) == rivals(g.edges) != set()


def test_ego_builds_what_its_nodes_touch(spark, fresh):
    wanted = sorted(map(tuple, graph.ego(Graph(build(spark, SF).nodes, build(spark, SF).edges), "-07").collect()))
    assert sorted(map(tuple, graph.ego(build(spark, fresh), "-07").collect())) == wanted != []
    assert not any(n.startswith(("companies", "edges-COMPETES_WITH", "edges-CAUSES")) for n in names(fresh))


def test_degrees_of_rivals_meet_a_pair_once(spark, fresh, monkeypatch):
    """Each list goes to a company without those before it, so a pair is shuffled once; causes are kept by their keys."""
    whole = build(spark, SF)
    wanted = sorted(map(tuple, Graph(whole.nodes, whole.edges).degrees_of().collect()), key=str)
    each, sent = graph_tables.StoredGraph._each, []
    monkeypatch.setattr(graph_tables.StoredGraph, "_each", lambda self, met: sent.append(each(self, met)) or sent[-1])
    g = build(spark, fresh)
    assert sorted(map(tuple, g.degrees_of().collect()), key=str) == wanted
    pairs = g._companies().agg(F.sum(F.expr("size(orgs) * (size(orgs) - 1) div 2"))).first()[0]
    assert [df.agg(F.sum(F.size("met"))).first()[0] for df in sent] == [pairs]
    assert g._rows(("CAUSES", "ORG", "RISK")).columns == ["org", "risk", "date", "d"]

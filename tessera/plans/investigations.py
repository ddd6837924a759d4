"""Investigations of an organisation and overviews of the graph, each with the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import graph as go
from tessera.plans.queries import C, query, table
from tessera.sources.graph_tables import PRELUDE, Graph, build

#: The organisation that is looked into.
ORG = "1"
WORD = "the"

_SPEAKERS = "(SELECT dst, list_sort(list(DISTINCT p.name)) AS who FROM edges JOIN nodes p ON p.node_id = src AND p.label = 'PERSON' WHERE type = 'SAID' GROUP BY dst) w"
_TOLD = "coalesce(who[1], '') AS primary_speaker, coalesce(array_to_string(who, '|'), '') AS all_speakers, coalesce(len(who), 0) AS speaker_count"


def _org(g: Graph, name: str = ORG) -> DataFrame:
    return g.nodes_of("ORG").filter(C("name") == name)


def _with_speakers(g: Graph, statements: DataFrame) -> DataFrame:
    """Rows with a statement's node id as `statement`, and who said it: the first by name, all, and how many."""
    people = g.nodes_ending("SAID", labels=["PERSON"]).select(C("node_id").alias("src"), C("name").alias("who"))
    said = g.edges_of("SAID").join(people, "src").groupBy(C("dst").alias("statement")).agg(F.array_sort(F.collect_set("who")).alias("who"))
    rows = statements.join(said, "statement", "left")
    none = F.coalesce("who", F.array().cast("array<string>"))
    return rows.withColumns({"primary_speaker": F.coalesce(F.get(none, F.lit(0)), F.lit("")), "all_speakers": F.array_join(none, "|"), "speaker_count": F.size(none).cast("long")}).drop("who")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements' texts; repeated turns are repeated."""
    return table(spark, sf_dir, "conversations").select(F.concat_ws("-", C("conv_id").cast("string"), C("turn").cast("string")).alias("statement_id"), "text", "role", "conv_id")


@query(
    f"""SELECT s.name AS statement_id, x.section_id, {_TOLD} FROM nodes s JOIN (SELECT DISTINCT conv_id || '-' AS section_id FROM talk
    WHERE employer = 'S1') x ON starts_with(s.name, x.section_id) LEFT JOIN {_SPEAKERS} ON w.dst = s.node_id WHERE s.label = 'STATEMENT'
    ORDER BY statement_id LIMIT 50""",
    graph=True,
)
def statements_by_section(g: Graph) -> DataFrame:
    """Statements whose id begins with that of a section of the company: an equi-join on the part before the mark, then the prefix."""
    employed = g.edges_of("WORKS_FOR").filter("dst = 'S1'").select("src")
    sections = g.edges_of("SAID").join(employed, "src", "left_semi").select(F.expr("substring(dst, 2)").alias("id")).select(F.concat(F.split_part("id", F.lit("-"), F.lit(1)), F.lit("-")).alias("section_id"))
    own = g.edges_of("CO_MENTIONED", touching=["STATEMENT"], beside=["ORG"]).filter("src_label = 'STATEMENT' and dst = 'S1'").select(F.concat(F.split_part(F.expr("substring(src, 2)"), F.lit("-"), F.lit(1)), F.lit("-")).alias("section_id"))
    sections = sections.join(own, "section_id", "left_semi").distinct().withColumn("k", C("section_id"))
    rows = g.nodes_of("STATEMENT").select(C("node_id").alias("statement"), C("name").alias("statement_id"), F.concat(F.split_part("name", F.lit("-"), F.lit(1)), F.lit("-")).alias("k"))
    rows = rows.join(sections, "k").filter(F.startswith(C("statement_id"), C("section_id"))).select("statement", "statement_id", "section_id")
    return go.top(_with_speakers(g, rows).drop("statement"), C("statement_id"), n=50)


@query(
    f"""SELECT s.name AS statement_id, e.cnt, {_TOLD} FROM edges e JOIN nodes o ON o.node_id = e.dst AND o.label = 'ORG' AND o.name = '{ORG}'
    JOIN nodes s ON s.node_id = e.src AND s.label = 'STATEMENT' LEFT JOIN {_SPEAKERS} ON w.dst = s.node_id WHERE e.type = 'CO_MENTIONED'
    ORDER BY statement_id LIMIT 50""",
    graph=True,
)
def statements_of_org(g: Graph) -> DataFrame:
    near = g.edges_of("CO_MENTIONED", touching=["STATEMENT"], beside=["ORG"]).join(_org(g).select(C("node_id").alias("dst")), "dst")
    rows = near.join(g.nodes_of("STATEMENT").select(C("node_id").alias("src"), C("name").alias("statement_id")), "src")
    return go.top(_with_speakers(g, rows.select(C("src").alias("statement"), "statement_id", "cnt")).drop("statement"), C("statement_id"), n=50)


@query(
    f"""SELECT DISTINCT s.name AS statement_id, m.label AS shared_type, m.name AS shared_name FROM eu x
    JOIN nodes o ON o.node_id = x.a AND o.label = 'ORG' AND o.name = '{ORG}' JOIN nodes m ON m.node_id = x.b JOIN eu y ON y.a = m.node_id
    JOIN nodes s ON s.node_id = y.b AND s.label = 'STATEMENT'
    WHERE x.type = 'CO_MENTIONED' AND y.type IN ('CO_MENTIONED', 'SAID') AND contains(m.name, '2')
    ORDER BY statement_id, shared_name, shared_type LIMIT 50""",
    graph=True,
)
def statements_by_shared_entity(g: Graph) -> DataFrame:
    """Statements that share an entity with the organisation: both sides meet on the entity."""
    near = go.undirected(g.edges_of("CO_MENTIONED", touching=["ORG"])).join(F.broadcast(_org(g).select(C("node_id").alias("a"))), "a").select(C("b").alias("via")).distinct()
    shared = g.nodes.filter(C("name").contains("2")).select(C("node_id").alias("via"), C("label").alias("shared_type"), C("name").alias("shared_name")).join(near, "via", "left_semi")
    said = go.undirected(g.edges_of("CO_MENTIONED", "SAID", touching=["STATEMENT"]).filter((C("src_label") == "STATEMENT") | (C("dst_label") == "STATEMENT"))).select(C("a").alias("via"), "b")
    rows = said.join(shared, "via").join(g.nodes_of("STATEMENT").select(C("node_id").alias("b"), C("name").alias("statement_id")), "b")
    return go.top(rows.select("statement_id", "shared_type", "shared_name").distinct(), C("statement_id"), C("shared_name"), C("shared_type"), n=50)


def _by_text(sql: str):
    """Register a query over the graph and the statements' texts."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(build(spark, sf_dir), _texts(spark, sf_dir))

        run.__name__ = f.__name__
        query(f"{PRELUDE} {sql}")(run)
        return f

    return put


@_by_text(
    f"""SELECT p.name AS person, coalesce(min(r.name), '') AS role, count(DISTINCT t.statement) AS statements FROM talk t
    JOIN edges e ON e.dst = t.statement AND e.type = 'SAID' JOIN nodes p ON p.node_id = e.src LEFT
    JOIN edges h ON h.src = p.node_id AND h.type = 'HAS_ROLE' LEFT JOIN nodes r ON r.node_id = h.dst WHERE contains(lower(t.text), '{WORD}')
    GROUP BY p.node_id, p.name ORDER BY statements DESC, person LIMIT 30"""
)
def people_with_roles(g: Graph, texts: DataFrame) -> DataFrame:
    hits = texts.filter(F.lower("text").contains(WORD)).select(F.concat(F.lit("U"), "statement_id").alias("dst")).distinct()
    count = g.edges_of("SAID").join(hits, "dst", "left_semi").groupBy("src").agg(F.count("*").alias("statements"))
    roles = g.edges_of("HAS_ROLE").join(g.nodes_of("ROLE").select(C("node_id").alias("dst"), "name"), "dst").groupBy("src").agg(F.min("name").alias("role"))
    rows = go.optional(count, roles, "src", [], ["role"]).join(g.nodes_ending("SAID", labels=["PERSON"]).select(C("node_id").alias("src"), C("name").alias("person")), "src")
    return go.top(rows.select("person", "role", "statements"), F.desc("statements"), C("person"), n=30)


@_by_text(
    """SELECT DISTINCT p.name AS speaker, t.conv_id || '-' || t.turn AS statement_id, substring(t.text, 1, 200) AS quote FROM edges e
    JOIN nodes p ON p.node_id = e.src JOIN talk t ON t.statement = e.dst WHERE e.type = 'SAID' AND p.name = 'user3' ORDER BY statement_id, quote LIMIT 10"""
)
def speaker_quotes(g: Graph, texts: DataFrame) -> DataFrame:
    who = g.nodes_ending("SAID", labels=["PERSON"]).filter("name = 'user3'").select(C("node_id").alias("src"), C("name").alias("speaker"))
    said = g.edges_of("SAID").join(F.broadcast(who), "src").select("speaker", F.expr("substring(dst, 2)").alias("statement_id"))
    quotes = texts.select("statement_id", F.substring("text", 1, 200).alias("quote")).distinct()
    return go.top(said.join(quotes, "statement_id").select("speaker", "statement_id", "quote"), C("statement_id"), C("quote"), n=10)


def _near_sql(label: str, n: int) -> str:
    return f"SELECT o.name, sum(cnt)::BIGINT AS mentions FROM eu JOIN nodes s ON s.node_id = a AND s.label = 'ORG' AND s.name = '{ORG}' JOIN nodes o ON o.node_id = b AND o.label = '{label}' WHERE type = 'CO_MENTIONED' GROUP BY o.node_id, o.name ORDER BY mentions DESC, o.name LIMIT {n}"


def _near(g: Graph, label: str, n: int) -> DataFrame:
    ends = g.edges_of("CO_MENTIONED", touching=[label], beside=["ORG"]).filter((C("src_label") == label) | (C("dst_label") == label))
    rows = go.undirected(ends).join(F.broadcast(_org(g).select(C("node_id").alias("a"))), "a").join(g.nodes_of(label).select(C("node_id").alias("b"), "name"), "b")
    return go.top(rows.groupBy("b", "name").agg(F.sum("cnt").alias("mentions")).drop("b"), F.desc("mentions"), C("name"), n=n)


@query(_near_sql("DATE", 30), graph=True)
def org_dates(g: Graph) -> DataFrame:
    return _near(g, "DATE", 30)


@query(_near_sql("CONCEPT", 30), graph=True)
def org_concepts(g: Graph) -> DataFrame:
    return _near(g, "CONCEPT", 30)


@query(_near_sql("MONEY", 15), graph=True)
def org_quantities(g: Graph) -> DataFrame:
    return _near(g, "MONEY", 15)


@query(
    f"""SELECT m.name, n.b AS concept, n.cnt FROM (SELECT * FROM eu WHERE type = 'CO_MENTIONED') n JOIN nodes m ON m.node_id = n.a AND m.label = 'METRIC'
    JOIN (SELECT DISTINCT b FROM eu JOIN nodes s ON s.node_id = a AND s.label = 'ORG' AND s.name = '{ORG}'
    JOIN nodes c ON c.node_id = b AND c.label = 'CONCEPT' WHERE type = 'CO_MENTIONED') k ON k.b = n.b ORDER BY n.cnt DESC, m.name, concept LIMIT 30""",
    graph=True,
)
def org_metrics(g: Graph) -> DataFrame:
    """Metrics that share a concept with the organisation."""
    near = go.undirected(g.edges_of("CO_MENTIONED", touching=["CONCEPT"], beside=["ORG", "METRIC"]))
    concepts = near.join(F.broadcast(_org(g).select(C("node_id").alias("a"))), "a").join(g.nodes_of("CONCEPT").select(C("node_id").alias("b")), "b", "left_semi").select("b").distinct()
    rows = near.join(g.nodes_of("METRIC").select(C("node_id").alias("a"), "name"), "a").join(concepts, "b", "left_semi")
    return go.top(rows.select("name", C("b").alias("concept"), "cnt"), F.desc("cnt"), C("name"), C("concept"), n=30)


@query(
    f"""SELECT x.direction, r.name AS risk, x.type, x.cnt FROM (SELECT 'out' AS direction, type, cnt, src AS me, dst AS other FROM edges
    UNION ALL SELECT 'in', type, cnt, dst, src FROM edges) x JOIN nodes o ON o.node_id = me AND o.label = 'ORG' AND o.name = '{ORG}'
    JOIN nodes r ON r.node_id = other AND r.label = 'RISK' WHERE type IN ('EXPOSES_TO_RISK', 'MITIGATES_RISK')
    ORDER BY cnt DESC, risk, direction, type LIMIT 30""",
    graph=True,
)
def org_risks(g: Graph) -> DataFrame:
    edges, me = g.edges_of("EXPOSES_TO_RISK", "MITIGATES_RISK"), _org(g).select(C("node_id").alias("me"))
    side = lambda way, own, other: edges.select(F.lit(way).alias("direction"), "type", "cnt", C(own).alias("me"), C(other).alias("other"))
    rows = side("out", "src", "dst").unionByName(side("in", "dst", "src")).join(F.broadcast(me), "me").join(g.nodes_of("RISK").select(C("node_id").alias("other"), C("name").alias("risk")), "other")
    return go.top(rows.select("direction", "risk", "type", "cnt"), F.desc("cnt"), C("risk"), C("direction"), C("type"), n=30)


@query(
    """SELECT c_name AS company, o_orderkey AS section_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS filing_date, o_orderpriority AS section FROM orders
    JOIN customer ON o_custkey = c_custkey WHERE o_custkey = 7 OR contains(c_name, '00011') ORDER BY filing_date DESC, section_id, section LIMIT 50"""
)
def sections_of_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), C("o_custkey") == C("c_custkey")).filter((C("o_custkey") == 7) | C("c_name").contains("00011"))
    rows = rows.select(C("c_name").alias("company"), C("o_orderkey").alias("section_id"), F.to_date("o_orderdate").cast("string").alias("filing_date"), C("o_orderpriority").alias("section"))
    return go.top(rows, F.desc("filing_date"), C("section_id"), C("section"), n=50)


@query("SELECT s_suppkey, s_name FROM supplier WHERE list_contains([s_name, 'S' || s_suppkey, lower(s_name)], 'supplier#000000007') OR list_contains([s_name, 'S' || s_suppkey, lower(s_name)], 'S3')")
def org_by_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership in a list property."""
    variants = F.array(C("s_name"), F.concat(F.lit("S"), C("s_suppkey").cast("string")), F.lower("s_name"))
    return table(spark, sf_dir, "supplier").withColumn("variants", variants).filter(F.array_contains("variants", "supplier#000000007") | F.array_contains("variants", "S3")).select("s_suppkey", "s_name")


# --- overviews ---------------------------------------------------------------------------------------------


@query(
    """SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(DISTINCT label)
    FROM nodes) AS n_labels, (SELECT count(DISTINCT type) FROM edges) AS n_types, (SELECT count(*) FROM nodes) > 0 AND (SELECT count(*)
    FROM edges) > 0 AS loaded, (SELECT array_to_string(list(label || ':' || n ORDER BY n DESC, label), ', ') FROM (SELECT label, count(*) AS n FROM nodes
    GROUP BY label ORDER BY n DESC, label LIMIT 5)) AS top_labels""",
    graph=True,
)
def load_check(g: Graph) -> DataFrame:
    labels = g.nodes.groupBy("label").agg(F.count("*").alias("n"))  # a row for each label
    types = g.edge_counts()
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "label"))
    named = F.array_sort(F.collect_list(F.when(C("r") <= 5, F.struct("r", F.concat_ws(":", "label", C("n").cast("string")).alias("t")))))
    of_nodes = labels.withColumn("r", rank).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_nodes"), F.count("*").alias("n_labels"), F.array_join(F.transform(named, lambda x: x["t"]), ", ").alias("top_labels"))
    of_edges = types.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_edges"), F.count("*").alias("n_types"))
    return of_nodes.crossJoin(F.broadcast(of_edges)).select("n_nodes", "n_edges", "n_labels", "n_types", ((C("n_nodes") > 0) & (C("n_edges") > 0)).alias("loaded"), "top_labels")  # one row each


def _keys(**columns: str) -> Column:
    """Names of the properties that a row has, in order."""
    return F.array_sort(F.array_compact(F.array(*[F.when(C(c).isNotNull(), F.lit(k)) for k, c in columns.items()])))


_KEYS_SQL = "array_to_string(list_sort(list_filter([CASE WHEN name IS NOT NULL THEN 'name' END, CASE WHEN mentions IS NOT NULL THEN 'mentions' END, 'node_id'], lambda x: x IS NOT NULL)), ',')"


@query(f"SELECT label, {_KEYS_SQL} AS keys, count(*) AS cnt FROM nodes GROUP BY ALL", graph=True)
def label_keys(g: Graph) -> DataFrame:
    return g.nodes.groupBy("label", F.array_join(_keys(name="name", mentions="mentions", node_id="node_id"), ",").alias("keys")).agg(F.count("*").alias("cnt"))


@query(
    """SELECT DISTINCT kind, key
    FROM (SELECT 'node' AS kind, unnest(list_filter([CASE WHEN name IS NOT NULL THEN 'name' END, CASE WHEN mentions IS NOT NULL THEN 'mentions' END], lambda x: x IS NOT NULL)) AS key
    FROM nodes
    UNION ALL SELECT 'edge', unnest(list_filter([CASE WHEN cnt IS NOT NULL THEN 'cnt' END, CASE WHEN confidence IS NOT NULL THEN 'confidence' END, CASE WHEN quote IS NOT NULL THEN 'quote' END], lambda x: x IS NOT NULL))
    FROM edges)""",
    graph=True,
)
def property_keys(g: Graph) -> DataFrame:
    """Keys in use, found by one flag for each and not by exploding rows."""
    used = lambda df, kind, names: df.agg(F.array_compact(F.array(*[F.when(F.count(c) > 0, F.lit(c)) for c in names])).alias("k")).select(F.lit(kind).alias("kind"), F.explode("k").alias("key"))
    return used(g.nodes, "node", ["name", "mentions"]).union(used(g.edges, "edge", ["cnt", "confidence", "quote"]))


@query("SELECT label, node_id, name FROM nodes QUALIFY row_number() OVER (PARTITION BY label ORDER BY node_id) <= 3", graph=True)
def sample_nodes(g: Graph) -> DataFrame:
    return go.cap(g.nodes.select("label", "node_id", "name"), ["label"], ["node_id"], 3)


@query(
    """SELECT e.type, e.edge_id, p.name AS source, q.name AS target FROM (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY type
    ORDER BY edge_id) <= 5) e JOIN nodes p ON p.node_id = src JOIN nodes q ON q.node_id = dst""",
    graph=True,
)
def sample_edges(g: Graph) -> DataFrame:
    few, n = g.first_edges(5), g.nodes.select("node_id", "name")
    return n.toDF("src", "source").join(F.broadcast(few), "src").join(n.toDF("dst", "target"), "dst").select("type", "edge_id", "source", "target")


@query(
    """SELECT name, label, sum(cnt)::BIGINT AS mentions FROM edges JOIN nodes ON node_id = dst WHERE type = 'CO_MENTIONED' GROUP BY node_id, name, label
    ORDER BY mentions DESC, name, label LIMIT 15""",
    graph=True,
)
def most_mentioned(g: Graph) -> DataFrame:
    rows = g.edges_of("CO_MENTIONED").groupBy(C("dst").alias("node_id")).agg(F.sum("cnt").alias("mentions")).join(g.nodes_ending("CO_MENTIONED").select("node_id", "name", "label"), "node_id")
    return go.top(rows.select("name", "label", "mentions"), F.desc("mentions"), C("name"), C("label"), n=15)


@query(
    """SELECT s.name AS person, o.label, count(DISTINCT b) AS cnt FROM eu JOIN nodes s ON s.node_id = a AND s.label = 'PERSON' JOIN nodes o ON o.node_id = b
    WHERE o.label IN ('PERSON', 'ORG', 'ROLE') GROUP BY s.node_id, s.name, o.label""",
    graph=True,
)
def person_neighbourhood(g: Graph) -> DataFrame:
    near = go.undirected(g.edges_of(touching=["PERSON"]).filter("src_label = 'PERSON' or dst_label = 'PERSON'"))
    people = g.nodes_of("PERSON").select(C("node_id").alias("a"), C("name").alias("person"))
    ends = g.nodes_of("PERSON", "ORG", "ROLE").select(C("node_id").alias("b"), "label")
    return near.select("a", "b").distinct().join(people, "a").join(ends, "b").groupBy("a", "person", "label").agg(F.count("*").alias("cnt")).drop("a")


@query(
    """SELECT n_nodes, n_edges, n_statements, round(n_statements / n_docs, 4) AS statements_per_document, round(n_edges / n_docs, 4) AS edges_per_document, n_statements / n_docs < 10 AS alert
    FROM (SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM nodes
    WHERE label = 'STATEMENT') AS n_statements, (SELECT count(DISTINCT conv_id) FROM talk) AS n_docs)""",
    graph=True,
)
def document_ratios(g: Graph) -> DataFrame:
    """Ratios to the number of documents, with an alert for few statements in each."""
    is_statement = C("label") == "STATEMENT"
    doc = F.when(is_statement, F.split_part("name", F.lit("-"), F.lit(1)))
    of_nodes = g.nodes.agg(F.count("*").alias("n_nodes"), F.sum(is_statement.cast("long")).alias("n_statements"), F.countDistinct(doc).alias("n_docs"))
    both = of_nodes.crossJoin(F.broadcast(g.edge_counts().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_edges"))))  # one row each
    per = C("n_statements") / C("n_docs")
    return both.select("n_nodes", "n_edges", "n_statements", F.round(per, 4).alias("statements_per_document"), F.round(C("n_edges") / C("n_docs"), 4).alias("edges_per_document"), (per < 10).alias("alert"))

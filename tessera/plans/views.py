"""The named views over a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import hubs, names, neighbours, optional, top
from tessera.sources.graph_tables import Graph

C = F.col


def _labelled(g: Graph, label: str, min_mentions: int, *ending: str) -> DataFrame:
    """Nodes of a label; with types, ends of their edges are enough."""
    return (g.nodes_ending(*ending, labels=[label]) if ending else g.nodes_of(label)).filter(C("mentions") > min_mentions).select("node_id", "name", "mentions")


def risk_dashboard(g: Graph, n: int = 50) -> DataFrame:
    by = lambda kind, out: g.edges_of(kind).groupBy(C("dst").alias("node_id")).agg(F.countDistinct("src").alias(out))
    rows = optional(optional(_labelled(g, "RISK", 1), by("EXPOSES_TO_RISK", "exposures"), "node_id", ["exposures"]), by("MITIGATES_RISK", "mitigations"), "node_id", ["mitigations"])
    ratio = F.when(C("exposures") > 0, F.round(C("mitigations").cast("double") / (C("exposures") + 1), 4)).otherwise(0.0)
    return top(rows.select(C("name").alias("risk_name"), "mentions", "exposures", "mitigations", ratio.alias("mitigation_ratio")), F.desc_nulls_first("mentions"), C("risk_name"), n=n)


def financial_hotspots(g: Graph, min_mentions: int = 5, n: int = 50) -> DataFrame:
    near = neighbours(g, ["GEOGRAPHY", "GPE", "LOC"], ["CO_MENTIONED"], of=["MONEY"]).groupBy("node_id").agg(F.countDistinct("other").alias("geo_count"), names("other_name", 3).alias("geographies"))
    rows = optional(_labelled(g, "MONEY", min_mentions), near, "node_id", ["geo_count"], ["geographies"])
    return top(rows.select(C("name").alias("amount"), "mentions", "geo_count", "geographies"), F.desc_nulls_first("mentions"), C("amount"), n=n)


def product_ecosystem(g: Graph, n: int = 30) -> DataFrame:
    near = neighbours(g, ["ORG"], ["CO_MENTIONED"], 1, of=["PRODUCT"]).groupBy("node_id").agg(F.countDistinct("other").alias("org_count"), names("other_name", 5).alias("orgs"))
    rows = optional(_labelled(g, "PRODUCT", 2), near, "node_id", ["org_count"], ["orgs"])
    return top(rows.select(C("name").alias("product"), "mentions", "org_count", "orgs"), F.desc("org_count"), F.desc_nulls_first("mentions"), C("product"), n=n)


def regulatory_network(g: Graph, n: int = 30) -> DataFrame:
    of = lambda label: F.countDistinct(F.when(C("other_label") == label, C("other")))
    near = neighbours(g, ["ORG", "PERSON", "CONCEPT"], ["CO_MENTIONED"], 1, of=["REGULATION"]).groupBy("node_id").agg(of("ORG").alias("orgs"), of("PERSON").alias("people"), of("CONCEPT").alias("concepts"))
    rows = optional(_labelled(g, "REGULATION", 2), near, "node_id", ["orgs", "people", "concepts"])
    return top(rows.select(C("name").alias("regulation"), "mentions", "orgs", "people", "concepts", (C("orgs") + C("people") + C("concepts")).alias("total_impact")), F.desc("total_impact"), C("regulation"), n=n)


def competitive_landscape(g: Graph, min_count: int = 1, n: int = 50) -> DataFrame:
    n1, n2 = (g.nodes_of("ORG").select(C("node_id").alias(k), C("name").alias(c)) for k, c in (("src", "company1"), ("dst", "company2")))
    money = neighbours(g, ["MONEY"], ["CO_MENTIONED"], of=["ORG"]).groupBy(C("node_id").alias("src")).agg(F.countDistinct("other").alias("money_count"), names("other_name", 5).alias("financial_mentions"))
    rows = optional(g.edges_of("COMPETES_WITH").filter(C("cnt") > min_count).join(n1, "src").join(n2, "dst"), money, "src", ["money_count"], ["financial_mentions"])
    return top(rows.select("company1", "company2", C("cnt").alias("co_mentions"), "money_count", "financial_mentions"), F.desc("co_mentions"), C("company1"), C("company2"), n=n)


def risk_exposure_map(g: Graph, n: int = 100) -> DataFrame:
    orgs, risks = g.nodes_of("ORG").select(C("node_id").alias("src"), C("name").alias("organization")), g.nodes_of("RISK").select(C("node_id").alias("dst"), C("name").alias("risk"), C("mentions").alias("risk_mentions"))
    by = g.edges_of("MITIGATES_RISK").join(g.nodes_ending("MITIGATES_RISK").select(C("node_id").alias("src"), C("name").alias("who")), "src").groupBy("dst").agg(F.countDistinct("src").alias("mitigation_count"), names("who", 3).alias("mitigations"))
    rows = optional(g.edges_of("EXPOSES_TO_RISK").filter("cnt > 1").join(orgs, "src").join(risks, "dst"), by, "dst", ["mitigation_count"], ["mitigations"])
    return top(rows.select("organization", "risk", "risk_mentions", C("cnt").alias("exposure_count"), "mitigation_count", "mitigations"), F.desc("exposure_count"), F.desc_nulls_first("risk_mentions"), C("organization"), C("risk"), n=n)


def temporal_insights(g: Graph, n: int = 50) -> DataFrame:
    near = neighbours(g, ["DATE"], ["CO_MENTIONED"], 2).select("node_id", "other", C("other_name").alias("date")).distinct()
    rows = near.join(g.nodes_beside(["DATE"], ["CO_MENTIONED"]).select("node_id", "label", "name"), "node_id").groupBy(C("label").alias("entity_type"), C("name").alias("entity_name"), "date").agg(F.count("*").alias("temporal_connections"))
    return top(rows, F.desc("temporal_connections"), C("entity_name"), C("date"), C("entity_type"), n=n)


def speaker_network(g: Graph, n: int = 50) -> DataFrame:
    said = g.edges_of("SAID").groupBy(C("src").alias("node_id")).agg(F.countDistinct("dst").alias("statements"))
    roles = g.edges_of("HAS_ROLE").join(g.nodes_of("ROLE").select(C("node_id").alias("dst"), "name"), "dst").groupBy(C("src").alias("node_id")).agg(names("name", 3).alias("roles"))
    rows = optional(_labelled(g, "PERSON", 0, "SAID").join(said, "node_id"), roles, "node_id", [], ["roles"])
    return top(rows.select(C("name").alias("speaker"), "mentions", "statements", "roles"), F.desc("statements"), F.desc_nulls_first("mentions"), C("speaker"), n=n)


def metric_analysis(g: Graph, n: int = 50) -> DataFrame:
    near = neighbours(g, ["ORG", "PRODUCT", "CONCEPT"], ["CO_MENTIONED"], of=["METRIC"]).groupBy("node_id").agg(F.countDistinct("other").alias("entity_count"), names("other_name", 5).alias("entities"))
    rows = optional(_labelled(g, "METRIC", 2), near, "node_id", ["entity_count"], ["entities"])
    canonical = F.lower(F.regexp_replace("name", "^[0-9]+-", ""))
    return top(rows.select(C("name").alias("metric"), canonical.alias("canonical_metric"), "mentions", "entity_count", "entities"), F.desc_nulls_first("mentions"), C("metric"), n=n)


def causal_relationships(g: Graph, min_confidence: float = 0.6, n: int = 100) -> DataFrame:
    kinds = ["CAUSES", "DRIVES", "BOOSTS", "HURTS", "MITIGATES"]
    ends = g.nodes_ending(*kinds)
    a, b = ends.select(C("node_id").alias("src"), C("name").alias("source_entity"), C("label").alias("source_type")), ends.select(C("node_id").alias("dst"), C("name").alias("target_entity"), C("label").alias("target_type"))
    rows = g.edges_of(*kinds).filter(C("confidence").isNull() | (C("confidence") >= min_confidence)).join(a, "src").join(b, "dst")
    rows = rows.groupBy("src", "dst", "source_entity", "source_type", C("type").alias("rel_type"), "target_entity", "target_type").agg(F.count("*").alias("frequency"), names("quote", 2).alias("quotes")).drop("src", "dst")
    return top(rows, F.desc("frequency"), C("source_entity"), C("target_entity"), C("rel_type"), n=n)


def product_mentions(g: Graph, n: int = 50) -> DataFrame:
    near = neighbours(g, ["ORG"], ["CO_MENTIONED"], of=["PRODUCT"]).groupBy("node_id").agg(F.countDistinct("other").alias("org_count"), F.sum("cnt").alias("total_co_mentions"), names("other_name", 5).alias("orgs"))
    rows = optional(_labelled(g, "PRODUCT", 1), near, "node_id", ["org_count", "total_co_mentions"], ["orgs"])
    return top(rows.select(C("name").alias("product"), "mentions", "org_count", "total_co_mentions", "orgs"), F.desc("total_co_mentions"), F.desc_nulls_first("mentions"), C("product"), n=n)


def organization_roles(g: Graph, n: int = 100) -> DataFrame:
    roles = g.edges_of("HAS_ROLE").join(g.nodes_of("ROLE").select(C("node_id").alias("dst"), C("name").alias("role")), "dst").select(C("src").alias("node_id"), "role")
    works = g.edges_of("WORKS_FOR").join(g.nodes_of("ORG").select(C("node_id").alias("dst"), C("name").alias("organization")), "dst").select(C("src").alias("node_id"), "organization")
    rows = _labelled(g, "PERSON", 0, "HAS_ROLE").join(roles, "node_id").join(works, "node_id", "left").select(C("name").alias("person"), "role", "organization", "mentions")
    return top(rows, F.desc_nulls_first("mentions"), C("person"), C("role"), C("organization").asc_nulls_last(), n=n)


def statement_topics(g: Graph, n: int = 50) -> DataFrame:
    who = g.edges_of("SAID").join(g.nodes_ending("SAID").select(C("node_id").alias("src"), C("name").alias("speaker_name")), "src").select(C("dst").alias("node_id"), C("src").alias("speaker"), "speaker_name")
    topics = neighbours(g, ["CONCEPT", "ORG", "PRODUCT"], ["CO_MENTIONED"], of=["STATEMENT"]).groupBy("node_id").agg(F.countDistinct("other").alias("topic_count"), names("other_name", 5).alias("topics"))
    rows = optional(g.nodes_of("STATEMENT").select("node_id", "name").join(who, "node_id", "left"), topics, "node_id", ["topic_count"], ["topics"])
    return top(rows.select(C("name").alias("statement_id"), "speaker", "speaker_name", "topic_count", "topics"), F.desc("topic_count"), C("statement_id"), C("speaker"), n=n)


def comention_network(g: Graph, min_count: int = 1, n: int = 200) -> DataFrame:
    ends = g.nodes_ending("CO_MENTIONED")
    a, b = ends.select(C("node_id").alias("src"), C("name").alias("source"), C("label").alias("source_type")), ends.select(C("node_id").alias("dst"), C("name").alias("target"), C("label").alias("target_type"))
    rows = g.edges_of("CO_MENTIONED").filter(C("cnt") > min_count).join(a, "src").join(b, "dst").select("source", "source_type", "target", "target_type", C("cnt").alias("co_mentions"))
    return top(rows, F.desc("co_mentions"), C("source"), C("target"), C("source_type"), C("target_type"), n=n)


def hubs_all_edges(g: Graph) -> DataFrame:
    return hubs(g, 10, 5).drop("node_id")


def hubs_comention(g: Graph) -> DataFrame:
    return hubs(g, 5, 3, ["CO_MENTIONED"]).drop("node_id")


VIEWS = {f.__name__: f for f in (hubs_all_edges, risk_dashboard, financial_hotspots, product_ecosystem, regulatory_network, competitive_landscape, risk_exposure_map, temporal_insights, hubs_comention, speaker_network, metric_analysis, causal_relationships, product_mentions, organization_roles, statement_topics, comention_network)}

_near = lambda labels, least, cols, src="node_id": f"SELECT a AS {src}, {cols} FROM eu JOIN nodes o ON o.node_id = b WHERE type = 'CO_MENTIONED' AND coalesce(cnt, 0) > {least} AND o.label IN ({labels}) GROUP BY a"
_names = lambda x, k: f"coalesce(array_to_string(list_sort(list(DISTINCT {x}))[1:{k}], '|'), '')"
_hub = lambda m, d, w: f"SELECT label AS type, name, mentions, degree, degree * mentions AS influence FROM nodes JOIN (SELECT a AS node_id, count(DISTINCT edge_id) AS degree FROM eu {w} GROUP BY a) USING (node_id) WHERE mentions > {m} AND degree > {d} ORDER BY influence DESC, node_id LIMIT 100"
VIEW_SQL = {
    "hubs_all_edges": _hub(10, 5, ""),
    "hubs_comention": _hub(5, 3, "WHERE type = 'CO_MENTIONED'"),
    "risk_dashboard": """SELECT name AS risk_name, mentions, coalesce(e, 0) AS exposures, coalesce(m, 0) AS mitigations, CASE WHEN coalesce(e, 0) > 0 THEN round(CAST(coalesce(m, 0) AS DOUBLE) / (e + 1), 4) ELSE 0.0 END AS mitigation_ratio
        FROM nodes LEFT JOIN (SELECT dst AS node_id, count(DISTINCT src) AS e FROM edges WHERE type = 'EXPOSES_TO_RISK' GROUP BY dst) USING (node_id) LEFT
        JOIN (SELECT dst AS node_id, count(DISTINCT src) AS m FROM edges WHERE type = 'MITIGATES_RISK' GROUP BY dst) USING (node_id)
        WHERE label = 'RISK' AND mentions > 1 ORDER BY mentions DESC, risk_name LIMIT 50""",
    "financial_hotspots": f"""SELECT name AS amount, mentions, coalesce(c, 0) AS geo_count, coalesce(l, '') AS geographies FROM nodes LEFT
        JOIN ({_near("'GEOGRAPHY','GPE','LOC'", 0, "count(DISTINCT b) AS c, " + _names('o.name', 3) + ' AS l')}) USING (node_id)
        WHERE label = 'MONEY' AND mentions > 5 ORDER BY mentions DESC, amount LIMIT 50""",
    "product_ecosystem": f"""SELECT name AS product, mentions, coalesce(c, 0) AS org_count, coalesce(l, '') AS orgs FROM nodes LEFT
        JOIN ({_near("'ORG'", 1, "count(DISTINCT b) AS c, " + _names('o.name', 5) + ' AS l')}) USING (node_id) WHERE label = 'PRODUCT' AND mentions > 2
        ORDER BY org_count DESC, mentions DESC, product LIMIT 30""",
    "regulatory_network": f"""SELECT name AS regulation, mentions, coalesce(x, 0) AS orgs, coalesce(y, 0) AS people, coalesce(z, 0) AS concepts, coalesce(x + y + z, 0) AS total_impact
        FROM nodes LEFT
        JOIN ({_near("'ORG','PERSON','CONCEPT'", 1, "count(DISTINCT CASE WHEN o.label = 'ORG' THEN b END) AS x, count(DISTINCT CASE WHEN o.label = 'PERSON' THEN b END) AS y, count(DISTINCT CASE WHEN o.label = 'CONCEPT' THEN b END) AS z")}) USING (node_id)
        WHERE label = 'REGULATION' AND mentions > 2 ORDER BY total_impact DESC, regulation LIMIT 30""",
    "competitive_landscape": f"""SELECT p.name AS company1, q.name AS company2, cnt AS co_mentions, coalesce(c, 0) AS money_count, coalesce(l, '') AS financial_mentions FROM edges
        JOIN nodes p ON p.node_id = src AND p.label = 'ORG' JOIN nodes q ON q.node_id = dst AND q.label = 'ORG' LEFT
        JOIN ({_near("'MONEY'", 0, "count(DISTINCT b) AS c, " + _names('o.name', 5) + ' AS l', 'src')}) m USING (src) WHERE type = 'COMPETES_WITH' AND cnt > 1
        ORDER BY cnt DESC, company1, company2 LIMIT 50""",
    "risk_exposure_map": f"""SELECT p.name AS organization, q.name AS risk, q.mentions AS risk_mentions, cnt AS exposure_count, coalesce(c, 0) AS mitigation_count, coalesce(l, '') AS mitigations
        FROM edges JOIN nodes p ON p.node_id = src AND p.label = 'ORG' JOIN nodes q ON q.node_id = dst AND q.label = 'RISK' LEFT
        JOIN (SELECT dst, count(DISTINCT src) AS c, {_names('w.name', 3)} AS l FROM edges JOIN nodes w ON w.node_id = src WHERE type = 'MITIGATES_RISK'
        GROUP BY dst) m USING (dst) WHERE type = 'EXPOSES_TO_RISK' AND cnt > 1 ORDER BY exposure_count DESC, risk_mentions DESC, organization, risk LIMIT 100""",
    "temporal_insights": """SELECT n.label AS entity_type, n.name AS entity_name, d.name AS date, count(*) AS temporal_connections FROM (SELECT DISTINCT a, b FROM eu
        WHERE type = 'CO_MENTIONED' AND cnt > 2) JOIN nodes d ON d.node_id = b AND d.label = 'DATE' JOIN nodes n ON n.node_id = a GROUP BY ALL
        ORDER BY temporal_connections DESC, entity_name, date, entity_type LIMIT 50""",
    "speaker_network": f"""SELECT name AS speaker, mentions, statements, coalesce(l, '') AS roles FROM nodes JOIN (SELECT src AS node_id, count(DISTINCT dst) AS statements
        FROM edges WHERE type = 'SAID' GROUP BY src) USING (node_id) LEFT JOIN (SELECT src AS node_id, {_names('r.name', 3)} AS l FROM edges
        JOIN nodes r ON r.node_id = dst AND r.label = 'ROLE' WHERE type = 'HAS_ROLE' GROUP BY src) USING (node_id) WHERE label = 'PERSON'
        ORDER BY statements DESC, mentions DESC, speaker LIMIT 50""",
    "metric_analysis": f"""SELECT name AS metric, lower(regexp_replace(name, '^[0-9]+-', '')) AS canonical_metric, mentions, coalesce(c, 0) AS entity_count, coalesce(l, '') AS entities
        FROM nodes LEFT JOIN ({_near("'ORG','PRODUCT','CONCEPT'", 0, "count(DISTINCT b) AS c, " + _names('o.name', 5) + ' AS l')}) USING (node_id)
        WHERE label = 'METRIC' AND mentions > 2 ORDER BY mentions DESC, metric LIMIT 50""",
    "causal_relationships": f"""SELECT p.name AS source_entity, p.label AS source_type, type AS rel_type, q.name AS target_entity, q.label AS target_type, count(*) AS frequency, {_names('quote', 2)} AS quotes
        FROM edges JOIN nodes p ON p.node_id = src JOIN nodes q ON q.node_id = dst
        WHERE type IN ('CAUSES', 'DRIVES', 'BOOSTS', 'HURTS', 'MITIGATES') AND (confidence IS NULL OR confidence >= 0.6)
        GROUP BY src, dst, p.name, p.label, type, q.name, q.label ORDER BY frequency DESC, source_entity, target_entity, rel_type LIMIT 100""",
    "product_mentions": f"""SELECT name AS product, mentions, coalesce(c, 0) AS org_count, CAST(coalesce(t, 0) AS BIGINT) AS total_co_mentions, coalesce(l, '') AS orgs FROM nodes
        LEFT JOIN ({_near("'ORG'", 0, "count(DISTINCT b) AS c, sum(cnt) AS t, " + _names('o.name', 5) + ' AS l')}) USING (node_id)
        WHERE label = 'PRODUCT' AND mentions > 1 ORDER BY total_co_mentions DESC, mentions DESC, product LIMIT 50""",
    "organization_roles": """SELECT p.name AS person, r.name AS role, o.name AS organization, p.mentions AS mentions FROM edges e
        JOIN nodes p ON p.node_id = e.src AND p.label = 'PERSON' JOIN nodes r ON r.node_id = e.dst AND r.label = 'ROLE' LEFT
        JOIN edges w ON w.src = e.src AND w.type = 'WORKS_FOR' LEFT JOIN nodes o ON o.node_id = w.dst AND o.label = 'ORG' WHERE e.type = 'HAS_ROLE'
        ORDER BY mentions DESC, person, role, organization LIMIT 100""",
    "statement_topics": f"""SELECT s.name AS statement_id, src AS speaker, p.name AS speaker_name, coalesce(c, 0) AS topic_count, coalesce(l, '') AS topics FROM nodes s LEFT
        JOIN edges e ON e.dst = s.node_id AND e.type = 'SAID' LEFT JOIN nodes p ON p.node_id = src LEFT
        JOIN ({_near("'CONCEPT','ORG','PRODUCT'", 0, "count(DISTINCT b) AS c, " + _names('o.name', 5) + ' AS l')}) t ON t.node_id = s.node_id
        WHERE s.label = 'STATEMENT' ORDER BY topic_count DESC, statement_id, speaker LIMIT 50""",
    "comention_network": """SELECT p.name AS source, p.label AS source_type, q.name AS target, q.label AS target_type, cnt AS co_mentions FROM edges
        JOIN nodes p ON p.node_id = src JOIN nodes q ON q.node_id = dst WHERE type = 'CO_MENTIONED' AND cnt > 1
        ORDER BY co_mentions DESC, source, target, source_type, target_type LIMIT 200""",
}

"""Queries of validation and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import audit as A
from graphloom.operators import graph as G
from graphloom.plans.base import EDGES, NODES, edges, nodes
from graphloom.plans.common import q, sql_said, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


_E = f"WITH {EDGES}"


@query("validate_paper", "SELECT doc_id, doc_id % 3 > 0 AS valid FROM documents")
def _(spark, sf):
    pmid = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id").cast("string")).when(F.col("doc_id") % 2 > 0, "x1")
    return table(spark, sf, "documents").select("doc_id", A.paper_is_valid(pmid).alias("valid"))


@query("validate_span", f"SELECT event_id, array_to_string({sql_said(("event_id % 7 = 0", q('text is empty')), ("event_id % 5 = 0", q('end must not be before start')), ('value > 1 OR value < 0', q('confidence must be between 0 and 1')))}, '; ') AS problems FROM events")
def _(spark, sf):
    c = F.col("event_id")
    text = F.when(c % 7 > 0, F.col("event_type")).otherwise(F.lit(" "))
    return table(spark, sf, "events").select("event_id", F.array_join(A.span_problems(text, F.lit(5), F.when(c % 5 == 0, 4).otherwise(9), F.col("value")), "; ").alias("problems"))


@query("validate_edge_topology", f"{_E} SELECT record_id, relation_index, relation = 'TARGETS' AS allowed FROM e")
def _(spark, sf):
    return A.topology(edges(spark, sf)).select("record_id", "relation_index", "allowed")


@query("validate_record_ids", f"{_E} SELECT record_id, bool_and(flag <> 'R') AS agree FROM e GROUP BY record_id")
def _(spark, sf):
    e = edges(spark, sf).withColumn("source_id", F.when(F.col("flag") == "R", "x").otherwise(F.col("source_id")))
    return e.groupBy("record_id").agg(F.collect_list("source_id").alias("s")).select("record_id", A.ids_agree(F.col("record_id"), F.col("s")).alias("agree"))


_FLAGS = sql_said(("true", q("missing trigger")), ("flag = 'N'", q("missing source sentence")), ("flag <> 'A'", q("missing extraction method")), ("confidence < 0.55", q("confidence < 0.55")))


@query("relation_audit", f"{_E} SELECT record_id, relation_index, array_to_string({_FLAGS}, '; ') AS flags FROM e")
def _(spark, sf):
    return A.relation_audit(edges(spark, sf)).select("record_id", "relation_index", F.array_join("flags", "; ").alias("flags"))


@query("provenance_audit", f"{_E} SELECT 'missing_evidence_method' AS issue_type, count(*) AS n FROM e UNION ALL SELECT 'missing_source_sentence', count(*) FROM e WHERE flag = 'N'")
def _(spark, sf):
    return A.provenance_issues(edges(spark, sf)).groupBy("issue_type").agg(F.count("*").alias("n"))


_QUALITY = f"""{EDGES}, {NODES}, pa AS (SELECT o_orderkey::VARCHAR AS record_id, CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS title, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus ELSE ' ' END AS abstract FROM orders),
z AS (SELECT 'records' AS metric, '' AS key, count(DISTINCT record_id) AS n FROM pa UNION ALL SELECT 'relations', '', count(*) FROM e UNION ALL SELECT 'node_mentions', '', count(*) FROM n
UNION ALL SELECT 'unique_nodes', '', count(DISTINCT row(label, lower(key))) FROM n UNION ALL SELECT 'label', label, count(*) FROM n GROUP BY label UNION ALL SELECT 'relation', relation, count(*) FROM e GROUP BY relation
UNION ALL SELECT 'tier', evidence_tier::VARCHAR, count(*) FROM e GROUP BY evidence_tier UNION ALL SELECT 'paper_only', '', count(DISTINCT record_id) FROM pa WHERE record_id NOT IN (SELECT record_id FROM e)
UNION ALL SELECT * FROM (SELECT 'top_entity', label || ':' || key AS k, count(*) AS n FROM n GROUP BY k ORDER BY n DESC, k LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'top_pair', head_label || ':' || head_key || ' ' || relation || ' ' || tail_label || ':' || tail_key AS k, count(*) AS n FROM e GROUP BY k ORDER BY n DESC, k LIMIT 10)
UNION ALL SELECT 'warning', 'node has no display_name', count(*) FROM n UNION ALL SELECT 'warning', 'relation has no source sentence', count(*) FROM e WHERE flag = 'N' HAVING count(*) > 0
UNION ALL SELECT 'warning', 'relation has no extraction method', count(*) FROM e WHERE flag <> 'A' HAVING count(*) > 0 UNION ALL SELECT 'warning', 'missing paper title', count(*) FROM pa WHERE title IS NULL HAVING count(*) > 0
UNION ALL SELECT 'warning', 'missing paper abstract', count(*) FROM pa WHERE trim(abstract) = '' HAVING count(*) > 0)"""
_Q = f"WITH {_QUALITY}"


def paper_rows(spark, sf):
    """Orders as papers, some without a title or an abstract."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(key.cast("string").alias("record_id"), F.when(key % 7 > 0, F.col("o_orderpriority")).alias("title"), F.when(key % 5 > 0, F.col("o_orderstatus")).otherwise(" ").alias("abstract"))


@query("graph_quality", f"{_Q} SELECT * FROM z")
def _(spark, sf):
    return A.graph_quality(edges(spark, sf), nodes(spark, sf), paper_rows(spark, sf))


@query("unified_quality", f"{_Q} SELECT * FROM z")
def _(spark, sf):
    e, n = edges(spark, sf), nodes(spark, sf)
    a, b = F.col("record_id").cast("long") % 2 == 0, F.col("record_id").cast("long") % 2 == 1
    return A.unified_quality([(e.where(a), n.where(a)), (e.where(b), n.where(b))], paper_rows(spark, sf))


@query("trial_graph_quality", "WITH t AS (SELECT DISTINCT p_partkey, 'Disease' AS label, unnest(string_split(p_name, ' ')) AS w FROM part UNION SELECT DISTINCT p_partkey, 'Treatment', unnest([p_type, p_brand]) FROM part) SELECT label, count(*) AS relations, count(DISTINCT w) AS unique_nodes, count(DISTINCT p_partkey) AS records FROM t GROUP BY label")
def _(spark, sf):
    trials = table(spark, sf, "part").select(F.concat(F.lit("NCT"), F.col("p_partkey").cast("string")).alias("nct_id"), F.split("p_name", " ").alias("conditions"), F.array("p_type", "p_brand").alias("interventions"))
    return G.build_trial_graph(trials).groupBy(F.col("tail_label").alias("label")).agg(F.count("*").alias("relations"), F.count_distinct("tail_key").alias("unique_nodes"), F.count_distinct("record_id").alias("records"))


@query("baseline_bundle", f"{_Q} SELECT * FROM z UNION ALL SELECT 'issue', 'missing_evidence_method', count(*) FROM e UNION ALL SELECT 'issue', 'missing_source_sentence', count(*) FROM e WHERE flag = 'N' UNION ALL SELECT 'load', 'records', count(DISTINCT record_id) FROM e UNION ALL SELECT 'load', 'node_merges', count(*) FROM n UNION ALL SELECT 'load', 'relation_merges', count(*) FROM e")
def _(spark, sf):
    """Quality, load counts and provenance of one graph in one table."""
    e, n = edges(spark, sf), nodes(spark, sf)
    issues = A.provenance_issues(e).groupBy(F.col("issue_type").alias("key")).agg(F.count("*").alias("n")).select(F.lit("issue").alias("metric"), "key", "n")
    loads = G.load_stats(e, n).select(F.lit("load").alias("metric"), F.col("metric").alias("key"), "n")
    return A.graph_quality(e, n, paper_rows(spark, sf)).unionByName(issues).unionByName(loads)




"""Queries of the graph operators, on line items as relations."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import rules
from graphloom.operators import extract as E
from graphloom.operators import graph as G
from graphloom.operators import paths as P
from graphloom.operators import review as R
from graphloom.operators import search as S
from graphloom.plans.base import EDGES, MERGED, NODES, OVERLAY, edges, nodes
from graphloom.plans.common import q, table
from graphloom.plans.q_extract import _MENTIONS, _NODE, _RELATIONS, LEXICON, RULES, papers

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def merged(spark, sf):
    return G.merge_edges(edges(spark, sf))


_ENDS = "head_label, head_key, relation, tail_label, tail_key"
_E, _M = f"WITH {EDGES}", f"WITH {EDGES}, {MERGED}"


@query("merge_edges", f"{_M} SELECT * FROM m")
def _(spark, sf):
    return merged(spark, sf)


@query("merge_nodes", f"WITH {EDGES}, {NODES} SELECT label, key, arg_max(tier, ord) AS tier FROM n GROUP BY label, key")
def _(spark, sf):
    return G.merge_nodes(nodes(spark, sf)).select("label", "key", F.element_at("properties", "tier").alias("tier"))


@query("merge_mentions", f"WITH {EDGES}, {NODES} SELECT DISTINCT record_id AS source_id, label, key, 0 AS evidence_tier FROM n")
def _(spark, sf):
    return G.merge_mentions(nodes(spark, sf))


@query("has_evidence_edges", f"{_E} SELECT DISTINCT tail_label, tail_key, evidence_tier, CASE evidence_tier {' '.join(f'WHEN {k} THEN {q(v)}' for k, v in rules.TIERS)} END AS level FROM e")
def _(spark, sf):
    return G.has_evidence_edges(edges(spark, sf))


@query("load_stats", f"WITH {EDGES}, {NODES} SELECT 'records' AS metric, count(DISTINCT record_id) AS n FROM e UNION ALL SELECT 'node_merges', count(*) FROM n UNION ALL SELECT 'relation_merges', count(*) FROM e")
def _(spark, sf):
    return G.load_stats(edges(spark, sf), nodes(spark, sf))


@query("neighborhood", f"{_M} SELECT {_ENDS}, citations, evidence_tier FROM m WHERE evidence_tier >= 3 AND citations >= 2 AND relation = 'TARGETS' ORDER BY evidence_tier DESC, citations DESC, {_ENDS} LIMIT 200")
def _(spark, sf):
    return G.neighborhood(merged(spark, sf), labels=("Drug",), relations=("TARGETS",), min_tier=3, min_citations=2, limit=200).select(*G.ENDS, "citations", "evidence_tier")


@query("edge_sources", f"{_E} SELECT DISTINCT {_ENDS}, source_id FROM e")
def _(spark, sf):
    return G.edge_sources(edges(spark, sf))


_LIMIT = 20_000
_PATHS = f"""i AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {_ENDS}) AS edge, * FROM m WHERE evidence_tier >= 2),
b AS MATERIALIZED (SELECT edge, head_label AS al, head_key AS ak, tail_label AS zl, tail_key AS zk FROM i UNION ALL SELECT edge, tail_label, tail_key, head_label, head_key FROM i),
p1 AS MATERIALIZED (SELECT al AS sl, ak AS sk, zl, zk, [edge] AS path, al = 'Gene' OR zl = 'Gene' AS hit FROM b WHERE contains(lower(ak), '171')),
p2 AS MATERIALIZED (SELECT sl, sk, b.zl, b.zk, path || [edge] AS path, hit OR b.zl = 'Gene' AS hit FROM p1 JOIN b ON p1.zl = al AND p1.zk = ak WHERE NOT list_contains(path, edge)),
p3 AS (SELECT sl, sk, b.zl, b.zk, path || [edge] AS path, hit OR b.zl = 'Gene' AS hit FROM p2 JOIN b ON p2.zl = al AND p2.zk = ak WHERE NOT list_contains(path, edge))"""


@query("neighborhood_khop", f"WITH {EDGES}, {MERGED}, {_PATHS} SELECT sl || ':' || sk AS start, zl || ':' || zk AS \"end\", CAST(len(path) AS INTEGER) AS hops, array_to_string(x.path, '>') AS path FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) AS x WHERE hit ORDER BY len(x.path), sl, sk, x.path LIMIT {_LIMIT}")
def _(spark, sf):
    """Paths of up to three edges from nodes whose key holds 171, with a gene on them, the first twenty thousand."""
    paths = P.Paths(merged(spark, sf), min_tier=2, labels=("Gene",))
    found = paths.of(paths.starts("171"), 3, _LIMIT)
    name = lambda c: F.concat_ws(":", f"{c}.label", f"{c}.key").alias(c)
    return found.select(name("start"), name("end"), "hops", F.array_join(F.transform("path", lambda e: e.cast("string")), ">").alias("path"))


@query("node_summary", f"{_M}, x AS (SELECT head_label AS label, head_key AS key, relation, tail_label AS other_label, tail_key AS other_key, false AS reverse, evidence_tier, citations FROM m UNION ALL SELECT tail_label, tail_key, relation, head_label, head_key, true, evidence_tier, citations FROM m), y AS (SELECT *, CAST(row_number() OVER (PARTITION BY label, key ORDER BY evidence_tier DESC, citations DESC, relation, other_label, other_key, reverse) AS INTEGER) AS rank FROM x) SELECT * FROM y WHERE rank <= 5")
def _(spark, sf):
    return G.node_summary(merged(spark, sf), 5)


_INSPECT = f"""{_M}, v AS (SELECT head_label AS label, head_key AS key FROM m UNION SELECT tail_label, tail_key FROM m),
i AS (SELECT 'nodes' AS metric, 'all' AS key, count(*) AS n FROM v UNION ALL SELECT 'edges', 'all', count(*) FROM m UNION ALL SELECT 'label', label, count(*) FROM v GROUP BY label UNION ALL SELECT 'relation', relation, count(*) FROM m GROUP BY relation UNION ALL SELECT 'tier', evidence_tier::VARCHAR, count(*) FROM m GROUP BY evidence_tier)"""


@query("graph_inspection", f"{_INSPECT} SELECT * FROM i")
def inspect(spark, sf):
    m = merged(spark, sf)
    return G.inspection(G.nodes_of(m), m)


_DIM = ", ".join(f"({q(a)}, {q(b)})" for a, b in [("label", x) for x in rules.NODE_LABELS] + [("relation", x) for x in rules.RELATION_TYPES] + [("tier", str(i)) for i, _ in rules.TIERS])


@query("graph_facets", f"{_INSPECT} SELECT f.metric, f.key, coalesce(n, 0) AS n FROM (VALUES {_DIM}) AS f(metric, key) LEFT JOIN i USING (metric, key)")
def _(spark, sf):
    return G.facets(inspect(spark, sf))


_NEEDLES = ("1-URG", "987", "gene", "f", "5-l", "-", "Drug:12", "no such text")
_TEXTS = f"{EDGES}, {NODES}, pa AS (SELECT o_orderkey::VARCHAR AS record_id, o_orderpriority AS title, o_orderstatus AS abstract FROM orders)"
_CONTAINS = lambda columns, x: " OR ".join(f"contains(lower({c}), lower({q(x)}))" for c in columns)


def _papers(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("record_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("abstract"))


def _searched(index, *columns):
    return functools.reduce(DataFrame.unionByName, [S.search(index, x).groupBy(*columns).agg(F.count("*").alias("n")).withColumn("needle", F.lit(x)) for x in _NEEDLES])


@query("graph_text_search", f"WITH {_TEXTS}, t AS (SELECT e.*, title FROM e LEFT JOIN pa USING (record_id)) " + " UNION ALL ".join(f"SELECT relation, title, count(*) AS n, {q(x)} AS needle FROM t WHERE {_CONTAINS(('source_id', 'title', 'head_key', 'tail_key', 'head_label', 'tail_label', 'relation'), x)} GROUP BY ALL" for x in _NEEDLES))
def _(spark, sf):
    """How many relations hold each text in one of their columns, by relation and title."""
    rows = G.relation_texts(edges(spark, sf), _papers(spark, sf)).drop("properties").withColumn("sentence", F.lit(None).cast("string"))
    return _searched(S.build(rows, G.RELATION_TEXTS), "relation", "title")


@query("mention_text_search", f"WITH {_TEXTS}, t AS (SELECT n.record_id, label, key, n.record_id AS source_id, title, abstract FROM n LEFT JOIN pa USING (record_id)) " + " UNION ALL ".join(f"SELECT label, abstract, count(*) AS n, {q(x)} AS needle FROM t WHERE {_CONTAINS(('source_id', 'title', 'abstract', 'key', 'label'), x)} GROUP BY ALL" for x in _NEEDLES))
def _(spark, sf):
    rows = G.mention_texts(nodes(spark, sf), _papers(spark, sf)).drop("properties", "ord")
    return _searched(S.build(rows, G.MENTION_TEXTS), "label", "abstract")


@query("recent_records", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY day DESC, o_orderkey::VARCHAR DESC LIMIT 20")
def _(spark, sf):
    records = table(spark, sf, "orders").select(F.col("o_orderkey").alias("record_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("publication_date"))
    return G.recent_records(records, 20).select(F.col("record_id").alias("o_orderkey"), F.col("publication_date").alias("day"))


def overlaid(spark, sf):
    from graphloom.plans.q_review import curated

    return R.evidence_overlay(edges(spark, sf), curated(spark, sf))


@query("overlay_filter", f"WITH {OVERLAY} SELECT record_id, relation_index FROM o WHERE hit")
def _(spark, sf):
    return G.overlay_filter(overlaid(spark, sf), changed_only=True).select("record_id", "relation_index")


@query("overlay_metadata", f"WITH {OVERLAY} SELECT record_id, relation_index, evidence_tier::VARCHAR AS original_tier, new_tier::VARCHAR AS tier, new_status AS review_status, true AS tier_changed FROM o WHERE hit")
def _(spark, sf):
    return G.overlay_filter(overlaid(spark, sf)).select("record_id", "relation_index", G.overlay_metadata(F.col("properties")).alias("x")).select("record_id", "relation_index", "x.*")


@query("curation_links", f"{_E} SELECT record_id, relation_index, 'https://example.org/' || record_id || ' relation:' || record_id || ':' || relation_index::VARCHAR AS links FROM e")
def _(spark, sf):
    item = F.concat_ws(":", F.lit("relation"), "record_id", F.col("relation_index").cast("string"))
    links = F.array_append(F.transform(F.array("source_id"), lambda s: F.concat(F.lit("https://example.org/"), s)), item)
    return edges(spark, sf).select("record_id", "relation_index", F.array_join(links, " ").alias("links"))


def _mentions(spark, sf):
    return E.lexicon_ner(papers(spark, sf), LEXICON)


_ENTITY_NODES = f"""{_MENTIONS}, en AS (SELECT pmid, label, lower(text) AS folded, arg_min(text, row(start, "end")) AS key, array_to_string(list_sort(list_distinct(list(text))), ';') AS aliases, count(*) AS mentions FROM (SELECT pmid, {_NODE} AS label, text, start, "end" FROM n) GROUP BY ALL)"""


@query("entities_to_nodes", f"WITH {_ENTITY_NODES} SELECT pmid, label, key, aliases, mentions FROM en")
def _(spark, sf):
    return G.entities_to_nodes(_mentions(spark, sf)).withColumn("aliases", F.array_join("aliases", ";"))


@query("build_graph_records", f"WITH {_ENTITY_NODES}, en2 AS (SELECT pmid, count(*) AS nodes FROM en GROUP BY pmid) SELECT doc_id::VARCHAR AS pmid, coalesce(nodes, 0) AS nodes, 0::BIGINT AS relations, coalesce(quality, 0) AS evidence_tier FROM documents LEFT JOIN en2 ON en2.pmid = doc_id::VARCHAR LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)")
def _(spark, sf):
    claims = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("pmid"), F.col("quality").alias("tier"), F.col("quality").alias("ord"))
    none = spark.createDataFrame([], "pmid string")
    return G.build_records(papers(spark, sf), _mentions(spark, sf), none, claims)


@query("annotate_query_provenance", "SELECT c_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ';') AS matched_queries, 'pack' AS query_pack FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _(spark, sf):
    hits = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("query"), F.col("o_custkey").alias("pmid"))
    out = G.annotate_query_provenance(table(spark, sf, "customer").select(F.col("c_custkey").alias("pmid")), hits, "pack")
    return out.select(F.col("pmid").alias("c_custkey"), F.array_join("matched_queries", ";").alias("matched_queries"), "query_pack")


@query("unique_first", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def _(spark, sf):
    return G.unique_first(table(spark, sf, "orders"), "o_custkey", "o_orderkey")


@query("query_pack_corpus", "SELECT c_custkey, c_name, min(o_orderkey) AS first_hit, count(DISTINCT o_orderpriority) AS queries FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    first = G.unique_first(orders, "o_custkey", "o_orderkey").select(F.col("o_custkey").alias("pmid"), F.col("o_orderkey").alias("first_hit"))
    found = G.annotate_query_provenance(first, orders.select(F.col("o_custkey").alias("pmid"), F.col("o_orderpriority").alias("query")), "pack")
    return found.join(table(spark, sf, "customer"), F.col("pmid") == F.col("c_custkey")).select("c_custkey", "c_name", "first_hit", F.size("matched_queries").cast("long").alias("queries"))


_SYN = [("gene", f"nation {i}", f"N{i}", f"Nation number {i}") for i in range(0, 25, 2)]


@query("normalize_graph_entities", f"SELECT n_nationkey, canonical_id, canonical_name FROM nation LEFT JOIN (VALUES {', '.join(f'({q(t)}, {q(i)}, {q(c)})' for _, t, i, c in _SYN)}) AS v(t, canonical_id, canonical_name) ON replace(lower(n_name), '_', ' ') = t")
def _(spark, sf):
    synonyms = spark.createDataFrame(_SYN, "label_key string, text_key string, canonical_id string, canonical_name string")
    named = table(spark, sf, "nation").select("n_nationkey", F.lit("GENE").alias("label"), F.col("n_name").alias("key"))
    return G.normalize_entities(named, synonyms).select("n_nationkey", "canonical_id", "canonical_name")


@query("build_trial_graph", "SELECT 'NCT' || p_partkey::VARCHAR AS head_key, label AS tail_label, w AS tail_key, field AS registry_field FROM (SELECT DISTINCT p_partkey, 'Disease' AS label, 'conditions' AS field, unnest(string_split(p_name, ' ')) AS w FROM part UNION SELECT DISTINCT p_partkey, 'Treatment', 'interventions', unnest([p_type, p_brand]) FROM part)")
def _(spark, sf):
    trials = table(spark, sf, "part").select(F.concat(F.lit("NCT"), F.col("p_partkey").cast("string")).alias("nct_id"), F.split("p_name", " ").alias("conditions"), F.array("p_type", "p_brand").alias("interventions"))
    return G.build_trial_graph(trials).select("head_key", "tail_label", "tail_key", "registry_field")


@query("literature_pipeline", f"WITH {_RELATIONS} SELECT head_label, head_key, relation, tail_label, tail_key, count(DISTINCT pmid) AS citations, 0 AS evidence_tier, max(confidence) AS confidence, arg_min(pmid, row(pmid, relation_index)) AS created_from FROM r GROUP BY ALL")
def _(spark, sf):
    """Papers to a merged graph: mentions and tiers, relations, then one edge a pair."""
    docs = papers(spark, sf)
    mentions = E.lexicon_ner(docs, LEXICON)
    relations = E.extract_relations(docs, mentions, E.classify_evidence(docs), table=RULES).withColumn("record_id", F.col("pmid")).withColumn("source_id", F.col("pmid"))
    return G.merge_edges(relations)


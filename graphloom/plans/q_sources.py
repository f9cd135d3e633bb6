"""Queries of readers and writers: tables go out and come back; files are those of the table folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.plans.base import EDGES, edges
from graphloom.plans.common import table
from graphloom.plans.q_review import queue
from graphloom.sources import files as FI
from graphloom.sources import records as S
from graphloom.sources.tables import shared_dir

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def papers(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("pmid"), F.lit("t").alias("title"), F.col("text").alias("abstract"), F.col("source").alias("journal"))


_PAPERS = "SELECT doc_id::VARCHAR AS pmid, text AS abstract, source AS journal FROM documents"


@query("scan_papers", _PAPERS)
def _(spark, sf):
    path = place(spark, "papers")
    S.write_json(papers(spark, sf), path)
    return S.read_json(spark, path, S.PAPER).select("pmid", "abstract", "journal")


@query("sink_papers", "SELECT count(*) AS n, sum(length(text)) AS characters FROM documents")
def _(spark, sf):
    path = place(spark, "papers")
    S.write_json(papers(spark, sf), path)
    return S.read_json(spark, path, S.PAPER).agg(F.count("*").alias("n"), F.sum(F.length("abstract")).alias("characters"))


@query("multi_batch_union", _PAPERS)
def _(spark, sf):
    paths = [place(spark, "batch") for _ in range(2)]
    for i, path in enumerate(paths):
        S.write_json(papers(spark, sf).where(F.col("pmid").cast("long") % 2 == i), path)
    return S.read_json(spark, paths, S.PAPER).select("pmid", "abstract", "journal")


@query("scan_sink_entities", "SELECT conv_id::VARCHAR AS pmid, role AS text, CAST(turn AS INTEGER) AS start FROM conversations")
def _(spark, sf):
    path = place(spark, "entities")
    m = F.struct(F.col("role").alias("text"), F.lit("GENE").alias("label"), F.col("turn").cast("int").alias("start"), (F.col("turn") + 4).cast("int").alias("end"), F.lit(0.5).alias("confidence"), F.col("role").alias("normalized_text"))
    S.write_json(table(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("pmid")).agg(F.collect_list(m).alias("entities")), path)
    return S.read_mentions(spark, path).select("pmid", "text", "start")


@query("scan_sink_claims", "SELECT doc_id::VARCHAR AS source_pmid, quality AS evidence_level FROM labels")
def _(spark, sf):
    path = place(spark, "claims")
    S.write_json(table(spark, sf, "labels").select(F.lit("c").alias("claim"), F.col("doc_id").cast("string").alias("source_pmid"), F.col("quality").alias("evidence_level")), path)
    return S.read_json(spark, path, S.CLAIM).select("source_pmid", "evidence_level")


def _records(spark, sf, path):
    node = lambda s: F.struct(F.col(f"{s}_label").alias("label"), F.col(f"{s}_key").alias("key_value"))
    e = edges(spark, sf)
    r = F.struct("relation_index", node("head").alias("head"), "relation", node("tail").alias("tail"), F.col("source_id").alias("source_pmid"), "evidence_tier", "confidence", "properties")
    trial = F.col("record_id").cast("long") % 2 == 0
    rows = e.groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("relation_index", r.alias("r"))), lambda a, b: a["relation_index"] - b["relation_index"]), lambda x: x["r"]).alias("relations"))
    rows.select(F.when(~trial, F.col("record_id")).alias("pmid"), F.when(trial, F.concat(F.lit("NCT"), "record_id")).alias("nct_id"), "relations").write.json(path)
    return path


_RANK = "CAST(row_number() OVER (PARTITION BY record_id ORDER BY relation_index) AS INTEGER)"


@query("scan_graph_records", f"WITH {EDGES} SELECT CASE WHEN record_id::BIGINT % 2 = 0 THEN 'NCT' ELSE '' END || record_id AS record_id, {_RANK} AS relation_index, head_key, relation, tail_key, evidence_tier, confidence FROM e")
def _(spark, sf):
    e, _ = S.read_graph(spark, _records(spark, sf, place(spark, "graph")))
    return e.select("record_id", "relation_index", "head_key", "relation", "tail_key", "evidence_tier", "confidence")


@query("scan_mixed_graph", f"WITH {EDGES} SELECT CASE WHEN record_id::BIGINT % 2 = 0 THEN 'trial' ELSE 'pubmed' END AS record_type, count(*) AS n FROM e GROUP BY ALL")
def _(spark, sf):
    e, _ = S.read_graph(spark, _records(spark, sf, place(spark, "graph")))
    return e.groupBy("record_type").agg(F.count("*").alias("n"))


@query("sink_graph_records", f"WITH {EDGES} SELECT record_id, count(*) AS n, max(evidence_tier) AS top FROM e GROUP BY record_id")
def _(spark, sf):
    path = place(spark, "graph")
    G.nest_records(edges(spark, sf)).write.json(path)
    back = spark.read.schema(G.nest_records(edges(spark, sf)).schema).json(path)
    return G.unnest_records(back).groupBy("record_id").agg(F.count("*").alias("n"), F.max("evidence_tier").alias("top"))


@query("detect_record_type", "SELECT 'pubmed' AS papers, 'trial' AS trials, count(*) AS n FROM documents")
def _(spark, sf):
    a, b = place(spark, "a"), place(spark, "b")
    S.write_json(papers(spark, sf), a)
    S.write_json(papers(spark, sf).select(F.col("pmid").alias("nct_id")), b)
    return table(spark, sf, "documents").agg(F.lit(S.record_type(spark, a)).alias("papers"), F.lit(S.record_type(spark, b)).alias("trials"), F.count("*").alias("n"))


_LINES = """l AS (SELECT event_id // 1000 AS part, event_id % 10 AS k, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) AS line FROM events)"""


def event_lines(spark, sf):
    """A file for every thousand events: some lines are blank, no JSON, of another type, without their id or with a wrong one."""
    k, id_ = F.col("event_id") % 10, F.col("event_id").cast("string")
    good = lambda *c: F.to_json(F.struct(*c))
    line = (
        F.when(k == 0, '{"k": ').when(k == 3, "").when(k == 5, good(id_.alias("pmid"), F.lit("many").alias("n"))).when(k == 7, good(F.lit(1).alias("n")))
        .when(k == 8, good(F.concat(F.lit("x"), id_).alias("pmid"), F.lit(1).alias("n"))).otherwise(good(id_.alias("pmid"), F.lit(1).alias("n")))
    )
    path = place(spark, "events")
    rows = table(spark, sf, "events").select(F.floor(F.col("event_id") / 1000).alias("part"), "event_id", line.alias("value"))
    rows.repartition("part").sortWithinPartitions("part", "event_id").select("value", "part").write.partitionBy("part").text(path)
    return S.read_json_permissive(spark, path, "pmid string, n int", required=("pmid",), checks={"pmid: digits only": "not pmid rlike '^[0-9]+$'"})


@query("scan_permissive", f"WITH {_LINES} SELECT part, line, CASE k WHEN 0 THEN 'json' ELSE 'schema' END AS kind, CASE k WHEN 0 THEN 'invalid JSON' WHEN 5 THEN 'n: expected int' WHEN 7 THEN 'pmid: field required' ELSE 'pmid: digits only' END AS message FROM l WHERE k IN (0, 5, 7, 8)")
def _(spark, sf):
    part = F.regexp_extract("file", "/part=([0-9]+)/", 1).cast("long")
    return event_lines(spark, sf)[1].select(part.alias("part"), "line", "kind", "message")


@query("scan_permissive_rows", "SELECT event_id::VARCHAR AS pmid, 1 AS n FROM events WHERE event_id % 10 NOT IN (0, 3, 5, 7, 8)")
def _(spark, sf):
    return event_lines(spark, sf)[0]


@query("scan_sink_trials", "SELECT 'NCT' || p_partkey::VARCHAR AS nct_id, p_name AS brief_title, p_size AS enrollment_count FROM part")
def _(spark, sf):
    path = place(spark, "trials")
    S.write_json(table(spark, sf, "part").select(F.concat(F.lit("NCT"), F.col("p_partkey").cast("string")).alias("nct_id"), F.col("p_name").alias("brief_title"), F.col("p_size").alias("enrollment_count")), path)
    return S.read_json(spark, path, S.TRIAL).select("nct_id", "brief_title", "enrollment_count")


@query("parse_article_xml", "SELECT doc_id::VARCHAR AS pmid, source || ' & ' || lang || ' <x>' AS title, lang || ' x2 (' || n_chars::VARCHAR || ')' || CASE WHEN doc_id % 2 = 0 THEN ' and ' || source ELSE '' END AS abstract, '2024-Jan' AS publication_date, lang || ';' || source AS mesh_terms FROM documents")
def _(spark, sf):
    """Documents as article files with nested markup, attributes, comments and CDATA sections, read split at the articles."""
    c = F.col
    parts = [
        "<PubmedArticle><MedlineCitation Owner='a>b'><PMID Version='1'>", c("doc_id").cast("string"), "</PMID><!-- <PMID>0</PMID> --><Article><ArticleTitle>", "source", " &amp; <i>", "lang",
        "</i> <![CDATA[<x>]]></ArticleTitle>\n<Abstract><AbstractText Label='A'>", "lang", " <x:math xmlns:x='u'>x<sup>2</sup></x:math> &#40;<b><e>", c("n_chars").cast("string"), "</e></b>)</AbstractText><AbstractText>",
        F.when(c("doc_id") % 2 == 0, F.concat(F.lit("and <u>"), "source", F.lit("</u>"))).otherwise(F.lit("")),
        "</AbstractText></Abstract><Journal><JournalIssue><PubDate><Year>2024</Year><Month>Jan</Month></PubDate></JournalIssue></Journal></Article><MeshHeadingList><MeshHeading><DescriptorName>", "lang",
        "</DescriptorName></MeshHeading><MeshHeading><DescriptorName UI='1'><i>", "source", "</i></DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle>",
    ]
    path = place(spark, "articles")
    xml = F.concat(*(p if not isinstance(p, str) else c(p) if p in ("lang", "source") else F.lit(p) for p in parts))
    table(spark, sf, "documents").select(xml.alias("value")).write.text(path)
    found = S.parse_articles(S.read_elements(spark, path, "PubmedArticle"))
    return found.select("pmid", "title", "abstract", "publication_date", F.array_join("mesh_terms", ";").alias("mesh_terms"))


@query("flatten_trial_json", "SELECT 'NCT' || p_partkey::VARCHAR AS nct_id, p_name AS brief_title, p_type || ';' || p_brand AS interventions, p_size AS enrollment_count FROM part")
def _(spark, sf):
    c = F.col
    name = lambda x: F.struct(x.alias("name"))
    body = F.struct(F.struct(F.struct(F.concat(F.lit("NCT"), c("p_partkey").cast("string")).alias("nctId"), c("p_name").alias("briefTitle")).alias("identificationModule"), F.struct(F.struct(c("p_size").alias("count")).alias("enrollmentInfo")).alias("designModule"), F.struct(F.array(name(c("p_type")), name(F.lit("")), name(c("p_brand"))).alias("interventions")).alias("armsInterventionsModule")).alias("protocolSection"))
    out = S.flatten_studies(table(spark, sf, "part").select(F.to_json(body).alias("json")))
    return out.select("nct_id", "brief_title", F.array_join("interventions", ";").alias("interventions"), "enrollment_count")


_ITEMS = f"WITH {EDGES} SELECT 'relation:' || record_id || ':' || relation_index::VARCHAR AS item_id, evidence_tier, confidence FROM e WHERE confidence <= 0.65 OR evidence_tier = 0"


@query("sink_review_queue", _ITEMS)
def _(spark, sf):
    path = place(spark, "queue")
    rows = queue(spark, sf).where("item_type = 'graph_relation'")
    S.write_queue_csv(rows, path)
    return S.read_review_csv(spark, path, rows.columns).select("item_id", "evidence_tier", "confidence")


@query("import_review_csv", f"WITH {EDGES} SELECT 'relation:' || record_id || ':' || relation_index::VARCHAR AS item_id, CAST((confidence <= 0.65)::INT + (evidence_tier = 0)::INT AS INTEGER) AS reasons FROM e WHERE confidence <= 0.65 OR evidence_tier = 0")
def _(spark, sf):
    path = place(spark, "queue")
    rows = queue(spark, sf).where("item_type = 'graph_relation'")
    S.write_queue_csv(rows, path)
    return S.read_review_csv(spark, path, rows.columns).select("item_id", F.size("reasons").alias("reasons"))


def _splits(spark, sf, path):
    rows = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("quality") == 0, "evidence").otherwise("ner").alias("task"), F.when(F.col("toxic") == 0, "train").otherwise("test").alias("split"))
    S.write_json(rows, path, by=("task", "split"))
    return spark.read.schema("id string, task string, split string").json(path)


_SPLITS = "s AS (SELECT doc_id::VARCHAR AS id, CASE WHEN quality = 0 THEN 'evidence' ELSE 'ner' END AS task, CASE WHEN toxic = 0 THEN 'train' ELSE 'test' END AS split FROM labels)"


@query("sink_training_splits", f"WITH {_SPLITS} SELECT * FROM s")
def _(spark, sf):
    return _splits(spark, sf, place(spark, "splits"))


@query("scan_training_rows", f"WITH {_SPLITS} SELECT id FROM s WHERE task = 'ner' AND split = 'train'")
def _(spark, sf):
    return _splits(spark, sf, place(spark, "splits")).where("task = 'ner' and split = 'train'").select("id")


def _one_json(spark, df, name):
    path = place(spark, name)
    df.coalesce(1).write.text(path)
    return path


@query("load_lexicon_dim", "SELECT n_name AS term, 'GENE' AS label FROM nation")
def _(spark, sf):
    body = table(spark, sf, "nation").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("n_name").alias("term"), F.lit("GENE").alias("label"))).alias("entries"))).alias("value"))
    return S.lexicon_table(spark, _one_json(spark, body, "lexicon"))


@query("load_synonym_dim", "SELECT 'gene' AS label_key, t AS text_key, 'N' || n_nationkey::VARCHAR AS canonical_id FROM (SELECT n_nationkey, unnest([replace(lower(n_name), '_', ' '), 'n' || n_nationkey::VARCHAR, 'alias ' || n_nationkey::VARCHAR]) AS t FROM nation)")
def _(spark, sf):
    n = F.col("n_nationkey").cast("string")
    entry = F.struct(F.concat(F.lit("N"), n).alias("canonical_id"), F.col("n_name").alias("canonical_name"), F.array(F.lit("Gene")).alias("labels"), F.array(F.concat(F.lit("Alias-"), n)).alias("synonyms"))
    body = table(spark, sf, "nation").agg(F.to_json(F.struct(F.collect_list(entry).alias("entities"))).alias("value"))
    return S.synonym_table(spark, _one_json(spark, body, "synonyms")).select("label_key", "text_key", "canonical_id")


@query("load_query_packs", "SELECT 'pack' AS name, r_name AS query FROM region")
def _(spark, sf):
    body = table(spark, sf, "region").agg(F.to_json(F.struct(F.lit("pack").alias("name"), F.concat(F.collect_list("r_name"), F.array(F.lit(" "))).alias("queries"))).alias("value"))
    return S.query_packs(spark, _one_json(spark, body, "packs"))


@query("corpus_manifest", """SELECT count(*) AS lines, CAST(sum(length('{"pmid":"' || doc_id::VARCHAR || '"}') + 1) AS BIGINT) AS bytes, true AS hashed FROM documents""")
def _(spark, sf):
    """The manifest's sums: how the writer splits the files is not fixed, what they hold together is."""
    path = place(spark, "lines")
    papers(spark, sf).select("pmid").write.json(path)
    m = FI.corpus_manifest(spark, path)
    return m.agg(F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"), F.bool_and(F.col("sha256").rlike("^[0-9A-F]{64}$")).alias("hashed"))


@query("round_discovery", "SELECT CAST(n_nationkey AS INTEGER) AS round FROM nation WHERE n_nationkey % 2 = 0")
def _(spark, sf):
    kinds = F.when(F.col("n_nationkey") % 2 == 0, F.array(*map(F.lit, ("evidence", "entities", "queue")))).otherwise(F.array(F.lit("evidence")))
    names = table(spark, sf, "nation").select("n_nationkey", F.explode(kinds).alias("kind")).select(F.concat("kind", F.lit("_round"), F.col("n_nationkey").cast("string"), F.lit(".jsonl")).alias("name"))
    return FI.rounds(names)

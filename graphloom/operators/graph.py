"""A labelled property graph in tables.

edges: record_id, relation_index, head_label, head_key, relation, tail_label, tail_key, source_id, evidence_tier,
confidence, properties (map). nodes: record_id, label, key, ord, properties (map).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import rules
from graphloom.functions.text import casefold
from graphloom.operators.extract import node_label

ENDS = ("head_label", "head_key", "relation", "tail_label", "tail_key")
_MAP = "map<string,string>"


def allowed_edges(spark: SparkSession) -> DataFrame:
    """The topology (a few dozen rows): relation, head_label, tail_label."""
    return spark.createDataFrame([(r, h, t) for r, pairs in rules.ALLOWED_EDGES.items() for h, t in pairs], "relation string, head_label string, tail_label string")


def entities_to_nodes(mentions: DataFrame) -> DataFrame:
    """Distinct nodes of a paper: first spelling of the key, sorted aliases, number of mentions."""
    m = mentions.withColumn("node", node_label("label")).where("node is not null")
    order = F.struct("start", "end")
    return m.groupBy("pmid", F.col("node").alias("label"), casefold("normalized_text").alias("folded")).agg(F.min_by("normalized_text", order).alias("key"), F.array_sort(F.collect_set("text")).alias("aliases"), F.count("*").alias("mentions")).drop("folded")


def build_records(papers: DataFrame, entities: DataFrame, relations: DataFrame, claims: DataFrame) -> DataFrame:
    """One row a paper: its tier (0 without a claim) and how many nodes and relations it has; entity rows without a
    paper are dropped, papers without entities stay. Each input is reduced to one row a paper before it is joined."""
    nodes = entities_to_nodes(entities).groupBy("pmid").agg(F.count("*").alias("nodes"))
    edges = relations.groupBy("pmid").agg(F.count("*").alias("relations"))
    tiers = claims.groupBy("pmid").agg(F.max_by("tier", "ord").alias("evidence_tier"))
    out = papers.select("pmid").join(nodes, "pmid", "left").join(edges, "pmid", "left").join(tiers, "pmid", "left")
    return out.fillna(0, ["nodes", "relations", "evidence_tier"])


def annotate_query_provenance(papers: DataFrame, hits: DataFrame, pack: str) -> DataFrame:
    """hits: query, pmid. Adds query_pack and the sorted distinct queries of each paper (empty if none)."""
    queries = hits.groupBy("pmid").agg(F.array_sort(F.collect_set("query")).alias("matched_queries"))
    out = papers.join(queries, "pmid", "left").withColumn("query_pack", F.lit(pack))
    return out.withColumn("matched_queries", F.coalesce("matched_queries", F.array().cast("array<string>")))


def unique_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Each key once, at its first place."""
    return rows.groupBy(key).agg(F.min(order).alias(order))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One node per (label, key): of every property the latest value (by ord)."""
    values = nodes.select("label", "key", "ord", F.explode_outer("properties").alias("name", "value"))
    last = values.groupBy("label", "key", "name").agg(F.max_by("value", "ord").alias("value"))
    entries = F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "value")))
    return last.groupBy("label", "key").agg(F.map_from_entries(F.array_sort(entries)).alias("properties"))


def merge_mentions(nodes: DataFrame) -> DataFrame:
    """MENTIONS edges paper -> node with tier 0: label, key, source_id."""
    return nodes.select(F.col("record_id").alias("source_id"), "label", "key").distinct().withColumn("evidence_tier", F.lit(0))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge per (head, relation, tail): how many sources, largest tier and confidence, the first source. edge_sources() has
    the sources themselves, a row each."""
    return edges.groupBy(*ENDS).agg(
        F.count_distinct("source_id").alias("citations"),
        F.max("evidence_tier").alias("evidence_tier"),
        F.max("confidence").alias("confidence"),
        F.min_by("source_id", F.struct("record_id", "relation_index")).alias("created_from"),
    )


def edge_sources(edges: DataFrame, most: int | None = None) -> DataFrame:
    """The distinct sources of every merged edge, a row each; with `most` the first of them by their hash."""
    found = edges.select(*ENDS, "source_id").distinct()
    if most is None:
        return found
    rank = F.row_number().over(Window.partitionBy(*ENDS).orderBy(F.xxhash64("source_id"), "source_id"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def has_evidence_edges(edges: DataFrame) -> DataFrame:
    """tail node -> evidence level, for every level its relations had."""
    levels = F.element_at(F.create_map(*[F.lit(x) for k, v in rules.TIERS for x in (k, v)]), F.col("evidence_tier"))
    return edges.select("tail_label", "tail_key", "evidence_tier").distinct().withColumn("level", levels)


def load_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    records = edges.select("record_id").unionByName(nodes.select("record_id"))
    parts = [
        records.agg(F.lit("records").alias("metric"), F.count_distinct("record_id").alias("n")),
        nodes.agg(F.lit("node_merges").alias("metric"), F.count("*").alias("n")),
        edges.agg(F.lit("relation_merges").alias("metric"), F.count("*").alias("n")),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


#: Where a search looks: a relation's texts and a mention's, beside the ends.
RELATION_TEXTS = ("source_id", "title", "head_key", "tail_key", "head_label", "tail_label", "relation", "sentence", "source_url")
MENTION_TEXTS = ("source_id", "title", "abstract", "key", "label", "display_name", "aliases")


def relation_texts(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """Edges with their paper's title and their sentence and address, as columns; papers: record_id, title."""
    prop = lambda k: F.try_element_at("properties", F.lit(k)).alias(k)
    return edges.select("*", prop("sentence"), prop("source_url")).join(papers.select("record_id", "title"), "record_id", "left")


def mention_texts(nodes: DataFrame, papers: DataFrame) -> DataFrame:
    """Node mentions with their paper's title and abstract, display name and aliases; papers: record_id, title, abstract."""
    prop = lambda k: F.try_element_at("properties", F.lit(k)).alias(k)
    return nodes.select("*", F.col("record_id").alias("source_id"), prop("display_name"), prop("aliases")).join(papers.select("record_id", "title", "abstract"), "record_id", "left")


def search_edges(edges: DataFrame, text: str, columns: tuple[str, ...] = ENDS) -> DataFrame:
    """Edges with the text, of any case, in one of the columns, by reading them all; operators.search has an index."""
    return edges.where(functools.reduce(lambda a, b: a | b, [F.contains(casefold(F.coalesce(F.col(c), F.lit(""))), F.lit(text.casefold())) for c in columns]))


def neighborhood(edges: DataFrame, search: str | None = None, labels: tuple[str, ...] = (), relations: tuple[str, ...] = (), min_tier: int = 0, min_citations: int = 1, limit: int | None = None) -> DataFrame:
    """Filtered merged edges; nodes are nodes_of() of them. With a limit, the strongest first."""
    out = edges.where((F.col("evidence_tier") >= min_tier) & (F.col("citations") >= min_citations))
    if labels:
        out = out.where(F.col("head_label").isin(*labels) | F.col("tail_label").isin(*labels))
    if relations:
        out = out.where(F.col("relation").isin(*relations))
    if search:
        out = search_edges(out, search)
    return out if limit is None else out.orderBy(F.desc("evidence_tier"), F.desc("citations"), *ENDS).limit(limit)


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("head_label").alias("label"), F.col("head_key").alias("key")).unionByName(edges.select(F.col("tail_label").alias("label"), F.col("tail_key").alias("key"))).distinct()


def node_summary(edges: DataFrame, k: int = 25) -> DataFrame:
    """Of every node its k strongest relations, in both directions."""
    mine = lambda a, b, back: edges.select(F.col(f"{a}_label").alias("label"), F.col(f"{a}_key").alias("key"), "relation", F.col(f"{b}_label").alias("other_label"), F.col(f"{b}_key").alias("other_key"), F.lit(back).alias("reverse"), "evidence_tier", "citations")
    both = mine("head", "tail", False).unionByName(mine("tail", "head", True))
    rank = F.row_number().over(Window.partitionBy("label", "key").orderBy(F.desc("evidence_tier"), F.desc("citations"), "relation", "other_label", "other_key", "reverse"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def inspection(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """metric, key, n: totals and counts by label, relation and tier."""
    count = lambda df, metric, key: df.groupBy(F.lit(metric).alias("metric"), key.cast("string").alias("key")).agg(F.count("*").alias("n"))
    parts = [count(nodes, "nodes", F.lit("all")), count(edges, "edges", F.lit("all")), count(nodes, "label", F.col("label")), count(edges, "relation", F.col("relation")), count(edges, "tier", F.col("evidence_tier"))]
    return functools.reduce(DataFrame.unionByName, parts)


def facets(counts: DataFrame) -> DataFrame:
    """All labels, relations and tiers of the schema with their counts, zeros included."""
    spark = counts.sparkSession
    dim = [("label", x) for x in rules.NODE_LABELS] + [("relation", x) for x in rules.RELATION_TYPES] + [("tier", str(i)) for i, _ in rules.TIERS]
    return spark.createDataFrame(dim, "metric string, key string").join(counts, ["metric", "key"], "left").fillna(0, ["n"])


def overlay_filter(edges: DataFrame, changed_only: bool = False) -> DataFrame:
    """Edges with an overlay; with changed_only those whose tier it changed."""
    p = F.col("properties")
    out = edges.where(F.map_contains_key(p, "evidence_overlay_tier"))
    return out.where(~p["evidence_overlay_original_tier"].eqNullSafe(p["evidence_overlay_tier"])) if changed_only else out


def overlay_metadata(properties: Column) -> Column:
    p = lambda name: F.element_at(properties, f"evidence_overlay_{name}")
    return F.struct(p("original_tier").alias("original_tier"), p("tier").alias("tier"), p("review_status").alias("review_status"), (~p("original_tier").eqNullSafe(p("tier"))).alias("tier_changed"))


def normalize_entities(nodes: DataFrame, synonyms: DataFrame, small: int = 1_000_000) -> DataFrame:
    """nodes (label, key) with canonical_id and canonical_name from synonyms (label_key, text_key, canonical_id,
    canonical_name); the synonym table is broadcast only if it is small."""
    from graphloom.functions.text import match_label, match_text

    found = F.broadcast(synonyms) if synonyms.count() <= small else synonyms
    keyed = nodes.withColumn("label_key", match_label("label")).withColumn("text_key", match_text("key"))
    return keyed.join(found, ["label_key", "text_key"], "left").drop("label_key", "text_key")


def build_trial_graph(trials: DataFrame) -> DataFrame:
    """Edges of trials (nct_id, conditions, interventions): Trial ASSOCIATED_WITH Disease and Treatment."""
    trial = F.col("nct_id")
    part = lambda column, label, field: trials.select(trial.alias("record_id"), F.posexplode(column).alias("i", "key")).where(F.trim("key") != "").select("record_id", F.lit("Trial").alias("head_label"), F.col("record_id").alias("head_key"), F.lit("ASSOCIATED_WITH").alias("relation"), F.lit(label).alias("tail_label"), F.trim("key").alias("tail_key"), F.lit(field).alias("registry_field"), F.col("i").alias("i"))
    both = part("conditions", "Disease", "conditions").unionByName(part("interventions", "Treatment", "interventions"))
    return both.groupBy("record_id", *ENDS).agg(F.min("registry_field").alias("registry_field"))


def nest_records(edges: DataFrame) -> DataFrame:
    """Edges back to one row a record, relations in their order."""
    item = F.struct("relation_index", *ENDS, "evidence_tier", "confidence")
    return edges.groupBy("record_id").agg(F.array_sort(F.collect_list(item)).alias("relations"))


def numbered_relations(records: DataFrame, *keys: str, column: str = "relations") -> DataFrame:
    """keys, relation_index (from 1, the place in its record) and r: a row for each relation of the array."""
    return records.select(*keys, F.posexplode(column).alias("i", "r")).select(*keys, (F.col("i") + 1).alias("relation_index"), "r")


def recent_records(records: DataFrame, limit: int = 10) -> DataFrame:
    """The records (record_id, publication_date as text) with the latest dates, of equal ones those with the largest ids as
    text; a record without a date counts as the oldest."""
    return records.orderBy(F.desc(F.coalesce("publication_date", F.lit(""))), F.desc(F.col("record_id").cast("string"))).limit(limit)


def unnest_records(records: DataFrame) -> DataFrame:
    """Records with an array `relations` to edges with a 1-based relation_index."""
    return numbered_relations(records, "record_id").select("record_id", "relation_index", *[F.col(f"r.{c}").alias(c) for c in (*ENDS, "evidence_tier", "confidence")])

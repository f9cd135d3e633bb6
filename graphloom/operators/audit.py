"""Validation and quality reports over papers, mentions and graph edges."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import casefold, said
from graphloom.operators.graph import allowed_edges
from graphloom.sources.tables import written


def paper_is_valid(pmid: Column | str) -> Column:
    c = F.col(pmid) if isinstance(pmid, str) else pmid
    return F.coalesce(c.rlike(r"^\d+$"), F.lit(False))


def span_problems(text: Column, start: Column, end: Column, confidence: Column) -> Column:
    return said(
        (F.coalesce(F.trim(text), F.lit("")) == "", "text is empty"),
        (start.isNull() | (start < 0), "start must not be negative"),
        (end.isNull() | (end < start), "end must not be before start"),
        (confidence.isNull() | ~confidence.between(0.0, 1.0), "confidence must be between 0 and 1"),
    )


def topology(edges: DataFrame) -> DataFrame:
    """Adds `allowed`: whether (relation, head label, tail label) is in the schema; HAS_EVIDENCE is never a user's."""
    rules = F.broadcast(allowed_edges(edges.sparkSession).withColumn("_ok", F.lit(True)))  # a few dozen rows
    out = edges.join(rules, ["relation", "head_label", "tail_label"], "left")
    return out.withColumn("allowed", F.col("_ok").isNotNull() & (F.col("relation") != "HAS_EVIDENCE")).drop("_ok")


def ids_agree(record_id: Column, source_ids: Column) -> Column:
    return F.forall(source_ids, lambda s: s.eqNullSafe(record_id))


def trial_id(value: Column) -> Column:
    """Upper case; null unless it begins with NCT."""
    v = F.upper(F.trim(value))
    return F.when(v.startswith("NCT"), v)


def relation_flags(least: float = 0.55) -> Column:
    p = F.col("properties")
    none = lambda k: F.coalesce(F.element_at(p, k), F.lit("")) == ""
    return said(
        (none("trigger"), "missing trigger"),
        (none("sentence"), "missing source sentence"),
        (none("extraction_method") & none("source"), "missing extraction method"),
        (F.col("confidence") < least, f"confidence < {least}"),
        (F.col("source_id") != F.col("record_id"), "relation source PMID does not match graph record"),
    )


def relation_audit(edges: DataFrame, least: float = 0.55) -> DataFrame:
    """Relations with flags."""
    return edges.withColumn("flags", relation_flags(least)).where(F.size("flags") > 0)


def provenance_issues(edges: DataFrame) -> DataFrame:
    """record_id, relation_index, issue_type."""
    none = lambda k: F.trim(F.coalesce(F.element_at("properties", k), F.lit(""))) == ""
    issues = said(
        (F.col("source_id") != F.col("record_id"), "source_pmid_mismatch"),
        (none("sentence"), "missing_source_sentence"),
        (none("evidence_classification_method"), "missing_evidence_method"),
        (F.col("evidence_tier").isNull(), "missing_evidence_tier"),
    )
    return edges.select("record_id", "relation_index", F.explode(issues).alias("issue_type"))


def quality_warnings(edges: DataFrame, nodes: DataFrame, papers: DataFrame | None = None, invalid: DataFrame | None = None) -> DataFrame:
    """record_id, warning: what a load should be warned of. papers: record_id, title, abstract; invalid: rejected lines with
    line, kind and message."""
    none = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    prop = lambda k: F.try_element_at("properties", F.lit(k))
    each = lambda df, *pairs: df.select("record_id", F.explode(said(*pairs)).alias("warning"))
    parts = [
        each(nodes, (none(prop("display_name")), "node has no display_name")),
        each(
            edges,
            (~F.col("source_id").eqNullSafe(F.col("record_id")), "relation source does not match record"),
            (none(prop("sentence")), "relation has no source sentence"),
            (none(prop("extraction_method")), "relation has no extraction method"),
        ),
    ]
    if papers is not None:
        parts.append(each(papers, (none(F.col("title")), "missing paper title"), (none(F.col("abstract")), "missing paper abstract")))
    if invalid is not None:
        line = F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), "message")
        parts.append(invalid.select(F.lit(None).cast("string").alias("record_id"), line.alias("warning")))
    return functools.reduce(DataFrame.unionByName, parts)


def heavy_hitters(rows: DataFrame, key: Column, k: int, tracked: int = 10_000) -> DataFrame:
    """key, n of the k most frequent keys (of equal ones the smaller), exactly. A mergeable sketch of fixed size names the
    candidates, a second pass counts these alone. A key that the sketch lost has at most rows / (3/4 tracked) rows; only if the
    k-th candidate has no more than that, all keys are counted."""
    keyed = rows.select(key.cast("string").alias("key")).where("key is not null")
    seen = keyed.agg(F.count("*").alias("rows"), F.expr(f"approx_top_k(key, {min(10 * k, tracked)}, {tracked})").alias("top")).first()
    names = [t["item"] for t in seen["top"]]  # at most ten times k
    first = lambda df: df.groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(k)
    if not names:
        return first(keyed)
    counted = written(keyed.where(F.col("key").isin(*names)).groupBy("key").agg(F.count("*").alias("n")))
    top = counted.orderBy(F.desc("n"), "key").limit(k).collect()
    lost = seen["rows"] / (0.75 * tracked)
    sure = seen["rows"] and (len(names) < min(10 * k, tracked) and lost < 1 or len(top) == k and top[-1]["n"] > max(lost, min(t["count"] for t in seen["top"])))
    return counted.orderBy(F.desc("n"), "key").limit(k) if sure else first(keyed)


def graph_quality(edges: DataFrame, nodes: DataFrame, papers: DataFrame | None = None, invalid: DataFrame | None = None, top: int = 10) -> DataFrame:
    """metric, key, n: totals, distinct records and nodes, records with a paper only, rejected lines, counts by label, relation and
    tier, the most frequent entities and relation pairs, and how often each warning stands (quality_warnings() lists them)."""
    if top < 1:
        raise ValueError("top must be at least 1")
    total = lambda df, name, e: df.agg(e.alias("n")).select(F.lit(name).alias("metric"), F.lit("").alias("key"), "n")
    by = lambda df, name, c: df.groupBy(F.col(c).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "key", "n")
    ends = lambda s: F.concat_ws(":", f"{s}_label", f"{s}_key")
    records = edges.select("record_id").unionByName(nodes.select("record_id"))
    parts = [
        total(records if papers is None else papers.select("record_id"), "records", F.count_distinct("record_id")),
        total(edges, "relations", F.count("*")),
        total(nodes, "node_mentions", F.count("*")),
        total(nodes, "unique_nodes", F.count_distinct("label", casefold("key"))),
        by(nodes, "label", "label"),
        by(edges, "relation", "relation"),
        by(edges, "tier", "evidence_tier"),
        heavy_hitters(nodes, F.concat_ws(":", "label", "key"), top).select(F.lit("top_entity").alias("metric"), "key", "n"),
        heavy_hitters(edges, F.concat_ws(" ", ends("head"), F.col("relation"), ends("tail")), top).select(F.lit("top_pair").alias("metric"), "key", "n"),
        by(quality_warnings(edges, nodes, papers), "warning", "warning"),
    ]
    if papers is not None:
        parts.append(total(papers.select("record_id").distinct().join(records, "record_id", "left_anti"), "paper_only", F.count("*")))
    if invalid is not None:
        parts.append(total(invalid, "invalid_records", F.count("*")))
    return functools.reduce(DataFrame.unionByName, parts)


def unified_quality(parts: list[tuple[DataFrame, DataFrame]], papers: DataFrame | None = None, invalid: DataFrame | None = None, top: int = 10) -> DataFrame:
    """The report over several graphs: rows are united before they are counted, so distinct counts are exact."""
    edges, nodes = zip(*parts)
    return graph_quality(functools.reduce(DataFrame.unionByName, edges), functools.reduce(DataFrame.unionByName, nodes), papers, invalid, top)

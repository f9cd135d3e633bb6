"""The test tables as graph, papers, claims, decisions and predictions, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import rules
from graphloom.plans.common import q, table


def edges(spark, sf_dir) -> DataFrame:
    """Line items as relations of parts (drugs) to suppliers (genes); the order is the source."""
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min(F.col("l_quantity").cast("int") % 6).alias("t"), F.min(F.round(F.col("l_discount") * 10, 2)).alias("c"), F.min("l_returnflag").alias("flag"))
    key = F.col("l_orderkey").cast("string")
    return one.select(
        key.alias("record_id"), F.col("l_linenumber").alias("relation_index"), F.lit("Drug").alias("head_label"), F.col("p").cast("string").alias("head_key"),
        F.when(F.col("p") % 2 == 0, "TARGETS").otherwise("INHIBITS").alias("relation"), F.lit("Gene").alias("tail_label"), F.col("s").cast("string").alias("tail_key"),
        key.alias("source_id"), F.col("t").alias("evidence_tier"), F.col("c").alias("confidence"), "flag",
        F.map_filter(F.create_map(F.lit("sentence"), F.when(F.col("flag") != "N", F.lit("s")), F.lit("extraction_method"), F.when(F.col("flag") == "A", F.lit("rule_based_v1"))), lambda _, v: v.isNotNull()).alias("properties"),
    )


EDGES = """e AS (SELECT l_orderkey::VARCHAR AS record_id, l_linenumber AS relation_index, 'Drug' AS head_label, min(l_partkey)::VARCHAR AS head_key,
 CASE WHEN min(l_partkey) % 2 = 0 THEN 'TARGETS' ELSE 'INHIBITS' END AS relation, 'Gene' AS tail_label, min(l_suppkey)::VARCHAR AS tail_key, l_orderkey::VARCHAR AS source_id,
 min(CAST(trunc(l_quantity) AS INTEGER) % 6) AS evidence_tier, min(round(l_discount * 10, 2)) AS confidence, min(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey, l_linenumber)"""

MERGED = """m AS (SELECT head_label, head_key, relation, tail_label, tail_key, count(DISTINCT source_id) AS citations, max(evidence_tier) AS evidence_tier, max(confidence) AS confidence, arg_min(source_id, row(record_id, relation_index)) AS created_from FROM e GROUP BY ALL)"""


def nodes(spark, sf_dir) -> DataFrame:
    """Each relation's two ends as node rows; `size` is a property that later rows override."""
    e = edges(spark, sf_dir)
    side = lambda s: e.select("record_id", F.col(f"{s}_label").alias("label"), F.col(f"{s}_key").alias("key"), F.struct("record_id", "relation_index").alias("ord"), F.create_map(F.lit("tier"), F.col("evidence_tier").cast("string")).alias("properties"))
    return side("head").unionByName(side("tail"))


NODES = """n AS (SELECT record_id, head_label AS label, head_key AS key, row(record_id, relation_index) AS ord, evidence_tier::VARCHAR AS tier FROM e UNION ALL SELECT record_id, tail_label, tail_key, row(record_id, relation_index), evidence_tier::VARCHAR FROM e)"""


def decisions(spark, sf_dir) -> DataFrame:
    """Orders as decisions on the first two relations of their record."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.explode(F.array(F.lit(1), F.lit(2))).alias("i"))
    s = F.when(F.col("o_orderkey") % 5 == 0, "pending").when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "corrected").otherwise("rejected")
    fix = s == "corrected"
    return o.select(F.concat_ws(":", F.lit("relation"), F.col("o_orderkey").cast("string"), F.col("i").cast("string")).alias("item_id"), s.alias("review_status"), F.when(fix & (F.col("i") == 1), "ASSOCIATED_WITH").alias("corrected_relation"), F.when(fix, (F.col("o_orderkey") % 6).cast("int")).alias("corrected_tier"))


DECISIONS = """d0 AS (SELECT o_orderkey, i, CASE WHEN o_orderkey % 5 = 0 THEN 'pending' WHEN o_orderstatus = 'F' THEN 'accepted' WHEN o_orderstatus = 'O' THEN 'corrected' ELSE 'rejected' END AS review_status FROM orders, (VALUES (1), (2)) AS v(i)),
d AS (SELECT 'relation:' || o_orderkey::VARCHAR || ':' || i::VARCHAR AS item_id, review_status, CASE WHEN review_status = 'corrected' AND i = 1 THEN 'ASSOCIATED_WITH' END AS corrected_relation, CASE WHEN review_status = 'corrected' THEN CAST(o_orderkey % 6 AS INTEGER) END AS corrected_tier FROM d0)"""


def predictions(spark, sf_dir) -> DataFrame:
    """Documents as scored predictions."""
    c = F.col
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("prediction:"), c("doc_id").cast("string")).alias("item_id"), c("doc_id").cast("string").alias("source_pmid"), "text",
        F.concat(F.lit("LABEL_"), (c("doc_id") % 7).cast("string")).alias("prediction"), (c("n_chars") % 101 / 100.0).alias("confidence"), c("source").alias("checkpoint_name"),
        F.when(c("doc_id") % 4 == 0, "candidate").when(c("doc_id") % 4 == 1, "smoke").otherwise("").alias("checkpoint_status"), F.when(c("doc_id") % 5 > 0, rules.NOTICE).alias("warning"),
    )


PREDICTIONS = f"""p AS (SELECT 'prediction:' || doc_id::VARCHAR AS item_id, doc_id::VARCHAR AS source_pmid, text, 'LABEL_' || (doc_id % 7)::VARCHAR AS prediction, CASE WHEN doc_id % 7 < 6 THEN CAST(doc_id % 7 AS INTEGER) END AS tier, n_chars % 101 / 100.0 AS confidence, source AS checkpoint_name,
 CASE doc_id % 4 WHEN 0 THEN 'candidate' WHEN 1 THEN 'smoke' ELSE '' END AS checkpoint_status, CASE WHEN doc_id % 5 > 0 THEN {q(rules.NOTICE)} END AS warning FROM documents)"""


def prediction_decisions(spark, sf_dir) -> DataFrame:
    """Labels as decisions on predictions."""
    s = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 0, "corrected").otherwise("accepted")
    return table(spark, sf_dir, "labels").select(F.concat(F.lit("prediction:"), F.col("doc_id").cast("string")).alias("item_id"), s.alias("review_status"), F.when(s == "corrected", (F.col("doc_id") % 6).cast("int")).alias("corrected_tier"))


PREDICTION_DECISIONS = """r AS (SELECT 'prediction:' || doc_id::VARCHAR AS item_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 0 THEN 'corrected' ELSE 'accepted' END AS review_status, CASE WHEN toxic = 0 AND quality = 0 THEN CAST(doc_id % 6 AS INTEGER) END AS corrected_tier FROM labels)"""
CURATED = f"""{PREDICTIONS}, {PREDICTION_DECISIONS},
c AS (SELECT item_id, source_pmid, prediction, confidence, coalesce(review_status, 'pending') AS review_status, CASE WHEN review_status = 'corrected' THEN coalesce(corrected_tier, tier) ELSE tier END AS curated_evidence_tier FROM p LEFT JOIN r USING (item_id) WHERE coalesce(review_status, 'pending') <> 'rejected')"""
OVERLAY = f"""{EDGES}, {CURATED},
b AS (SELECT source_pmid AS record_id, max(row(curated_evidence_tier, item_id, review_status)) AS b FROM c WHERE curated_evidence_tier IS NOT NULL AND review_status <> 'pending' GROUP BY source_pmid),
o AS (SELECT e.*, b.b[1] AS new_tier, b.b[3] AS new_status, b.b IS NOT NULL AND b.b[1] <> evidence_tier AS hit FROM e LEFT JOIN b USING (record_id))"""

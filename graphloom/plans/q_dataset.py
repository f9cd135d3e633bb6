"""Queries of training tables, on documents with labels."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from graphloom.operators import dataset as D
from graphloom.operators import review as R
from graphloom.plans.base import CURATED, PREDICTION_DECISIONS, PREDICTIONS
from graphloom.plans.common import q, table
from graphloom.sources.tables import written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def examples(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return docs.join(table(spark, sf, "labels"), "doc_id").select(F.col("doc_id").cast("string").alias("item_id"), (F.col("doc_id") % 50).cast("string").alias("source_pmid"), F.concat(F.lit("t"), (F.col("doc_id") % 3).cast("string")).alias("task"), F.col("text"), F.concat_ws("/", "quality", "toxic", "lang").alias("label"), "source")


_X = "x AS (SELECT doc_id::VARCHAR AS item_id, (doc_id % 50)::VARCHAR AS source_pmid, 't' || (doc_id % 3)::VARCHAR AS task, text, quality::VARCHAR || '/' || toxic::VARCHAR || '/' || lang AS label, source FROM documents JOIN labels USING (doc_id))"


def _sizes(n: str) -> str:
    return f"CASE WHEN {n} <= 1 THEN 0 WHEN {n} = 2 THEN 1 ELSE v - d END AS v, CASE WHEN {n} <= 2 THEN 0 ELSE v - (o - d) END AS t"


def _split(rows: str, n: str) -> str:
    """rows with n and rk -> split."""
    return f"SELECT *, CASE WHEN rk <= {n} - v - t THEN 'train' WHEN rk <= {n} - t THEN 'validation' ELSE 'test' END AS split FROM (SELECT * EXCLUDE (v, o, d), {_sizes(n)} FROM (SELECT *, least(o, greatest(v - 1, 0)) AS d FROM (SELECT *, greatest(0, 2 * v + 1 - {n}) AS o FROM (SELECT *, greatest(1, CAST(round_even({n} * 0.1, 0) AS BIGINT)) AS v FROM ({rows})))))"


_STRAT = _split("SELECT *, count(*) OVER (PARTITION BY task, label) AS n, row_number() OVER (PARTITION BY task, label ORDER BY sha256('13|' || label || '|' || item_id), item_id) AS rk FROM x", "n")
_GROUP = _split("SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY sha256('13|' || source_pmid), source_pmid) AS rk FROM (SELECT DISTINCT source_pmid FROM x)", "n")


@query("split_stratified", f"WITH {_X} SELECT item_id, task, label, split FROM ({_STRAT})")
def stratified(spark, sf):
    return D.split_stratified(examples(spark, sf).drop("text"), "item_id").select("item_id", "task", "label", "split")


@query("split_by_group", f"WITH {_X}, g AS ({_GROUP}) SELECT item_id, source_pmid, split FROM x JOIN g USING (source_pmid)")
def grouped(spark, sf):
    return D.split_by_group(examples(spark, sf).drop("text"), "source_pmid").select("item_id", "source_pmid", "split")


_LEAK = "l AS (SELECT a.split AS a, b.split AS b, count(DISTINCT a.source_pmid) AS shared, array_to_string(list_sort(list(DISTINCT a.source_pmid))[1:5], ';') AS first FROM s a JOIN s b ON a.source_pmid = b.source_pmid AND a.split < b.split GROUP BY ALL)"


@query("split_leakage", f"WITH {_X}, s AS (SELECT source_pmid, split FROM ({_STRAT})), {_LEAK} SELECT * FROM l")
def _(spark, sf):
    rows = D.split_stratified(examples(spark, sf).drop("text"), "item_id")
    return D.leakage(rows, "source_pmid", "split").withColumn("first", F.array_join("first", ";"))


@query("pack_leakage", f"WITH {_X}, s AS (SELECT source_pmid, source AS split FROM x), {_LEAK} SELECT a, b, shared FROM l")
def _(spark, sf):
    return D.leakage(examples(spark, sf), "source_pmid", "source").drop("first")


@query("unmatched_keys", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return D.unmatched_keys(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


_MAP = "m AS (SELECT task, label, CAST(row_number() OVER (PARTITION BY task ORDER BY label) - 1 AS INTEGER) AS id FROM (SELECT DISTINCT task, label FROM x))"


@query("label_map", f"WITH {_X}, {_MAP} SELECT * FROM m")
def _(spark, sf):
    return D.label_map(examples(spark, sf))


@query("apply_label_map", f"WITH {_X}, {_MAP} SELECT item_id, id FROM x JOIN m USING (task, label)")
def _(spark, sf):
    e = examples(spark, sf).select("item_id", "task", "label")
    return D.apply_label_map(e, D.label_map(e)).select("item_id", "id")


_WORD = r"[^\x20\x09-\x0D]+"


def word_lengths(texts: list[str]) -> list[list[int]]:
    """Stands for a user's tokenizer: a word's number of characters is its id."""
    return [[len(w) for w in re.findall(_WORD, t)] for t in texts]


@query("udf_tokenizer_labels", f"WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {q(_WORD)}) AS w FROM documents) SELECT doc_id, len(w) AS tokens, CAST(ceil(len(w) / 8.0) * 8 AS INTEGER) AS padded, CAST(coalesce(list_sum(list_transform(w, lambda y: len(y))), 0) AS BIGINT) AS id_sum, CAST(len(w) * (doc_id % 3) - 100 * (ceil(len(w) / 8.0) * 8 - len(w)) AS BIGINT) AS label_sum FROM w")
def _(spark, sf):
    out = D.tokenize(table(spark, sf, "documents"), word_lengths, ("doc_id",))
    out = out.withColumn("labels", D.mask_labels("attention_mask", (F.col("doc_id") % 3).cast("int")))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("doc_id", total("attention_mask").alias("tokens"), F.size("labels").alias("padded"), total("input_ids").alias("id_sum"), total("labels").alias("label_sum"))


@query("label_repair", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS label, doc_id % 3 = 0 AS repaired FROM documents")
def _(spark, sf):
    rows = table(spark, sf, "documents").withColumn("label", F.when(F.col("doc_id") % 3 != 0, F.col("source")))
    return D.repair_labels(rows, "lang").select("doc_id", "label", "repaired")


@query("dataset_card", f"WITH {_X} SELECT task, source, count(*) AS rows, count(DISTINCT label) AS labels, count(*) FILTER (WHERE trim(text) = '') AS missing_text, count(*) - count(DISTINCT row(source_pmid, text, label)) AS duplicates FROM x GROUP BY task, source")
def _(spark, sf):
    return D.dataset_card(examples(spark, sf), "task", "source")


@query("annotation_quality", f"WITH {_X} SELECT task, count(*) AS rows, count(DISTINCT label) AS labels, count(*) FILTER (WHERE trim(text) = '') AS missing_text, count(*) - count(DISTINCT row(source_pmid, text, label)) AS duplicates FROM x GROUP BY task")
def _(spark, sf):
    return D.dataset_card(examples(spark, sf), "task")


@query("majority_baseline", f"WITH {_X}, s AS ({_STRAT}), b AS (SELECT task, arg_max(label, row(n, label)) AS majority FROM (SELECT task, label, count(*) AS n FROM s WHERE split = 'train' GROUP BY ALL) GROUP BY task) SELECT task, majority, count(*) AS n, avg(CASE WHEN label = majority THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy FROM s JOIN b USING (task) WHERE split = 'test' GROUP BY ALL")
def _(spark, sf):
    s = stratified(spark, sf)
    return D.majority_baseline(s.where("split = 'train'"), s.where("split = 'test'"))


@query("dataset_summary", f"WITH {_X} SELECT task, label, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT task, '2/2/xx', 0 FROM (SELECT DISTINCT task FROM x)")
def _(spark, sf):
    return D.dataset_summary(examples(spark, sf), ("2/2/xx",))


@query("readiness", f"WITH {_X}, c AS (SELECT task, label, count(*) AS n FROM x GROUP BY ALL), a AS (SELECT task, CAST(sum(n) AS BIGINT) AS examples, min(n) AS smallest, max(n)::DOUBLE / sum(n) AS largest_share FROM c GROUP BY task), w AS (SELECT *, concat_ws('; ', CASE WHEN examples < 10 THEN 'too few examples' END, CASE WHEN smallest < 2 THEN 'label with too few examples' END, CASE WHEN largest_share > 0.85 THEN 'dominant label' END) AS warnings FROM a) SELECT *, warnings = '' AS ready FROM w")
def _(spark, sf):
    return D.readiness(examples(spark, sf))


@query("evaluate_predictions", """WITH c AS (SELECT quality::VARCHAR AS t, toxic::VARCHAR AS p FROM labels), n AS (SELECT t AS label FROM c UNION SELECT p FROM c UNION SELECT '9'),
m AS (SELECT label, (SELECT count(*) FROM c WHERE t = label) AS s, (SELECT count(*) FROM c WHERE p = label) AS g, (SELECT count(*) FROM c WHERE p = label AND t = label) AS h FROM n),
r AS (SELECT label, CASE WHEN g > 0 THEN h / g::DOUBLE ELSE 0 END AS precision, CASE WHEN s > 0 THEN h / s::DOUBLE ELSE 0 END AS recall, s AS support FROM m)
SELECT label, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, support FROM r""")
def _(spark, sf):
    return D.evaluate(table(spark, sf, "labels").select(F.col("quality").cast("string").alias("true"), F.col("toxic").cast("string").alias("pred")), ("9",))


_CONFUSED = """c AS (SELECT quality::VARCHAR AS t, toxic::VARCHAR AS p FROM labels), n AS (SELECT t AS label FROM c UNION SELECT p FROM c UNION SELECT '9')"""


def judged(spark, sf):
    return table(spark, sf, "labels").select(F.col("quality").cast("string").alias("true"), F.col("toxic").cast("string").alias("pred"))


@query("evaluation_summary", f"""WITH {_CONFUSED}, m AS (SELECT label, (SELECT count(*) FROM c WHERE t = label) AS s, (SELECT count(*) FROM c WHERE p = label) AS g, (SELECT count(*) FROM c WHERE p = label AND t = label) AS h FROM n),
f AS (SELECT CASE WHEN h > 0 THEN 2 * (h / g::DOUBLE) * (h / s::DOUBLE) / (h / g::DOUBLE + h / s::DOUBLE) ELSE 0.0::DOUBLE END AS f1 FROM m)
SELECT (SELECT count(*) FROM c) AS examples, (SELECT count(*) FILTER (t = p)::DOUBLE / count(*) FROM c) AS accuracy, (SELECT avg(f1) FROM f) AS macro_f1, 'label(s) absent from evaluation set: 9' AS warnings""")
def _(spark, sf):
    return D.evaluation_summary(judged(spark, sf), ("0", "1", "9"))


@query("confusion_matrix", f"WITH {_CONFUSED} SELECT a.label AS true, b.label AS pred, (SELECT count(*) FROM c WHERE t = a.label AND p = b.label) AS n FROM n a, n b")
def _(spark, sf):
    return D.confusion_matrix(judged(spark, sf), ("9",))


_NEG = """e AS MATERIALIZED (SELECT DISTINCT l_orderkey AS group_id, 'p' || l_partkey::VARCHAR AS head, 's' || l_suppkey::VARCHAR AS tail FROM lineitem),
n AS MATERIALIZED (SELECT group_id, head AS z FROM e UNION SELECT group_id, tail FROM e),
c AS (SELECT a.group_id, a.z AS head, b.z AS tail FROM n a JOIN n b ON a.group_id = b.group_id WHERE a.z <> b.z),
g AS MATERIALIZED (SELECT c.*, 'NO_RELATION' AS label FROM c ANTI JOIN e ON c.group_id = e.group_id AND c.head = e.head AND c.tail = e.tail ORDER BY sha256('13|' || c.group_id::VARCHAR || '|' || c.head || '|' || c.tail) LIMIT (SELECT count(*) FROM e))"""


def positives(spark, sf):
    """Distinct line items as a stored table, dealt out by their group: numbers are shuffled, once, and made texts after it."""
    keys = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").repartition("l_orderkey").distinct()
    return written(keys.select(F.col("l_orderkey").alias("group_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("head"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("tail")), tidy=True)


@query("negative_samples", f"WITH {_NEG} SELECT * FROM g")
def _(spark, sf):
    return D.negative_samples(positives(spark, sf), stored=True)


@query("negative_report", f"WITH {_NEG} SELECT (SELECT count(*) FROM e) AS positive, (SELECT count(*) FROM g) AS negative, 0::BIGINT AS skipped, '' AS warnings")
def _(spark, sf):
    p = positives(spark, sf)
    return D.negative_report(p, D.negative_samples(p, stored=True))


@query("merge_relation_pack", f"WITH {_NEG} SELECT group_id, head, tail, 'TARGETS' AS label, false AS synthetic FROM e UNION ALL SELECT group_id, head, tail, label, true FROM g")
def pack(spark, sf):
    p = positives(spark, sf)
    return p.withColumn("label", F.lit("TARGETS")).withColumn("synthetic", F.lit(False)).unionByName(D.negative_samples(p, stored=True).withColumn("synthetic", F.lit(True)))


@query("relation_quality", f"WITH {_NEG} SELECT (SELECT count(*) FROM e) + (SELECT count(*) FROM g) AS rows, (SELECT count(*) FROM e) AS positive, (SELECT count(*) FROM g) AS negative, 0::BIGINT AS missing_endpoint, 0::BIGINT AS identical, 0::BIGINT AS duplicates")
def _(spark, sf):
    return D.relation_quality(pack(spark, sf))


_REVIEW = f"{_X}, b AS (SELECT task, label, count(*) AS n FROM x GROUP BY ALL), v AS (SELECT task, '' AS label, CAST(sum(n) AS BIGINT) AS n, 500 AS need FROM b GROUP BY task UNION ALL SELECT task, label, n, 30 FROM b), w AS (SELECT task, label, n, greatest(0, need - n) AS shortfall, n < need AS blocked FROM v)"


def review(spark, sf):
    return D.promotion_review(examples(spark, sf), 500, 30)


@query("promotion_review", f"WITH {_REVIEW} SELECT * FROM w")
def _(spark, sf):
    return review(spark, sf)


@query("promotion_plan", f"WITH {_REVIEW} SELECT task, label, CAST(batch AS INTEGER) AS batch, least(24, shortfall - (batch - 1) * 24) AS examples FROM (SELECT *, unnest(range(1, CAST(ceil(shortfall / 24.0) AS BIGINT) + 1)) AS batch FROM w WHERE shortfall > 0)")
def _(spark, sf):
    return D.promotion_plan(review(spark, sf))


@query("pack_comparison", f"WITH {_X} SELECT coalesce(source, '') AS pack, coalesce(task, '') AS task, count(*) AS rows, count(DISTINCT label) AS labels FROM x GROUP BY ROLLUP (source, task)")
def _(spark, sf):
    return D.pack_comparison(examples(spark, sf).withColumnRenamed("source", "pack"))


_CONFIG = ("0/0/en", "1/0/en", "1/0/xx")


@query("label_drift", f"WITH {_X}, s AS (SELECT split, list(DISTINCT label) AS have FROM ({_STRAT}) GROUP BY split) SELECT split, array_to_string(list_sort(list_filter(have, lambda y: y NOT IN ({', '.join(map(q, _CONFIG))}))), ';') AS unexpected, array_to_string(list_sort(list_filter([{', '.join(map(q, _CONFIG))}], lambda y: NOT list_contains(have, y))), ';') AS missing FROM s")
def _(spark, sf):
    return D.label_drift(stratified(spark, sf), "split", _CONFIG)


@query("label_coverage_check", f"WITH {_X}, h AS (SELECT list(DISTINCT label) AS have FROM x) SELECT 'data_in_config' AS check, len(list_filter(have, lambda y: y NOT IN ({', '.join(map(q, _CONFIG))}))) = 0 AS passed FROM h UNION ALL SELECT 'config_in_data', len(list_filter([{', '.join(map(q, _CONFIG))}], lambda y: NOT list_contains(have, y))) = 0 FROM h")
def _(spark, sf):
    return D.label_coverage(examples(spark, sf), _CONFIG)


def _claims(rows):
    return rows.select("source_pmid", F.lit("evidence_claim").alias("item_type"), F.col("curated_evidence_tier").alias("tier"), F.lit(None).cast("string").alias("relation_type"), "review_status")


@query("annotation_export", f"WITH {CURATED} SELECT source_pmid, 'evidence' AS task, curated_evidence_tier::VARCHAR AS label, review_status FROM c WHERE review_status IN ('accepted', 'corrected') AND curated_evidence_tier IS NOT NULL")
def export(spark, sf):
    from graphloom.plans.q_review import curated

    return D.annotation_examples(_claims(curated(spark, sf)))


@query("gold_seed", f"WITH {CURATED} SELECT source_pmid, 'evidence' AS task, curated_evidence_tier::VARCHAR AS label FROM c WHERE review_status IN ('accepted', 'corrected') AND curated_evidence_tier IS NOT NULL UNION ALL SELECT doc_id::VARCHAR, 'ner', lang FROM documents")
def gold(spark, sf):
    from graphloom.plans.q_review import curated

    return D.gold_seed(_claims(curated(spark, sf)), table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source_pmid"), F.col("lang").alias("label")))


@query("gold_seed_skipped", f"WITH {PREDICTIONS}, {PREDICTION_DECISIONS} SELECT coalesce(review_status, 'pending') AS review_status, count(*) AS n FROM p LEFT JOIN r USING (item_id) WHERE coalesce(review_status, 'pending') IN ('pending', 'rejected') GROUP BY ALL")
def _(spark, sf):
    from graphloom.plans.base import prediction_decisions, predictions

    decided = predictions(spark, sf).select("item_id").join(prediction_decisions(spark, sf), "item_id", "left")
    return D.skipped_decisions(decided.withColumn("review_status", F.coalesce("review_status", F.lit("pending"))))


_TWO = "o AS (SELECT doc_id::VARCHAR AS item_id, quality::VARCHAR AS label, CASE WHEN toxic = 1 THEN 'withdrawn' ELSE 'accepted' END AS status FROM labels UNION ALL SELECT doc_id::VARCHAR, CASE WHEN doc_id % 7 = 0 THEN '9' ELSE quality::VARCHAR END, 'accepted' FROM labels)"


def observations(spark, sf):
    one = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("item_id"), F.col("quality").cast("string").alias("label"), F.when(F.col("toxic") == 1, "withdrawn").otherwise("accepted").alias("status"))
    return one.unionByName(one.select("item_id", F.when(F.col("item_id").cast("long") % 7 == 0, "9").otherwise(F.col("label")).alias("label"), F.lit("accepted").alias("status")))


@query("provenance_diff", f"WITH {_TWO} SELECT item_id, count(*) AS observations, count(DISTINCT label) > 1 AS label_changed, count(DISTINCT status) > 1 AS status_changed, bool_or(status = 'withdrawn') AS withdrawn FROM o GROUP BY item_id")
def _(spark, sf):
    return D.provenance_diff(observations(spark, sf))


@query("fixture_import", f"WITH {_TWO} SELECT status, count(*) AS n, count(*) FILTER (WHERE label IS NULL) AS missing FROM o GROUP BY status")
def _(spark, sf):
    return D.import_summary(observations(spark, sf))


@query("training_provenance_audit", f"WITH {_X} SELECT source, count(*) AS rows, count(*) FILTER (WHERE trim(item_id) = '') AS missing_id, count(*) FILTER (WHERE label LIKE '0/%') AS low FROM x GROUP BY source")
def _(spark, sf):
    return D.provenance_audit(examples(spark, sf), F.col("label").like("0/%"))


@query("adapt_training_row", f"WITH {_X} SELECT item_id AS id, task, text, label AS labels FROM x")
def _(spark, sf):
    e = examples(spark, sf).withColumn("task2", F.when(F.col("task") == "t0", "evidence").when(F.col("task") == "t1", "relation").otherwise("ner"))
    rows = e.select(F.col("task2").alias("task"), F.col("item_id").alias("source_pmid"), F.lit(None).cast("string").alias("pmid"), "text", F.lit(None).cast("string").alias("sentence"), "label", F.array("label").alias("labels"))
    out = D.adapt_rows(rows)
    return out.select("id", F.concat(F.lit("t"), F.when(F.col("task") == "evidence", 0).when(F.col("task") == "relation", 1).otherwise(2).cast("string")).alias("task"), "text", F.array_join("labels", ";").alias("labels"))


def _groups(rows: str, key: str) -> str:
    return _split(f"SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY sha256('13|' || {key}), {key}) AS rk FROM (SELECT DISTINCT {key} FROM {rows})", "n")


@query("evidence_pack", f"WITH {_X}, {_MAP}, g AS ({_GROUP}) SELECT task, split, label, id, count(*) AS n FROM x JOIN g USING (source_pmid) JOIN m USING (task, label) GROUP BY ALL")
def evidence_pack(spark, sf):
    """Repair, split by group, map labels, and count by split and label."""
    rows = D.repair_labels(examples(spark, sf).drop("text"), "source")
    return D.apply_label_map(D.split_by_group(rows, "source_pmid"), D.label_map(rows)).groupBy("task", "split", "label", "id").agg(F.count("*").alias("n"))


@query("relation_pack", f"WITH {_NEG}, k AS (SELECT group_id::VARCHAR AS group_id, 'TARGETS' AS label FROM e UNION ALL SELECT group_id::VARCHAR, label FROM g), h AS ({_groups('k', 'group_id')}) SELECT split, label, count(*) AS n FROM k JOIN h USING (group_id) GROUP BY ALL")
def _(spark, sf):
    """Positives and negatives, split by group; rows of one group and label are counted before the split."""
    rows = pack(spark, sf).groupBy(F.col("group_id").cast("string").alias("group_id"), "label").agg(F.count("*").alias("n"))
    return D.split_by_group(written(rows, tidy=True), "group_id").groupBy("split", "label").agg(F.sum("n").alias("n"))


_PACK = f"""{CURATED}, k AS (SELECT source_pmid, 'evidence' AS task, curated_evidence_tier::VARCHAR AS label, text FROM c JOIN documents ON doc_id::VARCHAR = source_pmid WHERE review_status IN ('accepted', 'corrected') AND curated_evidence_tier IS NOT NULL
UNION ALL SELECT doc_id::VARCHAR, 'ner', coalesce(nullif(trim(lang), ''), source), text FROM documents), h AS ({_groups('k', 'source_pmid')}), s AS (SELECT k.*, split FROM k JOIN h USING (source_pmid)),
y AS (SELECT task, label, count(*) AS n FROM s GROUP BY ALL), b AS (SELECT task, arg_max(label, row(n, label)) AS majority FROM (SELECT task, label, count(*) AS n FROM s WHERE split = 'train' GROUP BY ALL) GROUP BY task),
w AS (SELECT task, concat_ws('; ', CASE WHEN sum(n) < 10 THEN 'too few examples' END, CASE WHEN min(n) < 2 THEN 'label with too few examples' END, CASE WHEN max(n)::DOUBLE / sum(n) > 0.85 THEN 'dominant label' END) AS warnings FROM y GROUP BY task)"""


@query("gold_pack", f"""WITH {_PACK} SELECT 'split' AS section, task, split || ':' || label AS name, count(*)::DOUBLE AS value FROM s GROUP BY ALL
UNION ALL SELECT 'label', task, label, (row_number() OVER (PARTITION BY task ORDER BY label) - 1)::DOUBLE FROM y
UNION ALL SELECT 'baseline', task, majority, avg(CASE WHEN label = majority THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM s JOIN b USING (task) WHERE split = 'test' GROUP BY ALL
UNION ALL SELECT 'ready', task, warnings, CASE WHEN warnings = '' THEN 1.0 ELSE 0.0 END FROM w
UNION ALL SELECT 'rows', task, split, count(*)::DOUBLE FROM s GROUP BY ALL UNION ALL SELECT 'labels', task, split, count(DISTINCT label)::DOUBLE FROM s GROUP BY ALL
UNION ALL SELECT 'missing_text', task, split, (count(*) FILTER (WHERE trim(coalesce(text, '')) = ''))::DOUBLE FROM s GROUP BY ALL
UNION ALL SELECT 'duplicates', task, split, (count(*) - count(DISTINCT row(source_pmid, coalesce(text, ''), label)))::DOUBLE FROM s GROUP BY ALL""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source_pmid"), "text", "lang", "source")
    seed = export(spark, sf).join(docs.select("source_pmid", "text"), "source_pmid").select("source_pmid", "task", "label", "text", F.lit(None).cast("string").alias("source"))
    ner = docs.select("source_pmid", F.lit("ner").alias("task"), F.col("lang").alias("label"), "text", "source")
    return D.pack_report(D.gold_pack(seed.unionByName(ner), "source"))


_GOVERN = f"""{_X}, s AS (SELECT source_pmid, split FROM x JOIN ({_GROUP}) USING (source_pmid)), {_LEAK},
c AS (SELECT task, label, count(*) AS n FROM x GROUP BY ALL),
k AS (SELECT 'leakage:' || a || ':' || b AS check, shared = 0 AS passed FROM l
UNION ALL SELECT 'readiness:' || task, sum(n) >= 10 AND min(n) >= 2 AND max(n)::DOUBLE / sum(n) <= 0.85 FROM c GROUP BY task
UNION ALL SELECT 'rows:' || task, count(*) > 0 FROM x GROUP BY task
UNION ALL SELECT 'drift:' || split, len(list_filter(have, lambda y: y NOT IN ({', '.join(map(q, _CONFIG))}))) = 0 AND len(list_filter([{', '.join(map(q, _CONFIG))}], lambda y: NOT list_contains(have, y))) = 0 FROM (SELECT split, list(DISTINCT label) AS have FROM x JOIN ({_GROUP}) USING (source_pmid) GROUP BY split)
UNION ALL SELECT 'provenance:' || source, count(*) FILTER (WHERE trim(item_id) = '') = 0 FROM x GROUP BY source)"""


@query("training_governance", f"WITH {_GOVERN} SELECT * FROM k UNION ALL SELECT 'overall', coalesce(bool_and(passed), true) FROM k")
def _(spark, sf):
    """Leakage, readiness, row counts, label drift (strict) and provenance in one table, with a verdict."""
    rows = examples(spark, sf)
    split = D.split_by_group(rows.drop("text"), "source_pmid")
    drift, origin = D.label_drift(split, "split", _CONFIG), D.provenance_audit(rows, F.col("label").like("0/%"))
    return D.governance(D.leakage(split, "source_pmid", "split"), D.readiness(rows), R.counts_by(rows, "task"), drift, origin, strict=True)

"""Queries of the text operators. The lexicon and the rules are words that the test documents hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import rules
from graphloom.operators import extract as E
from graphloom.plans.common import q, sql_fold, table

LEXICON = (("that", "GENE"), ("with", "OUTCOME"), ("for", "BIOMARKER"), ("was", "DISEASE"), ("by", "DRUG"), ("in the", "TREATMENT"), ("in", "PATHWAY"))
RULES = (("PREDICTS", (r"\bthe\b", r"\ba\b"), 0.62), ("ASSOCIATED_WITH", (r"\band\b",), 0.58), ("TARGETS", (r"\bof\b",), 0.6))
CUES = ((5, 0.82, (r"\blicense[d]?\b",)), (4, 0.76, (r"\bidiot\b", r"\bclown\b")), (3, 0.68, (r"\bthat\b",)))
OWN_RULES = (("SHOWS", (r"\bthis\b",), 0.3), ("COMES_FROM", (r"\bfrom\b", r"\bwas\b"), 0.4))
PHRASES = (r"\bidiot\b", r"\brights reserved\b")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("pmid"), "text")


def on_papers(f):
    return lambda spark, sf_dir: f(papers(spark, sf_dir))


_SENTENCES = r"""p AS (SELECT doc_id::VARCHAR AS pmid, regexp_extract_all(text, '([.!?]*)([^.!?]+[.!?]?)', 1) AS g1, regexp_extract_all(text, '([.!?]*)([^.!?]+[.!?]?)', 2) AS g2 FROM documents),
e AS (SELECT pmid, unnest(range(1, len(g2) + 1)) AS i, unnest(g1) AS skipped, unnest(g2) AS body FROM p),
f AS (SELECT pmid, i, body, coalesce(sum(length(skipped) + length(body)) OVER (PARTITION BY pmid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(skipped) + length(body) - length(regexp_replace(body, '^\s+', '')) AS start, regexp_replace(body, '^\s+|\s+$', '', 'g') AS sentence FROM e),
s AS (SELECT pmid, CAST(row_number() OVER (PARTITION BY pmid ORDER BY i) - 1 AS INTEGER) AS sentence_no, CAST(start AS INTEGER) AS start, CAST(start + length(sentence) AS INTEGER) AS "end", sentence FROM f WHERE sentence <> '')"""

_WORDS = "|".join(sorted((t for t, _ in LEXICON), key=lambda x: (-len(x), x)))
_LABELS = "CASE lower(text) " + " ".join(f"WHEN {q(t)} THEN {q(x)}" for t, x in LEXICON) + " END"
# RE2 has no look-around: terms are found among the words, each with the space before it; "in the" before "in"
_MENTIONS = rf"""w AS (SELECT doc_id::VARCHAR AS pmid, regexp_extract_all(regexp_replace(text, '([^\p{{L}}\p{{N}}_])', '\1' || chr(1), 'g'), '[^' || chr(1) || ']+', 0) AS pieces FROM documents),
x AS (SELECT pmid, unnest(range(1, len(pieces) + 1)) AS i, unnest(pieces) AS piece FROM w),
y AS (SELECT pmid, i, piece, coalesce(sum(length(piece)) OVER (PARTITION BY pmid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, lead(piece) OVER (PARTITION BY pmid ORDER BY i) AS nxt, regexp_replace(piece, '[^\p{{L}}\p{{N}}_]$', '') AS word FROM x),
z AS (SELECT *, lower(piece) = 'in ' AND regexp_matches(nxt, '^(?i:the)([^\p{{L}}\p{{N}}_]|$)') AS two FROM y),
m AS (SELECT pmid, CAST(off AS INTEGER) AS start, CAST(CASE WHEN two THEN off + 6 ELSE off + length(word) END AS INTEGER) AS "end", CASE WHEN two THEN piece || substr(nxt, 1, 3) ELSE word END AS text FROM z WHERE lower(word) IN ({", ".join(q(t) for t, _ in LEXICON)})),
n AS (SELECT pmid, start, "end", text, {_LABELS} AS label, 0.75::DOUBLE AS confidence, text AS normalized_text FROM m)"""


def _mentions(docs: DataFrame) -> DataFrame:
    return E.lexicon_ner(docs, LEXICON)


def _relations(docs: DataFrame) -> DataFrame:
    return E.extract_relations(docs, _mentions(docs), table=RULES).select("pmid", "relation_index", "head_label", "head_key", "relation", "tail_label", "tail_key", "confidence", "trigger", "sentence_no")


def _fired(s: str, table=RULES) -> str:
    parts = []
    for i, (r, patterns, c) in enumerate(table):
        hit = "coalesce(" + ", ".join(f"nullif(regexp_extract({s}, '(?i){p}'), '')" for p in patterns) + ")"
        parts.append(f"{{'rule_no': {i}, 'relation': {q(r)}, 'trigger': {hit}, 'c': {c}::DOUBLE}}")
    return "[" + ", ".join(parts) + "]"


_NODE = "CASE label " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in rules.NODE_OF_ENTITY.items()) + " END"
_PAIRS = ", ".join(f"({i}, {q(h)}, {q(t)})" for i, _, h, t, _ in E.rule_rows(RULES))
_RELATIONS = f"""{_SENTENCES}, {_MENTIONS},
h AS (SELECT s.pmid, sentence_no, sentence, n.start AS m_start, n."end" AS m_end, {_NODE} AS node, text AS key, confidence AS mc, row_number() OVER (PARTITION BY s.pmid, sentence_no ORDER BY n.start, n."end") AS pos, count(*) OVER (PARTITION BY s.pmid, sentence_no) AS k FROM s JOIN n ON s.pmid = n.pmid AND n.start < s."end" AND n."end" > s.start),
g AS (SELECT a.pmid, a.sentence_no, a.sentence, a.node AS an, b.node AS bn, a.key AS ak, b.key AS bk, least(a.mc, b.mc) AS mc, a.pos AS ap, b.pos AS bp, unnest({_fired('a.sentence')}) AS rule FROM h a JOIN h b ON a.pmid = b.pmid AND a.sentence_no = b.sentence_no AND a.pos <> b.pos AND a.k >= 2 WHERE a.pos < b.pos OR NOT (a.node = b.node AND b.m_start <= a.m_start)),
o AS (SELECT g.*, rule.rule_no AS rule_no, rule.relation AS relation, rule.trigger AS trigger, rule.c AS rc, row(sentence_no, rule.rule_no, least(ap, bp), greatest(ap, bp), ap > bp) AS ord FROM g JOIN (VALUES {_PAIRS}) AS v(r, hl, tl) ON v.r = rule.rule_no AND hl = an AND tl = bn WHERE rule.trigger IS NOT NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY pmid, an, {sql_fold('ak')}, relation, bn, {sql_fold('bk')} ORDER BY ord DESC) AS back, min(ord) OVER (PARTITION BY pmid, an, {sql_fold('ak')}, relation, bn, {sql_fold('bk')}) AS lo FROM o),
r AS (SELECT pmid, CAST(row_number() OVER (PARTITION BY pmid ORDER BY lo) AS INTEGER) AS relation_index, an AS head_label, ak AS head_key, relation, bn AS tail_label, bk AS tail_key, least(mc, rc) AS confidence, trigger, sentence_no FROM l WHERE back = 1)"""


def _top_pairs(docs: DataFrame) -> DataFrame:
    pairs = _relations(docs).groupBy("head_label", "head_key", "relation", "tail_label", "tail_key").agg(F.count("*").alias("n"))
    return pairs.orderBy(F.desc("n"), "head_label", "head_key", "relation", "tail_label", "tail_key").limit(10)


def _top_entities(docs: DataFrame) -> DataFrame:
    return _mentions(docs).groupBy("label", "text").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label", "text").limit(10)


def _tagger():
    import re

    pattern = re.compile(r"\b(that|with)\b")
    return lambda texts: [[{"start": m.start(), "end": m.end(), "text": m[0], "label": "GENE", "confidence": 0.9} for m in pattern.finditer(t)] for t in texts]


def _classifier():
    import pandas as pd

    return lambda texts: pd.DataFrame({"tier": texts.str.contains("idiot").astype("int32") * 4, "confidence": 0.7, "cues": [["x"]] * len(texts)})


def _predictor():
    return lambda texts: [(f"LABEL_{len(t) % 7}", 0.5 + len(t) % 5 / 10) for t in texts]


def _chunks_sql(words: int, overlap: int) -> str:
    step = words - overlap
    return rf"""p AS (SELECT doc_id::VARCHAR AS pmid, text, regexp_extract_all(text, '(\s*)(\S+)', 0) AS w, regexp_extract_all(text, '(\s*)(\S+)', 1) AS sp FROM documents),
c AS (SELECT *, CAST(unnest(CASE WHEN len(w) <= {words} THEN range(0, 1) ELSE range(0, CAST(ceil((len(w) - {words}) / {step}.0) AS BIGINT) + 1) END) AS INTEGER) AS chunk_no FROM p),
d AS (SELECT *, coalesce(list_sum(list_transform(w[1:chunk_no * {step}], lambda x: length(x))), 0) + length(sp[chunk_no * {step} + 1]) AS off, list_sum(list_transform(w[1:least(chunk_no * {step} + {words}, len(w))], lambda x: length(x))) AS stop FROM c)
SELECT pmid, chunk_no, CAST(CASE WHEN len(w) <= {words} THEN 0 ELSE off END AS INTEGER) AS start, CASE WHEN len(w) <= {words} THEN text ELSE substr(text, CAST(off + 1 AS BIGINT), CAST(stop - off AS BIGINT)) END AS chunk FROM d"""


def _cues_sql() -> str:
    arms = []
    for tier, confidence, patterns in CUES:
        cues = "list_sort(list_distinct(" + " || ".join(f"regexp_extract_all(text, '(?i){p}')" for p in patterns) + "))"
        arms.append(f"WHEN {' OR '.join(f"regexp_matches(text, '(?i){p}')" for p in patterns)} THEN {{'t': {tier}, 'c': {confidence}::DOUBLE, 'q': array_to_string({cues}, '; ')}}")
    return f"SELECT pmid, CAST(x.t AS INTEGER) AS tier, x.c AS confidence, x.q AS cues FROM (SELECT doc_id::VARCHAR AS pmid, CASE {' '.join(arms)} ELSE {{'t': 0, 'c': 0.5::DOUBLE, 'q': ''}} END AS x FROM documents)"


def _phrase_sql() -> str:
    parts = []
    for p in PHRASES:
        g, f = f"regexp_split_to_array(text, '(?i){p}')", f"regexp_extract_all(text, '(?i){p}')"
        parts.append(f"SELECT doc_id::VARCHAR AS pmid, text, g, f, unnest(range(1, len(f) + 1)) AS i FROM (SELECT doc_id, text, {g} AS g, {f} AS f FROM documents)")
    start = "CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS BIGINT)"
    return f"SELECT pmid, 'prohibited_assertion' AS finding_type, 'Potential scope drift phrase: ' || phrase AS detail FROM (SELECT pmid, f[i] AS phrase, substr(text, greatest(1, {start} - 79), least(80, {start})) AS b FROM ({' UNION ALL '.join(parts)})) WHERE NOT (" + " OR ".join(f"contains(lower(b), {q(n)})" for n in rules.NEGATIONS) + ")"


QUERIES = {
    "split_sentences": on_papers(E.split_sentences),
    "chunk_text": on_papers(lambda d: E.chunk_text(d, 250, 40)),
    "lexicon_ner": on_papers(_mentions),
    "ner_apply": on_papers(lambda d: E.ner_apply(d, LEXICON[:5], 100, 20).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("pmid").alias("papers"))),
    "ner_examples": on_papers(lambda d: E.ner_examples(_mentions(d)).select("source_pmid", "task", "text", "label", "start", "end", "warning")),
    "entity_observations": on_papers(lambda d: E.entity_observations(_mentions(d))),
    "classify_evidence": on_papers(lambda d: E.classify_evidence(d, CUES).withColumn("cues", F.array_join("cues", "; "))),
    "match_relation_rules": on_papers(lambda d: E.match_relation_rules(E.split_sentences(d), RULES).select("pmid", "sentence_no", "rule_no", "relation", "trigger", "rule_confidence")),
    "extract_relations": on_papers(_relations),
    "top_pairs": on_papers(_top_pairs),
    "top_entities": on_papers(_top_entities),
    "phrase_scan": on_papers(lambda d: E.phrase_scan(d, PHRASES)),
    "udf_tagger": on_papers(lambda d: E.ner_apply(d, max_words=10**6, overlap=0, tagger=_tagger).select("pmid", "start", "end", "text", "label", "confidence")),
    "udf_evidence_classifier": on_papers(lambda d: E.classify_evidence(d, classifier=_classifier).select("pmid", "tier", "confidence")),
    "udf_predictor": on_papers(lambda d: E.predict_with(d, _predictor, checkpoint_name="rule").select("pmid", "prediction", "confidence", "checkpoint_name")),
    "batch_score": on_papers(lambda d: E.predict_with(d, _predictor, checkpoint_name="rule", checkpoint_status="candidate").select("pmid", "prediction", "confidence", "tier", "checkpoint_status")),
    "udf_rule_table": on_papers(lambda d: E.match_relation_rules(E.split_sentences(d), OWN_RULES).groupBy("relation", "trigger").agg(F.count("*").alias("n"), F.max("rule_confidence").alias("confidence"))),
}
ORACLE = {
    "split_sentences": f"WITH {_SENTENCES} SELECT * FROM s",
    "chunk_text": f"WITH {_chunks_sql(250, 40)}",
    "lexicon_ner": f"WITH {_MENTIONS} SELECT * FROM n",
    "ner_apply": f"WITH {_MENTIONS} SELECT label, count(*) AS n, count(DISTINCT pmid) AS papers FROM n WHERE label NOT IN ('TREATMENT', 'PATHWAY') GROUP BY label",
    "ner_examples": f"WITH {_MENTIONS} SELECT pmid AS source_pmid, 'ner' AS task, text, label, start, \"end\", {q(rules.NOTICE)} AS warning FROM n",
    "entity_observations": f"WITH {_MENTIONS} SELECT pmid, 'ner' AS item_type, label, concat_ws(':', 'ner', pmid, start, \"end\", label, text) AS item_id, sha256(pmid || '|' || start::VARCHAR || '|' || \"end\"::VARCHAR || '|' || label) AS identity, sha256(text) AS text_hash FROM n",
    "classify_evidence": _cues_sql(),
    "match_relation_rules": f"WITH {_SENTENCES} SELECT pmid, sentence_no, CAST(r.rule_no AS INTEGER) AS rule_no, r.relation AS relation, r.trigger AS trigger, r.c AS rule_confidence FROM (SELECT pmid, sentence_no, unnest({_fired('sentence')}) AS r FROM s) WHERE r.trigger IS NOT NULL",
    "extract_relations": f"WITH {_RELATIONS} SELECT * FROM r",
    "top_pairs": f"WITH {_RELATIONS} SELECT head_label, head_key, relation, tail_label, tail_key, count(*) AS n FROM r GROUP BY ALL ORDER BY n DESC, head_label, head_key, relation, tail_label, tail_key LIMIT 10",
    "top_entities": f"WITH {_MENTIONS} SELECT label, text, count(*) AS n FROM n GROUP BY ALL ORDER BY n DESC, label, text LIMIT 10",
    "phrase_scan": _phrase_sql(),
    "udf_rule_table": f"WITH {_SENTENCES} SELECT r.relation AS relation, r.trigger AS trigger, count(*) AS n, max(r.c) AS confidence FROM (SELECT unnest({_fired('sentence', OWN_RULES)}) AS r FROM s) WHERE r.trigger IS NOT NULL GROUP BY ALL",
    "udf_tagger": f"WITH {_MENTIONS} SELECT pmid, start, \"end\", text, 'GENE' AS label, 0.9::DOUBLE AS confidence FROM n WHERE text IN ('that', 'with')",
    "udf_evidence_classifier": "SELECT doc_id::VARCHAR AS pmid, CASE WHEN contains(text, 'idiot') THEN 4 ELSE 0 END AS tier, 0.7::DOUBLE AS confidence FROM documents",
    "udf_predictor": "SELECT doc_id::VARCHAR AS pmid, 'LABEL_' || (length(text) % 7)::VARCHAR AS prediction, 0.5 + length(text) % 5 / 10.0 AS confidence, 'rule' AS checkpoint_name FROM documents",
    "batch_score": "SELECT doc_id::VARCHAR AS pmid, 'LABEL_' || (length(text) % 7)::VARCHAR AS prediction, 0.5 + length(text) % 5 / 10.0 AS confidence, CASE WHEN length(text) % 7 < 6 THEN length(text) % 7 END AS tier, 'candidate' AS checkpoint_status FROM documents",
}

"""Behaviours on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import dataset as D
from graphloom.operators import extract as E
from graphloom.operators import graph as G
from graphloom.operators import review as R


def papers(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "pmid string, text string")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_sentences(spark):
    got = E.split_sentences(papers(spark, "MGMT predicts response. EGFR is separate.", " \n", "no end", None)).orderBy("pmid", "start").collect()
    assert [(r.pmid, r.start, r.end, r.sentence) for r in got] == [("0", 0, 23, "MGMT predicts response."), ("0", 24, 41, "EGFR is separate."), ("2", 0, 6, "no end")]


def test_long_texts_keep_their_offsets(spark):
    text = " ".join(f"Word{i} é." for i in range(500))
    got = E.split_sentences(papers(spark, text)).collect()
    assert len(got) == 500 and all(text[r.start : r.end] == r.sentence for r in got)
    chunks = E.chunk_text(papers(spark, text), 100, 20).orderBy("chunk_no").collect()
    assert all(text[r.start : r.start + len(r.chunk)] == r.chunk for r in chunks)
    assert [len(r.chunk.split()) for r in chunks] == [100] * 12 + [40] and chunks[-1].chunk.endswith("Word499 é.")


def test_lexicon_takes_the_longest_whole_word(spark):
    got = E.lexicon_ner(papers(spark, "mgmt methylation, XMGMT and MGMT; gbm")).orderBy("start").collect()
    assert [(r.text, r.label, r.start, r.normalized_text) for r in got] == [("mgmt methylation", "BIOMARKER", 0, "mgmt methylation"), ("MGMT", "GENE", 28, "MGMT"), ("gbm", "DISEASE", 34, "glioblastoma")]


def test_relations_stay_in_their_sentence(spark):
    docs = papers(spark, "MGMT methylation predicts response. EGFR is separate.", "MGMT methylation matters. It predicts response.")
    got = E.extract_relations(docs, E.lexicon_ner(docs)).collect()
    assert [(r.pmid, r.head_key, r.relation, r.tail_key, r.trigger, r.confidence) for r in got] == [("0", "MGMT methylation", "PREDICTS", "response", "predicts", 0.62)]


@pytest.mark.parametrize("text,tier", [("A randomised phase II trial in patients", 5), ("phase 2 cohort", 4), ("Patients and mouse", 3), ("murine organoids", 2), ("in vitro", 1), ("nothing", 0), ("", 0)])
def test_evidence(spark, text, tier):
    assert one(spark, E.evidence(F.lit(text))["tier"]) == tier


def test_cleaning(spark):
    assert one(spark, T.clean_text(F.lit("  a&amp;b \x01 c&lt;\n"))) == "a&b c<"
    assert one(spark, T.clean_text(F.lit("&eacute;&#233;&copy 1 &amp;lt; &nosuch; R&D"))) == "éé© 1 &lt; &nosuch; R&D"
    assert one(spark, T.clean_text(F.lit("&eacute;&lt"))) == "é<"
    assert one(spark, T.source_text(F.lit("&alpha;"), F.lit(None).cast("string"))) == "α" and one(spark, T.clean_text(F.lit(None).cast("string"))) == ""
    assert one(spark, T.join_sections(F.array(F.lit("a &beta;"), F.lit(""), F.lit("b")))) == "a β b"
    assert one(spark, T.evidence_tier(F.lit(" label_4 "))) == 4 and one(spark, T.evidence_tier(F.lit("LABEL_9"))) is None
    assert one(spark, T.entity_label(F.lit("B-cell_type"))) == "CELL_TYPE" and one(spark, T.entity_label(F.lit("?"))) == "UNKNOWN"


def test_negated_phrases_are_not_findings(spark):
    got = E.phrase_scan(papers(spark, "This must not be a treatment recommendation.", "A treatment recommendation."), notice="x").collect()
    assert sorted((r.pmid, r.finding_type) for r in got) == [("0", "missing_research_warning"), ("1", "missing_research_warning"), ("1", "prohibited_assertion")]


def edges(spark, *rows):
    return spark.createDataFrame([(r, i, "Drug", h, "TARGETS", "Gene", t, r, tier, c, {}) for r, i, h, t, tier, c in rows], "record_id string, relation_index int, head_label string, head_key string, relation string, tail_label string, tail_key string, source_id string, evidence_tier int, confidence double, properties map<string,string>")


def test_merge_is_idempotent_and_takes_the_largest(spark):
    e = edges(spark, ("1", 1, "a", "x", 1, 0.5), ("2", 1, "a", "x", 4, 0.2), ("3", 1, "b", "x", 0, 0.9))
    once, twice = (sorted(map(str, G.merge_edges(d).collect())) for d in (e, e.unionByName(e)))
    assert once == twice
    m = G.merge_edges(e).where("head_key = 'a'").first()
    assert (m.evidence_tier, m.confidence, m.citations, m.created_from) == (4, 0.5, 2, "1")
    assert sorted(r.source_id for r in G.edge_sources(e.unionByName(e)).where("head_key = 'a'").collect()) == ["1", "2"]
    assert G.edge_sources(e, most=1).count() == 2


def test_small_functions(spark):
    assert one(spark, T.item_id("relation", F.lit(7), F.lit("x"))) == "relation:7:x"
    assert one(spark, T.item_id("relation", F.lit(None), F.lit("x"))) is None
    assert tuple(one(spark, T.shift_span(F.lit(2), F.lit(5), F.lit(100)))) == (102, 105)
    rows = spark.createDataFrame([("9", "2024"), ("10", "2024"), ("7", None), ("8", "2024-05")], "record_id string, publication_date string")
    assert [r.record_id for r in G.recent_records(rows, 3).collect()] == ["8", "9", "10"]
    records = spark.createDataFrame([("1", ["a", "b"]), ("2", []), ("3", None)], "id string, relations array<string>")
    assert [tuple(r) for r in G.numbered_relations(records, "id").collect()] == [("1", 1, "a"), ("1", 2, "b")]


def test_runs_are_browsed_latest_first(spark):
    columns = "run_id string, created_at string, warning_count int, predictions_path string, graph_path string"
    runs = spark.createDataFrame([("Run-A", "1", 0, "in/Strasse.jsonl", None), ("run-b", "2", 3, "in/y", "g/STRASSE"), ("c", "3", 1, None, None)], columns)
    ids = lambda **k: [r.run_id for r in R.browse_runs(runs, paths=("predictions_path", "graph_path"), limit=5, **k).collect()]
    assert ids() == ["c", "run-b", "Run-A"]
    assert ids(run_id="RUN") == ["run-b", "Run-A"]
    assert ids(path_contains="straße") == ["run-b", "Run-A"]
    assert ids(path_contains="straße", warnings_only=True) == ["run-b"]


def test_examples_and_seeds_follow_decisions(spark):
    items = spark.createDataFrame(
        [("1", "evidence_claim", 3, None, "accepted"), ("1", "graph_relation", 2, " TARGETS", "corrected"), ("2", "evidence_claim", None, None, "accepted"), ("3", "evidence_claim", 1, None, "pending"), ("4", "graph_relation", 1, "X", "rejected")],
        "source_pmid string, item_type string, tier int, relation_type string, review_status string",
    )
    shown = lambda df: sorted((r.source_pmid, r.task, r.label) for r in df.collect())
    assert shown(D.annotation_examples(items)) == [("1", "evidence", "3"), ("1", "relation", "TARGETS")]
    assert shown(D.annotation_examples(items, include_pending=True))[-1] == ("3", "evidence", "1")
    ner = spark.createDataFrame([("9", "GENE")], "source_pmid string, label string")
    assert shown(D.gold_seed(items, ner))[-1] == ("9", "ner", "GENE")
    assert {r.review_status: r.n for r in D.skipped_decisions(items).collect()} == {"pending": 1, "rejected": 1}
    with pytest.raises(ValueError):
        D.gold_seed()


def test_entity_observations(spark):
    m = spark.createDataFrame([("1", 2, 5, " ", "Norm", "GENE"), ("1", 2, 5, "abc", "Norm", "GENE")], "pmid string, start int, end int, text string, normalized_text string, label string")
    a, b = E.entity_observations(m).orderBy("item_id").collect()
    assert (a.item_id, b.item_id) == ("ner:1:2:5:GENE:Norm", "ner:1:2:5:GENE:abc")
    assert a.identity == b.identity and a.text_hash != b.text_hash


def test_overlay_reverts(spark):
    e = edges(spark, ("1", 1, "a", "x", 1, 0.5), ("2", 1, "a", "x", 4, 0.2))
    curated = spark.createDataFrame([("p1", "1", 3, "accepted"), ("p2", "1", 5, "pending"), ("p3", "9", 2, "accepted")], "item_id string, source_pmid string, curated_evidence_tier int, review_status string")
    over = R.evidence_overlay(e, curated)
    assert {(r.record_id, r.change) for r in R.overlay_diff(e, over).collect()} == {("1", "increased"), ("2", "unchanged")}
    assert sorted(map(str, R.overlay_revert(over).collect())) == sorted(map(str, e.collect()))


def test_decisions(spark):
    e = edges(spark, ("1", 1, "a", "x", 1, 0.5), ("1", 2, "a", "y", 1, 0.5), ("1", 3, "a", "z", 1, 0.5), ("1", 4, "a", "w", 1, 0.5))
    d = spark.createDataFrame([("relation:1:1", "rejected", None, None), ("relation:1:2", "corrected", "INHIBITS", 5), ("relation:1:3", "pending", None, None)], "item_id string, review_status string, corrected_relation string, corrected_tier int")
    got = {r.relation_index: (r.relation, r.evidence_tier) for r in R.apply_decisions(e, d).collect()}
    assert got == {2: ("INHIBITS", 5), 3: ("TARGETS", 1), 4: ("TARGETS", 1)}


@pytest.mark.parametrize("n,want", [(1, (1, 0, 0)), (2, (1, 1, 0)), (3, (1, 1, 1)), (10, (8, 1, 1)), (25, (21, 2, 2)), (100, (80, 10, 10))])
def test_split_sizes(spark, n, want):
    v, t = one(spark, F.struct(*[c.cast("int").alias(x) for c, x in zip(D.split_sizes(F.lit(n)), "vt")]))
    assert (n - v - t, v, t) == want


def test_groups_stay_together(spark):
    rows = spark.createDataFrame([(str(i % 20) if i % 21 else None, "t", "l", str(i)) for i in range(200)], "source_pmid string, task string, label string, item_id string")
    split = D.split_by_group(rows, "source_pmid")
    assert D.leakage(split, "source_pmid", "split").count() == 0 and split.count() == 200
    assert {r.split for r in split.where("source_pmid is null").collect()} == {"train"}


def test_negatives_are_never_positive(spark):
    p = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (2, "a", "b")], "group_id int, head string, tail string")
    every = {(1, "b", "a"), (1, "c", "b"), (1, "a", "c"), (1, "c", "a"), (2, "b", "a")}
    take = lambda **how: {(r.group_id, r.head, r.tail) for r in D.negative_samples(p, **how).collect()}
    assert take(ratio=9) == every and len(take()) == 3 and take() < every
    assert len(take(ratio=9, most=2)) == 2 and len(take(ratio=0.1)) == 1 and not take(ratio=0)


def test_negative_report_counts_what_is_skipped(spark):
    p = spark.createDataFrame([(1, "a", "b"), (2, "a", " "), (3, "a", "a"), (None, None, "b")], "group_id int, head string, tail string")
    got = D.negative_report(p, D.negative_samples(p)).first()
    assert got.asDict() == {"positive": 4, "negative": 1, "skipped": 3, "warnings": ""}
    none = p.where("false")
    assert D.negative_report(none, D.negative_samples(none)).first().warnings == "no positive relation examples found"


def test_governance_verdict(spark):
    leaks = spark.createDataFrame([("test", "train", 2)], "a string, b string, shared long")
    ready, counts = spark.createDataFrame([("t", True)], "task string, ready boolean"), spark.createDataFrame([("t", 3)], "key string, n long")
    assert {r.check: r.passed for r in D.governance(leaks, ready, counts).collect()} == {"leakage:test:train": False, "readiness:t": True, "rows:t": True, "overall": False}
    assert D.governance(leaks.where("false"), ready, counts).where("check = 'overall'").first().passed


def test_numbers_over_ranges(spark):
    rows = spark.range(1000).withColumn("k", F.xxhash64("id")).repartition(7)
    got = R.number_rows(rows, ["k"]).orderBy("k").select("rn").collect()
    assert [r.rn for r in got] == list(range(1, 1001))


def test_batches_are_final_only_when_all_is_decided(spark):
    rows = spark.createDataFrame(
        [
            ("a", "1", "evidence_claim", "7", "t", "accepted", 3, None),
            ("a", "2", "graph_relation", "7", None, "accepted", None, "TARGETS"),
            ("b", "3", "evidence_claim", "8", "t", "accepted", None, None),
            ("b", "4", "graph_relation", "8", None, "accepted", 1, " "),
            ("c", "5", "evidence_claim", "9", "t", None, 2, None),
            ("d", "6", "evidence_claim", "9", "t", "rejected", 2, None),
        ],
        "batch string, item_id string, item_type string, source_pmid string, text string, review_status string, tier int, relation_type string",
    )
    final = R.finalize_batches(rows, "batch")
    assert {r.batch: (r.ready, r.warnings) for r in final.collect()} == {
        "a": (True, ""),
        "b": (False, "accepted evidence without a tier; accepted relations without a type"),
        "c": (False, "rows are pending; no accepted evidence"),
        "d": (False, "no accepted evidence"),
    }
    assert [(r.item_id, r.label) for r in R.accepted_examples(rows, final, "batch").collect()] == [("1", 3)]
    assert R.finalize_batches(rows.limit(0), "batch").count() == 0


def test_handoff_tells_changed_missing_and_required_tables(spark):
    a, b = spark.range(5), spark.range(3)
    manifest = R.handoff({"a": a, "b": b, "e": a.limit(0)})
    got = R.handoff_problems(manifest, {"a": a.orderBy("id", ascending=False), "b": spark.range(1, 4), "e": a.limit(0)}, ("a", "z"))
    assert {(r.artifact, r.problem) for r in got.collect()} == {("b", "checksum mismatch"), ("z", "not in the manifest")}
    assert [(r.artifact, r.problem) for r in R.handoff_problems(manifest, {"a": a, "b": b}).collect()] == [("e", "missing")]


def test_reviewed_rows_stay_when_a_queue_opens(spark):
    items = spark.createDataFrame([("1", ["x"]), ("2", ["y"])], "item_id string, reasons array<string>")
    done = spark.createDataFrame([("2", "accepted", "bea")], "item_id string, review_status string, reviewer string")
    got = {r.item_id: (r.review_status, r.reviewer, r.source_sha256 is None) for r in R.open_queue(items, done, "ann").collect()}
    assert got == {"1": ("pending", "ann", False), "2": ("accepted", "bea", True)}


def test_tokenizer_pads_and_masks(spark):
    rows = spark.createDataFrame([(1, "a bb ccc"), (2, None), (3, "")], "id long, text string")
    got = D.tokenize(rows, lambda texts: [[len(w) for w in t.split()] for t in texts], ("id",), multiple=4).withColumn("labels", D.mask_labels("attention_mask", F.lit(9))).orderBy("id").collect()
    assert (got[0].input_ids, got[0].attention_mask, got[0].labels) == ([1, 2, 3, 0], [1, 1, 1, 0], [9, 9, 9, -100])
    assert got[1].input_ids == got[2].input_ids == []


def test_governance_blocks_on_drift_only_if_strict(spark):
    leaks = spark.createDataFrame([], "a string, b string, shared long")
    ready, counts = spark.createDataFrame([("t", True)], "task string, ready boolean"), spark.createDataFrame([("t", 3)], "key string, n long")
    drift = spark.createDataFrame([("train", "x", "")], "split string, unexpected string, missing string")
    verdict = lambda strict: {r.check: r.passed for r in D.governance(leaks, ready, counts, drift, strict=strict).collect()}["overall"]
    assert verdict(False) and not verdict(True)


def test_gold_pack_repairs_and_counts(spark):
    seed = spark.createDataFrame([(str(i), "ner", None if i % 2 else "a", "t", "b") for i in range(20)], "source_pmid string, task string, label string, text string, source string")
    pack = D.gold_pack(seed, "source")
    assert pack["rows"].where("repaired").count() == 10 and [(r.label, r.id) for r in pack["labels"].orderBy("id").collect()] == [("a", 0), ("b", 1)]
    assert {(r.name, r.value) for r in D.pack_report(pack).where("section = 'rows'").collect()} == {("train", 16.0), ("validation", 2.0), ("test", 2.0)}


def test_stratified_splits_take_null_and_single_labels(spark):
    rows = spark.createDataFrame([("t", "a", i) for i in range(20)] + [("t", None, i) for i in range(20, 30)] + [("t", "b", 30)], "task string, label string, item_id long")
    got = {(r.label, r.split): r["count"] for r in D.split_stratified(rows, "item_id").groupBy("label", "split").count().collect()}
    assert got == {("a", "train"): 16, ("a", "validation"): 2, ("a", "test"): 2, (None, "train"): 8, (None, "validation"): 1, (None, "test"): 1, ("b", "train"): 1}
    assert D.split_stratified(rows.limit(0), "item_id").count() == 0

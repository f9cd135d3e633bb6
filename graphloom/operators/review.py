"""Review queues, decisions applied to graphs and predictions, overlays, batches."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import rules
from graphloom.functions.text import active_learning_reasons, candidate_priority, casefold, evidence_tier, prediction_reasons, review_reasons, said, tier_shift
from graphloom.functions.unicode import bind
from graphloom.operators.search import TextIndex, search

ITEM = ("item_id", "item_type", "source_pmid", "evidence_tier", "confidence", "relation_type", "reasons")


def claim_items(claims: DataFrame, most: float = 0.65, hypothesis: bool = True) -> DataFrame:
    """claims: pmid, tier, confidence."""
    out = claims.select(F.concat(F.lit("evidence:"), "pmid").alias("item_id"), F.lit("evidence_claim").alias("item_type"), F.col("pmid").alias("source_pmid"), F.col("tier").alias("evidence_tier"), "confidence", F.lit("").alias("relation_type"), review_reasons(F.col("confidence"), F.col("tier"), most, hypothesis).alias("reasons"))
    return out.where(F.size("reasons") > 0)


def relation_items(edges: DataFrame, most: float = 0.65, hypothesis: bool = True) -> DataFrame:
    item = F.concat_ws(":", F.lit("relation"), "record_id", F.col("relation_index").cast("string"))
    out = edges.select(item.alias("item_id"), F.lit("graph_relation").alias("item_type"), F.col("record_id").alias("source_pmid"), "evidence_tier", "confidence", F.col("relation").alias("relation_type"), review_reasons(F.col("confidence"), F.col("evidence_tier"), most, hypothesis).alias("reasons"))
    return out.where(F.size("reasons") > 0)


def review_queue(claims: DataFrame | None, edges: DataFrame | None, most: float = 0.65, hypothesis: bool = True) -> DataFrame:
    parts = ([claim_items(claims, most, hypothesis)] if claims is not None else []) + ([relation_items(edges, most, hypothesis)] if edges is not None else [])
    if not parts:
        raise ValueError("claims or edges are needed")
    return functools.reduce(DataFrame.unionByName, parts)


def counts_by(rows: DataFrame, *columns: str) -> DataFrame:
    """facet, key, n: counts by each column, in one pass (grouping sets)."""
    some = rows.select(*[F.col(c).cast("string").alias(c) for c in columns])
    sets = [[F.col(c)] for c in columns]
    out = some.groupingSets(sets, *[F.col(c) for c in columns]).agg(F.count("*").alias("n"), *[F.grouping(c).alias(f"_{c}") for c in columns])
    facet, key = F, F
    for c in columns:
        facet, key = facet.when(F.col(f"_{c}") == 0, c), key.when(F.col(f"_{c}") == 0, F.col(c))
    return out.select(facet.alias("facet"), key.alias("key"), "n")


def queue_summary(queue: DataFrame) -> DataFrame:
    """facet, key, n by item type, tier, relation type and reason."""
    reasons = queue.select(F.explode("reasons").alias("reason"))
    return counts_by(queue, "item_type", "evidence_tier", "relation_type").unionByName(counts_by(reasons, "reason"))


def item_problems(status: Column, notes: Column, corrected: Column) -> Column:
    """Messages on a review row that contradicts itself."""
    blank = F.trim(F.coalesce(notes, F.lit(""))) == ""
    return said(
        (~status.isin(*rules.REVIEW_STATUSES), "unknown review status"),
        ((status == "corrected") & blank, "corrected items require review_notes"),
        ((status == "corrected") & corrected.isNull(), "corrected items require a correction"),
        ((status == "rejected") & blank, "rejected items require review_notes"),
        ((status == "accepted") & corrected.isNotNull(), "accepted items must not include corrections"),
    )


def prediction_problems(status: Column, notes: Column, corrected: Column, predicted: Column) -> Column:
    return F.concat(item_problems(status, notes, corrected), said(((status == "accepted") & predicted.isNull(), "accepted predictions require a valid predicted evidence tier")))


def apply_decisions(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """edges joined with decisions (item_id, review_status, corrected_relation, corrected_tier): rejected go, corrected
    are rewritten, accepted are tagged, pending and undecided stay as they are."""
    item = F.concat_ws(":", F.lit("relation"), "record_id", F.col("relation_index").cast("string"))
    met = edges.withColumn("item_id", item).join(decisions, "item_id", "left")
    status = F.coalesce("review_status", F.lit("pending"))
    fix = status == "corrected"
    kept = met.where(status != "rejected")
    return kept.withColumn("relation", F.when(fix, F.coalesce("corrected_relation", "relation")).otherwise(F.col("relation"))).withColumn("evidence_tier", F.when(fix, F.coalesce("corrected_tier", "evidence_tier")).otherwise(F.col("evidence_tier"))).withColumn("curation_status", F.when(status.isin("accepted", "corrected"), status)).drop("review_status", "corrected_relation", "corrected_tier")


def change_log(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """item_id, action, detail of rejected and corrected relations."""
    item = F.concat_ws(":", F.lit("relation"), "record_id", F.col("relation_index").cast("string"))
    met = edges.withColumn("item_id", item).join(decisions, "item_id").where(F.col("review_status").isin("rejected", "corrected"))
    changed = said(
        (F.col("corrected_relation") != F.col("relation"), F.concat(F.lit("relation "), "relation", F.lit(" -> "), "corrected_relation")),
        (F.col("corrected_tier") != F.col("evidence_tier"), F.concat(F.lit("evidence tier "), F.col("evidence_tier").cast("string"), F.lit(" -> "), F.col("corrected_tier").cast("string"))),
    )
    detail = F.when(F.col("review_status") == "rejected", "").otherwise(F.when(F.size(changed) > 0, F.array_join(changed, "; ")).otherwise("curation metadata added"))
    return met.select("item_id", F.col("review_status").alias("action"), detail.alias("detail"))


def curated_evidence(predictions: DataFrame, decisions: DataFrame) -> DataFrame:
    """predictions (item_id, source_pmid, prediction, confidence) with decisions: rejected go, none is pending, the tier
    is the corrected or the predicted one."""
    met = predictions.join(decisions, "item_id", "left").withColumn("review_status", F.coalesce("review_status", F.lit("pending")))
    tier = F.coalesce(F.when(F.col("review_status") == "corrected", F.col("corrected_tier")), evidence_tier("prediction"))
    return met.where("review_status <> 'rejected'").select("item_id", "source_pmid", "prediction", "confidence", "review_status", tier.alias("curated_evidence_tier"))


def reviewed_summary(decisions: DataFrame) -> DataFrame:
    """Per review status: n, new_relations, new_tiers."""
    return decisions.groupBy("review_status").agg(F.count("*").alias("n"), F.count("corrected_relation").alias("new_relations"), F.count("corrected_tier").alias("new_tiers"))


def curated_audit(curated: DataFrame) -> DataFrame:
    """Per review status: n, invalid_tier, unlinked (items whose id is not that of their paper)."""
    unlinked = ~F.col("item_id").eqNullSafe(F.concat(F.lit("prediction:"), "source_pmid"))
    return curated.groupBy("review_status").agg(F.count("*").alias("n"), F.count_if(F.col("curated_evidence_tier").isNull()).alias("invalid_tier"), F.count_if(unlinked).alias("unlinked"))


def search_curated(
    curated: DataFrame, pmid: str = "", tier: int | None = None, reviewer: str = "", status: str = "", checkpoint: str = "", text: str = "", index: TextIndex | None = None, limit: int | None = None
) -> DataFrame:
    """Curated rows by paper, tier, status, and texts of any case within reviewer, checkpoint_name and text. With an index over
    the rows' text only rows that hold the text are read; with a limit the first by item_id are taken."""
    out = search(index, text) if index is not None and text else curated
    holds = lambda c, x: F.contains(casefold(F.coalesce(F.col(c), F.lit(""))), F.lit(x.casefold()))
    wanted = [(pmid, lambda: F.col("source_pmid") == pmid), (tier is not None, lambda: F.col("curated_evidence_tier") == tier), (reviewer, lambda: holds("reviewer", reviewer)), (status, lambda: F.col("review_status") == status)]
    wanted += [(checkpoint, lambda: holds("checkpoint_name", checkpoint)), (text and index is None, lambda: holds("text", text))]
    for given, condition in wanted:
        if given:
            out = out.where(condition())
    return out if limit is None else out.orderBy("item_id").limit(limit)


def texts_held(rows: DataFrame, column: str, texts: tuple[str, ...]) -> DataFrame:
    """Rows whose column holds one of the texts, of any case, with the array `held` of those it holds in place of the column. The
    column is read and folded once for all texts: for a few searches that is far less work than an index of its grams."""
    hit = bind(casefold(F.coalesce(F.col(column), F.lit(""))), lambda v: said(*[(F.contains(v, F.lit(t.casefold())), t) for t in texts]))
    return rows.withColumn("held", hit).drop(column).where(F.size("held") > 0)


def browse_runs(runs: DataFrame, run_id: str = "", path_contains: str = "", warnings_only: bool = False, limit: int | None = None, paths: tuple[str, ...] = ("predictions_path", "graph_path", "reviewed_queue_path", "overlay_graph_path", "handoff_bundle_path")) -> DataFrame:
    """Registered runs (run_id, created_at, warning_count, paths), the latest first, by texts of any case within the id and within
    the paths, joined by a space."""
    holds = lambda c, x: F.contains(casefold(c), F.lit(x.casefold()))
    out = runs
    if run_id:
        out = out.where(holds(F.col("run_id").cast("string"), run_id))
    if path_contains:
        out = out.where(holds(F.concat_ws(" ", *(F.coalesce(F.col(p), F.lit("")) for p in paths)), path_contains))
    if warnings_only:
        out = out.where("warning_count > 0")
    return out if limit is None else out.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


def load_guard(overlay: DataFrame) -> DataFrame:
    """One row of an overlaid edge table: relations, overlay_relations, pending, missing_original, safe_to_load."""
    p = F.col("properties")
    over = F.map_contains_key(p, "evidence_overlay_tier")
    out = overlay.agg(F.count("*").alias("relations"), F.count_if(over).alias("overlay_relations"), F.count_if(over & (p["evidence_overlay_review_status"] == "pending")).alias("pending"), F.count_if(over & ~F.map_contains_key(p, "evidence_overlay_original_tier")).alias("missing_original"))
    return out.withColumn("safe_to_load", (F.col("relations") > 0) & (F.col("overlay_relations") > 0) & (F.col("pending") == 0) & (F.col("missing_original") == 0))


def quality_gate(guard: DataFrame) -> DataFrame:
    """name, passed, all_passed: load_guard()'s row as checks."""
    check = lambda name, passed: F.struct(F.lit(name).alias("name"), passed.alias("passed"))
    checks = F.array(check("relations", F.col("relations") > 0), check("overlay", F.col("overlay_relations") > 0), check("pending", F.col("pending") == 0))
    return guard.select(F.inline(checks), F.col("safe_to_load").alias("all_passed"))


def evidence_overlay(edges: DataFrame, curated: DataFrame, pending: bool = False) -> DataFrame:
    """Sets the tier of a paper's edges to the best curated tier of the paper (one row a paper before the join); keeps
    the original in the properties."""
    rows = curated.where("curated_evidence_tier is not null" + ("" if pending else " and review_status <> 'pending'"))
    best = rows.groupBy(F.col("source_pmid").alias("record_id")).agg(F.max_by(F.struct("curated_evidence_tier", "review_status", "item_id"), F.struct("curated_evidence_tier", "item_id")).alias("b"))
    met = edges.join(best, "record_id", "left")
    hit = F.col("b").isNotNull() & (F.col("evidence_tier") != F.col("b.curated_evidence_tier"))
    extra = F.create_map(F.lit("evidence_overlay_tier"), F.col("b.curated_evidence_tier").cast("string"), F.lit("evidence_overlay_original_tier"), F.col("evidence_tier").cast("string"), F.lit("evidence_overlay_review_status"), F.col("b.review_status"), F.lit("evidence_overlay_item_id"), F.col("b.item_id"))
    out = met.withColumn("properties", F.when(hit, F.map_concat("properties", extra)).otherwise(F.col("properties")))
    return out.withColumn("evidence_tier", F.when(hit, F.col("b.curated_evidence_tier")).otherwise(F.col("evidence_tier"))).drop("b").select(edges.columns)


def overlay_revert(edges: DataFrame) -> DataFrame:
    original = F.element_at("properties", "evidence_overlay_original_tier").cast("int")
    return edges.withColumn("evidence_tier", F.coalesce(original, "evidence_tier")).withColumn("properties", F.map_filter("properties", lambda k, _: ~k.startswith("evidence_overlay_")))


def overlay_diff(raw: DataFrame, overlay: DataFrame) -> DataFrame:
    """record_id, relation_index, change, before, after of every relation on either side."""
    keys = ["record_id", "relation_index"]
    a, b = raw.select(*keys, F.col("evidence_tier").alias("before")), overlay.select(*keys, F.col("evidence_tier").alias("after"))
    met = a.join(b, keys, "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise(tier_shift(F.col("before"), F.col("after"))["direction"])
    return met.select(*keys, change.alias("change"), "before", "after")


def enrich_qualifiers(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """Fills empty qualifiers (species_model, trial_phase, evidence_context) from sentence and paper; lists the added."""
    from graphloom.functions.text import qualifiers

    names = ("species_model", "trial_phase", "evidence_context")
    context = F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("sentence", "paper_text")])
    met = edges.join(papers, "record_id", "left").withColumn("q", qualifiers(F.col("relation"), context))
    added = F.array_compact(F.array(*[F.when(F.col(n).isNull() & F.col(f"q.{n}").isNotNull(), F.lit(n)) for n in names]))
    out = met.withColumn("added", added)
    return functools.reduce(lambda d, n: d.withColumn(n, F.coalesce(n, f"q.{n}")), names, out).drop("q", "paper_text")


def active_learning(predictions: DataFrame, graph_pmids: DataFrame, least: float = 0.8, limit: int | None = None) -> DataFrame:
    """predictions with reasons to review them and a priority; the highest first if there is a limit."""
    known = graph_pmids.select(F.col("pmid").alias("source_pmid")).distinct().withColumn("in_graph", F.lit(True))
    met = predictions.join(known, "source_pmid", "left")
    base = prediction_reasons(F.col("confidence"), F.col("checkpoint_status"), F.col("prediction"), F.col("warning"), least)
    reasons = active_learning_reasons(base, F.coalesce("in_graph", F.lit(False)), F.col("prediction"), F.col("source_pmid"), F.col("text"))
    out = met.withColumn("reasons", reasons).where(F.size("reasons") > 0).withColumn("priority", candidate_priority("reasons")).drop("in_graph")
    return out if limit is None else out.orderBy(F.desc("priority"), "source_pmid", "item_id").limit(limit)


def number_rows(rows: DataFrame, order: list, name: str = "rn") -> DataFrame:
    """1, 2, ... over a total order without a window over everything: ranges, their sizes, then a number in each range."""
    from pyspark.sql.functions import spark_partition_id

    from graphloom.sources.tables import written

    ranged = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), tidy=True)
    first = ranged.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    return ranged.join(F.broadcast(first.select("part", "first", before.alias("before"))), "part").withColumn(name, F.col("at") - F.col("first") + F.col("before") + 1).drop("part", "at", "first", "before")


def plan_batches(candidates: DataFrame, order: list, size: int = 25) -> DataFrame:
    rows = number_rows(candidates, order)
    index = F.ceil(F.col("rn") / size).cast("long")
    return rows.withColumn("batch_index", index).withColumn("batch_position", ((F.col("rn") - 1) % size + 1).cast("long")).withColumn("batch_id", F.format_string("ALBATCH-%03d", "batch_index")).drop("rn")


def batch_status(batches: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Per batch: rows, decided rows and a status; reviewed rows (item_id, review_status) override the batch's."""
    now = batches.join(reviewed.select("item_id", F.col("review_status").alias("new_status")), "item_id", "left").withColumn("s", F.coalesce("new_status", "review_status", F.lit("pending")))
    out = now.groupBy("batch_id").agg(F.count("*").alias("items"), F.count_if(F.col("s") == "pending").alias("pending"), F.count_if(F.col("s").isin("accepted", "corrected")).alias("kept"), F.count_if(F.col("s") == "rejected").alias("rejected"))
    return out.withColumn("status", F.when(F.col("pending") == 0, "complete").when(F.col("pending") < F.col("items"), "in_review").otherwise("planned"))


def finalize_batches(rows: DataFrame, *by: str) -> DataFrame:
    """rows: by, item_type, review_status, tier, relation_type. Per batch its counts, warnings and `ready`: no row pending,
    each accepted claim with a tier, each accepted relation with a type, and one accepted claim at least."""
    status = F.coalesce("review_status", F.lit("pending"))
    claim, relation = [(status == "accepted") & (F.col("item_type") == t) for t in ("evidence_claim", "graph_relation")]
    untyped = relation & (F.trim(F.coalesce("relation_type", F.lit(""))) == "")
    counts = {"pending": status == "pending", "rejected": status == "rejected", "accepted_evidence": claim, "accepted_relations": relation, "_tier": claim & F.col("tier").isNull(), "_type": untyped}
    out = rows.groupBy(*by).agg(F.count("*").alias("reviewed"), *[F.count_if(c).alias(n) for n, c in counts.items()])
    warnings = said(
        (F.col("pending") > 0, "rows are pending"),
        (F.col("_tier") > 0, "accepted evidence without a tier"),
        (F.col("_type") > 0, "accepted relations without a type"),
        (F.col("accepted_evidence") == 0, "no accepted evidence"),
    )
    out = out.withColumn("warnings", F.array_join(warnings, "; ")).drop("_tier", "_type")
    return out.withColumn("ready", F.col("warnings") == "")


def accepted_examples(rows: DataFrame, final: DataFrame, *by: str) -> DataFrame:
    """The accepted claims of the batches that finalize_batches() finds ready, as evidence examples."""
    ready = final.where("ready").select(*by)
    kept = rows.join(ready, list(by), "left_semi").where("review_status = 'accepted' and item_type = 'evidence_claim'")
    return kept.select("item_id", F.trim("source_pmid").alias("source_pmid"), F.lit("evidence").alias("task"), F.col("tier").alias("label"), F.coalesce("text", F.lit("")).alias("text"), F.lit(rules.NOTICE).alias("warning"))


def open_queue(items: DataFrame, reviewed: DataFrame, reviewer: str = "") -> DataFrame:
    """Queue items as pending rows of a reviewer, with a hash of the item they were made from; rows that are reviewed already
    (item_id, review_status, reviewer) stay as they are."""
    made = F.sha2(F.concat_ws("|", "item_id", F.array_join("reasons", "; ")), 256)
    new = items.select("item_id", F.lit("pending").alias("review_status"), F.lit(reviewer).alias("reviewer"), made.alias("source_sha256"))
    return upsert(new, reviewed.select("item_id", "review_status", "reviewer"), "item_id")


def handoff(tables: dict[str, DataFrame]) -> DataFrame:
    """artifact, rows, digest (of the rows in any order) of tables handed over."""
    one = lambda name, df: df.select(F.xxhash64(F.to_json(F.struct("*"))).alias("h")).agg(F.lit(name).alias("artifact"), F.count("*").alias("rows"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("digest"))
    return functools.reduce(DataFrame.unionByName, [one(n, t) for n, t in tables.items()])


def handoff_problems(manifest: DataFrame, tables: dict[str, DataFrame], required: tuple[str, ...] = ()) -> DataFrame:
    """artifact, problem of a manifest's tables that are missing or have other rows now, and of required ones it lacks."""
    now = handoff(tables).select("artifact", F.col("digest").alias("now"))
    want = F.explode(F.array(*map(F.lit, required)).cast("array<string>")).alias("artifact")
    all_of = manifest.join(manifest.sparkSession.range(1).select(want), "artifact", "full_outer").join(now, "artifact", "left")
    problem = F.when(F.col("digest").isNull(), "not in the manifest").when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("digest"), "checksum mismatch")
    return all_of.select("artifact", problem.alias("problem")).where("problem is not null")


def export_batch(batches: DataFrame, batch_id: str, path: str, columns: list[str], reviewer: str = "", status: str = "in_review") -> None:
    """A batch's rows as CSV with a header for a reviewer to edit: the columns, who is assigned (the reviewer given, else one
    of the row) and the batch's status."""
    have = set(batches.columns)
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) if c in have else F.lit(None).cast("string")
    assigned = F.coalesce(F.nullif(F.lit(reviewer), F.lit("")), *map(text, ("assigned_reviewer", "reviewer_id", "reviewer")), F.lit(""))
    state = F.coalesce(F.nullif(F.lit(status), F.lit("")), text("batch_status"), F.lit("in_review"))
    rows = batches.where(F.col("batch_id") == batch_id)
    kept = [F.array_join(c, "; ").alias(c) if dict(batches.dtypes)[c].startswith("array") else F.col(c) for c in columns]
    rows.select(*kept, assigned.alias("assigned_reviewer"), state.alias("batch_status")).write.option("header", True).option("escape", '"').csv(path)


def import_batch(spark: SparkSession, paths: str | list[str], columns: list[str], decided_at: str) -> DataFrame:
    """Reviewed rows of CSV files: blanks are null, a decided row has the time of its decision, the assigned reviewer stands in
    for a missing one. A row without an item_id or with an unknown status stops the import."""
    from graphloom.functions.text import blank_to_null

    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(paths)
    rows = rows.select(*[blank_to_null(c).alias(c) for c in columns])
    for c in ("assigned_reviewer", "reviewer", "reviewer_id", "review_status", "decision_timestamp_utc"):
        if c not in columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    status = F.coalesce("review_status", F.lit("pending"))
    wrong = F.when(F.col("item_id").isNull(), "a row has no item_id").when(~status.isin(*rules.REVIEW_STATUSES), F.concat("item_id", F.lit(": unknown review status "), status))
    reviewer = F.coalesce("reviewer", "assigned_reviewer")
    return (
        rows.withColumn("review_status", F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(status))
        .withColumn("reviewer", reviewer)
        .withColumn("reviewer_id", F.coalesce("reviewer_id", "reviewer"))
        .withColumn("decision_timestamp_utc", F.coalesce("decision_timestamp_utc", F.when(F.col("review_status") != "pending", F.lit(decided_at))))
    )


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows win over existing ones of the same key."""
    return new.unionByName(existing.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def adjudicate(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """rows: item_id, source, fields. item_id, field, values (source=value, sorted) where sources disagree."""
    long = rows.unpivot(["item_id", "source"], [F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f) for f in fields], "field", "value").where("value <> ''")
    return long.groupBy("item_id", "field").agg(F.count_distinct("value").alias("different"), F.array_sort(F.collect_list(F.concat_ws("=", "source", "value"))).alias("values")).where("different > 1").drop("different")

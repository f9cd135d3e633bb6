"""Training tables: splits, leakage, labels, negatives, readiness, evaluation.

examples: task, item_id, source_pmid, text, label (and what else a task has).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from graphloom.functions.text import first_filled, half_even, said
from graphloom.operators.review import number_rows
from graphloom.sources.tables import written

SPLITS = ("train", "validation", "test")


def split_sizes(total: Column, validation: float = 0.1, test: float = 0.1) -> tuple[Column, Column]:
    """Sizes of validation and test; one of two rows goes to validation, a single row to train, and train keeps one."""
    share = lambda r: F.greatest(F.lit(1), half_even(total * r)) if r > 0 else F.lit(0)
    v, t = share(validation), share(test)
    over = F.greatest(F.lit(0), v + t + 1 - total)
    drop = F.least(over, F.greatest(v - 1, F.lit(0)))
    return F.when(total <= 1, 0).when(total == 2, 1).otherwise(v - drop), F.when(total <= 2, 0).otherwise(t - (over - drop))


def split_of(rank: Column, total: Column, validation: float = 0.1, test: float = 0.1) -> Column:
    v, t = split_sizes(total, validation, test)
    train = total - v - t
    return F.when(rank <= train, "train").when(rank <= train + v, "validation").otherwise("test")


def shuffled(seed: int, *columns: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]), 256)


def few(rows: DataFrame, small: int = 100_000) -> DataFrame:
    """The rows, to be broadcast if they are counted to be few."""
    return F.broadcast(rows) if rows.count() <= small else rows


def split_stratified(rows: DataFrame, key: str, seed: int = 13, validation: float = 0.1, test: float = 0.1) -> DataFrame:
    """Adds `split`: each (task, label) is shuffled by a hash of the key and cut by the size rule. Rows are numbered by ranges
    and a label's first number is taken off, so no task holds a label's rows."""
    placed = number_rows(rows.withColumn("_h", shuffled(seed, "label", key)), ["task", "label", "_h", key], "_r")
    sizes = placed.groupBy(F.col("task").alias("_task"), F.col("label").alias("_label")).agg(F.count("*").alias("_n"), F.min("_r").alias("_first"))
    same = F.col("task").eqNullSafe(F.col("_task")) & F.col("label").eqNullSafe(F.col("_label"))
    split = split_of(F.col("_r") - F.col("_first") + 1, F.col("_n"), validation, test)
    return placed.join(few(sizes), same).withColumn("split", split).drop("_h", "_r", "_n", "_first", "_task", "_label")


def split_by_group(rows: DataFrame, group: str, seed: int = 13, validation: float = 0.1, test: float = 0.1) -> DataFrame:
    """Adds `split`: all rows of a group go together; rows without a group go to train. Groups are numbered by ranges of
    their hash, so no task holds them all."""
    groups = written(rows.where(F.col(group).isNotNull()).select(group).distinct(), tidy=True)
    total = groups.count()
    groups = groups.withColumn("_h", F.unhex(shuffled(seed, group)))  # in the order of its text, half as long
    placed = number_rows(groups, ["_h", group], "_r").select(group, split_of(F.col("_r"), F.lit(total), validation, test).alias("split"))
    return rows.join(placed, group, "left").fillna({"split": "train"})


def leakage(rows: DataFrame, key: str, part: str, most: int = 5) -> DataFrame:
    """Pairs of parts with the keys they share: a, b, shared, first (the least of the keys, up to `most`). Each is an aggregate of
    fixed size a pair that merges map-side: the number, then the least key, the least above it, and so on."""
    one = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(part).alias("p")).distinct()
    parts = one.groupBy("key").agg(F.array_sort(F.collect_set("p")).alias("ps")).where(F.size("ps") > 1)  # at most as many as there are parts
    pairs = F.flatten(F.transform("ps", lambda a: F.transform(F.filter("ps", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    met = written(parts.select("key", F.explode(pairs).alias("x")).select("key", "x.*"))
    out = met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.array(F.min("key")).alias("first"))
    for _ in range(most - 1):
        last = few(out.select("a", "b", F.element_at("first", -1).alias("last")))  # a row for each pair of parts
        above = met.join(last, ["a", "b"]).where(F.col("key") > F.col("last")).groupBy("a", "b").agg(F.min("key").alias("next"))
        out = written(out.join(above, ["a", "b"], "left").select("a", "b", "shared", F.when(F.col("next").isNull(), F.col("first")).otherwise(F.array_append("first", F.col("next"))).alias("first")))
    return out


def label_map(rows: DataFrame) -> DataFrame:
    """task, label, id: dense numbers from 0 in label order."""
    return rows.select("task", "label").distinct().withColumn("id", F.row_number().over(Window.partitionBy("task").orderBy("label")) - 1)


def apply_label_map(rows: DataFrame, labels: DataFrame, small: int = 100_000) -> DataFrame:
    """Adds `id`; a label that the map lacks is an error."""
    out = rows.join(few(labels, small), ["task", "label"], "left")
    return out.withColumn("id", F.when(F.col("id").isNull(), F.raise_error(F.concat(F.lit("unknown label: "), "label")).cast("int")).otherwise(F.col("id")))


def mask_labels(mask: Column | str, label_id: Column) -> Column:
    """The label where the attention mask is 1, -100 elsewhere."""
    return F.transform(mask, lambda m: F.when(m == 1, label_id).otherwise(F.lit(-100)))


def tokenize(rows: DataFrame, tokenizer: Callable[[list[str]], list[list[int]]], keep: tuple[str, ...], multiple: int = 8, most: int | None = None) -> DataFrame:
    """keep, input_ids, attention_mask: texts by a user's tokenizer, a batch at a time, padded with 0 to a multiple of a
    length; cut only if `most` is given. Null texts are empty."""

    def batches(parts):
        for part in parts:
            ids = [x[:most] for x in tokenizer(part["text"].fillna("").tolist())]
            pad = [-len(x) % multiple for x in ids]
            out = part[list(keep)].copy()
            out["input_ids"] = [[*x, *[0] * n] for x, n in zip(ids, pad)]
            out["attention_mask"] = [[1] * len(x) + [0] * n for x, n in zip(ids, pad)]
            yield out

    schema = StructType([*(rows.schema[c] for c in keep), StructField("input_ids", ArrayType(LongType())), StructField("attention_mask", ArrayType(IntegerType()))])
    return rows.select(*keep, "text").mapInPandas(batches, schema)


def repair_labels(rows: DataFrame, *fallbacks: str) -> DataFrame:
    """Fills a missing label from the first filled of other columns; `repaired` tells which."""
    label = first_filled("label", *fallbacks)
    return rows.withColumn("repaired", (F.trim(F.coalesce("label", F.lit(""))) == "") & (label != "")).withColumn("label", label)


def dataset_card(rows: DataFrame, *by: str) -> DataFrame:
    """Per part: rows, labels, missing texts, duplicates (rows less distinct keys)."""
    key = F.struct(F.coalesce("source_pmid", F.lit("")), F.coalesce("text", F.lit("")), F.coalesce("label", F.lit("")))
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.count_distinct("label").alias("labels"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("missing_text"), (F.count("*") - F.count_distinct(key)).alias("duplicates"))


def majority_baseline(train: DataFrame, test: DataFrame) -> DataFrame:
    """Per task the most frequent label (ties: the larger text) and its accuracy on the test rows."""
    best = train.groupBy("task", "label").agg(F.count("*").alias("n")).groupBy("task").agg(F.max_by("label", F.struct("n", "label")).alias("majority"))
    return test.join(few(best), "task").groupBy("task", "majority").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("majority")).cast("double")).alias("accuracy"))


def readiness(rows: DataFrame, per_task: int = 10, per_label: int = 2, dominant: float = 0.85) -> DataFrame:
    """Per task: examples, smallest label, share of the largest, warnings, ready."""
    counts = rows.groupBy("task", "label").agg(F.count("*").alias("n"))
    out = counts.groupBy("task").agg(F.sum("n").alias("examples"), F.min("n").alias("smallest"), (F.max("n") / F.sum("n")).alias("largest_share"))
    warnings = said((F.col("examples") < per_task, "too few examples"), (F.col("smallest") < per_label, "label with too few examples"), (F.col("largest_share") > dominant, "dominant label"))
    return out.withColumn("warnings", F.array_join(warnings, "; ")).withColumn("ready", F.col("warnings") == "")


def evaluate(rows: DataFrame, labels: tuple[str, ...] = ()) -> DataFrame:
    """rows: true, pred. Per label precision, recall, f1, support; over the labels of either side and of `labels`."""
    spark = rows.sparkSession
    cells = rows.groupBy("true", "pred").agg(F.count("*").alias("n"))
    mine = lambda c: cells.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(c))
    hit = cells.where(F.col("true") == F.col("pred")).select(F.col("true").alias("label"), F.col("n").alias("tp"))
    given = spark.createDataFrame([(x,) for x in labels], "label string")
    names = given.unionByName(cells.select(F.col("true").cast("string").alias("label"))).unionByName(cells.select(F.col("pred").cast("string").alias("label"))).distinct()
    met = functools.reduce(lambda d, o: d.join(o, "label", "left"), (mine("true"), mine("pred"), hit), names).fillna(0)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = met.withColumn("precision", ratio(F.col("tp"), F.col("pred"))).withColumn("recall", ratio(F.col("tp"), F.col("true")))
    p, r = F.col("precision"), F.col("recall")
    return out.select("label", "precision", "recall", ratio(2 * p * r, p + r).alias("f1"), F.col("true").alias("support"))


def evaluation_summary(rows: DataFrame, labels: tuple[str, ...] = (), least: int = 10) -> DataFrame:
    """One row: examples, accuracy, macro_f1 (the mean over the labels of evaluate()), warnings."""
    whole = rows.agg(F.count("*").alias("examples"), F.count_if(F.col("true") == F.col("pred")).alias("right"))
    per = evaluate(rows, labels).agg(
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"),
        F.array_sort(F.collect_list(F.when((F.col("support") == 0) & F.col("label").isin(*labels), F.col("label")))).alias("absent"),
    )
    accuracy = F.when(F.col("examples") > 0, F.col("right") / F.col("examples")).otherwise(0.0)
    told = said(
        (F.col("examples") < least, f"fewer than {least} evaluation examples"),
        (F.size("absent") > 0, F.concat(F.lit("label(s) absent from evaluation set: "), F.array_join("absent", ", "))),
    )
    return whole.crossJoin(per).select("examples", accuracy.alias("accuracy"), "macro_f1", F.array_join(told, "; ").alias("warnings"))  # a row each


def confusion_matrix(rows: DataFrame, labels: tuple[str, ...] = ()) -> DataFrame:
    """true, pred, n for every pair of labels of either side and of `labels`, zeros included: a cell a pair of labels."""
    cells = rows.groupBy(F.col("true").cast("string").alias("true"), F.col("pred").cast("string").alias("pred")).agg(F.count("*").alias("n"))
    names = evaluate(rows, labels).agg(F.array_sort(F.collect_set("label")).alias("names"))
    every = names.select(F.explode("names").alias("true"), "names").select("true", F.explode("names").alias("pred"))
    return every.join(cells, ["true", "pred"], "left").fillna(0, ["n"])


DECIDED = ("accepted", "corrected")


def annotation_examples(items: DataFrame, include_pending: bool = False) -> DataFrame:
    """Reviewed items (source_pmid, item_type, tier, relation_type, review_status) as examples: source_pmid, task, label,
    review_status. Claims teach evidence by their tier, relations their type; items without a label teach nothing."""
    kept = items.where(F.col("review_status").isin(*DECIDED, *["pending"] * include_pending))
    claim = F.col("item_type") == "evidence_claim"
    label = F.when(claim, F.col("tier").cast("string")).otherwise(F.nullif(F.trim("relation_type"), F.lit("")))
    out = kept.select("source_pmid", F.when(claim, "evidence").otherwise("relation").alias("task"), label.alias("label"), "review_status")
    return out.where(F.col("label").isNotNull())


def gold_seed(items: DataFrame | None = None, ner: DataFrame | None = None) -> DataFrame:
    """source_pmid, task, label of what was decided, and of entity rows (source_pmid, label); what is pending or rejected is left
    out, see skipped_decisions()."""
    parts = [annotation_examples(items).drop("review_status")] if items is not None else []
    parts += [ner.select("source_pmid", F.lit("ner").alias("task"), "label")] if ner is not None else []
    if not parts:
        raise ValueError("items or entity rows are needed")
    return functools.reduce(DataFrame.unionByName, parts)


def skipped_decisions(items: DataFrame) -> DataFrame:
    """review_status, n of the items that gold_seed() leaves out by their status."""
    return items.where(F.col("review_status").isin("pending", "rejected")).groupBy("review_status").agg(F.count("*").alias("n"))


def _trimmed(positives: DataFrame) -> DataFrame:
    """group_id, head, tail: the ends as texts, trimmed."""
    return positives.select("group_id", *[F.trim(F.col(c).cast("string")).alias(c) for c in ("head", "tail")])


def _candidates(rows: DataFrame, small: int) -> tuple[list[tuple[DataFrame, Callable[[DataFrame], DataFrame]]], int]:
    """Ordered pairs of a group's different ends, each part with what takes the positives out of it; and how many pairs that
    leaves. rows: as _trimmed() makes them. A group of at most `small` rows is one row with its pairs in an array, so its
    candidates need no join; larger groups, if there are any, are joined with themselves, where a hub is AQE's to split."""
    rows = rows.where(F.col("group_id").isNotNull())
    large = written(rows.groupBy("group_id").agg(F.count("*").alias("n")).where(F.col("n") > small).select("group_id"), tidy=True)
    hubs = large.count() > 0
    kept = rows.join(few(large), "group_id", "left_anti") if hubs else rows
    groups = written(kept.groupBy("group_id").agg(F.collect_set(F.struct("head", "tail")).alias("known")), tidy=True)
    side = lambda c: F.transform("known", lambda p: p[c])
    ends = F.array_distinct(F.filter(F.concat(side("head"), side("tail")), lambda x: x != ""))
    positive = F.size(F.filter("known", lambda p: (p["head"] != "") & (p["tail"] != "") & (p["head"] != p["tail"])))
    e = F.size(ends).cast("long")
    n = groups.agg(F.sum(e * (e - 1) - positive)).first()[0] or 0
    pairs = groups.select("group_id", "known", ends.alias("ends")).select("group_id", "known", "ends", F.explode("ends").alias("head")).select("group_id", "known", "head", F.explode("ends").alias("tail"))
    parts = [(pairs.where("head <> tail"), lambda found: found.where(~F.array_contains("known", F.struct("head", "tail"))).drop("known"))]
    if hubs:
        mine = written(rows.join(few(large), "group_id", "left_semi").distinct(), tidy=True)
        ends = written(mine.select("group_id", F.explode(F.filter(F.array("head", "tail"), lambda x: x != "")).alias("end")).distinct(), tidy=True)
        n += ends.groupBy("group_id").agg(F.count("*").alias("e")).agg(F.sum(F.col("e") * (F.col("e") - 1))).first()[0] or 0
        n -= mine.where("head <> '' and tail <> '' and head <> tail").count()
        every = ends.withColumnRenamed("end", "head").join(ends.withColumnRenamed("end", "tail"), "group_id").where("head <> tail")
        parts.append((every, lambda found: found.join(mine, ["group_id", "head", "tail"], "left_anti")))
    return parts, n


def negative_samples(positives: DataFrame, ratio: float = 1.0, most: int | None = None, seed: int = 13, small: int = 256, stored: bool = False) -> DataFrame:
    """positives: group_id, head, tail. Ordered pairs of a group's ends that are not positive, the first in hash order: as
    many as `ratio` times the positives (one at least, of any), and `most` at most. The group is a paper and a sentence, so
    its ends are few; see _candidates() for groups of over `small` rows. stored: the positives are a stored table and are
    read as they are.

    The hashes are uniform and the candidates are counted, so a bound on the hash is known below which there are just over as
    many as are wanted; only those are written, and with their hash only if it is near the bound. The few that are too many
    are ordered, largest first. Should they be too few after all, the bound is raised.
    """
    positives = positives.select("group_id", "head", "tail")
    positives = positives if stored else written(positives, tidy=True)
    n = positives.count()
    target = max(int(n * ratio), 1 if ratio > 0 and n else 0)
    target = target if most is None else min(target, most)
    order, label = ["_h", "group_id", "head", "tail"], F.lit("NO_RELATION").alias("label")
    if target == 0:
        return _trimmed(positives).limit(0).select(*order[1:], label)
    parts, pairs = _candidates(_trimmed(positives), small)
    share, near = min(1.0, (target + 6 * target**0.5 + 20) / max(pairs, 1)), (20 * target**0.5 + 100) / max(pairs, 1)
    bound = lambda x: F.lit(f"{int(x * 16**12):012x}")
    while True:
        low = [(p.withColumn("_h", shuffled(seed, *order[1:])), rest) for p, rest in parts]
        if share < 1:
            low = [(p.where(F.col("_h") < bound(share)), rest) for p, rest in low]
        if share > near:
            low = [(p.withColumn("_h", F.when(F.col("_h") >= bound(share - near), F.col("_h"))), rest) for p, rest in low]
        found = written(functools.reduce(DataFrame.unionByName, [rest(p).select(*order) for p, rest in low]), tidy=True)
        total, hashed = found.agg(F.count("*"), F.count("_h")).first()
        if hashed >= min(total, total - target) and (share == 1 or total >= target):
            break
        share, near = (min(1.0, 1.1 * share), near) if total < target else (share, 4 * near)
    over = total - target
    if over > 0:
        last = written(found.where(F.col("_h").isNotNull()).orderBy(*map(F.desc, order)).limit(over)).agg(F.min(F.struct(*order)).alias("cut"))  # some six roots of the target
        found = found.join(F.broadcast(last)).where(F.col("_h").isNull() | (F.struct(*order) < F.col("cut")))
    return found.select(*order[1:], label)


def negative_report(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """One row: positive, negative, skipped (positives of groups with less than two ends), warnings. A group with a row of two
    ends is not skipped, so only groups without such a row have their ends compared."""
    rows = _trimmed(positives)
    two = F.coalesce((F.col("head") != "") & (F.col("tail") != "") & (F.col("head") != F.col("tail")), F.lit(False))
    end = F.coalesce(F.nullif("head", F.lit("")), F.nullif("tail", F.lit("")))
    lone = rows.where(~two).groupBy("group_id").agg(F.count("*").alias("n"), F.min(end).alias("a"), F.max(end).alias("z")).where("a is null or a = z")
    whole = rows.where(two).select("group_id").distinct()
    skipped = lone.join(whole, lone["group_id"].eqNullSafe(whole["group_id"]), "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("skipped"))
    counts = positives.agg(F.count("*").alias("positive")).join(negatives.agg(F.count("*").alias("negative"))).join(skipped)  # a row each
    none = F.col("positive") == 0
    warnings = said((none, "no positive relation examples found"), (~none & (F.col("negative") == 0), "no synthetic negatives could be generated"))
    return counts.withColumn("warnings", F.array_join(warnings, "; "))


def unmatched_keys(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """The keys of rows that `others` lacks."""
    return rows.select(key).join(others.select(key), key, "left_anti")


def dataset_summary(rows: DataFrame, expected: tuple[str, ...] = ()) -> DataFrame:
    """task, label, n; expected labels that a task lacks with 0."""
    want = F.array(*map(F.lit, expected)).cast("array<string>")
    missing = rows.groupBy("task").agg(F.array_except(want, F.collect_set("label")).alias("m")).select("task", F.explode("m").alias("label"), F.lit(0).cast("long").alias("n"))
    return rows.groupBy("task", "label").agg(F.count("*").alias("n")).unionByName(missing)


def label_drift(rows: DataFrame, part: str, expected: tuple[str, ...]) -> DataFrame:
    """Per part the labels that are not expected, and those that are missing."""
    want = F.array(*map(F.lit, expected)).cast("array<string>")
    have = rows.groupBy(part).agg(F.collect_set("label").alias("have"))
    listed = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ";")
    return have.select(part, listed(F.col("have"), want).alias("unexpected"), listed(want, F.col("have")).alias("missing"))


def label_coverage(rows: DataFrame, expected: tuple[str, ...]) -> DataFrame:
    """check, passed: whether all labels of the data are expected, and all expected ones in the data."""
    want = F.array(*map(F.lit, expected)).cast("array<string>")
    have = rows.agg(F.collect_set("label").alias("have"))
    check = lambda name, a, b: F.struct(F.lit(name).alias("check"), (F.size(F.array_except(a, b)) == 0).alias("passed"))
    return have.select(F.inline(F.array(check("data_in_config", F.col("have"), want), check("config_in_data", want, F.col("have")))))


def import_summary(rows: DataFrame) -> DataFrame:
    """Per status of imported rows: n, missing labels."""
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("label").isNull()).alias("missing"))


def provenance_audit(rows: DataFrame, low: Column) -> DataFrame:
    """Per source: rows, missing_id, low (rows for which the condition holds)."""
    return rows.groupBy("source").agg(F.count("*").alias("rows"), F.count_if(F.trim(F.coalesce("item_id", F.lit(""))) == "").alias("missing_id"), F.count_if(low).alias("low"))


def governance(leaks: DataFrame, ready: DataFrame, counts: DataFrame, drift: DataFrame | None = None, provenance: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """check, passed: of the leakage pairs (a, b, shared), of readiness (task, ready), of row counts (key, n), of label drift
    (split, unexpected, missing; it blocks only if strict) and of provenance (source, missing_id), and `overall`, which
    passes if all of them do."""
    named = lambda df, kind, passed, *key: df.select(F.concat_ws(":", F.lit(kind), *key).alias("check"), passed.alias("passed"))
    parts = [named(leaks, "leakage", F.col("shared") == 0, "a", "b"), named(ready, "readiness", F.col("ready"), "task"), named(counts, "rows", F.col("n") > 0, "key")]
    if drift is not None:
        parts.append(named(drift, "drift", F.lit(not strict) | ((F.col("unexpected") == "") & (F.col("missing") == "")), "split"))
    if provenance is not None:
        parts.append(named(provenance, "provenance", F.col("missing_id") == 0, "source"))
    checks = functools.reduce(DataFrame.unionByName, parts)
    return checks.unionByName(checks.agg(F.lit("overall").alias("check"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed")))


def gold_pack(seed: DataFrame, *fallbacks: str, per_task: int = 10, per_label: int = 2) -> dict[str, DataFrame]:
    """seed: source_pmid, task, label, text -> the pack's rows (labels repaired, split by paper, with label ids) and its
    label map, card, baseline and readiness."""
    split = split_by_group(repair_labels(seed, *fallbacks), "source_pmid")
    labels = label_map(split)
    baseline = majority_baseline(*(split.where(F.col("split") == s) for s in ("train", "test")))
    return {"rows": apply_label_map(split, labels), "labels": labels, "card": dataset_card(split, "task", "split"), "baseline": baseline, "readiness": readiness(split, per_task, per_label)}


def pack_report(pack: dict[str, DataFrame]) -> DataFrame:
    """section, task, name, value of a gold pack."""
    line = lambda df, section, name, value: df.select(F.lit(section).alias("section"), "task", F.col(name).alias("name"), F.col(value).cast("double").alias("value"))
    sizes = pack["rows"].groupBy("task", F.concat_ws(":", "split", "label").alias("name")).agg(F.count("*").alias("n"))
    parts = [line(sizes, "split", "name", "n"), line(pack["labels"], "label", "label", "id"), line(pack["baseline"], "baseline", "majority", "accuracy"), line(pack["readiness"], "ready", "warnings", "ready")]
    parts += [line(pack["card"], c, "split", c) for c in ("rows", "labels", "missing_text", "duplicates")]
    return functools.reduce(DataFrame.unionByName, parts)


def relation_quality(rows: DataFrame) -> DataFrame:
    """One row of counts. Duplicates are rows less distinct keys; only hashes of the keys are shuffled, and the keys themselves are
    compared where a hash comes again."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    key = ["group_id", F.coalesce("head", F.lit("")), F.coalesce("tail", F.lit("")), "label"]
    hashed = rows.withColumn("_k", F.xxhash64(*key))
    again = written(hashed.select("_k").repartition("_k").groupBy("_k").agg(F.count("*").alias("n")).where("n > 1").select("_k"), tidy=True)
    same = hashed.join(few(again), "_k", "left_semi").agg((F.count("*") - F.count_distinct(F.struct(*key))).alias("duplicates"))
    counts = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("label") != "NO_RELATION").alias("positive"), F.count_if(F.col("label") == "NO_RELATION").alias("negative"), F.count_if(blank("head") | blank("tail")).alias("missing_endpoint"), F.count_if(F.col("head") == F.col("tail")).alias("identical"))
    return counts.join(same)  # a row each


def promotion_review(rows: DataFrame, per_task: int = 100, per_label: int = 10) -> DataFrame:
    """task, label ("" for the task itself), n, shortfall, blocked."""
    by = rows.groupBy("task", "label").agg(F.count("*").alias("n"))
    tasks = by.groupBy("task").agg(F.sum("n").alias("n")).select("task", F.lit("").alias("label"), "n", F.lit(per_task).alias("need"))
    both = tasks.unionByName(by.select("task", "label", "n", F.lit(per_label).alias("need")))
    return both.select("task", "label", "n", F.greatest(F.lit(0), F.col("need") - F.col("n")).alias("shortfall"), (F.col("n") < F.col("need")).alias("blocked"))


def promotion_plan(review: DataFrame, size: int = 24) -> DataFrame:
    """Batches that fill the shortfalls: task, label, batch, examples."""
    short = review.where("shortfall > 0").withColumn("batches", F.ceil(F.col("shortfall") / size).cast("int"))
    return short.select("task", "label", "shortfall", F.explode(F.sequence(F.lit(1), F.col("batches"))).alias("batch")).select("task", "label", "batch", F.least(F.lit(size), F.col("shortfall") - (F.col("batch") - 1) * size).cast("long").alias("examples"))


def pack_comparison(rows: DataFrame) -> DataFrame:
    """Rows and labels per (pack, task), per pack and in all (rollup; "" stands for all)."""
    return rows.rollup("pack", "task").agg(F.count("*").alias("rows"), F.count_distinct("label").alias("labels")).fillna("", ["pack", "task"])


def provenance_diff(rows: DataFrame) -> DataFrame:
    """rows: item_id, batch, label, status. Per item: batches, changes of label and status, withdrawn."""
    from graphloom.functions.rules import WITHDRAWN

    return rows.groupBy("item_id").agg(F.count("*").alias("observations"), (F.count_distinct("label") > 1).alias("label_changed"), (F.count_distinct("status") > 1).alias("status_changed"), F.bool_or(F.col("status").isin(*WITHDRAWN)).alias("withdrawn"))


def adapt_rows(rows: DataFrame) -> DataFrame:
    """One shape for rows of every task: task, id, text, labels."""
    text = F.when(F.col("task") == "relation", first_filled("sentence", "text")).otherwise(first_filled("text"))
    labels = F.when(F.col("task") == "evidence", F.array(F.coalesce(F.col("label").cast("string"), F.lit("")))).otherwise(F.array_sort(F.coalesce("labels", F.array().cast("array<string>"))))
    return rows.select("task", first_filled("source_pmid", "pmid").alias("id"), text.alias("text"), labels.alias("labels"))

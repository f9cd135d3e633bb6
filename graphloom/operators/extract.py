"""From texts to spans, mentions, evidence tiers and relations. Texts come as DataFrames (pmid, text)."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import rules
from graphloom.functions.text import casefold, col, evidence_tier, normalize_alias, qualifiers

_STRIP = r"(?U)^\s+|\s+$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body's own lambdas read it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, b: a + b)


def with_offsets(lengths: Column, body: Callable[[Callable[[Column], Column]], Column], block: int = 64) -> Column:
    """body gets a function i -> sum of the first i lengths. Sums of blocks are kept, so a long array costs little."""
    size = F.lit(block)

    def of(n: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / size).cast("int")), lambda b: _total(F.slice(n, b * size + 1, size)))
        return let(blocks, lambda sums: let(F.transform(sums, lambda _, b: _total(F.slice(sums, 1, b))), lambda base: body(lambda i: F.element_at(base, F.floor(i / size).cast("int") + 1) + _total(F.slice(n, F.floor(i / size).cast("int") * size + 1, i % size)))))

    return let(lengths, of)


def _groups(text: Column, pattern: Column, *numbers: int) -> Column:
    return F.struct(*[F.regexp_extract_all(text, pattern, F.lit(i)).alias(f"g{i}") for i in numbers])


def _lengths(parts: Column) -> Column:
    return F.transform(parts, lambda x: F.length(x))


def numbered(docs: DataFrame, array: Column, number: str) -> DataFrame:
    """pmid, number (from 0), s: a row for each element. The outer form keeps the optimizer from testing the array's size in a
    filter of its own, which would make the array twice."""
    return docs.select("pmid", F.posexplode_outer(array).alias(number, "s")).where(F.col(number).isNotNull())


def sentence_spans(text: Column | str) -> Column:
    """Array of struct start, end, sentence: runs of anything up to . ! or ?, stripped. The text is cut after each of these in one
    pass; a piece that is nothing else is no sentence."""

    def spans(pieces: Column) -> Column:
        def span(before: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
            def of(x: Column, i: Column) -> Column:
                lead = F.length(x) - F.length(F.regexp_replace(x, r"(?U)^\s+", ""))
                stripped = lambda t: F.struct((before(i) + lead).alias("start"), (before(i) + lead + F.length(t)).alias("end"), t.alias("sentence"))
                return F.when(~x.rlike(r"^[.!?]?$"), let(F.regexp_replace(x, _STRIP, ""), stripped))

            return of

        return with_offsets(_lengths(pieces), lambda before: F.transform(pieces, span(before)))

    return F.filter(let(F.split(col(text), r"(?<=[.!?])", -1), spans), lambda s: s["sentence"] != "")


def split_sentences(docs: DataFrame) -> DataFrame:
    """pmid, sentence_no (from 0), start, end, sentence."""
    return numbered(docs, sentence_spans("text"), "sentence_no").select("pmid", "sentence_no", "s.*")


def chunk_spans(text: Column | str, max_words: int = 250, overlap: int = 40) -> Column:
    """Array of struct start, chunk: windows of words; the text itself if it has no more than a window."""
    if max_words < 1 or not 0 <= overlap < max_words:
        raise ValueError("max_words must be positive and above the overlap, which must not be negative")
    t, step = col(text), max_words - overlap

    def chunks(g: Column) -> Column:
        n = F.size(g["g0"])
        last = F.greatest(F.lit(0), F.ceil((n - max_words) / step).cast("int"))

        def chunk(before: Callable[[Column], Column]) -> Callable[[Column], Column]:
            def of(i: Column) -> Column:
                start = before(i * step) + F.length(F.element_at(g["g1"], i * step + 1))
                return F.struct(start.alias("start"), F.substring(t, start + 1, before(F.least(i * step + max_words, n)) - start).alias("chunk"))

            return of

        whole = F.array(F.struct(F.lit(0).alias("start"), t.alias("chunk")))
        return F.when(n <= max_words, whole).otherwise(with_offsets(_lengths(g["g0"]), lambda before: F.transform(F.sequence(F.lit(0), last), chunk(before))))

    return let(_groups(t, F.lit(r"(?sU)(\s*)(\S+)"), 0, 1), chunks)


def chunk_text(docs: DataFrame, max_words: int = 250, overlap: int = 40) -> DataFrame:
    """pmid, chunk_no, start, chunk."""
    return numbered(docs, chunk_spans("text", max_words, overlap), "chunk_no").select("pmid", "chunk_no", "s.*")


def lexicon_pattern(terms: Iterable[str]) -> str:
    """Whole words of any case, longest term first."""
    longest = sorted(set(terms), key=lambda x: (-len(x), x.lower()))
    return r"(?iU)(?<!\w)(?:" + "|".join(re.escape(t).replace(r"\ ", " ") for t in longest) + r")(?!\w)"


def match_spans(text: Column | str, pattern: str) -> Column:
    """Array of struct start, end, text of a pattern's matches: matches and the gaps between them are found in one pass
    each, so a text without a match costs no more than others."""

    def spans(g: Column) -> Column:
        def span(before: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
            def of(x: Column, i: Column) -> Column:
                end = before(i + 1)
                return F.struct((end - F.length(x)).alias("start"), end.alias("end"), x.alias("text"))

            return of

        steps = F.transform(g["found"], lambda x, i: F.length(x) + F.length(F.element_at(g["gaps"], i + 1)))
        return with_offsets(steps, lambda before: F.transform(g["found"], span(before)))

    t = col(text)
    return let(F.struct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("found"), F.split(t, pattern, -1).alias("gaps")), spans)


def lexicon_spans(text: Column | str, lexicon: Iterable[tuple[str, str]] = rules.LEXICON, score: float = rules.LEXICON_SCORE) -> Column:
    """Array of struct start, end, text, label, confidence: leftmost, longest, not overlapping."""
    lexicon = tuple(lexicon)
    labels = F.create_map(*[F.lit(x) for term, label in {a.lower(): b for a, b in lexicon}.items() for x in (term, label)])
    tag = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), F.element_at(labels, F.lower(m["text"])).alias("label"), F.lit(score).alias("confidence"))
    return F.transform(match_spans(text, lexicon_pattern(x for x, _ in lexicon)), tag)


def lexicon_ner(docs: DataFrame, lexicon: Iterable[tuple[str, str]] = rules.LEXICON, aliases: dict[str, str] | None = None) -> DataFrame:
    """pmid, start, end, text, label, confidence, normalized_text."""
    spans = numbered(docs, lexicon_spans("text", lexicon), "_no").select("pmid", "s.*")
    return spans.withColumn("normalized_text", normalize_alias("text", aliases))


Tagger = Callable[[list[str]], list[list[dict]]]


def tag_with(chunks: DataFrame, tagger: Callable[[], Tagger]) -> DataFrame:
    """Any tagger over chunks (pmid, start, chunk), a batch at a time; it is made once a task. Offsets are those of the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tag = tagger()
        for batch in batches:
            rows = [
                (pmid, int(m["start"]) + at, int(m["end"]) + at, m["text"], m["label"], float(m["confidence"]))
                for pmid, at, found in zip(batch.pmid, batch.start, tag(batch.chunk.tolist()))
                for m in found
            ]
            yield pd.DataFrame(rows, columns=["pmid", "start", "end", "text", "label", "confidence"])

    return chunks.select("pmid", "start", "chunk").mapInPandas(run, "pmid string, start int, end int, text string, label string, confidence double")


def merge_mentions_of_chunks(mentions: DataFrame) -> DataFrame:
    """One mention per (pmid, start, end, label, normalized_text): the most confident."""
    keys = ["pmid", "start", "end", "label", "normalized_text"]
    return mentions.groupBy(*keys).agg(F.max_by(F.struct("text", "confidence"), F.struct("confidence", "text")).alias("best")).select(*keys, "best.*")


def ner_apply(docs: DataFrame, lexicon=rules.LEXICON, max_words: int = 250, overlap: int = 40, tagger: Callable[[], Tagger] | None = None) -> DataFrame:
    """Tags chunks (by the lexicon, or by a tagger), restores offsets, and keeps the most confident of equal mentions."""
    chunks = chunk_text(docs, max_words, overlap)
    if tagger is None:
        spans = chunks.select("pmid", F.col("start").alias("at"), F.explode(lexicon_spans("chunk", lexicon)).alias("m"))
        found = spans.select("pmid", (F.col("m.start") + F.col("at")).alias("start"), (F.col("m.end") + F.col("at")).alias("end"), "m.text", "m.label", "m.confidence")
    else:
        found = tag_with(chunks, tagger)
    return merge_mentions_of_chunks(found.withColumn("normalized_text", normalize_alias("text")))


def evidence(text: Column | str, table=rules.EVIDENCE_RULES) -> Column:
    """struct tier, confidence, cues: the first tier of the table with a cue in the text."""
    t = col(text)
    out = F
    for tier, confidence, patterns in table:
        cues = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(f"(?iu){p}"), F.lit(0)) for p in patterns]))))
        out = out.when(functools.reduce(lambda a, b: a | b, [t.rlike(f"(?iu){p}") for p in patterns]), F.struct(F.lit(tier).alias("tier"), F.lit(confidence).alias("confidence"), cues.alias("cues")))
    return out.otherwise(F.struct(F.lit(0).alias("tier"), F.lit(0.5).alias("confidence"), F.array().cast("array<string>").alias("cues")))


def classify_evidence(docs: DataFrame, table=rules.EVIDENCE_RULES, classifier: Callable[[], Callable[[pd.Series], pd.DataFrame]] | None = None) -> DataFrame:
    """pmid, tier, confidence, cues. classifier: makes a function from texts to columns tier, confidence, cues."""
    if classifier is None:
        return docs.select("pmid", evidence(F.coalesce("text", F.lit("")), table).alias("e")).select("pmid", "e.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classify = classifier()
        for batch in batches:
            yield pd.concat([batch[["pmid"]].reset_index(drop=True), classify(batch.text.reset_index(drop=True))], axis=1)

    return docs.select("pmid", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "pmid string, tier int, confidence double, cues array<string>")


def rule_rows(table=rules.RELATION_RULES, pairs: dict | None = None) -> list[tuple[int, str, str, str, float]]:
    """(rule_no, relation, head label, tail label, confidence)."""
    pairs = rules.ALLOWED_EDGES | rules.RULE_PAIRS | (pairs or {})
    return [(i, relation, h, t, confidence) for i, (relation, _, confidence) in enumerate(table) for h, t in pairs[relation]]


def match_relation_rules(sentences: DataFrame, table=rules.RELATION_RULES) -> DataFrame:
    """Adds rule_no, relation, trigger, rule_confidence: a row for each rule with a trigger in the sentence."""
    s = F.col("sentence")

    def first(patterns: tuple[str, ...]) -> Column:
        hits = [F.regexp_extract(s, f"(?iu){p}", 0) for p in patterns]
        return F.coalesce(*[F.when(h != "", h) for h in hits])

    matched = [F.struct(F.lit(i).alias("rule_no"), F.lit(r).alias("relation"), first(p).alias("trigger"), F.lit(c).alias("rule_confidence")) for i, (r, p, c) in enumerate(table)]
    return sentences.withColumn("rule", F.explode(F.filter(F.array(*matched), lambda x: x["trigger"].isNotNull()))).select(*sentences.columns, "rule.*")


def node_label(label: Column | str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in rules.NODE_OF_ENTITY.items() for x in kv]), col(label))


def mention_blocks(mentions: Column, block: int = 64) -> Column:
    """Sorted mentions in blocks with the span each covers, so that a sentence reads only the blocks at its place."""

    def made(part: Column) -> Column:
        low, high = F.transform(part, lambda m: m["m_start"]), F.transform(part, lambda m: m["m_end"])
        return F.struct(F.array_min(low).alias("low"), F.array_max(high).alias("high"), part.alias("ms"))

    size = F.lit(block)
    numbers = lambda ms: F.sequence(F.lit(0), F.floor((F.size(ms) - 1) / size).cast("int"))
    return let(mentions, lambda ms: F.transform(numbers(ms), lambda b: let(F.slice(ms, b * size + 1, size), made)))


def mentions_within(blocks: Column, start: Column, end: Column) -> Column:
    """The mentions that overlap a span, in order, with their number among them."""
    near = F.filter(blocks, lambda b: (b["low"] < end) & (b["high"] > start))
    found = F.flatten(F.transform(near, lambda b: F.filter(b["ms"], lambda m: (m["m_start"] < end) & (m["m_end"] > start))))
    return F.transform(found, lambda m, i: F.struct((i + 1).alias("pos"), m["m_start"].alias("m_start"), m["key"].alias("key"), m["node"].alias("node"), m["m_confidence"].alias("m_confidence")))


def extract_relations(docs: DataFrame, mentions: DataFrame, tiers: DataFrame | None = None, table=rules.RELATION_RULES, pairs: dict | None = None) -> DataFrame:
    """Relations between mentions of a sentence, at most one per (pmid, head, relation, tail): the last one found wins.

    A paper's mentions meet its text as one sorted array, and the text is split once: each sentence takes the mentions at its
    place from their blocks, those with two or more go on if one pattern of all triggers is in them, and only then is each
    rule tried. Mentions are paired within their sentence, by the node labels that a fired rule takes. tiers: pmid, tier.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.when(F.trim("normalized_text") != "", F.trim("normalized_text")), F.trim("text"))
    mention = F.struct(F.col("start").alias("m_start"), F.col("end").alias("m_end"), key.alias("key"), node_label("label").alias("node"), F.col("confidence").alias("m_confidence"))
    held = mentions.select("pmid", mention.alias("m")).groupBy("pmid").agg(F.collect_list("m").alias("ms"))
    held = held.where(F.size("ms") >= 2).select("pmid", mention_blocks(F.array_sort("ms")).alias("blocks"))
    blocks = F.col("blocks")
    told = F.transform(sentence_spans("text"), lambda s, i: F.struct(i.alias("sentence_no"), s["sentence"].alias("sentence"), mentions_within(blocks, s["start"], s["end"]).alias("ms")))
    spoken = numbered(docs.select("pmid", "text").join(held, "pmid"), F.filter(told, lambda s: F.size(s["ms"]) >= 2), "_no").select("pmid", "s.*")
    any_trigger = "(?iu)" + "|".join(f"(?:{p})" for _, patterns, _ in table for p in patterns)
    fired = match_relation_rules(spoken.where(F.col("sentence").rlike(any_trigger)), table)
    allowed = F.broadcast(spark.createDataFrame(rule_rows(table, pairs), "rule_no int, relation string, a_node string, b_node string, c double").drop("relation", "c"))  # the rule table
    fired = fired.join(allowed, "rule_no")
    first = fired.withColumn("a", F.explode(F.filter("ms", lambda m: m["node"] == F.col("a_node"))))
    met = first.withColumn("b", F.explode(F.filter("ms", lambda m: (m["node"] == F.col("b_node")) & (m["pos"] != F.col("a.pos"))))).drop("ms")
    forward = F.col("a.pos") < F.col("b.pos")
    good = met.where(forward | ~((F.col("a_node") == F.col("b_node")) & (F.col("b.m_start") <= F.col("a.m_start"))))
    order = F.struct("sentence_no", "rule_no", F.least("a.pos", "b.pos"), F.greatest("a.pos", "b.pos"), ~forward)
    last = F.struct(F.col("a.key").alias("head_key"), F.col("b.key").alias("tail_key"), F.least("a.m_confidence", "b.m_confidence", "rule_confidence").alias("confidence"), "trigger", "sentence", "sentence_no")
    best = good.groupBy("pmid", "a_node", casefold("a.key").alias("hk"), "relation", "b_node", casefold("b.key").alias("tk")).agg(F.max_by(last, order).alias("last"), F.min(order).alias("first"))
    index = F.row_number().over(Window.partitionBy("pmid").orderBy("first"))
    found = best.select("pmid", index.alias("relation_index"), F.col("a_node").alias("head_label"), "relation", F.col("b_node").alias("tail_label"), "last.*")
    out = found.select("pmid", "relation_index", "head_label", "head_key", "relation", "tail_label", "tail_key", "confidence", "trigger", "sentence", "sentence_no", qualifiers(F.col("relation"), F.col("sentence")).alias("qualifiers"))
    if tiers is None:
        return out.withColumn("evidence_tier", F.lit(0))
    return out.join(tiers.select("pmid", F.col("tier").alias("evidence_tier")), "pmid", "left").fillna({"evidence_tier": 0})


def ner_examples(mentions: DataFrame) -> DataFrame:
    """A training row for each mention."""
    return mentions.select(F.lit("ner").alias("task"), F.col("pmid").alias("source_pmid"), "text", "label", "start", "end", "confidence", "normalized_text", F.lit(rules.NOTICE).alias("warning"))


def entity_observations(mentions: DataFrame) -> DataFrame:
    """pmid, item_type, label, item_id, identity and text_hash of each mention, for comparing two sets of them: the text is the
    normalized one where there is no other, the identity leaves the text out."""
    text = F.trim(F.coalesce(F.when(F.trim("text") != "", F.col("text")), F.col("normalized_text"), F.lit("")))
    label = F.trim(F.coalesce("label", F.lit("")))
    place = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("pmid", "start", "end")]
    return mentions.select(
        "pmid",
        F.lit("ner").alias("item_type"),
        label.alias("label"),
        F.concat_ws(":", F.lit("ner"), *place, label, text).alias("item_id"),
        F.sha2(F.concat_ws("|", *place, label), 256).alias("identity"),
        F.sha2(text, 256).alias("text_hash"),
    )


def phrase_scan(docs: DataFrame, patterns: Iterable[str] = rules.PROHIBITED, negations: Iterable[str] = rules.NEGATIONS, before: int = 80, notice: str | None = None) -> DataFrame:
    """pmid, finding_type, detail: phrases without a negation in the characters before them; texts without the notice."""
    hits = F.concat(*[match_spans("text", f"(?iu){p}") for p in patterns])
    window = lambda m: F.substring("text", F.greatest(F.lit(1), m["start"] - before + 1), F.least(F.lit(before), m["start"]))
    found = docs.select("pmid", F.explode(F.transform(hits, lambda m: F.struct(window(m).alias("before"), m["text"].alias("phrase")))).alias("f"))
    negated = functools.reduce(lambda a, b: a | b, [F.contains(casefold("f.before"), F.lit(n)) for n in negations])
    out = found.where(~negated).select("pmid", F.lit("prohibited_assertion").alias("finding_type"), F.concat(F.lit("Potential scope drift phrase: "), "f.phrase").alias("detail"))
    if notice is None:
        return out
    small = lambda c: F.regexp_replace(casefold(c), "[^a-z0-9]+", "")
    lost = docs.where(~F.contains(small("text"), small(F.lit(notice)))).select("pmid", F.lit("missing_research_warning").alias("finding_type"), F.lit("Required research-use warning not found").alias("detail"))
    return out.unionByName(lost)


def predict_with(rows: DataFrame, predictor: Callable[[], Callable[[list[str]], list[tuple[str, float]]]], **provenance: str) -> DataFrame:
    """Any model over texts, a batch at a time, loaded once a task: one prediction for each input row."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = predictor()
        for batch in batches:
            found = predict(batch.text.tolist())
            if len(found) != len(batch):
                raise ValueError("a predictor must return one prediction for each text")
            yield batch.assign(prediction=[p for p, _ in found], confidence=[float(c) for _, c in found])

    out = rows.mapInPandas(run, ", ".join(f"`{k}` {v}" for k, v in kinds.items()) + ", prediction string, confidence double")
    return out.withColumns({k: F.lit(v) for k, v in provenance.items()}).withColumn("tier", evidence_tier("prediction"))

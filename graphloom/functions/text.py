"""Column functions: cleaning, keys, labels, tiers, reasons and qualifiers. All stay in the JVM."""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import rules, unicode

def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(text: Column | str) -> Column:
    """White space of any kind to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(col(text), r"(?U)\s+", " "))


def unescape(text: Column | str) -> Column:
    """All named and numeric character entities."""
    return unicode.unescape(col(text))


def clean_text(text: Column | str) -> Column:
    """Entities resolved, control characters and white space to single spaces, trimmed; null is empty."""
    return squeeze(F.regexp_replace(F.coalesce(unescape(text), F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " "))


def blank_to_null(text: Column | str) -> Column:
    t = F.trim(col(text))
    return F.when(t != "", t)


def join_sections(sections: Column | str) -> Column:
    return clean_text(F.concat_ws(" ", F.filter(col(sections), lambda x: x != "")))


def source_text(title: Column | str, abstract: Column | str) -> Column:
    """Title and abstract, cleaned: the text that all spans count in."""
    some = lambda c: F.when(F.coalesce(col(c), F.lit("")) != "", col(c))
    return clean_text(F.concat_ws("\n\n", some(title), some(abstract)))


def casefold(text: Column | str) -> Column:
    """Full case folding."""
    return unicode.casefold(col(text))


def canonical_key(text: Column | str) -> Column:
    return F.lower(squeeze(text))


def lookup(key: Column, values: dict[str, str]) -> Column:
    """A small fixed map; for a map that grows, join a table."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def normalize_alias(text: Column | str, aliases: dict[str, str] | None = None) -> Column:
    plain = squeeze(text)
    return F.coalesce(lookup(F.lower(plain), aliases or rules.ALIASES), plain)


def normalize_aliases(texts: Column | str, aliases: dict[str, str] | None = None) -> Column:
    return F.transform(col(texts), lambda x: normalize_alias(x, aliases))


def entity_label(label: Column | str) -> Column:
    """A tagger's label in the fixed set, else UNKNOWN."""
    plain = F.trim(F.replace(F.replace(col(label), F.lit("B-"), F.lit("")), F.lit("I-"), F.lit("")))
    return F.coalesce(lookup(F.upper(F.translate(plain, "-_", "  ")), rules.LABEL_ALIASES), F.lit("UNKNOWN"))


def entity_from_span(source: Column, start: Column, end: Column, word: Column, label: Column, score: Column) -> Column:
    """struct text, label, start, end, confidence, normalized_text."""
    s = F.coalesce(start, F.lit(0))
    e = F.when(F.coalesce(end, F.lit(0)) == 0, s).otherwise(end)
    raw = F.coalesce(F.trim(word), F.lit(""))
    inside = (s >= 0) & (s <= e) & (e <= F.length(source))
    cut = blank_to_null(F.substring(source, s + 1, e - s))
    text = F.coalesce(F.when(inside, cut), F.when(raw != "", raw), F.lit("UNKNOWN"))
    confidence = F.greatest(F.lit(0.0), F.least(F.coalesce(score, F.lit(0.0)), F.lit(1.0)))
    return F.struct(text.alias("text"), entity_label(F.coalesce(label, F.lit(""))).alias("label"), s.alias("start"), e.alias("end"), confidence.alias("confidence"), normalize_alias(text).alias("normalized_text"))


def publication_date(medline: Column, year: Column, month: Column, day: Column) -> Column:
    return F.coalesce(blank_to_null(medline), F.concat_ws("-", *(blank_to_null(x) for x in (year, month, day))))


def match_label(label: Column | str) -> Column:
    return F.replace(casefold(label), F.lit("_"), F.lit(""))


def match_text(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(casefold(text), "[^a-z0-9]+", " "))


def evidence_tier(value: Column | str) -> Column:
    """0 to 5 from a number, its text or LABEL_n; else null."""
    digits = F.regexp_extract(F.trim(col(value).cast("string")), r"(?i)^(?:LABEL_)?(\d{1,9})$", 1)
    n = F.when(digits != "", digits).cast("int")
    return F.when(n.between(0, 5), n)


def confidence_bucket(confidence: Column | str) -> Column:
    c = col(confidence)
    return F.when(c < 0.5, "<0.50").when(c < 0.75, "0.50-0.74").when(c < 0.9, "0.75-0.89").otherwise("0.90-1.00")


def tier_shift(before: Column, after: Column) -> Column:
    """struct label ("p -> c") and direction."""
    show = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    direction = F.when(after > before, "increased").when(after < before, "decreased").otherwise("unchanged")
    return F.struct(F.concat(show(before), F.lit(" -> "), show(after)).alias("label"), direction.alias("direction"))


def split_reasons(value: Column | str) -> Column:
    """A JSON array of strings, or text with semicolons."""
    c = F.coalesce(col(value), F.lit(""))
    parts = F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>")), parts)


def said(*pairs: tuple[Column, Column | str]) -> Column:
    """Array of the messages whose condition holds."""
    return F.array_compact(F.array(*[F.when(c, m if isinstance(m, Column) else F.lit(m)) for c, m in pairs]))


def review_reasons(confidence: Column, tier: Column, most: float = 0.65, hypothesis: bool = True) -> Column:
    return said((confidence <= most, f"confidence <= {most}"), ((tier == 0) & F.lit(hypothesis), "hypothesis-tier evidence"))


def prediction_reasons(confidence: Column, status: Column, prediction: Column, notice: Column, least: float = 0.75, wanted: str = rules.NOTICE) -> Column:
    s = F.coalesce(status, F.lit(""))
    return said(
        (F.coalesce(confidence, F.lit(0.0)) < least, f"confidence < {least}"),
        ((s != "") & ~s.isin(*rules.SAFE_STATUSES), F.concat(F.lit("checkpoint status: "), s)),
        (evidence_tier(prediction).isNull(), "invalid evidence prediction label"),
        (F.coalesce(notice, F.lit("")) != wanted, "missing research-use warning"),
    )


def active_learning_reasons(base: Column, in_graph: Column, prediction: Column, pmid: Column, text: Column) -> Column:
    more = said(
        (in_graph, "pmid already present in graph"),
        (evidence_tier(prediction) >= 3, "tier-change-sensitive evidence"),
        (F.trim(F.coalesce(pmid, F.lit(""))) == "", "missing source PMID"),
        (F.trim(F.coalesce(text, F.lit(""))) == "", "missing evidence text"),
    )
    return F.array_distinct(F.concat(base, more))


def candidate_priority(reasons: Column | str) -> Column:
    def weight(r: Column) -> Column:
        w = F.coalesce(lookup(r, {k: str(v) for k, v in rules.PRIORITY.items()}).cast("int"), F.lit(0))
        return functools.reduce(lambda a, p: a + F.when(r.startswith(p[0]), p[1]).otherwise(0), rules.PRIORITY_PREFIX, w)

    return F.aggregate(F.transform(col(reasons), weight), F.lit(0), lambda a, b: a + b)


def first_match(text: Column, table: Iterable[tuple[str, tuple[str, ...]]]) -> Column:
    """Value of the first row of the table of which a substring is in the text, or null."""
    out = F
    for value, words in table:
        out = out.when(functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]), value)
    return out.otherwise(F.lit(None).cast("string"))


def qualifiers(relation: Column, sentence: Column) -> Column:
    """struct cohort, species_model, mutation_status, trial_phase, evidence_context."""
    low = casefold(sentence)
    return F.struct(
        F.lit(None).cast("string").alias("cohort"),
        first_match(low, rules.SPECIES).alias("species_model"),
        F.when(relation == "PREDICTS", first_match(low, rules.MUTATIONS)).alias("mutation_status"),
        first_match(low, rules.PHASES).alias("trial_phase"),
        first_match(low, rules.CONTEXTS).alias("evidence_context"),
    )


QUALIFIERS = ("cohort", "species_model", "mutation_status", "trial_phase", "evidence_context")


def qualifier_map(q: Column | str, names: tuple[str, ...] = QUALIFIERS) -> Column:
    """The qualifiers that are there, as a map."""
    c = col(q)
    whole = F.create_map(*[x for n in names for x in (F.lit(n), c[n])])
    return F.map_filter(whole, lambda _, v: v.isNotNull())


def first_filled(*columns: Column | str) -> Column:
    """First value that isn't blank; else empty."""
    return F.coalesce(*[blank_to_null(col(c).cast("string")) for c in columns], F.lit(""))


def item_id(kind: str, *parts: Column | str) -> Column:
    """kind:part:part, as queues name their items; null if a part is null."""
    return F.concat(F.lit(kind), *[x for p in parts for x in (F.lit(":"), col(p).cast("string"))])


def shift_span(start: Column | str, end: Column | str, offset: Column | str) -> Column:
    """struct start, end of a span found in a part of a text, counted in the text that holds the part at this offset."""
    return F.struct((col(start) + col(offset)).alias("start"), (col(end) + col(offset)).alias("end"))


def stringify(value: Column | str) -> Column:
    return F.coalesce(F.trim(col(value).cast("string")), F.lit(""))


def content_hash(*columns: str) -> Column:
    """SHA-256 of the JSON of the named columns, in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("long")

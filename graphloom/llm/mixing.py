"""Mixing sources, languages and topics to target weights: iterative proportional fitting, then calibrated sampling.

Documents are summed by cell (source, language, topic) before anything moves. Targets are the wanted tokens of each source,
language and topic, none above what there is, all together the budget. The cells' token weights are raked to them in
turn, and no weight may exceed its cell's tokens, so that weight over tokens is a probability and the expected sample
meets the targets as far as the raking has come (rounds go on until the largest error is under a tolerance). A document
is kept with its cell's probability. All of it is DataFrame operations.

Nulls and odd rows: null source or language is a cell value of its own (empty text); null text has no words and no
weight and is kept with its cell's probability; the draw is a hash of the doc_id, so repeated rows stay or go together;
extra columns stay, but those named like the new ones; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import Scratch, WORD, text_of

DIMS = ("source", "lang", "topic")
SETTLED = 0.99
#: Topics by the words (or signs) a text holds, first match; a parameter.
TOPICS = (
    ("licence", ("license", "licence", "copyright", "rights reserved")),
    ("secret", ("password", "secret", "api key")),
    ("contact", ("@", "tel", "phone", "call")),
)


def bounded(word: str) -> str:
    """Pattern of a word that no ASCII letter touches."""
    return f"(^|[^a-z]){word}([^a-z]|$)"


def topic_of(text: Column, rules: tuple[tuple[str, tuple[str, ...]], ...] = TOPICS) -> Column:
    low, found = F.lower(text), F
    holds = lambda w: F.contains(low, F.lit(w)) & low.rlike(bounded(w)) if w[0].isalpha() else F.contains(low, F.lit(w))
    for name, words in rules:
        found = found.when(functools.reduce(lambda a, b: a | b, [holds(w) for w in words]), name)
    return found.otherwise("other")


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from a hash of the id."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 12)
    return F.conv(digest, 16, 10).cast("double") / float(1 << 48)


def targets_of(cells: DataFrame, d: str, wanted: float, alpha: float, shares: DataFrame | None, scratch: Scratch) -> DataFrame:
    """Tokens that each value of a dimension is to have (d, target): in proportion to tokens to the power alpha, or to given
    shares (value, share), never above its tokens; what that leaves over goes to the others. The factor of proportion
    rises as values turn out to be full, which takes a few sums of the dimension's table."""
    own = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("tokens"))
    if shares is None:
        own = own.withColumn("p", F.pow("tokens", F.lit(alpha)))
    else:
        own = own.join(shares.select(F.col("value").alias(d), F.col("share").cast("double").alias("p")), d, "left").fillna({"p": 0.0})
    own, factor = scratch.save(own, f"own_{d}"), 0.0
    while True:
        full = F.col("tokens") <= F.lit(factor) * F.col("p")
        r = own.agg(F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0.0)).alias("full"), F.coalesce(F.sum(F.when(~full, F.col("p"))), F.lit(0.0)).alias("free")).first()
        new = (wanted - r.full) / r.free if r.free > 0 else factor
        if new <= factor:
            return own.select(d, F.least("tokens", F.lit(factor) * F.col("p")).alias(f"target_{d}"))
        factor = new


def rake(cells: DataFrame, budget: float, alphas: dict[str, float], shares: dict[str, DataFrame], scratch: Scratch, rounds: int = 60, tolerance: float | None = 5e-4, small: int = 100_000) -> DataFrame:
    """cells: source, lang, topic, tokens -> with `weight`, expected tokens, none above tokens. Ends after `rounds`, or
    when no marginal is farther than `tolerance` of all tokens from its target, or three more rounds bring them no nearer (not
    to SETTLED of the distance), which is so for targets that contradict each other or ask for what the cells do not have;
    these are met as nearly as the last round does. A marginal is summed map-side and joined back, so that the cells of one
    value need not meet in one task; only cells that are at most `small` by count are summed by a window, which is the same
    with fewer jobs."""
    total = float(cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    out = cells.withColumn("weight", F.col("tokens") * F.lit(float(budget)))
    for d in DIMS:
        out = out.join(targets_of(cells, d, budget * total, alphas[d], shares.get(d), scratch), d)
    before, saved, few = float("inf"), "start", cells.count() <= small
    out = scratch.save(out, saved)
    for i in range(rounds):
        for d in DIMS:
            if few:
                out = out.withColumn("now", F.sum("weight").over(Window.partitionBy(d)))
            else:
                out = out.join(out.groupBy(d).agg(F.sum("weight").alias("now")), d)
            now = F.col("now")
            weight = F.when(now > 0, F.least(F.col("tokens").cast("double"), F.col("weight") * (F.col(f"target_{d}") / now))).otherwise(0.0)
            out = out.withColumn("weight", weight).drop("now")
        if i % 3 == 2 or not few or i == rounds - 1:
            out = scratch.save(out, f"round{i}")
            scratch.drop(saved)
            saved = f"round{i}"
        if i % 3 == 2 and tolerance is not None:
            error = _error(out)
            if error <= tolerance * total or error > SETTLED * before:
                break
            before = error
    return out.select(*DIMS, "tokens", "weight")


def _error(cells: DataFrame) -> float:
    """The largest distance of a marginal from its target."""
    far = (cells.groupBy(d).agg(F.abs(F.sum("weight") - F.first(f"target_{d}")).alias("e")).select("e") for d in DIMS)
    return functools.reduce(DataFrame.unionByName, far).agg(F.coalesce(F.max("e"), F.lit(0.0))).first()[0]


def mix(docs: DataFrame, budget: float = 0.8, alphas: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, seed: str = "mix", rules: tuple = TOPICS, small: int = 100_000, **raking) -> DataFrame:
    """The documents drawn, with source, lang and topic (no nulls) as mix_source, mix_lang, mix_topic, n_tokens, prob; their
    expected tokens are `budget` of all. Cells without tokens are kept with probability `budget`."""
    scratch = Scratch(docs.sparkSession, "mixing")
    alphas = {"source": 0.7, "lang": 0.7, "topic": 0.9} | (alphas or {})
    text = text_of()
    docs = docs.drop(*(f"mix_{d}" for d in DIMS), "n_tokens", "prob")
    named = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"mix_{c}") for c in DIMS[:2]), topic_of(text, rules).alias("mix_topic"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"))
    cells = named.groupBy(*(F.col(f"mix_{d}").alias(d) for d in DIMS)).agg(F.sum("n_tokens").alias("tokens"))
    cells = scratch.save(cells, "cells")
    prob = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(float(budget)))
    fitted = scratch.save(rake(cells, budget, alphas, targets or {}, scratch, small=small, **raking).withColumn("prob", prob), "fitted")
    probs = fitted.select(*(F.col(d).alias(f"mix_{d}") for d in DIMS), "prob")
    if fitted.count() <= small:
        probs = F.broadcast(probs)
    return named.join(probs, [f"mix_{d}" for d in DIMS]).where(draw(F.col("doc_id"), seed) < F.col("prob"))

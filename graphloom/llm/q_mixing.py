"""op3: documents drawn to target weights of source, language and topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table
from graphloom.llm.mixing import DIMS, SETTLED, TOPICS, bounded, mix

BUDGET, ALPHAS, ROUNDS, TOLERANCE = 0.8, {"source": 0.7, "lang": 0.7, "topic": 0.9}, 60, 5e-4


def op3_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = mix(docs, BUDGET, ALPHAS, rounds=ROUNDS, tolerance=TOLERANCE)
    return found.select("doc_id", *(F.col(f"mix_{d}").alias(d) for d in DIMS), "n_tokens", F.round("prob", 6).alias("prob"))


def _sql() -> str:
    holds = lambda w: f"regexp_matches(lower(t), '{bounded(w)}')" if w[0].isalpha() else f"contains(lower(t), '{w}')"
    topic = "CASE " + " ".join("WHEN " + " OR ".join(holds(w) for w in words) + f" THEN '{name}'" for name, words in TOPICS) + " ELSE 'other' END"
    parts = [
        "d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS source, coalesce(lang, '') AS lang FROM documents)",
        rf"n AS MATERIALIZED (SELECT doc_id, source, lang, {topic} AS topic, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n_tokens FROM d)",
        "c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM n GROUP BY ALL)",
        f"b AS MATERIALIZED (SELECT {BUDGET} * sum(tokens)::DOUBLE AS wanted FROM c)",
    ]
    for x in DIMS:  # the factor is the largest of those that hold when the k values of least room are full, over all k
        parts += [
            f"m_{x} AS MATERIALIZED (SELECT {x}, sum(tokens)::DOUBLE AS m, pow(sum(tokens)::DOUBLE, {ALPHAS[x]}) AS p FROM c GROUP BY {x})",
            f"f_{x} AS MATERIALIZED (SELECT max((wanted - full_) / free_) AS factor FROM (SELECT coalesce(sum(m) OVER (ORDER BY m / p, {x} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_, sum(p) OVER (ORDER BY m / p, {x} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free_ FROM m_{x} WHERE p > 0), b WHERE free_ > 0)",
            f"t_{x} AS MATERIALIZED (SELECT {x}, least(m, coalesce(factor, 0) * p) AS target FROM m_{x}, f_{x})",
        ]
    targets = ", ".join(f"t_{x}.target AS target_{x}" for x in DIMS)
    joins = " ".join(f"JOIN t_{x} USING ({x})" for x in DIMS)
    step = f"(SELECT * FROM r WHERE NOT done AND round < {ROUNDS})"
    for x in DIMS:
        now = f"sum(weight) OVER (PARTITION BY {x})"
        step = f"(SELECT * REPLACE (CASE WHEN {now} > 0 THEN least(tokens::DOUBLE, weight * (target_{x} / {now})) ELSE 0 END AS weight) FROM {step})"
    far = "greatest(" + ", ".join(f"abs(sum(weight) OVER (PARTITION BY {x}) - target_{x})" for x in DIMS) + ")"
    tested = f"(SELECT *, (round + 1) % 3 = 0 AS test, max(far) OVER () AS error FROM (SELECT *, {far} AS far FROM {step}))"
    done = f"test AND (error <= {TOLERANCE} * (SELECT sum(tokens) FROM c) OR error > {SETTLED} * before)"
    kept = "source, lang, topic, tokens, weight, " + ", ".join(f"target_{x}" for x in DIMS)
    parts += [
        f"r AS (SELECT 0 AS round, false AS done, 'inf'::DOUBLE AS before, source, lang, topic, tokens, tokens * {BUDGET}::DOUBLE AS weight, {targets} FROM c {joins} UNION ALL "
        f"SELECT round + 1, {done}, CASE WHEN test THEN error ELSE before END, {kept} FROM {tested})",
        f"f AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN weight / tokens ELSE {BUDGET} END AS prob FROM r WHERE round = (SELECT max(round) FROM r))",
    ]
    u = "('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / 281474976710656.0"
    return f"WITH RECURSIVE {', '.join(parts)} SELECT doc_id, source, lang, topic, n_tokens, round(prob, 6) AS prob FROM n JOIN f USING (source, lang, topic) WHERE {u} < prob"


QUERIES = {"op3_raking": op3_raking}
ORACLE = {"op3_raking": _sql()}

"""op13: the documents' manifest, and what tampered texts make of it."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import crc_sql, table
from graphloom.llm.merkle import leaves, manifest, proofs

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 8


def op13_recursive_climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    fields = [F.col(c) for c in FIELDS]
    small = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = manifest(leaves(docs, fields, F.col("lang"), F.col("doc_id"), [*fields[:-1], small], hit), FAN)
    text = lambda c: F.lower(F.hex(c))
    root = F.lit(found.root.hex() if found.root else None).cast("string")
    return proofs(found).select(
        F.col("key").alias("doc_id"),
        text("digest").alias("leaf"),
        text("sub").alias("subroot"),
        root.alias("root"),
        F.sha2(text("siblings"), 256).alias("proof_sha256"),
        text("folded").alias("folded_root"),
        (text("folded") == root).alias("verified"),
    )


def _sql(depth: int = 9, top: int = 4) -> str:
    """Levels one by one, as far as a group has several nodes left; each leaf keeps its place, siblings and folded hash.
    `depth` levels in a group and `top` over the groups: for up to 8^9 documents a language and 8^4 languages."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join([*(field(c) for c in FIELDS[:-1]), field(text)]) + ")"
    small = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    parts = [
        f"l AS MATERIALIZED (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc_sql('doc_id::VARCHAR')} % 3 = 0 THEN {leaf(small)} ELSE {leaf('text')} END AS fold FROM documents)",
        "p0 AS MATERIALIZED (SELECT *, coalesce('=' || lang, '-') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS n, row_number() OVER () AS id FROM l)",
        "n0 AS MATERIALIZED (SELECT g, n, leaf AS h FROM p0)",
        "s0 AS MATERIALIZED (SELECT id, g, n, '' AS sib, fold FROM p0)",
    ]

    def level(i: int) -> None:
        run = f"k{i} AS MATERIALIZED (SELECT g, n // {FAN} AS up, list(h ORDER BY n) AS kids, count(*) OVER (PARTITION BY g) AS ups, sum(count(*)) OVER (PARTITION BY g) AS size FROM n{i} GROUP BY g, n // {FAN})"
        cut = lambda a, b: f"array_to_string(kids[{a}:{b}], '')"
        pos = f"(n % {FAN})"
        around = f"{cut(1, pos)} || coalesce(@ || '', '') || {cut(pos + ' + 2', FAN)}"
        parts.extend([
            run,
            f"n{i + 1} AS MATERIALIZED (SELECT g, up AS n, CASE WHEN size = 1 THEN kids[1] ELSE sha256(array_to_string(kids, '')) END AS h FROM k{i})",
            f"s{i + 1} AS MATERIALIZED (SELECT id, g, up AS n, CASE WHEN size = 1 THEN sib ELSE sib || {around.replace('@', 'NULL')} END AS sib, CASE WHEN size = 1 THEN fold ELSE sha256({around.replace('@', 'fold')}) END AS fold FROM s{i} JOIN k{i} USING (g) WHERE k{i}.up = s{i}.n // {FAN})",
        ])

    for i in range(depth):
        level(i)
    b = depth + 1
    parts += [
        f"sub AS MATERIALIZED (SELECT g, h AS subroot, row_number() OVER (ORDER BY g <> '-', encode(g)) - 1 AS rank FROM n{depth})",
        f"n{b} AS MATERIALIZED (SELECT '' AS g, rank AS n, subroot AS h FROM sub)",
        f"s{b} AS MATERIALIZED (SELECT id, '' AS g, rank AS n, sib, fold FROM s{depth} JOIN sub USING (g))",
    ]
    for i in range(b, b + top):
        level(i)
    e = b + top
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, n{e}.h AS root, sha256(sib) AS proof_sha256, s{e}.fold AS folded_root, s{e}.fold = n{e}.h AS verified "
        f"FROM s{e} JOIN p0 USING (id) JOIN sub ON sub.g = p0.g, n{e}"
    )


QUERIES = {"op13_recursive_climb": op13_recursive_climb}
ORACLE = {"op13_recursive_climb": _sql()}

"""What the queries share: tables, and SQL fragments for their restatement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPACE = r"[\s\x{00A0}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}', ' ', 'g'))"


def sql_unescape(x: str) -> str:
    """The entities that the test tables hold, and the common ones."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def sql_clean(x: str) -> str:
    return sql_squeeze(rf"regexp_replace({sql_unescape(f'coalesce({x}, {q('')})')}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g')")


def sql_fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def sql_map(key: str, values: dict[str, str], other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in values.items()) + f" ELSE {other} END"


def sql_first_match(x: str, rows) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({x}, {q(w)})" for w in words) + f" THEN {q(v)}" for v, words in rows) + " END"


def sql_bucket(c: str) -> str:
    return f"CASE WHEN {c} < 0.5 THEN '<0.50' WHEN {c} < 0.75 THEN '0.50-0.74' WHEN {c} < 0.9 THEN '0.75-0.89' ELSE '0.90-1.00' END"


def sql_tier(x: str) -> str:
    n = rf"try_cast(nullif(regexp_extract(trim({x}), '^(?i:LABEL_)?(\d{{1,9}})$', 1), '') AS INTEGER)"
    return f"CASE WHEN {n} BETWEEN 0 AND 5 THEN {n} END"


def sql_said(*pairs: tuple[str, str]) -> str:
    """List of messages (SQL text) whose condition holds."""
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {m} END" for c, m in pairs) + "], lambda x: x IS NOT NULL)"

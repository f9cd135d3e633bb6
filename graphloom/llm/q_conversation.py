"""op11: damaged conversations repaired at the least cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import crc_sql, table
from graphloom.llm.conversation import audits, damage, repair


def op11_coalescing_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, copies = damage(table(spark, sf_dir, "conversations"))
    return audits(repair(rows, copies))


def _sql() -> str:
    """Row after row with the best (cost, audit, output) of each state; structs compare field by field."""
    word = r"[^\x20\x09-\x0D]"
    path = lambda p, cost, edit, line: f"{{'cost': {p}.cost + {cost}, 'audit': {p}.audit || '{edit}', 'out': {p}.out || {line}}}"
    drop = lambda p: path(p, 4, "D", "''")
    keep = lambda p: path(p, "extra", "K", "line")
    role = lambda p, name: path(p, "extra + 3", "R", f"('\n{name}:' || text)")
    fill = lambda p, name: path(p, 3, "I", f"'\n{name}:'")
    start = "{'cost': %s, 'audit': '%s', 'out': '%s'}"
    when = lambda test, value, other: f"CASE WHEN {test} THEN {value} ELSE {other} END"
    may = "fault NOT IN ('blank', 'duplicate')"
    to_u = lambda p: when("c = 'u'", keep(p), role(p, "user"))
    least = lambda *x: f"least({', '.join(x)})"
    return f"""WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM k, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS copy FROM o),
f AS MATERIALIZED (SELECT *, role[1:1] AS c, chr(10) || role || ':' || text AS line, count(*) OVER (PARTITION BY conv_id) AS rows_,
    lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS prior,
    CASE WHEN NOT regexp_matches(text, '{word}') THEN 'blank' WHEN copy > 1 THEN 'duplicate'
         WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    CASE WHEN regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 0 ELSE 3 END AS extra FROM n),
v(conv_id, i, e, s, u, a) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {start % (0, '', '')}, {start % (1000000000, '', '')}, {start % (3, 'I', '@user:')}, {start % (6, 'II', '@user:@assistant:')} FROM k
  UNION ALL
  SELECT conv_id, i, e, s, u, {least("a", fill("u", "assistant"))} FROM (
    SELECT conv_id, i, e, s, {least("u", fill("e", "user"), fill("s", "user"), fill("a", "user"))} AS u, a FROM (
      SELECT v.conv_id, f.i, {drop("e")} AS e, {when(may + " AND c = 's'", least(drop("s"), keep("e")), drop("s"))} AS s,
        {when(may, least(drop("u"), to_u("e"), to_u("s"), to_u("a")), drop("u"))} AS u,
        {when(may, least(drop("a"), when("c = 'a'", keep("u"), role("u", "assistant"))), drop("a"))} AS a
      FROM v JOIN f ON v.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = v.i + 1))),
b AS (SELECT conv_id, arg_max(least(e, a), i) AS best FROM v GROUP BY conv_id),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (prior IS NOT NULL AND prior || c NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, best.cost::BIGINT AS cost, best.audit AS audit, sha256(best.out[2:]) AS repaired_sha256
FROM b LEFT JOIN t ON b.conv_id IS NOT DISTINCT FROM t.conv_id""".replace("'@user:@assistant:'", "chr(10) || 'user:' || chr(10) || 'assistant:'").replace("'@user:'", "chr(10) || 'user:'")


QUERIES = {"op11_coalescing_viterbi": op11_coalescing_viterbi}
ORACLE = {"op11_coalescing_viterbi": _sql()}

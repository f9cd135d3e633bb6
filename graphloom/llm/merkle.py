"""Merkle manifest of a dataset, checked by a recursive query that climbs from the leaves to the root.

Rows are leaves of one tree a group (say, a language); runs of `fan` consecutive nodes become a node, and the groups' roots
become one tree in the same way. Built levels are stored as rows: runs with their leaves, and for every other node a row
with its parent, the digests of its siblings before and after it, and the number of leaf runs below its parent. A recursive
query starts at the leaf runs and joins each with its node's row: it appends the siblings to the path and folds them around
the hash carried along, one hash a leaf. Leaves of one run share all later siblings, so they climb in one row; what they
don't share, the siblings within the run, is put before the path at the end.

All paths end at the root, so the join of the upper levels would be one key: a node's row stands as often as its number of
leaf runs asks for (one copy for 4,096 of them) and each path takes the copy that its own hash chooses. Numbers within
a group come from ranges of the sorted leaves, their sizes by group, and a number in each range; a group of any size is
spread. Digests are binary in the tables; hashes are over their hexadecimal text.

Nulls and odd rows: null fields have their own mark in a leaf, other than the empty text's; rows of null group are a group
and rows of null key come first in theirs; equal keys follow each other by digest, and repeated rows are a leaf each; extra
columns are ignored; an empty table has no root and gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import Scratch

PART = 4096


class Manifest(NamedTuple):
    """Tables runs (id, group root's digest if it is one, leaves: array of at, key, digest and altered digest, lone) and nodes
    (id, salt, parent, below, before, after, sub), the root's id and digest (None for an empty table)."""

    runs: DataFrame
    nodes: DataFrame
    root_id: str | None
    root: bytes | None


def field(column: Column) -> Column:
    """A field in a leaf: `-` if null, else its UTF-8 length, a colon and its text."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(fields: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*(field(c) for c in fields)), 256))


def hashed(digests: Column) -> Column:
    """Hash of concatenated digests as hexadecimal text."""
    return F.unhex(F.sha2(F.lower(F.hex(digests)), 256))


def joined(digests: Column) -> Column:
    """An array of digests as one binary."""
    return F.aggregate(digests, F.lit(b""), lambda a, x: F.concat(a, x))


def leaves(rows: DataFrame, fields: Sequence[Column], group: Column, key: Column, altered: Sequence[Column] | None = None, where: Column | None = None) -> DataFrame:
    """grp, key, digest and altered: the digest with other fields, where a row is altered."""
    other = F.when(where, digest(altered)) if altered else F.lit(None).cast("binary")
    return rows.select(group.alias("grp"), key.alias("key"), digest(fields).alias("digest"), other.alias("altered"), F.rand().alias("tie"))


def ranked(rows: DataFrame, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """rows with n, their number in their group (from 0), and size, the group's number of rows."""
    by = [F.col("grp").asc_nulls_first(), *order]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = scratch.save(placed.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), name)
    group = Window.partitionBy("grp")
    spans = placed.groupBy("part", "grp").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(F.col("part").alias("p"), F.col("grp").alias("g"), "first", before.alias("before"), F.sum("rows").over(group).alias("size"))
    found = placed.join(spans, (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("g")))
    return found.withColumn("n", F.col("at") - F.col("first") + F.col("before")).drop("part", "at", "first", "before", "p", "g", "tie")


def _name(level: Column | int, n: Column, top: bool) -> Column:
    return F.concat(F.lit("top:" if top else ""), F.lit(level).cast("string"), F.lit(":"), n.cast("string"), F.lit(":"), F.coalesce(field(F.col("grp")), F.lit("-")))


def _levels(nodes: DataFrame, fan: int, top: bool, scratch: Scratch) -> list[DataFrame]:
    """Levels above rows (grp, n, size, id, digest, below): per level grp, n, size, id, kids, digest, below and last, if the
    node is its group's root."""
    found, size = [], nodes.agg(F.max("size")).first()[0] or 0
    level, reach = 0, 1
    while reach < size:
        level, reach = level + 1, reach * fan
        kid = ["n", "id", "digest", "below", *(c for c in ("key", "altered") if c in nodes.columns)]
        up = nodes.where(F.col("size") > reach // fan).groupBy("grp", "size", F.floor(F.col("n") / fan).alias("up"))
        up = up.agg(F.array_sort(F.collect_list(F.struct(*kid))).alias("kids"))
        up = up.select("grp", F.col("up").alias("n"), "size", _name(level, F.col("up"), top).alias("id"), "kids", hashed(joined(F.transform("kids", lambda k: k["digest"]))).alias("digest"))
        below = F.lit(1).cast("long") if level == 1 and not top else F.aggregate("kids", F.lit(0).cast("long"), lambda a, k: a + k["below"])
        nodes = scratch.save(up.withColumn("below", below).withColumn("last", F.col("size") <= reach), f"{'top' if top else 'level'}{level}")
        found.append(nodes)
    return found


def _links(runs: DataFrame, sub: bool) -> DataFrame:
    """A row for each kid of a run."""
    before = F.slice("all", 1, F.col("pos"))
    after = F.slice("all", F.col("pos") + 2, F.greatest(F.size("all") - F.col("pos") - 1, F.lit(0)))
    kids = runs.select("*", F.transform("kids", lambda k: k["digest"]).alias("all"), F.posexplode("kids").alias("pos", "kid"))
    root = F.when(F.col("last"), F.col("digest")) if sub else F.lit(None).cast("binary")
    return kids.select(
        F.col("kid.id").alias("id"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("kid.below") / PART), F.lit(1)) - 1)).alias("salt"),
        F.col("id").alias("parent"),
        "below",
        joined(before).alias("before"),
        joined(after).alias("after"),
        root.alias("sub"),
    )


def manifest(found: DataFrame, fan: int = 8) -> Manifest:
    """The manifest of leaves(): stored levels of each group's tree and of the tree over the groups."""
    spark, scratch = found.sparkSession, Scratch(found.sparkSession, "merkle")
    first = ranked(scratch.save(found, "leaves"), [F.col("key").asc_nulls_first(), F.col("digest").asc(), F.col("tie").asc()], scratch, "sorted")
    first = scratch.save(first.select("*", _name(0, F.col("n"), False).alias("id"), F.lit(1).cast("long").alias("below")), "numbered")
    scratch.drop("leaves", "sorted")
    levels = _levels(first, fan, False, scratch)
    lone = first.where("size = 1")
    roots = lone.select("grp", "id", "digest", "below")
    for level in levels:
        roots = roots.unionByName(level.where("last").select("grp", "id", "digest", "below"))
    seconds = ranked(roots.withColumn("name", F.col("grp")).withColumn("grp", F.lit("")), [F.col("name").asc_nulls_first()], scratch, "roots").drop("name")
    upper = _levels(seconds, fan, True, scratch)
    end = (upper[-1] if upper else seconds).select("id", "digest").first()
    leaf = lambda x: F.struct(x["n"].alias("n"), x["key"].alias("key"), x["digest"].alias("digest"), x["altered"].alias("altered"))
    alone = lone.select("id", F.col("digest").alias("sub"), F.array(F.struct("n", "key", "digest", "altered")).alias("leaves"), F.lit(True).alias("lone"))
    runs, links = alone, None
    for i, level in enumerate(levels + upper):
        if i == 0 and levels:
            runs = runs.unionByName(level.select("id", F.when(F.col("last"), F.col("digest")).alias("sub"), F.transform("kids", leaf).alias("leaves"), F.lit(False).alias("lone")))
            continue
        more = _links(level, sub=i < len(levels))
        links = more if links is None else links.unionByName(more)
    if links is None:
        links = spark.createDataFrame([], "id string, salt long, parent string, below long, before binary, after binary, sub binary")
    return Manifest(runs, scratch.save(links, "nodes"), end and end["id"], end and bytes(end["digest"]))


CLIMB = """
WITH RECURSIVE climb(run, at, below, sub, path, folds) AS (
  SELECT id, id, 1L, sub, X'', folds FROM {starts}
  UNION ALL
  SELECT /*+ MERGE(n) */ c.run, n.parent, n.below, coalesce(c.sub, n.sub), concat(c.path, n.before, n.after),
    transform(c.folds, f -> unhex(sha2(lower(hex(concat(n.before, f, n.after))), 256)))
  FROM climb c JOIN {nodes} n ON n.id = c.at AND n.salt = pmod(xxhash64(c.run), greatest(ceil(c.below / {part}), 1)))
SELECT run, sub, path, folds FROM climb WHERE at = {root}"""


def proofs(found: Manifest) -> DataFrame:
    """Per leaf: key, digest, sub (its group's root), siblings (digests from its own run up to the root) and folded, the root
    that follows from its altered digest (or its own) and these siblings."""
    spark, scratch = found.nodes.sparkSession, Scratch(found.nodes.sparkSession, "climb")
    around = lambda i: F.array_compact(F.transform("leaves", lambda k, j: F.when(j != i, k["digest"])))
    claimed = lambda k: F.coalesce(k["altered"], k["digest"])
    folded = lambda i: hashed(joined(F.transform("leaves", lambda k, j: F.when(j == i, claimed(k)).otherwise(k["digest"]))))
    folds = F.when(F.col("lone"), F.transform("leaves", claimed)).otherwise(F.transform("leaves", lambda k, i: folded(i)))
    starts = found.runs.select("id", "sub", folds.alias("folds"))
    limit = "spark.sql.cteRecursionRowLimit"
    old = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # a row a run and level; the default bound is a million
    try:
        ends = scratch.save(spark.sql(CLIMB, starts=starts, nodes=found.nodes, part=PART, root=found.root_id or ""), "ends")
    finally:
        spark.conf.set(limit, old)
    met = ends.join(found.runs.drop("sub"), F.col("run") == F.col("id"))
    each = met.select("sub", "path", "folds", "leaves", F.posexplode("leaves").alias("i", "leaf"))
    return each.select(
        F.col("leaf.key").alias("key"),
        F.col("leaf.digest").alias("digest"),
        "sub",
        F.concat(joined(around(F.col("i"))), "path").alias("siblings"),
        F.element_at("folds", F.col("i") + 1).alias("folded"),
    )

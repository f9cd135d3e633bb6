"""Neighbourhood paths of one to three edges: start search, filters over whole paths, and a limit that reaches every hop.

Paths come in one order: fewer hops first, then by start and edge ids. A limit needs the first paths only, so each hop is
given no more than what can still count: one-edge paths are taken in batches of that order, and of the paths before the
last hop the first ones that have a valid next edge, which the ends' degrees tell without making it. The adjacency of a
node is dealt out over as many parts as its degree asks for, and a path is copied to the parts of its end: no join key
holds a hub's edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.unicode import casefold
from graphloom.operators.graph import ENDS
from graphloom.operators.review import number_rows
from graphloom.sources.tables import written

#: Edges a part of a node's adjacency; one-edge paths of the first batch, at least.
PART, BATCH = 4096, 1000


class Paths:
    """Filtered edges with ids (1, 2, ... in the order of their ends), as adjacency in parts."""

    def __init__(self, edges: DataFrame, relations: tuple[str, ...] = (), min_tier: int = 0, min_citations: int = 1, labels: tuple[str, ...] = (), part: int = PART):
        kept = edges.where((F.col("evidence_tier") >= min_tier) & (F.col("citations") >= min_citations))
        if relations:
            kept = kept.where(F.col("relation").isin(*relations))
        self.edges = written(number_rows(kept.select(*ENDS), [F.col(c) for c in ENDS], "edge"))
        node = lambda s: F.struct(F.col(f"{s}_label").alias("label"), F.col(f"{s}_key").alias("key"))
        ways = self.edges.select("edge", node("head").alias("at"), node("tail").alias("to"))
        back = ways.where("at <> to").select("edge", F.col("to").alias("at"), F.col("at").alias("to"))
        hit = F.col("to.label").isin(*labels) if labels else F.lit(True)
        both = ways.unionByName(back).withColumn("hit", hit)
        degrees = both.groupBy("at").agg(F.count("*").alias("degree"), F.count_if("hit").alias("hits"))
        self.labels, self.part = labels, part
        self.degrees = written(degrees)
        self._salts = F.greatest(F.ceil(F.col("degree") / part), F.lit(1))
        self.adjacency = written(both.join(self.degrees.select("at", "degree"), "at").withColumn("salt", F.pmod(F.xxhash64("edge"), self._salts)).drop("degree"))

    def starts(self, search: str = "", label: str | None = None) -> DataFrame:
        """Nodes of the edges whose key holds the text, of any case."""
        found = self.degrees.select("at").where(F.contains(casefold(F.col("at.key")), F.lit(search.strip().casefold())))
        return found.where(F.col("at.label") == label) if label else found

    def _step(self, paths: DataFrame) -> DataFrame:
        """Every path by one more edge, none twice."""
        many = paths.join(self.degrees.select("at", "degree"), "at").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), self._salts - 1)))
        met = many.join(self.adjacency.withColumnRenamed("hit", "more"), ["at", "salt"]).where(~F.array_contains("path", F.col("edge")))
        return met.select("start", F.col("to").alias("at"), F.array_append("path", F.col("edge")).alias("path"), F.array_append("nodes", F.col("to")).alias("nodes"), (F.col("hit") | F.col("more")).alias("hit"))

    def _extensible(self, paths: DataFrame) -> DataFrame:
        """Paths with a valid next edge: their end has more edges (to a label that counts, if the path has none) than the path's
        own at that end. An edge of the path stands at its end once for each of its two nodes there."""
        used = lambda test: F.size(F.filter(F.sequence(F.lit(1), F.size("path")), test))
        touches = lambda i: (F.element_at("nodes", i) == F.col("at")) | (F.element_at("nodes", i + 1) == F.col("at"))
        met = paths.join(self.degrees, "at")
        if not self.labels:
            return met.where(F.col("degree") > used(touches)).drop("degree", "hits")
        other = lambda i: F.when(F.element_at("nodes", i) == F.col("at"), F.element_at("nodes", i + 1)).otherwise(F.element_at("nodes", i))
        taken = used(lambda i: touches(i) & other(i)["label"].isin(*self.labels))
        return met.where(F.when(F.col("hit"), F.col("degree") > used(touches)).otherwise(F.col("hits") > taken)).drop("degree", "hits")

    def of(self, starts: DataFrame, depth: int, limit: int | None = None) -> DataFrame:
        """Paths from these nodes: start, end (structs label, key), hops, path (edge ids), nodes; with a limit the first of them."""
        if depth not in (1, 2, 3):
            raise ValueError("depth must be 1, 2 or 3")
        if limit is not None and limit < 1:
            raise ValueError("limit must be at least 1")
        hit = F.col("at.label").isin(*self.labels) if self.labels else F.lit(True)
        nothing = F.array().cast("array<long>")
        zero = starts.distinct().select(F.col("at").alias("start"), "at", nothing.alias("path"), F.array("at").alias("nodes"), hit.alias("hit"))
        one = self._step(zero)
        shown = lambda p: p.where("hit").select("start", F.col("at").alias("end"), F.size("path").alias("hops"), "path", "nodes")
        if limit is None:
            out, now = shown(one), one
            for _ in range(depth - 1):
                now = self._step(now)
                out = out.unionByName(shown(now))
            return out
        one = written(one)
        order = [F.col("start.label"), F.col("start.key"), F.col("path")]
        found = written(one.where("hit").orderBy(*order).limit(limit))
        parts, left = [found], limit - found.count()
        for hops in range(2, depth + 1):
            if left <= 0:
                break
            more, left = self._deeper(one, hops, left, order)
            parts += more
        out = shown(parts[0])
        for p in parts[1:]:
            out = out.unionByName(shown(p))
        return out

    def _deeper(self, one: DataFrame, hops: int, left: int, order: list[Column]) -> tuple[list[DataFrame], int]:
        """The first `left` paths of this many edges, from batches of one-edge paths in order; each batch adds whole answers."""
        parts, after, size = [], None, BATCH
        while left > 0:
            rest = one if after is None else one.where(F.struct(*order) > F.struct(F.lit(after["label"]).alias("label"), F.lit(after["key"]).alias("key"), F.array(*map(F.lit, after["path"])).cast("array<long>").alias("path")))
            batch = written(rest.orderBy(*order).limit(size))
            last = batch.orderBy(*[c.desc() for c in order]).select("start.label", "start.key", "path").first()
            if last is None:
                break
            now = batch
            for _ in range(hops - 2):
                now = self._step(now)
            now = self._extensible(now).orderBy(*order).limit(left)
            found = written(self._step(now).where("hit").orderBy(*order).limit(left))
            parts.append(found)
            left, after, size = left - found.count(), last.asDict(), size * 4
        return parts, left

    def edges_of(self, paths: DataFrame) -> DataFrame:
        """The paths' edges, once each, with their ids."""
        ids = paths.select(F.explode("path").alias("edge")).distinct()
        return self.edges.join(ids, "edge", "left_semi")

"""Near-duplicate groups by SimHash fingerprints.

Fingerprints are split into blocks, documents meet where blocks are equal, and every link is verified by its Hamming
distance. With one lane of 64 bits the blocks are combined: if two fingerprints differ in at most `radius` bits, at least
`blocks - radius` of the blocks agree, so no close pair can miss every combination. For looser similarities a fingerprint
has several lanes, too many for every combination; then a key is a choice of four-bit blocks, as many as tell the number
of fingerprints apart, and there are as many keys as a pair of the wanted similarity needs to share one but for a
fiftieth. Both numbers follow from the table's size, none of the pairs that meet is left out.

Copies are one fingerprint; of a dense bucket only links of a spanning forest leave it, so that no group is expanded into
all pairs and no link between groups is lost.

Nulls and odd rows: null text counts as empty; a text without words has fingerprint zero and links like any other;
null doc_id takes part but never names a component unless all of its ids are null; repeated rows stay, each with the
same result; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Scratch, blobs, heavy_keys, salted_join, text_of

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
_SMALL = 8


def fingerprint(text: bytes, width: int, lanes: int = 1) -> np.ndarray:
    """SimHash of the word shingles of a text, 64 bits a lane; a bit is 1 if set in over half of the hashes."""
    words = text.lower().split()
    if not words:
        return np.zeros(lanes, np.uint64)
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = np.array([digest(line, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
        hashes = np.fromiter([digest(line[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64, len(starts))
    n, counts = len(hashes), np.zeros(256 * 8 * lanes, np.int64)
    for at in range(0, n, 4096):
        h = np.repeat(hashes[at : at + 4096, None], lanes, axis=1)
        more = h[:, 1:] * (np.uint64(0x9E3779B97F4A7C15) + np.arange(2, 2 * lanes, 2, dtype=np.uint64))
        more = (more ^ (more >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h[:, 1:] = more ^ (more >> np.uint64(29))
        octets = h.view(np.uint8).reshape(len(h), 8 * lanes) + np.arange(0, 256 * 8 * lanes, 256, dtype=np.int64)
        counts += np.bincount(octets.ravel(), minlength=len(counts))
    ones = counts.reshape(-1, 256).astype(np.float64) @ _BITS
    return np.packbits(2 * ones.ravel() > n, bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, width: int = 5, lanes: int = 1) -> DataFrame:
    """doc_id, fp (array of long: the bits of the unsigned lanes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.concatenate([np.zeros(0, np.uint64), *(fingerprint(x, width, lanes) for x in blobs(batch.column(1)))]).view(np.int64)
            offsets = pa.array(np.arange(0, len(fp) + 1, lanes, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(fp))], ["doc_id", "fp"])

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id, text_of().cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp array<long>")


def _near(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64) <= radius


def forest(node: np.ndarray, fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest of the graph "at most `radius` bits apart": each member leaves the unvisited once."""
    out = []
    while len(node):
        frontier, node, fps = [(node[0], fps[0])], node[1:], fps[1:]
        while frontier and len(node):
            i, x = frontier.pop()
            near = _near(fps, x, radius)
            if near.any():
                out.append((np.full(near.sum(), i), node[near]))
                frontier.extend(zip(node[near], fps[near]))
                node, fps = node[~near], fps[~near]
    return out


def _links(radius: int, lanes: int):
    """Rows (key, node, fp) sorted by key -> links (a, b); a key's rows may span batches."""

    def of(key: np.ndarray, node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.diff(key)) + 1
        starts, sizes = np.concatenate(([0], cut)), np.diff(np.concatenate(([0], cut, [len(key)])))
        end = np.repeat(starts + sizes, sizes)
        few = np.repeat(sizes <= _SMALL, sizes)
        a, b = [], []
        for step in range(1, _SMALL):
            i = np.flatnonzero(few & (np.arange(len(key)) + step < end))
            i = i[_near(fp[i], fp[i + step], radius)]
            a.append(node[i])
            b.append(node[i + step])
        for s, n in zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist()):
            one = s + np.unique(node[s : s + n], return_index=True)[1]
            for x, y in forest(node[one], fp[one], radius):
                a.append(x)
                b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, lanes), np.uint64))
        for batch in batches:
            fp = batch.column(2).flatten().to_numpy().view(np.uint64).reshape(-1, lanes)
            held = tuple(np.concatenate(x) for x in zip(held, (batch.column(0).to_numpy(), batch.column(1).to_numpy(), fp)))
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if whole:
                yield of(*(x[:whole] for x in held))
                held = tuple(x[whole:] for x in held)
        if len(held[0]):
            yield of(*held)

    return run


def block_masks(blocks: int, radius: int) -> list[int]:
    """Masks of every combination of `blocks - radius` of the blocks."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    return [sum(x) for x in itertools.combinations(parts, blocks - radius)]


def blocks_for(n: int, radius: int) -> int:
    """Fewest blocks whose combined keys have two bits more than the number of fingerprints needs: at every choice no
    close pair is missed, it only decides how many unrelated fingerprints meet."""
    need = min(40, math.log2(max(n, 2)) + 2)
    return next(b for b in range(radius + 1, 17) if 64 * (b - radius) // b >= need or b == 16)


def keys_for(n: int, similarity: float, missed: float = 0.02) -> tuple[int, int]:
    """(bits a key, keys): keys have three bits more than the number of fingerprints needs, and of pairs of that Jaccard
    similarity a share of `missed` shares no key. Bits of two fingerprints differ in proportion to the angle between
    their shingle sets."""
    bits = math.ceil(math.log2(max(n, 2))) + 3
    same = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    return bits, math.ceil(math.log(missed) / math.log(1 - same**bits))


def _keys(bits: int, keys: int, lanes: int):
    """Rows (node, fp) -> (key, node), a row for each choice of four-bit blocks, the last of them cut to what is left."""
    rng = np.random.default_rng(11)
    choices = [np.sort(rng.choice(16 * lanes, -(-bits // 4), replace=False)) for _ in range(keys)]
    spare = np.uint64(-bits % 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().view(np.uint8).reshape(-1, 8 * lanes)
            for at in range(0, len(node), 1000):
                octets = fp[at : at + 1000]
                parts = np.stack((octets & 15, octets >> 4), axis=2).reshape(len(octets), -1).astype(np.uint64)
                out = np.empty((keys, len(octets)), np.uint64)
                for i, choice in enumerate(choices):
                    value = np.full(len(octets), i, np.uint64)
                    for c in choice:
                        value = value << np.uint64(4) | parts[:, c]
                    out[i] = value >> spare
                yield pa.RecordBatch.from_arrays([pa.array(out.ravel().view(np.int64)), pa.array(np.tile(node[at : at + 1000], keys))], ["key", "node"])

    return run


def components(links: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b): node, root (smallest node). Alternating large-star and small-star steps;
    each round is written to the shared folder, only a count and a checksum reach the driver. Rounds grow with the logarithm
    of the longest chain; should `rounds` not do, it raises an error rather than return half-joined components."""
    edges = scratch.save(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges0")
    seen = None
    for i in range(1, rounds + 1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch.save(low.select("u", F.col("m").alias("v")).unionByName(small).distinct(), f"edges{i}")
        scratch.drop(f"edges{i - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now
    raise RuntimeError(f"components not settled after {rounds} rounds")


def near_duplicates(docs: DataFrame, width: int = 5, radius: int | None = None, lanes: int = 16, blocks: int | None = None, similarity: float = 0.8, tile: int = 4096) -> DataFrame:
    """Per document: doc_id, fp (array of long, one a lane), component_id (smallest doc_id reachable over links of at most
    `radius` bits). The default radius is where the fingerprints of two texts of that Jaccard similarity differ, with two
    standard deviations to spare.

    A bucket of over `tile` fingerprints is dealt out as pairs of tiles.
    """
    if radius is None:
        differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
        radius = int(64 * lanes * differ + 2 * math.sqrt(64 * lanes * differ * (1 - differ)))
    scratch = Scratch(docs.sparkSession, "simhash")
    marks = scratch.save(fingerprints(docs, width, lanes).withColumn("node", F.col("fp")[0] if lanes == 1 else F.xxhash64("fp")), "marks")
    groups = scratch.save(marks.groupBy("node").agg(F.min("doc_id").alias("low"), F.first("fp").alias("fp"), F.count("*").alias("n")), "groups")
    if lanes == 1:
        masks = block_masks(blocks or blocks_for(groups.count(), radius), radius)
        parts = [F.xxhash64(F.lit(i), F.col("fp")[0].bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(masks)]
        keys = groups.select(F.explode(F.array(*parts)).alias("key"), "node")
    else:
        keys = groups.select("node", "fp").mapInArrow(_keys(*keys_for(groups.count(), similarity), lanes), "key long, node long")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = keys.join(sizes, "key").join(groups.select("node", "fp"), "node")
    tiles = F.ceil(F.col("n") / tile)
    mine = F.pmod(F.xxhash64("node"), tiles)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), tiles - 1), lambda j: F.xxhash64("key", F.least(mine, j), F.greatest(mine, j)))
    met = met.select(F.explode(F.when(F.col("n") > tile, pairs).otherwise(F.array("key"))).alias("key"), "node", "fp")
    links = met.repartition("key").sortWithinPartitions("key").mapInArrow(_links(radius, lanes), "a long, b long")
    found = scratch.save(components(links, scratch), "components")
    low = found.join(groups, found["node"] == groups["node"]).groupBy("root").agg(F.min("low").alias("component_id"))
    named = found.join(low, "root").select("node", "component_id")
    reach = groups.join(named, "node", "left").select("node", F.coalesce("component_id", "low").alias("component_id"))
    copies = scratch.save(heavy_keys(groups.select("node", "n"), ["node"]), "heavy")
    return salted_join(marks, reach, ["node"], copies, F.xxhash64("doc_id")).select("doc_id", "fp", "component_id")

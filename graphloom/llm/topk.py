"""Exact top-k search of 64-bit codes by Hamming distance: incremental multi-index hashing.

Each segment of the codes is an index of its own. Search radii grow segment by segment: once all segments have been
searched at radius r - 1 and s of them at radius r, every code within m * r + s - 1 bits has been met (with m segments),
since a farther one alone can differ by more in each. What is met is verified by its whole distance; a query ends when
its k-th verified distance is covered in that way, so the result is exact, ties by smaller id included.

Nulls and odd rows: null ids and null codes take no part; of rows with one id one stays, chosen by its content; a
query never finds its own id; extra columns are ignored; an empty table gives an empty result; a query with fewer than k
others gets them all.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.blocks import search
from graphloom.llm.common import concat_ranges


def segments_for(n: int) -> int:
    """Segments of about log2(n) bits each, 8 to 16."""
    return min(8, max(4, round(64 / max(np.log2(max(n, 2)), 1))))


def _flips(bits: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for c in itertools.combinations(range(bits), radius)], np.int64)


class MultiIndex:
    """An index of a block's codes for each of their segments."""

    def __init__(self, codes: np.ndarray):
        self.codes, m = codes, segments_for(len(codes))
        self.edges = [round(i * 64 / m) for i in range(m + 1)]
        self.width = [b - a for a, b in itertools.pairwise(self.edges)]
        self.order, self.first = [], []
        for s in range(m):
            v = self.part(codes, s)
            self.order.append(np.argsort(v, kind="stable"))
            self.first.append(np.concatenate(([0], np.cumsum(np.bincount(v, minlength=1 << self.width[s])))))

    def part(self, x: np.ndarray, s: int) -> np.ndarray:
        return ((x >> np.uint64(self.edges[s])) & np.uint64((1 << self.width[s]) - 1)).astype(np.int64)


def multi_index(index: MultiIndex, queries: np.ndarray, own: np.ndarray, k: int, chunk: int = 64) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query: rows and distances of its k nearest codes and of all that tie with the last."""
    codes, width, part, order, first = index.codes, index.width, index.part, index.order, index.first
    n, m = len(codes), len(width)
    flips: dict[tuple[int, int], np.ndarray] = {}
    out = []
    for at in range(0, len(queries), chunk):
        q = queries[at : at + chunk]
        seen, tally = np.zeros((len(q), n), bool), np.zeros((len(q), 65), np.int64)
        for i, o in enumerate(own[at : at + chunk]):
            if o >= 0:
                seen[i, o] = True
        want = np.minimum(k, n - (own[at : at + chunk] >= 0))
        held: list[tuple[np.ndarray, ...]] = []
        active = np.flatnonzero(want > 0)
        for radius, s in itertools.product(range(max(width) + 1), range(m)):
            if not len(active):
                break
            if (width[s], radius) not in flips:
                flips[width[s], radius] = _flips(width[s], radius)
            v = part(q[active], s)[:, None] ^ flips[width[s], radius]
            start, size = first[s][v].ravel(), (first[s][v + 1] - first[s][v]).ravel()
            rows = order[s][concat_ranges(start, size)]
            who = np.repeat(np.repeat(active, v.shape[1]), size)
            new = ~seen[who, rows]
            who, rows = who[new], rows[new]
            seen[who, rows] = True
            distance = np.bitwise_count(q[who] ^ codes[rows]).astype(np.int64)
            np.add.at(tally, (who, distance), 1)
            held.append((who, rows, distance))
            covered = min(64, m * radius + s)
            active = active[tally[active, : covered + 1].sum(axis=1) < want[active]]
        who, rows, distance = (np.concatenate(x) for x in zip(*held)) if held else [np.zeros(0, np.int64)] * 3
        by = np.argsort(who, kind="stable")
        cuts = np.searchsorted(who[by], np.arange(len(q) + 1))
        for i in range(len(q)):
            mine = by[cuts[i] : cuts[i + 1]]
            last = int(np.searchsorted(np.cumsum(tally[i]), want[i])) if want[i] > 0 else -1
            mine = mine[distance[mine] <= last]
            out.append((rows[mine], distance[mine]))
    return out


def nearest_codes(rows: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", code: Column | None = None, block: int = 16384, query_block: int = 256) -> DataFrame:
    """query_id, rank, the id column, distance (int). code: a long whose 64 bits are compared (default: column `code`)."""
    code = F.col("code") if code is None else code
    good = rows.select(F.col(id_column).cast("long").alias("id"), code.cast("long").alias("payload"), is_query.alias("asked")).where("id is not null and payload is not null")

    def index(ids: np.ndarray, codes: pa.Array):
        held = MultiIndex(codes.to_numpy().view(np.uint64))

        def ask(query_ids: np.ndarray, queries: pa.Array):
            place = np.minimum(np.searchsorted(ids, query_ids), len(ids) - 1)
            found = multi_index(held, queries.to_numpy().view(np.uint64), np.where(ids[place] == query_ids, place, -1), k)
            out = []
            for u, (r, distance) in enumerate(found):
                top = np.lexsort((ids[r], distance))[:k]
                out.append((np.full(len(top), query_ids[u]), ids[r][top], distance[top].astype(np.float64)))
            return tuple(map(np.concatenate, zip(*out)))

        return ask

    found = search(good, F.col("asked"), index, k, "low", block, query_block)
    return found.select("query_id", "rank", F.col("id").alias(id_column), F.col("score").cast("int").alias("distance"))


def sign_code(column: str = "embedding") -> Column:
    """Bit i is 1 where component i is above 0; null unless there are 64 components, none of them null or NaN."""
    x = F.col(column).cast("array<double>")
    whole = (F.size(x) == 64) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v))
    bits = F.aggregate(F.transform(x, lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.when(whole, bits)

"""Approximate nearest neighbours by collision counting.

Each of a block's projections is one sorted array of its vectors' values. A query's own values stand in the middle of a
window in every array; the windows widen step by step (virtual rehashing: no table is built again). A vector that falls
into the windows of at least a share of the projections is verified by its exact cosine. A query ends when its k-th
verified distance is one that windows of that width find with the wanted probability; windows grow to that width and
no further, so that few vectors beyond it collide.

Nulls and odd rows: vectors that are null, zero, or hold null or non-finite components take no part, as query or as
candidate; vectors are compared with those of their own length; of rows with one id one stays, chosen by its content;
null ids take no part;
extra columns are ignored; an empty table gives an empty result; a query with fewer than k candidates gets them all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.blocks import search


def _ratio(projections: int, share: float, sigmas: float) -> float:
    """Half-width over distance at which a vector meets `share` of the windows, `sigmas` standard deviations to spare."""
    from statistics import NormalDist

    p = next(p for p in np.linspace(share, 0.999, 2000) if p - sigmas * (p * (1 - p) / projections) ** 0.5 >= share)
    return NormalDist().inv_cdf((1 + p) / 2)


class Arrays:
    """A block's unit vectors and the sorted arrays of their projections; directions are orthogonal as far as they can be."""

    def __init__(self, x: np.ndarray, projections: int, seed: int):
        d, rng = x.shape[1], np.random.default_rng(seed)
        turns = [np.linalg.qr(rng.normal(size=(d, d)))[0] * d**0.5 for _ in range(-(-projections // d))]
        self.x, self.directions = x, np.concatenate(turns, axis=1)[:, :projections]
        h = (x @ self.directions).T
        order = np.argsort(h, axis=1, kind="stable")
        self.values, self.order = np.take_along_axis(h, order, axis=1), order.ravel()

    def places(self, values: np.ndarray, side: str) -> np.ndarray:
        """Positions in `order`, a row a projection."""
        n = len(self.x)
        return np.stack([np.searchsorted(own, v, side) + j * n for j, (own, v) in enumerate(zip(self.values, values))])

    def collide(self, q: np.ndarray, own: np.ndarray, k: int, share: float, sigmas: float, start: float = 0.25, growth: float = 1.1) -> list[np.ndarray]:
        """For each query (unit vectors q) the rows that were verified; own: the query's own row, or -1."""
        n, projections = len(self.x), len(self.values)
        hq = (q @ self.directions).T
        least, ratio = int(np.ceil(share * projections)), _ratio(projections, share, sigmas)
        lo = self.places(hq, "left")
        hi = lo.copy()
        counts = np.zeros((len(q), n), np.uint16)
        checked: list[list[np.ndarray]] = [[] for _ in q]
        best: list[np.ndarray] = [np.zeros(0)] * len(q)
        active, half = np.arange(len(q)), np.full(len(q), start)
        while len(active):
            wide_lo, wide_hi = self.places(hq[:, active] - half[active], "left"), self.places(hq[:, active] + half[active], "right")
            still = []
            for i, u in enumerate(active.tolist()):
                starts = np.concatenate((wide_lo[:, i], hi[:, u])).tolist()
                ends = np.concatenate((lo[:, u], wide_hi[:, i])).tolist()
                before = counts[u] >= least
                counts[u] += np.bincount(np.concatenate([self.order[a:b] for a, b in zip(starts, ends)]), minlength=n).astype(np.uint16)
                lo[:, u], hi[:, u] = wide_lo[:, i], wide_hi[:, i]
                new = np.flatnonzero((counts[u] >= least) & ~before)
                new = new[new != own[u]]
                if len(new):
                    checked[u].append(new)
                    best[u] = np.sort(np.concatenate((best[u], 2 - 2 * (self.x[new] @ q[u]))))[:k]
                if (hi[:, u] - lo[:, u] == n).all():
                    continue
                enough = ratio * max(best[u][-1], 0) ** 0.5 if len(best[u]) == k else np.inf
                if half[u] < enough:
                    half[u] = min(half[u] * growth, enough)
                    still.append(u)
            active = np.array(still, np.int64)
        return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in checked]


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def nearest(rows: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", column: str = "embedding", projections: int = 128, share: float = 0.75, sigmas: float = 1.0, block: int = 16384, query_block: int = 256, seed: int = 7) -> DataFrame:
    """query_id, rank, the id column, score (cosine in double precision)."""
    number = F.col(column).cast("array<double>")
    finite = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(number, lambda x: x != 0)
    good = rows.where(F.col(id_column).isNotNull() & F.col(column).isNotNull() & finite)
    good = good.select(F.col(id_column).cast("long").alias("id"), number.alias("payload"), is_query.alias("asked"))

    def index(ids: np.ndarray, vectors: pa.Array):
        lengths, built = np.diff(vectors.offsets.to_numpy()), {}

        def of_length(d: int):
            at = np.flatnonzero(lengths == d)
            if d not in built and len(at):
                x = _matrix(vectors.take(pa.array(at)))
                unit = x / np.abs(x).max(axis=1, keepdims=True)
                norm = np.linalg.norm(unit, axis=1)
                built[d] = ids[at], unit, norm, Arrays(unit / norm[:, None], projections, seed)
            return built.get(d)

        def ask(query_ids: np.ndarray, queries: pa.Array):
            out, query_lengths = [], np.diff(queries.offsets.to_numpy())
            for d in np.unique(query_lengths).tolist():
                held = of_length(d)
                if held is None:
                    continue
                mine, unit, norm, arrays = held
                at = np.flatnonzero(query_lengths == d)
                q = _matrix(queries.take(pa.array(at)))
                unit_q = q / np.abs(q).max(axis=1, keepdims=True)
                norm_q = np.linalg.norm(unit_q, axis=1)
                place = np.minimum(np.searchsorted(mine, query_ids[at]), len(mine) - 1)
                own = np.where(mine[place] == query_ids[at], place, -1)
                for u, c in enumerate(arrays.collide(unit_q / norm_q[:, None], own, k, share, sigmas)):
                    score = np.einsum("ij,j->i", unit[c], unit_q[u]) / (norm[c] * norm_q[u])
                    top = np.lexsort((mine[c], -score))[:k]
                    out.append((np.full(len(top), query_ids[at][u]), mine[c][top], score[top]))
            return tuple(map(np.concatenate, zip(*out))) if out else None

        return ask

    found = search(good, F.col("asked"), index, k, "high", block, query_block)
    return found.select("query_id", "rank", F.col("id").alias(id_column), "score")

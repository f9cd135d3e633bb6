"""A stated query set against all rows, block by block: every query meets every block of rows once.

A block's rows travel once and its index is built once; the queries alone are copied, one copy a block, and stream past
the index in chunks, so that a task holds one block and one chunk whatever the number of queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Found = tuple[np.ndarray, np.ndarray, np.ndarray] | None
Ask = Callable[[np.ndarray, pa.Array], Found]


def _distinct(t: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Ids and payloads of rows sorted by id, the first of each id."""
    ids = t.column("id").to_numpy()
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    return ids[first], t.column("payload").combine_chunks().take(pa.array(first))


def search(rows: DataFrame, is_query: Column, index: Callable[[np.ndarray, pa.Array], Ask], k: int, nearest_first: str, block: int, query_block: int) -> DataFrame:
    """rows: id long, payload. `index` gets ids and payloads of a block's rows; what it returns gets those of a chunk of
    queries and returns (query id, row id, score) of the block's best. Blocks are dealt by a hash
    of the id, so their sizes are bounded whatever the payloads; of rows with one id the first by its payload's hash stays.
    Result: query_id, rank, id, score, the best k of all blocks; ties to the smaller id."""
    blocks = max(1, -(-rows.count() // block))
    mark = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).cast("int")
    data = rows.select(mark.alias("b"), F.lit(False).alias("query"), "id", "payload")
    asked = rows.where(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(True).alias("query"), "id", "payload")
    both = data.unionByName(asked).repartition(blocks, "b").sortWithinPartitions("b", "query", "id", F.xxhash64("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ask, held, queries = -1, None, [], []

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal ask, held, queries
            if queries and held:
                ask, held = index(*_distinct(pa.Table.from_batches(held))), []
            if queries and ask is not None:
                ids, payload = _distinct(pa.Table.from_batches(queries))
                for at in range(0, len(ids), query_block):
                    found = ask(ids[at : at + query_block], payload.slice(at, query_block))
                    if found is not None:
                        a, b, score = found
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(score, pa.float64())], ["query_id", "id", "score"])
            queries = []

        last = None  # the query that came last: rows with its id are the same query
        for batch in batches:
            b, query, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((b[1:] != b[:-1]) | (query[1:] != query[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)]):
                if hi == lo:
                    continue
                if b[lo] != now:
                    yield from answers()
                    now, ask, held, last = int(b[lo]), None, [], None
                if not query[lo]:
                    held.append(batch.slice(lo, hi - lo))
                    continue
                lo += int(np.searchsorted(ids[lo:hi], last, "right")) if last is not None else 0
                if lo < hi:
                    queries.append(batch.slice(lo, hi - lo))
                    last = ids[hi - 1]
                if sum(map(len, queries)) >= query_block:
                    yield from answers()
        yield from answers()

    found = both.mapInArrow(run, "query_id long, id long, score double")
    order = F.desc("score") if nearest_first == "high" else F.asc("score")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")

"""Packing token sequences into bins of a fixed size: minimum bin slack.

Tokenising: a task encodes whole texts with the given vocabulary and cuts only what is longer than a bin.
Packing: the pieces are counted by length (at most `size` counts, whatever the corpus). For each bin, the longest piece
left is fixed and a bitset dynamic programme over the lengths left finds the fullest feasible combination, which is then
removed; a combination is repeated while its lengths last, so there are few different ones. Pieces are numbered within
their length, and the plan of combinations tells each numbered piece its sequence and place by a join. Numbers come from
counts of each task's pieces by length and a running sum of those, so no group of equal lengths meets in one task.

Nulls and odd rows: null text is empty and is packed as its end token alone; repeated rows are packed each; null doc_ids
stay; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import Scratch, text_of


class Encoder:
    """ids of texts as the tokenizer file gives them. `ranks` is a file with the same vocabulary as byte ranks, whose
    encoder is several times as fast; texts it could split otherwise (characters beyond U+00FF, special tokens) go to
    the tokenizer itself."""

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if ranks and pattern:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def plain(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not any(t in text for t in self.special)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and self.plain(text):
            return np.array(self.fast(text), "<u4")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def tokenize(docs: DataFrame, files: tuple[str | None, ...], size: int = 2048, end: int = 0) -> DataFrame:
    """files: tokenizer file, then ranks file and split pattern or nothing. Pieces of whole texts: doc_id, piece, start, length, ids (binary, little-endian 32-bit), part, place (number of
    the piece among those of its length in its task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, count = Encoder(*files), TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in batches:
            doc, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encode(text), np.array(end, "<u4"))
                first = len(ids) % size or size
                start = 0
                for k, stop in enumerate(range(first, len(ids) + 1, size)):
                    n = stop - start
                    doc.append(i)
                    rows.append((k, start, n, ids[start:stop].tobytes(), part, count[n]))
                    count[n] += 1
                    start = stop
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
            columns = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["doc_id", "piece", "start", "length", "ids", "part", "place"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, part int, place long")


def fullest(room: int, counts: dict[int, int]) -> list[int]:
    """Lengths, each at most as often as it is there, with the largest sum that fits."""
    sums, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for n in sorted((n for n in counts if n <= room), reverse=True):
        left, k = min(counts[n], room // n), 1
        while left:
            k = min(k, left)
            steps.append((n, k, sums))
            sums |= sums << (n * k) & mask
            left -= k
            k *= 2
        if sums >> room & 1:
            break
    total, out = sums.bit_length() - 1, []
    for n, k, before in reversed(steps):
        if not before >> total & 1:
            out += [n] * k
            total -= n * k
    return out


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, lo, hi, copies, sequence, offset): of the pieces of that length numbered lo to hi, each run of
    `copies` goes to the next sequence, side by side from the offset."""
    left, used, rows, sequence = {n: c for n, c in counts.items() if c}, dict.fromkeys(counts, 0), [], 0
    while left:
        big = max(left)
        left[big] -= 1
        bin_ = [big, *fullest(size - big, {n: c for n, c in left.items() if c})]
        left[big] += 1
        need = {n: bin_.count(n) for n in bin_}
        times = min(left[n] // k for n, k in need.items())
        offset = 0
        for n, k in need.items():
            rows.append((n, used[n], used[n] + k * times, k, sequence, offset))
            used[n] += k * times
            left[n] -= k * times
            offset += n * k
            if not left[n]:
                del left[n]
        sequence += times
    return rows


def pack(pieces: DataFrame, scratch: Scratch, size: int = 2048, small: int = 500_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (as tokenize() gives them, kept in a table: their numbers must not change)."""
    spark = pieces.sparkSession
    by_part = scratch.save(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "parts")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    slots = spark.createDataFrame(plan(counts, size), "length long, lo long, hi long, copies long, base long, at long")
    before = by_part.select("length", "part", before.alias("before"))
    numbered = pieces.join(F.broadcast(before) if by_part.count() <= small else before, ["length", "part"])
    number = F.col("place") + F.col("before")
    met = numbered.join(F.broadcast(slots), "length").where((number >= F.col("lo")) & (number < F.col("hi")))  # a few rows for each of at most `size` lengths
    step = number - F.col("lo")
    return met.select(*pieces.columns, (F.col("base") + F.floor(step / F.col("copies"))).alias("sequence_id"), (F.col("at") + F.pmod(step, F.col("copies")) * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, files: tuple[str | None, ...], size: int = 2048) -> DataFrame:
    """Pieces with ids, sequence_id and offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.save(tokenize(docs, files, size), "pieces"), scratch, size).drop("part", "place")


def pack_digests(docs: DataFrame, files: tuple[str | None, ...], size: int = 2048) -> DataFrame:
    """As pack_documents(), with ids_crc32 in place of the ids, taken before anything is shuffled."""
    pieces = tokenize(docs, files, size).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.save(pieces, "pieces"), scratch, size).drop("part", "place")

"""Windows of a fixed number of symbols (bytes or words) that start at two places or more of a corpus.

Anchors: of the k-grams of a window the least by hash (leftmost of equal ones) is its anchor. It depends on the window's
content alone, so equal windows have equal anchors at equal distance, and all windows of a text that share an anchor
form one run: a segment. Segments meet by the anchor's hash. Equal segments are one class with a multiplicity; the
classes of an anchor go to one block, where a resolver finds the windows that they share. An anchor with more than
`hot` classes is dealt out by its windows' own hashes instead, so that no group grows with the corpus.

Texts are known by two hashes of their content, so null or repeated ids do no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Scratch, blobs, concat_ranges, heavy_keys, salted_join

_CHUNK, _BITS = 1 << 18, 24
_LOW = np.uint64((1 << _BITS) - 1)
_P = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class _Powers:
    def __init__(self) -> None:
        self.n = 0

    def get(self, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        if n > self.n:
            self.n = n = max(n, 2 * _CHUNK)
            raised = lambda p: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, p, np.uint64))))
            self.up, self.down = [raised(p) for p in _P], [raised(pow(p, -1, 1 << 64)) for p in _P]
        return self.up, self.down


_powers = _Powers()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Bytes:
    """Symbols are the bytes of a text."""

    def __init__(self) -> None:
        self.random = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def symbols(self, body: bytes) -> np.ndarray:
        return self.random[np.frombuffer(body, np.uint8)]

    def parts(self, body: bytes) -> bytes:
        return body

    def cut(self, parts: bytes, lo: int, hi: int) -> bytes:
        return parts[lo:hi]


class Words:
    """Symbols are the words of a text, by a 64-bit hash."""

    def __init__(self) -> None:
        self.seen: dict[bytes, int] = {}

    def symbols(self, body: bytes) -> np.ndarray:
        words, seen = body.split(), self.seen
        if len(seen) > 200_000:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))

    def parts(self, body: bytes) -> list[bytes]:
        return body.split()

    def cut(self, parts: list[bytes], lo: int, hi: int) -> bytes:
        return b" ".join(parts[lo:hi])


UNITS = {"bytes": Bytes, "words": Words}


def segments(pieces: list[np.ndarray], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of symbol arrays: piece, lo, hi (first and last window start), anchor hash, segment hash."""
    n = np.array([len(x) for x in pieces], np.int64)
    starts = np.cumsum(n) - n
    s = np.concatenate(pieces)
    width, m = length - gram + 1, len(s) - gram + 1
    up, down = _powers.get(len(s) + 1)
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(s * up[i][: len(s)]))) for i in (0, 1)]
    hashes = _mix((sums[0][gram:] - sums[0][:-gram]) * down[0][:m])
    key = (hashes & ~_LOW) | np.arange(m, dtype=np.uint64)
    rows = -(-m // width) + 1
    grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:m] = key
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = np.maximum(n - length + 1, 0)
    p = concat_ranges(starts, windows)
    a = (np.minimum(behind[p], ahead[p + width - 1]) & _LOW).astype(np.int64)
    piece = np.repeat(np.arange(len(pieces)), windows)
    first = np.ones(len(p), bool)
    first[1:] = (a[1:] != a[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(first)
    last = np.append(first[1:], len(p)) - 1
    lo, hi, a, piece = p[first], p[last], a[first], piece[first]
    whole = _mix((sums[1][hi + length] - sums[1][lo]) * down[1][lo] + (a - lo).astype(np.uint64) * np.uint64(_P[0]) + (hi - lo).astype(np.uint64))
    return piece, lo - starts[piece], hi - starts[piece], hashes[a], whole


def _anchors(unit: str, length: int, gram: int):
    """Segments of texts (k1, k2, body), about a megabyte of symbols at a time; a text that a batch holds n times is read
    once and its segments count n times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = UNITS[unit]()
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            order = np.lexsort((k2, k1))
            new = np.ones(len(order), bool)
            new[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
            copies = np.diff(np.append(np.flatnonzero(new), len(order)))
            texts = order[new]
            doc, offset, pieces, size = [], [], [], 0

            def cut() -> pa.RecordBatch:
                piece, lo, hi, h, seg = segments(pieces, length, gram)
                at, shift = np.array(doc)[piece], np.array(offset)[piece]
                columns = (k1[texts[at]], k2[texts[at]], (lo + shift).astype(np.int32), (hi + shift).astype(np.int32), h.view(np.int64), seg.view(np.int64), copies[at])
                doc.clear(), offset.clear(), pieces.clear()
                return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k1", "k2", "lo", "hi", "h", "seg", "n"])

            for i, row in enumerate(texts.tolist()):
                s = kind.symbols(batch.column(2)[row].as_py() or b"")
                for at in range(0, max(len(s) - length + 1, 0), _CHUNK):
                    doc.append(i)
                    offset.append(at)
                    pieces.append(s[at : at + _CHUNK + length - 1])
                    size += len(pieces[-1])
                    if size >= _CHUNK:
                        yield cut()
                        size = 0
            if pieces:
                yield cut()

    return run


_CUT = "h long, seg long, n long, off int, wa long, wb long, body binary"


def _cut(unit: str, length: int):
    """Cuts the wanted segments out of texts; of a hot anchor's segment, a row for each window with two hashes of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, last = UNITS[unit](), None
        for batch in batches:
            k1, k2, bodies, want = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)
            rows: list[tuple] = []
            size = 0
            for i, key in enumerate(zip(k1, k2)):
                if key == last:  # a copy of the text before
                    continue
                last, parts = key, kind.parts(bodies[i].as_py() or b"")
                for x in want[i].as_py():
                    if not x["hot"]:
                        rows.append((x["h"], x["seg"], x["n"], 0, 0, 0, kind.cut(parts, x["lo"], x["hi"] + length)))
                        size += len(rows[-1][-1])
                    else:
                        for p in range(x["lo"], x["hi"] + 1):
                            d = xxhash.xxh3_128_digest(kind.cut(parts, p, p + length))
                            a, b = (int.from_bytes(d[j : j + 8], "little", signed=True) for j in (0, 8))
                            rows.append((x["h"], x["seg"], x["n"], p - x["lo"], a, b, None))
                    if len(rows) > 20_000 or size > _BLOCK:
                        yield _batch(rows)
                        rows, size = [], 0
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["h", "seg", "n", "off", "wa", "wb", "body"])

    return run


#: A resolver gets bodies and how many places each stands at; it returns (body, first window, end) arrays of windows, counted in the body, that start at two places or more.
Resolver = Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _resolve(resolver: Resolver, length: int, block: int):
    """Classes sorted by anchor -> their repeated spans (h, seg, lo, hi). Whole anchors make up blocks of about `block` bytes."""

    def work(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        h, seg, n = (t.column(c).to_numpy() for c in ("h", "seg", "n"))
        order = np.lexsort((seg, h))
        keep = np.ones(len(order), bool)
        keep[1:] = (h[order][1:] != h[order][:-1]) | (seg[order][1:] != seg[order][:-1])
        pick = order[keep]
        bodies = blobs(t.column("body").take(pa.array(pick)).combine_chunks())
        at, lo, hi = resolver(bodies, n[pick])
        return pa.RecordBatch.from_arrays([pa.array(h[pick][at]), pa.array(seg[pick][at]), pa.array(lo.astype(np.int32)), pa.array((hi - 1 + length).astype(np.int32))], ["h", "seg", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            if not t.num_rows:
                continue
            h, sizes = t.column("h").to_numpy(), pc.binary_length(t.column("body")).to_numpy().astype(np.int64)
            ends = np.flatnonzero(h[1:] != h[:-1]) + 1
            full = np.cumsum(sizes)[ends - 1] // block
            start = 0
            for end in ends[np.flatnonzero(np.diff(np.concatenate(([0], full))))].tolist():
                yield work(t.slice(start, end - start))
                start = end
            held = t.slice(start).combine_chunks()
        if held is not None and held.num_rows:
            yield work(held)

    return run


_BLOCK = 1 << 20


def repeated(docs: DataFrame, heavy: DataFrame, scratch: Scratch, unit: str, length: int, gram: int, resolver: Resolver, hot: int = 2048, block: int = _BLOCK) -> DataFrame:
    """docs: k1, k2, body, mark -> k1, k2, spans (lo, end) whose symbols are covered by a repeated window, several rows a text. heavy: see heavy_keys()."""
    # read twice from the texts: as a table the segments would take as much disk as the texts themselves
    rows = docs.select("k1", "k2", "body").mapInArrow(_anchors(unit, length, gram), "k1 long, k2 long, lo int, hi int, h long, seg long, n long")
    classes = rows.groupBy("h", "seg").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("k1", "k2", "lo", "hi")))
    groups = classes.groupBy("h").agg(F.count("*").alias("classes"), F.sum("n").alias("total")).where("total > 1").drop("total")
    met = scratch.save(classes.join(groups, "h"), "classes")
    wanted = met.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi", "h", "seg", "n", (F.col("classes") > hot).alias("hot"))).alias("want"))
    parts = scratch.save(salted_join(docs, wanted, ["k1", "k2"], heavy, F.col("mark")).select("k1", "k2", "body", "want").mapInArrow(_cut(unit, length), _CUT), "segments")
    found = parts.where("body is not null").repartition("h").sortWithinPartitions("h").mapInArrow(_resolve(resolver, length, block), "h long, seg long, lo int, hi int")
    window = parts.where("body is null").dropDuplicates(["h", "seg", "off"])
    twice = window.groupBy("wa", "wb").agg(F.sum("n").alias("total")).where("total > 1")
    dealt = window.join(twice, ["wa", "wb"]).select("h", "seg", F.col("off").alias("lo"), (F.col("off") + length).alias("hi"))
    spans = found.unionByName(dealt).groupBy("h", "seg").agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))
    common = heavy_keys(met.select("h", "seg", "n"), ["h", "seg"])
    members = salted_join(rows.select("k1", "k2", "lo", "h", "seg"), spans, ["h", "seg"], common, F.xxhash64("k1", "lo"))
    moved = F.transform("parts", lambda x: F.struct((F.col("lo") + x["lo"]).alias("lo"), (F.col("lo") + x["hi"]).alias("hi")))
    return members.select("k1", "k2", moved.alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame, heavy: DataFrame) -> DataFrame:
    """docs (k1, k2, mark, ...) with `spans`, an array of struct lo, hi; null if a text has none."""
    lists = spans.groupBy("k1", "k2").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    return salted_join(docs, lists, ["k1", "k2"], heavy, F.col("mark"), "left")


def copied(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The texts (k1, k2) that stand in most rows of docs, see heavy_keys()."""
    return scratch.save(heavy_keys(docs.groupBy("k1", "k2").agg(F.count("*").alias("n")), ["k1", "k2"]), "heavy")


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """columns, k1, k2, body, mark (a hash of the columns) of documents; null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashes = (F.xxhash64(text).alias("k1"), F.crc32(text.cast("binary")).alias("k2"))
    return docs.select(*columns, *hashes, text.cast("binary").alias("body"), F.xxhash64(*columns).alias("mark"))


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of integers, in order by at least the first `depth` symbols: prefix doubling, each time only over the
    suffixes that still tie with another."""
    n = len(s)
    bits = max(int(s.max()).bit_length(), 1)
    width = max(1, 62 // bits)
    padded = np.concatenate((s.astype(np.int64), np.zeros(width, np.int64)))
    key = np.zeros(n, np.int64)
    for j in range(width):
        key = (key << bits) | padded[j : j + n]
    del padded
    order = np.argsort(key).astype(np.int32)
    slots, ties = np.arange(n, dtype=np.int32), key[order]
    rank = np.zeros(n + 1, np.int32)  # how many suffixes are smaller, from 1; 0 beyond the end
    while True:
        new = np.ones(len(ties), bool)
        new[1:] = ties[1:] != ties[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(ties)))
        at = order[slots]
        rank[at] = np.repeat(slots[first], size) + 1
        open_ = np.repeat(size > 1, size)
        slots, at = slots[open_], at[open_]
        if width >= depth or not len(slots):
            return order
        key = rank[at].astype(np.int64) * (n + 1) + rank[np.minimum(at.astype(np.int64) + width, n)]
        by = np.argsort(key)
        order[slots], ties = at[by], key[by]
        width *= 2

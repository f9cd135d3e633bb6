"""Language-model scores from a probabilistic suffix tree over words.

Learning: words are counted, then, one length after the other, the next words of every context that is frequent enough.
A context stays in the tree if its next-word distribution diverges from that of its longest suffix (a likelihood-ratio
test against the number of its next words). Distributions are discounted and the rest goes to the suffix's distribution,
down to add-one counts of single words, so every state's distribution sums to one.
Scoring: each token by the state of the longest context that stayed.

A context needs `context_least` occurrences and a next word `least` after it, the same numbers at any size of the corpus;
beyond that only the test decides, so contexts and next words grow with the corpus. They are Spark tables, keyed by
64-bit hashes of their words: what a run of words adds to a score is joined to the texts that hold it. Of fixed size are
only the most frequent words and runs, which travel with the scorer and need no join, and bitmaps that let through every
key of a table and few others. What is counted or joined by the token goes through the shuffle as arrays, a row for each
range of keys that a task has met, and is added up by range; the number of ranges grows with the corpus.

Nulls and odd rows: null text is empty and is scored as its end token; null doc_id counts as the empty text in the
training rule; repeated rows count and are scored each; no training rows: every token is unknown; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Scratch, blobs, text_of

_CHUNK = 1 << 19
_ROWS = 1000
_LONG = pa.int64()
_END = b" "  # no word is equal to it


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fewer rows at a time, so that a worker holds less beside its arrays."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _chunks(bodies: list[bytes]) -> Iterator[list[list[bytes]]]:
    """Texts as lower-case words (A-Z only), some megabytes at a time."""
    held, size = [], 0
    for body in bodies:
        held.append(body.lower().split())
        size += len(body)
        if size > _CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(seen.values(), _LONG)], ["word", "n"])

    for batch in _slices(batches):
        for words in _chunks(blobs(batch.column(0))):
            for x in words:
                seen.update(x)
        if len(seen) > 500_000:
            yield out()
            seen.clear()
    if seen:
        yield out()


class Words:
    """Words of the head by rank (0: the end; then by count; from `other` on or below 0: not in the head), add-one counts."""

    def __init__(self, words: list[str], counts: np.ndarray, ends: int, total: int, distinct: int):
        self.words, self.total, self.ends, self.other = words, total, ends, len(words) + 1
        self.denominator = float(total + distinct + 1)
        self.log0 = np.log10((np.concatenate(([ends], counts)).astype(np.float64) + 1) / self.denominator)


class _Shared:
    """A broadcast with a name, so that a worker builds its word index once."""

    def __init__(self, spark, value, number: int):
        self.id, self._b = number, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self._b.value


class Model(NamedTuple):
    words: Words  #: the words of the head
    counts: DataFrame  #: all training words (word, n)
    deltas: DataFrame  #: what a run of words adds to the score of a text it stands in (key, w: its count, delta), a row as entry and one as context
    runs: np.ndarray  #: bitmap of all frequent runs
    longest: int  #: words in the longest run
    tables: list[str]  #: scratch tables that deltas reads


def _floor(table: DataFrame, n: str, room: int) -> tuple[int, int]:
    """The least count such that at most `room` rows have it or more, by eighths of powers of two, and the rows below it."""
    octaves = table.groupBy(F.floor(F.log2(n) * 8).alias("octave")).agg(F.count("*").alias("k"), F.min(n).alias("low")).orderBy(F.desc("octave")).collect()  # at most 8 * 63 rows
    fit = int(np.searchsorted(np.cumsum([r.k for r in octaves]), room, side="right")) if octaves else 0
    return octaves[fit - 1].low if fit else 1 << 62, sum(r.k for r in octaves[fit:])


def _words(docs: DataFrame, scratch: Scratch, head: int) -> tuple[Words, DataFrame]:
    """The words of the head, and all words with their counts (word, n)."""
    bodies = docs.select(text_of().cast("binary").alias("body"))
    counts = scratch.save(bodies.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    ends = docs.count()
    floor, _ = _floor(counts, "n", head)
    frequent = counts.where(F.col("n") >= floor).orderBy(F.desc("n"), "word").toArrow()  # at most `head` rows
    said = counts.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("s")).first()
    return Words(frequent["word"].to_pylist(), frequent["n"].to_numpy(), ends, said.s + ends, said.k + (ends > 0)), counts


_BITS = 1 << 26
_BATCH = 1 << 18
_RANGE = 1 << 19  #: keys in a range, about
_PRIMES = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of two columns of longs."""
    p1, p2, p3, p4, p5 = _PRIMES
    h = np.full(len(a), 42, np.uint64)
    for x in (a, b):
        h = (h + p5 + np.uint64(8)) ^ (_turn(x.view(np.uint64) * p2, 31) * p1)
        h = _turn(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


class _Ids(dict):
    """Word to id: the end 0, words of the head by rank, others by hash."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 42)
        h -= (h >> 63) << 64
        if len(self) < 300_000:
            self[word] = h
        return h


_IDS: dict[int, _Ids] = {}


def _ids(shared: _Shared, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    if shared.id not in _IDS:
        _IDS.clear()
        _IDS[shared.id] = _Ids({w.encode(): i for i, w in enumerate(shared.value[0].words, 1)} | {_END: 0})
    n = np.array([len(x) + 1 for x in words])
    flat = itertools.chain.from_iterable(itertools.chain(x, (_END,)) for x in words)
    return np.fromiter(map(_IDS[shared.id].__getitem__, flat), np.int64, int(n.sum())), n


def _places(n: np.ndarray) -> np.ndarray:
    """Of texts of n tokens one after the other, each token's place in its text."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _longer(key: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """From the keys of the words that end at each token, those of one word more; right at the places `at`, or at all."""
    if at is None:
        return _pair(np.concatenate((key[:1], key[:-1])), key)
    out = np.zeros_like(key)
    out[at] = _pair(key[at - 1], key[at])
    return out


def _has(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """False where a key is surely not in the set; of other keys a few are let through, and go with the next join."""
    at = key & (_BITS - 1)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


def _bitmap(keys: DataFrame) -> np.ndarray:
    """The set of keys as bits of fixed number, whatever the number of keys."""
    at = F.col("key").bitwiseAND(F.lit(_BITS - 1))
    bit = F.expr("shiftleft(1L, cast(key & 63 as int))")
    found = keys.groupBy(F.shiftright(at, 6).alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()  # at most _BITS / 64 rows
    out = np.zeros(_BITS >> 6, np.uint64)
    out[found["slot"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _range_bits(keys: int) -> int:
    """Leading bits of a key that tell its range."""
    return max(3, (keys // _RANGE).bit_length())


def _ranges(key: np.ndarray, bits: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Ranges that sorted unsigned keys fall in, and where each starts and ends."""
    at = (key >> np.uint64(64 - bits)).astype(np.int32)
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
    return at[starts], list(zip(starts.tolist(), [*starts[1:].tolist(), len(at)]))


def _packed(x: np.ndarray) -> bytes:
    """Numbers as bytes, all first bytes before all second ones, which compresses better."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unpacked(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    size = np.dtype(kind).itemsize
    return [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(size, -1).T).view(kind).ravel() for x in column.to_pylist()]


def _summed(key: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, unsigned, the place of the first of each, and their sums of x."""
    key = key.view(np.uint64)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], order[first], np.add.reduceat(x[order], first) if len(first) else x[:0]


def _followed(words: _Shared, sets: _Shared, levels: list[int], bits: int):
    """Counts of (d, context of d words, the d words that end one token later) for each d of the levels, as arrays by range. The
    sets know the frequent runs of the first level; a longer run is a candidate if all of its runs of that length are frequent."""

    def out(held: list) -> pa.RecordBatch:
        rows = []
        for d, found in zip(levels, held):
            if found:
                before, now = (np.concatenate(x) for x in zip(*found))
                found.clear()
                key, first, n = _summed(_pair(before, now), np.ones(len(now), np.int32))
                before, now, n = before[first], now[first], n.astype(np.int32)
                at, cuts = _ranges(key, bits)
                rows += [(d, r, *(_packed(x[lo:hi]) for x in (before, now, n))) for r, (lo, hi) in zip(at.tolist(), cuts)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), *[pa.binary()] * 3))], ["d", "range", "s", "low", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, lows = sets.value
        held, size, first = [[] for _ in levels], 0, levels[0]
        for batch in _slices(batches):
            for part in _chunks(blobs(batch.column(0))):
                key, n = _ids(words, part)
                place = _places(n)
                for _ in range(first - 1):
                    key = _longer(key)
                context = (place >= first - 1) & _has(contexts, key)
                good = (place >= first - 1) & _has(lows, key)
                for d, found in zip(levels, held):
                    step = d - first + 1
                    good[step:] &= context[:-step] if step < len(context) else False
                    good[:step] = False
                    good &= place >= d
                    if d > first:
                        need = good.copy()
                        for k in range(1, levels[-1] - d + 2):  # a longer run needs the keys before it too
                            need[:-k] |= good[k:]
                        key = _longer(key, np.flatnonzero(need))
                    at = np.flatnonzero(good)
                    if len(at):
                        found.append((key[at - 1], key[at]))
                        size += len(at)
                if size > _BATCH:
                    yield out(held)
                    held, size = [[] for _ in levels], 0
        if size:
            yield out(held)

    return run


def _counted(least: int):
    """The runs of one range that were counted `least` times, of all tasks together."""

    def run(table: pa.Table) -> pa.Table:
        _IDS.clear()  # of a worker that read texts before
        s, low, n = (np.concatenate(_unpacked(table[c], k)) for c, k in (("s", np.int64), ("low", np.int64), ("n", np.int32)))
        key, first, n = _summed(_pair(s, low), n.astype(np.int64))
        often = n >= least
        first = first[often]
        columns = (np.full(len(first), table["d"][0].as_py(), np.int32), key[often].view(np.int64), s[first], low[first], n[often])
        return pa.table([pa.array(x) for x in columns], ["d", "key", "s", "low", "n"])

    return run


def learn(docs: DataFrame, scratch: Scratch, depth: int = 4, head: int = 200_000, context_least: int = 10, least: int = 2, discount: float = 0.5, strictness: float = 3.0) -> Model:
    """The tree as tables. A run is an entry below the context before its last word and may be a context itself. As entry it brings log10 of its
    probability over what its context's rest gives to it, as context log10 of its rest, which every next word takes.
    """
    spark = docs.sparkSession
    bodies = docs.select(text_of().cast("binary").alias("body"))
    tree, counts = _words(docs, scratch, head)
    shared = _Shared(spark, (tree,), hash((scratch.base, "ids")))
    ranks = spark.createDataFrame(pa.table({"word": pa.array(tree.words, pa.string()), "rank": pa.array(range(1, tree.other), _LONG)}))
    ids = counts.join(F.broadcast(ranks), "word", "left").select(F.coalesce("rank", F.xxhash64("word")).alias("key"), "n")
    ids = scratch.save(ids.unionByName(spark.range(1).select(F.lit(0).cast("long").alias("key"), F.lit(tree.ends).cast("long").alias("n"))), "ids")
    lower = ids.where(F.col("n") >= least).select("key", "n", ((F.col("n") + 1) / F.lit(tree.denominator)).alias("p"))
    parts, runs, bits = [], [lower.select("key")], _range_bits(tree.total)
    for levels in [[d] for d in range(1, min(depth, 2) + 1)] + [list(range(3, depth + 1))] * (depth > 2):
        frequent = lambda table: table.where((F.col("n") >= context_least) & (F.col("key") != 0)).select("key", F.col("n").alias("count"))
        sets = _Shared(spark, (_bitmap(frequent(lower)), _bitmap(lower)), 0)
        counted = bodies.mapInArrow(_followed(shared, sets, levels, bits), "d int, range int, s binary, low binary, n binary").groupBy("d", "range").applyInArrow(_counted(least), "d int, key long, s long, low long, n long")
        counted = scratch.save(counted, f"counted{levels[0]}")
        for d in levels:
            contexts = frequent(lower)
            found = counted.where(F.col("d") == d).join(lower.select(F.col("key").alias("low"), F.col("p").alias("below")), "low")
            rows = scratch.save(found.select("key", "s", "n", "below"), f"rows{d}")
            left = F.greatest(F.col("count") - F.col("seen"), F.lit(0))
            gain = F.col("gain") - F.col("seen") * F.log("count") + F.when(left > 0, left * F.log(left / F.col("count") / F.greatest(1 - F.col("seen_p"), F.lit(1e-12)))).otherwise(0.0)
            taken = F.greatest(F.col("n") - F.lit(discount), F.lit(0.0))
            sums = rows.groupBy("s").agg(F.sum(taken).alias("taken"), F.sum("n").alias("seen"), F.sum("below").alias("seen_p"), F.count("*").alias("kinds"), F.sum(F.col("n") * F.log(F.col("n") / F.col("below"))).alias("gain"))
            states = sums.join(contexts.withColumnRenamed("key", "s"), "s").select("s", "count", (1 - F.col("taken") / F.col("count")).alias("rest"), (2 * gain > F.col("kinds") + strictness * F.sqrt(2 * F.col("kinds"))).alias("kept"))
            states = scratch.save(states, f"states{d}")
            given = F.col("rest") * F.col("below")
            p = F.when(F.col("kept"), taken / F.col("count") + given).otherwise(F.col("below"))
            lower = scratch.save(rows.join(states, "s").select("key", "n", p.alias("p"), F.when(F.col("kept"), F.log10(p / given)).otherwise(0.0).alias("delta")), f"entries{d}")
            scratch.drop(f"rows{d}")
            runs.append(lower.select("key"))
            parts += [states.where("kept").select(F.col("s").alias("key"), F.col("count").alias("w"), F.log10("rest").alias("delta")), lower.select("key", F.col("n").alias("w"), "delta").where("delta <> 0")]
        scratch.drop(f"counted{levels[0]}")
    deltas = functools.reduce(DataFrame.unionByName, parts, spark.range(0).select(F.col("id").alias("key"), F.col("id").alias("w"), F.col("id").cast("double").alias("delta")))
    known = _bitmap(functools.reduce(DataFrame.unionByName, runs))
    return Model(tree, counts, deltas, known, depth + 1, ["ids", *(f"{x}{d}" for x in ("states", "entries") for d in range(1, depth + 1))])


_SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<string>"
_BLOCK = pa.schema([("rid", _LONG), ("range", pa.int32()), ("keys", pa.binary()), ("texts", pa.binary())])


def _score(shared: _Shared, longest: int, range_bits: int, part: int):
    """Rows of texts, and of each range the keys that are still to be joined, with the number of their text from rid on."""
    names = [x.split()[0] for x in _SCORED.split(", ")]

    def blocks(rid: int, loose: list) -> pa.RecordBatch:
        key, owner = (np.concatenate(x) for x in zip(*loose))
        order = np.argsort(key)
        key, owner = key[order], owner[order].astype(np.int32)
        at, cuts = _ranges(key, range_bits)
        held = pa.table([pa.array(np.full(len(at), rid)), pa.array(at), *(pa.array([_packed(x[lo:hi]) for lo, hi in cuts], pa.binary()) for x in (key, owner))], schema=_BLOCK)
        empty = [pa.nulls(len(at), t) for t in _KINDS[1:]]
        return pa.RecordBatch.from_arrays([held["rid"].combine_chunks(), *empty, *(held[c].combine_chunks() for c in _BLOCK.names[1:])], names + _BLOCK.names[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, bits, single, often, delta, joined = shared.value
        rid = (TaskContext.get().partitionId() << 36) + (part << 32)
        rows = 0
        for batch in _slices(batches):
            base, score, size, known, tails, loose, done, held = [], [], [], [], [], [], 0, 0
            for words in _chunks(blobs(batch.column(2))):
                ids, n = _ids(shared, words)
                rare = (ids < 0) | (ids >= tree.other)
                log = np.where(rare, 0.0, tree.log0[np.where(rare, 0, ids)])
                starts = np.cumsum(n) - n
                text = np.repeat(np.arange(len(n)), n)
                more, place, key = np.bincount(text, np.where(rare, 0.0, single[np.where(rare, 0, ids)]), len(n)), _places(n), ids
                now = _has(bits, key)  # frequent, as far as its own shorter runs tell
                found = [(key[now & rare].view(np.uint64), text[now & rare])]
                for d in range(2, longest + 1):
                    at = np.flatnonzero(now[1:] & now[:-1] & (place[1:] >= d - 1)) + 1
                    key = _longer(key, at)
                    at = at[_has(bits, key[at])]
                    now = np.zeros(len(key), bool)
                    now[at] = True
                    found.append((key[at].view(np.uint64), text[at]))
                key, owner = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(key)  # in order, the search below stays in few places
                key, owner = key[order], owner[order]
                hit = np.zeros(len(key), bool)
                if len(often):
                    near = np.minimum(np.searchsorted(often, key), len(often) - 1)
                    hit = often[near] == key
                    more += np.bincount(owner[hit], delta[near[hit]], len(n))
                if joined is not None:
                    open_ = ~hit & _has(joined, key.view(np.int64))
                    loose.append((key[open_], owner[open_] + done))
                    held += len(loose[-1][0])
                done += len(n)
                if held > _BATCH:
                    yield blocks(rid + rows, loose)
                    loose, held = [], 0
                base.append(np.add.reduceat(log, starts))
                score.append(base[-1] + more)
                size.append(n)
                known.append(np.add.reduceat((~rare).astype(np.int64), starts) - (0 if tree.ends else 1))
                where = np.flatnonzero(rare)
                cuts = np.searchsorted(where, starts).tolist() + [len(where)]
                offsets = where - np.repeat(starts, np.diff(cuts))
                for i, x in enumerate(words):
                    tails.append([x[j] for j in offsets[cuts[i] : cuts[i + 1]].tolist()])
            if not size:
                continue
            if held:
                yield blocks(rid + rows, loose)
            m = batch.num_rows
            own = np.arange(rows, rows + m) + rid
            columns = [pa.array(own), batch.column(0), batch.column(1), *(pa.array(np.concatenate(x)) for x in (size, known, base, score)), pa.array(tails, pa.list_(pa.binary())).cast(pa.list_(pa.string()))]
            columns += [pa.array((own % (1 << range_bits)).astype(np.int32)), *[pa.nulls(m, pa.binary())] * 2]
            rows += m
            yield pa.RecordBatch.from_arrays(columns, names + _BLOCK.names[1:])

    return run


_KINDS = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string())]


_DELTAS = "range int, keys binary, deltas binary"


def _dealt(bits: int):
    """Rows (key, delta) as arrays by range."""

    def out(held: pa.Table) -> pa.RecordBatch:
        key, _, delta = _summed(held["key"].to_numpy(), held["delta"].to_numpy())
        at, cuts = _ranges(key, bits)
        return pa.RecordBatch.from_arrays([pa.array(at), *(pa.array([_packed(x[lo:hi]) for lo, hi in cuts], pa.binary()) for x in (key, delta))], ["range", "keys", "deltas"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size > _BATCH:
                yield out(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield out(pa.Table.from_batches(held))

    return run


def _sorted(deltas: pa.Table) -> pa.Table:
    """The deltas of one range, of all tasks together, by key."""
    key, _, delta = _summed(*(np.concatenate(_unpacked(deltas[c], k)) for c, k in (("keys", np.uint64), ("deltas", np.float64))))
    return pa.table([deltas["range"][:1], pa.array([_packed(key)], pa.binary()), pa.array([_packed(delta)], pa.binary())], ["range", "keys", "deltas"])


def _added(rows: pa.Table, deltas: pa.Table) -> pa.Table:
    """Of one range: rows of texts as they are, and what its deltas add to each text that holds a key of them (rid, more)."""
    _IDS.clear()
    names = [x.split()[0] for x in _SCORED.split(", ")]
    texts = rows.filter(rows["keys"].is_null()).select(names)
    blocks = rows.filter(rows["keys"].is_valid())
    rids, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
    if len(deltas):
        (key,), (delta,) = _unpacked(deltas["keys"], np.uint64), _unpacked(deltas["deltas"], np.float64)
        for rid, wanted, owner in zip(blocks["rid"].to_pylist(), _unpacked(blocks["keys"], np.uint64), _unpacked(blocks["texts"], np.int32)):
            near = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            hit = key[near] == wanted
            more, held = np.bincount(owner[hit], delta[near[hit]]), np.bincount(owner[hit])
            rids.append(np.flatnonzero(held) + rid)
            sums.append(more[held > 0])
    rid, more = np.concatenate(rids), np.concatenate(sums)
    parts = [pa.array(rid), *(pa.nulls(len(rid), t) for t in _KINDS[1:]), pa.array(more)]
    texts = texts.cast(pa.schema(list(zip(names, _KINDS)))).append_column("more", pa.nulls(len(texts), pa.float64()))
    return pa.concat_tables([texts, pa.table(parts, texts.column_names)])


def score_documents(docs: DataFrame, held_out: Column, often: int = 1 << 21, rounds: int = 2, **settings) -> DataFrame:
    """Learns from the rows where held_out is false and scores all: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (single words), score (the tree), both log10 of the whole text. The `often` most frequent runs of words
    travel with the scorer, all others are joined. The texts are scored in `rounds`, so that the shuffle holds the runs of one
    part of them at a time."""
    scratch = Scratch(docs.sparkSession, "suffix-tree", tidy=True)
    tree, counts, deltas, bits, longest, tables = learn(docs.where(~held_out), scratch, **settings)
    floor, open_ = _floor(deltas, "w", often)
    head = F.col("key").between(0, tree.other - 1)
    near = (F.col("w") >= floor) | head
    travels = deltas.where(near).select("key", "delta").toArrow()  # at most `often` rows and the head
    key, _, delta = _summed(travels["key"].to_numpy(), travels["delta"].to_numpy())
    single = np.zeros(tree.other)
    low = int(np.searchsorted(key, np.uint64(tree.other)))
    single[key[:low].astype(np.int64)] = delta[:low]
    rest = deltas.where(~near).select("key", "delta")
    joined, range_bits = _bitmap(rest) if open_ else None, _range_bits(8 * open_)
    shared = _Shared(docs.sparkSession, (tree, bits, single, key[low:], delta[low:], joined), hash((scratch.base, "score")))
    ranged = scratch.save(rest.mapInArrow(_dealt(range_bits), _DELTAS).groupBy("range").applyInArrow(_sorted, _DELTAS), "ranges")
    scratch.drop(*tables)
    rows = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), text_of().cast("binary").alias("body"))
    pieces = []
    for part in range(rounds):
        own = rows.where(F.pmod(F.xxhash64("doc_id", "body"), F.lit(rounds)) == part)
        scored = own.mapInArrow(_score(shared, longest, range_bits, part), _SCORED + ", range int, keys binary, texts binary")
        pieces.append(scratch.save(scored.groupBy("range").cogroup(ranged.groupBy("range")).applyInArrow(_added, _SCORED + ", more double"), f"scored{part}"))
    pieces = functools.reduce(DataFrame.unionByName, pieces)
    scratch.drop("ranges")
    scored = pieces.where("n_tokens is not null").drop("more")
    tails = scored.select("rid", F.explode("tail").alias("word"))
    rare = tails.join(counts, "word", "left").groupBy("rid").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0))).alias("logs"), F.count("*").alias("tokens"), F.count("n").alias("found"))
    runs = pieces.where("n_tokens is null").groupBy("rid").agg(F.sum("more").alias("more"))
    extra = F.coalesce(F.col("logs") - F.col("tokens") * F.log10(F.lit(float(tree.denominator))), F.lit(0.0))
    return scored.drop("tail").join(rare, "rid", "left").join(runs, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(tree.total).cast("long").alias("train_tokens"),
        (F.col("base") + extra).alias("base_score"),
        (F.col("score") + extra + F.coalesce("more", F.lit(0.0))).alias("score"),
    )

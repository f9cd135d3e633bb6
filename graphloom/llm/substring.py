"""Exact removal of repeated word passages: words covered by a window of `length` words that also starts elsewhere.

Relative Lempel-Ziv parsing: the segments of an anchor (see repeats.py) form a reference block with a suffix order as its
index. Each segment is factored greedily against every other place of the block: from a position the longest match is
the next factor. Factors of `length` words or more are duplicate spans. A window that no factor holds whole crosses the
end of a factor; those windows are looked up one by one in the index. Words are compared as words, hashes only bring
together what may be equal.

Nulls and odd rows: null text has no words; shorter texts keep everything; repeated rows lose what they share; null or
equal doc_ids do not matter; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Scratch, blobs, concat_ranges, merge_spans
from graphloom.llm.repeats import copied, keyed, repeated, suffix_order, with_spans


def match_lengths(text: np.ndarray, most: int) -> np.ndarray:
    """At each position the longest match, up to `most` symbols, with any other position; 0 matches nothing."""
    n = len(text)
    sa = suffix_order(text, most)
    padded = np.concatenate((text, np.zeros(most, text.dtype)))
    common = np.zeros(n, np.int64)
    alive = np.arange(1, n)
    for j in range(most):
        x = padded[sa[alive] + j]
        alive = alive[(x == padded[sa[alive - 1] + j]) & (x != 0)]
        if not len(alive):
            break
        common[alive] += 1
    longest = np.empty(n, np.int64)
    longest[sa] = np.maximum(common, np.append(common[1:], 0))
    return longest


def parse(match: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Greedy factors of the segments [start, end); starts of the windows that are repeated."""
    p, found = starts.copy(), []
    active = np.flatnonzero(p + length <= ends)
    while len(active):
        at = p[active]
        step = np.maximum(match[at], 1)
        long = match[at] >= length
        found.append(concat_ranges(at[long], step[long] - length + 1))
        edge = concat_ranges(np.maximum(at, at + step - length + 1)[long], np.minimum(step, length - 1)[long])
        found.append(edge[match[edge] >= length])
        alone = at[~long]
        inside = concat_ranges(alone, step[~long])
        found.append(inside[match[inside] >= length])
        p[active] = at + step
        active = active[p[active] + length <= ends[active]]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def resolver(length: int, most: int = 512):
    def resolve(bodies: list[bytes], places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = [x.split(b" ") for x in bodies]
        ids: dict[bytes, int] = {}
        sizes = np.array([len(x) for x in words], np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        text = np.zeros(int((sizes + 1).sum()), np.int64)
        for s, x in zip(starts.tolist(), words):
            text[s : s + len(x)] = [ids.setdefault(w, len(ids) + 1) for w in x]
        match = match_lengths(text, min(most, int(sizes.max())))
        again = np.flatnonzero(places > 1)  # the other place of such a body matches to its end
        copied = concat_ranges(starts[again], sizes[again])
        match[copied] = np.maximum(match[copied], np.repeat((starts + sizes)[again], sizes[again]) - copied)
        p = parse(match, starts, starts + sizes, length)
        at = np.searchsorted(starts, p, side="right") - 1
        inside = p - starts[at] <= sizes[at] - length
        p, at = p[inside], at[inside]
        return at, p - starts[at], p - starts[at] + 1

    return resolve


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, out = batch.column(2), []
        flat, offsets = spans.flatten(), spans.offsets.to_numpy()
        los, his = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        offsets = offsets - offsets[0]
        for i, body in enumerate(blobs(batch.column(1))):
            words = body.split()
            lo, hi = merge_spans(los[offsets[i] : offsets[i + 1]], his[offsets[i] : offsets[i + 1]])
            cuts = [0, *np.column_stack((lo, hi)).ravel().tolist(), len(words)]
            kept = [w for a, b in zip(cuts[::2], cuts[1::2]) for w in words[a:b]]
            out.append((len(words), len(words) - len(kept), b" ".join(kept), np.column_stack((lo, hi)).tolist()))
        n, gone, kept, cut = zip(*out) if out else ([],) * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()), pa.array(cut, pa.list_(pa.list_(pa.int64())))], ["row", "n_words", "n_removed", "kept", "removed"])


def remove_passages(docs: DataFrame, length: int = 50, gram: int | None = None, carry: tuple[str, ...] = ("doc_id",), hot: int = 2048) -> DataFrame:
    """Per row of docs: the carried columns, n_words, n_removed, kept (binary: kept words, one space between), removed
    (array of [first word, end])."""
    scratch = Scratch(docs.sparkSession, "substring")
    gram = gram or max(1, length // 3)
    own = ("n_words", "n_removed", "kept", "removed")
    body = keyed(docs, F.struct(*[c for c in carry if c not in own]).alias("row"))
    heavy = copied(body, scratch)
    spans = repeated(body, heavy, scratch, "words", length, gram, resolver(length), hot)
    pairs = with_spans(body, spans, heavy).select("row", "body", F.coalesce("spans", F.array().cast("array<struct<lo:int,hi:int>>")).alias("spans"))
    row = body.schema["row"].dataType.simpleString()
    out = pairs.mapInArrow(_apply, f"row {row}, n_words long, n_removed long, kept binary, removed array<array<long>>")
    return out.select("row.*", "n_words", "n_removed", "kept", "removed")

"""Exact substring deduplication by suffix order: bytes covered by a string of `length` bytes that also starts elsewhere.

Equal segments are classes with a multiplicity (see repeats.py). The classes of each anchor stand in a block of text, and
its Burrows-Wheeler transform is searched: beginning at the empty string, intervals grow by backward extension, breadth
first, and every boundary between neighbours in suffix order gets its common prefix by increasing value. The search
stops at `length`; boundaries that then have no value join suffixes with that many bytes in common.

Nulls and odd rows: null text is empty; texts shorter than `length` keep everything; repeated rows repeat each other's
bytes and lose them; null or equal doc_ids do not matter; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Scratch, blobs, concat_ranges, merge_spans
from graphloom.llm.repeats import copied, keyed, repeated, suffix_order, with_spans


def shared_prefixes(text: np.ndarray, length: int) -> np.ndarray:
    """Starts of suffixes that have at least `length` symbols in common with another; text ends with its only 0."""
    n = len(text)
    sa = suffix_order(text, length)
    bwt = text[sa - 1]
    by = np.argsort(bwt, kind="stable")
    by = by.astype(np.int32)
    lf, before, after = np.empty(n, np.int32), np.full(n, -1, np.int32), np.full(n, n, np.int32)
    lf[by] = np.arange(n, dtype=np.int32)
    same = bwt[by][1:] == bwt[by][:-1]
    before[by[1:][same]] = by[:-1][same]
    after[by[:-1][same]] = by[1:][same]
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    lb, rb = np.array([0]), np.array([n])
    for _ in range(length):
        alone = rb - lb == 1
        start = lf[lb[alone]]
        size = (rb - lb)[~alone]
        at = concat_ranges(lb[~alone], size)
        first = before[at] < np.repeat(lb[~alone], size)
        last = after[at] >= np.repeat(rb[~alone], size)
        lb = np.concatenate((start, np.sort(lf[at[first]])))
        rb = np.concatenate((start, np.sort(lf[at[last]]))).astype(np.int64) + 1
        new = ~known[rb]
        lb, rb = lb[new], rb[new]
        known[rb] = True
        if not len(lb):
            break
    joined, found = np.flatnonzero(~known), np.zeros(n, bool)
    found[sa[joined - 1]] = found[sa[joined]] = True
    return np.flatnonzero(found)


def resolver(length: int):
    def resolve(bodies: list[bytes], places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A body of several places is one run of equal suffixes in the order: its windows need no neighbour."""
        sizes = np.array([len(x) for x in bodies], np.int64)
        text = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
        dense = np.zeros(256, np.uint16)
        used = np.flatnonzero(np.bincount(text, minlength=256))
        dense[used] = np.arange(2, len(used) + 2)
        text = dense[text]
        ends = np.cumsum(sizes + 1) - 1
        text[ends] = 1
        text = np.append(text, np.uint16(0))
        starts = ends - sizes
        again = np.flatnonzero(places > 1)
        p = np.concatenate((shared_prefixes(text, length), concat_ranges(starts[again], np.maximum(sizes[again] - length + 1, 0))))
        at = np.searchsorted(starts, p, side="right") - 1
        p = np.unique(p[p - starts[at] <= sizes[at] - length])
        at = np.searchsorted(starts, p, side="right") - 1
        first = np.ones(len(p), bool)
        first[1:] = (p[1:] != p[:-1] + 1) | (at[1:] != at[:-1])
        f = np.flatnonzero(first)
        last = np.append(f[1:], len(p)) - 1 if len(p) else f
        return at[f], p[f] - starts[at[f]], p[last] - starts[at[f]] + 1

    return resolve


def _apply(as_text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, out = batch.column(2), []
        flat, offsets = spans.flatten(), spans.offsets.to_numpy()
        los, his = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        offsets = offsets - offsets[0]
        for i, body in enumerate(blobs(batch.column(1))):
            lo, hi = merge_spans(los[offsets[i] : offsets[i + 1]], his[offsets[i] : offsets[i + 1]])
            cuts = [0, *np.column_stack((lo, hi)).ravel().tolist(), len(body)]
            kept = b"".join(body[a:b] for a, b in zip(cuts[::2], cuts[1::2])) if len(lo) else body
            result = kept.decode("utf-8", "ignore") if as_text else kept
            out.append((len(body), len(body) - len(kept), len(lo), result, np.column_stack((lo, hi)).tolist()))
        n, gone, runs, kept, cut = zip(*out) if out else ([],) * 5
        names = ["row", "n_bytes", "n_removed", "n_spans", "kept", "removed"]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(cut, pa.list_(pa.list_(pa.int64())))], names)


def dedup_substrings(docs: DataFrame, length: int = 400, gram: int | None = None, carry: tuple[str, ...] = ("doc_id",), as_text: bool = False, hot: int = 2048) -> DataFrame:
    """Per row of docs: the carried columns, n_bytes, n_removed, n_spans, kept (binary; as_text: a string without the
    halves of characters that a cut went through), removed (array of [start, end])."""
    scratch = Scratch(docs.sparkSession, "suffix")
    gram = gram or max(1, length // 4)
    own = ("n_bytes", "n_removed", "n_spans", "kept", "removed")
    body = keyed(docs, F.struct(*[c for c in carry if c not in own]).alias("row"))
    heavy = copied(body, scratch)
    spans = repeated(body, heavy, scratch, "bytes", length, gram, resolver(length), hot)
    pairs = with_spans(body, spans, heavy).select("row", "body", F.coalesce("spans", F.array().cast("array<struct<lo:int,hi:int>>")).alias("spans"))
    row = body.schema["row"].dataType.simpleString()
    out = pairs.mapInArrow(partial(_apply, as_text), f"row {row}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}, removed array<array<long>>")
    return out.select("row.*", "n_bytes", "n_removed", "n_spans", "kept", "removed")


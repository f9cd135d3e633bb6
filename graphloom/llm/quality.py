"""Quality of documents from weak labels.

Overlapping heuristic labellers vote bad (-1), good (1) or abstain (0) on each text; rows that somebody has annotated may
bring one more vote, which anchors the class of such rows while the labellers are estimated. Expectation-maximisation over the counts of vote patterns (at most 3 to the number of labellers,
whatever the corpus) estimates how each labeller votes on good and on bad texts. The posterior labels, of which
an annotation is one vote, of a bounded sample of all rows that teach train a hashed linear scorer, which scores every text whole.

Nulls and odd rows: null and empty text have no words and get score 0 (rejected); repeated rows get equal results; null
annotations abstain; extra columns are ignored; an empty table gives an empty result; without any vote pattern of both
kinds the posterior is what expectation-maximisation makes of one kind, and the scorer follows it.
"""

from __future__ import annotations

import itertools
import operator
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import blobs, text_of

#: Insults that one labeller looks for; a parameter.
ABUSE = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
_EDGE = b".,;:!?*#$%&|\"'()[]{}<>"
_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
DIM, KINDS = 1 << 18, 3


def measures(body: bytes, words: list[bytes], abuse: frozenset[bytes]) -> tuple[int, ...]:
    """Votes of the heuristic labellers."""
    n = len(words)
    if not n:
        return (-1, -1, -1, -1, 0, 0)
    marks = sum(len(w) > 2 and w[-1] == w[-2] and not (w[-1:].isalnum() or w[-1] >= 128) for w in words) / n
    bars = words.count(b"|") / n
    again = sum(map(operator.eq, words, words[1:])) / n
    letters = len(body) - len(body.translate(None, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    upper = (len(body) - len(body.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / max(letters, 1)
    insult = not abuse.isdisjoint(w.lower().strip(_EDGE) for w in set(words))
    plain = marks < 0.02 and bars < 0.02 and again < 0.2 and upper < 0.2 and not insult
    bad = lambda x: -1 if x else 0
    return (bad(marks > 0.08), bad(bars > 0.08), bad(again > 0.25 and n > 8), bad(upper > 0.5 and n > 8), bad(insult), 1 if plain else 0)


def _code(votes: tuple[int, ...], annotated: int) -> int:
    code = 0
    for v in (*votes, annotated):
        code = code * 3 + v + 1
    return code


def _patterns(abuse: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for body, vote in zip(blobs(batch.column(0)), batch.column(1).to_pylist()):
                seen[_code(measures(body, body.split(), abuse), vote)] += 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], ["code", "n"])

    return run


class WeakLabels:
    """Two-class model of labellers whose votes are independent given the class."""

    def __init__(self, counts: dict[int, int], labellers: int, rounds: int = 50, smooth: float = 0.1):
        self.labellers = labellers
        codes = np.array(sorted(counts), np.int64)
        n = np.array([counts[c] for c in codes.tolist()], np.float64)
        votes = self.votes(codes)
        total = (votes - 1).sum(axis=1)
        bad = np.where((votes == 0).any(axis=1), 0.95, np.where(total > 0, 0.02, 0.2))
        for _ in range(rounds):
            bad = self._anchored(votes, bad)
            w = np.stack((n * bad, n * (1 - bad)))
            self.prior = (w.sum(axis=1) + smooth) / (w.sum() + 2 * smooth)
            self.table = np.stack([[np.bincount(votes[:, j], w[k], 3) + smooth for j in range(labellers)] for k in (0, 1)])
            self.table /= self.table.sum(axis=2, keepdims=True)
            bad = self._bad(votes)
        self.bad = dict(zip(codes.tolist(), bad.tolist()))

    def _anchored(self, votes: np.ndarray, bad: np.ndarray) -> np.ndarray:
        """The last labeller is a person: while the others are estimated, whose vote holds but for a hundredth."""
        return np.where(votes[:, -1] == 0, 0.99, np.where(votes[:, -1] == 2, 0.01, bad))

    def votes(self, codes: np.ndarray) -> np.ndarray:
        return np.stack([codes // 3 ** (self.labellers - 1 - j) % 3 for j in range(self.labellers)], axis=1)

    def _bad(self, votes: np.ndarray) -> np.ndarray:
        logs = np.log(self.prior)[:, None] + np.stack([np.log(self.table[k])[np.arange(self.labellers), votes].sum(axis=1) for k in (0, 1)])
        return 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -500, 500)))

    def accuracies(self) -> np.ndarray:
        """Share of a labeller's votes, abstentions aside, that the model holds right."""
        right = self.prior[0] * self.table[0, :, 0] + self.prior[1] * self.table[1, :, 2]
        said = right + self.prior[0] * self.table[0, :, 2] + self.prior[1] * self.table[1, :, 0]
        return right / said


def word_features(word: bytes) -> tuple[int, ...]:
    """Hashed: the word, its beginning, and the shape of its end."""
    stem = word.lower().strip(_EDGE)
    shape = word.translate(_SHAPE)[-3:]
    h = lambda kind, x: zlib.crc32(kind + x) % DIM
    return h(b"w", stem), h(b"4", stem[:4]), h(b"s", shape)


AGAIN = zlib.crc32(b"again") % DIM


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A distinct word counts by the root of its share, the repetition of neighbours by its share."""
    n = max(len(words), 1)
    seen = Counter(words)
    ids = np.fromiter(itertools.chain.from_iterable(map(word_features, seen)), np.int64, KINDS * len(seen))
    value = np.repeat(np.sqrt(np.fromiter(seen.values(), np.float64, len(seen)) / n), KINDS)
    ids = np.append(ids, AGAIN)
    value = np.append(value, sum(map(operator.eq, words, words[1:])) / n)
    ids, inverse = np.unique(ids, return_inverse=True)
    return ids, np.bincount(inverse, value, len(ids))


def fit_linear(sizes: np.ndarray, ids: np.ndarray, values: np.ndarray, good: np.ndarray, rounds: int = 150, rate: float = 0.5, penalty: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, classes weighted alike; Adam over all rows at once."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    w, b = np.zeros(DIM), 0.0
    m, v, mb, vb = np.zeros(DIM), np.zeros(DIM), 0.0, 0.0
    weight = good / max(good.sum(), 1e-9) + (1 - good) / max((1 - good).sum(), 1e-9)
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[ids] * values, len(sizes)) + b
        e = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - good)
        g = np.bincount(ids, e[row] * values, DIM) + penalty * w
        gb = e.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = rate / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= 0.05 * step * mb / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, float(b)


def hash_edge(share: float) -> int:
    """The signed 64-bit hash up to which a share of all hashes lies; a share of some rows is not lost, however many there are."""
    return min(int(min(1.0, share) * 2.0**64), 2**64 - 1) - 2**63


def fit(docs: DataFrame, vote: Column, sample: int = 5000, abuse: tuple[str, ...] = ABUSE) -> tuple[WeakLabels | None, np.ndarray, float]:
    """docs: text and what `vote` needs. Vote patterns are counted over all rows; the scorer sees about `sample` rows (by
    a hash of the text, of equal rows one; never over twice as many, which chance alone does not reach), annotated or not,
    half of them bad by their posterior."""
    words = frozenset(x.encode() for x in abuse)
    rows = docs.select(text_of().cast("binary").alias("body"), F.coalesce(vote, F.lit(0)).cast("int").alias("vote"))
    counts = {r.code: r.n for r in rows.mapInArrow(_patterns(words), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return None, np.zeros(DIM), 0.0
    model = WeakLabels(counts, 7)
    low = sum(n for c, n in counts.items() if model.bad[c] >= 0.5)
    edges = [hash_edge(sample / 2 / max(n, 1)) for n in (sum(counts.values()) - low, low)]
    drawn = rows.withColumn("at", F.xxhash64("body", F.lit(29))).where(F.col("at") <= max(edges)).dropDuplicates(["body", "vote"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, v, at in zip(blobs(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                split = body.split()
                bad = model.bad[_code(measures(body, split, words), v)]
                if at > edges[bad >= 0.5]:
                    continue
                ids, values = features(split)
                out.append((bad, ids.astype(np.int32), values.astype(np.float32)))
            if out:
                bad, ids, values = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(bad, pa.float64()), pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["bad", "ids", "values"])

    table = drawn.mapInArrow(run, "bad double, ids array<int>, values array<float>").limit(2 * sample).toArrow().combine_chunks()
    if not table.num_rows:
        raise RuntimeError(f"none of {sum(counts.values())} rows was drawn to teach the scorer")
    ids, values = (table.column(c).combine_chunks() for c in ("ids", "values"))
    sizes = np.diff(ids.offsets.to_numpy())
    good = 1 - table.column("bad").to_numpy()
    ids, values = ids.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy().astype(np.float64)
    del table
    w, b = fit_linear(sizes, ids, values, good)
    return model, w, b


class _Weights(dict):
    def __init__(self, w: np.ndarray):
        super().__init__()
        self.w = w.tolist()

    def __missing__(self, word: bytes) -> float:
        w = self.w
        self[word] = x = sum([w[i] for i in word_features(word)])
        return x


def score(docs: DataFrame, columns: list[str], w: np.ndarray, b: float) -> DataFrame:
    """columns and score (0 to 1, high is good) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast((w.astype(np.float32), b))
    carried = columns.index("text") + 1 if "text" in columns and docs.schema["text"].dataType.simpleString() == "string" else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        known, again = _Weights(w), float(w[AGAIN])
        for batch in batches:
            out = []
            for body in blobs(batch.column(0).field(carried - 1) if carried else batch.column(1)):
                words = body.split()
                if not words:
                    out.append(0.0)
                    continue
                seen = Counter(words)
                roots = np.sqrt(np.fromiter(seen.values(), np.float64, len(seen)))
                weights = np.fromiter(map(known.__getitem__, seen), np.float64, len(seen))
                z = b + roots @ weights / len(words) ** 0.5 + again * sum(map(operator.eq, words, words[1:])) / len(words)
                out.append(1 / (1 + np.exp(-min(max(z, -50), 50))))
            if len(known) > 150_000:
                known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["row", "score"])

    rows = docs.select(F.struct(*columns).alias("row"), *([] if carried else [text_of().cast("binary").alias("body")]))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, score double").select("row.*", "score")


def annotated(docs: DataFrame, labels: DataFrame, small: int = 1_000_000) -> DataFrame:
    """docs with `vote`: -1 where somebody found the document bad or toxic, 1 where neither, null elsewhere."""
    vote = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), -1).when(F.col("quality") == 1, 1)
    one = labels.groupBy("doc_id").agg(F.min(vote).alias("vote"))
    return docs.join(F.broadcast(one) if labels.count() <= small else one, "doc_id", "left")


def classify(docs: DataFrame, labels: DataFrame | None = None, held_out: Column | None = None, columns: list[str] | None = None, least: float = 0.4, **settings) -> DataFrame:
    """columns (default doc_id), score and keep. Rows where held_out is true teach nothing."""
    known = annotated(docs.select("doc_id", "text"), labels) if labels is not None else docs.select("doc_id", "text", F.lit(None).cast("int").alias("vote"))
    if held_out is not None:
        known = known.where(~held_out)
    _, w, b = fit(known, F.col("vote"), **settings)
    found = score(docs, [c for c in columns or ["doc_id"] if c not in ("score", "keep")], w, b)
    return found.withColumn("keep", F.col("score") >= least)

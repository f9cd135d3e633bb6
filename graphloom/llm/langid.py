"""Language of texts by a byte convolutional network.

Bytes are folded to 128 classes (case, digits and punctuation fall together, each lead byte of UTF-8 stands alone) with a
learnt embedding; filters of several
widths run over windows of fixed length; each filter's largest response in the window goes through a softmax layer. A
text's windows cover all of it and their log probabilities are averaged. Trained in numpy, by hand-written gradients,
on a bounded sample of labelled rows; applied to batches of windows, where a filter's response to its bytes is looked up
in tables made from the same weights.

Nulls and odd rows: null text, and text without a letter, is `und` with score 0; rows with null language teach nothing;
without any labelled rows every text is `und`; repeated rows get equal results; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import blobs, text_of

WINDOW, CLASSES = 256, 128


def _fold() -> np.ndarray:
    table = np.full(256, 28, np.uint8)
    for c in range(26):
        table[65 + c] = table[97 + c] = 1 + c
    table[[9, 10, 11, 12, 13, 32]] = 0
    table[48:58] = 27
    table[0x80:0xC0] = 32 + (np.arange(0x80, 0xC0) & 31)
    table[0xC0:] = 64 + np.arange(64)
    return table


FOLD = _fold()


class Network:
    """Embedding, filters by width, and the softmax layer."""

    def __init__(self, labels: list[str], widths: tuple[int, ...] = (2, 3, 4), filters: int = 8, size: int = 8, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.labels, self.widths, self.filters = labels, widths, filters
        self.p = {"emb": rng.normal(0, 0.5, (CLASSES, size)), "out": rng.normal(0, 0.1, (filters * len(widths), len(labels))), "bias": np.zeros(len(labels))}
        for w in widths:
            self.p[f"k{w}"] = rng.normal(0, (2 / (w * size)) ** 0.5, (w, size, filters))
            self.p[f"b{w}"] = np.zeros(filters)

    def tables(self, w: int) -> list[np.ndarray]:
        return [self.p["emb"] @ self.p[f"k{w}"][j] for j in range(w)]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """x: windows (n, length) of classes; y: label numbers."""
        n, features, best = len(x), [], []
        for w in self.widths:
            span = x.shape[1] - w + 1
            r = sum(t[x[:, j : j + span]] for j, t in enumerate(self.tables(w)))
            at = r.argmax(axis=1)
            best.append(at)
            features.append(np.take_along_axis(r, at[:, None, :], 1)[:, 0] + self.p[f"b{w}"])
        f = np.concatenate(features, axis=1)
        on = f > 0
        h = f * on
        z = h @ self.p["out"] + self.p["bias"]
        z -= z.max(axis=1, keepdims=True)
        q = np.exp(z)
        q /= q.sum(axis=1, keepdims=True)
        loss = -np.log(q[np.arange(n), y] + 1e-12).mean()
        q[np.arange(n), y] -= 1
        q /= n
        g = {"out": h.T @ q, "bias": q.sum(axis=0), "emb": np.zeros_like(self.p["emb"])}
        back = (q @ self.p["out"].T) * on
        column = np.broadcast_to(np.arange(self.filters), (n, self.filters))
        for i, w in enumerate(self.widths):
            b = back[:, i * self.filters : (i + 1) * self.filters]
            g[f"b{w}"], g[f"k{w}"] = b.sum(axis=0), np.zeros_like(self.p[f"k{w}"])
            for j in range(w):
                t = np.zeros((CLASSES, self.filters))
                np.add.at(t, (np.take_along_axis(x, best[i] + j, 1), column), b)
                g["emb"] += t @ self.p[f"k{w}"][j].T
                g[f"k{w}"][j] = self.p["emb"].T @ t
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 128, rate: float = 0.01, least: int = 240, seed: int = 2) -> None:
        """Adam; of few windows as many epochs as give `least` steps."""
        rng, t = np.random.default_rng(seed), 0
        epochs = max(epochs, -(-least // -(-len(x) // batch)))
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                pick = order[i : i + batch]
                _, g = self.gradients(x[pick], y[pick])
                t += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def compiled(self) -> Compiled:
        return Compiled(self)


class Compiled:
    """The network as tables: a row of filter responses for every class or pair of classes."""

    def __init__(self, network: Network):
        f32 = lambda a: np.ascontiguousarray(a, np.float32)
        self.labels, self.out, self.bias = network.labels, f32(network.p["out"]), f32(network.p["bias"])
        self.parts = []
        for w in network.widths:
            t, parts = network.tables(w), []
            for at in range(0, w, 2):
                own = t[at : at + 2]
                table = own[0] if len(own) == 1 else (own[0][:, None, :] + own[1]).reshape(-1, own[0].shape[1])
                parts.append((at, len(own), f32(table)))
            self.parts.append((w, parts, f32(network.p[f"b{w}"])))

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """windows: (n, WINDOW) of classes."""
        x = np.ascontiguousarray(windows.T).astype(np.intp)
        codes = {1: x, 2: x[:-1] * CLASSES + x[1:]}
        features = []
        for w, parts, bias in self.parts:
            span = WINDOW - w + 1
            r = None
            for at, n, table in parts:
                got = table.take(codes[n][at : at + span], axis=0, mode="clip")
                r = got if r is None else np.add(r, got, out=r)
            features.append(r.max(axis=0) + bias)
        h = np.maximum(np.concatenate(features, axis=1), 0)
        z = h @ self.out + self.bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows_of(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows that cover the texts whole (the last filled up with white space), and how many each has."""
    n = np.array([max(1, -(-len(b) // WINDOW)) for b in bodies])
    joined = b"".join(b.ljust(k * WINDOW) for b, k in zip(bodies, n.tolist()))
    return FOLD[np.frombuffer(joined, np.uint8)].reshape(-1, WINDOW), n


def drawn_windows(known: DataFrame, shares: dict[str, float], seed: int = 17) -> DataFrame:
    """lang, window, mark: of all windows of the texts of `known` (text, lang) those whose hash falls below their language's
    share; equal windows of a language are drawn together and stay one row."""
    edge = {name: int(share * 2.0**64) for name, share in shares.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), blobs(batch.column(1))):
                windows, _ = windows_of([body])
                marks = np.array([xxhash.xxh64_intdigest(w.tobytes(), seed) for w in windows], np.uint64)
                keep = np.flatnonzero(marks <= np.uint64(min(edge[name], 2**64 - 1)))
                if len(keep):
                    columns = [pa.array([name] * len(keep), pa.string()), pa.array([windows[i].tobytes() for i in keep], pa.binary()), pa.array(marks[keep].view(np.int64), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "window", "mark"])

    return known.select("lang", text_of().cast("binary")).mapInArrow(run, "lang string, window binary, mark long").distinct()


def train(docs: DataFrame, per_language: int = 4800, most: int = 200_000, epochs: int = 6) -> Compiled | None:
    """docs: text, lang. A labelled row is a window: all windows of all texts can be drawn, by their hash, and at most
    `per_language` of each language are learned from (fewer where all languages together would exceed `most`); no more than
    `most` windows of 256 bytes, and one for each language beyond that many languages, reach the driver."""
    known = docs.where(F.col("lang").isNotNull() & text_of().rlike(r"\p{L}"))
    windows_each = F.greatest(F.lit(1), F.ceil(F.octet_length(text_of()) / WINDOW))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.sum(windows_each).alias("n")).collect()}
    if not counts:
        return None
    bound = max(1, min(per_language, most // len(counts)))
    drawn = drawn_windows(known, {name: bound / n for name, n in counts.items()})
    order = Window.partitionBy("lang").orderBy("mark", "window")  # about `bound` rows a language
    sample = drawn.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= bound).toPandas().sort_values(["lang", "rank"])
    labels = sorted(counts)
    network = Network(labels)
    if len(sample):
        place = {name: i for i, name in enumerate(labels)}
        windows = np.frombuffer(b"".join(map(bytes, sample.window)), np.uint8).reshape(-1, WINDOW)
        network.fit(windows, sample.lang.map(place).to_numpy(), epochs)
    return network.compiled()


def predict(docs: DataFrame, model: Compiled | None) -> DataFrame:
    """Adds lang_pred and score to docs (doc_id, held_out, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            has, names, scores = batch.column(3).to_pylist(), [], []
            held: list[bytes] = []

            def flush():
                windows, n = windows_of(held)
                logs = np.concatenate([model.log_probabilities(windows[i : i + 512]) for i in range(0, len(windows), 512)])
                starts = np.cumsum(n) - n
                mean = np.add.reduceat(logs, starts) / n[:, None]
                p = np.exp(mean - mean.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                top = p.argmax(axis=1)
                names.extend(model.labels[i] for i in top)
                scores.extend(p[np.arange(len(top)), top].astype(float).tolist())
                held.clear()

            if model is None:
                names, scores = ["und"] * len(has), [0.0] * len(has)
            else:
                size = 0
                for body in blobs(batch.column(2)):
                    held.append(body)
                    size += len(body)
                    if size > 1 << 21:
                        flush()
                        size = 0
                if held:
                    flush()
            names = [x if ok else "und" for x, ok in zip(names, has)]
            scores = [x if ok else 0.0 for x, ok in zip(scores, has)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "held_out", text_of().cast("binary").alias("body"), text_of().rlike(r"\p{L}").alias("has"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, held_out: Column, **settings) -> DataFrame:
    """Learns from rows where held_out is false and predicts all: doc_id, held_out, lang_pred, score."""
    model = train(docs.where(~held_out).select("text", "lang"), **settings)
    return predict(docs.select("doc_id", "text", held_out.alias("held_out")), model)

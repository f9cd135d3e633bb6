"""Texts beyond one chunk (262,144 symbols) for the operators that read texts in chunks, and the pipeline on an empty table."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import substring, suffix


def long_texts(seed, n, make):
    """Three texts of n symbols and a short one; the first two share stretches across chunk borders, the third repeats itself."""
    rng = random.Random(seed)
    a, b, c = (make(rng, n) for _ in range(3))
    b[260_000:262_900] = a[100:3000]
    b[-500:] = a[-500:]
    c[5_000:6_000] = c[262_000:263_000]
    return [a, b, c, a[261_900:262_500]]


def covered(texts, length):
    """Per text which symbols a window covers that also starts elsewhere; windows as bytes of an integer array."""
    arrays = [np.asarray(t, np.uint32) for t in texts]
    windows = [[x[i : i + length].tobytes() for i in range(len(x) - length + 1)] for x in arrays]
    count = collections.Counter(hash(w) for ws in windows for w in ws)
    out = []
    for x, ws in zip(arrays, windows):
        starts = np.array([count[hash(w)] > 1 for w in ws], bool)
        gone = np.zeros(len(x), bool)
        for at in np.flatnonzero(starts):
            gone[at : at + length] = True
        out.append(gone)
    return out


def test_bytes_across_chunks(spark):
    texts = [bytes(t) for t in long_texts(1, 300_000, lambda rng, n: [rng.choice(b"abcdefghijklmnopqrstuvwxyz ") for _ in range(n)])]
    gone = covered([list(t) for t in texts], 400)
    want = {i: (len(t), int(g.sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~g])).hexdigest()) for i, (t, g) in enumerate(zip(texts, gone))}
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in suffix.dedup_substrings(df, length=400).select("doc_id", "n_bytes", "n_removed", F.sha2("kept", 256)).collect()}
    assert got == want and want[1][1] >= 3400 and want[2][1] >= 2000


def test_words_across_chunks(spark):
    texts = long_texts(2, 270_000, lambda rng, n: [rng.randrange(5000) for _ in range(n)])
    gone = covered(texts, 35)
    kept = [" ".join(f"w{x}" for x, g in zip(t, m) if not g) for t, m in zip(texts, gone)]
    want = {i: (len(t), int(m.sum()), hashlib.sha256(k.encode()).hexdigest()) for i, (t, m, k) in enumerate(zip(texts, gone, kept))}
    df = spark.createDataFrame([(i, " ".join(f"w{x}" for x in t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in substring.remove_passages(df, length=35).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()}
    assert got == want and want[1][1] >= 3400 and want[2][1] >= 2000


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", "en", "s", 0)]])
def test_pipeline_on_tables_without_text(spark, tmp_path, rows):
    import corpus_pipeline as P

    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []

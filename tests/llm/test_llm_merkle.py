"""The manifest against a plain Merkle tree: nulls, ties, lone and repeated leaves, many copies of upper rows, one or no row."""

import collections
import hashlib
import random
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from graphloom.llm import merkle
from graphloom.llm.q_merkle import op13_recursive_climb

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size long, path string"


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(row, lower=False):
    doc_id, text, lang, source, n_chars = row
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes, fan):
    """Root and per leaf its siblings by level, as (before, after)."""
    ways = [[] for _ in nodes]
    level, below = list(nodes), [[i] for i in range(len(nodes))]
    while len(level) > 1:
        up, groups = [], []
        for a in range(0, len(level), fan):
            run = level[a : a + fan]
            for j in range(len(run)):
                for i in below[a + j]:
                    ways[i].append((run[:j], run[j + 1 :]))
            up.append(h(*run))
            groups.append([i for x in below[a : a + fan] for i in x])
        level, below = up, groups
    return level[0], ways


def plain(rows, fan):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((mine, *tree([leaf(r) for r in mine], fan)))
    root, tops = tree([t[1] for t in trees], fan)
    out = collections.Counter()
    for (mine, sub, ways), top in zip(trees, tops):
        for r, way in zip(mine, ways):
            now = leaf(r, lower=r[0] is not None and crc32(str(r[0]).encode()) % 3 == 0)
            for before, after in way + top:
                now = h(*before, now, *after)
            out[r[0], leaf(r), sub, root, h(*(x for pair in way + top for side in pair for x in side)), now, now == root] += 1
    return out


def rows_of(n, seed):
    rng = random.Random(seed)
    langs = ["en"] * 6 + ["de", None, "", "-", "Ü", "z"]
    rows = [(rng.choice([None, i, i, i, i // 2]), rng.choice([None, "", "Ab C", "ÄÖ Z" * 3, f"Text {i}"]), rng.choice(langs), rng.choice([None, "s"]), rng.choice([None, i])) for i in range(n)]
    return rows + rows[: n // 4] + [(7, "One", "lone", "s", 3)] * (n > 9)


def result(spark, tmp_path, rows):
    folder = tmp_path / "t"
    spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3).write.parquet(str(folder / "documents.parquet"))
    df = op13_recursive_climb(spark, str(folder))
    return collections.Counter(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()))


@pytest.mark.parametrize("n,part", [(1, 4096), (9, 4096), (150, 2)])
def test_manifest_equals_plain_tree(spark, tmp_path, monkeypatch, n, part):
    monkeypatch.setattr(merkle, "PART", part)
    rows = rows_of(n, n)
    got = result(spark, tmp_path, rows)
    assert got == plain(rows, 8)
    assert sum(got.values()) == len(rows)


def test_one_language_and_other_fan(spark):
    rows = [(i, f"T{i}", "en", None, i) for i in range(11)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    found = merkle.manifest(merkle.leaves(df, [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")], F.col("lang"), F.col("doc_id")), fan=2)
    root, ways = tree([leaf(r) for r in rows], 2)
    assert found.root.hex() == root
    got = {r["key"]: r for r in merkle.proofs(found).collect()}
    assert all(bytes(got[i]["siblings"]).hex() == "".join(x for pair in ways[i] for side in pair for x in side) and bytes(got[i]["folded"]).hex() == root for i in range(11))


def test_empty_table(spark, tmp_path):
    assert not result(spark, tmp_path, [])

"""Paths with filters and a limit against a plain search of a small graph, text search by grams against reading all."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import audit as A
from graphloom.operators import dataset as D
from graphloom.operators import paths as P
from graphloom.operators import search as S

LABELS = ("Drug", "Gene", "Disease")


def graph(seed, hub=False):
    rng = random.Random(seed)
    nodes = [(rng.choice(LABELS), f"n{i}") for i in range(14)]
    ends = {(nodes[0] if hub and rng.random() < 0.6 else rng.choice(nodes), rng.choice(("R", "S")), rng.choice(nodes)) for _ in range(26)}
    return [(*h, r, *t, rng.randrange(6), rng.randrange(1, 4)) for h, r, t in sorted(ends)]


def plain(edges, search, labels, relations, tier, citations, depth, limit):
    kept = [(i, (e[0], e[1]), (e[3], e[4])) for i, e in enumerate(sorted(x for x in edges if x[5] >= tier and x[6] >= citations and (not relations or x[2] in relations)), 1)]
    nodes = sorted({n for _, a, b in kept for n in (a, b)})
    out = []
    now = [((n,), ()) for n in nodes if search.lower() in n[1].lower()]
    for _ in range(depth):
        now = [(ns + (b if ns[-1] == a else a,), es + (i,)) for ns, es in now for i, a, b in kept if i not in es and ns[-1] in (a, b)]
        hits = [(ns[0], es, ns[-1]) for ns, es in now if not labels or any(n[0] in labels for n in ns)]
        out += sorted(hits)
    return out[:limit] if limit else out


@pytest.mark.parametrize(
    "seed,hub,search,labels,relations,tier,citations,depth,limit,part",
    [
        (1, False, "", (), (), 0, 1, 3, None, 4096),
        (2, True, "N1", ("Gene",), (), 1, 1, 3, 40, 2),
        (3, True, "n", ("Disease",), ("R",), 0, 1, 3, 25, 3),
        (4, False, "3", ("Drug", "Gene"), (), 0, 2, 2, 7, 2),
        (5, True, "", (), (), 0, 1, 3, 2000, 2),
        (6, False, "absent", (), (), 0, 1, 2, 5, 4096),
    ],
)
def test_paths_equal_a_plain_search(spark, seed, hub, search, labels, relations, tier, citations, depth, limit, part):
    edges = graph(seed, hub)
    df = spark.createDataFrame(edges, "head_label string, head_key string, relation string, tail_label string, tail_key string, evidence_tier int, citations int")
    paths = P.Paths(df, relations, tier, citations, labels, part)
    got = [((r["start"]["label"], r["start"]["key"]), tuple(r["path"]), (r["end"]["label"], r["end"]["key"])) for r in paths.of(paths.starts(search), depth, limit).collect()]
    want = plain(edges, search, labels, relations, tier, citations, depth, limit)
    assert sorted(got, key=lambda x: (len(x[1]), x)) == want
    most = paths.adjacency.groupBy("at", "salt").count().agg(F.max("count")).first()[0]
    assert most is None or most <= max(3 * part, 8)  # dealt out by a hash, so about `part`


def test_batches_of_starts_give_the_same_paths(spark, monkeypatch):
    edges = graph(7, True)
    df = spark.createDataFrame(edges, "head_label string, head_key string, relation string, tail_label string, tail_key string, evidence_tier int, citations int")
    paths = P.Paths(df, labels=("Gene",))
    monkeypatch.setattr(P, "BATCH", 2)
    got = [((r["start"]["label"], r["start"]["key"]), tuple(r["path"])) for r in paths.of(paths.starts("n"), 3, 60).collect()]
    assert sorted(got, key=lambda x: (len(x[1]), x)) == [x[:2] for x in plain(edges, "n", ("Gene",), (), 0, 1, 3, 60)]
    with pytest.raises(ValueError):
        paths.of(paths.starts(), 4)


def test_search_equals_reading_all(spark):
    rng = random.Random(3)
    words = ["Straße", "STRASSE", "glioma", "GLIOMA-2", "a", "É", "", None, "x\u0001y", "TP53 in mice", "in"]
    rows = [(i, rng.choice(words), " ".join(filter(None, rng.choices(words, k=4))), rng.choice(words)) for i in range(300)]
    df = spark.createDataFrame(rows + rows[:20], "id int, a string, b string, c string")
    index = S.build(df, ("a", "b", "c"))
    for needle in ("strasse", "ß", "in", "n", "GLIOMA-", "é", "\u0001", "53 in m", "mice glioma", "nowhere", "zq", "", "aa"):
        want = sorted(i for i, *texts in rows + rows[:20] if any(needle.casefold() in t.casefold() for t in texts if t is not None))
        assert sorted(r["id"] for r in S.search(index, needle).collect()) == want, needle
    assert S.search(S.build(df.limit(0), ("a",)), "x").collect() == []


@pytest.mark.parametrize("tracked", [16, 1024])
def test_heavy_hitters_are_exact(spark, tracked):
    rng = random.Random(4)
    rows = [("hot",)] * 300 + [("warm",)] * 300 + [(f"k{rng.randrange(400)}",) for _ in range(2000)] + [(None,)] * 5
    df = spark.createDataFrame(rows, "k string")
    counts = {}
    for (k,) in rows:
        if k is not None:
            counts[k] = counts.get(k, 0) + 1
    want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:5]
    assert sorted(map(tuple, A.heavy_hitters(df, F.col("k"), 5, tracked).collect()), key=lambda x: (-x[1], x[0])) == want
    assert A.heavy_hitters(df.limit(0), F.col("k"), 5).collect() == []


def test_leakage_keeps_the_least_keys(spark):
    rng = random.Random(5)
    rows = [(f"k{rng.randrange(60)}", rng.choice("abc")) for _ in range(400)] + [(None, "a"), ("only", "a"), ("two", "a"), ("two", "d")]
    got = {(r["a"], r["b"]): (r["shared"], list(r["first"])) for r in D.leakage(spark.createDataFrame(rows, "key string, part string"), "key", "part").collect()}
    parts = {p: {k for k, q in rows if q == p and k} for p in "abcd"}
    want = {(a, b): (len(parts[a] & parts[b]), sorted(parts[a] & parts[b])[:5]) for a in "abcd" for b in "abcd" if a < b and parts[a] & parts[b]}
    assert got == want


def test_negatives_are_the_least_hashes(spark):
    import hashlib

    rng = random.Random(6)
    rows = [(rng.randrange(12), f"h{rng.randrange(5)}", rng.choice([f"t{rng.randrange(4)}", " ", f"h{rng.randrange(5)}"])) for _ in range(60)]
    df = spark.createDataFrame(rows, "group_id int, head string, tail string")
    ends = {}
    for g, *x in rows:
        ends.setdefault(g, set()).update(v for v in x if v.strip())
    pairs = {(g, a, b) for g, e in ends.items() for a in e for b in e if a != b} - {(g, a, b) for g, a, b in rows}
    order = sorted(pairs, key=lambda p: (hashlib.sha256(f"13|{p[0]}|{p[1]}|{p[2]}".encode()).hexdigest(), p))
    for ratio, most in ((1.0, None), (0.1, None), (0.5, 7), (9.0, None), (0.0, None)):
        target = max(int(len(rows) * ratio), 1 if ratio else 0)
        target = min(target, most) if most is not None else target
        got = {(r["group_id"], r["head"], r["tail"]) for r in D.negative_samples(df, ratio, most).collect()}
        assert got == set(order[:target]), (ratio, most)


def test_evaluation_summary_and_confusion(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")]
    df = spark.createDataFrame(rows, "true string, pred string")
    r = D.evaluation_summary(df, ("a", "d")).first()
    f1 = {"a": 0.5, "b": 2 / 3, "c": 0.0, "d": 0.0}
    assert (r["examples"], r["accuracy"], round(r["macro_f1"], 9)) == (4, 0.5, round(sum(f1.values()) / 4, 9))
    assert r["warnings"] == "fewer than 10 evaluation examples; label(s) absent from evaluation set: d"
    cells = {(x["true"], x["pred"]): x["n"] for x in D.confusion_matrix(df, ("d",)).collect()}
    assert cells == {(a, b): rows.count((a, b)) for a in "abcd" for b in "abcd"}
    assert D.evaluation_summary(df.limit(0)).first()["accuracy"] == 0.0

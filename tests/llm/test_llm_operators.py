"""Operators on small tables with nulls, empty texts, repeated rows and odd columns, against plain definitions."""

import collections
import hashlib
import math
import pathlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import ann, langid, mixing, packing, quality, simhash, substring, suffix, suffix_tree, topk
from graphloom.llm.common import Scratch, crc_bucket
from graphloom.llm.q_packing import FILES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, k1 string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), 0.0, "x") for i, t, lang, src in rows], SCHEMA).repartition(parts)


def sample(seed=1, n=60):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Ünder", "ñandu", "x", "the", "the", "of"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(12)]
    rows = [(i, rng.choice(base) + "  " + rng.choice(base)[: rng.randint(0, 80)] + "\n" + rng.choice(base), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for i in range(n)]
    return [*rows, (100, None, "en", "a"), (101, "", None, None), (102, " \t ", "en", "a"), (None, "no id here", "en", "b"), (7, rows[7][1], "en", "a"), rows[3], (103, "y" * 5000 + " tail", "de", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, sample())


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


@pytest.mark.parametrize("hot", [4096, 2])
def test_substrings(spark, docs, hot):
    rows = sample()
    texts, length = [(t or "").encode() for _, t, _, _ in rows], 25
    count = collections.Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    want = collections.Counter()
    for (i, *_), b in zip(rows, texts):
        gone = np.zeros(len(b), bool)
        for at in range(len(b) - length + 1):
            if count[b[at : at + length]] > 1:
                gone[at : at + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want[i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()] += 1
    got = suffix.dedup_substrings(docs, length=length, hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert collections.Counter(map(tuple, got)) == want


@pytest.mark.parametrize("hot", [4096, 2])
def test_passages(spark, docs, hot):
    rows, length = sample(), 8
    words = [(t or "").encode().split() for _, t, _, _ in rows]
    count = collections.Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    want = collections.Counter()
    for (i, *_), w in zip(rows, words):
        gone = [False] * len(w)
        for at in range(len(w) - length + 1):
            if count[tuple(w[at : at + length])] > 1:
                gone[at : at + length] = [True] * length
        want[i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()] += 1
    got = substring.remove_passages(docs, length=length, hot=hot).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert collections.Counter(map(tuple, got)) == want


@pytest.mark.parametrize("tile", [4096, 3])
def test_near_duplicates(spark, docs, tile):
    rows = sample()
    fp = [int(simhash.fingerprint((t or "").encode(), 4)[0]) for _, t, _, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    low = collections.defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)].append(r[0])
    want = collections.Counter((r[0], f, min(low[find(i)], default=None)) for i, (r, f) in enumerate(zip(rows, fp)))
    got = simhash.near_duplicates(docs, width=4, radius=4, lanes=1, tile=tile).collect()
    assert collections.Counter((r.doc_id, r.fp[0] % (1 << 64), r.component_id) for r in got) == want


def test_wide_fingerprints_link_near_copies_only(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for g in range(15):
        words = [word() for _ in range(200)]
        rows.append((2 * g, " ".join(words), "en", "a"))
        words[rng.randrange(200)] = "changed"
        rows.append((2 * g + 1, " ".join(words), "en", "a"))
    got = simhash.near_duplicates(table(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 2 for i in range(30)}


def test_suffix_tree(spark, docs):
    rows, held = sample(), lambda i: i is not None and i % 4 == 1
    rule = F.coalesce(F.col("doc_id") % 4 == 1, F.lit(False))
    words = [(t or "").encode().lower().split() for _, t, _, _ in rows]
    count, ends = collections.Counter(), 0
    for (i, *_), w in zip(rows, words):
        if not held(i):
            count.update(w)
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    want = collections.Counter((i, held(i), len(w) + 1, sum(count[x] > 0 for x in w) + 1, n, round(sum(math.log10((c + 1) / (n + v + 1)) for c in [ends, *(count[x] for x in w)]), 6)) for (i, *_), w in zip(rows, words))
    for head in (200_000, 3):
        got = suffix_tree.score_documents(docs, rule, head=head).collect()
        assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    got = suffix_tree.score_documents(docs, rule).collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def suffix_tree_by_definition(texts, depth, context_least, least, discount=0.5, strictness=3.0):
    """Plain dictionaries of the same tree: a function from a context (tuple of words) to the probability of a next word."""
    sequences = [[*t.lower().split(), None] for t in texts]
    count = collections.Counter(tuple(q[i : i + d]) for q in sequences for d in range(1, depth + 2) for i in range(len(q) - d + 1))
    total, distinct = sum(len(q) for q in sequences), len({w for q in sequences for w in q})
    states = {}

    def p(context, word):
        if not context:
            return (count[(word,)] + 1) / (total + distinct + 1)
        lower = p(context[1:], word)
        if context not in states:
            return lower
        rest, entries = states[context]
        return (max(entries[word] - discount, 0) / count[context] if word in entries else 0.0) + rest * lower

    for d in range(1, depth + 1):
        nexts = collections.defaultdict(dict)
        for run, n in count.items():
            if len(run) == d + 1 and n >= least and count[run[:-1]] >= context_least:
                nexts[run[:-1]][run[-1]] = n
        kept = {}
        for context, entries in nexts.items():
            n, lower = count[context], {w: p(context[1:], w) for w in entries}
            gain = sum(c * math.log(c / n / lower[w]) for w, c in entries.items())
            left = n - sum(entries.values())
            if left > 0:
                gain += left * math.log(left / n / max(1 - sum(lower.values()), 1e-12))
            if 2 * gain > len(entries) + strictness * math.sqrt(2 * len(entries)):
                kept[context] = (1 - sum(max(c - discount, 0) for c in entries.values()) / n, entries)
        states |= kept
    return p, states, {w for q in sequences for w in q}


def test_tree_states_are_distributions(spark):
    p, states, words = suffix_tree_by_definition([t or "" for _, t, *_ in sample()], 3, 5, 2)
    assert {len(c) for c in states} == {1, 2, 3}
    for context in states:
        assert abs(sum(p(context, w) for w in [*words, "never said"]) - 1) < 1e-9


def test_languages(spark):
    rng = random.Random(6)
    kinds = {"aa": ["shing", "thew", "oughts", "wharf"], "bb": ["zeño", "ñandú", "cción", "llar"]}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(40)), k, "s") for i in range(80) for k in [rng.choice(["aa", "bb"])]]
    rows += [(200, None, "aa", "s"), (201, "12 34 !!", "aa", "s"), (202, "", "bb", "s"), (203, "shing thew wharf oughts", None, "s")]
    got = {r.doc_id: r for r in langid.identify(table(spark, rows), crc_bucket(F.col("doc_id"), 5) == 0).collect()}
    assert all(got[i].lang_pred == k for i, _, k, _ in rows[:80])
    assert [got[i].lang_pred for i in (200, 201, 202, 203)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values())


def test_languages_learn_from_whole_texts(spark):
    """Any window of a text can be drawn, whatever its length; no language is left out; the bound holds."""
    rng = random.Random(7)
    body = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = [(i, body(rng.choice([5, 300, 256, 40_000])), f"l{i % 70}", "s") for i in range(140)] + [(900, "ж" * 300, "l0", "s")] * 2
    docs = table(spark, rows).select("text", "lang")
    want = set()
    for _, text, lang, _ in rows:
        windows, _ = langid.windows_of([text.encode()])
        want |= {(lang, w.tobytes()) for w in windows}
    got = [(r.lang, bytes(r.window)) for r in langid.drawn_windows(docs, {f"l{i}": 1.0 for i in range(70)}).collect()]
    assert len(got) == len(want) and set(got) == want
    half = langid.drawn_windows(docs, {f"l{i}": 0.5 for i in range(70)}).count()
    assert 0.4 * len(want) < half < 0.6 * len(want)
    assert langid.train(docs, per_language=3, epochs=1).labels == sorted({lang for _, _, lang, _ in rows})
    assert len({langid.FOLD[b] for b in range(0xC0, 0x100)}) == 64


def test_quality(spark):
    rng = random.Random(8)
    plain = lambda: " ".join(rng.choice(["a", "mild", "story", "went", "home"]) + rng.choice(["", ","]) for _ in range(40))
    rows, labels = [], []
    for i in range(120):
        kind = i % 4
        text = plain() if kind < 2 else " ".join(f"{w}***" for w in plain().split()) if kind == 2 else plain() + " you idiot " + plain()
        rows.append((i, text, "en", "s"))
        if i % 3 == 0:
            labels.append((i, 1 if kind != 2 else 0, 1 if kind == 3 else 0))
    rows += [(500, None, "en", "s"), (501, "", "en", "s")]
    annotated = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for known in (annotated, None):
        got = {r.doc_id: r.keep for r in quality.classify(table(spark, rows), known).collect()}
        assert sum(got[i] == (i % 4 < 2) for i in range(120)) >= 117
        assert not got[500] and not got[501]


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(FILES[0])
    got = packing.pack_documents(docs, FILES, 64).collect()
    fill, back = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
        back[r.doc_id].append((r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    rooms = []
    for n in sorted((r.length for r in got), reverse=True):  # best fit, for comparison
        fits = [x for x in rooms if x >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 64) - n)
    assert len(fill) <= len(rooms) + 1
    for i, text, _, _ in sample():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        if i not in (3, 7):
            assert [x for _, _, p in sorted(back[i]) for x in p] == ids
            assert all(len(p) == 64 for _, _, p in sorted(back[i])[1:])


def test_mixing(spark, docs):
    everything = mixing.mix(docs, budget=1.0, alphas=dict.fromkeys(mixing.DIMS, 1.0)).collect()
    assert len(everything) == len(sample())
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(1, 30), rng.choice(["en", "en", "de"]), rng.choice(["a", "a", "a", "b"])) for i in range(3000)]
    source = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "value string, share double")
    got = mixing.mix(table(spark, rows), budget=0.3, alphas=dict.fromkeys(mixing.DIMS, 1.0), targets={"source": source}).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    share = {r.source: r.n / sum(x.n for x in got) for r in got}
    total = sum(len(t.split()) for _, t, _, _ in rows)
    assert abs(share["a"] - 0.5) < 0.04 and abs(sum(r.n for r in got) / total - 0.3) < 0.03


def test_raking_meets_its_targets_within_what_cells_hold(spark):
    from graphloom.llm.common import Scratch

    rng = random.Random(4)
    rows = [(s, l, t, int(10 ** rng.uniform(1, 5))) for s in "abcdefgh" for l in ("en", "de") for t in ("x", "y", "z")]
    cells, total = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long"), sum(r[3] for r in rows)
    alphas = {"source": 0.5, "lang": 0.7, "topic": 0.9}
    got = mixing.rake(cells, 0.7, alphas, {}, Scratch(spark, "t")).collect()
    joined = mixing.rake(cells, 0.7, alphas, {}, Scratch(spark, "t"), rounds=3, small=0).collect()
    summed = mixing.rake(cells, 0.7, alphas, {}, Scratch(spark, "t"), rounds=3).collect()
    key = lambda r: (r.source, r.lang, r.topic, r.tokens, round(r.weight, 6))
    assert sorted(map(key, joined)) == sorted(map(key, summed))
    assert all(0 <= r.weight <= r.tokens for r in got)
    for d in mixing.DIMS:
        have, now = collections.Counter(), collections.Counter()
        for r in got:
            have[r[d]] += r.tokens
            now[r[d]] += r.weight
        low, high = 0.0, 1e9
        for _ in range(200):  # by halving
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(n, mid * n ** alphas[d]) for n in have.values()) < 0.7 * total else (low, mid)
        assert all(abs(now[k] - min(n, low * n ** alphas[d])) < 1e-3 * total for k, n in have.items())


def vectors(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:140] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [None] + [1.0] * 15), (1200, [float("inf")] * 16), (1250, [1.0, 2.0]), (None, [1.0] * 16), (0, x[0].tolist())]
    return x.astype(float), spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<float>, rank int")


def test_nearest(spark):
    x, rows = vectors(spark)
    got = collections.defaultdict(list)
    for r in ann.nearest(rows, F.col("vec_id") % 50 == 0, k=5, block=200, query_block=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 600, 50))
    norm, hits = np.linalg.norm(x, axis=1), 0
    for q, found in got.items():
        s = x @ x[q] / (norm * norm[q])
        s[q] = -9
        best = np.lexsort((np.arange(600), -s.round(12)))[:5]
        hits += len({i for i, _ in found} & set(best.tolist()))
        assert len(found) == 5 and all(abs(score - s[i]) < 1e-12 for i, score in found)
    assert hits >= 0.9 * 60


def test_nearest_codes(spark):
    x, rows = vectors(spark)
    code = F.aggregate(F.transform("embedding", lambda v, i: F.when(v > 0, F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a + b)
    codes = ((x > 0) * (1 << np.arange(16))).sum(axis=1)
    plain = rows.where("vec_id < 600")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.distance) for r in topk.nearest_codes(plain, F.col("vec_id") % 20 == 0, k=4, code=code, block=250, query_block=4).collect()}
    for q in range(0, 600, 20):
        order = sorted((int(c ^ codes[q]).bit_count(), i) for i, c in enumerate(codes.tolist()) if i != q)
        assert [got[q, r] for r in (1, 2, 3, 4)] == [(i, d) for d, i in order[:4]]
    assert topk.nearest_codes(rows, F.col("vec_id") % 50 == 0, code=topk.sign_code()).count() == 0


def test_empty_tables(spark, empty):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rule = crc_bucket(F.col("doc_id"), 5) == 0
    for df in (
        suffix.dedup_substrings(empty), substring.remove_passages(empty), simhash.near_duplicates(empty), simhash.near_duplicates(empty, lanes=1, radius=4), suffix_tree.score_documents(empty, rule), langid.identify(empty, rule),
        quality.classify(empty, labels), packing.pack_digests(empty, FILES), mixing.mix(empty), ann.nearest(none, F.col("vec_id") % 5 == 0), topk.nearest_codes(none, F.col("vec_id") % 5 == 0, code=topk.sign_code()),
    ):
        assert df.count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    shared = " ".join(word() for _ in range(90))
    rows = []
    for i in range(40):
        words = [word() for _ in range(60)]
        text = " ".join(words) if i % 4 else " ".join(words) + " " + shared + " " + word()
        rows.append((i, text, "en", "ab"[i % 2]))
    rows += [(50, rows[1][1], "en", "a"), (51, "junk!! " * 40, "en", "a"), (52, None, "en", "a"), (None, " ".join(word() for _ in range(50)), "en", "b")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(51, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        kept[name] = docs.collect()
        docs = spark.createDataFrame(kept[name], docs.schema)
    ids = lambda name: {r.doc_id for r in kept[name]}
    assert ids("quality") == {*range(40), 50, None}
    assert ids("near_dedup") == {*range(40), None}
    assert all((shared[:200] in r.text) is False for r in kept["substring_dedup"])
    assert ids("mixing") <= ids("substring_dedup") and len(ids("mixing")) > 25
    assert {r.doc_id for r in kept["packing"]} == ids("mixing")


@pytest.mark.parametrize("settings", [{}, {"head": 50, "often": 100}])
def test_suffix_tree_scores_by_definition(spark, settings):
    """Whole scores against plain dictionaries, with nearly everything broadcast and nearly everything joined; a context of
    12 occurrences among 100,000 tokens has a state, a repeated text of five words scores by contexts of four."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(500)), "en", "a") for i in range(200)]
    rows += [(1000 + i, "seldom seen pairs of words", "en", "a") for i in range(12)]
    rows += [(2000 + i, "seldom seen others", "en", "a") for i in range(12)]
    docs, rule = table(spark, rows), F.col("doc_id") % 7 == 2
    p, states, _ = suffix_tree_by_definition([t for i, t, *_ in rows if i % 7 != 2], 4, 10, 2)
    assert {len(c) for c in states} == {1, 2, 3, 4}
    got = {r.doc_id: r for r in suffix_tree.score_documents(docs, rule, **settings).collect()}
    for i, text, *_ in rows:
        words = [*text.split(), None]
        want = 0.0
        for at, w in enumerate(words):
            context = tuple(words[max(0, at - 4) : at])
            while context and context not in states:
                context = context[1:]
            want += math.log10(p(context, w))
        assert abs(got[i].score - want) < 1e-6
    assert got[1000].score - got[1000].base_score > 2


def test_unannotated_rows_teach_the_scorer(spark):
    """Nobody has annotated the kind of junk that only a heuristic labeller sees."""
    rng = random.Random(9)
    plain = lambda: " ".join(rng.choice(["a", "mild", "story", "went", "home"]) + rng.choice(["", ","]) for _ in range(40))
    rows = [(i, plain() if i % 3 == 0 else plain() + " you idiot " + plain() if i % 3 == 1 else " ".join(f"{w}***" for w in plain().split()), "en", "s") for i in range(150)]
    labels = spark.createDataFrame([(i, 1, i % 3) for i in range(60) if i % 3 < 2], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.keep for r in quality.classify(table(spark, rows), labels).collect()}
    assert sum(got[i] == (i % 3 == 0) for i in range(150)) >= 147


def test_annotation_is_one_vote_among_others():
    code = lambda *votes: quality._code(votes[:-1], votes[-1])
    model = quality.WeakLabels({code(-1, -1, -1, -1, -1, 0, 0): 500, code(0, 0, 0, 0, 0, 1, 1): 500, code(-1, -1, -1, -1, -1, 0, 1): 5}, 7)
    assert model.bad[code(-1, -1, -1, -1, -1, 0, 1)] != 0.01
    assert model.bad[code(-1, -1, -1, -1, -1, 0, 0)] > 0.99


def test_pipeline_removes_passages_of_51_words(spark):
    import corpus_pipeline as P

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    shared = " ".join(word() for _ in range(51))
    assert len(shared) < 400
    rows = [(i, " ".join([*(word() for _ in range(60)), *([shared] if i % 3 == 0 else []), *(word() for _ in range(60))]), "en", "a") for i in range(12)]
    got = {r.doc_id: r.text for r in P.substring_dedup(spark, table(spark, rows).select(P.COLUMNS), "").collect()}
    assert len(got) == 12 and not any(shared[20:-20] in t for t in got.values())
    assert all(got[i] == t for i, t, *_ in rows if i % 3)


def test_teaching_share_at_scale(spark):
    """A share of a billionth still is a share; a scorer that nobody taught is an error."""
    assert quality.hash_edge(2500 / 25e9) - quality.hash_edge(0.0) == int(1e-7 * 2**64)
    assert (quality.hash_edge(0.0), quality.hash_edge(1.0), quality.hash_edge(7.0)) == (-(2**63), 2**63 - 1, 2**63 - 1)
    docs = spark.createDataFrame([(f"some plain words number {i}", 0) for i in range(20)], "text string, vote int")
    with pytest.raises(RuntimeError, match="none of 20 rows"):
        quality.fit(docs, F.col("vote"), sample=0)


@pytest.mark.parametrize("settings", [{"rounds": 1}, {"rounds": 3, "head": 50, "often": 100}])
def test_suffix_tree_by_ranges_and_rounds(spark, monkeypatch, settings):
    """Many small ranges of keys and blocks of texts, and any number of rounds, give the scores of one range."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 500}" for _ in range(200)), "en", "a") for i in range(120)]
    rows += [(None, "w1 w2 w3", "en", "a"), (7, None, "en", "a"), (7, None, "en", "a")]
    docs, rule = table(spark, rows), F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False))
    scores = lambda **x: sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, round(r.base_score, 6), round(r.score, 6)) for r in suffix_tree.score_documents(docs, rule, **x).collect())
    want = scores()
    monkeypatch.setattr(suffix_tree, "_range_bits", lambda keys: 7)
    monkeypatch.setattr(suffix_tree, "_BATCH", 5000)
    monkeypatch.setattr(suffix_tree, "_CHUNK", 3000)
    assert scores(**settings) == want and len(want) == len(rows)


def test_tidy_tables_leave_no_shuffle_files(spark):
    """Once a tidy table is written, its shuffle files are gone without the driver's garbage collection, and the setting is as it was."""
    own, key = pathlib.Path(spark.conf.get("spark.local.dir")), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, held = set(own.rglob("shuffle_*.data")), spark.conf.get(key, None)
    kept = Scratch(spark, "tidy", tidy=True).save(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    for _ in range(100):
        if not set(own.rglob("shuffle_*.data")) - before:
            break
        time.sleep(0.1)
    assert not set(own.rglob("shuffle_*.data")) - before
    assert spark.conf.get(key, None) == held and kept.count() == 7


def test_passages_of_over_50_words_by_their_bytes(spark):
    """A passage of 51 to 80 words that two documents share is removed, whole and in both, if it has 400 bytes, and not if it
    has fewer; documents without one are left alone. Edges differ, so that only a space on each side is shared too."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    own = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for i in range(80):
        passage = own(rng.randint(51, 80)).encode()
        gone = len(passage) + 2 if len(passage) + 2 >= 400 else 0
        for j, (left, right) in enumerate((("A", "B"), ("C", "D"))):
            rows.append((2 * i + j, f"{own(90)}{left} {passage.decode()} {right}{own(90)}", "en", "a"))
            want[2 * i + j] = gone
    rows += [(1000 + i, own(250), "en", "a") for i in range(40)]
    want |= {1000 + i: 0 for i in range(40)}
    assert 20 < sum(x > 0 for x in want.values()) < 140
    assert {r.doc_id: r.n_removed for r in suffix.dedup_substrings(table(spark, rows), length=400).collect()} == want

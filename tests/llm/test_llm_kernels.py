"""The parts that run inside tasks, against plain definitions."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import ann, langid, packing, quality, repeats, simhash, substring, suffix, topk
from graphloom.llm.common import concat_ranges, merge_spans
from graphloom.llm.q_packing import FILES


def windows(seqs, n):
    return collections.Counter(tuple(s[i : i + n]) for s in seqs for i in range(len(s) - n + 1))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=120), st.integers(1, 12))
def test_shared_prefixes(symbols, length):
    text = np.array([*symbols, 0], np.uint16)
    count = windows([tuple(text)], length)
    want = {i for i in range(len(text) - length + 1) if count[tuple(text[i : i + length])] > 1}
    assert set(suffix.shared_prefixes(text, length).tolist()) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=40), min_size=1, max_size=4), st.integers(1, 8))
def test_relative_parse(seqs, length):
    text = np.array([x for s in seqs for x in (*s, 0)], np.int64)
    starts = np.cumsum([0, *(len(s) + 1 for s in seqs[:-1])])
    ends = starts + [len(s) for s in seqs]
    found = set(substring.parse(substring.match_lengths(text, 64), starts, ends, length).tolist())
    count = windows([tuple(s) for s in seqs], length)
    assert found == {int(a) + i for a, s in zip(starts, seqs) for i in range(len(s) - length + 1) if count[tuple(s[i : i + length])] > 1}


def test_segments_cover_every_window_once_and_equal_windows_share_anchors():
    rng = random.Random(1)
    base = [rng.randrange(1 << 62) for _ in range(6)]
    pieces = [np.array([rng.choice(base) for _ in range(rng.randint(0, 60))], np.uint64) for _ in range(20)]
    length, gram = 9, 3
    piece, lo, hi, h, _ = repeats.segments(pieces, length, gram)
    got = {(int(p), w): int(x) for p, a, b, x in zip(piece, lo, hi, h) for w in range(a, b + 1)}
    assert set(got) == {(i, w) for i, p in enumerate(pieces) for w in range(len(p) - length + 1)}
    by = collections.defaultdict(set)
    for (p, w), x in got.items():
        by[tuple(pieces[p][w : w + length].tolist())].add(x)
    assert all(len(v) == 1 for v in by.values())


def test_spans_and_ranges():
    lo, hi = merge_spans(np.array([5, 0, 2, 9]), np.array([7, 2, 4, 12]))
    assert lo.tolist() == [0, 5, 9] and hi.tolist() == [4, 7, 12]
    assert concat_ranges(np.array([3, 10]), np.array([2, 3])).tolist() == [3, 4, 10, 11, 12]


def slow_fingerprint(text, width):
    words = regex.findall(rb"[^\x20\x09-\x0D]+", text.lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [b"", b"  \n", b"A b", b"a b c d e", b"a\tb\x0bc  d e f a b c d e f", "É é ß x y z".encode()])
def test_fingerprint(text):
    assert int(simhash.fingerprint(text, 4)[0]) == slow_fingerprint(text, 4)


def test_blocks_never_miss_a_close_pair():
    rng = random.Random(2)
    for blocks in (5, 6, 7, 8):
        masks = simhash.block_masks(blocks, 4)
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 4):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)


def test_forest_joins_what_is_near():
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 1 << 12, 60, dtype=np.uint64))[:, None]
    node = np.arange(len(fps))
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in simhash.forest(node, fps, 2):
        for x, y in zip(a.tolist(), b.tolist()):
            assert bin(int(fps[x, 0] ^ fps[y, 0])).count("1") <= 2
            root[find(x)] = find(y)
    for i in range(len(fps)):
        for j in range(i):
            if bin(int(fps[i, 0] ^ fps[j, 0])).count("1") <= 2:
                assert find(i) == find(j)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), max_size=8), st.integers(0, 40))
def test_fullest(counts, room):
    sums = {0}
    for n, k in counts.items():
        sums = {s + n * i for s in sums for i in range(k + 1) if s + n * i <= room}
    got = packing.fullest(room, counts)
    assert sum(got) == max(sums) and all(got.count(n) <= counts[n] for n in got)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 50), max_size=12))
def test_plan_places_everything_once(counts):
    fill, placed = collections.defaultdict(list), collections.Counter()
    for n, lo, hi, copies, sequence, offset in packing.plan(counts, 30):
        for i in range(lo, hi):
            fill[sequence + (i - lo) // copies].append((offset + (i - lo) % copies * n, n))
            placed[n, i] += 1
    assert placed == {(n, i): 1 for n, c in counts.items() for i in range(c)}
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 30


def test_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    tokenizer, encode, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.Encoder(*FILES), random.Random(4)
    chars = [chr(i) for i in range(256)] + [" ", "a", "it's", "\n\n", "　", "日", "<|endoftext|>", "é"] * 5
    for _ in range(3000):
        text = "".join(rng.choice(chars) for _ in range(rng.randint(0, 25)))
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_collisions_find_most_and_verify_few():
    """10,000 vectors without any structure: recall of at least 0.9 and a tenth of the vectors verified at most."""
    x = np.random.default_rng(6).normal(size=(10_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[5000:5010] = x[0]
    own = np.arange(0, 10_000, 250)
    found = ann.Arrays(x, 128, 7).collide(x[own], own, 5, share=0.75, sigmas=1.0)
    s = x[own] @ x.T
    s[np.arange(len(own)), own] = -9
    hits = sum(len(set(np.argsort(-s[i])[:5].tolist()) & set(c.tolist())) for i, c in enumerate(found) if i)
    assert hits >= 0.9 * 5 * (len(own) - 1)
    assert set(range(5000, 5010)) <= set(found[0].tolist())  # equal vectors fall into every window
    assert sum(map(len, found)) <= 0.1 * len(x) * len(own)
    assert all(o not in c and len(set(c.tolist())) == len(c) for o, c in zip(own, found))


def test_multi_index_is_exact():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    codes[50:120] = codes[0]
    codes[120:200] = codes[1] ^ (np.uint64(1) << rng.integers(0, 64, 80).astype(np.uint64))
    queries, own = codes[[0, 1, 130, 300]], np.array([0, 1, 130, -1])
    for q, o, (rows, distance) in zip(queries, own, topk.multi_index(topk.MultiIndex(codes), queries, own, 10)):
        d = np.bitwise_count(codes ^ q).astype(int)
        ids = [i for i in np.lexsort((np.arange(400), d)) if i != o]
        got = sorted(zip(distance.tolist(), rows.tolist()))[:10]
        assert got == [(int(d[i]), int(i)) for i in ids[:10]]


def test_network_gradients_and_tables():
    net = langid.Network(["a", "b"], filters=3, size=4)
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, langid.CLASSES, (5, 20)), np.array([0, 1, 0, 1, 1])
    _, g = net.gradients(x, y)
    for k, p in net.p.items():
        i = tuple(0 for _ in p.shape) if k != "emb" else (int(x[0, 3]), 1)
        p[i] += 1e-5
        high, _ = net.gradients(x, y)
        p[i] -= 2e-5
        low, _ = net.gradients(x, y)
        p[i] += 1e-5
        assert abs(g[k][i] - (high - low) / 2e-5) < 1e-6
    w = rng.integers(0, langid.CLASSES, (4, langid.WINDOW))
    features = []
    for n in net.widths:
        r = sum(t[w[:, j : j + langid.WINDOW - n + 1]] for j, t in enumerate(net.tables(n)))
        features.append(r.max(axis=1) + net.p[f"b{n}"])
    z = np.maximum(np.concatenate(features, axis=1), 0) @ net.p["out"] + net.p["bias"]
    want = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert np.allclose(net.compiled().log_probabilities(w), want, atol=1e-4)


def test_weak_labels_find_the_good_labeller():
    rng, counts = random.Random(7), collections.Counter()
    for _ in range(4000):
        bad = rng.random() < 0.3
        votes = [(-1 if bad else 1) if rng.random() < acc else (1 if bad else -1) for acc in (0.95, 0.9, 0.85, 0.6)]
        votes = [v if rng.random() < 0.8 else 0 for v in votes]
        counts[quality._code(tuple(votes), 0)] += 1
    accuracy = quality.WeakLabels(counts, 5).accuracies()[:4]
    assert accuracy[0] > accuracy[3] + 0.15 and abs(accuracy[0] - 0.95) < 0.05


def test_crc_rule():
    assert zlib.crc32(b"") % 7 == 0

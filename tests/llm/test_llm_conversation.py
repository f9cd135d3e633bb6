"""Repair of conversations: the decoder against all edit sequences, settlement, odd tables."""

import hashlib
import itertools
import random

import pytest

from graphloom.llm.conversation import SPACE, Decoder, audits, damage, fault_of, repair

LEGAL = {"": 0, "s": 1, "u": 2, "a": 3}


def brute(rows):
    """(cost, audit, lines) of the best edit sequence, by trying all; rows: (role, text, fault)."""
    best = None

    def go(i, state, cost, audit, lines, room):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows) and state in ("", "a"):
            best = min(best, (cost, audit, lines)) if best else (cost, audit, lines)
        if room:
            for letter, name in (("u", "user"), ("a", "assistant")):
                if (letter == "a") == (state == "u"):
                    go(i, letter, cost + 3, audit + "I", lines + (f"{name}:",), room - 1)
        if i == len(rows):
            return
        role, text, fault = rows[i]
        go(i + 1, state, cost + 4, audit + "D", lines, 2)
        if fault in ("blank", "duplicate"):
            return
        extra = 3 if fault else 0
        for letter, name in (("u", "user"), ("a", "assistant")):
            if (letter == "a") == (state == "u"):
                go(i + 1, letter, cost + extra + 3, audit + "R", lines + (f"{name}:{text}",), 2)
        c = role[:1]
        if c == "s" and state == "" or c in ("u", "a") and (c == "a") == (state == "u"):
            go(i + 1, c, cost + extra, audit + "K", lines + (f"{role}:{text}",), 2)

    go(0, "", 0, "", (), 2)
    return best


def decoded(rows, settle=True):
    d, edits = Decoder(), []
    for role, text, fault in rows:
        d.step(role, text, None, fault)
        if settle:
            edits += d.settle()
    cost = d.finish()
    edits += d.settle()
    return cost, "".join(e for e, _ in edits), tuple(f"{r[1]}:{r[2]}" for e, r in edits if e != "D")


@pytest.mark.parametrize("seed", range(4))
def test_decoder_equals_all_sequences(seed):
    rng = random.Random(seed)
    for _ in range(150):
        rows = [
            (rng.choice(["system", "user", "assistant", " ", "", "tool", "sam"]), str(i), rng.choice([None] * 4 + ["blank", "duplicate", "truncated", "truncated"]))
            for i in range(rng.randrange(0, 7))
        ]
        want = brute(rows)
        assert decoded(rows) == want
        assert decoded(rows, settle=False) == want


def test_settles_as_it_goes():
    d, most, n = Decoder(), 0, 0
    rng = random.Random(5)
    for i in range(30_000):
        d.step(rng.choice(["user", "assistant", "system", "tool"]), str(i), i, rng.choice([None, None, "blank", "truncated"]))
        n += sum(1 for _ in d.settle())
        most = max(most, d.held())
    assert most < 60 and n > 29_900
    d, most = Decoder(), 0
    for i in range(5_000):  # only blank rows
        d.step("user", "", i, "blank")
        list(d.settle())
        most = max(most, d.held())
    assert most < 20


def plain(conversations):
    """The contract in plain Python: rows (conv_id, turn, role, text) already damaged, in the order of a list."""
    out = {}
    for key in {r[0] for r in conversations}:
        rows = sorted((r for r in conversations if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, told = set(), []
        for _, _, role, text in rows:
            told.append((role, text, fault_of(text, (role, text) not in seen)))
            seen.add((role, text))
        turns = {r[1] for r in rows if r[1] is not None}
        cost, audit, lines = brute(told)
        out[key] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(sum(f == k for *_, f in told) for k in ("blank", "duplicate", "truncated")),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(told)),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


ROWS = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 5, "user", "Cut off"),
    (2, None, None, None), (2, 0, "system", "Rules."), (2, 1, "user", "Q?"), (2, 2, "assistant", ""),
    (None, 3, "user", "No id."), (None, None, "assistant", "Turnless!"), (3, 0, "", " \t"), (4, 2, "user", "Ü" * 300_000 + "."),
    (5, 0, "system", "Only rules."), (6, 7, "user", "A."), (6, 7, "user", "B."), (6, 8, "user", "A."), (7, 0, "Übung", "x…"), (7, 1, "user", "x "),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def result(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in df.collect()}


def test_repair_equals_plain(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], SCHEMA + ", edit string, copies int")
    want = plain([(a, b, " " if c is None else c, " " if d is None else d) for a, b, c, d in ROWS])
    assert result(audits(repair(df.repartition(3)))) == want
    edits = repair(df, batch_rows=2).where("edit in ('K', 'R', 'I') and conv_id = 6").orderBy("seq").collect()
    assert [(r["role"], r["text"]) for r in edits] == [("user", "A."), ("assistant", "B.")]


def test_damage_and_lost_conversations(spark):
    from zlib import crc32

    rows = [(c, t, r, x) for c in range(160) for t, r, x in ((0, "user", "Why? Now."), (1, None, "So!"))[: 1 + (c < 40)]] + [(None, None, "user", "Lost.")]
    damaged = []
    for c, t, r, x in rows:
        kind = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = "user" if kind == 4 else " " if r is None else r, {1: "", 2: "".join(y for y in x if y not in ".!?")}.get(kind, x)
        damaged += [(c, t, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    want = plain(damaged)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want |= {c: nothing for c, *_ in rows if c not in want}
    assert nothing in want.values()
    assert result(audits(repair(*damage(spark.createDataFrame(rows, SCHEMA))))) == want


def test_empty_table(spark):
    assert audits(repair(*damage(spark.createDataFrame([], SCHEMA)))).collect() == []


def test_space_is_the_contracts():
    assert set(SPACE) == {chr(c) for c in (0x20, *range(0x09, 0x0E))}

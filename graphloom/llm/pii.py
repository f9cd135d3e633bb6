"""Personal data by a semi-Markov conditional random field over what the base patterns leave.

Base spans (mail addresses, IP addresses, cards, phone numbers) follow fixed patterns and always stay. The field looks at
islands of a text: stretches of digits and separators, and stretches around an at-sign or a word for one. An island is cut
into tokens; a segment of at most `MOST` tokens may be an entity of a kind, scored as a whole (digits and their groups,
separators, check sum, labels of a domain, brackets, neighbours, a word before it), and every other token is background. The
score of a segmentation is the sum over its entities; dynamic programming over token positions chooses boundaries and kinds
together. Its spans that touch no base span are added.

Weights are fitted to the conditional likelihood on windows around base spans and other islands, a bounded sample by hash
(`sample` windows a kind, twice as many without an entity). Base spans alone would teach the base patterns, so each is also
written in other ways (no country code, other separators, spelled-out signs), and spoilt (a wrong check sum, an octet too
large, a date) to teach what is none.

Nulls and odd rows: a null text is empty and has no span; null ids and repeated rows keep their rows; texts of any length are
read whole, in time linear in their length; a table without a base span teaches the rewritten forms of nothing, and the
field adds nothing; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Scratch, text_of

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Tokens, digits and groups of digits of the longest entity.
MOST, DIGITS, GROUPS = 26, 19, 8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_SIGNS = ("@", "\uff20", " at ", " AT ", "(at)", "[at]", "{at}", "(AT)", "[AT]", "{AT}", "( at )", "[ at ]", "{ at }")


def marked(text: str) -> bool:
    """False for a text that can't hold an entity."""
    return _DIGIT.search(text) is not None or any(x in text for x in _SIGNS)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping a kind, ordered by start and kind."""
    out, end = [], 0
    for m in _DOMAIN.finditer(text):  # the local part is what stands before the sign, back to the last match
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, EMAIL, m.end()))
            end = m.end()
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), IP, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), CARD, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((m.start(), PHONE, m.end()))
    return sorted(out)


_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.DOTALL)
_SEP = r"[\x20().\-/\u00A0\u2010-\u2015\[\]]"
_NUMBERS = re.compile(rf"[0-9]++(?:{_SEP}{{1,4}}+[0-9]++)*+")
_AT = re.compile(r"[@\uFF20]|[\[({]\x20?at\x20?[\])}]|(?<=\x20)at(?=\x20)", re.I)
_NAME_BEFORE = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?$")
_HOST_AFTER = re.compile(r"\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[({]\x20?(?:dot|\.)\x20?[\])}]|(?<=\x20)dot(?=\x20))\x20?[A-Za-z0-9-]{1,63}){1,8}", re.I)
_AT_IN = re.compile(r"[@\uFF20]|[\[({ ]at[\])} ]", re.I)
_DOT_IN = re.compile(r"\.|[\[({ ]dot[\])} ]", re.I)
_CUES = {
    "tel": PHONE, "telefon": PHONE, "téléphone": PHONE, "teléfono": PHONE, "phone": PHONE, "call": PHONE, "mobile": PHONE, "fax": PHONE,
    "card": CARD, "visa": CARD, "mastercard": CARD, "tarjeta": CARD, "carte": CARD, "karte": CARD,
    "ip": IP, "host": IP, "server": IP, "address": IP,
    "mail": EMAIL, "email": EMAIL, "contact": EMAIL, "correo": EMAIL, "courriel": EMAIL,
}
_BEFORE = re.compile(r"([^\W\d_]+)[\s:.#-]{0,3}$")
_FEATURES: dict[str, int] = {}


def _feature(name: str) -> int:
    return _FEATURES.setdefault(name, len(_FEATURES))


for _n in (
    "bias", "digits 4-6", "digits 7-8", "digits 9", "digits 10", "digits 11", "digits 12", "digits 13-14", "digits 15", "digits 16", "digits 17-19",
    "groups 1", "groups 2", "groups 3", "groups 4", "groups 5+", "four of four", "last of four", "groups to 3", "first of four", "octets", "octets too large", "sum right", "sum wrong",
    "plus", "double zero", "brackets", "brackets open", "separator none", "separator space", "separator dash", "separator dot", "separator slash", "separator other", "separators mixed", "separators wide", "square",
    "sign", "sign spelled", "labels 2", "labels 3", "labels 4+", "name last", "digits last", "one letter last", "dot spelled", "dot and space", "capital after dot", "space at sign", "word before sign", "digit before sign",
    "before mark", "before word", "before edge", "after mark", "after edge", "touches local", "more digits before", "more digits after", *(f"cue {k}" for k in KINDS),
):
    _feature(_n)


class Segment(NamedTuple):
    """Tokens [i, j) of an island, characters [start, end) of the text, the kinds it may be, its features."""

    i: int
    j: int
    start: int
    end: int
    kinds: tuple[int, ...]
    features: list[int]


def islands(text: str) -> list[tuple[int, int]]:
    """Stretches that may hold an entity: at least four digits with separators, or an at-sign with a name and a host."""
    found = []
    for m in _NUMBERS.finditer(text):
        if m.end() - m.start() >= 4 and sum("0" <= c <= "9" for c in m.group()) >= 4:
            start = m.start()
            while start and start > m.start() - 2 and text[start - 1] in "+([":
                start -= 1
            found.append((start, m.end()))
    for sign in _SIGNS:
        at = text.find(sign)
        while at >= 0:
            a, b = (at + 1, at + 3) if sign[0] == " " else (at, at + len(sign))
            before, after = _NAME_BEFORE.search(text[max(0, a - 66) : a]), _HOST_AFTER.match(text, b)
            if before and after:
                found.append((a - len(before.group()), after.end()))
            at = text.find(sign, b)
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(found):
        if out and lo < out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _numbers(text: str, tokens: list[tuple[int, int]], i: int, j: int, digits: str) -> list[int]:
    part = text[tokens[i][0] : tokens[j - 1][1]]
    groups = [text[a:b] for a, b in tokens[i:j] if "0" <= text[a] <= "9"]
    n, f = len(digits), _FEATURES
    size = "4-6" if n < 7 else "7-8" if n < 9 else str(n) if n < 13 else "13-14" if n < 15 else str(n) if n < 17 else "17-19"
    out = [f["bias"], f[f"digits {size}"], f[f"groups {len(groups)}" if len(groups) < 5 else "groups 5+"]]
    gaps = re.split("[0-9]+", part.lstrip("+([ "))[1:-1]
    kinds = {g.strip("()[]") or g for g in gaps}
    plain = {" ": "space", "-": "dash", ".": "dot", "/": "slash"}
    out.append(f["separators mixed"] if len(kinds) > 1 else f["separator " + (plain.get(next(iter(kinds)), "other") if kinds else "none")])
    tests = (
        (len(groups) == 4 and all(len(g) == 4 for g in groups), "four of four"),
        (len(groups[-1]) == 4, "last of four"),
        (len(groups[0]) == 4, "first of four"),
        (all(len(g) < 4 for g in groups), "groups to 3"),
        (part[0] == "+", "plus"),
        (digits.startswith("00"), "double zero"),
        ("(" in part and part.count("(") == part.count(")"), "brackets"),
        (part.count("(") != part.count(")") or part.count("[") != part.count("]"), "brackets open"),
        ("[" in part, "square"),
        (any(len(g.strip("()[]")) > 1 for g in gaps), "separators wide"),
    )
    out += [f[name] for test, name in tests if test]
    if len(groups) == 4:
        out.append(f["octets" if all(len(g) < 4 and int(g) < 256 for g in groups) else "octets too large"])
    if 12 <= n <= 19:
        out.append(f["sum right" if luhn(digits) else "sum wrong"])
    return out


def _address(text: str, start: int, end: int) -> list[int] | None:
    part, f = text[start:end], _FEATURES
    sign = _AT_IN.search(part)
    if not sign or not part[: sign.start()].strip() or not part[sign.end() :].strip():
        return None
    name, host = part[: sign.start()], part[sign.end() :]
    labels = [x.strip() for x in _DOT_IN.split(host)]
    if len(labels) < 2 or not all(labels) or any(" " in x for x in labels) or " " in name.strip() or _AT_IN.search(host):
        return None
    last = labels[-1]
    out = [f["bias"], f["sign" if sign.group() in "@\uff20" else "sign spelled"], f[f"labels {len(labels)}" if len(labels) < 4 else "labels 4+"]]
    tests = (
        (last.isalpha() and last.islower() and 2 <= len(last) <= 6, "name last"),
        (last.isdigit(), "digits last"),
        (len(last) == 1, "one letter last"),
        (re.search("(?i)dot", host) is not None, "dot spelled"),
        (re.search(r"\.\x20", host) is not None, "dot and space"),
        (last[:1].isupper() and not last.isupper(), "capital after dot"),
        (sign.group() == "@" and (name.endswith(" ") or host.startswith(" ")), "space at sign"),
        (name.strip().isalpha(), "word before sign"),
        (any(c.isdigit() or c in "._-" for c in name.strip()), "digit before sign"),
    )
    return out + [f[name] for test, name in tests if test]


def _around(text: str, start: int, end: int) -> list[int]:
    f = _FEATURES
    a, b = text[start - 1 : start], text[end : end + 1]
    out = [f["before edge" if not a or a.isspace() else "before mark"], f["after edge" if not b or b.isspace() else "after mark"]]
    if a and a in "._%+-@":
        out.append(f["touches local"])
    near = text[max(0, start - 3) : start].strip(" -.()/")
    if near and near[-1].isdigit():
        out.append(f["more digits before"])
    near = text[end : end + 3].strip(" -.()/")
    if near and near[0].isdigit():
        out.append(f["more digits after"])
    word = _BEFORE.search(text[max(0, start - 24) : start])
    if word:
        out.append(f["before word"])
        kind = _CUES.get(word.group(1).lower())
        if kind is not None:
            out.append(f[f"cue {KINDS[kind]}"])
    return out


def segments(text: str, lo: int, hi: int) -> tuple[int, list[Segment]]:
    """Number of tokens of an island and its candidate entities, at most MOST tokens and DIGITS digits each."""
    tokens = [m.span() for m in _TOKEN.finditer(text, lo, hi)]
    address = _AT.search(text, lo, hi) is not None
    out = []
    for i, (start, _) in enumerate(tokens):
        first = text[start]
        if start and text[start - 1].isalnum() or not (first.isalnum() or first in "+("):
            continue
        digits, groups = "", 0
        for j in range(i, min(len(tokens), i + MOST)):
            a, end = tokens[j]
            if "0" <= text[a] <= "9":
                digits, groups = digits + text[a : min(end, a + DIGITS + 1)], groups + 1
                if not address and (len(digits) > DIGITS or groups > GROUPS):
                    break
            elif not text[a].isalpha():
                continue
            if text[end : end + 1].isalnum():
                continue
            if not address:
                if len(digits) >= 4:
                    out.append(Segment(i, j + 1, start, end, (IP, CARD, PHONE), _numbers(text, tokens, i, j + 1, digits) + _around(text, start, end)))
            else:
                found = _address(text, start, end)
                if found:
                    out.append(Segment(i, j + 1, start, end, (EMAIL,), found + _around(text, start, end)))
    return len(tokens), out


def choose(n: int, found: list[Segment], weights: np.ndarray) -> list[tuple[Segment, int]]:
    """The segmentation of highest score; background stays where an entity adds nothing, of equal ones the first found."""
    ends: dict[int, list[tuple[int, float, Segment, int]]] = {}
    for s in found:
        scores = weights[:, s.features].sum(axis=1)
        kind = max(s.kinds, key=lambda k: scores[k])
        if scores[kind] > 0:
            ends.setdefault(s.j, []).append((s.i, float(scores[kind]), s, kind))
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, score, s, kind in ends.get(j, ()):
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (s, kind)
    out, j = [], n
    while j > 0:
        if back[j]:
            out.append(back[j])
            j = back[j][0].i
        else:
            j -= 1
    return out[::-1]


def _sum(x: list[float]) -> float:
    m = max(x)
    return m if m == -math.inf else m + math.log(sum(math.exp(v - m) for v in x))


def marginals(n: int, found: list[Segment], weights: np.ndarray) -> tuple[float, list[tuple[Segment, int, float]]]:
    """Log of the sum over all segmentations, and each (segment, kind) with its probability."""
    arcs = []
    for s in found:
        scores = weights[:, s.features].sum(axis=1)
        arcs.extend((s, k, float(scores[k])) for k in s.kinds)
    into, onto = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for arc in arcs:
        into[arc[0].j].append(arc)
        onto[arc[0].i].append(arc)
    ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        ahead[j] = _sum([ahead[j - 1], *(ahead[s.i] + score for s, _, score in into[j])])
    for i in range(n - 1, -1, -1):
        behind[i] = _sum([behind[i + 1], *(behind[s.j] + score for s, _, score in onto[i])])
    return ahead[n], [(s, k, math.exp(ahead[s.i] + score + behind[s.j] - ahead[n])) for s, k, score in arcs]


def rewritten(kind: int, text: str, rng: np.random.Generator) -> list[tuple[str, bool]]:
    """Other ways to write an entity, and spoilt ones that are none."""
    groups = re.findall("[0-9]+", text)
    digits = "".join(groups)
    pick = lambda *x: x[rng.integers(len(x))]
    if kind == EMAIL:
        name, host = text.split("@", 1)
        at, dot = pick(" at ", " [at] ", "(at)", "[at]", " (at) ", " @ ", "\uff20"), pick(".", ".", " dot ", "[.]", "(dot)")
        return [(name + at + host.replace(".", dot), True), (name + " at " + host.split(".")[0] + ". " + host.split(".")[-1].capitalize(), False)]
    if kind == IP:
        at = rng.integers(4)
        wrong = [g if i != at else str(256 + int(g)) for i, g in enumerate(groups)]
        return [(pick("[.]", "(.)", "-", " . ", "/").join(groups), True), (".".join(wrong), False), (".".join(groups[:3]), False)]
    if kind == CARD:
        by = pick(".", "/", "  ", "\u2011", " - ", "\u00a0")
        spoilt = digits[:-1] + str((int(digits[-1]) + 1 + int(rng.integers(9))) % 10)
        again = by.join(digits[i : i + 4] for i in range(0, len(digits), 4))
        return [(again, True), (spoilt, False), (again[:-1] + spoilt[-1], False), (digits[:9], False)]
    local = groups[1:] if len(groups) > 2 and len(groups[0]) < 4 else groups
    bare = pick("-", ".", " ").join(local)
    ways = [bare, f"({local[0]}) " + "-".join(local[1:]) if len(local) > 1 else bare, "00" + pick(" ", "-").join(groups), "-".join(groups)]
    a, b, c = int(rng.integers(1900, 2100)), int(rng.integers(1, 13)), int(rng.integers(1, 29))
    sep = pick("-", ".", "/")
    date = pick(f"{a}{sep}{b:02d}{sep}{c:02d}", f"{c:02d}{sep}{b:02d}{sep}{a}", f"{a}-{a + b}", f"{a}{b:02d}{c:02d}")
    return [(pick(*ways), True), (date, False), (digits[:6], False), (digits + digits + digits[:2], False)]


class Window(NamedTuple):
    text: str
    spans: list[tuple[int, int, int]]


def examples(windows: list[Window], seed: int = 7) -> list[tuple[int, list[Segment], set[tuple[int, int, int]]]]:
    """Islands with their segments and the (i, j, kind) that are entities, from windows as they are and rewritten."""
    rng, all_windows = np.random.default_rng(seed), []
    for w in windows:
        all_windows.append(w)
        if len(w.spans) == 1:
            start, kind, end = w.spans[0]
            for text, right in rewritten(kind, w.text[start:end], rng):
                found = w.text[:start] + text + w.text[end:]
                all_windows.append(Window(found, [(start, kind, start + len(text))] if right else base_spans(found)))
    out = []
    for w in all_windows:
        for lo, hi in islands(w.text):
            n, found = segments(w.text, lo, hi)
            gold = {(s.i, s.j, k) for s in found for a, k, b in w.spans if s.start == a and s.end == b and k in s.kinds}
            if found and len(gold) == sum(lo <= a < hi for a, _, _ in w.spans):
                out.append((n, found, gold))
    return out


def fit(windows: list[Window], epochs: int = 12, rate: float = 0.15, penalty: float = 1e-4, batch: int = 32, seed: int = 7) -> np.ndarray:
    """Weights (kind, feature) by Adam on the conditional log likelihood, steps falling to a tenth; all zero without windows."""
    found, rng = examples(windows, seed), np.random.default_rng(seed)
    weights = np.zeros((len(KINDS), len(_FEATURES)))
    mean, square, step = np.zeros_like(weights), np.zeros_like(weights), 0
    total = max(1, epochs * -(-len(found) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(found))
        for at in range(0, len(order), batch):
            gradient = -penalty * weights * batch
            for x in order[at : at + batch]:
                n, segs, gold = found[x]
                for s, k, p in marginals(n, segs, weights)[1]:
                    gradient[k, s.features] += ((s.i, s.j, k) in gold) - p
            step += 1
            mean = 0.9 * mean + 0.1 * gradient
            square = 0.99 * square + 0.01 * gradient**2
            move = (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
            weights += rate * (1 - 0.9 * step / total) * move
    return weights


def spans(text: str, weights: np.ndarray) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base) of base spans and of the field's that touch none, ordered by start and kind."""
    if not marked(text):
        return []
    base, taken = base_spans(text), []
    for a, _, b in base:
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    added, at = [], 0
    for lo, hi in islands(text):
        while at < len(taken) and taken[at][1] <= lo:
            at += 1
        pieces, k = [], at  # what the base spans leave of the island
        while k < len(taken) and taken[k][0] < hi:
            pieces.append((lo, taken[k][0]))
            lo, k = taken[k][1], k + 1
        for a, b in [*pieces, (lo, hi)]:
            if b - a >= 4:
                n, found = segments(text, a, b)
                added += [(s.start, kind, s.end, False) for s, kind in choose(n, found, weights)]
    return sorted([(*x, True) for x in base] + added)


def windows(docs: DataFrame, reach: int = 48) -> DataFrame:
    """kind (-1: none), text and spans of windows around each island of the texts, and their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, texts, found = [], [], []
            for text in batch.column(0).to_pylist():
                if not marked(text):
                    continue
                base = base_spans(text)
                at = 0
                for lo, hi in islands(text):
                    if hi - lo > 200:
                        continue
                    while at < len(base) and base[at][0] < lo - 200:
                        at += 1
                    near = []
                    for x in base[at:]:
                        if x[0] >= hi:
                            break
                        if x[2] > lo:
                            near.append(x)
                    lo, hi = min([lo, *(x[0] for x in near)]), max([hi, *(x[2] for x in near)])
                    a = max(0, lo - reach)
                    kinds.append(near[0][1] if len(near) == 1 else -1 if not near else 4)
                    texts.append(text[a : hi + reach])
                    found.append([v for s, k, e in near for v in (s - a, k, e - a)])
            if kinds:
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(texts), pa.array(found, pa.list_(pa.int32()))], ["kind", "text", "spans"])

    out = docs.select(text_of().alias("text")).mapInArrow(run, "kind int, text string, spans array<int>")
    return out.withColumn("h", F.xxhash64("text", "spans"))


def train(docs: DataFrame, sample: int = 400) -> np.ndarray:
    """Weights from at most `sample` different windows of each kind and twice as many without an entity, the least by hash."""
    scratch, taught = Scratch(docs.sparkSession, "pii"), []
    found = scratch.save(windows(docs), "windows")
    for kind in (-1, *range(len(KINDS))):
        most = sample * (2 if kind == -1 else 1)
        rows = found.where(F.col("kind") == kind).groupBy("h").agg(F.min(F.struct("text", "spans")).alias("w")).orderBy("h").limit(most)
        taught += [Window(r["w"]["text"], [tuple(r["w"]["spans"][i : i + 3]) for i in range(0, len(r["w"]["spans"]), 3)]) for r in rows.collect()]
    return fit(taught)


def find(docs: DataFrame, weights: np.ndarray, redact: bool = False) -> DataFrame:
    """doc_id and spans (start, kind as a number, end, base); with `redact` also the text with each span as its kind's name in
    brackets (of overlapping spans the first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            found, clean = [], []
            for text in batch.column(1).to_pylist():
                mine = spans(text, weights)
                found.append([{"start": a, "kind": k, "end": b, "base": x} for a, k, b, x in mine])
                if redact:
                    parts, at = [], 0
                    for a, k, b, _ in mine:
                        if a >= at:
                            parts += [text[at:a], f"[{KINDS[k].upper()}]"]
                            at = b
                    clean.append("".join([*parts, text[at:]]))
            columns = [batch.column(0), pa.array(found, of)] + [pa.array(clean, pa.string())] * redact
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "spans"] + ["redacted"] * redact)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, spans array<struct<start: bigint, kind: int, end: bigint, base: boolean>>" + ", redacted string" * redact
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)

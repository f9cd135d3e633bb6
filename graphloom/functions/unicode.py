"""Character entities and full case folding in Catalyst. The tables come from Python's own (html.entities, str.casefold)."""

from __future__ import annotations

import functools
import json
import sys
import zlib
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 256


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hashed(table: dict[str, str], buckets: int = BUCKETS) -> str:
    parts: list[dict[str, str]] = [{} for _ in range(buckets)]
    for key, value in table.items():
        parts[zlib.crc32(key.encode()) % buckets][key] = value
    return json.dumps(parts)


def find_in(table: str, key: Column, buckets: int = BUCKETS) -> Column:
    """Value of a key in a fixed table, as _hashed() makes it: the literal is an array of small maps, a lookup reads one."""
    maps = F.from_json(F.lit(table), "array<map<string,string>>")
    return F.try_element_at(F.get(maps, F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(buckets)).cast("int")), key)


@functools.cache
def _entities() -> tuple[str, str, int]:
    """All named entities; those that need no semicolon; the longest of these."""
    from html.entities import html5

    short = {k: v for k, v in html5.items() if not k.endswith(";")}
    return _hashed(html5), _hashed(short), max(map(len, short))


@functools.cache
def _windows_codes() -> str:
    """Numeric references from 128 to 159 mean the characters of Windows code page 1252, where it has one."""

    def of(n: int) -> str:
        try:
            return bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            return chr(n)

    return json.dumps({str(n): of(n) for n in range(0x80, 0xA0)} | {"0": "�", "13": "\r"})


def character(code: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _numeric(digits: Column, base: int) -> Column:
    plain = F.regexp_replace(digits, "^0+", "")
    short = F.length(plain) <= 7
    n = F.when(plain == "", 0).when(short, F.conv(plain, base, 10).cast("int"))
    known = F.try_element_at(F.from_json(F.lit(_windows_codes()), "map<string,string>"), n.cast("string"))
    lost = n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    none = n.between(1, 8) | (n == 11) | n.between(14, 31) | n.between(0x7F, 0x9F) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    return F.when(~short, "�").when(known.isNotNull(), known).when(lost, "�").when(none, "").otherwise(character(n))


def _named(name: Column) -> Column:
    """A name with or without its semicolon; else the longest entity without one that it starts with; else as it is."""
    whole, short, most = _entities()

    def prefix(k: Column) -> Column:
        return F.concat(find_in(short, F.substring(name, F.lit(1), k)), F.substring(name, k + 1, F.length(name)))

    known = F.transform(F.sequence(F.lit(most), F.lit(2), F.lit(-1)), lambda k: F.when(k < F.length(name), prefix(k)))
    return F.coalesce(find_in(whole, name), F.get(F.array_compact(known), F.lit(0)), F.concat(F.lit("&"), name))


def _reference(part: Column) -> Column:
    """The text after an ampersand, the reference at its start resolved."""

    def of(m: Column) -> Column:
        rest = F.substring(part, F.length(m) + 1, F.length(part))
        name = F.regexp_replace(m, ";$", "")
        hexadecimal = name.rlike("^#[xX]")
        number = F.when(hexadecimal, _numeric(F.substring(name, F.lit(3), F.length(name)), 16)).otherwise(_numeric(F.substring(name, F.lit(2), F.length(name)), 10))
        return F.when(m == "", F.concat(F.lit("&"), part)).otherwise(F.concat(F.when(m.startswith("#"), number).otherwise(_named(m)), rest))

    return bind(F.regexp_extract(part, r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)", 1), of)


def unescape(text: Column) -> Column:
    """All named and numeric character references, with or without a semicolon, as browsers read them. A text is split at
    its ampersands, so what one reference yields is not read again."""
    parts = F.transform(F.split(text, "&", -1), lambda p, i: F.when(i == 0, p).otherwise(_reference(p)))
    return F.when(F.contains(text, F.lit("&")), F.array_join(parts, "")).otherwise(text)


@functools.cache
def _folds() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters beyond ASCII that fold to one character, their folds, and those that fold to several."""
    one, several = [], []
    for n in range(128, sys.maxunicode + 1):
        if 0xD800 <= n <= 0xDFFF:
            continue
        folded = chr(n).casefold()
        if folded != chr(n):
            (one if len(folded) == 1 else several).append((chr(n), folded))
    return "".join(a for a, _ in one), "".join(b for _, b in one), tuple(several)


def _in_class(characters: Iterable[str], rare: int = 0x100) -> str:
    """A pattern's class of these characters. Those from `rare` on are looked through only for a character from there on: Java
    tries a class's members one by one."""
    codes = sorted(map(ord, characters))
    listed = lambda some: "".join(f"\\x{{{n:X}}}" for n in some)
    few, many = [n for n in codes if n < rare], [n for n in codes if n >= rare]
    return f"[{listed(few)}[\\x{{{rare:X}}}-\\x{{10FFFF}}&&[{listed(many)}]]]"


def casefold(text: Column) -> Column:
    """Full case folding. ASCII texts take one step; others have each character folded by the table, and those that fold to
    several characters only where a text has one."""
    old, new, several = _folds()
    table = F.from_json(F.lit(json.dumps(dict(several))), "map<string,string>")
    wide = _in_class(c for c, _ in several)
    found = F.split(text, f"(?<={wide})|(?={wide})", -1)
    spread = F.array_join(F.transform(found, lambda p: F.coalesce(F.when(F.length(p) == 1, F.try_element_at(table, p)), p)), "")
    whole = F.when(text.rlike(wide), spread).otherwise(text)
    ascii_only = F.octet_length(text) == F.char_length(text)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(whole, upper + old, upper.lower() + new))

"""XML in Catalyst: a text's events (tags, text, CDATA, comments) by one pattern, elements by name, mixed content in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.unicode import unescape

#: Comment, CDATA section, instruction or declaration, tag (its attribute values may hold `>`), text.
_EVENTS = r"""(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>]*+>|<(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^<]++|<"""
_NAME = r"^<(/?)(?:[^\s/>:]+:)?([^\s/>]+)"


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def normalized(xml: Column) -> Column:
    """The same elements and text, plainly: no attributes, prefixes, comments or instructions, CDATA as escaped text, an empty
    element as a start and an end tag. What is between tags then holds no `<` or `>`."""

    def event(e: Column) -> Column:
        section = _escaped(F.replace(F.substring(e, F.lit(10), F.length(e) - 12), F.lit("&"), F.lit("&amp;")))
        name = F.regexp_extract(e, _NAME, 2)
        end = F.regexp_extract(e, _NAME, 1)
        tag = F.concat(F.lit("<"), end, name, F.when(e.endswith("/>"), F.concat(F.lit("></"), name)).otherwise(F.lit("")), F.lit(">"))
        return F.when(e.startswith("<![CDATA["), section).when(e.startswith("<!") | e.startswith("<?"), "").when(F.length(e) == 1, _escaped(e)).when(e.startswith("<"), tag).otherwise(_escaped(e))

    return F.array_join(F.transform(F.regexp_extract_all(xml, F.lit(_EVENTS), F.lit(0)), event), "")


def element(xml: Column, *path: str) -> Column:
    """What the first element of a path of names holds, in a normalized text; null if there is none. Elements of one name are
    taken not to stand in each other."""
    for name in path:
        xml = F.get(elements(xml, name), F.lit(0))
    return xml


def elements(xml: Column, name: str) -> Column:
    """What each element of a name holds, in order."""
    return F.coalesce(F.regexp_extract_all(xml, F.lit(f"(?s)<{name}>(.*?)</{name}>"), F.lit(1)), F.array().cast("array<string>"))


def text_of(xml: Column) -> Column:
    """All text in a normalized element, nested elements' too, in order, with its references resolved."""
    return unescape(F.regexp_replace(F.coalesce(xml, F.lit("")), "<[^>]*>", ""))

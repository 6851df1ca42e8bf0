"""Scalar functions with exact text semantics, all on the JVM side."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

XML_SPACE = " \t\r\n"


def xml_strip(c: Column) -> Column:
    """Strip the four XML white-space characters and no others."""
    return F.btrim(c, F.lit(XML_SPACE))


def lexical_boolean(c: Column) -> Column:
    s = xml_strip(c)
    return F.when(s.isin("true", "1"), True).when(s.isin("false", "0"), False)


def lexical_integer(c: Column, low: int | None = None, high: int | None = None) -> Column:
    """An ASCII integer of at most 1000 characters that fits a long and the range, else NULL."""
    s = xml_strip(c)
    value = F.when(s.rlike(r"^[+-]?[0-9]+\z") & (F.length(s) <= 1000), s.try_cast("bigint"))
    if low is not None:
        value = F.when(value >= low, value)
    return F.when(value <= high, value) if high is not None else value


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def blank(c: Column) -> Column:
    """Nothing but Unicode white space (NULL counts as blank)."""
    return c.isNull() | ~c.rlike(r"[^\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{001C}-\x{001F}]")


def canonical_json(*columns: str) -> Column:
    """Compact JSON of the columns in name order, NULLs kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def json_text(c: Column) -> Column:
    """The JSON literal of a text; NULL stays NULL."""
    whole = F.to_json(F.array(c.cast("string")))
    return F.when(c.isNotNull(), F.substring(whole, F.lit(2), F.length(whole) - 2))


def json_object(**members: Column) -> Column:
    """Canonical JSON of members that are JSON texts already, by name; NULL becomes null."""
    parts = []
    for i, (name, value) in enumerate(sorted(members.items())):
        parts += [F.lit(("," if i else "{") + json.dumps(name) + ":"), F.coalesce(value, F.lit("null"))]
    return F.concat(*parts, F.lit("}"))


def json_list(items: Column) -> Column:
    """A JSON array of JSON texts; NULL stays NULL."""
    return F.when(items.isNotNull(), F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))


def json_members(m: Column) -> Column:
    """Canonical JSON of a map of JSON texts, by key."""
    pairs = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(json_text(e["key"]), F.lit(":"), F.coalesce(e["value"], F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def revision_label(location: Column, pattern: str) -> Column:
    """The first group of pattern in the URL-decoded base name of a location, NULL unless all of the name matches."""
    name = F.url_decode(F.replace(F.substring_index(location, "/", -1), F.lit("+"), F.lit("%2B")))
    found = F.regexp_extract(name, rf"^(?:{pattern})\z", 1)
    return F.when(found != "", found)

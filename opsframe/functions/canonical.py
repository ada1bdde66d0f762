"""Canonical JSON of whole records as column expressions: sorted keys, fixed separators, fixed spelling of values.

A VARIANT sorts the keys of an object at every depth and drops white space, but forgets how a number was written.  So
numbers travel through it as marked strings, already in canonical spelling, and the marks are taken off afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsframe.functions.keys import bound, escape_non_ascii, json_quoted, shortest_number

# Stand-ins for an escaped backslash and an escaped quote; JSON allows no raw control characters, so they are free.
_BACKSLASH, _QUOTE = "\x01", "\x02"
_TOKEN = r'"[^"]*"|-?[0-9][0-9eE.+-]*|-?Infinity|NaN|[^"0-9NI-]+|[\s\S]'
_PIECE = r'"[^"]*"|[^"]+'
_INTEGER = r"^-?(0|[1-9][0-9]*)$"
_DOUBLE = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
_UNNUMBERED = ["NaN", "Infinity", "-Infinity"]


def _hidden(text: Column) -> Column:
    """Text in which every quote begins or ends a string."""
    text = F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASH))
    return F.replace(text, F.lit('\\"'), F.lit(_QUOTE))


def _shown(text: Column) -> Column:
    text = F.replace(text, F.lit(_QUOTE), F.lit('\\"'))
    return F.replace(text, F.lit(_BACKSLASH), F.lit("\\\\"))


def _tokens(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _number(token: Column) -> Column:
    """A number as it is written back: whole numbers digit by digit, others as the shortest double."""
    whole = F.when(token == "-0", "0").otherwise(token)
    return (
        F.when(token.isin(*_UNNUMBERED), token)
        .when(token.rlike(_INTEGER), whole)
        .when(token.rlike(_DOUBLE), shortest_number(token.try_cast("double")))
    )


def _marked(token: Column) -> Column:
    return (
        F.when(token.startswith('"'), F.concat(F.lit('"s'), F.substring(token, 2, 1 << 30)))
        .when(token.rlike("^[0-9NI-]"), F.coalesce(F.concat(F.lit('"n'), _number(token), F.lit('"')), token))
        .otherwise(token)
    )


def is_json(text: Column) -> Column:
    """Whether ``text`` is one JSON value; NaN and the infinities count as numbers."""
    bare = F.array_join(F.transform(_tokens(_hidden(text), _TOKEN), lambda t: F.when(t.isin(*_UNNUMBERED), "0").otherwise(t)), "")
    checked = F.when(text.rlike("NaN|Infinity"), _shown(bare)).otherwise(text)
    return F.try_parse_json(checked).isNotNull()


def _spelled(string: Column, ascii_only: bool) -> Column:
    """A quoted and hidden string as Spark writes it, in the other spelling of control characters."""
    lower = string
    for code in ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F"):
        lower = F.replace(lower, F.lit(f"\\u00{code}"), F.lit(f"\\u00{code.lower()}"))
    shown = _shown(F.when(string.contains("\\u00"), lower).otherwise(string))
    return bound(shown, escape_non_ascii) if ascii_only else shown


def _unmarked(text: Column, ascii_only: bool, spaced: bool) -> Column:
    def piece(t: Column) -> Column:
        string = bound(F.concat(F.lit('"'), F.substring(t, 3, 1 << 30)), lambda x: _spelled(x, ascii_only))
        other = F.replace(F.replace(t, F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": ")) if spaced else t
        number = F.substring(t, F.lit(3), F.length(t) - 3)
        return F.when(t.startswith('"n'), number).when(t.startswith('"'), string).otherwise(other)

    return F.array_join(F.transform(_tokens(_hidden(text), _PIECE), piece), "")


def fields_of(text: Column) -> Column:
    """The marked top-level fields of a JSON object, for ``canonical_field`` and ``canonical_object``; null if it is none."""
    marked = _shown(F.array_join(F.transform(_tokens(_hidden(text), _TOKEN), _marked), ""))
    return F.when(is_json(text), F.try_variant_get(F.try_parse_json(marked), "$", "map<string,variant>"))


def canonical_field(fields: Column, name: str, ascii_only: bool = True, spaced: bool = False) -> Column:
    """Canonical text of one field, null if the object has none of that name."""
    key = f"s{name}"
    return bound(fields, lambda own: F.when(F.map_contains_key(own, key), _unmarked(F.to_json(own[key]), ascii_only, spaced)))


def canonical_object(
    fields: Column, without: list[str] | None = None, added: dict[str, Column] | None = None, ascii_only: bool = True, spaced: bool = False
) -> Column:
    """Canonical text of an object, fields left out or put in their place; ``added`` values are canonical text.

    Keys are in the order of their code points at the top level and of their UTF-16 units below.  An object
    with a key twice counts as no JSON, and halves of surrogate pairs are not kept.
    """
    added = added or {}
    gone = [f"s{n}" for n in [*(without or []), *added]]
    comma, colon = (", ", ": ") if spaced else (",", ":")

    def entry(own: Column, key: Column) -> Column:
        value = _unmarked(F.to_json(own[key]), ascii_only, spaced)
        for name, text in added.items():
            value = F.when(key == f"s{name}", text).otherwise(value)
        name = F.substring(key, 2, 1 << 30)
        quoted = bound(json_quoted(name), escape_non_ascii) if ascii_only else json_quoted(name)
        return F.concat(quoted, F.lit(colon), value)

    def text_of(own: Column) -> Column:
        keys = F.filter(F.map_keys(own), lambda k: ~k.isin(*gone)) if gone else F.map_keys(own)
        if added:
            keys = F.concat(keys, F.array(*[F.lit(f"s{n}") for n in added]))
        entries = F.transform(F.array_sort(keys), lambda key: entry(own, key))
        return F.concat(F.lit("{"), F.array_join(entries, comma), F.lit("}"))

    return bound(fields, text_of)


def canonical_json(text: Column, without: list[str] | None = None, ascii_only: bool = True, spaced: bool = False) -> Column:
    """Canonical text of a JSON object, null for anything else."""
    return canonical_object(fields_of(text), without, None, ascii_only, spaced)

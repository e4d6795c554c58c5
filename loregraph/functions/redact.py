"""Removal of names, contact data, amounts and dates from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loregraph.functions.keys import _col

CLIENT_PLACEHOLDER = "the gaming commission"
NAME_PLACEHOLDER = "[stakeholder]"

# The four patterns and their placeholders, in the order they apply.
# (?U) makes the word boundary and digit classes Unicode-aware in Java.
PATTERNS = {
    "email": (r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[email]"),
    "phone": (r"(?U)\b(\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "[phone]"),
    "amount": (r"(?U)\$[\d,]+(?:\.\d{2})?", "[amount]"),
    "date": (r"(?U)\b\d{1,2}/\d{1,2}/\d{2,4}\b", "[date]"),
}


def _literal_pattern(name: Column) -> Column:
    quoted = F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("(?iu)\\Q"), quoted, F.lit("\\E"))


def redact_name(text: Column | str, name: Column | str, placeholder: str) -> Column:
    """Replace every case-insensitive occurrence of ``name``; a missing name changes nothing."""
    text, name = _col(text), _col(name)
    literal = placeholder.replace("\\", "\\\\").replace("$", "\\$")  # no group references
    replaced = F.regexp_replace(text, _literal_pattern(name), F.lit(literal))
    return F.when(F.coalesce(name, F.lit("")) != "", replaced).otherwise(text)


def redact_client(text: Column | str, client: Column | str, placeholder: str = CLIENT_PLACEHOLDER) -> Column:
    return redact_name(text, client, placeholder)


def redact_names(text: Column | str, names: Column | str) -> Column:
    """Apply the names of an array column in order, each on the result of the one before.

    A pattern is compiled and run only for a name that may occur in the text as it then stands. The
    text is carried along in lower case for a plain search, which decides if text and name are
    ASCII; other texts and names, where letters may match more than their lower case, take the pattern.
    """
    listed = F.coalesce(_col(names), F.array().cast("array<string>"))

    def state(value: Column) -> Column:
        plain = F.octet_length(value) == F.length(value)
        return F.struct(value.alias("value"), F.lower(value).alias("low"), plain.alias("plain"))

    def step(acc: Column, name: Column) -> Column:
        searched = acc["plain"] & (F.octet_length(name) == F.length(name))
        absent = name.isNull() | (searched & ~F.contains(acc["low"], F.lower(name)))
        return F.when(F.coalesce(absent, F.lit(False)), acc).otherwise(state(redact_name(acc["value"], name, NAME_PLACEHOLDER)))

    return F.aggregate(listed, state(_col(text)), step, lambda acc: acc["value"])


def redact_pattern(text: Column | str, kind: str) -> Column:
    pattern, placeholder = PATTERNS[kind]
    return F.regexp_replace(_col(text), pattern, placeholder)


def redact(
    text: Column | str,
    client: Column | None = None,
    names: Column | None = None,
    placeholder: str = CLIENT_PLACEHOLDER,
) -> Column:
    """Client name, known names, then email, phone, amount and date; the order matters."""
    result = _col(text)
    if client is not None:
        result = redact_client(result, client, placeholder)
    if names is not None:
        result = redact_names(result, names)
    for kind in PATTERNS:
        result = redact_pattern(result, kind)
    return result

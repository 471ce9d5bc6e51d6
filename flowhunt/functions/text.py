"""DNS text features as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clean_query(query: Column) -> Column:
    """Strip trailing dots; an empty or missing name becomes NULL."""
    stripped = F.regexp_replace(query, r"\.+$", "")
    return F.when(stripped != "", stripped)


def query_length(query: Column, unit: str = "chars") -> Column:
    length = F.length(query) if unit == "chars" else F.octet_length(query)
    return F.coalesce(length, F.lit(0))


def subdomain_depth(query: Column) -> Column:
    """Number of dots in the name."""
    dots = F.length(query) - F.length(F.replace(query, F.lit("."), F.lit("")))
    return F.coalesce(dots, F.lit(0))


def shannon_entropy(text: Column, unit: str = "chars") -> Column:
    """Bits per character; 0 for empty or missing text.

    Each distinct character contributes once, with its count taken from how much shorter the text
    gets when that character is removed. ``unit="bytes"`` divides by the byte length, as the
    collector does.
    """
    chars = F.length(text)
    size = (chars if unit == "chars" else F.octet_length(text)).cast("double")

    def add_term(total: Column, char: Column) -> Column:
        share = (chars - F.length(F.replace(text, char, F.lit("")))) / size
        return total - share * F.log2(share)

    letters = F.array_distinct(F.split(text, ""))
    bits = F.aggregate(letters, F.lit(0.0), add_term)
    return F.when(chars > 0, bits).otherwise(F.lit(0.0))

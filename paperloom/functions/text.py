"""Text expressions shared by operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(name: Column) -> Column:
    """Lower-case letters and digits, white space as single hyphens, none at the ends."""
    bare = F.regexp_replace(F.lower(name), r"[^\p{L}\p{Nd}\-\s]", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\s+", "-"), "^-+|-+$", "")


def trigrams(text: Column) -> Column:
    """All runs of three characters, lower-cased."""
    low = F.lower(text)
    return F.when(F.length(low) >= 3, F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substr(low, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def excerpt(text: Column, most: int = 500) -> Column:
    """At most ``most`` characters, cut at the last space if that is past the middle."""
    head = F.substring(text, 1, most)
    at = F.length(head) - F.instr(F.reverse(head), " ")
    return F.when(F.length(text) <= most, text).when((F.instr(head, " ") > 0) & (at > most // 2), F.substr(head, F.lit(1), at)).otherwise(head)

"""Tokens and edit variants as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of letters a-z and digits, in order, duplicates kept. Null gives an empty list."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), F.array().cast("array<string>"))


def shorter(term: Column) -> Column:
    """The strings that lack one character of a term."""
    return F.transform(F.sequence(F.lit(1), F.length(term)), lambda i: F.concat(F.substring(term, F.lit(1), i - 1), F.substring(term, i + 1, F.length(term))))


def deletions(term: Column) -> Column:
    """The term and what is left of it after one or two deletions.

    Two words within two edits of each other have such a string in common, so an equi-join on it finds all such pairs.
    """
    one = F.when(F.length(term) > 0, shorter(term)).otherwise(F.array().cast("array<string>"))
    two = F.flatten(F.transform(one, lambda x: F.when(F.length(x) > 0, shorter(x)).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(F.array(term), one, two))


def ngrams(sequence: Column, n: int) -> Column:
    """All runs of n items of an array. Give a column, not an expression: a lambda would work an expression out again for each item."""
    runs = F.transform(F.sequence(F.lit(0), F.size(sequence) - n), lambda i: F.array(*(F.get(sequence, i + k) for k in range(n))))
    return F.when(F.size(sequence) >= n, runs).otherwise(F.array().cast("array<array<string>>"))

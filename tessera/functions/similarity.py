"""Pair similarities as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence over code points, by bit-parallel rows in one integer."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """2 * LCS / (|a| + |b|); two empty texts are equal."""
    whole = len(a) + len(b)
    return 2 * common_subsequence(a, b) / whole if whole else 1.0


def ratios(left: pd.Series, right: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(left, right, strict=True):
        if pair not in known:
            known[pair] = 1.0 if pair[0] == pair[1] else indel_ratio(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype=float)


def fuzzy_ratio(a: Column, b: Column) -> Column:
    return F.pandas_udf(ratios, "double")(a, b)


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def unit(vector: Column) -> Column:
    """The vector as doubles at length one; null for a null, zero or partly null one. Made once per row, before pairs."""
    v = F.transform(vector, lambda x: x.cast("double"))
    size = F.sqrt(_dot(v, v))
    return F.when(size > 0, F.transform(v, lambda x: x / size))


def unit_cosine(a: Column, b: Column) -> Column:
    """Cosine of two unit vectors, 0 for a null one; negative values count as 0."""
    return F.coalesce(F.greatest(_dot(a, b), F.lit(0.0)), F.lit(0.0))


def hashed_embedding(text: Column, width: int = 64) -> Column:
    """An offline stand-in for sentence embeddings: counts of character trigrams, hashed to `width` places."""
    padded = F.concat(F.lit("  "), F.lower(text), F.lit("  "))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.pmod(F.xxhash64(F.substring(padded, i, F.lit(3))), F.lit(width)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.size(F.filter(grams, lambda g: g == k)).cast("double"))

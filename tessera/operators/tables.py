"""Small relational operators: sampling, ordinals, prefixes, set operations, as-of and upsert."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.staging import fresh, with_position


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").alias(prefix + c) for c in df.columns))


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renamed columns first, in the order of names, then the others."""
    return df.select(*(F.col(f"`{a}`").alias(b) for a, b in names.items()), *(F.col(f"`{c}`") for c in df.columns if c not in names))


def sampled(df: DataFrame, n: int, seed: int | None = None, where: str | None = None) -> DataFrame:
    """n rows after the filter: at random, or with a seed those of the smallest row hashes, which is repeatable."""
    df = df.where(where) if where else df
    return df.orderBy(F.rand() if seed is None else F.xxhash64(F.lit(seed), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))).limit(n)


def union_sources(named: dict[str, DataFrame], column: str | None = None) -> DataFrame:
    """UNION ALL by name; with column, each row's source as the first column."""
    parts = [df if column is None else df.select(F.lit(name).alias(column), "*") for name, df in named.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def without_ordinals(df: DataFrame, order: list[str], ordinals: list[int]) -> DataFrame:
    """df without the rows at these 0-based places of the order; places that don't exist are passed over."""
    place = fresh("_place", df.columns)
    placed = with_position(df, [F.col(c).asc_nulls_last() for c in order], place)
    return placed.where(~F.col(place).isin([int(o) for o in ordinals])).select(*(F.col(f"`{c}`") for c in df.columns))


def page(df: DataFrame, order: list[Column | str], number: int, size: int = 100) -> DataFrame:
    """The number-th page of a sorted grid, from 0."""
    return df.orderBy(*order).offset(number * size).limit(size)


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str, out: str) -> DataFrame:
    """left with the value of the last right row of the same key at or before its time: union and a running last value."""
    side, seen = fresh("_side", left.columns), fresh("_value", left.columns)
    both = left.withColumn(side, F.lit(1)).withColumn(seen, F.lit(None).cast(right.schema[value].dataType))
    other = right.select(*(F.col(c) if c in (key, time) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), F.lit(0).alias(side), F.col(value).alias(seen))
    w = Window.partitionBy(key).orderBy(time, side).rowsBetween(Window.unboundedPreceding, 0)
    return both.unionByName(other).withColumn(out, F.last(seen, True).over(w)).where(F.col(side) == 1).drop(side, seen)


def upserted(rows: DataFrame, key: list[str], sequence: str) -> DataFrame:
    """The last row of each key by sequence."""
    rest = [c for c in rows.columns if c not in key]
    last = fresh("_row", rows.columns)
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), sequence).alias(last)).select(*key, f"{last}.*")


def extrapolated_cost(test_cost: float, test_rows: int, full: DataFrame) -> float:
    """The cost of all rows, in proportion to a test run's."""
    return full.count() / test_rows * test_cost if test_rows else 0.0

"""Intermediate tables in the session's shared folder, global positions without a single-task window."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def staging_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a local folder in local mode (tests) and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/tessera-{spark.sparkContext.applicationId}"
    return found.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder; columns of nulls alone become text."""
    untyped = [f.name for f in df.schema if isinstance(f.dataType, T.NullType)]
    df = df.withColumns({c: F.col(f"`{c}`").cast("string") for c in untyped}) if untyped else df
    path = f"{staging_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The session's settings with those of wanted, put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def fresh(wanted: str, columns: list[str]) -> str:
    """wanted, or with a number behind it the first name that no column has."""
    taken, name, n = {c.lower() for c in columns}, wanted, 0
    while name.lower() in taken:
        n += 1
        name = f"{wanted}_{n}"
    return name


def with_position(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its 0-based place in the given order, as a long, in a last column of that name.

    A range sort numbers rows inside each partition; the partitions' sizes (one row each) give the offsets. Columns of df
    keep their values, whatever their names.
    """
    spark = df.sparkSession
    at, part, before = (fresh(n, [*df.columns, name]) for n in ("_at", "_part", "_before"))
    marked = staged(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()))
    number = F.shiftright(at, 33)
    sizes = sorted((r[0], r[1]) for r in marked.groupBy(number.alias("p")).count().collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    lookup = spark.createDataFrame(offsets, f"{part} long, {before} long")
    numbered = marked.withColumn(part, number).join(F.broadcast(lookup), part)
    place = F.col(before) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.select(*(F.col(f"`{c}`") for c in df.columns), place.alias(name))

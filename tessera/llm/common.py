"""Helpers that the operators of this subpackage share: columns, shared folders, tables that cut lineage."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts of the word operators name it: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, local mode (tests) takes one of
    its own; on a cluster that is an error, as executors would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: While a table is written: its shuffle files go when it is done, and batches sent to Python are bounded by their bytes.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives the loss of executors, frees the shuffle files behind it."""
    spark, path = df.sparkSession, table_path(df.sparkSession, name)
    with _settings(spark, _WRITING):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files behind a table of written(), once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Ids that a table may have to be broadcast: at 16 to 24 bytes each, under 100 MB in an executor.
BROADCAST_IDS = 4_000_000


def by_ids(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """df semi- or anti-joined on doc_id with ids, a written table of one long column doc_id; rows with a null doc_id match nothing.

    Up to BROADCAST_IDS ids are broadcast, so that df, which may hold whole texts, isn't shuffled; beyond that both
    sides are shuffled.
    """
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, df["doc_id"].cast("long") == ids["doc_id"], how)


def few(table: DataFrame) -> DataFrame:
    """A written table of digests, to be broadcast if its rows, some 100 bytes each, are few enough for that."""
    return F.broadcast(table) if table.limit(BROADCAST_IDS // 4 + 1).count() <= BROADCAST_IDS // 4 else table


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def give_back() -> None:
    """Returns freed memory to the system: Python workers are reused, and what one task took would stay with them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


#: What tasks leave in their Python worker for later ones of the same kind: name to a function that drops it and tells whether there was any.
LEFT_BEHIND: dict[str, Callable[[], bool]] = {}


def only(name: str) -> None:
    """Drops what tasks of other kinds left in this worker; Spark gives a worker tasks of every stage and run."""
    if any([drop() for other, drop in LEFT_BEHIND.items() if other != name]):
        gc.collect()
        give_back()


def map_rows(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str, chunk: int = 256, leaves: str = "") -> DataFrame:
    """mapInArrow over tuples: rows gets an iterator over the partition's tuples and yields tuples in the order of schema.

    Input is turned into Python values chunk rows at a time and output is sent chunk rows at a time, so a task holds
    a few hundred rows whatever its partition's size. leaves: the name in LEFT_BEHIND of what the task may keep.
    """
    names = df.columns
    spark = df.sparkSession
    out = pa.schema([(f.name, _arrow_type(f.dataType)) for f in spark.createDataFrame([], schema).schema.fields])

    def source(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                yield from zip(*(part.column(i).to_pylist() for i in range(len(names))), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(leaves)
        kept: list[tuple] = []
        for row in rows(source(batches)):
            kept.append(row)
            if len(kept) >= chunk:
                yield _batch(kept, out)
                kept = []
        if kept:
            yield _batch(kept, out)
        give_back()

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)

"""Tables of a session: CSV files, names, listing, materialisation, export."""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.staging import staged

#: Words that a normalised column name must not be.
RESERVED = "all and as asc between by case cast create cross desc distinct drop else end exists false for from full group having in inner insert intersect into is join left like limit not null offset on or order outer right select set table then true union unique using values when where with".split()


def normalised_names(names: list[str]) -> list[str]:
    """Lower case, blanks to _, other marks dropped, _ before digits and reserved words, repeats numbered."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        plain = re.sub(r"[^a-z0-9_]", "", re.sub(r"\s+", "_", name.strip().lower()))
        if not plain or plain[0].isdigit() or plain in RESERVED:
            plain = "_" + plain
        while plain in seen:
            seen[plain] += 1
            plain = f"{plain}_{seen[plain]}"
        seen[plain] = 0
        out.append(plain)
    return out


def safe_name(spark: SparkSession, wanted: str) -> str:
    """An identifier made of wanted that no table or view of the session has."""
    base = re.sub(r"\W+", "_", wanted)
    base = base if re.match(r"[A-Za-z_]", base) else "_" + base
    taken, name, n = {t.name.lower() for t in spark.catalog.listTables()}, base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def load_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> tuple[str, DataFrame]:
    """The file as a view named after it, with normalised column names; types are inferred unless a schema is given."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    df = df.toDF(*normalised_names(df.columns))
    name = safe_name(spark, os.path.basename(path.rstrip("/")).split(".")[0])
    df.createOrReplaceTempView(name)
    return name, df


def ingest(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Loads files by suffix: csv, parquet, json and orc become views; anything else is a document path."""
    found = {}
    for path in paths:
        kind = path.rsplit(".", 1)[-1].lower()
        if kind == "csv":
            found[path] = load_csv(spark, path)[0]
        elif kind in ("parquet", "json", "orc"):
            found[path] = safe_name(spark, os.path.basename(path).split(".")[0])
            spark.read.format(kind).load(path).createOrReplaceTempView(found[path])
        else:
            found[path] = path
    return found


def materialise(df: DataFrame, name: str, temporary: bool = True) -> str:
    """df's rows as they are now: a view over a table in the shared folder, or a saved table."""
    if temporary:
        staged(df).createOrReplaceTempView(name)
    else:
        df.write.mode("overwrite").saveAsTable(name)
    return name


def list_tables(spark: SparkSession, names: list[str] | None = None) -> list[dict]:
    """Name, columns with types, and row count of the tables and views of the session, or of those named; one job counts them all."""
    names = [t.name for t in spark.catalog.listTables()] if names is None else names
    if not names:
        return []
    counts = reduce(DataFrame.unionAll, [spark.table(n).agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n") for k, n in enumerate(names)])
    found = {r.k: r.n for r in counts.collect()}
    return [{"name": n, "columns": spark.table(n).dtypes, "row_count": found[k]} for k, n in enumerate(names)]


def export_csv(df: DataFrame, path: str, single: bool = True) -> str:
    path = path if path.lower().endswith(".csv") else path + ".csv"
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_markdown(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """One Markdown file per document below folder, written by Spark as text partitions named after the document."""
    from tessera.sources.documents import full_text

    texts = full_text(pages, "\n\n").select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("stem"), F.col("text").alias("value"))
    texts.write.mode("overwrite").partitionBy("stem").text(folder)
    return texts

"""llm(): a prompt column to an answer column, with usage and a prompt cache as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.providers import OfflineProvider, Provider

WORKERS = 8


def ask_all(prompts: list[str | None], ask: Callable[[str], str], workers: int = WORKERS) -> list[str | None]:
    """Answers in order: each distinct prompt is asked once, several at a time; null prompts and failed calls give null."""
    distinct = list(dict.fromkeys(p for p in prompts if p is not None))

    def safe(prompt: str) -> str | None:
        try:
            return ask(prompt)
        except Exception:  # noqa: BLE001  a failed call is a null answer, by contract
            return None

    with ThreadPoolExecutor(max(1, workers)) as pool:
        answers = dict(zip(distinct, pool.map(safe, distinct), strict=True))
    return [None if p is None else answers[p] for p in prompts]


def llm_function(provider: Provider | None = None, workers: int = WORKERS):
    """The pandas UDF behind llm(prompt)."""
    provider = provider or OfflineProvider()

    @F.pandas_udf("string")
    def llm(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield pd.Series(ask_all([None if pd.isna(p) else p for p in prompts], lambda p: provider.text(provider.fitted(p)), workers), dtype=object)

    return llm if isinstance(provider, OfflineProvider) else llm.asNondeterministic()


def llm(prompt: Column, provider: Provider | None = None) -> Column:
    return llm_function(provider)(prompt)


def register(spark: SparkSession, provider: Provider | None = None) -> None:
    """Makes llm(prompt) known to SQL. It stands in SELECT, WHERE, GROUP BY and ORDER BY; project it first for joins and aggregates unless the provider is offline."""
    spark.udf.register("llm", llm_function(provider))


def with_usage(answered: DataFrame, prompt: str, answer: str, provider: Provider | None = None) -> DataFrame:
    """Adds input_tokens, output_tokens, total_tokens and cost, by columns alone (four characters a token)."""
    provider = provider or OfflineProvider()
    tokens = [F.ceil(F.length(F.coalesce(F.col(c), F.lit(""))) / 4.0).cast("long") for c in (prompt, answer)]
    out = answered.withColumns({"input_tokens": tokens[0], "output_tokens": tokens[1]})
    return out.withColumns({"total_tokens": F.col("input_tokens") + F.col("output_tokens"), "cost": F.col("input_tokens") * provider.input_price + F.col("output_tokens") * provider.output_price})


def cached_answers(prompts: DataFrame, prompt: str, path: str, provider: Provider | None = None) -> DataFrame:
    """prompts with `answer`: known ones come from the Parquet cache at path, the others are asked once and appended."""
    provider, spark = provider or OfflineProvider(), prompts.sparkSession
    key = F.sha2(F.concat_ws("\0", F.lit(type(provider).__name__), F.lit(provider.model), F.col(prompt)), 256)
    keyed = prompts.withColumn("prompt_key", key)
    try:
        known = spark.read.schema("prompt_key string, answer string").parquet(path)
        known.limit(0).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise  # a cache that can't be read is an error, not an empty one
        known = spark.createDataFrame([], "prompt_key string, answer string")
    missing = keyed.where(F.col(prompt).isNotNull()).select("prompt_key", prompt).dropDuplicates(["prompt_key"]).join(known, "prompt_key", "left_anti")
    missing.select("prompt_key", llm_function(provider)(F.col(prompt)).alias("answer")).where("answer is not null").write.mode("append").parquet(path)
    return keyed.join(spark.read.parquet(path).dropDuplicates(["prompt_key"]), "prompt_key", "left").drop("prompt_key")

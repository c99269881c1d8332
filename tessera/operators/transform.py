"""Table to table: a model turns the rows of a source into rows of a declared schema."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.providers import OfflineProvider, Provider
from tessera.functions.schema import TableSchema, parse_schema


def llm_table_to_table(source: DataFrame, schema: str | TableSchema, instruction: str = "", options: dict | str | None = None, provider: Provider | None = None) -> DataFrame:
    """Rows that the provider makes of source, typed by the schema; null for values that are missing.

    The whole source is one prompt, as a model must see it together; a prompt over the token limit is an error, never
    cut. options (a dict or its JSON text): {"rows_per_call": n} splits the source into calls of n rows each, run in
    parallel, where rows can be turned on their own; "partition_by": column makes a call of each value's rows.
    """
    provider, spec = provider or OfflineProvider(), parse_schema(schema) if isinstance(schema, str) else schema
    options = json.loads(options) if isinstance(options, str) else options or {}
    wanted = spec.table_json_schema()

    def answer(rows: list[str]) -> list[str]:
        prompt = json.dumps({"task": "transform", "instruction": instruction, "rows": [json.loads(r) for r in rows]})
        if provider.count_tokens(prompt) > provider.token_limit:
            raise ValueError("the source exceeds the token limit of one call; set rows_per_call or partition_by")
        return [json.dumps(r) for r in provider.structured(prompt, wanted)["rows"]]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        held: list[str] = []
        at = None
        for batch in batches:
            for group, row in zip(batch["_group"], batch["_row"], strict=True):
                if held and (group != at or size and len(held) >= size):
                    yield pd.DataFrame({"_out": answer(held)})
                    held = []
                at = group
                held.append(row)
        if held:
            yield pd.DataFrame({"_out": answer(held)})

    size = int(options.get("rows_per_call", 0))
    group = F.col(options["partition_by"]).cast("string") if options.get("partition_by") else F.lit("")
    rows = source.select(F.coalesce(group, F.lit("")).alias("_group"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("_row"))
    if options.get("partition_by"):
        rows = rows.repartition("_group").sortWithinPartitions("_group")
    elif not size:
        rows = rows.coalesce(1)
    parsed = rows.mapInPandas(run, "_out string").select(F.from_json("_out", _nullable(spec.struct)).alias("r")).select("r.*")
    return parsed


def _nullable(struct: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in struct])


def pattern_warnings(rows: DataFrame, spec: TableSchema) -> DataFrame:
    """The rows that break a column's pattern, with the columns' names in `violations`."""
    return rows.withColumn("violations", spec.violations()).where(F.size("violations") > 0)

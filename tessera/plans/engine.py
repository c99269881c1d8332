"""The SQL front end: statements with model table functions, run one after the other over a Spark session.

A call such as llm_join('t', 'left', 'right', '3: name fuzzy_match', 'task') is turned into a lazy DataFrame, registered as
a view and spliced into the statement as its name, so Catalyst plans it together with the rest. Sources given as SQL text
go through the same front end, so calls nest. A statement can read what earlier ones made.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import compat, llm
from tessera.functions.providers import OfflineProvider, Provider
from tessera.functions.schema import parse_schema
from tessera.operators.smart_join import DEFAULT_K, llm_join, llm_join_test
from tessera.operators.transform import llm_table_to_table
from tessera.plans import sql_text
from tessera.plans.progress import Progress, Task
from tessera.sources.documents import Parser, annotated, llm_pdf_to_table, plain_pages, read_pages, require_readable
from tessera.sources.tables import list_tables, load_csv, materialise, safe_name

#: Builds the rows of a table function from the engine, the call's literals, its options and the list of warnings.
TableFunction = Callable[["Engine", list[str], dict, list[str]], DataFrame]
__all__ = ["DEFAULT_K", "Engine", "Result", "annotated"]


@dataclass
class Result:
    """The last statement's rows (lazy) and warnings on the way."""

    df: DataFrame | None
    warnings: list[str] = field(default_factory=list)


class Engine:
    """One Spark session's tables, functions and provider. parser turns document bytes into page texts."""

    def __init__(self, spark: SparkSession, provider: Provider | None = None, parser: Parser = plain_pages, readable_only: bool = True):
        self.spark, self.provider, self.parser, self.readable_only = spark, provider or OfflineProvider(), parser, readable_only
        self._made: dict[tuple, str] = {}
        self.table_functions: dict[str, TableFunction] = {name: getattr(Engine, "_" + name) for name in ("llm_pdf_to_table", "llm_table_to_table", "llm_join", "llm_join_test")}
        llm.register(spark, self.provider)
        compat.register(spark)

    def sql(self, text: str, progress: Progress | None = None) -> Result:
        """Runs every statement in order; the result is the last one's."""
        parts = sql_text.statements(text)
        warnings: list[str] = []
        last = None
        self._made.clear()  # sources may be others by now
        if progress:
            progress.expect(len(parts))
        for part in parts:
            last = self._statement(part, warnings)
            if progress:
                progress.step()
        return Result(last, warnings)

    def register_table_function(self, name: str, build: TableFunction) -> None:
        """Makes build(engine, arguments, options, warnings) the rows of name(...) after FROM and JOIN; arguments are literals."""
        self.table_functions[name.lower()] = build

    def register_function(self, name: str, function) -> None:
        """Makes a (pandas) UDF or a Python function known to SQL."""
        self.spark.udf.register(name, function)

    def submit(self, text: str, kind: str = "EDITOR") -> Task:
        """The same in the background; the task can be cancelled."""
        return Task(self.spark, lambda: self.sql(text).df, kind, text)

    def load_csv(self, path: str) -> str:
        return load_csv(self.spark, path)[0]

    def tables(self) -> list[dict]:
        return list_tables(self.spark)

    def batch_documents(self, table: str, schema: str, paths: list[str], instruction: str = "", with_source: bool = True, replace: bool = True) -> DataFrame:
        """One table from many documents: one distributed extraction, the file's name as source_pdf if wanted."""
        if not replace and self.spark.catalog.tableExists(table):
            return self.spark.table(table)
        pages = self._pages(paths[0])
        for path in paths[1:]:
            pages = pages.unionByName(self._pages(path))
        rows = llm_pdf_to_table(pages, schema, instruction, self.provider, with_path=True)
        name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
        rows = rows.select(*([name.alias("source_pdf")] if with_source else []), *[c for c in rows.columns if c != "path"])
        materialise(rows, table, temporary=False)
        return self.spark.table(table)

    def _pages(self, path: str) -> DataFrame:
        pages = read_pages(self.spark, path, self.parser)
        return require_readable(pages) if self.readable_only else pages

    def _statement(self, text: str, warnings: list[str]) -> DataFrame:
        made = sql_text.creation(text)
        if made:
            if made.if_missing and self.spark.catalog.tableExists(made.name):
                return self.spark.table(made.name)
            if not (made.replace or made.temporary or made.if_missing) and self.spark.catalog.tableExists(made.name):
                raise ValueError(f"table {made.name} exists")
            materialise(self._statement(made.query, warnings), made.name, made.temporary)
            self._made.clear()
            return self.spark.table(made.name)
        for call in sql_text.calls(text, self.table_functions):
            text = text[: call.start] + self._view(call, warnings) + text[call.end :]
        return self.spark.sql(sql_text.translated(text))

    def _view(self, call: sql_text.Call, warnings: list[str]) -> str:
        """The view of a call; one that the script made before, with all its arguments, keeps its view until a table is created."""
        options = self._options(call)
        key = (call.name, *call.arguments)
        if key in self._made and not options.get("force_recreate") and self.spark.catalog.tableExists(self._made[key]):
            return self._made[key]
        df = self.table_functions[call.name](self, call.arguments, options, warnings)
        name = safe_name(self.spark, call.arguments[0] if call.name == "llm_join" and len(call.arguments) == 5 else f"{call.name}_{uuid.uuid4().hex[:8]}")
        df.createOrReplaceTempView(name)
        self._made[key] = name
        return name

    @staticmethod
    def _options(call: sql_text.Call) -> dict:
        """The JSON object among the arguments from the third on, if there is one."""
        for a in call.arguments[2:] if call.name not in ("llm_join", "llm_join_test") else []:
            if a.lstrip().startswith("{"):
                return json.loads(a)
        return {}

    def _source(self, text: str, warnings: list[str]) -> DataFrame:
        """A table's name or a query, which may hold calls itself."""
        try:
            return self.spark.table(text.strip()) if re.fullmatch(r"\s*[\w.]+\s*", text) else self._statement(text, warnings)
        except Exception as e:
            raise ValueError(f"source can't be read: {str(e)[:300]}") from e

    def _llm_pdf_to_table(self, a: list[str], options: dict, warnings: list[str]) -> DataFrame:
        self._count("llm_pdf_to_table", a, 2, 4)
        spec = parse_schema(a[1])
        if spec.patterns:
            warnings.append("columns with patterns: " + ", ".join(spec.patterns))
        return llm_pdf_to_table(self._pages(a[0]), spec, self._instruction(a[2:]), self.provider)

    def _llm_table_to_table(self, a: list[str], options: dict, warnings: list[str]) -> DataFrame:
        self._count("llm_table_to_table", a, 2, 4)
        return llm_table_to_table(self._source(a[0], warnings), a[1], self._instruction(a[2:]), options, self.provider)

    def _llm_join(self, a: list[str], options: dict, warnings: list[str]) -> DataFrame:
        self._count("llm_join", a, 4, 5)
        left, right, algorithm, task = a[-4:]
        return llm_join(self._source(left, warnings), self._source(right, warnings), algorithm, task, self.provider, check=True)

    def _llm_join_test(self, a: list[str], options: dict, warnings: list[str]) -> DataFrame:
        self._count("llm_join_test", a, 4, 6)
        n, mode = int(a[4]) if len(a) > 4 else 10, a[5] if len(a) > 5 else "dry"
        left = self._source(a[0], warnings)
        # A query that limits or filters itself isn't sampled at random but cut.
        words = {t.text.upper() for t in sql_text.tokens(a[0]) if t.kind == "word"}
        n = max(1, min(100, n))
        cut = left if "LIMIT" in words else left.limit(n) if "WHERE" in words else left.orderBy(F.rand()).limit(n)
        return llm_join_test(cut, self._source(a[1], warnings), a[2], a[3], mode, provider=self.provider, check=True)

    @staticmethod
    def _instruction(rest: list[str]) -> str:
        return next((r for r in rest if not r.lstrip().startswith("{")), "")

    @staticmethod
    def _count(name: str, a: list[str], least: int, most: int) -> None:
        if not least <= len(a) <= most:
            raise ValueError(f"{name} takes {least} to {most} arguments, got {len(a)}")

"""Documents as tables of pages, and the extraction of declared rows from them.

Pages are rows (path, page_no, text). Extraction is one lazy plan over all documents: outline, then relevant sections
and page ranges, chunks of pages, rows, exact duplicates, and a last look at each document's table. Each step is a call
per document, section or chunk inside mapInPandas; documents are spread by path, and a task holds one document.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.llm import ask_all
from tessera.functions.providers import OfflineProvider, Provider
from tessera.functions.schema import TableSchema, parse_schema

READABLE_CHARS = 500  # a page, on average

Parser = Callable[[bytes], list[str]]


class UnreadableDocument(ValueError):
    """A document with too little text for its number of pages; it needs character recognition first."""


def plain_pages(content: bytes) -> list[str]:
    """The default parser: UTF-8 text, pages divided by form feeds."""
    return content.decode("utf-8", "replace").split("\f")


def read_pages(spark: SparkSession, path: str, parser: Parser = plain_pages) -> DataFrame:
    """path, page_no (from 1), text of every document below path; parser turns a file's bytes into page texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                texts = parser(bytes(content))
                yield pd.DataFrame({"path": name, "page_no": range(1, len(texts) + 1), "text": texts})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, page_no int, text string")


def readability(pages: DataFrame) -> DataFrame:
    """path, n_pages, n_chars (page breaks count one each), readable: at least 500 characters a page."""
    found = pages.groupBy("path").agg(F.count("*").alias("n_pages"), (F.sum(F.length(F.coalesce("text", F.lit("")))) + F.count("*") - 1).alias("n_chars"))
    return found.withColumn("readable", F.col("n_chars") >= READABLE_CHARS * F.col("n_pages"))


def require_readable(pages: DataFrame) -> DataFrame:
    bad = [r.path for r in readability(pages).where(~F.col("readable")).select("path").limit(5).collect()]
    if bad:
        raise UnreadableDocument(f"too little text: {', '.join(bad)}")
    return pages


def full_text(pages: DataFrame, delimiter: str = "\n") -> DataFrame:
    """path, text: a document's pages in order."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return pages.groupBy("path").agg(F.array_join(F.transform(ordered, lambda p: F.coalesce(p["text"], F.lit(""))), delimiter).alias("text"))


def annotated(pages: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """path, text: the pages from start to end (1-based, inclusive; all if not given), each between page marks."""
    part = pages
    if start:
        part = part.where(F.col("page_no") >= start)
    if end:
        part = part.where(F.col("page_no") <= end)
    marked = part.select("path", "page_no", F.concat(F.format_string("[START OF PAGE %d]\n", "page_no"), F.coalesce("text", F.lit("")), F.format_string("\n[END OF PAGE %d]", "page_no")).alias("text"))
    return full_text(marked)


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    """A Markdown table with the 0-based row number first; bars in cells are escaped, line ends become <br>."""

    def cell(value: object) -> str:
        return "" if value is None else "<br>".join(str(value).replace("|", "\\|").splitlines())

    lines = ["| |" + "|".join(map(cell, columns)) + "|", "|" + "---|" * (len(columns) + 1)]
    lines += [f"|{k}|" + "|".join(cell(r.get(c)) for c in columns) + "|" for k, r in enumerate(rows)]
    return "\n".join(lines)


def _object(**kinds: object) -> dict:
    return {"type": "object", "properties": kinds, "required": list(kinds), "additionalProperties": False}


_TEXT, _WHOLE = {"type": "string"}, {"type": "integer"}


def _list(of: dict) -> dict:
    return {"type": "array", "items": of}


def step_schema(step: str) -> dict:
    """The JSON schema of a step's answer."""
    body = {
        "outline": _object(document_outline=_TEXT, document_sections=_list(_object(id=_TEXT, title=_TEXT, description=_TEXT))),
        "relevant": _object(section_ids=_list(_TEXT)),
        "locate": _object(ranges=_list(_object(section_id=_TEXT, start_page=_WHOLE, end_page=_WHOLE))),
        "chunk": _object(chunks=_list(_object(expectation=_TEXT, start_page=_WHOLE, end_page=_WHOLE))),
        "prune": _object(rows_to_remove=_list(_WHOLE)),
    }[step]
    return {"name": step, "strict": True, "schema": body}


def llm_pdf_to_table(pages: DataFrame, schema: str | TableSchema, instruction: str = "", provider: Provider | None = None, with_path: bool = False) -> DataFrame:
    """The rows of the declared schema that the documents hold; with_path adds the document's path first.

    Sections without a page range and chunks without rows are passed over, duplicates inside a document are dropped
    before the last look, and row numbers that it names but that don't exist are ignored. Without any row the result is
    empty, with the declared columns.
    """
    provider, spec = provider or OfflineProvider(), parse_schema(schema) if isinstance(schema, str) else schema
    described = spec.row_object()
    columns = list(described["properties"])

    def asked(step: str, wanted: dict, **about: object) -> dict:
        return provider.structured(json.dumps({"task": step, "instruction": instruction, "columns": described["properties"], **about}), wanted)

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, raw in zip(batch["path"], batch["pages"], strict=True):
                pages_ = [{"page_no": int(p["page_no"]), "text": p["text"] or ""} for p in raw]
                outline = asked("outline", step_schema("outline"), document="\n\n".join(p["text"] for p in pages_))
                sections = outline["document_sections"]
                wanted = set(asked("relevant", step_schema("relevant"), outline=outline["document_outline"], sections=sections)["section_ids"])
                ranges: dict[str, dict] = {}
                for r in asked("locate", step_schema("locate"), sections=sections, pages=pages_)["ranges"]:
                    ranges.setdefault(r["section_id"], r)
                chunks = []
                for s in sections:
                    r = ranges.get(s["id"])
                    if s["id"] in wanted and r:
                        text = "\n".join(p["text"] for p in pages_ if r["start_page"] <= p["page_no"] <= r["end_page"])
                        chunks += asked("chunk", step_schema("chunk"), section=s, start_page=r["start_page"], end_page=r["end_page"], text=text)["chunks"]
                spans = dict.fromkeys((c["start_page"], c["end_page"], c["expectation"]) for c in chunks)
                yield pd.DataFrame([(path, k, e, "\n".join(p["text"] for p in pages_ if a <= p["page_no"] <= b)) for k, (a, b, e) in enumerate(spans)], columns=["path", "chunk", "expectation", "text"])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prompts = [json.dumps({"task": "rows", "instruction": instruction, "expectation": e, "text": t}) for e, t in zip(batch["expectation"], batch["text"], strict=True)]
            answers = ask_all(prompts, lambda p: json.dumps(provider.structured(p, spec.table_json_schema())["rows"]))
            out = [(p, c, k, json.dumps(r, sort_keys=True)) for p, c, a in zip(batch["path"], batch["chunk"], answers, strict=True) for k, r in enumerate(json.loads(a or "[]"))]
            yield pd.DataFrame(out, columns=["path", "chunk", "place", "row"])

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, found in zip(batch["path"], batch["rows"], strict=True):
                made = [json.loads(r["row"]) for r in found]
                gone = set(asked("prune", step_schema("prune"), table=markdown_table(made, columns))["rows_to_remove"])
                yield pd.DataFrame([(path, json.dumps(r)) for k, r in enumerate(made) if k not in gone], columns=["path", "row"])

    documents = pages.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("pages"))
    chunks = documents.mapInPandas(plan, "path string, chunk int, expectation string, text string")
    made = chunks.repartition("path", "chunk").mapInPandas(rows, "path string, chunk int, place int, row string")
    distinct = made.groupBy("path", "row").agg(F.min(F.struct("chunk", "place")).alias("at"))
    tables = distinct.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "row"))).alias("rows"))
    kept = tables.mapInPandas(prune, "path string, row string")
    out = kept.select("path", F.from_json("row", spec.struct).alias("r"))
    return out.select(*(["path"] if with_path else []), "r.*")

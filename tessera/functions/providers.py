"""Language-model providers: picklable, made on executors, offline and deterministic by default.

Prompts of structured calls are JSON texts with a `task`, so that the deterministic provider can answer each by a rule.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import time
import urllib.request
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

CHARS_PER_TOKEN = 4


@dataclass(frozen=True)
class Usage:
    """Tokens and cost of calls; adds up."""

    input_tokens: int = 0
    output_tokens: int = 0
    cost: float = 0.0

    @property
    def total_tokens(self) -> int:
        return self.input_tokens + self.output_tokens

    def __add__(self, other: Usage) -> Usage:
        return Usage(self.input_tokens + other.input_tokens, self.output_tokens + other.output_tokens, self.cost + other.cost)


@dataclass(frozen=True)
class Provider:
    """Base: counts tokens, cuts prompts to the limit, prices calls. Subclasses answer."""

    model: str = "offline"
    token_limit: int = 128_000
    input_price: float = 0.0
    output_price: float = 0.0

    def text(self, prompt: str, images: tuple[bytes, ...] = ()) -> str:
        raise NotImplementedError

    def structured(self, prompt: str, schema: dict, images: tuple[bytes, ...] = ()) -> dict:
        raise NotImplementedError

    def count_tokens(self, text: str) -> int:
        """About four characters a token, rounded up."""
        return -(-len(text) // CHARS_PER_TOKEN)

    def fitted(self, prompt: str) -> str:
        return prompt if self.count_tokens(prompt) <= self.token_limit else prompt[: self.token_limit * CHARS_PER_TOKEN]

    def usage(self, prompt: str, answer: str) -> Usage:
        i, o = self.count_tokens(prompt), self.count_tokens(answer)
        return Usage(i, o, i * self.input_price + o * self.output_price)


@dataclass(frozen=True)
class OfflineProvider(Provider):
    """Answers by closed rules: text calls give a label from the prompt's digest, structured calls follow their task."""

    labels: tuple[str, ...] = ("positive", "neutral", "negative")
    accept: float = 0.5

    def text(self, prompt: str, images: tuple[bytes, ...] = ()) -> str:
        return self.labels[int(hashlib.md5(prompt.encode()).hexdigest()[:4], 16) % len(self.labels)]

    def structured(self, prompt: str, schema: dict, images: tuple[bytes, ...] = ()) -> dict:
        asked = json.loads(prompt)
        return getattr(self, "_" + asked["task"])(asked, schema)

    def _choose(self, asked: dict, schema: dict) -> dict:
        best = asked["candidates"][0]["combined_score"] if asked["candidates"] else 0.0
        return {"selected_candidate": 1 if best >= self.accept else None, "confidence": best}

    def _outline(self, asked: dict, schema: dict) -> dict:
        """A section for each heading of the Markdown, or one for all of it."""
        titles = re.findall(r"^#+\s+(.+)$", asked["document"], re.MULTILINE) or ["document"]
        return {"document_outline": "; ".join(titles), "document_sections": [{"id": f"section_{k}", "title": t, "description": t} for k, t in enumerate(titles, 1)]}

    def _relevant(self, asked: dict, schema: dict) -> dict:
        return {"section_ids": [s["id"] for s in asked["sections"]]}

    def _locate(self, asked: dict, schema: dict) -> dict:
        pages, found = asked["pages"], []
        for s in asked["sections"]:
            at = [p["page_no"] for p in pages if s["title"] in p["text"]]
            found.append({"section_id": s["id"], "start_page": at[0] if at else pages[0]["page_no"], "end_page": pages[-1]["page_no"]})
        for one, after in zip(found, found[1:], strict=False):
            one["end_page"] = max(one["start_page"], min(one["end_page"], after["start_page"]))
        return {"ranges": found}

    def _chunk(self, asked: dict, schema: dict) -> dict:
        return {"chunks": [{"expectation": "rows", "start_page": p, "end_page": p} for p in range(asked["start_page"], asked["end_page"] + 1)]}

    def _rows(self, asked: dict, schema: dict) -> dict:
        """A row for each block of `column: value` lines; a column that comes again begins the next row."""
        columns = schema["schema"]["properties"]["rows"]["items"]["properties"]
        rows: list[dict] = []
        for key, value in re.findall(r"^\s*(\w+)\s*:\s*(.*?)\s*$", asked["text"], re.MULTILINE):
            if key in columns:
                if not rows or key in rows[-1]:
                    rows.append({})
                rows[-1][key] = _typed(value, columns[key]["type"])
        return {"rows": [{c: r.get(c) for c in columns} for r in rows]}

    def _prune(self, asked: dict, schema: dict) -> dict:
        """Rows without any value."""
        lines = asked["table"].splitlines()[2:]
        return {"rows_to_remove": [k for k, line in enumerate(lines) if not "".join(line.split("|")[2:]).strip()]}

    def _transform(self, asked: dict, schema: dict) -> dict:
        """Columns of the same name, passed through; others null."""
        columns = schema["schema"]["properties"]["rows"]["items"]["properties"]
        return {"rows": [{c: _typed(r.get(c), d["type"]) for c, d in columns.items()} for r in asked["rows"]]}


def _typed(value: object, kind: str) -> object:
    if value is None:
        return None
    try:
        if kind == "integer":
            return int(float(value))
        if kind == "number":
            return float(value)
    except (TypeError, ValueError):
        return None
    if kind == "boolean":
        return str(value).lower() in ("true", "1", "yes")
    return value if isinstance(value, str) else json.dumps(value)


@dataclass(frozen=True)
class HttpProvider(Provider):
    """Any service with the widespread chat-completions protocol. The key is read from the environment of executors only."""

    url: str = "https://localhost/v1/chat/completions"
    key_variable: str = "LLM_API_KEY"
    system: str = "Answer exactly what is asked, without comment."
    timeout: float = 120.0

    def _ask(self, prompt: str, more: dict, images: tuple[bytes, ...] = ()) -> str:
        content: object = self.fitted(prompt)
        if images:
            content = [{"type": "text", "text": content}, *({"type": "image_url", "image_url": {"url": "data:image/png;base64," + base64.b64encode(i).decode()}} for i in images)]
        body = {"model": self.model, "messages": [{"role": "system", "content": self.system}, {"role": "user", "content": content}], **more}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(self.key_variable, '')}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"]

    def text(self, prompt: str, images: tuple[bytes, ...] = ()) -> str:
        return self._ask(prompt, {}, images)

    def structured(self, prompt: str, schema: dict, images: tuple[bytes, ...] = ()) -> dict:
        if self.count_tokens(prompt) > self.token_limit:
            raise ValueError("the prompt exceeds the token limit; structured prompts aren't cut")
        return json.loads(self._ask(prompt, {"response_format": {"type": "json_schema", "json_schema": schema}}, images))


def _write(folder: str, name: str, value: object) -> None:
    """value as the JSON file name of folder, whole or not at all: written beside it and moved."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    path = f"{base}/{name}.json"
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(json.dumps(value).encode())
    system.move(part, path)


def _read(folder: str, name: str) -> object | None:
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    path = f"{base}/{name}.json"
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(path) as source:
        return json.loads(source.read())


@dataclass(frozen=True)
class RecordingProvider(Provider):
    """Answers of inner, kept as one file per call in a folder that driver and executors share (a URI).

    mode: replay asks inner for what isn't kept yet and keeps it; record asks anew and keeps; only raises KeyError for
    what isn't kept. A call is known by its provider, model, whole prompt, schema and images.
    """

    inner: Provider = field(default_factory=OfflineProvider)
    folder: str = ""
    mode: str = "replay"

    def __post_init__(self) -> None:
        if self.mode not in ("replay", "record", "only"):
            raise ValueError(f"mode {self.mode!r} is none of replay, record, only")

    def key(self, prompt: str, schema: dict | None = None, images: tuple[bytes, ...] = ()) -> str:
        whole = json.dumps([type(self.inner).__name__, self.inner.model, prompt, schema, [hashlib.sha256(i).hexdigest() for i in images]], sort_keys=True)
        return hashlib.sha256(whole.encode()).hexdigest()

    def _recall(self, key: str, ask: Callable[[], object]) -> object:
        name = f"{key[:2]}/{key}"
        kept = None if self.mode == "record" else _read(self.folder, name)
        if kept is None:
            if self.mode == "only":
                raise KeyError("no recorded answer for this call")
            kept = {"answer": ask()}
            _write(self.folder, name, kept)
        return kept["answer"]

    def text(self, prompt: str, images: tuple[bytes, ...] = ()) -> str:
        return self._recall(self.key(prompt, None, images), lambda: self.inner.text(prompt, images))

    def structured(self, prompt: str, schema: dict, images: tuple[bytes, ...] = ()) -> dict:
        return self._recall(self.key(prompt, schema, images), lambda: self.inner.structured(prompt, schema, images))


@dataclass(frozen=True)
class LoggingProvider(Provider):
    """inner, with every call and its outcome as a file of its own in a shared folder: interactions() reads them."""

    inner: Provider = field(default_factory=OfflineProvider)
    folder: str = ""

    def _logged(self, kind: str, prompt: str, ask: Callable[[], object]) -> object:
        began, answer, error = time.time(), None, None
        try:
            answer = ask()
            return answer
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            raise
        finally:
            said = "" if answer is None else answer if isinstance(answer, str) else json.dumps(answer)
            used = self.inner.usage(prompt, said)
            entry = {"time": began, "seconds": time.time() - began, "model": self.inner.model, "kind": kind, "prompt": prompt, "answer": said, "error": error}
            _write(self.folder, uuid.uuid4().hex, entry | {"input_tokens": used.input_tokens, "output_tokens": used.output_tokens, "cost": used.cost})

    def text(self, prompt: str, images: tuple[bytes, ...] = ()) -> str:
        return self._logged("text", prompt, lambda: self.inner.text(prompt, images))

    def structured(self, prompt: str, schema: dict, images: tuple[bytes, ...] = ()) -> dict:
        return self._logged("structured", prompt, lambda: self.inner.structured(prompt, schema, images))


def interactions(spark: SparkSession, folder: str) -> DataFrame:
    """The calls that a LoggingProvider noted, one row each; their sums are a query's usage."""
    kinds = "time double, seconds double, model string, kind string, prompt string, answer string, error string, input_tokens long, output_tokens long, cost double"
    return spark.read.schema(kinds).option("pathGlobFilter", "*.json").json(folder)

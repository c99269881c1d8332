"""Progress trees and running statements that can be cancelled."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Progress:
    """A node's share done: the weighted mean of its parts, or done over total (0 while the total is unknown)."""

    name: str = "task"
    weight: float = 1.0
    total: int = 0
    done: int = 0
    parts: list[Progress] = field(default_factory=list)
    parent: Progress | None = None
    told: Callable[[int], None] | None = None
    last: int = -1

    def part(self, name: str, weight: float = 1.0) -> Progress:
        self.parts.append(Progress(name, weight, parent=self))
        return self.parts[-1]

    def share(self) -> float:
        if self.parts:
            whole = sum(p.weight for p in self.parts)
            return sum(p.weight * p.share() for p in self.parts) / whole if whole else 0.0
        return min(self.done / self.total, 1.0) if self.total > 0 else 0.0

    def expect(self, total: int) -> None:
        if total < 0:
            raise ValueError("a total can't be negative")
        self.total = total
        self._tell()

    def step(self, n: int = 1) -> None:
        self.done += n
        self._tell()

    def _tell(self) -> None:
        top = self
        while top.parent:
            top = top.parent
        percent = int(100 * top.share())
        if top.told and percent != top.last:
            top.last = percent
            top.told(percent)


class Task:
    """A statement that runs under a job tag of its own, so that cancel() stops its Spark jobs."""

    _pool = ThreadPoolExecutor(4)

    def __init__(self, spark: SparkSession, run: Callable[[], DataFrame | None], kind: str = "EDITOR", summary: str = ""):
        self.id, self.kind = uuid.uuid4().hex, kind
        self.summary = summary if len(summary) <= 25 else summary[:25] + "..."
        self._spark, self._gone = spark, threading.Event()
        self.future: Future = self._pool.submit(self._run, run)

    def _run(self, run: Callable[[], DataFrame | None]) -> DataFrame | None:
        tag = f"tessera-{self.id}"
        self._spark.addTag(tag)
        try:
            return None if self._gone.is_set() else run()
        finally:
            self._spark.removeTag(tag)

    def cancel(self) -> None:
        self._gone.set()
        self.future.cancel()
        self._spark.interruptTag(f"tessera-{self.id}")

    def result(self, timeout: float | None = None) -> DataFrame | None:
        return self.future.result(timeout)

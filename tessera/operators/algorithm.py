"""The join algorithm's little language: `k: column mechanism [weight], column mechanism [weight], ...`."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

MECHANISMS = ("semantic_distance", "fuzzy_match", "exact_match", "arithmetic_asc", "arithmetic_desc", "numeric_distance")
TEXTUAL, NUMERIC = {"semantic_distance", "fuzzy_match"}, {"arithmetic_asc", "arithmetic_desc", "numeric_distance"}
GOLDEN = (1 + 5**0.5) / 2


@dataclass(frozen=True)
class Criterion:
    column: str
    mechanism: str
    weight: float


@dataclass(frozen=True)
class Algorithm:
    k: int
    criteria: tuple[Criterion, ...]

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys(c.column for c in self.criteria))

    def check(self, left: T.StructType, right: T.StructType) -> None:
        """Refuses columns that a side lacks, text mechanisms on other than text, numeric ones on other than numbers."""
        for c in self.criteria:
            for side, schema in (("left", left), ("right", right)):
                if c.column not in schema.names:
                    raise ValueError(f"column {c.column!r} is not in the {side} table")
                kind = schema[c.column].dataType
                if c.mechanism in TEXTUAL and not isinstance(kind, T.StringType | T.ArrayType) or c.mechanism in NUMERIC and not isinstance(kind, T.NumericType):
                    raise ValueError(f"{c.mechanism} doesn't fit {side} column {c.column!r} of type {kind.simpleString()}")


def parse_algorithm(text: str) -> Algorithm:
    """Weights that are left out fall by the golden ratio from criterion to criterion, beginning with 1."""
    head, colon, body = text.partition(":")
    if not colon or not head.strip().isdigit() or int(head) < 1:
        raise ValueError("an algorithm begins with the number of candidates, at least 1, and a colon")
    found = []
    for i, part in enumerate(body.split(",")):
        words = part.split()
        if len(words) not in (2, 3):
            raise ValueError(f"criterion {i + 1} must be: column mechanism [weight]")
        if words[1] not in MECHANISMS:
            raise ValueError(f"unknown mechanism {words[1]!r}; known: {', '.join(MECHANISMS)}")
        found.append(Criterion(words[0], words[1], float(words[2]) if len(words) == 3 else GOLDEN**-i))
    return Algorithm(int(head), tuple(found))

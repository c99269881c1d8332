"""Mixing sources to target weights: iterative proportional fitting over (source, language, topic) cells.

Token sums per cell are raked to target shares of source, language and topic in turn until every marginal agrees. A
document's weight is the share of tokens to keep times its cell's raked over actual tokens; it appears floor(weight)
times, and once more with the probability of the rest, decided by a hash of its doc_id, so the expected tokens of every
source, language and topic meet their targets. DataFrame functions only: one aggregation over the documents (partial
sums, so a source of a third of all rows is one row per task), sums over the cells, one join back by cell. Up to CELL_ROWS
cells are raked in one task, by windows; more are summed by partial aggregation and joined with their sums.
"""

from __future__ import annotations

import uuid
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, dropped, text_or_empty, written

DIMENSIONS = ("source", "lang", "topic")
ROUNDS_AT_ONCE, MAX_ROUNDS, TOLERANCE, CELL_ROWS = 5, 60, 1e-9, 100_000
#: Marks that tell a text's topic where documents have no such column, the first that occurs; else prose.
TOPIC_MARKS = [(" | ", "table"), ("!!", "promotion"), ("$$$", "noise"), ("@", "contact"), ("icense", "legal")]


def topic_of(text: Column) -> Column:
    found = F.lit("prose")
    for mark, name in reversed(TOPIC_MARKS):
        found = F.when(F.contains(text, F.lit(mark)), F.lit(name)).otherwise(found)
    return found


def described(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic and n_tokens (runs without ASCII white space) of every row; null names become ''."""
    text = text_or_empty()
    topic = F.coalesce(F.col("topic").cast("string"), F.lit("")) if "topic" in docs.columns else topic_of(text)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *named, topic.alias("topic"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"))


def rake(cells: DataFrame, shares: dict[str, dict[str, float]], power: float, others: bool = False) -> DataFrame:
    """cells (the dimensions, tokens) with raked, whose sums by each dimension are the target shares.

    Targets: the given shares of a dimension, over the values that occur; for dimensions that shares lacks, the actual
    shares to the given power. Both are made to sum to one. Values without a given share get none, or with others what
    they would have if none were given, and the given ones make up the rest. Warns where the targets can't be met.
    """
    now = written(cells, "cells")
    few = now.limit(CELL_ROWS + 1).count() <= CELL_ROWS
    whole = now.agg(F.sum("tokens")).first()[0] or 0
    wide = now.withColumn("raked", F.try_divide(F.col("tokens").cast("double"), F.lit(float(whole))))
    for d in DIMENSIONS:
        wide = wide.join(_targets(now, d, shares.get(d), power, others), d)
    old, now = now, written(wide, "cells")
    dropped(old)
    rounds = ROUNDS_AT_ONCE if few else 1
    for _ in range(0, MAX_ROUNDS, rounds):
        step = _windowed(now.coalesce(1), rounds) if few else _joined(now)
        old, now = now, written(step, "cells")
        dropped(old)
        off = [now.groupBy(d).agg(F.abs(F.sum("raked") - F.max(f"target_{d}")).alias("off")).select("off") for d in DIMENSIONS]
        worst = reduce(DataFrame.union, off).agg(F.max("off")).first()[0]
        if worst is None or worst < TOLERANCE:
            break
    else:
        warnings.warn(f"raking ended {worst:.2g} off the target shares after {MAX_ROUNDS} rounds", stacklevel=2)
    return now.select(*DIMENSIONS, "tokens", "raked")


def _windowed(cells: DataFrame, rounds: int) -> DataFrame:
    """cells after so many rounds, each dimension's sums by a window."""
    kept = ", ".join((*DIMENSIONS, "tokens", *(f"target_{d}" for d in DIMENSIONS)))
    text = "{cells}"
    for _ in range(rounds):
        for d in DIMENSIONS:
            text = f"(SELECT {kept}, coalesce(try_divide(raked * target_{d}, sum(raked) OVER (PARTITION BY {d})), 0.0D) AS raked FROM {text})"
    return cells.sparkSession.sql(f"SELECT * FROM {text}", cells=cells)


def _joined(cells: DataFrame) -> DataFrame:
    """cells after one round, each dimension's sums by partial aggregation."""
    for d in DIMENSIONS:
        cells = cells.join(cells.groupBy(d).agg(F.sum("raked").alias("sum")), d).withColumn("raked", F.coalesce(F.try_divide(F.col("raked") * F.col(f"target_{d}"), F.col("sum")), F.lit(0.0))).drop("sum")
    return cells


def _targets(cells: DataFrame, d: str, given: dict[str, float] | None, power: float, others: bool) -> DataFrame:
    """The target share of every value of a dimension."""
    values = cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("own"))
    if not given:
        return _of_one(values, F.col("own")).select(d, F.col("share").alias(f"target_{d}"))
    listed = F.lit(0.0)
    for value, share in given.items():
        listed = F.when(F.col(d) == value, F.lit(float(share))).otherwise(listed)
    if not others:
        return _of_one(values, listed).select(d, F.col("share").alias(f"target_{d}"))
    free = ~F.col(d).isin(list(given))
    own = _of_one(values, F.col("own")).withColumnRenamed("share", "actual")
    left = own.agg(F.coalesce(1 - F.sum(F.when(free, F.col("actual"))), F.lit(1.0))).first()[0]
    return _of_one(own, listed).select(d, F.when(free, F.col("actual")).otherwise(F.col("share") * left).alias(f"target_{d}"))


def _of_one(values: DataFrame, column: Column) -> DataFrame:
    """values with share, the column over its sum; 0 where that is 0."""
    total = values.agg(F.sum(column)).first()[0] or 0.0
    return values.withColumn("share", F.coalesce(F.try_divide(column, F.lit(float(total))), F.lit(0.0)))


def uniform(seed: int) -> Column:
    """A number in [0, 1) from the doc_id."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32


def cell_weights(rows: DataFrame, shares: dict[str, dict[str, float]] | None, power: float, keep: float, others: bool = False) -> DataFrame:
    """The dimensions and weight of every cell of described rows."""
    raked = rake(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), shares or {}, power, others)
    whole = raked.agg(F.sum("tokens")).first()[0] or 0
    weight = F.lit(keep) * F.col("raked") * F.lit(whole) / F.col("tokens")
    return written(raked.withColumn("weight", F.when(F.col("tokens") > 0, F.round(weight, 9)).otherwise(0.0)).select(*DIMENSIONS, "weight"), "weights")


def _copies(seed: int) -> Column:
    return (F.floor("weight") + (uniform(seed) < F.col("weight") - F.floor("weight")).cast("int")).cast("long")


def mix(docs: DataFrame, shares: dict[str, dict[str, float]] | None = None, power: float = 0.7, keep: float = 1.0, seed: int = 1, others: bool = False) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, copies for every row of docs.

    weight is the expected number of copies, probability that of being in the sample at all, copies the decision. Values
    without a given share have weight 0, or with others the share that they would have if none were given. Null names
    count as '', null texts as empty. Texts without words have the weight of their cell, or 0 if the cell has no tokens.
    Rows that share a doc_id decide alike, as do rows without one. An existing topic column is used; other columns are
    ignored; an empty table gives an empty one.
    """
    rows = written(described(docs), "described")
    found = rows.join(cell_weights(rows, shares, power, keep, others), list(DIMENSIONS)).withColumn("copies", _copies(seed))
    return found.select("doc_id", *DIMENSIONS, "n_tokens", F.round("weight", 6).alias("weight"), F.round(F.least(F.col("weight"), F.lit(1.0)), 6).alias("probability"), "copies")


def sampled(docs: DataFrame, shares: dict[str, dict[str, float]] | None = None, power: float = 0.7, keep: float = 1.0, seed: int = 1, others: bool = False) -> DataFrame:
    """docs, all columns, each row as often as mix() decides, so expected tokens meet the targets; rows without a doc_id stay once.

    Cells are joined in place: their weights are broadcast while they are few (CELL_ROWS), so texts aren't shuffled then.
    """
    weights = cell_weights(described(docs), shares, power, keep, others)
    weights = F.broadcast(weights) if weights.limit(CELL_ROWS + 1).count() <= CELL_ROWS else weights
    mark = uuid.uuid4().hex  # no column of docs has such a name
    topic = F.coalesce(F.col("topic").cast("string"), F.lit("")) if "topic" in docs.columns else topic_of(text_or_empty())
    cells = {f"{d}_{mark}": F.coalesce(F.col(d).cast("string"), F.lit("")) for d in ("source", "lang")} | {f"topic_{mark}": topic}
    placed = docs.withColumns(cells).join(weights.select(*(F.col(d).alias(f"{d}_{mark}") for d in DIMENSIONS), F.col("weight").alias(f"weight_{mark}")), [f"{d}_{mark}" for d in DIMENSIONS])
    weight = F.col(f"weight_{mark}")
    copies = F.when(F.col("doc_id").isNull(), 1).otherwise((F.floor(weight) + (uniform(seed) < weight - F.floor(weight)).cast("int")).cast("int"))
    once = placed.withColumn(f"copy_{mark}", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies))))
    return once.select(*(F.col(f"`{c}`") for c in docs.columns))

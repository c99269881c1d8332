"""The smart join: scored candidates, top k per left row, a model's choice, left-outer output.

Scores are columns over candidate pairs: per criterion a similarity in [0, 1], combined as the product of powers. With an
exact criterion pairs meet in an equi-join on it (a pair that differs there scores 0). A numeric or rank criterion that
stands alone needs only the right rows around a left row's place in sorted order. Otherwise every left row meets every
right row that agrees in the exact criteria, blocks of rows at a time (block_scores), and only its best become rows.
Payload columns stay out of the pairs and are joined back after the top k. Numeric distance takes its
largest distance from the extremes of each side and rank similarity its ranks from sorted positions, so neither needs
the pairs. With a provider that may charge for calls the left side is limited to LEFT_LIMIT rows, as every left row may
cost one; the offline provider, whose answers are free, takes every row.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.llm import ask_all, with_usage
from tessera.functions.providers import OfflineProvider, Provider
from tessera.functions.similarity import fuzzy_ratio, hashed_embedding, unit, unit_cosine
from tessera.operators.algorithm import Algorithm, parse_algorithm
from tessera.operators.block_scores import best_pairs
from tessera.plans.staging import fresh, staged, with_position

LEFT_LIMIT, GATE, BROADCAST_BYTES, DEFAULT_K = 10_000, 0.01, 64 << 20, 5
#: Fixed value: the JSON schema of a decision.
DECISION = {"name": "join_decision", "strict": True, "schema": {"type": "object", "properties": {"selected_candidate": {"type": ["number", "null"]}, "confidence": {"type": "number"}}, "required": ["selected_candidate", "confidence"], "additionalProperties": False}}


def _side(df: DataFrame, key: str | list[str] | None, name: str) -> DataFrame:
    """df with a row index: its place by key, or by all its orderable columns."""
    cols = [key] if isinstance(key, str) else key or [f.name for f in df.schema if not isinstance(f.dataType, T.MapType)]
    return with_position(df, [F.col(f"`{c}`").asc_nulls_last() for c in cols], name)


def _number(name: str) -> Column:
    value = F.expr(f"try_cast(`{name}` AS double)")
    return F.coalesce(F.when(~F.isnan(value), value), F.lit(0.0))


def _text(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def candidates(left: DataFrame, right: DataFrame, algorithm: str | Algorithm, embed: Callable[[Column], Column] = hashed_embedding, left_key: str | None = None, right_key: str | None = None, blocking: bool = True, check: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(left with left_idx, right with right_idx, top k pairs: left_idx, right_idx, rank, score, part_0, part_1, ...).

    The index is the last column of left and right, under another name where a column of theirs has that one. Ranks order by score, then by the larger right_idx. Null and non-numeric values count as 0 for numeric mechanisms,
    null texts as empty; null equals null for exact matches of anything but floating numbers. semantic_distance takes
    arrays of numbers as embeddings and embeds texts, once per row, with embed.
    """
    algorithm = parse_algorithm(algorithm) if isinstance(algorithm, str) else algorithm
    if check:
        algorithm.check(left.schema, right.schema)
    for c in algorithm.columns:
        for side, df in (("left", left), ("right", right)):
            if c not in df.columns:
                raise ValueError(f"column {c!r} is not in the {side} table")
    left, right = _side(left, left_key, fresh("left_idx", left.columns)), _side(right, right_key, fresh("right_idx", right.columns))
    l_cols, r_cols, scores, equal = [F.col(left.columns[-1]).alias("left_idx")], [F.col(right.columns[-1]).alias("right_idx")], [], []
    spans = []
    n_right = right.count()
    ranks_l, ranks_r = [], []
    for i, c in enumerate(algorithm.criteria):
        a, b = F.col(f"l{i}"), F.col(f"r{i}")
        kinds = [df.schema[c.column].dataType for df in (left, right)]
        if c.mechanism == "exact_match":
            l_cols.append(F.col(f"`{c.column}`").alias(f"l{i}"))
            r_cols.append(F.col(f"`{c.column}`").alias(f"r{i}"))
            floating = any(isinstance(k, T.FloatType | T.DoubleType) for k in kinds)
            same = (F.coalesce(a == b, F.lit(False)) & ~F.isnan(a)) if floating else a.eqNullSafe(b)
            scores.append(same.cast("double"))
            if c.weight > 0:
                equal.append(same if floating else a.eqNullSafe(b))
            continue
        if c.mechanism in ("fuzzy_match", "semantic_distance"):
            vector = c.mechanism == "semantic_distance"
            for cols, kind, tag in ((l_cols, kinds[0], "l"), (r_cols, kinds[1], "r")):
                value = F.col(f"`{c.column}`") if isinstance(kind, T.ArrayType) else embed(_text(c.column)) if vector else _text(c.column)
                cols.append((unit(value) if vector else value).alias(f"{tag}{i}"))
            scores.append(unit_cosine(a, b) if vector else fuzzy_ratio(a, b))
            continue
        l_cols.append(_number(c.column).alias(f"l{i}"))
        r_cols.append(_number(c.column).alias(f"r{i}"))
        if c.mechanism == "numeric_distance":
            spans.append(i)
            far = F.col(f"far{i}")
            scores.append(F.when(far == 0, 1.0).otherwise(1 - F.abs(a - b) / far))
        else:
            ranks_l.append((i, c))
            ranks_r.append((i, c))
            scores.append(1 / (1 + F.abs(F.col(f"lrank{i}") - F.col(f"rrank{i}")) / F.lit(float(max(1, n_right)))))
    lf, rf = left.select(*l_cols), right.select(*r_cols)
    for i, c in ranks_l:
        lf, rf = _ranked(lf, rf, i, c.mechanism == "arithmetic_desc", n_right)
    for i in spans:
        far = F.greatest(F.abs(F.col(f"lmax{i}") - F.col(f"rmin{i}")), F.abs(F.col(f"rmax{i}") - F.col(f"lmin{i}")))
        ends = lf.agg(F.min(f"l{i}").alias(f"lmin{i}"), F.max(f"l{i}").alias(f"lmax{i}")).crossJoin(rf.agg(F.min(f"r{i}").alias(f"rmin{i}"), F.max(f"r{i}").alias(f"rmax{i}")))
        lf = lf.crossJoin(F.broadcast(ends.withColumn(f"far{i}", far)))  # one row
    single = algorithm.criteria[0] if len(algorithm.criteria) == 1 and algorithm.criteria[0].weight > 0 else None
    if single and single.mechanism == "numeric_distance":
        pairs = _nearest_values(lf, rf, algorithm.k, n_right)
    elif single and ranks_l:
        around = F.explode(F.sequence(F.col("lrank0") - algorithm.k, F.col("lrank0") + algorithm.k))
        pairs = lf.withColumn("near", around).join(rf, F.col("near") == F.col("rrank0")).drop("near")
    elif all(0 <= c.weight < float("inf") for c in algorithm.criteria):
        pairs = _best_of_all(lf, rf, algorithm, equal, blocking, n_right)
    elif equal and blocking:
        on = equal[0]
        for e in equal[1:]:
            on = on & e
        pairs = lf.join(rf, on)
    else:
        small = int(str(rf._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES
        pairs = lf.crossJoin(F.broadcast(rf) if small else rf)
    parts = [s.alias(f"part_{i}") for i, s in enumerate(scores)]
    scored = pairs.select("left_idx", "right_idx", *parts)
    whole = F.lit(1.0)
    for i, c in enumerate(algorithm.criteria):
        whole = whole * F.pow(F.col(f"part_{i}"), F.lit(c.weight))
    scored = scored.withColumn("score", whole)
    order = Window.partitionBy("left_idx").orderBy(F.desc("score"), F.desc("right_idx"))
    top = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= algorithm.k)
    return left, right, top.select("left_idx", "right_idx", "rank", "score", *(f"part_{i}" for i in range(len(scores))))


def _best_of_all(lf: DataFrame, rf: DataFrame, algorithm: Algorithm, equal: list[Column], blocking: bool, n_right: int) -> DataFrame:
    """Pairs among which are the k best of each left row: the k best that agree in the exact criteria and, without blocking,
    those with the last k right rows. All pairs that differ there score 0, so no others of them come before these."""
    lf, rf = staged(lf), staged(rf)
    features = [(i, c.mechanism, c.weight) for i, c in enumerate(algorithm.criteria) if c.mechanism != "exact_match" and c.weight > 0]
    on = None
    for e in equal:
        on = e if on is None else on & e
    keys = [i for i, c in enumerate(algorithm.criteria) if c.mechanism == "exact_match" and c.weight > 0]
    best = best_pairs(lf, rf, features, keys, on, algorithm.k, n_right)
    if equal and not blocking:
        last = rf.where(F.col("right_idx") >= n_right - algorithm.k).select("right_idx")
        best = best.union(lf.select("left_idx").crossJoin(F.broadcast(last))).distinct()
    return lf.join(best, "left_idx").join(rf, "right_idx")


def _nearest_values(lf: DataFrame, rf: DataFrame, k: int, n_right: int) -> DataFrame:
    """Each left row with the k right rows below its value and the k from it on: among them are its k nearest.

    Right rows are numbered by value twice, so that of equal values those of the larger index come nearest on both sides;
    left rows then join the numbers around their own place.
    """
    lf, below = _ranked(lf, rf, 0, False, n_right)
    above = with_position(rf, [F.col("r0"), F.desc("right_idx")], "rrank0")
    sides = [(below, F.col("lrank0") - k, F.col("lrank0") - 1), (above, F.col("lrank0"), F.col("lrank0") + k - 1)]
    parts = [lf.withColumn("near", F.explode(F.sequence(a, z))).join(side, F.col("near") == F.col("rrank0")).select(*lf.columns, *rf.columns) for side, a, z in sides]
    return parts[0].unionByName(parts[1])


def _ranked(lf: DataFrame, rf: DataFrame, i: int, falling: bool, n_right: int) -> tuple[DataFrame, DataFrame]:
    """Adds lrank{i}, the number of smaller right values, and rrank{i}, the place among right values (from the top if falling)."""
    right = with_position(rf, [F.col(f"r{i}"), F.col("right_idx")], "place")
    right = right.withColumn(f"rrank{i}", (F.lit(n_right - 1) - F.col("place") if falling else F.col("place"))).drop("place")
    both = lf.select(F.col(f"l{i}").alias("v"), F.lit(0).alias("side"), F.col("left_idx").alias("idx")).union(rf.select(f"r{i}", F.lit(1), "right_idx"))
    every = with_position(both, [F.col("v"), F.col("side"), F.col("idx")], "among_all").where("side = 0").select(F.col("idx").alias("left_idx"), "among_all")
    own = with_position(lf.select("left_idx", F.col(f"l{i}").alias("v")), [F.col("v"), F.col("left_idx")], "among_left").select("left_idx", "among_left")
    rank = every.join(own, "left_idx").select("left_idx", (F.col("among_all") - F.col("among_left")).alias(f"lrank{i}"))
    return lf.join(rank, "left_idx"), right


def _grouped(left: DataFrame, right: DataFrame, top: DataFrame, algorithm: Algorithm) -> DataFrame:
    """left_idx, best, candidates: an array of at most k structs by rank with the right row's JSON and score breakdown."""
    names = {c: F.col(f"`{c}`") for c in right.columns[:-1]}
    rows = right.select(F.col(right.columns[-1]).alias("right_idx"), _json(*names.values()).alias("right_row"), _json(*(names[c] for c in algorithm.columns)).alias("right_row_alg_cols"))
    breakdown = F.create_map(*[x for i, c in enumerate(algorithm.criteria) for x in (F.lit(_label(algorithm, i)), F.col(f"part_{i}"))])
    joined = top.join(rows, "right_idx")
    one = F.struct("rank", "right_idx", "score", breakdown.alias("breakdown"), "right_row", "right_row_alg_cols")
    return joined.groupBy("left_idx").agg(F.max("score").alias("best"), F.array_sort(F.collect_list(one), lambda a, b: (a["rank"] - b["rank"]).cast("int")).alias("candidates"))


def _label(algorithm: Algorithm, i: int) -> str:
    """The criterion's column; with its mechanism if the column comes more than once."""
    c = algorithm.criteria[i]
    return c.column if sum(x.column == c.column for x in algorithm.criteria) == 1 else f"{c.column} {c.mechanism} {i + 1}"


def _json(*cols: Column) -> Column:
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def _decided(asked: DataFrame, instruction: str, provider: Provider) -> DataFrame:
    """asked with prompt and decision, a struct of selected_candidate and confidence; a failed call gives null."""
    shown = F.transform("candidates", lambda c: F.struct(c["rank"].alias("number"), F.round(c["score"], 3).alias("combined_score"), F.transform_values(c["breakdown"], lambda _, v: F.round(v, 3)).alias("scores"), c["right_row_alg_cols"].alias("row")))
    prompt = _json(F.lit("choose").alias("task"), F.lit(instruction).alias("instruction"), F.col("left_row_alg_cols").alias("left"), shown.alias("candidates"))

    @F.pandas_udf("string")
    def decide(prompts: pd.Series) -> pd.Series:
        return pd.Series(ask_all(list(prompts), lambda p: json.dumps(provider.structured(p, DECISION))), dtype=object)

    run = decide if isinstance(provider, OfflineProvider) else decide.asNondeterministic()
    return asked.withColumn("prompt", prompt).withColumn("decision_json", run("prompt")).withColumn("decision", F.from_json("decision_json", "selected_candidate double, confidence double"))


def llm_join(left: DataFrame, right: DataFrame, algorithm: str, instruction: str = "", provider: Provider | None = None, left_limit: int | str | None = "paid", blocking: bool = True, **sides) -> DataFrame:
    """One row per left row: left_*, right_* (null without a match), join_confidence.

    A left row whose best score is under 0.01 is no match with confidence 0 and isn't asked about. An answer of no
    candidate, or of a number that isn't one of the candidates', gives nulls with the answer's confidence; a failed
    call gives nulls with confidence 0. No right row is exclusive to one left row. left_limit: the most left rows that
    are taken, None for any number; "paid" is LEFT_LIMIT for providers other than the offline one, or with prices.
    """
    provider, spec = provider or OfflineProvider(), parse_algorithm(algorithm)
    if left_limit == "paid":
        free = type(provider) is OfflineProvider and not provider.input_price and not provider.output_price
        left_limit = None if free else LEFT_LIMIT
    if left_limit is not None and left.limit(left_limit + 1).count() > left_limit:
        raise ValueError(f"the left table has more than {left_limit} rows")
    l, r, top = candidates(left, right, spec, blocking=blocking, **sides)
    grouped = _grouped(l, r, top, spec).where(F.col("best") >= GATE)
    left_row, right_row = _packed(l, "left"), _packed(r, "right")
    shown = l.select(F.col(l.columns[-1]).alias("left_idx"), _json(*(F.col(f"`{c}`") for c in spec.columns)).alias("left_row_alg_cols"))
    decided = _decided(grouped.join(shown, "left_idx"), instruction, provider)
    number = F.col("decision.selected_candidate").cast("int")
    chosen = F.element_at(F.filter("candidates", lambda c: c["rank"] == number), 1)["right_idx"]
    picked = decided.select("left_idx", F.when(F.exists("candidates", lambda c: c["rank"] == number), chosen).alias("right_idx"), F.col("decision.confidence").alias("confidence"))
    out = left_row.join(picked, "left_idx", "left").join(right_row, "right_idx", "left")
    return out.select(*(F.col("left_row")[c].alias(f"left_{c}") for c in left.columns), *(F.col("right_row")[c].alias(f"right_{c}") for c in right.columns), F.coalesce("confidence", F.lit(0.0)).alias("join_confidence"))


def _packed(df: DataFrame, side: str) -> DataFrame:
    """The index and the row as a struct, so that no name of the table meets another's."""
    return df.select(F.col(df.columns[-1]).alias(f"{side}_idx"), F.struct(*(F.col(f"`{c}`") for c in df.columns[:-1])).alias(f"{side}_row"))


def llm_join_test(left: DataFrame, right: DataFrame, algorithm: str, instruction: str = "", mode: str = "dry", n: int | None = None, seed: int | None = None, provider: Provider | None = None, **sides) -> DataFrame:
    """row_index, left_row_json, candidates_json, llm_decision_json (null in dry mode and under the gate), row_cost.

    row_cost is the price of the row's prompt and answer by the provider's prices, 0 without a call; extrapolated_cost()
    carries its sum on to the whole table. All k candidates are listed, those of score 0 too. n takes that many left rows at random (by seed, if given).
    """
    if mode not in ("dry", "full"):
        raise ValueError("mode must be dry or full")
    provider, spec = provider or OfflineProvider(), parse_algorithm(algorithm)
    if n is not None:
        left = left.orderBy(F.rand(seed)).limit(max(1, min(100, n)))
    l, r, top = candidates(left, right, spec, blocking=False, **sides)
    rows = l.select(F.col(l.columns[-1]).alias("left_idx"), _json(*(F.col(f"`{c}`") for c in left.columns)).alias("left_row_json"), _json(*(F.col(f"`{c}`") for c in spec.columns)).alias("left_row_alg_cols"))
    grouped = rows.join(_grouped(l, r, top, spec), "left_idx", "left")
    listed = F.transform("candidates", lambda c: F.struct(c["right_row"].alias("right_row"), c["right_row_alg_cols"].alias("right_row_alg_cols"), c["score"].alias("score"), c["breakdown"].alias("breakdown")))
    if mode == "full":
        asked = with_usage(_decided(grouped.where(F.col("best") >= GATE), instruction, provider), "prompt", "decision_json", provider)
        grouped = grouped.join(asked.select("left_idx", "decision_json", "cost"), "left_idx", "left")
    else:
        grouped = grouped.withColumns({"decision_json": F.lit(None).cast("string"), "cost": F.lit(0.0)})
    return grouped.select(F.col("left_idx").alias("row_index"), "left_row_json", F.coalesce(F.to_json(listed), F.lit("[]")).alias("candidates_json"), F.col("decision_json").alias("llm_decision_json"), F.coalesce("cost", F.lit(0.0)).alias("row_cost"))

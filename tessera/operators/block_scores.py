"""The k best right rows of every left row when all pairs must be scored: blocks of rows meet blocks, numpy scores them.

Rows with equal features are scored once. What is left is numbered in order of its exact keys and cut into blocks of at
most BLOCK_ROWS rows and BLOCK_BYTES bytes; blocks of equal keys are joined, and a task holds one pair of blocks and sends
on k right rows per left row and pair of blocks. So every pair is compared, but no pair is a row of a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.similarity import common_subsequence
from tessera.plans.staging import settings, staged, with_position

BLOCK_ROWS, LEFT_ROWS, BLOCK_BYTES, BROADCAST_BYTES = 4096, 2048, 4 << 20, 64 << 20
CELLS = 1 << 19  # scores that are held at a time


def best_pairs(lf: DataFrame, rf: DataFrame, features: list[tuple[int, str, float]], keys: list[int], on: Column | None, k: int, n_right: int) -> DataFrame:
    """left_idx, right_idx of the k best pairs of each left row among those that meet by on; ties to the larger right_idx.

    lf: left_idx, l{i}, for numeric criteria far{i}, for ranks lrank{i}; rf: right_idx, r{i}, rrank{i}. features: number,
    mechanism and weight of the criteria other than exact ones; keys: numbers of the exact ones, whose columns on names.
    """
    l_names = [n for i, kind, _ in features for n in ([f"l{i}", f"far{i}"] if kind == "numeric_distance" else [f"lrank{i}"] if kind.startswith("arithmetic") else [f"l{i}"])]
    r_names = [f"rrank{i}" if kind.startswith("arithmetic") else f"r{i}" for i, kind, _ in features]
    l_keys, r_keys = [f"l{i}" for i in keys], [f"r{i}" for i in keys]
    # Of equal right rows only the k of the largest right_idx can be chosen; the first stands for them.
    same = Window.partitionBy(*r_keys, *r_names).orderBy(F.desc("right_idx"))
    right = staged(rf.withColumns({"place": F.row_number().over(same), "rid": F.first("right_idx").over(same)}).where(F.col("place") <= k))
    left = lf.groupBy(*l_keys, *l_names).agg(F.min("left_idx").alias("lid"))
    cores = lf.sparkSession.sparkContext.defaultParallelism
    l_blocks, _ = _blocks(left, "lid", l_keys, l_names, "l_rows", LEFT_ROWS, 3 * cores)
    r_blocks, size = _blocks(right.where("place = 1"), "rid", r_keys, r_names, "r_rows", BLOCK_ROWS, 1)
    if size <= BROADCAST_BYTES:
        l_blocks, r_blocks = l_blocks.repartition(6 * cores), F.broadcast(r_blocks)
    met = (l_blocks.crossJoin(r_blocks) if on is None else l_blocks.join(r_blocks, on)).select("l_rows", "r_rows")
    if size > BROADCAST_BYTES:
        met = met.repartition(6 * cores)
    scored = met.mapInArrow(_scorer(features, k, n_right), "lid long, rid long, score double")
    order = Window.partitionBy("lid").orderBy(F.desc("score"), F.desc("rid"))
    picks = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")
    every = picks.join(right.select("rid", "right_idx"), "rid")
    order = Window.partitionBy("lid").orderBy(F.desc("score"), F.desc("right_idx"))
    chosen = every.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("lid", "right_idx")
    with settings(lf.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1"}):  # a pair of blocks at a time
        chosen = staged(chosen)
    equal = F.lit(True)
    for n in l_keys + l_names:
        equal = equal & F.col(n).eqNullSafe(F.col(f"same_{n}"))
    members = lf.join(left.select("lid", *(F.col(n).alias(f"same_{n}") for n in l_keys + l_names)), equal).select("left_idx", "lid")
    return members.join(chosen, "lid").select("left_idx", "right_idx")


def _blocks(rows: DataFrame, idx: str, keys: list[str], names: list[str], name: str, most: int, parts: int) -> tuple[DataFrame, int]:
    """keys and an array of rows per block, of rows that agree in keys; and the bytes of all rows."""
    numbered = with_position(rows.select(*keys, idx, *names), [*(F.col(n) for n in keys), F.desc(idx)], "place")
    width = F.lit(8)
    for n in names:
        kind = rows.schema[n].dataType
        width = width + (F.coalesce(8 * F.size(n), F.lit(8)) if isinstance(kind, T.ArrayType) else 4 * F.length(n) + 4 if isinstance(kind, T.StringType) else F.lit(8))
    count, widest, size = numbered.agg(F.count("*"), F.max(width), F.sum(width)).first()
    per_block = max(1, min(most, BLOCK_BYTES // (widest or 8), -(-count // parts)))
    block = F.floor(F.col("place") / per_block).alias("block")
    return numbered.groupBy(*keys, block).agg(F.collect_list(F.struct(idx, *names)).alias(name)), size or 0


def _scorer(features: list[tuple[int, str, float]], k: int, n_right: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = best = None
        for batch in batches:
            for j in range(batch.num_rows):
                lid, *left = _fields(batch.column(0), j)
                rid, *right = _fields(batch.column(1), j)
                lid, rid = _numbers(lid), _numbers(rid)
                order = np.argsort(-rid)  # of equal scores the first is the one of the larger index
                rid, right = rid[order], [c.take(pa.array(order)) for c in right]
                if before is None or not np.array_equal(before, lid):
                    before, best = lid, np.full((len(lid), k), -np.inf) if k <= 64 else None
                parts = _parts(left, right, features, n_right)
                step = max(1, CELLS // len(rid))
                for at in range(0, len(lid), step):
                    span = slice(at, min(at + step, len(lid)))
                    score = np.ones((span.stop - at, len(rid)))
                    with np.errstate(all="ignore"):
                        for part, (_, _, weight) in zip(parts, features, strict=True):
                            score *= part(span) if weight == 1 else part(span) ** weight
                    score[np.isnan(score)] = np.inf  # Spark's order, too, puts what isn't a number above all numbers
                    rows, cols = _top(score, k, None if best is None else best[span])
                    found = [pa.array(lid[span][rows]), pa.array(rid[cols]), pa.array(score[rows, cols])]
                    yield pa.RecordBatch.from_arrays(found, ["lid", "rid", "score"])

    return run


def _fields(lists: pa.ListArray, j: int) -> list[pa.Array]:
    return lists.slice(j, 1).flatten().flatten()


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _top(score: np.ndarray, k: int, best: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best of each row, of equal ones the first. best: each row's k best scores so far, rising;
    what is under the least of them is left out, and they are brought up to date."""
    n = score.shape[1]
    few = None
    if best is not None and np.isfinite(best[:, 0]).any():
        few = np.nonzero(score >= best[:, :1])
        few = None if len(few[0]) > 4 * k * len(score) else few
    if few is None and n > k:
        least = np.partition(score, n - k, axis=1)[:, n - k, None]
        above, ties = score > least, score == least
        few = np.nonzero(above | ties & (np.cumsum(ties, axis=1, dtype=np.int32) <= k - above.sum(axis=1, keepdims=True)))
    rows, cols = np.nonzero(np.ones(score.shape, bool)) if few is None else few
    order = np.lexsort((cols, -score[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    rows, cols, place = rows[place < k], cols[place < k], place[place < k]
    if best is not None:
        new = np.full(best.shape, -np.inf)
        new[rows, place] = score[rows, cols]
        best[:] = np.sort(np.hstack((best, new)), axis=1)[:, -k:]
    return rows, cols


def _parts(left: list[pa.Array], right: list[pa.Array], features: list[tuple[int, str, float]], n_right: int) -> list[Callable[[slice], np.ndarray]]:
    """For each feature a function from a span of left rows to their similarities with all right rows."""
    left, out = list(left), []
    for (_, kind, _), b in zip(features, right, strict=True):
        a = left.pop(0)
        if kind == "fuzzy_match":
            out.append(_fuzzy(a.to_pylist(), b.to_pylist()))
        elif kind == "semantic_distance":
            out.append(_cosine(a, b))
        elif kind == "numeric_distance":
            out.append(_distance(_numbers(a), _numbers(b), float(left.pop(0)[0].as_py())))
        else:
            out.append(_rank(_numbers(a), _numbers(b), float(max(1, n_right))))
    return out


def _distance(a: np.ndarray, b: np.ndarray, far: float) -> Callable[[slice], np.ndarray]:
    return lambda span: np.ones((span.stop - span.start, len(b))) if far == 0 else 1 - np.abs(a[span, None] - b) / far


def _rank(a: np.ndarray, b: np.ndarray, n: float) -> Callable[[slice], np.ndarray]:
    return lambda span: 1 / (1 + np.abs(a[span, None] - b) / n)


def _cosine(a: pa.ListArray, b: pa.ListArray) -> Callable[[slice], np.ndarray]:
    """Of unit vectors; 0 for null ones and those of other lengths, negative ones as 0."""
    lengths = [np.nan_to_num(_numbers(x.value_lengths()).astype(float)).astype(np.int64) for x in (a, b)]
    wide = max(1, *(int(n.max(initial=0)) for n in lengths))

    def matrix(x: pa.ListArray, n: np.ndarray) -> np.ndarray:
        whole = np.zeros((len(n), wide))
        whole[np.arange(wide) < n[:, None]] = _numbers(x.flatten())
        return whole

    x, y = matrix(a, lengths[0]), matrix(b, lengths[1]).T
    alike = all((n == wide).all() for n in lengths)

    def part(span: slice) -> np.ndarray:
        found = np.maximum(x[span] @ y, 0.0)
        return found if alike else np.where(lengths[0][span, None] == lengths[1], found, 0.0)

    return part


def _fuzzy(a: list[str], b: list[str]) -> Callable[[slice], np.ndarray]:
    """indel_ratio: a left text of up to 64 characters meets all right ones at once, one bit per character."""
    sizes = np.array([len(t) for t in b])
    known, codes = np.unique(np.frombuffer("".join(b).encode("utf-32-le"), np.uint32), return_inverse=True)
    number = {chr(c): n for n, c in enumerate(known.tolist(), 1)}
    places = np.zeros((int(sizes.max()), len(b)), np.intp)  # 0 where a text has ended
    text = np.repeat(np.arange(len(b)), sizes)
    places[np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes), text] = codes + 1

    def common(t: str) -> np.ndarray:
        if len(t) > 64:
            return np.array([common_subsequence(t, u) for u in b])
        where = np.zeros(len(known) + 1, np.uint64)
        for i, c in enumerate(t):
            if c in number:
                where[number[c]] |= np.uint64(1 << i)
        row = np.full(len(b), (1 << len(t)) - 1, np.uint64)
        for line in places:
            hit = row & where[line]
            row = (row + hit) | (row - hit)
        return len(t) - np.bitwise_count(row & np.uint64((1 << len(t)) - 1)).astype(np.int64)

    def part(span: slice) -> np.ndarray:
        out = np.ones((span.stop - span.start, len(b)))
        for row, t in zip(out, a[span], strict=True):
            whole = len(t) + sizes
            np.divide(2 * common(t), whole, out=row, where=whole > 0)
        return out

    return part

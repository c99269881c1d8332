"""Approximate nearest neighbours by cross-polytope hashing.

A vector is turned by fast Hadamard pseudo-rotations (three rounds of random signs and a Walsh-Hadamard transform, one
independent rotation per hash function) and hashed to the nearest signed axis, one of twice the width. A table
concatenates one or more hashes to a bucket, and (table, bucket) is the key that vectors and queries meet on: a vector
goes to one bucket of each table, a query to the buckets that score best for it, the sum of its coordinates along their
axes. CODES further hashes concatenate to a code of every vector; in a bucket, a query's candidates are the vectors whose
whole code scores over the query's own threshold, and only these are reranked by exact inner products in double precision.

Inner products favour long vectors, which directions don't show. So vectors are put into bands of similar length (BAND);
bands with few vectors make one bucket, and a code's score is multiplied by the vector's length.

How many hashes make a bucket, how many tables and buckets are probed and which share of the vectors passes the code
threshold is fitted for each table of vectors: SAMPLE_QUERIES queries are compared with all vectors in one pass, and of
all settings that find TARGET of their true neighbours the cheapest is taken. Thresholds come from a sample of at most
SAMPLE_ROWS vectors, whose best also bound from below what a query's nearest can score, so that buckets return few rows.
Both samples are bounded in rows and bytes (SAMPLE_BYTES); all vectors are indexed and all queries search.

Equal vectors are folded into one entry with its smallest vec_ids. Buckets of more than BUCKET_ROWS vectors are split by
a hash of the vector, and queries go to every part, so a crowded bucket doesn't land in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, log

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_rows, written

TABLES, CODES, MAX_HASHES = 6, 32, 3
BAND, EXACT_ROWS, WHOLE_ROWS, BUCKET_ROWS, BLOCK = 1.1, 512, 2048, 8192, 128
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_QUERIES, TARGET = 4096, 8 << 20, 96, 0.95
#: Settings that are tried: shares of the buckets to probe, shares of the vectors to rerank.
PROBED = (1.0, 0.75, 0.5, 0.375, 0.25, 0.19, 0.125, 0.09, 0.06, 0.03, 0.015, 0.008, 0.004)
RERANKED = (0.0025, 0.005, 0.01, 0.015, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.1, 0.15, 0.25, 0.5, 1.0)
#: Cost of a query in a bucket, of a code's score and of a reranked pair, in products of numbers.
_VISIT, _SCORE, _RERANK = 5000, CODES, 1000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, width, size = x.shape[0], 1, x.shape[1]
    while width < size:
        x = x.reshape(n, size // (2 * width), 2, width)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, size)
        width *= 2
    return x / np.sqrt(size).astype(x.dtype)


class CrossPolytope:
    """Independent hash functions for vectors of a dimension."""

    def __init__(self, dimension: int, hashes: int, seed: int = 11):
        self.width = 1 << max(1, (dimension - 1).bit_length())
        self.axes = 2 * self.width
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (hashes, 3, self.width)).astype(np.float32)

    def turned(self, x: np.ndarray, h: int) -> np.ndarray:
        """Coordinates of the rows along every signed axis of hash function h."""
        out = np.zeros((len(x), self.width), np.float32)
        out[:, : x.shape[1]] = x
        for signs in self.signs[h]:
            out = hadamard(out * signs)
        return np.hstack((out, -out))

    def hashed(self, x: np.ndarray, hashes: range) -> np.ndarray:
        """The nearest signed axes, rows x hashes."""
        return np.stack([self.turned(x, h).argmax(axis=1) for h in hashes], axis=1).astype(np.uint16)


@dataclass
class Plan:
    """The index of the vectors of one dimension. bands, longest first: least length class, hashes of a bucket (0: one bucket), probes."""

    dimension: int
    rows: int
    bands: list[tuple[int, int, int]] = field(default_factory=list)
    tables: int = 1
    share: float = 1.0
    sample: np.ndarray | None = None
    sample_ids: list[list[int]] = field(default_factory=list)
    recall: float = 1.0  # of the sample queries

    def __post_init__(self) -> None:
        self.matrices = None
        self.hashing = CrossPolytope(self.dimension, TABLES * MAX_HASHES + CODES)
        self.code_hashes = range(TABLES * MAX_HASHES, TABLES * MAX_HASHES + CODES)
        if self.sample is not None:
            self.sample_codes = self.hashing.hashed(_units(self.sample), self.code_hashes)
            self.sample_sizes = _sizes(self.sample)

    def band_of(self, length_class: int) -> int:
        return next(b for b, (least, _, _) in enumerate(self.bands) if length_class >= least)

    def buckets(self, x: np.ndarray, table: int, hashes: int) -> np.ndarray:
        found = np.zeros(len(x), np.int64)
        for h in range(hashes):
            found = found * self.hashing.axes + self.hashing.hashed(x, range(table * MAX_HASHES + h, table * MAX_HASHES + h + 1))[:, 0]
        return found

    def probes(self, q: np.ndarray, table: int, hashes: int, count: int) -> np.ndarray:
        """The buckets that score best for each query, by the sum over the concatenated hashes."""
        axes = self.hashing.axes
        best, found = np.zeros((len(q), 1), np.float32), np.zeros((len(q), 1), np.int64)
        for h in range(hashes):
            y = self.hashing.turned(q, table * MAX_HASHES + h)
            total = (best[:, :, None] + y[:, None, :]).reshape(len(q), -1)
            name = (found[:, :, None] * axes + np.arange(axes)).reshape(len(q), -1)
            keep = min(count, total.shape[1]) if h == hashes - 1 else min(max(count, axes), total.shape[1])
            top = np.argpartition(-total, keep - 1, axis=1)[:, :keep]
            best, found = np.take_along_axis(total, top, 1), np.take_along_axis(name, top, 1)
        return found

    def coordinates(self, q: np.ndarray) -> np.ndarray:
        """Of the queries along the axes of the code, hashes x queries x axes; narrow rotations are multiplied as matrices."""
        if self.hashing.width > 128:
            return np.stack([self.hashing.turned(q, h) for h in self.code_hashes])
        if self.matrices is None:
            self.matrices = np.stack([self.hashing.turned(np.eye(self.dimension), h) for h in self.code_hashes])
        return q.astype(np.float32) @ self.matrices

    def threshold(self, scores: np.ndarray) -> np.ndarray:
        """Scores of a query's codes in the sample to the least score that a candidate may have."""
        place = min(scores.shape[1], ceil(self.share * scores.shape[1]))
        return -np.partition(-scores, place - 1, axis=1)[:, place - 1] if self.share < 1 else np.full(len(scores), -np.inf)


def _sizes(x: np.ndarray) -> np.ndarray:
    largest = np.maximum(np.abs(x).max(axis=1), 1e-300)
    return largest * np.sqrt(((x / largest[:, None]) ** 2).sum(axis=1))


def _units(x: np.ndarray) -> np.ndarray:
    return x / _sizes(x)[:, None]


def code_scores(y: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Queries x vectors: the sum of the queries' coordinates along the axes of each vector's code."""
    found = np.take(y[0], codes[:, 0], axis=1)
    for h in range(1, len(y)):
        found += np.take(y[h], codes[:, h], axis=1)
    return found


def products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows, each summed on its own, so a pair has one score wherever it is met."""
    return (v * q).sum(axis=1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, target: float = TARGET, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of queries its k nearest found rows of vectors other than itself.

    Both tables have vec_id and embedding (queries may be a part of vectors). Nearest means the largest inner product of
    the original vectors in double precision; ties go to the smaller vec_id. Null or zero vectors and those with null
    or non-finite components take no part, and vectors meet those of their own dimension only; of a dimension with up to
    exact_rows vectors all are candidates. Rows that repeat a vec_id count once per different vector. A query always
    has k answers where there are as many candidates. Other columns are ignored.
    """
    wanted = _usable(queries).withColumn("class_id", _class()).select("vec_id", "class_id", "embedding")
    found = search(vectors, wanted, k, target, exact_rows).where("vec_id is not null")
    best = Window.partitionBy("class_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("class_id", "vec_id").agg(F.max("score").alias("score"))
    top = once.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    top = written(top.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("top")), "nearest")
    asked = wanted.select(F.col("vec_id").alias("query_id"), "class_id").distinct().join(top, "class_id")
    others = F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    rows = asked.select("query_id", F.posexplode(others).alias("at", "x"))
    return rows.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def search(vectors: DataFrame, wanted: DataFrame, k: int, target: float = TARGET, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """class_id, vec_id, score of the reranked candidates that can be among the k + 1 best, and rows without a vec_id whose
    score is the number of pairs that a bucket reranked for a query. wanted: class_id, embedding."""
    entry = written(_entries(vectors, k + 1), "vectors")
    asked = written(wanted.groupBy("class_id").agg(F.first("embedding").alias("embedding")), "queries")
    plans = _plans(entry, asked, k, target, exact_rows)

    def place(rows: Iterator[tuple]) -> Iterator[tuple]:
        for block in _by_dimension(rows, 2):
            for d, ids, length_class, x in block:
                plan = plans[d]
                units = _units(x)
                codes = plan.hashing.hashed(units, plan.code_hashes)
                band = np.array([plan.band_of(c) for c in length_class])
                for b in np.unique(band).tolist():
                    at = np.flatnonzero(band == b)
                    hashes = plan.bands[b][1]
                    for t in range(plan.tables if hashes else 1):
                        for i, bucket in zip(at.tolist(), plan.buckets(units[at], t, hashes).tolist(), strict=True):
                            yield d, b, t, bucket, ids[i], x[i].tobytes(), codes[i].tobytes()

    key = "dimension int, band int, tab int, bucket long"
    placed = written(map_rows(entry.select("ids", "length_class", "embedding"), place, f"{key}, ids array<long>, vector binary, code binary"), "placed")
    names = ["dimension", "band", "tab", "bucket"]
    parts = written(placed.groupBy(*names).agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / BUCKET_ROWS).cast("int")).select(*names, "parts"), "buckets")
    parts = F.broadcast(parts) if parts.limit(1_000_001).count() <= 1_000_000 else parts  # some 50 bytes a row

    def ask(rows: Iterator[tuple]) -> Iterator[tuple]:
        for block in _by_dimension(rows, 1):
            for d, ids, x in block:
                plan = plans.get(d)
                if plan is None:
                    continue
                units = x / _sizes(x)[:, None]
                least, bound = np.full(len(x), -np.inf), np.full(len(x), -np.inf)
                if plan.sample is not None:
                    least = plan.threshold(code_scores(plan.coordinates(units), plan.sample_codes) * plan.sample_sizes)
                    if len(plan.sample) > k:
                        exact = x @ plan.sample.T
                        bound = np.partition(exact, -(k + 1), axis=1)[:, -(k + 1)]
                        bound = np.nan_to_num(bound - 1e-11 * _sizes(x) * plan.sample_sizes.max(), nan=-np.inf, neginf=-np.inf)  # sums of other orders
                for b, (_, hashes, count) in enumerate(plan.bands):
                    for t in range(plan.tables if hashes else 1):
                        found = plan.probes(units, t, hashes, count) if hashes else np.zeros((len(x), 1), np.int64)
                        for i, buckets in enumerate(found.tolist()):
                            for bucket in buckets:
                                yield d, b, t, bucket, ids[i], x[i].tobytes(), float(least[i]), float(bound[i])

    probes = map_rows(asked.select("class_id", "embedding"), ask, f"{key}, class_id string, vector binary, least double, bound double")
    probes = probes.join(parts, names).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    stored = placed.join(parts, names).withColumn("part", F.pmod(F.xxhash64("vector"), F.col("parts")).cast("int")).drop("parts")
    shared = [*names, "part"]
    stored = stored.select(*shared, F.lit(0).alias("side"), "ids", "vector", "code", F.lit(None).cast("string").alias("class_id"), F.lit(0.0).alias("least"), F.lit(0.0).alias("bound"))
    probes = probes.select(*shared, F.lit(1).alias("side"), F.lit(None).cast("array<long>").alias("ids"), "vector", F.lit(None).cast("binary").alias("code"), "class_id", "least", "bound")

    def meet(rows: Iterator[tuple]) -> Iterator[tuple]:
        at, held, block, index = None, [], [], None
        for row in rows:
            if row[:5] != at:
                yield from _answers(plans, at, index, block)
                at, held, block, index = row[:5], [], [], None
            if row[5] == 0:
                held.append(row[6:9])
                continue
            if index is None:
                index, held = _bucket(held), []
            block.append(row[7:8] + row[9:])
            if len(block) == BLOCK:
                yield from _answers(plans, at, index, block)
                block = []
        yield from _answers(plans, at, index, block)

    tasks = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(p.rows * p.tables for p in plans.values()) // 50_000)
    dealt = stored.unionByName(probes).repartition(tasks, *shared).sortWithinPartitions(*shared, "side")
    found = map_rows(dealt, meet, "class_id string, vec_id long, score double", chunk=1024)

    def known(rows: Iterator[tuple]) -> Iterator[tuple]:
        """The best of the sample: so no query is left with fewer answers than there are candidates."""
        for block in _by_dimension(rows, 1):
            for d, ids, x in block:
                if d in plans and plans[d].sample is not None:
                    sample, sample_ids = plans[d].sample, plans[d].sample_ids
                    top = np.argsort(-(x @ sample.T), axis=1)[:, : k + 1]
                    for class_id, q, best in zip(ids, x, top, strict=True):
                        for j, s in zip(best.tolist(), products(sample[best], q).tolist(), strict=True):
                            yield from ((class_id, v, s) for v in sample_ids[j])

    return found.unionByName(map_rows(asked.select("class_id", "embedding"), known, "class_id string, vec_id long, score double"))


def _answers(plans: dict[int, Plan], at: tuple | None, index: tuple | None, block: list[tuple]) -> Iterator[tuple]:
    if at is None or index is None or not block:
        return
    plan, (ids, v, codes, sizes) = plans[at[0]], index
    q = np.frombuffer(b"".join([b[0] for b in block])).reshape(len(block), -1)
    least, bound = np.array([b[2] for b in block]), np.array([b[3] for b in block])
    if plan.share < 1:
        scores = code_scores(plan.coordinates(q / _sizes(q)[:, None]), codes) * sizes
        who, which = np.nonzero(scores >= least[:, None])
    else:
        who, which = np.divmod(np.arange(len(q) * len(v)), len(v))
    for n, b in zip(np.bincount(who, minlength=len(block)).tolist(), block, strict=True):
        yield b[1], None, float(n)
    for a in range(0, len(who), 1 << 15):
        i, j = who[a : a + (1 << 15)], which[a : a + (1 << 15)]
        score = products(v[j], q[i])
        good = np.flatnonzero(score >= bound[i])
        for x, y, s in zip(i[good].tolist(), j[good].tolist(), score[good].tolist(), strict=True):
            for vec_id in ids[y]:
                yield block[x][1], vec_id, s


def _bucket(held: list[tuple]) -> tuple:
    """ids, vectors, codes and lengths of a bucket's entries."""
    if not held:
        return None
    v = np.frombuffer(b"".join([h[1] for h in held])).reshape(len(held), -1)
    codes = np.frombuffer(b"".join([h[2] for h in held]), np.uint16).reshape(len(held), CODES)
    return [h[0] for h in held], v, codes, _sizes(v)


def _by_dimension(rows: Iterator[tuple], names: int, block: int = BLOCK) -> Iterator[list[tuple]]:
    """Rows (names..., vector) in blocks: per dimension the names as lists and the vectors as a matrix."""

    def parts(held: list[tuple]) -> list[tuple]:
        out = []
        for d in sorted({len(r[-1]) for r in held}):
            mine = [r for r in held if len(r[-1]) == d]
            out.append((d, *([r[i] for r in mine] for i in range(names)), np.array([r[-1] for r in mine], np.float64)))
        return out

    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == block:
            yield parts(held)
            held = []
    if held:
        yield parts(held)


def _plans(entry: DataFrame, asked: DataFrame, k: int, target: float, exact_rows: int) -> dict[int, Plan]:
    """An index plan for every dimension. The driver holds counts per length class, and for the dimensions beyond
    exact_rows the two samples and the sample queries' true neighbours."""
    counts: dict[int, dict[int, int]] = {}
    for r in entry.groupBy(F.size("embedding").alias("d"), "length_class").count().collect():
        counts.setdefault(r.d, {})[r.length_class] = r["count"]
    plans = {d: Plan(d, sum(c.values()), [(min(c), 0, 1)]) for d, c in counts.items()}
    for d in [d for d, p in plans.items() if p.rows > exact_rows]:
        n = plans[d].rows
        mine, asking = entry.where(F.size("embedding") == d), asked.where(F.size("embedding") == d)
        sample = _some(mine, 5, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * d), max(256, n // 16)), n)
        queries = _some(asking, 6, SAMPLE_QUERIES, asking.count())
        if not sample or not queries:
            continue
        plan = Plan(d, n, sample=np.array([r.embedding for r in sample]), sample_ids=[r.ids for r in sample])
        truth = _truth(mine, np.array([r.embedding for r in queries]), k)
        plans[d] = _fitted(plan, counts[d], np.array([r.embedding for r in queries]), truth, target)
    return plans


def _some(rows: DataFrame, seed: int, most: int, n: int) -> list:
    """About most of n rows, at most twice as many, by a hash of the vector."""
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), "embedding"), F.lit(max(1, n // max(1, most)))) == 0).limit(2 * most).collect() if most > 0 else []


def _truth(entry: DataFrame, queries: np.ndarray, k: int) -> list[tuple[int, np.ndarray]]:
    """(query's number, vector) of the queries' k nearest among all entries, in one pass."""

    def best(rows: Iterator[tuple]) -> Iterator[tuple]:
        top: list[list[tuple]] = [[] for _ in queries]
        for block in _by_dimension(rows, 0, 1024):
            for _, x in block:
                scores = queries @ x.T
                for i, line in enumerate(scores):
                    floor = top[i][-1][0] if len(top[i]) == k + 1 else -np.inf
                    new = np.flatnonzero(line > floor)
                    if len(new):
                        merged = top[i] + [(float(line[j]), x[j]) for j in new[np.argsort(-line[new])[: k + 1]]]
                        top[i] = sorted(merged, key=lambda t: -t[0])[: k + 1]
        for i, found in enumerate(top):
            yield from ((i, s, v) for s, v in found)

    near = map_rows(entry.select("embedding"), best, "q int, score double, embedding array<double>")
    first = Window.partitionBy("q").orderBy(F.desc("score"))
    rows = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).select("q", "embedding").collect()
    found = [(r.q, np.array(r.embedding)) for r in rows]
    return [(q, v) for q, v in found if not np.array_equal(v, queries[q])]


def _fitted(plan: Plan, counts: dict[int, int], queries: np.ndarray, truth: list[tuple[int, np.ndarray]], target: float) -> Plan:
    """plan with bands, and the cheapest hashes, tables, probes and share of reranked vectors that find target of the truth."""
    axes = plan.hashing.axes
    bands: list[list[int]] = []  # least class, rows
    for c in sorted(counts, reverse=True):
        if bands and (bands[-1][1] + counts[c] <= WHOLE_ROWS):
            bands[-1] = [c, bands[-1][1] + counts[c]]
        else:
            bands.append([c, counts[c]])
    who = np.array([q for q, _ in truth], np.int64)
    near = np.array([v for _, v in truth]) if truth else np.zeros((0, plan.dimension))
    units = _units(queries)
    y = plan.coordinates(units)
    codes = plan.hashing.hashed(_units(near), plan.code_hashes)
    code_score = sum(y[h][who, codes[:, h]] for h in range(CODES)) * _sizes(near) if truth else np.zeros(0)
    in_sample = code_scores(y, plan.sample_codes) * plan.sample_sizes
    passes = {}
    for share in RERANKED:
        plan.share = share
        passes[share] = code_score >= plan.threshold(in_sample)[who]
    classes = np.floor(np.log(_sizes(near)) / log(BAND) + 0.5).astype(int) if truth else np.zeros(0, int)
    band = np.array([next((b for b, (least, _) in enumerate(bands) if c >= least), len(bands) - 1) for c in classes], int)
    deepest = [0 if n <= WHOLE_ROWS else max(h for h in range(1, MAX_HASHES + 1) if h == 1 or n / axes**h >= 32) for _, n in bands]
    best = None
    for less in range(max(deepest, default=0) + 1):
        hashes = [min(h, max(1, max(deepest) - less)) if h else 0 for h in deepest]
        place = np.ones((TABLES, len(who)))  # the place of a neighbour's bucket among those of its query
        for t in range(TABLES):
            turned = {h: plan.hashing.turned(units, t * MAX_HASHES + h) for h in range(max(hashes, default=0))}
            own = {h: plan.hashing.hashed(_units(near), range(t * MAX_HASHES + h, t * MAX_HASHES + h + 1))[:, 0] for h in turned} if truth else {}
            for i, q in enumerate(who.tolist()):
                depth = hashes[band[i]]
                if depth:
                    place[t, i] = 1 + _better([turned[h][q] for h in range(depth)], sum(float(turned[h][q, own[h][i]]) for h in range(depth)))
        for tables in range(1, TABLES + 1):
            first = place[:tables].min(axis=0) if truth else np.zeros(0)
            for probed in PROBED:
                count = [max(1, ceil(probed * axes**h)) if h else 1 for h in hashes]
                if max(count) > 16384:
                    continue
                met = first <= np.array([count[b] for b in band]) if truth else np.ones(0, bool)
                visits = sum((tables if h else 1) * c for h, c in zip(hashes, count, strict=True))
                scanned = sum(n * (tables * probed if h else 1) for (_, n), h in zip(bands, hashes, strict=True))
                for share in RERANKED:
                    recall = float((met & passes[share]).mean()) if truth else 1.0
                    cost = visits * _VISIT + scanned * _SCORE + share * plan.rows * _RERANK
                    if recall >= target and (best is None or cost < best[0]):
                        best = cost, hashes, count, tables, share, recall
        if max(hashes, default=0) <= 1:
            break
    _, hashes, count, plan.tables, plan.share, plan.recall = best or (0, [0] * len(bands), [1] * len(bands), 1, 1.0, 1.0)
    plan.bands = [(least, h, c) for (least, _), h, c in zip(bands, hashes, count, strict=True)]
    return plan


def _better(coordinates: list[np.ndarray], total: float) -> int:
    """How many buckets score over total."""
    sums = np.sort(coordinates[0])
    for y in coordinates[1:-1]:
        sums = np.sort((sums[:, None] + y[None]).ravel())
    if len(coordinates) == 1:
        return int((sums > total).sum())
    return int((len(sums) - np.searchsorted(sums, total - coordinates[-1], side="right")).sum())


def _entries(vectors: DataFrame, keep: int) -> DataFrame:
    """embedding, ids (the smallest keep vec_ids that have it), length_class; a crowded vector is cut down part by part."""
    rows = _usable(vectors).select("embedding", "vec_id").distinct()
    salted = Window.partitionBy("embedding", F.pmod(F.xxhash64("vec_id"), F.lit(16))).orderBy("vec_id")
    least = rows.withColumn("place", F.row_number().over(salted)).where(F.col("place") <= keep)
    entry = least.groupBy("embedding").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, keep).alias("ids"))
    # The largest component is a column of its own, computed once a row; dividing by it keeps squares from overflowing.
    entry = entry.withColumn("largest", F.array_max(F.transform("embedding", lambda x: F.abs(x))))
    length = F.col("largest") * F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + (x / F.col("largest")) * (x / F.col("largest"))))
    return entry.withColumn("length_class", F.floor(F.log(length) / log(BAND) + 0.5).cast("int")).drop("largest")


def _class() -> Column:
    """A name that equal vectors share: 128 bits of hashes."""
    return F.concat_ws(":", F.xxhash64("embedding"), F.xxhash64(F.lit(7), "embedding"))


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(v.isNotNull() & (F.size(v) > 0) & F.col("vec_id").isNotNull())
    return rows.where(finite).where(F.exists(v, lambda x: x != 0))

"""Joins that score all pairs: every pair is compared, only the best become rows."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions.providers import OfflineProvider
from tessera.functions.similarity import indel_ratio
from tessera.operators import block_scores, smart_join


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(block_scores, "BLOCK_ROWS", 7)
    monkeypatch.setattr(block_scores, "LEFT_ROWS", 4)


def _counted(spark, monkeypatch, name):
    """Counts the pairs that become rows and are scored one by one."""
    made, plain = spark.sparkContext.accumulator(0), getattr(smart_join, name)

    def count(x):
        made.add(1)
        return x

    monkeypatch.setattr(smart_join, name, lambda a, b: F.udf(count, "double")(plain(a, b)))
    return made


def _best(pairs, k):
    """(left, right, score) in the order of the join: by score, then by the larger right index."""
    out = {}
    for left, right, score in sorted(pairs, key=lambda p: (p[0], -p[2], -p[1])):
        out.setdefault(left, []).append((right, round(score, 9)))
    return {left: rows[:k] for left, rows in out.items()}


def _found(top):
    out = {}
    for r in top.orderBy("left_idx", "rank").collect():
        out.setdefault(r.left_idx, []).append((r.right_idx, round(r.score, 9)))
    return out


def test_fuzzy(spark, monkeypatch, small_blocks):
    made, rng = _counted(spark, monkeypatch, "fuzzy_ratio"), random.Random(3)
    texts = ["", "abba", "naïve 𝒳", "x" * 70 + "ab", "ab" * 64, *("".join(rng.choices("abc", k=rng.randrange(1, 9))) for _ in range(30))]
    left, right = ([(i, rng.choice(["n", None]), rng.choice([*texts, None])) for i in range(n)] for n in (40, 60))
    frames = [spark.createDataFrame(rows, "k long, g string, v string") for rows in (left, right)]
    top = smart_join.candidates(*frames, "3: g exact_match, v fuzzy_match 1.5", left_key="k", right_key="k")[2]
    assert _found(top) == _best([(a, b, indel_ratio(x or "", y or "") ** 1.5) for a, g, x in left for b, h, y in right if g == h], 3)
    made.value = 0
    top.collect()
    assert made.value <= 3 * len(left)


def test_semantic(spark, monkeypatch, small_blocks):
    made, rng = _counted(spark, monkeypatch, "unit_cosine"), random.Random(4)
    vectors = [None, [0.0, 0.0, 0.0], [1.0, 2.0], [float("nan"), 1.0, 0.0], *([float(rng.randrange(-2, 3)) for _ in range(3)] for _ in range(25))]
    left, right = ([(i, rng.choice(vectors)) for i in range(n)] for n in (30, 45))
    frames = [spark.createDataFrame(rows, "k long, v array<double>") for rows in (left, right)]
    top = smart_join.candidates(*frames, "4: v semantic_distance 1", left_key="k", right_key="k")[2]

    def cosine(x, y):
        x, y = (np.array(v if v and any(v) else [0.0]) for v in (x, y))
        if len(x) != len(y):
            return 0.0
        with np.errstate(all="ignore"):
            found = x @ y / np.sqrt((x @ x) * (y @ y)) if x.any() and y.any() else 0.0
        return float("inf") if np.isnan(found) else max(0.0, float(found))

    got = {a: [s if s == s else float("inf") for _, s in rows] for a, rows in _found(top).items()}
    want = _best([(a, b, cosine(x, y)) for a, x in left for b, y in right], 4)
    assert {a: [round(s, 9) for _, s in rows] for a, rows in want.items()} == got
    made.value = 0
    top.collect()
    assert made.value <= 4 * len(left)


def test_join_test_lists_what_scores_0_too(spark, monkeypatch, small_blocks):
    made, rng = _counted(spark, monkeypatch, "fuzzy_ratio"), random.Random(6)
    left, right = ([(i, rng.choice(["a", "b", "c", None, f"alone {i}"]), rng.choice(["", "x", "xy", "zz"])) for i in range(n)] for n in (30, 50))
    frames = [spark.createDataFrame(rows, "k long, g string, v string") for rows in (left, right)]
    rows = smart_join.llm_join_test(*frames, "9: g exact_match, v fuzzy_match 1", left_key="k", right_key="k").collect()
    want = _best([(a, b, indel_ratio(x, y) * (g == h)) for a, g, x in left for b, h, y in right], 9)
    got = {r.row_index: [(json.loads(c["right_row"])["k"], round(c["score"], 9)) for c in json.loads(r.candidates_json)] for r in rows}
    assert got == want and made.value <= 2 * 2 * 9 * len(left)


@pytest.fixture(scope="module")
def many_suppliers(spark, tmp_path_factory):
    """One supplier more than a paid provider may be asked about."""
    n, folder = smart_join.LEFT_LIMIT + 1, str(tmp_path_factory.mktemp("many"))
    spark.range(n).selectExpr("id AS s_suppkey", "concat('Supplier#', id) AS s_name", "cast(id % 25 AS int) AS s_nationkey", "cast(id % 97 AS double) AS s_acctbal").write.parquet(f"{folder}/supplier.parquet")
    spark.range(100).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", "cast(id % 25 AS int) AS c_nationkey", "cast(id AS double) AS c_acctbal").write.parquet(f"{folder}/customer.parquet")
    spark.range(25).selectExpr("cast(id AS int) AS n_nationkey", "concat('Nation ', id) AS n_name", "cast(id % 5 AS int) AS n_regionkey").write.parquet(f"{folder}/nation.parquet")
    return folder, n


class _Paid(OfflineProvider):
    pass


def test_paid_calls_are_limited(spark):
    one = spark.range(smart_join.LEFT_LIMIT + 1).selectExpr("id AS k", "'a' AS n")
    for provider in (_Paid(), OfflineProvider(input_price=1e-6)):
        with pytest.raises(ValueError, match="more than"):
            smart_join.llm_join(one, one.limit(1), "1: n exact_match", provider=provider)


def test_clash_join_takes_every_row(spark, many_suppliers):
    folder, n = many_suppliers
    rows = entry.queries()["clash_join"](spark, folder)
    assert rows.count() == n and rows.where("left_nation = right_nation AND right_idx IS NOT NULL AND join_confidence = 1").count() == n


def test_engine_join_takes_every_row(spark, many_suppliers):
    folder, n = many_suppliers
    rows = entry.queries()["engine_join"](spark, folder)
    assert rows.count() == n and rows.where("left_s_nationkey IS NOT NULL AND right_n_name = concat('Nation ', left_s_nationkey) AND join_confidence = 1").count() == n


def test_join_decision_takes_every_row(spark, many_suppliers):
    folder, n = many_suppliers
    rows = entry.queries()["join_decision"](spark, folder)
    assert rows.count() == n and rows.where("right_key % 25 = left_nation AND join_confidence > 0.5").count() == n


def test_join_gate_null_takes_every_row(spark, many_suppliers):
    folder, n = many_suppliers
    rows = entry.queries()["join_gate_null"](spark, folder)
    assert rows.count() == n and rows.where("right_key IS NULL AND join_confidence = 0").count() == n

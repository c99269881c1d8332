"""Registered queries of the SQL front end, sources, sinks and streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.llm import cached_answers, with_usage
from tessera.functions.providers import OfflineProvider
from tessera.functions.schema import TableSchema, column
from tessera.operators.smart_join import llm_join
from tessera.operators.tables import page, sampled, without_ordinals
from tessera.operators.transform import pattern_warnings
from tessera.plans.engine import Engine
from tessera.plans.queries import _LABEL, _both, _top, query, table
from tessera.plans.staging import staging_dir
from tessera.sources.tables import export_csv, list_tables, load_csv
from tessera.streaming.events import event_stream, windowed_counts

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _engine(spark: SparkSession, sf_dir: str, text: str, name: str = "q") -> DataFrame:
    """A script through the front end, over views of the tables that it names."""
    for t in _TABLES:
        if t in text:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return Engine(spark).sql(text).df


def _dialect(name: str, sql: str) -> None:
    """One text for both sides: the database runs it as it is, Spark through the front end."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _engine(spark, sf_dir, sql)

    run.__name__ = name
    query(sql)(run)


_dialect("dialect_strings", r"""SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_') AS first_vowel, regexp_replace(p_name, '([a-z])([0-9])', '\2\1', 'g') AS swapped, regexp_extract(p_name, '\d+') AS digits,
 concat(p_brand, NULL, '-', p_size) AS label, string_split(p_name, ' ')[1] AS word, split_part(p_type, ' ', 2) AS kind, len(p_name)::BIGINT AS size, strpos(p_type, 'E')::BIGINT AS at_e, starts_with(p_brand, 'Brand') AS branded, regexp_matches(p_type, 'STEEL$') AS steel, strip_accents('é' || p_brand) AS plain, sha256(p_name) AS digest FROM part""")
_dialect("dialect_dates", """SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y at %H:%M') AS shown, date_diff('month', timestamp '1992-01-15 00:00:00', o_orderdate) AS months, date_diff('day', timestamp '1992-01-15 00:00:00', o_orderdate) AS days, dayofweek(o_orderdate)::BIGINT AS weekday,
 date_part('quarter', o_orderdate)::BIGINT AS quarter FROM orders""")
_dialect("dialect_numbers", "SELECT c_custkey, c_custkey // 7 AS whole, round(log(c_custkey + 1), 6) AS tens, round(ln(c_custkey + 1), 6) AS natural, round(c_custkey / 7, 6) AS share, greatest(c_nationkey, NULL, 10)::BIGINT AS most, try_cast(c_name AS BIGINT) AS number, sign(c_acctbal)::BIGINT AS side FROM customer")
_dialect("list_functions", """SELECT o_orderkey, array_to_string(list_sort([o_orderkey, 9, 100, 10]), ',') AS sorted, list_contains([o_orderkey % 5, 3], 3) AS has_three, list_reduce(list_transform([1, 2, 3], lambda x: x * o_orderkey), lambda a, b: a + b)::BIGINT AS total,
 len(list_filter(range(0, 10), lambda x: x % 3 = o_orderkey % 3))::BIGINT AS third, array_to_string(list_slice(['a', 'b', 'c', 'd'], 2, 3), '') AS middle, [10, 20, 30][(o_orderkey % 4)::INT + 1]::BIGINT AS picked FROM orders""")
_dialect("dialect_structs", """SELECT event_id, {'kind': event_type, 'at': {'user': user_id}}.at.user AS user_, map {'a': user_id, 'b': event_id}['b'] AS mapped, struct_pack(v := value).v AS value_, props::json->>'k' AS k, json_extract_string(props, '$.k') AS same_k, json_keys(props)[1] AS first_key FROM events""")
_dialect("dialect_aggregates", """SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS priorities, arg_max(o_orderkey, o_totalprice) AS dearest, round(quantile_cont(o_totalprice, 0.5), 4) AS middle, array_to_string(list_slice(array_agg(o_orderkey ORDER BY o_orderkey DESC), 1, 3), ',') AS last_keys FROM orders GROUP BY o_orderstatus""")
_dialect("dialect_qualify", "SELECT * EXCLUDE (o_totalprice, o_orderdate) FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 2")


@query("SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation WHERE n_nationkey >= 5")
def engine_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same call before and after its source is replaced."""
    t = f"source_{uuid.uuid4().hex}"
    call = f"SELECT * FROM llm_table_to_table('{t}', 'TABLE t (k BIGINT, name VARCHAR)')"
    make = f"CREATE OR REPLACE TEMP TABLE {t} AS SELECT n_nationkey AS k, n_name AS name FROM nation"
    return _engine(spark, sf_dir, f"{make} WHERE n_nationkey < 5; {call}; {make} WHERE n_nationkey >= 5; {call}")


@query("SELECT s_suppkey AS left_s_suppkey, s_nationkey AS left_s_nationkey, n_name AS right_n_name, 1.0::DOUBLE AS join_confidence FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def engine_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT left_s_suppkey, left_s_nationkey, right_n_name, join_confidence FROM llm_join('SELECT s_suppkey, s_nationkey, s_nationkey AS nation FROM supplier', 'SELECT n_nationkey AS nation, n_name FROM nation', '1: nation exact_match', 'the nation')"
    return _engine(spark, sf_dir, text)


@query("SELECT k, _at, _part, _place, _before FROM (SELECT o_orderkey AS k, o_custkey AS _at, o_orderstatus AS _part, o_totalprice AS _place, o_orderpriority AS _before, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) WHERE n NOT IN (1, 5)")
def clash_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey AS _at", "o_orderstatus AS _part", "o_totalprice AS _place", "o_orderpriority AS _before")
    return without_ordinals(o, ["k"], [1, 5])


@query("SELECT s_suppkey AS left_left_idx, s_name AS left_confidence, s_nationkey AS left_nation, n_nationkey AS right_nation, n_name AS right_idx, n_regionkey AS right_right_idx, 1.0::DOUBLE AS join_confidence FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def clash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS left_idx", "s_name AS confidence", "s_nationkey AS nation")
    n = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS nation", "n_name AS idx", "n_regionkey AS right_idx")
    return llm_join(s, n, "1: nation exact_match", "the nation")


@query()
def join_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three likeliest customers of a supplier's nation by name; too slow in SQL on whole tables."""
    return _top(spark, sf_dir, "3: nation exact_match, name fuzzy_match 1.0")


@query("SELECT s_suppkey AS supplier_key, s_name AS _2_name, s_nationkey AS _order, s_acctbal AS account_balance FROM supplier")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV under awkward headings, read back with inferred types and normalised names."""
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS `Supplier Key`", "s_name AS `2 Name`", "s_nationkey AS `ORDER`", "s_acctbal AS `account (balance)`")
    path = export_csv(s, f"{staging_dir(spark)}/suppliers-{uuid.uuid4().hex}", single=False)
    return load_csv(spark, path)[1]


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 200")
def page_of_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 2)


@query("SELECT least(50, (SELECT count(*) FROM orders WHERE o_totalprice > 100000)) AS n, TRUE AS repeatable, TRUE AS filtered FROM region LIMIT 1")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 50 by seed, drawn twice."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    one, two = (sampled(o, 50, seed=7, where="o_totalprice > 100000") for _ in range(2))
    both = one.join(two.select("o_orderkey"), "o_orderkey")
    again = both.agg(F.count("*").alias("met"))
    return one.agg(F.count("*").alias("n"), F.bool_and(F.col("o_totalprice") > 100000).alias("filtered")).crossJoin(again).select("n", (F.col("n") == F.col("met")).alias("repeatable"), "filtered")


@query("SELECT least(40, count(*)) AS n FROM orders")
def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _engine(spark, sf_dir, "SELECT o_orderkey FROM orders USING SAMPLE reservoir(40 ROWS) REPEATABLE (3)")
    return rows.agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_brand, p_size, CASE WHEN p_size % 10 <> 7 THEN 'brand,size' ELSE 'brand' END AS broken FROM (SELECT *, p_brand AS brand FROM part) WHERE NOT regexp_matches(p_brand, '^Brand#[1-3]')")
def pattern_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = TableSchema("t", T.StructType([column("brand", "string", None, "^Brand#[1-3]"), column("size", "integer", None, "7$")]))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    broken = pattern_warnings(rows, spec).where(F.array_contains("violations", "brand"))
    return broken.select("p_partkey", F.col("brand").alias("p_brand"), F.col("size").alias("p_size"), F.array_join("violations", ",").alias("broken"))


_PRICES = f"ceil(length(p_name) / 4.0) * 2e-6 + ceil(length({_LABEL.format('p_name')}) / 4.0) * 8e-6"


@query(f"SELECT p_brand, round(sum({_PRICES}), 9) AS cost FROM part GROUP BY p_brand")
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.llm import llm

    provider = OfflineProvider(input_price=2e-6, output_price=8e-6)
    answered = table(spark, sf_dir, "part").withColumn("answer", llm(F.col("p_name"), provider))
    return with_usage(answered, "p_name", "answer", provider).groupBy("p_brand").agg(F.round(F.sum("cost"), 9).alias("cost"))


@query(f"SELECT p_partkey, {_LABEL.format('p_type')} AS answer FROM part")
def replayed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct prompt is asked once and kept; the second pass reads what the first kept."""
    path = f"{staging_dir(spark)}/answers-{uuid.uuid4().hex}"
    prompts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    cached_answers(prompts, "p_type", path)
    return cached_answers(prompts, "p_type", path).select("p_partkey", "answer")


@query("SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'supplier', count(*) FROM supplier")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    for t in ("nation", "region", "supplier"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    found = [(t["name"], t["row_count"]) for t in list_tables(spark, ["nation", "region", "supplier"])]
    return spark.createDataFrame(found, "name string, n long")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed counts of a stream over the table's files, run until all are read."""
    path = f"{staging_dir(spark)}/stream-{uuid.uuid4().hex}"
    counts = windowed_counts(event_stream(spark, sf_dir, glob="events.parquet"))
    kept = counts.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))
    run = kept.writeStream.outputMode("complete").option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    run.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path)).start().awaitTermination()
    return spark.read.parquet(path).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_both("set_except_all", "SELECT o_orderstatus AS k FROM orders EXCEPT ALL SELECT o_orderstatus FROM orders WHERE o_totalprice > 150000")
_both("set_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
_both("window_others", "SELECT o_orderkey, CAST(ntile(4) OVER w AS BIGINT) AS quarter, round(percent_rank() OVER w, 6) AS place, round(cume_dist() OVER w, 6) AS reach, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)")
_both("window_range", "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS near FROM customer")
_both("join_range", "SELECT s_suppkey, count(c_custkey) AS n FROM supplier LEFT JOIN customer ON c_nationkey = s_nationkey AND c_acctbal BETWEEN s_acctbal - 1000 AND s_acctbal + 1000 GROUP BY s_suppkey")

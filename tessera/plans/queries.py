"""Registered queries of the engine's own operators over the relational and corpus tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.llm import llm, with_usage
from tessera.functions.similarity import fuzzy_ratio
from tessera.operators.smart_join import candidates, llm_join, llm_join_test
from tessera.operators.tables import as_of, prefixed, renamed, union_sources, upserted, without_ordinals
from tessera.operators.transform import llm_table_to_table
from tessera.sources.documents import annotated, llm_pdf_to_table, readability

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name"))
    return s, c


def _top(spark: SparkSession, sf_dir: str, algorithm: str, decimals: int = 6) -> DataFrame:
    s, c = _sides(spark, sf_dir)
    left, right, top = candidates(s, c, algorithm, left_key="key", right_key="key")
    keys = top.join(left.select("left_idx", F.col("key").alias("left_key")), "left_idx").join(right.select("right_idx", F.col("key").alias("right_key")), "right_idx")
    return keys.select("left_key", "right_key", "rank", F.round("score", decimals).alias("score"))


def _top_sql(parts: list[tuple[str, float]], k: int, where: str = "TRUE", before: str = "") -> str:
    score = " * ".join(f"pow({p}, {w!r})" for p, w in parts)
    return f"""
WITH l AS (SELECT s_suppkey AS key, s_nationkey AS nation, s_acctbal AS balance, s_name AS name FROM supplier),
r AS (SELECT c_custkey AS key, c_nationkey AS nation, c_acctbal AS balance, c_name AS name FROM customer),
far AS (SELECT greatest(abs((SELECT max(balance) FROM l) - (SELECT min(balance) FROM r)), abs((SELECT max(balance) FROM r) - (SELECT min(balance) FROM l))) AS d){before},
p AS (SELECT l.key AS left_key, r.key AS right_key, {score} AS score FROM l JOIN r ON {where}),
t AS (SELECT *, row_number() OVER (PARTITION BY left_key ORDER BY score DESC, right_key DESC) AS rank FROM p)
SELECT left_key, right_key, rank, round(score, 6) AS score FROM t WHERE rank <= {k}"""


_GOLD = (5**0.5 - 1) / 2
_DISTANCE = "(1 - abs(l.balance - r.balance) / (SELECT d FROM far))"
_PLACES = """,
rr AS (SELECT key, row_number() OVER (ORDER BY balance, key) - 1 AS place, count(*) OVER () AS n FROM r),
lr AS (SELECT l.key, (SELECT count(*) FROM r WHERE r.balance < l.balance) AS place FROM l)"""


@query(_top_sql([("1.0", 1.0), (_DISTANCE, _GOLD)], 3, "l.nation IS NOT DISTINCT FROM r.nation"))
def join_exact_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, "3: nation exact_match, balance numeric_distance")


@query(_top_sql([("CASE WHEN l.nation IS NOT DISTINCT FROM r.nation THEN 1.0 ELSE 0.0 END", 1.0)], 2, "l.nation IS NOT DISTINCT FROM r.nation"))
def join_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, "2: nation exact_match")


@query(_top_sql([(_DISTANCE, 2.0)], 3))
def join_numeric_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, "3: balance numeric_distance 2.0")


def _rank_sql(place: str) -> str:
    score = f"1 / (1 + abs((SELECT place FROM lr WHERE lr.key = l.key) - {place}) / (SELECT max(n) FROM rr)::DOUBLE)"
    return _top_sql([(score, 1.0)], 3, "TRUE", _PLACES).replace("FROM l JOIN r ON TRUE", "FROM l JOIN r ON TRUE JOIN rr ON rr.key = r.key")


@query(_rank_sql("rr.place"))
def join_rank_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, "3: balance arithmetic_asc")


@query(_rank_sql("(rr.n - 1 - rr.place)"))
def join_rank_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, "3: balance arithmetic_desc")


_LCS = """
WITH RECURSIVE n AS (SELECT n_nationkey AS k, n_name AS s FROM nation), p AS (SELECT a.k AS ak, b.k AS bk, a.s AS a, b.s AS b FROM n a, n b),
dp AS (SELECT ak, bk, a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: 0) AS line FROM p
  UNION ALL
  SELECT ak, bk, a, b, i + 1, list_reduce(range(1, length(b) + 1), lambda acc, j: list_append(acc, CASE WHEN a[i + 1] = b[j::INT] THEN line[j::INT] + 1 ELSE greatest(line[j::INT + 1], acc[len(acc)]) END), [0]) FROM dp WHERE i < length(a))
SELECT ak AS left_key, bk AS right_key, round(CASE WHEN length(a) + length(b) = 0 THEN 1.0 ELSE 2.0 * line[length(b) + 1] / (length(a) + length(b)) END, 6) AS ratio FROM dp WHERE i = length(a)"""


@query(_LCS)
def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    pairs = n.select(F.col("n_nationkey").alias("left_key"), F.col("n_name").alias("a")).crossJoin(n.select(F.col("n_nationkey").alias("right_key"), F.col("n_name").alias("b")))
    return pairs.select("left_key", "right_key", F.round(fuzzy_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query("""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT q.vec_id AS left_key, e.vec_id AS right_key, round(greatest(list_cosine_similarity(q.v, e.v), 0.0), 6) AS score FROM e q, e),
t AS (SELECT *, row_number() OVER (PARTITION BY left_key ORDER BY score DESC, right_key DESC) AS rank FROM p)
SELECT left_key, round(sum(score), 4) AS top_sum, max(score) AS best FROM t WHERE rank <= 5 GROUP BY left_key""")
def join_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    left, _, top = candidates(e, e, "5: embedding semantic_distance 1.0", left_key="vec_id", right_key="vec_id")
    found = top.join(left.select("left_idx", F.col("vec_id").alias("left_key")), "left_idx")
    return found.groupBy("left_key").agg(F.round(F.sum(F.round("score", 6)), 4).alias("top_sum"), F.max(F.round("score", 6)).alias("best"))


_BEST = _top_sql([("1.0", 1.0), (_DISTANCE, _GOLD)], 1, "l.nation IS NOT DISTINCT FROM r.nation")


@query(f"""
WITH b AS ({_BEST})
SELECT s_suppkey AS left_key, s_nationkey AS left_nation, CASE WHEN b.score >= 0.5 THEN b.right_key END AS right_key, round(coalesce(b.score, 0.0), 3) AS join_confidence
FROM supplier LEFT JOIN b ON b.left_key = s_suppkey""")
def join_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = _sides(spark, sf_dir)
    found = llm_join(s, c, "3: nation exact_match, balance numeric_distance", "the customer nearest by balance", left_key="key", right_key="key")
    return found.select("left_key", "left_nation", "right_key", F.round("join_confidence", 3).alias("join_confidence"))


@query("SELECT s_suppkey AS left_key, NULL::BIGINT AS right_key, 0.0::DOUBLE AS join_confidence FROM supplier")
def join_gate_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = _sides(spark, sf_dir)
    far = c.withColumn("nation", F.col("nation") + 1000)
    return llm_join(s, far, "3: nation exact_match", "no nation agrees", left_key="key", right_key="key").select("left_key", "right_key", "join_confidence")


@query("""
SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS row_index, s_suppkey AS left_key, least(3, (SELECT count(*) FROM customer)) AS n_candidates, TRUE AS undecided, 0.0::DOUBLE AS row_cost FROM supplier""")
def join_test_dry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = _sides(spark, sf_dir)
    found = llm_join_test(s, c, "3: nation exact_match, balance numeric_distance", "preview", left_key="key", right_key="key")
    return found.select("row_index", F.get_json_object("left_row_json", "$.key").cast("long").alias("left_key"), F.json_array_length("candidates_json").cast("long").alias("n_candidates"), F.col("llm_decision_json").isNull().alias("undecided"), "row_cost")


_LABEL = "list_extract(['positive', 'neutral', 'negative'], (1 + ('0x' || substr(md5({0}), 1, 4))::INT % 3)::INT)"


@query(f"SELECT p_partkey, {_LABEL.format('p_name')} AS label FROM part")
def llm_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", llm(F.col("p_name")).alias("label"))


@query(f"SELECT {_LABEL.format('p_brand || p_type')} AS label, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part WHERE {_LABEL.format('p_name')} = 'positive' GROUP BY 1")
def llm_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "part").where(llm(F.col("p_name")) == "positive")
    return kept.withColumn("label", llm(F.concat("p_brand", "p_type"))).groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@query(f"SELECT p_brand, count(*) AS calls, sum(ceil(length(p_name) / 4.0))::BIGINT AS input_tokens, sum(ceil(length({_LABEL.format('p_name')}) / 4.0))::BIGINT AS output_tokens FROM part GROUP BY 1")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered = table(spark, sf_dir, "part").withColumn("answer", llm(F.col("p_name")))
    return with_usage(answered, "p_name", "answer").groupBy("p_brand").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


@query("SELECT c_custkey, c_mktsegment, c_acctbal, NULL::VARCHAR AS remark FROM customer")
def table_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = "TABLE segments (c_custkey BIGINT, c_mktsegment VARCHAR, c_acctbal DOUBLE, remark VARCHAR)"
    return llm_table_to_table(table(spark, sf_dir, "customer"), spec, "keep the columns", {"rows_per_call": 200})


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: a document's lines, one page each."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.posexplode(F.split("text", "\n")).alias("k", "text"))
    return docs.select("path", (F.col("k") + 1).alias("page_no"), "text")


@query("SELECT doc_id::VARCHAR AS path, len(string_split(text, chr(10)))::BIGINT AS n_pages, length(text)::BIGINT AS n_chars, length(text) >= 500 * len(string_split(text, chr(10))) AS readable FROM documents")
def page_readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readability(_pages(spark, sf_dir))


@query(r"""
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
u AS (SELECT doc_id, l, unnest(range(2, least(3, len(l)) + 1)) AS n FROM p WHERE len(l) >= 2)
SELECT doc_id::VARCHAR AS path, string_agg('[START OF PAGE ' || n || ']' || chr(10) || l[n::INT] || chr(10) || '[END OF PAGE ' || n || ']', chr(10) ORDER BY n) AS text FROM u GROUP BY doc_id""")
def page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotated(_pages(spark, sf_dir), 2, 3)


@query("SELECT text, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("SELECT DISTINCT c_custkey::VARCHAR AS path, c_name AS name, c_acctbal AS balance FROM customer")
def document_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of `column: value` lines per customer, every one twice; extraction drops the repeats."""
    block = F.concat(F.lit("name: "), F.col("c_name"), F.lit("\nbalance: "), F.col("c_acctbal").cast("string"))
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.lit(1).alias("page_no"), F.concat_ws("\n", block, block).alias("text"))
    spec = 'TABLE t WITH COLUMNS [{"name": "name", "type": "string"}, {"name": "balance", "type": "number"}]'
    return llm_pdf_to_table(pages, spec, with_path=True)


@query("SELECT 'supplier' AS source_pdf, s_suppkey AS key, s_name AS name FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name FROM customer")
def batch_union_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = _sides(spark, sf_dir)
    return union_sources({"supplier": s.select("key", "name"), "customer": c.select("key", "name")}, "source_pdf")


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) WHERE k NOT IN (0, 3, 8, 100)")
def remove_rows_by_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_ordinals(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], [0, 3, 8, 100, 10**12])


@query("SELECT s_name AS name, s_suppkey AS s_suppkey, s_nationkey, s_acctbal FROM supplier")
def rename_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return renamed(table(spark, sf_dir, "supplier"), {"s_name": "name"})


@query("SELECT n_nationkey AS left_n_nationkey, n_name AS left_n_name, n_regionkey AS left_n_regionkey FROM nation")
def prefix_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixed(table(spark, sf_dir, "nation"), "left_")


@query("SELECT event_type, json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY ALL")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k long"))
    again = e.select("event_type", F.from_json(F.to_json("p", {"ignoreNullFields": "false"}), "k long").alias("p"))
    return again.groupBy("event_type", F.col("p.k").alias("k")).agg(F.count("*").alias("n"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def agg_groupby(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_base_price"), F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"),
    )


def _both(name: str, sql: str, spark_sql: str | None = None) -> None:
    """A statement that Spark runs as it is (or in its own words) over views of the tables it names."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = spark_sql or sql
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
            if t in text:
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(text)

    run.__name__ = name
    query(sql)(run)


_both("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_both("agg_cube", "SELECT p_brand, p_size % 5 AS size_group, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_size % 5)")
_both("agg_grouping_sets", "SELECT c_nationkey, c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ())")
_both("agg_filter_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_totalprice > 100000) AS large FROM orders GROUP BY o_orderstatus")
_both("agg_array", "SELECT o_custkey, array_agg(o_orderkey ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey", "SELECT o_custkey, array_sort(array_agg(o_orderkey)) AS orders FROM orders GROUP BY o_custkey")
_both("window_rank", "SELECT o_custkey, o_orderkey, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS d, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)")
_both("window_frame", "SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near, first_value(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS first_part FROM lineitem")
_both("set_union", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
_both("set_intersect", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer")
_both("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
_both("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
_both("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
_both("join_full_outer", "SELECT s.s_nationkey AS supplier_nation, c.c_nationkey AS customer_nation, count(*) AS n FROM supplier s FULL OUTER JOIN (SELECT * FROM customer WHERE c_nationkey < 12) c ON s.s_nationkey = c.c_nationkey GROUP BY 1, 2")
_both("correlated_subquery", "SELECT c_custkey, c_acctbal FROM customer c WHERE c_acctbal > (SELECT avg(d.c_acctbal) FROM customer d WHERE d.c_nationkey = c.c_nationkey)")
_both("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_both("region_revenue", "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name")
_both("scalar_functions", "SELECT p_partkey, upper(p_brand) AS u, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, regexp_extract(p_name, '([0-9]+)', 1) AS digits, greatest(p_size, 10) AS least_ten, coalesce(nullif(p_size, 1), -1) AS not_one, levenshtein(p_brand, p_type) AS edits FROM part", "SELECT p_partkey, upper(p_brand) AS u, lpad(CAST(p_size AS STRING), 4, '0') AS padded, regexp_extract(p_name, '([0-9]+)', 1) AS digits, greatest(p_size, 10) AS least_ten, coalesce(nullif(p_size, 1), -1) AS not_one, CAST(levenshtein(p_brand, p_type) AS BIGINT) AS edits FROM part")
_both("date_functions", "SELECT date_part('year', o_orderdate) AS y, date_part('month', o_orderdate) AS m, count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day FROM orders GROUP BY 1, 2", "SELECT CAST(date_part('year', o_orderdate) AS BIGINT) AS y, CAST(date_part('month', o_orderdate) AS BIGINT) AS m, count(*) AS n, date_format(min(o_orderdate), 'yyyy-MM-dd') AS first_day FROM orders GROUP BY 1, 2")


@query("""
SELECT o.o_orderkey, o.o_custkey, o.o_orderdate, e.value AS last_value FROM (SELECT o_orderkey, o_custkey, o_orderdate FROM orders) o
ASOF LEFT JOIN (SELECT user_id, ts, max_by(value, event_id) AS value FROM events GROUP BY ALL) e ON o.o_custkey = e.user_id AND o.o_orderdate >= e.ts""")
def asof_last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("o_custkey"), F.col("ts").alias("o_orderdate")).agg(F.max_by("value", "event_id").alias("value"))
    return as_of(o, e, "o_custkey", "o_orderdate", "value", "last_value")


@query("SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def upsert_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserted(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_id")


@query("SELECT user_id, sum(gap) AS sessions FROM (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS gap FROM events) GROUP BY user_id")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    apart = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag(F.col("ts").cast("timestamp")).over(w))
    return table(spark, sf_dir, "events").withColumn("gap", F.when(apart <= 30 * 60 * 10**6, 0).otherwise(1)).groupBy("user_id").agg(F.sum("gap").alias("sessions"))

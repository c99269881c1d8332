import pytest
from pyspark.sql import functions as F

from tessera.functions.llm import cached_answers, llm
from tessera.operators.tables import sampled, union_sources, without_ordinals
from tessera.operators.transform import llm_table_to_table, pattern_warnings
from tessera.functions.schema import parse_schema
from tessera.plans import sql_text
from tessera.plans.engine import Engine
from tessera.plans.progress import Progress
from tessera.sources.documents import UnreadableDocument, annotated, llm_pdf_to_table, markdown_table, readability, require_readable
from tessera.sources.tables import export_csv, load_csv, normalised_names, safe_name
from tessera.streaming.events import event_stream, windowed_counts


NAMES = ("llm_join", "llm_pdf_to_table")


def test_statements_and_calls():
    assert sql_text.statements("select ';' ; -- x;\n select 2;") == ["select ';'", "-- x;\n select 2"]
    found = sql_text.calls("SELECT * FROM llm_join('it''s', 'SELECT 1; x') JOIN llm_pdf_to_table('p', 's')", NAMES)
    assert [(c.name, c.arguments) for c in found] == [("llm_pdf_to_table", ["p", "s"]), ("llm_join", ["it's", "SELECT 1; x"])]
    with pytest.raises(ValueError):
        sql_text.calls("SELECT llm_join('a', 'b')", NAMES)
    with pytest.raises(ValueError):
        sql_text.calls("SELECT * FROM llm_join(a, b)", NAMES)


def test_dialect(spark):
    engine = Engine(spark)
    spark.range(6).selectExpr("id", "id % 2 AS k").createOrReplaceTempView("numbers")
    assert engine.sql("SELECT * EXCLUDE (k) FROM numbers").df.columns == ["id"]
    assert engine.sql("SELECT [1, 2] AS a").df.first().a == [1, 2]
    got = engine.sql("SELECT id, k FROM numbers QUALIFY row_number() OVER (PARTITION BY k ORDER BY id) = 1 ORDER BY id").df
    assert got.columns == ["id", "k"] and [r.id for r in got.collect()] == [0, 1]
    one, two = (sorted(r.id for r in engine.sql("SELECT id FROM numbers USING SAMPLE reservoir(3 ROWS) REPEATABLE (5)").df.collect()) for _ in range(2))
    assert one == two and len(one) == 3
    assert engine.sql("SELECT strip_accents('é') AS a, epoch(timestamp '1970-01-01 00:00:02') AS e").df.first() == ("e", 2.0)


def test_later_statements_read_earlier_tables(spark):
    engine, told = Engine(spark), []
    progress = Progress(told=told.append)
    got = engine.sql("CREATE OR REPLACE TEMP TABLE made AS SELECT 1 AS a; SELECT * FROM llm_table_to_table('SELECT * FROM made', 'TABLE t (a INTEGER, b VARCHAR)') x", progress)
    assert [tuple(r) for r in got.df.collect()] == [(1, None)]
    assert told == [0, 50, 100] and engine.submit("SELECT 2 AS b").result(60).first().b == 2
    assert engine.sql("SELECT * FROM llm_join('made', 'SELECT * FROM llm_table_to_table(''made'', ''TABLE t (a INTEGER)'')', '1: a exact_match', 'task')").df.first().right_a == 1


def test_llm(spark):
    rows = spark.createDataFrame([("a",), (None,), ("a",)], "p string")
    got = [r.x for r in rows.select(llm(F.col("p")).alias("x")).collect()]
    assert got[0] == got[2] and got[1] is None and got[0] in ("positive", "neutral", "negative")


def test_cache(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "p string")
    for _ in range(2):
        got = cached_answers(rows, "p", str(tmp_path / "cache")).collect()
        assert sum(r.answer is None for r in got) == 1 and len(got) == 3
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2


def test_documents(spark, tmp_path):
    pages = spark.createDataFrame([("d", 1, "x" * 499), ("d", 2, "y" * 500), ("e", 1, "z" * 498)], "path string, page_no int, text string")
    assert {(r.path, r.n_chars, r.readable) for r in readability(pages).collect()} == {("d", 1000, True), ("e", 498, False)}
    with pytest.raises(UnreadableDocument):
        require_readable(pages)
    short = spark.createDataFrame([("d", k, str(k)) for k in (1, 2, 3)], pages.schema)
    assert annotated(short, 2, 3).first().text == "[START OF PAGE 2]\n2\n[END OF PAGE 2]\n[START OF PAGE 3]\n3\n[END OF PAGE 3]"
    spec = 'TABLE t WITH COLUMNS [{"name": "name", "type": "string"}, {"name": "total", "type": "number"}]'
    text = "# A\nname: Ann\ntotal: 2\nname: Bob\n# B\nname: Ann\ntotal: 2"
    got = llm_pdf_to_table(spark.createDataFrame([("d", 1, text)], pages.schema), spec)
    assert sorted(map(tuple, got.collect())) == [("Ann", 2.0), ("Bob", None)]
    empty = llm_pdf_to_table(spark.createDataFrame([("d", 1, "nothing")], pages.schema), spec)
    assert empty.columns == ["name", "total"] and empty.count() == 0
    for name in ("one", "two"):
        (tmp_path / f"{name}.txt").write_text("name: Ann\ntotal: 2\n" + "." * 600)
    made = Engine(spark).batch_documents("batch", spec, [str(tmp_path / "one.txt"), str(tmp_path / "two.txt")])
    assert sorted(map(tuple, made.collect())) == [("one", "Ann", 2.0), ("two", "Ann", 2.0)]


def test_table_transform(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y1")], "a int, b string")
    spec = parse_schema('TABLE t WITH COLUMNS [{"name": "b", "type": "string", "pattern": "^[a-z]$"}]')
    got = llm_table_to_table(rows, spec, options='{"rows_per_call": 1}')
    assert sorted(r.b for r in got.collect()) == ["x", "y1"]
    assert [r.violations for r in pattern_warnings(got, spec).collect()] == [["b"]]
    assert llm_table_to_table(rows, spec, options={"partition_by": "a"}).count() == 2
    assert llm_table_to_table(rows.limit(0), spec).count() == 0


def test_tables(spark, tmp_path):
    assert normalised_names(["First Name", "2nd-Col", "select", "a", "A"]) == ["first_name", "_2ndcol", "_select", "a", "a_1"]
    (tmp_path / "my data.csv").write_text("Id,Full Name\n1,Ann\n2,\n")
    name, df = load_csv(spark, str(tmp_path / "my data.csv"))
    assert name == "my_data" and df.columns == ["id", "full_name"] and spark.table(name).count() == 2
    assert safe_name(spark, "my data") == "my_data_1" and safe_name(spark, "1x") == "_1x"
    out = export_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(out).count() == 2


def test_row_operators(spark):
    rows = spark.range(10).toDF("id")
    assert sorted(r.id for r in without_ordinals(rows, ["id"], [0, 9, 50, -1]).collect()) == list(range(1, 9))
    assert sampled(rows, 4, seed=1).collect() == sampled(rows, 4, seed=1).collect()
    assert union_sources({"a": rows.limit(1), "b": rows.limit(2)}, "src").groupBy("src").count().count() == 2


def test_progress():
    whole = Progress()
    a, b = whole.part("a", 3), whole.part("b")
    a.expect(4)
    a.step(2)
    b.expect(1)
    b.step(5)
    assert whole.share() == pytest.approx((3 * 0.5 + 1) / 4)
    with pytest.raises(ValueError):
        a.expect(-1)


def test_stream(spark, tmp_path):
    events = spark.createDataFrame([(k, f"2024-01-01 00:{k:02d}:00", k % 2, "t", 1.0, "{}") for k in range(30)], "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events"))
    counts = windowed_counts(event_stream(spark, str(tmp_path / "events")), "10 minutes")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("stream_counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("stream_counts").collect()) == [10, 10, 10]


def test_markdown_table():
    assert markdown_table([{"a": "x|y", "b": "1\n2"}, {"a": None}], ["a", "b"]).splitlines() == ["| |a|b|", "|---|---|---|", "|0|x\\|y|1<br>2|", "|1|||"]


def test_own_functions(spark):
    engine = Engine(spark)
    engine.register_table_function("numbered", lambda e, arguments, options, warnings: e.spark.range(int(arguments[0])).toDF("n"))
    engine.register_function("doubled", F.udf(lambda x: x * 2, "long"))
    assert [r.m for r in engine.sql("SELECT doubled(n) AS m FROM numbered(3) ORDER BY 1").df.collect()] == [0, 2, 4]
    assert "numbered" not in Engine(spark).table_functions


def test_criteria_are_checked_through_sql(spark):
    engine = Engine(spark)
    spark.createDataFrame([(1, "a")], "k int, name string").createOrReplaceTempView("checked")
    with pytest.raises(ValueError, match="doesn't fit"):
        engine.sql("SELECT * FROM llm_join('checked', 'checked', '1: name numeric_distance', '')")

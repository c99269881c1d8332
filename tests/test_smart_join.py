import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.llm import llm
from tessera.functions.providers import HttpProvider, LoggingProvider, OfflineProvider, RecordingProvider, interactions
from tessera.functions.similarity import indel_ratio
from tessera.operators.algorithm import parse_algorithm
from tessera.operators.smart_join import candidates, llm_join, llm_join_test
from tessera.operators.tables import extrapolated_cost


def test_algorithm():
    found = parse_algorithm("5: name semantic_distance, price numeric_distance 1.5, kind exact_match")
    assert found.k == 5 and [c.mechanism for c in found.criteria] == ["semantic_distance", "numeric_distance", "exact_match"]
    assert [round(c.weight, 3) for c in found.criteria] == [1.0, 1.5, 0.382]


@pytest.mark.parametrize("text", ["name fuzzy_match", "0: a exact_match", "3: a nonsense", "3: a", "x: a exact_match"])
def test_algorithm_errors(text):
    with pytest.raises(ValueError):
        parse_algorithm(text)


@given(st.text(max_size=12), st.text(max_size=12))
def test_indel(a, b):
    whole = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            whole[i + 1][j + 1] = whole[i][j] + 1 if x == y else max(whole[i][j + 1], whole[i + 1][j])
    want = 2 * whole[-1][-1] / (len(a) + len(b)) if a or b else 1.0
    assert indel_ratio(a, b) == pytest.approx(want) == indel_ratio(b, a)


def _pairs(spark, left, right, kind, algorithm, **more):
    top = candidates(spark.createDataFrame(left, f"k int, v {kind}"), spark.createDataFrame(right, f"k int, v {kind}"), algorithm, left_key="k", right_key="k", **more)[2]
    return {(r.left_idx, r.right_idx): (r["rank"], round(r.score, 6)) for r in top.collect()}


def test_numeric_distance(spark):
    got = _pairs(spark, [(0, 1.0), (1, None)], [(0, 5.0), (1, 3.0)], "double", "2: v numeric_distance 1")
    assert got == {(0, 1): (1, 0.6), (0, 0): (2, 0.2), (1, 1): (1, 0.4), (1, 0): (2, 0.0)}
    assert _pairs(spark, [(0, 2.0)], [(0, 2.0)], "double", "1: v numeric_distance") == {(0, 0): (1, 1.0)}


def test_ranks_keep_the_left_side_rising(spark):
    left, right = [(0, 10.0), (1, 25.0)], [(0, 10.0), (1, 20.0), (2, 30.0)]
    rising = _pairs(spark, left, right, "double", "3: v arithmetic_asc 1")
    assert rising[0, 0][1] == 1.0 and rising[0, 2][1] == round(1 / (1 + 2 / 3), 6) and rising[1, 2] == (1, 1.0)
    falling = _pairs(spark, left, right, "double", "3: v arithmetic_desc 1")
    assert falling[0, 2] == (1, 1.0) and falling[1, 0] == (1, 1.0)


def test_exact_ties_and_nulls(spark):
    got = _pairs(spark, [(0, "a"), (1, None)], [(0, "a"), (1, None), (2, "a")], "string", "3: v exact_match")
    assert got == {(0, 2): (1, 1.0), (0, 0): (2, 1.0), (1, 1): (1, 1.0)}
    whole = _pairs(spark, [(0, "a")], [(0, "a"), (1, "b")], "string", "5: v exact_match", blocking=False)
    assert whole == {(0, 0): (1, 1.0), (0, 1): (2, 0.0)}


def test_semantic_and_fuzzy(spark):
    got = _pairs(spark, [(0, [1.0, 0.0]), (1, None)], [(0, [1.0, 1.0]), (1, [-1.0, 0.0])], "array<double>", "2: v semantic_distance 1")
    assert got[0, 0] == (1, 0.707107) and got[0, 1] == (2, 0.0) and got[1, 0][1] == 0.0
    assert _pairs(spark, [(0, None)], [(0, "")], "string", "1: v fuzzy_match") == {(0, 0): (1, 1.0)}
    assert _pairs(spark, [(0, "kitten")], [(0, "sitting")], "string", "1: v fuzzy_match") == {(0, 0): (1, round(8 / 13, 6))}


def test_join_rows(spark):
    left = spark.createDataFrame([(0, "a", 1.0), (1, "b", 1.0), (2, "zz", 1.0)], "k int, n string, v double")
    right = spark.createDataFrame([(7, "a", 1.0), (8, "b", 9.0)], "k int, n string, v double")
    out = llm_join(left, right, "2: n exact_match, v numeric_distance 1", left_key="k", right_key="k")
    assert out.columns == ["left_k", "left_n", "left_v", "right_k", "right_n", "right_v", "join_confidence"]
    assert {(r.left_k, r.right_k, r.join_confidence) for r in out.collect()} == {(0, 7, 1.0), (1, None, 0.0), (2, None, 0.0)}
    empty = llm_join(left, right.limit(0), "2: n exact_match", left_key="k", right_key="k")
    assert [r.right_k for r in empty.collect()] == [None] * 3
    assert llm_join(left.limit(0), right, "2: n exact_match").count() == 0
    with pytest.raises(ValueError):
        llm_join(left, right, "2: n exact_match", left_limit=2)


class _Stubborn(OfflineProvider):
    def structured(self, prompt, schema, images=()):
        return {"selected_candidate": 9, "confidence": 0.7}


def test_out_of_range_choice_is_no_match(spark):
    one = spark.createDataFrame([(0, "a")], "k int, n string")
    row = llm_join(one, one, "2: n exact_match", provider=_Stubborn()).first()
    assert row.right_k is None and row.join_confidence == 0.7


def test_join_test(spark):
    one = spark.createDataFrame([(0, "a"), (1, "c")], "k int, n string")
    dry = llm_join_test(one, one, "2: n exact_match", left_key="k", right_key="k").orderBy("row_index").collect()
    assert [r.llm_decision_json for r in dry] == [None, None] and len(json.loads(dry[0].candidates_json)) == 2
    assert set(json.loads(dry[0].candidates_json)[0]) == {"right_row", "right_row_alg_cols", "score", "breakdown"}
    full = llm_join_test(one, one, "2: n exact_match", mode="full", left_key="k", right_key="k").orderBy("row_index").collect()
    assert json.loads(full[0].llm_decision_json)["selected_candidate"] == 1
    with pytest.raises(ValueError):
        llm_join_test(one, one, "2: n exact_match", mode="other")


def test_algorithm_check(spark):
    one = spark.createDataFrame([(0, "a")], "k int, n string")
    with pytest.raises(ValueError):
        candidates(one, one, "2: n numeric_distance", check=True)
    with pytest.raises(ValueError):
        candidates(one, one, "2: missing exact_match")


def test_recorded_answers_outlive_their_workers(spark, tmp_path):
    folder = f"file://{tmp_path}/answers"
    rows = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "p string").repartition(3)
    first = {r.p: r.x for r in rows.select("p", llm(F.col("p"), RecordingProvider(folder=folder)).alias("x")).collect()}
    assert len(list(tmp_path.glob("answers/*/*.json"))) == 2
    again = rows.select("p", llm(F.col("p"), RecordingProvider(inner=OfflineProvider(labels=("other",)), folder=folder, mode="only")).alias("x")).collect()
    assert {r.p: r.x for r in again} == first  # what was kept is replayed, whatever the provider would say now
    with pytest.raises(KeyError):
        RecordingProvider(folder=folder, mode="only").text("c")
    assert RecordingProvider(inner=OfflineProvider(labels=("other",)), folder=folder, mode="record").text("a") == "other"
    assert RecordingProvider(folder=folder).text("a") == "other"
    key = RecordingProvider(folder=folder).key
    assert len({key("a"), key("a", {}), key("a", None, (b"x",)), key("b")}) == 4
    with pytest.raises(ValueError):
        RecordingProvider(mode="sometimes")


def test_interaction_log(spark, tmp_path):
    provider = LoggingProvider(inner=OfflineProvider(input_price=1e-6, output_price=2e-6), folder=f"file://{tmp_path}/log")
    spark.createDataFrame([("one prompt",), ("another",)], "p string").select(llm(F.col("p"), provider)).collect()
    with pytest.raises(Exception):
        provider.structured("no JSON", {})
    found = {r.prompt: r for r in interactions(spark, f"file://{tmp_path}/log").collect()}
    assert set(found) == {"one prompt", "another", "no JSON"} and found["no JSON"].error
    assert found["one prompt"].input_tokens == 3 and found["one prompt"].cost == pytest.approx(3e-6 + found["one prompt"].output_tokens * 2e-6)


def test_http_provider(monkeypatch):
    seen = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.headers["Authorization"], asked))
            answer = json.dumps({"n": 1}) if "response_format" in asked else "fine"
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": answer}}]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("LLM_API_KEY", "secret")
    provider = HttpProvider("m", token_limit=5, url=f"http://127.0.0.1:{server.server_port}/v1")
    assert provider.text("x" * 100, (b"png",)) == "fine" and provider.structured("short", {"name": "s"}) == {"n": 1}
    with pytest.raises(ValueError, match="token limit"):
        provider.structured("x" * 100, {})
    server.shutdown()
    (key, first), (_, second) = seen
    assert key == "Bearer secret" and first["model"] == "m" and second["response_format"]["json_schema"] == {"name": "s"}
    text, image = first["messages"][1]["content"]
    assert len(text["text"]) == 20 and image["image_url"]["url"].startswith("data:image/png;base64,")


def test_cost_of_a_join_test(spark):
    left = spark.createDataFrame([(k, float(k)) for k in range(4)], "k long, v double")
    provider = OfflineProvider(input_price=1e-3, output_price=1e-2)
    rows = llm_join_test(left, left, "2: v numeric_distance", "which", "full", provider=provider, left_key="k", right_key="k").collect()
    assert all(r.row_cost > 0.05 for r in rows)
    dry = llm_join_test(left, left, "2: v numeric_distance", "which", "dry", provider=provider, left_key="k", right_key="k").collect()
    assert {r.row_cost for r in dry} == {0.0}
    cost = sum(r.row_cost for r in rows)
    assert extrapolated_cost(cost, len(rows), left.union(left)) == pytest.approx(2 * cost) and extrapolated_cost(1.0, 0, left) == 0.0


@pytest.mark.parametrize("mechanism", ["numeric_distance", "numeric_distance 2.5", "arithmetic_asc", "arithmetic_desc"])
@pytest.mark.parametrize("k", [1, 3, 50])
def test_neighbours_in_order_are_all_pairs_best(spark, mechanism, k):
    """Ties everywhere: the sorted neighbours give what all pairs give."""
    rng = random.Random(5)
    left = spark.createDataFrame([(i, rng.choice([None, float(rng.randrange(6))])) for i in range(15)], "k long, v double")
    right = spark.createDataFrame([(i, rng.choice([None, float(rng.randrange(8)) - 1])) for i in range(25)], "k long, v double")
    one = candidates(left, right, f"{k}: v {mechanism}", left_key="k", right_key="k")[2]
    # A second criterion that is 1 for every pair leaves the scores and takes the way of all pairs.
    with_one = [df.withColumn("c", F.lit("x")) for df in (left, right)]
    two = candidates(*with_one, f"{k}: v {mechanism if mechanism[-1].isdigit() else mechanism + ' 1'}, c exact_match 1", left_key="k", right_key="k")[2]
    assert sorted((r.left_idx, r.right_idx, r["rank"], round(r.score, 12)) for r in one.collect()) == sorted((r.left_idx, r.right_idx, r["rank"], round(r.score, 12)) for r in two.collect())

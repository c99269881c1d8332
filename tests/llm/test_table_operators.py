import base64
import hashlib
import json
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm import cross_polytope, mixing
from tessera.llm.common import table_path
from tessera.llm.cross_polytope import hadamard, nearest, search
from tessera.llm.line_crf import fit
from tessera.llm.mixing import described, mix, rake
from tessera.llm.queries import MIX_POWER, MIX_SHARES, URL_RULES
from tessera.llm.tool_links import SCHEMAS, Field, conversation_calls, levels, link_calls
from tessera.llm.url_rules import judge_urls
from tessera.llm.warc import archive_round_trip, parse, read_archives, record, write_archives
from tests.llm.fixtures import documents
from tests.llm.test_text_operators import brute_components, brute_removed

SF = "/root/testdata/sf0.001"


def _plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & {"op2_ipf_mixing", "op4_warc_seekable_bundles", "op5_fm_index_dedup", "op6_url_range_join", "op7_parity_sketch_join", "op9_tool_call_links"}))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    found = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(str([_plain(v) for v in r]) for r in found.fetchall())
    assert sorted(str([_plain(r[c]) for c in columns]) for r in df.collect()) == want


# WARC


def _pages(spark):
    rows = [(k, f"http://a.org/{k}", f"<p>{k % 7}</p>") for k in range(40)]
    rows += [(50, None, None), (51, "http://x/\r\nInjected: 1", ""), (52, "u", "é" * 300_000), (53, "u", "é" * 300_000), (None, "u", "<p>1</p>"), (None, "u", "alone"), (3, "http://a.org/3", "<p>3</p>")]
    return spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, digest string, keeper int")


def test_archives(spark):
    pages = _pages(spark)
    got = archive_round_trip(pages).collect()
    assert len(got) == pages.count() and all(r.payload_ok for r in got)
    keeper = {}
    for r in pages.collect():
        h = r.html or ""
        keeper[h] = max((x for x in (keeper.get(h), r.page_id) if x is not None), default=None)
    want = []
    for r in pages.collect():
        raw = (r.html or "").encode()
        top = keeper[r.html or ""]
        again = top is not None and top != r.page_id
        want.append((r.page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", top if again else None))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert archive_round_trip(pages.limit(0)).count() == 0
    assert archive_round_trip(pages, min_bytes=100).where("record_type = 'revisit'").count() == 1


def test_frames_are_independent(spark):
    pages, folder = _pages(spark), table_path(spark, "warc-test")
    index = write_archives(pages, folder, frame_bytes=2000, bundle_bytes=4000)
    assert index.groupBy("bundle").agg(F.countDistinct("frame")).where("`count(DISTINCT frame)` > 1").count() > 0
    some = index.where("page_id in (3, 52)")
    assert sorted(r.page_id for r in read_archives(some, folder).collect()) == [3, 3, 52]


def test_record_round_trip():
    raw = record(7, "http://x/\r\nEvil: 1", b"a\r\n\r\nb", 9, False, "2000-01-01T00:00:00Z")
    found = parse(raw)
    assert found["payload"] == b"a\r\n\r\nb" and "Evil" not in found and found["WARC-Record-ID"].startswith("<urn:x-page:7:")
    assert parse(record(7, None, b"x", 9, True, ""))["payload"] is None


# URL rules


def brute_judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


def test_url_rules(spark):
    rng = np.random.default_rng(4)
    hosts = ["org", "example.org", "EXAMPLE.org", "a.example.org", "xexample.org", "example.org.evil.com", "b.com", "com", "example.org:80", "-x.org", "org.", "a..org", "ÄÖ.org"]
    paths = ["", "/", "/es/", "/es", "/en/12?q=/es/", "/en/2#x", "/fr/a/b", "?q=1", "#t", "/de/\nx", "//"]
    urls = [f"{s}://{h}{p}" for s in ("http", "https://") for h in hosts for p in paths] + [None, "", "no scheme", "://", "http://", "x://y://z.org/es/"]
    pages = spark.createDataFrame([(k, u, "h", "p", 3) for k, u in enumerate(urls)] + [(None, "http://a.org/", "h", "p", 3)] * 2, "page_id long, url string, host string, path string, cell int")
    rules = [*URL_RULES, ("allow", "example.org", "/es/"), ("block", "a.example.org", "/"), ("allow", "org", "/en/12"), ("block", "net", ""), ("allow", "a.org", "/")]
    frame = spark.createDataFrame(rules, "verdict string, host string, path string")
    for cells in (1, 7, None):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, frame, cells=cells).collect()}
        assert got == {k: brute_judge(u, rules) for k, u in enumerate(urls)} | {None: brute_judge("http://a.org/", rules)}
    assert judge_urls(pages, frame).count() == pages.count() and judge_urls(pages.limit(0), frame).count() == 0
    assert judge_urls(pages, frame.limit(0)).where("verdict <> 'allow'").count() == 0
    del rng


# Nearest neighbours


def brute_nearest(rows, k, wanted):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, v in ok:
        if wanted(q):
            scored = sorted((-(u * v).sum(), i) for i, u in ok if i != q and len(u) == len(v))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return out


def test_nearest_small_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=5).tolist()) for k in range(45)] + [(100 + k, [1.0, 2.0, 0.0, 0.0, 0.5]) for k in range(40)]
    rows += [(200, None), (201, [0.0] * 5), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [float("nan")] + [1.0] * 4), (204, [float("inf")] * 5), (205, [1.0, 2.0]), (206, []), (None, [1.0] * 5), (210, [3.0, 1.0])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, ids string, side int")
    got = nearest(table, table.where("vec_id % 5 = 0"), k=20).collect()
    want = brute_nearest(rows, 20, lambda q: q % 5 == 0)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(w[:3] for w in want)
    np.testing.assert_allclose(sorted(r.score for r in got), sorted(w[3] for w in want))
    assert nearest(table.limit(0), table.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["as they are", "one long vector", "spread lengths", "two dimensions"])
def test_recall(spark, kind):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    rng = np.random.default_rng(0)
    if kind == "one long vector":
        x[7] *= 5
    elif kind == "spread lengths":
        x *= np.exp(rng.normal(scale=0.3, size=(len(x), 1)))
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    if kind == "two dimensions":
        rows += [(100_000 + k, rng.normal(size=6).tolist()) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = df.where("vec_id % 20 = 0")
    got = {(r.query_id, r.vec_id) for r in nearest(df, queries).collect()}
    want = {(q, i) for q, _, i, _ in brute_nearest(rows, 20, lambda q: q % 20 == 0)} if kind == "two dimensions" else set()
    for q in np.flatnonzero(ids % 20 == 0) if not want else []:
        s = x @ x[q]
        s[q] = -np.inf
        want |= {(int(ids[q]), int(ids[j])) for j in np.argsort(-s)[:20]}
    reranked = search(df, cross_polytope._usable(queries).withColumn("class_id", cross_polytope._class()), 20).where("vec_id is null").agg(F.sum("score")).first()[0]
    share = reranked / (queries.count() * df.count())
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want), kind
    assert share < 0.1, share


def test_buckets_of_concatenated_hashes(spark, monkeypatch):
    for name, value in (("WHOLE_ROWS", 128), ("BUCKET_ROWS", 4), ("EXACT_ROWS", 64)):
        monkeypatch.setattr(cross_polytope, name, value)
    plan = cross_polytope.Plan(6, 100)
    q = np.random.default_rng(2).normal(size=(5, 6))
    for hashes in (1, 2, 3):
        every = plan.probes(q, 1, hashes, plan.hashing.axes**hashes)
        assert all(sorted(row) == list(range(plan.hashing.axes**hashes)) for row in every.tolist())
        assert (plan.probes(q, 1, hashes, 1)[:, 0] == plan.buckets(q, 1, hashes)).all()  # the best is a vector's own
    x = np.random.default_rng(3).normal(size=(600, 6)).round(3)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000 + k, x[5].tolist()) for k in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in nearest(df, df.where("vec_id % 20 = 0"), 5, exact_rows=64).collect()}
    want = {(q, i): s for q, _, i, s in brute_nearest(rows, 5, lambda q: q % 20 == 0)}
    assert len(got) == len(want) and len(got.keys() & want.keys()) >= 0.9 * len(want)
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in got.keys() & want.keys())


def test_hadamard():
    x = np.random.default_rng(1).normal(size=(3, 8))
    np.testing.assert_allclose(hadamard(hadamard(x)), x)


# Mixing


def test_marginals_meet_their_targets(spark):
    docs = documents(spark)
    cells = described(docs).groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"))
    raked = rake(cells, {"source": {"src0": 0.4, "src1": 0.3, "src2": 0.2, "src3": 0.1}}, 0.5)
    got = {r.source: r.share for r in raked.groupBy("source").agg(F.sum("raked").alias("share")).collect()}
    assert got == pytest.approx({"": 0.0, "src0": 0.4, "src1": 0.3, "src2": 0.2, "src3": 0.1}, abs=1e-6)


def test_mix_expectation_and_edges(spark):
    docs = documents(spark)
    out = mix(docs, {"lang": {"en": 0.5, "de": 0.5}}, 0.7, keep=3.0)
    assert out.count() == docs.count()
    rows = out.collect()
    assert all(r.copies in (int(r.weight), int(r.weight) + 1) for r in rows)
    assert {r.weight for r in rows if r.lang not in ("en", "de")} == {0.0}
    total = sum(r.n_tokens for r in rows)
    assert sum(r.weight * r.n_tokens for r in rows) == pytest.approx(3.0 * total, rel=1e-4)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert mix(docs.limit(0)).count() == 0
    assert {r.topic for r in mix(docs.withColumn("topic", F.lit("given"))).collect()} == {"given"}


def target_shares(tokens, shares, power):
    """The target of each value of a dimension, from the tokens of each and the given shares."""
    raw = {v: shares.get(v, 0.0) if shares else n**power for v, n in tokens.items()}
    return {v: x / sum(raw.values()) for v, x in raw.items()}


def test_stage_meets_the_target_shares(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = {r.doc_id: r for r in described(docs).collect()}
    times = Counter(r.doc_id for r in corpus_pipeline.source_mix(spark, docs, SF).select("doc_id").collect())
    weights = mix(docs, MIX_SHARES, MIX_POWER, others=True).collect()
    assert dict(times) == {r.doc_id: r.copies for r in weights if r.copies}
    # No document of an under-represented cell is lost, and the shares of the whole stay within a hundredth of the targets.
    assert all(times[r.doc_id] >= int(r.weight) for r in weights)
    for d in ("source", "lang", "topic"):
        tokens, kept, expected = Counter(), Counter(), Counter()
        for r in rows.values():
            tokens[r[d]] += r.n_tokens
            kept[r[d]] += r.n_tokens * times[r.doc_id]
        for r in weights:
            expected[r[d]] += r.n_tokens * r.weight
        want = target_shares(tokens, MIX_SHARES.get(d), MIX_POWER)
        assert {v: x / sum(expected.values()) for v, x in expected.items()} == pytest.approx(want, abs=1e-5)
        assert {v: x / sum(kept.values()) for v, x in kept.items()} == pytest.approx(want, abs=0.02)


def test_stage_keeps_languages_without_a_share(spark):
    text = "seven words that make up a text"
    rows = [(k, text, "en" if k < 400 else None if k < 700 else "xx", f"s{k % 2}", len(text)) for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.lang for r in corpus_pipeline.source_mix(spark, docs, SF).collect()]
    own = {v: n**MIX_POWER for v, n in {"en": 400, None: 300, "xx": 300}.items()}
    for v, x in own.items():
        assert kept.count(v) / len(kept) == pytest.approx(x / sum(own.values()), abs=0.04)
    assert corpus_pipeline.source_mix(spark, docs.where("lang is null"), SF).count() == 300


def test_many_cells_are_raked_alike(spark, monkeypatch):
    docs = documents(spark)
    few = {r.doc_id: r.weight for r in mix(docs, MIX_SHARES, MIX_POWER, others=True).collect()}
    monkeypatch.setattr(mixing, "CELL_ROWS", 3)
    assert {r.doc_id: r.weight for r in mix(docs, MIX_SHARES, MIX_POWER, others=True).collect()} == pytest.approx(few, abs=2e-6)
    assert mixing.sampled(docs, MIX_SHARES, MIX_POWER, others=True).columns == docs.columns


def test_raking_reports_targets_out_of_reach(spark):
    cells = spark.createDataFrame([("a", "en", "t", 10), ("b", "de", "t", 10)], "source string, lang string, topic string, tokens long")
    with pytest.warns(UserWarning, match="off the target shares"):
        rake(cells, {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.9, "de": 0.1}}, 0.7)


# Tool calls


def test_links(spark):
    calls = spark.createDataFrame(
        [
            (1, 0, "a", "f", '{"n": 5, "s": "x", "z": {"k2": null, "k1": [1.5, "é"]}}', None, "e"),
            (1, 1, "b", "f", '{"s": "", "n": 50}', ["a", "nowhere"], "e"),
            (1, 2, "c", "f", '{"n": "5"}', ["b", "a"], "e"),
            (1, 3, "d", "g", "{}", ["e"], "e"),
            (1, 4, "e", "f", "not json", ["d"], "e"),
            (1, 5, "x", "f", None, [], "e"),
            (2, 0, "a", "f", "[1]", [], "e"),
            (2, 7, "a", "f", '{"n": 1, "s": "later"}', [], "e"),
            (None, 0, "a", "f", "{}", [], "e"),
        ],
        "conv_id long, turn long, call_id string, name string, arguments string, after array<string>, level string",
    )
    results = spark.createDataFrame([(1, 9, "a", "r1"), (1, 8, "a", "first"), (1, 0, "b", "soon"), (3, 0, "q", None), (1, 1, None, "lost")], "conv_id long, turn long, call_id string, content string")
    schemas = {"f": [Field("n", "integer", least=1, most=9), Field("s", "string", least=1), Field("o", "boolean", required=False)]}
    got = {(r.conv_id, r.call_id): r for r in link_calls(calls, results, schemas).collect()}
    assert {k: (r.level, r.status, r.valid, r.problems) for k, r in got.items()} == {
        (1, "a"): (0, "answered", True, ""),
        (1, "b"): (1, "early", False, "n:range,s:range"),
        (1, "c"): (2, "unanswered", False, "n:type,s:missing"),
        (1, "d"): (None, "cycle", False, "name:unknown"),
        (1, "e"): (None, "cycle", False, "arguments:json"),
        (1, "x"): (0, "unanswered", False, "arguments:json"),
        (2, "a"): (0, "unanswered", False, "arguments:json"),
        (3, "q"): (None, "orphan", False, "call:missing"),
    }
    assert got[1, "a"].json == '{"arguments":{"n":5,"s":"x","z":{"k1":[1.5,"é"],"k2":null}},"id":"a","level":0,"name":"f","result":"first","status":"answered","turn":0}'
    assert json.loads(got[1, "e"].json)["arguments"] == "not json" and json.loads(got[1, "x"].json)["arguments"] is None
    assert link_calls(calls.limit(0), results.limit(0), schemas).count() == 0


def plain_levels(after):
    """Longest chains by relaxation; None on or behind a cycle."""
    found = {}
    for _ in range(len(after) + 1):
        for c, parents in after.items():
            known = [p for p in parents if p in after]
            if all(p in found for p in known):
                found[c] = max((found[p] + 1 for p in known), default=0)
    return {c: found.get(c) for c in after}


def test_levels_of_any_graph(spark):
    rng = random.Random(4)
    graphs = {0: {f"c{k}": [f"c{k - 1}", f"c{k - 2}"] if k else [] for k in range(1000)}}  # one chain of a thousand calls
    graphs[1] = {a: [b for b in "abc" if b != a] for a in "abc"} | {"d": ["a"], "e": ["absent"], "f": ["f"], "g": ["e", "e"]}
    for g in range(2, 8):
        names = [f"n{k}" for k in range(14)]
        graphs[g] = {n: rng.sample(names if g > 5 else names[:k], min(k, rng.randrange(4))) for k, n in enumerate(names)}
    rows = [(g, c, k, parents) for g, graph in graphs.items() for k, (c, parents) in enumerate(graph.items())]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, turn long, after array<string>")
    got = {(r.conv_id, r.call_id): r.level for r in levels(calls).collect()}
    want = {(g, c): n for g, graph in graphs.items() for c, n in plain_levels(graph).items() if n is not None}
    assert got == want and got[0, "c999"] == 999


def test_links_use_hash_joins(spark):
    plan = entry.queries()["op9_tool_call_links"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan


def test_conversation_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", None), (1, 2, "user", ""), (1, 2, "user", ""), (1, 3, None, "x"), (None, 0, "user", "x"), (2, None, "user", "x"), (3, 5, "assistant", "alone"), (4, 0, "user", 'long "quoted"\n' * 5000)]
    talk = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, name string")
    got = {(r.conv_id, r.turn): (r.status, r.problems) for r in link_calls(*conversation_calls(talk), SCHEMAS).collect()}
    nulls = got.pop((1, 0))
    assert nulls[0] == "answered" and {p.partition(":")[0] for p in nulls[1].split(",")} == {"chars", "lines", "prompt"}
    assert got == {(1, 2): ("unanswered", "chars:range,prompt:range"), (3, 5): ("orphan", "call:missing"), (4, 0): ("unanswered", "chars:range,lines:range")}


# The pipeline


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = table_path(spark, f"test-stage-{k}")
        stage(spark, now, SF).write.parquet(path)
        before, now = now, spark.read.parquet(path)
        if k < 4:
            assert now.columns == docs.columns and (now.count() <= before.count() or k == 3)
    assert now.count() > 0 and {r.n_tokens == len(r.token_ids) for r in now.collect()} == {True}


def test_pipeline_stages_against_plain_python(spark):
    """Each stage on its own input: which rows stay and what their texts are."""
    docs = documents(spark).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    rows = [tuple(r) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)

    def kept(name, given):
        return sorted(map(tuple, stages[name](spark, given, SF).collect()), key=str)

    model = fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    accepted = [r for r, s in zip(rows, model.score([r[1] or "" for r in rows]), strict=True) if s >= 0.7]
    assert kept("quality classifier", docs) == sorted(accepted, key=str)

    smallest = {d: c for d, _, c in brute_components([(r[0], r[1] or "") for r in rows], 5, 80)}
    assert kept("n-gram Jaccard join", docs) == sorted((r for r in rows if r[0] is None or smallest[r[0]] == r[0]), key=str)

    cut = kept("substring dedup", docs)
    digests = sorted(((d, k) for d, _, _, k in brute_removed([(r[0], r[1] or "") for r in rows])), key=str)
    assert sorted(((r[0], hashlib.sha256(b" ".join((r[1] or "").encode().split())).hexdigest()) for r in cut), key=str) == digests
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in cut)

    times = {r.doc_id: r.copies for r in mix(docs, MIX_SHARES, MIX_POWER, others=True).collect()}
    assert Counter(kept("mixing sources to target weights", docs)) == Counter({r: n for r, m in Counter(rows).items() if (n := m * (1 if r[0] is None else times[r[0]]))})

    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    got = stages["BPE encoding and decoding"](spark, docs, SF).collect()
    assert sorted(((r.doc_id, r.token_ids) for r in got), key=str) == sorted(want, key=str)


def test_pipeline_stages_on_odd_rows(spark):
    docs = documents(spark).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"), "starts", "key", "n", "rep", "component_id")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert 0 < out.count() and (name.startswith("BPE") or out.columns == docs.columns)
        assert stage(spark, docs.limit(0), SF).count() == 0

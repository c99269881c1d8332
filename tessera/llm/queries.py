"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.parity_join import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"), shingle=4, percent=85).select("doc_id", "n_shingles", "component_id")


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(words) - 3, 1) + 1), lambda i: array_to_string(words[i:i + 3], ' '))) AS w FROM d WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS seen FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""


def op8_cross_polytope_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.cross_polytope import nearest

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op9_tool_call_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.tool_links import SCHEMAS, conversation_calls, link_calls

    return link_calls(*conversation_calls(table(spark, sf_dir, "conversations")), SCHEMAS)


OP9_SQL = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, 'call_' || conv_id || '_' || turn AS call_id, CASE role WHEN 'user' THEN 'reply' ELSE 'configure' END AS name, text, length(text) AS chars,
    length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM conversations WHERE role IN ('user', 'system')),
r AS (SELECT conv_id, turn AS r_turn, 'call_' || conv_id || '_' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'assistant'),
v AS (SELECT conv_id, turn, 0 AS level FROM c UNION SELECT c.conv_id, c.turn, v.level + 1 FROM v JOIN c ON c.conv_id = v.conv_id AND c.turn - v.turn IN (1, 2)),
l AS (SELECT conv_id, turn, max(level) AS level FROM v GROUP BY ALL),
j AS (SELECT conv_id, coalesce(c.turn, r_turn) AS turn, call_id, name, level::BIGINT AS level, content, text, chars, lines, c.turn IS NOT NULL AS called,
    CASE WHEN c.turn IS NULL THEN 'orphan' WHEN r_turn IS NULL THEN 'unanswered' ELSE 'answered' END AS status
  FROM c FULL JOIN r USING (conv_id, call_id) LEFT JOIN l ON l.conv_id = c.conv_id AND l.turn = c.turn),
p AS (SELECT *, CASE WHEN NOT called THEN 'call:missing' ELSE concat_ws(',', CASE WHEN chars < 1 OR chars > CASE name WHEN 'reply' THEN 400 ELSE 4000 END THEN 'chars:range' END,
    CASE WHEN name = 'reply' AND lines > 4 THEN 'lines:range' END, CASE WHEN chars < 1 THEN 'prompt:range' END) END AS problems FROM j)
SELECT conv_id, turn, call_id, name, level, status, problems = '' AS valid, problems,
  '{"arguments":' || CASE WHEN called THEN '{"chars":' || chars || CASE name WHEN 'reply' THEN ',"lines":' || lines ELSE '' END || ',"prompt":' || to_json(text)::VARCHAR || '}' ELSE 'null' END
  || ',"id":"' || call_id || '","level":' || coalesce(level::VARCHAR, 'null') || ',"name":' || coalesce('"' || name || '"', 'null') || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null')
  || ',"status":"' || status || '","turn":' || turn || '}' AS json FROM p
"""


def op10_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from tessera.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), path("word_bpe_49k.json"))


def op1_spotsigs_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.spotsigs import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


#: Target shares of the mixing query and stage; source and topic take their actual shares to MIX_POWER.
MIX_SHARES = {"lang": {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1}}
MIX_POWER = 0.7


def op2_ipf_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), MIX_SHARES, MIX_POWER)


def _op2_sql(rounds: int = 40) -> str:
    from tessera.llm.mixing import TOPIC_MARKS

    topic = "CASE " + " ".join(f"WHEN contains(coalesce(text, ''), '{mark}') THEN '{name}'" for mark, name in TOPIC_MARKS) + " ELSE 'prose' END"
    lang = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX_SHARES["lang"].items()) + " ELSE 0.0 END"
    steps = ["r0 AS (SELECT *, tokens::DOUBLE / sum(tokens) OVER () AS raked FROM t)"]
    for k in range(3 * rounds):
        d = ("source", "lang", "topic")[k % 3]
        steps.append(f"r{k + 1} AS (SELECT * EXCLUDE (raked), raked * t_{d} / sum(raked) OVER (PARTITION BY {d}) AS raked FROM r{k})")
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {topic} AS topic, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
c AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
s AS (SELECT source, pow(sum(tokens)::DOUBLE, {MIX_POWER}) AS x FROM c GROUP BY 1),
o AS (SELECT topic, pow(sum(tokens)::DOUBLE, {MIX_POWER}) AS x FROM c GROUP BY 1),
l AS (SELECT lang, ({lang})::DOUBLE AS x FROM c GROUP BY 1),
t AS (SELECT c.*, s.x / (SELECT sum(x) FROM s) AS t_source, l.x / (SELECT sum(x) FROM l) AS t_lang, o.x / (SELECT sum(x) FROM o) AS t_topic FROM c JOIN s USING (source) JOIN l USING (lang) JOIN o USING (topic)),
{", ".join(steps)},
w AS (SELECT source, lang, topic, round(raked * sum(tokens) OVER () / tokens, 9) AS weight FROM r{3 * rounds})
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(least(weight, 1.0), 6) AS probability,
  (floor(weight) + CASE WHEN ('0x' || substr(md5('1:' || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < weight - floor(weight) THEN 1 ELSE 0 END)::BIGINT AS copies
FROM d JOIN w USING (source, lang, topic)
"""


def op3_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.line_crf import fit, score_documents

    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))


def op4_warc_seekable_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


_BASE32 = "list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * g::INT + 1, 5))::INT >> s) & 31), 1)), 'string_agg', '')), 'string_agg', '')"
OP4_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to, true AS payload_ok FROM k
"""

#: verdict, host, path
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op5_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), window=13)


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - 11), lambda i: {'i': i, 'w': array_to_string(words[i:i + 12], ' ')}), recursive := true) FROM d WHERE len(words) >= 13),
f AS (SELECT w, min(doc_id) AS first FROM g GROUP BY w),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM g JOIN f USING (w) WHERE first < doc_id),
t AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM d),
k AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY j) AS kept FROM t ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, len(words)::BIGINT - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""


def op6_url_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.url_rules import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "verdict string, host string, path string"))


OP6_SQL = f"""
WITH r(verdict, host, path) AS (VALUES {", ".join(map(str, URL_RULES))}),
a AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
m AS (SELECT u.page_id, max_by(r.host || r.path, (length(r.host || r.path), length(r.host))) AS rule, max_by(r.verdict, (length(r.host || r.path), length(r.host))) AS verdict
  FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.page_id)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_spotsigs_fingerprints, op2_ipf_mixing, op3_line_crf_quality, op4_warc_seekable_bundles, op5_fm_index_dedup,
        op6_url_range_join, op7_parity_sketch_join, op8_cross_polytope_neighbours, op9_tool_call_links, op10_bpe_prefix_dp,
    ]
    import corpus_pipeline

    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ipf_mixing": _op2_sql(),
        "op4_warc_seekable_bundles": OP4_SQL,
        "op5_fm_index_dedup": OP5_SQL,
        "op6_url_range_join": OP6_SQL,
        "op7_parity_sketch_join": OP7_SQL,
        "op9_tool_call_links": OP9_SQL,
    }

import base64
import hashlib
import random
import string
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from xxhash import xxh3_64_intdigest

import corpus_pipeline
from tessera.llm import bpe, common, parity_join, substring_dedup
from tessera.llm.bpe import encode_documents, model_of
from tessera.llm.components import components
from tessera.llm.fm_index import FMIndex
from tessera.llm.line_crf import _forward_backward, fit, keep_accepted, score_documents, train
from tessera.llm.parity_join import dense_sketch, piece_keys, shingle_set, similar_documents
from tessera.llm.spotsigs import BARE, CHAIN, COMMON, PICKED, edited, fingerprint_documents, likeness, signatures, similar_pairs
from tessera.llm.substring_dedup import cleaned, remove_repeats
from tests.llm.fixtures import documents, pairs

P = pytest.importorskip("public_tokenizers")
VOCABULARY = P.path("word_bpe_49k.json")


# BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("abcdeinrst'<|>o \u03a3\u0130é1²", max_size=80))
def test_bpe_equals_the_library(library, text):
    ids, numbers = model_of(VOCABULARY).encode_text(text)
    assert numbers == [int(i) for i in ids.split()]
    decoded = model_of(VOCABULARY).decode(numbers)
    want = library.encode(text, add_special_tokens=False).ids
    assert ids == " ".join(map(str, want))
    assert decoded == library.decode(want, skip_special_tokens=False) == model_of(VOCABULARY).decode(want)


@pytest.mark.parametrize("text", ["<|endoftext|>a<|startoftext|> B<|endoftext|><|end", "a\x1cb \x1f", "\0<|endoftext|>", "lllll ssssssss....'s", "", "   "])
def test_bpe_special_cases(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert model_of(VOCABULARY).encode_text(text)[0] == " ".join(map(str, want))


def test_words_that_come_again_stay_cached(library, monkeypatch):
    """Words that come once don't drive out the others, and what is forgotten changes no ids."""
    monkeypatch.setattr(bpe, "CACHE_WORDS", 200)
    model, asked = bpe.WordBpe(VOCABULARY), []
    plain = model.encode_word
    monkeypatch.setattr(model, "encode_word", lambda word: asked.append(word) or plain(word))
    rng = random.Random(8)
    for _ in range(60):
        once = ["".join(rng.choices("abcdeßé", k=12)) + rng.choice(["", "!", "...", "'s", "7%", "ñ?"]) for _ in range(10)]
        text = " ".join([*once, "often", "often!", "(often)", "öften."])
        assert model.encode_text(text)[1] == library.encode(text, add_special_tokens=False).ids
        assert len(model._cache) + len(model._cache.older) <= 200
    assert asked.count("often") == asked.count("öften") == 1


def test_models_go_when_a_worker_turns_to_other_work():
    """Workers serve every stage: what the encoder keeps for its next task isn't there while others run."""
    kept = model_of(VOCABULARY)
    common.only("bpe")
    assert model_of(VOCABULARY) is kept
    common.only("")
    assert model_of.cache_info().currsize == 0


def test_the_pipeline_encodes_bounded_batches(spark, monkeypatch):
    """27 MB of texts in one partition don't reach the encoder's Python worker as one batch."""

    def sizes(docs, path, with_ids):
        return docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"size": [b.nbytes]}) for b in batches), "size long")

    monkeypatch.setattr(corpus_pipeline, "encode_documents", sizes)
    docs = spark.range(600).selectExpr("id AS doc_id", "repeat('many words of one text ', 2000) AS text").coalesce(1)
    found = [r.size for r in corpus_pipeline.encode(spark, docs, "").collect()]
    assert sum(found) > 25_000_000 and max(found) < 12_000_000


def test_bpe_documents(spark, library):
    docs = documents(spark)
    got = sorted(map(tuple, encode_documents(docs, VOCABULARY).collect()), key=str)
    want = []
    for doc_id, text in pairs(docs):
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert encode_documents(docs.limit(0), VOCABULARY).count() == 0
    assert encode_documents(docs, VOCABULARY, with_ids=True).where("size(token_ids) <> n_tokens").count() == 0


# Near duplicates


def brute_components(rows, n, percent):
    sets = {}
    for i, (doc_id, text) in enumerate(rows):
        w = text.encode().lower().split()
        sets[i] = (doc_id, frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset())
    parent = {d: d for d, _ in sets.values() if d is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, (a, s) in sets.items():
        for j in range(i):
            b, t = sets[j]
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t) and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets.values()), key=str)


@pytest.mark.parametrize(("n", "percent", "block"), [(4, 85, 1 << 18), (5, 80, 50), (1, 50, 1)])
def test_similar_documents(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(parity_join, "BLOCK_KEYS", block)
    docs = documents(spark, 80)
    got = similar_documents(docs, n, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(pairs(docs), n, percent)


def test_similar_documents_long_chains(spark):
    """Neighbours link, distant documents don't: only chains join them."""
    rng = random.Random(5)
    text = [f"v{rng.randrange(10**6)}" for _ in range(160)]
    rows = [(100 - k, " ".join(text[3 * k : 3 * k + 60])) for k in range(33)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = similar_documents(docs, 4, 85).select("doc_id", "n_shingles", "component_id").collect()
    want = brute_components(rows, 4, 85)
    assert sorted(map(tuple, got), key=str) == want and len({c for *_, c in want}) < 33
    assert similar_documents(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**6))
def test_similar_sets_share_a_key(size, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
    d = int(len(a) * 15 / 100)
    b = np.unique(np.concatenate((a[: len(a) - rng.integers(0, d + 1)], rng.integers(0, 2**64, rng.integers(0, d + 1), dtype=np.uint64))))
    common = len(np.intersect1d(a, b))
    if len(b) and 100 * common >= 85 * (len(a) + len(b) - common):
        assert len(np.intersect1d(piece_keys(a, 85), piece_keys(b, 85)))


def test_shingles():
    assert len(shingle_set("", 4)) == len(shingle_set(" \n", 4)) == 0
    assert len(shingle_set("a b", 4)) == 1 and len(shingle_set("a b c d e", 4)) == 2
    assert (shingle_set("A b", 4) == shingle_set("a  B\t", 4)).all() and (shingle_set("É", 1) != shingle_set("é", 1)).all()


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (9, 8), (8, 7), (2, 1), (20, 1)] + [(100 + k, 101 + k) for k in range(70)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 20: 1, 8: 7, 9: 7} | {k: 100 for k in range(101, 171)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Repeated passages


def brute_removed(rows, window=13):
    first = {}
    words = [(d, t.encode().split()) for d, t in rows]
    for d, w in words:
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        for j in range(len(w) - window + 1):
            if d is not None and first[tuple(w[j : j + window])] < d:
                gone.update(range(j, j + window))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("hot", "block"), [(4000, 1 << 17), (3, 64)])
def test_remove_repeats(spark, monkeypatch, hot, block):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", block)
    monkeypatch.setattr(substring_dedup, "BLOCK_KEYS", block)
    docs = documents(spark)
    want = brute_removed(pairs(docs))
    assert sorted(map(tuple, remove_repeats(docs).collect()), key=str) == want
    assert sum(n for _, _, n, _ in want) > 300
    assert sorted(map(tuple, remove_repeats(docs, window=3).collect()), key=str) == brute_removed(pairs(docs), 3)
    assert remove_repeats(docs.limit(0)).count() == 0


def test_minimizers_of_several_texts_are_those_of_each():
    rng = random.Random(8)
    texts = [[b"%d" % rng.randrange(9) for _ in range(n)] for n in (0, 13, 3, 40, 12, 14, 14, 0)]
    texts[6] = texts[5]
    names, text, first = substring_dedup.minimizers(texts, 13)
    alone = [substring_dedup.minimizers([t], 13)[0].tolist() for t in texts]
    assert [names[text == k].tolist() for k in range(len(texts))] == alone and [len(a) for a in alone] == [0, 1, 0, 28, 0, 2, 2, 0]
    assert [first[text == k].tolist() for k in range(len(texts))] == [list(range(len(a))) for a in alone]
    at, lengths = substring_dedup.runs(names, text, 9)
    assert all(lengths <= 9) and all(len(set(zip(names[a : a + n].tolist(), text[a : a + n].tolist()))) == 1 for a, n in zip(at.tolist(), lengths.tolist()))
    assert sum(lengths) == len(names)


def test_cleaned_texts(spark):
    docs = documents(spark)
    out = cleaned(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    want = sorted(((d, k) for d, _, _, k in brute_removed(pairs(docs))), key=str)
    assert sorted(((r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in out.collect()), key=str) == want
    assert out.where("text is null").count() == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), max_size=12), min_size=1, max_size=6), st.lists(st.integers(1, 6), max_size=15), st.integers(1, 4))
def test_fm_index(texts, query, length):
    sequence = np.concatenate([np.array(t + [0], np.int64) for t in texts])
    index = FMIndex(sequence, length + 1)
    (low, high), = index.windows([np.array(query, np.int64)], length)
    for k in range(max(0, len(query) - length + 1)):
        pattern = query[k : k + length]
        want = sorted(p for p in range(len(sequence)) if sequence[p : p + length].tolist() == pattern)
        assert sorted(index.order[low[k] : high[k]].tolist()) == want


# Fingerprints


def plain_signatures(text):
    """Anchor chains word by word: (anchor, content words after it), or the whole sequence."""
    words = [w for w in "".join(" " if c in string.punctuation else c for c in text.lower()).translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    common = [w in COMMON for w in words]
    found = set()
    for i, w in enumerate(words):
        bare = not any(common[max(0, i - BARE) : i + 1])
        if common[i] or (bare and (xxh3_64_intdigest(w.encode()) >> 40) % PICKED == 0):
            chain = list(islice((x for x, c in zip(islice(words, i + 1, None), islice(common, i + 1, None), strict=True) if not c), CHAIN))
            if len(chain) == CHAIN:
                found.add((w, *chain))
    return found or ({tuple(words)} if words else set())


def plain_likeness(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_fingerprints(spark):
    docs = documents(spark).where("doc_id is null or doc_id <> 0").unionByName(documents(spark).where("doc_id = 0").limit(1))
    docs = docs.unionByName(docs.where("doc_id in (5, 9)").selectExpr("doc_id + 500 AS doc_id", "regexp_replace(text, 'w(.)', 'der w$1')  AS text", *docs.columns[2:]))
    rows = sorted(pairs(docs), key=lambda r: (r[0] is None, -(r[0] or 0)))
    want, chains = {}, {d: frozenset(plain_signatures(t)) for d, t in rows}
    for (d, t), (e, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        changed = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        a, b, c = chains[d], plain_signatures(changed), chains[e]
        want[d] = len(t), hashlib.sha256(changed.encode()).hexdigest(), len(a), len(b), plain_likeness(a, b), plain_likeness(a, c)
    for parts in ("1", "4", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = fingerprint_documents(docs).collect()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        size = {f: len(base64.b64decode(f)) // 4 for r in got for f in (r.fingerprint, r.edited_fingerprint)}
        assert {r.doc_id: (r.n_chars, r.edited_sha256, size[r.fingerprint], size[r.edited_fingerprint], r.near_edited, r.near_next) for r in got} == want
        # Equal fingerprints exactly where the chains are equal.
        assert len({r.fingerprint for r in got}) == len(set(chains.values())) == len({(r.fingerprint, chains[r.doc_id]) for r in got})
    assert fingerprint_documents(docs.limit(0)).count() == 0
    assert fingerprint_documents(documents(spark)).count() == documents(spark).count()
    one = fingerprint_documents(docs.where("doc_id = 4")).first()
    assert one.near_next == 1.0


@given(st.lists(st.sampled_from([*COMMON[:6], *"abcdefghijklmnop", "Der", "x-y", "."]), max_size=60))
def test_signatures_against_plain_chains(words):
    text = " ".join(words)
    assert len(signatures(text)) == len(plain_signatures(text))


def test_signatures():
    assert len(signatures("")) == len(signatures("?! ...")) == 0 and len(signatures("the of")) == 1
    assert (signatures("The Cat, sat of mats now!") == signatures("the cat sat of mats now")).all()
    # Anchors are the common words: each of the, of, and, in leads a chain; the content words here lead none.
    assert len(signatures("the quick brown fox of jumping dogs and lazy cats in winter nights")) == 4
    assert plain_signatures("the quick brown fox of jumping dogs") == {("the", "quick", "brown"), ("of", "jumping", "dogs")}
    assert edited("abcdef", "xyz") == "abcdxy" and edited("abcdef", "x") == "abcdx" and edited("ab", "x") == "ab"
    a = np.arange(10, dtype=np.uint32)
    assert likeness(a, a[:5]) == 0.5 and likeness(a, a[:0]) == 0.0 and likeness(a[:0], a[:0]) == 1.0


@pytest.mark.parametrize("least", [0.3, 0.6, 1.0])
def test_similar_pairs(spark, least):
    docs = documents(spark)
    found, member = similar_pairs(docs, least)
    sets = {d: plain_signatures(t) for d, t in pairs(docs) if d is not None}
    classes = {}
    for d in sorted(sets):
        classes.setdefault(frozenset(sets[d]), d)
    reps = sorted(classes.values())
    want = {(a, b) for i, a in enumerate(reps) for b in reps[i + 1 :] if sets[a] and sets[b] and plain_likeness(sets[a], sets[b]) >= least}
    assert {(r.a, r.b) for r in found.collect()} == want and (want or least == 1)
    assert {(r.doc_id, r.class_id) for r in member.collect()} == {(d, classes[frozenset(s)]) for d, s in sets.items()}


# Quality


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(2)
    scores, moves = [rng.normal(size=n) for n in (1, 4, 3)], rng.normal(size=(2, 2))
    marginals, total, moved = _forward_backward(scores, moves)
    all_log, all_moves = 0.0, np.zeros((2, 2))
    for s, got in zip(scores, marginals, strict=True):
        weights, bad, steps = 0.0, np.zeros(len(s)), np.zeros((2, 2))
        for k in range(2 ** len(s)):
            y = [(k >> t) & 1 for t in range(len(s))]
            w = np.exp(sum(s[t] for t in range(len(s)) if y[t]) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False)))
            weights += w
            bad += w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                steps[a, b] += w
        np.testing.assert_allclose(got, bad / weights)
        all_log += np.log(weights)
        all_moves += steps / weights
    np.testing.assert_allclose([total], [all_log])
    np.testing.assert_allclose(moved, all_moves)


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = score_documents(docs, fit(docs, labels))
    assert scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").where("held_out").select("predicted", "quality", "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert sum(r.predicted == r.quality for r in rows) >= 0.93 * len(rows)


def test_quality_edges(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(k, k % 2, 0, "clash") for k in range(40)] + [(None, 1, 0, ""), (3, None, 0, ""), (4, 7, 0, ""), (5, 0, 0, "")], "doc_id long, quality int, toxic int, text string")
    model = fit(docs, labels)
    got = score_documents(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    kept = keep_accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert score_documents(docs.limit(0), model).count() == 0
    prior = fit(docs, labels.limit(0))
    assert {r.score for r in score_documents(docs, prior).collect()} == {0.5}
    assert train(["a", "b"], [1, 1]).score(["", "x"]).tolist() == [pytest.approx(0.99)] * 2


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 2000), st.integers(0, 400), st.integers(0, 10**6))
def test_sketches_bound_the_difference(size, changed, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
    b = np.unique(np.concatenate((a[min(changed, len(a) - 1) :], rng.integers(0, 2**63, changed).astype(np.uint64))))
    x, y = sorted((dense_sketch(a).view(np.uint64), dense_sketch(b).view(np.uint64)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))

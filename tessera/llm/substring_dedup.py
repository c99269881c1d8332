"""Removal of word windows that an earlier document holds, by FM-indexes over shards of repeated passages.

(1) Each window
of `window` words is named by its minimizer, the least hash among the runs of GRAM words inside it; a window that
repeats has the same minimizer everywhere. One pass emits (minimizer, document), about one row for five words, and only
minimizers of at least two documents go on. Of the documents of one block (BLOCK_KEYS rows of a task) that share one, only
a head meets other blocks, so a passage of a third of all documents costs a row per block. (2) Neighbouring windows under
one such minimizer make a segment of at most 2 * window - GRAM words, routed to a shard by the minimizer; of equal
segments a task sends those that tell the smallest doc_id and whether there is another. Minimizers of more than HOT
occurrences are routed by whole windows instead, which fold completely. So what meets by one route is bounded, whatever
the skew. (3) A task takes shards block by block, builds a compressed FM-index over the block's segments and streams the
segments through it by backward search; the suffix interval of a window gives the smallest document that holds it. (4)
Windows with a smaller document than their own are joined back, and the words that they cover are cut from the whole
texts. Memory is bounded by one block and one text; texts are shuffled by doc_id twice, nothing is collected.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from tessera.llm.common import dropped, few, give_back, map_rows, only, text_or_empty, written
from tessera.llm.fm_index import FMIndex
from tessera.llm.parity_join import mix

GRAM = 5
HOT = 4000
BLOCK_WORDS = 1 << 17
BLOCK_KEYS = 1 << 18
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def minimizers(texts: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of every text (a list of words) its minimizer, the least hash of the GRAM-word runs inside it; the
    number of its text and its first word. All texts are one array, as most are short; windows across two are left out."""
    gram = min(GRAM, window)
    sizes = np.array([len(t) for t in texts], np.int64)
    windows = np.maximum(sizes - window + 1, 0)
    total = int(windows.sum())
    if not total:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(texts)), np.uint64, int(sizes.sum()))
    n = len(h) - gram + 1
    g = np.full(n, gram, np.uint64)
    for k in range(gram):
        g = mix(g + h[k : k + n]) * np.uint64(2 * k + 3)
    g, covered = mix(g), 1
    while covered < window - gram + 1:
        step = min(covered, window - gram + 1 - covered)
        g = np.minimum(g[:-step], g[step:])
        covered += step
    text = np.repeat(np.arange(len(texts)), windows)
    first = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows)
    return g[np.repeat(np.cumsum(sizes) - sizes, windows) + first].view(np.int64), text, first


def runs(names: np.ndarray, text: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of equal names in one text, cut into parts of at most longest."""
    if not len(names):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], (names[1:] != names[:-1]) | (text[1:] != text[:-1]))))
    length = np.diff(np.append(first, len(names)))
    parts = -(-length // longest)
    part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(first, parts) + longest * part, np.minimum(longest, np.repeat(length, parts) - longest * part)


def _values(column: pa.Array) -> Iterator:
    """The values of a column, a few at a time as Python objects."""
    for at in range(0, len(column), 64):
        yield from column.slice(at, 64).to_pylist()


def _gathered(rows: Iterator[tuple], text: int) -> Iterator[list[tuple]]:
    """Rows in groups of at most 64 rows and about 1 MB of the text in that place."""
    group: list[tuple] = []
    size = 0
    for row in rows:
        group.append(row)
        size += len(row[text])
        if len(group) == 64 or size > 1 << 20:
            yield group
            group, size = [], 0
    if group:
        yield group


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs (doc_id, text).

    Words are the runs of characters other than space and U+0009 to U+000D. A word is removed if a window of that many
    consecutive words covers it whose word sequence also starts in a document with a smaller doc_id; repeats inside one
    document stay, and so does the first document's copy. Null and empty texts have no words. Rows with a null doc_id
    are kept whole and never make others repeat; rows that share a doc_id aren't earlier than each other. Other columns
    are ignored.
    """

    def remove(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text, starts in rows:
            words = text.encode().split()
            keep = _keep(len(words), starts, window)
            kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k] if starts else words
            yield doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    source = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).withColumn("text_id", F.xxhash64("text"))
    joined = source.join(repeated_windows(docs, window), ["doc_id", "text_id"], "left").select("doc_id", "text", "starts")
    return map_rows(joined, remove, "doc_id long, n_words long, n_removed long, kept_sha256 string", chunk=64)


def cleaned(docs: DataFrame, window: int = 13) -> DataFrame:
    """docs, all columns and rows, with those words cut from the texts; n_chars, where there is one, follows the text.

    The white space after kept words stays; an untouched text stays as it is (null stays null).
    """

    def cut(text: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else _without(t.encode(), s, window).decode() for t, s in zip(text, starts, strict=True)], dtype=object)

    mark = f"_touched_{uuid.uuid4().hex}"  # no column of docs has that name
    hits = repeated_windows(docs, window)
    same = (docs["doc_id"].cast("long") == hits["doc_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == hits["text_id"])
    touched = hits["starts"].isNotNull()
    text = F.when(touched, F.pandas_udf(cut, "string")(F.when(touched, docs["text"]), hits["starts"])).otherwise(docs["text"])
    out = docs.join(hits, same, "left").select(*(text.alias(c) if c == "text" else docs[f"`{c}`"] for c in docs.columns), touched.alias(mark))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(mark), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(mark)


def repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, text_id (xxhash64 of the text), starts: the first words of the windows that an earlier document holds."""
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).withColumn("text_id", F.xxhash64("text"))
    named = texts.where("doc_id is not null")
    schema = pa.schema([(c, pa.int64()) for c in ("key", "doc_id", "head", "n", "most")])
    longest = window - min(GRAM, window) + 1

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("")
        held: list[tuple] = []
        filled = 0
        for batch in batches:
            for rows in _gathered(zip(*(_values(batch.column(c)) for c in (0, 1)), strict=True), 1):
                names, text, _ = minimizers([t.encode().split() for _, t in rows], window)
                at = runs(names, text, longest)[0]
                held.append((names[at], np.array([d for d, _ in rows], np.int64)[text[at]]))
                filled += len(at)
                if filled >= BLOCK_KEYS:
                    yield from headed(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held, filled = [], 0
        if filled:
            yield from headed(*(np.concatenate(c) for c in zip(*held, strict=True)))
        give_back()

    def headed(key: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows (key, document, head, n, most): the first row of a key is its head in this block, of the smallest doc_id, with
        the block's occurrences and largest doc_id; other documents have the head's doc_id."""
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        each = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))))
        key, doc, n = key[each], doc[each], np.diff(np.append(each, len(key)))
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        head = np.repeat(doc[starts], sizes)
        first = np.zeros(len(key), bool)
        first[starts] = True
        most, total = np.repeat(doc[starts + sizes - 1], sizes), np.repeat(np.add.reduceat(n, starts), sizes)
        whole = pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(head, mask=first), pa.array(total), pa.array(most)], schema=schema)
        for at in range(0, whole.num_rows, 1 << 16):
            yield whole.slice(at, 1 << 16)

    # Heads meet by key; other documents lie apart, each by itself.
    by_key = Window.partitionBy("key", F.when(F.col("head").isNotNull(), F.col("doc_id")))
    seen = named.select("doc_id", "text").mapInArrow(keys, "key long, doc_id long, head long, n long, most long")
    repeated = seen.withColumns({"lowest": F.min("doc_id").over(by_key), "highest": F.max("most").over(by_key), "total": F.sum("n").over(by_key)})
    repeated = repeated.where(F.when(F.col("head").isNull(), F.col("lowest") < F.col("highest")).otherwise(F.col("head") < F.col("most")))
    repeated = written(repeated.select("doc_id", "key", (F.col("head").isNull() & (F.col("total") > HOT)).alias("hot")), "minimizers")
    hot = written(repeated.where("hot").select("key").distinct().withColumn("crowded", F.lit(True)), "hot-minimizers")
    placed = repeated.select("doc_id", "key").join(few(hot), "key", "left")
    per_doc = placed.groupBy("doc_id").agg(F.collect_list(F.when(F.col("crowded").isNull(), F.col("key"))).alias("cool"), F.collect_list(F.when(F.col("crowded"), F.col("key"))).alias("hot"))

    def cut(rows: Iterator[tuple]) -> Iterator[tuple]:
        """A row per segment; of equal ones in a task the first carries the words, and few go on to a shard:
        enough to know the smallest doc_id and whether there is another."""
        seen: dict[bytes, tuple[int, int]] = {}  # smallest and largest doc_id sent so far
        for group in _gathered(rows, 2):
            texts = [text.encode().split() for _, _, text, _, _ in group]
            names, text, first = minimizers(texts, window)
            at, lengths = runs(names, text, longest)
            bounds = np.searchsorted(text[at], np.arange(len(group) + 1)).tolist()
            parts = list(zip(names[at].tolist(), first[at].tolist(), lengths.tolist(), strict=True))
            for (doc_id, text_id, _, cool, hot), words, low, high in zip(group, texts, bounds, bounds[1:], strict=False):
                found: list[tuple[int, int, int | None]] = []
                if cool:
                    wanted = set(cool)
                    found += [p for p in parts[low:high] if p[0] in wanted]
                if hot:
                    wanted = set(hot)
                    found += [(None, start + k, 1) for name, start, length in parts[low:high] if name in wanted for k in range(length)]
                if len(seen) > 250_000:
                    seen.clear()
                for route, start, length in found:
                    segment = b" ".join(words[start : start + length + window - 1])
                    digest = xxh3_128_digest(segment)
                    least, most = seen.get(digest, (None, None))
                    sent = least is None or doc_id < least or least == most < doc_id
                    if sent:
                        seen[digest] = (doc_id, doc_id) if least is None else (min(least, doc_id), max(most, doc_id))
                        if route is None:
                            route = int.from_bytes(digest[:8], "little", signed=True)
                    yield route if sent else None, digest, segment if least is None else None, doc_id, text_id, start

    segments = map_rows(named.join(per_doc, "doc_id").select("doc_id", "text_id", "text", "cool", "hot"), cut, "route long, digest binary, segment binary, doc_id long, text_id long, start int", chunk=64)
    found = written(segments, "segments")
    dropped(repeated)

    def index(rows: Iterator[tuple]) -> Iterator[tuple]:
        block, size, at, last = [], 0, None, None
        for route, digest, segment, doc_id in rows:
            if route != at and size >= BLOCK_WORDS:
                yield from earliest(block, window)
                block, size = [], 0
            if (route, digest) == (at, last):
                entry = block[-1]
                entry[1] = entry[1] if segment is None else segment.split(b" ")
                entry[3] = max(entry[3], doc_id)
                continue
            at, last = route, digest
            block.append([digest, segment.split(b" ") if segment is not None else None, doc_id, doc_id])
            size += 2 * window - GRAM + 1
        yield from earliest(block, window)

    shards = found.where("route is not null").select("route", "digest", "segment", "doc_id").repartition("route").sortWithinPartitions("route", "digest", "doc_id")
    holders = map_rows(shards, index, "digest binary, holders array<long>", chunk=256)
    hits = found.select("digest", "doc_id", "text_id", "start").join(holders, "digest")
    starts = F.filter(F.transform("holders", lambda h, j: F.when(h < F.col("doc_id"), F.col("start") + j)), lambda s: s.isNotNull())
    hits = hits.select("doc_id", "text_id", starts.alias("starts")).where(F.size("starts") > 0)
    hits = written(hits.groupBy("doc_id", "text_id").agg(F.flatten(F.collect_list("starts")).alias("starts")), "removed")
    dropped(found)

    return hits


def earliest(block: list[tuple], window: int) -> Iterator[tuple]:
    """For the segments of whole routes: digest and, for each window, the smallest doc_id that holds it."""
    if not block:
        return
    number: dict[bytes, int] = {}
    texts = [np.array([number.setdefault(w, len(number) + 1) for w in words], np.int64) for _, words, _, _ in block]
    gap = np.zeros(1, np.int64)
    index = FMIndex(np.concatenate([x for t in texts for x in (t, gap)]), window + 1)
    owner = np.repeat(np.array([first for _, _, first, _ in block], np.int64), [len(t) + 1 for t in texts])
    _, _, firsts = index.classes(window)
    least = np.minimum.reduceat(owner[index.order], firsts)
    for (digest, _, first, last), (low, _) in zip(block, index.windows(texts, window), strict=True):
        holders = least[np.searchsorted(firsts, low)]
        if last > first or (holders < first).any():
            yield digest, holders.tolist()


def _keep(n_words: int, starts: list[int] | None, window: int) -> np.ndarray:
    gone = np.zeros(n_words + 1, np.int32)
    if starts is not None and len(starts):
        at = np.unique(np.asarray(starts))
        gone[at] += 1
        np.add.at(gone, at + window, -1)
    return np.cumsum(gone[:-1]) == 0


def _without(raw: bytes, starts: list[int], window: int) -> bytes:
    spans = [m.span() for m in _WORD.finditer(raw)]
    ends = [a for a, _ in spans[1:]] + [len(raw)]
    keep = _keep(len(spans), starts, window).tolist()
    return raw[: spans[0][0]] + b"".join([raw[a:b] for (a, _), b, k in zip(spans, ends, keep, strict=True) if k])

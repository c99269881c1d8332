"""Jaccard join of word-shingle sets by parity sketches.

A shingle toggles one bit of a sketch, so the Hamming distance of two sketches is at most the symmetric difference of
the sets, and a pair of similarity t or more differs by at most d = (1 - t) / (1 + t) * (|A| + |B|). Documents are put
into size bands; a pair belongs to the band of its larger set. In a band the sketch is cut into p = d + 1 + z pieces
(each of 2^32 bits, held sparsely as the XOR of one random word per set bit), so a similar pair agrees on at least
1 + z pieces. A piece that no shingle falls into says nothing: z is the number of empty pieces that nearly every
document of the band stays under, so a similar pair also shares a piece that isn't empty; only the documents with more
empty pieces than z join on those too, which keeps the join exact.

The pieces are what documents are joined on: their XOR values, told apart by a 64-bit checksum. The dense sketch, a bit or
more to a shingle, is the one whose Hamming distance is measured, as a filter between that join and the verification.

Flow: (1) one pass gives each document its set's size, digest and dense sketch; equal sets fold into a class, named by
its smallest doc_id. (2) A second pass over the classes' texts emits (piece key, class), one key for about four
shingles. Of the classes of one block (BLOCK_KEYS keys of a task) that share a key only the smallest, the key's head
there, meets those of other blocks; so a key that a third of all documents share costs a row per block. (3) Every class
is paired with its head, and every head with the key's smallest; pairs pass the Hamming filter and are verified on whole
sets, in the JVM. (4) Verified links form components. PIVOT_ROUNDS times every key that still holds several components
pairs its classes with one drawn by a hash, another for each key, which ties most groups of loosely alike texts together;
what then still holds several components is joined pair by pair, across components and through the same filter, and
verified. No bucket is ever collected, and no pairs are made
inside a group that is already one component. Step (4) is quadratic in the number of components that share one piece,
that is some hashed shingles and no other in that slice: unlinked texts rarely do.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from tessera.llm.common import BROADCAST_IDS, by_ids, dropped, few, give_back, map_rows, text_or_empty, written
from tessera.llm.components import components

LEAST_WORDS = 8  # 64-bit words of a dense sketch
BAND_RATIO = 1.5
BLOCK_KEYS, PIVOT_ROUNDS = 1 << 18, 2
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of size words; of the whole sequence if it is shorter; none without words."""
    words = text.encode().lower().split()  # bytes: A-Z only, and white space is U+0009 to U+000D and space
    if not words:
        return np.empty(0, np.uint64)
    h = np.array(list(map(xxh3_64_intdigest, words)), dtype=np.uint64)
    n = max(1, len(h) - size + 1)
    width = min(size, len(h))
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out + h[k : k + n]) * np.uint64(2 * k + 3)
    return np.unique(mix(out))


def edges_of_bands(limit: int) -> list[int]:
    """Smallest sizes of the bands up to one that begins above limit."""
    found = [1]
    while found[-1] <= limit:
        found.append(max(found[-1] + 1, int(found[-1] * BAND_RATIO)))
    return found


@lru_cache(maxsize=4096)
def band_pieces(low: int, high: int, percent: int) -> tuple[int, int]:
    """Pieces and allowed empty pieces of the band of sizes low to high."""
    least = 2 * high * (100 - percent) // (100 + percent) + 1
    mean = least * exp(-low * percent / 100 / least)
    slack = ceil(mean + 4 * sqrt(mean))
    return least + slack, slack


def piece_keys(found: np.ndarray, percent: int) -> np.ndarray:
    """Join keys of a set: in its own band and in those above that a similar larger set can be in."""
    size = len(found)
    edges = edges_of_bands(size * 100 // percent)
    keys = []
    for b, (low, after) in enumerate(zip(edges, edges[1:], strict=False)):
        if after <= size:
            continue
        if low > size * 100 // percent:
            break
        pieces, slack = band_pieces(low, after - 1, percent)
        at = ((found >> np.uint64(32)) * np.uint64(pieces)) >> np.uint64(32)  # grows with the sorted hashes
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        values = np.bitwise_xor.reduceat(mix(found ^ np.uint64(0x9E3779B97F4A7C15)), starts)
        where = at[starts]
        if pieces - len(where) > slack:
            empty = np.setdiff1d(np.arange(pieces, dtype=np.uint64), where)
            where, values = np.concatenate((where, empty)), np.concatenate((values, np.zeros(len(empty), np.uint64)))
        keys.append(mix(values ^ mix(where * np.uint64(0x2545F4914F6CDD1D) + np.uint64(b + 1))))
    return np.concatenate(keys)


def dense_sketch(found: np.ndarray) -> np.ndarray:
    """The parity of the shingles at each bit, as 64-bit words: a power of two of them, at least a bit to a shingle.

    A sketch of twice the words folds to one of half by XOR of its halves, so sketches of different sizes compare.
    """
    words = max(LEAST_WORDS, 1 << max(0, (len(found) - 1) // 64).bit_length())
    bit = ((found >> np.uint64(8)) % np.uint64(64 * words)).astype(np.int64)
    odd = (np.bincount(bit, minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def folded_sketch(sketch: np.ndarray) -> np.ndarray:
    """A dense sketch folded to LEAST_WORDS words."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, LEAST_WORDS), axis=0)


def _sizes_allow(percent: int) -> Column:
    return F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent


def _near(distance: Column, percent: int) -> Column:
    """Whether a link allows this Hamming distance: it is at most the difference of the sets."""
    return distance * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)


def _may_link(percent: int) -> Column:
    """Whether sizes and folded sketches of the sides x and y allow a link."""
    distance = sum((F.bit_count(F.col("x.folded")[k].bitwiseXOR(F.col("y.folded")[k])) for k in range(1, LEAST_WORDS)), F.bit_count(F.col("x.folded")[0].bitwiseXOR(F.col("y.folded")[0])))
    return _sizes_allow(percent) & _near(distance, percent)


def _may_link_whole(percent: int) -> Column:
    """Whether the whole dense sketches of x and y allow a link."""
    x, y = F.col("x.sketch"), F.col("y.sketch")
    words = F.least(F.size(x), F.size(y))

    def word(sketch: Column, k: Column) -> Column:  # sizes that allow a link differ by one folding at most
        return F.when(F.size(sketch) > words, F.get(sketch, k).bitwiseXOR(F.get(sketch, k + words))).otherwise(F.get(sketch, k))

    distance = F.aggregate(F.sequence(F.lit(0), words - 1), F.lit(0), lambda sum, k: sum + F.bit_count(word(x, k).bitwiseXOR(word(y, k))))
    return (F.greatest(F.size(x), F.size(y)) > 2 * words) | _near(distance, percent)


def similar_documents(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text).

    Documents link when 100 * |A and B| >= percent * |A or B| over their sets of shingle-word shingles (A-Z
    lower-cased). component_id is the smallest doc_id reachable by links. Empty and null texts have no shingles and link
    with nothing. Rows that share a doc_id count as one document that has all their links. A null doc_id links with
    nothing and has a null component. Other columns are ignored; an empty table gives an empty one.
    """
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))

    def describe(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            found = shingle_set(text, shingle)
            sketch = dense_sketch(found)
            yield doc_id, len(found), xxh3_128_digest(found.tobytes()), sketch, folded_sketch(sketch)

    about = written(map_rows(texts, describe, "doc_id long, n long, set_id binary, sketch array<long>, folded array<long>"), "sets")
    repeated = about.where("doc_id is not null and n > 0").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most")).where("rep < most").select("set_id", "rep")
    repeated = written(repeated, "repeated-sets")
    folded = about.join(few(repeated), "set_id", "left").select("doc_id", "n", "sketch", "folded", F.coalesce("rep", "doc_id").alias("rep"))
    folded = written(folded, "folded")
    linkable = folded.where("doc_id is not null and n > 0")
    reps = linkable.where("doc_id = rep").select("doc_id", "n", "sketch", "folded")
    # A doc_id that stands for a class by one of its texts keeps them all.
    copies = linkable.where("doc_id <> rep").select("doc_id").join(reps.select("doc_id"), "doc_id", "left_anti").distinct()
    copies = written(copies, "copies")

    schema = pa.schema([("key", pa.int64()), ("rep", pa.int64()), ("head", pa.int64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = shingle_set(text, shingle)
                    if not len(found):
                        continue
                    keys.append(piece_keys(found, percent).view(np.int64))
                    ids.append(np.full(len(keys[-1]), doc_id, np.int64))
                    held += len(keys[-1])
                    if held >= BLOCK_KEYS:
                        yield from headed(np.concatenate(keys), np.concatenate(ids))
                        keys, ids, held = [], [], 0
        if held:
            yield from headed(np.concatenate(keys), np.concatenate(ids))
        give_back()

    def headed(keys: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows (key, class, head): no head where the class alone has the key in this block, itself where it is the head."""
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        first = np.concatenate(([True], keys[1:] != keys[:-1]))
        head = ids[np.flatnonzero(first)][np.cumsum(first) - 1]
        alone = first & np.concatenate((first[1:], [True]))
        fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])))
        columns = [pa.array(keys), pa.array(ids), pa.array(head, mask=alone)]
        whole = pa.RecordBatch.from_arrays(columns, schema=schema).filter(pa.array(fresh))
        for at in range(0, whole.num_rows, 1 << 16):
            yield whole.slice(at, 1 << 16)

    first_texts = by_ids(texts.where("doc_id is not null"), copies, "left_anti")
    keyed = first_texts.mapInArrow(emit, "key long, rep long, head long")
    # Heads meet by key; the others lie apart, each by itself, so that no task gets all of a key.
    led = F.when(F.col("head") != F.col("rep"), F.col("rep"))
    by_key = Window.partitionBy("key", led)
    shared = keyed.withColumns({"pivot": F.min("rep").over(by_key), "most": F.max("rep").over(by_key)}).where("head is not null or pivot < most")
    buckets = written(shared.select("key", "rep", F.when(led.isNotNull(), F.col("head")).otherwise(F.col("pivot")).alias("pivot")), "buckets")

    near = buckets.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    links = _verified(_filtered(near, reps, percent), texts, shingle, percent, "links")
    label = written(components(links), "labels")

    def mixed() -> DataFrame:
        """key, rep, component of the keys that still hold several components."""
        placed = written(buckets.join(label, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("component")).distinct(), "grouped")
        several = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("key")
        return written(placed.join(several, "key", "left_semi"), "mixed")

    def joined(found: DataFrame) -> DataFrame:
        return written(components(label.select(F.col("component").alias("a"), F.col("node").alias("b")).union(found)), "labels")

    for turn in range(PIVOT_ROUNDS):
        left = mixed()
        drawn = left.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "key", "rep").alias("at"), F.col("rep").alias("pivot"), F.col("component").alias("its"))).alias("p")).select("key", "p.pivot", "p.its")
        tried = left.join(written(drawn, "pivots"), "key").where("component <> its").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
        found = _verified(_filtered(tried, reps, percent), texts, shingle, percent, "links")
        if found.isEmpty():
            break
        label = joined(found)

    sided = written(mixed().join(reps, F.col("rep") == F.col("doc_id")).select("key", "rep", "component", "n", "folded"), "sided")
    dropped(buckets)
    rest = sided.alias("x").join(sided.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component")) & _may_link(percent))
    rest = written(rest.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct(), "rest")
    more = _verified(_filtered(rest, reps, percent), texts, shingle, percent, "more-links")

    member = linkable.select("doc_id", "rep").distinct()
    # A doc_id of several texts ties their classes together.
    tied = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("doc_id")
    tied = written(member.join(tied, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "ties")
    again = written(more.union(tied), "more")
    if not again.isEmpty():
        label = joined(again)
    known = member.join(label, F.col("rep") == F.col("node"), "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = folded.select("doc_id", F.col("n").alias("n_shingles")).join(known, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = written(out, "similar")
    for old in (about, repeated, folded, copies, links, sided, more):
        dropped(old)
    return out


def _filtered(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    x, y = reps.alias("x"), reps.alias("y")
    both = pairs.join(x, F.col("a") == F.col("x.doc_id")).join(y, F.col("b") == F.col("y.doc_id"))
    return both.where(_may_link(percent) & _may_link_whole(percent)).select("a", "b").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int, name: str) -> DataFrame:
    """The pairs whose whole sets are similar enough; sets are made again for the documents that take part only.

    Sets are compared where they meet, row by row in the JVM, so a task holds one pair of them.
    """
    pairs = written(pairs, name)
    if pairs.isEmpty():
        return pairs
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")

    def sets(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            yield doc_id, shingle_set(text, shingle).view(np.int64)

    found = written(map_rows(by_ids(texts, wanted, "left_semi"), sets, "doc_id long, words array<long>", chunk=64), "pair-sets")
    x, y = found.select(F.col("doc_id").alias("a"), F.col("words").alias("x")), found.select(F.col("doc_id").alias("b"), F.col("words").alias("y"))
    met = pairs.join(x, "a").join(y, "b").select("a", "b", F.size("x").alias("n_x"), F.size("y").alias("n_y"), F.size(F.array_intersect("x", "y")).alias("common"))
    kept = written(met.where(100 * F.col("common").cast("long") >= percent * (F.col("n_x") + F.col("n_y") - F.col("common")).cast("long")).select("a", "b").distinct(), name)
    for old in (pairs, wanted, found):
        dropped(old)
    return kept

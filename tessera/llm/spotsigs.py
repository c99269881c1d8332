"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A signature is an anchor with the next CHAIN content words after it, whatever common words stand between. Anchors are the
common words of four languages. Where none of the BARE words before a place is a common word (lists, tables, other
languages), content words picked by their hash, one of PICKED, are anchors too, so that such stretches count; what
anchors a place depends on those words alone, so an edit elsewhere leaves it. A text without any complete chain has one
signature, of its whole word sequence; a text without words has none. A fingerprint is the sorted set of 32-bit signature
hashes, in base64.

Documents meet their successor in descending doc_id by one range shuffle of whole texts: cells of ascending doc_id are
cut at quantiles, each cell is sorted, and the first document of the cell below is added to each cell's end. A task
holds a few texts at a time. Two given sets are compared by plain Jaccard; the similar pairs of a whole corpus are found
by folding equal fingerprints and joining on length partition and signature, rarest signatures only, before Jaccard is
computed (`similar_pairs`).
"""

from __future__ import annotations

import base64
import hashlib
import string
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tessera.llm.common import map_rows, text_or_empty, written
from tessera.llm.parity_join import mix

CHAIN, BARE, PICKED, CELLS = 2, 16, 4, 2000
#: Common words of English, German, French and Spanish.
COMMON = """
the of and to in a is that it for on as with was be by are this from or an at which not
der die das und zu von mit den ist im ein eine nicht sich auf für dem des als auch es
le la les de des du et en un une que qui dans pour par sur est pas au aux avec il elle
el los las y que del se por con para una su al lo como más
""".split()
_BLANK = bytes(32 if chr(b) in string.punctuation else b for b in range(256))
_ANCHORS = np.array(sorted({xxh3_64_intdigest(w.encode()) for w in COMMON}), np.uint64)
_MAYBE = np.zeros(1 << 16, bool)
_MAYBE[(_ANCHORS & np.uint64(0xFFFF)).astype(np.int64)] = True


def signatures(text: str) -> np.ndarray:
    """Sorted distinct 32-bit signature hashes of a text."""
    words = text.lower().encode().translate(_BLANK).split()
    if not words:
        return np.empty(0, np.uint32)
    h = np.array(list(map(xxh3_64_intdigest, words)), dtype=np.uint64)
    common = _MAYBE[(h & np.uint64(0xFFFF)).astype(np.int64)]
    maybe = np.flatnonzero(common)
    common[maybe] = np.isin(h[maybe], _ANCHORS)
    seen = np.concatenate(([0], np.cumsum(common)))
    place = np.arange(len(h))
    bare = seen[place + 1] == seen[np.maximum(place - BARE, 0)]
    picked = (h >> np.uint64(40)) % np.uint64(PICKED) == 0
    anchors = np.flatnonzero(common | (bare & picked))
    content = np.flatnonzero(~common)
    after = np.searchsorted(content, anchors, side="right")
    whole = after + CHAIN <= len(content)
    anchors, after = anchors[whole], after[whole]
    if not len(anchors):
        return np.array([xxh3_64_intdigest(b" ".join(words)) >> 32], np.uint32)
    found = h[anchors]
    for k in range(CHAIN):
        found = mix(found + np.uint64(k + 1)) * np.uint64(2 * k + 3) ^ h[content[after + k]]
    return np.unique((mix(found) >> np.uint64(32)).astype(np.uint32))


def fingerprint(found: np.ndarray) -> str:
    return base64.b64encode(found.astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def edited(text: str, other: str) -> str:
    """text with its last third of code points (rounded down) replaced by as many of other's first ones."""
    third = len(text) // 3
    return text[: len(text) - third] + other[:third]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for every row of docs.

    The next document is the one of the next smaller doc_id, after the last one the first. Null texts are empty. Rows
    that share a doc_id follow each other by descending text; rows without a doc_id come last. A single row is its own
    next. Empty texts have empty fingerprints, which are like each other (1) and unlike all else (0). Other columns
    are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    cells = min(CELLS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = texts.approxQuantile("doc_id", [k / cells for k in range(1, cells)], 1 / (8 * cells)) if cells > 1 else []
    bounds = F.array(*[F.lit(int(c)) for c in sorted(set(cuts))]).cast("array<long>")
    placed = texts.withColumn("cell", F.coalesce(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))), F.lit(0)) if cuts else F.lit(0))
    tops = sorted((r.cell, r.top) for r in placed.select("cell", "doc_id").groupBy("cell").agg(F.max("doc_id").alias("top")).collect() if r.top is not None)
    below = [(tops[k - 1][1], tops[k][0]) for k in range(1, len(tops))] + [(top[1], cell) for top in tops[-1:] for cell in {0, tops[0][0]}]
    carried = spark.createDataFrame(below, "doc_id long, cell int")  # a row per cell at most, so it is broadcast
    carried = texts.where(F.col("doc_id").isin([d for d, _ in below])).join(F.broadcast(carried), "doc_id").groupBy("doc_id", "cell").agg(F.max("text").alias("text"))
    both = placed.select("cell", F.lit(0).alias("carried"), "doc_id", "text").unionByName(carried.select("cell", F.lit(1).alias("carried"), "doc_id", "text"))
    order = ["cell", "carried", F.col("doc_id").desc_nulls_last(), F.col("text").desc()]

    def row(now: tuple, after: tuple) -> tuple:
        doc_id, text, found = now
        changed = edited(text, after[1])
        new = signatures(changed)
        return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), fingerprint(found), fingerprint(new), likeness(found, new), likeness(found, after[2])

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        at = first = now = None
        for cell, is_carried, doc_id, text in rows:
            if cell != at:
                if now:  # a cell without a carried row holds all rows: the first follows the last
                    yield row(now, first)
                at, first, now = cell, None, None
            this = (doc_id, text, signatures(text))
            if now:
                yield row(now, this)
            first = first or this
            now = None if is_carried else this
        if now:
            yield row(now, first)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    dealt = both.repartitionById(cells, F.col("cell")).sortWithinPartitions(*order)
    return map_rows(dealt, run, schema, chunk=64)


def similar_pairs(docs: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, likeness) of fingerprint classes that are at least that alike, and membership (doc_id, class_id).

    Equal fingerprints form a class named by its smallest doc_id. Sets are partitioned by length, each partition 1 / least
    times as long as the one before, so a similar pair lies in one partition or in two neighbouring ones. Classes meet on
    partition and signature, the smaller set's also in the partition above, and on their rarest signatures only (as many
    as a similar pair can't miss); pairs of too different lengths are left out, the others verified by Jaccard over
    whole sets. Texts without signatures pair with nothing; rows without a doc_id are left out.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            yield doc_id, signatures(text).astype(np.int64)

    found = map_rows(docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), run, "doc_id long, signs array<long>")
    found = written(found.withColumn("name", F.sha2(F.array_join(F.col("signs").cast("array<string>"), ","), 256)), "spots")
    first = written(found.groupBy("name").agg(F.min("doc_id").alias("class_id")), "spot-classes")
    member = found.select("doc_id", "name").join(first, "name").select("doc_id", "class_id")
    classes = found.join(first, "name").where("doc_id = class_id and size(signs) > 0").select("class_id", "signs").dropDuplicates(["class_id"])
    classes = written(classes, "spot-sets")
    spots = classes.select("class_id", F.size("signs").alias("n"), F.explode("signs").alias("sign"))
    often = written(spots.groupBy("sign").agg(F.count("*").alias("often")).where("often > 1"), "spot-counts")
    rare = Window.partitionBy("class_id").orderBy("often", "sign")
    missed = F.col("n") - F.ceil(F.col("n") * least) + 1
    # Signatures of one class only can't be shared; they take the first places of the order.
    shared = spots.join(often, "sign").withColumns({"place": F.row_number().over(rare), "shared": F.count("*").over(Window.partitionBy("class_id"))})
    prefix = shared.where(F.col("place") + F.col("n") - F.col("shared") <= missed).select("sign", "class_id", "n")
    part = (F.floor(F.log(F.col("n").cast("double")) / -np.log(least) + 1e-9) if least < 1 else F.col("n")).cast("long")
    prefix = written(prefix.withColumn("part", part), "spot-prefixes")
    x = prefix.select("sign", F.explode(F.array("part", F.col("part") + 1)).alias("part"), F.col("part").alias("own"), F.col("class_id").alias("x"), F.col("n").alias("n_x"))
    y = prefix.select("sign", "part", F.col("class_id").alias("y"), F.col("n").alias("n_y"))
    lengths = F.least("n_x", "n_y") >= least * F.greatest("n_x", "n_y")
    met = x.join(y, ["part", "sign"]).where((F.col("x") != F.col("y")) & ((F.col("own") < F.col("part")) | (F.col("x") < F.col("y"))) & lengths)
    met = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    sides = met.join(classes.select(F.col("class_id").alias("a"), F.col("signs").alias("s")), "a").join(classes.select(F.col("class_id").alias("b"), F.col("signs").alias("t")), "b")
    common = F.size(F.array_intersect("s", "t"))
    return sides.select("a", "b", (common / (F.size("s") + F.size("t") - common)).alias("likeness")).where(F.col("likeness") >= least), member

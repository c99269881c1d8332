"""From raw documents to token ids: quality, near duplicates, repeated passages, source mix, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents; n_chars follows the text. Rows with null or
empty texts pass the stages like others (quality scores them, they have no near duplicates and no passages, and encode
to no tokens). Where a stage decides by doc_id, rows that share one are decided alike and rows without one are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.bpe import encode_documents
from tessera.llm.common import by_ids, table_path, written
from tessera.llm.line_crf import fit, keep_accepted
from tessera.llm.mixing import sampled
from tessera.llm.parity_join import similar_documents
from tessera.llm.queries import MIX_POWER, MIX_SHARES
from tessera.llm.substring_dedup import cleaned


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier accepts, scored in place: the text isn't shuffled."""
    return keep_accepted(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group that links of five-word shingles at 0.8 or more connect."""
    found = similar_documents(docs, shingle=5, percent=80)
    return by_ids(docs, written(found.where("component_id <> doc_id").select("doc_id").distinct(), "duplicates"), "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 13-word windows that an earlier document holds."""
    return cleaned(docs, window=13)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix asks for: expected tokens meet the target weights, so those of scarce cells are
    repeated and those of plentiful ones thinned out.

    Languages that MIX_SHARES lacks, null among them, keep their share as for source and topic.
    """
    return sampled(docs, MIX_SHARES, MIX_POWER, others=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts; written here, where the batches that go to Python are bounded in bytes."""
    from public_tokenizers import path

    return written(encode_documents(docs, path("word_bpe_49k.json"), with_ids=True), "encoded")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", encode),
]

#: The trained classifier can't be expressed in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = table_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""A corpus made ready for training: five stages, each on all that the stage before kept.

Language identification and quality drop documents, near-duplicate removal keeps one of each group, mixing
repeats documents to reach its sources' targets, and packing cuts what is left into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import langid, mixing, packing, quality, simhash
from cadenza.llm.shared import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Code length above which no learned language explains a text; plain bytes would take 8.
MAX_BITS = 7.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter that some learned language can code."""
    model = langid.fit(docs, ~langid.held_out(F.col("doc_id")))
    said = langid.predict(docs, model)
    return said.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("bits_per_byte") < MAX_BITS)).select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels, threshold=0.3).where("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return simhash.keep_one_of_each(docs, words=5, similarity=0.8).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mix_documents(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    packed = packing.pack_documents(
        docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN, capacity=1024,
    )
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("pack", pack),
]

#: The first two stages are learned models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

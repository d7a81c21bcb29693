"""A corpus from raw documents to packed token sequences: five stages, each written and read again before the next.

Quality rules drop what they reject; of near-duplicates (five-word shingles, similarity 0.8) one document stays; personal
data is replaced in the texts; documents are repeated or left out so that sources meet their target weights; what is left
is tokenised and packed. All stages but the last return the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foliomill.llm import jaccard_join, mixing, packing, personal_data, quality_rules
from foliomill.llm.shared import stored

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram Jaccard links join: the one of smallest id."""
    return jaccard_join.deduplicated(docs, words=5, percent=80)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return personal_data.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them."""
    return mixing.mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token sequences with their places in packed sequences."""
    return packing.packed(stored(packing.pieces(docs, TOKENIZER), "pieces"))


STAGES = [("quality rules", quality), ("n-gram jaccard join", near_duplicates), ("personal data", personal), ("mixing", mix), ("packing", pack)]

#: Training, decoding and packing have no SQL; test_pipeline_against_plain_loops in tests/llm compares all stages with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{i}")
    return docs

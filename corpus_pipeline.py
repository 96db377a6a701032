"""A training-data pipeline over ``documents``: quality, recurring lines, near-duplicates, mix, packing.

Every stage is a function (spark, docs, sf_dir) -> DataFrame whose result is written as Parquet and read
again as the next stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import line_dedup, mixing, packing, quality, simhash
from riskloom.llm.common import Stages

#: near-duplicates of the pipeline: shingles of five words; texts that share 0.8 of them link, and those whose
#: 64-bit fingerprints differ in up to 10 bits if they share half (riskloom/llm/verify.py). 48 sets of 16 bits
#: let 94 % of fingerprints at 10 bits meet, 99 % at 7; pairs at 0.8 do not depend on them
SHINGLE, RADIUS, KEY_BITS, KEY_SETS = 5, 10, 16, 48
TOKENIZER = "byte_bpe_50k.json"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labelled ones among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels).filter("predicted = 1").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; those made of nothing else go."""
    return line_dedup.without_recurring_lines(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near-duplicates, links verified on the shingle sets."""
    return simhash.keep_first(docs, shingle=SHINGLE, radius=RADIUS, parts=simhash.sampled_masks(KEY_BITS, KEY_SETS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share of the mix takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their ids, sequence and offset."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER), with_ids=True)


STAGES = [("quality classifier", keep_good), ("line dedup", drop_lines), ("SimHash near-dedup", one_of_each),
          ("mixing to target weights", mix), ("packing", pack)]
#: a learned classifier and a tokenizer have no SQL; tests/llm/test_pipeline.py checks every stage by brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = Stages(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = st.write(f"stage_{k}", stage(spark, docs, sf_dir))
        if k:
            st.drop(f"stage_{k - 1}")
    return docs

"""From raw documents to packed sequences: the stages of a training-data pipeline, each one operator of ``hushframe.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hushframe.llm.catalog import query
from hushframe.llm.exact_dedup import exact_dedup
from hushframe.llm.mixing import mix_documents
from hushframe.llm.near_copies import near_dedup
from hushframe.llm.packing import pack_documents
from hushframe.llm.toxicity import drop_toxic
from hushframe.session import Scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of toxicity."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word shingles of similarity 0.8 or more the document with the smallest id.

    SimHash fingerprints within four bits are candidates; signatures add the alike texts that fingerprints do not reach,
    see the README.  Whole sets decide.
    """
    return near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", reject_toxic), ("exact dedup", drop_copies), ("simhash near-dedup", drop_near_copies), ("mixing", mix_sources), ("best-fit packing", pack_sequences),
]
ORACLE_SQL = None  # fitted trees and XXH64 fingerprints have no SQL; tests hold the near-copy stage against brute force, the others by their operators


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's table is deleted once the next one's is stored."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        held = Scratch(spark)
        docs = held(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        before.close()
        before = held
    out = STAGES[-1][1](spark, docs, sf_dir)  # packing has stored its pieces
    before.close()
    return out


query("pipeline", ORACLE_SQL)(run)

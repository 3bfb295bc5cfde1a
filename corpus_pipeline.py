"""The corpus pipeline: toxic documents go, one of each group of near duplicates stays, repeated passages are cut, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before has kept; all but the last return the
columns of documents. run() writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.jaccard import near_duplicates
from seqloom.llm.packing import pack
from seqloom.llm.queries import tokenizer_path
from seqloom.llm.shared import release, written
from seqloom.llm.substring import repeated_spans
from seqloom.llm.toxicity import with_scores

#: Texts whose five-word shingles have this Jaccard similarity or more are near duplicates.
SIMILARITY = 0.8
#: The radius of fingerprints that stood for it before; no stage uses it, a test still reads it.
NEAR_BITS = 7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores under 0.7. It learns from the labelled rows of the table documents."""
    scored = with_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    release()  # what the training took
    return scored.where("predicted = 0").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; rows without an id stay."""
    groups = near_duplicates(docs, shingle=5, similarity=SIMILARITY)
    copies = written(groups.where("component_id < doc_id").select("doc_id").distinct(), "copies")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds; n_chars follows the text. None goes, even if nothing is left."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = repeated_spans(docs, carry=rest)
    own = {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    if "n_chars" in rest:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("carried.n_chars"))
    return cut.select(*(own.get(c, F.col("carried")[c]).alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]

#: No SQL: a trained network, fingerprints and a tokenizer are beyond it; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

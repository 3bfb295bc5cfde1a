"""Random FASTA files for benchmarks, made by the tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.sources.writers import write_sequences


def random_records(spark: SparkSession, records: int, shortest: int = 500, longest: int = 2000, repeats: int = 10, seed: int = 42) -> DataFrame:
    """Records of random bases. A length is a number from `shortest` to `longest` times one from 1 to `repeats`; the seed fixes all.

    A record's bases follow from its number alone, so the number of tasks changes nothing.
    """

    def draw(tag: str, *more) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), "ord", *more), F.lit(1 << 40))

    size = (draw("length") % (longest - shortest + 1) + shortest) * (draw("times") % repeats + 1)
    base = lambda i: F.element_at(F.array(*(F.lit(x) for x in "ACGT")), (draw("base", i) % 4 + 1).cast("int"))
    df = spark.range(records).select(F.lit(0).alias("file_ord"), F.col("id").alias("ord")).withColumn("_n", size.cast("int"))
    seq = F.array_join(F.transform(F.sequence(F.lit(1), F.col("_n")), base), "")
    return df.select("file_ord", "ord", F.concat(F.lit("seq_"), F.col("ord").cast("string")).alias("id"), F.concat(F.lit("length="), F.col("_n").cast("string")).alias("desc"), seq.alias("seq"), F.lit(None).cast("string").alias("qual"))


def write_random_fasta(spark: SparkSession, path: str, records: int = 1_000_000, width: int = 60, seed: int = 42) -> None:
    """random_records() as a folder of FASTA files."""
    write_sequences(random_records(spark, records, seed=seed), path, width=width, ordered=False)

"""The driver's tables as sequence records: the same views in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(df: DataFrame, ord_: str, id_, desc, seq) -> DataFrame:
    return df.select(F.lit(0).alias("file_ord"), F.col(ord_).alias("ord"), id_.alias("id"), desc.alias("desc"), seq.alias("seq"), F.lit(None).cast("string").alias("qual"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as nucleotide records: the letters ACGTN of each text."""
    d = table(spark, sf_dir, "documents")
    return _records(d, "doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.col("lang"), F.regexp_replace("text", "[^ACGTNacgtn]", ""))


def gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reads with gaps: spaces and line ends as - and . ."""
    d = table(spark, sf_dir, "documents")
    return _records(d, "doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.col("lang"), F.translate(F.regexp_replace("text", "[^ACGTNacgtn \n]", ""), " \n", "-."))


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as records of any ASCII letters."""
    d = table(spark, sf_dir, "documents")
    return _records(d, "doc_id", F.concat(F.lit("p"), F.col("doc_id").cast("string")), F.col("lang"), F.regexp_replace("text", "[^A-Za-z]", ""))


def with_quals(df: DataFrame) -> DataFrame:
    """Records with a quality for each letter."""
    return df.withColumn("qual", F.translate("seq", "ACGTNacgtn-.", "I?5+#H>4*\"!!"))


def grouped_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reads whose id is their source: few ids, many ties."""
    d = table(spark, sf_dir, "documents")
    return _records(d, "doc_id", F.col("source"), F.col("lang"), F.regexp_replace("text", "[^ACGTNacgtn]", ""))


def page_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as nucleotide records."""
    d = table(spark, sf_dir, "pages")
    return _records(d, "page_id", F.concat(F.lit("w"), F.col("page_id").cast("string")), F.col("url"), F.regexp_replace("html", "[^ACGTNacgtn]", ""))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as BED regions of reads."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("bed_ord"), F.concat(F.lit("d"), (F.col("event_id") % 1000).cast("string")).alias("seq_id"), F.col("user_id").alias("start"), (F.col("user_id") + F.floor("value").cast("long")).alias("end"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("name"))


def id_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the reads whose label says good quality."""
    return table(spark, sf_dir, "labels").where("quality = 1").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"))


#: The views as common table expressions for DuckDB.
SQL = {
    "reads": "reads AS (SELECT 0 AS file_ord, doc_id AS ord, 'd' || doc_id AS id, lang AS \"desc\", regexp_replace(text, '[^ACGTNacgtn]', '', 'g') AS seq, CAST(NULL AS VARCHAR) AS qual FROM documents)",
    "gapped": "gapped AS (SELECT 0 AS file_ord, doc_id AS ord, 'd' || doc_id AS id, lang AS \"desc\", translate(regexp_replace(text, '[^ACGTNacgtn \\n]', '', 'g'), ' ' || chr(10), '-.') AS seq FROM documents)",
    "proteins": "proteins AS (SELECT 0 AS file_ord, doc_id AS ord, 'p' || doc_id AS id, lang AS \"desc\", regexp_replace(text, '[^A-Za-z]', '', 'g') AS seq FROM documents)",
    "quals": "quals AS (SELECT * EXCLUDE (qual), translate(seq, 'ACGTNacgtn-.', 'I?5+#H>4*\"!!') AS qual FROM reads)",
    "grouped_reads": "grouped_reads AS (SELECT 0 AS file_ord, doc_id AS ord, source AS id, lang AS \"desc\", regexp_replace(text, '[^ACGTNacgtn]', '', 'g') AS seq FROM documents)",
    "page_reads": "page_reads AS (SELECT 0 AS file_ord, page_id AS ord, 'w' || page_id AS id, url AS \"desc\", regexp_replace(html, '[^ACGTNacgtn]', '', 'g') AS seq FROM pages)",
    "regions": "regions AS (SELECT event_id AS bed_ord, 'd' || (event_id % 1000) AS seq_id, user_id AS s, user_id + CAST(floor(value) AS BIGINT) AS e, CASE WHEN event_id % 3 > 0 THEN event_type END AS name FROM events)",
    "id_list": "id_list AS (SELECT DISTINCT 'd' || doc_id AS id FROM labels WHERE quality = 1)",
}


def sql(body: str, *names: str) -> str:
    """A statement over views."""
    return f"WITH {', '.join(SQL[n] for n in names)} {body}"

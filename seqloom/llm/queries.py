"""The thin queries opN_<name> over the driver's tables, each through its operator, and SQL where it can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The place of an installed public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: The rules of the URL query: (host and path, verdict).
URL_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.url_filter import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.substring import repeated_spans

    return repeated_spans(_table(spark, sf_dir, "documents"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.sentencepieces import digests

    return digests(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.html_extract import extract

    return extract(_table(spark, sf_dir, "pages"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.simhash import hexadecimal, near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4).select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.warc import capture_histories

    return capture_histories(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_ts")


def op7_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.gif import text_media

    return text_media(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.toxicity import held_out, with_scores

    scored = with_scores(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.bitsliced import top_k

    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_substring_dedup, op3_sentencepieces, op4_html_extraction, op5_simhash_dedup, op6_warc, op7_gif_media, op8_toxicity, op9_bitsliced_topk, op10_packing)}

ORACLE_SQL = {
    "op1_url_filter": r"""
        WITH u AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
            FROM pages),
        r AS (
            SELECT *, CASE
                WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
                WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
                WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
                WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule
            FROM u)
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(host, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)$') THEN 'block'
            ELSE 'allow' END AS verdict
        FROM r""",
    "op2_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        k AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS win FROM w, unnest(generate_series(1, len(ws) - 12)) AS t(i)),
        m AS (SELECT win, min(doc_id) AS first_id FROM k GROUP BY win),
        c AS (SELECT DISTINCT doc_id, j FROM k JOIN m USING (win), unnest(generate_series(i, i + 12)) AS t(j) WHERE first_id < doc_id),
        x AS (SELECT doc_id, j, ws[j] AS word FROM w, unnest(generate_series(1, len(ws))) AS t(j)),
        g AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS kept FROM x ANTI JOIN c USING (doc_id, j) GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN g USING (doc_id)""",
    "op6_warc": r"""
        WITH p AS (
            SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1),
        j AS (
            SELECT p.*, CASE WHEN first_id IS NOT NULL AND first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to,
                   split_part(substr(url, strpos(url, '://') + 3), '/', 1) AS h,
                   CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM p LEFT JOIN f USING (payload_digest))
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to,
               array_to_string(list_reverse(string_split(lower(split_part(rest, '/', 1)), '.')), ',') || ')'
                 || CASE WHEN strpos(rest, '/') > 0 THEN lower(substr(rest, strpos(rest, '/'))) ELSE '' END AS url_key,
               strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS capture_ts
        FROM j""",
    "op9_bitsliced_topk": r"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}

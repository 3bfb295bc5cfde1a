"""Every query of the sequence operators over the driver's tables, with its SQL."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom import guide
from seqloom.functions import sequence as S
from seqloom.operators import aggregation, extraction, ordering, search, selection, transform
from seqloom.plans import views as V
from seqloom.sources import codec, generator, readers, writers
from seqloom.sources.formats import detect_format
from seqloom.storage import folder, numbered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# ---- SQL of the scalar functions -------------------------------------------------------------------------------------


def _count(bases: str, seq: str = "seq") -> str:
    both = bases.upper() + bases.lower()
    return f"(length({seq}) - length(translate({seq}, '{both}', '')))"


_GC = f"CASE WHEN {_count('ACGTU')} > 0 THEN CAST({_count('GC')} AS DOUBLE) / {_count('ACGTU')} * 100.0 ELSE 0.0 END"
_NUC = "regexp_full_match(seq, '[ACGTUNacgtun.-]+')"
_RC = "translate(reverse(upper(seq)), 'ATUGC', 'TAACG')"
_QSUM = "list_sum(list_transform(string_split(qual, ''), lambda c: ascii(c)))"
_SIZE = ", CAST(length(seq) AS BIGINT) AS n"


def _brief(df: DataFrame, *more: str | Column) -> DataFrame:
    """The place and id of records, a digest of their sequence, and more."""
    return df.select("ord", "id", F.md5(F.col("seq").cast("binary")).alias("seq_md5"), S.seq_length("seq").alias("n"), *more)


_BRIEF = f"ord, id, md5(seq) AS seq_md5{_SIZE}"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics by language of the reads whose GC content is 40 % or more."""
    kept = selection.filter_records(V.reads(spark, sf_dir), gc_min=40.0, min_len=1, check=False)
    return aggregation.sequence_stats(kept, gc=True, by=["desc"]).withColumnRenamed("desc", "lang")


# ---- stats -----------------------------------------------------------------------------------------------------------

_BASE = 'count(*) AS "count", CAST(coalesce(sum(length(seq)), 0) AS BIGINT) AS total_len, CAST(coalesce(min(length(seq)), 0) AS BIGINT) AS min_len, CAST(coalesce(max(length(seq)), 0) AS BIGINT) AS max_len'
_MEAN = "CASE WHEN count(*) > 0 THEN CAST(coalesce(sum(length(seq)), 0) AS DOUBLE) / count(*) ELSE 0.0 END AS mean_len"
_G, _A, _N = (f"CAST(coalesce(sum(CASE WHEN {_NUC} THEN {_count(b)} END), 0) AS BIGINT)" for b in ("GC", "ATU", "N"))
_COMPOSITION = f"CAST(count(*) FILTER ({_NUC}) AS BIGINT) AS nucleotide_count, {_G} AS gc_count, {_A} AS at_count, {_N} AS n_count, CASE WHEN {_G} + {_A} + {_N} > 0 THEN CAST({_G} AS DOUBLE) * 100.0 / ({_G} + {_A} + {_N}) ELSE 0.0 END AS gc_percent, CASE WHEN {_G} + {_A} + {_N} > 0 THEN CAST({_N} AS DOUBLE) * 100.0 / ({_G} + {_A} + {_N}) ELSE 0.0 END AS n_percent"


@_query(V.sql(f"SELECT {_BASE}, {_MEAN} FROM reads", "reads"))
def stats_basic(spark, sf_dir):
    return aggregation.sequence_stats(V.reads(spark, sf_dir))


@_query(V.sql(f"SELECT {_BASE}, {_MEAN}, {_COMPOSITION} FROM reads", "reads"))
def stats_gc(spark, sf_dir):
    return aggregation.sequence_stats(V.reads(spark, sf_dir), gc=True)


@_query(V.sql(f"SELECT {_BASE}, {_MEAN}, {_COMPOSITION} FROM proteins", "proteins"))
def stats_protein(spark, sf_dir):
    return aggregation.sequence_stats(V.proteins(spark, sf_dir), gc=True)


@_query(V.sql(
    f"""SELECT {_BASE}, {_MEAN}, CAST(sum(length(qual)) AS BIGINT) AS qual_count, CAST(sum(coalesce({_QSUM}, 0)) AS BIGINT) AS qual_sum,
    CAST(min(list_min(list_transform(string_split(qual, ''), lambda c: ascii(c)))) AS INTEGER) AS qual_min, CAST(max(list_max(list_transform(string_split(qual, ''), lambda c: ascii(c)))) AS INTEGER) AS qual_max,
    CAST(sum({_QSUM}) AS DOUBLE) / sum(length(qual)) AS mean_qual FROM (SELECT seq, nullif(qual, '') AS qual FROM quals)""",
    "reads", "quals"))
def stats_qual(spark, sf_dir):
    return aggregation.sequence_stats(V.with_quals(V.reads(spark, sf_dir)), qual=True)


@_query(V.sql(f"SELECT {_BASE}, {_MEAN} FROM reads WHERE length(seq) BETWEEN 100 AND 500", "reads"))
def stats_len_window(spark, sf_dir):
    return aggregation.sequence_stats(V.reads(spark, sf_dir), min_len=100, max_len=500)


@_query(V.sql(f'SELECT "desc" AS lang, {_BASE}, {_MEAN}, {_COMPOSITION} FROM reads WHERE {_GC} >= 40.0 AND length(seq) >= 1 GROUP BY 1', "reads"))
def stats_by_lang(spark, sf_dir):
    return flagship(spark, sf_dir)


# ---- filter ----------------------------------------------------------------------------------------------------------


def _filter(name: str, condition: str, views: tuple[str, ...] = ("reads",), source=V.reads, **options) -> None:
    def run(spark, sf_dir):
        return _brief(selection.filter_records(source(spark, sf_dir), **{k: v(spark, sf_dir) if callable(v) else v for k, v in options.items()}))

    run.__name__ = name
    _query(V.sql(f"SELECT {_BRIEF} FROM {views[-1]} WHERE {condition}", *views))(run)


_filter("filter_len", "length(seq) BETWEEN 50 AND 400", min_len=50, max_len=400)
_filter("filter_gc", f"{_GC} BETWEEN 42.0 AND 48.0", gc_min=42.0, gc_max=48.0, check=False)
_filter("filter_regex", "regexp_matches(seq, 'A[CG]T+A')", pattern="A[CG]T+A")
_filter("filter_exclude_regex", "NOT regexp_matches(seq, 'tata|nnn')", exclude_pattern="tata|nnn")
_filter("filter_ids", "id IN (SELECT id FROM id_list)", ("id_list", "reads"), ids=V.id_list)
_filter("filter_ids_invert", "id NOT IN (SELECT id FROM id_list)", ("id_list", "reads"), ids=V.id_list, invert=True)
_filter("filter_id_flags", "id IN ('d3', 'd5', 'd8', 'absent')", ids=["d3", "d5", "d8", "absent"])
_filter("filter_min_qual", f"qual = '' OR CAST({_QSUM} AS DOUBLE) / length(qual) - 33 >= 25", ("reads", "quals"), source=lambda s, d: V.with_quals(V.reads(s, d)), min_qual=25.0)
_filter("filter_no_qual", "true", min_qual=25.0)
_filter("filter_combined", "length(seq) >= 100 AND regexp_matches(seq, 'ga') AND id IN (SELECT id FROM id_list)", ("id_list", "reads"), min_len=100, pattern="ga", ids=V.id_list)
_filter("filter_combined_invert", "NOT (length(seq) >= 100 AND regexp_matches(seq, 'ga'))", min_len=100, pattern="ga", invert=True)
_filter("filter_all_invert", "false", invert=True)
_filter("filter_protein_len", "length(seq) >= 1000", ("proteins",), source=V.proteins, min_len=1000)


@_query(V.sql("SELECT count(*) AS total, count(*) FILTER (length(seq) >= 100) AS kept FROM reads", "reads"))
def filter_counts(spark, sf_dir):
    return selection.filter_counts(V.reads(spark, sf_dir), min_len=100)


# ---- functions, modify, convert --------------------------------------------------------------------------------------


@_query(V.sql(f"SELECT ord, {_GC} AS gc, {_NUC} AS nucleotide, CAST({_QSUM} AS DOUBLE) / length(qual) AS avg_quality, length(seq) AS n FROM quals WHERE seq <> ''", "reads", "quals"))
def scalar_functions(spark, sf_dir):
    r = V.with_quals(V.reads(spark, sf_dir)).where("seq <> ''")
    return r.select("ord", S.gc_content("seq").alias("gc"), S.is_nucleotide("seq").alias("nucleotide"), S.average_quality("qual").alias("avg_quality"), S.seq_length("seq").alias("n"))


@_query(V.sql(f"SELECT ord, {_GC} AS gc, {_RC} AS rc, substr(seq, 2, 4) AS part FROM reads", "reads"))
def sql_functions(spark, sf_dir):
    S.register(spark)
    V.reads(spark, sf_dir).createOrReplaceTempView("seqloom_reads")
    return spark.sql("SELECT ord, seq_gc(seq) AS gc, seq_revcomp(seq) AS rc, seq_slice(seq, 2, 5) AS part FROM seqloom_reads")


def _modify(name: str, seq: str, views: tuple[str, ...] = ("reads",), source=V.reads, where: str = "true", spark_where: str = "true", **options) -> None:
    def run(spark, sf_dir):
        out = transform.modify_records(source(spark, sf_dir).where(spark_where), check=False, **options)
        return _brief(out, F.md5(F.col("qual").cast("binary")).alias("qual_md5")) if "qual" in seq else _brief(out)

    run.__name__ = name
    _query(V.sql(f"SELECT {_BRIEF}{', md5(qual) AS qual_md5' if 'qual' in seq else ''} FROM (SELECT ord, id, {seq} FROM {views[-1]} WHERE {where})", *views))(run)


_quals = lambda s, d: V.with_quals(V.reads(s, d))
_modify("modify_upper", "upper(seq) AS seq", upper=True)
_modify("modify_lower", "lower(seq) AS seq", lower=True)
_modify("modify_upper_wins", "upper(seq) AS seq", upper=True, lower=True)
_modify("modify_revcomp", f"{_RC} AS seq, reverse(qual) AS qual", ("reads", "quals"), _quals, reverse_complement=True)
_modify("modify_slice", "substr(seq, 11, 30) AS seq, substr(qual, 11, 30) AS qual", ("reads", "quals"), _quals, slice_range="11:40")
_modify("modify_remove_gaps", "translate(seq, '-.', '') AS seq", ("gapped",), V.gapped, remove_gaps=True)
_modify("modify_chain", "substr(translate(lower(translate(reverse(upper(seq)), 'ATUGC', 'TAACG')), '-.', ''), 3, 48) AS seq", ("gapped",), V.gapped, reverse_complement=True, lower=True, remove_gaps=True, slice_range="3:50")


@_query(V.sql("SELECT ord, translate(seq, '-.', '') AS seq, replace(translate(seq, 'ACGTNacgtn-.', 'I?5+#H>4*\"!!'), '!', '') AS qual FROM gapped", "gapped"))
def modify_gap_quality(spark, sf_dir):
    return transform.modify_records(V.with_quals(V.gapped(spark, sf_dir)), remove_gaps=True).select("ord", "seq", "qual")


@_query(V.sql("SELECT ord, id, repeat('I', length(seq)) AS qual FROM reads", "reads"))
def convert_fa_to_fq(spark, sf_dir):
    return transform.convert_records(V.reads(spark, sf_dir), "fastq", 40).select("ord", "id", "qual")


@_query(V.sql("SELECT ord, id, seq, CAST(NULL AS VARCHAR) AS qual FROM quals", "reads", "quals"))
def convert_fq_to_fa(spark, sf_dir):
    return transform.convert_records(V.with_quals(V.reads(spark, sf_dir)), "fasta").select("ord", "id", "seq", "qual")


@_query(V.sql("""SELECT ord, '>' || id || ' ' || "desc" || CASE WHEN seq = '' THEN '' ELSE chr(10) || rtrim(regexp_replace(seq, '(.{60})', '\\1' || chr(10), 'g'), chr(10)) END AS value FROM reads""", "reads"))
def fasta_render(spark, sf_dir):
    return transform.rendered(V.reads(spark, sf_dir)).select("ord", "value")


@_query(V.sql("""SELECT ord, '@' || id || ' ' || "desc" || chr(10) || seq || chr(10) || '+' || chr(10) || qual AS value FROM quals""", "reads", "quals"))
def fastq_render(spark, sf_dir):
    return transform.rendered(V.with_quals(V.reads(spark, sf_dir)), "fastq").select("ord", "value")


# ---- extract ---------------------------------------------------------------------------------------------------------


def _cut(start: str, end: str, flank: int = 0, name: str = "NULL") -> str:
    return f"""SELECT ord, id || '_' || coalesce({name}, (s1 + 1) || ':' || e1) AS id, 'extracted region ' || (s1 + 1) || '-' || e1 AS "desc", substr(seq, s1 + 1, e1 - s1) AS seq
        FROM (SELECT *, greatest({start} - {flank}, 0) AS s1, least({end} + {flank}, length(seq)) AS e1 FROM x) WHERE s1 < e1 AND s1 < length(seq)"""


@_query(V.sql(f"SELECT {_BRIEF} FROM reads WHERE id IN (SELECT id FROM id_list)", "id_list", "reads"))
def extract_ids(spark, sf_dir):
    return _brief(extraction.extract_records(V.reads(spark, sf_dir), ids=V.id_list(spark, sf_dir)))


@_query(V.sql(f", x AS (SELECT * FROM reads) {_cut('20', '80')}".lstrip(), "reads").replace(") ,", "),", 1))
def extract_range(spark, sf_dir):
    return extraction.extract_records(V.reads(spark, sf_dir), range_="21:80").select("ord", "id", "desc", "seq")


@_query(V.sql(f", x AS (SELECT * FROM reads WHERE id IN (SELECT id FROM id_list)) {_cut('20', '80', 5)}", "id_list", "reads").replace(") ,", "),"))
def extract_ids_range(spark, sf_dir):
    return extraction.extract_records(V.reads(spark, sf_dir), ids=V.id_list(spark, sf_dir), range_="21:80", flank=5).select("ord", "id", "desc", "seq")


@_query(V.sql(f", x AS (SELECT reads.*, s, e, name FROM reads JOIN regions ON id = seq_id) {_cut('s', 'e', 0, 'name')}", "regions", "reads").replace(") ,", "),"))
def extract_bed(spark, sf_dir):
    return extraction.extract_records(V.reads(spark, sf_dir), bed=V.regions(spark, sf_dir)).select("ord", "id", "desc", "seq")


@_query(V.sql(f", x AS (SELECT reads.*, s, e, name FROM reads JOIN regions ON id = seq_id) {_cut('s', 'e', 20, 'name')}", "regions", "reads").replace(") ,", "),"))
def extract_bed_flank(spark, sf_dir):
    return extraction.extract_records(V.reads(spark, sf_dir), bed=V.regions(spark, sf_dir), ids=["d1"], range_="1:2", flank=20).select("ord", "id", "desc", "seq")


# ---- search ----------------------------------------------------------------------------------------------------------


def _hits(pattern: str, mismatches: int = 0, view: str = "reads") -> str:
    """Hits of a nucleotide pattern and its reverse complement as SQL."""
    k, rc = len(pattern), search.reverse_complement(pattern)

    def one(p: str, strand: str) -> str:
        wrong = " + ".join(f"CAST(substr(u, i + {j + 1}, 1) <> '{c}' AS INTEGER)" for j, c in enumerate(p))
        fits = f"substr(u, i + 1, {k}) = '{p}'" if not mismatches else f"({wrong}) <= {mismatches}"
        nuc = f" AND {_NUC}" if strand == "-" else ""
        return f"SELECT ord, id, i AS \"start\", i + {k} AS \"end\", substr(seq, i + 1, {k}) AS matched, '{strand}' AS strand FROM p WHERE {fits}{nuc}"

    return f", p AS (SELECT *, upper(seq) AS u, unnest(generate_series(0, length(seq) - {k})) AS i FROM {view} WHERE length(seq) >= {k}), hits AS ({one(pattern, '+')} UNION ALL {one(rc, '-')})"


def _hit_sql(body: str, pattern: str, mismatches: int = 0) -> str:
    return V.sql(f"{_hits(pattern, mismatches)} {body}", "reads").replace(") ,", "),", 1)


_HIT = ["ord", "id", "start", "end", "matched", "strand"]


@_query(_hit_sql('SELECT r.ord, count(h.ord) FILTER (strand = \'+\') AS forward, count(h.ord) FILTER (strand = \'-\') AS "reverse" FROM reads r LEFT JOIN hits h ON h.ord = r.ord GROUP BY r.ord', "ATTA"))
def search_exact_counts(spark, sf_dir):
    return search.count_hits(V.reads(spark, sf_dir), "atta").select("ord", "forward", "reverse")


@_query(_hit_sql("SELECT * FROM hits WHERE strand = '+'", "ATTA"))
def search_exact_hits(spark, sf_dir):
    return search.find_hits(V.reads(spark, sf_dir), "ATTA").where("strand = '+'").select(*_HIT)


@_query(_hit_sql("SELECT * FROM hits", "AATT"))
def search_both_strands(spark, sf_dir):
    return search.find_hits(V.reads(spark, sf_dir), "aatt").select(*_HIT)


@_query(_hit_sql("SELECT * FROM hits", "ACNTAGA", 1))
def search_mismatch(spark, sf_dir):
    return search.find_hits(V.reads(spark, sf_dir), "ACNTAGA", mismatches=1).select(*_HIT)


@_query(V.sql(
    """, m AS (SELECT ord, id, unnest(generate_series(1, len(ms))) AS k, ms, pieces FROM (SELECT ord, id, regexp_extract_all(upper(seq), 'AT+A[CG]') AS ms, regexp_split_to_array(upper(seq), 'AT+A[CG]') AS pieces FROM reads) WHERE len(ms) > 0)
    SELECT ord, id, CAST(list_sum(list_transform(pieces[1:k], lambda s: length(s))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda s: length(s))), 0) AS BIGINT) AS "start",
    CAST(list_sum(list_transform(pieces[1:k], lambda s: length(s))) + list_sum(list_transform(ms[1:k], lambda s: length(s))) AS BIGINT) AS "end", ms[k] AS matched, '+' AS strand FROM m""", "reads").replace(") ,", "),", 1))
def search_regex(spark, sf_dir):
    return search.find_hits(V.reads(spark, sf_dir), "AT+A[CG]", regex=True).select(*_HIT)


@_query(_hit_sql("SELECT ord, id || ':' || (\"start\" + 1) || '-' || \"end\" || chr(9) || matched || chr(9) || strand AS value FROM hits", "GATTA"))
def search_lines(spark, sf_dir):
    return search.hit_lines(search.find_hits(V.reads(spark, sf_dir), "GATTA")).select("ord", "value")


@_query(_hit_sql("SELECT ord, id || chr(9) || \"start\" || chr(9) || \"end\" || chr(9) || matched AS value FROM hits", "GATTA"))
def search_bed4(spark, sf_dir):
    return search.hit_lines(search.find_hits(V.reads(spark, sf_dir), "GATTA"), bed=True).select("ord", "value")


@_query(_hit_sql("SELECT ord, id || chr(9) || \"start\" || chr(9) || \"end\" || chr(9) || matched || chr(9) || '0' || chr(9) || strand AS value FROM hits", "GATTA"))
def search_bed6(spark, sf_dir):
    return search.hit_lines(search.find_hits(V.reads(spark, sf_dir), "GATTA"), bed=True, strand=True).select("ord", "value")


# ---- sort, dedup, sample ---------------------------------------------------------------------------------------------


def _sort(name: str, by: str, key: str, descending: bool, source=V.reads, view: str = "reads") -> None:
    def run(spark, sf_dir):
        return ordering.ranked_records(source(spark, sf_dir), by, descending).select("rank", "ord", "id")

    run.__name__ = name
    _query(V.sql(f"SELECT row_number() OVER (ORDER BY {key} {'DESC' if descending else ''}, ord) AS rank, ord, id FROM {view}", view))(run)


_sort("sort_name", "name", "id", False)
_sort("sort_len_desc", "len", "length(seq)", True)
_sort("sort_gc", "gc", _GC, False)
_sort("sort_ties", "name", "id", True, V.grouped_reads, "grouped_reads")


def _dedup(name: str, key: str, view: str = "reads", source=V.reads, **options) -> None:
    def run(spark, sf_dir):
        return _brief(ordering.dedup_records(source(spark, sf_dir), **options))

    run.__name__ = name
    _query(V.sql(f"SELECT {_BRIEF} FROM {view} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY ord) = 1", view))(run)


_dedup("dedup_seq", "seq")
_dedup("dedup_seq_nocase", "upper(seq)", ignore_case=True)
_dedup("dedup_id", "id", "grouped_reads", V.grouped_reads, by_id=True)
_dedup("dedup_prefix", "substr(seq, 1, 4)", prefix=4)
_dedup("dedup_prefix_nocase", "upper(substr(seq, 1, 4))", prefix=4, ignore_case=True)


@_query(V.sql("SELECT count(*) AS total, count(DISTINCT seq) AS kept, count(*) - count(DISTINCT seq) AS removed FROM reads", "reads"))
def dedup_counts(spark, sf_dir):
    return ordering.duplicate_counts(V.reads(spark, sf_dir))


@_query(V.sql("SELECT ord, id FROM reads ORDER BY md5('42:0:' || ord), ord LIMIT 100", "reads"))
def sample_count(spark, sf_dir):
    return ordering.sample_count(V.reads(spark, sf_dir), 100).select("ord", "id")


@_query(V.sql("SELECT ord, id FROM reads WHERE CAST(('0x' || substr(md5('7:0:' || ord), 1, 8)) AS BIGINT) / 4294967296.0 < 0.1", "reads"))
def sample_fraction(spark, sf_dir):
    return ordering.sample_fraction(V.reads(spark, sf_dir), 0.1, 7).select("ord", "id")


# ---- merge and split -------------------------------------------------------------------------------------------------


@_query(V.sql("SELECT 0 AS file_ord, ord, id, \"desc\", md5(seq) AS seq_md5 FROM reads UNION ALL SELECT 1, ord, id, \"desc\", md5(seq) FROM page_reads", "reads", "page_reads"))
def merge_union(spark, sf_dir):
    return ordering.merge_records([V.reads(spark, sf_dir), V.page_reads(spark, sf_dir)]).select("file_ord", "ord", "id", "desc", F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


@_query(V.sql("SELECT 0 AS file_ord, ord, 'docs:' || id AS id, CAST(NULL AS VARCHAR) AS \"desc\" FROM reads UNION ALL SELECT 1, ord, 'web:' || id, NULL FROM page_reads", "reads", "page_reads"))
def merge_prefix(spark, sf_dir):
    return ordering.merge_records([V.reads(spark, sf_dir), V.page_reads(spark, sf_dir)], ["docs", "web"]).select("file_ord", "ord", "id", "desc")


@_query(V.sql("SELECT ord, id, CAST(floor((row_number() OVER (ORDER BY ord) - 1) / ceil((SELECT count(*) FROM reads) / 7.0)) AS INTEGER) + 1 AS part FROM reads", "reads"))
def split_parts(spark, sf_dir):
    return ordering.split_parts(V.reads(spark, sf_dir), 7).select("ord", "id", "part")


@_query(V.sql("SELECT ord, id, CAST((row_number() OVER (ORDER BY ord) - 1) // 128 AS INTEGER) + 1 AS part FROM reads", "reads"))
def split_chunk(spark, sf_dir):
    return ordering.split_chunks(V.reads(spark, sf_dir), 128).select("ord", "id", "part")


@_query(V.sql("SELECT ord, regexp_replace(id, '[^a-zA-Z0-9_-]', '_', 'g') || CASE WHEN n = 1 THEN '' ELSE '_' || n END AS part FROM (SELECT ord, id, row_number() OVER (PARTITION BY id ORDER BY ord) AS n FROM grouped_reads)", "grouped_reads"))
def split_by_id_names(spark, sf_dir):
    return ordering.split_by_id(V.grouped_reads(spark, sf_dir)).select("ord", "part")


@_query("""SELECT * FROM (VALUES
    ('stats', 4, 1), ('convert', 6, 1), ('filter', 8, 2), ('extract', 6, 1), ('search', 7, 1), ('modify', 6, 1),
    ('sample', 5, 1), ('sort', 4, 1), ('dedup', 5, 1), ('merge', 4, 1), ('split', 5, 1), ('compress', 7, 1)
    ) AS t(command, parameters, examples)""")
def guide_catalog(spark, sf_dir):
    return guide.catalog(spark).select("command", F.size("parameters").alias("parameters"), F.size("examples").alias("examples"))


@_query(V.sql("SELECT count(*) AS total, least(count(*), 100) AS sampled FROM reads", "reads"))
def sample_counts(spark, sf_dir):
    return ordering.sample_counts(V.reads(spark, sf_dir), count=100)


@_query(V.sql("SELECT 0 AS file_ord, count(*) AS records FROM reads UNION ALL SELECT 1, count(*) FROM page_reads", "reads", "page_reads"))
def merge_counts(spark, sf_dir):
    return ordering.merge_counts([V.reads(spark, sf_dir), V.page_reads(spark, sf_dir)])


# ---- files: written to the shared folder by the tasks, and read back -------------------------------------------------


def _file_query(name: str, fmt: str, body: str, views: tuple[str, ...], source, **options) -> None:
    """What a scan finds in a folder of files that a sink has written."""

    def run(spark, sf_dir):
        path = folder(spark, name)
        writers.write_sequences(source(spark, sf_dir), path, fmt, ordered=False, **options)
        out = readers.read_sequences(spark, path, fmt)
        return out.select("id", "desc", F.md5(F.col("seq").cast("binary")).alias("seq_md5"), S.seq_length("seq").alias("n"), F.md5(F.col("qual").cast("binary")).alias("qual_md5"))

    run.__name__ = name
    _query(V.sql(body, *views))(run)


_file_query("scan_fasta", "fasta", f'SELECT id, "desc", md5(seq) AS seq_md5{_SIZE}, CAST(NULL AS VARCHAR) AS qual_md5 FROM reads', ("reads",), V.reads)
_file_query("scan_fastq", "fastq", f'SELECT id, "desc", md5(seq) AS seq_md5{_SIZE}, md5(qual) AS qual_md5 FROM quals WHERE seq <> \'\'', ("reads", "quals"), lambda s, d: _quals(s, d).where("seq <> ''"))
_file_query("scan_fasta_gzip", "fasta", f'SELECT id, "desc", md5(seq) AS seq_md5{_SIZE}, CAST(NULL AS VARCHAR) AS qual_md5 FROM proteins', ("proteins",), V.proteins, width=100, compression="gzip")
_file_query("scan_fastq_gzip", "fastq", f'SELECT id, "desc", md5(seq) AS seq_md5{_SIZE}, md5(repeat(\'I\', length(seq))) AS qual_md5 FROM reads WHERE seq <> \'\'', ("reads",), lambda s, d: V.reads(s, d).where("seq <> ''"), compression="gzip")


@_query(V.sql('SELECT seq_id, s AS "start", e AS "end", name FROM regions', "regions"))
def scan_bed(spark, sf_dir):
    path = folder(spark, "bed")
    lines = V.regions(spark, sf_dir).select(F.concat_ws("\t", "seq_id", "start", "end", "name").alias("value"))
    lines.write.text(path)
    return readers.read_bed(spark, path).select("seq_id", "start", "end", "name")


@_query(V.sql("SELECT id FROM id_list", "id_list"))
def scan_ids(spark, sf_dir):
    path = folder(spark, "ids")
    V.id_list(spark, sf_dir).select(F.concat(F.lit("  "), "id", F.lit(" ")).alias("value")).write.text(path)
    return readers.read_ids(spark, path)


@_query(V.sql(f"SELECT {_BRIEF} FROM reads WHERE id IN (SELECT id FROM id_list)", "id_list", "reads"))
def filter_id_file(spark, sf_dir):
    path = folder(spark, "ids")
    V.id_list(spark, sf_dir).write.text(path)
    return _brief(selection.filter_records(V.reads(spark, sf_dir), ids=readers.read_ids(spark, path)))


@_query(V.sql("SELECT 1 AS file_ord, id FROM reads UNION ALL SELECT 0, id FROM page_reads", "reads", "page_reads"))
def scan_files(spark, sf_dir):
    paths = []
    for df in (V.page_reads(spark, sf_dir), V.reads(spark, sf_dir)):
        paths.append(folder(spark, "file"))
        writers.write_sequences(df.select("file_ord", "ord", "id", F.lit(None).cast("string").alias("desc"), "seq", "qual").coalesce(1), paths[-1], ordered=False)
    return readers.read_sequences(spark, paths, "fasta").select("file_ord", "id")


@_query("""SELECT * FROM (VALUES ('a.fa', 'fasta'), ('b.FQ', 'fastq'), ('c.fastq.gz', 'fastq'), ('d.fasta.gz', 'fasta'), ('e.txt', 'fasta')) AS t(name, format)""")
def detect_formats(spark, sf_dir):
    return spark.createDataFrame([(n, detect_format(n)) for n in ("a.fa", "b.FQ", "c.fastq.gz", "d.fasta.gz", "e.txt")], "name string, format string")


# ---- guards, order and reports ---------------------------------------------------------------------------------------


def _guard(name: str, run_guarded) -> None:
    """The id that a guard's error names: that of the first record that is no nucleotide sequence."""

    def run(spark, sf_dir):
        df = V.proteins(spark, sf_dir)
        try:
            run_guarded(df)
        except selection.NotNucleotide as e:
            found = selection.first_non_nucleotide(df).select("ord", "id")
            return found.withColumn("named", F.lit(str(e)).contains(F.concat(F.lit("'"), "id", F.lit("'"))))
        raise AssertionError("a guard let records pass that are no nucleotides")

    run.__name__ = name
    _query(V.sql(f"SELECT ord, id, true AS named FROM proteins WHERE NOT {_NUC} ORDER BY ord LIMIT 1", "proteins"))(run)


_guard("guard_gc", lambda df: selection.filter_records(df, gc_min=10.0))
_guard("guard_revcomp", lambda df: transform.modify_records(df, reverse_complement=True))
_filter("filter_gc_checked", f"seq <> '' AND {_GC} >= 45.0", source=lambda s, d: V.reads(s, d).where("seq <> ''"), gc_min=45.0)


@_query(_hit_sql("SELECT row_number() OVER (ORDER BY ord, strand, \"start\") AS place, * FROM hits", "GATTA"))
def search_ordered(spark, sf_dir):
    hits = search.find_hits(V.reads(spark, sf_dir), "GATTA")
    return numbered(hits, ["file_ord", "ord", "strand", "start"], "place").select("place", *_HIT)


@_query(_hit_sql("SELECT * FROM hits", "AATTAA"))
def search_short(spark, sf_dir):
    """Most of these records are shorter than the pattern."""
    return search.find_hits(V.reads(spark, sf_dir), "AATTAA").select(*_HIT)


@_query(V.sql(f"SELECT row_number() OVER (ORDER BY ord) AS place, {_BRIEF} FROM (SELECT * FROM reads QUALIFY row_number() OVER (PARTITION BY seq ORDER BY ord) = 1)", "reads"))
def dedup_ordered(spark, sf_dir):
    kept = numbered(ordering.dedup_records(V.reads(spark, sf_dir)), ["file_ord", "ord"], "place")
    return _brief(kept, "place")


@_query(V.sql("SELECT ord, id FROM reads WHERE false", "reads"))
def sort_empty(spark, sf_dir):
    return ordering.sort_records(V.reads(spark, sf_dir).where("false"), "gc").select("ord", "id")


@_query(V.sql(
    """SELECT 'Sequences: ' || count(*) || chr(10) || 'Total length: ' || sum(length(seq)) || chr(10) || 'Min length: ' || min(length(seq)) || chr(10) || 'Max length: ' || max(length(seq)) || chr(10)
    || 'Mean length: ' || format('{:.2f}', CAST(sum(length(seq)) AS DOUBLE) / count(*)) AS report FROM reads""", "reads"))
def stats_report(spark, sf_dir):
    return spark.createDataFrame([(aggregation.report(V.reads(spark, sf_dir)),)], "report string")


@_query(V.sql("""SELECT 'No nucleotide sequences: base composition does not apply.' AS last_line FROM proteins WHERE NOT regexp_full_match(seq, '[ACGTUNacgtun.-]+') HAVING count(*) > 0""", "proteins"))
def stats_report_proteins(spark, sf_dir):
    letters = V.proteins(spark, sf_dir).where(~S.is_nucleotide("seq"))
    return spark.createDataFrame([(aggregation.report(letters, gc=True).rpartition("\n")[2],)], "last_line string")


@_query("""SELECT * FROM (VALUES ('1:100', 0, 100), ('7:7', 6, 7), (' 3:9 ', 2, 9), ('0:10', NULL, NULL), ('10:1', NULL, NULL), ('5', NULL, NULL)) AS t(text, first, last)""")
def parse_ranges(spark, sf_dir):
    def bounds(text: str) -> tuple:
        try:
            return text, *S.parse_range(text)
        except ValueError:
            return text, None, None

    return spark.createDataFrame([bounds(x) for x in ("1:100", "7:7", " 3:9 ", "0:10", "10:1", "5")], "text string, first int, last int")


@_query("""SELECT * FROM (VALUES ('data/a.b.fa', 'a.b'), ('x.fq', 'x'), ('/p/q', 'q'), ('.hid', '.hid')) AS t(path, stem)""")
def file_stems(spark, sf_dir):
    df = spark.createDataFrame([("data/a.b.fa",), ("x.fq",), ("/p/q",), (".hid",)], "path string")
    return df.select("path", S.file_stem("path").alias("stem"))


@_query(V.sql("SELECT 0 AS file_ord, ord, id FROM reads UNION ALL SELECT 1, ord, id FROM page_reads", "reads", "page_reads"))
def merge_prefix_fastq(spark, sf_dir):
    """FASTQ ids stay as they are."""
    return ordering.merge_records([V.reads(spark, sf_dir), V.page_reads(spark, sf_dir)], ["docs", "web"], to="fastq").select("file_ord", "ord", "id")


@_query(V.sql("SELECT part, count(*) AS files_records, min(ord) AS first, max(ord) AS last FROM (SELECT ord, CAST((row_number() OVER (ORDER BY ord) - 1) // 128 AS INTEGER) + 1 AS part FROM reads) GROUP BY part", "reads"))
def split_files(spark, sf_dir):
    """A folder for each part; what a scan of each finds, by part."""
    path = folder(spark, "split")
    parts = ordering.split_chunks(V.reads(spark, sf_dir), 128)
    writers.write_parts(parts, path)
    lines = spark.read.text(path).where(F.col("value").startswith(">"))
    number = F.regexp_extract("value", r"^>d(\d+)", 1).cast("long")
    return lines.groupBy(F.col("part").cast("int").alias("part")).agg(F.count("*").alias("files_records"), F.min(number).alias("first"), F.max(number).alias("last"))


@_query("SELECT 'Hello, World!' || chr(10) AS text, true AS overwrite_refused")
def compress_roundtrip(spark, sf_dir):
    """gzip of a file of this machine and back; an existing output is refused."""
    with tempfile.TemporaryDirectory() as place:
        source = Path(place, "x.txt")
        source.write_text("Hello, World!\n")
        packed = codec.compress(str(source))
        try:
            codec.compress(str(source))
            refused = False
        except FileExistsError:
            refused = True
        text = Path(codec.decompress(packed, f"{place}/y.txt")).read_text()
    return spark.createDataFrame([(text, refused)], "text string, overwrite_refused boolean")


@_query("SELECT name, CAST(records AS BIGINT) AS records FROM (VALUES ('random', 500)) AS t(name, records)")
def random_fasta(spark, sf_dir):
    path = folder(spark, "random")
    generator.write_random_fasta(spark, path, 500, seed=7)
    return readers.read_fasta(spark, path).where(S.is_nucleotide("seq") & (S.seq_length("seq") >= 500)).agg(F.count("*").alias("records")).select(F.lit("random").alias("name"), "records")

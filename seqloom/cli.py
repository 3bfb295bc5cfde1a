"""The command line: python -m seqloom COMMAND ..."""

from __future__ import annotations

import argparse
import shutil
import sys
import tempfile

from pyspark.sql import DataFrame, SparkSession

from seqloom import guide
from seqloom.operators import aggregation, extraction, ordering, search, selection, transform
from seqloom.functions import sequence as S
from seqloom.sources import codec, readers, writers
from seqloom.sources.formats import detect_format
from seqloom.storage import clean


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seqloom", description="Biological sequence analytics on Spark")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, output: bool = True, inputs: bool = True) -> argparse.ArgumentParser:
        about = next((c.about for c in guide.COMMANDS if c.name == name), "What the commands do and take")
        p = commands.add_parser(name, help=about, description=about)
        if inputs:
            p.add_argument("-i", "--input", default=None, help="file; standard input without it")
            p.add_argument("-f", "--format", default=None)
        if output:
            p.add_argument("-o", "--output", default=None, help="file; a folder of files if it ends in /; standard output without it")
            p.add_argument("--gzip", action="store_true", help="a folder's files are packed")
            p.add_argument("-w", "--width", type=int, default=60)
        return p

    p = add("guide", False, False)
    p.add_argument("topic", nargs="?")
    p.add_argument("--form", choices=("text", "json", "markdown"), default="text")

    p = add("stats", False)
    for x in ("--gc", "--qual"):
        p.add_argument(x, action="store_true")
    for x in ("--min-len", "--max-len"):
        p.add_argument(x, type=int)

    p = add("convert")
    p.add_argument("-F", "--from", dest="from_")
    p.add_argument("-T", "--to", default="fasta")
    p.add_argument("-Q", "--qual", type=int, default=30)

    p = add("filter")
    for x, kind in (("--min-len", int), ("--max-len", int), ("--gc-min", float), ("--gc-max", float), ("--pattern", str), ("--exclude-pattern", str), ("--min-qual", float), ("--id-file", str)):
        p.add_argument(x, type=kind)
    p.add_argument("--id", action="append", default=[])
    p.add_argument("-v", "--invert", action="store_true")

    p = add("extract")
    p.add_argument("--id", action="append", default=[])
    p.add_argument("--id-file")
    p.add_argument("-r", "--range", dest="range_")
    p.add_argument("-b", "--bed")
    p.add_argument("-F", "--flanking", type=int, default=0)
    p.add_argument("--stream", action="store_true", help="accepted; every run streams")

    p = add("search")
    p.add_argument("pattern")
    p.add_argument("-r", "--regex", action="store_true")
    p.add_argument("-m", "--mismatches", type=int, default=0)
    p.add_argument("--bed", action="store_true")
    p.add_argument("--strand", action="store_true")
    p.add_argument("-t", "--threads", type=int, default=1)

    p = add("modify")
    p.add_argument("-r", "--reverse-complement", action="store_true")
    for x in ("--upper", "--lower"):
        p.add_argument(x, action="store_true")
    p.add_argument("-g", "--remove-gaps", action="store_true")
    p.add_argument("-s", "--slice", dest="slice_")

    p = add("sample")
    g = p.add_mutually_exclusive_group(required=True)
    g.add_argument("-n", "--count", type=int)
    g.add_argument("-F", "--fraction", type=float)
    p.add_argument("--seed", type=int, default=42)

    p = add("sort")
    g = p.add_mutually_exclusive_group()
    for x in ("name", "len", "gc"):
        g.add_argument(f"--by-{x}", dest="by", action="store_const", const=x)
    p.set_defaults(by="name")
    p.add_argument("-d", "--desc", action="store_true")
    p.add_argument("--max-memory", type=int, help="accepted; Spark sorts in its own memory and spills")
    p.add_argument("-t", "--threads", type=int, default=1)

    p = add("dedup")
    g = p.add_mutually_exclusive_group()
    g.add_argument("--by-id", action="store_true")
    g.add_argument("--prefix", type=int)
    p.add_argument("-I", "--ignore-case", action="store_true")
    p.add_argument("--buckets", type=int, help="accepted; Spark partitions by its own settings")
    p.add_argument("-t", "--threads", type=int, default=1)

    p = add("merge", inputs=False)
    p.add_argument("inputs", nargs="+")
    p.add_argument("-f", "--format", default=None)
    p.add_argument("-a", "--add-prefix", action="store_true")
    p.add_argument("--sep", default=":")

    p = add("split", False)
    g = p.add_mutually_exclusive_group(required=True)
    g.add_argument("-n", "--parts", type=int)
    g.add_argument("-c", "--chunk-size", type=int)
    g.add_argument("--by-id", action="store_true")
    p.add_argument("--outdir", default=".")
    p.add_argument("--prefix", default="split")
    p.add_argument("-w", "--width", type=int, default=60)

    p = add("compress", False, False)
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output")
    p.add_argument("-d", "--decompress", action="store_true")
    p.add_argument("-l", "--level", type=int, default=6)
    p.add_argument("--delete", action="store_true")
    p.add_argument("-f", "--force", action="store_true")
    p.add_argument("-t", "--threads", type=int, default=1, help="accepted; one file is packed by one thread")
    return top


def _say(text: str) -> None:
    print(text, file=sys.stderr)


def _run(a: argparse.Namespace, spark: SparkSession) -> None:
    if a.command == "merge":
        _command(a, spark, a.inputs)
    elif a.input:
        _command(a, spark, [a.input])
    else:
        with tempfile.TemporaryDirectory() as folder:  # standard input, while the command runs
            path = f"{folder}/stdin.{'fq' if detect_format(None, a.format) == 'fastq' else 'fa'}"
            with open(path, "wb") as f:
                shutil.copyfileobj(sys.stdin.buffer, f)
            _command(a, spark, [path])


def _command(a: argparse.Namespace, spark: SparkSession, paths: list[str]) -> None:
    fmt = detect_format(paths[0], getattr(a, "from_", None) or a.format)
    df = readers.read_sequences(spark, paths, fmt)

    def ids() -> DataFrame | None:
        return readers.read_ids(spark, a.id_file, a.id) if a.id or a.id_file else None

    def put(out: DataFrame, to: str = fmt, ordered: bool = False) -> None:
        if a.output and a.output.endswith("/"):  # a folder: written by the tasks
            writers.write_sequences(out, a.output, to, a.width, "gzip" if a.gzip else "none", not ordered)
        else:
            _say(f"{writers.write_file(out, a.output, to, a.width, ordered)} records written")

    match a.command:
        case "stats":
            print(aggregation.report(df, a.gc, a.qual, a.min_len, a.max_len))
        case "convert":
            put(transform.convert_records(df, a.to, a.qual), a.to)
        case "filter":
            put(selection.filter_records(df, a.min_len, a.max_len, a.gc_min, a.gc_max, a.pattern, a.exclude_pattern, ids(), a.min_qual, a.invert))
            _say(f"of {df.count()} records read")
        case "extract":
            if fmt == "fastq":
                raise ValueError("extract reads FASTA")
            bed = readers.read_bed(spark, a.bed) if a.bed else None
            out = extraction.extract_records(df, ids(), a.range_, bed, a.flanking)
            order = ("file_ord", "ord", *(("bed_ord",) if "bed_ord" in out.columns else ()))
            rows = out.select(*order, S.fasta_text("id", "desc", "seq", a.width).alias("value"))
            _say(f"{writers.write_lines(rows, a.output, order)} records written")
        case "search":
            hits = search.find_hits(df, a.pattern, a.mismatches, a.regex)
            lines = search.hit_lines(hits, a.bed, a.strand)
            _say(f"{writers.write_lines(lines, a.output, ('file_ord', 'ord', 'strand', 'start'))} hits")
        case "modify":
            put(transform.modify_records(df, a.reverse_complement, a.upper, a.lower, a.remove_gaps, a.slice_))
        case "sample":
            put(ordering.sample_count(df, a.count, a.seed) if a.count is not None else ordering.sample_fraction(df, a.fraction, a.seed))
            _say(f"of {df.count()} records read")
        case "sort":
            put(ordering.sort_records(df, a.by, a.desc), ordered=True)
        case "dedup":
            put(ordering.dedup_records(df, a.by_id, a.prefix, a.ignore_case))
        case "merge":
            prefixes = [p.rpartition("/")[2].rpartition(".")[0] or p for p in paths] if a.add_prefix else None
            if prefixes and fmt != "fastq":
                stems = dict(enumerate(prefixes))
                parts = [df.where(df.file_ord == i) for i in stems]
                df = ordering.merge_records(parts, prefixes, a.sep, fmt)
            put(df)
        case "split":
            parts = ordering.split_parts(df, a.parts) if a.parts is not None else ordering.split_chunks(df, a.chunk_size) if a.chunk_size is not None else ordering.split_by_id(df)
            _say(f"{len(writers.write_split(parts, a.outdir, a.prefix, fmt, a.width))} files written")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs a command; errors go to standard error and give 1."""
    a = _parser().parse_args(argv)
    try:
        if a.command == "guide":
            print(guide.render(a.topic, a.form))
        elif a.command == "compress":
            _say(codec.decompress(a.input, a.output, a.delete, a.force) if a.decompress else codec.compress(a.input, a.output, a.level, a.delete, a.force))
        else:
            if getattr(a, "threads", 1) < 1:
                raise ValueError("threads are 1 or more")
            spark = spark or SparkSession.builder.appName("seqloom").master(f"local[{getattr(a, 'threads', 0) if getattr(a, 'threads', 1) > 1 else '*'}]").config("spark.ui.enabled", "false").getOrCreate()
            try:
                _run(a, spark)
            finally:
                clean(spark)
    except (ValueError, OSError) as e:
        _say(f"seqloom: {e}")
        return 1
    return 0

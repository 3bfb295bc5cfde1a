"""The commands and what they take, as a table, text, JSON and Markdown."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Command(NamedTuple):
    name: str
    about: str
    parameters: tuple[tuple[str, str], ...]
    examples: tuple[str, ...]


_INPUT = ("-i, --input", "files to read; the format follows the name unless -f gives it")
_OUTPUT = ("-o, --output", "file to write; standard output without it")
COMMANDS = (
    Command("stats", "Counts, lengths, base composition and qualities", (_INPUT, ("--gc", "base composition"), ("--qual", "qualities"), ("--min-len, --max-len", "bounds of the lengths that count")), ("seqloom stats -i reads.fa --gc",)),
    Command("convert", "FASTA to FASTQ and back", (_INPUT, _OUTPUT, ("-F, --from", "format read"), ("-T, --to", "format written, fasta by default"), ("-Q, --qual", "Phred value for missing qualities, 30 by default"), ("-w, --width", "bases in a line")), ("seqloom convert -i reads.fa -T fastq -o reads.fq",)),
    Command("filter", "Records that meet all conditions", (_INPUT, _OUTPUT, ("--min-len, --max-len", "length"), ("--gc-min, --gc-max", "GC percentage"), ("--pattern, --exclude-pattern", "regular expressions"), ("--id, --id-file", "ids"), ("--min-qual", "mean Phred quality"), ("-v, --invert", "the records that don't meet them")), ("seqloom filter -i reads.fa --min-len 100", "seqloom filter -i reads.fa --id-file ids.txt -v")),
    Command("extract", "Records by id, ranges of them, or BED regions", (_INPUT, _OUTPUT, ("--id, --id-file", "ids"), ("-r, --range", "start:end, from 1"), ("-b, --bed", "regions"), ("-F, --flanking", "bases added on both sides")), ("seqloom extract -i genome.fa --bed genes.bed --flanking 100",)),
    Command("search", "Motifs: exact, approximate or regular expressions", (_INPUT, _OUTPUT, ("pattern", "what to look for"), ("-r, --regex", "it is a regular expression"), ("-m, --mismatches", "letters that may differ"), ("--bed", "BED lines"), ("--strand", "BED lines with the strand")), ("seqloom search GAATTC -i genome.fa --bed",)),
    Command("modify", "Reverse complement, case, gaps and slices", (_INPUT, _OUTPUT, ("-r, --reverse-complement", "the other strand"), ("--upper, --lower", "case"), ("-g, --remove-gaps", "without - and ."), ("-s, --slice", "start:end, from 1")), ("seqloom modify -i reads.fa -r --upper",)),
    Command("sample", "A number or a share of the records", (_INPUT, _OUTPUT, ("-n, --count", "how many"), ("-F, --fraction", "what share"), ("--seed", "42 by default")), ("seqloom sample -i reads.fa -n 1000 --seed 7",)),
    Command("sort", "By name, length or GC", (_INPUT, _OUTPUT, ("--by-name, --by-len, --by-gc", "key, the name by default"), ("-d, --desc", "descending")), ("seqloom sort -i reads.fa --by-len -d",)),
    Command("dedup", "The first record of each key", (_INPUT, _OUTPUT, ("--by-id", "the id is the key"), ("--prefix", "so many letters are the key"), ("-I, --ignore-case", "case doesn't count")), ("seqloom dedup -i reads.fa --prefix 50",)),
    Command("merge", "Files one after the other", (("inputs", "files"), _OUTPUT, ("-a, --add-prefix", "file names before the ids"), ("--sep", "what stands between, : by default")), ("seqloom merge a.fa b.fa -o all.fa",)),
    Command("split", "Parts, chunks or a file for each record", (_INPUT, ("-n, --parts", "how many parts"), ("-c, --chunk-size", "records in a chunk"), ("--by-id", "a file for each record"), ("--outdir, --prefix", "where, and how file names start")), ("seqloom split -i reads.fa -n 8 --outdir parts",)),
    Command("compress", "gzip files and back", (_INPUT, _OUTPUT, ("-d, --decompress", "unpack"), ("-l, --level", "1 to 9"), ("--delete", "the input goes afterwards"), ("-f, --force", "an existing output is replaced"), ("-t, --threads", "accepted")), ("seqloom compress -i reads.fa",)),
)


def catalog(spark: SparkSession) -> DataFrame:
    """A row for each command."""
    rows = [(c.name, c.about, described(c), [tuple(p) for p in c.parameters], list(c.examples)) for c in COMMANDS]
    return spark.createDataFrame(rows, "command string, about string, description string, parameters array<struct<param:string,description:string>>, examples array<string>")


def described(c: Command) -> str:
    """What a command does and takes, in a sentence."""
    return f"{c.about}. Takes {', '.join(p for p, _ in c.parameters)}."


def render(command: str | None = None, form: str = "text") -> str:
    """All commands or one as text, json or markdown; an unknown one gives a message."""
    chosen = [c for c in COMMANDS if command in (None, c.name)]
    if not chosen:
        message = f"unknown command: {command}"
        return json.dumps({"error": message}) if form == "json" else message
    if form == "json":
        return json.dumps([{"command": c.name, "about": c.about, "description": described(c), "parameters": [{"param": p, "description": d} for p, d in c.parameters], "examples": list(c.examples)} for c in chosen], indent=2)
    mark = ("## ", "- `{}`: {}", "    {}") if form == "markdown" else ("", "  {}  {}", "  $ {}")
    return "\n".join(x for c in chosen for x in [f"{mark[0]}{c.name}", c.about, *(mark[1].format(p, d) for p, d in c.parameters), *(mark[2].format(e) for e in c.examples), ""])

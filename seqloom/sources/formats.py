"""Names of formats and what file names say of them."""

from __future__ import annotations

import re

_NAMES = {"fasta": "fasta", "fa": "fasta", "fastq": "fastq", "fq": "fastq", "auto": "auto"}


def parse_format(name: str) -> str | None:
    """fasta, fastq or auto for a name in any case; None for another."""
    return _NAMES.get(name.lower())


def detect_format(path: str | None, given: str | None = None) -> str:
    """The given format, if it is one of the two; else what the file name's end says (.gz left aside), else fasta."""
    known = parse_format(given) if given else None
    if known in ("fasta", "fastq"):
        return known
    m = re.search(r"\.(fq|fastq|fa|fasta)(\.gz)?$", path or "", re.I)
    return _NAMES[m[1].lower()] if m else "fasta"

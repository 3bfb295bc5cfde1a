"""gzip of local files, whatever is in them."""

from __future__ import annotations

import gzip
import shutil
from pathlib import Path


def _target(path: Path, output: str | None, default: Path, force: bool) -> Path:
    out = Path(output) if output else default
    if out.exists() and not force:
        raise FileExistsError(out)
    if out.resolve() == path.resolve():
        raise ValueError("input and output are one file")
    return out


def compress(path: str, output: str | None = None, level: int = 6, delete: bool = False, force: bool = False) -> str:
    """path.gz, or output; the level is brought into 1 to 9. The input stays, unless `delete`."""
    source = Path(path)
    out = _target(source, output, Path(f"{path}.gz"), force)
    with open(source, "rb") as f, gzip.open(out, "wb", min(9, max(1, level))) as g:
        shutil.copyfileobj(f, g, 1 << 20)
    if delete:
        source.unlink()
    return str(out)


def decompress(path: str, output: str | None = None, delete: bool = False, force: bool = False) -> str:
    """The unpacked file: without .gz or .gzip, else with .out; all members of the archive. The input stays, unless `delete`."""
    source = Path(path)
    default = source.with_suffix("") if source.suffix in (".gz", ".gzip") else Path(f"{path}.out")
    out = _target(source, output, default, force)
    with gzip.open(source, "rb") as g, open(out, "wb") as f:
        shutil.copyfileobj(g, f, 1 << 20)
    if delete:
        source.unlink()
    return str(out)

"""filter: records by length, GC, regular expression, id and quality."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.schema import ORDER

#: Ids in a Python list up to here become a literal set; longer lists a joined table.
LITERAL_IDS = 1000


class NotNucleotide(ValueError):
    """A record that a nucleotide operation can't take."""


def require_nucleotides(df: DataFrame, what: str) -> None:
    """Raises NotNucleotide with the id of the first record, in input order, that is no nucleotide sequence.

    An eager check: in a lazy plan the test could be pruned or short-circuited away.
    """
    bad = first_non_nucleotide(df).collect()
    if bad:
        raise NotNucleotide(f"{what} needs nucleotide sequences; {bad[0].id!r} is none")


def first_non_nucleotide(df: DataFrame) -> DataFrame:
    """id and order columns of the first record that is no nucleotide sequence; no row if all are."""
    return df.where(~S.is_nucleotide("seq")).select("id", *ORDER).orderBy(*ORDER).limit(1)


def _ids(df: DataFrame, ids: DataFrame | Iterable[str] | None) -> DataFrame | list[str] | None:
    """Ids to select by, None if there are none."""
    if ids is None or isinstance(ids, DataFrame):
        return ids
    ids = sorted(set(ids))
    if len(ids) > LITERAL_IDS:
        return df.sparkSession.createDataFrame([(i,) for i in ids], "id string")
    return ids or None


def with_membership(df: DataFrame, ids: DataFrame | Iterable[str] | None, name: str) -> tuple[DataFrame, Column | None]:
    """df and a condition that holds for members of the ids; None without ids. A table of ids is joined, as Spark sees fit."""
    found = _ids(df, ids)
    if found is None:
        return df, None
    if isinstance(found, list):
        return df, F.col("id").isin(found)
    if found.isEmpty():
        return df, None
    members = found.select(F.col(found.columns[0]).alias("id")).distinct().withColumn(name, F.lit(True))
    return df.join(members, "id", "left"), F.coalesce(F.col(name), F.lit(False))


def filter_records(
    df: DataFrame,
    min_len: int | None = None,
    max_len: int | None = None,
    gc_min: float | None = None,
    gc_max: float | None = None,
    pattern: str | None = None,
    exclude_pattern: str | None = None,
    ids: DataFrame | Iterable[str] | None = None,
    min_qual: float | None = None,
    invert: bool = False,
    check: bool = True,
) -> DataFrame:
    """Records that meet all conditions, or with `invert` those that don't meet them all (none, without conditions).

    GC bounds need nucleotide records; `check` finds others eagerly. Records without qualities pass min_qual, as do empty
    ones. An empty set of ids is no condition. Columns and order columns stay.
    """
    if check and (gc_min is not None or gc_max is not None):
        require_nucleotides(df, "a GC filter")
    columns = df.columns
    if isinstance(ids, DataFrame) and not invert:  # a semi join keeps the other conditions under it
        if not ids.isEmpty():
            df = df.join(ids.select(F.col(ids.columns[0]).alias("id")).distinct(), "id", "left_semi")
        ids = None
    df, whole = _conditions(df, min_len, max_len, gc_min, gc_max, pattern, exclude_pattern, ids, min_qual, invert)
    return df.where(whole).select(*columns)


def _conditions(df: DataFrame, min_len=None, max_len=None, gc_min=None, gc_max=None, pattern=None, exclude_pattern=None, ids=None, min_qual=None, invert: bool = False) -> tuple[DataFrame, Column]:
    """df, joined with the ids if they are a table, and the condition that filter_records() keeps records by."""
    conditions = []
    if min_len is not None:
        conditions.append(S.seq_length("seq") >= min_len)
    if max_len is not None:
        conditions.append(S.seq_length("seq") <= max_len)
    df, member = with_membership(df, ids, "_member")
    conditions += [member] if member is not None else []
    if gc_min is not None:
        conditions.append(S.gc_content("seq") >= gc_min)
    if gc_max is not None:
        conditions.append(S.gc_content("seq") <= gc_max)
    if pattern is not None:
        conditions.append(F.col("seq").rlike(S.checked_regex(pattern)))
    if exclude_pattern is not None:
        conditions.append(~F.col("seq").rlike(S.checked_regex(exclude_pattern)))
    if min_qual is not None:
        conditions.append(F.col("qual").isNull() | (F.col("qual") == "") | (S.average_quality("qual") - 33 >= min_qual))
    whole = F.lit(True)
    for c in conditions:
        whole = whole & c
    return df, ~F.coalesce(whole, F.lit(False)) if invert else whole


def filter_counts(df: DataFrame, check: bool = True, **conditions) -> DataFrame:
    """total and kept records of a filter, as one row of one pass. Conditions are those of filter_records()."""
    if check and not {"gc_min", "gc_max"}.isdisjoint(conditions):
        require_nucleotides(df, "a GC filter")
    df, whole = _conditions(df, **conditions)
    return df.agg(F.count("*").alias("total"), F.count_if(F.coalesce(whole, F.lit(False))).alias("kept"))

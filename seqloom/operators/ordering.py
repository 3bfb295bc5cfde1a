"""sort, dedup, sample, merge and split: operators that heed the input order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.schema import ORDER
from seqloom.storage import numbered


def sort_key(by: str = "name") -> Column:
    """The key of a sort by name, len or gc."""
    keys = {"name": F.col("id"), "len": S.seq_length("seq"), "gc": S.gc_content("seq")}
    if by not in keys:
        raise ValueError(f"sort by one of {sorted(keys)}, not {by!r}")
    return keys[by]


def sort_order(by: str = "name", descending: bool = False) -> list[Column]:
    """The key, then the input order: ties stay in it, also if the key descends."""
    key = sort_key(by)
    return [key.desc() if descending else key.asc(), *(F.col(c).asc() for c in ORDER)]


def sort_records(df: DataFrame, by: str = "name", descending: bool = False) -> DataFrame:
    """Records in a stable global order: a range exchange and a sort that spills. The key is computed once."""
    keyed, order = _keyed(df, by, descending)
    return keyed.orderBy(*order).drop("_key")


def ranked_records(df: DataFrame, by: str = "name", descending: bool = False) -> DataFrame:
    """Records with their place, `rank` from 1, in the sorted order."""
    keyed, order = _keyed(df, by, descending)
    return numbered(keyed, order, "rank").drop("_key")


def _keyed(df: DataFrame, by: str, descending: bool) -> tuple[DataFrame, list[Column]]:
    """df with the key as a column, so that range sampling, exchange and sort all read it; and sort_order() over it."""
    key = F.col("_key")
    return df.withColumn("_key", sort_key(by)), [key.desc() if descending else key.asc(), *(F.col(c).asc() for c in ORDER)]


def dedup_records(df: DataFrame, by_id: bool = False, prefix: int | None = None, ignore_case: bool = False, ordered: bool = False) -> DataFrame:
    """The first record, in input order, for each key.

    The rank limit is planned before the exchange too, so each task sends one record a key and a hot key costs no more. The
    exchange hashes a digest of the key (SHA-256), so no second copy of a sequence is sent.
    """
    if by_id and prefix is not None:
        raise ValueError("a key is the id or a prefix")
    first = Window.partitionBy("_key").orderBy(*ORDER)
    kept = df.withColumn("_key", _digest(by_id, prefix, ignore_case)).withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_key", "_rank")
    return kept.orderBy(*ORDER) if ordered else kept


def _digest(by_id: bool, prefix: int | None, ignore_case: bool) -> Column:
    """32 bytes for a key of dedup_records()."""
    return F.unhex(F.sha2(S.dedup_key(by_id, prefix, ignore_case).cast("binary"), 256))


def duplicate_counts(df: DataFrame, by_id: bool = False, prefix: int | None = None, ignore_case: bool = False) -> DataFrame:
    """total, kept and removed records of a deduplication, as one row."""
    groups = df.groupBy(_digest(by_id, prefix, ignore_case).alias("_key")).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("kept")).withColumn("removed", F.col("total") - F.col("kept"))


def _draw(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in ORDER)).cast("binary"))


def sample_count(df: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """min(count, all) records drawn without replacement, the same for a seed: those with the smallest hashes of their place.

    The hash of the last one is found first: hashes are uniform, so it is near count / all, and only the hashes near it are
    sorted. What comes back is a filter by it: no task gathers the sample.
    """
    if count < 0:
        raise ValueError("a count is 0 or more")
    drawn = df.withColumn("_draw", _draw(seed))
    total = drawn.count()
    if count >= total:
        return df
    if not count:
        return df.where(F.lit(False))
    share, value, margin = count / total, _value(F.col("_draw")), 6.0
    while True:
        room = margin * (share * (1 - share) / total) ** 0.5 + margin / total
        low, high = max(0.0, share - room), min(1.0, share + room)
        r = drawn.agg(F.count_if(value < low).alias("under"), F.count_if(value < high).alias("upto")).first()
        if r.under < count <= r.upto or (low == 0.0 and high == 1.0):
            break
        margin *= 4
    near = drawn.where((value >= low) & (value < high) if high < 1.0 else value >= low).select("_draw", *ORDER)
    last = near.orderBy("_draw", *ORDER).limit(count - r.under).agg(F.max(F.struct("_draw", *ORDER)).alias("x")).first().x
    types = dict(df.dtypes)
    place = F.struct(F.lit(last["_draw"]).alias("_draw"), *(F.lit(last[c]).cast(types[c]).alias(c) for c in ORDER))
    return drawn.where(F.struct("_draw", *ORDER) <= place).drop("_draw")


def sample_counts(df: DataFrame, count: int | None = None, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """total and sampled records of sample_count() or sample_fraction(), as one row."""
    if (count is None) == (fraction is None):
        raise ValueError("a sample has a count or a fraction")
    sampled = F.least(F.count("*"), F.lit(count)) if count is not None else F.count_if(_value(_draw(seed)) < fraction)
    return df.agg(F.count("*").alias("total"), sampled.cast("long").alias("sampled"))


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Each record with a probability, the same records for a seed. No exchange."""
    if not 0 <= fraction <= 1:
        raise ValueError("a fraction is 0 to 1")
    return df.where(_value(_draw(seed)) < fraction)


def _value(draw: Column) -> Column:
    """A drawn hash as a number from 0 to 1 (exclusive)."""
    return F.conv(F.substring(draw, 1, 8), 16, 10).cast("double") / float(1 << 32)


def merge_counts(inputs: Sequence[DataFrame]) -> DataFrame:
    """file_ord and records of each input of merge_records()."""
    return merge_records(inputs).groupBy("file_ord").agg(F.count("*").alias("records"))


def merge_records(inputs: Sequence[DataFrame], prefixes: Sequence[str] | None = None, sep: str = ":", to: str = "fasta") -> DataFrame:
    """All records of the inputs, one input after the other (file_ord counts them).

    prefixes: one for each input, put before the ids; descriptions go then. FASTQ ids stay as they are.
    """
    if not inputs:
        raise ValueError("merge needs one input or more")
    out = None
    for i, df in enumerate(inputs):
        df = df.withColumn("file_ord", F.lit(i))
        if prefixes is not None and to.lower() not in ("fastq", "fq"):
            df = df.withColumns({"id": F.concat(F.lit(prefixes[i] + sep), "id"), "desc": F.lit(None).cast("string")})
        out = df if out is None else out.unionByName(df)
    return out


def split_chunks(df: DataFrame, size: int) -> DataFrame:
    """Records with `part` from 1: `size` consecutive ones each."""
    if size < 1:
        raise ValueError("a part holds one record or more")
    return numbered(df, ORDER, "_n").withColumn("part", F.floor((F.col("_n") - 1) / size).cast("int") + 1).drop("_n")


def split_parts(df: DataFrame, parts: int) -> DataFrame:
    """Records with `part` from 1: at most `parts` parts of equal size, the last may be short (so there can be fewer)."""
    if parts < 1:
        raise ValueError("there is one part or more")
    total = df.count()
    if not total:
        raise ValueError("there is nothing to split")
    return split_chunks(df, -(-total // parts))


def split_by_id(df: DataFrame) -> DataFrame:
    """Records with `part`, a file name made of the id; where ids give one name, the later records' names end in _2, _3 ...

    Places come from one global order of names, so a name that many records share is dealt to several tasks.
    """
    placed = numbered(df.withColumn("_safe", S.safe_id("id")), ["_safe", *ORDER], "_n")
    first = placed.groupBy("_safe").agg(F.min("_n").alias("_first"))
    n = F.col("_n") - F.col("_first") + 1
    return placed.join(first, "_safe").withColumn("part", F.when(n == 1, F.col("_safe")).otherwise(F.concat("_safe", F.lit("_"), n.cast("string")))).select(*df.columns, "part")

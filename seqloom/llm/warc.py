"""WARC archives by Spark's own writers, and a capture index merged out of sorted runs.

write_archives() writes uncompressed WARC/1.1 files as text whose line separator is CR LF: a record's last empty line. So
any file system that Spark knows will do, and lost tasks leave nothing behind. Records are written by classes of size, so
that no file is over FILE_BYTES but by a single record. read_archives() parses whole files.
merged_index() takes the sorted run of each archive, deals ranges of (URL key, time) to tasks and merges the runs of a
range with a loser tree, so the result is globally ordered by partition and row.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.shared import BROADCAST_BYTES, folder, written

CRLF = "\r\n"
#: The most bytes of a file, and the payloads of a class of sizes: each has as many records a file as surely fit.
FILE_BYTES, CLASSES = 64 << 20, (14 << 10, 1 << 20)
#: Bytes that a record's headers take at most without its URL.
HEADERS = 2048
ENTRIES = "run string, url_key string, capture_ts string, url string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_offset long, record_bytes long"
_NAMES = [x.split()[0] for x in ENTRIES.split(", ")]
_SCHEMA = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in (x.split() for x in ENTRIES.split(", "))])


def with_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to of each page.

    Of pages with equal payloads of `least` bytes or more, the one with the smallest page_id is the response and the others
    revisit it. A null html is an empty payload. A null page_id is never referred to; it revisits if a page with an id has
    its payload. Rows that repeat the smallest page_id are responses too.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    digest = F.sha2(F.col("payload").cast("binary"), 256)
    first = rows.select("page_id", digest.alias("payload_digest"), F.octet_length("payload").alias("n")).where(F.col("n") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 and _first is not null").drop("_n")
    first = written(first, "copied")  # payloads that have copies, by their digests alone
    rows = rows.withColumn("payload_digest", digest).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    if first.count() * 200 <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(first), "payload_digest", "left")
    else:  # short payloads, which may all be equal, take no part in the shuffle
        short = rows.where(F.col("payload_bytes") < least).withColumn("_first", F.lit(None).cast("long"))
        rows = rows.where(F.col("payload_bytes") >= least).join(first, "payload_digest", "left").unionByName(short)
    refers = F.when((F.col("payload_bytes") >= least) & F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("page_id")), F.col("_first"))
    return rows.withColumn("refers_to", refers).withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")).drop("_first")


def _record_id(page: Column) -> Column:
    h = F.md5(F.coalesce(page.cast("string"), F.lit("null")))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def write_archives(rows: DataFrame, path: str, compression: str = "none", file_bytes: int = FILE_BYTES, classes: Sequence[int] = CLASSES) -> None:
    """Writes a WARC record for each row of with_revisits(). gzip packs a file as a whole; offsets are those of the unpacked file.

    A pass for each class of sizes that has records; classes: the most bytes of payload and URL of each but the last, whose files
    have one record each.

    A revisit (identical-payload-digest profile) holds the HTTP header alone; its Content-Length is that of the payload.
    The capture time is 2024-01-01 and page_id seconds; a page without an id gets the first second.
    """
    ts = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(3155760000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.concat(http, F.when(F.col("record_type") == "response", F.col("payload")).otherwise(""))
    refers = F.when(F.col("refers_to").isNotNull(), F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), _record_id(F.col("refers_to")), F.lit(f"{CRLF}X-Refers-To-Page: "), F.col("refers_to").cast("string"), F.lit(CRLF))).otherwise("")
    target = F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20"), F.lit(CRLF))).otherwise("")
    page = F.when(F.col("page_id").isNotNull(), F.concat(F.lit("X-Page: "), F.col("page_id").cast("string"), F.lit(CRLF))).otherwise("")
    head = F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.col("record_type"), F.lit(f"{CRLF}WARC-Record-ID: "), _record_id(F.col("page_id")), F.lit(f"{CRLF}WARC-Date: "), ts, F.lit(CRLF), target, page, refers, F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest"), F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length("block").cast("string"), F.lit(CRLF + CRLF))
    size = F.octet_length("payload") + F.coalesce(F.octet_length("url"), F.lit(0))
    largest = rows.agg(F.max(size)).first()[0] or 0  # a folder is written for no rows too
    lower = -1
    for upper in [*classes, None]:
        if largest > lower:
            own = rows.where(size > lower) if upper is None else rows.where((size > lower) & (size <= upper))
            per_file = 1 if upper is None else max(1, file_bytes // (upper + HEADERS))
            own.withColumn("block", block).select(F.concat(head, F.col("block"), F.lit(CRLF)).alias("value")).write.mode("append").option("lineSep", CRLF).option("maxRecordsPerFile", per_file).option("compression", compression).text(path)
        lower = upper
    # the first task writes a file even if it has no record
    spark = rows.sparkSession
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-00000-*")
    system = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in system.globStatus(files) or ():
        if not f.getLen():
            system.delete(f.getPath(), False)


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header, block) of each record of a WARC file; a broken record ends the file with ValueError."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split(CRLF)[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(head["content-length"])
        if end + 8 + n > len(data):
            raise ValueError(f"the record at byte {at} breaks off")
        yield at, end + 8 + n - at, head, data[end + 4 : end + 4 + n]
        at = end + 8 + n


def url_key(url: str | None) -> str:
    """The sort key of a URL: its host's labels from the last to the first, then path and query, in lower case."""
    host, slash, path = (url or "").partition("://")[2].partition("/")
    return f"{','.join(reversed(host.lower().split('.')))}){slash}{path.lower()}"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """An entry for each record, in a run for each file, sorted by URL key, time and page; payload digests are recomputed.

    A response's length and digest are those of the bytes read; a revisit's are those that its headers name.
    """

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows, data = [], data.as_py()
                for at, size, head, block in records(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    cut = block.index(b"\r\n\r\n") + 4
                    page, refers, kind = head.get("x-page"), head.get("x-refers-to-page"), head["warc-type"]
                    if kind == "response":
                        n, digest = len(block) - cut, hashlib.sha256(memoryview(block)[cut:]).hexdigest()
                    else:
                        http = dict(x.split(": ", 1) for x in block[:cut].decode().split(CRLF) if ": " in x)
                        n, digest = int(http["Content-Length"]), head["warc-payload-digest"].removeprefix("sha256:")
                    url = head.get("warc-target-uri")
                    rows.append((name.rpartition("/")[2], url_key(url), head["warc-date"], url, page and int(page), n, digest, kind, refers and int(refers), at, size))
                rows.sort(key=lambda r: (r[1], r[2], -1 if r[4] is None else r[4], r[9]))
                for i in range(0, len(rows), 5000):
                    cols = zip(*rows[i : i + 5000])
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ENTRIES)


class LoserTree:
    """Merges k sorted iterables: an inner node keeps the loser of its match, so the next winner takes log2(k) comparisons."""

    def __init__(self, runs: Sequence[Iterable]):
        self.runs, k = [iter(r) for r in runs], len(runs)
        self.keys = [next(r, None) for r in self.runs]
        self.tree = [-1] * max(1, k)
        for leaf in range(k - 1, -1, -1):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        if x is None or y is None:
            return x is not None or (y is None and a < b)
        return (x, a) < (y, b)

    def _play(self, leaf: int) -> None:
        """Replays the matches from a leaf to the root; an empty node keeps the first that comes."""
        winner, node = leaf, (leaf + len(self.runs)) >> 1
        while node:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = winner
                return
            if self._beats(other, winner):
                self.tree[node], winner = winner, other
            node >>= 1
        self.tree[0] = winner

    def __iter__(self):
        if not self.runs:
            return
        while (key := self.keys[w := self.tree[0]]) is not None:
            yield key
            self.keys[w] = next(self.runs[w], None)
            self._play(w)


def merged_index(entries: DataFrame) -> DataFrame:
    """The entries of sorted runs as one global order of URL key, capture time and page.

    Ranges of that order are dealt to tasks (a hot URL's history spans several), each gets a slice of every run, and the
    slices are merged by a loser tree. A task holds its range as Arrow columns; only the keys at the heads of the slices are
    Python objects, and rows go out 5000 at a time. Rows are in order within a partition, partitions follow each other.
    """

    def run(batches):
        t = pa.Table.from_batches(list(batches), _SCHEMA).combine_chunks()
        runs = t.column("run").to_numpy()
        edges = [0, *(np.flatnonzero(runs[1:] != runs[:-1]) + 1).tolist(), len(t)] if len(t) else [0]

        def slice_(a, b):
            for i in range(a, b, 1000):
                part = t.slice(i, min(1000, b - i))
                cols = (part.column(c).to_pylist() for c in ("url_key", "capture_ts", "page_id", "run", "record_offset"))
                for k, (url, ts, page, own, at) in enumerate(zip(*cols)):
                    yield url, ts, -1 if page is None else page, own, at, i + k

        merged = (x[5] for x in LoserTree([slice_(a, b) for a, b in zip(edges, edges[1:])]))
        while rows := list(islice(merged, 5000)):
            yield from t.take(pa.array(rows)).to_batches()

    order = ["url_key", "capture_ts", "page_id", "run", "record_offset"]
    return entries.repartitionByRange(*order).sortWithinPartitions("run", *order[:3], "record_offset").mapInArrow(run, ENTRIES)


def capture_histories(pages: DataFrame, least: int = 100) -> DataFrame:
    """Writes pages (page_id, url, html) to WARC archives, reads these back and merges their index; a row for each page.

    An empty table gives no rows; other columns of pages are ignored; repeated rows are written each.
    """
    spark = pages.sparkSession
    path = folder(spark, "warc")
    write_archives(with_revisits(pages, least), path, compression="gzip")
    return merged_index(written(read_archives(spark, path), "runs"))

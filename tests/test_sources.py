"""Files: scans, sinks, gzip, the command line and the stream."""

import gzip

import pytest

from seqloom import cli
from seqloom.sources import codec, readers, writers
from seqloom.sources.formats import detect_format, parse_format


def rows(df):
    return [(r.id, r.desc, r.seq, r.qual) for r in df.orderBy("file_ord", "ord").collect()]


def put(path, text):
    (gzip.open(path, "wt", newline="") if str(path).endswith(".gz") else open(path, "w", newline="")).write(text)
    return str(path)


def test_formats():
    assert [detect_format(x) for x in ("a.fq", "a.FASTQ.gz", "a.fa", "a.txt", None)] == ["fastq", "fastq", "fasta", "fasta", "fasta"]
    assert detect_format("a.fq", "fasta") == "fasta" and detect_format("a.fq", "auto") == "fastq"
    assert parse_format("FQ") == "fastq" and parse_format("sam") is None


@pytest.mark.parametrize("name", ["a.fa", "a.fa.gz"])
def test_fasta(spark, tmp_path, name):
    p = tmp_path / name
    with gzip.open(p, "wb") if name.endswith("gz") else open(p, "wb") as f:
        f.write(b">seq1 desc of it \r\nACGT\r\n\nAC\r\n>seq2\nTTAA\n>empty\n>last\tx y\nG>T")
    assert rows(readers.read_fasta(spark, str(p))) == [("seq1", "desc of it", "ACGTAC", None), ("seq2", None, "TTAA", None), ("empty", None, "", None), ("last", "x y", "G>T", None)]


def test_fasta_odd_files(spark, tmp_path):
    assert rows(readers.read_fasta(spark, put(tmp_path / "e.fa", ""))) == []
    assert rows(readers.read_fasta(spark, put(tmp_path / "n.fa", "no header\nACGT\n>a\nC\n"))) == [("a", None, "C", None)]


def test_fasta_splits_keep_order(spark, tmp_path):
    p = put(tmp_path / "big.fa", "".join(f">r{i} x\n{'ACGT' * (i % 7)}\nAC\n" for i in range(4000)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        df = readers.read_fasta(spark, p)
        assert df.rdd.getNumPartitions() > 2
        assert [r[0] for r in rows(df)] == [f"r{i}" for i in range(4000)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_fastq_splits(spark, tmp_path):
    text = "".join(f"@r{i} d{i}\n{'ACGT' * (1 + i % 5)}\n+\n{'@+I' + 'J' * (4 * (1 + i % 5) - 3)}\n" for i in range(3000))
    p = put(tmp_path / "big.fq", text)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10007b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        got = rows(readers.read_fastq(spark, p))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(got) == 3000 and got[17] == ("r17", "d17", "ACGT" * 3, "@+I" + "J" * 9) and [g[0] for g in got] == [f"r{i}" for i in range(3000)]
    assert rows(readers.read_fastq(spark, put(tmp_path / "a.fq", "@r1 d1\r\nACGT\r\n+\r\nIIII\r\n"))) == [("r1", "d1", "ACGT", "IIII")]


def test_many_files(spark, tmp_path):
    a, b = put(tmp_path / "b.fa", ">x\nA\n"), put(tmp_path / "a.fa", ">y\nC\n>z\nG\n")
    assert [r[0] for r in rows(readers.read_sequences(spark, [a, b]))] == ["x", "y", "z"]
    assert readers.read_sequences(spark, []).count() == 0


def test_record_iterator(spark, tmp_path):
    p = put(tmp_path / "a.fa", ">y\nC\n>z\nG\n")
    assert [r.id for r in readers.record_iter(readers.read_sequences(spark, p))] == [r.id for r in readers.parse_records(spark, p)] == ["y", "z"]


def test_ids_and_bed(spark, tmp_path):
    p = put(tmp_path / "ids.txt", " a \n\nb\na\n")
    assert sorted(r.id for r in readers.read_ids(spark, p, ["c"]).collect()) == ["a", "b", "c"]
    bed = put(tmp_path / "x.bed", "#c\n\ns1\t1\t4\tregionA\ns2\t5\t9\nbroken\t1\ns3\t0\t2\t\n")
    got = [(r.seq_id, r.start, r.end, r.name) for r in readers.read_bed(spark, bed).orderBy("bed_ord").collect()]
    assert got == [("s1", 1, 4, "regionA"), ("s2", 5, 9, None), ("s3", 0, 2, "")]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|BED"):
        readers.read_bed(spark, put(tmp_path / "y.bed", "s\tone\t4\n")).collect()


def test_round_trip(spark, tmp_path, records):
    df = records(("a", "ACGTACGT", None, "d"), ("b", ""), ("c", "GG"))
    for fmt, ending in (("fasta", "fa"), ("fastq", "fq")):
        out = str(tmp_path / f"one.{ending}")
        assert writers.write_file(df, out, fmt, 3) == 3
        assert [(r[0], r[1], r[2]) for r in rows(readers.read_sequences(spark, out))] == [("a", "d", "ACGTACGT"), ("b", None, ""), ("c", None, "GG")]
    writers.write_sequences(df, str(tmp_path / "folder"), "fasta", 3, "gzip")
    assert readers.read_fasta(spark, str(tmp_path / "folder")).count() == 3


def test_codec(tmp_path):
    p = put(tmp_path / "t.txt", "Hello, World!\n" * 1000)
    out = codec.compress(p, level=12)
    with pytest.raises(FileExistsError):
        codec.compress(p)
    assert (tmp_path / "t.txt").exists()
    assert open(codec.decompress(out, str(tmp_path / "back"))).read() == "Hello, World!\n" * 1000
    codec.decompress(out, delete=True, force=True)
    assert not (tmp_path / "t.txt.gz").exists()


def run(spark, *argv):
    return cli.main([str(x) for x in argv], spark)


def test_command_line(spark, tmp_path, capsys):
    fa = put(tmp_path / "a.fa", ">s1 d\nACGTAC\n>s2\nGG\n>s1\nTTTT\n")
    out = tmp_path / "o.fa"
    assert run(spark, "filter", "-i", fa, "--min-len", 3, "-o", out) == 0 and out.read_text() == ">s1 d\nACGTAC\n>s1\nTTTT\n"
    assert run(spark, "sort", "-i", fa, "--by-len", "-d", "-o", out) == 0 and out.read_text().split("\n")[0::2][:3] == [">s1 d", ">s1", ">s2"]
    assert run(spark, "dedup", "-i", fa, "--by-id", "-o", out) == 0 and out.read_text() == ">s1 d\nACGTAC\n>s2\nGG\n"
    assert run(spark, "extract", "-i", fa, "--id", "s2", "-r", "2:2", "-o", out) == 0 and out.read_text() == ">s2_2:2 extracted region 2-2\nG\n"
    assert run(spark, "search", "CG", "-i", fa, "-o", out) == 0 and out.read_text() == "s1:2-3\tCG\t+\ns1:2-3\tCG\t-\n"
    assert run(spark, "modify", "-i", fa, "-r", "-o", out) == 0 and out.read_text().split("\n")[1] == "GTACGT"
    assert run(spark, "convert", "-i", fa, "-T", "fastq", "-o", tmp_path / "o.fq") == 0 and (tmp_path / "o.fq").read_text().startswith("@s1 d\nACGTAC\n+\n??????\n")
    assert run(spark, "sample", "-i", fa, "-n", 2, "-o", out) == 0 and out.read_text().count(">") == 2
    assert run(spark, "merge", fa, fa, "-a", "-o", out) == 0 and out.read_text().startswith(">a:s1\nACGTAC\n")
    assert run(spark, "split", "-i", fa, "-c", 2, "--outdir", tmp_path / "parts", "--prefix", "chunk") == 0
    assert sorted(p.name for p in (tmp_path / "parts").iterdir()) == ["chunk_0001.fa", "chunk_0002.fa"]
    assert run(spark, "stats", "-i", fa, "--gc") == 0 and "Sequences: 3" in capsys.readouterr().out
    assert run(spark, "guide", "sort") == 0
    assert run(spark, "filter", "-i", put(tmp_path / "p.fa", ">p\nMKW\n"), "--gc-min", 10) == 1
    assert run(spark, "extract", "-i", tmp_path / "o.fq", "--id", "s1") == 1
    assert run(spark, "split", "-i", fa, "-c", 0) == 1


def test_stream(spark, tmp_path):
    from seqloom.streaming import landing

    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "a.fa", ">a\nACGT\n>b\nGG\n>c\nACGT\n")
    stream = landing.stream_fasta(spark, str(tmp_path / "in"))
    for i in range(2):
        landing.run_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), landing.dedup_stream, once=True).awaitTermination()
        assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["ACGT", "GG"]


@pytest.mark.parametrize("fmt", ["fasta", "fastq"])
def test_folders_count_as_several_files(spark, tmp_path, fmt):
    df = spark.range(300).selectExpr("0 AS file_ord", "id AS ord", "concat('r', id) AS id", "concat('d ', id) AS `desc`", "repeat('ACGT', cast(id % 5 + 1 AS int)) AS seq", "repeat('@+IJ', cast(id % 5 + 1 AS int)) AS qual")
    df = df if fmt == "fastq" else df.withColumn("qual", df.qual.substr(1, 0)).replace("", None, "qual")
    path = str(tmp_path / "many files")
    writers.write_sequences(df.repartition(7), path, fmt, ordered=False, compression="gzip" if fmt == "fasta" else "none")
    found = readers.read_sequences(spark, path, fmt)
    assert sorted(rows(found)) == sorted(rows(df))
    assert found.select("file_ord").distinct().count() == 7 and found.select("file_ord", "ord").distinct().count() == 300
    one = put(tmp_path / "one.fa", ">x\nAC\n")
    both = readers.read_sequences(spark, [path, one], None if fmt == "fasta" else "fasta") if fmt == "fasta" else None
    assert both is None or both.orderBy("file_ord", "ord").collect()[-1].id == "x"


def test_command_writes_a_folder(spark, tmp_path):
    source = put(tmp_path / "a.fa", ">b\nACGT\n>a\nGG\n")
    assert cli.main(["sort", "-i", source, "-o", f"{tmp_path}/out/", "--gzip"], spark) == 0
    assert [r[0] for r in rows(readers.read_fasta(spark, f"{tmp_path}/out"))] == ["a", "b"]


def test_bad_expression_is_an_error(spark, tmp_path, capsys):
    source = put(tmp_path / "a.fa", ">b\nACGT\n")
    assert cli.main(["search", r"\p{L}", "-r", "-i", source], spark) == 1 and "regular expression" in capsys.readouterr().err


def test_clusters_need_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from seqloom import storage

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://x:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.folder(cluster, "x")


def test_written_tables_are_cleaned(spark, records):
    from pathlib import Path

    from seqloom import storage

    table = storage.written(records(("a", "ACGT")), "t")
    path = Path(storage._MADE[-1].removeprefix("file://").removeprefix("file:"))
    assert table.count() == 1 and path.exists()
    assert storage.clean(spark) >= 1 and not path.exists() and storage.clean(spark) == 0

"""The behaviours of the sequence operators on small literal inputs."""

import pytest

from seqloom import guide
from seqloom.functions import sequence as S
from seqloom.operators import aggregation, extraction, ordering, search, selection, transform


def ids(df):
    return [r.id for r in df.orderBy("file_ord", "ord").collect()]


def seqs(df):
    return [r.seq for r in df.orderBy("file_ord", "ord").collect()]


def test_parse_range():
    assert S.parse_range("1:100") == (0, 100)
    for bad in ("0:10", "10:1", "5", "a:b", "1:2:3", "-1:4"):
        with pytest.raises(ValueError):
            S.parse_range(bad)


def test_filter_lengths_and_ids(records):
    df = records(("p1", "MKWVTF"), ("p2", "GA"))
    assert ids(selection.filter_records(df, min_len=3)) == ["p1"]
    assert ids(selection.filter_records(df, max_len=2)) == ["p2"]
    assert ids(selection.filter_records(df, ids=["p2", "x"])) == ["p2"]
    assert ids(selection.filter_records(df, ids=[])) == ["p1", "p2"]
    assert ids(selection.filter_records(df, ids=["p2"], invert=True)) == ["p1"]
    assert ids(selection.filter_records(df, invert=True)) == []


def test_filter_by_table_of_ids(spark, records):
    df = records(("a", "A"), ("b", "C"), ("a", "G"))
    table = spark.createDataFrame([("a",), ("a",)], "id string")
    assert seqs(selection.filter_records(df, ids=table)) == ["A", "G"]
    assert seqs(selection.filter_records(df, ids=table, invert=True)) == ["C"]
    assert ids(selection.filter_records(df, ids=table.where("false"))) == ["a", "b", "a"]


def test_filter_gc_needs_nucleotides(records):
    with pytest.raises(selection.NotNucleotide, match="p1"):
        selection.filter_records(records(("p1", "MKWVTF")), gc_min=10)
    with pytest.raises(selection.NotNucleotide):
        selection.filter_records(records(("e", "")), gc_min=10)
    df = records(("a", "GGNN"), ("b", "AATT"), ("c", "GU-."))
    assert ids(selection.filter_records(df, gc_min=100.0)) == ["a"]
    assert ids(selection.filter_records(df, gc_max=50.0)) == ["b", "c"]


def test_filter_patterns_keep_case(records):
    df = records(("a", "acgt"), ("b", "ACGT"))
    assert ids(selection.filter_records(df, pattern="ACG")) == ["b"]
    assert ids(selection.filter_records(df, exclude_pattern="ACG")) == ["a"]
    for bad in ("(?=A)", "(?<!A)C", r"(A)\1"):
        with pytest.raises(ValueError):
            selection.filter_records(df, pattern=bad)


def test_filter_quality(records):
    df = records(("a", "ACGT", "IIII"), ("b", "ACGT"), ("c", "", ""))
    assert ids(selection.filter_records(df, min_qual=40)) == ["a", "b", "c"]
    assert ids(selection.filter_records(df, min_qual=41)) == ["b", "c"]


def test_modify(records):
    assert seqs(transform.modify_records(records(("p", "mkwvtf")), upper=True)) == ["MKWVTF"]
    with pytest.raises(selection.NotNucleotide):
        transform.modify_records(records(("p", "MKWVTF")), reverse_complement=True)
    out = transform.modify_records(records(("r", "aACGTUN-", "12345678")), reverse_complement=True).first()
    assert (out.seq, out.qual) == ("-NAACGTT", "87654321")
    df = records(("r", "ac-gt"))
    assert seqs(transform.modify_records(df, reverse_complement=True, lower=True, remove_gaps=True, slice_range="1:2")) == ["ac"]
    assert seqs(transform.modify_records(df, upper=True, lower=True)) == ["AC-GT"]
    assert seqs(transform.modify_records(records(("r", "ACGT")), slice_range="3:10")) == ["GT"]
    assert seqs(transform.modify_records(records(("r", "ACGT")), slice_range="9:12")) == [""]


def test_gap_qualities(records):
    df = records(("r", "A-CG", "1234"), ("s", "ACGT", "abcd"), ("t", "A.C"))
    out = [r.qual for r in transform.modify_records(df, remove_gaps=True).orderBy("ord").collect()]
    assert out == ["134", "abcd", None]
    assert transform.modify_records(df, remove_gaps=True, legacy_gap_qual=True).orderBy("ord").first().qual == "123"


def test_convert_and_render(records):
    assert transform.convert_records(records(("r", "ACGT")), "fastq", 30).first().qual == "????"
    assert transform.convert_records(records(("r", "ACGT", "IIII")), "fasta").first().qual is None
    with pytest.raises(ValueError):
        transform.convert_records(records(("r", "ACGT")), "fastq", 94)
    assert transform.rendered(records(("r", "ACGTACGTA", None, "d")), width=4).first().value == ">r d\nACGT\nACGT\nA"
    assert transform.rendered(records(("r", "ACGTACGT")), width=4).first().value == ">r\nACGT\nACGT"
    assert transform.rendered(records(("r", "")), width=4).first().value == ">r"
    assert transform.rendered(records(("r", "AC")), "fastq").first().value == "@r\nAC\n+\nII"
    with pytest.raises(ValueError):
        transform.rendered(records(("r", "AC")), width=0)


def test_extract(spark, records):
    df = records(("seq1", "AACCGGTT"), ("seq2", "TTTTAAAA"))
    out = extraction.extract_records(df, ids=["seq1"], range_="2:5").collect()
    assert [(r.id, r.seq, r.desc) for r in out] == [("seq1_2:5", "ACCG", "extracted region 2-5")]
    bed = lambda *rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "bed_ord long, seq_id string, start long, `end` long, name string")
    out = extraction.extract_records(df, bed=bed(("seq1", 1, 4, "regionA")), ids=["seq2"], range_="1:2").collect()
    assert [(r.id, r.seq) for r in out] == [("seq1_regionA", "ACC")]
    out = extraction.extract_records(df, bed=bed(("seq1", 1, 4, None), ("seq1", 20, 30, None)), flank=2).collect()
    assert [(r.id, r.seq) for r in out] == [("seq1_1:6", "AACCGG")]
    for nothing in ({}, {"ids": []}, {"bed": bed(("x", 1, 2, None)).where("false")}):
        with pytest.raises(ValueError):
            extraction.extract_records(df, **nothing)


def hits(df, *a, **k):
    return [(r.start, r.end, r.matched, r.strand) for r in search.find_hits(df, *a, ordered=True, **k).collect()]


def test_search_literal(records):
    assert hits(records(("p", "MKWVTFISLL")), "WVTF") == [(2, 6, "WVTF", "+")]
    assert hits(records(("a", "AAAA")), "AA") == [(0, 2, "AA", "+"), (1, 3, "AA", "+"), (2, 4, "AA", "+")]
    assert hits(records(("g", "GAATTC")), "GAATTC") == [(0, 6, "GAATTC", "+"), (0, 6, "GAATTC", "-")]
    assert hits(records(("s", "AC")), "ACG") == []
    assert hits(records(("s", "acgTT")), "Cg") == [(1, 3, "cg", "+"), (1, 3, "cg", "-")]
    assert hits(records(("a", "AC"), ("b", "GT")), "ACGT") == []  # never across records
    with pytest.raises(ValueError):
        hits(records(("a", "A")), "")


def test_search_mismatches(records):
    found = hits(records(("r", "ATGCTGAAG")), "ATG", mismatches=1)
    assert [h[0] for h in found if h[3] == "+"] == [0, 3, 6]
    brute = [i for i in range(7) if sum(a != b for a, b in zip("ATGCTGAAG"[i : i + 3], "CAT")) <= 1]
    assert [h[0] for h in found if h[3] == "-"] == brute


def test_search_regex_and_counts(records):
    assert hits(records(("r", "acgtACG")), "ACG", regex=True) == [(0, 3, "ACG", "+"), (4, 7, "ACG", "+")]
    assert hits(records(("r", "acgt")), "acg", regex=True) == []
    r = search.count_hits(records(("r", "GAATTCGAATTC")), "gaattc").first()
    assert (r.forward, r.reverse) == (2, 2)
    assert search.count_hits(records(("r", "A.CAxC")), ".").first().forward == 1


def test_search_lines(records):
    h = search.find_hits(records(("id", "xATGx")), "ATG")
    assert search.hit_lines(h).first().value == "id:2-4\tATG\t+"
    assert search.hit_lines(h, bed=True).first().value == "id\t1\t4\tATG"
    assert search.hit_lines(h, bed=True, strand=True).first().value == "id\t1\t4\tATG\t0\t+"


def test_stats(records):
    r = aggregation.sequence_stats(records(("a", "GGNN"), ("b", "GU-."), ("p", "MKW")), gc=True).first()
    assert (r["count"], r.total_len, r.nucleotide_count, r.gc_count, r.at_count, r.n_count) == (3, 11, 2, 3, 1, 2)
    assert aggregation.sequence_stats(records(("a", "GGNN")), gc=True).first().gc_percent == 50.0
    q = aggregation.sequence_stats(records(("a", "ACGT", "IIII")), qual=True).first()
    assert (q.mean_qual, q.qual_min, q.qual_max) == (73.0, 73, 73)
    empty = aggregation.sequence_stats(records(("a", "A")).where("false"), gc=True, qual=True).first()
    assert (empty["count"], empty.mean_len, empty.qual_min) == (0, 0.0, None)
    assert aggregation.report(records(("a", "A")).where("false")) == "No sequences found."
    assert "Mean length: 3.67" in aggregation.report(records(("a", "GGNN"), ("b", "GU-."), ("p", "MKW")), gc=True)


def test_sort_is_stable(records):
    df = records(("z", "AAAA"), ("a", "TT"), ("m", "CCC"), ("a", "GG"))
    assert [r.id for r in ordering.sort_records(df).collect()] == ["a", "a", "m", "z"]
    assert [r.seq for r in ordering.sort_records(df, "len", True).collect()] == ["AAAA", "CCC", "TT", "GG"]
    ranked = ordering.ranked_records(df, "name", True).orderBy("rank").collect()
    assert [(r["rank"], r.seq) for r in ranked] == [(1, "AAAA"), (2, "CCC"), (3, "TT"), (4, "GG")]


def test_dedup(records):
    df = records(("a", "AAAA"), ("b", "CCCC"), ("a", "TTTT"), ("c", "AAAA"), ("b", "aaaa"))
    assert seqs(ordering.dedup_records(df, by_id=True)) == ["AAAA", "CCCC", "AAAA"]
    assert ids(ordering.dedup_records(df)) == ["a", "b", "a", "b"]
    assert ids(ordering.dedup_records(df, ignore_case=True)) == ["a", "b", "a"]
    assert ids(ordering.dedup_records(records(("x", "ACGTA"), ("y", "acgtc")), prefix=4, ignore_case=True)) == ["x"]
    once = ordering.dedup_records(df)
    assert sorted(ids(ordering.dedup_records(once))) == sorted(ids(once))


def test_sample(records):
    df = records(*((f"r{i}", "A") for i in range(200)))
    a, b = (ordering.sample_count(df, 20, 3) for _ in range(2))
    assert ids(a) == ids(b) and len(set(ids(a))) == 20
    assert ids(ordering.sample_count(df, 500)) == ids(df)
    assert ordering.sample_count(df, 0).count() == 0
    assert 20 < ordering.sample_fraction(df, 0.25).count() < 85
    assert ordering.sample_fraction(df, 0.0).count() == 0 and ordering.sample_fraction(df, 1.0).count() == 200
    with pytest.raises(ValueError):
        ordering.sample_fraction(df, 1.5)


def test_merge_and_split(records):
    a, b = records(("r1", "A", None, "d")), records(("r1", "C"), ("r2", "G"))
    merged = ordering.merge_records([a, b])
    assert [(r.file_ord, r.id) for r in merged.orderBy("file_ord", "ord").collect()] == [(0, "r1"), (1, "r1"), (1, "r2")]
    named = ordering.merge_records([a, b], ["x", "y"]).orderBy("file_ord", "ord").collect()
    assert [(r.id, r.desc) for r in named] == [("x:r1", None), ("y:r1", None), ("y:r2", None)]
    assert ordering.merge_records([a, b], ["x", "y"], to="fastq").first().id == "r1"
    df = records(*((f"s{i}", "AC") for i in range(5)))
    parts = lambda d: [r.part for r in d.orderBy("ord").collect()]
    assert parts(ordering.split_parts(df, 2)) == [1, 1, 1, 2, 2]
    assert parts(ordering.split_parts(df, 4)) == [1, 1, 2, 2, 3]
    assert parts(ordering.split_chunks(df, 2)) == [1, 1, 2, 2, 3]
    assert parts(ordering.split_by_id(records(("a/b", "A"), ("a_b", "C"), ("c", "G")))) == ["a_b", "a_b_2", "c"]
    for bad in (lambda: ordering.split_chunks(df, 0), lambda: ordering.split_parts(df, 0), lambda: ordering.split_parts(df.where("false"), 2)):
        with pytest.raises(ValueError):
            bad()
    whole = ordering.merge_records([ordering.split_parts(df, 2).where(f"part = {i}").drop("part") for i in (1, 2)])
    assert sorted(ids(whole)) == ids(df)


def test_guide(spark):
    assert guide.catalog(spark).count() == 12
    assert "unknown command" in guide.render("nothing") and "error" in guide.render("nothing", "json")
    assert guide.render("sort", "markdown").startswith("## sort")


def test_plans(records):
    """Deduplication limits ranks before the exchange; filters of ids are semi joins; nothing is a cross join."""
    plan = ordering.dedup_records(records(("a", "A")))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange")
    sample = ordering.sample_fraction(records(("a", "A")), 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in sample


def test_long_sequences_are_searched_in_slices(records, monkeypatch):
    import random

    r = random.Random(8)
    seq = "".join(r.choices("ACGT", k=5000))
    df = records(("long", seq), ("short", "GATTACA"), ("protein", "MKW" + seq))
    whole = {p: sorted(map(tuple, search.find_hits(df, p, m).collect())) for p, m in (("GAT", 0), ("ACCA", 1), ("A" * 40, 30))}
    rows = list(df.select("file_ord", "ord", "id", "seq").toArrow().to_batches())
    monkeypatch.setattr(search, "CHUNK", 64)
    for p, m in (("GAT", 0), ("ACCA", 1), ("A" * 40, 30)):
        patterns = [("+", p.encode(), False), ("-", search.reverse_complement(p).encode(), True)]
        found = [tuple(x.values()) for b in rows for out in search._literal_hits(b, patterns, m) for x in out.to_pylist()]
        assert sorted(found) == whole[p] and whole[p]


def test_counts(records):
    df = records(*((f"r{i}", "ACGT" * (i + 1)) for i in range(10)))
    r = selection.filter_counts(df, min_len=20, pattern="ACGTACGT").first()
    assert (r.total, r.kept) == (10, 6)
    r = selection.filter_counts(df, ids=["r1", "r2"], invert=True).first()
    assert (r.total, r.kept) == (10, 8)
    assert tuple(ordering.sample_counts(df, count=3).first()) == (10, 3) and tuple(ordering.sample_counts(df, count=30).first()) == (10, 10)
    assert sorted(map(tuple, ordering.merge_counts([df, df.limit(2)]).collect())) == [(0, 10), (1, 2)]
    with pytest.raises(selection.NotNucleotide):
        selection.filter_counts(records(("p", "MKW")), gc_min=1.0)


def test_sample_takes_the_smallest_draws(records):
    df = records(*((f"r{i}", "A") for i in range(3000)))
    for n in (1, 7, 1500, 2999):
        drawn = df.withColumn("d", ordering._draw(5)).orderBy("d", "file_ord", "ord").limit(n)
        assert ids(ordering.sample_count(df, n, 5)) == ids(drawn)
    plan = ordering.sample_count(df, 1500, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "TakeOrdered" not in plan


def test_keys_are_projected_once(records):
    plan = ordering.sort_records(records(("a", "ACGT")), "gc")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("translate(seq") == plan.split("Project")[-1].count("translate(seq") > 0

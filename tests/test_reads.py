import pytest
from pyspark.sql import functions as F

from strandspark.functions import cigar as C
from strandspark.functions import flags as G
from strandspark.functions import sequence as S
from strandspark.functions import stats as T
from strandspark.operators import align as A
from strandspark.operators import count as N
from strandspark.operators import pileup as P
from strandspark.operators import variants as V
from strandspark.schemas import READS


def make(spark, rows):
    """rows: qname, flag, chrom, pos, cigar and, if given, seq, tags, mapq, tlen."""
    out = []
    for i, r in enumerate(rows):
        q, flag, chrom, pos, cigar, *more = r
        seq, tags, mapq, tlen = [*more, *[None] * 4][:4]
        out.append((q, flag, chrom, pos, 30 if mapq is None else mapq, cigar, None, -1, tlen or 0, seq, "I" * len(seq) if seq else None, {k: ("i", str(v)) for k, v in (tags or {}).items()}, i))
    return spark.createDataFrame(out, READS)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_cigar(spark):
    o = C.parse(F.lit("5S10M2I3D20M100N8M4H"))
    assert one(spark, C.to_string(o)) == "5S10M2I3D20M100N8M4H"
    assert one(spark, C.ref_length(o)) == 141 and one(spark, C.read_length(o)) == 45
    assert [tuple(b) for b in one(spark, C.blocks(F.lit(100), o))] == [(100, 110), (113, 133), (233, 241)]
    assert [tuple(b) for b in one(spark, C.regions(F.lit(100), o))] == [(100, 133), (233, 241)]
    assert [tuple(b) for b in one(spark, C.junctions(F.lit(100), o))] == [(133, 233)]
    assert one(spark, C.to_string(C.clean(C.parse(F.lit("10M0I5M3D0M2M"))))) == "15M3D2M"
    assert one(spark, C.op_at(o, F.lit(3))) == "S" and one(spark, C.op_at(o, F.lit(15))) == "I" and one(spark, C.op_at(o, F.lit(16), True)) == "D"
    assert one(spark, C.parse(F.lit("*"))) == [] and one(spark, C.parse(F.lit(None).cast("string"))) == []
    assert one(spark, C.deleted_at(C.parse(F.lit("10M2D5M")), F.lit(9))) and not one(spark, C.deleted_at(C.parse(F.lit("10M2D5M")), F.lit(12)))


@pytest.mark.parametrize("cigar,ok", [("10M5N10M", True), ("5N10M", False), ("10M", False), ("3M5N10M", False), ("10M5N3M", False), ("10M5N2M5N10M", True)])
def test_junction_valid(spark, cigar, ok):
    assert one(spark, C.junction_valid(C.parse(F.lit(cigar)), 4))["valid"] is ok


def test_sequences(spark):
    assert one(spark, S.revcomp(F.lit("AACGTn"))) == "nACGTT"
    assert one(spark, S.phred(F.lit("!+I"))) == [0, 10, 40]
    assert one(spark, S.phred_text(F.array(F.lit(-5), F.lit(40), F.lit(200)))) == "!I~"
    assert one(spark, S.shift_quality(F.lit("hhB"), -31)) == "II#"
    assert one(spark, S.trim_name(F.lit("a_F3_b_R3x"))) == "a_F3_b"
    assert one(spark, S.quoted_split(F.lit('a "x;y";b'))) == ['a "x;y"', "b"]
    with pytest.raises(Exception):
        one(spark, S.revcomp(F.lit("AX"), strict=True))


def test_statistics(spark):
    e = one(spark, T.entropy(*[F.lit(x) for x in (10, 0, 0, 0)]))
    assert e > 0 and one(spark, T.entropy(*[F.lit(0)] * 4)) == 0
    c = one(spark, T.consensus(*[F.lit(x) for x in (2, 1, 0, 0)]))
    assert (c.major, c.minor) == ("A", "C")
    c = one(spark, T.consensus(*[F.lit(x) for x in (2, 2, 1, 0)]))
    assert (c.major, c.minor) == ("C/A", "")
    assert one(spark, T.heterozygosity(*[F.lit(x) for x in (6, 3, 1, 0)])) == pytest.approx(2 / 7)
    assert one(spark, T.poisson(F.lit(2), F.lit(1.5))) == pytest.approx(0.25102143)
    assert one(spark, T.poisson_cumulative(F.lit(2), F.lit(1.0))) == pytest.approx(0.36787944 * 1.5)
    assert T.beta_cdf(0.5, 2, 2) == pytest.approx(0.5) and T.beta_quantile(0.025, 1, 1) == pytest.approx(0.025)
    low, high = T.binomial_interval(100, 30, 10)
    assert 0.2 < low < 0.3 < high < 0.42


def test_filters(spark):
    r = make(spark, [("a", 0, "chr1", 100, "10M", "A" * 10, {"AS": 5, "NM": 1}), ("b", 4, None, -1, "*", "C" * 10), ("c", 1 | 8, "chr1", 200, "10M", "A" * 10, {"AS": 9, "NM": 4}), ("d", 1 | 2 | 32, "chr2", 300, "5M2I3M", "A" * 10, {"NM": 3})])
    keep = lambda *c: [x.qname for x in A.filter_reads(r, *c).where("fail_reason is null").orderBy("idx").collect()]
    assert keep(("mapped",)) == ["a", "d"] and keep(("unmapped",)) == ["b", "c"]
    assert keep(("properpair",)) == ["d"]
    assert keep(("mismatch", 2)) == ["a", "d"]  # an insertion counts once
    assert keep(("gte", "AS", 5)) == ["a", "c"] and keep(("lt", "AS", 6)) == ["a", "b", "d"]
    assert keep(("exclude", "chr1:101-150")) == ["b", "c", "d"] and keep(("include", "chr1:101-150", "chr2:301-301")) == ["a", "d"]
    reasons = {x.qname: x.fail_reason for x in A.filter_reads(r, ("mapped",), ("includeref", "chr1")).collect()}
    assert reasons == {"a": None, "b": "mapped", "c": "mapped", "d": "includeref"}


def test_unique_and_lists(spark):
    r = make(spark, [("a", 0, "c", 5, "4M", "AACC"), ("b", 0, "c", 5, "4M", "AACC"), ("c", 16, "c", 5, "4M", "CCAA"), ("d", 4, None, -1, "*", "AACC")])
    assert [x.qname for x in A.unique_sequence(r).orderBy("idx").collect()] == ["a", "d"]
    assert [x.qname for x in A.unique_start(r).orderBy("idx").collect()] == ["a", "c"]
    names = spark.createDataFrame([("a",), ("a",)], "name string")
    assert A.in_list(r, names).count() == 1 and A.not_in_list(r, names).count() == 3


def test_best_and_pairs(spark):
    a = make(spark, [("r", 0, "c", 100, "10M", "A" * 10, {"AS": 9, "NM": 0}), ("r", 0, "c", 500, "10M", "A" * 10, {"AS": 9, "NM": 0}), ("s", 4, None, -1, "*", "A" * 10, {})])
    b = make(spark, [("r", 16, "c", 200, "10M", "A" * 10, {"AS": 8, "NM": 1}), ("s", 16, "c", 10, "10M", "A" * 10, {"AS": 8, "NM": 1})])
    assert [x.best for x in A.best_mappings(a).orderBy("idx").collect()] == [True, True, True]
    pairs, lost = A.pair_reads(a, b)
    assert [(x.pos1, x.pos2, x.size, x.nh) for x in pairs.collect()] == [(100, 200, 110, 1)]
    assert {(x.read, x.qname, x.pos, x.reasons) for x in lost.collect()} == {(1, "r", 500, "direction"), (1, "s", -1, "unmapped"), (2, "s", 10, "unmapped")}


def test_duplicates(spark):
    r = make(spark, [("a", 0, "c", 5, "4M", "AACC", {}, 10, 100), ("b", 0, "c", 5, "4M", "AACC", {}, 20, 100), ("c", 0, "c", 5, "4M", "AACC", {}, 20, 90)])
    assert [x.flag for x in A.mark_duplicates(r).orderBy("idx").collect()] == [1024, 0, 0]
    assert {(x.tlen, x.n) for x in A.duplicate_counts(r).collect()} == {(100, 2), (90, 1)}


def test_conversions(spark):
    r = make(spark, [("a/1", 16, "c", 5, "2S4M", "TTACGT"), ("a/1", 16, "c", 9, "6M", "TTACGT")])
    assert [(x.name, x.seq) for x in A.to_fastq(r).collect()] == [("a/1", "ACGTAA")]
    named = A.rename_pairs(r).first()
    assert named.qname == "a" and named.tags["ZN"].v == "1"
    clipped = A.remove_clipping(r).orderBy("idx").first()
    assert (clipped.seq, clipped.cigar, clipped.tags["ZA"].v, clipped.tags["ZB"].v) == ("ACGT", "4M", "2", "0")
    assert [(x.start, x.end, x.strand) for x in A.to_bed(r).orderBy("start").collect()] == [(5, 9, "-"), (9, 15, "-")]


def test_convert_regions(spark):
    r = make(spark, [("a", 0, "chr1:100-150,200-250", 40, "20M", "A" * 20), ("b", 0, "chr1:100-150,200-250", 10, "20M", "A" * 20), ("c", 0, "chr1:100-150,200-250", 48, "20M", "A" * 20), ("d", 0, "chr1:10-20,30-40,50-60", 5, "20M", "A" * 20)])
    got = {x.qname: (x.chrom, x.pos, x.cigar) for x in A.convert_regions(r).collect()}
    assert got["a"] == ("chr1", 140, "10M50N10M") and got["d"] == ("chr1", 15, "5M10N10M10N5M")
    assert got["b"][0] is None and got["c"][0] is None


def test_coverage_and_peaks(spark):
    r = make(spark, [("a", 0, "c", 10, "5M10N5M", "A" * 10), ("b", 0, "c", 12, "5M", "A" * 5), ("c", 16, "c", 12, "2M2D2M", "A" * 4)])
    assert sorted(tuple(x) for x in P.read_coverage(r).select("start", "end", "depth").collect()) == [(10, 12, 1.0), (12, 14, 3.0), (14, 15, 2.0), (15, 16, 1.0), (16, 17, 2.0), (17, 18, 1.0), (25, 30, 1.0)]
    bed = spark.createDataFrame([("c", 10, 20), ("c", 40, 50)], "chrom string, start long, end long")
    got = {x.start: (x.max_depth, x.reads, x.total) for x in P.peak_heights(r, bed).collect()}
    assert got == {10: (3, 3, 16), 40: (0, 0, 0)}


def test_expressed(spark):
    r = make(spark, [("a", 0, "c", 10, "10M", "A" * 10), ("b", 0, "c", 25, "10M", "A" * 10), ("c", 0, "c", 60, "10M", "A" * 10), ("d", 16, "c", 10, "10M", "A" * 10)])
    assert [(x.start, x.end, x.score, x.strand) for x in P.expressed_regions(r).collect()] == [(10, 35, 2, "+")]


def test_base_calls(spark):
    ref = P.chunked_reference(spark.createDataFrame([("c", "ACGTACGTACGT")], "name string, seq string"), 5)
    r = make(spark, [("a", 0, "c", 0, "4M", "ACGA"), ("b", 16, "c", 0, "4M", "ACGT"), ("d", 0, "c", 0, "2M1I2M", "ACTGT"), ("e", 0, "c", 1, "1M1D1M", "CT")])
    got = {x.pos: x for x in P.base_calls(r, ref, chunk=5).collect()}
    assert (got[4].ref, got[4]["count"], got[4].consensus, got[4].minor) == ("T", 4, "T", "A")
    assert got[3].inserts == "T:1" and got[3].deletions == 1
    assert [x.pos for x in P.base_calls(r, ref, variants=True, chunk=5).collect()] == []
    assert {x.idx: x.mismatches for x in P.mismatches_to_reference(r, ref, 5).collect()} == {0: 1, 1: 0, 2: 1, 3: 1}
    alt = {x.pos: (x.altbase, x.altcount, x.refcount) for x in P.minor_alleles(r, ref, alleles=4, chunk=5).collect()}
    assert alt[4] == ("A", 1, 3)


def test_cims(spark):
    r = make(spark, [("a", 0, "c", 0, "5M1D20M1D20M", "A" * 45)])
    assert [(x.start, x.end) for x in P.deletion_clusters(r, window=20).orderBy("start").collect()] == [(5, 5), (26, 26)]
    assert [(x.start, x.end) for x in P.deletion_clusters(r, window=30).collect()] == [(5, 26)]


def test_variants(spark):
    assert V.read_variants(100, "10M", "4A5", "ACGTCCGTAC") == [("M", 104, "C")]
    assert V.read_variants(100, "4M2I4M", "8", "ACGTTTACGT") == [("I", 104, "TT")]
    assert V.read_variants(100, "4M2D4M", "4^GG4", "ACGTACGT") == [("D", 104, "GG")]
    assert V.read_variants(100, "4M2D4M", "4^GG0A3", "ACGTTCGT") == [("D", 104, "GG"), ("M", 106, "T")]
    assert V.read_variants(100, "2S4M10N4M", "0T7", "GGACGTACGT") == [("M", 100, "A")]
    r = make(spark, [("a", 0, "c", 100, "10M", "ACGTCCGTAC", {})]).withColumn("tags", F.create_map(F.lit("MD"), F.struct(F.lit("Z").alias("t"), F.lit("4A5").alias("v"))))
    snp = spark.createDataFrame([("c", 104, "-", "T/G", "single")], "chrom string, chromStart long, strand string, observed string, clazz string")
    assert [(x.mismatches, x.known) for x in V.mismatches_but_known(r, snp).collect()] == [(0, 1)]
    assert V.filter_known_mismatches(r, 0, snp).first().tags["ZS"].v == "1"


def test_counts(spark):
    r = make(spark, [("a", 16, "c", 10, "10M", "A" * 10, {"IH": 2}), ("b", 16, "c", 10, "10M", "A" * 10, {}), ("d", 16, "c", 15, "5M40N5M", "A" * 10, {}), ("e", 0, "c", 15, "5M", "A" * 5, {})])
    m = spark.createDataFrame([(1, "c", 0, 30, "+"), (1, "c", 55, 70, "+"), (2, "c", 100, 200, "+")], "region long, chrom string, start long, end long, strand string")
    got = lambda **k: {x.region: x["count"] for x in N.region_counts(r, m, **k).collect()}
    assert got() == {1: 1.0, 2: 0.0}
    assert got(stranded=False) == {1: 4.0, 2: 0.0}
    assert got(stranded=False, multiple="partial") == {1: 3.5, 2: 0.0} and got(stranded=False, multiple="ignore") == {1: 3.0, 2: 0.0}
    assert got(stranded=False, uniq=True) == {1: 3.0, 2: 0.0}
    x = N.region_counts(r, m, stranded=False, norm="all", fpkm=True).where("region = 1").first()
    assert x.cpm == pytest.approx(4 / (4 / 1e6)) and x.rpkm == pytest.approx(4 / 0.045 / (4 / 1e6))
    ex = spark.createDataFrame([("g", 1, "c", 0, 25, "+", True), ("g", 2, "c", 30, 40, "+", False)], "gid string, i int, chrom string, start long, end long, strand string, const boolean")
    got = {x.i: (x.inclusion, x.exclusion) for x in N.exon_inclusion(r.withColumn("flag", F.lit(0)), ex.withColumn("strand", F.lit("+")), library="FR").collect()}
    assert got == {1: (4, 0), 2: (0, 1)}


def test_stats(spark):
    r = make(spark, [("a", 0, "c", 10, "10M", "A" * 10, {"IH": 2}), ("a", 0, "c", 90, "10M", "A" * 10, {"IH": 2}), ("b", 4, None, -1, "*", "A" * 10, {})])
    s = A.read_stats(r).first()
    assert (s.total, s.mapped, s.unmapped, s.flag_4) == (2, 1, 1, 1)
    d = make(spark, [("a", 0, "c", 1, "1M", "A", {"NM": 1}), ("b", 0, "c", 1, "1M", "A", {"NM": 3})])
    assert [(x.value, x.n, x.pct) for x in A.tag_distribution(d, "NM").orderBy("value").collect()] == [(1, 1, 50.0), (2, 0, 50.0), (3, 1, 100.0)]
    assert G.LABELS[4] == "Unmapped"


def test_conversion_without_a_check_and_checked_only(spark):
    from strandspark.schemas import READS

    row = lambda name, pos, cigar: {"qname": name, "flag": 0, "chrom": "chr1:100-110,200-300", "pos": pos, "mapq": 1, "cigar": cigar, "rnext": None, "pnext": -1, "tlen": 0, "seq": "A", "qual": "I", "tags": {}, "idx": pos}
    reads = spark.createDataFrame([row("a", 8, "20M"), row("b", 2, "20M")], READS)
    place = lambda df: [(r.qname, r.chrom, r.pos, r.cigar, sorted(r.tags)) for r in df.orderBy("qname").collect()]
    assert place(A.convert_regions(reads, overlap=0)) == [("a", "chr1", 108, "2M90N18M", []), ("b", "chr1", 102, "8M90N12M", [])]
    assert place(A.convert_regions(reads, validate_only=True, keep_unmapped=False)) == [("b", "chr1:100-110,200-300", 2, "20M", ["HI", "IH", "NH"])]
    sizes = spark.createDataFrame([("chr1", 1000)], "chrom string, length long")
    assert place(A.convert_regions(reads, sizes=sizes, keep_unmapped=False))[0][:2] == ("b", "chr1")
    with pytest.raises(Exception, match="no such chromosome"):
        A.convert_regions(reads, sizes=sizes.where("length > 1000")).collect()


def test_report_with_classes(spark):
    from strandspark.schemas import READS

    row = lambda i, chrom, pos, cigar, flag=0: {"qname": f"r{i}", "flag": flag, "chrom": chrom, "pos": pos, "mapq": 1, "cigar": cigar, "rnext": None, "pnext": -1, "tlen": 0, "seq": "ACGT", "qual": "IIII", "tags": {}, "idx": i}
    reads = spark.createDataFrame([row(0, "c.1", 5, "4M"), row(1, "c.1", 5, "4M", 16), row(2, "c.1", 500, "4M"), row(3, "c.2", 0, "2M5N2M"), row(4, None, -1, "*", 4), row(5, "c.1", 5, "4M", 129)], READS)
    ranges = spark.createDataFrame([("c.1", 0, 10, "+", 0)], "chrom string, start long, end long, strand string, rank int")
    got = {(r.section, r.key): r.n for r in A.report(reads, ranges, delimiter=".", tags=("LENGTH",)).collect()}
    assert {k: v for k, v in got.items() if k[0] != "flag"} == {
        ("reads", "total"): 5, ("reads", "mapped"): 4, ("reads", "unmapped"): 1, ("reference", "c"): 4, ("LENGTH", "4"): 4, ("class", "coding"): 1, ("class", "coding-rev"): 1, ("class", "intergenic"): 1, ("class", "junction"): 1,
    }
    assert got["flag", "16"] == 1 and got["flag", "4"] == 1 and ("flag", "1") not in got
    every = {(r.section, r.key): r.n for r in A.report(reads, ranges, first_only=False).collect()}
    assert every["reads", "total"] == 6 and every["class", "coding"] == 1


def test_median_of_counts(spark):
    from strandspark.functions.stats import median_of_counts

    df = spark.createDataFrame([("a", 1, 4), ("a", 2, 1), ("a", 3, 4), ("b", 1, 4), ("b", 4, 4), ("c", 5, 0), ("d", 0, 1), ("d", 3, 1)], "k string, value long, n long")
    assert {r.k: r.median for r in median_of_counts(df, ["k"]).collect()} == {"a": 2, "b": 2, "c": 0, "d": 1}

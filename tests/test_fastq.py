import random

import pytest

from strandspark.operators import fastq as Q
from strandspark.schemas import FASTQ


def make(spark, rows):
    return spark.createDataFrame([(i, n, c, s, q) for i, (n, c, s, q) in enumerate(rows)], FASTQ)


def test_filters(spark):
    r = make(spark, [("a", "", "ACGTACGTAC", "IIIII#####"), ("b", "x", "ACGTNNNTAC", "IIIIIIIIII"), ("c", "", "ACG", "III")])
    assert [x.name for x in Q.filter_wildcards(r, 2).orderBy("idx").collect()] == ["a", "c"]
    assert [x.name for x in Q.filter_size(r, 4).orderBy("idx").collect()] == ["a", "b"]
    cut = Q.filter_quality_window(r, 30, 2).orderBy("idx").collect()
    assert [(x.seq, x.comment) for x in cut] == [("ACGTA", " #qual"), ("ACGTNNNTAC", "x"), ("ACG", "")]
    assert [(x.seq, x.qual) for x in Q.filter_suffix_quality(r, "#").orderBy("idx").collect()][0] == ("ACGTA", "IIIII")
    assert Q.filter_truncate(r, 3).orderBy("idx").first().comment == " #trunc"
    assert [x.seq for x in Q.filter_prefix(r, 8).orderBy("idx").collect()] == ["AC", "AC", "ACG"]


def test_colour_space_prefix(spark):
    r = make(spark, [("a", "", "T0123", "IIII")])
    assert Q.filter_truncate(r, 2).first().seq == "T01" and Q.truncate(r, 2).first().seq == "T01"
    assert Q.encode_colours(r).first().seq == "CGT"
    with pytest.raises(Exception):
        Q.filter_prefix(r, 1).collect()


def test_adapter(spark):
    r = make(spark, [("a", "", "TTTTTTACGT", "I" * 10), ("b", "", "TTTTTTTTTT", "I" * 10), ("c", "", "ACGTAC", "I" * 6), ("d", "", "GGGGACNT", "I" * 8)])
    got = {x.name: x.seq for x in Q.filter_adapter(r, "ACGTACGT", 1.0, 4).collect()}
    assert got == {"a": "TTTTTT", "b": "TTTTTTTTTT", "d": "GGGGACNT"}
    assert {x.name: x.seq for x in Q.filter_adapter(r, "ACNTACGT", 1.0, 4).collect()}["d"] == "GGGG"


def test_pairs(spark):
    r = make(spark, [(n, "", "A", "I") for n in ("p", "p", "q", "r", "r", "r")])
    assert [x.idx for x in Q.filter_pairs(r).orderBy("idx").collect()] == [0, 1, 3, 4]
    assert [x.part for x in Q.split_round_robin(r, 2).orderBy("idx").collect()] == [0, 0, 1, 0, 0, 0]
    assert [x.part for x in Q.unmerge(r).orderBy("idx").collect()] == [0, 1, 0, 0, 1, 2]
    assert [x.run for x in Q._runs(r, tile=2).orderBy("idx").collect()] == [1, 1, 2, 3, 3, 3]
    assert Q.pair_count(r).first().n == 2
    pairs, counts = Q.proper_pairs(r.where("idx in (0, 2)"), r.where("idx in (1, 3)"))
    assert pairs.count() == 1 and tuple(counts.first()) == (1, 1, 1)


def test_merge_checks_names(spark):
    a, b = make(spark, [("x/1", "", "A", "I")]), make(spark, [("x/2", "", "C", "I")])
    assert Q.merge([a, b], slash=True).count() == 2
    with pytest.raises(Exception):
        Q.merge([a, b]).collect()


def test_tiles(spark):
    r = make(spark, [("a", "", "ACGTACGTAC", "I" * 10)])
    assert [(x.part, x.seq) for x in Q.tiles(r, 4, 3).orderBy("part").collect()] == [(0, "ACGT"), (1, "TACG")]


def test_scales(spark):
    assert Q.quality_scale(make(spark, [("a", "", "AC", "!I")])).first().scale == "Sanger"
    assert Q.quality_scale(make(spark, [("a", "", "AC", "hf")])).first().scale == "Illumina"
    assert Q.quality_scale(make(spark, [("a", "", "AC", "<h")])).first().scale == "Solexa"
    assert Q.quality_scale(make(spark, [("a", "", "AC", "!h")])).first().scale == "Unknown"
    assert Q.is_colorspace(make(spark, [("a", "", "T0120", "III")])).first().colorspace
    assert not Q.is_colorspace(make(spark, [("a", "", "TACG", "IIII")])).first().colorspace


def test_summaries(spark):
    s = Q.quality_stats(make(spark, [("a", "", "AC", "!+"), ("b", "", "AC", "++"), ("c", "", "A", "I")]))
    got = {x.position: x for x in s.collect()}
    assert (got[1].min, got[1].median, got[1].max, got[1].total) == (0, 10, 40, 3)
    assert got[1].mean == pytest.approx(50 / 3) and got[2].stdev == 0.0


def test_alignment(spark):
    assert Q._aligned(["TTACGTTT"], "ACGT").tolist() == [[8, 2, 6, 0, 4, 4]]
    r = make(spark, [("a", "", "ACGTGGGGGGGGGGCCCC", "I" * 18), ("b", "", "GGGG", "IIII")])
    got = {x.name: x.seq for x in Q.trim_linkers(r, five="ACGT", three="CCCC", min_len=5).collect()}
    assert got == {"a": "GGGGGGGGGG"}
    tags = {x.name: (x.tag, x.seq) for x in Q.split_barcodes(r, [("one", "ACGA", "5", True)], edits=1).collect()}
    assert tags["a"][0] == "one" and tags["b"] == ("missing", "GGGG")
    tags = {x.name: (x.tag, x.seq) for x in Q.split_barcodes(r, [("rc", "GGGGC", "5", True)], allow_revcomp=True).collect()}
    assert tags["a"][0] == "rc"


def test_conversions(spark):
    r = make(spark, [("a", "c", "ACGN", "!+5I")])
    assert Q.to_fasta(r, True).first().seq == "0 10 20 40"
    back = Q.from_fasta(Q.to_fasta(r), Q.to_fasta(r, True)).first()
    assert (back.seq, back.qual) == ("ACGN", "!+5I")
    assert Q.names(r, True).first().name == "a c"
    assert [x.flag for x in Q.to_reads(r, r).orderBy("idx").collect()] == [77, 141]
    q = spark.createDataFrame([("m", "1", "2", "3", "4", "5", "0", "1", "AC.T", "hhBB", "1"), ("m", "1", "2", "3", "4", "6", "0", "1", "ACGT", "BBBB", "1"), ("m", "1", "2", "3", "4", "7", "0", "1", "ACGT", "hhhh", "0")], "machine string, run string, lane string, tile string, x string, y string, index string, read string, seq string, qual string, qc string")
    assert [(x.name, x.seq, x.qual) for x in Q.from_qseq(q, trim=True).collect()] == [("m_1:2:3:4:5/1", "AC", "II")]
    assert Q.from_qseq(q).count() == 2
    out, seen = Q.filter_chain(r, lambda d: Q.filter_size(d, 1), lambda d: Q.filter_truncate(d, 2))
    out.collect()
    assert seen[1].get == {"kept": 1, "altered": 1}


def cell_by_cell(ref, query, match=2, mismatch=-1, gap=-1):
    """The matrix of one read, each cell with where its path began."""
    score = {(i, j): (0, i, j, 0) for i in range(len(ref) + 1) for j in range(len(query) + 1)}
    best = (0, 0, 0, 0, 0, 0)
    for i in range(1, len(ref) + 1):
        score[i, 0] = (0, i, 0, 0)
        for j in range(1, len(query) + 1):
            d, u, l = score[i - 1, j - 1], score[i - 1, j], score[i, j - 1]
            same = ref[i - 1] == query[j - 1]
            begun = d if d[0] else (0, i - 1, j - 1, 0)
            paths = [(d[0] + (match if same else mismatch), begun[1], begun[2], begun[3] + same)] + [(x[0] + gap, *x[1:]) for x in (u, l)]
            here = max(paths, key=lambda x: x[0])
            score[i, j] = here if here[0] > 0 else (0, i, j, 0)
            if here[0] > best[0]:
                best = (here[0], here[1], i, here[2], j, here[3])
    return best


def test_alignments_of_many_reads():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ACGTN") for _ in range(rng.randrange(0, 15))) for _ in range(400)]
    for query in ("ACGT", "TTGACA", "A"):
        score = cell_by_cell
        want = [score(t, query) for t in texts]
        assert [tuple(r) for r in Q._aligned(texts, query).tolist()] == want

from pyspark.sql import functions as F

from strandspark.operators import genes as M
from strandspark.operators.pileup import chunked_reference
from strandspark.schemas import GTF


def rows(spark, items):
    """feature, start, end, gene, transcript and, if given, strand."""
    out = []
    for i, (f, s, e, g, t, *more) in enumerate(items):
        attrs = {"gene_id": g, "gene_name": g, "transcript_id": t}
        out.append(("chr1", "x", f, s, e, ".", more[0] if more else "+", ".", attrs, "; ".join(f'{k} "{v}"' for k, v in attrs.items()) + ";", i))
    return spark.createDataFrame(out, GTF)


def three(spark, baz=((100, 110), (150, 160), (175, 200)), strand="+"):
    t = {"foo": ((100, 110), (125, 135), (150, 160), (175, 200)), "bar": ((100, 110), (125, 135), (175, 200)), "baz": baz}
    return M.transcripts(rows(spark, [("exon", s, e, "g", n, strand) for n, ex in t.items() for s, e in ex]))


def table(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_regions(spark):
    got = table(M.regions(three(spark)), "i", "start", "end", "const", F.array_join("names", ","))
    assert got == [(1, 100, 110, True, "bar,baz,foo"), (2, 125, 135, False, "bar,foo"), (3, 150, 160, False, "baz,foo"), (4, 175, 200, True, "bar,baz,foo")]
    got = table(M.regions(three(spark, ((100, 120), (150, 160), (170, 200)))), "start", "end", "const", F.array_join("names", ","))
    assert got == [(100, 110, True, "bar,baz,foo"), (110, 120, False, "baz"), (125, 135, False, "bar,foo"), (150, 160, False, "baz,foo"), (170, 175, False, "baz"), (175, 200, True, "bar,baz,foo")]


def test_beds(spark):
    tx = three(spark)
    assert table(M.bed_tss(tx), "start", "end", "name") == [(100, 103, "g/0")] and table(M.bed_txs(tx), "start", "end") == [(197, 200)]
    assert table(M.bed_introns(tx), "start", "end", "name")[0] == (110, 125, "g/i1")
    assert table(M.bed_donors(tx), "start", "name") == [(110, "g/0"), (135, "g/0"), (160, "g/0")]
    assert table(M.bed_donors(three(spark, strand="-")), "start", "end") == [(124, 125), (149, 150), (174, 175)]
    assert table(M.bed_promoters(three(spark, strand="-"), 50, 5), "start", "end") == [(195, 250)]
    assert table(M.bed_exons(tx), "name")[-1] == ("g/e4",)


def test_coding(spark):
    items = [("exon", 100, 200, "g", "t"), ("exon", 300, 400, "g", "t"), ("CDS", 150, 200, "g", "t"), ("CDS", 300, 350, "g", "t")]
    tx = M.transcripts(rows(spark, items))
    assert table(M.gene_sizes(tx), "genomic", "transcript", "intron", "coding", "utr5", "utr3") == [(300, 200, 100, 100, 50, 50)]
    assert table(M.bed_translation_starts(tx), "start", "end") == [(150, 153)] and table(M.bed_utr3(tx), "start", "end") == [(351, 400)]
    minus = M.transcripts(rows(spark, [(*i, "-") for i in items]))
    assert table(M.bed_translation_starts(minus), "start", "end") == [(347, 350)] and table(M.bed_utr5(minus), "start", "end") == [(351, 400)]
    points = spark.createDataFrame([("chr1", p, "+") for p in (50, 120, 160, 250, 380, 5000)], "chrom string, pos long, strand string")
    assert [r.locations for r in M.annotate(points, tx).orderBy("pos").collect()] == ["intergenic", "5'UTR", "coding", "intron", "3'UTR", "intergenic"]
    tags = [r.tag for r in M.classify(points, M.class_ranges(tx)).orderBy("pos").collect()]
    assert tags == ["promoter", "utr-5", "coding", "intron", "utr-3", "intergenic"]
    assert M.classify(points.limit(1).withColumn("strand", F.lit("-")), M.class_ranges(tx)).first().tag == "promoter-rev"


def test_same_name_on_two_chromosomes(spark):
    g = rows(spark, [("exon", 1, 9, "g", "t"), ("exon", 5, 9, "g", "u")]).withColumn("chrom", F.when(F.col("idx") == 1, "chr2").otherwise("chr1"))
    assert M.genes(M.transcripts(g)).count() == 2
    assert M.find_genes(M.transcripts(g), "chr2", 9).count() == 1 and M.by_name(M.transcripts(g), "g").count() == 2


def test_enrichment(spark):
    g = rows(spark, [("exon", 1, 9, "g", "t"), ("exon", 1, 9, "g", "u_dup1")])
    iso = spark.createDataFrame([("i1", "t", 0), ("i2", "t", 1)], "isoform string, transcript string, idx long")
    got = M.add_isoform(g, iso).orderBy("idx").collect()
    assert got[0].attrs["isoform_id"] == "i2" and got[0].attributes.endswith('; isoform_id "i2";') and "isoform_id" not in got[1].attrs
    assert M.remove_duplicates(g).count() == 1
    assert M.to_ensembl(g).first().chrom == "1" and M.to_ucsc(M.to_ensembl(g)).first().chrom == "chr1" and M.to_ucsc(g).count() == 0


def test_gff(spark):
    items = [("CDS", {"Parent": "r1"}), ("exon", {"Parent": "r1,r2"}), ("mRNA", {"ID": "r1", "Parent": "g1"}), ("mRNA", {"ID": "r2", "Parent": "g1"}), ("gene", {"ID": "g1", "Name": "N"}), ("exon", {"Parent": "lost"})]
    g = spark.createDataFrame([("c", "x", f, 0, 9, ".", "+", ".", a, "", i) for i, (f, a) in enumerate(items)], GTF)
    good, bad = M.from_gff(g)
    assert table(good, "idx", F.col("attrs")["transcript_id"]) == [(0, "r1"), (1, "r1"), (1, "r2")] and bad.count() == 1
    assert good.first().attrs["gene_name"] == "N"


def test_junctions(spark):
    ref = chunked_reference(spark.createDataFrame([("chr1", "AAAAAAAAAACCCCCCCCCCGGGGGGGGGGTTTTTTTTTT")], "name string, seq string"), 7)
    tx = M.transcripts(rows(spark, [("exon", 0, 10, "g", "t"), ("exon", 20, 30, "g", "t"), ("exon", 35, 40, "g", "t")]))
    got = {r.name: r.seq for r in M.junctions(tx, ref, 4, 8, chunk=7).collect()}
    assert got == {"chr1:6-10,20-24": "AAAAGGGG", "chr1:26-30,35-39": "GGGGTTTT", "chr1:6-10,35-39": "AAAATTTT"}
    assert set(r.name for r in M.junctions(tx, ref, 4, 8, known=True, chunk=7).collect()) == {"chr1:6-10,20-24", "chr1:26-30,35-39"}


def test_primers(spark):
    from strandspark.operators.bed import primer_sites

    seq = "T" * 20 + "ACGTACGTACGTAA" + "C" * 30 + "GGATTACAGGATTACA" + "T" * 20
    ref = chunked_reference(spark.createDataFrame([("c", seq)], "name string, seq string"), 64)
    p = spark.createDataFrame([("a", "ACGTACGTACGTAA", "TGTAATCCTGTAATCC"), ("b", "ACGTACGTACGTTT", "TGTAATCCTGTAATCC")], "name string, fwd string, rev string")
    assert table(primer_sites(p, ref, 200, 64), "chrom", "start", "end", "name", "strand") == [("c", 20, 80, "a", "+")]


def test_junction_chains(spark):
    """Short exons are passed on to each exon further on, until a junction is long enough."""
    ref = chunked_reference(spark.createDataFrame([("chr1", "".join("ACGT"[i * i % 7 % 4] for i in range(300)))], "name string, seq string"), 64)
    spans = lambda *exons, **kw: {r.name.partition(":")[2] for r in M.junctions(M.transcripts(rows(spark, [("exon", s, e, "g", "t") for s, e in exons])), ref, chunk=64, **kw).collect()}
    assert spans((29, 40), (49, 70), (79, 82), (89, 100), fragment=4, min_size=8) == {"36-40,49-53", "36-40,79-82,89-93", "36-40,89-93", "66-70,79-82,89-93", "66-70,89-93"}
    # an exon of ten bases, then long ones: every exon after what is too short follows
    assert spans((0, 10), (100, 140), (200, 260), fragment=30, min_size=50) == {"0-10,100-130,200-230", "110-140,200-230"}
    exons, want = [(0, 10), (20, 25), (30, 34), (40, 43), (50, 60), (70, 72)], set()

    def go(parts, k):
        for j in range(k, len(exons)):
            new = [*parts, (exons[j][0], min(exons[j][1], exons[j][0] + 10))]
            if sum(e - s for s, e in new) >= 25:
                want.add(",".join(f"{s}-{e}" for s, e in new))
            elif len(new) < 4:
                go(new, j + 1)

    for k, (s, e) in enumerate(exons):
        go([(max(s, e - 10), e)], k + 1)
    assert len(want) > 2 and spans(*exons, fragment=10, min_size=25, max_exons=4) == want
    assert spans((0, 20), (100, 120), fragment=5, min_size=8, scramble=True) == {"15-20,100-105", "115-120,0-5", "15-20,0-5", "115-120,100-105"}
    assert spans((0, 20), (100, 120), fragment=5, min_size=8, retain_introns=True) == {"15-20,100-105", "15-20,20-25", "115-120,120-125", "95-100,100-105"}
    assert spans((0, 20), (15, 40), (100, 120), fragment=5, min_size=8, known=True) == {"35-40,100-105"}


def test_region_order_and_counts(spark):
    g = spark.createDataFrame([("c", 25_000, 1), ("c", 5, 9), ("c", 9_999, 2), ("b", 70_000, 0), ("c", 20_001, 0)], "chrom string, start long, first long")
    assert [(r.chrom, r.start) for r in M.in_region_order(g).collect()] == [("b", 70_000), ("c", 9_999), ("c", 5), ("c", 20_001), ("c", 25_000)]

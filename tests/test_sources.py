import gzip

import pytest
from pyspark.sql import functions as F

from strandspark.sources import bam, sinks, text
from strandspark.streaming import event_windows, start, stream_table

SAM = "@HD\tVN:1.4\n@SQ\tSN:c1\tLN:100\n@SQ\tSN:c2\tLN:50\nr1\t0\tc1\t11\t30\t4M\t*\t0\t0\tACGT\tIIII\tAS:i:7\tZZ:Z:a:b\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*\n"


def put(tmp_path, name, content):
    p = tmp_path / name
    p.write_bytes(gzip.compress(content.encode()) if name.endswith(".gz") else content.encode())
    return str(p)


def test_bed(spark, tmp_path):
    p = put(tmp_path, "a.bed", "# x\nc1\t5\t9\n\nc2\t1\t4\tn\t3\t-\t1\t2\t0,0,0\te1\te2\n")
    got = text.read_bed(spark, p).orderBy("idx").collect()
    assert (got[0].chrom, got[0].start, got[0].end, got[0].score, got[0].strand) == ("c1", 5, 9, 0.0, None)
    assert got[1].extras == ["e1", "e2"] and got[1].strand == "-"
    assert [r.value for r in sinks.bed_lines(text.read_bed(spark, p).orderBy("idx")).collect()][1] == "c2\t1\t4\tn\t3\t-\t1\t2\t0,0,0"
    with pytest.raises(Exception):
        text.read_bed(spark, put(tmp_path, "b.bed", "c1\tx\t9\n")).collect()
    assert tuple(text.region_literal(spark, "c1:11-20").first())[:3] == ("c1", 10, 20)


@pytest.mark.parametrize("name", ["a.fastq", "a.fastq.gz"])
def test_fastq(spark, tmp_path, name):
    body = "@a one\nACGT\n+\n@III\n@b\nAC\n+b\nI@\n"
    df = text.read_fastq(spark, put(tmp_path, name, body))
    assert [(r.name, r.comment, r.seq, r.qual) for r in df.orderBy("idx").collect()] == [("a", "one", "ACGT", "@III"), ("b", "", "AC", "I@")]
    assert "\n".join(r.value for r in sinks.fastq_lines(df.orderBy("idx")).collect()) == "@a one\nACGT\n+\n@III\n@b\nAC\n+\nI@"


def test_fastq_in_many_blocks(spark, tmp_path):
    p = put(tmp_path, "m.fastq", "".join(f"@n{i}\n{'ACGT' * (i % 5 + 1)}\n+\n{'@III' * (i % 5 + 1)}\n" for i in range(500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = text.read_fastq(spark, p).orderBy("idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert [r.name for r in got] == [f"n{i}" for i in range(500)] and all(len(r.seq) == len(r.qual) for r in got)


def test_fasta(spark, tmp_path):
    p = put(tmp_path, "a.fa", ">x first\nACGT\nAC\n>empty\n>y\n#c\nTT\n")
    assert [(r.name, r.comment, r.seq) for r in text.read_fasta(spark, p).orderBy("idx").collect()] == [("x", "first", "ACGTAC"), ("y", "", "TT")]
    assert text.read_fasta(spark, put(tmp_path, "q.fa", ">x\n1 2\n3\n"), qual=True).first().seq == "1 2 3"
    assert text.is_fasta(spark, p) and not text.is_fasta(spark, put(tmp_path, "f.fq", "@a\nA\n+\nI\n"))
    with pytest.raises(ValueError):
        text.is_fasta(spark, put(tmp_path, "n.fq", "nothing\n"))


def test_sam_and_bam(spark, tmp_path):
    p = put(tmp_path, "a.sam", SAM)
    df = text.read_sam(spark, p)
    got = df.orderBy("idx").collect()
    assert (got[0].pos, got[0].tags["ZZ"].v, got[1].chrom, got[1].pos) == (10, "a:b", None, -1)
    assert [(r.chrom, r.length, r.tid) for r in text.read_sam_header(spark, p).collect()] == [("c1", 100, 0), ("c2", 50, 1)]
    assert [r.value for r in sinks.sam_lines(df.orderBy("idx")).collect()] == SAM.splitlines()[3:]
    data = bam.encode([("c1", 100), ("c2", 50)], [r.asDict(recursive=True) for r in got])
    (tmp_path / "a.bam").write_bytes(data)
    back = bam.read_bam(spark, str(tmp_path / "a.bam")).orderBy("idx").collect()
    assert [(r.qname, r.flag, r.chrom, r.pos, r.cigar, r.seq, r.qual) for r in back] == [(r.qname, r.flag, r.chrom, r.pos, r.cigar, r.seq, r.qual) for r in got]
    assert back[0].tags["AS"].v == "7" and len(bam.block_table(data)) == 2
    assert bam.check(spark, p) == (True, "2") and bam.check(spark, str(tmp_path / "a.bam"), "bam") == (True, "2")
    (tmp_path / "bad.bam").write_bytes(data[:40])
    assert not bam.check(spark, str(tmp_path / "bad.bam"), "bam")[0]


def test_gtf(spark, tmp_path):
    p = put(tmp_path, "a.gtf", 'c1\tx\texon\t11\t20\t.\t+\t.\tgene_id "g;1"; transcript_id "t"; # note\n')
    r = text.read_gtf(spark, p).first()
    assert (r.start, r.end, r.attrs) == (10, 20, {"gene_id": "g;1", "transcript_id": "t"})
    assert sinks.gtf_lines(text.read_gtf(spark, p)).first().value.startswith('c1\tx\texon\t11\t20\t.\t+\t.\tgene_id "g;1"')
    g = text.read_gff(spark, put(tmp_path, "a.gff", "c\tx\tgene\t1\t9\t.\t+\t.\tID=g1;Name=N\n##FASTA\n>c\nc\tx\tgene\t1\t9\t.\t+\t.\tID=g2\n")).collect()
    assert [r.attrs for r in g] == [{"ID": "g1", "Name": "N"}]


def test_tables(spark, tmp_path):
    v = text.read_vcf(spark, put(tmp_path, "a.vcf", "##x\n#CHROM\nc\t10\t.\tAC\tG\t50\tPASS\t.\n")).first()
    assert (v.pos, v.ref, v.alt) == (10, "AC", "G")
    r = text.read_repeats(spark, put(tmp_path, "a.out", "SW perc\nscore div\n\n 1 2 3 4 chr1 11 20 (5) C AluY SINE/Alu 1 2\n")).first()
    assert (r.start, r.end, r.strand, r.member, r.family) == (10, 20, "-", "AluY", "SINE/Alu")
    assert text.read_base_calls(spark, put(tmp_path, "a.txt", "chrom\tpos\nc\t5\n")).first().pos == 5
    assert text.read_names(spark, put(tmp_path, "n.txt", "a x\n\nb\n")).count() == 2
    assert text.read_qseq(spark, put(tmp_path, "q.txt", "\t".join("m123456 1 2 3 4 5 0 1 AC hh 1".split()) + "\n")).first().seq == "AC"
    assert text.read_dbsnp(spark, put(tmp_path, "d.txt", "\t".join(["1", "c", "5", "6"] + ["x"] * 8) + "\nshort\n")).first().chromStart == 5
    assert text.read_sizes(spark, put(tmp_path, "s.txt", "c1\t100\n")).first().length == 100
    assert text.sample_labels(["/a/s1.sorted.bam", "/a/s2.sorted.bam"]) == ["s1", "s2"]


def test_parts(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, "a"), (1, 1, "b"), (2, 0, "c")], "idx long, part int, name string")
    sinks.write_parts(df, str(tmp_path / "out"), F.col("name"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out/part=0")).collect()] == ["a", "c"]
    g = spark.createDataFrame([("c", 1, 3, 5)], "chrom string, start long, end long, depth long")
    assert [r.value for r in sinks.wiggle_lines(g).collect()] == ["variableStep chrom=c", "1 5", "2 5", "3 5"]


def test_streams(spark, tmp_path):
    from strandspark.operators.bed import extend

    src = spark.createDataFrame([("c", 100, 200, "+")], "chrom string, start long, end long, strand string")
    src.write.parquet(str(tmp_path / "in"))
    q = start(stream_table(spark, str(tmp_path / "in"), src.schema), lambda d: extend(d, 10), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().start == 90
    ev = spark.createDataFrame([("2024-01-01 00:01:00", "x", 1.0), ("2024-01-01 00:02:00", "x", 2.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert [(r.n, r.total) for r in event_windows(ev).collect()] == [(2, 3.0)]

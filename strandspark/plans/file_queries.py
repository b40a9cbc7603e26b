"""Readers and writers: views are written as files of a format to the shared folder and read back."""

from pyspark.sql import functions as F

from ..functions import flags as G
from ..functions import sequence as S
from ..functions.stats import median_of_counts
from ..operators import align as A
from ..operators import bed as B
from ..operators import count as N
from ..operators import genes as M
from ..sources import bam, sinks, text
from ..sources.scratch import scratch_path
from .read_queries import MAPPED, SPAN
from .registry import query
from .views import bed, cte, fastq, gtf, reads, transcripts

IV, FQ, RD, GX, RG = cte("iv"), cte("fq"), cte("rd"), cte("gx"), cte("rg")


def written(spark, lines, name: str, ending: str = "", **options) -> str:
    path = scratch_path(spark, name) + ending
    lines.write.options(**options).text(path)
    return path


def table(spark, sf, name: str):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("file_bed", IV + ' SELECT chrom, s AS "start", e AS "end", name, score, strand FROM iv')
def file_bed(spark, sf):
    path = written(spark, sinks.bed_lines(bed(spark, sf)), "bed")
    return text.read_bed(spark, path).select("chrom", "start", "end", "name", "score", "strand")


@query("file_bed_gz", IV + ' SELECT chrom, s AS "start", e AS "end", name, score, strand FROM iv')
def file_bed_gz(spark, sf):
    path = written(spark, sinks.bed_lines(bed(spark, sf)), "bed", compression="gzip")
    return text.read_bed(spark, path).select("chrom", "start", "end", "name", "score", "strand")


@query("file_bgz", IV + ' SELECT chrom, s AS "start", e AS "end", name, score, strand FROM iv')
def file_bgz(spark, sf):
    """Block-compressed lines, which are read in splits."""
    path = scratch_path(spark, "bed") + ".bgz"
    bam.write_bgz(sinks.bed_lines(bed(spark, sf)), path)
    return text.read_bed(spark, path).select("chrom", "start", "end", "name", "score", "strand")


@query("file_fastq", FQ + " SELECT name, comment, seq, qual FROM fq")
def file_fastq(spark, sf):
    path = written(spark, sinks.fastq_lines(fastq(spark, sf)), "fastq")
    return text.read_fastq(spark, path).select("name", "comment", "seq", "qual")


@query("file_fasta", "SELECT 's'||CAST(p_partkey AS STRING) AS name, p_brand AS comment, repeat(md5(p_name), 3) AS seq FROM part")
def file_fasta(spark, sf):
    p = table(spark, sf, "part").select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_brand").alias("comment"), S.wrapped(F.repeat(F.md5("p_name"), 3)).alias("seq"))
    return text.read_fasta(spark, written(spark, sinks.fasta_lines(p), "fasta")).select("name", "comment", "seq")


_READ = RD + " SELECT qname, flag, chrom, pos, mapq, cigar, tlen, seq, qual, CAST(t_as AS STRING) AS t_as, CAST(t_nm AS STRING) AS t_nm, CAST(t_ih AS STRING) AS t_ih FROM rd"


def _read(df):
    return df.select("qname", "flag", "chrom", "pos", "mapq", "cigar", "tlen", "seq", "qual", *[G.tag(t).alias(f"t_{t.lower()}") for t in ("AS", "NM", "IH")])


@query("file_sam", _READ)
def file_sam(spark, sf):
    return _read(text.read_sam(spark, written(spark, sinks.sam_lines(reads(spark, sf)), "sam")))


#: References as a file names them that has numbers alone.
REFERENCES = [(str(k), 1_000_500) for k in range(1, 6)]


def _bam(spark, sf) -> str:
    path = scratch_path(spark, "bam")
    bam.write_bam(reads(spark, sf).withColumn("chrom", F.substring("chrom", 4, 9)), path, REFERENCES)
    return path


@query("file_bam", _READ.replace("flag, chrom, pos", "flag, substr(chrom, 4) AS chrom, pos"))
def file_bam(spark, sf):
    return _read(bam.read_bam(spark, _bam(spark, sf)))


@query("file_bam_fetch", RD + f" SELECT qname, flag, pos, cigar FROM rd WHERE chrom='chr2' AND pos < 300000 AND pos + greatest({SPAN}, 1) > 200000")
def file_bam_fetch(spark, sf):
    """A region of chr2, which the file has as 2."""
    return bam.read_bam(spark, _bam(spark, sf), "chr2:200001-300000").select("qname", "flag", "pos", "cigar")


@query("file_bam_references", "SELECT CAST(k AS STRING) AS chrom, CAST(1000500 AS BIGINT) AS length, CAST(k - 1 AS INT) AS tid FROM (VALUES (1), (2), (3), (4), (5)) v(k)")
def file_bam_references(spark, sf):
    return bam.read_bam_references(spark, _bam(spark, sf))


@query("file_gtf", GX + ' SELECT chrom, feature, s AS "start", e AS "end", strand, gid AS gene_id, tid AS transcript_id FROM gx')
def file_gtf(spark, sf):
    got = text.read_gtf(spark, written(spark, sinks.gtf_lines(gtf(spark, sf)), "gtf"))
    return got.select("chrom", "feature", "start", "end", "strand", F.element_at("attrs", "gene_id").alias("gene_id"), F.element_at("attrs", "transcript_id").alias("transcript_id"))


@query("file_gff", GX + ' SELECT chrom, feature, s AS "start", e AS "end", gid AS id, tid AS parent FROM gx')
def file_gff(spark, sf):
    g = gtf(spark, sf).withColumn("attributes", F.concat(F.lit("ID="), F.element_at("attrs", "gene_id"), F.lit(";Parent="), F.element_at("attrs", "transcript_id")))
    return text.read_gff(spark, written(spark, sinks.gtf_lines(g), "gff")).select("chrom", "feature", "start", "end", F.element_at("attrs", "ID").alias("id"), F.element_at("attrs", "Parent").alias("parent"))


def _lines(df, *cols, sep="\t"):
    return df.select(F.concat_ws(sep, *[F.lit(c) if isinstance(c, str) else c.cast("string") for c in cols]).alias("value"))


@query("file_vcf", "SELECT 'chr'||CAST(p_size AS STRING) AS chrom, p_partkey AS pos, p_brand AS id, p_type AS ref, 'ACG' AS alt, CAST(p_size AS STRING) AS qual, 'PASS' AS filter, 'N='||CAST(p_size AS STRING) AS info FROM part")
def file_vcf(spark, sf):
    p, c = table(spark, sf, "part"), F.col
    rows = _lines(p, F.concat(F.lit("chr"), c("p_size").cast("string")), c("p_partkey"), c("p_brand"), c("p_type"), "ACG", c("p_size"), "PASS", F.concat(F.lit("N="), c("p_size").cast("string")))
    head = spark.range(1).select(F.lit("##fileformat=VCFv4.1\n#CHROM\tPOS").alias("value"))
    return text.read_vcf(spark, written(spark, head.unionByName(rows), "vcf")).drop("idx")


@query("file_qseq", "SELECT 'm' AS machine, '1' AS run, CAST(user_id%8 AS STRING) AS lane, CAST(event_id%100 AS STRING) AS tile, CAST(event_id AS STRING) AS x, CAST(user_id AS STRING) AS y, '0' AS index, '1' AS read, md5(props) AS seq, md5(event_type) AS qual, CAST(event_id%2 AS STRING) AS qc FROM events")
def file_qseq(spark, sf):
    e, c = table(spark, sf, "events"), F.col
    return text.read_qseq(spark, written(spark, _lines(e, "m", "1", c("user_id") % 8, c("event_id") % 100, c("event_id"), c("user_id"), "0", "1", F.md5("props"), F.md5("event_type"), c("event_id") % 2), "qseq")).drop("idx")


@query("file_repeats", RG + """ SELECT chrom, s AS "start", e AS "end", strand, 'm'||CAST(rid%21 AS STRING) AS member, 'f'||CAST(rid%3 AS STRING) AS family FROM rg""")
def file_repeats(spark, sf):
    b, c = bed(spark, sf, "rg"), F.col
    mark = F.when(c("strand") == "+", "+").otherwise("C")
    rows = _lines(b, c("score").cast("int"), "0", "0", "0", c("chrom"), c("start") + 1, c("end"), "(0)", mark, F.concat(F.lit("m"), (c("rid") % 21).cast("string")), F.concat(F.lit("f"), (c("rid") % 3).cast("string")), "1", "2", "(3)", c("rid"), sep="  ")
    head = spark.range(1).select(F.lit("   SW  perc\nscore  div.\n").alias("value"))
    return text.read_repeats(spark, written(spark, head.unionByName(rows), "repeats")).drop("idx")


@query("file_dbsnp", "SELECT 'chr'||CAST(p_partkey%5 AS STRING) AS chrom, CAST(p_size AS BIGINT) AS \"chromStart\", CAST(p_size+1 AS BIGINT) AS \"chromEnd\", 'rs'||CAST(p_partkey AS STRING) AS name, '+' AS strand, 'A/C' AS observed, 'single' AS clazz, 1.0::DOUBLE AS weight FROM part")
def file_dbsnp(spark, sf):
    p, c = table(spark, sf, "part"), F.col
    rows = _lines(p, "585", F.concat(F.lit("chr"), (c("p_partkey") % 5).cast("string")), c("p_size"), c("p_size") + 1, F.concat(F.lit("rs"), c("p_partkey").cast("string")), "0", "+", "A", "A", "A/C", "genomic", "single", "unknown", "0", "0", "x", "exact", "1")
    return text.read_dbsnp(spark, written(spark, rows, "dbsnp")).select("chrom", "chromStart", "chromEnd", "name", "strand", "observed", "clazz", "weight")


@query("file_sizes", "SELECT n_name AS chrom, CAST(n_nationkey*1000 AS BIGINT) AS length FROM nation")
def file_sizes(spark, sf):
    return text.read_sizes(spark, written(spark, _lines(table(spark, sf, "nation"), F.col("n_name"), F.col("n_nationkey") * 1000), "sizes"))


@query("file_base_calls", "SELECT 'chr'||CAST(p_size AS STRING) AS chrom, p_partkey AS pos FROM part")
def file_base_calls(spark, sf):
    rows = _lines(table(spark, sf, "part"), F.concat(F.lit("chr"), F.col("p_size").cast("string")), F.col("p_partkey"), "A", "10")
    head = spark.range(1).select(F.lit("chrom\tpos\tref\tcount").alias("value"))
    return text.read_base_calls(spark, written(spark, head.unionByName(rows), "calls")).select("chrom", "pos")


@query("file_names", "SELECT DISTINCT p_brand AS name FROM part")
def file_names(spark, sf):
    return text.read_names(spark, written(spark, table(spark, sf, "part").select(F.concat("p_brand", F.lit(" x")).alias("value")), "names")).distinct()


@query("file_bedgraph", IV + " SELECT chrom, s AS \"start\", e AS \"end\", CAST(CAST(score AS BIGINT) AS STRING) AS depth FROM iv")
def file_bedgraph(spark, sf):
    lines = sinks.bedgraph_lines(bed(spark, sf).select("chrom", "start", "end", F.col("score").alias("depth")))
    c = F.split("value", "\t")
    return spark.read.text(written(spark, lines, "bedgraph")).select(c[0].alias("chrom"), c[1].cast("long").alias("start"), c[2].cast("long").alias("end"), c[3].alias("depth"))


# --- what other queries don't reach ---------------------------------------------------------------

@query("normaliser_by_quantiles", "WITH c AS (SELECT CAST(p_size%40 AS DOUBLE) AS n FROM part), z AS (SELECT n FROM c WHERE n > 0), q AS (SELECT quantile_disc(n, 0.25) AS lo, quantile_disc(n, 0.75) AS hi FROM z) SELECT sum(n) AS total FROM z, q WHERE n BETWEEN lo AND hi")
def normaliser_by_quantiles(spark, sf):
    return N.normaliser_by_quantiles(table(spark, sf, "part").select((F.col("p_size") % 40).cast("double").alias("count")), 0.25, 0.75)


@query("median_of_counts", "WITH c AS (SELECT p_brand AS k, CAST(p_size AS BIGINT) AS v FROM part) SELECT k, CAST(floor(median(v)) AS BIGINT) AS median FROM c GROUP BY k")
def median_of_counts_query(spark, sf):
    c = table(spark, sf, "part").groupBy(F.col("p_brand").alias("k"), F.col("p_size").cast("long").alias("value")).agg(F.count("*").alias("n"))
    return median_of_counts(c, ["k"])


@query("gene_by_id", GX + " SELECT gid, chrom, min(s) AS \"start\", max(e) AS \"end\" FROM gx WHERE gid IN ('gene1', 'gene7', 'gene33') GROUP BY gid, chrom")
def gene_by_id(spark, sf):
    tx = transcripts(spark, sf)
    return M.genes(M.by_id(tx, "gene1").unionByName(M.by_name(tx, "gene7")).unionByName(M.by_id(tx, "gene33"))).select("gid", "chrom", "start", "end")


@query("genes_in_region_order", GX + " , g AS (SELECT gid, chrom, min(s) AS s, min(idx) AS first FROM gx GROUP BY gid, chrom) SELECT gid, chrom, row_number() OVER (PARTITION BY chrom ORDER BY s//10000, first) AS place FROM g")
def genes_in_region_order(spark, sf):
    """Places by chromosome of the order that the operator gives."""
    from pyspark.sql import Window

    ordered = M.in_region_order(M.genes(transcripts(spark, sf))).withColumn("at", F.monotonically_increasing_id())
    return ordered.select("gid", "chrom", F.row_number().over(Window.partitionBy("chrom").orderBy("at")).cast("long").alias("place"))


@query("gtf_duplicate_counts", GX + " SELECT count(*) FILTER (idx%7 <> 0) AS kept, count(*) FILTER (idx%7 = 0) AS dropped FROM gx")
def gtf_duplicate_counts(spark, sf):
    g = gtf(spark, sf).withColumn("attrs", F.expr("case when idx%7 = 0 then map('transcript_id', concat(attrs['transcript_id'], '_dup2')) else attrs end"))
    return M.duplicate_counts(g)


@query("typed_columns", "SELECT p_partkey AS id, [p_brand, p_type] AS names, [p_size, p_size+1]::BIGINT[] AS sizes, p_name AS text FROM part")
def typed_columns(spark, sf):
    p = table(spark, sf, "part")
    size = F.col("p_size")
    values = F.array(F.col("p_partkey").cast("string"), F.concat_ws(",", "p_brand", "p_type", F.lit("")), F.concat_ws(",", size.cast("string"), (size + 1).cast("string")), F.col("p_name"))
    return p.select(*[c.alias(n) for n, c in S.typed(values, ["#id", "@names", "@#sizes", "text"]).items()])


@query("quoted_split", "SELECT p_partkey, 'a;'||p_name AS v, p_brand AS w FROM part")
def quoted_split(spark, sf):
    """Attribute values with the delimiter inside quotes."""
    attrs = text.attributes(F.concat(F.lit('v "a;'), "p_name", F.lit('"; w "'), "p_brand", F.lit('";')))
    return table(spark, sf, "part").select("p_partkey", attrs.alias("a")).select("p_partkey", F.col("a")["v"].alias("v"), F.col("a")["w"].alias("w"))


@query("thousands", "SELECT p_partkey, format('{:,}', CAST(p_partkey*7919 AS BIGINT)) AS n FROM part")
def thousands(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.thousands(F.col("p_partkey") * 7919).alias("n"))


@query("bam_count_repeats", cte("rd", "rg") + f""" , m AS (SELECT rid, chrom, s, e, strand FROM rg WHERE rid%5=1), l AS (SELECT *, pos + {SPAN} AS aend, CASE WHEN ((flag & 16) <> 0) = ((flag & 128) <> 0) THEN '+' ELSE '-' END AS fs FROM rd WHERE {MAPPED})
  , h AS (SELECT rid, count(DISTINCT l.idx) AS n FROM m JOIN l ON l.chrom=m.chrom AND l.fs=m.strand AND l.pos < m.e AND m.s < l.aend GROUP BY rid)
  SELECT 'r'||CAST(m.rid AS STRING) AS region, CAST(e-s AS BIGINT) AS length, CAST(coalesce(n, 0) AS DOUBLE) AS "count" FROM m LEFT JOIN h ON h.rid=m.rid""")
def bam_count_repeats(spark, sf):
    """A fifth of the regions are repeats."""
    b = bed(spark, sf, "rg").where("rid%5=1")
    model = N.repeat_model(b.select("chrom", "start", "end", "strand", F.lit("f").alias("family"), F.concat(F.lit("r"), F.col("rid").cast("string")).alias("member")))
    return N.region_counts(reads(spark, sf), model).select(F.regexp_extract("region", r"(r[0-9]+)", 1).alias("region"), "length", "count")


_REPORT = RD + f""" , f AS (SELECT *, pos + {SPAN} AS aend FROM rd WHERE ((flag & 1) = 0 OR (flag & 64) <> 0) AND {MAPPED} AND chrom='chr1' AND pos < 500000 AND pos + {SPAN} > 100000)
  , o AS (SELECT *, CASE WHEN t_ih > 1 THEN row_number() OVER (PARTITION BY qname, t_ih > 1, (flag & 128) <> 0 ORDER BY idx) ELSE 1 END AS k FROM f), u AS (SELECT * FROM o WHERE k = 1)
  SELECT 'reads' AS section, 'total' AS key, count(*) AS n FROM u UNION ALL SELECT 'reads', 'mapped', count(*) FROM u UNION ALL SELECT 'reference', 'chr1', count(*) FROM u
  UNION ALL SELECT 'flag', CAST(b AS STRING), count(*) FROM u, (VALUES (1),(2),(4),(8),(16),(32),(64),(128),(256),(512),(1024),(2048)) v(b) WHERE (flag & b) <> 0 GROUP BY b
  UNION ALL SELECT 'AS', CAST(t_as AS STRING), count(*) FROM u GROUP BY t_as UNION ALL SELECT 'MAPQ', CAST(mapq AS STRING), count(*) FROM u GROUP BY mapq"""


@query("bam_report", _REPORT)
def bam_report(spark, sf):
    return A.report(reads(spark, sf), region="chr1:100001-500000", tags=("AS", "MAPQ"))


@query("bed_report", RG + " SELECT 'total' AS section, 'regions' AS key, count(*) AS n FROM rg UNION ALL SELECT 'total', 'bases', CAST(sum(e-s) AS BIGINT) FROM rg UNION ALL SELECT 'reference', chrom, count(*) FROM rg GROUP BY chrom UNION ALL SELECT 'name', name, count(*) FROM rg GROUP BY name")
def bed_report(spark, sf):
    return B.report(bed(spark, sf, "rg"), names=True)

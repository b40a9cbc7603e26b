"""Gene models, annotation and variants over derived exons and reads."""

from pyspark.sql import functions as F

from ..operators import bed as B
from ..operators import count as N
from ..operators import genes as M
from ..operators import variants as V
from .read_queries import BIT, MAPPED, SPAN, reference
from .registry import query
from .views import bed, cte, gtf, reads, spelled, transcripts, view

#: Transcripts by hand: exons and coding parts as distinct spans, codons at the ends of the coding part.
TX = cte("gx") + """ , ex AS (SELECT DISTINCT gid, chrom, tid, strand, s, e FROM gx WHERE feature='exon'), cd AS (SELECT DISTINCT gid, chrom, tid, s, e FROM gx WHERE feature='CDS')
  , cx AS (SELECT tid, min(s) AS cs, arg_max(e, s*100000000+e) AS ce, sum(e-s) AS cn FROM cd GROUP BY tid)
  , t0 AS (SELECT gid, chrom, tid, min(strand) AS strand, min(s) AS s, max(e) AS e, min(idx) AS first FROM gx GROUP BY gid, chrom, tid)
  , tx AS (SELECT t0.*, cs, ce, cn, row_number() OVER (PARTITION BY gid, chrom ORDER BY first, t0.tid) - 1 AS tx, CASE WHEN strand='+' THEN coalesce(cs, s) ELSE coalesce(ce, e)-3 END AS startc, CASE WHEN strand='+' THEN coalesce(ce, e)-3 ELSE coalesce(cs, s) END AS stopc FROM t0 LEFT JOIN cx ON cx.tid=t0.tid)
  , iv AS (SELECT * FROM (SELECT gid, chrom, tid, strand, lag(e) OVER (PARTITION BY tid ORDER BY s, e) AS s, s AS e FROM ex) x WHERE s IS NOT NULL)"""


def site(name: str, start: str, end: str, key: str, where: str = "true"):
    return TX + f""" , z AS (SELECT gid, chrom, strand, tx, {start} AS a, {end} AS b, row_number() OVER (PARTITION BY gid, chrom, {key} ORDER BY tx) AS k FROM tx WHERE {where}) SELECT chrom, a AS "start", b AS "end", gid||'/'||CAST(tx AS STRING) AS name, 0 AS score, strand FROM z WHERE k = 1"""


@query("gtf_tobed_genes", TX + ' SELECT chrom, min(s) AS "start", max(e) AS "end", gid AS name, 0 AS score, min(strand) AS strand FROM tx GROUP BY gid, chrom')
def gtf_tobed_genes(spark, sf):
    return M.bed_genes(transcripts(spark, sf))


def numbered(view: str, letter: str):
    return TX + f""" SELECT chrom, s AS "start", e AS "end", gid||'/{letter}'||CAST(row_number() OVER (PARTITION BY gid, chrom ORDER BY s, e) AS STRING) AS name, 0 AS score, strand FROM (SELECT DISTINCT gid, chrom, strand, s, e FROM {view}) x"""


@query("gtf_tobed_exons", numbered("ex", "e"))
def gtf_tobed_exons(spark, sf):
    return M.bed_exons(transcripts(spark, sf))


@query("gtf_tobed_introns", numbered("iv", "i"))
def gtf_tobed_introns(spark, sf):
    return M.bed_introns(transcripts(spark, sf))


@query("gtf_tobed_tss", site("tss", "CASE WHEN strand='+' THEN s ELSE e-3 END", "CASE WHEN strand='+' THEN s+3 ELSE e END", "CASE WHEN strand='+' THEN s ELSE e END"))
def gtf_tobed_tss(spark, sf):
    return M.bed_tss(transcripts(spark, sf))


@query("gtf_tobed_txs", site("txs", "CASE WHEN strand='-' THEN s ELSE e-3 END", "CASE WHEN strand='-' THEN s+3 ELSE e END", "CASE WHEN strand='-' THEN s ELSE e END"))
def gtf_tobed_txs(spark, sf):
    return M.bed_txs(transcripts(spark, sf))


@query("gtf_tobed_promoter", site("promoter", "CASE WHEN strand='+' THEN s-500 ELSE e-100 END", "CASE WHEN strand='+' THEN s+100 ELSE e+500 END", "CASE WHEN strand='+' THEN s ELSE e END"))
def gtf_tobed_promoter(spark, sf):
    return M.bed_promoters(transcripts(spark, sf), 500, 100)


@query("gtf_tobed_tlss", site("tlss", "startc", "startc+3", "startc", "cs IS NOT NULL"))
def gtf_tobed_tlss(spark, sf):
    return M.bed_translation_starts(transcripts(spark, sf))


@query("gtf_tobed_tlxs", site("tlxs", "stopc", "stopc+3", "stopc", "cs IS NOT NULL"))
def gtf_tobed_tlxs(spark, sf):
    return M.bed_translation_stops(transcripts(spark, sf))


@query("gtf_tobed_utr5", site("utr5", "CASE WHEN strand='+' THEN s ELSE startc+4 END", "CASE WHEN strand='+' THEN startc ELSE e END", "CASE WHEN strand='+' THEN s ELSE e END, startc", "cs IS NOT NULL"))
def gtf_tobed_utr5(spark, sf):
    return M.bed_utr5(transcripts(spark, sf))


@query("gtf_tobed_utr3", site("utr3", "CASE WHEN strand='+' THEN stopc+4 ELSE s END", "CASE WHEN strand='+' THEN e ELSE stopc END", "CASE WHEN strand='+' THEN e ELSE s END, stopc", "cs IS NOT NULL"))
def gtf_tobed_utr3(spark, sf):
    return M.bed_utr3(transcripts(spark, sf))


def splice(donor: bool):
    right, left = ("+", "-") if donor else ("-", "+")
    return TX + f""" , n AS (SELECT ex.*, row_number() OVER (PARTITION BY tid ORDER BY s, e) AS i, count(*) OVER (PARTITION BY tid) AS c FROM ex)
      , p AS (SELECT gid, chrom, strand, tid, e AS a, e+1 AS b FROM n WHERE strand='{right}' AND i < c UNION ALL SELECT gid, chrom, strand, tid, s-1, s FROM n WHERE strand='{left}' AND i > 1)
      , z AS (SELECT p.*, tx.tx, row_number() OVER (PARTITION BY p.gid, p.chrom, a ORDER BY tx.tx) AS k FROM p JOIN tx ON tx.tid=p.tid) SELECT chrom, a AS "start", b AS "end", gid||'/'||CAST(tx AS STRING) AS name, 0 AS score, strand FROM z WHERE k = 1"""


@query("gtf_tobed_junc5", splice(True))
def gtf_tobed_junc5(spark, sf):
    return M.bed_donors(transcripts(spark, sf))


@query("gtf_tobed_junc3", splice(False))
def gtf_tobed_junc3(spark, sf):
    return M.bed_acceptors(transcripts(spark, sf))


_REGIONS = TX + """ , p AS (SELECT DISTINCT gid, chrom, s AS a FROM ex UNION SELECT DISTINCT gid, chrom, e FROM ex), q AS (SELECT * FROM (SELECT gid, chrom, a, lead(a) OVER (PARTITION BY gid, chrom ORDER BY a) AS b FROM p) x WHERE b IS NOT NULL)
  , m AS (SELECT q.gid, q.chrom, a, b, string_agg(DISTINCT tid, ',' ORDER BY tid) AS names, count(DISTINCT tid) AS n, min(strand) AS strand FROM q JOIN ex ON ex.gid=q.gid AND ex.chrom=q.chrom AND s <= a AND b <= e GROUP BY q.gid, q.chrom, a, b)
  , sp AS (SELECT gid, chrom, tid, min(s) AS s, max(e) AS e FROM ex GROUP BY ALL), o AS (SELECT m.*, (SELECT count(*) FROM sp WHERE sp.gid=m.gid AND sp.chrom=m.chrom AND sp.s <= a AND b <= sp.e) AS spanning FROM m)
  , f AS (SELECT *, CASE WHEN lag(b) OVER w = a AND lag(names) OVER w = names THEN 0 ELSE 1 END AS fresh FROM o WINDOW w AS (PARTITION BY gid, chrom ORDER BY a)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY gid, chrom ORDER BY a) AS i FROM f)
  , rx AS (SELECT gid, chrom, i, min(strand) AS strand, min(a) AS a, max(b) AS b, bool_and(n = spanning) AS const, max(n) AS n FROM g GROUP BY gid, chrom, i)"""


@query("gtf_tobed_regions", _REGIONS + """ SELECT chrom, a AS "start", b AS "end", gid||'/'||CASE WHEN const THEN 'const' ELSE 'alt' END||'.'||CAST(i AS STRING) AS name, CAST(n AS INT) AS score, strand FROM rx""")
def gtf_tobed_regions(spark, sf):
    return M.bed_regions(transcripts(spark, sf))


@query("gtf_genesize", TX + """ , l AS (SELECT tx.gid, tx.chrom, tx.tid, tx.s, tx.e, (SELECT sum(ex.e-ex.s) FROM ex WHERE ex.tid=tx.tid) AS t, coalesce((SELECT sum(iv.e-iv.s) FROM iv WHERE iv.tid=tx.tid), 0) AS i, coalesce(cn, 0) AS c,
    coalesce(CASE WHEN strand='+' THEN (SELECT sum(least(ex.e, cs)-ex.s) FROM ex WHERE ex.tid=tx.tid AND ex.s < cs) ELSE (SELECT sum(ex.e-greatest(ex.s, ce)) FROM ex WHERE ex.tid=tx.tid AND ex.e > ce) END, 0) AS u5,
    coalesce(CASE WHEN strand='-' THEN (SELECT sum(least(ex.e, cs)-ex.s) FROM ex WHERE ex.tid=tx.tid AND ex.s < cs) ELSE (SELECT sum(ex.e-greatest(ex.s, ce)) FROM ex WHERE ex.tid=tx.tid AND ex.e > ce) END, 0) AS u3 FROM tx)
  SELECT gid AS gene, max(e)-min(s) AS genomic, CAST(max(t) AS BIGINT) AS transcript, CAST(max(i) AS BIGINT) AS intron, CAST(max(c) AS BIGINT) AS coding, CAST(max(u5) AS BIGINT) AS utr5, CAST(max(u3) AS BIGINT) AS utr3 FROM l GROUP BY gid, chrom""")
def gtf_genesize(spark, sf):
    return M.gene_sizes(transcripts(spark, sf))


@query("gtf_query", TX + " SELECT gid FROM tx WHERE chrom='chr2' AND strand='+' GROUP BY gid, chrom HAVING min(s) <= 900000 AND max(e) >= 100000")
def gtf_query(spark, sf):
    return M.find_genes(transcripts(spark, sf), "chr2", 100_000, 900_000, "+").select("gid")


@query("gtf_annotate", TX + """ , pt AS (SELECT o_orderkey AS pid, 'chr'||CAST(1+o_custkey%5 AS STRING) AS c, (o_orderkey*1237+o_custkey*7919)%5000000 AS p FROM orders), gs AS (SELECT gid, chrom, min(s) AS a, max(e) AS b, min(first) AS f FROM tx GROUP BY gid, chrom)
  , h AS (SELECT pid, p, tx.gid, tx.tid, tx.first, tx.tx, strand, startc, stopc, EXISTS (SELECT 1 FROM ex WHERE ex.tid=tx.tid AND ex.s <= p AND p < ex.e) AS inside FROM pt JOIN gs ON gs.chrom=c AND a <= p AND p <= b JOIN tx ON tx.gid=gs.gid AND tx.chrom=gs.chrom)
  , l AS (SELECT *, CASE WHEN NOT inside THEN 'intron' WHEN CASE WHEN strand='+' THEN p < startc ELSE p >= startc+3 END THEN '5''UTR' WHEN CASE WHEN strand='+' THEN p >= stopc+3 ELSE p < stopc END THEN '3''UTR' ELSE 'coding' END AS loc FROM h)
  , a AS (SELECT pid, string_agg(gid, ',' ORDER BY first, gid) FILTER (tx=0) AS g, string_agg(tid, ',' ORDER BY first, gid, tx) AS t, string_agg(loc, ',' ORDER BY first, gid, tx) AS l FROM l GROUP BY pid)
  SELECT pt.pid, coalesce(g,'') AS gene_ids, coalesce(t,'') AS transcript_ids, coalesce(a.l,'intergenic') AS locations FROM pt LEFT JOIN a ON a.pid=pt.pid""")
def gtf_annotate(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    points = o.select(F.col("o_orderkey").alias("pid"), F.concat(F.lit("chr"), (F.col("o_custkey") % 5 + 1).cast("string")).alias("chrom"), ((F.col("o_orderkey") * 1237 + F.col("o_custkey") * 7919) % 5_000_000).alias("pos"))
    return M.annotate(points, transcripts(spark, sf)).select("pid", "gene_ids", "transcript_ids", "locations")


_CLASSES = TX + """ , u AS (SELECT chrom, strand, s, e, 0 AS k FROM (SELECT cd.*, tx.strand FROM cd JOIN tx ON tx.tid=cd.tid) x
    UNION ALL SELECT ex.chrom, ex.strand, ex.s, least(ex.e, cs), CASE WHEN ex.strand='+' THEN 1 ELSE 2 END FROM ex JOIN cx ON cx.tid=ex.tid WHERE ex.s < cs UNION ALL SELECT ex.chrom, ex.strand, greatest(ex.s, ce), ex.e, CASE WHEN ex.strand='+' THEN 2 ELSE 1 END FROM ex JOIN cx ON cx.tid=ex.tid WHERE ex.e > ce
    UNION ALL SELECT chrom, strand, s, e, 3 FROM ex UNION ALL SELECT chrom, strand, s, e, 4 FROM iv UNION ALL SELECT chrom, strand, CASE WHEN strand='+' THEN min(s)-2000 ELSE max(e) END, CASE WHEN strand='+' THEN min(s) ELSE max(e)+2000 END, 5 FROM tx GROUP BY gid, chrom, strand)
  , pt AS (SELECT o_orderkey AS pid, 'chr'||CAST(1+o_custkey%5 AS STRING) AS c, CASE WHEN o_orderkey%3=0 THEN '-' ELSE '+' END AS st, (o_orderkey*1237+o_custkey*7919)%5000000 AS p FROM orders)
  , h AS (SELECT pid, min(k*2 + CASE WHEN st=strand THEN 0 ELSE 1 END) AS b FROM pt JOIN u ON u.chrom=c AND s <= p AND p < e GROUP BY pid)"""


@query("classify_positions", _CLASSES + """ SELECT pt.pid, CASE WHEN b IS NULL THEN 'intergenic' ELSE (['coding','utr-5','utr-3','other-exon','intron','promoter'])[CAST(b//2+1 AS BIGINT)]||CASE WHEN b%2=1 THEN '-rev' ELSE '' END END AS tag FROM pt LEFT JOIN h ON h.pid=pt.pid""")
def classify_positions(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    points = o.select(F.col("o_orderkey").alias("pid"), F.concat(F.lit("chr"), (F.col("o_custkey") % 5 + 1).cast("string")).alias("chrom"), ((F.col("o_orderkey") * 1237 + F.col("o_custkey") * 7919) % 5_000_000).alias("pos"), F.when(F.col("o_orderkey") % 3 == 0, "-").otherwise("+").alias("strand"))
    return M.classify(points, M.class_ranges(transcripts(spark, sf))).select("pid", "tag")


_TAG = "CASE WHEN {b} IS NULL THEN 'intergenic' ELSE (['coding','utr-5','utr-3','other-exon','intron','promoter'])[CAST({b}//2+1 AS BIGINT)]||CASE WHEN {b}%2=1 THEN '-rev' ELSE '' END END"
_REGION_TAGS = _CLASSES.split(", pt AS")[0].replace("WITH ", cte("rg") + ", ", 1) + f""" , pt AS (SELECT rid, 0 AS n, chrom AS c, strand AS st, s AS p FROM rg UNION ALL SELECT rid, 1, chrom, strand, e-1 FROM rg)
  , h AS (SELECT rid, n, min(k*2 + CASE WHEN st=strand THEN 0 ELSE 1 END) AS b FROM pt JOIN u ON u.chrom=c AND s <= p AND p < e GROUP BY rid, n)
  , w AS (SELECT rg.rid, {_TAG.format(b="x.b")} AS a, {_TAG.format(b="y.b")} AS z FROM rg LEFT JOIN h x ON x.rid=rg.rid AND x.n=0 LEFT JOIN h y ON y.rid=rg.rid AND y.n=1) SELECT rid, CASE WHEN a=z THEN a ELSE a||'/'||z END AS tag FROM w"""


@query("classify_regions", _REGION_TAGS)
def classify_regions(spark, sf):
    return M.classify_regions(bed(spark, sf, "rg"), M.class_ranges(transcripts(spark, sf))).select("rid", "tag")


@query("gtf_filter_ucsc", cte("gx") + " SELECT idx, CASE chrom WHEN 'chr3' THEN 'chrM' ELSE chrom END AS chrom FROM gx WHERE chrom NOT IN ('chr4', 'chr5') AND idx%7 <> 0")
def gtf_filter_ucsc(spark, sf):
    """Names as Ensembl has them, one of them of no chromosome; a seventh of the rows are of copies."""
    g = gtf(spark, sf).withColumn("attrs", F.expr("case when idx%7 = 0 then map_concat(map_filter(attrs, (k, v) -> k <> 'transcript_id'), map('transcript_id', concat(attrs['transcript_id'], '_dup1'))) else attrs end"))
    named = M.filter_chrom_text(g, "r5").withColumn("chrom", F.expr("case chrom when 'chr3' then 'MT' when 'chr4' then '4_random' else substr(chrom, 4) end"))
    return M.to_ucsc(M.remove_duplicates(named)).select("idx", "chrom")


@query("gtf_to_ensembl", cte("gx") + " SELECT idx, CASE chrom WHEN 'chr3' THEN 'MT' ELSE substr(chrom, 4) END AS chrom FROM gx")
def gtf_to_ensembl(spark, sf):
    return M.to_ensembl(gtf(spark, sf).withColumn("chrom", F.expr("case chrom when 'chr3' then 'chrM' else chrom end"))).select("idx", "chrom")


@query("gtf_add_isoform", cte("gx") + """ , m AS (SELECT tid, max(first) AS f FROM (SELECT tid, min(idx) AS first FROM gx GROUP BY tid) x WHERE first%3=1 GROUP BY tid) SELECT gx.idx, CASE WHEN m.f IS NULL THEN 'gene_id "'||gid||'"; transcript_id "'||gx.tid||'";' ELSE 'gene_id "'||gid||'"; transcript_id "'||gx.tid||'"; isoform_id "iso'||CAST(m.f AS STRING)||'";' END AS attributes FROM gx LEFT JOIN m ON m.tid=gx.tid""")
def gtf_add_isoform(spark, sf):
    g = gtf(spark, sf)
    iso = g.groupBy(F.element_at("attrs", "transcript_id").alias("transcript")).agg(F.min("idx").alias("idx")).where("idx%3=1").select(F.concat(F.lit("iso"), F.col("idx").cast("string")).alias("isoform"), "transcript", "idx")
    return M.add_isoform(g, iso).select("idx", "attributes")


@query("gtf_add_xref", cte("gx") + """ SELECT idx, CASE WHEN tid LIKE '%.1' THEN 'N'||gid ELSE gid END AS gene_name FROM gx""")
def gtf_add_xref(spark, sf):
    g = gtf(spark, sf)
    t = F.element_at("attrs", "transcript_id")
    x = g.where(t.endswith(".1")).select(t.alias("transcript"), F.concat(F.lit("N"), F.element_at("attrs", "gene_id")).alias("name"), "idx")
    return M.add_xref(g, x).select("idx", F.element_at("attrs", "gene_name").alias("gene_name"))


@query("gtf_add_reflink", cte("gx") + """ SELECT idx, CASE WHEN tid LIKE '%.1' THEN 'N'||gid ELSE gid END AS gene_id, CASE WHEN tid LIKE '%.1' THEN gid END AS orig FROM gx""")
def gtf_add_reflink(spark, sf):
    g = gtf(spark, sf)
    t = F.element_at("attrs", "transcript_id")
    x = g.where(t.endswith(".1")).select(t.alias("transcript"), F.concat(F.lit("N"), F.element_at("attrs", "gene_id")).alias("name"), F.lit("i").alias("id"), "idx")
    return M.add_reflink(g, x, replace=True).select("idx", F.element_at("attrs", "gene_id").alias("gene_id"), F.try_element_at("attrs", F.lit("orig_gene_id")).alias("orig"))


@query("gff_to_gtf", cte("gx") + " SELECT idx, gid AS gene_id, tid AS transcript_id, feature FROM gx")
def gff_to_gtf(spark, sf):
    g = gtf(spark, sf)
    a = lambda k: F.element_at("attrs", k)
    up = lambda df, feature, **kv: df.withColumns({"feature": F.lit(feature), "attrs": F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)])})
    one = g.dropDuplicates(["attributes"])
    gene = up(g.select("*", a("gene_id").alias("__g")).dropDuplicates(["__g"]).drop("__g"), "gene", ID=a("gene_id"), Name=a("gene_id"))
    rna = up(one, "mRNA", ID=a("transcript_id"), Parent=a("gene_id"))
    part = g.withColumn("attrs", F.create_map(F.lit("Parent"), a("transcript_id")))
    good, _ = M.from_gff(part.unionByName(rna).unionByName(gene))
    return good.select("idx", a("gene_id").alias("gene_id"), a("transcript_id").alias("transcript_id"), "feature")


#: Last chunk of a reference that holds all transcripts: genes start below 5,000,000 and end within 1,300 bases.
GENOME = 4900


_JUNCTIONS = cte("gx") + """ , ex AS (SELECT DISTINCT gid, chrom, s, e FROM gx WHERE feature='exon')
  , jn AS (SELECT DISTINCT x.chrom, greatest(x.s, x.e-30) AS a, x.e AS b, y.s AS c, least(y.e, y.s+30) AS d FROM ex x JOIN ex y ON y.gid=x.gid AND y.chrom=x.chrom AND y.s > x.e)
  , sa AS (""" + spelled("(SELECT DISTINCT chrom, a, b FROM jn) z", "chrom, a, b", "a", "b", GENOME) + """), sc AS (""" + spelled("(SELECT DISTINCT chrom, c, d FROM jn) z", "chrom, c, d", "c", "d", GENOME) + """)
  SELECT jn.chrom||':'||CAST(jn.a AS STRING)||'-'||CAST(jn.b AS STRING)||','||CAST(jn.c AS STRING)||'-'||CAST(jn.d AS STRING) AS name, sa.q||sc.q AS seq
  FROM jn JOIN sa ON sa.chrom=jn.chrom AND sa.a=jn.a AND sa.b=jn.b JOIN sc ON sc.chrom=jn.chrom AND sc.c=jn.c AND sc.d=jn.d"""


@query("gtf_junctions", _JUNCTIONS)
def gtf_junctions(spark, sf):
    """Exons have 60 bases or more, so two pieces of 30 are enough for each junction."""
    return M.junctions(transcripts(spark, sf), reference(spark, sf, GENOME), 30, 50, chunk=1024)


@query("bed_tofasta", cte("rg") + ", b AS (" + spelled("(SELECT * FROM rg WHERE e-s >= 100) z", "rid, chrom, s, e, strand") + """)
  SELECT chrom||':'||CAST(s AS STRING)||'-'||CAST(e AS STRING)||'['||strand||']' AS name, CASE WHEN strand='-' THEN reverse(translate(q,'ACGT','TGCA')) ELSE q END AS seq FROM b""")
def bed_tofasta(spark, sf):
    return B.to_fasta(bed(spark, sf, "rg"), reference(spark, sf), min_size=100, chunk=1024)


_GENE_COUNTS = _REGIONS.replace("WITH ", cte("rd") + ", ", 1) + f""" , l AS (SELECT *, pos + {SPAN} AS aend, CASE WHEN {BIT(16)} = {BIT(128)} THEN '+' ELSE '-' END AS fs FROM rd WHERE {MAPPED})
  , h AS (SELECT DISTINCT gid, rx.chrom, l.idx FROM rx JOIN l ON l.chrom=rx.chrom AND l.fs=rx.strand AND l.pos < rx.b AND rx.a < l.aend), c AS (SELECT gid, chrom, count(*) AS n FROM h GROUP BY gid, chrom)
  , z AS (SELECT gid, chrom, sum(b-a) AS len FROM rx GROUP BY gid, chrom), tt AS (SELECT sum(n) AS total FROM c)
  SELECT z.gid||'/'||z.chrom AS region, CAST(len AS BIGINT) AS length, CAST(coalesce(n,0) AS DOUBLE) AS "count", round(coalesce(n,0)/(total/1e6), 6) AS cpm, round(coalesce(n,0)/(len/1000.0)/(total/1e6), 6) AS rpkm FROM z LEFT JOIN c ON c.gid=z.gid AND c.chrom=z.chrom, tt"""


@query("bam_count_genes", _GENE_COUNTS)
def bam_count_genes(spark, sf):
    return N.region_counts(reads(spark, sf), N.gene_model(M.regions(transcripts(spark, sf))), norm="mapped", fpkm=True).withColumns({"cpm": F.round("cpm", 6), "rpkm": F.round("rpkm", 6)})


_EXONS = _REGIONS.replace("WITH ", cte("rd") + ", ", 1) + f""" , l AS (SELECT qname, chrom, pos, pos + {SPAN} AS aend, cigar, CASE WHEN {BIT(16)} = {BIT(128)} THEN '+' ELSE '-' END AS fs FROM rd WHERE {MAPPED})
  , pc AS (SELECT l.*, pos + x AS s, pos + y AS e FROM l JOIN (VALUES ('32M',0,32),('12M300N20M',0,12),('12M300N20M',312,332),('5S27M',0,27),('10M2I20M',0,30),('15M3D17M',0,35),('4S10M120N10M80N8M',0,10),('4S10M120N10M80N8M',130,140),('4S10M120N10M80N8M',220,228)) v(c,x,y) ON cigar=c)
  , tc AS (SELECT DISTINCT gid, rx.chrom, i, qname FROM rx JOIN pc ON pc.chrom=rx.chrom AND pc.fs=rx.strand AND pc.s < rx.b AND rx.a < pc.e), ov AS (SELECT DISTINCT gid, rx.chrom, i, qname FROM rx JOIN l ON l.chrom=rx.chrom AND l.fs=rx.strand AND l.pos < rx.b AND rx.a < l.aend)
  , inc AS (SELECT gid, chrom, i, count(*) AS n FROM tc GROUP BY ALL), exc AS (SELECT gid, chrom, i, count(*) AS n FROM (SELECT * FROM ov EXCEPT SELECT * FROM tc) x GROUP BY ALL), ge AS (SELECT gid, count(DISTINCT qname) AS n FROM tc GROUP BY gid)
  , al AS (SELECT rx.*, coalesce(inc.n, 0) AS inclusion, coalesce(exc.n, 0) AS exclusion, coalesce(ge.n, 0) AS gene_reads FROM rx LEFT JOIN inc ON inc.gid=rx.gid AND inc.chrom=rx.chrom AND inc.i=rx.i LEFT JOIN exc ON exc.gid=rx.gid AND exc.chrom=rx.chrom AND exc.i=rx.i LEFT JOIN ge ON ge.gid=rx.gid)
  SELECT gid, CAST(i AS BIGINT) AS i, chrom, a AS "start", b AS "end", strand, const, inclusion, exclusion, gene_reads, round(CASE WHEN inclusion+exclusion=0 THEN 0.0 ELSE inclusion/(inclusion+exclusion) END, 6) AS incl_pct, round(CASE WHEN inclusion+exclusion=0 THEN 0.0 ELSE exclusion/(inclusion+exclusion) END, 6) AS excl_pct,
    CASE WHEN NOT const THEN round(CASE WHEN gene_reads-inclusion-exclusion=0 THEN 0.0 ELSE (inclusion-exclusion)/(gene_reads-inclusion-exclusion) END, 6) + 0.0 END AS alt_index FROM al"""


@query("bam_count_exons", _EXONS)
def bam_count_exons(spark, sf):
    got = N.exon_inclusion(reads(spark, sf), M.regions(transcripts(spark, sf)))
    return got.withColumns({"i": F.col("i").cast("long"), **{c: F.round(c, 6) + 0.0 for c in ("incl_pct", "excl_pct", "alt_index")}})


#: A mismatch at one of the first ten aligned bases, then what each CIGAR string has: by hand, as reads' MD tags would say.
_MD = "CASE cigar WHEN '32M' THEN CAST(m AS STRING)||'N'||CAST(31-m AS STRING) WHEN '12M300N20M' THEN CAST(m AS STRING)||'N'||CAST(31-m AS STRING) WHEN '5S27M' THEN CAST(m AS STRING)||'N'||CAST(26-m AS STRING) WHEN '10M2I20M' THEN CAST(m AS STRING)||'N'||CAST(29-m AS STRING) WHEN '15M3D17M' THEN CAST(m AS STRING)||'N'||CAST(14-m AS STRING)||'^ACG17' WHEN '4S10M120N10M80N8M' THEN CAST(m AS STRING)||'N'||CAST(27-m AS STRING) END"
_CLIP = "CASE cigar WHEN '5S27M' THEN 5 WHEN '4S10M120N10M80N8M' THEN 4 ELSE 0 END"
_VARIANTS = cte("rd") + f""" , x AS (SELECT *, idx%10 AS m FROM rd WHERE {MAPPED} AND cigar <> '*'), v AS (SELECT idx, chrom, 'M' AS op, pos+m AS p, substr(seq, CAST({_CLIP}+m+1 AS BIGINT), 1) AS b FROM x
  UNION ALL SELECT idx, chrom, 'I', pos+10, substr(seq, 11, 2) FROM x WHERE cigar='10M2I20M' UNION ALL SELECT idx, chrom, 'D', pos+15, 'ACG' FROM x WHERE cigar='15M3D17M')"""


@query("bam_variants", _VARIANTS + " SELECT idx, chrom, op, CAST(p AS BIGINT) AS pos, b AS bases FROM v")
def bam_variants(spark, sf):
    return V.variants(_with_md(spark, sf))


def _with_md(spark, sf):
    r = reads(spark, sf).where("cigar <> '*'").withColumn("m", F.col("idx") % 10)
    return r.withColumn("tags", F.create_map(F.lit("MD"), F.struct(F.lit("Z").alias("t"), F.expr(_MD).alias("v")))).drop("m")


#: At places where some reads have a mismatch, an insertion or a deletion.
_DBSNP = """SELECT chrom, pos + CASE idx%3 WHEN 0 THEN (idx%10) WHEN 1 THEN 10 ELSE 15 END AS p, CASE WHEN mapq%2=0 THEN '+' ELSE '-' END AS st, CASE mapq%4 WHEN 0 THEN 'A/C/T' WHEN 1 THEN '-/ACG' WHEN 2 THEN 'G/C' ELSE '-/AA/GT/CC' END AS o, CASE mapq%5 WHEN 0 THEN 'single' WHEN 1 THEN 'mixed' WHEN 2 THEN 'deletion' WHEN 3 THEN 'insertion' ELSE 'in-del' END AS c FROM rd WHERE chrom IS NOT NULL"""


@query("bam_known_variants", _VARIANTS + f""" , d AS ({_DBSNP}), a AS (SELECT chrom, p, c, CASE WHEN st='-' THEN reverse(translate(y, 'ACGT', 'TGCA')) ELSE y END AS y FROM (SELECT *, unnest(string_split(o, '/')) AS y FROM d) z)
  SELECT DISTINCT v.idx, v.chrom, v.op, CAST(v.p AS BIGINT) AS pos, v.b AS bases FROM v JOIN a ON a.chrom=v.chrom AND a.p=v.p
  WHERE op='M' AND c IN ('single','mixed') AND y=b OR op='I' AND c IN ('insertion','mixed','in-del') AND y=b OR op='D' AND c IN ('deletion','mixed','in-del') AND y='-'""")
def bam_known_variants(spark, sf):
    snp = spark.sql(_DBSNP.replace("FROM rd", "FROM {rd}"), rd=view(spark, sf, "rd")).select("chrom", F.col("p").alias("chromStart"), F.col("st").alias("strand"), F.col("o").alias("observed"), F.col("c").alias("clazz"))
    return V.known_variants(V.variants(_with_md(spark, sf)), snp)

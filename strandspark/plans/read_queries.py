"""Alignment, pile-up and counting operators over derived reads."""

from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import flags as G
from ..operators import align as A
from ..operators import count as N
from ..operators import pileup as P
from .registry import query
from .views import bed, cte, reads, spelled

RD = cte("rd")
BOTH = cte("rd", "rg")
BIT = lambda b: f"((flag & {b}) <> 0)"
MAPPED = "(flag & 4) = 0"
#: Reference bases, inserted and deleted bases of the derived CIGAR strings, by hand.
SPAN = "CASE cigar WHEN '32M' THEN 32 WHEN '12M300N20M' THEN 332 WHEN '5S27M' THEN 27 WHEN '10M2I20M' THEN 30 WHEN '15M3D17M' THEN 35 WHEN '4S10M120N10M80N8M' THEN 228 ELSE 0 END"
R = RD + f" , r AS (SELECT *, pos + {SPAN} AS aend, CASE WHEN {BIT(16)} THEN '-' ELSE '+' END AS strand FROM rd)"
RR = BOTH + f" , r AS (SELECT *, pos + {SPAN} AS aend, CASE WHEN {BIT(16)} THEN '-' ELSE '+' END AS strand FROM rd)"
_PIECES = "(VALUES ('32M',0,32,0),('12M300N20M',0,12,0),('12M300N20M',312,332,12),('5S27M',0,27,5),('10M2I20M',0,10,0),('10M2I20M',10,30,12),('15M3D17M',0,15,0),('15M3D17M',18,35,15),('4S10M120N10M80N8M',0,10,4),('4S10M120N10M80N8M',130,140,14),('4S10M120N10M80N8M',220,228,24)) v(c,a,z,q)"
PIECES = f", b AS (SELECT r.*, pos + a AS s, pos + z AS e, q FROM r JOIN {_PIECES} ON cigar = c WHERE {MAPPED})"


def kept(spark, sf, *criteria):
    return A.filter_reads(reads(spark, sf), *criteria).where("fail_reason is null").select("idx")


def simple(name: str, where: str, *criteria):
    @query(f"bam_filter_{name}", R + f" SELECT idx FROM r WHERE {where}")
    def f(spark, sf):
        return kept(spark, sf, *criteria)


MATED = f"({MAPPED} AND (NOT {BIT(1)} OR NOT {BIT(8)}))"
PROPER = f"({BIT(1)} AND {MAPPED} AND NOT {BIT(8)} AND {BIT(16)} <> {BIT(32)} AND {BIT(2)})"
EDITS = "(t_nm - CASE cigar WHEN '10M2I20M' THEN 1 WHEN '15M3D17M' THEN 2 ELSE 0 END)"
simple("mapped", MATED, ("mapped",))
simple("unmapped", f"NOT {MATED}", ("unmapped",))
simple("properpair", PROPER, ("properpair",))
simple("noproperpair", f"NOT {PROPER}", ("noproperpair",))
simple("mask", "(flag & 1040) = 0", ("mask", "0x410"))
simple("secondary_qc_dup", "(flag & 1792) = 0", ("nosecondary",), ("noqcfail",), ("nopcrdup",))
simple("excluderef", f"NOT ({MAPPED} AND chrom='chr2')", ("excluderef", "chr2"))
simple("includeref", f"{MAPPED} AND chrom='chr2'", ("includeref", "chr2"))
simple("exclude_region", f"NOT ({MAPPED} AND chrom='chr1' AND (pos BETWEEN 100000 AND 400000 OR aend BETWEEN 100000 AND 400000))", ("exclude", "chr1:100001-400000"))
simple("include_regions", f"{MAPPED} AND (chrom='chr1' AND (pos BETWEEN 100000 AND 400000 OR aend BETWEEN 100000 AND 400000) OR chrom='chr3' AND (pos BETWEEN 0 AND 5000 OR aend BETWEEN 0 AND 5000))", ("include", "chr1:100001-400000", "chr3:1-5000"))
simple("mismatch", f"{MAPPED} AND {EDITS} <= 2", ("mismatch", 2))
simple("mismatch_ratio", f"{MAPPED} AND {EDITS} <= 0.1*length(seq)", ("maximum_mismatch_ratio", 0.1))
simple("length", "length(seq) BETWEEN 10 AND 32", ("minlen", 10), ("maxlen", 32))
simple("tags", "t_as >= 20 AND t_nm < 5 AND t_ih = 2 AND mapq <= 49 AND mapq > 3", ("gte", "AS:i", 20), ("lt", "NM", 5), ("lt", "ZZ:i", 3), ("eq", "IH", 2), ("lte", "MAPQ", 49), ("gt", "MAPQ", 3))


@query("bam_filter_reasons", R + f""" SELECT coalesce(CASE WHEN NOT {MATED} THEN 'mapped' WHEN (flag & 1024) <> 0 THEN 'nopcrdup' WHEN NOT (t_as >= 25) THEN 'gte' END, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1""")
def bam_filter_reasons(spark, sf):
    return A.filter_reads(reads(spark, sf), ("mapped",), ("nopcrdup",), ("gte", "AS:i", 25)).groupBy(F.coalesce("fail_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("bam_filter_unique", R + f""" SELECT idx FROM (SELECT idx, flag, row_number() OVER (PARTITION BY chrom, pos, substr(CASE WHEN {BIT(16)} THEN reverse(seq) ELSE seq END, 1, 2) ORDER BY idx) AS k FROM r) x WHERE k = 1 OR NOT {MAPPED}""")
def bam_filter_unique(spark, sf):
    return A.unique_sequence(reads(spark, sf), 2).select("idx")


@query("bam_filter_unique_start", R + f""" SELECT idx FROM (SELECT idx, row_number() OVER (PARTITION BY chrom, strand, CASE WHEN strand='-' THEN aend ELSE pos END ORDER BY idx) AS k FROM r WHERE {MAPPED}) x WHERE k = 1""")
def bam_filter_unique_start(spark, sf):
    return A.unique_start(reads(spark, sf)).select("idx")


@query("bam_filter_lists", RD + " SELECT idx FROM rd WHERE qname IN (SELECT qname FROM rd WHERE idx%10=1) AND qname NOT IN (SELECT qname FROM rd WHERE idx%30=2)")
def bam_filter_lists(spark, sf):
    r = reads(spark, sf)
    listed = lambda cond: r.where(cond).select(F.col("qname").alias("name"))
    return A.not_in_list(A.in_list(r, listed("idx%10=1")), listed("idx%30=2")).select("idx")


HIT = "EXISTS (SELECT 1 FROM rg g WHERE g.chrom = r.chrom AND g.strand = r.strand AND r.pos <= g.e AND g.s <= r.aend)"


@query("bam_filter_excludebed", RR + f" SELECT idx FROM r WHERE {MAPPED} AND NOT {HIT}")
def bam_filter_excludebed(spark, sf):
    return A.exclude_bed(reads(spark, sf), bed(spark, sf, "rg")).select("idx")


@query("bam_filter_includebed", RR + f" SELECT idx FROM r WHERE NOT {MAPPED} OR {HIT}")
def bam_filter_includebed(spark, sf):
    return A.include_bed(reads(spark, sf), bed(spark, sf, "rg")).select("idx")


@query("bam_tobed", R + f' SELECT chrom, CAST(pos AS BIGINT) AS "start", CAST(aend AS BIGINT) AS "end", qname AS name, 0 AS score, strand FROM r WHERE {MAPPED}')
def bam_tobed(spark, sf):
    return A.to_bed(reads(spark, sf))


@query("bam_tofastq", R + f""" , f AS (SELECT idx, qname AS name, CASE WHEN {BIT(16)} THEN reverse(translate(seq,'ACGT','TGCA')) ELSE seq END AS seq, CASE WHEN {BIT(16)} THEN reverse(qual) ELSE qual END AS qual FROM r WHERE {MAPPED} AND NOT {BIT(128)})
  SELECT idx, name, seq, qual FROM (SELECT *, lag(seq) OVER (PARTITION BY name ORDER BY idx) AS p FROM f) x WHERE p IS NULL OR p <> seq""")
def bam_tofastq(spark, sf):
    return A.to_fastq(reads(spark, sf), show_unmapped=False, read2=False)


@query("bam_tag", R + f""" SELECT idx, qname||'_x' AS qname, CASE WHEN {MAPPED} THEN strand END AS xs, CASE WHEN {MAPPED} THEN chrom ELSE '*' END AS zr, CASE WHEN {MAPPED} THEN pos ELSE -1 END AS zp, CASE WHEN {MAPPED} THEN cigar ELSE '*' END AS zc, 'v:1' AS zq,
  CASE WHEN {MAPPED} AND cigar='12M300N20M' THEN chrom||':'||CAST(pos+12 AS STRING)||'>'||CAST(pos+312 AS STRING)
       WHEN {MAPPED} AND cigar='4S10M120N10M80N8M' THEN chrom||':'||CAST(pos+10 AS STRING)||'>'||CAST(pos+130 AS STRING)||','||chrom||':'||CAST(pos+140 AS STRING)||'>'||CAST(pos+220 AS STRING) END AS zj FROM r""")
def bam_tag(spark, sf):
    r = A.add_tag(A.tag_origin(A.tag_strand(A.tag_junctions(reads(spark, sf))), "ZR", "ZP", "ZC"), "ZQ:Z:v:1")
    r = A.add_suffix(r, "_x")
    return r.select("idx", "qname", G.tag("XS").alias("xs"), G.tag("ZR").alias("zr"), G.tag("ZP").cast("int").alias("zp"), G.tag("ZC").alias("zc"), G.tag("ZQ").alias("zq"), G.tag("ZJ").alias("zj"))


@query("bam_renamepair", RD + " SELECT idx, qname AS qname, CAST(idx%2 AS STRING) AS zn FROM rd")
def bam_renamepair(spark, sf):
    r = reads(spark, sf).withColumn("qname", F.concat("qname", F.lit("/"), (F.col("idx") % 2).cast("string")))
    return A.rename_pairs(r).select("idx", "qname", G.tag("ZN").alias("zn"))


@query("bam_removeclipping", RD + f""" , c AS (SELECT *, CASE WHEN {MAPPED} AND cigar='5S27M' THEN 5 WHEN {MAPPED} AND cigar LIKE '4S%' THEN 4 ELSE 0 END AS k FROM rd)
  SELECT idx, substr(seq, k+1) AS seq, CASE WHEN k > 0 THEN substr(cigar, 3) ELSE cigar END AS cigar, CASE WHEN k > 0 THEN CAST(k AS STRING) END AS za, CASE WHEN k > 0 THEN round(CAST(k AS DOUBLE)/length(seq), 6) END AS zc FROM c""")
def bam_removeclipping(spark, sf):
    return A.remove_clipping(reads(spark, sf)).select("idx", "seq", "cigar", G.tag("ZA").alias("za"), F.round(G.tag("ZC").cast("double"), 6).alias("zc"))


@query("bam_export", RD + " SELECT qname AS name, coalesce(chrom,'*') AS ref, pos+1 AS pos, cigar, flag AS flags, CAST(t_as AS STRING) AS AS_, 'AS:i:'||CAST(t_as AS STRING)||chr(9)||'IH:i:'||CAST(t_ih AS STRING)||chr(9)||'NM:i:'||CAST(t_nm AS STRING) AS tags FROM rd")
def bam_export(spark, sf):
    return A.export(reads(spark, sf), "-name", "-ref", "-pos", "-cigar", "-flags", "-tag:AS", "-tag:*").withColumnRenamed("AS", "AS_")


@query("bam_split", RD + " SELECT CAST(floor((row_number() OVER (ORDER BY idx) - 1)/7000) AS BIGINT) AS part, idx FROM rd")
def bam_split(spark, sf):
    return A.split_number(reads(spark, sf), 7000, tile=10**12).select("part", "idx")


@query("bam_best", RD + f" SELECT idx, rank() OVER (PARTITION BY qname ORDER BY {MAPPED} DESC, t_as DESC, t_nm) = 1 AS best FROM rd")
def bam_best(spark, sf):
    return A.best_mappings(reads(spark, sf)).select("idx", "best")


@query("bam_keepbest", RD + " SELECT idx FROM (SELECT idx, rank() OVER (PARTITION BY qname ORDER BY t_as DESC) AS k FROM rd) x WHERE k = 1")
def bam_keepbest(spark, sf):
    return A.keep_best(reads(spark, sf)).select("idx")


_MERGE = RD + f""" , f AS (SELECT *, CAST(idx%3 AS INT) AS source FROM rd), m AS (SELECT source, idx, rank() OVER (PARTITION BY qname ORDER BY t_as DESC, t_nm) AS k FROM f WHERE {MAPPED})
  , u AS (SELECT source, idx, row_number() OVER (PARTITION BY qname ORDER BY source, idx) AS k FROM f WHERE qname NOT IN (SELECT qname FROM f WHERE {MAPPED}))
  SELECT source, idx FROM m WHERE k = 1 UNION ALL SELECT source, idx FROM u WHERE k = 1"""


@query("bam_merge", _MERGE)
def bam_merge(spark, sf):
    r = reads(spark, sf)
    return A.merge_best([r.where(f"idx%3={i}") for i in range(3)]).select("source", "idx")


@query("bam_merge_keepall", RD + f""" SELECT source, idx FROM (SELECT CAST(idx%3 AS INT) AS source, idx, row_number() OVER (PARTITION BY qname, chrom, pos ORDER BY t_as DESC, t_nm, idx%3, idx) AS k FROM rd WHERE {MAPPED}) x WHERE k = 1""")
def bam_merge_keepall(spark, sf):
    r = reads(spark, sf)
    return A.merge_best([r.where(f"idx%3={i}") for i in range(3)], discard_unmapped=True, keep_all=True).select("source", "idx")


_PAIR = R + f""" , p AS (SELECT a.qname, a.idx AS idx1, b.idx AS idx2, a.chrom AS c1, b.chrom AS c2, a.pos AS p1, b.pos AS p2, a.t_as+b.t_as AS sa, a.t_nm+b.t_nm AS sn, greatest(b.aend-a.pos, a.aend-b.pos) AS size,
    CASE WHEN (a.flag & 4) <> 0 OR (b.flag & 4) <> 0 THEN 'unmapped' WHEN a.chrom <> b.chrom THEN 'chromosome' WHEN a.strand = b.strand THEN 'orientation' WHEN a.pos < b.pos AND a.strand='-' THEN 'direction' WHEN b.pos < a.pos AND b.strand='-' THEN 'direction'
      WHEN greatest(b.aend-a.pos, a.aend-b.pos) NOT BETWEEN 50 AND 200000 THEN 'size' END AS reason FROM r a JOIN r b ON a.qname = b.qname WHERE a.idx%2=1 AND b.idx%2=0)"""


@query("bam_pair", _PAIR + """ , k AS (SELECT *, rank() OVER (PARTITION BY qname ORDER BY sa DESC, sn, size) AS r FROM p WHERE reason IS NULL) SELECT qname, idx1, idx2, c1 AS chrom1, p1 AS pos1, p2 AS pos2, size, count(*) OVER (PARTITION BY qname) AS nh FROM k WHERE r = 1""")
def bam_pair(spark, sf):
    r = reads(spark, sf)
    return A.pair_reads(r.where("idx%2=1"), r.where("idx%2=0"), max_size=200_000)[0]


@query("bam_pair_failures", _PAIR + """ SELECT 1 AS "read", qname, c1 AS chrom, p1 AS pos, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM p GROUP BY qname, c1, p1 HAVING count(*) FILTER (reason IS NULL) = 0
  UNION ALL SELECT 2, qname, c2, p2, string_agg(DISTINCT reason, ',' ORDER BY reason) FROM p GROUP BY qname, c2, p2 HAVING count(*) FILTER (reason IS NULL) = 0""")
def bam_pair_failures(spark, sf):
    r = reads(spark, sf)
    return A.pair_reads(r.where("idx%2=1"), r.where("idx%2=0"), max_size=200_000)[1]


@query("bam_pcrdup", R + f""" , k AS (SELECT idx, qname, flag, row_number() OVER (PARTITION BY chrom, pos, tlen ORDER BY mapq DESC, idx) > 1 AS dup FROM r WHERE {MAPPED}) SELECT idx, CAST(CASE WHEN dup THEN flag | 1024 ELSE flag END AS INT) AS flag FROM k UNION ALL SELECT idx, flag FROM r WHERE NOT {MAPPED}""")
def bam_pcrdup(spark, sf):
    return A.mark_duplicates(reads(spark, sf)).select("idx", "flag")


@query("bam_pcrdup_counts", RD + f" SELECT chrom, pos, tlen, count(*) AS n FROM rd WHERE {MAPPED} GROUP BY ALL")
def bam_pcrdup_counts(spark, sf):
    return A.duplicate_counts(reads(spark, sf))


_INNER = R + f""" , m AS (SELECT *, row_number() OVER (PARTITION BY qname, idx%2 ORDER BY idx) AS k FROM r WHERE {MAPPED})
  , d AS (SELECT a.qname, CASE WHEN a.pos < b.pos THEN b.pos - a.aend ELSE a.pos - b.aend END AS distance, a.strand||'/'||b.strand AS orientation FROM m a JOIN m b ON a.qname=b.qname AND a.chrom=b.chrom WHERE a.k=1 AND b.k=1 AND a.idx%2=1 AND b.idx%2=0)"""


@query("bam_innerdist", _INNER + " SELECT * FROM d")
def bam_innerdist(spark, sf):
    r = reads(spark, sf)
    return A.inner_distance(r.where("idx%2=1"), r.where("idx%2=0"))[0]


@query("bam_innerdist_summary", _INNER + " SELECT count(*) AS n, round(avg(distance), 6) AS mean, round(stddev_samp(distance), 6) AS stdev, count(*) FILTER (orientation='+/+') AS plus_plus, count(*) FILTER (orientation='+/-') AS plus_minus, count(*) FILTER (orientation='-/+') AS minus_plus, count(*) FILTER (orientation='-/-') AS minus_minus FROM d")
def bam_innerdist_summary(spark, sf):
    r = reads(spark, sf)
    return A.inner_distance(r.where("idx%2=1"), r.where("idx%2=0"))[1].withColumns({"mean": F.round("mean", 6), "stdev": F.round("stdev", 6)})


@query("bam_nearest", RR + f""" , d AS (SELECT r.idx, CASE WHEN g.s <= r.aend AND r.pos <= g.e THEN 0 WHEN g.e < r.pos THEN r.pos - g.e ELSE g.s - r.aend END AS far, CASE WHEN g.s <= r.aend AND r.pos <= g.e THEN '' WHEN g.e < r.pos THEN 'up' ELSE 'down' END AS side
    FROM r JOIN rg g ON g.chrom=r.chrom AND g.strand=r.strand AND g.s <= r.aend + 1000 AND greatest(r.pos - 1000, 0) <= g.e WHERE {MAPPED}), k AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY far, side) AS n FROM d)
  SELECT r.idx, r.qname, CASE WHEN r.strand='+' AND side='down' OR r.strand='-' AND side='up' THEN -far ELSE far END AS distance FROM r LEFT JOIN (SELECT * FROM k WHERE n=1) k ON k.idx=r.idx WHERE {MAPPED}""")
def bam_nearest(spark, sf):
    return A.nearest_region(reads(spark, sf), bed(spark, sf, "rg"), 1000)


@query("bam_extract", RR + PIECES + " SELECT DISTINCT g.rid AS region, b.idx FROM rg g JOIN b ON g.chrom=b.chrom AND g.strand=b.strand AND b.s <= g.e AND g.s <= b.e")
def bam_extract(spark, sf):
    return A.extract(reads(spark, sf), bed(spark, sf, "rg").withColumnRenamed("rid", "region").withColumn("name", F.col("region").cast("string"))).select(F.col("region_name").cast("long").alias("region"), "idx")


@query("bam_junctioncount", R + f""" , j AS (SELECT qname, chrom||':'||CAST(pos + CASE WHEN cigar LIKE '12M%' THEN 12 ELSE 10 END AS STRING)||'-'||CAST(pos + CASE WHEN cigar LIKE '12M%' THEN 312 ELSE 130 END AS STRING) AS junction FROM r WHERE {MAPPED} AND cigar LIKE '%N%') SELECT junction, count(DISTINCT qname) AS "reads" FROM j GROUP BY junction""")
def bam_junctioncount(spark, sf):
    return A.junction_counts(reads(spark, sf))


_ONCE = RD + f""" , o AS (SELECT * FROM (SELECT *, CASE WHEN t_ih > 1 THEN row_number() OVER (PARTITION BY qname, t_ih > 1, {BIT(128)} ORDER BY idx) ELSE 1 END AS k FROM rd) x WHERE k = 1)"""


@query("bam_stats", _ONCE + f""" SELECT count(*) AS total, count(*) FILTER ({MAPPED}) AS mapped, count(*) FILTER (NOT {MAPPED}) AS unmapped, """ + ", ".join(f"count(*) FILTER ((flag & {b}) <> 0) AS flag_{b}" for b in G.LABELS) + f""", round(avg(CASE WHEN {MAPPED} AND tlen > 0 THEN tlen END), 6) AS tlen_mean, round(stddev_samp(CASE WHEN {MAPPED} AND tlen > 0 THEN tlen END), 6) AS tlen_stdev FROM o""")
def bam_stats(spark, sf):
    return A.read_stats(reads(spark, sf)).withColumns({"tlen_mean": F.round("tlen_mean", 6), "tlen_stdev": F.round("tlen_stdev", 6)})


@query("bam_stats_refs", _ONCE + f" SELECT chrom AS ref, count(*) AS n FROM o WHERE {MAPPED} GROUP BY chrom")
def bam_stats_refs(spark, sf):
    return A.reference_counts(reads(spark, sf))


@query("bam_tag_distribution", _ONCE + f""" , c AS (SELECT CAST(t_as AS BIGINT) AS value, count(*) AS n FROM o WHERE {MAPPED} GROUP BY t_as), s AS (SELECT unnest(range((SELECT min(value) FROM c), (SELECT max(value) FROM c) + 1)) AS value)
  SELECT s.value, coalesce(c.n, 0) AS n, round(sum(coalesce(c.n, 0)) OVER (ORDER BY s.value) * 100.0 / (SELECT count(*) FROM o WHERE {MAPPED}), 6) AS pct FROM s LEFT JOIN c ON c.value = s.value""")
def bam_tag_distribution(spark, sf):
    return A.tag_distribution(reads(spark, sf), "AS").withColumn("pct", F.round("pct", 6))


# --- pile-up ---------------------------------------------------------------------------------------

@query("bam_coverage", R + PIECES + """ , ev AS (SELECT chrom, s AS p, 1 AS d FROM b UNION ALL SELECT chrom, e, -1 FROM b), q AS (SELECT chrom, p, sum(d) AS d FROM ev GROUP BY chrom, p HAVING sum(d) <> 0)
  , w AS (SELECT chrom, p AS s, lead(p) OVER (PARTITION BY chrom ORDER BY p) AS e, sum(d) OVER (PARTITION BY chrom ORDER BY p) AS depth FROM q) SELECT chrom, CAST(s AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end", CAST(depth*0.5 AS DOUBLE) AS depth FROM w WHERE depth > 0""")
def bam_coverage(spark, sf):
    return P.read_coverage(reads(spark, sf), norm=0.5)


_MASKED = " WHERE (flag & 1796) = 0"


@query("bam_peakheight", RR + f""" , q AS (SELECT r.*, pos + a AS s, pos + z AS e FROM r JOIN (VALUES ('32M',0,32),('12M300N20M',0,12),('12M300N20M',312,332),('5S27M',0,27),('10M2I20M',0,30),('15M3D17M',0,35),('4S10M120N10M80N8M',0,10),('4S10M120N10M80N8M',130,140),('4S10M120N10M80N8M',220,228)) v(c,a,z) ON cigar=c{_MASKED})
  , h AS (SELECT g.rid, g.s AS gs, g.e AS ge, q.qname, greatest(g.s,q.s) AS s, least(g.e,q.e) AS e FROM rg g JOIN q ON q.chrom=g.chrom AND q.s < g.e AND g.s < q.e)
  , ev AS (SELECT rid, s AS p, 1 AS d FROM h UNION ALL SELECT rid, e, -1 FROM h), st AS (SELECT rid, p, sum(d) AS d FROM ev GROUP BY rid, p), dp AS (SELECT rid, sum(d) OVER (PARTITION BY rid ORDER BY p) AS depth FROM st), m AS (SELECT rid, max(depth) AS mx FROM dp GROUP BY rid), t AS (SELECT rid, count(DISTINCT qname) AS n, sum(e-s) AS total FROM h GROUP BY rid)
  SELECT g.rid, CAST(coalesce(mx,0) AS BIGINT) AS max_depth, coalesce(n,0) AS "reads", CAST(coalesce(total,0) AS BIGINT) AS total, round(coalesce(total,0)/(g.e-g.s), 6) AS mean FROM rg g LEFT JOIN m ON m.rid=g.rid LEFT JOIN t ON t.rid=g.rid""")
def bam_peakheight(spark, sf):
    return P.peak_heights(reads(spark, sf), bed(spark, sf, "rg")).select("rid", F.col("max_depth").cast("long").alias("max_depth"), "reads", F.col("total").cast("long").alias("total"), F.round("mean", 6).alias("mean"))


@query("bam_expressed", R + PIECES.replace(f"WHERE {MAPPED}", "WHERE (flag & 1540) = 0") + """ , o AS (SELECT *, CASE WHEN s > coalesce(max(e) OVER (PARTITION BY chrom, strand ORDER BY s, e, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 10, -1) THEN 1 ELSE 0 END AS fresh FROM b)
  , i AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom, strand ORDER BY s, e, idx) AS k FROM o) SELECT chrom, CAST(min(s) AS BIGINT) AS "start", CAST(max(e) AS BIGINT) AS "end", count(DISTINCT qname) AS score, strand FROM i GROUP BY chrom, strand, k HAVING count(DISTINCT qname) >= 2""")
def bam_expressed(spark, sf):
    return P.expressed_regions(reads(spark, sf))


_BASES = R + """ , p AS (SELECT r.*, pos + a AS s, q, z - a AS n FROM r JOIN """ + _PIECES + """ ON cigar = c WHERE (flag & 1540) = 0)
  , m AS (SELECT chrom, s + k AS pos, substr(seq, CAST(q + k + 1 AS BIGINT), 1) AS base, ascii(substr(qual, CAST(q + k + 1 AS BIGINT), 1)) - 33 AS bq, strand, t_ih, 'M' AS op FROM (SELECT *, unnest(range(n)) AS k FROM p) x)
  , d AS (SELECT chrom, pos + 15 + k AS pos, NULL AS base, NULL AS bq, strand, t_ih, 'D' AS op FROM (SELECT *, unnest(range(3)) AS k FROM r WHERE cigar='15M3D17M' AND (flag & 1540) = 0) x)
  , g AS (SELECT chrom, pos + a + k AS pos, NULL AS base, NULL AS bq, strand, t_ih, 'N' AS op FROM (SELECT r.*, a, unnest(range(n)) AS k FROM r JOIN (VALUES ('12M300N20M',12,300),('4S10M120N10M80N8M',10,120),('4S10M120N10M80N8M',140,80)) v(c,a,n) ON cigar=c WHERE (flag & 1540) = 0) x)
  , i AS (SELECT chrom, pos + 10 AS pos, substr(seq, 11, 2) AS base, CAST(floor((ascii(substr(qual,11,1)) + ascii(substr(qual,12,1)) - 66)/2) AS INT) AS bq, strand, t_ih, 'I' AS op FROM r WHERE cigar='10M2I20M' AND (flag & 1540) = 0)
  , every AS (SELECT * FROM m UNION ALL SELECT * FROM d UNION ALL SELECT * FROM g UNION ALL SELECT * FROM i)"""
_CALL = """ , t AS (SELECT chrom, pos, count(*) FILTER (op='M' AND bq>=5 AND base='A') AS a, count(*) FILTER (op='M' AND bq>=5 AND base='C') AS c, count(*) FILTER (op='M' AND bq>=5 AND base='G') AS g, count(*) FILTER (op='M' AND bq>=5 AND base='T') AS t,
    count(*) FILTER (op='D') AS dl, count(*) FILTER (op='N') AS gaps, count(*) FILTER (op='I' AND bq>=5) AS ins, count(DISTINCT base) FILTER (op='I' AND bq>=5) AS kinds, sum(t_ih) FILTER ((op IN ('M','I') AND bq>=5) OR op='D') AS ih,
    count(*) FILTER ((op IN ('M','I') AND bq>=5) OR op IN ('D','N')) AS listed, count(*) FILTER (((op IN ('M','I') AND bq>=5) OR op IN ('D','N')) AND strand='+') AS plus FROM every GROUP BY chrom, pos)
  , u AS (SELECT *, a+c+g+t AS n, greatest(a,c,g,t) AS best FROM t WHERE a+c+g+t+dl+kinds > 0)
  , v AS (SELECT *, CAST(a=best AS INT)+CAST(c=best AS INT)+CAST(g=best AS INT)+CAST(t=best AS INT) AS tops, greatest(CASE WHEN a<best THEN a ELSE 0 END, CASE WHEN c<best THEN c ELSE 0 END, CASE WHEN g<best THEN g ELSE 0 END, CASE WHEN t<best THEN t ELSE 0 END) AS second FROM u)
  SELECT chrom, pos+1 AS pos, n AS "count", CASE WHEN best=0 THEN 'N' ELSE concat_ws('/', CASE WHEN t=best THEN 'T' END, CASE WHEN g=best THEN 'G' END, CASE WHEN c=best THEN 'C' END, CASE WHEN a=best THEN 'A' END) END AS consensus,
    CASE WHEN best>0 AND tops=1 AND second>0 AND second/n>=0.01 THEN concat_ws('/', CASE WHEN t=second THEN 'T' END, CASE WHEN g=second THEN 'G' END, CASE WHEN c=second THEN 'C' END, CASE WHEN a=second THEN 'A' END) ELSE '' END AS minor,
    round(CAST(coalesce(ih,0) AS DOUBLE)/(n+dl+kinds), 6) AS ave_mappings, a AS n_a, c AS n_c, g AS n_g, t AS n_t, dl AS deletions, gaps, ins AS insertions, round(CAST(plus AS DOUBLE)/listed, 6) AS plus_share,
    round(CASE WHEN n=0 THEN 0 ELSE """ + "+".join(f"(({x}+{f}*sqrt(n))/(n+sqrt(n))/{f})*log2(({x}+{f}*sqrt(n))/(n+sqrt(n))/{f})" for x, f in (("a", 0.3), ("t", 0.3), ("c", 0.2), ("g", 0.2))) + """ END, 6) AS entropy FROM v"""


@query("bam_basecall", _BASES + _CALL)
def bam_basecall(spark, sf):
    c = P.base_calls(reads(spark, sf), min_qual=5)
    return c.select("chrom", "pos", "count", "consensus", "minor", F.round("ave_mappings", 6).alias("ave_mappings"), "n_a", "n_c", "n_g", "n_t", "deletions", "gaps", "insertions", F.round("plus_share", 6).alias("plus_share"), F.round("entropy", 6).alias("entropy"))


def reference(spark, sf, last=1000):
    """A made-up reference of five chromosomes of last + 1 chunks of 1024 bases: the character of each position follows from its chunk."""
    c = spark.range(1, 6).select(F.concat(F.lit("chr"), F.col("id").cast("string")).alias("chrom"), F.explode(F.sequence(F.lit(0), F.lit(last))).alias("chunk"))
    seq = F.repeat(F.translate(F.md5(F.concat("chrom", F.lit("."), F.col("chunk").cast("string"))), "0123456789abcdef", "ACGTACGTACGTACGT"), 32)
    return c.select("chrom", F.col("chunk").cast("long").alias("chunk"), seq.alias("seq"))


REF = "substr(translate(md5(chrom||'.'||CAST(CAST(floor(pos/1024) AS BIGINT) AS STRING)),'0123456789abcdef','ACGTACGTACGTACGT'), CAST((pos%1024)%32+1 AS BIGINT), 1)"


@query("bam_minorallele", _BASES + f""" , t AS (SELECT chrom, pos, {REF} AS rb, base, count(*) AS n FROM m GROUP BY chrom, pos, base), f AS (SELECT chrom, pos, rb, b AS base, coalesce(sum(n) FILTER (base=b), 0) AS n, sum(n) AS total FROM t, (VALUES ('A'),('C'),('G'),('T')) v(b) GROUP BY chrom, pos, rb, b HAVING sum(n) > 1)
  , k AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos, base = rb ORDER BY n DESC, base DESC) AS i FROM f), w AS (SELECT chrom, pos, rb, total, max(n) FILTER (base=rb) AS rc, max(base) FILTER (base<>rb AND i=1) AS ab, max(n) FILTER (base<>rb AND i=1) AS ac, max(n) FILTER (base<>rb AND i=2) AS bg FROM k GROUP BY chrom, pos, rb, total)
  SELECT chrom, pos+1 AS pos, rb AS refbase, ab AS altbase, CAST(total AS BIGINT) AS total, CAST(rc AS BIGINT) AS refcount, CAST(ac AS BIGINT) AS altcount, CAST(bg AS BIGINT) AS background, CAST(rc-bg AS BIGINT) AS refback, CAST(ac-bg AS BIGINT) AS altback, round(CASE WHEN rc-bg+ac-bg=0 THEN 0.0 ELSE (ac-bg)/(rc-bg+ac-bg) END, 6) + 0.0 AS altfreq FROM w""")
def bam_minorallele(spark, sf):
    return P.minor_alleles(reads(spark, sf), reference(spark, sf), min_count=1, chunk=1024).withColumn("altfreq", F.round("altfreq", 6))


@query("bam_mismatches_reference", _BASES.replace("(flag & 1540) = 0", MAPPED).replace("SELECT chrom, s + k AS pos, substr", "SELECT idx, chrom, s + k AS pos, substr").split(", d AS")[0] + f""" , x AS (SELECT idx, count(*) AS n FROM m WHERE base <> {REF} GROUP BY idx) SELECT r.idx, coalesce(x.n,0) + CASE WHEN cigar IN ('10M2I20M','15M3D17M') THEN 1 ELSE 0 END AS mismatches FROM r LEFT JOIN x ON x.idx=r.idx WHERE {MAPPED}""")
def bam_mismatches_reference(spark, sf):
    return P.mismatches_to_reference(reads(spark, sf), reference(spark, sf), 1024)


_CIMS = R + PIECES + """ , c AS (SELECT chrom, strand, p, count(*) AS n, sum(gone) AS d FROM (SELECT chrom, strand, unnest(range(s, e)) AS p, 0 AS gone FROM b WHERE (flag & 1540) = 0
    UNION ALL SELECT chrom, strand, unnest(range(pos + 15, pos + 18)), 1 FROM r WHERE cigar = '15M3D17M' AND (flag & 1540) = 0) x GROUP BY chrom, strand, p)
  , t AS (SELECT chrom, strand, p FROM c WHERE d/n > 0.2), far AS (SELECT chrom, strand, p, min(p) OVER (PARTITION BY chrom, strand ORDER BY p RANGE BETWEEN 20 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM t)
  , w AS (SELECT chrom, strand, min(p) AS s FROM t GROUP BY chrom, strand UNION ALL SELECT far.chrom, far.strand, far.next FROM w JOIN far ON far.chrom = w.chrom AND far.strand = w.strand AND far.p = w.s WHERE far.next IS NOT NULL)
  , z AS (SELECT w.chrom, w.strand, w.s, max(t.p) AS e FROM w JOIN t ON t.chrom = w.chrom AND t.strand = w.strand AND t.p >= w.s AND t.p < w.s + 20 GROUP BY w.chrom, w.strand, w.s)
  SELECT chrom, s AS "start", e AS "end", strand FROM z"""
_CIMS = _CIMS.replace("WITH rd", "WITH RECURSIVE rd", 1)



@query("bam_cims", _CIMS)
def bam_cims(spark, sf):
    return P.deletion_clusters(reads(spark, sf), 0.2)


# --- counts ----------------------------------------------------------------------------------------

_FR = RR + f""" , l AS (SELECT *, CASE WHEN (strand='-') = {BIT(128)} THEN '+' ELSE '-' END AS fs, CASE WHEN strand='-' THEN aend ELSE pos END AS spot FROM r WHERE {MAPPED})
  , h AS (SELECT g.rid, g.s AS gs, g.e AS ge, l.* FROM rg g JOIN l ON l.chrom=g.chrom AND l.fs=g.strand AND l.pos < g.e AND g.s < l.aend)"""


def model(spark, sf):
    return bed(spark, sf, "rg").withColumnRenamed("rid", "region")


@query("bam_count", _FR + f""" , t AS (SELECT count(*) FILTER (t_ih<=1) + count(DISTINCT CASE WHEN t_ih>1 THEN qname END) AS total FROM rd WHERE {MAPPED}), c AS (SELECT rid, count(*) AS n FROM h GROUP BY rid)
  SELECT g.rid AS region, g.e-g.s AS length, CAST(coalesce(n,0) AS DOUBLE) AS "count", round(coalesce(n,0)/(total/1e6), 6) AS cpm, round(coalesce(n,0)/((g.e-g.s)/1000.0)/(total/1e6), 6) AS rpkm FROM rg g LEFT JOIN c ON c.rid=g.rid, t""")
def bam_count(spark, sf):
    return N.region_counts(reads(spark, sf), model(spark, sf), norm="all", fpkm=True).withColumns({"cpm": F.round("cpm", 6), "rpkm": F.round("rpkm", 6)})


@query("bam_count_partial", _FR + ' SELECT g.rid AS region, round(coalesce(sum(1.0/t_ih), 0), 6) AS "count" FROM rg g LEFT JOIN h ON h.rid=g.rid GROUP BY g.rid')
def bam_count_partial(spark, sf):
    return N.region_counts(reads(spark, sf), model(spark, sf), multiple="partial").select("region", F.round("count", 6).alias("count"))


@query("bam_count_ignore", _FR + ' SELECT g.rid AS region, CAST(count(h.idx) FILTER (t_ih=1) AS DOUBLE) AS "count" FROM rg g LEFT JOIN h ON h.rid=g.rid GROUP BY g.rid')
def bam_count_ignore(spark, sf):
    return N.region_counts(reads(spark, sf), model(spark, sf), multiple="ignore").select("region", "count")


@query("bam_count_uniq_startonly", _FR + ' SELECT g.rid AS region, CAST(count(DISTINCT CASE WHEN spot BETWEEN gs AND ge THEN h.strand||CAST(spot AS STRING) END) AS DOUBLE) AS "count" FROM rg g LEFT JOIN h ON h.rid=g.rid GROUP BY g.rid')
def bam_count_uniq_startonly(spark, sf):
    return N.region_counts(reads(spark, sf), model(spark, sf), uniq=True, start_only=True).select("region", "count")


@query("bam_count_bins", R + f""" , t AS (SELECT 'chr'||CAST(k AS STRING) AS chrom, unnest(range(0, 1000000, 20000)) AS s FROM (VALUES (1),(2),(3),(4),(5)) v(k)) SELECT chrom||':'||CAST(s AS STRING)||':' AS region, CAST(20000 AS BIGINT) AS length, CAST((SELECT count(*) FROM r WHERE r.chrom=t.chrom AND pos < s+20000 AND s < aend AND {MAPPED}) AS DOUBLE) AS "count" FROM t""")
def bam_count_bins(spark, sf):
    sizes = spark.range(1, 6).select(F.concat(F.lit("chr"), F.col("id").cast("string")).alias("chrom"), F.lit(1_000_000).cast("long").alias("length"))
    return N.region_counts(reads(spark, sf), N.bin_model(sizes, 20_000), stranded=False, bin_size=20_000)


@query("bam_count_coverage", RR + PIECES + f""" , l AS (SELECT b.*, CASE WHEN (strand='-') = {BIT(128)} THEN '+' ELSE '-' END AS fs FROM b), h AS (SELECT g.rid, greatest(g.s,l.s) AS s, least(g.e,l.e) AS e FROM rg g JOIN l ON l.chrom=g.chrom AND l.fs=g.strand AND l.s < g.e AND g.s < l.e)
  , ps AS (SELECT rid, unnest(range(s, e)) AS p FROM h), d AS (SELECT rid, p, count(*) AS n FROM ps GROUP BY rid, p) SELECT g.rid AS region, round(coalesce(avg(n),0), 6) AS mean, round(CASE WHEN count(n) > 2 THEN stddev_samp(n) ELSE 0 END, 5) AS stdev, round(coalesce(median(n),0), 6) AS median FROM rg g LEFT JOIN d ON d.rid=g.rid GROUP BY g.rid""")
def bam_count_coverage(spark, sf):
    return N.region_depth(reads(spark, sf), model(spark, sf)).select("region", F.round("mean", 6).alias("mean"), F.round("stdev", 5).alias("stdev"), F.round("median", 6).alias("median"))


@query("bam_count_repeat_families", _FR + """ , z AS (SELECT rid, 'f'||CAST(rid%7 AS STRING) AS family, 'm'||CAST(rid%21 AS STRING) AS member, e-s AS n FROM rg), w AS (SELECT family, member, count(*) AS n FROM h JOIN z ON z.rid=h.rid GROUP BY ROLLUP(family, member)), y AS (SELECT family, member, sum(n) AS n FROM z GROUP BY ROLLUP(family, member))
  SELECT y.family, coalesce(y.member,'*') AS member, CAST(y.n AS BIGINT) AS size, CAST(coalesce(w.n,0) AS DOUBLE) AS "count" FROM y LEFT JOIN w ON w.family=y.family AND w.member IS NOT DISTINCT FROM y.member WHERE y.family IS NOT NULL""")
def bam_count_repeat_families(spark, sf):
    rep = bed(spark, sf, "rg").select("chrom", "start", "end", "strand", F.concat(F.lit("f"), (F.col("rid") % 7).cast("string")).alias("family"), F.concat(F.lit("m"), (F.col("rid") % 21).cast("string")).alias("member"))
    return N.repeat_families(reads(spark, sf), rep)


@query("cigar_functions", R + """ SELECT idx, CAST(aend-pos AS INT) AS ref_len, CASE WHEN cigar='*' THEN 0 WHEN cigar='10M2I20M' THEN 32 ELSE 32 END AS read_len, CASE WHEN cigar='*' THEN '' ELSE cigar END AS text, cigar IN ('12M300N20M','4S10M120N10M80N8M') AS spliced FROM r""")
def cigar_functions(spark, sf):
    o = C.parse(F.col("cigar"))
    return reads(spark, sf).select("idx", C.ref_length(o).alias("ref_len"), C.read_length(o).alias("read_len"), C.to_string(C.clean(o)).alias("text"), C.junction_valid(o)["valid"].alias("spliced"))


@query("bam_cims_fasta", cte("rg") + ", x AS (SELECT rid, chrom, strand, s, e, s-12 AS a, e+12 AS z FROM rg WHERE s >= 12 AND e < 1000000), q AS (" + spelled("x", "rid, chrom, strand, s, e, a, z", "a", "z") + """)
  , c AS (SELECT *, substr(q, 1, 12)||lower(substr(q, 13, e-s))||substr(q, 13+e-s, 12) AS y FROM q) SELECT chrom||':'||CAST(a AS STRING)||strand||CAST(z AS STRING) AS name, CASE WHEN strand='-' THEN translate(reverse(y), 'ACGTacgt', 'TGCAtgca') ELSE y END AS seq FROM c""")
def bam_cims_fasta(spark, sf):
    """Regions in place of clusters, with their flanks."""
    return P.cluster_flanks(bed(spark, sf, "rg").where("start >= 12 and end < 1000000"), reference(spark, sf), 12, 1024)

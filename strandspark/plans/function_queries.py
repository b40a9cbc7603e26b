"""Column functions and conversions that the other queries don't reach."""

from pyspark.sql import functions as F

from ..functions import flags as G
from ..functions import sequence as S
from ..functions import stats as T
from ..operators import align as A
from ..operators import bed as B
from ..operators import count as N
from ..operators import fasta as FA
from ..operators import variants as V
from .read_queries import MAPPED, reference
from .registry import query
from .views import bed, cte, fastq, reads, spelled

FQ = cte("fq")


@query("sequence_functions", FQ + """ SELECT idx, reverse(translate(seq,'ACGTN','TGCAN')) AS rc, length(seq)-length(replace(seq,'N','')) AS wild, ascii(substr(qual,1,1))-33 AS first_quality, 'x_F3' AS trimmed FROM fq""".replace("'x_F3' AS trimmed", "'x' AS trimmed"))
def sequence_functions(spark, sf):
    f = fastq(spark, sf)
    return f.select("idx", S.revcomp(F.col("seq"), strict=True).alias("rc"), S.wildcards(F.col("seq")).cast("long").alias("wild"), S.phred(F.col("qual"))[0].alias("first_quality"), S.trim_name(F.lit("x_F3_z")).alias("trimmed"))


@query("solexa_quality", FQ + " SELECT idx, array_to_string(list_transform(string_split(qual, ''), lambda c: chr(CAST(floor(10*log10(pow(10.0, floor((ascii(c)-64)/10)) + 1)) AS INT) + 33)), '') AS qual FROM fq")
def solexa_quality(spark, sf):
    return fastq(spark, sf).select("idx", S.solexa_quality(F.col("qual")).alias("qual"))


@query("poisson", "SELECT p_partkey, round(pow(1.5, p_size%15)*exp(-1.5)/factorial(p_size%15), 9) AS p, round(coalesce((SELECT sum(pow(1.5, i)*exp(-1.5)/factorial(CAST(i AS INT))) FROM range(1, p_size%15+1) t(i)), 0), 9) AS below FROM part")
def poisson(spark, sf):
    x = (F.col("p_size") % 15).cast("int")
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.round(T.poisson(x, F.lit(1.5)), 9).alias("p"), F.round(T.poisson_cumulative(x, F.lit(1.5)), 9).alias("below"))


@query("log_likelihood", """WITH c AS (SELECT p_partkey, p_size AS a, p_partkey%7 AS c, p_partkey%11 AS g, p_partkey%5 AS t FROM part)
  SELECT p_partkey, round(ln((a+0.3*sqrt(a+c+g+t))/(a+c+g+t+sqrt(a+c+g+t))/0.3), 9) + 0.0 AS a, round(ln((c+0.2*sqrt(a+c+g+t))/(a+c+g+t+sqrt(a+c+g+t))/0.2), 9) + 0.0 AS c FROM c""")
def log_likelihood(spark, sf):
    k = F.col("p_partkey")
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", T.log_likelihood(F.col("p_size").cast("long"), k % 7, k % 11, k % 5).alias("l"))
    return p.select("p_partkey", F.round("l.A", 9).alias("a"), F.round("l.C", 9).alias("c"))


@query("binomial_interval")
def binomial_interval(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select("p_partkey", T.confidence(F.col("p_size") + 10, F.col("p_size") % 10, 20).alias("ci")).select("p_partkey", "ci.low", "ci.high")


@query("bam_convertregion", cte("rd") + """ , c AS (SELECT idx, idx%90 AS p FROM rd), v AS (SELECT *, p < 50 AND p + 32 > 50 AND 50 - p >= 4 AND p - 18 >= 4 AS ok FROM c)
  SELECT idx, CASE WHEN ok THEN 'chr1' END AS chrom, CAST(CASE WHEN ok THEN 1000 + p ELSE -1 END AS INT) AS pos, CASE WHEN ok THEN CAST(50-p AS STRING)||'M150N'||CAST(p-18 AS STRING)||'M' ELSE '*' END AS cigar, CASE WHEN ok THEN '1' END AS nh FROM v""")
def bam_convertregion(spark, sf):
    r = reads(spark, sf).withColumns({"qname": F.col("idx").cast("string"), "flag": F.lit(0), "chrom": F.lit("chr1:1000-1050,1200-1300"), "pos": (F.col("idx") % 90).cast("int"), "cigar": F.lit("32M")})
    return A.convert_regions(r).select("idx", "chrom", "pos", "cigar", G.tag("NH").alias("nh"))


@query("repeats_to_fasta", cte("rg") + ", b AS (" + spelled("(SELECT * FROM rg WHERE rid%3=1) z", "rid, chrom, s, e, strand") + """)
  SELECT 'f1|m'||CAST(rid%21 AS STRING)||'|'||chrom||':'||CAST(s AS STRING)||'-'||CAST(e AS STRING)||'['||strand||']' AS name, regexp_replace(regexp_replace(q, '(.{50})', '\\1'||chr(10), 'g'), chr(10)||'$', '') AS seq FROM b""")
def repeats_to_fasta(spark, sf):
    """Family f1, which a third of the regions are of."""
    return FA.from_repeats(_repeats(bed(spark, sf, "rg")), reference(spark, sf), "f1", 1024)


def _repeats(b):
    return b.select("chrom", "start", "end", "strand", F.concat(F.lit("f"), (F.col("rid") % 3).cast("string")).alias("family"), F.concat(F.lit("m"), (F.col("rid") % 21).cast("string")).alias("member"))


@query("bam_filter_reference_dbsnp")
def bam_filter_reference_dbsnp(spark, sf):
    r, ref = reads(spark, sf), reference(spark, sf)
    found = V.reference_variants(r, ref, 1024)
    snp = found.where("op = 'M' and pos % 2 = 0").select("chrom", F.col("pos").alias("chromStart"), F.lit("+").alias("strand"), F.col("bases").alias("observed"), F.lit("single").alias("clazz")).distinct()
    return V.filter_known_mismatches(r, 12, snp, found).select("idx", G.tag("ZS").alias("known"))


@query("bam_mapped_total", cte("rd") + f" SELECT count(*) FILTER (t_ih<=1) + count(DISTINCT CASE WHEN t_ih>1 THEN qname END) AS total FROM rd WHERE {MAPPED}")
def bam_mapped_total(spark, sf):
    return N.mapped_total(reads(spark, sf))


_PRIMERS = """WITH ref AS (SELECT 'chr'||CAST(c AS STRING) AS chrom, k, repeat(translate(md5('chr'||CAST(c AS STRING)||'.'||CAST(k AS STRING)),'0123456789abcdef','ACGTACGTACGTACGT'), 32) AS q FROM range(1, 6) a(c), range(0, 201) b(k))
  , wide AS (SELECT chrom, k, q, q||substr(coalesce(lead(q) OVER (PARTITION BY chrom ORDER BY k), ''), 1, 64) AS w FROM ref)
  , p AS (SELECT chrom||'p'||CAST(k AS STRING) AS name, substr(q, 1, 18) AS f, substr(q, 100, 18) AS r FROM ref), here AS (SELECT chrom, k*1024+i-1 AS pos, substr(w, i, 18) AS h FROM (SELECT chrom, k, w, unnest(range(1, 1025)) AS i FROM wide) x WHERE length(substr(w, i, 18)) = 18)
  , probe AS (SELECT name, 'f' AS z, f AS h FROM p UNION ALL SELECT name, 'r', r FROM p UNION ALL SELECT name, 'R', reverse(translate(r,'ACGT','TGCA')) FROM p UNION ALL SELECT name, 'F', reverse(translate(f,'ACGT','TGCA')) FROM p)
  , s AS (SELECT name, z, chrom, pos FROM here JOIN probe USING (h))
  , m AS (SELECT a.chrom, a.pos AS s, b.pos + 18 AS e, a.name, CASE WHEN a.z='f' THEN '+' ELSE '-' END AS strand FROM s a JOIN s b ON b.name=a.name AND b.chrom=a.chrom AND (a.z='f' AND b.z='r' OR a.z='R' AND b.z='F') AND b.pos >= a.pos AND b.pos + 18 - a.pos <= 120)
  , n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY chrom, s, e, strand) - 1 AS i FROM m) SELECT chrom, s AS "start", e AS "end", CASE WHEN i > 0 THEN name||'.'||CAST(i AS STRING) ELSE name END AS name, strand FROM n"""


@query("primer_sites", _PRIMERS)
def primer_sites(spark, sf):
    ref = reference(spark, sf, 200)
    p = ref.select(F.concat("chrom", F.lit("p"), F.col("chunk").cast("string")).alias("name"), F.substring("seq", 1, 18).alias("fwd"), S.revcomp(F.substring("seq", 100, 18)).alias("rev"))
    return B.primer_sites(p, ref, 120, 1024)

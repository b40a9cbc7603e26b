"""Sequencing-shaped views of the driver's tables.

Each view is one SELECT that Spark and DuckDB read alike: arithmetic on keys gives positions, strands and
CIGAR strings, digests give sequences. The queries run the library on the views; their SQL names the same
views as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POS = "(l_orderkey*7919+l_partkey*104729+l_linenumber*31)%1000000"
#: Lines of an order may share their number, so parts, suppliers and quantities go into the key.
_KEY = "(((l_orderkey*8+l_linenumber)*20000+l_partkey)*1000+l_suppkey)*64+CAST(l_quantity AS INT)"
_SEQ = "translate(md5(CAST(l_orderkey AS STRING)||'-'||CAST(l_linenumber AS STRING)),'0123456789abcdef','ACGTACGTACGTACGT')"
_QUAL = "translate(md5(CAST(l_partkey AS STRING)||'+'||CAST(l_linenumber AS STRING)),'0123456789abcdef','!#%+05:?ABDEFGHI')"

VIEWS = {
    "iv": f"""SELECT {_KEY} AS rid, 'chr'||CAST(1+l_suppkey%5 AS STRING) AS chrom, {_POS} AS s,
        {_POS}+20+CAST(l_quantity AS INT)*3 AS e, 'n'||CAST(l_partkey%50 AS STRING) AS name, l_quantity AS score,
        CASE WHEN l_linestatus='O' THEN '+' ELSE '-' END AS strand FROM lineitem""",
    "rg": """SELECT o_orderkey AS rid, 'chr'||CAST(1+o_custkey%5 AS STRING) AS chrom, (o_orderkey*15485863+o_custkey*32452843)%1000000 AS s,
        (o_orderkey*15485863+o_custkey*32452843)%1000000+50+(o_orderkey%37)*10 AS e, 'g'||CAST(o_orderkey%100 AS STRING) AS name,
        CAST(o_orderkey%1500 AS DOUBLE)+0.5 AS score, CASE WHEN o_orderkey%2=0 THEN '+' ELSE '-' END AS strand FROM orders""",
    "rd": f"""SELECT {_KEY} AS idx, 'r'||CAST(l_partkey AS STRING) AS qname,
        CAST(CASE WHEN l_linenumber=7 THEN 4 ELSE CASE WHEN l_linestatus='O' THEN 16 ELSE 0 END + CASE WHEN l_suppkey%11=3 THEN 256 ELSE 0 END + CASE WHEN l_suppkey%13=5 THEN 1024 ELSE 0 END END
          + CASE WHEN l_orderkey%4=0 THEN 0 ELSE 1 + CASE WHEN l_partkey%2=0 THEN 64 ELSE 128 END + CASE WHEN l_partkey%3=0 THEN 2 ELSE 0 END + CASE WHEN l_partkey%5=0 THEN 32 ELSE 0 END + CASE WHEN l_partkey%19=0 THEN 8 ELSE 0 END END AS INT) AS flag,
        CASE WHEN l_linenumber=7 THEN NULL ELSE 'chr'||CAST(1+l_suppkey%5 AS STRING) END AS chrom, CAST(CASE WHEN l_linenumber=7 THEN -1 ELSE {_POS} END AS INT) AS pos,
        CAST(l_quantity AS INT) AS mapq, CASE l_linenumber%7 WHEN 1 THEN '32M' WHEN 2 THEN '12M300N20M' WHEN 3 THEN '5S27M' WHEN 4 THEN '10M2I20M' WHEN 5 THEN '15M3D17M' WHEN 6 THEN '4S10M120N10M80N8M' ELSE '*' END AS cigar,
        CAST((l_orderkey%9)*50 AS INT) AS tlen, {_SEQ} AS seq, {_QUAL} AS qual, CAST(l_quantity AS INT) AS t_as, CAST(l_linenumber AS INT) AS t_nm, CAST(1+l_linenumber%3 AS INT) AS t_ih FROM lineitem""",
    "fq": """SELECT event_id AS idx, 'q'||CAST(event_id-(event_id%5)%2 AS STRING) AS name, event_type AS comment,
        substr(translate(md5(props||CAST(event_id AS STRING)),'0123456789abcdef','ACGTACGTACGTACGN'),1,CAST(20+event_id%13 AS INT)) AS seq,
        substr(translate(md5(CAST(event_id*7 AS STRING)),'0123456789abcdef','##%+05:?ABDEFGHI'),1,CAST(20+event_id%13 AS INT)) AS qual FROM events""",
    "gx": """SELECT l_orderkey*10+l_linenumber AS idx, 'gene'||CAST(l_orderkey AS STRING) AS gid, 'chr'||CAST(1+l_orderkey%5 AS STRING) AS chrom, 't'||CAST(l_orderkey AS STRING)||'.'||CAST(l_linenumber%2 AS STRING) AS tid,
        CASE WHEN l_orderkey%2=0 THEN '+' ELSE '-' END AS strand, 'exon' AS feature, (l_orderkey*7919)%5000000+l_linenumber*150+l_partkey%100 AS s, (l_orderkey*7919)%5000000+l_linenumber*150+l_partkey%100+60+l_suppkey%60 AS e FROM lineitem
        UNION ALL SELECT l_orderkey*10+l_linenumber+500000000 AS idx, 'gene'||CAST(l_orderkey AS STRING) AS gid, 'chr'||CAST(1+l_orderkey%5 AS STRING) AS chrom, 't'||CAST(l_orderkey AS STRING)||'.'||CAST(l_linenumber%2 AS STRING) AS tid,
        CASE WHEN l_orderkey%2=0 THEN '+' ELSE '-' END AS strand, 'CDS' AS feature, (l_orderkey*7919)%5000000+l_linenumber*150+l_partkey%100+10 AS s, (l_orderkey*7919)%5000000+l_linenumber*150+l_partkey%100+50+l_suppkey%60 AS e FROM lineitem WHERE l_linenumber BETWEEN 2 AND 4""",
    "ref": """SELECT p_partkey AS k, 'ref'||CAST(p_partkey%4 AS STRING) AS chrom, (p_partkey-p_partkey%4) AS chunk4, translate(md5(p_name||CAST(p_partkey AS STRING)),'0123456789abcdef','ACGTACGTACGTACGT') AS seq FROM part""",
}
TABLES = {"iv": "lineitem", "rg": "orders", "rd": "lineitem", "fq": "events", "gx": "lineitem", "ref": "part"}


def cte(*names: str) -> str:
    """WITH clause that defines views for a statement."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)


def spelled(rows: str, key: str, start: str = "s", end: str = "e", last: int = 1000) -> str:
    """SELECT of key and q, the made-up reference (read_queries.reference) from start to end: pieces by chunk of 1024 bases, each spelled at once."""
    seq = "repeat(translate(md5(chrom||'.'||CAST(k AS STRING)),'0123456789abcdef','ACGTACGTACGTACGT'), 32)"
    lo, hi = f"greatest({start}, k*1024)", f"least({end}, (k+1)*1024)"
    return f"""SELECT {key}, string_agg(substr({seq}, CAST({lo}-k*1024+1 AS BIGINT), CAST({hi}-{lo} AS BIGINT)), '' ORDER BY k) AS q
      FROM (SELECT *, unnest(range({start}//1024, least(({end}-1)//1024, {last})+1)) AS k FROM {rows}) pieces GROUP BY {key}"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base = spark.read.parquet(f"{sf_dir}/{TABLES[name]}.parquet")
    return spark.sql(re.sub(rf"FROM {TABLES[name]}\b", "FROM {t}", VIEWS[name]).replace("{t}", "{base}"), base=base)


def bed(spark: SparkSession, sf_dir: str, name: str = "iv") -> DataFrame:
    """iv or rg as intervals."""
    return view(spark, sf_dir, name).select("rid", "chrom", F.col("s").alias("start"), F.col("e").alias("end"), "name", "score", "strand")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda k, c: (F.lit(k), F.struct(F.lit("i").alias("t"), F.col(c).cast("string").alias("v")))
    tags = F.create_map(*t("AS", "t_as"), *t("NM", "t_nm"), *t("IH", "t_ih"))
    none = F.lit(None)
    return view(spark, sf_dir, "rd").select("idx", "qname", "flag", "chrom", "pos", "mapq", "cigar", none.cast("string").alias("rnext"), none.cast("int").alias("pnext"), "tlen", "seq", "qual", tags.alias("tags"))


def fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fq")


def gtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    attrs = F.create_map(F.lit("gene_id"), F.col("gid"), F.lit("gene_name"), F.col("gid"), F.lit("transcript_id"), F.col("tid"))
    text = F.concat(F.lit('gene_id "'), "gid", F.lit('"; transcript_id "'), "tid", F.lit('";'))
    return view(spark, sf_dir, "gx").select("idx", "chrom", F.lit("x").alias("source"), "feature", F.col("s").alias("start"), F.col("e").alias("end"), F.lit(".").alias("score"), "strand", F.lit(".").alias("frame"), attrs.alias("attrs"), text.alias("attributes"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.genes import transcripts as build

    return build(gtf(spark, sf_dir))

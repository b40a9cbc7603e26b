"""Read operators over derived FASTQ records."""

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import fasta as FA
from ..operators import fastq as Q
from .registry import query
from .views import cte, fastq

FQ = cte("fq")
NOTE = lambda n: f"comment||' #{n}'"


def both(df):
    return df.select("idx", "name", "comment", "seq", "qual")


@query("fastq_filter_wildcard", FQ + " SELECT idx, seq FROM fq WHERE length(seq) - length(replace(replace(replace(seq,'N',''),'.',''),'4','')) <= 1")
def fastq_filter_wildcard(spark, sf):
    return Q.filter_wildcards(fastq(spark, sf), 1).select("idx", "seq")


@query("fastq_filter_size", FQ + " SELECT idx FROM fq WHERE length(qual) >= 27")
def fastq_filter_size(spark, sf):
    return Q.filter_size(fastq(spark, sf), 27).select("idx")


@query("fastq_filter_whitelist", FQ + " SELECT idx FROM fq WHERE name IN (SELECT name FROM fq WHERE idx%7=2)")
def fastq_filter_whitelist(spark, sf):
    f = fastq(spark, sf)
    return Q.filter_names(f, f.where("idx%7=2").select(F.concat(F.lit("@"), "name").alias("name"))).select("idx")


_RUN = FQ + """ , n AS (SELECT *, CASE WHEN name = lag(name) OVER (ORDER BY idx) THEN 0 ELSE 1 END AS fresh FROM fq), r AS (SELECT *, sum(fresh) OVER (ORDER BY idx) AS run FROM n)
  , k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY idx) - 1 AS nth, count(*) OVER (PARTITION BY run) AS c FROM r)"""


@query("fastq_filter_paired", _RUN + " SELECT idx FROM k WHERE nth < c - c%2")
def fastq_filter_paired(spark, sf):
    return Q.filter_pairs(fastq(spark, sf)).select("idx")


@query("fastq_filter_quality", FQ + f""" , w AS (SELECT idx, min(i) AS i FROM (SELECT idx, i, (SELECT sum(ascii(substr(qual, CAST(i+j+1 AS BIGINT), 1)) - 33) FROM range(5) t(j)) AS total FROM (SELECT *, unnest(range(greatest(length(qual)-5, 0))) AS i FROM fq) x) y WHERE total < 5*18 GROUP BY idx)
  SELECT fq.idx, CASE WHEN i IS NULL THEN comment ELSE {NOTE("qual")} END AS comment, CASE WHEN i IS NULL THEN seq ELSE substr(seq, 1, CAST(i+4 AS BIGINT)) END AS seq, CASE WHEN i IS NULL THEN qual ELSE substr(qual, 1, CAST(i+4 AS BIGINT)) END AS qual FROM fq LEFT JOIN w ON w.idx=fq.idx""")
def fastq_filter_quality(spark, sf):
    return both(Q.filter_quality_window(fastq(spark, sf), 18, 5)).drop("name")


@query("fastq_filter_suffixqual", FQ + f" SELECT idx, CASE WHEN rtrim(qual,'I') <> qual THEN {NOTE('suff')} ELSE comment END AS comment, substr(seq, 1, length(rtrim(qual,'I'))) AS seq, rtrim(qual,'I') AS qual FROM fq")
def fastq_filter_suffixqual(spark, sf):
    return both(Q.filter_suffix_quality(fastq(spark, sf), "I")).drop("name")


@query("fastq_filter_truncate", FQ + f" SELECT idx, CASE WHEN length(qual) > 25 THEN {NOTE('trunc')} ELSE comment END AS comment, substr(seq,1,25) AS seq, substr(qual,1,25) AS qual FROM fq")
def fastq_filter_truncate(spark, sf):
    return both(Q.filter_truncate(fastq(spark, sf), 25)).drop("name")


@query("fastq_filter_prefix", FQ + f" SELECT idx, {NOTE('trunc')} AS comment, substr(seq,4) AS seq, substr(qual,4) AS qual FROM fq")
def fastq_filter_prefix(spark, sf):
    return both(Q.filter_prefix(fastq(spark, sf), 3)).drop("name")


_ADAPTER = FQ + """ , t AS (SELECT idx, name, comment, seq, qual, list_transform(range(4, length(seq)+1), lambda i: {'i': i, 'm': least(i, 8), 'n': len(list_filter(range(1, least(i, 8)+1), lambda k: substr('ACGTNACG', k, 1) IN ('N', substr(seq, length(seq)-i+k, 1)))), 'best': 0::BIGINT, 'at': 0::BIGINT, 'done': false}) AS l FROM fq)
  , z AS (SELECT idx, name, comment, seq, qual, list_reduce(list_prepend({'i': 0::BIGINT, 'm': 0::BIGINT, 'n': 0::BIGINT, 'best': 0::BIGINT, 'at': 0::BIGINT, 'done': false}, l), lambda a, x: {'i': x.i, 'm': x.m, 'n': x.n,
      'best': CASE WHEN NOT a.done AND x.n >= x.m*0.8 AND x.n >= a.best THEN x.n ELSE a.best END, 'at': CASE WHEN NOT a.done AND x.n >= x.m*0.8 AND x.n >= a.best THEN x.i ELSE a.at END,
      'done': a.done OR (NOT (x.n >= x.m*0.8 AND x.n >= a.best) AND a.best > 0)}) AS r FROM t), c AS (SELECT idx, name, comment, seq, qual, CASE WHEN r.best > 0 THEN r.at ELSE 0 END AS i FROM z)
  SELECT idx, name, comment||CASE WHEN i > 0 THEN ' #trim' ELSE '' END AS comment, substr(seq, 1, length(seq)-i) AS seq, substr(qual, 1, length(qual)-i) AS qual FROM c WHERE i = 0 OR length(qual) > i"""


@query("fastq_filter_adapter", _ADAPTER)
def fastq_filter_adapter(spark, sf):
    return both(Q.filter_adapter(fastq(spark, sf), "ACGTNACG", 0.8, 4))


@query("fastq_filter_chain", FQ + " SELECT idx, substr(seq, 1, 24) AS seq FROM fq WHERE length(qual) >= 22 AND length(seq) - length(replace(seq,'N','')) <= 2")
def fastq_filter_chain(spark, sf):
    out, _ = Q.filter_chain(fastq(spark, sf), lambda d: Q.filter_size(d, 22), lambda d: Q.filter_wildcards(d, 2), lambda d: Q.filter_truncate(d, 24))
    return out.select("idx", "seq")


@query("fastq_tag", FQ + " SELECT idx, 'a_'||name||'/1' AS name FROM fq")
def fastq_tag(spark, sf):
    return Q.tag_names(fastq(spark, sf), "a_", "/1").select("idx", "name")


@query("fastq_revcomp", FQ + " SELECT idx, reverse(translate(seq,'ACGT','TGCA')) AS seq, reverse(qual) AS qual FROM fq")
def fastq_revcomp(spark, sf):
    return Q.revcomp_reads(fastq(spark, sf)).select("idx", "seq", "qual")


@query("fastq_truncate", FQ + " SELECT idx, substr(seq,1,21) AS seq, substr(qual,1,21) AS qual FROM fq")
def fastq_truncate(spark, sf):
    return Q.truncate(fastq(spark, sf), 21).select("idx", "seq", "qual")


@query("fastq_tile", FQ + """ SELECT idx, CAST(p/5 AS INT) AS part, comment||' #tile:'||CAST(p AS STRING)||','||CAST(p+12 AS STRING) AS comment, substr(seq, CAST(p+1 AS BIGINT), 12) AS seq, substr(qual, CAST(p+1 AS BIGINT), 12) AS qual FROM (SELECT *, unnest(range(0, length(seq)-12, 5)) AS p FROM fq) x""")
def fastq_tile(spark, sf):
    return Q.tiles(fastq(spark, sf), 12, 5).select("idx", "part", "comment", "seq", "qual")


@query("fastq_tofasta", FQ + " SELECT idx, name, seq FROM fq")
def fastq_tofasta(spark, sf):
    return Q.to_fasta(fastq(spark, sf)).select("idx", "name", "seq")


@query("fastq_tofasta_qual", FQ + " SELECT idx, array_to_string(list_transform(string_split(qual, ''), lambda x: ascii(x) - 33), ' ') AS seq FROM fq")
def fastq_tofasta_qual(spark, sf):
    return Q.to_fasta(fastq(spark, sf), True).select("idx", "seq")


@query("fastq_names", FQ + " SELECT name||' '||comment AS name FROM fq")
def fastq_names(spark, sf):
    return Q.names(fastq(spark, sf), True)


@query("fastq_convertqual", FQ + " SELECT idx, array_to_string(list_transform(string_split(qual, ''), lambda x: chr(ascii(x) + 31 - 31)), '') AS qual, '' AS comment FROM fq")
def fastq_convertqual(spark, sf):
    up = fastq(spark, sf).withColumn("qual", S.shift_quality(F.col("qual"), 31))
    return Q.convert_quality(up).select("idx", "qual", "comment")


@query("fastq_csencode", FQ + " SELECT idx, seq, qual FROM fq WHERE idx%2=0 UNION ALL SELECT idx, substr(seq, 2), substr(qual, 2) FROM fq WHERE idx%2=1")
def fastq_csencode(spark, sf):
    colours = F.translate("seq", "ACGTN", "0123.")
    f = fastq(spark, sf).withColumn("seq", F.when(F.col("idx") % 2 == 1, F.concat(F.lit("T"), colours)).otherwise(colours))
    return Q.encode_colours(f).select("idx", "seq", "qual")


@query("fastq_fromfasta", FQ + " SELECT idx, name, seq, qual FROM fq")
def fastq_fromfasta(spark, sf):
    f = fastq(spark, sf)
    name = F.concat("name", F.lit("_F3"))
    return Q.from_fasta(f.withColumn("name", name), Q.to_fasta(f.withColumn("name", name), True)).select("idx", "name", "seq", "qual")


@query("fastq_fromfasta_common", FQ + " SELECT idx, name||'/1' AS name, repeat('5', length(seq)) AS qual FROM fq")
def fastq_fromfasta_common(spark, sf):
    return Q.from_fasta(fastq(spark, sf), suffix="/1", common=20).select("idx", "name", "qual")


@query("fastq_fromqseq", FQ + """ , q AS (SELECT *, replace(seq,'N','.') AS s2, qual||'BB' AS q2, seq||'NN' AS sx FROM fq WHERE idx%3 <> 0), u AS (SELECT *, rtrim(array_to_string(list_transform(string_split(qual,''), lambda x: chr(ascii(x)+31)), '')||'BB', 'B') AS k FROM q)
  SELECT idx, 'm_1:2:3:4:'||CAST(idx AS STRING)||'/1' AS name, substr(sx, 1, length(k)) AS seq, array_to_string(list_transform(string_split(k,''), lambda x: chr(ascii(x)-31)), '') AS qual FROM u WHERE length(k) >= 20""")
def fastq_fromqseq(spark, sf):
    f = fastq(spark, sf)
    rows = f.select(
        "idx", F.lit("m").alias("machine"), F.lit("1").alias("run"), F.lit("2").alias("lane"), F.lit("3").alias("tile"), F.lit("4").alias("x"), F.col("idx").cast("string").alias("y"), F.lit("0").alias("index"), F.lit("1").alias("read"),
        F.concat(F.translate("seq", "N", "."), F.lit("..")).alias("seq"), F.concat(S.shift_quality(F.col("qual"), 31), F.lit("BB")).alias("qual"), F.when(F.col("idx") % 3 == 0, "0").otherwise("1").alias("qc"),
    )
    return Q.from_qseq(rows, min_length=20, trim=True).select("idx", "name", "seq", "qual")


@query("fastq_tobam", FQ + " SELECT idx*2 AS idx, name AS qname, 77 AS flag, seq FROM fq UNION ALL SELECT idx*2+1, name, 141, reverse(seq) FROM fq")
def fastq_tobam(spark, sf):
    f = fastq(spark, sf)
    return Q.to_reads(f, f.withColumn("seq", F.reverse("seq"))).select("idx", "qname", "flag", "seq")


@query("fastq_split", _RUN + " SELECT idx, CAST((run-1)%4 AS BIGINT) AS part FROM k")
def fastq_split(spark, sf):
    return Q.split_round_robin(fastq(spark, sf), 4).select("idx", "part")


@query("fastq_unmerge", _RUN + " SELECT idx, CAST(nth AS INT) AS part FROM k")
def fastq_unmerge(spark, sf):
    return Q.unmerge(fastq(spark, sf)).select("idx", F.col("part").cast("int").alias("part"))


@query("fastq_merge", FQ + " SELECT idx, CAST(f AS INT) AS file, name FROM fq, (VALUES (0),(1)) v(f)")
def fastq_merge(spark, sf):
    f = fastq(spark, sf)
    return Q.merge([f, f]).select("idx", "file", "name")


@query("fastq_properpairs", FQ + """ , a AS (SELECT name, max(idx) AS idx FROM fq WHERE idx%5 IN (0,2,4) GROUP BY name), b AS (SELECT name, max(idx) AS idx FROM fq WHERE idx%5 IN (1,3) GROUP BY name)
  SELECT (SELECT count(*) FROM a JOIN b USING (name)) AS pairs, (SELECT count(*) FROM a WHERE name NOT IN (SELECT name FROM b)) AS discarded1, (SELECT count(*) FROM b WHERE name NOT IN (SELECT name FROM a)) AS discarded2""")
def fastq_properpairs(spark, sf):
    f = fastq(spark, sf)
    return Q.proper_pairs(f.where("idx%5 in (0,2,4)"), f.where("idx%5 in (1,3)"))[1]


@query("fastq_sort", FQ + " SELECT idx, seq FROM fq ORDER BY seq, idx")
def fastq_sort(spark, sf):
    return Q.sort_reads(fastq(spark, sf), True).select("idx", "seq")


@query("fastq_scale", "SELECT 'Sanger' AS scale")
def fastq_scale(spark, sf):
    return Q.quality_scale(fastq(spark, sf))


@query("fastq_colorspace", "SELECT false AS colorspace")
def fastq_colorspace(spark, sf):
    return Q.is_colorspace(fastq(spark, sf))


@query("fastq_paircount", _RUN + " SELECT count(*) AS n FROM k WHERE run = 1")
def fastq_paircount(spark, sf):
    return Q.pair_count(fastq(spark, sf))


@query("fastq_lengths", FQ + " SELECT CAST(length(qual) AS INT) AS length, count(*) AS n FROM fq GROUP BY length(qual)")
def fastq_lengths(spark, sf):
    return Q.length_counts(fastq(spark, sf))


@query("fastq_stats", FQ + """ , q AS (SELECT p + 1 AS position, greatest(ascii(substr(qual, CAST(p+1 AS BIGINT), 1)) - 33, 0) AS value FROM (SELECT *, unnest(range(length(qual))) AS p FROM fq) x), c AS (SELECT position, value, count(*) AS n FROM q GROUP BY position, value)
  , w AS (SELECT *, sum(n) OVER (PARTITION BY position ORDER BY value) * 1.0 / sum(n) OVER (PARTITION BY position) AS reach FROM c)
  SELECT CAST(position AS INT) AS position, round(CAST(sum(value*n) AS DOUBLE)/sum(n), 6) AS mean, CAST(min(value) AS INT) AS min, CAST(min(CASE WHEN reach > 0.25 AND value > 0 THEN value END) AS INT) AS pct25, CAST(min(CASE WHEN reach > 0.5 AND value > 0 THEN value END) AS INT) AS median,
    CAST(min(CASE WHEN reach > 0.75 AND value > 0 THEN value END) AS INT) AS pct75, CAST(max(value) AS INT) AS max, CAST(sum(n) AS BIGINT) AS total, (SELECT round(stddev_samp(value), 5) FROM q q2 WHERE q2.position = w.position) AS stdev FROM w GROUP BY position""")
def fastq_stats(spark, sf):
    return Q.quality_stats(fastq(spark, sf)).withColumns({"mean": F.round("mean", 6), "stdev": F.round("stdev", 5)})


@query("fastq_trim_linkers")
def fastq_trim_linkers(spark, sf):
    return both(Q.trim_linkers(fastq(spark, sf), five="ACGT", three="TTGA", min_len=15))


@query("fastq_barcodes", FQ + " SELECT idx, CASE WHEN seq LIKE 'AC%' THEN 'one' WHEN seq LIKE '%TG' THEN 'two' ELSE 'missing' END AS tag, CASE WHEN seq LIKE 'AC%' THEN substr(seq, 3) ELSE seq END AS seq FROM fq")
def fastq_barcodes(spark, sf):
    return Q.split_barcodes(fastq(spark, sf), [("one", "AC", "5", True), ("two", "TG", "3", False)]).select("idx", "tag", "seq")


@query("fasta_strip", FQ + " SELECT idx FROM fq WHERE name NOT LIKE '%7%'")
def fasta_strip(spark, sf):
    return FA.strip_names(fastq(spark, sf), "7").select("idx")


@query("fasta_tag", FQ + " SELECT idx, 'p'||name||'s' AS name FROM fq")
def fasta_tag(spark, sf):
    return FA.tag(fastq(spark, sf), "p", "s").select("idx", "name")


@query("natural_order", FQ + " SELECT name, row_number() OVER (ORDER BY CAST(substr(name, 2) AS BIGINT)) AS place FROM (SELECT DISTINCT name FROM fq) x")
def natural_order(spark, sf):
    from pyspark.sql import Window

    w = Window.orderBy(S.natural_key(F.col("name")))
    return fastq(spark, sf).select("name").distinct().select("name", F.row_number().over(w).cast("long").alias("place"))

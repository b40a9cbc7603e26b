"""Line-oriented formats. Every reader gives idx, the place of a record among its files in path order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.align import parse_region
from ..schemas import DBSNP_COLUMNS, QSEQ_COLUMNS


def numbered_lines(spark: SparkSession, path, line_sep: str | None = None) -> DataFrame:
    """value and idx, the line's number over all files. Blocks of files count their lines on their own; a
    table of one row for each block says how many come before. Compressed text is one block, but for paths
    that end in .bgz: those are read in splits, and idx grows with the lines without counting them."""
    if isinstance(path, str) and path.endswith(".bgz"):
        from .bam import read_bgz

        return read_bgz(spark, path, line_sep)
    reader = spark.read.option("lineSep", line_sep) if line_sep else spark.read
    lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b")).withColumn("m", F.monotonically_increasing_id())
    # ids of a block's lines follow each other, so the smallest one is all that must be known
    blocks = lines.groupBy("f", "b").agg(F.min("m").alias("m0"), F.count("*").alias("n"))
    w = Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("f").alias("f2"), F.col("b").alias("b2"), "m0", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return lines.join(blocks, (F.col("f") == F.col("f2")) & (F.col("b") == F.col("b2"))).select("value", (F.col("m") - F.col("m0") + F.col("before")).alias("idx"))


def _columns(spark: SparkSession, path, comment: str = "#") -> DataFrame:
    rows = numbered_lines(spark, path).where((F.trim("value") != "") & ~F.col("value").startswith(comment))
    return rows.select("idx", "value", F.split("value", "\t").alias("c"))


def _at(i: int, default: str | None = None) -> Column:
    v = F.nullif(F.get("c", F.lit(i)), F.lit(""))
    return F.coalesce(v, F.lit(default)) if default is not None else v


def read_bed(spark: SparkSession, path) -> DataFrame:
    """BED of 3 columns or more; comments and blank lines are skipped, rows without numbers for positions
    are errors. Missing scores are 0, missing strands null."""
    c = _columns(spark, path)
    return c.select(
        _at(0).alias("chrom"), _at(1).cast("long").alias("start"), _at(2).cast("long").alias("end"), _at(3, "").alias("name"), F.coalesce(_at(4).cast("double"), F.lit(0.0)).alias("score"), _at(5).alias("strand"),
        _at(6).alias("thick_start"), _at(7).alias("thick_end"), _at(8).alias("rgb"), F.slice("c", F.lit(10), F.greatest(F.size("c") - 9, F.lit(0))).alias("extras"), "idx",
    )


def region_literal(spark: SparkSession, region: str) -> DataFrame:
    """chrom:start-end, counted from 1, as a table of one interval."""
    chrom, start, end = parse_region(region)
    return spark.range(1).select(F.lit(chrom).alias("chrom"), F.lit(start).cast("long").alias("start"), F.lit(end).cast("long").alias("end"), F.lit("").alias("name"), F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("strand"))


def read_fastq(spark: SparkSession, path) -> DataFrame:
    """Records of four lines; names end at the first blank or tab, the rest is the comment."""
    lines = numbered_lines(spark, path).withColumn("k", F.col("idx") % 4)
    pick = lambda i: F.max(F.when(F.col("k") == i, F.col("value")))
    rec = lines.groupBy(F.floor(F.col("idx") / 4).alias("idx")).agg(pick(0).alias("head"), pick(1).alias("seq"), pick(3).alias("qual")).where("head is not null and qual is not null")
    head = F.regexp_replace("head", "^@", "")
    return rec.select("idx", F.regexp_extract(head, r"^[^ \t]*", 0).alias("name"), F.regexp_extract(head, r"^[^ \t]*[ \t](.*)$", 1).alias("comment"), "seq", "qual")


def read_fasta(spark: SparkSession, path, qual: bool = False) -> DataFrame:
    """Records of any number of lines, joined (with blanks between for qualities); those without a sequence
    are dropped, as are comment lines."""
    rec = numbered_lines(spark, path, ">")
    head = F.regexp_extract("value", r"^([^\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"(?m)^#[^\n]*$", "")
    seq = F.trim(F.regexp_replace(body, r"\s*\n\s*", " " if qual else ""))
    out = rec.select("idx", F.regexp_extract(head, r"^[^ \t]*", 0).alias("name"), F.regexp_extract(head, r"^[^ \t]*[ \t](.*)$", 1).alias("comment"), seq.alias("seq"))
    return out.where("seq <> '' and name <> ''")


def read_sam(spark: SparkSession, path) -> DataFrame:
    """Alignments; positions from 0, -1 where there is none; tags by name with type and text."""
    c = _columns(spark, path, "@")
    tags = F.transform(F.slice("c", F.lit(12), F.greatest(F.size("c") - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.struct(F.substring(t, 4, 1).alias("t"), F.substring(t, 6, 1 << 30).alias("v")).alias("x")))
    name = F.nullif(_at(2), F.lit("*"))
    mate = F.nullif(_at(6), F.lit("*"))
    return c.select(
        _at(0).alias("qname"), _at(1).cast("int").alias("flag"), name.alias("chrom"), (_at(3).cast("int") - 1).alias("pos"), _at(4).cast("int").alias("mapq"), _at(5).alias("cigar"),
        F.when(mate == "=", name).otherwise(mate).alias("rnext"), (_at(7).cast("int") - 1).alias("pnext"), _at(8).cast("int").alias("tlen"), _at(9).alias("seq"), _at(10).alias("qual"),
        F.map_from_entries(F.transform(tags, lambda t: F.struct(t["k"], t["x"]))).alias("tags"), "idx",
    )


def read_sam_header(spark: SparkSession, path) -> DataFrame:
    """chrom, length and tid of the reference lines."""
    h = numbered_lines(spark, path).where("value like '@SQ%'")
    got = h.select(F.regexp_extract("value", r"\tSN:([^\t]*)", 1).alias("chrom"), F.regexp_extract("value", r"\tLN:([0-9]*)", 1).cast("long").alias("length"), "idx")
    return got.select("chrom", "length", (F.row_number().over(Window.orderBy("idx")) - 1).alias("tid"))


def attributes(text: Column) -> Column:
    """GTF (key "value";) or GFF (key=value;) attributes as a map; of repeated keys the first counts."""
    parts = F.transform(F.split(text, ';(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda p: F.trim(p))
    pairs = F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.struct(F.regexp_extract(p, r"^([^ =]+)", 1).alias("k"), F.regexp_replace(F.regexp_extract(p, r"^[^ =]+[ =]+(.*)$", 1), '^"|"$', "").alias("v")))
    zero = F.array().cast("array<struct<k:string,v:string>>")
    once = F.aggregate(pairs, zero, lambda a, x: F.when(F.exists(a, lambda y: y["k"] == x["k"]), a).otherwise(F.concat(a, F.array(x))))
    return F.map_from_entries(once)


def read_gtf(spark: SparkSession, path) -> DataFrame:
    """Nine-column rows, starts from 0; what follows a # after the attributes is a comment."""
    c = _columns(spark, path)
    attr = F.trim(F.regexp_replace(F.coalesce(F.get("c", F.lit(8)), F.lit("")), r';\s*#.*$', ";"))
    return c.where(F.size("c") >= 9).select(
        _at(0).alias("chrom"), _at(1).alias("source"), _at(2).alias("feature"), (_at(3).cast("long") - 1).alias("start"), _at(4).cast("long").alias("end"), _at(5).alias("score"),
        _at(6).alias("strand"), _at(7).alias("frame"), attributes(attr).alias("attrs"), attr.alias("attributes"), "idx",
    )


def read_gff(spark: SparkSession, path) -> DataFrame:
    """As read_gtf, up to the line that begins the sequences, if any (##FASTA or >)."""
    lines = numbered_lines(spark, path)
    stop = lines.where(F.col("value").startswith("##FASTA") | F.col("value").startswith(">")).agg(F.min("idx").alias("stop"))  # one row
    kept = lines.crossJoin(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("idx") < F.col("stop"))).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    c = kept.select("idx", F.split("value", "\t").alias("c")).where(F.size("c") >= 9)
    return c.select(
        _at(0).alias("chrom"), _at(1).alias("source"), _at(2).alias("feature"), (_at(3).cast("long") - 1).alias("start"), _at(4).cast("long").alias("end"), _at(5).alias("score"),
        _at(6).alias("strand"), _at(7).alias("frame"), attributes(F.get("c", F.lit(8))).alias("attrs"), F.get("c", F.lit(8)).alias("attributes"), "idx",
    )


def read_qseq(spark: SparkSession, path) -> DataFrame:
    c = _columns(spark, path, "\0")
    return c.select("idx", *[F.coalesce(F.get("c", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(QSEQ_COLUMNS)])


def read_repeats(spark: SparkSession, path) -> DataFrame:
    """Repeat table: chrom, start (from 0), end, strand (+, else -), member, family. Lines that don't begin
    with a number are headers."""
    c = numbered_lines(spark, path).select("idx", F.split(F.trim("value"), r"\s+").alias("c")).where(F.get("c", F.lit(0)).rlike("^[0-9]+$"))
    return c.select(_at(4).alias("chrom"), (_at(5).cast("long") - 1).alias("start"), _at(6).cast("long").alias("end"), F.when(_at(8) == "+", "+").otherwise("-").alias("strand"), _at(9).alias("member"), _at(10).alias("family"), "idx")


def read_vcf(spark: SparkSession, path) -> DataFrame:
    c = _columns(spark, path)
    return c.select(_at(0).alias("chrom"), _at(1).cast("long").alias("pos"), _at(2).alias("id"), _at(3).alias("ref"), _at(4).alias("alt"), _at(5).alias("qual"), _at(6).alias("filter"), _at(7).alias("info"), "idx")


def read_base_calls(spark: SparkSession, path) -> DataFrame:
    """chrom and pos of a base-call table; the header line is skipped."""
    return _columns(spark, path).where(F.get("c", F.lit(1)).rlike("^[0-9]+$")).select(_at(0).alias("chrom"), _at(1).cast("long").alias("pos"), "idx")


def read_dbsnp(spark: SparkSession, path) -> DataFrame:
    """The 26 columns; rows of fewer than 12 are dropped, further ones padded with null."""
    c = _columns(spark, path).where(F.size("c") >= 12)
    kind = {"chromStart": "long", "chromEnd": "long", "score": "double", "weight": "double"}
    return c.select(*[(_at(i).try_cast(kind[n]) if n in kind else _at(i)).alias(n) for i, n in enumerate(DBSNP_COLUMNS)])


def read_sizes(spark: SparkSession, path) -> DataFrame:
    """chrom and length of a chrom.sizes or .fai file."""
    return _columns(spark, path).select(_at(0).alias("chrom"), _at(1).cast("long").alias("length"))


def read_names(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").getItem(0).alias("name")).where("name <> ''")


def is_fasta(spark: SparkSession, path) -> bool:
    """Whether the first line that begins a record is a FASTA one; neither kind is an error."""
    first = numbered_lines(spark, path).where(F.col("value").rlike("^[>@]")).orderBy("idx").select("value").first()
    if first is None:
        raise ValueError("neither FASTA nor FASTQ")
    return first[0].startswith(">")


def sample_labels(paths: list[str], delimiter: str = ".") -> list[str]:
    """File names without the words at the end that all of them share."""
    words = [re.split(r"[._]", p.rpartition("/")[2]) for p in paths]
    while len(words) > 1 and all(len(w) > 1 for w in words) and len({w[-1] for w in words}) == 1:
        words = [w[:-1] for w in words]
    return [delimiter.join(w) for w in words]

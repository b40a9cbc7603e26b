"""Rows as lines of text formats, and partitioned output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number_text(x: Column) -> Column:
    """A number without a fraction prints without a point."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def bed_lines(bed: DataFrame) -> DataFrame:
    """Five columns or more: strand, thick ends and colour follow where they are known."""
    cols = [F.col("chrom"), F.col("start").cast("string"), F.col("end").cast("string"), F.coalesce("name", F.lit("")), number_text(F.coalesce(F.col("score").cast("double"), F.lit(0.0)))]
    cols += [F.col(c) for c in ("strand", "thick_start", "thick_end", "rgb") if c in bed.columns]
    return bed.select(F.concat_ws("\t", *cols).alias("value"))


def fastq_lines(reads: DataFrame) -> DataFrame:
    head = F.concat_ws(" ", "name", F.nullif("comment", F.lit(""))) if "comment" in reads.columns else F.col("name")
    return reads.select(F.concat(F.lit("@"), head, F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value"))


def fasta_lines(fasta: DataFrame) -> DataFrame:
    head = F.concat_ws(" ", "name", F.nullif("comment", F.lit(""))) if "comment" in fasta.columns else F.col("name")
    return fasta.select(F.concat(F.lit(">"), head, F.lit("\n"), "seq").alias("value"))


def sam_lines(reads: DataFrame) -> DataFrame:
    tags = F.transform(F.array_sort(F.map_entries(F.coalesce("tags", F.create_map().cast("map<string,struct<t:string,v:string>>")))), lambda e: F.concat_ws(":", e["key"], e["value"]["t"], e["value"]["v"]))
    same = F.when(F.col("rnext") == F.col("chrom"), "=").otherwise(F.coalesce("rnext", F.lit("*")))
    cols = [F.col("qname"), F.col("flag").cast("string"), F.coalesce("chrom", F.lit("*")), (F.col("pos") + 1).cast("string"), F.col("mapq").cast("string"), F.coalesce("cigar", F.lit("*")), same]
    cols += [(F.coalesce("pnext", F.lit(-1)) + 1).cast("string"), F.coalesce("tlen", F.lit(0)).cast("string"), F.coalesce("seq", F.lit("*")), F.coalesce("qual", F.lit("*"))]
    return reads.select(F.concat_ws("\t", *cols, F.nullif(F.array_join(tags, "\t"), F.lit(""))).alias("value"))


def gtf_lines(gtf: DataFrame) -> DataFrame:
    return gtf.select(F.concat_ws("\t", "chrom", "source", "feature", (F.col("start") + 1).cast("string"), F.col("end").cast("string"), F.coalesce("score", F.lit(".")), F.coalesce("strand", F.lit(".")), F.coalesce("frame", F.lit(".")), "attributes").alias("value"))


def bedgraph_lines(graph: DataFrame) -> DataFrame:
    return graph.select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), number_text(F.col("depth").cast("double"))).alias("value"))


def wiggle(graph: DataFrame) -> DataFrame:
    """chrom, pos, value: a row for each position from start to end, both included, as the format's
    conversion counts. Lines of one chromosome go below a variableStep header."""
    return graph.select("chrom", F.explode(F.sequence(F.col("start").cast("long"), F.col("end").cast("long"))).alias("pos"), F.col("depth").alias("value"))


def wiggle_lines(graph: DataFrame) -> DataFrame:
    w = wiggle(graph)
    heads = graph.select("chrom").distinct().select("chrom", F.lit(-1).cast("long").alias("pos"), F.concat(F.lit("variableStep chrom="), "chrom").alias("value"))
    rows = w.select("chrom", "pos", F.concat_ws(" ", F.col("pos").cast("string"), F.col("value").cast("string")).alias("value"))
    return heads.unionByName(rows).orderBy("chrom", "pos").select("value")


def write_lines(lines: DataFrame, path: str, compression: str | None = None) -> None:
    w = lines.write.mode("overwrite")
    (w.option("compression", compression) if compression else w).text(path)


def write_parts(rows: DataFrame, path: str, line: Column, column: str = "part", compression: str | None = None) -> None:
    """Text files below path/column=value: `line` of each row, rows of a part in the order of idx."""
    lines = rows.select(column, "idx", line.alias("value")).repartition(column).sortWithinPartitions(column, "idx").select(column, "value")
    w = lines.write.mode("overwrite").partitionBy(column)
    (w.option("compression", compression) if compression else w).text(path)


def range_sorted(df: DataFrame, partitions: int, *keys: str) -> DataFrame:
    """Rows in ranges of keys, sorted within: written as Parquet, readers skip by the ranges."""
    return df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)

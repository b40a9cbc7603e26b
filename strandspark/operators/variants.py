"""Variants of reads and their comparison with known ones."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import flags as G
from ..functions.sequence import revcomp
from .align import mapped, ops
from .pileup import reference_base

MD = re.compile(r"([0-9]+)|\^([A-Za-z]+)|([A-Za-z])")
CIGAR = re.compile(r"([0-9]+)([MIDNSHP=X])")


def read_variants(pos: int, cigar: str, md: str, seq: str) -> list[tuple[str, int, str]]:
    """(op, position, bases) of a read's variants by its MD tag: M for a mismatch (the read's base), I for
    an insertion, D for a deletion (the reference's bases). Zero runs between letters may be missing."""
    todo = [(int(n), "", "") if n else (0, d, "") if d else (0, "", x) for n, d, x in MD.findall(md or "")]
    todo.reverse()
    out, at, i, left = [], pos, 0, 0
    for n, op in ((int(n), op) for n, op in CIGAR.findall(cigar or "")):
        if op in "M=X":
            while n:
                if left:
                    step = min(n, left)
                    left, n, at, i = left - step, n - step, at + step, i + step
                    continue
                if not todo:
                    at, i, n = at + n, i + n, 0
                    break
                run, gone, base = todo.pop()
                if base:
                    out.append(("M", at, seq[i : i + 1].upper()))
                    at, i, n = at + 1, i + 1, n - 1
                elif not gone:
                    left = run
        elif op == "I":
            out.append(("I", at, seq[i : i + n].upper()))
            i += n
        elif op == "D":
            while todo and not left and not todo[-1][1] and not todo[-1][2] and todo[-1][0] == 0:
                todo.pop()
            gone = todo.pop()[1] if todo and not left and todo[-1][1] else ""
            out.append(("D", at, gone.upper()))
            at += n
        elif op == "N":
            at += n
        elif op == "S":
            i += n
    return out


def variants(reads: DataFrame) -> DataFrame:
    """idx, chrom, op, pos, bases: a row for each variant of mapped reads. The MD tag is a state machine
    along the read, so batches go through Arrow."""
    src = reads.where(mapped()).select("idx", "chrom", "pos", "cigar", G.tag("MD").alias("md"), "seq")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = [(i, c, *v) for i, c, p, g, m, s in df.itertuples(index=False, name=None) for v in read_variants(p, g, m, s)]
            yield pd.DataFrame(rows, columns=["idx", "chrom", "op", "pos", "bases"])

    return src.mapInPandas(run, "idx long, chrom string, op string, pos long, bases string")


def reference_variants(reads: DataFrame, reference: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """The same rows from comparing aligned bases with the reference instead of MD tags; deletions have no bases."""
    o = reads.where(mapped()).select("idx", "chrom", "seq", F.explode(C.walk(F.col("pos"), ops())).alias("o")).select("idx", "chrom", "seq", "o.*")
    spelled = o.where(F.col("op").isin("M", "=", "X")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("len") - 1)))
    spelled = spelled.select("idx", "chrom", F.lit("M").alias("op"), (F.col("ref") + F.col("i")).cast("long").alias("pos"), F.upper(F.substring(F.col("seq"), F.col("read") + F.col("i") + 1, F.lit(1))).alias("bases"))
    odd = reference_base(spelled, reference, chunk).where("bases <> ref").drop("ref")
    indels = o.where(F.col("op").isin("I", "D")).select("idx", "chrom", "op", F.col("ref").cast("long").alias("pos"), F.when(F.col("op") == "I", F.upper(F.substring(F.col("seq"), F.col("read") + 1, F.col("len")))).otherwise("").alias("bases"))
    return odd.unionByName(indels)


def known_variants(found: DataFrame, dbsnp: DataFrame) -> DataFrame:
    """Rows of found (chrom, op, pos, bases) that dbsnp (chrom, chromStart, strand, observed, clazz) lists at
    the position: mismatches among single or mixed ones, insertions and deletions among theirs, with the
    bases among the alleles, turned for the minus strand."""
    alleles = F.transform(F.split("observed", "/"), lambda x: F.when(F.col("d_strand") == "-", revcomp(x)).otherwise(x))
    d = dbsnp.select(F.col("chrom").alias("d_chrom"), F.col("chromStart").alias("d_pos"), F.col("strand").alias("d_strand"), "observed", "clazz")
    both = found.join(d, (F.col("chrom") == F.col("d_chrom")) & (F.col("pos") == F.col("d_pos"))).withColumn("__a", alleles)
    kinds = F.when(F.col("op") == "M", F.col("clazz").isin("single", "mixed")).when(F.col("op") == "I", F.col("clazz").isin("insertion", "mixed", "in-del")).otherwise(F.col("clazz").isin("deletion", "mixed", "in-del"))
    allele = F.when(F.col("op") == "D", F.array_contains("__a", F.lit("-"))).otherwise(F.array_contains("__a", F.col("bases")))
    return both.where(kinds & allele).select(found.columns).distinct()


def mismatches_but_known(reads: DataFrame, dbsnp: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """idx, mismatches and known: variants of each mapped read that dbsnp doesn't list, and that it does."""
    v = (found if found is not None else variants(reads)).select("idx", "chrom", "op", "pos", "bases")
    k = known_variants(v, dbsnp).groupBy("idx").agg(F.count("*").alias("known"))
    n = v.groupBy("idx").agg(F.count("*").alias("n"))
    out = reads.where(mapped()).select("idx").join(n, "idx", "left").join(k, "idx", "left").na.fill(0, ["n", "known"])
    return out.select("idx", (F.col("n") - F.col("known")).alias("mismatches"), "known")


def filter_known_mismatches(reads: DataFrame, most: int, dbsnp: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Reads with no more than `most` unlisted variants; tag ZS has the number of listed ones, if any."""
    m = mismatches_but_known(reads, dbsnp, found)
    out = reads.join(m.where(F.col("mismatches") <= most), "idx")
    return out.withColumn("tags", F.when(F.col("known") > 0, G.put_tag("ZS", "i", F.col("known"))).otherwise(F.col("tags"))).select(reads.columns)

"""Row transforms and summaries of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import natural_key, revcomp
from .pileup import fetch_sequence


def annotate(bed: DataFrame, name: str | None = None, score: float | None = None, strand: str | None = None, rgb: dict[str, str] | None = None) -> DataFrame:
    """Constants for columns; a region without a name gets chrom:start-end; rgb by name."""
    given = F.lit(name) if name is not None else F.coalesce(F.nullif("name", F.lit("")), F.concat(F.col("chrom"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")))
    out = bed.withColumn("name", given)
    if score is not None:
        out = out.withColumn("score", F.lit(float(score)))
    if strand is not None:
        out = out.withColumn("strand", F.lit(strand))
    if rgb:
        table = F.create_map(*[F.lit(x) for kv in rgb.items() for x in kv])
        out = out.withColumn("rgb", F.coalesce(F.try_element_at(table, F.col("name")), F.col("rgb") if "rgb" in bed.columns else F.lit(None)))
    return out


def clean(bed: DataFrame) -> DataFrame:
    """Scores cut to whole numbers of 1000 at most."""
    return bed.withColumn("score", F.least(F.col("score").cast("long"), F.lit(1000).cast("long")))


def extend(bed: DataFrame, five: int = 0, three: int = 0, exact: bool = False) -> DataFrame:
    """Regions grown upstream and downstream, as strands go, or of exactly these lengths counted from the
    other end. Starts stop at 0; a missing strand is +."""
    minus = F.coalesce(F.col("strand") == "-", F.lit(False))
    s, e = F.col("start"), F.col("end")

    def left(n: int) -> Column:
        return (e - n if exact else s - n) if n else s

    def right(n: int) -> Column:
        return (s + n if exact else e + n) if n else e

    return bed.withColumns({"start": F.greatest(F.lit(0), F.when(minus, left(three)).otherwise(left(five))), "end": F.when(minus, right(five)).otherwise(right(three))})


def sizes(bed: DataFrame) -> DataFrame:
    return bed.select((F.col("end") - F.col("start")).alias("size"))


def to_bed3(bed: DataFrame) -> DataFrame:
    return bed.select("chrom", "start", "end")


def to_bed6(bed: DataFrame) -> DataFrame:
    return bed.select("chrom", "start", "end", "name", "score", "strand")


def clean_bedgraph(graph: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows on known chromosomes (chrom, length) that begin inside of them, ends cut at their length."""
    rows = graph.join(sizes.select("chrom", F.col("length").alias("__n")), "chrom").where(F.col("start") < F.col("__n"))
    return rows.withColumn("end", F.least("end", "__n")).select(graph.columns)


def sort(bed: DataFrame) -> DataFrame:
    return bed.orderBy("chrom", "start", "end", F.col("strand").asc_nulls_first(), "name")


def stats(bed: DataFrame) -> DataFrame:
    """One row: regions, bases and mean size."""
    n = F.col("end") - F.col("start")
    return bed.agg(F.count("*").alias("regions"), F.sum(n).alias("bases"), F.avg(n).alias("mean_size"))


def report(bed: DataFrame, ranges: DataFrame | None = None, names: bool = False) -> DataFrame:
    """section, key and n: regions and bases, regions by reference, by name if asked for, and by class of
    gene region where ranges (genes.class_ranges) are given."""
    from .genes import classify_regions

    size = (F.col("end") - F.col("start")).cast("long")
    entry = lambda section, key, n=F.lit(1).cast("long"): F.struct(F.lit(section).alias("section"), key.alias("key"), n.alias("n"))  # noqa: E731, B008
    entries = [entry("total", F.lit("regions")), entry("total", F.lit("bases"), size), entry("reference", F.col("chrom"))] + ([entry("name", F.col("name"))] if names else [])
    if ranges is not None:
        bed = classify_regions(bed, ranges)
        entries.append(entry("class", F.col("tag")))
    return bed.select(F.explode(F.array(*entries)).alias("x")).groupBy("x.section", "x.key").agg(F.sum("x.n").alias("n"))


def counts_by(bed: DataFrame, column: str = "chrom") -> DataFrame:
    """Regions for each value of a column, in natural order."""
    return bed.groupBy(column).agg(F.count("*").alias("n")).orderBy(natural_key(F.col(column)))


def to_fasta(bed: DataFrame, reference: DataFrame, min_size: int = 50, stranded: bool = True, include_name: bool = False, chunk: int = 1 << 16) -> DataFrame:
    """name and seq of regions of min_size bases or more, as their strand reads."""
    got = fetch_sequence(bed.where(F.col("end") - F.col("start") >= min_size), reference, chunk)
    place = F.concat(F.col("chrom"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    if stranded:
        place = F.concat(place, F.when(F.col("strand").isNotNull(), F.concat(F.lit("["), F.col("strand"), F.lit("]"))).otherwise(""))
    name = F.concat(F.col("name"), F.lit("|"), place) if include_name else place
    seq = F.when(F.lit(stranded) & (F.col("strand") == "-"), revcomp(F.col("seq"))).otherwise(F.col("seq"))
    return got.select(name.alias("name"), seq.alias("seq"))


def from_vcf(vcf: DataFrame) -> DataFrame:
    """Variants as regions of their reference allele, named REF/ALT."""
    return vcf.select("chrom", (F.col("pos") - 1).alias("start"), (F.col("pos") - 1 + F.length("ref")).alias("end"), F.concat("ref", F.lit("/"), "alt").alias("name"), F.col("qual").alias("score"), F.lit("+").alias("strand"))


def from_base_calls(calls: DataFrame) -> DataFrame:
    return calls.select("chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"))


def primer_sites(primers: DataFrame, reference: DataFrame, max_size: int = 4000, chunk: int = 1 << 16, flip: bool = False) -> DataFrame:
    """Exact amplicons of primer pairs (name, fwd, rev) on chunked sequences: chrom, start, end, name,
    strand. Primers match whole; further amplicons of a name are numbered .1, .2 and so on.

    Sites are found chunk by chunk, each read with the beginning of the next, and joined by chromosome
    and distance in bins.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("chrom").orderBy("chunk")
    wide = reference.withColumn("seq", F.upper(F.concat("seq", F.coalesce(F.substring(F.lead("seq").over(w), 1, 64), F.lit(""))))).withColumn("n", F.lit(chunk))
    p = primers.select("name", F.upper("fwd").alias("fwd"), (F.upper("rev") if flip else revcomp(F.upper("rev"))).alias("rev")).dropDuplicates(["fwd", "rev"])
    probes = p.select("name", F.lit("f").alias("end"), "fwd", "rev", F.col("fwd").alias("probe")).unionByName(p.select("name", F.lit("r").alias("end"), "fwd", "rev", F.col("rev").alias("probe")))
    probes = probes.unionByName(p.select("name", F.lit("R").alias("end"), "fwd", "rev", revcomp(F.col("rev")).alias("probe"))).unionByName(p.select("name", F.lit("F").alias("end"), "fwd", "rev", revcomp(F.col("fwd")).alias("probe")))
    # sites by the probe's first 12 bases, then compared whole
    k = 12
    spots = wide.select("chrom", "chunk", "seq", F.explode(F.sequence(F.lit(1), F.least(F.length("seq"), F.col("n")))).alias("i")).select("chrom", (F.col("chunk") * chunk + F.col("i") - 1).alias("pos"), F.substring(F.col("seq"), F.col("i"), F.lit(64)).alias("here"))
    found = spots.withColumn("key", F.substring("here", 1, k)).join(probes.withColumn("key", F.substring("probe", 1, k)), "key").where(F.col("here").startswith(F.col("probe")))
    found = found.select("name", "fwd", "rev", "end", "chrom", "pos", (F.col("pos") + F.length("probe")).alias("stop"))
    out = None
    for a, b, strand in (("f", "r", "+"), ("R", "F", "-")):
        left = found.where(F.col("end") == a).select("name", "chrom", F.col("pos").alias("start"), F.explode(F.array(F.floor(F.col("pos") / max_size), F.floor(F.col("pos") / max_size) + 1)).alias("bin"))
        right = found.where(F.col("end") == b).select("name", "chrom", F.col("pos").alias("p2"), F.col("stop").alias("end"), F.floor(F.col("pos") / max_size).alias("bin"))
        one = left.join(right, ["name", "chrom", "bin"]).where((F.col("p2") >= F.col("start")) & (F.col("end") - F.col("start") <= max_size)).select("chrom", "start", "end", "name", F.lit(strand).alias("strand"))
        out = one if out is None else out.unionByName(one)
    n = F.row_number().over(Window.partitionBy("name").orderBy("chrom", "start", "end", "strand")) - 1
    return out.withColumn("__n", n).withColumn("name", F.when(F.col("__n") > 0, F.concat_ws(".", "name", "__n")).otherwise(F.col("name"))).drop("__n")

"""Gene models: transcripts, regions, derived intervals, annotation and enrichment.

GTF rows have chrom, source, feature, start (0-based), end, score, strand, frame, attrs (map), idx. A
transcript row has gid, gene_id, gene_name, chrom, strand, transcript_id, tx (its place in the gene),
start, end, exons and cds (arrays of start, end by start), start_codon and stop_codon.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import BIN, overlap_pairs
from .tiles import key, least_around

SPANS = "array<struct<start:bigint,end:bigint>>"
# Chromosome names that convert between the two naming schemes.
NUCLEAR = [*[str(n) for n in range(1, 23)], "X", "Y"]


def gene_key() -> Column:
    """isoform_id, else gene_name, else gene_id, else the first attribute, else the line."""
    a = F.col("attrs")
    pick = [F.nullif(F.try_element_at(a, F.lit(k)), F.lit("")) for k in ("isoform_id", "gene_name", "gene_id")]
    return F.coalesce(*pick, F.try_element_at(F.map_values(a), F.lit(1)), F.concat(F.lit("id_"), F.col("idx").cast("string")))


def _spans(feature: str) -> Column:
    return F.array_sort(F.collect_set(F.when(F.col("feature") == feature, F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))))


def transcripts(gtf: DataFrame) -> DataFrame:
    """One row for each transcript of a gene; a gene is a key on one chromosome. Without exons the whole
    span is one; without codons they are the 3 bases at either end of the coding part, as the strand goes."""
    a = lambda k: F.coalesce(F.try_element_at("attrs", F.lit(k)), F.lit(""))
    rows = gtf.withColumns({"gid": gene_key(), "__gene": a("gene_id"), "__name": a("gene_name"), "transcript_id": a("transcript_id")})
    codon = lambda f: F.min(F.when(F.col("feature") == f, F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))))
    t = rows.groupBy("gid", "chrom", "transcript_id").agg(
        F.min_by("__gene", "idx").alias("gene_id"), F.min_by("__name", "idx").alias("gene_name"), F.min_by("strand", "idx").alias("strand"), F.min("idx").alias("first"),
        F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), _spans("exon").alias("exons"), _spans("CDS").alias("cds"),
        codon("start_codon").alias("start_codon"), codon("stop_codon").alias("stop_codon"),
    )
    whole = F.array(F.struct(F.col("start"), F.col("end")))
    t = t.withColumn("exons", F.when(F.size("exons") > 0, F.col("exons")).otherwise(whole))
    lo, hi = F.when(F.size("cds") > 0, F.col("cds")[0]["start"]).otherwise(F.col("start")), F.when(F.size("cds") > 0, F.element_at("cds", -1)["end"]).otherwise(F.col("end"))
    left, right = F.struct(lo.alias("start"), (lo + 3).alias("end")), F.struct((hi - 3).alias("start"), hi.alias("end"))
    plus = F.col("strand") == "+"
    t = t.withColumns({"start_codon": F.coalesce("start_codon", F.when(plus, left).otherwise(right)), "stop_codon": F.coalesce("stop_codon", F.when(plus, right).otherwise(left))})
    return t.withColumn("tx", F.row_number().over(Window.partitionBy("gid", "chrom").orderBy("first", "transcript_id")) - 1)


def genes(tx: DataFrame) -> DataFrame:
    """One row for each gene: gid, chrom, strand, gene_id, gene_name, start, end, first (its first line)."""
    return tx.groupBy("gid", "chrom").agg(F.min_by("strand", "tx").alias("strand"), F.min_by("gene_id", "tx").alias("gene_id"), F.min_by("gene_name", "tx").alias("gene_name"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("first").alias("first"))


def by_id(tx: DataFrame, gid: str) -> DataFrame:
    return tx.where(F.col("gid") == gid)


def by_name(tx: DataFrame, name: str) -> DataFrame:
    return tx.where(F.col("gene_name") == name)


def _label() -> Column:
    return F.coalesce(F.nullif("gene_name", F.lit("")), F.col("gid"))


def _utr(ends_before: bool) -> Column:
    """Pieces of exons before the coding part (or after it), in reference order."""
    edge = F.col("cds")[0]["start"] if ends_before else F.element_at("cds", -1)["end"]
    if ends_before:
        parts = F.filter("exons", lambda x: x["start"] < edge)
        cut = F.transform(parts, lambda x: F.struct(x["start"].alias("start"), F.least(x["end"], edge).alias("end")))
    else:
        parts = F.filter("exons", lambda x: x["end"] > edge)
        cut = F.transform(parts, lambda x: F.struct(F.greatest(x["start"], edge).alias("start"), x["end"].alias("end")))
    return F.when(F.size("cds") > 0, cut).otherwise(F.array().cast(SPANS))


def utr5() -> Column:
    return F.when(F.col("strand") == "+", _utr(True)).otherwise(_utr(False))


def utr3() -> Column:
    return F.when(F.col("strand") == "+", _utr(False)).otherwise(_utr(True))


def introns_of() -> Column:
    n = F.size("exons")
    return F.transform(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.get(F.col("exons"), i - 1)["end"].alias("start"), F.get(F.col("exons"), i)["start"].alias("end")))


def regions(tx: DataFrame) -> DataFrame:
    """Disjoint exon regions of each gene: gid, chrom, strand, gene_name, i (from 1), start, end, const (every
    transcript that reaches over the region has it) and names of those that do. A gene is one row's work."""
    own = F.struct("tx", "transcript_id", "strand", _label().alias("gene_name"), "exons", F.array_min(F.transform("exons", lambda x: x["start"])).alias("a"), F.array_max(F.transform("exons", lambda x: x["end"])).alias("b"))
    g = tx.groupBy("gid", "chrom").agg(F.array_sort(F.collect_list(own)).alias("t"))
    ends = F.flatten(F.transform("t", lambda y: F.concat(F.transform(y["exons"], lambda x: x["start"]), F.transform(y["exons"], lambda x: x["end"]))))
    g = g.withColumn("cuts", F.array_sort(F.array_distinct(ends)))

    def piece(p: Column, q: Column) -> Column:
        has = F.filter("t", lambda y: F.exists(y["exons"], lambda x: (x["start"] <= p) & (q <= x["end"])))
        first = F.get(has, F.lit(0))
        reach = F.size(F.filter("t", lambda y: (y["a"] <= p) & (q <= y["b"])))
        names = F.array_sort(F.transform(has, lambda y: y["transcript_id"]))
        return F.struct(p.alias("start"), q.alias("end"), (F.size(has) == reach).alias("const"), names.alias("names"), first["strand"].alias("strand"), first["gene_name"].alias("gene_name"))

    following = F.slice("cuts", F.lit(2), F.greatest(F.size("cuts"), F.lit(0)))
    g = g.select("gid", "chrom", F.filter(F.zip_with("cuts", following, piece), lambda x: F.size(x["names"]) > 0).alias("m"))
    # neighbours with the same transcripts are one region: it begins where the piece before is another one
    fresh = F.filter(F.transform("m", lambda x, i: i), lambda i: (i == 0) | (F.get("m", i - 1)["end"] != F.get("m", i)["start"]) | (F.get("m", i - 1)["names"] != F.get("m", i)["names"]))
    g = g.select("gid", "chrom", "m", fresh.alias("f"))

    def region(at: Column, k: Column) -> Column:
        upto = F.coalesce(F.get("f", k + 1), F.size("m"))
        x, last = F.get("m", at), F.get("m", upto - 1)
        return F.struct((k + 1).alias("i"), x["strand"].alias("strand"), x["gene_name"].alias("gene_name"), x["start"].alias("start"), last["end"].alias("end"), F.forall(F.slice("m", at + 1, upto - at), lambda y: y["const"]).alias("const"), x["names"].alias("names"))

    out = g.select("gid", "chrom", F.explode(F.transform("f", region)).alias("r"))
    return out.select("gid", "chrom", "r.strand", "r.gene_name", F.col("r.i").cast("long").alias("i"), "r.start", "r.end", "r.const", "r.names")


def _bed(df: DataFrame, start: Column, end: Column, site: Column) -> DataFrame:
    """One interval for each distinct site of a gene, named after the gene's first transcript with it."""
    rows = df.select("gid", "chrom", "strand", _label().alias("__g"), "tx", start.cast("long").alias("start"), end.cast("long").alias("end"), site.alias("__site"))
    first = rows.groupBy("gid", "chrom", "__site").agg(F.min(F.struct("tx", "start", "end", "__g", "strand")).alias("r"))
    return first.select("chrom", "r.start", "r.end", F.concat_ws("/", "r.__g", F.col("r.tx").cast("string")).alias("name"), F.lit(0).alias("score"), "r.strand")


def _plus() -> Column:
    return F.col("strand") == "+"


def bed_genes(tx: DataFrame) -> DataFrame:
    return genes(tx).select("chrom", "start", "end", _label().alias("name"), F.lit(0).alias("score"), "strand")


def _numbered_parts(tx: DataFrame, parts: Column, letter: str) -> DataFrame:
    d = tx.select("gid", "chrom", "strand", _label().alias("__g"), F.explode(parts).alias("x")).select("gid", "chrom", "strand", "__g", "x.start", "x.end").distinct()
    n = F.row_number().over(Window.partitionBy("gid", "chrom").orderBy("start", "end"))
    return d.select("chrom", "start", "end", F.concat(F.col("__g"), F.lit(f"/{letter}"), n.cast("string")).alias("name"), F.lit(0).alias("score"), "strand")


def bed_exons(tx: DataFrame) -> DataFrame:
    return _numbered_parts(tx, F.col("exons"), "e")


def bed_introns(tx: DataFrame) -> DataFrame:
    return _numbered_parts(tx, introns_of(), "i")


def bed_regions(tx: DataFrame) -> DataFrame:
    """Disjoint regions as gene/const.i or gene/alt.i, score the number of transcripts."""
    kind = F.when(F.col("const"), "const").otherwise("alt")
    return regions(tx).select("chrom", "start", "end", F.concat(F.col("gene_name"), F.lit("/"), kind, F.lit("."), F.col("i").cast("string")).alias("name"), F.size("names").alias("score"), "strand")


def bed_tss(tx: DataFrame) -> DataFrame:
    s, e = F.col("start"), F.col("end")
    return _bed(tx, F.when(_plus(), s).otherwise(e - 3), F.when(_plus(), s + 3).otherwise(e), F.when(_plus(), s).otherwise(e))


def bed_txs(tx: DataFrame) -> DataFrame:
    s, e = F.col("start"), F.col("end")
    return _bed(tx, F.when(_plus(), e - 3).otherwise(s), F.when(_plus(), e).otherwise(s + 3), F.when(_plus(), e).otherwise(s))


def bed_promoters(tx: DataFrame, up: int, down: int = 0) -> DataFrame:
    """up bases before each transcription start to down bases after it; not cut off at 0."""
    s, e = F.col("start"), F.col("end")
    return _bed(tx, F.when(_plus(), s - up).otherwise(e - down), F.when(_plus(), s + down).otherwise(e + up), F.when(_plus(), s).otherwise(e))


def bed_translation_starts(tx: DataFrame) -> DataFrame:
    return _bed(tx.where(F.size("cds") > 0), F.col("start_codon.start"), F.col("start_codon.end"), F.col("start_codon"))


def bed_translation_stops(tx: DataFrame) -> DataFrame:
    return _bed(tx.where(F.size("cds") > 0), F.col("stop_codon.start"), F.col("stop_codon.end"), F.col("stop_codon"))


def _splice(tx: DataFrame, donor: bool) -> DataFrame:
    """Bases just after exons but the last, or just before exons but the first, as the strand decides."""
    right = _plus() if donor else ~_plus()
    n = F.size("exons")
    after = F.transform(F.slice("exons", F.lit(1), F.greatest(n - 1, F.lit(0))), lambda x: F.struct(x["end"].alias("s"), (x["end"] + 1).alias("e")))
    before = F.transform(F.filter("exons", lambda x, i: i > 0), lambda x: F.struct((x["start"] - 1).alias("s"), x["start"].alias("e")))
    df = tx.withColumn("__x", F.explode(F.when(right, after).otherwise(before)))
    return _bed(df, F.col("__x.s"), F.col("__x.e"), F.col("__x"))


def bed_donors(tx: DataFrame) -> DataFrame:
    return _splice(tx, True)


def bed_acceptors(tx: DataFrame) -> DataFrame:
    return _splice(tx, False)


def bed_utr5(tx: DataFrame) -> DataFrame:
    """From the transcript's beginning to the start codon, introns included."""
    s, e = F.when(_plus(), F.col("start")).otherwise(F.col("start_codon.end") + 1), F.when(_plus(), F.col("start_codon.start")).otherwise(F.col("end"))
    return _bed(tx.where(F.size("cds") > 0), s, e, F.struct(F.when(_plus(), F.col("start")).otherwise(F.col("end")), F.col("start_codon")))


def bed_utr3(tx: DataFrame) -> DataFrame:
    s, e = F.when(_plus(), F.col("stop_codon.end") + 1).otherwise(F.col("start")), F.when(_plus(), F.col("end")).otherwise(F.col("stop_codon.start"))
    return _bed(tx.where(F.size("cds") > 0), s, e, F.struct(F.when(_plus(), F.col("end")).otherwise(F.col("start")), F.col("stop_codon")))


def gene_sizes(tx: DataFrame) -> DataFrame:
    """gene, genomic size and the largest transcript, intron, coding and untranslated lengths of a gene."""
    total = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    t = tx.select("gid", "chrom", _label().alias("gene"), "start", "end", total(F.col("exons")).alias("t"), total(introns_of()).alias("i"), total(F.col("cds")).alias("c"), total(utr5()).alias("u5"), total(utr3()).alias("u3"))
    return t.groupBy("gid", "chrom").agg(F.first("gene").alias("gene"), (F.max("end") - F.min("start")).alias("genomic"), F.max("t").alias("transcript"), F.max("i").alias("intron"), F.max("c").alias("coding"), F.max("u5").alias("utr5"), F.max("u3").alias("utr3")).drop("gid", "chrom")


def find_genes(tx: DataFrame, chrom: str, start: int, end: int | None = None, strand: str | None = None) -> DataFrame:
    """Genes that touch a position or range, both ends included."""
    g = genes(tx).where((F.col("chrom") == chrom) & (F.col("start") <= (start if end is None else end)) & (F.col("end") >= start))
    return g.where(F.col("strand") == strand) if strand else g


def junctions(tx: DataFrame, reference: DataFrame, fragment: int = 46, min_size: int = 50, max_exons: int = 5, known: bool = False, scramble: bool = False, retain_introns: bool = False, chunk: int = 1 << 16) -> DataFrame:
    """Sequences across junctions of a gene's exons: name (chrom:start-end,start-end...) and seq.

    The last `fragment` bases of an exon are followed by the first of any exon after it. As long as that is
    shorter than min_size, and of fewer than max_exons exons, the first bases of each exon further on follow
    as well; what stays too short is left out. An exon must begin after the piece before it ends. known:
    only neighbours in a transcript. scramble: the exons follow on themselves once more, in any place.
    retain_introns (without known): also each exon's end with the intron after it, and each start but a
    gene's first with the intron before it.
    """
    from .pileup import fetch_sequence

    ex = tx.select("gid", "chrom", F.explode("exons").alias("x")).groupBy("gid", "chrom").agg(F.array_sort(F.collect_set(F.struct(F.col("x.start").alias("s"), F.col("x.end").alias("e")))).alias("x"))  # a gene's exons
    span = lambda s, e: F.array(F.struct(s.cast("long").alias("start"), e.cast("long").alias("end")))
    size = lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    last = span(F.greatest("s", F.col("e") - fragment), F.col("e"))
    first = span(F.col("s2"), F.least("e2", F.col("s2") + fragment))
    after = F.lit(True) if scramble else F.col("s2") > F.element_at("parts", -1)["end"]
    if known:
        n = F.size("exons")
        pairs = tx.where(n > 1).select("chrom", F.explode(F.zip_with(F.slice("exons", F.lit(1), n - 1), F.slice("exons", F.lit(2), n - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))).alias("p"))
        pairs = pairs.select("chrom", F.col("p.x.start").alias("s"), F.col("p.x.end").alias("e"), F.col("p.y.start").alias("s2"), F.col("p.y.end").alias("e2")).distinct()
        done = pairs.withColumn("parts", last).where(after).select("chrom", F.concat("parts", first).alias("parts"))
    else:
        each = ex.select("gid", "chrom", F.posexplode(F.concat("x", "x") if scramble else F.col("x")).alias("i", "x")).select("gid", "chrom", "i", F.col("x.s").alias("s"), F.col("x.e").alias("e"))
        following = each.select("gid", "chrom", F.col("i").alias("j"), F.col("s").alias("s2"), F.col("e").alias("e2"))
        open_, done = each.select("gid", "chrom", "i", last.alias("parts")), None
        for k in range(2, max_exons + 1):
            grown = open_.join(following, ["gid", "chrom"]).where((F.col("j") > F.col("i")) & after).select("gid", "chrom", F.col("j").alias("i"), F.concat("parts", first).alias("parts"))
            full = grown.where(size(F.col("parts")) >= min_size).select("chrom", "parts")
            done = full if done is None else done.unionByName(full)
            open_ = grown.where(size(F.col("parts")) < min_size)
    out = done.where(size(F.col("parts")) >= min_size)
    if retain_introns and not known:
        ends = ex.select("chrom", F.posexplode("x").alias("i", "x")).select("chrom", "i", F.col("x.s").alias("s"), F.col("x.e").alias("e"))
        out = out.unionByName(ends.select("chrom", F.concat(last, span(F.col("e"), F.col("e") + fragment)).alias("parts")))
        out = out.unionByName(ends.where("i > 0").select("chrom", F.concat(span(F.greatest(F.col("s") - fragment, F.lit(0)), F.col("s")), span(F.col("s"), F.least("e", F.col("s") + fragment))).alias("parts")))
    name = F.concat(F.col("chrom"), F.lit(":"), F.array_join(F.transform("parts", lambda p: F.concat(p["start"].cast("string"), F.lit("-"), p["end"].cast("string"))), ","))
    out = out.join(reference.select("chrom").distinct(), "chrom", "left_semi").withColumn("name", name).dropDuplicates(["name"])
    bits = out.select("name", "chrom", F.posexplode("parts").alias("k", "p")).select("name", "chrom", "k", F.col("p.start").alias("start"), F.col("p.end").alias("end"))
    seqs = fetch_sequence(bits, reference, chunk)
    return seqs.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "seq"))), lambda x: x["seq"]), "").alias("seq"))


# --- position joins --------------------------------------------------------------------------------

CLASSES = ("coding", "utr-5", "utr-3", "other-exon", "intron", "promoter")


def class_ranges(tx: DataFrame, promoter: int = 2000) -> DataFrame:
    """Ranges by class of a gene model: chrom, start, end, strand, rank (place in CLASSES). The same range comes
    from each transcript that has it."""
    ranked = lambda spans, rank: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(rank).alias("rank")))
    each = [ranked(spans, rank) for rank, spans in enumerate((F.col("cds"), utr5(), utr3(), F.col("exons"), introns_of()))]
    parts = tx.select("chrom", "strand", F.explode(F.concat(*each)).alias("x")).select("chrom", "x.start", "x.end", "strand", "x.rank")
    g = genes(tx)
    plus = F.col("strand") == "+"
    near = g.select("chrom", F.when(plus, F.col("start") - promoter).otherwise(F.col("end")).alias("start"), F.when(plus, F.col("start")).otherwise(F.col("end") + promoter).alias("end"), "strand", F.lit(5).alias("rank"))
    return parts.unionByName(near)


def _side(strand: Column) -> Column:
    return F.when(strand == "+", 0).when(strand == "-", 1).when(strand.isNull(), 2).otherwise(3)


#: By the side of a point and four times the rank of a range plus its side: the class, then unknown, same or other strand.
_RANK = np.array([[4 * (n // 4) + (0 if 2 in (q, n % 4) else 1 if q == n % 4 else 2) for n in range(4 * len(CLASSES))] for q in range(4)])


def _classed(df: DataFrame, ranges: DataFrame, pos: Column, name: str, mitochondrial: str) -> DataFrame:
    """df with the class around pos as name. Classes are laid over each tile once and looked up there."""
    spans = ranges.select(key("chrom").alias("k"), F.col("start").alias("s"), F.col("end").alias("e"), (F.col("rank") * 4 + _side(F.col("strand"))).alias("n")).distinct()
    row = F.struct(*df.columns)
    asked = df.select(key("chrom").alias("k"), pos.cast("long").alias("s"), _side(F.col("strand")).alias("e"), row.alias("row"))
    got = least_around(spans, asked, ("row",), _RANK).unionByName(asked.where("k is null or s is null").select("row", F.lit(-1).cast("long").alias("v")))
    names = F.array(*[F.lit(c) for c in CLASSES])
    tag = F.when(F.col("v") < 0, "intergenic").otherwise(F.concat(F.get(names, F.shiftright("v", 2).cast("int")), F.when(F.col("v").bitwiseAND(3) == 2, "-rev").otherwise("")))
    if "spliced" in df.columns:
        tag = F.when(F.col("row.spliced"), "junction").otherwise(tag)
    return got.select("row.*", F.when(F.col("row.chrom") == mitochondrial, "mitochondrial").otherwise(tag).alias(name))


def classify(points: DataFrame, ranges: DataFrame, mitochondrial: str = "chrM", bin_size: int = BIN) -> DataFrame:
    """points (chrom, pos, strand and, if known, spliced) with tag: the first class with a range around the
    position, with -rev if only ranges of the other strand are; junction for spliced reads, mitochondrial,
    or intergenic. Strands are +, -, unknown (null) or one other mark."""
    return _classed(points, ranges, F.col("pos"), "tag", mitochondrial)


def classify_regions(bed: DataFrame, ranges: DataFrame, mitochondrial: str = "chrM", bin_size: int = BIN) -> DataFrame:
    """bed with tag: the classes of start and last base, joined by / where they differ."""
    one = bed.select(F.struct(*bed.columns).alias("__bed"), "chrom", "strand", "start", "end")
    two = _classed(_classed(one, ranges, F.col("start"), "__a", mitochondrial), ranges, F.col("end") - 1, "__z", mitochondrial)
    return two.select("__bed.*", F.when(F.col("__a") == F.col("__z"), F.col("__a")).otherwise(F.concat_ws("/", "__a", "__z")).alias("tag"))


def annotate(points: DataFrame, tx: DataFrame, bin_size: int = 10_000) -> DataFrame:
    """points (chrom, pos) with gene_ids, gene_names, transcript_ids and locations of the genes around a
    position, joined by commas; location intergenic without one."""
    p = points.withColumns({"__rid": F.monotonically_increasing_id(), "start": F.col("pos").cast("long"), "end": F.col("pos").cast("long")})
    g = genes(tx).select("gid", "chrom", F.col("start").alias("start"), F.col("end").alias("end"))
    hit = overlap_pairs(p.select("__rid", "chrom", "start", "end"), g, False, True, 0, bin_size, ("gid",)).select("__rid", "chrom", F.col("start").alias("at"), F.col("t_gid").alias("gid"))
    t = hit.join(tx.select("gid", "chrom", "gene_id", F.col("gene_name").alias("gene_name"), "strand", "transcript_id", "tx", "first", "exons", "start_codon", "stop_codon"), ["gid", "chrom"])
    at = F.col("at")
    inside = F.exists("exons", lambda x: (x["start"] <= at) & (at < x["end"]))
    plus = F.col("strand") == "+"
    before, after = F.when(plus, at < F.col("start_codon.start")).otherwise(at >= F.col("start_codon.end")), F.when(plus, at >= F.col("stop_codon.end")).otherwise(at < F.col("stop_codon.start"))
    loc = F.when(~inside, "intron").when(before, "5'UTR").when(after, "3'UTR").otherwise("coding")
    rows = t.groupBy("__rid").agg(F.array_sort(F.collect_list(F.struct("first", "gid", "tx", "gene_id", "gene_name", "transcript_id", loc.alias("loc")))).alias("r"))
    gene = F.filter("r", lambda x: x["tx"] == 0)
    text = lambda arr, f: F.array_join(F.transform(arr, lambda x: x[f]), ",")
    out = p.join(rows, "__rid", "left").withColumns({"gene_ids": text(gene, "gene_id"), "gene_names": text(gene, "gene_name"), "transcript_ids": text(F.col("r"), "transcript_id"), "locations": F.coalesce(text(F.col("r"), "loc"), F.lit("intergenic"))})
    return out.na.fill("", ["gene_ids", "gene_names", "transcript_ids"]).drop("__rid", "start", "end", "r")


# --- GTF rows --------------------------------------------------------------------------------------

def _lookup(gtf: DataFrame, table: DataFrame, key: str, values: dict[str, str]) -> DataFrame:
    """Left join of table's columns by transcript_id; of repeated keys the last line counts."""
    last = table.groupBy(key).agg(*[F.max_by(c, "idx").alias(f"__{n}") for n, c in values.items()])
    rows = gtf.withColumn("__t", F.try_element_at("attrs", F.lit("transcript_id")))
    return rows.join(last.withColumnRenamed(key, "__t"), "__t", "left").drop("__t")


def _with_attrs(df: DataFrame, names: list[str]) -> DataFrame:
    """Appends found attributes to the map and to the text."""
    text, attrs = F.col("attributes"), F.col("attrs")
    without = lambda n: lambda k, _: k != n
    for n in names:
        v = F.col(f"__{n}")
        text = F.when(v.isNotNull(), F.concat(F.rtrim(F.rtrim(text), F.lit(";")), F.lit(f'; {n} "'), v, F.lit('";'))).otherwise(text)
        attrs = F.when(v.isNotNull(), F.map_concat(F.map_filter(attrs, without(n)), F.create_map(F.lit(n), v))).otherwise(attrs)
    return df.withColumns({"attributes": text, "attrs": attrs}).drop(*[f"__{n}" for n in names])


def add_isoform(gtf: DataFrame, isoforms: DataFrame) -> DataFrame:
    """isoforms: isoform, transcript, idx."""
    return _with_attrs(_lookup(gtf, isoforms, "transcript", {"isoform_id": "isoform"}), ["isoform_id"])


def add_xref(gtf: DataFrame, xref: DataFrame) -> DataFrame:
    """xref: transcript, name, idx."""
    return _with_attrs(_lookup(gtf, xref, "transcript", {"gene_name": "name"}), ["gene_name"])


def add_reflink(gtf: DataFrame, reflink: DataFrame, replace: bool = False) -> DataFrame:
    """reflink: name, transcript, id, idx. Appends gene_name and isoform_id, or replaces gene_id by the
    name and keeps what it was as orig_gene_id."""
    df = _lookup(gtf, reflink, "transcript", {"gene_name": "name", "isoform_id": "id"})
    if not replace:
        return _with_attrs(df, ["gene_name", "isoform_id"])
    old = F.try_element_at("attrs", F.lit("gene_id"))
    df = df.withColumns({"__orig_gene_id": F.when(F.col("__gene_name").isNotNull(), old), "attributes": F.when(F.col("__gene_name").isNotNull(), F.regexp_replace("attributes", 'gene_id "[^"]*";? ?', "")).otherwise(F.col("attributes"))})
    return _with_attrs(df.withColumnRenamed("__gene_name", "__gene_id").drop("__isoform_id"), ["gene_id", "orig_gene_id"])


def filter_chrom_text(gtf: DataFrame, text: str) -> DataFrame:
    return gtf.where(~F.col("chrom").contains(text))


def to_ucsc(gtf: DataFrame) -> DataFrame:
    """1-22, X, Y and MT as chr1 ... chrM; others go."""
    return gtf.where(F.col("chrom").isin(*NUCLEAR, "MT")).withColumn("chrom", F.when(F.col("chrom") == "MT", "chrM").otherwise(F.concat(F.lit("chr"), "chrom")))


def to_ensembl(gtf: DataFrame) -> DataFrame:
    return gtf.where(F.col("chrom").isin(*[f"chr{c}" for c in NUCLEAR], "chrM")).withColumn("chrom", F.when(F.col("chrom") == "chrM", "MT").otherwise(F.substring("chrom", 4, 100)))


def duplicate_counts(gtf: DataFrame) -> DataFrame:
    """One row, kept and dropped: rows that remove_duplicates keeps and drops."""
    dup = F.coalesce(F.try_element_at("attrs", F.lit("transcript_id")).contains("_dup"), F.lit(False))
    return gtf.agg(F.count_if(~dup).alias("kept"), F.count_if(dup).alias("dropped"))


def in_region_order(found: DataFrame, first: str = "first", bin_size: int = 10_000) -> DataFrame:
    """Genes (chrom, start and `first`, the place of a gene's first row) as an index by bins walks them: by
    chromosome and bin, within a bin in the order of the file."""
    return found.orderBy("chrom", F.floor(F.col("start") / bin_size), first)


def remove_duplicates(gtf: DataFrame) -> DataFrame:
    """Rows whose transcript_id has no _dup."""
    return gtf.where(~F.coalesce(F.try_element_at("attrs", F.lit("transcript_id")).contains("_dup"), F.lit(False)))


def from_gff(gff: DataFrame, genes_: tuple[str, ...] = ("gene",), rnas: tuple[str, ...] = ("mRNA", "rRNA", "tRNA", "ncRNA", "transcript")) -> tuple[DataFrame, DataFrame]:
    """(GTF rows, rows without a known parent). gff: as GTF rows, attrs with ID, Parent and Name. Exons and
    coding parts take gene and transcript from their parents, whatever the order of lines; of several
    parents each gives a row."""
    a = lambda k: F.try_element_at("attrs", F.lit(k))
    g = gff.where(F.col("feature").isin(*genes_)).select(a("ID").alias("__g"), F.coalesce(a("Name"), a("ID")).alias("gene_name")).dropDuplicates(["__g"])
    up = lambda df: df.withColumn("__up", F.explode(F.split(F.coalesce(a("Parent"), F.lit("")), ",")))
    r = up(gff.where(F.col("feature").isin(*rnas))).select(a("ID").alias("__r"), F.col("__up").alias("__g"))
    links = r.join(g, "__g").dropDuplicates(["__r"]).select("__r", "__g", "gene_name")
    parts = up(gff.where(F.col("feature").isin("exon", "CDS", "start_codon", "stop_codon")))
    direct = g.select(F.col("__g").alias("__r"), "__g", "gene_name")  # parts right below a gene
    every = links.unionByName(direct.join(links.select("__r"), "__r", "left_anti"))
    got = parts.join(every, parts["__up"] == every["__r"], "left")
    attrs = F.create_map(F.lit("gene_id"), F.col("__g"), F.lit("transcript_id"), F.col("__up"), F.lit("gene_name"), F.col("gene_name"))
    text = F.concat(F.lit('gene_id "'), "__g", F.lit('"; transcript_id "'), "__up", F.lit('"; gene_name "'), "gene_name", F.lit('";'))
    good = got.where("__g is not null").withColumns({"attrs": attrs, "attributes": text}).select(gff.columns)
    lost = got.where("__g is null").select(*gff.columns, F.col("__up").alias("parent"))
    orphans = up(gff.where(F.col("feature").isin(*rnas))).join(g.select(F.col("__g").alias("__up")), "__up", "left_anti").select(*gff.columns, F.col("__up").alias("parent"))
    return good, lost.unionByName(orphans)

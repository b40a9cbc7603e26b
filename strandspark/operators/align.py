"""Alignments: filter criteria, tags, best mappings, pairs, duplicates and conversions.

Reads have the columns of schemas.READS. Order-dependent operators use idx, the place in the file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import flags as G
from ..functions.sequence import revcomp
from .intervals import BIN, not_overlapping, overlap_pairs
from .tiles import key, nearest_parts



def ops() -> Column:
    return C.parse(F.col("cigar"))


def aend() -> Column:
    return C.end_of(F.col("pos"), ops())


def mapped() -> Column:
    return ~G.has(G.UNMAPPED)


def with_ends(reads: DataFrame) -> DataFrame:
    """Mapped reads as intervals: start, end and strand beside the columns of reads."""
    return reads.where(mapped()).withColumns({"start": F.col("pos").cast("long"), "end": aend().cast("long"), "strand": G.strand()})


# --- filter criteria -------------------------------------------------------------------------------

def is_mapped() -> Column:
    """Mapped, and the mate too if there is one."""
    return mapped() & (~G.has(G.PAIRED) | ~G.has(G.MATE_UNMAPPED))


def is_unmapped() -> Column:
    return ~is_mapped()


def is_proper_pair() -> Column:
    return G.has(G.PAIRED) & mapped() & ~G.has(G.MATE_UNMAPPED) & (G.has(G.REVERSE) != G.has(G.MATE_REVERSE)) & G.has(G.PROPER)


def mask_flag(mask: int | str) -> Column:
    return ~G.has(int(mask, 0) if isinstance(mask, str) else mask)


def exclude_ref(ref: str) -> Column:
    return ~mapped() | (F.col("chrom") != ref)


def include_ref(ref: str) -> Column:
    return F.coalesce(mapped() & (F.col("chrom") == ref), F.lit(False))


def parse_region(region: str) -> tuple[str, int, int]:
    """chrom:start-end, start counted from 1, to 0-based."""
    chrom, _, span = region.partition(":")
    start, _, end = span.partition("-")
    return chrom, int(start) - 1, int(end)


def exclude_region(region: str) -> Column:
    """Neither end of the read lies in the region, both ends of that included. Unmapped reads pass."""
    chrom, start, end = parse_region(region)
    hit = (F.col("chrom") == chrom) & (F.col("pos").between(start, end) | aend().between(start, end))
    return ~mapped() | ~F.coalesce(hit, F.lit(False))


def include_regions(*regions: str) -> Column:
    """Any of the regions is touched."""
    out = F.lit(False)
    for r in regions:
        out = out | (mapped() & ~exclude_region(r))
    return out


def edit_count() -> Column:
    return C.edits(G.tag("NM").cast("int"), ops())


def max_mismatches(n: int) -> Column:
    return F.coalesce(mapped() & (edit_count() <= n), F.lit(False))


def max_mismatch_ratio(ratio: float) -> Column:
    return F.coalesce(mapped() & (edit_count() <= F.lit(ratio) * F.length("seq")), F.lit(False))


def min_length(n: int) -> Column:
    return F.length("seq") >= n


def max_length(n: int) -> Column:
    return F.length("seq") <= n


def _tag_value(tag: str, value) -> tuple[Column, Column]:
    name, _, kind = tag.partition(":")
    found = F.col("mapq").cast("string") if name == "MAPQ" else G.tag(name)
    text = str(value)

    def number(t):
        try:
            t(text)
            return True
        except ValueError:
            return False

    if kind == "i" or kind == "" and number(int):
        return found.try_cast("bigint"), F.lit(int(text))
    if kind == "f" or kind == "" and number(float):
        return found.try_cast("double"), F.lit(float(text))
    if kind == "H":
        return F.conv(found, 16, 10).try_cast("bigint"), F.lit(int(text, 16))
    return found, F.lit(text)


def tag_compare(op: str, tag: str, value) -> Column:
    """op: lt, lte, gt, gte or eq. tag: NAME[:type] or MAPQ. A missing tag is less than anything."""
    a, b = _tag_value(tag, value)
    test = {"lt": a < b, "lte": a <= b, "gt": a > b, "gte": a >= b, "eq": a == b}[op]
    return F.coalesce(test, F.lit(op in ("lt", "lte")))


#: Criteria by name that are one expression over a read.
CRITERIA: dict[str, Callable[..., Column]] = {
    "mapped": is_mapped, "unmapped": is_unmapped, "properpair": is_proper_pair, "noproperpair": lambda: ~is_proper_pair(),
    "mask": mask_flag, "nosecondary": lambda: mask_flag(G.SECONDARY), "noqcfail": lambda: mask_flag(G.QCFAIL), "nopcrdup": lambda: mask_flag(G.DUPLICATE),
    "excluderef": exclude_ref, "includeref": include_ref, "exclude": exclude_region, "include": include_regions, "mismatch": max_mismatches,
    "maximum_mismatch_ratio": max_mismatch_ratio, "minlen": min_length, "length": min_length, "maxlen": max_length,
    **{op: (lambda o: lambda tag, value: tag_compare(o, tag, value))(op) for op in ("lt", "lte", "gt", "gte", "eq")},
}


def filter_reads(reads: DataFrame, *criteria: tuple) -> DataFrame:
    """reads with fail_reason: the first criterion (name, arguments...) that a read fails, null if none."""
    reason = None
    for name, *args in criteria:
        fails = ~F.coalesce(CRITERIA[name](*args), F.lit(False))
        reason = F.when(fails, name) if reason is None else reason.when(fails, name)
    return reads.withColumn("fail_reason", reason if reason is not None else F.lit(None).cast("string"))


def unique_sequence(reads: DataFrame, length: int | None = None) -> DataFrame:
    """The first read of each sequence at each position; reverse reads by their sequence backwards, of
    which `length` characters count. Unmapped reads pass."""
    seq = F.when(G.has(G.REVERSE), F.reverse("seq")).otherwise(F.col("seq"))
    key = F.substring(seq, 1, length) if length else seq
    w = Window.partitionBy("chrom", "pos", key).orderBy("idx")
    return reads.withColumn("__n", F.when(mapped(), F.row_number().over(w)).otherwise(1)).where("__n = 1").drop("__n")


def unique_start(reads: DataFrame) -> DataFrame:
    """One forward read for each start, one reverse read for each end."""
    w = Window.partitionBy("chrom", G.strand(), F.when(G.has(G.REVERSE), aend()).otherwise(F.col("pos"))).orderBy("idx")
    return reads.where(mapped()).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def in_list(reads: DataFrame, names: DataFrame) -> DataFrame:
    return reads.join(names.select(F.col("name").alias("qname")).distinct(), "qname", "left_semi").select(reads.columns)


def not_in_list(reads: DataFrame, names: DataFrame) -> DataFrame:
    return reads.join(names.select(F.col("name").alias("qname")).distinct(), "qname", "left_anti").select(reads.columns)


def exclude_bed(reads: DataFrame, bed: DataFrame, stranded: bool = True, bin_size: int = BIN) -> DataFrame:
    """Mapped reads that touch no region. Unmapped reads fail."""
    return not_overlapping(with_ends(reads), bed, stranded, True).select(reads.columns)


def include_bed(reads: DataFrame, bed: DataFrame, stranded: bool = True, bin_size: int = BIN) -> DataFrame:
    """Reads that touch a region, and unmapped ones."""
    hit = overlap_pairs(with_ends(reads).withColumn("__rid", F.monotonically_increasing_id()), bed, stranded, True, 0, bin_size, ()).dropDuplicates(["__rid"])
    return hit.select(reads.columns).unionByName(reads.where(~mapped()))


# --- projections -----------------------------------------------------------------------------------

def to_bed(reads: DataFrame) -> DataFrame:
    return with_ends(reads).select("chrom", "start", "end", F.col("qname").alias("name"), F.lit(0).alias("score"), "strand")


def to_fastq(reads: DataFrame, show_mapped: bool = True, show_unmapped: bool = True, read1: bool = True, read2: bool = True, proper: bool = False, colorspace: bool = False) -> DataFrame:
    """idx, name, seq, qual as sequenced; a record that repeats name and sequence of the one before goes."""
    keep = (F.lit(show_mapped) & mapped()) | (F.lit(show_unmapped) & ~mapped())
    if not read1:
        keep = keep & ~G.has(G.READ1)
    if not read2:
        keep = keep & ~G.has(G.READ2)
    if proper:
        keep = keep & is_proper_pair()
    rev = G.has(G.REVERSE)
    seq = F.when(rev, F.reverse("seq") if colorspace else revcomp(F.col("seq"))).otherwise(F.col("seq"))
    rows = reads.where(keep).select("idx", F.col("qname").alias("name"), seq.alias("seq"), F.when(rev, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"))
    # records that follow each other have one name, so the window is cut by name, not by file
    w = Window.partitionBy("name").orderBy("idx")
    return rows.withColumn("__p", F.lag("seq").over(w)).where("__p is null or __p <> seq").drop("__p")


def add_tag(reads: DataFrame, spec: str) -> DataFrame:
    """KEY[:type]:VALUE appended to every read's tags."""
    parts = spec.split(":")
    key, kind, value = (parts[0], parts[1], ":".join(parts[2:])) if len(parts) > 2 else (parts[0], "Z", parts[1])
    return reads.withColumn("tags", G.put_tag(key, kind, F.lit(value)))


def add_suffix(reads: DataFrame, suffix: str) -> DataFrame:
    return reads.withColumn("qname", F.concat("qname", F.lit(suffix)))


def tag_strand(reads: DataFrame) -> DataFrame:
    return reads.withColumn("tags", F.when(mapped(), G.put_tag("XS", "A", G.strand())).otherwise(F.col("tags")))


def tag_origin(reads: DataFrame, ref: str | None = None, pos: str | None = None, cigar: str | None = None) -> DataFrame:
    """Where a read is, under the given tag names; * and -1 for unmapped reads."""
    for name, kind, value in ((ref, "Z", F.when(mapped(), F.col("chrom")).otherwise("*")), (pos, "i", F.when(mapped(), F.col("pos")).otherwise(-1)), (cigar, "Z", F.when(mapped(), F.col("cigar")).otherwise("*"))):
        if name:
            reads = reads.withColumn("tags", G.put_tag(name, kind, value))
    return reads


def junction_text(sep: str = ">") -> Column:
    return F.array_join(F.transform(C.junctions(F.col("pos"), ops()), lambda j: F.concat(F.col("chrom"), F.lit(":"), j["start"].cast("string"), F.lit(sep), j["end"].cast("string"))), ",")


def tag_junctions(reads: DataFrame, name: str = "ZJ") -> DataFrame:
    text = junction_text()
    return reads.withColumn("tags", F.when(mapped() & (text != ""), G.put_tag(name, "Z", text)).otherwise(F.col("tags")))


def rename_pairs(reads: DataFrame, delimiter: str = "/") -> DataFrame:
    """Splits names at the last delimiter; what follows goes to tag ZN."""
    d = "\\" + delimiter
    cut = F.col("qname").contains(delimiter)
    tags = F.when(cut, G.put_tag("ZN", "Z", F.regexp_extract("qname", f"{d}([^{d}]*)$", 1))).otherwise(F.col("tags"))
    return reads.withColumns({"tags": tags, "qname": F.when(cut, F.regexp_extract("qname", f"^(.*){d}[^{d}]*$", 1)).otherwise(F.col("qname"))})


def remove_clipping(reads: DataFrame) -> DataFrame:
    """Drops H and S with their bases; ZA and ZB are the soft-clipped bases in front and behind, ZC their share."""
    o = ops()
    inner = F.filter(o, lambda x: x["op"] != "H")
    first, last = F.try_element_at(inner, F.lit(1)), F.try_element_at(inner, F.lit(-1))
    front = F.coalesce(F.when(first["op"] == "S", first["len"]), F.lit(0))
    back = F.coalesce(F.when((F.size(inner) > 1) & (last["op"] == "S"), last["len"]), F.lit(0))
    n = F.length("seq")
    clipped = front + back > 0
    share = (front + back) / n
    tags = F.when(clipped, G.put_tag("ZC", "f", share, G.put_tag("ZB", "i", back, G.put_tag("ZA", "i", front)))).otherwise(F.col("tags"))
    out = reads.withColumns({"__t": tags, "__s": F.substring(F.col("seq"), front + 1, n - front - back), "__q": F.substring(F.col("qual"), front + 1, n - front - back), "__c": C.to_string(F.filter(o, lambda x: ~x["op"].isin("H", "S")))})
    return out.withColumns({"tags": F.when(mapped(), F.col("__t")).otherwise(F.col("tags")), "seq": F.when(mapped(), F.col("__s")).otherwise(F.col("seq")), "qual": F.when(mapped(), F.col("__q")).otherwise(F.col("qual")), "cigar": F.when(mapped(), F.col("__c")).otherwise(F.col("cigar"))}).drop("__t", "__s", "__q", "__c")


def clean_cigar(reads: DataFrame) -> DataFrame:
    return reads.withColumn("cigar", F.when(mapped(), C.to_string(C.clean(ops()))).otherwise(F.col("cigar")))


def to_unmapped(reads: DataFrame) -> DataFrame:
    """Placement reset, bases as sequenced; of the flags only what tells of pairs stays."""
    rev = G.has(G.REVERSE)
    keep = G.PAIRED | G.READ1 | G.READ2
    return reads.withColumns({
        "seq": F.when(rev, revcomp(F.col("seq"))).otherwise(F.col("seq")), "qual": F.when(rev, F.reverse("qual")).otherwise(F.col("qual")),
        "flag": F.col("flag").bitwiseAND(F.lit(keep)).bitwiseOR(F.lit(G.UNMAPPED)), "chrom": F.lit(None).cast("string"), "pos": F.lit(-1), "mapq": F.lit(0), "cigar": F.lit("*"),
        "rnext": F.lit(None).cast("string"), "pnext": F.lit(-1), "tlen": F.lit(0),
    })


def export(reads: DataFrame, *fields: str) -> DataFrame:
    """Chosen fields as columns; positions from 1. -tag:X gives one tag, -tag:* all of them as K:t:v."""
    known = {
        "name": F.col("qname"), "ref": F.coalesce("chrom", F.lit("*")), "pos": F.col("pos") + 1, "cigar": F.col("cigar"), "flags": F.col("flag"), "mapq": F.col("mapq"),
        "nextref": F.coalesce("rnext", F.lit("*")), "nextpos": F.col("pnext") + 1, "isize": F.col("tlen"), "tlen": F.col("tlen"), "seq": F.col("seq"), "qual": F.col("qual"), "strand": G.strand(),
    }
    cols = []
    for f in fields:
        f = f.lstrip("-")
        if f == "tag:*":
            pairs = F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat_ws(":", e["key"], e["value"]["t"], e["value"]["v"]))
            cols.append(F.array_join(pairs, "\t").alias("tags"))
        elif f.startswith("tag:"):
            cols.append(F.coalesce(G.tag(f[4:].split(":")[0]), F.lit("")).alias(f[4:].split(":")[0]))
        else:
            cols.append(known[f].alias(f))
    return reads.select(*cols)


def split_number(reads: DataFrame, count: int, tile: int = 1_000_000) -> DataFrame:
    """reads with part: file of `count` reads each, in file order. Ranks are counted by runs of idx."""
    from .intervals import carry

    df = reads.withColumn("__tile", F.floor(F.col("idx") / tile))
    df = carry(df, [], "__tile", F.count("*"), F.sum, "__before")
    rank = F.row_number().over(Window.partitionBy("__tile").orderBy("idx")) - 1 + F.coalesce("__before", F.lit(0))
    return df.withColumn("part", F.floor(rank / count)).drop("__tile", "__before")


# --- ranking ---------------------------------------------------------------------------------------

def _tag_order(tags: tuple[str, ...]) -> list[Column]:
    """AS+ : the larger the better, NM- : the smaller."""
    out = []
    for t in tags:
        v = G.tag(t[:2]).try_cast("double")
        out.append(v.asc_nulls_last() if t.endswith("-") else v.desc_nulls_last())
    return out


def best_mappings(reads: DataFrame, tags: tuple[str, ...] = ("AS+", "NM-")) -> DataFrame:
    """reads with best: whether no mapping of that name has a better list of tags. Unmapped reads rank last."""
    w = Window.partitionBy("qname").orderBy(mapped().desc(), *_tag_order(tags))
    return reads.withColumn("best", F.rank().over(w) == 1)


def keep_best(reads: DataFrame, tag: str = "AS") -> DataFrame:
    """Reads with the largest value of a tag, or MAPQ, for their name; a missing value is -1; ties stay."""
    value = F.coalesce(F.col("mapq").cast("double") if tag == "MAPQ" else G.tag(tag).try_cast("double"), F.lit(-1.0))
    return reads.withColumn("__r", F.rank().over(Window.partitionBy("qname").orderBy(value.desc()))).where("__r = 1").drop("__r")


def merge_best(files: list[DataFrame], tags: tuple[str, ...] = ("AS+", "NM-"), discard_unmapped: bool = False, keep_all: bool = False) -> DataFrame:
    """Mappings of several files, with source, that are best for their name; ties of any file stay.
    keep_all: the best at each position of each name. Names that are mapped nowhere give one unmapped read."""
    every = None
    for i, df in enumerate(files):
        one = df.withColumn("source", F.lit(i))
        every = one if every is None else every.unionByName(one)
    order = [mapped().desc(), *_tag_order(tags)]
    if keep_all:
        w = Window.partitionBy("qname", "chrom", "pos").orderBy(*order, "source", "idx")
        found = every.where(mapped()).withColumn("__r", F.row_number().over(w))
    else:
        found = every.where(mapped()).withColumn("__r", F.rank().over(Window.partitionBy("qname").orderBy(*order)))
    out = found.where("__r = 1").drop("__r")
    if discard_unmapped:
        return out
    w = Window.partitionBy("qname").orderBy("source", "idx")
    every = every.withColumn("__any", F.max(mapped().cast("int")).over(Window.partitionBy("qname")))
    lost = every.where("__any = 0").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__any")
    return out.unionByName(lost)


def pair_reads(reads1: DataFrame, reads2: DataFrame, tags: tuple[str, ...] = ("AS+", "NM-"), min_size: int = 50, max_size: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(pairs, failures). Mappings of one name pair if both are mapped, to one reference, on opposite
    strands, facing each other, with a size in range. The best sum of tags, then the smallest size wins;
    ties all stay, and nh is their number. failures: read number, name, position and reasons of mappings
    that are in no valid pair."""
    def side(df: DataFrame, n: int) -> DataFrame:
        keep = df.select(
            "qname", F.col("idx").alias(f"idx{n}"), F.col("chrom").alias(f"chrom{n}"), F.col("pos").alias(f"pos{n}"), aend().alias(f"aend{n}"), G.has(G.REVERSE).alias(f"rev{n}"), mapped().alias(f"map{n}"),
            *[G.tag(t[:2]).try_cast("double").alias(f"{t[:2]}{n}") for t in tags],
        )
        return keep

    both = side(reads1, 1).join(side(reads2, 2), "qname")
    c = F.col
    size = F.greatest(c("aend2") - c("pos1"), c("aend1") - c("pos2"))
    reason = (
        F.when(~c("map1") | ~c("map2"), "unmapped").when(c("chrom1") != c("chrom2"), "chromosome").when(c("rev1") == c("rev2"), "orientation")
        .when((c("pos1") < c("pos2")) & c("rev1"), "direction").when((c("pos2") < c("pos1")) & c("rev2"), "direction").when((size < min_size) | (size > max_size), "size")
    )
    both = both.withColumns({"size": size, "reason": reason})
    order = [(c(f"{t[:2]}1") + c(f"{t[:2]}2")).asc_nulls_last() if t.endswith("-") else (c(f"{t[:2]}1") + c(f"{t[:2]}2")).desc_nulls_last() for t in tags]
    w = Window.partitionBy("qname").orderBy(*order, "size")
    pairs = both.where("reason is null").withColumn("__r", F.rank().over(w)).where("__r = 1")
    pairs = pairs.withColumn("nh", F.count("*").over(Window.partitionBy("qname"))).select("qname", "idx1", "idx2", "chrom1", "pos1", "pos2", "size", "nh")
    ends = None
    for n in (1, 2):
        one = both.groupBy(F.lit(n).alias("read"), "qname", F.col(f"chrom{n}").alias("chrom"), F.col(f"pos{n}").alias("pos")).agg(F.count_if(F.col("reason").isNull()).alias("__ok"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
        one = one.where("__ok = 0").drop("__ok")
        ends = one if ends is None else ends.unionByName(one)
    return pairs, ends


def mark_duplicates(reads: DataFrame, fragment: bool = False) -> DataFrame:
    """reads with the duplicate bit set on all mapped ones but the best of each (reference, position and,
    unless fragment, template length): the highest MAPQ, then the earliest. The mates of marked reads are
    marked too, by name."""
    key = ["chrom", "pos"] + ([] if fragment else ["tlen"])
    leads = mapped() if fragment else mapped() & (~G.has(G.PAIRED) | (F.col("tlen") >= 0))
    w = Window.partitionBy(*key).orderBy(F.desc("mapq"), "idx")
    keyed = reads.withColumn("__lead", leads)
    ranked = keyed.where("__lead").withColumn("__dup", F.row_number().over(w) > 1)
    names = ranked.where(F.col("__dup") & G.has(G.PAIRED)).select("qname").distinct().withColumn("__hit", F.lit(True))
    rest = keyed.where("not __lead").join(names, "qname", "left").withColumn("__dup", F.coalesce("__hit", F.lit(False)) & mapped()).drop("__hit")
    every = ranked.unionByName(rest.select(ranked.columns))
    return every.withColumn("flag", F.when(F.col("__dup"), F.col("flag").bitwiseOR(F.lit(G.DUPLICATE))).otherwise(F.col("flag"))).select(reads.columns)


def duplicate_counts(reads: DataFrame) -> DataFrame:
    """Reads of each (reference, position, template length)."""
    return reads.where(mapped()).groupBy("chrom", "pos", "tlen").agg(F.count("*").alias("n"))


def inner_distance(reads1: DataFrame, reads2: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distance for each name whose first mappings lie on one reference, summary): the gap between mates,
    its mean, deviation and number, and counts of the four orientations."""
    def first(df: DataFrame, n: int) -> DataFrame:
        one = df.where(mapped()).withColumn("__n", F.row_number().over(Window.partitionBy("qname").orderBy("idx"))).where("__n = 1")
        return one.select("qname", F.col("chrom").alias(f"c{n}"), F.col("pos").alias(f"p{n}"), aend().alias(f"e{n}"), G.strand().alias(f"s{n}"))

    both = first(reads1, 1).join(first(reads2, 2), "qname").where("c1 = c2")
    gap = F.when(F.col("p1") < F.col("p2"), F.col("p2") - F.col("e1")).otherwise(F.col("p1") - F.col("e2"))
    each = both.select("qname", gap.alias("distance"), F.concat("s1", F.lit("/"), "s2").alias("orientation"))
    from ..functions.stats import stdev

    total = each.agg(F.count("*").alias("n"), F.avg("distance").alias("mean"), stdev(F.col("distance")).alias("stdev"), *[F.count_if(F.col("orientation") == o).alias(n) for o, n in (("+/+", "plus_plus"), ("+/-", "plus_minus"), ("-/+", "minus_plus"), ("-/-", "minus_minus"))])
    return each, total


def nearest_region(reads: DataFrame, bed: DataFrame, maxdist: int = 100_000) -> DataFrame:
    """qname and distance of the nearest region on a read's strand; negative downstream, as the read goes,
    null if there is none within maxdist."""
    place = ["chrom", "strand", "start", "end"]
    q = with_ends(reads).select("idx", "qname", *place)
    ends = (key("chrom", "strand").alias("k"), F.col("start").alias("s"), F.col("end").alias("e"))
    spans = bed.select(*ends).distinct().withColumn("n", F.lit(1))
    near = nearest_parts(spans, q.select(*place).distinct().select(*place, *ends), tuple(place), maxdist).groupBy(*place).agg(F.min("v").alias("__v"))
    far, side = F.shiftright("__v", 2), F.col("__v").bitwiseAND(3)
    back = (F.col("strand") == "+") & (side == 1) | (F.col("strand") == "-") & (side == 2)
    return q.join(near, place, "left").select("idx", "qname", F.when(back, -far).otherwise(far).alias("distance"))


def extract(reads: DataFrame, bed: DataFrame, stranded: bool = True, bin_size: int = BIN) -> DataFrame:
    """Reads of which an aligned piece touches a region, with the region's start, end and name; once for
    each such region. Gaps don't count."""
    once = "region" not in bed.columns or bed.groupBy("region").count().where("count > 1").isEmpty()
    parts = with_ends(reads).withColumn("__rid", F.monotonically_increasing_id()).withColumn("__all", C.blocks(F.col("pos"), ops()))
    parts = parts.select("*", F.posexplode("__all").alias("__i", "__b")).withColumns({"start": F.col("__b.start").cast("long"), "end": F.col("__b.end").cast("long")}).drop("__b")
    regions = bed.withColumn("region", F.monotonically_increasing_id()) if "region" not in bed.columns else bed
    hits = overlap_pairs(parts, regions, stranded, True, 0, bin_size, ("start", "end", "name", "region"))
    if once:  # a region is met by the first piece that touches it, so pairs needn't be compared
        hits = hits.where(~F.exists(F.slice("__all", F.lit(1), F.col("__i")), lambda x: (x["start"] <= F.col("t_end")) & (F.col("t_start") <= x["end"])))
    else:
        hits = hits.dropDuplicates(["__rid", "t_region"])
    return hits.select(*reads.columns, F.col("t_start").alias("region_start"), F.col("t_end").alias("region_end"), F.col("t_name").alias("region_name"))


def junction_counts(reads: DataFrame) -> DataFrame:
    """junction (chrom:start-end of a read's first gap) and the number of names that have it."""
    first = F.get(C.junctions(F.col("pos"), ops()), F.lit(0))
    j = reads.where(mapped()).select("qname", "chrom", first.alias("j")).where("j is not null")
    name = F.concat(F.col("chrom"), F.lit(":"), F.col("j.start").cast("string"), F.lit("-"), F.col("j.end").cast("string"))
    return j.groupBy(name.alias("junction")).agg(F.count_distinct("qname").alias("reads"))


# --- statistics ------------------------------------------------------------------------------------

def once_per_read(reads: DataFrame) -> DataFrame:
    """A name that maps to several places counts once: its first mapping; others are all kept."""
    many = F.coalesce(G.tag("IH").try_cast("int"), G.tag("NH").try_cast("int"), F.lit(1)) > 1
    w = Window.partitionBy("qname", many, G.has(G.READ2)).orderBy("idx")
    return reads.withColumn("__n", F.when(many, F.row_number().over(w)).otherwise(1)).where("__n = 1").drop("__n")


def read_stats(reads: DataFrame) -> DataFrame:
    """One row: total, mapped, unmapped, a count for each flag bit and the mean and deviation of template lengths."""
    from ..functions.stats import stdev

    size = F.when(mapped() & (F.col("tlen") > 0), F.col("tlen"))
    return once_per_read(reads).agg(
        F.count("*").alias("total"), F.count_if(mapped()).alias("mapped"), F.count_if(~mapped()).alias("unmapped"),
        *[F.count_if(G.has(b)).alias(f"flag_{b}") for b in G.LABELS], F.avg(size).alias("tlen_mean"), stdev(size).alias("tlen_stdev"),
    )


def report(reads: DataFrame, ranges: DataFrame | None = None, region: str | None = None, delimiter: str | None = None, tags: tuple[str, ...] = (), first_only: bool = True) -> DataFrame:
    """section, key and n of one file's report: reads (total, mapped, unmapped), flags by bit, references
    (up to the delimiter), classes of gene regions where ranges (genes.class_ranges) are given, and values of
    tags, MAPQ and LENGTH. region: only reads that overlap chrom:start-end. first_only: of pairs only the
    first read; classes go by that whatever is asked for. All sections are counted in one pass."""
    from .genes import classify

    r = reads
    if region is not None:
        chrom, start, end = parse_region(region)
        r = r.where(mapped() & (F.col("chrom") == chrom) & (F.col("pos") < end) & (C.end_of(F.col("pos"), ops()) > start))
    first = ~G.has(G.PAIRED) | G.has(G.READ1)
    r = once_per_read(r.where(first) if first_only else r)
    entry = lambda section, key, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(section).alias("section"), key.cast("string").alias("key")))
    ref = F.split("chrom", "\\" + delimiter).getItem(0) if delimiter else F.col("chrom")
    values = {t: F.col("mapq") if t == "MAPQ" else F.length("seq") if t == "LENGTH" else G.tag(t) for t in tags}
    entries = [entry("reads", F.lit("total")), entry("reads", F.when(mapped(), "mapped").otherwise("unmapped")), entry("reference", ref, mapped())]
    entries += [entry("flag", F.lit(str(b)), G.has(b)) for b in G.LABELS] + [entry(t, v, mapped() & v.isNotNull()) for t, v in values.items()]
    if ranges is not None:
        points = r.withColumns({"strand": G.strand(), "spliced": F.coalesce(F.col("cigar"), F.lit("")).contains("N")})
        r = classify(points, ranges)
        entries.append(entry("class", F.col("tag"), mapped() & first))
    each = r.select(F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("x"))
    return each.groupBy(F.col("x.section").alias("section"), F.col("x.key").alias("key")).agg(F.count("*").alias("n"))


def reference_counts(reads: DataFrame, delimiter: str | None = None) -> DataFrame:
    ref = F.split("chrom", "\\" + delimiter).getItem(0) if delimiter else F.col("chrom")
    return once_per_read(reads).where(mapped()).groupBy(ref.alias("ref")).agg(F.count("*").alias("n"))


def tag_distribution(reads: DataFrame, tag: str, fill: bool = True, ascending: bool = True) -> DataFrame:
    """value, n and pct (cumulative share of mapped reads, in hundredths) of an integer tag, MAPQ or LENGTH.
    Values without reads between the least and the largest are listed with 0 if fill."""
    value = F.col("mapq") if tag == "MAPQ" else F.length("seq") if tag == "LENGTH" else G.tag(tag)
    base = once_per_read(reads).where(mapped()).select(value.try_cast("bigint").alias("value"))
    counts = base.where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    total = base.agg(F.count("*").alias("__all"))
    if fill:
        span = counts.agg(F.min("value").alias("a"), F.max("value").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("value"))
        counts = span.join(counts, "value", "left").na.fill(0, ["n"])
    w = Window.orderBy(F.col("value").asc() if ascending else F.col("value").desc()).rowsBetween(Window.unboundedPreceding, 0)
    # one row for each value of the tag, and a total of one row
    return counts.crossJoin(F.broadcast(total)).select("value", "n", (F.sum("n").over(w) * 100.0 / F.col("__all")).alias("pct"))


# --- coordinates of concatenated fragments ---------------------------------------------------------

def convert_regions(reads: DataFrame, overlap: int = 4, keep_unmapped: bool = True, sizes: DataFrame | None = None, validate_only: bool = False) -> DataFrame:
    """Reads mapped to references named chrom:start-end,start-end... placed on chrom, with N operations
    between fragments. Mappings whose gaps have less than `overlap` bases on either side are dropped; NH,
    IH and HI are set to what is left of each name. A name of which nothing is left comes back once,
    unmapped, with the reason in ZR, if keep_unmapped. An overlap of 0 converts without a check, and drops
    nothing. validate_only: reads stay where they are, and only what the check says of them counts. sizes
    (chrom, length): a chromosome that it has not is an error."""
    name = F.col("chrom")
    frags = F.transform(F.split(F.regexp_extract(name, ":(.*)$", 1), ","), lambda p: F.struct(F.split(p, "-").getItem(0).try_cast("int").alias("s"), F.split(p, "-").getItem(1).try_cast("int").alias("e")))
    m = reads.where(mapped() & name.contains(":")).withColumns({"__f": frags, "__o": ops()})
    # fragments with what precedes them, so that positions map by lookup
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<s:int,e:int,off:int>>").alias("out"))
    placed = F.aggregate(F.col("__f"), zero, lambda a, f: F.struct((a["n"] + f["e"] - f["s"]).alias("n"), F.concat(a["out"], F.array(F.struct(f["s"].alias("s"), f["e"].alias("e"), a["n"].alias("off")))).alias("out")))["out"]
    m = m.withColumn("__p", placed)
    first = F.element_at(F.filter("__p", lambda f: (f["off"] <= F.col("pos")) & (F.col("pos") < f["off"] + f["e"] - f["s"])), 1)
    walked = C.walk(F.col("pos"), F.col("__o"))

    def cut(o: Column) -> Column:
        """An operation on the reference, cut where fragments meet; a gap goes after each cut."""
        inner = F.filter(F.col("__p"), lambda f: (f["off"] < o["ref"] + o["len"]) & (o["ref"] < f["off"] + f["e"] - f["s"]))
        pieces = F.transform(inner, lambda f: F.struct((F.least(o["ref"] + o["len"], f["off"] + f["e"] - f["s"]) - F.greatest(o["ref"], f["off"])).alias("len"), o["op"].alias("op"), f["off"].alias("off")))
        same = F.array(F.struct(o["len"].alias("len"), o["op"].alias("op"), F.lit(-1).alias("off")))
        return F.when(o["op"].isin(*C.ON_REF), pieces).otherwise(same)

    m = m.withColumn("__pieces", F.flatten(F.transform(walked, cut)))
    frag_at = lambda off: F.element_at(F.filter(F.col("__p"), lambda f: f["off"] == off), 1)
    start = F.struct(first["off"].alias("off"), F.array().cast(C.OPS).alias("out"))

    def join(a: Column, p: Column) -> Column:
        moved = (p["off"] >= 0) & (p["off"] != a["off"])
        gap = F.struct((frag_at(p["off"])["s"] - frag_at(a["off"])["e"]).alias("len"), F.lit("N").alias("op"))
        piece = F.array(F.struct(p["len"].alias("len"), p["op"].alias("op")))
        return F.struct(F.when(p["off"] >= 0, p["off"]).otherwise(a["off"]).alias("off"), F.when(moved, F.concat(a["out"], F.array(gap), piece)).otherwise(F.concat(a["out"], piece)).alias("out"))

    new = C.clean(F.aggregate("__pieces", start, join)["out"])
    m = m.withColumns({"__new": new, "__at": first["s"] + F.col("pos") - first["off"]})
    checked = C.junction_valid(F.col("__new"), overlap)
    m = m.withColumn("__v", checked if overlap else F.struct(F.lit(True).alias("valid"), F.lit("").alias("reason")))
    m = m.withColumns({"__ok": F.col("__v.valid"), "__why": F.col("__v.reason")})
    if not validate_only:
        m = m.withColumns({"chrom": F.regexp_extract("chrom", "^([^:]*):", 1), "pos": F.col("__at"), "cigar": C.to_string(F.col("__new"))})
        if sizes is not None:
            m = m.join(sizes.select("chrom", F.lit(True).alias("__there")), "chrom", "left")
            m = m.withColumn("chrom", F.when(F.col("__there"), F.col("chrom")).otherwise(F.raise_error(F.concat(F.lit("no such chromosome: "), "chrom")).cast("string")))
    if not overlap:
        return m.select(reads.columns)
    w = Window.partitionBy("qname")
    m = m.withColumn("__n", F.count_if("__ok").over(w)).withColumn("__i", F.row_number().over(w.orderBy(F.desc("__ok"), "idx")))
    good = m.where("__ok")
    for t, v in (("NH", F.col("__n")), ("IH", F.col("__n")), ("HI", F.col("__i"))):
        good = good.withColumn("tags", G.put_tag(t, "i", v))
    good = good.select(reads.columns)
    if not keep_unmapped:
        return good
    lost = m.where("__n = 0 and __i = 1").withColumn("tags", G.put_tag("ZR", "Z", F.col("__why")))
    return good.unionByName(to_unmapped(lost.select(reads.columns)))

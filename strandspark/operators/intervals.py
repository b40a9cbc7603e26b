"""Interval algebra: overlap, nearest and difference joins, merging, coverage.

Range joins go by bins: each interval is listed under every bin that it touches, bins are joined by
equality with chromosome (and strand), and a pair counts in the one bin where the later of the two
begins. Scans along a chromosome (running maxima and sums) are cut into tiles: each tile is scanned on
its own and a table with one row for each tile carries results across, so that no task holds a whole
chromosome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tiles import key, meeting

#: Default bin of range joins and tile of scans, in bases.
BIN, TILE = 1000, 1_000_000
#: Tile of sweeps that look for one neighbour.
SWEEP = 1 << 17


def with_bins(df: DataFrame, start: Column, end: Column, size: int, col: str = "bin") -> DataFrame:
    first = F.floor(start / size)
    return df.withColumn(col, F.explode(F.sequence(first, F.greatest(first, F.floor(end / size)))))


def overlap_pairs(query: DataFrame, target: DataFrame, stranded: bool = True, closed: bool = True, margin: int = 0, bin_size: int = BIN, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Pairs of intervals that overlap: columns of query, and those of target prefixed t_ (keep names them).

    closed: intervals that only touch overlap too. stranded: both have the same strand. A target within
    `margin` bases counts as overlapping. Both need chrom, start, end and, if stranded, strand.
    """
    cols = keep if keep is not None else tuple(target.columns)
    need = dict.fromkeys(("chrom", "start", "end", *(("strand",) if stranded else ()), *cols))
    t = target.select(*[F.col(c).alias(f"t_{c}") for c in need])
    lo, hi = F.greatest(F.col("start") - margin, F.lit(0)), F.col("end") + margin
    q = with_bins(query.withColumns({"__lo": lo, "__hi": hi}), F.col("__lo"), F.col("__hi"), bin_size, "__bin")
    t = with_bins(t, F.col("t_start"), F.col("t_end"), bin_size, "t___bin")
    on = (F.col("chrom") == F.col("t_chrom")) & (F.col("__bin") == F.col("t___bin"))
    if stranded:
        on = on & (F.col("strand") == F.col("t_strand"))
    touch = (F.col("__lo") <= F.col("t_end")) & (F.col("t_start") <= F.col("__hi")) if closed else (F.col("__lo") < F.col("t_end")) & (F.col("t_start") < F.col("__hi"))
    once = F.col("__bin") == F.greatest(F.floor(F.col("__lo") / bin_size), F.floor(F.col("t_start") / bin_size))
    return q.join(t, on & touch & once).select(*query.columns, *[f"t_{c}" for c in cols])


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("__rid", F.monotonically_increasing_id())


def furthest(query: DataFrame, target: DataFrame, keys: list[str], at: Column, t_at: Column, value: Column, closed: bool, name: str, tile: int = SWEEP) -> DataFrame:
    """query with name: the greatest value of targets of the same keys whose t_at is before `at` (or equal, if
    closed); null without one, or where a key is null. One sweep: targets of one place are merged first,
    queries and targets are sorted together within tiles, and maxima are carried across tiles."""
    k = [f"__{c}" for c in keys]
    known = F.lit(True)
    for c in keys:
        known = known & F.col(c).isNotNull()
    row = F.struct(*query.columns)
    q = query.where(known).select(*[F.col(c).alias(n) for c, n in zip(keys, k)], at.cast("long").alias("__at"), F.lit(int(closed)).alias("__kind"), F.lit(None).cast("long").alias("__v"), row.alias("__row"))
    t = target.where(known).groupBy(*[F.col(c).alias(n) for c, n in zip(keys, k)], t_at.cast("long").alias("__at")).agg(F.max(value.cast("long")).alias("__v"))
    t = t.select(*k, "__at", F.lit(int(not closed)).alias("__kind"), "__v", F.lit(None).cast(q.schema["__row"].dataType).alias("__row"))
    both = q.unionByName(t).withColumn("__tile", F.floor(F.col("__at") / tile))
    w = Window.partitionBy(*k, "__tile").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = carry(both, k, "__tile", F.max("__v"), F.max, "__carry").withColumn("__m", F.greatest(F.max("__v").over(w), F.col("__carry")))
    found = swept.where("__row is not null").select("__row.*", F.col("__m").alias(name))
    return found.unionByName(query.where(~known).withColumn(name, F.lit(None).cast("long")))


def _reached(query: DataFrame, target: DataFrame, stranded: bool, closed: bool) -> tuple[DataFrame, Column]:
    """query with __over, and whether a target overlaps: of those that begin in time, one reaches far enough."""
    keys = ["chrom"] + ["strand"] * stranded
    df = furthest(query, target, keys, F.col("end"), F.col("start"), F.col("end"), closed, "__over")
    return df, F.coalesce(F.col("__over") >= F.col("start") if closed else F.col("__over") > F.col("start"), F.lit(False))


def overlapping(query: DataFrame, target: DataFrame, stranded: bool = True, exact: bool = False, closed: bool = True) -> DataFrame:
    """Rows of query that overlap a target, each once. exact: that equal one in coordinates (and strand)."""
    if exact:
        keys = ["chrom", "start", "end"] + ["strand"] * stranded
        return query.join(target.select(*keys).distinct(), keys, "left_semi").select(query.columns)
    df, hit = _reached(query, target, stranded, closed)
    return df.where(hit).select(query.columns)


def not_overlapping(query: DataFrame, target: DataFrame, stranded: bool = True, closed: bool = True) -> DataFrame:
    """Rows of query that overlap no target. Rows without a chromosome are kept."""
    df, hit = _reached(query, target, stranded, closed)
    return df.where(~hit).select(query.columns)


def count_overlaps(reference: DataFrame, samples: dict[str, DataFrame], stranded: bool = True, bin_size: int = BIN) -> DataFrame:
    """Reference regions with the number of overlapping regions of each sample and, as present, in how
    many samples there are any. Counts are looked up for each place that regions have, not paired."""
    keys = ["chrom"] + ["strand"] * stranded
    place = [*keys, "start", "end"]
    spots = reference.select(*place).distinct().select(*place, key(*keys).alias("k"), F.col("start").alias("s"), F.col("end").alias("e"))
    found = None
    for name, df in samples.items():
        spans = df.groupBy(key(*keys).alias("k"), F.col("start").alias("s"), F.col("end").alias("e")).agg(F.count("*").alias("n"))
        one = meeting(spans, spots, tuple(place), True).select(*place, F.lit(name).alias("__sample"), "v")
        found = one if found is None else found.unionByName(one)
    counts = found.groupBy(*place).agg(*[F.sum(F.when(F.col("__sample") == s, F.col("v")).otherwise(0)).alias(s) for s in samples])
    out = reference.join(counts, place, "left").select(*reference.columns, *samples).na.fill(0, list(samples))
    present = sum((F.when(F.col(s) > 0, 1).otherwise(0) for s in samples), F.lit(0))
    return out.withColumn("present", present.cast("long"))


def sum_overlaps(query: DataFrame, target: DataFrame, ids: tuple[str, ...], n: str, sums: dict[str, Column], stranded: bool = True) -> DataFrame:
    """What grouping overlap_pairs(query, target) by ids gives: n, the number of targets that overlap, and sums
    of whole-number expressions over them, for ids with any. No pair is made."""
    k = key(*(["chrom"] + ["strand"] * stranded))
    q = query.select(*ids, k.alias("k"), F.col("start").alias("s"), F.col("end").alias("e"))
    values = {n: F.lit(1), **sums}
    # one sweep for each figure, as a span has one number
    each = None
    t = target.groupBy(k.alias("k"), F.col("start").alias("s"), F.col("end").alias("e")).agg(*[F.sum(x.cast("long")).alias(f"__{c}") for c, x in values.items()])
    for c in values:
        one = meeting(t.select("k", "s", "e", F.col(f"__{c}").alias("n")), q, ids, True).select(*ids, F.lit(c).alias("__c"), "v")
        each = one if each is None else each.unionByName(one)
    out = each.groupBy(*ids).agg(*[F.sum(F.when(F.col("__c") == c, F.col("v")).otherwise(0)).alias(c) for c in values])
    return out.where(F.col(n) > 0)


def distance(start: Column, end: Column, t_start: Column, t_end: Column) -> tuple[Column, Column]:
    """(bases between, up or down): 0 and nothing for intervals that touch."""
    touch = (t_start <= end) & (start <= t_end)
    return F.when(touch, 0).when(t_end < start, start - t_end).otherwise(t_start - end).cast("long"), F.when(touch, "").when(t_end < start, "up").otherwise("down")


def _neighbours(q: DataFrame, reference: DataFrame, maxdist: int, stranded: bool, bin_size: int, cols: tuple[str, ...]) -> DataFrame:
    """Pairs of q with the reference regions that overlap, or where none does, that are least far off on
    either side. Sweeps find the last end before and the first start after; regions are then looked up."""
    keys = ["chrom"] + ["strand"] * stranded
    df, hit = _reached(q, reference, stranded, True)
    touching = overlap_pairs(df.where(hit).select(q.columns), reference, stranded, True, 0, bin_size, cols)
    rest = df.where(~hit).select(q.columns)
    rest = furthest(rest, reference, keys, F.col("start"), F.col("end"), F.col("end"), False, "__up")
    rest = furthest(rest, reference, keys, -F.col("end"), -F.col("start"), -F.col("start"), False, "__down")
    up, down = F.col("start") - F.col("__up"), -F.col("__down") - F.col("end")
    rest = rest.withColumn("__far", F.least(up, down)).where(F.col("__far") <= maxdist)
    ends = F.array(F.when(up == F.col("__far"), F.struct(F.lit("up").alias("side"), F.col("__up").alias("at"))), F.when(down == F.col("__far"), F.struct(F.lit("down").alias("side"), (-F.col("__down")).alias("at"))))
    look = rest.withColumn("__end", F.explode(F.filter(ends, lambda x: x.isNotNull()))).select(*q.columns, F.col("__end.side").alias("__side"), F.col("__end.at").alias("__at"))
    t = reference.select(*[F.col(c).alias(f"t_{c}") for c in cols], F.explode(F.array(F.struct(F.lit("up").alias("side"), F.col("end").cast("long").alias("at")), F.struct(F.lit("down").alias("side"), F.col("start").cast("long").alias("at")))).alias("__t"))
    on = (F.col("chrom") == F.col("t_chrom")) & (F.col("__side") == F.col("__t.side")) & (F.col("__at") == F.col("__t.at"))
    if stranded:
        on = on & (F.col("strand") == F.col("t_strand"))
    return touching.unionByName(look.join(t, on).select(touching.columns))


def nearest(query: DataFrame, reference: DataFrame, maxdist: int = 100_000, match_name: bool = False, stranded: bool = True, bin_size: int | None = None) -> DataFrame:
    """Nearest reference regions of each query region within maxdist: query columns, nearest and distance.

    A region downstream of a + region, or upstream of a - region, as strands of the reference go, has a
    negative distance. Regions as near as the best, on the same side and under another name than the one
    before, are listed as well. Without any, nearest is * and distance null. match_name: only regions
    whose name contains the query's.
    """
    q = _numbered(query)
    cols = ("chrom", "start", "end", "strand", "name")
    if match_name:  # the next one may have another name, so all within reach are looked at
        found = overlap_pairs(q, reference, stranded, True, maxdist, bin_size or max(BIN, maxdist // 4), cols)
        pairs = found.where(F.col("t_name").contains(F.col("name")))
    else:
        pairs = _neighbours(q, reference, maxdist, stranded, bin_size or BIN, cols)
    far, side = distance(F.col("start"), F.col("end"), F.col("t_start"), F.col("t_end"))
    back = (F.col("t_strand") == "+") & (side == "down") | (F.col("t_strand") == "-") & (side == "up")
    pairs = pairs.withColumns({"__far": far, "__side": side, "distance": F.when(back, -far).otherwise(far)})
    order = ("__far", "__side", "t_chrom", "t_start", "t_end", F.col("t_strand").asc_nulls_first(), "t_name")
    w = Window.partitionBy("__rid").orderBy(*order)
    best = pairs.withColumn("__best", F.first("distance").over(w)).where("distance = __best")
    best = best.withColumn("__before", F.lag("t_name").over(w)).where("__before is null or __before <> t_name")
    out = q.join(best.select("__rid", F.col("t_name").alias("nearest"), "distance"), "__rid", "left")
    return out.withColumn("nearest", F.coalesce("nearest", F.lit("*"))).drop("__rid")


def carry(df: DataFrame, keys: list[str], tile: str, value: Column, combine, name: str) -> DataFrame:
    """df with, as `name`, `value` (an aggregate) combined over all earlier tiles of the keys."""
    w = Window.partitionBy(*keys).orderBy(tile).rowsBetween(Window.unboundedPreceding, -1)
    tiles = df.groupBy(*keys, tile).agg(value.alias("__v")).withColumn(name, combine(F.col("__v")).over(w)).drop("__v")
    return df.join(tiles, [*keys, tile])


def islands(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", gap: int = 0, bookended: bool = True, tile: int = TILE) -> DataFrame:
    """df with island, a number shared by intervals of the same keys that chain: the next one begins no
    more than `gap` bases after the furthest end so far; at exactly that distance only if bookended."""
    df = df.withColumn("__tile", F.floor(F.col(start) / tile))
    w = Window.partitionBy(*keys, "__tile").orderBy(start, end)
    df = carry(df, keys, "__tile", F.max(end), F.max, "__carry")
    reach = F.greatest(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("__carry")) + gap
    fresh = reach.isNull() | ((F.col(start) > reach) if bookended else (F.col(start) >= reach))
    df = df.withColumn("__new", fresh.cast("long")).drop("__carry")
    df = carry(df, keys, "__tile", F.sum("__new"), F.sum, "__carry")
    # equal intervals are of one island, whichever of them was the first
    return df.withColumn("island", F.sum("__new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)) + F.coalesce("__carry", F.lit(0))).drop("__tile", "__new", "__carry")


def merge_regions(df: DataFrame, extend: tuple[int, int] = (0, 0), stranded: bool = True, count: bool = False, clip: bool = False, bookended: bool = False) -> DataFrame:
    """Overlapping regions merged: chrom, start, end, name (distinct names in order, joined by commas),
    score (sum, or number of regions with count) and strand (+ where strands mix).

    extend: bases by which regions grow upstream and downstream, as strands go, before they are compared;
    clip: the result covers the regions themselves. stranded: + and anything else are merged apart.
    """
    up, down = extend
    minus = F.coalesce(F.col("strand") == "-", F.lit(False))
    grown = df.withColumns({
        "__s": F.greatest(F.lit(0), F.col("start") - F.when(minus, down).otherwise(up)),
        "__e": F.col("end") + F.when(minus, up).otherwise(down),
        "__g": F.when(F.lit(stranded) & ~F.coalesce(F.col("strand") == "+", F.lit(False)), "-").otherwise("+"),
    })
    parts = islands(grown, ["chrom", "__g"], "__s", "__e", 0, bookended)
    s, e = ("start", "end") if clip else ("__s", "__e")
    mixed = F.count_distinct(F.coalesce("strand", F.lit("")))
    return parts.groupBy("chrom", "__g", "island").agg(
        F.min(s).alias("start"), F.max(e).alias("end"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("name"),
        (F.count("*").cast("double") if count else F.sum("score")).alias("score"), F.when(mixed > 1, "+").otherwise(F.max("strand")).alias("strand"),
    ).drop("__g", "island")


def subtract(query: DataFrame, remove: DataFrame, stranded: bool = True, bin_size: int = BIN) -> DataFrame:
    """What is left of each query region outside of `remove`; pieces of a changed region get * after the
    name. A region that is covered goes."""
    cover = merge_regions(remove.withColumns({"name": F.lit(""), "score": F.lit(0.0)}), stranded=stranded, bookended=True).select("chrom", "start", "end", "strand")
    if stranded:
        cover = cover.withColumn("strand", F.coalesce("strand", F.lit("-")))
    q = _numbered(query)
    hits = overlap_pairs(q.select("__rid", "chrom", "start", "end", "strand"), cover, stranded, False, 0, bin_size, ("start", "end"))
    cuts = hits.groupBy("__rid").agg(F.array_sort(F.collect_list(F.struct(F.col("t_start").alias("s"), F.col("t_end").alias("e")))).alias("__cuts"))
    rows = q.join(cuts, "__rid", "left")
    zero = F.struct(F.col("start").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("out"))

    def step(a: Column, c: Column) -> Column:
        piece = F.array(F.struct(a["at"].cast("bigint").alias("s"), c["s"].cast("bigint").alias("e")))
        return F.struct(F.greatest(a["at"], c["e"]).alias("at"), F.when(c["s"] > a["at"], F.concat(a["out"], piece)).otherwise(a["out"]).alias("out"))

    def close(a: Column) -> Column:
        rest = F.array(F.struct(a["at"].cast("bigint").alias("s"), F.col("end").cast("bigint").alias("e")))
        return F.when(a["at"] < F.col("end"), F.concat(a["out"], rest)).otherwise(a["out"])

    left = F.when(F.col("__cuts").isNull(), F.array(F.struct(F.col("start").cast("bigint").alias("s"), F.col("end").cast("bigint").alias("e")))).otherwise(F.aggregate(F.col("__cuts"), zero, step, close))
    out = rows.withColumn("__p", F.explode(left))
    return out.withColumns({"start": F.col("__p.s"), "end": F.col("__p.e"), "name": F.when(F.col("__cuts").isNull(), F.col("name")).otherwise(F.concat("name", F.lit("*")))}).select(query.columns)


def coverage(spans: DataFrame, keys: tuple[str, ...] = ("chrom",), tile: int = TILE) -> DataFrame:
    """Runs of equal depth over zero: keys, start, end, depth. Ends are summed by position first, then
    tiles are scanned with the depth and the next position carried across."""
    ends = spans.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))).alias("x"))
    steps = ends.groupBy(*keys, F.col("x.pos").alias("pos")).agg(F.sum("x.d").alias("d")).where("d <> 0").withColumn("__tile", F.floor(F.col("pos") / tile))
    k = list(keys)
    tiles = steps.groupBy(*k, "__tile").agg(F.sum("d").alias("__sum"), F.min("pos").alias("__first"))
    w = Window.partitionBy(*k).orderBy("__tile")
    tiles = tiles.select(*k, "__tile", F.coalesce(F.sum("__sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__carry"), F.lead("__first").over(w).alias("__next"))
    inside = Window.partitionBy(*k, "__tile").orderBy("pos")
    depth = F.sum("d").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__carry")
    runs = steps.join(tiles, [*k, "__tile"]).select(*k, F.col("pos").alias("start"), F.coalesce(F.lead("pos").over(inside), F.col("__next")).alias("end"), depth.alias("depth"))
    return runs.where("depth > 0")


def tiles_of(sizes: DataFrame, width: int, stranded: bool = False) -> DataFrame:
    """Bins of fixed width over (chrom, length): chrom, start, end, strand (both if stranded, else null)."""
    out = sizes.select("chrom", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length").cast("long") - 1, F.lit(0).cast("long")), F.lit(width).cast("long"))).alias("start"))
    out = out.select("chrom", "start", F.least(F.col("start") + width, F.col("length").cast("long")).alias("end"))
    return out.withColumn("strand", F.explode(F.array(F.lit("+"), F.lit("-")))) if stranded else out.withColumn("strand", F.lit(None).cast("string"))

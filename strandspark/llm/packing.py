"""Best-fit packing into sequences of several permitted lengths.

The plan depends on documents only through the number of pieces of each length, so it is made on that
histogram: at most one entry for each length up to the largest capacity, whatever the number of rows.
Best fit by decreasing length is run on it exactly, many equal pieces and many equal bins in one step.
A bin opens in the size that costs least for what would fill it: the pieces still to be placed are dealt
into a bin of each permitted capacity, largest first, and the cost of the least capacity that holds them
is taken by the unit. Sizes in which pieces of a length open are then tried out jointly, together with
opening one size throughout; the cheapest plan is taken. Each bin is finally cut down to the least
permitted capacity that holds its contents. Documents find their places by rank within their length;
ranks are counted within salted parts of a length, so a length that a third of the rows have is no single
task.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

CAPACITIES = (512, 1024, 2048, 4096)
#: Plans that are made at most beyond the first ones, to better the sizes in which bins open.
TRIES = 64
#: Share above the least cost that any plan could have, from which on nothing further is tried.
SLACK = 0.01
#: Placements that are broadcast at most (some 60 bytes each); more are joined by sorting.
PLACES = 200_000


@dataclass(frozen=True)
class Placement:
    """Ranks rank0 ... of one length go, each at a time, into `bins` bins from bin0 on."""

    length: int
    rank0: int
    each: int
    bin0: int
    bins: int
    offset: int
    capacity: int


def least_capacity(used: int, capacities: tuple[int, ...]) -> int:
    return capacities[bisect_left(capacities, used)]


class Opening:
    """The size in which a bin opens for pieces of a length: forced for some lengths, else `size` or the
    least capacity that takes them, else (None) the one of least cost for what would fill it."""

    def __init__(self, capacities: tuple[int, ...], cost: dict[int, float], size: int | None = None, forced: dict[int, int] | None = None):
        self.capacities, self.cost, self.size, self.forced = capacities, cost, size, forced or {}

    def filled(self, capacity: int, length: int, left: int, shorter: list[int], counts: dict[int, int]) -> tuple[int, int]:
        """(units used, bins that could be filled alike) if a bin of a capacity took the longest pieces first."""
        n = min(capacity // length, left)
        space, alike = capacity - n * length, left // n
        k = len(shorter)
        while space > 0 and (k := bisect_right(shorter, space, 0, k)):
            k -= 1
            n = min(space // shorter[k], counts[shorter[k]])
            alike = min(alike, counts[shorter[k]] // n)
            space -= n * shorter[k]
        return capacity - space, max(1, alike)

    def __call__(self, length: int, left: int, shorter: list[int], counts: dict[int, int]) -> tuple[int, int]:
        """(capacity, bins to open in it before asking again)."""
        capacity = self.forced.get(length) or self.size and max(self.size, least_capacity(length, self.capacities))
        if capacity:
            return capacity, -(-left // (capacity // length))
        tried = []
        for c in self.capacities[bisect_left(self.capacities, length) :]:
            used, alike = self.filled(c, length, left, shorter, counts)
            tried.append((self.cost[least_capacity(used, self.capacities)] / used, -c, alike))
        _, c, alike = min(tried)
        return -c, min(alike, -(-left // (-c // length)))


def pack_counts(counts: dict[int, int], opening: Opening) -> tuple[list[tuple[int, int, int, tuple]], dict[int, int]]:
    """Best fit by decreasing length over {length: pieces}: groups (bin0, bins, used, chain) of equal bins;
    chain holds (length, rank of the first bin's first piece, each, offset). Also the bins that were opened
    for each length."""
    open_: dict[int, list] = {}  # free space -> groups
    free: list[int] = []
    done: list[tuple] = []
    bins, opened = 0, {}

    def put(group, space):
        if space <= 0:
            done.append(group)
            return
        if space not in open_:
            open_[space] = []
            insort(free, space)
        open_[space].append(group)

    lengths = sorted(counts)
    for at in range(len(lengths) - 1, -1, -1):
        length = lengths[at]
        left, rank = counts[length], 0
        shorter = lengths[:at] if opening.size is None else lengths[:0]
        while left:
            k = bisect_left(free, length)
            if k < len(free):
                space = free[k]
                group = open_[space].pop()
                if not open_[space]:
                    del open_[space], free[k]
            else:
                space, n = opening(length, left, shorter, counts)
                group = (bins, n, 0, ())
                opened[length] = opened.get(length, 0) + n
                bins += n
            bin0, n, used, chain = group
            each = min(space // length, left)
            full = min(n, left // each)
            if full < n:
                put((bin0 + full, n - full, used, tuple((a, r + full * e, e, o) for a, r, e, o in chain)), space)
            put((bin0, full, used + each * length, (*chain, (length, rank, each, used))), space - each * length)
            rank += full * each
            left -= full * each
    for groups in open_.values():
        done += groups
    return done, opened


def cost_of(groups: list, capacities: tuple[int, ...], cost: dict[int, float]) -> float:
    return sum(n * cost[least_capacity(used, capacities)] for _, n, used, _ in groups if used)


def least_cost(counts: dict[int, int], capacities: tuple[int, ...], cost: dict[int, float], tries: int = TRIES) -> list:
    """Groups of the cheapest plan: bins open in one size throughout, or each where it costs least; then
    other sizes are tried for single lengths, those for which most bins open first, and kept where they
    save. If all choices of a size for each length are no more than `tries`, they are all made."""

    def made(size, forced):
        groups, opened = pack_counts(counts, Opening(capacities, cost, size, forced))
        return cost_of(groups, capacities, cost), groups, opened, size, forced

    plans = [made(size, {}) for size in (None, *capacities)]
    best = min(plans, key=lambda p: p[0])
    fits = {n: capacities[bisect_left(capacities, n) :] for n in counts}
    choices = 1
    for f in fits.values():
        choices = min(choices * len(f), tries + 1)
    if choices <= tries:
        plans = [made(None, dict(zip(fits, c))) for c in itertools.product(*fits.values())]
        return min([best, *plans], key=lambda p: p[0])[1]
    bound = sum(n * c for n, c in counts.items()) * min(cost[c] / c for c in capacities)  # no plan costs less
    tried = set()
    while tries and best[0] > bound * (1 + SLACK):
        todo = [(n, c) for n in sorted(best[2], key=lambda n: (-best[2][n], n)) for c in fits[n] if (n, c) not in tried and best[4].get(n) != c]
        if not todo:
            break
        for n, c in todo:
            tried.add((n, c))
            tries -= 1
            got = made(best[3], {**best[4], n: c})
            if got[0] < best[0]:
                best = got
                break
            if not tries:
                break
    return best[1]


def plan(counts: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, cost: dict[int, float] | None = None) -> list[Placement]:
    """Placements of the cheapest plan found; cost of a bin: its capacity, unless given."""
    capacities = tuple(sorted(set(capacities)))
    groups = least_cost(counts, capacities, cost or {c: float(c) for c in capacities})
    return [Placement(a, r, e, b, n, o, least_capacity(used, capacities)) for b, n, used, chain in groups for a, r, e, o in chain]


def words_and_end(text: Column) -> Column:
    """Length in words, one more for the end of the document."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")) + 1).cast("int")


def pack_documents(docs: DataFrame, length: Column | None = None, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES, cost: dict[int, float] | None = None) -> DataFrame:
    """One row for each piece of a document: id, piece (from 0), start and length in units of length,
    bin_id, capacity of that bin, and offset in it.

    A document longer than the largest capacity is cut into pieces of that capacity and a rest. length
    defaults to words plus one, so null and empty texts take one place; a null or negative length counts
    as one. Every row is placed once, repeated rows and null ids too; places of rows that are alike may be
    dealt either way. An empty table gives an empty result. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    capacities = tuple(sorted(set(capacities)))
    top, parts = capacities[-1], int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = F.greatest(F.coalesce((length if length is not None else words_and_end(docs[text_col])).cast("long"), F.lit(1)), F.lit(1))
    whole = docs.select(docs[id_col].alias("id"), size.alias("whole"))
    pieces = whole.select("id", "whole", F.explode(F.sequence(F.lit(0), ((F.col("whole") - 1) / top).cast("int"))).alias("piece")).select(
        "id", "piece", (F.col("piece") * F.lit(top).cast("long")).alias("start"), F.least(F.lit(top).cast("long"), F.col("whole") - F.col("piece") * F.lit(top).cast("long")).cast("int").alias("length")
    )
    pieces = scratch.put(pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(parts)).cast("int")))
    cells = scratch.put(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")))
    counts = {r.length: r.n for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row for each length up to top
    from pyspark.sql import Window

    before = cells.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    local = pieces.withColumn("rn", F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece")) - 1)
    ranked = local.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("rn"))
    rows = [(p.length, p.rank0, p.rank0 + p.each * p.bins, p.each, p.bin0, p.offset, p.capacity) for p in plan(counts, capacities, cost)]
    places = spark.createDataFrame(rows, "length int, lo long, hi long, each int, bin0 long, at int, capacity int")
    # as many as the histogram makes: some placements for each length up to the largest capacity
    put = ranked.join(F.broadcast(places) if len(rows) <= PLACES else places.hint("merge"), "length").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return put.select(
        F.col("id").alias(id_col), "piece", "start", "length", (F.col("bin0") + F.expr("(rank - lo) div each")).alias("bin_id"), "capacity", (F.col("at") + (nth % F.col("each")) * F.col("length")).cast("int").alias("offset")
    )

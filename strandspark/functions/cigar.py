"""CIGAR strings as arrays of (len, op), with higher-order functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = "array<struct<len:int,op:string>>"
SPANS = "array<struct<start:int,end:int>>"
#: Operations that place read bases on the reference; those that move along the reference; along the read.
ALIGNED, ON_REF, ON_READ = ("M", "=", "X"), ("M", "D", "N", "=", "X"), ("M", "I", "S", "=", "X")


def parse(cigar: Column) -> Column:
    """array<struct<len,op>>; null or '*' has no operations."""
    parts = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, "^[0-9]+", 0).cast("int").alias("len"), F.right(p, F.lit(1)).alias("op")))


def to_string(ops: Column) -> Column:
    return F.array_join(F.transform(ops, lambda o: F.concat(o["len"].cast("string"), o["op"])), "")


def total(ops: Column, kinds: tuple[str, ...]) -> Column:
    return F.aggregate(ops, F.lit(0), lambda a, o: a + F.when(o["op"].isin(*kinds), o["len"]).otherwise(0))


def count(ops: Column, kinds: tuple[str, ...]) -> Column:
    return F.size(F.filter(ops, lambda o: o["op"].isin(*kinds)))


def ref_length(ops: Column) -> Column:
    return total(ops, ON_REF)


def read_length(ops: Column) -> Column:
    return total(ops, ON_READ)


def read_length_strict(ops: Column) -> Column:
    """As read_length; an operation of another kind than M I S = X D N H is an error."""
    odd = F.exists(ops, lambda o: ~o["op"].isin("M", "I", "S", "=", "X", "D", "N", "H"))
    return F.when(odd, F.raise_error(F.lit("unknown CIGAR operation")).cast("int")).otherwise(read_length(ops))


def end_of(pos: Column, ops: Column) -> Column:
    """Reference position after the last aligned base."""
    return pos + ref_length(ops)


def walk(pos: Column, ops: Column) -> Column:
    """Operations with where they begin: array<struct<op,len,ref,read>>."""
    zero = F.struct(pos.cast("int").alias("ref"), F.lit(0).alias("read"), F.array().cast("array<struct<op:string,len:int,ref:int,read:int>>").alias("out"))

    def step(a: Column, o: Column) -> Column:
        here = F.struct(o["op"].alias("op"), o["len"].alias("len"), a["ref"].alias("ref"), a["read"].alias("read"))
        return F.struct(
            (a["ref"] + F.when(o["op"].isin(*ON_REF), o["len"]).otherwise(0)).alias("ref"),
            (a["read"] + F.when(o["op"].isin(*ON_READ), o["len"]).otherwise(0)).alias("read"),
            F.concat(a["out"], F.array(here)).alias("out"),
        )

    return F.aggregate(ops, zero, step)["out"]


def blocks(pos: Column, ops: Column) -> Column:
    """Aligned pieces in reference coordinates, one for each M, = or X."""
    return F.transform(F.filter(walk(pos, ops), lambda o: o["op"].isin(*ALIGNED)), lambda o: F.struct(o["ref"].alias("start"), (o["ref"] + o["len"]).alias("end")))


def regions(pos: Column, ops: Column) -> Column:
    """Pieces broken at N only; a deletion does not break one."""
    zero = F.struct(pos.cast("int").alias("start"), pos.cast("int").alias("end"), F.array().cast(SPANS).alias("out"))

    def step(a: Column, o: Column) -> Column:
        gap = o["op"] == "N"
        end = a["end"] + F.when(o["op"].isin(*ON_REF), o["len"]).otherwise(0)
        return F.struct(F.when(gap, end).otherwise(a["start"]).alias("start"), end.alias("end"), F.when(gap, F.concat(a["out"], F.array(F.struct(a["start"], a["end"])))).otherwise(a["out"]).alias("out"))

    return F.aggregate(ops, zero, step, lambda a: F.concat(a["out"], F.array(F.struct(a["start"], a["end"]))))


def junctions(pos: Column, ops: Column) -> Column:
    """Reference spans of the N operations."""
    return F.transform(F.filter(walk(pos, ops), lambda o: o["op"] == "N"), lambda o: F.struct(o["ref"].alias("start"), (o["ref"] + o["len"]).alias("end")))


def clean(ops: Column) -> Column:
    """Drops operations of length zero and merges neighbours of one kind."""
    kept = F.filter(ops, lambda o: o["len"] > 0)

    def step(a: Column, o: Column) -> Column:
        last = F.element_at(a, -1)
        merged = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct((last["len"] + o["len"]).alias("len"), o["op"].alias("op"))))
        return F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["op"] == o["op"]), merged).otherwise(F.concat(a, F.array(o)))

    def safe(a: Column, o: Column) -> Column:
        return F.when(F.size(a) == 0, F.array(o)).otherwise(step(a, o))

    return F.aggregate(kept, F.array().cast(OPS), safe)


def op_at(ops: Column, qpos: Column, is_del: Column | bool = False) -> Column:
    """Operation that covers a read position; with is_del, the deletion or gap that follows it."""
    placed = walk(F.lit(0), ops)
    at = F.filter(placed, lambda o: o["op"].isin(*ON_READ) & (o["read"] <= qpos) & (qpos < o["read"] + o["len"]))
    gone = F.filter(placed, lambda o: o["op"].isin("D", "N") & (o["read"] - 1 <= qpos) & (qpos <= o["read"]))
    want = is_del if isinstance(is_del, Column) else F.lit(is_del)
    return F.when(want, F.get(gone, F.lit(0))["op"]).otherwise(F.get(at, F.lit(0))["op"])


def edits(nm: Column, ops: Column) -> Column:
    """Mismatches and indels, each indel once whatever its length: NM less inserted and deleted bases
    plus the number of insertions and deletions."""
    return nm - total(ops, ("I", "D")) + count(ops, ("I", "D"))


def junction_valid(ops: Column, min_overlap: int = 4) -> Column:
    """struct<valid,reason>: no N at the start, an N somewhere, and min_overlap aligned bases on both
    outer sides of the gaps."""
    n = F.size(ops)
    first = F.array_position(F.transform(ops, lambda o: o["op"]), F.lit("N"))
    last = n + 1 - F.array_position(F.reverse(F.transform(ops, lambda o: o["op"])), F.lit("N"))
    head, tail = total(F.slice(ops, 1, first.cast("int") - 1), ("M", "I", "=", "X")), total(F.slice(ops, last.cast("int") + 1, n), ("M", "I", "=", "X"))
    reason = (
        F.when(n == 0, "no cigar").when(first == 1, "starts with gap").when(first == 0, "no gap").when(last == n, "ends with gap")
        .when((first > 0) & (head < min_overlap), "5' overlap too short").when((first > 0) & (tail < min_overlap), "3' overlap too short")
    )
    return F.struct(reason.isNull().alias("valid"), F.coalesce(reason, F.lit("")).alias("reason"))


def deleted_at(ops: Column, qpos: Column) -> Column:
    """Whether a deletion that no gap precedes follows a read position."""
    placed = walk(F.lit(0), ops)
    return F.exists(F.arrays_zip(placed.alias("p"), F.concat(F.array(F.lit("")), F.transform(ops, lambda o: o["op"])).alias("before")), lambda z: (z["p"]["op"] == "D") & (z["before"] != "N") & (qpos < z["p"]["read"]))

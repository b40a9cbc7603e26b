"""SAM flags and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# SAM flag bits and their labels.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20
READ1, READ2, SECONDARY, QCFAIL, DUPLICATE, SUPPLEMENTARY = 0x40, 0x80, 0x100, 0x200, 0x400, 0x800
LABELS = {
    PAIRED: "Multiple fragments", PROPER: "All fragments aligned", UNMAPPED: "Unmapped", MATE_UNMAPPED: "Next unmapped",
    REVERSE: "Reverse complemented", MATE_REVERSE: "Next reverse complemented", READ1: "First fragment", READ2: "Last fragment",
    SECONDARY: "Secondary alignment", QCFAIL: "QC Fail", DUPLICATE: "PCR/Optical duplicate", SUPPLEMENTARY: "Supplementary",
}


def has(bit: int, flag: Column | str = "flag") -> Column:
    return (F.col(flag) if isinstance(flag, str) else flag).bitwiseAND(F.lit(bit)) != 0


def strand(flag: Column | str = "flag") -> Column:
    return F.when(has(REVERSE, flag), "-").otherwise("+")


def tag(name: str, tags: Column | str = "tags") -> Column:
    """Value of a tag as text, null where it is missing."""
    return F.try_element_at(F.col(tags) if isinstance(tags, str) else tags, F.lit(name))["v"]


def put_tag(name: str, kind: str, value: Column, tags: Column | str = "tags") -> Column:
    """tags with one more, in place of one of that name."""
    old = F.coalesce(F.col(tags) if isinstance(tags, str) else tags, F.create_map().cast("map<string,struct<t:string,v:string>>"))
    rest = F.map_filter(old, lambda k, v: k != name)
    return F.map_concat(rest, F.create_map(F.lit(name), F.struct(F.lit(kind).alias("t"), value.cast("string").alias("v"))))


def fragment_strand(library: str = "FR") -> Column | None:
    """Strand of the fragment a read comes from; None for unstranded libraries."""
    rev, second = has(REVERSE), has(READ2)
    same = rev == second  # read 1 forward or read 2 reverse
    if library == "FR":
        return F.when(same, "+").otherwise("-")
    return F.when(same, "-").otherwise("+") if library == "RF" else None

"""Sequences, qualities and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complements and the colour-space alphabet.
BASES, COMPLEMENT = "ACGTNacgtn", "TGCANtgcan"
COLOURS, COLOUR_BASES = "0123456.", "ACGTNNNN"


def revcomp(seq: Column, strict: bool = False) -> Column:
    """Reverse complement of A C G T N in either case. Other characters stay, or are an error if strict."""
    out = F.reverse(F.translate(seq, BASES, COMPLEMENT))
    return F.when(seq.rlike("[^ACGTNacgtn]"), F.raise_error(F.lit("not a base")).cast("string")).otherwise(out) if strict else out


def phred(qual: Column, offset: int = 33) -> Column:
    """Qualities as array<int>."""
    return F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c) - offset)


def phred_text(values: Column) -> Column:
    """Integers to a quality string, cut off at 0 and 93."""
    return F.array_join(F.transform(values, lambda q: F.char(F.greatest(F.lit(0), F.least(F.lit(93), q)) + 33)), "")


def shift_quality(qual: Column, by: int = -31) -> Column:
    """Quality characters moved by a constant, as from offset 64 to 33."""
    return F.array_join(F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.char(F.ascii(c) + by)), "")


def solexa_quality(qual: Column) -> Column:
    """Solexa scale to Phred: int(10 log10(10^(v/10) + 1)), where v/10 is a whole number rounded down."""
    value = lambda c: F.floor((F.ascii(c) - 64) / 10)
    return F.array_join(F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.char((F.floor(10 * F.log10(F.pow(F.lit(10.0), value(c)) + 1))).cast("int") + 33)), "")


def colour_to_base(seq: Column) -> Column:
    return F.translate(seq, COLOURS, COLOUR_BASES)


def wildcards(seq: Column) -> Column:
    """How many of 4, . and N a sequence has."""
    return F.length(seq) - F.length(F.translate(seq, "4.N", ""))


def trim_name(name: Column) -> Column:
    """Cuts a read name at its last _F3 or _R3."""
    return F.regexp_replace(name, "^(.*)_[FR]3.*$", "$1")


def quoted_split(text: Column, delimiter: str = ";", quote: str = '"') -> Column:
    """Splits at delimiters outside quotes."""
    return F.split(text, f"{delimiter}(?=(?:[^{quote}]*{quote}[^{quote}]*{quote})*[^{quote}]*$)")


def natural_key(text: Column) -> Column:
    """A string whose order is the natural one: runs of digits padded, so that chr2 comes before chr10."""
    parts = F.regexp_extract_all(text, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p)), "")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def wrapped(seq: Column, width: int = 50) -> Column:
    """Line breaks after every `width` characters, none at the end."""
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def typed(values: Column, names: list[str]) -> dict[str, Column]:
    """Columns from an array of texts by names that tell their types: #name a whole number, @name a list of
    texts, @#name a list of whole numbers; lists are divided by commas, one of which may stand at the end.
    Null where the array ends early."""
    out = {}
    for i, name in enumerate(names):
        v = F.get(values, F.lit(i))
        many, number = name.startswith("@"), name.lstrip("@").startswith("#")
        parts = F.split(F.regexp_replace(v, ",+$", ""), ",")
        out[name.lstrip("@").removeprefix("#")] = F.transform(parts, lambda x: x.cast("long")) if many and number else parts if many else v.cast("long") if number else v
    return out

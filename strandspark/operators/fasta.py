"""Sequences without qualities: idx, name, comment, seq."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import wrapped
from .pileup import fetch_sequence


def strip_names(fasta: DataFrame, text: str = "_") -> DataFrame:
    """Records whose name doesn't contain text."""
    return fasta.where(~F.col("name").contains(text))


def tag(fasta: DataFrame, prefix: str = "", suffix: str = "") -> DataFrame:
    return fasta.withColumn("name", F.concat(F.lit(prefix), "name", F.lit(suffix)))


def from_repeats(repeats: DataFrame, reference: DataFrame, family: str | None = None, chunk: int = 1 << 16) -> DataFrame:
    """Sequences of repeats, of one family if given, wrapped at 50; never turned."""
    r = repeats.where(F.col("family") == family) if family else repeats
    got = fetch_sequence(r, reference, chunk)
    place = F.concat(F.col("family"), F.lit("|"), F.col("member"), F.lit("|"), F.col("chrom"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit("["), "strand", F.lit("]"))
    return got.select(place.alias("name"), wrapped(F.col("seq")).alias("seq"))

"""Sequencing reads: filters, conversions, pairs and statistics. Rows have idx, name, comment, seq, qual."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from ..functions import sequence as Q

SANGER, ILLUMINA, SOLEXA = (33, 74), (64, 104), (59, 104)


def _note(text: str, when: Column) -> Column:
    return F.when(when, F.concat(F.coalesce("comment", F.lit("")), F.lit(f" #{text}"))).otherwise(F.col("comment"))


def _cut(reads: DataFrame, start: Column | int, length: Column, when: Column, note: str) -> DataFrame:
    """Bases and qualities from start on; sequences in colour space with a prefix base keep that."""
    extra = F.length("seq") - F.length("qual")
    s = F.lit(start) if isinstance(start, int) else start
    return reads.withColumns({
        "seq": F.when(when, F.substring(F.col("seq"), s + 1, F.greatest(length + extra, F.lit(0)))).otherwise(F.col("seq")),
        "qual": F.when(when, F.substring(F.col("qual"), s + 1, F.greatest(length, F.lit(0)))).otherwise(F.col("qual")), "comment": _note(note, when),
    })


def filter_wildcards(reads: DataFrame, most: int) -> DataFrame:
    return reads.where(Q.wildcards(F.col("seq")) <= most)


def filter_size(reads: DataFrame, least: int) -> DataFrame:
    return reads.where(F.length("qual") >= least)


def filter_names(reads: DataFrame, names: DataFrame) -> DataFrame:
    """Reads whose name is listed; a leading @ in the list is ignored."""
    return reads.join(names.select(F.regexp_replace("name", "^@", "").alias("name")).distinct(), "name", "left_semi").select(reads.columns)


def _runs(reads: DataFrame, tile: int = 1_000_000) -> DataFrame:
    """reads with run (number of a stretch of equal names in file order) and nth (place in it)."""
    from .intervals import carry

    # pre-read's name: within tiles of the file, the first of a tile sees the last of the one before
    df = reads.withColumn("__tile", F.floor(F.col("idx") / tile))
    ends = df.groupBy("__tile").agg(F.max_by("name", "idx").alias("__last"))
    ends = ends.select("__tile", F.lag("__last").over(Window.orderBy("__tile")).alias("__prev"))
    w = Window.partitionBy("__tile").orderBy("idx")
    df = df.join(ends, "__tile").withColumn("__new", F.coalesce((F.coalesce(F.lag("name").over(w), F.col("__prev")) != F.col("name")).cast("long"), F.lit(1).cast("long"))).drop("__prev")
    df = carry(df, [], "__tile", F.sum("__new"), F.sum, "__carry")
    df = df.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("__carry", F.lit(0))).drop("__tile", "__new", "__carry")
    return df.withColumn("nth", F.row_number().over(Window.partitionBy("run").orderBy("idx")) - 1)


def filter_pairs(reads: DataFrame) -> DataFrame:
    """Neighbours of one name in twos; a third one goes."""
    df = _runs(reads).withColumn("__n", F.count("*").over(Window.partitionBy("run")))
    return df.where(F.col("nth") < F.col("__n") - F.col("__n") % 2).select(reads.columns)


def filter_quality_window(reads: DataFrame, least: float, window: int, illumina: bool = False) -> DataFrame:
    """Cut at the first window of mean quality below `least`; what stays ends with the window's last base
    but one. The last window of a read is not looked at."""
    q = Q.phred(F.col("qual"), 64 if illumina else 33)
    at = F.transform(F.sequence(F.lit(0), F.greatest(F.length("qual") - window - 1, F.lit(0))), lambda i: F.aggregate(F.slice(F.col("__q"), i + 1, F.lit(window)), F.lit(0), lambda a, x: a + x))
    df = reads.withColumn("__q", q).withColumn("__low", F.when(F.length("qual") > window, F.array_position(F.transform(at, lambda x: x < least * window), True)).otherwise(0))
    low = F.col("__low") > 0
    return _cut(df, 0, (F.col("__low") + window - 2).cast("int"), low, "qual").drop("__q", "__low")


def filter_suffix_quality(reads: DataFrame, value: str) -> DataFrame:
    """Trailing qualities equal to value go."""
    keep = F.length(F.rtrim(F.col("qual"), F.lit(value)))
    return _cut(reads, 0, keep, keep < F.length("qual"), "suff")


def filter_truncate(reads: DataFrame, size: int) -> DataFrame:
    return _cut(reads, 0, F.lit(size), F.length("qual") > size, "trunc")


def filter_prefix(reads: DataFrame, size: int) -> DataFrame:
    """The first bases go; not for colour space with a prefix base."""
    odd = F.length("seq") != F.length("qual")
    df = reads.withColumn("seq", F.when(odd, F.raise_error(F.lit("a colour-space prefix can't be trimmed")).cast("string")).otherwise(F.col("seq")))
    return _cut(df, size, F.length("qual") - size, F.length("qual") > size, "trunc")


def adapter_start(seq: Column, adapter: str, share: float, least: int) -> Column:
    """Length of the 3' end that matches the beginning of an adapter: from `least` on the ends are tried by
    length; the best is kept until one after a match is no better. N in the adapter matches anything.
    Reads of one length are compared together, base by base of the adapter, in Arrow batches."""
    code = np.frombuffer(adapter.upper().encode("latin-1"), np.uint8)
    free = code == ord("N")

    def starts(texts: list[str], n: int) -> np.ndarray:
        bases = np.frombuffer("".join(texts).upper().encode("latin-1", "replace"), np.uint8).reshape(len(texts), n)
        best, at = np.zeros(len(texts), np.int32), np.zeros(len(texts), np.int32)
        done = np.zeros(len(texts), bool)
        for i in range(least, n + 1):
            m = min(i, len(code))
            hits = ((bases[:, n - i : n - i + m] == code[:m]) | free[:m]).sum(1)
            good = (hits >= m * share) & (hits >= best)
            take = good & ~done
            done |= ~good & (best > 0)
            best[take], at[take] = hits[take], i
        return np.where(best > 0, at, 0)

    def find(col: pa.Array) -> pa.Array:
        texts = col.to_pylist()
        by = defaultdict(list)
        for k, t in enumerate(texts):
            by[-1 if t is None else len(t)].append(k)
        out = np.zeros(len(texts), np.int32)
        for n, own in by.items():
            if n >= least:
                out[own] = starts([texts[k] for k in own], n)
        return pa.array(out, mask=np.array([t is None for t in texts], bool))

    find.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return arrow_udf(find, "int")(seq)


def filter_adapter(reads: DataFrame, adapter: str, share: float = 0.8, least: int = 4) -> DataFrame:
    """Adapters at the 3' end go; reads that are nothing else are dropped."""
    df = reads.withColumn("__i", adapter_start(F.col("seq"), adapter, share, least))
    df = df.where((F.col("__i") == 0) | (F.length("qual") > F.col("__i")))
    return _cut(df, 0, F.length("qual") - F.col("__i"), F.col("__i") > 0, "trim").drop("__i")


def filter_chain(reads: DataFrame, *stages) -> tuple[DataFrame, list]:
    """Applies DataFrame functions in turn; an Observation for each tells how many reads it put out and
    altered (their comment ends in a note), once the result has been computed."""
    from pyspark.sql import Observation

    seen = []
    for k, stage in enumerate(stages):
        obs = Observation(f"stage{k}")
        reads = stage(reads).observe(obs, F.count(F.lit(1)).alias("kept"), F.count_if(F.coalesce(F.col("comment"), F.lit("")).rlike("#[a-z]+$")).alias("altered"))
        seen.append(obs)
    return reads, seen


# --- conversions -----------------------------------------------------------------------------------

def tag_names(reads: DataFrame, prefix: str = "", suffix: str = "") -> DataFrame:
    return reads.withColumn("name", F.concat(F.lit(prefix), "name", F.lit(suffix)))


def revcomp_reads(reads: DataFrame) -> DataFrame:
    return reads.withColumns({"seq": Q.revcomp(F.col("seq")), "qual": F.reverse("qual")})


def truncate(reads: DataFrame, size: int) -> DataFrame:
    extra = F.length("seq") - F.length("qual")
    return reads.withColumns({"seq": F.substring(F.col("seq"), F.lit(1), F.lit(size) + extra), "qual": F.substring("qual", 1, size)})


def tiles(reads: DataFrame, length: int = 35, offset: int = 10) -> DataFrame:
    """Overlapping tiles with part, their number; a tile that would end where the read ends is none."""
    last = F.length("seq") - length - 1
    at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(offset))).otherwise(F.array().cast("array<int>"))
    df = reads.select("*", F.posexplode(at).alias("part", "__p"))
    note = F.concat_ws(" ", F.nullif("comment", F.lit("")), F.concat(F.lit("#tile:"), F.col("__p").cast("string"), F.lit(","), (F.col("__p") + length).cast("string")))
    return df.withColumns({"comment": note, "seq": F.substring(F.col("seq"), F.col("__p") + 1, F.lit(length)), "qual": F.substring(F.col("qual"), F.col("__p") + 1, F.lit(length))}).drop("__p")


def to_fasta(reads: DataFrame, qual: bool = False) -> DataFrame:
    """name and sequence, or qualities as numbers separated by blanks."""
    value = F.array_join(F.transform(Q.phred(F.col("qual")), lambda x: x.cast("string")), " ") if qual else F.col("seq")
    return reads.select("idx", "name", "comment", value.alias("seq"))


def names(reads: DataFrame, comment: bool = False) -> DataFrame:
    return reads.select(F.concat_ws(" ", "name", F.nullif("comment", F.lit(""))).alias("name") if comment else F.col("name"))


def convert_quality(reads: DataFrame) -> DataFrame:
    """Illumina 1.3 qualities to Sanger ones; comments go."""
    return reads.withColumns({"qual": Q.shift_quality(F.col("qual"), -31), "comment": F.lit("")})


def encode_colours(reads: DataFrame) -> DataFrame:
    """Colours as bases; a prefix base goes with the first colour and quality."""
    prefix = F.length("seq") > F.length("qual")
    seq = F.when(prefix, F.substring("seq", 3, 1 << 30)).otherwise(F.col("seq"))
    return reads.withColumns({"seq": Q.colour_to_base(seq), "qual": F.when(prefix, F.substring("qual", 2, 1 << 30)).otherwise(F.col("qual"))})


def from_fasta(fasta: DataFrame, quals: DataFrame | None = None, suffix: str | None = None, common: int | None = None) -> DataFrame:
    """Sequences and qualities (blank-separated numbers, or one for all) of one order and names as reads."""
    s = fasta.select("idx", "name", F.col("seq"))
    if common is not None:
        joined = s.withColumn("q", F.array_repeat(F.lit(common), F.length("seq")))
    else:
        q = quals.select("idx", F.col("name").alias("__n"), F.transform(F.split(F.trim("seq"), r"\s+"), lambda x: x.cast("int")).alias("q"))
        joined = s.join(q, "idx").withColumn("name", F.when(F.col("name") == F.col("__n"), F.col("name")).otherwise(F.raise_error(F.lit("names of sequences and qualities differ")).cast("string")))
    name = F.concat(Q.trim_name(F.col("name")), F.lit(suffix or ""))
    return joined.select("idx", name.alias("name"), F.lit("").alias("comment"), "seq", Q.phred_text(F.col("q")).alias("qual"))


def from_qseq(rows: DataFrame, solexa: bool = False, min_length: int = 0, trim: bool = False, tag: str | None = None, keep_failed: bool = False) -> DataFrame:
    """qseq rows as reads: those that passed the filter, trailing B qualities trimmed if trim (and only
    then shorter ones than min_length dropped), qualities in Sanger scale."""
    df = rows if keep_failed else rows.where(~F.col("qc").isin("0", "QC"))
    index = F.when(F.col("index").isin("0", ""), F.lit("")).otherwise(F.concat(F.lit("#"), "index"))
    place = F.concat(F.col("machine"), F.lit("_"), F.col("run"), F.lit(":"), F.concat_ws(":", "lane", "tile", "x", "y"), index, F.lit("/"), "read")
    seq, qual = F.translate("seq", ".", "N"), F.col("qual")
    if trim:
        kept = F.length(F.rtrim(qual, F.lit("B")))
        df = df.where((kept > 0) & (kept >= min_length))
        seq, qual = F.substring(seq, F.lit(1), kept), F.substring(qual, F.lit(1), kept)
    qual = Q.solexa_quality(qual) if solexa else Q.shift_quality(qual, -31)
    order = "idx" if "idx" in rows.columns else F.monotonically_increasing_id().alias("idx")
    return df.select(order, F.concat(F.lit(tag or ""), place).alias("name"), F.lit("").alias("comment"), seq.alias("seq"), qual.alias("qual"))


def to_reads(read1: DataFrame, read2: DataFrame | None = None) -> DataFrame:
    """Reads as unmapped alignments; with mates, in pairs by place in the file."""
    def side(df: DataFrame, flag: int, n: int) -> DataFrame:
        return df.select(F.col("name").alias("qname"), F.lit(flag).alias("flag"), F.lit(None).cast("string").alias("chrom"), F.lit(-1).alias("pos"), F.lit(0).alias("mapq"), F.lit("*").alias("cigar"), "seq", "qual", (F.col("idx") * 2 + n).alias("idx"))

    if read2 is None:
        return side(read1, 4, 0)
    return side(read1, 1 | 4 | 8 | 64, 0).unionByName(side(read2, 1 | 4 | 8 | 128, 1))


# --- several files ---------------------------------------------------------------------------------

def split_round_robin(reads: DataFrame, parts: int, ignore_pairs: bool = False) -> DataFrame:
    """reads with part: records, or neighbours of one name, dealt in turn."""
    if ignore_pairs:
        return reads.withColumn("part", F.col("idx") % parts)
    df = _runs(reads)
    return df.withColumn("part", (F.col("run") - 1) % parts).drop("run", "nth")


def unmerge(reads: DataFrame) -> DataFrame:
    """reads with part: the k-th of neighbours of one name is in part k."""
    return _runs(reads).withColumnRenamed("nth", "part").drop("run")


def merge(files: list[DataFrame], slash: bool = False) -> DataFrame:
    """Files of one order of names interleaved; names may differ after a slash if slash. Other differences
    are an error."""
    first = files[0].select("idx", F.col("name").alias("__first"))
    key = lambda c: F.split(c, "/").getItem(0) if slash else F.col(c)
    out = None
    for k, df in enumerate(files):
        one = df.join(first, "idx").withColumn("name", F.when(key("name") == key("__first"), F.col("name")).otherwise(F.raise_error(F.lit("names differ")).cast("string"))).drop("__first").withColumn("file", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def proper_pairs(read1: DataFrame, read2: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs by name, one row of pairs, discarded1, discarded2)."""
    a, b = (df.select("name", F.struct("comment", "seq", "qual").alias(f"r{n}")) for n, df in ((1, read1), (2, read2)))
    both = a.join(b, "name", "full")
    counts = both.agg(F.count_if(F.col("r1").isNotNull() & F.col("r2").isNotNull()).alias("pairs"), F.count_if(F.col("r2").isNull()).alias("discarded1"), F.count_if(F.col("r1").isNull()).alias("discarded2"))
    return both.where("r1 is not null and r2 is not null"), counts


def sort_reads(reads: DataFrame, by_sequence: bool = False) -> DataFrame:
    return reads.orderBy("seq" if by_sequence else "name", "idx")


# --- properties and statistics ---------------------------------------------------------------------

def quality_scale(reads: DataFrame, probe: int = 10_000) -> DataFrame:
    """One row, scale: Sanger, Illumina, Solexa or Unknown, judged by the first reads of the file."""
    q = F.transform(F.filter(F.split("qual", ""), lambda c: c != ""), lambda c: F.ascii(c))
    span = reads.where(F.col("idx") <= probe).select(F.array_min(q).alias("lo"), F.array_max(q).alias("hi")).where("lo is not null")
    fits = lambda r: (F.col("lo") >= r[0]) & (F.col("hi") <= r[1])
    kind = F.when(fits(SANGER), "Sanger").when(fits(ILLUMINA), "Illumina").when(fits(SOLEXA), "Solexa").otherwise("Unknown")
    n = span.select(kind.alias("k")).agg(*[F.count_if(F.col("k") == k).alias(k) for k in ("Sanger", "Illumina", "Solexa", "Unknown")])
    return n.select(F.when(F.col("Unknown") > 0, "Unknown").when(F.col("Solexa") > 0, "Solexa").when(F.col("Sanger") > F.col("Illumina"), "Sanger").otherwise("Illumina").alias("scale"))


def is_colorspace(reads: DataFrame) -> DataFrame:
    """One row: whether the first telling character after a sequence's first is a colour."""
    tell = F.regexp_extract(F.substring("seq", 2, 1 << 30), "[0-3ACGTacgt]", 0)
    return reads.select("idx", tell.alias("t")).where("t <> ''").agg(F.coalesce(F.min_by(F.col("t").rlike("[0-3]"), "idx"), F.lit(False)).alias("colorspace"))


def pair_count(reads: DataFrame) -> DataFrame:
    """One row, n: how many neighbours share the first name."""
    first = reads.agg(F.min_by("name", "idx").alias("__f"))
    other = reads.crossJoin(F.broadcast(first)).where(F.col("name") != F.col("__f")).agg(F.min("idx").alias("__o"))  # one row each
    return reads.crossJoin(F.broadcast(other)).where(F.col("__o").isNull() | (F.col("idx") < F.col("__o"))).agg(F.count("*").alias("n"))


def length_counts(reads: DataFrame) -> DataFrame:
    return reads.groupBy(F.length("qual").alias("length")).agg(F.count("*").alias("n"))


def summary_of_counts(counts: DataFrame, keys: list[str], value: str = "value", n: str = "n") -> DataFrame:
    """keys with mean, deviation, least, quartiles (the first value at which more than the share is
    reached; a share reached at value 0 goes to the next), largest and total of values with counts."""
    from ..functions.stats import weighted_stdev

    w = Window.partitionBy(*keys)
    df = counts.where(F.col(n) > 0).withColumns({"__c": F.sum(n).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "__t": F.sum(n).over(w)})
    reach = lambda p: F.min(F.when((F.col("__c") / F.col("__t") > p) & (F.col(value) > 0), F.col(value)))
    v = F.col(value).cast("double")
    return df.groupBy(*keys).agg(
        (F.sum(v * F.col(n)) / F.sum(n)).alias("mean"), weighted_stdev(v, F.col(n)).alias("stdev"), F.min(value).alias("min"),
        *[F.coalesce(reach(p), F.lit(0)).alias(a) for p, a in ((0.25, "pct25"), (0.5, "median"), (0.75, "pct75"))], F.max(value).alias("max"), F.sum(n).alias("total"),
    )


def quality_stats(reads: DataFrame) -> DataFrame:
    """Summary of qualities (negative ones as 0) for each position from 1."""
    q = reads.select(F.posexplode(Q.phred(F.col("qual"))).alias("p", "q")).select((F.col("p") + 1).alias("position"), F.greatest("q", F.lit(0)).alias("value"))
    return summary_of_counts(q.groupBy("position", "value").agg(F.count("*").alias("n")), ["position"])


# --- local alignment -------------------------------------------------------------------------------

def smith_waterman(refs: np.ndarray, query: str, match: int = 2, mismatch: int = -1, gap: int = -1) -> np.ndarray:
    """Rows of score, ref start, ref end, query start, query end and matches of the best local alignment of
    each row of refs (bytes, reads of one length); ends exclusive; among equals the first end along ref,
    then query. A cell of the matrix is worked out for all reads at once."""
    count, m = refs.shape
    code = np.frombuffer(query.encode("latin-1"), np.uint8)
    n = len(code)
    zero = np.zeros(count, np.int32)
    prev = [(zero, zero, zero, zero)] * (n + 1)  # score, ref start, query start, matches
    best = [zero.copy() for _ in range(6)]
    for i in range(1, m + 1):
        row = [(zero, zero + i, zero, zero)]
        for j in range(1, n + 1):
            same = refs[:, i - 1] == code[j - 1]
            d, u, l = prev[j - 1], prev[j], row[j - 1]
            on = d[0] > 0
            cell = [d[0] + np.where(same, match, mismatch), np.where(on, d[1], i - 1), np.where(on, d[2], j - 1), np.where(on, d[3], 0) + same]
            for other in (u, l):
                more = other[0] + gap > cell[0]
                if more.any():
                    cell = [np.where(more, x + gap if k == 0 else x, y) for k, (x, y) in enumerate(zip(other, cell))]
            none = cell[0] <= 0
            cell = tuple(np.where(none, v, c) for v, c in zip((0, i, j, 0), cell))
            up = cell[0] > best[0]
            if up.any():
                for k, v in enumerate((cell[0], cell[1], i, cell[2], j, cell[3])):
                    best[k] = np.where(up, v, best[k])
            row.append(cell)
        prev = row
    return np.stack(best, 1)


def _aligned(texts: list[str], query: str) -> np.ndarray:
    """smith_waterman for reads of any lengths, those of one length together."""
    out = np.zeros((len(texts), 6), np.int64)
    by = defaultdict(list)
    for k, t in enumerate(texts):
        by[len(t)].append(k)
    for n, own in by.items():
        if n:
            out[own] = smith_waterman(np.frombuffer("".join(texts[k] for k in own).encode("latin-1", "replace"), np.uint8).reshape(len(own), n), query)
    return out


def trim_linkers(reads: DataFrame, five: str | None = None, three: str | None = None, identity: float = 0.8, min_trim: int = 4, min_len: int = 25) -> DataFrame:
    """Linkers at the ends, found by local alignment of min_trim bases or more at that identity and near the
    end, go; reads shorter than min_len afterwards are dropped. Batches go through Arrow."""
    schema = reads.schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            up = [t.upper() for t in df["seq"]]
            size = np.array([len(t) for t in up], np.int64)
            left, right = np.zeros(len(up), np.int64), size.copy()
            fits = lambda s, a, b, c, d, n: (s > 0) & (b - a >= min_trim) & (n / np.maximum(1, np.maximum(b - a, d - c)) >= identity)
            if five and up:
                s, a, b, c, d, n = _aligned(up, five.upper()).T
                left = np.where(fits(s, a, b, c, d, n) & ((a < min_trim) | (c < min_trim) & (d == len(five))), b, left)
            if three and up:
                s, a, b, c, d, n = _aligned(up, three.upper()).T
                right = np.where(fits(s, a, b, c, d, n) & (c < min_trim) & ((b > size - min_trim) | (d == len(three))), a, right)
            for col in ("seq", "qual"):
                df[col] = [t[x:y] for t, x, y in zip(df[col], left.tolist(), right.tolist())]
            yield df[right - left >= min_len]

    return reads.mapInPandas(run, schema)


def split_barcodes(reads: DataFrame, barcodes: list[tuple[str, str, str, bool]], edits: int = 0, slack: int = 0, allow_revcomp: bool = False) -> DataFrame:
    """reads with tag, the first barcode (name, sequence, end 5 or 3, strip) that fits, or missing, and,
    where that asks for it, the barcode stripped. It fits with no more than `edits` differences within
    `slack` bases of its end; with allow_revcomp reads are turned if only that fits."""
    from pyspark.sql import types as T

    schema = T.StructType(reads.schema.fields + [T.StructField("tag", T.StringType())])
    other = str.maketrans(Q.BASES, Q.COMPLEMENT)

    def find(texts: list[str]) -> list[tuple | None]:
        """(name, end, strip, start and end of the barcode) of the first that fits each read."""
        out: list[tuple | None] = [None] * len(texts)
        for name, code, end, strip in barcodes:
            code = code.upper()
            todo = [k for k, x in enumerate(out) if x is None]
            if not todo:
                break
            if edits == 0 and slack == 0:  # nothing to align
                for k in todo:
                    if texts[k].startswith(code) if end == "5" else texts[k].endswith(code):
                        out[k] = (name, end, strip, (0, len(code)) if end == "5" else (len(texts[k]) - len(code), len(texts[k])))
                continue
            size = np.array([len(texts[k]) for k in todo])
            s, a, b, c, d, n = _aligned([texts[k] for k in todo], code).T
            wrong = len(code) - (b - a) + np.maximum(b - a, d - c) - n
            near = a <= slack if end == "5" else b >= size - slack
            for i in np.flatnonzero((s > 0) & (wrong <= edits) & near).tolist():
                out[todo[i]] = (name, end, strip, (int(a[i]), int(b[i])))
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            seqs = df["seq"].tolist()
            quals = df["qual"].tolist() if "qual" in df else [None] * len(seqs)
            found = find([t.upper() for t in seqs])
            if allow_revcomp:
                lost = [k for k, x in enumerate(found) if x is None]
                turned = [seqs[k].translate(other)[::-1] for k in lost]
                for k, t, got in zip(lost, turned, find([t.upper() for t in turned])):
                    if got:
                        found[k], seqs[k], quals[k] = got, t, quals[k][::-1] if quals[k] else quals[k]
            for k, got in enumerate(found):
                if got and got[2]:
                    cut = slice(got[3][1], None) if got[1] == "5" else slice(0, got[3][0])
                    seqs[k], quals[k] = seqs[k][cut], quals[k][cut] if quals[k] else quals[k]
            df["seq"] = seqs
            if "qual" in df:
                df["qual"] = quals
            df["tag"] = [got[0] if got else "missing" for got in found]
            yield df[[f.name for f in schema]]

    return reads.mapInPandas(run, schema)

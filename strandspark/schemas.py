"""Schemas of the data model. Coordinates are 0-based and half-open."""

from pyspark.sql import types as T

TAGS = T.MapType(T.StringType(), T.StructType([T.StructField("t", T.StringType()), T.StructField("v", T.StringType())]))

READS = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("qname", T.StringType()), ("flag", T.IntegerType()), ("chrom", T.StringType()), ("pos", T.IntegerType()), ("mapq", T.IntegerType()),
        ("cigar", T.StringType()), ("rnext", T.StringType()), ("pnext", T.IntegerType()), ("tlen", T.IntegerType()), ("seq", T.StringType()),
        ("qual", T.StringType()), ("tags", TAGS), ("idx", T.LongType()),
    )]
)

BED = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("chrom", T.StringType()), ("start", T.LongType()), ("end", T.LongType()), ("name", T.StringType()), ("score", T.DoubleType()), ("strand", T.StringType()),
        ("thick_start", T.StringType()), ("thick_end", T.StringType()), ("rgb", T.StringType()), ("extras", T.ArrayType(T.StringType())), ("idx", T.LongType()),
    )]
)

FASTQ = T.StructType([T.StructField("idx", T.LongType())] + [T.StructField(n, T.StringType()) for n in ("name", "comment", "seq", "qual")])
FASTA = T.StructType([T.StructField("idx", T.LongType())] + [T.StructField(n, T.StringType()) for n in ("name", "comment", "seq")])

GTF = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("chrom", T.StringType()), ("source", T.StringType()), ("feature", T.StringType()), ("start", T.LongType()), ("end", T.LongType()), ("score", T.StringType()),
        ("strand", T.StringType()), ("frame", T.StringType()), ("attrs", T.MapType(T.StringType(), T.StringType())), ("attributes", T.StringType()), ("idx", T.LongType()),
    )]
)

# The 26 columns of the dbSNP table.
DBSNP_COLUMNS = (
    "bin chrom chromStart chromEnd name score strand refNCBI refUCSC observed molType clazz valid avHet avHetSE func locType weight"
    " exceptions submitterCount submitters alleleFreqCount alleles alleleNs alleleFreqs bitfields"
).split()
DBSNP = T.StructType([T.StructField(n, T.LongType() if n in ("chromStart", "chromEnd") else T.StringType()) for n in DBSNP_COLUMNS])

QSEQ_COLUMNS = "machine run lane tile x y index read seq qual qc".split()
QSEQ = T.StructType([T.StructField(n, T.StringType()) for n in QSEQ_COLUMNS])

"""A training corpus from raw documents: toxic documents go, exact copies go, one document of each group
of near copies stays, personal data is masked, and what is left is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.llm.common import Scratch, ascii_lower, released, table
from strandspark.llm.exact_dedup import exact_dedup
from strandspark.llm.jaccard import jaccard_components
from strandspark.llm.packing import pack_documents
from strandspark.llm.pii import redact
from strandspark.llm.toxicity import learn, toxicity

#: Words of a shingle, and common to all shingles of two near copies in hundredths.
WORDS, NUM, DEN = 5, 80, 100


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5. The model is learned from labelled documents of this stage's input.

    Null and empty texts have the score of a text without hits, long texts are read to their end, repeated
    rows all stay or all go, null ids are no matter, an empty table stays empty, and further columns of any
    name stay as they are."""
    model = learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), docs["text"].alias("text"))
    return toxicity(rows, model, id_col="row").where("predicted = 0").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for the case of A-Z, the one with the largest doc_id.

    Null counts as an empty text, so one of all null and empty texts stays; texts of any length are compared
    as a whole; of repeated rows one stays; a null id is less than any other; an empty table stays empty,
    and further columns of any name stay as they are."""
    named = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_sha"))
    scratch = Scratch(spark, "copies")
    found = scratch.put(named)
    scratch.forget()
    sha = F.sha2(ascii_lower(F.coalesce(docs["text"], F.lit(""))).cast("binary"), 256)
    rows = docs.select(F.struct(*docs.columns).alias("row"), docs["doc_id"].alias("id"), sha.alias("sha"))
    kept = rows.join(found.hint("merge"), F.col("id").eqNullSafe(F.col("k_id")) & (F.col("sha") == F.col("k_sha")), "left_semi")
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():  # rows that share id and text
        kept = kept.dropDuplicates(["id", "sha"])
    return kept.select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that hangs together by links of 0.8 or more on shingles of five words:
    the one with the smallest doc_id.

    Null, empty and blank texts link with nothing and stay, texts of any length are compared as a whole,
    repeated rows stay or go together, documents without an id stay, an empty table stays empty, and further
    columns of any name stay as they are."""
    found = jaccard_components(docs, words=WORDS, num=NUM, den=DEN)
    scratch = Scratch(spark, "near-copies")
    gone = scratch.put(found.where("doc_id <> component_id").select("doc_id").distinct())
    scratch.forget()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data in its text replaced by the kind in brackets; n_chars follows.

    A null text stays null and so does its n_chars, empty ones and long ones are treated as any other, rows
    are independent, an empty table stays empty, and further columns of any name stay as they are."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of 512 to 4096 words.

    Null and empty texts take one place, for the end of the document; long ones are cut into pieces;
    repeated rows and null ids are placed each; an empty table has no places; further columns are not read."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", mask_personal_data),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read back before the next; tables of earlier stages go."""
    scratch, before = Scratch(spark, "pipeline"), None
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with released():  # what a stage wrote on its way
            docs = scratch.put(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs


#: Similarity groups, learned scores and bin packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None

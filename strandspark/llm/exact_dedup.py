"""Exact dedup by deterministic block naming, in DataFrame operations only.

Texts are cut into blocks of a fixed number of characters. Distinct blocks are sorted and numbered;
the numbers are names. Adjacent pairs of names are then named in the same way, level by level, until
one name is left of each document. Two documents have the same (level, name) just if their texts are
equal: no step relies on a hash being free of collisions.

Only the naming of blocks moves texts, once, and equal blocks are merged before the shuffle. Rows carry
128-bit fingerprints of their blocks to look names up by; that fingerprints and blocks match one to one
is verified on the named blocks themselves, and other seeds are taken if they don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

#: Characters of a block.
BLOCK = 4096
#: Pairs of seeds that are tried for fingerprints.
SEEDS = ((11, 97), (1009, 7), (31337, 271), (65537, 8191))


def fingerprint(block: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), block)


def _numbered(keys: DataFrame, *order: str) -> DataFrame:
    """Sorts distinct keys within partitions and numbers them: unique, and fixed once written."""
    return keys.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def name_documents(docs: DataFrame, scratch: Scratch, text: Column, ids: list[str], block: int = BLOCK, hashed=fingerprint) -> DataFrame:
    """rid (a number for each row), ids, sha (SHA-256 of text), level and name for every row of docs.
    Null texts count as empty."""
    text = F.coalesce(text, F.lit(""))
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.length("t") / F.lit(block)).cast("int"), F.lit(1)) - 1),
        lambda i: F.substring(F.col("t"), i * block + 1, F.lit(block)),
    )
    plain = docs.select(*ids, text.alias("t"))
    for one, two in SEEDS:
        marks = lambda b: (hashed(b, one).alias("h1"), hashed(b, two).alias("h2"))  # noqa: E731, B023
        rows = scratch.put(
            plain.select(*ids, F.sha2(F.encode("t", "utf-8"), 256).alias("sha"), F.transform(cut, lambda b: F.struct(*marks(b))).alias("marks"))  # noqa: B023
            .withColumn("rid", F.monotonically_increasing_id())
        )
        blocks = plain.select(F.explode(cut).alias("block")).select("block", *marks(F.col("block")))
        named = scratch.put(_numbered(blocks.distinct(), "block").select("h1", "h2", "name"))
        if named.groupBy("h1", "h2").count().where("count > 1").isEmpty():
            break
        scratch.drop(rows, named)
    else:
        raise RuntimeError("no pair of seeds gives every block a fingerprint of its own")
    places = rows.select("rid", F.posexplode("marks").alias("pos", "m")).select("rid", "pos", "m.h1", "m.h2")
    nodes = scratch.put(places.join(named, ["h1", "h2"]).select("rid", "pos", "name"))
    level, done = 0, None
    while True:
        ends = nodes.groupBy("rid").agg(F.count("*").alias("n"), F.min("name").alias("name"))
        single = ends.where("n = 1").select("rid", F.lit(level).alias("level"), "name")
        done = single if done is None else done.unionByName(single)
        pairs = nodes.join(ends.where("n > 1").select("rid"), "rid").groupBy("rid", F.expr("pos div 2").alias("pos")).agg(
            F.min_by("name", "pos").alias("first"), F.when(F.count("*") > 1, F.max_by("name", "pos")).otherwise(-1).alias("second")
        )
        pairs = scratch.put(pairs)
        if pairs.isEmpty():
            break
        level += 1
        names = scratch.put(_numbered(pairs.select("first", "second").distinct(), "first", "second"))
        nodes = scratch.put(pairs.join(names, ["first", "second"]).select("rid", "pos", "name"))
    return rows.select("rid", *ids, "sha").join(done, "rid")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold_case: bool = True, block: int = BLOCK, hashed=fingerprint) -> DataFrame:
    """One row for each row of docs: the id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after lower-casing A-Z (fold_case) and nothing else; null
    counts as empty, so all null and empty texts form one group. The row with the largest id stays, of
    repeated rows with that id exactly one, and null ids rank lowest: keep_id is null where all ids of a
    group are. An empty table gives an empty result. Other columns of docs are not read, so their names
    don't matter. Documents of any length: each is one row here, and its blocks are rows of their own.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    text = F.coalesce(docs[text_col], F.lit(""))
    named = name_documents(docs.select(docs[id_col].alias("id"), text.alias("x")), scratch, ascii_lower(F.col("x")) if fold_case else F.col("x"), ["id"], block, hashed)
    named = scratch.put(named)
    # written, so that a large group's rows can be split among tasks when they look up what stays
    groups = scratch.put(named.groupBy("level", "name").agg(F.max(F.struct("id", "rid")).alias("keep"), F.count("*").alias("group_size")))
    return named.join(groups, ["level", "name"]).select(
        F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), F.col("sha").alias("text_sha256")
    )

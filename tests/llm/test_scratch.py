"""Files of ended steps."""

import random
import time

import pytest
from pyspark.sql import functions as F

from strandspark.llm import suffix_dedup
from strandspark.llm.common import Scratch


def shuffled(spark):
    """Names of the shuffle files there are."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(found) if f.getName().startswith("shuffle_")}


def left_of(spark, names):
    """Which of the files are still there after three seconds, or as soon as none is."""
    end = time.time() + 3
    while (left := names & shuffled(spark)) and time.time() < end:
        time.sleep(0.05)
    return left


def test_shuffle_files_of_an_ended_step_go(spark):
    """The last step's, too: one round of garbage collection let them stay until the next."""
    scratch, before = Scratch(spark, "scratch"), shuffled(spark)
    d = spark.range(20_000).withColumn("k", F.xxhash64("id"))
    same = lambda batches: iter(batches)
    out = scratch.put(d.repartition(4, "k").mapInArrow(same, "id long, k long").join(d.withColumnRenamed("id", "j").hint("merge"), "k"))
    made = shuffled(spark) - before
    scratch.forget()
    assert made and not left_of(spark, made) and out.count() == 20_000


@pytest.mark.parametrize("crowd", [1, 50_000])
def test_removal_of_repeats_keeps_no_files_of_ended_steps(spark, monkeypatch, crowd):
    """Shuffle files and tables of ended steps lay beside the texts that the last steps move: 4.43 times the input."""
    rng = random.Random(crowd)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(120))
    df = spark.createDataFrame([(i, f"{word()} {passage[: 700 - i]} {word()}") for i in range(20)], "doc_id long, text string").repartition(4)
    before, kept = shuffled(spark), []

    def put(self, table, f=Scratch.put):
        kept.append(len(left_of(spark, shuffled(spark) - before)))
        return f(self, table)

    monkeypatch.setattr(Scratch, "put", put)
    out = suffix_dedup.remove_repeats(df, crowd=crowd)
    assert not left_of(spark, shuffled(spark) - before) and not any(kept) and len(kept) > 6
    assert all(r.n_removed > 600 for r in out.collect())

"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch holds at most; long documents would make the default batches too large.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds the rows and bytes of an Arrow batch, unless the session has smaller bounds already. The
    settings stay, since plans are made when results are asked for."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ARROW_ROWS:
        spark.conf.set(rows, str(ARROW_ROWS))
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) > ARROW_BYTES:
        spark.conf.set(size, str(ARROW_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, where
    both are one process, gets a folder of its own if that is unset."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="strandspark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Scratch:
    """Tables of one query in the shared folder. put() cuts lineage: what was written is read back,
    and a lost executor costs no recomputation of what led to it. As with checkpoints, what the result
    reads stays in the folder until its owner clears it: drop() removes what no later step reads, and
    released() all that was written within it, once results are stored elsewhere."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        for scope in getattr(_scopes, "open", ()):
            scope.append(self)

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that no later step reads."""
        for t in tables:
            for path in {f.rpartition("/")[0] for f in t.inputFiles()}:
                if "/" + self.root.rpartition("/")[2] + "/" in path:
                    self._delete(path)

    def forget(self) -> None:
        """Lets Spark remove the shuffle files of queries that have ended: it does so as soon as the driver
        has collected their plans as garbage, which may else take as long as the job. One round was seen
        to free them one step late, two at once; presumably the JVM learns late of what Python lets go."""
        for _ in range(2):
            gc.collect()
            time.sleep(0.05)
            self.spark._jvm.System.gc()

    def release(self) -> None:
        """Removes all of its tables."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


_scopes = threading.local()


@contextmanager
def released() -> Iterator[None]:
    """Removes the tables of every Scratch that this thread makes within."""
    scopes = _scopes.__dict__.setdefault("open", [])
    scopes.append(mine := [])
    try:
        yield
    finally:
        scopes.pop()
        for s in mine:
            s.release()


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else. lower() does just that to texts of single bytes, and faster."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))

"""What operators need from the session."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from itertools import count
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors see; where none is set, one of this machine's in local mode, as in tests, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
        found = tempfile.mkdtemp(prefix="cairn-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def rounds(most: int | None) -> Iterator[int]:
    """Numbers of rounds; an error once most are over, since what is there by then is a part of the result."""
    for n in count():
        if most is not None and n >= most:
            raise RuntimeError(f"not done after {most} rounds")
        yield n


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def landed(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read again: without its lineage, and with its true size.

    A checkpoint keeps the size that the planner estimates, and a join's estimate is the product
    of its sides'; so over many rounds of joins the estimates grow, which here begin anew.
    """
    path = f"{shared_folder(df.sparkSession)}/landed-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Turns:
    """A table that each round writes anew, in the shared folder; what the round before the last has written is deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/turns-{uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.root}/{self.n}")
        if self.n > 1:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{self.n - 1}")
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{self.n}")

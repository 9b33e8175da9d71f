"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset and the master is local."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="polisgrid-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Table:
    """A DataFrame written as Parquet in the shared folder and read again, so a lost executor costs a read only."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        df.write.parquet(self.path)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fitting(sample: DataFrame, most: int) -> DataFrame | None:
    """Of the rows of a bounded sample (doc_id, text), those of the documents that fit in so many bytes of text, the
    smallest by hash first; a document that would exceed them is passed over. None if there is no row.

    Only ids and sizes come to the driver.
    """
    sizes = sample.groupBy("doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    ids, total = [], 0
    for doc_id, size in sizes:
        if total + size <= most:
            ids.append((doc_id,))
            total += size
    if not ids:
        return None
    return sample.join(F.broadcast(sample.sparkSession.createDataFrame(ids, "doc_id long")), "doc_id", "left_semi")

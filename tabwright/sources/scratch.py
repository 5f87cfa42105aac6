"""Written tables between the steps of one piece of work, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session that names none, such as a test's, gets one of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
        found = "file://" + tempfile.mkdtemp(prefix="tabwright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Steps:
    """A folder of written tables; ``drop`` deletes it, and so does the end of a ``with`` block.

    A table that has been written is not computed again when an executor is lost, and cannot differ between two readers.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.count, self.root = spark, 0, f"{shared_dir(spark)}/steps-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def __enter__(self) -> Steps:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()


_held: dict[tuple[str, str], Steps] = {}


def steps_of(spark: SparkSession, name: str) -> Steps:
    """Steps of a registered query: those of its call before go, as their result has been read."""
    key = (spark.sparkContext.applicationId, name)
    if key in _held:
        _held.pop(key).drop()
    _held[key] = Steps(spark)
    return _held[key]

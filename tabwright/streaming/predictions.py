"""Running scores of predictions while they are still being written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.sources.files import PREDICTION


def read_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of prediction lines from files that appear below the folder."""
    return spark.readStream.schema(PREDICTION).json(folder)


def running_confusion(stream: DataFrame, gold: DataFrame) -> DataFrame:
    """Counts by gold and predicted label so far, for the complete or update output mode."""
    joined = stream.join(gold.select("id", F.col("label").alias("gold")), "id")
    return joined.groupBy("gold", F.coalesce("label", F.lit("INVALID")).alias("pred")).agg(F.count(F.lit(1)).alias("n"))

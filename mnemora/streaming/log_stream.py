"""The journal as a stream: an extension beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import JOURNAL


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.readStream.text(path)
    return lines.select(F.from_json("value", JOURNAL).alias("r")).select("r.*").where("op IS NOT NULL").withColumn("at", F.timestamp_seconds("ts"))


def op_counts(stream: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Calls by op and window; entries later than ``late`` are dropped by the watermark."""
    return stream.withWatermark("at", late).groupBy(F.window("at", window), "op").agg(F.count("*").alias("calls"))


def once_by_hash(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first entry of each content_hash within the watermark."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["content_hash"])


def compact(stream: DataFrame, snapshot: str, checkpoint: str):
    """Appends each micro-batch's last snapshot per id to a table partitioned by batch.

    A batch that runs again overwrites its own partition, so replays change nothing.
    """

    def fold(df: DataFrame, batch: int) -> None:
        last = df.where(F.col("op").isin("remember", "edit", "import", "forget")).groupBy("id").agg(F.max_by(F.struct("op", "after", "ts"), "ts").alias("s"))
        last.select("id", "s.*").write.mode("overwrite").parquet(f"{snapshot}/batch={batch}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

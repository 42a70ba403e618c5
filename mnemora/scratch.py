"""Intermediate tables in the folder that all executors share, and components."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session may go without one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
    own = os.path.join(tempfile.gettempdir(), "checkpoints")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        _delete(spark, path)


class Scratch:
    """Tables written down to cut lineage; ``drop`` removes one, the program's end all."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        atexit.register(_delete_at_exit, spark, self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}-{uuid.uuid4().hex[:6]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch = self  # the id stays taken while the frame lives
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := self.paths.pop(id(df), None):
                _delete(self.spark, path)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node in ``links(a, b)``: the smallest node reachable.
    The result is a table in ``scratch``.

    Large-star / small-star rounds (Kiveris et al.): each round is two
    aggregations with map-side combine and two joins that adaptive execution can
    split, so that a hub's links are never gathered in one task.
    """

    def starred(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        met = both.join(low, "u")
        if large:
            out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
        return out.where("a <> b").distinct()

    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        new = scratch.keep(starred(starred(edges, True), False))
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(edges)
        edges = new
        if tuple(now) == mark:
            break
        mark = tuple(now)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    out = scratch.keep(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots))
    scratch.drop(edges)
    return out

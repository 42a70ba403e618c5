"""A log of lines that is rotated by size, with no line lost or doubled at any stop.

Under a root the active lines are in ``active``. A rotation renames that folder to
``rotating-<n>``, writes its lines as segments of bounded size to ``half-<n>``, renames that to
``segments-<n>`` and deletes ``rotating-<n>``. Renames are whole or not at all, and a reader
passes over ``half`` folders and over what is rotating once its segments stand; so each
line is read once, whenever a rotation stops, and ``recover`` takes it up again.

Segments lie whole and in order in files of many, a line with its segment's number: a
large log has very many segments, but only as many files as tasks wrote it.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

LINE = "seq long, value string"
#: Segments that follow each other and go to one file.
TOGETHER = 256


class Log:
    """Lines (seq, value) under a root folder that only this log uses."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(""))) if self._fs.exists(self._path("")) else []

    def _move(self, old: str, new: str) -> None:
        if not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"can't rename {old} to {new} under {self.root}")

    def append(self, lines: DataFrame) -> None:
        """Adds ``lines(seq, value)``: a folder that appears among the active ones when whole."""
        name = uuid.uuid4().hex
        lines.select("seq", "value").write.json(f"{self.root}/new-{name}")
        self._fs.mkdirs(self._path("active"))
        self._move(f"new-{name}", f"active/{name}")

    def _shown(self) -> tuple[list[str], list[str]]:
        """Folders of JSON lines and of segments that a reader meets."""
        names = self._names()
        done = {n.split("-")[1] for n in names if n.startswith("segments-")}
        loose = [n for n in names if n.startswith("rotating-") and n.split("-")[1] not in done] + ["active"] * ("active" in names)
        loose = [n for n in loose if len(self._fs.listStatus(self._path(n)))]
        return loose, [n for n in names if n.startswith("segments-")]

    def read(self) -> DataFrame:
        """seq, value of every line."""
        loose, segments = self._shown()
        out = self.spark.createDataFrame([], LINE)
        for names in (loose, segments):
            if names:
                rows = self.spark.read.schema(LINE).option("recursiveFileLookup", True).json([f"{self.root}/{n}" for n in names])
                out = out.unionByName(rows.select("seq", "value"))
        return out

    def segments(self) -> DataFrame:
        """rotation, segment, n, bytes, first_seq, last_seq of what has been rotated."""
        names = self._shown()[1]
        if not names:
            return self.spark.createDataFrame([], "rotation string, segment int, n long, bytes long, first_seq long, last_seq long")
        rows = self.spark.read.schema(f"segment int, {LINE}").option("recursiveFileLookup", True).json([f"{self.root}/{n}" for n in names])
        part = lambda what: F.regexp_extract(F.input_file_name(), what, 1)
        # Older rotations have a folder a segment in place of the number in each line.
        own = F.coalesce("segment", F.when(F.col("segment").isNull(), part("/segment=([0-9]+)/")).cast("int"))
        rows = rows.select(part("/segments-([0-9]+)/").alias("rotation"), own.alias("segment"), "seq", "value")
        return rows.groupBy("rotation", "segment").agg(F.count("*").alias("n"), F.sum(size()).alias("bytes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))

    def rotate(self, most: int, stop: str = "") -> None:
        """Moves the active lines to segments of at most ``most`` bytes, in the order of seq.

        ``stop`` ends the work after a step, as a crash would: renamed, written or moved.
        A line longer than half of ``most`` is refused, as segments would be mostly empty.
        """
        self.recover(most)
        if "active" not in self._names():
            return
        last = max((int(n.split("-")[1]) for n in self._names() if re.match(r"(segments|rotating)-[0-9]+$", n)), default=0)
        self._move("active", f"rotating-{last + 1:09}")
        if stop != "renamed":
            self._finish(f"{last + 1:09}", most, stop)

    def recover(self, most: int) -> None:
        """Ends rotations that have stopped on the way, and clears what they left half done."""
        names = self._names()
        for n in names:
            if n.startswith(("half-", "new-")):
                self._fs.delete(self._path(n), True)
        for n in (x.split("-")[1] for x in names if x.startswith("rotating-")):
            if f"segments-{n}" in names:
                self._fs.delete(self._path(f"rotating-{n}"), True)
            else:
                self._finish(n, most)

    def _finish(self, n: str, most: int, stop: str = "") -> None:
        rows = self.spark.read.schema(LINE).option("recursiveFileLookup", True).json(f"{self.root}/rotating-{n}")
        out = segmented(rows, most).repartition(F.floor(F.col("segment") / TOGETHER)).sortWithinPartitions("segment", "seq", "value")
        out.select("segment", "seq", "value").write.option("compression", "gzip").json(f"{self.root}/half-{n}")
        if stop == "written":
            return
        self._move(f"half-{n}", f"segments-{n}")
        if stop != "moved":
            self._fs.delete(self._path(f"rotating-{n}"), True)


def size() -> Column:
    """Bytes of a line with its end."""
    return F.octet_length("value") + 1


def segmented(rows: DataFrame, most: int) -> DataFrame:
    """``rows(seq, value)`` with segment: no segment's lines have more than ``most`` bytes.

    A segment takes the lines that end in its stretch of ``most`` less the longest line, of
    the whole log's bytes. Where a line ends is its place in a range of the sorted lines and
    the sum of the ranges before, so that no task has more than its range.
    """
    longest = rows.agg(F.coalesce(F.max(size()), F.lit(0))).first()[0]
    if 2 * longest > most:
        raise ValueError(f"a line has {longest} bytes, more than half of a segment's {most}")
    parts = Scratch(rows.sparkSession).keep(rows.orderBy("seq", "value").withColumn("_p", F.spark_partition_id()))
    sums = parts.groupBy("_p").agg(F.sum(size()).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    starts = sums.select("_p", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.sum(size()).over(Window.partitionBy("_p").orderBy("seq", "value").rowsBetween(Window.unboundedPreceding, 0))
    ends = parts.withColumn("_inside", inside).join(F.broadcast(starts), "_p").withColumn("_end", F.col("_start") + F.col("_inside"))
    return ends.withColumn("segment", F.floor((F.col("_end") - 1) / (most - longest + 1)).cast("int")).select("seq", "value", "segment")

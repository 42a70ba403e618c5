"""Readers and writers: journals, archives, trash, gold sets, text to ingest."""

from __future__ import annotations

import gzip
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import scalars as S

JOURNAL = "ts double, op string, actor string, id string, before string, after string, meta string, scope string"
ARCHIVE_ROW = "id string, text string, meta string, vector array<double>"
ARCHIVE_HEADER = "format string, version int, exported_at double, source string, options string"
TRASH = "memory_id string, deleted_at double, actor string, memory string, collection string"
GOLD = "query string, relevant_ids array<string>, k int, mode string"
#: The archive format that is read and written.
FORMAT, VERSION = "memory-archive", 1


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of plain or gzipped files; lines that don't parse are left out.

    ``seq`` orders the rows as the files do: rotated segments by name, the active file
    last, and within a file by line. Of a segment that is there both plain and gzipped
    the plain file counts, as the other may be cut short.
    """
    kind = StructType.fromDDL(schema)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"))
    bare = F.regexp_replace("file", r"\.gz$", "")
    lines = lines.withColumn("segment", bare)
    plain = lines.where("file = segment").select("segment").distinct().withColumn("plain", F.lit(True))
    lines = lines.join(F.broadcast(plain), "segment", "left").where("plain IS NULL OR file = segment")
    got = lines.withColumn("row", F.from_json("value", kind, {"mode": "PERMISSIVE"}))
    active = F.when(F.col("segment").rlike(r"^[^-]*\.(log|jsonl)$"), 1).otherwise(0)
    first = kind.fieldNames()[0]
    return got.where(F.col(f"row.{first}").isNotNull()).select(F.struct(active.alias("active"), "segment", "line").alias("seq"), "row.*")


def read_journal(
    spark: SparkSession,
    path: str,
    *,
    since: float | None = None,
    until: float | None = None,
    op: str | None = None,
    actor: str | None = None,
    scope: str | None = None,
) -> DataFrame:
    """Entries between ``since`` and ``until``, both included, in the order of ``seq``."""
    j = read_lines(spark, path, JOURNAL)
    given = (
        (since, F.col("ts") >= F.lit(since)),
        (until, F.col("ts") <= F.lit(until)),
        (op, F.col("op") == F.lit(op)),
        (actor, F.col("actor") == F.lit(actor)),
        (scope, F.col("scope") == F.lit(scope)),
    )
    for value, cond in given:
        if value is not None:
            j = j.where(cond)
    return j


def write_journal(entries: DataFrame, path: str) -> None:
    """Appends entries as segments, one a day of ``ts``, that retention can drop whole."""
    day = F.date_format(F.timestamp_seconds("ts"), "yyyyMMdd")
    entries.withColumn("day", day).write.partitionBy("day").mode("append").option("compression", "gzip").json(path)


def pruned_days(spark: SparkSession, path: str, keep_days: float, now: float) -> list[str]:
    """Drops the journal's day folders that are older than ``keep_days``; 0 keeps all."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    cutoff = spark.range(1).select(F.date_format(F.timestamp_seconds(F.lit(now - keep_days * 86_400)), "yyyyMMdd")).first()[0]
    gone = []
    for status in fs.listStatus(root) if keep_days > 0 else []:
        name = status.getPath().getName()
        if name.startswith("day=") and name[4:] < cutoff:
            fs.delete(status.getPath(), True)
            gone.append(name[4:])
    return sorted(gone)


def read_goldset(spark: SparkSession, path: str) -> DataFrame:
    """Cases; blank lines and those that start with # don't count."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    return lines.select(F.from_json("value", GOLD).alias("c")).select("c.*").where("query IS NOT NULL")


def write_archive(rows: DataFrame, path: str, header: dict) -> int:
    """A gzipped archive: a header line, then rows by (created_at, id). Streams through
    the driver partition by partition, as the format is one file."""
    n = 0
    cols = [c for c in ("id", "text", "meta", "vector") if c in rows.columns]
    with gzip.open(path, "wt", encoding="utf-8") as out:
        out.write(json.dumps({"format": FORMAT, "version": VERSION, **header}) + "\n")
        for r in rows.orderBy("created_at", "id").select(F.to_json(F.struct(*cols)).alias("line")).toLocalIterator():
            out.write(r.line + "\n")
            n += 1
    return n


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an archive without its header line."""
    return read_lines(spark, path, ARCHIVE_ROW).where("text IS NOT NULL")


def archive_info(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """format, version, model, dim, rows, usable, same_model of an archive, by its header.

    It is usable if the format is ours and the version not newer; its vectors count
    only where the model is the store's.
    """
    lines = spark.read.text(path)
    heads = lines.select(F.from_json("value", ARCHIVE_HEADER).alias("h")).where("h.format IS NOT NULL").select("h.*")
    rows = lines.select(F.from_json("value", ARCHIVE_ROW).alias("r")).where("r.text IS NOT NULL").agg(F.count("*").alias("rows"))
    own = F.get_json_object("source", "$.embedding_model")
    usable = (F.col("format") == FORMAT) & (F.coalesce("version", F.lit(0)) <= VERSION)
    info = heads.select("format", "version", own.alias("model"), F.get_json_object("source", "$.embedding_dim").cast("int").alias("dim"), usable.alias("usable"))
    same = F.lit(True) if model is None else F.coalesce(F.col("model") == model, F.lit(False))
    return info.withColumn("same_model", same).join(rows, F.lit(True))


def open_archive(spark: SparkSession, path: str, model: str, regenerate: bool = False) -> tuple[DataFrame, bool]:
    """(rows, whether their vectors count) of an archive that may be imported.

    One that isn't an archive, is of a newer version, or holds vectors of another model is
    refused; the last not with ``regenerate``, where texts are embedded anew. Without
    vectors the model doesn't matter.
    """
    try:
        info = archive_info(spark, path, model).first()
    except Exception as e:  # noqa: BLE001 - whatever makes a file unreadable is one kind of error here
        raise ValueError(f"{path} can't be read as an archive: {str(e)[:200]}") from e
    if info is None or not info.usable:
        raise ValueError(f"{path} is no archive of version {VERSION} or older")
    held = (info.dim or 0) > 0
    if held and info.model and not info.same_model and not regenerate:
        raise ValueError(f"the archive's vectors are of {info.model!r}, the store's of {model!r}; embed them anew (regenerate)")
    return read_archive(spark, path), held and (info.same_model or not info.model)


def read_trash(spark: SparkSession, path: str) -> DataFrame:
    """Trash entries, the row's snapshot as JSON; lines cut short are left out."""
    return read_lines(spark, path, TRASH).withColumn("collection", F.coalesce("collection", F.lit("")))


def write_trash(entries: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").option("compression", "gzip").json(path)


def ingest_files(spark: SparkSession, path: str, max_chars: int = 500, min_chars: int = 30) -> DataFrame:
    """source, position, text: chunks of whole text files."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    found = files.select(F.concat(F.lit("ingest:"), "file").alias("source"), F.posexplode(S.chunks(F.col("value"), max_chars, min_chars)).alias("position", "text"))
    return found

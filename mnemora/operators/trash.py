"""Soft deletes: entries (memory_id, deleted_at, actor, collection, memory) beside the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _visible(collection: str) -> Column:
    """Entries without a collection are old ones, which every collection sees."""
    return F.col("collection").isin("", collection)


def trash(rows: DataFrame, ids: DataFrame, now: float, actor: str = "", collection: str = "") -> tuple[DataFrame, DataFrame]:
    """(rows, entries): rows leave for the trash whole; ids that don't exist do nothing."""
    met = rows.join(ids.select("id").distinct(), "id", "left_semi")
    memory = F.struct(*[F.col(c) for c in rows.columns])
    entries = met.select(F.col("id").alias("memory_id"), F.lit(now).alias("deleted_at"), F.lit(actor).alias("actor"), F.lit(collection).alias("collection"), memory.alias("memory"))
    return rows.join(ids.select("id"), "id", "left_anti"), entries


def listed(entries: DataFrame, collection: str) -> DataFrame:
    """The collection's entries, oldest first."""
    return entries.where(_visible(collection)).orderBy("deleted_at", "memory_id")


def _newest(entries: DataFrame, collection: str) -> DataFrame:
    """Entries with _back: whether it is the visible one of its row to come back first. Of
    equal times one is chosen by the entry's content, of equal entries any one."""
    marked = entries.withColumn("_mine", _visible(collection)).withColumn("_h", F.xxhash64(*[F.col(c) for c in entries.columns]))
    last = marked.where("_mine").groupBy("memory_id").agg(F.max(F.struct("deleted_at", "_h")).alias("_last"))
    met = marked.join(last, "memory_id", "left").withColumn("_top", F.col("_mine") & (F.struct("deleted_at", "_h") == F.col("_last")))
    met = met.withColumn("_top", F.coalesce("_top", F.lit(False))).drop("_mine", "_h", "_last")
    # Only entries that are the same in all are numbered.
    tops = met.where("_top").withColumn("_back", F.row_number().over(Window.partitionBy("memory_id").orderBy("deleted_at")) == 1)
    return met.where("NOT _top").withColumn("_back", F.lit(False)).unionByName(tops).drop("_top")


def restorable(entries: DataFrame, rows: DataFrame, collection: str) -> DataFrame:
    """The newest visible entry of each row that isn't live again."""
    mine = _newest(entries, collection).where("_back")
    return mine.join(rows.select(F.col("id").alias("memory_id")), "memory_id", "left_anti").select(*entries.columns)


def restore(entries: DataFrame, rows: DataFrame, ids: DataFrame, collection: str) -> tuple[DataFrame, DataFrame]:
    """(rows, entries): each named row's newest snapshot comes back and its entry goes, and
    no other, whatever else has its time; rows that live are left alone."""
    named = ids.select(F.col("id").alias("memory_id")).distinct().join(rows.select(F.col("id").alias("memory_id")), "memory_id", "left_anti")
    met = _newest(entries, collection).join(named.withColumn("_named", F.lit(True)), "memory_id", "left")
    met = met.withColumn("_back", F.col("_back") & F.coalesce("_named", F.lit(False))).drop("_named")
    back = met.where("_back").select("memory.*").select(*rows.columns)
    return rows.unionByName(back), met.where("NOT _back").select(*entries.columns)


def purge(entries: DataFrame, collection: str, ids: DataFrame | None = None) -> DataFrame:
    """Entries without the collection's, or without those of the named rows."""
    if ids is None:
        return entries.where(~_visible(collection))
    named = entries.join(ids.select(F.col("id").alias("memory_id"), F.lit(True).alias("_hit")).distinct(), "memory_id", "left")
    return named.where(~(_visible(collection) & F.coalesce("_hit", F.lit(False)))).select(*entries.columns)


def unneeded(entries: DataFrame, verdicts: DataFrame, collection: str) -> DataFrame:
    """Entries without the collection's of rows that an undone forget has brought back."""
    return purge(entries, collection, verdicts.where("undone AND op = 'forget'").select("id"))


def purge_expired(entries: DataFrame, collection: str, ttl_days: float, now: float) -> DataFrame:
    """Entries without the collection's that are older than ``ttl_days``; 0 keeps all."""
    if ttl_days <= 0:
        return entries
    return entries.where(~(_visible(collection) & (F.col("deleted_at") < now - ttl_days * 86_400)))

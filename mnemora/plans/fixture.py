"""Deterministic relations derived from the driver's tables, in both dialects.

``memories``, ``edges``, ``queries``, ``journal`` and ``trash`` exercise every operator;
``DUCK`` has the same definitions as common table expressions for the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

NOW = 1_700_000_000.0
RELS = ["related", "refines", "derived_from", "example_of", "contradicts", "supersedes"]
TYPES = ["semantic", "episodic", "procedural", "feedback"]
OPS = {"signup": "remember", "purchase": "edit", "view": "link", "click": "unlink", "error": "forget"}
#: The moment in the journal that time travel goes to.
THEN = 1_705_500_000_000_000


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sizes(spark: SparkSession, d: str) -> tuple[int, int]:
    """Rows of documents and of embeddings, from their footers."""
    return read(spark, d, "documents").count(), read(spark, d, "embeddings").count()


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")


def _pick(xs: list, k: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in xs]), k.cast("int"))


def name_of(i: Column) -> Column:
    return F.concat(F.lit("m"), F.lpad(i.cast("string"), 8, "0"))


def memories(spark: SparkSession, d: str, n: int, e: int) -> DataFrame:
    """One row per document; n and e are the tables' sizes."""
    i = F.col("doc_id")
    some = lambda cond, x: F.when(cond, F.array(F.lit(x))).otherwise(F.array().cast("array<string>"))
    expires = F.when(i % 19 == 0, 1699990000.0).when(i % 29 == 0, 1800000000.0).otherwise(0.0)
    base = read(spark, d, "documents").select(
        name_of(i).alias("id"),
        F.trim("text").alias("text"),
        _pick(TYPES, i % 4).alias("type"),
        F.when(i % 31 == 0, F.array().cast("array<string>")).otherwise(F.concat(F.array("lang", "source"), some(i % 3 == 0, "hot"), some(i % 50 == 0, "level:1"))).alias("tags"),
        (((i * 37) % 101).cast("double") / 100.0).alias("importance"),
        (F.lit(NOW) - (i % 120) * 86400).alias("created_at"),
        (F.lit(NOW) - (i % 90) * 43200).alias("last_accessed"),
        (i % 17).alias("access_count"),
        "source",
        (i % 3 - 1).cast("int").alias("polarity"),
        (i % 41 == 0).alias("pinned"),
        F.when(i % 23 == 0, name_of((i + 1) % n)).otherwise("").alias("superseded_by"),
        expires.alias("expires_at"),
        _pick(S.TRUST, i % 3).alias("trust"),
        F.when(i % 37 == 0, 1710000000.0).when(i % 5 == 0, 1690000000.0).otherwise(0.0).alias("valid_from"),
        F.when((i % 10 == 0) & (i % 37 != 0), 1699000000.0).otherwise(0.0).alias("valid_until"),
        (i % e).alias("vec_id"),
        i.alias("i"),
    )
    return base.withColumn("content_hash", S.content_hash(F.col("text")))


def edges(spark: SparkSession, d: str, n: int) -> DataFrame:
    i = F.col("doc_id")
    to = name_of((i * 7 + 1) % n)
    own = F.when(i % 5 == 0, F.array(F.struct(to.alias("dst"), _pick(RELS, i % 6).alias("rel"))))
    more = F.when(i % 15 == 0, F.array(F.struct(to.alias("dst"), F.lit("refines").alias("rel"))))
    lost = F.when(i % 70 == 0, F.array(F.struct(F.lit("m99999999").alias("dst"), F.lit("related").alias("rel"))))
    none = F.array().cast("array<struct<dst:string,rel:string>>")
    every = F.concat(*(F.coalesce(x, none) for x in (own, more, lost)))
    docs = read(spark, d, "documents").select("doc_id")
    return docs.select(name_of(i).alias("src"), F.explode(every).alias("e")).select("src", "e.dst", "e.rel").where("src <> dst").distinct()


def queries(spark: SparkSession, d: str, e: int) -> DataFrame:
    b = read(spark, d, "benchmark").select("item_id", "text").withColumn("vec_id", (F.col("item_id") * 13) % e)
    return b.join(vectors(spark, d), "vec_id").select(F.col("item_id").alias("qid"), F.col("text").alias("qtext"), F.col("x").alias("qx"), "vec_id", "label")


def journal(spark: SparkSession, d: str) -> DataFrame:
    """seq, us, op, id, dst_id, rel, text: events as an append-only log."""
    op = F.element_at(F.create_map(*[F.lit(x) for kv in OPS.items() for x in kv]), F.col("event_type"))
    seq = F.col("event_id")
    return read(spark, d, "events").select(
        seq.alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"),
        op.alias("op"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"),
        F.concat(F.lit("u"), ((seq * 7) % 40).cast("string")).alias("dst_id"),
        _pick(RELS, seq % 6).alias("rel"),
        F.concat(F.lit("text "), seq.cast("string")).alias("text"),
    )


def trash(spark: SparkSession, d: str) -> DataFrame:
    """Entries of forgotten rows, of three collections, one of them the nameless old one."""
    gone = journal(spark, d).where("op = 'forget'")
    return gone.select(
        F.col("id").alias("memory_id"),
        (F.col("us") / 1e6).alias("deleted_at"),
        F.lit("someone").alias("actor"),
        _pick(["", "main", "other"], F.col("seq") % 3).alias("collection"),
        F.struct("id", "text").alias("memory"),
    )


DUCK = """
WITH RECURSIVE nn AS (SELECT count(*) AS n FROM documents), ee AS (SELECT count(*) AS e FROM embeddings),
v AS (SELECT vec_id, embedding::DOUBLE[] AS x, label FROM embeddings),
m AS (
  SELECT 'm' || lpad(doc_id::VARCHAR, 8, '0') AS id, trim(text) AS text,
    ['semantic','episodic','procedural','feedback'][doc_id % 4 + 1] AS type,
    CASE WHEN doc_id % 31 = 0 THEN []::VARCHAR[] ELSE list_concat(list_concat([lang, source], CASE WHEN doc_id % 3 = 0 THEN ['hot'] ELSE []::VARCHAR[] END),
      CASE WHEN doc_id % 50 = 0 THEN ['level:1'] ELSE []::VARCHAR[] END) END AS tags,
    ((doc_id * 37) % 101)::DOUBLE / 100::DOUBLE AS importance,
    1700000000::DOUBLE - (doc_id % 120) * 86400 AS created_at, 1700000000::DOUBLE - (doc_id % 90) * 43200 AS last_accessed,
    doc_id % 17 AS access_count, source, (doc_id % 3 - 1)::INT AS polarity, doc_id % 41 = 0 AS pinned,
    CASE WHEN doc_id % 23 = 0 THEN 'm' || lpad(((doc_id + 1) % n)::VARCHAR, 8, '0') ELSE '' END AS superseded_by,
    CASE WHEN doc_id % 19 = 0 THEN 1699990000::DOUBLE WHEN doc_id % 29 = 0 THEN 1800000000::DOUBLE ELSE 0::DOUBLE END AS expires_at,
    ['trusted','reported','untrusted'][doc_id % 3 + 1] AS trust,
    CASE WHEN doc_id % 37 = 0 THEN 1710000000::DOUBLE WHEN doc_id % 5 = 0 THEN 1690000000::DOUBLE ELSE 0::DOUBLE END AS valid_from,
    CASE WHEN doc_id % 10 = 0 AND doc_id % 37 <> 0 THEN 1699000000::DOUBLE ELSE 0::DOUBLE END AS valid_until,
    doc_id % e AS vec_id, doc_id AS i,
    substr(sha256(trim(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g'))), 1, 32) AS content_hash
  FROM documents, nn, ee),
ed AS (
  SELECT DISTINCT src, dst, rel FROM (
    SELECT 'm' || lpad(doc_id::VARCHAR, 8, '0') AS src, 'm' || lpad(((doc_id * 7 + 1) % n)::VARCHAR, 8, '0') AS dst,
      ['related','refines','derived_from','example_of','contradicts','supersedes'][doc_id % 6 + 1] AS rel
    FROM documents, nn WHERE doc_id % 5 = 0
    UNION ALL SELECT 'm' || lpad(doc_id::VARCHAR, 8, '0'), 'm' || lpad(((doc_id * 7 + 1) % n)::VARCHAR, 8, '0'), 'refines'
    FROM documents, nn WHERE doc_id % 15 = 0
    UNION ALL SELECT 'm' || lpad(doc_id::VARCHAR, 8, '0'), 'm99999999', 'related' FROM documents WHERE doc_id % 70 = 0)
  WHERE src <> dst),
q AS (
  SELECT item_id AS qid, text AS qtext, x AS qx, v.vec_id, label
  FROM benchmark, ee JOIN v ON v.vec_id = (item_id * 13) % e),
jl AS (
  SELECT event_id AS seq, epoch_us(ts)::DOUBLE AS us,
    CASE event_type WHEN 'signup' THEN 'remember' WHEN 'purchase' THEN 'edit' WHEN 'view' THEN 'link'
      WHEN 'click' THEN 'unlink' WHEN 'error' THEN 'forget' END AS op,
    'u' || user_id AS id, 'u' || ((event_id * 7) % 40) AS dst_id,
    ['related','refines','derived_from','example_of','contradicts','supersedes'][event_id % 6 + 1] AS rel,
    'text ' || event_id AS text
  FROM events),
tr AS (
  SELECT id AS memory_id, us / 1e6::DOUBLE AS deleted_at, ['', 'main', 'other'][seq % 3 + 1] AS collection, text
  FROM jl WHERE op = 'forget')
"""

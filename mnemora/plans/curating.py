"""Tags, merges, archives, collections and the trash."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import archive as A
from ..operators import curation as U
from ..operators import trash as B
from ..sources import files
from .base import RANK, TRUSTS, Tables, joined, query, strings
from .fixture import NOW, name_of


def renamed_sql(old: str, new: str) -> str:
    return f"""SELECT id, array_to_string(list_transform(list_filter(list_zip(tags2, range(1, len(tags2) + 1)),
      lambda z: list_position(tags2, z[1]) = z[2]), lambda z: z[1]), ',') AS tags
    FROM (SELECT id, list_transform(tags, lambda x: CASE WHEN x IN ({old}) THEN '{new}' ELSE x END) AS tags2 FROM m WHERE list_has_any(tags, [{old}]))"""


@query("rename_tag", renamed_sql("'hot'", "warm"))
def rename_tag(t: Tables):
    return U.rename_tags(t.m, ["hot"], "warm").select("id", joined("tags").alias("tags"))


@query("merge_tags", renamed_sql("'de', 'fr', 'level:1'", "hot"))
def merge_tags(t: Tables):
    """Several tags into one that some rows have already: it stays where it came first."""
    return U.rename_tags(t.m, ["de", "fr", "level:1"], "hot").select("id", joined("tags").alias("tags"))


@query("delete_tag", "SELECT id, array_to_string(list_filter(tags, lambda x: x <> 'hot'), ',') AS tags FROM m WHERE list_contains(tags, 'hot')")
def delete_tag(t: Tables):
    return t.m.where(F.array_contains("tags", "hot")).select("id", joined(F.array_remove("tags", "hot")).alias("tags"))


TO = "CASE WHEN dst = 'm00000036' THEN 'm00000001' ELSE dst END"


@query("repoint_incoming", f"SELECT DISTINCT src, {TO} AS dst, rel FROM ed WHERE src <> {TO}")
def repoint_incoming(t: Tables):
    return U.repoint(t.e, "m00000036", "m00000001")


@query("union_tags", "SELECT source, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags FROM m GROUP BY source")
def union_tags(t: Tables):
    tags = t.m.select("source", F.explode("tags").alias("x"))
    return tags.groupBy("source").agg(joined(F.sort_array(F.collect_set("x"))).alias("tags"))


def _pairs(t: Tables):
    """Every even row takes in the one after it."""
    return t.m.where("i % 2 = 0").select(F.col("id").alias("target"), name_of(F.col("i") + 1).alias("other"))


MERGED = "a.text || coalesce(chr(10) || chr(10) || b.text, '')"


@query(
    "merge",
    f"""SELECT a.id, {MERGED} AS text, {TRUSTS}[greatest({RANK.format("a.trust")}, coalesce({RANK.format("b.trust")}, 0)) + 1] AS trust,
    a.pinned OR coalesce(b.pinned, FALSE) AS pinned, substr(sha256(trim(regexp_replace(lower({MERGED}), '\\s+', ' ', 'g'))), 1, 32) AS content_hash
    FROM m a LEFT JOIN m b ON b.i = a.i + 1 WHERE a.i % 2 = 0""",
)
def merge(t: Tables):
    rows, _ = U.merge(t.m, t.e, _pairs(t))
    return rows.select("id", "text", "trust", "pinned", "content_hash")


@query(
    "merge_links",
    """,
    f AS (SELECT 'm' || lpad(i::VARCHAR, 8, '0') AS id, 'm' || lpad((i - i % 2)::VARCHAR, 8, '0') AS target, i FROM m),
    mv AS (SELECT coalesce(a.target, src) AS src, coalesce(b.target, dst) AS dst, rel,
        src <> coalesce(a.target, src) OR dst <> coalesce(b.target, dst) AS changed, src <> coalesce(a.target, src) AND b.id IS NULL AS lost
      FROM ed LEFT JOIN f a ON a.id = src LEFT JOIN f b ON b.id = dst)
    SELECT DISTINCT src, dst, rel FROM mv WHERE NOT lost AND (NOT changed OR src <> dst)""",
)
def merge_links(t: Tables):
    return U.merge(t.m, t.e, _pairs(t))[1]


# --- archives ------------------------------------------------------------------------------

EXPORTED = "type IN ('semantic', 'feedback') AND list_has_any(tags, ['hot', 'en']) AND superseded_by = ''"


@query("archive_export", f"SELECT row_number() OVER (ORDER BY created_at, id) AS line, id FROM m WHERE {EXPORTED}")
def archive_export(t: Tables):
    return A.numbered(A.exported(t.m, ["semantic", "feedback"], ["hot", "en"]), "created_at", "id").select("line", "id")


def _archive(t: Tables) -> str:
    """An archive of what is exported, with its header, as a file."""
    rows = A.exported(t.m, ["semantic", "feedback"], ["hot", "en"])
    meta = F.to_json(F.struct("type", "importance", "created_at", "superseded_by"))
    lines = rows.select(F.to_json(F.struct("id", "text", meta.alias("meta"))).alias("value"))
    head = '{"format": "%s", "version": %d, "source": {"embedding_model": "hash", "embedding_dim": 64}}' % (files.FORMAT, files.VERSION)
    return t.file(t.spark.createDataFrame([(head,), ("{cut short",)], "value string").unionAll(lines), gz=True)


@query("archive_info", f"SELECT 'memory-archive' AS format, 1 AS version, 'hash' AS model, 64 AS dim, true AS usable, false AS same_model, count(*) AS rows FROM m WHERE {EXPORTED}")
def archive_info(t: Tables):
    return files.archive_info(t.spark, _archive(t), "another")


@query("archive_read", f"SELECT id, text, type FROM m WHERE {EXPORTED}")
def archive_read(t: Tables):
    """What is written comes back, without the header and the line that was cut short."""
    return files.read_archive(t.spark, _archive(t)).select("id", "text", F.get_json_object("meta", "$.type").alias("type"))


INCOMING = "SELECT CASE WHEN i % 3 = 0 THEN id ELSE 'x' || id END AS id, superseded_by, i FROM m WHERE i % 2 = 0"


def _incoming(t: Tables):
    """Every other row, two thirds of them under ids that aren't there yet."""
    new = F.when(F.col("i") % 3 == 0, F.col("id")).otherwise(F.concat(F.lit("x"), "id"))
    return t.m.where("i % 2 = 0").withColumn("id", new)


IMPORT = "SELECT a.id, CASE WHEN m.id IS NULL THEN 'add' ELSE '{0}' END AS action FROM (" + INCOMING + ") a LEFT JOIN m ON m.id = a.id"
for policy, action in (("skip", "skip"), ("overwrite", "replace"), ("rename", "rename")):
    query(f"archive_import_{policy}", IMPORT.format(action))(lambda t, policy=policy: A.import_actions(_incoming(t).select("id"), t.m, policy))


@query("join_import_collision", f"SELECT a.id IN (SELECT id FROM m) AS there, count(*) AS n FROM ({INCOMING}) a GROUP BY ALL")
def join_import_collision(t: Tables):
    met = _incoming(t).select("id").join(t.m.select("id", F.lit(True).alias("hit")), "id", "left")
    return met.groupBy(F.coalesce("hit", F.lit(False)).alias("there")).agg(F.count("*").alias("n"))


NEW = "'n' || substr(sha256('a/' || {0}), 1, 31)"
RENAMED = f""",
ic AS ({INCOMING}),
rn AS (SELECT id, {NEW.format("id")} AS new FROM ic WHERE id IN (SELECT id FROM m))"""


@query(
    "archive_import",
    RENAMED
    + """ SELECT id, superseded_by FROM m
    UNION ALL SELECT coalesce(r.new, ic.id), coalesce(s.new, ic.superseded_by) FROM ic LEFT JOIN rn r ON r.id = ic.id LEFT JOIN rn s ON s.id = ic.superseded_by""",
)
def archive_import(t: Tables):
    """Under the policy that renames: all rows afterwards, and what they are superseded by."""
    rows, _, _ = A.imported(_incoming(t), t.e, t.m, t.e, "rename", "a")
    return rows.select("id", "superseded_by")


@query(
    "archive_remap_refs",
    RENAMED
    + """ SELECT src, dst, rel FROM ed
    UNION SELECT coalesce(a.new, src), coalesce(b.new, dst), rel FROM ed JOIN ic ON ic.id = src LEFT JOIN rn a ON a.id = src LEFT JOIN rn b ON b.id = dst""",
)
def archive_remap_refs(t: Tables):
    return A.imported(_incoming(t), t.e, t.m, t.e, "rename", "a")[1]


@query("archive_dry_run", f"SELECT CASE WHEN m.id IS NULL THEN 'add' ELSE 'skip' END AS action, count(*) AS n FROM ({INCOMING}) a LEFT JOIN m ON m.id = a.id GROUP BY ALL")
def archive_dry_run(t: Tables):
    rows, _, summary = A.imported(_incoming(t), t.e, t.m, t.e, "skip", dry_run=True)
    if rows is not t.m:
        raise AssertionError("a dry run changed the rows")
    return summary


# --- collections ---------------------------------------------------------------------------


def _named(t: Tables):
    return t.m.withColumn("collection", F.when(F.col("i") % 10 == 0, "both").otherwise(F.col("source")))


CO = ", co AS (SELECT *, CASE WHEN i % 10 = 0 THEN 'both' ELSE source END AS collection FROM m)"


@query(
    "collections_copy",
    CO
    + """ SELECT id, collection FROM co
    UNION SELECT id, 'src2' FROM co WHERE collection = 'both'""",
)
def collections_copy(t: Tables):
    return A.copied(_named(t), "both", "src2").select("id", "collection")


def _names(t: Tables):
    return _named(t).select(F.col("collection").alias("name")).distinct()


@query("collections_create", CO + " SELECT DISTINCT collection AS name FROM co UNION ALL SELECT 'fresh'")
def collections_create(t: Tables):
    return A.created(_names(t), "fresh")


@query("collections_delete", CO + " SELECT collection AS name, count(*) AS n, collection = 'src0' AS active FROM co WHERE collection <> 'both' GROUP BY collection")
def collections_delete(t: Tables):
    return A.listed(*A.deleted(_named(t), _names(t), "both", "src0"), "src0")


# --- trash -----------------------------------------------------------------------------------

SEEN = "collection IN ('', 'main')"


@query("trash", "SELECT id AS memory_id, 'main' AS collection, text FROM m WHERE i % 13 = 0")
def trash(t: Tables):
    """Every thirteenth row leaves whole."""
    _, entries = B.trash(t.m, t.m.where("i % 13 = 0"), NOW, "someone", "main")
    return entries.select("memory_id", "collection", "memory.text")


@query("trash_rows", "SELECT id FROM m WHERE i % 13 <> 0")
def trash_rows(t: Tables):
    return B.trash(t.m, t.m.where("i % 13 = 0"), NOW)[0].select("id")


@query("trash_list", f"SELECT memory_id, deleted_at, collection FROM tr WHERE {SEEN}")
def trash_list(t: Tables):
    return B.listed(t.t, "main").select("memory_id", "deleted_at", "collection")


LAST = """,
li AS (SELECT DISTINCT id FROM jl WHERE op = 'remember' AND seq % 5 = 0),
nw AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY deleted_at DESC) AS r FROM tr WHERE collection IN ('', 'main')),
bk AS (SELECT * FROM nw WHERE r = 1 AND memory_id NOT IN (SELECT id FROM li))"""


def _live(t: Tables):
    return t.j.where("op = 'remember' AND seq % 5 = 0").select("id").distinct().withColumn("text", F.lit("live"))


@query("trash_restore", LAST + " SELECT id, 'live' AS text FROM li UNION ALL SELECT memory_id, text FROM bk")
def trash_restore(t: Tables):
    """All that can come back does, its newest snapshot each, beside what lives."""
    every = t.t.select(F.col("memory_id").alias("id")).distinct()
    return B.restore(t.t, _live(t), every, "main")[0]


@query("trash_left", LAST + " SELECT memory_id, deleted_at FROM tr WHERE NOT EXISTS (SELECT 1 FROM bk WHERE bk.memory_id = tr.memory_id AND bk.deleted_at = tr.deleted_at)")
def trash_left(t: Tables):
    every = t.t.select(F.col("memory_id").alias("id")).distinct()
    return B.restore(t.t, _live(t), every, "main")[1].select("memory_id", "deleted_at")


@query("trash_purge", f"SELECT memory_id, deleted_at, collection FROM tr WHERE NOT ({SEEN} AND memory_id IN ('u1', 'u2', 'u3', 'u4'))")
def trash_purge(t: Tables):
    return B.purge(t.t, "main", strings(t.spark, "u1", "u2", "u3", "u4")).select("memory_id", "deleted_at", "collection")


@query("trash_purge_expired", f"SELECT memory_id, deleted_at, collection FROM tr WHERE NOT ({SEEN} AND deleted_at < 1705500000 - 5 * 86400)")
def trash_purge_expired(t: Tables):
    return B.purge_expired(t.t, "main", 5, 1705500000.0).select("memory_id", "deleted_at", "collection")


@query("trash_read", "SELECT memory_id, collection, text FROM tr")
def trash_read(t: Tables):
    """Written and read back; a line that was cut short is passed over."""
    lines = t.t.select(F.to_json(F.struct("memory_id", "deleted_at", "actor", F.to_json("memory").alias("memory"), "collection")).alias("value"))
    path = t.file(lines.unionAll(t.spark.createDataFrame([('{"memory_id": "u1", "dele',)], "value string")), gz=True)
    return files.read_trash(t.spark, path).select("memory_id", "collection", F.get_json_object("memory", "$.text").alias("text"))

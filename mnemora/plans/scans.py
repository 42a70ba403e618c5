"""Scans, predicates and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import archive as A
from ..operators import metric
from ..operators import recall as R
from ..scratch import Scratch
from .base import ACTIVE, CURRENT, LIVE, Tables, cos, joined, pool_sql, query, r6, strings
from .fixture import NOW


@query("scan_all", "SELECT id, text, type, array_to_string(tags, ',') AS tags, importance, created_at, content_hash FROM m")
def scan_all(t: Tables):
    return t.m.select("id", "text", "type", joined("tags").alias("tags"), "importance", "created_at", "content_hash")


@query("scan_with_vectors", "SELECT id, len(x)::BIGINT AS dim, round(list_dot_product(x, x), 6) AS norm2 FROM m JOIN v USING (vec_id)")
def scan_with_vectors(t: Tables):
    return t.embedded().select("id", F.size("x").cast("long").alias("dim"), r6(S.dot(F.col("x"), F.col("x"))).alias("norm2"))


@query("point_get", "SELECT id, type, superseded_by, expires_at FROM m WHERE id = 'm00000023'")
def point_get(t: Tables):
    return t.m.where("id = 'm00000023'").select("id", "type", "superseded_by", "expires_at")


@query("get_by_ids", "SELECT id, vec_id FROM m WHERE id IN ('m00000001', 'm00000500', 'm77777777')")
def get_by_ids(t: Tables):
    return t.m.join(strings(t.spark, "m00000001", "m00000500", "m77777777"), "id", "left_semi").select("id", "vec_id")


OUTCOME = "CASE count(*) WHEN 0 THEN 'none' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS outcome"


@query("prefix_resolve", f"SELECT count(*) AS matches, {OUTCOME}, min(id) AS first_id FROM m WHERE starts_with(id, 'm0000001')")
def prefix_resolve(t: Tables):
    n = F.count("*")
    outcome = F.when(n == 0, "none").when(n == 1, "unique").otherwise("ambiguous")
    return t.m.where(F.col("id").startswith("m0000001")).agg(n.alias("matches"), outcome.alias("outcome"), F.min("id").alias("first_id"))


@query("scan_recent_keyset", f"SELECT id, created_at FROM m WHERE {ACTIVE} AND created_at < 1699500000 ORDER BY created_at DESC, id LIMIT 50")
def scan_recent_keyset(t: Tables):
    return t.m.where(R.live(NOW) & (F.col("created_at") < 1699500000.0)).orderBy(F.desc("created_at"), "id").limit(50).select("id", "created_at")


@query(
    "list_filtered",
    f"""SELECT id, importance FROM m
    WHERE type = 'semantic' AND list_contains(tags, 'hot') AND created_at >= 1690000000 AND {ACTIVE}
    ORDER BY importance DESC, id LIMIT 20""",
)
def list_filtered(t: Tables):
    rows = t.m.where((F.col("type") == "semantic") & (F.col("created_at") >= 1690000000.0) & R.live(NOW, tag="hot"))
    return rows.orderBy(F.desc("importance"), "id").limit(20).select("id", "importance")


@query("metadata_eq_scan", "SELECT id, type FROM m WHERE pinned AND type = 'episodic'")
def metadata_eq_scan(t: Tables):
    return t.m.where("pinned AND type = 'episodic'").select("id", "type")


@query("metadata_range_scan", "SELECT id, expires_at FROM m WHERE expires_at > 0 AND expires_at <= 1700000000")
def metadata_range_scan(t: Tables):
    return t.m.where(f"expires_at > 0 AND expires_at <= {NOW}D").select("id", "expires_at")


@query("content_contains_scan", "SELECT id FROM m WHERE contains(text, 'tion the') ORDER BY id LIMIT 100")
def content_contains_scan(t: Tables):
    return t.m.where(F.col("text").contains("tion the")).select("id").orderBy("id").limit(100)


@query("vector_query", pool_sql(20, "type = 'semantic'") + " SELECT qid, id, pool_pos, round(cosine, 6) AS cosine FROM pool")
def vector_query(t: Tables):
    return t.pool(20, "type = 'semantic'").select("qid", "id", F.col("pool_pos").cast("long").alias("pool_pos"), r6("cosine").alias("cosine"))


@query(
    "join_query_memory",
    f""" SELECT qid, count(*) AS n, round(max(c), 6) AS best
    FROM (SELECT qid, {cos("qx", "x")} AS c FROM q, m JOIN v ON v.vec_id = m.vec_id) WHERE c >= 0.2::DOUBLE GROUP BY qid""",
)
def join_query_memory(t: Tables):
    """How many rows are at least that near to each query, and how near the nearest is."""
    return R.within(t.m, t.v, t.q, 0.2).withColumn("best", r6("best"))


@query(
    "vector_query_index",
    f""" SELECT qid, vec_id, round(c, 6) AS cosine, rank::INT AS rank FROM (
      SELECT qid, v.vec_id, {cos("qx", "x")} AS c, row_number() OVER (PARTITION BY qid ORDER BY {cos("qx", "x")} DESC, v.vec_id) AS rank FROM q, v) WHERE rank <= 10""",
)
def vector_query_index(t: Tables):
    """The ten nearest vectors of each query by an index of cells, built for the call."""
    index = metric.build_index(t.v, f"{Scratch(t.spark).root}/index", 64)
    return metric.nearest(t.spark, index, t.q, 10)[0].withColumn("cosine", r6("cosine"))


@query("pool_position", pool_sql(10, "pinned") + " SELECT qid, id, pool_pos FROM pool")
def pool_position(t: Tables):
    return t.pool(10, "pinned").select("qid", "id", F.col("pool_pos").cast("long").alias("pool_pos"))


WHERE = "type = 'semantic' AND importance >= 0.3::DOUBLE AND source = 'src0' AND created_at >= 1690000000 AND created_at <= 1699900000"
VALID = "(valid_from = 0 OR valid_from <= {0}) AND (valid_until = 0 OR {0} < valid_until)"
for name, cond, sql in (
    (
        "filter_where",
        lambda: (F.col("type") == "semantic") & (F.col("importance") >= 0.3) & (F.col("source") == "src0") & F.col("created_at").between(1690000000.0, 1699900000.0),
        WHERE,
    ),
    ("filter_tag", lambda: F.array_contains("tags", "hot"), "list_contains(tags, 'hot')"),
    ("filter_superseded", lambda: F.col("superseded_by") == "", "superseded_by = ''"),
    ("filter_expired", lambda: (F.col("expires_at") == 0) | (F.col("expires_at") > NOW), LIVE),
    ("filter_min_trust", lambda: S.trust_rank(F.col("trust")) <= 1, "trust IN ('trusted', 'reported', '')"),
    (
        "filter_valid_at",
        lambda: S.is_valid_at(F.col("valid_from"), F.col("valid_until"), F.lit(1698000000.0)),
        VALID.format(1698000000),
    ),
    (
        "filter_eligible",
        lambda: R.eligible(NOW, min_trust="reported", tag="hot"),
        f"list_contains(tags, 'hot') AND {CURRENT} AND trust <> 'untrusted'",
    ),
    ("filter_as_of", lambda: R.eligible(NOW, valid_at=1699500000.0), f"{LIVE} AND {VALID.format(1699500000)}"),
    (
        "set_overlap",
        lambda: F.arrays_overlap("tags", F.array(F.lit("src1"), F.lit("de"))),
        "list_has_any(tags, ['src1', 'de'])",
    ),
):
    query(name, f"SELECT id FROM m WHERE {sql}")(lambda t, cond=cond: t.m.where(cond()).select("id"))


@query(
    "export_filter",
    """SELECT id FROM m WHERE type IN ('semantic', 'feedback') AND list_has_any(tags, ['hot', 'en'])
    AND created_at >= 1695000000 AND superseded_by = ''""",
)
def export_filter(t: Tables):
    return A.exported(t.m, ["semantic", "feedback"], ["hot", "en"], 1695000000.0).select("id")


@query("filter_min_cosine", pool_sql() + " SELECT qid, id FROM pool WHERE cosine >= 0.2")
def filter_min_cosine(t: Tables):
    return t.pool(20).where("cosine >= 0.2").select("qid", "id")


@query(
    "hit_projection",
    pool_sql(5)
    + """ SELECT qid, m.id, round(cosine, 4) AS score, nullif(superseded_by, '') AS superseded_by, nullif(expires_at, 0) AS expires_at
    FROM pool JOIN m ON m.id = pool.id""",
)
def hit_projection(t: Tables):
    gone = F.nullif("superseded_by", F.lit("")).alias("superseded_by")
    return t.pool(5).join(t.m, "id").select("qid", "id", F.round("cosine", 4).alias("score"), gone, F.nullif("expires_at", F.lit(0.0)).alias("expires_at"))


@query("except", "SELECT id FROM m WHERE id NOT IN (SELECT src FROM ed) AND id NOT IN (SELECT dst FROM ed)")
def except_(t: Tables):
    """Rows that no link touches."""
    ends = t.e.select(F.col("src").alias("id")).union(t.e.select(F.col("dst").alias("id")))
    return t.m.select("id").join(ends, "id", "left_anti")


@query(
    "intersect",
    """SELECT a.id, array_to_string(list_sort(list_intersect(a.tags, b.tags)), ',') AS both
    FROM m a JOIN m b ON b.i = a.i + 1""",
)
def intersect(t: Tables):
    next_ = t.m.select((F.col("i") - 1).alias("i"), F.col("tags").alias("other"))
    return t.m.join(next_, "i").select("id", joined(F.sort_array(F.array_intersect("tags", "other"))).alias("both"))

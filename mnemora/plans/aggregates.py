"""Aggregates and ranks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import archive as A
from ..operators import conflicts as C
from ..operators import log as L
from ..operators import recall as R
from .base import ACTIVE, DECAY, LEXICAL, LIVE, RANK, SIGNALS, TRUSTS, Tables, decay, hybrid, pool_sql, query, r6, strings
from .fixture import NOW


@query("agg_count", "SELECT count(*) AS n FROM m")
def agg_count(t: Tables):
    return t.m.agg(F.count("*").alias("n"))


@query(
    "agg_stats",
    f"""SELECT count(*) AS total, count(*) FILTER (superseded_by = '') AS active, count(*) FILTER (superseded_by <> '') AS superseded,
    count(*) FILTER (type = 'semantic') AS semantic, count(*) FILTER (type = 'episodic') AS episodic,
    count(*) FILTER (type = 'procedural') AS procedural, count(*) FILTER (type = 'feedback') AS feedback FROM m WHERE {LIVE}""",
)
def agg_stats(t: Tables):
    kinds = [F.count_if(F.col("type") == k).alias(k) for k in ("semantic", "episodic", "procedural", "feedback")]
    gone = F.col("superseded_by") != ""
    return t.m.where(R.live(NOW, superseded=True)).agg(F.count("*").alias("total"), F.count_if(~gone).alias("active"), F.count_if(gone).alias("superseded"), *kinds)


@query("agg_list_tags", "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM m WHERE superseded_by = '') GROUP BY tag")
def agg_list_tags(t: Tables):
    return t.m.where("superseded_by = ''").select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("agg_top_tags", f"SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM m WHERE {ACTIVE}) GROUP BY tag ORDER BY n DESC, tag LIMIT 15")
def agg_top_tags(t: Tables):
    tags = t.m.where(R.live(NOW)).select(F.explode("tags").alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(15)


@query("agg_decay_histogram", f"SELECT least(4, floor({DECAY} * 5))::INT AS band, count(*) AS n FROM m WHERE {ACTIVE} GROUP BY band")
def agg_decay_histogram(t: Tables):
    band = F.least(F.lit(4), F.floor(decay() * 5)).cast("int").alias("band")
    return t.m.where(R.live(NOW)).groupBy(band).agg(F.count("*").alias("n"))


@query(
    "agg_health",
    f"""SELECT count(*) FILTER ({DECAY} < 0.05::DOUBLE AND type <> 'procedural') AS at_risk, count(*) FILTER (access_count = 0) AS never_recalled,
    count(*) FILTER (last_accessed < 1700000000 - 30 * 86400) AS stale, count(*) FILTER (type = 'episodic') AS episodic,
    round(avg(importance), 3) AS avg_importance, coalesce(sum(n), 0)::BIGINT AS links, round(coalesce(sum(n), 0) / count(*), 3) AS link_density
    FROM m LEFT JOIN (SELECT src, count(*) AS n FROM ed GROUP BY src) l ON l.src = id WHERE {ACTIVE}""",
)
def agg_health(t: Tables):
    links = t.e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return t.m.where(R.live(NOW)).join(links, "id", "left").agg(
        F.count_if((decay() < 0.05) & (F.col("type") != "procedural")).alias("at_risk"),
        F.count_if(F.col("access_count") == 0).alias("never_recalled"),
        F.count_if(F.col("last_accessed") < NOW - 30 * S.DAY).alias("stale"),
        F.count_if(F.col("type") == "episodic").alias("episodic"),
        F.round(F.avg("importance"), 3).alias("avg_importance"),
        total.alias("links"),
        F.round(total / F.count("*"), 3).alias("link_density"),
    )


@query("agg_top_recalled", f"SELECT id, access_count FROM m WHERE {ACTIVE} AND access_count > 0 ORDER BY access_count DESC, id LIMIT 5")
def agg_top_recalled(t: Tables):
    return t.m.where(R.live(NOW) & (F.col("access_count") > 0)).orderBy(F.desc("access_count"), "id").limit(5).select("id", "access_count")


@query("agg_worst_trust", f"SELECT source, {TRUSTS}[max({RANK.format('trust')}) + 1] AS trust FROM m GROUP BY source")
def agg_worst_trust(t: Tables):
    return t.m.groupBy("source").agg(S.trust_label(F.max(S.trust_rank(F.col("trust")))).alias("trust"))


def _words(t: Tables):
    return t.q.select("qid", F.explode(F.array_distinct(S.tokenize(F.col("qtext")))).alias("t"))


@query("agg_bm25_df", pool_sql() + LEXICAL + " SELECT qid, t, df::BIGINT AS df FROM dfr JOIN qt USING (qid, t)")
def agg_bm25_df(t: Tables):
    words = t.pool(20).join(t.m, "id").select("qid", F.explode(F.array_distinct(S.tokenize(F.col("text")))).alias("t"))
    return words.groupBy("qid", "t").agg(F.count("*").alias("df")).join(_words(t), ["qid", "t"])


@query("agg_term_freq", pool_sql() + LEXICAL + " SELECT qid, id, t, f::BIGINT AS f FROM tf JOIN qt USING (qid, t)")
def agg_term_freq(t: Tables):
    words = t.pool(20).join(t.m, "id").select("qid", "id", F.explode(S.tokenize(F.col("text"))).alias("t"))
    return words.groupBy("qid", "id", "t").agg(F.count("*").alias("f")).join(_words(t), ["qid", "t"])


@query(
    "agg_pool_max_norm",
    pool_sql() + LEXICAL + " SELECT qid, bool_or(matched) AS matched, round(max(lex), 6) AS most, count(*) FILTER (lex > 0) AS n FROM bm GROUP BY qid",
)
def agg_pool_max_norm(t: Tables):
    """Each pool's best lexical score is 1, or 0 where no row has a word of the query."""
    rows = R.bm25(t.pool(20).join(t.m, "id"), t.q)
    return rows.groupBy("qid").agg(F.bool_or("matched").alias("matched"), r6(F.max("lex")).alias("most"), F.count_if(F.col("lex") > 0).alias("n"))


@query(
    "agg_minmax_norm",
    pool_sql()
    + """ SELECT qid, id, round(CASE WHEN max(cosine) OVER w - min(cosine) OVER w <= 1e-12 THEN 1
      ELSE (cosine - min(cosine) OVER w) / (max(cosine) OVER w - min(cosine) OVER w) END, 6) AS norm FROM pool WINDOW w AS (PARTITION BY qid)""",
)
def agg_minmax_norm(t: Tables):
    w = Window.partitionBy("qid")
    low, span = F.min("cosine").over(w), F.max("cosine").over(w) - F.min("cosine").over(w)
    return t.pool(20).select("qid", "id", r6(F.when(span <= 1e-12, 1.0).otherwise((F.col("cosine") - low) / span)).alias("norm"))


@query("agg_fanout_max", pool_sql(10) + " SELECT id, round(max(cosine), 6) AS score FROM pool GROUP BY id")
def agg_fanout_max(t: Tables):
    return t.pool(10).groupBy("id").agg(r6(F.max("cosine")).alias("score"))


CLUSTERS = f""",
cl AS (SELECT m.*, min(id) OVER (PARTITION BY type, vec_id) AS leader FROM m)
SELECT leader, count(*) AS n, round(avg(importance), 3) AS importance, bool_or(pinned) AS pinned, {TRUSTS}[max({RANK.format('trust')}) + 1] AS trust,
  max(CASE WHEN list_contains(tags, 'level:1') THEN 1 ELSE 0 END) + 1 AS level
FROM cl GROUP BY leader"""


@query("agg_cluster_importance", CLUSTERS)
def agg_cluster_importance(t: Tables):
    """Of given clusters: rows of one type that share a vector, led by the first."""
    from ..operators import lifecycle as Y

    w = Window.partitionBy("type", "vec_id")
    clusters = t.m.select("id", F.min("id").over(w).alias("leader"), (F.row_number().over(w.orderBy("id")) - 1).cast("long").alias("pos"))
    sizes = clusters.groupBy("leader").agg(F.count("*").alias("n"))
    return Y.reflections(clusters, t.m, consolidate=True).join(sizes, "leader").select("leader", "n", "importance", "pinned", "trust", "level")


@query("agg_op_counters", "SELECT op, count(*) AS calls FROM jl GROUP BY op")
def agg_op_counters(t: Tables):
    return t.j.groupBy("op").agg(F.count("*").alias("calls"))


@query(
    "agg_metrics_latency",
    """,
    la AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events),
    s AS (SELECT event_type, list(value ORDER BY value) AS v FROM la WHERE r <= 1024 GROUP BY event_type)
    SELECT e.event_type, count(*) AS n, round(avg(value), 3) AS avg, round(max(value), 3) AS max,
      round(any_value(v[round_even(0.50::DOUBLE * (len(v) - 1), 0)::INT + 1]), 3) AS p50,
      round(any_value(v[round_even(0.95::DOUBLE * (len(v) - 1), 0)::INT + 1]), 3) AS p95,
      round(any_value(v[round_even(0.99::DOUBLE * (len(v) - 1), 0)::INT + 1]), 3) AS p99
    FROM events e JOIN s USING (event_type) GROUP BY e.event_type""",
)
def agg_metrics_latency(t: Tables):
    return L.latencies(t.read("events").select("event_type", "event_id", "value"), "event_type", "value", "event_id")


@query("collections_list", "SELECT source AS name, count(*) AS n, source = 'src0' AS active FROM m GROUP BY source UNION ALL SELECT 'empty', 0, false")
def collections_list(t: Tables):
    rows = t.m.withColumn("collection", F.col("source"))
    names = rows.select(F.col("collection").alias("name")).distinct().union(strings(t.spark, "empty"))
    return A.listed(rows, names, "src0")


RANKS = """,
rk AS (SELECT *,
    row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, pool_pos) - 1 AS rc, row_number() OVER (PARTITION BY qid ORDER BY lex DESC, pool_pos) - 1 AS rl,
    row_number() OVER (PARTITION BY qid ORDER BY rec DESC, pool_pos) - 1 AS rr, row_number() OVER (PARTITION BY qid ORDER BY importance DESC, pool_pos) - 1 AS ri
  FROM si)"""


@query("rank_by_signal", pool_sql() + LEXICAL + SIGNALS + RANKS + " SELECT qid, id, rc, rl, rr, ri FROM rk")
def rank_by_signal(t: Tables):
    ranks = (("cosine", "rc"), ("lex", "rl"), ("rec", "rr"), ("importance", "ri"))
    return hybrid(t, "rrf").select("qid", "id", *(F.col(f"rank_{a}").cast("long").alias(b) for a, b in ranks))


@query(
    "topk_per_query",
    pool_sql()
    + """ SELECT qid, id, importance FROM (
      SELECT qid, m.id, importance, row_number() OVER (PARTITION BY qid ORDER BY importance DESC, pool_pos) AS r
      FROM pool JOIN m ON m.id = pool.id) WHERE r <= 3""",
)
def topk_per_query(t: Tables):
    rows = t.pool(20).join(t.m, "id").withColumn("score", F.col("importance"))
    return R.top(rows, 3).select("qid", "id", "importance")


@query(
    "similar_pairs",
    """,
    tv AS (SELECT DISTINCT type, m.vec_id, x FROM m JOIN v USING (vec_id)),
    pr AS (SELECT a.type, a.vec_id AS p, b.vec_id AS q,
      list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) AS s
      FROM tv a JOIN tv b ON a.type = b.type AND a.vec_id <= b.vec_id)
    SELECT type, p, q, round(s, 6) AS similarity FROM pr WHERE s >= 0.35::DOUBLE""",
)
def similar_pairs(t: Tables):
    return C.similar_vectors(t.embedded(), 0.35).select("type", "p", "q", r6("similarity").alias("similarity"))

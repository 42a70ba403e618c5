"""Conflicts, decay, reflection and the lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import conflicts as C
from ..operators import lifecycle as Y
from ..operators import maintenance as M
from ..operators import recall as R
from ..sources.embedders import HashEmbedder, embedded
from .base import ACTIVE, DECAY, LIVE, NEGATIVE, RANK, TRUSTS, Tables, cos, decay, joined, query, r6, tok
from .fixture import NOW, name_of

NEG = f"len(list_filter({tok()}, lambda w: w IN {NEGATIVE})) % 2"
#: fa: facts of rows, with x and the parity of negations; kind of a pair a, b.
FACTS = f", fa AS (SELECT m.*, x, {NEG} AS neg FROM m JOIN v USING (vec_id))"
KIND = "CASE WHEN a.polarity * b.polarity = -1 THEN 'polarity' WHEN a.neg <> b.neg THEN 'negation' {0}ELSE 'duplicate' END AS kind"


def conflicts_sql(more: str = "") -> str:
    return FACTS + f""",
cf AS (SELECT a.id AS a, b.id AS b, {cos("a.x", "b.x")} AS s, {KIND.format(more)}
  FROM fa a JOIN fa b ON a.type = b.type AND a.id < b.id AND (len(a.tags) = 0 OR len(b.tags) = 0 OR list_has_any(a.tags, b.tags))
  WHERE a.superseded_by = '' AND b.superseded_by = '')
SELECT a, b, round(s, 4) AS similarity, kind FROM cf WHERE s >= 0.8::DOUBLE"""


@query("conflicts_all_pairs", conflicts_sql())
def conflicts_all_pairs(t: Tables):
    return C.conflicts(t.m.where("superseded_by = ''"), vectors=t.v)


@query("contradiction_fn", conflicts_sql("WHEN abs(length(a.text) - length(b.text)) > 500 THEN 'custom' "))
def contradiction_fn(t: Tables):
    """A rule of the user's own, on pairs that polarity and negations leave open."""
    differ = lambda one, two: F.abs(one("length") - two("length")) > 500
    return C.conflicts(t.m.where("superseded_by = ''"), contradicts=differ, reads={"length": F.length("text")}, vectors=t.v)


@query("classify_conflict", conflicts_sql().replace("SELECT a, b, round(s, 4) AS similarity, kind FROM cf", "SELECT kind, count(*) AS n FROM cf") + " GROUP BY kind")
def classify_conflict(t: Tables):
    return C.conflicts(t.m.where("superseded_by = ''"), vectors=t.v).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "conflict_classes",
    FACTS
    + f""",
tg AS (SELECT fa.*, list_sort(list_distinct(tags)) AS tagged FROM fa WHERE superseded_by = ''),
cc AS (SELECT *, min(id) OVER (PARTITION BY type, vec_id, tagged, polarity, neg) AS class FROM tg),
cp AS (SELECT least(a.class, b.class) AS ca, greatest(a.class, b.class) AS cb, {cos("a.x", "b.x")} AS s, {KIND.format("")}
  FROM cc a JOIN cc b ON a.type = b.type AND a.id < b.id AND (len(a.tags) = 0 OR len(b.tags) = 0 OR list_has_any(a.tags, b.tags)))
SELECT ca, cb, round(max(s), 4) AS similarity, kind, count(*) AS n FROM cp WHERE s >= 0.8::DOUBLE GROUP BY ca, cb, kind""",
)
def conflict_classes(t: Tables):
    """Clashes as pairs of classes of rows, with the number of pairs each stands for."""
    return C.conflict_classes(t.m.where("superseded_by = ''"), vectors=t.v)[0]


@query(
    "join_self_similarity",
    """,
    tv AS (SELECT DISTINCT type, m.vec_id, x FROM m JOIN v USING (vec_id))
    SELECT a.type, count(*) AS pairs, round(max(s), 6) AS most FROM (
      SELECT a.type, list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) AS s
      FROM tv a JOIN tv b ON a.type = b.type AND a.vec_id < b.vec_id) a WHERE s >= 0.25::DOUBLE GROUP BY a.type""",
)
def join_self_similarity(t: Tables):
    pairs = C.similar_vectors(t.embedded(), 0.25).where("p < q")
    return pairs.groupBy("type").agg(F.count("*").alias("pairs"), r6(F.max("similarity")).alias("most"))


@query(
    "conflicts_for_one",
    FACTS
    + f""",
nb AS (SELECT * FROM (
    SELECT a.id AS aid, b.id AS bid, {cos("a.x", "b.x")} AS s, row_number() OVER (PARTITION BY a.id ORDER BY {cos("a.x", "b.x")} DESC, b.id) AS r
    FROM fa a, fa b) WHERE r <= 12)
SELECT a.id AS a, b.id AS b, round(s, 4) AS similarity, {KIND.format("")}
FROM nb JOIN fa a ON a.id = aid JOIN fa b ON b.id = bid
WHERE aid <> bid AND s >= 0.8::DOUBLE AND b.superseded_by = '' AND (b.expires_at = 0 OR b.expires_at > 1700000000)
  AND a.type = b.type AND (len(a.tags) = 0 OR len(b.tags) = 0 OR list_has_any(a.tags, b.tags))""",
)
def conflicts_for_one(t: Tables):
    """What every row clashes with among its nearest neighbours."""
    return C.conflicts_for(t.m, t.m, t.v, NOW)


@query("decay_score_all", f"SELECT id, round({DECAY}, 6) AS score FROM m WHERE {LIVE}")
def decay_score_all(t: Tables):
    return M.decay_scores(t.m, NOW).select("id", r6("score").alias("score"))


@query("decay_prune", f"SELECT id FROM m WHERE {LIVE} AND {DECAY} < 0.05::DOUBLE AND type <> 'procedural' AND NOT pinned")
def decay_prune(t: Tables):
    return M.prunable(t.m, NOW).select("id")


@query("purge_expired", "SELECT id FROM m WHERE NOT (expires_at > 0 AND expires_at <= 1700000000)")
def purge_expired(t: Tables):
    return Y.forget(t.m, M.expired(t.m, NOW)).select("id")


def _candidates(t: Tables, kind: str = "episodic") -> DataFrame:
    return t.embedded((F.col("type") == kind) & R.live(NOW) & (S.level_of(F.col("tags")) < 1))


@query("reflect_candidates", f"SELECT id, vec_id FROM m WHERE type = 'episodic' AND {ACTIVE} AND NOT list_contains(tags, 'level:1')")
def reflect_candidates(t: Tables):
    return _candidates(t).select("id", "vec_id")


@query("reflect_clusters")
def reflect_clusters(t: Tables):
    return C.leader_clusters(_candidates(t))


@query("leader_cluster")
def leader_cluster(t: Tables):
    """Looser clusters of every type and state at once, of three rows and more."""
    return C.leader_clusters(t.m, 0.4, 3, vectors=t.v).select("id", "leader", "n")


@query("reflect_create")
def reflect_create(t: Tables):
    rows = _candidates(t)
    return Y.reflections(C.leader_clusters(rows), rows, consolidate=True).withColumn("tags", joined("tags"))


GIVEN = """,
cl AS (SELECT m.*, min(id) OVER w AS leader, row_number() OVER (PARTITION BY type, vec_id ORDER BY id) - 1 AS pos, count(*) OVER w AS n
  FROM m WHERE type = 'episodic' WINDOW w AS (PARTITION BY type, vec_id))"""


def _given(t: Tables) -> DataFrame:
    """Clusters that SQL can name: episodic rows that share a vector, led by the first."""
    from pyspark.sql import Window

    w = Window.partitionBy("vec_id")
    rows = t.m.where("type = 'episodic'")
    return rows.select("id", F.min("id").over(w).alias("leader"), F.count("*").over(w).alias("n"), (F.row_number().over(w.orderBy("id")) - 1).cast("long").alias("pos"))


SUMMARY = "'[Reflection ×' || count(*) || '] ' || string_agg(text, ' | ' ORDER BY importance DESC, pos)"


@query("fn_extractive_summary", GIVEN + f" SELECT leader, left({SUMMARY}, 512) AS text FROM cl GROUP BY leader")
def fn_extractive_summary(t: Tables):
    return Y.reflections(_given(t), t.m).select("leader", "text")


@query(
    "summarizers",
    GIVEN + f" SELECT leader, CASE WHEN count(*) > 1 THEN min_by(left(text, 40), pos) || ' and more' ELSE left({SUMMARY}, 512) END AS text FROM cl GROUP BY leader",
)
def summarizers(t: Tables):
    """A summarizer of the user's own; where it fails, the extractive summary stands."""

    def headline(members: list[dict]) -> str:
        if len(members) < 2:
            raise ValueError("nothing to sum up")
        return min(members, key=lambda m: m["pos"])["text"][:40] + " and more"

    return Y.reflections(_given(t), t.m, summarizer=headline).select("leader", "text")


CONSOLIDATED = GIVEN + """,
big AS (SELECT * FROM cl WHERE n > 1)
SELECT m.id, CASE WHEN b.id IS NULL THEN m.superseded_by ELSE 'r' || leader END AS superseded_by, m.pinned
FROM m LEFT JOIN big b ON b.id = m.id
UNION ALL SELECT 'r' || leader, '', bool_or(pinned) FROM big GROUP BY leader"""


@query("reflect_consolidate", CONSOLIDATED)
def reflect_consolidate(t: Tables):
    """Sources of clusters of two and more make way for their summaries."""
    clusters = _given(t).where("n > 1")
    rows, _ = Y.consolidated(t.m.drop("i", "vec_id"), t.e, clusters, Y.reflections(clusters, t.m, consolidate=True), "soft", NOW)
    return rows.select("id", "superseded_by", "pinned")


@query("reflect_links", GIVEN + " SELECT src, dst, rel FROM ed UNION ALL SELECT 'r' || leader, id, unnest(['derived_from', 'supersedes']) FROM cl WHERE n > 1")
def reflect_links(t: Tables):
    clusters = _given(t).where("n > 1")
    return Y.consolidated(t.m.drop("i", "vec_id"), t.e, clusters, Y.reflections(clusters, t.m, consolidate=True), "soft", NOW)[1]


# --- writing -------------------------------------------------------------------------------


def _items(t: Tables) -> DataFrame:
    """New rows: every document's text again, every other one marked as new."""
    text = F.when(F.col("i") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("New: "), "text"))
    return t.m.select(F.col("i").alias("pos"), F.concat(F.lit(" "), text).alias("text"), "type", "tags", F.lit(1.5).alias("importance"), "polarity", "trust", "vec_id")


ITEMS = """,
it AS (SELECT i AS pos, CASE WHEN i % 2 = 0 THEN text ELSE 'New: ' || text END AS text, type, tags, polarity, trust, vec_id FROM m),
ih AS (SELECT *, substr(sha256(trim(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g'))), 1, 32) AS hash FROM it)"""
HASHED = f"""{ITEMS},
lv AS (SELECT content_hash, min(id) AS old FROM m WHERE {ACTIVE} GROUP BY content_hash)"""


@query(
    "remember_many",
    HASHED + " SELECT pos, coalesce(old, 'pos ' || min(pos) OVER (PARTITION BY hash)) AS kept_as, old IS NOT NULL AS touched FROM ih LEFT JOIN lv ON content_hash = hash",
)
def remember_many(t: Tables):
    """What each item is stored as: a live row of the same text, or the batch's first."""
    fresh = Y.build(_items(t), NOW)
    mapping, _ = Y.remember_many(t.m, fresh, NOW, idempotent=True)
    own = fresh.select(F.col("id").alias("kept_as"), F.col("pos").alias("first"))
    return mapping.join(own, "kept_as", "left").select("pos", F.coalesce(F.concat(F.lit("pos "), F.col("first").cast("string")), "kept_as").alias("kept_as"), "touched")


@query(
    "join_hash_dedup",
    f"""SELECT a.id, min(b.id) AS twin FROM m a JOIN m b ON a.content_hash = b.content_hash AND b.superseded_by = ''
    AND (b.expires_at = 0 OR b.expires_at > 1700000000) GROUP BY a.id HAVING min(b.id) < a.id""",
)
def join_hash_dedup(t: Tables):
    first = t.m.where(R.live(NOW)).groupBy("content_hash").agg(F.min("id").alias("twin"))
    return t.m.join(first, "content_hash").where("twin < id").select("id", "twin")


@query("importance_fn", ITEMS + " SELECT pos, least(1, length(text) / 2000::DOUBLE) AS importance, trim(text) AS text FROM ih")
def importance_fn(t: Tables):
    """Importance by a rule of the user's own, of the text, kept in 0..1."""
    fresh = Y.build(_items(t).drop("importance"), NOW, importance=lambda text, type_, tags: F.length(text) / 2000)
    return fresh.select("pos", "importance", "text")


@query(
    "remember",
    ITEMS
    + f""",
    fa AS (SELECT m.*, x FROM m JOIN v USING (vec_id)),
    fn AS (SELECT ih.*, x FROM ih JOIN v USING (vec_id)),
    nb AS (SELECT * FROM (
      SELECT pos, fn.type AS type1, fn.tags AS tags1, fa.id, {cos("fn.x", "fa.x")} AS s,
        row_number() OVER (PARTITION BY pos ORDER BY {cos("fn.x", "fa.x")} DESC, fa.id) AS r FROM fn, fa) WHERE r <= 12),
    cf AS (SELECT pos, m.id FROM nb JOIN m ON m.id = nb.id WHERE s >= 0.8::DOUBLE AND type1 = m.type AND (len(tags1) = 0 OR len(m.tags) = 0 OR list_has_any(tags1, m.tags)) AND {ACTIVE}),
    rf AS (SELECT DISTINCT pos FROM cf)
    SELECT (SELECT count(*) FROM m) + (SELECT count(*) FROM it) - (SELECT count(*) FROM rf) AS stored, (SELECT count(*) FROM rf) AS refused, (SELECT count(*) FROM cf) AS clashes""",
)
def remember(t: Tables):
    """Under the policy that refuses what clashes: counts of rows stored and refused."""
    fresh = Y.build(_items(t), NOW)
    stored, refused, clashes, _ = Y.remember(t.m, t.v, fresh, t.v.where("false"), NOW, "raise")
    return stored.agg(F.count("*").alias("stored")).join(refused.agg(F.count("*").alias("refused")), F.lit(True)).join(clashes.agg(F.count("*").alias("clashes")), F.lit(True))


WANT = """SELECT 'm' || lpad(doc_id::VARCHAR, 8, '0') AS src, 'm' || lpad((doc_id + 2)::VARCHAR, 8, '0') AS dst, 'related' AS rel
    FROM documents WHERE doc_id % 9 = 0"""


@query("link", f"SELECT src, dst, rel FROM ed UNION SELECT src, dst, rel FROM ({WANT}) w WHERE dst IN (SELECT id FROM m)")
def link(t: Tables):
    wanted = t.m.where("i % 9 = 0").select(F.col("id").alias("src"), name_of(F.col("i") + 2).alias("dst"), F.lit("related").alias("rel"))
    return Y.link(t.e, wanted, t.m)


@query("unlink", "SELECT src, dst, rel FROM ed WHERE rel <> 'refines' AND src <> 'm00000005'")
def unlink(t: Tables):
    every = t.e.where("src = 'm00000005'").withColumn("rel", F.lit(None).cast("string"))
    return Y.unlink(t.e, t.e.where("rel = 'refines'").unionByName(every))


def _changes(t: Tables) -> DataFrame:
    """A change of seven rows in eight, some of them bad, and of a row that isn't there."""
    k, i = F.col("i") % 8, F.col("i")
    text = F.when(k == 0, F.concat(F.lit(" changed "), i.cast("string"))).when(k == 4, F.lit("  "))
    tags = F.when(k == 1, F.array(F.lit("a"), F.lit("b"))).when(k == 2, F.array(F.lit("x,y")))
    changes = t.m.where(k < 7).select(
        "id", text.alias("new_text"), F.when(k == 0, 1.7).alias("new_importance"), F.when(k == 1, "feedback").alias("new_type"), tags.alias("new_tags"),
        F.when(k == 3, 1699500000.0).alias("new_valid_from"), F.when(k == 3, True).alias("new_pinned"), (k == 5).alias("clear_source"),
        F.when(k == 5, -1).alias("new_polarity"), F.when((k == 5) | (k == 6), "reported").alias("new_trust"), F.when(k == 5, 5.0).alias("new_expires_at"),
    )
    return changes.unionAll(changes.where("id = 'm00000000'").withColumn("id", F.lit("nobody")))


EDITED = """,
e1 AS (
  SELECT m.*, CASE WHEN i % 8 = 2 THEN 'bad tags' WHEN i % 8 = 3 AND valid_until <> 0 THEN 'bad validity' WHEN i % 8 = 4 THEN 'bad text' END AS bad,
    CASE WHEN i % 8 = 0 THEN 'changed ' || i ELSE text END AS text2 FROM m)"""


@query(
    "edit",
    EDITED
    + """ SELECT id, text2 AS text, CASE WHEN i % 8 = 0 THEN 1::DOUBLE ELSE importance END AS importance,
    CASE WHEN i % 8 = 1 THEN 'feedback' ELSE type END AS type, CASE WHEN i % 8 = 1 THEN 'a,b' ELSE array_to_string(tags, ',') END AS tags,
    CASE WHEN i % 8 = 3 AND bad IS NULL THEN 1699500000 ELSE valid_from END AS valid_from, pinned OR (i % 8 = 3 AND bad IS NULL) AS pinned,
    CASE WHEN i % 8 <> 5 THEN source END AS source, CASE WHEN i % 8 = 5 THEN -1 ELSE polarity END AS polarity,
    CASE WHEN i % 8 IN (5, 6) THEN 'reported' ELSE trust END AS trust, CASE WHEN i % 8 = 5 THEN 5 ELSE expires_at END AS expires_at,
    substr(sha256(trim(regexp_replace(lower(text2), '\\s+', ' ', 'g'))), 1, 32) AS content_hash FROM e1""",
)
def edit(t: Tables):
    columns = ["id", "text", "importance", "type", "tags", "valid_from", "pinned", "source", "polarity", "trust", "expires_at", "content_hash"]
    return Y.edit(t.m, _changes(t))[0].withColumn("tags", joined("tags")).select(*columns)


@query(
    "edit_verdicts",
    EDITED
    + """ SELECT id, coalesce(bad, CASE WHEN i % 8 = 6 AND trust = 'reported' THEN 'same' ELSE 'changed' END) AS verdict FROM e1 WHERE i % 8 < 7
    UNION ALL SELECT 'nobody', 'unknown'""",
)
def edit_verdicts(t: Tables):
    return Y.edit(t.m, _changes(t))[1]


@query("forget", "SELECT id FROM m WHERE i % 11 <> 0")
def forget(t: Tables):
    return Y.forget(t.m, t.m.where("i % 11 = 0")).select("id")


@query("nuke", "SELECT 'nuke' AS op, count(*) AS removed, 0::BIGINT AS left FROM m")
def nuke(t: Tables):
    rows, entry = Y.nuke(t.m, confirm=True)
    return entry.join(rows.agg(F.count("*").alias("left")), F.lit(True))


def _pairs(t: Tables) -> DataFrame:
    """Chains of two, a second wish for their first rows, loops of three, loops with older
    marks, and marks that stand already."""
    wishes = [("i % 50 = 1", 1), ("i % 50 = 2", 3), ("i % 50 = 1", 7), ("i % 50 IN (20, 21)", 1), ("i % 50 = 22", -2), ("i % 92 = 24", -1), ("i % 46 = 23", 1), ("i = 7", 0)]
    new = F.array_compact(F.array(*[F.when(F.expr(cond), name_of(F.col("i") + by)) for cond, by in wishes]))
    return t.m.select(F.col("id").alias("old"), F.explode(new).alias("new"))


PAIRS = """,
pr AS (
  SELECT i AS o, i + 1 AS w FROM m WHERE i % 50 = 1 UNION ALL SELECT i, i + 3 FROM m WHERE i % 50 = 2 UNION ALL SELECT i, i + 7 FROM m WHERE i % 50 = 1
  UNION ALL SELECT i, i + 1 FROM m WHERE i % 50 IN (20, 21) UNION ALL SELECT i, i - 2 FROM m WHERE i % 50 = 22
  UNION ALL SELECT i, i - 1 FROM m WHERE i % 92 = 24 UNION ALL SELECT i, i + 1 FROM m WHERE i % 46 = 23 UNION ALL SELECT i, i FROM m WHERE i = 7),
w0 AS (SELECT o, min(w) AS w FROM pr, nn WHERE o <> w AND w < n GROUP BY o),
w1 AS (SELECT o, w FROM w0 JOIN m ON i = o WHERE superseded_by <> 'm' || lpad(w::VARCHAR, 8, '0')),
st AS (SELECT o AS i, w AS nxt FROM w1 UNION ALL SELECT i, substr(superseded_by, 2)::BIGINT FROM m WHERE superseded_by <> '' AND i NOT IN (SELECT o FROM w1)),
wk AS (SELECT o AS s, w AS tip, 1 AS d FROM w1 UNION ALL SELECT s, nxt, d + 1 FROM wk JOIN st ON st.i = tip WHERE d < 60 AND tip <> s),
ok AS (SELECT * FROM w1 WHERE o NOT IN (SELECT s FROM wk WHERE tip = s)),
pn AS (SELECT w AS i FROM ok JOIN m ON i = o WHERE pinned UNION SELECT w FROM pn JOIN ok ON o = pn.i)"""


@query(
    "supersede",
    PAIRS
    + """ SELECT m.id, CASE WHEN o IS NULL THEN superseded_by ELSE 'm' || lpad(w::VARCHAR, 8, '0') END AS superseded_by,
    CASE WHEN o IS NULL THEN 0 ELSE 1700000000 END::DOUBLE AS superseded_at, pinned OR m.i IN (SELECT i FROM pn) AS pinned FROM m LEFT JOIN ok ON o = m.i""",
)
def supersede(t: Tables):
    return Y.supersede(t.m, t.e, _pairs(t), NOW)[0].select("id", "superseded_by", "superseded_at", "pinned")


@query("supersede_links", PAIRS + " SELECT src, dst, rel FROM ed UNION SELECT 'm' || lpad(w::VARCHAR, 8, '0'), 'm' || lpad(o::VARCHAR, 8, '0'), 'supersedes' FROM ok")
def supersede_links(t: Tables):
    return Y.supersede(t.m, t.e, _pairs(t), NOW)[1]


def _marked(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, every fourth marked one pinned as its successor is; links from successors; and
    whom to restore, twice, with rows that aren't marked."""
    rows = t.m.withColumn("pinned", F.col("i") % 92 <= 1).withColumn("superseded_at", F.when(F.col("superseded_by") == "", 0.0).otherwise(NOW - 5))
    links = t.m.where("superseded_by <> ''").select(F.col("superseded_by").alias("src"), F.col("id").alias("dst"), F.lit("supersedes").alias("rel"))
    ids = t.m.where("i % 46 = 0 OR i % 46 = 9").select("id")
    return rows, t.e.unionByName(links).distinct(), ids.unionAll(ids)


RESTORED = ", rs AS (SELECT id, superseded_by AS by_, i % 92 <= 1 AS pin FROM m WHERE superseded_by <> '' AND (i % 46 = 0 OR i % 46 = 9))"


@query(
    "restore",
    RESTORED
    + """ SELECT id, CASE WHEN id IN (SELECT id FROM rs) THEN '' ELSE superseded_by END AS superseded_by,
    CASE WHEN superseded_by = '' OR id IN (SELECT id FROM rs) THEN 0::DOUBLE ELSE 1699999995::DOUBLE END AS superseded_at,
    i % 92 <= 1 AND id NOT IN (SELECT by_ FROM rs WHERE pin) AS pinned FROM m""",
)
def restore(t: Tables):
    return Y.restore(*_marked(t))[0].select("id", "superseded_by", "superseded_at", "pinned")


@query(
    "restore_links",
    RESTORED
    + """ SELECT * FROM (SELECT src, dst, rel FROM ed UNION SELECT superseded_by, id, 'supersedes' FROM m WHERE superseded_by <> '') e
    WHERE NOT (rel = 'supersedes' AND EXISTS (SELECT 1 FROM rs WHERE rs.id = dst AND by_ = src))""",
)
def restore_links(t: Tables):
    return Y.restore(*_marked(t))[1]


# --- maintenance -----------------------------------------------------------------------------

PRUNED = f"{LIVE} AND {DECAY} < 0.05::DOUBLE AND type <> 'procedural' AND NOT pinned"


@query(
    "maintenance_tick",
    f""",
    kept AS (SELECT * FROM m WHERE NOT ({PRUNED})),
    old AS (SELECT * FROM tr WHERE collection IN ('', 'main') AND deleted_at < 1700000000 - 30 * 86400)
    SELECT (SELECT count(*) FROM m WHERE {PRUNED}) AS decayed, (SELECT count(*) FROM kept WHERE expires_at > 0 AND expires_at <= 1700000000) AS purged,
      (SELECT count(*) FROM old) AS trash, (SELECT count(*) FROM kept WHERE NOT (expires_at > 0 AND expires_at <= 1700000000)) AS left, 0 AS reflected""",
)
def maintenance_tick(t: Tables):
    """Decay and purge are due, reflection ran an hour ago."""
    entries = t.t.select("memory_id", "deleted_at", "actor", "collection")
    state = M.State(last={"reflect": NOW - 3600})
    done = M.tick(t.m, entries, state, NOW, lambda rows: (rows, 1), "main")
    counts = done.rows.agg(F.lit(done.ran["decay"]).alias("decayed"), F.lit(done.ran["purge"]).alias("purged"), F.lit(done.ran["trash"]).alias("trash"), F.count("*").alias("left"))
    return counts.withColumn("reflected", F.lit(done.ran.get("reflect", 0)))


@query(
    "next_run_at",
    "SELECT id, CASE WHEN access_count = 0 THEN 1699999999::DOUBLE ELSE last_accessed + 86400 END AS due, access_count = 0 OR last_accessed + 86400 <= 1700000000 AS overdue FROM m",
)
def next_run_at(t: Tables):
    """As if rows were jobs that last ran when they were last accessed, or never."""
    last = F.when(F.col("access_count") == 0, F.lit(None).cast("double")).otherwise(F.col("last_accessed"))
    due = M.next_run_at(last, 86_400, NOW)
    return t.m.select("id", due.alias("due"), (due <= NOW).alias("overdue"))


@query("vector_index_ok", "SELECT count(*) FILTER (vec_id % 7 = 0) AS missing, count(*) AS n FROM m")
def vector_index_ok(t: Tables):
    """With every seventh vector lost."""
    lost = M.without_vector(t.m, t.v.where("vec_id % 7 <> 0"))
    return lost.agg(F.count("*").alias("missing")).join(t.m.agg(F.count("*").alias("n")), F.lit(True))


@query("rebuild_vectors", "SELECT id, 16 AS dim, 1::DOUBLE AS norm FROM m")
def rebuild_vectors(t: Tables):
    new = M.rebuilt_vectors(t.m, HashEmbedder(16))
    norm = r6(F.sqrt(S.dot(F.col("x"), F.col("x"))))
    return new.select("id", F.size("x").alias("dim"), norm.alias("norm"))


@query("fake_embed", "SELECT a.id, b.id IS NOT NULL AS twin FROM m a LEFT JOIN m b ON b.i = a.i + 1 AND b.text = a.text")
def fake_embed(t: Tables):
    """Equal texts, and only those, have equal vectors: each row against the next."""
    x = embedded(t.m, HashEmbedder()).join(t.m.select("id", "i"), "id")
    next_ = x.select((F.col("i") - 1).alias("i"), F.col("x").alias("y"))
    return x.join(next_, "i", "left").select("id", F.coalesce(F.col("x") == F.col("y"), F.lit(False)).alias("twin"))


@query("embedding_function", "SELECT id, [length(text)::DOUBLE, 1::DOUBLE] AS x FROM m")
def embedding_function(t: Tables):
    """An embedder of the user's own."""
    return embedded(t.m, lambda texts: [[float(len(s)), 1.0] for s in texts])


@query("readiness", "SELECT true AS ready, count(*) AS n, 32 AS dim FROM m")
def readiness(t: Tables):
    got = M.readiness(t.m, HashEmbedder())
    return t.spark.createDataFrame([(got["ready"], got["checks"]["store"]["count"], got["checks"]["embedder"]["dim"])], "ready boolean, n long, dim int")


@query("probe_embedding", "SELECT id, text <> '' AS ok, CASE WHEN text <> '' THEN 8 ELSE -1 END AS dim FROM m")
def probe_embedding(t: Tables):
    """Whether an embedder gives each row's text a vector, and of which length."""
    found = t.m.select("id", "text").join(embedded(t.m.where("text <> ''"), HashEmbedder(8)), "id", "left")
    return found.select("id", F.col("x").isNotNull().alias("ok"), F.coalesce(F.size("x"), F.lit(-1)).alias("dim"))


@query(
    "doctor",
    """,
    ck AS (
      SELECT 'missing_vectors' AS check, count(*) AS bad FROM m WHERE vec_id % 7 = 0
      UNION ALL SELECT 'odd_dimensions', 0 UNION ALL SELECT 'dangling_links', count(*) FROM ed WHERE dst NOT IN (SELECT id FROM m)
      UNION ALL SELECT 'lost_superseders', count(*) FROM m WHERE superseded_by <> '' AND superseded_by NOT IN (SELECT id FROM m)
      UNION ALL SELECT 'stale_hashes', 0 UNION ALL SELECT 'bad_tags', 0 UNION ALL SELECT 'bad_validity', 0)
    SELECT "check", bad, bad = 0 AS ok FROM ck""",
)
def doctor(t: Tables):
    return M.doctor(t.m, t.v.where("vec_id % 7 <> 0"), t.e)


@query("agg_trust_by_cluster", GIVEN + f" SELECT leader, {TRUSTS}[max({RANK.format('trust')}) + 1] AS trust FROM cl GROUP BY leader")
def agg_trust_by_cluster(t: Tables):
    return Y.reflections(_given(t), t.m).select("leader", "trust")


@query("decay_frequency", f"SELECT id, round({DECAY} * (1 + 0.2::DOUBLE * ln(1 + access_count)), 6) AS score FROM m WHERE {LIVE}")
def decay_frequency(t: Tables):
    """Decay where reading often slows it."""
    return M.decay_scores(t.m, NOW, frequency=0.2).select("id", r6("score").alias("score"))


@query("decay_bands", f"SELECT type, round(min({DECAY}), 6) AS low, round(max({DECAY}), 6) AS high FROM m WHERE {ACTIVE} GROUP BY type")
def decay_bands(t: Tables):
    return t.m.where(R.live(NOW)).groupBy("type").agg(r6(F.min(decay())).alias("low"), r6(F.max(decay())).alias("high"))

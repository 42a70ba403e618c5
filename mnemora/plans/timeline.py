"""The journal and time travel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import log as L
from ..operators import trash as B
from ..scratch import Scratch
from ..sources import files, rotation
from .base import Tables, query, r6
from .fixture import NOW, THEN, name_of

READ = "us >= 1704500000000000 AND us <= 1705500000000000 AND op = 'link'"


def _journal_lines(t: Tables):
    meta = F.to_json(F.struct("dst_id", "rel"))
    actor = F.when(F.col("seq") % 2 == 0, "agent").otherwise("person")
    entry = F.struct((F.col("us") / 1e6).alias("ts"), "op", actor.alias("actor"), "id", meta.alias("meta"), F.lit("s").alias("scope"))
    return t.j.select(F.to_json(entry).alias("value"))


@query("journal_read", f"SELECT us / 1e6::DOUBLE AS ts, op, id, rel FROM jl WHERE {READ}")
def journal_read(t: Tables):
    """From files, between two moments, both included; a line that doesn't parse is passed over."""
    lines = _journal_lines(t).unionAll(t.spark.createDataFrame([("{broken",)], "value string"))
    found = files.read_journal(t.spark, t.file(lines), since=1704500000.0, until=1705500000.0, op="link")
    return found.select("ts", "op", "id", F.get_json_object("meta", "$.rel").alias("rel"))


@query("as_actor", "SELECT op, count(*) AS n FROM jl WHERE seq % 2 = 0 GROUP BY op")
def as_actor(t: Tables):
    """What one actor did, from files."""
    return files.read_journal(t.spark, t.file(_journal_lines(t), gz=True), actor="agent", scope="s").groupBy("op").agg(F.count("*").alias("n"))


@query("concat_journal_segments", "SELECT count(*) AS n, count(DISTINCT id) AS ids, true AS ordered FROM jl")
def concat_journal_segments(t: Tables):
    """A rotated segment and the active file; the segment is there twice, plain and, cut
    short, gzipped."""
    half = t.j.agg(F.max("seq")).first()[0] // 2
    old, new = t.j.where(F.col("seq") <= half), t.j.where(F.col("seq") > half)
    root = Scratch(t.spark).root
    hadoop = t.spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(root).getFileSystem(t.spark._jsc.hadoopConfiguration())
    for rows, name, option in ((old, "journal-1.log", "none"), (old.where("seq < 3"), "journal-1.log.gz", "gzip"), (new, "journal.log", "none")):
        entry = F.struct(F.col("seq").cast("double").alias("ts"), "op", "id")
        rows.select(F.to_json(entry).alias("value")).coalesce(1).write.option("compression", option).text(f"{root}/tmp-{name}")
        part = next(s.getPath() for s in fs.listStatus(hadoop.Path(f"{root}/tmp-{name}")) if s.getPath().getName().startswith("part"))
        fs.rename(part, hadoop.Path(f"{root}/{name}"))
        fs.delete(hadoop.Path(f"{root}/tmp-{name}"), True)
    late = (F.col("seq.active") == 1) == (F.col("ts") > half)
    return files.read_journal(t.spark, root).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.bool_and(late).alias("ordered"))


@query("journal_tail", "SELECT seq, op, id FROM jl ORDER BY seq DESC LIMIT 20")
def journal_tail(t: Tables):
    return t.j.orderBy(F.desc("seq")).limit(20).select("seq", "op", "id")


@query("journal_find_ts", "SELECT seq FROM jl WHERE abs(us - (SELECT us FROM jl WHERE seq = 100)) <= 1000 ORDER BY seq LIMIT 1")
def journal_find_ts(t: Tables):
    at = (t.j.where("seq = 100").first() or [None, None])[1]
    return t.j.where(F.abs(F.col("us") - F.lit(at)) <= 1000).orderBy("seq").limit(1).select("seq")


@query("journal_summary", "SELECT seq, CASE WHEN op IN ('link', 'unlink') THEN op || ' ' || id || ' -' || rel || '-> ' || dst_id ELSE op || ' ' || id END AS line FROM jl")
def journal_summary(t: Tables):
    return L.summaries(t.j)


@query("history", "SELECT seq, op FROM jl WHERE id = 'u7' OR (op IN ('link', 'unlink') AND dst_id = 'u7')")
def history(t: Tables):
    """A row's own entries and those of links to it."""
    journal = t.j.withColumn("dst_id", F.when(F.col("op").isin("link", "unlink"), F.col("dst_id")))
    return L.history(journal, "u7").select("seq", "op")


@query(
    "history_superseder",
    "SELECT seq, op FROM jl WHERE id = 'u7' OR (op = 'edit' AND seq % 4 = 0 AND dst_id = 'u7')",
)
def history_superseder(t: Tables):
    """As if every fourth edit were a supersede: the newer row's history names it too."""
    new = F.when((F.col("op") == "edit") & (F.col("seq") % 4 == 0), F.col("dst_id"))
    return L.history(t.j.withColumn("new_id", new).drop("dst_id"), "u7").select("seq", "op")


OUTCOME = "CASE count(*) WHEN 0 THEN 'none' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS outcome"


@query("prefix_resolve_journal", f"SELECT count(*) AS matches, {OUTCOME}, min(id) AS first_id FROM (SELECT id FROM jl UNION SELECT dst_id FROM jl) WHERE starts_with(id, 'u3')")
def prefix_resolve_journal(t: Tables):
    return L.resolve_prefix(t.j, "u3")


@query(
    "versions",
    """SELECT seq, id, lag(text) OVER (PARTITION BY id ORDER BY seq) AS before FROM jl WHERE op IN ('remember', 'edit')
    QUALIFY op = 'edit' AND before IS NOT NULL""",
)
def versions(t: Tables):
    return L.versions(t.j)


def _log(t: Tables):
    """The journal with links inside every fourth edit, and unlinks of all relations."""
    held = F.array(F.struct(F.concat(F.lit("u"), ((F.col("seq") * 3) % 40).cast("string")).alias("dst_id"), F.lit("refines").alias("rel")))
    every = (F.col("op") == "unlink") & (F.col("seq") % 5 == 0)
    return t.j.withColumn("links", F.when((F.col("op") == "edit") & (F.col("seq") % 4 == 0), held)).withColumn("rel", F.when(~every, F.col("rel")))


LOG = """,
lg AS (
  SELECT seq, us, op, id, dst_id, CASE WHEN op = 'unlink' AND seq % 5 = 0 THEN NULL ELSE rel END AS rel, text,
    CASE WHEN op = 'edit' AND seq % 4 = 0 THEN 'u' || ((seq * 3) % 40) END AS held FROM jl)"""


def replay_sql(cut: str, undo: str = "FALSE") -> str:
    """Rows and links that ``cut(t, seq, op, ...)`` of lg leaves at each t; undone entries as ``undo`` says."""
    return LOG + f""",
cut AS ({cut}),
b AS (SELECT id, t, max_by(op = 'forget' OR ({undo}), seq) AS gone, max(seq) AS base, max_by(text, seq) AS text
  FROM cut WHERE op IN ('remember', 'edit', 'forget') OR ({undo}) GROUP BY id, t),
ev AS (
  SELECT c.id, c.t, c.dst_id, c.rel, c.op = 'link' AS on_, c.seq FROM (SELECT * FROM cut WHERE op IN ('link', 'unlink') AND NOT ({undo})) c JOIN b ON b.id = c.id AND b.t = c.t AND c.seq > base
  UNION ALL SELECT b.id, b.t, held, 'refines', true, base FROM b JOIN cut c ON c.id = b.id AND c.t = b.t AND c.seq = base WHERE held IS NOT NULL),
lo AS (SELECT id, t, dst_id, rel, max_by(on_, seq) AS on_, max(seq) AS seq FROM ev WHERE rel IS NOT NULL GROUP BY ALL),
lf AS (SELECT id, t, dst_id, max(seq) AS off FROM ev WHERE rel IS NULL GROUP BY ALL),
ll AS (SELECT lo.id, lo.t, count(*) AS links, string_agg(dst_id || ' ' || rel, ',' ORDER BY dst_id, rel) AS listed
  FROM lo LEFT JOIN lf USING (id, t, dst_id) WHERE on_ AND (off IS NULL OR seq > off) GROUP BY ALL)
SELECT b.id, b.t::DOUBLE AS us, text, coalesce(links, 0) AS links, coalesce(listed, '') AS listed FROM b LEFT JOIN ll ON ll.id = b.id AND ll.t = b.t WHERE NOT gone"""


def state_sql(nuked: str = "", undo: str = "FALSE") -> str:
    """Replay up to THEN, after the last nuke."""
    return replay_sql(f"SELECT *, {THEN} AS t FROM lg WHERE us <= {THEN} {nuked}", undo).replace("b.t::DOUBLE AS us, ", "")


def _listed(rows, *more: str):
    return rows.select("id", *more, "text", "links", F.coalesce(F.array_join(F.transform("link_list", lambda x: F.concat_ws(" ", x["dst_id"], x["rel"])), ","), F.lit("")).alias("listed"))


@query("state_at", state_sql())
def state_at(t: Tables):
    return _listed(L.state_at(_log(t), float(THEN)))


@query("state_at_nuke", state_sql("AND seq > (SELECT max(seq) FROM jl WHERE seq % 500 = 0 AND us <= 1705500000000000)"))
def state_at_nuke(t: Tables):
    """With a nuke at every five hundredth entry."""
    op = F.when(F.col("seq") % 500 == 0, "nuke").otherwise(F.col("op"))
    return _listed(L.state_at(_log(t).withColumn("op", op), float(THEN)))


@query("state_at_undo", state_sql(undo="op = 'unlink' AND seq % 3 = 0"))
def state_at_undo(t: Tables):
    """Every third unlink stands for the undo of a remember, which takes the row away."""
    hit = (F.col("op") == "unlink") & (F.col("seq") % 3 == 0)
    journal = _log(t).withColumn("of_op", F.when(hit, "remember")).withColumn("text", F.when(~hit, F.col("text")))
    return _listed(L.state_at(journal.withColumn("op", F.when(hit, "undo").otherwise(F.col("op"))), float(THEN)))


@query("get_at", state_sql().replace("WHERE NOT gone", "WHERE NOT gone AND b.id = 'u7'"))
def get_at(t: Tables):
    return _listed(L.state_at(_log(t).where("id = 'u7'"), float(THEN)))


@query(
    "states_at",
    replay_sql("""SELECT lg.*, t FROM (SELECT DISTINCT id, us + 3e9 AS t FROM jl WHERE seq % 3 = 0) ak JOIN lg ON lg.id = ak.id AND us <= t
    WHERE op <> 'nuke' AND seq % 900 <> 0 AND seq > coalesce((SELECT max(seq) FROM jl n WHERE n.seq % 900 = 0 AND n.us <= t), -1)"""),
)
def states_at(t: Tables):
    """What each third entry's row was like 50 minutes later, with a nuke at every nine
    hundredth entry: thousands of moments in one pass."""
    asked = t.j.where("seq % 3 = 0").select("id", (F.col("us") + 3e9).alias("us"))
    op = F.when(F.col("seq") % 900 == 0, "nuke").otherwise(F.col("op"))
    return _listed(L.states_at(_log(t).withColumn("op", op), asked), "us")


@query(
    "journal_rotate",
    "SELECT strftime(make_timestamp(us::BIGINT), '%Y%m%d') AS day, count(*) AS n FROM jl GROUP BY day HAVING day >= strftime(make_timestamp(1705500000000000 - 3 * 86400000000), '%Y%m%d')",
)
def journal_rotate(t: Tables):
    """Segments a day, of which those older than three days go (as of THEN)."""
    root = Scratch(t.spark).root
    files.write_journal(t.j.select((F.col("us") / 1e6).alias("ts"), "op", "id"), root)
    files.pruned_days(t.spark, root, 3, THEN / 1e6)
    return t.spark.read.schema("ts double, op string, id string, day string").json(root).groupBy("day").agg(F.count("*").alias("n"))


@query(
    "journal_rotate_size",
    """,
    ln AS (SELECT seq, length(op || ' ' || id || ' ' || seq) + 1 AS b FROM jl),
    sg AS (SELECT seq, b, ((sum(b) OVER (ORDER BY seq) - 1) // (4096 - (SELECT max(b) FROM ln) + 1))::INT AS segment FROM ln)
    SELECT segment, count(*) AS n, sum(b)::BIGINT AS bytes, min(seq) AS first_seq, max(seq) AS last_seq FROM sg GROUP BY segment""",
)
def journal_rotate_size(t: Tables):
    """Segments of at most 4,096 bytes; a first try stops halfway and is taken up again."""
    log = rotation.Log(t.spark, f"{Scratch(t.spark).root}/log")
    log.append(t.j.select("seq", F.concat_ws(" ", "op", "id", F.col("seq").cast("string")).alias("value")))
    log.rotate(4096, stop="written")
    log.recover(4096)
    return log.segments().drop("rotation")


@query(
    "prune_archives",
    "SELECT DISTINCT strftime(make_timestamp(us::BIGINT), '%Y%m%d') AS day FROM jl WHERE strftime(make_timestamp(us::BIGINT), '%Y%m%d') < strftime(make_timestamp(1705500000000000 - 3 * 86400000000), '%Y%m%d')",
)
def prune_archives(t: Tables):
    """The days that retention drops."""
    root = Scratch(t.spark).root
    files.write_journal(t.j.select((F.col("us") / 1e6).alias("ts"), "op", "id"), root)
    gone = files.pruned_days(t.spark, root, 3, THEN / 1e6)
    return t.spark.createDataFrame([(d,) for d in gone], "day string")


# --- undo ------------------------------------------------------------------------------------


def _entries(t: Tables):
    """One entry a row, of an op by the row's number; every other edit has been changed since."""
    m = t.m
    row = F.struct(*[F.col(c) for c in m.columns])
    text = F.when(F.col("i") % 16 < 8, F.col("text")).otherwise(F.concat("text", F.lit(" then")))
    after = F.struct(*[text.alias("text") if c == "text" else F.col(c) for c in m.columns])
    before = F.struct(*[F.concat(F.lit("was "), "text").alias("text") if c == "text" else F.col(c) for c in m.columns])
    k = F.col("i") % 8
    op = F.when(k == 0, "remember").when(k == 1, "forget").when(k == 2, "edit").when(k == 3, "supersede").when(k == 4, "restore").when(k == 5, "link").when(k == 6, "unlink").otherwise("export")
    none = F.lit(None).cast("string")
    to = name_of((F.col("i") * 7 + 1) % t.sizes[0])
    rels = F.when(k >= 5, F.array(F.lit("refines"), F.lit("contradicts")))
    return m.select(
        F.col("i").alias("seq"), op.alias("op"), F.when((k == 1) & (F.col("i") % 16 == 1), F.concat(F.lit("gone"), "id")).otherwise(F.col("id")).alias("id"),
        before.alias("before"), F.when(k == 2, after).otherwise(row).alias("after"), F.when(k >= 5, to).otherwise(none).alias("dst_id"), rels.alias("rels"),
        F.when(k == 4, F.when(F.col("i") % 16 == 4, name_of((F.col("i") + 1) % t.sizes[0])).otherwise(F.lit("nobody"))).otherwise(none).alias("superseder_id"),
    )


VERDICTS = """,
hv AS (SELECT src, dst, list(rel) AS have FROM ed GROUP BY ALL),
vd AS (SELECT i AS seq, m.id, text, superseded_by AS by_, pinned, 'm' || lpad(((i + 1) % n)::VARCHAR, 8, '0') AS next_, CASE i % 8 WHEN 0 THEN true WHEN 1 THEN i % 16 = 1 WHEN 2 THEN i % 16 < 8 WHEN 3 THEN superseded_by <> '' WHEN 4 THEN i % 16 = 4
    WHEN 5 THEN coalesce(list_has_any(have, ['refines', 'contradicts']), false)
    WHEN 6 THEN NOT coalesce(list_has_all(have, ['refines', 'contradicts']), false) ELSE false END AS undone
  FROM m CROSS JOIN nn LEFT JOIN hv ON src = m.id AND dst = 'm' || lpad(((i * 7 + 1) % n)::VARCHAR, 8, '0'))"""


@query("undo", VERDICTS + " SELECT seq, undone FROM vd")
def undo(t: Tables):
    return L.undo(_entries(t), t.m, t.e, NOW)[2].select("seq", "undone")


@query("undo_trash", "SELECT memory_id, deleted_at, collection FROM tr WHERE NOT (collection IN ('', 'main') AND memory_id IN (SELECT id FROM jl WHERE op = 'forget' AND seq % 7 = 0) AND memory_id <> 'u3')")
def undo_trash(t: Tables):
    """Some forgets are undone, one can't be: the others' rows need their trash no more."""
    before = F.struct("id", "text", F.lit("").alias("superseded_by"), F.lit(False).alias("pinned"))
    none = F.lit(None).cast("string")
    entries = t.j.where("op = 'forget' AND seq % 7 = 0").dropDuplicates(["id"]).select("seq", "op", "id", before.alias("before"), before.alias("after"), none.alias("dst_id"), F.array(none).alias("rels"), none.alias("superseder_id"))
    rows = t.spark.createDataFrame([("u3", "here", "", False)], "id string, text string, superseded_by string, pinned boolean")
    verdicts = L.undo(entries, rows, t.e, NOW)[2]
    return B.unneeded(t.t, verdicts, "main").select("memory_id", "deleted_at", "collection")


@query(
    "undo_rows",
    VERDICTS
    + """ SELECT m.id, CASE WHEN i % 8 = 2 AND undone THEN 'was ' || m.text ELSE m.text END AS text,
      CASE WHEN i % 8 = 3 AND undone THEN '' WHEN i % 8 = 4 AND undone THEN next_ ELSE superseded_by END AS superseded_by,
      m.pinned OR EXISTS (SELECT 1 FROM vd z WHERE z.undone AND z.seq % 8 = 4 AND z.pinned AND z.by_ <> z.next_ AND z.next_ = m.id) AS pinned
    FROM m JOIN vd ON seq = i WHERE i % 8 <> 0
    UNION ALL SELECT m.id, 'was ' || m.text, superseded_by, pinned FROM m WHERE i % 16 = 1""",
)
def undo_rows(t: Tables):
    """The rows afterwards: forgotten ones are back beside those of the same text."""
    return L.undo(_entries(t), t.m, t.e, NOW)[0].select("id", "text", "superseded_by", "pinned")


@query(
    "undo_links",
    VERDICTS
    + """ SELECT src, dst, rel FROM ed WHERE NOT EXISTS (SELECT 1 FROM vd WHERE undone AND seq % 8 = 3 AND rel = 'supersedes' AND by_ = src AND id = dst)
      AND NOT EXISTS (SELECT 1 FROM vd WHERE undone AND seq % 8 = 5 AND vd.id = src AND rel IN ('refines', 'contradicts')
        AND dst = 'm' || lpad(((seq * 7 + 1) % (SELECT n FROM nn))::VARCHAR, 8, '0'))
    UNION SELECT id, 'm' || lpad(((seq * 7 + 1) % (SELECT n FROM nn))::VARCHAR, 8, '0'), r FROM vd, (VALUES ('refines'), ('contradicts')) x(r) WHERE undone AND seq % 8 = 6
    UNION SELECT next_, id, 'supersedes' FROM vd WHERE undone AND seq % 8 = 4 AND by_ <> next_""",
)
def undo_links(t: Tables):
    return L.undo(_entries(t), t.m, t.e, NOW)[1]


def _lives(t: Tables):
    """All remembers, edits and forgets of the log with snapshots of few different texts, so
    that some fit each other, and the rows of today: three of four of the log's ids."""
    snap = lambda n: F.struct(F.col("id"), F.concat(F.lit("v"), (n % 3).cast("string")).alias("text"))
    before = F.when((F.col("op") != "forget") | (F.col("seq") % 11 != 0), snap(F.floor(F.col("seq") / 3)))
    entries = t.j.where("op IN ('remember', 'edit', 'forget')").select("seq", "op", "id", before.alias("before"), snap(F.col("seq")).alias("after"))
    number = F.substring("id", 2, 20).cast("long")
    rows = t.j.select("id").distinct().where(number % 4 != 0).select("id", F.concat(F.lit("v"), (number % 3).cast("string")).alias("text"))
    return entries, rows


LIVES = """,
le AS (SELECT seq, op, id, CASE WHEN op <> 'forget' OR seq % 11 <> 0 THEN 'v' || ((seq // 3) % 3) END AS old_, 'v' || (seq % 3) AS new_,
    row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS k FROM jl WHERE op IN ('remember', 'edit', 'forget')),
lr AS (SELECT id, 'v' || (substr(id, 2)::BIGINT % 3) AS text FROM (SELECT DISTINCT id FROM jl) WHERE substr(id, 2)::BIGINT % 4 <> 0),
lf AS (
  SELECT id, 0::BIGINT AS k, text, NULL::BIGINT AS seq, false AS undone FROM (SELECT DISTINCT id FROM jl) LEFT JOIN lr USING (id)
  UNION ALL
  SELECT id, k, CASE WHEN NOT ok THEN text WHEN op = 'remember' THEN NULL ELSE old_ END, seq, ok
  FROM (SELECT lf.id, le.k, lf.text, le.seq, le.op, old_,
      coalesce(CASE le.op WHEN 'remember' THEN lf.text IS NOT NULL WHEN 'forget' THEN lf.text IS NULL AND old_ IS NOT NULL ELSE lf.text = new_ END, false) AS ok
    FROM lf JOIN le ON le.id = lf.id AND le.k = lf.k + 1))"""


@query("undo_chains", LIVES + " SELECT seq, undone FROM lf WHERE k > 0")
def undo_chains(t: Tables):
    """All entries of all rows' lives, newest first: which of them are undone."""
    return L.undo_chains(*_lives(t))[1].select("seq", "undone")


@query("undo_chains_rows", LIVES + " SELECT id, arg_max(text, k) AS text FROM (SELECT id, k, coalesce(text, '') AS text FROM lf) GROUP BY id HAVING arg_max(text, k) <> ''")
def undo_chains_rows(t: Tables):
    """The rows that are left when all of them have been tried."""
    return L.undo_chains(*_lives(t))[0].select("id", "text")


@query("journal_values", "SELECT op, round(avg(us) / 1e6, 6) AS mean FROM jl GROUP BY op")
def journal_values(t: Tables):
    return t.j.groupBy("op").agg(r6(F.avg("us") / 1e6).alias("mean"))

"""Recall, selection, packing and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import lifecycle as Y
from ..operators import log as L
from ..operators import recall as R
from ..operators import touches as D
from ..operators import trigrams
from ..scratch import Scratch
from .aggregates import RANKS
from .base import (
    ACTIVE, CURRENT, HELD, HITS, LEXICAL, LIVE, ORACLES, SIGNALS, WEIGHTED, Tables, cos, hits, hybrid, pool_sql, query, r6, ranked_sql, semantic, semantic_sql, strings, tok,
)
from .fixture import DUCK, NOW, name_of
from .scalar import phrases_sql

HYBRID = pool_sql() + LEXICAL + SIGNALS + WEIGHTED
SCORED = f", sc AS (SELECT qid, id, pool_pos, base AS score FROM sw m WHERE {HELD})"
VALID_THEN = "(valid_from = 0 OR valid_from <= 1699500000) AND (valid_until = 0 OR 1699500000 < valid_until)"


@query("recall_semantic", pool_sql() + semantic_sql(CURRENT) + ranked_sql() + HITS)
def recall_semantic(t: Tables):
    return hits(semantic(t))


@query("topk_semantic", pool_sql(10) + semantic_sql("TRUE") + ranked_sql(3) + HITS)
def topk_semantic(t: Tables):
    """By score alone, whatever the rows' state."""
    rows = t.pool(10).join(t.m, "id").withColumn("score", F.col("cosine") + 0.05 * F.col("polarity"))
    return hits(R.top(rows, 3))


@query("topk_overfetch", pool_sql(12) + semantic_sql(f"{CURRENT} AND trust = 'trusted'") + ranked_sql(3) + HITS)
def topk_overfetch(t: Tables):
    """k = 3 of a pool of four times as many, or of all rows if there are fewer."""
    return hits(semantic(t, k=3, n=max(3, min(3 * 4, t.sizes[0])), min_trust="trusted"))


@query("recall_as_of", pool_sql() + semantic_sql(f"{LIVE} AND {VALID_THEN}") + ranked_sql() + HITS)
def recall_as_of(t: Tables):
    return hits(semantic(t, valid_at=1699500000.0))


@query("recall_min_trust", pool_sql() + semantic_sql(f"{CURRENT} AND trust = 'trusted'") + ranked_sql() + HITS)
def recall_min_trust(t: Tables):
    return hits(semantic(t, min_trust="trusted"))


@query("recall_filtered", pool_sql(20, "type = 'semantic' AND importance >= 0.2::DOUBLE") + semantic_sql(f"{CURRENT} AND list_contains(tags, 'hot')") + ranked_sql() + HITS)
def recall_filtered(t: Tables):
    return hits(semantic(t, "type = 'semantic' AND importance >= 0.2D", tag="hot"))


@query("fn_bm25", pool_sql() + LEXICAL + " SELECT qid, id, round(lex, 6) AS lex FROM bm")
def fn_bm25(t: Tables):
    return R.bm25(t.pool(20).join(t.m, "id"), t.q).select("qid", "id", r6("lex").alias("lex"))


@query("recall_hybrid_weighted", HYBRID + SCORED + ranked_sql() + HITS)
def recall_hybrid_weighted(t: Tables):
    return hits(R.top(hybrid(t).where(R.eligible(NOW)), 5))


@query(
    "recall_renormalised",
    pool_sql(3, "NOT contains(lower(text), 'th')")
    + LEXICAL
    + SIGNALS
    + WEIGHTED
    + " SELECT qid, id, matched, round(base, 6) AS score FROM sw",
)
def recall_renormalised(t: Tables):
    """Small pools, some without any word of the query: there the other weights count more."""
    rows = hybrid(t, n=3, where=~F.lower("text").contains("th"))
    return rows.select("qid", "id", "matched", r6("score").alias("score"))


RRF = pool_sql() + LEXICAL + SIGNALS + RANKS
RRF_SCORE = """0.55::DOUBLE / (60 + rc) + 0.2::DOUBLE / (60 + rl) + 0.15::DOUBLE / (60 + rr)
    + 0.1::DOUBLE / (60 + ri) + 0.05::DOUBLE * polarity / 61"""


@query("recall_hybrid_rrf", RRF + f", sc AS (SELECT qid, id, pool_pos, {RRF_SCORE} AS score FROM rk m WHERE {HELD})" + ranked_sql() + HITS)
def recall_hybrid_rrf(t: Tables):
    return hits(R.top(hybrid(t, "rrf").where(R.eligible(NOW)), 5))


BREAKDOWN = "round(cosine, 4) AS cosine, round(lex, 4) AS lexical, round(rec, 4) AS recency, round(importance, 4) AS importance"


def _breakdown(rows: DataFrame, *more):
    names = (("cosine", "cosine"), ("lex", "lexical"), ("rec", "recency"), ("importance", "importance"))
    return rows.select("qid", "id", *(F.round(a, 4).alias(b) for a, b in names), *more)


@query("explain_projection", HYBRID + f" SELECT qid, id, {BREAKDOWN}, polarity, round(base, 4) AS score FROM sw")
def explain_projection(t: Tables):
    return _breakdown(hybrid(t), "polarity", F.round("score", 4).alias("score"))


@query(
    "recall_explain",
    RRF
    + f""", sc AS (SELECT *, {RRF_SCORE} AS score FROM rk m WHERE {HELD})"""
    + ranked_sql(3)
    + f" SELECT qid, id, {BREAKDOWN}, rc, rl, rr, ri, round(score, 6) AS rrf, rank FROM best",
)
def recall_explain(t: Tables):
    """The hits themselves, with what each signal and its rank were."""
    best = R.top(hybrid(t, "rrf").where(R.eligible(NOW)), 3)
    ranks = (("cosine", "rc"), ("lex", "rl"), ("rec", "rr"), ("importance", "ri"))
    return _breakdown(best, *(F.col(f"rank_{a}").cast("long").alias(b) for a, b in ranks), r6("score").alias("rrf"), F.col("rank").cast("long").alias("rank"))


# --- graph ---------------------------------------------------------------------------


def spread_sql(rows: str, seed: str) -> str:
    """sp(qid, id, spread): three rounds of activation from ``seed`` over links inside ``rows``."""

    def step(new: str, old: str) -> str:
        return f""",
{new} AS (
  SELECT o.qid, o.id, seed, 0.5::DOUBLE * seed + 0.5::DOUBLE * coalesce(g, act) AS act FROM {old} o LEFT JOIN (
    SELECT dg.qid, b AS id, sum(z.act / deg) AS g FROM dg JOIN {old} z ON z.qid = dg.qid AND z.id = a GROUP BY ALL) USING (qid, id))"""

    return (
        f""",
per AS (SELECT qid, min({seed}) AS lo, max({seed}) AS hi FROM {rows} GROUP BY qid),
s0 AS (SELECT r.qid, id, CASE WHEN hi - lo <= 1e-12 THEN 1 ELSE ({seed} - lo) / (hi - lo) END AS s FROM {rows} r JOIN per USING (qid)),
s1 AS (SELECT qid, id, s / sum(s) OVER (PARTITION BY qid) AS seed, s / sum(s) OVER (PARTITION BY qid) AS act FROM s0),
un AS (SELECT DISTINCT qid, a, b FROM (
  SELECT x.qid, src AS a, dst AS b FROM ed JOIN s1 x ON x.id = src JOIN s1 y ON y.id = dst AND y.qid = x.qid
  UNION ALL SELECT x.qid, dst, src FROM ed JOIN s1 x ON x.id = src JOIN s1 y ON y.id = dst AND y.qid = x.qid)),
dg AS (SELECT qid, a, b, count(*) OVER (PARTITION BY qid, a) AS deg FROM un)"""
        + step("a1", "s1")
        + step("a2", "a1")
        + step("a3", "a2")
        + """,
sp AS (SELECT qid, id, CASE WHEN hi - lo > 1e-12 THEN round((act - lo) / (hi - lo), 12) END AS spread
  FROM (SELECT *, min(act) OVER (PARTITION BY qid) AS lo, max(act) OVER (PARTITION BY qid) AS hi FROM a3)
  WHERE qid IN (SELECT qid FROM un))"""
    )


@query(
    "recall_graph_fusion",
    HYBRID
    + spread_sql("sw", "base")
    + f""",
sc AS (SELECT m.qid, m.id, pool_pos, base + 0.3::DOUBLE * coalesce(spread, 0) AS score
  FROM sw m LEFT JOIN sp ON sp.qid = m.qid AND sp.id = m.id WHERE {HELD})"""
    + ranked_sql()
    + HITS,
)
def recall_graph_fusion(t: Tables):
    return hits(R.top(hybrid(t, w=R.Weights(graph=0.3)).where(R.eligible(NOW)), 5))


@query(
    "recall_graph_rrf",
    RRF
    + spread_sql("rk", "cosine")
    + f""",
gr AS (SELECT m.*, coalesce(spread, 0) AS spread, max(coalesce(spread, 0)) OVER (PARTITION BY m.qid) > 0 AS counts,
  row_number() OVER (PARTITION BY m.qid ORDER BY coalesce(spread, 0) DESC, pool_pos) - 1 AS rg
  FROM rk m LEFT JOIN sp ON sp.qid = m.qid AND sp.id = m.id),
sc AS (SELECT qid, id, pool_pos, {RRF_SCORE} + CASE WHEN counts THEN 0.3::DOUBLE / (60 + rg) ELSE 0 END AS score FROM gr m WHERE {HELD})"""
    + ranked_sql()
    + HITS,
)
def recall_graph_rrf(t: Tables):
    return hits(R.top(hybrid(t, "rrf", R.Weights(graph=0.3)).where(R.eligible(NOW)), 5))


def expansion_sql(front: str, seen: str, score: float, cap: int = 5, rels: str = "('refines', 'example_of')") -> str:
    """x1(qid, id, score, n): rows one link from ``front(qid, id, rank)``, in its order."""
    return f""",
x0 AS (SELECT f.qid, dst AS id, min(rank) AS pos FROM {front} f
  JOIN (SELECT DISTINCT src, dst FROM ed WHERE rel IN {rels}) l ON l.src = f.id
  JOIN m ON m.id = dst AND superseded_by = '' WHERE NOT EXISTS (SELECT 1 FROM {seen} z WHERE z.qid = f.qid AND z.id = dst) GROUP BY ALL),
x1 AS (SELECT * FROM (
    SELECT qid, x0.id, {score}::DOUBLE AS score, row_number() OVER (PARTITION BY qid ORDER BY pos, x0.id) AS n
    FROM x0 JOIN m ON m.id = x0.id WHERE {HELD})
  WHERE n <= {cap})"""


SEMANTIC = pool_sql() + semantic_sql(CURRENT)


@query("recall_expand_append", SEMANTIC + ranked_sql() + expansion_sql("best", "best", 0.7) + " SELECT qid, id, score, 1 AS hop, n FROM x1")
def recall_expand_append(t: Tables):
    return R.expand(semantic(t), t.e, t.m, R.eligible(NOW)).select("qid", "id", "score", "hop", F.col("n").cast("long").alias("n"))


@query(
    "recall_expand_deep",
    SEMANTIC
    + ranked_sql()
    + expansion_sql("best", "best", 1.0, 1000)
    + """,
f2 AS (SELECT qid, id, n AS rank FROM x1),
s2 AS (SELECT qid, id FROM best UNION SELECT qid, id FROM x0),"""
    + expansion_sql("f2", "s2", 1.0, 1000).replace("x0", "y0").replace("x1", "y1").lstrip(",")
    + """ SELECT qid, id, hop, score, n FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hop, n0) AS n
    FROM (SELECT qid, id, 1 AS hop, 0.7::DOUBLE AS score, n AS n0 FROM x1 UNION ALL SELECT qid, id, 2, 0.7::DOUBLE * 0.5::DOUBLE, n FROM y1))
  WHERE n <= 6""",
)
def recall_expand_deep(t: Tables):
    """Two hops with decay, all relations but none weighing more, six rows a query."""
    spec = R.Expand(rels=("refines", "example_of"), depth=2, cap=6, score=0.7, decay=0.5)
    found = R.expand(semantic(t), t.e, t.m, R.eligible(NOW), spec)
    return found.select("qid", "id", "hop", "score", F.col("n").cast("long").alias("n"))


@query(
    "union_expansion",
    SEMANTIC
    + ranked_sql()
    + expansion_sql("best", "best", 0.7)
    + " SELECT qid, id, round(score, 6) AS score FROM best UNION ALL SELECT qid, id, round(score, 6) FROM x1",
)
def union_expansion(t: Tables):
    found = semantic(t)
    more = R.expand(found, t.e, t.m, R.eligible(NOW))
    return found.select("qid", "id", r6("score").alias("score")).unionByName(more.select("qid", "id", r6("score").alias("score")))


@query(
    "recall_expand_rerank",
    SEMANTIC
    + ranked_sql()
    + expansion_sql("best", "sc", 0.7)
    + """,
tp AS (SELECT qid, max(score) AS best, max(pool_pos) AS size FROM sc GROUP BY qid),
un AS (SELECT qid, id, score, pool_pos FROM sc UNION ALL SELECT qid, id, score * best, size + n FROM x1 JOIN tp USING (qid))
SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pool_pos) AS rank FROM un) WHERE rank <= 5""",
)
def recall_expand_rerank(t: Tables):
    """What the best lead to competes with the pool before the cut."""
    rows = t.pool(20).join(t.m, "id").where(R.eligible(NOW)).withColumn("score", F.col("cosine") + 0.05 * F.col("polarity"))
    rows = rows.select("qid", "id", "score", "pool_pos")
    return hits(R.top(R.expand_reranked(rows, 5, t.e, t.m, R.eligible(NOW)), 5))


@query(
    "recall_touch",
    SEMANTIC
    + ranked_sql()
    + """ SELECT m.id, m.access_count + coalesce(n, 0) AS access_count, CASE WHEN n IS NULL THEN last_accessed ELSE 1700000000::DOUBLE END AS last_accessed
    FROM m LEFT JOIN (SELECT id, count(*) AS n FROM best GROUP BY id) h ON h.id = m.id""",
)
def recall_touch(t: Tables):
    """A recall's hits as a delta, merged with the rows on reading."""
    return D.merged(t.m, D.delta(semantic(t), NOW, 1)).select("id", "access_count", "last_accessed")


@query(
    "touch_delta",
    SEMANTIC + ranked_sql() + " SELECT id, count(*) AS n, 1700000000::DOUBLE AS at, 7::BIGINT AS seq FROM best GROUP BY id",
)
def touch_delta(t: Tables):
    """What a recall writes: a row for each memory it hit."""
    return D.delta(semantic(t), NOW, 7)


@query(
    "touch_batches",
    """,
    tb AS (SELECT 'm' || lpad(((event_id * 13) % n)::VARCHAR, 8, '0') AS id, event_id // 64 AS seq FROM events, nn),
    ts AS (SELECT id, count(*) AS n, 1700000000 - max_by((seq * 7919) % 1000, seq) AS last_ FROM tb GROUP BY id)
    SELECT m.id, access_count + coalesce(n, 0) AS access_count, coalesce(last_, last_accessed)::DOUBLE AS last_accessed FROM m LEFT JOIN ts USING (id)""",
)
def touch_batches(t: Tables):
    """A batch for every 64 events, whose times aren't in order: the first half is folded
    into the rows, of the rest some are merged with each other, and reading meets them all."""
    events = t.read("events").select(name_of((F.col("event_id") * 13) % t.sizes[0]).alias("id"), F.floor(F.col("event_id") / 64).alias("seq"))
    deltas = events.groupBy("id", "seq").agg(F.count("*").alias("n")).select("id", "n", (NOW - (F.col("seq") * 7919) % 1000).cast("double").alias("at"), "seq")
    last = events.agg(F.max("seq")).first()[0]
    rows, left = D.folded(t.m, deltas, last // 2)
    some = F.col("seq") % 2 == 0
    return D.merged(rows, D.summed(left.where(some)).unionByName(left.where(~some))).select("id", "access_count", "last_accessed")


# --- lexical reach -----------------------------------------------------------------


def newcomers_sql(limit: int | None) -> str:
    """nw(qid, id, seen): rows beyond the pool that hold one of a query's longest words."""
    cut = "" if limit is None else f"WHERE i <= {limit}"
    last = "" if limit is None else f"AND seen <= {limit}"
    return f""",
pr AS (SELECT qid, unnest(list_distinct(list_filter({tok("qtext")}, lambda w: length(w) >= 3))) AS w FROM q),
pb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY length(w) DESC, w) AS n FROM pr) WHERE n <= 4),
fd AS (SELECT qid, m.id, n, row_number() OVER (PARTITION BY qid, n ORDER BY m.id) AS i FROM pb JOIN m ON contains(m.text, w)),
fe AS (SELECT qid, id, min(n) AS n FROM fd {cut} GROUP BY ALL),
ff AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n, id) AS seen FROM fe),
nw AS (SELECT qid, id, seen FROM ff WHERE NOT EXISTS (SELECT 1 FROM pool p WHERE p.qid = ff.qid AND p.id = ff.id) {last})"""


@query("join_pool_lexical_union", pool_sql() + newcomers_sql(None) + " SELECT qid, id, 'lexical' AS lane FROM nw UNION ALL SELECT qid, id, 'pool' FROM pool")
def join_pool_lexical_union(t: Tables):
    pool = t.pool(20)
    new = R.lexical_newcomers(pool, t.m, t.q)
    return pool.select("qid", "id", F.lit("pool").alias("lane")).unionByName(new.select("qid", "id", F.lit("lexical").alias("lane")))


@query("union_lexical", pool_sql(5) + newcomers_sql(5) + " SELECT qid, id, seen FROM nw")
def union_lexical(t: Tables):
    """With a limit: each probe's first five rows, and of all found the first five."""
    return R.lexical_newcomers(t.pool(5), t.m, t.q, limit=5).select("qid", "id", F.col("seen").cast("long").alias("seen"))


@query("union_lexical_index", pool_sql(5) + newcomers_sql(5) + " SELECT qid, id, seen FROM nw")
def union_lexical_index(t: Tables):
    """The same by an index of grams in place of a scan."""
    index = trigrams.build(t.m, f"{Scratch(t.spark).root}/grams", 4096)
    found = R.lexical_newcomers(t.pool(5), t.m, t.q, limit=5, finder=lambda words: trigrams.first_containing(index, words, 5))
    return found.select("qid", "id", F.col("seen").cast("long").alias("seen"))


@query(
    "content_contains_index",
    f""",
    pw AS (SELECT DISTINCT unnest({tok("qtext")}) AS w FROM q UNION SELECT unnest(['th', 'a', 'nowhere to be found', '. ']))
    SELECT w, count(*) AS n, min(m.id) AS first_id, max(m.id) AS last_id FROM pw JOIN m ON contains(m.text, w) GROUP BY w""",
)
def content_contains_index(t: Tables):
    """Which rows hold each word of each query, and some short or absent strings."""
    index = trigrams.build(t.m, f"{Scratch(t.spark).root}/grams", 4096)
    words = t.q.select(F.explode(S.tokenize(F.col("qtext"))).alias("w")).unionAll(strings(t.spark, "th", "a", "nowhere to be found", ". ").withColumnRenamed("id", "w"))
    lists = trigrams.holding(index, words)[0].select("w", F.size("ids").alias("n"), F.array_min("ids").alias("first_id"), F.array_max("ids").alias("last_id"))
    return lists.groupBy("w").agg(F.sum("n").cast("long").alias("n"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))


CORPUS = pool_sql() + newcomers_sql(20) + f""",
p0 AS (SELECT qid, id, cosine, pool_pos FROM pool UNION ALL
  SELECT nw.qid, nw.id, {cos("qx", "x")}, 20 + seen FROM nw JOIN m ON m.id = nw.id JOIN v ON v.vec_id = m.vec_id JOIN q ON q.qid = nw.qid)"""


@query(
    "recall_lexical_corpus",
    CORPUS + (LEXICAL + SIGNALS + WEIGHTED).replace("FROM pool", "FROM p0").replace("pool.", "p0.") + SCORED + ranked_sql() + HITS,
)
def recall_lexical_corpus(t: Tables):
    """Hybrid over the pool and the rows that only words reach, with their own cosine."""
    pool = R.corpus_pool(t.pool(20), t.m, t.v, t.q, 20)
    return hits(R.top(hybrid(t, pool=pool).where(R.eligible(NOW)), 5))


# --- selection -------------------------------------------------------------------------


def greedy_sql(k: int, lam: float | None, dedup: float | None) -> str:
    """Greedy selection from sc(qid, id, pool_pos, score), step by step."""
    sql = f""",
g AS (SELECT sc.*, x, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pool_pos) AS o,
  CASE WHEN max(score) OVER w - min(score) OVER w <= 1e-12 THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS rel
  FROM sc JOIN m ON m.id = sc.id JOIN v ON v.vec_id = m.vec_id WINDOW w AS (PARTITION BY qid)),
k0 AS (SELECT qid, id, x, score, 0 AS rank FROM g WHERE FALSE)"""
    for i in range(1, k + 1):
        near = f"(SELECT max({cos('g.x', 'z.x')}) FROM k{i - 1} z WHERE z.qid = g.qid)"
        value = "rel" if lam is None else f"{lam}::DOUBLE * rel - {1 - lam}::DOUBLE * coalesce(near, 0)"
        fresh = "" if dedup is None else f" AND coalesce(near, -1) < {dedup}::DOUBLE"
        sql += f""",
c{i} AS (SELECT g.*, {near} AS near FROM g WHERE NOT EXISTS (SELECT 1 FROM k{i - 1} z WHERE z.qid = g.qid AND z.id = g.id)),
k{i} AS (SELECT * FROM k{i - 1} UNION ALL SELECT qid, id, x, score, {i} FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {value} DESC, o) AS r FROM c{i} WHERE TRUE{fresh}) WHERE r = 1)"""
    return sql + f" SELECT qid, id, round(score, 6) AS score, rank::BIGINT AS rank FROM k{k}"


def _with_vectors(rows: DataFrame, t: Tables) -> DataFrame:
    return rows.join(t.v.select("vec_id", "x"), "vec_id", "left")


def _selected(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", r6("score"))


@query("recall_mmr", HYBRID + SCORED + greedy_sql(5, 0.7, None))
def recall_mmr(t: Tables):
    return _selected(R.diversify(_with_vectors(hybrid(t).where(R.eligible(NOW)), t), 5, lam=0.7))


@query("recall_dedup", HYBRID + SCORED + greedy_sql(5, None, 0.3))
def recall_dedup(t: Tables):
    return _selected(R.diversify(_with_vectors(hybrid(t).where(R.eligible(NOW)), t), 5, dedup=0.3))


def _semantic_pool(t: Tables, n: int) -> DataFrame:
    rows = t.pool(n).join(t.m, "id").where(R.eligible(NOW))
    return _with_vectors(rows.withColumn("score", F.col("cosine") + 0.05 * F.col("polarity")), t)


@query("mmr_select", pool_sql(30) + semantic_sql(CURRENT) + greedy_sql(3, 0.5, 0.6))
def mmr_select(t: Tables):
    """Both at once: near copies are out, and what is left is spread."""
    return _selected(R.diversify(_semantic_pool(t, 30), 3, lam=0.5, dedup=0.6))


@query("dedup_threshold", pool_sql(30) + semantic_sql(CURRENT) + greedy_sql(4, None, 0.2))
def dedup_threshold(t: Tables):
    return _selected(R.diversify(_semantic_pool(t, 30), 4, dedup=0.2))


# --- packing -----------------------------------------------------------------------------

LINE = """'- (' || m.type || ')' || CASE WHEN m.pinned AND m.trust <> 'trusted' THEN ' [pinned, ' || m.trust || ']'
    WHEN m.pinned THEN ' [pinned]' WHEN m.trust <> 'trusted' THEN ' [' || m.trust || ']' ELSE '' END || ' ' || m.text"""


def cost_sql(text: str) -> str:
    return f"greatest(1, round_even(length({text}) / 4::DOUBLE, 0))::BIGINT"


def pack_sql(budget: int) -> str:
    """pk(qid, rank, used, fits) of ln(qid, id, rank, cost), in rank order."""
    return f""",
pk(qid, rank, used, fits) AS (
  SELECT qid, 0::BIGINT, 0::BIGINT, FALSE FROM (SELECT DISTINCT qid FROM ln)
  UNION ALL SELECT pk.qid, ln.rank, (CASE WHEN pk.used + ln.cost <= {budget} THEN pk.used + ln.cost ELSE pk.used END)::BIGINT, pk.used + ln.cost <= {budget}
  FROM pk JOIN ln ON ln.qid = pk.qid AND ln.rank = pk.rank + 1)"""


def _priced(rows: DataFrame) -> DataFrame:
    line = S.pack_line(F.col("text"), F.col("type"), F.col("pinned"), F.col("trust"))
    return rows.withColumn("cost", S.estimate_tokens(line).cast("long")).withColumn("rank", F.col("rank").cast("int"))


def _taken(packed: DataFrame) -> DataFrame:
    return packed.where("fits").select("qid", "id", F.col("rank").cast("long").alias("rank"), "cost")


TAKEN = " SELECT qid, id, rank, cost FROM pk JOIN ln USING (qid, rank) WHERE fits"
LINES = f", ln AS (SELECT b.qid, b.id, b.rank, {cost_sql(LINE)} AS cost FROM best b JOIN m ON m.id = b.id)"


@query("pack_greedy", SEMANTIC + ranked_sql(20) + LINES + pack_sql(800) + TAKEN)
def pack_greedy(t: Tables):
    return _taken(R.pack(_priced(semantic(t, k=20)), 800))


PINNED = f""",
pn1 AS (SELECT id, created_at FROM m WHERE pinned AND {ACTIVE} AND trust <> 'untrusted'),
fr AS (SELECT qid, id, 0 AS c, -created_at AS o, top FROM (SELECT qid, max(score) AS top FROM best GROUP BY qid), pn1
  UNION ALL SELECT qid, id, 1, rank, score FROM best WHERE id NOT IN (SELECT id FROM pn1)),
pp AS (SELECT qid, id, top AS score, row_number() OVER (PARTITION BY qid ORDER BY c, o, id) AS rank FROM fr)"""


@query("prepend_pinned", SEMANTIC + ranked_sql(5) + PINNED + " SELECT qid, id, round(score, 6) AS score, rank FROM pp")
def prepend_pinned(t: Tables):
    """Standing instructions first, newest first, as good as the best hit; none twice."""
    return hits(R.prepend_pinned(semantic(t), t.m, NOW, "reported"))


PACKED = pool_sql(50) + LEXICAL + SIGNALS + WEIGHTED + SCORED + ranked_sql(50) + PINNED + LINES.replace("best b", "pp b") + pack_sql(800)


def _recall_pack(t: Tables) -> DataFrame:
    ranked = R.top(hybrid(t, n=50).where(R.eligible(NOW)), 50).select("qid", "id", "score", "rank")
    ranked = R.prepend_pinned(ranked, t.m, NOW, "reported")
    return R.pack(_priced(ranked.join(t.m, "id")), 800)


@query("recall_pack", PACKED + TAKEN)
def recall_pack(t: Tables):
    """Hybrid recall of fifty, the pinned before them, packed into 800 tokens."""
    return _taken(_recall_pack(t))


@query("pack_compress")
def pack_compress(t: Tables):
    """Summaries of groups of what didn't fit into 300 tokens."""
    return R.compress(R.pack(_priced(semantic(t, k=20)), 300), 300, threshold=0.1)


@query("token_counter", SEMANTIC + ranked_sql(20) + LINES.replace(cost_sql(LINE), f"(length({LINE}) + 2) // 3") + pack_sql(900) + TAKEN)
def token_counter(t: Tables):
    """Packing with another count of tokens: three characters each."""
    line = S.pack_line(F.col("text"), F.col("type"), F.col("pinned"), F.col("trust"))
    rows = semantic(t, k=20).withColumn("cost", F.floor((F.length(line) + 2) / 3).cast("long")).withColumn("rank", F.col("rank").cast("int"))
    return _taken(R.pack(rows, 900))


def _fanned(t: Tables) -> DataFrame:
    """task, qid, qtext, qx: each task's fan-out queries; vectors go by place, as the
    derived tables have none for phrases."""
    _, e = t.sizes
    tasks = t.q.select(F.col("qid").alias("task"), F.posexplode(S.fanout_queries(F.col("qtext"))).alias("pos", "qtext"))
    rows = tasks.withColumn("qid", F.col("task") * 10 + F.col("pos")).withColumn("vec_id", (F.col("task") * 13 + F.col("pos") * 7) % e)
    return rows.join(t.v.select("vec_id", F.col("x").alias("qx")), "vec_id").select("task", "qid", "qtext", "qx")


#: The fan-out queries take the place of the queries' relation.
FANNED = (
    phrases_sql("q0", "qid", "qtext")
    + """,
fl AS (SELECT qid AS id, trim(regexp_replace(lower(qtext), '\\s+', ' ', 'g')) AS flat FROM q0),
fan AS (SELECT qid AS task, 0 AS pos, qtext FROM q0
  UNION ALL SELECT ph.id, row_number() OVER (PARTITION BY ph.id ORDER BY n), p FROM ph JOIN fl ON fl.id = ph.id WHERE p <> flat),
q AS (SELECT task * 10 + pos AS qid, task, qtext, x AS qx, v.vec_id, label FROM fan, ee JOIN v ON v.vec_id = (task * 13 + pos * 7) % e)"""
)
CONTEXT = f""",
per AS (SELECT task, id, max(score) AS score FROM best JOIN q ON q.qid = best.qid GROUP BY ALL),
bt AS (SELECT task AS qid, id, score, row_number() OVER (PARTITION BY task ORDER BY score DESC, id) AS rank FROM per),
ln AS (SELECT b.qid, b.id, b.rank, {cost_sql(LINE)} AS cost FROM bt b JOIN m ON m.id = b.id)"""


@query("auto_context")
def auto_context(t: Tables):
    """A context a task: hybrid recall of ten for the task and each key phrase, each
    row's best score, packed into 800 tokens."""
    q = _fanned(t)
    w = R.Weights()
    rows = R.signals(R.vector_pool(t.m, t.v, q, 40), t.m, q, NOW, w).where("superseded_by = ''")
    best = R.top(R.weighted(rows, w).where(R.eligible(NOW)), 10)
    per = best.join(q.select("qid", "task"), "qid").groupBy("task", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    ranked = per.withColumnRenamed("task", "qid").withColumn("rank", F.row_number().over(order))
    return _taken(R.pack(_priced(ranked.join(t.m, "id")), 800))


ORACLES["auto_context"] = (
    DUCK.replace("\nq AS (", "\nq0 AS (")
    + FANNED
    + pool_sql(40)
    + LEXICAL
    + SIGNALS
    + WEIGHTED
    + SCORED
    + ranked_sql(10)
    + CONTEXT
    + pack_sql(800)
    + TAKEN
)


@query(
    "recall_reranker",
    pool_sql(10)
    + """ SELECT qid, id, first_rank, new_rank FROM (
    SELECT qid, pool.id, pool_pos AS first_rank, row_number() OVER (PARTITION BY qid ORDER BY length(text) DESC, pool_pos) AS new_rank
    FROM pool JOIN m ON m.id = pool.id) WHERE new_rank <= 3""",
)
def recall_reranker(t: Tables):
    """A reranker function sees a query's whole pool: here the longest texts win."""
    rows = t.pool(10).join(t.m.select("id", "text"), "id")
    rows = Y.rescored(rows, lambda pdf: pdf.text.str.len()).where("new_rank <= 3")
    return rows.select("qid", "id", F.col("first_rank").cast("long").alias("first_rank"), F.col("new_rank").cast("long").alias("new_rank"))


@query(
    "rerank_positions",
    pool_sql(10)
    + """ SELECT qid, pool.id, pool_pos AS first_rank, row_number() OVER (PARTITION BY qid ORDER BY importance DESC, pool_pos) AS new_rank
    FROM pool JOIN m ON m.id = pool.id""",
)
def rerank_positions(t: Tables):
    rows = Y.rescored(t.pool(10).join(t.m, "id"), F.col("importance"))
    return rows.select("qid", "id", F.col("first_rank").cast("long").alias("first_rank"), F.col("new_rank").cast("long").alias("new_rank"))


# --- evaluation --------------------------------------------------------------------------

GOLD = """,
g AS (SELECT qid, id FROM (
    SELECT q.qid, m.id, row_number() OVER (PARTITION BY q.qid ORDER BY m.id) AS n
    FROM q JOIN v ON v.label = q.label JOIN m ON m.vec_id = v.vec_id) WHERE n <= 10)"""


def metrics_sql(hits_: str, k: int) -> str:
    """ev(qid, recall, precision, rr, ap, ndcg) of ``hits_(qid, id, r)``."""
    return f""",
h AS (SELECT x.qid, x.id, x.r, (g.id IS NOT NULL)::INT AS rel FROM {hits_} x LEFT JOIN g ON g.qid = x.qid AND g.id = x.id WHERE x.r <= {k}),
c AS (SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY r) AS seen FROM h), n AS (SELECT qid, count(*) AS n FROM g GROUP BY qid),
ev AS (
  SELECT n.qid, round(coalesce(sum(rel) / max(n)::DOUBLE, 0), 6) AS recall, round(coalesce(sum(rel) / nullif(count(r), 0)::DOUBLE, 0), 6) AS precision,
    round(coalesce(1 / min(CASE WHEN rel = 1 THEN r END)::DOUBLE, 0), 6) AS rr, round(coalesce(sum(rel * seen / r::DOUBLE) / max(n), 0), 6) AS ap,
    round(coalesce(sum(rel / log2(r + 1)) / (SELECT sum(1 / log2(i + 1)) FROM range(1, {k + 1}) t(i) WHERE i <= max(n)), 0), 6) AS ndcg
  FROM n LEFT JOIN c ON c.qid = n.qid GROUP BY n.qid)"""


def gold(t: Tables) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("id")
    every = t.q.select("qid", "label").join(t.v.select("vec_id", "label"), "label").join(t.m.select("id", "vec_id"), "vec_id")
    return every.withColumn("n", F.row_number().over(order)).where("n <= 10").select("qid", "id")


POOL10 = ", px AS (SELECT qid, id, pool_pos AS r FROM pool)"


def _evaluated(t: Tables) -> DataFrame:
    return L.metrics(t.pool(10).select("qid", "id", F.col("pool_pos").alias("rank")), gold(t), 10)


@query("evaluate", pool_sql(10) + GOLD + POOL10 + metrics_sql("px", 10) + " SELECT * FROM ev")
def evaluate(t: Tables):
    return _evaluated(t)


def _as(sql: str, **names: str) -> str:
    for old, new in names.items():
        sql = sql.replace(f"{old} AS", f"{new} AS").replace(f"FROM {old}", f"FROM {new}")
    return sql


OWN_K = "[3, 5, 10][{0} % 3 + 1]"


@query(
    "evaluate_cases",
    HYBRID
    + _as(semantic_sql(CURRENT) + ranked_sql(10), sc="sa", best="ba")
    + SCORED
    + ranked_sql(10)
    + GOLD
    + f""",
px AS (SELECT qid, id, rank AS r FROM best WHERE qid % 2 = 1 AND rank <= {OWN_K.format("qid")}
  UNION ALL SELECT qid, id, rank FROM ba WHERE qid % 2 = 0 AND rank <= {OWN_K.format("qid")})"""
    + metrics_sql("px", 10).replace("WHERE i <= max(n))", f"WHERE i <= least(max(n), {OWN_K.format('n.qid')}))")
    + " SELECT * FROM ev",
)
def evaluate_cases(t: Tables):
    """Each case with a k and a mode of its own: three, five or ten of a semantic or a hybrid recall."""
    cases = gold(t).withColumn("k", F.get(F.array(F.lit(3), F.lit(5), F.lit(10)), (F.col("qid") % 3).cast("int")))
    even = semantic(t, k=10).where("qid % 2 = 0").select("qid", "id", "rank")
    odd = R.top(hybrid(t).where(R.eligible(NOW)), 10).where("qid % 2 = 1").select("qid", "id", "rank")
    return L.metrics(even.unionByName(odd), cases, 5)


@query("agg_eval_macro", pool_sql(10) + GOLD + POOL10 + metrics_sql("px", 10) + " SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("recall", "precision", "rr", "ap", "ndcg")) + " FROM ev")
def agg_eval_macro(t: Tables):
    return _evaluated(t).agg(*(r6(F.avg(c)).alias(c) for c in ("recall", "precision", "rr", "ap", "ndcg")))


@query("eval_metrics", HYBRID + SCORED + ranked_sql(5) + GOLD + ", px AS (SELECT qid, id, rank AS r FROM best)" + metrics_sql("px", 5) + " SELECT * FROM ev")
def eval_metrics(t: Tables):
    """Of hybrid recall, at five."""
    found = R.top(hybrid(t).where(R.eligible(NOW)), 5)
    return L.metrics(found.select("qid", "id", "rank"), gold(t), 5)


@query("join_goldset", pool_sql(10) + GOLD + " SELECT pool.qid, pool.id FROM pool JOIN g ON g.qid = pool.qid AND g.id = pool.id")
def join_goldset(t: Tables):
    return t.pool(10).select("qid", "id").join(gold(t), ["qid", "id"], "left_semi")


@query("first_relevant_rank", pool_sql(10) + GOLD + " SELECT pool.qid, min(pool_pos) AS rank FROM pool JOIN g ON g.qid = pool.qid AND g.id = pool.id GROUP BY pool.qid")
def first_relevant_rank(t: Tables):
    return t.pool(10).join(gold(t), ["qid", "id"], "left_semi").groupBy("qid").agg(F.min("pool_pos").cast("long").alias("rank"))

"""What the queries share: the derived tables, registration, and pieces of their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import recall as R
from ..scratch import shared_dir
from . import fixture as X
from .fixture import DUCK, NOW

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """m(emories), v(ectors), e(dges), q(ueries), j(ournal), t(rash) of one folder."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d, self._sizes = spark, d, None

    @property
    def sizes(self) -> tuple[int, int]:
        self._sizes = self._sizes or X.sizes(self.spark, self.d)
        return self._sizes

    def __getattr__(self, name: str) -> DataFrame:
        make = {
            "m": lambda: X.memories(self.spark, self.d, *self.sizes),
            "v": lambda: X.vectors(self.spark, self.d),
            "e": lambda: X.edges(self.spark, self.d, self.sizes[0]),
            "q": lambda: X.queries(self.spark, self.d, self.sizes[1]),
            "j": lambda: X.journal(self.spark, self.d),
            "t": lambda: X.trash(self.spark, self.d),
        }
        if name not in make:
            raise AttributeError(name)
        made = make[name]()
        setattr(self, name, made)
        return made

    def read(self, name: str) -> DataFrame:
        return X.read(self.spark, self.d, name)

    def embedded(self, where=None) -> DataFrame:
        m = self.m if where is None else self.m.where(where)
        return m.join(self.v.select("vec_id", "x"), "vec_id")

    def pool(self, n: int, where=None) -> DataFrame:
        return R.vector_pool(self.m if where is None else self.m.where(where), self.v, self.q, n)

    def file(self, lines: DataFrame, gz: bool = False, name: str = "") -> str:
        """Writes lines of text to the shared folder, to be read back by a source."""
        path = f"{shared_dir(self.spark)}/file-{uuid.uuid4().hex}{name}"
        lines.write.option("compression", "gzip" if gz else "none").text(path)
        return path


def query(name: str, sql: str | None = None):
    """Registers a function of Tables; ``sql`` is its oracle, after the derived tables."""

    def add(f):
        QUERIES[name] = lambda spark, d: f(Tables(spark, d))
        if sql is not None:
            ORACLES[name] = DUCK + sql
        return f

    return add


def r6(c) -> Column:
    return F.round(c, 6)


def joined(c) -> Column:
    return F.array_join(c, ",")


def strings(spark: SparkSession, *rows) -> DataFrame:
    return spark.createDataFrame([(r,) for r in rows], "id string")


# --- pieces of SQL ---------------------------------------------------------------

LIVE = "(m.expires_at = 0 OR m.expires_at > 1700000000)"
ACTIVE = f"m.superseded_by = '' AND {LIVE}"
VALID_NOW = "(m.valid_from = 0 OR m.valid_from <= 1700000000) AND (m.valid_until = 0 OR 1700000000 < m.valid_until)"
#: Rows that a recall may return, of all and of those that aren't superseded.
HELD = f"{LIVE} AND {VALID_NOW}"
CURRENT = f"{ACTIVE} AND {VALID_NOW}"
RANK = "CASE {0} WHEN 'reported' THEN 1 WHEN 'untrusted' THEN 2 ELSE 0 END"
TRUSTS = "['trusted','reported','untrusted']"
NEGATIVE = "('not','never','no','dont','doesnt','wont','shouldnt','cant','without','avoid','neither','nor','nothing','nobody','nowhere','none')"
DECAY = "importance * exp(-0.1::DOUBLE * greatest(0, (1700000000 - last_accessed) / 86400::DOUBLE))"


def tok(text: str = "text") -> str:
    return f"regexp_extract_all(regexp_replace(lower({text}), '[''’]', '', 'g'), '[\\p{{L}}\\p{{N}}_]+')"


def cos(a: str, b: str) -> str:
    return f"(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"


def pool_sql(n: int = 20, where: str = "TRUE") -> str:
    """pool(qid, qtext, id, cosine, pool_pos): each query's n nearest where ``where`` holds."""
    return f""",
cand AS (SELECT qid, qtext, m.id, {cos("qx", "x")} AS cosine FROM q, m JOIN v ON v.vec_id = m.vec_id WHERE {where}),
pool AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) AS pool_pos FROM cand)
  WHERE pool_pos <= {n})"""


#: tf, dl, dfr, qt and bm(qid, id, lex) with best, the whole pool's highest raw score.
LEXICAL = f""",
tk AS (SELECT pool.qid, m.id, unnest({tok()}) AS t FROM pool JOIN m ON m.id = pool.id),
tf AS (SELECT qid, id, t, count(*)::DOUBLE AS f FROM tk GROUP BY ALL),
dl AS (SELECT qid, id, count(*)::DOUBLE AS dl FROM tk GROUP BY ALL),
qt AS (SELECT DISTINCT qid, unnest({tok("qtext")}) AS t FROM q),
pn AS (
  SELECT p.qid, count(*)::DOUBLE AS n, sum(coalesce(dl, 0)) / count(*)::DOUBLE AS avgdl
  FROM pool p LEFT JOIN dl USING (qid, id) GROUP BY p.qid),
dfr AS (SELECT qid, t, count(*)::DOUBLE AS df FROM tf GROUP BY ALL),
raw AS (
  SELECT tf.qid, tf.id, sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * f * 2.5::DOUBLE
    / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / greatest(avgdl, 1)))) AS s
  FROM tf JOIN qt USING (qid, t) JOIN dfr USING (qid, t) JOIN dl USING (qid, id) JOIN pn USING (qid) GROUP BY ALL),
top1 AS (SELECT qid, max(s) AS best FROM raw GROUP BY qid),
bm AS (
  SELECT pool.qid, pool.id, round(CASE WHEN best > 0 THEN coalesce(s, 0) / best ELSE 0 END, 12) AS lex, coalesce(best, 0) > 0 AS matched
  FROM pool LEFT JOIN raw USING (qid, id) LEFT JOIN top1 ON top1.qid = pool.qid)"""

#: si: the signals of pool rows that aren't superseded. The matches are the whole pool's.
SIGNALS = """,
si AS (
  SELECT pool.qid, pool.id, pool_pos, cosine, lex, matched, importance, polarity, expires_at, pinned, trust, type, text, vec_id,
    valid_from, valid_until,
    exp(-0.1::DOUBLE * greatest(0, (1700000000 - created_at) / 86400::DOUBLE)) AS rec
  FROM pool JOIN m ON m.id = pool.id JOIN bm ON bm.qid = pool.qid AND bm.id = pool.id WHERE superseded_by = '')"""

#: sw: si with base, the weighted score.
WEIGHTED = """,
sw AS (
  SELECT *, CASE WHEN matched THEN 1::DOUBLE ELSE 1 / 0.8::DOUBLE END
      * (0.55::DOUBLE * cosine + 0.15::DOUBLE * rec + 0.1::DOUBLE * importance)
    + 0.2::DOUBLE * lex + 0.05::DOUBLE * polarity AS base FROM si)"""


def semantic_sql(where: str) -> str:
    """sc(qid, id, pool_pos, score) of pool rows where ``where`` holds."""
    return f""",
sc AS (
  SELECT qid, pool.id, pool_pos, cosine + 0.05::DOUBLE * polarity AS score
  FROM pool JOIN m ON m.id = pool.id WHERE {where})"""


def ranked_sql(k: int = 5) -> str:
    """best(qid, id, score, rank): the k best of sc."""
    return f""",
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pool_pos) AS rank FROM sc)
  WHERE rank <= {k})"""


HITS = " SELECT qid, id, round(score, 6) AS score, rank FROM best"


def hits(rows: DataFrame) -> DataFrame:
    return rows.select("qid", "id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


def semantic(t: Tables, where=None, k: int = 5, n: int = 20, **fine) -> DataFrame:
    rows = t.pool(n, where).join(t.m, "id").where(R.eligible(NOW, **fine))
    return R.top(rows.withColumn("score", F.col("cosine") + 0.05 * F.col("polarity")), k)


def hybrid(t: Tables, fusion: str = "weighted", w: R.Weights = R.Weights(), n: int = 20, where=None, pool: DataFrame | None = None) -> DataFrame:
    """A scored pool without superseded rows; what is expired is still in it."""
    rows = R.signals(t.pool(n, where) if pool is None else pool, t.m, t.q, NOW, w).where("superseded_by = ''")
    return R.weighted(rows, w, t.e) if fusion == "weighted" else R.reciprocal_ranks(rows, w, t.e)


def decay() -> Column:
    return S.decay(F.col("importance"), F.col("last_accessed"), F.col("access_count"), NOW)

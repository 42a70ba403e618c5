"""Ranked retrieval for a batch of queries at once.

A pool holds each query's nearest memories after the metadata filter; signals, ranks
and fusion are windows over the pool, and eligibility comes after scoring, so that it
doesn't shift the statistics. Every order ends in pool position or id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..scratch import Scratch

#: Queries that are sent to every task at once, and probe words; more go in slices.
QUERIES_AT_ONCE = 10_000
WORDS_AT_ONCE = 100_000
#: Queries whose products with a block of vectors are held at once.
ROWS_OF_PRODUCT = 256


@dataclass(frozen=True)
class Weights:
    cosine: float = 0.55
    lexical: float = 0.20
    recency: float = 0.15
    importance: float = 0.10
    polarity: float = 0.05
    graph: float = 0.0
    rate: float = 0.10

    def __post_init__(self):
        if min(self.cosine, self.lexical, self.recency, self.importance, self.graph) < 0 or self.core <= 0:
            raise ValueError("weights must not be negative, nor the core ones all zero")

    @property
    def core(self) -> float:
        return self.cosine + self.lexical + self.recency + self.importance


@dataclass(frozen=True)
class Expand:
    """Which links expansion follows, how far, how many rows a query, what they score."""

    rels: tuple[str, ...] = ("refines", "example_of")
    depth: int = 1
    cap: int = 5
    score: float = 0.70
    decay: float = 1.0


def _slices(frame: DataFrame, key: str, most: int) -> list[DataFrame]:
    """The frame in parts of about ``most`` rows, by a hash of ``key``."""
    n = frame.count()
    parts = -(-n // most)
    if parts <= 1:
        return [frame]
    parts += 1 + parts // 8  # room for uneven hashes
    return [frame.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)]


def _best(n: int, q: np.ndarray, v: np.ndarray, cos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's n best, with all that tie with the last of them."""
    order = np.lexsort((-cos, q))
    q, v, cos = q[order], v[order], cos[order]
    start = np.flatnonzero(np.diff(q, prepend=-1))
    size = np.diff(np.append(start, len(q)))
    last = cos[np.minimum(start + n, start + size) - 1]
    keep = cos >= np.repeat(last, size)
    return q[keep], v[keep], cos[keep]


def _nearest(vectors: DataFrame, batch: list, n: int, qid_type: str) -> DataFrame:
    """qid, vec_id, cosine of one slice of queries, sent to every task."""
    ids = pa.array([r.qid for r in batch])
    qx = np.array([r.qx for r in batch], dtype=np.float64)
    norms = np.sqrt((qx * qx).sum(axis=1))
    unit = qx / np.where(norms > 0, norms, 1)[:, None]
    vec_type = dict(vectors.dtypes)["vec_id"]

    def run(blocks):
        found, names = None, []
        base = 0
        for b in blocks:
            if not b.num_rows:
                continue
            x = np.array(b.column(1).flatten(), dtype=np.float64).reshape(b.num_rows, -1)
            own = np.sqrt((x * x).sum(axis=1))
            xu = x / np.where(own > 0, own, 1)[:, None]
            parts = [] if found is None else [found]
            for at in range(0, len(unit), ROWS_OF_PRODUCT):
                near = unit[at : at + ROWS_OF_PRODUCT] @ xu.T
                cut = np.partition(near, -n, axis=1)[:, [-n]] if near.shape[1] > n else near.min(axis=1, keepdims=True)
                # The product rounds otherwise than a plain sum: what is near the cut is confirmed.
                q, v = np.nonzero(near >= cut - 1e-9)
                q += at
                both = norms[q] * own[v]
                cos = np.divide((qx[q] * x[v]).sum(axis=1), both, out=np.zeros(len(q)), where=both > 0)
                parts.append((q, v + base, cos))
            names.append(b.column(0))
            base += b.num_rows
            found = _best(n, *(np.concatenate([p[i] for p in parts]) for i in range(3)))
        if found is not None:
            q, v, cos = found
            every = pa.chunked_array(names)
            yield pa.record_batch([ids.take(pa.array(q)), every.take(pa.array(v)).combine_chunks(), pa.array(cos)], names=["qid", "vec_id", "cosine"])

    return vectors.select("vec_id", "x").mapInArrow(run, f"qid {qid_type}, vec_id {vec_type}, cosine double")


def vector_pool(rows: DataFrame, vectors: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """qid, id, cosine, pool_pos: the n nearest of ``rows(id, vec_id)`` to each query.

    Exact. Each distinct vector in ``vectors(vec_id, x)`` that a row has is scored once:
    a task multiplies its block with the batch of ``queries(qid, qx)`` and returns its
    own n best of each, so the shuffle holds n vectors per query and task. Rows meet
    the n best vectors only. Vectors that are null, hold nulls or have another length
    than the queries are no neighbours. Queries beyond QUERIES_AT_ONCE go in slices.
    """
    queries = queries.select("qid", F.col("qx").cast("array<double>").alias("qx"))
    qid_type = dict(queries.dtypes)["qid"]
    dims = [r[0] for r in queries.select(F.size("qx")).distinct().limit(2).collect()]
    if len(dims) > 1:
        raise ValueError("queries must have vectors of one length")
    x = F.col("x").cast("array<double>")
    usable = vectors.select("vec_id", x.alias("x")).where((F.size("x") == (dims[0] if dims else -1)) & F.forall("x", lambda v: v.isNotNull()))
    usable = usable.join(rows.select("vec_id").distinct(), "vec_id", "left_semi")
    near = None
    for part in _slices(queries, "qid", QUERIES_AT_ONCE) if dims else []:
        if batch := part.collect():
            one = _nearest(usable, batch, n, qid_type)
            near = one if near is None else near.unionAll(one)
    if near is None:
        near = usable.select(F.lit(None).cast(qid_type).alias("qid"), "vec_id", F.lit(0.0).alias("cosine")).where("false")
    best = near.withColumn("r", F.rank().over(Window.partitionBy("qid").orderBy(F.desc("cosine")))).where(F.col("r") <= n).drop("r")
    order = Window.partitionBy("qid").orderBy(F.desc("cosine"), "id")
    pool = best.join(rows.select("id", "vec_id"), "vec_id").select("qid", "id", "cosine")
    pool = pool.withColumn("pool_pos", F.row_number().over(order)).where(F.col("pool_pos") <= n)
    # Statistics, ranks and joins read the pool again and again: n rows a query, written once.
    return Scratch(rows.sparkSession).keep(pool)


def within(rows: DataFrame, vectors: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """qid, n, best: how many of ``rows(id, vec_id)`` have a cosine of ``least`` or more with
    each of ``queries(qid, qx)``, and the greatest; queries without any have no row.

    Tasks multiply their vectors with the queries and return a count and a maximum a query,
    each vector weighing as many rows as share it; no pair of a query and a row is written.
    """
    queries = queries.select("qid", F.col("qx").cast("array<double>").alias("qx"))
    qid_type = dict(queries.dtypes)["qid"]
    weighed = vectors.select("vec_id", F.col("x").cast("array<double>").alias("x")).where(F.forall("x", lambda v: v.isNotNull()))
    weighed = weighed.join(rows.groupBy("vec_id").agg(F.count("*").alias("n")), "vec_id").select("x", "n")
    out = None
    for part in _slices(queries, "qid", QUERIES_AT_ONCE):
        batch = part.collect()
        if not batch:
            continue
        ids, qx = pa.array([r.qid for r in batch]), np.array([r.qx for r in batch], dtype=np.float64)
        norms = np.sqrt((qx * qx).sum(axis=1))

        def run(blocks, ids=ids, qx=qx, norms=norms):
            count, best = np.zeros(len(qx), dtype=np.int64), np.full(len(qx), -np.inf)
            unit = qx / np.where(norms > 0, norms, 1)[:, None]
            for b in blocks:
                fits = np.array(b.column(0).value_lengths()) == qx.shape[1]
                b = b.filter(pa.array(fits))
                if not b.num_rows:
                    continue
                x, weight = np.array(b.column(0).flatten(), dtype=np.float64).reshape(b.num_rows, -1), b.column(1).to_numpy()
                own = np.sqrt((x * x).sum(axis=1))
                xu = x / np.where(own > 0, own, 1)[:, None]
                for at in range(0, len(unit), ROWS_OF_PRODUCT):
                    q, v = np.nonzero(unit[at : at + ROWS_OF_PRODUCT] @ xu.T >= least - 1e-9)
                    q += at
                    both = norms[q] * own[v]
                    cos = np.divide((qx[q] * x[v]).sum(axis=1), both, out=np.zeros(len(q)), where=both > 0)
                    q, v, cos = q[cos >= least], v[cos >= least], cos[cos >= least]
                    np.add.at(count, q, weight[v])
                    np.maximum.at(best, q, cos)
            hit = np.flatnonzero(count)
            yield pa.record_batch([ids.take(pa.array(hit)), pa.array(count[hit]), pa.array(best[hit])], names=["qid", "n", "best"])

        one = weighed.mapInArrow(run, f"qid {qid_type}, n long, best double")
        out = one if out is None else out.unionAll(one)
    if out is None:
        out = queries.select("qid", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("best")).where("false")
    return out.groupBy("qid").agg(F.sum("n").alias("n"), F.max("best").alias("best"))


def bm25(pool: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """qid, id, lex in 0..1, matched for ``pool(qid, id, text)``, statistics from each
    pool; matched says whether any row of the query's pool has a word of it. Scores are
    rounded to 12 places, so that ties don't hang on the order of sums."""
    docs = pool.select("qid", "id", S.tokenize(F.col("text")).alias("toks")).withColumn("dl", F.size("toks").cast("double"))
    stats = docs.groupBy("qid").agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    tf = docs.select("qid", "id", "dl", F.explode("toks").alias("t")).groupBy("qid", "id", "dl", "t").agg(F.count("*").cast("double").alias("f"))
    wanted = queries.select("qid", F.explode(F.array_distinct(S.tokenize(F.col("qtext")))).alias("t"))
    tf = tf.join(wanted, ["qid", "t"]).withColumn("df", F.count("*").over(Window.partitionBy("qid", "t")).cast("double")).join(stats, "qid")
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    term = idf * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("dl") / F.greatest("avgdl", F.lit(1.0))))
    raw = tf.groupBy("qid", "id").agg(F.sum(term).alias("s"))
    top = F.max("s").over(Window.partitionBy("qid"))
    lex = F.coalesce(F.when(top > 0, F.col("s") / top), F.lit(0.0))
    return pool.select("qid", "id").join(raw, ["qid", "id"], "left").select("qid", "id", F.round(lex, 12).alias("lex"), F.coalesce(top > 0, F.lit(False)).alias("matched"))


def live(now: float, superseded: bool = False, expired: bool = False, min_trust: str | None = None, tag: str | None = None) -> Column:
    """What lists, pins, conflicts and upkeep see: rows that are neither superseded nor
    expired, whether or not they are true at present."""
    out = F.lit(True)
    if tag is not None:
        out = out & F.array_contains("tags", tag)
    if not superseded:
        out = out & (F.col("superseded_by") == "")
    if not expired:
        out = out & ((F.col("expires_at") == 0) | (F.col("expires_at") > now))
    if min_trust is not None:
        S.check_choice(min_trust, S.TRUST, "min_trust")
        out = out & (S.trust_rank(F.col("trust")) <= S.TRUST.index(min_trust))
    return out


def eligible(
    now: float,
    superseded: bool = False,
    expired: bool = False,
    min_trust: str | None = None,
    valid_at: float | None = None,
    tag: str | None = None,
) -> Column:
    """What a recall returns: live rows that are true at ``valid_at``, or else now. What
    was true at a moment may have been superseded since, so there that is no bar."""
    fine = live(now, superseded or valid_at is not None, expired, min_trust, tag)
    return fine & S.is_valid_at(F.col("valid_from"), F.col("valid_until"), F.lit(now if valid_at is None else valid_at))


def signals(pool: DataFrame, memories: DataFrame, queries: DataFrame, now: float, w: Weights) -> DataFrame:
    """The pool with its memories' columns and lex, matched, rec. Rows may be dropped
    afterwards: lex and matched are the whole pool's."""
    rows = pool.join(memories, "id")
    return rows.join(bm25(rows, queries), ["qid", "id"]).withColumn("rec", S.recency(F.col("created_at"), now, w.rate))


def graph_spread(rows: DataFrame, edges: DataFrame, seed: str, damping: float = 0.5, rounds: int = 3) -> DataFrame:
    """qid, id, spread in 0..1: activation spread over undirected links in the pool.

    Queries without a link inside their pool, or without spread, have no rows. The
    rounds read ``rows`` again and again, so it should be written down or cheap.
    """
    per = Window.partitionBy("qid")
    low, high = F.min(seed).over(per), F.max(seed).over(per)
    nodes = rows.select("qid", "id", F.when(high - low <= 1e-12, 1.0).otherwise((F.col(seed) - low) / (high - low)).alias("s"))
    nodes = nodes.select("qid", "id", (F.col("s") / F.sum("s").over(per)).alias("seed"))
    a, b = nodes.select("qid", F.col("id").alias("src")), nodes.select("qid", F.col("id").alias("dst"))
    inside = a.join(edges.select("src", "dst").distinct(), "src").join(b, ["qid", "dst"])
    both = inside.select("qid", "src", "dst").union(inside.select("qid", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = both.withColumn("deg", F.count("*").over(Window.partitionBy("qid", "src")))
    act = nodes.withColumn("act", F.col("seed"))
    for _ in range(rounds):
        sent = both.join(act.select("qid", F.col("id").alias("src"), "act"), ["qid", "src"])
        sent = sent.groupBy("qid", F.col("dst").alias("id")).agg(F.sum(F.col("act") / F.col("deg")).alias("got"))
        act = act.join(sent, ["qid", "id"], "left").select("qid", "id", "seed", ((1 - damping) * F.col("seed") + damping * F.coalesce("got", "act")).alias("act"))
    act = act.join(both.select("qid").distinct(), "qid", "left_semi")
    low, high = F.min("act").over(per), F.max("act").over(per)
    return act.select("qid", "id", F.when(high - low > 1e-12, F.round((F.col("act") - low) / (high - low), 12)).alias("spread")).where("spread IS NOT NULL")


def weighted(rows: DataFrame, w: Weights, edges: DataFrame | None = None) -> DataFrame:
    """Adds score. Where no row of a query's whole pool matches lexically, the other
    weights take over the lexical one's share."""
    scale = F.lit(1.0)
    if w.lexical > 0 and w.core > w.lexical:
        scale = F.when(F.col("matched"), 1.0).otherwise(w.core / (w.core - w.lexical))
    core = w.cosine * F.col("cosine") + w.recency * F.col("rec") + w.importance * F.col("importance")
    rows = rows.withColumn("score", scale * core + w.lexical * F.col("lex") + w.polarity * F.col("polarity"))
    if edges is not None and w.graph > 0:
        rows = Scratch(rows.sparkSession).keep(rows)
        spread = graph_spread(rows, edges, "score")
        rows = rows.join(spread, ["qid", "id"], "left").withColumn("score", F.col("score") + w.graph * F.coalesce("spread", F.lit(0.0)))
    return rows


def reciprocal_ranks(rows: DataFrame, w: Weights, edges: DataFrame | None = None, k: int = 60) -> DataFrame:
    """Adds score, the weighted sum of 1 / (k + rank) over the signals, ranks from 0.
    The graph is a signal of the queries in whose pool something spreads from cosine."""
    used = [("cosine", w.cosine, None), ("lex", w.lexical, None), ("rec", w.recency, None), ("importance", w.importance, None)]
    if edges is not None and w.graph > 0:
        rows = Scratch(rows.sparkSession).keep(rows)
        rows = rows.join(graph_spread(rows, edges, "cosine"), ["qid", "id"], "left").fillna(0.0, ["spread"])
        used.append(("spread", w.graph, F.max("spread").over(Window.partitionBy("qid")) > 0))
    score = w.polarity * F.col("polarity") / (k + 1)
    for name, weight, counts in used:
        if weight > 0:
            rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(name), "pool_pos")) - 1
            rows = rows.withColumn(f"rank_{name}", rank)
            part = weight / (k + F.col(f"rank_{name}"))
            if counts is not None:
                rows = rows.withColumn("_counts", counts)
                part = F.when(F.col("_counts"), part).otherwise(0.0)
            score = score + part
    return rows.withColumn("score", score).drop("_counts")


def top(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "pool_pos")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# --- lexical reach ---------------------------------------------------------------


def probes(queries: DataFrame, most: int = 4, shortest: int = 3) -> DataFrame:
    """qid, w, n: each query's longest words, longest first."""
    long = F.array_distinct(F.filter(S.tokenize(F.col("qtext")), lambda w: F.length(w) >= shortest))
    words = queries.select("qid", F.explode(long).alias("w"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.length("w")), "w")
    return words.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)


def containing(memories: DataFrame, words: DataFrame) -> DataFrame:
    """id, w: the rows of ``memories(id, text)`` whose text contains a word of ``words(w)``.

    All distinct words are searched for in one pass over the texts; more than
    WORDS_AT_ONCE go in several.
    """

    def finder(some: list[str]):
        def find(batches):
            import ahocorasick

            auto = ahocorasick.Automaton()
            for w in some:
                auto.add_word(w, w)
            auto.make_automaton()
            for b in batches:
                pairs = [(i, w) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w in {w for _, w in auto.iter(t or "")}]
                yield pa.record_batch([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], names=["id", "w"])

        return find

    out = None
    for part in _slices(words.select("w").distinct(), "w", WORDS_AT_ONCE):
        if some := [r.w for r in part.collect()]:
            one = memories.select("id", "text").mapInArrow(finder(some), "id string, w string")
            out = one if out is None else out.unionAll(one)
    return memories.select("id", F.lit("").alias("w")).where("false") if out is None else out


def lexical_newcomers(
    pool: DataFrame, memories: DataFrame, queries: DataFrame, limit: int | None = None, most: int = 4, shortest: int = 3, finder: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """qid, id, seen: rows beyond the pool whose text contains a probe of the query.

    Probes are tried longest first and each finds its first ``limit`` rows by id; of
    all that are found, the pool's among them, the first ``limit`` count. ``finder`` says
    for words (w) which rows (id, w) hold them, at least the first ``limit`` of each by id,
    if not ``containing`` by a scan.
    """
    words = probes(queries, most, shortest)
    found = (finder(words) if finder else containing(memories, words)).join(words, "w").select("qid", "id", "n")
    if limit is not None:
        each = Window.partitionBy("qid", "n").orderBy("id")
        found = found.withColumn("i", F.row_number().over(each)).where(F.col("i") <= limit)
    found = found.groupBy("qid", "id").agg(F.min("n").alias("n"))
    found = found.withColumn("seen", F.row_number().over(Window.partitionBy("qid").orderBy("n", "id")))
    if limit is not None:
        found = found.where(F.col("seen") <= limit)
    new = found.join(pool.select("qid", "id"), ["qid", "id"], "left_anti").select("qid", "id", "seen")
    return Scratch(memories.sparkSession).keep(new)


def corpus_pool(pool: DataFrame, rows: DataFrame, vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """The pool and its lexical newcomers, which come after it, with their own cosine."""
    new = lexical_newcomers(pool, rows, queries, limit)
    met = new.join(rows.select("id", "vec_id"), "id").join(vectors.select("vec_id", "x"), "vec_id", "left").join(queries.select("qid", "qx"), "qid")
    size = pool.groupBy("qid").agg(F.max("pool_pos").alias("size"))
    cosine = F.when(F.col("x").isNotNull(), S.cosine(F.col("x"), F.col("qx"))).otherwise(0.0)
    late = met.join(size, "qid", "left").select("qid", "id", cosine.alias("cosine"), (F.coalesce("size", F.lit(0)) + F.col("seen")).cast("int").alias("pool_pos"))
    both = pool.select("qid", "id", "cosine", F.col("pool_pos").cast("int").alias("pool_pos")).unionByName(late)
    return Scratch(rows.sparkSession).keep(both)


# --- expansion along links ---------------------------------------------------------


def expand(hits: DataFrame, edges: DataFrame, memories: DataFrame, keep: Column, spec: Expand = Expand(), seen: DataFrame | None = None, superseded: bool = False) -> DataFrame:
    """qid, id, score, hop, n: rows linked from ``hits(qid, id, rank)``, breadth first.

    A row h links away scores score * decay^(h - 1). Hits are walked by rank and a
    row's links by (dst, rel); the first ``cap`` rows of a query count. Rows that
    ``keep`` refuses are seen but not walked on. ``seen(qid, id)`` are rows that are
    never reached again, beside the hits.
    """
    links = edges.where(F.col("rel").isin(list(spec.rels))).groupBy("src", F.col("dst").alias("id")).agg(F.min("rel").alias("rel"))
    fine = memories.where(F.lit(True) if superseded else F.col("superseded_by") == "").withColumn("_keep", keep).select("id", "_keep")
    known = hits.select("qid", "id")
    known = known if seen is None else known.union(seen.select("qid", "id")).distinct()
    front, out = hits.select("qid", F.col("id").alias("src"), F.col("rank").cast("long").alias("pos")), None
    scratch = Scratch(hits.sparkSession)
    for hop in range(1, spec.depth + 1):
        met = front.join(links, "src").groupBy("qid", "id").agg(F.min("pos").alias("from"))
        met = met.join(known, ["qid", "id"], "left_anti").join(fine, "id")
        order = Window.partitionBy("qid").orderBy("from", "id")
        met = met.withColumn("pos", F.row_number().over(order).cast("long"))
        if spec.depth > 1:
            met = scratch.keep(met)  # each level reads all before it
            known = known.union(met.select("qid", "id"))
        met = met.where("_keep")
        got = met.select("qid", "id", F.lit(float(spec.score * spec.decay ** (hop - 1))).alias("score"), F.lit(hop).alias("hop"), "pos")
        out = got if out is None else out.unionByName(got)
        front = met.select("qid", F.col("id").alias("src"), "pos")
    if out is None:
        out = hits.select("qid", "id", F.lit(0.0).alias("score"), F.lit(0).alias("hop"), F.lit(0).cast("long").alias("pos")).where("false")
    order = Window.partitionBy("qid").orderBy("hop", "pos")
    return out.withColumn("n", F.row_number().over(order)).where(F.col("n") <= spec.cap).drop("pos")


def expand_reranked(scored: DataFrame, k: int, edges: DataFrame, memories: DataFrame, keep: Column, spec: Expand = Expand()) -> DataFrame:
    """qid, id, score, pool_pos: a scored pool with what its k best lead to, before any cut.

    An expanded row scores its hop's score, within 0..1, times the best of the pool,
    and comes after it on ties.
    """
    best = scored.groupBy("qid").agg(F.max("score").alias("best"), F.max("pool_pos").alias("size"))
    new = expand(top(scored, k).select("qid", "id", "rank"), edges, memories, keep, spec, seen=scored.select("qid", "id"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))) * F.col("best")
    new = new.join(best, "qid").select("qid", "id", score.alias("score"), (F.col("size") + F.col("n")).alias("pool_pos"))
    return scored.select("qid", "id", "score", "pool_pos").unionByName(new)


# --- selection ---------------------------------------------------------------------


def diversify(rows: DataFrame, k: int, lam: float | None = None, dedup: float | None = None) -> DataFrame:
    """qid, id, score, rank: greedy selection from each pool ``rows(qid, id, score,
    pool_pos, x)`` by marginal relevance and without near copies of what is chosen.

    A row without a vector is like nothing. A pool is a query's, and so bounded.
    """

    def pick(pdf):
        pdf = pdf.sort_values(["score", "pool_pos"], ascending=[False, True]).reset_index(drop=True)
        dim = max((len(v) for v in pdf.x if v is not None), default=1)
        x = np.array([np.zeros(dim) if v is None else v for v in pdf.x], dtype=np.float64)
        norm = np.sqrt((x * x).sum(axis=1))
        unit = x / np.where(norm > 0, norm, 1)[:, None]
        s = pdf.score.to_numpy()
        rel = np.ones(len(s)) if s.max() - s.min() <= 1e-12 else (s - s.min()) / (s.max() - s.min())
        near, left, out = np.full(len(s), -np.inf), list(range(len(s))), []
        while left and len(out) < k:
            value = [rel[i] if lam is None else lam * rel[i] - (1 - lam) * (near[i] if out else 0) for i in left]
            i = left.pop(int(np.argmax(value)))
            if dedup is not None and out and near[i] >= dedup:
                continue
            out.append(i)
            near = np.maximum(near, unit @ unit[i])
        return pdf.loc[out, ["qid", "id", "score"]].assign(rank=range(1, len(out) + 1))

    qid_type = dict(rows.dtypes)["qid"]
    return rows.select("qid", "id", "score", "pool_pos", "x").groupBy("qid").applyInPandas(pick, f"qid {qid_type}, id string, score double, rank long")


# --- packing -----------------------------------------------------------------------


def prepend_pinned(hits: DataFrame, memories: DataFrame, now: float, min_trust: str | None = None) -> DataFrame:
    """qid, id, score, rank: a query's hits after all live pinned rows, newest first.

    Pinned rows score as the best hit (1 without hits, for queries in ``hits`` only) and
    move rather than repeat. Ranks count anew.
    """
    pinned = memories.where(F.col("pinned") & live(now, min_trust=min_trust)).select("id", "created_at")
    best = hits.groupBy("qid").agg(F.max("score").alias("score"))
    # Every query gets every pinned row: the result itself is this product.
    front = best.crossJoin(pinned)
    first = front.select("qid", "id", "score", F.lit(0).alias("c"), (-F.col("created_at")).alias("o"))
    rest = hits.join(pinned.select("id"), "id", "left_anti").select("qid", "id", "score", F.lit(1).alias("c"), F.col("rank").cast("double").alias("o"))
    order = Window.partitionBy("qid").orderBy("c", "o", "id")
    return first.unionByName(rest).withColumn("rank", F.row_number().over(order)).select("qid", "id", "score", "rank")


def pack(hits: DataFrame, budget: int) -> DataFrame:
    """The rows of ``hits(qid, rank, cost, ...)`` with used and fits: in rank order, what
    no longer fits the budget is passed over, and smaller rows after it may still fit."""
    lists = hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("cost").cast("long").alias("cost")))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<rank:int,used:bigint,fits:boolean>>").alias("seen"))

    def step(acc, x):
        fits = acc["used"] + x["cost"] <= budget
        used = acc["used"] + F.when(fits, x["cost"]).otherwise(0)
        item = F.struct(x["rank"].cast("int").alias("rank"), used.alias("used"), fits.alias("fits"))
        return F.struct(used.alias("used"), F.concat(acc["seen"], F.array(item)).alias("seen"))

    seen = lists.select("qid", F.explode(F.aggregate("items", start, step)["seen"]).alias("e")).select("qid", "e.rank", "e.used", "e.fits")
    return hits.join(seen, ["qid", "rank"])


def first_sentences(members: Column) -> Column:
    """``[×n similar] a | b | c``: of structs (importance, pos, text), the beginnings of
    the three most important up to the first full stop."""
    order = F.array_sort(F.transform(members, lambda m: F.struct((-m["importance"]).alias("o"), m["pos"].alias("pos"), m["text"].alias("text"))))
    heads = F.filter(F.transform(F.slice(order, 1, 3), lambda m: F.trim(F.substring_index(m["text"], ".", 1))), lambda s: s != "")
    return F.concat(F.lit("[×"), F.size(members).cast("string"), F.lit(" similar] "), F.array_join(heads, " | "))


def first_sentence_summaries(rows: DataFrame, group: str) -> DataFrame:
    """group, summary: ``[×n similar] a | b | c`` of ``rows(group, importance, pos, text)``.
    Each task keeps a group's three best, so that its texts never meet."""
    best = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("importance"), "pos"))
    head = F.trim(F.substring_index("text", ".", 1)).alias("head")
    three = rows.select(group, "importance", "pos", head).withColumn("r", best).where(F.col("r") <= 3)
    heads = three.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("r", "head"))).alias("heads"))
    line = F.array_join(F.filter(F.transform("heads", lambda x: x["head"]), lambda s: s != ""), " | ")
    met = rows.groupBy(group).agg(F.count("*").alias("n")).join(heads, group)
    return met.select(group, F.concat(F.lit("[×"), F.col("n").cast("string"), F.lit(" similar] "), line).alias("summary"))


def compress(packed: DataFrame, budget: int, threshold: float = 0.30, least: int = 2) -> DataFrame:
    """qid, members, text, tokens: summaries of what ``pack`` passed over, if they fit.

    Dropped rows (qid, id, rank, text, importance) are grouped by token overlap with a
    leader, in rank order; each group of ``least`` or more takes a line if the budget
    that is left has room for it, larger groups not first.
    """
    left = packed.groupBy("qid").agg(F.max("used").alias("used"))
    dropped = packed.where("NOT fits").select("qid", "id", "rank", "text", "importance", F.array_distinct(S.tokenize(F.col("text"))).alias("toks"))

    def group(pdf):
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        sets, used, out = [set(t) for t in pdf.toks], set(), []
        for i in range(len(pdf)):
            if i in used:
                continue
            mine = [i]
            for j in range(i + 1, len(pdf)):
                union = sets[i] | sets[j]
                if j not in used and union and len(sets[i] & sets[j]) / len(union) >= threshold:
                    mine.append(j)
            used.update(mine)
            if len(mine) >= least:
                out.extend((pdf.qid[j], pdf.id[j], int(pdf["rank"][i]), int(pdf["rank"][j])) for j in mine)
        return __import__("pandas").DataFrame(out, columns=["qid", "id", "leader", "pos"])

    qid_type = dict(packed.dtypes)["qid"]
    groups = dropped.groupBy("qid").applyInPandas(group, f"qid {qid_type}, id string, leader int, pos int")
    member = F.struct(F.col("importance"), F.col("pos"), F.col("text"))
    lines = groups.join(dropped.select("qid", "id", "text", "importance"), ["qid", "id"]).groupBy("qid", "leader").agg(
        F.collect_list(member).alias("m"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]), ",").alias("members")
    )
    lines = lines.select("qid", F.col("leader").alias("rank"), "members", F.concat(F.lit("- (compressed) "), first_sentences(F.col("m"))).alias("text"))
    lines = lines.withColumn("cost", S.estimate_tokens(F.col("text"))).join(left, "qid")
    # The budget differs by query: what is used comes as a first item that always fits.
    start = lines.select("qid", F.lit(-1).alias("rank"), F.col("used").alias("cost")).distinct()
    fitted = pack(lines.select("qid", "rank", "cost").unionByName(start), budget).where("fits AND rank >= 0")
    return fitted.select("qid", "rank").join(lines, ["qid", "rank"]).select("qid", "members", "text", F.col("cost").alias("tokens"))

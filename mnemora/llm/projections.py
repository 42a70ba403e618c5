"""Near-duplicate vectors by collision-counting projections.

Within a tile of vectors, many one-dimensional random projections are sorted. A
vector's window in each is centred on it, and a pair collides in a projection if one
lies in the other's window. Pairs with enough collisions are verified by their
cosine; how many are enough is calibrated so that a pair at the threshold misses
with probability ``MISS`` at most.

A window holds a fixed share of all vectors, so tiles come from cells: the signs of b
projections, in as many tables as keep the same recall, b growing with the logarithm
of a label's vectors so that a cell's expected size is fixed. A cell of more than
``TILE`` vectors is split into chunks that meet pairwise. A pair is judged in the
first table only in which it shares a cell, and tiles return sums and local
components, never pairs.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import Scratch, components, table, tidied

THRESHOLD = 0.93
#: Chance that a pair at the threshold shares no cell, and that it has too few collisions.
MISS = 1e-4
CELL, TILE = 512, 1024
PROJECTIONS, WIDTH = 24, 1.5  # the window's half-width in distances at the threshold
SEED = 20240613


def bits(n: int) -> int:
    """Signs of a cell's code for a label of n vectors."""
    return max(0, math.ceil(math.log2(n / CELL))) if n else 0


@lru_cache(None)
def tables(b: int, threshold: float = THRESHOLD) -> int:
    """Tables of b signs that a pair at the threshold shares one of, but for MISS."""
    same = (1 - math.acos(threshold) / math.pi) ** b
    return 1 if same >= 1 else math.ceil(math.log(MISS) / math.log1p(-same))


@lru_cache(None)
def needed(threshold: float = THRESHOLD) -> int:
    """Collisions that a pair at the threshold has, but for MISS."""
    p = math.erf(WIDTH / math.sqrt(2))
    tail, k = 0.0, 0
    while True:
        tail += math.comb(PROJECTIONS, k) * p**k * (1 - p) ** (PROJECTIONS - k)
        if tail > MISS:
            return k
        k += 1


def _normals(dim: int, b: int, count: int) -> np.ndarray:
    """dim x (count * b), the same for every prefix of the tables."""
    return np.hstack([np.random.default_rng((SEED, dim, t)).standard_normal((dim, b)) for t in range(count)]) if b else np.zeros((dim, 0))


def cell_codes(unit: np.ndarray, b: int, count: int) -> np.ndarray:
    """One code per vector and table."""
    if not b:
        return np.zeros((len(unit), count), dtype=np.int64)
    signs = (unit @ _normals(unit.shape[1], b, count) > 0).reshape(len(unit), count, b)
    return signs @ (1 << np.arange(b, dtype=np.int64))


def collisions(a: np.ndarray, b: np.ndarray, width: float) -> np.ndarray:
    """Per pair of rows (projections in columns) the windows of ``a`` that hold ``b``."""
    count = np.zeros((len(a), len(b)), dtype=np.uint8)
    for i in range(a.shape[1]):
        order = np.argsort(b[:, i], kind="stable")
        rank = np.empty(len(b), dtype=np.int32)
        rank[order] = np.arange(len(b), dtype=np.int32)
        line = b[order, i]
        low = np.searchsorted(line, a[:, i] - width, side="left").astype(np.int32)
        high = np.searchsorted(line, a[:, i] + width, side="right").astype(np.int32)
        # rank in [low, high) by one unsigned comparison
        count += (rank[None, :] - low[:, None]).view(np.uint32) < (high - low).astype(np.uint32)[:, None]
    return count


def _unit(rows: pa.Array) -> np.ndarray:
    x = np.array(rows.to_pylist(), dtype=np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def judge_tile(ids: np.ndarray, weight: np.ndarray, unit: np.ndarray, chunk: np.ndarray, low: int, high: int, b: int, t: int, threshold: float):
    """(id, linked weight, smallest id of its component here) of linked vectors."""
    one = np.flatnonzero(chunk == low)
    two = one if low == high else np.flatnonzero(chunk == high)
    projected = unit @ np.random.default_rng((SEED, unit.shape[1], -t % 2**31)).standard_normal((unit.shape[1], PROJECTIONS))
    width = WIDTH * math.sqrt(2 - 2 * threshold)
    count = collisions(projected[one], projected[two], width)
    x, y = np.nonzero(count >= needed(threshold))
    x, y = one[x], two[y]
    if low == high:
        x, y = x[x < y], y[x < y]
    codes = cell_codes(unit, b, t) if t else np.zeros((len(unit), 0))
    linked = []
    for s in range(0, len(x), 1 << 15):
        p, q = x[s : s + (1 << 15)], y[s : s + (1 << 15)]
        new = ~(codes[p] == codes[q]).any(axis=1)
        p, q = p[new], q[new]
        good = (unit[p] * unit[q]).sum(axis=1) >= threshold
        linked.append((p[good], q[good]))
    p, q = (np.concatenate([z[i] for z in linked]) if linked else np.empty(0, dtype=np.int64) for i in (0, 1))
    total = np.bincount(p, weights=weight[q], minlength=len(ids)) + np.bincount(q, weights=weight[p], minlength=len(ids))
    root = ids.copy()
    while len(p):
        least = np.minimum(root[p], root[q])
        if (least == root[p]).all() and (least == root[q]).all():
            break
        np.minimum.at(root, p, least)
        np.minimum.at(root, q, least)
    hit = np.unique(np.concatenate((p, q)))
    return ids[hit], total[hit].astype(np.int64), root[hit]


#: Squared lengths that are summed up without loss.
SQUARES = (1e-250, 1e300)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of ``vectors(vec_id, embedding,
    label)``.

    Only vectors of equal label and length are compared. Null labels, and vectors
    that are null, empty, zero or hold null or non-finite components, link with
    nothing; nor do rows without vec_id, whose component is null. Repeated rows are
    vectors of their own. Equal vectors are judged once, with their number. Vectors of
    any finite length count, be they too short or long to square. An empty table has
    no rows; other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession)
    # Tiles get floats as they are stored, and take products in double precision.
    single = vectors.schema["embedding"].dataType == ArrayType(FloatType())
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("x"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    if not single:
        # Doubles whose squares leave the range of doubles are scaled first; floats' don't.
        most = F.array_max(F.transform("x", lambda v: F.abs(v)))
        rows = rows.withColumn("x", F.when(fine & (most > 0) & ~norm.between(*SQUARES), F.transform("x", lambda v: v / most)).otherwise(F.col("x")))
    usable = rows.where(fine).where((norm > 0) & (norm < float("inf"))).select("vec_id", "label", "x", F.size("x").alias("dim"), F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(7), "x").alias("h2"))
    key = ["label", "dim", "h1", "h2"]
    classes = scratch.keep(usable.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")))
    per = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    heads = usable.join(classes.withColumnRenamed("rep", "vec_id"), [*key, "vec_id"]).dropDuplicates(["vec_id", *key])
    heads = scratch.keep(heads.join(per, ["label", "dim"]).select(F.col("vec_id").alias("rep"), "label", "dim", "h1", "h2", "m", "n", "x"))

    def code(batches):
        for batch in batches:
            rep, label, dim, n, x, h1 = batch.columns
            dims, sizes = dim.to_numpy(), n.to_numpy()
            out = [None] * batch.num_rows
            for d, size in sorted(set(zip(dims.tolist(), sizes.tolist()))):
                at = np.flatnonzero((dims == d) & (sizes == size))
                b = bits(size)
                for i, c in zip(at, cell_codes(_unit(x.take(pa.array(at))), b, tables(b, threshold)).tolist()):
                    out[i] = c
            yield pa.record_batch([rep, label, dim, n, h1, pa.array(out, pa.list_(pa.int64()))], names=["rep", "label", "dim", "n", "h1", "codes"])

    label_type = dict(classes.dtypes)["label"]
    coded = heads.select("rep", "label", "dim", "n", "x", "h1").mapInArrow(tidied(code), f"rep long, label {label_type}, dim int, n long, h1 long, codes array<long>")
    cell = ["label", "dim", "t", "code"]
    coded = scratch.keep(coded.select("rep", "label", "dim", "n", "h1", F.posexplode("codes").alias("t", "code")))
    chunks = coded.groupBy(*cell).agg(F.ceil(F.count("*") / TILE).alias("chunks"), F.count("*").alias("size")).where("size > 1").drop("size")
    own = F.pmod(F.xxhash64("rep", "h1"), F.col("chunks"))
    tiles = coded.join(chunks, cell).withColumn("chunk", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    tiles = tiles.select("rep", "h1", *cell, "n", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    tiles = tiles.join(heads.select("rep", "label", "dim", "h1", "m", "x"), ["rep", "label", "dim", "h1"])

    def judge(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        get = lambda c: group[c].to_numpy()
        one = lambda c: group[c][0].as_py()
        # In a fixed order, so that a rerun of the task returns the same rows.
        group = group.sort_by([("rep", "ascending"), ("h1", "ascending")])
        ids, total, root = judge_tile(get("rep"), get("m"), _unit(group["x"]), get("chunk"), one("low"), one("high"), bits(one("n")), one("t"), threshold)
        return pa.table({"rep": pa.array(ids, pa.int64()), "links": pa.array(total, pa.int64()), "root": pa.array(root, pa.int64())})

    judged = scratch.keep(tiles.groupBy(*cell, "low", "high").applyInArrow(judge, "rep long, links long, root long"))
    links = judged.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(judged.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    facts = classes.join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    facts = facts.select(*key, (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = usable.select("vec_id", *key).join(facts, key).select("vec_id", "n_links", "component_id")
    other = rows.where(~(fine & F.coalesce((norm > 0) & (norm < float("inf")), F.lit(False)))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(other).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_vectors`` of embeddings, at cosine 0.93."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: DuckDB's FLOAT arithmetic differs, hence the casts. For the whole table.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x)) / sqrt(list_dot_product(b.x, b.x)) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, component_id = vec_id AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) q ON q.a = vec_id
"""

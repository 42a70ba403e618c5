"""Exact neighbourhoods of unit vectors by cells around pivots.

Pivots are vectors of the table, chosen by a hash; a vector lives in the cell of its nearest
one. Two vectors with a cosine of t are sqrt(2 - 2t) apart, so one that is further than
that from the border between two cells, or from the sphere that holds a cell's vectors, has
no such neighbour there. How much this saves depends on the data: of clustered vectors most
cells are passed over, of vectors without structure hardly any is, and nothing is lost.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Vectors of a cell, on average, and cells at most: their pivots go to every task.
CELL, CELLS = 8192, 4096
#: Vectors of a block, about, and bytes of them at most. Each block is written down once, and
#: tasks read those that meet: what is written grows as the vectors do, whatever meets.
BLOCK, BLOCK_BYTES = 8192, 4 << 20
#: Rows of a block that a task multiplies at once, and pairs of them that it confirms at once.
AT_ONCE, CONFIRMED = 512, 65_536
#: Blocks of a partition: a task holds the pairs of two partitions' blocks.
BLOCKS_AT_ONCE = 4
#: More than what rounding may add to a distance.
SLACK = 1e-7


@dataclass(frozen=True)
class Cells:
    """Unit pivots, their distances, and how far a cell's vectors are from its pivot at most."""

    pivots: np.ndarray
    apart: np.ndarray
    radius: np.ndarray

    def __len__(self) -> int:
        return len(self.pivots)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1)[:, None], norm


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.array(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def near_pivots(unit: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's products with the pivots, and its nearest one; zeros are in cell 0."""
    dots = unit @ pivots.T
    return dots, dots.argmax(axis=1)


def cells_of(vectors: DataFrame, cell: int = CELL, cells: int = CELLS) -> Cells:
    """Cells for ``vectors(vec_id, x)``: a pivot for each ``cell`` of them, at most ``cells``."""
    n = vectors.count()
    want = min(cells, -(-n // cell)) if n else 0
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(want).select("x").collect() if want > 1 else []
    kept: list[np.ndarray] = []
    for p in _unit(np.array([r.x for r in sample], dtype=np.float64))[0] if sample else ():
        if p.any() and all(2 - 2 * (p @ k) > 1e-6 for k in kept):
            kept.append(p)
    if len(kept) < 2:
        return Cells(np.zeros((1, 1)), np.zeros((1, 1)), np.array([2.0]))
    pivots = np.array(kept)
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))

    def run(batches):
        far = np.zeros(len(pivots))
        for b in batches:
            if b.num_rows:
                unit, norm = _unit(matrix(b.column(0)))
                dots, own = near_pivots(unit, pivots)
                dist = np.sqrt(np.maximum(0, 2 - 2 * dots[np.arange(len(own)), own]))
                np.maximum.at(far, own[norm > 0], dist[norm > 0])
        yield pa.record_batch([pa.array(range(len(far)), pa.int32()), pa.array(far)], names=["cell", "far"])

    radius = np.zeros(len(pivots))
    for r in vectors.select("x").mapInArrow(run, "cell int, far double").groupBy("cell").agg(F.max("far").alias("far")).collect():
        radius[r.cell] = r.far
    return Cells(pivots, apart, radius)


def _visits(unit: np.ndarray, cells: Cells, reach: float) -> tuple[np.ndarray, list[list[int]]]:
    """Each vector's cell, and the lower cells that may hold a vector within ``reach``."""
    if len(cells) == 1:
        return np.zeros(len(unit), dtype=np.int64), [[] for _ in unit]
    dots, own = near_pivots(unit, cells.pivots)
    mine = dots[np.arange(len(own)), own]
    border = (mine[:, None] - dots) / np.where(cells.apart[own] > 0, cells.apart[own], 1)
    dist = np.sqrt(np.maximum(0, 2 - 2 * dots))
    may = (border <= reach + SLACK) & (dist <= cells.radius + reach + SLACK) & (np.arange(len(cells)) < own[:, None])
    return own, [np.flatnonzero(row).tolist() for row in may]


def _pack(x: np.ndarray) -> tuple[bytes, bool]:
    """Vectors as bytes, and whether these are doubles: of what floats hold exactly, they are floats."""
    with np.errstate(over="ignore"):
        narrow = x.astype(np.float32)
    wide = not np.array_equal(narrow, x)
    return (x if wide else narrow).tobytes(), wide


def _unpack(row: dict) -> np.ndarray:
    x = np.frombuffer(row["x"].as_buffer(), dtype=np.float64 if row["wide"].as_py() else np.float32)
    return x.reshape(len(row["ids"].values), -1).astype(np.float64)


def _slack(dim: int) -> float:
    """More than what products of unit vectors in single precision are off."""
    return (dim + 8) * 2.0**-23


def _toward(unit: np.ndarray, cells: Cells, own: int, other: int, reach: np.ndarray | float) -> np.ndarray:
    """Which vectors of one cell may have neighbours within ``reach`` in the other."""
    mine, theirs = unit @ cells.pivots[own], unit @ cells.pivots[other]
    border = (mine - theirs) / max(cells.apart[own, other], 1e-9)
    dist = np.sqrt(np.maximum(0, 2 - 2 * theirs))
    return (border <= reach + SLACK) & (dist <= cells.radius[other] + reach + SLACK)


def _blocks(placed: DataFrame, name: str, keys: list[str], block: int, pack, schema: str, scratch: Scratch, dim: int = 0) -> DataFrame:
    """``placed(name, *keys, x, ...)`` in blocks: a row for each, as ``pack`` makes it of a table.

    They lie in as many partitions as keep a task's meetings few and all cores busy.
    """
    if not dim:
        first = placed.select(F.size("x")).first()
        dim = max(1, first[0]) if first else 1
    block = max(1, min(block, BLOCK_BYTES // (8 * max(1, dim))))
    sizes = scratch.keep(placed.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("pieces")))
    total = int(sizes.agg(F.sum("pieces")).first()[0] or 1)
    cores = scratch.spark.sparkContext.defaultParallelism
    parts = min(total, max(-(-total // BLOCKS_AT_ONCE), int(np.ceil(np.sqrt(8 * cores)))))
    dealt = placed.join(F.broadcast(sizes), keys).withColumn("piece", F.pmod(F.xxhash64(name), F.col("pieces"))).drop("pieces")
    return scratch.keep(dealt.repartition(parts, *keys, "piece").groupBy(*keys, "piece").applyInArrow(pack, schema))


def _pairs(one: DataFrame, two: DataFrame, may) -> DataFrame:
    """Rows of two tables of blocks where ``may`` holds, columns ending in 1 and 2. Tasks read
    the tables where they are written down: nothing is sent by key, so no copy is stored."""
    named = lambda df, i: df.select(*[F.col(c).alias(f"{c}{i}") for c in df.columns])
    return named(one, 1).hint("shuffle_replicate_nl").join(named(two, 2), may)


def _both(batches):
    """The two blocks of each pair of ``_pairs``, as dicts of scalars."""
    for b in batches:
        for i in range(b.num_rows):
            yield tuple({c[:-1]: b.column(k)[i] for k, c in enumerate(b.schema.names) if c.endswith(side)} for side in "12")


def _cosines(x: np.ndarray, y: np.ndarray, xn: np.ndarray, yn: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """By a plain sum: a product of matrices rounds differently."""
    scale = xn[i] * yn[j]
    return np.divide((x[i] * y[j]).sum(axis=1), scale, out=np.zeros(len(i)), where=scale > 0)


def _hits(dots: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of products that are ``least`` of their row or more. Few rows have any."""
    some = np.flatnonzero(~(dots.max(axis=1) < least))
    i, j = np.nonzero(dots[some] >= least[some, None])
    return some[i], j


def similar(vectors: DataFrame, threshold: float, cell: int = CELL, cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """type, p, q, similarity of vectors (vec_id p <= q) of one type of cosine ``threshold``
    or more, of distinct ``vectors(type, vec_id, x)``. Exact.

    Vectors are written down in blocks, each of one type and cell, of about ``block``; two
    blocks meet if a vector of the higher cell may have a neighbour in the lower one. A vector
    and itself are a pair; zeros have a cosine of 0 with all.
    """
    scratch = Scratch(vectors.sparkSession)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    vec_type = dict(vectors.dtypes)["vec_id"]
    vectors = scratch.keep(vectors.select("type", "vec_id", F.col("x").cast("array<double>").alias("x")))
    # From a right angle on nothing is out of reach.
    found = cells_of(vectors.select("vec_id", "x"), cell, cells) if threshold > 0 else Cells(np.zeros((1, 1)), np.zeros((1, 1)), np.array([2.0]))

    def place(batches):
        for b in batches:
            if b.num_rows:
                own = near_pivots(_unit(matrix(b.column(2)))[0], found.pivots)[1]
                yield pa.record_batch([*b.columns, pa.array(own, pa.int32())], names=["type", "vec_id", "x", "cell"])

    def pack(table: pa.Table) -> pa.Table:
        x = matrix(table["x"])
        data, wide = _pack(x)
        near = sorted({c for row in _visits(_unit(x)[0], found, reach)[1] for c in row})
        one = lambda name: table[name].slice(0, 1)
        ids = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), table["vec_id"].combine_chunks())
        return pa.table({"type": one("type"), "cell": one("cell"), "piece": one("piece"), "ids": ids, "x": pa.array([data], pa.binary()), "wide": [wide], "near": pa.array([near], pa.list_(pa.int32()))})

    placed = vectors.withColumn("cell", F.lit(0)) if len(found) == 1 else vectors.mapInArrow(place, f"type string, vec_id {vec_type}, x array<double>, cell int")
    blocks = _blocks(placed, "vec_id", ["type", "cell"], block, pack, f"type string, cell int, piece long, ids array<{vec_type}>, x binary, wide boolean, near array<int>", scratch)

    def meet(batches):
        for one, two in _both(batches):
            own, other = one["cell"].as_py(), two["cell"].as_py()
            same = own == other and one["piece"].as_py() == two["piece"].as_py()
            x, y = _unpack(one), _unpack(two)
            (xu, xn), (yu, yn) = _unit(x), _unit(y)
            a, b = np.arange(len(x)), np.arange(len(y))
            if own != other:
                a, b = np.flatnonzero(_toward(xu, found, own, other, reach)), np.flatnonzero(_toward(yu, found, other, own, reach))
            xf, yf, least = xu[a].astype(np.float32), np.ascontiguousarray(yu[b].astype(np.float32).T), np.full(AT_ONCE, threshold - _slack(x.shape[1]), dtype=np.float32)
            if not len(b):
                continue
            left, right = one["ids"].values, two["ids"].values
            for at in range(0, len(a), AT_ONCE):
                dots = xf[at : at + AT_ONCE] @ yf
                rows, columns = _hits(dots, least[: len(dots)])
                for cut in range(0, len(rows), CONFIRMED):
                    i, j = a[at + rows[cut : cut + CONFIRMED]], b[columns[cut : cut + CONFIRMED]]
                    if same:
                        i, j = i[i <= j], j[i <= j]
                    cos = _cosines(x, y, xn, yn, i, j)
                    i, j, cos = (v[cos >= threshold] for v in (i, j, cos))
                    p, q = left.take(pa.array(i)), right.take(pa.array(j))
                    swap = pc.greater(p, q)
                    kind = pa.array([one["type"].as_py()] * len(cos), pa.string())
                    yield pa.record_batch([kind, pc.if_else(swap, q, p), pc.if_else(swap, p, q), pa.array(cos)], names=["type", "p", "q", "similarity"])

    within = (F.col("cell1") == F.col("cell2")) & (F.col("piece1") <= F.col("piece2"))
    pairs = _pairs(blocks, blocks, (F.col("type1") == F.col("type2")) & (within | F.array_contains("near1", F.col("cell2"))))
    return pairs.mapInArrow(meet, f"type string, p {vec_type}, q {vec_type}, similarity double")


# --- an index for nearest vectors --------------------------------------------------------


#: The cell of vectors that are zero, whose cosine with all is 0: a right angle away.
ZEROS = -1


@dataclass
class Index:
    """A table of vectors by cell, in a folder a cell, and the cells."""

    path: str
    cells: Cells
    sizes: dict[int, int]
    vec_type: str


def build_index(vectors: DataFrame, path: str, cell: int = CELL, cells: int = CELLS) -> Index:
    """Writes all of ``vectors(vec_id, x)`` to ``path``, which must not be there yet, by cell.
    Vectors that are null or hold nulls, or are of another length than most, aren't indexed."""
    x = F.col("x").cast("array<double>")
    rows = vectors.select("vec_id", x.alias("x")).where(F.forall("x", lambda v: v.isNotNull()) & (F.size("x") > 0))
    dims = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("x") == (dims.d if dims else -1))
    found, vec_type = cells_of(rows, cell, cells), dict(vectors.dtypes)["vec_id"]

    def place(batches):
        for b in batches:
            if b.num_rows:
                unit, norm = _unit(matrix(b.column(1)))
                own = np.where(norm > 0, near_pivots(unit, found.pivots)[1], ZEROS) if len(found) > 1 else np.zeros(b.num_rows)
                yield pa.record_batch([*b.columns, pa.array(own.astype(np.int32))], names=["vec_id", "x", "cell"])

    placed = rows.mapInArrow(place, f"vec_id {vec_type}, x array<double>, cell int")
    # A large cell in several files: dealt by cell and a few hash values.
    placed.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(8))).write.partitionBy("cell").parquet(path)
    sizes = {r.cell: r["count"] for r in vectors.sparkSession.read.parquet(path).groupBy("cell").count().collect()} if dims else {}
    return Index(path, found, sizes, vec_type)


def nearest(spark, index: Index, queries: DataFrame, n: int, at_once: int = 10_000) -> tuple[DataFrame, dict[str, int]]:
    """(hits, report): qid, vec_id, cosine, rank of the n nearest vectors of each of
    ``queries(qid, qx)``, equal cosines by vec_id; exact.

    First each query reads the nearest cells that hold n vectors, which bounds how far its
    n-th may be; then it reads those others that the bound doesn't rule out. ``report`` says
    how many cells and vectors the queries met, and how many a full scan would have.
    Queries go in slices of ``at_once``, so what is sent to tasks is bounded. Queries that are
    zero are as near to all: they read everything.
    """
    scratch, cells, sizes = Scratch(spark), index.cells, index.sizes
    qid_type = dict(queries.dtypes)["qid"]
    report = {"queries": 0, "cells": len(sizes), "cells_read": 0, "cells_of_scan": 0, "vectors_read": 0, "vectors_of_scan": 0}
    parts = -(-max(1, queries.count()) // at_once)
    total, out = sum(sizes.values()), None
    order = sorted(sizes)
    for part in range(parts):
        batch = queries.select("qid", F.col("qx").cast("array<double>").alias("qx")).where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part).collect()
        if not batch or not total:
            continue
        qx = np.array([r.qx for r in batch], dtype=np.float64)
        unit, norms = _unit(qx)
        low = np.zeros((len(batch), len(order)))
        dist = low
        if len(cells) > 1:
            live = np.array([c for c in order if c != ZEROS], dtype=int)
            dots = unit @ cells.pivots[live].T
            far = np.sqrt(np.maximum(0, 2 - 2 * dots))
            home = dots.argmax(axis=1)
            apart = cells.apart[np.ix_(live, live)]
            border = (dots[np.arange(len(batch)), home][:, None] - dots) / np.where(apart[home] > 0, apart[home], 1)
            border[np.arange(len(batch)), home] = 0
            least, zeros = np.maximum(np.maximum(0, far - cells.radius[live]), border), [np.full((len(batch), 1), np.sqrt(2))] * (ZEROS in sizes)
            low, dist = np.hstack([*zeros, least]), np.hstack([*zeros, far])  # ZEROS is first in order
            low[norms == 0] = 0
        held = np.array([sizes[c] for c in order])
        first = np.zeros(low.shape, dtype=bool)
        for i, row in enumerate(low):
            by = np.lexsort((dist[i], row))
            first[i, by[: int(np.searchsorted(np.cumsum(held[by]), min(n, total))) + 1]] = True
        found = _scan(spark, index, order, first, batch, qx, norms, n, qid_type, scratch)
        kth = {r.i: r.cos for r in found.groupBy("i").agg(F.min("cosine").alias("cos"), F.count("*").alias("k")).where(F.col("k") >= n).collect()}
        bound = np.array([np.sqrt(max(0.0, 2 - 2 * kth[i])) if i in kth and norms[i] > 0 else np.inf for i in range(len(batch))])
        then = (low <= bound[:, None] + SLACK) & ~first
        both = found
        if then.any():
            both = found.unionByName(_scan(spark, index, order, then, batch, qx, norms, n, qid_type, scratch))
        rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("cosine"), "vec_id"))
        best = both.withColumn("rank", rank).where(F.col("rank") <= n).select("qid", "vec_id", "cosine", "rank")
        out = best if out is None else out.unionByName(best)
        seen = first | then
        report["queries"] += len(batch)
        report["cells_read"] += int(seen.sum())
        report["cells_of_scan"] += seen.size
        report["vectors_read"] += int((seen * held).sum())
        report["vectors_of_scan"] += total * len(batch)
    if out is None:
        out = spark.createDataFrame([], f"qid {qid_type}, vec_id {index.vec_type}, cosine double, rank int")
    return out, report


def _scan(spark, index: Index, order: list[int], wanted: np.ndarray, batch: list, qx: np.ndarray, norms: np.ndarray, n: int, qid_type: str, scratch: Scratch) -> DataFrame:
    """i, qid, vec_id, cosine: each query's n best in each task of the cells it wants."""
    by_cell = {c: np.flatnonzero(wanted[:, k]) for k, c in enumerate(order) if wanted[:, k].any()}
    ids = pa.array([r.qid for r in batch])
    unit = qx / np.where(norms > 0, norms, 1)[:, None]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            at, x = b.column(2).to_numpy(zero_copy_only=False), matrix(b.column(1))
            xu, own = _unit(x)
            for c in np.unique(at):
                rows, asked = np.flatnonzero(at == c), by_cell.get(int(c), np.empty(0, dtype=int))
                for start in range(0, len(asked), 256):
                    q = asked[start : start + 256]
                    near = unit[q] @ xu[rows].T
                    cut = np.partition(near, -n, axis=1)[:, [-n]] if near.shape[1] > n else near.min(axis=1, keepdims=True)
                    i, v = np.nonzero(near >= cut - 1e-9)
                    i, v = q[i], rows[v]
                    scale = norms[i] * own[v]
                    cos = np.divide((qx[i] * x[v]).sum(axis=1), scale, out=np.zeros(len(i)), where=scale > 0)
                    yield pa.record_batch([pa.array(i, pa.int64()), ids.take(pa.array(i)), b.column(0).take(pa.array(v)), pa.array(cos)], names=["i", "qid", "vec_id", "cosine"])

    rows = spark.read.parquet(index.path).where(F.col("cell").isin(list(by_cell))).select("vec_id", "x", "cell")
    found = rows.mapInArrow(run, f"i long, qid {qid_type}, vec_id {index.vec_type}, cosine double")
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("cosine"), "vec_id"))
    return scratch.keep(found.withColumn("r", rank).where(F.col("r") <= n).drop("r"))


def asker(vectors: DataFrame, qid_type: str, dim: int, n: int | None, cell: int = CELL, cells: int = CELLS, block: int = BLOCK, ties: str | None = None):
    """(ask, found): writes ``vectors(vec_id, x)`` of ``dim`` components down in blocks, and ``ask``
    looks for neighbours of any queries in them, as ``nearest_join`` says; None for n finds all.

    ``ask(asked, at_home, away)`` gives qid, vec_id, cosine, tie of ``asked(qid, x, least)`` in
    their own cell or in the others within reach of ``least``. ``found`` are the cells.
    """
    scratch, vec_type = Scratch(vectors.sparkSession), dict(vectors.dtypes)["vec_id"]
    tie_type = dict(vectors.dtypes)[ties] if ties else "int"
    usable = vectors.select("vec_id", F.col("x").cast("array<double>").alias("x"), (F.col(ties) if ties else F.lit(0)).alias("tie"))
    usable = scratch.keep(usable.where((F.size("x") == dim) & F.forall("x", lambda v: v.isNotNull())))
    found = cells_of(usable, cell, cells)

    def own_cell(unit: np.ndarray, norm: np.ndarray) -> np.ndarray:
        if len(found) == 1:
            return np.zeros(len(unit), dtype=np.int32)
        return np.where(norm > 0, near_pivots(unit, found.pivots)[1], ZEROS).astype(np.int32)

    def place(batches):
        for b in batches:
            if b.num_rows:
                unit, norm = _unit(matrix(b.column(1)))
                yield pa.record_batch([*b.columns, pa.array(own_cell(unit, norm))], names=[*b.schema.names, "cell"])

    one = lambda table, name: table[name].slice(0, 1)
    lists = lambda column: pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column.combine_chunks())

    def pack(table: pa.Table) -> pa.Table:
        data, wide = _pack(matrix(table["x"]))
        return pa.table({"cell": one(table, "cell"), "ids": lists(table["vec_id"]), "x": pa.array([data], pa.binary()), "wide": [wide], "ties": lists(table["tie"])})

    residents = usable.mapInArrow(place, f"vec_id {vec_type}, x array<double>, tie {tie_type}, cell int")
    residents = _blocks(residents, "vec_id", ["cell"], block, pack, f"cell int, ids array<{vec_type}>, x binary, wide boolean, ties array<{tie_type}>", scratch, dim)
    filled = np.array(sorted(r.cell for r in residents.select("cell").distinct().collect()), dtype=int)  # at most ``cells`` of them

    def reaches(bound: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """How far neighbours of a cosine of ``bound`` may be; -inf sets no bound."""
        return np.where((bound <= 0) & (norm == 0) | np.isneginf(bound), np.inf, np.sqrt(np.maximum(0, 2 - 2 * np.maximum(bound, -1))))

    def low(unit: np.ndarray, norm: np.ndarray, own: np.ndarray, to: np.ndarray) -> np.ndarray:
        """How far the vectors of the cells ``to`` are from queries, at least."""
        out = np.zeros((len(unit), len(to)))
        if len(found) > 1:
            home, live = np.maximum(own, 0), to != ZEROS
            dots = unit @ found.pivots[to[live]].T
            mine = (unit * found.pivots[home]).sum(axis=1)
            apart = found.apart[home][:, to[live]]
            border = np.where(apart > 0, (mine[:, None] - dots) / np.where(apart > 0, apart, 1), 0)
            out[:, live] = np.maximum(np.maximum(0, np.sqrt(np.maximum(0, 2 - 2 * dots)) - found.radius[to[live]]), border)
            out[:, ~live] = np.sqrt(2)
            out[norm == 0] = 0
        return out

    def packed(at_home: bool, away: bool):
        """Packs queries, and the cells they are asked in: their own, others within reach, or both."""

        def pack(table: pa.Table) -> pa.Table:
            x, own, bound = matrix(table["x"]), table["cell"][0].as_py(), table["least"].to_numpy()
            unit, norm = _unit(x)
            within = low(unit, norm, np.full(len(x), own), filled) <= reaches(bound, norm)[:, None] + SLACK if away else np.zeros((1, len(filled)), dtype=bool)
            near = sorted({int(c) for c in filled[within.any(axis=0)] if c != own} | ({own} if at_home else set()))
            data, wide = _pack(x)
            return pa.table({"cell": one(table, "cell"), "ids": lists(table["qid"]), "x": pa.array([data], pa.binary()), "wide": [wide], "least": lists(table["least"]), "near": pa.array([near], pa.list_(pa.int32()))})

        return pack

    def meet(batches):
        for query, stored in _both(batches):
            q, x = _unpack(query), _unpack(stored)
            (qu, qn), (xu, xn) = _unit(q), _unit(x)
            bound, own, to = query["least"].values.to_numpy(), query["cell"].as_py(), stored["cell"].as_py()
            a = np.arange(len(q)) if own == to else np.flatnonzero(low(qu, qn, np.full(len(q), own), np.array([to]))[:, 0] <= reaches(bound, qn) + SLACK)
            slack, xf = _slack(x.shape[1]), np.ascontiguousarray(xu.astype(np.float32).T)
            names, known = query["ids"].values, stored["ids"].values
            order = np.argsort(np.argsort(stored["ties"].values.to_numpy(zero_copy_only=False), kind="stable"))
            for at in range(0, len(a), AT_ONCE):
                part = a[at : at + AT_ONCE]
                dots, cut = qu[part].astype(np.float32) @ xf, (bound[part] - slack).astype(np.float32)
                rows, columns = _hits(dots, cut)
                many = np.flatnonzero(np.bincount(rows, minlength=len(part)) > n) if n else ()
                if len(many):
                    cut[many] = np.partition(np.where(dots[many] >= cut[many, None], dots[many], -np.inf), -n, axis=1)[:, -n] - np.float32(2 * slack)
                    rows, columns = _hits(dots, cut)
                cos = np.concatenate([_cosines(q, x, qn, xn, part[rows[c : c + CONFIRMED]], columns[c : c + CONFIRMED]) for c in range(0, len(rows), CONFIRMED)] or [np.zeros(0)])
                keep = np.flatnonzero(cos >= bound[part[rows]])
                if n and ties:
                    keep = keep[np.lexsort((order[columns[keep]], -cos[keep], rows[keep]))]
                    sort = rows[keep]
                    keep = keep[np.arange(len(sort)) - np.searchsorted(sort, sort) < n]
                yield pa.record_batch([names.take(pa.array(part[rows[keep]])), known.take(pa.array(columns[keep])), pa.array(cos[keep]), stored["ties"].values.take(pa.array(columns[keep]))], names=["qid", "vec_id", "cosine", "tie"])

    def look(asked: DataFrame, at_home: bool, away: bool) -> DataFrame:
        placed = asked.mapInArrow(place, f"qid {qid_type}, x array<double>, least double, cell int")
        blocks = _blocks(placed, "qid", ["cell"], block, packed(at_home, away), f"cell int, ids array<{qid_type}>, x binary, wide boolean, least array<double>, near array<int>", scratch, dim)
        pairs = _pairs(blocks, residents, F.array_contains("near1", F.col("cell2")))
        return _best(pairs.mapInArrow(meet, f"qid {qid_type}, vec_id {vec_type}, cosine double, tie {tie_type}"), n, ties)

    return look, found


def _best(near: DataFrame, n: int | None, ties: str | None) -> DataFrame:
    if not n:
        return near
    by = Window.partitionBy("qid").orderBy(F.desc("cosine"), *(["tie", "vec_id"] if ties else []))
    return near.withColumn("r", (F.row_number() if ties else F.rank()).over(by)).where(F.col("r") <= n).drop("r")


def nearest_join(vectors: DataFrame, queries: DataFrame, n: int, cell: int = CELL, cells: int = CELLS, block: int = BLOCK, least: float | None = None, ties: str | None = None) -> DataFrame:
    """qid, vec_id, cosine: the n nearest of ``vectors(vec_id, x)`` to each of
    ``queries(qid, qx)`` and all that are as near as the last of them; exact.

    For queries as many as the vectors: both sides stay on the executors, written down once in
    blocks of about ``block``, each of one cell. A query first meets the vectors of its own
    cell, which bounds how far its n-th may be, and then those of the cells that the bound
    doesn't rule out. With ``least`` only neighbours of that cosine or more count, and they
    are all found at once. With ``ties``, a column of ``vectors``, equal cosines stand in its
    order, and a query has n neighbours and no more, however many vectors are equal.
    Zeros have a cosine of 0 with all: zero vectors are a cell of their own, a right angle
    from everything, and zero queries meet every cell. Vectors that are null, hold nulls or
    are of another length than the queries are no neighbours.
    """
    scratch = Scratch(vectors.sparkSession)
    queries = scratch.keep(queries.select("qid", F.col("qx").cast("array<double>").alias("x")))
    dims = [r[0] for r in queries.select(F.size("x")).distinct().limit(2).collect()]
    if len(dims) > 1:
        raise ValueError("queries must have vectors of one length")
    ask, found = asker(vectors, dict(queries.dtypes)["qid"], dims[0] if dims else -1, n, cell, cells, block, ties)
    bounded = lambda df, to: df.select("qid", "x", to.cast("double").alias("least"))
    none = F.lit(float("-inf"))
    if least is not None or len(found) == 1:
        return ask(bounded(queries, F.lit(least) if least is not None else none), True, True).select("qid", "vec_id", "cosine")
    first = scratch.keep(ask(bounded(queries, none), True, False))
    bound = first.groupBy("qid").agg(F.count("*").alias("k"), F.min("cosine").alias("least")).where(F.col("k") >= n).select("qid", "least")
    then = ask(bounded(queries.join(bound, "qid", "left"), F.coalesce("least", none)), False, True)
    return _best(first.unionByName(then), n, ties).select("qid", "vec_id", "cosine")

"""Near-duplicate documents by fast similarity sketching, banding and exact checks.

A document's set holds the hashes (64 bits) of its distinct word shingles. Its sketch
(Dahlgaard, Knudsen and Thorup 2017) fills t coordinates by rounds: in each of the
first t rounds every element throws one value into a random bin, in the next t
rounds into the bin of the round's number, and a bin keeps its least value, early
rounds first. Every coordinate is therefore filled, with the concentration of
independent sampling. Bands of coordinates are join keys, and a pair of 0.8 (0.85)
shares none of the 40 bands of 6 with probability 6e-6 (6e-9).

1. Equal sets are one class, which its smallest document stands for.
2. The members of a band's bucket are compared with one pivot, the smallest of them:
   as many pairs as members. Components are taken of the links found.
3. Buckets whose members lie in several components are live. Among the documents of
   live buckets all pairs of different components that can reach the threshold are
   compared: in an order of shingles by rising frequency, linked sets share one of
   their first (1 - threshold) * n + 1, at places that leave room for the overlap
   (Xiao et al. 2008). Copies edited apart from each other have edits of their own
   first, so a large group of them proposes few pairs, and none is left out.

Both comparisons intersect the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, table, tidied
from .rolling import mix, prefix, span_hash

BANDS, ROWS = 40, 6
#: Members compared with one copy of a pivot's text in one group of rows.
GROUP = 128
_FULL = np.uint64(2**64 - 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``size`` words.

    A-Z count as a-z. A text of fewer words has one shingle, one without words none.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "replace").lower(), dtype=np.uint8)
    edge = np.diff(np.concatenate(([0], (~_SPACE[raw]).view(np.int8), [0])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    words = span_hash(prefix(raw), start, end)
    k = min(size, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        out = (out ^ words[i : i + n]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return np.unique(mix(out))


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """One row of t coordinates per set; a row of an empty set is all ones."""
    out = np.full((len(sets), t), _FULL)
    size = np.array([len(s) for s in sets])
    if not size.sum():
        return out
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    flat, low = out.reshape(-1), np.uint64(2**56 - 1)
    for i in range(2 * t):
        h = mix(values + mix(np.array([i + 1], dtype=np.uint64)))
        bins = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(flat, owner * t + bins, np.uint64(i) << np.uint64(56) | mix(h) & low)
        open_ = (out == _FULL).any(axis=1)
        stay = open_[owner]
        if not stay.any():
            break
        if not stay.all():
            values, owner = values[stay], owner[stay]
    return out


def _signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n, s1, s2 (a digest of the set) and the bands' keys."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                sets = [shingles(t, size) for t in b.column(1).to_pylist()]
                sketch = sketches(sets, bands * rows)
                keys = np.zeros((len(sets), bands), dtype=np.uint64)
                for r in range(rows):
                    keys = mix(keys * np.uint64(31) + sketch[:, r::rows])
                keys = mix(keys + np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x632BE59BD9B4E019))
                one = [np.bitwise_xor.reduce(mix(s + np.uint64(1))) if len(s) else np.uint64(0) for s in sets]
                two = [mix(s + np.uint64(2)).sum(dtype=np.uint64) if len(s) else np.uint64(0) for s in sets]
                yield pa.record_batch(
                    [b.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (one, two)), pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), keys.view(np.int64).reshape(-1))],
                    names=["doc_id", "n", "s1", "s2", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(run), "doc_id long, n long, s1 long, s2 long, bands array<long>")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, part: int, whole: int) -> DataFrame:
    """The pairs (a, b) of which whole * intersection >= part * union holds.

    Each pivot b's members are split into groups of about GROUP, each with a copy
    of the pivot, so that a pivot of many members doesn't fill one task.
    """
    count = pairs.groupBy("b").agg(F.count("*").alias("c"))
    salted = pairs.join(count, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.ceil(F.col("c") / GROUP)))
    need = salted.select(F.col("a").alias("doc_id"), "b", "salt", F.lit(1).alias("role")).unionAll(salted.select(F.col("b").alias("doc_id"), "b", "salt", F.lit(0).alias("role")).distinct())
    rows = need.join(texts, "doc_id").select("b", "salt", "role", F.col("doc_id").alias("a"), "text")

    def run(batches):
        at, pivots = None, []
        for batch in batches:
            found = []
            for b, salt, role, a, text in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (b, salt):
                    at, pivots = (b, salt), []
                mine = shingles(text, size)
                if role == 0:
                    pivots.append(mine)
                    continue
                for other in pivots:
                    if whole * min(len(mine), len(other)) < part * max(len(mine), len(other)):
                        continue
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    if both and whole * both >= part * (len(mine) + len(other) - both):
                        found.append((a, b))
                        break
            yield pa.record_batch([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.repartition("b", "salt").sortWithinPartitions("b", "salt", "role").mapInArrow(tidied(run), "a long, b long").distinct()


def _live(members: DataFrame, comp: DataFrame) -> DataFrame:
    """doc_id, component of the documents in buckets that hold several components."""
    placed = members.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("c"))
    split = placed.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("bucket")
    return placed.join(split, "bucket").select("doc_id", "c").distinct()


def _possible(sets: DataFrame, part: int, whole: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b), a > b, of ``sets(doc_id, th, c, set)`` that may reach the threshold.

    They are of different components c, and all such pairs that do reach it are here.
    """
    items = sets.select("doc_id", "th", F.explode("set").alias("g"))
    often = items.groupBy("g").agg(F.count("*").cast("int").alias("df")).where("df > 1")
    # Shingles that only one set has come first, and need no rows: they shift the others.
    shared = items.join(often, "g").groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("items"))
    own = F.col("n") - F.size("items")
    first = F.greatest(F.col("n") - F.ceil(part * F.col("n") / F.lit(whole)) + 1 - own, F.lit(0)).cast("int")
    heads = shared.join(sets.select("doc_id", "th", "c", F.size("set").alias("n")), ["doc_id", "th"])
    heads = heads.select("doc_id", "c", "n", own.alias("own"), F.posexplode(F.slice("items", 1, first)).alias("i", "item"))
    # room: the most elements that two sets can share which first meet here
    heads = scratch.keep(heads.select("doc_id", "c", "n", F.col("item.g").alias("g"), (F.col("n") - F.col("own") - F.col("i")).alias("room")))
    for _ in range(2):
        met = heads.groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("n").alias("least")).where("low < high").select("g", "least")
        fewer = scratch.keep(heads.join(met, "g").where((whole + part) * F.col("room") >= part * (F.col("n") + F.col("least"))).drop("least"))
        scratch.drop(heads)
        heads = fewer
    one = heads.select(F.col("g").alias("ga"), F.col("doc_id").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("room").alias("ra"))
    two = heads.select(F.col("g").alias("gb"), F.col("doc_id").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"), F.col("room").alias("rb"))
    fits = (whole * F.least("na", "nb") >= part * F.greatest("na", "nb")) & ((whole + part) * F.least("ra", "rb") >= part * (F.col("na") + F.col("nb")))
    met = one.join(two, (F.col("ga") == F.col("gb")) & (F.col("ca") != F.col("cb")) & (F.col("a") > F.col("b")) & fits)
    out = scratch.keep(met.select("a", "b").distinct())
    scratch.drop(heads)
    return out


def near_duplicates(docs: DataFrame, size: int = 5, part: int = 80, whole: int = 100, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs(doc_id, text)``.

    Documents are linked if whole * intersection >= part * union of their shingle
    sets; a component's id is its smallest doc_id, which alone is kept. Null texts
    and texts without words have empty sets and link with nothing. Rows with one
    doc_id are one node, linked if any of their texts is. A null doc_id has a null
    component and isn't kept. An empty table has no rows. Other columns of ``docs``
    are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = scratch.keep(_signatures(docs, size, bands, rows))
    usable = sig.where("doc_id IS NOT NULL AND n > 0")
    classes = scratch.keep(usable.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")))
    same = usable.select("doc_id", "n", "s1", "s2").join(classes.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"]).where("doc_id <> rep")
    banded = classes.select(F.col("rep").alias("doc_id"), "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min(F.struct("doc_id", "n")).alias("pivot"), F.max("doc_id").alias("top")).where("pivot.doc_id < top").select("bucket", "pivot")
    members = scratch.keep(banded.join(shared, "bucket").select("bucket", "doc_id", "n", "pivot"))
    texts = scratch.keep(docs.join(members.select("doc_id").distinct(), "doc_id", "left_semi"))
    near_size = whole * F.least("n", "pivot.n") >= part * F.greatest("n", "pivot.n")
    pairs = members.where((F.col("doc_id") != F.col("pivot.doc_id")) & near_size).select(F.col("doc_id").alias("a"), F.col("pivot.doc_id").alias("b"))
    pairs = scratch.keep(pairs.distinct())
    links = same.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).unionAll(_confirmed(pairs, texts, size, part, whole))
    first = components(links, scratch)
    live = scratch.keep(_live(members.select("bucket", "doc_id"), first))
    # A doc_id of several texts has a set for each of them.
    sets = texts.join(live, "doc_id").select("doc_id", F.xxhash64("text").alias("th"), "c", "text").dropDuplicates(["doc_id", "th"])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                found = [shingles(t, size).view(np.int64) for t in b.column(3).to_pylist()]
                edges = np.cumsum([0, *map(len, found)], dtype=np.int32)
                yield pa.record_batch([*(b.column(i) for i in range(3)), pa.ListArray.from_arrays(edges, np.concatenate(found))], names=["doc_id", "th", "c", "set"])

    sets = scratch.keep(sets.mapInArrow(tidied(run), "doc_id long, th long, c long, set array<long>"))
    possible = _possible(sets, part, whole, scratch)
    more = first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(_confirmed(possible, texts, size, part, whole))
    comp = components(more, scratch)
    for done in (classes, members, texts, pairs, first, live, sets, possible):
        scratch.drop(done)
    out = sig.select("doc_id", F.col("n").alias("n_shingles")).join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    id_ = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", id_.alias("component_id"), F.coalesce(F.col("doc_id") == id_, F.lit(False)).alias("kept"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_duplicates`` of documents: shingles of three words, similarity 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, part=85)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: shingles of five words, similarity 0.8.

    Rows of one doc_id are one document, which stays or goes with all its rows. A row
    without doc_id, with a null text or without words is compared with nothing and
    stays. All columns of ``docs`` are kept as they are, whatever they are called.
    """
    gone = near_duplicates(docs).where("NOT kept").select("doc_id")
    return docs.alias("d").join(gone.alias("g"), F.col("d.doc_id") == F.col("g.doc_id"), "left_anti")

"""Winnowing fingerprints (Schleimer, Wilkerson, Aiken 2003).

Every k-gram of code points is hashed; of each window of w consecutive hashes
the smallest is chosen, the rightmost on ties, and its position kept. Two texts
that share a passage of k + w - 1 code points share a chosen hash, and nothing
shorter than k is matched. Texts shorter than k are one gram; those shorter than a
window choose the least of the grams they have; the empty text chooses none.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, tidied
from .rolling import PIECE, gram_hashes, prefix, span_hash, window_minima

K, W = 20, 30


def winnow(codes: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) chosen from an array of code points, by position."""
    n = len(codes)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if n < k:
        return span_hash(prefix(codes), np.array([0]), np.array([n])), np.zeros(1, np.int64)
    hashes, at = [], []
    span = k + w - 1
    # Pieces overlap by all but one code point of a window, so no window is lost.
    for start in range(0, max(1, n - span + 1), PIECE):
        grams = gram_hashes(prefix(codes[start : start + PIECE + span - 1]), k)
        chosen = window_minima(grams, min(w, len(grams)))
        chosen = chosen[np.flatnonzero(np.diff(chosen, prepend=-1))]
        hashes.append(grams[chosen])
        at.append(chosen + start)
    if len(at) == 1:
        return hashes[0], at[0]
    position, first = np.unique(np.concatenate(at), return_index=True)
    return np.concatenate(hashes)[first], position


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), dtype=np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of chosen hashes, of the bits that fingerprints
    hold; two empty ones are alike."""
    a, b = np.unique(a.astype(np.uint32)), np.unique(b.astype(np.uint32))
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def encode(hashes: np.ndarray, positions: np.ndarray) -> str:
    """``hashes:gaps``, both base64: 32 bits a hash, and positions as varint gaps."""
    gaps = np.diff(positions, prepend=0)
    if len(gaps) and gaps.max() < 128:
        packed = gaps.astype(np.uint8).tobytes()
    else:
        out = bytearray()
        for g in gaps.tolist():
            while g >= 128:
                out.append(g & 127 | 128)
                g >>= 7
            out.append(g)
        packed = bytes(out)
    short = (hashes & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()  # chosen hashes have small high bits
    return f"{base64.b64encode(short).decode()}:{base64.b64encode(packed).decode()}"


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, n_chars, hashes array<long>, positions array<long> of each row of
    ``docs(doc_id, text)``. A null text counts as empty and has empty arrays."""

    def run(batches):
        for b in batches:
            rows = [winnow(code_points(t), k, w) for t in b.column(1).to_pylist()]
            size = pa.array([len(t or "") for t in b.column(1).to_pylist()], pa.int64())
            hashes, positions = (pa.array(x, pa.list_(pa.int64())) for x in zip(*((h.view(np.int64).tolist(), p.tolist()) for h, p in rows))) if rows else (pa.array([], pa.list_(pa.int64())),) * 2
            yield pa.record_batch([b.column(0), size, hashes, positions], names=["doc_id", "n_chars", "hashes", "positions"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(run), "doc_id long, n_chars long, hashes array<long>, positions array<long>")


def in_order(docs: DataFrame) -> DataFrame:
    """Rows of ``docs(doc_id, text)`` as (run, last, doc_id, text), each followed by
    the row with the next higher id.

    About sqrt(rows) quantiles of the ids cut the table into runs; a run lies
    sorted in one partition. A run's first row is also sent, marked ``last``, to
    the end of the run before it (the first run's to the last run), so one shuffle
    of the texts is enough. What is broadcast is one row a run, sqrt(rows) at most:
    3 MB for 10**11 documents. Null ids come first; rows of one id go by text.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = keyed.count()
    parts = math.isqrt(n)
    # A cut rounded to a double is still one fixed number, which is all a cut must be.
    cuts = np.unique(np.array(keyed.approxQuantile("key", [i / parts for i in range(1, parts)], 0.2 / parts), dtype=np.float64)) if parts > 1 else np.empty(0)

    @F.pandas_udf("int")
    def run_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(dtype=np.float64), side="right").astype(np.int32))

    keyed = keyed.withColumn("run", run_of("key"))
    firsts = keyed.groupBy("run").agg(F.min("key").alias("first_key"))
    order = Window.orderBy("run")
    firsts = firsts.select("run", "first_key", F.coalesce(F.lag("run").over(order), F.max("run").over(Window.partitionBy())).alias("to"))
    own, mark = F.struct(F.col("run").alias("r"), F.lit(False).alias("last")), F.struct(F.col("to").alias("r"), F.lit(True).alias("last"))
    both = keyed.join(F.broadcast(firsts), "run").withColumn("at", F.explode(F.when(F.col("key") == F.col("first_key"), F.array(own, mark)).otherwise(F.array(own))))
    both = both.select(F.col("at.r").alias("run"), F.col("at.last").alias("last"), "key", "doc_id", "text")
    return both.repartitionByRange("run").sortWithinPartitions("run", "last", "key", "text").select("run", "last", "doc_id", "text")


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text; see the module.

    A null text counts as empty, an empty one has an empty fingerprint; rows of one id
    go by text, null ids first; an empty table has no rows; other columns are ignored.
    """

    def judged(doc_id, text, mine, following, its):
        text, following = text or "", following or ""
        edit = edited_text(text, following)
        changed = winnow(code_points(edit))
        return (doc_id, len(text), hashlib.sha256(edit.encode()).hexdigest(), encode(*mine), encode(*changed), likeness(mine[0], changed[0]), likeness(mine[0], its[0]))

    def run(batches):
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held = None  # the row that waits for its successor
        for b in batches:
            out = []
            for at, last, doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[0] != at:
                    held = None
                if last and held is None:
                    continue  # a further mark of the same run
                mine = winnow(code_points(text))
                if held:
                    out.append(judged(*held[1:], text, mine))
                held = None if last else (at, doc_id, text, mine)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], names=names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(table(spark, sf_dir, "documents")).mapInArrow(tidied(run), schema)

"""Ranked lexical search: WAND over shards of documents.

One pass turns every text into its length and its counts of the queries' terms, written
down by document. Whole-table statistics come from that table. A shard is a run of its
documents: a task inverts them into one list a term, each posting with its exact part of a
score and each list with the largest one, and runs every query over the lists in order of
documents. The pivot is the first document at which the largest parts of the lists up to it
reach the heap's lowest score; lists before it jump there, and documents between are never
looked at. A task's heaps go on from shard to shard, and their rows are merged by windows
in two steps, so that no item's rows of all tasks meet at once.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, tidied

#: A term is a run of ASCII letters, digits and anything beyond ASCII; A-Z are lowered.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Items, and bytes of their texts, whose terms are sent to every task at once.
ITEMS_AT_ONCE, BYTES_AT_ONCE = 2_000, 16 << 20
#: Documents, and postings, of a shard at most; one document is never split.
SHARD_DOCS, SHARD_POSTINGS = 20_000, 4_000_000
#: First-step groups of an item's rows when heaps are merged.
MERGE_SALTS = 32


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERM_BYTES).split()


def _forward(docs: DataFrame, places: dict[bytes, int]) -> DataFrame:
    """doc_id, n, t, tf of documents with a term: those of ``places``, and how often."""
    names, known = ["doc_id", "n", "t", "tf"], places.keys()

    def run(batches):
        for b in batches:
            ids, sizes, edges, at, often = [], [], [0], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = terms(text)
                if not found:
                    continue
                counts = Counter(found)
                ids.append(doc_id)
                sizes.append(len(found))
                for term in counts.keys() & known:
                    at.append(places[term])
                    often.append(counts[term])
                edges.append(len(at))
            lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x, pa.int32())) for x in (at, often)]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], names=names)

    return docs.mapInArrow(tidied(run), "doc_id long, n long, t array<int>, tf array<int>")


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2df + 1))) of each term, 0 or more."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)


class Shard:
    """Documents by ascending id, and a list (documents, parts of scores, largest part) a term."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, t: np.ndarray, tf: np.ndarray, edges: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.end = ids[order], len(ids)
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        doc = np.repeat(place, np.diff(edges))
        m = np.empty(len(ids), dtype=np.int64)
        m[place] = 25 + (75 * n * n_docs) // n_terms
        by_term = np.lexsort((doc, t))
        doc, t, tf = doc[by_term], t[by_term], tf[by_term].astype(np.int64)
        self.docs, self.parts = doc, weight[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        self.starts = np.searchsorted(t, np.arange(len(weight) + 1))
        self.made: dict[int, tuple[list[int], list[int], int] | None] = {}

    def list_of(self, term: int) -> tuple[list[int], list[int], int] | None:
        if term not in self.made:
            low, high = self.starts[term], self.starts[term + 1]
            parts = self.parts[low:high]
            top = int(parts.max()) if low < high else 0
            self.made[term] = (self.docs[low:high].tolist() + [self.end], parts.tolist() + [0], top) if top else None
        return self.made[term]


def wand(shard: Shard, query: list[tuple[int, int]], heap: list[tuple[int, int]], k: int) -> int:
    """Puts a shard's documents into ``heap`` of (score, -id), the k best so far.

    ``query`` is (term, how often). Returns how many documents were scored.
    """
    found = [(shard.list_of(t), times) for t, times in query]
    found = [(x, times) for x, times in found if x]
    docs, parts = [x[0] for x, _ in found], [x[1] if times == 1 else [times * p for p in x[1]] for x, times in found]
    tops, width, end, ids, scored = [x[2] * times for x, times in found], len(found), shard.end, shard.ids, 0
    if not width:
        return 0
    at, bits = [0] * width, width.bit_length()
    mask = (1 << bits) - 1
    heads = sorted(d[0] << bits | i for i, d in enumerate(docs))  # next document and list, in order
    least = heap[0][0] if len(heap) == k else 1
    while True:
        reach = 0
        for p, head in enumerate(heads):
            reach += tops[head & mask]
            if reach >= least:
                break
        else:
            return scored
        pivot = head >> bits
        if pivot >= end:
            return scored
        if heads[0] >> bits == pivot:
            score, p = 0, 0
            for head in heads:
                if head >> bits != pivot:
                    break
                i = head & mask
                j = at[i]
                score += parts[i][j]
                at[i] = j = j + 1
                heads[p] = docs[i][j] << bits | i
                p += 1
            scored += 1
            if score >= least:
                entry = (score, -int(ids[pivot]))
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
                least = heap[0][0] if len(heap) == k else 1
        else:
            for q in range(p):
                head = heads[q]
                if head >> bits == pivot:
                    break
                i = head & mask
                at[i] = j = bisect_left(docs[i], pivot, at[i])
                heads[q] = docs[i][j] << bits | i
        heads.sort()


NO_ID = (1 << 63) - 1


def _shards(batches):
    """(ids, n, t, tf, edges) of runs of documents, whatever the batches are."""
    held, docs, postings = [], 0, 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            one = b.slice(at, SHARD_DOCS - docs if docs < SHARD_DOCS else 1)
            held.append(one)
            at, docs, postings = at + one.num_rows, docs + one.num_rows, postings + len(one.column(2).flatten())
            if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield pa.Table.from_batches(held).combine_chunks()
                held, docs, postings = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _best_by_task(forward: DataFrame, queries: list[list[tuple[int, int]]], weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item (its place), score, doc_id, task: each task's k best of each query."""

    def run(batches):
        heaps: list[list[tuple[int, int]]] = [[] for _ in queries]
        for part in _shards(batches):
            t, tf = (part.column(c).chunk(0) for c in ("t", "tf"))
            ids = part.column("doc_id").fill_null(NO_ID).to_numpy()
            edges = t.offsets.to_numpy().astype(np.int64)
            shard = Shard(ids, part.column("n").to_numpy(), t.flatten().to_numpy(), tf.flatten().to_numpy(), edges - edges[0], weight, n_docs, n_terms)
            for query, heap in zip(queries, heaps):
                wand(shard, query, heap, k)
        rows = [(i, score, -low) for i, heap in enumerate(heaps) for score, low in heap]
        item, score, doc_id = zip(*rows) if rows else ((), (), ())
        yield pa.record_batch([pa.array(item, pa.int32()), pa.array(score, pa.int64()), pa.array(doc_id, pa.int64())], names=["item", "score", "doc_id"])

    return forward.mapInArrow(tidied(run), "item int, score long, doc_id long")


def _ranked(rows: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """item_id, rank, doc_id, score of the k best rows of ``docs(doc_id, text)`` for each
    item of ``items(item_id, text)``.

    Rows with a score of 0 are never returned, so an item without terms, or whose terms
    no document has, has no rows. Equal scores go by doc_id, a null one last. Null texts
    have no terms, and documents without a term don't count in any statistic. Rows of one
    item_id are one item, with the terms of its distinct texts; rows of one doc_id are
    documents of their own. Tables may be empty; other columns are ignored. Items go in
    blocks of about ``items_at_once``, each with one pass over the documents.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks, found = max(1, -(-n // items_at_once), -(-size // BYTES_AT_ONCE)), None
    for block in range(blocks):
        asked: dict[int | None, Counter] = {}
        for row in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect():
            asked.setdefault(row.item_id, Counter()).update(terms(row.text))
        names = sorted(asked, key=lambda i: (i is None, i))
        places = {t: i for i, t in enumerate(sorted(set().union(*asked.values())))}
        queries = [sorted((places[t], times) for t, times in asked[i].items()) for i in names]
        forward = scratch.keep(_forward(docs, places))
        n_docs, n_terms = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
        df = np.zeros(len(places), dtype=np.int64)
        for term, often in forward.select(F.explode("t").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
            df[term] = often
        rows = _best_by_task(forward, queries, weights(df, n_docs), n_docs, n_terms, k)
        rows = _ranked(rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(MERGE_SALTS))), k, "item", "salt")
        named = spark.createDataFrame(list(enumerate(names)), "item int, item_id long")  # a block's items
        doc_id = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
        best = scratch.keep(_ranked(rows.drop("rank"), k, "item").join(F.broadcast(named), "item").select("item_id", "rank", doc_id, "score"))
        scratch.drop(forward)
        found = best if found is None else found.unionAll(best)
    return found


def op12_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for every benchmark item, by ``search``."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH dt AS (SELECT doc_id, unnest({_TERMS}) AS t FROM documents),
it AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL),
dn AS (SELECT doc_id, count(*) AS n FROM dt GROUP BY doc_id),
al AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM dn),
tf AS (SELECT doc_id, t, count(*) AS tf FROM dt WHERE t IN (SELECT t FROM it) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, al GROUP BY t, n_docs),
sc AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM tf JOIN dn USING (doc_id) JOIN w USING (t) JOIN it USING (t), al GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM sc WHERE score > 0) WHERE rank <= 10"""

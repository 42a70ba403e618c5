"""Exact duplicates, lexical search and the rewrite of drifted files, against brute force."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from mnemora.llm import exact, rewrite, search

# --- exact duplicates ------------------------------------------------------------


def brute_duplicates(rows):
    """Sorted (doc_id, keep_id, group_size, kept, sha) of (doc_id, text) rows."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc_id, text or ""))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        spare = 1
        for m in members:
            as_good = len(m[1]) == len(best[1]) and m[0] == best[0]
            kept, spare = as_good and spare > 0, spare - as_good
            out.append((m[0], best[0], len(members), kept, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def duplicates(frame, **fine):
    return sorted((tuple(r) for r in exact.exact_duplicates(frame, **fine).collect()), key=repr)


def some_texts():
    rng = random.Random(3)
    base = ["", " \n", "abc", "ab c", "a\tbc", "abd", "ab", "ü b", "üb", "x" * 5000, "x" * 4999 + " x", "x" * 4999 + "y", "é", "é", "a b", "a b"]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(len(base), 400):
        t = rng.choice(base) if rng.random() < 0.5 else "".join(rng.choice("ab \n") for _ in range(rng.randrange(40)))
        rows.append((i, t))
    rows += [(None, "abc"), (None, None), (5, "abd"), (5, "abd"), (900, "only   here"), (900, "only   here"), (None, "lost"), (None, "lost")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("fine", [{}, {"hash_bits": 0}, {"spill_bytes": 1500, "local_bytes": 900}, {"hot_rows": 5}, {"hot_rows": 3, "spill_bytes": 700, "hash_bits": 2}])
def test_exact_duplicates_against_brute_force(spark, fine):
    rows = some_texts()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert duplicates(frame, **fine) == brute_duplicates(rows)


def test_exact_duplicates_of_empty_and_odd_tables(spark):
    assert duplicates(spark.createDataFrame([], "doc_id long, text string")) == []
    odd = spark.createDataFrame([(1, "a b", 7, "n", True), (2, "ab", 8, "o", False)], "doc_id int, text string, keep_id int, n string, kept boolean")
    assert duplicates(odd) == brute_duplicates([(1, "a b"), (2, "ab")])
    assert duplicates(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")) == brute_duplicates([(1, None), (2, "")])


def test_tries_hold_what_is_put_in_and_give_subtrees_away():
    rng = random.Random(5)
    trie, plain = exact.Trie(lambda a, b: a + b), Counter()
    for _ in range(3000):
        key = bytes(rng.choice(b"abc") for _ in range(rng.randrange(9)))
        trie.add(key, 1)
        plain[key] += 1
    assert dict(trie.items()) == plain and trie.terminals == len(plain)
    assert [k for k, _ in trie.items()] == sorted(plain)

    def weighed(node):
        assert node.weight == len(node.label) + exact.NODE_BYTES + sum(map(weighed, node.children.values()))
        return node.weight

    weighed(trie.root)
    gone = dict(trie.spill(trie.weight // 3))
    left = dict(trie.items())
    assert gone and left and not gone.keys() & left.keys() and gone | left == plain
    assert all(trie.was_given(k) for k in gone)
    weighed(trie.root)
    assert len(dict(trie.spill(0))) + 1 == len(left)  # one string is always held


# --- ranked lexical search --------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k=10):
    bags = [(doc_id, Counter(brute_terms(text))) for doc_id, text in docs]
    bags = [(doc_id, bag) for doc_id, bag in bags if bag]
    n_docs, n_terms = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, bag in bags:
            m = 25 + (75 * bag.total() * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in brute_terms(text) if t in bag)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        for rank, (less, null, doc_id) in enumerate(sorted(found)[:k], 1):
            out.append((item_id, rank, None if null else doc_id, -less))
    return sorted(out, key=repr)


def searched(docs, items, **fine):
    return sorted((tuple(r) for r in search.search(docs, items, **fine).collect()), key=repr)


def some_docs(n=500):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["Öl", "öl", "naïve", "x1", "日本", "A", "b", "it's"]
    pick = lambda most: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=rng.randrange(1, most)))
    docs = [(i, pick(60)) for i in range(n)]
    docs += [(None, pick(30)), (None, None), (n, ""), (n + 1, " -!\x00 "), (3, docs[3][1]), (7, pick(9)), (n + 2, "w1 " * 30_000), (n + 3, docs[4][1]), (n + 4, docs[4][1])]
    items = [(i, pick(14)) for i in range(25)] + [(90, "w1 W1 w1 w59"), (91, ""), (92, "unheard of"), (93, None), (94, docs[4][1])]
    return docs, items


@pytest.mark.parametrize("fine", [{}, {"k": 3}, {"items_at_once": 4}])
def test_search_against_brute_force(spark, fine, monkeypatch):
    docs, items = some_docs()
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert searched(*frames, **fine) == brute_search(docs, items, fine.get("k", 10))


def test_search_of_empty_and_odd_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert searched(docs, items) == []
    full = spark.createDataFrame([(1, "a b", "x", 2), (2, "b", "y", 3)], "doc_id int, text string, score string, t int")
    assert searched(full, items.limit(0)) == []
    twice = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (1, "b", 6)], "item_id long, text string, rank int")
    assert searched(full, twice) == brute_search([(1, "a b"), (2, "b")], [(1, "a b")])


def test_wand_equals_full_scores_and_scores_fewer():
    rng = np.random.default_rng(2)
    n, width = 4000, 30
    doc, t = np.nonzero(rng.random((n, width)) < 0.6 / (1 + np.arange(width)))
    tf = rng.integers(1, 9, len(doc))
    edges = np.searchsorted(doc, np.arange(n + 1))
    ids, sizes = rng.permutation(n), rng.integers(20, 200, n)
    weight = search.weights(np.bincount(t, minlength=width), n)
    shard = search.Shard(ids, sizes, t.astype(np.int32), tf, edges, weight, n, int(sizes.sum()))
    full = np.zeros(n, dtype=np.int64)
    np.add.at(full, shard.docs, shard.parts * np.where(np.repeat(np.arange(width), np.diff(shard.starts)) == 2, 2, 1))
    heap: list = []
    scored = search.wand(shard, [(i, 2 if i == 2 else 1) for i in range(width)], heap, 10)
    assert sorted(heap, reverse=True) == heapq.nlargest(10, zip(full.tolist(), (-shard.ids).tolist()))
    assert scored < np.count_nonzero(full) / 2


def test_shards_do_not_depend_on_batches():
    parts = [pa.record_batch([pa.array([i]), pa.array([2]), pa.array([[i, 1]], pa.list_(pa.int32())), pa.array([[1, 1]], pa.list_(pa.int32()))], names=["doc_id", "n", "t", "tf"]) for i in range(9)]
    got = list(search._shards(iter(parts)))
    assert len(got) == 1 and got[0].num_rows == 9 and got[0].column("t").chunk(0).flatten().to_pylist()[::2] == list(range(9))


# --- the rewrite of drifted files ---------------------------------------------------

SCHEMA = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"


def clients(n):
    rng = random.Random(n)
    some = lambda v: None if rng.random() < 0.1 else v
    rows = []
    for i in range(n):
        rows.append((i * 7, some(rng.randrange(n)), some("web"), some(datetime(2024, 1, 1) + timedelta(microseconds=rng.randrange(10**13))), some(f"Né {i}"), some(f"{i}@x"), some("town"), some(rng.randrange(25)), some("a|b"), some(round(rng.uniform(-1000, 9999), 2))))
    return rows


def brute_rewrite(rows, files):
    """file_no to (version, n_rows, n_nulls, ids, rows, start columns) as the contract says."""
    key = lambda r: (r[0] is None, zlib.crc32(str(r[0]).encode()), r[0] or 0)
    ordered, per = sorted(rows, key=key), 1 + len(rows) // files
    names, out = rewrite.COLUMNS, {}
    for no in range(-(-len(rows) // per)):
        v = zlib.crc32(f"7:{no}".encode()) % 24
        v = 0 if v > 15 else v
        mine = []
        for r in ordered[no * per : (no + 1) * per]:
            r = list(r)
            if v & 4:
                r[6], r[7] = "none", -1
            if v & 8 and r[9] is not None:
                r[9] = float(np.float32(r[9]))
            mine.append(r)
        lines = []
        for r in mine:
            r = list(r)
            r[3] = None if r[3] is None else (r[3] - datetime(1970, 1, 1)) // timedelta(microseconds=1)
            r[9] = None if r[9] is None else math.floor(1048576 * r[9])
            lines.append("|".join("?" if x is None else str(x) for x in r))
        start = [c for c in names if not (v & 4 and c in ("nation_id", "city"))]
        if v & 1:
            start = [{"name": "email", "email": "name"}.get(c, c) for c in start]
        start = start[:1] + start[:0:-1] if v & 2 else start
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        ids = ",".join("?" if r[0] is None else str(r[0]) for r in mine)
        out[no] = (v, len(mine), sum(x is None for r in mine for x in r), digest(ids), digest("\n".join(lines)), ",".join(start))
    return out


@pytest.mark.parametrize("n,files", [(997, 40), (30, 40), (1, 5)])
def test_rewrite_against_brute_force(spark, n, files):
    rows = clients(n)
    found = rewrite.rewrite_drifted(spark.createDataFrame(rows, SCHEMA).repartition(4), files).collect()
    want = brute_rewrite(rows, files)
    assert {r.file_no: (r.version, r.n_rows, r.n_nulls, r.ids_sha256, r.rows_sha256, r.start_columns) for r in found} == want
    assert all(r.columns == ",".join(rewrite.COLUMNS) and r.rewritten == (r.version != 0) for r in found)
    folder = Path(found[0].path).parent
    assert sorted(p.name for p in folder.iterdir()) == sorted(Path(r.path).name for r in found)
    for r in found:
        schema = pq.read_schema(r.path)
        assert [rewrite.field_id(f) for f in schema] == list(range(1, 11)) and schema.field("nation_id").type == pa.int64() and all(f.nullable for f in schema)


def test_rewrite_of_nulls_repeats_and_clashing_columns(spark):
    rows = clients(40)
    rows += [rows[3], (None, *rows[4][1:]), (None, *rows[4][1:])]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("place", F.lit(1)).withColumn("_part", F.lit("x")).withColumn("row", F.lit(0)).withColumn("a.b", F.lit(0))
    found = rewrite.rewrite_drifted(frame, 6).collect()
    assert {r.file_no: (r.version, r.n_rows, r.n_nulls, r.ids_sha256, r.rows_sha256, r.start_columns) for r in found} == brute_rewrite(rows, 6)
    assert rewrite.rewrite_drifted(frame.limit(0)).collect() == []


def test_rewrite_steps_can_be_run_again(spark, tmp_path):
    """A task that is run twice, or after the others have moved on, changes nothing."""
    schema = rewrite.evolved_schema(pa.schema([("client_id", pa.int64()), ("city", pa.string()), ("nation_id", pa.int32()), ("balance", pa.float64())]), {"nation_id": pa.int64()})
    folder = f"{tmp_path}/data"
    for sub in ("data", "new", "half"):
        (tmp_path / sub).mkdir()
    rows = spark.createDataFrame([(i // 5, i, (i, "c", i, 0.1 * i)) for i in range(20)], "file_no long, place long, row struct<client_id: long, city: string, nation_id: long, balance: double>")
    version = lambda i: 4 * (i % 3)
    for _ in range(2):
        rewrite.write_files(rows, folder, schema, version, 4).count()
    for _ in range(2):
        said = {r.file_no: r for r in rewrite.rewrite_files(spark, folder, schema, version, 4, rewrite.MISSING).collect()}
    for _ in range(2):
        rewrite.move_files(spark, folder, 4).count()
    assert [said[i].start_columns for i in range(3)] == ["client_id,city,nation_id,balance", "client_id,balance", "client_id,city,nation_id,balance"]
    for i in range(4):
        got = pq.read_table(f"{folder}/{rewrite._name(i)}")
        assert got.column("client_id").to_pylist() == list(range(5 * i, 5 * i + 5)) and got.schema.names == schema.names
        assert set(got.column("city").to_pylist()) == {"none" if version(i) & 4 else "c"}
        assert got.column("balance")[1].as_py() == (float(np.float32(0.1 * (5 * i + 1))) if version(i) & 8 else 0.1 * (5 * i + 1))
    assert not list((tmp_path / "half").iterdir()) and not list((tmp_path / "new").iterdir())

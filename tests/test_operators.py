import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora.functions import scalars as S
from mnemora.operators import conflicts, graph, log, recall


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "text string").select(col.alias("x")).first().x


def test_tokenize(spark):
    assert one(spark, "Don't stop, it’s 3 o_k", S.tokenize(F.col("text"))) == ["dont", "stop", "its", "3", "o_k"]
    assert one(spark, "東京都x ok 東", S.tokenize(F.col("text"))) == ["東京都x", "ok", "東", "東京", "京都"]
    assert one(spark, None, S.tokenize(F.col("text"))) == []


def test_scalars(spark):
    assert one(spark, "  A  b\tC ", S.content_hash(F.col("text"))) == one(spark, "a b c", S.content_hash(F.col("text")))
    assert [one(spark, t, S.estimate_tokens(F.col("text"))) for t in ("", "x" * 10, "x" * 14)] == [1, 2, 4]
    assert one(spark, "deploy the android client", S.key_phrases(F.col("text"))) == ["deploy android", "android client", "deploy"]
    assert one(spark, "android client", S.fanout_queries(F.col("text"))) == ["android client", "android", "client"]
    assert one(spark, "Always use ruff for linting please", S.importance(F.col("text"), F.lit("procedural"))) == 0.98
    assert one(spark, "Maybe?", S.importance(F.col("text"), F.lit("semantic"))) == 0.1
    assert [one(spark, t, S.parse_duration(F.col("text"))) for t in ("30m", "7d", "bad")] == [1800, 604800, None]
    assert one(spark, "x", S.negation_differs(F.array(F.lit("never"), F.lit("use")), F.array(F.lit("use")))) is True
    with pytest.raises(ValueError):
        S.key_phrases(F.col("text"), -1)


@pytest.mark.parametrize(
    "got, want, k, expected",
    [
        ("axby", "ab", 4, (1, 0.5, 1, 0.833333, 0.919721)),
        ("xyz", "a", 3, (0, 0, 0, 0, 0)),
        ("aab", "ab", 3, (1, 1, 1, 0.833333, 0.919721)),
        ("b", "ab", 1, (0.5, 1, 1, 0.5, 1)),
        ("ba", "ab", 2, (1, 1, 1, 1, 1)),
        ("", "a", 5, (0, 0, 0, 0, 0)),
    ],
)
def test_metrics(spark, got, want, k, expected):
    hits = spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(got)], "qid long, id string, rank int")
    gold = spark.createDataFrame([(1, x) for x in want], "qid long, id string")
    r = log.metrics(hits, gold, k).first()
    assert tuple(r)[1:] == pytest.approx(expected, abs=1e-6)


def test_state_at_replays_links_and_nuke(spark):
    rows = [(1, 1.0, "remember", "a", None, None, "one"), (2, 2.0, "link", "a", "b", "refines", None), (3, 3.0, "nuke", None, None, None, None), (4, 4.0, "remember", "b", None, None, "two"), (5, 5.0, "link", "b", "c", "related", None), (6, 6.0, "link", "b", "d", "related", None), (7, 7.0, "unlink", "b", "c", "related", None), (8, 8.0, "forget", "b", None, None, None)]
    j = spark.createDataFrame(rows, "seq long, us double, op string, id string, dst_id string, rel string, text string")
    assert [(r.id, r.links) for r in log.state_at(j, 2.5).collect()] == [("a", 1)]
    assert [(r.id, r.text, r.links) for r in log.state_at(j, 7.5).collect()] == [("b", "two", 1)]
    assert log.state_at(j, 9.0).count() == 0


def links(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, rel string")


def ids(spark, letters):
    return spark.createDataFrame([(x,) for x in letters], "id string")


def test_walks(spark):
    e = links(spark, [("a", "b", "refines"), ("a", "b", "related"), ("a", "c", "related"), ("b", "d", "related"), ("c", "d", "refines"), ("d", "gone", "related"), ("x", "a", "refines")])
    known, seed = ids(spark, "abcdx"), spark.createDataFrame([("a",)], "seed string")
    got = {(r.id, r.rel, r.depth) for r in graph.neighbors(seed, e, known, 3, "out").collect()}
    assert got == {("b", "refines", 1), ("b", "related", 1), ("c", "related", 1), ("d", "related", 2)}
    got = {(r.id, r.rel, r.depth) for r in graph.neighbors(seed, e, known, 1, "both", "refines").collect()}
    assert got == {("b", "refines", 1), ("x", "refines", 1)}
    assert graph.neighbors(seed, e, known, 0).count() == 0
    assert graph.subgraph(seed, e, 2).count() == 5
    with pytest.raises(ValueError):
        graph.neighbors(seed, e, known, 1, "sideways")


def test_paths(spark):
    e = links(spark, [("a", "b", "refines"), ("a", "b", "related"), ("a", "c", "related"), ("b", "d", "related"), ("c", "d", "contradicts"), ("d", "e", "related")])
    known = ids(spark, "abcdez")
    assert graph.find_path(e, known, "e", "a") == [("e", ""), ("d", "related"), ("b", "related"), ("a", "refines")]
    assert graph.find_path(e, known, "a", "z") == [] == graph.find_path(e, known, "a", "nobody")
    assert graph.find_path(e, known, "a", "a") == [("a", "")]
    assert graph.find_path(e, known, "a", "e", most=2) == []


def brute_path(edges, start, end, most):
    """The least of the shortest paths, of all of them written out."""
    near = {}
    for a, b, rel in edges:
        near.setdefault(a, set()).add((b, rel))
        near.setdefault(b, set()).add((a, rel))
    paths = [[(start, "")]]
    for _ in range(most + 1):
        if hit := [p for p in paths if p[-1][0] == end]:
            return min(hit)
        paths = [[*p, step] for p in paths for step in near.get(p[-1][0], ()) if step[0] not in {x for x, _ in p}]
    return None


def test_paths_from_both_ends(spark):
    """Equal to all paths written out: chains, hubs, parallel links, lengths up to the most."""
    rng = random.Random(8)
    names = [f"n{i:02}" for i in range(26)]
    edges = [(names[i], names[i + 1], "related") for i in range(9)] + [("n12", names[i], "refines") for i in range(13, 20)]
    edges += [(rng.choice(names), rng.choice(names), rng.choice(("related", "refines"))) for _ in range(9)] + [("n12", "n13", "contradicts"), ("n20", "gone", "related"), ("gone", "n21", "related")]
    pairs = [(a, b) for a in names[::2] for b in names[::3]] + [("n00", "n06"), ("n00", "n07"), ("n20", "n21"), ("n01", "gone")]
    for most in (5, 6):
        got = {(r.start, r.end): [tuple(x) for x in r.path] for r in graph.find_paths(spark.createDataFrame(pairs, "start string, end string"), links(spark, edges), ids(spark, names), most).collect()}
        want = {p: path for p in set(pairs) if p[1] != "gone" and (path := brute_path(edges, *p, most))}
        assert got == want and max(map(len, want.values())) == most + 1


def greedy(rows, x, threshold, least):
    """Leader clustering as one loop over all rows: (importance, created_at, id, polarity)."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1], rows[i][2]))
    used, out = set(), set()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for i in sorted(order, key=lambda i: -rows[i][0]):
        if i in used:
            continue
        used.add(i)
        mood, members = rows[i][3], [i]
        for j in order:
            if j not in used and mood * rows[j][3] >= 0 and unit[i] @ unit[j] >= threshold:
                members.append(j)
                used.add(j)
                mood = mood or rows[j][3]
        if len(members) >= least:
            out |= {(rows[j][2], rows[i][2], len(members), at) for at, j in enumerate(members)}
    return out


@pytest.mark.parametrize("n, distinct, threshold", [(8, 8, 0.9), (60, 20, 0.3), (40, 40, 0.0)])
def test_leader_clusters(spark, n, distinct, threshold):
    """As one greedy loop: a chain of alike vectors, shared vectors, one large component."""
    rng = np.random.default_rng(n)
    chain = np.array([[np.cos(0.3 * i), np.sin(0.3 * i)] for i in range(8)])
    v = chain if n == 8 else rng.standard_normal((distinct, 3))
    of = rng.integers(0, distinct, n) if n > distinct else np.arange(n)
    rows = [(float(rng.integers(0, 4)) / 4, float(rng.integers(0, 3)), f"r{i:02}", int(rng.integers(-1, 2))) for i in range(n)]
    frame = spark.createDataFrame([(*r, int(of[i]), v[of[i]].tolist(), "t") for i, r in enumerate(rows)], "importance double, created_at double, id string, polarity int, vec_id long, x array<double>, type string")
    got = {tuple(r) for r in conflicts.leader_clusters(frame, threshold).select("id", "leader", "n", "pos").collect()}
    assert got == greedy(rows, v[of], threshold, 2)


def test_leader_clusters_of_a_large_component(spark):
    """Ten thousand rows of two vectors are one component, and one cluster a polarity."""
    rows = spark.range(10_000).select(F.lit(0.5).alias("importance"), F.col("id").cast("double").alias("created_at"), F.lpad(F.col("id").cast("string"), 5, "0").alias("id"), (F.col("id") % 3 - 1).cast("int").alias("polarity"), (F.col("id") % 2).alias("vec_id"), F.lit("t").alias("type"))
    rows = rows.withColumn("x", F.array(F.lit(1.0), F.col("vec_id") * 0.1))
    got = conflicts.leader_clusters(rows).groupBy("leader").agg(F.count("*").alias("n"), F.min("n").alias("said"), F.max("pos").alias("last"), F.countDistinct("pos").alias("places")).orderBy("leader").collect()
    assert [tuple(r) for r in got] == [("00000", 6667, 6667, 6666, 6667), ("00002", 3333, 3333, 3332, 3333)]


def test_leader_clusters_of_rows_that_wait_for_each_other(spark, monkeypatch):
    """Forty vectors, each alike to the next, which stands behind it: few tables all the same."""
    v = np.array([[np.cos(0.07 * i), np.sin(0.07 * i)] for i in range(40)])
    rows = [(0.5, float(i), f"r{i:02}", i % 3 - 1) for i in range(40)]
    frame = spark.createDataFrame([(*r, i, v[i].tolist(), "t") for i, r in enumerate(rows)], "importance double, created_at double, id string, polarity int, vec_id long, x array<double>, type string")
    kept, keep = [], conflicts.Scratch.keep
    monkeypatch.setattr(conflicts.Scratch, "keep", lambda self, df: kept.append(1) or keep(self, df))
    got = {tuple(r) for r in conflicts.leader_clusters(frame, 0.997).select("id", "leader", "n", "pos").collect()}
    assert got == greedy(rows, v, 0.997, 2)
    assert len(kept) < 30


def test_leader_clusters_in_several_stretches(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((50, 3))
    of = rng.integers(0, 50, 120)
    rows = [(float(rng.integers(0, 4)) / 4, float(rng.integers(0, 3)), f"r{i:03}", int(rng.integers(-1, 2))) for i in range(120)]
    frame = spark.createDataFrame([(*r, int(of[i]), v[of[i]].tolist(), "t") for i, r in enumerate(rows)], "importance double, created_at double, id string, polarity int, vec_id long, x array<double>, type string")
    got = {tuple(r) for r in conflicts.leader_clusters(frame, 0.7, links_at_once=100).select("id", "leader", "n", "pos").collect()}
    assert got == greedy(rows, v[of], 0.7, 2)


def test_leader_clusters_write_few_links(spark, monkeypatch):
    """Of very many alike vectors, only the links of those that lead are looked for and kept;
    rows of a vector that is zero are alike to nothing."""
    rng = np.random.default_rng(5)
    v = np.vstack([np.array([1.0, 0.0, 0.0]) + 0.3 * rng.standard_normal((158, 3)), np.zeros((2, 3))])
    rows = [(float(rng.integers(0, 4)) / 4, float(i % 7), f"r{i:03}", int(rng.integers(-1, 2))) for i in range(160)]
    frame = spark.createDataFrame([(*r, i, "t") for i, r in enumerate(rows)], "importance double, created_at double, id string, polarity int, vec_id long, type string")
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, x array<double>")
    monkeypatch.setattr(conflicts, "NODES_AT_ONCE", 4, raising=False)
    kept, keep = [], conflicts.Scratch.keep
    monkeypatch.setattr(conflicts.Scratch, "keep", lambda self, df: kept.append(keep(self, df)) or kept[-1])
    monkeypatch.setattr(conflicts.Scratch, "drop", lambda self, *frames: None)
    got = {tuple(r) for r in conflicts.leader_clusters(frame.join(vectors, "vec_id"), 0.8, links_at_once=600).select("id", "leader", "n", "pos").collect()}
    assert max(df.count() for df in kept) < 2500  # of 17,168 links
    with np.errstate(invalid="ignore"):
        assert got == greedy(rows, v, 0.8, 2)
    apart = {tuple(r) for r in conflicts.leader_clusters(frame, 0.8, vectors=vectors).select("id", "leader", "n", "pos").collect()}
    assert apart == got


def some_vectors(seed, n, dim, spots, spread):
    """Clustered unit-free vectors with repeats, and two that are zero."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((spots, dim))[rng.integers(0, spots, n)] + spread * rng.standard_normal((n, dim))
    x *= rng.uniform(0.1, 9, (n, 1))
    x[3], x[n - 1], x[n - 2] = x[5], 0, 0
    return x


def cosines(x, y):
    norm = lambda m: np.sqrt((m * m).sum(axis=1))
    scale = norm(x)[:, None] * norm(y)[None, :]
    dots = np.array([[(a * b).sum() for b in y] for a in x])
    return np.divide(dots, scale, out=np.zeros_like(scale), where=scale > 0)


@pytest.mark.parametrize("threshold, spread, cell, block", [(0.8, 0.1, 20, 2048), (0.9, 0.3, 10, 7), (0.3, 1.0, 25, 30), (-0.2, 0.5, 20, 64)])
def test_similar_vectors_in_cells(spark, threshold, spread, cell, block):
    """As all pairs: clustered or not, cells cut into blocks or not, an obtuse threshold."""
    from mnemora.operators import metric

    n = 160
    x = some_vectors(cell, n, 5, 12, spread)
    kinds = ["ab"[i % 3 == 0] for i in range(n)]
    frame = spark.createDataFrame([(kinds[i], i, x[i].tolist()) for i in range(n)], "type string, vec_id long, x array<double>").repartition(3)
    got = {(r.type, r.p, r.q): r.similarity for r in metric.similar(frame, threshold, cell, 64, block).collect()}
    cos = cosines(x, x)
    want = {(kinds[i], i, j): cos[i, j] for i in range(n) for j in range(i, n) if kinds[i] == kinds[j] and cos[i, j] >= threshold}
    assert got.keys() == want.keys() and metric.similar(frame, threshold, cell, 64, block).count() == len(want)
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    if threshold == 0.8:
        found = metric.cells_of(frame, cell, 64)
        visits = metric._visits(metric._unit(x)[0], found, 0.1)[1]
        assert len(found) > 4 and sum(map(len, visits)) < n * (len(found) - 1) / 2 / 2  # most cells are passed over
    assert metric.similar(frame.where("false"), 0.5).count() == 0


@pytest.mark.parametrize("spread, at_once", [(0.05, 100), (1.0, 7)])
def test_nearest_by_index(spark, tmp_path, spread, at_once):
    """As a scan of all vectors; of clustered ones most are never read."""
    from mnemora.operators import metric

    n, k = 400, 6
    x, q = some_vectors(1, n, 6, 20, spread), some_vectors(1, 30, 6, 20, spread)[:-1]
    odd = [(1000, None), (1001, [1.0]), (1002, [None] * 6)]
    frame = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)] + odd, "vec_id long, x array<double>").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", q[i].tolist()) for i in range(len(q))], "qid string, qx array<double>")
    index = metric.build_index(frame, f"{tmp_path}/index", 20)
    hits, report = metric.nearest(spark, index, queries, k, at_once)
    got = {(r.qid, r.rank): (r.vec_id, r.cosine) for r in hits.collect()}
    cos = cosines(q, x)
    for i in range(len(q)):
        order = sorted(range(n), key=lambda j: (-cos[i, j], j))[:k]
        assert [got[f"q{i}", r + 1][0] for r in range(k)] == order
        assert all(abs(got[f"q{i}", r + 1][1] - cos[i, j]) < 1e-12 for r, j in enumerate(order))
    assert len(got) == k * len(q) and report["queries"] == len(q) and report["vectors_of_scan"] == n * len(q)
    if spread < 0.1:
        assert report["vectors_read"] < report["vectors_of_scan"] / 2
    assert metric.nearest(spark, index, queries.where("false"), k)[0].count() == 0
    assert metric.nearest(spark, metric.build_index(frame.where("false"), f"{tmp_path}/none"), queries, k)[0].count() == 0
    assert metric.nearest(spark, index, queries, 1000)[0].count() == n * len(q)


@pytest.mark.parametrize("spread, cell, block", [(0.05, 20, 2048), (1.0, 30, 9)])
def test_nearest_join(spark, spread, cell, block):
    """As a scan, ties included, with as many queries as vectors, zeros on both sides."""
    from mnemora.operators import metric

    n, k = 200, 5
    x = some_vectors(2, n, 6, 15, spread)
    x[10] = x[11] = x[12] = x[13] = x[14] = x[15]
    odd = [(1000, None), (1001, [1.0]), (1002, [None] * 6)]
    frame = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)] + odd, "vec_id long, x array<double>").repartition(3)
    queries = frame.where(F.col("vec_id") < n).select(F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("qid"), F.col("x").alias("qx"))
    got = {}
    for r in metric.nearest_join(frame, queries, k, cell, 64, block).collect():
        got.setdefault(int(r.qid[1:]), []).append((r.vec_id, r.cosine))
    cos = cosines(x, x)
    for i in range(n):
        last = sorted(cos[i], reverse=True)[k - 1]
        want = {j for j in range(n) if cos[i, j] >= last}
        assert {j for j, _ in got[i]} == want and len(got[i]) == len(want)
        assert all(abs(c - cos[i, j]) < 1e-12 for j, c in got[i])
    assert metric.nearest_join(frame, queries.where("false"), k).count() == 0 == metric.nearest_join(frame.where("false"), queries, k).count()


def test_nearest_join_above_a_bound_with_ties(spark, monkeypatch):
    """As a scan; of very many equal vectors each query has n, the first by name, and what is
    written down doesn't grow with how many blocks meet."""
    from mnemora.operators import metric

    n, k, least = 300, 4, 0.6
    x = some_vectors(7, n, 6, 15, 0.3).astype(np.float32).astype(float)
    x[40:240:2] = x[40]
    name = [f"r{(i * 7) % n:03}" for i in range(n)]
    frame = spark.createDataFrame([(i, x[i].tolist(), name[i]) for i in range(n)], "vec_id long, x array<double>, name string").repartition(3)
    queries = frame.select(F.col("vec_id").alias("qid"), F.col("x").alias("qx"))
    cos = cosines(x, x)
    want = {i: sorted((j for j in range(n) if cos[i, j] >= least), key=lambda j: (-cos[i, j], name[j]))[:k] for i in range(n)}
    for cell, block in ((20, 2048), (300, 10)):
        kept, got = [], {}
        with monkeypatch.context() as m:
            keep = metric.Scratch.keep
            m.setattr(metric.Scratch, "keep", lambda self, df: kept.append(keep(self, df)) or kept[-1])
            for r in metric.nearest_join(frame, queries, k, cell, 64, block, least, "name").collect():
                got.setdefault(r.qid, []).append((-r.cosine, name[r.vec_id], r.vec_id))
        assert {i: [v[-1] for v in sorted(got.get(i, []))] for i in range(n)} == want
        blocks = [df for df in kept if "ids" in df.columns]
        assert [df.select(F.sum(F.size("ids"))).first()[0] for df in blocks] == [n, n]  # each vector once


def test_blocks_hold_what_floats_hold(spark):
    """A block is half as large where single precision loses nothing, and whole where it would."""
    from mnemora.operators import metric

    x = np.array([[0.5, 0.25], [1.0, np.float32(0.1)]])
    assert metric._pack(x)[1] is False and len(metric._pack(x)[0]) == 16
    assert all(metric._pack(v)[1] for v in (x + 1e-12, x * 1e300, np.array([[np.nan, 1.0]])))


def test_conflict_classes(spark):
    """A vector that many rows share costs a few rows, and expands to the same pairs."""
    rows = spark.range(300).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("id"), F.lit("t").alias("type"), (F.col("id") % 150 == 7).cast("long").alias("vec_id"),
                                   F.when(F.col("id") % 4 == 0, "never use it").otherwise("use it").alias("text"), F.array(F.lit("a")).alias("tags"), (F.col("id") % 2).cast("int").alias("polarity"))
    rows = rows.withColumn("x", F.array(F.lit(1.0), F.col("vec_id") * 0.2))
    pairs, members = conflicts.conflict_classes(rows)
    assert members.count() == 300 and pairs.count() < 15
    assert pairs.agg(F.sum("n")).first()[0] == 300 * 299 / 2 == conflicts.conflicts(rows).count()
    assert {r.kind: r.n for r in pairs.groupBy("kind").agg(F.sum("n").alias("n")).collect()} == {r.kind: r.n for r in conflicts.conflicts(rows).groupBy("kind").agg(F.count("*").alias("n")).collect()}


def test_a_rule_that_says_what_it_reads(spark):
    """The same clashes as by whole texts, which then meet no other row; nulls stay rows."""
    texts = ["use it", "use it " * 9, "never use it", None, ""]
    rows = spark.createDataFrame([(f"r{i:02}", "t", i % 3, texts[i % 5], ["a"], 0, [1.0, 0.1 * (i % 3)]) for i in range(30)], "id string, type string, vec_id long, text string, tags array<string>, polarity int, x array<double>")
    by_text = conflicts.conflicts(rows.na.fill("", ["text"]), contradicts=lambda a, b: F.abs(F.length(a("text")) - F.length(b("text"))) > 20)
    reads = {"length": F.length(F.coalesce("text", F.lit("")))}
    pairs, members = conflicts.conflict_classes(rows.na.fill("", ["text"]), contradicts=lambda a, b: F.abs(a("length") - b("length")) > 20, reads=reads)
    got = conflicts.conflicts(rows.na.fill("", ["text"]), contradicts=lambda a, b: F.abs(a("length") - b("length")) > 20, reads=reads)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, by_text.collect())) and {r.kind for r in got.collect()} == {"negation", "custom", "duplicate"}
    assert members.count() == 30 and members.select("class").distinct().count() == 12  # of one length, two texts are a class
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan
    null = conflicts.conflicts(rows, contradicts=lambda a, b: F.abs(a("length") - b("length")) > 20, reads={"length": F.length("text")})
    assert null.count() == got.count()
    vectors = rows.select("vec_id", "x").distinct()
    apart = conflicts.conflicts(rows.drop("x").na.fill("", ["text"]), contradicts=lambda a, b: F.abs(a("length") - b("length")) > 20, reads=reads, vectors=vectors)
    assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, got.collect()))


def test_pack_skips_and_goes_on(spark):
    hits = spark.createDataFrame([(1, "a", 1, 5), (1, "b", 2, 9), (1, "c", 3, 4)], "qid long, id string, rank int, cost int")
    assert [r.id for r in recall.pack(hits, 10).where("fits").orderBy("rank").collect()] == ["a", "c"]


def test_latencies_of_the_last_samples(spark):
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(50)] + [("b", 1, 7.0)], "op string, seq long, ms double")
    got = {r.op: tuple(r)[1:] for r in log.latencies(rows, "op", "ms", "seq", samples=11).collect()}
    assert got["a"] == (50, 24.5, 49.0, 44.0, 49.0, 49.0) and got["b"] == (1, 7.0, 7.0, 7.0, 7.0, 7.0)


def test_undo(spark):
    kind = "id string, text string, superseded_by string, access_count long"
    rows = spark.createDataFrame([("a", "new", "", 9), ("b", "other", "", 0), ("c", "c", "b", 0)], kind)
    e = links(spark, [("a", "b", "refines"), ("a", "c", "related")])
    snap = "struct<id:string,text:string,superseded_by:string,access_count:bigint>"
    entries = spark.createDataFrame(
        [
            (1, "edit", "a", ("a", "old", "", 1), ("a", "new", "", 1), None, None, None),
            (2, "edit", "b", ("b", "old", "", 0), ("b", "changed since", "", 0), None, None, None),
            (3, "forget", "d", ("d", "back", "", 2), None, None, None, None),
            (4, "supersede", "c", None, None, None, None, None),
            (5, "link", "a", None, None, "b", ["refines"], None),
            (6, "unlink", "b", None, None, "c", ["related", "refines"], None),
            (7, "unlink", "b", None, None, "gone", ["related"], None),
            (8, "export", "a", None, None, None, None, None),
        ],
        f"seq long, op string, id string, before {snap}, after {snap}, dst_id string, rels array<string>, superseder_id string",
    )
    left, edges, verdicts = log.undo(entries, rows, e, 1.0)
    assert {r.seq for r in verdicts.collect() if r.undone} == {1, 3, 4, 5, 6}
    assert sorted(map(tuple, left.collect())) == [("a", "old", "", 1), ("b", "other", "", 0), ("c", "c", "", 0), ("d", "back", "", 2)]
    assert sorted(map(tuple, edges.collect())) == [("a", "c", "related"), ("b", "c", "refines"), ("b", "c", "related")]


def test_undo_chains(spark):
    """Any number of entries a row, newest first, as one undo after another; nulls, both
    zeros, columns that reading changes, ops and ids that are never undone."""
    rng = random.Random(8)
    kind = "id string, text string, trust double, access_count long"
    row = lambda i: (i, rng.choice(["a", "b", None]), rng.choice([0.0, -0.0, 1.0]), rng.randrange(9))
    same = lambda a, b: a is not None and a[:3] == b[:3]
    ids = [f"r{i}" for i in range(30)]
    now = {i: row(i) for i in ids if rng.random() < 0.7}
    entries = []
    for seq in rng.sample(range(10**6), 900):
        i = "r0" if rng.random() < 0.3 else rng.choice([*ids, "new", None])
        op = rng.choices(["remember", "edit", "forget", "link"], [1, 12, 3, 1])[0]
        entries.append((seq, op, i, row(i) if rng.random() < 0.9 else None, row(i) if rng.random() < 0.9 else None))
    state, undone = dict(now), set()
    for seq, op, i, before, after in sorted(entries, reverse=True):
        live = state.get(i)
        if i is None:
            continue
        if op == "remember" and live:
            del state[i]
        elif (op == "forget" and before and not live) or (op == "edit" and before and after and same(live, after)):
            state[i] = before
        else:
            continue
        undone.add(seq)
    snap = "struct<id:string,text:string,trust:double,access_count:bigint>"
    log_ = spark.createDataFrame(entries, f"seq long, op string, id string, before {snap}, after {snap}")
    rows = spark.createDataFrame(list(now.values()), kind)
    left, verdicts = log.undo_chains(log_, rows)
    got = verdicts.collect()
    assert len(got) == len(entries) and {r.seq for r in got if r.undone} == undone and len(undone) > 60
    assert sorted(map(repr, map(tuple, left.collect()))) == sorted(map(repr, state.values()))
    left, verdicts = log.undo_chains(log_.where("false"), rows)
    assert verdicts.count() == 0 and left.count() == len(now)


def test_replay_knows_undo(spark):
    rows = [(1, 1.0, "remember", "a", "one", None), (2, 2.0, "remember", "b", "two", None), (3, 3.0, "undo", "a", None, "remember"), (4, 4.0, "edit", "b", "three", None), (5, 5.0, "undo", "b", "two", "edit"), (6, 6.0, "undo", "b", None, "link")]
    j = spark.createDataFrame(rows, "seq long, us double, op string, id string, text string, of_op string").withColumn("dst_id", F.lit("x")).withColumn("rel", F.lit("related"))
    assert [(r.id, r.text) for r in log.state_at(j, 9.0).collect()] == [("b", "two")]


def test_chunks(spark):
    go = lambda text, *a: one(spark, text, S.chunks(F.col("text"), *a))
    assert go("# Head\n\n## Sub\n\nOne paragraph of some length here.\r\n\r\n  Another paragraph, also long enough. ") == ["# Head\n## Sub\nOne paragraph of some length here.", "Another paragraph, also long enough."]
    assert go("tiny\n\n-\n\n# Only a heading that nothing follows at all") == ["# Only a heading that nothing follows at all"]
    assert go("One two. Three four. Five. " + "x" * 30 + ". Six.", 20, 6) == ["One two. Three four. Five.", "x" * 30 + ". Six."]
    assert go("Hi. " + "y" * 25 + ". Bye now, all.", 20, 6) == ["Hi. " + "y" * 25 + ".", "Bye now, all."]
    assert go("a b c", 500, 0) == ["a b c"] and go("", 10, 0) == [] and go("z" * 100, 20, 5) == ["z" * 100]


def test_times_and_display(spark):
    now = 1_700_000_000.0
    at = lambda t: one(spark, t, S.parse_timestamp(F.col("text"), now))
    assert at("7d") == now - 7 * 86400 and at(" 12.5 ") == 12.5 and at(None) is None and at(" ") is None
    assert at("2024-01-01") == 1704067200.0 and at("2024-01-01T01:00:00Z") == 1704070800.0 and at("2024-01-01 01:00:00+01:00") == 1704067200.0
    with pytest.raises(Exception, match="invalid timestamp"):
        at("next week")
    spans = [one(spark, "x", S.format_duration(F.lit(n))) for n in (45, 60, 125, 7200, 7380, 90_000, 172_800)]
    assert spans == ["45s", "1m", "2m 5s", "2h", "2h 3m", "1d 1h", "2d"]
    ages = [one(spark, "x", S.age(F.lit(now - s), now)) for s in (5, 90, 7200, 200_000, 700_000, 6_000_000)]
    assert ages == ["just now", "1m ago", "2h ago", "2d ago", "1w ago", "2mo ago"]
    assert one(spark, " a \n b " + "c" * 80, S.snippet(F.col("text"), 10)) == "a b ccccc…"
    assert one(spark, '[{"to": "a", "rel": "related"}]', F.size(S.links_of(F.col("text")))) == 1 and one(spark, "[{", F.size(S.links_of(F.col("text")))) == 0
    with pytest.raises(ValueError):
        S.check_choice("fts", ["pool", "corpus"], "index")
    with pytest.raises(ValueError):
        S.check_tag("a,b")


def test_many_moments_equal_single_replays(spark):
    """Nukes, undos, links in snapshots, unlinks of all rels, ties of time and times that
    run backwards: every (id, moment) as a replay of its own."""
    rng = random.Random(4)
    rows, us = [], 100.0
    for seq in range(600):
        us += rng.choice((0, 0, 1, 5, -4))
        op = rng.choices(["remember", "edit", "link", "unlink", "forget", "undo", "nuke"], [4, 4, 9, 5, 1, 1, 0.1])[0]
        text = f"t{seq}" if op in ("remember", "edit") or (op == "undo" and rng.random() < 0.5) else None
        held = [(rng.choice("xyz"), rng.choice(("related", "refines"))) for _ in range(rng.randrange(3))] if text and rng.random() < 0.4 else None
        rel = rng.choice(("related", "refines", None)) if op == "unlink" else rng.choice(("related", "refines"))
        rels = ["refines"] if op == "unlink" and rel is None and rng.random() < 0.3 else None
        rows.append((seq, us, op, rng.choice("abcd") if op != "nuke" else None, rng.choice("xyz"), rel, text, held, rels, rng.choice(("remember", "edit"))))
    j = spark.createDataFrame(rows, "seq long, us double, op string, id string, dst_id string, rel string, text string, links array<struct<dst_id:string,rel:string>>, rels array<string>, of_op string").cache()
    moments = sorted({r[1] for r in rows} | {0.0, 1e6, 150.5})[::12]
    asked = spark.createDataFrame([(i, m) for i in "abcdq" for m in moments] * 2, "id string, us double")
    plain = lambda r: (r.text, r.base, r.links, [tuple(x) for x in r.link_list or []])
    for bits in (3, 16):
        got = {(r.id, r.us): plain(r) for r in log.states_at(j, asked, bits).collect()}
        want = {(r.id, m): plain(r) for m in moments for r in log.state_at(j, m).collect()} if bits == 3 else want
        assert got == want and len(want) > 30
    none = j.where("false")
    assert log.states_at(none, asked).count() == 0 and log.states_at(j, asked.where("false")).count() == 0


def test_replay_of_links_in_snapshots(spark):
    held = "array<struct<dst_id:string,rel:string>>"
    rows = [(1, 1.0, "remember", "a", None, None, "one", None), (2, 2.0, "link", "a", "b", "refines", None, None), (3, 3.0, "edit", "a", None, None, "two", [("b", "refines"), ("c", "related")]),
            (4, 4.0, "link", "a", "b", "related", None, None), (5, 5.0, "unlink", "a", "b", None, None, None), (6, 6.0, "edit", "a", None, None, "three", None)]
    j = spark.createDataFrame(rows, f"seq long, us double, op string, id string, dst_id string, rel string, text string, links {held}")
    at = lambda t: [tuple(x) for x in log.state_at(j, t).first().link_list or []]
    assert at(2.0) == [("b", "refines")] and at(3.0) == [("b", "refines"), ("c", "related")]
    assert at(4.0) == [("b", "refines"), ("b", "related"), ("c", "related")] and at(5.0) == [("c", "related")] and at(6.0) == []


def test_many_nukes_end_what_was_before_them(spark):
    """Each row looks through the nukes of its cell, not through all of them; from the end."""
    entries = [(i, float((i * 7919) % 1000 if i % 5 else i), "nuke" if i % 9 == 4 else "remember", f"u{i % 4}", None, None, f"t{i}") for i in range(200)]
    j = spark.createDataFrame(entries, "seq long, us double, op string, id string, dst_id string, rel string, text string")
    rows, _ = log.lives(j)
    want = set()
    for seq, us, op, id_, _, _, text in entries:
        ends = [e[1] for e in entries if e[0] > seq and (e[2] == "nuke" or e[3] == id_ and e[2] == "remember")]
        if op == "remember" and (not ends or us < min(ends)):
            want.add((id_, text, seq, us, min(ends, default=None)))
    assert {tuple(r) for r in rows.collect()} == want
    plan = rows._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "unboundedfollowing" not in plan.lower()


def test_paths_through_a_hub_cost_no_more_than_their_pairs(spark, monkeypatch):
    """Two hundred rows on one hub, of which pairs ask each other and rows beside it."""
    monkeypatch.setattr(graph, "HUB", 10)
    spokes = [f"s{i:03}" for i in range(200)]
    edges = spark.createDataFrame([(s, "hub", "related") for s in spokes] + [(f"x{i:03}", f"s{i:03}", "refines") for i in range(0, 200, 2)], "src string, dst string, rel string")
    known = spark.createDataFrame([(i,) for i in [*spokes, *(f"x{i:03}" for i in range(200))]], "id string")
    pairs = [(s, f"s{(i + 1) % 200:03}") for i, s in enumerate(spokes)] + [(s, f"x{(i + 2) % 200:03}") for i, s in enumerate(spokes)]
    kept, keep = [], graph.Scratch.keep
    monkeypatch.setattr(graph.Scratch, "keep", lambda self, df: kept.append(keep(self, df)) or kept[-1])
    got = {(r.start, r.end): [(x.id, x.rel) for x in r.path] for r in graph.find_paths(spark.createDataFrame(pairs, "start string, end string"), edges, known, 3).collect()}
    want = {(a, b): [(a, ""), ("hub", "related"), (b, "related")] for a, b in pairs if b[0] == "s"}
    want |= {(a, b): [(a, ""), ("hub", "related"), (f"s{b[1:]}", "related"), (b, "refines")] for a, b in pairs if b[0] == "x" and int(b[1:]) % 2 == 0}
    assert got == want
    assert max(df.count() for df in kept) < 1000


def test_undo_compares_long_texts_and_writes_no_whole_rows(spark):
    """Texts that differ late or are digests of each other's kind, missing sides, and types
    that aren't the rows' own; what is written down for verdicts holds no rows."""
    import hashlib

    from mnemora.operators import log

    long = "x" * 500
    rows = [("a", long, 1.5, ""), ("b", long + "b", -0.0, ""), ("c", "#" + hashlib.sha256(long.encode()).hexdigest(), 1.0, ""), ("d", None, None, "")]
    frame = spark.createDataFrame(rows, "id string, text string, `im.p` double, superseded_by string")
    snap = "struct<id:string,text:string,`im.p`:float,superseded_by:string>"
    after = [("a", long, 1.5, ""), ("b", long + "c", 0.0, ""), ("c", long, 1.0, ""), ("d", None, None, "")]
    entries = [(i, "edit", r[0], (r[0], "was", 9.0, ""), r, None, None, None) for i, r in enumerate(after)] + [(9, "edit", "a2", None, None, None, None, None), (8, "forget", "z", ("z", "back", 1.0, "a"), None, None, None, None)]
    entries = spark.createDataFrame(entries, f"seq long, op string, id string, before {snap}, after {snap}, dst_id string, rels array<string>, superseder_id string")
    left, _, verdicts = log.undo(entries, frame, spark.createDataFrame([], "src string, dst string, rel string"), 1.0)
    assert {r.seq for r in verdicts.collect() if r.undone} == {0, 3, 8}
    assert {tuple(r) for r in left.collect()} == {("a", "was", 9.0, ""), rows[1], rows[2], ("d", "was", 9.0, ""), ("z", "back", 1.0, "a")}
    assert "before" not in spark.read.parquet(verdicts.inputFiles()[0]).columns


def test_jaccard_cuts_each_text_into_words_once(spark):
    import __spark_entry__ as e
    from mnemora.functions import scalars as S

    sets = spark.createDataFrame([(1, ["a", "b", "a"], ["b", "c"]), (2, [], []), (3, None, ["a"]), (4, [None, "a"], [None]), (5, ["a"], ["a", "a"])], "k int, a array<string>, b array<string>")
    assert [r.j for r in sets.orderBy("k").select(S.jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == [1 / 3, 0.0, 0.0, 0.5, 1.0]
    plan = e.queries()["fn_jaccard"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and all("regexp_extract_all" not in line for line in plan[: plan.index("Join")].splitlines())

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora.operators import lifecycle as Y
from mnemora.operators import recall as R

NOW = 1_700_000_000.0


def vectors(spark, xs):
    return spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "vec_id long, x array<double>")


def rows_of(spark, vec_ids):
    return spark.createDataFrame([(f"r{i:03}", v) for i, v in enumerate(vec_ids)], "id string, vec_id long")


def test_pool_is_exact_with_shared_vectors_and_ties(spark, monkeypatch):
    """Rows that share a vector tie; queries go in slices; both ways give the same pool."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 5)).round(1)
    x[7] = 0
    of = rng.integers(0, 60, 150)
    q = rng.standard_normal((9, 5))
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, qx array<double>")
    norm = np.linalg.norm(x, axis=1)
    cos = np.divide(q @ x.T, np.linalg.norm(q, axis=1)[:, None] * norm, out=np.zeros((9, 60)), where=norm > 0)
    want = {(i, p + 1, f"r{r:03}") for i in range(9) for p, r in enumerate(sorted(range(150), key=lambda r: (-round(cos[i, of[r]], 12), r))[:12])}
    for most in (10_000, 2):
        monkeypatch.setattr(R, "QUERIES_AT_ONCE", most)
        got = R.vector_pool(rows_of(spark, of.tolist()), vectors(spark, x.tolist()).repartition(3), queries, 12).collect()
        assert {(r.qid, r.pool_pos, r.id) for r in got} == want


def test_pool_passes_over_odd_vectors(spark):
    xs = [[1.0, 0.0], None, [1.0, None], [1.0, 2.0, 3.0], [0.0, 1.0]]
    q = spark.createDataFrame([("a", [1.0, 0.0])], "qid string, qx array<double>")
    got = R.vector_pool(rows_of(spark, [0, 1, 2, 3, 4, 9]), vectors(spark, xs), q, 10).collect()
    assert [(r.qid, r.id, r.cosine) for r in sorted(got)] == [("a", "r000", 1.0), ("a", "r004", 0.0)]
    assert R.vector_pool(rows_of(spark, [0]), vectors(spark, xs), q.where("false"), 3).count() == 0
    two = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "qid string, qx array<double>")
    with pytest.raises(ValueError):
        R.vector_pool(rows_of(spark, [0]), vectors(spark, xs), two, 3)


def memory(spark, rows):
    """(id, text, superseded_by, links...) as memories that are alike in all else."""
    full = [(i, t, s, ["x"], 0.5, 0, NOW, 0.0, "trusted", 0.0, 0.0, False, "semantic") for i, t, s in rows]
    return spark.createDataFrame(
        full,
        "id string, text string, superseded_by string, tags array<string>, importance double, polarity int, created_at double, expires_at double, "
        "trust string, valid_from double, valid_until double, pinned boolean, type string",
    )


def test_weights_are_shared_by_the_whole_pools_matches(spark):
    """A match of a superseded row counts: the other rows' weights stay as they are."""
    q = spark.createDataFrame([(1, "kubernetes")], "qid long, qtext string")
    pool = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.4, 2)], "qid long, id string, cosine double, pool_pos int")
    w = R.Weights()
    for text, scale in (("kubernetes rocks", 1.0), ("nothing of it", 1 / 0.8)):
        m = memory(spark, [("a", text, "b"), ("b", "plain words", "")])
        rows = R.signals(pool, m, q, NOW, w).where("superseded_by = ''")
        (r,) = R.weighted(rows, w).collect()
        assert r.score == pytest.approx(scale * (0.55 * 0.4 + 0.15 + 0.05))
    with pytest.raises(ValueError):
        R.Weights(cosine=0, lexical=0, recency=0, importance=0)


def test_rrf_skips_weightless_signals_and_idle_graphs(spark):
    rows = spark.createDataFrame([(1, "a", 0.9, 0.0, 1.0, 0.5, 1, 1), (1, "b", 0.8, 1.0, 0.5, 0.9, 0, 2)], "qid long, id string, cosine double, lex double, rec double, importance double, polarity int, pool_pos int")
    none = spark.createDataFrame([], "src string, dst string, rel string")
    got = {r.id: r.score for r in R.reciprocal_ranks(rows, R.Weights(lexical=0, graph=0.5), none).collect()}
    assert got["a"] == pytest.approx(0.55 / 60 + 0.15 / 60 + 0.10 / 61 + 0.05 / 61)
    assert got["b"] == pytest.approx(0.55 / 61 + 0.15 / 61 + 0.10 / 60)


def test_probes_in_slices(spark, monkeypatch):
    m = memory(spark, [(f"m{i}", f"word{i % 5} here", "") for i in range(10)])
    words = spark.createDataFrame([(f"word{i}",) for i in range(5)] + [("nowhere",)], "w string")
    whole = sorted(map(tuple, R.containing(m, words).collect()))
    monkeypatch.setattr(R, "WORDS_AT_ONCE", 2)
    assert sorted(map(tuple, R.containing(m, words).collect())) == whole and len(whole) == 10
    assert R.containing(m, words.where("false")).count() == 0


def test_expansion_walks_breadth_first(spark):
    m = memory(spark, [(x, "t", "z" if x == "g" else "") for x in "abcdefghz"])
    e = spark.createDataFrame(
        [("a", "d", "refines"), ("b", "c", "refines"), ("b", "a", "refines"), ("c", "e", "example_of"), ("d", "f", "refines"), ("d", "h", "related"), ("f", "g", "refines"), ("a", "missing", "refines")],
        "src string, dst string, rel string",
    )
    found = spark.createDataFrame([(1, "b", 1), (1, "a", 2)], "qid long, id string, rank int")
    go = lambda **k: [(r.id, r.hop, r.score) for r in R.expand(found, e, m, F.lit(True), R.Expand(**k)).orderBy("n").collect()]
    assert go() == [("c", 1, 0.7), ("d", 1, 0.7)]
    assert go(depth=3, decay=0.5) == [("c", 1, 0.7), ("d", 1, 0.7), ("e", 2, 0.35), ("f", 2, 0.35)]
    assert go(depth=3, cap=3, rels=("refines",)) == [("c", 1, 0.7), ("d", 1, 0.7), ("f", 2, 0.7)]
    assert go(depth=0) == [] == go(cap=0)
    refused = R.expand(found, e, m, F.col("id") != "d", R.Expand(depth=3)).collect()
    assert {r.id for r in refused} == {"c", "e"}


def brute_select(score, x, k, lam, dedup):
    left, out = sorted(range(len(score)), key=lambda i: -score[i]), []
    span = max(score) - min(score)
    rel = [1.0 if span <= 1e-12 else (s - min(score)) / span for s in score]
    near = lambda i: max((float(x[i] @ x[j]) for j in out), default=0.0)
    while left and len(out) < k:
        best = max(left, key=lambda i: rel[i] if lam is None else lam * rel[i] - (1 - lam) * near(i))
        left.remove(best)
        if not (dedup is not None and out and near(best) >= dedup):
            out.append(best)
    return out


@pytest.mark.parametrize("lam, dedup", [(0.7, None), (None, 0.6), (0.4, 0.8), (1.0, None)])
def test_diversify(spark, lam, dedup):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((25, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    score = rng.random(25).round(3)
    rows = spark.createDataFrame([("q", f"r{i}", float(score[i]), i, x[i].tolist()) for i in range(25)], "qid string, id string, score double, pool_pos int, x array<double>")
    got = [r.id for r in R.diversify(rows, 8, lam, dedup).orderBy("rank").collect()]
    assert got == [f"r{i}" for i in brute_select(score, x, 8, lam, dedup)]


def test_pack_and_compress(spark):
    """What is too large is passed over; leftovers are summed up where the budget has room."""
    rows = [("q", "a", 1, 6, "alpha beta. More", 0.2), ("q", "b", 2, 9, "gamma delta one. x", 0.5), ("q", "c", 3, 3, "short", 0.1), ("q", "d", 4, 9, "gamma delta two. y", 0.9), ("q", "e", 5, 20, "lonely words", 0.9), ("r", "a", 1, 99, "t", 0.1)]
    hits = spark.createDataFrame(rows, "qid string, id string, rank int, cost long, text string, importance double")
    packed = R.pack(hits, 10)
    assert {(r.qid, r.id, r.used) for r in packed.collect() if r.fits} == {("q", "a", 6), ("q", "c", 9)}
    small = R.pack(hits.where("qid = 'q'"), 10)
    assert R.compress(small, 10).count() == 0
    (got,) = R.compress(small, 40).collect()
    assert got.members == "b,d" and got.text == "- (compressed) [×2 similar] gamma delta two | gamma delta one" and got.tokens == 15


def test_pinned_come_first(spark):
    m = memory(spark, [("a", "t", ""), ("b", "t", ""), ("c", "t", "b"), ("d", "t", "")]).withColumn("pinned", F.col("id").isin("a", "b", "c")).withColumn("created_at", F.when(F.col("id") == "b", 9.0).otherwise(5.0))
    hits = spark.createDataFrame([(1, "d", 0.9, 1), (1, "a", 0.8, 2), (2, "d", 0.4, 1)], "qid long, id string, score double, rank int")
    got = [(r.qid, r.id, r.score, r["rank"]) for r in R.prepend_pinned(hits, m, NOW).orderBy("qid", "rank").collect()]
    assert got == [(1, "b", 0.9, 1), (1, "a", 0.9, 2), (1, "d", 0.9, 3), (2, "b", 0.4, 1), (2, "a", 0.4, 2), (2, "d", 0.4, 3)]


def test_reranker_hook(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "bb", 2), (2, "c", 1)], "qid long, id string, pool_pos int")
    got = {(r.qid, r.id): (r.first_rank, r.new_rank) for r in Y.rescored(rows, lambda pdf: pdf.id.str.len()).collect()}
    assert got == {(1, "a"): (1, 2), (1, "bb"): (2, 1), (2, "c"): (1, 1)}
    with pytest.raises(Exception, match="scores for"):
        Y.rescored(rows, lambda pdf: [1.0] * 9).collect()


def test_trigram_index(spark, tmp_path):
    """As a scan for every probe, short and absent ones, ranges added later, odd texts."""
    import random

    from mnemora.operators import trigrams

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeé北") for _ in range(rng.randrange(1, 7)))
    rows = [(f"m{i:03}", " ".join(word() for _ in range(rng.randrange(12)))) for i in range(300)] + [("n1", None), ("n2", ""), ("n3", "ab"), ("n4", "x" * 5000 + "needle" + "y" * 5000), ("m000", "needle twice"), (None, "needle")]
    frame = spark.createDataFrame(rows, "id string, text string").repartition(3)
    more = [(f"z{i}", f"late needle {word()}") for i in range(20)]
    index = trigrams.build(frame, f"{tmp_path}/grams", 50)
    assert index.ranges == 7
    index = trigrams.build(spark.createDataFrame(more, "id string, text string"), f"{tmp_path}/grams", 50, index.ranges)
    probes = {word() for _ in range(60)} | {"needle", "dle t", "a", "é北", "absent one", "x" * 40, "ab", rows[5][1], rows[7][1][2:9]}
    probes = {p for p in probes if p}
    ask = lambda some: trigrams.containing(index, spark.createDataFrame([(p,) for p in some], "w string"))
    hits, report = ask([*probes, *probes, None, ""])
    want = sorted(((i, w) for i, t in rows + more for w in probes if w in (t or "")), key=repr)
    assert sorted(map(tuple, hits.collect()), key=repr) == want and report["texts_read"] == report["texts_of_scan"] == 326
    hits, report = ask(["needle", "x" * 40, "absent one"])
    assert hits.count() == 24 and report["texts_read"] < 40
    assert trigrams.containing(trigrams.build(frame.where("false"), f"{tmp_path}/none"), spark.createDataFrame([("abc",)], "w string"))[0].count() == 0


def test_trigram_lists_are_made_and_searched_in_parts(spark, tmp_path, monkeypatch):
    """A range's lists in parts of bounded length, a long text a stretch at a time, and texts
    with so many probes that one pass looks for all."""
    import random

    import pyarrow as pa

    from mnemora.operators import trigrams as T

    rng = random.Random(8)
    texts = ["".join(rng.choice("abcé北\0") for _ in range(rng.randrange(3, 40))) for _ in range(60)] + ["abcdé北" * 20]
    brute = sorted((ord(t[i]) << 42 | ord(t[i + 1]) << 21 | ord(t[i + 2]), d) for d, t in enumerate(texts) for i in {t[k : k + 3]: k for k in range(len(t) - 2)}.values())
    monkeypatch.setattr(T, "PART_LETTERS", 100)
    made = list(T._postings([pa.record_batch([pa.array(range(a, b)), pa.array([0] * (b - a)), pa.array(texts[a:b])], names=["doc", "r", "text"]) for a, b in ((0, 30), (30, 61))]))
    rows = [x for b in made for x in b.to_pylist()]
    assert sorted((x["gram"], d) for x in rows for d in x["docs"]) == brute
    parts = {p: {d for x in rows if x["part"] == p for d in x["docs"]} for p in {x["part"] for x in rows}}
    assert len(parts) > 10 and all(min(ds) == p and (len(ds) == 1 or sum(len(texts[d]) for d in ds) <= 100) for p, ds in parts.items())
    monkeypatch.undo()
    long = [(f"m{i:02}", "".join(rng.choice("abc ") for _ in range(3000))) for i in range(40)]
    probes = {t[k : k + n] for _, t in long[:4] for k in range(0, 200, 5) for n in (3, 4, 5, 9)} | {"zzzz", "b"}
    index = T.build(spark.createDataFrame(long, "id string, text string"), f"{tmp_path}/grams", 15)
    lists = T.holding(index, spark.createDataFrame([(p,) for p in probes], "w string"))[0].collect()
    assert sorted((i, x.w) for x in lists for i in x.ids) == sorted((i, w) for i, t in long for w in probes if w in t)


def test_trigram_lists_by_small_numbers(monkeypatch):
    """Grams with small numbers give the lists that whole ones give."""
    import random

    from mnemora.operators import trigrams as T

    rng = random.Random(3)
    for letters in ("ab", "abcdé北\0", "".join(map(chr, range(1, 300)))):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 60))) for _ in range(50)] + ["aaa"]
        made = []
        for table in (T.TABLE, 0):
            monkeypatch.setattr(T, "TABLE", table)
            (lists,) = T._lists(list(range(7, 58)), texts)
            made.append([x.tolist() for x in lists])
            monkeypatch.undo()
        assert made[0] == made[1] and len(made[0][0]) == len({t[i : i + 3] for t in texts for i in range(len(t) - 2)})


def test_trigram_first_rows_in_stretches(spark, tmp_path, monkeypatch):
    """Each probe's first rows by id, whatever the stretches: rare probes with many false
    candidates, repeated ids, several builds, short and absent probes."""
    import random

    from mnemora.operators import trigrams as T

    rng = random.Random(9)
    false = "abcd bcde"  # has both grams of "abcde" but for some rows not the word
    rows = [(f"m{rng.randrange(10**6):06}", f"{false} {'abcde' if i % 97 == 5 else ''} {'th' if i % 3 else ''}") for i in range(300)]
    rows += [("m5", "abcde"), ("m5", "abcde twice"), ("z9", "only here"), ("n0", None)]
    more = [(f"m{rng.randrange(10**6):06}", f"{false} {'abcde' if i % 11 == 5 else ''}") for i in range(60)]
    index = T.build(spark.createDataFrame(rows, "id string, text string").repartition(3), f"{tmp_path}/grams", 40)
    index = T.build(spark.createDataFrame(more, "id string, text string"), f"{tmp_path}/grams", 40, index.ranges)
    probes = ["abcde", "bcd", "only here", "absent", "th", "abcd bcde", "abcde twice"]
    asked = spark.createDataFrame([(p,) for p in [*probes, "bcd", None, ""]], "w string")
    monkeypatch.setattr(T, "STRETCH", 2)
    for limit, many in ((1, 0), (3, 40), (1000, 40)):
        monkeypatch.setattr(T, "MANY", many)  # with 0 one pass finds also what isn't due in a text
        got = {}
        for x in T.first_containing(index, asked, limit).collect():
            got.setdefault(x.w, []).append(x.id)
        for w in probes:
            want = sorted(i for i, t in rows + more if w in (t or ""))
            have = sorted(got.get(w, []))
            assert have[:limit] == want[:limit] and not set(have) - set(want), (w, limit)
        if limit == 1:
            assert len(got["bcd"]) < 20  # not all 360

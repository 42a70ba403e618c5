import pytest
from pyspark.sql import functions as F

from mnemora.operators import archive as A
from mnemora.operators import curation as U
from mnemora.operators import lifecycle as Y
from mnemora.operators import maintenance as M
from mnemora.operators import trash as B
from mnemora.sources.embedders import HashEmbedder, HttpEmbedder, embedded, probe

NOW = 1_700_000_000.0


def items(spark, rows, more=""):
    return spark.createDataFrame(rows, "pos long, text string" + more)


def stored(spark, *texts, **columns):
    built = Y.build(items(spark, list(enumerate(texts))), NOW - 10)
    for name, value in columns.items():
        built = built.withColumn(name, F.lit(value))
    return built.withColumn("id", F.concat(F.lit("s"), F.col("pos").cast("string"))).withColumn("vec_id", F.col("pos")).drop("pos")


def test_bad_items_are_named_and_refused(spark):
    rows = [(1, "a", "semantic", 0, None, None, None, None), (2, "a", "odd", 0, None, None, None, None), (3, "a", "semantic", 2, None, None, None, None), (4, "a", "semantic", 0, 5.0, 1.0, None, None), (5, "a", "semantic", 0, None, -1.0, None, None), (6, "a", "semantic", 0, None, None, 9.0, 5.0)]
    bad = items(spark, rows, ", type string, polarity int, expires_at double, ttl_seconds double, valid_from double, valid_until double")
    got = {r.pos: r.problem for r in Y.problem(bad).collect()}
    assert got == {1: None, 2: "type", 3: "polarity", 4: "both expires_at and ttl_seconds", 5: "ttl_seconds", 6: "validity"}
    with pytest.raises(Exception, match="bad item: type"):
        Y.build(bad.where("pos < 3"), NOW).collect()
    tagged = items(spark, [(1, "a", ["x", " "])], ", tags array<string>")
    assert Y.problem(tagged).first().problem == "tags"
    (r,) = Y.build(items(spark, [(1, "  a b ", 7.0, 60.0)], ", importance double, ttl_seconds double"), NOW).collect()
    assert (r.text, r.importance, r.expires_at, r.trust, r.tags, r.polarity) == ("a b", 1.0, NOW + 60, "trusted", [], 0)
    assert Y.build(items(spark, [(1, "x")]), NOW).first().id == Y.build(items(spark, [(1, "x")]), NOW).first().id


def test_idempotent_batches(spark):
    rows = stored(spark, "Known  fact", "old one").withColumn("superseded_by", F.when(F.col("id") == "s1", "s0").otherwise(""))
    fresh = Y.build(items(spark, [(1, "known fact"), (2, "new"), (3, "NEW"), (4, "old one")]), NOW)
    mapping, added = Y.remember_many(rows, fresh, NOW, idempotent=True)
    got = {r.pos: (r.kept_as, r.touched) for r in mapping.collect()}
    own = {r.pos: r.id for r in fresh.collect()}
    assert got == {1: ("s0", True), 2: (own[2], False), 3: (own[2], False), 4: (own[4], False)}
    assert {r.pos for r in added.collect()} == {2, 4}
    assert Y.remember_many(rows, fresh, NOW)[1].count() == 4


def test_conflict_policies(spark):
    rows = stored(spark, "use ruff", "never use ruff", "far away").withColumn("tags", F.array(F.lit("t")))
    old = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0])], "vec_id long, x array<double>")
    fresh = Y.build(items(spark, [(1, "always use ruff", ["t"]), (2, "other thing", ["t"]), (3, "use ruff now", ["u"])], ", tags array<string>"), NOW).withColumn("vec_id", F.col("pos") + 10)
    new = spark.createDataFrame([(11, [1.0, 0.05]), (12, [-1.0, 0.0]), (13, [1.0, 0.0])], "vec_id long, x array<double>")
    pos = {r.id: r.pos for r in fresh.collect()}
    for policy, left, refused in (("ignore", 6, set()), ("warn", 6, set()), ("raise", 5, {1}), ("supersede", 6, set())):
        after, gone, clashes, links = Y.remember(rows, old, fresh, new, NOW, policy)
        assert after.count() == left and {pos[r.id] for r in gone.collect()} == refused
        kinds = {(pos[r.a], r.b, r.kind) for r in clashes.collect()}
        assert kinds == (set() if policy == "ignore" else {(1, "s0", "duplicate"), (1, "s1", "negation")})
        if policy == "supersede":
            assert {r.id: pos.get(r.superseded_by) for r in after.collect() if r.superseded_by} == {"s0": 1, "s1": 1}
            assert {(pos[r.src], r.dst, r.rel) for r in links.collect()} == {(1, "s0", "supersedes"), (1, "s1", "supersedes")}
    with pytest.raises(ValueError):
        Y.remember(rows, old, fresh, new, NOW, "merge")


def test_built_rows_keep_their_vectors(spark):
    """So that texts needn't meet their vectors' ids again by pos."""
    built = Y.build(items(spark, [(1, "x", 7), (2, "y", 9)], ", vec_id long"), NOW)
    assert {r.pos: r.vec_id for r in built.collect()} == {1: 7, 2: 9}
    assert "vec_id" not in Y.build(items(spark, [(1, "x")]), NOW).columns


def test_consolidation(spark):
    rows = stored(spark, "alpha", "beta", "gamma").withColumn("pinned", F.col("id") == "s1")
    edges = spark.createDataFrame([("s2", "s0", "related")], "src string, dst string, rel string")
    clusters = spark.createDataFrame([("s0", "s0", 0), ("s1", "s0", 1)], "id string, leader string, pos long")
    made = Y.reflections(clusters, rows, consolidate=True)
    (r,) = made.collect()
    assert (r.text, r.tags, r.level, r.pinned) == ("[Reflection ×2] alpha | beta", ["reflection", "level:1"], 1, True)
    assert not Y.reflections(clusters, rows).first().pinned
    for mode, ids in (("keep", {"s0", "s1", "s2", "rs0"}), ("soft", {"s0", "s1", "s2", "rs0"}), ("hard", {"s2", "rs0"})):
        after, links = Y.consolidated(rows.drop("vec_id"), edges, clusters, made, mode, NOW)
        got = {x.id: (x.superseded_by, x.pinned) for x in after.collect()}
        assert set(got) == ids and got["rs0"] == ("", True)
        assert links.count() == (5 if mode == "soft" else 1)
        if mode == "soft":
            assert got["s0"] == ("rs0", False) and got["s1"] == ("rs0", True)


def test_nuke_needs_a_yes(spark):
    rows = stored(spark, "a", "b")
    with pytest.raises(ValueError):
        Y.nuke(rows)
    left, entry = Y.nuke(rows, confirm=True)
    assert left.count() == 0 and entry.first().removed == 2


def test_merge(spark):
    rows = stored(spark, "a", "b", "c", "d").withColumn("trust", F.when(F.col("id") == "s1", "untrusted").otherwise("trusted")).withColumn("pinned", F.col("id") == "s1")
    edges = spark.createDataFrame([("s1", "s2", "refines"), ("s1", "gone", "related"), ("s0", "s1", "related"), ("s3", "s1", "related"), ("s3", "s0", "related"), ("s0", "gone", "related"), ("s1", "s0", "refines")], "src string, dst string, rel string")
    pairs = spark.createDataFrame([("s0", "s1"), ("s2", "s2"), ("s3", "nobody")], "target string, other string")
    after, links = U.merge(rows, edges, pairs)
    got = {r.id: (r.text, r.trust, r.pinned) for r in after.collect()}
    assert got == {"s0": ("a\n\nb", "untrusted", True), "s2": ("c", "trusted", False), "s3": ("d", "trusted", False)}
    assert sorted(map(tuple, links.collect())) == [("s0", "gone", "related"), ("s0", "s2", "refines"), ("s3", "s0", "related")]


def test_merges_that_share_rows(spark):
    """A tree of merges and a long chain, as merging one by one, the innermost first."""
    import random

    rng = random.Random(5)
    n = 60
    names = [f"s{i:02}" for i in range(n)]
    rows = stored(spark, *[f"t{i}" for i in range(n)]).withColumn("id", F.concat(F.lit("s"), F.lpad(F.regexp_extract("text", "[0-9]+", 0), 2, "0")))
    rows = rows.withColumn("pinned", F.col("id") == "s09").withColumn("trust", F.when(F.col("id") == "s17", "reported").otherwise("trusted"))
    chain = [(names[i], names[i + 1], i) for i in range(20)]  # s00 takes s01 takes s02 ...
    tree = [(names[rng.randrange(25, i)], names[i], rng.randrange(9)) for i in range(26, 50)]
    odd = [("s50", "s51", 0), ("s51", "s52", 0), ("s52", "s50", 0), ("s53", "s51", 9), ("s54", "s54", 0), ("s54", "nobody", 0), ("s55", "s50", 5)]
    edges = [(rng.choice(names), rng.choice([*names, "gone"]), "related") for _ in range(40)]
    frame = spark.createDataFrame(edges, "src string, dst string, rel string").distinct()
    after, links = U.merge(rows, frame, spark.createDataFrame(chain + tree + odd, "target string, other string, pos int"))
    kids = {}
    for target, other, pos in sorted(chain + tree, key=lambda p: (p[2], p[1])):
        kids.setdefault(target, []).append(other)
    whole = lambda x: [x, *(y for k in kids.get(x, []) for y in whole(k))]
    gone = {o for _, o, _ in chain + tree}
    top = {y: x for x in names if x not in gone for y in whole(x)}
    got = {r.id: r for r in after.collect()}
    assert set(got) == set(names) - gone
    for x, r in got.items():
        members = whole(x)
        assert r.text == "\n\n".join(f"t{int(y[1:])}" for y in members)
        assert r.pinned == ("s09" in members) and r.trust == ("reported" if "s17" in members else "trusted")
    want = {(top[a], top.get(b, b), rel) for a, b, rel in set(edges) if (b in top or a not in gone) and not (top[a] == top.get(b, b) and (a in gone or b in gone))}
    assert set(map(tuple, links.collect())) == want


def test_trash(spark):
    rows = stored(spark, "a", "b", "c").select("id", "text")
    left, entries = B.trash(rows, spark.createDataFrame([("s0",), ("nobody",)], "id string"), 5.0, "me", "main")
    assert left.count() == 2 and entries.first().memory.text == "a"
    older = entries.withColumn("deleted_at", F.lit(1.0)).withColumn("memory", F.struct(F.lit("s0").alias("id"), F.lit("older").alias("text")))
    other = entries.withColumn("collection", F.lit("other")).withColumn("deleted_at", F.lit(9.0))
    every = entries.unionByName(older).unionByName(other)
    want = spark.createDataFrame([("s0",)], "id string")
    back, rest = B.restore(every, left, want, "main")
    assert {(r.id, r.text) for r in back.collect()} == {("s0", "a"), ("s1", "b"), ("s2", "c")}
    assert {(r.deleted_at, r.collection) for r in rest.collect()} == {(1.0, "main"), (9.0, "other")}
    assert B.restore(every, rows, want, "main")[1].count() == 3  # it lives: nothing happens
    twice = every.unionByName(entries).unionByName(other.withColumn("deleted_at", F.lit(5.0)))
    back, rest = B.restore(twice, left, want.unionAll(want), "main")
    assert back.count() == 3 and sorted((r.deleted_at, r.collection) for r in rest.collect()) == [(1.0, "main"), (5.0, "main"), (5.0, "other"), (9.0, "other")]
    assert B.purge(every, "main").count() == 1 and B.purge(every, "main", want).count() == 1
    assert B.purge_expired(every, "main", 0, 1e9).count() == 3
    assert B.purge_expired(every, "main", 1, 86_403.0).count() == 2


def test_imports(spark):
    store = stored(spark, "a", "b")
    new = stored(spark, "new a", "c").withColumn("id", F.when(F.col("id") == "s1", "t1").otherwise("s0")).withColumn("superseded_by", F.when(F.col("id") == "t1", "s0").otherwise(""))
    links = spark.createDataFrame([("t1", "s0", "related")], "src string, dst string, rel string")
    edges = spark.createDataFrame([("s0", "s1", "related")], "src string, dst string, rel string")
    for policy, texts in (("skip", {"a", "b", "c"}), ("overwrite", {"new a", "b", "c"}), ("rename", {"a", "new a", "b", "c"})):
        rows, after, summary = A.imported(new, links, store, edges, policy, "x")
        got = {r.text: r for r in rows.collect()}
        assert set(got) == texts and sum(r.n for r in summary.collect()) == 2
        to = got["new a"].id if policy == "rename" else "s0"
        assert got["c"].superseded_by == to and ("t1", to, "related") in set(map(tuple, after.collect()))
    assert A.imported(new, links, store, edges, "rename", dry_run=True)[0] is store
    for bad in (new, new.where("id = 't1'").unionAll(new.where("id = 't1'"))):
        with pytest.raises(Exception, match="already there"):
            A.import_actions(bad.select("id"), store, "error").collect()
        with pytest.raises(ValueError, match="collisions, among them (s0: already there|t1: comes twice)"):
            A.imported(bad, links, store, edges, "error")
    assert A.imported(new.where("id = 't1'"), links, store, edges, "error")[0].count() == 3
    with pytest.raises(ValueError):
        A.import_actions(new, store, "merge")
    again = new.withColumn("seq", F.lit(1)).unionAll(new.withColumn("text", F.concat("text", F.lit(" later"))).withColumn("seq", F.lit(2)))
    for policy, texts, counts in (
        ("skip", {"a", "b", "c"}, {"add": 1, "skip": 3}),
        ("overwrite", {"new a later", "b", "c later"}, {"add": 1, "replace": 3}),
        ("rename", {"a", "b", "new a", "new a later", "c", "c later"}, {"add": 1, "rename": 3}),
    ):
        rows, after, summary = A.imported(again, links, store, edges, policy, "x")
        got = {r.text: r for r in rows.collect()}
        assert set(got) == texts and len({r.id for r in got.values()}) == rows.count() == len(texts)
        assert {r.action: r.n for r in summary.collect()} == counts
        if policy == "rename":
            assert got["c"].superseded_by == got["new a"].id == got["c later"].superseded_by and ("t1", got["new a"].id, "related") in set(map(tuple, after.collect()))


def test_numbered_and_collections(spark):
    rows = spark.range(1000).select(F.xxhash64("id").alias("k"), "id").repartition(7)
    got = [(r.line, r.k) for r in A.numbered(rows, "k").orderBy("line").collect()]
    assert [x[0] for x in got] == list(range(1, 1001)) and [x[1] for x in got] == sorted(x[1] for x in got)
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    with pytest.raises(ValueError):
        A.created(names, "a")
    held = spark.createDataFrame([("1", "a", "x"), ("1", "b", "y"), ("2", "a", "z")], "id string, collection string, text string")
    for gone, active in (("a", "a"), ("c", "a")):
        with pytest.raises(ValueError):
            A.deleted(held, names, gone, active)
    assert sorted(map(tuple, A.copied(held, "a", "b").collect())) == [("1", "a", "x"), ("1", "b", "x"), ("2", "a", "z"), ("2", "b", "z")]


def test_tick_isolates_jobs(spark):
    rows = stored(spark, "a", "b", "c").withColumn("last_accessed", F.when(F.col("id") == "s0", NOW - 90 * 86400).otherwise(NOW)).withColumn("expires_at", F.when(F.col("id") == "s1", NOW - 1).otherwise(0.0))
    _, entries = B.trash(rows, rows.where("false"), NOW, "", "main")

    def broken(_):
        raise RuntimeError("no model")

    first = M.tick(rows, entries, M.State(), NOW, broken, "main")
    assert first.ran == {"decay": 1, "purge": 1, "trash": 0} and first.errors == {"reflect": "no model"}
    assert {r.id for r in first.rows.collect()} == {"s2"} and {r.memory_id for r in first.entries.collect()} == {"s0"}
    again = M.tick(first.rows, first.entries, first.state, NOW + 60, lambda r: (r, 3), "main")
    assert again.ran == {"reflect": 3} and again.state.totals == {"decay": 1, "purge": 1, "reflect": 3}
    off = M.tick(rows, entries, M.State(), NOW, None, "main", every={"decay": None, "purge": None})
    assert off.ran == {}


def test_embedders(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            got = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])]
            reply = {"data": got[::-1]} if body["model"] == "m" else {"embeddings": [g["embedding"] for g in got]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(reply).encode())

        def log_message(self, *args):
            pass

    hash_ = HashEmbedder(20)
    a, b = hash_(["x", "y"])
    assert a == hash_(["x"])[0] != b and abs(sum(v * v for v in a) - 1) < 1e-12 and len(a) == 20
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v1/embeddings"
    rows = spark.createDataFrame([(i, "t" * i if i else None) for i in range(7)], "id long, text string")
    for kind, model in (("openai", "m"), ("ollama", "o")):
        got = {r.id: r.x for r in embedded(rows, HttpEmbedder(url, model, kind, "key"), at_once=3).collect()}
        assert got == {i: [float(i), 1.0] for i in range(7)}
    server.shutdown()
    with pytest.raises(Exception, match="vectors for"):
        embedded(rows, lambda texts: [[1.0]]).collect()
    assert probe(lambda texts: 1 / 0)["ok"] is False and probe(hash_) == {"ok": True, "dim": 20}
    with pytest.raises(ValueError):
        HashEmbedder(0)


def brute_supersede(rows, pairs):
    """One pair after the other: rows of id to [mark, pinned]. Pairs come oldest row first."""
    links = set()
    for old, new in pairs:
        rows[old][0], rows[new][1] = new, rows[new][1] or rows[old][1]
        links.add((new, old, "supersedes"))
    return rows, links


def test_supersede_in_chains(spark):
    """Chains of any length in one batch: pins reach the head, loops change nothing."""
    n = 70
    names = [f"s{i:02}" for i in range(n)]
    rows = stored(spark, *[f"t{i}" for i in range(n)]).withColumn("id", F.concat(F.lit("s"), F.lpad(F.regexp_extract("text", "[0-9]+", 0), 2, "0")))
    rows = rows.withColumn("pinned", F.col("id").isin("s03", "s50")).withColumn("superseded_by", F.when(F.col("id") == "s60", "s61").otherwise(""))
    chain = [(names[i], names[i + 1]) for i in range(40)]
    loop = [("s45", "s46"), ("s46", "s47"), ("s47", "s45"), ("s44", "s45")]
    odd = [("s62", "s60"), ("s61", "s62"), ("s05", "s09"), ("s50", "nobody"), ("nobody", "s50"), ("s51", "s51"), ("s60", "s61"), ("s50", "s52")]
    edges = spark.createDataFrame([("s00", "s01", "related")], "src string, dst string, rel string")
    pairs = spark.createDataFrame(chain + loop + odd + chain[:3], "old string, new string")
    after, links = Y.supersede(rows, edges, pairs, NOW)
    state = {r.id: (r.superseded_by, r.pinned) for r in after.collect()}
    assert after.count() == n == len(state)
    plain = {x: ["s61" if x == "s60" else "", x in ("s03", "s50")] for x in names}
    # s62 -> s60 -> s61 -> s62 is a loop through an older mark: of the batch's two pairs in it none stands.
    want, made = brute_supersede(plain, [*chain, ("s44", "s45"), ("s50", "s52")])
    assert state == {k: tuple(v) for k, v in want.items()}
    assert set(map(tuple, links.collect())) == made | {("s00", "s01", "related")}
    assert {r.id for r in after.where(F.col("superseded_at") == NOW).collect()} == {o for _, o, _ in made}
    again, more = Y.supersede(after, links, pairs, NOW + 9)
    assert again.where(F.col("superseded_at") == NOW + 9).count() == 0 and more.count() == links.count()
    assert {r.id for r in Y.supersede(rows, edges, spark.createDataFrame([("s00", "s02", 2), ("s00", "s01", 1)], "old string, new string, pos int"), NOW)[0].where("superseded_by = 's02'").collect()} == {"s00"}


def test_supersede_joins_parts_of_a_union_once(spark, monkeypatch, capsys):
    """No stage holds a join of its own for each part of the pairs."""
    keep = Y.Scratch.keep
    monkeypatch.setattr(Y.Scratch, "keep", lambda self, df: (df.explain(), keep(self, df))[1])
    rows = stored(spark, *[f"t{i}" for i in range(12)])
    pairs = spark.createDataFrame([], "old string, new string")
    for i in range(5):
        pairs = pairs.unionAll(rows.where(F.col("id") == f"s{i}").select(F.col("id").alias("old"), F.lit(f"s{i + 5}").alias("new")))
    edges = spark.createDataFrame([], "src string, dst string, rel string")
    after, links = Y.supersede(rows, edges, pairs, NOW)
    plans = capsys.readouterr().out.split("== Physical Plan ==")[1:]
    assert plans and max(p.count("LeftSemi") for p in plans) <= 1
    assert {(r.id, r.superseded_by) for r in after.where("superseded_by <> ''").collect()} == {(f"s{i}", f"s{i + 5}") for i in range(5)} and links.count() == 5


def test_restore_gives_back(spark):
    rows = stored(spark, "a", "b", "c").withColumn("pinned", F.col("id") == "s0")
    edges = spark.createDataFrame([("s1", "s0", "related")], "src string, dst string, rel string")
    pairs = spark.createDataFrame([("s0", "s1")], "old string, new string")
    after, links = Y.supersede(rows, edges, pairs, NOW)
    assert {r.id for r in after.where("pinned").collect()} == {"s0", "s1"}
    ids = spark.createDataFrame([("s0",), ("s0",), ("s2",), ("nobody",)], "id string")
    back, left = Y.restore(after, links, ids)
    assert sorted((r.id, r.superseded_by, r.superseded_at, r.pinned) for r in back.collect()) == [("s0", "", 0.0, True), ("s1", "", 0.0, False), ("s2", "", 0.0, False)]
    assert list(map(tuple, left.collect())) == [("s1", "s0", "related")]


def test_edit_refuses_and_reports(spark):
    rows = stored(spark, "one", "two", "three").withColumn("valid_until", F.when(F.col("id") == "s1", 5.0).otherwise(0.0))
    change = lambda schema, *values: Y.edit(rows, spark.createDataFrame(list(values), schema))
    after, said = change("id string, new_text string", ("s0", "  "), ("s1", " two "), ("s2", "new"), ("x", "y"))
    assert {r.id: r.verdict for r in said.collect()} == {"s0": "bad text", "s1": "same", "s2": "changed", "x": "unknown"}
    assert [r.text for r in after.orderBy("id").collect()] == ["one", "two", "new"]
    assert after.where("id = 's2'").first().content_hash != rows.where("id = 's2'").first().content_hash
    for schema, value in (("new_type string", "odd"), ("new_polarity int", 2), ("new_expires_at double", -1.0), ("new_trust string", ""), ("new_tags array<string>", ["a,b"]), ("new_valid_from double", 5.0)):
        after, said = change(f"id string, {schema}, new_importance double", ("s1", value, 0.1))
        assert said.first().verdict.startswith("bad") and after.where("id = 's1'").first().importance != 0.1
    after, said = change("id string, new_valid_from double, new_importance double, clear_source boolean, pos int", ("s1", 4.0, 7.0, True, 2), ("s1", 9.0, 0.2, False, 1))
    r = after.where("id = 's1'").first()
    assert after.count() == 3 and (r.valid_from, r.importance, r.source) == (4.0, 1.0, None) and said.count() == 1


def test_touch_deltas(spark):
    """Any number of batches, merged in any grouping, leave what touching one by one leaves."""
    import random

    from mnemora.operators import touches as D

    rng = random.Random(1)
    rows = stored(spark, *"abcdefgh").drop("vec_id")
    one, deltas = rows, None
    for seq in range(7):
        hits = spark.createDataFrame([(f"s{rng.randrange(10)}",) for _ in range(rng.randrange(1, 12))] + [(None,)], "id string")
        now = NOW + rng.randrange(1000)
        one = Y.touch(one, hits, now)
        new = D.delta(hits, now, seq)
        assert new.count() == hits.where("id IS NOT NULL").distinct().count()
        deltas = new if deltas is None else deltas.unionByName(new)
    state = lambda df: {r.id: (r.access_count, r.last_accessed) for r in df.collect()}
    want = state(one)
    assert state(D.merged(rows, deltas)) == want == state(D.merged(rows, D.summed(deltas)))
    for upto in (-1, 2, 9):
        base, left = D.folded(rows, deltas, upto)
        assert state(D.merged(base, left)) == want
        assert state(D.merged(base, D.summed(left.where("seq % 2 = 0")).unionByName(left.where("seq % 2 = 1")))) == want
    assert D.due(126, 1000) and not D.due(125, 1000)

"""Each operator against brute force on small fixtures, and its corner cases."""

import hashlib
import random
import re
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora.llm import fingerprint, learning, minhash, mixing, projections, quality, suffix, toxicity, url_filter
from mnemora.llm.common import Scratch, components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def words(rng, n):
    return " ".join("".join(rng.choices(string.ascii_lowercase[:8], k=rng.randint(2, 6))) for _ in range(n))


def corpus():
    rng = random.Random(3)
    base = [words(rng, 60) for _ in range(12)]
    shared = words(rng, 15)
    rows = [(i, t, "a") for i, t in enumerate(base)]
    rows += [(20 + i, base[0], "b") for i in range(5)]
    for i in range(12):
        w = base[1].split()
        w[rng.randrange(60)] = "changed"
        rows.append((40 + i, " ".join(w), "b"))
    rows += [(60 + i, f"{words(rng, 10)} {shared} {words(rng, 10)}", None) for i in range(6)]
    rows += [(80, None, "c"), (81, "", "c"), (82, "  \n", "c"), (83, "one", None), (84, "one", "a"), (85, "one two", "a"), (86, "é" * 200, "a"), (87, "é" * 120, "a"), (88, "x" * 5000, "d")]
    return rows


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("k, part", [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, part):
    rows = corpus()
    sets = {i: shingle_set(t, k) for i, t, _ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= part * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = minhash.near_duplicates(frame(spark, rows), k, part).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(sets[i]), find(i), find(i) == i) for i in sets}
    assert len(got) == len(rows)


def test_near_duplicates_empty_and_null_ids(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    got = minhash.near_duplicates(frame(spark, [(None, "a b c", "x"), (1, "a b c", "x"), (1, "a b c", "x")])).collect()
    assert sorted((r.doc_id or -1, r.kept) for r in got) == [(-1, False), (1, True), (1, True)]


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    s = minhash.sketches([a, np.concatenate((a[:300], rng.integers(0, 2**63, 100).astype(np.uint64))), a[:1], a[:0]], 128)
    assert (s[:3] != np.uint64(2**64 - 1)).all() and (s[3] == np.uint64(2**64 - 1)).all()
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.15


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (4, 5), (9, 8), (8, 7), (7, 1), (6, 6)], "a long, b long")
    got = {r.node: r.component for r in components(links, Scratch(spark)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 4: 4, 5: 4}


def brute_repeats(rows, n=50):
    seen, out = {}, {}
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - n + 1):
            w = raw[s : s + n]
            if seen.setdefault(w, i) < i:
                gone[s : s + n] = b"\1" * n
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


def test_suffix_arrays(spark, tmp_path):
    rows = corpus()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_repeats(rows)
    got = suffix.op8_suffix_arrays(spark, str(tmp_path)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {i: v[:4] for i, v in want.items()}
    left = {r.doc_id: r.text for r in suffix.remove_repeats(frame(spark, rows)).collect()}
    assert left[80] is None and all(left[i] == v[4].decode("utf-8", "replace") for i, v in want.items() if i != 80)
    assert suffix.remove_repeats(frame(spark, [])).count() == 0


def _pieces(text, doc):
    raw = np.frombuffer(text, dtype=np.uint8)
    first, last, at, _ = suffix.runs(raw)
    return suffix.piece_rows(raw, np.zeros(len(first), dtype=np.int64), first, last - first + 1, at - first), np.full(len(first), doc), at


@pytest.mark.parametrize("batch", [7, 64, 10_000])
def test_family_of_suffix_arrays(batch):
    """Batches by rising owner settle exactly the windows that smaller owners have."""
    rng = random.Random(3)
    lines = [bytes(rng.choices(b"ab\0 ", k=rng.randrange(20, 90))) for _ in range(12)]
    texts = [b"".join(rng.choice(lines) + bytes(rng.choices(b"xy", k=rng.randrange(3))) for _ in range(6)) for _ in range(25)]
    parts = [_pieces(t, i) for i, t in enumerate(texts)]
    rows, owner, at = (np.concatenate([p[i] for p in parts]) for i in range(3))
    family, masks = suffix.Family(), []
    for i in range(0, len(rows), batch):
        masks.append(family.scan(rows[i : i + batch], owner[i : i + batch]))
    mask, seen, want = np.concatenate(masks), {}, set()
    for i, t in enumerate(texts):
        want |= {(i, s) for s in range(len(t) - 49) if seen.setdefault(t[s : s + 50], i) < i}
    n, off = rows[:, -2].astype(int), rows[:, -1].astype(int)
    got = {(o, a - back) for o, a, m, r, left in zip(owner, at, mask, n, off) for back in range(50 - r, left + 1) if m >> back & 1}
    assert got == want and len(family.levels) <= np.log2(len(rows)) + 1
    for level in family.levels.values():
        assert (level.keys[1:] > level.keys[:-1]).all() and len(np.unique(level.keys)) == len(level.keys)


def test_anchors_dealt_twice(spark, tmp_path, monkeypatch):
    """Buckets dealt again, and a very common line, change nothing."""
    rows = corpus()
    common = "one very common line that is in every text of the table, over and over\n"
    rows = [(i, t and t + common + str(i % 7) * 3 + common, s) for i, t, s in rows]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(suffix, "FAN", 3)
    monkeypatch.setattr(suffix, "SHARD_BYTES", 4000)
    monkeypatch.setattr(suffix, "BATCH_PIECES", 50)
    got = {r.doc_id: tuple(r)[1:] for r in suffix.op8_suffix_arrays(spark, str(tmp_path)).collect()}
    assert got == {i: v[:4] for i, v in brute_repeats(rows).items()}


def test_suffix_long_text_and_clashing_columns(spark):
    """A text in several pieces of hashing; columns named as the operator's own; null and repeated ids."""
    rng = np.random.default_rng(5)
    long = "".join(map(chr, rng.integers(97, 123, (1 << 22) + 500).tolist()))
    rows = [(1, long, "a", 1), (2, long[(1 << 22) - 40 : (1 << 22) + 40], "b", 2), (2, long[100:200], "c", 3), (None, long[:60], "d", 4), (3, None, "e", 5), (4, "", "f", 6), (4, long[150:220], "g", 7), (4, long[150:220], "g", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, blobs string, th int").withColumn("key", F.col("blobs"))
    out = suffix.remove_repeats(df)
    assert out.columns == df.columns
    got = sorted((r.blobs, r.text, r.th, r.key) for r in out.collect())
    assert got == [("a", long, 1, "a"), ("b", "", 2, "b"), ("c", "", 3, "c"), ("d", long[:60], 4, "d"), ("e", None, 5, "e"), ("f", "", 6, "f"), ("g", "", 7, "g"), ("g", "", 7, "g")]


def test_drawn_places(spark):
    """A permutation of any number of slots, and a shard's share of a run of slots spreads
    as drawing without replacement does."""
    for total in (1, 2, 3, 64, 1001):
        got = [r[0] for r in spark.range(total).select(mixing.drawn_place(F.col("id"), total)).collect()]
        assert sorted(got) == list(range(total))
    total, shard, run = 400_000, 500, 100_000
    places = spark.range(run).select(F.floor(mixing.drawn_place(F.col("id"), total) / shard).alias("s")).groupBy("s").count().toPandas()["count"]
    p = run / total
    assert len(places) == total // shard
    assert abs(places.std() / (shard * p * (1 - p) * (1 - shard / total)) ** 0.5 - 1) < 0.1


def test_shards_are_drawn(spark):
    """Shards are of one length, the last of what is left; a source's slots fall into them in
    order, all of them, at random but repeatably."""
    sources = spark.createDataFrame([(0, 900, 2000), (1, 50, 37), (2, 8, 0), (3, 100_000, 300_000)], "sid int, blocks long, slots long")
    total = 302_037
    for length in (1000, 50_000, total, 10**7):
        got = sorted(tuple(r) for r in mixing.drawn_shards(sources, total, length, 5, Scratch(spark)).collect())
        assert got == sorted(tuple(r) for r in mixing.drawn_shards(sources, total, length, 2, Scratch(spark)).collect())
        sizes = {}
        for _, _, shard, _, n in got:
            sizes[shard] = sizes.get(shard, 0) + n
        assert sizes == {i: min(length, total - i * length) for i in range(-(-total // length))}
        for sid, blocks, slots in (tuple(r) for r in sources.collect()):
            mine = [g for g in got if g[0] == sid]
            assert sum(g[4] for g in mine) == slots and all(g[1] == blocks and g[4] > 0 for g in mine)
            at = 0
            for _, _, _, start, n in sorted(mine, key=lambda g: g[2]):
                assert start == at
                at += n
        if length == 1000:  # of source 0, 6.6 a shard are expected
            counts = [next((g[4] for g in got if g[0] == 0 and g[2] == i), 0) for i in range(302)]
            assert 2.1 < np.std(counts) < 3.1


def test_mixed_blocks(spark):
    """Every slot of the mix has its block's words, in a shard that the draw gave it to."""
    rows = corpus()
    docs = frame(spark, rows)
    mix = mixing.mix_sources(docs, Scratch(spark), shard_blocks=5)
    shards = {(r.sid, r.shard): (r.start, r.n) for r in mix.shards.collect()}
    slots = {(r.sid, r.slot): (r.shard, r.block) for r in mix.slots.collect()}
    assert len({s for _, s in shards}) > 3
    filled = [sum(n for (_, z), (_, n) in shards.items() if z == s) for s in sorted({s for _, s in shards})]
    assert set(filled[:-1]) == {5} and 0 < filled[-1] <= 5
    assert all(shards[sid, s][0] <= k < sum(shards[sid, s]) for (sid, k), (s, _) in slots.items())
    text, order = {i: t for i, t, _ in rows}, {}
    for r in mix.placed.orderBy("sid", "start").collect():
        order.setdefault(r.sid, []).extend(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id]))
    names = {r.source: r.sid for r in mix.sources.collect()}
    got = mixing.mixed_blocks(docs, shard_blocks=5).collect()
    assert len(got) == len(slots)
    for r in got:
        assert slots[names[r.source], r.slot] == (r.shard, r.block)
        assert r.text.split(" ") == order[names[r.source]][r.block * 32 : r.block * 32 + 32]


def test_mixing_query(spark, tmp_path):
    """The query with nulls, empty texts, repeated rows, and an empty table."""
    rows = [*corpus(), (5, "a b c", "a"), (5, "a b c", "a"), (None, "x y", "b"), (90, "w " * 90_000, "d")]
    frame(spark, rows).write.parquet(f"{tmp_path}/a/documents.parquet")
    got = sorted((tuple(r) for r in mixing.op2_mixing(spark, f"{tmp_path}/a").collect()), key=repr)
    assert got == sorted((tuple(r) for r in mixing.op2_mixing(spark, f"{tmp_path}/a").collect()), key=repr)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r[0]), r[1]) for r in got) == sorted((str(i), size(t)) for i, t, _ in rows)
    assert all(0 <= taken <= 3 * n for _, n, _, _, taken in got)
    per = Counter()
    for *_, source_size, target, taken in got:
        per[source_size, target] += taken
    assert all(abs(v - k[1]) <= 3 * mixing.BLOCK_WORDS for k, v in per.items())
    frame(spark, []).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert mixing.op2_mixing(spark, f"{tmp_path}/b").count() == 0 == mixing.mixing_stage(spark, frame(spark, []), "").count()


def test_winnowing(spark, tmp_path):
    rng = random.Random(1)
    shared = words(rng, 12)[: fingerprint.K + fingerprint.W - 1]
    a, b = (fingerprint.winnow(fingerprint.code_points(words(rng, 30) + shared + words(rng, 30)))[0] for _ in range(2))
    assert set(a) & set(b)
    codes = fingerprint.code_points("ab" * 300)
    hashes, at = fingerprint.winnow(codes)
    grams = {codes[i : i + fingerprint.K].tobytes() for i in at}
    assert len(grams) == 1 and (np.diff(at) <= fingerprint.W).all()
    rows = corpus()
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprint.op1_winnowing(spark, str(tmp_path)).collect()}
    order = sorted(i for i, *_ in rows)
    text = {i: t or "" for i, t, _ in rows}
    assert set(got) == set(order)
    for i, nxt in zip(order, order[1:] + order[:1]):
        half = len(text[i]) // 2
        edited = text[i][: len(text[i]) - half] + text[nxt][:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(text[i])
        assert 0 <= got[i].near_edited <= 1 and (got[i].fingerprint == got[i].edited_fingerprint) <= (got[i].near_edited == 1)
    assert got[0].fingerprint == got[20].fingerprint and got[20].near_next == 1


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randint(0, 200)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)] + [(400, None, "z"), (401, "", "b"), (5, "one two", "a"), (5, "one two", "a")]
    docs = frame(spark, rows)

    def run():
        mix = mixing.mix_sources(docs, Scratch(spark))
        got = mix.placed.join(mixing.taken_words(mix), ["sid", "start"], "left").collect()
        return mix, sorted((r.sid, r.doc_id, r.size, r.taken or 0) for r in got)

    mix, got = run()
    assert got == run()[1]
    sources = {r.sid: r for r in mix.sources.collect()}
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    target |= share
    for r in sources.values():
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        assert abs(sum(g[3] for g in got if g[0] == r.sid) - r.target) <= 3 * mixing.BLOCK_WORDS
    assert all(g[3] <= 3 * g[2] for g in got)
    for (sid, p), blocks in {((r.sid, r["pass"])): None for r in mix.slots.collect()}.items():
        seen = [r.block for r in mix.slots.where(f"sid = {sid} AND pass = {p}").collect()]
        assert len(seen) == len(set(seen))
        break
    out = mixing.mixing_stage(spark, docs, "").collect()
    assert sum(len(r.text.split()) for r in out) == sum(g[3] for g in got) and out[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}


def test_mixing_keeps_rows_without_id(spark):
    rng = random.Random(12)
    rows = [(None if i % 3 == 0 else i % 40, words(rng, 30 + i % 4), rng.choice(["a", "b", None])) for i in range(90)] + [(0, words(rng, 30), "a"), (None, "one two", "z"), (None, "one two", "z"), (None, None, "z")]
    docs = frame(spark, rows)
    mix = mixing.mix_sources(docs, Scratch(spark))
    placed = mix.placed.join(mixing.taken_words(mix), ["sid", "start"]).collect()
    source = {r.sid: r.source for r in mix.sources.collect()}
    want, got = Counter(), Counter()
    for r in placed:
        want[r.doc_id, source[r.sid]] += r.taken
    texts = {(i, s, w) for i, t, s in rows for w in (t or "").split()}
    for r in mixing.mixing_stage(spark, docs, "").collect():
        got[r.doc_id, r.source] += len(r.text.split())
        assert all((r.doc_id, r.source, w) in texts for w in r.text.split())
    assert got == want and got[None, "a"] and got[None, None] and got[None, "z"]


def test_projections(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    x = np.concatenate((base, base + 0.1 * rng.standard_normal((40, 16)), base[:5], base[:1] * 2, np.tile(base[7], (30, 1)) + 0.02 * rng.standard_normal((30, 16))))
    rows = [(i, [float(c) for c in v], int(i % 40 % 3) if i < 80 else 0) for i, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [1.0, None], 1), (903, [float("nan")] * 16, 1), (904, [1.0] * 16, None)]
    got = {r.vec_id: r for r in projections.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    ok = [(i, np.array(v, dtype=np.float32).astype(float), label) for i, v, label in rows if i < 900]
    root, links = {i: i for i, *_ in rows}, dict.fromkeys((i for i, *_ in rows), 0)
    for i, u, a in ok:
        for j, v, b in ok:
            if i != j and a == b and u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= 0.93:
                links[i] += 1
    for _ in range(50):
        for i, u, a in ok:
            for j, v, b in ok:
                if i < j and a == b and root[i] != root[j] and u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= 0.93:
                    root[i] = root[j] = min(root[i], root[j])
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (links[i], root[i], root[i] == i) for i in root}


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?q", "http://example.net/en", "https://example.com/de/1#x", "http://example.com?/de/", "http://notexample.com/de/", "http://x.org/fr/", "ftp://net/", "http://net", "a://b://net/"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.RULES).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[4] == ("example.net", "/en", "net/", "block") and got[5][2:] == ("example.com/de/", "block")
    assert got[6] == ("example.com", "", None, "allow") and got[7][2:] == (None, "allow") and got[8][2:] == ("org/fr/", "allow")
    assert got[9][2:] == ("net/", "block") and got[10][2:] == (None, "allow") and got[11][:2] == ("b:", "//net/")


def test_trees_and_flat_traversal():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    model = quality.fit(x[:1500], y[:1500])
    assert ((model.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    p = model.predict(x[:3])
    for row, want in zip(x[:3], p):
        m = model.base
        for t in range(len(model.value)):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + 1 + int(row[model.feature[t, node]] > model.threshold[t, node])
            m += model.value[t, node - 2**quality.DEPTH + 1]
        assert want == pytest.approx(1 / (1 + np.exp(-m)))
    assert quality.fit(np.zeros((0, 5)), np.zeros(0)).predict(x[:2]) == pytest.approx([0.5, 0.5])


def test_grammar_is_its_five_transducers_in_turn():
    """The composed machine puts out and weighs what the five do, one after another."""
    rng = random.Random(8)
    weights = {o: rng.uniform(-3, 3) for o in toxicity.OUTCOMES}
    five, machine = toxicity.transducers(weights), toxicity.grammar(weights)
    outcomes = set()
    for _ in range(3000):
        letters = rng.choices(range(6), weights=[2, 3, 1, 2, 1, 1], k=rng.randrange(12))
        now, total = letters, 0.0
        for t in five:
            now, w = t.run(now)
            total += w
        got, weight = machine.run(letters)
        assert got == now and weight == pytest.approx(total)
        assert weight == pytest.approx(sum(weights[o] for o in got if o in toxicity.OUTCOMES))
        outcomes.update(got)
    assert outcomes >= set(toxicity.OUTCOMES)


def test_clauses():
    """What a clause's words around an insult make of it; words alone decide nothing else."""
    weights = {toxicity.INSULT: 1.0, toxicity.DENIED: -2.5, toxicity.QUOTED: -2.0, toxicity.AIMED: 2.0, toxicity.MENACE: 1.5, toxicity.PILED: 1.25}
    m = toxicity.Matcher({"zork ": 3.0, "blar": 1.0}, weights)
    at = lambda text: [(round(s, 6), [toxicity.OUTCOMES.index(o) for o in out]) for s, _, out in m.clauses(text.lower())]
    assert at("what a zork, really") == [(4.0, [0])] and at("nothing here. not there") == []
    assert at("this is not a zork") == [(0.5, [1])] and at("You are a zork") == [(5.0, [3])]
    assert at("anna said it was zork; zork it is") == [(1.0, [2]), (4.0, [0])]
    assert at("i will kill you") == [(1.5, [4])] and at("kill the process") == []
    assert at("zork blarx! bright day") == [(6.25, [0, 5])]
    assert at("zorky") == [] and at("blar") == [] and at("blarx") == [(2.0, [0])]
    assert m.features("said it was zork") != m.features("well it was zork") and m.features("a day") == m.features("") == [0.0] * m.n_features


def test_outcome_weights_are_learned(spark):
    """Where denied and quoted insults are harmless, their arcs come to weigh less."""
    rng = random.Random(11)
    bad, fine = ["you are a zork", "what a zork"], ["this is not a zork", "he said that zork"]
    rows, labels = [], []
    for i in range(600):
        toxic = int(i % 3 == 0)
        lead = rng.choice(bad) if toxic else rng.choice(fine) if i % 12 == 1 else words(rng, 4)
        rows.append((i, f"{words(rng, 20)}. {lead}. {words(rng, 20)}", "a"))
        labels.append((i, 1, toxic))
    docs, labels = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    matcher, predict = toxicity.train_toxicity(docs, labels)
    assert any(x.startswith("zork") for x in matcher.stems)
    score = lambda t: float(predict(np.array([matcher.features(t)]))[0])
    assert min(map(score, bad)) > toxicity.THRESHOLD > max(map(score, fine))


def test_classifiers_corner_cases(spark):
    """An empty table, no labels, one label only, a very long text."""
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(i, 1, 1) for i in range(8)], none.schema)
    docs = frame(spark, [*((i, f"text {i}", "a") for i in range(8)), (9, "word zork. " * 300_000, "b")])
    for f in (quality.score_quality, toxicity.score_toxicity):
        assert f(frame(spark, []), none).count() == 0
        for labels in (none, one):
            got = f(docs, labels).collect()
            assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)


def test_classifiers_score_every_row(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, 40) + (" idiot" if i % 5 == 0 else ""), "a") for i in range(200)] + [(300, None, "a"), (301, "", "b"), (301, "", "b")]
    docs = frame(spark, rows).withColumnRenamed("lang", "score")
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 5 == 0)) for i in range(200)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for f in (quality.score_quality, toxicity.score_toxicity):
        got = f(docs, labels).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got) and got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    toxic = {r.doc_id: r.predicted for r in got}
    assert all(toxic[i] == (i % 5 == 0) for i in range(200))
    chosen = learning.labelled_sample(docs, labels, "toxic", 10).count()
    assert chosen == 10


def test_rare_stems_are_learned_among_many(spark):
    """A clear stem of 8 toxic documents counts, however many stems are commoner; the
    words of one toxic document don't, however many copies of it there are."""
    rng = random.Random(13)
    common = ["".join(rng.choices(string.ascii_lowercase, k=10)) for _ in range(5000)]
    some = lambda: " ".join(rng.sample(common, 300))
    rows = [(1, some() + " zzqxblar" * (i < 8)) for i in range(20)] + [(0, some()) for _ in range(40)] + [(0, words(rng, 12)) for _ in range(240)]
    rows += [(1, "quxx copied words zzqxblar")] * 60
    assert len(toxicity._beginnings(set(common))) > 20_000
    got = toxicity.learned_stems(spark.createDataFrame(rows, "label int, text string"))
    assert "zzqxblar " in got and got["zzqxblar "] > 2 and not {"quxx ", "copied ", "words "} & set(got)

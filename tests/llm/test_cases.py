"""The queries' corner cases: nulls, empty and very long texts, ties, repeats, empty tables, clashing columns."""

import base64
import hashlib
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora.llm import fingerprint, minhash, projections, quality, rolling, toxicity, url_filter

from .test_operators import corpus, frame, shingle_set, words

DATA = Path("/root/testdata")


def brute_winnow(codes, k, w):
    """Chosen positions, window by window, of grams compared as the operator compares them."""
    grams = [int(rolling.gram_hashes(rolling.prefix(codes[i : i + k]), k)[0]) >> rolling.POS_BITS for i in range(len(codes) - k + 1)]
    w = min(w, len(grams))
    return sorted({max(range(i, i + w), key=lambda j: (-grams[j], j)) for i in range(len(grams) - w + 1)})


def decoded(text):
    """(hashes, positions) of a written fingerprint."""
    hashes, gaps = (base64.b64decode(x) for x in text.split(":"))
    at, out, n, shift = -0, [], 0, 0
    for b in gaps:
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            at += n
            out.append(at)
            n = shift = 0
    return np.frombuffer(hashes, dtype="<u4"), out


def test_winnowing_against_brute_force(spark, tmp_path):
    """Choices, positions and both likenesses of the query, from its own column."""
    rows = [(7, words(random.Random(1), 30), "a"), (3, "ab" * 120, "a"), (5, None, "a"), (5, "short", "a"), (None, "", "a"), (9, "é🎉" * 60, "a"), (9, "é🎉" * 60, "a")]
    df = frame(spark, rows).withColumn("run", F.lit("x")).withColumn("key", F.lit(1)).withColumn("fingerprint", F.lit(0))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = fingerprint.op1_winnowing(spark, str(tmp_path)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.n_chars), []).append(r)
    assert len(got) == len(rows)
    for (i, t, _), (_, nxt, _) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        edited = fingerprint.edited_text(t, nxt)
        sha = hashlib.sha256(edited.encode()).hexdigest()
        r = next(x for x in by[i, len(t)] if x.edited_sha256 == sha)
        hashes, at = decoded(r.fingerprint)
        codes = fingerprint.code_points(t)
        if len(codes) >= fingerprint.K:
            assert at == brute_winnow(codes, fingerprint.K, fingerprint.W)
        else:
            assert at == [0] * bool(t)
        a, b = set(hashes.tolist()), set(decoded(r.edited_fingerprint)[0].tolist())
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        c = set(fingerprint.winnow(fingerprint.code_points(nxt))[0].astype(np.uint32).tolist())
        assert r.near_next == pytest.approx(len(a & c) / len(a | c) if a | c else 1.0)
    frame(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert fingerprint.op1_winnowing(spark, f"{tmp_path}/none").count() == 0


def test_winnowing_of_a_text_in_pieces(monkeypatch):
    codes = fingerprint.code_points(words(random.Random(2), 300))
    whole = fingerprint.winnow(codes)
    monkeypatch.setattr(fingerprint, "PIECE", 100)
    cut = fingerprint.winnow(codes)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_near_duplicates_long_text_and_other_columns(spark):
    """A very long text with a near copy; columns named as the operator's own; several texts of one id."""
    rng = random.Random(5)
    long = words(rng, 60_000)
    rows = [(4, long, "a"), (9, long + " more words at the end", "b"), (2, words(rng, 50), "c"), (2, long, "c"), (11, "one", "d"), (12, "one", "d"), (13, "", "d"), (14, None, "d")]
    df = frame(spark, rows).withColumn("component_id", F.lit(0)).withColumn("n", F.lit("n")).withColumn("bucket", F.lit(1.0))
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.near_duplicates(df, 3, 85).collect()}
    n = {t: len(shingle_set(t, 3)) for _, t, _ in rows if t}
    assert got[4, n[long]] == (2, False) == got[9, n[rows[1][1]]] and got[2, n[long]] == (2, True) == got[2, n[rows[2][1]]]
    assert got[11, 1] == (11, True) and got[12, 1] == (11, False) and got[13, 0] == (13, True) and got[14, 0] == (14, True)
    kept = minhash.near_dedup_stage(spark, df, "")
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {2, 11, 13, 14}


def test_vectors_of_extreme_lengths(spark):
    """Doubles whose squares are no doubles any more are vectors like any other."""
    rows = [(1, [1e200, 2e200], 1), (2, [1.0, 2.0], 1), (3, [2e-200, 4e-200], 1), (4, [-1e300, 1e300], 1), (5, [5e-324, 0.0], 1), (6, [0.0, 0.0], 1), (7, [3e-320, 0.0], 1), (8, [1e-130, -1.001e-130], 1)]
    got = projections.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4), (5, 1, 5), (6, 0, 6), (7, 1, 5), (8, 0, 8)]


def test_vectors_corner_cases(spark):
    kind = "vec_id long, embedding array<double>, label string, code int, t int, links string"
    none = spark.createDataFrame([], kind)
    assert projections.near_vectors(none).count() == 0
    x = [1.0, 0.0, 0.5]
    rows = [(1, x, "a", 1, 2, "l"), (1, x, "a", 1, 2, "l"), (2, [2.0, 0.0, 1.0], "a", 1, 2, "l"), (3, x, "b", 1, 2, "l"), (4, x, None, 1, 2, "l"), (5, [0.0] * 3, "a", 1, 2, "l"), (6, [1.0, None, 0.0], "a", 1, 2, "l"), (7, [float("nan"), 0.0, 0.0], "a", 1, 2, "l"), (8, [1.0], "a", 1, 2, "l"), (None, x, "a", 1, 2, "l"), (9, None, "a", 1, 2, "l")]
    got = projections.near_vectors(spark.createDataFrame(rows, kind)).collect()
    assert got[0].asDict().keys() == {"vec_id", "n_links", "component_id", "kept"} and len(got) == len(rows)
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [
        (0, 0, 0, False), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True),
    ]


def test_urls_corner_cases(spark, monkeypatch):
    """Null urls and ids, no scheme, rules of equal length, an empty table, both kinds of join."""
    kind = "page_id long, url string, rule string, host int"
    urls = [None, "", "example.com/de/", "https://A.Example.NET/en/x?y#z", "http://net/", "http://www.org/fr/", "http://org/fr", "http://example.com/de/?q", "x://example.com", "http://sub.example.com/de/a"]
    rows = [(i if i != 4 else None, u, "r", 1) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, kind)
    found = []
    for most in (10_000, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", most)
        found.append(sorted(map(repr, map(tuple, url_filter.judge_urls(pages, url_filter.RULES).collect()))))
    assert found[0] == found[1] and len(found[0]) == len(urls)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.RULES).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[None] == ("net", "/", "net/", "block")
    assert got[5] == ("www.org", "/fr/", "org/fr/", "allow") and got[6] == ("org", "/fr", None, "allow")
    assert got[7][2:] == ("example.com/de/", "block") == got[9][2:] and got[8][2:] == (None, "allow")
    tied = [("allow", "example.com", "/a"), ("block", "example.com", "/a"), ("block", "com", "/a")]
    one = spark.createDataFrame([(1, "http://example.com/abc")], "page_id long, url string")
    assert url_filter.judge_urls(one, tied).first().verdict == "block"
    assert url_filter.judge_urls(pages.where("false"), url_filter.RULES).count() == 0
    assert url_filter.judge_urls(pages, []).where("verdict = 'allow' AND rule IS NULL").count() == len(urls)


@pytest.mark.skipif(not (DATA / "sf0.1").exists(), reason="no test data")
def test_classifiers_on_held_out_rows(spark):
    """Both queries over whole tables: every row scored, held out by the id's checksum, and
    what wasn't learned from told apart."""
    d = str(DATA / "sf0.1")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    for query, label, least, recall in ((quality.op3_quality, "quality", 0.97, 0.97), (toxicity.op9_toxicity, "toxic", 0.97, 0.8)):
        rows = query(spark, d).join(labels, "doc_id", "left").select("doc_id", "held_out", "score", "predicted", label).collect()
        assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
        assert all(r.predicted == int(r.score >= (0.7 if label == "quality" else 0.3)) for r in rows)
        from zlib import crc32

        assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
        tested = [(r.predicted, r[label]) for r in rows if r.held_out and r[label] is not None]
        assert np.mean([a == b for a, b in tested]) >= least
        assert np.mean([a for a, b in tested if b]) >= recall


def test_corpus_has_every_case():
    rows = corpus()
    assert any(t is None for _, t, _ in rows) and any(t == "" for _, t, _ in rows) and any(s is None for *_, s in rows)

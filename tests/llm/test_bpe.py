import base64

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mnemora.llm import bpe

TEXTS = ["", " ", "  ", "a", "a b", " a  b ", "a\n\nb", "x \n y", "It's we'll I'D 'sx ' s", "día ñandú über 北京 123 4५६", "<|endoftext|>a<|endoftext|><|endoftext|> b", "\x1c a\x1cb\u3000c\xa0 d\u2028e", "aaaa" * 500, "ab" * 3000, "🎉🎉 x", "\t\tif x:\r\n\treturn  1 ", "the " * 50]


@pytest.fixture(scope="module")
def ours():
    return bpe.RankFile(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def counts():
    return bpe.PrefixCounts(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encodes_as_tiktoken(ours, theirs):
    for t in TEXTS:
        assert ours.encode(t) == theirs.encode_ordinary(t), t
        assert ours.decode(ours.encode(t)) == t.encode()


def test_counts_as_tokenizers(counts, library):
    for t in TEXTS:
        assert counts.count(t) == len(library.encode(t, add_special_tokens=False).ids), t


ANY = st.text(st.one_of(st.sampled_from(" \n\tabestionTH'’.,19ñß北é"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=150, deadline=None)
@given(ANY)
def test_random_texts(ours, theirs, counts, library, t):
    assert ours.encode(t) == theirs.encode_ordinary(t)
    assert counts.count(t) == len(library.encode(t, add_special_tokens=False).ids)


def test_prefix_counts_match_encoding_each_prefix(counts):
    for piece in (b" thereheation", b"aaaaaaaaaaaa", "ñandúüß".encode(), b" tokenization"):
        assert counts.prefixes(piece) == [len(counts.bpe(piece[:i])) if i else 0 for i in range(len(piece) + 1)]


def test_queue_order():
    q = bpe.RankQueue()
    for rank, at in ((70000, 1), (3, 9), (3, 2), (255, 0), (256, 4)):
        q.push(rank, at)
    assert [q.pop() for _ in range(6)] == [(3, 2), (3, 9), (255, 0), (256, 4), (70000, 1), None]


def test_frames_null_empty_repeats(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x")], "doc_id long, text string, ids string")
    rows = {(r.doc_id, len(r.ids), bytes(r.decoded)) for r in bpe.encode_documents(docs).collect()}
    assert rows == {(1, 0, b""), (2, 0, b""), (3, 2, b"a b")}
    got = sorted(tuple(r) for r in bpe.count_tokens(docs).collect())
    assert got == [(1, 0, 0), (2, 0, 0), (3, 3, 2), (3, 3, 2)]
    assert bpe.count_tokens(docs.limit(0)).count() == 0


def test_profile_at_every_prefix(counts, library):
    """The stored counts are the library's for the text cut at each character."""
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for t in [*(x[:80] for x in TEXTS), "\n\n're x", "ing\n\n", "'ve\n\n", "x!<|endoftext|><|endoftext|> y", "a  \n\n b", "''re 'x"]:
        got = counts.profile(t)
        assert got == [count(t[:i]) for i in range(len(t) + 1)], t
        for budget in (0, 1, 3):
            assert counts.within(t, budget) == max(i for i, n in enumerate(got) if n <= budget)


@settings(max_examples=100, deadline=None)
@given(ANY)
def test_random_profiles(counts, library, t):
    assert counts.profile(t) == [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]


@pytest.mark.parametrize("size", [bpe.SHARED - 1, bpe.SHARED, bpe.SHARED + 1, 20_000])
def test_long_pre_tokens(ours, theirs, size):
    """Both ways of merging, by one queue for many pre-tokens and one queue each, agree."""
    for unit in ("ab", "the", "réêou", "xyzzy"):
        t = (unit * size)[:size]
        assert ours.encode(t) == theirs.encode_ordinary(t)


def test_queries(spark, tmp_path, theirs, library):
    """Both queries' rows against the libraries: nulls, repeats, special strings, a long text."""
    import hashlib

    texts = [*TEXTS, None, "a b", "a b", "word " * 30_000, "x" * 3000, "<|endoftext|>" * 3]
    rows = [(None if i == 3 else i // 2, t, "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    want6, want7 = [], []
    for i, t, _ in rows:
        t = t or ""
        ids, n = theirs.encode_ordinary(t), len(library.encode(t, add_special_tokens=False).ids)
        want6.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
        want7.append((i, len(t.encode()), n, n > 1024))
    assert sorted(map(tuple, bpe.op6_byte_bpe(spark, str(tmp_path)).collect()), key=repr) == sorted(want6, key=repr)
    assert sorted(map(tuple, bpe.op7_token_counts(spark, str(tmp_path)).collect()), key=repr) == sorted(want7, key=repr)
    encoded = bpe.encode_documents(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert sorted(bytes(r.decoded).decode() for r in encoded.collect()) == sorted(t or "" for t in texts)
    stored = {r.doc_id: r.counts for r in bpe.prefix_counts(spark.createDataFrame([(1, "it's  \n x"), (2, None)], "doc_id long, text string")).collect()}
    assert stored[2] == [0] and stored[1] == [len(library.encode("it's  \n x"[:i], add_special_tokens=False).ids) for i in range(10)]
    assert bpe.op6_byte_bpe(spark, _empty(spark, tmp_path)).count() == 0 == bpe.op7_token_counts(spark, _empty(spark, tmp_path)).count()


def _empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/none/documents.parquet")
    return f"{tmp_path}/none"


def test_vocabularies_do_not_mix(spark, tmp_path):
    """Another file in the same session, and the first one again, give each their own ids;
    a file without merges gives a token for each byte."""
    import base64

    import public_tokenizers
    import tiktoken

    from mnemora.llm import bpe

    whole = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    lines = [x for x in open(whole, "rb").read().splitlines() if x]
    texts = ["hello the world in 2024", "", None, "naïve über straße", "the the the"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    for most in (len(lines), 300, 256, len(lines)):
        path = tmp_path / f"{most}.tiktoken"
        path.write_bytes(b"\n".join(lines[:most]) + b"\n")
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines[:most])}
        library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        got = {r.doc_id: (r.ids, bytes(r.decoded)) for r in bpe.encode_documents(docs, str(path)).collect()}
        assert got == {i: (library.encode(t or "", disallowed_special=()), (t or "").encode()) for i, t in enumerate(texts)}
    kept = bpe.encode_documents(docs.withColumn("ids", docs.doc_id).withColumn("a.b", docs.doc_id), keep=["ids", "a.b"]).collect()
    assert all(tuple(r.kept) == (r.doc_id, r.doc_id) for r in kept)

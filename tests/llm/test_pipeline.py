import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_on_a_small_corpus(spark, tmp_path):
    from .test_operators import DOCS, brute_repeats, frame, words

    rng = random.Random(9)
    good = [(i, words(rng, 80), f"s{i % 3}") for i in range(120)]
    copies = [(200 + i, good[0][1], "s0") for i in range(30)]
    junk = [(300 + i, "%%% ### " * 60, "s1") for i in range(40)]
    frame(spark, good + copies + junk).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, *_ in good + copies] + [(i, 0, 0) for i, *_ in junk], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = seen[name] = spark.read.parquet(f"{tmp_path}/{i}")
        if name != "encode":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(seen["quality"]) == {i for i, *_ in good + copies}
    assert ids(seen["near_dedup"]) == {i for i, *_ in good}
    left = {r.doc_id: r.text for r in seen["repeats"].collect()}
    assert left == {i: v[4].decode() for i, v in brute_repeats(good).items()}
    assert seen["encode"].count() == seen["mixing"].count() > 0
    assert seen["encode"].where("n_tokens > 0").count() == seen["encode"].count()


def test_rows_without_id_reach_the_end(spark, tmp_path):
    from .test_operators import frame, words

    rng = random.Random(10)
    rows = [(i, words(rng, 80), f"s{i % 3}") for i in range(60)] + [(None, words(rng, 80), f"s{i % 3}") for i in range(30)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    without = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        without[name] = docs.where("doc_id IS NULL").count()
    assert without["repeats"] > 0 and without["encode"] == without["mixing"] > 0


def test_corner_cases_of_the_stages(spark, tmp_path):
    """Null texts and sources, empty texts, repeated rows, ties, columns that clash with the
    stages' own; an empty table. Every stage but the last keeps the columns."""
    from pyspark.sql import functions as F

    from .test_operators import frame, words

    rng = random.Random(12)
    rows = [(i, words(rng, 70), f"s{i % 2}" if i % 5 else None) for i in range(60)]
    rows += [rows[0], rows[0], (100, rows[1][1], "s1"), (101, rows[1][1] + " and", "s0"), (102, "", "s0"), (103, None, "s1"), (104, "one", None), (None, None, None), (None, words(rng, 70), None)]
    docs = frame(spark, rows).withColumn("uid", F.monotonically_increasing_id()).cache()
    clashing = ["key", "score", "predicted", "held_out", "n", "spans", "shard", "_text", "ids", "row", "kept", "sid", "a.b", "_", "th", "text2", "start", "size", "d", "g"]
    for k, c in enumerate(clashing):
        docs = docs.withColumn(c, F.col("uid") * 100 + k)
    spark.createDataFrame([(i, i % 2, 0) for i in range(0)] + [(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, now = {}, docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/c{i}")
        now = seen[name] = spark.read.parquet(f"{tmp_path}/c{i}")
        if name != "encode":
            assert now.columns == docs.columns
            odd = F.lit(False)
            for k, c in enumerate(clashing):
                odd = odd | ~F.col(f"`{c}`").eqNullSafe(F.col("uid") * 100 + k)
            assert now.where(odd | F.col("uid").isNull()).count() == 0
    ids = lambda df: sorted((r.doc_id if r.doc_id is not None else -1) for r in df.select("doc_id").collect())
    assert len(ids(seen["quality"])) == len(rows)  # one label only: all score alike, near it
    deduped = ids(seen["near_dedup"])
    assert 100 not in deduped and 101 not in deduped and deduped.count(0) == 3 and deduped.count(-1) == 2 and {102, 103, 104} <= set(deduped)
    assert ids(seen["repeats"]) == deduped
    mixed = set(ids(seen["mixing"]))
    assert not mixed & {102, 103} and -1 in mixed
    assert all(r.n_tokens == len(r.token_ids) > 0 for r in seen["encode"].collect())
    now = docs.where("false")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/e{i}")
        now = spark.read.parquet(f"{tmp_path}/e{i}")
        assert now.count() == 0

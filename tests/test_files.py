import gzip
import json
import os

import pytest

from pyspark.sql import functions as F

from mnemora.sources import files
from mnemora.streaming import log_stream


def write(path, lines, gz=False):
    with (gzip.open if gz else open)(path, "wt", encoding="utf-8") as f:
        f.write("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")


def test_journal_segments(spark, tmp_path):
    entry = lambda ts, op="edit", **k: {"ts": ts, "op": op, "actor": "a", "id": f"m{ts}", "scope": "s", **k}
    write(tmp_path / "journal-20240101.log.gz", [entry(1), entry(2, "link")], gz=True)
    write(tmp_path / "journal-20240102.log", [entry(3), entry(4, actor="b")])
    write(tmp_path / "journal-20240102.log.gz", [entry(3)], gz=True)  # a twin cut short
    write(tmp_path / "journal.log", [entry(5), '{"ts": 6, "op', entry(7, scope="other")])
    j = files.read_journal(spark, str(tmp_path))
    assert [r.ts for r in j.orderBy("seq").collect()] == [1, 2, 3, 4, 5, 7]
    pick = lambda **k: [r.ts for r in files.read_journal(spark, str(tmp_path), **k).orderBy("seq").collect()]
    assert pick(since=2, until=4) == [2, 3, 4] and pick(op="link") == [2] and pick(actor="b") == [4] and pick(scope="other") == [7]


def test_journal_days_and_retention(spark, tmp_path):
    path = str(tmp_path / "j")
    rows = spark.createDataFrame([(float(d * 86_400 + 5), "edit", f"m{d}") for d in range(10)], "ts double, op string, id string")
    files.write_journal(rows.where("ts < 400000"), path)
    files.write_journal(rows.where("ts >= 400000"), path)
    assert files.pruned_days(spark, path, 0, 10 * 86_400.0) == []
    assert files.pruned_days(spark, path, 3, 9 * 86_400.0 + 50) == ["19700101", "19700102", "19700103", "19700104", "19700105", "19700106"]
    assert spark.read.json(path).count() == 4


def test_archive_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("b", "text b", 2.0, [1.0, 2.0]), ("a", "text a", 1.0, None)], "id string, text string, created_at double, vector array<double>")
    path = str(tmp_path / "x.gz")
    assert files.write_archive(rows.withColumn("meta", F.lit("{}")), path, {"source": {"embedding_model": "m", "embedding_dim": 2}}) == 2
    got = files.read_archive(spark, path).orderBy("seq").collect()
    assert [(r.id, r.text, r.vector) for r in got] == [("a", "text a", None), ("b", "text b", [1.0, 2.0])]
    info = files.archive_info(spark, path, "m").first()
    assert (info.model, info.dim, info.rows, info.usable, info.same_model) == ("m", 2, 2, True, True)
    write(tmp_path / "new.gz", [{"format": files.FORMAT, "version": 99}], gz=True)
    write(tmp_path / "odd.gz", [{"format": "zip", "version": 1}], gz=True)
    assert [files.archive_info(spark, str(tmp_path / n)).first().usable for n in ("new.gz", "odd.gz")] == [False, False]


def test_trash_and_goldset(spark, tmp_path):
    entries = spark.createDataFrame([("m1", 5.0, "me", '{"id": "m1"}', "main"), ("m2", 6.0, "me", "{}", None)], files.TRASH)
    files.write_trash(entries, str(tmp_path / "t"))
    assert {(r.memory_id, r.collection) for r in files.read_trash(spark, str(tmp_path / "t")).collect()} == {("m1", "main"), ("m2", "")}
    write(tmp_path / "gold.jsonl", ["# note", "", {"query": "q", "relevant_ids": ["a", "b"], "k": 3}, {"query": "p", "relevant_ids": []}])
    got = {r["query"]: (r.relevant_ids, r.k) for r in files.read_goldset(spark, str(tmp_path / "gold.jsonl")).collect()}
    assert got == {"q": (["a", "b"], 3), "p": ([], None)}


def test_ingest(spark, tmp_path):
    write(tmp_path / "note.md", ["## Deploy", "", "Use the release target, not the other one.", "", "ok"])
    got = [(r.source, r.position, r.text) for r in files.ingest_files(spark, str(tmp_path)).collect()]
    assert got == [("ingest:note.md", 0, "## Deploy\nUse the release target, not the other one.")]


def test_streams(spark, tmp_path):
    """Batches of files, late entries, repeats, and a compaction that runs again."""
    src = tmp_path / "in"
    os.mkdir(src)
    entry = lambda ts, op, id_, **k: {"ts": ts, "op": op, "id": id_, "after": f"{id_}@{ts}", **k}
    write(src / "1.log", [entry(10, "remember", "a"), entry(20, "edit", "a"), entry(400, "remember", "b"), "broken"])

    def drain(frame, name, mode):
        frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    counts = {(r.window.start.timestamp(), r.op): r.calls for r in drain(log_stream.op_counts(log_stream.read_stream(spark, str(src))), "counts", "complete")}
    assert counts == {(0.0, "remember"): 1, (0.0, "edit"): 1, (300.0, "remember"): 1}
    hashed = log_stream.read_stream(spark, str(src)).withColumn("content_hash", F.col("id"))
    assert sorted(r.id for r in drain(log_stream.once_by_hash(hashed), "once", "append")) == ["a", "b"]
    for _ in range(2):
        log_stream.compact(log_stream.read_stream(spark, str(src)), str(tmp_path / "snap"), str(tmp_path / "check")).awaitTermination()
        write(src / "2.log", [entry(500, "forget", "a")])
    got = {(r.batch, r.id): (r.op, r.after) for r in spark.read.parquet(str(tmp_path / "snap")).collect()}
    assert got == {(0, "a"): ("edit", "a@20"), (0, "b"): ("remember", "b@400"), (1, "a"): ("forget", "a@500")}


def test_archives_that_may_be_opened(spark, tmp_path):
    """Vectors of another model, newer versions and other files are refused; texts can be embedded anew."""
    rows = spark.createDataFrame([("a", "x", 1.0, [1.0, 0.0])], "id string, text string, created_at double, vector array<double>").withColumn("meta", F.lit("{}"))
    path = lambda name: str(tmp_path / name)
    files.write_archive(rows, path("m.gz"), {"source": {"embedding_model": "m", "embedding_dim": 2}})
    files.write_archive(rows.drop("vector"), path("none.gz"), {"source": {"embedding_model": "m", "embedding_dim": 0}})
    files.write_archive(rows, path("new.gz"), {"version": 9})
    (tmp_path / "odd.gz").write_text('{"a": 1}\n')
    got, use = files.open_archive(spark, path("m.gz"), "m")
    assert got.count() == 1 and use
    with pytest.raises(ValueError, match="embed them anew"):
        files.open_archive(spark, path("m.gz"), "other")
    assert files.open_archive(spark, path("m.gz"), "other", regenerate=True)[1] is False
    assert files.open_archive(spark, path("none.gz"), "other")[1] is False
    for name in ("new.gz", "odd.gz", "missing.gz"):
        with pytest.raises(ValueError):
            files.open_archive(spark, path(name), "m")


def test_rotation_by_size(spark, tmp_path):
    """No segment above the bound, and every line read once, wherever a rotation stops."""
    from mnemora.sources.rotation import Log

    lines = [(i, f"line {i} " + "x" * (i * 7 % 50)) for i in range(200)]
    frame = lambda some: spark.createDataFrame(some, "seq long, value string").repartition(3)
    for stop in ("", "renamed", "written", "moved"):
        log, read = Log(spark, f"{tmp_path}/log{stop}"), lambda log: sorted(map(tuple, log.read().collect()))
        log.rotate(300)
        assert read(log) == [] and log.segments().count() == 0
        log.append(frame(lines[:120]))
        log.rotate(300, stop)
        assert read(log) == lines[:120]
        log.append(frame(lines[120:150]))
        assert read(log) == lines[:150]
        log.append(frame(lines[150:]))
        log.rotate(300)
        log.rotate(300)
        assert read(log) == lines
        parts = log.segments().orderBy("first_seq").collect()
        assert all(p.bytes <= 300 for p in parts) and sum(p.n for p in parts) == 200 and {p.rotation for p in parts} == {"000000001", "000000002"}
        assert all(a.last_seq < b.first_seq for a, b in zip(parts, parts[1:]))
        assert sorted(p.name for p in (tmp_path / f"log{stop}").iterdir()) == ["segments-000000001", "segments-000000002"]
    log.append(frame([(1, "y" * 200)]))
    with pytest.raises(ValueError, match="more than half"):
        log.rotate(300)


def test_rotation_makes_few_files_of_many_segments(spark, tmp_path):
    """As many files as tasks, whole segments in each; a folder a segment is read too."""
    import json

    from mnemora.sources.rotation import Log

    log = Log(spark, f"{tmp_path}/log")
    log.append(spark.range(3000).selectExpr("id AS seq", "concat('line ', id) AS value"))
    log.rotate(100)
    found = [(p, json.loads(x)["segment"]) for p in (tmp_path / "log").rglob("*.gz") for x in __import__("gzip").open(p, "rt")]
    segments = log.segments().collect()
    assert len(segments) == len({s for _, s in found}) == len(set(found)) > 300 and len({p for p, _ in found}) <= 4
    assert all(s.bytes <= 100 for s in segments) and sum(s.n for s in segments) == 3000
    old = tmp_path / "log" / "segments-000000002" / "segment=7"
    old.mkdir(parents=True)
    (old / "part.json").write_text('{"seq": 9000, "value": "older"}\n')
    assert [tuple(x) for x in log.segments().where("rotation = '000000002'").collect()] == [("000000002", 7, 1, 6, 9000, 9000)]
    assert log.read().count() == 3001

"""A store: memories, vectors, links and trash of a collection as versions on disk.

A change writes the tables that it changes to a new folder and then a manifest that
names the current ones, so that readers see all of a change or nothing, and one that
fails or is repeated leaves no trace. A recall only appends what it touched: the manifest
names such deltas beside the table, readers merge them in, and from time to time they are
merged with each other or into the table. Folders that none of the last KEEP manifests
names go. Changes are logged in the journal once they stand.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import archive, conflicts, curation, graph, lifecycle, log, maintenance, trash
from ..operators import recall as R
from ..operators import touches
from ..sources import files
from ..sources.embedders import Embedder, HashEmbedder, embedded

SCHEMAS = {
    "memories": lifecycle.ROW + ", vec_id string",
    "vectors": "vec_id string, x array<double>",
    "edges": "src string, dst string, rel string",
    "trash": "memory_id string, deleted_at double, actor string, collection string, memory struct<"
    + ", ".join(f"{n}:{k}" for n, k in (x.split(" ") for x in (lifecycle.ROW + ", vec_id string").split(", ")))
    + ">",
}
SCHEMAS["touches"] = touches.SCHEMA
MODES = ("semantic", "hybrid", "rrf")
#: Manifests whose folders are kept, for readers that are still under way.
KEEP = 20


class Unknown(KeyError):
    """An id or name that doesn't exist."""


class Store:
    """Commands over one collection at a path; safe to use from several threads."""

    def __init__(self, spark: SparkSession, path: str, collection: str = "main", embed: Embedder | None = None, actor: str = "", clock: Callable[[], float] = time.time):
        self.spark, self.path, self.collection, self.actor, self.clock = spark, path.rstrip("/"), collection, actor, clock
        self.embed = embed or HashEmbedder()
        self.lock = threading.RLock()
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- tables ------------------------------------------------------------------

    @property
    def scope(self) -> str:
        return hashlib.sha256(f"{self.path}\n{self.collection}".encode()).hexdigest()

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _manifests(self) -> list[int]:
        at = self._hadoop(f"{self.path}/{self.collection}/manifests")
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(at) if s.getPath().getName().endswith(".json")) if self._fs.exists(at) else []

    def _manifest(self) -> tuple[int, dict]:
        found = self._manifests()
        if not found:
            return 0, {}
        text = self.spark.read.text(f"{self.path}/{self.collection}/manifests/{found[-1]}.json", wholetext=True).first()[0]
        return found[-1], json.loads(text)

    def table(self, name: str) -> DataFrame:
        now = self._manifest()[1]
        path, deltas = now.get(name), now.get("touches", []) if name == "memories" else []
        rows = self.spark.read.schema(SCHEMAS[name]).parquet(path) if path else self.spark.createDataFrame([], SCHEMAS[name])
        return touches.merged(rows, self.spark.read.schema(touches.SCHEMA).parquet(*deltas)) if deltas else rows

    def _write(self, version: int, name: str, df: DataFrame) -> str:
        path = f"{self.path}/{self.collection}/data/{version}-{name}-{uuid.uuid4().hex[:8]}"
        columns = [x.split(" ")[0] for x in SCHEMAS[name].split(", ")] if name != "trash" else ["memory_id", "deleted_at", "actor", "collection", "memory"]
        df.select(*columns).write.parquet(path)
        return path

    def commit(self, op: str, entries: list[dict], **tables: DataFrame) -> None:
        """Writes the changed tables, then the manifest, then the journal. The tables must
        have been read under the lock; a new table of memories has all touches in it."""
        with self.lock:
            version, now = self._manifest()
            for name, df in tables.items():
                now[name] = self._write(version + 1, name, df)
            if "memories" in tables:
                now["touches"] = []
            self._publish(version + 1, now)
            stamp = self.clock()
            rows = [(stamp, op, self.actor, e.get("id", ""), e.get("before"), e.get("after"), json.dumps(e.get("meta", {})), self.scope) for e in entries]
            if rows:
                files.write_journal(self.spark.createDataFrame(rows, files.JOURNAL), f"{self.path}/journal")

    def _publish(self, version: int, now: dict) -> None:
        target = f"{self.path}/{self.collection}/manifests/{version}.json"
        out = self._fs.create(self._hadoop(target), False)  # fails if another writer was first
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        self._prune()

    def _prune(self) -> None:
        """Drops manifests beyond the last KEEP, and the folders that only they named."""
        found = self._manifests()
        if len(found) < 2 * KEEP:
            return
        named = set()
        for v in found[-KEEP:]:
            for path in json.loads(self.spark.read.text(f"{self.path}/{self.collection}/manifests/{v}.json", wholetext=True).first()[0]).values():
                named |= {p.rsplit("/", 1)[-1] for p in (path if isinstance(path, list) else [path])}
        for status in self._fs.listStatus(self._hadoop(f"{self.path}/{self.collection}/data")):
            name = status.getPath().getName()
            if name not in named and int(name.split("-")[0]) <= found[-KEEP]:  # newer ones may be being written
                self._fs.delete(status.getPath(), True)
        for v in found[:-KEEP]:
            self._fs.delete(self._hadoop(f"{self.path}/{self.collection}/manifests/{v}.json"), False)

    def touch(self, hits: DataFrame, now: float) -> None:
        """Appends a delta of ``hits(id)``: rows in proportion to them. Deltas are merged
        when there are many, and go into the table when they have grown to a share of it."""
        with self.lock:
            version, named = self._manifest()
            deltas = [*named.get("touches", []), self._write(version + 1, "touches", touches.delta(hits, now, version + 1))]
            if len(deltas) > touches.DELTAS:
                every = self.spark.read.schema(touches.SCHEMA).parquet(*deltas)
                one = self._write(version + 1, "touches", touches.summed(every))
                deltas = [one]
                if touches.due(self.spark.read.schema(touches.SCHEMA).parquet(one).count(), self.spark.read.schema(SCHEMAS["memories"]).parquet(named["memories"]).count()):
                    rows = self.spark.read.schema(SCHEMAS["memories"]).parquet(named["memories"])
                    named["memories"] = self._write(version + 1, "memories", touches.merged(rows, self.spark.read.schema(touches.SCHEMA).parquet(one)))
                    deltas = []
            self._publish(version + 1, named | {"touches": deltas})

    # --- reading -----------------------------------------------------------------

    def get(self, id_: str) -> dict:
        row = self.table("memories").where(F.col("id") == id_).first()
        if row is None:
            raise Unknown(id_)
        return row.asDict()

    def resolve(self, prefix: str) -> str:
        """The one id that begins so."""
        found = [r.id for r in self.table("memories").where(F.col("id").startswith(prefix)).select("id").orderBy("id").limit(2).collect()]
        if len(found) != 1:
            raise Unknown(f"{prefix}: {'no' if not found else 'several'} ids begin so")
        return found[0]

    def recent(self, limit: int = 50, before: float | None = None) -> list[dict]:
        if limit < 0:
            raise ValueError("limit must not be negative")
        rows = self.table("memories").where(R.live(self.clock()))
        rows = rows if before is None else rows.where(F.col("created_at") < before)
        return [r.asDict() for r in rows.orderBy(F.desc("created_at"), "id").limit(limit).collect()]

    def recall(self, queries: list[str], k: int = 5, mode: str = "hybrid", overfetch: int = 4, touch: bool = True, **fine) -> list[dict]:
        """The k best of each query: query, id, text, score, rank."""
        S.check_choice(mode, MODES, "mode")
        if k <= 0 or not queries:
            return []
        now, rows = self.clock(), self.table("memories")
        q = self.spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(queries, self.embed(queries)))], "qid long, qtext string, qx array<double>")
        pool = R.vector_pool(rows, self.table("vectors"), q, k * overfetch)
        w = R.Weights()
        if mode == "semantic":
            scored = pool.join(rows, "id").withColumn("score", F.col("cosine") + w.polarity * F.col("polarity"))
        else:
            seen = R.signals(pool, rows, q, now, w).where("superseded_by = ''")
            scored = R.weighted(seen, w) if mode == "hybrid" else R.reciprocal_ranks(seen, w)
        best = R.top(scored.where(R.eligible(now, **fine)), k).select("qid", "id", "text", "score", "rank").orderBy("qid", "rank").collect()
        if touch and best:
            self.touch(self.spark.createDataFrame([(r.id,) for r in best], "id string"), now)
        return [{"query": queries[r.qid], "id": r.id, "text": r.text, "score": r.score, "rank": r["rank"]} for r in best]

    def stats(self) -> dict:
        rows = self.table("memories").where(R.live(self.clock(), superseded=True))
        r = rows.agg(F.count("*").alias("total"), F.count_if(F.col("superseded_by") == "").alias("active"), *(F.count_if(F.col("type") == t).alias(t) for t in S.TYPES)).first()
        return r.asDict()

    def neighbors(self, id_: str, depth: int = 1, direction: str = "both") -> list[dict]:
        seed = self.spark.createDataFrame([(id_,)], "seed string")
        return [r.asDict() for r in graph.neighbors(seed, self.table("edges"), self.table("memories"), depth, direction).orderBy("depth", "id", "rel").collect()]

    def path_between(self, start: str, end: str) -> list[tuple[str, str]]:
        return graph.find_path(self.table("edges"), self.table("memories"), start, end)

    def conflicts(self, threshold: float = 0.8) -> list[dict]:
        rows = self.table("memories").where("superseded_by = ''").join(self.table("vectors"), "vec_id")
        rows = rows.withColumn("vec_id", F.xxhash64("vec_id"))  # pairs are of numbers
        return [r.asDict() for r in conflicts.conflicts(rows, threshold).orderBy("a", "b").collect()]

    def journal(self, limit: int = 20, **given) -> list[dict]:
        at = self._hadoop(f"{self.path}/journal")
        if limit <= 0 or not self._fs.exists(at):
            return []
        rows = files.read_journal(self.spark, f"{self.path}/journal/*", scope=self.scope, **given)
        return [r.asDict() for r in rows.orderBy(F.desc("ts"), F.desc("seq")).drop("seq").limit(limit).collect()]

    def readiness(self) -> dict:
        return maintenance.readiness(self.table("memories"), self.embed)

    # --- changing ------------------------------------------------------------------

    def remember(self, items: list[dict], policy: str = "ignore", idempotent: bool = False) -> list[str]:
        """The ids that the items are stored as, in their order."""
        if not items:
            return []
        unknown = {k for x in items for k in x} - set(lifecycle.ITEM) - {"text"}
        if unknown or not all(str(x.get("text") or "").strip() for x in items):
            raise ValueError(f"an item needs a text; unknown fields: {', '.join(sorted(unknown)) or 'none'}")
        kinds = {"polarity": "int", "pinned": "boolean", "tags": "array<string>"} | dict.fromkeys(("importance", "expires_at", "ttl_seconds", "valid_from", "valid_until"), "double")
        names = sorted({k for x in items for k in x})
        defaults = {"polarity": 0, "pinned": False, "type": "semantic", "trust": "trusted", "tags": []}
        value = lambda x, k: float(x[k]) if kinds.get(k) == "double" and x.get(k) is not None else x.get(k, defaults.get(k))
        frame = self.spark.createDataFrame([(i, *(value(x, k) for k in names)) for i, x in enumerate(items)], "pos long, " + ", ".join(f"{k} {kinds.get(k, 'string')}" for k in names))
        bad = [r.problem for r in lifecycle.problem(frame).where("problem IS NOT NULL").select("problem").collect()]
        if bad:
            raise ValueError(f"bad items: {', '.join(bad)}")
        with self.lock:
            now, rows, vectors = self.clock(), self.table("memories"), self.table("vectors")
            built = lifecycle.build(frame, now)
            mapping, added = lifecycle.remember_many(rows, built, now, idempotent)
            kept = [(r.kept_as, r.touched) for r in mapping.orderBy("pos").collect()]
            added = added.withColumn("vec_id", F.col("id"))
            new = embedded(added, self.embed).withColumnRenamed("id", "vec_id")
            stored, refused, _, links = lifecycle.remember(rows, vectors, added, new, now, policy)
            gone = {r.id for r in refused.collect()}
            if gone:
                raise ValueError(f"{len(gone)} items clash with what is stored")
            touched = self.spark.createDataFrame([(i,) for i, t in kept if t], "id string")
            fresh = [r.id for r in added.select("id").collect()]
            edges = {"edges": self.table("edges").unionByName(links).distinct()} if policy == "supersede" else {}
            self.commit("remember", [{"id": i} for i in fresh], memories=lifecycle.touch(stored, touched, now), vectors=vectors.unionByName(new), **edges)
        return [i for i, _ in kept]

    def _need(self, *ids: str) -> None:
        found = {r.id for r in self.table("memories").where(F.col("id").isin(*ids)).select("id").collect()}
        if missing := set(ids) - found:
            raise Unknown(", ".join(sorted(missing)))

    def edit(self, id_: str, **given) -> dict:
        """Changes fields of lifecycle.EDITS; None leaves one alone, and clear_source empties
        the source. What is bad is refused whole; what changes nothing isn't logged."""
        kinds = {f"new_{c}": k for c, k in lifecycle.EDITS.items()} | {"clear_source": "boolean"}
        named = {c if c == "clear_source" else f"new_{c}": float(v) if kinds.get(f"new_{c}") == "double" and v is not None else v for c, v in given.items()}
        if unknown := set(named) - set(kinds):
            raise ValueError(f"unknown fields: {', '.join(sorted(c.removeprefix('new_') for c in unknown))}")
        with self.lock:
            before = self.get(id_)
            change = self.spark.createDataFrame([(id_, *named.values())], ", ".join(["id string", *(f"{c} {kinds[c]}" for c in named)]))
            rows, verdicts = lifecycle.edit(self.table("memories"), change)
            verdict = verdicts.first().verdict
            if verdict.startswith("bad"):
                raise ValueError(verdict)
            if verdict == "changed":
                changed, text = {}, (given.get("text") or before["text"]).strip()
                if text != before["text"]:
                    vectors = self.table("vectors").where(F.col("vec_id") != before["vec_id"])
                    changed["vectors"] = vectors.unionByName(self.spark.createDataFrame([(before["vec_id"], self.embed([text])[0])], SCHEMAS["vectors"]))
                self.commit("edit", [{"id": id_, "before": before["text"], "after": text}], memories=rows, **changed)
            return self.get(id_)

    def forget(self, id_: str) -> None:
        with self.lock:
            before = self.get(id_)
            ids = self.spark.createDataFrame([(id_,)], "id string")
            self.commit("forget", [{"id": id_, "before": before["text"]}], memories=lifecycle.forget(self.table("memories"), ids))

    def trash(self, id_: str) -> None:
        with self.lock:
            self._need(id_)
            ids = self.spark.createDataFrame([(id_,)], "id string")
            rows, entries = trash.trash(self.table("memories"), ids, self.clock(), self.actor, self.collection)
            self.commit("forget", [{"id": id_, "meta": {"to": "trash"}}], memories=rows, trash=self.table("trash").unionByName(entries))

    def untrash(self, id_: str) -> None:
        with self.lock:
            ids, entries, rows = self.spark.createDataFrame([(id_,)], "id string"), self.table("trash"), self.table("memories")
            if trash.restorable(entries, rows, self.collection).where(F.col("memory_id") == id_).isEmpty():
                raise Unknown(id_)
            back, rest = trash.restore(entries, rows, ids, self.collection)
            self.commit("restore", [{"id": id_, "meta": {"from": "trash"}}], memories=back, trash=rest)

    def supersede(self, old: str, new: str) -> None:
        with self.lock:
            self._need(old, new)
            pairs = self.spark.createDataFrame([(old, new)], "old string, new string")
            rows, edges = lifecycle.supersede(self.table("memories"), self.table("edges"), pairs, self.clock())
            self.commit("supersede", [{"id": old, "meta": {"new_id": new}}], memories=rows, edges=edges)

    def restore(self, id_: str) -> None:
        with self.lock:
            self._need(id_)
            rows, edges = lifecycle.restore(self.table("memories"), self.table("edges"), self.spark.createDataFrame([(id_,)], "id string"))
            self.commit("restore", [{"id": id_}], memories=rows, edges=edges)

    def link(self, src: str, dst: str, rel: str = "related") -> None:
        S.check_choice(rel, lifecycle.RELS, "rel")
        if src == dst:
            raise ValueError("a row can't be linked to itself")
        with self.lock:
            self._need(src, dst)
            wanted = self.spark.createDataFrame([(src, dst, rel)], SCHEMAS["edges"])
            edges = lifecycle.link(self.table("edges"), wanted, self.table("memories"))
            self.commit("link", [{"id": src, "meta": {"dst_id": dst, "rel": rel}}], edges=edges)

    def unlink(self, src: str, dst: str, rel: str | None = None) -> None:
        with self.lock:
            gone = self.spark.createDataFrame([(src, dst, rel)], SCHEMAS["edges"])
            self.commit("unlink", [{"id": src, "meta": {"dst_id": dst, "rel": rel}}], edges=lifecycle.unlink(self.table("edges"), gone))

    def merge(self, target: str, other: str) -> dict:
        with self.lock:
            self._need(target, other)
            pairs = self.spark.createDataFrame([(target, other)], "target string, other string")
            rows, edges = curation.merge(self.table("memories"), self.table("edges"), pairs)
            self.commit("edit", [{"id": target, "meta": {"merged_from": other}}], memories=rows, edges=edges)
            return self.get(target)

    def history(self, id_: str) -> list[dict]:
        at = self._hadoop(f"{self.path}/journal")
        if not self._fs.exists(at):
            return []
        rows = files.read_journal(self.spark, f"{self.path}/journal/*", scope=self.scope)
        for name in ("dst_id", "new_id"):
            rows = rows.withColumn(name, F.get_json_object("meta", f"$.{name}"))
        return [r.asDict() for r in log.history(rows, id_).orderBy("ts", "seq").drop("seq").collect()]

    def _last_runs(self) -> dict[str, float]:
        """When each job of upkeep last ran, of the whole journal."""
        if not self._fs.exists(self._hadoop(f"{self.path}/journal")):
            return {}
        rows = files.read_journal(self.spark, f"{self.path}/journal/*", scope=self.scope).where(F.col("op").startswith("tick "))
        return {r.op[5:]: r.ts for r in rows.groupBy("op").agg(F.max("ts").alias("ts")).collect()}

    def tick(self) -> dict:
        """Upkeep that is due, as far as the journal tells when it last ran."""
        with self.lock:
            last = self._last_runs()
            done = maintenance.tick(self.table("memories"), self.table("trash"), maintenance.State(last=last), self.clock(), None, self.collection)
            for job in set(done.ran) & {"decay", "purge"}:
                self.commit(f"tick {job}", [{"meta": {"n": done.ran[job]}}], memories=done.rows, trash=done.entries)
            return {"ran": done.ran, "errors": done.errors}

    def export(self, path: str, **given) -> int:
        rows = archive.exported(self.table("memories"), **given).join(self.table("vectors").withColumnRenamed("x", "vector"), "vec_id", "left")
        rows = rows.withColumn("meta", F.to_json(F.struct(*[c for c in self.table("memories").columns if c not in ("id", "text")])))
        return files.write_archive(rows, path, {"exported_at": self.clock(), "source": {"collection": self.collection, "embedding_dim": len(self.embed([""])[0])}})

    def backup(self, path: str) -> None:
        """Copies the store's folder, which must not be there yet."""
        util = self.spark._jvm.org.apache.hadoop.fs.FileUtil
        conf = self.spark._jsc.hadoopConfiguration()
        if self._fs.exists(self._hadoop(path)) or not util.copy(self._fs, self._hadoop(self.path), self._hadoop(path).getFileSystem(conf), self._hadoop(path), False, conf):
            raise ValueError(f"can't copy to {path}")

    def render(self, form: str = "dot") -> str:
        """The links as Graphviz source, JSON, or plain lines."""
        S.check_choice(form, ("dot", "json", "text"), "form")
        edges = [(r.src, r.dst, r.rel) for r in self.table("edges").orderBy("src", "dst", "rel").collect()]
        if form == "json":
            return json.dumps([{"src": a, "dst": b, "rel": r} for a, b, r in edges])
        if form == "text":
            return "\n".join(f"{a} -{r}-> {b}" for a, b, r in edges)
        return "\n".join(["digraph {", *(f"  {json.dumps(a)} -> {json.dumps(b)} [label={json.dumps(r)}];" for a, b, r in edges), "}"])

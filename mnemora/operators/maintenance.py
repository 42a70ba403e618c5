"""Scheduled upkeep, health checks, and repair of vectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.embedders import Embedder, embedded, probe
from . import lifecycle, trash
from . import recall as R

#: Seconds between runs of each job, and days that trash is kept.
DECAY_EVERY, REFLECT_EVERY, PURGE_EVERY, TRASH_DAYS = 86_400, 7 * 86_400, 86_400, 30


def decay_scores(rows: DataFrame, now: float, rate: float = 0.1, frequency: float = 0.0) -> DataFrame:
    """Rows that haven't expired, with score."""
    score = S.decay(F.col("importance"), F.col("last_accessed"), F.col("access_count"), now, rate, frequency)
    return rows.where(R.live(now, superseded=True)).withColumn("score", score)


def prunable(rows: DataFrame, now: float, least: float = 0.05, protect: tuple[str, ...] = ("procedural",)) -> DataFrame:
    """Rows whose score has fallen below ``least``, but for protected types and pins."""
    return decay_scores(rows, now).where((F.col("score") < least) & ~F.col("type").isin(*protect) & ~F.col("pinned")).drop("score")


def expired(rows: DataFrame, now: float) -> DataFrame:
    return rows.where((F.col("expires_at") > 0) & (F.col("expires_at") <= now))


def next_run_at(last: Column, every: int, now: float) -> Column:
    """When a job is due; one that never ran has been due for a second."""
    return F.when(last.isNull(), F.lit(now - 1)).otherwise(last + every)


@dataclass(frozen=True)
class State:
    """When each job last ran, and totals."""

    last: dict[str, float] = field(default_factory=dict)
    totals: dict[str, int] = field(default_factory=dict)


@dataclass
class Tick:
    rows: DataFrame
    entries: DataFrame
    state: State
    ran: dict[str, int]
    errors: dict[str, str]


def tick(
    rows: DataFrame,
    entries: DataFrame,
    state: State,
    now: float,
    reflect: Callable[[DataFrame], tuple[DataFrame, int]] | None = None,
    collection: str = "",
    every: dict[str, int | None] | None = None,
    trash_days: float = TRASH_DAYS,
) -> Tick:
    """Decay, reflection and purge, each if it is due; one that fails doesn't stop the rest.

    ``rows`` and the trash's ``entries`` are the state before; ``reflect`` maps rows to
    rows and the number of summaries. Pruned rows go to the trash, expired ones go.
    ``every`` changes intervals; None switches a job off.
    """
    due = {"decay": DECAY_EVERY, "reflect": REFLECT_EVERY, "purge": PURGE_EVERY} | (every or {})
    out = Tick(rows, entries, state, {}, {})

    def decay() -> int:
        gone = prunable(out.rows, now).select("id")
        n = gone.count()
        out.rows, new = trash.trash(out.rows, gone, now, "decay", collection)
        out.entries = out.entries.unionByName(new.select(*out.entries.columns))
        return n

    def reflecting() -> int:
        out.rows, n = reflect(out.rows)
        return n

    def purge() -> int:
        gone = expired(out.rows, now).select("id")
        n = gone.count()
        out.rows = lifecycle.forget(out.rows, gone)
        kept = trash.purge_expired(out.entries, collection, trash_days, now)
        out.ran["trash"] = out.entries.count() - kept.count()
        out.entries = kept
        return n

    last, totals = dict(state.last), dict(state.totals)
    for name, job in (("decay", decay), ("reflect", reflecting if reflect else None), ("purge", purge)):
        if job is None or due[name] is None or now < (now - 1 if name not in last else last[name] + due[name]):
            continue
        try:
            out.ran[name] = job()
            last[name] = now
            totals[name] = totals.get(name, 0) + out.ran[name]
        except Exception as e:  # noqa: BLE001 - jobs are isolated from each other
            out.errors[name] = str(e)
    out.state = replace(state, last=last, totals=totals)
    return out


def without_vector(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    return rows.join(vectors.where("x IS NOT NULL").select("vec_id"), "vec_id", "left_anti")


def rebuilt_vectors(rows: DataFrame, embed: Embedder) -> DataFrame:
    """id, x of all rows anew from their texts, as after a change of model."""
    return embedded(rows, embed)


def doctor(rows: DataFrame, vectors: DataFrame, edges: DataFrame) -> DataFrame:
    """check, bad, ok: rows without vectors, vectors of another length than most, links
    to rows that don't exist, rows superseded by none, stale hashes, bad tags, validity."""
    lengths = vectors.where("x IS NOT NULL").groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"))
    most = lengths.agg(F.max_by("dim", F.struct("n", "dim")).alias("dim"))
    ids = rows.select("id")
    counts = {
        "missing_vectors": without_vector(rows, vectors),
        "odd_dimensions": vectors.where("x IS NOT NULL").join(F.broadcast(most), F.size("x") != F.col("dim")),
        "dangling_links": edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti"),
        "lost_superseders": rows.where("superseded_by <> ''").join(ids.withColumnRenamed("id", "superseded_by"), "superseded_by", "left_anti"),
        "stale_hashes": rows.where(F.col("content_hash") != S.content_hash(F.col("text"))),
        "bad_tags": rows.where(~S.tags_ok(F.col("tags"))),
        "bad_validity": rows.where(~S.validity_ok(F.col("valid_from"), F.col("valid_until"))),
    }
    out = None
    for name, bad in counts.items():
        one = bad.agg(F.lit(name).alias("check"), F.count("*").alias("bad")).withColumn("ok", F.col("bad") == 0)
        out = one if out is None else out.unionByName(one)
    return out


def readiness(rows: DataFrame, embed: Embedder) -> dict:
    """Whether rows can be read and the embedder answers."""
    try:
        store = {"ok": True, "count": rows.count()}
    except Exception as e:  # noqa: BLE001
        store = {"ok": False, "error": f"{type(e).__name__}: {e}"}
    checks = {"store": store, "embedder": probe(embed)}
    return {"ready": all(c["ok"] for c in checks.values()), "checks": checks}

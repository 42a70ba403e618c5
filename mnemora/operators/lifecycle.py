"""Mutations as functions from a snapshot to its next state.

Nothing is updated in place: each takes the rows or edges as they are and the
requested changes, and returns the rows or edges that result.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import scalars as S
from ..scratch import Scratch
from . import conflicts as C
from . import recall as R

RELS = ("related", "refines", "derived_from", "example_of", "contradicts", "supersedes")
POLICIES = ("ignore", "warn", "supersede", "raise")

#: Columns that a new row may be given, with what stands in for a missing one.
ITEM = {
    "type": "'semantic'",
    "tags": "array()",
    "importance": "CAST(NULL AS DOUBLE)",
    "source": "CAST(NULL AS STRING)",
    "polarity": "0",
    "expires_at": "CAST(NULL AS DOUBLE)",
    "ttl_seconds": "CAST(NULL AS DOUBLE)",
    "pinned": "false",
    "trust": "'trusted'",
    "valid_from": "CAST(NULL AS DOUBLE)",
    "valid_until": "CAST(NULL AS DOUBLE)",
}
ROW = (
    "id string, text string, type string, tags array<string>, importance double, created_at double, last_accessed double, access_count bigint, source string, polarity int, "
    "pinned boolean, superseded_by string, superseded_at double, expires_at double, trust string, valid_from double, valid_until double, content_hash string"
)


def _given(items: DataFrame) -> DataFrame:
    for name, default in ITEM.items():
        if name not in items.columns:
            items = items.withColumn(name, F.expr(default))
    return items.withColumn("tags", F.coalesce(F.col("tags").cast("array<string>"), F.array().cast("array<string>")))


def problem(items: DataFrame) -> DataFrame:
    """``items`` with all columns of ITEM and problem: why an item can't be stored, or null."""
    start, end = F.coalesce("valid_from", F.lit(0.0)), F.coalesce("valid_until", F.lit(0.0))
    checks = [
        (~F.col("type").isin(*S.TYPES), "type"),
        (~F.col("trust").isin(*S.TRUST), "trust"),
        (~F.col("polarity").isin(-1, 0, 1), "polarity"),
        (F.col("expires_at").isNotNull() & F.col("ttl_seconds").isNotNull(), "both expires_at and ttl_seconds"),
        (F.col("ttl_seconds") <= 0, "ttl_seconds"),
        (F.col("expires_at") < 0, "expires_at"),
        ((start < 0) | (end < 0) | ((start != 0) & (end != 0) & (end <= start)), "validity"),
        (~S.tags_ok(F.col("tags")), "tags"),
    ]
    found = F.lit(None).cast("string")
    for bad, name in reversed(checks):
        found = F.when(F.coalesce(bad, F.lit(False)), name).otherwise(found)
    return _given(items).withColumn("problem", found)


def build(items: DataFrame, now: float, importance: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """Rows, and pos, of ``items(pos, text, ...)``; a bad item fails the whole batch.

    Ids are hashes of pos, text and time, so that a task that runs again gives the same
    ones. Texts are stripped, importance is kept in 0..1; a missing one is what
    ``importance(text, type, tags)`` says, or 0.5. A vec_id is kept.
    """
    ok = problem(items)
    text = F.trim("text")
    text = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("bad item: "), F.col("problem"))).cast("string")).otherwise(text)
    ok = ok.withColumn("text", text)
    scored = F.lit(0.5) if importance is None else importance(F.col("text"), F.col("type"), F.col("tags"))
    fresh = {
        "id": F.substring(F.sha2(F.concat_ws("\u0001", F.col("pos").cast("string"), "text", F.lit(str(now))), 256), 1, 32),
        "importance": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("importance").cast("double"), scored))),
        "created_at": F.lit(now),
        "last_accessed": F.lit(now),
        "access_count": F.lit(0).cast("bigint"),
        "superseded_by": F.lit(""),
        "superseded_at": F.lit(0.0),
        "expires_at": F.coalesce("expires_at", F.lit(now) + F.col("ttl_seconds"), F.lit(0.0)),
        "valid_from": F.coalesce("valid_from", F.lit(0.0)),
        "valid_until": F.coalesce("valid_until", F.lit(0.0)),
        "content_hash": S.content_hash(F.col("text")),
    }
    names = [x.split()[0] for x in ROW.split(", ")]
    kinds = dict(x.split() for x in ROW.split(", "))
    known = [c for c in ("vec_id",) if c in items.columns]
    return ok.select("pos", *[fresh.get(c, F.col(c)).cast(kinds[c]).alias(c) for c in names], *known)


def remember_many(rows: DataFrame, fresh: DataFrame, now: float, idempotent: bool = False) -> tuple[DataFrame, DataFrame]:
    """(mapping, added): for each built row (pos, ...) the id it is stored as, and what
    is new. With ``idempotent`` a text that a live row has already, or an earlier row of
    the batch, adds nothing; mapping says whether it met a stored row (touched)."""
    if not idempotent:
        return fresh.select("pos", F.col("id").alias("kept_as"), F.lit(False).alias("touched")), fresh
    live = rows.where(R.live(now)).groupBy("content_hash").agg(F.min("id").alias("old"))
    first = F.min_by("id", "pos").over(Window.partitionBy("content_hash"))
    met = fresh.withColumn("first", first).join(live, "content_hash", "left")
    mapping = met.select("pos", F.coalesce("old", "first").alias("kept_as"), F.col("old").isNotNull().alias("touched"))
    added = met.where("old IS NULL AND id = first").select(*fresh.columns)
    return mapping, added


def remember(
    rows: DataFrame,
    vectors: DataFrame,
    fresh: DataFrame,
    fresh_vectors: DataFrame,
    now: float,
    policy: str = "ignore",
    threshold: float = 0.8,
    contradicts: C.PairRule | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, refused, conflicts, links) after built rows are stored under a conflict policy.

    ``raise`` refuses those that clash with what is stored; ``supersede`` marks the
    stored rows they clash with, by the first new one if several do, and ``links`` has the
    new links that say so; ``warn`` and ``ignore`` store all. New rows are judged against stored ones, not each other.
    ``fresh_vectors(vec_id, x)`` are the new rows' vectors; ``fresh`` has vec_id.
    """
    S.check_choice(policy, POLICIES, "policy")
    columns = [c for c in rows.columns if c in fresh.columns]
    none = rows.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("similarity"), F.lit("").alias("kind")).where("false")
    links = none.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("kind").alias("rel"))
    if policy == "ignore":
        return rows.select(*columns).unionByName(fresh.select(*columns)), none.select(F.col("a").alias("id")), none, links
    # The scan matches on vectors, so it doesn't need the new rows to be stored.
    clashes = C.conflicts_for(fresh, rows, vectors.select("vec_id", "x").unionByName(fresh_vectors.select("vec_id", "x")), now, threshold, contradicts)
    refused = clashes.select(F.col("a").alias("id")).distinct() if policy == "raise" else none.select(F.col("a").alias("id"))
    stored = rows.select(*columns).unionByName(fresh.join(refused, "id", "left_anti").select(*columns))
    if policy == "supersede":
        first = clashes.join(fresh.select(F.col("id").alias("a"), "pos"), "a").groupBy(F.col("b").alias("old")).agg(F.min_by("a", "pos").alias("new"))
        stored, links = supersede(stored, links, first, now)
    return stored, refused, clashes, links


def link(edges: DataFrame, wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Edges with those of ``wanted`` added once; loops and missing ends are refused."""
    ends = known.select("id")
    new = wanted.where((F.col("src") != F.col("dst")) & F.col("rel").isin(*RELS))
    for end in ("src", "dst"):
        new = new.join(ends.withColumnRenamed("id", end), end, "left_semi")
    return edges.select("src", "dst", "rel").union(new.select("src", "dst", "rel")).distinct()


def unlink(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those of ``gone``; a null rel takes all between two rows."""
    some = edges.join(gone.where("rel IS NOT NULL"), ["src", "dst", "rel"], "left_anti")
    return some.join(gone.where("rel IS NULL").select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "rel")


#: What an edit may change, and the columns of a change that say so.
EDITS = {
    "text": "string", "type": "string", "tags": "array<string>", "importance": "double", "polarity": "int", "expires_at": "double", "source": "string",
    "pinned": "boolean", "trust": "string", "valid_from": "double", "valid_until": "double",
}


def edit(rows: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, verdicts) after ``changes(id, new_text, new_type, ...)``, of any of EDITS.

    A null or missing column leaves a field alone; ``clear_source`` (boolean) empties the
    source. Texts are stripped and rehashed, importance is kept in 0..1, and the validity
    that results is checked as a pair. ``verdicts(id, verdict)`` has a row for each row
    named: ``changed``, ``same`` where nothing differs, ``unknown``, or ``bad`` and the
    field, and then nothing of the row changes. Of several changes of a row, the one with
    the greatest pos counts, or where there is none the least.
    """
    given = changes.select("id", *[F.col(f"new_{c}").cast(kind).alias(f"new_{c}") if f"new_{c}" in changes.columns else F.lit(None).cast(kind).alias(f"new_{c}") for c, kind in EDITS.items()],
                           F.coalesce("clear_source", F.lit(False)).alias("clear_source") if "clear_source" in changes.columns else F.lit(False).alias("clear_source"),
                           F.col("pos") if "pos" in changes.columns else F.lit(0).alias("pos"))
    fields = F.struct(*[c for c in given.columns if c != "id"])
    one = F.max_by(fields, "pos") if "pos" in changes.columns else F.min(fields)
    met = rows.join(given.groupBy("id").agg(one.alias("_to")), "id", "left")
    to = lambda c: F.col(f"_to.new_{c}")
    own = {c: F.coalesce(to(c), F.col(c)) for c in EDITS if c in rows.columns}
    own["text"] = F.coalesce(F.trim(to("text")), F.col("text"))
    own["importance"] = F.when(to("importance").isNull(), F.col("importance")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), to("importance"))))
    if "source" in own:
        own["source"] = F.when(F.coalesce(F.col("_to.clear_source"), F.lit(False)), F.lit(None).cast("string")).otherwise(own["source"])
    checks = [
        (F.trim(to("text")) == "", "text"),
        (to("type").isNotNull() & ~S.choice_ok(to("type"), S.TYPES), "type"),
        (to("polarity").isNotNull() & ~to("polarity").isin(-1, 0, 1), "polarity"),
        (to("expires_at") < 0, "expires_at"),
        (to("trust").isNotNull() & ~S.choice_ok(to("trust"), S.TRUST), "trust"),
        (~S.tags_ok(to("tags")), "tags"),
    ]
    if "valid_from" in own:
        touched = to("valid_from").isNotNull() | to("valid_until").isNotNull()
        checks.append((touched & ~S.validity_ok(own["valid_from"], own["valid_until"]), "validity"))
    bad = F.lit(None).cast("string")
    for cond, name in reversed(checks):
        bad = F.when(F.coalesce(cond, F.lit(False)), name).otherwise(bad)
    fine = F.col("_to").isNotNull() & bad.isNull()
    differs = F.lit(False)
    for c, value in own.items():
        differs = differs | ~value.eqNullSafe(F.col(c))
    verdict = F.when(bad.isNotNull(), F.concat(F.lit("bad "), bad)).when(differs, "changed").otherwise("same")
    known = met.where("_to IS NOT NULL").select("id", verdict.alias("verdict"))
    lost = changes.select("id").distinct().join(rows.select("id"), "id", "left_anti").select("id", F.lit("unknown").alias("verdict"))
    if "content_hash" in rows.columns:
        own["content_hash"] = F.when(own["text"].eqNullSafe(F.col("text")), F.col("content_hash")).otherwise(S.content_hash(own["text"]))
    out = met.select(*[F.when(fine, own[c]).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in rows.columns])
    return out, known.unionByName(lost)


def touch(rows: DataFrame, hits: DataFrame, now: float) -> DataFrame:
    """Rows with a count more for each time ``hits(id)`` has them, accessed now."""
    n = hits.groupBy("id").agg(F.count("*").alias("_n"))
    met = rows.join(n, "id", "left")
    met = met.withColumn("access_count", F.col("access_count") + F.coalesce("_n", F.lit(0)))
    return met.withColumn("last_accessed", F.when(F.col("_n").isNotNull(), F.lit(now)).otherwise(F.col("last_accessed"))).drop("_n")


def forget(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id"), "id", "left_anti")


def nuke(rows: DataFrame, confirm: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, entry): no rows, and the one log entry (op, removed), if confirmed."""
    if not confirm:
        raise ValueError("nuke needs confirm=True")
    return rows.where("false"), rows.agg(F.lit("nuke").alias("op"), F.count("*").alias("removed"))


def on_loops(steps: DataFrame, scratch: Scratch) -> DataFrame:
    """id of the rows of ``steps(id, next)``, one a row, from which steps come back to them.

    Pointers jump twice as far in each round, so rounds are as many as the longest chain's
    length has bits; those that haven't come to an end by then point into loops.
    """
    far = steps.select("id", "next", F.lit(True).alias("moved"))
    for _ in range(max(1, steps.count()).bit_length() + 1):
        more = far.select(F.col("id").alias("next"), F.col("next").alias("after"))
        far = scratch.keep(far.join(more, "next", "left").select("id", F.coalesce("after", "next").alias("next"), F.col("after").isNotNull().alias("moved")))
        if far.where("moved").isEmpty():
            break
    return far.where("moved").select(F.col("next").alias("id")).distinct()


def _ahead(pairs: DataFrame, marked: DataFrame, scratch: Scratch) -> DataFrame:
    """id of all rows ahead of ``marked(id)`` along ``pairs(old, new)``, which have no loops;
    the rounds are as many as the longest chain's length has bits."""
    jumps, found = pairs.select("old", "new"), marked.select("id")
    while True:
        reached = jumps.join(found.select(F.col("id").alias("old")), "old").select(F.col("new").alias("id"))
        found = scratch.keep(found.unionByName(reached).distinct())
        further = jumps.select(F.col("old").alias("new"), F.col("new").alias("then"))
        jumps = scratch.keep(jumps.join(further, "new").select("old", F.col("then").alias("new")))
        if jumps.isEmpty():
            return found.join(pairs.select(F.col("new").alias("id")).distinct(), "id", "left_semi")


def supersede(rows: DataFrame, edges: DataFrame, pairs: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """(rows, edges) after ``pairs(old, new)``: old rows are marked, and links ``supersedes``
    lead to them. Pins follow: whatever comes after a pinned row in a chain of the batch is
    pinned too, and the old rows keep theirs, so that ``restore`` can hand them back.

    A row has one successor: of several pairs of an old row the one with the greatest pos
    counts, or without a pos the one with the smallest new row. Pairs with themselves, of
    rows that don't exist, that are marked so already, or that would close a loop, through
    the batch or through older marks, change nothing.
    """
    scratch = Scratch(rows.sparkSession)
    one = F.max_by("new", "pos") if "pos" in pairs.columns else F.min("new")
    known = rows.select(F.col("id").alias("old"), F.col("superseded_by").alias("by"))
    # Written down, as the join would else go into each part of a union, and one task hold the sorts of all.
    pairs = scratch.keep(pairs.where("old <> new"))
    wanted = pairs.join(rows.select(F.col("id").alias("new")), "new", "left_semi")
    wanted = wanted.groupBy("old").agg(one.alias("new")).join(known, "old").where("NOT new <=> by").select("old", "new")
    wanted = scratch.keep(wanted)
    marks = rows.where("superseded_by <> ''").select("id", F.col("superseded_by").alias("next"))
    steps = marks.join(wanted.select(F.col("old").alias("id")), "id", "left_anti").unionByName(wanted.select(F.col("old").alias("id"), F.col("new").alias("next")))
    # Only chains that go on from a pair's new row can come back to its old one.
    if not wanted.join(steps.select(F.col("id").alias("new")), "new", "left_semi").isEmpty():
        wanted = scratch.keep(wanted.join(on_loops(scratch.keep(steps), scratch).select(F.col("id").alias("old")), "old", "left_anti"))
    out = rows.join(wanted.select(F.col("old").alias("id"), F.col("new").alias("_new")), "id", "left")
    marked = F.col("_new").isNotNull()
    own = {
        "superseded_by": F.coalesce("_new", "superseded_by"),
        "superseded_at": F.when(marked, F.lit(now)).otherwise(F.col("superseded_at") if "superseded_at" in rows.columns else F.lit(0.0)),
    }
    if "pinned" in rows.columns:
        pinned = rows.where("pinned").select("id").join(wanted.select(F.col("old").alias("id")), "id", "left_semi")
        out = out.join(_ahead(wanted, pinned, scratch).select("id", F.lit(True).alias("_pin")), "id", "left")
        own["pinned"] = F.col("pinned") | F.coalesce("_pin", F.lit(False))
    names = [*rows.columns, *([] if "superseded_at" in rows.columns else ["superseded_at"])]
    new = wanted.select(F.col("new").alias("src"), F.col("old").alias("dst"), F.lit("supersedes").alias("rel"))
    return out.select(*[own[c].alias(c) if c in own else F.col(c) for c in names]), edges.select("src", "dst", "rel").unionByName(new).distinct()


def restore(rows: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, edges) where the rows of ``ids`` are no longer superseded: marks and their
    times are cleared, the links ``supersedes`` to them go, and a pin that a row shares with
    its successor is taken from the successor. Pins are judged as they were before; rows
    that aren't superseded, unknown ids and repeats do nothing."""
    pin = F.col("pinned") if "pinned" in rows.columns else F.lit(False)
    back = rows.where("superseded_by <> ''").join(ids.select("id").distinct(), "id", "left_semi").select("id", F.col("superseded_by").alias("by"), pin.alias("pin"))
    handed = back.where("pin").select(F.col("by").alias("id"), F.lit(True).alias("_unpin")).distinct()
    met = rows.join(back.select("id", F.lit(True).alias("_back")), "id", "left").join(handed, "id", "left")
    own = {"superseded_by": F.when(F.col("_back"), "").otherwise(F.col("superseded_by"))}
    if "superseded_at" in rows.columns:
        own["superseded_at"] = F.when(F.col("_back"), 0.0).otherwise(F.col("superseded_at"))
    if "pinned" in rows.columns:
        own["pinned"] = F.col("pinned") & F.col("_unpin").isNull()
    gone = back.select(F.col("by").alias("src"), F.col("id").alias("dst"), F.lit("supersedes").alias("rel"))
    left = edges.join(gone, ["src", "dst", "rel"], "left_anti").select("src", "dst", "rel")
    return met.select(*[own[c].alias(c) if c in own else F.col(c) for c in rows.columns]), left


# --- reflection --------------------------------------------------------------------


#: Characters of an extractive summary, and members that can have a part in it at most:
#: each takes at least the three of a separator.
SUMMARY, IN_SUMMARY = 512, 172


def extractive_summaries(members: DataFrame) -> DataFrame:
    """leader, summary: ``[Reflection ×n] a | b``, the most important first, SUMMARY
    characters at most, of ``members(leader, importance, pos, text)``. Each task keeps only
    what can have a part, cut to what fits, so that a cluster's texts never meet."""
    order = F.row_number().over(Window.partitionBy("leader").orderBy(F.desc("importance"), "pos"))
    cut = F.substring(F.coalesce("text", F.lit("")), 1, SUMMARY).alias("text")
    best = members.select("leader", "importance", "pos", cut).withColumn("r", order).where(F.col("r") <= IN_SUMMARY)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), " | ")
    met = best.groupBy("leader").agg(joined.alias("body")).join(members.groupBy("leader").agg(F.count("*").alias("n")), "leader")
    return met.select("leader", F.substring(F.concat(F.lit("[Reflection ×"), F.col("n").cast("string"), F.lit("] "), F.col("body")), 1, SUMMARY).alias("summary"))


def reflections(clusters: DataFrame, rows: DataFrame, consolidate: bool = False, summarizer: Callable[[list[dict]], str] | None = None) -> DataFrame:
    """leader, text, importance, pinned, trust, tags, level: one summary per cluster.

    Importance is the members' mean, trust their worst; the level is one above their
    highest; tags are reflection, the level, and the members' in the cluster's order
    but for their levels. A pin passes on only where the sources make way
    (``consolidate``). ``summarizer`` gets a cluster's members as dictionaries; where it
    fails, the extractive summary stands.
    """
    met = clusters.select("id", "leader", "pos").join(rows, "id")
    got = met.groupBy("leader").agg(
        F.round(F.avg("importance"), 3).alias("importance"),
        F.bool_or("pinned").alias("pinned"),
        S.trust_label(F.max(S.trust_rank(F.col("trust")))).alias("trust"),
        (F.max(S.level_of(F.col("tags"))) + 1).alias("level"),
    )
    each = met.select("leader", "pos", F.posexplode("tags").alias("at", "tag")).where("NOT startswith(tag, 'level:')")
    each = each.groupBy("leader", "tag").agg(F.min(F.struct("pos", "at")).alias("first"))
    inherited = F.transform(F.sort_array(F.collect_list(F.struct("first", "tag"))), lambda x: x["tag"])
    got = got.join(each.groupBy("leader").agg(inherited.alias("inherited")), "leader", "left").join(extractive_summaries(met.select("leader", "importance", "pos", "text")), "leader")
    own = F.array(F.lit("reflection"), F.concat(F.lit("level:"), F.col("level").cast("string")))
    tags = F.array_distinct(F.concat(own, F.coalesce("inherited", F.array().cast("array<string>"))))
    out = got.select("leader", F.col("summary").alias("text"), "importance", (F.lit(consolidate) & F.col("pinned")).alias("pinned"), "trust", tags.alias("tags"), "level")
    if summarizer is None:
        return out
    # A function of the user's own sees whole clusters, and so they must be of a size for it.
    member = F.struct("importance", "pos", "text", "id", "tags", "type")
    out = out.join(met.groupBy("leader").agg(F.collect_list(member).alias("members")), "leader")

    def rewrite(batches):
        for pdf in batches:
            texts = []
            for text, members in zip(pdf.text, pdf.members):
                try:
                    texts.append(summarizer([m.asDict() if hasattr(m, "asDict") else dict(m) for m in members]) or text)
                except Exception:  # noqa: BLE001 - a summarizer may be remote; its failure costs only its wording
                    texts.append(text)
            yield pdf.assign(text=texts).drop(columns=["members"])

    return out.mapInPandas(rewrite, out.drop("members").schema)


def consolidated(rows: DataFrame, edges: DataFrame, clusters: DataFrame, summaries: DataFrame, mode: str, now: float) -> tuple[DataFrame, DataFrame]:
    """(rows, edges) once summaries stand beside their sources (``keep``), supersede them
    with links derived_from beside supersedes (``soft``), or replace them (``hard``). A
    summary's id is ``r`` and its leader's."""
    S.check_choice(mode, ("keep", "soft", "hard"), "mode")
    new_id = F.concat(F.lit("r"), F.col("leader"))
    made = {
        "id": new_id,
        "type": F.lit("semantic"),
        "created_at": F.lit(now),
        "last_accessed": F.lit(now),
        "access_count": F.lit(0).cast("bigint"),
        "source": F.lit("reflection"),
        "polarity": F.lit(0),
        "superseded_by": F.lit(""),
        "superseded_at": F.lit(0.0),
        "expires_at": F.lit(0.0),
        "valid_from": F.lit(0.0),
        "valid_until": F.lit(0.0),
        "content_hash": S.content_hash(F.col("text")),
    }
    columns = [c for c in rows.columns if c in made or c in summaries.columns]
    kinds = dict(rows.dtypes)
    new = summaries.select(*[made.get(c, F.col(c)).cast(kinds[c]).alias(c) for c in columns])
    if mode == "hard":
        return forget(rows, clusters).select(*columns).unionByName(new), edges
    if mode == "keep":
        return rows.select(*columns).unionByName(new), edges
    stored, links = supersede(rows.select(*columns).unionByName(new), edges, clusters.select(F.col("id").alias("old"), new_id.alias("new")), now)
    return stored.select(*columns), links.unionByName(clusters.select(new_id.alias("src"), F.col("id").alias("dst"), F.lit("derived_from").alias("rel")))


# --- hooks -------------------------------------------------------------------------


def rescored(rows: DataFrame, score: Column | Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """A reranker hook: adds rescored, first_rank and new_rank to a pool.

    ``score`` is a Column over the pool's columns, or a function that gets one query's
    pool as a frame and returns as many scores.
    """
    first = Window.partitionBy("qid").orderBy("pool_pos")
    then = Window.partitionBy("qid").orderBy(F.desc("rescored"), "pool_pos")
    if isinstance(score, Column):
        rows = rows.withColumn("rescored", score)
    else:

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            scores = list(score(pdf))
            if len(scores) != len(pdf):
                raise ValueError(f"the reranker gave {len(scores)} scores for {len(pdf)} rows")
            return pdf.assign(rescored=[float(s) for s in scores])

        schema = StructType([*rows.schema.fields, StructField("rescored", DoubleType())])
        rows = rows.groupBy("qid").applyInPandas(run, schema)
    return rows.withColumn("first_rank", F.row_number().over(first)).withColumn("new_rank", F.row_number().over(then))

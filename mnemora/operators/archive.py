"""Archives and collections: what goes out, what comes in, and under which names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..scratch import Scratch

IMPORT_POLICIES = ("skip", "overwrite", "rename", "error")


def exported(rows: DataFrame, types: list[str] | None = None, tags: list[str] | None = None, since: float | None = None, superseded: bool = False) -> DataFrame:
    """The rows an archive holds: of the types, with any of the tags, from ``since`` on."""
    if not superseded:
        rows = rows.where("superseded_by = ''")
    if types is not None:
        rows = rows.where(F.col("type").isin(*types))
    if tags is not None:
        rows = rows.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    return rows if since is None else rows.where(F.col("created_at") >= since)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with line: their place, from 1, in the order of the whole.

    Rows are sorted by range into partitions, whose counts say where each begins; so no
    task sorts more than its range.
    """
    parts = rows.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    parts = Scratch(rows.sparkSession).keep(parts)  # sampled ranges may differ in another run
    counts = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    starts = counts.select("_p", F.coalesce(before, F.lit(0)).alias("_start"))
    return parts.join(F.broadcast(starts), "_p").withColumn("line", F.col("_start") + F.col("_i") + 1).drop("_p", "_i", "_start")


def import_actions(incoming: DataFrame, store: DataFrame, policy: str) -> DataFrame:
    """id, action of archive rows under a collision policy: add, skip, replace, rename.

    ``error`` fails on an id that is there, or that comes twice.
    """
    S.check_choice(policy, IMPORT_POLICIES, "policy")
    met = incoming.join(store.select("id", F.lit(True).alias("there")), "id", "left")
    if policy == "error":
        twice = F.count("*").over(Window.partitionBy("id")) > 1
        met = met.withColumn("there", F.col("there") | F.when(twice, True))
    stop = F.raise_error(F.concat(F.lit("already there: "), F.col("id"))).cast("string")
    clash = {"skip": F.lit("skip"), "overwrite": F.lit("replace"), "rename": F.lit("rename"), "error": stop}[policy]
    return met.select("id", F.when(F.col("there"), clash).otherwise(F.lit("add")).alias("action"))


def new_id(id_: str, archive: str, *more):
    """The id of a renamed row: the same whenever the same archive is read."""
    return F.concat(F.lit("n"), F.substring(F.sha2(F.concat_ws("/", F.lit(archive), F.col(id_), *more), 256), 1, 31))


def refuse_collisions(incoming: DataFrame, store: DataFrame, shown: int = 10) -> None:
    """The pre-scan of the policy ``error``: fails with the first ids that are there already
    or come twice, before anything is built."""
    twice = incoming.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("comes twice").alias("why"))
    there = incoming.select("id").distinct().join(store.select("id"), "id", "left_semi").select("id", F.lit("already there").alias("why"))
    bad = there.unionByName(twice)
    if first := bad.orderBy("id", "why").limit(shown).collect():
        raise ValueError(f"{bad.select('id').distinct().count()} collisions, among them " + ", ".join(f"{r.id}: {r.why}" for r in first))


def imported(incoming: DataFrame, links: DataFrame, store: DataFrame, edges: DataFrame, policy: str, archive: str = "", dry_run: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, edges, summary) after an import; a dry run changes neither.

    ``links(src, dst, rel)`` are the archive's. Renamed rows get new ids, and what the
    archive's rows point at, links and superseded_by, follows them. ``summary`` counts
    rows by action. Of rows of one id in the archive, in the order of seq if it is there,
    the first counts under ``skip`` and the last under ``overwrite``; under ``rename`` the
    others get ids of their own, and references follow the first. ``error`` fails at once.
    """
    if S.check_choice(policy, IMPORT_POLICIES, "policy") == "error":
        refuse_collisions(incoming, store)
    order = F.col("seq") if "seq" in incoming.columns else F.xxhash64(*[F.col(c) for c in store.columns if c in incoming.columns])
    per = Window.partitionBy("id")
    # Written down, as equal rows may be numbered otherwise when asked again.
    come = incoming.withColumn("_nth", F.row_number().over(per.orderBy(order))).withColumn("_of", F.count("*").over(per))
    come = come.join(store.select("id", F.lit(True).alias("_there")), "id", "left").withColumn("_there", F.coalesce("_there", F.lit(False)))
    later = F.col("_nth") > 1
    action = {
        "skip": F.when(F.col("_there") | later, "skip"),
        "overwrite": F.when(F.col("_there") | later, "replace"),
        "rename": F.when(F.col("_there") | later, "rename"),
        "error": F.when(F.lit(False), ""),
    }[policy]
    come = Scratch(store.sparkSession).keep(come.withColumn("_action", F.coalesce(action, F.lit("add"))))
    summary = come.groupBy(F.col("_action").alias("action")).agg(F.count("*").alias("n"))
    if dry_run:
        return store, edges, summary
    go = come.where("_action <> 'skip'") if policy != "overwrite" else come.where("_nth = _of")
    to = F.when(F.col("_action") == "rename", F.when(later, new_id("id", f"{archive}#", F.col("_nth").cast("string"))).otherwise(new_id("id", archive)))
    names = go.where("_nth = 1 AND _action = 'rename'").select("id", new_id("id", archive).alias("to"))
    met = go.withColumn("_to", to).join(names.select(F.col("id").alias("superseded_by"), F.col("to").alias("_by")), "superseded_by", "left")
    own = {"id": F.coalesce("_to", "id"), "superseded_by": F.coalesce("_by", "superseded_by")}
    new = met.select(*[own[c].alias(c) if c in own else F.col(c) for c in store.columns])
    rows = store.join(new.select("id"), "id", "left_anti").unionByName(new)
    theirs = remapped(links.join(go.select(F.col("id").alias("src")).distinct(), "src", "left_semi"), names)
    kept = edges.join(new.select(F.col("id").alias("src")), "src", "left_anti").select("src", "dst", "rel")
    return rows, kept.unionByName(theirs).distinct(), summary


def remapped(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges whose ends in ``names(id, to)`` are called otherwise."""
    met = edges.join(names.select(F.col("id").alias("src"), F.col("to").alias("s")), "src", "left")
    met = met.join(names.select(F.col("id").alias("dst"), F.col("to").alias("d")), "dst", "left")
    return met.select(F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst"), "rel")


# --- collections: rows with a column ``collection``, names in ``collections(name)`` ----


def listed(rows: DataFrame, collections: DataFrame, active: str) -> DataFrame:
    """name, n, active of every collection, empty ones too."""
    n = rows.groupBy(F.col("collection").alias("name")).agg(F.count("*").alias("n"))
    return collections.join(n, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"), (F.col("name") == active).alias("active"))


def created(collections: DataFrame, name: str) -> DataFrame:
    if not collections.where(F.col("name") == name).isEmpty():
        raise ValueError(f"collection {name!r} exists")
    return collections.unionByName(collections.sparkSession.createDataFrame([(name,)], "name string"))


def deleted(rows: DataFrame, collections: DataFrame, name: str, active: str) -> tuple[DataFrame, DataFrame]:
    """(rows, collections) without one, which must exist and not be the active one."""
    if name == active:
        raise ValueError("the active collection can't be deleted")
    if collections.where(F.col("name") == name).isEmpty():
        raise ValueError(f"no collection {name!r}")
    return rows.where(F.col("collection") != name), collections.where(F.col("name") != name)


def copied(rows: DataFrame, source: str, target: str) -> DataFrame:
    """Rows with those of ``source`` in ``target`` too, in place of rows of the same id."""
    if source == target:
        raise ValueError("a collection can't be copied onto itself")
    new = rows.where(F.col("collection") == source).withColumn("collection", F.lit(target))
    clash = new.select("id", "collection")
    return rows.join(clash, ["id", "collection"], "left_anti").select(*rows.columns).unionByName(new)

"""Tags, merges of rows, and rewrites of what points at them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..scratch import Scratch
from .lifecycle import on_loops


def rename_tags(rows: DataFrame, old: list[str], new: str) -> DataFrame:
    """Rows that have an old tag, with the new one in its place, first place kept."""
    S.check_tag(new)
    fresh = F.array_distinct(F.transform("tags", lambda x: F.when(x.isin(old), new).otherwise(x)))
    return rows.where(F.arrays_overlap("tags", F.array(*[F.lit(x) for x in old]))).withColumn("tags", fresh)


def repoint(edges: DataFrame, old: str, new: str) -> DataFrame:
    """Edges into ``old`` lead to ``new``; loops and repeats that arise are dropped."""
    return edges.withColumn("dst", F.when(F.col("dst") == old, new).otherwise(F.col("dst"))).where("src <> dst").distinct()


def _jumped(steps: DataFrame, scratch: Scratch) -> DataFrame:
    """id, next, far of ``steps(id, next, far)``, whose chains end in a null: pointers to the
    ends and sums of far along them, in as many rounds as the longest chain has bits."""
    while True:
        ahead = steps.select(F.col("id").alias("next"), F.col("next").alias("then"), F.col("far").alias("more"))
        met = steps.join(ahead, "next", "left")
        steps = scratch.keep(met.select("id", F.col("then").alias("next"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far")))
        if steps.where("next IS NOT NULL").isEmpty():
            return steps


def taken_in(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """target, other, nth: which row each other of ``pairs(target, other, pos)`` ends in, and
    at which place among all that end there: right after what took it in, before what that
    takes in later. An other occurs once, and pairs have no loops.

    Rows are a list in that order: after a row comes the first that it takes in, else the
    next one taken in by the nearest row above that takes in more. Both are found by
    pointers that jump ever farther, and so are the places in the list.
    """
    per = Window.partitionBy("target").orderBy("pos", "other")
    kids = scratch.keep(pairs.withColumn("sibling", F.lead("other").over(per)).withColumn("first", F.row_number().over(per) == 1))
    roots = kids.select(F.col("target").alias("id")).distinct().join(kids.select(F.col("other").alias("id")), "id", "left_anti")
    # Up to the nearest row with a sibling: such rows and roots are where the search ends.
    up = kids.select(F.col("other").alias("id"), F.when(F.col("sibling").isNull(), F.col("target")).alias("up"), "sibling")
    ends = up.where("sibling IS NOT NULL").select("id", "sibling")
    far = up.select("id", F.col("up").alias("next"))
    while True:
        ahead = far.select(F.col("id").alias("next"), F.col("next").alias("then"), F.lit(True).alias("known"))
        met = far.join(ahead, "next", "left")
        moves = F.col("known") & F.col("then").isNotNull()
        far = scratch.keep(met.select("id", F.when(moves, F.col("then")).otherwise(F.col("next")).alias("next"), F.coalesce(moves, F.lit(False)).alias("moved")))
        if far.where("moved").isEmpty():
            break
        far = far.select("id", "next")
    above = far.select("id", F.coalesce("next", "id").alias("at")).join(ends.select(F.col("id").alias("at"), "sibling"), "at", "left").select("id", "sibling")
    first = kids.where("first").select(F.col("target").alias("id"), F.col("other").alias("child"))
    nodes = above.unionByName(roots.withColumn("sibling", F.lit(None).cast("string")))
    steps = nodes.join(first, "id", "left").select("id", F.coalesce("child", "sibling").alias("next"))
    places = _jumped(scratch.keep(steps.withColumn("far", F.lit(1).cast("long"))), scratch)
    tops = _tops(kids, scratch)
    whole = places.join(roots, "id").select(F.col("id").alias("target"), F.col("far").alias("all"))
    return tops.join(whole, "target").join(places.select(F.col("id").alias("other"), "far"), "other").select("target", "other", (F.col("all") - F.col("far")).alias("nth"))


def _tops(kids: DataFrame, scratch: Scratch) -> DataFrame:
    """target, other: the row at the top of each other's chain."""
    far = kids.select(F.col("other").alias("id"), F.col("target").alias("next"))
    while True:
        ahead = far.select(F.col("id").alias("next"), F.col("next").alias("then"))
        far = scratch.keep(far.join(ahead, "next", "left").select("id", F.coalesce("then", "next").alias("next"), F.col("then").isNotNull().alias("moved")))
        if far.where("moved").isEmpty():
            return far.select(F.col("next").alias("target"), F.col("id").alias("other"))
        far = far.select("id", "next")


def merge(rows: DataFrame, edges: DataFrame, pairs: DataFrame, separator: str = "\n\n") -> tuple[DataFrame, DataFrame]:
    """(rows, edges) after each row ``pairs(target, other)`` names took in the other.

    Texts are joined and hashed anew, the worse trust counts, and a pin of either. What
    the other pointed at moves along unless it doesn't exist; what pointed at the other
    points at the target; loops and repeats that arise are dropped. The other goes.

    Pairs may share rows: a row that takes in several does so in the order of pos, if
    there is one, then of their ids, and what it has taken in goes along when it is taken in
    itself, as if the pairs were merged one by one, the innermost first. A row is taken
    in once, by the pair with the least (pos, target). Pairs with themselves, with a missing
    row, or on a loop are refused.
    """
    scratch = Scratch(rows.sparkSession)
    ids = rows.select("id")
    pos = F.col("pos") if "pos" in pairs.columns else F.lit(0).alias("pos")
    fine = pairs.select("target", "other", pos).where("target <> other").join(ids.select(F.col("id").alias("target")), "target", "left_semi")
    fine = fine.join(ids.select(F.col("id").alias("other")), "other", "left_semi")
    fine = scratch.keep(fine.groupBy("other").agg(F.min(F.struct("pos", "target")).alias("by")).select("by.target", "other", "by.pos"))
    shared = fine.join(fine.select(F.col("other").alias("target")), "target", "left_semi")
    if not shared.isEmpty():
        looped = on_loops(scratch.keep(fine.select(F.col("other").alias("id"), F.col("target").alias("next"))), scratch)
        fine = scratch.keep(fine.join(looped.select(F.col("id").alias("other")), "other", "left_anti"))
        fine = scratch.keep(taken_in(fine, scratch))
    else:
        place = F.row_number().over(Window.partitionBy("target").orderBy("pos", "other"))
        fine = fine.select("target", "other", place.cast("long").alias("nth"))
    taken = fine.join(rows.select(F.col("id").alias("other"), F.col("text").alias("t2"), F.col("trust").alias("r2"), F.col("pinned").alias("p2")), "other")
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", F.coalesce("t2", F.lit("")).alias("t2")))), lambda x: x["t2"]), separator)
    taken = taken.groupBy(F.col("target").alias("id")).agg(line.alias("t2"), F.max(S.trust_rank(F.col("r2"))).alias("r2"), F.bool_or("p2").alias("p2"))
    met = rows.join(taken, "id", "left").join(fine.select(F.col("other").alias("id")), "id", "left_anti")
    both = F.col("t2").isNotNull()
    text = F.when(both, F.concat("text", F.lit(separator), "t2")).otherwise(F.col("text"))
    changed = {
        "text": text,
        "trust": F.when(both, S.trust_label(F.greatest(S.trust_rank(F.col("trust")), F.col("r2")))).otherwise(F.col("trust")),
        "pinned": F.col("pinned") | F.coalesce("p2", F.lit(False)),
        "content_hash": S.content_hash(text),
    }
    out = met.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in rows.columns])
    moved = edges.join(fine.select(F.col("other").alias("src"), F.col("target").alias("s2")), "src", "left")
    moved = moved.join(fine.select(F.col("other").alias("dst"), F.col("target").alias("d2")), "dst", "left")
    moved = moved.join(ids.select(F.col("id").alias("dst"), F.lit(True).alias("there")), "dst", "left")
    moved = moved.where(F.col("s2").isNull() | F.col("there"))
    moved = moved.select(F.coalesce("s2", "src").alias("src"), F.coalesce("d2", "dst").alias("dst"), "rel", (F.col("s2").isNotNull() | F.col("d2").isNotNull()).alias("changed"))
    return out, moved.where("NOT changed OR src <> dst").select("src", "dst", "rel").distinct()

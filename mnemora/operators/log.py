"""The append-only log: summaries, history, replay, undo; and measures over results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..scratch import Scratch
from . import lifecycle

SNAPSHOTS = ("remember", "edit", "import", "restore", "supersede")
#: Samples that percentiles are taken of, the last ones of each group.
SAMPLES = 1024
#: Columns that reading changes, and that undo doesn't compare.
VOLATILE = ("last_accessed", "access_count")


def latencies(rows: DataFrame, group: str, value: str, seq: str, samples: int = SAMPLES) -> DataFrame:
    """n, avg, max over all, nearest-rank percentiles over the last ``samples`` per group.

    Ranks are rounded half to even. The last ones are found by a limited window, which
    Spark cuts in each task before the shuffle, so that a group's rows don't meet.
    """
    whole = rows.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(value), 3).alias("avg"), F.round(F.max(value), 3).alias("max"))
    last = rows.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(seq)))).where(F.col("r") <= samples)
    sorted_ = last.groupBy(group).agg(F.sort_array(F.collect_list(value)).alias("v"))
    at = lambda p: F.round(F.get("v", F.bround(F.lit(p) * (F.size("v") - 1), 0).cast("int")), 3)
    return whole.join(sorted_.select(group, at(0.50).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99")), group)


def summaries(journal: DataFrame) -> DataFrame:
    link = F.concat(F.col("op"), F.lit(" "), F.col("id"), F.lit(" -"), F.col("rel"), F.lit("-> "), F.col("dst_id"))
    return journal.select("seq", F.when(F.col("op").isin("link", "unlink"), link).otherwise(F.concat_ws(" ", "op", "id")).alias("line"))


def history(journal: DataFrame, id_: str) -> DataFrame:
    """Entries about a row: its own, links to it, and those that name it as the newer row."""
    hit = F.col("id") == id_
    for other in ("dst_id", "new_id", "superseder_id"):
        if other in journal.columns:
            hit = hit | F.coalesce(F.col(other) == id_, F.lit(False))
    return journal.where(hit)


def resolve_prefix(journal: DataFrame, prefix: str) -> DataFrame:
    """matches, outcome, id: the ids that begin so, of rows that may be long deleted."""
    ids = None
    for c in ("id", "dst_id", "new_id", "superseder_id"):
        if c in journal.columns:
            one = journal.select(F.col(c).alias("id"))
            ids = one if ids is None else ids.union(one)
    n = F.count("*")
    outcome = F.when(n == 0, "none").when(n == 1, "unique").otherwise("ambiguous").alias("outcome")
    return ids.where(F.col("id").startswith(prefix)).distinct().agg(n.alias("matches"), outcome, F.min("id").alias("first_id"))


def versions(journal: DataFrame) -> DataFrame:
    """seq, id, before: the text each edit replaced, from the entry if it says, else from
    the entry before."""
    w = Window.partitionBy("id").orderBy("seq")
    texts = journal.where(F.col("op").isin("remember", "edit"))
    before = F.lag("text").over(w)
    texts = texts.withColumn("before", F.coalesce("before", before) if "before" in journal.columns else before)
    return texts.where("op = 'edit' AND before IS NOT NULL").select("seq", "id", "before")


LINKS = "array<struct<dst_id:string,rel:string>>"


def _moves(journal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log's rows and its links: (seq, us, id, put, text, links) of entries that replace a
    row or take it away, and (seq, us, id, dst_id, rel, on) of entries that add or remove one.

    A snapshot's links (column links) are added by it. An unlink without rel removes those of
    its column rels, or if there is none all links to its row; it has a null rel.
    """
    undone = (F.col("op") == "undo") & F.col("text").isNull() & (F.col("of_op") == "remember") if "of_op" in journal.columns else F.lit(False)
    put = F.col("op").isin(*SNAPSHOTS) | ((F.col("op") == "undo") & F.col("text").isNotNull())
    held = F.col("links").cast(LINKS) if "links" in journal.columns else F.lit(None).cast(LINKS)
    rows = journal.where(put | (F.col("op") == "forget") | undone).select("seq", "us", "id", put.alias("put"), "text", held.alias("links"))
    moves = journal.where(F.col("op").isin("link", "unlink"))
    if "rels" in journal.columns:
        moves = moves.withColumn("rel", F.explode_outer(F.when(F.col("rel").isNull() & (F.size("rels") > 0), F.col("rels")).otherwise(F.array("rel"))))
    moves = moves.select("seq", "us", "id", "dst_id", "rel", (F.col("op") == "link").alias("on"))
    own = rows.where("put").select("seq", "us", "id", F.explode("links").alias("l")).select("seq", "us", "id", "l.dst_id", "l.rel", F.lit(True).alias("on"))
    return rows, moves.unionByName(own)


def _listed(links: DataFrame, *keys: str) -> DataFrame:
    return links.groupBy(*keys).agg(F.count("*").alias("links"), F.sort_array(F.collect_list(F.struct("dst_id", "rel"))).alias("link_list"))


def state_at(journal: DataFrame, us: float) -> DataFrame:
    """id, text, base, links, link_list: what the log up to ``us`` leaves.

    Snapshots replace a row with the links they hold, forget removes it, nuke removes all
    before it; links and unlinks after a row's last snapshot apply in order, an unlink
    without rel to all links to its row. An undo puts back the text it holds, or without
    one takes away the row if it is a remember that was undone (column of_op).
    """
    cut = journal.where(F.col("us") <= us)
    nuked = cut.where("op = 'nuke'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("from_seq"))
    cut = cut.join(F.broadcast(nuked), F.col("seq") > F.col("from_seq")).drop("from_seq")
    rows, moves = _moves(cut)
    last = rows.groupBy("id").agg(F.max_by(F.struct("put", "text"), "seq").alias("s"), F.max("seq").alias("base"))
    alive = last.where("s.put").select("id", F.col("s.text").alias("text"), "base")
    moves = moves.join(alive.select("id", "base"), "id").where("seq > base OR (seq = base AND on)")
    ends = moves.where("rel IS NOT NULL").groupBy("id", "dst_id", "rel").agg(F.max_by("on", "seq").alias("on"), F.max("seq").alias("seq")).where("on")
    all_off = moves.where("rel IS NULL AND NOT on").groupBy("id", "dst_id").agg(F.max("seq").alias("off"))
    ends = ends.join(all_off, ["id", "dst_id"], "left").where("off IS NULL OR seq > off")
    return alive.join(_listed(ends, "id"), "id", "left").select("id", "text", "base", F.coalesce("links", F.lit(0)).alias("links"), "link_list")


#: Cells that a log is cut into by sequence, and by time (a power of two).
SEQ_CELLS, TIME_BITS = 4096, 16


def _until(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``rows(seq, closes, ...)`` with until: the least ``closes`` of rows of its keys with a
    greater seq. Cells of sequence numbers, and then their minima, each make a window, so
    that a key of very many entries isn't one task's. Windows run from the end: one that goes
    on to the end is computed anew for every row."""
    rows = rows.withColumn("_cell", F.floor(F.col("seq") / width))
    later = Window.partitionBy(*keys).orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*keys, "_cell").agg(F.min("closes").alias("_least")).withColumn("_later", F.min("_least").over(later)).drop("_least")
    inside = Window.partitionBy(*keys, "_cell").orderBy(F.desc("seq")).rangeBetween(Window.unboundedPreceding, -1)
    met = rows.withColumn("_inside", F.min("closes").over(inside))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "_cell"]]
    met = met.alias("r").join(cells.alias("c"), same, "left")
    return met.select(*[F.col(f"r.{c}") for c in rows.columns if c != "_cell"], F.least("r._inside", "c._later").alias("until"))


def lives(journal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, links) of a whole log as intervals: rows(id, text, base, since, until) and
    links(id, dst_id, rel, since, until), until null where nothing has ended them.

    At any time t, what is true of ``since <= t < until`` is what a replay of the entries
    with ``us <= t`` leaves, also where times and sequence disagree: an interval ends
    at the least time of all later entries that replace, remove or unlink what it is about.
    Nukes, which end everything, are put down in cells of sequence numbers, as many as there
    are nukes: a row looks through those of its cell, and takes the least of the later cells.
    """
    rows, moves = _moves(journal)
    span, first_seq, n_nukes = journal.agg(F.coalesce(F.max("seq") - F.min("seq"), F.lit(0)), F.min("seq"), F.count_if(F.col("op") == "nuke")).first()
    width = max(1, span // SEQ_CELLS)
    ended = _nuked(journal, first_seq or 0, span, n_nukes)

    closing = rows.select("seq", "id", F.col("us").alias("closes"))
    versions = _until(rows.withColumn("closes", F.col("us")), ["id"], width).where("put").select("seq", "id", "text", F.col("us").alias("since"), "until")
    versions = ended(versions).select("id", "text", F.col("seq").alias("base"), "since", "until")
    on = moves.where("on").select("seq", "id", "dst_id", "rel", F.col("us").alias("since"))
    nothing = F.lit(None).cast("double")
    off = moves.where("NOT on")
    for keys, ends in (
        (["id"], closing),
        (["id", "dst_id", "rel"], off.where("rel IS NOT NULL").select("seq", "id", "dst_id", "rel", F.col("us").alias("closes"))),
        (["id", "dst_id"], off.where("rel IS NULL").select("seq", "id", "dst_id", F.col("us").alias("closes"))),
    ):
        before = F.col("until") if "until" in on.columns else nothing
        both = on.withColumn("so_far", before).withColumn("closes", nothing).drop("until").unionByName(ends, allowMissingColumns=True)
        on = _until(both, keys, width).where("since IS NOT NULL").withColumn("until", F.least("until", "so_far")).drop("so_far", "closes")
    return versions, ended(on).select("id", "dst_id", "rel", "since", "until")


def _nuked(journal: DataFrame, first: int, span: int, n: int) -> Callable[[DataFrame], DataFrame]:
    """What ends ``frame(seq, since, until)`` at the least time of the later ones of n nukes."""
    if not n:
        return lambda frame: frame.where("until IS NULL OR since < until")
    width = max(1, span // n)
    cell = lambda c: F.floor((c - first) / width)
    nukes = journal.where("op = 'nuke'").select("seq", F.col("us").alias("closes"))
    steps = _until(nukes, [], max(1, span // SEQ_CELLS)).select(cell(F.col("seq")).alias("_cell"), "seq", F.least("closes", "until").alias("us"))
    held = steps.groupBy("_cell").agg(F.array_sort(F.collect_list(F.struct("seq", "us"))).alias("_nukes"))
    # A cell without nukes, or a row after its cell's last one, goes by the next cell that has some.
    every = journal.sparkSession.range(0, span // width + 1).withColumnRenamed("id", "_cell").join(held, "_cell", "left")
    least = every.select("_cell", "_nukes", F.array_min(F.transform("_nukes", lambda x: x["us"])).alias("closes"), F.col("_cell").alias("seq"))
    table = Scratch(journal.sparkSession).keep(_until(least, [], max(1, (span // width + 1) // SEQ_CELLS)).select(F.col("seq").alias("_cell"), "_nukes", F.col("until").alias("_later")))

    def ended(frame: DataFrame) -> DataFrame:
        # The first later nuke of the cell has the least time of all from it on.
        inside = F.get(F.filter("_nukes", lambda x: x["seq"] > F.col("seq")), F.lit(0))["us"]
        met = frame.withColumn("_cell", cell(F.col("seq"))).join(table, "_cell", "left")
        return met.withColumn("until", F.least("until", inside, "_later")).drop("_cell", "_nukes", "_later").where("until IS NULL OR since < until")

    return ended


def _dyadic(low: Column, high: Column, bits: int) -> Column:
    """array<struct<level, node>>: the fewest aligned ranges of cells that make low..high."""

    def step(acc, level):
        a, b, out = acc["a"], acc["b"], acc["out"]
        open_ = a <= b
        first, last = open_ & (a % 2 == 1), open_ & (b % 2 == 0)
        node = lambda n: F.array(F.struct(level.alias("level"), n.alias("node")))
        none = F.array().cast("array<struct<level:int,node:bigint>>")
        out = F.concat(out, F.when(first, node(a)).otherwise(none), F.when(last & ((a != b) | ~first), node(b)).otherwise(none))
        a2, b2 = F.when(first, a + 1).otherwise(a), F.when(last, b - 1).otherwise(b)
        return F.struct(F.when(a2 <= b2, F.floor(a2 / 2)).otherwise(F.lit(1)).cast("long").alias("a"), F.when(a2 <= b2, F.floor(b2 / 2)).otherwise(F.lit(0)).cast("long").alias("b"), out.alias("out"))

    start = F.struct(low.cast("long").alias("a"), high.cast("long").alias("b"), F.array().cast("array<struct<level:int,node:bigint>>").alias("out"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(bits + 1)]), start, step)["out"]


def _during(asked: DataFrame, spans: DataFrame, low: float, width: float, bits: int) -> DataFrame:
    """``asked(id, us)`` joined with what of ``spans(id, since, until, ...)`` holds then.

    A span is cut into the few aligned ranges of time cells that make it up, and a moment
    looks into the one range of each size that it is in; so the join is on equal keys, a
    row of many versions is spread over its ranges, and nothing meets in vain but in the
    first and last cell.
    """
    cell = lambda c: F.least(F.greatest(F.floor((c - low) / width), F.lit(0)), F.lit((1 << bits) - 1)).cast("long")
    nodes = spans.withColumn("_n", F.explode(_dyadic(cell(F.col("since")), F.when(F.col("until").isNull(), F.lit((1 << bits) - 1).cast("long")).otherwise(cell(F.col("until"))), bits)))
    nodes = nodes.select("*", F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node")).drop("_n")
    looks = F.transform(F.array(*[F.lit(i) for i in range(bits + 1)]), lambda i: F.struct(i.alias("_level"), F.floor(cell(F.col("us")) / F.pow(F.lit(2.0), i)).cast("long").alias("_node")))
    looking = asked.withColumn("_n", F.explode(looks)).select("id", "us", "_n._level", "_n._node")
    met = looking.join(nodes, ["id", "_level", "_node"]).where("since <= us AND (until IS NULL OR us < until)")
    return met.drop("_level", "_node", "since", "until")


def states_at(journal: DataFrame, asked: DataFrame, bits: int = TIME_BITS) -> DataFrame:
    """id, us, text, base, links, link_list of each of ``asked(id, us)`` that lived then: as
    ``state_at``, for any number of moments in one pass over the log. Repeated questions
    count once."""
    scratch = Scratch(journal.sparkSession)
    low, high = journal.agg(F.min("us"), F.max("us")).first()
    low, high = (0.0, 1.0) if low is None else (float(low), float(high))
    width = max((high - low) / (1 << bits), 1e-9)
    rows, links = lives(journal)
    asked = scratch.keep(asked.select("id", F.col("us").cast("double").alias("us")).distinct())
    alive = scratch.keep(_during(asked, rows, low, width, bits))
    held = _during(alive.select("id", "us"), links, low, width, bits).select("id", "us", "dst_id", "rel").distinct()
    return alive.join(_listed(held, "id", "us"), ["id", "us"], "left").select("id", "us", "text", "base", F.coalesce("links", F.lit(0)).alias("links"), "link_list")


#: Columns of a row that superseding and restoring change.
MARKS = ("superseded_by", "superseded_at", "pinned")
#: Letters from which a text is compared by its digest, which is longer.
DIGESTED = 64


def _brief(row: Column, schema: StructType) -> Column:
    """The columns of a struct that undo compares, texts of more than DIGESTED letters by
    digest. The array makes Spark compute the struct once, and not once a column."""

    def short(r: Column, name: str, kind: DataType) -> Column:
        c = r.getField(name).cast(kind)
        return F.when(F.length(c) > DIGESTED, F.concat(F.lit("#"), F.sha2(c, 256))).otherwise(c) if kind.typeName() == "string" else c

    compared = [f for f in schema if f.name not in VOLATILE]
    return F.transform(F.array(row), lambda r: F.struct(*[short(r, f.name, f.dataType).alias(f.name) for f in compared]))[0]


def undo(entries: DataFrame, rows: DataFrame, edges: DataFrame, now: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, edges, verdicts): the inverse of ``entries``, where that is safe.

    ``entries`` has seq, op, id, before and after (structs of the columns of ``rows``),
    dst_id, rels (an array) and superseder_id; at most one entry a row, or a link (for many of
    a row see ``undo_chains``).
    ``verdicts`` is (seq, op, id, undone). A supersede is undone by ``restore`` and a
    restore by ``supersede``, with their links and pins. Refused: a forget whose row lives,
    an edit whose row has changed since in any column that isn't VOLATILE, a restore whose
    newer row is gone or is itself superseded by the row, links that aren't there any more,
    and ops that have no inverse. A forget that is undone leaves its row's trash entries
    without use: ``trash.unneeded`` takes them out.
    """
    scratch = Scratch(rows.sparkSession)
    state = rows.select("id", F.col("superseded_by").alias("by"), _brief(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), rows.schema).alias("now"))
    edited = (F.col("op") == "edit") & F.col("after").isNotNull()
    # Only edits are compared; what entries bring back is fetched for those that are undone.
    asked = entries.select("seq", "op", "id", F.col("before").isNotNull().alias("held"), F.when(edited, _brief(F.col("after"), rows.schema)).alias("after"), "dst_id", "rels", "superseder_id")
    met = asked.join(state, "id", "left")
    met = met.select(
        "seq", "op", "id", "held", F.col("after").isNotNull().alias("edited"), F.col("now").eqNullSafe(F.col("after")).alias("steady"),
        F.col("now").isNotNull().alias("live"), "by", "dst_id", "rels", "superseder_id",
    )
    live = F.col("live")
    newer = rows.select(F.col("id").alias("superseder_id"), F.col("superseded_by").alias("newer"))
    met = met.join(newer, "superseder_id", "left")
    there = edges.groupBy(F.col("src").alias("id"), F.col("dst").alias("dst_id")).agg(F.collect_set("rel").alias("have"))
    met = met.join(there, ["id", "dst_id"], "left").join(rows.select(F.col("id").alias("dst_id"), F.lit(True).alias("far")), "dst_id", "left")
    none = F.array().cast("array<string>")
    have, rels = F.coalesce("have", none), F.coalesce("rels", none)
    ok = {
        "remember": live,
        "forget": F.col("held") & ~live,
        "edit": F.col("held") & F.col("edited") & live & F.col("steady"),
        "supersede": live & (F.col("by") != ""),
        "restore": live & F.col("newer").isNotNull() & (F.col("newer") != F.col("id")) & (F.col("superseder_id") != F.col("id")),
        "link": F.size(F.array_intersect(have, rels)) > 0,
        "unlink": live & F.coalesce("far", F.lit(False)) & (F.size(F.array_except(rels, have)) > 0),
    }
    undone = F.lit(False)
    for op, cond in ok.items():
        undone = F.when(F.col("op") == op, F.coalesce(cond, F.lit(False))).otherwise(undone)
    judged = scratch.keep(met.withColumn("undone", undone).select("seq", "op", "id", "dst_id", "rels", "superseder_id", "undone"))
    done = judged.where("undone")
    returned = done.where("op IN ('forget', 'edit')").select("seq", "op", "id").alias("d")
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"d.{c}")) for c in ("seq", "op", "id")]
    back = entries.where("op IN ('forget', 'edit')").alias("e").join(returned, same, "left_semi").select("before.*").select(*[F.col(f"`{c}`") for c in rows.columns])
    touched = done.where("op IN ('remember', 'forget', 'edit')").select("id").distinct()
    # Marks and pins are moved in a narrow table; whole rows meet only what has changed in it.
    own = [c for c in MARKS if c in rows.columns]
    marks = F.struct(*own)
    narrow = lambda frame, again: frame.select("id", *own, marks.alias("_was"), F.lit(again).alias("_again"))
    kept = scratch.keep(narrow(rows.select("id", *own).join(touched, "id", "left_anti"), False).unionByName(narrow(back, True)))
    links = done.select("op", F.col("id").alias("src"), F.col("dst_id").alias("dst"), F.explode_outer("rels").alias("rel"))
    fewer = edges.join(links.where("op = 'link'").select("src", "dst", "rel"), ["src", "dst", "rel"], "left_anti").select("src", "dst", "rel")
    more = fewer.union(links.where("op = 'unlink' AND rel IS NOT NULL").select("src", "dst", "rel")).distinct()
    kept, more = lifecycle.restore(kept, more, done.where("op = 'supersede'").select("id"))
    kept, more = lifecycle.supersede(kept, more, done.where("op = 'restore'").select(F.col("id").alias("old"), F.col("superseder_id").alias("new")), now)
    changed = kept.select("id", "_again", marks.alias("_new"), "_was").where("NOT (_new <=> _was)").drop("_was")
    gone = touched.select("id", F.lit(False).alias("_again"), F.lit(None).cast(changed.schema["_new"].dataType).alias("_new"), F.lit(True).alias("_gone"))
    changed = scratch.keep(changed.withColumn("_gone", F.lit(False)).unionByName(gone))

    def after(frame: DataFrame, again: bool) -> DataFrame:
        out = frame.join(changed.where(F.col("_again") == again).drop("_again"), "id", "left").where("_gone IS NULL OR NOT _gone")
        return out.select(*[F.when(F.col("_gone").isNull(), F.col(c)).otherwise(F.col(f"_new.{c}")).alias(c) if c in own else F.col(f"`{c}`") for c in rows.columns])

    return after(rows, False).unionByName(after(back, True)), more, judged.select("seq", "op", "id", "undone")


def undo_chains(entries: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, verdicts): the entries of rows' lives undone newest first, any number a row.

    ``entries`` has seq (one of its own each), op, id, before and after (structs of the
    columns of ``rows``); ``verdicts`` is (seq, op, id, undone). Equal to one ``undo`` after
    another, from the greatest seq to the least: a remember takes the row away, a forget
    brings it back if it isn't there, an edit is undone if the row, as it is by then, is what
    the edit left, but for VOLATILE. Entries refused are passed over. Those of other ops, or
    without id, are never undone. An empty table changes nothing.

    What a step leaves (a row's digest, or nothing) says which older entry is the next to
    take: the latest that accepts it. So each entry knows its next by an as-of join, and the
    entries that are undone are the path that starts at the row of today, walked by pointer
    jumping: rounds are the bits of the longest path, and no row's entries meet in one task.
    """
    scratch = Scratch(rows.sparkSession)

    def digest(at: str) -> Column:
        steady = []
        for f in rows.schema:
            if f.name not in VOLATILE:
                # Adding 0 makes one of the two zeros of a float.
                part = F.col(f"{at}.`{f.name}`")
                steady.append((part + 0.0 if f.dataType.typeName() in ("double", "float") else part).alias(f.name))
        return F.when(F.col(at).isNotNull(), F.sha2(F.to_json(F.struct(*steady)), 256))

    steps = entries.where("id IS NOT NULL AND (op = 'remember' OR op = 'forget' AND before IS NOT NULL OR op = 'edit' AND before IS NOT NULL AND after IS NOT NULL)")
    # Newest first: the place of an entry is its seq, negated.
    place = (-F.col("seq")).cast("long").alias("seq")
    takes = F.when(F.col("op") == "edit", digest("after")).when(F.col("op") == "forget", "gone").otherwise("live").alias("takes")
    leaves = F.when(F.col("op") != "remember", digest("before")).alias("leaves")
    steps = scratch.keep(steps.select(place, "op", "id", takes, leaves))
    low, high = steps.agg(F.min("seq"), F.max("seq")).first()
    low, high = (0, 0) if low is None else (low, high)
    today = rows.select("id", F.struct(*[F.col(c) for c in rows.columns]).alias("row"))
    starts = scratch.keep(steps.select("id").distinct().join(today, "id", "left").select(F.lit(low - 1).cast("long").alias("seq"), "id", digest("row").alias("leaves")))
    nothing = F.lit(None).cast("long")
    looks = F.when(F.col("leaves").isNull(), F.array(F.lit("gone"))).otherwise(F.array(F.lit("live"), F.col("leaves")))
    asking = steps.select("seq", "id", "leaves").unionByName(starts.select("seq", "id", "leaves")).select("seq", "id", F.explode(looks).alias("takes"), nothing.alias("closes"), F.lit(True).alias("asks"))
    both = asking.unionByName(steps.select("seq", "id", "takes", F.col("seq").alias("closes"), F.lit(False).alias("asks")))
    found = _until(both, ["id", "takes"], max(1, (high - low) // SEQ_CELLS)).where("asks").groupBy("id", "seq").agg(F.min("until").alias("next"))
    jump = scratch.keep(found.where("next IS NOT NULL"))
    path = starts.select("id", "seq")
    while not jump.isEmpty():
        path = scratch.keep(path.unionByName(path.join(jump, ["id", "seq"]).select("id", F.col("next").alias("seq"))))
        jump = scratch.keep(jump.alias("a").join(jump.alias("b"), (F.col("a.id") == F.col("b.id")) & (F.col("a.next") == F.col("b.seq"))).select("a.id", "a.seq", "b.next"))
    undone = scratch.keep(path.where(F.col("seq") >= low).select("id", (-F.col("seq")).alias("seq"), F.lit(True).alias("hit")))
    last = undone.groupBy("id").agg(F.min("seq").alias("seq"))
    back = entries.join(last, ["id", "seq"], "left_semi").where("op <> 'remember'").select("before.*").select(*rows.columns)
    kept = rows.join(last, "id", "left_anti").select(*rows.columns).unionByName(back)
    verdicts = entries.select("seq", "op", "id").join(undone, ["id", "seq"], "left").select("seq", "op", "id", F.coalesce("hit", F.lit(False)).alias("undone"))
    return kept, verdicts


def metrics(hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """qid, recall, precision, rr, ap, ndcg of ranked ``hits(qid, id, rank)``.

    Relevance is binary. Precision divides by what was retrieved. A relevant id that
    comes twice is credited once, but for precision. Queries without hits score 0. Where
    ``gold`` has a column k, a case counts only its k best hits, a null one ``k``.
    """
    own = F.coalesce(F.max("k"), F.lit(k)) if "k" in gold.columns else F.lit(k)
    size = gold.groupBy("qid").agg(F.countDistinct("id").alias("n"), own.cast("int").alias("most"))
    if "k" in gold.columns:
        hits = hits.join(size.select("qid", "most"), "qid").where("rank <= most").drop("most")
    rel = hits.join(gold.select("qid", "id", F.lit(1).alias("rel")).distinct(), ["qid", "id"], "left").fillna(0, ["rel"])
    first = F.row_number().over(Window.partitionBy("qid", "id").orderBy("rank"))
    rel = rel.withColumn("new", F.when(first == 1, F.col("rel")).otherwise(0))
    rel = rel.withColumn("seen", F.sum("new").over(Window.partitionBy("qid").orderBy("rank")))
    got = rel.groupBy("qid").agg(
        F.sum("new").alias("found"),
        F.sum("rel").alias("good"),
        F.count("*").alias("m"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum(F.col("new") * F.col("seen") / F.col("rank")).alias("gain"),
        F.sum(F.col("new") / F.log2(F.col("rank") + 1.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.col("most")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    r6 = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return size.join(got, "qid", "left").select(
        "qid",
        r6(F.col("found") / F.col("n")).alias("recall"),
        r6(F.col("good") / F.col("m")).alias("precision"),
        r6(1 / F.col("first")).alias("rr"),
        r6(F.col("gain") / F.col("n")).alias("ap"),
        r6(F.col("dcg") / ideal).alias("ndcg"),
    )

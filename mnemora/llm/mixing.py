"""Mixing sources to target weights, in blocks of a fixed number of words.

Native DataFrame operations only. Each source's words, in a fixed order of its
documents, are packed into blocks of ``block_words``. A source's target number of
words sets how many slots it fills in the mix. Every output shard has the same number of
slots (the last one what is left), and how many of them each source fills is drawn:
the slots of all sources, one after another, are permuted, and a shard gets those
that come to lie in its stretch. A shard's counts are so a multinomial draw over the
sources by their shares, given that all shards' counts add up to the targets, which
is exact for any number of slots. A shard's slots of a source follow each other. The
source's k-th slot takes block perm(k mod blocks) of pass k div blocks, where each
pass has a permutation of its own. Both permutations are swap-or-not (Hoang, Morris
and Rogaway 2012: exact for any number, nothing stored). Slots meet the blocks'
documents in a join on (source, block). All draws are hashes of a seed, so reruns
agree.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, Scratch, table

BLOCK_WORDS, SHARD_BLOCKS, ROUNDS, SEED = 32, 4096, 10, 20240517
#: The default weights of sources in code point order, repeating.
CYCLE = (1, 2, 3)
#: A source's words are used this many times at most.
MOST = 3
#: Rounds of the permutation that draws the shards: slots whose rounds all went alike, a
#: 2**-22th of them, stay neighbours, and a shard should hold hardly any such two.
DRAW_ROUNDS = 22


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def target_words(sizes: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """sid, source, source_size, target from ``sizes(source, source_size)``.

    A target is the least of MOST times the source's size and its weight's share,
    what is cut off being reshared by weight: min(MOST * size, level * weight) with
    one level for all, found by prefix sums over sources in the order in which they
    reach their limits. ``weights(source, weight)`` replaces the default cycle;
    sources it lacks weigh 0. One row per source runs through one task.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("sid", F.row_number().over(every) - 1)
    if weights is None:
        s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in CYCLE]), (F.col("sid") % len(CYCLE) + 1).cast("int")))
    else:
        w = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double").alias("weight"))
        s = s.join(w, F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source").fillna(0.0, ["weight"])
    all_ = Window.partitionBy()
    reach = Window.orderBy((F.try_divide("limit", "weight")).asc_nulls_last(), "sid")
    s = s.withColumn("limit", MOST * F.col("source_size").cast("double"))
    s = s.withColumn("total", F.sum(F.col("source_size").cast("double")).over(all_)).withColumn("heavy", F.sum("weight").over(all_))
    full = reach.rowsBetween(Window.unboundedPreceding, -1)
    used, gone = F.coalesce(F.sum("limit").over(full), F.lit(0.0)), F.coalesce(F.sum("weight").over(full), F.lit(0.0))
    s = s.withColumn("level", F.when(F.col("heavy") > gone + 1e-9, (F.col("total") - used) / (F.col("heavy") - gone)))
    fits = (F.col("weight") > 0) & (F.col("level") * F.col("weight") <= F.col("limit") * (1 + 1e-12))
    s = s.withColumn("level", F.first(F.when(fits, F.col("level")), ignorenulls=True).over(reach.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    want = F.coalesce(F.col("level") * F.col("weight"), F.when(F.col("weight") > 0, F.col("limit")), F.lit(0.0))
    return s.select("sid", "source", "source_size", F.least("limit", want).alias("target"))


def permuted(df: DataFrame, index: str, n: str, key: list, out: str, rounds: int = ROUNDS) -> DataFrame:
    """Adds ``out``: a pseudorandom permutation of 0..n-1, keyed by ``key``, at ``index``."""

    def one(x: Column, r: Column) -> Column:
        mate = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), r, *key), F.col(n)) - x, F.col(n))
        # The one-element array names the mate, so that it is worked out once.
        return F.transform(F.array(mate), lambda m: F.when(F.xxhash64(F.lit(-SEED), r, *key, F.greatest(m, x)).bitwiseAND(1) == 1, m).otherwise(x))[0]

    return df.withColumn(out, F.aggregate(F.array(*[F.lit(r) for r in range(rounds)]), F.col(index).cast("long"), one))


def drawn_place(g: Column, total: int) -> Column:
    """A pseudorandom permutation of 0..total-1 at ``g``, the one that draws the shards."""
    draw = random.Random(SEED)
    turns = F.array(*[F.lit(draw.randrange(total)).cast("long") for _ in range(DRAW_ROUNDS)])

    def one(x: Column, turn: Column) -> Column:
        mate = turn - x + F.when(turn < x, F.lit(total).cast("long")).otherwise(F.lit(0).cast("long"))
        return F.transform(F.array(mate), lambda m: F.when(F.xxhash64(F.lit(-SEED), turn, F.greatest(m, x)).bitwiseAND(1) == 1, m).otherwise(x))[0]

    return F.aggregate(turns, g.cast("long"), one)


def drawn_shards(sources: DataFrame, total: int, shard_blocks: int, parts: int, scratch: Scratch) -> DataFrame:
    """sid, blocks, shard, start, n: how many slots of ``sources(sid, blocks, slots)``,
    ``total`` of all together, from which on, fall into each shard of ``shard_blocks``
    slots; a shard that has none of a source has no row for it."""
    zero, run = F.lit(0).cast("long"), max(1, -(-total // parts))
    drawn = sources.where("slots > 0").withColumn("first", F.sum("slots").over(Window.orderBy("sid")) - F.col("slots"))
    drawn = drawn.select("sid", "blocks", "first", "slots", F.explode(F.sequence(zero, F.col("slots") - 1, F.lit(run).cast("long"))).alias("low")).repartition(parts, "sid", "low")
    g = F.explode(F.sequence(F.col("first") + F.col("low"), F.col("first") + F.least(F.col("low") + run, "slots") - 1))
    drawn = drawn.select("sid", "blocks", g.alias("g")).select("sid", "blocks", F.floor(drawn_place(F.col("g"), max(1, total)) / shard_blocks).alias("shard"))
    counts = scratch.keep(drawn.groupBy("sid", "blocks", "shard").agg(F.count("*").alias("n")))
    # Prefix sums over a source's shards in two levels, so that they are never in one task.
    counts = counts.withColumn("bucket", F.floor(F.col("shard") / max(1, math.isqrt(total // shard_blocks))))
    sums = counts.groupBy("sid", "bucket").agg(F.sum("n").alias("all"))
    before = F.sum("all").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("all")
    inner = F.sum("n").over(Window.partitionBy("sid", "bucket").orderBy("shard")) - F.col("n")
    met = counts.withColumn("at", inner).join(sums.select("sid", "bucket", before.alias("base")).hint("merge"), ["sid", "bucket"])
    return met.select("sid", "blocks", "shard", (F.col("base") + F.col("at")).alias("start"), "n")


@dataclass
class Mix:
    """sources: sid, source, source_size, target, blocks, slots. placed: sid, start,
    doc_id, size, where a row's words start in its source. shards: sid, blocks, shard,
    start, n, the drawn counts. slots: shard, sid, block, pass and slot, one row per
    block of the mix. takes: sid, block, and how often it is taken. spans: sid, block,
    start, n: the words of a block that a row holds."""

    sources: DataFrame
    placed: DataFrame
    shards: DataFrame
    slots: DataFrame
    takes: DataFrame
    spans: DataFrame
    sized: DataFrame


def mix_sources(docs: DataFrame, scratch: Scratch, weights: DataFrame | None = None, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> Mix:
    """Plans a mix of ``docs(doc_id, text, source)``; see ``Mix``.

    Null sources are a source of their own, last in order. Texts that are null or
    have no words have size 0 and hold no block. Repeated rows are rows of their
    own. A target below half a block of its source takes none. An empty table has no
    sources. Sources are few enough for one task; nothing else is.
    """
    sized = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size_of(F.col("text")).alias("size")))
    sources = target_words(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    blocks = F.ceil(F.col("source_size") / block_words)
    sources = sources.withColumn("blocks", blocks).withColumn("slots", F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * F.col("blocks")).cast("long")).otherwise(F.lit(0).cast("long")))
    sources = scratch.keep(sources)
    buckets = max(1, math.isqrt(sized.count()))
    ids = sources.select("sid", F.col("source").alias("s_source"))
    numbered = sized.join(ids, F.col("source").eqNullSafe(F.col("s_source"))).select("doc_id", "size", "sid")
    # Prefix sums in two levels, so that a source's rows are never in one task: of
    # n rows, about sqrt(n) buckets with sqrt(n) rows each.
    numbered = numbered.where("size > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    sums = numbered.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("n")
    inner = F.sum("size").over(Window.partitionBy("sid", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = numbered.withColumn("at", inner).join(sums.select("sid", "bucket", before.alias("base")).hint("merge"), ["sid", "bucket"])
    placed = scratch.keep(placed.select("sid", (F.col("base") + F.col("at")).alias("start"), "doc_id", "size"))
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    spans = placed.select("sid", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    low, high = F.greatest("start", F.col("block") * block_words), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    spans = spans.select("sid", "block", "start", (high - low).alias("n"))
    total = sources.agg(F.sum("slots")).first()[0] or 0
    # A number of partitions of its own: adaptive execution would join these few rows.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (16 * SHARD_BLOCKS))
    shards = drawn_shards(sources, total, shard_blocks, parts, scratch)
    slots = shards.repartition(parts, "sid", "shard").select("sid", "blocks", "shard", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("slot"))
    slots = slots.withColumn("pass", F.floor(F.col("slot") / F.col("blocks"))).withColumn("i", F.col("slot") % F.col("blocks"))
    slots = permuted(slots, "i", "blocks", [F.col("sid"), F.col("pass")], "block").select("shard", "sid", "slot", "pass", "block")
    takes = slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
    return Mix(sources, placed, shards, slots, takes, spans, sized)


def taken_words(mix: Mix) -> DataFrame:
    """sid, start, taken of each placed row: the words of it that the mix takes."""
    return mix.spans.join(mix.takes.hint("merge"), ["sid", "block"]).groupBy("sid", "start").agg(F.sum(F.col("n") * F.col("times")).alias("taken"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each row of documents that the mix takes; rows without words
    count with size 0. The mix takes one shard's draw of blocks after another, and
    all of them together meet each source's target to half a block."""
    mix = mix_sources(table(spark, sf_dir, "documents"), Scratch(spark))
    got = mix.placed.join(taken_words(mix).hint("merge"), ["sid", "start"], "left").select("doc_id", "size", "sid", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    ids = mix.sources.select("sid", F.col("source").alias("s_source"))
    empty = mix.sized.where("size = 0").join(ids, F.col("source").eqNullSafe(F.col("s_source"))).select("doc_id", "size", "sid", F.lit(0).cast("long").alias("taken"))
    return got.unionAll(empty).join(mix.sources.select("sid", "source_size", "target"), "sid").select("doc_id", "size", "source_size", "target", "taken")


def _placed_rows(docs: DataFrame, mix: Mix) -> DataFrame:
    """sid, start, size, row: the rows of ``docs`` that hold words, at their places.

    Rows of one id, source and size are alike enough to stand for each other, but
    each stands for one row: they are numbered on both sides. The join is on keys
    that can't be null, as null ids never equal each other.
    """
    like = Window.partitionBy("key", "no_id", "sid", "size")
    key, no_id = F.coalesce("doc_id", F.lit(0).cast("long")).alias("key"), F.col("doc_id").isNull().alias("no_id")
    wanted = mix.placed.select("sid", "start", "size", key, no_id).withColumn("nth", F.row_number().over(like.orderBy("start")))
    ids = mix.sources.select("sid", F.col("source").alias("s_source"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), size_of(F.col("text")).alias("size")).where("size > 0")
    rows = rows.select("row", "size", key, no_id).join(ids, F.col("row.source").eqNullSafe(F.col("s_source"))).drop("s_source")
    rows = rows.withColumn("nth", F.row_number().over(like.orderBy(F.xxhash64("row.text"))))
    return rows.join(wanted, ["key", "no_id", "sid", "size", "nth"]).select("sid", "start", "size", "row")


def _words_at(text: Column, spans: Column) -> Column:
    """The words of ``spans`` (structs at, n), joined by spaces. The one-element array
    names the text's words, so that they are found once and not for each span."""
    found = F.array(F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0)))
    return F.transform(found, lambda words: F.array_join(F.flatten(F.transform(spans, lambda s: F.slice(words, s["at"] + 1, s["n"]))), " "))[0]


def _offset(block_words: int) -> Column:
    """Of a span's first word in its row."""
    return F.greatest(F.col("block") * block_words - F.col("start"), F.lit(0)).cast("int")


def mixed_blocks(docs: DataFrame, weights: DataFrame | None = None, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """shard, slot, source, block, text: the mix itself, a row for each slot.

    A block's text is its words joined by spaces. Within a shard a source's slots
    follow each other; ordering by a hash of (sid, slot) would shuffle them.
    """
    mix = mix_sources(docs, Scratch(docs.sparkSession), weights, block_words, shard_blocks)
    spans = mix.spans.select("sid", "start", "block", F.struct(_offset(block_words).alias("at"), F.col("n").cast("int").alias("n")).alias("span"))
    held = spans.join(_placed_rows(docs, mix).select("sid", "start", F.col("row.text").alias("text")), ["sid", "start"])
    pieces = held.select("sid", "block", F.struct("start", _words_at(F.col("text"), F.array("span")).alias("words")).alias("piece"))
    blocks = pieces.groupBy("sid", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list("piece")), lambda p: p["words"]), " ").alias("text"))
    return mix.slots.join(blocks, ["sid", "block"]).join(mix.sources.select("sid", "source"), "sid").select("shard", "slot", "source", "block", "text")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: a row for the words of a document taken at least once,
    another for those taken twice or more, and so on to MOST.

    A row whose words are all taken keeps its text as it is; of others the taken
    words are joined by single spaces and n_chars is counted anew. A row without
    doc_id is a document like any other and stays without one. Rows without words
    hold no block and go. An empty table stays empty. Rows come by the shard that
    the draw gave the first of their blocks to.
    """
    mix = mix_sources(docs, Scratch(spark))
    nth = F.row_number().over(Window.partitionBy("sid", "block").orderBy("pass")).alias("copy")
    spans = mix.spans.join(mix.slots.select("sid", "block", "shard", nth).hint("merge"), ["sid", "block"])
    # A struct's names are lost if it is made beside a generator.
    spans = spans.select("sid", "start", "copy", "shard", F.struct(_offset(BLOCK_WORDS).alias("at"), F.col("n").cast("int").alias("n")).alias("span"))
    copies = spans.groupBy("sid", "start", "copy").agg(F.sort_array(F.collect_list("span")).alias("spans"), F.sum("span.n").alias("words"), F.min_by("shard", "span.at").alias("shard"))
    met = _placed_rows(docs, mix).join(copies, ["sid", "start"])
    text = F.when(F.col("words") == F.col("size"), F.col("row.text")).otherwise(_words_at(F.col("row.text"), F.col("spans")))
    out = met.select("row", "shard", text.alias("_text")).sortWithinPartitions("shard")
    kept = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*[kept.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])

"""Walks over typed links: level-by-level joins, each node visited once.

Each level is written down, as the next one reads it and all before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

DIRECTIONS = ("out", "in", "both")
#: A node of more links than this isn't left by all of them where it is known where to go.
HUB = 1000


def undirected(edges: DataFrame) -> DataFrame:
    """a, b, rel in both directions, dangling ends included."""
    one = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "rel")
    return one.union(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "rel")).distinct()


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    """a, b, way, rel: steps along links (way 0) and against them (way 1)."""
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction {direction!r}")
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0).alias("way"), "rel")
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(1).alias("way"), "rel")
    return {"out": out, "in": back, "both": out.union(back)}[direction].distinct()


def levels(seeds: DataFrame, steps: DataFrame, depth: int) -> DataFrame:
    """seed, id, depth of every node within ``depth`` steps(a, b), seeds at 0."""
    scratch = Scratch(seeds.sparkSession)
    seen = front = seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("depth")).distinct()
    for d in range(1, depth + 1):
        new = front.join(steps.select("a", "b").distinct(), front.id == F.col("a")).select("seed", F.col("b").alias("id")).distinct()
        front = scratch.keep(new.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def neighbors(seeds: DataFrame, edges: DataFrame, known: DataFrame, depth: int = 1, direction: str = "both", rel: str | None = None) -> DataFrame:
    """seed, id, rel, depth: what ``seeds(seed)`` lead to, with all parallel links of the
    first contact.

    Nodes are visited in the order in which they are found: by the node they were found
    from, links along before links against, then by id. A node is found once; the rels
    are those between it and its finder in that direction. Links to rows that don't
    exist are not followed.
    """
    steps = _steps(edges if rel is None else edges.where(F.col("rel") == rel), direction)
    steps = steps.join(known.select(F.col("id").alias("b")), "b", "left_semi")
    scratch = Scratch(seeds.sparkSession)
    front = seeds.select("seed", F.col("seed").alias("a"), F.lit(0).cast("long").alias("pos")).distinct()
    seen, out = front.select("seed", F.col("a").alias("id")), None
    for d in range(1, depth + 1):
        met = front.join(steps, "a").select("seed", F.col("b").alias("id"), F.struct("pos", "way").alias("via"), "rel")
        met = met.join(seen, ["seed", "id"], "left_anti")
        first = met.groupBy("seed", "id").agg(F.min("via").alias("via"))
        found = scratch.keep(met.join(first, ["seed", "id", "via"]).select("seed", "id", "rel", "via", F.lit(d).alias("depth")))
        got = found.select("seed", "id", "rel", "depth")
        out = got if out is None else out.unionByName(got)
        nodes = found.select("seed", "id", "via").distinct()
        order = Window.partitionBy("seed").orderBy("via", "id")
        front = nodes.select("seed", F.col("id").alias("a"), F.row_number().over(order).cast("long").alias("pos"))
        seen = seen.unionByName(nodes.select("seed", "id"))
    if out is None:
        out = seeds.select("seed", F.col("seed").alias("id"), F.lit("").alias("rel"), F.lit(0).alias("depth")).where("false")
    return out


def subgraph(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """seed, src, dst, rel: links out of nodes nearer than ``depth``, dangling ones too."""
    near = levels(seeds, _steps(edges, "out"), depth).where(F.col("depth") < depth)
    return near.join(edges, near.id == edges.src).select("seed", "src", "dst", "rel").distinct()


def find_paths(pairs: DataFrame, edges: DataFrame, known: DataFrame, most: int = 6) -> DataFrame:
    """start, end, path of each of ``pairs(start, end)`` of existing rows that a path of
    at most ``most`` links, either way, connects.

    A path is an array of (id, rel it was reached by), the start's rel being empty. Of
    the shortest the one that a walk finds first which tries neighbours by (id, rel):
    the least as an array. A row and itself are a path of one.

    Both ends search in turn, so that each goes half as deep, and hold only which nodes they
    reached at which level. Once two levels meet, the nodes between that lie on a shortest
    path are found backwards, and the least path forwards, a step of all pairs at a time.
    The last step, and those along found paths, look only for links to the other level, so
    that a node of very many links costs a row for each pair that comes by, not its links.
    """
    scratch = Scratch(pairs.sparkSession)
    ids, key = known.select("id"), ["start", "end"]
    asked = pairs.select(*key).distinct()
    for one in key:
        asked = asked.join(ids.select(F.col("id").alias(one)), one, "left_semi")
    asked = scratch.keep(asked)
    steps = scratch.keep(undirected(edges))
    links = scratch.keep(steps.select("a", "b").distinct())
    hubs = scratch.keep(links.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > HUB).select("a"))
    hop = lambda id_, rel: F.array(F.struct(id_.alias("id"), rel.alias("rel")))
    done = asked.where("start = end").select(*key, hop(F.col("start"), F.lit("")).alias("path"))
    open_ = asked.where("start <> end")
    sides = [[open_.select(*key, F.col(one).alias("id"))] for one in key]
    for depth in range(1, most + 1):
        side = sides[(depth + 1) % 2]
        near = side[-1].join(open_, key, "left_semi") if depth > 2 else side[-1]
        if depth == most:
            other = sides[depth % 2][-1]
            met = scratch.keep(_between(near, other, links, hubs).select(*key, F.col("b").alias("id")).distinct())
            side.append(met)  # what is met is the other side's, at this side's next level
            done = done.unionByName(_least(met, *sides, steps, links, hubs, scratch))
            break
        new = near.join(links, near.id == links.a).select(*key, F.col("b").alias("id")).distinct()
        for level in side:
            new = new.join(level, [*key, "id"], "left_anti")
        side.append(scratch.keep(new))
        met = scratch.keep(sides[0][-1].join(sides[1][-1], [*key, "id"]).join(open_, key, "left_semi"))
        if not met.isEmpty():
            done = done.unionByName(_least(met, *sides, steps, links, hubs, scratch))
        open_ = scratch.keep(open_.join(met.select(*key).distinct(), key, "left_anti"))
        if open_.isEmpty() or side[-1].isEmpty():
            break
    return done


def _between(front: DataFrame, level: DataFrame, steps: DataFrame, hubs: DataFrame) -> DataFrame:
    """start, end, a, b and what else ``steps(a, b, ...)`` has, of those from ``front(start,
    end, id)`` to ``level(start, end, id)``."""
    key = ["start", "end"]
    front, level = front.select(*key, F.col("id").alias("a")), level.select(*key, F.col("id").alias("b"))
    few = front.join(F.broadcast(hubs), "a", "left_anti").join(steps, "a").join(level, [*key, "b"])
    many = front.join(F.broadcast(hubs), "a", "left_semi").join(level, key).join(steps, ["a", "b"])
    return few.unionByName(many)


def _least(met: DataFrame, there: list[DataFrame], back: list[DataFrame], steps: DataFrame, links: DataFrame, hubs: DataFrame, scratch: Scratch) -> DataFrame:
    """start, end, path through ``met(start, end, id)``, where the last levels from both
    ends meet."""
    key = ["start", "end"]
    on_path = [met]
    for level in reversed(there[:-1]):
        on_path.insert(0, scratch.keep(_between(on_path[0], level, links, hubs).select(*key, F.col("b").alias("id")).distinct()))
    on_path += back[-2::-1]  # whatever leads nearer to the end lies on a shortest path
    at = met.select(*key).distinct().select(*key, F.struct(F.lit(0).alias("k"), F.col("start").alias("id"), F.lit("").alias("rel")).alias("x"))
    walked = [at]
    for k, level in enumerate(on_path[1:], 1):
        tried = _between(at.select(*key, "x.id"), level, steps, hubs).select(*key, F.col("b").alias("id"), "rel")
        at = scratch.keep(tried.groupBy(*key).agg(F.min(F.struct("id", "rel")).alias("m")).select(*key, F.struct(F.lit(k).alias("k"), F.col("m.id").alias("id"), F.col("m.rel").alias("rel")).alias("x")))
        walked.append(at)
    every = reduce(DataFrame.unionByName, walked)
    path = F.transform(F.sort_array(F.collect_list("x")), lambda x: F.struct(x["id"].alias("id"), x["rel"].alias("rel")))
    return every.groupBy(*key).agg(path.alias("path"))


def find_path(edges: DataFrame, known: DataFrame, start: str, end: str, most: int = 6) -> list[tuple[str, str]]:
    """(id, rel) along the path between two rows, [] if there is none."""
    one = edges.sparkSession.createDataFrame([(start, end)], "start string, end string")
    hit = find_paths(one, edges, known, most).first()
    return [(x.id, x.rel) for x in hit.path] if hit else []

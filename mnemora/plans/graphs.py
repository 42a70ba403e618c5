"""Walks over links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from .base import Tables, query
from .fixture import name_of

SEEDS = "('m00000000', 'm00000005', 'm00000070', 'm00000035')"


def _seeds(t: Tables):
    return t.m.where(f"id IN {SEEDS}").select(F.col("id").alias("seed"))


@query("join_edges_out", "SELECT src, dst, rel, type FROM ed JOIN m ON m.id = dst")
def join_edges_out(t: Tables):
    return t.e.join(t.m.select(F.col("id").alias("dst"), "type"), "dst").select("src", "dst", "rel", "type")


@query("join_edges_in", "SELECT m.id, count(*) AS n, min(src) AS first_src FROM m JOIN ed ON dst = m.id GROUP BY m.id")
def join_edges_in(t: Tables):
    back = t.e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.min("src").alias("first_src"))
    return t.m.select("id").join(back, "id")


@query("undirected_adjacency", "SELECT DISTINCT a, b, rel FROM (SELECT src AS a, dst AS b, rel FROM ed UNION ALL SELECT dst, src, rel FROM ed)")
def undirected_adjacency(t: Tables):
    return G.undirected(t.e)


def level_sql(d: int) -> str:
    """n{d}(seed, id, pos): nodes first met at level d; r{d}: the links that met them."""
    seen = " UNION ALL ".join(f"SELECT seed, id FROM n{i}" for i in range(d))
    return f""",
j{d} AS (SELECT f.seed, b AS id, pos * 2 + way AS via, rel FROM n{d - 1} f JOIN st ON st.a = f.id
  WHERE NOT EXISTS (SELECT 1 FROM ({seen}) z WHERE z.seed = f.seed AND z.id = b)),
r{d} AS (SELECT DISTINCT j.seed, j.id, rel, j.via FROM j{d} j
  JOIN (SELECT seed, id, min(via) AS via FROM j{d} GROUP BY ALL) f ON f.seed = j.seed AND f.id = j.id AND f.via = j.via),
n{d} AS (SELECT seed, id, row_number() OVER (PARTITION BY seed ORDER BY via, id) AS pos FROM (SELECT DISTINCT seed, id, via FROM r{d}))"""


STEPS = """,
st AS (SELECT src AS a, dst AS b, 0 AS way, rel FROM ed WHERE dst IN (SELECT id FROM m)
  UNION ALL SELECT dst, src, 1, rel FROM ed WHERE src IN (SELECT id FROM m))"""
WALK = STEPS + f", n0 AS (SELECT id AS seed, id, 0 AS pos FROM m WHERE id IN {SEEDS})" + level_sql(1) + level_sql(2) + level_sql(3)


@query("neighbors", WALK + " SELECT seed, id, rel, 1 AS depth FROM r1 UNION ALL SELECT seed, id, rel, 2 FROM r2 UNION ALL SELECT seed, id, rel, 3 FROM r3")
def neighbors(t: Tables):
    return G.neighbors(_seeds(t), t.e, t.m, 3, "both")


OUT = STEPS.replace("UNION ALL SELECT dst, src, 1, rel FROM ed WHERE src IN (SELECT id FROM m)", "") + ", n0 AS (SELECT id AS seed, id, 0 AS pos FROM m)" + level_sql(1)


@query("neighbors_out", OUT + " SELECT seed, id, rel, 1 AS depth FROM r1")
def neighbors_out(t: Tables):
    """Of every row, along links, with all parallel relations."""
    return G.neighbors(t.m.select(F.col("id").alias("seed")), t.e, t.m, 1, "out")


@query(
    "subgraph",
    f""", w(seed, id, d) AS (
      SELECT id, id, 0 FROM m WHERE id IN {SEEDS} UNION SELECT w.seed, dst, d + 1 FROM w JOIN ed ON ed.src = w.id WHERE d < 2)
    SELECT DISTINCT seed, src, dst, rel FROM (SELECT seed, id, min(d) AS d FROM w GROUP BY ALL) s JOIN ed ON ed.src = s.id WHERE d < 2""",
)
def subgraph(t: Tables):
    return G.subgraph(_seeds(t), t.e, 2)


PATHS = """,
pa AS (SELECT DISTINCT a.id AS start, 'm' || lpad((((a.i + k) * 7 + 1) % n)::VARCHAR, 8, '0') AS "end" FROM m a, nn, (VALUES (0), (70)) x(k) WHERE a.i % 5 = 0),
un AS (SELECT DISTINCT a, b, rel FROM (SELECT src AS a, dst AS b, rel FROM ed UNION ALL SELECT dst, src, rel FROM ed)),
w(start, "end", id, path, d) AS (
  SELECT start, "end", start, [start || ':'], 0 FROM pa WHERE "end" IN (SELECT id FROM m)
  UNION ALL SELECT w.start, w."end", b, list_append(path, b || ':' || rel), d + 1 FROM w JOIN un ON un.a = w.id
  WHERE d < 3 AND w.id <> w."end" AND NOT list_contains(list_transform(path, lambda p: split_part(p, ':', 1)), b)),
hit AS (SELECT *, row_number() OVER (PARTITION BY start, "end" ORDER BY d, path) AS r FROM w WHERE id = "end")
SELECT start, "end", array_to_string(path, '>') AS path FROM hit WHERE r = 1"""


@query("find_path", PATHS)
def find_path(t: Tables):
    """From every fifth row to where it points, and to where the seventieth after it does:
    some of these are linked through an id that doesn't exist."""
    n, _ = t.sizes
    to = lambda k: name_of(((F.col("i") + k) * 7 + 1) % n)
    pairs = t.m.where("i % 5 = 0").select(F.col("id").alias("start"), F.explode(F.array(to(0), to(70))).alias("end"))
    found = G.find_paths(pairs, t.e, t.m, 3)
    steps = F.transform("path", lambda p: F.concat(p["id"], F.lit(":"), p["rel"]))
    return found.select("start", "end", F.array_join(steps, ">").alias("path"))

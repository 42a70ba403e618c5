"""Reading as small writes: touches in an append-only delta beside the rows they change.

A recall appends one row a memory it hit. Whoever reads the rows merges the deltas in;
deltas are merged with each other, and at last into the rows, when they have grown, so
that a read meets few of them. A delta row says how often, when last, and by which batch:
counts add up and the last batch's time counts, so deltas may be merged in any grouping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "id string, n bigint, at double, seq bigint"
#: Deltas that a read meets at most before they are merged into one.
DELTAS = 16
#: Rows of deltas, as a share of the table's, from which on they go into the table.
SHARE = 0.125


def delta(hits: DataFrame, now: float, seq: int) -> DataFrame:
    """The delta of one recall: a row for each id in ``hits(id)``, repeats counted."""
    return hits.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).select("id", "n", F.lit(float(now)).alias("at"), F.lit(seq).cast("long").alias("seq"))


def summed(deltas: DataFrame) -> DataFrame:
    """Deltas as one, a row an id. Sums are partial before the shuffle, so that a row that
    everything touches is no task's burden."""
    return deltas.groupBy("id").agg(F.sum("n").alias("n"), F.max_by("at", "seq").alias("at"), F.max("seq").alias("seq"))


def merged(rows: DataFrame, deltas: DataFrame) -> DataFrame:
    """The rows as if each batch had touched them; deltas of rows that are gone are lost."""
    met = rows.join(summed(deltas).select("id", F.col("n").alias("_n"), F.col("at").alias("_at")), "id", "left")
    own = {"access_count": F.col("access_count") + F.coalesce("_n", F.lit(0)), "last_accessed": F.coalesce("_at", "last_accessed")}
    return met.select(*[own[c].alias(c) if c in own else F.col(c) for c in rows.columns])


def folded(rows: DataFrame, deltas: DataFrame, upto: int) -> tuple[DataFrame, DataFrame]:
    """(rows, deltas) with the batches up to ``upto`` in the rows and the later ones left."""
    return merged(rows, deltas.where(F.col("seq") <= upto)), deltas.where(F.col("seq") > upto)


def due(delta_rows: int, table_rows: int, share: float = SHARE) -> bool:
    return delta_rows > share * table_rows

"""Rewriting files of drifted schemas to one evolved schema, matched by Parquet field id.

Rows are sorted by range; the partitions' counts, summed up before each, make places in the
whole of places in a partition, and a place says which file a row belongs to. A file is
written by one task, batch by batch. The rewrite goes over a table of files: a task reads its
file's columns by field id, writes the replacement under another name and reports it; when
all have been reported, replacements are moved over what they replace. Either step may be
run again by another executor: the first starts anew, the second leaves alone what is done.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Callable
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, shared_dir, table

FIELD_ID = b"PARQUET:field_id"
#: Ranges of the sort at most, so that their counts are few.
RANGES = 10_000
#: Files that the report of the files, of a row each, is written in.
FEW = 8
#: Rows that are read and written at once.
BATCH_ROWS = 65_536
#: What a column holds that a file lacks.
MISSING = {"nation_id": -1, "city": "none"}


def evolved_schema(schema: pa.Schema, types: dict[str, pa.DataType]) -> pa.Schema:
    """The schema, nullable, with field ids from 1 and some other types."""
    return pa.schema([pa.field(f.name, types.get(f.name, f.type), True, {FIELD_ID: str(i + 1).encode()}) for i, f in enumerate(schema)])


def version_of(file_no: int) -> int:
    v = zlib.crc32(f"7:{file_no}".encode()) % 24
    return v if v < 16 else 0


def drifted_schema(schema: pa.Schema, version: int) -> pa.Schema:
    """How a version's files name, order and type the evolved schema's columns."""
    fields = list(schema)
    if version & 8:
        types = {"balance": pa.float32(), "nation_id": pa.int32()}
        fields = [f.with_type(types.get(f.name, f.type)) for f in fields]
    if version & 4:
        fields = [f for f in fields if f.name not in MISSING]
    if version & 1:
        names = {"name": "email", "email": "name"}
        fields = [f.with_name(names.get(f.name, f.name)) for f in fields]
    if version & 2:
        fields = [f for f in fields if f.name == "client_id"] + [f for f in reversed(fields) if f.name != "client_id"]
    return pa.schema(fields)


def field_id(field: pa.Field) -> int:
    return int((field.metadata or {}).get(FIELD_ID, -1))


def matched(batch: pa.RecordBatch | pa.Table, schema: pa.Schema, missing: dict[str, object]) -> list[pa.Array]:
    """The schema's columns out of a batch, by field id: cast, or made where it has none."""
    at = {field_id(f): i for i, f in enumerate(batch.schema)}
    out = []
    for f in schema:
        i = at.get(field_id(f))
        if i is None:
            out.append(pa.array([missing[f.name]], f.type).take(pa.array(np.zeros(batch.num_rows, dtype=np.int64))))
        else:
            out.append(batch.column(i).cast(f.type, safe=False))
    return out


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pa.fs.FileSystem.from_uri(path) if urlparse(path).scheme else (pa.fs.LocalFileSystem(), path)


def _name(file_no: int) -> str:
    return f"part-{file_no:05d}.parquet"


def _write_whole(folder: str, name: str, schema: pa.Schema, batches: Callable[[pq.ParquetWriter], None]) -> None:
    """A file that appears under its name only when it is whole."""
    fs, base = _store(folder)
    half = posixpath.join(posixpath.dirname(base), "half", f"{name}-{uuid.uuid4().hex}")
    with fs.open_output_stream(half) as sink, pq.ParquetWriter(sink, schema) as writer:
        batches(writer)
    fs.move(half, posixpath.join(base, name))


def placed(rows: DataFrame, scratch: Scratch, order: list, most: int = RANGES) -> DataFrame:
    """Rows with ``place``, from 0, in the order of the whole.

    A range-partitioned sort is written down; the counts of its partitions, of which
    there are at most ``most``, are summed up and met with their rows.
    """
    spark = rows.sparkSession
    ranges = min(most, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(ranges, *order, "_row").sortWithinPartitions(*order, "_row").drop("_row")
    parts = scratch.keep(parts.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return parts.join(F.broadcast(starts), "_part").withColumn("place", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def write_files(rows: DataFrame, folder: str, schema: pa.Schema, version: Callable[[int], int], n_files: int) -> DataFrame:
    """Writes ``rows(file_no, place, row)``, a file to a task, as its version has it.

    ``row`` is a struct of the evolved schema's columns. Returns file_no of each.
    """

    def run(batches):
        queue = _Runs(batches, schema)
        while queue.more():
            file_no = queue.key
            start = drifted_schema(schema, version(file_no))

            def put(writer, start=start):
                for part in queue.run():
                    writer.write_batch(pa.record_batch(matched(part, start, {}), schema=start))

            _write_whole(folder, _name(file_no), start, put)
            yield pa.record_batch([pa.array([file_no], pa.int64())], names=["file_no"])

    dealt = rows.repartition(n_files, "file_no").sortWithinPartitions("file_no", "place").select("file_no", "row")
    return dealt.mapInArrow(run, "file_no long")


class _Runs:
    """Runs of equal keys in a stream of batches (key, row), of which one is held."""

    def __init__(self, batches, schema: pa.Schema):
        self.batches, self.schema, self.batch, self.at, self.key = iter(batches), schema, None, 0, None

    def more(self) -> bool:
        while self.batch is None or self.at >= self.batch.num_rows:
            self.batch, self.at = next(self.batches, None), 0
            if self.batch is None:
                return False
        self.key = self.batch.column(0)[self.at].as_py()
        return True

    def run(self):
        key = self.key
        while self.more() and self.key == key:
            keys = self.batch.column(0).to_numpy()
            end = self.at + int(np.searchsorted(keys[self.at :], key, side="right"))
            fields = self.batch.column(1).slice(self.at, end - self.at).flatten()
            self.at = end
            yield pa.record_batch([c.cast(f.type) for c, f in zip(fields, self.schema)], schema=self.schema)


def rewrite_files(spark: SparkSession, folder: str, schema: pa.Schema, version: Callable[[int], int], n_files: int, missing: dict[str, object]) -> DataFrame:
    """file_no, version, start_columns, rewritten of each file in ``folder``: a task each
    writes ``schema``'s file for one not of version 0, into a folder beside theirs."""

    def run(batches):
        fs, base = _store(folder)
        for b in batches:
            for file_no in b.column(0).to_pylist():
                with fs.open_input_file(posixpath.join(base, _name(file_no))) as source:
                    file, v = pq.ParquetFile(source), version(file_no)
                    drifted = file.schema_arrow

                    def put(writer, file=file, drifted=drifted):
                        for part in file.iter_batches(BATCH_ROWS):
                            part = pa.RecordBatch.from_arrays(part.columns, schema=drifted)
                            writer.write_batch(pa.record_batch(matched(part, schema, missing), schema=schema))

                    if v:
                        _write_whole(posixpath.join(posixpath.dirname(folder), "new"), _name(file_no), schema, put)
                said = [pa.array([file_no], pa.int64()), pa.array([v], pa.int64()), pa.array([",".join(drifted.names)]), pa.array([v != 0])]
                yield pa.record_batch(said, names=["file_no", "version", "start_columns", "rewritten"])

    return spark.range(0, n_files, 1, n_files).mapInArrow(run, "file_no long, version long, start_columns string, rewritten boolean")


def move_files(spark: SparkSession, folder: str, n_files: int) -> DataFrame:
    """Moves the replacements over the files they replace; what is moved stays so."""

    def run(batches):
        fs, base = _store(folder)
        for b in batches:
            for file_no in b.column(0).to_pylist():
                new = posixpath.join(posixpath.dirname(base), "new", _name(file_no))
                if fs.get_file_info(new).type == pa.fs.FileType.File:
                    fs.move(new, posixpath.join(base, _name(file_no)))
            yield b

    return spark.range(0, n_files, 1, n_files).mapInArrow(run, "id long")


def _scaled(balance: float | None) -> str:
    if balance is None:
        return "?"
    return str(int(np.floor(1048576 * balance))) if np.isfinite(balance) else str(balance)


def digests(path: str, schema: pa.Schema) -> tuple[int, int, str, str, str]:
    """n_rows, n_nulls, ids_sha256, rows_sha256 and columns of a file, read in batches."""
    fs, inner = _store(path)
    rows = nulls = 0
    ids, whole = hashlib.sha256(), hashlib.sha256()
    with fs.open_input_file(inner) as source:
        file = pq.ParquetFile(source)
        names = file.schema_arrow.names
        for part in file.iter_batches(BATCH_ROWS):
            columns = []
            for name in schema.names:
                c = part.column(names.index(name))
                nulls += c.null_count
                if pa.types.is_timestamp(c.type):
                    c = c.cast(pa.timestamp("us", c.type.tz), safe=False).cast(pa.int64())
                if pa.types.is_floating(c.type):
                    columns.append([_scaled(x) for x in c.to_pylist()])
                else:
                    columns.append(pc.fill_null(c.cast(pa.string()), "?").to_pylist())
            ids.update((("," if rows else "") + ",".join(columns[0])).encode() if part.num_rows else b"")
            whole.update((("\n" if rows else "") + "\n".join(map("|".join, zip(*columns)))).encode() if part.num_rows else b"")
            rows += part.num_rows
    return rows, nulls, ids.hexdigest(), whole.hexdigest(), ",".join(names)


def rewrite_drifted(rows: DataFrame, files: int = 1000, version: Callable[[int], int] = version_of) -> DataFrame:
    """file_no, version, n_rows, n_nulls, ids_sha256, rows_sha256, start_columns, columns,
    path, rewritten of each file that ``rows``, a table like clients, ends in.

    Row r in the order of crc32 of client_id's digits, then client_id, goes to file
    r div (1 + N div ``files``). Files start as their version has them and are rewritten
    to the schema of ``rows`` with nation_id as a long and field ids from 1, all in a new
    folder under spark.checkpoint.dir that stays. Null ids come last; rows of one id go by
    their place in the table, so repeated rows all stay. Nulls stay nulls, also of columns
    that a file lacked in no row. A balance that isn't finite is digested by its name. An
    empty table has no files and no rows. Only the ten columns of ``clients`` are written:
    others, whatever they are called, are ignored.
    """
    spark = rows.sparkSession
    scratch, root = Scratch(spark), f"{shared_dir(spark)}/rewrite-{uuid.uuid4().hex}"
    if urlparse(root).scheme == "file":
        root = urlparse(root).path
    rows = rows.select(*COLUMNS)
    arrow = spark.createDataFrame([], rows.schema).toArrow().schema
    schema = evolved_schema(arrow, {"nation_id": pa.int64()})
    n = rows.count()
    if n == 0:
        return spark.createDataFrame([], OUT)
    for sub in ("data", "new", "half"):
        fs, base = _store(f"{root}/{sub}")
        fs.create_dir(base, recursive=True)
    folder, per, n_files = f"{root}/data", 1 + n // files, -(-n // (1 + n // files))
    key = F.crc32(F.col("client_id").cast("string").cast("binary"))
    sorted_ = placed(rows.withColumn("_key", key), scratch, [F.col("_key").asc_nulls_last(), F.col("client_id").asc_nulls_last()])
    long = rows.schema["nation_id"].dataType.typeName() != "long"
    row = F.struct(*[F.col(c).cast("long").alias(c) if long and c == "nation_id" else F.col(c) for c in COLUMNS]).alias("row")
    write_files(sorted_.select(F.expr(f"place div {per}").alias("file_no"), "place", row), folder, schema, version, n_files).count()
    found = scratch.keep(rewrite_files(spark, folder, schema, version, n_files, MISSING).repartition(FEW))
    move_files(spark, folder, n_files).count()  # not before every replacement is whole

    def digest(batches):
        for b in batches:
            paths = [posixpath.join(folder, _name(i)) for i in b.column("file_no").to_pylist()]
            seen = list(zip(*[digests(p, schema) for p in paths])) or [()] * len(_DIGESTS)
            yield pa.record_batch([*b.columns, pa.array(paths, pa.string()), *map(pa.array, seen, _DIGESTS.values())], names=[*b.schema.names, "path", *_DIGESTS])

    columns = [c.split()[0] for c in OUT.split(", ")]
    types = dict(c.split() for c in OUT.split(", "))
    made = [*found.columns, "path", *_DIGESTS]
    return found.repartition(n_files, "file_no").mapInArrow(digest, ", ".join(f"{c} {types[c]}" for c in made)).select(*columns)


_DIGESTS = {"n_rows": pa.int64(), "n_nulls": pa.int64(), "ids_sha256": pa.string(), "rows_sha256": pa.string(), "columns": pa.string()}
COLUMNS = ["client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance"]
OUT = "file_no long, version long, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string, start_columns string, columns string, path string, rewritten boolean"


def op13_schema_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rewrite_drifted`` of all clients, in about a thousand files."""
    return rewrite_drifted(table(spark, sf_dir, "clients"))

"""Exact duplicates: compressed radix tries over length-and-content-hash partitions.

Texts are compared without white space. Every task first puts its own texts into a
trie, so that copies leave it once; what is left is dealt by length and content hash, and
each partition inserts whole byte strings into a trie whose terminals hold the row that
stays and how many rows ended there. A trie that outgrows its bound gives away its
heaviest subtrees, whose strings go to a further round over more partitions, dealt by their own hash too.

A key of very many rows is dealt with a salt first, so that no task meets all of it: such
keys hold more than a fixed share of all rows each, so there are few, and they alone are
broadcast. Rows then find their terminal by length and SHA-256, by an ordinary join that
adaptive execution can split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, tidied

#: What is deleted before texts are compared.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of strings and nodes that a trie holds before it gives subtrees away.
SPILL_BYTES = 256 << 20
#: The same for the tries that tasks fill before the shuffle.
LOCAL_BYTES = 32 << 20
#: A key is salted if it has more rows than this, and more than a SHARE-th of all.
HOT_ROWS, SHARE = 1_000, 100_000
#: Memory that a node takes beside its label, about.
NODE_BYTES = 200
#: Bytes of texts in a batch that leaves a task.
BATCH_BYTES = 8 << 20


class Node:
    __slots__ = ("label", "children", "value", "weight")

    def __init__(self, label: bytes, value=None):
        self.label, self.children, self.value = label, {}, value
        self.weight = len(label) + NODE_BYTES


def _shared(label: bytes, key: bytes, at: int) -> int:
    """How many leading bytes of ``label`` follow in ``key`` from ``at`` on, less than all."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:  # label[:low] is shared
        mid = (low + high + 1) // 2
        if label[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """Byte strings with values; ``merge`` makes one of the values of equal strings."""

    def __init__(self, merge):
        self.root, self.merge, self.terminals = Node(b""), merge, 0
        self.given: set[bytes] = set()

    @property
    def weight(self) -> int:
        return self.root.weight

    def add(self, key: bytes, value) -> None:
        node, at, path = self.root, 0, [self.root]
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = new = Node(key[at:], value)
                self._grown(path, new.weight)
                self.terminals += 1
                return
            if not key.startswith(child.label, at):
                n = _shared(child.label, key, at)
                upper = Node(child.label[:n])
                upper.children[child.label[n]] = child
                upper.weight = child.weight + NODE_BYTES
                node.children[key[at]] = upper
                child.label, child.weight = child.label[n:], child.weight - n
                self._grown(path, NODE_BYTES)
                child = upper
            node, at = child, at + len(child.label)
            path.append(node)
        if node.value is None:
            node.value = value
            self.terminals += 1
        else:
            node.value = self.merge(node.value, value)

    @staticmethod
    def _grown(path: list[Node], by: int) -> None:
        for node in path:
            node.weight += by

    def items(self, top: Node | None = None, before: bytes = b"") -> Iterator[tuple[bytes, tuple]]:
        """The strings of a subtree with their values, in order."""
        stack = [(top or self.root, before)]
        while stack:
            node, prefix = stack.pop()
            prefix += node.label
            if node.value is not None:
                yield prefix, node.value
            stack.extend((node.children[b], prefix) for b in sorted(node.children, reverse=True))

    def spill(self, most: int) -> Iterator[tuple[bytes, tuple]]:
        """Gives away the heaviest subtrees until ``most`` bytes are left, or one string."""
        while self.weight > most and self.terminals > 1:
            path, before = [self.root], b""
            while path[-1].children:
                heaviest = max(path[-1].children.values(), key=lambda n: n.weight)
                if len(path) > 1 and heaviest.weight < 0.75 * path[-1].weight:
                    break
                before += path[-1].label
                path.append(heaviest)
            for found in self.items(path[-1], before):
                self.terminals -= 1
                yield found
            self.given.add(before + path[-1].label[:1])
            while len(path) > 1:  # empty nodes above go too
                node = path.pop()
                del path[-1].children[node.label[0]]
                self._grown(path, -node.weight)
                if path[-1].children or path[-1].value is not None:
                    break

    def was_given(self, key: bytes) -> bool:
        """Whether strings of the key's subtree were given away before."""
        return any(key[:n] in self.given for n in {len(g) for g in self.given})


def normalized(text: bytes | None) -> bytes:
    return (text or b"").translate(None, BLANKS)


def _better(one: tuple, two: tuple) -> tuple:
    """Values are (-code points, whether the id is null, id, rows, rows as good, open, SHA-256)."""
    a, b = one[:3], two[:3]
    as_good = one[4] + two[4] if a == b else one[4] if a < b else two[4]
    return (*min(a, b), one[3] + two[3], as_good, *one[5:])


SCHEMA = "n_bytes long, h long, sha binary, chars long, owner long, n long, as_good long, open boolean, text binary"
_ARROW = pa.schema([("n_bytes", pa.int64()), ("h", pa.int64()), ("sha", pa.binary()), ("chars", pa.int64()), ("owner", pa.int64()), ("n", pa.int64()), ("as_good", pa.int64()), ("open", pa.bool_()), ("text", pa.binary())])


def _hash(sha: bytes, bits: int) -> int:
    return int.from_bytes(sha[:8], "big", signed=True) >> (64 - bits) if bits else 0


class _Out:
    """Terminals on their way out, as batches of bounded size."""

    def __init__(self, bits: int):
        self.bits, self.rows, self.size = bits, [], 0

    def add(self, key: bytes, value: tuple, is_open: bool) -> None:
        less, null, owner, n, as_good, _, sha = value
        self.rows.append((len(key), _hash(sha, self.bits), sha, -less, None if null else owner, n, as_good, is_open, key if is_open else None))
        self.size += len(key) if is_open else 64

    def full(self) -> Iterator[pa.RecordBatch]:
        if self.size > BATCH_BYTES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*self.rows), _ARROW.types)], schema=_ARROW)
        self.rows, self.size = [], 0


def _members(docs: DataFrame, bits: int) -> DataFrame:
    """doc_id, chars, n_bytes, h, sha of every row."""
    names = ["doc_id", "chars", "n_bytes", "h", "sha"]

    def run(batches):
        for b in batches:
            chars = pc.fill_null(pc.utf8_length(b.column(1)), 0).cast(pa.int64())
            sizes, shas = [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                text = normalized(text)
                sizes.append(len(text))
                shas.append(hashlib.sha256(text).digest())
            yield pa.record_batch([b.column(0), chars, pa.array(sizes, pa.int64()), pa.array([_hash(s, bits) for s in shas], pa.int64()), pa.array(shas, pa.binary())], names=names)

    return docs.mapInArrow(tidied(run), "doc_id long, chars long, n_bytes long, h long, sha binary")


def _local(docs: DataFrame, bits: int, most: int) -> DataFrame:
    """The distinct texts of each task, by a trie that starts anew when it is full."""

    def run(batches):
        out, trie = _Out(bits), Trie(_better)
        for b in batches:
            chars = pc.fill_null(pc.utf8_length(b.column(1)), 0).to_pylist()
            for doc_id, n, text in zip(b.column(0).to_pylist(), chars, b.column(1).cast(pa.binary()).to_pylist()):
                text = normalized(text)
                trie.add(text, (-n, doc_id is None, doc_id or 0, 1, 1, True, hashlib.sha256(text).digest()))
                if trie.weight > most:
                    for key, value in trie.items():
                        out.add(key, value, True)
                        yield from out.full()
                    trie = Trie(_better)
        for key, value in trie.items():
            out.add(key, value, True)
            yield from out.full()
        yield from out.rest()

    return docs.mapInArrow(tidied(run), SCHEMA)


def _tries(rows: DataFrame, bits: int, most: int) -> DataFrame:
    """A partition's strings in one trie. Rows that are open, because of a salt or since
    their subtree was given away, leave with their text and go to another round."""

    def run(batches):
        out, trie = _Out(bits), Trie(_better)
        for b in batches:
            for _, _, sha, chars, owner, n, as_good, is_open, text in zip(*(c.to_pylist() for c in b.columns)):
                trie.add(text, (-chars, owner is None, owner or 0, n, as_good, is_open, sha))
                if trie.weight > most:
                    for key, value in trie.spill(most // 2):
                        out.add(key, value, True)
                        yield from out.full()
            yield from out.full()
        for key, value in trie.items():
            out.add(key, value, value[5] or trie.was_given(key))
            yield from out.full()
        yield from out.rest()

    return rows.mapInArrow(tidied(run), SCHEMA)


def exact_duplicates(docs: DataFrame, spill_bytes: int = SPILL_BYTES, local_bytes: int = LOCAL_BYTES, hot_rows: int = HOT_ROWS, hash_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of ``docs(doc_id, text)``.

    Texts are equal if they are the same without white space. The row with the most
    code points stays, then the one with the smallest doc_id; a null doc_id comes after
    all others. Null texts count as empty, and all empty ones are one group. Of repeated
    rows that are as good in both, one stays. An empty table has no rows; other columns
    are ignored. ``hash_bits`` is how much of the content hash deals the texts out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    members = scratch.keep(_members(docs, hash_bits).withColumn("row", F.monotonically_increasing_id()))
    n, size = members.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    hot = members.groupBy("n_bytes", "h").agg(F.count("*").alias("c")).where(F.col("c") > max(hot_rows, n // SHARE))
    hot = hot.select("n_bytes", "h", F.ceil(F.sqrt("c")).cast("long").alias("salts"))  # fewer than SHARE rows
    rows = _local(docs, hash_bits, local_bytes).join(F.broadcast(hot), ["n_bytes", "h"], "left")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("owner", "chars"), F.coalesce("salts", F.lit(1)))).withColumn("open", F.col("salts").isNotNull())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * size // spill_bytes + 1)
    columns, done, level = [c.split()[0] for c in SCHEMA.split(", ")], [], 0
    left = rows.repartition(parts, "n_bytes", "h", "salt").select(*columns)
    while True:
        found = scratch.keep(_tries(left, hash_bits, spill_bytes))
        done.append(found.where("NOT open").drop("open", "text"))
        again, level, parts = found.where("open"), level + 1, 2 * parts
        count = again.count()
        if not count:
            break
        left = again.withColumn("open", F.lit(False)).select(*columns).repartition(min(parts, count), F.xxhash64(F.lit(level), "n_bytes", "h", "text"))
    owners = reduce(DataFrame.unionAll, done).select("n_bytes", "sha", "owner", F.col("chars").alias("most"), "n", "as_good")
    met = members.join(owners, ["n_bytes", "sha"])
    best = (F.col("chars") == F.col("most")) & F.col("doc_id").eqNullSafe(F.col("owner"))
    kept = best
    if not owners.where("as_good > 1").isEmpty():
        firsts = met.where((F.col("as_good") > 1) & best).groupBy("n_bytes", "sha").agg(F.min("row").alias("first"))
        met = members.join(owners.join(firsts, ["n_bytes", "sha"], "left"), ["n_bytes", "sha"])
        kept = best & (F.col("row") == F.coalesce("first", "row"))
    return met.select("doc_id", F.col("owner").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op11_exact_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``exact_duplicates`` of all documents."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-chars, doc_id)) AS keep_id FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)"""

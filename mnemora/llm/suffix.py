"""Removal of long passages seen before, by a logarithmic family of suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts in a document of
smaller id. Suffixes are sampled by content: of the K-grams in every LENGTH-byte
window the least by hash is its anchor, so equal windows have equal anchors, and
the windows of one anchor that follow each other form a run. A run's piece is the
text of its windows, and the piece's suffix at the anchor is what is sorted.

1. Copies of a whole text, by SHA-256 and length, go whole; the first one stays.
2. Each batch of the other texts notes where its anchors are. Anchors that several of
   its documents have are called for at once; of the rest, hashes go to shards, which
   call for those that several batches have. Equal hashes only propose.
3. Documents meet the calls and give the called runs' pieces. A batch of pieces gets
   a suffix array; pieces equal to one of a smaller document are settled there, and
   the others go to their anchor's shard.
4. A shard takes its pieces by rising doc_id, in batches. Each batch gets a suffix
   array, is merge-scanned against every level of the family, and becomes a level;
   levels of one size class are merged. Where pieces share an anchor's K bytes and
   differ, their windows are sorted by their LENGTH bytes, anchor offset by offset.
5. Documents meet what was settled, drop the bytes and are done.

What is settled is settled by comparing bytes. All meetings are joins by document
and share one shuffle of the texts.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hand_back, table, tidied
from .rolling import PIECE, gram_hashes, mix, prefix, window_minima

LENGTH, K = 50, 20
#: Bytes of text whose anchors one shard is meant to hold, and whose pieces another.
SHARD_BYTES, PIECE_BYTES = 16 << 20, 8 << 20
#: Bytes of text whose anchors or pieces a task holds at a time.
BATCH_BYTES = 8 << 20
#: Pieces that a shard sorts at a time.
BATCH_PIECES = 1 << 16
#: A batch deals its anchors to so many buckets at most, each of them again, and so on.
FAN = 256

#: Offsets of windows in a piece, and a piece as a row of bytes: what follows the
#: anchor, what precedes it, nearest byte first, and the lengths of both.
OFFSETS = LENGTH - K + 1
LEFT = LENGTH - K
WIDTH = LENGTH + LEFT + 2
ROW, GRAM = f"S{WIDTH}", f"S{K}"


def runs(raw: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per run of windows: first and last window start, its anchor, the hash of the
    anchor's gram."""
    n = len(raw)
    if n < length:
        z = np.empty(0, dtype=np.int64)
        return z, z, z, z.view(np.uint64)
    parts = []
    for start in range(0, n - length + 1, PIECE):
        pre = prefix(raw[start : start + PIECE + length - 1])
        grams = gram_hashes(pre, k)
        anchor = window_minima(grams, length - k + 1)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        last = np.append(first[1:], len(anchor)) - 1
        at = anchor[first]
        # Chosen hashes are small ones; mixed again they spread evenly over shards.
        parts.append((first + start, last + start, at + start, mix(grams[at])))
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(4))


def _pack(*columns: np.ndarray) -> bytes:
    """Columns as byte planes, compressed: high bytes of small numbers cost little."""
    head = np.array([len(columns[0]), *(c.dtype.itemsize for c in columns)], dtype="<i4")
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)
    return len(head).to_bytes(1, "little") + head.tobytes() + zlib.compress(planes, 1)


def _unpack(data: bytes) -> list[np.ndarray]:
    n = data[0]
    head = np.frombuffer(data, dtype="<i4", count=n, offset=1)
    planes, at, out = np.frombuffer(zlib.decompress(data[1 + 4 * n :]), dtype=np.uint8), 0, []
    for width in head[1:].tolist():
        size = int(head[0]) * width
        out.append(np.ascontiguousarray(planes[at : at + size].reshape(width, -1).T).reshape(-1).view(f"<u{width}"))
        at += size
    return out


# --- anchors -------------------------------------------------------------------


@dataclass
class Anchors:
    """Anchors of a batch, sorted by hash: ``a``, the document's index in ``ids`` and
    ``th``, the run's first window, its number of windows, and the anchor's distance
    from the first. Index ``CALLED`` stands for documents that are called for already."""

    ids: np.ndarray
    th: np.ndarray
    a: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    n: np.ndarray
    off: np.ndarray

    CALLED = np.uint32(2**32 - 1)

    def part(self, at) -> Anchors:
        """Some anchors and their documents."""
        used, doc = np.unique(self.doc[at], return_inverse=True)
        if len(used) and used[-1] == self.CALLED:
            used, doc = used[:-1], np.where(doc == len(used) - 1, self.CALLED, doc)
        return Anchors(self.ids[used], self.th[used], self.a[at], doc.astype(np.uint32), self.first[at], self.n[at], self.off[at])

    def packed(self) -> bytes:
        owners = _pack(self.ids.view(np.uint64), self.th.view(np.uint32))
        return len(owners).to_bytes(4, "little") + owners + _pack(np.diff(self.a, prepend=np.uint64(0)), self.doc, self.first, self.n, self.off)

    @classmethod
    def joined(cls, blobs) -> Anchors:
        """Of all blobs, no longer sorted."""
        parts, base = [], 0
        for blob in blobs:
            size = 4 + int.from_bytes(blob[:4], "little")
            ids, th = _unpack(blob[4:size])
            a, doc, first, n, off = _unpack(blob[size:])
            doc = np.where(doc == cls.CALLED, cls.CALLED, doc + np.uint32(base)).astype(np.uint32)
            parts.append((ids.view(np.int64), th.view(np.int32), np.cumsum(a, dtype=np.uint64), doc, first, n, off))
            base += len(ids)
        return cls(*(np.concatenate([p[i] for p in parts]) for i in range(7)))

    def dealt(self, bits: int, shards: int, width: int):
        """(bucket, blob) for each bucket of ``width`` neighbouring shards; needs sorted anchors."""
        shard = ((self.a >> np.uint64(bits - 32)) * np.uint64(shards) >> np.uint64(32)) // np.uint64(width)
        cuts = np.flatnonzero(np.diff(shard)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(shard)]):
            if lo < hi:
                yield int(shard[lo]), self.part(slice(lo, hi)).packed()

    def calls(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc_id, th, run) of the anchors ``which``, a run as first << 16 | n << 8 | off."""
        doc = self.doc[which]
        run = self.first[which].astype(np.int64) << 16 | self.n[which].astype(np.int64) << 8 | self.off[which].astype(np.int64)
        return self.ids[doc], self.th[doc], run


def _shared(found: Anchors) -> tuple[Anchors, np.ndarray]:
    """The anchors sorted, and which of them several documents have."""
    order = np.lexsort((found.doc, found.a))
    found = Anchors(found.ids, found.th, *(x[order] for x in (found.a, found.doc, found.first, found.n, found.off)))
    if not len(order):
        return found, np.empty(0, dtype=bool)
    start = np.flatnonzero(np.concatenate(([True], found.a[1:] != found.a[:-1])))
    size = np.diff(np.append(start, len(order)))
    # Two indices may be rows of one doc_id: harmless, as owners are compared later.
    last = found.doc[start + size - 1]
    return found, np.repeat((found.doc[start] != last) | (last == Anchors.CALLED), size)


#: Calls name a document and its run; anchors are blobs.
_ROW = "bucket long, doc_id long, th int, run long, data binary"
_TYPES = {"bucket": pa.int64(), "doc_id": pa.int64(), "th": pa.int32(), "run": pa.int64(), "data": pa.binary()}


def _rows(n: int, **columns):
    """Batches of n rows; columns that aren't given are null."""
    for at in range(0, n, 50_000 if "run" in columns else 500):
        end = min(n, at + (50_000 if "run" in columns else 500))
        yield pa.record_batch([pa.array(columns[c][at:end], t) if c in columns else pa.nulls(end - at, t) for c, t in _TYPES.items()], names=list(_TYPES))


def _blobs(dealt):
    rows = list(dealt)
    return _rows(len(rows), bucket=[x[0] for x in rows], data=[x[1] for x in rows])


def _slices(batch: pa.RecordBatch, column: int = 2):
    """Stretches of a batch of at most BATCH_BYTES of text, one document at least."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _scan_batches(shards: int, width: int, bits: int):
    """Step 2 for each batch of (doc_id, th, text): calls, and anchors for shards.

    Calls go by way of the shards too, so that each batch is scanned once and what is
    called and what is passed on belong to the same batch.
    """
    keep, buckets = np.uint64(64 - bits), -(-shards // width)

    def run(batches):
        for batch in chain.from_iterable(map(_slices, batches)):
            parts = []
            for i, (id_, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if id_ is None or text is None:
                    continue
                first, last, at, a = runs(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8))
                parts.append((a >> keep, np.full(len(first), i, dtype=np.uint32), first.astype(np.uint64), (last - first + 1).astype(np.uint8), (at - first).astype(np.uint8)))
            if not parts:
                continue
            ids, th = (batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in (0, 1))
            found, shared = _shared(Anchors(ids, th, *(np.concatenate([p[i] for p in parts]) for i in range(5))))
            del parts
            ids, th, run = found.calls(np.flatnonzero(shared))
            yield from _rows(len(ids), bucket=ids % buckets, doc_id=ids, th=th, run=run)
            # Of an anchor that is called for here, shards learn only that it is.
            stay = ~shared
            stay[1:] |= found.a[1:] != found.a[:-1]
            stay[:1] = True
            for x, none in ((found.doc, Anchors.CALLED), (found.first, 0), (found.n, 0), (found.off, 0)):
                x[shared] = none
            yield from _blobs(found.part(np.flatnonzero(stay)).dealt(bits, shards, width))

    return run


def _deal_again(shards: int, width: int, bits: int):
    """Buckets of blobs, sorted by bucket, to buckets of ``width`` shards."""
    buckets = -(-shards // width)

    def run(batches):
        held, size, at = [], 0, None

        def out():
            found, _ = _shared(Anchors.joined(held))
            return _blobs(found.dealt(bits, shards, width))

        for batch in batches:
            made = batch.filter(batch.column(1).is_valid())
            ids = made.column(1).to_numpy()
            yield from _rows(len(ids), bucket=ids % buckets, doc_id=ids, th=made.column(2).to_numpy(), run=made.column(3).to_numpy())
            blobs = batch.filter(batch.column(1).is_null())
            for bucket, blob in zip(blobs.column(0).to_pylist(), blobs.column(4).to_pylist()):
                if held and (bucket != at or size >= BATCH_BYTES):
                    yield from out()
                    held, size = [], 0
                held.append(blob)
                size, at = size + len(blob), bucket
        if held:
            yield from out()

    return run


def _call_shared(group: pa.Table) -> pa.Table:
    """Step 2's shards: calls for the runs whose anchors several batches have, beside
    those that are made already."""
    made = group.filter(group["doc_id"].is_valid()).select(["doc_id", "th", "run"])
    blobs = group["data"].filter(group["doc_id"].is_null()).to_pylist()
    if not blobs:
        return made
    found, shared = _shared(Anchors.joined(blobs))
    own = found.calls(np.flatnonzero(shared & (found.doc != Anchors.CALLED)))
    del found, shared, blobs
    hand_back()
    return pa.concat_tables([made, pa.table([pa.array(x, f.type) for x, f in zip(own, made.schema)], schema=made.schema)])


# --- pieces ----------------------------------------------------------------------


def piece_rows(raw: np.ndarray, base: np.ndarray, first: np.ndarray, n: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The pieces of runs as rows of WIDTH bytes; ``base`` is where a run's text starts in raw."""
    at = base + first + off
    right = (first + n - 1 + LENGTH) - (first + off)
    out = np.zeros((len(first), WIDTH), dtype=np.uint8)
    where = at[:, None] + np.arange(LENGTH)
    inside = np.arange(LENGTH) < right[:, None]
    out[:, :LENGTH] = np.where(inside, raw[np.minimum(where, len(raw) - 1)], 0)
    where = at[:, None] - 1 - np.arange(LEFT)
    inside = np.arange(LEFT) < off[:, None]
    out[:, LENGTH : LENGTH + LEFT] = np.where(inside, raw[np.maximum(where, 0)], 0)
    out[:, -2], out[:, -1] = right, off
    return out


def _sorted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, which of the ordered rows differ from the one before): a suffix array
    whose rows are compared as unsigned bytes; the sort is stable."""
    keys = rows.view(ROW).reshape(-1)
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(order), dtype=bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    return order, new


class Level:
    """A suffix array: distinct rows in order, each with its smallest owner."""

    def __init__(self, rows: np.ndarray, owner: np.ndarray):
        self.rows, self.owner = rows, owner
        self.keys = rows.view(ROW).reshape(-1)
        self.grams = np.ascontiguousarray(rows[:, :K]).view(GRAM).reshape(-1)

    def merged(self, other: Level) -> Level:
        """Both in one, in time linear in their sizes but for the search of places."""
        to = np.searchsorted(self.keys, other.keys) + np.arange(len(other.keys))
        rows, owner = np.empty((len(to) + len(self.keys), WIDTH), dtype=np.uint8), np.empty(len(to) + len(self.keys), dtype=np.int64)
        rest = np.ones(len(rows), dtype=bool)
        rest[to] = False
        rows[to], rows[rest], owner[to], owner[rest] = other.rows, self.rows, other.owner, self.owner
        return Level(rows, owner)


def _windows(rows: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each row a bit mask of the window offsets at which a smaller owner has the
    same window. Windows of one content have one offset from their anchor."""
    out = np.zeros(len(rows), dtype=np.uint32)
    right, left = rows[:, -2], rows[:, -1]
    for back in range(OFFSETS):
        at = np.flatnonzero((left >= back) & (right >= LENGTH - back))
        if len(at) < 2:
            continue
        keys = np.empty((len(at), LENGTH), dtype=np.uint8)
        keys[:, : LENGTH - back] = rows[at, : LENGTH - back]
        keys[:, LENGTH - back :] = rows[at, LENGTH : LENGTH + back]
        keys = keys.view(f"S{LENGTH}").reshape(-1)
        order = np.argsort(keys, kind="stable")
        start = np.flatnonzero(np.concatenate(([True], keys[order[1:]] != keys[order[:-1]])))
        least = np.repeat(np.minimum.reduceat(owner[at[order]], start), np.diff(np.append(start, len(at))))
        gone = at[order][owner[at[order]] > least]
        out[gone] |= np.uint32(1 << back)
    return out


#: Every window of a run.
WHOLE = np.uint32(2**32 - 1)


class Family:
    """A logarithmic family of suffix arrays. Batches must come by rising owner."""

    def __init__(self):
        self.levels: dict[int, Level] = {}

    def scan(self, rows: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Masks of the windows that smaller owners have, of rows that are then added."""
        if not len(rows):
            return np.empty(0, dtype=np.uint32)
        order, new = _sorted(rows)
        head = np.cumsum(new) - 1  # the distinct row of each ordered one
        own = order[new]  # the first of equal ones, of the smallest owner
        mine = Level(rows[own], owner[own])
        gram = np.cumsum(np.concatenate(([True], mine.grams[1:] != mine.grams[:-1]))) - 1
        variants = np.bincount(gram)
        seen, met = np.zeros(len(own), dtype=bool), []
        least = mine.owner.copy()
        for level in self.levels.values():
            lo, hi = (np.searchsorted(level.grams, mine.grams, side=s) for s in ("left", "right"))
            at = np.minimum(np.searchsorted(level.keys, mine.keys), len(level.keys) - 1)
            same = level.keys[at] == mine.keys
            seen |= same
            least[same] = np.minimum(least[same], level.owner[at[same]])
            first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
            # Rows here that this batch repeats are variants that are counted already.
            variants += (hi - lo)[first] - np.bincount(gram, weights=same, minlength=len(first)).astype(np.int64)
            met.append((level, lo, hi))
        mask = np.zeros(len(own), dtype=np.uint32)
        mask[least < mine.owner] = WHOLE
        mixed = variants[gram] > 1
        ours = np.flatnonzero(mixed & (mask != WHOLE))
        if len(ours):
            all_rows, all_owner = [mine.rows[ours]], [mine.owner[ours]]
            for level, lo, hi in met:
                wanted = np.zeros(len(level.keys) + 1, dtype=np.int64)
                np.add.at(wanted, lo[ours], 1)
                np.add.at(wanted, hi[ours], -1)
                wanted = np.cumsum(wanted[:-1]) > 0
                all_rows.append(level.rows[wanted])
                all_owner.append(level.owner[wanted])
            mask[ours] = _windows(np.concatenate(all_rows), np.concatenate(all_owner))[: len(ours)]
        out = np.empty(len(rows), dtype=np.uint32)
        out[order] = np.where(owner[order] > mine.owner[head], WHOLE, mask[head])
        fresh = Level(mine.rows[~seen], mine.owner[~seen])
        if len(fresh.keys):
            while (size := len(fresh.keys).bit_length()) in self.levels:
                fresh = self.levels.pop(size).merged(fresh)
            self.levels[size] = fresh
        return out


def _settled_spans(ids, th, first, n, off, mask):
    """(doc_id, th, span) of windows that go, a span as start << 8 | number of windows."""
    whole = mask == WHOLE
    some = np.flatnonzero((mask != 0) & ~whole)
    bits = np.zeros((len(some), OFFSETS + 2), dtype=np.int8)
    bits[:, 1:-1] = mask[some][:, None] >> np.arange(OFFSETS, dtype=np.uint32) & 1
    edge = np.diff(bits, axis=1)
    row, low = np.nonzero(edge == 1)  # offsets from low to high - 1, and so starts that follow each other
    _, high = np.nonzero(edge == -1)
    part = some[row]
    which = np.concatenate((np.flatnonzero(whole), part))
    start = np.concatenate((first[whole], first[part] + off[part] - high + 1))
    return ids[which], th[which], start << 8 | np.concatenate((n[whole], high - low))


def _spans(found) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int32(), pa.int64()))], names=["doc_id", "th", "span"])


_PIECE_ROW = "doc_id long, th int, at long, piece binary"


def _called_pieces(batches):
    """Step 3: the pieces that go on to shards, with the run's first window, and settled
    spans (piece null)."""
    names = ["doc_id", "th", "at", "piece"]
    for batch in chain.from_iterable(_slices(b) for b in batches):
        texts, parts, base = [], [], 0
        for i, (text, calls) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            texts.append(text.encode("utf-8", "replace"))
            run = np.array(calls, dtype=np.int64)
            parts.append((np.full(len(run), i), np.full(len(run), base), run >> 16, run >> 8 & 255, run & 255))
            base += len(texts[-1])
        raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
        doc, base, first, n, off = (np.concatenate([p[i] for p in parts]) for i in range(5))
        ids, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        ids, th = ids[doc], th[doc]
        by_id = np.argsort(ids, kind="stable")  # so that the first of equal rows has the smallest owner
        base, ids, th, first, n, off = (x[by_id] for x in (base, ids, th, first, n, off))
        for lo in range(0, len(ids), BATCH_PIECES):
            s = slice(lo, lo + BATCH_PIECES)
            rows = piece_rows(raw, base[s], first[s], n[s], off[s])
            order, new = _sorted(rows)
            head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            gone = np.zeros(len(order), dtype=bool)
            gone[order] = ids[s][order] > ids[s][order[head]]
            done = _spans(_settled_spans(ids[s], th[s], first[s], n[s], off[s], np.where(gone, WHOLE, np.uint32(0))))
            yield pa.record_batch([*done.columns, pa.nulls(done.num_rows, pa.binary())], names=names)
            go = np.flatnonzero(~gone)
            sent = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDTH), len(go), [None, pa.py_buffer(np.ascontiguousarray(rows[go]))]).cast(pa.binary())
            yield pa.record_batch([pa.array(ids[s][go]), pa.array(th[s][go]), pa.array(first[s][go]), sent], names=names)


def _settle_pieces(batches):
    """Step 4: a family of one partition's pieces, which come by rising doc_id. What is
    settled already goes through."""
    family, held, size = Family(), [], 0

    def out():
        t = pa.Table.from_batches(held).combine_chunks()
        ids, th, first = (t.column(i).to_numpy() for i in range(3))
        rows = np.frombuffer(b"".join(t.column(3).to_pylist()), dtype=np.uint8).reshape(-1, WIDTH)
        off = rows[:, -1].astype(np.int64)
        return _spans(_settled_spans(ids, th, first, rows[:, -2] + off - LENGTH + 1, off, family.scan(rows, ids)))

    for batch in batches:
        done = batch.filter(batch.column(3).is_null())
        yield pa.record_batch(done.columns[:3], names=["doc_id", "th", "span"])
        batch = batch.filter(batch.column(3).is_valid())
        held.append(batch)
        size += batch.num_rows
        if size >= BATCH_PIECES:
            yield out()
            held, size = [], 0
    if size:
        yield out()


# --- documents -------------------------------------------------------------------


#: The span of a text that goes whole.
ALL = -1


def _cut(text: str | None, spans) -> tuple[bytes, bytes, int, int]:
    """(whole, kept, removed bytes, maximal removed runs)."""
    raw = (text or "").encode("utf-8", "replace")
    if not spans or len(raw) < LENGTH:
        return raw, raw, 0, 0
    spans = np.array(spans, dtype=np.int64)
    if spans.min() == ALL:
        return raw, b"", len(raw), 1
    edge = np.zeros(len(raw) + 1, dtype=np.int64)
    np.add.at(edge, spans >> 8, 1)
    np.add.at(edge, (spans >> 8) + (spans & 255) - 1 + LENGTH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    n = int(np.count_nonzero(np.diff(gone.view(np.int8), prepend=0) == 1))
    kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
    return raw, kept, len(raw) - len(kept), n


NO_ID = -(2**63)


def _settled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts by (key, th), what goes of them as (key, th, spans))."""
    spark = docs.sparkSession
    # Keys that can't be null, so that all joins see the same exchange of the texts.
    keyed = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("key", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("th", F.hash("text"))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, bits = max(1, -(-n_bytes // SHARD_BYTES)), max(40, n_bytes.bit_length() + 10)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // PIECE_BYTES))
    # As many partitions as the joins' other sides have, or these would be dealt anew.
    texts = keyed.repartition("key", "th")
    usable = F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)
    same = ["sha", "size"]
    scratch = Scratch(spark)
    hashed = scratch.keep(keyed.where(usable).select("doc_id", "th", F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").alias("size")))
    several = hashed.groupBy(*same).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select(*same, "low")
    copies = scratch.keep(hashed.join(several, same).where("doc_id > low").select(F.col("doc_id").alias("key"), "th").distinct())
    scratch.drop(hashed)
    # A filter of the texts, or an anti join, would be pushed below their exchange, which
    # then isn't shared.
    source = texts.join(copies.withColumn("copy", F.lit(True)).hint("merge"), ["key", "th"], "left").where("copy IS NULL").select("doc_id", "th", "text")
    width = 1
    while -(-shards // width) > FAN:
        width *= FAN
    noted = source.mapInArrow(tidied(_scan_batches(shards, width, bits)), _ROW)
    while width > 1:
        width //= FAN
        noted = noted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidied(_deal_again(shards, width, bits)), _ROW)
    calls = noted.groupBy("bucket").applyInArrow(_call_shared, "doc_id long, th int, run long")
    calls = calls.groupBy(F.col("doc_id").alias("key"), "th").agg(F.collect_list("run").alias("calls"))
    pieces = texts.join(calls.hint("merge"), ["key", "th"]).select("doc_id", "th", "text", "calls").mapInArrow(tidied(_called_pieces), _PIECE_ROW)
    anchored = F.when(F.col("piece").isNotNull(), F.xxhash64(F.substring("piece", 1, K))).otherwise(F.col("doc_id"))
    pieces = pieces.repartition(parts, anchored).sortWithinPartitions("doc_id")
    gone = pieces.mapInArrow(tidied(_settle_pieces), "doc_id long, th int, span long").select(F.col("doc_id").alias("key"), "th", "span")
    gone = gone.unionAll(copies.select("key", "th", F.lit(ALL).cast("long").alias("span")))
    return texts, gone.groupBy("key", "th").agg(F.collect_list("span").alias("spans"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without the repeated bytes; all its columns are kept.

    text is what is left (cut sequences of bytes become U+FFFD), n_chars, if there,
    is counted anew. A null text stays null, an empty one empty. A row without doc_id
    keeps its text and is no source of matches; rows of one doc_id don't match each
    other, so that repeated rows lose the same bytes. An empty table stays empty.
    """
    names = docs.columns
    rest = F.struct(F.lit(0).alias("_" * (1 + max(map(len, names)))), *[F.col(f"`{c}`") for c in names if c != "text"])
    texts, gone = _settled(docs.select(rest.alias("row"), "doc_id", "text"))
    met = texts.join(gone.hint("merge"), ["key", "th"], "left").select("row", "text", "spans")

    def run(batches):
        for batch in batches:
            rows, old, spans = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            new = [t if not x else _cut(t, x)[1].decode("utf-8", "replace") for t, x in zip(old, spans)]
            size = pa.array([None if t is None else len(t) for t in new], pa.int64())
            own = {"text": pa.array(new, batch.column(1).type), "n_chars": size.cast(rows.type.field("n_chars").type) if "n_chars" in names else size}
            yield pa.record_batch([own[c] if c in own else rows.field(c) for c in names], names=names)

    return met.mapInArrow(tidied(run), docs.schema)


def op8_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of what ``remove_repeats`` leaves; null texts count as empty."""
    texts, gone = _settled(table(spark, sf_dir, "documents").select("doc_id", "text"))
    met = texts.join(gone.hint("merge"), ["key", "th"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            done = [_cut(t, x) for t, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.record_batch(
                [batch.column(0), *(pa.array([f(x) for x in done], t) for f, t in ((lambda x: len(x[0]), pa.int64()), (lambda x: x[2], pa.int64()), (lambda x: x[3], pa.int64()), (lambda x: hashlib.sha256(x[1]).hexdigest(), pa.string())))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return met.mapInArrow(tidied(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``remove_repeats`` of ``docs``: no row goes, and what is left of a text stays."""
    return remove_repeats(docs)

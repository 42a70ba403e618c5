"""Byte-level BPE: a hierarchical-bitmap rank queue, and exact prefix counts.

``merge`` runs one pre-token's merges, ``merge_all`` those of many at once. Adjacent pairs wait in buckets, one per
merge rank; a two-level bitmap over the ranks finds the lowest non-empty bucket
by find-first-set. Symbols form a linked list over byte positions, and an entry
whose pair has changed since it was queued is skipped when it is met. The cost is
n log n in a pre-token's bytes, so one of any length is encoded whole.

``PrefixCounts`` stores how many tokens every prefix of a pre-token encodes to.
The last token of a prefix's encoding is the one token that ends there and is
compatible with the last token of what precedes it, so one pass suffices. ``profile``
stores a text's counts at every prefix, which answers truncation and budget questions
without encoding anything again.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from itertools import accumulate, chain, islice

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from .common import table, tidied

#: Unicode's White_Space, which is what ``\s`` means to the tokenizer libraries.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE, _BLANK = regex.compile(f"[{SPACE}]"), regex.compile(f"[{SPACE}]+")
SPACES = frozenset(c for c in map(chr, range(0x3001)) if _SPACE.match(c))
#: White space beside a space, or at an end: where a text has it, words aren't units.
_LOOSE = re.compile(f" [{SPACE}]|[{SPACE}] |^[{SPACE}]|[{SPACE}]$").search
#: Distinct words whose encoding a worker remembers before it starts afresh.
CACHE = 300_000
#: The same in a stage among others, whose workers the others share.
STAGE_CACHE = 100_000
#: The same where only counts are remembered.
COUNT_CACHE = 400_000
LOW_BITS = 8
#: Stands for the token before a pre-token's first.
START = (1 << 24) - 1


class RankQueue:
    """Positions by rank; ``pop`` gives the lowest rank's leftmost position."""

    __slots__ = ("top", "low", "buckets")

    def __init__(self):
        self.top, self.low, self.buckets = 0, {}, {}

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heapq.heappush(bucket, at)
            return
        self.buckets[rank] = [at]
        word = rank >> LOW_BITS
        self.low[word] = self.low.get(word, 0) | 1 << (rank & (1 << LOW_BITS) - 1)
        self.top |= 1 << word

    def pop(self) -> tuple[int, int] | None:
        top = self.top
        if not top:
            return None
        word = (top & -top).bit_length() - 1
        bits = self.low[word]
        first = bits & -bits
        rank = word << LOW_BITS | first.bit_length() - 1
        bucket = self.buckets[rank]
        at = heapq.heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[word] = bits ^ first
            if bits == first:
                self.top = top ^ 1 << word
        return rank, at


def merge(piece: bytes, rank_of) -> list[int]:
    """Start offsets of the tokens of one pre-token, and its length at the end.

    ``rank_of(piece, i, j, k)`` is the rank of merging [i:j] and [j:k], or None.
    """
    n = len(piece)
    nxt, before = list(range(1, n + 2)), list(range(-1, n))
    waits = [-1] * (n + 1)  # the rank at which a symbol and its successor wait
    queue = RankQueue()
    for i in range(n - 1):
        r = rank_of(piece, i, i + 1, i + 2)
        if r is not None:
            waits[i] = r
            queue.push(r, i)
    while (got := queue.pop()) is not None:
        rank, i = got
        if waits[i] != rank:
            continue  # stale
        j = nxt[i]
        k = nxt[i] = nxt[j]
        waits[j] = waits[i] = -1
        if k < n:
            before[k] = i
            r = rank_of(piece, i, k, nxt[k])
            if r is not None:
                waits[i] = r
                queue.push(r, i)
        h = before[i]
        if h >= 0:
            r = rank_of(piece, h, i, k)
            if r != waits[h]:
                waits[h] = -1 if r is None else r
                if r is not None:
                    queue.push(r, h)
    out = [0]
    while out[-1] < n:
        out.append(nxt[out[-1]])
    return out


class PairTable:
    """Ranks of adjacent token pairs, looked up for arrays of pairs at once."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 24 | b] = rank
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int32)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        key = a.astype(np.int64) << 24 | b
        if not len(self.keys):  # a vocabulary of single bytes
            return np.full(len(key), -1, dtype=np.int32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.int32(-1))


#: Pre-tokens up to this long share one queue; longer ones have one each.
SHARED = 256


def merge_all(pieces: list[bytes], pairs: PairTable, byte_ids: np.ndarray) -> list[tuple[int, ...]]:
    """Token ids of many pre-tokens, by one rank queue over all their bytes.

    A bucket holds arrays of positions. Of the lowest bucket each pre-token merges
    its leftmost pair, all at once, and positions left over wait in it again; so each
    goes through the merges in the order that a queue of its own would give.
    """
    if not pieces:
        return []
    sizes = np.array(list(map(len, pieces)))
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
    sym = byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    n = len(sym)
    sym = np.append(sym, np.int32(0))
    end = np.cumsum(sizes)
    nxt, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    nxt[end - 1] = n  # stands for the end of any pre-token
    before[end - sizes] = -1
    alive = np.ones(n, dtype=bool)
    waits = np.full(n + 1, -1, dtype=np.int32)
    buckets: dict[int, list[np.ndarray]] = {}
    low: dict[int, int] = {}
    top = 0

    def push(at: np.ndarray, rank: np.ndarray) -> None:
        nonlocal top
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank, prepend=-1))
        for r, x in zip(rank[cuts].tolist(), np.split(at, cuts[1:])):
            have = buckets.get(r)
            if have is not None:
                have.append(x)
                continue
            buckets[r] = [x]
            word = r >> LOW_BITS
            low[word] = low.get(word, 0) | 1 << (r & (1 << LOW_BITS) - 1)
            top |= 1 << word

    first = np.flatnonzero(nxt[:n] < n)
    rank = pairs(sym[first], sym[first + 1])
    waits[first] = rank
    push(first[rank >= 0], rank[rank >= 0])
    while top:
        word = (top & -top).bit_length() - 1
        bits = low[word]
        bit = bits & -bits
        rank = word << LOW_BITS | bit.bit_length() - 1
        held = buckets.pop(rank)
        at = held[0] if len(held) == 1 else np.concatenate(held)
        at = at[waits[at] == rank]  # the others are stale
        at.sort()
        who = owner[at]
        lead = np.empty(len(at), dtype=bool)
        lead[:1] = True
        np.not_equal(who[1:], who[:-1], out=lead[1:])
        i = at[lead]
        if len(i) < len(at):
            buckets[rank] = [np.unique(at[~lead])]
        else:
            low[word] = bits ^ bit
            if bits == bit:
                top ^= 1 << word
        if not len(i):
            continue
        j = nxt[i]
        k = nxt[j]
        sym[i], nxt[i], waits[j], alive[j] = rank, k, -1, False
        inner = k < n
        before[k[inner]] = i[inner]
        h = before[i]
        left = h >= 0
        a = np.concatenate((i[inner], h[left]))
        b = np.concatenate((k[inner], i[left]))
        got = pairs(sym[a], sym[b])
        waits[i] = -1
        waits[a] = got
        good = got >= 0
        push(a[good], got[good])
    ids = sym[:n][alive].tolist()
    count = np.cumsum(np.bincount(owner[alive], minlength=len(pieces))).tolist()
    return [tuple(ids[a:b]) for a, b in zip([0, *count], count)]


#: Characters of text whose words are looked up together.
STRETCH = 6 << 20


def stretches(texts: list[str]):
    """The texts in lists of about STRETCH characters, one text at least."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= STRETCH:
            yield texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:]


class Units:
    """Splits texts into units that the pattern treats alike in any context.

    A match never starts before a space it holds, so a text may be cut before a
    single space between two non-spaces. Such units repeat and are remembered.
    ``of_pieces`` maps a list of pre-tokens (bytes) to a list of tuples; ``finish``
    makes of a unit's joined tuple what is remembered and given out for it.
    """

    def __init__(self, pattern: str, of_pieces, cache: int = CACHE, finish=None):
        self.cache, self.finish = cache, finish
        self.find = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")).findall
        self.of_pieces, self.words, self.pieces = of_pieces, {}, {}

    def _segments(self, parts: list[str]) -> list[tuple[int, int, str]]:
        """(from, to, string) of what isn't a word after a space: the first part, and
        stretches of parts that are empty or begin or end with white space."""
        out, at = [], [0, 1]
        for i, w in enumerate(parts):
            if i and (not w or w[0] in SPACES or w[-1] in SPACES):
                if i == at[1] and (at[0] or self._loose(parts[0])):
                    at[1] = i + 1
                else:
                    out.append(at)
                    at = [i, i + 1]
        out.append(at)
        return [(a, b, " " * (a > 0) + " ".join(parts[a:b])) for a, b in out]

    @staticmethod
    def _loose(w: str) -> bool:
        return not w or w[0] in SPACES or w[-1] in SPACES

    def _split(self, words: list[str]) -> list[list[str]]:
        """The pre-tokens of each word with a space before it, all found in one pass."""
        if not words:
            return []
        found = self.find(" " + " ".join(words))
        ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
        wanted = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        at = np.searchsorted(ends, wanted)
        if at[-1] >= len(ends) or (ends[at] != wanted).any():  # a pattern that leaves characters out
            return [self.find(" " + w) for w in words]
        cuts = (at + 1).tolist()
        return [found[a:b] for a, b in zip([0, *cuts], cuts)]

    def batch(self, texts: list[str]):
        """Yields for each text what is remembered of its units."""
        if len(self.words) > self.cache:
            self.words.clear()
        if len(self.pieces) > self.cache:
            self.pieces.clear()
        split = [t.split(" ") for t in texts]
        segments = [self._segments(p) if _LOOSE(t) else None for t, p in zip(texts, split)]
        seen: set[str] = set().union(*split)
        fresh = [w for w in seen - self.words.keys() if w and w[0] not in SPACES and w[-1] not in SPACES]
        strings = list({s for x in segments if x for *_, s in x} | {p[0] for x, p in zip(segments, split) if not x})
        found = self._split(fresh) + [self.find(s) for s in strings]
        known = self.pieces
        missing = list(set(chain.from_iterable(found)) - known.keys())
        known.update(zip(missing, self.of_pieces([p.encode() for p in missing])))
        whole = [known[p[0]] if len(p) == 1 else tuple(chain.from_iterable(map(known.__getitem__, p))) for p in found]
        if self.finish:
            whole = list(map(self.finish, whole))
        self.words.update(zip(fresh, whole))
        whole = dict(zip(strings, whole[len(fresh) :]))
        get = self.words.get
        for parts, cuts in zip(split, segments):
            out = list(map(get, parts))
            if cuts:
                for a, b, s in reversed(cuts):
                    out[a:b] = [whole[s]]
            else:
                out[0] = whole[parts[0]]
            yield out

    def __call__(self, text: str) -> list[tuple]:
        return next(self.batch([text]))

    def forget(self) -> None:
        """Drops what is remembered, for a worker that other work shares."""
        self.words, self.pieces = {}, {}


class RankFile:
    """Encodes as the tiktoken library does with a file of ranks, no special tokens.

    With ``digests`` a unit's ids are remembered as their decimal string and as the
    bytes that they decode to, so that a text's digests take no step per token.
    """

    def __init__(self, content: bytes, pattern: str, digests: bool = False, cache: int = CACHE):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.units = Units(pattern, self.of_pieces, cache, self.rendered if digests else None)
        self.pairs = PairTable(self.ranks)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)

    def of_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        whole = [self.ranks.get(p) for p in pieces]
        out = [None if t is None else (t,) for t in whole]
        short = [i for i, t in enumerate(out) if t is None and len(pieces[i]) <= SHARED]
        for i, ids in zip(short, merge_all([pieces[i] for i in short], self.pairs, self.byte_ids)):
            out[i] = ids
        return [self.piece(p) if t is None else t for p, t in zip(pieces, out)]

    def piece(self, piece: bytes) -> tuple[int, ...]:
        get, longest = self.ranks.get, self.longest
        cuts = merge(piece, lambda p, i, j, k: get(p[i:k]) if k - i <= longest else None)
        return tuple([self.ranks[piece[i:j]] for i, j in zip(cuts, cuts[1:])])

    def encode_all(self, texts: list[str]):
        for some in stretches(texts):
            for units in self.units.batch(some):
                yield list(chain.from_iterable(units))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def rendered(self, ids: tuple[int, ...]) -> tuple[int, str, bytes]:
        return len(ids), ",".join(map(str, ids)), self.decode(ids)

    def digest_all(self, texts: list[str]):
        """(tokens, SHA-256 of the ids joined by commas, SHA-256 of the decoded bytes) of each."""
        for some in stretches(texts):
            for units in self.units.batch(some):
                counts, ids, back = zip(*units)
                yield sum(counts), hashlib.sha256(",".join(filter(None, ids)).encode()).hexdigest(), hashlib.sha256(b"".join(back)).hexdigest()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounts:
    """Exact token counts of prefixes, as the tokenizers library counts tokens."""

    def __init__(self, content: bytes, pattern: str):
        model = json.loads(content)
        letters = _byte_letters()
        raw = lambda s: bytes(map(letters.__getitem__, s))
        self.special = [t["content"] for t in model["added_tokens"]]
        specials = set(self.special)
        self.vocab = {raw(t): i for t, i in model["model"]["vocab"].items() if t not in specials}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
        self.merges = {(raw(a), raw(b)): r for r, (a, b) in enumerate(pairs)}
        self.bytes_of = {i: t for t, i in self.vocab.items()}
        found = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            found.add_word(token.decode("latin-1"), (i, len(token)))
        found.make_automaton()
        self.tokens_in = found.iter
        self.follows: dict[int, bool] = {}
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        numbers = [(n,) for n in range(1000)]  # shared, so that a remembered count is small
        total = lambda n: numbers[n] if n < 1000 else (n,)
        self.units = Units(pattern, lambda pieces: [total(self.prefixes(p)[-1]) for p in pieces], COUNT_CACHE)

    def bpe(self, piece: bytes) -> list[int]:
        get = self.merges.get
        cuts = merge(piece, lambda p, i, j, k: get((p[i:j], p[j:k])))
        return [self.vocab[piece[i:j]] for i, j in zip(cuts, cuts[1:])]

    def _compatible(self, a: int, b: int) -> bool:
        key = a << 24 | b
        ok = self.follows.get(key)
        if ok is None:
            if len(self.follows) >= 4 * CACHE:
                self.follows.clear()
            before = [] if a == START else [a]  # an entry that no merges reach never starts a piece
            ok = self.follows[key] = self.bpe(b"".join(self.bytes_of[x] for x in (*before, b))) == [*before, b]
        return ok

    def prefixes(self, piece: bytes) -> list[int]:
        """Tokens of piece[:i] for each i from 0 to its length."""
        n, known = len(piece), self.follows.get
        last, count = [START] * (n + 1), [0] * (n + 1)
        # The automaton gives the tokens that end at each byte, the longest first.
        for at, (t, size) in self.tokens_in(piece.decode("latin-1")):
            if count[at + 1]:
                continue
            j = at + 1 - size
            ok = known(last[j] << 24 | t)
            if ok or ok is None and self._compatible(last[j], t):
                last[at + 1], count[at + 1] = t, count[j] + 1
        return count

    def segments(self, text: str):
        """(is special, string) in order; special strings are tokens of their own."""
        if self.split_special is None:
            yield False, text
            return
        at = 0
        for m in self.split_special.finditer(text):
            yield False, text[at : m.start()]
            yield True, m.group()
            at = m.end()
        yield False, text[at:]

    def count_all(self, texts: list[str]) -> list[int]:
        out, plain, of = [0] * len(texts), [], []
        for i, t in enumerate(texts):
            for special, s in self.segments(t):
                if special:
                    out[i] += 1
                elif s:
                    plain.append(s)
                    of.append(i)
        for i, units in zip(of, chain.from_iterable(map(self.units.batch, stretches(plain)))):
            out[i] += sum(map(sum, units))
        return out

    def count(self, text: str) -> int:
        return self.count_all([text])[0]

    def _cuts(self, string: str) -> list[int]:
        """Tokens of a piece's every prefix of whole characters, the empty one first."""
        counts = self.prefixes(string.encode())
        if len(counts) == len(string) + 1:
            return counts
        at = accumulate((len(c.encode()) for c in string), initial=0)
        return [counts[i] for i in at]

    def profile(self, text: str) -> list[int]:
        """Tokens of text[:i], as the library would count that text, for each i from 0.

        A text cut within a pre-token ends in a shorter one. Two cases differ: white
        space at the cut is one pre-token, as no word follows, and a contraction cut
        short is a sign and a letter. A special string cut short is ordinary text.
        """
        out, base, begin = [0], 0, 0
        for special, s in self.segments(text):
            if special:
                # Up to here ``s`` continues the plain text before it.
                lead = text[begin : len(out) - 1]
                tail = lead[max(last, 0) :]
                for i in range(1, len(s)):
                    out.append(before + sum(self.prefixes(x.encode())[-1] for x in self.units.find(tail + s[:i])))
                base, begin = base + 1, len(out)
                out.append(base)
                continue
            # last: where the last pre-token, or the white space at the end, starts;
            # before: the tokens up to there.
            at, last, before, space = 0, -1, base, 0
            for m in self.units.find(s):
                cuts = self._cuts(m)
                word = len(m) > 1 and m[0] == " " and not _SPACE.match(m[1])
                blank = _SPACE.match(m[-1]) is not None
                if blank or word:
                    # The run of white space that the cuts so far and these end in.
                    start = at - space
                    if not space:
                        last, before = start, base
                        run = self._cuts(_BLANK.match(s, start).group())
                    n = len(m) if blank else 1
                    out.extend(before + c for c in run[space + 1 : space + n + 1])
                    if word:
                        last, before = at, base
                        out.extend(base + c for c in cuts[2:])
                else:
                    last, before = at, base
                    if m[0] == "'" and len(m) > 1 and m[1].isalpha():
                        cuts = [0, *(sum(self.prefixes(x.encode())[-1] for x in self.units.find(m[:i])) for i in range(1, len(m))), cuts[-1]]
                    out.extend(base + c for c in cuts[1:])
                space = space + len(m) if blank else 0
                at, base = at + len(m), base + cuts[-1]
        return out

    def within(self, text: str, budget: int) -> int:
        """The most leading characters that have ``budget`` tokens at most."""
        return max((i for i, n in enumerate(self.profile(text)) if n <= budget), default=0)


def _worker_model(kind, content, *rest, made={}):  # noqa: B006 - one model of a kind a worker
    """The model of a vocabulary, kept from task to task until another one is wanted."""
    file, digest = content
    key = digest, rest
    if kind not in made or made[kind][0] != key:
        made[kind] = key, kind(file.value, *rest)
    return made[kind][1]


def _broadcast_file(spark: SparkSession, path: str):
    """A vocabulary file, about 1 MB whatever the input, sent from the driver; its digest."""
    with open(path, "rb") as f:
        data = f.read()
    return spark.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, keep: list[str] | None = None) -> DataFrame:
    """doc_id, ids array<int>, decoded binary of each row of ``docs(doc_id, text)``.

    A null or empty text has no ids. Rows are independent: repeated ones repeat, and a null
    doc_id stays null. An empty table has no rows. ``keep`` names further columns, which come
    along as one struct ``kept``, whatever they are called; then ``decoded`` is left out.
    """
    content = _broadcast_file(docs.sparkSession, path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []))
    schema = StructType([f for f in rows.schema if f.name != "text"]).add("ids", ArrayType(IntegerType()))
    schema = schema if keep else schema.add("decoded", BinaryType())

    def run(batches):
        model = _worker_model(RankFile, content, pattern, False, STAGE_CACHE)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                encoded, at = model.encode_all([t or "" for t in b.column(1).to_pylist()]), 0
                while ids := list(islice(encoded, 500)):
                    part, at = b.slice(at, len(ids)), at + len(ids)
                    back = [] if keep else [pa.array([model.decode(x) for x in ids], pa.binary())]
                    columns = [part.column(i) for i in range(part.num_columns) if i != 1]
                    yield pa.record_batch([*columns, pa.array(ids, pa.list_(pa.int32())), *back], names=schema.names)
        model.units.forget()

    return rows.mapInArrow(tidied(run), schema)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests are taken beside the encoder, so that ids stay in the worker. A null
    text counts as empty; rows are independent, and repeated ones repeat."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    content, pattern = _broadcast_file(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN

    def run(batches):
        model = _worker_model(RankFile, content, pattern, True)
        for b in batches:
            found = list(model.digest_all([t or "" for t in b.column(1).to_pylist()]))
            columns = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.record_batch([b.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(tidied(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


#: Tokens above which a document is over the limit.
LIMIT = 1024


def count_tokens(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each row of ``docs(doc_id, text)``; null is empty.

    Special strings inside a text are one token each, the library's default.
    """
    content = _broadcast_file(docs.sparkSession, path or public_tokenizers.path("byte_bpe_50k.json"))

    def run(batches):
        model = _worker_model(PrefixCounts, content, pattern)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(model.count_all(texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(run), "doc_id long, n_bytes long, n_tokens long")


def prefix_counts(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, counts array<int>: tokens of each prefix of whole characters of the text
    of each row of ``docs(doc_id, text)``, the empty one first; null is empty."""
    content = _broadcast_file(docs.sparkSession, path or public_tokenizers.path("byte_bpe_50k.json"))

    def run(batches):
        model = _worker_model(PrefixCounts, content, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 100):
                some = b.slice(at, 100)
                yield pa.record_batch([some.column(0), pa.array([model.profile(t or "") for t in some.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "counts"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(run), "doc_id long, counts array<int>")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``count_tokens`` of documents, and which are over the limit."""
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)

"""Scalar functions as Column builders; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scripts written without spaces, and the vocabularies below.
CJK = r"[぀-ヿ㐀-䶿一-鿿豈-﫿가-힣]"
NEGATIONS = [
    "not", "never", "no", "dont", "don't", "doesnt", "doesn't", "wont", "won't", "shouldnt", "shouldn't", "cant", "can't",
    "without", "avoid", "neither", "nor", "nothing", "nobody", "nowhere", "none",
]
STOP_WORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "need", "must", "to", "for", "of", "in", "on", "at", "by", "from", "with", "about", "and", "or", "but",
    "if", "then", "so", "as", "that", "this", "these", "those", "it", "its", "i", "my", "we", "our", "you", "your", "they", "their", "what", "how",
    "when", "where", "who", "which", "why", "not", "just", "now", "also", "than", "only", "any", "all", "each",
]
TYPES = ["episodic", "semantic", "procedural", "feedback"]
TRUST = ["trusted", "reported", "untrusted"]
IMPORTANCE_TIERS = [
    (0.9, [
        r"\b(always|never)\b",
        r"\bfrom now on\b",
        r"\b(must|must not|mustn't)\b",
        r"\bdo not ever\b",
        r"\bimportant\b",
        r"\bcritical\b",
        r"^correction\b",
        r"\bactually,",
        r"\bthat('s| is| was) (wrong|incorrect)\b",
        r"\bnot \w+([ ,]+\w+){0,3}[ ,]+but\b",
        r"\binstead of\b",
        r"\bprefers?\b",
        r"\bfavou?rite\b",
        r"\b(i|user) (like|love|hate|dislike)s?\b",
        r"\bdon'?t (like|want|use)\b",
    ]),
    (0.75, [
        r"\bdecided\b",
        r"\bdecision\b",
        r"\bwe (use|chose|agreed|settled on)\b",
        r"\bconvention\b",
        r"\bpolicy\b",
        r"\bstandard\b",
        r"\brule\b",
        r"\bworkflow\b",
        r"\brequired\b",
    ]),
    (0.6, [
        r"\b(fixed|solved|resolved)\b",
        r"\b(implemented|added|built|created)\b",
        r"\b(deployed|released|shipped|merged|published)\b",
        r"\b(configured|installed|migrated)\b",
    ]),
    (0.35, [
        r"\b(noticed|observed|saw|spotted)\b",
        r"\b(seems|appears|looks like)\b",
        r"\b(maybe|perhaps|might|possibly)\b",
        r"\bnot sure\b",
        r"\bfor now\b",
        r"\btemporar(y|ily)\b",
    ]),
]
DAY = 86400.0
NO_STRINGS = "array<string>"


def tokenize(text: Column) -> Column:
    """Lower-case words without apostrophes, then each word's CJK bigrams."""
    norm = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "['’]", "")
    words = F.regexp_extract_all(norm, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))

    def bigrams(word: Column) -> Column:
        chars = F.regexp_extract_all(word, F.lit(CJK), F.lit(0))
        pairs = F.transform(F.sequence(F.lit(0), F.size(chars) - 2), lambda i: F.concat(F.get(chars, i), F.get(chars, i + 1)))
        return F.when(F.size(chars) >= 2, pairs).otherwise(F.array().cast(NO_STRINGS))

    return F.when(norm.rlike(CJK), F.concat(words, F.flatten(F.transform(words, bigrams)))).otherwise(words)


def content_hash(text: Column) -> Column:
    """32 hex digits of the SHA-256 of the lower-cased, space-collapsed text."""
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    return F.substring(F.sha2(F.array_join(words, " "), 256), 1, 32)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; 0 if both are empty or one is null. The outer array makes
    Spark compute each of the two once, whatever they are made of."""
    sets = F.array(F.struct(F.array_distinct(a).alias("a"), F.array_distinct(b).alias("b")))
    both = F.transform(sets, lambda s: F.struct(F.size(F.array_intersect(s["a"], s["b"])).alias("met"), (F.size(s["a"]) + F.size(s["b"])).alias("all")))
    share = F.transform(both, lambda n: F.when(n["all"] > 0, n["met"] / (n["all"] - n["met"])).otherwise(0.0))[0]
    return F.when(F.isnull(a) | F.isnull(b), 0.0).otherwise(share)


def count_negations(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(NEGATIONS)))


def negation_differs(a: Column, b: Column) -> Column:
    return count_negations(a) % 2 != count_negations(b) % 2


def estimate_tokens(text: Column) -> Column:
    """About four characters a token, rounded half to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(F.length(text) / 4.0).cast("int"))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it, even
    within functions over arrays."""
    return F.transform(F.array(value), use)[0]


def key_phrases(text: Column, most: int = 3) -> Column:
    """Distinct pairs of neighbouring content words, then the words; ``most`` of them."""
    if most < 0:
        raise ValueError(f"most must be >= 0, not {most}")
    none = F.array().cast(NO_STRINGS)

    def phrases(words: Column) -> Column:
        pair = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))
        pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(0), F.size(words) - 2), pair)).otherwise(none)
        return F.slice(F.array_distinct(F.concat(pairs, words)), 1, most)

    words = F.filter(tokenize(text), lambda w: ~w.isin(STOP_WORDS) & (F.length(w) > 2))
    return bound(words, phrases) if most else none


def fanout_queries(text: Column, most: int = 3) -> Column:
    """The text, then its key phrases that aren't the text itself."""
    same = lambda s: F.array_join(F.filter(F.split(F.lower(s), r"(?U)\s+"), lambda w: w != ""), " ")
    return F.concat(F.array(text), F.filter(key_phrases(text, most), lambda p: same(p) != same(text)))


def importance(text: Column, type_: Column) -> Column:
    body = F.trim(F.coalesce(text, F.lit("")))
    tier = F.lit(0.5)
    for score, patterns in reversed(IMPORTANCE_TIERS):
        hit = F.lit(False)
        for p in patterns:
            hit = hit | body.rlike(f"(?i){p}")
        tier = F.when(hit, F.lit(score)).otherwise(tier)
    standing = F.when(type_.isin("procedural", "feedback"), 0.10).otherwise(0.0)
    asking, short = F.when(body.endswith("?"), 0.15).otherwise(0.0), F.when(F.length(body) < 20, 0.10).otherwise(0.0)
    score = tier + standing - asking - short
    return F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.98), score)), 3)


def recency(at: Column, now: float, rate: float = 0.10) -> Column:
    return F.exp(-rate * F.greatest(F.lit(0.0), (F.lit(now) - at) / DAY))


def decay(importance_: Column, last: Column, count: Column, now: float, rate: float = 0.1, frequency: float = 0.0) -> Column:
    return importance_ * recency(last, now, rate) * (1 + frequency * F.log1p(count.cast("double")))


def trust_rank(trust: Column) -> Column:
    """0 for trusted and missing, 1 reported, 2 untrusted and unknown labels."""
    return F.when(F.coalesce(trust, F.lit("")).isin("", "trusted"), 0).when(trust == "reported", 1).otherwise(2)


def trust_label(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TRUST]), (rank + 1).cast("int"))


def level_of(tags: Column) -> Column:
    """The first number that a ``level:`` tag holds, or 0."""
    levels = F.filter(F.transform(F.filter(tags, lambda t: t.startswith("level:")), lambda t: F.substring(t, 7, 20).try_cast("int")), lambda x: x.isNotNull())
    return F.coalesce(F.get(levels, 0), F.lit(0))


def pack_line(text: Column, type_: Column, pinned: Column, trust: Column) -> Column:
    marks = F.concat_ws(", ", F.when(pinned, "pinned"), F.when(trust_rank(trust) > 0, trust))
    return F.concat(F.lit("- ("), type_, F.lit(")"), F.when(marks != "", F.concat(F.lit(" ["), marks, F.lit("]"))).otherwise(""), F.lit(" "), text)


def parse_duration(text: Column) -> Column:
    """Whole seconds of ``30m``, ``1.5h``, ``7d``, ``2w``; null if malformed."""
    return F.floor(F.regexp_extract(F.lower(text), _SPAN, 1).try_cast("double") * _unit(text))


def is_valid_at(start: Column, end: Column, at: Column) -> Column:
    """Half-open interval; 0 on either side is unbounded."""
    return ((start == 0) | (start <= at)) & ((end == 0) | (at < end))


# --- checks ------------------------------------------------------------------------


def check_choice(value: str, allowed, name: str) -> str:
    """``value`` if it is allowed; an unknown one is never taken for a default."""
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")
    return value


def check_tag(tag: str) -> str:
    if not tag.strip() or "," in tag:
        raise ValueError(f"a tag must not be blank nor hold a comma: {tag!r}")
    return tag


def choice_ok(value: Column, allowed) -> Column:
    return F.coalesce(value.isin(*allowed), F.lit(False))


def tags_ok(tags: Column) -> Column:
    return ~F.exists(tags, lambda x: (F.trim(x) == "") | x.contains(","))


def validity_ok(start: Column, end: Column) -> Column:
    """Neither is negative, and where both are set the end comes after the start."""
    return (start >= 0) & (end >= 0) & ((start == 0) | (end == 0) | (end > start))


# --- times and display ---------------------------------------------------------------

_SPAN = r"^\s*(\d+(?:\.\d+)?)\s*([smhdw])\s*$"


def _unit(text: Column) -> Column:
    unit = F.regexp_extract(F.lower(text), _SPAN, 2)
    return F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).when(unit == "w", 604800)


def parse_timestamp(text: Column, now: float) -> Column:
    """Epoch seconds of a span before ``now`` (``7d``), of a number, or of an ISO date or
    time, in UTC unless it says otherwise; null if blank. Anything else is an error."""
    clean = F.trim(text)
    span = F.lit(now) - F.regexp_extract(F.lower(clean), _SPAN, 1).try_cast("double") * _unit(clean)
    day = F.when(clean.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(clean, F.lit("T00:00:00"))).otherwise(clean)
    zoned = F.when(day.rlike(r"([Zz]|[+-]\d{2}:?\d{2})$"), day).otherwise(F.concat(day, F.lit("Z")))
    iso = F.when(clean.rlike(r"^\d{4}-\d{2}-\d{2}"), F.unix_micros(zoned.try_cast("timestamp")) / 1e6)
    stop = F.raise_error(F.concat(F.lit("invalid timestamp: "), clean)).cast("double")
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit(None).cast("double")).otherwise(F.coalesce(span, clean.try_cast("double"), iso, stop))


def format_duration(seconds: Column) -> Column:
    """``45s``, ``3m 5s``, ``2h``, ``1d 4h``: the two largest units, zero ones left out."""
    n = F.abs(seconds).cast("long")

    def of(size: int, name: str, rest: int, less: str) -> Column:
        left = F.floor(n % size / rest)
        second = F.when(left > 0, F.concat(F.lit(" "), left.cast("string"), F.lit(less))).otherwise("")
        return F.concat(F.floor(n / size).cast("string"), F.lit(name), second)

    small = F.when(n < 60, F.concat(n.cast("string"), F.lit("s"))).when(n < 3600, of(60, "m", 1, "s"))
    return small.when(n < 86400, of(3600, "h", 60, "m")).otherwise(of(86400, "d", 3600, "h"))


def age(at: Column, now: float) -> Column:
    """How long ago, in the largest unit that fits."""
    gone = F.lit(now) - at
    ago = lambda size, name: F.concat(F.floor(gone / size).cast("string"), F.lit(f"{name} ago"))
    near = F.when(gone < 60, "just now").when(gone < 3600, ago(60, "m")).when(gone < DAY, ago(3600, "h"))
    return near.when(gone < 7 * DAY, ago(DAY, "d")).when(gone < 60 * DAY, ago(7 * DAY, "w")).otherwise(ago(30 * DAY, "mo"))


def snippet(text: Column, width: int = 60) -> Column:
    """On one line, at most ``width`` characters, the last an ellipsis if cut."""
    flat = F.array_join(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), " ")
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 1), F.lit("…"))).otherwise(flat)


def links_of(text: Column) -> Column:
    """Links of a JSON list of {to, rel}; malformed ones count as none."""
    none = F.array().cast("array<struct<to:string,rel:string>>")
    return F.coalesce(F.from_json(text, "array<struct<to:string,rel:string>>"), none)


# --- chunks --------------------------------------------------------------------------


def chunks(text: Column, max_chars: int = 500, min_chars: int = 30) -> Column:
    """Paragraphs as an array; a heading goes with what follows it. A longer paragraph is
    cut between sentences, as many to a chunk as fit, and a short leftover joins its
    neighbour there. Chunks below ``min_chars`` are left out; a sentence is never cut."""
    strings = "array<string>"
    bare = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    real = lambda xs: F.filter(F.transform(xs, bare), lambda x: x != "")
    none, empty = F.lit(None).cast("string"), F.array().cast(strings)
    blocks = real(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"(?U)\n\s*\n"))

    def glue(acc: Column, block: Column) -> Column:
        both = F.concat_ws("\n", acc["open"], block)
        head = block.rlike(r"(?U)^#{1,6}\s+\S") & ~block.contains("\n")
        return F.struct(F.when(head, both).alias("open"), F.when(head, acc["done"]).otherwise(F.concat(acc["done"], F.array(both))).alias("done"))

    start = F.struct(none.alias("open"), empty.alias("done"))
    closed = lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    def folded(parts: Column, joins) -> Column:
        """Each part joins the one before it where ``joins`` says so."""

        def step(acc: Column, x: Column) -> Column:
            on = acc["open"].isNotNull() & joins(acc["open"], x)
            return F.struct(
                F.when(on, F.concat_ws(" ", acc["open"], x)).otherwise(x).alias("open"),
                F.when(on | acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"),
            )

        return F.aggregate(parts, start, step, closed)

    def cut(block: Column) -> Column:
        packed = folded(real(F.split(block, r"(?U)(?<=[.!?])\s+")), lambda a, x: F.length(a) + 1 + F.length(x) <= max_chars)
        whole = folded(packed, lambda a, x: F.length(x) < min_chars)

        def forward(parts: Column) -> Column:
            runt = (F.size(parts) > 1) & (F.length(F.get(parts, 0)) < min_chars)
            two = F.array(F.concat_ws(" ", F.get(parts, 0), F.get(parts, 1)))
            return F.when(runt, F.concat(two, F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))))).otherwise(parts)

        return bound(whole, forward)

    glued = F.aggregate(blocks, start, glue, closed)
    every = F.flatten(F.transform(glued, lambda b: F.when(F.length(b) <= max_chars, F.array(b)).otherwise(cut(b))))
    return F.filter(every, lambda c: F.length(c) >= min_chars)

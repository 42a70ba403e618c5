"""Scalar functions and driver-side helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.recall import Weights
from ..sources import files
from .base import DECAY, NEGATIVE, Tables, cos, decay, joined, query, r6, tok
from .fixture import NOW


def _toks(c: str = "text"):
    return S.tokenize(F.col(c))


@query("fn_tokenize", f"SELECT id, len({tok()})::INT AS n, array_to_string({tok()}, ' ') AS words FROM m")
def fn_tokenize(t: Tables):
    return t.m.select("id", F.size(_toks()).alias("n"), F.array_join(_toks(), " ").alias("words"))


@query("fn_content_hash", "SELECT id, content_hash FROM m")
def fn_content_hash(t: Tables):
    return t.m.select("id", "content_hash")


@query("fn_cosine", f"SELECT a.vec_id, round({cos('a.x', 'b.x')}, 6) AS cosine FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def fn_cosine(t: Tables):
    next_ = t.v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return t.v.select("vec_id", "x").join(next_, "vec_id").select("vec_id", r6(S.cosine(F.col("x"), F.col("y"))).alias("cosine"))




def next_sql(value: str) -> str:
    return f"SELECT a.id, {value} FROM (SELECT id, i, {tok()} AS s FROM m) a JOIN (SELECT i, {tok()} AS s FROM m) b ON b.i = a.i + 1"


def _with_next(t: Tables, of=lambda words: words):
    """Rows with words and other, what ``of`` makes of their own and the next text's words:
    each text is cut into words once, before rows meet."""
    return t.m.select("id", "i", of(_toks()).alias("words")).join(t.m.select((F.col("i") - 1).alias("i"), of(_toks()).alias("other")), "i")


@query("fn_jaccard", next_sql("round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::DOUBLE, 6) AS jaccard"))
def fn_jaccard(t: Tables):
    return _with_next(t, F.array_distinct).select("id", r6(S.jaccard(F.col("words"), F.col("other"))).alias("jaccard"))


def negative(s: str) -> str:
    return f"len(list_filter({s}, lambda w: w IN {NEGATIVE}))"


@query("fn_count_neg", f"SELECT id, {negative(tok())}::INT AS n FROM m")
def fn_count_neg(t: Tables):
    return t.m.select("id", S.count_negations(_toks()).alias("n"))


@query("fn_negation_diff", next_sql(f"{negative('a.s')} % 2 <> {negative('b.s')} % 2 AS differs"))
def fn_negation_diff(t: Tables):
    return _with_next(t).select("id", S.negation_differs(F.col("words"), F.col("other")).alias("differs"))


@query("fn_estimate_tokens", "SELECT id, greatest(1, round_even(length(text) / 4::DOUBLE, 0))::INT AS tokens FROM m")
def fn_estimate_tokens(t: Tables):
    return t.m.select("id", S.estimate_tokens(F.col("text")).alias("tokens"))


STOP = "(" + ", ".join(f"'{w}'" for w in S.STOP_WORDS) + ")"

def phrases_sql(rows: str, id_: str = "id", text: str = "text") -> str:
    """ph(id, n, p): texts' key phrases in order: pairs of neighbouring content words, then the words."""
    return f""",
w0 AS (SELECT {id_} AS id, list_filter({tok(text)}, lambda w: w NOT IN {STOP} AND length(w) > 2) AS w FROM {rows}),
w1 AS (SELECT id, list_concat([w[k] || ' ' || w[k + 1] FOR k IN range(1, len(w))], w) AS ps FROM w0),
w2 AS (SELECT id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM w1),
w3 AS (SELECT id, p, min(k) AS k FROM w2 GROUP BY ALL),
ph AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS n FROM w3) WHERE n <= 3)"""


@query("fn_key_phrases", phrases_sql("m") + " SELECT m.id, coalesce(string_agg(p, '|' ORDER BY n), '') AS phrases FROM m LEFT JOIN ph ON ph.id = m.id GROUP BY m.id")
def fn_key_phrases(t: Tables):
    return t.m.select("id", F.array_join(S.key_phrases(F.col("text")), "|").alias("phrases"))


@query(
    "fn_fanout_queries",
    phrases_sql("m")
    + """, sm AS (SELECT id, text, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS flat FROM m)
    SELECT sm.id, text || coalesce('|' || string_agg(p, '|' ORDER BY n) FILTER (p <> flat), '') AS queries FROM sm LEFT JOIN ph ON ph.id = sm.id GROUP BY sm.id, text""",
)
def fn_fanout_queries(t: Tables):
    return t.m.select("id", F.array_join(S.fanout_queries(F.col("text")), "|").alias("queries"))


CUES = ["Always ", "We decided ", "Fixed ", "Maybe ", ""]


def importance_sql(text: str) -> str:
    hit = lambda p: f"regexp_matches({text}, '(?i){p.replace(chr(39), chr(39) * 2)}')"
    tiers = " ".join(f"WHEN {' OR '.join(map(hit, patterns))} THEN {score}::DOUBLE" for score, patterns in S.IMPORTANCE_TIERS)
    moved = f"""CASE {tiers} ELSE 0.5::DOUBLE END + CASE WHEN type IN ('procedural', 'feedback') THEN 0.1::DOUBLE ELSE 0 END
      - CASE WHEN ends_with({text}, '?') THEN 0.15::DOUBLE ELSE 0 END - CASE WHEN length({text}) < 20 THEN 0.1::DOUBLE ELSE 0 END"""
    return f"round(greatest(0.05::DOUBLE, least(0.98::DOUBLE, {moved})), 3)"


@query(
    "fn_importance",
    f""", cu AS (SELECT id, type, ['Always ', 'We decided ', 'Fixed ', 'Maybe ', ''][i % 5 + 1] || text || CASE WHEN i % 7 = 0 THEN '?' ELSE '' END AS t FROM m)
    SELECT id, {importance_sql("t")} AS score FROM cu""",
)
def fn_importance(t: Tables):
    """Whole texts with a cue before them, some of them questions."""
    cue = F.get(F.array(*[F.lit(x) for x in CUES]), (F.col("i") % 5).cast("int"))
    text = F.concat(cue, F.col("text"), F.when(F.col("i") % 7 == 0, "?").otherwise(""))
    return t.m.select("id", S.importance(text, F.col("type")).alias("score"))


@query("fn_recency", "SELECT id, round(exp(-0.1::DOUBLE * greatest(0, (1700000000 - created_at) / 86400::DOUBLE)), 6) AS recency FROM m")
def fn_recency(t: Tables):
    return t.m.select("id", r6(S.recency(F.col("created_at"), NOW)).alias("recency"))


@query("fn_decay", f"SELECT id, round({DECAY}, 6) AS score FROM m")
def fn_decay(t: Tables):
    return t.m.select("id", r6(decay()).alias("score"))


@query("fn_trust_rank", "SELECT id, CASE trust WHEN 'trusted' THEN 0 WHEN 'reported' THEN 1 ELSE 2 END AS rank FROM m")
def fn_trust_rank(t: Tables):
    return t.m.select("id", S.trust_rank(F.col("trust")).alias("rank"))


@query(
    "fn_level_of",
    "SELECT id, CASE WHEN i % 3 = 0 THEN i % 7 WHEN list_contains(tags, 'level:1') THEN 1 WHEN i % 3 = 1 THEN 5 ELSE 0 END::INT AS level FROM m",
)
def fn_level_of(t: Tables):
    """The first level that parses, wherever it stands among the tags."""
    first = F.when(F.col("i") % 3 == 0, F.array(F.lit("level:x"), F.concat(F.lit("level:"), (F.col("i") % 7).cast("string")))).otherwise(F.array(F.lit("level:")))
    last = F.when(F.col("i") % 3 == 1, F.array(F.lit("level:5"))).otherwise(F.array(F.lit("levels:9")))
    return t.m.select("id", S.level_of(F.concat(first, F.col("tags"), last)).alias("level"))


MARKS = """CASE WHEN pinned AND trust <> 'trusted' THEN ' [pinned, ' || trust || ']' WHEN pinned THEN ' [pinned]'
    WHEN trust <> 'trusted' THEN ' [' || trust || ']' ELSE '' END"""


@query("fn_pack_line", f"SELECT id, '- (' || type || ')' || {MARKS} || ' ' || text AS line FROM m")
def fn_pack_line(t: Tables):
    return t.m.select("id", S.pack_line(F.col("text"), F.col("type"), F.col("pinned"), F.col("trust")).alias("line"))


UNIT = "['s', 'm', 'h', 'd', 'w'][i % 5 + 1]"
SECONDS = "[1, 60, 3600, 86400, 604800][i % 5 + 1]"


def _span():
    unit = F.get(F.array(*[F.lit(u) for u in "smhdw"]), (F.col("i") % 5).cast("int"))
    return F.concat((F.col("i") % 90).cast("string"), F.lit(".5"), unit)


@query("fn_parse_duration", f"SELECT id, CASE WHEN i % 11 = 0 THEN NULL ELSE floor((i % 90 + 0.5::DOUBLE) * {SECONDS})::BIGINT END AS seconds FROM m")
def fn_parse_duration(t: Tables):
    """Spans of every unit; some are malformed."""
    return t.m.select("id", S.parse_duration(F.when(F.col("i") % 11 == 0, "soon").otherwise(_span())).alias("seconds"))


LONG = "(i * 977 % 400000)"


@query(
    "fn_format_duration",
    f""", du AS (SELECT id, {LONG} AS s FROM m)
    SELECT id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' || CASE WHEN s % 60 > 0 THEN ' ' || s % 60 || 's' ELSE '' END
      WHEN s < 86400 THEN s // 3600 || 'h' || CASE WHEN s % 3600 // 60 > 0 THEN ' ' || s % 3600 // 60 || 'm' ELSE '' END
      ELSE s // 86400 || 'd' || CASE WHEN s % 86400 // 3600 > 0 THEN ' ' || s % 86400 // 3600 || 'h' ELSE '' END END AS span FROM du""",
)
def fn_format_duration(t: Tables):
    return t.m.select("id", S.format_duration(F.col("i") * 977 % 400000).alias("span"))


@query(
    "fn_parse_timestamp",
    f"""SELECT id, CASE i % 5 WHEN 0 THEN 1700000000 - (i % 90 + 0.5::DOUBLE) * 1 WHEN 1 THEN 1600000000::DOUBLE + i WHEN 2 THEN epoch(DATE '2024-01-01' + (i % 300)::INT)::DOUBLE
      WHEN 3 THEN epoch(DATE '2024-01-01' + (i % 300)::INT)::DOUBLE + 37800 - 7200 ELSE NULL END AS at FROM m""",
)
def fn_parse_timestamp(t: Tables):
    """Spans before now, numbers, dates, times with an offset, and blanks."""
    k = F.col("i") % 5
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("i") % 300).cast("int")).cast("string")
    text = F.when(k == 0, _span()).when(k == 1, (F.lit(1600000000) + F.col("i")).cast("string")).when(k == 2, day)
    text = text.when(k == 3, F.concat(day, F.lit("T10:30:00+02:00"))).otherwise(" ")
    return t.m.select("id", S.parse_timestamp(text, NOW).alias("at"))


@query("fn_validity_check", "SELECT id, valid_until = 0 OR valid_from = 0 OR valid_until > valid_from AS ok FROM m")
def fn_validity_check(t: Tables):
    return t.m.select("id", S.validity_ok(F.col("valid_from"), F.col("valid_until")).alias("ok"))


@query("fn_tag_check", "SELECT id, i % 4 NOT IN (1, 2) AS ok FROM m")
def fn_tag_check(t: Tables):
    """Some rows are given a blank tag or one with a comma."""
    more = F.when(F.col("i") % 4 == 1, F.array(F.lit(" "))).when(F.col("i") % 4 == 2, F.array(F.lit("a,b"))).otherwise(F.array(F.lit("fine")))
    return t.m.select("id", S.tags_ok(F.concat("tags", more)).alias("ok"))


@query("fn_choice_check", "SELECT id, type <> 'feedback' AND i % 6 <> 0 AS ok FROM m")
def fn_choice_check(t: Tables):
    value = F.when(F.col("i") % 6 == 0, F.lit(None).cast("string")).otherwise(F.col("type"))
    return t.m.select("id", S.choice_ok(value, ["semantic", "episodic", "procedural"]).alias("ok"))


@query(
    "fn_first_sentence_summary",
    """SELECT source, '[×' || count(*) || ' similar] ' || array_to_string(list_filter(list(trim(split_part(text, '.', 1)) ORDER BY importance DESC, i)[1:3], lambda s: s <> ''), ' | ') AS summary
    FROM m GROUP BY source""",
)
def fn_first_sentence_summary(t: Tables):
    from ..operators.recall import first_sentence_summaries

    return first_sentence_summaries(t.m.select("source", "importance", F.col("i").alias("pos"), "text"), "source").select("source", "summary")


@query("fn_chunk_text")
def fn_chunk_text(t: Tables):
    return t.m.select("id", F.posexplode(S.chunks(F.col("text"))).alias("n", "chunk"))


AGE = "(i * 7919 % 20000000)"


@query(
    "fn_age",
    f""", ag AS (SELECT id, {AGE} AS s FROM m)
    SELECT id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' WHEN s < 604800 THEN s // 86400 || 'd ago'
      WHEN s < 5184000 THEN s // 604800 || 'w ago' ELSE s // 2592000 || 'mo ago' END AS age FROM ag""",
)
def fn_age(t: Tables):
    return t.m.select("id", S.age(F.lit(NOW) - F.col("i") * 7919 % 20000000, NOW).alias("age"))


FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query("fn_snippet", f"SELECT id, CASE WHEN length({FLAT}) > 60 THEN left({FLAT}, 59) || '…' ELSE {FLAT} END AS snippet FROM m")
def fn_snippet(t: Tables):
    return t.m.select("id", S.snippet(F.col("text")).alias("snippet"))


@query("fn_links_json", "SELECT m.id, CASE WHEN i % 4 = 0 THEN 0 ELSE count(src) END AS n, CASE WHEN i % 4 = 0 THEN NULL ELSE min(dst) END AS first_to FROM m LEFT JOIN ed ON src = m.id GROUP BY m.id, i")
def fn_links_json(t: Tables):
    """Links as JSON and back; every fourth list is cut short, and counts as none."""
    links = t.e.groupBy(F.col("src").alias("id")).agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col("dst").alias("to"), "rel")))).alias("json"))
    text = F.when(F.col("i") % 4 == 0, '[{"to": "m0').otherwise(F.coalesce("json", F.lit("[]")))
    got = S.links_of(text)
    return t.m.join(links, "id", "left").select("id", F.size(got).cast("long").alias("n"), F.get(got, 0)["to"].alias("first_to"))


@query("goldset_read", "SELECT text AS query, ['m' || item_id] AS ids, 5 AS k FROM benchmark")
def goldset_read(t: Tables):
    """Cases from a file with comments and blank lines."""
    case = F.struct(F.col("text").alias("query"), F.array(F.concat(F.lit("m"), F.col("item_id").cast("string"))).alias("relevant_ids"), F.lit(5).alias("k"))
    lines = t.read("benchmark").select(F.to_json(case).alias("value"))
    notes = t.spark.createDataFrame([("# cases",), ("",), ("  ",)], "value string")
    return files.read_goldset(t.spark, t.file(notes.unionAll(lines))).select("query", F.col("relevant_ids").alias("ids"), "k")


@query("ingest_files")
def ingest_files(t: Tables):
    """Chunks of text files, one of them of all benchmark texts as paragraphs."""
    text = t.read("benchmark").orderBy("item_id").agg(F.array_join(F.collect_list("text"), "\n\n").alias("value"))
    found = files.ingest_files(t.spark, t.file(text))
    return found.select("position", "text")


@query("journal_scope", "SELECT sha256('/data/memories' || chr(10) || source) AS scope, count(*) AS n FROM m GROUP BY source")
def journal_scope(t: Tables):
    """The scope under which a collection at a path is logged."""
    scope = F.sha2(F.concat(F.lit("/data/memories\n"), "source"), 256)
    return t.m.groupBy(scope.alias("scope")).agg(F.count("*").alias("n"))


@query("weights_config", "SELECT type, round(avg(0.1::DOUBLE * importance), 9) AS part, round(0.1::DOUBLE, 9) AS share FROM m GROUP BY type")
def weights_config(t: Tables):
    """What importance adds to a row's score under the default weights, and its share."""
    w = Weights()
    return t.m.groupBy("type").agg(F.round(F.avg(w.importance * F.col("importance")), 9).alias("part"), F.lit(round(w.importance / w.core, 9)).alias("share"))



@query("tags_joined", "SELECT id, array_to_string(tags, ',') AS tags FROM m")
def tags_joined(t: Tables):
    return t.m.select("id", joined("tags").alias("tags"))

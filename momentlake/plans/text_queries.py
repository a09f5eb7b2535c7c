"""Queries of text functions, urls, transcript files and times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake.functions import text as T
from momentlake.operators import assembly, chunking
from momentlake.plans import sql as S
from momentlake.plans.rule_queries import IDEAS_CTE
from momentlake.sources import transcripts, web
from momentlake.sources.corpus import moments, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_NORMAL = S.normal("coalesce(text, '')")


@query(f"SELECT doc_id, {_NORMAL} AS normal FROM documents")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("normal"))


@query(f"SELECT doc_id, sha256({_NORMAL}) AS hash, substr(sha256(coalesce(text, '')), 1, 16) AS short, CASE WHEN trim(substr(coalesce(text, ''), 1, 500)) = '' THEN 'empty' ELSE sha256(trim(substr(coalesce(text, ''), 1, 500))) END AS preview FROM documents")
def text_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"), T.short_hash(text).alias("short"), T.preview_hash(F.col("text"), F.lit("")).alias("preview"))


@query(f"SELECT doc_id, len(s)::INTEGER AS n_sentences, list_max(list_transform(s, lambda x: length(x)))::INTEGER AS longest, s[1] AS first FROM (SELECT doc_id, {S.sentences(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS s FROM documents)")
def text_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.array_max(F.transform("s", lambda x: F.length(x))).alias("longest"), F.col("s")[0].alias("first"))


_WORDS = S.words("coalesce(text, '')")


@query(f"SELECT doc_id, len(w)::INTEGER AS n_words, len(list_distinct(w))::INTEGER AS n_distinct FROM (SELECT doc_id, {_WORDS} AS w FROM documents)")
def text_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"))


@query(f"SELECT doc_id, CASE WHEN length(n) = 0 THEN 0 ELSE len(list_distinct(list_transform(range(1, greatest(length(n) - 2, 1) + 1), lambda i: substr(n, i, 3)))) END::INTEGER AS n_grams FROM (SELECT doc_id, {_NORMAL} AS n FROM documents)")
def text_trigram_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("n"))
    return n.select("doc_id", F.size(T.grams(F.col("n"))).alias("n_grams"))


@query(f"SELECT doc_id, len(t)::INTEGER AS n_tokens, len(list_distinct(t))::INTEGER AS n_distinct, t[1] AS first FROM (SELECT doc_id, {S.tokens(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS t FROM documents)")
def text_fts_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", T.fts_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.try_element_at("t", F.lit(1)).alias("first"))


def snippet_sql(text: str, terms: list[str]) -> str:
    """A snippet as an expression over an alias ``text``; used inside a scalar macro-like CASE."""
    hits = ", ".join(f"nullif(strpos(lower({text}), {S.q(t)}), 0)" for t in terms if len(t) >= 2)
    at = f"list_min([{hits}])" if hits else "NULL"
    head = f"CASE WHEN length({text}) <= 240 THEN {text} ELSE substr({text}, 1, 240) || '...' END"
    start, end = f"greatest({at} - 121, 0)", f"least(length({text}), {at} + 119)"
    return (
        f"CASE WHEN {text} = '' THEN '' WHEN {at} IS NULL THEN {head} ELSE CASE WHEN {start} > 0 THEN '... ' ELSE '' END"
        f" || substr({text}, {start} + 1, {end} - {start}) || CASE WHEN {end} < length({text}) THEN ' ...' ELSE '' END END"
    )


@query(f"SELECT doc_id, {snippet_sql('t', ['then', 'tion', 'a'])} AS snippet FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def text_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.coalesce("text", F.lit("")), ["then", "tion", "a"]).alias("snippet"))


_CLOCK = "CASE WHEN s // 3600 > 0 THEN (s // 3600) || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') ELSE (s // 60)::VARCHAR END || ':' || lpad((s % 60)::VARCHAR, 2, '0')"


@query(f"SELECT event_id, {_CLOCK} AS label, {_CLOCK.replace('s //', '(s + 60) //').replace('s %', '(s + 60) %')} AS later, s::DOUBLE AS seconds FROM (SELECT event_id, floor(value * 60)::BIGINT AS s FROM events)")
def ts_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.floor(F.col("value") * 60).cast("double")
    labels = table(spark, sf_dir, "events").select("event_id", T.clock(s).alias("label"), T.clock(s + 60).alias("later"))
    return labels.withColumn("seconds", T.clock_seconds(F.col("label")))


@query(f"SELECT event_id, {_CLOCK} || '–' || {_CLOCK.replace('s //', '(s + 60) //').replace('s %', '(s + 60) %')} AS timestamp_label FROM (SELECT event_id, floor(value * 60)::BIGINT AS s FROM events)")
def ts_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.floor(F.col("value") * 60).cast("double")
    return table(spark, sf_dir, "events").select("event_id", T.clock_range(s, s + 60).alias("timestamp_label"))


@query("SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&t=' ELSE '?t=' END || (page_id * 7) || 's' AS link FROM pages")
def ts_deeplink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.deep_link(F.col("url"), F.col("page_id") * 7.0).alias("link"))


@query(S.with_moments("SELECT ord, video_id || ':' || printf('%.2f', start_sec) || ':' || printf('%.2f', end_sec) AS id FROM m"))
def moment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments(spark, sf_dir).select("ord", T.moment_id(F.col("video_id"), F.col("start_sec"), F.col("end_sec")).alias("id"))


@query("SELECT page_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE) ELSE printf('%.1f MB', n / 1048576.0::DOUBLE) END AS size FROM (SELECT page_id, length(html) AS n FROM pages)")
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.human_size(F.length("html")).alias("size"))


# Pages' urls with every fifth turned into one of a known provider's forms.
_URLS_SQL = """u AS (
  SELECT page_id, CASE page_id % 5
    WHEN 0 THEN 'https://youtu.be/' || substr(sha256(page_id::VARCHAR), 1, 11) || '?list=x'
    WHEN 1 THEN 'https://M.YouTube.com/watch?list=x&v=' || substr(sha256(page_id::VARCHAR), 1, 11) || '&t=3'
    WHEN 2 THEN 'https://player.vimeo.com/video/' || page_id
    WHEN 3 THEN '/home/v/' || page_id || '.mp4'
    ELSE url END AS url FROM pages)"""


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.substring(F.sha2(F.col("page_id").cast("string"), 256), 1, 11)
    k = F.col("page_id") % 5
    url = (
        F.when(k == 0, F.concat(F.lit("https://youtu.be/"), short, F.lit("?list=x"))).when(k == 1, F.concat(F.lit("https://M.YouTube.com/watch?list=x&v="), short, F.lit("&t=3")))
        .when(k == 2, F.concat(F.lit("https://player.vimeo.com/video/"), F.col("page_id").cast("string"))).when(k == 3, F.concat(F.lit("/home/v/"), F.col("page_id").cast("string"), F.lit(".mp4"))).otherwise(F.col("url"))
    )
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"))


@query(f"WITH {_URLS_SQL} SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://www.youtube.com/watch?v=' || substr(sha256(page_id::VARCHAR), 1, 11) WHEN 1 THEN 'https://www.youtube.com/watch?v=' || substr(sha256(page_id::VARCHAR), 1, 11) ELSE url END AS url FROM u")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("page_id", web.normal_url(F.col("url")).alias("url"))


@query(f"WITH {_URLS_SQL} SELECT page_id, CASE WHEN page_id % 5 < 2 THEN 'youtube' WHEN page_id % 5 = 2 THEN 'vimeo' WHEN page_id % 5 = 3 THEN 'local' WHEN regexp_matches(url, '^https?://') THEN 'generic' ELSE 'local' END AS provider, CASE WHEN page_id % 2 = 0 THEN 'webpage' WHEN page_id % 5 < 2 THEN 'youtube' WHEN page_id % 5 = 2 THEN 'vimeo' WHEN page_id % 5 = 3 THEN 'local' WHEN regexp_matches(url, '^https?://') THEN 'generic' ELSE 'local' END AS hinted FROM u")
def provider_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    hint = F.when(F.col("page_id") % 2 == 0, "webpage").otherwise("auto")
    return _urls(spark, sf_dir).select("page_id", web.provider(F.col("url")).alias("provider"), web.provider(F.col("url"), hint).alias("hinted"))


@query(f"WITH {_URLS_SQL} SELECT page_id, CASE WHEN page_id % 5 < 2 THEN substr(sha256(page_id::VARCHAR), 1, 11) ELSE substr(sha256(url), 1, 16) END AS video_id FROM u")
def video_id_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("page_id", web.video_id(F.col("url")).alias("video_id"))


# Transcript files made of conversations: a cue of five seconds for each turn.
_CUES = """c AS (
  SELECT conv_id, turn, regexp_replace(text, '\\s+', ' ', 'g') AS line, turn * 5 AS s FROM conversations)"""


def _files(spark: SparkSession, sf_dir: str, stamp: str, head: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"\s+", " ").alias("line"))
    at = lambda t: F.format_string(f"00:%02d:%02d{stamp}", F.floor(t / 60).cast("int"), (t % 60).cast("int"))
    cue = F.concat((F.col("turn") + 1).cast("string"), F.lit("\n"), at(F.col("turn") * 5), F.lit(" --> "), at(F.col("turn") * 5 + 4), F.lit("\n"), "line")
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", cue.alias("cue")))).alias("cues"))
    text = F.concat(F.lit(head), F.array_join(F.transform("cues", lambda x: x["cue"]), "\n\n"))
    return rows.select(F.col("conv_id").alias("video_id"), text.alias("text"))


_ROW = "row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1"


@query(rf"WITH {_CUES} SELECT conv_id AS video_id, ({_ROW})::INTEGER AS seq, s + 0.5::DOUBLE AS start_sec, s + 4.5::DOUBLE AS end_sec, trim(line) AS text FROM c WHERE NOT regexp_matches(trim(line), '^\d+$')")
def parse_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.parse_srt(_files(spark, sf_dir, ",500", ""))


@query(rf"WITH {_CUES} SELECT conv_id AS video_id, ({_ROW})::INTEGER AS seq, s + 0.25::DOUBLE AS start_sec, s + 4.25::DOUBLE AS end_sec, (turn + 1) || ' ' || trim(line) AS text FROM c")
def parse_vtt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.parse_vtt(_files(spark, sf_dir, ".250", "WEBVTT\nKind: captions\n\n"))


_TXT = f"""p AS (SELECT doc_id, {S.strip("text")} AS t FROM documents WHERE {S.strip("text")} <> ''),
s AS (SELECT doc_id, greatest(length(t) / 15.0::DOUBLE, 30.0::DOUBLE) / length(t) AS rate, unnest({S.sentences("t")}) AS x, generate_subscripts({S.sentences("t")}, 1) AS k FROM p),
l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS seq, greatest(length({S.strip("x")}) * rate, 1.0::DOUBLE) AS lasts, {S.strip("x")} AS text FROM s WHERE {S.strip("x")} <> ''),
e AS (SELECT doc_id AS video_id, seq, text, sum(lasts) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS hi, lasts FROM l)"""


@query(f"WITH {_TXT} SELECT video_id, seq::INTEGER AS seq, round(hi - lasts, 4) AS start_sec, round(hi, 4) AS end_sec, text FROM e")
def parse_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), "text")
    return transcripts.parse_txt(files).withColumns({"start_sec": F.round("start_sec", 4), "end_sec": F.round("end_sec", 4)})


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as entries of 7 to 36 seconds."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("seq"), (F.col("turn") * 40.0).alias("start_sec"), (F.col("turn") * 40.0 + 7 + F.length("text") % 30).alias("end_sec"), "text")


_CHUNKS = (
    f"en AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY s, seq) AS k, count(*) OVER (PARTITION BY video_id) AS n, s, greatest(s, e) AS e, t FROM (SELECT conv_id AS video_id, turn AS seq, turn * 40.0::DOUBLE AS s, turn * 40.0::DOUBLE + 7 + length(text) % 30 AS e, {S.collapse("coalesce(text, '')")} AS t FROM conversations) WHERE t <> '')",
    "ov AS (SELECT a.video_id, a.k AS f, a.n, a.s AS start, coalesce(min(CASE WHEN b.e - a.s > 120 THEN b.k END), a.n + 1) AS over FROM en a JOIN en b ON b.video_id = a.video_id AND b.k >= a.k GROUP BY a.video_id, a.k, a.n, a.s)",
    r"st AS (SELECT o.video_id, o.f, o.n, CASE WHEN o.over > o.n THEN o.n ELSE coalesce(max(CASE WHEN b.e - o.start >= 30 AND regexp_matches(b.t, '[.!?]\s*$') THEN b.k END), greatest(o.f, o.over - 1)) END AS g FROM ov o JOIN en b ON b.video_id = o.video_id AND b.k BETWEEN o.f AND o.over GROUP BY o.video_id, o.f, o.n, o.over, o.start)",
    "pc AS (SELECT video_id, 0 AS p, f, g, n FROM st WHERE f = 1 UNION ALL SELECT pc.video_id, pc.p + 1, st.f, st.g, st.n FROM pc JOIN st ON st.video_id = pc.video_id AND st.f = pc.g + 1)",
    "pt AS (SELECT pc.video_id, pc.p, min(CASE WHEN en.k = pc.f THEN en.s END) AS s, max(CASE WHEN en.k = pc.g THEN en.e END) AS e, string_agg(en.t, ' ' ORDER BY en.k) AS t FROM pc JOIN en ON en.video_id = pc.video_id AND en.k BETWEEN pc.f AND pc.g GROUP BY pc.video_id, pc.p)",
    "mg AS (SELECT video_id, p, 0 AS o, s AS os, e AS oe FROM pt WHERE p = 0 UNION ALL SELECT mg.video_id, pt.p, CASE WHEN pt.e - pt.s < 30 AND pt.e - mg.os <= 120 THEN mg.o ELSE mg.o + 1 END, CASE WHEN pt.e - pt.s < 30 AND pt.e - mg.os <= 120 THEN mg.os ELSE pt.s END, pt.e FROM mg JOIN pt ON pt.video_id = mg.video_id AND pt.p = mg.p + 1)",
    "ck AS (SELECT mg.video_id, mg.o AS seq, min(mg.os) AS start_sec, arg_max(mg.oe, mg.p) AS end_sec, string_agg(pt.t, ' ' ORDER BY mg.p) AS transcript_text FROM mg JOIN pt ON pt.video_id = mg.video_id AND pt.p = mg.p GROUP BY mg.video_id, mg.o)",
)


@query("WITH RECURSIVE " + ",\n".join(_CHUNKS) + " SELECT video_id, seq::INTEGER AS seq, start_sec, end_sec, transcript_text FROM ck")
def chunk_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(_entries(spark, sf_dir))


@query(
    """WITH v AS (SELECT source AS video_id, sum(n_chars) / 15.0::DOUBLE AS d FROM documents GROUP BY source)
SELECT video_id, k::INTEGER AS seq, k * 60.0::DOUBLE AS start_sec, least((k + 1) * 60.0::DOUBLE, d) AS end_sec FROM v, LATERAL (SELECT unnest(range(0, ceil(d / 60)::BIGINT)) AS k)"""
)
def fallback_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("video_id")).agg((F.sum("n_chars") / 15.0).alias("duration_sec"))
    return chunking.tiles(v)


@query(
    """WITH v AS (SELECT source AS video_id, sum(n_chars) / 15.0::DOUBLE AS d FROM documents GROUP BY source)
SELECT video_id, k::INTEGER AS seq, least(k * 30.0::DOUBLE, d) AS timestamp_sec FROM v, LATERAL (SELECT unnest(range(0, greatest(1, ceil(d / 30)::BIGINT))) AS k)"""
)
def keyframe_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("video_id")).agg((F.sum("n_chars") / 15.0).alias("duration_sec"))
    return chunking.frame_times(v)


# Screen texts are taken from events: the video is a source, the time a multiple of 20 s.
_OCR = "o AS (SELECT 'src' || (event_id % 20) AS video_id, (event_id * 20 % 90000)::DOUBLE AS timestamp_sec, event_type AS text FROM events)"


def _ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("src"), (e % 20).cast("string")).alias("video_id"), (e * 20 % 90000).cast("double").alias("timestamp_sec"), F.col("event_type").alias("text"), F.lit(0.9).alias("confidence"))


@query(S.with_moments("SELECT m.moment_id, o.timestamp_sec, o.text FROM m JOIN o ON o.video_id = m.video_id AND o.timestamp_sec BETWEEN m.start_sec AND m.end_sec", _OCR))
def ocr_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.seen_in(moments(spark, sf_dir), _ocr(spark, sf_dir)).select("moment_id", "timestamp_sec", "text")


@query(
    S.with_moments(
        "SELECT moment_id, string_agg(text, ' ' ORDER BY t) AS ocr_text FROM (SELECT m.moment_id, o.text, min(o.timestamp_sec) AS t, min((o.timestamp_sec, o.text)) AS f FROM m JOIN o ON o.video_id = m.video_id AND o.timestamp_sec BETWEEN m.start_sec AND m.end_sec GROUP BY m.moment_id, o.text) GROUP BY moment_id".replace("ORDER BY t", "ORDER BY t, text"),
        _OCR,
    )
)
def ocr_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.screen_text(moments(spark, sf_dir), _ocr(spark, sf_dir))


@query(
    S.with_moments(
        "SELECT video_id, moment_id, p::INTEGER AS place FROM (SELECT video_id, moment_id, row_number() OVER (PARTITION BY video_id ORDER BY start_sec, moment_id) - 1 AS p, count(*) OVER (PARTITION BY video_id) AS n FROM m) WHERE n < 3 OR p IN (n // 4, n // 2, 3 * n // 4)"
    )
)
def timeline_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.anchors(moments(spark, sf_dir))


def _assembled(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Conversations as videos, with screen texts from events."""
    e = F.col("event_id")
    videos = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id")).distinct().withColumn("duration_sec", F.lit(0.0))
    seen = table(spark, sf_dir, "events").select((e % 500).alias("video_id"), (e % 600).cast("double").alias("timestamp_sec"), F.col("event_type").alias("text"), F.lit(0.9).alias("confidence"), F.concat(F.lit("frames/"), e.cast("string")).alias("path"))
    return assembly.assemble(videos, _entries(spark, sf_dir), seen.drop("path"), seen.select("video_id", "timestamp_sec", "path"))


_ASSEMBLED = (
    *_CHUNKS,
    "al AS (SELECT * FROM ck UNION ALL SELECT DISTINCT conv_id, 0, 0.0::DOUBLE, 60.0::DOUBLE, '' FROM conversations WHERE conv_id NOT IN (SELECT video_id FROM en))",
    "bare AS (SELECT *, video_id || ':' || printf('%.2f', start_sec) || ':' || printf('%.2f', end_sec) AS moment_id FROM al)",
    "ev AS (SELECT event_id, event_id % 500 AS video_id, (event_id % 600)::DOUBLE AS tm, event_type AS text FROM events)",
    "seen AS (SELECT moment_id, string_agg(text, ' ' ORDER BY tm, text) AS ocr_text FROM (SELECT bare.moment_id, ev.text, min(ev.tm) AS tm FROM bare JOIN ev ON ev.video_id = bare.video_id AND ev.tm BETWEEN bare.start_sec AND bare.end_sec GROUP BY ALL) GROUP BY moment_id)",
    "mo AS (SELECT bare.*, coalesce(seen.ocr_text, '') AS ocr_text FROM bare LEFT JOIN seen USING (moment_id))",
)


@query("WITH RECURSIVE " + ",\n".join(_ASSEMBLED) + f" SELECT moment_id, video_id, seq::INTEGER AS seq, start_sec, end_sec, transcript_text, ocr_text, sha256({S.normal("trim(trim(transcript_text) || ' ' || trim(ocr_text))")}) AS content_hash FROM mo")
def ingest_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of parsed transcripts with their screen texts and hashes."""
    return _assembled(spark, sf_dir)["moments"]


_EVIDENCE = """SELECT moment_id, 'transcript' AS modality, transcript_text AS content, 1.0::DOUBLE AS confidence FROM mo WHERE trim(transcript_text) <> ''
UNION ALL SELECT mo.moment_id, 'ocr', ev.text, 0.9::DOUBLE FROM mo JOIN ev ON ev.video_id = mo.video_id AND ev.tm BETWEEN mo.start_sec AND mo.end_sec
UNION ALL SELECT mo.moment_id, 'visual', 'frames/' || ev.event_id, 1.0::DOUBLE FROM mo JOIN ev ON ev.video_id = mo.video_id AND ev.tm BETWEEN mo.start_sec AND mo.end_sec
UNION ALL SELECT moment_id, 'idea', text, confidence FROM ideas"""


@query("WITH RECURSIVE " + ",\n".join([*_ASSEMBLED, "m AS (SELECT moment_id, transcript_text FROM mo)", IDEAS_CTE]) + "\n" + _EVIDENCE)
def ingest_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assembled(spark, sf_dir)["evidence"]

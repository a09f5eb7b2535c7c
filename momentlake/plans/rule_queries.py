"""Queries of the rule operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake.functions import rules as R
from momentlake.operators import rules as op
from momentlake.plans import sql as S
from momentlake.plans.lineage import cut
from momentlake.sources.corpus import moments

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _kind(x: str, given: list, fallback: str, field: int, ignore_case: bool = False) -> str:
    cases = " ".join(f"WHEN {S.any_match(x, p, ignore_case)} THEN {S.q(n) if field == 0 else f'{c}::DOUBLE'}" for n, c, p in given)
    return f"CASE {cases} ELSE {fallback} END"


IDEAS_CTE = f"""is1 AS (
  SELECT moment_id, unnest({S.sentences(S.collapse('transcript_text'))}) AS text, generate_subscripts({S.sentences(S.collapse('transcript_text'))}, 1) - 1 AS pos FROM m),
is2 AS (SELECT moment_id, pos, trim(text) AS text, lower(trim(text)) AS low, list_slice(regexp_split_to_array(lower(trim(text)), '[\\s\\p{{Z}}]+'), 1, 50) AS w FROM is1 WHERE length(trim(text)) >= 10),
is3 AS (SELECT *, {_kind('low', R.IDEA_RULES, "'claim'", 0)} AS type, {_kind('low', R.IDEA_RULES, '0.5::DOUBLE', 1)} AS confidence FROM is2),
is4 AS (SELECT *, row_number() OVER (PARTITION BY moment_id, type, substr(text, 1, 80) ORDER BY pos) AS r FROM is3
        WHERE type <> 'claim' OR (len(w) >= 8 AND len(list_distinct(w))::DOUBLE / len(w) > 0.6)),
ideas AS (SELECT 'idea:' || moment_id || ':' || pos AS idea_id, moment_id, pos::INTEGER AS pos, type, confidence, text FROM is4 WHERE r = 1)"""

_BOTH = "transcript_text || chr(10) || ocr_text"
CLAIMS_CTE = f"""cs1 AS (SELECT moment_id, unnest({S.sentences(_BOTH)}) AS text, generate_subscripts({S.sentences(_BOTH)}, 1) - 1 AS pos FROM m),
cs2 AS (SELECT moment_id, pos, {S.strip('text')} AS text FROM cs1),
cs3 AS (SELECT *, row_number() OVER (PARTITION BY moment_id, lower(text) ORDER BY pos) AS r FROM cs2 WHERE length(text) >= 10),
claims AS (
  SELECT 'clm:' || substr(sha256(moment_id || '|' || pos), 1, 12) AS claim_id, moment_id, pos::INTEGER AS pos,
         {_kind('text', R.CLAIM_RULES, "'factual'", 0, True)} AS type, {_kind('text', R.CLAIM_RULES, '0.5::DOUBLE', 1, True)} AS confidence,
         substr(text, 1, 2000) AS text, substr({S.claim_normal('text')}, 1, 2000) AS normalized
  FROM cs3 WHERE r = 1)"""


def _extract(x: str, patterns: list[str], strip: str, least: int, ignore_case: bool = False, groups: dict[int, int] | None = None) -> str:
    """List of distinct matches in order; a leading boundary of RE2 makes group 1 the match."""
    parts = []
    for k, p in enumerate(patterns):
        group = (groups or {}).get(k, 0)
        bare = p[2:] if p.startswith(r"\b") else p[len(r"(?:\b|(?<=\s))") :] if p.startswith(r"(?:\b|(?<=\s))") else p
        if bare != p and not group:
            p = p[: -len(bare)] + f"({bare})"
            group = 1
        parts.append(f"regexp_extract_all({x}, {S.q(R.re2(p, ignore_case))}, {group})")
    got = "list_concat(" + ", ".join(parts) + ")" if len(parts) > 1 else parts[0]
    clean = f"rtrim({S.strip('x')}, {S.q(strip)})" if strip else "x"
    listed = f"list_filter(list_transform({got}, lambda x: {clean}), lambda x: length(x) >= {least})"
    return listed


def _distinct_rows(name: str, modality: str, listed: str, confidence: float) -> str:
    return f"""{name}1 AS (SELECT moment_id, unnest(l) AS x, generate_subscripts(l, 1) AS p FROM (SELECT moment_id, {listed} AS l FROM (SELECT moment_id, {_BOTH} AS b FROM m))),
{name}2 AS (SELECT moment_id, x, min(p) AS p FROM {name}1 GROUP BY moment_id, x),
{name} AS (SELECT moment_id, '{modality}' AS modality, (row_number() OVER (PARTITION BY moment_id ORDER BY p) - 1)::INTEGER AS pos, substr(x, 1, 1000) AS content, {confidence}::DOUBLE AS confidence FROM {name}2)"""


PATHS_CTE = _distinct_rows("tp", "file_path", _extract("b", R.FILE_PATHS, ".,;:')]}", 3, True), 0.9)
COMMANDS_CTE = _distinct_rows("tc", "command", _extract("b", R.COMMANDS, ".,;:'\"", 3, True), 0.9)
ERRORS_CTE = _distinct_rows("te", "error", _extract("b", R.ERRORS, ".,;:", 5, True), 0.9)
EQUATIONS_CTE = _distinct_rows("tq", "equation", _extract("b", R.EQUATIONS, ".,;:", 3), 0.9)
CODE_CTE = _distinct_rows("tk", "code", _extract("b", R.CODE_IDENTIFIERS, "", 2, groups={0: 1, 1: 1, 2: 1}), 0.8)
IMPORTS_CTE = _distinct_rows("ti", "import", _extract("b", R.IMPORTS, "", 1, groups={0: 1, 1: 1}), 0.9)
TECHNICAL_CTES = (PATHS_CTE, COMMANDS_CTE, ERRORS_CTE, EQUATIONS_CTE, CODE_CTE, """technical AS (
  SELECT 'tev:' || substr(sha256(moment_id || '|' || modality || '|' || pos), 1, 12) AS evidence_id, moment_id, modality, pos, content, confidence
  FROM (SELECT * FROM tp UNION ALL SELECT * FROM tc UNION ALL SELECT * FROM te UNION ALL SELECT * FROM tq UNION ALL SELECT * FROM tk))""")


def _listed_terms(x: str, terms) -> str:
    tests = ", ".join(f"CASE WHEN regexp_matches({x}, {S.q('(?i)(?:^|[^a-zA-Z])' + t.replace('-', '\\-') + '(?:$|[^a-zA-Z])')}) THEN {S.q(t)} END" for t in terms)
    return f"list_filter([{tests}], lambda y: y IS NOT NULL)"


def entities_list(x: str) -> str:
    """List of structs (l, t) before the first spelling is kept."""
    def of(kind: str, listed: str) -> str:
        return f"list_transform({listed}, lambda z: {{'l': z, 't': '{kind}'}})"

    acronyms = rf"regexp_extract_all(regexp_replace({x}, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'), '(?:^|[^\p{{L}}\p{{N}}_])([A-Z]{{2,6}})(?:$|[^\p{{L}}\p{{N}}_])', 1)"
    calls = rf"regexp_extract_all({x}, '(?:^|[^\p{{L}}\p{{N}}_])([A-Z][a-zA-Z0-9]*\([^)]*\))', 1)"
    methods = rf"regexp_extract_all({x}, '(?:^|[^\p{{L}}\p{{N}}_])([a-z][a-zA-Z0-9]*\.[a-z][a-zA-Z0-9]+)', 1)"
    dotted = rf"regexp_extract_all({x}, '[a-z][a-zA-Z0-9]*(?:\.[a-zA-Z][a-zA-Z0-9]*)+')"
    return "list_concat(" + ", ".join([
        of("capitalized_phrase", rf"list_filter(regexp_extract_all({x}, {S.q(R.re2(R.CAPITALIZED))}), lambda y: length(y) >= 4)"),
        of("acronym", acronyms),
        of("file_path", rf"list_filter(regexp_extract_all({x}, {S.q(R.ENTITY_PATHS)}), lambda y: length(y) >= 3 AND NOT regexp_matches(y, '[.,)]$'))"),
        of("code_identifier", f"list_filter(list_transform(list_concat({calls}, {methods}, {dotted}), lambda y: rtrim(y, ')')), lambda y: length(y) >= 4)"),
        of("known_term", _listed_terms(x, R.KNOWN_TERMS)),
        of("package", _listed_terms(x, R.PACKAGES)),
    ]) + ")"


def entities_cte(name: str, source: str, key: str, text: str) -> str:
    return f"""{name}1 AS (SELECT {key}, unnest(l) AS e, generate_subscripts(l, 1) AS p FROM (SELECT {key}, {entities_list('b')} AS l FROM (SELECT {key}, {text} AS b FROM {source}))),
{name}2 AS (SELECT {key}, e, p, row_number() OVER (PARTITION BY {key}, lower(e.l) ORDER BY p) AS r FROM {name}1),
{name} AS (SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY p) - 1)::INTEGER AS pos, e.l AS label, e.t AS entity_type FROM {name}2 WHERE r = 1)"""


ENTITIES_CTE = entities_cte("ents", "m", "moment_id", _BOTH)

FRESH_CTE = f"""fr AS (SELECT moment_id AS item_id, lower(transcript_text || ' ' || ocr_text) AS low FROM m),
fs AS (
  SELECT item_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE,
         1.0::DOUBLE - CASE WHEN {S.has_any('low', R.STALE)} THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END
         + CASE WHEN {S.has_any('low', R.FRESH)} THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
         - CASE WHEN {S.has_any('low', R.TOOLS)} THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)) AS freshness_score
  FROM fr)"""


@query(S.with_moments("SELECT * FROM ideas", IDEAS_CTE))
def ideas_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.ideas(moments(spark, sf_dir))


@query(S.with_moments("SELECT type, count(*) AS n FROM ideas GROUP BY type", IDEAS_CTE))
def ideas_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.ideas(moments(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"))


@query(S.with_moments("SELECT claim_id, moment_id, pos, type, confidence, text FROM claims", CLAIMS_CTE))
def claims_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.claims(moments(spark, sf_dir)).drop("normalized")


@query(S.with_moments("SELECT claim_id, normalized FROM claims", CLAIMS_CTE))
def claims_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.claims(moments(spark, sf_dir)).select("claim_id", "normalized")


@query(S.with_moments("SELECT type, count(*) AS n FROM claims GROUP BY type", CLAIMS_CTE))
def claims_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.claims(moments(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"))


@query(
    S.with_moments(
        """SELECT a.claim_id AS claim_a, b.claim_id AS claim_b,
       CASE WHEN a.neg AND b.pos THEN 'negative vs positive directive' ELSE 'positive vs negative directive' END AS reason
FROM s a JOIN s b ON a.claim_id < b.claim_id AND ((a.neg AND b.pos) OR (a.pos AND b.neg))""",
        CLAIMS_CTE,
        f"s AS (SELECT claim_id, {S.starts_any('lower(text)', R.NEGATIVE)} AS neg, {S.starts_any('lower(text)', R.POSITIVE)} AS pos FROM claims)",
    )
)
def claims_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.contradictions(op.claims(moments(spark, sf_dir)))


@query(
    S.with_moments(
        """SELECT x.claim_id, x.neg, x.pos, count(y.claim_id) AS n_against, min(y.claim_id) AS first_against
FROM s x LEFT JOIN s y ON x.claim_id <> y.claim_id AND ((x.neg AND y.pos) OR (x.pos AND y.neg)) WHERE x.neg OR x.pos GROUP BY ALL""",
        CLAIMS_CTE,
        f"s AS (SELECT claim_id, {S.starts_any('lower(text)', R.NEGATIVE)} AS neg, {S.starts_any('lower(text)', R.POSITIVE)} AS pos FROM claims)",
    )
)
def claims_opposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each directive with how many others contradict it: one row a claim, whatever the number of pairs."""
    return op.opposed(cut(op.claims(moments(spark, sf_dir))))


def _technical(name: str, modality: str, cte: str, table: str, function) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = moments(spark, sf_dir)
        return m.select("moment_id", F.posexplode(function(op.combined(m))).alias("pos", "content")).withColumn("content", F.substring("content", 1, 1000))

    run.__name__ = name
    query(S.with_moments(f"SELECT moment_id, pos, content FROM {table}", cte))(run)


_technical("tech_paths", "file_path", PATHS_CTE, "tp", op.file_paths)
_technical("tech_commands", "command", COMMANDS_CTE, "tc", op.commands)
_technical("tech_errors", "error", ERRORS_CTE, "te", op.errors)
_technical("tech_equations", "equation", EQUATIONS_CTE, "tq", op.equations)
_technical("tech_code", "code", CODE_CTE, "tk", op.code_identifiers)
_technical("tech_imports", "import", IMPORTS_CTE, "ti", op.imports)


@query(S.with_moments("SELECT * FROM technical", *TECHNICAL_CTES))
def tech_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.technical(moments(spark, sf_dir))


@query(S.with_moments("SELECT modality, count(*) AS n, count(DISTINCT moment_id) AS n_moments FROM technical GROUP BY modality", *TECHNICAL_CTES))
def tech_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.technical(moments(spark, sf_dir)).groupBy("modality").agg(F.count("*").alias("n"), F.countDistinct("moment_id").alias("n_moments"))


@query(S.with_moments("SELECT * FROM ents", ENTITIES_CTE))
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.moment_entities(moments(spark, sf_dir))


@query(S.with_moments("SELECT lower(label) AS entity, entity_type, count(*) AS n FROM ents GROUP BY ALL", ENTITIES_CTE))
def entity_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op.moment_entities(moments(spark, sf_dir))
    return found.groupBy(F.lower("label").alias("entity"), "entity_type").agg(F.count("*").alias("n"))


@query(
    S.with_moments(
        "SELECT item_id, freshness_score, CASE WHEN freshness_score < 0.5 THEN 'potentially stale' ELSE '' END AS stale_reason, CASE WHEN freshness_score >= 0.7 THEN 'fresh' WHEN freshness_score < 0.5 THEN 'stale' ELSE 'neutral' END AS band FROM fs",
        FRESH_CTE,
    )
)
def freshness_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.freshness_scores(moments(spark, sf_dir))


@query(
    S.with_moments(
        "SELECT count(*) AS total_scored, round(sum((freshness_score * 10)::INTEGER)::DOUBLE / 10.0 / count(*), 3) AS average_freshness, count(*) FILTER (WHERE freshness_score < 0.5) AS stale_count, count(*) FILTER (WHERE freshness_score >= 0.7) AS fresh_count FROM fs",
        FRESH_CTE,
    )
)
def freshness_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = op.freshness_scores(moments(spark, sf_dir))
    tenths = F.sum(F.round(F.col("freshness_score") * 10).cast("int"))
    return s.agg(
        F.count("*").alias("total_scored"), F.round(tenths.cast("double") / 10.0 / F.count("*"), 3).alias("average_freshness"),
        F.count_if(F.col("freshness_score") < 0.5).alias("stale_count"), F.count_if(F.col("freshness_score") >= 0.7).alias("fresh_count"),
    )



"""Rule operators: ideas, claims, technical evidence, entities and freshness of moments."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentlake.functions import rules as R
from momentlake.functions import text as T
from momentlake.plans.lineage import cut


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed one time, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _holds(text: Column, need: Iterable[Iterable[str]]) -> Column:
    """Whether the text holds a string of each group."""
    return reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in group)) for group in need), F.lit(True))


def _folded(text: Column) -> Column:
    """In lower case, with the letters that patterns without regard to case take for plain ones."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.lower(F.translate(text, R.CASE_FROM, R.CASE_TO)))  # ASCII has none of them


def _first_class(text: Column, folded: Column, given: list, fallback: tuple[str, float], ignore_case: bool = False, need: dict[str, tuple[str, ...]] | None = None) -> Column:
    """(type, confidence) of the first class with a pattern that is found; with ``need``, a class is tried where the text holds a string that it needs."""
    out = F.struct(F.lit(fallback[0]).alias("type"), F.lit(fallback[1]).alias("confidence"))
    for name, confidence, patterns in reversed(given):
        found = text.rlike(R.java(R.any_of(patterns), ignore_case))
        out = F.when(_holds(folded, [need[name]]) & found if need else found, F.struct(F.lit(name).alias("type"), F.lit(confidence).alias("confidence"))).otherwise(out)
    return out


def informative(sentence: Column) -> Column:
    """Eight words or more, over 60 % of the first fifty of them different."""
    first = F.slice(F.split(F.lower(sentence), r"(?U)\s+", 51), 1, 50)
    return _once(first, lambda w: (F.size(w) >= 8) & (F.size(F.array_distinct(w)) / F.size(w) > 0.6))


def ideas(moments: DataFrame) -> DataFrame:
    """``idea_id, moment_id, pos, type, confidence, text``: typed sentences of transcripts."""
    # inside arrays each sentence is classified once; a filter on rows would be pushed below and classify again
    told = F.transform(T.sentences(T.collapse(F.col("transcript_text"))), lambda x, k: F.struct(k.alias("pos"), F.trim(x).alias("text")))
    told = F.transform(F.filter(told, lambda x: F.length(x["text"]) >= 10), lambda x: F.struct(x["pos"].alias("pos"), x["text"].alias("text"), _once(F.lower(x["text"]), lambda low: _first_class(low, low, R.IDEA_RULES, R.IDEA_FALLBACK, need=R.IDEA_NEED)).alias("kind")))
    told = F.filter(told, lambda x: (x["kind"]["type"] != R.IDEA_FALLBACK[0]) | informative(x["text"]))
    told = moments.select("moment_id", F.explode(told).alias("s")).select("moment_id", "s.*")
    one = told.groupBy("moment_id", "kind", F.substring("text", 1, 80).alias("head")).agg(F.min(F.struct("pos", "text")).alias("first"))
    return one.select(F.concat_ws(":", F.lit("idea"), "moment_id", F.col("first.pos").cast("string")).alias("idea_id"), "moment_id", F.col("first.pos").alias("pos"), "kind.type", "kind.confidence", "first.text")


def claims(moments: DataFrame) -> DataFrame:
    """``claim_id, moment_id, pos, type, confidence, text, normalized``: sentences as claims.

    The class with the highest confidence wins, the earlier one on ties; confidences never
    rise along the classes, so that is the first that is found.
    """
    both = F.concat(F.coalesce("transcript_text", F.lit("")), F.lit("\n"), F.coalesce("ocr_text", F.lit("")))
    told = moments.select("moment_id", F.posexplode(T.sentences(both)).alias("pos", "text"))
    told = told.withColumn("text", F.regexp_replace("text", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).where(F.length("text") >= 10)
    one = told.groupBy("moment_id", F.lower("text").alias("low")).agg(F.min(F.struct("pos", "text")).alias("first"))
    text = F.col("first.text")
    kind = _once(_folded(text), lambda low: _first_class(text, low, R.CLAIM_RULES, R.CLAIM_FALLBACK, ignore_case=True, need=R.CLAIM_NEED))
    ident = F.concat(F.lit("clm:"), T.short_hash(F.concat_ws("|", "moment_id", F.col("first.pos").cast("string")), 12))
    one = one.withColumn("kind", kind)
    return one.select(ident.alias("claim_id"), "moment_id", F.col("first.pos").alias("pos"), "kind.type", "kind.confidence", F.substring(text, 1, 2000).alias("text"), F.substring(T.normalize_claim(text), 1, 2000).alias("normalized"))


def _starts(text: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.startswith(F.lower(text), F.lit(p)) for p in prefixes))


def directives(claims: DataFrame) -> DataFrame:
    """``claim_id, neg, pos`` of the claims that forbid or ask for something; "do not" is a "do" as well, as the rules have it."""
    signed = claims.select("claim_id", _starts(F.col("text"), R.NEGATIVE).alias("neg"), _starts(F.col("text"), R.POSITIVE).alias("pos"))
    return signed.where("neg or pos")


def opposed(claims: DataFrame) -> DataFrame:
    """``claim_id, neg, pos, n_against, first_against`` of every directive: how many others have the other sign, and the first of them.

    One row a claim, from totals of the two sides; `contradictions` gives the pairs.
    """
    d = directives(claims)
    low = lambda test: F.min(F.when(test, F.col("claim_id")))
    totals = d.agg(F.count_if("neg").alias("n_neg"), F.count_if("pos").alias("n_pos"), F.count("*").alias("n"), low(F.col("neg")).alias("first_neg"), low(F.col("pos")).alias("first_pos"), F.min("claim_id").alias("first"))
    totals = totals.crossJoin(d.crossJoin(F.broadcast(totals.select("first"))).agg(low(F.col("claim_id") > F.col("first")).alias("second")))  # one row each
    both = F.col("neg") & F.col("pos")
    joined = d.crossJoin(F.broadcast(totals))
    against = F.when(both, F.col("n") - 1).when(F.col("neg"), F.col("n_pos")).otherwise(F.col("n_neg"))
    first = F.when(both, F.when(F.col("claim_id") == F.col("first"), F.col("second")).otherwise(F.col("first"))).when(F.col("neg"), F.col("first_pos")).otherwise(F.col("first_neg"))
    return joined.select("claim_id", "neg", "pos", against.alias("n_against"), first.alias("first_against"))


def contradictions(claims: DataFrame, asked: DataFrame | None = None, salts: int = 64) -> DataFrame:
    """``claim_a, claim_b, reason``: negative directives against positive ones, a before b.

    Claims are ordered by id. ``asked`` (claim_id) leaves only pairs with one of these
    claims: that is the form for large tables, as pairs of all are as many as the product of
    the sides. One side is dealt to ``salts`` tasks and the other sent to each; a pair is made
    in one task only and leaves it as a row of the result, so pairs are never shuffled.
    """
    d = cut(directives(claims))
    sides = lambda n, own, other: d.select(F.col("claim_id").alias(n), (F.col("neg") & F.col("pos")).alias(f"both_{n}"), F.explode(F.expr(f"filter(array(if(neg, '{own}', null), if(pos, '{other}', null)), x -> x is not null)")).alias("wants"))
    a, b = sides("x", "pos", "neg"), sides("y", "neg", "pos")
    once = F.col("x") < F.col("y")
    if asked is not None:
        names = asked.select(F.col("claim_id").alias("x")).distinct()
        a = a.join(names, "x", "left_semi")
        b = b.join(names.select(F.col("x").alias("y"), F.lit(True).alias("also")), "y", "left")
        once = once | ((F.col("x") > F.col("y")) & F.col("also").isNull())
    b = b.withColumn("salt", F.pmod(F.xxhash64("y"), F.lit(salts)).cast("int"))
    twice = F.col("both_x") & F.col("both_y")  # such a pair meets under either sign, and counts as negative first
    pairs = a.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).join(b, ["wants", "salt"]).where(once & (~twice | (F.col("wants") == "pos")))
    negative_first = twice | F.when(F.col("x") < F.col("y"), F.col("wants") == "pos").otherwise(F.col("wants") == "neg")
    return pairs.select(F.least("x", "y").alias("claim_a"), F.greatest("x", "y").alias("claim_b"), F.when(negative_first, "negative vs positive directive").otherwise("positive vs negative directive").alias("reason"))


def _found(text: Column, patterns: list[str], need: list[tuple], strip: str, least: int, ignore_case: bool = False, group_of: dict[int, int] | None = None, sign: dict[int, str] | None = None) -> Column:
    """Distinct matches of all patterns in order, stripped, ``least`` characters or more; a pattern is tried where the text holds what it needs, and the short pattern of ``sign`` where it has one."""
    none = F.array().cast("array<string>")

    def parts(low: Column) -> Column:
        every = [F.regexp_extract_all(text, F.lit(R.java(p, ignore_case)), F.lit((group_of or {}).get(k, 0))) for k, p in enumerate(patterns)]
        tests = [text.rlike(sign[k]) if k in (sign or {}) else _holds(low, n) if n else None for k, n in enumerate(need)]
        return F.concat(*(found if t is None else F.when(t, found).otherwise(none) for t, found in zip(tests, every, strict=True)))

    found = F.when(text.isNotNull(), _once(_folded(text) if ignore_case else text, parts))
    trimmed = F.transform(found, lambda x: F.rtrim(F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), F.lit(strip)) if strip else x)
    return F.array_distinct(F.filter(trimmed, lambda x: F.length(x) >= least))


def file_paths(text: Column) -> Column:
    return _found(text, R.FILE_PATHS, R.FILE_PATHS_NEED, ".,;:')]}", 3, ignore_case=True)


def code_identifiers(text: Column) -> Column:
    return _found(text, R.CODE_IDENTIFIERS, R.CODE_IDENTIFIERS_NEED, "", 2, group_of={0: 1, 1: 1, 2: 1}, sign=R.CODE_IDENTIFIERS_SIGN)


def imports(text: Column) -> Column:
    return _found(text, R.IMPORTS, R.IMPORTS_NEED, "", 1, group_of={0: 1, 1: 1})


def commands(text: Column) -> Column:
    return _found(text, R.COMMANDS, R.COMMANDS_NEED, ".,;:'\"", 3, ignore_case=True)


def errors(text: Column) -> Column:
    return _found(text, R.ERRORS, R.ERRORS_NEED, ".,;:", 5, ignore_case=True)


def equations(text: Column) -> Column:
    return _found(text, R.EQUATIONS, R.EQUATIONS_NEED, ".,;:", 3)


#: Modality, extractor and confidence of what is stored as evidence.
TECHNICAL = (("file_path", file_paths, 0.9), ("command", commands, 0.9), ("error", errors, 0.9), ("equation", equations, 0.9), ("code", code_identifiers, 0.8))


def combined(moments: DataFrame) -> Column:
    return F.concat(F.coalesce(moments["transcript_text"], F.lit("")), F.lit("\n"), F.coalesce(moments["ocr_text"], F.lit("")))


def technical(moments: DataFrame) -> DataFrame:
    """``evidence_id, moment_id, modality, pos, content, confidence``, content cut at 1000."""
    text = F.col("__text")

    def rows_of(modality: str, found: Column, confidence: float) -> Column:
        return F.transform(found, lambda x, k: F.struct(F.lit(modality).alias("modality"), k.alias("pos"), F.substring(x, 1, 1000).alias("content"), F.lit(confidence).alias("confidence")))

    rows = F.concat(*(rows_of(m, f(text), c) for m, f, c in TECHNICAL))
    found = moments.select("moment_id", combined(moments).alias("__text")).select("moment_id", F.explode(rows).alias("e")).select("moment_id", "e.*")
    ident = F.concat(F.lit("tev:"), T.short_hash(F.concat_ws("|", "moment_id", "modality", F.col("pos").cast("string")), 12))
    return found.select(ident.alias("evidence_id"), "moment_id", "modality", "pos", "content", "confidence")


def _mentions(text: Column, low: Column, known: tuple[str, ...], packages: tuple[str, ...]) -> Column:
    """Array of (label, entity_type): classes in order, by place in the text or the list inside a class.

    A listed term is looked for as a plain substring of ``low`` before its pattern is tried.
    """

    def of(kind: str, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(x.alias("label"), F.lit(kind).alias("entity_type")))

    every = lambda p: F.regexp_extract_all(text, F.lit(R.java(p)), F.lit(0))
    phrases = F.filter(every(R.CAPITALIZED), lambda x: F.length(x) >= 4)
    acronyms = every(R.ACRONYMS)
    held = lambda test, found: F.when(test, found).otherwise(F.array().cast("array<string>"))
    paths = F.filter(held(F.contains(text, F.lit("/")), every(R.ENTITY_PATHS)), lambda x: (F.length(x) >= 3) & ~x.rlike(r"[.,)]$"))
    code = F.filter(F.transform(F.concat(held(F.contains(text, F.lit("(")), every(R.ENTITY_CODE[0])), *(held(text.rlike(r"\.[a-zA-Z]"), every(p)) for p in R.ENTITY_CODE[1:])), lambda x: F.rtrim(x, F.lit(")"))), lambda x: F.length(x) >= 4)
    listed = lambda terms: F.filter(F.array(*(F.when(F.contains(low, F.lit(t.lower())) & text.rlike(R.java(rf"(?<![a-zA-Z])\Q{t}\E(?![a-zA-Z])", True)), t) for t in terms)), lambda x: x.isNotNull())
    return F.concat(of("capitalized_phrase", phrases), of("acronym", acronyms), of("file_path", paths), of("code_identifier", code), of("known_term", listed(known)), of("package", listed(packages)))


def entities(df: DataFrame, key: str, text: Column, known: tuple[str, ...] = R.KNOWN_TERMS, packages: tuple[str, ...] = R.PACKAGES) -> DataFrame:
    """``key, pos, label, entity_type`` of each row's text; of labels that differ in case the first stays."""
    given = df.select(key, text.alias("__text"), F.lower(text).alias("__low"))
    found = given.select(key, _mentions(F.col("__text"), F.col("__low"), known, packages).alias("found"))
    keyed = found.select(key, "found", F.transform("found", lambda x: F.lower(x["label"])).alias("keys"))
    first = F.transform(F.array_distinct("keys"), lambda k: F.element_at(F.col("found"), F.array_position(F.col("keys"), k).cast("int")))
    return keyed.select(key, F.posexplode(first).alias("pos", "e")).select(key, "pos", "e.label", "e.entity_type")


def moment_entities(moments: DataFrame) -> DataFrame:
    """Entities of the text of moments."""
    return entities(moments, "moment_id", combined(moments))


def freshness(text: Column) -> Column:
    """1, less 0.3 for a stale phrase, plus 0.2 for a fresh one, less 0.1 for a tool word; 0 to 1."""
    low = F.lower(text)
    has = lambda words: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))
    score = F.lit(1.0) - F.when(has(R.STALE), 0.3).otherwise(0.0)
    score = score + F.when(has(R.FRESH), 0.2).otherwise(0.0)
    score = score - F.when(has(R.TOOLS), 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def freshness_scores(moments: DataFrame) -> DataFrame:
    """``item_id, freshness_score, stale_reason, band`` of moments."""
    both = F.concat(F.coalesce("transcript_text", F.lit("")), F.lit(" "), F.coalesce("ocr_text", F.lit("")))
    s = moments.select(F.col("moment_id").alias("item_id"), freshness(both).alias("freshness_score"))
    band = F.when(F.col("freshness_score") >= 0.7, "fresh").when(F.col("freshness_score") < 0.5, "stale").otherwise("neutral")
    return s.withColumn("stale_reason", F.when(F.col("freshness_score") < 0.5, "potentially stale").otherwise("")).withColumn("band", band)

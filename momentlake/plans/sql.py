"""Pieces of SQL that the checks share."""

from __future__ import annotations

from momentlake.functions import rules as R
from momentlake.functions import text as T
from momentlake.sources.corpus import MOMENTS_SQL


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def with_moments(body: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([MOMENTS_SQL, *ctes]) + "\n" + body


def normal(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s\p{{Z}}]', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({normal(x)}, ' '), lambda w: w <> '')"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'))"


def sentences(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '([.!?])[\s\p{{Z}}]+', '\1' || chr(1), 'g'), chr(1))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def matches(x: str, pattern: str, ignore_case: bool = False) -> str:
    return f"regexp_matches({x}, {q(R.re2(pattern, ignore_case))})"


def any_match(x: str, patterns: list[str], ignore_case: bool = False) -> str:
    return "(" + " OR ".join(matches(x, p, ignore_case) for p in patterns) + ")"


def has_any(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(p)})" for p in phrases) + ")"


def starts_any(x: str, phrases) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {q(p)})" for p in phrases) + ")"


def claim_normal(x: str) -> str:
    stop = ", ".join(map(q, T.STOP_WORDS))
    return f"coalesce(list_aggregate(list_filter({words(x)}, lambda w: w NOT IN ({stop}) AND length(w) > 1), 'string_agg', ' '), '')"


def tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(translate(lower({x}), {q(T.FOLD_FROM)}, {q(T.FOLD_TO)}), '[^\p{{L}}\p{{N}}\p{{Co}}]+'), lambda t: t <> '')"

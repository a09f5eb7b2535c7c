"""Text functions: Column in, Column out, all inside the JVM.

A word character is a letter, a number or an underscore in the Unicode sense; Java's plain
``\\w`` knows ASCII only, so patterns name the classes or start with ``(?U)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a normalised claim leaves out.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can need dare ought "
    "used to of in for on with at by from as into through during before after above below between out off over under again further "
    "then once here there and but or nor not so yet"
).split()


def normalize_text(text: Column) -> Column:
    """Lower case; other than word characters and white space to space; runs to one; trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def combined_text(*parts: Column) -> Column:
    """Non-blank parts, trimmed, joined by a space."""
    given = F.transform(F.array(*(F.coalesce(p, F.lit("")) for p in parts)), lambda x: F.trim(x))
    return F.array_join(F.filter(given, lambda x: x != ""), " ")


def content_hash(text: Column) -> Column:
    return F.sha2(normalize_text(text), 256)


def short_hash(text: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def preview_hash(transcript: Column, ocr: Column) -> Column:
    """Hash of the first 500 characters of each part, or ``empty``."""
    both = F.trim(F.concat(F.substring(F.coalesce(transcript, F.lit("")), 1, 500), F.substring(F.coalesce(ocr, F.lit("")), 1, 500)))
    return F.when(both == "", "empty").otherwise(F.sha2(both, 256))


def sentences(text: Column) -> Column:
    """Cut after . ! ? before white space; nothing is dropped."""
    return F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])[\s\p{Z}]+")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\p{Z}]+", " "))


def words(text: Column) -> Column:
    """Words of the normalised text in order; none for an empty one."""
    return F.filter(F.split(normalize_text(text), " "), lambda w: w != "")


def grams(normal: Column, n: int = 3) -> Column:
    """Distinct n-grams of characters; a shorter text is its own gram, an empty one has none."""
    chars = F.split(normal, "")
    size = F.length(normal)
    slid = F.slice(chars, F.lit(1), F.greatest(size - (n - 1), F.lit(0)))
    for k in range(1, n):  # zipped slices are linear; a substring for each place would be quadratic
        slid = F.zip_with(slid, F.slice(chars, F.lit(1 + k), F.greatest(size - (n - 1), F.lit(0))), lambda a, b: F.concat(a, b))
    return F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(normal)).otherwise(F.array_distinct(slid))


def gram_codes(normal: Column) -> Column:
    """`grams` of three characters, each as one number: 21 bits a character, so different grams have different numbers."""
    codes = F.transform(F.split(normal, ""), lambda c: F.ascii(c).cast("long"))
    size = F.length(normal)
    at = lambda k: F.slice(codes, F.lit(1 + k), F.greatest(size - 2, F.lit(0)))
    three = F.zip_with(F.zip_with(at(0), at(1), lambda a, b: a * (1 << 21) + b), at(2), lambda a, b: a * (1 << 21) + b)
    short = F.array(F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: a * (1 << 21) + c))
    return F.when(size == 0, F.array().cast("array<bigint>")).when(size < 3, short).otherwise(F.array_distinct(three))


def jaccard(a: Column, b: Column) -> Column:
    """Of sets given as arrays of distinct values; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def normalize_claim(text: Column) -> Column:
    kept = F.filter(words(text), lambda w: ~w.isin(STOP_WORDS) & (F.length(w) > 1))
    return F.array_join(kept, " ")


#: Latin letters and what they fold to.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīłńňōőřśšťūůűźżž"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeegilnnoorsstuuuzzz"


def fts_tokens(text: Column) -> Column:
    """Index terms in order: lower case, Latin diacritics folded, cut at all but letters and numbers."""
    low = F.lower(F.coalesce(text, F.lit("")))
    folded = F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, FOLD_FROM, FOLD_TO))  # ASCII has nothing to fold
    return F.filter(F.split(folded, r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def snippet(text: Column, terms: list[str] | Column, size: int = 240) -> Column:
    """The surroundings of the earliest term of two or more characters, else the beginning."""
    given = F.array(*(F.lit(t) for t in terms)) if isinstance(terms, list) else terms
    low = F.lower(text)
    at = F.array_min(F.filter(F.transform(F.filter(given, lambda t: F.length(t) >= 2), lambda t: F.position(t, low)), lambda p: p > 0))
    start = F.greatest(at - 1 - size // 2, F.lit(0))
    end = F.least(F.length(text), at - 1 + size // 2)
    middle = F.concat(F.when(start > 0, "... ").otherwise(""), F.substr(text, (start + 1).cast("int"), (end - start).cast("int")), F.when(end < F.length(text), " ...").otherwise(""))
    head = F.when(F.length(text) <= size, text).otherwise(F.concat(F.substring(text, 1, size), F.lit("...")))
    return F.when(F.coalesce(text, F.lit("")) == "", "").when(at.isNull(), head).otherwise(middle)


def clock(seconds: Column) -> Column:
    """H:MM:SS, or M:SS within the first hour; fractions are cut."""
    whole = F.floor(seconds).cast("long")
    h, m, s = F.floor(whole / 3600).cast("long"), F.floor(whole % 3600 / 60).cast("long"), whole % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def clock_range(start: Column, end: Column) -> Column:
    return F.concat(clock(start), F.lit("–"), clock(end))


def clock_seconds(text: Column) -> Column:
    """Seconds of h:m:s or m:s; null for other shapes."""
    p = F.split(text, ":")
    number = lambda k: F.try_element_at(p, F.lit(k)).try_cast("double")
    return F.when(F.size(p) == 3, number(1) * 3600 + number(2) * 60 + number(3)).when(F.size(p) == 2, number(1) * 60 + number(2))


def deep_link(url: Column, seconds: Column) -> Column:
    """The url with the second to start from; null without a url."""
    at = F.floor(seconds).cast("long").cast("string")
    return F.when(url != "", F.concat(url, F.when(F.contains(url, F.lit("?")), "&t=").otherwise("?t="), at, F.lit("s")))


def one_decimal(x: Column) -> Column:
    """As C's ``%.1f`` prints it: never with an exponent, the binary value rounded and its ties to the even digit, where Java's formats round the printed value and ties up. Null for null."""
    return F.call_function("format_number", x.cast("double"), F.lit("0.0"))


def human_size(size: Column) -> Column:
    big = F.when(size < 1 << 20, F.concat(one_decimal(size / 1024.0), F.lit(" KB"))).otherwise(F.concat(one_decimal(size / 1048576.0), F.lit(" MB")))
    return F.when(size < 1024, F.format_string("%d B", size)).otherwise(big)


def moment_id(video: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s:%.2f:%.2f", video, start, end)

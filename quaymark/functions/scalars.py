"""Scalar functions, Column to Column, without Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaymark.functions import tables

#: Delimiters of tokens, for entropy hits and for anomaly density.
TOKEN_DELIMITERS = r"(?U)[\s=:\"',;<>()\[\]{}]+"
COARSE_DELIMITERS = r"(?U)[\s=:\"',]+"


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per code point; 0 for an empty text."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.when(n > 0, F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))).otherwise(F.lit(0.0))


def may_reach(text: Column, bits: float) -> Column:
    """Whether a text has signs enough for so many bits per code point: d different ones have log2(d) at most."""
    return F.size(F.array_distinct(F.split(text, ""))) >= 2.0 ** (bits - 1e-6) - 1e-6


def redact(text: Column, keep: int = 6) -> Column:
    return F.when(F.length(text) <= keep, F.lit("***")).otherwise(F.concat(F.substring(text, 1, keep), F.lit("***")))


def truncate(text: Column, most: int = 80) -> Column:
    """A text longer than ``most`` with both ends kept and an ellipsis between them."""
    half = most // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, half), F.lit(" … "), F.substring(text, -half, half)))


def url_path(url: Column) -> Column:
    """The path of a URL, without query, fragment and the last segment's parameters."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/]*", "")
    return F.regexp_replace(bare, r";[^/]*$", "")


def url_filename(url: Column) -> Column:
    """The last path segment, or the whole URL if there is none."""
    name = F.regexp_extract(F.regexp_replace(url_path(url), r"/+$", ""), r"([^/]*)$", 1)
    return F.when(name == "", url).otherwise(name)


def extension(path: Column) -> Column:
    """The last suffix in lower case, with its dot; names that only begin with a dot, or end with one, have none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def human_size(n: Column) -> Column:
    """Whole units, by integer division, up to terabytes."""
    units = ("B", "KB", "MB", "GB", "TB")
    out = F.format_string("%.1f TB", F.floor(n / F.lit(1024**4)).cast("double"))
    for power in (3, 2, 1, 0):
        out = F.when(n < F.lit(1024 ** (power + 1)), F.format_string(f"%.1f {units[power]}", F.floor(n / F.lit(1024**power)).cast("double"))).otherwise(out)
    return out


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_")


def key_to_url(base: Column, key: Column) -> Column:
    return F.concat(F.regexp_replace(base, r"/+$", ""), F.lit("/"), F.regexp_replace(key, r"^/+", ""))


def file_type(url: Column) -> Column:
    """By special name, then by extension."""
    name = F.lower(F.regexp_extract(F.regexp_replace(url_path(url), r"/+$", ""), r"([^/]*)$", 1))
    special = {n: t for t, names in tables.SPECIAL_NAMES.items() for n in names}
    by_extension = {f".{e}": t for t, names in tables.EXTENSIONS.items() for e in names}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in special.items() for x in kv]), name), tables.lookup(by_extension, extension(name), tables.OTHER))


def is_text(kind: Column) -> Column:
    return ~kind.isin(*tables.NOT_TEXT)


def mixed_characters(token: Column) -> Column:
    """At least two of upper case, lower case, digit, other sign."""
    return sum(token.rlike(p).cast("int") for p in (r"\p{Lu}", r"\p{Ll}", r"\p{Nd}", r"[^\p{L}\p{N}]")) >= 2


def harmless(token: Column) -> Column:
    """A token that entropy does not speak against: a digest, number, date, URL, constant, or too repetitive."""
    return token.rlike(tables.HARMLESS_TOKENS) | (F.size(F.array_distinct(F.split(token, ""))) / F.length(token) < 0.3)


def context(lines: Column, number: Column) -> Column:
    """The line with its neighbours, 200 code points at most."""
    first = F.greatest(number - 1, F.lit(1))
    return F.substring(F.array_join(F.slice(lines, first, number + 2 - first), "\n"), 1, 200)


def fingerprint(match: Column) -> Column:
    return F.substring(F.sha2(match, 256), 1, 16)


def base_rule(rule: Column) -> Column:
    return F.substring_index(rule, ":", -1)


def label(description: Column) -> Column:
    return F.trim(F.substring_index(description, "(", 1))


def framework(ref: Column) -> Column:
    return F.substring_index(ref, " ", 1)


def sanitised(text: Column, most: int = 5000) -> Column:
    """What a semantic analyser may see: long encoded strings cut to 8 signs, key blocks without their bodies, a bounded length."""
    cut = F.regexp_replace(text, r"\b([A-Za-z0-9+/]{8})[A-Za-z0-9+/]{32,}={0,2}\b", "$1***")
    return F.substring(F.regexp_replace(cut, r"(-----BEGIN[^-]+-----)[^-]+(-----END[^-]+-----)", "$1 [REDACTED] $2"), 1, most)


def unfenced(text: Column) -> Column:
    """A reply without a Markdown code fence around it."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(bare.startswith("```"), F.regexp_replace(F.regexp_replace(bare, r"^```[a-z]*\n?", ""), r"\n?```$", "")).otherwise(bare)


def decimal_degrees(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    value = F.coalesce(degrees, F.lit(0.0)) + F.coalesce(minutes, F.lit(0.0)) / 60 + F.coalesce(seconds, F.lit(0.0)) / 3600
    return F.when(ref.isin("S", "W"), -value).otherwise(value)


def version_parts(version: Column) -> Column:
    """Numbers of a dotted version, without a leading or trailing v; [0] if any part is no number."""
    bare = F.regexp_replace(version, r"^v+|v+$", "")
    return F.when(bare.rlike(r"^[0-9]+(\.[0-9]+)*$"), F.transform(F.split(bare, r"\."), lambda x: x.cast("int"))).otherwise(F.array(F.lit(0)))


def version_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1, number by number; of two that agree so far the shorter is lower."""
    x, y = version_parts(a), version_parts(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def key_format_ok(provider: Column, key: Column) -> Column:
    """Whether a provider's key looks like one; a provider without a format takes any."""
    out = F.lit(True)
    for name, pattern in tables.KEY_FORMATS.items():
        out = F.when(provider == name, F.coalesce(key.rlike(pattern), F.lit(False))).otherwise(out)
    return out


def elapsed(start: Column, end: Column) -> Column:
    """Seconds between two timestamps, to two places."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return F.round((micros(end) - micros(start)) / 1e6, 2)


def risk_band(score: Column) -> Column:
    return F.when(score >= 7, "red").when(score >= 4, "amber").otherwise("green")


def exposure_rating(critical: Column, high: Column, medium: Column) -> Column:
    return F.when(critical > 0, "CRITICAL").when(high > 2, "HIGH").when((high > 0) | (medium > 3), "MODERATE").otherwise("LOW")


def card_checked(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)

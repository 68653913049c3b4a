"""Text functions of ingestion and matching, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space at the ends of a text (no-break spaces do not), and inside it.
EDGE = r"\x{0009}-\x{000D}\x{001C}-\x{0020}\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}"
INNER = r"[ \t\n\x0B\f\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{EDGE}]+|[{EDGE}]+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(f"[^{EDGE}]")


def or_default(c: Column, default: Column) -> Column:
    """The stripped text, or the default where that is empty."""
    return F.coalesce(F.nullif(strip(c), F.lit("")), default)


def collapsed(c: Column) -> Column:
    return strip(F.regexp_replace(c, INNER, " "))


def excerpt(c: Column, size: int = 160) -> Column:
    """The first letters of the collapsed text. They come from its beginning alone if more than white space follows them there."""
    start = F.regexp_replace(F.regexp_replace(F.substring(c, 1, 4 * size), INNER, " "), f"^[{EDGE}]+", "")
    return F.when(F.substring(start, size + 1, 4 * size).rlike(f"[^{EDGE}]"), F.substring(start, 1, size)).otherwise(F.substring(collapsed(c), 1, size))


def normalized_name(c: Column) -> Column:
    return F.lower(collapsed(c))


def normalized_key(kind: Column, name: Column) -> Column:
    return F.concat(F.lower(kind), F.lit(":"), normalized_name(name))


def file_name(c: Column, default: str = "unnamed") -> Column:
    return F.when(is_blank(c), F.lit(default)).otherwise(strip(F.substring_index(F.replace(c, F.lit("\\"), F.lit("/")), "/", -1)))


def file_extension(name: Column) -> Column:
    """Lower-case text after the last dot; empty without one or if it ends the name."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def document_kind(name: Column) -> Column:
    """markdown, txt or pdf; null for any other extension."""
    e = file_extension(name)
    return F.when(e.isin("md", "markdown"), "markdown").when(e == "txt", "txt").when(e == "pdf", "pdf")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def name_contains(name: Column, query: str | None) -> Column:
    """Literal search that folds ASCII letters only; everything matches a blank query."""
    q = (query or "").strip(" ")
    return F.contains(ascii_lower(name), ascii_lower(F.lit(q))) if q else F.lit(True)


def size_label(size: Column) -> Column:
    kb = F.format_string("%.1f KB", F.round(size / 1024.0, 1))
    return F.when(size.isNull(), "unknown").when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(kb)


def uuid3(prefix: str, *parts: Column) -> Column:
    """prefix-UUID made of the MD5 of "prefix:part|part", so the same facts always get the same id."""
    h = F.md5(F.concat(F.lit(f"{prefix}:"), F.concat_ws("|", *parts)))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit(f"{prefix}-"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-3"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))


def cosine(x: Column, y: Column) -> Column:
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))


def pair(a: Column, b: Column) -> tuple[Column, Column]:
    """Both ends in one order, so that a pair is the same in either direction."""
    return F.least(a, b), F.greatest(a, b)


def random_id() -> Column:
    """A new id for each row; never the same twice, so nothing that is compared rests on it."""
    return F.uuid()


def appended(values: Column, x: Column) -> Column:
    """The array with the value at its end, unless it has it."""
    return F.when(F.array_contains(values, x), values).otherwise(F.array_append(values, x))


def to_json_list(values: Column) -> Column:
    return F.coalesce(F.to_json(values), F.lit("[]"))


def from_json_list(c: Column) -> Column:
    """The texts of a JSON array; an empty array for null, blank or anything that is none."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def iso(c: Column) -> Column:
    """A timestamp as ISO text in UTC with milliseconds, in whatever time zone the session is."""
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def from_iso(c: Column) -> Column:
    return F.try_to_timestamp(c)

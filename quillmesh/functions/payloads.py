"""Column expressions that read values out of source payloads."""

from __future__ import annotations

import html
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STRINGS = "array<string>"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filled(c: Column | str) -> Column:
    """A string without white space at its ends; null where nothing is left."""
    x = F.trim(F.regexp_replace(col(c), r"(?U)^\s+|\s+$", ""))
    return F.when(x != "", x)


def value(v: Column, path: str, kind: str = "string") -> Column:
    """The value at ``path`` of a variant; null where it is missing, JSON null or of another kind."""
    found = F.try_variant_get(v, path, kind)
    return F.when(~F.is_variant_null(F.try_variant_get(v, path, "variant")), found)


def one_or_many(v: Column, path: str) -> Column:
    """The values at ``path`` as an array of variants, be it a list, a single value (a list of one) or missing (an empty list)."""
    single = F.try_variant_get(v, path, "variant")
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.when(single.isNotNull() & ~F.is_variant_null(single), F.array(single)), F.array().cast("array<variant>"))


def unboxed(v: Column, key: str, kind: str = "string") -> Column:
    """The value of ``key``, be it wrapped as ``{"value": ...}`` or bare."""
    bare = F.try_variant_get(v, f"$.{key}", "variant")
    boxed = F.startswith(F.schema_of_variant(bare), F.lit("OBJECT"))
    return F.when(boxed, value(v, f"$.{key}.value", kind)).otherwise(value(v, f"$.{key}", kind))


def unboxed_many(v: Column, key: str) -> Column:
    """As ``unboxed``, as an array of variants."""
    return F.when(F.try_variant_get(v, f"$.{key}.value", "variant").isNotNull(), one_or_many(v, f"$.{key}.value")).otherwise(one_or_many(v, f"$.{key}"))


def restored_text(index: Column | str) -> Column:
    """The text whose words stand in a map of word to positions, by position and word."""
    places = F.flatten(F.transform(F.map_entries(col(index)), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.when(F.size(col(index)) > 0, F.array_join(F.transform(F.array_sort(places), lambda x: x["word"]), " "))


def int_or_null(c: Column | str) -> Column:
    """A whole number, typed or written, or null."""
    x = F.trim(col(c).cast("string"))
    return F.when(x.rlike(r"^[+-]?\d{1,18}$"), x.try_cast("bigint"))


def year_or_null(c: Column | str) -> Column:
    """A whole number from 1000 to 3000, or null."""
    n = int_or_null(c)
    return F.when(n.between(1000, 3000), n).cast("int")


def iso_date(c: Column | str) -> Column:
    """The date in the first ten characters, or null."""
    x = F.substring(col(c), 1, 10)
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(x, "yyyy-MM-dd"))


def partial_date(c: Column | str) -> Column:
    """A date of which month and day may be missing or wrong: then it is 1 January, or the first of the month."""
    x = col(c)
    y, m, d = F.regexp_extract(x, r"^(\d{4})", 1), F.regexp_extract(x, r"^\d{4}.(\d{2})", 1), F.regexp_extract(x, r"^\d{4}.{4}(\d{2})", 1)
    y = F.when(y != "", y)
    whole = F.concat_ws("-", y, F.when(m != "", m).otherwise("01"), F.when(d != "", d).otherwise("01"))
    return F.when(y.isNotNull(), F.coalesce(F.try_to_date(whole, "yyyy-MM-dd"), F.try_to_date(F.concat(y, F.lit("-01-01")), "yyyy-MM-dd")))


def date_from_parts(*candidates: Column) -> Column:
    """The first candidate (an array of year, month, day, of which the last two may be missing) that is a date."""
    two = lambda a, k: F.lpad(F.coalesce(F.get(a, F.lit(k)).cast("string"), F.lit("1")), 2, "0")
    made = [F.try_to_date(F.concat_ws("-", F.lpad(F.get(a, F.lit(0)).cast("string"), 4, "0"), two(a, 1), two(a, 2)), "yyyy-MM-dd") for a in candidates]
    return F.coalesce(*[F.when(F.get(a, F.lit(0)).isNotNull(), x) for a, x in zip(candidates, made, strict=True)])


def millis_date(c: Column | str) -> Column:
    """The UTC date of milliseconds since 1970, or null."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(int_or_null(c) / 86_400_000).cast("int"))


def leading_year(c: Column | str) -> Column:
    found = F.regexp_extract(col(c), r"^([12]\d{3})", 1)
    return F.when(found != "", found.cast("int"))


def last_year(c: Column | str) -> Column:
    """The last of the years that stand in a text."""
    return F.try_element_at(F.regexp_extract_all(col(c), F.lit(r"\b([12]\d{3})\b"), F.lit(1)), F.lit(-1)).cast("int")


def yes_no(c: Column | str) -> Column:
    """True, false, or null for anything that says neither."""
    x = F.lower(F.trim(col(c)))
    return F.when(x.isin("y", "yes", "true", "1"), True).when(x.isin("n", "no", "false", "0"), False)


def _unescape(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(lambda x: html.unescape(x), na_action="ignore")


_unescape.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}


def unescaped(c: Column | str) -> Column:
    """Character references replaced. Only texts with an ampersand leave the JVM."""
    x = col(c)
    has = F.contains(x, F.lit("&"))
    return F.coalesce(F.pandas_udf(_unescape, "string")(F.when(has, x)), x)


def without_markup(c: Column | str) -> Column:
    """Tags as spaces, character references replaced, white space collapsed; null where nothing is left."""
    return filled(F.regexp_replace(unescaped(F.regexp_replace(col(c), r"<[^>]+>", " ")), r"(?U)\s+", " "))


def listed_names(c: Column | str) -> Column:
    """Names of a list separated by semicolons, without remarks in brackets at their ends."""
    names = F.transform(F.split(col(c), ";"), lambda n: F.trim(F.regexp_replace(F.trim(n), r"\s+\[.*\]$", "")))
    return F.filter(names, lambda n: n != "")


def content_id(size: int, *parts: Column | str) -> Column:
    """The head of the hash of the parts, joined by NUL: a lasting id for rows without one."""
    return F.substring(F.sha2(F.concat_ws("\0", *[F.coalesce(col(p), F.lit("")) for p in parts]), 256), 1, size)


def first(items: Column, want: Callable[[Column], Column], take: Callable[[Column], Column]) -> Column:
    """``take`` of the first of ``items`` that fits ``want``, or null."""
    return take(F.get(F.filter(items, want), F.lit(0)))


def last_segment(c: Column | str) -> Column:
    """What stands after the last slash, without slashes at the end."""
    return F.substring_index(F.rtrim(col(c), F.lit("/")), "/", -1)

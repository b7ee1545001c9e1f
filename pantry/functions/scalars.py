"""Scalar functions as Column expressions. All run in generated code; none is a Python UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a rendered page, and the characters that a query language reserves.
HTML = r"(?i)<(!doctype\s+html|html[\s>])"
RESERVED = r'([+\-=&|><!(){}\[\]^"~*?:\\/])'

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def trim(x: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def absent_if_empty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def is_barcode(x: Column) -> Column:
    return x.rlike(r"\A[0-9]{8,14}\z")


def number(x: Column) -> Column:
    """A number from text or number: blanks around it are ignored; anything but a plain finite number is absent."""
    t = trim(x.cast("string"))
    value = F.when(t.rlike(NUMBER), t.try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def normal_key(x: Column) -> Column:
    return F.replace(x, F.lit("-"), F.lit("_"))


def base_key(x: Column, suffix: str) -> Column:
    return F.substring(x, F.lit(1), F.length(x) - len(suffix))


def is_html(x: Column) -> Column:
    return x.rlike(HTML)


def percent(x: Column) -> Column:
    """Hundredths, halves rounded up."""
    return F.floor(x * 100 + 0.5)


def completeness_level(x: Column) -> Column:
    return F.when(x >= 0.8, "high").when(x >= 0.5, "moderate").when(x.isNotNull(), "low")


def escape_query(x: Column) -> Column:
    """Reserved characters of a query language with a backslash before each, so that text stays literal."""
    return F.regexp_replace(x, RESERVED, r"\\$1")


def joined(x: Column) -> Column:
    """A list of strings as one."""
    return F.array_join(x, ", ")


def joined_variant(x: Column) -> Column:
    """The same of a value that is a string or a list."""
    as_list = F.try_variant_get(x, "$", "array<string>")
    return F.when(F.schema_of_variant(x).startswith("ARRAY"), F.array_join(as_list, ", ")).otherwise(F.try_variant_get(x, "$", "string"))


def sentence(x: Column) -> Column:
    return F.when(x.rlike("[.!?]$"), x).otherwise(F.concat(x, F.lit(".")))


def tokens(*columns: Column) -> Column:
    """Lower-case runs of letters and digits of all columns together."""
    return F.filter(F.split(F.lower(F.concat_ws(" ", *columns)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def url_component(x: Column) -> Column:
    """Percent-encoded but for letters, digits and - _ . ! ~ * ' ( )."""
    out = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    for code, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))

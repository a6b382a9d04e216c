"""Vectors as array columns: text form and cosine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(x: Column) -> Column:
    """A float without exponent and, when whole, without decimal point."""
    plain = x.cast("string")
    part = lambda i: F.regexp_extract(plain, r"^-?(\d)\.(\d*?)0*E(-?\d+)$", i)
    sign = F.when(F.startswith(plain, F.lit("-")), "-").otherwise("")
    digits, power = F.concat(part(1), part(2)), F.coalesce(part(3).try_cast("int"), F.lit(0))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    whole = F.concat(sign, F.rpad(digits, power + 1, F.lit("0")))
    large = F.when(F.length(digits) <= power + 1, whole).otherwise(
        F.concat(sign, F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2))
    )
    return F.when(plain.contains("E"), F.when(power < 0, small).otherwise(large)).otherwise(F.regexp_replace(plain, r"\.0?$", ""))


def format_vector(v: Column) -> Column:
    """[0.1,2,…]"""
    return F.concat(F.lit("["), F.array_join(F.transform(v, _number), ","), F.lit("]"))


def parse_vector(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when a vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))

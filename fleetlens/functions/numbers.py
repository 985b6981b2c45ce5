"""Rounding and number text as browsers do it."""

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T


def round_half_up(x: Column) -> Column:
    """Nearest whole number, ties towards plus infinity (``-0.5`` gives 0)."""
    return (F.floor(x) + F.when(x - F.floor(x) >= 0.5, 1).otherwise(0)).cast("long")


def plain_text(c: Column, kind: T.DataType) -> Column:
    """A value as export text: doubles as plain decimals from 1e-6 up to 1e21, as ``1e+21`` beyond; else a plain cast.

    The digits are those of the JVM, whose releases before 19 write a few large doubles with more digits than they need.
    """
    text = c.cast("string")
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        return text
    size = F.abs(c)
    # a double has at most 17 digits: from 1 on at most 16 of them are decimals, below 1 at most 23 places are used
    decimals = F.when(size >= 1, text.try_cast("decimal(38,17)").cast("string")).otherwise(text.try_cast("decimal(38,24)").cast("string"))
    plain = F.regexp_replace(decimals, r"\.?0+\z", "")
    power = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), "E-", "e-"), "E", "e+")
    return F.when(c == 0, "0").when((size >= 1e-6) & (size < 1e21), plain).otherwise(power)

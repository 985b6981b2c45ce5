"""Memory and byte counts with a fitting unit."""

from pyspark.sql import Column, functions as F

from fleetlens import fixed
from fleetlens.functions.numbers import round_half_up


def _whole(v: Column, unit: str) -> Column:
    return F.concat(round_half_up(v).cast("string"), F.lit(" " + unit))


def _tenths(v: Column, unit: str) -> Column:
    return F.format_string("%.1f " + unit, v)


def _scaled(v: Column, units: list[str], whole_units: int) -> Column:
    """One branch per unit; powers of 1024 divide doubles exactly, so no loop is needed."""
    text = None
    for power, unit in enumerate(units):
        amount = v / float(1024**power)
        shown = _whole(amount, unit) if power < whole_units else _tenths(amount, unit)
        if power == len(units) - 1:
            return text.otherwise(shown)
        below = v < 1024 ** (power + 1)
        text = F.when(below, shown) if text is None else text.when(below, shown)


def format_mem(mb: Column, humanize: bool = True) -> Column:
    """Megabytes; negative, missing and infinite amounts are not available."""
    v = mb.cast("double")
    shown = _scaled(v, fixed.MEMORY_UNITS, 1) if humanize else _whole(v, fixed.MEMORY_UNITS[0])
    unusable = v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf"))
    return F.when(unusable, fixed.NOT_AVAILABLE).otherwise(shown)


def format_bytes(count: Column) -> Column:
    """Bytes; whole numbers up to kilobytes, one decimal beyond."""
    v = count.cast("double")
    nothing = v.isNull() | F.isnan(v) | (v <= 0)
    return F.when(nothing, "0 " + fixed.BYTE_UNITS[0]).otherwise(_scaled(v, fixed.BYTE_UNITS, 2))


def entry_size(kind: Column, length: Column) -> Column:
    """The size shown beside a directory entry: directories have none."""
    return F.when(kind == "DIRECTORY", fixed.DASH).otherwise(format_bytes(length))

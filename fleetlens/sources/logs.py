"""Task logs as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetlens import fixed


def log_lines(logs: DataFrame, key: str = "taskInstanceId", text: str = "log") -> DataFrame:
    """Every line of every log, numbered from 0."""
    return logs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def log_slice(
    logs: DataFrame,
    skip: int = 0,
    limit: int = fixed.LOG_LINES_PER_READ,
    key: str = "taskInstanceId",
    text: str = "log",
) -> DataFrame:
    """Lines ``skip`` up to but without ``skip + limit``; only these become rows."""
    wanted = F.slice(F.split(text, "\n"), skip + 1, limit)
    rows = logs.select(key, F.posexplode(wanted).alias("_at", "line"))
    return rows.select(key, (F.col("_at") + skip).alias("line_no"), "line")


def next_skip(skip: int, got_text: bool) -> int:
    """Where the next read starts: further on only if this one brought text."""
    return skip + fixed.LOG_LINES_PER_READ if got_text else skip

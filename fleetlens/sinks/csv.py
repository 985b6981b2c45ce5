"""CSV export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens import fixed
from fleetlens.functions import plain_text

BOM = "\ufeff"
NEEDS_QUOTES = "[\",\n\r]"


def csv_field(text: Column) -> Column:
    """One field: missing is empty, quotes only where a reader would need them."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.isNull(), "").when(F.rlike(text, F.lit(NEEDS_QUOTES)), quoted).otherwise(text)


def csv_line(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A row as one line of CSV."""
    fields = [csv_field(plain_text(F.col(f"`{c}`"), df.schema[c].dataType)) for c in columns or df.columns]
    return F.concat_ws(",", *fields)


def header_line(columns: list[str]) -> str:
    def quoted(name: str) -> str:
        return '"' + name.replace('"', '""') + '"' if any(x in name for x in '",\n\r') else name

    return ",".join(quoted(c) for c in columns)


def _check_columns(df: DataFrame | None) -> None:
    if df is None or not df.columns:
        raise ValueError("nothing to export: the result has no columns")
    if len(set(df.columns)) != len(df.columns):
        raise ValueError("nothing exported: column names repeat")


def export_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts, each with a header, written by as many tasks as the data has."""
    _check_columns(df)
    texts = df.select(*[plain_text(F.col(f"`{c}`"), df.schema[c].dataType).alias(c) for c in df.columns])
    texts.write.csv(
        path,
        header=True,
        escape='"',
        nullValue="",
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def export_result(df: DataFrame | None, path: str, most: int = fixed.MAX_ROW_LIMIT) -> None:
    """A capped query result as a single file with a byte-order mark, for spreadsheets.

    Only for results no longer than the row cap: a single file is written by a single task.
    """
    _check_columns(df)
    lines = df.select(csv_line(df).alias("value")).limit(most + 1)
    rows = lines.collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: use export_csv")
    texts = [(BOM + header_line(df.columns),), *[(r["value"],) for r in rows]]
    df.sparkSession.createDataFrame(texts, "value string").coalesce(1).write.text(path)

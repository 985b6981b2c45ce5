"""Cutting scripts into statements."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fleetlens import fixed

# One piece: anything up to a semicolon that is outside quotes and comments. All repetitions
# are possessive, so a script is read once, whatever its length.
_TEXT = r"[^;'\"/-]++"
_SINGLE = r"'[^']*+(?:''[^']*+)*+(?:'|\z)"
_DOUBLE = r"\"[^\"]*+(?:\"|\z)"
_LINE = r"--[^\n]*+"
_BLOCK = r"/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)"
PIECE = rf"(?:{_TEXT}|{_SINGLE}|{_DOUBLE}|{_LINE}|{_BLOCK}|[/-])++;?|;"


def split_statements(script: Column) -> Column:
    """The statements of a script, each with its semicolon; blank pieces and pieces that start
    with a comment are left out."""
    pieces = F.regexp_extract_all(script, F.lit(PIECE), F.lit(0))
    trimmed = F.transform(pieces, lambda p: F.btrim(p, F.lit(fixed.TYPED_BLANKS)))
    return F.filter(trimmed, lambda p: (p != "") & ~F.startswith(p, F.lit("--")) & ~F.startswith(p, F.lit("/*")))

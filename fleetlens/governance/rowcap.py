"""Row caps written at the end of a statement."""

from __future__ import annotations

import re
from dataclasses import dataclass

_FLAGS = re.IGNORECASE
_LIMIT = re.compile(r"\bLIMIT\s+(\d+)(?:\s+OFFSET\s+(\d+))?\s*\Z", _FLAGS)
_LIMIT_PAIR = re.compile(r"\bLIMIT\s+(\d+)\s*,\s*(\d+)\s*\Z", _FLAGS)
_FETCH = re.compile(
    r"(?:\bOFFSET\s+(\d+)\s+ROWS?\s+)?\bFETCH\s+(?:FIRST|NEXT)\s+(\d+)\s+ROWS?\s+ONLY\s*\Z", _FLAGS
)
_ASIDE = re.compile(r"'(?:[^'\\]|\\.|'')*+'?|\"(?:[^\"\\]|\\.)*+\"?|`[^`]*+`?|--[^\n]*|/\*.*?(?:\*/|\Z)", re.DOTALL)
_ROWNUM = re.compile(r"\b(WHERE|AND)\s+ROWNUM\s*(<=|<)\s*(\d+)\s*\Z", _FLAGS)


@dataclass(frozen=True)
class CappedSql:
    """A statement in Spark's spelling and the cap at its end, if it has one."""

    text: str
    cap: int | None


def _spelled(head: str, count: int, skip: int) -> CappedSql:
    offset = f" OFFSET {skip}" if skip else ""
    head = head.rstrip()
    # a comment that runs to the end of its line must not swallow the cap
    between = "\n" if "--" in head.rsplit("\n", 1)[-1] else " "
    return CappedSql(f"{head}{between}LIMIT {count}{offset}", count)


def normalise_limit(sql: str) -> CappedSql:
    """Rewrites ``LIMIT a, b``, ``FETCH FIRST`` and ``ROWNUM`` where they end the statement.

    A cap inside a subquery, a text or a comment is not the statement's own and stays untouched.
    """
    bare = _ASIDE.sub(lambda found: " " * len(found[0]), sql)
    if found := _LIMIT_PAIR.search(bare):
        return _spelled(sql[: found.start()], int(found[2]), int(found[1]))
    if found := _FETCH.search(bare):
        return _spelled(sql[: found.start()], int(found[2]), int(found[1] or 0))
    if found := _LIMIT.search(bare):
        return CappedSql(sql, int(found[1]))
    found = _ROWNUM.search(bare)
    # "a OR b AND ROWNUM <= n" caps only one arm, so it is not a cap of the statement
    if found and not re.search(r"\bOR\b", bare, _FLAGS):
        return _spelled(sql[: found.start()], int(found[3]) - (found[2] == "<"), 0)
    return CappedSql(sql, None)

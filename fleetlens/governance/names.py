"""What a statement means to Spark: its kind, the names it writes, and the relations it resolves to.

Decisions about tables rest on Spark's own reading of a statement, not on a search of its text. Statements are parsed and
resolved here, never run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession

#: Leaves of a resolved plan that read nothing stored.
_UNSTORED = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef", "CommandResult"}

_INSERT = re.compile(
    r"\s*INSERT\s+INTO\s+(?:TABLE\s+)?(?P<target>[`\w$.]+)\s*(?:\((?P<columns>[^()]*)\))?\s*(?P<query>(?:\(|\b(?:SELECT|WITH|VALUES|TABLE|FROM)\b).*)",
    re.IGNORECASE | re.DOTALL,
)


@dataclass(frozen=True)
class Insert:
    """An INSERT taken apart: the target's name parts, the columns it names, and the query whose rows go in."""

    target: tuple[str, ...]
    columns: tuple[str, ...]
    query: str


def _seq(items: JavaObject) -> list:
    return [items.apply(i) for i in range(items.size())]


def kind(plan: JavaObject) -> str:
    return plan.getClass().getSimpleName().rstrip("$")


def parse(session: SparkSession, sql: str) -> JavaObject:
    """The plan as written, nothing looked up."""
    return session._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def resolve(session: SparkSession, plan: JavaObject) -> JavaObject:
    """The plan with all names looked up; commands in it are not run."""
    skip = getattr(session._jvm.org.apache.spark.sql.execution, "CommandExecutionMode").SKIP()
    state = session._jsparkSession.sessionState()
    run = state.executePlan(plan, skip)
    run.assertAnalyzed()
    return run.analyzed()


def _nodes(plan: JavaObject) -> Iterator[JavaObject]:
    """A plan's nodes with those of its subqueries and named parts; what lies under a view is the view's own matter."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        if kind(node) != "View":
            todo += _seq(node.children())
            todo += _seq(node.subqueries())
            todo += [x for x in _seq(node.innerChildren()) if hasattr(x, "subqueries") and x.getClass().getName().startswith("org.apache.spark.sql.catalyst.plans")]


def written_names(plan: JavaObject) -> list[tuple[str, ...]]:
    """The relations a parsed statement names, as their parts."""
    return [tuple(_seq(n.multipartIdentifier())) for n in _nodes(plan) if kind(n) in ("UnresolvedRelation", "UnresolvedTableOrView", "UnresolvedTable")]


def dynamic_names(plan: JavaObject) -> bool:
    """Whether a name is worked out by an expression."""
    return any(kind(n) == "PlanWithUnresolvedIdentifier" for n in _nodes(plan))


def relations(plan: JavaObject) -> tuple[set[str], list[str]]:
    """Session views a resolved plan reads, in lower case, and what else it reads from storage."""
    views, stored = set(), []
    for node in _nodes(plan):
        what = kind(node)
        if what == "View":
            name = node.desc().identifier()
            if node.isTempView() and not name.database().isDefined():
                views.add(name.table().lower())
            else:
                stored.append(name.unquotedString())
        elif not _seq(node.children()) and what not in _UNSTORED:
            stored.append(what)
    return views, stored


def insert_of(session: SparkSession, sql: str) -> Insert | None:
    """The parts of a plain INSERT; None for anything else, an overwrite or a partition clause included.

    The text is cut by its head, and the cut counts only if Spark reads the whole and the parts alike.
    """
    found = _INSERT.fullmatch(sql)
    if not found:
        return None
    whole = parse(session, sql)
    if kind(whole) != "InsertIntoStatement" or whole.overwrite() or whole.byName() or whole.partitionSpec().size():
        return None
    # rows that are written out get new column numbers each time they are read
    alone, inside = (re.sub(r"#\d+L?", "", p.toString()) for p in (parse(session, found["query"]), whole.query()))
    if alone != inside:
        return None
    return Insert(tuple(_seq(whole.table().multipartIdentifier())), tuple(_seq(whole.userSpecifiedCols())), found["query"])

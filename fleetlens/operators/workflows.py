"""Workflow and task instances, and the applications their logs name."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens import fixed
from fleetlens.functions import (
    allowed_action,
    app_id,
    app_link,
    first_lines,
    is_running,
    workflow_state_label,
    workflow_state_tag,
)


TASK_PARENT = "processInstanceId"


def in_range(df: DataFrame, as_of: datetime, key: str = fixed.DEFAULT_RANGE, column: str = "startTime") -> DataFrame:
    """Rows of the last 1, 3 or 7 days up to ``as_of``, both ends included; other keys keep all.

    Both ends are literals of the column's own type, so the scan can skip by them.
    """
    hours = fixed.RANGE_HOURS.get(key)
    if hours is None:
        return df
    kind = df.schema[column].dataType
    low, high = (F.lit(str(t)).cast(kind) for t in (as_of - timedelta(hours=hours), as_of))
    return df.filter(F.col(column).between(low, high))


def filter_instances(df: DataFrame, state: str | None = None, name: str | None = None) -> DataFrame:
    """Instances in a state whose name contains a text; what is left out restricts nothing."""
    if state:
        df = df.filter(F.col("state") == state)
    if name:
        df = df.filter(F.contains("name", F.lit(name)))
    return df


def choose_view(task_search: str) -> str:
    """Searching for a task switches from workflows to tasks."""
    return "task" if task_search.strip(fixed.TYPED_BLANKS) else "process"


def with_state(df: DataFrame) -> DataFrame:
    """Label, tag and permitted action of every instance."""
    state = F.col("state")
    return df.withColumns(
        {
            "label": workflow_state_label(state),
            "tag": workflow_state_tag(state),
            "running": is_running(state),
            "action": allowed_action(state),
        }
    )


def _prefixed(df: DataFrame, prefix: str, but: str) -> DataFrame:
    return df.select(*[F.col(c) if c == but else F.col(c).alias(prefix + c) for c in df.columns])


def _as_parents(workflows: DataFrame) -> DataFrame:
    return _prefixed(workflows, "workflow_", "").withColumnRenamed("workflow_id", TASK_PARENT)


def without_tasks(workflows: DataFrame, tasks: DataFrame) -> DataFrame:
    """Workflows that have no tasks; of the tasks only their distinct parents are shuffled."""
    return _as_parents(workflows).join(tasks.select(TASK_PARENT).distinct(), TASK_PARENT, "left_anti")


def expand_tasks(workflows: DataFrame, tasks: DataFrame, how: str = "left") -> DataFrame:
    """One row per workflow and task; ``how="left"`` keeps workflows without tasks.

    A left join would keep all tasks of one workflow in one task, since the preserved side
    is the other one. So matches and workflows without tasks are found apart: the inner join
    can be split on a busy workflow, and the anti join needs only the distinct ids.
    """
    matched = tasks.join(_as_parents(workflows), TASK_PARENT)
    if how == "inner":
        return matched
    return matched.unionByName(without_tasks(workflows, tasks), allowMissingColumns=True)


def mine_app_ids(logs: DataFrame, lines: int | None = None) -> DataFrame:
    """The first application id in each log, null when there is none.

    Only an id per log leaves the scan, never the text. Whole logs are looked at unless the
    caller asks for their first ``lines`` only.
    """
    text = F.col("log") if lines is None else first_lines(F.col("log"), lines)
    return logs.select("taskInstanceId", app_id(text).alias("appId"))


def with_app_ids(tasks: DataFrame, logs: DataFrame, lines: int | None = None) -> DataFrame:
    """Tasks with the application id their log names."""
    mined = mine_app_ids(logs, lines)
    return tasks.join(mined, tasks["id"] == mined["taskInstanceId"], "left").drop("taskInstanceId")


def link_apps(
    tasks: DataFrame, logs: DataFrame, apps: DataFrame, rm: str, lines: int | None = None
) -> DataFrame:
    """Tasks with the application their log names, and a link to it."""
    return with_apps(with_app_ids(tasks, logs, lines), apps, rm)


def with_apps(rows: DataFrame, apps: DataFrame, rm: str, key: str = "id") -> DataFrame:
    """Rows holding an ``appId`` beside that application's columns, all rows kept.

    Most logs name no application. As null join keys those rows would all meet in one task,
    so they are spread by their own key under a name no application is found by.
    """
    spread = F.coalesce(F.col("appId"), F.concat(F.lit("#"), F.col(key).cast("string")))
    left = rows.withColumn("_key", spread)
    right = _prefixed(apps, "app_", "")
    joined = left.join(right, (left["_key"] == right["app_id"]) & left["appId"].isNotNull(), "left")
    return joined.drop("_key", "app_id").withColumn("appUrl", app_link(rm, F.col("appId")))


def running_only(df: DataFrame, column: Column | None = None) -> DataFrame:
    return df.filter(is_running(F.col("state") if column is None else column))

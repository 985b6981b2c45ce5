"""From workflows to their tasks to the applications these started."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from fleetlens import fixed
from fleetlens.operators.workflows import (
    expand_tasks,
    filter_instances,
    in_range,
    link_apps,
    without_tasks,
)


def workflow_drilldown(
    workflows: DataFrame,
    tasks: DataFrame,
    logs: DataFrame,
    apps: DataFrame,
    rm: str,
    as_of: datetime,
    key: str = fixed.DEFAULT_RANGE,
    state: str | None = None,
    name: str | None = None,
) -> DataFrame:
    """Recent workflows with their tasks and the application each task's log names.

    Filters come first and reach the workflow scan; logs shrink to one id each where they
    are read; neither texts nor whole applications are grouped anywhere. Workflows without
    tasks join nothing and are added at the end.
    """
    recent = filter_instances(in_range(workflows, as_of, key), state, name)
    linked = link_apps(expand_tasks(recent, tasks, "inner"), logs, apps, rm)
    return linked.unionByName(without_tasks(recent, tasks), allowMissingColumns=True)

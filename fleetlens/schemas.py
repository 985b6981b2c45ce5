"""Record schemas of the landed snapshots, as Spark type strings."""

from __future__ import annotations

from collections.abc import Sequence


def _struct(fields: str) -> str:
    """Fields as written in SQL, ``name type, ...``, as a struct type."""
    pairs = (field.split(None, 1) for field in fields.split(","))
    return "struct<" + ", ".join(f"{name}: {kind.strip()}" for name, kind in pairs) + ">"


def narrowed(struct: str, fields: Sequence[str] | None) -> str:
    """The struct type with the named fields only, in the given order; all of them for None."""
    if fields is None:
        return struct
    parts = (part.split(": ", 1) for part in struct.removeprefix("struct<").removesuffix(">").split(", "))
    kinds = {name.strip("`"): f"{name}: {kind}" for name, kind in parts}
    if unknown := [name for name in fields if name not in kinds]:
        raise ValueError(f"fields {unknown} are not in the record")
    return f"struct<{', '.join(kinds[name] for name in fields)}>"


def _bigints(names: list[str]) -> str:
    return ", ".join(f"{name} bigint" for name in names)


APPLICATION = _struct(
    """id string, name string, state string, finalStatus string, `user` string, queue string,
    applicationType string, applicationTags string, startedTime bigint, finishedTime bigint,
    elapsedTime bigint, amHostHttpAddress string, amRPCAddress string, allocatedVCores bigint,
    allocatedMB bigint, runningContainers bigint, queueUsagePercentage double, memorySeconds bigint,
    vcoreSeconds bigint, clusterUsagePercentage double, preemptedResourceMB bigint,
    preemptedResourceVCores bigint, numNonAMContainerPreempted bigint, numAMContainerPreempted bigint,
    logAggregationStatus string, progress double, diagnostics string, clusterId string, priority bigint,
    unmanagedApplication boolean, appNodeLabelExpression string, amNodeLabelExpression string,
    trackingUrl string, trackingUI string, amContainerLogs string"""
)


def application_envelope(fields: Sequence[str] | None = None) -> str:
    return f"apps struct<app: array<{narrowed(APPLICATION, fields)}>>"



METRIC_NAMES = [
    "appsSubmitted", "appsCompleted", "appsPending", "appsRunning", "appsFailed", "appsKilled",
    "reservedMB", "availableMB", "allocatedMB", "totalMB",
    "reservedVirtualCores", "availableVirtualCores", "allocatedVirtualCores", "totalVirtualCores",
    "containersAllocated", "containersPending", "containersReserved",
    "totalNodes", "activeNodes", "lostNodes", "unhealthyNodes", "decommissioningNodes",
    "decommissionedNodes", "rebootedNodes", "shuffledNodes", "totalNodeLabels",
]


def metrics_envelope(fields: Sequence[str] | None = None) -> str:
    return f"clusterMetrics {narrowed(_struct(_bigints(METRIC_NAMES)), fields)}"



FILE_STATUS = _struct(
    """pathSuffix string, type string, length bigint, permission string, owner string, `group` string,
    modificationTime bigint, accessTime bigint, blockSize bigint, replication int, childrenNum int,
    fileId bigint, storagePolicy int"""
)


def listing_envelope(fields: Sequence[str] | None = None) -> str:
    return f"dir string, FileStatuses struct<FileStatus: array<{narrowed(FILE_STATUS, fields)}>>"



STORAGE_NUMBERS = [
    "CapacityTotal", "CapacityUsed", "CapacityRemaining", "CapacityUsedNonDFS",
    "BlocksTotal", "TotalLoad", "NumLiveDataNodes", "NumDeadDataNodes",
]
STORAGE_BEAN = _struct(f"name string, {_bigints(STORAGE_NUMBERS)}, LiveNodes string")
STORAGE_ENVELOPE = f"beans array<{STORAGE_BEAN}>"

NODE_NUMBERS = ["capacity", "usedSpace", "remaining", "nonDfsUsedSpace", "numBlocks", "lastContact"]
DATA_NODE = _struct(f"{_bigints(NODE_NUMBERS)}, adminState string")
LIVE_NODES = f"map<string, {DATA_NODE}>"

PROJECT = _struct("id bigint, name string, description string, createTime string, updateTime string")
WORKFLOW = _struct(
    """id bigint, name string, state string, startTime string, endTime string, duration bigint,
    executorName string, host string, processDefinition struct<name: string>"""
)
TASK = _struct(
    """id bigint, name string, taskType string, state string, host string, workerGroup string,
    startTime string, endTime string, duration bigint, appLink string, executorName string,
    processInstanceName string, processInstanceId bigint, logPath string, retryTimes int,
    maxRetryTimes int, taskInstancePriority string"""
)


def page_envelope(row: str) -> str:
    """One page of a paged answer holding ``row`` records."""
    data = f"struct<totalList: array<{row}>, total: bigint, currentPage: int, totalPage: int>"
    return f"code int, msg string, data {data}"

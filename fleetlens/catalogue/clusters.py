"""Queries over queues, cluster metrics and storage, with their plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens import functions as L
from fleetlens.catalogue.applications import tenths
from fleetlens.catalogue.views import Views, sql
from fleetlens.operators.listing import listing_keys, sort_listing
from fleetlens.operators.paging import page, with_position
from fleetlens.operators.queues import queue_usage as use_of_queues
from fleetlens.operators.storage import cluster_usage, fullest_first, node_usage
from fleetlens.plans.overview import queue_overview
from fleetlens.sources.scheduler import leaf_names, normalise_queue, unroll_queues
from fleetlens.sources.snapshots import listing_from_text, metrics_from_text, storage_from_text


def queue_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Running applications against the quota of every queue of a capacity scheduler."""
    views = Views(spark, folder)
    queues = views.queues.select(
        "*",
        F.lit("capacity").alias("scheduler"),
        F.lit(0).cast("bigint").alias("quotaMemory"),
        F.lit(0).cast("bigint").alias("quotaVCores"),
        F.lit(None).cast("bigint").alias("fairMemory"),
        F.lit(None).cast("bigint").alias("fairVCores"),
    )
    return queue_overview(views.apps, queues, views.cluster_metrics).select(
        "queueName", "parent", "runningApps", "memory", "vCores", "memQuota", "vcoreQuota", "memPct", "vcorePct", "memSeverity"
    )


def _unrolled(spark: SparkSession, folder: str) -> DataFrame:
    return normalise_queue(unroll_queues(Views(spark, folder).scheduler_documents, keep=["snapshot"]))


def queue_tree(spark: SparkSession, folder: str) -> DataFrame:
    return _unrolled(spark, folder).select("snapshot", "scheduler", "queueName", "parent", "depth", "path")


def queue_fields(spark: SparkSession, folder: str) -> DataFrame:
    return _unrolled(spark, folder).select(
        "snapshot", "path", "absoluteCapacity", "memory", "vCores", "quotaMemory", "fairMemory", "numActiveApps", "numPendingApps"
    )


def queue_quota(spark: SparkSession, folder: str) -> DataFrame:
    views = Views(spark, folder)
    usage = use_of_queues(_unrolled(spark, folder), views.cluster_metrics)
    return usage.select("snapshot", "path", "memQuota", "vcoreQuota", "memPct", "vcorePct")


def queue_history(spark: SparkSession, folder: str) -> DataFrame:
    """Queues of every snapshot against the totals of the same snapshot."""
    metrics = metrics_from_text(Views(spark, folder).metric_documents, keep=["snapshot"])
    usage = use_of_queues(_unrolled(spark, folder), metrics, ["snapshot"])
    return usage.select("snapshot", "path", "memQuota", "vcoreQuota", "memPct", "vcorePct", "memSeverity")


def leaf_queue_names(spark: SparkSession, folder: str) -> DataFrame:
    return leaf_names(Views(spark, folder).scheduler_documents, keep=["snapshot"])


def cluster_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return metrics_from_text(Views(spark, folder).metric_documents, keep=["snapshot"]).select(
        "snapshot",
        "totalMB",
        "allocatedMB",
        "totalVirtualCores",
        "appsRunning",
        L.utilisation(F.col("allocatedMB"), F.col("totalMB")).alias("memPct"),
    )


def datanode_usage(spark: SparkSession, folder: str) -> DataFrame:
    _, nodes = storage_from_text(Views(spark, folder).storage_documents)
    return node_usage(nodes).select(
        "host", "capacity", "usedSpace", "remaining", "numBlocks", "usedPct", "severity", "usedText", "capacityText", "state"
    )


def storage_overview(spark: SparkSession, folder: str) -> DataFrame:
    cluster, _ = storage_from_text(Views(spark, folder).storage_documents, keep=["snapshot"])
    return cluster_usage(cluster).select(
        "snapshot", "CapacityUsed", "BlocksTotal", "usedPct", "remainingPct", "nonDfsPct", "usedText", "totalText"
    )


def top_nodes(spark: SparkSession, folder: str) -> DataFrame:
    nodes = Views(spark, folder).data_nodes.filter("capacity > 0")
    return page(nodes, fullest_first(), 0, 20, "place").select("place", "host", "usedSpace")


def node_utilisation(spark: SparkSession, folder: str) -> DataFrame:
    return Views(spark, folder).data_nodes.select(
        "host",
        L.utilisation(F.col("usedSpace"), F.col("capacity")).alias("pct"),
        L.utilisation(F.col("usedSpace"), F.lit(250_000_000_000)).alias("pct_small"),
    )


def node_severity(spark: SparkSession, folder: str) -> DataFrame:
    pct = L.utilisation(F.col("usedSpace"), F.lit(1_000_000_000_000))
    return Views(spark, folder).data_nodes.select(
        "host", L.severity(pct).alias("severity"), L.severity_colour(pct).alias("colour")
    )


def node_state(spark: SparkSession, folder: str) -> DataFrame:
    state = F.col("adminState")
    return Views(spark, folder).data_nodes.select(
        "host", L.node_state(state).alias("state"), L.node_state_class(state).alias("class")
    )


def fmt_bytes(spark: SparkSession, folder: str) -> DataFrame:
    views = Views(spark, folder)
    files = views.hdfs_entries.select(
        F.concat_ws("/", "dir", "pathSuffix").alias("name"), L.entry_size(F.col("type"), F.col("length")).alias("size")
    )
    nodes = views.data_nodes.select(F.col("host").alias("name"), L.format_bytes(F.col("usedSpace")).alias("size"))
    return files.unionByName(nodes)


def hdfs_listing(spark: SparkSession, folder: str) -> DataFrame:
    return listing_from_text(Views(spark, folder).listing_documents).select("dir", "pathSuffix", "type", "length")


def listing_sorted(spark: SparkSession, folder: str) -> DataFrame:
    return sort_listing(Views(spark, folder).hdfs_entries).select("dir", "type", "pathSuffix")


def listing_page(spark: SparkSession, folder: str) -> DataFrame:
    entries = Views(spark, folder).hdfs_entries
    return page(entries, listing_keys(), 1, 20, "place").select("place", "type", "pathSuffix")


def listing_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry with its place in the sorted listing of all folders."""
    entries = Views(spark, folder).hdfs_entries.select("dir", "type", "pathSuffix")
    return with_position(entries, [F.col("dir").asc(), *listing_keys()])


def path_resolve(spark: SparkSession, folder: str) -> DataFrame:
    cwd, typed = F.col("dir"), F.regexp_replace("url", r"\Ahttps?:", "")
    return (
        Views(spark, folder)
        .table("pages")
        .select("page_id", "url", F.concat(F.lit("/p"), F.col("page_id") % 7).alias("dir"))
        .select(
            "page_id",
            L.resolve_path(cwd, typed).alias("absolute"),
            L.resolve_path(cwd, F.concat(F.lit(" a//b"), typed, F.lit("/ "))).alias("relative"),
            L.resolve_path(F.lit("/"), F.concat(F.lit("x"), typed)).alias("from_root"),
            L.resolve_path(cwd, F.lit(" // ")).alias("root"),
            L.resolve_path(cwd, F.lit("  ")).alias("stay"),
        )
    )


def path_parts(spark: SparkSession, folder: str) -> DataFrame:
    path = L.resolve_path(F.lit("/"), F.regexp_replace("url", r"\Ahttps?:", ""))
    parts = Views(spark, folder).table("pages").select("page_id", L.path_parts(path).alias("p"))
    return parts.select(
        "page_id",
        F.array_join("p.segments", "|").alias("segments"),
        F.col("p.depth").alias("depth"),
        F.col("p.parent").alias("parent"),
        F.array_join("p.ancestors", " ").alias("crumbs"),
    )


def remote_error(spark: SparkSession, folder: str) -> DataFrame:
    """Landed responses of failed listings, made of the pages: exceptions, HTML and plain text."""
    kind = F.col("page_id") % 4
    named = F.struct(F.lit("AccessControlException").alias("exception"), F.col("url").alias("message"))
    bare = F.struct(F.lit("RemoteException").alias("exception"), F.col("url").alias("message"))
    body = (
        F.when(kind == 0, F.to_json(F.struct(named.alias("RemoteException"))))
        .when(kind == 1, F.to_json(F.struct(bare.alias("RemoteException"))))
        .when(kind == 2, F.concat(F.lit("<html><PRE>\n "), F.col("url"), F.lit(" \n</PRE><pre>second</pre>"), F.col("html")))
        .otherwise(F.col("html"))
    )
    text = L.remote_error(body, F.col("page_id") % 100 + 400, F.lit("Not Found"))
    return Views(spark, folder).table("pages").select("page_id", text.alias("error"))


QUERIES = {
    f.__name__: f
    for f in [
        queue_usage, queue_tree, queue_fields, queue_quota, queue_history, cluster_metrics, datanode_usage, storage_overview, top_nodes,
        node_utilisation, node_severity, node_state, fmt_bytes, hdfs_listing, listing_sorted, listing_page, listing_positions, path_resolve,
        path_parts, remote_error,
    ]
} | {"leaf_queues": leaf_queue_names}


def pct(used: str, total: str) -> str:
    return f"CASE WHEN {total} > 0 THEN CAST(least(100, floor(CAST({used} AS DOUBLE) / {total} * 100 + 0.5)) AS BIGINT) ELSE 0 END"


def _bytes(v: str) -> str:
    kb = f"((CAST({v} AS HUGEINT) + 512) // 1024)"
    return (
        f"CASE WHEN {v} <= 0 THEN '0 B' WHEN {v} < 1024 THEN concat({v}, ' B') WHEN {v} < 1048576 THEN concat({kb}, ' KB')"
        f" WHEN {v} < 1073741824 THEN concat({tenths(v, 1048576)}, ' MB')"
        f" WHEN {v} < 1099511627776 THEN concat({tenths(v, 1073741824)}, ' GB')"
        f" ELSE concat({tenths(v, 1099511627776)}, ' TB') END"
    )


def _band(p: str, high: str, medium: str, normal: str) -> str:
    return f"CASE WHEN {p} >= 85 THEN '{high}' WHEN {p} >= 60 THEN '{medium}' ELSE '{normal}' END"


_SCHEDULER = "CASE k % 3 WHEN 0 THEN 'capacity' WHEN 1 THEN 'fair' ELSE 'unknown' END"
_QUEUES = f"""(WITH s AS (SELECT s_suppkey AS k FROM supplier),
 g AS (SELECT k, unnest(range(1, k % 3 + 3)) AS g FROM s),
 l AS (SELECT k, g, unnest(range(1, g + k % 2 + 1)) AS l FROM g)
 SELECT k AS snapshot, {_SCHEDULER} AS scheduler, 'root' AS "queueName", CAST(NULL AS VARCHAR) AS parent, 0 AS depth, 'root' AS path, 100.0 AS cap, NULL AS l FROM s
 UNION ALL SELECT k, {_SCHEDULER}, concat('g', g), 'root', 1, concat('root.g', g), g * 5.0, NULL FROM g
 UNION ALL SELECT k, {_SCHEDULER}, concat('g', g, 'l', l), concat('g', g), 2, concat('root.g', g, '.g', g, 'l', l), CASE WHEN k % 3 = 1 THEN 0 ELSE l END, l FROM l)"""
_FIELDS = f"""(SELECT snapshot, path, scheduler, CAST(cap AS DOUBLE) AS "absoluteCapacity",
 CAST(CASE WHEN l IS NULL THEN 0 ELSE l * 512 + snapshot END AS BIGINT) AS memory, CAST(coalesce(l, 0) AS BIGINT) AS "vCores",
 CAST(CASE WHEN scheduler = 'fair' AND l % 2 = 0 THEN l * 4096 ELSE 0 END AS BIGINT) AS "quotaMemory",
 CAST(CASE WHEN scheduler = 'fair' AND l % 2 = 0 THEN l * 4 ELSE 0 END AS BIGINT) AS "quotaVCores",
 CAST(CASE WHEN scheduler = 'fair' AND l = 1 THEN 1000 END AS BIGINT) AS "fairMemory",
 CAST(CASE WHEN scheduler = 'fair' AND l = 1 THEN 2 END AS BIGINT) AS "fairVCores",
 CAST((snapshot + l) % 7 AS BIGINT) AS "numActiveApps", CAST(NULL AS BIGINT) AS "numPendingApps" FROM {_QUEUES})"""


def _quota(limit: str, share: str, total: str) -> str:
    return (
        f"CASE WHEN scheduler = 'fair' THEN CASE WHEN {limit} > 0 THEN CAST({limit} AS DOUBLE) WHEN {share} <> 0 THEN CAST({share} AS DOUBLE)"
        f' ELSE CAST({total} AS DOUBLE) END WHEN "absoluteCapacity" > 0 THEN CAST({total} AS DOUBLE) * "absoluteCapacity" / 100 ELSE CAST({total} AS DOUBLE) END'
    )


_URL = "regexp_replace(url, '^https?:', '')"


def _tidy(p: str) -> str:
    t = f"rtrim(regexp_replace({p}, '/+', '/', 'g'), '/')"
    return f"CASE WHEN {t} = '' THEN '/' ELSE {t} END"


ORACLES = {
    "queue_usage": f"""WITH used AS (SELECT queue, CAST(sum("allocatedMB") AS BIGINT) AS memory, CAST(sum("allocatedVCores") AS BIGINT) AS vc, count(*) AS n
 FROM {{apps}} WHERE state = 'RUNNING' GROUP BY queue),
 q AS (SELECT "queueName", parent, coalesce(n, 0) AS "runningApps", coalesce(memory, 0) AS memory, coalesce(vc, 0) AS "vCores",
 CASE WHEN "absoluteCapacity" > 0 THEN CAST("totalMB" AS DOUBLE) * "absoluteCapacity" / 100 ELSE CAST("totalMB" AS DOUBLE) END AS "memQuota",
 CASE WHEN "absoluteCapacity" > 0 THEN CAST("totalVirtualCores" AS DOUBLE) * "absoluteCapacity" / 100 ELSE CAST("totalVirtualCores" AS DOUBLE) END AS "vcoreQuota"
 FROM {{queues}} LEFT JOIN used ON queue = "queueName" CROSS JOIN {{cluster_metrics}}),
 p AS (SELECT *, {pct('memory', '"memQuota"')} AS "memPct", {pct('"vCores"', '"vcoreQuota"')} AS "vcorePct" FROM q)
 SELECT *, {_band('"memPct"', 'high', 'medium', 'normal')} AS "memSeverity" FROM p""",
    "queue_tree": f"""SELECT snapshot, scheduler, "queueName", parent, depth, path FROM {_QUEUES}""",
    "queue_fields": f"""SELECT snapshot, path, "absoluteCapacity", memory, "vCores", "quotaMemory", "fairMemory", "numActiveApps", "numPendingApps" FROM {_FIELDS}""",
    "queue_quota": f"""WITH q AS (SELECT snapshot, path, memory, "vCores", {_quota('"quotaMemory"', '"fairMemory"', '"totalMB"')} AS "memQuota",
 {_quota('"quotaVCores"', '"fairVCores"', '"totalVirtualCores"')} AS "vcoreQuota" FROM {_FIELDS} CROSS JOIN {{cluster_metrics}})
 SELECT snapshot, path, "memQuota", "vcoreQuota", {pct('memory', '"memQuota"')} AS "memPct", {pct('"vCores"', '"vcoreQuota"')} AS "vcorePct" FROM q""",
    "queue_history": f"""WITH q AS (SELECT snapshot, path, memory, "vCores", {_quota('"quotaMemory"', '"fairMemory"', '(snapshot * 1024 + 4096)')} AS "memQuota",
 {_quota('"quotaVCores"', '"fairVCores"', '(snapshot % 32 + 8)')} AS "vcoreQuota" FROM {_FIELDS}),
 p AS (SELECT snapshot, path, "memQuota", "vcoreQuota", {pct('memory', '"memQuota"')} AS "memPct", {pct('"vCores"', '"vcoreQuota"')} AS "vcorePct" FROM q)
 SELECT *, {_band('"memPct"', 'high', 'medium', 'normal')} AS "memSeverity" FROM p""",
    "leaf_queues": f"""SELECT snapshot, "queueName" FROM {_QUEUES} WHERE depth = 2""",
    "cluster_metrics": f"""WITH m AS (SELECT s_suppkey AS snapshot, s_suppkey * 1024 + 4096 AS "totalMB",
 CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey * 512 ELSE 0 END AS "allocatedMB", s_suppkey % 32 + 8 AS "totalVirtualCores", CAST(0 AS BIGINT) AS "appsRunning" FROM supplier)
 SELECT *, {pct('"allocatedMB"', '"totalMB"')} AS "memPct" FROM m""",
    "datanode_usage": f"""WITH n AS (SELECT host, capacity, "usedSpace", capacity - "usedSpace" AS remaining, CAST(0 AS BIGINT) AS "numBlocks",
 {pct('"usedSpace"', 'capacity')} AS "usedPct", coalesce("adminState", 'In Service') AS state FROM {{data_nodes}} WHERE capacity > 0)
 SELECT *, {_band('"usedPct"', 'high', 'medium', 'normal')} AS severity, {_bytes('"usedSpace"')} AS "usedText", {_bytes('capacity')} AS "capacityText" FROM n""",
    "storage_overview": f"""WITH c AS (SELECT host AS snapshot, capacity, "usedSpace" AS "CapacityUsed", CAST(0 AS BIGINT) AS "BlocksTotal", {pct('"usedSpace"', 'capacity')} AS "usedPct" FROM {{data_nodes}})
 SELECT snapshot, "CapacityUsed", "BlocksTotal", "usedPct", 100 - "usedPct" AS "remainingPct", CAST(0 AS BIGINT) AS "nonDfsPct",
 {_bytes('"CapacityUsed"')} AS "usedText", {_bytes('capacity')} AS "totalText" FROM c""",
    "top_nodes": """SELECT * FROM (SELECT row_number() OVER (ORDER BY "usedSpace" DESC, host) AS place, host, "usedSpace" FROM {data_nodes} WHERE capacity > 0)
 WHERE place <= 20""",
    "node_utilisation": f"""SELECT host, {pct('"usedSpace"', 'capacity')} AS pct, {pct('"usedSpace"', '250000000000')} AS pct_small FROM {{data_nodes}}""",
    "node_severity": f"""WITH n AS (SELECT host, {pct('"usedSpace"', '1000000000000')} AS p FROM {{data_nodes}})
 SELECT host, {_band('p', 'high', 'medium', 'normal')} AS severity, {_band('p', '#f56c6c', '#e6a23c', '#5e6ad2')} AS colour FROM n""",
    "node_state": """SELECT host, coalesce("adminState", 'In Service') AS state, CASE WHEN "adminState" IS NULL THEN 'success' ELSE 'warning' END AS class FROM {data_nodes}""",
    "fmt_bytes": f"""SELECT concat(dir, '/', "pathSuffix") AS name, CASE WHEN type = 'DIRECTORY' THEN '—' ELSE {_bytes('length')} END AS size FROM {{hdfs_entries}}
 UNION ALL SELECT host, {_bytes('"usedSpace"')} FROM {{data_nodes}}""",
    "hdfs_listing": """SELECT dir, "pathSuffix", type, length FROM {hdfs_entries}""",
    "listing_sorted": """SELECT dir, type, "pathSuffix" FROM {hdfs_entries}""",
    "listing_page": """SELECT * FROM (SELECT row_number() OVER (ORDER BY CASE WHEN type = 'DIRECTORY' THEN 0 ELSE 1 END, lower("pathSuffix"), "pathSuffix") AS place,
 type, "pathSuffix" FROM {hdfs_entries}) WHERE place BETWEEN 21 AND 40""",
    "listing_positions": """SELECT dir, type, "pathSuffix", row_number() OVER (ORDER BY dir, CASE WHEN type = 'DIRECTORY' THEN 0 ELSE 1 END, lower("pathSuffix"), "pathSuffix") - 1 AS position FROM {hdfs_entries}""",
    "path_resolve": f"""SELECT page_id, {_tidy(_URL)} AS absolute, {_tidy(f"concat('/p', page_id % 7, '/a//b', {_URL}, '/')")} AS relative,
 {_tidy(f"concat('/x', {_URL})")} AS from_root, '/' AS root, concat('/p', page_id % 7) AS stay FROM pages""",
    "path_parts": f"""WITH p AS (SELECT page_id, {_tidy(_URL)} AS path FROM pages), s AS (SELECT page_id, path, string_split(substr(path, 2), '/') AS parts FROM p)
 SELECT page_id, array_to_string(parts, '|') AS segments, CAST(len(parts) AS INT) AS depth,
 CASE WHEN len(parts) = 1 THEN '/' ELSE concat('/', array_to_string(parts[1:len(parts)-1], '/')) END AS parent,
 array_to_string([concat('/', array_to_string(parts[1:i], '/')) FOR i IN range(1, len(parts) + 1)], ' ') AS crumbs FROM s""",
    "remote_error": """SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('AccessControlException: ', url) WHEN 1 THEN url WHEN 2 THEN url
 ELSE CASE WHEN regexp_matches(html, '(?is)<pre>(.*?)</pre>') THEN trim(regexp_extract(html, '(?is)<pre>(.*?)</pre>', 1), chr(10) || chr(13) || chr(9) || ' ')
 ELSE concat('HTTP ', page_id % 100 + 400, ' Not Found') END END AS error FROM pages""",
}
ORACLES = {name: sql(text) for name, text in ORACLES.items()}

"""Snapshot tables as projections of the given tables, for Spark and for SQL alike.

Every view is written once as ``(column, expression)`` pairs that both engines read;
``MS(x)`` stands for epoch milliseconds, which they spell differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens import schemas

SPARK_MS = r"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', \1)"
PLAIN_MS = r"(epoch_us(\1)//1000)"


def _case(key: str, texts: list[str]) -> str:
    *whens, last = texts
    arms = " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(whens))
    return f"CASE {key} % {len(texts)} {arms} ELSE {last} END"


def _app_columns(key: str) -> list[tuple[str, str]]:
    states = ["'ACCEPTED'", "'RUNNING'", "'FINISHED'", "'FAILED'", "'KILLED'"]
    return [
        ("id", f"concat('application_1704067200_', CAST({key} AS STRING))"),
        ("name", "concat(upper(event_type), '-job-', CAST(user_id AS STRING))"),
        ("state", _case("event_id", states)),
        ("user", "concat('user', CAST(user_id % 40 AS STRING))"),
        ("queue", "concat('NATION_', CAST(user_id % 25 AS STRING))"),
        (
            "applicationType",
            "CASE event_type WHEN 'click' THEN 'SPARK' WHEN 'view' THEN 'MAPREDUCE' WHEN 'error' THEN 'FLINK' ELSE 'TEZ' END",
        ),
        ("startedTime", "CAST(MS(ts) AS BIGINT)"),
        (
            "finishedTime",
            "CASE WHEN event_id % 5 <= 1 THEN CAST(0 AS BIGINT) ELSE CAST(MS(ts) + CAST(floor(value*1000) AS BIGINT) AS BIGINT) END",
        ),
        ("elapsedTime", "CAST(floor(value*1000) AS BIGINT)"),
        ("allocatedMB", "CAST(floor(value*64) AS BIGINT)"),
        ("allocatedVCores", "CAST(event_id % 64 AS BIGINT)"),
        ("seq", "CAST(event_id AS BIGINT)"),
    ]


STATEMENTS = [
    "concat('SELECT * FROM shop.orders WHERE k = ', CAST(o_custkey AS STRING))",
    "concat('-- note', chr(10), 'with a as (select 1) select * from a JOIN b LIMIT ', CAST(o_custkey * 10 AS STRING))",
    "'INSERT INTO audit_log VALUES (1)'",
    "'SELECT 1; DELETE FROM orders'",
    "concat('SELECT ', chr(39), ';', chr(39), ' AS semi FROM dual;')",
    "'CALL pkg.refresh()'",
    "'SELECT * FROM t WHERE ROWNUM <= 50'",
    "'UPDATE other.t SET a = 1'",
]

VIEWS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "apps": ("events", _app_columns("event_id")),
    "process_instances": (
        "orders",
        [
            ("id", "o_orderkey"),
            ("name", "concat('flow-', CAST(o_custkey AS STRING), '-', o_orderpriority)"),
            ("state", "CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'RUNNING_EXEUTION' ELSE 'READY_STOP' END"),
            ("startTime", "o_orderdate"),
            ("duration", "CAST(floor(o_totalprice/50) AS BIGINT)"),
        ],
    ),
    "task_instances": (
        "lineitem",
        [
            ("id", "l_orderkey*10 + l_linenumber"),
            ("processInstanceId", "l_orderkey"),
            ("name", "concat('task-', CAST(l_partkey AS STRING))"),
            ("state", "CASE l_returnflag WHEN 'R' THEN 'FAILURE' WHEN 'A' THEN 'SUCCESS' ELSE 'SUBMITTED_SUCCESS' END"),
            ("startTime", "l_shipdate"),
            ("duration", "CAST(l_quantity AS BIGINT) * 97"),
            ("retryTimes", "CAST(l_linenumber % 3 AS INT)"),
            ("maxRetryTimes", "CASE WHEN l_linenumber = 1 THEN CAST(NULL AS INT) ELSE 3 END"),
        ],
    ),
    "task_logs": (
        "documents",
        [
            ("taskInstanceId", "doc_id"),
            (
                "log",
                "CASE WHEN doc_id % 3 = 0 THEN concat('start', chr(10), 'Submitted application_1704067200_', CAST(doc_id AS STRING), chr(10), text) ELSE text END",
            ),
        ],
    ),
    "hdfs_entries": (
        "pages",
        [
            ("dir", "concat('/p', CAST(page_id % 7 AS STRING))"),
            ("pathSuffix", "concat(CASE WHEN page_id % 2 = 0 THEN 'Part' ELSE 'part' END, '-', CAST(page_id AS STRING))"),
            ("type", "CASE WHEN page_id % 5 = 0 THEN 'DIRECTORY' ELSE 'FILE' END"),
            ("length", "CASE WHEN page_id % 5 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(length(html) AS BIGINT) END"),
        ],
    ),
    "data_nodes": (
        "supplier",
        [
            ("host", "s_name"),
            ("capacity", "CASE WHEN s_suppkey % 20 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(1099511627776 AS BIGINT) END"),
            ("usedSpace", "CAST(floor(abs(s_acctbal)*100000000) AS BIGINT)"),
            ("adminState", "CASE WHEN s_suppkey % 4 = 0 THEN 'Decommissioned' END"),
        ],
    ),
    "sql_audit": (
        "orders",
        [
            ("stmt_id", "o_orderkey"),
            ("db", _case("o_custkey", ["'shop'", "'crm'", "'sales'", "'ghost'", "'private'"])),
            ("stmt", _case("o_orderkey", STATEMENTS)),
        ],
    ),
}

QUEUES_SQL = """SELECT 'root' AS "queueName", CAST(NULL AS STRING) AS parent, CAST(100 AS DOUBLE) AS "absoluteCapacity"
 UNION ALL SELECT r_name, 'root', CAST(20 AS DOUBLE) FROM region
 UNION ALL SELECT n_name, r_name, CAST(n_nationkey % 5 AS DOUBLE) FROM nation JOIN region ON n_regionkey = r_regionkey"""
METRICS_SQL = """SELECT CAST(count(*)*16384 AS BIGINT) AS "totalMB", CAST(count(*)*8 AS BIGINT) AS "totalVirtualCores" FROM supplier"""


def _view_sql(name: str) -> str:
    table, columns = VIEWS[name]
    exprs = ", ".join(f'{re.sub(r"MS\((\w+)\)", PLAIN_MS, e)} AS "{alias}"' for alias, e in columns)
    return f"SELECT {exprs} FROM {table}"


def sql(text: str) -> str:
    """Fills ``{view}`` places of a query with the view as a subquery."""
    known = {"queues": QUEUES_SQL, "cluster_metrics": METRICS_SQL}

    def fill(found: re.Match) -> str:
        name = found[1]
        return f"({known.get(name) or _view_sql(name)})"

    return re.sub(r"\{(\w+)\}", fill, text)


class Views:
    """The snapshot tables of one folder of given tables, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def project(self, df: DataFrame, name: str) -> DataFrame:
        """The columns of a view out of its given table, batch or stream."""
        _, columns = VIEWS[name]
        return df.select(*[F.expr(re.sub(r"MS\((\w+)\)", SPARK_MS, e)).alias(alias) for alias, e in columns])

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        return self.project(self.table(VIEWS[name][0]), name)

    @property
    def queues(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        root = self.spark.range(1).selectExpr(
            "'root' AS queueName", "CAST(NULL AS STRING) AS parent", "CAST(100 AS DOUBLE) AS absoluteCapacity"
        )
        middle = region.selectExpr("r_name", "'root'", "CAST(20 AS DOUBLE)")
        leaves = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).selectExpr(
            "n_name", "r_name", "CAST(n_nationkey % 5 AS DOUBLE)"
        )
        return root.union(middle).union(leaves)

    @property
    def cluster_metrics(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "CAST(count(*)*16384 AS BIGINT) AS totalMB", "CAST(count(*)*8 AS BIGINT) AS totalVirtualCores"
        )

    # --- snapshots as JSON texts, one document per row ----------------------------------

    @property
    def app_documents(self) -> DataFrame:
        """An envelope per event: the application, and every fourth time a second attempt of it."""
        apps = self.apps.drop("seq")
        app = F.struct(*[F.col(f"`{c}`") for c in apps.columns])
        again = app.withField("id", F.concat("id", F.lit("_2"))).withField("state", F.lit("RUNNING"))
        listed = F.when(F.col("allocatedVCores") % 4 == 0, F.array(app, again)).otherwise(F.array(app))
        return apps.select(F.to_json(F.struct(F.struct(listed.alias("app")).alias("apps"))).alias("value"))

    @property
    def metric_documents(self) -> DataFrame:
        """A metrics record per supplier; some fields are missing."""
        metrics = F.struct(
            (F.col("s_suppkey") * 1024 + 4096).alias("totalMB"),
            F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey") * 512).alias("allocatedMB"),
            (F.col("s_suppkey") % 32 + 8).alias("totalVirtualCores"),
        )
        return self.table("supplier").select(
            F.col("s_suppkey").alias("snapshot"), F.to_json(F.struct(metrics.alias("clusterMetrics"))).alias("value")
        )

    @property
    def listing_documents(self) -> DataFrame:
        entry = F.struct("pathSuffix", "type", "length")
        statuses = F.struct(F.array(entry).alias("FileStatus")).alias("FileStatuses")
        return self.hdfs_entries.select(F.to_json(F.struct("dir", statuses)).alias("value"))

    @property
    def storage_documents(self) -> DataFrame:
        """A storage snapshot per supplier: cluster figures and one node, whose map is text or object."""
        nodes = self.data_nodes
        node = F.struct("capacity", "usedSpace", (F.col("capacity") - F.col("usedSpace")).alias("remaining"), "adminState")
        live = F.to_json(F.create_map(F.col("host"), node))
        cluster = F.struct(
            F.lit("Hadoop:service=NameNode,name=FSNamesystem").alias("name"),
            F.col("capacity").alias("CapacityTotal"),
            F.col("usedSpace").alias("CapacityUsed"),
            F.lit(None).cast("string").alias("LiveNodes"),
        )
        info = F.struct(
            F.lit("Hadoop:service=NameNode,name=NameNodeInfo").alias("name"),
            F.lit(None).cast("bigint").alias("CapacityTotal"),
            F.lit(None).cast("bigint").alias("CapacityUsed"),
            live.alias("LiveNodes"),
        )
        return nodes.select(
            F.col("host").alias("snapshot"), F.to_json(F.struct(F.array(cluster, info).alias("beans"))).alias("value")
        )

    @property
    def scheduler_documents(self) -> DataFrame:
        """A scheduler snapshot per supplier: two to four groups of queues, in three dialects."""
        key = F.col("s_suppkey")
        fair = key % 3 == 1

        def text(*pieces):
            return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces])

        def resources(name, memory, cores):
            return text(f', "{name}": {{"memory": ', memory, ', "vCores": ', cores, "}")

        def leaf(group, number):
            held = [number * 512 + key, number]
            limit = F.when(number % 2 == 0, resources("maxResources", number * 4096, number * 4)).otherwise("")
            share = F.when(number == 1, resources("fairShare", number * 1000, number * 2)).otherwise("")
            running = (key + number) % 7
            of_fair = text(resources("usedResources", *held), limit, share, ', "numActiveApps": ', running)
            of_other = text(
                resources("resourcesUsed", *held), ', "absoluteCapacity": ', number, ', "numActiveApplications": ', running
            )
            name = text('{"queueName": "g', group, "l", number, '"')
            return F.concat(name, F.when(fair, of_fair).otherwise(of_other), F.lit("}"))

        def children(first, last, queue):
            queues = F.array_join(F.transform(F.sequence(F.lit(first).cast("bigint"), last), queue), ", ")
            spelled = F.when(fair, "childQueues").otherwise("queues")
            return text(', "', spelled, '": {"queue": [', queues, "]}")

        def group(number):
            head = text('{"queueName": "g', number, '", "absoluteCapacity": ', number * 5)
            return F.concat(head, children(1, number + key % 2, lambda i: leaf(number, i)), F.lit("}"))

        kind = F.when(fair, "fairScheduler").when(key % 3 == 0, "capacityScheduler").otherwise("fifoScheduler")
        root = F.concat(F.lit('"queueName": "root", "absoluteCapacity": 100'), children(1, key % 3 + 2, group))
        info = F.when(fair, text('"rootQueue": {', root, "}")).otherwise(root)
        doc = text('{"scheduler": {"schedulerInfo": {"type": "', kind, '", ', info, "}}}")
        return self.table("supplier").select(key.alias("snapshot"), doc.alias("value"))

    @property
    def project_pages(self) -> DataFrame:
        """Customers as listings of 1,200 projects in pages of 100; in some listings a page fails.

        Both groupings are bounded by the page and listing sizes.
        """
        rows = self.table("customer").select(
            F.floor(F.col("c_custkey") / 1200).alias("listing"),
            (F.floor(F.col("c_custkey") % 1200 / 100) + 1).alias("page_no"),
            F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description")).alias("row"),
        )
        totals = rows.groupBy("listing").agg(F.count("*").alias("total"))
        pages = rows.groupBy("listing", "page_no").agg(F.sort_array(F.collect_list("row")).alias("totalList"))
        failed = (F.col("listing") % 5 == 1) & (F.col("page_no") == 2)
        answer = F.struct(
            F.when(failed, 10113).otherwise(0).alias("code"),
            F.when(failed, "page failed").alias("msg"),
            F.struct("totalList", "total").alias("data"),
        )
        text = pages.join(totals, "listing").select("listing", "page_no", F.to_json(answer).alias("value"))
        parsed = F.from_json("value", schemas.page_envelope(schemas.PROJECT)).alias("answer")
        return text.select("listing", "page_no", parsed).select("listing", "page_no", "answer.*")

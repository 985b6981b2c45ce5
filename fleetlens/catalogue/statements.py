"""Queries over SQL statements, governed SQL, and exports, with their plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.catalogue.views import Views, sql
from fleetlens.governance import checks, split
from fleetlens.governance.policy import Policy
from fleetlens.governance.runner import GuardedSession
from fleetlens.operators.paging import cap_rows
from fleetlens.session import work_dir
from fleetlens.sinks.append import guarded_append as append
from fleetlens.sinks.audit import audit_rows as audit
from fleetlens.sinks.csv import csv_line, export_csv
from fleetlens.sources.registry import Registry

SERVICES = {"shop": "shopdb", "crm": "other", "sales": "salesdb", "private": "private"}
POLICY = Policy(
    allowed_sources=("shop", "crm", "sales", "ghost"),
    allowed_tables=("orders", "t", "a", "b", "audit_log", "dual"),
    writable_tables=("crm.*", "shop.audit_log"),
    procedures=("shop.pkg.refresh",),
)


def _audit(spark: SparkSession, folder: str) -> DataFrame:
    return Views(spark, folder).sql_audit


def audit_read_only(spark: SparkSession, folder: str) -> DataFrame:
    return _audit(spark, folder).select("stmt_id", checks.is_read_only(F.col("stmt")).alias("read_only"))


def audit_multi(spark: SparkSession, folder: str) -> DataFrame:
    return _audit(spark, folder).select("stmt_id", checks.is_multi(F.col("stmt")).alias("multi"))


def _refs(spark: SparkSession, folder: str) -> DataFrame:
    return _audit(spark, folder).select("stmt_id", F.explode(checks.table_refs(F.col("stmt"))).alias("table_name"))


def audit_table_refs(spark: SparkSession, folder: str) -> DataFrame:
    return _refs(spark, folder).groupBy("table_name").agg(F.count("*").alias("mentions"))


def audit_tables_allowed(spark: SparkSession, folder: str) -> DataFrame:
    return _audit(spark, folder).select("stmt_id", checks.tables_allowed(F.col("stmt"), ["orders", "t", "b"]).alias("allowed"))


def tables_not_allowed(spark: SparkSession, folder: str) -> DataFrame:
    return checks.disallowed_tables(_refs(spark, folder), ["orders", "t", "b"])


def audit_writable(spark: SparkSession, folder: str) -> DataFrame:
    service = F.create_map(*[F.lit(x) for pair in SERVICES.items() for x in pair])[F.col("db")]
    writable = checks.is_writable(F.col("stmt"), F.col("db"), service, POLICY.writable_tables)
    return _audit(spark, folder).select("stmt_id", "db", F.coalesce(writable, F.lit(False)).alias("writable"))


def audit_procedures(spark: SparkSession, folder: str) -> DataFrame:
    return _audit(spark, folder).select(
        "stmt_id",
        checks.is_procedure(F.col("stmt")).alias("call"),
        checks.procedure_ref(F.col("stmt"), F.col("db")).alias("procedure_name"),
        checks.is_executable(F.col("stmt"), F.col("db"), POLICY.procedures).alias("executable"),
    )


def audit_row_cap(spark: SparkSession, folder: str) -> DataFrame:
    return _audit(spark, folder).select(
        "stmt_id", checks.row_cap(F.col("stmt")).alias("cap"), checks.cap_too_high(F.col("stmt")).alias("too_high")
    )


def audit_length(spark: SparkSession, folder: str) -> DataFrame:
    return _audit(spark, folder).select("stmt_id", checks.too_long(F.col("stmt"), 38).alias("too_long"))


def audit_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    return _audit(spark, folder).select(
        "stmt_id", *[checks.with_row_cap(F.col("stmt"), mode, 100).alias(f"as_{mode}") for mode in ("mysql", "fetch", "rownum")]
    )


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    return checks.with_verdict(_audit(spark, folder), POLICY, SERVICES)


def audit_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder).select("stmt_id", "code", "detail")


def audit_verdict_counts(spark: SparkSession, folder: str) -> DataFrame:
    return checks.verdict_counts(_judged(spark, folder))


def split_statements(spark: SparkSession, folder: str) -> DataFrame:
    """A script per audited statement: it, a quoted semicolon, a comment and an unfinished rest."""
    tail = F.lit(";\n SELECT ';;' AS x, \";\" AS y ;  ; -- done\n; SELECT 2 ")
    pieces = _audit(spark, folder).select("stmt_id", F.posexplode(split.split_statements(F.concat(F.col("stmt"), tail))).alias("pos", "piece"))
    return pieces.select("stmt_id", "pos", "piece")


def audit_rows(spark: SparkSession, folder: str) -> DataFrame:
    statements = _audit(spark, folder)
    long = F.concat_ws(" ", F.col("stmt"), F.repeat(F.lit("/* padding */"), 16))
    return audit(statements, F.col("stmt_id") + 1_700_000_000_000, F.col("db"), F.col("stmt_id") % 100, F.col("stmt_id") % 977, long)


def csv_lines(spark: SparkSession, folder: str) -> DataFrame:
    parts = _export_rows(spark, folder)
    return parts.select("p_partkey", csv_line(parts).alias("line"))


def _export_rows(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    label = (
        F.when(key % 5 == 0, F.concat(F.col("p_name"), F.lit(', "'), F.col("p_brand"), F.lit('"')))
        .when(key % 5 == 1, F.concat(F.col("p_name"), F.lit("\n"), F.col("p_brand")))
        .when(key % 5 == 2, F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")))
        .when(key % 5 == 3, F.col("p_name"))
    )
    return Views(spark, folder).table("part").select("p_partkey", label.alias("label"), "p_size", "p_retailprice")


def csv_export(spark: SparkSession, folder: str) -> DataFrame:
    """Parts written as CSV and read back."""
    path = work_dir(spark, "csv")
    export_csv(_export_rows(spark, folder), path)
    kinds = "p_partkey bigint, label string, p_size bigint, p_retailprice double"
    return spark.read.csv(
        path, schema=kinds, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def guarded_append(spark: SparkSession, folder: str) -> DataFrame:
    orders = Views(spark, folder).table("orders")
    return append(orders, "shop.orders_copy", work_dir(spark, "append"), Policy(writable_tables=("shop.*",)))


def capped_rows(spark: SparkSession, folder: str) -> DataFrame:
    lines = Views(spark, folder).table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    shown, more = cap_rows(lines.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), limit=500)
    return shown.withColumn("truncated", F.lit(more))


# --- governed SQL -----------------------------------------------------------------------

TABLES = ["customer", "lineitem", "nation", "orders", "part", "supplier"]

GUARDED = {
    "sql_select_where": """SELECT count(*) AS orders, min(o_orderkey) AS first, max(o_orderkey) AS last, CAST(sum(o_orderkey) AS BIGINT) AS keys
 FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'F'""",
    "sql_cte": """WITH big AS (SELECT l_orderkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey)
 SELECT count(*) AS orders, CAST(sum(quantity) AS BIGINT) AS pieces FROM big WHERE quantity > 100""",
    "sql_inner_join": """SELECT n_name, count(*) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "sql_left_join": """SELECT c_mktsegment, count(*) AS customers, count(o.o_custkey) AS with_orders
 FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) o ON o.o_custkey = c_custkey GROUP BY c_mktsegment""",
    "sql_right_join": """SELECT n_name, count(s_suppkey) AS suppliers FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""",
    "sql_group_having": """SELECT count(*) AS suppliers, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(pieces) AS BIGINT) AS pieces FROM (
 SELECT l_suppkey, count(*) AS lines, CAST(sum(l_quantity) AS BIGINT) AS pieces FROM lineitem GROUP BY l_suppkey HAVING count(*) > 550) s""",
    "sql_order_limit_offset": "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 40 OFFSET 25",
    "sql_union": "SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 0",
    "sql_guarded": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey;",
}
# the same in another engine's spelling, run in place of the text above
SPELLED = {"sql_order_limit_offset": "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 25, 40"}

SCRIPT = """SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F';
-- a piece that starts with a comment is not run
SELECT 1; DELETE FROM orders;
SELECT o_orderkey FROM orders ORDER BY o_orderkey;
SELECT nothing FROM orders;
SELECT ';' AS semi, o_custkey FROM orders ORDER BY o_orderkey, o_custkey LIMIT 7"""


def _session(spark: SparkSession, folder: str, tables: list[str]) -> GuardedSession:
    registry = Registry.from_config({"datasources": [{"name": "lake", "type": "parquet", "path": folder}]})
    return GuardedSession(spark, registry, "lake", tables, Policy(allowed_sources=("lake",)))


def _guarded(name: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        result = _session(spark, folder, TABLES).run(SPELLED.get(name, GUARDED[name]))
        if result.df is None:
            raise RuntimeError(result.error)
        return result.df if name != "sql_guarded" else result.df.withColumn("truncated", F.lit(result.truncated))

    query.__name__ = name
    return query


INSERT = "INSERT INTO orders_copy SELECT * FROM orders WHERE o_orderstatus = 'F'"


def sql_insert(spark: SparkSession, folder: str) -> DataFrame:
    """Rows put into a copy of the orders by the runner, which tells how many; beside them what the copy holds then."""
    place = work_dir(spark, "shop")
    orders = Views(spark, folder).table("orders")
    orders.write.parquet(f"{place}/orders.parquet")
    orders.where("o_orderstatus = 'P'").write.parquet(f"{place}/orders_copy.parquet")
    registry = Registry.from_config({"datasources": [{"name": "shop", "type": "parquet", "path": place}]})
    policy = Policy(allowed_sources=("shop",), writable_tables=("shop.orders_copy",))
    session = GuardedSession(spark, registry, "shop", ["orders", "orders_copy"], policy)
    result = session.run(INSERT)
    if result.df is None:
        raise RuntimeError(result.error)
    held = spark.read.parquet(f"{place}/orders_copy.parquet").agg(F.count("*").alias("held"), F.sum("o_orderkey").alias("keys"))
    return held.withColumn("affected_rows", F.lit(result.df.first()["affected_rows"]))


def sql_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The audit trail of a script that was run twice under one name."""
    trail = work_dir(spark, "trail")
    registry = Registry.from_config({"datasources": [{"name": "lake", "type": "parquet", "path": folder}]})
    session = GuardedSession(spark, registry, "lake", ["orders"], Policy(allowed_sources=("lake",)), trail)
    for _ in range(2):
        session.run_batch(SCRIPT, "nightly")
    return spark.read.parquet(trail).select("statement_id", "db", "rows", "sql", "preview")


def sql_batch(spark: SparkSession, folder: str) -> DataFrame:
    """What became of every statement of a script."""
    results = _session(spark, folder, ["orders"]).run_batch(SCRIPT)
    rows = [(i, r.code, r.rows, r.truncated, ",".join(r.columns)) for i, r in enumerate(results)]
    return spark.createDataFrame(rows, "pos bigint, code bigint, found bigint, truncated boolean, columns string")


QUERIES = {
    f.__name__: f
    for f in [
        audit_read_only, audit_multi, audit_table_refs, audit_tables_allowed, tables_not_allowed, audit_writable,
        audit_procedures, audit_row_cap, audit_length, audit_rewrite, audit_verdicts, audit_verdict_counts, split_statements,
        audit_rows, csv_lines, csv_export, guarded_append, capped_rows, sql_batch, sql_insert, sql_audit, *map(_guarded, GUARDED),
    ]
}

_KIND = "(SELECT *, stmt_id % 8 AS k FROM {sql_audit})"
_REFS = """(SELECT stmt_id, unnest(regexp_extract_all(stmt, '(?i)\\b(?:FROM|JOIN|INTO|UPDATE|TABLE)\\s+["\\[]?([A-Za-z0-9_$.]+)', 1)) AS table_name FROM {sql_audit})"""
_LABEL = """CASE p_partkey % 5 WHEN 0 THEN concat(p_name, ', "', p_brand, '"') WHEN 1 THEN concat(p_name, chr(10), p_brand) WHEN 2 THEN concat('  ', p_name, ' ') WHEN 3 THEN p_name END"""
_SCRIPT_TAIL = "chr(59) || chr(10) || ' SELECT '';;'' AS x, \";\" AS y ;  ; -- done' || chr(10) || '; SELECT 2 '"

_VERDICT = """CASE WHEN db = 'private' THEN '403 source not allowed' WHEN db = 'ghost' THEN '404 unknown source'
 WHEN k IN (4) THEN '403 several statements' WHEN k = 3 THEN '403 several statements'
 WHEN k = 5 AND db <> 'shop' THEN '403 procedure not allowed'
 WHEN k = 2 AND db NOT IN ('crm', 'shop') THEN '403 not writable'
 WHEN k = 7 AND db <> 'crm' THEN '403 not writable'
 WHEN k = 1 AND cap > 10000 THEN '400 row limit too high' ELSE '200 ok' END"""
_JUDGED = f"""(SELECT stmt_id, CAST(v[1:3] AS INT) AS code, v[5:] AS detail FROM (SELECT stmt_id, {_VERDICT} AS v
 FROM (SELECT *, stmt_id % 8 AS k, CAST(nullif(regexp_extract(stmt, 'LIMIT (\\d+)', 1), '') AS BIGINT) AS cap FROM {{sql_audit}})))"""

ORACLES = {
    "audit_read_only": f"SELECT stmt_id, k IN (0, 1, 3, 4, 6) AS read_only FROM {_KIND}",
    "audit_multi": f"SELECT stmt_id, k IN (3, 4) AS multi FROM {_KIND}",
    "audit_table_refs": f"SELECT table_name, count(*) AS mentions FROM {_REFS} GROUP BY table_name",
    "audit_tables_allowed": f"SELECT stmt_id, k NOT IN (1, 2, 4) AS allowed FROM {_KIND}",
    "tables_not_allowed": f"SELECT stmt_id, table_name FROM {_REFS} WHERE table_name NOT IN ('orders', 't', 'b') AND regexp_replace(table_name, '^[^.]*\\.', '') NOT IN ('orders', 't', 'b')",
    "audit_writable": f"""SELECT stmt_id, db, CASE k WHEN 0 THEN FALSE WHEN 1 THEN db = 'crm' WHEN 2 THEN db IN ('crm', 'shop') WHEN 3 THEN db = 'crm' WHEN 4 THEN db = 'crm'
 WHEN 5 THEN FALSE WHEN 6 THEN db = 'crm' ELSE db = 'crm' END AS writable FROM {_KIND}""",
    "audit_procedures": f"""SELECT stmt_id, k = 5 AS call, CASE WHEN k = 5 THEN concat(db, '.pkg.refresh') END AS procedure_name, k = 5 AND db = 'shop' AS executable FROM {_KIND}""",
    "audit_row_cap": f"""WITH c AS (SELECT stmt_id, CASE k WHEN 1 THEN CAST(regexp_extract(stmt, 'LIMIT (\\d+)', 1) AS BIGINT) WHEN 6 THEN 50 ELSE 100 END AS cap FROM {_KIND})
 SELECT stmt_id, cap, cap > 10000 AS too_high FROM c""",
    "audit_length": "SELECT stmt_id, length(stmt) > 38 AS too_long FROM {sql_audit}",
    "audit_rewrite": f"""WITH b AS (SELECT stmt_id, k, rtrim(stmt, ';') AS s FROM {_KIND})
 SELECT stmt_id, CASE WHEN k IN (1, 6) THEN s ELSE s || ' LIMIT 100' END AS as_mysql, CASE WHEN k IN (1, 6) THEN s ELSE s || ' FETCH FIRST 100 ROWS ONLY' END AS as_fetch,
 CASE WHEN k IN (1, 6) THEN s ELSE concat('SELECT * FROM (', s, ') WHERE ROWNUM <= 100') END AS as_rownum FROM b""",
    "audit_verdicts": f"SELECT * FROM {_JUDGED}",
    "audit_verdict_counts": f"SELECT code, detail, count(*) AS statements FROM {_JUDGED} GROUP BY code, detail",
    "split_statements": f"""WITH s AS (SELECT stmt_id, regexp_extract_all(stmt || {_SCRIPT_TAIL}, '([^;''"]|''[^'']*''|"[^"]*")+;?|;') AS raw FROM {{sql_audit}}),
 t AS (SELECT stmt_id, list_filter(list_transform(raw, lambda x: trim(x, chr(10) || ' ')), lambda x: x <> '' AND NOT starts_with(x, '--')) AS pieces FROM s)
 SELECT stmt_id, CAST(generate_subscripts(pieces, 1) - 1 AS INT) AS pos, unnest(pieces) AS piece FROM t""",
    "audit_rows": """SELECT stmt_id + 1700000000000 AS at, db, stmt_id % 100 AS rows, stmt_id % 977 AS cost_ms, concat(stmt, ' ', repeat('/* padding */', 16)) AS sql,
 substr(concat(stmt, ' ', repeat('/* padding */', 16)), 1, 200) AS preview FROM {sql_audit}""",
    "csv_lines": f"""WITH p AS (SELECT *, {_LABEL} AS label FROM part)
 SELECT p_partkey, concat(p_partkey, ',', CASE WHEN label IS NULL THEN '' WHEN regexp_matches(label, '[",\\n\\r]') THEN concat('"', replace(label, '"', '""'), '"') ELSE label END, ',', p_size, ',',
 CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END) AS line FROM p""",
    "csv_export": f"SELECT p_partkey, {_LABEL} AS label, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part",
    "guarded_append": "SELECT count(*) AS affected_rows FROM orders",
    "capped_rows": """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, (SELECT count(*) FROM lineitem) > 500 AS truncated FROM lineitem
 ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity LIMIT 500""",
    "sql_batch": """WITH c AS (SELECT count(*) AS n FROM orders) SELECT CAST(pos AS BIGINT) AS pos, CAST(code AS BIGINT) AS code, found, truncated, columns FROM (
 SELECT 0 AS pos, 200 AS code, CAST(1 AS BIGINT) AS found, FALSE AS truncated, 'n' AS columns UNION ALL SELECT 1, 403, 0, FALSE, ''
 UNION ALL SELECT 2, 200, least(n, 100), n > 100, 'o_orderkey' FROM c UNION ALL SELECT 3, 502, 0, FALSE, ''
 UNION ALL SELECT 4, 403, 0, FALSE, '')""",
    "sql_insert": """SELECT count(*) FILTER (o_orderstatus = 'F') AS affected_rows, count(*) FILTER (o_orderstatus IN ('F', 'P')) AS held,
 CAST(sum(o_orderkey) FILTER (o_orderstatus IN ('F', 'P')) AS BIGINT) AS keys FROM orders""",
    "sql_audit": """SELECT 'nightly:' || pos AS statement_id, 'lake' AS db, rows, sql, sql AS preview FROM (
 SELECT 0 AS pos, CAST(1 AS BIGINT) AS rows, 'SELECT count(*) AS n FROM orders WHERE o_orderstatus = ''F'';' AS sql
 UNION ALL SELECT 2, (SELECT least(count(*), 100) FROM orders), 'SELECT o_orderkey FROM orders ORDER BY o_orderkey;')""",
    **{name: text for name, text in GUARDED.items()},
    "sql_guarded": "SELECT l_orderkey, l_linenumber, l_partkey, (SELECT count(*) FROM lineitem) > 100 AS truncated FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 100",
}
ORACLES = {name: sql(text) for name, text in ORACLES.items()}

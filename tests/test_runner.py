"""Governed SQL end to end."""

import pytest

from fleetlens.governance.policy import Policy
from fleetlens.governance.runner import GuardedSession, audit_of, run_batch, run_sql
from fleetlens.sources.registry import Registry

TABLES = ["orders", "lineitem", "nation", "region"]


@pytest.fixture
def registry(tables):
    return Registry.from_config({"datasources": [{"name": "lake", "type": "parquet", "path": tables}]})


@pytest.fixture
def guarded(spark, registry):
    policy = Policy(allowed_sources=("lake",), allowed_tables=("orders", "nation"), max_limit=1000)
    return GuardedSession(spark, registry, "lake", TABLES, policy)


def test_default_cap_and_truncation(guarded):
    result = guarded.run("SELECT o_orderkey FROM orders;")
    assert (result.code, result.rows, result.truncated, result.columns) == (200, 100, True, ["o_orderkey"])
    assert result.cost_ms >= 0
    small = guarded.run("SELECT n_name FROM nation")
    assert (small.rows, small.truncated) == (25, False)


def test_stated_caps(guarded):
    assert guarded.run("SELECT * FROM orders LIMIT 500").rows == 500
    assert guarded.run("SELECT * FROM orders WHERE ROWNUM <= 7").rows == 7
    assert guarded.run("SELECT * FROM orders ORDER BY o_orderkey FETCH FIRST 3 ROWS ONLY").rows == 3
    over = guarded.run("SELECT * FROM orders LIMIT 1001")
    assert (over.code, over.df) == (400, None)
    assert guarded.run("SELECT * FROM (SELECT * FROM orders LIMIT 800) x").rows == 100
    assert guarded.run("SELECT 'LIMIT 2000' AS t FROM nation").rows == 25


def test_empty_results_keep_their_columns(guarded):
    result = guarded.run("SELECT n_name, n_nationkey FROM nation WHERE 1 = 0")
    assert (result.rows, result.columns) == (0, ["n_name", "n_nationkey"])


@pytest.mark.parametrize(
    "sql, code",
    [
        ("INSERT INTO orders SELECT * FROM orders", 403),
        ("DROP TABLE orders", 403),
        ("CALL p()", 403),
        ("SELECT 1; SELECT 2", 403),
        ("WITH a AS (SELECT 1) INSERT INTO orders SELECT * FROM orders", 502),
        ("SELECT * FROM lineitem", 502),
        ("SELECT * FROM nation, lineitem", 502),
        ("SELECT * FROM `lineitem`", 502),
        ("SELECT * FROM parquet.`/root/testdata/sf0.001/lineitem.parquet`", 502),
        ("SELECT * FROM default.orders", 403),
        ("SELECT * FROM spark_catalog.default.orders", 403),
        ("SELECT * FROM IDENTIFIER('lineitem')", 403),
        ("SELECT reflect('java.lang.System', 'getProperty', 'user.home')", 403),
        ("SELECT nothing FROM orders", 502),
        ("SELECT (", 502),
        ("", 403),
    ],
)
def test_refusals(guarded, sql, code):
    result = guarded.run(sql)
    assert (result.code, result.df) == (code, None) and result.error


def test_stored_tables_are_out_of_reach(spark, registry):
    spark.sql("CREATE OR REPLACE TEMP VIEW local_view AS SELECT 1 AS a")
    policy = Policy()
    session = GuardedSession(spark, registry, "lake", TABLES, policy)
    assert session.run("SELECT * FROM local_view").code == 502
    spark.sql("CREATE TABLE IF NOT EXISTS stored_secret (a INT) USING parquet")
    try:
        assert session.run("SELECT * FROM stored_secret").code == 403
    finally:
        spark.sql("DROP TABLE stored_secret")


def test_commands_run_as_they_are(guarded):
    described = guarded.run("DESCRIBE nation")
    guarded.run("SELECT n_name FROM nation")
    described = guarded.run("DESCRIBE nation")
    assert described.code == 200 and [r.col_name for r in described.df.collect()] == ["n_nationkey", "n_name", "n_regionkey"]
    assert guarded.run("EXPLAIN SELECT n_name FROM nation").rows == 1
    assert guarded.run("SHOW TABLES").code == 200


def test_sources(spark, registry):
    policy = Policy(allowed_sources=("lake", "ghost"))
    assert run_sql(spark, registry, "other", "SELECT 1", policy, TABLES).code == 403
    assert run_sql(spark, registry, "ghost", "SELECT 1", policy, TABLES).code == 404
    assert run_sql(spark, registry, "lake", "SELECT 1", Policy(max_sql_chars=5), TABLES).code == 400
    assert run_sql(spark, registry, "lake", "SELECT 1", policy, TABLES).rows == 1


def test_batches_go_on_after_an_error(spark, registry):
    script = "SELECT 1 AS a; SELECT broken FROM nation;\n-- skipped\nSELECT 9; SELECT ';' AS b FROM nation LIMIT 2;"
    results = run_batch(spark, registry, "lake", script, Policy(), TABLES)
    assert [r.code for r in results] == [200, 502, 403]
    assert results[2].sql == "SELECT ';' AS b FROM nation LIMIT 2;"
    audit = audit_of(spark, results).collect()
    assert [(r.db, r.rows, r.sql) for r in audit] == [("lake", 1, "SELECT 1 AS a;")]


def test_slow_queries_are_stopped(spark, registry):
    sql = "SELECT count(*) AS n FROM range(900000000000000) WHERE id % 7 = 3"
    result = run_sql(spark, registry, "lake", sql, Policy(query_timeout=2), TABLES)
    assert (result.code, result.error) == (504, "query timed out") and result.cost_ms < 60_000


@pytest.fixture
def shop(spark, tables, folder):
    """A source of its own whose orders take rows."""
    spark.read.parquet(f"{tables}/orders.parquet").where("o_orderkey % 2 = 0").write.parquet(f"{folder}/orders.parquet")
    spark.read.parquet(f"{tables}/nation.parquet").write.parquet(f"{folder}/nation.parquet")
    registry = Registry.from_config({"datasources": [{"name": "shop", "service": "shopdb", "type": "parquet", "path": folder}, {"name": "crm", "type": "mysql"}]})
    policy = Policy(allowed_tables=("orders", "nation"), writable_tables=("shop.orders", "crm.*"))
    return GuardedSession(spark, registry, "shop", ["orders", "nation", "region"], policy, f"{folder}/audit")


def test_inserts_into_permitted_tables(shop):
    count = lambda: shop.run("SELECT count(*) AS n FROM orders").df.first().n
    before = count()
    result = shop.run("INSERT INTO orders SELECT * FROM orders WHERE o_orderkey % 10 = 0;")
    added = result.df.first().affected_rows
    assert (result.code, result.rows, result.columns, result.truncated) == (200, 1, ["affected_rows"], False) and 0 < added < before
    assert count() == before + added
    assert shop.run("INSERT INTO shopdb.orders (o_orderkey, o_orderpriority) VALUES (-1, 'a b'), (-2, NULL)").df.first().affected_rows == 2
    assert shop.run("insert into shop.orders(O_ORDERKEY) WITH k AS (SELECT n_nationkey - 100 AS x FROM nation) SELECT x FROM k").df.first().affected_rows == 25
    rows = shop.run("SELECT o_orderkey, o_orderpriority, o_custkey FROM orders WHERE o_orderkey < 0 ORDER BY 1 DESC LIMIT 2").df.collect()
    assert [tuple(r) for r in rows] == [(-1, "a b", None), (-2, None, None)]


@pytest.mark.parametrize(
    "sql, code",
    [
        ("INSERT INTO nation SELECT * FROM nation", 403),
        ("INSERT INTO orders SELECT * FROM default.orders", 403),
        ("INSERT INTO orders (o_orderkey) SELECT r_regionkey FROM region", 502),
        ("INSERT INTO lake.orders SELECT * FROM orders", 403),
        ("INSERT INTO crm.orders SELECT * FROM orders", 403),
        ("INSERT OVERWRITE orders SELECT * FROM orders", 403),
        ("INSERT INTO orders SELECT o_orderkey FROM orders", 502),
        ("INSERT INTO orders (o_orderkey, o_orderkey) SELECT 1, 2", 502),
        ("INSERT INTO orders (o_orderkey) SELECT 'x'", 502),
        ("INSERT INTO orders (o_orderkey) SELECT 1; DROP TABLE orders", 403),
        ("INSERT INTO orders (o_orderpriority) SELECT java_method('java.lang.System', 'getProperty', 'user.home')", 403),
        ("UPDATE orders SET o_orderpriority = ''", 403),
        ("DELETE FROM orders WHERE o_orderkey = 1", 403),
        ("DELETE FROM orders", 403),
        ("TRUNCATE TABLE orders", 403),
    ],
)
def test_writes_that_are_refused(shop, sql, code):
    result = shop.run(sql)
    assert (result.code, result.df) == (code, None) and result.error
    assert shop.run("SELECT count(*) AS n FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey IS NULL").df.first().n == 0


@pytest.fixture
def secret(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS hidden")
    spark.sql("CREATE TABLE IF NOT EXISTS hidden.vault (pin INT) USING parquet")
    spark.sql("CREATE TABLE IF NOT EXISTS stored_vault (pin INT) USING parquet")
    yield
    spark.sql("DROP TABLE stored_vault")
    spark.sql("DROP DATABASE hidden CASCADE")


@pytest.mark.parametrize(
    "sql",
    [
        "SHOW TABLES IN hidden", "SHOW TABLES FROM hidden LIKE 'v*'", "SHOW TABLE EXTENDED IN hidden LIKE '*'", "SHOW COLUMNS IN vault IN hidden",
        "SHOW COLUMNS IN hidden.vault", "SHOW COLUMNS IN stored_vault", "DESCRIBE hidden.vault", "DESC TABLE EXTENDED hidden.vault", "DESCRIBE stored_vault",
        "DESCRIBE hidden.vault pin", "SHOW CREATE TABLE hidden.vault", "SHOW DATABASES", "SHOW CATALOGS", "SHOW VIEWS IN hidden", "SHOW PARTITIONS hidden.vault",
        "DESCRIBE DATABASE hidden", "EXPLAIN SELECT * FROM hidden.vault", "EXPLAIN EXTENDED SELECT * FROM stored_vault", "DESCRIBE QUERY SELECT * FROM stored_vault",
        "SELECT * FROM hidden.vault", "SELECT * FROM stored_vault", "SELECT (SELECT max(pin) FROM stored_vault)", "WITH a AS (SELECT * FROM stored_vault) SELECT 1 FROM a",
        "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT pin FROM stored_vault)", "SELECT * FROM later.db.vault", "SELECT * FROM later.vault",
        "DESCRIBE later.vault", "SHOW TABLES IN later", "SELECT * FROM IDENTIFIER('stored_' || 'vault')", "EXPLAIN DELETE FROM hidden.vault",
    ],
)
def test_nothing_is_told_of_what_is_stored(guarded, secret, sql):
    # a catalogue that is configured but not loaded yet
    guarded.session.conf.set("spark.sql.catalog.later", "no.such.Catalog")
    result = guarded.run(sql)
    assert (result.code, result.df) == (403, None)


def test_commands_about_permitted_tables(guarded):
    shown = guarded.run("SHOW TABLES").df
    assert [r.tableName for r in shown.collect()] == ["nation", "orders"]
    assert [r[0] for r in guarded.run("SHOW COLUMNS IN nation").df.collect()] == ["n_nationkey", "n_name", "n_regionkey"]
    assert guarded.run("DESCRIBE QUERY SELECT n_name FROM nation").df.first().col_name == "n_name"
    assert guarded.run("SELECT x FROM (WITH a AS (SELECT n_nationkey AS x FROM nation) SELECT x FROM a) WHERE x IN (SELECT o_custkey FROM orders)").code == 200


def test_the_runner_keeps_the_audit(spark, shop, folder):
    trail = lambda: sorted((r.statement_id, r.db, r.rows, r.sql) for r in spark.read.parquet(f"{folder}/audit").collect())
    script = "SELECT 1 AS a; SELECT nothing FROM orders; INSERT INTO orders (o_orderkey) VALUES (-5);"
    assert [r.code for r in shop.run_batch(script, "night-1")] == [200, 502, 200]
    first = trail()
    assert [r[:3] for r in first] == [("night-1:0", "shop", 1), ("night-1:2", "shop", 1)]
    shop.run_batch(script, "night-1")
    assert trail() == first
    shop.run_batch("SELECT 2 AS b", "night-2")
    shop.run_batch("SELECT 2 AS b")
    shop.run_batch("SELECT 2 AS b")
    assert len(trail()) == 5

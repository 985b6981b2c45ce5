"""Running SQL under a policy.

Spark parses, resolves and runs the statements. What is added here is who may name what, which
tables take rows, how many rows come back, how long it may take, and the audit trail.
"""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens import fixed
from fleetlens.governance.checks import statement_body, verdict
from fleetlens.governance.names import Insert, dynamic_names, insert_of, kind, parse, relations, resolve, written_names
from fleetlens.governance.policy import Policy
from fleetlens.governance.rowcap import normalise_limit
from fleetlens.governance.split import split_statements
from fleetlens.operators.paging import RowLimitExceeded, first_rows, permitted_cap
from fleetlens.sinks.append import append_counted, fitted, is_target_writable
from fleetlens.sinks.audit import AUDIT, append_once
from fleetlens.sources.registry import Registry, UnknownSource

#: Commands that tell something about one table, and what they may be asked about is checked.
ABOUT_TABLES = ("ShowColumns", "DescribeRelation", "DescribeColumn")

_QUOTED = re.compile(r"'(?:[^'\\]|\\.|'')*+'?|\"(?:[^\"\\]|\\.)*+\"?|--[^\n]*|/\*.*?(?:\*/|\Z)", re.DOTALL)
_READING = re.compile(r"\s*(?:SELECT|SHOW|DESC|DESCRIBE|EXPLAIN|WITH)\b", re.IGNORECASE)
_REACHING_OUT = re.compile(r"\b(?:reflect|try_reflect|java_method)\s*\(", re.IGNORECASE)


class Refused(ValueError):
    """A statement the policy does not let through."""

    def __init__(self, code: int, detail: str):
        super().__init__(detail)
        self.code = code


@dataclass(frozen=True)
class Result:
    """Outcome of one statement; ``df`` is missing exactly when there is an ``error``."""

    source: str
    sql: str
    df: DataFrame | None
    rows: int
    truncated: bool
    cost_ms: int
    code: int = 200
    error: str | None = None

    @property
    def columns(self) -> list[str]:
        return self.df.columns if self.df is not None else []


class GuardedSession:
    """A session of its own in which only a source's permitted tables exist."""

    def __init__(
        self,
        spark: SparkSession,
        registry: Registry,
        source: str,
        tables: Iterable[str],
        policy: Policy,
        audit: str | None = None,
    ):
        self.registry, self.source, self.policy, self.audit = registry, source, policy, audit
        self.session = spark.newSession()
        self.session.conf.set("spark.sql.runSQLOnFiles", "false")
        self.tables = [t for t in tables if policy.table_allowed(t)]
        self._opened: set[str] = set()

    def _open_tables(self, sql: str) -> None:
        """Makes the permitted tables a statement could mean known to the session."""
        words = set(re.findall(r"\w+", sql.lower()))
        for table in self.tables:
            if table.lower() in words and table not in self._opened:
                self.registry.open(self.session, self.source, table).createOrReplaceTempView(table)
                self._opened.add(table)

    def _judge(self, sql: str) -> str:
        """The statement's body, if its text passes the policy."""
        services = {name: s.service for name, s in self.registry.sources.items()}
        one = self.session.sql("SELECT :sql AS stmt, :source AS db", args={"sql": sql, "source": self.source})
        outcome = verdict(F.col("stmt"), F.col("db"), self._text_policy(), services)
        judged = one.select(outcome.alias("v"), statement_body(F.col("stmt")).alias("body")).first()
        if judged["v"]["code"] != 200:
            raise Refused(judged["v"]["code"], judged["v"]["detail"])
        return judged["body"]

    def _text_policy(self) -> Policy:
        """The policy for the text checks: tables and the cap are checked by Spark's own reading."""
        kept = {"allowed_tables": (), "max_limit": (1 << 63) - 1}
        return Policy(**{**vars(self.policy), **kept})

    def _check_names(self, plan) -> None:
        """Refuses names that point out of the session before Spark looks them up, as a catalogue is loaded for that."""
        if dynamic_names(plan):
            raise Refused(403, "names cannot be worked out")
        places = {d.name.lower() for d in self.session.catalog.listDatabases()}
        places |= {c.name.lower() for c in self.session.catalog.listCatalogs()} | {"global_temp"}
        for *place, table in written_names(plan):
            catalogue = place and self.session.conf.get(f"spark.sql.catalog.{place[0]}", None)
            if len(place) > 1 or catalogue or place and place[0].lower() in places:
                raise Refused(403, f"{'.'.join([*place, table])} is out of reach")

    def _check_reads(self, plan) -> None:
        """Refuses a statement that resolves to anything stored but the permitted tables."""
        views, stored = relations(resolve(self.session, plan))
        if stored or views - {t.lower() for t in self._opened}:
            raise Refused(403, "table not allowed")

    def _command(self, plan, body: str) -> DataFrame:
        """A command that tells about permitted tables or explains a permitted query."""
        what = kind(plan)
        if what == "ShowTables" and not written_names(plan) and kind(plan.namespace()) in ("CurrentNamespace", "ResolvedNamespace") and plan.pattern().isEmpty():
            rows = [("", t, True) for t in sorted(self.tables)]
            return self.session.createDataFrame(rows, "namespace string, tableName string, isTemporary boolean")
        if what == "ExplainCommand":
            self._check_names(plan.logicalPlan())
            self._check_reads(plan.logicalPlan())
        elif what == "DescribeQueryCommand":
            self._check_names(plan.plan())
            self._check_reads(plan.plan())
        elif what in ABOUT_TABLES:
            own = {t.lower() for t in self._opened}
            names = written_names(plan)
            namespace = what == "ShowColumns" and plan.namespace().isDefined()
            if namespace or not names or any(len(n) > 1 or n[0].lower() not in own for n in names):
                raise Refused(403, "table not allowed")
        else:
            raise Refused(403, "command not allowed")
        return self.session.sql(body)

    def _rows(self, body: str) -> tuple[DataFrame, bool, int]:
        capped = normalise_limit(body)
        try:
            plan = parse(self.session, capped.text)
        except Py4JJavaError:
            plan = parse(self.session, body)
        self._check_names(plan)
        if plan.getClass().getName().startswith("org.apache.spark.sql.catalyst.plans.logical.Show") or kind(plan) in ABOUT_TABLES or kind(plan).endswith("Command") or kind(plan).startswith("Describe"):
            df, cap = self._command(plan, body), self.policy.max_limit
        else:
            cap = permitted_cap(capped.cap, self.policy.default_limit, self.policy.max_limit)
            # as a subquery Spark takes neither commands nor writes, in whatever disguise
            self.session.sql(f"SELECT * FROM (\n{capped.text}\n)")
            self._check_reads(plan)
            df = self.session.sql(capped.text)
        rows, more = first_rows(df, cap)
        return self.session.createDataFrame(rows, df.schema), more, len(rows)

    def _insert(self, insert: Insert) -> DataFrame:
        """Appends a query's rows to a permitted table of a file source and tells how many they were."""
        *place, table = insert.target
        here = self.registry.get(self.source)
        owner = here.name if not place or place == [here.service] else ".".join(place)
        if not is_target_writable(f"{owner}.{table}", self.policy):
            raise Refused(403, f"table '{'.'.join(insert.target)}' not writable")
        target = self.registry.get(owner)
        if target.type != "parquet":
            raise Refused(403, "rows are written to file sources only")
        plan = parse(self.session, insert.query)
        self._check_names(plan)
        self._open_tables(insert.query)
        self._check_reads(plan)
        stored = self.registry.open(self.session, owner, table)
        rows = fitted(self.session.sql(insert.query), stored.schema, insert.columns)
        written = append_counted(rows, f"{target.path.rstrip('/')}/{table}.parquet")
        # the files a view lists are those of the time it was made
        self._opened.discard(next((t for t in self._opened if t.lower() == table.lower()), table))
        return written

    def _insert_of(self, sql: str) -> Insert | None:
        """The INSERT a statement is, checked as its query would be."""
        text = sql.strip().rstrip(";").rstrip()
        if not re.match(r"INSERT\b", text, re.IGNORECASE):
            return None
        try:
            insert = insert_of(self.session, text)
        except PySparkException:
            return None
        if insert:
            self._judge(f"SELECT * FROM (\n{insert.query}\n)")
            if len(sql) > self.policy.max_sql_chars:
                raise Refused(400, f"SQL too long: {len(sql)} > {self.policy.max_sql_chars}")
            if _REACHING_OUT.search(_QUOTED.sub(" ", insert.query)):
                raise Refused(403, "function not allowed")
        return insert

    def _answer(self, sql: str) -> tuple[DataFrame, bool, int]:
        if insert := self._insert_of(sql):
            return self._insert(insert), False, 1
        body = self._judge(sql)
        if not _READING.match(_QUOTED.sub(" ", body)):
            raise Refused(403, "of writes, only a plain INSERT INTO is run")
        if _REACHING_OUT.search(_QUOTED.sub(" ", body)):
            raise Refused(403, "function not allowed")
        self._open_tables(body)
        return self._rows(body)

    def run(self, sql: str) -> Result:
        """Checks, runs and caps one statement; a failure is a result too."""
        began = time.monotonic()
        tag = f"guarded-{uuid.uuid4().hex}"
        expired = threading.Event()
        jobs = self.session.sparkContext

        def expire() -> None:
            expired.set()
            jobs.cancelJobsWithTag(tag)

        timer = threading.Timer(self.policy.query_timeout, expire)
        df, rows, truncated, code, error = None, 0, False, 200, None
        try:
            jobs.addJobTag(tag)
            timer.start()
            df, truncated, rows = self._answer(sql)
        except (Refused, RowLimitExceeded, UnknownSource) as refusal:
            code, error = refusal.code, str(refusal)
        except (PySparkException, Py4JJavaError) as failure:
            df = None
            code, error = (504, "query timed out") if expired.is_set() else (502, str(failure))
        finally:
            timer.cancel()
            jobs.removeJobTag(tag)
        cost = int((time.monotonic() - began) * 1000)
        return Result(self.source, sql, df, rows, truncated, cost, code, error)

    def run_batch(self, script: str, batch: str | None = None) -> list[Result]:
        """Every statement of a script in order; one that fails does not stop the next.

        ``batch`` names the run in the audit trail: a batch of that name run again leaves the trail as it is.
        """
        one = self.session.sql("SELECT :script AS s", args={"script": script})
        results = [self.run(sql) for sql in one.select(split_statements(F.col("s"))).first()[0]]
        if self.audit:
            append_once(audit_of(self.session, results, batch or uuid.uuid4().hex), self.audit, "statement_id")
        return results


def run_sql(
    spark: SparkSession, registry: Registry, source: str, sql: str, policy: Policy, tables: Iterable[str], audit: str | None = None
) -> Result:
    guarded = GuardedSession(spark, registry, source, tables, policy, audit)
    result = guarded.run(sql)
    if audit:
        append_once(audit_of(guarded.session, [result], uuid.uuid4().hex), audit, "statement_id")
    return result


def run_batch(
    spark: SparkSession,
    registry: Registry,
    source: str,
    script: str,
    policy: Policy,
    tables: Iterable[str],
    audit: str | None = None,
    batch: str | None = None,
) -> list[Result]:
    return GuardedSession(spark, registry, source, tables, policy, audit).run_batch(script, batch)


def audit_of(spark: SparkSession, results: list[Result], batch: str | None = None) -> DataFrame:
    """Audit rows of the statements that ran; with ``batch``, each under a name of its own in that batch."""
    now = time.time()
    rows = [
        (int(now * 1000), r.source, r.rows, r.cost_ms, r.sql, r.sql[: fixed.AUDIT_SQL_CHARS], f"{batch}:{i}")
        for i, r in enumerate(results)
        if r.error is None
    ]
    named = spark.createDataFrame(rows, f"{AUDIT}, statement_id string")
    return named if batch else named.drop("statement_id")

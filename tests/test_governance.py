"""Statement checks: a truth table, and models written apart from the patterns."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens import fixed
from fleetlens.governance import checks
from fleetlens.governance.policy import Policy
from fleetlens.governance.rowcap import normalise_limit
from fleetlens.governance.split import PIECE, split_statements


def each(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = dict(df.select("i", make(F.col("s"))).collect())
    return [got[i] for i in range(len(texts))]


READS = [
    "select 1", "  SELECT 1", "show tables", "DESC t", "describe t", "explain select 1", "with a as (select 1) select 1",
    "-- c\nselect 1", "/* c */ select 1", "/* a */ -- b\n /* c */\n select 1", "-- a\n-- b\n\tSELECT 1", "select(1)", "　select 1",
    "/* a */ stray */ select 1", "WITH x INSERT INTO t SELECT 1",
]
OTHERS = [
    "", "  ", "insert into t values (1)", "selected", "-- only a comment", "-- c select 1", "/* open select 1", "update t set a = 1",
    "delete from t", "(select 1)", "call p()", "; select 1", "select_1", "/* a */ insert into t select 1", "/*/ select 1",
]


def test_read_only(spark):
    assert each(spark, READS, checks.is_read_only) == [True] * len(READS)
    assert each(spark, OTHERS, checks.is_read_only) == [False] * len(OTHERS)


def reads(text):
    """Read-only by trying every possible end of every leading comment."""
    text = text.lstrip()
    for word in fixed.READ_ONLY_WORDS:
        rest = text[len(word) :]
        if text[: len(word)].upper() == word and not (rest[:1].isalnum() or rest[:1] == "_"):
            return True
    if text.startswith("--"):
        return "\n" in text and reads(text.split("\n", 1)[1])
    if text.startswith("/*"):
        ends = [i for i in range(2, len(text) - 1) if text[i : i + 2] == "*/"]
        return any(reads(text[i + 2 :]) for i in ends)
    return False


def test_read_only_against_the_model(spark):
    rng = random.Random(7)
    bits = ["--", "\n", "/*", "*/", " ", "select", "SELECT", "x", "insert", "with", "/", "*", "-", "_"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    assert each(spark, texts, checks.is_read_only) == [reads(t) for t in texts]


def test_read_only_survives_many_comments(spark):
    texts = ["-- c\n" * 50_000 + "select 1", "/* c */ " * 20_000 + "select 1", "-- c\n" * 50_000 + "drop", " " * 300_000]
    assert each(spark, texts, checks.is_read_only) == [True, True, False, False]


def test_multi(spark):
    yes = ["select 1; select 2", "select ';'", "a;b;", "select 1; ;", ";;x;"]
    no = ["select 1", "select 1;", "select 1;;; ", " select 1 ; ", "", ";"]
    assert each(spark, yes, checks.is_multi) == [True] * len(yes)
    assert each(spark, no, checks.is_multi) == [False] * len(no)


def test_table_refs(spark):
    texts = [
        'select * from a.b JOIN "c" on 1=1', "insert INTO [d] select * from e", "update f set x = 1", "drop table g",
        "select fromage from h, i", "select * from `j`", "delete from  k\n where 1=1", "select 1", "truncate table t$1.x_2",
    ]
    assert each(spark, texts, checks.table_refs) == [["a.b", "c"], ["d", "e"], ["f"], ["g"], ["h"], [], ["k"], [], ["t$1.x_2"]]


def test_tables_allowed(spark):
    texts = ["select * from shop.orders", "select * from orders", "select * from x.y.orders", "select * from a join orders", "select 1"]
    assert each(spark, texts, lambda c: checks.tables_allowed(c, ["orders"])) == [True, True, False, False, True]
    assert each(spark, texts, lambda c: checks.tables_allowed(c, ["y.orders", "a", "orders"])) == [True] * 5
    assert each(spark, texts, lambda c: checks.tables_allowed(c, [])) == [True] * 5


def test_disallowed_tables(spark):
    refs = spark.createDataFrame([(1, "shop.orders"), (1, "t"), (2, "x.t"), (3, "z"), (4, "x.y.t")], "s int, table_name string")
    allowed = spark.createDataFrame([("orders",), ("x.t",), ("t",), ("t",)], "name string")
    for given in (allowed, ["orders", "x.t", "t"]):
        got = sorted(tuple(r) for r in checks.disallowed_tables(refs, given).collect())
        assert got == [(3, "z"), (4, "x.y.t")]
    assert checks.disallowed_tables(refs, []).count() == 5


def test_writable(spark):
    texts = ["insert into t values (1)", "update real.t set a = 1", "update other.t set a = 1", "insert into t select * from u", "insert into u values (1)", "values (1)", "delete from real.u"]

    def judge(writable):
        return each(spark, texts, lambda c: checks.is_writable(c, F.lit("src"), F.lit("real"), writable))

    assert judge(["src.*"]) == [True, True, False, True, True, False, True]
    assert judge(["src.t"]) == [True, True, False, False, False, False, False]
    assert judge(["other.t"]) == [False, False, True, False, False, False, False]
    assert judge([]) == [False] * 7


def test_procedures(spark):
    texts = ["CALL p()", " exec pkg.p", "begin src.p; end;", "call src.pkg.p()", "call a.b.c", "select 1", "BEGIN pkg.p. ; end", "callp()", "BEGIN"]
    want = ["src.p", "src.pkg.p", "src.p", "src.pkg.p", "a.b.c", None, "src.pkg.p", None, None]
    assert each(spark, texts, lambda c: checks.procedure_ref(c, F.lit("src"))) == want
    assert each(spark, texts, checks.is_procedure) == [True, True, True, True, True, False, True, False, True]
    assert each(spark, texts, lambda c: checks.is_executable(c, F.lit("src"), ["src.p"]))[:4] == [True, False, True, False]


def test_row_cap(spark):
    texts = [
        "select 1", "select 1 limit 5", "x LIMIT 5, 10", "fetch first 7 rows only", "where ROWNUM<9", "where rownum <= 9",
        "select 'limit 3'", "limit 99999999999999999999999", "a limit 20 fetch first 3 rows", "limit n",
    ]
    want = [None, 5, 5, 7, 9, 9, 3, checks.UNLIMITED, 20, None]
    assert each(spark, texts, checks.stated_cap) == want
    assert each(spark, texts, checks.row_cap)[0] == 100
    assert each(spark, texts, checks.cap_too_high) == [False] * 7 + [True, False, False]


def test_length_counts_characters(spark):
    assert each(spark, ["é" * 5, "é" * 6], lambda c: checks.too_long(c, 5)) == [False, True]


def test_rewrite(spark):
    texts = ["select 1 ; ", "select 1 limit 3;"]

    def rewritten(mode):
        return each(spark, texts, lambda c: checks.with_row_cap(c, mode, 10))

    assert rewritten("mysql") == ["select 1 LIMIT 10", "select 1 limit 3"]
    assert rewritten("fetch")[0] == "select 1 FETCH FIRST 10 ROWS ONLY"
    assert rewritten("rownum")[0] == "SELECT * FROM (select 1) WHERE ROWNUM <= 10"
    sources = [("oracle", "fetch", None), ("mysql", "", None), ("oracle", "", 11), ("oracle", None, 12), ("oracle", "", None)]
    mode = checks.cap_spelling(F.col("engine"), F.col("configured"), F.col("major"))
    rows = spark.createDataFrame(sources, "engine string, configured string, major int").coalesce(1)
    got = rows.select(mode.alias("mode"), checks.with_row_cap(F.lit("select 1"), mode, 10).alias("text")).collect()
    assert [r.mode for r in got] == ["fetch", "mysql", "rownum", "fetch", "rownum"]
    assert [r.text for r in got] == [rewritten(r.mode)[0] for r in got]


@pytest.mark.parametrize("text, cap", [("x limit 7", 7), ("fetch  first 8 rows", 8), ("ROWNUM<9", 9), ("rownum <= 5 limit 6", 5), ("limit 99999999999999999999", checks.UNLIMITED), ("limits 4", None)])
def test_stated_caps(spark, text, cap):
    assert each(spark, [text], checks.stated_cap) == [cap]


SPLITS = [
    ("a;b", ["a;", "b"]),
    (" a ; ; b ", ["a ;", ";", "b"]),
    ("select ';' ; x", ["select ';' ;", "x"]),
    ("select 'it''s;' ; x", ["select 'it''s;' ;", "x"]),
    ('select ";" ; x', ['select ";" ;', "x"]),
    ("a -- ;\n; b", ["a -- ;\n;", "b"]),
    ("a /* ; */ ; b", ["a /* ; */ ;", "b"]),
    ("-- c;\nselect 1; b", ["b"]),
    ("/* c */ select 1; b", ["b"]),
    ("a 'open ; b", ["a 'open ; b"]),
    ("a /* open ; b", ["a /* open ; b"]),
    ("a - b / c; d", ["a - b / c;", "d"]),
    ("a /*/ ; */ b", ["a /*/ ; */ b"]),
    ("", []),
    (" \n ", []),
    (";", [";"]),
]


def test_split(spark):
    assert each(spark, [t for t, _ in SPLITS], split_statements) == [w for _, w in SPLITS]


def test_split_loses_nothing(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab;'\"-/*\n ") for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    pieces = each(spark, texts, lambda c: F.regexp_extract_all(c, F.lit(PIECE), F.lit(0)))
    assert ["".join(p) for p in pieces] == texts
    assert all(p.endswith(";") for ps in pieces for p in ps[:-1])


def test_split_of_long_scripts(spark):
    text = "select '" + "x;" * 60_000 + "' ; /* " + "y;" * 60_000 + "*/ z ;" + "w" * 100_000
    assert [len(p) for p in each(spark, [text], split_statements)[0]] == [120_000 + 11, 100_000]


POLICY = Policy(
    allowed_sources=("src", "ghost"),
    allowed_tables=("t", "u"),
    writable_tables=("src.t",),
    procedures=("src.p",),
    max_limit=1000,
    max_sql_chars=80,
)
VERDICTS = [
    ("src", "x" * 81, 400, "too long"),
    ("away", "x" * 81, 400, "too long"),
    ("away", "select 1", 403, "source not allowed"),
    ("ghost", "select 1", 404, "unknown source"),
    ("src", "select 1; select 2", 403, "several statements"),
    ("src", "call p()", 200, "ok"),
    ("src", "begin p; x; end;", 200, "ok"),
    ("src", "call q()", 403, "procedure not allowed"),
    ("src", "begin", 403, "procedure not allowed"),
    ("src", "insert into t values (1); drop table t", 403, "several statements"),
    ("src", "insert into t values (1);", 200, "ok"),
    ("src", "insert into u values (1)", 403, "not writable"),
    ("src", "drop", 403, "not writable"),
    ("src", None, 403, "not writable"),
    ("src", "", 403, "not writable"),
    ("src", "select * from v", 403, "table not allowed"),
    ("src", "select * from t limit 1001", 400, "row limit too high"),
    ("src", "select * from x.t limit 1000", 200, "ok"),
    ("src", "select * from v limit 1001", 403, "table not allowed"),
    ("src", "insert into t select * from u", 403, "not writable"),
    ("src", "with a as (select 1) insert into v select 1", 403, "table not allowed"),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(i, d, s) for i, (d, s, _, _) in enumerate(VERDICTS)], "i int, db string, stmt string")
    judged = checks.with_verdict(df, POLICY, {"src": "real"})
    got = {r.i: (r.code, r.detail) for r in judged.collect()}
    assert [got[i] for i in range(len(VERDICTS))] == [(c, d) for _, _, c, d in VERDICTS]
    counts = {r.detail: r.statements for r in checks.verdict_counts(judged).collect()}
    assert sum(counts.values()) == len(VERDICTS) and counts["ok"] == 4


@pytest.mark.parametrize(
    "sql, text, cap",
    [
        ("select 1", "select 1", None),
        ("select 1 limit 5", "select 1 limit 5", 5),
        ("select 1 LIMIT 5 offset 3", "select 1 LIMIT 5 offset 3", 5),
        ("select 1 limit 3, 5", "select 1 LIMIT 5 OFFSET 3", 5),
        ("select 1 fetch first 7 rows only", "select 1 LIMIT 7", 7),
        ("select 1 offset 2 rows fetch next 7 rows only", "select 1 LIMIT 7 OFFSET 2", 7),
        ("select * from t where rownum <= 9", "select * from t LIMIT 9", 9),
        ("select * from t where a = 1 and rownum < 9", "select * from t where a = 1 LIMIT 8", 8),
        ("select * from t where a = 1 or b = 2 and rownum < 9", "select * from t where a = 1 or b = 2 and rownum < 9", None),
        ("select * from (select 1 limit 5)", "select * from (select 1 limit 5)", None),
        ("select 'limit 5'", "select 'limit 5'", None),
    ],
)
def test_normalise_limit(sql, text, cap):
    found = normalise_limit(sql)
    assert (found.text, found.cap) == (text, cap)


def test_policy_from_config():
    policy = Policy.from_config({"allowedDbs": [" a ", ""], "writableTables": ["x.*"], "maxLimit": "5"})
    assert (policy.allowed_sources, policy.writable_tables, policy.max_limit, policy.default_limit) == (("a",), ("x.*",), 5, 100)


@pytest.mark.parametrize(
    "sql, text, cap",
    [
        ("SELECT * FROM t -- LIMIT 5", "SELECT * FROM t -- LIMIT 5", None),
        ("SELECT * FROM t /* LIMIT 5 */", "SELECT * FROM t /* LIMIT 5 */", None),
        ("SELECT * FROM t LIMIT 5 -- all", "SELECT * FROM t LIMIT 5 -- all", 5),
        ("SELECT * FROM t -- c\nLIMIT 2, 5", "SELECT * FROM t -- c\nLIMIT 5 OFFSET 2", 5),
    ],
)
def test_comments_state_no_cap(sql, text, cap):
    found = normalise_limit(sql)
    assert (found.text, found.cap) == (text, cap)

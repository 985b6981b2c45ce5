"""Secret scans: candidates by pattern, told apart by how widely each value is owned over the whole corpus.

Every candidate value is hashed; hashes are counted by distinct repository and distinct owner. A value that many owners
carry is a copied example; one that stays with few owners looks live. Columns only: no Python on the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import stored, text_of

#: The patterns of the base kinds, then those that the operator adds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KEY_BLOCK = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
PREFIXED = (
    r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35,}|sk_live_[A-Za-z0-9]{16,}"
    r"|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})"
)
#: From how many distinct owners on a value counts as a copied example.
EXAMPLE_OWNERS = 3
#: Stands for a removed credential.
REDACTED = "[REDACTED]"
_MARK, _STAND_IN = "\u0001", "\u0002"
_BLOCK = 64


@dataclass(frozen=True)
class Kind:
    """A sort of secret: ``group`` is the part of the match that is the value, ``least`` its least length."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (Kind("assign", ASSIGN, 2, 6), Kind("access", ACCESS), Kind("hex", HEX))
ADDED = (Kind("keyblock", KEY_BLOCK), Kind("prefixed", PREFIXED))


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def _found(text: Column, kind: Kind, rank: int) -> Column:
    """Array of (start, rank, kind, end, value) in code points.

    Each match is set between marks and the text split at them, so pieces and matches alternate; starts are running sums of
    piece lengths, by blocks, so that a text full of matches stays cheap.
    """
    pieces = F.split(F.regexp_replace(text, kind.pattern, f"{_MARK}$0{_MARK}"), _MARK)

    def spans(pieces: Column) -> Column:
        lengths = F.transform(pieces, F.char_length)

        def by_block(lengths: Column, sums: Column) -> Column:
            before = F.transform(F.sequence(F.lit(0), F.size(sums) - 1), lambda b: _total(F.slice(sums, F.lit(1), b)))

            def one(before: Column) -> Column:
                def span(i: Column) -> Column:
                    block = F.floor(i / _BLOCK).cast("int")
                    start = F.get(before, block) + _total(F.slice(lengths, block * _BLOCK + 1, i % _BLOCK))
                    match = F.get(pieces, i)
                    value = match if not kind.group else F.regexp_extract(match, kind.pattern, kind.group)
                    return F.struct(
                        start.alias("start"),
                        F.lit(rank).alias("rank"),
                        F.lit(kind.name).alias("kind"),
                        (start + F.get(lengths, i)).alias("end"),
                        value.alias("value"),
                    )

                found = F.transform(F.sequence(F.lit(1), F.size(lengths) - 2, F.lit(2)), span)
                return F.filter(found, lambda s: F.char_length(s["value"]) >= kind.least)

            return _with(before, one)

        blocks = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / _BLOCK).cast("int"))
        return _with(
            lengths,
            lambda of: _with(F.transform(blocks, lambda b: _total(F.slice(of, b * _BLOCK + 1, F.lit(_BLOCK)))), lambda s: by_block(of, s)),
        )

    none = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int,value:string>>)")
    return _with(pieces, lambda p: F.when(F.size(p) > 1, spans(p)).otherwise(none))


def _with(value: Column, body) -> Column:
    """``body`` over a value that is worked out once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans_of(text: Column) -> Column:
    """All spans of a text by start, then kind; the text may be null."""
    safe = F.translate(F.coalesce(text, F.lit("")), _MARK, _STAND_IN)
    kinds = (*BASE, *ADDED)
    return F.array_sort(F.concat(*(_found(safe, kind, rank) for rank, kind in enumerate(kinds))))


def _named(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def ownership(candidates: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """(hash, repos, owners, example) from rows (hash, repo, owner); a repository is known by its owner and name.

    Distinct rows are made before anything is counted and each count is combined before its shuffle, so a value that a
    third of all rows carry costs one row per task.
    """
    by_owner = candidates.distinct().groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    counted = by_owner.groupBy("hash").agg(F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners"))
    return counted.withColumn("example", F.col("owners") >= example_owners)


def _judged(rows: DataFrame, example_owners: int) -> DataFrame:
    """(_row, spans with ``example``) of the rows that have spans; ``rows`` is stored and has _row, _repo, _owner, _spans."""
    each = rows.where(F.size("_spans") > 0).select("_row", "_repo", "_owner", F.explode("_spans").alias("s"))
    each = each.withColumn("hash", F.sha2("s.value", 256))
    known = ownership(each.select("hash", F.col("_repo").alias("repo"), F.col("_owner").alias("owner")), example_owners)
    told = each.drop("_repo", "_owner").join(known, "hash")
    span = F.struct("s.start", "s.rank", "s.kind", "s.end", "hash", "repos", "owners", "example")
    return told.groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("_judged"))


def scan_secrets(
    docs: DataFrame, repo_col: str = "doc_id", owner_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
    example_owners: int = EXAMPLE_OWNERS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, base_spans, spans (text lists), counts by kind, n_live, n_example, judged.

    A null text is empty. A null owner or repository is an owner or repository of its own name "null". Repeated rows stay,
    each with its result, and count once in the ownership; an empty table gives an empty table; other columns are ignored.
    """
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(repo_col).cast("string"), F.lit("null")).alias("_repo"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("null")).alias("_owner"),
        spans_of(F.col(text_col)).alias("_spans"),
    )
    rows = stored(narrow.withColumn("_row", F.monotonically_increasing_id()), "secrets")
    judged = _judged(rows, example_owners)
    count = lambda name: F.size(F.filter("_spans", lambda s: s["kind"] == name)).cast("long")
    tally = lambda example: F.coalesce(F.size(F.filter("_judged", lambda s: s["example"] == example)), F.lit(0)).cast("long")
    plain = rows.select(
        "_row",
        "doc_id",
        *(count(kind.name).alias(f"n_{kind.name}") for kind in (*BASE, *ADDED)),
        _named(F.filter("_spans", lambda s: s["rank"] < len(BASE))).alias("base_spans"),
        _named(F.col("_spans")).alias("spans"),
    )
    return plain.join(judged, "_row", "left").select(
        *(c for c in plain.columns if c != "_row"),
        tally(False).alias("n_live"),
        tally(True).alias("n_example"),
        F.col("_judged").alias("judged"),
    )


def redact_live(
    docs: DataFrame, repo_col: str = "doc_id", owner_col: str = "source", text_col: str = "text", example_owners: int = EXAMPLE_OWNERS
) -> DataFrame:
    """``docs`` with every live-looking credential replaced; copied examples and all other rows stay as they are.

    Rows without candidates, null texts among them, pass in the scan. Only rows with candidates are stored, judged and
    rewritten. ``n_chars``, where there is such a column, follows the new text.
    """
    spans = spans_of(F.col(text_col)).alias("_spans")
    found = docs.select(F.struct("*").alias("_doc"), spans)
    clean = found.where(F.size("_spans") == 0).select("_doc.*")
    named = found.where(F.size("_spans") > 0).select(
        "_doc",
        "_spans",
        F.coalesce(F.col(f"_doc.{repo_col}").cast("string"), F.lit("null")).alias("_repo"),
        F.coalesce(F.col(f"_doc.{owner_col}").cast("string"), F.lit("null")).alias("_owner"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = stored(named, "secrets")
    told = rows.join(_judged(rows, example_owners), "_row")
    told = told.select("_doc", F.filter("_judged", lambda s: ~s["example"]).alias("_live"))
    told = told.withColumn("_text", _without(F.col(f"_doc.{text_col}"), F.col("_live")))
    renewed = {text_col: F.col("_text")}
    if "n_chars" in docs.columns:
        renewed["n_chars"] = F.char_length("_text").cast(docs.schema["n_chars"].dataType)
    kept = [renewed.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns]
    return clean.unionByName(told.select(*kept))


def _without(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans, in order of their starts, replaced; one fold that carries the reach along."""

    def step(done: Column, span: Column) -> Column:
        gap = F.substring(text, done["reach"] + 1, F.greatest(span["start"] - done["reach"], F.lit(0)))
        more = F.when(span["start"] >= done["reach"], F.array(gap, F.lit(REDACTED))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.concat(done["parts"], more).alias("parts"), F.greatest(done["reach"], span["end"]).alias("reach"))

    none = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("reach"))
    return F.aggregate(spans, none, step, lambda done: F.concat(F.array_join(done["parts"], ""), F.substring(text, done["reach"] + 1, F.char_length(text))))

"""Paged answers put back together.

Input: one row per landed page with its listing, ``page_no`` (from 1), ``code``, ``msg`` and
``data`` (see ``schemas.page_envelope``).

A reader stops after a page that is empty, or that completes the stated total, or that is an
error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens import fixed
from fleetlens.operators.running import running_total
from fleetlens.session import checkpoint

STOPS = "failed OR n = 0 OR seen >= total"
MISSING = "page missing"


def _copy(seq: str | None) -> list[Column]:
    """The order of a page's copies: how new they are, then an answer over a failure, then what they hold."""
    good = F.coalesce(F.col("code") == 0, F.lit(False)).alias("_good")
    return [(F.col(seq) if seq else F.lit(0)).alias("_seq"), good, F.xxhash64("data", "code", "msg").alias("_hash")]


def _headers(pages: DataFrame, keys: Sequence[str], seq: str | None) -> DataFrame:
    """What decides where a reader stops: one narrow row per page, of its newest copy."""
    rows = F.coalesce(F.size("data.totalList"), F.lit(0)).cast("long")
    head = F.struct(
        *_copy(seq),
        F.when(F.col("code") == 0, rows).otherwise(0).alias("n"),
        F.coalesce("data.total", F.lit(0)).alias("total"),
        (F.coalesce(F.col("code"), F.lit(-1)) != 0).alias("failed"),
        F.coalesce(F.nullif("msg", F.lit("")), F.lit(fixed.DEFAULT_PAGE_ERROR)).alias("msg"),
        "code",
    )
    newest = pages.select(*keys, "page_no", head.alias("_head")).groupBy(*keys, "page_no").agg(F.max("_head").alias("_head"))
    return newest.select(*keys, "page_no", "_head.*")


def _reached(pages: DataFrame, keys: Sequence[str], max_pages: int | None, seq: str | None) -> tuple[DataFrame, DataFrame]:
    """Pages a reader asks for, and how each listing ends: ``last_page``, ``bad`` and ``gap``.

    No task has to hold a listing. Several steps need the headers, so these are kept in the
    shared folder and the pages are parsed for them only once.
    """
    few = pages if max_pages is None else pages.filter(F.col("page_no") <= max_pages)
    headers = checkpoint(_headers(few, keys, seq))
    seen = running_total(headers, list(keys), "page_no", F.col("n"), "seen")
    seen = running_total(seen, list(keys), "page_no", F.lit(1), "place")
    # without a gap page n is the n-th; the first page behind a gap stands at the missing number
    ends = seen.groupBy(*keys).agg(
        F.min(F.when(F.expr(STOPS), F.col("page_no"))).alias("last_page"),
        F.min(F.when(F.col("failed"), F.col("page_no"))).alias("bad"),
        F.min(F.when(F.col("place") < F.col("page_no"), F.col("place"))).alias("gap"),
    )
    ends = ends.withColumn("gap", F.when(F.col("last_page").isNull() | (F.col("gap") < F.col("last_page")), F.col("gap")))
    joined = seen.join(ends, list(keys))
    return joined.filter(F.col("last_page").isNull() | (F.col("page_no") <= F.col("last_page"))), ends


def page_errors(pages: DataFrame, keys: Sequence[str], max_pages: int | None = None, seq: str | None = None) -> DataFrame:
    """The page at which each listing failed, with its code and message; a missing page has no code."""
    reached, ends = _reached(pages, keys, max_pages, seq)
    failed = reached.filter("failed AND gap IS NULL").select(*keys, "page_no", "code", "msg")
    kinds = failed.schema
    gaps = ends.filter("gap IS NOT NULL").select(
        *keys,
        F.col("gap").cast(kinds["page_no"].dataType).alias("page_no"),
        F.lit(None).cast(kinds["code"].dataType).alias("code"),
        F.lit(MISSING).alias("msg"),
    )
    return failed.unionByName(gaps)


def union_pages(pages: DataFrame, keys: Sequence[str], max_pages: int | None = None, seq: str | None = None) -> DataFrame:
    """All rows of the pages a reader asks for, with their page and place in it.

    Of a page that landed more than once the copy of the highest ``seq`` counts, and of those, or
    if no ``seq`` is named, an answer before a failure. A listing that
    fails on the way, or lacks a page before its end, has no rows: ask ``page_errors`` for the
    reason. Listings are read to their end unless the caller names ``max_pages``.
    """
    reached, _ = _reached(pages, keys, max_pages, seq)
    by = [*keys, "page_no", "_seq", "_hash"]
    wanted = reached.filter("gap IS NULL AND (bad IS NULL OR bad > last_page)").select(*by)
    payload = pages.select(*keys, "page_no", *_copy(seq), F.col("data.totalList").alias("rows")).dropDuplicates(by)
    exploded = payload.join(wanted, by).select(*keys, "page_no", F.posexplode("rows").alias("pos", "row"))
    return exploded.select(*keys, "page_no", "pos", "row.*")

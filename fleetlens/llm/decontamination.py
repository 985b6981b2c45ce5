"""Benchmark decontamination: prefix-filtered join of item windows with documents.

A window is ``WINDOW`` consecutive words of an item (a shorter item is one window). A document can hold a window only if it
holds the window's rarest word, so that word is the prefix that is joined: words are ordered by how often they occur in
all documents. Candidates are bounded by length and position, then the window is compared word for word. Columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import ascii_lower, stored, text_of, words_between

WINDOW = 10
#: What separates words once A-Z is lowered; fixed value.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to so many distinct words a list is written into the plan as a set; more are joined.
LISTED_WORDS = 50_000


def words_of(column: str) -> Column:
    """Words of a text; a null text has none."""
    return words_between(ascii_lower(text_of(column)), SEPARATORS)


def _listed(words: DataFrame) -> str | None:
    """The words of a one-column table as an SQL list, None if they are too many to list."""
    rows = words.limit(LISTED_WORDS + 1).collect()
    if len(rows) > LISTED_WORDS:
        return None
    return ", ".join(f"'{r[0]}'" for r in rows) or "''"


def item_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, words) of every distinct window of every item."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), words_of(text_col).alias("all"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    cut = F.transform(starts, lambda i: F.slice("all", i, F.lit(window)))
    return items.where(F.size("all") > 0).select("item", F.explode(cut).alias("words")).distinct()


def _counted(docs: DataFrame, vocabulary: DataFrame, text_col: str) -> DataFrame:
    """(word, n): how often each word of the vocabulary occurs in the documents, 0 included."""
    listed = _listed(vocabulary)
    chosen = words_of(text_col) if listed is None else F.expr(f"filter(_words, w -> w IN ({listed}))")
    each = docs.select(words_of(text_col).alias("_words")).select(F.explode(chosen if listed else F.col("_words")).alias("word"))
    counts = each.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return vocabulary.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, offset, item, words): each window with its rarest word and where that stands in it."""
    each = windows.select("item", "words", F.posexplode("words").alias("offset", "word")).join(counts, "word")
    rarest = F.min(F.struct("n", "word", "offset")).alias("r")
    return each.groupBy("item", "words").agg(rarest).select(F.col("r.word").alias("word"), F.col("r.offset").alias("offset"), "item", "words")


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, items (sorted texts).

    A word is hit if it lies in any occurrence of any window. Null and empty texts have no words, null and empty items no
    windows; a null item id reads "null". Repeated documents stay, each with its result; repeated items count once. Without
    items nothing is hit. An empty table gives an empty table; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    windows = stored(item_windows(benchmark, window, item_col, item_text_col), "windows")
    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    needed = stored(prefixes(windows, _counted(docs, vocabulary, "text")), "prefixes")
    listed = _listed(needed.select("word").distinct())
    positions = "sequence(0, size(_words) - 1)"
    places = positions if listed is None else f"filter({positions}, i -> get(_words, i) IN ({listed}))"
    near = f"transform({places}, i -> struct(i AS at, get(_words, i) AS word, "
    near += f"slice(_words, greatest(i - {window - 2}, 1), i + {window} - greatest(i - {window - 2}, 1) + 1) AS around))"
    cut = docs.select(F.col("doc_id"), words_of("text").alias("_words")).select(
        F.monotonically_increasing_id().alias("_row"),
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.expr(f"CASE WHEN size(_words) > 0 THEN {near} ELSE array() END").alias("_near"),
    )
    rows = stored(cut, "candidates")
    candidates = rows.select("_row", "n_words", F.explode("_near").alias("c")).select("_row", "n_words", "c.*")
    joined = candidates.join(needed, "word")
    start = F.col("at") - F.col("offset")
    within = (start >= 0) & (start + F.size("words") <= F.col("n_words"))
    first = F.least(F.col("at"), F.lit(window - 1)) - F.col("offset") + 1
    same = within & (F.slice("around", F.greatest(first, F.lit(1)), F.size("words")) == F.col("words"))
    hits = joined.where(same).select("_row", "item", start.alias("start"), (start + F.size("words")).alias("end"))
    by_row = hits.groupBy("_row").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items")
    )
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach"))
    covered = F.aggregate(
        "spans",
        none,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["reach"]), F.lit(0))).alias("n"),
            F.greatest(a["reach"], s["end"]).alias("reach"),
        ),
        lambda a: a["n"],
    )
    return rows.select("_row", "doc_id", "n_words").join(by_row, "_row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
    )

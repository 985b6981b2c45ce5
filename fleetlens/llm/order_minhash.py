"""Order MinHash: sketches that follow edit distance.

The k-mers of a text are numbered by occurrence, so a repeated k-mer counts each time, and each (k-mer, occurrence) gets a
pseudo-random rank. One permutation is dealt into ``BINS`` bins by the rank's hash, which costs one pass instead of one
per hash function. Each bin keeps its ``PICKED`` lowest k-mers, puts them back into text order and hashes the tuple: two
texts agree in a bin only if they share those k-mers in that order. Columns only: no Python on the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm.common import SPACE_CLASS, text_of, words_between

KMER = 3
BIN_BITS = 5
BINS = 2**BIN_BITS
PICKED = 2
#: How a rank and a position share one sortable integer; positions from 2**24 on tie.
_PLACE_BITS = 24
_RANK_BITS = 62 - _PLACE_BITS - BIN_BITS
_PLACE = (1 << _PLACE_BITS) - 1
#: Rows that share a cell of the id order; one window group.
CELL_ROWS = 2_000


def _with(value: Column, body) -> Column:
    """``body`` over a value that is worked out once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def signature(text: Column) -> Column:
    """Array of ``BINS`` hashes, null where a bin is empty. Texts of fewer than ``KMER`` words are one k-mer; no words, no bins."""

    def kmers(words: Column) -> Column:
        firsts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (KMER - 1), F.lit(1)))
        return F.transform(firsts, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, KMER))))

    def by_hash(kmers: Column) -> Column:
        return F.sort_array(F.transform(kmers, lambda h, i: F.shiftrightunsigned(h, 1).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("long"))))

    def ranked(kmers: Column, run: Column) -> Column:
        size = F.size(run)

        def same(a: Column, b: Column) -> Column:
            return F.shiftright(a, _PLACE_BITS) == F.shiftright(b, _PLACE_BITS)

        def first_of(x: Column, i: Column) -> Column:
            """Lowest index whose k-mer is that of x, by halving."""
            steps = F.sequence(F.lit(1), F.ceil(F.log2(size + F.lit(1))).cast("int") + 1)
            low = F.shiftleft(F.shiftright(x, _PLACE_BITS), _PLACE_BITS)

            def halve(a: Column, _: Column) -> Column:
                mid = F.shiftright(a["lo"] + a["hi"], 1)
                go_left = F.get(run, mid) >= low
                return F.struct(
                    F.when(go_left, a["lo"]).otherwise(F.least(mid + 1, a["hi"])).alias("lo"), F.when(go_left, mid).otherwise(a["hi"]).alias("hi")
                )

            return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), i.alias("hi")), halve, lambda a: a["hi"])

        def one(x: Column, i: Column) -> Column:
            place = x.bitwiseAND(F.lit(_PLACE))
            repeated = (i > 0) & same(F.get(run, i - 1), x)
            number = F.when(repeated, i - first_of(x, i)).otherwise(F.lit(0))
            rank = F.shiftrightunsigned(F.xxhash64(F.get(kmers, place.cast("int")), number), 2)
            return rank.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(place)

        return F.sort_array(F.transform(run, one))

    def chosen(ranked: Column) -> Column:
        bin_of = lambda x: F.shiftright(x, 62 - BIN_BITS)
        kept = F.filter(ranked, lambda x, i: (i < PICKED) | (bin_of(F.get(ranked, i - PICKED)) != bin_of(x)))
        in_text_order = F.transform(kept, lambda x: F.shiftleft(bin_of(x), _PLACE_BITS).bitwiseOR(x.bitwiseAND(F.lit(_PLACE))))
        return F.sort_array(in_text_order)

    def tuples(kmers: Column, picked: Column) -> Column:
        bin_of = lambda x: F.shiftright(x, _PLACE_BITS)
        kmer_at = lambda x: F.get(kmers, x.bitwiseAND(F.lit(_PLACE)).cast("int"))

        def tuple_hash(b: Column) -> Column:
            own = F.filter(picked, lambda x: bin_of(x) == b)
            return F.when(F.size(own) > 0, F.xxhash64(F.transform(own, kmer_at)))

        return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), tuple_hash)

    empty = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.lit(None).cast("long"))
    whole = lambda words: _with(
        kmers(words),
        lambda k: _with(
            by_hash(k), lambda run: _with(ranked(k, run), lambda r: _with(chosen(r), lambda picked: tuples(k, picked)))
        ),
    )
    return _with(words_between(text, SPACE_CLASS), lambda w: F.when(F.size(w) > 0, whole(w)).otherwise(empty))


def likeness(a: Column, b: Column) -> Column:
    """Share of the bins that either text fills in which both agree; 1 for two texts without words."""
    both = F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y) & x.isNotNull(), 1).otherwise(0))
    either = F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), 1).otherwise(0))
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    return F.when(total(either) == 0, F.lit(1.0)).otherwise(total(both) / total(either))


def printed(signature: Column) -> Column:
    """The signature as text, eight hex digits a bin, dashes where it is empty."""
    digits = lambda h: F.lower(F.lpad(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    return F.array_join(F.transform(signature, lambda h: F.coalesce(digits(h), F.lit("--------"))), "")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, signature, fingerprint. Null texts are empty; other columns are ignored."""
    signed = docs.select(F.col(id_col).alias("doc_id"), signature(text_of(text_col)).alias("signature"))
    return signed.withColumn("fingerprint", printed(F.col("signature")))


def _cells(ids: DataFrame, cell_rows: int, most: int) -> tuple[str, str, str]:
    """SQL for the cell of ``doc_id``, whether it is the largest id of its cell, and the cell that it follows on to.

    Cells are ranges of ids of about ``cell_rows`` rows; their number has the fixed bound ``most``, and only one id for
    each reaches the driver.
    """
    rows = ids.count()
    cells = max(1, min(most, -(-rows // cell_rows)))
    shares = ", ".join(str(i / cells) for i in range(1, cells)) or "0.5"
    cuts = ids.agg(F.expr(f"percentile_approx(doc_id, array({shares}), {max(10_000, 20 * cells)})")).first()[0] or []
    bounds = f"array({', '.join(f'{c}L' for c in sorted(set(cuts)))})" if cuts else "cast(array() as array<bigint>)"
    steps = f"sequence(1, {max(1, len(cuts)).bit_length() + 1})"
    halve = f"(a, s) -> IF(a.lo < a.hi, IF(get({bounds}, (a.lo + a.hi) div 2) <= doc_id, "
    halve += "named_struct('lo', cast((a.lo + a.hi) div 2 + 1 as int), 'hi', a.hi), named_struct('lo', a.lo, 'hi', cast((a.lo + a.hi) div 2 as int))), a)"
    cell = f"IF(doc_id IS NULL, -1, aggregate({steps}, named_struct('lo', 0, 'hi', {len(set(cuts))}), {halve}, a -> a.lo))"
    tops = ids.select(F.expr(cell).alias("cell"), "doc_id").groupBy("cell").agg(F.max("doc_id").alias("top")).orderBy("cell").collect()
    if not tops:
        return cell, "false", "0"
    first = ", ".join(f"{t['top']}L" for t in tops if t["top"] is not None)
    is_first = f"doc_id IN ({first})" if first else "false"
    if tops[0]["top"] is None:
        is_first = f"(doc_id IS NULL OR {is_first})"
    names = [t["cell"] for t in tops]
    before = [0] * (names[-1] + 2)
    for at, name in enumerate(names):
        before[name + 1] = names[at + 1] if at + 1 < len(names) else names[0]
    return cell, is_first, f"get(array({', '.join(map(str, before))}), _cell + 1)"


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = CELL_ROWS, most_cells: int = 65_536) -> DataFrame:
    """Each row of ``docs`` beside its edited text and the next document, descending id (after the last: the first).

    The edited text is the text with its last third replaced by as many first characters of the next one. Returns doc_id,
    n_chars, edited, signature, edited_signature, near_edited, near_next. Null texts are empty, null ids come last, rows of
    one id are ordered by their text, and a lone document is its own next. An empty table gives an empty table.

    Rows are dealt once, by ranges of ids; the first row of each range is copied to the end of the range before it.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    cell, is_first, follows = _cells(docs.select("doc_id"), cell_rows, most_cells)
    signed = docs.withColumn("signature", signature(F.col("text"))).withColumn("_cell", F.expr(cell))
    own = F.array(F.struct(F.col("_cell").alias("cell"), F.lit(False).alias("ahead")))
    ahead = F.array(F.struct(F.expr(follows).alias("cell"), F.lit(True).alias("ahead")))
    dealt = signed.withColumn("_to", F.explode(F.when(F.expr(is_first), F.concat(own, ahead)).otherwise(own)))
    order = Window.partitionBy("_to.cell").orderBy("_to.ahead", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    paired = dealt.withColumn("_next", F.lead(F.struct("text", "signature")).over(order)).where(~F.col("_to.ahead"))
    n = F.char_length("text")
    moved = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - moved), F.substring("_next.text", F.lit(1), moved))
    both = paired.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "signature", F.col("_next.signature").alias("_next"))
    both = both.withColumn("edited_signature", signature(F.col("edited")))
    return both.select(
        "doc_id",
        "n_chars",
        "edited",
        "signature",
        "edited_signature",
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("_next")).alias("near_next"),
    )

"""Sharding, secrets, decontamination and order sketches against plain versions."""

import brute
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import decontamination
from fleetlens.llm.common import release
from fleetlens.llm.decontamination import find_contamination
from fleetlens.llm.order_minhash import compare_edits, fingerprint, printed
from fleetlens.llm.secret_scan import REDACTED, redact_live, scan_secrets
from fleetlens.llm.sharding import place, shard_rows


def test_shards_are_even_and_gapless(made):
    rows, docs = made
    placed = shard_rows(docs, 24).collect()
    assert sorted(r.doc_id for r in placed) == sorted(d for d, _ in rows)
    sizes = {d: len((t or "").encode()) + 8 for d, t in rows}
    assert all(r["size"] == sizes[r.doc_id] for r in placed)
    by = {s: sorted(r.slot for r in placed if r.shard == s) for s in range(24)}
    counts = [len(v) for v in by.values()]
    assert max(counts) - min(counts) <= 1 and all(v == list(range(len(v))) for v in by.values())


def test_full_shards_pass_rows_on_clockwise():
    counts = {cell: 3 for cell in range(0, 16384, 7)}
    total = sum(counts.values())
    for slack in (0.0, 0.25):
        pieces = place(counts, 5, slack)
        assert sum(e - f for _, f, e, _, _ in pieces) == total
        loads = [sum(e - f for _, f, e, s, _ in pieces if s == k) for k in range(5)]
        assert max(loads) <= (total // 5 + 1 if not slack else 1.25 * total / 5 + 1)
    free = {(c, f): s for c, f, _, s, _ in place(counts, 5, 5.0)}
    more = {(c, f): s for c, f, _, s, _ in place(counts, 6, 5.0)}
    assert all(more[k] in (5, free[k]) for k in free)  # with room, one more shard takes rows only into itself


def test_repeated_and_null_rows_are_sharded(spark, none):
    docs = spark.createDataFrame([(1, "a")] * 50 + [(None, "a")] * 50 + [(None, None)] * 20, "doc_id long, text string")
    placed = shard_rows(docs, 7).collect()
    counts = sorted(sum(r.shard == s for r in placed) for s in range(7))
    assert len(placed) == 120 and counts[-1] - counts[0] <= 1
    assert shard_rows(none, 4).count() == 0


def test_secrets(made):
    rows, docs = made
    got = {r.doc_id: r for r in scan_secrets(docs).withColumn("sha", F.sha2("base_spans", 256)).collect()}
    for d, t in rows:
        assert (got[d].n_assign, got[d].n_access, got[d].n_hex, got[d].sha) == brute.secrets(t), (d, t)


def test_ownership_tells_examples_from_live_ones(spark, none):
    docs = spark.createDataFrame(
        [(i, "token=copied99", f"o{i}") for i in range(5)] + [(9, "x token=mine1234 y token=copied99", "o1"), (None, None, None)],
        "doc_id long, text string, source string",
    )
    got = {r.doc_id: (r.n_live, r.n_example) for r in scan_secrets(docs).collect()}
    assert got == {**{i: (0, 1) for i in range(5)}, 9: (1, 1), None: (0, 0)}
    texts = {r.doc_id: r.text for r in redact_live(docs).collect()}
    assert texts[9] == f"x {REDACTED} y token=copied99" and texts[0] == "token=copied99" and texts[None] is None
    assert scan_secrets(none).count() == 0 and redact_live(none).count() == 0


@pytest.mark.parametrize("listed", [50_000, 0])
def test_contamination(spark, made, monkeypatch, listed):
    monkeypatch.setattr(decontamination, "LISTED_WORDS", listed)
    rows, docs = made
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    items += [(None, "two words"), (900, "word the word the word the word the word the word"), (901, None), (902, "--"), (903, "one"), (903, "one")]
    items += [(904, rows[3][1])]
    rows = [*rows, (30_000, "x " + items[0][1] + " y " + items[1][1])]
    docs = docs.select("doc_id", "text", "words").union(spark.createDataFrame([rows[-1] + ("w",)], "doc_id long, text string, words string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(rows, [("null" if i is None else i, t) for i, t in items])
    got = find_contamination(docs, bench).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(r["items"]))) == want[r.doc_id], r.doc_id


def test_contamination_of_nothing(spark, made, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(none, bench).count() == 0
    assert {r.n_hit for r in find_contamination(made[1], bench).collect()} == {0}


@pytest.mark.parametrize("cell_rows", [2_000, 9])
def test_edited_texts(made, cell_rows):
    rows, docs = made
    want = brute.edits(rows)
    got = compare_edits(docs, cell_rows=cell_rows).collect()
    assert {r.doc_id: (r.n_chars, brute.sha(r.edited)) for r in got} == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = [r for r in got if r.n_chars > 2000 and r.doc_id < 10_000]
    assert sum(r.near_edited for r in long) > 5 * sum(r.near_next for r in long) > -1


def test_prints_follow_texts_and_order(spark, made, none):
    rows, docs = made
    by_text = {}
    prints = {r.doc_id: r.fingerprint for r in fingerprint(docs).collect()}
    for d, t in rows:
        assert by_text.setdefault(t or "", prints[d]) == prints[d]
    words = [f"w{i}" for i in range(300)]
    turned = words[150:] + words[:150]
    few = spark.createDataFrame([(2, " ".join(words)), (1, " ".join(turned))], "doc_id long, text string")
    a = compare_edits(few).orderBy("doc_id").first()
    assert 0.2 < a.near_next < 0.9  # nearly the same k-mers, another order
    assert compare_edits(none).count() == 0
    alone = compare_edits(few.where("doc_id = 1")).first()
    assert alone.near_next == 1.0
    same = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (5, None)], "doc_id long, text string")
    assert compare_edits(same).count() == 3


def test_working_tables_can_be_released(spark, made):
    from fleetlens.session import shared_dir

    scan_secrets(made[1]).count()
    release(spark)
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    left = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(folder)
    assert not [s for s in left if "fleetlens-secrets" in s.getPath().getName()]

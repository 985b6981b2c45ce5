"""The weak-label classifier against gold labels, and the pipeline stage by stage."""

import brute
import numpy as np
import pytest

import corpus_pipeline
from fleetlens.llm.common import release
from fleetlens.llm.quality import LABELLERS, classify, keep_good, learn_accuracies, posteriors, train_scorer

FOLDER = "/root/testdata/sf0.01"


def test_accuracies_are_recovered():
    rng = np.random.default_rng(4)
    kind = rng.choice(3, 40_000, p=[0.75, 0.15, 0.1])
    true = np.full((3, len(LABELLERS)), 0.01)
    true[1, :7], true[2, 7:], true[[0, 2], 0] = 0.6, 0.8, 0.001
    fired = rng.random((len(kind), len(LABELLERS))) < true[kind]
    fired[fired[:, 0], 1:] = False  # of an empty text the other labellers see nothing
    patterns, counts = np.unique(fired @ (1 << np.arange(len(LABELLERS))), return_counts=True)
    share, chance = learn_accuracies(patterns, counts.astype(float))
    assert np.allclose(share, [0.75, 0.15, 0.1], atol=0.03) and np.allclose(chance, true, atol=0.06)
    assert (posteriors(fired.astype(int), share, chance).argmax(axis=1) == kind).mean() > 0.97


def test_scorer_learns_soft_targets():
    rows = [np.array([5, 65536]), np.array([9, 65537])] * 20
    weights = train_scorer(rows, np.array([[0.9, 0.05, 0.05], [0.05, 0.9, 0.05]] * 20))
    assert weights[5, 0] > weights[5, 1] and weights[9, 1] > weights[9, 0]


def test_held_out_labels(spark):
    """Cues are mined from the labels of even ids, and rows of odd ids are judged; the README gives the figures."""
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    judged = classify(docs, labels.where("doc_id % 2 = 0")).select("doc_id", "keep").join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert len(judged) == labels.where("doc_id % 2 = 1").count()
    clean = [r.keep for r in judged if r.quality == 1 and not r.toxic]
    junk = [not r.keep for r in judged if r.quality == 0]
    toxic = [not r.keep for r in judged if r.toxic]
    print("held out", np.mean(clean), np.mean(junk), np.mean(toxic), len(clean), len(junk), len(toxic))
    assert np.mean(clean) > 0.97 and np.mean(junk) > 0.85 and np.mean(toxic) > 0.7


def test_quality_edges(made, none, spark):
    rows, docs = made
    assert classify(docs).count() == len(rows)
    kept = keep_good(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert kept.columns == docs.columns and classify(none).count() == 0 and keep_good(none).count() == 0


def test_texts_without_words_go_and_short_ones_do_not(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    odd = [(-1, None), (-2, ""), (-3, " \n\t "), (-4, "Re."), (-5, "That it was."), (-6, "x" * 2_000_000)]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    kept = {r.doc_id: r.keep for r in classify(more, labels).where("doc_id < 0").collect()}
    assert len(kept) == 6 and [kept[i] for i in (-1, -2, -3, -4, -5)] == [False, False, False, True, True]


def test_silence_about_an_empty_text_is_no_evidence():
    share, chance = learn_accuracies(np.array([0, 1, 2, 256]), np.array([900.0, 3, 60, 37]))
    assert posteriors(np.eye(1, len(LABELLERS), dtype=int), share, chance).argmax() == 1


@pytest.fixture(scope="module")
def staged(spark):
    """Input and output rows of each stage."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, FOLDER)
        kept = spark.createDataFrame(result.collect(), result.schema)
        out.append((name, docs, kept))
        docs = kept
    release(spark, corpus_pipeline._owner())
    return out


def test_stages_take_effect(spark, staged):
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    assert all(kept.columns == columns for _, _, kept in staged[:-1])
    texts = [({r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r for r in kept.collect()}) for _, docs, kept in staged[:4]]
    before, after = texts[1]
    names = brute.components({d: brute.simhash(t) for d, t in before.items()})
    assert set(after) == {d for d in before if names[d] == d} and len(after) < len(before)
    before, after = texts[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    hit = brute.contamination(before.items(), items)
    assert set(after) == {d for d in before if not hit[d][1]} and len(after) < len(before)
    before, after = texts[3]
    changed = [d for d in before if before[d] != after[d].text]
    assert set(after) == set(before) and changed and all(sum(brute.secrets(before[d])[:3]) or "KEY" in before[d] or "_" in before[d] for d in changed)
    assert all(after[d].n_chars == len(after[d].text) for d in changed)


def test_last_stage_counts_tokens(staged):
    _, docs, kept = staged[-1]
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = kept.collect()
    assert {r.doc_id for r in rows} == set(texts) and all(r.decoded_sha256 == brute.sha(texts[r.doc_id]) for r in rows)


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


def test_run_is_its_stages(spark, staged):
    want = sorted(map(tuple, staged[-1][2].collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == want


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def odd_rows():
    """Null ids, one id over two texts, repeated rows, null and empty texts."""
    texts = [" ".join(WORDS[(i * 7 + j * (i + 3)) % 20] + str(i) for j in range(30)) for i in range(4)]
    return [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (5, texts[3]), (9, texts[2]), (None, texts[2]), (7, None), (8, ""), (None, None)], texts


def test_near_dedup_loses_no_text(spark):
    rows, texts = odd_rows()
    docs = spark.createDataFrame([(d, t, 1, "x", "y") for d, t in rows], "doc_id long, text string, _near_key int, component_id string, key string").repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (7, None)], key=str)


def test_decontaminate_judges_rows(spark):
    item = next(r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").where("length(text) > 100").collect())
    rows = [(None, f"before {item} after"), (5, item), (5, "clean words only"), (None, "clean"), (6, None), (7, ""), (8, item), (8, item)]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, _row_key int, items string").repartition(3)
    kept = corpus_pipeline.decontaminate(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(5, "clean words only"), (None, "clean"), (6, None), (7, "")], key=str)


def test_owners_remove_their_own_tables(spark):
    from fleetlens.llm.common import owned, stored

    with owned("a"):
        mine = stored(spark.range(3), "mine")
    other = stored(spark.range(4), "other")
    release(spark, "b")
    assert mine.count() == 3
    release(spark, "a")
    assert other.count() == 4


def test_many_live_secrets_in_one_text(spark):
    import time

    from fleetlens.llm.secret_scan import redact_live

    text = " ".join(f"password=q{i}zX{i * 7919}" for i in range(4_000))
    docs = spark.createDataFrame([(1, text, "s"), (2, "clean é", "s")], "doc_id long, text string, source string")
    began = time.time()
    got = {r.doc_id: r.text for r in redact_live(docs).collect()}
    release(spark)
    words = got[1].split()
    assert got[2] == "clean é" and len(words) == 4_000 and time.time() - began < 30
    assert sum("REDACTED" in w for w in words) > 3_000 and all("REDACTED" in w or w in text for w in words)


def plain_votes(text, words, starts):
    """The labellers as they are described, one token after the other."""
    import re

    from fleetlens.llm.quality import _TRIM, FEW, STARTS

    tokens = text.split() if text else []
    n, fired = len(tokens), 0
    if not n:
        return 1
    bare = {t.lower().strip(_TRIM) for t in tokens}
    symbols = len(re.findall(r"[^\w\s]{2,}|(?<=\s)[|~^<>=*#](?=\s)", text))
    lines = [line for line in text.split("\n") if line.strip()]
    fired |= 128 * bool(words & bare) | 256 * bool(starts & {b[:k] for b in bare for k in STARTS if len(b) >= k})
    fired |= 2 * (symbols > max(1 if n < FEW else 0, 0.1 * n))
    if n < FEW:
        return fired
    fired |= 4 * (sum(t.isupper() for t in tokens) > 0.2 * n) | 8 * (sum(a == b for a, b in zip(tokens, tokens[1:])) > max(2, 0.08 * n))
    fired |= 16 * (len(set(tokens)) < 0.12 * n and n >= 30) | 32 * (len(lines) >= 4 and len(set(lines)) < 0.5 * len(lines))
    return fired | 64 * (not 2 <= len(text) / n - 1 <= 25)


def test_votes_of_odd_texts():
    import random

    from fleetlens.llm.quality import Cues, votes_of

    rng = random.Random(1)
    chars = "ab AB.,|~^<>=*# \n\t\x1c\x85\xa0　éΣİßﬁ_9-!?'\"()[]中😀"
    texts = [None, "", "|", " | ", "| |", "## #", "ΑΣ ΑΣ. ΣΑ", "a\n" * 20] + ["".join(rng.choice(chars) for _ in range(rng.randrange(40))) for _ in range(5000)]
    for words, starts in ((set(), set()), ({"ab", "a", "éa", "(a"}, {"abab", "baabb"})):
        cues = Cues(frozenset(words), frozenset(starts))
        got = [votes_of(t, cues) for t in texts]
        assert got == [plain_votes(t, words, starts) for t in texts] and len(set(got)) > 8


def test_starts_are_cut_only_from_words_that_begin_like_one():
    from fleetlens.llm.quality import Cues

    asked = []

    class Asked(frozenset):
        def isdisjoint(self, other):
            asked.extend(other)
            return super().isdisjoint(other)

    cues = Cues(frozenset(), Asked({"wxyzab"}))
    assert cues.votes("some xabcdefg and awxyzab " * 50) == 0 and not asked
    assert cues.votes("other (WXYZabcd, words") == 256 and set(asked) == {"wxyz", "wxyza", "wxyzab", "wxyzabc"}


def test_stages_bound_the_batches_that_go_to_python(spark):
    from pyspark.sql import functions as F

    from fleetlens.session import BATCH_SETTING

    def largest(session):
        def sizes(batches):
            for b in batches:
                yield b.assign(n=b["text"].str.len().sum())[["n"]]

        texts = session.range(120).coalesce(1).select(F.repeat(F.lit("word "), 20_000).alias("text"))
        return max(r.n for r in texts.mapInPandas(sizes, "n long").collect())

    for stage in (corpus_pipeline.quality, corpus_pipeline.near_dedup, corpus_pipeline.tokens):
        free, own = spark.newSession(), spark.newSession()
        free.conf.unset(BATCH_SETTING)
        own.conf.set(BATCH_SETTING, "7m")
        assert largest(free) == 12_000_000
        for session in (free, own):
            stage(session, session.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER)
        assert largest(free) < 4_000_000 and own.conf.get(BATCH_SETTING) == "7m"
    release(spark, corpus_pipeline._owner())

"""Substrings, language model, SimHash, personal data, byte BPE against plain versions."""

import math

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import byte_bpe, language_model, simhash, substrings
from fleetlens.llm.byte_bpe import decode, encode, round_trip
from fleetlens.llm.components import components
from fleetlens.llm.language_model import learn_weights, score_texts
from fleetlens.llm.pii import find_spans, scan_personal_data
from fleetlens.llm.queries import tokenizer
from fleetlens.llm.simhash import bit_groups, flips, near_groups, thresholds
from fleetlens.llm.substrings import COVER, PERIOD, remove_repeats


def test_cover_covers():
    for shift in range(PERIOD):
        assert any((c + shift) % PERIOD in COVER for c in COVER)


def _shared(rows):
    """Passages of 49 to 130 words moved between documents, at every alignment."""
    words = [f"v{i}" for i in range(400)]
    more = [(40_000, " ".join(words))]
    for k, (start, size) in enumerate([(0, 49), (3, 50), (17, 51), (100, 64), (211, 130), (380, 20), (350, 50)]):
        more.append((40_001 + k, " ".join(["pre"] * (k * 5) + words[start : start + size] + ["post"] * k)))
    more.append((3_999, " ".join(words[90:170])))
    return [*rows, *more]


def test_repeated_substrings(spark, made):
    rows = _shared(made[0])
    docs = spark.createDataFrame([(d, t, 1, "a") for d, t in rows], "doc_id long, text string, start int, key string").repartition(4)
    want = brute.substrings(rows)
    got = remove_repeats(docs).withColumn("sha", F.sha2("kept", 256)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in got} == want


def test_repeated_rows_and_null_ids_in_substrings(spark, none):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (2, text), (None, text), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in remove_repeats(docs).collect())
    assert got == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 60), (2, 60)]
    assert remove_repeats(none).count() == 0


@pytest.mark.parametrize("chunk, bucket", [(2_000_000, 2_000_000), (700, 900)])
def test_base_scores(made, monkeypatch, chunk, bucket):
    if chunk < 1_000:
        monkeypatch.setattr(language_model, "BUCKET_KEYS", 40_000)
    rows, docs = made
    want = brute.base_scores(rows)
    got = score_texts(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        held, n, known, train, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_model_is_the_mixture_it_claims(spark):
    texts = [(i, " ".join(["a", "b"] * (i % 5 + 1) + ["c"])) for i in range(60)]
    got = {r.doc_id: r for r in score_texts(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    fold = {d: language_model.fold_of(d) for d, _ in texts}
    counts = {}
    for keep in ("all", "fit"):
        one, two = {}, {}
        for d, t in texts:
            if fold[d] == 2 or keep == "fit" and fold[d] == language_model.TUNING_FOLD:
                continue
            w = ["</s>", *t.split(), "</s>"]
            for a, b in zip(w, w[1:]):
                one[b] = one.get(b, 0) + 1
                two[a, b] = two.get((a, b), 0) + 1
        counts[keep] = one, two
    one, two = counts["fit"]
    n, v = sum(one.values()), len(one)
    events = []
    for d, t in texts:
        if fold[d] == language_model.TUNING_FOLD:
            w = ["</s>", *t.split(), "</s>"]
            for a, b in zip(w, w[1:]):
                events.append((int(math.log2(one.get(a, 0) + 1)), 1, two.get((a, b), 0) / max(one.get(a, 0), 1), one.get(b, 0) / n))
    weights = learn_weights(pd.DataFrame(events, columns=["bucket", "n", "f2", "f1"]), v)
    one, two = counts["all"]
    n, v = sum(one.values()), len(one)
    for d, t in texts:
        w, total = ["</s>", *t.split(), "</s>"], 0.0
        for a, b in zip(w, w[1:]):
            mix = weights[int(math.log2(one.get(a, 0) + 1))]
            total += math.log10(mix[0] * two.get((a, b), 0) / max(one.get(a, 0), 1) + mix[1] * one.get(b, 0) / n + mix[2] / (v + 1))
        assert math.isclose(got[d].score, total, rel_tol=1e-6)


def test_scores_of_nothing(spark, none):
    assert score_texts(none).count() == 0
    few = spark.createDataFrame([(None, None), (None, "a"), (4, "")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in score_texts(few).collect()) == [1, 1, 2]
    assert np.allclose(learn_weights(pd.DataFrame(), 3).sum(axis=1), 1)


def test_scores_keep_large_ids_beside_null_ones(spark):
    ids = [9007199254740993, 9007199254740995, None, -(2**63), 2**63 - 1]
    docs = spark.createDataFrame([(i, "a b c") for i in ids], "doc_id long, text string").repartition(1)
    got = {r.doc_id: r.held_out for r in score_texts(docs).collect()}
    assert got == {i: language_model.fold_of(i) == 2 for i in ids}


def test_fingerprints_and_components(made):
    rows, docs = made
    prints = {d: brute.simhash(t) for d, t in rows}
    want = brute.components(prints)
    got = near_groups(docs).collect()
    assert {r.doc_id: r["print"] % 2**64 for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("group_rows", [20_000, 7])
def test_near_prints_link_whatever_the_split(spark, group_rows):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = [int(c) for c in centres]
    for c in centres[:6]:
        for _ in range(60):
            bits = rng.choice(64, rng.integers(1, 6), replace=False)
            values.append(int(c) ^ sum(1 << int(b) for b in bits))
    ids = {i: v for i, v in enumerate(dict.fromkeys(values))}
    prints = spark.createDataFrame([(np.uint64(v).astype(np.int64).item(),) for v in ids.values()], "print long")
    found = components(simhash.link(prints, group_rows=group_rows)).collect()
    parts = {r.node % 2**64: r.component for r in found}
    want = brute.components(ids)
    by_want, by_got = {}, {}
    for i, v in ids.items():
        by_want.setdefault(want[i], set()).add(v)
        by_got.setdefault(parts.get(v, ("alone", v)), set()).add(v)
    assert sorted(map(sorted, by_want.values())) == sorted(map(sorted, by_got.values()))


def test_thresholds_avoid_a_crowded_group():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 2**63, 5_000, dtype=np.uint64) << np.uint64(16)
    groups = [list(range(k * 16, k * 16 + 16)) for k in range(4)]
    chosen = thresholds(sample, groups)
    assert chosen[0] == -1 and sum(t + 1 for t in chosen) == 4
    assert sorted(b for g in bit_groups(sample) for b in g) == list(range(64))
    assert len(flips(16, 1)) == 17


def test_prints_of_nothing(spark, none):
    assert near_groups(none).count() == 0
    few = spark.createDataFrame([(None, None), (7, ""), (7, ""), (3, "a b c d")], "doc_id long, text string")
    assert sorted(r.component_id for r in near_groups(few).collect()) == [3, 7, 7, 7]


def test_chains_and_stars_are_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}}


def test_personal_data(made, none):
    rows, docs = made
    got = {r.doc_id: r for r in scan_personal_data(docs).withColumn("sha", F.sha2("base_spans", 256)).collect()}
    for d, t in rows:
        r = got[d]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.sha) == brute.personal(t), (d, t)
    assert scan_personal_data(none).count() == 0


def test_personal_data_at_random():
    rng = np.random.default_rng(3)
    letters = list("ab@..-+ 1234567890()%_é") + ["iban", "://"]
    for _ in range(3_000):
        text = "".join(rng.choice(letters, rng.integers(1, 60)))
        said = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{s}:{e}" for k, s, e in find_spans(text) if k < 4)
        assert brute.sha(said) == brute.personal(text)[-1], text


def test_cues_add_spans():
    text = "IBAN: DE89 3704 0044 0532 0130 00, account no. 12345678, SSN 123-45-6789, https://me:pw1@host.org/x"
    assert [(k, text[s:e]) for k, s, e in find_spans(text) if k > 3] == [
        (4, "DE89 3704 0044 0532 0130 00"), (5, "12345678"), (6, "123-45-6789"), (7, "me:pw1@host.org")
    ]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    path, pattern = tokenizer()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})


def test_ids_are_the_library_s(made, library, none):
    rows, docs = made
    coded = encode(docs, *tokenizer())
    got = {r.doc_id: r.ids for r in coded.collect()}
    for d, t in rows:
        assert got[d] == library.encode_ordinary(t or ""), d
    texts = {r.doc_id: r.bytes for r in decode(coded, *tokenizer()).collect()}
    assert all(bytes(texts[d]).decode() == (t or "") for d, t in rows)
    for r in round_trip(docs, *tokenizer()).collect():
        t = dict(rows)[r.doc_id]
        ids = library.encode_ordinary(t or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(t or ""))
    assert encode(none, *tokenizer()).count() == 0 and round_trip(none, *tokenizer()).count() == 0


def test_pieces_of_any_length_take_the_query(library):
    rng = np.random.default_rng(2)
    coder = byte_bpe.Coder(*tokenizer())
    pieces = ["".join(rng.choice(list("abcdenirstüé"), rng.integers(2, 120))) for _ in range(300)] + ["a" * 100, "ha" * 50, "!" * 90]
    pieces += ["x" * 200_000, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 60_000)), "中文" * 4_000, "aaaa" * 999 + "b"]
    for piece, rows in zip(pieces, coder.batch(pieces)):
        want = library.encode_ordinary(piece)
        assert " ".join(r[1] for r in rows) == " ".join(map(str, want)) and b"".join(r[2] for r in rows) == piece.encode()
        assert sum(r[0] for r in rows) == len(want)


def test_coder_forgets_and_learns_again(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KNOWN", 5)
    coder = byte_bpe.Coder(*tokenizer())
    for text in ["one two  three\n\nfour five's six seven eight", "two three\u3000four\r\n nine 12345 ... 中文", "one nine"] * 3:
        rows = next(coder.batch([text]))
        assert " ".join(r[1] for r in rows) == " ".join(map(str, library.encode_ordinary(text)))
    assert len(coder.known_words.young) <= 6 and len(coder.known_words.old) <= 6


def test_unknown_ids_decode_to_null(spark):
    coded = spark.createDataFrame([(1, [0, 50300]), (2, [None, 5]), (3, None), (4, []), (5, [64, 64])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.bytes for r in decode(coded, *tokenizer()).collect()}
    assert got[1] is None and got[2] is None and bytes(got[3]) == bytes(got[4]) == b"" and bytes(got[5]) == b"aa"


def test_words_are_remembered_by_their_ids_alone(library):
    coder = byte_bpe.Coder(*tokenizer())
    text = "one two's three\n\nfour, five é 中文 12345 ... \U0001f600"
    (n, ids, raw), empty = coder.joined([text, None])
    want = library.encode_ordinary(text)
    assert (n, ids, raw) == (len(want), " ".join(map(str, want)), text.encode()) and empty == (0, "", b"")
    assert {type(v) for held in (coder.known_words, coder.known_pieces) for v in held.young.values()} == {str}


def test_what_ids_decode_to_is_not_taken_from_the_text(monkeypatch):
    coder = byte_bpe.Coder(*tokenizer())
    plain = coder._contract
    monkeypatch.setattr(coder, "_contract", lambda raws: [(n, ids, b"" if raw == b" two" else raw) for (n, ids, raw) in plain(raws)])
    for _ in range(2):  # learned, then remembered
        assert [raw for _, _, raw in coder.joined(["one two two, three", "two"])] == [b"one, three", b"two"]
        assert b"".join(r[2] for r in next(coder.batch(["one two two, three"]))) == b"one, three"

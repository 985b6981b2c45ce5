"""Token counts and alignment against the libraries on whole texts."""

import random
import string
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import alignment, chunks
from fleetlens.llm.alignment import Pair, align_tokens
from fleetlens.llm.queries import op12_alignment, vocabulary
from fleetlens.llm.token_counts import Counter, count_tokens
from fleetlens.llm.words import BYTE_LEVEL, joinable, parts_of, piece_splitter, word_splitter
from fleetlens.session import BATCH_BYTES, BATCH_SETTING

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
CHARS = "ab é中😀 \n\t\r\x0b\x1c\x85\xa0 '1２.,!_s\u3000\u0558\ua7ceʼn\x00"
ODD = [
    "a <|endoftext|> b<|endoftext|>", "<|endoftext|><|endoftext|>  ", "<|endoftext|", "x" * 5001, "ab" * 3000 + "ll'll", " " * 999 + "x", "中文字符" * 300,
    "line\nline\n\n two\r\nthree \n", "\n", "\n\n", " ", "", None, "under▁line", "ＡＢ ﬁ é e\u0301",
]


def noise(n, most, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(CHARS) for _ in range(rng.randrange(most))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(A)


def test_words_end_where_pieces_do():
    import public_tokenizers
    import regex

    assert BYTE_LEVEL == public_tokenizers.PATTERN
    whole, fast = regex.compile(BYTE_LEVEL).findall, piece_splitter(BYTE_LEVEL)
    for lines, marks in ((True, ",.!'"), (False, ""), (True, string.punctuation), (False, "-]^")):
        words = word_splitter(BYTE_LEVEL, lines, marks)
        for text in noise(3000, 12) + [t for t in ODD if t]:
            assert [p for w in words(text) for p in fast(w)] == whole(text)
    assert word_splitter("[a-z]+")("a b") == ["a b"]


def test_codes_are_packed_whole():
    import numpy as np

    for codes in ([], [0], [2**24 - 1, 0, 255, 256, 65536], list(range(70_000))):
        assert chunks.unpack(chunks.pack(np.array(codes, np.int32))).tolist() == codes


def test_parts_are_never_joined():
    import numpy as np

    table = joinable([b"ab", b"bc"])
    owner, part, place = parts_of(np.frombuffer(b"abcabb", np.uint8), np.array([4, 2]), table)
    assert owner.tolist() == [0, 0, 1, 1] and part.tolist() == [0, 0, 0, 1, 2, 3] and place.tolist() == [0, 1, 2, 0, 0, 0]


def test_counts_are_the_librarys(spark, made, library):
    texts = noise(500, 60) + ODD + [t for _, t in made[0]]
    rows = [(i % 900 if i % 7 else None, t, 1, "x", True) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, word string, over_limit boolean").repartition(5)
    got = sorted(map(tuple, count_tokens(docs, A, limit=20).collect()), key=str)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted(((d, len((t or "").encode()), count(t), count(t) > 20) for d, t, *_ in rows), key=str)
    assert count_tokens(docs.where("false"), A).count() == 0


def test_counts_of_long_words(library):
    rng = random.Random(5)
    texts = ["x" * 1_000_003, "".join(rng.choice("etaoin") for _ in range(30_000)), "".join(rng.choice("ÀÉßçñ") for _ in range(20_000))]
    texts.append(" ".join(noise(20, 40)) * 9_000)
    assert Counter(A).batch(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_counter_forgets_and_learns_again(library):
    counter = Counter(A)
    counter.known.most = 5
    for text in noise(60, 80, 9):
        assert counter.batch([text, text]) == [len(library.encode(text, add_special_tokens=False).ids)] * 2
    assert len(counter.known.young) <= 6 and len(counter.known.old) <= 6


def plain(library, pair):
    from sentencepiece import SentencePieceProcessor

    library.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=B)
    a = lambda t: library.encode(t, add_special_tokens=False).ids
    return a, b.encode, pair.bytes_a.__getitem__, pair.bytes_b.__getitem__


def chunked(docs):
    """Each row's words as coded, by id, and how many chunks there are."""
    words, texts = chunks.code_texts(docs, lambda: lambda text: None if text == "no" else text.split(), "doc_id", "text")
    named = {(r.chunk, r.place): r.word for r in words.collect()}
    rows = texts.collect()
    found = {r.doc_id: None if r.codes is None else [named[r.chunk, c] for c in chunks.unpack(r.codes).tolist()] for r in rows}
    return found, len(rows), len({r.chunk for r in rows})


@pytest.mark.parametrize("most, number", [(chunks.CHUNK_WORDS, 1), (40, 10)])
def test_chunk_goes_on_over_batches(spark, monkeypatch, most, number):
    """Batches for Python may be small: a chunk's size is its own, and ends with its distinct words too."""
    monkeypatch.setattr(chunks, "CHUNK_WORDS", most)
    texts = [f"a w{i} v{i} a" if i % 5 else [None, "", "no"][i % 3] for i in range(250)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(setting, 7)
    try:
        found, rows, count = chunked(docs)
    finally:
        spark.conf.unset(setting)
    assert rows == len(texts) and found == {i: None if t == "no" else (t or "").split() for i, t in enumerate(texts)}
    assert count == 1 if number == 1 else count >= number


def test_groups_are_joined_in_parts(monkeypatch):
    groups, code = pa.array([f"{i},{i}|{i}é" for i in range(9)]), np.array([8, 0, 0, 3, 5, 1, 7], np.int32)
    for most in (1, 3, 7, 100):
        monkeypatch.setattr(alignment, "JOINED_WORDS", most)
        assert b"".join(alignment._joined(groups, code)).decode() == ";".join(groups[i].as_py() for i in code.tolist())


def test_alignment_takes_small_batches(spark, folder):
    """The query bounds the texts that a worker and its executor hold at once, unless the session says how."""
    spark.createDataFrame([(1, "unbelievable")], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    free, own = spark.newSession(), spark.newSession()
    free.conf.unset(BATCH_SETTING)
    own.conf.set(BATCH_SETTING, "7m")
    assert [op12_alignment(x, folder).count() for x in (free, own)] == [1, 1]
    assert [x.conf.get(BATCH_SETTING, None) for x in (free, own)] == [BATCH_BYTES, "7m"]


@pytest.mark.parametrize("chars", [chunks.CHUNK_CHARS, 300])
def test_alignment_of_whole_texts(spark, library, monkeypatch, chars):
    monkeypatch.setattr(chunks.code_texts, "__defaults__", (chars,))
    texts = noise(300, 50) + [t if t is None or len(t) < 900 else t[:900] for t in ODD] + ["the cat sat on the mat. The end\n"] * 3
    rows = [(i % 250 if i % 7 else None, t, "x", 5, 6) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int, place int").repartition(3)
    want = brute.alignments([r[:2] for r in rows], *plain(library, Pair(A, B)))
    got = [tuple(r) for r in align_tokens(docs, A, B, digest=True).collect()]
    assert sorted(got, key=str) == sorted(((d, *w) for (d, *_), w in zip(rows, want)), key=str)
    assert sum(w[6] == "" for w in want) >= 4


def test_alignment_shows_its_groups(spark):
    docs = spark.createDataFrame([(1, "unbelievable"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in align_tokens(docs, A, B).collect()}
    sides = [g.split("|") for g in rows[1].groups.split(";")]
    assert sum(len(a.split(",")) for a, _ in sides) == rows[1].n_a and sum(len(b.split(",")) for _, b in sides) == rows[1].n_b
    assert tuple(rows[2])[1:] == (0, 0, 0, 0, 0, 0, "") and align_tokens(docs.where("false"), A, B).count() == 0


def test_one_word_in_a_third_of_all_places(spark, library):
    texts = [" ".join(["the"] * 40 + [f"w{zlib.crc32(str(i).encode())}" for _ in range(3)]) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    want = brute.alignments(list(enumerate(texts)), *plain(library, Pair(A, B)))
    got = {r.doc_id: tuple(r)[1:] for r in align_tokens(docs, A, B, digest=True).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_long_text_is_aligned_whole(spark, library):
    text = " ".join(noise(30, 40)).replace("\x00", "") * 4_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = align_tokens(docs, A, B).select("n_a", F.length("groups").alias("n")).first()
    library.encode_special_tokens = True
    assert row.n_a == len(library.encode(" " + text, add_special_tokens=False).ids) and row.n > row.n_a


def small_vocabulary(folder, size=400):
    """Ranks trained on texts of few letters, so that many pairs make the same token; their file."""
    import base64

    rng = random.Random(8)
    seqs = [[bytes([b]) for b in "".join(rng.choice("aabn") for _ in range(rng.randrange(2, 30))).encode()] for _ in range(300)]
    ranks = {bytes([b]): b for b in range(256)}
    while len(ranks) < size:
        pairs = {}
        for s in seqs:
            for pair in zip(s, s[1:]):
                pairs[pair] = pairs.get(pair, 0) + 1
        a, b = max(sorted(p for p in pairs if p[0] + p[1] not in ranks), key=pairs.get)
        ranks[a + b] = len(ranks)
        seqs = [contracted(s, ranks, ranks[a + b]) for s in seqs]
    with open(f"{folder}/ranks", "wb") as out:
        out.writelines(base64.b64encode(t) + f" {r}\n".encode() for t, r in ranks.items())
    return f"{folder}/ranks", ranks


def contracted(tokens, ranks, rank):
    out = []
    for token in tokens:
        if out and ranks.get(out[-1][0] + token) == rank and out[-1][1]:
            out[-1] = (out[-1][0] + token, False)
        else:
            out.append((token, True))
    return [t for t, _ in out]


def plain_bpe(raw, ranks):
    """The leftmost pair of least rank, one after the other."""
    tokens = [bytes([b]) for b in raw]
    while True:
        known = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(tokens, tokens[1:])) if a + b in ranks]
        if not known:
            return [ranks[t] for t in tokens]
        _, i = min(known)
        tokens[i : i + 2] = [tokens[i] + tokens[i + 1]]


def test_contraction_is_the_plain_one(folder):
    from fleetlens.llm.byte_bpe import Coder

    path, ranks = small_vocabulary(folder)
    coder, rng = Coder(path, BYTE_LEVEL), random.Random(9)
    assert coder.con.execute("SELECT count_if(tangled) FROM merges").fetchall()[0][0] > 20
    raws = ["".join(rng.choice("aabnc ") for _ in range(rng.randrange(1, 60))).encode() for _ in range(1500)] + [b"a" * 999, b"ab" * 300, b"banana" * 90]
    want = [plain_bpe(raw, ranks) for raw in raws]
    assert coder._contract(raws) == [(len(w), " ".join(map(str, w)), raw) for w, raw in zip(want, raws)]


def test_a_step_keeps_one_row_a_part(folder):
    import pandas as pd

    from fleetlens.llm import byte_bpe

    path, ranks = small_vocabulary(folder)
    coder = byte_bpe.Coder(path, BYTE_LEVEL)
    coder.con.register("parts", pd.DataFrame({"part": [0, 1], "tokens": ["".join(coder.byte_tokens[b] for b in raw) for raw in (b"ab" * 40, b"c")]}))
    steps = coder.con.execute(byte_bpe._CONTRACT.partition("SELECT l.piece")[0] + "SELECT part, count(*) FROM t GROUP BY part").fetchall()
    assert dict(steps)[1] == 1 and dict(steps)[0] < 40

import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from corpuslens.llm import packing, token_files  # noqa: E402
from corpuslens.llm.tokens import Encoder  # noqa: E402

ODD = ["a  b", " x y ", "a\n b \nc", "it's  ok\t\tx y", "<|endoftext|> hi", "a <|endoftext|> b", "x<|startoftext|><|endoftext|>", " <|endoftext|>  <|endoftext|>\n", "<|EndOfText|> <|endoftext|", "It<|endoftext|>'s  <|startoftext|> 7 ", "don't 's", "\n\n a\n\nb  \n c", "ΑΣ ΑΣ b", "x" * 100 + " " + "y" * 60, "12 345 a1b2 ...!! ?", " ", "ab. cd, 'll x'll ª² İİ, ǅ, ẞ",
       "".join(map(chr, range(32, 600))), " ".join("a" + chr(c) + "b" for c in range(1, 1200)), " ".join("a" + chr(c) + "." for c in range(1, 1200)), " ".join(chr(c) + "," for c in range(1, 1200)), "日本語 テキスト 🙂 ok"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_whole_encoding(texts, name):
    enc = Encoder(P.path(name))
    some = [*texts, *ODD]
    want = Tokenizer.from_file(P.path(name)).encode_batch([t or "" for t in some], add_special_tokens=False)
    for _ in range(2):  # the second time from memory
        for t, w, g in zip(some, want, enc.ids(some)):
            assert np.array(w.ids, enc.dtype).tobytes() == g, t


def plain(name, texts):
    return [[*x.ids, 0] for x in Tokenizer.from_file(P.path(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_files_round_trip(spark, docs, texts, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_files.write_token_files(docs, path, P.path("byte_bpe_50k.json"))
    want, start = plain("byte_bpe_50k.json", texts), 0
    got = {r.doc_id: r for r in token_files.read_token_files(spark, path).collect()}
    digest = {r.doc_id: r for r in token_files.digest_token_files(spark, path).collect()}
    for i, ids in enumerate(want):
        assert list(got[i * 3].ids) == ids and got[i * 3].start == start
        d = digest[i * 3]
        assert (d.start, d.n_tokens, d.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    few = {r.doc_id: list(r.ids) for r in token_files.read_documents(spark, path, [3, 30, 9999]).collect()}
    assert few == {3: want[1], 30: want[10]}
    meta = spark.read.parquet(f"{path}/dictionary").first()
    assert {r.dict_sha256 for r in spark.read.parquet(f"{path}/shards").select("dict_sha256").distinct().collect()} == {meta.dict_sha256}


def test_every_corpus_has_a_dictionary(spark, tmp_path):
    """Long texts only, few short ones, empty ones: all are compressed with a dictionary and come back."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    vocabulary = [word() for _ in range(300)]
    kinds = {"long": [" ".join(rng.choice(vocabulary) for _ in range(2200)) for _ in range(80)], "few": ["one text", "two"], "empty": [""] * 60, "short": [rng.choice(vocabulary) for _ in range(55)]}
    for k, some in kinds.items():
        path = f"file://{tmp_path}/{k}"
        token_files.write_token_files(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), path, P.path("byte_bpe_50k.json"))
        made = bytes(spark.read.parquet(f"{path}/dictionary").first().dictionary)
        assert len(made) > (10_000 if k == "long" else 7), k
        assert {r.doc_id: list(r.ids) for r in token_files.read_token_files(spark, path).collect()} == dict(enumerate(plain("byte_bpe_50k.json", some)))


def test_marks_by_the_library():
    """Ids that the library gives when it loads the file as it is."""
    assert Encoder(P.path("byte_bpe_50k.json")).ids(["a <|endoftext|> b"]) == [np.array([64, 220, 50256, 275], "<u2").tobytes()]


def test_long_texts_and_marks_through_the_queries(spark):
    long = "word, another one 12 " * 60_000  # over a megabyte
    rows = [(3, long), (1, "a <|endoftext|> b"), (2, "x" * 1_200_000), (5, None), (4, "<|startoftext|>" * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, start = dict(zip([r[0] for r in rows], plain("byte_bpe_50k.json", [r[1] for r in rows]))), 0
    got = {r.doc_id: r for r in token_files.op2(df).collect()}
    for i in sorted(want):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(want[i]), zlib.crc32(np.array(want[i], "<u4").tobytes()))
        start += len(want[i])
    ids = dict(zip([r[0] for r in rows], plain("word_bpe_49k.json", [r[1] for r in rows])))
    pieces = {(i, k): zlib.crc32(np.array(x[a : a + 2048], "<u4").tobytes()) for i, x in ids.items() for k, a in enumerate(range(0, len(x), 2048))}
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in packing.op10(df).collect()} == pieces


def test_packing_with_null_and_repeated_ids(spark):
    rows = [(None, "a b"), (None, None), (7, "c"), (7, "c"), (7, "d e f")]
    got = packing.op10(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and {r.sequence_id for r in got} == {got[0].sequence_id} and sorted(r.offset for r in got)[0] == 0
    ends = sorted((r.offset, r.offset + r.length) for r in got)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_token_files_of_nothing_and_of_equal_ids(spark, no_docs):
    assert token_files.op2(no_docs).count() == 0
    df = spark.createDataFrame([(2, "b"), (1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    assert sorted(((r.doc_id or -1, r.start) for r in token_files.op2(df).collect())) == [(-1, 0), (1, 1), (1, 3), (2, 5)]


def test_packing_is_gapless_and_exact(docs, texts):
    want = {(i * 3, k): (a, len(ids[a : a + 64])) for i, ids in enumerate(plain("word_bpe_49k.json", texts)) for k, a in enumerate(range(0, len(ids), 64))}
    rows = packing.best_fit(packing.token_pieces(docs, P.path("word_bpe_49k.json"), 64), 64).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length) for r in rows} == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for a, n in sorted(places):
            assert a == at
            at += n
        assert at <= 64
    assert len(by) <= 1.1 * sum(n for _, n in want.values()) / 64 + 1


def test_best_fit_takes_the_tightest_bin():
    rng = random.Random(1)
    lengths = sorted((rng.randint(1, 50) for _ in range(400)), reverse=True)
    bins, offsets = packing.pack_lengths(lengths, 50)
    left = {}
    for n, b, o in zip(lengths, bins, offsets):
        fits = [x for x in left.values() if x >= n]
        assert (left.get(b, 50) == min(fits)) if fits else b not in left
        assert o == 50 - left.get(b, 50)
        left[b] = left.get(b, 50) - n


def test_packing_of_nothing(no_docs):
    assert packing.op10(no_docs).count() == 0

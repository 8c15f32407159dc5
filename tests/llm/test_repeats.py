import hashlib
import random

import pytest

from corpuslens.llm import repeats


def brute(rows):
    """rows in order: (id, text)."""
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            x = b[p : p + 100]
            if x in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(x)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "chunk", "runs"), [(repeats.HOT_RUNS, repeats.CHUNK_BYTES, repeats.CHUNK_RUNS), (1, 700, 50)])
def test_matches_brute_force(docs, texts, monkeypatch, hot, chunk, runs):
    from pyspark import cloudpickle

    monkeypatch.setattr(repeats, "HOT_RUNS", hot)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(repeats, "CHUNK_RUNS", runs)
    cloudpickle.register_pickle_by_value(repeats)  # so that the workers get the changed numbers
    try:
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.op9(docs).collect())
    finally:
        cloudpickle.unregister_pickle_by_value(repeats)
    assert got == brute([(i * 3, t) for i, t in enumerate(texts)])


def test_repeated_ids_nulls_and_empty_table(spark, no_docs):
    assert repeats.op9(no_docs).count() == 0
    rng = random.Random(1)
    t = "".join(rng.choice("abcdef ") for _ in range(180))
    df = spark.createDataFrame([(5, t), (5, t), (None, t), (7, None), (8, "")], "doc_id long, text string")
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed) for r in repeats.op9(df).collect()))
    assert got == [(-1, 180, 0), (5, 180, 180), (5, 180, 180), (7, 0, 0), (8, 0, 0)]


def test_index_marks_all_but_the_earliest():
    rng = random.Random(4)
    for letters, n in (("ab", 60), ("abcd", 300), ("a", 40)):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, n))).encode() for _ in range(25)]
        texts += [texts[3][5:], texts[7] + texts[3], b"\x00" * 30, b"\x00" * 20]
        index = repeats.RunLengthIndex(texts)
        seen, want, at = set(), [], 0
        for t in texts:
            for p in range(len(t) - 11):
                if t[p : p + 12] in seen:
                    want.append(at + p)
                seen.add(t[p : p + 12])
            at += len(t)
        assert index.repeated(12).tolist() == want
        assert index.lengths.sum() == at and len(index.heads) == len(index.symbols)


def test_index_of_a_repetitive_text_is_as_small_as_its_runs():
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefgh") for _ in range(400)).encode()
    texts = [base * 60, base[100:] * 40, base[::-1]]
    index = repeats.RunLengthIndex(texts)
    m = sum(map(len, texts))
    assert len(index.heads) == len(index.tails) == len(index.symbols) == len(index.lengths) < m / 20
    assert not any(getattr(v, "size", 0) >= m and k not in ("text", "left") for k, v in vars(index).items())
    again = set(index.repeated(50).tolist())
    seen, want, at = set(), set(), 0
    for t in texts:
        for p in range(len(t) - 49):
            if t[p : p + 50] in seen:
                want.add(at + p)
            seen.add(t[p : p + 50])
        at += len(t)
    assert again == want

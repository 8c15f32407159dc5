import math
import zlib
from collections import Counter

import numpy as np
import pytest

from corpuslens.llm import language_model as lm


@pytest.mark.parametrize("max_broadcast", [lm.MAX_BROADCAST, 0])
def test_base_scores_are_exact(docs, texts, max_broadcast):
    toks = {i * 3: [*(t or "").encode().lower().split(), b" "] for i, t in enumerate(texts)}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, x in toks.items() if not held(i) for w in x)
    n, v = sum(c.values()), len(c)
    rows = lm.score_texts(docs, max_broadcast=max_broadcast).collect()
    assert len(rows) == len(texts)
    for r in rows:
        x = toks[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(x), sum(c[w] > 0 for w in x), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), rel_tol=1e-9)
        assert r.score < 0


def test_both_ways_of_scoring_agree(docs):
    """They differ by the filter's false positives only: few, and always towards a higher count."""
    a = {r.doc_id: r for r in lm.score_texts(docs).collect()}
    b = {r.doc_id: r for r in lm.score_texts(docs, max_broadcast=0).collect()}
    n = sum(r.n_tokens for r in a.values())
    assert abs(sum(a[i].score - b[i].score for i in a)) < 0.01 * n
    assert all(abs(a[i].base_score - b[i].base_score) < 1e-6 for i in a)


def test_filter_gives_counts_back():
    rng = np.random.default_rng(2)
    h = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    c = rng.integers(1, 5000, len(h))
    b = lm.bucket_of(h, 7)
    f = lm.Filter([lm.build_segment(h[b == k], c[b == k]) for k in range(7)])
    want = lm.level_counts()[lm.levels(c)]
    assert (f.probe(h) >= want).all() and (f.probe(h) == want).mean() > 0.98
    assert (np.abs(want - c) <= 0.5 * c + 1).all()
    other = np.setdiff1d(rng.integers(0, 2**63, 20_000).astype(np.uint64), h)
    assert (f.probe(other) > 0).mean() < 0.02


def test_repeated_phrases_score_better_on_held_out_texts(spark):
    phrase = " ".join(f"alpha{i} beta{i}" for i in range(30))
    df = spark.createDataFrame([(i, phrase if i % 2 else " ".join(f"w{(i * 37 + k) % 91}" for k in range(40))) for i in range(300)], "doc_id long, text string")
    held = [r for r in lm.score_texts(df).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_nothing_and_null_ids(spark, no_docs):
    assert lm.op7(no_docs).count() == 0
    r = lm.op7(spark.createDataFrame([(None, None)], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.train_tokens) == (False, 1, 1)


def test_levels_stand_for_the_middle_of_their_range():
    c = np.arange(1, 5000)
    q = lm.levels(c)
    for level in np.unique(q)[:-1]:
        assert lm.level_counts()[level] == (c[q == level].min() + c[q == level].max()) / 2


def test_pairs_seen_once_are_in_the_model(spark):
    """A text of pairs that training saw once scores better than one of the same words in an order that it never saw."""
    held = [i for i in range(100) if lm.held_out(i)][:2]
    words = [f"w{k}" for k in range(200)]
    docs = [(next(i for i in range(100) if not lm.held_out(i)), " ".join(words)), (held[0], " ".join(words)), (held[1], " ".join(reversed(words)))]
    got = {r.doc_id: r.score for r in lm.score_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[held[0]] > got[held[1]] + 0.1


def test_scores_do_not_depend_on_the_size_switch(docs, monkeypatch):
    """The same filter is probed on both sides, false positives included; chunks of few tokens as well."""
    want = sorted(map(tuple, lm.score_texts(docs).collect()))
    for size in (lm.CHUNK_TOKENS, 50):
        monkeypatch.setattr(lm, "CHUNK_TOKENS", size)
        got = sorted(map(tuple, lm.score_texts(docs, max_broadcast=0).collect()))
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-12, atol=0)


def test_scores_against_plain_counts(docs, texts):
    """score is P(w | v) of exact counts brought to their levels, but for the filter's false positives: few, and always towards a higher count."""
    toks = {i * 3: [*(t or "").encode().lower().split(), None] for i, t in enumerate(texts)}
    one, two = Counter(), Counter()
    for i, x in toks.items():
        if not lm.held_out(i):
            one.update(x)
            two.update(zip([None, *x], x))
    n, v = sum(one.values()), len(one)
    about = lambda c: float(lm.level_counts()[lm.levels(np.array([c]))[0]]) if c else 0.0
    same = 0
    for r in lm.score_texts(docs).collect():
        x = toks[r.doc_id]
        want = sum(float(lm.smoothed(about(two[a, b]), about(one[a]), about(one[b]), n, v)) for a, b in zip([None, *x], x))
        same += math.isclose(r.score, want, rel_tol=1e-9)
        assert abs(r.score - want) < 3 + 0.02 * len(x)  # a false positive is worth about two
    assert same > 0.6 * len(texts)


def test_long_texts(spark):
    long = "alpha beta gamma " * 120_000  # two megabytes
    got = {r.doc_id: r for r in lm.op7(spark.createDataFrame([(1, long), (2, "x" * 1_500_000), (3, "alpha beta")], "doc_id long, text string")).collect()}
    assert got[1].n_tokens == 360_001 and got[2].n_tokens == 2 and got[3].n_known == 3


def test_nothing_stays_broadcast(spark, docs, monkeypatch):
    """The model is let go when the scores are written; they can be read as often as wanted."""
    import os

    from pyspark import SparkContext

    sent, broadcast = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(broadcast(self, value)) or sent[-1])
    scores = lm.score_texts(docs)
    assert len(sent) == 2 and not any(os.path.exists(b._path) for b in sent)
    assert scores.count() == len(scores.collect()) == docs.count()


def test_little_is_written_beyond_the_broadcast_size(spark, monkeypatch):
    """Pairs are kept in the filter alone, a token of a chunk is a place among its words, an answer a level of one byte for each n-gram."""
    from pyspark.sql import functions as F

    tables, write = {}, lm.materialize
    monkeypatch.setattr(lm, "materialize", lambda df, name, *a, **o: tables.setdefault(name, write(df, name, *a, **o)))
    monkeypatch.setattr(lm, "discard", lambda *_: None, raising=False)
    df = spark.createDataFrame([(i, " ".join(f"w{i * k * k % 499}" for k in range(300))) for i in range(400)], "doc_id long, text string").coalesce(1)
    n = sum(r.n_tokens for r in lm.score_texts(df, max_broadcast=0).collect())
    size = lambda name, *columns: tables[name].agg(F.sum(sum((F.coalesce(F.length(c), F.lit(0)) for c in columns), F.lit(0)))).first()[0]
    tables["pairs"] = tables["ngram-counts"].where("kind = 2")
    assert size("pairs", "hashes", "counts") == 0 < size("pairs", "segment")
    assert size("chunks", *(c for c, kind in tables["chunks"].dtypes if kind == "binary")) < 5 * n
    assert size("answers", "exact", "level") < 2 * n


def test_packed_arrays_come_back():
    for x in (np.arange(7, dtype=np.uint64) * 2**40, np.array([5, 70_000], np.uint32), np.zeros(0, np.int64)):
        assert (lm._unpack(lm._pack(x), x.dtype) == x).all() and len(lm._pack(x)) == x.nbytes

"""The stages and run() against plain Python and SQL versions that share no code with them but the pseudonyms' own function."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from corpuslens.llm import pii, quality
from tests.llm.test_mixing import plan_by_hand
from tests.llm.test_shingle_join import brute

P = pytest.importorskip("public_tokenizers")
duckdb = pytest.importorskip("duckdb")


def pieces_of(rows):
    """(doc_id, piece, start, length, crc32) by the tokenizers library as it loads its file."""
    from tokenizers import Tokenizer

    tok, out = Tokenizer.from_file(P.path("word_bpe_49k.json")), []
    for r in rows:
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            x = ids[a : a + 2048]
            out.append((r.doc_id, k, a, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    return sorted(out, key=str)


def gapless(rows, capacity=2048):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    for x in by.values():
        x.sort()
        assert x[0][0] == 0 and x[-1][1] <= capacity and all(a[1] == b[0] for a, b in zip(x, x[1:]))
    return len(by)


def test_stages_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality rules", "n-gram Jaccard join", "personal data", "source mix", "best-fit packing"]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    names = [x[0] for x in con.execute(quality.OP3_SQL).description]
    good = {r[names.index("doc_id")] for r in con.execute(quality.OP3_SQL).fetchall() if r[names.index("kept")]}
    kept = cp.quality_rules(spark, docs, sf)
    rows = kept.collect()
    assert kept.columns == list(cp.COLUMNS) and {r.doc_id for r in rows} == good
    one = cp.near_duplicates(spark, kept, sf)
    assert one.columns == list(cp.COLUMNS)
    one = one.collect()
    assert {r.doc_id for r in one} == {v[1] for v in brute([(r.doc_id, r.text) for r in rows], 5, 80, 100).values()}
    private = {r.doc_id: r for r in cp.personal_data(spark, spark.createDataFrame(one, docs.schema), sf).collect()}
    assert all(private[r.doc_id].text == pii.pseudonymize_text(r.text, pii.session_key(spark))[0] and private[r.doc_id].n_chars == len(private[r.doc_id].text) for r in one)
    mixed = cp.source_mix(spark, spark.createDataFrame(list(private.values()), docs.schema), sf)
    assert mixed.columns == list(cp.COLUMNS)
    mixed = mixed.collect()
    plan = plan_by_hand([(r.doc_id, r.source, r.text) for r in private.values()])
    want = Counter({k[0]: int(taken / len(k[2].split()) + 0.5) for k, (taken, _) in plan.items() if k[2].strip()})
    assert Counter(r.doc_id for r in mixed) == +want
    packed = cp.run(spark, sf).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed), key=str) == pieces_of(mixed)
    assert gapless(packed) <= 1.02 * -(-sum(r.length for r in packed) // 2048) + 1


def test_odd_rows_in_every_stage(spark, docs, no_docs, texts):
    """Nulls in any column, shared and repeated ids, very long texts, other columns of clashing names, and nothing at all."""
    t = [" ".join(f"the {p}{k} of and to in" for k in range(40)) for p in "abcdef"]
    odd = [(None, t[0], None, None, None), (None, t[1], "en", "s", 1), (4, t[2], "en", None, 5), (4, t[3], None, "s", 5), (4, t[3], None, "s", 5), (5, t[3], "en", "s", 5), (7, None, "en", "s", None), (8, "", "en", "s", 0), (9, t[4] * 3000, "en", "s", 9)]
    df = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").unionByName(docs.select(*cp.COLUMNS).limit(40))
    df = df.selectExpr("*", "1 as n", "'x' as pii", "doc_id as name", "'y' as row", "2 as slot", "'z' as _k")
    before = df
    for name, stage in cp.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, "").collect(), df.select(*cp.COLUMNS).schema)
        assert after.columns == list(cp.COLUMNS), name
        before = after
    near = Counter((r.doc_id, r.text) for r in cp.near_duplicates(spark, df, "").collect())
    assert near[None, t[0]] == near[None, t[1]] == near[4, t[2]] == near[4, t[3]] == near[7, None] == near[8, ""] == near[9, t[4] * 3000] == 1 and near[5, t[3]] == 0
    last = cp.best_fit_packing(spark, before, "").collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in last), key=str) == pieces_of(before.collect())
    gapless(last)
    for name, stage in cp.STAGES:
        assert stage(spark, no_docs.select(*cp.COLUMNS), "").count() == 0, name

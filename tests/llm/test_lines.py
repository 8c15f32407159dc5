"""Line dedup against plain Python."""

import hashlib
import random
from collections import defaultdict

import pytest

from corpuslens.llm import keyed, lines

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=20, min_documents=3):
    """(doc_id, n_lines, n_dropped, text) of each row."""
    holders = defaultdict(set)
    key = lambda x: x.strip(BLANK).translate(LOWER)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(i)
    low = lambda i: (i is not None, i or 0)
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if len(holders.get(key(x), ())) < min_documents or max(holders[key(x)], key=low) == i]
        out.append((i, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    pool = ["  Terms of use apply to this page. ", "terms of USE apply to this page.", "\tAll rights reserved, é and É differ\r", "ALL RIGHTS RESERVED, É AND É DIFFER", "short", "", "x" * 19, "X" * 20, "\x0bx" * 12, "line of no-break space kept ", " line of no-break space kept "]
    out = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else "own line number %d of a text" % rng.randrange(10**6) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    out += [(100, None), (101, ""), (102, "\n\n"), (103, "\n".join(pool * 300)), (7, out[7][1]), (8, "another text of id 8\n" + pool[0]), (None, pool[0] + "\n" + pool[7]), (None, pool[7])]
    return out


@pytest.mark.parametrize("heavy", [keyed.HEAVY, 0.2, 2.0])
def test_against_plain_python(spark, rows, monkeypatch, heavy):
    monkeypatch.setattr(keyed, "HEAVY", heavy)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for least, n in ((20, 3), (1, 1), (5, 2)):
        got = [tuple(r) for r in lines.drop_shared_lines(docs, least, n).select("doc_id", "n_lines", "n_dropped", "text").collect()]
        assert sorted(got, key=repr) == brute(rows, least, n)
    want = sorted((i, a, b, hashlib.sha256(t.encode()).hexdigest()) for i, a, b, t in brute([r for r in rows if r[0] is not None]))
    assert sorted(tuple(r) for r in lines.op12(docs.where("doc_id is not null")).collect()) == want


def test_names_of_its_own_and_empty_tables(spark, docs, no_docs):
    odd = docs.withColumnsRenamed({"node": "row", "rep": "digest", "kept": "places", "pii": "n_lines", "size": "id"})
    got = lines.drop_shared_lines(odd)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "digest", "q", "places", "key", "id", "n_lines", "n_dropped"]
    assert got.count() == docs.count() and {r["id"] for r in got.select("id").collect()} == {1}
    assert lines.drop_shared_lines(no_docs).count() == 0 and lines.op12(no_docs).count() == 0

import random
from collections import defaultdict

import numpy as np
import pytest

from corpuslens.llm import shingle_join as sj


def shingle_set(t, n):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n, num, den):
    sets = {i: shingle_set(t, n) for i, t in rows}
    parent, links = {i: i for i in sets}, defaultdict(int)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), links[i]) for i in sets}


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100)])
@pytest.mark.parametrize("block", [sj.BLOCK_SHINGLES, 200])
def test_matches_brute_force(docs, texts, n, num, den, block):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in sj.jaccard_components(docs, n, num, den, block=block).collect()}
    assert got == brute([(i * 3, t) for i, t in enumerate(texts)], n, num, den)


def test_short_lists_lose_no_pair():
    """Sets that link share a shingle of their short lists, whatever the sketch says, and are brought together by it."""
    rng = np.random.default_rng(1)
    for num, den in ((90, 100), (80, 100)):
        for size in (1, 2, 9, 17, 30, 81, 200, 700):
            for _ in range(30):
                cells = (rng.random(sj.CELLS) < 0.3).astype(np.uint32) * rng.integers(0, 5, sj.CELLS, dtype=np.uint32)
                a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2))
                d = int(len(a) * (den - num) // den)
                for cut in {0, d // 2, d}:
                    b = np.unique(np.r_[a[cut:], rng.integers(0, 2**63, d - cut).astype(np.uint64)])
                    both = len(np.intersect1d(a, b))
                    if den * both >= num * (len(a) + len(b) - both):
                        x, y = sj.short_lists(a, cells, num, den), sj.short_lists(b, cells, num, den)
                        assert len(np.intersect1d(x, y))
                        lo = np.repeat([sj.size_level(len(a), num, den), sj.size_level(len(b), num, den)], [len(x), len(y)])
                        *_, p, q, who, times = sj.stars(np.r_[x, y], np.repeat([1, 2], [len(x), len(y)]), lo, lo)
                        assert who.tolist() == [1, 2] and min(times) >= min(sj.meetings(len(a)), sj.meetings(len(b)))
                        assert list(zip(p, q)) in ([(1, 2)], [(2, 1)])


def test_stars_part_lists_by_size():
    """Members of a list are joined exactly when a chain of close enough sizes leads from one to the other; in two steps as well."""
    rng = np.random.default_rng(2)
    for _ in range(60):
        token, node = rng.integers(0, 4, 40).astype(np.uint64), np.arange(40)
        level = rng.integers(0, 200, 40)

        def parts(edges):
            of = {int(k): int(k) for k in node}
            for a, b in edges:
                a, b = of[a], of[b]
                of = {k: b if v == a else v for k, v in of.items()}
            return {frozenset(k for k in of if of[k] == v) for v in of.values()}

        want = parts((int(i), int(j)) for i in node for j in node if token[i] == token[j] and abs(level[i] - level[j]) <= sj.NEAR)
        *_, a, b, who, times = sj.stars(token, node, level, level)
        count = dict(zip(who.tolist(), times.tolist()))
        assert set(count) == {k for p in want if len(p) > 1 for k in p} and set(count.values()) <= {1}
        assert parts(zip(a.tolist(), b.tolist())) == want
        halves = [sj.stars(token[i], node[i], level[i], level[i]) for i in (slice(0, 17), slice(17, 40))]
        met = sj.stars(*(np.concatenate([h[k] for h in halves]) for k in range(5)))
        packed = [sj._unpacked(sj._packed(*h[:5])) for h in halves]
        again = sj.stars(*(np.concatenate([h[k] for h in packed]) for k in range(5)))
        in_steps = [k for h in (*halves, met) for k in h[7].tolist()]
        assert sorted(in_steps) == sorted(count)  # each is counted once, where it first meets another
        assert [x.tolist() for x in again] == [x.tolist() for x in met]
        assert parts((int(x), int(y)) for h in (*halves, met) for x, y in zip(h[5], h[6])) == want


def test_search_matches_brute_force_on_dense_and_thin_lists():
    rng = random.Random(3)
    for universe in (12, 60, 2000):
        sets = sorted((np.unique(np.array([rng.randrange(universe) for _ in range(rng.randint(1, 40))], np.uint64)) for _ in range(80)), key=len)
        lists = sj.Lists(sets, 80, 100)
        for i, s in enumerate(sets):
            want = [j for j in range(i) if 100 * len(np.intersect1d(s, sets[j])) >= 80 * len(np.union1d(s, sets[j]))]
            assert sorted(lists.search(s, below=i).tolist()) == want


def test_empty_table_and_null_ids(spark, no_docs):
    assert sj.op1(no_docs).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.n_links) for r in sj.op1(df).collect()), key=str)
    assert got == sorted([(None, 4, 2), (4, 4, 2), (4, 4, 2), (None, None, 0)], key=str)


def test_null_and_shared_ids_find_near_copies(spark):
    """Rows go by their texts: against all pairs of rows, whatever their ids."""
    rng = random.Random(12)
    bases = [[f"{p}{k}" for k in range(120)] for p in "abcdef"]

    def near(words, changes):
        out = list(words)
        for i in rng.sample(range(len(out)), changes):
            out[i] = f"new{rng.randrange(10**6)}"
        return " ".join(out)

    rows = [(3, " ".join(bases[0])), (None, near(bases[0], 1)), (None, near(bases[0], 1)), (None, near(bases[1], 1)), (None, near(bases[1], 1)), (None, near(bases[1], 1))]
    rows += [(5, " ".join(bases[2])), (5, " ".join(bases[3])), (5, " ".join(bases[4])), (9, near(bases[2], 1)), (8, near(bases[3], 1)), (None, near(bases[4], 1)), (None, None), (None, ""), (7, "")]
    rows += [rows[1], rows[6]]
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} if w else set())
    linked = [[j for j in range(len(rows)) if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])] for i in range(len(rows))]
    want = []
    for i, (doc, _) in enumerate(rows):
        reach, todo = {i}, [i]
        while todo:
            new = [j for j in linked[todo.pop()] if j not in reach]
            reach.update(new)
            todo += new
        ids = [rows[j][0] for j in reach if rows[j][0] is not None]
        want.append((doc, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc, len(linked[i])))
    got = [tuple(r)[:4] for r in sj.op1(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "n_shingles", "component_id", "n_links").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(x > 0 for *_, x in want) >= 12


def test_one_of_each_group_stays(docs, texts):
    kept = [r.doc_id for r in sj.near_duplicates_removed(docs).collect()]
    want = brute([(i * 3, t) for i, t in enumerate(texts)], 5, 80, 100)
    assert sorted(kept) == sorted({v[1] for v in want.values()})


def test_rows_without_or_with_shared_ids_stay(spark):
    t = [" ".join(f"{p}{k}" for k in range(30)) for p in "abcd"]
    rows = [(None, t[0]), (None, t[1]), (4, t[2]), (4, t[3]), (4, t[3]), (5, t[3]), (7, t[0]), (8, None), (None, None)]
    kept = sj.near_duplicates_removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, t[1]), (4, t[2]), (4, t[3]), (7, t[0]), (8, None), (None, None)]
    assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)


def test_a_task_settles_its_lists_in_parts(monkeypatch):
    """What a task has gathered is settled part by part, in a bounded memory, and tokenizers of earlier tasks go first."""
    import tracemalloc

    import pyarrow as pa

    from corpuslens.llm import tokens

    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choices(vocabulary, k=1000)).encode() for _ in range(1500)]
    tasks = []

    class Docs:
        def mapInArrow(self, f, schema):
            tasks.append(f)
            raise LookupError

    sketch = type("Sent", (), {"value": np.zeros(sj.CELLS, np.uint32)})
    with pytest.raises(LookupError):
        sj.short_list_meetings(Docs(), 5, 80, 100, sketch, 16, True)
    monkeypatch.setitem(tokens._encoders, ("left", False), object())
    batches = iter([pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t], pa.binary())], names=["row_key", "text"]) for i, t in enumerate(texts)])
    tracemalloc.start()
    posts = 0
    for b in tasks[0](batches):
        posts += sum(len(sj._unpacked(x.as_py())[0]) for k, x in zip(b.column(0).to_pylist(), b.column(3)) if k >= 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not tokens._encoders
    assert posts > sj.CHUNK and peak < 60e6

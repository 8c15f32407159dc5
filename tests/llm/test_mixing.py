from collections import Counter, defaultdict

import pytest

from corpuslens.llm import mixing


def plan_by_hand(rows, weights=(1, 2, 3), block=mixing.BLOCK):
    """(taken, first slot) by (key, source, text) of different rows: points, slots and blocks in plain Python."""
    import hashlib
    import re

    size = {r: len(re.findall(r"[^\x20\x09-\x0D]+", r[2] or "")) for r in rows}
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for r, n in size.items() if r[1] == s) for s in sources}
    w = {s: weights[i % 3] for i, s in enumerate(sources)}
    target, open_, left = {}, set(sources), float(sum(total.values()))
    while True:  # reshare what is above the cap until none is
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * total[s]}
        if not above:
            target |= share
            break
        for s in above:
            target[s] = 3.0 * total[s]
            left -= target[s]
        open_ -= above
        if not open_:
            break
    use = [s for s in sources if min(int(target[s] + 0.5), 3 * total[s]) > 0]
    blocks = {s: -(-total[s] // block) for s in use}
    words = {s: min(int(target[s] + 0.5), 3 * total[s]) for s in use}
    slots = {s: words[s] // total[s] * blocks[s] + -(-(words[s] % total[s]) // block) for s in use}
    ends, n = {}, 0
    for s in use:
        n += slots[s]
        ends[s] = int(n / sum(slots.values()) * mixing.POINTS)
    order = {s: [] for s in use}
    for t in range(sum(slots.values())):
        u = t * mixing.GOLDEN % mixing.POINTS
        s = next(s for s in use if u < ends[s])
        if len(order[s]) < 3 * blocks[s]:
            order[s].append(t)
    out = {r: (0, None) for r in rows}
    for s in use:
        at, read = 0, []
        for r in range(len(order[s])):  # places of the words of each slot's block, until the target is reached
            read += range(r % blocks[s] * block, min((r % blocks[s] + 1) * block, total[s]))
        read = Counter(read[: words[s]])
        own = [r for r in rows if r[1] == s and size[r]]
        copy = {r: hashlib.md5(r[2].encode()).hexdigest() + "-1" for r in own}
        for r in sorted(own, key=lambda r: (hashlib.md5("/".join(([] if r[0] is None else [str(r[0])]) + [copy[r]]).encode()).hexdigest()[:12], r[0] or 0)):
            taken = sum(read[at + i] for i in range(size[r]))
            out[r] = (taken, order[s][at // block] if taken else None)
            at += size[r]
    return out


@pytest.mark.parametrize("block", [16, mixing.BLOCK])
def test_the_points_decide(docs, texts, block):
    rows = [(i * 3, None if i % 11 == 0 else f"s{i % 4}", t) for i, t in enumerate(texts) if len(t or "") < 5000]
    df = docs.where("text is null or length(text) < 5000")
    want = plan_by_hand(rows, block=block)
    got = {(r.key, r.source, texts[r.key // 3]): (r.taken, r.first_slot) for r in mixing.mix_sources(df, block=block).collect()}
    assert got == want


def test_long_texts(spark):
    df = spark.createDataFrame([(1, "word " * 300_000, "a"), (2, "x " * 20, "b"), (3, "y" * 1_500_000, "b")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.op5(df).collect()}
    assert got[1].size == 300_000 and abs(got[1].taken - got[1].target) <= 3 * mixing.BLOCK and got[2].taken + got[3].taken <= 63


def test_sources_meet_their_targets(docs, texts):
    rows = mixing.mix_sources(docs, block=16).collect()
    assert len(rows) == len(texts)
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.size == len((texts[r.key // 3] or "").replace(" ", "_").split())
        by[r.source].append(r)
    assert set(by) == {None, "s0", "s1", "s2", "s3"}
    for x in by.values():  # the points decide how many slots a source gets: within a few blocks of its target
        assert -4 * 16 <= sum(r.taken for r in x) - x[0].target <= 1 and x[0].source_size == sum(r.size for r in x)
    assert abs(sum(x[0].target for x in by.values()) - sum(r.size for r in rows)) < 1e-6


def test_targets_stop_at_three_times_the_source(spark):
    sized = spark.createDataFrame([("a", 100), ("b", 1), ("c", 10), (None, 5), ("z", 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sized).collect()}
    # a..z weigh 1, 2, 3, 1 and null 2; b, c and null reach their caps, z has nothing
    assert got["b"] == 3 and got["c"] == 30 and got[None] == 15 and got["z"] == 0 and abs(got["a"] - 68) < 1e-9


def test_reruns_and_partitions_agree(docs):
    a = sorted(map(str, mixing.op5(docs).collect()))
    assert a == sorted(map(str, mixing.op5(docs.repartition(1)).collect()))


def test_schedule_is_even_in_every_run_of_slots(spark, docs):
    rows = mixing.reading_order(docs, block=16).select("slot", "source").distinct().collect()
    slots = dict((r.slot, r.source) for r in rows)
    total, n = Counter(slots.values()), len(slots)
    half = Counter(s for t, s in slots.items() if t < n // 2)
    for s, k in total.items():
        assert abs(half[s] - k / 2) <= 4


def test_repeated_rows_and_empty_table(spark, no_docs):
    df = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "x"), (1, None, "x"), (None, "d e", None)], "doc_id long, text string, source string")
    rows = mixing.op5(df).collect()
    assert len(rows) == 4 and abs(sum(r.taken for r in rows) - 8) <= 1
    assert mixing.op5(no_docs).count() == 0


def test_mixed_documents_keep_their_columns(docs):
    m = mixing.mixed_documents(docs)
    assert m.columns == docs.columns
    n = Counter(r.doc_id for r in m.collect())
    assert n and max(n.values()) <= 3


def test_native_plan(docs):
    plan = mixing.op5(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan

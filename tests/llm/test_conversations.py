"""Conversation repair against a search over all edits in plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from corpuslens.llm import conversations as conv

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_damage(rows):
    one = lambda x: " " if x is None else str(x)
    out = []
    for c, t, role, text in rows:
        role, text = one(role), one(text)
        fate = zlib.crc32(f"{one(c)}:{one(t)}".encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(c, t, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def brute_conversation(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of one conversation's rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        last = re.sub("[\x20\x09-\x0d]", "", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None)
        seen.add((role, text))

    @lru_cache(None)
    def best(i, done, inserted):
        """(cost, letters, repaired) of the cheapest end from row i with the roles' initials so far as done (s, u, a or nothing)."""
        out = []
        if i == len(rows) and done in ("", "a"):
            out.append((0, "", ()))
        if i < len(rows):
            cost, letters, kept = best(i + 1, done, 0)
            out.append((cost + 2, "D" + letters, kept))
        for letter, price, role in [("I", 5, "user"), ("I", 5, "assistant"), ("K", 0, None), ("R", 1, "user"), ("R", 1, "assistant")]:
            if letter == "I" and inserted == 3 or letter != "I" and (i == len(rows) or faults[i] in ("blank", "duplicate")):
                continue
            new = role or rows[i][2]
            if (done, new[:1]) not in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                continue
            cost, letters, kept = best(i if letter == "I" else i + 1, new[:1], inserted + 1 if letter == "I" else 0)
            price += 5 if letter != "I" and faults[i] == "truncated" else 0
            out.append((cost + price, letter + letters, ((new, "" if letter == "I" else rows[i][3]), *kept)))
        return min(out, key=lambda x: x[:2]) if out else (10**9, "", ())

    cost, audit, kept = best(0, "", 0)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    return {c: brute_conversation(v) for c, v in by.items()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    said = ["Yes.", "No!", "Why?", "and then", "", " \t\n", "Yes.  \n", "é.", "ends with no-break space. ", "a. b", None, "x" * 5000 + "."]
    out = []
    for c in range(70):
        roles = rng.choice([["user", "assistant"], ["system", "user", "assistant"], ["user"], ["assistant", "tool", None, ""], ["user", "assistant", "umpire", "system"]])
        n = rng.choice([0, 1, 2, 3, 5, 8, 14, 30])
        for t in range(n):
            role = rng.choice(roles) if rng.random() < 0.5 else ("user", "assistant")[t % 2]
            text = rng.choice(said) if rng.random() < 0.5 else f"Turn {rng.randrange(999)}."
            out.append((None if c == 5 else c, None if rng.random() < 0.05 else t * rng.choice([1, 1, 1, 2]), role, text))
    return out + out[40:44] + [(900, t, ("user", "assistant")[t % 2], f"Long {t}.") for t in range(60)] + [(901, t, "tool", f"Tool {t}.") for t in range(40)] + [(902, None, "user", "Same.")] * 20


@pytest.mark.parametrize("size", [conv.CHUNK, 3, 1])
def test_against_all_edits(spark, rows, size):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["conv_id"]: tuple(r[1:]) for r in conv.digest(conv.repair(df, size)).collect()}
    one = lambda x: " " if x is None else x
    assert got == brute([(c, t, one(r), one(x)) for c, t, r, x in rows])


def test_query(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = dict.fromkeys({r[0] for r in rows}, (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())) | brute(brute_damage(rows))
    got = conv.op13(df)
    assert {r["conv_id"]: tuple(r[1:]) for r in got.collect()} == want
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_edits_are_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Hello."), (1, 2, "user", "")], SCHEMA).withColumns({"cid": F.lit(1), "chunk": F.lit(2), "fault": F.lit("x"), "row_id": F.lit(3)})
    got = conv.repair(df).orderBy("chunk", "step").select("turn", "old_role", "role", "text", "fault", "edit", "cost").collect()
    assert [tuple(r) for r in got] == [(0, "user", "user", "Hi.", None, "K", 0), (1, "assistant", "assistant", "Hello.", None, "K", 0), (2, "user", "user", "", "blank", "D", 2)]


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conv.repair(none).count() == 0 and conv.op13(none).count() == 0


def test_costs_by_chunks_are_the_whole_conversations():
    rng = random.Random(2)
    steps = conv.Steps()
    for _ in range(300):
        codes = bytes(rng.choice([0, 1, 2, 3, 4, 6, 7]) for _ in range(rng.randrange(1, 60)))
        cut = rng.randrange(len(codes) + 1)
        whole = conv.run_back(steps, codes, conv.END)
        right = tuple(conv.run_back(steps, codes[cut:], conv.END))
        guess = conv.run_back(steps, codes[:cut], conv.END)
        assert conv.run_again(steps, codes[:cut], conv.END, guess, right) == whole


def test_passes_are_few(spark):
    """A conversation in 200 chunks: its chunks' first vectors agree up to constants but for the last ones."""
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "tool"]), f"Turn {t}" + rng.choice([".", ""])) for t in range(1000)]
    _, coded = conv.faults(spark.createDataFrame(rows, SCHEMA))
    chunks = conv.materialize(conv.chunked(coded, 5), "test-chunks")
    assert chunks.count() >= 200
    ends, passes = conv.settled(chunks)
    assert ends.count() >= 200 and passes <= 12

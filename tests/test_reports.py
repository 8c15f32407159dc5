"""The quality report against the single operators, and near hashes against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import profile, similarity


def expected(df):
    """Findings put together from the single operators."""
    types = {r["column"]: r["type"] for r in profile.infer_types(df).collect()}
    found = {("Issues", "Empty column", c, "no filled cell") for c, k in types.items() if k == "empty"}
    found |= {("Issues", "Sparse column", r["column"], f"{r['fill_percent']}% filled") for r in profile.fill_rates(df).collect() if r["filled"] and r["fill_percent"] < 50}
    found |= {("Issues", "Constant column", r["column"], r["value"]) for r in profile.constant_columns(df).collect()}
    twice = profile.duplicate_rows(df).first()["duplicates"]
    found |= {("Issues", "Duplicate rows", "rows", str(twice))} if twice else set()
    texts, numbers = ([c for c, k in types.items() if k == kind] for kind in ("text", "number"))
    for r in profile.cardinality_flags(df, texts).collect() if texts else []:
        if r["identifier_like"]:
            found.add(("Anomalies", "Identifier-like column", r["column"], f"{r['distinct']} different values"))
        if r["dominated"]:
            found.add(("Anomalies", "Dominated column", r["column"], f"{r['top_n']} of {r['filled']}"))
    for r in profile.numeric_outliers(df, numbers).where("rank = 1").collect() if numbers else []:
        found.add(("Anomalies", "Outliers", r["column"], str(r["outliers"])))
    return found or {("Issues", "Result", "table", "no issues found")}


def random_table(rng, n):
    kinds = {
        "id": lambda i: f"k{i}",
        "nearly": lambda i: f"k{max(i, 1)}",
        "same": lambda i: "x" if rng.random() < 0.97 else f"y{i}",
        "even": lambda i: rng.choice("ab"),
        "one": lambda i: " v ",
        "none": lambda i: rng.choice([None, "", "  "]),
        "few": lambda i: "f" if rng.random() < 0.3 else None,
        "number": lambda i: str(rng.gauss(0, 1)) if rng.random() < 0.97 else "90.5",
        "level": lambda i: "7",
        "date": lambda i: f"2024-01-{i % 28 + 1:02d}",
        "mixed": lambda i: rng.choice(["1", "2", "3", "4", "n/a"]) if rng.random() < 0.9 else "word",
        "odd name.x": lambda i: rng.choice(["p", "q"]),
    }
    names = rng.sample(sorted(kinds), rng.randrange(1, 8))
    rows = [[kinds[c](i) for c in names] for i in range(n)]
    return names, rows + (rows[: rng.randrange(3)] if rows else [])


@pytest.mark.parametrize("seed", range(6))
def test_report_is_what_the_operators_find(spark, seed):
    rng = random.Random(seed)
    names, rows = random_table(rng, rng.choice([0, 1, 2, 5, 300]))
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in names)).repartition(3)
    got = [(r.section, r.grp, r.field, r.value) for r in profile.quality_report(df, "t").collect()]
    assert len(got) == len(set(got)) and set(got) == expected(df)


def test_typed_columns_and_two_readings(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet").withColumn("big", F.when(F.col("o_orderkey") % 500 == 0, 1e9).otherwise(F.col("o_totalprice")))
    report = profile.quality_report(df, "orders")
    assert {(r.section, r.grp, r.field, r.value) for r in report.collect()} == expected(df)
    plan = report._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1  # the other reading was the counters' own


@pytest.mark.parametrize("most", [0, 5, 7, 8, 20, 33])
def test_near_hashes(spark, most):
    rng = random.Random(most)
    hashes = [rng.getrandbits(64) for _ in range(60)]
    for h in hashes[:40]:
        for bits in (1, most // 2, most, most + 1):
            hashes.append(h ^ sum(1 << b for b in rng.sample(range(64), min(64, bits))))
    hashes += hashes[:5] + [None, None, 0, (1 << 64) - 1]
    signed = lambda h: None if h is None else h - (1 << 64) if h >> 63 else h
    rows = [(1000 - i, signed(h)) for i, h in enumerate(hashes)]
    df = spark.createDataFrame(rows, "id long, hash long").repartition(4)
    by = {}
    for i, h in rows:
        if h is not None:
            by.setdefault(h, []).append(i)
    low = {h: min(v) for h, v in by.items()}
    want = {(low[h], i, 0) for h, v in by.items() for i in v if i != low[h]}
    keys = sorted(low, key=low.get)
    for p, x in enumerate(keys):
        for y in keys[p + 1 :]:
            d = ((x ^ y) & (1 << 64) - 1).bit_count()
            if d <= most:
                want.add((low[x], low[y], d))
    got = [tuple(r) for r in similarity.near_duplicates(df, most, block=16).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_no_hashes(spark):
    none = spark.createDataFrame([("a", None)], "id string, hash long")
    assert similarity.near_duplicates(none, 20).count() == similarity.near_duplicates(none, 3).count() == 0

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import profile


def test_types_by_majority(spark):
    rows = [("1", "2024-01-02", "x", "", "0x10")] * 8 + [("a", "b", "y", None, "1,000")] * 2
    got = {r.column: r.type for r in profile.infer_types(spark.createDataFrame(rows, "a string, b string, c string, d string, e string")).collect()}
    assert got == {"a": "text", "b": "text", "c": "text", "d": "empty", "e": "text"}  # exactly 80 % is not enough
    rows.append(rows[0])
    got = {r.column: r.type for r in profile.infer_types(spark.createDataFrame(rows, "a string, b string, c string, d string, e string")).collect()}
    assert got == {"a": "number", "b": "date", "c": "text", "d": "empty", "e": "number"}


def test_numbers_and_outliers(spark):
    df = spark.createDataFrame([(str(x),) for x in [*range(1, 5), "0x10", "", "x"]], "v string")
    r = profile.profile_numbers(df, ["v"]).first()
    assert (r.n, r.min, r.max, r.median, r.q1) == (5, 1, 16, 3, 2)
    df = spark.createDataFrame([(float(x % 10),) for x in range(100)] + [(1000.0,)], "v double")
    assert [(r.outliers, r.value) for r in profile.numeric_outliers(df, ["v"]).collect()] == [(1, 1000.0)]


def test_constant_flags_and_duplicates(spark):
    df = spark.createDataFrame([("a", str(i), "k") for i in range(19)] + [("b", "19", "k"), ("b", "19", "k")], "x string, y string, z string")
    assert [(r.column, r.n) for r in profile.constant_columns(df).collect()] == [("z", 21)]
    f = {r.column: r for r in profile.cardinality_flags(df.limit(20)).collect()}
    assert f["x"].dominated and f["y"].identifier_like and not f["z"].dominated  # 19 of 20 is exactly 95 %
    assert tuple(profile.duplicate_rows(df).first()) == (21, 1)
    assert tuple(profile.duplicate_rows(df.limit(0)).first()) == (0, 0)


def test_dialect(spark):
    t = [("a.csv", "a;b;c\r\n1;2;3"), ("b.tsv", "a,b\n"), ("c.csv", "﻿abc"), ("d.csv", "a|b,c\n\r\n"), ("e.csv", None)]
    got = {r.path: (r.separator, r.bom, r.line_end) for r in profile.detect_dialect(spark.createDataFrame(t, "path string, text string")).collect()}
    assert got["a.csv"] == (";", False, "CRLF") and got["b.tsv"] == ("\t", False, "LF") and got["c.csv"] == (",", True, "none") and got["d.csv"] == (",", False, "mixed")


def test_ragged(spark):
    rows = [("f", 0, ["a", "b"]), ("f", 1, ["1", "2"]), ("f", 2, ["1"]), ("g", 0, ["a"])]
    got = {r.path: (r.data_rows, r.ragged, r.confidence) for r in profile.ragged_rows(spark.createDataFrame(rows, "path string, row_no long, cells array<string>")).collect()}
    assert got == {"f": (2, 1, 50), "g": (0, 0, 100)}


@pytest.mark.parametrize(("days", "step"), [((1, 2, 3, 4), "1 day"), ((1, 3, 5), "2 days"), ((1, 2, 4), None), ((1, 2), None), ((1, 1, 2, 3), None)])
def test_cadence(spark, days, step):
    df = spark.createDataFrame([("k", f"2024-01-{d:02d}") for d in days], "k string, d string").select("k", F.to_timestamp("d").alias("d"))
    assert [r.step for r in profile.regular_cadence(df, ["k"], "d").collect()] == ([step] if step else [])


def test_report(spark):
    df = spark.createDataFrame([("1", "x", None), ("1", "x", None), ("1", "y", None)], "a string, b string, c string")
    got = {(r.grp, r.field) for r in profile.quality_report(df, "t").collect()}
    assert got == {("Empty column", "c"), ("Constant column", "a"), ("Duplicate rows", "rows")}
    clean = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "y")], "a string, b string")
    assert [r.value for r in profile.quality_report(clean, "t").collect()] == ["no issues found"]


def test_quantiles_by_ranges_equal_interpolation(spark):
    import random

    rng = random.Random(4)
    cols = {"a": [rng.randrange(20) for _ in range(501)], "b": [rng.gauss(0, 1) for _ in range(400)], "c": [7.5], "d": [1.0, 2.0]}
    df = spark.createDataFrame([(k, float(x)) for k, v in cols.items() for x in v] + [("a", None)], "column string, x double").repartition(7)
    got = {(r.column, r.p): r.q for r in profile.exact_quantiles(df, (0.0, 0.25, 0.5, 0.9, 1.0)).collect()}
    for k, v in cols.items():
        v = sorted(v)
        for p in (0.0, 0.25, 0.5, 0.9, 1.0):
            at = p * (len(v) - 1)
            low = int(at)
            assert abs(got[k, p] - (v[low] + (at - low) * (v[min(low + 1, len(v) - 1)] - v[low]))) < 1e-9
    assert profile.exact_quantiles(df.where("x is null"), (0.5,)).count() == 0

"""Delimited text read in blocks against a walk over each whole text, character by character."""

import random

import pytest

from corpuslens.operators import profile
from corpuslens.sources import readers


def walk(text, sep):
    """Records, told character by character."""
    rows, row, cell, inside, i = [], [], "", False, 0
    text = text.removeprefix("﻿")
    while i < len(text):
        c = text[i]
        if inside and c == '"' and text[i + 1 : i + 2] == '"':
            cell += '"'
            i += 1
        elif c == '"':
            inside = not inside
        elif inside or c not in (sep, "\r", "\n"):
            cell += c
        elif c == sep:
            row.append(cell)
            cell = ""
        else:
            i += text[i : i + 2] == "\r\n"
            rows.append([*row, cell])
            row, cell = [], ""
        i += 1
    if cell or row:
        rows.append([*row, cell])
    return [r for r in rows if len(r) > 1 or r[0].strip()]


def random_text(rng, n, sep=","):
    return "".join(rng.choice(["a", "bc", sep, sep, "\n", "\n", "\r\n", "\r", '"', '""', '"x\ny"', '"p' + sep + 'q"', " ", "é"]) for _ in range(n))


def test_records_of_a_text():
    rng = random.Random(0)
    for _ in range(3000):
        t = random_text(rng, rng.randrange(14), ";")
        assert readers.parse_records(t, ";") == walk(t, ";"), repr(t)


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("most_odd", [readers.MOST_ODD, -1])
def test_cells_of_split_files(spark, tmp_path, small_splits, monkeypatch, most_odd):
    monkeypatch.setattr(readers, "MOST_ODD", most_odd)
    rng = random.Random(1)
    texts = {f"f{i}.csv": random_text(rng, rng.choice([0, 5, 60, 300])) for i in range(8)}
    texts["long.csv"] = "﻿k,v\n" + "".join(f'{i},"line one of {i}\nline, two ""{i}""\n\nend"\n' for i in range(40))
    texts["open.csv"] = 'a,b\n1,"never closed\n' + "x,y\n" * 30
    texts["wide.csv"] = "a,b\n" + '"' + "word " * 100 + '"' + ",1\n2,3\n"
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode())
    assert readers._lines(spark, str(tmp_path)).select("path", "block").distinct().count() > 40
    got = {}
    for r in readers.read_cells(spark, str(tmp_path)).collect():
        got.setdefault(r["path"].rpartition("/")[2], []).append((r["row_no"], list(r["cells"])))
    for name, t in texts.items():
        t = t.removesuffix("\n") if t.count('"') % 2 else t  # the last line end of a file isn't seen
        assert sorted(got.get(name, [])) == list(enumerate(walk(t, ","))), name


def test_separators_by_file(spark, tmp_path, small_splits):
    files = {"a.csv": "id,name\n1,x\n2,\"y,\nz\"\n", "b.csv": "id;name\n3;u;extra\n4\n", "c.tsv": "name\tid\nw\t5\n", "d.csv": "﻿id|more\n6|\"m|n\"\n", "e.csv": "id,name\n7,\n"}
    for name, t in files.items():
        (tmp_path / name).write_text(t, newline="")
    df = readers.read_delimited(spark, str(tmp_path))
    assert df.columns == ["id", "name", "more"]
    want = [("1", "x", None), ("2", "y,\nz", None), ("3", "u", None), ("4", None, None), ("5", "w", None), ("6", None, "m|n"), ("7", None, None)]
    assert sorted(tuple(r) for r in df.collect()) == want
    bare = readers.read_delimited(spark, str(tmp_path / "a.csv"), header=False)
    assert bare.columns == ["c0", "c1"] and bare.count() == 3


def test_confidence(spark):
    rows = spark.createDataFrame([("a", 0, ["x", "y"]), ("a", 1, ["1", "2"]), ("a", 2, ["1"]), ("a", 3, ["1", "2"]), ("b", 0, ["x"])], "path string, row_no long, cells array<string>")
    assert {r["path"]: r["confidence"] for r in profile.delimiter_confidence(rows).collect()} == {"a": 67, "b": 100}

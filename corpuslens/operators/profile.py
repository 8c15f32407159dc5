"""Column profiling and table quality: dialect, types, fill, quantiles, top values, outliers, findings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions.scalars import human_step, whole_percent
from corpuslens.session import materialize

# What counts as a number (sign, decimals, exponent, prefixed integers, Infinity) and as a date.
NUMBER = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|Infinity)$|^0[xX][0-9a-fA-F]+$|^0[oO][0-7]+$|^0[bB][01]+$"
DATE = r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{4})"
SEPARATORS = (",", "\t", ";", "|")


def _cell(c: str) -> Column:
    """A cell's text, trimmed; null when empty."""
    return F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))


def number_value(c: Column) -> Column:
    """The number that a numeric cell stands for, as double; null for other cells."""
    base = lambda p, n: F.conv(F.regexp_extract(c, p, 1), n, 10).try_cast("double")
    return F.when(c.rlike(r"^0[xX]"), base(r"^0[xX]([0-9a-fA-F]+)$", 16)).when(c.rlike(r"^0[oO]"), base(r"^0[oO]([0-7]+)$", 8)).when(c.rlike(r"^0[bB]"), base(r"^0[bB]([01]+)$", 2)).when(c.rlike(NUMBER), c.try_cast("double"))


def date_value(c: Column) -> Column:
    """Timestamp of a date-shaped cell in year-first order (with an optional time); null for others."""
    return F.when(c.rlike(r"^\d{4}[-/]"), F.try_to_timestamp(F.regexp_replace(c, "/", "-")))


def cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Long form (column, cell) with trimmed cells, null when empty. Multiplies rows by columns."""
    columns = columns or df.columns
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), _cell(c).alias("cell")) for c in columns))).alias("x")).select("x.column", "x.cell")


def infer_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, type): more than 80 % of the filled cells numeric gives number, else date-shaped gives date, else text; no filled cell: empty.

    One pass of conditional counts for all columns together.
    """
    columns = columns or df.columns
    aggs = []
    for i, c in enumerate(columns):
        x = _cell(c)
        num = x.rlike(NUMBER)
        aggs += [F.count(x).alias(f"n{i}"), F.count_if(num).alias(f"a{i}"), F.count_if(~num & x.rlike(DATE)).alias(f"d{i}")]
    one = df.agg(*aggs)
    kind = lambda i: F.when(F.col(f"n{i}") == 0, "empty").when(F.col(f"a{i}") > 0.8 * F.col(f"n{i}"), "number").when(F.col(f"d{i}") > 0.8 * F.col(f"n{i}"), "date").otherwise("text")
    rows = F.array(*(F.struct(F.lit(c).alias("column"), kind(i).alias("type"), F.col(f"n{i}").alias("filled")) for i, c in enumerate(columns)))
    return one.select(F.explode(rows).alias("x")).select("x.*")


def fill_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, filled, total, fill_percent)."""
    columns = columns or df.columns
    one = df.agg(F.count("*").alias("total"), *(F.count(_cell(c)).alias(f"n{i}") for i, c in enumerate(columns)))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("filled"), F.col("total").alias("total")) for i, c in enumerate(columns)))
    return one.select(F.explode(rows).alias("x")).select("x.*").withColumn("fill_percent", whole_percent(F.col("filled"), F.col("total")))


def exact_quantiles(values: DataFrame, probs: tuple[float, ...]) -> DataFrame:
    """(column, p, q) of values(column, x): quantiles with linear interpolation.

    Equal values are counted first; counts are ranked within ranges of (column, value), which start at what was counted
    before them, so no task holds a column's values.
    """
    counts = values.where(F.col("x").isNotNull()).groupBy("column", "x").agg(F.count("*").alias("n")).repartitionByRange("column", "x")
    counts = materialize(counts.withColumn("part", F.spark_partition_id()), "value-counts")  # ranges are drawn from a sample: the sums must be of the same deal
    parts = counts.groupBy("column", "part").agg(F.sum("n").alias("s"))
    upto = W.partitionBy("column").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("column", "part", F.coalesce(F.sum("s").over(upto), F.lit(0)).alias("base"), F.sum("s").over(W.partitionBy("column")).alias("total"))
    inside = W.partitionBy("column", "part").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(inside)).join(parts, ["column", "part"])
    place = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), (F.lit(p) * (F.col("total") - 1)).alias("at")) for p in probs)))
    hits = ranked.select("column", "x", (F.col("base") + F.col("upto") - F.col("n")).alias("a"), (F.col("base") + F.col("upto")).alias("b"), place.alias("t")).select("column", "x", "a", "b", "t.p", "t.at")
    low, high = F.floor("at"), F.ceil("at")
    holds = lambda k: (F.col("a") <= k) & (k < F.col("b"))
    two = hits.where(holds(low) | holds(high)).groupBy("column", "p").agg(F.max("at").alias("at"), F.max(F.when(holds(low), F.col("x"))).alias("u"), F.max(F.when(holds(high), F.col("x"))).alias("v"))
    return two.select("column", "p", F.when(F.col("u") == F.col("v"), F.col("u")).otherwise((high - F.col("at")) * F.col("u") + (F.col("at") - low) * F.col("v")).alias("q"))


def profile_numbers(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """(column, n, min, max, mean, q1, median, q3, stddev) of numeric columns (or of numeric cells of text columns).

    Population standard deviation; quantiles interpolate linearly. One aggregation for all columns, and exact_quantiles();
    approximate uses approx_percentile instead, whose state is bounded, in the same aggregation.
    """
    aggs, xs = [], []
    types = dict(df.dtypes)
    for i, c in enumerate(columns):
        x = number_value(_cell(c)) if types[c] == "string" else F.col(f"`{c}`").cast("double")
        xs.append(F.struct(F.lit(c).alias("column"), x.alias("x")))
        some = F.percentile_approx(x, [0.25, 0.5, 0.75], 10000)
        q = [some[j].alias(k) for j, k in enumerate(("q1", "median", "q3"))] if approximate else []
        aggs += [F.struct(F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), *q, F.stddev_pop(x).alias("stddev")).alias(f"s{i}")]
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("s")) for i, c in enumerate(columns)))
    one = df.agg(*aggs).select(F.explode(rows).alias("x")).select("x.column", "x.s.*")
    if not approximate:
        q = exact_quantiles(df.select(F.explode(F.array(*xs)).alias("v")).select("v.*"), (0.25, 0.5, 0.75))
        q = q.groupBy("column").agg(*(F.max(F.when(F.col("p") == p, F.col("q"))).alias(k) for k, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))))
        one = one.join(q, "column", "left")
    return one.select("column", "n", "min", "max", "mean", "q1", "median", "q3", "stddev")


def profile_texts(df: DataFrame, columns: list[str], top: int = 3) -> DataFrame:
    """(column, filled, distinct, rank, value, n): the top values of text columns; ties by value ascending."""
    counts = cells(df, columns).where("cell is not null").groupBy("column", F.col("cell").alias("value")).agg(F.count("*").alias("n"))
    per = counts.groupBy("column").agg(F.sum("n").alias("filled"), F.count("*").alias("distinct"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= top)
    return ranked.join(per, "column").select("column", "filled", "distinct", "rank", "value", "n")


def profile_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, first, last) of date or timestamp columns, or of year-first date cells."""
    types = dict(df.dtypes)
    aggs = []
    for i, c in enumerate(columns):
        x = date_value(_cell(c)) if types[c] == "string" else F.col(f"`{c}`").cast("timestamp")
        aggs.append(F.struct(F.count(x).alias("n"), F.min(x).alias("first"), F.max(x).alias("last")).alias(f"s{i}"))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("s")) for i, c in enumerate(columns)))
    return df.agg(*aggs).select(F.explode(rows).alias("x")).select("x.column", "x.s.*")


def numeric_outliers(df: DataFrame, columns: list[str], far: int = 3) -> DataFrame:
    """(column, outliers, rank, value): values over 3 population standard deviations from the mean, and the farthest.

    Ties in distance by value ascending. The statistics are one row, sent to every task.
    """
    types = dict(df.dtypes)
    x = {c: (number_value(_cell(c)) if types[c] == "string" else F.col(f"`{c}`").cast("double")) for c in columns}
    stats = df.agg(*(e for i, c in enumerate(columns) for e in (F.avg(x[c]).alias(f"m{i}"), F.stddev_pop(x[c]).alias(f"d{i}"))))
    away = F.array_compact(F.array(*(F.when(F.abs(x[c] - F.col(f"m{i}")) > 3 * F.col(f"d{i}"), F.struct(F.lit(c).alias("column"), x[c].alias("value"), F.abs(x[c] - F.col(f"m{i}")).alias("off"))) for i, c in enumerate(columns))))
    hit = df.crossJoin(F.broadcast(stats)).select(F.explode(away).alias("x")).select("x.*")  # stats is one row
    n = hit.groupBy("column").agg(F.count("*").alias("outliers"))
    ranked = hit.withColumn("rank", F.row_number().over(W.partitionBy("column").orderBy(F.desc("off"), "value"))).where(F.col("rank") <= far)
    return ranked.join(n, "column").select("column", "outliers", "rank", "value")


def constant_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n, value): columns with more than one filled cell, all equal."""
    columns = columns or df.columns
    one = df.agg(*(F.struct(F.count(_cell(c)).alias("n"), F.min(_cell(c)).alias("lo"), F.max(_cell(c)).alias("hi")).alias(f"s{i}") for i, c in enumerate(columns)))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("s")) for i, c in enumerate(columns)))
    return one.select(F.explode(rows).alias("x")).select("x.column", "x.s.*").where("n > 1 and lo = hi").select("column", "n", F.col("lo").alias("value"))


def regular_cadence(df: DataFrame, by: list[str], ts: str) -> DataFrame:
    """(by..., n, step_ms, step): groups of more than two times whose sorted steps are all equal and positive.

    Two aggregations, no ordered window: with first, last and count known, the steps are equal exactly when the times
    are different and all lie on first + k * (last - first) / (count - 1).
    """
    t = df.where(F.col(ts).isNotNull()).select(*by, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"))
    ends = t.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_t").alias("_a"), F.max("_t").alias("_b")).where("_n > 2 and _b > _a and (_b - _a) % (_n - 1) = 0")
    each = t.join(ends, by) if by else t.crossJoin(F.broadcast(ends))
    ok = each.groupBy(*by, "_n", "_a", "_b").agg(F.max((F.col("_t") - F.col("_a")) % F.expr("(_b - _a) div (_n - 1)")).alias("_off"), F.count_distinct("_t").alias("_k")).where("_off = 0 and _k = _n")
    step = F.expr("(_b - _a) div (_n - 1)") / 1000
    return ok.select(*by, F.col("_n").alias("n"), step.cast("long").alias("step_ms"), human_step(step.cast("long")).alias("step"))


def cardinality_flags(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, filled, distinct, top_n, identifier_like, dominated): all different with more than three filled; several values with one at 95 % or more."""
    counts = cells(df, columns).where("cell is not null").groupBy("column", "cell").agg(F.count("*").alias("n"))
    per = counts.groupBy("column").agg(F.sum("n").alias("filled"), F.count("*").alias("distinct"), F.max("n").alias("top_n"))
    return per.withColumn("identifier_like", (F.col("filled") == F.col("distinct")) & (F.col("filled") > 3)).withColumn("dominated", (F.col("distinct") > 1) & (F.col("top_n") >= 0.95 * F.col("filled")))


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(rows, duplicates): rows whose tuple of cells was seen before."""
    columns = columns or df.columns
    keys = df.groupBy(*(F.coalesce(_cell(c), F.lit("")).alias(c) for c in columns)).agg(F.count("*").alias("n"))
    return keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


# ---- delimited text -------------------------------------------------------------------------------------------


def detect_dialect(files: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """(path, separator, bom, line_end) of whole texts: the candidate with most hits in the first line; tab for .tsv."""
    t = F.col(text)
    plain = F.regexp_replace(t, "^﻿", "")
    first = F.regexp_extract(plain, r"^([^\r\n]*)", 1)
    n = lambda s: F.length(first) - F.length(F.replace(first, F.lit(s), F.lit("")))
    best = F.array_max(F.array(*(F.struct(n(s).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(SEPARATORS))))
    crlf, lf = F.regexp_count(t, F.lit("\r\n")), F.regexp_count(t, F.lit("\n"))
    return files.select(
        F.col(path).alias("path"),
        F.when(F.lower(F.col(path)).endswith(".tsv"), "\t").when(best["n"] > 0, best["s"]).otherwise(",").alias("separator"),
        t.startswith("﻿").alias("bom"),
        F.when(lf == 0, "none").when(crlf == 0, "LF").when(crlf == lf, "CRLF").otherwise("mixed").alias("line_end"),
    )


def ragged_rows(rows: DataFrame, cells_col: str = "cells", by: str = "path", order: str = "row_no") -> DataFrame:
    """(path, header_cells, data_rows, ragged, confidence): rows whose cell count differs from the header's, and the percent that agree (100 without data)."""
    head = rows.groupBy(by).agg(F.min_by(F.size(cells_col), order).alias("header_cells"), F.min(order).alias("_first"))
    body = rows.join(head, by).groupBy(by, "header_cells").agg(F.count_if(F.col(order) != F.col("_first")).alias("data_rows"), F.count_if((F.col(order) != F.col("_first")) & (F.size(cells_col) != F.col("header_cells"))).alias("ragged"))
    return body.withColumn("confidence", F.when(F.col("data_rows") == 0, 100).otherwise(whole_percent(F.col("data_rows") - F.col("ragged"), F.col("data_rows"))).cast("long"))


def delimiter_confidence(rows: DataFrame, cells_col: str = "cells", by: str = "path", order: str = "row_no") -> DataFrame:
    """(path, confidence): whole percent of a file's records after its first that have as many cells as that; 100 when there are none."""
    return ragged_rows(rows, cells_col, by, order).select(by, "confidence")


#: Bits of a cell's hash that are counted to tell whether one value may hold nearly all cells.
VOTE_BITS = 8


def _number(c: str, kind: str) -> Column:
    """The numbers of a column: of a numeric one as they are, of others where a cell is one."""
    plain = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
    return F.col(f"`{c}`").cast("double") if plain else number_value(_cell(c))


def _counters(df: DataFrame, columns: list[str]) -> dict:
    """The first reading: one row with all counters and sketches of all columns; each is merged over tasks.

    A value with 95 % of the cells of a column has 95 % of them on its side in every bit of a hash, so a column where some bit
    is shared more evenly has no such value.
    """
    types, aggs = dict(df.dtypes), [F.count("*").alias("total")]
    for i, c in enumerate(columns):
        x = _cell(c)
        num, h = x.rlike(NUMBER), F.xxhash64(x)
        value = _number(c, types[c])
        aggs += [F.count(x).alias(f"n{i}"), F.count_if(num).alias(f"a{i}"), F.count_if(~num & x.rlike(DATE)).alias(f"d{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        aggs += [F.avg(value).alias(f"m{i}"), F.stddev_pop(value).alias(f"s{i}"), F.approx_count_distinct(x, 0.02).alias(f"k{i}")]
        aggs += [F.count_if(x.isNotNull() & (F.getbit(h, F.lit(b)) == 1)).alias(f"v{i}_{b}") for b in range(VOTE_BITS)]
    return df.agg(*aggs).first().asDict()


def quality_report(df: DataFrame, source: str) -> DataFrame:
    """Findings (source, section, grp, field, value): what is wrong with the table, or one row that says nothing is.

    Sections: issues (empty and constant columns, duplicate rows, fill under 50 %) and anomalies (outliers,
    identifier-like and dominated columns). The table is read twice: once for the counters of all columns, then for exact
    counts of what they leave open, which are the rows' hashes, the outliers, and the cells of those text columns that may
    be identifier-like or dominated. Counts are combined before they move.
    """
    columns, types = df.columns, dict(df.dtypes)
    c = _counters(df, columns)
    total, known, kinds = c["total"], [], {}
    for i, name in enumerate(columns):
        n = c[f"n{i}"]
        kinds[name] = "empty" if n == 0 else "number" if c[f"a{i}"] > 0.8 * n else "date" if c[f"d{i}"] > 0.8 * n else "text"
        percent = math.floor(100 * n / total + 0.5) if total else 0
        if n == 0:
            known.append(("Issues", "Empty column", name, "no filled cell"))
        elif percent < 50:
            known.append(("Issues", "Sparse column", name, f"{percent}% filled"))
        if n > 1 and c[f"lo{i}"] == c[f"hi{i}"]:
            known.append(("Issues", "Constant column", name, c[f"lo{i}"]))

    asked = [F.struct(F.lit("rows").alias("what"), F.lit("rows").alias("column"), F.md5(F.to_json(F.array(*(F.coalesce(_cell(x), F.lit("")) for x in columns)))).alias("key"))]
    for i, name in enumerate(columns):
        n, cell = c[f"n{i}"], _cell(name)
        if kinds[name] == "text":
            unlike = n > 3 and c[f"k{i}"] >= 0.8 * n  # the sketch is within 2 %, with a wide margin
            voted = all(max(c[f"v{i}_{b}"], n - c[f"v{i}_{b}"]) >= 0.95 * n for b in range(VOTE_BITS))
            if unlike or voted:
                asked.append(F.when(cell.isNotNull(), F.struct(F.lit("cells").alias("what"), F.lit(name).alias("column"), F.md5(cell).alias("key"))))
        elif kinds[name] == "number" and c[f"s{i}"] is not None:
            x = _number(name, types[name])
            far = F.abs(x - F.lit(c[f"m{i}"])) > 3 * F.lit(c[f"s{i}"])
            asked.append(F.when(far, F.struct(F.lit("far").alias("what"), F.lit(name).alias("column"), F.lit("").alias("key"))))
    each = df.select(F.explode(F.array_compact(F.array(*asked))).alias("x")).groupBy("x.what", "x.column", "x.key").agg(F.count("*").alias("n"))
    per = each.groupBy("what", "column").agg(F.sum("n").alias("filled"), F.count("*").alias("distinct"), F.max("n").alias("top"))

    text = lambda c: c.cast("string")
    row = lambda section, grp, field, value: F.struct(F.lit(section).alias("section"), F.lit(grp).alias("grp"), field.alias("field"), value.alias("value"))
    what, filled, distinct, top = (F.col(k) for k in ("what", "filled", "distinct", "top"))
    exact = F.array_compact(
        F.array(
            F.when((what == "rows") & (filled > distinct), row("Issues", "Duplicate rows", F.lit("rows"), text(filled - distinct))),
            F.when((what == "cells") & (filled == distinct) & (filled > 3), row("Anomalies", "Identifier-like column", F.col("column"), F.format_string("%d different values", distinct))),
            F.when((what == "cells") & (distinct > 1) & (top >= 0.95 * filled), row("Anomalies", "Dominated column", F.col("column"), F.format_string("%d of %d", top, filled))),
            F.when(what == "far", row("Anomalies", "Outliers", F.col("column"), text(filled))),
        )
    )
    # one small row of all findings, so that "none" is known without reading again
    listed = per.select(exact.alias("f")).agg(F.flatten(F.collect_list("f")).alias("f"))
    fixed = F.array(*(row(s, g, F.lit(f), F.lit(v)) for s, g, f, v in known)) if known else F.slice(F.array(row("", "", F.lit(""), F.lit(""))), 1, 0)
    every = listed.select(F.concat(fixed, "f").alias("f"))
    none = F.array(row("Issues", "Result", F.lit("table"), F.lit("no issues found")))
    return every.select(F.explode(F.when(F.size("f") == 0, none).otherwise(F.col("f"))).alias("x")).select(F.lit(source).alias("source"), "x.section", "x.grp", "x.field", "x.value")

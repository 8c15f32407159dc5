"""Queries over the tabular profile operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.operators import profile
from corpuslens.session import table

_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _strings(spark, sf, name, columns=None):
    df = table(spark, sf, name)
    return df.select(*(F.col(c).cast("string").alias(c) for c in columns or df.columns))


def _rounded(df, *columns):
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


QUERIES = {
    "t3_infer_types": lambda s, d: profile.infer_types(_strings(s, d, "customer")).unionByName(profile.infer_types(_strings(s, d, "orders"))),
    "a9_fill_rates": lambda s, d: profile.fill_rates(table(s, d, "customer")),
    "a6_profile_numbers": lambda s, d: _rounded(profile.profile_numbers(table(s, d, "lineitem"), _NUMBERS), "min", "max", "mean", "q1", "median", "q3", "stddev"),
    "a6_profile_numeric_cells": lambda s, d: _rounded(profile.profile_numbers(_strings(s, d, "customer"), ["c_acctbal", "c_custkey"]), "min", "max", "mean", "q1", "median", "q3", "stddev"),
    "a7_top_values": lambda s, d: profile.profile_texts(table(s, d, "customer"), ["c_mktsegment", "c_nationkey"]),
    "a8_profile_dates": lambda s, d: profile.profile_dates(table(s, d, "orders"), ["o_orderdate"]).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first", "last")}),
    "t4_numeric_outliers": lambda s, d: _rounded(profile.numeric_outliers(table(s, d, "orders").withColumn("spread", F.pow(F.col("o_totalprice") / 1e5, F.lit(8.0))), ["o_totalprice", "spread"]), "value"),
    "t5_constant_columns": lambda s, d: profile.constant_columns(table(s, d, "lineitem").select("l_returnflag", "l_tax").withColumns({"k": F.lit(7), "e": F.lit(None).cast("string")})),
    "t7_regular_cadence": lambda s, d: profile.regular_cadence(table(s, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("p"), F.date_trunc("day", "o_orderdate").alias("day")).distinct(), ["p"], "day"),
    "t8_cardinality_flags": lambda s, d: profile.cardinality_flags(table(s, d, "customer")),
    "a11_duplicate_rows": lambda s, d: profile.duplicate_rows(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"]),
    "t1_detect_dialect": lambda s, d: profile.detect_dialect(table(s, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 5 == 0, ".tsv").otherwise(".csv")).alias("path"), F.concat(F.when(F.col("c_custkey") % 2 == 0, F.concat_ws(";", "c_name", "c_mktsegment", "c_acctbal")).otherwise(F.concat_ws("|", "c_name", "c_mktsegment")), F.when(F.col("c_custkey") % 3 == 0, "\r\n").otherwise("\n"), F.lit("x")).alias("text"))),
    "t9_quality_report": lambda s, d: profile.quality_report(_strings(s, d, "customer"), "customer"),
}

_NUM = r"^([+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|Infinity)|0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+)$"
_DATE = r"^([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4})"


def _types_sql(name: str, columns: list[str]) -> str:
    one = lambda c: f"""select '{c}' as "column", case when n = 0 then 'empty' when a > 0.8 * n then 'number' when d > 0.8 * n then 'date' else 'text' end as type, n as filled from (
      select count(x) as n, count(*) filter (where regexp_matches(x, '{_NUM}')) as a, count(*) filter (where not regexp_matches(x, '{_NUM}') and regexp_matches(x, '{_DATE}')) as d
      from (select nullif(trim(cast({c} as varchar)), '') as x from {name}))"""  # noqa: E731
    return " union all ".join(one(c) for c in columns)


def _numbers_sql(name: str, columns: list[str]) -> str:
    return " union all ".join(
        f"""select '{c}' as "column", count({c}) as n, round(cast(min({c}) as double), 6) as min, round(cast(max({c}) as double), 6) as max, round(avg(cast({c} as double)), 6) as mean,
        round(quantile_cont(cast({c} as double), 0.25), 6) as q1, round(quantile_cont(cast({c} as double), 0.5), 6) as median, round(quantile_cont(cast({c} as double), 0.75), 6) as q3, round(stddev_pop(cast({c} as double)), 6) as stddev from {name}"""
        for c in columns
    )


_SPREAD = "(select o_totalprice, pow(o_totalprice / 1e5, 8) as spread from orders)"
_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORACLE = {
    "t3_infer_types": _types_sql("customer", _CUSTOMER) + " union all " + _types_sql("orders", _ORDERS),
    "a9_fill_rates": " union all ".join(f"""select '{c}' as "column", count(nullif(trim(cast({c} as varchar)), '')) as filled, count(*) as total, cast(floor(100.0 * count(nullif(trim(cast({c} as varchar)), '')) / count(*) + 0.5) as bigint) as fill_percent from customer""" for c in _CUSTOMER),
    "a6_profile_numbers": _numbers_sql("lineitem", _NUMBERS),
    "a6_profile_numeric_cells": _numbers_sql("customer", ["c_acctbal", "c_custkey"]),
    "a7_top_values": """with u as (select 'c_mktsegment' as "column", c_mktsegment as value from customer union all select 'c_nationkey', cast(c_nationkey as varchar) from customer),
      c as (select "column", value, count(*) as n from u where value is not null group by all),
      r as (select *, row_number() over (partition by "column" order by n desc, value) as rank, sum(n) over (partition by "column") as filled, count(*) over (partition by "column") as "distinct" from c)
      select "column", cast(filled as bigint) as filled, "distinct", rank, value, n from r where rank <= 3""",
    "a8_profile_dates": """select 'o_orderdate' as "column", count(o_orderdate) as n, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') as first, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') as last from orders""",
    "t4_numeric_outliers": f"""with u as (select 'o_totalprice' as "column", o_totalprice as value from orders union all select 'spread', spread from {_SPREAD}),
      s as (select "column", avg(value) as m, stddev_pop(value) as d from u group by all),
      h as (select u."column", value, abs(value - m) as far from u join s using ("column") where abs(value - m) > 3 * d),
      r as (select *, row_number() over (partition by "column" order by far desc, value) as rank, count(*) over (partition by "column") as outliers from h)
      select "column", outliers, rank, round(value, 6) as value from r where rank <= 3""",
    "t5_constant_columns": """select "column", n, value from (
      select 'l_returnflag' as "column", count(l_returnflag) as n, min(l_returnflag) as value, max(l_returnflag) as hi from lineitem union all
      select 'l_tax', count(l_tax), cast(min(l_tax) as varchar), cast(max(l_tax) as varchar) from lineitem union all
      select 'k', count(*), '7', '7' from lineitem) where n > 1 and value = hi""",
    "t7_regular_cadence": """with d as (select distinct strftime(o_orderdate, '%Y-%m') as p, date_trunc('day', o_orderdate) as day from orders),
      g as (select p, day, epoch_ms(day) - lag(epoch_ms(day)) over (partition by p order by day) as step from d),
      r as (select p, count(*) as n, min(step) as lo, max(step) as hi from g group by p)
      select p, n, lo as step_ms, case when lo % 86400000 = 0 then case when lo = 86400000 then '1 day' else cast(lo // 86400000 as varchar) || ' days' end else 'other' end as step from r where n > 2 and lo = hi and lo > 0""",
    "t8_cardinality_flags": " union all ".join(f"""select '{c}' as "column", cast(sum(n) as bigint) as filled, count(*) as "distinct", max(n) as top_n, sum(n) = count(*) and sum(n) > 3 as identifier_like, count(*) > 1 and max(n) >= 0.95 * sum(n) as dominated from (select count(*) as n from customer where {c} is not null group by {c})""" for c in _CUSTOMER),
    "a11_duplicate_rows": "select count(*) as rows, count(*) - count(distinct l_returnflag || chr(1) || l_linestatus || chr(1) || l_linenumber || chr(1) || l_suppkey) as duplicates from lineitem",
    "t1_detect_dialect": """with t as (select c_custkey as k, case when c_custkey % 2 = 0 then c_name || ';' || c_mktsegment || ';' || c_acctbal else c_name || '|' || c_mktsegment end as line from customer)
      select 'c' || k || case when k % 5 = 0 then '.tsv' else '.csv' end as path, case when k % 5 = 0 then chr(9) when k % 2 = 0 then ';' else '|' end as separator, false as bom, case when k % 3 = 0 then 'CRLF' else 'LF' end as line_end from t""",
    "t9_quality_report": """select 'customer' as source, 'Anomalies' as section, 'Identifier-like column' as grp, 'c_name' as field, count(distinct c_name) || ' different values' as value from customer having count(distinct c_name) = count(c_name)""",
}

"""Queries over record-shaped stand-ins: orders as dated files, conversations as mailboxes, pages as web archives, customers as a delimited file."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpuslens.functions.scalars import register_sql
from corpuslens.operators import classify, logs, profile
from corpuslens.session import shared_dir, table
from corpuslens.sources import readers


_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _dated(s, d):
    o = table(s, d, "orders")
    back = lambda c, n: F.timestamp_micros(F.unix_micros("o_orderdate") - F.pmod(F.col(c), F.lit(n)) * 86_400_000_000)
    return o.select("o_orderkey", F.col("o_orderdate").alias("captured"), F.lit(None).cast("timestamp").alias("created"), back("o_custkey", 4).alias("modified"), back("o_orderkey", 3).alias("saved"))


def _talks(s, d):
    return table(s, d, "conversations")


def _delimited(s, d):
    path = f"{shared_dir(s)}/corpuslens-customers-{uuid.uuid4().hex}"
    c = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.col("c_name"), F.lit(' said "a;b"\nand left')).alias("note"), F.col("c_mktsegment").alias("segment"))
    c.write.option("sep", ";").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return readers.read_delimited(s, path)


def _mixed(s, d):
    """Files of three separators in one folder."""
    path = f"{shared_dir(s)}/corpuslens-mixed-{uuid.uuid4().hex}"
    c = table(s, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit('a;b|c, "d"\n'), "c_name").alias("note"))
    for k, sep in enumerate(";|,"):
        c.where(F.col("c_custkey") % 3 == k).drop("c_custkey").write.option("sep", sep).option("header", True).option("escape", '"').option("quoteAll", True).csv(f"{path}/{k}")
    return readers.read_delimited(s, path)


def _confidence(s, d):
    """Lines of documents as records of cells between commas."""
    t = table(s, d, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    lines = readers.split_lines(t).select("path", F.col("line_no").alias("row_no"), F.split("line", ",").alias("cells"))
    return profile.delimiter_confidence(lines)


def _sql(s, d):
    register_sql(s)
    table(s, d, "documents").createOrReplaceTempView("corpuslens_documents")
    return s.sql("select doc_id, word_count(text) as words, human_bytes(n_chars) as size, clean_ext(source) as ext from corpuslens_documents")


QUERIES = {
    "p15_time_anomalies": lambda s, d: classify.time_anomalies(_dated(s, d), F.lit("1998-01-01").cast("timestamp")).select("o_orderkey", F.array_join("anomalies", "; ").alias("anomalies")),
    "a22_summarise_mailbox": lambda s, d: logs.summarise_mailbox(_talks(s, d).select(F.col("conv_id").alias("path"), F.col("role").alias("sender"), F.col("turn").alias("date"))).select("path", "messages", "first", "last", "senders", F.array_join("top_senders", ",").alias("top_senders")),
    "a26_summarise_warc": lambda s, d: logs.summarise_warc(table(s, d, "pages").select(F.pmod("page_id", F.lit(5)).cast("string").alias("path"), F.concat(F.lit("WARC-Target-URI: "), "url").alias("line"))).select("path", "records", "urls", "hosts"),
    "a42_revision_audit": lambda s, d: logs.revision_audit(_talks(s, d).select(F.col("conv_id").alias("doc"), F.col("role").alias("author"), F.when(F.col("turn") % 2 == 0, "ins").otherwise("del").alias("kind"))).withColumn("share", F.round("share", 6)),
    "a46_block_histogram": lambda s, d: logs.block_histogram(readers.split_lines(table(s, d, "documents").select(F.col("doc_id").alias("path"), "text")), "^[A-M]", "^([N-Z][a-z]*)"),
    "s3_read_delimited": _delimited,
    "s3_mixed_separators": _mixed,
    "t2_delimiter_confidence": _confidence,
    "s8_catalog_tables": lambda s, d: readers.catalog_tables(s, d, _TABLES)[0].select("table", "rows", "position", "column"),
    "u3_sql_functions": _sql,
}

ORACLE = {
    "p15_time_anomalies": """with d as (select o_orderkey, o_orderdate as c, o_orderdate - to_days(cast(o_custkey % 4 as int)) as m, o_orderdate - to_days(cast(o_orderkey % 3 as int)) as s from orders)
      select o_orderkey, concat_ws('; ', case when c > timestamp '1998-01-03' then 'captured is in the future' end, case when m > timestamp '1998-01-03' then 'modified is in the future' end,
        case when c - m > interval 1 day then 'modified before capture' end, case when c - s > interval 25 hours then 'saved before capture' end) as anomalies from d""",
    "a22_summarise_mailbox": """with n as (select conv_id, role, count(*) as n from conversations group by all), r as (select *, row_number() over (partition by conv_id order by n desc, role) as r from n),
      t as (select conv_id, string_agg(role, ',' order by r) as top_senders from r where r <= 10 group by 1)
      select conv_id as path, count(*) as messages, min(turn) as first, max(turn) as last, count(distinct role) as senders, any_value(top_senders) as top_senders from conversations join t using (conv_id) group by 1""",
    "a26_summarise_warc": "select cast(page_id % 5 as varchar) as path, 0 as records, count(distinct url) as urls, count(distinct regexp_extract(url, '://([^/?#:]*)', 1)) as hosts from pages group by 1",
    "a42_revision_audit": """with c as (select conv_id as doc, role as author, count(*) filter (where turn % 2 = 0) as ins, count(*) filter (where turn % 2 <> 0) as del, count(*) as total from conversations group by all)
      select *, round(total * 1.0 / sum(total) over (partition by doc), 6) as share, row_number() over (partition by doc order by total desc, author) as rank from c""",
    "a46_block_histogram": """with d as (select doc_id, string_split(text, chr(10)) as l from documents), e as (select doc_id, unnest(l) as line, unnest(range(len(l))) as no from d),
      b as (select *, sum(case when regexp_matches(line, '^[A-M]') then 1 else 0 end) over (partition by doc_id order by no) as block, regexp_extract(line, '^([N-Z][a-z]*)', 1) as c from e),
      f as (select doc_id, block, arg_min(c, no) as class from b where block > 0 and not regexp_matches(line, '^[A-M]') and c <> '' group by all)
      select doc_id as path, class, count(*) as n from f group by all""",
    "s3_read_delimited": """select cast(c_custkey as varchar) as id, c_name || ' said "a;b"' || chr(10) || 'and left' as note, c_mktsegment as segment from customer""",
    "s3_mixed_separators": """select cast(c_custkey as varchar) as id, 'a;b|c, "d"' || chr(10) || c_name as note from customer""",
    "t2_delimiter_confidence": r"""with l as (
  select doc_id, list_transform(regexp_split_to_array(coalesce(text, ''), '\r?\n'), lambda x: len(string_split(x, ','))) as n from documents)
select doc_id as path, cast(case when len(n) = 1 then 100 else floor(100.0 * len(list_filter(n[2:], lambda x: x = n[1])) / (len(n) - 1) + 0.5) end as bigint) as confidence from l""",
    "s8_catalog_tables": " union all ".join(f"""select '{t}' as "table", (select count(*) from {t}) as rows, ordinal_position - 1 as position, column_name as "column" from information_schema.columns where table_name = '{t}'""" for t in _TABLES),
    "u3_sql_functions": r"""select doc_id, len(regexp_extract_all(text, '\S+')) as words, case when n_chars < 1024 then n_chars || ' B' else printf('%.1f KB', floor(n_chars / 1024.0 * 10 + 0.5) / 10) end as size, regexp_replace(lower(source), '[^a-z0-9]', '', 'g') as ext from documents""",
}

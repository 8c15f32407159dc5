"""Lines that many documents share, dropped from all but one of them."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.keyed import join_by_key
from corpuslens.session import materialize

#: The white space that is stripped from a line's ends: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """A line as it is compared: without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def drop_shared_lines(docs: DataFrame, min_chars: int = 20, min_documents: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with text replaced by the lines that stay, plus n_lines (before) and n_dropped.

    A line whose key has min_chars code points or more, and is found in min_documents different doc_ids or more, stays only
    in the largest of these doc_ids. All other lines stay where they are, joined by \\n. A null or empty text is one empty
    line (and comes back empty). A null doc_id is an id like others, below all; rows that share a doc_id are one document
    for the counts, and keep or lose their lines alike. Repeated rows stay repeated, other columns are handed on, those
    called n_lines or n_dropped are replaced; an empty table gives an empty one. A very long text is one row here as there.

    Lines are exploded and hashed (128 bits), the documents of each hash counted in two steps, so that a line that a third
    of all documents have is counted where it stands. The places of lines to drop then meet their text in one shuffle of
    the texts; each text is put together by position. A document is its row's id and a hash of its text.
    """
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    row = row.select("row", F.col("row").getField(doc_id).alias("id"), F.coalesce(F.col("row").getField(text).cast("string"), F.lit("")).alias("text"))
    row = row.withColumn("digest", F.xxhash64("text"))
    lines = row.select("id", "digest", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    lines = lines.select("id", "digest", "place", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    lines = lines.select("id", "digest", "place", F.unhex(F.md5(F.encode("key", "utf-8"))).alias("key"))

    found = lines.groupBy("key", "id").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("documents"), F.sum("n").alias("n"), F.max("id").alias("keeper"))
    shared = materialize(found.where(F.col("documents") >= min_documents).select("key", "n", "keeper"), "shared-lines")
    lost = join_by_key(lines, shared, ["key"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    places = lost.groupBy("id", "digest").agg(F.array_sort(F.collect_set("place")).alias("places"))

    # one flag a line, up to the last that goes; each place says how many lines stay before it
    gap = lambda p, i: F.array_repeat(F.lit(False), (p - F.coalesce(F.get("places", i - 1), F.lit(-1)) - 1).cast("int"))
    gone = F.flatten(F.transform("places", lambda p, i: F.concat(gap(p, i), F.array(F.lit(True)))))
    met = row.alias("r").join(places.withColumn("gone", gone).alias("p"), F.col("r.id").eqNullSafe(F.col("p.id")) & (F.col("r.digest") == F.col("p.digest")), "left")
    all_lines = F.split("text", "\n")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(all_lines, lambda x, i: ~F.coalesce(F.get("gone", i), F.lit(False))), "\n"))
    n = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    out = met.select("row", kept.alias("text"), n.alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"))
    own = [F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*own, "n_lines", "n_dropped")


def op12(docs: DataFrame) -> DataFrame:
    d = drop_shared_lines(docs.select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


OP12_SQL = r"""
with l as (select doc_id, coalesce(text, '') as text, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as place from documents),
  k as (select doc_id, place, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
  s as (select key, max(doc_id) as keeper from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
  m as (select k.*, s.keeper is not null and s.keeper <> k.doc_id as gone from k left join s using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '')) as kept_sha256 from m group by doc_id
"""

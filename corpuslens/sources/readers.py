"""Sources: file corpora, delimited text, cells, JSON and JSON Lines, lines, catalogues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.operators.inventory import extension
from corpuslens.operators.profile import detect_dialect
from corpuslens.session import ensure_on_workers, materialize


def scan_corpus(spark: SparkSession, root: str, content: bool = False, glob: str | None = None) -> DataFrame:
    """(path, size, modified, ext[, content]) of every file under a folder. Without content the bytes aren't read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    df = (r.option("pathGlobFilter", glob) if glob else r).load(root)
    cols = ["path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), extension(F.col("path")).alias("ext")]
    return df.select(*cols, *(["content"] if content else []))


def with_head(files: DataFrame, n: int = 264, content: str = "content") -> DataFrame:
    """files with the first n bytes as `head` in place of the content."""
    return files.withColumn("head", F.substring(F.col(content), 1, n)).drop(content)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole text files."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_delimited(spark: SparkSession, path: str, dialect: str | None = None, header: bool = True) -> DataFrame:
    """A delimited file or folder as strings: quoted fields may hold separators and line ends, "" in them is a quote.

    Each file is read with its own separator unless one is given. Columns are named by the header of the first file (by path)
    of each separator, or c0, c1, ...; files of different separators are put together by name, and what one doesn't have is
    null. Short records are filled up with nulls, an empty cell is null, cells beyond the header are left out.
    """
    if dialect is not None:
        return _named(_records(spark, path, dialect), header)
    kinds = file_dialects(spark, path).groupBy("separator").agg(F.collect_list("path").alias("paths")).collect()  # four rows; the session lists these files anyway
    parts = [_named(_records(spark, sorted(k["paths"]), k["separator"]), header) for k in sorted(kinds, key=lambda k: min(k["paths"]))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def file_dialects(spark: SparkSession, path: str) -> DataFrame:
    """(path, separator) of each file, by its first line."""
    lines = _lines(spark, path).where("block = 0")
    return detect_dialect(lines.groupBy("path").agg(F.min_by("value", "seq").alias("text"))).select("path", "separator")


def _named(records: DataFrame, header: bool) -> DataFrame:
    first = records.where("block = 0").groupBy("path").agg(F.min_by("cells", F.struct("no", "sub")).alias("cells"), F.min(F.struct("no", "sub")).alias("at"))
    top = first.orderBy("path").select("cells").first()
    if top is None:
        raise ValueError("no records")
    names = [c.strip() or f"c{i}" for i, c in enumerate(top["cells"])] if header else [f"c{i}" for i in range(len(top["cells"]))]
    names = [n if n not in names[:i] else f"{n}_{i}" for i, n in enumerate(names)]
    if header:  # the first record of a file stands in its first block
        heads = first.select("path", F.lit(0).cast("long").alias("block"), "at.no", "at.sub")
        records = records.join(heads, ["path", "block", "no", "sub"], "left_anti")
    return records.select(*(F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)))


def read_cells(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(path, row_no, cells): each record as an array, so rows of any length survive; a record of one blank field is dropped.

    A file of any size is read by many tasks (see _records). Records are numbered within their block, blocks start at the
    counts before them.
    """
    found = materialize(_records(spark, path, sep), "cells")
    blocks = found.groupBy("path", "block").agg(F.count("*").alias("n"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(W.partitionBy("path", "block").orderBy("no", "sub")) - 1
    return found.withColumn("own", own).join(starts, ["path", "block"]).select("path", (F.col("start") + F.col("own")).cast("long").alias("row_no"), "cells")


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, block, seq, value): what stands between line feeds, with the place of the split it was read in; seq ascends within a split."""
    r = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    return r.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")


def parse_records(text: str, sep: str) -> list[list[str]]:
    """Records of a text: every quote opens or closes, two in a quoted stretch are one, separators and line ends count outside only.

    Records of one blank field are left out; a stretch that is never closed ends with the text.
    """
    if '"' not in text:
        plain = text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if "\r" in text or "\n" in text else [text]
        return [r for r in (x.split(sep) for x in plain) if len(r) > 1 or r[0].strip()]
    records, row, cell = [], [], ""
    parts = text.split('"')
    for i, part in enumerate(parts):
        if i % 2:
            cell += part
        elif not part and 0 < i < len(parts) - 1:
            cell += '"'
        else:
            for k, line in enumerate(part.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
                if k:
                    records.append([*row, cell])
                    row, cell = [], ""
                first, *more = line.split(sep)
                cell += first
                for x in more:
                    row.append(cell)
                    cell = x
    records.append([*row, cell])
    return [r for r in records if len(r) > 1 or r[0].strip()]


#: Splits that begin inside quotes: up to so many (some 100 bytes each) their places are broadcast, beyond that joined by shuffle.
MOST_ODD = 100_000


def _records(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    """(path, block, no, sub, cells): every record, in the order of block, no and sub within its file. block is where it begins.

    Splits of a file are parsed alone. Whether one begins inside quotes is told by how many quotes stand in the splits before
    it: a first pass counts them, a running sum per file gives the parity. A record that goes on into later splits is handed
    over in pieces, which are put together and parsed; only such a record is in one task. A quote that is never closed makes
    the rest of its file one record, whose last line end isn't kept. Lines that end with a carriage return alone aren't split
    points for tasks, but end records.
    """
    ensure_on_workers(spark)
    lines = _lines(spark, path)

    def count(batches):
        import pyarrow as pa

        where, quotes, ends, done = None, 0, [False, False], []
        for b in batches:
            for p, k, v in zip(*(c.to_pylist() for c in b.columns)):
                if (p, k) != where:
                    if where:
                        done.append((*where, quotes % 2, *ends))
                    where, quotes, ends = (p, k), 0, [False, False]
                quotes += v.count('"')
                ends[quotes % 2] = True
        if where:
            done.append((*where, quotes % 2, *ends))
        types = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names=["path", "block", "parity", "even", "odd"])

    facts = materialize(lines.select("path", "block", "value").mapInArrow(count, "path string, block long, parity int, even boolean, odd boolean"), "quote-counts")
    order = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    state = facts.withColumn("inside", F.coalesce(F.sum("parity").over(order), F.lit(0)) % 2)
    closes = F.when(F.col("inside") == 0, F.col("even")).otherwise(F.col("odd"))
    opens = ((F.col("inside") + F.col("parity")) % 2 == 1) & ((F.col("inside") == 0) | closes)
    owner = F.last(F.when(opens, F.col("block")), ignorenulls=True).over(order)
    odd = materialize(state.withColumn("owner", owner).where("inside = 1").select("path", "block", "owner"), "odd-blocks")
    cols = ["path", "block", "value", "owner"]
    if odd.count() <= MOST_ODD:
        marked = lines.join(F.broadcast(odd), ["path", "block"], "left").select(cols)
    else:
        marked = lines.join(odd, ["path", "block"], "left").repartition("path", "block").sortWithinPartitions("path", "block", "seq").select(cols)

    def cut(batches):
        """Records that begin and end in their split, and as text what goes on from or into others."""
        import pyarrow as pa

        where, no, held, inside, carried = None, 0, [], False, None
        out = []

        def end():
            if held:  # open at the split's end
                out.append((*where, no, 0, "".join(held), None) if carried is None else (where[0], carried, None, where[1], "".join(held), None))

        def batch():
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=["path", "block", "no", "sub", "text", "cells"])

        for b in batches:
            for p, k, v, o in zip(*(c.to_pylist() for c in b.columns)):
                if (p, k) != where:
                    end()
                    where, no, held, inside, carried = (p, k), 0, [], o is not None, o
                    v = v.removeprefix("\ufeff") if k == 0 else v
                if v.count('"') % 2:
                    inside = not inside
                held.append(v + "\n")
                if inside:
                    continue
                text, held = "".join(held), []
                if carried is not None:
                    out.append((p, carried, None, k, text, None))
                    carried = None
                    continue
                for r in parse_records(text[:-1], sep):
                    out.append((p, k, no, 0, None, r))
                    no += 1
                if len(out) >= 20_000:
                    yield batch()
                    out = []
        end()
        yield batch()

    pieces = marked.mapInArrow(cut, "path string, block long, no long, sub long, text string, cells array<string>")
    whole = pieces.where("cells is not null").select("path", "block", "no", "sub", "cells")
    # of a record in pieces the first has a number, the others the split they stand in
    torn = pieces.where("cells is null").groupBy("path", "block").agg(F.max("no").alias("no"), F.sort_array(F.collect_list(F.struct(F.when(F.col("no").isNotNull(), F.lit(-1)).otherwise(F.col("sub")).alias("at"), "text"))).alias("parts"))
    text = F.regexp_replace(F.array_join(F.transform("parts", lambda x: x["text"]), ""), r"\n\z", "")

    @F.udf("array<array<string>>", useArrow=True)
    def parsed(t):
        return parse_records(t, sep)

    joined = torn.select("path", "block", "no", F.posexplode(parsed(text)).alias("sub", "cells")).withColumn("sub", F.col("sub").cast("long"))
    return whole.unionByName(joined)


# Strings are kept whole; comments and commas before a closing bracket go.
_COMMENTS = r"""("(?:[^"\\]|\\.)*")|/\*[\s\S]*?\*/|//[^\r\n]*"""
_COMMAS = r"""("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])"""


def parse_relaxed_json(df: DataFrame, col: str) -> DataFrame:
    """df plus json: the text without comments and trailing commas as a variant; null where it still doesn't parse."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(col), "^﻿", ""), _COMMENTS, "$1"), _COMMAS, "$1")
    return df.withColumn("json", F.try_parse_json(plain))


def profile_jsonl(lines: DataFrame, line: str = "line") -> DataFrame:
    """(records, valid, keys): filled lines, those that parse, and the sorted union of their top-level keys."""
    f = lines.where(F.trim(F.col(line)) != "")
    ok = F.try_parse_json(F.col(line)).isNotNull()
    n = f.agg(F.count("*").alias("records"), F.count_if(ok).alias("valid"))
    keys = f.where(ok).select(F.explode(F.json_object_keys(line)).alias("k")).distinct().agg(F.array_sort(F.collect_list("k")).alias("keys"))
    return n.crossJoin(keys)  # one row each


def read_lines(spark: SparkSession, path: str, unfold: bool = False) -> DataFrame:
    """(path, line_no, line) of text files; unfold joins lines that start with a space or tab to the one before."""
    return split_lines(read_texts(spark, path), unfold)


def split_lines(texts: DataFrame, unfold: bool = False, path: str = "path", text: str = "text") -> DataFrame:
    t = F.regexp_replace(F.col(text), r"\r?\n[ \t]", "") if unfold else F.col(text)
    return texts.select(F.col(path).alias("path"), F.posexplode(F.split(t, r"\r?\n")).alias("line_no", "line"))


def catalog_tables(spark: SparkSession, root: str, names: list[str], sample: int = 5) -> tuple[DataFrame, DataFrame]:
    """(columns, sample): one row per column of each Parquet table with its row count, and some rows of the largest as JSON."""
    rows, largest = [], (-1, None)
    for n in names:
        df = spark.read.parquet(f"{root}/{n}.parquet")
        count = df.count()
        rows += [(n, count, i, c, t) for i, (c, t) in enumerate(df.dtypes)]
        largest = max(largest, (count, n))
    cols = spark.createDataFrame(rows, "table string, rows long, position int, column string, type string")
    big = spark.read.parquet(f"{root}/{largest[1]}.parquet")
    return cols, big.limit(sample).select(F.lit(largest[1]).alias("table"), F.to_json(F.struct(*big.columns)).alias("row"))

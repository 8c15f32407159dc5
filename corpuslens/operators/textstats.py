"""Statistics of texts and markup: sizes, indicators, entropy, JSON trees, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.scalars import shannon
from corpuslens.session import ensure_on_workers

# Last labels that make a dotted name a file name rather than a domain.
FILE_WORDS = (
    "js mjs cjs ts tsx jsx json css scss html htm xml svg "
    "png jpg jpeg gif webp ico bmp tiff txt md rst "
    "exe dll so dylib bin dat db sql log lock map "
    "py rb go rs java class php c h cpp cc hpp sh bat ps1 "
    "yml yaml ini cfg conf toml env properties "
    "woff woff2 ttf otf eot mp3 mp4 wav avi mov webm "
    "zip gz tar bz2 xz rar 7z pdf doc docx xls xlsx ppt pptx"
).split()
# The patterns of the four kinds of indicator.
URL = r"(?i)\bhttps?://[^\s\"'<>()\[\]{}\\|^`]+"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}\b"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
DOMAIN = r"(?i)\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}\b"


def words(c: Column) -> Column:
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))


def text_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """df plus chars, words, lines, paragraphs, reading_minutes (200 words a minute, rounded up)."""
    t = F.coalesce(F.col(text), F.lit(""))
    w = words(t)
    return df.withColumns({
        "chars": F.length(t), "words": w, "lines": F.when(t == "", 0).otherwise(F.regexp_count(t, F.lit("\n")) + 1),
        "paragraphs": F.size(F.filter(F.split(t, r"\n\s*\n"), lambda x: F.trim(F.regexp_replace(x, r"\s", " ")) != "")), "reading_minutes": F.ceil(w / 200).cast("int"),
    })


def extract_indicators(df: DataFrame, text: str = "text", most: int | None = None) -> DataFrame:
    """df plus urls, emails, ipv4, domains: distinct per row, in order of appearance; addresses are blanked before domains are sought."""
    all_of = lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(0))
    cut = lambda a: F.array_distinct(a) if most is None else F.slice(F.array_distinct(a), 1, most)
    t = F.coalesce(F.col(text), F.lit(""))
    no_url = F.regexp_replace(t, URL, " ")
    no_mail = F.regexp_replace(no_url, EMAIL, " ")
    domains = F.filter(F.transform(all_of(no_mail, DOMAIN), F.lower), lambda d: ~F.element_at(F.split(d, r"\."), -1).isin(FILE_WORDS))
    return df.withColumns({"urls": cut(F.transform(all_of(t, URL), lambda u: F.regexp_replace(u, r"[.,;:'\")\]}>]+$", ""))), "emails": cut(all_of(no_url, EMAIL)), "ipv4": cut(all_of(no_mail, IPV4)), "domains": cut(domains)})


def character_entropy(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, entropy): Shannon bits per character of each text (of all texts of a key); keys without characters are left out.

    A text's code points are counted in one pass inside the task; what leaves it is a row for each different one.
    """
    ensure_on_workers(df.sparkSession)

    @F.pandas_udf("array<struct<c: int, n: bigint>>")
    def counted(texts):
        import numpy as np
        import pandas as pd

        def one(t):
            c, n = np.unique(np.frombuffer((t or "").encode("utf-32-le"), "<u4"), return_counts=True)
            return [{"c": int(x), "n": int(y)} for x, y in zip(c, n)]

        return pd.Series([one(t) for t in texts])

    per = df.select(key, F.explode(counted(F.col(text).cast("string"))).alias("x")).groupBy(key, "x.c").agg(F.sum("x.n").alias("n"))
    return per.groupBy(key).agg(F.collect_list(F.col("n").cast("double")).alias("n")).select(key, shannon("n").alias("entropy"))


def entropy_profile(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """(path, chunks, mean, min, max, verdict): entropy of each file's bytes in 64 to 512 chunks; files under 256 bytes, or without content, are skipped.

    path keeps its type, whatever that is. The bytes are counted inside the task; only one small array a file leaves it.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                data = np.frombuffer(b.column(1)[i].as_py() or b"", np.uint8)
                if len(data) < 256:
                    continue
                n = min(512, max(64, len(data) // 256))
                size = -(-len(data) // n)
                bits = []
                for a in range(0, len(data), size):
                    c = np.bincount(data[a : a + size])
                    p = c[c > 0] / c.sum()
                    bits.append(float(-(p * np.log2(p)).sum()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([bits], pa.list_(pa.float64()))], names=["path", "bits"])

    kept = files.select(F.col(path).alias("path"), F.col(content).alias("content"))
    per = kept.mapInArrow(run, f"path {kept.schema['path'].dataType.simpleString()}, bits array<double>")
    mean = F.aggregate("bits", F.lit(0.0), lambda a, x: a + x) / F.size("bits")
    m = per.select("path", F.size("bits").alias("chunks"), mean.alias("mean"), F.array_min("bits").alias("min"), F.array_max("bits").alias("max"))
    verdict = F.when((F.col("max") > 7.5) & (F.col("max") - F.col("min") > 1.5), "embedded high-entropy region").when(F.col("mean") > 7.5, "uniformly high").when(F.col("mean") < 4.5, "low").otherwise("mixed")
    return m.withColumn("verdict", verdict)


def readable_share(head: Column) -> Column:
    """Share of tab, line ends and printable ASCII in bytes; 1 for none."""
    latin = F.decode(head, "ISO-8859-1")
    return F.when(F.length(head) > 0, F.length(F.regexp_replace(latin, r"[^\t\r\n -~]", "")) / F.length(head)).otherwise(1.0)


def is_readable_text(head: Column, decoded: bool = False) -> Column:
    """Empty, byte-order-marked or over 85 % printable bytes; or UTF-16 without mark (zeros on one side only).

    decoded: the bytes are those of a string, which has no byte order left; then only the share counts.
    """
    latin, n = F.decode(head, "ISO-8859-1"), F.length(head)
    if decoded:
        return (n == 0) | (readable_share(head) > 0.85)
    bom = F.hex(F.substring(head, 1, 2)).isin("FFFE", "FEFF")
    zeros = lambda kept: F.regexp_count(F.regexp_replace(latin, r"(?s)(.)(.?)", kept), F.lit("\x00")) / F.greatest(n / 2, F.lit(1.0))
    even, odd = zeros("$1"), zeros("$2")
    rest = F.regexp_replace(F.decode(head, "ISO-8859-1"), "\x00", "")
    wide = ((even > 0.6) & (odd < 0.1) | (odd > 0.6) & (even < 0.1)) & (F.length(F.regexp_replace(rest, r"[^\t\r\n -~]", "")) > 0.85 * F.length(rest))
    return (n == 0) | bom | (readable_share(head) > 0.85) | F.coalesce(wide, F.lit(False))


def markup_words(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, words, reading_minutes) of visible text over all parts of a document; 220 words a minute, at least 1."""
    t = F.coalesce(F.col(html), F.lit(""))
    for p in (r"(?is)<style\b.*?</style\s*>", r"(?is)<script\b.*?</script\s*>", r"<[^>]*>", r"&[a-zA-Z0-9#]+;"):
        t = F.regexp_replace(t, p, " ")
    n = df.groupBy(key).agg(F.sum(words(t)).alias("words"))
    return n.withColumn("reading_minutes", F.greatest(F.lit(1), F.floor(F.col("words") / 220 + 0.5)).cast("long"))


def markup_tally(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, tag, n): elements by name, lower case."""
    tags = F.regexp_extract_all(F.coalesce(F.col(xml), F.lit("")), F.lit(r"<([A-Za-z][A-Za-z0-9:_-]*)"), F.lit(1))
    return df.select(key, F.explode(tags).alias("tag")).groupBy(key, F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))


def markup_depth(xml: Column) -> Column:
    """Deepest nesting of elements; self-closing ones count while they stand."""
    tags = F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(r"</?[A-Za-z][^>]*>"), F.lit(0))
    zero = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(a, t):
        down = F.when(t.startswith("</"), -1).when(t.endswith("/>"), 0).otherwise(1)
        at = a["d"] + F.when(t.endswith("/>"), 1).otherwise(down)
        return F.struct(F.greatest(a["d"] + down, F.lit(0)).alias("d"), F.greatest(a["m"], at).alias("m"))

    return F.aggregate(tags, zero, step)["m"]


def paint_colours(xml: Column) -> Column:
    """Distinct fill and stroke values, as attributes or inline styles; none, inherit and url() left out."""
    t = F.coalesce(xml, F.lit(""))
    found = F.concat(F.regexp_extract_all(t, F.lit(r"""(?i)\b(?:fill|stroke)\s*=\s*["']([^"']+)["']"""), F.lit(1)), F.regexp_extract_all(t, F.lit(r"""(?i)\b(?:fill|stroke)\s*:\s*([^;"']+)"""), F.lit(1)))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.lower(F.trim(x))), lambda x: ~x.isin("none", "inherit") & ~x.startswith("url")))


def json_keys(df: DataFrame, col: str) -> DataFrame:
    """(key, n): how often each top-level key occurs over all rows."""
    return df.select(F.explode(F.json_object_keys(col)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def json_stats(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, keys, depth, arrays, longest_array) of each JSON document, over all its levels; keys null where it doesn't parse."""

    def walk(text):
        import json

        try:
            todo, keys, depth, arrays, longest = [(json.loads(text), 1)], 0, 0, 0, 0
        except (TypeError, ValueError):
            return None, None, None, None
        while todo:
            x, d = todo.pop()
            if isinstance(x, dict):
                keys += len(x)
                depth = max(depth, d)
                todo += [(v, d + 1) for v in x.values()]
            elif isinstance(x, list):
                arrays, longest, depth = arrays + 1, max(longest, len(x)), max(depth, d)
                todo += [(v, d + 1) for v in x]
        return keys, depth, arrays, longest

    @F.pandas_udf("keys long, depth long, arrays long, longest_array long")
    def stats(c):
        import pandas as pd

        return pd.DataFrame([walk(x) for x in c], columns=["keys", "depth", "arrays", "longest_array"]).astype("Int64")

    return df.select(key, stats(F.col(col)).alias("s")).select(key, "s.*")


def line_tally(lines: DataFrame, patterns: dict[str, str], by: str = "path", line: str = "line") -> DataFrame:
    """(by, pattern, n): lines that match each named pattern; patterns without a match give 0. One pass, no join."""
    sums = lines.groupBy(by).agg(*(F.count_if(F.col(line).rlike(p)).alias(k) for k, p in patterns.items()))
    return sums.select(by, F.explode(F.array(*(F.struct(F.lit(k).alias("pattern"), F.col(k).alias("n")) for k in patterns))).alias("x")).select(by, "x.pattern", "x.n")

"""File and archive inventories: breakdowns, folder roll-ups, duplicates, archive sums and timing, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Categories in the order in which they are tested and win ties.
CATEGORIES = ("photo", "audio", "video", "archive", "document", "other")


def extension(path: Column) -> Column:
    """Text after the last dot of the last path segment, lower case; '' without a dot."""
    base = F.element_at(F.split(F.coalesce(path, F.lit("")), "[/\\\\]"), -1)
    return F.lower(F.regexp_extract(base, r"\.([^.]*)$", 1))


def breakdown(files: DataFrame) -> DataFrame:
    """(level, name, count, bytes) of files(category, ext, size): per category (zero rows too), per extension, in total, and distinct extensions.

    One aggregation with grouping sets.
    """
    g = files.groupingSets([["category"], ["ext"], []], "category", "ext").agg(F.grouping_id().alias("g"), F.count("*").alias("count"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_distinct("ext").alias("exts"))
    level = F.when(F.col("g") == 1, "category").when(F.col("g") == 2, "ext").otherwise("total")
    rows = g.select(level.alias("level"), F.coalesce("category", "ext", F.lit("all")).alias("name"), "count", "bytes", "exts", "g")
    zero = files.sparkSession.createDataFrame([("category", c) for c in CATEGORIES], "level string, name string")
    cats = zero.join(rows.where("g = 1"), ["level", "name"], "full_outer").select("level", "name", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
    exts = rows.where("g = 3").select(F.lit("distinct_exts").alias("level"), F.lit("all").alias("name"), F.col("exts").alias("count"), F.lit(0).cast("long").alias("bytes"))
    return cats.unionByName(rows.where("g <> 1").select("level", "name", "count", "bytes")).unionByName(exts)


def ancestors(path: Column) -> Column:
    """Every folder above a path, from the first segment down."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def rollup_paths(files: DataFrame) -> DataFrame:
    """(folder, files, bytes, one byte column per category) for every ancestor folder of files(path, size, category).

    Depth is bounded by the path, so one explode does what a recursion would; sums combine before the shuffle.
    """
    up = files.select(F.explode(ancestors(F.col("path"))).alias("folder"), "size", "category")
    return up.groupBy("folder").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), *(F.sum(F.when(F.col("category") == c, F.col("size")).otherwise(0)).alias(c) for c in CATEGORIES))


def dominant_category(rollup: DataFrame) -> DataFrame:
    """(folder, category): the category with most bytes, the first in the fixed order on a tie."""
    best = F.array_max(F.array(*(F.struct(F.col(c).alias("b"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(CATEGORIES))))
    return rollup.select("folder", best["c"].alias("category"))


def pool_tail(files: DataFrame, min_share: float = 0.01, min_files: int = 8) -> DataFrame:
    """(folder, name, size, count, category): in each folder, files under `min_share` of its bytes become one row when `min_files` or more are.

    The pooled row has their bytes, count and dominant category; total bytes don't change. One shuffle by folder for the
    sums; the pooled rows are summed per (folder, category) before they meet.
    """
    per = W.partitionBy("folder")
    t = files.withColumn("_tiny", F.col("size") < min_share * F.sum("size").over(per)).withColumn("_pool", F.col("_tiny") & (F.sum(F.col("_tiny").cast("int")).over(per) >= min_files))
    kept = t.where("not _pool or _pool is null").select("folder", "name", "size", F.lit(1).cast("long").alias("count"), "category")
    order = F.create_map(*(x for i, c in enumerate(CATEGORIES) for x in (F.lit(c), F.lit(-i))))
    cats = t.where("_pool").groupBy("folder", "category").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    pooled = cats.groupBy("folder").agg(F.sum("b").alias("size"), F.sum("n").alias("count"), F.max_by("category", F.struct("b", order[F.col("category")])).alias("category"))
    return kept.unionByName(pooled.select("folder", F.format_string("%d files", "count").alias("name"), "size", "count", "category"))


def hash_files(files: DataFrame, algos: tuple[str, ...] = ("sha256",), content: str = "content") -> DataFrame:
    """files plus one hex column per algorithm (md5, sha1, sha256, sha512), of whole contents."""
    c = F.col(content)
    how = {"md5": F.md5(c), "sha1": F.sha1(c), "sha256": F.sha2(c, 256), "sha512": F.sha2(c, 512)}
    return files.withColumns({a: how[a] for a in algos})


def duplicate_files(hashes: DataFrame, digest: str = "sha256", path: str = "path", size: str | None = None) -> DataFrame:
    """(digest, copies, first_path[, wasted]): contents that occur more than once.

    Only the count and the smallest path of a group are kept, so a group of any size is one small row.
    """
    extra = [(F.max(size) * (F.count("*") - 1)).alias("wasted")] if size else []
    return hashes.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count("*").alias("copies"), F.min(path).alias("first_path"), *extra).where("copies > 1")


def verify_crc(entries: DataFrame, most: int = 10) -> DataFrame:
    """(archive, passed, failed, skipped, mismatches): recomputed CRC-32 of entries(archive, name, crc, content) against the stored one.

    Entries without content are skipped; the first `most` failing names are listed.
    """
    state = F.when(F.col("content").isNull() | F.col("crc").isNull(), "skipped").when(F.crc32("content") == F.col("crc"), "passed").otherwise("failed")
    e = entries.withColumn("_s", state)
    r = e.withColumn("_r", F.row_number().over(W.partitionBy("archive", "_s").orderBy("name")))
    return r.groupBy("archive").agg(*(F.count_if(F.col("_s") == s).alias(s) for s in ("passed", "failed", "skipped")), F.array_sort(F.collect_list(F.when((F.col("_s") == "failed") & (F.col("_r") <= most), F.col("name")))).alias("mismatches"))


def summarise_archives(entries: DataFrame) -> DataFrame:
    """One row per archive of entries (FIXTURES.md B): counts, sizes, saved percent, methods, encryption, ratios, suspicion."""
    ratio = F.when(F.col("comp_size") > 0, F.col("uncomp_size") / F.col("comp_size")).otherwise(0.0)
    files = ~F.coalesce("is_dir", F.lit(False))
    per = entries.groupBy("archive").agg(
        F.count_if(files).alias("files"), F.count_if(~files).alias("dirs"), F.sum("comp_size").alias("comp"), F.sum("uncomp_size").alias("uncomp"),
        F.count_if(F.col("flags").bitwiseAND(F.lit(1)) == 1).alias("encrypted"), F.coalesce(F.bool_or("zip64"), F.lit(False)).alias("zip64"),
        F.min_by(F.shiftright("version_made_by", 8), "name").alias("host_system"), F.max(ratio).alias("worst_ratio"), F.max_by("name", ratio).alias("worst_entry"),
    )
    methods = entries.where(files).groupBy("archive", "method").agg(F.count("*").alias("n")).groupBy("archive").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "n")))).alias("methods"))
    overall = F.when(F.col("comp") > 0, F.col("uncomp") / F.col("comp")).otherwise(0.0)
    saved = F.when(F.col("uncomp") > 0, F.floor(100.0 * (1 - F.col("comp") / F.col("uncomp")) + 0.5)).otherwise(0).cast("long")
    return per.join(methods, "archive", "left").withColumns({"saved_percent": saved, "overall_ratio": overall, "suspicious": (overall > 100) | (F.col("worst_ratio") > 1000)})


def timing(entries: DataFrame, now: Column, by: str = "archive", ts: str = "ts", buckets: int = 24) -> DataFrame:
    """(by, entries, earliest, latest, span_ms, histogram, pattern, placeholder, future): when a group's entries are dated.

    pattern: bulk (three or more within two seconds), identical or spread. placeholder counts 1980-01-01; future, dates a
    day or more ahead of `now`. The histogram has equal buckets from first to last; empty ones are 0.
    """
    t = entries.where(F.col(ts).isNotNull()).select(by, F.unix_millis(F.col(ts).cast("timestamp")).alias("t"), F.col(ts).cast("timestamp").alias("at"))
    ends = t.groupBy(by).agg(F.count("*").alias("entries"), F.min("t").alias("a"), F.max("t").alias("b"), F.count_if(F.to_date("at") == F.lit("1980-01-01").cast("date")).alias("placeholder"), F.count_if(F.col("at") > now + F.expr("INTERVAL 1 DAY")).alias("future"))
    span = F.col("b") - F.col("a")
    k = F.when(span == 0, 0).otherwise(F.least(F.lit(buckets - 1), F.floor((F.col("t") - F.col("a")) / span * buckets))).cast("int")
    hist = t.join(ends.select(by, "a", "b"), by).groupBy(by, k.alias("k")).agg(F.count("*").alias("n")).groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    pattern = F.when((F.col("entries") >= 3) & (span <= 2000) & (span > 0), "bulk").when((F.col("entries") > 1) & (span == 0), "identical").otherwise("spread")
    filled = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    return ends.join(hist, by).select(by, "entries", F.timestamp_millis("a").alias("earliest"), F.timestamp_millis("b").alias("latest"), span.alias("span_ms"), filled.alias("histogram"), pattern.alias("pattern"), "placeholder", "future")


def catalog_counts(catalog: DataFrame) -> DataFrame:
    """(category, extensions): distinct extensions, each counted in the first category that lists it, and 'all'. catalog: (ord, cat, exts array)."""
    e = catalog.select("ord", "cat", F.explode("exts").alias("e")).select("ord", "cat", F.lower("e").alias("e"))
    first = e.groupBy("e").agg(F.min_by("cat", "ord").alias("category"))
    return first.groupingSets([["category"], []], "category").agg(F.count("*").alias("extensions")).select(F.coalesce("category", F.lit("all")).alias("category"), "extensions")


def tree_order(rollup: DataFrame, path: str = "path", is_dir: str = "is_dir") -> DataFrame:
    """Rows by parent, folders before files, then by name regardless of case."""
    parent, name = F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lower(F.element_at(F.split(path, "/"), -1))
    return rollup.orderBy(parent, F.desc(is_dir), name, path)

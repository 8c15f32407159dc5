"""Mixing sources to target weights by a low-discrepancy source schedule. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: 2**32 divided by the golden ratio, odd: slot t falls on the point t * GOLDEN mod 2**32.
GOLDEN, POINTS = 2654435769, 2**32
BLOCK = 64
NEAR = 1024  # slots, or documents of a source, that one window task ranks together (about)
SLICE = 8192  # slots whose documents are written together, in order


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """(source, source_size, target) of (source, size) rows.

    Sources in code-point order, null last, weigh `weights` in turn. They share `share` of all words by weight; a target
    stops at `most` times its source's size and the excess is reshared by weight until none is above. In closed form:
    sources sorted by cap/weight fill up in that order, the others get what is left by weight. The window without
    partitions sees one row per source only. Sources without words get 0.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = len(weights)
    named = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(n)) + 1).cast("int")).cast("double"))
    all_of = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_level = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    filled = (
        named.withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("all_words", F.sum("source_size").over(all_of) * F.lit(float(share)))
        .withColumn("left_words", F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_w", F.sum("w").over(all_of) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("open", F.col("cap") * F.col("left_w") >= F.col("left_words") * F.col("w"))
    )
    # the first source in this order that doesn't reach its cap sets the level of all after it
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), "source", (F.col("left_words") / F.col("left_w")).alias("level")))).over(all_of)["level"]
    return filled.withColumn("level", level).select("source", "source_size", F.when(F.col("open"), F.col("level") * F.col("w")).otherwise(F.col("cap")).alias("target"))


def _plan(targets: DataFrame, block: int, most: int) -> DataFrame:
    """What the schedule needs of each source: blocks, the slots that its target is worth, its stretch of points, the most slots it may get."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    t = targets.withColumn("words", F.least(F.floor(F.col("target") + 0.5), most * F.col("source_size"))).where("words > 0")
    t = t.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("most", most * F.col("blocks"))
    t = t.withColumn("slots", F.floor(F.col("words") / F.col("source_size")) * F.col("blocks") + F.ceil(F.col("words") % F.col("source_size") / block))
    t = t.withColumn("sid", F.row_number().over(order)).withColumn("total", F.sum("slots").over(W.partitionBy()))
    upto = F.sum("slots").over(order.rowsBetween(W.unboundedPreceding, 0))
    return t.withColumn("hi", F.floor(upto / F.col("total") * POINTS).cast("long")).withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0).cast("long")))


def schedule(spark, plan: DataFrame, slots: int) -> DataFrame:
    """(slot, sid, r): slot goes to source sid, as its r-th. plan: of _plan(); slots: their number in all.

    Slot t goes to the source whose stretch of cumulative weights holds the t-th golden-ratio point, so any run of slots
    holds each source close to its weight; how many slots a source gets is for the points to say. Slots are ranked in two
    steps (within chunks of slots, then over chunk totals), so that a source with a third of the slots isn't ranked by one
    task. Slots beyond a source's `most` stay empty.
    """
    cells = 4096
    width = POINTS // cells
    stretch = plan.where("hi > lo").select("sid", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))).alias("cell"))
    t = spark.range(slots).select(F.col("id").alias("slot"), F.expr(f"((id % {2**31}) * {GOLDEN}) % {POINTS}").alias("u")).withColumn("cell", F.expr(f"u div {width}"))
    t = t.join(stretch, "cell").where("u >= lo and u < hi").select("slot", "sid", F.expr(f"slot div {NEAR}").alias("chunk"))
    t = t.withColumn("k", F.row_number().over(W.partitionBy("sid", "chunk").orderBy("slot")) - 1)
    sums = t.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("sid").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = t.join(sums.select("sid", "chunk", "base"), ["sid", "chunk"]).select("slot", "sid", (F.col("base") + F.col("k")).alias("r"))
    return ranked.join(plan.select("sid", "most"), "sid").where("r < most").select("slot", "sid", "r")


def _laid_out(rows: DataFrame, total: int) -> DataFrame:
    """rows(sid, key, size, ...) plus at: words of the same source before it, in shuffled order; ranked in two steps (within about total / NEAR stretches of the hash, then over their sums)."""
    parts = max(1, -(-total // NEAR))
    h = rows.withColumn("h", F.conv(F.substring(F.md5(F.concat_ws("/", F.col("key").cast("string"), "copy").cast("binary")), 1, 12), 16, 10).cast("long"))
    h = h.withColumn("part", F.floor(F.col("h") / 2.0**48 * parts).cast("long"))
    inside = W.partitionBy("sid", "part").orderBy("h", "key", "copy").rowsBetween(W.unboundedPreceding, -1)
    h = h.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    sums = h.groupBy("sid", "part").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("sid").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return h.join(sums.select("sid", "part", "base"), ["sid", "part"]).withColumn("at", F.col("at") + F.col("base")).drop("h", "part", "base")


def mix_plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, block: int = BLOCK, most: int = 3) -> dict[str, DataFrame]:
    """The mix of docs, as tables: `sizes` of the rows, `targets` and `sources`, `laid` out rows, and the schedule's `reads`.

    Each source's documents, shuffled by a fixed hash, are laid end to end and cut into blocks of `block` words; its r-th
    slot reads block r mod blocks. A source's slots are those whose points fall into its stretch, and it stops at its
    rounded target; so its words are its target's, or a few blocks less. No document is read more than `most` times over, and reruns agree (rows with the same key
    are told apart by `copy`, a hash of their text and a count within equal rows). Null or wordless texts have size 0 and
    are never read; an empty table gives empty results. Input columns other than the named ones are ignored.
    """
    sized = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.md5(F.col(text).cast("binary")).alias("hash"))
    same = W.partitionBy("key", "source", "hash").orderBy("size")
    sized = materialize(sized.withColumn("n", F.row_number().over(same)).withColumn("copy", F.concat_ws("-", "hash", "n")), "mix-sizes")
    targets = materialize(source_targets(sized, weights, share, most), "mix-targets")
    plan = materialize(_plan(targets, block, most), "mix-plan")
    slots = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    reads = materialize(schedule(docs.sparkSession, plan, slots), "mix-schedule")
    got = reads.groupBy("sid").agg(F.count("*").alias("got"))
    ids = plan.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    stop = F.least("words", F.expr("got div blocks") * F.col("source_size") + F.least(F.col("got") % F.col("blocks") * block, "source_size"))
    ids = materialize(ids.select("sid", F.col("source").alias("s"), F.col("source_size").alias("pass"), "blocks", stop.alias("stop")), "mix-sources")
    laid = _laid_out(sized.where("size > 0").join(ids, F.col("source").eqNullSafe(F.col("s"))).drop("s"), sized.count())
    part = F.greatest(F.least(F.col("at") + F.col("size"), F.expr("stop % pass")) - F.col("at"), F.lit(0))
    laid = laid.withColumn("taken", F.expr("stop div pass") * F.col("size") + part)
    return {"sizes": sized, "targets": targets, "sources": ids, "laid": laid.withColumn("r", F.expr(f"at div {block}")), "reads": reads}


def mix_sources(docs: DataFrame, **kw) -> DataFrame:
    """(key, copy, size, source, source_size, target, taken, first_slot) of every row of docs; see mix_plan(). first_slot is null for rows that are never read."""
    m = mix_plan(docs, **kw)
    k = m["laid"].join(m["reads"], ["sid", "r"], "left").select("key", "copy", "source", "taken", "slot")
    d = m["sizes"].join(m["targets"].withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    on = d["key"].eqNullSafe(k["key"]) & (d["copy"] == k["copy"]) & d["source"].eqNullSafe(k["source"])
    return d.join(k, on, "left").select(d["key"], d["copy"], "size", d["source"], "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.when(F.col("taken") > 0, F.col("slot")).alias("first_slot"))


def reading_order(docs: DataFrame, block: int = BLOCK, **kw) -> DataFrame:
    """(slot, source, key, copy, from_word, to_word): what the mix reads at each slot, in slot order when sorted."""
    m = mix_plan(docs, block=block, **kw)
    pieces = m["laid"].select("sid", "source", "key", "copy", "at", "size", "blocks", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))).alias("block"))
    pieces = pieces.select("sid", "source", "key", "copy", "block", F.greatest("at", F.col("block") * block).alias("from_word"), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block).alias("to_word"))
    reads = m["reads"].join(m["sources"], "sid").select("sid", "slot", F.expr("r % blocks").alias("block"), F.expr("stop - r div blocks * pass").alias("left"))
    read = reads.join(pieces, ["sid", "block"]).where("from_word < left")
    return read.select("slot", "source", "key", "copy", "from_word", F.least("to_word", "left").alias("to_word"))


def op5(docs: DataFrame) -> DataFrame:
    return mix_sources(docs).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken", "first_slot")


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **kw) -> DataFrame:
    """docs as the mix reads them, written in the order of the schedule: each row as often as its taken words divided by its size, to the nearest number.

    Rows of which less than half is read go, others are repeated up to three times; the c-th reading stands at the slot
    that reads the row's first word for the c-th time. Columns stay those of docs, whatever their names; null keys, texts
    and sources are values like others (a null or wordless text is never read). Texts move twice: to their plan, and to
    their stretch of the schedule.
    """
    m = mix_plan(docs, key, text, source, **kw)
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    name = lambda k, s, h: F.md5(F.to_json(F.struct(k.cast("string").alias("k"), s.cast("string").alias("s"), h.alias("h"))).cast("binary"))
    plan = m["laid"].withColumn("times", times).where("times > 0")
    plan = plan.select(name(F.col("key"), F.col("source"), F.col("hash")).alias("p_name"), F.col("n").alias("p_n"), "sid", F.explode(F.expr("transform(sequence(0, times - 1), c -> r + c * blocks)")).alias("r"))
    plan = plan.join(m["reads"], ["sid", "r"]).select("p_name", "p_n", "slot")
    order = [F.col(f"row.`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    rows = docs.select(F.struct(*docs.columns).alias("row"), name(F.col(key), F.col(source), F.md5(F.col(text).cast("binary"))).alias("name"))
    # equal rows are told apart by a number; partitioned by name as the join is, which therefore moves nothing
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("name").orderBy(*order)))
    read = rows.join(plan, (F.col("name") == F.col("p_name")) & ((F.col("n") - F.col("p_n")) == 0)).select("row", "slot", F.expr(f"slot div {SLICE}").alias("slice"))
    return read.repartition("slice").sortWithinPartitions("slot").select("row.*")


OP5_SQL = rf"""
with d0 as (select doc_id as key, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5(text) as hash from documents),
d as (select key, source, size, concat_ws('-', hash, row_number() over (partition by key, source, hash order by size)) as copy from d0),
per as (select source, sum(size) as source_size from d group by source),
nm as (select source, source_size, source_size * 3.0 as cap, ((row_number() over (order by source nulls last) - 1) % 3 + 1) * 1.0 as w from per),
ord as (select *, sum(source_size) over () * 1.0 - coalesce(sum(cap) over b, 0) as left_words, sum(w) over () - coalesce(sum(w) over b, 0) as left_w
  from nm window b as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
op as (select *, cap * left_w >= left_words * w as open from ord),
lv as (select left_words / left_w as level from op where open order by cap / w, source nulls last limit 1),
tg as (select source, source_size, case when open then (select level from lv) * w else cap end as target from op),
p1 as (select *, least(cast(floor(target + 0.5) as bigint), cast(3 * source_size as bigint)) as words from tg),
p2 as (select source, source_size, words, cast(ceil(source_size / {BLOCK}.0) as bigint) as blocks from p1 where words > 0),
p3 as (select *, cast(words // source_size as bigint) * blocks + cast(ceil((words % source_size) / {BLOCK}.0) as bigint) as slots, row_number() over (order by source nulls last) as sid from p2),
p4 as (select *, cast(floor(sum(slots) over (order by sid) / (sum(slots) over () * 1.0) * {POINTS}) as bigint) as hi, sum(slots) over () as total from p3),
pl as (select *, coalesce(lag(hi) over (order by sid), 0) as lo from p4),
sl as (select t, ((t % {2**31}) * {GOLDEN}) % {POINTS} as u from (select unnest(range((select cast(max(total) as bigint) from pl))) as t)),
rk as (select t, sid, blocks, row_number() over (partition by sid order by t) - 1 as r from sl join pl on u >= lo and u < hi),
rd as (select t, sid, r from rk where r < 3 * blocks),
gt as (select sid, count(*) as got from rd group by sid),
st as (select pl.sid, source, source_size as pass, least(words, coalesce(got, 0) // blocks * source_size + least(coalesce(got, 0) % blocks * {BLOCK}, source_size)) as stop from pl left join gt on gt.sid = pl.sid),
lo as (select d.key, d.copy, d.source, st.sid, size, pass, stop, coalesce(sum(size) over (partition by st.sid order by substr(md5(concat_ws('/', cast(key as varchar), copy)), 1, 12), key, copy rows between unbounded preceding and 1 preceding), 0) as p0
  from d join st on d.source is not distinct from st.source where size > 0),
tk as (select key, copy, source, sid, cast(p0 // {BLOCK} as bigint) as r, (stop // pass) * size + greatest(least(p0 + size, stop % pass) - p0, 0) as taken from lo),
ts as (select key, copy, source, taken, case when taken > 0 then t end as first_slot from tk left join rd on tk.sid = rd.sid and tk.r = rd.r)
select d.key as doc_id, cast(d.size as bigint) as size, cast(source_size as bigint) as source_size, target, cast(coalesce(taken, 0) as bigint) as taken, first_slot
from d join tg on d.source is not distinct from tg.source left join ts on d.key is not distinct from ts.key and d.copy = ts.copy and d.source is not distinct from ts.source
"""

"""Queries over the column functions and small operators, on values derived from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpuslens.functions import scalars as S
from corpuslens.operators import classify, geometry, inventory, search, tracks
from corpuslens.session import ensure_on_workers, shared_dir, table
from corpuslens.sources import extend, readers, sinks


def _part(s, d):
    return table(s, d, "part")


def _orders(s, d):
    return table(s, d, "orders")


def _at(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _pick(values, key: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.expr(key) % len(values) + 1).cast("int"))


_CODES, _CLASSES = ("0.00", "yyyy-mm-dd", "0%", "$#,##0", "General", '"day" 0'), ("number", "date", "percent", "currency", "general", "number")
_ENV, _PATHS = ("a/.env", ".env.local", "x/.env.example", "env", "b\\.env.sample", ".environment"), ("/a", "a/../b", "C:\\x", "a/b..c", "..", "\\\\host\\x")
_HIGH = bytes(range(128, 256)).decode("cp437")
_SEQ = ("ACGTNACGTACGTACGT", "ACGUACGUACGUA", "MKWVTFISLLFLFSSAYS", "")


def _dos(s, d):
    o = _orders(s, d)
    date = F.expr("(year(o_orderdate) - 1980) * 512 + (o_orderkey % 14) * 32 + day(o_orderdate)")
    time = F.expr("(o_orderkey % 24) * 2048 + (o_orderkey % 60) * 32 + o_orderkey % 30")
    return o.select("o_orderkey", F.date_format(S.dos_datetime(date.cast("int"), time.cast("int")), "yyyy-MM-dd HH:mm:ss").alias("at"))


def _names(s, d):
    n = F.upper(F.substring(F.md5(F.col("c_name").cast("binary")), F.lit(1), F.lit(4) + (F.col("c_custkey") % 3).cast("int")))
    c = table(s, d, "customer")
    return c.select("c_custkey", S.clean_name(F.concat(n, F.lit("-_"))).alias("name"), S.is_blocked(n, ["ba", "dea"]).alias("blocked"), S.clean_cause(F.concat(F.lit(" "), "c_mktsegment", F.lit("!_x"))).alias("cause"))


def _clock(s, d):
    e = table(s, d, "events").where("value is not null")
    sample = F.struct(*(F.col("value").alias(a) for a in ("ax", "ay", "az")), *((F.col("value") * 2).alias(a) for a in ("gx", "gy", "gz")))
    f = e.select(F.col("user_id").alias("clip_id"), F.col("event_id").alias("frame"), F.array_repeat(sample, (F.col("event_id") % 3 + 1).cast("int")).alias("samples"), F.lit(16.0).alias("accel_per_g"), F.lit(8.0).alias("gyro_per_dps"))
    return tracks.imu_clock(f, 25.0).select("clip_id", "frame", "i", *(F.round(c, 6).alias(c) for c in ("t", "ax", "az", "gx")))


def _bom(s, d):
    inst = _part(s, d).select(F.concat(F.when(F.col("p_partkey") % 7 == 0, "#R").otherwise("R"), F.col("p_partkey").cast("string")).alias("ref"), F.col("p_type").alias("value"), F.when(F.col("p_partkey") % 5 == 0, False).alias("in_bom"))
    place = table(s, d, "lineitem").where("l_linenumber > 5").select(F.concat(F.lit("R"), F.col("l_partkey").cast("string")).alias("ref"))
    return geometry.bom_crossref(inst, place)


def _natural(s, d):
    p = _part(s, d).select(F.concat(_pick(("R", "C", "U"), "p_partkey"), F.col("p_partkey").cast("string")).alias("ref"))
    ordered = geometry.natural_order(p, "ref")
    # each row with the one that stands before it within its task's stretch of the order says whether it holds
    return ordered.withColumn("at", F.monotonically_increasing_id()).groupBy(F.substring("ref", 1, 1).alias("letter")).agg(F.min_by("ref", "at").alias("first"), F.max_by("ref", "at").alias("last"), F.count("*").alias("n"))


def _traces(s, d):
    e = table(s, d, "events").where("value is not null")
    t = e.select(F.col("user_id").alias("file"), F.col("event_type").alias("var"), F.col("event_id").alias("idx"), (F.col("value") * 3).alias("re"), F.when(F.col("user_id") % 2 == 0, F.col("value") * 4).alias("im"))
    return geometry.summarise_traces(t).withColumns({c: F.round(c, 6) for c in ("first", "last", "low", "high")})


def _catalog(s, d):
    c = _part(s, d).groupBy("p_brand").agg(F.min("p_partkey").alias("ord"), F.collect_set(F.concat(F.lit("X"), (F.col("p_partkey") % 40).cast("string"))).alias("exts"))
    return c.select("ord", F.col("p_brand").alias("cat"), "exts")


def _findings(s, d):
    c = table(s, d, "customer").select("c_mktsegment", "c_name", F.col("c_nationkey").cast("string").alias("nation"))
    return search.to_findings(c, "customers", "Facts", F.col("c_mktsegment"), ["c_name", "nation"]).withColumn("section", F.col("grp"))


def _search(s, d):
    return search.search(_findings(s, d), " Mach ", {"mach": ["#000000012", "nothing"]}).groupBy("section", "field", "matched").agg(F.count("*").alias("n"))


def _labelled(s, d):
    p = _part(s, d).select(F.concat("p_type", F.lit(" "), F.col("p_partkey").cast("string")).alias("label"), F.array(F.concat(F.lit("e"), F.col("p_size").cast("string"))).alias("exts"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("tags"), F.col("p_brand").alias("cat"))
    return search.search_catalog(p, ".E7").select("label", "cat")


def _markers(s, d):
    f = search.to_findings(table(s, d, "documents").select("lang", "source", "doc_id"), "documents", "Facts", F.col("doc_id"), ["lang", "source"]).withColumn("source", F.col("grp"))
    return classify.detect_ai_markers(f, ["EN", "d"], ["Lang"], ["s1", "web"])


def _category(s, d):
    files = table(s, d, "pages").select("page_id", F.concat(F.lit("X"), (F.length("html") % 9).cast("string")).alias("ext"))
    rules = s.createDataFrame([(f"x{k}", c, p) for k, c, p in ((0, "photo", 1), (1, "audio", 1), (2, "video", 2), (2, "photo", 1), (5, "archive", 1))], "ext string, cat string, priority int")
    return classify.with_category(files, rules).select("page_id", "category")


def _registered(s, d):
    p = _part(s, d).select(F.col("p_partkey").cast("string").alias("path"), F.concat("p_name", F.lit("")).cast("binary").alias("head"))
    low = s.createDataFrame([("pn", 0, "50", "text", "Part name", 900)], classify.SIGNATURES)
    return classify.identify(p, classify.signatures(s).unionByName(low))


def _folder(s, name):
    return f"{shared_dir(s)}/corpuslens-{name}-{uuid.uuid4().hex}"


def _scan(s, d):
    f = _folder(s, "corpus")
    _part(s, d).select("p_size", F.concat_ws("|", "p_partkey", "p_name").alias("value")).repartition("p_size").sortWithinPartitions("p_size").write.partitionBy("p_size").text(f)
    files = readers.with_head(readers.scan_corpus(s, f, content=True, glob="*.txt"), 4)
    return files.groupBy(F.regexp_extract("path", r"p_size=(\d+)", 1).alias("size"), "ext").agg(F.sum("size").alias("bytes"), F.max(F.length("head")).cast("long").alias("head"))


def _read_back(s, d):
    f = _folder(s, "lines")
    _orders(s, d).select("o_orderpriority", F.format_string("%d\n  and %s", "o_orderkey", "o_orderstatus").alias("value")).write.partitionBy("o_orderpriority").text(f)
    return readers.read_lines(s, f, unfold=True).where("line <> ''").groupBy("line").agg(F.count("*").alias("n"))


def _csv_back(s, d):
    f = _folder(s, "findings")
    sinks.write_findings_csv(_findings(s, d), f)
    back = s.read.option("header", False).option("escape", '"').csv(f).toDF("section", "grp", "field", "value").where("value <> 'Value'")
    return back.groupBy("section", "grp", "field").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


def _json_back(s, d):
    f = _folder(s, "json")
    c = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), "c_name", "c_mktsegment")
    sinks.write_findings_json(search.to_findings(c, "x", "Facts", F.col("key"), ["c_name", "c_mktsegment"]).withColumn("source", F.col("grp")), f)
    return s.read.json(f).select(F.col("Facts.c_name").alias("name"), F.col("Facts.c_mktsegment").alias("segment"))


def _backup(s, d):
    f = _folder(s, "backup")
    c = table(s, d, "customer").select("c_custkey", F.concat("c_name", F.lit(', "quoted"')).alias("note"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("segment"))
    sinks.write_backup(c, f)
    return s.read.csv(f, header=True, escape='"', schema="c_custkey long, note string, segment string")


def _imu_back(s, d):
    f = _folder(s, "imu")
    e = table(s, d, "events").where("value is not null").select(F.col("user_id").alias("clip_id"), F.col("event_id").cast("double").alias("t"), *(F.floor("value").cast("double").alias(a) for a in ("gx", "gy", "gz", "ax", "ay", "az")))
    sinks.write_imu(e, f, "scaled", 0.5)
    v = F.split("value", ",")
    return s.read.text(f"{f}/samples").select((v[0].cast("double") / 2).alias("t"), (v[1].cast("double") / 2).alias("gx"), (v[6].cast("double") / 2).alias("az"))


def _cells_back(s, d):
    f = _folder(s, "cells")
    p = _part(s, d).select(F.expr("""concat(p_partkey, ',"', p_name, ', ""x""', char(10), 'y"', repeat(',z', int(p_partkey % 3)))""").alias("value"))
    p.write.text(f)
    return readers.read_cells(s, f).select(F.get("cells", F.lit(0)).cast("long").alias("key"), F.get("cells", F.lit(1)).alias("note"), F.size("cells").alias("n"))


def _extracted(s, d):
    def names(path, content):
        if path.startswith("7"):
            raise ValueError("a seven")
        return [("Part", "name", "upper", content.decode().upper())]

    ensure_on_workers(s)
    extend.register_extractor(["PRT"], names)
    p = _part(s, d)
    return extend.run_extractors(p.select(F.concat(F.col("p_partkey").cast("string"), F.lit(".x")).alias("path"), F.when(F.col("p_partkey") % 2 == 0, "prt").otherwise("other").alias("ext"), F.col("p_name").cast("binary").alias("content")))


QUERIES = {
    "f3_human_distance": lambda s, d: _part(s, d).select("p_partkey", S.human_distance(F.col("p_partkey") * 14).alias("distance")),
    "f4_dos_datetime": _dos,
    "f5_filetime": lambda s, d: table(s, d, "events").select("event_id", _at(S.filetime((F.unix_micros("ts") + 11_644_473_600_000_000) * 10 + F.col("event_id") % 10)).alias("at")),
    "f6_serial_date": lambda s, d: _orders(s, d).select("o_orderkey", _at(S.serial_date(F.unix_seconds("o_orderdate") / 86400.0 + 25569 + F.col("o_orderkey") % 8 / 8.0)).alias("at")),
    "f6_format_class": lambda s, d: _part(s, d).select("p_partkey", S.format_class(_pick(_CODES, "p_partkey")).alias("class")),
    "f7_guid": lambda s, d: _part(s, d).select("p_partkey", S.guid(F.unhex(F.when(F.col("p_partkey") % 9 > 0, F.md5(F.col("p_name").cast("binary"))).otherwise("00"))).alias("guid")),
    "f8_nmea_degrees": lambda s, d: table(s, d, "customer").select("c_custkey", F.round(S.nmea_degrees(F.expr("concat(lpad(c_custkey % 90, 2, '0'), lpad(c_custkey * 7 % 60, 2, '0'), '.5')"), _pick(("N", "S", "e", "w"), "c_custkey")), 9).alias("degrees")),
    "f8_igc_degrees": lambda s, d: table(s, d, "customer").select("c_custkey", F.round(S.igc_degrees(F.expr("concat(lpad(c_custkey % 90, 2, '0'), lpad(c_custkey * 7 % 60, 2, '0'), '250', if(c_custkey % 2 = 0, 'N', 'S'))")), 9).alias("degrees")),
    "f9_xor_checksum": lambda s, d: _part(s, d).select("p_partkey", S.xor_checksum("p_name").alias("sum")),
    "f12_rational_seconds": lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.rational_seconds(F.expr("concat(int(l_quantity), if(l_partkey % 3 = 0, '', concat('/', l_linenumber)), 's')")), 9).alias("seconds")),
    "f12_timecode": lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.timecode_seconds(F.expr("concat('01:', l_linenumber, ':', int(l_quantity), if(l_partkey % 2 = 0, ';', ':'), '12')"), 24), 9).alias("seconds")),
    "f13_sequence_type": lambda s, d: _part(s, d).select("p_partkey", S.sequence_type(F.concat(F.lower(_pick(_SEQ, "p_partkey")), F.lit(" 12"))).alias("type")),
    "f14_compact_number": lambda s, d: _part(s, d).select("p_partkey", S.compact_number(F.col("p_partkey") % 1000 / 100.0).alias("text")),
    "f16_cp437": lambda s, d: _part(s, d).select("p_partkey", S.decode_cp437(F.unhex(F.hex(128 + F.col("p_partkey") % 128))).alias("text")),
    "f17_strip_ansi": lambda s, d: _part(s, d).select("p_partkey", S.strip_ansi(F.concat(F.lit("\x1b[1;31m"), "p_name", F.lit("\x1b[0m!\x1b[2K"))).alias("text")),
    "p8_env_files": lambda s, d: _part(s, d).select("p_partkey", S.is_env_file(_pick(_ENV, "p_partkey")).alias("env")),
    "p14_unsafe_paths": lambda s, d: _part(s, d).select("p_partkey", S.is_unsafe_path(_pick(_PATHS, "p_partkey")).alias("unsafe")),
    "p11_clean_names": _names, "w8_imu_clock": _clock, "j3_bom_crossref": _bom, "k3_natural_order": _natural, "g19_summarise_traces": _traces,
    "a37_catalog_counts": lambda s, d: inventory.catalog_counts(_catalog(s, d)), "q2_section_search": _search, "q3_search_catalog": _labelled, "p13_ai_markers": _markers, "p1_with_category": _category, "u1_signatures": _registered,
    "s1_scan_corpus": _scan, "s7_read_lines": _read_back, "s9_findings_csv": _csv_back, "s10_findings_json": _json_back, "s11_write_backup": _backup, "w9_write_imu": _imu_back, "s4_read_cells": _cells_back,
    "u2_extractors": _extracted,
}


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_FIND = "(select c_mktsegment as section, 'c_name' as field, c_name as value from customer union all select c_mktsegment, 'nation', cast(c_nationkey as varchar) from customer)"
ORACLE = {
    "f3_human_distance": "select p_partkey, case when p_partkey = 0 then '-' when p_partkey * 14 >= 1000 then printf('%.2f km', p_partkey * 14 / 1000.0) else p_partkey * 14 || ' m' end as distance from part",
    "f4_dos_datetime": "select o_orderkey, case when o_orderkey % 14 between 1 and 12 then printf('%04d-%02d-%02d %02d:%02d:%02d', year(o_orderdate), o_orderkey % 14, day(o_orderdate), o_orderkey % 24, o_orderkey % 60, o_orderkey % 30 * 2) end as at from orders where not (o_orderkey % 14 between 1 and 12 and day(o_orderdate) > 28) union all select o_orderkey, case when day(o_orderdate) <= day(last_day(make_date(year(o_orderdate), cast(o_orderkey % 14 as int), 1))) then printf('%04d-%02d-%02d %02d:%02d:%02d', year(o_orderdate), o_orderkey % 14, day(o_orderdate), o_orderkey % 24, o_orderkey % 60, o_orderkey % 30 * 2) end from orders where o_orderkey % 14 between 1 and 12 and day(o_orderdate) > 28",
    "f5_filetime": "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as at from events",
    "f6_serial_date": "select o_orderkey, strftime(o_orderdate + to_hours(cast(3 * (o_orderkey % 8) as int)), '%Y-%m-%d %H:%M:%S.%f') as at from orders",
    "f6_format_class": f"select p_partkey, ({_list(_CLASSES)})[p_partkey % 6 + 1] as class from part",
    "f7_guid": "select p_partkey, case when p_partkey % 9 > 0 then h[7:8] || h[5:6] || h[3:4] || h[1:2] || '-' || h[11:12] || h[9:10] || '-' || h[15:16] || h[13:14] || '-' || h[17:20] || '-' || h[21:32] end as guid from (select p_partkey, md5(p_name) as h from part)",
    "f8_nmea_degrees": "select c_custkey, round((case when c_custkey % 4 in (1, 3) then -1 else 1 end) * (c_custkey % 90 + (c_custkey * 7 % 60 + 0.5) / 60.0), 9) as degrees from customer",
    "f8_igc_degrees": "select c_custkey, round((case when c_custkey % 2 = 1 then -1 else 1 end) * (c_custkey % 90 + (c_custkey * 7 % 60 + 0.25) / 60.0), 9) as degrees from customer",
    "f9_xor_checksum": "select p_partkey, list_reduce(list_transform(string_split(p_name, ''), lambda x: ascii(x)), lambda a, b: xor(a, b)) as sum from part",
    "f12_rational_seconds": "select l_orderkey, l_linenumber, round(cast(floor(l_quantity) as double) / case when l_partkey % 3 = 0 then 1 else l_linenumber end, 9) as seconds from lineitem",
    "f12_timecode": "select l_orderkey, l_linenumber, round(3600 + 60 * l_linenumber + floor(l_quantity) + 0.5, 9) as seconds from lineitem",
    "f13_sequence_type": "select p_partkey, (['DNA', 'RNA', 'protein', 'unknown'])[p_partkey % 4 + 1] as type from part",
    "f14_compact_number": "select p_partkey, p_partkey % 1000 // 100 || case when p_partkey % 100 = 0 then '' when p_partkey % 10 = 0 then '.' || p_partkey % 100 // 10 else '.' || lpad(cast(p_partkey % 100 as varchar), 2, '0') end as text from part",
    "f16_cp437": f"select p_partkey, substr('{_HIGH}', cast(p_partkey % 128 + 1 as int), 1) as text from part",
    "f17_strip_ansi": "select p_partkey, p_name || '!' as text from part",
    "p8_env_files": "select p_partkey, p_partkey % 6 < 2 as env from part",
    "p14_unsafe_paths": "select p_partkey, p_partkey % 6 <> 3 as unsafe from part",
    "p11_clean_names": "with n as (select *, upper(md5(c_name)[1:4 + c_custkey % 3]) as n from customer), l as (select *, translate(lower(n), '0134578', 'oieastb') as t from n) select c_custkey, case when length(n) = 5 then n end as name, contains(t, 'ba') or contains(t, 'dea') as blocked, lower(c_mktsegment) || '_x' as cause from l",
    "w8_imu_clock": "with e as (select *, event_id % 3 + 1 as n from events where value is not null), i as (select *, unnest(range(n)) as i from e) select user_id as clip_id, event_id as frame, cast(i as int) as i, round((event_id + i / n) / 25.0, 6) as t, round(value / 16, 6) as ax, round(value / 16, 6) as az, round(radians(value * 2 / 8), 6) as gx from i",
    "j3_bom_crossref": "select 'R' || p_partkey as ref, p_type as value, exists (select 1 from lineitem where l_partkey = p_partkey and l_linenumber > 5) as on_board from part where p_partkey % 7 <> 0 and p_partkey % 5 <> 0",
    "k3_natural_order": "select l as letter, l || min(p_partkey) as first, l || max(p_partkey) as last, count(*) as n from (select *, (['R', 'C', 'U'])[p_partkey % 3 + 1] as l from part) group by l",
    "g19_summarise_traces": "with v as (select user_id as file, event_type as var, event_id as idx, case when user_id % 2 = 0 then abs(value) * 5 else value * 3 end as v from events where value is not null) select file, var, count(*) as points, round(arg_min(v, idx), 6) as first, round(arg_max(v, idx), 6) as last, round(min(v), 6) as low, round(max(v), 6) as high, count(*) <= 1 as operating_point from v group by all",
    "a37_catalog_counts": "with c as (select p_brand as cat, min(p_partkey) as ord from part group by 1), e as (select distinct p_brand, p_partkey % 40 as e from part), f as (select e, arg_min(cat, ord) as cat from e join c on p_brand = cat group by e) select cat as category, count(*) as extensions from f group by 1 union all select 'all', count(*) from f",
    "q2_section_search": f"with h as (select *, contains(lower(field || ' ' || value), 'mach') or contains(value, '#000000012') as hit from {_FIND}), f as (select *, max(hit) over (partition by section) as hit_here from h) select section, field, case when hit then 'row' else 'section' end as matched, count(*) as n from f where hit or (not hit_here and section = 'MACHINERY') group by all",
    "q3_search_catalog": "select p_type || ' ' || p_partkey as label, p_brand as cat from part where contains(lower(p_type || ' ' || p_partkey), '.e7') or (p_partkey % 2 = 0 and contains(lower(p_name), '.e7')) or contains('e' || p_size, 'e7')",
    "p13_ai_markers": "with f as (select cast(doc_id as varchar) as source, 'lang' as field, lang as value from documents where lang is not null union all select cast(doc_id as varchar), 'source', source from documents where source is not null), m as (select *, coalesce(case when field = 'lang' then case when contains(lower(value), 'en') then 'EN' when contains(lower(value), 'd') then 'd' end end, case when contains(lower(value), 's1') then 's1' when contains(lower(value), 'web') then 'web' end) as match from f) select * from m where match is not null",
    "p1_with_category": "select page_id, case length(html) % 9 when 0 then 'photo' when 1 then 'audio' when 2 then 'photo' when 5 then 'archive' else 'other' end as category from pages",
    "u1_signatures": "select cast(p_partkey as varchar) as path, case when p_name[1] = 'P' then 'text' end as kind, case when p_name[1] = 'P' then 'pn' end as sniffed_ext, case when p_name[1] = 'P' then 'Part name' end as label from part",
    "s1_scan_corpus": "select cast(p_size as varchar) as size, 'txt' as ext, cast(sum(length(p_partkey || '|' || p_name) + 1) as bigint) as bytes, 4 as head from part group by p_size",
    "s7_read_lines": "select o_orderkey || ' and ' || o_orderstatus as line, count(*) as n from orders group by 1",
    "s9_findings_csv": f"select section, section as grp, field, count(*) as n, min(value) as low, max(value) as high from {_FIND} group by all",
    "s10_findings_json": "select c_name as name, c_mktsegment as segment from customer",
    "s11_write_backup": "select c_custkey, c_name || ', \"quoted\"' as note, case when c_custkey % 3 > 0 then c_mktsegment end as segment from customer",
    "w9_write_imu": "select cast(event_id as double) as t, cast(floor(value) as double) as gx, cast(floor(value) as double) as az from events where value is not null",
    "s4_read_cells": "select p_partkey as key, p_name || ', \"x\"' || chr(10) || 'y' as note, cast(2 + p_partkey % 3 as int) as n from part",
    "u2_extractors": "select p_partkey || '.x' as source, case when cast(p_partkey as varchar)[1] = '7' then 'Error' else 'Part' end as section, case when cast(p_partkey as varchar)[1] = '7' then 'Extractor' else 'name' end as grp, case when cast(p_partkey as varchar)[1] = '7' then 'ValueError' else 'upper' end as field, case when cast(p_partkey as varchar)[1] = '7' then 'a seven' else upper(p_name) end as value from part where p_partkey % 2 = 0",
}

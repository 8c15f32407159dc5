"""Queries over file formats: texts of each format are put together from table rows, and the SQL twin goes by the rows themselves."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.operators import classify, inventory, logs, profile, textstats, tracks
from corpuslens.session import table
from corpuslens.sources import readers


def _texts(df, by: str, order: str, *lines, head: str = "", tail: str = "", sep: str = "\n"):
    """(path, text): one text for each value of `by`, with these lines for every row, in order."""
    body = F.concat_ws(sep, *(F.expr(x) for x in lines))
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), body.alias("l")))), lambda x: x["l"])
    return df.groupBy(F.col(by).cast("string").alias("path")).agg(F.concat(F.lit(head), F.concat_ws(sep, rows), F.lit(tail)).alias("text"))


def _lines(*a, **kw):
    return readers.split_lines(_texts(*a, **kw))


def _orders(s, d):
    return table(s, d, "orders")


def _items(s, d):
    """Lines of orders with a number of their own: line numbers repeat within an order."""
    return table(s, d, "lineitem").withColumn("no", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")))


def _har(s, d):
    o = _orders(s, d).where("o_custkey is not null")
    e = """concat('{"startedDateTime":"2024-01-01T00:00:00Z","time":', o_orderkey % 2000, ',"request":{"method":"GET","url":"http://h', o_custkey, '/', o_orderkey, '","headers":[{"name":"', if(o_orderkey % 3 = 0, 'Cookie', 'Accept'), '","value":"x"}]},"response":{"status":', 100 * (2 + o_orderkey % 4), ',"content":{"size":', o_orderkey % 1000 - 1, ',"mimeType":"', if(o_orderkey % 2 = 0, 'application/json; charset=utf-8', 'image/png'), '"},"headers":[]}}')"""
    return logs.http_entries(_texts(o, "o_custkey", "o_orderkey", e, head='{"log":{"entries":[', tail="]}}", sep=","))


def _http(s, d):
    r = logs.summarise_http(_har(s, d))
    return r.select("path", "requests", "bytes", "time_ms", "slow", "sensitive", *(F.coalesce(F.try_element_at("statuses", F.lit(k)), F.lit(0)).alias(f"s{k}") for k in (200, 300, 400, 500)), F.coalesce(F.try_element_at("types", F.lit("application/json")), F.lit(0)).alias("json"), F.coalesce(F.try_element_at("types", F.lit("image/png")), F.lit(0)).alias("png"))


def _requests(s, d):
    return logs.http_requests(_har(s, d)).groupBy("short_type", "status_class").agg(F.count("*").alias("n"))


def _archives(s, d):
    e = _items(s, d).select(F.col("l_orderkey").alias("archive"), F.col("l_linenumber").cast("string").alias("name"), F.floor(F.col("l_quantity") * 3).cast("long").alias("comp_size"), F.floor(F.col("l_quantity") * (F.col("l_linenumber") + 4)).cast("long").alias("uncomp_size"), F.when(F.col("l_linenumber") % 2 == 0, 8).otherwise(0).alias("method"), (F.col("l_suppkey") % 7 == 0).alias("is_dir"), (F.col("l_partkey") % 2).cast("int").alias("flags"), F.lit(788).alias("version_made_by"), (F.col("l_partkey") % 50 == 0).alias("zip64"))
    r = inventory.summarise_archives(e)
    at = lambda k: F.coalesce(F.try_element_at("methods", F.lit(k)), F.lit(0)).alias(f"m{k}")
    return r.select("archive", "files", "dirs", "comp", "uncomp", "encrypted", "zip64", "host_system", F.round("worst_ratio", 6).alias("worst_ratio"), "saved_percent", F.round("overall_ratio", 6).alias("overall_ratio"), "suspicious", at(0), at(8))


def _crc(s, d):
    e = _items(s, d).select(F.col("l_suppkey").alias("archive"), F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), "l_linenumber").alias("name"), F.col("l_returnflag").cast("binary").alias("c"), (F.col("l_partkey") % 5).alias("k"))
    # crc32 of the three flags: A, N, R
    stored = F.create_map(*(F.lit(x) for p in (("A", 3554254475), ("N", 1130791706), ("R", 1466425173)) for x in p))
    e = e.withColumns({"content": F.when(F.col("k") != 4, F.col("c")), "crc": stored[F.col("c").cast("string")] + F.when(F.col("k") == 3, 1).otherwise(0)})
    return inventory.verify_crc(e).select("archive", "passed", "failed", "skipped", F.array_join("mismatches", ",").alias("mismatches"))


def _json_tally(s, d):
    docs = _texts(_orders(s, d), "o_custkey", "o_orderkey", """concat('{"level":"', o_orderpriority, '"}')""", head='{"runs":[{"results":[', tail="]}]}", sep=",")
    return logs.tally_json(docs, "runs array<struct<results: array<struct<level: string>>>>", "runs[0].results", "level")


def _rules(s, d):
    p = table(s, d, "part")
    lines = _lines(p, "p_size", "p_partkey", """concat(if(p_partkey % 3 = 0, '# ', ''), if(p_partkey % 2 = 0, 'alert tcp', 'drop udp'), ' any any -> any 80 (msg:"', p_name, '"; sid:', p_partkey, '; classtype:', if(p_partkey % 5 = 0, 'trojan-activity', 'misc'), ';)')""", "'# only a remark'")
    return logs.ids_rules(lines)


def _messages(s, d):
    c = table(s, d, "conversations").where("text is not null and role is not null")
    raw = F.concat(F.lit("From "), "role", F.lit("\r\nFrom: The "), "role", F.lit(" <"), "role", F.lit("@example.com>\r\nSubject: turn\r\n "), F.col("turn").cast("string"), F.lit("\r\nReceived: a\r\nreceived: b\r\nDate: Mon, 5 Feb 2024 10:11:12 +0000\r\nAuthentication-Results: mx; spf=pass dkim=fail\r\n\r\n"), F.length("text").cast("string"))
    m = logs.message_facts(c.select("conv_id", "turn", raw.alias("raw")))
    return m.select("conv_id", "turn", "sender", "subject", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), "hops", "spf", "dkim", "dmarc", "body_chars", F.array_join(F.element_at("headers", "received"), "+").alias("received"))


def _mailboxes(s, d):
    c = table(s, d, "conversations").where("role is not null")
    return logs.split_mailbox(_texts(c, "conv_id", "turn", "concat('From ', role)", "concat('turn ', turn)", sep="\r\n")).select("path", "msg_no", F.regexp_extract("raw", r"turn (\d+)", 1).cast("long").alias("turn"))


def _calendar(s, d):
    lines = _lines(_orders(s, d), "o_custkey", "o_orderkey", "'BEGIN:VEVENT'", "concat('UID:', o_orderkey)", "concat('DTSTART;TZID=UTC:', date_format(o_orderdate, 'yyyyMMdd'))", "concat('SUMMARY:', o_orderpriority)", "if(o_orderkey % 2 = 0, 'RRULE:FREQ=DAILY', 'X:1')", "'ATTENDEE:a'", "if(o_orderkey % 3 = 0, 'ATTENDEE;X=1:b', 'X:2')", "'END:VEVENT'")
    return logs.summarise_calendar(lines)[1]


def _ldif(s, d):
    lines = _lines(table(s, d, "customer"), "c_nationkey", "c_custkey", "concat('dn: cn=', c_custkey)", "concat('cn: ', c_name)", "concat('mail: ', c_custkey, '@example.com')", "'objectClass: Person'", "'objectclass: top'", "if(c_custkey % 4 = 0, 'changetype: add', '')")
    return logs.summarise_ldif(lines)


def _diff(s, d):
    return logs.summarise_diff(_lines(_items(s, d), "l_suppkey", "l_partkey", "concat('--- a/f', l_partkey % 11)", "if(l_partkey % 5 = 0, '+++ /dev/null', concat('+++ b/f', l_partkey % 11, '\\t2024'))", "'@@ -1 +1 @@'", "'-old'", "repeat('+new\\n', int(l_linenumber - 1)) || '+new'", "' same'"))


def _bib(s, d):
    return logs.summarise_bib(_lines(_orders(s, d), "o_custkey", "o_orderkey", "concat(if(o_orderkey % 2 = 0, '@Article{', '@book{'), 'k', o_orderkey % 3, ',')", "concat('  year = {', year(o_orderdate), '},')", "'}'", "'@comment{x, year = {1900}}'"))


def _feed(s, d):
    f = _texts(_orders(s, d), "o_custkey", "o_orderkey", """concat('<item><title>', o_orderkey, '</title><pubDate>', date_format(o_orderdate, 'EEE, d MMM yyyy'), ' 00:00:00 GMT</pubDate>', if(o_orderkey % 2 = 0, concat('<enclosure url="u" length="', o_orderkey, '"/>'), ''), '</item>')""", head="<rss><channel>", tail="</channel></rss>")
    r = logs.summarise_feed(f)
    return r.select("path", "items", F.date_format("first", "yyyy-MM-dd").alias("first"), F.date_format("last", "yyyy-MM-dd").alias("last"), "enclosures", "enclosure_bytes")


def _fasta(s, d):
    r = logs.sequence_stats(_lines(table(s, d, "part"), "p_size", "p_partkey", "concat('>', p_partkey)", "concat(repeat('GC', int(p_partkey % 7)), 'ACGTN')", "'aattn'"))
    return r.withColumns({c: F.round(c, 6) for c in ("mean_length", "gc_percent")})


def _workout(s, d):
    t = _texts(_items(s, d), "l_orderkey", "no", "concat('<Lap><TotalTimeSeconds>', int(l_quantity), '</TotalTimeSeconds><DistanceMeters>', int(l_quantity) * 10, '</DistanceMeters><Calories>', l_linenumber, '</Calories><Track><Trackpoint><DistanceMeters>5</DistanceMeters><HeartRateBpm><Value>', 60 + int(l_quantity), '</Value></HeartRateBpm><Cadence>', 80 + l_linenumber, '</Cadence></Trackpoint></Track></Lap>')")
    return logs.summarise_workout(t)


def _nmea(s, d):
    body = "concat('GPGGA,', lpad(l_linenumber, 6, '0'), ',', lpad(10 + l_linenumber, 2, '0'), '30.0,', if(l_partkey % 2 = 0, 'N', 'S'), ',020', '15.0,E,', l_partkey % 3, ',0', l_linenumber, ',', l_linenumber, '.5,10,M')"
    i = _items(s, d).withColumn("body", F.expr(body))
    from corpuslens.functions.scalars import xor_checksum

    i = i.withColumn("sum", F.lpad(F.hex(F.when(F.col("l_partkey") % 4 == 0, xor_checksum("body").bitwiseXOR(F.lit(1))).otherwise(xor_checksum("body"))), 2, "0"))
    r = logs.summarise_nmea(_lines(i, "l_orderkey", "no", "concat('$', body, '*', sum)", "'not a sentence'"))
    return r.select("path", "sentences", "fixes", "best_hdop", "most_satellites", "first_time", "last_time", *(F.round(f"{k}_{c}", 6).alias(f"{k}_{c}") for c in ("lat", "lon") for k in ("min", "max")), "checksum_ok", "checksum_bad", F.element_at("types", "GGA").alias("gga"))


def _igc(s, d):
    r = logs.summarise_igc(_lines(_items(s, d), "l_orderkey", "no", "concat('B', lpad(l_linenumber, 6, '0'), lpad(10 + l_linenumber, 2, '0'), '30000', if(l_partkey % 2 = 0, 'N', 'S'), '02015000EA', lpad(int(l_quantity), 5, '0'), if(l_partkey % 3 = 0, '00000', lpad(int(l_quantity) + 1, 5, '0')))", "'HFPLTPILOTINCHARGE: Ann'"))
    return r.withColumns({f"{k}_{c}": F.round(f"{k}_{c}", 6) for c in ("lat", "lon") for k in ("min", "max")})


def _playlist(s, d):
    return logs.summarise_playlist(_lines(_items(s, d), "l_orderkey", "no", "concat('#EXTINF:', int(l_quantity), '.5,')", "'seg.ts'", "concat('#EXT-X-STREAM-INF:PROGRAM-ID=1,BANDWIDTH=', l_partkey, ',RESOLUTION=640x', l_linenumber)", "'# remark'", "concat('v', l_partkey, '.m3u8')", "if(l_linenumber = 1 and l_orderkey % 2 = 0, '#EXT-X-ENDLIST', '')"))


def _features(s, d):
    f = _texts(_items(s, d), "l_orderkey", "no", """concat('{"type":"Feature","geometry":{"type":"', if(l_partkey % 2 = 0, 'Point', 'MultiPoint'), '","coordinates":', if(l_partkey % 2 = 0, concat('[', l_linenumber, ',', int(l_quantity), ']'), concat('[[', l_linenumber, ',', int(l_quantity), ',7],[', -l_linenumber, ',0,9]]')), '},"properties":{"k', l_linenumber % 3, '":"v"}}')""", head='{"features":[', tail="]}", sep=",")
    return logs.summarise_features(f)


def _notebooks(s, d):
    t = _texts(_items(s, d), "l_orderkey", "no", """concat('{"cell_type":"', if(l_partkey % 3 = 0, 'markdown', 'code'), '","source":["a","b"],"outputs":[', if(l_partkey % 2 = 0, '{"x":1}', ''), ']}')""", head='{"cells":[', tail="]}", sep=",")
    return logs.summarise_notebooks(t)


def _tensors(s, d):
    t = _texts(_items(s, d), "l_orderkey", "no", """concat('"t', l_linenumber, '":{"dtype":"', if(l_partkey % 2 = 0, 'F16', 'F32'), '","shape":[', l_linenumber, ',', int(l_quantity), ']}')""", head='{"__metadata__":{"dtype":null},', tail="}", sep=",")
    return logs.summarise_tensors(t).withColumn("dtypes", F.array_join("dtypes", ","))


def _locks(s, d):
    i = _items(s, d)
    cargo = _texts(i, "l_orderkey", "no", "'[[package]]'", "concat('name = \"p', l_partkey, '\"')", "'checksum = \"x\"'", head="version = 3\n").withColumn("path", F.concat("path", F.lit("/Cargo.lock")))
    pip = _texts(i, "l_orderkey", "no", "concat('p', l_partkey, if(l_partkey % 2 = 0, '==1.0', ''))").withColumn("path", F.concat("path", F.lit("/requirements.txt")))
    return logs.lockfile_inventory(cargo.unionByName(pip))


def _crashes(s, d):
    o = _orders(s, d)
    plain = F.concat(F.lit("Process:  app"), F.col("o_custkey").cast("string"), F.lit(" [12]\nVersion:  1."), F.col("o_orderkey").cast("string"), F.lit("\nException Type:  EXC_BAD\nCrashed Thread:  "), (F.col("o_orderkey") % 9).cast("string"), F.lit("\n  0x1000 - 0x2000 lib <6F9619FF-8B86-D011-B42D-00C04FC964FF>\n"))
    js = F.concat(F.lit('{"procName":"app'), F.col("o_custkey").cast("string"), F.lit('","bundleInfo":{"CFBundleShortVersionString":"1.'), F.col("o_orderkey").cast("string"), F.lit('"},"exception":{"type":"EXC_BAD"},"faultingThread":'), (F.col("o_orderkey") % 9).cast("string"), F.lit("}"))
    r = logs.crash_facts(o.select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderkey") % 2 == 0, js).otherwise(plain).alias("text")))
    return r.select("path", "process", "version", "exception", "thread", F.array_join("uuids", ",").alias("uuids"), "images")


def _cards(s, d):
    c = logs.contacts(_lines(table(s, d, "customer"), "c_nationkey", "c_custkey", "'BEGIN:VCARD'", "if(c_custkey % 2 = 0, concat('FN:', c_name), concat('N:Last', c_custkey, ';First;;;'))", "concat('ORG:', c_mktsegment, ';Unit')", "concat('EMAIL;TYPE=work:', c_custkey, '@example.com')", "'item1.EMAIL:b@example.com'", "'TEL:1'", "'ADR:;;1 Road;Town;;;'", "'END:VCARD'"))
    return c.select("path", "name", "organisation", F.array_join("emails", ",").alias("emails"), F.array_join("phones", ",").alias("phones"), F.array_join("addresses", "|").alias("addresses"))


def _warc(s, d):
    o = _orders(s, d)
    r = logs.summarise_warc(_lines(o, "o_custkey", "o_orderkey", "concat('WARC-Type: ', if(o_orderkey % 2 = 0, 'request', 'response'))", "concat('WARC-Target-URI: <http://h', o_orderkey % 5, '.org/', o_orderkey, '>')", "concat('WARC-Date: ', date_format(o_orderdate, 'yyyy-MM-dd'), 'T00:00:00Z')"))
    at = lambda k: F.coalesce(F.try_element_at("types", F.lit(k)), F.lit(0)).alias(k)
    return r.select("path", "records", "urls", "hosts", F.date_format("first", "yyyy-MM-dd").alias("first"), F.date_format("last", "yyyy-MM-dd").alias("last"), at("request"), at("response"))


def _ragged(s, d):
    t = table(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("path"), "text")
    lines = readers.split_lines(t).select("path", F.col("line_no").alias("row_no"), F.split("line", ",").alias("cells"))
    return profile.ragged_rows(lines)


def _midi(s, d):
    t = _items(s, d).select(F.col("l_orderkey").alias("file"), (F.col("no") * 480).cast("long").alias("tick"), (F.col("l_quantity") * 10_000).cast("int").alias("us"), F.lit(480).alias("ppq"), F.lit(4800).cast("long").alias("max_tick"))
    r = tracks.midi_duration(t)
    return r.select("file", F.round("seconds", 6).alias("seconds"), F.round("first_bpm", 6).alias("first_bpm"))


def _scenes(s, d):
    f = _items(s, d).select(F.col("l_orderkey").alias("clip_id"), F.col("no").cast("double").alias("t"), F.array((F.col("l_partkey") % 256).cast("int"), (F.col("l_suppkey") % 256).cast("int"), F.col("l_quantity").cast("int") * 5).alias("rgb"))
    return tracks.scene_changes(f).withColumn("diff", F.round("diff", 6))


def _timed(s, d):
    i = _items(s, d).select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").alias("line_no"), F.expr("concat(if(l_partkey % 3 = 0, '', concat('[0', l_linenumber, ':', lpad(int(l_quantity), 2, '0'), '.5]')), if(l_partkey % 5 = 0, '[09:00]', ''), ' words ', l_partkey)").alias("line"))
    return tracks.timed_lines(i)


def _toolpath(s, d):
    r = tracks.toolpath_summary(_lines(_items(s, d), "l_orderkey", "no", "if(no = 1, 'G21\\nG90', '; next')", "concat('G', if(l_partkey % 3 = 0, 0, 1), ' X', int(l_quantity), ' Y', no, ' Z', no, ' F', 100 * no, if(l_partkey % 2 = 0, ' E1', ''))"))
    return r.select("path", "rapid", "feed", "arc", "extrude", F.round("extruded_mm", 4).alias("extruded_mm"), F.round("cut_mm", 4).alias("cut_mm"), "feed_min", "feed_max", "min_x", "max_x", "min_y", "max_y", "min_z", "max_z")


def _relaxed(s, d):
    p = table(s, d, "part").withColumn("j", F.concat(F.lit('{ /* note */ "name": "'), "p_name", F.lit(' // kept", "size": '), F.col("p_size").cast("string"), F.lit(", // remark\n \"list\": [1, 2, ], }")))
    r = readers.parse_relaxed_json(p, "j")
    return r.select("p_partkey", F.try_variant_get("json", "$.name", "string").alias("name"), F.try_variant_get("json", "$.size", "int").alias("size"), F.try_variant_get("json", "$.list[1]", "int").alias("second"))


def _jsonl(s, d):
    o = _orders(s, d).select(F.expr("""case o_orderkey % 5 when 0 then '' when 1 then '{broken' when 2 then concat('{"a":', o_orderkey, '}') when 3 then '{"b":[1],"c":{}}' else concat('{"a":1,"', o_orderstatus, '":2}') end""").alias("line"))
    return readers.profile_jsonl(o).withColumn("keys", F.array_join("keys", ","))


def _keys(s, d):
    banner = ["-----BEGIN RSA PRIVATE KEY-----", "x\nPuTTY-User-Key-File-2: y", "-----BEGIN PGP PRIVATE KEY BLOCK-----", "[Interface]\nPrivateKey = z", "nothing", '{"kty":"RSA","n":"1","d":"2"}', "-----BEGIN OPENSSH PRIVATE KEY-----"]
    p = table(s, d, "part").withColumn("text", F.concat("p_name", F.lit("\n"), F.element_at(F.array(*map(F.lit, banner)), (F.col("p_partkey") % 7 + 1).cast("int"))))
    return classify.flag_key_material(p).select("p_partkey", F.array_join("key_material", ",").alias("key_material"))


_HEADS = ["89504E470D0A1A0A0000", "FFD8FFE000104A464946", "255044462D312E340A25", "612C620A312C320A332C340A", "0001020304050607", "68656C6C6F20776F726C642C2074657874"]
_EXTS = ["png", "jpg", "bin", "csv", "", "txt", "png"]


def _headed(s, d):
    p = table(s, d, "part")
    ext = F.element_at(F.array(*map(F.lit, _EXTS)), (F.col("p_partkey") % 7 + 1).cast("int"))
    head = F.unhex(F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("p_partkey") % 6 + 1).cast("int")))
    return p.select(F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise("")).alias("path"), ext.alias("ext"), head.alias("head"))


def _mismatch(s, d):
    expect = s.createDataFrame([("png", ["png"]), ("jpg", ["jpg"])], "ext string, sniff array<string>")
    return classify.signature_mismatch(_headed(s, d), expect)


def _variants(s, d):
    v = s.createDataFrame([("png", 1, "portable", "hex", "89504E47", False), ("png", 2, "camera", "hexat", "6:4A464946", False), ("png", 3, "other picture", "hex", "", True), ("txt", 1, "greeting", "includes", "world", False), ("txt", 2, "document", "starts", "%PDF", False)], "ext string, ord int, name string, rule string, arg string, is_default boolean")
    return classify.resolve_variant(_headed(s, d), v.withColumn("rule", F.when(F.col("is_default"), "none").otherwise(F.col("rule"))))


def _audit(s, d):
    known = s.createDataFrame([("csv",), ("PNG",)], "ext string")
    return classify.audit_openable(_headed(s, d), known)


def _sidecars(s, d):
    p = table(s, d, "part").select(F.expr("concat('d', p_partkey div 2 % 10, '/F', p_partkey div 2, if(p_partkey % 2 = 0, '.jpg', if(p_partkey % 3 = 0, '.txt', '.XMP')))").alias("path"))
    return classify.pair_sidecars(p, ["jpg"])


def _entropy(s, d):
    t = table(s, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    return textstats.entropy_profile(t).withColumns({c: F.round(c, 6) for c in ("mean", "min", "max")})


QUERIES = {
    "a12_summarise_http": _http, "a13_http_requests": _requests, "a14_summarise_archives": _archives, "s13_verify_crc": _crc, "a20_tally_json": _json_tally,
    "a21_ids_rules": _rules, "a21_ids_summary": lambda s, d: logs.ids_summary(_rules(s, d)), "a23_message_facts": _messages, "a22_split_mailbox": _mailboxes,
    "a24_calendar_events": _calendar, "a25_ldif_files": lambda s, d: _ldif(s, d)[0], "a25_ldif_entries": lambda s, d: _ldif(s, d)[1].select("path", "dn", "cn", "mail", F.array_join("classes", ",").alias("classes"), "change"),
    "a27_summarise_diff": _diff, "a28_bib_files": lambda s, d: _bib(s, d)[0].select("path", "entries", "first_year", "last_year", F.coalesce(F.try_element_at("types", F.lit("article")), F.lit(0)).alias("articles")), "a28_bib_duplicates": lambda s, d: _bib(s, d)[1],
    "a29_summarise_feed": _feed, "a30_sequence_stats": _fasta, "a31_summarise_workout": _workout, "a32_summarise_nmea": _nmea, "a33_summarise_igc": _igc,
    "a34_playlist_files": lambda s, d: _playlist(s, d)[0], "a34_playlist_variants": lambda s, d: _playlist(s, d)[1], "a36_feature_geometries": lambda s, d: _features(s, d)[0], "a36_feature_properties": lambda s, d: _features(s, d)[1],
    "a38_summarise_notebooks": _notebooks, "a39_summarise_tensors": _tensors, "a43_lockfile_inventory": _locks, "a44_crash_facts": _crashes, "a45_contacts": _cards, "a26_web_archive": _warc,
    "t6_ragged_rows": _ragged, "w17_midi_duration": _midi, "w16_scene_changes": _scenes, "w20_timed_lines": _timed, "w19_toolpath_summary": _toolpath,
    "s5_parse_relaxed_json": _relaxed, "s6_profile_jsonl": _jsonl, "p9_key_material": _keys, "p2_identify": lambda s, d: classify.identify(_headed(s, d)), "p3_signature_mismatch": _mismatch, "p4_resolve_variant": _variants,
    "p5_resolve_content": lambda s, d: classify.resolve_content(_headed(s, d)), "p7_audit_files": lambda s, d: _audit(s, d)[0], "p7_audit_representatives": lambda s, d: _audit(s, d)[1],
    "j2_sidecar_pairs": lambda s, d: _sidecars(s, d)[0], "j2_sidecar_rest": lambda s, d: _sidecars(s, d)[1].groupBy("path").agg(F.count("*").alias("n")), "a10_entropy_profile": _entropy,
}

_HEX = "[" + ", ".join(f"'{h}'" for h in _HEADS) + "]"
_EXT = "[" + ", ".join(f"'{e}'" for e in _EXTS) + "]"
_F = f"(select 'f' || p_partkey || case when e <> '' then '.' || e else '' end as path, e as ext, p_partkey % 6 as h, ({_HEX})[p_partkey % 6 + 1] as hex from (select *, ({_EXT})[p_partkey % 7 + 1] as e from part))"
_SNIFF = "case h when 0 then 'png' when 1 then 'jpg' when 2 then 'pdf' end"
_OK = "(ext in ('csv', 'png') or h <> 4)"
_AUDIT = f"(select path, case when ext = '' then path else ext end as format, {_OK} as ok, case when {_OK} then null when ext = '' then 'extensionless binary' else 'unrecognised binary' end as reason from {_F})"
_RULES = "(select cast(p_size as varchar) as path, p_partkey % 3 <> 0 as enabled, case when p_partkey % 2 = 0 then 'alert' else 'drop' end as action, case when p_partkey % 2 = 0 then 'tcp' else 'udp' end as protocol, p_partkey as sid, p_name as msg, case when p_partkey % 5 = 0 then 'trojan-activity' else 'misc' end as classtype from part)"
_SIDE = "(select *, 'd' || p_partkey // 2 % 10 || '/F' || p_partkey // 2 || case when p_partkey % 2 = 0 then '.jpg' when p_partkey % 3 = 0 then '.txt' else '.XMP' end as path from part)"
_Q = "cast(floor(l_quantity) as bigint)"
_ITEMS = "(select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as no from lineitem)"
_MOVES = f"""(select *, {_Q} as x, case when l_partkey % 3 = 0 then 0 else 1 end as mode, l_partkey % 2 = 0 as extrude,
  sqrt(power({_Q} - coalesce(lag({_Q}) over w, 0), 2) + 2 * power(no - coalesce(lag(no) over w, 0), 2)) as length from {_ITEMS} window w as (partition by l_orderkey order by no))"""

ORACLE = {
    "a12_summarise_http": """select cast(o_custkey as varchar) as path, count(*) as requests, cast(sum(greatest(o_orderkey % 1000 - 1, 0)) as bigint) as bytes, cast(sum(o_orderkey % 2000) as double) as time_ms, count(*) filter (where o_orderkey % 2000 > 1000) as slow, count(*) filter (where o_orderkey % 3 = 0) as sensitive,
      count(*) filter (where o_orderkey % 4 = 0) as s200, count(*) filter (where o_orderkey % 4 = 1) as s300, count(*) filter (where o_orderkey % 4 = 2) as s400, count(*) filter (where o_orderkey % 4 = 3) as s500, count(*) filter (where o_orderkey % 2 = 0) as json, count(*) filter (where o_orderkey % 2 = 1) as png from orders group by 1""",
    "a13_http_requests": "select case when o_orderkey % 2 = 0 then 'json' else 'img/png' end as short_type, (o_orderkey % 4 + 2) || 'xx' as status_class, count(*) as n from orders group by all",
    "a14_summarise_archives": """with e as (select l_orderkey as archive, cast(floor(l_quantity * 3) as bigint) as c, cast(floor(l_quantity * (l_linenumber + 4)) as bigint) as u, case when l_linenumber % 2 = 0 then 8 else 0 end as m, l_suppkey % 7 = 0 as dir, l_partkey as p from lineitem),
      s as (select archive, count(*) filter (where not dir) as files, count(*) filter (where dir) as dirs, cast(sum(c) as bigint) as comp, cast(sum(u) as bigint) as uncomp, count(*) filter (where p % 2 = 1) as encrypted, bool_or(p % 50 = 0) as zip64, 3 as host_system, max(case when c > 0 then u / c else 0.0 end) as w,
        count(*) filter (where not dir and m = 0) as m0, count(*) filter (where not dir and m = 8) as m8 from e group by 1)
      select archive, files, dirs, comp, uncomp, encrypted, zip64, host_system, round(w, 6) as worst_ratio, cast(case when uncomp > 0 then floor(100.0 * (1 - comp / uncomp) + 0.5) else 0 end as bigint) as saved_percent, round(case when comp > 0 then uncomp / comp else 0.0 end, 6) as overall_ratio, w > 1000 or (comp > 0 and uncomp / comp > 100) as suspicious, m0, m8 from s""",
    "s13_verify_crc": """with e as (select l_suppkey as archive, lpad(cast(l_orderkey as varchar), 9, '0') || '-' || l_linenumber as name, l_partkey % 5 as k from lineitem), f as (select *, row_number() over (partition by archive, k = 3 order by name) as r from e)
      select archive, count(*) filter (where k < 3) as passed, count(*) filter (where k = 3) as failed, count(*) filter (where k = 4) as skipped, coalesce(string_agg(name, ',' order by name) filter (where k = 3 and r <= 10), '') as mismatches from f group by 1""",
    "a20_tally_json": "select cast(o_custkey as varchar) as path, o_orderpriority as value, count(*) as n from orders group by all",
    "a21_ids_rules": f"select * from {_RULES}",
    "a21_ids_summary": " union all ".join(f"select path, '{k}' as key, cast({k} as varchar) as value, count(*) as n from {_RULES} group by all" for k in ("action", "protocol", "classtype", "enabled")),
    "a23_message_facts": "select conv_id, turn, role || '@example.com' as sender, 'turn ' || turn as subject, '2024-02-05 10:11:12' as date, 2 as hops, 'pass' as spf, 'fail' as dkim, cast(null as varchar) as dmarc, cast(length(cast(length(text) as varchar)) as int) as body_chars, 'a+b' as received from conversations where text is not null and role is not null",
    "a22_split_mailbox": "select cast(conv_id as varchar) as path, cast(row_number() over (partition by conv_id order by turn) - 1 as int) as msg_no, turn from conversations where role is not null",
    "a24_calendar_events": "select cast(o_custkey as varchar) as path, cast(o_orderkey as varchar) as uid, o_orderpriority as summary, strftime(o_orderdate, '%Y%m%d') as starts, cast(case when o_orderkey % 3 = 0 then 2 else 1 end as bigint) as attendees, o_orderkey % 2 = 0 as recurs from orders",
    "a25_ldif_files": "select cast(c_nationkey as varchar) as path, count(*) as entries, count(*) filter (where c_custkey % 4 = 0) as changes from customer group by 1",
    "a25_ldif_entries": "select cast(c_nationkey as varchar) as path, 'cn=' || c_custkey as dn, c_name as cn, c_custkey || '@example.com' as mail, 'person,top' as classes, c_custkey % 4 = 0 as change from customer",
    "a27_summarise_diff": "select cast(l_suppkey as varchar) as path, count(distinct case when l_partkey % 5 <> 0 then l_partkey % 11 end) as files, cast(sum(l_linenumber) as bigint) as added, count(*) as deleted from lineitem group by 1",
    "a28_bib_files": "select cast(o_custkey as varchar) as path, count(*) as entries, cast(min(year(o_orderdate)) as int) as first_year, cast(max(year(o_orderdate)) as int) as last_year, count(*) filter (where o_orderkey % 2 = 0) as articles from orders group by 1",
    "a28_bib_duplicates": "select cast(o_custkey as varchar) as path, 'k' || o_orderkey % 3 as key, count(*) as n from orders group by all having count(*) > 1",
    "a29_summarise_feed": "select cast(o_custkey as varchar) as path, count(*) as items, strftime(min(o_orderdate), '%Y-%m-%d') as first, strftime(max(o_orderdate), '%Y-%m-%d') as last, count(*) filter (where o_orderkey % 2 = 0) as enclosures, cast(coalesce(sum(o_orderkey) filter (where o_orderkey % 2 = 0), 0) as bigint) as enclosure_bytes from orders group by 1",
    "a30_sequence_stats": "select cast(p_size as varchar) as path, count(*) as records, cast(sum(2 * (p_partkey % 7) + 10) as bigint) as residues, round(sum(2 * (p_partkey % 7) + 10) / count(*), 6) as mean_length, round(100.0 * sum(2 * (p_partkey % 7) + 2) / sum(2 * (p_partkey % 7) + 8), 6) as gc_percent from part group by 1",
    "a31_summarise_workout": f"select cast(l_orderkey as varchar) as path, cast(count(*) as int) as laps, cast(count(*) as int) as points, cast(sum({_Q}) * 10 as double) as metres, cast(sum({_Q}) as double) as seconds, cast(sum(l_linenumber) as double) as calories, cast(min({_Q}) + 60 as double) as hr_min, cast(max({_Q}) + 60 as double) as hr_max, cast(min(l_linenumber) + 80 as double) as cadence_min, cast(max(l_linenumber) + 80 as double) as cadence_max from lineitem group by 1",
    "a32_summarise_nmea": """with i as (select *, case when l_partkey % 3 > 0 then (case when l_partkey % 2 = 0 then 1 else -1 end) * (10.5 + l_linenumber) end as lat, case when l_partkey % 3 > 0 then 20.25 end as lon from lineitem)
      select cast(l_orderkey as varchar) as path, count(*) as sentences, count(lat) as fixes, cast(min(l_linenumber) + 0.5 as double) as best_hdop, cast(max(l_linenumber) as int) as most_satellites, lpad(cast(min(l_linenumber) as varchar), 6, '0') as first_time, lpad(cast(max(l_linenumber) as varchar), 6, '0') as last_time,
      cast(min(lat) as double) as min_lat, cast(max(lat) as double) as max_lat, cast(min(lon) as double) as min_lon, cast(max(lon) as double) as max_lon, count(*) filter (where l_partkey % 4 <> 0) as checksum_ok, count(*) filter (where l_partkey % 4 = 0) as checksum_bad, count(*) as gga from i group by 1""",
    "a33_summarise_igc": f"""with i as (select *, {_Q} + case when l_partkey % 3 = 0 then 0 else 1 end as alt, (case when l_partkey % 2 = 0 then 1 else -1 end) * (10.5 + l_linenumber) as lat from lineitem)
      select cast(l_orderkey as varchar) as path, count(*) as fixes, lpad(cast(min(l_linenumber) as varchar), 6, '0') as first, lpad(cast(max(l_linenumber) as varchar), 6, '0') as last, cast(min(alt) as int) as alt_min, cast(max(alt) as int) as alt_max, cast(min(lat) as double) as min_lat, cast(max(lat) as double) as max_lat, cast(20.25 as double) as min_lon, cast(20.25 as double) as max_lon, 'Ann' as pilot, cast(null as varchar) as glider from i group by 1""",
    "a34_playlist_files": f"select cast(l_orderkey as varchar) as path, count(*) as segments, cast(sum({_Q} + 0.5) as double) as seconds, l_orderkey % 2 <> 0 or min(l_linenumber) > 1 as live from lineitem group by l_orderkey",
    "a34_playlist_variants": "select cast(l_orderkey as varchar) as path, l_partkey as bandwidth, '640x' || l_linenumber as resolution, 'v' || l_partkey || '.m3u8' as uri from lineitem",
    "a36_feature_geometries": f"""select cast(l_orderkey as varchar) as path, 'Point' as type, count(*) as n, count(*) as points, cast(min(l_linenumber) as double) as west, cast(min({_Q}) as double) as south, cast(max(l_linenumber) as double) as east, cast(max({_Q}) as double) as north, cast(null as double) as low, cast(null as double) as high from lineitem where l_partkey % 2 = 0 group by 1
      union all select cast(l_orderkey as varchar), 'MultiPoint', count(*), 2 * count(*), cast(-max(l_linenumber) as double), cast(0 as double), cast(max(l_linenumber) as double), cast(max({_Q}) as double), cast(7 as double), cast(9 as double) from lineitem where l_partkey % 2 = 1 group by 1""",
    "a36_feature_properties": "select cast(l_orderkey as varchar) as path, 'k' || l_linenumber % 3 as key, count(*) as features from lineitem group by all",
    "a38_summarise_notebooks": "select cast(l_orderkey as varchar) as path, count(*) as cells, count(*) filter (where l_partkey % 3 <> 0) as code, count(*) filter (where l_partkey % 3 = 0) as markdown, 2 * count(*) filter (where l_partkey % 3 <> 0) as code_lines, count(*) filter (where l_partkey % 2 = 0) as outputs from lineitem group by 1",
    "a39_summarise_tensors": f"select cast(l_orderkey as varchar) as path, count(*) as tensors, cast(sum(l_linenumber * {_Q}) as bigint) as parameters, string_agg(distinct case when l_partkey % 2 = 0 then 'F16' else 'F32' end, ',' order by case when l_partkey % 2 = 0 then 'F16' else 'F32' end) as dtypes from lineitem group by 1",
    "a43_lockfile_inventory": """select l_orderkey || '/Cargo.lock' as path, 'cargo' as ecosystem, cast(count(*) as int) as packages, '3' as lock_version, true as integrity from lineitem group by l_orderkey
      union all select l_orderkey || '/requirements.txt', 'pip', cast(count(*) filter (where l_partkey % 2 = 0) as int), null, false from lineitem group by l_orderkey""",
    "a44_crash_facts": "select o_orderkey as path, 'app' || o_custkey as process, '1.' || o_orderkey as version, 'EXC_BAD' as exception, cast(o_orderkey % 9 as varchar) as thread, case when o_orderkey % 2 = 0 then '' else '6F9619FF-8B86-D011-B42D-00C04FC964FF' end as uuids, cast(o_orderkey % 2 as int) as images from orders",
    "a45_contacts": "select cast(c_nationkey as varchar) as path, case when c_custkey % 2 = 0 then c_name else 'First Last' || c_custkey end as name, c_mktsegment || ', Unit' as organisation, c_custkey || '@example.com,b@example.com' as emails, '1' as phones, '1 Road, Town' as addresses from customer",
    "a26_web_archive": "select cast(o_custkey as varchar) as path, count(*) as records, count(distinct o_orderkey) as urls, count(distinct o_orderkey % 5) as hosts, strftime(min(o_orderdate), '%Y-%m-%d') as first, strftime(max(o_orderdate), '%Y-%m-%d') as last, count(*) filter (where o_orderkey % 2 = 0) as request, count(*) filter (where o_orderkey % 2 = 1) as response from orders group by 1",
    "a10_entropy_profile": """with d as (select doc_id, hex(encode(text)) as h, octet_length(encode(text)) as n from documents),
      s as (select doc_id, h, cast(ceil(n / cast(least(512, greatest(64, n // 256)) as double)) as bigint) as size from d where n >= 256),
      b as (select doc_id, size, unnest(regexp_extract_all(h, '..')) as byte, generate_subscripts(regexp_extract_all(h, '..'), 1) - 1 as i from s),
      c as (select doc_id, i // size as chunk, byte, count(*) as n from b group by all),
      p as (select doc_id, chunk, n, sum(n) over (partition by doc_id, chunk) as total from c),
      e as (select doc_id, chunk, -sum(n / cast(total as double) * log2(n / cast(total as double))) as bits from p group by all),
      m as (select doc_id as path, cast(count(*) as int) as chunks, avg(bits) as mean, min(bits) as min, max(bits) as max from e group by 1)
      select path, chunks, round(mean, 6) as mean, round(min, 6) as min, round(max, 6) as max,
        case when max > 7.5 and max - min > 1.5 then 'embedded high-entropy region' when mean > 7.5 then 'uniformly high' when mean < 4.5 then 'low' else 'mixed' end as verdict from m""",
    "t6_ragged_rows": r"""with l as (select doc_id, list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: len(string_split(x, ','))) as n from documents where text is not null), r as (select doc_id as path, cast(n[1] as int) as header_cells, cast(len(n) - 1 as bigint) as data_rows, cast(len(list_filter(n[2:], lambda x: x <> n[1])) as bigint) as ragged from l)
      select *, cast(case when data_rows = 0 then 100 else floor(100.0 * (data_rows - ragged) / data_rows + 0.5) end as bigint) as confidence from r""",
    "w17_midi_duration": f"""with t as (select l_orderkey as file, no * 480 as tick, cast(trunc(l_quantity * 10000) as bigint) as us from {_ITEMS} union all select distinct l_orderkey, 0, 500000 from lineitem), n as (select *, greatest(coalesce(lead(tick) over (partition by file order by tick), 4800) - tick, 0) as n from t)
      select file, round(sum(n / 480.0 * us / 1e6), 6) as seconds, cast(120 as double) as first_bpm from n group by 1""",
    "w16_scene_changes": f"""with f as (select l_orderkey as clip_id, cast(no as double) as t, l_partkey % 256 as r, l_suppkey % 256 as g, cast(l_quantity as int) * 5 as b from {_ITEMS}), d as (select clip_id, t, (abs(r - lag(r) over w) + abs(g - lag(g) over w) + abs(b - lag(b) over w)) / 3.0 as diff from f window w as (partition by clip_id order by t))
      select clip_id, t, round(diff, 6) as diff, cast(least(99, floor(50 * diff / 55.0 + 0.5)) as int) as confidence from d where diff > 55""",
    "w20_timed_lines": f"""with i as (select cast(l_orderkey as varchar) as path, l_linenumber as line_no, 'words ' || l_partkey as text, case when l_partkey % 3 <> 0 then l_linenumber * 60 + {_Q} + 0.5 end as a, case when l_partkey % 5 = 0 then 540.0 end as b from lineitem)
      select path, line_no, cast(a as double) as seconds, text from i where a is not null union all select path, line_no, cast(b as double), text from i where b is not null union all select path, line_no, null, text from i where a is null and b is null""",
    "w19_toolpath_summary": f"""select cast(l_orderkey as varchar) as path, count(*) filter (where mode = 0) as rapid, count(*) filter (where mode = 1) as feed, 0 as arc, count(*) filter (where extrude) as extrude, round(coalesce(sum(length) filter (where extrude), 0), 4) as extruded_mm, round(coalesce(sum(length) filter (where mode = 1 and not extrude), 0), 4) as cut_mm,
      cast(100 * min(no) as double) as feed_min, cast(100 * max(no) as double) as feed_max, cast(min(x) as double) as min_x, cast(max(x) as double) as max_x, cast(min(no) as double) as min_y, cast(max(no) as double) as max_y, cast(min(no) as double) as min_z, cast(max(no) as double) as max_z from {_MOVES} group by 1""",
    "s5_parse_relaxed_json": "select p_partkey, p_name || ' // kept' as name, p_size as size, 2 as second from part",
    "s6_profile_jsonl": "select count(*) filter (where o_orderkey % 5 <> 0) as records, count(*) filter (where o_orderkey % 5 > 1) as valid, (select string_agg(k, ',' order by k) from (select unnest(['a', 'b', 'c']) as k union select o_orderstatus from orders where o_orderkey % 5 = 4)) as keys from orders",
    "p9_key_material": "select p_partkey, (['pem', 'putty', 'pgp', 'wireguard', '', 'jwk', 'pem,openssh'])[p_partkey % 7 + 1] as key_material from part",
    "p2_identify": f"select path, case h when 0 then 'image' when 1 then 'image' when 2 then 'document' end as kind, {_SNIFF} as sniffed_ext, case h when 0 then 'PNG image' when 1 then 'JPEG image' when 2 then 'PDF document' end as label from {_F}",
    "p3_signature_mismatch": f"select path, ext, {_SNIFF} as sniffed_ext, case when h > 2 then 'missing signature' else 'wrong signature' end as reason, hex[1:32] as first_bytes from {_F} where ext in ('png', 'jpg') and ({_SNIFF} is null or {_SNIFF} <> ext)",
    "p4_resolve_variant": f"select path, case ext when 'png' then case h when 0 then 'portable' when 1 then 'camera' else 'other picture' end when 'txt' then case h when 5 then 'greeting' when 2 then 'document' end end as variant from {_F}",
    "p5_resolve_content": f"select path, (['image', 'image', 'document', 'delimited', 'binary', 'text'])[h + 1] as kind from {_F}",
    "p7_audit_files": f"select * from {_AUDIT}",
    "p7_audit_representatives": f"select format, min(path) as path, arg_min(reason, path) as reason, count(*) as files from {_AUDIT} where not ok group by 1",
    "j2_sidecar_pairs": f"select a.path, b.path as sidecar from {_SIDE} a join {_SIDE} b on a.p_partkey // 2 = b.p_partkey // 2 and a.p_partkey % 2 = 0 and b.p_partkey % 2 = 1 and b.p_partkey % 3 <> 0",
    "j2_sidecar_rest": f"select path, count(*) as n from {_SIDE} s where not (p_partkey % 2 = 1 and p_partkey % 3 <> 0 and exists (select 1 from part o where o.p_partkey = s.p_partkey - 1)) group by 1",
}

"""Summaries of line-based and structured logs.

Most share one pattern: lines (path, line_no, line) from sources.readers, a running block number per file (a window in
line order), and one aggregation per result. A file is the unit that a window orders; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions.scalars import igc_degrees, nmea_degrees, xor_checksum

def _in_order():
    return W.partitionBy("path").orderBy("line_no")


def _first(pattern: str, c: str | Column = "line", group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.nullif(F.regexp_extract(c if isinstance(c, Column) else F.col(c), pattern, group), F.lit(""))


def numbered_blocks(lines: DataFrame, start: str) -> DataFrame:
    """lines plus block: the number of lines so far that begin a block (0 before the first)."""
    return lines.withColumn("block", F.sum(F.col("line").rlike(start).cast("int")).over(_in_order().rowsBetween(W.unboundedPreceding, 0)))


def tally(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by..., key, n) of the filled values."""
    return df.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.count("*").alias("n"))


def as_map(counts: DataFrame, by: list[str], key: str, name: str) -> DataFrame:
    """Counts of each group as one map."""
    return counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name))


# ---- HTTP ------------------------------------------------------------------------------------------------------

HAR = "log struct<entries: array<struct<startedDateTime: string, time: double, request: struct<method: string, url: string, headers: array<struct<name: string, value: string>>>, response: struct<status: int, content: struct<size: bigint, mimeType: string>, headers: array<struct<name: string, value: string>>>>>>"


def http_entries(docs: DataFrame, text: str = "text") -> DataFrame:
    """(path, started, method, url, status, mime, size, time_ms, headers) of session archives (path, text)."""
    e = docs.select("path", F.explode(F.from_json(text, HAR)["log"]["entries"]).alias("e"))
    headers = F.concat(F.coalesce("e.request.headers", F.array()), F.coalesce("e.response.headers", F.array()))
    return e.select("path", F.try_to_timestamp("e.startedDateTime").alias("started"), "e.request.method", "e.request.url", "e.response.status", F.trim(F.split("e.response.content.mimeType", ";")[0]).alias("mime"), F.col("e.response.content.size").alias("size"), F.col("e.time").alias("time_ms"), headers.alias("headers"))


def summarise_http(entries: DataFrame, slow_ms: float = 1000, top: int = 8) -> DataFrame:
    """(path, requests, bytes, time_ms, slow, sensitive, statuses, types) per session."""
    secret = F.exists("headers", lambda h: F.lower(h["name"]).isin("authorization", "cookie", "set-cookie"))
    s = entries.groupBy("path").agg(F.count("*").alias("requests"), F.sum(F.greatest("size", F.lit(0))).alias("bytes"), F.sum("time_ms").alias("time_ms"), F.count_if(F.col("time_ms") > slow_ms).alias("slow"), F.count_if(secret).alias("sensitive"))
    types = tally(entries, ["path"], "mime").withColumn("_r", F.row_number().over(W.partitionBy("path").orderBy(F.desc("n"), "mime"))).where(F.col("_r") <= top)
    return s.join(as_map(tally(entries, ["path"], "status"), ["path"], "status", "statuses"), "path", "left").join(as_map(types, ["path"], "mime", "types"), "path", "left")


def http_requests(entries: DataFrame) -> DataFrame:
    """entries plus short_type and status_class."""
    short = F.regexp_replace(F.regexp_replace(F.col("mime"), "^(application|text)/", ""), "^image/", "img/")
    s = F.col("status")
    return entries.withColumns({"short_type": short, "status_class": F.when(s >= 500, "5xx").when(s >= 400, "4xx").when(s >= 300, "3xx").when(s >= 200, "2xx").otherwise("other")})


# ---- JSON reports ------------------------------------------------------------------------------------------------


def tally_json(docs: DataFrame, schema: str, rows: str, key: str, text: str = "text") -> DataFrame:
    """(path, value, n): how often each value of `key` occurs among the objects at `rows` of JSON documents."""
    e = docs.select("path", F.from_json(text, schema).alias("j")).select("path", F.explode(F.expr(f"j.{rows}")).alias("r"))
    return e.select("path", F.expr(f"r.{key}").cast("string").alias("value")).where("value is not null").groupBy("path", "value").agg(F.count("*").alias("n"))


def summarise_notebooks(docs: DataFrame, text: str = "text") -> DataFrame:
    """(path, cells, code, markdown, code_lines, outputs)."""
    schema = "cells array<struct<cell_type: string, source: array<string>, outputs: array<string>>>"
    c = docs.select("path", F.explode(F.from_json(text, schema)["cells"]).alias("c")).select("path", "c.*")
    code = F.col("cell_type") == "code"
    return c.groupBy("path").agg(F.count("*").alias("cells"), F.count_if(code).alias("code"), F.count_if(F.col("cell_type") == "markdown").alias("markdown"), F.sum(F.when(code, F.size("source")).otherwise(0)).alias("code_lines"), F.sum(F.greatest(F.size(F.coalesce("outputs", F.array())), F.lit(0))).alias("outputs"))


def summarise_tensors(headers: DataFrame, text: str = "text") -> DataFrame:
    """(path, tensors, parameters, dtypes) of JSON headers that map a tensor's name to dtype and shape."""
    t = headers.select("path", F.explode(F.from_json(text, "map<string, struct<dtype: string, shape: array<bigint>>>")).alias("name", "t")).where("name <> '__metadata__' and t.dtype is not null")
    return t.groupBy("path").agg(F.count("*").alias("tensors"), F.sum(F.aggregate("t.shape", F.lit(1).cast("long"), lambda a, x: a * x)).alias("parameters"), F.array_sort(F.collect_set("t.dtype")).alias("dtypes"))


def crash_facts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(path, process, version, exception, thread, uuids, images) of crash reports in JSON or text form."""
    j = F.try_parse_json(text)
    v = lambda p: F.try_variant_get(j, p, "string")
    field = lambda name: F.trim(_first(rf"(?m)^{name}:\s*([^\r\n]+)", text))
    uuid = r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"
    return docs.select(
        "path", F.coalesce(v("$.procName"), v("$.app_name"), _first(r"^(\S+)", field("Process"))).alias("process"), F.coalesce(v("$.bundleInfo.CFBundleShortVersionString"), v("$.app_version"), field("Version")).alias("version"),
        F.coalesce(v("$.exception.type"), field("Exception Type")).alias("exception"), F.coalesce(v("$.faultingThread"), _first(r"(?m)^(?:Crashed Thread|Triggered by Thread):\s*(\d+)", text)).alias("thread"),
        F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(uuid), F.lit(0)), F.upper)).alias("uuids"), F.regexp_count(text, F.lit(r"(?m)^\s*0x[0-9a-f]+\s+-\s+0x[0-9a-f]+")).alias("images"),
    )


# ---- rules, patches, references, feeds -----------------------------------------------------------------------------


def ids_rules(lines: DataFrame) -> DataFrame:
    """(path, enabled, action, protocol, sid, msg, classtype) of intrusion rules; commented ones are disabled; only lines with a sid count."""
    body = F.regexp_replace("line", r"^\s*#\s*", "")
    r = lines.select("path", (~F.col("line").rlike(r"^\s*#")).alias("enabled"), body.alias("b"))
    return r.select("path", "enabled", _first(r"^(\w+)\s+", "b").alias("action"), _first(r"^\w+\s+(\w+)\s+", "b").alias("protocol"), _first(r"\bsid\s*:\s*(\d+)", "b").cast("long").alias("sid"), _first(r'msg\s*:\s*"([^"]*)"', "b").alias("msg"), _first(r"classtype\s*:\s*([\w-]+)", "b").alias("classtype")).where("sid is not null")


def ids_summary(rules: DataFrame) -> DataFrame:
    """(path, key, value, n) by action, protocol, class type and enabled, in one aggregation."""
    g = rules.groupingSets([["path", "action"], ["path", "protocol"], ["path", "classtype"], ["path", "enabled"]], "path", "action", "protocol", "classtype", "enabled").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    key = F.when(F.col("g") == 7, "action").when(F.col("g") == 11, "protocol").when(F.col("g") == 13, "classtype").otherwise("enabled")
    return g.select("path", key.alias("key"), F.coalesce("action", "protocol", "classtype", F.col("enabled").cast("string")).alias("value"), "n")


def summarise_diff(lines: DataFrame) -> DataFrame:
    """(path, files, added, deleted) of patches."""
    name = F.when(F.col("line").rlike(r"^\+\+\+ "), _first(r"^\+\+\+ (?:[ab]/)?([^\t]+)"))
    return lines.groupBy("path").agg(F.count_distinct(F.when(name != "/dev/null", name)).alias("files"), F.count_if(F.col("line").rlike(r"^\+(?!\+\+ )")).alias("added"), F.count_if(F.col("line").rlike(r"^-(?!-- )")).alias("deleted"))


def summarise_bib(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per file: entries, first and last year; duplicate keys with their count)."""
    b = numbered_blocks(lines, r"^\s*@\w+\s*\{").where("block > 0")
    e = b.groupBy("path", "block").agg(F.lower(F.first(_first(r"^\s*@(\w+)\s*\{"), ignorenulls=True)).alias("type"), F.first(_first(r"^\s*@\w+\s*\{\s*([^,\s}]+)"), ignorenulls=True).alias("key"), F.first(_first(r"(?i)\byear\s*=\s*[{\"]?(\d{4})"), ignorenulls=True).cast("int").alias("year")).where(~F.col("type").isin("comment", "string", "preamble"))
    s = e.groupBy("path").agg(F.count("*").alias("entries"), F.min("year").alias("first_year"), F.max("year").alias("last_year")).join(as_map(tally(e, ["path"], "type"), ["path"], "type", "types"), "path", "left")
    return s, e.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1")


def summarise_feed(docs: DataFrame, text: str = "text") -> DataFrame:
    """(path, items, first, last, enclosures, enclosure_bytes) of RSS or Atom documents."""
    item = F.regexp_extract_all(text, F.lit(r"(?s)<(?:item|entry)\b.*?</(?:item|entry)>"), F.lit(0))
    e = docs.select("path", F.explode_outer(item).alias("x"))
    when = F.coalesce(F.try_to_timestamp(_first(r"<(?:updated|published|dc:date)>\s*([^<]+?)\s*<", "x")), F.try_to_timestamp(F.regexp_replace(_first(r"<pubDate>\s*(?:\w+,\s*)?([^<]+?)\s*<", "x"), r"\s*(GMT|UT)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z")))
    size = _first(r"<enclosure\b[^>]*\blength=[\"'](\d+)", "x").try_cast("long")
    return e.groupBy("path").agg(F.count("x").alias("items"), F.min(when).alias("first"), F.max(when).alias("last"), F.count_if(F.col("x").rlike(r"<enclosure\b|rel=[\"']enclosure")).alias("enclosures"), F.coalesce(F.sum(size), F.lit(0)).alias("enclosure_bytes"))


def summarise_warc(lines: DataFrame) -> DataFrame:
    """(path, records, types, urls, hosts, first, last) of web-archive header lines."""
    x = lines.select("path", _first(r"(?i)^WARC-Type:\s*(\S+)").alias("type"), _first(r"(?i)^WARC-Target-URI:\s*<?([^\s>]+)").alias("url"), F.try_to_timestamp(_first(r"(?i)^WARC-Date:\s*(\S+)")).alias("date"))
    s = x.groupBy("path").agg(F.count("type").alias("records"), F.count_distinct("url").alias("urls"), F.count_distinct(F.try_parse_url("url", F.lit("HOST"))).alias("hosts"), F.min("date").alias("first"), F.max("date").alias("last"))
    return s.join(as_map(tally(x, ["path"], "type"), ["path"], "type", "types"), "path", "left")


def lockfile_inventory(files: DataFrame, text: str = "text") -> DataFrame:
    """(path, ecosystem, packages, lock_version, integrity) of dependency lock files, by name and then content."""
    base, t = F.lower(F.element_at(F.split("path", "/"), -1)), F.col(text)
    eco = F.when(base == "package-lock.json", "npm").when(base == "yarn.lock", "yarn").when(base == "pnpm-lock.yaml", "pnpm").when(base == "cargo.lock", "cargo").when(base == "poetry.lock", "poetry").when(base == "gemfile.lock", "bundler").when(base == "composer.lock", "composer").when(base == "go.sum", "go").when(base == "requirements.txt", "pip").when(t.rlike('"lockfileVersion"'), "npm").when(t.rlike(r"(?m)^\[\[package\]\]"), "cargo").otherwise("unknown")
    count = {"npm": r'(?m)^\s*"node_modules/[^"]+":', "yarn": r"(?m)^\"?[^\s#][^\n]*:$", "pnpm": r"(?m)^  ['\"]?/?[@\w][^:\n]*@?[^:\n]*:$", "cargo": r"(?m)^\[\[package\]\]", "poetry": r"(?m)^\[\[package\]\]", "bundler": r"(?m)^    [\w-]+ \(", "composer": r'"reference"\s*:', "go": r"(?m)^\S+ v\S+ h1:", "pip": r"(?m)^[A-Za-z0-9_.-]+\s*=="}
    n = None
    for k, p in count.items():
        n = F.when(F.col("ecosystem") == k, F.regexp_count(text, F.lit(p))) if n is None else n.when(F.col("ecosystem") == k, F.regexp_count(text, F.lit(p)))
    v = F.coalesce(_first(r'"lockfileVersion"\s*:\s*(\d+)', text), _first(r"(?m)^lockfileVersion:\s*'?([\d.]+)", text), _first(r"(?m)^version = (\d+)$", text))
    return files.withColumn("ecosystem", eco).select("path", "ecosystem", n.otherwise(0).alias("packages"), v.alias("lock_version"), t.rlike(r"integrity|checksum = |sha256:|h1:").alias("integrity"))


# ---- mail, calendars, directories, contacts ---------------------------------------------------------------------


def split_mailbox(docs: DataFrame, text: str = "text") -> DataFrame:
    """(path, msg_no, raw) of mailbox files: a message begins with a line 'From '."""
    return docs.select("path", F.posexplode(F.filter(F.split(text, r"\r?\n(?=From )"), lambda x: F.trim(x) != "")).alias("msg_no", "raw"))


def message_facts(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """messages plus headers (lower-case name to values), sender, date, subject, hops, spf, dkim, dmarc, body_chars. Encoded words are decoded."""

    @F.pandas_udf("string")
    def decoded(c):
        from email.header import decode_header, make_header

        def one(x):
            try:
                return None if x is None else str(make_header(decode_header(x)))
            except (LookupError, ValueError):
                return x

        return c.map(one)

    text = F.regexp_replace(raw, r"\r\n", "\n")
    head = F.regexp_replace(F.regexp_extract(text, r"^(?:From [^\n]*\n)?([\s\S]*?)(?:\n\n|$)", 1), r"\n[ \t]+", " ")
    pairs = F.filter(F.transform(F.split(head, "\n"), lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, r"^([^:\s]+):", 1))).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)).alias("v"))), lambda p: p["k"] != "")
    m = messages.withColumn("_h", pairs)
    value = lambda k: F.get(F.transform(F.filter("_h", lambda p: p["k"] == k), lambda p: p["v"]), F.lit(0))
    names = F.array_distinct(F.transform("_h", lambda p: p["k"]))
    headers = F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter("_h", lambda p: p["k"] == n), lambda p: p["v"])))
    auth = F.lower(F.concat_ws(" ", value("authentication-results"), value("received-spf")))
    sender = F.coalesce(_first(r"<([^<>@\s]+@[^<>\s]+)>", value("from")), _first(r"([^<>\s,;]+@[^<>\s,;]+)", value("from")), F.nullif(value("from"), F.lit("")), F.lit("(unknown)"))
    date = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(value("date"), r"^\w+,\s*|\s*\([^)]*\)$", ""), r"\s*(GMT|UT)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    return m.withColumns({
        "headers": headers, "sender": sender, "date": date, "subject": decoded(value("subject")), "hops": F.size(F.filter("_h", lambda p: p["k"] == "received")),
        **{k: _first(rf"\b{k}\s*=\s*(\w+)", auth) for k in ("spf", "dkim", "dmarc")}, "body_chars": F.length(F.regexp_extract(text, r"\n\n([\s\S]*)$", 1)),
    }).drop("_h")


def summarise_mailbox(messages: DataFrame, box: str = "path", sender: str = "sender", date: str = "date", top: int = 10) -> DataFrame:
    """(box, messages, first, last, senders, top_senders): ties by sender ascending."""
    s = messages.groupBy(box).agg(F.count("*").alias("messages"), F.min(date).alias("first"), F.max(date).alias("last"), F.count_distinct(sender).alias("senders"))
    t = messages.groupBy(box, sender).agg(F.count("*").alias("n")).withColumn("_r", F.row_number().over(W.partitionBy(box).orderBy(F.desc("n"), sender))).where(F.col("_r") <= top)
    return s.join(t.groupBy(box).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", sender))), lambda x: x[sender]).alias("top_senders")), box, "left")


def summarise_calendar(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components: path, type, n; events: path, uid, summary, starts, attendees, recurs) of unfolded calendar lines."""
    b = numbered_blocks(lines, r"^BEGIN:")
    comps = b.select("path", _first(r"^BEGIN:(\w+)").alias("type")).where("type is not null").groupBy("path", "type").agg(F.count("*").alias("n"))
    prop = lambda p: F.first(_first(rf"^{p}(?:;[^:]*)?:(.*)$"), ignorenulls=True)
    ev = b.groupBy("path", "block").agg(F.first(_first(r"^BEGIN:(\w+)"), ignorenulls=True).alias("t"), prop("UID").alias("uid"), prop("SUMMARY").alias("summary"), prop("DTSTART").alias("starts"), F.count_if(F.col("line").rlike("^ATTENDEE[;:]")).alias("attendees"), (F.count_if(F.col("line").rlike("^RRULE[;:]")) > 0).alias("recurs"))
    return comps, ev.where("t = 'VEVENT'").drop("t", "block")


def summarise_ldif(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per file: entries, changes; entries: path, dn, cn, mail, classes) of unfolded directory exports."""
    b = numbered_blocks(lines, r"(?i)^dn::?\s").where("block > 0")
    prop = lambda p: F.min_by(_first(rf"(?i)^{p}::?\s*(.*)$"), F.when(F.col("line").rlike(rf"(?i)^{p}::?\s"), F.col("line_no")))
    e = b.groupBy("path", "block").agg(prop("dn").alias("dn"), prop("cn").alias("cn"), prop("mail").alias("mail"), F.array_sort(F.collect_set(F.lower(_first(r"(?i)^objectClass:\s*(\S+)")))).alias("classes"), (F.count_if(F.col("line").rlike("(?i)^changetype:")) > 0).alias("change")).drop("block")
    return e.groupBy("path").agg(F.count("*").alias("entries"), F.count_if("change").alias("changes")), e


def contacts(lines: DataFrame) -> DataFrame:
    """(path, card, name, organisation, emails, phones, addresses) of unfolded contact cards; the name falls back to the reversed structured one."""
    b = numbered_blocks(lines, r"(?i)^BEGIN:VCARD").where("block > 0")
    p = b.withColumns({"k": F.upper(_first(r"^(?:[\w-]+\.)?([A-Za-z-]+)[;:]")), "v": F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))})
    one = lambda k: F.min_by(F.when(F.col("k") == k, F.col("v")), F.when(F.col("k") == k, F.col("line_no")))
    many = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("k") == k, F.struct("line_no", "v")))), lambda x: x["v"])
    c = p.groupBy("path", F.col("block").alias("card")).agg(one("FN").alias("fn"), one("N").alias("n"), one("ORG").alias("org"), many("EMAIL").alias("emails"), many("TEL").alias("phones"), F.transform(many("ADR"), lambda a: F.array_join(F.filter(F.split(a, ";"), lambda x: F.trim(x) != ""), ", ")).alias("addresses"))
    part = F.split("n", ";")
    n = F.concat_ws(" ", F.nullif(F.get(part, F.lit(1)), F.lit("")), F.nullif(F.get(part, F.lit(0)), F.lit("")))
    return c.select("path", "card", F.coalesce(F.nullif("fn", F.lit("")), F.nullif(n, F.lit(""))).alias("name"), F.regexp_replace("org", ";+", ", ").alias("organisation"), "emails", "phones", "addresses")


# ---- sequences, workouts, positions, playlists ---------------------------------------------------------------------


def sequence_stats(lines: DataFrame, kind: str = "fasta") -> DataFrame:
    """FASTA: records, residues, mean_length, gc_percent over A, C, G, T, U. FASTQ: reads, bases, length range, gc_percent (N counts), quality range, encoding."""
    n = lambda c, letters: F.length(F.regexp_replace(c, f"[^{letters}]", ""))
    if kind == "fasta":
        seq = F.when(~F.col("line").rlike("^[>;]"), F.regexp_replace("line", r"\s", "")).otherwise("")
        s = lines.groupBy("path").agg(F.count_if(F.col("line").startswith(">")).alias("records"), F.sum(F.length(seq)).alias("residues"), F.sum(n(seq, "GCgc")).alias("gc"), F.sum(n(seq, "ACGTUacgtu")).alias("known"))
        return s.select("path", "records", "residues", (F.col("residues") / F.nullif("records", F.lit(0))).alias("mean_length"), (100.0 * F.col("gc") / F.nullif("known", F.lit(0))).alias("gc_percent"))
    k = F.col("line_no") % 4
    q = F.transform(F.filter(F.split("line", ""), lambda x: x != ""), lambda x: F.ascii(x))
    s = lines.where(F.col("line") != "").groupBy("path").agg(
        F.count_if(k == 1).alias("reads"), F.sum(F.when(k == 1, F.length("line"))).alias("bases"), F.min(F.when(k == 1, F.length("line"))).alias("shortest"), F.max(F.when(k == 1, F.length("line"))).alias("longest"),
        F.sum(F.when(k == 1, n(F.col("line"), "GCgc"))).alias("gc"), F.min(F.when(k == 3, F.array_min(q))).alias("quality_low"), F.max(F.when(k == 3, F.array_max(q))).alias("quality_high"),
    )
    return s.withColumns({"gc_percent": 100.0 * F.col("gc") / F.nullif("bases", F.lit(0)), "encoding": F.when(F.col("quality_low") < 59, "phred+33").when(F.col("quality_low") >= 64, "phred+64").otherwise("ambiguous")}).drop("gc")


def summarise_workout(docs: DataFrame, text: str = "text") -> DataFrame:
    """(path, laps, points, metres, seconds, calories, hr and cadence ranges) of training files."""
    all_of = lambda p, t: F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(1)), lambda x: x.try_cast("double"))
    total = lambda a: F.aggregate(F.filter(a, lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x)
    t = F.col(text)
    laps = F.regexp_replace(t, r"(?s)<Track>.*?</Track>", "")
    hr, cad = all_of(r"<HeartRateBpm[^>]*>\s*<Value>\s*([\d.]+)", t), all_of(r"<(?:\w+:)?(?:Run)?Cadence>\s*([\d.]+)", t)
    return docs.select("path", F.regexp_count(t, F.lit(r"<Lap\b")).alias("laps"), F.regexp_count(t, F.lit(r"<Trackpoint\b")).alias("points"), total(all_of(r"<DistanceMeters>\s*([\d.]+)", laps)).alias("metres"), total(all_of(r"<TotalTimeSeconds>\s*([\d.]+)", laps)).alias("seconds"), total(all_of(r"<Calories>\s*([\d.]+)", laps)).alias("calories"), F.array_min(hr).alias("hr_min"), F.array_max(hr).alias("hr_max"), F.array_min(cad).alias("cadence_min"), F.array_max(cad).alias("cadence_max"))


def summarise_nmea(lines: DataFrame) -> DataFrame:
    """(path, sentences, types, fixes, best_hdop, most_satellites, first_time, last_time, bounds, checksum_ok, checksum_bad) of position logs."""
    body, given = _first(r"^\$([^*\r\n]*)"), F.upper(_first(r"\*([0-9A-Fa-f]{2})"))
    f = F.split("body", ",")
    at = lambda i: F.nullif(F.get(f, F.lit(i)), F.lit(""))
    s = lines.select("path", body.alias("body"), given.alias("given")).where("body is not null").withColumn("type", F.right(F.get(f, F.lit(0)), F.lit(3)))
    gga, rmc = F.col("type") == "GGA", F.col("type") == "RMC"
    fix = (gga & (at(6).try_cast("int") > 0)) | (rmc & (at(2) == "A"))
    lat = F.when(fix & gga, nmea_degrees(at(2), at(3))).when(fix & rmc, nmea_degrees(at(3), at(4)))
    lon = F.when(fix & gga, nmea_degrees(at(4), at(5))).when(fix & rmc, nmea_degrees(at(5), at(6)))
    ok = F.lpad(F.hex(xor_checksum("body")), 2, "0") == F.col("given")
    x = s.withColumns({"lat": lat, "lon": lon, "time": F.when(gga | rmc, at(1)), "_ok": ok, "_fix": F.coalesce(fix & gga, F.lit(False)), "_hdop": F.when(gga, at(8).try_cast("double")), "_sat": F.when(gga, at(7).try_cast("int"))})
    r = x.groupBy("path").agg(F.count("*").alias("sentences"), F.count_if("_fix").alias("fixes"), F.min("_hdop").alias("best_hdop"), F.max("_sat").alias("most_satellites"), F.min("time").alias("first_time"), F.max("time").alias("last_time"), *(g(c).alias(f"{k}_{c}") for c in ("lat", "lon") for k, g in (("min", F.min), ("max", F.max))), F.count_if("_ok").alias("checksum_ok"), F.count_if(~F.col("_ok")).alias("checksum_bad"))
    return r.join(as_map(tally(x, ["path"], "type"), ["path"], "type", "types"), "path", "left")


def summarise_igc(lines: DataFrame) -> DataFrame:
    """(path, fixes, first, last, altitude range, bounds, pilot, glider) of flight logs; GPS altitude unless it is 0, then pressure."""
    b = r"^B(\d{6})(\d{7}[NS])(\d{8}[EW])[AV](-?\d{4,5})(-?\d{4,5})"
    g = lambda i: _first(b, group=i)
    alt = F.when(g(5).try_cast("int") != 0, g(5).try_cast("int")).otherwise(g(4).try_cast("int"))
    x = lines.select("path", "line_no", g(1).alias("t"), igc_degrees(g(2)).alias("lat"), igc_degrees(g(3)).alias("lon"), alt.alias("alt"), F.trim(_first(r"(?i)^H.PLT[^:]*:(.*)$")).alias("pilot"), F.trim(_first(r"(?i)^H.GTY[^:]*:(.*)$")).alias("glider"))
    return x.groupBy("path").agg(F.count("t").alias("fixes"), F.min("t").alias("first"), F.max("t").alias("last"), F.min("alt").alias("alt_min"), F.max("alt").alias("alt_max"), *(h(c).alias(f"{k}_{c}") for c in ("lat", "lon") for k, h in (("min", F.min), ("max", F.max))), F.first("pilot", ignorenulls=True).alias("pilot"), F.first("glider", ignorenulls=True).alias("glider"))


def summarise_playlist(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per file: segments, seconds, live; variants: path, bandwidth, resolution, uri) of streaming playlists."""
    x = lines.where(F.trim("line") != "").where(~F.col("line").startswith("#") | F.col("line").startswith("#EXT"))
    v = x.withColumn("uri", F.lead("line").over(_in_order())).where(F.col("line").startswith("#EXT-X-STREAM-INF"))
    s = lines.groupBy("path").agg(F.count_if(F.col("line").startswith("#EXTINF")).alias("segments"), F.coalesce(F.sum(_first(r"^#EXTINF:\s*([\d.]+)").try_cast("double")), F.lit(0.0)).alias("seconds"), (F.count_if(F.col("line").startswith("#EXT-X-ENDLIST")) == 0).alias("live"))
    return s, v.select("path", _first(r"[:,]BANDWIDTH=(\d+)").cast("long").alias("bandwidth"), _first(r"RESOLUTION=(\d+x\d+)").alias("resolution"), F.trim("uri").alias("uri"))


# ---- map features, revisions, blocks ---------------------------------------------------------------------------------


def summarise_features(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(geometries: path, type, n, points, bounds, elevation; properties: path, key, features) of map feature collections."""
    schema = "features array<struct<geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>"
    f = docs.select("path", F.explode(F.from_json(text, schema)["features"]).alias("f")).select("path", "f.geometry.type", "f.geometry.coordinates", "f.properties")
    pts = F.regexp_extract_all("coordinates", F.lit(r"\[\s*(-?[\d.eE+-]+\s*,\s*-?[\d.eE+-]+(?:\s*,\s*-?[\d.eE+-]+)?)\s*\]"), F.lit(1))
    axis = lambda i: F.transform(pts, lambda p: F.get(F.split(p, r"\s*,\s*"), F.lit(i)).try_cast("double"))
    lo, hi = lambda i: F.min(F.array_min(axis(i))), lambda i: F.max(F.array_max(axis(i)))
    g = f.groupBy("path", "type").agg(F.count("*").alias("n"), F.sum(F.size(pts)).alias("points"), lo(0).alias("west"), lo(1).alias("south"), hi(0).alias("east"), hi(1).alias("north"), lo(2).alias("low"), hi(2).alias("high"))
    return g, f.select("path", F.explode(F.map_keys("properties")).alias("key")).groupBy("path", "key").agg(F.count("*").alias("features"))


def revision_audit(edits: DataFrame) -> DataFrame:
    """(doc, author, ins, del, total, share, rank) of edits(doc, author, kind): authors by total, ties by name."""
    p = edits.groupBy("doc", "author").pivot("kind", ["ins", "del"]).count().na.fill(0, ["ins", "del"]).withColumn("total", F.col("ins") + F.col("del"))
    w = W.partitionBy("doc")
    return p.withColumns({"share": F.col("total") / F.sum("total").over(w), "rank": F.row_number().over(w.orderBy(F.desc("total"), "author"))})


def creator_differs(meta: DataFrame) -> DataFrame:
    """meta(doc, creator, last_by) rows whose last editor isn't the creator."""
    return meta.where(F.lower(F.trim("creator")) != F.lower(F.trim("last_by")))


def block_histogram(lines: DataFrame, header: str, key: str) -> DataFrame:
    """(path, class, n): blocks begin at header lines; a block's class is the first line after it that matches key (its group 1)."""
    b = numbered_blocks(lines, header).where((F.col("block") > 0) & ~F.col("line").rlike(header)).withColumn("c", _first(key))
    per = b.where("c is not null").groupBy("path", "block").agg(F.min_by("c", "line_no").alias("class"))
    return per.groupBy("path", "class").agg(F.count("*").alias("n"))

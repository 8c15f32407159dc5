"""File identification: categories, signatures, variants, text tests, audits and pairings. Rule sets are tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.operators.inventory import extension
from corpuslens.operators.textstats import is_readable_text

SIGNATURES = "ext string, offset int, magic_hex string, kind string, label string, priority int"
# What files of public formats begin with (or hold at an offset), most telling first.
DEFAULT_SIGNATURES = [
    ("png", 0, "89504E470D0A1A0A", "image", "PNG image", 10), ("jpg", 0, "FFD8FF", "image", "JPEG image", 20), ("gif", 0, "47494638", "image", "GIF image", 30),
    ("pdf", 0, "25504446", "document", "PDF document", 40), ("zip", 0, "504B0304", "archive", "ZIP archive", 50), ("gz", 0, "1F8B", "archive", "gzip data", 60),
    ("7z", 0, "377ABCAF271C", "archive", "7-Zip archive", 70), ("flac", 0, "664C6143", "audio", "FLAC audio", 80), ("ogg", 0, "4F676753", "audio", "Ogg container", 90),
    ("mp3", 0, "494433", "audio", "MP3 audio with tags", 100),
    # brands of the ISO media container, then the container itself
    ("heic", 4, "6674797068656963", "image", "HEIC image", 101), ("avif", 4, "6674797061766966", "image", "AVIF image", 102), ("mov", 4, "6674797071742020", "video", "QuickTime movie", 103), ("m4a", 4, "667479704D344120", "audio", "M4A audio", 104),
    ("mp4", 4, "66747970", "video", "ISO media container", 110), ("exe", 0, "4D5A", "program", "Windows program", 120),
    ("elf", 0, "7F454C46", "program", "ELF program", 130), ("sqlite", 0, "53514C69746520666F726D6174203300", "database", "SQLite database", 140), ("tar", 257, "7573746172", "archive", "tar archive", 150),
    # forms of RIFF, told apart at offset 8
    ("webp", 8, "57454250", "image", "WebP image", 160), ("wav", 8, "57415645666D7420", "audio", "Wave audio", 161), ("avi", 8, "415649204C495354", "video", "AVI video", 162),
    ("tif", 0, "49492A00", "image", "TIFF image, little-endian", 170), ("tif", 0, "4D4D002A", "image", "TIFF image, big-endian", 171), ("psd", 0, "38425053", "image", "Photoshop image", 172), ("ico", 0, "00000100", "image", "Windows icon", 173),
    ("rar", 0, "526172211A07", "archive", "RAR archive", 180), ("xz", 0, "FD377A585A00", "archive", "xz data", 181), ("bz2", 0, "425A68", "archive", "bzip2 data", 182), ("zst", 0, "28B52FFD", "archive", "Zstandard data", 183), ("lz4", 0, "04224D18", "archive", "LZ4 data", 184), ("cab", 0, "4D534346", "archive", "Cabinet archive", 185), ("ar", 0, "213C617263683E0A", "archive", "ar archive", 186),
    ("mkv", 0, "1A45DFA3", "video", "Matroska container", 190), ("flv", 0, "464C5601", "video", "Flash video", 191), ("mid", 0, "4D546864", "audio", "MIDI file", 192), ("aiff", 8, "41494646", "audio", "AIFF audio", 193),
    ("class", 0, "CAFEBABE", "program", "Java class", 200), ("wasm", 0, "0061736D", "program", "WebAssembly module", 201), ("ole", 0, "D0CF11E0A1B11AE1", "document", "OLE compound file", 202), ("rtf", 0, "7B5C727466", "document", "Rich text", 203),
    ("woff", 0, "774F4646", "font", "WOFF font", 210), ("woff2", 0, "774F4632", "font", "WOFF2 font", 211), ("otf", 0, "4F54544F", "font", "OpenType font", 212),
    ("parquet", 0, "50415231", "database", "Parquet file", 220), ("avro", 0, "4F626A01", "database", "Avro file", 221), ("pcap", 0, "D4C3B2A1", "capture", "Packet capture", 222), ("pcapng", 0, "0A0D0D0A", "capture", "Packet capture, new form", 223),
    # text starts
    ("xml", 0, "3C3F786D6C", "text", "XML document", 300), ("html", 0, "3C21444F43545950452068746D6C", "text", "HTML document", 301), ("html", 0, "3C21646F63747970652068746D6C", "text", "HTML document", 302), ("ps", 0, "25215053", "document", "PostScript", 303), ("pem", 0, "2D2D2D2D2D424547494E20", "text", "PEM block", 304), ("sh", 0, "2321", "text", "Script", 305), ("ics", 0, "424547494E3A5643414C454E444152", "text", "Calendar", 306), ("vcf", 0, "424547494E3A5643415244", "text", "Contact card", 307),
]
_registered: list[DataFrame] = []


def register_signatures(rules: DataFrame) -> None:
    """Add rows of the SIGNATURES form to what identify() uses when it is given no rules."""
    _registered.append(rules)


def signatures(spark) -> DataFrame:
    return reduce(DataFrame.unionByName, _registered, spark.createDataFrame(DEFAULT_SIGNATURES, SIGNATURES))


def with_category(df: DataFrame, catalog: DataFrame, ext: str = "ext") -> DataFrame:
    """df plus category: of the first catalogue row (ext, cat, priority) for the extension, else other."""
    first = catalog.groupBy(F.lower("ext").alias("_e")).agg(F.min_by("cat", "priority").alias("category"))
    return df.join(first, F.lower(F.col(ext)) == F.col("_e"), "left").drop("_e").withColumn("category", F.coalesce("category", F.lit("other")))


def identify(files: DataFrame, rules: DataFrame | None = None, key: str = "path", head: str = "head") -> DataFrame:
    """(key, kind, sniffed_ext, label): the first rule by priority whose bytes stand at its offset; all null when none does.

    Each file is cut at the rule set's few different (offset, length) places, which meet the rules in an equality join;
    the rule table decides by its size whether it is sent to the tasks.
    """
    rules = (signatures(files.sparkSession) if rules is None else rules).withColumns({"magic_hex": F.upper("magic_hex"), "n": F.length("magic_hex")})
    places = [(r[0], r[1]) for r in rules.select("offset", "n").distinct().collect()]  # a few places of a rule table
    h = F.upper(F.hex(F.col(head)))
    cut = F.array(*(F.struct(F.lit(o).alias("offset"), F.substring(h, 2 * o + 1, n).alias("magic_hex")) for o, n in places))
    e = files.select(F.col(key).alias("_k"), F.explode(cut).alias("c")).select("_k", "c.offset", "c.magic_hex")
    best = e.join(rules, ["offset", "magic_hex"]).groupBy("_k").agg(F.min_by(F.struct("kind", F.col("ext").alias("sniffed_ext"), "label"), "priority").alias("b"))
    return files.join(best, F.col(key) == F.col("_k"), "left").select(F.col(key), "b.kind", "b.sniffed_ext", "b.label")


def signature_mismatch(files: DataFrame, expect: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(path, ext, sniffed_ext, reason, first_bytes) of files(path, ext, head) whose extension expects another signature.

    expect: (ext, sniff array). reason: wrong signature, or missing signature where none was found.
    """
    s = files.join(expect.withColumnRenamed("sniff", "_want"), "ext").join(identify(files, rules), "path")
    bad = s.where(F.col("sniffed_ext").isNull() | ~F.array_contains("_want", F.col("sniffed_ext")))
    return bad.select("path", "ext", "sniffed_ext", F.when(F.col("sniffed_ext").isNull(), "missing signature").otherwise("wrong signature").alias("reason"), F.hex(F.substring("head", 1, 16)).alias("first_bytes"))


def resolve_variant(files: DataFrame, variants: DataFrame, specific_only: bool = False) -> DataFrame:
    """(path, variant): what an ambiguous extension stands for. variants: (ext, ord, name, rule, arg, is_default).

    Rules: hex (bytes at the start), hexat (offset:hex), starts (text start), includes (text). The first that holds wins,
    else the extension's default, unless only rule-proved answers are wanted.
    """
    h, t = F.upper(F.hex("head")), F.decode("head", "ISO-8859-1")
    arg = F.col("arg")
    at = F.split(arg, ":")
    holds = F.when(F.col("rule") == "hex", F.startswith(h, F.upper(arg))).when(F.col("rule") == "hexat", F.startswith(F.substr(h, F.get(at, F.lit(0)).try_cast("int") * 2 + 1), F.upper(F.get(at, F.lit(1))))).when(F.col("rule") == "starts", F.startswith(F.ltrim(t), arg)).when(F.col("rule") == "includes", F.contains(t, arg)).otherwise(False)
    j = files.join(variants, "ext")
    proved = j.where(F.coalesce(holds, F.lit(False))).groupBy("path").agg(F.min_by("name", "ord").alias("proved"))
    default = j.where("is_default").groupBy("path").agg(F.min_by("name", "ord").alias("fallback"))
    r = files.select("path").join(proved, "path", "left").join(default, "path", "left")
    return r.select("path", F.col("proved").alias("variant") if specific_only else F.coalesce("proved", "fallback").alias("variant"))


def looks_delimited(head: Column) -> Column:
    """Two or more filled lines among the first ten, with commas or tabs in even numbers (each within one of a mean of at least one)."""
    lines = F.slice(F.filter(F.split(F.decode(F.substring(head, 1, 2048), "ISO-8859-1"), r"\r?\n"), lambda x: F.trim(x) != ""), 1, 10)

    def even(sep: str) -> Column:
        n = F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(sep), F.lit(""))))
        mean = F.aggregate(n, F.lit(0.0), lambda a, x: a + x) / F.size(n)
        return (mean >= 1) & F.forall(n, lambda x: F.abs(x - mean) <= 1)

    return (F.size(lines) >= 2) & (even(",") | even("\t"))


def resolve_content(files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(path, kind): by signature, else delimited text, else text or binary."""
    j = files.join(identify(files, rules).drop("label"), "path")
    return j.select("path", F.coalesce("kind", F.when(looks_delimited(F.col("head")) & is_readable_text(F.col("head")), "delimited").when(is_readable_text(F.col("head")), "text").otherwise("binary")).alias("kind"))


def audit_openable(files: DataFrame, known: DataFrame, rules: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(per_file, representatives): path, format, ok, reason; and one path per failing format (the smallest).

    The format is the extension, or the lower-case base name without one. A file is fine when its extension is known or
    its content resolves to anything but binary. Files whose head is null are unread: neither fine nor reported.
    """
    base = F.lower(F.element_at(F.split("path", "/"), -1))
    f = files.withColumn("ext", extension(F.col("path"))).withColumn("format", F.when(F.col("ext") == "", base).otherwise(F.col("ext")))
    k = known.select(F.lower("ext").alias("ext")).distinct().withColumn("_known", F.lit(True))
    j = f.join(k, "ext", "left").join(resolve_content(files, rules), "path", "left")
    ok = F.coalesce("_known", F.lit(False)) | (F.col("kind") != "binary")
    reason = F.when(F.col("head").isNull(), "unreadable").when(ok, None).when(F.col("ext") == "", "extensionless binary").otherwise("unrecognised binary")
    per = j.select("path", "format", F.when(F.col("head").isNull(), F.lit(None)).otherwise(ok).alias("ok"), reason.alias("reason"))
    return per, per.where("not ok").groupBy("format").agg(F.min("path").alias("path"), F.min_by("reason", "path").alias("reason"), F.count("*").alias("files"))


# Banners and fields of private keys.
KEY_PATTERNS = {"pem": r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----", "openssh": r"-----BEGIN OPENSSH PRIVATE KEY-----", "putty": r"(?m)^PuTTY-User-Key-File-\d", "pgp": r"-----BEGIN PGP PRIVATE KEY BLOCK-----", "wireguard": r"(?m)^\s*PrivateKey\s*=", "jwk": r"\"kty\"\s*:\s*\"(?:RSA|EC|OKP)\"[^}]*\"d\"\s*:"}


def flag_key_material(df: DataFrame, text: str = "text") -> DataFrame:
    """df plus key_material: names of the private-key forms that the text holds (empty when none)."""
    return df.withColumn("key_material", F.array_compact(F.array(*(F.when(F.col(text).rlike(p), F.lit(k)) for k, p in KEY_PATTERNS.items()))))


def detect_ai_markers(findings: DataFrame, keywords: list[str], fields: list[str], phrases: list[str]) -> DataFrame:
    """(source, field, value, match): named fields that hold a keyword (the first in order), or any field with a phrase."""
    low = F.lower("value")
    first = lambda words: F.get(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, F.lower(w))), F.lit(0)) if words else F.lit(None).cast("string")
    named = F.lower("field").isin([f.lower() for f in fields])
    return findings.withColumn("match", F.coalesce(F.when(named, first(keywords)), first(phrases))).where("match is not null").select("source", "field", "value", "match")


def time_anomalies(df: DataFrame, now: Column, captured: str = "captured", created: str = "created", modified: str = "modified", saved: str = "saved") -> DataFrame:
    """df plus anomalies: dates in the future (2 days' grace), modified over a day before the origin, saved over a day and an hour before it."""
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    day = 86_400_000
    origin, word = F.coalesce(ms(captured), ms(created)), F.when(F.col(captured).isNotNull(), "capture").otherwise("creation")
    future = [F.when(ms(c) - F.unix_millis(now) > 2 * day, F.lit(f"{c} is in the future")) for c in (captured, created, modified)]
    early = [F.when(origin - ms(modified) > day, F.concat(F.lit("modified before "), word)), F.when(origin - ms(saved) > day + 3_600_000, F.concat(F.lit("saved before "), word))]
    return df.withColumn("anomalies", F.array_compact(F.array(*future, *early)))


def filter_listing(files: DataFrame, query: str, limit: int = 300) -> DataFrame:
    """Files whose base name holds the query in any case, largest first, `limit` of them, with the full number found."""
    hit = files.where(F.contains(F.lower(F.element_at(F.split("path", "/"), -1)), F.lit(query.lower())))
    return hit.orderBy(F.desc("size"), "path").limit(limit).crossJoin(F.broadcast(hit.agg(F.count("*").alias("matched"))))  # one row


def pair_sidecars(files: DataFrame, primary: list[str], sidecar: str = "xmp") -> tuple[DataFrame, DataFrame]:
    """(pairs, rest): sidecars with a primary file of the same folder and stem, and the files left over once those are taken."""
    ext = extension(F.col("path"))
    f = files.select("path", ext.alias("ext"), F.regexp_extract("path", r"^(.*/)?", 0).alias("dir"), F.lower(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")).alias("stem"))
    p, s = f.where(F.col("ext").isin(primary)), f.where(F.col("ext") == sidecar)
    pairs = p.join(s.select(F.col("path").alias("sidecar"), "dir", "stem"), ["dir", "stem"]).select("path", "sidecar")
    return pairs, files.join(pairs.select(F.col("sidecar").alias("path")).distinct(), "path", "left_anti")


def sources_by_extension(files: DataFrame, n: int = 10) -> DataFrame:
    """(ext, files, rank): the most frequent extensions of a scanned corpus."""
    c = files.groupBy(extension(F.col("path")).alias("ext")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "ext").limit(n)
    return c.withColumn("rank", F.row_number().over(W.orderBy(F.desc("files"), "ext")))

"""Column functions used by the operators; each takes and returns Columns."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Frame rates that a measured rate snaps to.
FRAME_RATES = (23.976, 24.0, 25.0, 29.97, 30.0, 48.0, 50.0, 59.94, 60.0, 120.0, 240.0)
NOTES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(c: Column) -> Column:
    """Round halves up, towards plus infinity."""
    return F.floor(c + 0.5)


def human_bytes(c: Column | str) -> Column:
    """Byte count as text in steps of 1,024: B, KB with one decimal, MB and GB with two; '-' for null."""
    c = _c(c)
    k = 1024.0
    return F.when(c.isNull(), "-").when(c < 1024, F.format_string("%d B", c.cast("long"))).when(c < 1024**2, F.format_string("%.1f KB", c / k)).when(c < 1024**3, F.format_string("%.2f MB", c / k**2)).otherwise(F.format_string("%.2f GB", c / k**3))


def human_duration(seconds: Column | str) -> Column:
    """Seconds as '1h 2m', '3m 4s' or '5s'; '-' when not positive."""
    s = _c(seconds).cast("double")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), half_up(s % 60)
    return F.when(s.isNull() | F.isnan(s) | (s <= 0), "-").when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))


def human_step(ms: Column | str) -> Column:
    """A regular step in milliseconds as whole days, hours or minutes where it is a multiple, else seconds."""
    ms = _c(ms).cast("long")
    out = None
    for unit, n in (("day", 86_400_000), ("hour", 3_600_000), ("minute", 60_000)):
        k = F.floor(ms / n)
        text = F.when(k == 1, F.lit(f"1 {unit}")).otherwise(F.format_string(f"%d {unit}s", k))
        out = F.when(ms % n == 0, text) if out is None else out.when(ms % n == 0, text)
    return out.otherwise(F.format_string("%d seconds", half_up(ms / 1000)))


def human_span(ms: Column | str) -> Column:
    """A span in milliseconds with the unit that suits it, from ms to years."""
    ms = _c(ms).cast("double")
    s, m, h, d = ms / 1000, ms / 60e3, ms / 3600e3, ms / 86400e3
    unit = lambda v, name: F.when(v < 10, F.format_string(f"%.1f {name}", v)).otherwise(F.format_string(f"%.0f {name}", v))
    secs = F.format_string("%d second%s", half_up(s), F.when(half_up(s) == 1, "").otherwise("s"))
    return F.when(ms <= 0, "0 seconds").when(s < 1, F.format_string("%d ms", half_up(ms))).when(s < 60, secs).when(m < 60, unit(m, "minutes")).when(h < 24, unit(h, "hours")).when(d < 365, unit(d, "days")).otherwise(F.format_string("%.1f years", d / 365))


def human_distance(metres: Column | str) -> Column:
    """Metres below a kilometre, else kilometres with two decimals; '-' for null or 0."""
    m = _c(metres).cast("double")
    return F.when(m.isNull() | (m == 0), "-").when(m >= 1000, F.format_string("%.2f km", m / 1000)).otherwise(F.format_string("%d m", half_up(m)))


def dos_datetime(date: Column | str, time: Column | str) -> Column:
    """Packed DOS date and time as a timestamp; null when a field is out of range."""
    d, t = _c(date).cast("int"), _c(time).cast("int")
    y, mo, da = F.shiftright(d, 9) + 1980, F.shiftright(d, 5).bitwiseAND(F.lit(15)), d.bitwiseAND(F.lit(31))
    h, mi, s = F.shiftright(t, 11), F.shiftright(t, 5).bitwiseAND(F.lit(63)), t.bitwiseAND(F.lit(31)) * 2
    ok = mo.between(1, 12) & da.between(1, 31) & (h < 24) & (mi < 60) & (s < 60)
    return F.when(ok, F.try_make_timestamp(y, mo, da, h, mi, s))


def filetime(ticks: Column | str) -> Column:
    """100-nanosecond ticks since 1601 as a timestamp; null for 0."""
    t = _c(ticks).cast("long")
    return F.when(t > 0, F.timestamp_micros(((t - t % 10).cast("decimal(20,0)") / F.lit(10).cast("decimal(2,0)")).cast("long") - F.lit(11_644_473_600_000_000)))


def serial_date(c: Column | str) -> Column:
    """Spreadsheet day serial (1 = 1900-01-01, with the leap day that never was) as a timestamp; null below 0."""
    c = _c(c).cast("double")
    return F.when(c >= 0, F.timestamp_seconds(half_up((c - 25569) * 86400).cast("long")))


def format_class(code: Column | str) -> Column:
    """Class of a spreadsheet number format: date, currency, percent, number or general. Quoted and bracketed parts don't count."""
    c = F.regexp_replace(F.lower(_c(code)), r'"[^"]*"|\[[^\]$]*\]|\\.', "")
    return F.when(c.rlike(r"[$€£¥]"), "currency").when(c.rlike(r"[ymdhs]") & ~c.rlike("general"), "date").when(c.rlike("%"), "percent").when(c.rlike("[0#]"), "number").otherwise("general")


def guid(c: Column | str) -> Column:
    """16 bytes with the first three groups little-endian as GUID text; null for any other length."""
    h = F.lower(F.hex(_c(c)))
    at = lambda *ix: [F.substring(h, 2 * i + 1, 2) for i in ix]
    return F.when(F.length(_c(c)) == 16, F.concat(*at(3, 2, 1, 0), F.lit("-"), *at(5, 4), F.lit("-"), *at(7, 6), F.lit("-"), *at(8, 9), F.lit("-"), *at(*range(10, 16))))


def nmea_degrees(c: Column | str, hemisphere: Column | str) -> Column:
    """ddmm.mmmm with hemisphere letter as signed degrees; null when unreadable."""
    v = _c(c).try_cast("double")
    deg = F.floor(v / 100)
    return F.when(F.upper(_c(hemisphere)).isin("S", "W"), -1.0).otherwise(1.0) * (deg + (v - deg * 100) / 60)


def igc_degrees(c: Column | str) -> Column:
    """DDMMmmmN or DDDMMmmmE (thousandths of minutes) as signed degrees."""
    c = _c(c)
    d, m, h = F.regexp_extract(c, r"^(\d{2,3})(\d{5})([NSEW])$", 1), F.regexp_extract(c, r"^(\d{2,3})(\d{5})([NSEW])$", 2), F.right(c, F.lit(1))
    return F.when(d != "", (d.try_cast("double") + m.try_cast("double") / 60000) * F.when(h.isin("S", "W"), -1.0).otherwise(1.0))


def xor_checksum(c: Column | str) -> Column:
    """XOR of the characters' codes."""
    codes = F.transform(F.filter(F.split(_c(c), ""), lambda x: x != ""), lambda x: F.ascii(x))
    return F.aggregate(codes, F.lit(0), lambda a, x: a.bitwiseXOR(x))


def rgb_hsl(r: Column | str, g: Column | str, b: Column | str) -> Column:
    """struct(h, s, l): hue in degrees 0..360, saturation and lightness in percent, all rounded halves up."""
    r, g, b = (_c(x) / 255.0 for x in (r, g, b))
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d, lum = hi - lo, (hi + lo) / 2
    h = F.when(d == 0, 0.0).when(hi == r, (g - b) / d + F.when(g < b, 6.0).otherwise(0.0)).when(hi == g, (b - r) / d + 2.0).otherwise((r - g) / d + 4.0)
    s = F.when(d == 0, 0.0).when(lum > 0.5, d / (2.0 - hi - lo)).otherwise(d / (hi + lo))
    return F.struct(half_up(h * 60).cast("int").alias("h"), half_up(s * 100).cast("int").alias("s"), half_up(lum * 100).cast("int").alias("l"))


def rgb_hex(r: Column | str, g: Column | str, b: Column | str) -> Column:
    return F.format_string("#%02x%02x%02x", *(_c(x).cast("int") for x in (r, g, b)))


def shannon(counts: Column | str) -> Column:
    """Entropy in bits of an array of counts."""
    a = F.filter(_c(counts), lambda x: x > 0)
    n = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(a, F.lit(0.0), lambda s, x: s - x / n * F.log2(x / n))


def rational_seconds(c: Column | str) -> Column:
    """'120/24s' or '5s' as seconds; null when unreadable."""
    parts = F.split(F.regexp_replace(F.trim(_c(c)), "s$", ""), "/")
    return F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.when(F.size(parts) == 1, 1.0)))


def timecode_seconds(c: Column | str, fps: Column | float) -> Column:
    """HH:MM:SS:FF (or ;FF) at a frame rate as seconds; null when unreadable."""
    p = lambda i: F.nullif(F.regexp_extract(_c(c), r"^(\d+):(\d+):(\d+)[:;](\d+)$", i), F.lit("")).cast("double")
    return p(1) * 3600 + p(2) * 60 + p(3) + p(4) / (F.lit(fps) if isinstance(fps, (int, float)) else fps)


def sequence_type(c: Column | str) -> Column:
    """DNA, RNA, protein or unknown, from the first 2,000 letters."""
    s = F.substring(F.regexp_replace(F.upper(_c(c)), "[^A-Z]", ""), 1, 2000)
    n = F.length(s)
    share = lambda letters: F.length(F.regexp_replace(s, f"[^{letters}]", "")) / n
    return F.when(F.coalesce(n, F.lit(0)) == 0, "unknown").when((share("ACGTN") > 0.9) & ~s.contains("U"), "DNA").when(share("ACGUN") > 0.9, "RNA").when(share("ACDEFGHIKLMNPQRSTVWYX") > 0.9, "protein").otherwise("unknown")


def compact_number(c: Column | str) -> Column:
    """At most four decimals, without trailing zeros."""
    t = F.format_string("%.4f", _c(c).cast("double"))
    return F.when(_c(c).isNotNull(), F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def note_of(freq: Column | str) -> Column:
    """struct(note, cents) of a frequency against A4 = 440 Hz; null when not positive."""
    f = _c(freq).cast("double")
    midi = 69 + 12 * F.log2(f / 440)
    n = half_up(midi).cast("int")
    name = F.concat(F.element_at(F.array(*map(F.lit, NOTES)), F.pmod(n, F.lit(12)) + 1), (F.floor(n / 12) - 1).cast("int").cast("string"))
    return F.when(f > 0, F.struct(name.alias("note"), half_up(100 * (midi - n)).cast("int").alias("cents")))


def decode_cp437(c: Column | str) -> Column:
    """Bytes of the original PC code page as text. Control bytes other than tab, line feed and return are dropped."""
    high = bytes(range(128, 256))
    latin = F.regexp_replace(F.decode(_c(c), "ISO-8859-1"), "[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return F.translate(latin, high.decode("latin-1"), high.decode("cp437"))


def strip_ansi(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), "\x1b\\[[0-9;?]*[A-Za-z]", "")


def clean_ext(c: Column | str) -> Column:
    """Lower case, a-z and 0-9 only; '(none)' when nothing is left, '(other)' beyond 16 characters."""
    k = F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), "[^a-z0-9]", "")
    return F.when(k == "", "(none)").when(F.length(k) > 16, "(other)").otherwise(k)


def clean_name(c: Column | str) -> Column:
    """Player name: upper case, A-Z and 0-9 only, exactly five characters, else null."""
    n = F.regexp_replace(F.upper(F.coalesce(_c(c), F.lit(""))), "[^A-Z0-9]", "")
    return F.when(F.length(n) == 5, n)


def is_blocked(c: Column | str, words: list[str]) -> Column:
    """Whether a name holds a blocked word once digits are read as the letters they resemble."""
    plain = F.translate(F.lower(_c(c)), "0134578", "oieastb")
    return F.exists(F.array(*map(F.lit, words)), lambda w: plain.contains(w)) if words else F.lit(False)


def clean_cause(c: Column | str) -> Column:
    """Lower-case letters, digits, dash and underscore, 24 at most; null when nothing is left."""
    return F.nullif(F.substring(F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), "[^a-z0-9_-]", ""), 1, 24), F.lit(""))


def hash_client(c: Column | str, salt: str) -> Column:
    """SHA-256 of 'salt:address' in hex."""
    return F.sha2(F.concat_ws(":", F.lit(salt), _c(c).cast("string")), 256)


def is_unsafe_path(c: Column | str) -> Column:
    """Absolute, drive-letter or UNC path, or one with a .. segment."""
    n = F.regexp_replace(_c(c), r"\\", "/")
    return n.rlike("^/") | n.rlike("^[A-Za-z]:") | F.array_contains(F.split(n, "/"), "..")


def is_env_file(c: Column | str) -> Column:
    """Base name .env or .env.x, unless x says it is an example."""
    base = F.lower(F.element_at(F.split(_c(c), "[/\\\\]"), -1))
    return base.rlike(r"^\.env(\..+)?$") & ~base.rlike(r"\.(example|sample|template|dist|defaults?)$")


def snap_rate(c: Column | str, standards=FRAME_RATES) -> Column:
    """The nearest standard rate when within 0.5, else two decimals."""
    x = _c(c).cast("double")
    best = F.array_min(F.array(*(F.struct(F.abs(x - s).alias("d"), F.lit(i).alias("i"), F.lit(float(s)).alias("s")) for i, s in enumerate(standards))))
    return F.when(x.isNull(), None).when(best["d"] < 0.5, best["s"]).otherwise(half_up(x * 100) / 100)


def whole_percent(part: Column, total: Column) -> Column:
    return F.when(total > 0, half_up(100.0 * part / total)).otherwise(0).cast("long")


def register_sql(spark: SparkSession) -> list[str]:
    """Make the plain text functions callable from SQL as temporary SQL functions; returns their names."""
    made = {
        "human_bytes(n BIGINT) RETURNS STRING": "CASE WHEN n IS NULL THEN '-' WHEN n < 1024 THEN concat(n, ' B') WHEN n < 1048576 THEN format_string('%.1f KB', n / 1024D) WHEN n < 1073741824 THEN format_string('%.2f MB', n / 1048576D) ELSE format_string('%.2f GB', n / 1073741824D) END",
        "clean_ext(s STRING) RETURNS STRING": "CASE WHEN regexp_replace(lower(coalesce(s, '')), '[^a-z0-9]', '') = '' THEN '(none)' WHEN length(regexp_replace(lower(s), '[^a-z0-9]', '')) > 16 THEN '(other)' ELSE regexp_replace(lower(s), '[^a-z0-9]', '') END",
        "word_count(s STRING) RETURNS INT": "CASE WHEN trim(coalesce(s, '')) = '' THEN 0 ELSE size(split(trim(s), '\\\\s+')) END",
    }
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.partition("(")[0] for h in made]

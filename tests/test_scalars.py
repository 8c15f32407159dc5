from pyspark.sql import functions as F

from corpuslens.functions import scalars as sc


def one(spark, col, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(col.alias("x")).first().x


def test_texts_of_sizes_and_times(spark):
    for n, want in ((None, "-"), (0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1536 * 1024, "1.50 MB"), (5 * 1024**3, "5.00 GB")):
        assert one(spark, sc.human_bytes(F.lit(n).cast("long"))) == want
    for s, want in ((0, "-"), (59, "59s"), (61, "1m 1s"), (3660, "1h 1m")):
        assert one(spark, sc.human_duration(F.lit(s))) == want
    for ms, want in ((86_400_000, "1 day"), (172_800_000, "2 days"), (3_600_000, "1 hour"), (120_000, "2 minutes"), (1500, "2 seconds")):
        assert one(spark, sc.human_step(F.lit(ms))) == want
    for ms, want in ((0, "0 seconds"), (500, "500 ms"), (1000, "1 second"), (90_000, "1.5 minutes"), (3 * 86400e3, "3.0 days"), (800 * 86400e3, "2.2 years")):
        assert one(spark, sc.human_span(F.lit(float(ms)))) == want
    assert one(spark, sc.human_distance(F.lit(999.4))) == "999 m" and one(spark, sc.human_distance(F.lit(1500.0))) == "1.50 km"


def test_packed_times(spark):
    d, t = (2024 - 1980) << 9 | 2 << 5 | 29, 13 << 11 | 5 << 5 | 7
    assert str(one(spark, sc.dos_datetime(F.lit(d), F.lit(t)))) == "2024-02-29 13:05:14"
    assert one(spark, sc.dos_datetime(F.lit(13 << 5 | 1), F.lit(0))) is None
    assert str(one(spark, sc.filetime(F.lit(116_444_736_000_000_000)))) == "1970-01-01 00:00:00"
    assert str(one(spark, sc.serial_date(F.lit(45000.5)))) == "2023-03-15 12:00:00"
    assert [one(spark, sc.format_class(F.lit(c))) for c in ("yyyy-mm-dd", "$#,##0.00", "0%", "0.00", "General")] == ["date", "currency", "percent", "number", "general"]


def test_identifiers_and_paths(spark):
    assert one(spark, sc.guid(F.lit(bytes(range(16))))) == "03020100-0504-0706-0809-0a0b0c0d0e0f"
    assert [one(spark, sc.clean_ext(F.lit(c))) for c in ("JPG", ".tar.gz", "", "x" * 17)] == ["jpg", "targz", "(none)", "(other)"]
    assert one(spark, sc.clean_name(F.lit("ab-c1z"))) == "ABC1Z" and one(spark, sc.clean_name(F.lit("abc"))) is None
    assert one(spark, sc.is_blocked(F.lit("B4DXX"), ["bad"])) and not one(spark, sc.is_blocked(F.lit("GOODX"), ["bad"]))
    assert one(spark, sc.clean_cause(F.lit("Hit by: ROCK!"))) == "hitbyrock"
    assert [one(spark, sc.is_unsafe_path(F.lit(p))) for p in ("/etc/x", "C:\\x", "a/../b", "\\\\srv\\x", "a/b..c")] == [True, True, True, True, False]
    assert [one(spark, sc.is_env_file(F.lit(p))) for p in ("a/.env", ".env.local", ".env.example", "x.env")] == [True, True, False, False]


def test_positions_and_notes(spark):
    assert abs(one(spark, sc.nmea_degrees(F.lit("4807.038"), F.lit("N"))) - 48.1173) < 1e-4
    assert abs(one(spark, sc.igc_degrees(F.lit("00533456W"))) + 5.5576) < 1e-4
    assert one(spark, sc.xor_checksum(F.lit("GPGLL,1"))) == __import__("functools").reduce(lambda a, c: a ^ ord(c), "GPGLL,1", 0)
    assert tuple(one(spark, sc.note_of(F.lit(440.0)))) == ("A4", 0) and one(spark, sc.note_of(F.lit(261.63)))[0] == "C4"
    assert tuple(one(spark, sc.rgb_hsl(F.lit(255), F.lit(0), F.lit(0)))) == (0, 100, 50) and one(spark, sc.rgb_hex(F.lit(1), F.lit(2), F.lit(255))) == "#0102ff"


def test_other_texts(spark):
    assert one(spark, sc.rational_seconds(F.lit("120/24s"))) == 5.0 and one(spark, sc.rational_seconds(F.lit("7s"))) == 7.0 and one(spark, sc.rational_seconds(F.lit("1/0s"))) is None
    assert one(spark, sc.timecode_seconds(F.lit("01:00:01:12"), 24.0)) == 3601.5
    assert [one(spark, sc.sequence_type(F.lit(c))) for c in ("ACGTTTGA", "ACGUUGA", "MKVLWEH", "")] == ["DNA", "RNA", "protein", "unknown"]
    assert [one(spark, sc.compact_number(F.lit(x))) for x in (1.5, 2.0, 0.12346)] == ["1.5", "2", "0.1235"]
    assert one(spark, sc.decode_cp437(F.lit(b"\x80\x01\xe1a\n"))) == "Çßa\n"
    assert one(spark, sc.strip_ansi(F.lit("\x1b[31mred\x1b[0m"))) == "red"
    assert one(spark, sc.snap_rate(F.lit(29.96))) == 29.97 and one(spark, sc.snap_rate(F.lit(12.345))) == 12.35
    assert abs(one(spark, sc.shannon(F.array(F.lit(1.0), F.lit(1.0), F.lit(0.0)))) - 1) < 1e-12


def test_sql_functions(spark):
    sc.register_sql(spark)
    assert tuple(spark.sql("select human_bytes(2048), clean_ext('A.b'), word_count(' a  b ')").first()) == ("2.0 KB", "ab", 2)

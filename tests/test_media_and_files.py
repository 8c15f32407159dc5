import json
import math
import random

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import classify, geometry, graph, inventory, pixels, search, signal, similarity, textstats, tracks
from corpuslens.plans import corpus, media
from corpuslens.sources import extend, readers, sinks


def test_climb_moves_only_at_the_threshold(spark):
    rows = [("a", i, float(e)) for i, e in enumerate((10, 11.9, 12, 11, 13.9, 14, 11))] + [("b", 0, None), ("b", 1, 5.0)]
    got = {r.track_id: (r.ascent, r.descent) for r in tracks.track_climb(spark.createDataFrame(rows, "track_id string, seq int, ele double")).collect()}
    assert got == {"a": (4.0, 3.0), "b": (0.0, 0.0)}


def test_pause_of_exactly_a_minute_is_moving(spark):
    rows = [("a", i, 0.0, i / 1000, t) for i, t in enumerate((0, 60, 121))]
    df = spark.createDataFrame(rows, "track_id string, seq int, lat double, lon double, t long").withColumn("time", F.timestamp_seconds("t"))
    r = tracks.track_moving(df).first()
    assert r.moving_s == 60 and abs(r.distance_m - 2 * 111.19) < 0.1


def test_timelines(spark):
    t = spark.createDataFrame([("m", 0, 500000, 100, 400), ("m", 200, 1000000, 100, 400), ("n", 100, 250000, 100, 200)], "file string, tick long, us int, ppq int, max_tick long")
    assert {r.file: (r.seconds, r.first_bpm) for r in tracks.midi_duration(t).collect()} == {"m": (3.0, 120.0), "n": (0.75, 120.0)}
    f = spark.createDataFrame([("c", 0.0, [0, 0]), ("c", 0.5, [100, 20]), ("c", 1.0, [100, 30])], "clip_id string, t double, rgb array<int>")
    assert [(r.t, r.diff, r.confidence) for r in tracks.scene_changes(f).collect()] == [(0.5, 60.0, 55)]
    lines = spark.createDataFrame([("f", 0, "[00:02.50][01:00]hi"), ("f", 1, "plain")], "path string, line_no int, line string")
    assert [(r.seconds, r.text) for r in tracks.timed_lines(lines).collect()] == [(2.5, "hi"), (60.0, "hi"), (None, "plain")]


def test_machine_path(spark):
    code = ["G21 G90", "G0 X10 Y0", "G1 X10 Y10 E1 F600", "G91", "G1 X5 E1", "X5", "G90", "G1 X0 Y10 Z2"]
    lines = spark.createDataFrame([("f", i, c) for i, c in enumerate(code)], "path string, line_no int, line string")
    r = tracks.toolpath_summary(lines).first()
    assert (r.rapid, r.feed, r.extrude) == (1, 4, 2) and r.extruded_mm == 15.0 and r.max_x == 20.0 and r.layers == 2
    assert abs(r.cut_mm - (5 + math.hypot(20, 2))) < 1e-9


def samples(spark, f, n=4096, rate=8192):
    return spark.range(n).select(F.lit("c").alias("clip_id"), F.lit(0).alias("channel"), F.col("id").alias("idx"), F.sin(2 * math.pi * f * F.col("id") / rate).alias("v"), F.lit(rate).alias("sample_rate"))


def test_spectrum_and_pitch(spark):
    s = samples(spark, 512)
    st = signal.spectrum_stats(signal.spectrogram(s, 1024)).first()
    assert abs(st.peak_hz - 512) < 8
    assert abs(signal.pitch(s, 2048).first().hz - 512) < 2
    assert abs(signal.spectral_centroid(s, 1024).first().centroid_hz - 512) < 30


def test_pixels(spark):
    px = spark.range(32 * 32).select(F.lit("i").alias("image_id"), (F.col("id") % 32).cast("int").alias("x"), (F.col("id") / 32).cast("int").alias("y")).withColumns({"r": F.col("x") * 8, "g": F.col("y") * 8, "b": F.lit(100)})
    odd = px.withColumn("r", F.pmod(F.col("x") * F.col("x") * 37 + F.col("y") * 61 + F.col("x") * F.col("y") * F.col("y") * 13, F.lit(256)))
    assert len(pixels.phash(odd).first().phash) == 16 and pixels.phash(odd).first().phash == pixels.phash(odd.repartition(7)).first().phash
    assert pixels.sharpness(px.withColumns({"r": F.lit(9), "g": F.lit(9), "b": F.lit(9)})).first().label == "blurry"
    spot = px.withColumns({c: F.when((F.col("x") == 20) & (F.col("y") == 5), 255).otherwise(0) for c in "rgb"})
    r = pixels.focus_region(spot, 8).first()
    assert (r.cell_x, r.cell_y, r.center_x, r.center_y) == (2, 0, 20.0, 4.0)
    ident = spark.range(27).select(F.col("id").alias("i"), *((F.expr(f"id div {3**k} % 3") * 127.5).alias(c) for k, c in enumerate("rgb")))
    out = pixels.apply_lut(px, ident, 3).collect()
    assert len(out) == 1024 and all(abs(r.lr - r.r) < 1e-6 and abs(r.lg - r.g) < 1e-6 and abs(r.lb - r.b) < 1e-6 for r in out)


def test_meshes_and_components(spark):
    cube = [((0, 0, 0), (1, 0, 0), (0, 1, 0)), ((0, 0, 0), (0, 1, 0), (0, 0, 1)), ((5, 5, 5), (6, 5, 5), (5, 6, 5))]
    cols = "mesh_id string, tri long, " + ", ".join(f"{p}{q} double" for p in "abc" for q in "xyz")
    df = spark.createDataFrame([("m", i, *(float(v) for p in t for v in p)) for i, t in enumerate(cube)], cols)
    assert [(r.body, r.triangles) for r in geometry.mesh_bodies(df).orderBy("body").collect()] == [(1, 2), (2, 1)]
    assert geometry.mesh_stats(df).first().area == 1.5
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (7, 7), (4, None)], "src long, dst long")
    for k in (1, 37):
        assert {r.node: r.component for r in graph.connected_components(e.repartition(k)).collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    long = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.connected_components(long).where("component <> 0").count() == 0
    assert graph.connected_components(e.limit(0)).count() == 0


def test_near_hashes_match_brute_force(spark):
    import random

    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(20)]
    hs = [*base, *(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 9))) for b in base)]
    rows = [(i, h - 2**64 if h >= 2**63 else h) for i, h in enumerate(hs)]
    got = {(r.a, r.b) for r in similarity.near_duplicates(spark.createDataFrame(rows, "id long, hash long"), 7).collect()}
    low = {}
    for i, h in enumerate(hs):
        low.setdefault(h, i)
    want = {(low[h], i) for i, h in enumerate(hs) if low[h] != i} | {(a, b) for x, a in low.items() for y, b in low.items() if a < b and (x ^ y).bit_count() <= 7}
    assert got == want


def test_inventory(spark):
    f = spark.createDataFrame([("a/b/x.jpg", 5, "photo", "jpg"), ("a/y.mp3", 5, "audio", "mp3"), ("z", 1, "other", "")], "path string, size long, category string, ext string")
    b = {(r.level, r.name): (r["count"], r.bytes) for r in inventory.breakdown(f).collect()}
    assert b["category", "video"] == (0, 0) and b["total", "all"] == (3, 11) and b["distinct_exts", "all"][0] == 3
    r = inventory.rollup_paths(f)
    assert {x.folder: x.bytes for x in r.collect()} == {"a": 10, "a/b": 5}
    assert {x.folder: x.category for x in inventory.dominant_category(r).collect()} == {"a": "photo", "a/b": "photo"}
    crc = spark.createDataFrame([("z", "a", 3421780262, b"123456789"), ("z", "b", 1, b"x"), ("z", "c", 1, None)], "archive string, name string, crc long, content binary")
    assert tuple(inventory.verify_crc(crc).first()) == ("z", 1, 1, 1, ["b"])
    e = spark.createDataFrame([("z", "a", 10, 20000, 8, 0, False, 1, 788, False), ("z", "d/", 0, 0, 0, 0, True, 0, 788, False)], "archive string, name string, comp_size long, uncomp_size long, method int, crc long, is_dir boolean, flags int, version_made_by int, zip64 boolean")
    s = inventory.summarise_archives(e).first()
    assert (s.files, s.dirs, s.encrypted, s.host_system, s.worst_entry, s.suspicious, s.methods) == (1, 1, 1, 3, "a", True, {8: 1})
    c = spark.createDataFrame([(1, "photo", ["JPG", "png"]), (2, "other", ["jpg", "x"])], "ord int, cat string, exts array<string>")
    assert {r.category: r.extensions for r in inventory.catalog_counts(c).collect()} == {"photo": 2, "other": 1, "all": 3}


def test_classification(spark):
    f = spark.createDataFrame([("a/p.png", "png", b"\x89PNG\r\n\x1a\nxx"), ("q.jpg", "jpg", b"\x89PNG\r\n\x1a\n"), ("r.jpg", "jpg", b"hello\n"), ("t", "", b"a,b\n1,2\n3,4\n"), ("u.bin", "bin", bytes(range(256)))], "path string, ext string, head binary")
    assert {r.path: r.sniffed_ext for r in classify.identify(f).collect()}["a/p.png"] == "png"
    want = spark.createDataFrame([("png", ["png"]), ("jpg", ["jpg"])], "ext string, sniff array<string>")
    assert {(r.path, r.reason) for r in classify.signature_mismatch(f, want).collect()} == {("q.jpg", "wrong signature"), ("r.jpg", "missing signature")}
    assert {r.path: r.kind for r in classify.resolve_content(f).collect()} == {"a/p.png": "image", "q.jpg": "image", "r.jpg": "text", "t": "delimited", "u.bin": "binary"}
    per, reps = classify.audit_openable(f, spark.createDataFrame([("png",)], "ext string"))
    assert [(r.format, r.path, r.reason) for r in reps.collect()] == [("bin", "u.bin", "unrecognised binary")]
    v = spark.createDataFrame([("jpg", 1, "png inside", "hex", "89504e47", False), ("jpg", 2, "greeting", "starts", "hel", False), ("jpg", 3, "plain", "none", "", True), ("bin", 1, "default", "none", "", True)], "ext string, ord int, name string, rule string, arg string, is_default boolean")
    assert {r.path: r.variant for r in classify.resolve_variant(f, v).where("variant is not null").collect()} == {"q.jpg": "png inside", "r.jpg": "greeting", "u.bin": "default"}
    k = spark.createDataFrame([("-----BEGIN RSA PRIVATE KEY-----",), ("-----BEGIN PUBLIC KEY-----",)], "text string")
    assert [r.key_material for r in classify.flag_key_material(k).collect()] == [["pem"], []]
    pairs, rest = classify.pair_sidecars(spark.createDataFrame([("d/A.JPG",), ("d/a.xmp",), ("e/a.xmp",)], "path string"), ["jpg"])
    assert [tuple(r) for r in pairs.collect()] == [("d/A.JPG", "d/a.xmp")] and {r.path for r in rest.collect()} == {"d/A.JPG", "e/a.xmp"}


def test_time_anomalies(spark):
    df = spark.createDataFrame([("2024-01-10", None, "2024-01-01", "2024-01-08"), (None, "2024-01-01", "2030-01-01", None)], "captured string, created string, modified string, saved string")
    df = df.select(*(F.to_timestamp(c).alias(c) for c in df.columns))
    got = [r.anomalies for r in classify.time_anomalies(df, F.lit("2024-02-01").cast("timestamp")).collect()]
    assert got == [["modified before capture", "saved before capture"], ["modified is in the future"]]


def test_texts_and_markup(spark):
    t = textstats.text_stats(spark.createDataFrame([("a b\n\nc",), ("",), (None,)], "text string")).collect()
    assert [(r.chars, r.words, r.lines, r.paragraphs, r.reading_minutes) for r in t] == [(6, 3, 3, 2, 1), (0, 0, 0, 0, 0), (0, 0, 0, 0, 0)]
    x = spark.createDataFrame([("<svg fill='red'><g style='stroke: #FFF'><p/></g></svg>",)], "x string")
    assert x.select(textstats.markup_depth(F.col("x")).alias("d"), textstats.paint_colours(F.col("x")).alias("c")).first() == (3, ["red", "#fff"])
    i = textstats.extract_indicators(spark.createDataFrame([("see http://a.com/x. or mail me@b.org, 10.0.0.300 10.0.0.1 and Foo.Example.net main.py",)], "text string")).first()
    assert (i.urls, i.emails, i.ipv4, i.domains) == (["http://a.com/x"], ["me@b.org"], ["10.0.0.1"], ["foo.example.net"])
    j = textstats.json_stats(spark.createDataFrame([(1, '{"a": [1, {"b": {}}]}'), (2, "nope")], "id int, j string"), "id", "j").orderBy("id").collect()
    assert tuple(j[0])[1:] == (2, 4, 1, 2) and j[1]["keys"] is None
    e = textstats.entropy_profile(spark.createDataFrame([("a", bytes(1000)), ("b", bytes(range(256)) * 64), ("c", b"x")], "path string, content binary"))
    assert {r.path: r.verdict for r in e.collect()}["a"] == "low" and e.count() == 2
    h = spark.createDataFrame([("ab".encode("utf-16-le"),), (b"plain",), (b"",), (bytes(range(128, 200)),)], "h binary")
    assert [r.x for r in h.select(textstats.is_readable_text(F.col("h")).alias("x")).collect()] == [True, True, True, False]


def test_search(spark):
    f = spark.createDataFrame([("s", "Camera", "g", "Model", "X1"), ("s", "Camera", "g", "Lens", "50mm"), ("s", "GPS camera", "g", "Lat", "1")], "source string, section string, grp string, field string, value string")
    assert {(r.field, r.matched) for r in search.search(f, "lens").collect()} == {("Lens", "row")}
    assert {(r.field, r.matched) for r in search.search(f, "camera").collect()} == {("Model", "section"), ("Lens", "section"), ("Lat", "section")}
    assert {r.field for r in search.search(f, "optics", {"optics": ["50MM"]}).collect()} == {"Lens"}
    c = spark.createDataFrame([("JPEG image", ["jpg"], "photo"), ("Text", ["txt"], "document")], "label string, exts array<string>, cat string").withColumn("tags", F.lit(None).cast("string"))
    assert search.search_catalog(c, ".JPG").count() == 1 and search.search_catalog(c, "", "document").count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.CSV").write_text('x;y\n1;"a;\nb ""q"""\n\n2;z\n')
    (tmp_path / "d" / "b.json").write_text('{"a": 1, // note\n "u": "http://x", /* c */ "l": [1, 2,],}')
    root = f"file://{tmp_path}/d"
    assert {r.ext: r.size for r in readers.scan_corpus(spark, root).collect()}.keys() == {"csv", "json"}
    head = readers.with_head(readers.scan_corpus(spark, root, content=True), 3)
    assert {bytes(r["head"]) for r in head.collect()} == {b"x;y", b'{"a'}
    assert [tuple(r) for r in readers.read_delimited(spark, f"{root}/a.CSV").collect()] == [("1", 'a;\nb "q"'), ("2", "z")]
    assert [r.cells for r in readers.read_cells(spark, f"{root}/a.CSV", ";").orderBy("row_no").collect()] == [["x", "y"], ["1", 'a;\nb "q"'], ["2", "z"]]
    j = readers.parse_relaxed_json(readers.read_texts(spark, f"{root}/b.json"), "text").select(F.to_json("json").alias("j")).first().j
    assert json.loads(j) == {"a": 1, "u": "http://x", "l": [1, 2]}
    p = readers.profile_jsonl(spark.createDataFrame([('{"a": 1}',), ('{"b": 1, "a": 2}',), ("x",), ("",)], "line string")).first()
    assert tuple(p) == (3, 2, ["a", "b"])
    assert [r.line for r in readers.read_lines(spark, f"{root}/a.CSV").orderBy("line_no").collect()][0] == "x;y"


def test_sinks(spark, tmp_path):
    f = spark.createDataFrame([("s", "A", "g", 'q"x', "1"), ("s", "A", "g", "k", "2"), ("s", "A", "g", "k", "3"), ("s", "B", "g", "long", "y" * 6000)], "source string, section string, grp string, field string, value string")
    d = json.loads(sinks.findings_json(f.where("section = 'A'")).first().json)
    assert d == {"A": {'q"x': "1", "k": ["2", "3"]}}
    sinks.write_findings_csv(f, f"file://{tmp_path}/csv")
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert text.startswith('\ufeff"Section","Group","Field","Value"\r\n') and '"q""x"' in text and "(6000 characters in all)" in text and len(text) < 5500
    sinks.write_backup(spark.createDataFrame([("a,b", None), ('q"', "x")], "a string, b string").coalesce(1), f"file://{tmp_path}/bak")
    assert next((tmp_path / "bak").glob("part-*")).read_text() == 'a,b\n"a,b",\n"q""",x\n'


def test_extractors_keep_errors(spark):
    def first_byte(path, content):
        yield "Bytes", "head", "first", content[0]

    extend.register_extractor(["bin"], first_byte)
    f = spark.createDataFrame([("a.bin", "bin", b"\x07"), ("b.bin", "bin", b""), ("c.txt", "txt", b"x")], "path string, ext string, content binary")
    assert {(r.source, r.section, r.value if r.section == "Bytes" else r.field) for r in extend.run_extractors(f).collect()} == {("a.bin", "Bytes", "7"), ("b.bin", "Error", "IndexError")}


@pytest.mark.parametrize("n", [1, 37])
def test_results_do_not_depend_on_partitions(spark, sf, n):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(map(tuple, textstats.character_entropy(docs, "source", "lang").select("source", F.round("entropy", 9)).collect()))
    assert want == sorted(map(tuple, textstats.character_entropy(docs.repartition(n), "source", "lang").select("source", F.round("entropy", 9)).collect()))


def _bodies(links):
    """Components by brute force: sets that share a member are merged until none do."""
    sets = []
    for link in map(set, links):
        sets = [x for x in sets if not x & link] + [link.union(*(x for x in sets if x & link))]
    return sets


def test_bodies_by_brute_force(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(50)]
    got = geometry.graph_bodies(spark.createDataFrame(edges, "l long, r long"), "l", "r").collect()
    assert sorted(map(tuple, got)) == sorted((min(b), len(b)) for b in _bodies((x, -y - 1) for x, y in edges))
    tri = [("m", i, *(float(v) for _ in range(3) for v in (rng.randrange(4), rng.randrange(4), 0))) for i in range(12)]
    got = geometry.mesh_bodies(spark.createDataFrame(tri, "mesh_id string, tri long, " + ", ".join(f"{p}{q} double" for p in "abc" for q in "xyz"))).collect()
    want = _bodies([("t", r[1]), *(r[k : k + 3] for k in (2, 5, 8))] for r in tri)
    assert sorted(r.triangles for r in got) == sorted(sum(x[0] == "t" for x in b) for b in want)


def test_graph_query_takes_all_edges(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    nodes = li.select("l_suppkey").distinct().count() + li.select("l_partkey").distinct().count()
    assert sum(r.nodes for r in media.QUERIES["g18_graph_bodies"](spark, sf).collect()) == nodes


def test_matches_are_numbered_across_ranges(spark):
    df = spark.createDataFrame([(i * 37 % 1009, i % 5) for i in range(1009)], "doc_id long, hits long").repartition(4)
    got = search.number_matches(df, ["doc_id"])
    assert sorted((r.doc_id, r.match) for r in got.collect()) == [(i, i + 1) for i in range(1009)]
    assert "windowspecdefinition(doc_id" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_listing_is_limited_before_it_meets_the_count(spark, sf):
    df = corpus.QUERIES["p17_filter_listing"](spark, sf)
    files = corpus._files(spark, sf).where("split_part(path, '/', -1) like '%7%'")
    want = [(r.path, r.size) for r in files.orderBy(F.desc("size"), "path").limit(300).collect()]
    assert [tuple(r) for r in df.collect()] == [(*x, files.count()) for x in want]
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_spectrogram_by_stretches(spark):
    import numpy as np

    from corpuslens.operators import signal

    rng = np.random.default_rng(1)
    clips = {"a": rng.normal(size=203), "b": rng.normal(size=16), "c": rng.normal(size=15)}
    df = spark.createDataFrame([(k, i, float(v), 8000) for k, x in clips.items() for i, v in enumerate(x)], "clip_id string, idx long, v double, sample_rate int").repartition(5)
    got = {(r.clip_id, r.frame): r.db for r in signal.spectrogram(df, 16, 4, together=5).collect()}
    w = signal._window("hann", 16)
    want = {(k, f): 20 * np.log10(np.abs(np.fft.rfft(x[4 * f : 4 * f + 16] * w))[:8] / w.sum() * 2 + 1e-12) for k, x in clips.items() for f in range((len(x) - 16) // 4 + 1) if len(x) >= 16}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_readable_share_of_odd_texts_is_its_sqls(spark, tmp_path):
    """No text, an empty one, zeros between letters, a mark, and a share that lies between two roundings (323 of 640 bytes)."""
    import duckdb

    from corpuslens.plans import corpus

    texts = [None, "", "a\0" * 40, "\ufeffab", "a" * 323 + "\u20ac" + "\u00e9" * 157, "plain", "\u00e9", "a\nb\tc\r\n" * 9 + "\x01"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(corpus.ORACLE["p6_readable_share"] + " order by doc_id").fetchall()
    assert list(map(str, want)) == [str(tuple(r)) for r in corpus.QUERIES["p6_readable_share"](spark, str(tmp_path)).orderBy("doc_id").collect()]


def test_bodies_of_small_and_large_meshes(spark, monkeypatch):
    """Small meshes never reach the iterated job; meshes over the size do, and have the same bodies. Parts of a few triangles are drawn together, too."""
    rng = random.Random(6)
    names = ["small", None, *("m" * 40 + str(i) for i in range(5))]
    tri = [(m, 1000 * j + i, *(float(v) for _ in range(3) for v in (rng.randrange(6), rng.randrange(6), rng.randrange(2)))) for j, m in enumerate(names) for i in range(8 * (j + 1))]
    tri = [(*r[:2], *(r[2:5] * 3 if r[1] % 10 == 0 else r[2:])) for r in tri]  # some are a point
    rng.shuffle(tri)
    df = spark.createDataFrame(tri, "mesh_id string, tri long, " + ", ".join(f"{p}{q} double" for p in "abc" for q in "xyz")).repartition(3)
    want = []
    for m in names:
        bodies = [[t[1] for t in b if t[0] == "t"] for b in _bodies([("t", r[1]), *(r[k : k + 3] for k in (2, 5, 8))] for r in tri if r[0] == m)]
        want += [(m, k + 1, len(b)) for k, b in enumerate(sorted(bodies, key=lambda b: (-len(b), min(b))))]
    found = lambda: sorted(map(str, map(tuple, geometry.mesh_bodies(df).collect())))
    for rows in (30, 1):
        with monkeypatch.context() as m:
            m.setattr(geometry, "MESH_ROWS", rows)
            m.setattr(geometry, "MESH_TASK", 20)
            assert found() == sorted(map(str, want))
    monkeypatch.setattr(geometry, "connected_components", None)
    assert found() == sorted(map(str, want))

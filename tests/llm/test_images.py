import numpy as np

from corpuslens.llm import images

SCHEMA = "image_id long, width int, height int, pixels binary, node long"


def picture(seed, side=128):
    rng = np.random.default_rng(seed)
    a = np.full((side, side), 120.0)
    for _ in range(14):
        y, x = rng.integers(0, side - 30, 2)
        h, w = rng.integers(8, 40, 2)
        a[y : y + h, x : x + w] = rng.integers(20, 250)
    return a


def test_edited_copies_are_found_and_others_left_alone(spark):
    rows, want = [], {}
    for k in range(12):
        a = picture(k)
        edits = [a, a, a[10:, 7:], np.clip(a * 0.8 + 12, 0, 255), np.rot90(a), images._resized(a, 1.5), np.clip(a + np.random.default_rng(k).normal(0, 3, a.shape), 0, 255)]
        for j, e in enumerate(edits if k < 4 else edits[:1]):
            i = k * 10 + j
            e = np.ascontiguousarray(e).astype(np.uint8)
            rows.append((i, e.shape[1], e.shape[0], e.tobytes(), 0))
            want[i] = k * 10
    rows += [(900, 64, 64, bytes(64 * 64), 0), (901, 64, 64, bytes(64 * 64), 0), (902, None, None, None, 0), (903, 10, 10, b"short", 0)]
    want |= {900: 900, 901: 900, 902: 902, 903: 903}
    got = {r.image_id: r.component_id for r in images.image_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_drawn_vectors(spark):
    v = spark.createDataFrame([(1, [0.1] * 64), (2, [0.1] * 64), (3, [-0.4 + k / 50 for k in range(64)]), (4, None)], "vec_id long, embedding array<float>")
    got = {r.image_id: r.component_id for r in images.op8(v).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    assert images.op8(v.limit(0)).count() == 0


def test_components_are_those_of_all_pairs_of_a_bucket(spark, monkeypatch):
    """Against brute force over every pair that shares an entry, in one corner's bucket of many and in several blocks."""
    monkeypatch.setattr(images, "BLOCK", 4)
    rows, points = [], {}
    for k in range(24):  # a third shares a corner; copies of it stand far apart, with other images between them
        a = picture(k % 12)
        a = images._resized(a, 1.8) if k >= 12 else a
        if k % 3 == 0:
            a[:40, :40], a[8:30, 8:30] = 90, 200
        a = np.ascontiguousarray(a).astype(np.uint8)
        points[k] = images.keypoints(a)
        rows.append((k, a.shape[1], a.shape[0], a.tobytes(), 0))
    brute = {k: k for k in points}
    for _ in points:
        for x in points:
            for y in points:
                if brute[x] != brute[y] and images.agreeing(points[min(x, y)], points[max(x, y)]) >= images.MIN_AGREE:
                    brute[x] = brute[y] = min(brute[x], brute[y])
    got = {r.image_id: r.component_id for r in images.image_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute and len(set(got.values())) < 20


def test_pairs_of_unrelated_neighbours_do_not_hide_a_copy(spark):
    e = spark.createDataFrame([(k, i) for k in (1, 2) for i in (1, 2, 3, 4)], "key long, node long")
    assert {tuple(r) for r in images._all_pairs(e, None).collect()} == {(a, b) for a in range(1, 5) for b in range(a + 1, 5)}


def test_rows_by_picture_not_by_id(spark):
    """Null and shared ids: unlike pictures stay apart, equal ones meet; a repeated row, other columns and an empty table do no harm."""
    a, b = (np.ascontiguousarray(picture(k)).astype(np.uint8) for k in (1, 2))
    flat = bytes(16)
    rows = [(None, 128, 128, a.tobytes(), 0), (7, 128, 128, a.tobytes(), 0), (7, 128, 128, b.tobytes(), 0), (7, 128, 128, b.tobytes(), 0), (None, 4, 4, flat, 0), (9, 128, 128, b.tobytes(), 0), (3, None, 128, a.tobytes(), 0)]
    got = sorted(((r.image_id, r.component_id, r.n_keypoints > 0) for r in images.image_copies(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 7, True), (7, 7, True), (7, 7, True), (7, 7, True), (None, None, False), (9, 7, True), (3, 3, False)], key=str)


def test_large_pictures_in_bounded_stretches(monkeypatch):
    """agreeing() is the same when it holds a small part of the corners at a time."""
    a = images.keypoints(picture(3).astype(np.uint8))
    b = images.keypoints(np.ascontiguousarray(np.rot90(picture(3))).astype(np.uint8))
    x, y = (np.ascontiguousarray(k["bits"]).view("<u8") for k in (a, b))
    whole = images._nearest(x, y)
    big = images._nearest(np.tile(x, (400, 1)), np.tile(y, (60, 1)))
    assert (big[0][: len(x)] == whole[0]).all() and (big[1][: len(x)] == whole[1]).all()


def test_recall_on_drawn_pictures(spark, sf):
    """The operator against all pairs by agreeing(): copies of a table's pictures that were cropped, turned, scaled, shaded or blurred by noise."""
    rows = [(r.image_id, np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width)) for r in images.drawn(spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 70")).collect()]
    rng, pictures = np.random.default_rng(5), dict(rows)
    edits = (lambda a: a[12:100, 9:104], lambda a: np.rot90(a), lambda a: images._resized(a, 1.25), lambda a: images._resized(a, 1.5), lambda a: a * 0.7 + 25, lambda a: a + rng.normal(0, 10, a.shape))
    for k, (i, a) in enumerate(rows[:24]):
        pictures[1000 + i] = np.ascontiguousarray(np.clip(edits[k % 6](a.astype(float)), 0, 255)).astype(np.uint8)
    points = {i: images.keypoints(a) for i, a in pictures.items()}
    ids = sorted(points)
    links = [(i, j) for n, i in enumerate(ids) for j in ids[:n] if images.agreeing(points[j], points[i]) >= images.MIN_AGREE]
    df = spark.createDataFrame([(i, a.shape[1], a.shape[0], a.tobytes(), 0) for i, a in pictures.items()], SCHEMA)
    got = {r.image_id: r.component_id for r in images.image_copies(df).collect()}
    assert len(links) >= 24 and sum(got[i] == got[j] for i, j in links) >= 0.9 * len(links)
    together = [(i, j) for n, i in enumerate(ids) for j in ids[:n] if got[i] == got[j]]
    assert all(i == j + 1000 for i, j in together)  # nothing but the copies


def test_tables_reach_edited_copies(spark):
    """Recall of the tables of pairs of corners against brute force: of pairs that the verifier accepts nine in ten share a key at least, unlike pictures none."""
    met = accepted = 0
    originals = [images.keypoints(picture(k).astype(np.uint8)) for k in range(12)]
    for k in range(12):
        a = picture(k)
        for b in (a[30:, 25:], images._resized(a, 1.25), images._resized(a, 1.8), a + np.random.default_rng(k).normal(0, 15, a.shape)):
            y = images.keypoints(np.ascontiguousarray(np.clip(b, 0, 255)).astype(np.uint8))
            if images.agreeing(originals[k], y) >= images.MIN_AGREE:
                accepted += 1
                met += bool(common_pairs(originals[k], y))
    assert accepted > 20 and met >= 0.9 * accepted


def common_pairs(x, y):
    """Keys of pairs of corners that both have, of corners in company."""
    a, b = images.table_keys(x), images.table_keys(y)
    shared = np.intersect1d(a, b)

    def keys(k, points):
        i, w = np.nonzero(np.isin(k, shared))
        return set(images.pair_keys(w, k[i, w], points["x"][i].astype(float), points["y"][i].astype(float)).tolist())

    return keys(a, x) & keys(b, y)


def test_corners_that_met_different_pictures_form_no_pairs():
    """Own bits don't count; a picture in common in three sets of four is enough, in two it isn't."""
    table, key, at = np.zeros(3, np.int64), np.array([11, 22, 33]), np.array([0.0, 20.0, 40.0])
    low = images.others(np.array([0b0011, 0b0101, 0b0011]), 64, 0)  # bit 0 is the picture's own
    assert low.tolist() == [2, 4, 2]
    none = np.zeros(3, np.uint64)
    whole, some = images.pair_keys(table, key, at, at * 0), images.pair_keys(table, key, at, at * 0, (low, none, low, low))
    assert len(whole) == 3 and len(some) == 1 and not len(images.pair_keys(table, key, at, at * 0, (low, none, none, low)))
    assert some.tolist() == images.pair_keys(table[:2], key[[0, 2]], at[[0, 2]], at[:2] * 0).tolist()


def test_a_picture_met_by_several_tasks_is_one(spark):
    f = spark.createDataFrame([(1, 5, 1, b"x", 3), (2, 5, 1, b"x", 0), (3, 6, 1, b"y", 3), (4, 5, 1, None, 0), (5, None, 0, None, 1)], images.FEATURES)
    assert sorted(map(tuple, images._corners(f).collect())) == [(5, b"x"), (6, b"y")]


def test_only_buckets_with_open_pairs_go_on(spark):
    e = spark.createDataFrame([(1, 1, 1, 3), (1, 2, 1, 3), (1, 3, 1, 3), (2, 2, 2, 2), (2, 3, 2, 2), (3, 1, 1, 2), (3, 4, 1, 2)], "key long, node long, lo long, size long")
    assert {tuple(r) for r in images._to_first(e, None).collect()} == {(1, 2), (1, 3), (2, 3), (1, 4)}
    found = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    comp = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "node long, component long")
    assert {r.key for r in images._mixed(e, found, comp).collect()} == {3}
    assert images._mixed(e, found.limit(0), None).count() == e.count()


def test_mixed_buckets(spark):
    """Buckets go on when their pictures are of several components, told without a row for each pair of pictures."""
    entries = [(k, n) for k, nodes in enumerate([(1, 2, 3), (1, 4), (2, 3), (5, 6), (3, 9, 8), (7, 8)]) for n in nodes]
    low = {k: min(n for j, n in entries if j == k) for k, _ in entries}
    size = {k: sum(j == k for j, _ in entries) for k, _ in entries}
    comp = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    table = spark.createDataFrame([(k, n, low[k], size[k]) for k, n in entries], "key long, node long, lo long, size long")
    got = images._mixed(table, spark.createDataFrame(list(comp.items()), "node long, component long"))
    assert sorted((r.key, r.node, r.lo, r.size) for r in got.collect()) == sorted((k, n, low[k], size[k]) for k, n in entries if k in (1, 3, 4))
    assert images._mixed(table, None).count() == len(entries)


def test_a_group_of_near_copies_makes_few_pairs_of_corners(spark, monkeypatch):
    """Near copies are joined by the single corners they share; they don't form all their pairs of corners as well."""
    made, real = {}, images.materialize

    def counted(df, name, *more):
        out = real(df, name, *more)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(images, "materialize", counted)
    rows, want, rng = [], {}, np.random.default_rng(4)
    for i in range(44):  # 40 near copies of one picture, and others
        a = np.clip(picture(1) + rng.normal(0, 2, (128, 128)), 0, 255) if i < 40 else picture(i)
        rows.append((i, 128, 128, a.astype(np.uint8).tobytes(), 0))
        want[i] = 0 if i < 40 else i
    got = {r.image_id: r.component_id for r in images.image_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want
    assert made["image-pairs-of-corners"] < 200


def test_corners_pair_for_other_components_only(spark):
    at = {11: 0.0, 22: 30.0}
    singles = spark.createDataFrame([(k, n, 0, x, 0.0, 64, 3) for k, x in at.items() for n in (64, 128, 192)], "key long, node long, table int, x float, y float, lo long, size long")

    def nodes(*joined):
        comp = spark.createDataFrame([(n, min(joined)) for n in joined], "node long, component long") if joined else None
        return sorted((r.node, r.lo, r.size) for r in images.shared_entries(singles, comp).collect())

    assert nodes() == nodes(64, 128) == nodes(128, 192) == [(64, 64, 3), (128, 64, 3), (192, 64, 3)]
    assert nodes(64, 128, 192) == []


def test_a_bucket_of_two_components_is_told_exactly():
    """Components 64 and 128 have one bit in set 0; as the bucket's ends they are told apart all the same."""
    seen, least, most = (np.array([v]) for v in (1, 64, 128))
    assert images.others(seen, 64, 0).tolist() == [0]
    assert images.company(seen, least, most, 64, 0).tolist() == images.company(seen, least, most, 128, 0).tolist() == [1]
    assert images.company(seen, least, least, 64, 0).tolist() == [0]


def test_most_alike_of_what_is_neither_tested_nor_joined(spark):
    alike = spark.createDataFrame([(1, 5, 9), (2, 5, 4), (3, 5, 4), (1, 6, 3), (2, 7, 8)], "a long, b long, n long")
    tested = spark.createDataFrame([(1, 5)], "a long, b long")
    comp = spark.createDataFrame([(2, 2), (7, 2)], "node long, component long")
    pairs = lambda *of: {tuple(r) for r in images._most_alike(alike, *of).collect()}
    assert pairs(None, None) == {(1, 5), (1, 6), (2, 7)} and pairs(tested, comp) == {(2, 5), (1, 6)}
    singles = spark.createDataFrame([(k, n, 1, 3) for k in range(images.ALIKE) for n in (1, 2, 2)] + [(9, 1, 1, 2), (9, 3, 1, 2)], "key long, node long, lo long, size long")
    assert [tuple(r) for r in images._alike(singles).collect()] == [(1, 2, images.ALIKE)]

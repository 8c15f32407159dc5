"""Local image descriptors: find copies of images that were cropped, scaled, turned or recoloured.

Corners at several scales get an orientation (intensity centroid) and a 256-bit descriptor of binary tests turned by it.
Descriptors meet in hash tables keyed by one of their 64-bit words. Pictures that share several corners are verified first
(mutual nearest descriptors under one similarity transform), and verified pairs make components. Corners that may have met
the same picture of another component then form pairs with those beside them, which meet in tables again: unlike pictures now
and then share a corner, but hardly two that stand together. Pictures that share such a pair are verified likewise, unless
they are joined already.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.keyed import join_by_key
from corpuslens.llm.shingle_join import mix
from corpuslens.operators.graph import connected_components
from corpuslens.session import discard, materialize

SCALES, PATCH, TESTS = (1.0, 1.25, 1.5, 1.875, 2.25), 12, 256
#: A corner is the strongest place within so many pixels, and has this share of the strongest one's response.
APART, STRENGTH = 5, 0.02
#: Most differing bits of matched descriptors; what a match may be off (pixels, radians, log scale); matches that agree on one transform.
MAX_BITS, MAX_OFF, MAX_TURN, MAX_GROWTH, MIN_AGREE = 48, 4.0, 0.3, 0.5, 6
#: Pairs of corners that stand for a picture: at least so many pixels apart, one among so many nearest of the other.
FAR, NEIGHBOURS = 8.0, 6
#: Entries that a picture shares with a first picture to be held against it before corners pair. All others meet by pairs of corners.
ALIKE = 3
#: Sets of 64 bits by which a bucket tells its components, and how many must have one in common before two corners pair.
SETS, COMMON = 4, 3
#: Images of a bucket that one task holds against as many others.
BLOCK = 256
_rng = np.random.default_rng(7)
_PAIRS = np.clip(_rng.normal(0, PATCH / 2.5, (TESTS, 4)), -PATCH + 1, PATCH - 1)
_DISC = np.array([(y, x) for y in range(-7, 8) for x in range(-7, 8) if x * x + y * y <= 49])
_PLACE = np.uint64(0x9E3779B97F4A7C15)
KEYPOINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("scale", "<f4"), ("angle", "<f4"), ("bits", "u1", (TESTS // 8,))])


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2r+1) squared pixels, edges repeated."""
    p = np.pad(a, ((r + 1, r), (r + 1, r)), mode="edge").cumsum(0).cumsum(1)
    k = 2 * r + 1
    return (p[k:, k:] - p[:-k, k:] - p[k:, :-k] + p[:-k, :-k]) / (k * k)


def _resized(a: np.ndarray, by: float) -> np.ndarray:
    """a, smaller by this factor, by linear interpolation."""
    if by == 1:
        return a
    h, w = int(a.shape[0] / by), int(a.shape[1] / by)
    y, x = np.minimum(np.arange(h) * by, a.shape[0] - 1.001), np.minimum(np.arange(w) * by, a.shape[1] - 1.001)
    i, j = y.astype(int), x.astype(int)
    u, v = (y - i)[:, None], (x - j)[None, :]
    return (a[i][:, j] * (1 - v) + a[i][:, j + 1] * v) * (1 - u) + (a[i + 1][:, j] * (1 - v) + a[i + 1][:, j + 1] * v) * u


def _highest(a: np.ndarray, r: int) -> np.ndarray:
    """Maximum over (2r+1) squared places."""
    a = np.pad(a, r, constant_values=-np.inf)
    for axis in (0, 1):
        n = a.shape[axis] - 2 * r
        a = np.max([a.take(range(i, i + n), axis) for i in range(2 * r + 1)], axis=0)
    return a


def keypoints(pixels: np.ndarray) -> np.ndarray:
    """All corners of a grey image (rows of 0..255) with their descriptors; none for flat or very small images."""
    found = []
    for scale in SCALES:
        a = _box(_resized(pixels.astype(np.float64), scale), 1)
        if min(a.shape) <= 2 * PATCH + 4:
            continue
        gy, gx = np.gradient(a)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        m = PATCH + 2
        c = r[m:-m, m:-m]
        ys, xs = np.nonzero((c >= _highest(r, APART)[m:-m, m:-m]) & (c > max(1.0, STRENGTH * float(r.max()))))
        if not len(ys):
            continue
        ys, xs = ys + m, xs + m
        disc = a[ys[:, None] + _DISC[:, 0], xs[:, None] + _DISC[:, 1]]
        angle = np.arctan2((disc * _DISC[:, 0]).sum(1), (disc * _DISC[:, 1]).sum(1))
        s = _box(a, 2)
        cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]

        def at(px, py, s=s, xs=xs, ys=ys, cos=cos, sin=sin):
            x = np.clip(np.rint(xs[:, None] + px * cos - py * sin), 0, s.shape[1] - 1).astype(int)
            y = np.clip(np.rint(ys[:, None] + px * sin + py * cos), 0, s.shape[0] - 1).astype(int)
            return s[y, x]

        k = np.zeros(len(ys), KEYPOINT)
        k["x"], k["y"], k["scale"], k["angle"] = xs * scale, ys * scale, scale, angle
        k["bits"] = np.packbits(at(_PAIRS[:, 0], _PAIRS[:, 1]) < at(_PAIRS[:, 2], _PAIRS[:, 3]), axis=1)
        found.append(k)
    return np.concatenate(found) if found else np.zeros(0, KEYPOINT)


def table_keys(k: np.ndarray) -> np.ndarray:
    """(corners x tables): keys of the Hamming tables, one for each 64-bit word of a descriptor; matches need 64 equal bits of 256 in one word."""
    words = np.ascontiguousarray(k["bits"]).view("<u8")
    return mix(words ^ (np.arange(1, words.shape[1] + 1, dtype=np.uint64) * _PLACE)).view(np.int64)


def _nearest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each descriptor of x the first nearest of y and its distance; a bounded stretch of x at a time."""
    step = max(1, 4_000_000 // max(1, len(y)))
    near = [np.bitwise_count(x[i : i + step, None] ^ y[None]).sum(2, dtype=np.int32) for i in range(0, len(x), step)] if len(x) * len(y) <= 4_000_000 else None
    if near is not None:
        d = near[0] if len(near) == 1 else np.concatenate(near)
        j = d.argmin(1)
        return j, d[np.arange(len(x)), j]
    at, best = np.zeros(len(x), np.int64), np.zeros(len(x), np.int32)
    for i in range(0, len(x), step):
        d = np.bitwise_count(x[i : i + step, None] ^ y[None]).sum(2, dtype=np.int32)
        at[i : i + step] = d.argmin(1)
        best[i : i + step] = d.min(1)
    return at, best


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """Matches of two images' corners that agree on one similarity transform: the most over transforms that single matches give."""
    if not len(a) or not len(b):
        return 0
    x, y = (np.ascontiguousarray(k["bits"]).view("<u8") for k in (a, b))
    j, d = _nearest(x, y)
    back, _ = _nearest(y, x)
    i = np.flatnonzero((back[j] == np.arange(len(a))) & (d <= MAX_BITS))
    if len(i) < MIN_AGREE:
        return 0
    p, q = a[i], b[j[i]]
    turn, grow = (q["angle"] - p["angle"]).astype(np.float64), np.log(q["scale"] / p["scale"]).astype(np.float64)
    z, w = p["x"] + 1j * p["y"], q["x"] + 1j * q["y"]
    f, best = np.exp(grow + 1j * turn), 0
    for k in range(0, len(i), 512):
        s = slice(k, k + 512)
        off = np.abs((w[s, None] + f[s, None] * (z[None] - z[s, None])) - w[None])
        turned = np.abs((turn[s, None] - turn[None] + np.pi) % (2 * np.pi) - np.pi)
        best = max(best, int(((off <= MAX_OFF) & (turned <= MAX_TURN) & (np.abs(grow[s, None] - grow[None]) <= MAX_GROWTH)).sum(1).max()))
    return best


FEATURES = "image_id long, node long, n_keypoints long, points binary, part int"


def features(images: DataFrame) -> DataFrame:
    """FEATURES of images(image_id, width, height, pixels); node is 64 bits of the picture's digest.

    Unreadable or null pictures have neither node nor corners. A task gives the corners of equal pictures once; part is its number.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen: set[int] = set()
        for b in batches:
            for r in range(0, b.num_rows, 64):
                out = []
                for i, w, h, px in zip(*(c.to_pylist() for c in b.slice(r, 64).columns)):
                    node, n, points = None, 0, None
                    if px is not None and w and h and len(px) == w * h:
                        k = keypoints(np.frombuffer(px, np.uint8).reshape(h, w))
                        node, n = int.from_bytes(hashlib.blake2b(b"%d:" % w + px, digest_size=8).digest(), "little", signed=True), len(k)
                        points = None if node in seen or not n else k.tobytes()
                        seen.add(node)
                    out.append((i, node, n, points, part))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["image_id", "node", "n_keypoints", "points", "part"])

    return images.select(F.col("image_id").cast("long"), F.col("width").cast("int"), F.col("height").cast("int"), F.col("pixels").cast("binary")).mapInArrow(run, FEATURES)


def _corners(f: DataFrame) -> DataFrame:
    """(node, points) of features: one row a picture that has corners, however many tasks have met it."""
    rows = f.where("points is not null").select("node", "points", "part")
    again = rows.groupBy("node").agg(F.min("part").alias("first"), F.count("*").alias("n")).where("n > 1").select("node", "first")
    return rows.join(again, "node", "left").where("first is null or part = first").select("node", "points")


def _in_company(entries: DataFrame, by: str = "node", **values) -> DataFrame:
    """entries(key, by, ...) whose bucket holds another picture (or component) too, with values aggregated over the bucket; a bucket that very many pictures are in is many tasks."""
    buckets = entries.groupBy("key").agg(F.min(by).alias("c1"), F.max(by).alias("c2"), F.count("*").alias("n"), *(c.alias(k) for k, c in values.items()))
    buckets = materialize(buckets.where("c1 <> c2").select("key", "n", *values), "image-buckets")
    return join_by_key(entries, buckets, ["key"])


def others(seen: np.ndarray, node: int, of: int) -> np.ndarray:
    """The of-th bit sets of the components of buckets (one's bit is told by six bits of its number) without this own one's bit."""
    return seen.view(np.uint64) & ~(np.uint64(1) << np.uint64((node >> 6 * of) & 63))


def company(seen: np.ndarray, least: np.ndarray, most: np.ndarray, c: int, of: int) -> np.ndarray:
    """others(), with the bits of the buckets' least and greatest components put back where those are others: a bucket of two components is told exactly."""
    out = others(seen, c, of)
    for ends in (least, most):
        bit = np.uint64(1) << ((ends.view(np.uint64) >> np.uint64(6 * of)) & np.uint64(63))
        out = out | np.where(ends != c, bit, np.uint64(0))
    return out


def pair_keys(table: np.ndarray, key: np.ndarray, x: np.ndarray, y: np.ndarray, met: tuple[np.ndarray, ...] = ()) -> np.ndarray:
    """Keys of pairs of a picture's corners: both keys of one table, of corners FAR apart or more, of which one is among the other's NEIGHBOURS nearest in it.

    met has SETS bit sets of the other components that each corner meets. With it only corners pair that have a bit in common in
    COMMON of them. That leaves out corners that can't both be in another component, and such as are in one that has the
    own component's bit in two sets of four (1 of 680) and is neither the least nor the greatest of a bucket.
    """
    out = [np.zeros(0, np.uint64)]
    for w in np.unique(table):
        at = np.flatnonzero(table == w)
        z, k = (x[at] + 1j * y[at]).astype(np.complex64), key[at].view(np.uint64)
        for s in range(0, len(at), 1024):
            d = np.abs(z[s : s + 1024, None] - z[None])
            d[d < FAR] = np.inf
            if met:
                d[sum(((m[at][s : s + 1024, None] & m[at][None]) != 0).astype(np.int8) for m in met) < COMMON] = np.inf
            near = np.argsort(d, axis=1, kind="stable")[:, :NEIGHBOURS]
            p, q = np.repeat(k[s : s + 1024], near.shape[1]), k[near.ravel()]
            ok = np.isfinite(np.take_along_axis(d, near, 1).ravel()) & (p != q)
            p, q = p[ok], q[ok]
            out.append(mix(mix(np.minimum(p, q)) + np.maximum(p, q) + np.uint64(int(w) * int(_PLACE) % (1 << 64))))
    return np.unique(np.concatenate(out)).view(np.int64)


def single_entries(corners: DataFrame) -> DataFrame:
    """(key, node, table, x, y, lo, size): entries of single corners that another picture has too, one table for each word of a descriptor, with the first picture that has them and how many entries there are."""

    def single(batches):
        import pyarrow as pa

        for b in batches:
            for r in range(0, b.num_rows, 256):
                part = b.slice(r, 256)
                points = [np.frombuffer(p.as_py(), KEYPOINT) for p in part.column(1)]
                keys = [table_keys(k) for k in points]
                tables = keys[0].shape[1]
                n = [len(k) for k in keys]
                cols = [np.concatenate([k.ravel() for k in keys]), np.repeat(np.array(part.column(0).to_pylist(), np.int64), [k.size for k in keys]), np.tile(np.arange(tables, dtype=np.int32), sum(n))]
                cols += [np.repeat(np.concatenate([k[c] for k in points]), tables) for c in "xy"]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "node", "table", "x", "y"])

    e = corners.mapInArrow(single, "key long, node long, table int, x float, y float")
    return _in_company(e, lo=F.min("node"), size=F.count("*"))


def _of_component(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    """rows(node, ...) with c, the node's component found so far."""
    return rows.withColumn("c", F.col("node")) if comp is None else rows.join(comp, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")


def shared_entries(singles: DataFrame, comp: DataFrame | None = None) -> DataFrame:
    """(key, node, lo, size): keys of pairs of corners that a picture of another component has too, the first picture that has them and how many have.

    A bucket of single corners tells its components by sets of 64 bits. Only corners that meet another component form pairs,
    with such as may meet the same one.
    """

    def double(batches):
        import pyarrow as pa

        for b in batches:
            keys, nodes, comps = [], b.column(0).to_pylist(), b.column(1).to_pylist()
            for own, corners in zip(comps, b.column(2).to_pylist()):
                table, key, least, most, *met = (np.array([e[c] for e in corners], np.int64) for c in ("table", "key", "least", "most", *names))
                x, y = (np.array([e[c] for e in corners], np.float64) for c in "xy")
                keys.append(pair_keys(table, key, x, y, tuple(company(m, least, most, own, of) for of, m in enumerate(met))))
            node, c = (np.repeat(np.array(v, np.int64), [len(k) for k in keys]) for v in (nodes, comps))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *keys])), pa.array(node, pa.int64()), pa.array(c, pa.int64())], names=["key", "node", "c"])

    names = [f"met{of}" for of in range(SETS)]
    bits = {m: F.expr(f"bit_or(shiftleft(1L, cast(shiftright(c, {6 * of}) & 63 as int)))") for of, m in enumerate(names)}
    e = _in_company(_of_component(singles.select("key", "node", "table", "x", "y"), comp), by="c", least=F.min("c"), most=F.max("c"), **bits)
    per = e.groupBy("node", "c").agg(F.collect_list(F.struct("table", "key", "x", "y", "least", "most", *names)).alias("corners"))  # a picture's corners
    pairs = materialize(per.mapInArrow(double, "key long, node long, c long"), "image-pairs-of-corners")
    return _in_company(pairs, by="c", lo=F.min("node"), size=F.count("*")).select("key", "node", "lo", "size")


def _verified(pairs: DataFrame, corners: DataFrame) -> DataFrame:
    """The pairs (a, b) whose corners agree. Corners are fetched for what is to be verified only, first those of b, then those of a."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            of = {}
            out = []
            for a, b, x, y in zip(*(batch.column(c) for c in range(4))):
                a, b = a.as_py(), b.as_py()
                if a not in of:
                    of = {a: np.frombuffer(x.as_py(), KEYPOINT)}
                if agreeing(of[a], np.frombuffer(y.as_py(), KEYPOINT)) >= MIN_AGREE:
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    points = materialize(corners.join(wanted, "node"), "image-corners")
    both = pairs.join(points.select(F.col("node").alias("b"), F.col("points").alias("y")), "b").join(points.select(F.col("node").alias("a"), F.col("points").alias("x")), "a")
    found = materialize(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct(), "image-links")
    discard(points)
    return found


def _alike(singles: DataFrame) -> DataFrame:
    """(a, b, n): first pictures of buckets of single corners and others that share n of their entries, ALIKE or more."""
    shared = singles.where("node <> lo").select("key", F.col("lo").alias("a"), F.col("node").alias("b")).distinct()
    return shared.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= ALIKE)


def _apart(pairs: DataFrame, comp: DataFrame | None) -> DataFrame:
    """pairs(a, b, ...) that aren't joined yet."""
    if comp is None:
        return pairs
    of = [comp.select(F.col("node").alias(c), F.col("component").alias("c" + c)) for c in "ab"]
    return pairs.join(of[0], "a", "left").join(of[1], "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select(*pairs.columns)


def _most_alike(alike: DataFrame, tested: DataFrame | None, comp: DataFrame | None) -> DataFrame:
    """Pairs (a, b) of alike that are neither joined nor tested: for each b the a that it shares most entries with, the least of such."""
    rest = _apart(alike, comp)
    rest = rest if tested is None else rest.join(tested, ["a", "b"], "left_anti")
    return rest.groupBy("b").agg(F.min(F.struct((-F.col("n")).alias("n"), "a")).alias("best")).select("best.a", "b")


def _to_first(entries: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Pairs of each bucket's first picture with the others; with one picture for each component found so far."""
    if comp is None:
        return entries.where("node <> lo").select(F.col("lo").alias("a"), F.col("node").alias("b")).distinct()
    e = entries.join(comp, "node", "left").groupBy("key", F.coalesce("component", "node").alias("c")).agg(F.min("node").alias("node"), F.min("lo").alias("lo"))
    return e.where("node <> lo").select(F.col("lo").alias("a"), F.col("node").alias("b")).distinct()


def _mixed(entries: DataFrame, *joined: DataFrame | None) -> DataFrame:
    """The entries of buckets whose pictures aren't all joined yet, told by the least and the greatest component of each bucket. joined ends with the components; links may stand before them."""
    comp = joined[-1]
    if comp is None:
        return entries
    of = entries.join(comp, "node", "left").select("key", "size", F.coalesce("component", "node").alias("c"))
    keys = of.groupBy("key").agg(F.max("size").alias("n"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select("key", "n")
    return materialize(join_by_key(entries, materialize(keys, "image-mixed-keys"), ["key"]), "image-mixed-tables")


def _all_pairs(entries: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Pairs (a, b) that share buckets and aren't joined yet; large buckets are split into pairs of blocks."""
    e = entries.select("key", "node")
    e = e.withColumn("c", F.col("node")) if comp is None else e.join(comp, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    mixed = e.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).alias("nb")).where("c1 <> c2")
    mixed = materialize(mixed.select("key", "n", "nb"), "image-mixed")
    e = materialize(join_by_key(e, mixed, ["key"]).withColumn("me", F.pmod(F.xxhash64("node"), "nb")), "image-open")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))
    x = e.select("key", F.col("node").alias("a"), F.col("c").alias("ca"), F.col("me").alias("bi"), other.alias("bj"))
    y = e.select("key", F.col("node").alias("b"), F.col("c").alias("cb"), other.alias("bi"), F.col("me").alias("bj"))
    return x.join(y, ["key", "bi", "bj"]).where("a < b and ca <> cb").select("a", "b").distinct()


def image_copies(images: DataFrame) -> DataFrame:
    """(image_id, n_keypoints, component_id) per row of images(image_id, width, height, pixels in grey bytes).

    component_id is the smallest image_id reachable over verified pairs of pictures that share a pair of corners (pair_keys());
    identical pixels are one picture from the start, whatever their ids, and unlike pictures that share an id are pictures
    of their own. First every picture is held against the one that it shares most single corners with, of the first pictures of
    their entries, round by round until no new pair agrees: large groups of copies are joined by few tests, and only corners that
    are in two components or more form pairs. Then every picture is held against the least of its buckets' first pictures, and
    buckets whose pictures are all joined by that are done. In the others the first picture is held against the rest, round by
    round with one picture for each component found so far, until no new pair agrees. Then all pairs that share buckets and aren't joined are tested, which grows with the
    square of the different pictures that share one pair of corners. An empty table gives an empty one. Pictures without
    corners match their identical copies only; null or unreadable pixels match nothing and keep their own id; a row with a
    null id takes the least id of its component, if there is one. Other columns are ignored.
    """
    f = materialize(features(images), "image-features")
    corners = _corners(f)
    used: list[DataFrame] = []
    tested = found = comp = None

    def kept(df: DataFrame, name: str) -> DataFrame:
        used.append(materialize(df, name))
        return used[-1]

    def agree(pairs: DataFrame) -> bool:
        """Verify the pairs that weren't tested yet; whether any agree, which are then joined."""
        nonlocal tested, found, comp
        pairs = kept(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "image-pairs")
        if pairs.isEmpty():
            return False
        tested = pairs if tested is None else tested.unionByName(pairs)
        new = _verified(pairs, corners)
        used.append(new)
        if new.isEmpty():
            return False
        found = new if found is None else found.unionByName(new)
        comp = kept(connected_components(found, "a", "b"), "image-components")
        return True

    singles = kept(single_entries(corners), "image-single")
    alike = kept(_alike(singles), "image-alike")
    while agree(_most_alike(alike, tested, comp)):
        pass
    entries = kept(shared_entries(singles, comp), "image-tables")
    agree(_apart(entries.where("node <> lo").select(F.col("lo").alias("a"), F.col("node").alias("b")), comp).groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    entries = _mixed(entries, comp)
    used.append(entries)
    while agree(_to_first(entries, comp)):
        pass
    agree(_all_pairs(entries, comp))
    ids = f.where("node is not null").groupBy("node").agg(F.min("image_id").alias("least"))
    if comp is not None:
        ids = ids.join(comp, "node", "left").withColumn("c", F.coalesce("component", "node"))
        low = materialize(ids.groupBy("c").agg(F.min("least").alias("component_id")), "image-lowest")
        ids = ids.join(low, "c").select("node", "component_id")
    else:
        ids = ids.withColumnRenamed("least", "component_id")
    named = materialize(ids, "image-classes")
    discard(*used)
    return f.join(named, "node", "left").select("image_id", "n_keypoints", F.coalesce("component_id", "image_id").alias("component_id"))


def drawn(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", side: int = 112) -> DataFrame:
    """Pictures drawn from vectors, one each: a texture of plane waves whose amplitudes are the components.

    Near vectors give pictures that look alike and unrelated ones pictures that don't, with corners as different from each
    other as those of photographs. Null vectors and those without length give null pixels; null components count as 0.
    """

    def run(batches):
        import pyarrow as pa

        waves = {}
        for b in batches:
            for r in range(0, b.num_rows, 256):
                part = b.slice(r, 256)
                out = []
                for v in part.column(1).to_pylist():
                    v = np.nan_to_num(np.array([x or 0.0 for x in v or ()], np.float64), posinf=0.0, neginf=0.0)
                    if not v.any():
                        out.append(None)
                        continue
                    if len(v) not in waves:
                        waves[len(v)] = _waves(len(v), side)
                    a = v / np.abs(v).max() @ waves[len(v)]
                    out.append(np.clip(np.rint(128 + 48 * a / max(a.std(), 1e-9)), 0, 255).astype(np.uint8).tobytes())
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([side] * n, pa.int32()), pa.array([side] * n, pa.int32()), pa.array(out, pa.binary())], names=["image_id", "width", "height", "pixels"])

    return vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "image_id long, width int, height int, pixels binary")


def _waves(n: int, side: int) -> np.ndarray:
    """n plane waves over side x side pixels, of 5 to 40 pixels length in any direction."""
    rng = np.random.default_rng(11)
    k = 2 * np.pi / np.exp(rng.uniform(np.log(5), np.log(40), n))
    turn, phase = rng.uniform(0, 2 * np.pi, n), rng.uniform(0, 2 * np.pi, n)
    y, x = np.mgrid[:side, :side]
    return np.cos(k[:, None] * (np.cos(turn)[:, None] * x.ravel() + np.sin(turn)[:, None] * y.ravel()) + phase[:, None])


def op8(vectors: DataFrame) -> DataFrame:
    return image_copies(drawn(vectors))

"""Meshes, nets and simulation traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.operators.graph import connected_components
from corpuslens.session import ensure_on_workers, materialize

CORNERS = ("a", "b", "c")
#: Triangles that a task draws together at a time, and of the largest mesh that is taken as one (about 100 MB).
MESH_ROWS = 400_000
#: Triangles for each task that meshes are dealt to (about).
MESH_TASK = 1_000_000


def mesh_stats(triangles: DataFrame) -> DataFrame:
    """(mesh_id, triangles, area, volume, bounds): surface area and absolute signed volume."""
    v = {f"{p}{q}": F.col(f"{p}{q}").cast("double") for p in CORNERS for q in "xyz"}
    u, w = {q: v[f"b{q}"] - v[f"a{q}"] for q in "xyz"}, {q: v[f"c{q}"] - v[f"a{q}"] for q in "xyz"}
    n = (u["y"] * w["z"] - u["z"] * w["y"], u["z"] * w["x"] - u["x"] * w["z"], u["x"] * w["y"] - u["y"] * w["x"])
    area = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2
    vol = (v["ax"] * (v["by"] * v["cz"] - v["bz"] * v["cy"]) + v["ay"] * (v["bz"] * v["cx"] - v["bx"] * v["cz"]) + v["az"] * (v["bx"] * v["cy"] - v["by"] * v["cx"])) / 6
    box = [f(g(*(v[f"{p}{q}"] for p in CORNERS))).alias(f"{k}_{q}") for q in "xyz" for k, f, g in (("min", F.min, F.least), ("max", F.max, F.greatest))]
    return triangles.groupBy("mesh_id").agg(F.count("*").alias("triangles"), F.sum(area).alias("area"), F.abs(F.sum(vol)).alias("volume"), *box)


def _roots(n: int, left, right):
    """The smallest node reachable from each of n nodes by the links left[i] - right[i]: larger roots are hung under smaller ones until none is linked with another."""
    import numpy as np

    root = np.arange(n)
    while True:
        a, b = root[left], root[right]
        open_ = a != b
        if not open_.any():
            return root
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root = up


def _stars(rows: DataFrame, nodes: tuple[str, ...], whole: bool) -> DataFrame:
    """rows(mesh_id, n, first, nodes...), each of which links its nodes, as stars (mesh_id, n, first, v, u, w) of what a task has at a time.

    Two nodes u and w hang under the smallest node v of their star (or v itself, where there are none left); a star's sum
    of n and least first stand in its first row, other rows have an n of 0.
    whole: rows of a mesh come one after the other, by column m, and are taken together; then only first rows are given.
    """
    most = MESH_ROWS

    def chunks(batches):
        import numpy as np
        import pyarrow as pa

        held, size, enough = [], 0, most
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < enough:
                continue
            t, cut = pa.Table.from_batches(held), size
            if whole:
                m = t["m"].to_numpy()
                cut = int(np.searchsorted(m, m[-1]))  # the last mesh may go on
            if cut:
                yield t.slice(0, cut)
            held, size = t.slice(cut).to_batches(), size - cut
            enough = max(most, 2 * size)
        if size:
            yield pa.Table.from_batches(held)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for t in chunks(batches):
            k = len(t)
            node, at, of = np.unique(np.concatenate([t[c].to_numpy() for c in nodes]), return_index=True, return_inverse=True)
            one, others = of[:k], of[k:]
            root = _roots(len(node), np.tile(one, len(nodes) - 1), others)
            n, first = np.zeros(len(node), np.int64), np.full(len(node), np.iinfo(np.int64).max)
            np.add.at(n, root[one], t["n"].to_numpy())
            np.minimum.at(first, root[one], t["first"].to_numpy())
            order = np.append(np.argsort(root, kind="stable"), 0)  # star by star, the smallest first
            start = np.append(root[order[:-1]] == order[:-1], True)
            rank = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
            given = np.flatnonzero(start[:-1] if whole else (rank[:-1] % 2 == 1) | start[:-1] & start[1:])
            u, v = order[given], root[order[given]]
            w, n = np.where(start[given + 1], v, order[given + 1]), np.where(rank[given] < 2, n[v], 0)
            mesh = t["mesh_id"].combine_chunks().take(pa.array(at[v] % k))
            for x in (mesh.chunks if isinstance(mesh, pa.ChunkedArray) else [mesh]):
                yield pa.RecordBatch.from_arrays([x, *map(pa.array, (n, first[v], node[v], node[u], node[w]))], names=["mesh_id", "n", "first", "v", "u", "w"])

    return rows.mapInArrow(run, f"mesh_id {rows.schema['mesh_id'].dataType.simpleString()}, n long, first long, v long, u long, w long")


def mesh_bodies(triangles: DataFrame, step: float = 1e-5) -> DataFrame:
    """(mesh_id, body, triangles) largest first: triangles (numbered by tri, an integer) that share a vertex once vertices are rounded to `step`.

    Vertices are nodes of one graph. Each task first draws its triangles together to stars, so a vertex leaves it once for
    MESH_ROWS triangles. The stars of a mesh of at most so many triangles meet in one task, which gives its bodies;
    those of larger meshes go to the iterated edge job, so a mesh of any size is spread over all tasks.
    """
    spark = triangles.sparkSession
    ensure_on_workers(spark)
    key = lambda p: F.xxhash64("mesh_id", *(F.floor(F.col(f"{p}{q}") / step + 0.5) for q in "xyz"))
    t = triangles.select("mesh_id", F.lit(1).cast("long").alias("n"), F.coalesce(F.col("tri").cast("long"), F.lit(2**63 - 1)).alias("first"), *(key(p).alias(p) for p in CORNERS))
    large = materialize(triangles.groupBy("mesh_id").agg(F.count("*").alias("n")).where(F.col("n") > MESH_ROWS).select(F.col("mesh_id").alias("large")), "large-meshes")
    some = not large.isEmpty()
    is_large = F.col("mesh_id").eqNullSafe(F.col("large"))
    stars = _stars(t.join(F.broadcast(large), is_large, "left_anti") if some else t, CORNERS, False)
    parts = -(-triangles.count() // MESH_TASK)  # so that tasks sort in memory
    dealt = [parts] if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else []
    met = stars.repartition(*dealt, "mesh_id").withColumn("m", F.xxhash64("mesh_id")).sortWithinPartitions("m")
    per = _stars(met, ("v", "u", "w"), True).select("mesh_id", "n", "first")
    if some:
        many = materialize(_stars(t.join(F.broadcast(large), is_large, "left_semi"), CORNERS, False), "mesh-stars")
        comps = connected_components(many.select("v", F.explode(F.array("u", "w")).alias("u")), "u", "v")
        weighed = many.where("n > 0").join(comps, F.col("v") == F.col("node"), "left").groupBy("mesh_id", F.coalesce("component", "v").alias("component"))
        per = per.unionByName(weighed.agg(F.sum("n").alias("n"), F.min("first").alias("first")).select("mesh_id", "n", "first"))
    place = F.row_number().over(W.partitionBy("mesh_id").orderBy(F.desc("n"), "first"))
    return per.select("mesh_id", place.alias("body"), F.col("n").alias("triangles"))


def graph_bodies(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(component, nodes) of a bipartite edge table whose two sides have their own number ranges; right numbers are told apart by sign."""
    comps = connected_components(edges.select(F.col(left).alias("a"), (-F.col(right) - 1).alias("b")), "a", "b")
    return comps.groupBy("component").agg(F.count("*").alias("nodes"))


def summarise_nets(points: DataFrame) -> DataFrame:
    """(board, points, nets, components, pins, bounds) of net points; 0, N/C and no net don't count as nets."""
    net = F.when(~F.upper(F.coalesce("net", F.lit(""))).isin("0", "N/C", ""), F.col("net"))
    return points.groupBy("board").agg(F.count("*").alias("points"), F.count_distinct(net).alias("nets"), F.count_distinct("ref").alias("components"), F.count_distinct(F.when(F.col("ref").isNotNull(), F.struct("ref", "pin"))).alias("pins"), *(f(c).alias(f"{k}_{c}") for c in ("x", "y") for k, f in (("min", F.min), ("max", F.max))))


def natural_order(df: DataFrame, col: str) -> DataFrame:
    """Rows with R2 before R10: by letters, then number, then the rest."""
    return df.orderBy(F.regexp_extract(col, r"^(\D*)", 1), F.regexp_extract(col, r"^\D*(\d+)", 1).try_cast("long"), col)


def bom_crossref(instances: DataFrame, placements: DataFrame) -> DataFrame:
    """(ref, value, on_board): parts of a schematic that belong in the bill of materials, in natural order, and whether the board has them."""
    parts = instances.where(~F.col("ref").startswith("#") & F.coalesce("in_bom", F.lit(True))).select("ref", "value").distinct()
    board = placements.select("ref").distinct().withColumn("_on", F.lit(True))
    return natural_order(parts.join(board, "ref", "left").select("ref", "value", F.coalesce("_on", F.lit(False)).alias("on_board")), "ref")


def summarise_traces(samples: DataFrame) -> DataFrame:
    """(file, var, points, first, last, operating_point) of samples(file, var, idx, re, im): magnitudes; one point is an operating point."""
    m = F.hypot("re", F.coalesce("im", F.lit(0.0)))
    v = F.when(F.col("im").isNull(), F.col("re")).otherwise(m)
    return samples.groupBy("file", "var").agg(F.count("*").alias("points"), F.min_by(v, "idx").alias("first"), F.max_by(v, "idx").alias("last"), F.min(v).alias("low"), F.max(v).alias("high"), (F.count("*") <= 1).alias("operating_point"))

"""Discrete gradients, Morse-Smale complexes, simplex persistence, contour trees and bivariate fields.

Meshes are points (vid, v) and cells (cid, verts). Vertices are compared by (v, vid). Steps that look at one vertex
and its star run over all stars in parallel; those that need a whole complex run once for each dataset.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import barycentric
from fieldloom.operators import complexes, mesh, topology
from fieldloom.operators.triangulation import faces
from fieldloom.session import written


def ordered_faces(points: DataFrame, cells: DataFrame, size: int) -> DataFrame:
    """(face, key, cid): faces with their vertices as (v, vid), greatest first; keys sort as the lower-star filtration."""
    flat = faces(cells, size).select("face", "cid", F.explode("face").alias("vid")).join(points.select("vid", "v"), "vid")
    return flat.groupBy("face", "cid").agg(F.reverse(F.sort_array(F.collect_list(F.struct("v", "vid")))).alias("key"))  # four at most


GRADIENT = "cell array<long>, dim int, pair array<long>, top long"


def discrete_gradient(points: DataFrame, cells: DataFrame, dimension: int = 2) -> DataFrame:
    """(cell, dim, pair, top): each cell that starts a gradient arrow, with the cell it points to, and critical cells, without one.

    `top` is the greatest vertex of the cell; cells are sorted arrays of vertices. Lower stars are disjoint, one a row.
    """
    every = None
    for n in range(2, dimension + 2):
        own = ordered_faces(points, cells, n).select("key").distinct()
        every = own if every is None else every.unionByName(own)
    stars = every.groupBy(F.get("key", 0).alias("x")).agg(F.collect_list("key").alias("star"))  # a vertex's own star
    rows = points.select(F.struct("v", "vid").alias("x")).join(stars, "x", "left").select("x.vid", F.coalesce("star", F.expr("cast(array() as array<array<struct<v:double,vid:bigint>>>)")).alias("star"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cell", pa.list_(pa.int64())), ("dim", pa.int32()), ("pair", pa.list_(pa.int64())), ("top", pa.int64())])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                star = [[(p["v"], p["vid"]) for p in s] for s in row["star"]]
                names = sorted({p for s in star for p in s})
                rank = {p: i for i, p in enumerate(names)}
                back = [p[1] for p in names] or [row["vid"]]
                name = lambda s, back=back: sorted(back[i] for i in s)
                for cell, pair in complexes.lower_star_gradient(len(back) - 1, [tuple(rank[p] for p in s) for s in star]):
                    out.append({"cell": name(cell), "dim": len(cell) - 1, "pair": name(pair) if pair else None, "top": row["vid"]})
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.mapInArrow(run, GRADIENT)


def morse_smale(points: DataFrame, cells: DataFrame) -> dict[str, DataFrame]:
    """Of a triangulated surface: `critical` cells, `separatrices` with their paths, and the `segmentation` of vertices.

    A separatrix leads from a critical edge down over vertices to a minimum (type 0), or up over triangles to a maximum
    (type 1), or to the boundary, where it has no destination.
    """
    gradient = written(discrete_gradient(points, cells), "gradient")
    critical = gradient.where("pair IS NULL").select(F.col("dim").alias("CellDimension"), F.col("cell"), F.col("top").alias("ttkVertexScalarField"))
    saddles = gradient.where("pair IS NULL AND dim = 1").select(F.col("cell").alias("saddle"))
    # Down: a vertex paired with an edge goes to the edge's other end.
    down = gradient.where("dim = 0").select(F.get("cell", 0).alias("vid"), F.coalesce(F.element_at(F.array_except("pair", "cell"), 1), F.get("cell", 0)).alias("next"))
    starts = saddles.select(F.col("saddle").alias("source"), F.explode("saddle").alias("vid"), F.lit(0).alias("SeparatrixType")).withColumn("first", F.col("vid"))
    low = mesh.follow(starts, down).select("source", F.array("first").alias("first"), "SeparatrixType", "step", F.array("vid").alias("cell"))
    # Up: a triangle goes on over the edge that is paired with it, to the triangle on the edge's other side.
    sides = faces(cells, 2).select("face", "cid").join(cells.select("cid", F.sort_array("verts").alias("t")), "cid").select("face", "t")
    owned = gradient.where("dim = 1 AND pair IS NOT NULL").select(F.col("cell").alias("face"), F.col("pair").alias("vid"))
    # An ascending path runs against the arrows: from a triangle whose edge e is paired with it, over e.
    up = owned.join(sides, "face").where("t <> vid").select("vid", F.col("t").alias("next"))
    rest = sides.select(F.col("t").alias("vid")).distinct().join(up, "vid", "left_anti").select("vid", F.col("vid").alias("next"))
    starts = saddles.join(sides.withColumnRenamed("face", "saddle"), "saddle").select(F.col("saddle").alias("source"), F.col("t").alias("vid"), F.lit(1).alias("SeparatrixType")).withColumn("first", F.col("vid"))
    high = mesh.follow(starts, up.unionByName(rest)).select("source", "first", "SeparatrixType", "step", F.col("vid").alias("cell"))
    lines = low.unionByName(high)
    ends = lines.groupBy("source", "first", "SeparatrixType").agg(F.max_by("cell", "step").alias("destination"))
    known = critical.select(F.col("cell").alias("destination"), F.lit(True).alias("_known"))
    ends = ends.join(known, "destination", "left").select("source", "first", "SeparatrixType", F.when(F.col("_known"), F.col("destination")).alias("destination"))
    segmentation = mesh.path_compression(points, cell_edges(cells))
    return {"critical": critical, "separatrices": lines.join(ends, ["source", "first", "SeparatrixType"]), "segmentation": segmentation}


def cell_edges(cells: DataFrame) -> DataFrame:
    from fieldloom.operators.triangulation import edges

    return edges(cells)


def surface_pairs(points: DataFrame, cells: DataFrame) -> DataFrame:
    """(birth_vertex, death_vertex, Birth, Death): saddle-maximum pairs of a triangulated surface in sublevel sets.

    The triangles of a surface are the nodes of its dual, joined over their sides from the greatest side down; what lies
    beyond the boundary is one node more, the eldest. Only the maxima and the sides where their basins touch meet in
    one task. Sides that belong to three triangles or more are an error.
    """
    tri = written(ordered_faces(points, cells, 3).select("cid", "key"), "triangles")
    side = written(ordered_faces(points, cells, 2).select("face", F.col("key").alias("side"), "cid"), "sides")
    if side.groupBy("face").agg(F.count("*").alias("n")).where("n > 2").limit(1).count():
        raise ValueError("a side belongs to three triangles or more")
    outside = F.lit(-1).cast("long")
    pairs = side.groupBy("side").agg(F.min("cid").alias("p"), F.when(F.count("*") > 1, F.max("cid")).otherwise(outside).alias("q"))
    pairs = written(pairs, "dual")
    both = pairs.unionByName(pairs.where(F.col("q") != outside).select("side", F.col("q").alias("p"), F.col("p").alias("q")))
    steep = both.groupBy("p").agg(F.max_by("q", "side").alias("q"))
    key = tri.select(F.col("cid").alias("q"), F.col("key").alias("theirs"))
    up = tri.join(steep, tri["cid"] == steep["p"]).join(key, "q", "left")
    up = up.select(F.col("cid").alias("vid"), F.when((F.col("q") == outside) | (F.col("theirs") > F.col("key")), F.col("q")).otherwise(F.col("cid")).alias("next"))
    end = up.sparkSession.createDataFrame([(-1, -1)], "vid long, next long")
    label = written(mesh.jump(up.unionByName(end)), "basins")
    touch = pairs.join(label.select(F.col("vid").alias("p"), F.col("next").alias("a")), "p").join(label.select(F.col("vid").alias("q"), F.col("next").alias("b")), "q").where("a <> b")
    touch = touch.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("side").alias("side"))
    named = tri
    touch = touch.join(named.select(F.col("cid").alias("a"), F.col("key").alias("ka")), "a", "left").join(named.select(F.col("cid").alias("b"), F.col("key").alias("kb")), "b")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        plain = lambda k: tuple((p["v"], p["vid"]) for p in k)
        age = {-1: ((np.inf, 0),)}
        links = []
        for a, b, s, ka, kb in zip(pdf["a"], pdf["b"], pdf["side"], pdf["ka"], pdf["kb"], strict=True):
            age[b] = plain(kb)
            if a >= 0:
                age[a] = plain(ka)
            links.append((plain(s), a, b))
        root, out = {a: a for a in age}, []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for s, a, b in sorted(links, reverse=True):
            a, b = sorted((find(a), find(b)), key=age.__getitem__)
            if a != b:
                root[a] = b
                if s[0] != age[a][0]:
                    out.append((s[0][1], age[a][0][1], s[0][0], age[a][0][0]))
        return pd.DataFrame(out, columns=["birth_vertex", "death_vertex", "Birth", "Death"])

    return touch.groupBy(F.lit(0).alias("_g")).applyInPandas(lambda pdf: run(pdf), "birth_vertex long, death_vertex long, Birth double, Death double")


def _complex(pdf: pd.DataFrame):
    """The simplices of one dataset's rows (verts, vals), and the vertex and value of each rank."""
    value = {int(v): x for vs, xs in zip(pdf["verts"], pdf["vals"], strict=True) for v, x in zip(vs, xs, strict=True)}
    back = sorted(value, key=lambda v: (value[v], v))
    rank = {v: i for i, v in enumerate(back)}
    cells = {tuple(sorted((rank[int(v)] for v in vs), reverse=True)) for vs in pdf["verts"]}
    return complexes.closure(cells), back, value


def _cells_with_values(points: DataFrame, cells: DataFrame) -> DataFrame:
    flat = cells.select("dataset", "cid", F.explode("verts").alias("vid")).join(points.select("dataset", "vid", "v"), ["dataset", "vid"])
    packed = flat.groupBy("dataset", "cid").agg(F.collect_list(F.struct("vid", "v")).alias("p"))  # four at most
    return packed.select("dataset", F.transform("p", lambda x: x["vid"]).alias("verts"), F.transform("p", lambda x: x["v"]).alias("vals"))


def simplex_diagram(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Persistence pairs of every dimension of each dataset's complex (points dataset, vid, v; cells dataset, cid, verts), by reduction.

    Pairs without persistence are dropped; classes that never die end at the greatest vertex, not finite.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        simplices, back, value = _complex(pdf)
        pairs, forever, _ = complexes.reduction(simplices)
        rows = [(back[b[0]], back[d[0]], len(b) - 1, value[back[b[0]]], value[back[d[0]]], True) for b, d in pairs if b[0] != d[0]]
        rows += [(back[b[0]], back[-1], len(b) - 1, value[back[b[0]]], value[back[-1]], False) for b in forever]
        return pd.DataFrame([(int(pdf["dataset"].iloc[0]), *r) for r in rows], columns=[c.split()[0] for c in topology.DIAGRAM.split(", ")])

    return _cells_with_values(points, cells).groupBy("dataset").applyInPandas(run, topology.DIAGRAM)


def generators(points: DataFrame, cells: DataFrame) -> DataFrame:
    """(dataset, generator, birth_vertex, death_vertex, a, b): the edges of a cycle for each one-dimensional class that dies later than it is born."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        simplices, back, _ = _complex(pdf)
        pairs, _, cycles = complexes.reduction(simplices)
        rows, n = [], 0
        for b, d in sorted(pairs):
            if len(b) == 2 and b[0] != d[0]:
                rows += [(int(pdf["dataset"].iloc[0]), n, back[b[0]], back[d[0]], *sorted(back[x] for x in simplices[e])) for e in sorted(cycles[d])]
                n += 1
        return pd.DataFrame(rows, columns=["dataset", "generator", "birth_vertex", "death_vertex", "a", "b"])

    return _cells_with_values(points, cells).groupBy("dataset").applyInPandas(run, "dataset long, generator long, birth_vertex long, death_vertex long, a long, b long")


def manifold_persistence(segmentation: DataFrame, diagram: DataFrame, manifold: str, ends: str) -> DataFrame:
    """The segmentation with Persistence and PairType of the pair of the extremum (birth or death vertex) that each manifold belongs to."""
    own = diagram.groupBy(F.col(f"{ends}_vertex").alias(manifold)).agg(F.max_by(F.struct((F.col("Death") - F.col("Birth")).alias("Persistence"), "PairType"), F.col("Death") - F.col("Birth")).alias("_p"))
    return segmentation.join(own, manifold, "left").select(*segmentation.columns, F.col("_p.Persistence").alias("Persistence"), F.col("_p.PairType").alias("PairType"))


def contour_tree(points: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arcs (dataset, SegmentationId, downNodeId, upNodeId, RegionSize) and segmentation (dataset, vid, SegmentationId) of each dataset's contour tree; nodes are vertex ids."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, values, near = topology._graph(pdf)
        arcs, arc_of = complexes.contour_tree(values, ids, [near[i] for i in range(len(ids))])
        rows = [(int(ids[x]), int(k), None, None) for x, k in enumerate(arc_of)]
        rows += [(None, k, int(ids[a]), int(ids[b])) for k, (a, b) in enumerate(arcs)]
        made = pd.DataFrame([(int(pdf["dataset"].iloc[0]), *r) for r in rows], columns=["dataset", "vid", "SegmentationId", "downNodeId", "upNodeId"])
        return made.astype({c: "Int64" for c in made.columns})

    made = written(topology.with_neighbours(points, edges).groupBy("dataset").applyInPandas(run, "dataset long, vid long, SegmentationId long, downNodeId long, upNodeId long"), "contour")
    size = made.where("vid IS NOT NULL").groupBy("dataset", "SegmentationId").agg(F.count("*").alias("RegionSize"))
    arcs = made.where("vid IS NULL").drop("vid").join(size, ["dataset", "SegmentationId"], "left").withColumn("RegionSize", F.coalesce("RegionSize", F.lit(0)).cast("long"))
    return arcs.select("dataset", "SegmentationId", "downNodeId", "upNodeId", "RegionSize"), made.where("vid IS NOT NULL").select("dataset", "vid", "SegmentationId")


# --- bivariate fields ----------------------------------------------------------------------


def jacobi_set(points: DataFrame, cells: DataFrame, u: str, v: str) -> DataFrame:
    """(a, b, EdgeType, IsPareto): edges of a triangulated surface at which the map (u, v) folds.

    The link of an edge is projected on the normal of the edge's image; where all of it falls on one side, the edge is
    an extremum there (0 below none, 3 above none). IsPareto: u and v change in opposite ways along the edge.
    """
    own = points.select(F.col("vid").alias("_v"), F.struct(F.col(u).cast("double").alias("u"), F.col(v).cast("double").alias("v"), "vid").alias("_p"))
    df = faces(cells, 2).join(cells, "cid").select(F.get("face", 0).alias("a"), F.get("face", 1).alias("b"), F.get(F.array_except("verts", "face"), 0).alias("o"))
    for c in "abo":
        df = df.join(own, F.col(c) == F.col("_v")).withColumn(c, F.col("_p")).drop("_v", "_p")
    du, dv = F.col("b.u") - F.col("a.u"), F.col("b.v") - F.col("a.v")
    height = du * (F.col("o.v") - F.col("a.v")) - dv * (F.col("o.u") - F.col("a.u"))
    above = (height > 0) | ((height == 0) & (F.col("o.vid") > F.col("a.vid")))
    sides = df.groupBy(F.col("a.vid").alias("a"), F.col("b.vid").alias("b")).agg(F.max(above).alias("hi"), F.max(~above).alias("lo"), F.max(du * dv < 0).alias("p"))
    return sides.where("NOT (hi AND lo)").select("a", "b", F.when(F.col("hi"), 0).otherwise(3).alias("EdgeType"), F.col("p").cast("tinyint").alias("IsPareto"))


def _corners(points: DataFrame, cells: DataFrame, size: int, fields: tuple[str, ...]) -> DataFrame:
    """cid and the structs p0, p1, ... of a face's corners."""
    own = points.select(F.col("vid").alias("_v"), F.struct(*[F.col(c).cast("double").alias(c) for c in dict.fromkeys(fields)]).alias("_p"))
    df = faces(cells, size).select("cid", "face", *[F.get("face", i).alias(f"p{i}") for i in range(size)])
    for i in range(size):
        df = df.join(own, F.col(f"p{i}") == F.col("_v")).withColumn(f"p{i}", F.col("_p")).drop("_v", "_p")
    return df


def fiber(points: DataFrame, cells: DataFrame, u: str, v: str, at: tuple[float, float]) -> DataFrame:
    """(cid, x0, y0, z0, x1, y1, z1): where u and v have the given values in tetrahedra, as segments between two faces.

    Fields are linear in a cell. A fiber that only touches a cell in a point gives nothing there.
    """
    df = _corners(points, cells, 3, ("x", "y", "z", u, v))
    place = lambda i: (F.col(f"p{i}.{u}"), F.col(f"p{i}.{v}"))
    w = F.array(*barycentric(F.lit(float(at[0])), F.lit(float(at[1])), place(0), place(1), place(2)))
    met = df.withColumn("w", w).where(F.get("w", 0).isNotNull() & F.forall("w", lambda x: x >= 0))
    spot = F.struct(*[sum((F.get("w", i) * F.col(f"p{i}.{c}") for i in range(3)), F.lit(0.0)).alias(c) for c in "xyz"])
    ends = met.select("cid", spot.alias("p")).groupBy("cid").agg(F.min("p").alias("p"), F.max("p").alias("q")).where("p <> q")
    return ends.select("cid", *[F.col(f"{e}.{c}").alias(f"{c}{n}") for n, e in enumerate("pq") for c in "xyz"])


def fiber_surface(points: DataFrame, cells: DataFrame, u: str, v: str, polygon: list[tuple[float, float]]) -> DataFrame:
    """(cid, edge, x, y, z, corner): triangles, three rows each, of the pre-image of a polygon's edges in tetrahedra.

    In a cell, the pre-image of an edge is where the distance from its line is 0, clipped to the edge's two ends.
    """
    df = _corners(points, cells, 4, ("x", "y", "z", u, v)).select("cid", F.array(*[F.array(*[F.col(f"p{i}.{c}") for c in ("x", "y", "z", u, v)]) for i in range(4)]).alias("t"))
    lines = list(zip(polygon, polygon[1:], strict=False))
    # A cell whose range box misses the polygon's has no part in it.
    box = [(min(p[k] for p in polygon), max(p[k] for p in polygon)) for k in (0, 1)]
    value = lambda k: F.transform("t", lambda p: F.get(p, 3 + k))
    for k, (lo, hi) in enumerate(box):
        df = df.where((F.array_max(value(k)) >= lo) & (F.array_min(value(k)) <= hi))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for cid, t in zip(pdf["cid"], pdf["t"], strict=True):
                t = np.array([list(p) for p in t], float)
                for n, (p, q) in enumerate(lines):
                    d = np.subtract(q, p)
                    off, along = (t[:, 3] - p[0]) * d[1] - (t[:, 4] - p[1]) * d[0], ((t[:, 3] - p[0]) * d[0] + (t[:, 4] - p[1]) * d[1]) / (d @ d)
                    shape = _zero_polygon(np.column_stack([t[:, :3], along]), off)
                    for keep in (lambda s: s[3], lambda s: 1 - s[3]):
                        shape = _clip(shape, keep)
                    for i in range(1, len(shape) - 1):
                        out += [(int(cid), n, k, *map(float, s[:3])) for k, s in enumerate((shape[0], shape[i], shape[i + 1]))]
            yield pd.DataFrame(out, columns=["cid", "edge", "corner", "x", "y", "z"])

    return df.mapInPandas(run, "cid long, edge int, corner int, x double, y double, z double")


def _zero_polygon(corners: np.ndarray, f: np.ndarray) -> list[np.ndarray]:
    """The polygon in which a linear function is 0 in a tetrahedron, its corners in cyclic order."""
    low, high = np.flatnonzero(f < 0), np.flatnonzero(f >= 0)
    cut = lambda i, j: corners[i] + (corners[j] - corners[i]) * (f[i] / (f[i] - f[j]))
    if len(low) in (0, 4):
        return []
    if len(low) == 2:
        return [cut(low[0], high[0]), cut(low[0], high[1]), cut(low[1], high[1]), cut(low[1], high[0])]
    lone, rest = (low, high) if len(low) == 1 else (high, low)
    return [cut(lone[0], j) for j in rest]


def _clip(shape: list[np.ndarray], keep) -> list[np.ndarray]:
    """The part of a polygon where a linear function isn't negative."""
    out = []
    for p, q in zip(shape, shape[1:] + shape[:1], strict=True):
        a, b = keep(p), keep(q)
        if a >= 0:
            out.append(p)
        if (a < 0) != (b < 0):
            out.append(p + (q - p) * (a / (a - b)))
    return out


def continuous_scatter_plot(points: DataFrame, cells: DataFrame, u: str, v: str, resolution: tuple[int, int], depth: int = 4) -> DataFrame:
    """(i, j, Density): how much volume of the tetrahedra maps to each cell of a grid over the range of (u, v), by its area.

    Each cell is taken at the points of a lattice of `depth` steps, each with an equal part of its volume; the plot
    converges as depth grows. Sums over all grid cells give the volume.
    """
    df = _corners(points, cells, 4, ("x", "y", "z", u, v))
    e = lambda i, c: F.col(f"p{i}.{c}") - F.col(f"p0.{c}")
    volume = F.abs(e(1, "x") * (e(2, "y") * e(3, "z") - e(2, "z") * e(3, "y")) - e(1, "y") * (e(2, "x") * e(3, "z") - e(2, "z") * e(3, "x")) + e(1, "z") * (e(2, "x") * e(3, "y") - e(2, "y") * e(3, "x"))) / 6
    lattice = [tuple((x + 0.25) / depth for x in (a, b, c, depth - 1 - a - b - c)) for a in range(depth) for b in range(depth - a) for c in range(depth - a - b)]
    weights = F.explode(F.array(*[F.array(*map(F.lit, w)) for w in lattice]))
    at = lambda c: sum((F.get("w", i) * F.col(f"p{i}.{c}") for i in range(4)), F.lit(0.0))
    spread = df.withColumn("volume", volume).withColumn("w", weights).select((F.col("volume") / len(lattice)).alias("part"), at(u).alias("u"), at(v).alias("v"))
    span = points.agg(*[f(F.col(c).cast("double")).alias(f"{n}{k}") for c, k in ((u, "u"), (v, "v")) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    bin_of = lambda k, n: F.least(F.floor(F.coalesce(F.try_divide((F.col(k) - F.col(f"lo{k}")) * n, F.col(f"hi{k}") - F.col(f"lo{k}")), F.lit(0.0))), F.lit(n - 1)).cast("int")
    area = (F.col("hiu") - F.col("lou")) * (F.col("hiv") - F.col("lov")) / (resolution[0] * resolution[1])
    binned = spread.crossJoin(F.broadcast(span))  # one row
    return binned.groupBy(bin_of("u", resolution[0]).alias("i"), bin_of("v", resolution[1]).alias("j")).agg((F.sum("part") / F.first(area)).alias("Density"))


"""Simplicial meshes as tables: points (vid, x, y, z, ...) and cells (cid, verts), the vertices of a cell in any order.

A face is known by the sorted array of its vertices. Derived tables (edges, faces, links) are joins and
expressions; `Triangulation` holds a mesh with the options of how they are derived.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import mesh, tables

# The six tetrahedra of a voxel, by corner (x + 2 y + 4 z).
VOXEL = ((0, 1, 2, 6), (1, 2, 3, 6), (0, 1, 4, 6), (1, 4, 5, 6), (1, 5, 6, 7), (1, 3, 6, 7))


def grid_triangles(points: DataFrame, nx: int, ny: int) -> DataFrame:
    """(cid, verts): two triangles for each quad of a grid (vid = i + nx * j), cut from its second corner to its third."""
    quads = points.where((F.col("i") < nx - 1) & (F.col("j") < ny - 1)).select("vid", (2 * (F.col("i") + (nx - 1) * F.col("j"))).cast("long").alias("q"))
    v = F.col("vid")
    both = F.array(F.struct(F.col("q").alias("cid"), F.array(v, v + 1, v + nx).alias("verts")), F.struct((F.col("q") + 1).alias("cid"), F.array(v + 1, v + nx, v + nx + 1).alias("verts")))
    return quads.select(F.explode(both).alias("c")).select("c.*")


def grid_tetrahedra(points: DataFrame, nx: int, ny: int, nz: int) -> DataFrame:
    """(cid, verts): six tetrahedra for each voxel of a grid (vid = i + nx * (j + ny * k))."""
    voxels = points.where((F.col("i") < nx - 1) & (F.col("j") < ny - 1) & (F.col("k") < nz - 1))
    voxels = voxels.select("vid", (F.col("i") + (nx - 1) * (F.col("j") + (ny - 1) * F.col("k"))).cast("long").alias("q"))
    step = lambda c: (c & 1) + nx * ((c >> 1 & 1) + ny * (c >> 2))
    six = [F.struct((6 * F.col("q") + n).alias("cid"), F.array(*[F.col("vid") + step(c) for c in tet]).alias("verts")) for n, tet in enumerate(VOXEL)]
    return voxels.select(F.explode(F.array(*six)).alias("c")).select("c.*")


def faces(cells: DataFrame, size: int) -> DataFrame:
    """(face, cid): each cell's faces of `size` vertices, as sorted arrays; cells have at most four vertices."""
    verts = F.sort_array("verts")

    def of(n: int) -> Column:
        return F.array(*[F.array(*[F.get(verts, i) for i in c]) for c in combinations(range(n), size)]) if n >= size else F.expr("cast(array() as array<array<bigint>>)")

    n = F.size("verts")
    picked = F.when(n == 2, of(2)).when(n == 3, of(3)).otherwise(of(4))
    return cells.select(F.explode(picked).alias("face"), "cid")


def edges(cells: DataFrame) -> DataFrame:
    """(vid, nvid): every edge in both directions."""
    one = faces(cells, 2).select("face").distinct()
    return one.select(F.get("face", 0).alias("vid"), F.get("face", 1).alias("nvid")).unionByName(one.select(F.get("face", 1).alias("vid"), F.get("face", 0).alias("nvid")))


def boundary(cells: DataFrame, size: int) -> DataFrame:
    """(face): faces of `size` vertices, one fewer than the cells have, that belong to one cell only."""
    return faces(cells, size).groupBy("face").agg(F.count("*").alias("n")).where("n = 1").select("face")


def request(cells: DataFrame, simplex: list[int], kind: str) -> DataFrame:
    """(face): the simplices that a request for one of them gives.

    `simplex` is itself, if the mesh has it; `facet` its faces of one vertex fewer; `cofacet` the faces of one more that
    contain it; `star` all that contain it; `link` those of the star's cells that share no vertex with it.
    """
    own = sorted(simplex)
    known = F.array(*[F.lit(v).cast("long") for v in own])
    within = cells.where(F.size(F.array_intersect("verts", known)) == len(own))
    holds = F.size(F.array_intersect("face", known)) == len(own)
    if kind == "simplex":
        return within.limit(1).select(known.alias("face"))
    if kind == "facet":
        return within.limit(1).select(F.explode(F.array(*[F.array(*[F.lit(v).cast("long") for v in c]) for c in combinations(own, len(own) - 1)])).alias("face"))
    if kind == "cofacet":
        return faces(within, len(own) + 1).where(holds).select("face").distinct()
    every = [faces(within, n).select("face") for n in (range(len(own), 5) if kind == "star" else range(1, 4))]
    found = every[0]
    for df in every[1:]:
        found = found.unionByName(df)
    keep = holds if kind == "star" else F.size(F.array_intersect("face", known)) == 0
    if kind not in ("star", "link"):
        raise ValueError(f"unknown request: {kind}")
    return found.where(keep).distinct()


def link_components(cells: DataFrame, size: int) -> DataFrame:
    """(face, LinkComponentNumber): in how many pieces the link of each face of `size` vertices falls; 1 inside a manifold."""
    rest = faces(cells, size).join(cells, "cid").select("face", F.array_except("verts", "face").alias("rest")).where(F.size("rest") > 0)
    node = lambda v: F.struct(F.col("face").alias("f"), v.alias("v"))
    nodes = rest.select("face", F.explode("rest").alias("v")).select(node(F.col("v")).alias("vid")).distinct()
    links = rest.where(F.size("rest") > 1).select("face", F.get("rest", 0).alias("a"), F.explode(F.slice("rest", 2, 3)).alias("b")).select(node(F.col("a")).alias("vid"), node(F.col("b")).alias("nvid"))
    return mesh.components(nodes, links).groupBy(F.col("vid.f").alias("face")).agg(F.countDistinct("ComponentId").alias("LinkComponentNumber"))


def periodic_edges(points: DataFrame, nx: int, ny: int) -> DataFrame:
    """The stencil of a grid that wraps around in both directions."""
    offsets = F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for s, (dx, dy) in enumerate(mesh.STENCIL)])
    spread = points.select("vid", "i", "j", F.explode(offsets).alias("o"))
    return spread.select("vid", F.col("o.slot").alias("slot"), (F.pmod(F.col("i") + F.col("o.dx"), F.lit(nx)) + nx * F.pmod(F.col("j") + F.col("o.dy"), F.lit(ny))).alias("nvid"))


def periodic_ghosts(points: DataFrame, nx: int, ny: int, layers: int = 1) -> DataFrame:
    """The grid and its ghost layers: copies of the opposite sides at places outside, with vtkGhostType 1."""
    shifts = F.array(*[F.struct(F.lit(a * nx).alias("di"), F.lit(b * ny).alias("dj")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    near = lambda c, n: F.col(c).between(-layers, n - 1 + layers)
    moved = points.withColumn("_s", F.explode(shifts)).withColumns({"i": F.col("i") + F.col("_s.di"), "j": F.col("j") + F.col("_s.dj")}).drop("_s")
    inside = F.col("i").between(0, nx - 1) & F.col("j").between(0, ny - 1)
    return moved.where(near("i", nx) & near("j", ny)).withColumn("vtkGhostType", F.when(inside, 0).otherwise(1).cast("tinyint"))


@dataclass(frozen=True)
class Triangulation:
    """A mesh with the options of a triangulation manager: explicit cells, or a grid of nx by ny, periodic or not."""

    points: DataFrame
    cells: DataFrame | None = None
    nx: int = 0
    ny: int = 0
    periodic: bool = False

    def edges(self) -> DataFrame:
        if self.cells is not None:
            return edges(self.cells)
        found = periodic_edges(self.points, self.nx, self.ny) if self.periodic else mesh.stencil_edges(self.points, self.nx, self.ny)
        return found.select("vid", "nvid")

    def triangles(self) -> DataFrame:
        if self.cells is None and self.periodic:
            raise ValueError("a periodic grid has no table of cells here; use edges()")
        return self.cells if self.cells is not None else grid_triangles(self.points, self.nx, self.ny)

    def write(self, path: str) -> None:
        """The mesh and its derived tables, as a folder that `read_triangulation` opens."""
        cells = self.triangles()
        for name, df in (("points", self.points), ("cells", cells), ("edges", self.edges()), ("boundary", boundary(cells, 2))):
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_triangulation(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a written triangulation: points, cells, edges and boundary."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("points", "cells", "edges", "boundary")}


# --- subdivision ---------------------------------------------------------------------------


def _centres(cells: DataFrame, points: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(face, vid and the mean of every other column of points): a new vertex for each face, numbered after the points."""
    every = None
    for n in sizes:
        own = faces(cells, n).select("face").distinct()
        every = own if every is None else every.unionByName(own)
    named = tables.global_rank(every, [F.size("face"), F.col("face")], "_r")
    fields = [c for c in points.columns if c != "vid"]
    means = named.select("face", "_r", F.explode("face").alias("vid")).join(points, "vid").groupBy("face", "_r").agg(*[F.avg(c).alias(c) for c in fields])
    first = points.agg(F.max("vid").alias("_m"))
    return means.crossJoin(F.broadcast(first)).select("face", (F.col("_m") + 1 + F.col("_r")).alias("vid"), *fields)  # one row


def _with_centres(cells: DataFrame, centres: DataFrame) -> DataFrame:
    """Triangles with the new vertices of their sides ab, bc, ca and of themselves, m."""
    t = F.sort_array("verts")
    df = cells.select("cid", *[F.get(t, i).alias(n) for i, n in enumerate("abc")])
    key = centres.select(F.col("face").alias("_f"), F.col("vid").alias("_v"))
    for name, corners in (("ab", "ab"), ("bc", "bc"), ("ca", "ac"), ("m", "abc")):
        df = df.join(key, F.array(*[F.col(c) for c in corners]) == F.col("_f")).withColumn(name, F.col("_v")).drop("_f", "_v")
    return df


def barycentric_subdivision(points: DataFrame, cells: DataFrame, levels: int = 1) -> tuple[DataFrame, DataFrame]:
    """Triangles cut into six by the barycentres of their sides and of themselves; fields of new vertices are means."""
    for _ in range(levels):
        centres = _centres(cells, points, (2, 3))
        df = _with_centres(cells, centres)
        parts = [F.array("a", "ab", "m"), F.array("ab", "b", "m"), F.array("b", "bc", "m"), F.array("bc", "c", "m"), F.array("c", "ca", "m"), F.array("ca", "a", "m")]
        cells = df.select(F.posexplode(F.array(*parts)).alias("n", "verts"), "cid").select((6 * F.col("cid") + F.col("n")).alias("cid"), "verts")
        points = points.select(*[F.col(c).cast("double").alias(c) if c != "vid" else F.col(c) for c in points.columns]).unionByName(centres.drop("face"))
    return points, cells


def mesh_subdivision(points: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triangles cut into three quads: a corner, the middles of its two sides, and the barycentre."""
    centres = _centres(cells, points, (2, 3))
    df = _with_centres(cells, centres)
    parts = [F.array("a", "ab", "m", "ca"), F.array("b", "bc", "m", "ab"), F.array("c", "ca", "m", "bc")]
    quads = df.select(F.posexplode(F.array(*parts)).alias("n", "verts"), "cid").select((3 * F.col("cid") + F.col("n")).alias("cid"), "verts")
    return points.select(*[F.col(c).cast("double").alias(c) if c != "vid" else F.col(c) for c in points.columns]).unionByName(centres.drop("face")), quads


def separators(points: DataFrame, cells: DataFrame, label: str) -> DataFrame:
    """(cid, a, b, x0, y0, z0, x1, y1, z1): the lines that part the labels a < b of triangles.

    A triangle of two labels has one line between the middles of the sides that join them; one of three has a line
    from the middle of each side to the barycentre.
    """
    own = points.select(F.col("vid").alias("_v"), F.struct("x", "y", "z", F.col(label).alias("l")).alias("_p"))
    df = cells.select("cid", *[F.get(F.sort_array("verts"), i).alias(n) for i, n in enumerate("abc")])
    for n in "abc":
        df = df.join(own, F.col(n) == F.col("_v")).withColumn(n, F.col("_p")).drop("_v", "_p")
    cross = lambda s, t: (F.col(f"{s}.l") != F.col(f"{t}.l"))
    mid = lambda s, t: F.struct(*[((F.col(f"{s}.{c}") + F.col(f"{t}.{c}")) / 2).alias(c) for c in "xyz"])
    side = lambda s, t: F.when(cross(s, t), F.struct(F.least(F.col(f"{s}.l"), F.col(f"{t}.l")).alias("a"), F.greatest(F.col(f"{s}.l"), F.col(f"{t}.l")).alias("b"), mid(s, t).alias("p")))
    sides = F.array_compact(F.array(side("a", "b"), side("b", "c"), side("a", "c")))
    centre = F.struct(*[((F.col(f"a.{c}") + F.col(f"b.{c}") + F.col(f"c.{c}")) / 3).alias(c) for c in "xyz"])
    lines = df.select("cid", sides.alias("s"), centre.alias("m")).where(F.size("s") > 0)
    line = lambda x, p, q: F.struct(x["a"].alias("a"), x["b"].alias("b"), p.alias("p"), q.alias("q"))
    both = F.when(F.size("s") == 2, F.array(line(F.get("s", 0), F.get("s", 0)["p"], F.get("s", 1)["p"]))).otherwise(F.transform("s", lambda x: line(x, x["p"], F.col("m"))))
    out = lines.select("cid", F.explode(both).alias("l"))
    return out.select("cid", "l.a", "l.b", *[F.col(f"l.{e}.{c}").alias(f"{c}{n}") for n, e in enumerate("pq") for c in "xyz"])


def tetrahedron_separators(points: DataFrame, cells: DataFrame, label: str) -> DataFrame:
    """(cid, a, b, corners): triangles that part the labels a < b of tetrahedra, each corner as (x, y, z).

    Each edge between two labels has two triangles: from its middle to the barycentre of the cell, by way of that of
    each of the two faces that hold the edge.
    """
    own = points.select(F.col("vid").alias("_v"), F.struct("x", "y", "z", F.col(label).alias("l")).alias("_p"))
    names = "pqrs"
    df = cells.select("cid", *[F.get(F.sort_array("verts"), i).alias(n) for i, n in enumerate(names)])
    for n in names:
        df = df.join(own, F.col(n) == F.col("_v")).withColumn(n, F.col("_p")).drop("_v", "_p")
    mean = lambda vs: F.array(*[sum((F.col(f"{v}.{c}") for v in vs), F.lit(0.0)) / len(vs) for c in "xyz"])
    parts = []
    for s, t in combinations(names, 2):
        for o in (n for n in names if n not in (s, t)):
            made = F.struct(F.least(F.col(f"{s}.l"), F.col(f"{t}.l")).alias("a"), F.greatest(F.col(f"{s}.l"), F.col(f"{t}.l")).alias("b"), F.array(mean([s, t]), mean([s, t, o]), mean(names)).alias("corners"))
            parts.append(F.when(F.col(f"{s}.l") != F.col(f"{t}.l"), made))
    return df.select("cid", F.explode(F.array_compact(F.array(*parts))).alias("t")).select("cid", "t.*")

"""Registered queries of meshes, glyphs, interpolation and images, on the grid of months by quantities."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldloom.operators import approximation, comparison, embedding, geometry, mesh, morse, topology, triangulation
from fieldloom.plans.registry import register
from fieldloom.plans.topological import _GRID, NX, NY, _series, _tracked, dataset, grid
from fieldloom.session import read_table, shared_dir, written

_Q = f"cid0 AS (SELECT 2 * (i + {NX - 1} * j) AS q, vid, i, j FROM g WHERE i < {NX - 1} AND j < {NY - 1})"
_T = f"{_Q}, t AS (SELECT q AS cid, vid AS a, vid + 1 AS b, vid + {NX} AS c FROM cid0 UNION ALL SELECT q + 1, vid + 1, vid + {NX}, vid + {NX + 1} FROM cid0)"
_P = "p AS (SELECT vid, i::DOUBLE AS x, j::DOUBLE AS y, v / 1e6::DOUBLE AS z, v FROM g)"
_SIDES = "sd AS (SELECT cid, a AS u, b AS w FROM t UNION ALL SELECT cid, b, c FROM t UNION ALL SELECT cid, a, c FROM t)"


def surface(spark, d):
    """Points (vid, x, y, z, v) of the grid, its height in millions, and its triangles."""
    points, edges = grid(spark, d)
    lifted = points.select("vid", F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"), (F.col("v") / 1e6).alias("z"), F.col("v").cast("double").alias("v"))
    return lifted, triangulation.grid_triangles(points, NX, NY), edges


@register("geometry_smoother", f"WITH {_GRID}, {_P} SELECT e.vid, round((any_value(a.x) + sum(b.x)) / (count(*) + 1), 6) AS x, round((any_value(a.y) + sum(b.y)) / (count(*) + 1), 6) AS y, round((any_value(a.z) + sum(b.z)) / (count(*) + 1), 6) AS z FROM e JOIN p a ON a.vid = e.vid JOIN p b ON b.vid = nvid GROUP BY e.vid")
def geometry_smoother(spark, d):
    points, _, edges = surface(spark, d)
    out = mesh.smooth_fields(points.select("vid", "x", "y", "z"), edges.select("vid", "nvid"), ["x", "y", "z"])
    return out.withColumns({c: F.round(c, 6) for c in "xyz"})


@register("surface_geometry_smoother")
def surface_geometry_smoother(spark, d):
    points, _, edges = surface(spark, d)
    return geometry.smooth_on_surface(points.select("vid", "x", "y", "z"), edges.select("vid", "nvid"), points.select("x", "y", "z"), 2, 2.0)


@register("triangulation_request", f"WITH {_GRID} SELECT concat(least(vid, nvid), '-', greatest(vid, nvid)) AS face FROM e WHERE vid = 2444")
def triangulation_request(spark, d):
    _, cells, _ = surface(spark, d)
    return triangulation.request(cells, [2444], "cofacet").select(F.array_join(F.col("face").cast("array<string>"), "-").alias("face"))


@register("triangulation_link", f"WITH {_GRID} SELECT nvid AS vid FROM e WHERE vid = 2444")
def triangulation_link(spark, d):
    _, cells, _ = surface(spark, d)
    return triangulation.request(cells, [2444], "link").where("size(face) = 1").select(F.get("face", 0).alias("vid"))


@register("domain_boundary", f"WITH {_GRID}, {_T}, {_SIDES} SELECT u, w FROM sd GROUP BY u, w HAVING count(*) = 1")
def domain_boundary(spark, d):
    _, cells, _ = surface(spark, d)
    return triangulation.boundary(cells, 2).select(F.get("face", 0).alias("u"), F.get("face", 1).alias("w"))


@register("periodic_ghosts", f"WITH {_GRID} SELECT vid, i + a * {NX} AS i, j + b * {NY} AS j, v, CASE WHEN a = 0 AND b = 0 THEN 0 ELSE 1 END::TINYINT AS \"vtkGhostType\" FROM g, (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b) WHERE i + a * {NX} BETWEEN -1 AND {NX} AND j + b * {NY} BETWEEN -1 AND {NY}")
def periodic_ghosts(spark, d):
    return triangulation.periodic_ghosts(grid(spark, d)[0], NX, NY)


@register("periodic_triangulation", f"WITH {_GRID} SELECT a.vid, round(avg(b.v), 4) AS average FROM g a, (VALUES (-1, 0), (0, -1), (1, -1), (1, 0), (0, 1), (-1, 1)) o(dx, dy) JOIN g b ON b.i = (a.i + dx + {NX}) % {NX} AND b.j = (a.j + dy + {NY}) % {NY} GROUP BY a.vid")
def periodic_triangulation(spark, d):
    points, _ = grid(spark, d)
    edges = triangulation.Triangulation(points, nx=NX, ny=NY, periodic=True).edges()
    return mesh.neighbour_average(points, edges).withColumn("average", F.round("average", 4))


@register("triangulation_round_trip", f"WITH {_GRID}, {_T}, {_SIDES} SELECT (SELECT count(*) FROM g) AS points, (SELECT count(*) FROM t) AS cells, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM (SELECT u, w FROM sd GROUP BY u, w HAVING count(*) = 1)) AS boundary")
def triangulation_round_trip(spark, d):
    points, _ = grid(spark, d)
    path = f"{shared_dir(spark)}/fieldloom/{uuid.uuid4().hex}"
    triangulation.Triangulation(points, nx=NX, ny=NY).write(path)
    tables = triangulation.read_triangulation(spark, path)
    return spark.createDataFrame([tuple(tables[n].count() for n in ("points", "cells", "edges", "boundary"))], "points long, cells long, edges long, boundary long")


@register("barycentric_subdivision", f"WITH {_GRID}, {_P}, {_T}, {_SIDES}, f AS (SELECT x, y, z FROM p UNION ALL SELECT (a.x + b.x) / 2, (a.y + b.y) / 2, (a.z + b.z) / 2 FROM (SELECT DISTINCT u, w FROM sd) JOIN p a ON a.vid = u JOIN p b ON b.vid = w UNION ALL SELECT (x.x + y.x + w.x) / 3, (x.y + y.y + w.y) / 3, (x.z + y.z + w.z) / 3 FROM t JOIN p x ON x.vid = a JOIN p y ON y.vid = b JOIN p w ON w.vid = c) SELECT round(x, 7) AS x, round(y, 7) AS y, round(z, 7) AS z FROM f")
def barycentric_subdivision(spark, d):
    points, cells, _ = surface(spark, d)
    fine, _ = triangulation.barycentric_subdivision(points.select("vid", "x", "y", "z"), cells)
    return fine.select(*[F.round(c, 7).alias(c) for c in "xyz"])


@register("mesh_subdivision", f"WITH {_GRID}, {_P}, {_T} SELECT round((p.x + (q.x + p.x) / 2 + (p.x + q.x + r.x) / 3 + (p.x + r.x) / 2) / 4, 5) AS x, round((p.y + (q.y + p.y) / 2 + (p.y + q.y + r.y) / 3 + (p.y + r.y) / 2) / 4, 5) AS y FROM (SELECT a AS k, b AS l, c AS m FROM t UNION ALL SELECT b, a, c FROM t UNION ALL SELECT c, a, b FROM t) JOIN p ON p.vid = k JOIN p q ON q.vid = l JOIN p r ON r.vid = m")
def mesh_subdivision(spark, d):
    points, cells, _ = surface(spark, d)
    fine, quads = triangulation.mesh_subdivision(points.select("vid", "x", "y", "z"), cells)
    flat = quads.select("cid", F.explode("verts").alias("vid")).join(fine, "vid")
    return flat.groupBy("cid").agg(F.round(F.avg("x"), 5).alias("x"), F.round(F.avg("y"), 5).alias("y")).select("x", "y")


@register("manifold_check", f"WITH {_GRID} SELECT vid, 1::BIGINT AS n FROM g")
def manifold_check(spark, d):
    _, cells, _ = surface(spark, d)
    return triangulation.link_components(cells, 1).select(F.get("face", 0).alias("vid"), F.col("LinkComponentNumber").alias("n"))


@register("marching_triangles", f"""WITH {_GRID}, {_T}, h AS (SELECT quantile_disc(v, 0.5) AS h FROM g), l AS (SELECT vid, i::DOUBLE AS x, j::DOUBLE AS y, (v > h)::INT AS l FROM g, h),
k AS (SELECT cid, p.x AS px, p.y AS py, p.l AS pl, q.x AS qx, q.y AS qy, q.l AS ql, r.x AS rx, r.y AS ry, r.l AS rl FROM t JOIN l p ON p.vid = a JOIN l q ON q.vid = b JOIN l r ON r.vid = c)
SELECT cid, CASE WHEN pl <> ql THEN (px + qx) / 2 ELSE (qx + rx) / 2 END AS x0, CASE WHEN pl <> ql THEN (py + qy) / 2 ELSE (qy + ry) / 2 END AS y0, CASE WHEN pl <> rl THEN (px + rx) / 2 ELSE (qx + rx) / 2 END AS x1, CASE WHEN pl <> rl THEN (py + ry) / 2 ELSE (qy + ry) / 2 END AS y1 FROM k WHERE pl <> ql OR ql <> rl""")
def marching_triangles(spark, d):
    points, cells, _ = surface(spark, d)
    half = points.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)").alias("h")).first().h
    labelled = points.withColumn("l", (F.col("v") > half).cast("int"))
    return triangulation.separators(labelled, cells, "l").select("cid", "x0", "y0", "x1", "y1")


_U = "(('0x' || substr(md5(concat('3:', vid, ':', {0})), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE"
_N = "sqrt(-2 * ln(" + _U.format("'n:r'") + ")) * cos(2 * pi() * " + _U.format("'n:a'") + ")"


@register("gaussian_point_cloud", "WITH v AS (SELECT unnest(range(1000)) AS vid), u AS (SELECT vid, " + ", ".join(f"2 * {_U.format(repr(str(k)))} - 1 AS u{k}" for k in range(3)) + f", {_N} AS n FROM v) SELECT vid, " + ", ".join(f"round(u{k} * n / sqrt(u0 * u0 + u1 * u1 + u2 * u2), 6) AS {c}" for k, c in enumerate("xyz")) + " FROM u")
def gaussian_point_cloud(spark, d):  # noqa: ARG001
    out = geometry.gaussian_point_cloud(spark, 1000, 3, 3)
    return out.select("vid", *[F.round(c, 6).alias(c) for c in "xyz"])


@register("icosphere", "SELECT 162::BIGINT AS points, 320::BIGINT AS cells, 1.0::DOUBLE AS radius")
def icosphere(spark, d):  # noqa: ARG001
    points, cells = geometry.icosphere(spark, 2)
    return points.agg(F.count("*").alias("points"), F.round(F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)), 6).alias("radius")).withColumn("cells", F.lit(cells.count()))


@register("icosphere_from_object", "WITH b AS (SELECT max(s_acctbal) - min(s_acctbal) AS w, max(s_nationkey) - min(s_nationkey) AS h FROM supplier) SELECT 42::BIGINT AS n, round(sqrt(w * w + h * h) / 2, 4) AS radius FROM b")
def icosphere_from_object(spark, d):
    points = read_table(spark, d, "supplier").select(F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"), F.lit(0.0).alias("z"))
    ball, _ = geometry.icosphere_of_object(points, 1)
    # The radius from the sphere's own points, by its normals.
    ends = ball.agg(F.count("*").alias("n"), F.max("x").alias("a"), F.min("x").alias("b"), F.max("nx").alias("m"))
    return ends.select("n", F.round((F.col("a") - F.col("b")) / (2 * F.col("m")), 4).alias("radius"))


@register("icospheres_from_points", "SELECT s_suppkey AS source, 42::BIGINT AS n, round(s_acctbal, 4) AS x FROM supplier")
def icospheres_from_points(spark, d):
    points = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("vid"), F.col("s_acctbal").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    balls, _ = geometry.icospheres_of_points(points, 1)
    return balls.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("x"), 4).alias("x"))


@register("sphere_from_point", "SELECT s_suppkey AS source, 58::BIGINT AS n, round(s_acctbal, 4) AS x FROM supplier")
def sphere_from_point(spark, d):
    points = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("vid"), F.col("s_acctbal").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    balls, _ = geometry.spheres_of_points(points)
    return balls.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("x"), 4).alias("x"))


_NODES = "n AS (SELECT date_diff('day', DATE '1970-01-01', ts::DATE) AS t, event_type AS l, count(DISTINCT user_id) AS s FROM events GROUP BY 1, 2)"


@register("planar_graph_layout", f"WITH {_NODES} SELECT t, l, (dense_rank() OVER (ORDER BY t) - 1)::DOUBLE AS x, sum(s) OVER (PARTITION BY t ORDER BY l ROWS UNBOUNDED PRECEDING) - s / 2 AS y FROM n")
def planar_graph_layout(spark, d):
    nodes = topology.overlap_nodes(_tracked(spark, d), "t", "event_type", "user_id").select(F.col("SequenceIndex").alias("t"), F.col("Label").alias("l"), "Size")
    return geometry.planar_layout(nodes, "t", "l", size="Size").select("t", "l", "x", "y")


@register("mesh_graph", "SELECT n_nationkey AS eid, n, side, CASE WHEN n = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS x, CASE WHEN n = 0 THEN n_nationkey ELSE n_regionkey * 5 END + side * (CASE WHEN n = 0 THEN 0.5 ELSE 2.0 END) / 2 AS y FROM nation, (SELECT unnest([0, 1]) AS n), (SELECT unnest([-1, 1]) AS side)")
def mesh_graph(spark, d):
    nation, region = read_table(spark, d, "nation"), read_table(spark, d, "region")
    at = lambda df, key, first, x, y, s: df.select((F.col(key).cast("long") + first).alias("vid"), F.lit(x).alias("x"), (F.col(key) * y).cast("double").alias("y"), F.lit(0.0).alias("z"), F.lit(s).alias("s"))
    nodes = at(nation, "n_nationkey", 0, 0.0, 1, 0.5).unionByName(at(region, "r_regionkey", 100, 1.0, 5, 2.0))
    edges = nation.select(F.col("n_nationkey").alias("eid"), F.col("n_nationkey").cast("long").alias("a"), (F.col("n_regionkey").cast("long") + 100).alias("b"))
    return geometry.mesh_graph(nodes, edges, "s")[0].select("eid", "n", "side", "x", "y")


_HERON = "sqrt(greatest((a + b + c) * (b + c - a) * (a + c - b) * (a + b - c), 0)) / 4"


@register("metric_distortion", f"""WITH {_GRID}, {_P}, {_T}, k AS (SELECT cid, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) AS a, sqrt((q.x - r.x) ** 2 + (q.y - r.y) ** 2) AS b, sqrt((p.x - r.x) ** 2 + (p.y - r.y) ** 2) AS c,
 sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) AS a3, sqrt((q.x - r.x) ** 2 + (q.y - r.y) ** 2 + (q.z - r.z) ** 2) AS b3, sqrt((p.x - r.x) ** 2 + (p.y - r.y) ** 2 + (p.z - r.z) ** 2) AS c3 FROM t JOIN p ON p.vid = t.a JOIN p q ON q.vid = t.b JOIN p r ON r.vid = t.c)
SELECT cid, round({_HERON}, 4) AS "Area", round(sqrt(greatest((a3 + b3 + c3) * (b3 + c3 - a3) * (a3 + c3 - b3) * (a3 + b3 - c3), 0)) / 4, 4) AS "MetricArea" FROM k""")
def metric_distortion(spark, d):
    points, cells, edges = surface(spark, d)
    one = edges.where("vid < nvid").select(F.col("vid").alias("i"), F.col("nvid").alias("j"))
    at = lambda c: points.select(F.col("vid").alias(c), F.struct("x", "y", "z").alias(f"_{c}"))
    gap = F.sqrt(sum(((F.col(f"_i.{c}") - F.col(f"_j.{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    metric = one.join(at("i"), "i").join(at("j"), "j").select("i", "j", gap.alias("d"))
    flat = points.withColumn("z", F.lit(0.0))
    return geometry.metric_distortion(flat, cells, metric)[0].select("cid", *[F.round(c, 4).alias(c) for c in ("Area", "MetricArea")])


_AT = "w AS (SELECT c_custkey AS tid, c_custkey % 90 + 0.25 AS x, c_custkey % 45 + 0.4 + (c_custkey % 2) * 0.5 AS y FROM customer), c AS (SELECT *, floor(x)::BIGINT AS i, floor(y)::BIGINT AS j, x - floor(x) AS fx, y - floor(y) AS fy FROM w)"
_BLEND = f"SELECT tid, c.x, c.y, CASE WHEN fx + fy <= 1 THEN g0.v * (1 - fx - fy) + g1.v * fx + g2.v * fy ELSE g3.v * (fx + fy - 1) + g2.v * (1 - fx) + g1.v * (1 - fy) END AS v FROM c JOIN g g0 ON g0.vid = c.i + {NX} * c.j JOIN g g1 ON g1.vid = g0.vid + 1 JOIN g g2 ON g2.vid = g0.vid + {NX} JOIN g g3 ON g3.vid = g0.vid + {NX + 1}"


def _targets(spark, d):
    key = F.col("c_custkey")
    return read_table(spark, d, "customer").select(key.alias("tid"), (key % 90 + 0.25).cast("double").alias("x"), (key % 45 + 0.4 + (key % 2) * 0.5).cast("double").alias("y"))


@register("data_set_interpolator", f"WITH {_GRID}, {_AT}, b AS ({_BLEND}) SELECT tid, round(v / 1e6, 4) AS v FROM b")
def data_set_interpolator(spark, d):
    points, cells, _ = surface(spark, d)
    return geometry.interpolate(_targets(spark, d), points, cells, ["v"], 4.0).select("tid", F.round(F.col("v") / 1e6, 4).alias("v"))


@register("projection_from_table", f"WITH {_GRID}, {_AT}, b AS ({_BLEND}) SELECT tid, round(2 * x, 4) AS x, round(3 * y, 4) AS y, round(v / 1e6, 4) AS z FROM b")
def projection_from_table(spark, d):
    points, cells, _ = surface(spark, d)
    bent = points.select("vid", F.col("x").alias("u"), F.col("y").alias("w"), (2 * F.col("x")).alias("x"), (3 * F.col("y")).alias("y"), "z")
    table = _targets(spark, d).withColumnsRenamed({"x": "u", "y": "w"})
    return geometry.project_table(bent, cells, table, "u", "w", 4.0).select("tid", *[F.round(c, 4).alias(c) for c in "xyz"])


CAMERA = {"position": (47.6, 24.55, 1000.0), "direction": (0.0, 0.0, -1.0), "up": (0.0, 1.0, 0.0), "height": 49.0, "near": 0.0, "far": 2000.0, "resolution": (95, 49)}
_SEEN = f"""k AS (SELECT q AS cid, cid0.i, cid0.j, g1.v / 1e6 AS v1, g2.v / 1e6 AS v2, g3.v / 1e6 AS v3 FROM cid0 JOIN g g1 ON g1.vid = cid0.vid + 1 JOIN g g2 ON g2.vid = cid0.vid + {NX} JOIN g g3 ON g3.vid = cid0.vid + {NX + 1}),
z AS (SELECT i, j, cid + 1 AS cid, (1000 - (v3 * 0.15::DOUBLE + v2 * 0.4::DOUBLE + v1 * 0.45::DOUBLE)) / 2000 AS d FROM k)"""


@register("cinema_imaging", f'WITH {_GRID}, {_Q}, {_SEEN} SELECT i, j, cid, round(d, 6) AS "Depth" FROM z')
def cinema_imaging(spark, d):
    points, cells, _ = surface(spark, d)
    return geometry.depth_image(points, cells, **CAMERA).withColumn("Depth", F.round("Depth", 6))


@register("depth_image_geometry", f"WITH {_GRID}, {_Q}, {_SEEN} SELECT i + 95 * j AS vid, round(i + 0.6, 4) AS x, round(j + 0.55, 4) AS y, round(1000 - 2000 * d, 3) AS z FROM z")
def depth_image_geometry(spark, d):
    points, cells, _ = surface(spark, d)
    image = written(geometry.depth_image(points, cells, **CAMERA), "image")
    out, _ = geometry.surface_of_depth(image, **CAMERA)
    return out.select("vid", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round("z", 3).alias("z"))


_IMAGE = "m AS (SELECT l_returnflag AS image, l_linenumber AS i, l_quantity::INT AS j, min(l_discount) AS d, round(max(l_tax), 2) AS tax FROM lineitem GROUP BY 1, 2, 3)"


def _image(spark, d):
    return read_table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("image"), F.col("l_linenumber").alias("i"), F.col("l_quantity").cast("int").alias("j")).agg(F.min("l_discount").alias("Depth"), F.round(F.max("l_tax"), 2).alias("tax"))


@register("darkroom_compositing", f'WITH {_IMAGE} SELECT i, j, image, d AS "Depth", tax FROM m QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY d, image) = 1')
def darkroom_compositing(spark, d):
    return geometry.composite(_image(spark, d))


@register("darkroom_color_map", f"WITH {_IMAGE} SELECT image, i, j, round(CASE WHEN d <= 0.05 THEN d / 0.05 ELSE 1 - (d - 0.05) / 0.05 END, 5) AS r, round(CASE WHEN d <= 0.05 THEN 0.5 * d / 0.05 ELSE 0.5 END, 5) AS g FROM m")
def darkroom_color_map(spark, d):
    out = geometry.color_map(_image(spark, d), "Depth", [(0.0, 0.0, 0.0, 0.0), (0.05, 1.0, 0.5, 0.0), (0.1, 0.0, 0.5, 1.0)])
    return out.select("image", "i", "j", F.round("r", 5).alias("r"), F.round("g", 5).alias("g"))


@register("darkroom_noise", f"WITH {_IMAGE} SELECT DISTINCT i, j, round((('0x' || substr(md5(concat('0:', i, ':', j)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE, 6) AS \"Noise\" FROM m")
def darkroom_noise(spark, d):
    return geometry.noise(geometry.composite(_image(spark, d))).select("i", "j", F.round("Noise", 6).alias("Noise"))


@register("darkroom_occlusion", f"WITH {_IMAGE}, c AS (SELECT i, j, min(d) AS d FROM m GROUP BY i, j) SELECT a.i, a.j, round(coalesce(avg(greatest(a.d - b.d, 0)), 0), 6) AS \"Occlusion\" FROM c a LEFT JOIN c b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND (a.i <> b.i OR a.j <> b.j) GROUP BY a.i, a.j")
def darkroom_occlusion(spark, d):
    return geometry.shade_by_depth(geometry.composite(_image(spark, d))).select("i", "j", F.round("Occlusion", 6).alias("Occlusion"))


@register("jacobi_set", f"""WITH {_GRID}, {_T}, o AS (SELECT a AS u, b AS w, c AS o FROM t UNION ALL SELECT b, c, a FROM t UNION ALL SELECT a, c, b FROM t),
f AS (SELECT vid, v::DOUBLE AS v, (i * i - 3 * j * i)::DOUBLE AS r FROM g), h AS (SELECT u, w, (q.v - p.v) * (x.r - p.r) - (q.r - p.r) * (x.v - p.v) AS h, x.vid > p.vid AS later, (q.v - p.v) * (q.r - p.r) < 0 AS opp FROM o JOIN f p ON p.vid = u JOIN f q ON q.vid = w JOIN f x ON x.vid = o)
SELECT u AS a, w AS b, CASE WHEN bool_or(h > 0 OR (h = 0 AND later)) THEN 0 ELSE 3 END AS "EdgeType", bool_or(opp)::TINYINT AS "IsPareto" FROM h GROUP BY u, w HAVING NOT (bool_or(h > 0 OR (h = 0 AND later)) AND bool_or(NOT (h > 0 OR (h = 0 AND later))))""")
def jacobi_set(spark, d):
    points, cells, _ = surface(spark, d)
    return morse.jacobi_set(points.withColumn("r", F.col("x") * F.col("x") - 3 * F.col("y") * F.col("x")), cells, "v", "r")


# --- topology beyond SQL: each has a brute-force test ----------------------------------------


@register("surface_persistence_pairs")
def surface_persistence_pairs(spark, d):
    points, cells, _ = surface(spark, d)
    return morse.surface_pairs(points, cells)


@register("discrete_gradient")
def discrete_gradient(spark, d):
    points, cells, _ = surface(spark, d)
    out = morse.discrete_gradient(points, cells)
    name = lambda c: F.array_join(F.col(c).cast("array<string>"), "-").alias(c)
    return out.select(name("cell"), "dim", name("pair"), "top")


@register("morse_smale_separatrices")
def morse_smale_separatrices(spark, d):
    points, cells, _ = surface(spark, d)
    name = lambda c: F.array_join(F.col(c).cast("array<string>"), "-").alias(c)
    return morse.morse_smale(points, cells)["separatrices"].select(name("source"), name("first"), "SeparatrixType", "step", name("cell"), name("destination"))


@register("stable_manifold_persistence")
def stable_manifold_persistence(spark, d):
    points, _, edges = surface(spark, d)
    diagram = topology.persistence_diagram(*dataset(points, edges))
    return morse.manifold_persistence(mesh.path_compression(points, edges), diagram.where("PairType = 0"), "AscendingManifold", "birth")


@register("contour_tree")
def contour_tree(spark, d):
    return morse.contour_tree(*dataset(*grid(spark, d)))[0]


_SMALL = (12, 10, 11)


def cube(spark, d):
    """A grid of months by tens of quantities by discounts, and its tetrahedra: sums of prices as v, of taxes as w."""
    nx, ny, nz = _SMALL
    key = [(F.month("l_shipdate") - 1).alias("i"), F.least(F.floor((F.col("l_quantity") - 1) / 5), F.lit(ny - 1)).cast("int").alias("j"), F.least(F.round(F.col("l_discount") * 100).cast("int"), F.lit(nz - 1)).alias("k")]
    sums = read_table(spark, d, "lineitem").groupBy(*key).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("v"), F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("w"))
    n = F.col("id")
    cells = spark.range(nx * ny * nz).select(n.alias("vid"), (n % nx).cast("int").alias("i"), (F.floor(n / nx) % ny).cast("int").alias("j"), F.floor(n / (nx * ny)).cast("int").alias("k"))
    points = cells.join(sums, ["i", "j", "k"], "left").select("vid", "i", "j", "k", *[F.col(a).cast("double").alias(b) for a, b in zip("ijk", "xyz", strict=True)], F.coalesce("v", F.lit(0)).cast("double").alias("v"), F.coalesce("w", F.lit(0)).cast("double").alias("w"))
    points = written(points, "cube")
    return points, triangulation.grid_tetrahedra(points, nx, ny, nz)


def _one(points, cells):
    return points.select(F.lit(0).cast("long").alias("dataset"), "vid", "v"), cells.withColumn("dataset", F.lit(0).cast("long"))


@register("persistence_diagram_3d")
def persistence_diagram_3d(spark, d):
    return morse.simplex_diagram(*_one(*cube(spark, d)))


@register("persistent_generators")
def persistent_generators(spark, d):
    return morse.generators(*_one(*cube(spark, d)))


@register("marching_tetrahedra")
def marching_tetrahedra(spark, d):
    points, cells = cube(spark, d)
    out = triangulation.tetrahedron_separators(points.withColumn("l", (F.col("v") > 3e7).cast("int")), cells, "l")
    return out.select("cid", "a", "b", *[F.round(F.get(F.get("corners", i), k), 6).alias(f"{c}{i}") for i in range(3) for k, c in enumerate("xyz")])


@register("fiber")
def fiber(spark, d):
    points, cells = cube(spark, d)
    middle = points.agg(*[F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})").alias(c) for c in "vw"]).first()
    return morse.fiber(points, cells, "v", "w", (middle.v, middle.w))


@register("fiber_surface")
def fiber_surface(spark, d):
    points, cells = cube(spark, d)
    q = points.agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})").alias(f"{c}{n}") for c in "vw" for n, p in enumerate((0.25, 0.75))]).first()
    return morse.fiber_surface(points, cells, "v", "w", [(q.v0, q.w0), (q.v1, q.w0), (q.v1, q.w1)])


@register("continuous_scatter_plot")
def continuous_scatter_plot(spark, d):
    return morse.continuous_scatter_plot(*cube(spark, d), "v", "w", (32, 32))


@register("topological_simplification_constraints")
def topological_simplification_constraints(spark, d):
    points, edges = dataset(*grid(spark, d))
    points = written(points, "points")
    pairs = topology.persistence_diagram(points, edges).where("Death - Birth > 2e7")
    kept = pairs.select(F.when(F.col("PairType") == 0, F.col("birth_vertex")).otherwise(F.col("death_vertex")).alias("v")).collect()  # a request's list
    return topology.simplify_to(points, edges, [r.v for r in kept])


@register("approximate_diagram")
def approximate_diagram(spark, d):
    return approximation.approximate_diagram(*dataset(*grid(spark, d)), 0.05)[0]


@register("topological_compression")
def topological_compression(spark, d):
    path = f"{shared_dir(spark)}/fieldloom/{uuid.uuid4().hex}"
    points, edges = dataset(*grid(spark, d))
    approximation.write_compressed(points, edges, 0.1, path)
    return approximation.read_compressed(spark, path)


@register("mandatory_critical_points")
def mandatory_critical_points(spark, d):
    points, edges = dataset(*grid(spark, d))
    bounds = points.select("dataset", "vid", (F.col("v") * 0.9).alias("lo"), (F.col("v") * 1.1).alias("hi"))
    return approximation.mandatory_extrema(bounds, edges)


@register("contours_around_points")
def contours_around_points(spark, d):
    points, _, edges = surface(spark, d)
    diagram = written(topology.persistence_diagram(*dataset(points, edges)), "diagram")
    tops = [r.v for r in diagram.where("PairType = 1").orderBy((F.col("Birth") - F.col("Death"))).select(F.col("death_vertex").alias("v")).limit(5).collect()]
    return approximation.contours_around(points, edges, diagram, tops, least=2)[1]


@register("harmonic_field")
def harmonic_field(spark, d):
    points, edges = dataset(*grid(spark, d))
    held = spark.createDataFrame([(0, 0, 0.0), (0, NX * NY - 1, 1.0)], "dataset long, vid long, v double")
    return embedding.harmonic_field(points, edges, held).withColumn("v", F.round("v", 6))


@register("eigen_field")
def eigen_field(spark, d):
    points, edges = _series(spark, d)
    return embedding.eigen_fields(points, edges, 3).select("dataset", "vid", *[F.round(c, 6).alias(c) for c in ("Minimum", "Maximum", "Sum", "Average")])


@register("pca")
def pca(spark, d):
    flat = read_table(spark, d, "embeddings").select("vec_id", *[F.get("embedding", i).alias(f"e{i}") for i in range(64)])
    return embedding.pca(flat, "vec_id", [f"e{i}" for i in range(64)]).select("vec_id", *[F.round(f"Component_{k}", 5).alias(f"Component_{k}") for k in range(2)])


@register("dimension_reduction_mds")
def dimension_reduction_mds(spark, d):
    return embedding.reduce_dimension(read_table(spark, d, "embeddings"), "vec_id", "embedding", "MDS", by="label")


@register("dimension_reduction_topomap")
def dimension_reduction_topomap(spark, d):
    return embedding.reduce_dimension(read_table(spark, d, "embeddings"), "vec_id", "embedding", "TopoMap", by="label")


@register("bottleneck_distance")
def bottleneck_distance(spark, d):
    points, edges = _series(spark, d)
    diagram = written(topology.persistence_diagram(points, edges), "diagram")
    first, second = [r.dataset for r in diagram.select("dataset").distinct().orderBy("dataset").limit(2).collect()]
    return comparison.matching_costs(comparison.diagram_matching(diagram, first, second, None), None)


@register("diagram_clustering")
def diagram_clustering(spark, d):
    return comparison.cluster_diagrams(topology.persistence_diagram(*_series(spark, d)), 2)[0]


@register("principal_geodesics")
def principal_geodesics(spark, d):
    points, axes, coefficients = comparison.principal_geodesics(topology.persistence_diagram(*_series(spark, d)))
    return comparison.decode_geodesics(points, axes, coefficients).select("dataset", "n", "PairType", F.round("Birth", 5).alias("Birth"), F.round("Death", 5).alias("Death"))


@register("merge_tree_distance_matrix")
def merge_tree_distance_matrix(spark, d):
    trees = comparison.branch_trees(topology.merge_tree(*_series(spark, d)))
    return comparison.tree_distance_matrix(written(trees, "trees")).withColumn("d", F.round("d", 6))


@register("merge_tree_clustering")
def merge_tree_clustering(spark, d):
    trees = comparison.branch_trees(topology.merge_tree(*_series(spark, d)))
    return comparison.cluster_by_distance(comparison.tree_distance_matrix(written(trees, "trees")), 2)


@register("tracking_from_fields")
def tracking_from_fields(spark, d):
    """Yearly curves of monthly sums, a diagram for each, and the trajectories of their pairs."""
    years = read_table(spark, d, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("dataset"), F.month("l_shipdate").cast("long").alias("vid")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double").alias("v"))
    points = written(years, "years")
    edges = points.select("dataset", "vid", F.explode(F.array(F.col("vid") - 1, F.col("vid") + 1)).alias("nvid"))
    return comparison.trajectories(comparison.track_diagrams(topology.persistence_diagram(points, edges)))


@register("temporal_reduction")
def temporal_reduction(spark, d):
    frames = read_table(spark, d, "lineitem").groupBy(((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1).cast("long").alias("t"), F.col("l_linenumber").alias("vid")).agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("v"))
    frames = written(frames, "frames")
    return comparison.restore_series(comparison.reduce_series(frames, 24), frames)

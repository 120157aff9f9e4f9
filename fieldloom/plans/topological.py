"""Registered queries of the mesh and topology operators, on a grid of months by quantities."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import mesh, topology
from fieldloom.plans.registry import register
from fieldloom.session import read_table, written

NX, NY = 96, 50
_GRID = f"""s AS (SELECT (year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1 AS i, CAST(l_quantity AS INT) - 1 AS j, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS v FROM lineitem GROUP BY 1, 2),
g AS (SELECT i, j, i + {NX} * j AS vid, coalesce(v, 0) AS v FROM (SELECT i, j FROM (SELECT unnest(range({NX})) AS i) CROSS JOIN (SELECT unnest(range({NY})) AS j)) LEFT JOIN s USING (i, j)),
e AS (SELECT vid, slot, i + dx + {NX} * (j + dy) AS nvid FROM g, (VALUES (0, -1, 0), (1, 0, -1), (2, 1, -1), (3, 1, 0), (4, 0, 1), (5, -1, 1)) o(slot, dx, dy) WHERE i + dx BETWEEN 0 AND {NX - 1} AND j + dy BETWEEN 0 AND {NY - 1}),
n AS (SELECT e.vid, slot, nvid, a.v AS v, b.v AS nv FROM e JOIN g a ON a.vid = e.vid JOIN g b ON b.vid = e.nvid)"""


def grid(spark, d):
    """(vid, i, j, v): sums of prices, in cents, by month and quantity; 0 where nothing was sold."""
    sums = read_table(spark, d, "lineitem").groupBy(((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1).alias("i"), (F.col("l_quantity").cast("int") - 1).alias("j")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("v"))
    cells = spark.range(NX * NY).select(F.col("id").alias("vid"), (F.col("id") % NX).cast("int").alias("i"), F.floor(F.col("id") / NX).cast("int").alias("j"))
    points = written(cells.join(sums, ["i", "j"], "left").select("vid", "i", "j", F.coalesce("v", F.lit(0)).alias("v")), "grid")
    return points, mesh.stencil_edges(points, NX, NY)


def dataset(points, edges):
    return points.withColumn("dataset", F.lit(0).cast("long")).withColumn("v", F.col("v").cast("double")), edges.withColumn("dataset", F.lit(0).cast("long"))


@register("neighbour_average", f"WITH {_GRID} SELECT vid, round(avg(nv), 4) AS average FROM n GROUP BY vid")
def neighbour_average(spark, d):
    return mesh.neighbour_average(*grid(spark, d)).withColumn("average", F.round("average", 4))


@register("scalar_field_smoother", f"WITH {_GRID}, s1 AS (SELECT vid, (any_value(v) + sum(nv)) / (count(*) + 1)::DOUBLE AS v FROM n GROUP BY vid), s2 AS (SELECT e.vid, (any_value(a.v) + sum(b.v)) / (count(*) + 1)::DOUBLE AS v FROM e JOIN s1 a ON a.vid = e.vid JOIN s1 b ON b.vid = nvid GROUP BY e.vid) SELECT vid, round(v, 3) AS v FROM s2")
def scalar_field_smoother(spark, d):
    points, edges = grid(spark, d)
    return mesh.smooth(points.select("vid", F.col("v").cast("double").alias("v")), edges, 2).withColumn("v", F.round("v", 3))


@register("morphological_closing", f"WITH {_GRID}, a AS (SELECT vid, greatest(any_value(v), max(nv)) AS v FROM n GROUP BY vid), b AS (SELECT e.vid, least(any_value(x.v), min(y.v)) AS v FROM e JOIN a x ON x.vid = e.vid JOIN a y ON y.vid = nvid GROUP BY e.vid) SELECT vid, v FROM b")
def morphological_closing(spark, d):
    points, edges = grid(spark, d)
    return mesh.morphology(points.select("vid", "v"), edges, "de")


@register("critical_points_2d", f"""WITH {_GRID}, r AS (SELECT vid, slot, (nv, nvid) > (v, vid) AS up FROM n),
p AS (SELECT a.vid, a.slot, a.up, b.up AS before FROM r a LEFT JOIN r b ON a.vid = b.vid AND b.slot = (a.slot + 5) % 6),
c AS (SELECT vid, count(*) AS k, count(*) FILTER (NOT up AND (before IS NULL OR before)) AS lo, count(*) FILTER (up AND (before IS NULL OR NOT before)) AS hi, bool_and(up) AS allup, bool_or(up) AS anyup FROM p GROUP BY vid),
t AS (SELECT vid, CASE WHEN k = 6 AND NOT anyup THEN 1 ELSE lo END AS n_lower, CASE WHEN k = 6 AND allup THEN 1 ELSE hi END AS n_upper, (k < 6)::TINYINT AS "IsOnBoundary" FROM c)
SELECT vid, n_lower, n_upper, CASE WHEN n_lower = 0 THEN 0 WHEN n_upper = 0 THEN 3 WHEN n_lower = 1 AND n_upper = 1 THEN 5 WHEN n_lower > 2 OR n_upper > 2 THEN 4 ELSE 1 END AS "CriticalType", "IsOnBoundary" FROM t""")
def critical_points_2d(spark, d):
    return mesh.critical_points(*grid(spark, d))


@register("path_compression", f"""WITH RECURSIVE {_GRID}, hi AS (SELECT vid, CASE WHEN (max(row(nv, nvid))) > row(any_value(v), vid) THEN arg_max(nvid, row(nv, nvid)) ELSE vid END AS nx FROM n GROUP BY vid),
lo AS (SELECT vid, CASE WHEN (min(row(nv, nvid))) < row(any_value(v), vid) THEN arg_min(nvid, row(nv, nvid)) ELSE vid END AS nx FROM n GROUP BY vid),
h AS (SELECT vid, nx FROM hi UNION SELECT h.vid, hi.nx FROM h JOIN hi ON hi.vid = h.nx), l AS (SELECT vid, nx FROM lo UNION SELECT l.vid, lo.nx FROM l JOIN lo ON lo.vid = l.nx)
SELECT h.vid, l.nx AS "AscendingManifold", h.nx AS "DescendingManifold" FROM h JOIN hi ON hi.vid = h.nx AND hi.nx = h.nx JOIN l ON l.vid = h.vid JOIN lo ON lo.vid = l.nx AND lo.nx = l.nx""")
def path_compression(spark, d):
    return mesh.path_compression(*grid(spark, d))


@register("connected_components", f"""WITH RECURSIVE {_GRID}, m AS (SELECT vid FROM g WHERE v > (SELECT quantile_disc(v, 0.7) FROM g)), me AS (SELECT e.vid, nvid FROM e JOIN m USING (vid) WHERE nvid IN (SELECT vid FROM m)),
c(vid, c) AS (SELECT vid, vid FROM m UNION SELECT nvid, c FROM c JOIN me USING (vid) WHERE c > nvid), k AS (SELECT vid, max(c) AS c FROM c GROUP BY vid), z AS (SELECT c, count(*) AS n FROM k GROUP BY c)
SELECT vid, coalesce(c, -1) AS "ComponentId", coalesce(n, 0) AS "ComponentSize" FROM g LEFT JOIN k USING (vid) LEFT JOIN z USING (c)""")
def connected_components(spark, d):
    points, edges = grid(spark, d)
    ranked = points.agg(F.expr("percentile_disc(0.7) WITHIN GROUP (ORDER BY v)").alias("t")).first().t
    return mesh.connected_components(points, edges, ranked)


@register("distance_field", f"""WITH {_GRID}, src AS (SELECT vid AS s, i AS si, j AS sj FROM g WHERE vid IN (0, {NX * NY - 1}, {NX * 25 + 40})), d AS (SELECT vid, s, CASE WHEN (i - si) * (j - sj) >= 0 THEN abs(i - si) + abs(j - sj) ELSE greatest(abs(i - si), abs(j - sj)) END::DOUBLE AS d FROM g, src)
SELECT vid, d AS distance, s AS source FROM d QUALIFY row_number() OVER (PARTITION BY vid ORDER BY d, s) = 1""")
def distance_field(spark, d):
    return mesh.distance_field(*grid(spark, d), [0, NX * NY - 1, NX * 25 + 40])


@register("integral_lines", f"""WITH RECURSIVE {_GRID}, hi AS (SELECT vid, CASE WHEN (max(row(nv, nvid))) > row(any_value(v), vid) THEN arg_max(nvid, row(nv, nvid)) ELSE vid END AS nx FROM n GROUP BY vid),
l(s, step, vid) AS (SELECT vid, 0::BIGINT, vid FROM g WHERE vid IN (0, 1000, 2500) UNION ALL SELECT l.s, l.step + 1, hi.nx FROM l JOIN hi USING (vid) WHERE hi.nx <> l.vid) SELECT s AS "SeedIdentifier", step, vid FROM l""")
def integral_lines(spark, d):
    return mesh.integral_lines(*grid(spark, d), [0, 1000, 2500])


@register("persistence_diagram_grid")
def persistence_diagram_grid(spark, d):
    return topology.persistence_diagram(*dataset(*grid(spark, d)))


@register("persistence_curve", 'WITH p AS (SELECT c_nationkey % 3 AS "PairType", round(greatest(max(o_totalprice) - min(o_totalprice), 1e-6), 2) AS "Persistence" FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey) SELECT DISTINCT a."PairType", a."Persistence", (SELECT count(*) FROM p b WHERE b."PairType" = a."PairType" AND b."Persistence" >= a."Persistence") AS "NumberOfPairs" FROM p a WHERE a."Persistence" > 0')
def persistence_curve(spark, d):
    """The curve of a diagram of customers: their least and greatest orders as birth and death."""
    orders = read_table(spark, d, "orders").join(read_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    pairs = orders.groupBy("c_custkey", (F.col("c_nationkey") % 3).alias("PairType")).agg(F.round(F.max("o_totalprice") - F.min("o_totalprice"), 2).alias("Persistence"))
    return topology.persistence_curve(pairs, ["PairType"]).withColumn("Persistence", F.round("Persistence", 2)).where("Persistence > 0")


@register("persistence_curve_grid")
def persistence_curve_grid(spark, d):
    diagram = persistence_diagram_grid(spark, d).withColumn("Persistence", F.col("Death") - F.col("Birth"))
    return topology.persistence_curve(diagram, ["PairType"])


@register("merge_tree_grid")
def merge_tree_grid(spark, d):
    return topology.merge_tree(*dataset(*grid(spark, d)))


@register("topological_simplification")
def topological_simplification(spark, d):
    return topology.simplify(*dataset(*grid(spark, d)), 1e7)


def _series(spark, d):
    """A path graph of daily sums of values for each type of event."""
    events = read_table(spark, d, "events").groupBy(F.xxhash64("event_type").alias("dataset"), F.datediff("ts", F.lit("1970-01-01")).cast("long").alias("vid")).agg(F.round(F.sum("value"), 6).alias("v"))
    points = written(events, "series")
    edges = points.select("dataset", "vid", F.explode(F.array(F.col("vid") - 1, F.col("vid") + 1)).alias("nvid"))
    return points, edges


@register("diagram_distance_matrix")
def diagram_distance_matrix(spark, d):
    return topology.diagram_distance_matrix(topology.persistence_diagram(*_series(spark, d)))


_TRACK = "t AS (SELECT DISTINCT date_diff('day', DATE '1970-01-01', ts::DATE) AS t, event_type AS l, user_id AS p FROM events)"


def _tracked(spark, d):
    return read_table(spark, d, "events").select(F.datediff("ts", F.lit("1970-01-01")).cast("long").alias("t"), "event_type", "user_id")


@register("tracking_overlap_nodes", f'WITH {_TRACK} SELECT t AS "SequenceIndex", l AS "Label", count(*) AS "Size" FROM t GROUP BY t, l')
def tracking_overlap_nodes(spark, d):
    return topology.overlap_nodes(_tracked(spark, d), "t", "event_type", "user_id")


@register("tracking_overlap_edges", f'WITH {_TRACK} SELECT x.t AS "SequenceIndex", x.l AS a, y.l AS b, count(*) AS "Overlap" FROM t x JOIN t y ON y.t = x.t + 1 AND x.p = y.p GROUP BY ALL')
def tracking_overlap_edges(spark, d):
    return topology.overlap_edges(_tracked(spark, d), "t", "event_type", "user_id")


@register("tracking_overlap_branches", f"""WITH RECURSIVE {_TRACK}, e AS (SELECT x.t AS t, x.l AS a, y.l AS b, count(*) AS n FROM t x JOIN t y ON y.t = x.t + 1 AND x.p = y.p GROUP BY ALL),
f AS (SELECT t, a, b FROM e QUALIFY row_number() OVER (PARTITION BY t, a ORDER BY n DESC, b DESC) = 1), l AS (SELECT t, a, b FROM e QUALIFY row_number() OVER (PARTITION BY t, b ORDER BY n DESC, a DESC) = 1),
k AS (SELECT f.t + 1 AS t, f.b AS l, f.a AS before FROM f JOIN l ON f.t = l.t AND f.a = l.a AND f.b = l.b), nodes AS (SELECT DISTINCT t, l FROM t),
h(t, l, head) AS (SELECT t, l, concat(t, ':', l) FROM nodes WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.t = nodes.t AND k.l = nodes.l) UNION ALL SELECT k.t, k.l, h.head FROM h JOIN k ON k.t = h.t + 1 AND k.before = h.l)
SELECT t AS "SequenceIndex", l AS "Label", head FROM h""")
def tracking_overlap_branches(spark, d):
    df = written(_tracked(spark, d), "tracked")
    return topology.overlap_branches(topology.overlap_nodes(df, "t", "event_type", "user_id"), topology.overlap_edges(df, "t", "event_type", "user_id"))

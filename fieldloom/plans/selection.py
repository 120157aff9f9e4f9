"""Registered queries of the table and block operators that `tabular` leaves out, and of sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldloom.operators import blocks, mesh, metrics, pairs, tables
from fieldloom.plans.registry import register
from fieldloom.plans.tabular import _DISTANCES, _MONTHS, _years
from fieldloom.session import read_table, shared_dir
from fieldloom.sources import cinema, meshfiles


@register("data_set_to_table", "SELECT vec_id, label FROM embeddings")
def data_set_to_table(spark, d):
    return tables.data_set_to_table(read_table(spark, d, "embeddings"))


@register("point_data_selector", "SELECT s_suppkey, s_acctbal AS balance FROM supplier")
def point_data_selector(spark, d):
    return tables.select_point_data(read_table(spark, d, "supplier"), ["s_acctbal"], "balance", ("s_suppkey",))


@register("array_editor_add", "SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def array_editor_add(spark, d):
    other = read_table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return tables.add_arrays(read_table(spark, d, "orders").select("o_orderkey", "o_custkey"), other, ["c_mktsegment"], "o_custkey")


@register("array_editor_reindex", "SELECT vec_id, t AS tuple_id, embedding[4 * t + 1]::DOUBLE AS a, embedding[4 * t + 4]::DOUBLE AS b FROM embeddings, (SELECT unnest(range(16)) AS t)")
def array_editor_reindex(spark, d):
    out = tables.reindex(read_table(spark, d, "embeddings"), "vec_id", "embedding", 4)
    return out.select("vec_id", F.col("tuple_id").cast("long").alias("tuple_id"), F.get("embedding", 0).cast("double").alias("a"), F.get("embedding", 3).cast("double").alias("b"))


@register("identifiers", 'SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS "PointIdentifiers" FROM orders')
def identifiers(spark, d):
    df = read_table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return tables.identifiers(df, [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "PointIdentifiers")


@register("identifier_randomizer", "WITH n AS (SELECT c_nationkey, row_number() OVER (ORDER BY md5(concat('7:', c_nationkey)), c_nationkey) - 1 AS k FROM (SELECT DISTINCT c_nationkey FROM customer)) SELECT c_custkey, k AS c_nationkey FROM customer JOIN n USING (c_nationkey)")
def identifier_randomizer(spark, d):
    return tables.randomize_identifiers(read_table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 7)


@register("order_array", 'SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS "c_acctbal_Order" FROM customer')
def order_array(spark, d):
    return tables.order_array(read_table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey").drop("c_acctbal")


@register("import_embedding", "SELECT s_suppkey, s_acctbal AS x, s_nationkey::DOUBLE AS y, 0.0::DOUBLE AS z FROM supplier")
def import_embedding(spark, d):
    df = read_table(spark, d, "supplier")
    points = df.select("s_suppkey", *[F.lit(0.0).alias(c) for c in "xyz"])
    return tables.embed(points, df.withColumn("n", F.col("s_nationkey").cast("double")), "s_suppkey", "s_acctbal", "n")


@register("projection_from_field", "SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice AS y, 0.0::DOUBLE AS z FROM part")
def projection_from_field(spark, d):
    return tables.project_from_fields(read_table(spark, d, "part"), "p_size", "p_retailprice").select("p_partkey", "x", "y", "z")


_CELLS = "c AS (SELECT year(l_shipdate) AS u, month(l_shipdate) AS v, min(l_orderkey * 10 + l_linenumber) AS p FROM lineitem GROUP BY 1, 2), k AS (SELECT p, dense_rank() OVER (ORDER BY u) - 1 AS iu, dense_rank() OVER (ORDER BY v) - 1 AS iv FROM c)"


@register("point_set_to_surface", f"WITH {_CELLS} SELECT a.iu, a.iv, a.p AS p00, b.p AS p10, c.p AS p11, e.p AS p01 FROM k a JOIN k b ON b.iu = a.iu + 1 AND b.iv = a.iv JOIN k c ON c.iu = a.iu + 1 AND c.iv = a.iv + 1 JOIN k e ON e.iu = a.iu AND e.iv = a.iv + 1")
def point_set_to_surface(spark, d):
    df = read_table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("u"), F.month("l_shipdate").alias("v")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("p"))
    return tables.surface_quads(df, "u", "v", "p")


@register("block_aggregator", "SELECT 0 AS block_id, n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT 1, r_regionkey, r_name FROM region")
def block_aggregator(spark, d):
    return blocks.aggregate_blocks([read_table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), read_table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))])


@register("for_each", "SELECT c_mktsegment, count(*) AS n, round(max(c_acctbal) - min(c_acctbal), 2) AS span FROM customer GROUP BY c_mktsegment")
def for_each(spark, d):
    import pandas as pd

    def body(pdf):
        return pd.DataFrame({"c_mktsegment": [pdf["c_mktsegment"].iloc[0]], "n": [len(pdf)], "span": [round(pdf["c_acctbal"].max() - pdf["c_acctbal"].min(), 2)]})

    return blocks.for_each(read_table(spark, d, "customer").select("c_mktsegment", "c_acctbal"), "c_mktsegment", body, "c_mktsegment string, n long, span double")


@register("block_tuples", "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS block_id, dense_rank() OVER (ORDER BY c_nationkey) - 1 AS tuple_id FROM customer")
def block_tuples(spark, d):
    return blocks.block_tuples(read_table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_nationkey", "c_mktsegment").select("c_custkey", "block_id", "tuple_id")


@register("grid_layout", "WITH p AS (SELECT c_custkey, c_nationkey AS b, c_acctbal AS x, (c_custkey % 50)::DOUBLE AS y FROM customer), m AS (SELECT max(w) AS w, max(h) AS h FROM (SELECT max(x) - min(x) AS w, max(y) - min(y) AS h FROM p GROUP BY b)) SELECT c_custkey, b, round(x + (b % 5) * (w + 1), 4) AS x, round(y + (b // 5) * (h + 1), 4) AS y FROM p, m")
def grid_layout(spark, d):
    points = read_table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("b"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 50).cast("double").alias("y"))
    return blocks.grid_layout(points, "b", 5).withColumns({c: F.round(c, 4) for c in "xy"})


@register("extract_blocks", "SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 7, 11)")
def extract_blocks(spark, d):
    return blocks.extract_blocks(read_table(spark, d, "customer"), "c_nationkey", [3, 7, 11]).select("c_custkey")


@register("extract_geometry", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (1, 2, 3)")
def extract_geometry(spark, d):
    return blocks.extract_geometry(read_table(spark, d, "supplier"), "s_nationkey", "!=", [1, 2, 3]).select("s_suppkey")


_ORDER_CELLS = "c AS (SELECT o_orderkey AS cid, unnest([o_custkey, (o_custkey + 1) % (SELECT count(*) FROM customer)]) AS vid FROM orders)"


@register("extract_cells", f"WITH {_ORDER_CELLS} SELECT cid FROM c JOIN customer ON vid = c_custkey GROUP BY cid HAVING bool_and(c_acctbal > 3000)")
def extract_cells(spark, d):
    customer = read_table(spark, d, "customer").select(F.col("c_custkey").alias("vid"), "c_acctbal")
    cells = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("cid"), F.array("o_custkey", (F.col("o_custkey") + 1) % customer.count()).alias("verts"))
    return blocks.extract_cells(cells, customer, "c_acctbal", ">", [3000.0]).select("cid")


@register("extract_array_values", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (2, 5)")
def extract_array_values(spark, d):
    return blocks.extract_array_values(read_table(spark, d, "nation"), "n_name", "n_nationkey", [2, 5])


@register("extract_arrays", "SELECT n_regionkey, n_nationkey FROM nation")
def extract_arrays(spark, d):
    return blocks.extract_arrays(read_table(spark, d, "nation"), [2, 0])


_TWO = f"y AS ({_MONTHS}), t AS (SELECT a.vid, a.v AS a, b.v AS b FROM y a JOIN y b USING (vid) WHERE a.block = 1995 AND b.block = 1996)"


def _two_years(spark, d):
    y = _years(spark, d)
    side = lambda block, name: y.where(F.col("block") == block).select("vid", F.col("v").alias(name))
    return side(1995, "a").join(side(1996, "b"), "vid")


@register("l_distance", f'WITH {_TWO} SELECT round(sum(abs(a - b) ** 3) ** (1 / 3.0::DOUBLE), 6) AS "LDistance" FROM t')
def l_distance(spark, d):
    return metrics.l_distance(_two_years(spark, d), "a", "b", 3).select(F.round("LDistance", 6).alias("LDistance"))


@register("l_distance_field", f'WITH {_TWO} SELECT vid, abs(a - b) AS "LDistanceField" FROM t')
def l_distance_field(spark, d):
    return metrics.l_distance_field(_two_years(spark, d), "a", "b", None).select("vid", "LDistanceField")


_BOTH = f"WITH e AS (SELECT vec_id, embedding FROM embeddings), m AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))) AS dh, sqrt(list_sum(list_transform(list_zip(a.embedding[1:8], b.embedding[1:8]), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))) AS dl FROM e a JOIN e b ON a.vec_id < b.vec_id)"


@register("distance_matrix_distortion", _BOTH + ', s AS (SELECT i, j, (dl - dh) ** 2 AS x FROM m UNION ALL SELECT j, i, (dl - dh) ** 2 FROM m) SELECT i, round(1 - sum(x) / (SELECT max(x) FROM s) / (count(*) + 1), 6) AS "SimValue" FROM s GROUP BY i')
def distance_matrix_distortion(spark, d):
    df = read_table(spark, d, "embeddings")
    out = pairs.distortion(df.withColumn("low", F.slice("embedding", 1, 8)), "vec_id", "low", "embedding")
    return out.withColumn("SimValue", F.round("SimValue", 6))


@register("rips_edges", f'WITH {_DISTANCES} SELECT i AS a, j AS b, round(d, 5) AS "Diameter" FROM m WHERE d < 1.2')
def rips_edges(spark, d):
    found = pairs.edges(read_table(spark, d, "embeddings"), "vec_id", "embedding", 1.2)
    return found.select(F.col("i").alias("a"), F.col("j").alias("b"), F.round("d", 5).alias("Diameter"))


@register("rips_point_diameters", f'WITH {_DISTANCES}, f AS (SELECT unnest([i, j]) AS p, d FROM m WHERE d < 1.2) SELECT vec_id AS p, round(coalesce(least(min(d), 1.2), 0), 5) AS "MinDiameter", round(coalesce(avg(d), 0), 5) AS "MeanDiameter", round(coalesce(max(d), 0), 5) AS "MaxDiameter" FROM embeddings LEFT JOIN f ON p = vec_id GROUP BY vec_id')
def rips_point_diameters(spark, d):
    df = read_table(spark, d, "embeddings")
    out = metrics.point_diameters(df.select(F.col("vec_id").alias("p")), pairs.edge_statistics(df, "vec_id", "embedding", 1.2), 1.2)
    return out.withColumns({c: F.round(c, 5) for c in out.columns if c != "p"})


@register("gaussian_density", f'WITH {_DISTANCES}, s AS (SELECT i, d FROM m UNION ALL SELECT j, d FROM m) SELECT i AS p, round(2 + sum(exp(-d * d / 0.5)), 5) AS "GaussianDensity" FROM s GROUP BY i')
def gaussian_density(spark, d):
    df = read_table(spark, d, "embeddings")
    out = metrics.density(df.select(F.col("vec_id").alias("p")), pairs.gaussian_sums(df, "vec_id", "embedding", 0.5))
    return out.withColumn("GaussianDensity", F.round("GaussianDensity", 5))


@register("rips_components", f'WITH RECURSIVE {_DISTANCES}, n AS MATERIALIZED (SELECT i AS a, j AS b FROM m WHERE d < 1.15 UNION ALL SELECT j, i FROM m WHERE d < 1.15), t(v, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT n.b, t.c FROM t JOIN n ON n.a = t.v WHERE t.c > n.b) SELECT v AS vid, max(c) AS "ComponentId" FROM t GROUP BY v')
def rips_components(spark, d):
    df = read_table(spark, d, "embeddings")
    return mesh.components(df.select(F.col("vec_id").alias("vid")), pairs.links(df, "vec_id", "embedding", 1.15))


@register("critical_points_1d", """WITH s AS (SELECT event_type, date_diff('day', DATE '1970-01-01', ts::DATE) AS t, round(sum(value), 6) AS v FROM events GROUP BY 1, 2),
w AS (SELECT *, lag((v, t)) OVER o AS b, lead((v, t)) OVER o AS a FROM s WINDOW o AS (PARTITION BY event_type ORDER BY t))
SELECT event_type, t, CASE WHEN NOT coalesce(b < (v, t), false) AND NOT coalesce(a < (v, t), false) THEN 0 WHEN NOT coalesce(b > (v, t), false) AND NOT coalesce(a > (v, t), false) THEN 1 ELSE -1 END AS "CriticalType" FROM w""")
def critical_points_1d(spark, d):
    s = read_table(spark, d, "events").groupBy("event_type", F.datediff("ts", F.lit("1970-01-01")).cast("long").alias("t")).agg(F.round(F.sum("value"), 6).alias("v"))
    return mesh.critical_points_1d(s, ["event_type"], "t", "v").select("event_type", "t", "CriticalType")


@register("point_merger", """WITH RECURSIVE p AS (SELECT s_suppkey AS vid, s_acctbal AS x FROM supplier), n AS (SELECT a.vid AS a, b.vid AS b FROM p a JOIN p b ON a.vid <> b.vid AND abs(a.x - b.x) < 20),
t(v, c) AS (SELECT vid, vid FROM p UNION SELECT n.b, t.c FROM t JOIN n ON n.a = t.v WHERE t.c < n.b) SELECT v AS vid, min(c) AS representative FROM t GROUP BY v""")
def point_merger(spark, d):
    points = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("vid"), F.col("s_acctbal").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return mesh.merge_points(points, 20.0)


# --- sources and sinks, by way of the shared folder -----------------------------------------


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/fieldloom/{uuid.uuid4().hex}"


@register("cinema_write_read", "SELECT n_regionkey::VARCHAR AS region, n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) ELSE n_name END AS n_name FROM nation")
def cinema_write_read(spark, d):
    """One product for each region, written into a catalog, one of them twice, and all read back."""
    base, nation = f"{_folder(spark)}/nations.cdb", read_table(spark, d, "nation")
    for region in range(5):
        cinema.write_product(nation.where(F.col("n_regionkey") == region).select("n_nationkey", "n_name"), base, {"region": region})
    again = nation.where("n_regionkey = 1").select("n_nationkey", F.upper("n_name").alias("n_name"))
    cinema.write_product(again, base, {"region": 1})
    rows = cinema.read_products(cinema.read_catalog(spark, base))
    return rows.select(F.col("region").cast("string").alias("region"), "n_nationkey", "n_name")


def _triangles(spark, d):
    """A fan of triangles over the suppliers' balances."""
    points = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("vid"), F.col("s_suppkey").cast("double").alias("x"), F.round("s_acctbal", 2).alias("y"), F.lit(0.5).alias("z"))
    cells = points.where("vid > 1").select((F.col("vid") - 2).alias("cid"), F.array(F.lit(0).cast("long"), F.col("vid") - 1, F.col("vid")).alias("verts"))
    return points, cells


@register("off_round_trip", "SELECT s_suppkey AS vid, s_suppkey::FLOAT AS x, round(s_acctbal, 2)::FLOAT AS y, 0.5::FLOAT AS z, (SELECT count(*) FROM supplier) - 2 AS n_cells FROM supplier")
def off_round_trip(spark, d):
    path = f"{_folder(spark)}/mesh.off"
    meshfiles.write_lines(meshfiles.off_lines(*_triangles(spark, d)), path)
    points, cells = meshfiles.read_off(spark, path)
    return points.withColumn("n_cells", F.lit(cells.count()))


@register("obj_writer", "SELECT s_suppkey + (SELECT count(*) FROM supplier) - 2 AS n, concat('f 1 ', s_suppkey, ' ', s_suppkey + 1) AS value FROM supplier WHERE s_suppkey > 1")
def obj_writer(spark, d):
    return meshfiles.obj_lines(*_triangles(spark, d)).where(F.col("value").startswith("f"))


@register("wrl_exporter", "SELECT concat('0, ', s_suppkey - 1, ', ', s_suppkey, ', -1,') AS value FROM supplier WHERE s_suppkey > 1")
def wrl_exporter(spark, d):
    return meshfiles.wrl_lines(*_triangles(spark, d)).where(F.col("value").endswith("-1,")).select("value")

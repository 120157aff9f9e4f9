"""Registered queries of the table, block and metric operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import blocks, metrics, pairs, tables
from fieldloom.plans.registry import register
from fieldloom.session import read_table
from fieldloom.sources import cinema

_JOIN = """
SELECT c.c_mktsegment AS segment, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS total
FROM {o} o JOIN {c} c ON o.o_custkey = c.c_custkey WHERE o.o_orderpriority LIKE '1%' GROUP BY c.c_mktsegment
"""
_WINDOW = """
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n,
  round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS recent
FROM {o}
"""
_SETS = """
SELECT s_nationkey AS nationkey FROM {s} INTERSECT SELECT c_nationkey FROM {c} EXCEPT SELECT n_nationkey FROM {n} WHERE n_regionkey = 0
"""


@register("cinema_query_join", _JOIN.format(o="orders", c="customer"))
def cinema_query_join(spark, d):
    return cinema.query(spark, _JOIN.format(o="InputTable0", c="InputTable1"), [read_table(spark, d, "orders"), read_table(spark, d, "customer")])


@register("cinema_query_window", _WINDOW.format(o="orders"))
def cinema_query_window(spark, d):
    return cinema.query(spark, _WINDOW.format(o="InputTable0"), [read_table(spark, d, "orders")])


@register("cinema_query_sets", _SETS.format(s="supplier", c="customer", n="nation"))
def cinema_query_sets(spark, d):
    return cinema.query(spark, _SETS.format(s="InputTable0", c="InputTable1", n="InputTable2"), [read_table(spark, d, t) for t in ("supplier", "customer", "nation")])


@register("catalog_upsert", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT n_nationkey, upper(n_name), n_regionkey FROM nation WHERE n_regionkey = 1")
def catalog_upsert(spark, d):
    nation = read_table(spark, d, "nation")
    return cinema.upsert(nation, nation.where("n_regionkey = 1").withColumn("n_name", F.upper("n_name")), ["n_nationkey"])


@register("table_data_selector", "SELECT c_custkey, c_acctbal FROM customer")
def table_data_selector(spark, d):
    return tables.select_columns(read_table(spark, d, "customer"), pattern="c_(custkey|acctbal|name)")


@register("array_editor", "SELECT p_partkey AS part, CAST(p_size AS DOUBLE) AS p_size, 1.5::DOUBLE AS weight FROM part")
def array_editor(spark, d):
    df = tables.edit_array(tables.edit_array(read_table(spark, d, "part"), "p_partkey", "part"), "p_size", kind="double")
    return tables.add_constants(tables.remove_arrays(df, ["p_name", "p_brand", "p_type", "p_retailprice"]), "weight,1.5")


@register("point_data_converter", "SELECT o_orderkey, floor((o_totalprice - lo) / (hi - lo) * 65535.0::DOUBLE - 32768.0::DOUBLE)::SMALLINT AS o_totalprice FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)")
def point_data_converter(spark, d):
    return tables.convert_point_data(read_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "smallint", rescale=True)


@register("scalar_field_normalizer", "SELECT o_orderkey, round((o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()) + 1e-6::DOUBLE, 6) AS v FROM orders")
def scalar_field_normalizer(spark, d):
    out = tables.normalize(read_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", out="v")
    return out.select("o_orderkey", F.round("v", 6).alias("v"))


@register("string_array_converter", "SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brandInt FROM part")
def string_array_converter(spark, d):
    return tables.dictionary_encode(read_table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand")


@register("identify_by_scalar_field", 'SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS "PointScalarFieldName" FROM orders')
def identify_by_scalar_field(spark, d):
    return tables.identify_by_field(read_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", descending=True, start_at_one=True).drop("o_totalprice")


@register("array_order", 'SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS "l_extendedprice_Order" FROM lineitem')
def array_order(spark, d):
    order = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    df = read_table(spark, d, "lineitem").select(*order)
    return tables.global_rank(df, [F.col(c) for c in order], "l_extendedprice_Order").select("l_orderkey", "l_linenumber", "l_extendedprice_Order")


@register("texture_map", "SELECT s_suppkey, round((s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()), 6) AS tex_u, 0.0::DOUBLE AS tex_v FROM supplier")
def texture_map(spark, d):
    return tables.texture_coordinates(read_table(spark, d, "supplier"), "s_acctbal").select("s_suppkey", F.round("tex_u", 6).alias("tex_u"), "tex_v")


@register("point_set_to_curve", "SELECT c_nationkey, a, b FROM (SELECT c_nationkey, c_custkey AS a, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS b FROM customer) WHERE b IS NOT NULL")
def point_set_to_curve(spark, d):
    return tables.curve_edges(read_table(spark, d, "customer"), ["c_nationkey"], "c_acctbal", "c_custkey")


@register("extract_rows", 'SELECT p AS "Position", n_nationkey, n_name FROM (VALUES (0, 7), (1, 3), (2, 7)) v(p, k) JOIN nation ON n_nationkey = k')
def extract_rows(spark, d):
    df = read_table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    return blocks.extract_rows(df, "n_nationkey", [7, 3, 7])


@register("extract_mask", 'SELECT s_suppkey, CASE WHEN s_acctbal > 5000 OR s_acctbal > 8000 THEN 1 ELSE 0 END::TINYINT AS "Mask" FROM supplier')
def extract_mask(spark, d):
    return blocks.extract_geometry(read_table(spark, d, "supplier"), "s_acctbal", ">", [5000.0, 8000.0], mask_only=True).select("s_suppkey", "Mask")


@register("extract_unique", 'SELECT DISTINCT c_mktsegment AS "Uniquec_mktsegment" FROM customer')
def extract_unique(spark, d):
    return blocks.extract_unique(read_table(spark, d, "customer"), "c_mktsegment")


@register("merge_block_tables", "SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def merge_block_tables(spark, d):
    nation, region = read_table(spark, d, "nation"), read_table(spark, d, "region")
    return blocks.merge_block_tables([nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), region.select("r_regionkey", "r_name")])


@register("flatten_blocks", 'SELECT c_custkey, dense_rank() OVER (ORDER BY c_nationkey, c_mktsegment) - 1 AS block_id, c_nationkey AS "ParentBlockId" FROM customer')
def flatten_blocks(spark, d):
    return blocks.flatten(read_table(spark, d, "customer"), "c_nationkey", "c_mktsegment").select("c_custkey", "block_id", "ParentBlockId")


_MONTHS = "SELECT year(l_shipdate) AS block, month(l_shipdate) AS vid, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2"


def _years(spark, d):
    return read_table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("block"), F.month("l_shipdate").alias("vid")).agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("v"))


@register("l_distance_matrix", f"WITH y AS ({_MONTHS}) SELECT a.block AS i, b.block AS j, round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 6) AS d FROM y a JOIN y b USING (vid) WHERE a.block < b.block GROUP BY 1, 2")
def l_distance_matrix(spark, d):
    return metrics.l_distance_matrix(_years(spark, d), "block", "vid", "v").withColumn("d", F.round("d", 6))


@register("uncertain_data_estimator", f'WITH y AS ({_MONTHS}) SELECT vid, min(v) AS "lowerBoundField", max(v) AS "upperBoundField", round(avg(v), 6) AS "meanField" FROM y GROUP BY vid')
def uncertain_data_estimator(spark, d):
    return metrics.ensemble(_years(spark, d), "vid", "v").withColumn("meanField", F.round("meanField", 6))


@register("ensemble_histogram", f"WITH y AS ({_MONTHS}), r AS (SELECT min(v) AS lo, max(v) AS hi FROM y), b AS (SELECT vid, least(floor((v - lo) * 5 / (hi - lo)), 4)::BIGINT AS bin FROM y, r) SELECT vid, bin, round(count(*) / (sum(count(*)) OVER (PARTITION BY vid))::DOUBLE, 6) AS probability FROM b GROUP BY vid, bin")
def ensemble_histogram(spark, d):
    out = metrics.ensemble_histogram(_years(spark, d), "vid", "v", 5)
    return out.withColumn("probability", F.round("probability", 6)).withColumn("bin", F.col("bin").cast("long"))


_VECTORS = "SELECT vec_id, embedding FROM embeddings"
_DISTANCES = f"e AS ({_VECTORS}), m AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS d FROM e a JOIN e b ON a.vec_id < b.vec_id)"


def _distances(spark, d):
    return metrics.table_distance_matrix(read_table(spark, d, "embeddings"), "vec_id", "embedding")


@register("table_distance_matrix", f"WITH {_DISTANCES} SELECT i, j, round(d, 5) AS d FROM m")
def table_distance_matrix(spark, d):
    return _distances(spark, d).withColumn("d", F.round("d", 5))


@register("matrix_to_heat_map", f'WITH {_DISTANCES} SELECT i, j, round(d, 5) AS "Distance", round(exp(-d), 5) AS "Proximity" FROM m')
def matrix_to_heat_map(spark, d):
    out = tables.heat_map(_distances(spark, d), "i", "j", "d")
    return out.withColumns({c: F.round(c, 5) for c in ("Distance", "Proximity")})


@register("rips_triangles", f'WITH {_DISTANCES}, n AS MATERIALIZED (SELECT * FROM m WHERE d <= 1.2) SELECT x.i AS a, x.j AS b, y.j AS c, round(greatest(x.d, y.d, z.d), 5) AS "Diameter" FROM n x JOIN n y ON x.i = y.i AND x.j < y.j JOIN n z ON z.i = x.j AND z.j = y.j')
def rips_triangles(spark, d):
    return pairs.triangles(read_table(spark, d, "embeddings"), "vec_id", "embedding", 1.2).withColumn("Diameter", F.round("Diameter", 5))


@register("clustering_metrics", """
WITH j AS (SELECT quality AS a, toxic AS b FROM labels), c AS (SELECT a, b, count(*)::DOUBLE AS n FROM j GROUP BY ALL), ra AS (SELECT a, sum(n) AS na FROM c GROUP BY a), rb AS (SELECT b, sum(n) AS nb FROM c GROUP BY b),
t AS (SELECT sum(n) AS t FROM c), mi AS (SELECT sum(n / t * log2(n * t / (na * nb))) AS mi, sum(n * (n - 1) / 2) AS sn FROM c JOIN ra USING (a) JOIN rb USING (b), t),
ha AS (SELECT sum(-na / t * log2(na / t)) AS ha, sum(na * (na - 1) / 2) AS sa FROM ra, t), hb AS (SELECT sum(-nb / t * log2(nb / t)) AS hb, sum(nb * (nb - 1) / 2) AS sb FROM rb, t)
SELECT round(2 * mi / (ha + hb), 6) AS "NMIValue", round((sn - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) AS "ARIValue" FROM mi, ha, hb, t
""")
def clustering_metrics(spark, d):
    out = metrics.clustering_metrics(read_table(spark, d, "labels"), "quality", "toxic")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@register("statistics", "SELECT round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS var, round(covar_samp(l_quantity, l_discount), 6) AS cov, round(corr(l_quantity, l_discount), 6) AS corr FROM lineitem")
def statistics(spark, d):
    out = metrics.statistics(read_table(spark, d, "lineitem"), "l_quantity", "l_discount")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])

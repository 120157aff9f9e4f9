"""Registered queries of the relational categories, through the SQL operator where both dialects agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import pairs
from fieldloom.plans.registry import register
from fieldloom.plans.tabular import _DISTANCES
from fieldloom.session import read_table
from fieldloom.sources import cinema


def _shared(name: str, statement: str, *names: str) -> None:
    """Registers a statement, with {0}, {1}, ... for its tables, that Spark and the oracle both run."""

    @register(name, statement.format(*names))
    def run(spark, d):
        return cinema.query(spark, statement.format(*[f"InputTable{i}" for i in range(len(names))]), [read_table(spark, d, t) for t in names])


_shared("right_join", "SELECT n_name, s_suppkey FROM {1} RIGHT JOIN {0} ON s_nationkey = n_nationkey", "nation", "supplier")
_shared("full_join", "SELECT coalesce(a.k, b.k) AS nationkey, a.n AS suppliers, b.n AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM {0} GROUP BY s_nationkey) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM {1} WHERE c_acctbal > 5000 GROUP BY c_nationkey) b ON a.k = b.k", "supplier", "customer")
_shared("left_join_null_test", "SELECT c_custkey FROM {0} LEFT JOIN {1} ON c_custkey = o_custkey WHERE o_orderkey IS NULL", "customer", "orders")
_shared("sort_limit", "SELECT o_orderkey, o_totalprice FROM {0} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "orders")
_shared("correlated_subquery", "SELECT o_orderkey, o_totalprice FROM {0} o WHERE o_totalprice > (SELECT avg(i.o_totalprice) FROM {0} i WHERE i.o_custkey = o.o_custkey)", "orders")
_shared("exists_subquery", "SELECT c_custkey FROM {0} c WHERE EXISTS (SELECT 1 FROM {1} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') AND c_mktsegment IN (SELECT c_mktsegment FROM {0} GROUP BY c_mktsegment HAVING count(*) > 5)", "customer", "orders")
_shared("common_table_expression", "WITH t AS (SELECT o_custkey AS k, sum(o_totalprice) AS total FROM {0} GROUP BY o_custkey), m AS (SELECT avg(total) AS mean FROM t) SELECT k, round(total, 2) AS total FROM t, m WHERE total > 1.5 * mean", "orders")
_shared("recursive_expression", "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT) AS n, CAST(1 AS BIGINT) AS f UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT r_regionkey, n, f FROM t, {0}", "region")
_shared("string_functions", "SELECT p_partkey, upper(p_name) AS up, substr(p_type, 2, 4) AS mid, length(p_name) AS n, replace(p_brand, '#', '-') AS brand, concat(p_brand, '/', p_type) AS both, trim(concat('  ', p_type, ' ')) AS bare, lower(p_type) LIKE '%eco%' AS eco FROM {0}", "part")
_shared("date_functions", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS STRING) AS first, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS STRING) AS later FROM {0}", "orders")
_shared("math_functions", "SELECT c_custkey, abs(c_acctbal) AS a, floor(c_acctbal) AS f, round(sqrt(abs(c_acctbal)), 6) AS s, round(power(abs(c_acctbal), 0.25), 6) AS p, round(ln(1 + abs(c_acctbal)), 6) AS l, c_custkey % 7 AS m, sign(c_acctbal) AS g, greatest(c_acctbal, 0) AS pos FROM {0}", "customer")
_shared("conditional_functions", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus, 'O'), 'open') AS status FROM {0}", "orders")
_shared("aggregates_having", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS d, min(l_shipdate) AS a, max(l_shipdate) AS b, count(DISTINCT l_suppkey) AS s FROM {0} GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10", "lineitem")
_shared("window_functions", "SELECT event_id, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before, lead(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS after, rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS r, dense_rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS dr, ntile(4) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS quarter FROM {0}", "events")
_shared("theta_join", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM {0} a JOIN {0} b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal", "supplier")


@register("array_functions", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, unnest(range(len(string_split(p_name, ' ')))) AS at FROM part")
def array_functions(spark, d):
    return cinema.query(spark, "SELECT p_partkey, word, CAST(at AS BIGINT) AS at FROM InputTable0 LATERAL VIEW posexplode(split(p_name, ' ')) w AS at, word", [read_table(spark, d, "part")])


@register("json_functions", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def json_functions(spark, d):
    return cinema.query(spark, "SELECT CAST(get_json_object(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n, round(sum(value), 2) AS total FROM InputTable0 GROUP BY 1", [read_table(spark, d, "events")])


@register("substitution", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH' AND o_totalprice > 150000")
def substitution(spark, d):
    return cinema.query(spark, "SELECT o_orderkey FROM InputTable0 WHERE o_orderpriority = '{priority[1]}' AND o_totalprice > {least}", [read_table(spark, d, "orders")], {"priority": ["1-URGENT", "2-HIGH"], "least": [150000]})


@register("nearest_neighbours", f"WITH {_DISTANCES}, s AS (SELECT i, j, d FROM m UNION ALL SELECT j, i, d FROM m), r AS (SELECT i, j, round(d, 5) AS d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM s) SELECT * FROM r WHERE rank <= 5")
def nearest_neighbours(spark, d):
    return pairs.nearest(read_table(spark, d, "embeddings"), "vec_id", "embedding", 5).withColumn("d", F.round("d", 5))

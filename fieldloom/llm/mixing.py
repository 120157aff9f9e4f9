"""Mixing sources to target weights by Pareto order sampling.

Sources get words in proportion to their weights, at most `most` times what they hold; the excess
is shared anew among the others (water-filling, solved in closed form by sorting on cap/weight).
Within a source, texts of SHORT words or more are twice as likely to be taken as shorter ones.
The expected copies of a text split into certain whole copies and an inclusion probability p for
one more. Each text draws U from its id; texts are ranked by (U/(1-U)) / (p/(1-p)), and a source
takes the lowest ranks until its words are nearest to its target. The cut is found from a
histogram of ranks, so that only the texts of one bucket of BUCKETS are ever sorted.

Defined results: null texts have no words and are never taken; null sources are one source, the
last; U comes from the id alone, so repeated rows share a rank and reruns agree; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.llm.common import documents, row_key, split_words, stored

SHORT, BUCKETS, SEED = 32, 65_536, "mix"
#: Tables of sources are broadcast up to this many rows (a few dozen bytes each).
BROADCAST_ROWS = 100_000


def water_fill(df: DataFrame, by: list[str], weight: Column, cap: Column, total: Column, order: list[Column]) -> DataFrame:
    """Adds `share`: total split by weight within each group of `by`, none above cap, the excess reshared."""
    df = df.withColumns({"_w": weight, "_c": cap, "_t": total})
    ratio = F.when(F.col("_w") > 0, F.col("_c") / F.col("_w")).otherwise(F.lit(0.0))
    w = W.partitionBy(*by).orderBy(ratio, *order)
    before = F.coalesce(F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_w").over(w.rowsBetween(0, W.unboundedFollowing))
    df = df.withColumns({"_left": F.col("_t") - before, "_rest": rest, "_n": F.row_number().over(w)})
    fits = F.col("_w") * F.col("_left") <= F.col("_c") * F.col("_rest")
    level = F.min(F.when(fits, F.struct("_n", "_left", "_rest"))).over(W.partitionBy(*by))
    df = df.withColumn("_level", level)
    share = F.when(F.col("_n") < F.col("_level._n"), F.col("_c").cast("double")).otherwise(F.try_divide(F.col("_w") * F.col("_level._left"), F.col("_level._rest")))
    share = F.coalesce(F.when(F.col("_level").isNull(), F.col("_c").cast("double")).otherwise(share), F.lit(0.0))
    return df.withColumn("share", share).drop("_w", "_c", "_t", "_left", "_rest", "_n", "_level")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken, and the columns to keep, for each row of docs (doc_id, source, text)."""
    sized = docs.select("doc_id", "source", *keep, F.size(split_words(F.col("text"))).cast("long").alias("size"))
    sized = stored(sized.withColumn("long", F.col("size") >= SHORT), "sized")

    groups = sized.groupBy("source", "long").agg(F.sum("size").alias("words"))
    sources = groups.groupBy("source").agg(F.sum("words").alias("source_size"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sources.withColumns({"weight": F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")), "total": F.sum("source_size").over(W.partitionBy())})
    sources = water_fill(sources, [], F.col("weight"), F.lit(most) * F.col("source_size"), F.col("total"), [F.col("source").asc_nulls_last()])
    sources = sources.select("source", "source_size", F.col("share").alias("target"))

    groups = groups.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    liking = F.when(F.col("long"), 2).otherwise(1) * F.col("words")
    groups = water_fill(groups, ["source"], liking, F.lit(most) * F.col("words"), F.col("target"), [F.col("long")])
    copies = F.least(F.lit(float(most)), F.coalesce(F.try_divide(F.col("share"), F.col("words")), F.lit(0.0)))
    groups = groups.withColumn("whole", F.floor(copies)).withColumn("p", copies - F.floor(copies))
    remains = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(W.partitionBy("source"))
    groups = stored(groups.select("source", "long", "source_size", "target", "whole", "p", remains.alias("remains")), "groups")
    n_groups = groups.count()

    g = _small(groups.withColumnsRenamed({"source": "_s", "long": "_l"}), n_groups)
    ranked = sized.join(g, sized["source"].eqNullSafe(F.col("_s")) & (sized["long"] == F.col("_l"))).drop("_s", "_l", "long")
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    drawn = (F.col("p") > 0) & (F.col("size") > 0)
    ranked = ranked.withColumn("u", u).withColumn("q", F.when(drawn, (F.col("u") * (1 - F.col("p"))) / ((1 - F.col("u")) * F.col("p"))))
    ranked = ranked.withColumn("bucket", F.floor(F.col("q") / (1 + F.col("q")) * BUCKETS))

    bars = ranked.where("q IS NOT NULL").groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("remains").alias("remains"))
    over = W.partitionBy("source").orderBy("bucket")
    bars = bars.withColumn("before", F.sum("words").over(over) - F.col("words"))
    edge = bars.where(F.col("before") < F.col("remains")).groupBy("source").agg(F.max(F.struct("bucket", "before")).alias("edge")).select(F.col("source").alias("_s"), "edge.bucket", "edge.before")
    edge = _small(edge.withColumnsRenamed({"bucket": "edge", "before": "edge_before"}), n_groups)
    ranked = ranked.join(edge, ranked["source"].eqNullSafe(F.col("_s")), "left").drop("_s")

    last = F.col("bucket") == F.col("edge")
    own = W.partitionBy("source").orderBy("q", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    at_edge = ranked.where(last).withColumn("before", F.col("edge_before") + F.coalesce(F.sum("size").over(own), F.lit(0)))
    at_edge = at_edge.withColumn("drawn", 2 * F.col("before") + F.col("size") < 2 * F.col("remains")).drop("before")
    others = ranked.where(~F.coalesce(last, F.lit(False))).withColumn("drawn", F.coalesce(F.col("bucket") < F.col("edge"), F.lit(False)))
    copies = F.col("whole") + F.col("drawn").cast("long")
    return others.unionByName(at_edge).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *keep)


def repeated(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, source, text and others), each as often as the mix takes it.

    Rows equal in id, source and text get the most copies of any of them.
    """
    key = row_key(docs["doc_id"], docs["source"], docs["text"])
    # Rows are kept whole in one column, so that no name of theirs meets one of these.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("key"))
    taken = mix(docs.select("doc_id", "source", "text", key.alias("key")), keep=("key",)).where("copies > 0").groupBy("key").agg(F.max("copies").cast("int").alias("copies"))
    taken = stored(taken, "taken")
    both = rows.join(_small(taken, taken.count()), "key")
    return both.withColumn("copy", F.explode_outer(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


SQL = f"""
WITH z AS (
  SELECT doc_id, source, n AS size, n >= {SHORT} AS long FROM (
    SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n FROM documents)
), g0 AS (SELECT source, long, sum(size)::BIGINT AS words FROM z GROUP BY ALL),
s0 AS (
  SELECT source, sum(words)::BIGINT AS ss, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM g0 GROUP BY source
), s1 AS (
  SELECT *, sum(ss) OVER ()::BIGINT - coalesce(sum(3 * ss) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lft,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest, row_number() OVER o AS n
  FROM s0 WINDOW o AS (ORDER BY 3 * ss / w, source NULLS LAST)
), s2 AS (SELECT *, min(CASE WHEN w * lft <= 3 * ss * rest THEN n END) OVER () AS k FROM s1),
lv AS (SELECT lft AS llft, rest AS lrest FROM s2 WHERE n = k),
s AS (SELECT source, ss, CASE WHEN n < k THEN (3 * ss)::DOUBLE ELSE w * llft / lrest END AS target FROM s2, lv),
g1 AS (SELECT g0.source, long, words, ss, target, (CASE WHEN long THEN 2 ELSE 1 END) * words AS w, 3 * words AS c FROM g0 JOIN s ON g0.source IS NOT DISTINCT FROM s.source),
g2 AS (
  SELECT *, target - coalesce(sum(c) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lft,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest, row_number() OVER o AS n
  FROM g1 WINDOW o AS (PARTITION BY source ORDER BY CASE WHEN w > 0 THEN c / w ELSE 0 END, long)
), g3 AS (SELECT *, min(CASE WHEN w * lft <= c * rest THEN n END) OVER (PARTITION BY source) AS k FROM g2),
g4 AS (
  SELECT *, max(CASE WHEN n = k THEN lft END) OVER (PARTITION BY source) AS llft, max(CASE WHEN n = k THEN rest END) OVER (PARTITION BY source) AS lrest FROM g3
), g5 AS (
  SELECT *, least(3.0::DOUBLE, coalesce(coalesce(CASE WHEN k IS NULL OR n < k THEN c::DOUBLE WHEN lrest <> 0 THEN w * llft / lrest END, 0) / nullif(words, 0), 0)) AS e FROM g4
), g AS (
  SELECT source, long, ss, target, floor(e) AS whole, e - floor(e) AS p, target - sum(floor(e) * words) OVER (PARTITION BY source) AS remains FROM g5
), r AS (
  SELECT doc_id, z.source, size, ss, target, whole, p, remains,
    (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM z JOIN g ON z.source IS NOT DISTINCT FROM g.source AND z.long = g.long
), q AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u * (1 - p)) / ((1 - u) * p) END AS q FROM r),
b AS (
  SELECT *, CASE WHEN q IS NOT NULL THEN coalesce(sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS before FROM q
)
SELECT doc_id, size, ss AS source_size, target,
  ((whole + CASE WHEN 2 * before + size < 2 * remains THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM b
"""

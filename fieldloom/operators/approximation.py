"""Approximate diagrams, compressed fields, mandatory critical points and contours around points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.operators import complexes, mesh, topology
from fieldloom.session import written


def quantized(points: DataFrame, epsilon: float) -> DataFrame:
    """Points with v moved to the middle of its step of width epsilon times the range, and the Bound of that move, half a step."""
    span = points.groupBy("dataset").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) * epsilon
    step = F.floor(F.coalesce(F.try_divide(F.col("v") - F.col("_lo"), width), F.lit(0.0)))
    steps = F.greatest(F.ceil(F.lit(1.0 / epsilon)).cast("long"), F.lit(1)) - 1
    moved = points.join(F.broadcast(span) if span.count() <= topology.BROADCAST_ROWS else span, "dataset")
    return moved.withColumn("v", F.when(width > 0, F.col("_lo") + (F.least(step, steps) + 0.5) * width).otherwise(F.col("v"))).withColumn("Bound", width / 2).drop("_lo", "_hi")


def approximate_diagram(points: DataFrame, edges: DataFrame, epsilon: float) -> tuple[DataFrame, DataFrame]:
    """The diagram of the field in steps of epsilon times its range, with Bound for births and deaths, and that field."""
    field = written(quantized(points, epsilon), "quantized")
    bound = field.groupBy("dataset").agg(F.max("Bound").alias("Bound"))
    diagram = topology.persistence_diagram(field.select("dataset", "vid", "v"), edges)
    return diagram.join(bound, "dataset"), field


def compress(points: DataFrame, edges: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Segments (dataset, vid, segment) and levels (dataset, segment, v) of a field within `tolerance` of its range.

    Extrema of less persistence than the tolerance are flattened first; what is left is cut into steps of that width,
    and extrema that stay keep their exact values, so that their pairs survive.
    """
    span = points.groupBy("dataset").agg((F.max("v") - F.min("v")).alias("_r"), F.min("v").alias("_lo"))
    widest = span.agg(F.max("_r")).first()[0] or 0.0
    flat = written(topology.simplify(points, edges, tolerance * widest), "flat")
    own, links = topology._keyed(flat, edges)
    exact = None
    for up in (False, True):
        ends = mesh.steepest(own, links, up).where("vid = next").select(F.col("vid.dataset").alias("dataset"), F.col("vid.vid").alias("vid"))
        exact = ends if exact is None else exact.unionByName(ends)
    kept = flat.join(exact.distinct().withColumn("_x", F.lit(True)), ["dataset", "vid"], "left").join(span, "dataset")
    width = tolerance * widest
    step = F.floor((F.col("v") - F.col("_lo")) / width) if width > 0 else F.lit(0)
    level = F.when(F.col("_x"), F.col("v")).otherwise(F.col("_lo") + (step + 0.5) * width if width > 0 else F.col("v"))
    coded = written(kept.select("dataset", "vid", level.alias("v")), "levels")
    levels = coded.select("dataset", "v").distinct().withColumn("segment", F.row_number().over(W.partitionBy("dataset").orderBy("v")) - 1)
    return coded.join(levels, ["dataset", "v"]).select("dataset", "vid", "segment"), levels.select("dataset", "segment", "v")


def write_compressed(points: DataFrame, edges: DataFrame, tolerance: float, path: str) -> None:
    """Writes a compressed field as a folder of two tables."""
    segments, levels = compress(points, edges, tolerance)
    segments.repartitionByRange("dataset", "vid").sortWithinPartitions("dataset", "vid").write.option("compression", "zstd").mode("overwrite").parquet(f"{path}/segments")
    levels.write.option("compression", "zstd").mode("overwrite").parquet(f"{path}/levels")


def read_compressed(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, vid, v) of a compressed field."""
    return spark.read.parquet(f"{path}/segments").join(spark.read.parquet(f"{path}/levels"), ["dataset", "segment"]).select("dataset", "vid", "v")


def mandatory_extrema(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(dataset, kind, ComponentId, low, high, n): where every field between two bounds (dataset, vid, lo, hi) has a minimum (0) or a maximum (3).

    A local minimum of the upper bound, of value c, forces one in its component of {lo <= c}, unless that holds a lower
    one. The interval is that of the values that the extremum can have; n counts the component's vertices.
    """
    rows = topology.with_neighbours(points.withColumn("v", F.col("lo")), edges).join(points.select("dataset", "vid", "lo", "hi"), ["dataset", "vid"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vid")
        ids = pdf["vid"].to_numpy()
        place = {v: i for i, v in enumerate(ids.tolist())}
        near = [[place[x] for x in xs if x in place] for xs in pdf["nbrs"]]
        out = []
        for kind, sign, low, high in ((0, 1, "lo", "hi"), (3, -1, "hi", "lo")):
            inner, outer = (sign * pdf[c].to_numpy(float) for c in (low, high))
            key = list(zip(outer.tolist(), ids.tolist(), strict=True))
            seeds = sorted((i for i in range(len(ids)) if all(key[i] < key[j] for j in near[i])), key=key.__getitem__)
            order, at = np.lexsort((ids, inner)).tolist(), 0
            sets, size, least, seeded, there = complexes.Forest(len(ids)), [1] * len(ids), inner.tolist(), [False] * len(ids), [False] * len(ids)
            for s in seeds:
                while at < len(order) and inner[order[at]] <= outer[s]:
                    x = order[at]
                    there[x], at = True, at + 1
                    for y in near[x]:
                        if there[y] and (r := sets.root(y)) != (q := sets.root(x)):
                            sets.up[r] = q
                            size[q] += size[r]
                            least[q] = min(least[q], least[r])
                            seeded[q] = seeded[q] or seeded[r]
                r = sets.root(s)
                if not seeded[r]:
                    a, b = sorted((sign * least[r], sign * outer[s]))
                    out.append((int(pdf["dataset"].iloc[0]), kind, int(ids[s]), float(a), float(b), size[r]))
                seeded[r] = True
        return pd.DataFrame(out, columns=["dataset", "kind", "ComponentId", "low", "high", "n"])

    return rows.groupBy("dataset").applyInPandas(run, "dataset long, kind int, ComponentId long, low double, high double, n long")


def contours_around(points: DataFrame, edges: DataFrame, diagram: DataFrame, seeds: list[int], extension: float = 67.0, least: int = 7) -> tuple[DataFrame, DataFrame]:
    """Contours (seed, vid) and centroids (seed, x, y, Size): for seeds that are maxima, the region above a level around each.

    The level lies `extension` per cent of the way from the maximum down to the saddle that it is paired with; a region
    of fewer than `least` vertices has no contour, which is its vertices with a neighbour outside. Points have x and y.
    """
    own = diagram.where((F.col("PairType") == 1) & F.col("death_vertex").isin(seeds)).select(F.col("death_vertex").alias("seed"), (F.col("Death") - (F.col("Death") - F.col("Birth")) * extension / 100).alias("c"))
    region = front = written(own.select("seed", "c", F.col("seed").alias("vid")), "region")
    while not front.isEmpty():
        reach = front.join(edges.select("vid", "nvid"), "vid").select("seed", "c", F.col("nvid").alias("vid")).distinct()
        reach = reach.join(points.select("vid", "v"), "vid").where("v >= c").select("seed", "c", "vid")
        front = written(reach.join(region.select("seed", "vid"), ["seed", "vid"], "left_anti"), "front")
        region = written(region.unionByName(front), "region")
    sizes = region.groupBy("seed").agg(F.count("*").alias("Size")).where(F.col("Size") >= least)
    kept = region.join(sizes, "seed").select("seed", "vid", "Size")
    inside = kept.select("seed", F.col("vid").alias("nvid"), F.lit(True).alias("_in"))
    rim = kept.join(edges.select("vid", "nvid"), "vid").join(inside, ["seed", "nvid"], "left").where("_in IS NULL").select("seed", "vid").distinct()
    centroids = kept.join(points.select("vid", "x", "y"), "vid").groupBy("seed").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.first("Size").alias("Size"))
    return rim, centroids

"""Operators on triangulated grids and graphs, as stencil joins and fixpoints of joins.

A grid is a table (vid, i, j, v) with vid = i + nx * j; its triangulation joins each vertex to six
neighbours. Comparisons use the pair (value, vid), so equal values never matter. Each round of a
fixpoint is written to the shared folder, which cuts its lineage.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.session import written

# The neighbours of a vertex of the triangulated grid, in cyclic order.
STENCIL = ((-1, 0), (0, -1), (1, -1), (1, 0), (0, 1), (-1, 1))


def stencil_edges(points: DataFrame, nx: int, ny: int) -> DataFrame:
    """(vid, slot, nvid): the neighbours of each grid vertex that are inside of the grid, by place in the cyclic order."""
    offsets = F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for s, (dx, dy) in enumerate(STENCIL)])
    spread = points.select("vid", "i", "j", F.explode(offsets).alias("o"))
    ni, nj = F.col("i") + F.col("o.dx"), F.col("j") + F.col("o.dy")
    inside = spread.where(ni.between(0, nx - 1) & nj.between(0, ny - 1))
    return inside.select("vid", F.col("o.slot").alias("slot"), (ni + nx * nj).alias("nvid"))


def neighbour_values(points: DataFrame, edges: DataFrame, field: str = "v") -> DataFrame:
    """Edges with both values: (vid, slot, nvid, v, nv)."""
    theirs = points.select(F.col("vid").alias("nvid"), F.col(field).alias("nv"))
    return edges.join(points.select("vid", F.col(field).alias("v")), "vid").join(theirs, "nvid")


def neighbour_average(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(vid, average): the mean of the neighbours' values."""
    return neighbour_values(points, edges).groupBy("vid").agg(F.avg("nv").alias("average"))


def smooth(points: DataFrame, edges: DataFrame, passes: int = 1, mask: str | None = None) -> DataFrame:
    """Jacobi passes: each value becomes the mean of itself and its neighbours; a mask of 0 freezes it."""
    return smooth_fields(points, edges, ["v"], passes, mask)


def smooth_fields(points: DataFrame, edges: DataFrame, fields: list[str], passes: int = 1, mask: str | None = None) -> DataFrame:
    """The same for several fields at once; with x, y and z, the geometry is smoothed."""
    for _ in range(passes):
        theirs = points.select(F.col("vid").alias("nvid"), *[F.col(c).alias(f"_{c}") for c in fields])
        sums = edges.join(theirs, "nvid").groupBy("vid").agg(*[F.sum(f"_{c}").alias(f"_{c}") for c in fields], F.count("*").alias("_n"))
        means = {}
        for c in fields:
            mean = ((F.col(c) + F.coalesce(f"_{c}", F.lit(0.0))) / (1 + F.coalesce("_n", F.lit(0)))).cast("double")
            means[c] = F.when(F.col(mask) == 0, F.col(c)).otherwise(mean) if mask else mean
        points = written(points.join(sums, "vid", "left").withColumns(means).drop("_n", *[f"_{c}" for c in fields]), "smooth")
    return points


def morphology(points: DataFrame, edges: DataFrame, steps: str) -> DataFrame:
    """Grayscale steps: d dilates (greatest of self and neighbours), e erodes (least); "de" closes, "ed" opens."""
    for step in steps:
        best = F.max if step == "d" else F.min
        near = neighbour_values(points, edges).groupBy("vid").agg(best("nv").alias("_b"))
        pick = (F.greatest if step == "d" else F.least)("v", F.coalesce("_b", "v"))
        points = written(points.join(near, "vid", "left").withColumn("v", pick).drop("_b"), "morph")
    return points


def morphology_label(points: DataFrame, edges: DataFrame, steps: str, pivot: int) -> DataFrame:
    """Binary steps on one label: d gives it to its neighbours, e takes it from vertices next to another one, the greatest of which they get."""
    for step in steps:
        other = F.when(F.col("nv") != pivot, F.col("nv"))
        near = neighbour_values(points, edges).groupBy("vid").agg(F.max(F.col("nv") == pivot).alias("_p"), F.max(other).alias("_o"))
        value = F.when(F.col("_p"), F.lit(pivot)).otherwise(F.col("v")) if step == "d" else F.when((F.col("v") == pivot) & F.col("_o").isNotNull(), F.col("_o")).otherwise(F.col("v"))
        points = written(points.join(near, "vid", "left").withColumn("v", value).drop("_p", "_o"), "label")
    return points


def critical_points(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(vid, n_lower, n_upper, CriticalType, IsOnBoundary) from the runs of lower and upper neighbours around each vertex.

    Types: 0 minimum, 1 saddle, 3 maximum (2D), 4 degenerate, 5 regular.
    """
    up = F.struct("nv", "nvid") > F.struct(F.col("v").alias("nv"), F.col("vid").alias("nvid"))
    ring = neighbour_values(points, edges).groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("slot", up.alias("up")))).alias("r"))  # six at most
    n = F.size("r")
    follows = lambda i: (F.get("r", (i + 1) % n)["slot"] == (F.get("r", i)["slot"] + 1) % len(STENCIL))
    starts = lambda up: F.size(F.filter(F.transform("r", lambda x, i: (x["up"] == up) & ~(follows((i + n - 1) % n) & (F.get("r", (i + n - 1) % n)["up"] == up) & (n > 1))), lambda y: y))
    whole = lambda up: F.when((n == len(STENCIL)) & ~F.exists("r", lambda x: x["up"] != up), 1)
    runs = ring.select("vid", F.coalesce(whole(False), starts(False)).alias("n_lower"), F.coalesce(whole(True), starts(True)).alias("n_upper"), (n < len(STENCIL)).cast("tinyint").alias("IsOnBoundary"))
    kind = F.when((F.col("n_lower") == 0), 0).when(F.col("n_upper") == 0, 3).when((F.col("n_lower") == 1) & (F.col("n_upper") == 1), 5).when((F.col("n_lower") > 2) | (F.col("n_upper") > 2), 4).otherwise(1)
    return runs.select("vid", "n_lower", "n_upper", kind.alias("CriticalType"), "IsOnBoundary")


def critical_points_1d(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Minima (0), maxima (1) and regular points (-1) of sequences; equal values go by place."""
    w = W.partitionBy(*by).orderBy(order)
    here = F.struct(F.col(value), F.col(order))
    before, after = F.lag(here).over(w), F.lead(here).over(w)
    lower = F.coalesce((before < here).cast("int"), F.lit(0)) + F.coalesce((after < here).cast("int"), F.lit(0))
    upper = F.coalesce((before > here).cast("int"), F.lit(0)) + F.coalesce((after > here).cast("int"), F.lit(0))
    return df.withColumn("CriticalType", F.when(lower == 0, 0).when(upper == 0, 1).otherwise(-1))


def components(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(vid, ComponentId): the greatest vid reachable over edges (vid, nvid), by hooking to the greatest and jumping.

    A vertex's label is a vertex of its component. Each round, a vertex and the vertex that it points to take the
    greatest label that the neighbours point at in two steps, and each pointer jumps to its pointer's end. Labels only
    grow, and the greatest one crosses at least an edge a round, so the loop ends; it ends when nothing moves.
    """
    both = written(edges.select("vid", "nvid").unionByName(edges.select(F.col("nvid").alias("vid"), F.col("vid").alias("nvid"))).distinct(), "edges")
    label = written(ids.select("vid", F.col("vid").alias("c")).distinct(), "component")
    while True:
        ahead = label.join(label.select(F.col("vid").alias("c"), F.col("c").alias("far")), "c").select("vid", "c", "far")
        near = both.join(ahead.select(F.col("vid").alias("nvid"), "far"), "nvid").groupBy("vid").agg(F.max("far").alias("m"))
        hooked = written(ahead.join(near, "vid", "left").select("vid", "c", F.greatest("far", "m").alias("n")), "hooked")
        # The vertex pointed to follows, and with it, by jumps, all that point there.
        offers = hooked.select("vid", "c", "n").unionByName(hooked.select(F.col("c").alias("vid"), F.lit(None).alias("c"), "n"))
        new = offers.groupBy("vid").agg(F.max("c").alias("was"), F.max("n").alias("c"))
        new = written(new.select("vid", "c", (F.col("c") != F.col("was")).alias("moved")), "component")
        label = new.select("vid", "c")
        if new.where("moved").isEmpty():
            return label.withColumnRenamed("c", "ComponentId")


def connected_components(points: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """(vid, ComponentId, ComponentSize) of the vertices whose value exceeds the threshold; -1 and 0 for the others."""
    inside = points.where(F.col("v") > threshold).select("vid")
    kept = edges.join(inside, "vid", "left_semi").join(inside.withColumnRenamed("vid", "nvid"), "nvid", "left_semi")
    found = components(inside, kept)
    sizes = found.groupBy("ComponentId").agg(F.count("*").alias("ComponentSize"))
    out = points.select("vid").join(found.join(sizes, "ComponentId"), "vid", "left")
    return out.select("vid", F.coalesce("ComponentId", F.lit(-1)).alias("ComponentId"), F.coalesce("ComponentSize", F.lit(0)).alias("ComponentSize"))


def steepest(points: DataFrame, edges: DataFrame, up: bool = True) -> DataFrame:
    """(vid, next): the greatest (or least) neighbour in order, or the vertex itself at an extremum."""
    best = F.max if up else F.min
    near = neighbour_values(points, edges).groupBy("vid").agg(best(F.struct("nv", "nvid")).alias("b"))
    own = F.struct(F.col("v").alias("nv"), F.col("vid").alias("nvid"))
    further = F.col("b") > own if up else F.col("b") < own
    return points.join(near, "vid", "left").select("vid", F.when(further, F.col("b.nvid")).otherwise(F.col("vid")).alias("next"))


def jump(pointers: DataFrame) -> DataFrame:
    """(vid, next and any column more) with each pointer followed to its end; a round takes it four times as far.

    Pointers that run in a circle have no end, and are an error.
    """
    now = first = written(pointers, "jump")
    for _ in range(40):  # 4 ** 40 steps are more than any table's
        ahead = now.select(F.col("vid").alias("next"), F.col("next").alias("far"))
        twice = now.join(ahead, "next").withColumnsRenamed({"next": "was", "far": "next"})
        new = written(twice.join(ahead, "next").withColumn("moved", F.col("far") != F.col("was")).drop("next", "was").withColumnRenamed("far", "next"), "jump")
        now = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    ends = first.where("vid = next").select("vid")
    if not now.select(F.col("next").alias("vid")).join(ends, "vid", "left_anti").isEmpty():
        raise ValueError("pointers run in a circle")
    return now.select(*pointers.columns)


def path_compression(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(vid, AscendingManifold, DescendingManifold): the minimum and the maximum that steepest paths reach.

    Both directions are followed in one table: a vertex stands in it once for each, its pointers apart.
    """
    end = lambda up: steepest(points, edges, up).select(F.struct(F.lit(up).alias("up"), F.col("vid").alias("x")).alias("vid"), F.struct(F.lit(up).alias("up"), F.col("next").alias("x")).alias("next"))
    ends = jump(end(False).unionByName(end(True))).groupBy(F.col("vid.x").alias("vid"))
    to = lambda up: F.max(F.when(F.col("vid.up") == up, F.col("next.x")))
    return ends.agg(to(False).alias("AscendingManifold"), to(True).alias("DescendingManifold"))


def follow(starts: DataFrame, pointers: DataFrame) -> DataFrame:
    """(every column of starts, step): starts (id, vid) and all that their pointers (vid, next) lead to, in as many joins as a path's length has bits."""
    leap = written(pointers.where("vid <> next").select("vid", "next"), "leap")
    leaps = []
    while not leap.isEmpty():
        leaps.append(leap)
        leap = written(leap.join(leap.select(F.col("vid").alias("next"), F.col("next").alias("far")), "next").select("vid", F.col("far").alias("next")), "leap")
    lines = starts.withColumn("step", F.lit(0).cast("long"))
    for n in range(len(leaps) - 1, -1, -1):
        further = lines.join(leaps[n], "vid").withColumns({"vid": F.col("next"), "step": F.col("step") + (1 << n)}).drop("next")
        lines = written(lines.unionByName(further), "lines")
    return lines


def integral_lines(points: DataFrame, edges: DataFrame, seeds: list[int], up: bool = True) -> DataFrame:
    """(SeedIdentifier, step, vid): the steepest path from each seed to its extremum."""
    starts = points.where(F.col("vid").isin(seeds)).select(F.col("vid").alias("SeedIdentifier"), "vid")
    return follow(starts, steepest(points, edges, up)).select("SeedIdentifier", "step", "vid")


def distance_field(points: DataFrame, edges: DataFrame, sources: list[int], length: Column | None = None) -> DataFrame:
    """(vid, distance, source): shortest path lengths over edges to the nearest source; ties go to the least source.

    Rounds of relaxation from the vertices that changed last; length is an expression over edge columns.
    """
    weighted = written(edges.withColumn("_l", F.lit(1.0) if length is None else length).select("vid", "nvid", "_l"), "lengths")
    best = points.where(F.col("vid").isin(sources)).select("vid", F.struct(F.lit(0.0).alias("d"), F.col("vid").alias("s")).alias("b"))
    best = changed = written(best, "distance")
    while True:
        # Three steps a round: fewer rounds, each of which ends in a table.
        steps = [changed.withColumnRenamed("b", "n")]
        for _ in range(3):
            on = steps[-1].join(weighted, "vid").select(F.col("nvid").alias("vid"), F.struct((F.col("n.d") + F.col("_l")).alias("d"), F.col("n.s").alias("s")).alias("n"))
            steps.append(on.groupBy("vid").agg(F.min("n").alias("n")))
        reached = reduce(DataFrame.unionByName, steps[1:]).groupBy("vid").agg(F.min("n").alias("n"))
        both = best.join(reached, "vid", "full").select("vid", F.least("b", "n").alias("b"), (F.col("b").isNull() | (F.col("n") < F.col("b"))).alias("moved"))
        both = written(both.withColumn("moved", F.coalesce("moved", F.lit(False))), "distance")
        best, changed = both.select("vid", "b"), both.where("moved").select("vid", "b")
        if changed.isEmpty():
            break
    return best.select("vid", F.col("b.d").alias("distance"), F.col("b.s").alias("source"))


def merge_points(points: DataFrame, radius: float, coordinates: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(vid, representative): points closer than radius merged, transitively, into the least vid.

    All points of a cell whose diagonal is under the radius are merged, and two cells near each other need one pair of
    points that are close, whatever number they hold: links grow as the points do, not as their pairs.
    """
    radius, n = abs(radius), len(coordinates)
    if not radius:
        return points.select("vid", F.col("vid").alias("representative"))
    width = radius / n**0.5 * 0.999
    finite = reduce(lambda a, b: a & b, [F.coalesce(F.abs(c) < float("inf"), F.lit(False)) for c in coordinates])
    cell = [f"_{k}" for k in range(n)]
    own = points.where(finite).select("vid", F.struct(*[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(coordinates)]).alias("x"))
    own = own.withColumns({c: F.floor(F.col(f"x.x{k}") / width).cast("long") for k, c in enumerate(cell)})
    cells = written(own.groupBy(*cell).agg(F.min("vid").alias("a"), F.collect_set("x").alias("p")), "cells")
    inside = own.select("vid", *cell).join(cells.select(F.col("a").alias("nvid"), *cell), cell).where("vid <> nvid").select("vid", "nvid")
    reach = int(radius / width) + 1
    steps = [s for s in product(range(-reach, reach + 1), repeat=n) if s > (0,) * n and sum((max(abs(x) - 1, 0) * width) ** 2 for x in s) < radius * radius]
    shift = F.explode(F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(cell, s, strict=True)]) for s in steps])).alias("s")
    met = cells.select("a", *cell, shift).select("a", *[(F.col(c) + F.col(f"s.{c}")).alias(c) for c in cell])
    met = met.join(cells.select(F.col("a").alias("b"), *cell), cell).select("a", "b")
    side = lambda a, p: cells.select(F.col("a").alias(a), F.col("p").alias(p), F.struct(*cell).alias(f"c{a}"))
    met = met.join(side("a", "p"), "a").join(side("b", "q"), "b")

    def beside(x: Column, box: str) -> Column:
        """Whether a point may be close to a point of a cell."""
        rounding = lambda k: F.abs(x[f"x{k}"]) * 1e-14
        gaps = [F.greatest(F.greatest(F.col(box)[c] * width - x[f"x{k}"], x[f"x{k}"] - (F.col(box)[c] + 1) * width) - rounding(k), F.lit(0.0)) for k, c in enumerate(cell)]
        return sum((g * g for g in gaps), F.lit(0.0)) < radius * radius * (1 + 1e-9)

    met = met.withColumns({"p": F.filter("p", lambda x: beside(x, "cb")), "q": F.filter("q", lambda x: beside(x, "ca"))})
    gap = lambda x, y: sum(((x[f"x{k}"] - y[f"x{k}"]) ** 2 for k in range(n)), F.lit(0.0))
    across = met.where(F.exists("p", lambda x: F.exists("q", lambda y: gap(x, y) < radius * radius))).select(F.col("a").alias("vid"), F.col("b").alias("nvid"))
    found = components(points.select("vid"), inside.unionByName(across))
    least = found.groupBy("ComponentId").agg(F.min("vid").alias("representative"))
    return found.join(least, "ComponentId").select("vid", "representative")

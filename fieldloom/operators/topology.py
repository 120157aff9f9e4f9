"""Persistence diagrams, merge trees and their comparison.

Kernels that are sequential by nature run once for each dataset, in parallel over datasets.
Vertices are compared by (value, vid) throughout.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.operators import complexes, mesh
from fieldloom.session import written

#: Tables of one row for each dataset are broadcast up to this many rows (a few dozen bytes each).
BROADCAST_ROWS = 100_000

DIAGRAM = "dataset long, birth_vertex long, death_vertex long, PairType int, Birth double, Death double, IsFinite boolean"
TREE = "dataset long, NodeId long, VertexId long, CriticalType int, Scalar double, parent long, RegionSize long"


def _sweep(values: np.ndarray, order: np.ndarray, neighbours: dict[int, list[int]]):
    """Merges vertices in order: (vertex, the extremum of each component that it joins, the eldest first)."""
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    parent = np.full(len(order), -1)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x in order.tolist():
        met = sorted({root(y) for y in neighbours.get(x, ()) if parent[y] >= 0}, key=rank.__getitem__)
        parent[x] = met[0] if met else x
        for y in met[1:]:
            parent[y] = met[0]
        yield x, met


def _graph(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
    """Ids, values and neighbour lists (by place) of the vertex rows (vid, v, nbrs) of one dataset."""
    pdf = pdf.sort_values("vid")
    ids = pdf["vid"].to_numpy()
    place = {v: i for i, v in enumerate(ids.tolist())}
    return ids, pdf["v"].to_numpy(float), {i: [place[n] for n in nbrs if n in place] for i, nbrs in enumerate(pdf["nbrs"])}


def with_neighbours(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(dataset, vid, v, nbrs): each vertex with its neighbours' ids."""
    near = edges.groupBy("dataset", "vid").agg(F.collect_set("nvid").alias("nbrs"))  # a vertex's own neighbours
    return points.join(near, ["dataset", "vid"], "left").select("dataset", "vid", "v", F.coalesce("nbrs", F.expr("cast(array() as array<bigint>)")).alias("nbrs"))


def _keyed(points: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same with (dataset, vid) as one id, so that operators on one mesh run over all datasets at once."""
    key = lambda c: F.struct("dataset", F.col(c).alias("vid"))
    return points.select(key("vid").alias("vid"), "v"), edges.select(key("vid").alias("vid"), key("nvid").alias("nvid"))


LINKS = "a long, av double, b long, bv double, s long, sv double"


def extremum_links(points: DataFrame, edges: DataFrame, up: bool) -> DataFrame:
    """(dataset, a, av, b, bv, s, sv): the extrema, and for each two whose basins touch the vertex s where they first do.

    The basins are those of steepest paths, so a table of vertices shrinks to one of extrema; a row without b is an
    extremum alone.
    """
    own, links = _keyed(points, edges)
    ends = mesh.jump(mesh.steepest(own, links, up)).join(own, "vid").select("vid", "v", "next")
    ends = written(ends, "basins")
    side = lambda v, e, m: ends.select(F.col("vid").alias(v), F.struct("v", "vid").alias(e), F.col("next").alias(m))
    both = links.join(side("vid", "e", "a"), "vid").join(side("nvid", "f", "b"), "nvid").where("a < b")
    at = F.min(F.greatest("e", "f")) if not up else F.max(F.least("e", "f"))
    touch = both.groupBy("a", "b").agg(at.alias("s"))
    value = ends.where("vid = next").select("vid", "v")
    touch = touch.join(value.withColumnsRenamed({"vid": "a", "v": "av"}), "a").join(value.withColumnsRenamed({"vid": "b", "v": "bv"}), "b")
    touch = touch.select("a.dataset", F.col("a.vid").alias("a"), "av", F.col("b.vid").alias("b"), "bv", F.col("s.vid.vid").alias("s"), F.col("s.v").alias("sv"))
    alone = value.select("vid.dataset", F.col("vid.vid").alias("a"), F.col("v").alias("av"))
    return touch.unionByName(alone, allowMissingColumns=True)


def _elder(pdf: pd.DataFrame, up: bool) -> list[tuple]:
    """(younger extremum, its value, where it ends, that value) by the elder rule; s is None for those that never end."""
    sign = -1 if up else 1
    key = lambda v, i: (sign * v, sign * i)
    age = {int(a): key(v, int(a)) for a, v in zip(pdf["a"], pdf["av"], strict=True)}
    value = dict(zip(pdf["a"].astype(int), pdf["av"], strict=True))
    root = {a: a for a in age}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out, real = [], pdf[pdf["b"].notna()]
    links = sorted(zip(real["a"].astype(int), real["b"].astype(int), real["s"].astype(int), real["sv"], strict=True), key=lambda r: key(r[3], r[2]))
    for a, b, s, sv in links:
        a, b = sorted((find(a), find(b)), key=age.__getitem__)
        if a != b:
            root[b] = a
            out.append((b, value[b], s, sv))
    return out + [(a, value[a], None, None) for a in age if find(a) == a]


def persistence_diagram(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Minimum-saddle pairs (type 0) and saddle-maximum pairs (type 1) of the join and split trees of each dataset.

    A component's least minimum is paired with the dataset's global maximum, and that pair isn't finite. Only the
    extrema and the places where their basins touch meet in a task for each dataset.
    """
    top = points.groupBy("dataset").agg(F.max(F.struct("v", "vid")).alias("_t")).select("dataset", F.col("_t.vid").alias("top"), F.col("_t.v").alias("topv"))
    columns = [c.split()[0] for c in DIAGRAM.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, set_id = [], int(pdf["dataset"].iloc[0])
        for rising in (True, False):
            for x, v, s, sv in _elder(pdf[pdf["up"] != rising], not rising):
                if s is not None:
                    rows.append((set_id, x, s, 0, v, sv, True) if rising else (set_id, s, x, 1, sv, v, True))
                elif rising:
                    rows.append((set_id, x, int(pdf["top"].iloc[0]), 0, v, float(pdf["topv"].iloc[0]), False))
        return pd.DataFrame(rows, columns=columns)

    links = extremum_links(points, edges, False).withColumn("up", F.lit(False)).unionByName(extremum_links(points, edges, True).withColumn("up", F.lit(True)))
    return links.join(F.broadcast(top) if top.count() <= BROADCAST_ROWS else top, "dataset").groupBy("dataset").applyInPandas(run, DIAGRAM)


def persistence_curve(diagram: DataFrame, by: list[str]) -> DataFrame:
    """Persistence and Number Of Pairs of at least that persistence, within each group."""
    w = W.partitionBy(*by).orderBy(F.col("Persistence").desc()).rangeBetween(W.unboundedPreceding, 0)
    return diagram.withColumn("Persistence", F.greatest(F.col("Persistence"), F.lit(1e-6))).select(*by, "Persistence", F.count("*").over(w).alias("NumberOfPairs")).distinct()


def threshold_pairs(diagram: DataFrame, least: float) -> DataFrame:
    return diagram.where(F.col("Death") - F.col("Birth") >= least)


def merge_tree(points: DataFrame, edges: DataFrame, rising: bool = True) -> DataFrame:
    """Nodes of the join (rising) or split tree: leaves (0), merges (1) and the root (2), with parents and sizes of the arcs below them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, values, near = _graph(pdf)
        order = np.lexsort((ids, values)) if rising else np.lexsort((ids, values))[::-1]
        head, size, rows, last = {}, {}, {}, -1
        for x, met in _sweep(values, order, near):
            last = x
            if len(met) == 1:
                size[head[met[0]]] += 1
                continue
            rows[x] = [x, 1 if met else 0, -1]
            for y in met:
                rows[head[y]][2] = x
            head[met[0] if met else x] = x
            size[x] = 1
        if last >= 0 and last not in rows:
            rows[last] = [last, 2, -1]
            size[last] = 1
            for r in rows.values():
                if r[2] == -1 and r[0] != last:
                    r[2] = last
        number = {x: k for k, x in enumerate(sorted(rows))}
        made = [(pdf["dataset"].iloc[0], number[x], int(ids[x]), kind, float(values[x]), number.get(up, -1), size[x]) for x, (_, kind, up) in sorted(rows.items())]
        return pd.DataFrame(made, columns=[c.split()[0] for c in TREE.split(", ")])

    return with_neighbours(points, edges).groupBy("dataset").applyInPandas(run, TREE)


def _flatten(points: DataFrame, edges: DataFrame, choose) -> DataFrame:
    """(dataset, vid, v): minima, then maxima, that `choose(pdf, rising)` drops are flattened."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, values, near = _graph(pdf)
        lists = [near[i] for i in range(len(ids))]
        for rising in (True, False):
            dropped = choose(ids, values, lists, rising)
            if dropped is not None:
                values = complexes.flattened(values, ids, lists, rising, dropped)
        return pd.DataFrame({"dataset": pdf["dataset"].iloc[0], "vid": ids, "v": values})

    return with_neighbours(points, edges).groupBy("dataset").applyInPandas(run, "dataset long, vid long, v double")


def simplify(points: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """(dataset, vid, v): minima of persistence under `least` are filled up to their saddle, maxima cut down to theirs."""

    def choose(ids: np.ndarray, values: np.ndarray, near: list[list[int]], rising: bool):  # noqa: ARG001
        return lambda x, met: ({y for y in met[1:] if abs(values[x] - values[y]) < least}, met[0])

    return _flatten(points, edges, choose)


def simplify_to(points: DataFrame, edges: DataFrame, kept: list[int]) -> DataFrame:
    """(dataset, vid, v): minima and maxima whose vertices aren't listed are flattened to the saddle where they end.

    A side of which no extremum is listed stays as it is. Of components that meet, those without a listed extremum end.
    """
    listed = frozenset(kept)

    def choose(ids: np.ndarray, values: np.ndarray, near: list[list[int]], rising: bool):
        place = list(zip(values.tolist(), ids.tolist(), strict=True))
        first = lambda i: all((place[i] < place[j]) == rising for j in near[i])
        wanted = {i for i, v in enumerate(ids.tolist()) if v in listed and first(i)}
        if not wanted:
            return None

        def dropped(x: int, met: list[int]) -> tuple[set[int], int]:  # noqa: ARG001
            good = [y for y in met if y in wanted]
            return ({y for y in met if y not in wanted} if good else set(), (good or met)[0])

        return dropped

    return _flatten(points, edges, choose)


def assign(cost: np.ndarray) -> np.ndarray:
    """The column of each row in a least-cost assignment (rows at most columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v, row_of = np.zeros(n + 1), np.zeros(m + 1), np.full(m + 1, -1)
    for i in range(n):
        row_of[m], j0 = i, m
        least, way, used = np.full(m + 1, np.inf), np.full(m + 1, m), np.zeros(m + 1, bool)
        while row_of[j0] >= 0:
            used[j0] = True
            i0 = row_of[j0]
            gain = cost[i0] - u[i0] - v[:m]
            better = ~used[:m] & (gain < least[:m])
            least[:m][better], way[:m][better] = gain[better], j0
            j1 = int(np.argmin(np.where(used[:m], np.inf, least[:m])))
            step = least[j1]
            u[row_of[used]] += step
            v[used] -= step
            least[:m][~used[:m]] -= step
            j0 = j1
        while j0 != m:
            row_of[j0], j0 = row_of[way[j0]], way[j0]
    out = np.full(n, -1)
    for j in range(m):
        if row_of[j] >= 0:
            out[row_of[j]] = j
    return out


def wasserstein(a: np.ndarray, b: np.ndarray, p: float = 2.0) -> float:
    """The p-Wasserstein distance of two diagrams of (birth, death) rows; points may go to the diagonal."""
    n, m = len(a), len(b)
    if not n + m:
        return 0.0
    cost = np.zeros((n + m, n + m))
    cost[:n, :m] = (np.abs(a[:, None, :] - b[None, :, :]) ** p).sum(axis=2)
    cost[:n, m:] = (2 * (np.abs(a[:, 1] - a[:, 0]) / 2) ** p)[:, None]
    cost[n:, :m] = (2 * (np.abs(b[:, 1] - b[:, 0]) / 2) ** p)[None, :]
    return float(cost[np.arange(n + m), assign(cost)].sum() ** (1 / p))


def most_persistent(diagram: DataFrame, k: int | None = 20) -> DataFrame:
    """(dataset, PairType, pairs): the k most persistent pairs of each dataset and type, or all where k is None."""
    if k is None:
        return diagram.where("Death > Birth").groupBy("dataset", "PairType").agg(F.sort_array(F.collect_list(F.array("Birth", "Death"))).alias("pairs"))
    rank = F.row_number().over(W.partitionBy("dataset", "PairType").orderBy((F.col("Death") - F.col("Birth")).desc(), "birth_vertex", "death_vertex"))
    top = diagram.where("Death > Birth").withColumn("_r", rank).where(F.col("_r") <= k)
    return top.groupBy("dataset", "PairType").agg(F.sort_array(F.collect_list(F.array("Birth", "Death"))).alias("pairs"))  # k at most


def diagram_distance_matrix(diagram: DataFrame, k: int | None = None, p: float = 2.0) -> DataFrame:
    """(i, j, d), i < j: Wasserstein distances of all pairs, or of the k most persistent, summed over pair types."""
    own = most_persistent(diagram, k)
    every = diagram.select("dataset").distinct()
    kinds = own.select("PairType").distinct()
    full = every.crossJoin(F.broadcast(kinds)).join(own, ["dataset", "PairType"], "left")  # two or three types
    pair = full.select("PairType", F.col("dataset").alias("i"), F.col("pairs").alias("x")).join(full.select("PairType", F.col("dataset").alias("j"), F.col("pairs").alias("y")), "PairType").where("i < j")

    @F.pandas_udf("double")
    def cost(x: pd.Series, y: pd.Series) -> pd.Series:
        rows = lambda z: np.array([list(r) for r in z], float).reshape(-1, 2) if z is not None else np.zeros((0, 2))
        return pd.Series([wasserstein(rows(s), rows(t), p) ** p for s, t in zip(x, y, strict=True)])

    return pair.repartition("i", "j").withColumn("c", cost("x", "y")).groupBy("i", "j").agg(F.pow(F.sum("c"), F.lit(1 / p)).alias("d"))


def overlap_nodes(df: DataFrame, time: str, label: str, point: str) -> DataFrame:
    """(SequenceIndex, Label, Size): labels of each time with their numbers of points."""
    return df.groupBy(F.col(time).alias("SequenceIndex"), F.col(label).alias("Label")).agg(F.countDistinct(point).alias("Size"))


def overlap_edges(df: DataFrame, time: str, label: str, point: str) -> DataFrame:
    """(SequenceIndex, a, b, Overlap): points that labels of one time share with labels of the next."""
    own = df.select(F.col(time).alias("t"), F.col(label).alias("l"), F.col(point).alias("p")).distinct()
    after = own.select((F.col("t") - 1).alias("t"), F.col("l").alias("b"), "p")
    return own.withColumnRenamed("l", "a").join(after, ["t", "p"]).groupBy(F.col("t").alias("SequenceIndex"), "a", "b").agg(F.count("*").alias("Overlap"))


def overlap_branches(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(SequenceIndex, Label, head): each node with the first node of its branch, `time:label`.

    A branch goes on to a node's largest successor, where the node is that one's largest predecessor.
    """
    name = lambda t, label: F.concat_ws(":", t.cast("string"), label.cast("string"))
    best = lambda key, other: F.max_by(F.struct("SequenceIndex", "a", "b"), F.struct("Overlap", other))  # noqa: E731, ARG005
    follows = edges.groupBy("SequenceIndex", "a").agg(best("a", "b").alias("e")).select("e.*")
    leads = edges.groupBy("SequenceIndex", "b").agg(best("b", "a").alias("e")).select("e.*")
    kept = follows.join(leads, ["SequenceIndex", "a", "b"])
    back = kept.select(name(F.col("SequenceIndex") + 1, F.col("b")).alias("vid"), name(F.col("SequenceIndex"), F.col("a")).alias("next"))
    all_nodes = nodes.select("SequenceIndex", "Label", name(F.col("SequenceIndex"), F.col("Label")).alias("vid"))
    pointers = all_nodes.join(back, "vid", "left").select("vid", F.coalesce("next", "vid").alias("next"))
    return all_nodes.join(mesh.jump(pointers), "vid").select("SequenceIndex", "Label", F.col("next").alias("head"))

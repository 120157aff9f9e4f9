"""Matching, clustering and tracking of persistence diagrams and merge trees, and reduction of series.

Diagrams are rows (dataset, PairType, Birth, Death, ...). Two diagrams meet in one task; pairs of diagrams, and
diagrams against centroids, run in parallel.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import mesh
from fieldloom.operators.topology import assign, most_persistent, wasserstein
from fieldloom.session import written


def _rows(cell) -> np.ndarray:
    return np.array([list(r) for r in cell], float).reshape(-1, 2) if cell is not None else np.zeros((0, 2))


def matching(a: np.ndarray, b: np.ndarray, p: float = 2.0) -> list[tuple[int, int, float]]:
    """(i, j, cost) of a least-cost matching of two diagrams; -1 is the diagonal, costs are to the power p."""
    n, m = len(a), len(b)
    cost = np.zeros((n + m, n + m))
    if not n + m:
        return []
    cost[:n, :m] = (np.abs(a[:, None, :] - b[None, :, :]) ** p).sum(axis=2)
    cost[:n, m:] = (2 * (np.abs(a[:, 1] - a[:, 0]) / 2) ** p)[:, None]
    cost[n:, :m] = (2 * (np.abs(b[:, 1] - b[:, 0]) / 2) ** p)[None, :]
    to = assign(cost)
    return [(i if i < n else -1, int(j) if j < m else -1, float(cost[i, j])) for i, j in enumerate(to) if i < n or j < m]


def bottleneck(a: np.ndarray, b: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
    """The bottleneck distance under the maximum norm, and a matching (i, j, cost) that has it.

    The least bound under which all points find a partner or the diagonal is found among the costs by bisection.
    """
    n, m = len(a), len(b)
    if not n + m:
        return 0.0, []
    cost = np.full((n + m, n + m), np.inf)
    cost[:n, :m] = np.abs(a[:, None, :] - b[None, :, :]).max(axis=2) if n and m else 0
    cost[np.arange(n), m + np.arange(n)] = (a[:, 1] - a[:, 0]) / 2
    cost[n + np.arange(m), np.arange(m)] = (b[:, 1] - b[:, 0]) / 2
    cost[n:, m:] = 0

    def matched(bound: float) -> list[int] | None:
        near = [np.flatnonzero(cost[i] <= bound).tolist() for i in range(n + m)]
        row_of = [-1] * (n + m)
        for start in range(n + m):
            back, stack, end = {}, [start], None
            while stack and end is None:
                i = stack.pop()
                for j in near[i]:
                    if j not in back:
                        back[j] = i
                        if row_of[j] < 0:
                            end = j
                            break
                        stack.append(row_of[j])
            if end is None:
                return None
            while True:
                i = back[end]
                before = next((j for j in range(n + m) if row_of[j] == i), None) if i != start else None
                row_of[end] = i
                if before is None:
                    break
                end = before
        return row_of

    bounds = np.unique(cost[np.isfinite(cost)])
    low, high = 0, len(bounds) - 1
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if matched(bounds[mid]) is not None else (mid + 1, high)
    row_of = matched(bounds[low])
    pairs = [(i if i < n else -1, j if j < m else -1, float(cost[i, j])) for j, i in enumerate(row_of) if i < n or j < m]
    return float(bounds[low]), sorted(pairs)


def diagram_matching(diagram: DataFrame, first: int, second: int, p: float | None = 2.0, tolerance: float = 0.0) -> DataFrame:
    """(PairType, a, b, Birth/Death of both, Cost): how the pairs of two datasets match, type by type; p None is the bottleneck.

    Pairs of less than `tolerance` times the greatest persistence of both are left out. Unmatched sides are null.
    """
    own = diagram.where(F.col("dataset").isin([first, second]) & (F.col("Death") > F.col("Birth")))
    top = own.agg(F.max(F.col("Death") - F.col("Birth")).alias("_t"))
    own = own.crossJoin(F.broadcast(top)).where(F.col("Death") - F.col("Birth") >= tolerance * F.col("_t"))  # one row
    lists = own.groupBy("PairType").agg(*[F.sort_array(F.collect_list(F.when(F.col("dataset") == d, F.array("Birth", "Death")))).alias(n) for d, n in ((first, "x"), (second, "y"))])

    def run(frames):
        for pdf in frames:
            out = []
            for kind, x, y in zip(pdf["PairType"], pdf["x"], pdf["y"], strict=True):
                x, y = _rows(x), _rows(y)
                for i, j, cost in matching(x, y, p) if p is not None else bottleneck(x, y)[1]:
                    side = lambda z, k: (float(z[k, 0]), float(z[k, 1])) if k >= 0 else (None, None)
                    out.append((int(kind), i, j, *side(x, i), *side(y, j), cost))
            yield pd.DataFrame(out, columns=["PairType", "a", "b", "BirthA", "DeathA", "BirthB", "DeathB", "Cost"])

    return lists.mapInPandas(run, "PairType int, a int, b int, BirthA double, DeathA double, BirthB double, DeathB double, Cost double")


def matching_costs(matched: DataFrame, p: float | None = 2.0) -> DataFrame:
    """One row: MinSaddleCost, SaddleMaxCost and Distance of a matching; sums under a root, or the greatest costs for the bottleneck."""
    total = (lambda c: F.pow(F.coalesce(F.sum(c), F.lit(0.0)), F.lit(1 / p))) if p is not None else (lambda c: F.coalesce(F.max(c), F.lit(0.0)))
    of = lambda kind: F.when(F.col("PairType") == kind, F.col("Cost"))
    return matched.agg(total(of(0)).alias("MinSaddleCost"), total(of(1)).alias("SaddleMaxCost"), total(F.col("Cost")).alias("Distance"))


def barycenter(diagrams: list[np.ndarray], rounds: int = 30) -> np.ndarray:
    """A diagram of locally least summed squared distance to the given ones, from the one of most pairs.

    Each point moves to the mean of its partners, where the diagonal counts as the foot of their mean; points whose
    partners are mostly on the diagonal fall onto it and go.
    """
    diagrams = [d for d in diagrams]
    centre = max(diagrams, key=len).copy() if diagrams else np.zeros((0, 2))
    for _ in range(rounds):
        partners: list[list[np.ndarray]] = [[] for _ in centre]
        born: list[np.ndarray] = []
        for d in diagrams:
            for i, j, _ in matching(centre, d):
                if i >= 0 and j >= 0:
                    partners[i].append(d[j])
                elif j >= 0:
                    born.append(d[j])
        n, moved = len(diagrams), []
        for own in partners + [[x] for x in born]:
            if own:
                mean = np.mean(own, axis=0)
                foot = np.full(2, mean.mean())
                moved.append((mean * len(own) + foot * (n - len(own))) / n)
        new = np.array([m for m in moved if m[1] - m[0] > 1e-9]).reshape(-1, 2)
        new = new[np.lexsort((new[:, 1], new[:, 0]))] if len(new) else new
        if new.shape == centre.shape and np.allclose(new, centre, atol=1e-9):
            break
        centre = new
    return centre


def cluster_diagrams(diagram: DataFrame, k: int, limit: int | None = 20, rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """(dataset, ClusterId) and the centroids (ClusterId, PairType, Birth, Death): k-means of diagrams under the 2-Wasserstein distance.

    Centroids start at the first dataset and then at the one furthest from all chosen. Assignments run in parallel over
    datasets, centroids over clusters; k=1 gives the barycentre. Centroids, of at most `limit` pairs a type for each
    member, go to all tasks.
    """
    spark = diagram.sparkSession
    own = written(most_persistent(diagram, limit), "diagrams").orderBy("dataset", "PairType")
    names = sorted(r.dataset for r in own.select("dataset").distinct().collect())  # one for each dataset
    if not names:
        return spark.createDataFrame([], "dataset long, ClusterId int"), spark.createDataFrame([], "ClusterId int, PairType int, Birth double, Death double")

    def distances(centres: list[dict[int, np.ndarray]]) -> dict[int, list[float]]:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            mine = {int(t): _rows(x) for t, x in zip(pdf["PairType"], pdf["pairs"], strict=True)}
            empty = np.zeros((0, 2))
            d = [sum(wasserstein(mine.get(t, empty), c.get(t, empty)) ** 2 for t in {*mine, *c}) for c in centres]
            return pd.DataFrame({"dataset": [int(pdf["dataset"].iloc[0])], "d": [d]})

        return {r.dataset: list(r.d) for r in own.groupBy("dataset").applyInPandas(run, "dataset long, d array<double>").collect()}  # k numbers for each dataset

    def of(name: int) -> dict[int, np.ndarray]:
        return {r.PairType: _rows(r.pairs) for r in own.where(F.col("dataset") == name).collect()}

    centres = [of(names[0])]
    while len(centres) < min(k, len(names)):
        far = distances(centres)
        centres.append(of(max(names, key=lambda n: (min(far[n]), -n))))
    label: dict[int, int] = {}
    for _ in range(rounds):
        found = distances(centres)
        new = {n: int(np.argmin(found[n])) for n in names}
        if new == label:
            break
        label = new
        tagged = own.join(F.broadcast(spark.createDataFrame(list(label.items()), "dataset long, c int")), "dataset")
        size = {c: sum(x == c for x in label.values()) for c in range(len(centres))}

        rows = tagged.groupBy("c", "PairType").applyInPandas(_middle(size), "c int, t int, b double, d double").collect()  # the centroids
        made: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for r in rows:
            made[r.c][r.t].append((r.b, r.d))
        centres = [{t: np.array(x) for t, x in made[c].items()} if size[c] else centres[c] for c in range(len(centres))]
    centroid = [(c, int(t), float(b), float(d)) for c, ts in enumerate(centres) for t, x in ts.items() for b, d in x]
    return spark.createDataFrame([(n, label[n]) for n in names], "dataset long, ClusterId int"), spark.createDataFrame(centroid, "ClusterId int, PairType int, Birth double, Death double")


def _middle(size: dict[int, int]):
    """The barycentre of one cluster's pairs of a type; members without such pairs count as empty diagrams."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [_rows(x) for x in pdf["pairs"]]
        lists += [np.zeros((0, 2))] * (size[int(pdf["c"].iloc[0])] - len(lists))
        b = barycenter(lists)
        return pd.DataFrame({"c": int(pdf["c"].iloc[0]), "t": int(pdf["PairType"].iloc[0]), "b": b[:, 0], "d": b[:, 1]})

    return run


def principal_geodesics(diagram: DataFrame, axes: int = 2, limit: int | None = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Barycentre (n, PairType, Birth, Death), axes (n, axis, db, dd) and coefficients (dataset, axis, coefficient) of a set of diagrams.

    In the barycentre's tangent space: each diagram is the vector of the moves from the barycentre's points to their
    partners (or to the diagonal), and axes are those of greatest variance, of length 1, first nonzero entry positive.
    """
    spark = diagram.sparkSession
    own = written(most_persistent(diagram, limit), "diagrams")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        empty = np.zeros((0, 2))
        names = sorted(set(pdf["dataset"]))
        lists = {(int(d), int(t)): _rows(x) for d, t, x in zip(pdf["dataset"], pdf["PairType"], pdf["pairs"], strict=True)}
        kinds = sorted({t for _, t in lists})
        centre = {t: barycenter([lists.get((d, t), empty) for d in names]) for t in kinds}
        moves = []
        for d in names:
            row = []
            for t in kinds:
                to = centre[t].copy()
                for i, j, _ in matching(centre[t], lists.get((d, t), empty)):
                    if i >= 0:
                        to[i] = lists[d, t][j] if j >= 0 else to[i].mean()
                row.append((to - centre[t]).ravel())
            moves.append(np.concatenate(row) if row else np.zeros(0))
        x = np.array(moves)
        x_mean = x.mean(axis=0)
        u, s, vt = np.linalg.svd(x - x_mean, full_matrices=False)
        vt = vt[:axes]
        vt = vt * np.array([np.sign(v[np.flatnonzero(np.abs(v) > 1e-12)[0]]) if (np.abs(v) > 1e-12).any() else 1.0 for v in vt])[:, None]
        points = [(t, b, d) for t in kinds for b, d in centre[t]]
        base = np.array([(b, d) for _, b, d in points]).reshape(-1, 2) + x_mean.reshape(-1, 2)
        out = [("point", i, t, 0, *map(float, base[i])) for i, (t, _, _) in enumerate(points)]
        out += [("axis", i, points[i][0], a, *map(float, vt[a].reshape(-1, 2)[i])) for a in range(len(vt)) for i in range(len(points))]
        out += [("coefficient", int(n), 0, a, float((x[k] - x_mean) @ vt[a]), 0.0) for k, n in enumerate(names) for a in range(len(vt))]
        return pd.DataFrame(out, columns=["kind", "n", "PairType", "axis", "p", "q"])

    made = written(own.groupBy(F.lit(0).alias("_g")).applyInPandas(lambda pdf: run(pdf), "kind string, n long, PairType int, axis int, p double, q double"), "geodesics")
    points = made.where("kind = 'point'").select("n", "PairType", F.col("p").alias("Birth"), F.col("q").alias("Death"))
    lines = made.where("kind = 'axis'").select("n", "axis", F.col("p").alias("db"), F.col("q").alias("dd"))
    return points, lines, made.where("kind = 'coefficient'").select(F.col("n").alias("dataset"), "axis", F.col("p").alias("coefficient"))


def decode_geodesics(points: DataFrame, axes: DataFrame, coefficients: DataFrame) -> DataFrame:
    """(dataset, n, PairType, Birth, Death): the diagrams that coefficients stand for; points on or below the diagonal go."""
    moved = coefficients.join(axes, "axis").groupBy("dataset", "n").agg(F.sum(F.col("coefficient") * F.col("db")).alias("db"), F.sum(F.col("coefficient") * F.col("dd")).alias("dd"))
    return moved.join(points, "n").select("dataset", "n", "PairType", (F.col("Birth") + F.col("db")).alias("Birth"), (F.col("Death") + F.col("dd")).alias("Death")).where("Death > Birth")


# --- tracking ------------------------------------------------------------------------------


def track_diagrams(diagram: DataFrame, p: float = 2.0) -> DataFrame:
    """(TimeStep, PairType, id, next, Cost, head): matches of the pairs of each dataset to those of the next one, datasets being times.

    `id` counts a dataset's pairs of a type by birth and death; `next` is its partner's, null where it goes to the
    diagonal; `head` is `time:type:id` of the first pair of its trajectory.
    """
    own = diagram.where("Death > Birth").groupBy("dataset", "PairType").agg(F.sort_array(F.collect_list(F.struct("Birth", "Death"))).alias("pairs"))
    lists = written(own.select("dataset", "PairType", F.transform("pairs", lambda x: F.array(x["Birth"], x["Death"])).alias("pairs")), "diagrams")
    times = lists.select("dataset").distinct()
    after = times.join(times.withColumnRenamed("dataset", "_n"), F.col("_n") > F.col("dataset"), "left").groupBy("dataset").agg(F.min("_n").alias("then"))  # one row for each time
    both = lists.withColumnRenamed("pairs", "x").join(after, "dataset").join(lists.select(F.col("dataset").alias("then"), "PairType", F.col("pairs").alias("y")), ["then", "PairType"], "left")

    def run(frames):
        for pdf in frames:
            out = []
            for t, kind, then, x, y in zip(pdf["dataset"], pdf["PairType"], pdf["then"], pdf["x"], pdf["y"], strict=True):
                for i, j, cost in matching(_rows(x), _rows(y), p):
                    if i >= 0:
                        out.append((int(t), int(kind), i, None if then != then else int(then) if then is not None else None, j if j >= 0 else None, cost))
            made = pd.DataFrame(out, columns=["TimeStep", "PairType", "id", "then", "next", "Cost"])
            yield made.astype({"then": "Int64", "next": "Int64"})

    found = written(both.repartition("dataset", "PairType").mapInPandas(run, "TimeStep long, PairType int, id long, then long, next long, Cost double"), "matches")
    name = lambda t, i: F.concat_ws(":", F.col(t).cast("string"), F.col("PairType").cast("string"), F.col(i).cast("string"))
    back = found.where("next IS NOT NULL").select(name("then", "next").alias("vid"), name("TimeStep", "id").alias("next"))
    nodes = found.select(name("TimeStep", "id").alias("vid"))
    head = mesh.jump(nodes.join(back, "vid", "left").select("vid", F.coalesce("next", "vid").alias("next"))).withColumnRenamed("next", "head")
    return found.withColumn("vid", name("TimeStep", "id")).join(head, "vid").select("TimeStep", "PairType", "id", "next", "Cost", "head")


def trajectories(tracked: DataFrame) -> DataFrame:
    """(head, PairType, Start, End, ComponentLength): the trajectories of tracked pairs."""
    return tracked.groupBy("head", "PairType").agg(F.min("TimeStep").alias("Start"), F.max("TimeStep").alias("End"), F.count("*").alias("ComponentLength"))


# --- merge trees ---------------------------------------------------------------------------


def branch_trees(tree: DataFrame) -> DataFrame:
    """(dataset, branches): each merge tree (NodeId, Scalar, parent) as its branches (number, parent branch, birth, death), the main one first.

    At a merge, the branch of the furthest leaf goes on; the others end there as its children.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        value = dict(zip(pdf["NodeId"].astype(int), pdf["Scalar"], strict=True))
        up = dict(zip(pdf["NodeId"].astype(int), pdf["parent"].astype(int), strict=True))
        kids = defaultdict(list)
        for x, y in up.items():
            if y >= 0:
                kids[y].append(x)
        root = next(x for x, y in up.items() if y < 0)
        order, stack = [], [root]
        while stack:
            x = stack.pop()
            order.append(x)
            stack += kids[x]
        leaf = {}
        for x in reversed(order):  # leaves first
            leaf[x] = max((leaf[y] for y in kids[x]), key=lambda z: (abs(value[z] - value[root]), -z)) if kids[x] else x
        number, rows = {leaf[root]: 0}, [(0, -1, value[leaf[root]], value[root])]
        for x in order:
            for y in sorted(kids[x]):
                if leaf[y] != leaf[x]:
                    number[leaf[y]] = len(rows)
                    rows.append((len(rows), number[leaf[x]], value[leaf[y]], value[x]))
        return pd.DataFrame({"dataset": [int(pdf["dataset"].iloc[0])], "branches": [[list(map(float, r)) for r in rows]]})

    return tree.groupBy("dataset").applyInPandas(run, "dataset long, branches array<array<double>>")


def branch_distance(a: np.ndarray, b: np.ndarray, normalized: bool = True) -> float:
    """The Wasserstein distance of two merge trees: branches match as trees, so that parents of partners are partners.

    Branches are (number, parent, birth, death); with `normalized`, births and deaths count relative to the parent's span.
    """

    def prepared(t: np.ndarray):
        kids = defaultdict(list)
        for n, up, _, _ in t:
            if up >= 0:
                kids[int(up)].append(int(n))
        span = {}
        for n, up, birth, death in t:
            lo, hi = min(birth, death), max(birth, death)
            if normalized and up >= 0:
                base = t[int(up)]
                p, q = min(base[2], base[3]), max(base[2], base[3])
                span[int(n)] = ((lo - p) / (q - p), (hi - p) / (q - p)) if q > p else (0.0, 0.0)
            else:
                span[int(n)] = (lo, hi)
        return kids, span

    (ka, sa), (kb, sb) = prepared(a), prepared(b)
    gone = lambda s: (s[1] - s[0]) ** 2 / 2

    def sizes(kids, span):
        total = {}
        for n in sorted(span, reverse=True):  # children have greater numbers
            total[n] = gone(span[n]) + sum(total[c] for c in kids[n])
        return total

    da, db = sizes(ka, sa), sizes(kb, sb)
    known: dict[tuple[int, int], float] = {}

    def depth_order():
        return [(i, j) for i in sorted(sa, reverse=True) for j in sorted(sb, reverse=True)]

    for i, j in depth_order():
        own = (sa[i][0] - sb[j][0]) ** 2 + (sa[i][1] - sb[j][1]) ** 2
        x, y = ka[i], kb[j]
        if x or y:
            cost = np.zeros((len(x) + len(y),) * 2)
            for r, c in enumerate(x):
                cost[r, : len(y)] = [known[c, e] for e in y]
                cost[r, len(y) :] = da[c]
            cost[len(x) :, : len(y)] = [db[e] for e in y]
            own += cost[np.arange(len(cost)), assign(cost)].sum()
        known[i, j] = own
    return float(np.sqrt(known[0, 0]))


def tree_distance_matrix(trees: DataFrame, normalized: bool = True) -> DataFrame:
    """(i, j, d), i < j: distances of branch trees (dataset, branches), each pair in one call; all pairs, by definition."""
    pair = trees.select(F.col("dataset").alias("i"), F.col("branches").alias("x")).join(trees.select(F.col("dataset").alias("j"), F.col("branches").alias("y")), F.col("i") < F.col("j"))

    @F.pandas_udf("double")
    def d(x: pd.Series, y: pd.Series) -> pd.Series:
        table = lambda z: np.array([list(r) for r in z], float)
        return pd.Series([branch_distance(table(s), table(t), normalized) for s, t in zip(x, y, strict=True)])

    return pair.repartition("i", "j").select("i", "j", d("x", "y").alias("d"))


def cluster_by_distance(matrix: DataFrame, k: int, rounds: int = 50) -> DataFrame:
    """(dataset, ClusterId): k-medoids of a long-form matrix (i, j, d); medoids start at the first dataset and then at the furthest."""
    rows = matrix.collect()  # one number for each two of the members clustered
    names = sorted({r.i for r in rows} | {r.j for r in rows})
    place = {n: i for i, n in enumerate(names)}
    d = np.zeros((len(names),) * 2)
    for r in rows:
        d[place[r.i], place[r.j]] = d[place[r.j], place[r.i]] = r.d
    chosen = [0]
    while len(chosen) < min(k, len(names)):
        chosen.append(int(np.argmax(d[:, chosen].min(axis=1))))
    for _ in range(rounds):
        label = np.argmin(d[:, chosen], axis=1)
        new = [int(own[np.argmin(d[np.ix_(own, own)].sum(axis=1))]) for own in (np.flatnonzero(label == c) for c in range(len(chosen)))]
        if new == chosen:
            break
        chosen = new
    return matrix.sparkSession.createDataFrame([(int(n), int(c)) for n, c in zip(names, np.argmin(d[:, chosen], axis=1), strict=True)], "dataset long, ClusterId int")


# --- reduction of series -------------------------------------------------------------------


def reduce_series(fields: DataFrame, keep: int) -> DataFrame:
    """(t, Alpha, before, after): of the frames (t, vid, v), `keep` key frames, and for each other one its place between two of them.

    Frames go one by one, the one that its neighbours blend best (L2) first; first and last stay. All errors come from
    the products of each two frames, summed over vertices in parallel; the greedy choice sees only those.
    """
    sums = fields.select("vid", F.col("t").alias("s"), F.col("v").cast("double").alias("a")).join(fields.select("vid", "t", F.col("v").cast("double").alias("b")), "vid").where("s <= t").groupBy("s", "t").agg(F.sum(F.col("a") * F.col("b")).alias("g"))
    rows = sums.collect()  # one number for each two frames
    times = sorted({r.t for r in rows})
    n, place = len(times), {t: i for i, t in enumerate(times)}
    g = np.zeros((n, n))
    for r in rows:
        g[place[r.s], place[r.t]] = g[place[r.t], place[r.s]] = r.g

    def error(i: int, m: int, j: int) -> float:
        a = (times[j] - times[m]) / (times[j] - times[i])
        return g[m, m] + a * a * g[i, i] + (1 - a) ** 2 * g[j, j] - 2 * a * g[m, i] - 2 * (1 - a) * g[m, j] + 2 * a * (1 - a) * g[i, j]

    live = list(range(n))
    while len(live) > max(keep, 2):
        k = min(range(1, len(live) - 1), key=lambda k: (sum(max(error(live[k - 1], m, live[k + 1]), 0.0) for m in range(live[k - 1] + 1, live[k + 1])), k))
        live.pop(k)
    out = []
    for i in range(n):
        if i in live:
            out.append((times[i], None, times[i], times[i]))
        else:
            before, after = max(x for x in live if x < i), min(x for x in live if x > i)
            out.append((times[i], float((times[after] - times[i]) / (times[after] - times[before])), times[before], times[after]))
    return fields.sparkSession.createDataFrame(out, "t long, Alpha double, before long, after long")


def restore_series(frames: DataFrame, fields: DataFrame) -> DataFrame:
    """(t, vid, v): the series from its key frames (t, vid, v) and the table that `reduce_series` makes."""
    at = lambda side: fields.select(F.col("t").alias(side), "vid", F.col("v").cast("double").alias(f"_{side}"))
    both = frames.join(at("before"), "before").join(at("after"), ["after", "vid"])
    return both.select("t", "vid", F.when(F.col("Alpha").isNull(), F.col("_before")).otherwise(F.col("Alpha") * F.col("_before") + (1 - F.col("Alpha")) * F.col("_after")).alias("v"))

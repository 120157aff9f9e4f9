"""Dimension reduction, harmonic fields and eigenfunctions.

PCA sums products over all rows in parallel and decomposes a matrix of columns by columns. The other methods need all
distances of a dataset, and run once for each dataset, in parallel over datasets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pca(df: DataFrame, key: str, columns: list[str], components: int = 2) -> DataFrame:
    """(key, Component_0, ...): projections of centred rows on the axes of greatest variance; the first nonzero weight of an axis is positive.

    Rows with a null in one of the columns have none.
    """
    known = df.where(reduce_and([F.col(c).isNotNull() for c in columns])).select(key, *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    n = len(columns)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total, products = 0, np.zeros(n), np.zeros((n, n))
        for pdf in frames:
            x = pdf.to_numpy(float)
            count, total, products = count + len(x), total + x.sum(axis=0), products + x.T @ x
        yield pd.DataFrame({"n": [count], "s": [total.tolist()], "p": [products.ravel().tolist()]})

    parts = known.select(*[f"_{i}" for i in range(n)]).mapInPandas(sums, "n long, s array<double>, p array<double>").collect()  # one row a task
    count = sum(r.n for r in parts)
    if not count:
        return known.select(key, *[F.lit(0.0).alias(f"Component_{k}") for k in range(components)])
    mean = sum(np.array(r.s) for r in parts) / count
    covariance = sum(np.array(r.p).reshape(n, n) for r in parts) / count - np.outer(mean, mean)
    _, axes = np.linalg.eigh(covariance)
    axes = axes[:, ::-1][:, :components]
    axes = axes * np.array([np.sign(a[np.flatnonzero(np.abs(a) > 1e-12)[0]]) for a in axes.T])
    project = lambda k: sum(((F.col(f"_{i}") - float(mean[i])) * float(axes[i, k]) for i in range(n)), F.lit(0.0))
    return known.select(key, *[project(k).alias(f"Component_{k}") for k in range(components)])


def reduce_and(tests: list[Column]) -> Column:
    held = F.lit(True)
    for t in tests:
        held = held & t
    return held


def distances(x: np.ndarray) -> np.ndarray:
    step = max(1, (1 << 22) // max(1, x.size))  # differences of so many rows at once
    return np.concatenate([np.sqrt(((x[i : i + step, None, :] - x[None, :, :]) ** 2).sum(axis=2)) for i in range(0, max(len(x), 1), step)])


class Distances:
    """Rows of the matrix of distances, made as they are asked for."""

    def __init__(self, x: np.ndarray):
        self.x, self.q = np.ascontiguousarray(x), (x * x).sum(axis=1)

    def __len__(self) -> int:
        return len(self.x)

    def __getitem__(self, i: int) -> np.ndarray:
        return np.sqrt(((self.x - self.x[i]) ** 2).sum(axis=1))

    def keep(self, places: np.ndarray) -> "Distances":
        return Distances(self.x[places])

    def closer(self, point: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places nearer to a point than given, and how near: a product rules out most, the rest go by differences."""
        q = point @ point
        bound = 8 * (len(point) + 2) * np.finfo(float).eps * (self.q.max() + q)
        at = np.flatnonzero(~(self.q + q - 2 * (self.x @ point) > best * best + bound) & (best > -np.inf))
        d = np.sqrt(((self.x[at] - point) ** 2).sum(axis=1))
        on = d < best[at]
        return at[on], d[on]


def scaling(d: np.ndarray, k: int) -> np.ndarray:
    """Classical multidimensional scaling."""
    n = len(d)
    centre = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * centre @ (d**2) @ centre)
    return vectors[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k], 0))


def euclidean_scaling(x: np.ndarray, k: int) -> np.ndarray:
    """The same of the rows' Euclidean distances, without these: the centred rows on their k main axes, of which the first nonzero weight is positive."""
    u, size, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    signs = np.array([np.sign(a[np.flatnonzero(np.abs(a) > 1e-12)[0]]) if (np.abs(a) > 1e-12).any() else 1.0 for a in axes[:k]])
    out = np.zeros((len(x), k))
    out[:, : len(signs)] = u[:, :k] * size[:k] * signs
    return out


def _neighbours(d: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row; ties by place."""
    own = d.copy()
    np.fill_diagonal(own, -1)
    return np.argsort(own, axis=1, kind="stable")[:, 1 : k + 1]


def isomap(d: np.ndarray, k: int, neighbours: int) -> np.ndarray:
    """Scaling of path lengths over the graph of nearest neighbours; pieces without a path are set apart by the greatest length."""
    n = len(d)
    g = np.full((n, n), np.inf)
    for i, js in enumerate(_neighbours(d, neighbours)):
        g[i, js] = g[js, i] = d[i, js]
    np.fill_diagonal(g, 0)
    for m in range(n):
        g = np.minimum(g, g[:, m, None] + g[None, m, :])
    return scaling(np.where(np.isinf(g), g[np.isfinite(g)].max() * 2 + 1, g), k)


def spectral(d: np.ndarray, k: int, neighbours: int) -> np.ndarray:
    """Eigenvectors of the normalised Laplacian of the graph of nearest neighbours, but for the constant one."""
    n = len(d)
    a = np.zeros((n, n))
    for i, js in enumerate(_neighbours(d, neighbours)):
        a[i, js] = 1
    a = (a + a.T) / 2
    degree = np.sqrt(a.sum(axis=1))
    _, vectors = np.linalg.eigh(np.eye(n) - a / np.outer(degree, degree))
    return vectors[:, 1 : k + 1] / degree[:, None]


def locally_linear(x: np.ndarray, k: int, neighbours: int) -> np.ndarray:
    """Locally linear embedding: each row as a sum of its neighbours, kept in fewer dimensions."""
    n = len(x)
    m = np.eye(n)
    for i, js in enumerate(_neighbours(distances(x), neighbours)):
        z = x[js] - x[i]
        gram = z @ z.T
        gram += np.eye(len(js)) * 1e-3 * max(np.trace(gram), 1e-12)
        w = np.linalg.solve(gram, np.ones(len(js)))
        m[i, js] -= w / w.sum()
    _, vectors = np.linalg.eigh(m.T @ m)
    return vectors[:, 1 : k + 1] * np.sqrt(n)


def tsne(d: np.ndarray, k: int, perplexity: float, rounds: int = 400) -> np.ndarray:
    """t-SNE by gradient descent from the scaling of the distances."""
    n = len(d)
    p = np.zeros((n, n))
    for i in range(n):
        low, high, beta = 0.0, np.inf, 1.0
        for _ in range(60):
            w = np.exp(-(d[i] ** 2) * beta)
            w[i] = 0
            s = max(w.sum(), 1e-300)
            entropy = np.log(s) + beta * (d[i] ** 2 * w).sum() / s
            if abs(entropy - np.log(perplexity)) < 1e-5:
                break
            low, high = (beta, high) if entropy > np.log(perplexity) else (low, beta)
            beta = beta * 2 if np.isinf(high) else (low + high) / 2
        p[i] = w / s
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = scaling(d, k)
    y = y / max(y.std(), 1e-12) * 1e-2
    step, gain = np.zeros_like(y), np.ones_like(y)
    for t in range(rounds):
        q = 1 / (1 + distances(y) ** 2)
        np.fill_diagonal(q, 0)
        diff = ((4 if t < 100 else 1) * p - q / q.sum()) * q
        grad = 4 * (np.diag(diff.sum(axis=1)) - diff) @ y
        gain = np.maximum(np.where(np.sign(grad) == np.sign(step), gain * 0.8, gain + 0.2), 0.01)
        step = (0.5 if t < 100 else 0.8) * step - 50 * gain * grad
        y = y + step
    return y - y.mean(axis=0)


def spanning_tree(d: np.ndarray | Distances) -> list[tuple[float, int, int]]:
    """Edges (length, i, j) of the least spanning tree in ascending order; ties by ends."""
    n = len(d)
    left, near, out = np.arange(n), np.zeros(n, int), []
    best = d[0].copy() if n else np.zeros(0)
    rows, ruled = d, best.copy()  # ruled: what a row must undercut, nothing can once it is in the tree
    best[:1], ruled[:1] = np.inf, -np.inf
    for done in range(1, n):
        m = int(np.argmin(best))
        if best[m] == np.inf:  # no finite length is left
            m = int(np.flatnonzero(ruled > -np.inf)[0])
        j = int(left[m])
        out.append((float(ruled[m]), min(int(near[m]), j), max(int(near[m]), j)))
        best[m], ruled[m] = np.inf, -np.inf
        if isinstance(rows, Distances):
            at, length = rows.closer(d.x[j], ruled)
        else:
            at = np.flatnonzero(d[j][left] < ruled)
            length = d[j][left[at]]
        best[at] = ruled[at] = length
        near[at] = j
        if 2 * (n - 1 - done) < len(left):
            on = np.flatnonzero(ruled > -np.inf)
            left, near, best, ruled = left[on], near[on], best[on], ruled[on]
            rows = rows.keep(on) if isinstance(rows, Distances) and len(on) else rows
    return sorted(out)


def _hull(p: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise."""
    order = p[np.lexsort((p[:, 1], p[:, 0]))]
    if len(order) < 3:
        return order
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    def half(points):
        line: list = []
        for q in points:
            while len(line) > 1 and turn(line[-2], line[-1], q) <= 0:
                line.pop()
            line.append(q)
        return line

    corners = half(order.tolist())[:-1] + half(order[::-1].tolist())[:-1]
    return np.array(corners) if corners else order[:1]


def topomap(d: np.ndarray | Distances) -> np.ndarray:
    """A plane layout in which components merge at the same lengths as in the given distances.

    Edges of the least spanning tree, in order, join two laid-out pieces: each is turned until a side of its hull lies
    level, one below and one above, and they are set apart by the edge's length. Only hulls move; a piece's points, as
    complex numbers, stay in a frame (turn, shift) of their own, into which those of a smaller piece go when it joins.
    """
    n = len(d)
    at, of = np.zeros(n, complex), list(range(n))
    piece, hull, frame = {i: [i] for i in range(n)}, {i: np.zeros(1, complex) for i in range(n)}, {i: (1 + 0j, 0j) for i in range(n)}

    def level(p: int, anchor: int, above: bool, shift: complex) -> None:
        """Turns the piece so that the hull side next to the anchor's nearest hull corner is level, the rest above or below."""
        (turn, by), corners = frame[p], hull[p]
        k = int(np.argmin(np.abs(corners - (turn * at[anchor] + by)) ** 2))
        a, b = corners[k], corners[(k + 1) % len(corners)]
        w = np.conj(b - a) / abs(b - a) if b != a else 1 + 0j
        w = w if above else -w
        hull[p] = (corners - a) * w + shift
        turn = turn * w
        frame[p] = (turn / abs(turn), (by - a) * w + shift)

    for length, i, j in spanning_tree(d):
        a, b = of[i], of[j]
        level(a, i, True, length * 1j)
        level(b, j, False, 0j)
        corners = np.concatenate([hull[a], hull[b]])
        corners = _hull(np.column_stack([corners.real, corners.imag]))
        if len(piece[a]) < len(piece[b]):
            a, b = b, a
        (turn, by), (turn_b, by_b) = frame[a], frame.pop(b)
        moved = piece.pop(b)
        at[moved] = (turn_b * at[moved] + by_b - by) * np.conj(turn)
        for x in moved:
            of[x] = a
        piece[a] += moved
        hull[a] = corners[:, 0] + 1j * corners[:, 1]
        hull.pop(b)
    for p, (turn, by) in frame.items():
        at[piece[p]] = turn * at[piece[p]] + by
    return np.column_stack([at.real, at.imag])


METHODS = ("MDS", "IsoMap", "SE", "LLE", "t-SNE", "TopoMap")


def reduce_dimension(df: DataFrame, key: str, vector: str, method: str, components: int = 2, neighbours: int = 5, perplexity: float = 20.0, by: str | None = None) -> DataFrame:
    """(by, key, Component_0, ...): an embedding of the rows' vectors, all of a dataset in one task.

    MDS and TopoMap hold the vectors, not their distances; the others hold a number for each pair of a dataset.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    if method == "TopoMap" and components != 2:
        raise ValueError("TopoMap makes two components")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        x = np.array(pdf["v"].tolist(), float)
        made = {"MDS": lambda: euclidean_scaling(x, components), "IsoMap": lambda: isomap(distances(x), components, neighbours), "SE": lambda: spectral(distances(x), components, neighbours), "LLE": lambda: locally_linear(x, components, neighbours), "t-SNE": lambda: tsne(distances(x), components, min(perplexity, max((len(x) - 1) / 3, 1))), "TopoMap": lambda: topomap(Distances(x))}[method]()
        return pd.DataFrame({"g": pdf["g"], "k": pdf["k"], **{f"Component_{i}": made[:, i] for i in range(components)}})

    rows = df.select(F.col(by).cast("string").alias("g") if by else F.lit("").alias("g"), F.col(key).cast("long").alias("k"), F.col(vector).alias("v")).where("v IS NOT NULL")
    schema = "g string, k long, " + ", ".join(f"Component_{i} double" for i in range(components))
    out = rows.groupBy("g").applyInPandas(run, schema).withColumnRenamed("k", key)
    return out.withColumnRenamed("g", by) if by else out.drop("g")


def harmonic_field(points: DataFrame, edges: DataFrame, held: DataFrame, log_alpha: float = 5.0, within: float = 1e-12) -> DataFrame:
    """(dataset, vid, v): least energy over each dataset's edges, with a penalty of 10 ** log_alpha on the held values (dataset, vid, v).

    Conjugate gradients, scaled by the diagonal, one dataset in a task. Of a vertex held twice, its least value counts;
    without any held vertex the field is 0.
    """
    from fieldloom.operators.topology import with_neighbours

    fixed = held.groupBy("dataset", "vid").agg(F.min(F.col("v").cast("double")).alias("h"))
    rows = with_neighbours(points, edges).join(fixed, ["dataset", "vid"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vid")
        ids = pdf["vid"].to_numpy()
        place = {v: i for i, v in enumerate(ids.tolist())}
        a, b = np.array([(i, place[x]) for i, near in enumerate(pdf["nbrs"]) for x in near if x in place and place[x] != i], np.int64).reshape(-1, 2).T
        n, h = len(ids), pdf["h"].to_numpy(float)
        penalty = np.where(np.isnan(h), 0.0, 10.0**log_alpha)
        diagonal = np.bincount(a, minlength=n) + penalty
        scale = np.where(diagonal > 0, diagonal, 1.0)
        right = penalty * np.nan_to_num(h)
        x, r = np.zeros(n), right.copy()
        z = r / scale
        p, rho = z.copy(), r @ z
        first = rho
        for _ in range(20 * n):
            if rho <= within * within * first:
                return pd.DataFrame({"dataset": pdf["dataset"].iloc[0], "vid": ids, "v": x})
            ap = diagonal * p - np.bincount(a, weights=p[b], minlength=n)
            alpha = rho / (p @ ap)
            x, r = x + alpha * p, r - alpha * ap
            z = r / scale
            rho, old = r @ z, rho
            p = z + rho / old * p
        raise ValueError("no convergence")

    return rows.groupBy("dataset").applyInPandas(run, "dataset long, vid long, v double")


def eigen_fields(points: DataFrame, edges: DataFrame, count: int) -> DataFrame:
    """(dataset, vid, EigenFunctions, Minimum, Maximum, Sum, Average): the first eigenfunctions of each dataset's graph Laplacian.

    The first entry that isn't 0 of each function is positive; a dataset is decomposed in one task.
    """
    from fieldloom.operators.topology import _graph, with_neighbours

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, _, near = _graph(pdf)
        n = len(ids)
        a = np.zeros((n, n))
        for i, js in near.items():
            a[i, [j for j in js if j != i]] = 1
        a = np.maximum(a, a.T)
        _, vectors = np.linalg.eigh(np.diag(a.sum(axis=1)) - a)
        x = vectors[:, :count]
        x = x * np.array([np.sign(c[np.flatnonzero(np.abs(c) > 1e-9)[0]]) for c in x.T])
        return pd.DataFrame({"dataset": pdf["dataset"].iloc[0], "vid": ids, "EigenFunctions": x.tolist(), "Minimum": x.min(axis=1), "Maximum": x.max(axis=1), "Sum": x.sum(axis=1), "Average": x.mean(axis=1)})

    return with_neighbours(points, edges).groupBy("dataset").applyInPandas(run, "dataset long, vid long, EigenFunctions array<double>, Minimum double, Maximum double, Sum double, Average double")

"""Kernels and fixpoints against brute force."""

import heapq
import itertools

import numpy as np

from fieldloom.operators import mesh, topology


def test_assignment_is_least():
    r = np.random.default_rng(1)
    for n in range(1, 6):
        cost = r.random((n, n))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert abs(cost[np.arange(n), topology.assign(cost)].sum() - best) < 1e-9


def test_wasserstein():
    a, b = np.array([[0.0, 4.0]]), np.array([[0.0, 3.0]])
    assert topology.wasserstein(a, a) == 0
    assert abs(topology.wasserstein(a, b) - 1) < 1e-9
    assert abs(topology.wasserstein(a, np.zeros((0, 2))) - np.sqrt(8)) < 1e-9


def test_path_diagram(spark):
    points = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate((3, 1, 5, 0, 4))], "dataset long, vid long, v double")
    edges = spark.createDataFrame([(0, i, j) for i in range(5) for j in (i - 1, i + 1)], "dataset long, vid long, nvid long")
    found = {(r.PairType, r.Birth, r.Death, r.IsFinite) for r in topology.persistence_diagram(points, edges).collect()}
    assert found == {(0, 1.0, 5.0, True), (0, 0.0, 5.0, False), (1, 1.0, 3.0, True), (1, 0.0, 4.0, True)}
    flat = {r.vid: r.v for r in topology.simplify(points, edges, 4.5).collect()}
    assert flat[1] == 5.0 and flat[3] == 0.0
    tree = topology.merge_tree(points, edges).collect()
    node = {r.NodeId: r.VertexId for r in tree}
    assert sorted((r.VertexId, r.CriticalType, node.get(r.parent)) for r in tree) == [(1, 0, 2), (2, 1, None), (3, 0, 2)]


def test_distance_field(spark):
    r = np.random.default_rng(2)
    ids = list(range(40))
    pairs = {(a, b) for a, b in r.integers(0, 40, (80, 2)).tolist() if a != b}
    pairs |= {(b, a) for a, b in pairs}
    points = spark.createDataFrame([(i, 0.0) for i in ids], "vid long, v double")
    edges = spark.createDataFrame(sorted(pairs), "vid long, nvid long")
    near = {i: [b for a, b in pairs if a == i] for i in ids}
    best, queue = {}, [(0.0, s, s) for s in (0, 7)]
    while queue:
        d, s, x = heapq.heappop(queue)
        if x not in best:
            best[x] = (d, s)
            for y in near[x]:
                heapq.heappush(queue, (d + 1, s, y))
    assert {r.vid: (r.distance, r.source) for r in mesh.distance_field(points, edges, [0, 7]).collect()} == best


def test_merge_points(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 0.9, 0.0, 0.0), (2, 1.7, 0.0, 0.0), (3, 9.0, 0.0, 0.0)], "vid long, x double, y double, z double")
    assert {r.vid: r.representative for r in mesh.merge_points(points, 1.0).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}


def test_empty(spark):
    points = spark.createDataFrame([], "dataset long, vid long, v double")
    edges = spark.createDataFrame([], "dataset long, vid long, nvid long")
    assert topology.persistence_diagram(points, edges).count() == 0
    assert mesh.components(points, edges).count() == 0


def brute_components(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[a] = b
    return {i: find(i) for i in ids}


def test_components_of_any_length(spark):
    r = np.random.default_rng(3)
    shuffled = (1000 + r.permutation(300)).tolist()
    ids = [*range(300), *shuffled, *range(2000, 2150)]
    # A path with ascending ids, one with shuffled ids, and a sparse random graph.
    pairs = [(i, i + 1) for i in range(299)] + list(zip(shuffled, shuffled[1:], strict=False)) + r.integers(2000, 2150, (90, 2)).tolist()
    points = spark.createDataFrame([(i,) for i in ids], "vid long")
    edges = spark.createDataFrame(pairs, "vid long, nvid long")
    found = mesh.components(points, edges).collect()
    assert len(found) == len(ids)
    assert {x.vid: x.ComponentId for x in found} == brute_components(ids, pairs)


def test_merge_points_along_a_line(spark):
    points = spark.createDataFrame([(i, 0.9 * i, 0.0, 0.0) for i in range(150)], "vid long, x double, y double, z double")
    assert {r.representative for r in mesh.merge_points(points, 1.0).collect()} == {0}


def test_merge_points_links_grow_with_the_points(spark, monkeypatch):
    r = np.random.default_rng(4)
    x = np.round(r.random((400, 3)) * (6, 6, 1), 2)
    x[300:, :] = (50, 50, 50)  # copies
    x[0] = (np.nan, 0, 0)
    x[1] = (np.inf, 0, 0)
    x[2] = (np.inf, 0, 0)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "vid long, x double, y double, z double")
    sent, components = [], mesh.components
    monkeypatch.setattr(mesh, "components", lambda ids, edges: sent.append(edges.count()) or components(ids, edges))
    for radius in (0.4, 0.55, 1.0, 20.0):
        label = list(range(400))
        for _ in range(400):
            new = [min(label[j] for j in range(400) if j == i or ((x[i] - x[j]) ** 2).sum() < radius * radius) for i in range(400)]
            if new == label:
                break
            label = new
        assert {q.vid: q.representative for q in mesh.merge_points(df, radius).collect()} == dict(enumerate(label))
    assert sent[-1] <= 400  # one cell holds most points, whose pairs are 44,000

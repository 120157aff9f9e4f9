"""Mesh, topology, comparison and embedding operators against brute force, on small random inputs."""

import itertools

import numpy as np
import pytest

from fieldloom.operators import approximation, comparison, complexes, embedding, geometry, mesh, metrics, morse, topology, triangulation
from fieldloom.sources import cinema
from fieldloom.streaming import tracking

NX, NY = 7, 6


@pytest.fixture(scope="module")
def plane(spark):
    """Points and triangles of a small grid with ties, and its values."""
    r = np.random.default_rng(5)
    v = r.integers(0, 12, NX * NY).astype(float)
    points = spark.createDataFrame([(0, i, i % NX, i // NX, float(i % NX), float(i // NX), 0.0, x) for i, x in enumerate(v.tolist())], "dataset long, vid long, i int, j int, x double, y double, z double, v double")
    cells = triangulation.grid_triangles(points, NX, NY)
    return points, cells, v


def simplices(cells, v):
    back = sorted(range(len(v)), key=lambda x: (v[x], x))
    rank = {x: k for k, x in enumerate(back)}
    return complexes.closure({tuple(sorted((rank[x] for x in r.verts), reverse=True)) for r in cells.collect()}), back


def test_pairs_of_a_surface(plane):
    points, cells, v = plane
    found, back = simplices(cells, v)
    pairs, _, _ = complexes.reduction(found)
    want = sorted((back[b[0]], back[d[0]]) for b, d in pairs if len(b) == 2 and b[0] != d[0])
    assert sorted((r.birth_vertex, r.death_vertex) for r in morse.surface_pairs(points, cells).collect()) == want
    low = sorted((back[b[0]], back[d[0]]) for b, d in pairs if len(b) == 1 and b[0] != d[0])
    edges = triangulation.edges(cells).selectExpr("0L AS dataset", "vid", "nvid")
    diagram = topology.persistence_diagram(points, edges).collect()
    assert sorted((r.birth_vertex, r.death_vertex) for r in diagram if r.PairType == 0 and r.IsFinite) == low
    ends = [(r.birth_vertex, r.death_vertex) for r in diagram if not r.IsFinite]
    assert ends == [(back[0], back[-1])]
    full = morse.simplex_diagram(points, cells.selectExpr("0L AS dataset", "cid", "verts")).collect()
    assert sorted((r.birth_vertex, r.death_vertex) for r in full if r.IsFinite) == sorted(want + low)


def test_gradient_and_separatrices(plane):
    points, cells, v = plane
    rows = morse.discrete_gradient(points, cells).collect()
    used = [tuple(r.cell) for r in rows] + [tuple(r.pair) for r in rows if r.pair]
    found, _ = simplices(cells, v)
    assert len(used) == len(set(used)) == len(found)
    critical = [r.dim for r in rows if r.pair is None]
    assert critical.count(0) - critical.count(1) + critical.count(2) == 1  # of a disc
    made = morse.morse_smale(points, cells)
    minima = {tuple(r.cell) for r in rows if r.pair is None and r.dim == 0}
    tops = {tuple(r.cell) for r in rows if r.pair is None and r.dim == 2}
    ends = {(r.SeparatrixType, tuple(r.destination) if r.destination else None) for r in made["separatrices"].collect()}
    assert {d for t, d in ends if t == 0} <= minima and {d for t, d in ends if t == 1} <= tops | {None}


def test_contour_tree(plane):
    points, cells, v = plane
    edges = triangulation.edges(cells).selectExpr("0L AS dataset", "vid", "nvid")
    arcs, segmentation = (df.collect() for df in morse.contour_tree(points, edges))
    nodes = {x for r in arcs for x in (r.downNodeId, r.upNodeId)}
    assert len(arcs) == len(nodes) - 1
    assert all((v[r.downNodeId], r.downNodeId) < (v[r.upNodeId], r.upNodeId) for r in arcs)
    near = {}
    for r in edges.collect():
        near.setdefault(r.vid, []).append((v[r.nvid], r.nvid))
    lowest = {x for x in near if all((v[x], x) < y for y in near[x])}
    highest = {x for x in near if all((v[x], x) > y for y in near[x])}
    assert lowest == nodes - {r.upNodeId for r in arcs} and highest == nodes - {r.downNodeId for r in arcs}
    by = {r.SegmentationId: r for r in arcs}
    assert all(v[by[r.SegmentationId].downNodeId] <= v[r.vid] <= v[by[r.SegmentationId].upNodeId] for r in segmentation)


def test_simplification_keeps_what_is_listed(plane):
    points, cells, v = plane
    edges = triangulation.edges(cells).selectExpr("0L AS dataset", "vid", "nvid")
    near = {}
    for r in edges.collect():
        near.setdefault(r.vid, []).append(r.nvid)
    lowest = sorted((x for x in near if all((v[x], x) < (v[y], y) for y in near[x])), key=lambda x: (v[x], x))
    flat = {r.vid: r.v for r in topology.simplify_to(points, edges, lowest[:1]).collect()}
    assert all(flat[x] >= v[x] for x in flat)  # maxima aren't listed, and stay
    # A minimum that is left is a plateau's, with a neighbour as low outside of it, or the listed one.
    levels = {x for x in flat if all(flat[x] < flat[y] for y in near[x])}
    assert levels <= {lowest[0]}


def test_generators_are_cycles(plane):
    points, cells, _ = plane
    rows = morse.generators(points, cells.selectExpr("0L AS dataset", "cid", "verts")).collect()
    for n in {r.generator for r in rows}:
        ends = [x for r in rows if r.generator == n for x in (r.a, r.b)]
        assert all(ends.count(x) % 2 == 0 for x in ends)


def test_bottleneck_is_least():
    r = np.random.default_rng(6)
    for n, m in ((2, 2), (3, 1), (0, 2), (3, 3)):
        a, b = (np.sort(r.random((k, 2)), axis=1) for k in (n, m))
        d, pairs = comparison.bottleneck(a, b)
        cost = lambda i, j: np.abs(a[i] - b[j]).max() if i < n and j < m else (a[i, 1] - a[i, 0]) / 2 if i < n else (b[j, 1] - b[j, 0]) / 2 if j < m else 0
        best = min(max(cost(i, p[i]) for i in range(n + m)) for p in itertools.permutations(range(n + m)))
        assert d == pytest.approx(best) and max([c for *_, c in pairs], default=0) == pytest.approx(best)


def test_diagrams_cluster_and_track(spark):
    rows = [(t, 0, float(k), float(k) + 5 + (t >= 3) * 20 + 0.1 * t) for t in range(6) for k in range(2)]
    diagram = spark.createDataFrame([(t, 10 * t + i, 0, 0, k, b, d, True) for i, (t, k, b, d) in enumerate(rows)], "dataset long, birth_vertex long, death_vertex long, x int, PairType int, Birth double, Death double, IsFinite boolean")
    labels = {r.dataset: r.ClusterId for r in comparison.cluster_diagrams(diagram, 2)[0].collect()}
    assert labels[0] == labels[1] == labels[2] != labels[3] == labels[4] == labels[5]
    lines = comparison.trajectories(comparison.track_diagrams(diagram)).collect()
    assert sum(r.ComponentLength for r in lines) == len(rows) and max(r.ComponentLength for r in lines) >= 3
    points, axes, coefficients = comparison.principal_geodesics(diagram, 12)
    again = {(r.dataset, round(r.Birth, 5), round(r.Death, 5)) for r in comparison.decode_geodesics(points, axes, coefficients).collect()}
    assert {(t, round(b, 5), round(d, 5)) for t, _, b, d in rows} <= again


def test_branch_distance():
    a = np.array([[0, -1, 0, 10], [1, 0, 2, 8]], float)
    b = np.array([[0, -1, 0, 10]], float)
    assert comparison.branch_distance(a, a) == 0
    assert comparison.branch_distance(a, b, normalized=False) == pytest.approx(np.sqrt(18))


def test_series_of_blends_is_restored(spark):
    frames = [(t, k, float(k * t if t <= 4 else 8 * k - k * t)) for t in range(9) for k in range(3)]
    fields = spark.createDataFrame(frames, "t long, vid long, v double")
    kept = comparison.reduce_series(fields, 3)
    assert sorted(r.t for r in kept.where("Alpha IS NULL").collect()) == [0, 4, 8]
    assert {(r.t, r.vid): round(r.v, 9) for r in comparison.restore_series(kept, fields).collect()} == {(t, k): v for t, k, v in frames}


def test_compression_and_mandatory(plane, spark, tmp_path):
    points, cells, v = plane
    edges = triangulation.edges(cells).selectExpr("0L AS dataset", "vid", "nvid")
    approximation.write_compressed(points, edges, 0.2, str(tmp_path / "c"))
    got = {r.vid: r.v for r in approximation.read_compressed(spark, str(tmp_path / "c")).collect()}
    assert max(abs(got[i] - x) for i, x in enumerate(v)) <= 0.2 * (v.max() - v.min()) * 1.5
    bounds = points.selectExpr("dataset", "vid", "v AS lo", "v AS hi")
    rows = approximation.mandatory_extrema(bounds, edges).collect()
    near = {}
    for r in edges.collect():
        near.setdefault(r.vid, []).append(r.nvid)
    # Without a gap between the bounds, every strict minimum of the plateaus is forced.
    assert {r.ComponentId for r in rows if r.kind == 0} >= {x for x in near if all(v[x] < v[y] for y in near[x])}


def test_fibers(spark):
    points = spark.createDataFrame([(i, float(i & 1), float(i >> 1 & 1), float(i >> 2), 0.0) for i in range(8)], "vid long, x double, y double, z double, v double")
    grid = points.selectExpr("vid", "CAST(x AS int) AS i", "CAST(y AS int) AS j", "CAST(z AS int) AS k")
    cells = triangulation.grid_tetrahedra(grid, 2, 2, 2)
    assert cells.count() == 6
    lines = morse.fiber(points, cells, "x", "y", (0.3, 0.6)).collect()
    assert all(abs(r.x0 - 0.3) < 1e-9 and abs(r.y1 - 0.6) < 1e-9 for r in lines) and sum(abs(r.z1 - r.z0) for r in lines) == pytest.approx(1)
    tri = morse.fiber_surface(points, cells, "x", "y", [(0.25, -0.5), (0.25, 0.5)]).toPandas()
    corners = tri.sort_values(["cid", "edge"])[["x", "y", "z"]].to_numpy().reshape(-1, 3, 3)
    area = np.linalg.norm(np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0]), axis=1).sum() / 2
    assert area == pytest.approx(0.5) and (abs(tri["x"] - 0.25) < 1e-9).all()
    plot = morse.continuous_scatter_plot(points, cells, "x", "y", (2, 2), 8).toPandas()
    assert plot["Density"].sum() * 0.25 == pytest.approx(1)


def test_embeddings(spark):
    r = np.random.default_rng(8)
    x = r.random((30, 4))
    df = spark.createDataFrame([(i, *map(float, p), list(map(float, p))) for i, p in enumerate(x)], "k long, a double, b double, c double, d double, v array<double>")
    got = embedding.pca(df, "k", ["a", "b", "c", "d"]).toPandas().sort_values("k").to_numpy()[:, 1:]
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]))
    d = embedding.distances(x)
    at = embedding.topomap(d)
    assert np.allclose([e[0] for e in embedding.spanning_tree(embedding.distances(at))], [e[0] for e in embedding.spanning_tree(d)])
    flat = r.random((25, 2))
    assert np.allclose(embedding.distances(embedding.scaling(embedding.distances(flat), 2)), embedding.distances(flat))
    for method in embedding.METHODS:
        rows = embedding.reduce_dimension(df, "k", "v", method, neighbours=6).collect()
        assert len(rows) == 30 and all(np.isfinite(q.Component_0) for q in rows)


def test_harmonic_and_eigen(spark):
    points = spark.createDataFrame([(0, i, 0.0) for i in range(6)], "dataset long, vid long, v double")
    edges = spark.createDataFrame([(0, i, j) for i in range(6) for j in (i - 1, i + 1)], "dataset long, vid long, nvid long")
    held = spark.createDataFrame([(0, 0, 0.0), (0, 5, 1.0)], "dataset long, vid long, v double")
    assert np.allclose([r.v for r in embedding.harmonic_field(points, edges, held).orderBy("vid").collect()], np.arange(6) / 5, atol=1e-4)
    first = embedding.eigen_fields(points, edges, 2).orderBy("vid").collect()
    assert np.allclose([r.EigenFunctions[0] for r in first], 1 / np.sqrt(6))


def test_rips_diagram(spark):
    angles = np.arange(8) * np.pi / 4
    p = np.column_stack([np.cos(angles), np.sin(angles)])
    rows = [(i, j, float(np.linalg.norm(p[i] - p[j]))) for i in range(8) for j in range(i + 1, 8)]
    found = metrics.rips_diagram(spark.createDataFrame(rows, "i long, j long, d double"), 3.0).collect()
    assert sum(r.PairType == 0 for r in found) == 8
    loop = [r for r in found if r.PairType == 1 and r.Death - r.Birth > 0.3]
    assert len(loop) == 1 and loop[0].Birth == pytest.approx(2 * np.sin(np.pi / 8))


def test_walks(spark, plane):
    with pytest.raises(ValueError, match="circle"):
        mesh.jump(spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "vid long, next long"))
    square = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 0)], "a long, b long")
    at = spark.createDataFrame([(i, float(i), 0.0) for i in range(4)], "vid long, u double, v double")
    assert [r.vid for r in geometry.range_polygon(square, at, 0).orderBy("n").collect()] == [0, 1, 2, 3]
    points, cells, _ = plane
    pinched = cells.where("cid IN (0, 1, 24, 25)")
    assert {r.face[0]: r.LinkComponentNumber for r in triangulation.link_components(pinched, 1).collect()}[NX + 1] >= 1


def test_products_of_one_name(spark, tmp_path):
    base = tmp_path / "a.cdb"
    for n in ("x", "y"):
        spark.createDataFrame([(n,)], "own string").write.parquet(str(base / n / "same.parquet"))
    (base / "data.csv").write_text("k,FILE\nx,x/same.parquet\ny,y/same.parquet\n")
    rows = cinema.read_products(cinema.read_catalog(spark, str(base))).collect()
    assert sorted((r.k, r.own) for r in rows) == [("x", "x"), ("y", "y")]


def test_streams(spark, tmp_path):
    rows = [("2024-01-01 00:00:10", "a", 1), ("2024-01-01 00:00:20", "a", 1), ("2024-01-01 00:00:30", "a", 2), ("2024-01-01 01:00:00", "b", 1)]
    spark.createDataFrame(rows, "t string, l string, p long").selectExpr("CAST(t AS timestamp) AS t", "l", "p").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, l string, p long").parquet(str(tmp_path / "in"))
    query = tracking.overlap_nodes(stream, "t", "10 minutes", "l", "p").writeStream.format("memory").queryName("nodes").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.Label, r.Size) for r in spark.table("nodes").collect()} == {("a", 2), ("b", 1)}
    sent = []
    tracking.serve(stream, "point", lambda df, n: sent.extend(r.value for r in df.collect()), str(tmp_path / "c")).awaitTermination(120)
    back = tracking.from_messages(spark.createDataFrame([(v,) for v in [*sent, "no json"]], "value string"), "point", "l string, p long")
    assert sorted((r.l, r.p) for r in back.collect()) == sorted((label, p) for _, label, p in rows)


def test_depth_image_keeps_what_is_behind_the_camera(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 5.0), (1, 4.0, 0.0, 5.0), (2, 0.0, 4.0, 5.0), (3, 4.0, 4.0, -30.0)], "vid long, x double, y double, z double")
    cells = spark.createDataFrame([(0, [0, 1, 2]), (1, [1, 2, 3])], "cid long, verts array<long>")
    camera = {"position": (2.0, 2.0, 3.0), "direction": (0.0, 0.0, -1.0), "up": (0.0, 1.0, 0.0), "height": 4.0, "near": 0.0, "far": 4.0, "resolution": (4, 4)}
    seen = {(r.i, r.j): r for r in geometry.depth_image(points, cells, **camera).collect()}
    assert len(seen) == 16 and seen[0, 0].Depth == pytest.approx(-0.5) and seen[3, 3].Depth == pytest.approx((3 - (5 - 35 * 0.75)) / 4)
    clipped = {(r.i, r.j) for r in geometry.depth_image(points, cells, **camera, clip=True).collect()}
    assert clipped == {p for p, r in seen.items() if 0 <= r.Depth <= 1}


def test_scaling_without_a_matrix():
    r = np.random.default_rng(9)
    x = r.random((150, 6))
    x[140:] = x[:10]
    assert np.allclose(embedding.distances(embedding.euclidean_scaling(x, 2)), embedding.distances(embedding.scaling(embedding.distances(x), 2)))
    assert np.allclose(embedding.euclidean_scaling(x[:2], 3)[:, 1:], 0)
    wide = embedding.euclidean_scaling(r.random((20000, 3)), 2)  # a matrix of these takes 3.2 GB, their differences 9.6
    assert wide.shape == (20000, 2) and wide[:, 0].std() >= wide[:, 1].std() > 0


def test_topomap_without_a_matrix(monkeypatch):
    r = np.random.default_rng(9)
    x = r.random((150, 6))
    x[140:] = x[:10]
    d = embedding.distances(x)
    monkeypatch.setattr(embedding, "distances", None)
    rows = embedding.Distances(x)
    assert embedding.spanning_tree(rows) == embedding.spanning_tree(d)
    a = embedding.topomap(rows)
    assert np.allclose(a, embedding.topomap(d))
    gaps = np.sqrt(((a[:, None] - a[None]) ** 2).sum(axis=2))
    assert np.allclose([e[0] for e in embedding.spanning_tree(gaps)], [e[0] for e in embedding.spanning_tree(d)])


def test_interpolation_meets_few_triangles(spark):
    points = spark.createDataFrame([(i, float(i % 9), float(i // 9), float(i)) for i in range(81)], "vid long, x double, y double, v double")
    corners = [i + 9 * j for j in range(8) for i in range(8)]
    cells = spark.createDataFrame([(2 * n + k, t) for n, a in enumerate(corners) for k, t in enumerate(([a, a + 1, a + 9], [a + 1, a + 9, a + 10]))], "cid long, verts array<long>")
    r = np.random.default_rng(2)
    at = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.vstack([r.random((60, 2)) * 8, r.integers(0, 9, (20, 2)), [[9.5, 1.0]]]))]
    targets = spark.createDataFrame(at, "tid long, x double, y double")
    out = geometry.interpolate(targets, points, cells, ["v"], 8.0)
    assert "_lox" in out._jdf.queryExecution().toString()  # boxes rule triangles out before weights are taken
    got = {q.tid: q.v for q in out.collect()}
    assert got.pop(80) is None and got == pytest.approx({i: x + 9 * y for i, x, y in at[:80]})
    table = targets.selectExpr("tid", "x AS u", "y AS w", "'a' AS name")
    rows = geometry.project_table(points.selectExpr("vid", "x AS u", "y AS w", "v AS x", "x AS y", "y AS z"), cells, table, "u", "w", 8.0).collect()
    assert {q.tid: (q.u, q.name) for q in rows} == {i: (x, "a") for i, x, _ in at} and all(q.y == pytest.approx(q.u) for q in rows if q.tid < 80)

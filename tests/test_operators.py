"""Operators on small grids against NumPy and hand cases."""

from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxloom.operators import components as K
from voxloom.operators import metrics as M
from voxloom.operators import mutex as W
from voxloom.operators import neighbors as N
from voxloom.operators import resample as R
from voxloom.operators import tiling as T
from voxloom.operators import voxels as V

KEYS = ["volume", "z", "y", "x"]


def grid(spark, a, column="label", volume="v"):
    z, y, x = np.indices(a.shape)
    return spark.createDataFrame(pd.DataFrame({"volume": volume, "z": z.ravel(), "y": y.ravel(), "x": x.ravel(), column: a.ravel()}).astype({"z": "int32", "y": "int32", "x": "int32"}))


def dense(df, column, shape):
    out = np.zeros(shape)
    for r in df.select("z", "y", "x", column).collect():
        out[r["z"], r["y"], r["x"]] = r[column]
    return out


def flood(a):
    """Components by flood fill, numbered in raster order."""
    out, k = np.zeros(a.shape, int), 0
    for start in zip(*np.nonzero(a), strict=True):
        if out[start]:
            continue
        k += 1
        todo = [start]
        out[start] = k
        while todo:
            p = todo.pop()
            for axis in range(3):
                for d in (-1, 1):
                    q = list(p)
                    q[axis] += d
                    q = tuple(q)
                    if all(0 <= i < n for i, n in zip(q, a.shape, strict=True)) and a[q] == a[p] and not out[q]:
                        out[q] = k
                        todo.append(q)
    return out


def test_components_match_flood_fill(spark):
    a = np.random.default_rng(1).integers(0, 3, (3, 7, 9)).astype(np.int64)
    got = dense(K.connected_components(grid(spark, a)), "component", a.shape)
    assert (got == flood(a)).all()


def test_distances_and_growth_match_brute_force(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 4, (3, 5, 6)).astype(np.int64) * (rng.random((3, 5, 6)) < 0.4)
    s = np.array([5.0, 1.0, 2.0])
    at = np.argwhere(np.ones(a.shape)) * s
    d = ((at[:, None] - at[None]) ** 2).sum(-1)
    zero, own = a.ravel() == 0, a.ravel()
    want = np.sqrt(np.where(zero[None], d, np.inf).min(1)).reshape(a.shape)
    assert np.allclose(dense(K.distance_transform(grid(spark, a), sampling=s.tolist()), "distance", a.shape), want)
    far = np.where(own[None] > 0, d, np.inf)
    near = far.min(1)
    grown = np.where(far == near[:, None], np.where(own > 0, own, 99)[None], 99).min(1)
    grown = np.where(np.sqrt(near) > 2, 0, grown).reshape(a.shape)
    assert (dense(K.grow_labels(grid(spark, a), 2.0, sampling=s.tolist()), "grown", a.shape) == grown).all()


def test_gaussian_equals_a_plain_convolution(spark):
    a = np.random.default_rng(9).random((6, 7, 40))
    kernel = np.exp(-0.5 * np.arange(-4, 5) ** 2)
    want = a
    for axis in range(3):
        padded = np.pad(want, [(4, 4) if k == axis else (0, 0) for k in range(3)], mode="symmetric")
        want = np.apply_along_axis(lambda line: np.convolve(line, kernel / kernel.sum(), "valid"), axis, padded)
    assert np.allclose(dense(K.gaussian_filter(grid(spark, a, "intensity"), 1.0), "intensity", a.shape), want)


@pytest.mark.parametrize("spacing", [1.0, 0.3, 7.5])
def test_lower_envelopes_equal_all_pairs(spacing):
    rng = np.random.default_rng(1)
    f = np.where(rng.random((40, 60)) < 0.5, np.inf, rng.integers(0, 40, (40, 60)) * (spacing**2))
    f[0], f[1] = np.inf, 0.0
    # many parabolas through one point
    f[2] = np.where(np.abs(np.arange(60) - 30) < 6, 36 * spacing**2 - ((30 - np.arange(60)) * spacing) ** 2, np.inf)
    ids = rng.integers(1, 50, f.shape)
    d = f[:, None, :] + ((np.arange(60)[:, None] - np.arange(60)[None, :]) * spacing) ** 2
    best = d.min(axis=2)
    who = np.where(np.isfinite(best), np.where(d == best[:, :, None], ids[:, None, :], 99).min(axis=2), 0)
    got = K.lower_envelope(f, ids, spacing)
    assert (got[0] == best).all() and (got[1] == who).all()


def test_envelopes_are_linear_in_a_lines_length(monkeypatch):
    steps = []

    class Counting:
        def __getattr__(self, name):
            steps.append(name)
            return getattr(np, name)

    monkeypatch.setattr(K, "np", Counting())
    rng = np.random.default_rng(2)
    for n in (200, 800):
        before = len(steps)
        K.lower_envelope(rng.random((1, n)) * n, np.zeros((1, n), np.int64), 1.0)
        steps.append(len(steps) - before)
    counts = [x for x in steps if isinstance(x, int)]
    assert counts[1] < 5 * counts[0]


def test_components_do_not_depend_on_bricks(spark):
    a = np.random.default_rng(5).integers(0, 3, (5, 9, 11)).astype(np.int64)
    for size in ((2, 3, 4), (5, 9, 11)):
        got = K.connected_components(grid(spark, a).withColumn("name", F.lit("n")), size=size)
        assert got.columns == [*KEYS, "label", "name", "component"]
        assert (dense(got, "component", a.shape) == flood(a)).all()


def test_components_of_a_hub_and_a_chain(spark, monkeypatch):
    from voxloom.operators import graph

    monkeypatch.setattr(graph, "HUB_ROWS", 5)
    edges = [(i, i + 1) for i in range(100, 130)] + [(7, k) for k in range(200, 240)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 131)}, 7: 7, **{k: 7 for k in range(200, 240)}}


def test_a_volume_of_one_weight_is_ranked_in_many_tasks(spark):
    from voxloom.operators import graph

    edges = spark.range(4000).selectExpr("'v' AS volume", "id AS u", "id + 1 AS v", "0 AS idx", "0.5D AS weight", "true AS mutex")
    dealt = graph.dealt_by_ranges(edges, ["volume"], [F.desc("weight"), F.asc("idx"), F.asc("u"), F.asc("v")])
    sizes = [r["count"] for r in dealt.groupBy(F.shiftright("_at", 33)).count().collect()]
    assert len(sizes) > 2 and max(sizes) < 2000
    assert W.ranked(edges).where("rank <> u + 1").count() == 0


def test_blends_on_bricks_equal_a_plain_sum(spark):
    from voxloom.sources import bricks as B

    a = np.random.default_rng(6).random((5, 9, 13))
    b = B.to_bricks(grid(spark, a, "value"), (2, 4, 4), ("value",))
    # a model whose result depends on the tile: the tiles' largest value is added
    model = lambda t: t + t.max(axis=(1, 2, 3), keepdims=True)
    for how in ("gaussian", "mean", "max"):
        total, weight = np.full(a.shape, -np.inf if how == "max" else 0.0), np.zeros(a.shape)
        w = T.tile_weights((4, 6, 6)) if how == "gaussian" else np.ones((4, 6, 6))
        for z, y, x in product((0, 1), (0, 3), (0, 3, 6, 7)):
            at = np.s_[z : z + 4, y : y + 6, x : x + 6]
            p = a[at] + a[at].max()
            total[at] = np.maximum(total[at], p) if how == "max" else total[at] + p * w
            weight[at] += w
        got = T.predict_blended(b, "value", model, (4, 6, 6), (2, 3, 3), how, size=(2, 4, 4))
        assert np.allclose(dense(B.to_voxels(got, ("pred",)), "pred", a.shape), total if how == "max" else total / (weight + 1e-8))
    tiles = {(r["z0"], r["y0"], r["x0"]): np.array(r["pred"]).reshape(r["nz"], r["ny"], r["nx"]) for r in T.predict_tiles(b, "value", model, (4, 6, 6), (2, 3, 3), size=(2, 4, 4)).collect()}
    assert len(tiles) == 2 * 2 * 4
    for (z, y, x), p in tiles.items():
        part = a[z : z + 4, y : y + 6, x : x + 6]
        assert np.allclose(p, part + part.max())


def test_voxels_without_a_tile_are_null(spark):
    from voxloom.sources import bricks as B

    b = B.to_bricks(grid(spark, np.ones((1, 1, 10)), "value"), (1, 1, 4), ("value",))
    got = B.to_voxels(T.predict_blended(b, "value", lambda t: t, (1, 1, 4), (1, 1, 4), "mean", "strict", size=(1, 1, 4), eps=0.0), ("pred",))
    assert [r["pred"] for r in got.orderBy("x").collect()] == [1.0] * 8 + [None] * 2




def test_hand_case_of_the_mutex_watershed():
    pulls = [(1, 2, 0.95), (5, 6, 0.93), (4, 5, 0.92), (2, 3, 0.90), (3, 4, 0.08)]
    pushes = [(2, 4, 0.88), (3, 5, 0.85), (1, 3, 0.12), (4, 6, 0.10)]
    e = pd.DataFrame([(u, v, 0, w, False) for u, v, w in pulls] + [(u, v, 3, w, True) for u, v, w in pushes], columns=["u", "v", "idx", "weight", "mutex"])
    out = W.solve_block(e)
    assert dict(zip(out["node"], out["root"], strict=True)) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}


def test_rounds_equal_the_exact_pass_on_the_hand_case(spark):
    rows = [("v", 1, 2, 0, 0.95, False), ("v", 5, 6, 0, 0.93, False), ("v", 4, 5, 0, 0.92, False), ("v", 2, 3, 0, 0.90, False), ("v", 2, 4, 3, 0.88, True), ("v", 3, 4, 0, 0.08, False)]
    e = spark.createDataFrame(rows, "volume string, u bigint, v bigint, idx int, weight double, mutex boolean")
    got = {r["node"]: r["root"] for r in W.boruvka(e, len(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}


def falling_order(rows, buckets):
    """Root of every node by a plain pass: per bucket all mutexes, then pulls in falling weight."""
    root = {n: n for r in rows for n in r[1:3]}
    apart = set()
    rows = sorted(rows, key=lambda r: -r[4])
    for part in np.array_split(np.arange(len(rows)), buckets):
        some = [rows[i] for i in part]
        for _, u, v, _, _, mutex in some:
            if mutex and root[u] != root[v]:
                apart.add((u, v))
        for _, u, v, _, _, mutex in some:
            a, b = sorted((root[u], root[v]))
            if not mutex and a != b and all({root[x], root[y]} != {a, b} for x, y in apart):
                root = {n: a if r == b else r for n, r in root.items()}
    return root


@pytest.mark.parametrize(("span", "most"), [(1 << 15, 1_000_000), (8, 1_000_000), (8, 0)])
def test_parallel_watershed_does_not_depend_on_blocks(spark, span, most):
    r = np.random.default_rng(7)
    rows = []
    for a in range(24):
        for step, mutex in ((1, False), (6, False), (3, True), (10, True)):
            if a + step < 24 and not (mutex and r.random() < 0.5):
                rows.append(("v", a + step, a, len(rows), 0.0, mutex))
    weights = r.permutation(len(rows)) / len(rows)
    rows = [(*x[:4], float(w), x[5]) for x, w in zip(rows, weights, strict=True)]
    e = spark.createDataFrame(rows, "volume string, u bigint, v bigint, idx int, weight double, mutex boolean")
    got = {x["node"]: x["root"] for x in W.boruvka(e, 2, span, most).collect()}
    want = falling_order(rows, 2)
    assert got == want and 2 < len(set(want.values())) < 24


def lattice_graph(rng, shape, levels):
    """Pull and push edges of a small volume; with few levels weights tie."""
    rows, n = [], int(np.prod(shape))
    at = np.arange(n).reshape(shape)
    steps = [((1, 0, 0), False), ((0, 1, 0), False), ((0, 0, 1), False), ((0, 2, 0), True), ((0, 0, 3), True), ((1, 1, 0), True), ((2, 0, 0), True)]
    for k, (o, mutex) in enumerate(steps):
        here = at[tuple(slice(0, s - d) for s, d in zip(shape, o, strict=True))].ravel()
        there = at[tuple(slice(d, s) for s, d in zip(shape, o, strict=True))].ravel()
        for u, v in zip(here.tolist(), there.tolist(), strict=True):
            if not mutex or rng.random() < 0.4:
                rows.append(("v", u, v, k, float(rng.integers(levels)) / levels * (0.8 if mutex else 1.0), mutex))
    return rows


@pytest.mark.parametrize(("size", "most", "levels"), [((2, 3, 4), 10**6, 1000), ((1, 3, 3), 10**6, 8), ((3, 5, 8), 10**6, 8), ((2, 3, 4), 0, 50)])
def test_exact_watershed_in_blocks_equals_one_pass(spark, size, most, levels):
    shape = (3, 5, 8) if most else (2, 2, 3)
    rows = lattice_graph(np.random.default_rng(levels + size[1]), shape, levels)
    names = ["volume", "u", "v", "idx", "weight", "mutex"]
    one = W.solve_block(pd.DataFrame(rows, columns=names))
    want = dict(zip(one["node"].tolist(), one["root"].tolist(), strict=True))
    other = [("w", *r[1:4], 1 - r[4], r[5]) for r in rows]  # a second volume, other weights
    two = W.solve_block(pd.DataFrame(other, columns=names))
    e = spark.createDataFrame(rows + other, "volume string, u bigint, v bigint, idx int, weight double, mutex boolean")
    ext = spark.createDataFrame([(v, *shape) for v in "vw"], "volume string, dz int, dy int, dx int")
    got = W.exact(e, ext, size, most).collect()
    assert {r["node"]: r["root"] for r in got if r["volume"] == "v"} == want
    assert {r["node"]: r["root"] for r in got if r["volume"] == "w"} == dict(zip(two["node"].tolist(), two["root"].tolist(), strict=True))
    assert 1 < len(set(want.values())) < len(want)
    if most:
        named = W.stitch_blocks(e, ext, size, most).where("volume = 'v'").collect()
        assert {r["node"]: r["instance"] for r in named} == want
        assert len({r["region"] for r in named}) >= len(set(want.values()))


def test_registered_watersheds_equal_one_pass_over_the_volume(spark):
    from voxloom.plans import graph_queries as G

    sf = "/root/testdata/sf0.001"
    one = W.solve_block(G.rounded_edges(spark, sf).toPandas())
    want = dict(zip(one["node"].tolist(), one["root"].tolist(), strict=True))
    assert {r["node"]: r["root"] for r in G.QUERIES["mws_exact"](spark, sf).collect()} == want
    blocks = W.exact(G.rounded_edges(spark, sf), V.extents(G.X.voxels(spark, sf)), size=(4, 16, 32))
    assert {r["node"]: r["root"] for r in blocks.collect()} == want
    size = pd.Series(want).value_counts()
    stitched = G.QUERIES["mws_block_stitch"](spark, sf).collect()
    assert {r["first_voxel"]: r["n_voxels"] for r in stitched} == size.to_dict()
    assert any(r["n_regions"] > 1 for r in stitched)


def cells(spark, true, pred):
    return M.contingency(spark.createDataFrame([("v", t, p) for t, p in zip(true, pred, strict=True)], "volume string, true_id int, pred_id int"))


def test_metrics_of_equal_and_split_labels(spark):
    same = cells(spark, [1, 1, 2, 2, 0], [5, 5, 7, 7, 0])
    assert M.ari(same).first()["ari"] == pytest.approx(1)
    assert M.ami(same).first()["ami"] == pytest.approx(1)
    v = M.voi(same).first()
    assert v["voi_split"] == v["voi_merge"] == 0 and M.ted(same).first()["ted"] == 0
    split = cells(spark, [1, 1, 1, 1], [1, 1, 2, 2])
    v = M.voi(split).first()
    assert v["voi_split"] == pytest.approx(1) and v["voi_merge"] == 0 and M.ted(split).first()["ted"] == 1
    merged = cells(spark, [1, 1, 2, 2], [1, 1, 1, 1])
    v = M.voi(merged).first()
    assert v["voi_merge"] == pytest.approx(1) and v["voi_split"] == 0


def test_background_in_both_weighs_nothing(spark):
    assert sorted(tuple(r) for r in cells(spark, [1, 1, 0, 2], [1, 2, 0, 1]).select("true_id", "pred_id", "n").collect()) == [(0, 0, 0), (1, 1, 1), (1, 2, 1), (2, 1, 1)]


def test_tiles_cover_and_shift_back(spark):
    cat = spark.createDataFrame([("v", 10, 3, 5)], "volume string, dz int, dy int, dx int")
    full = T.patch_grid(cat, (4, 4, 4), (4, 4, 4)).orderBy("patch_idx").collect()
    assert [r["z0"] for r in full if r["x0"] == 0] == [0, 4, 6] and {r["ny"] for r in full} == {3}
    strict = T.patch_grid(cat, (4, 4, 4), (4, 4, 4), coverage="strict").collect()
    assert sorted({r["z0"] for r in strict}) == [0, 4]


def test_blending_keeps_a_constant(spark):
    a = np.full((5, 6, 7), 0.25)
    v = grid(spark, a, "pred")
    tiles = T.patch_grid(V.extents(v), (4, 4, 4), (2, 2, 2))
    rows = T.gaussian_weight(T.assign(v, tiles), (4, 4, 4))
    # at the corners of a volume weights are below the eps of the weighted mean
    assert np.allclose(dense(T.blend(rows, "mean"), "pred", a.shape), 0.25)
    assert np.allclose(dense(T.blend(rows, eps=1e-30), "pred", a.shape), 0.25)


def test_erosion_restores_a_thin_object(spark):
    a = np.zeros((1, 5, 6), np.int64)
    a[0, 2, :] = 7
    assert (dense(N.boundary_erode(grid(spark, a)), "eroded", a.shape) == a).all()


def test_an_offset_beyond_the_axis_raises(spark):
    with pytest.raises(Exception, match="whole axis"):
        N.shifted(grid(spark, np.ones((2, 3, 3), np.int64)), ["label"], [(-2, 0, 0)]).collect()


def test_pooling_keeps_the_mean(spark):
    a = np.random.default_rng(3).random((4, 6, 8))
    p = R.resample(grid(spark, a, "intensity"), {"z": F.lit(2), "y": F.lit(3), "x": F.lit(4)}, "intensity", "pool")
    want = a.reshape(2, 2, 3, 2, 4, 2).mean((1, 3, 5))
    assert np.allclose(dense(p, "intensity", want.shape), want)


def test_degradation_always_gives_the_clean_value(spark):
    a = np.random.default_rng(4).random((8, 4, 4))
    out = R.degrade_pair(grid(spark, a, "intensity"), 4.0, 1)
    assert out.count() == a.size and np.allclose(dense(out, "clean", a.shape), a)


def test_replicated_section_takes_the_lower_neighbour(spark):
    s = spark.createDataFrame([("v", z, z == 2) for z in range(5)], "volume string, z int, dropped boolean")
    assert {r["z"]: r["source_z"] for r in V.nearest_surviving(s).collect()}[2] == 1


def test_rounds_take_the_edges_of_all_voxels(spark, monkeypatch):
    from voxloom.plans import graph_queries as G

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(W, "boruvka", lambda edges, buckets: edges)
    got, want = G.QUERIES["mws_boruvka"](spark, sf), G.rounded_edges(spark, sf)
    voxelwise = N.affinity_target(G.X.voxels(spark, sf))
    d = F.expr("((z * 11 + y * 7 + x * 3 + idx * 5) % 10) / 100.0D")
    affinities = voxelwise.select(*KEYS, "idx", F.when(F.col("target") == 1, 0.9 - d).otherwise(0.1 + d).alias("aff"))
    rows = W.build_edges(affinities, strides=G.STRIDES).withColumn("weight", F.round("weight", 6))
    assert rows.exceptAll(want.select(rows.columns)).count() == 0 and rows.count() == want.count()
    keys = ["volume", "u", "v", "idx", "weight", "mutex"]
    assert got.select(keys).exceptAll(want.select(keys)).count() == want.select(keys).exceptAll(got.select(keys)).count() == 0


def test_metrics_of_a_volume_of_background_alone(spark):
    rows = [("empty", 0, 0)] * 5 + [("nulls", None, 0)] * 2 + [("v", 1, 1), ("v", 1, 2), ("v", 0, 0)]
    cells = M.contingency(spark.createDataFrame(rows, "volume string, true_id int, pred_id int"))
    for volume in ("empty", "nulls"):
        assert M.ari(cells).where(f"volume = '{volume}'").first()["ari"] == 0
        assert M.ami(cells).where(f"volume = '{volume}'").first()["ami"] == 0
        v = M.voi(cells).where(f"volume = '{volume}'").first()
        assert (v["voi_split"], v["voi_merge"], v["voi_total"]) == (0, 0, 0)
        assert M.ted(cells).where(f"volume = '{volume}'").first()["ted"] == 0
    assert M.voi(cells).where("volume = 'v'").first()["voi_split"] == 1 and M.ted(cells).where("volume = 'v'").first()["ted"] == 1
    whole = M.contingency(spark.createDataFrame(rows, "volume string, true_id int, pred_id int"), ignore_background=False)
    assert M.ari(whole).where("volume = 'empty'").first()["ari"] == 1
    assert whole.where("volume = 'empty'").first()["n"] == 5


def test_expected_information_of_large_segments():
    few = M._expected_terms(np.array([50]), np.array([70]), np.array([1]), np.array([200]))[0]
    m = np.arange(1, 51, dtype=float)
    from math import exp, lgamma

    p = np.array([np.exp(lgamma(51) + lgamma(71) + lgamma(151) + lgamma(131) - lgamma(201) - lgamma(k + 1) - lgamma(51 - k) - lgamma(71 - k) - lgamma(200 - 120 + k + 1)) for k in m])
    assert few == pytest.approx(float((m / 200 * np.log(200 * m / 3500) * p).sum()), rel=1e-9)
    large = M._expected_terms(np.array([10**9]), np.array([2 * 10**9]), np.array([1]), np.array([10**10]))[0]
    assert 0 < large < 1e-8
    # many pairs at once equal one at a time, by sums over all sizes
    rng = np.random.default_rng(3)
    x, y, t = rng.integers(1, 60, 300), rng.integers(1, 60, 300), np.full(300, 60)

    def plain(x, y, t):
        p = np.array([exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(t - x + 1) + lgamma(t - y + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(t - x - y + k + 1)) for k in range(max(1, x + y - t), min(x, y) + 1)])
        k = np.arange(max(1, x + y - t), min(x, y) + 1)
        return float((k / t * np.log(t * k / (x * y)) * p).sum())

    assert np.allclose(M._expected_terms(x, y, np.full(300, 2.0), t), [2 * plain(*map(int, v)) for v in zip(x, y, t, strict=True)], rtol=1e-9, atol=1e-13)


def test_adjusted_information_does_not_depend_on_blocks_of_sizes(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [("v", int(a), int(a) // 3 + int(rng.integers(3))) for a in rng.integers(1, 40, 3000) ** 2 // 40]
    c = M.contingency(spark.createDataFrame(rows, "volume string, true_id int, pred_id int"))
    whole = M.ami(c).first()["ami"]
    monkeypatch.setattr(M, "GRID", 3)
    assert M.ami(c).first()["ami"] == pytest.approx(whole, rel=1e-12) and 0 < whole < 1


def test_ranks_and_buckets_of_edges(spark):
    rng = np.random.default_rng(5)
    rows = [(f"v{i % 2}", int(i), int(i + 1), int(rng.integers(3)), float(rng.integers(12)) / 10, bool(i % 3)) for i in range(500)]
    edges = spark.createDataFrame(rows, "volume string, u bigint, v bigint, idx int, weight double, mutex boolean")
    got = {(r["volume"], r["u"]): r["rank"] for r in W.ranked(edges).collect()}
    bucket = {(r["volume"], r["u"]): r["bucket"] for r in W.priority_buckets(edges, 7).collect()}
    for volume in ("v0", "v1"):
        order = sorted((r for r in rows if r[0] == volume), key=lambda r: (-r[4], r[3], r[1], r[2]))
        assert [got[volume, r[1]] for r in order] == list(range(1, len(order) + 1))
        want = np.concatenate([np.full(len(x), k + 1) for k, x in enumerate(np.array_split(np.arange(len(order)), 7))])
        assert [bucket[volume, r[1]] for r in order] == want.tolist()


def test_halos_that_reach_over_several_bricks(spark):
    from voxloom.operators import neighbors as N
    from voxloom.sources import bricks as B

    rng = np.random.default_rng(2)
    rows = [("v", z, y, x, int(rng.integers(3))) for z in range(4) for y in range(12) for x in range(20)]
    voxels = spark.createDataFrame(rows, "volume string, z int, y int, x int, label bigint")
    small = B.to_bricks(voxels.withColumn("intensity", F.lit(0.0)).withColumn("pred", F.lit(0).cast("bigint")), size=(2, 4, 4))
    offsets = [(-1, 0, 0), (0, -9, 0), (3, 0, 11), (0, 5, -17)]
    got = {tuple(r[c] for c in ("z", "y", "x", "idx")): r["target"] for r in B.affinity_bricks(small, offsets, size=(2, 4, 4)).collect()}
    label = {(z, y, x): k for _, z, y, x, k in rows}
    clip = lambda v, n: max(0, min(n - 1, v))
    assert got == {(z, y, x, i): int(label[clip(z + a, 4), clip(y + b, 12), clip(x + c, 20)] == label[z, y, x]) for z, y, x in label for i, (a, b, c) in enumerate(offsets)}
    assert N.OFFSETS


@pytest.mark.parametrize("connectivity", [1, 2, 3])
def test_components_join_over_edges_and_corners(spark, connectivity):
    a = (np.random.default_rng(3).random((4, 5, 6)) < 0.4).astype(np.int64) * 5
    want, n = np.zeros(a.shape, int), 0
    for start in np.argwhere(a).tolist():
        if want[tuple(start)]:
            continue
        n, todo = n + 1, [tuple(start)]
        while todo:
            at = todo.pop()
            if want[at]:
                continue
            want[at] = n
            near = np.argwhere(a) - at
            todo += [tuple(np.array(at) + d) for d in near if np.abs(d).max() == 1 and np.abs(d).sum() <= connectivity]
    got = K.connected_components(grid(spark, a), connectivity=connectivity)
    assert (dense(got, "component", a.shape) == want).all()


def test_blocks_are_joined_by_their_best_matches(spark):
    o = spark.createDataFrame([(1, 11, 8), (1, 12, 1), (2, 12, 3), (2, 13, 9), (3, 14, 1), (3, 13, 5)], "a bigint, b bigint, n bigint")
    got = {r["node"]: r["root"] for r in W.stitch(o).collect()}
    assert got == {1: 1, 11: 1, 2: 2, 13: 2}


def test_a_batch_that_is_run_again_adds_nothing(spark, tmp_path):
    from voxloom.streaming import metrics as S

    put = S.batch_sink(str(tmp_path / "t"), "append")
    for number, ids in ((0, [1, 2]), (1, [3]), (1, [3])):
        put(spark.createDataFrame([(i,) for i in ids], "id int"), number)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 2, 3]


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    import os

    from voxloom.streaming import metrics as S

    folder = tmp_path / "rows"
    folder.mkdir()
    # Spark tells late rows by the watermark of the batch before: one batch lies between
    for k, at in enumerate(["00:10", "05:00", "05:05", "00:20"]):
        rows = pd.DataFrame({"ts": [pd.Timestamp(f"2024-01-01 {at}", tz="UTC")], "stage": ["s"], "value": [float(k)]})
        rows.to_parquet(folder / f"{k}.parquet", coerce_timestamps="us")
        os.utime(folder / f"{k}.parquet", (1_000_000 + 60 * k,) * 2)
    stream = spark.readStream.schema("ts timestamp, stage string, value double").option("maxFilesPerTrigger", 1).parquet(str(folder))
    S.to_table(S.metric_windows(stream, "1 hour", "10 minutes"), str(tmp_path / "t"), str(tmp_path / "c"), "append")
    got = [(str(r["start"])[11:], r["mean"], r["n"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()]
    assert got == [("00:00:00", 0.0, 1)]


def test_agglomeration_equals_its_parts(spark):
    from voxloom.operators import affinities as A
    from voxloom.sources import bricks as B

    rng = np.random.default_rng(11)
    label = np.repeat(np.repeat(rng.integers(1, 6, (3, 3, 4)), 2, axis=1), 3, axis=2).astype(np.int64)
    fg = rng.random(label.shape) < 0.55
    fg[0, 0, :3] = [True, False, False]
    v = grid(spark, label).join(grid(spark, fg, "fg"), KEYS)
    offsets = [(-1, 0, 0), (0, -1, 0), (0, 0, -1), (0, -3, 0), (0, 0, -4)]
    weight = rng.random((5, *label.shape))
    shared = {k: weight[k] for k in range(5)}

    def affinity(h, k, same):
        at = tuple(slice(s, s + d) for s, d in zip(h.start, h.size, strict=True))
        return np.where(same, 0.5 + shared[k][at] / 2, shared[k][at] / 2)

    e = A.edges(B.to_bricks(v, (2, 4, 4), ("label", "fg")), affinity, offsets, 3, (1, 1, 1), mask="fg", size=(2, 4, 4))
    pairs = e.toPandas()
    at = np.arange(label.size).reshape(label.shape)
    assert fg.ravel()[pairs["u"]].all() and fg.ravel()[pairs["v"]].all()
    want_pairs = sum(int((fg[max(0, -o[0]) :, max(0, -o[1]) :, max(0, -o[2]) :] & fg[: label.shape[0] + o[0], : label.shape[1] + o[1], : label.shape[2] + o[2]]).sum()) for o in offsets)
    assert len(pairs) == want_pairs
    # the parts, one after the other
    top = pd.concat([pairs[~pairs["mutex"]], pairs[pairs["mutex"]].sort_values(["weight", "idx", "u", "v"], ascending=[False, True, True, True]).head(30)])
    solved = W.solve_block(top)
    root = np.where(fg.ravel(), at.ravel(), -1)
    root[solved["node"]] = solved["root"]
    ids, size = np.unique(root[root >= 0], return_counts=True)
    number = {int(i): k + 1 for k, i in enumerate(ids[size >= 3])}
    plain = np.array([number.get(int(r), 0) for r in root]).reshape(label.shape)
    got = W.agglomerate(e, v, "fg", least=3, max_push=30, size=(2, 4, 4))
    assert (dense(got, "instance", label.shape) == plain).all() and 2 < len(number) < len(ids)
    where = np.argwhere(plain > -1) * np.array([5.0, 1.0, 1.0])
    d = ((where[:, None] - where[None]) ** 2).sum(-1)
    far = np.where(plain.ravel()[None] > 0, d, np.inf)
    near = far.min(1)
    grown = np.where(far == near[:, None], np.where(plain.ravel() > 0, plain.ravel(), 999)[None], 999).min(1)
    grown = np.where(np.sqrt(near) > 2, 0, grown).reshape(label.shape)
    got = W.agglomerate(e, v, "fg", least=3, max_push=30, grow=2.0, sampling=(5.0, 1.0, 1.0), size=(2, 4, 4))
    assert (dense(got, "instance", label.shape) == grown).all()


def test_plans_of_zoom(spark):
    s = spark.createDataFrame([(f"v{k}", k, 40.0 if k % 2 else 8.0, 8.0, 8.0) for k in range(200)], "volume string, sample int, res_z double, res_y double, res_x double")
    rows = R.zoom_plan(s, (30, 4, 5), (50, 10, 9), 1, "ratio").collect()
    for r in rows:
        assert r["zoomed"] and 4 <= r["target_y"] <= 10
        assert r["target_x"] == min(9, max(5, r["target_y"])) and r["target_z"] == pytest.approx(min(50, max(30, r["target_y"] * r["res_z"] / 8)))
        assert r["zoom_z"] == pytest.approx(r["res_z"] / r["target_z"])
    assert len({r["target_y"] for r in rows}) == 200
    union = R.zoom_plan(s, (30, 4, 4), (50, 10, 10), 1, "union").collect()
    assert {r["zoomed"] for r in union if r["res_z"] == 8.0} == {False} and all(r["target_z"] == 8.0 == r["target_x"] for r in union if r["res_z"] == 8.0)
    assert all(r["zoomed"] and r["target_y"] == r["target_x"] and 30 <= r["target_z"] <= 50 for r in union if r["res_z"] == 40.0)
    some = R.zoom_plan(s, (30, 4, 4), (50, 10, 10), 1, "ratio", 0.5).where("zoomed").count()
    assert 60 < some < 140
    with pytest.raises(ValueError, match="ratio or union"):
        R.zoom_plan(s, (1, 1, 1), (2, 2, 2), 1, "other")


def test_zoom_by_plan_keeps_the_grid(spark):
    a = np.arange(4 * 6 * 8).reshape(4, 6, 8).astype(np.int64) + 1
    plan = spark.createDataFrame([("v", 0, 1.0, 1.0, 1.0), ("v", 1, 1.0, 0.5, 2.0)], "volume string, sample int, zoom_z double, zoom_y double, zoom_x double")
    out = R.zoom_by_plan(grid(spark, a), plan, "label", "nearest")
    assert (dense(out.where("sample = 0"), "label", a.shape) == a).all()
    small = a[:, ::2, :][:, :, np.arange(16) // 2]
    got = dense(out.where("sample = 1"), "label", a.shape)
    rows = np.flatnonzero(got.any(axis=(0, 2)))
    assert len(rows) == 3 and (got[:, rows] == small[:, :, 4:12]).all()


def test_turned_volumes(spark):
    a = np.arange(2 * 3 * 4).reshape(2, 3, 4).astype(np.int64)
    c = lambda axis, z: spark.createDataFrame([("v", axis, z, 8.0, 8.0)], "volume string, axis string, res_z double, res_y double, res_x double")
    assert (dense(V.orient(grid(spark, a), c("x", 8.0)), "label", (4, 3, 2)) == a.transpose(2, 1, 0)).all()
    assert (dense(V.orient(grid(spark, a), c("y", 8.0)), "label", (3, 2, 4)) == a.transpose(1, 0, 2)).all()
    assert (dense(V.orient(grid(spark, a), c("z", 40.0)), "label", a.shape) == a).all()
    with pytest.raises(Exception, match="anisotropic"):
        V.orient(grid(spark, a), c("y", 40.0)).collect()


def test_domains_of_stems(spark):
    want = {
        "x_volume_segmentation": "x_volume", "x_segmentation_volume": "x", "AC3_inputs": "AC3", "AC4": "AC4", "neurite_1": "neurons", "minnie65_8nm_x1_y2_z3_volume": "minnie65",
        "cremi3d_sample_A": "cremi3d", "cremi3d_sample_A+": "cremi3d_test", "cremi3d_x1_y2_z3": "cremi3d", "flyem3d_malecns_2": "flyem3d_malecns", "flyem3d_8nm_ssl": "flyem3d_fib25_ssl", "flyem3d_8nm": "flyem3d_fib25",
        "jrc_hela-2_4x4x3nm_x1": "jrc_hela-2", "jrc_other": "jrc_other", "mitoem2_rat_test02": "mitoem2_rat", "pyr_x1_y2_z3_more": "pyr", "": "",
    }
    rows = spark.createDataFrame([(k,) for k in want], "stem string")
    assert {r["stem"]: r["s"] for r in rows.select("stem", V.derive_subset(F.col("stem")).alias("s")).collect()} == want


def test_lost_sections(spark):
    a = np.random.default_rng(1).random((6, 2, 2)) + 1
    many = grid(spark, a, "intensity").drop("volume").join(spark.range(60).selectExpr("concat('v', id) AS volume"))
    lost = R.dropped_sections(many, 9, 5).groupBy("volume").agg(F.count_if("dropped").alias("n"), F.count("*").alias("all")).collect()
    assert {r["n"] for r in lost} == {1, 2, 3, 4, 5, 6} and {r["all"] for r in lost} == {6}
    runs = R.dropped_sections(many, 3, 5, contiguous=True).where("dropped").groupBy("volume").agg((F.max("z") - F.min("z") + 1).alias("span"), F.count("*").alias("n")).collect()
    assert len(runs) == 60 and all(r["span"] == r["n"] for r in runs)
    out = R.drop_sections(many, 9, 5)
    assert out.count() == 60 * a.size
    whole = {r["volume"] for r in lost if r["n"] == 6}
    assert {r["intensity"] for r in out.where(F.col("volume").isin(list(whole))).collect()} == {0.0}
    assert out.where(~F.col("volume").isin(list(whole))).where("intensity < 1").count() == 0


def test_jitter_repeats_the_edge(spark):
    a = np.random.default_rng(2).random((5, 7, 9))
    got = dense(R.jitter_sections(grid(spark, a, "intensity"), 4.0, 3), "intensity", a.shape)
    z = spark.range(5).selectExpr("'v' AS volume", "CAST(id AS INT) AS z")
    moves = {r["z"]: (r["y"], r["x"]) for r in z.select("z", *(((R.draw(3, "volume", "z", F.lit(k)) * 2 - 1) * 4.0).alias(c) for c, k in (("y", 1), ("x", 2)))).collect()}

    def at(values, c):
        """Linear between voxels, constant beyond the outer ones after a reflection about the border."""
        n = len(values)
        c = abs(c + 0.5) % (2 * n)
        c = min(max((2 * n - c if c > n else c) - 0.5, 0), n - 1)
        return np.interp(c, np.arange(n), values)

    for k, (my, mx) in moves.items():
        rows = np.array([[at(a[k, :, x], y + my * 7 / 6) for x in range(9)] for y in range(7)])
        want = np.array([[at(rows[y], x + mx * 9 / 8) for x in range(9)] for y in range(7)])
        assert np.allclose(got[k], want)


def test_the_degraded_volume_is_the_chain_of_its_parts(spark):
    a = np.random.default_rng(4).random((8, 4, 4))
    v = grid(spark, a, "intensity")
    got = dense(R.degrade_pair(v, 2.0, 1), "degraded", a.shape)
    low = R.resample(v, {"z": F.lit(4)}, "intensity", "pool", ("z",))
    assert np.allclose(dense(low, "intensity", (4, 4, 4)), a.reshape(4, 2, 4, 4).mean(1))
    low = R.section_gamma(R.section_noise(R.drop_sections(R.jitter_sections(low, 0.5, 1), 1, 1), 0.05, 1), 0.8, 1.25, 1)
    low = dense(low, "intensity", (4, 4, 4))
    at = np.clip((np.arange(8) + 0.5) / 2 - 0.5, 0, 3)
    want = np.stack([[np.interp(at, np.arange(4), low[:, y, x]) for x in range(4)] for y in range(4)])
    assert np.allclose(got, want.transpose(2, 0, 1))


def test_offsets_that_fit_a_volume(spark):
    cat = spark.createDataFrame([("a", 7, 32, 64), ("b", 2, 10, 28)], "volume string, dz int, dy int, dx int")
    t = N.offset_table(cat)
    got = {(r["volume"], r["idx"]): r["n_pairs"] for r in t.collect()}
    want = {(v, k): (z - abs(o[0])) * (y - abs(o[1])) * (x - abs(o[2])) for v, z, y, x in [("a", 7, 32, 64), ("b", 2, 10, 28)] for k, o in enumerate(N.OFFSETS) if abs(o[0]) < z and abs(o[1]) < y and abs(o[2]) < x}
    assert got == want
    few = N.select_offsets(t, 3).groupBy("volume", "kind").count().collect()
    assert {(r["volume"], r["kind"]): r["count"] for r in few} == {("a", "pull"): 3, ("a", "push"): 3, ("b", "pull"): 3, ("b", "push"): 3}


def test_array_kernels_equal_the_voxelwise_operators(spark):
    from voxloom.operators import affinities as A
    from voxloom.operators import scoring as C
    from voxloom.sources import bricks as B

    rng = np.random.default_rng(12)
    a = rng.integers(0, 4, (5, 9, 10)).astype(np.int64)
    v, size, offsets = grid(spark, a), (2, 4, 4), [(-1, 0, 0), (0, 2, -3), (3, 0, 0), (1, -5, 6)]
    b = B.to_bricks(v, size, ("label",))
    plain = N.affinity_target(v, offsets, background=2).persist()
    lines = A.target_lines(b, offsets, background=2, size=size).collect()
    got = {(r["z"], r["y"], r["x0"] + i, r["idx"]): (t, ok) for r in lines for i, (t, ok) in enumerate(zip(r["target"], r["valid"], strict=True))}
    assert got == {(r["z"], r["y"], r["x"], r["idx"]): (r["target"], r["valid"]) for r in plain.collect()}
    target = N.affinity_target(v, offsets)
    key = lambda d, *c: {r["idx"]: tuple(r[x] for x in c) for r in d.collect()}
    near = N.shifted(v, ["label"], offsets).groupBy("volume", "idx").agg(F.sum("n_label").alias("sum_label"), F.sum((F.col("label") == F.col("n_label")).cast("int")).alias("n_same"))
    assert key(A.neighbor_sums(b, offsets, size=size), "sum_label", "n_same") == key(near, "sum_label", "n_same")
    assert key(A.profile(b, offsets, size=size), "positive", "n_valid", "w_pos", "w_neg") == key(N.affinity_profile(target), "positive", "n_valid", "w_pos", "w_neg")
    assert (dense(A.valid_counts(b, offsets, size=size), "n_valid", a.shape) == dense(target.groupBy(*KEYS).agg(F.sum("valid").alias("n")), "n", a.shape)).all()

    def logit(h, k, same):
        z, y, x = h.axes()
        return np.where(same, 1.0, -1.0) + (z + 2 * y + 3 * x + k) % 5 / 3.0

    rows = target.withColumn("logit", F.when(F.col("target") == 1, 1.0).otherwise(-1.0) + F.expr("(z + 2 * y + 3 * x + idx) % 5 / 3.0D"))
    rows = C.balanced(rows, ["volume", "idx"], "target", "valid").withColumn("w", F.col("valid") * F.col("class_weight") * F.when(F.col("idx") < 1, 1.0).otherwise(2.0))
    want = C.composite(rows, ["volume"], "logit", "target", "w").first()
    one = C.balanced_composite(A.score_sums(b, logit, offsets, size=size), ["volume"], F.when(F.col("idx") < 1, 1.0).otherwise(2.0)).first()
    assert all(one[c] == pytest.approx(want[c]) for c in ("bce", "focal", "dice", "score"))
    aff = target.select(*KEYS, "idx", (F.col("target") * 0.5 + F.expr("(z + y + x + idx) % 7 / 20.0D")).alias("aff"))
    fg = rng.random(a.shape) < 0.7
    mask = grid(spark, fg, "fg").where("fg")
    built = W.build_edges(aff, offsets, 1, (1, 2, 3), mask)

    def affinity(h, k, same):
        z, y, x = h.axes()
        return same * 0.5 + (z + y + x + k) % 7 / 20.0

    bf = B.to_bricks(v.join(grid(spark, fg, "fg"), KEYS), size, ("label", "fg"))
    e = A.edges(bf, affinity, offsets, 1, (1, 2, 3), mask="fg", size=size)
    rows = lambda d: sorted((r["u"], r["v"], r["idx"], round(r["weight"], 9), r["mutex"]) for r in d.collect())
    assert rows(e) == rows(built) and len(rows(e)) > 100
    steps = K.binary_structure(3, 2)
    n = A.neighbor_counts(b, steps, size=size).collect()
    counts = {(r["z"], r["y"], r["x0"] + i): c for r in n for i, c in enumerate(r["n"])}
    inside = lambda p: all(0 <= i < w for i, w in zip(p, a.shape, strict=True))
    assert counts == {p: sum(inside(q) and a[q] == a[p] for q in (tuple(np.add(p, s).tolist()) for s in steps)) for p in np.ndindex(a.shape)}

"""That what queries shuffle, hold or send does not grow with rows that need not be made."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxloom.operators import affinities as A
from voxloom.operators import mutex as W
from voxloom.operators import resample as R
from voxloom.plans import grid_queries
from voxloom.sources import bricks as B
from voxloom.sources import fixtures as X


def volume_edges(seed, shape=(4, 6, 6)):
    rng, rows = np.random.default_rng(seed), []
    n = np.arange(np.prod(shape)).reshape(shape)
    for idx, o in enumerate([(1, 0, 0), (0, 1, 0), (0, 0, 1), (2, 0, 0), (0, 3, 1), (0, -2, 3)]):
        here, there = (tuple(slice(max(0, s * d), m - max(0, -s * d)) for d, m in zip(o, shape, strict=True)) for s in (-1, 1))
        u, v = n[here].ravel(), n[there].ravel()
        w = rng.integers(0, 12, len(u)) / 12
        rows.append(pd.DataFrame({"volume": "v", "u": u, "v": v, "idx": np.int32(idx), "weight": w, "mutex": idx >= 3}))
    return pd.concat(rows, ignore_index=True)


@pytest.mark.parametrize(("size", "most", "rows"), [((2, 2, 3), 10_000, False), ((4, 3, 6), 10_000, False), ((2, 3, 3), 250, True)])
def test_watershed_shuffles_no_row_an_edge(spark, monkeypatch, size, most, rows):
    seen, told = [], W._told_by_blocks
    monkeypatch.setattr(W, "_told_by_blocks", lambda *a: seen.append(1) or told(*a))
    e = volume_edges(7)
    one = W.solve_block(e)
    want = dict(zip(one["node"].tolist(), one["root"].tolist(), strict=True))
    ext = spark.createDataFrame([("v", 4, 6, 6)], "volume string, dz int, dy int, dx int")
    got = W.exact(spark.createDataFrame(e, "volume string, u bigint, v bigint, idx int, weight double, mutex boolean"), ext, size, most)
    assert {r["node"]: r["root"] for r in got.collect()} == want
    assert 1 < len(set(want.values())) < len(want)
    assert bool(seen) == rows  # blocks with more pairs than that go on as rows


def test_bricks_come_to_python_in_batches_of_bounded_bytes(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    monkeypatch.setattr(B, "BATCH_BYTES", 20_000)
    bricks = spark.range(64).selectExpr("'v' AS volume", "CAST(id AS INT) AS bz", "0 AS by", "0 AS bx", "CAST(id AS INT) AS z0", "0 AS y0", "0 AS x0", "1 AS dz", "10 AS dy", "50 AS dx", "transform(sequence(1, 500), i -> id) AS label").coalesce(1)
    try:
        sums = A.neighbor_sums(bricks, [(1, 0, 0)], size=(1, 10, 50))
        assert sums.first()["sum_label"] == 500 * (sum(range(1, 64)) + 63)
        batches = bricks.mapInPandas(lambda bs: (pd.DataFrame({"n": [len(b)]}) for b in bs), "n int").collect()
        assert sum(r["n"] for r in batches) == 64 and max(r["n"] for r in batches) <= 8
    finally:
        spark.conf.set(key, was)


def test_partitions_of_volumes_grow_in_number_and_not_in_size(spark):
    n = X.voxels(spark, "/root/testdata/sf0.1").rdd.getNumPartitions()
    assert 600_000 / n <= 100_000


EDGE = "volume string, u bigint, v bigint, idx int, weight double, mutex boolean"


def test_edges_of_a_volume_that_fits_a_task_are_ranked_without_a_row_an_edge(spark, monkeypatch):
    seen, by_ranges = [], W.ranked_by_ranges
    monkeypatch.setattr(W, "ranked_by_ranges", lambda *a: seen.append(1) or by_ranges(*a))
    small, large = volume_edges(3, (2, 4, 4)).assign(volume=None), volume_edges(4)
    e = spark.createDataFrame(pd.concat([small, large]).astype({"volume": object}).where(lambda d: d.notna(), None), EDGE)
    rank = {(r["volume"], r["u"], r["v"], r["idx"]): r["rank"] for r in W.ranked(e).collect()}
    bucket = {(r["volume"], r["u"], r["v"], r["idx"]): r["bucket"] for r in W.priority_buckets(e, 7).collect()}
    assert not seen
    most = len(large) - 1
    assert rank == {(r["volume"], r["u"], r["v"], r["idx"]): r["rank"] for r in W.ranked(e, most).collect()} and seen
    assert bucket == {(r["volume"], r["u"], r["v"], r["idx"]): r["bucket"] for r in W.priority_buckets(e, 7, most).collect()}
    for volume, d in ((None, small), ("v", large)):
        d = d.sort_values(["weight", "idx", "u", "v"], ascending=[False, True, True, True])
        keys = [(volume, *k) for k in zip(d["u"].tolist(), d["v"].tolist(), d["idx"].tolist(), strict=True)]
        assert [rank[k] for k in keys] == list(range(1, len(d) + 1))
        assert [bucket[k] for k in keys] == [i + 1 for i, part in enumerate(np.array_split(np.arange(len(d)), 7)) for _ in part]


def test_parallel_watershed_of_a_volume_that_fits_a_task_has_no_passes(spark, monkeypatch):
    seen, merges = [], W._sure_merges
    monkeypatch.setattr(W, "_sure_merges", lambda *a: seen.append(1) or merges(*a))
    small, large = volume_edges(5, (2, 3, 4)).assign(volume="s"), volume_edges(6, (3, 4, 5))
    e = spark.createDataFrame(pd.concat([small, large]), EDGE)
    roots = lambda d: {(r["volume"], r["node"]): r["root"] for r in d.collect()}
    whole = roots(W.boruvka(e, 2))
    assert not seen and 2 < len(set(whole.items())) and len({v for k, v in whole.items() if k[0] == "v"}) > 1
    assert whole == roots(W.boruvka(e, 2, 8, len(large) - 1)) and seen


def test_bricks_of_the_items_are_those_of_their_voxels(spark, tmp_path):
    items = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    odd = items.limit(3).withColumn("l_orderkey", F.lit(None).cast("bigint")).unionByName(items.limit(4).withColumn("l_orderkey", F.lit(9_000)).withColumn("l_quantity", F.lit(None).cast("double")))
    odd = odd.unionByName(items.limit(2).withColumn("l_orderkey", F.lit(-5_000))).unionByName(items.limit(5).withColumn("l_linenumber", F.lit(9)).withColumn("l_orderkey", F.lit(20_000)))
    items.unionByName(odd).unionByName(items.where("l_orderkey % 3 = 0").withColumn("l_extendedprice", F.lit(None).cast("double"))).write.parquet(str(tmp_path / "lineitem.parquet"))
    columns = ("intensity", "label", "pred")
    for size in ((8, 64, 64), (4, 16, 24)):
        got, want = X.bricks(spark, str(tmp_path), size, columns), B.to_bricks(X.voxels(spark, str(tmp_path)), size, columns)
        rounded = [F.expr("transform(intensity, i -> round(i, 6))").alias("intensity"), "label", "pred"]
        got, want = (d.select(*[c for c in want.columns if c not in columns], *rounded) for d in (got, want))
        assert got.dtypes == want.dtypes and got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < want.where("volume IS NULL").count()


@pytest.mark.parametrize(("kind", "sizes"), [("linear", (7, 5, 20)), ("linear", (3, 11, 4)), ("nearest", (7, 5, 20)), ("pool", (2, 5, 4))])
def test_resampling_of_bricks_equals_that_of_voxels(spark, monkeypatch, kind, sizes):
    a = np.random.default_rng(9).integers(0, 90, (5, 8, 11)).astype(float)
    a[1, 2, 3] = np.nan
    at = [x.ravel().tolist() for x in np.indices(a.shape)]
    v = spark.createDataFrame([("v", *r) for r in zip(*at, a.ravel().tolist(), strict=True)], "volume string, z int, y int, x int, intensity double")
    v = v.withColumn("label", F.col("x") * 1_000_003 + F.col("z")).withColumn("label", F.shiftleft(F.col("label").cast("bigint"), 33))
    value = "label" if kind == "nearest" else "intensity"
    to = {c: F.lit(n) for c, n in zip("zyx", sizes, strict=True)}
    rows = lambda d: sorted((r["z"], r["y"], r["x"], round(r[value], 6)) for r in d.where(~F.isnan(F.col(value).cast("double"))).collect())
    want = R.resample(v, to, value, kind)
    bricks = B.to_bricks(v, (2, 3, 4), (value,))
    monkeypatch.setattr(R, "spread", lambda *a: pytest.fail("a row a voxel and target"))
    got = R.resample_bricks(bricks, to, value, kind, size=(3, 4, 5))
    assert got.dtypes == want.select(got.columns).dtypes and got.count() == np.prod(sizes) and rows(got) == rows(want)


def test_trilinear_query_makes_no_row_a_target_and_voxel(spark, monkeypatch):
    monkeypatch.setattr(R, "spread", lambda *a: pytest.fail("a row a voxel and target"))
    assert grid_queries.QUERIES["res_trilinear"](spark, "/root/testdata/sf0.001").count() == 8_000


def test_bricks_are_written_by_load_and_the_last_load_of_a_volume_counts(spark, tmp_path):
    path = str(tmp_path / "b")
    bricks = lambda low, high, value: B.to_bricks(spark.range(low, high).selectExpr("concat('v', id) AS volume", "0 AS z", "0 AS y", "0 AS x", f"{value} AS label").coalesce(2), columns=("label",))
    B.write(bricks(0, 40, 1), path)
    assert len(list((tmp_path / "b").rglob("*.parquet"))) <= 8  # however many volumes
    B.write(bricks(30, 50, 2), path)
    bricks(0, 50, 3).write.parquet(f"{path}/load=000003")
    (tmp_path / "b" / "load=000003" / "_SUCCESS").unlink()  # as if it had not been finished
    got = {r["volume"]: r["label"] for r in B.to_voxels(B.read(spark, path), ("label",)).collect()}
    assert got == {f"v{k}": 1 if k < 30 else 2 for k in range(50)} and B.read(spark, path).count() == 50

"""That no side of a join that holds voxels is broadcast, and the operators that
replaced such joins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import affinities as A
from voxloom.operators import resample as R
from voxloom.operators import sampling as S
from voxloom.operators import tiling as T
from voxloom.operators import voxels as V
from voxloom.plans import registry
from voxloom.sources import bricks as B

SF = "/root/testdata/sf0.001"


def exploded_broadcasts(df):
    """Lines of the plan that ran, of rows that are broadcast as an explode makes them,
    without a count or an exchange in between that tells Spark how many they are."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    lines = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    found = []
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            for below in lines[k + 1 :]:
                if "Aggregate" in below or " Exchange" in below or "ShuffleQueryStage" in below:
                    break
                if "Generate" in below:
                    found.append(below)
                    break
    return found


@pytest.mark.parametrize("name", ["tile_reflect_pad", "deg_section_jitter", "deg_degrade_pair", "smp_patch_manifest", "jn_image_label_pair", "res_zoom_crop_pad"])
def test_no_exploded_side_is_broadcast(spark, name):
    assert exploded_broadcasts(registry.queries()[name](spark, SF)) == []


def grid(spark, shape, column="label"):
    a = np.arange(np.prod(shape)).reshape(shape)
    rows = [("v", *map(int, p), int(a[p])) for p in np.ndindex(*shape)]
    return a, spark.createDataFrame(rows, f"volume string, z int, y int, x int, {column} bigint")


@pytest.mark.parametrize(("shape", "size"), [((1, 2, 3), (4, 9, 11)), ((3, 4, 5), (3, 2, 13)), ((2, 1, 4), (2, 3, 4))])
def test_reflect_pad_over_several_periods(spark, shape, size):
    a, v = grid(spark, shape)
    got = {tuple(r[:3]): r[3] for r in T.reflect_pad(v, V.extents(v), size, "label").select("z", "y", "x", "label").collect()}
    full = [max(n, m) for n, m in zip(shape, size, strict=True)]
    want = np.pad(a, [(0, m - n) for n, m in zip(shape, full, strict=True)], mode="reflect")
    assert got == {p: want[p] for p in np.ndindex(*full)}


def test_center_fit_fills_gaps(spark):
    _, v = grid(spark, (2, 3, 4))
    sizes = v.select("volume").distinct().selectExpr("volume", "3 AS dz", "2 AS dy", "6 AS dx")
    got = {tuple(r[:3]): r[3] for r in R.center_fit(v.where("x <> 2"), sizes, "label", -1).select("z", "y", "x", "label").collect()}
    have = {(r.z, r.y, r.x): r.label for r in v.where("x <> 2").collect()}
    want = {(z, y, x): have.get((z + (2 - 3) // 2, y + (3 - 2) // 2, x + (4 - 6) // 2), -1) for z in range(3) for y in range(2) for x in range(6)}
    assert got == want


def test_crop_shares_count_what_is_there(spark):
    a, v = grid(spark, (3, 4, 6))
    crops = spark.createDataFrame([("s", "v", 0, 1, 2), ("t", "v", 2, 3, 5), ("u", "v", 7, 7, 7)], "sample string, volume string, z0 int, y0 int, x0 int")
    got = {r["sample"]: round(r["odd"], 6) for r in S.crop_shares(v, crops, (2, 2, 3), odd=F.col("label") % 2 == 1).collect()}
    part = lambda z, y, x: a[z : z + 2, y : y + 2, x : x + 3]
    assert got == {s: round(float((part(*p) % 2 == 1).mean()), 6) for s, p in (("s", (0, 1, 2)), ("t", (2, 3, 5)))}


def test_line_sums_are_sums_of_target_lines(spark, monkeypatch):
    monkeypatch.setattr(B, "SENT_BYTES", 100)  # pieces go on in many small frames
    _, v = grid(spark, (3, 5, 6))
    v = v.withColumn("label", F.expr("label div 7 % 3"))
    offsets, size = [(-1, 0, 0), (0, -3, 0), (0, 2, -4)], (2, 2, 4)
    bricks = B.to_bricks(v, size, ("label",))
    key = lambda d: sorted(map(tuple, d.select("volume", "z", "y", "idx", "n", "placed").collect()))
    assert key(A.line_sums(bricks, offsets, size=size)) == key(A.sums_along_x(A.target_lines(bricks, offsets, size=size)))

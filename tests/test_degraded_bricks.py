"""That volumes degraded whole, as arrays, are what the chain of rows makes of them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxloom.operators import resample as R
from voxloom.plans import grid_queries
from voxloom.sources import bricks as B


def rows_of(volume, a, keep=None):
    z, y, x = (v.ravel() for v in np.indices(a.shape))
    rows = pd.DataFrame({"volume": volume, "z": z, "y": y, "x": x, "intensity": a.ravel()})
    return rows if keep is None else rows[keep(rows)]


def values(d):
    d = d.select("volume", "z", "y", "x", "clean", "degraded").toPandas().sort_values(["volume", "z", "y", "x"])
    return list(map(tuple, d[["volume", "z", "y", "x"]].to_numpy().tolist())), d[["clean", "degraded"]].to_numpy(float)


@pytest.mark.parametrize(("zf", "normalize"), [(2.0, True), (3.0, False), (9.0, True)])
def test_volumes_of_bricks_are_degraded_as_rows_are(spark, monkeypatch, zf, normalize):
    rng = np.random.default_rng(6)
    odd = rng.random((5, 4, 6))
    odd[2, 1, 3] = np.nan
    scale = 40 if normalize else 1
    some = [rows_of("v", rng.random((7, 5, 9)) * scale), rows_of("flat", np.full((4, 3, 5), 0.5)), rows_of("one", rng.random((1, 1, 1))), rows_of("nan", odd), rows_of("gap", rng.random((4, 6, 8)), lambda r: (r["z"] < 2) | (r["y"] < 4))]
    v = spark.createDataFrame(pd.concat(some), "volume string, z int, y int, x int, intensity double")
    bricks = B.to_bricks(v, (2, 4, 4), ("intensity",))
    rows, chain = [], R._degraded_rows
    monkeypatch.setattr(R, "_degraded_rows", lambda d, *a: rows.append({r["volume"] for r in d.select("volume").distinct().collect()}) or chain(d, *a))
    pairs = R.degrade_pair(bricks, zf, 5, normalize=normalize)
    keys, got = values(pairs)
    assert rows == [{"gap"}] and pairs.where("clean IS NULL OR degraded IS NULL").count() == 0
    want_keys, want = values(R.degrade_pair(v, zf, 5, normalize=normalize))
    assert keys == want_keys and np.allclose(got, want, equal_nan=True)
    assert np.nanstd(got[:, 1]) > 0.01
    monkeypatch.setattr(R, "VOLUME_VOXELS", 0)
    assert np.allclose(values(R.degrade_pair(bricks, zf, 5, normalize=normalize))[1], want, equal_nan=True)


def test_the_query_makes_no_row_a_voxel_before_the_last_step(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    keys, want = values(R.degrade_pair(grid_queries.normed(spark, sf), 2.0, 3))
    monkeypatch.setattr(R, "_degraded_rows", lambda *a: pytest.fail("a row a voxel"))
    monkeypatch.setattr(grid_queries.X, "voxels", lambda *a: pytest.fail("a row a voxel"))
    got_keys, got = values(grid_queries.QUERIES["deg_degrade_pair"](spark, sf))
    assert keys == got_keys and np.abs(got - want).max() < 1e-9


def test_draws_of_texts_are_those_of_columns(spark):
    one = spark.range(50).selectExpr("concat('v', id) AS volume", "CAST(id AS INT) AS z").select("volume", "z", R.draw_bits(3, "volume", "z", F.lit(1)).alias("bits")).collect()
    assert R.draws(f"3:{r['volume']}:{r['z']}:1" for r in one).tolist() == [r["bits"] for r in one]

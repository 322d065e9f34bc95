"""The driver's contract, and that the parts that DuckDB can say agree with it
on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from voxloom.plans import registry

SF = "/root/testdata/sf0.001"
SOME = ["agg_voi", "agg_ted", "agg_ari", "prj_probe_norm", "jn_patch_assign", "win_best_depth", "bnd_erode", "tile_patch_grid", "res_nearest", "scr_soft_dice", "mws_build_edges", "str_running_contingency"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(tuple(None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


def test_entry(spark):
    row = __spark_entry__.entry(spark).first()
    assert math.isclose(row["voi_split"] + row["voi_merge"], row["voi_total"], abs_tol=2e-6)


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and len(registry.queries()) > 100


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert plain(got.select(*columns).collect()) == plain(want)


def test_voi_of_the_first_volume(spark):
    """A value that was worked out apart from this code."""
    from voxloom.operators import metrics as M
    from voxloom.sources import fixtures as X

    v = M.voi(M.contingency(X.voxels(spark, SF), "label", "pred")).first()
    assert (round(v["voi_split"], 6), round(v["voi_merge"], 6)) == (0.950945, 0.832593)

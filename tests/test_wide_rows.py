"""That volumes and blocks go on packed, in rows that readers can hold, and that volumes
solved whole and in blocks are the same."""

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from voxloom.operators import affinities as A
from voxloom.operators import mutex as W
from voxloom.operators.graph import cut
from voxloom.plans import graph_queries as G
from voxloom.sources import bricks as B

EDGE = "volume string, u bigint, v bigint, idx int, weight double, mutex boolean"
OFFSETS = [(-1, 0, 0), (0, -1, 0), (0, 0, -1), (-2, 0, 0), (0, -3, 1), (0, 2, -3)]
SHAPE = (4, 6, 7)


def voxel_rows(seed, volume, shape=SHAPE, foreground=0.8):
    rng = np.random.default_rng(seed)
    z, y, x = (a.ravel() for a in np.indices(shape))
    return pd.DataFrame({"volume": volume, "z": z, "y": y, "x": x, "label": rng.integers(1, 4, len(z)), "fg": rng.random(len(z)) < foreground})


@pytest.fixture
def voxels(spark):
    rows = [voxel_rows(1, "v"), voxel_rows(2, "w", (3, 5, 6)), voxel_rows(3, "bare", (2, 3, 4), 0.0), voxel_rows(4, "full", (2, 3, 4), 1.0)]
    return spark.createDataFrame(pd.concat(rows), "volume string, z int, y int, x int, label bigint, fg boolean").repartition(3)


def edges(voxels, mask=None, packed=False):
    def affinity(h, k, same):
        z, y, x = h.axes()
        return np.where(same, 0.6, 0.2) + ((z * 11 + y * 7 + x * 3 + k * 5) % 13) / 60

    return A.edges(B.to_bricks(voxels, (2, 3, 4), ("label", "fg")), affinity, OFFSETS, 3, (1, 1, 1), size=(2, 3, 4), mask=mask, decimals=6, packed=packed)


def by_node(d):
    return {(r["volume"], r["node"]): tuple(r[2:]) for r in d.collect()}


def test_packed_edges_are_the_edges(spark, voxels):
    key = lambda d: d.select("volume", *W.PACKED).toPandas().sort_values(["volume", "u", "v", "idx"]).to_numpy().tolist()
    packed = edges(voxels, "fg", True)
    assert packed.columns == ["volume", "n", "data"] and packed.count() < 60
    assert key(W._edges_of(packed)) == key(edges(voxels, "fg"))


@pytest.mark.parametrize("size", [(2, 3, 4), (1, 4, 7), (4, 6, 7)])
def test_volumes_in_blocks_and_whole_are_the_same(spark, voxels, monkeypatch, size):
    ext = B.extents(B.to_bricks(voxels, (2, 3, 4), ("label",)))
    e = edges(voxels, "fg", True).localCheckpoint()
    whole, named = by_node(W.exact(e, ext, size)), by_node(W.stitch_blocks(e, ext, size))
    monkeypatch.setattr(W, "VOLUME_EDGES", 0)
    seen = []
    monkeypatch.setattr(W, "cut", lambda d, wide=False: seen.append(dict(d.dtypes)) or cut(d, wide))
    assert by_node(W.exact(e, ext, size)) == whole and by_node(W.stitch_blocks(e, ext, size)) == named
    assert {n: i for n, (_, i) in named.items()} == {n: r for n, (r,) in whole.items()}
    # what blocks leave is bytes: readers of arrays take up memory for thousands of rows of them
    assert any("pairs" in kinds for kinds in seen) and not [kinds for kinds in seen if any(k.startswith("array") for k in kinds.values())]


@pytest.mark.parametrize("grow", [None, 2.0, 0.0])
def test_agglomeration_whole_in_blocks_of_rows_and_of_bricks(spark, voxels, monkeypatch, grow):
    blocks, agglomerated = [], W._agglomerated
    monkeypatch.setattr(W, "_agglomerated", lambda *a: blocks.append(1) or agglomerated(*a))
    e, bricks = edges(voxels, "fg", True).localCheckpoint(), B.to_bricks(voxels, (2, 3, 4), ("fg",))
    run = lambda e, v: sorted(map(tuple, W.agglomerate(e, v, "fg", 3, 20, grow, (5.0, 1.0, 1.0), (2, 3, 4)).select("volume", "z", "y", "x", "instance").collect()))
    got = run(e, voxels)
    assert len(got) == voxels.count() and len({(r[0], r[4]) for r in got}) > 6 and all(r[4] == 0 for r in got if r[0] == "bare")
    odd = voxels.unionByName(voxels.limit(5).withColumn("volume", F.lit(None).cast("string"))).withColumn("fg", F.when(F.col("fg"), True))
    assert got == run(W._edges_of(e), odd) == run(e, bricks) and not blocks
    monkeypatch.setattr(W, "VOLUME_EDGES", 0)
    assert got == run(e, voxels) == run(e, bricks) and blocks


def test_a_wide_box_with_few_edges_is_not_one_task(spark, monkeypatch):
    monkeypatch.setattr(W, "VOLUME_EDGES", 50)
    blocks, agglomerated = [], W._agglomerated
    monkeypatch.setattr(W, "_agglomerated", lambda *a: blocks.append(1) or agglomerated(*a))
    v = spark.createDataFrame([("v", 0, 0, x, x < 3) for x in range(60)], "volume string, z int, y int, x int, fg boolean")
    e = spark.createDataFrame([("v", 0, 1, 2, 0.9, False), ("v", 1, 2, 2, 0.8, False)], EDGE)
    assert [r["instance"] for r in W.agglomerate(e, v, "fg").orderBy("x").collect()] == [1] * 3 + [0] * 57 and blocks


def test_row_groups_of_wide_rows_are_small(spark):
    wide = spark.range(40).coalesce(1).mapInPandas(lambda bs: (b.assign(data=[np.random.default_rng(i).bytes(1 << 20) for i in b["id"]]) for b in bs), "id bigint, data binary")
    table = cut(wide, wide=True)
    sizes = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in table.inputFiles()]
    groups = [m.row_group(k).total_byte_size for m in sizes for k in range(m.num_row_groups)]
    assert len(groups) >= 4 and max(groups) <= 12 << 20 and table.count() == 40


@pytest.mark.parametrize("name", ["mws_exact", "mws_block_stitch", "mws_agglomerate"])
def test_queries_make_no_row_a_voxel_before_the_last_step(spark, monkeypatch, name):
    monkeypatch.setattr(G.X, "voxels", lambda *a: pytest.fail("a row a voxel"))
    monkeypatch.setattr(W, "_in_passes", lambda *a: pytest.fail("a volume that fits a task goes by blocks"))
    assert G.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0

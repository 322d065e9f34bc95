"""Bricks, files and streams in temporary folders."""

import hashlib

import numpy as np
import pytest

from test_operators import dense, grid
from voxloom.operators import neighbors as N
from voxloom.sources import bricks as B
from voxloom.streaming import metrics as S


def test_brick_round_trip_and_region(spark, tmp_path):
    a = np.random.default_rng(1).integers(0, 9, (5, 18, 20)).astype(np.int64)
    v = grid(spark, a)
    b = B.to_bricks(v, columns=("label",))
    B.write(b, str(tmp_path / "b"))
    back = B.to_voxels(spark.read.parquet(str(tmp_path / "b")), ("label",))
    assert (dense(back, "label", a.shape) == a).all()
    bricks = spark.read.parquet(str(tmp_path / "b")).withColumnRenamed("label", "intensity").selectExpr("*", "intensity AS label")
    bricks.write.partitionBy("volume").parquet(str(tmp_path / "c"))
    r = B.read_region(spark, str(tmp_path / "c"), "v", (1, 3, 2), (2, 15, 16))
    assert r.count() == 2 * 15 * 16 and all(a[x["z"], x["y"], x["x"]] == x["label"] for x in r.collect())


def test_halo_kernel_equals_the_voxel_join(spark):
    a = np.random.default_rng(2).integers(0, 3, (6, 20, 18)).astype(np.int64)
    offsets = [(-1, 0, 0), (0, 2, -3), (1, -5, 4)]
    v = grid(spark, a)
    key = lambda d: {(r["z"], r["y"], r["x"], r["idx"]): r["target"] for r in d.collect()}
    assert key(B.affinity_bricks(B.to_bricks(v, columns=("label",)), offsets)) == key(N.affinity_target(v, offsets))


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(3)
    np.save(tmp_path / "a.npy", rng.random((3, 4, 5)))
    np.savez(tmp_path / "b.npz", other=np.zeros(2), data=rng.random((1, 2, 3, 4)))
    np.save(tmp_path / "flat.npy", np.zeros((3, 4)))
    (tmp_path / "cut.npy").write_bytes((tmp_path / "a.npy").read_bytes()[:40])
    (tmp_path / "a.tif").write_bytes(b"II*")
    return tmp_path


def test_files(spark, folder):
    files = B.listing(spark, str(folder), content=True)
    ok = {r["name"]: r["ok"] for r in B.validate(files).collect()}
    assert ok == {"a.npy": True, "b.npz": True, "flat.npy": False, "cut.npy": False, "a.tif": False}
    assert {r["name"] for r in B.resolve_names(files).where("stem = 'a'").collect()} == {"a.tif"}
    sums = [("a.npy", (folder / "a.npy").stat().st_size, hashlib.md5((folder / "a.npy").read_bytes()).hexdigest()), ("b.npz", 1, ""), ("cut.npy", 40, "x"), ("gone", 1, "")]
    got = {r["name"]: r["status"] for r in B.verify_checksums(files, spark.createDataFrame(sums, "name string, size bigint, md5 string")).collect()}
    assert got == {"a.npy": "ok", "b.npz": "wrong size", "cut.npy": "wrong checksum", "gone": "missing"}
    bricks = B.ingest(files, (2, 2, 2))
    assert {(r["volume"], r["count"]) for r in bricks.groupBy("volume").count().collect()} == {("a", 12), ("b", 4)}
    assert {r["name"] for r in B.pending(files.select("name"), files.where("length < 100").select("name")).collect()} == {"a.npy", "b.npz", "flat.npy"}


@pytest.mark.parametrize("order", ["C", "F"])
def test_a_file_read_by_ranges_equals_the_whole_file(spark, tmp_path, order):
    from voxloom.sources import npy

    a = np.random.default_rng(4).integers(0, 999, (9, 21, 35)).astype(">i2")
    np.save(tmp_path / "v.npy", np.asarray(a, order=order))
    np.save(tmp_path / "w.npy", a[None, :2].astype(float))
    files = [((tmp_path / n).as_uri(), n[0]) for n in ("v.npy", "w.npy")]
    size = (4, 8, 16)
    got = npy.read_volumes(spark, files, size, part_bytes=3000)
    assert got.rdd.getNumPartitions() > 6
    want = B.ingest(B.listing(spark, str(tmp_path), content=True), size)
    key = lambda d: sorted((*tuple(r)[:-1], tuple(r["values"])) for r in d.collect())
    assert got.columns == want.columns and key(got) == key(want)
    # no slab is larger than a few rows of bricks, whatever the file's size
    at = npy.layout((tmp_path / "v.npy").read_bytes()[:2000])
    big = npy.Layout(at.offset, at.kind, (6446, 6643, 8090), at.turned)
    most = max((s.last - s.first) * (s.high - s.low) * big.shape[2] * 2 for s in npy.slabs("", "v", big, size))
    assert most <= npy.PART_BYTES


def test_a_box_of_a_file(spark, tmp_path):
    from voxloom.sources import npy

    a = np.random.default_rng(5).random((9, 21, 35))
    np.save(tmp_path / "v.npy", a)
    got = npy.read_box(spark, (tmp_path / "v.npy").as_uri(), "v", (5, 3, 20), (2, 6, 9), (4, 8, 16), part_bytes=1)
    v = {(r["z"], r["y"], r["x"]): r["values"] for r in B.to_voxels(got, ("values",)).collect()}
    assert all(v[z, y, x] == a[z, y, x] for z in range(5, 7) for y in range(3, 9) for x in range(20, 29)) and len(v) == 4 * 16 * 16
    assert npy.read_box(spark, (tmp_path / "v.npy").as_uri(), "v", (50, 3, 20), (2, 6, 9)).count() == 0


def test_a_file_that_ends_early_is_an_error(spark, tmp_path):
    from voxloom.sources import npy

    np.save(tmp_path / "v.npy", np.zeros((4, 8, 8)))
    (tmp_path / "v.npy").write_bytes((tmp_path / "v.npy").read_bytes()[:1000])
    with pytest.raises(Exception, match="ends before"):
        npy.read_volumes(spark, [((tmp_path / "v.npy").as_uri(), "v")]).collect()


def test_stems():
    assert B.parse_stem(B.make_stem("minnie65_8nm", 3, 2, 1)) == ("minnie65_8nm", 3, 2, 1)


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 1.0), ("b", 5.0, 0.0), ("c", 1.0, 1.0)], "name string, value double, weight double")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    S.to_table(S.running_eval(s, ["name"]), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = sorted(map(tuple, S.read_table(spark, str(tmp_path / "out"), S.running_eval(rows, ["name"]).schema).collect()))
    assert got == sorted(map(tuple, S.running_eval(rows, ["name"]).collect())) and len(got) == 2


def test_readers_see_one_batch_whole_while_the_next_is_written(spark, tmp_path):
    put, path = S.batch_sink(str(tmp_path / "t"), "complete"), str(tmp_path / "t")
    one = spark.createDataFrame([(1,), (2,)], "id int")
    assert S.read_table(spark, path, one.schema).count() == 0
    put(one, 0)
    reader = S.read_table(spark, path, one.schema)

    class Broken:
        """A batch whose write fails half way."""

        sparkSession = spark

        @property
        def write(self):
            (tmp_path / "t" / "batch-1-half").mkdir()
            (tmp_path / "t" / "batch-1-half" / "part-0.parquet").write_bytes(b"PAR1")
            raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        put(Broken(), 1)
    assert sorted(r["id"] for r in S.read_table(spark, path, one.schema).collect()) == [1, 2]
    for number in (1, 1):  # a batch that is run again replaces itself
        put(spark.createDataFrame([(3,)], "id int"), number)
    assert [r["id"] for r in S.read_table(spark, path, one.schema).collect()] == [3]
    put(spark.createDataFrame([(4,)], "id int"), 2)
    assert [r["id"] for r in S.read_table(spark, path, one.schema).collect()] == [4]
    with pytest.raises(Exception, match="exist|found"):
        reader.collect()  # of three batches ago

"""Bricks: one row per chunk of a volume, with arrays of its voxels; their
files, and what is exchanged across their borders."""

from __future__ import annotations

import io
import re
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.operators.voxels import AXES

SIZE = (4, 16, 16)
EXTENSIONS = (".h5", ".hdf5", ".tif", ".tiff", ".nrrd", ".nii", ".nii.gz", ".npy", ".npz")  # in order of preference


def to_bricks(voxels: DataFrame, size=SIZE, columns=("intensity", "label")) -> DataFrame:
    """(volume, bz, by, bx, z0, y0, x0, dz, dy, dx, columns as arrays), arrays in
    raster order. Voxels of a brick must fill their bounding box."""
    v = voxels.withColumns({f"b{a}": F.expr(f"CAST({a} div {n} AS INT)") for a, n in zip(AXES, size, strict=True)})
    g = v.groupBy("volume", "bz", "by", "bx").agg(
        *(F.min(a).alias(f"{a}0") for a in AXES), *((F.max(a) - F.min(a) + 1).alias(f"d{a}") for a in AXES), F.sort_array(F.collect_list(F.struct(*AXES, *columns))).alias("_v")
    )
    return g.select("volume", "bz", "by", "bx", *(f"{a}0" for a in AXES), *(f"d{a}" for a in AXES), *(F.col(f"_v.{c}").alias(c) for c in columns))


def to_voxels(bricks: DataFrame, columns=("intensity", "label")) -> DataFrame:
    """The voxels of bricks, one row each."""
    e = bricks.select("volume", *(f"{a}0" for a in AXES), "dy", "dx", F.posexplode(F.arrays_zip(*columns)).alias("_p", "_v"))
    at = {"z": "z0 + _p div (dy * dx)", "y": "y0 + (_p div dx) % dy", "x": "x0 + _p % dx"}
    return e.select("volume", *(F.expr(f"CAST({at[a]} AS INT)").alias(a) for a in AXES), *(f"_v.{c}" for c in columns))


def extents(bricks: DataFrame) -> DataFrame:
    """(volume, dz, dy, dx), from the bricks' boxes."""
    return bricks.groupBy("volume").agg(*(F.max(F.col(f"{a}0") + F.col(f"d{a}")).alias(f"d{a}") for a in AXES))


def _loads(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the loads in a folder of bricks; one that was not finished has none."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [f.getPath() for f in files.listStatus(folder)]
    whole = [p.getName() for p in names if p.getName().startswith("load=") and files.exists(context._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.removeprefix("load=")) for n in whole)


def write(bricks: DataFrame, path: str, per_file: int = 65_536) -> None:
    """Parquet, zstd, files of bounded size that hold many volumes; each call is a load, a
    folder of its own. A volume that is written again replaces what it had for ``read``: of
    a volume the last load that has it counts. So files grow in number with the bricks and
    not with the volumes, and no volume's folder is renamed by the driver."""
    k = max(_loads(bricks.sparkSession, path), default=0) + 1
    bricks.write.option("compression", "zstd").option("maxRecordsPerFile", per_file).mode("overwrite").parquet(f"{path}/load={k:06d}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The bricks of a folder that ``write`` made, of each volume those of its last load."""
    loads = _loads(spark, path)
    if not loads:
        return spark.read.parquet(path)
    rows = spark.read.parquet(path).where(F.col("load").isin(loads))
    if len(loads) == 1:
        return rows.drop("load")
    last = rows.groupBy(F.col("volume").alias("_volume")).agg(F.max("load").alias("_load"))
    return rows.join(last, rows["volume"].eqNullSafe(last["_volume"]) & (rows["load"] == last["_load"])).drop("load", "_volume", "_load")


def read_region(spark: SparkSession, path: str, volume: str, start, size, brick=SIZE) -> DataFrame:
    """Voxels of a box: the bricks that it touches, found by volume and brick
    numbers, then trimmed."""
    b = read(spark, path).where(F.col("volume") == volume)
    for a, s, n, w in zip(AXES, start, size, brick, strict=True):
        b = b.where((F.col(f"b{a}") >= s // w) & (F.col(f"b{a}") <= (s + n - 1) // w))
    v = to_voxels(b)
    for a, s, n in zip(AXES, start, size, strict=True):
        v = v.where((F.col(a) >= s) & (F.col(a) < s + n))
    return v


KINDS = {"array<bigint>": "<i8", "array<int>": "<i4", "array<double>": "<f8", "array<float>": "<f4", "array<boolean>": "?"}
_BOX = "z0 int, y0 int, x0 int, dz int, dy int, dx int"


class Halo:
    """A brick and what lies around it: ``start``, ``size`` and the volume's
    ``extent`` (z, y, x), and arrays of its columns with voxels of other bricks."""

    def __init__(self, row, columns: dict[str, str], reach):
        self.volume, self.start, self.size, self.extent = row.volume, (row.z0, row.y0, row.x0), (row.dz, row.dy, row.dx), (row.nz, row.ny, row.nx)
        before, after = _both(reach)
        self.low = [max(0, s - m) for s, m in zip(self.start, before, strict=True)]
        high = [min(n, s + d + m) for n, s, d, m in zip(self.extent, self.start, self.size, after, strict=True)]
        self.blocks = {c: np.zeros([h - s for s, h in zip(self.low, high, strict=True)], kind) for c, kind in columns.items()}
        for p in row.parts:
            shape = (p["dz"], p["dy"], p["dx"])
            at = tuple(slice(q - s, q - s + d) for q, s, d in zip((p["z0"], p["y0"], p["x0"]), self.low, shape, strict=True))
            for c, kind in columns.items():
                self.blocks[c][at] = np.frombuffer(p[c], kind).reshape(shape)

    def axes(self) -> list[np.ndarray]:
        """The coordinates of the brick's voxels, so that they broadcast."""
        return list(np.ix_(*(np.arange(s, s + d) for s, d in zip(self.start, self.size, strict=True))))

    def own(self, column: str) -> np.ndarray:
        return self.at(column, (0, 0, 0))

    def at(self, column: str, offset) -> np.ndarray:
        """The column at every voxel's neighbour, clamped into the volume."""
        if all(0 <= s + d and s + w + d <= n for s, w, d, n in zip(self.start, self.size, offset, self.extent, strict=True)):
            return self.blocks[column][tuple(slice(s + d - q, s + w + d - q) for s, w, d, q in zip(self.start, self.size, offset, self.low, strict=True))]
        there = [np.clip(np.arange(s, s + w) + d, 0, n - 1) - q for s, w, d, n, q in zip(self.start, self.size, offset, self.extent, self.low, strict=True)]
        return self.blocks[column][np.ix_(*there)]


def _both(reach) -> tuple[tuple, tuple]:
    """How far a reach goes before and behind a brick, along each axis."""
    pairs = [r if isinstance(r, tuple) else (r, r) for r in reach]
    return tuple(r[0] for r in pairs), tuple(r[1] for r in pairs)


BATCH_BYTES = 4 << 20  # of bricks that Spark sends to Python at once
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(bricks: DataFrame) -> DataFrame:
    """``bricks``, and what Python gets of them in batches of about ``BATCH_BYTES``, where
    the session would send more: what a task holds is some times a batch, however many bricks
    it has. The setting stays, as results are computed later."""
    conf = bricks.sparkSession.conf
    now = conf.get(ARROW_BYTES).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(ARROW_BYTES, str(BATCH_BYTES))
    return bricks


SENT_BYTES = 8 << 20  # of pieces that a task holds before it passes them on


def halos(bricks: DataFrame, columns: dict[str, str], reach, size=SIZE) -> DataFrame:
    """``bricks`` (as ``to_bricks`` cuts them by ``size``) with the volume's extent
    and parts: what lies within ``reach`` voxels of the brick, its own part too; a
    reach along an axis may be a pair, for before and behind the brick. Each brick cuts out of its arrays what each of its neighbours needs of it, and
    sends that and no more; the neighbours' numbers are as many rings as the reach
    asks for."""
    ext = bricks.groupBy("volume").agg(*(F.max(F.col(f"{a}0") + F.col(f"d{a}")).alias(f"n{a}") for a in AXES))
    before, after = _both(reach)
    up, down = ([-(-r // n) for r, n in zip(far, size, strict=True)] for far in (before, after))

    columns_sent = ["volume", "bz", "by", "bx", "z0", "y0", "x0", "dz", "dy", "dx", "nz", "ny", "nx", "part"]

    def send(batches):
        for b in batches:
            rows, held = [], 0
            for r in b.itertuples(index=False):
                start, shape, extent = (r.z0, r.y0, r.x0), (r.dz, r.dy, r.dx), (r.nz, r.ny, r.nx)
                arrays = {c: np.asarray(getattr(r, c), kind).reshape(shape) for c, kind in columns.items()}
                for t in product(*(range(max(0, q - j), min((n - 1) // w, q + k) + 1) for q, j, k, n, w in zip((r.bz, r.by, r.bx), down, up, extent, size, strict=True))):
                    own = [k * w for k, w in zip(t, size, strict=True)]
                    ends = [min(n, s + w) for n, s, w in zip(extent, own, size, strict=True)]
                    low = [max(s, q - m) for s, q, m in zip(start, own, before, strict=True)]
                    high = [min(s + d, e + m) for s, d, e, m in zip(start, shape, ends, after, strict=True)]
                    if all(q < h for q, h in zip(low, high, strict=True)):
                        piece = tuple(slice(q - s, h - s) for q, h, s in zip(low, high, start, strict=True))
                        rows.append((r.volume, *t, *own, *(e - s for e, s in zip(ends, own, strict=True)), *extent, {**dict(zip(("z0", "y0", "x0", "dz", "dy", "dx"), (*low, *(h - q for h, q in zip(high, low, strict=True))), strict=True)), **{c: a[piece].tobytes() for c, a in arrays.items()}}))
                        held += sum(a[piece].nbytes for a in arrays.values())
                # with a wide reach each brick goes to many: what a batch sends is many times the batch
                if held > SENT_BYTES:
                    yield pd.DataFrame(rows, columns=columns_sent)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns_sent)

    part = ", ".join(f"{x.split(' ')[0]}:int" for x in _BOX.split(", "))
    held = ", ".join(f"{c}:binary" for c in columns)
    sent = in_small_batches(bricks).join(ext, "volume").mapInPandas(send, f"volume string, bz int, by int, bx int, {_BOX}, nz int, ny int, nx int, part struct<{part}, {held}>")
    return sent.groupBy(*[c for c in sent.columns if c != "part"]).agg(F.collect_list("part").alias("parts"))


def cut_at_borders(start, blocks: dict[str, np.ndarray], size):
    """The pieces of arrays that lie at ``start`` that each brick of the grid gets:
    (brick numbers, box of the piece, pieces by name as bytes)."""
    shape = next(iter(blocks.values())).shape
    for t in product(*(range(s // w, (s + d - 1) // w + 1) for s, d, w in zip(start, shape, size, strict=True))):
        low = [max(s, k * w) for s, k, w in zip(start, t, size, strict=True)]
        high = [min(s + d, (k + 1) * w) for s, d, k, w in zip(start, shape, t, size, strict=True)]
        at = tuple(slice(q - s, h - s) for q, h, s in zip(low, high, start, strict=True))
        yield t, low, [h - q for h, q in zip(high, low, strict=True)], {c: np.ascontiguousarray(a[at]).tobytes() for c, a in blocks.items()}


def over_halos(bricks: DataFrame, columns: list[str], reach, fn, schema: str, size=SIZE) -> DataFrame:
    """Apply ``fn`` (from a ``Halo`` to a dict of columns) to every brick with what
    lies around it; the columns that ``schema`` names come out. What a brick gives
    may be its voxels or, so that no row a voxel and offset is made, sums over them."""
    kinds = {c: KINDS[dict(bricks.dtypes)[c]] for c in columns}
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                found = pd.DataFrame(fn(Halo(r, kinds, reach)))
                if len(found):
                    yield found[names]

    return halos(bricks, kinds, reach, size).mapInPandas(run, schema)


def affinity_bricks(bricks: DataFrame, offsets, label: str = "label", size=SIZE) -> DataFrame:
    """(volume, z, y, x, idx, target) like the voxel-wise affinity target, by a
    kernel on bricks with halos: one array operation an offset and brick. Offsets
    may reach over any number of bricks."""

    def run(h: Halo) -> dict:
        own, n = h.own(label), int(np.prod(h.size))
        z, y, x = (np.broadcast_to(a, h.size).ravel() for a in h.axes())
        same = [(h.at(label, o) == own).ravel().astype(np.int32) for o in offsets]
        k = len(offsets)
        return {"volume": h.volume, "z": np.tile(z, k), "y": np.tile(y, k), "x": np.tile(x, k), "idx": np.repeat(np.arange(k, dtype=np.int32), n), "target": np.concatenate(same)}

    return over_halos(bricks, [label], reach_of(offsets), run, "volume string, z int, y int, x int, idx int, target int", size)


def reach_of(offsets) -> tuple[int, int, int]:
    return tuple(max(abs(o[k]) for o in offsets) for k in range(3))


# --- files -----------------------------------------------------------------


def listing(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """(path, name, stem, suffix, length[, content]) of the files below a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.regexp_extract(name, r"(\.nii\.gz|\.[^.]+)$", 1)
    return f.select("path", name.alias("name"), F.regexp_replace(name, r"(\.nii\.gz|\.[^.]+)$", "").alias("stem"), suffix.alias("suffix"), "length", *(["content"] if content else []))


def resolve_names(files: DataFrame) -> DataFrame:
    """Of each stem's files the one whose extension comes first in EXTENSIONS."""
    order = F.array_position(F.array(*(F.lit(e) for e in EXTENSIONS)), F.col("suffix"))
    ranked = files.withColumn("_o", order).where("_o > 0").withColumn("_r", F.row_number().over(Window.partitionBy("stem").orderBy("_o", "name")))
    return ranked.where("_r = 1").drop("_o", "_r")


def verify_checksums(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, status) of every manifest row (name, size, md5): ok, missing, or
    wrong size or checksum."""
    f = files.select("name", F.col("length").alias("_length"), F.md5("content").alias("_md5"))
    status = F.when(F.col("_length").isNull(), "missing").when(F.col("_length") != F.col("size"), "wrong size").when(F.col("_md5") != F.col("md5"), "wrong checksum").otherwise("ok")
    return manifest.join(f, "name", "left").select("name", status.alias("status"))


def decode(content: bytes) -> np.ndarray:
    """The array in an .npy file, or the one named main, data, raw, volume, image
    or label, in this order, or else the first, in an .npz."""
    loaded = np.load(io.BytesIO(content), allow_pickle=False)
    if isinstance(loaded, np.ndarray):
        return loaded
    return loaded[next((k for k in ("main", "data", "raw", "volume", "image", "label") if k in loaded.files), loaded.files[0])]


def validate(files: DataFrame) -> DataFrame:
    """(name, suffix, ok, reason, shape): a file is fit if its suffix is known
    here and it opens as three dimensions, after a single leading channel."""

    @F.pandas_udf("ok boolean, reason string, shape array<int>")
    def check(suffix: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = []
        for s, c in zip(suffix, content, strict=True):
            try:
                if s not in (".npy", ".npz"):
                    raise ValueError("no codec")
                a = decode(c)
                a = a[0] if a.ndim == 4 and len(a) == 1 else a
                rows.append((a.ndim == 3, None if a.ndim == 3 else f"{a.ndim} dimensions", list(a.shape)))
            except Exception as e:  # what a damaged file raises is not known beforehand
                rows.append((False, type(e).__name__, None))
        return pd.DataFrame(rows, columns=["ok", "reason", "shape"])

    return files.select("name", "suffix", check("suffix", "content").alias("c")).select("name", "suffix", "c.*")


def ingest(files: DataFrame, size=SIZE) -> DataFrame:
    """Bricks (volume, bz, by, bx, z0, y0, x0, dz, dy, dx, values) of the fit
    files; a file is decoded in one task and leaves it brick by brick."""

    def run(batches):
        for b in batches:
            for stem, content in zip(b["stem"], b["content"], strict=True):
                a = decode(content)
                a = a[0] if a.ndim == 4 else a
                rows = []
                for z in range(0, a.shape[0], size[0]):
                    for y in range(0, a.shape[1], size[1]):
                        for x in range(0, a.shape[2], size[2]):
                            c = a[z : z + size[0], y : y + size[1], x : x + size[2]]
                            rows.append((stem, z // size[0], y // size[1], x // size[2], z, y, x, *c.shape, c.astype(float).ravel()))
                yield pd.DataFrame(rows, columns=["volume", "bz", "by", "bx", "z0", "y0", "x0", "dz", "dy", "dx", "values"])

    fit = files.join(validate(files).where("ok").select("name"), "name")
    return fit.select("stem", "content").mapInPandas(run, "volume string, bz int, by int, bx int, z0 int, y0 int, x0 int, dz int, dy int, dx int, values array<double>")


def pending(wanted: DataFrame, finished: DataFrame, key: str = "name") -> DataFrame:
    """What is wanted and not finished yet."""
    return wanted.join(finished.select(key), key, "left_anti")


def make_stem(name: str, z: int, y: int, x: int) -> str:
    return f"{name}_x{x}_y{y}_z{z}"


def parse_stem(stem: str) -> tuple[str, int, int, int] | None:
    m = re.fullmatch(r"(.*)_x(\d+)_y(\d+)_z(\d+)", stem)
    return None if m is None else (m[1], int(m[4]), int(m[3]), int(m[2]))

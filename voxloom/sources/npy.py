"""A data source of bricks in .npy files, whatever their size.

The driver reads each file's header, some hundred bytes; shape, element type and
offset say where every voxel lies. A partition is some bricks' worth of lines, a
slab of bounded size, that its task reads by byte ranges: no task and no row ever
holds a file.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from voxloom.sources.bricks import SIZE

PART_BYTES = 32 << 20
HEADER_BYTES = 1 << 16
COLUMNS = ("volume", "bz", "by", "bx", "z0", "y0", "x0", "dz", "dy", "dx", "values")
SCHEMA = "volume string, bz int, by int, bx int, z0 int, y0 int, x0 int, dz int, dy int, dx int, values array<double>"


@dataclass(frozen=True)
class Layout:
    """Where the voxels of a file lie: ``shape`` is that of three axes as stored,
    the slowest first; ``turned`` if that is x, y, z (Fortran order)."""

    offset: int
    kind: str
    shape: tuple[int, int, int]
    turned: bool


def layout(head: bytes) -> Layout:
    """From the first bytes of an .npy file. A single leading channel is passed over;
    anything but three axes of numbers is an error."""
    f = io.BytesIO(head)
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, kind = read(f)
    if len(shape) == 4 and shape[0] == 1:
        shape = shape[1:]
    if len(shape) != 3 or kind.hasobject:
        raise ValueError(f"not a volume: {len(shape)} axes of {kind}")
    return Layout(f.tell(), kind.str, tuple(shape[::-1] if fortran else shape), fortran)


@dataclass
class Slab(InputPartition):
    """Lines [low, high) of the middle axis in sections [first, last) of the slowest."""

    uri: str
    volume: str
    at: Layout
    first: int
    last: int
    low: int
    high: int


def slabs(uri: str, volume: str, at: Layout, size=SIZE, part_bytes: int = PART_BYTES) -> list[Slab]:
    """The slabs of a file: as many rows of bricks as ``part_bytes`` hold, one at least."""
    slow, middle = size[::-1][:2] if at.turned else size[:2]
    row = slow * middle * at.shape[2] * np.dtype(at.kind).itemsize
    step = middle * max(1, part_bytes // max(1, row))
    return [Slab(uri, volume, at, k, min(k + slow, at.shape[0]), j, min(j + step, at.shape[1])) for k in range(0, at.shape[0], slow) for j in range(0, at.shape[1], step)]


def read_slab(source, slab: Slab) -> np.ndarray:
    """The slab's voxels, as stored, by one range a section."""
    at, kind = slab.at, np.dtype(slab.at.kind)
    line = at.shape[2] * kind.itemsize
    out = np.empty((slab.last - slab.first, slab.high - slab.low, at.shape[2]), kind)
    for k in range(slab.first, slab.last):
        raw = source.read_at((slab.high - slab.low) * line, at.offset + (k * at.shape[1] + slab.low) * line)
        if len(raw) < out[0].nbytes:
            raise ValueError(f"{slab.uri} ends before its last voxel")
        out[k - slab.first] = np.frombuffer(raw, kind).reshape(out.shape[1:])
    return out


def bricks_of(slab: Slab, voxels: np.ndarray, size=SIZE) -> Iterator[tuple]:
    """The bricks of a slab's voxels, as rows of COLUMNS."""
    start = (slab.first, slab.low, 0)
    if slab.at.turned:
        voxels, start = voxels.transpose(2, 1, 0), start[::-1]
    for z in range(0, voxels.shape[0], size[0]):
        for y in range(0, voxels.shape[1], size[1]):
            for x in range(0, voxels.shape[2], size[2]):
                c = voxels[z : z + size[0], y : y + size[1], x : x + size[2]]
                corner = [a + s for a, s in zip((z, y, x), start, strict=True)]
                yield (slab.volume, *(a // w for a, w in zip(corner, size, strict=True)), *corner, *c.shape, np.ascontiguousarray(c, float).ravel())


class NpyReader(DataSourceReader):
    def __init__(self, options):
        self.files = json.loads(options["files"])
        self.size = tuple(json.loads(options.get("size", json.dumps(SIZE))))
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))

    def partitions(self) -> list[Slab]:
        def one(file):
            uri, volume = file
            store, path = fs.FileSystem.from_uri(uri)
            with store.open_input_file(path) as f:
                return slabs(uri, volume, layout(f.read(HEADER_BYTES)), self.size, self.part_bytes)

        with ThreadPoolExecutor(16) as pool:
            return [s for some in pool.map(one, self.files) for s in some]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(partition.uri)
        with store.open_input_file(path) as f:
            voxels = read_slab(f, partition)
        kinds = [pa.string(), *[pa.int32()] * 9, pa.list_(pa.float64())]
        rows: list[tuple] = []
        held = 0
        for row in bricks_of(partition, voxels, self.size):
            rows.append(row)
            held += len(row[-1])
            if held >= 1 << 20:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(COLUMNS))
                rows, held = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(COLUMNS))


class NpyBricks(DataSource):
    """``spark.read.format("npy_bricks")`` with options files (JSON: pairs of address
    and volume name), size and part_bytes."""

    @classmethod
    def name(cls) -> str:
        return "npy_bricks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options)


def read_volumes(spark: SparkSession, files: list[tuple[str, str]], size=SIZE, part_bytes: int = PART_BYTES) -> DataFrame:
    """Bricks, as ``bricks.ingest`` makes them of whole files, of .npy files (address,
    volume name) of any size; addresses are what pyarrow can open. Their names are
    the driver's, as the paths of any reader are."""
    spark.dataSource.register(NpyBricks)
    return spark.read.format("npy_bricks").option("files", json.dumps(files)).option("size", json.dumps(list(size))).option("part_bytes", part_bytes).load()


def read_box(spark: SparkSession, uri: str, volume: str, start, size, brick=SIZE, part_bytes: int = PART_BYTES) -> DataFrame:
    """The bricks of one file that a box touches, by ranges of the slabs that do."""
    spark.dataSource.register(NpyBoxes)
    options = {"files": json.dumps([(uri, volume)]), "size": json.dumps(list(brick)), "part_bytes": part_bytes, "start": json.dumps(list(start)), "extent": json.dumps(list(size))}
    return spark.read.format("npy_box").options(**options).load()


class NpyBoxReader(NpyReader):
    def __init__(self, options):
        super().__init__(options)
        self.start, self.extent = json.loads(options["start"]), json.loads(options["extent"])

    def partitions(self) -> list[Slab]:
        def touches(s: Slab) -> bool:
            slow, middle = (2, 1) if s.at.turned else (0, 1)
            return self.start[slow] < s.last and s.first < self.start[slow] + self.extent[slow] and self.start[middle] < s.high and s.low < self.start[middle] + self.extent[middle]

        # no slab is no partition, which would be read as a whole
        return [s for s in super().partitions() if touches(s)] or [Slab("", "", Layout(0, "<f8", (0, 0, 0), False), 0, 0, 0, 0)]

    def read(self, partition: Slab) -> Iterator[tuple]:
        if not partition.uri:
            return
        store, path = fs.FileSystem.from_uri(partition.uri)
        with store.open_input_file(path) as f:
            voxels = read_slab(f, partition)
        for row in bricks_of(partition, voxels, self.size):
            if all(a < c + n and c < a + w for a, w, c, n in zip(self.start, self.extent, row[4:7], row[7:10], strict=True)):
                yield (*row[:-1], row[-1].tolist())


class NpyBoxes(NpyBricks):
    @classmethod
    def name(cls) -> str:
        return "npy_box"

    def reader(self, schema) -> NpyBoxReader:
        return NpyBoxReader(self.options)

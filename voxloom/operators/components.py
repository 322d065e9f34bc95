"""Connected components of labels, exact distances, label growth and filters.

Components are found inside bricks and joined over the bricks' faces; distances
and filters go over pencils, all bricks along one axis, whose lines are arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators.graph import broadcast_if_small, components, cut, least_members, ranked_by_ranges
from voxloom.operators.voxels import AXES
from voxloom.sources.bricks import KINDS, Halo, in_small_batches, over_halos, to_bricks, to_voxels

KEYS = ["volume", *AXES]
SIZE = (8, 32, 32)
BRICK = ["volume", "bz", "by", "bx"]
BOX = [*BRICK, "z0", "y0", "x0", "dz", "dy", "dx"]
BOX_SCHEMA = "volume string, " + ", ".join(f"{c} int" for c in BOX[1:])
BITS = 21  # of a coordinate in the number of a voxel


def _half_steps(connectivity: int) -> list[tuple[int, int, int]]:
    """One of each two opposite steps to a neighbour."""
    return [s for s in product((-1, 0, 1), repeat=3) if s > (0, 0, 0) and sum(map(abs, s)) <= connectivity]


def _both_ends(shape, step) -> tuple[tuple, tuple]:
    """The voxels of an array that have a neighbour at ``step`` in it, and those."""
    here = tuple(slice(max(0, -d), n - max(0, d)) for n, d in zip(shape, step, strict=True))
    return here, tuple(slice(max(0, d), n - max(0, -d)) for n, d in zip(shape, step, strict=True))


def brick_components(bricks: DataFrame, label: str = "label", connectivity: int = 1) -> DataFrame:
    """``bricks`` with part (array<bigint>): 0 on background, else the number of the
    first voxel, in raster order, of the voxel's component inside its brick."""

    def run(batches):
        for b in batches:
            parts = []
            for r in b.itertuples(index=False):
                shape = (r.dz, r.dy, r.dx)
                a = np.asarray(getattr(r, label), np.int64).reshape(shape)
                at = np.arange(a.size).reshape(shape)
                pairs = []
                for step in _half_steps(connectivity):
                    here, there = _both_ends(shape, step)
                    same = (a[here] == a[there]) & (a[here] > 0)
                    pairs.append((at[here][same], at[there][same]))
                roots = least_members(a.size, *(np.concatenate(x) for x in zip(*pairs, strict=True)))
                z, y, x = (np.arange(s, s + d, dtype=np.int64) for s, d in zip((r.z0, r.y0, r.x0), shape, strict=True))
                number = ((z[:, None, None] << (2 * BITS)) + (y[:, None] << BITS) + x + 1).ravel()
                parts.append(np.where(a.ravel() > 0, number[roots], 0))
            yield b[[*BOX, label]].assign(part=parts)

    return in_small_batches(bricks).select(*BOX, label).mapInPandas(run, f"{BOX_SCHEMA}, {label} array<bigint>, part array<bigint>")


def connected_components(voxels: DataFrame, label: str = "label", connectivity: int = 1, size=SIZE) -> DataFrame:
    """``voxels`` with component (bigint): 0 on background, else the 1-based
    number, by first voxel in raster order, of the set of neighbours with the same
    label. Neighbours differ in ``connectivity`` coordinates at most (1: faces,
    2: edges too, 3: corners too), by one each.

    Bricks find their own components; only pairs of these that touch over a face go
    into the graph that joins them. A brick's voxels must fill it.
    """
    rest = [c for c in voxels.columns if c not in KEYS]
    bricks = cut(to_bricks(voxels.withColumn(label, F.col(label).cast("bigint")), size, rest))
    own = cut(brick_components(bricks, label, connectivity))

    def faces(h: Halo) -> dict:
        labels, parts = h.own(label), h.own("part")
        found = [np.empty((0, 2), np.int64)]
        for step in _half_steps(connectivity):
            inside = np.ones(h.size, bool)
            for x, d, n in zip(h.axes(), step, h.extent, strict=True):
                inside = inside & (x + d >= 0) & (x + d < n)
            there = h.at("part", step)
            touch = inside & (labels > 0) & (h.at(label, step) == labels) & (there != parts)
            found.append(np.stack([parts[touch], there[touch]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return {"volume": [h.volume] * len(pairs), "a": pairs[:, 0], "b": pairs[:, 1]}

    ident = lambda c: F.xxhash64("volume", c)
    touching = over_halos(own, [label, "part"], (1, 1, 1), faces, "volume string, a bigint, b bigint", size)
    joined = components(touching.select(ident("a").alias("a"), ident("b").alias("b")))
    parts = own.select(*BRICK, F.explode(F.array_distinct("part")).alias("part")).where("part > 0").withColumn("node", ident("part"))
    parts = cut(parts.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node"))
    first = parts.groupBy("volume", "root").agg(F.min("part").alias("first"))
    numbers = broadcast_if_small(cut(ranked_by_ranges(first, ["volume"], [F.asc("first")]).select("root", F.col("rank").alias("component"))))
    named = parts.join(numbers, "root").groupBy(*BRICK).agg(F.sort_array(F.collect_list(F.struct("part", "component"))).alias("names"))
    named = named.select(*BRICK, F.col("names.part").alias("parts"), F.col("names.component").alias("numbers"))

    @F.pandas_udf("array<bigint>")
    def renamed(part: pd.Series, parts: pd.Series, numbers: pd.Series) -> pd.Series:
        out = []
        for p, old, new in zip(part, parts, numbers, strict=True):
            p = np.asarray(p, np.int64)
            old, new = (np.append(0, np.asarray([] if x is None else x, np.int64)) for x in (old, new))
            out.append(new[np.searchsorted(old, p)])
        return pd.Series(out)

    numbered = own.select(*BRICK, "part").join(named, BRICK, "left").select(*BRICK, renamed("part", "parts", "numbers").alias("component"))
    out = to_voxels(bricks.join(numbered, BRICK), [*rest, "component"])
    return out.select(*voxels.columns, "component")


def labelled(voxels: DataFrame, least: int, label: str = "label", connectivity: int = 1, renumber: bool = False) -> DataFrame:
    """``connected_components`` without those of fewer than ``least`` voxels, which
    become 0; the others keep their numbers or, with ``renumber``, are counted anew."""
    kept = min_size(connected_components(voxels, label, connectivity), least)
    if not renumber:
        return kept
    ids = kept.where("component > 0").select("volume", "component").distinct()
    new = broadcast_if_small(cut(ranked_by_ranges(ids, ["volume"], [F.asc("component")])))
    return kept.join(new, ["volume", "component"], "left").withColumn("component", F.coalesce("rank", F.lit(0)).cast("bigint")).select(*kept.columns)


def min_size(voxels: DataFrame, n: int, column: str = "component") -> DataFrame:
    """Ids of fewer than n voxels in their volume become 0; others keep theirs."""
    large = voxels.where(F.col(column) > 0).groupBy("volume", column).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).withColumn("_keep", F.lit(True)).drop("_n")
    return voxels.join(large, ["volume", column], "left").withColumn(column, F.when(F.col("_keep"), F.col(column)).otherwise(F.lit(0).cast("bigint"))).drop("_keep")


def over_pencils(bricks: DataFrame, axis: str, columns: list[str], fn: Callable) -> DataFrame:
    """Apply ``fn`` to the lines along an axis: it gets the columns as arrays (lines,
    places) and returns as many of that shape. A task holds one pencil, the bricks
    that follow each other along the axis; its lines are whole."""
    k = AXES.index(axis)
    kinds = dict(bricks.dtypes)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(f"{axis}0")
        shapes = b[["dz", "dy", "dx"]].to_numpy()
        arrays = [np.concatenate([np.asarray(v, KINDS[kinds[c]]).reshape(n) for v, n in zip(b[c], shapes, strict=True)], axis=k) for c in columns]
        lines = [np.moveaxis(a, k, 2) for a in arrays]
        found = fn(*(a.reshape(-1, a.shape[2]) for a in lines))
        cuts = np.cumsum(shapes[:, k])[:-1]
        for c, f, a in zip(columns, found, lines, strict=True):
            b[c] = [x.ravel() for x in np.split(np.moveaxis(f.reshape(a.shape), 2, k), cuts, axis=k)]
        return b[[*BOX, *columns]]

    schema = f"{BOX_SCHEMA}, {', '.join(f'{c} {kinds[c]}' for c in columns)}"
    return bricks.select(*BOX, *columns).groupBy("volume", *(f"b{a}" for a in AXES if a != axis)).applyInPandas(run, schema)


def lower_envelope(f: np.ndarray, ids: np.ndarray, spacing: float, slack: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Along each row, min over j of f[j] + ((i - j) spacing)^2, and the least id
    among the best. Places of infinite f are no candidates.

    All rows go forward together: each keeps the parabolas that are lowest
    somewhere on a stack, with where each begins, so the work is linear in a
    row's length. Parabolas that only meet the others' minimum, within ``slack``
    places, stay on it, so that ties are told by id from exact values.
    """
    m, n = f.shape
    g = f / spacing**2 + np.arange(n, dtype=float) ** 2
    v, begin, top = np.zeros((m, n), np.int32), np.full((m, n + 1), np.inf), np.full(m, -1)
    for q in range(n):
        rows = np.flatnonzero(np.isfinite(f[:, q]))
        while len(rows):
            t = np.maximum(top[rows], 0)
            r, bare = v[rows, t], top[rows] < 0
            from_ = np.where(bare, -np.inf, (g[rows, q] - np.where(bare, 0, g[rows, r])) / (2 * np.maximum(q - r, 1)))
            pop = ~bare & (from_ < begin[rows, t] - slack)
            put = rows[~pop]
            top[put] += 1
            v[put, top[put]], begin[put, top[put]] = q, from_[~pop]
            rows = rows[pop]
            top[rows] -= 1
    best, who = np.full((m, n), np.inf), np.zeros((m, n), np.int64)
    some, at = np.flatnonzero(top >= 0), np.zeros(m, np.int64)
    for i in range(n):
        rows = some
        while len(rows):
            further = (at[rows] < top[rows]) & (begin[rows, at[rows] + 1] < i - slack)
            rows = rows[further]
            at[rows] += 1
        rows, c = some, at[some]
        while len(rows):
            j = v[rows, c]
            d, own = f[rows, j] + ((i - j) * spacing) ** 2, ids[rows, j]
            better = (d < best[rows, i]) | ((d == best[rows, i]) & (own < who[rows, i]))
            best[rows[better], i], who[rows[better], i] = d[better], own[better]
            more = (c < top[rows]) & (begin[rows, c + 1] <= i + slack)
            rows, c = rows[more], c[more] + 1
    return best, who


def nearest_sources(voxels: DataFrame, source: str, ident: str, sampling=(1.0, 1.0, 1.0), size=SIZE) -> DataFrame:
    """(volume, z, y, x, d2, nearest): squared distance to the nearest voxel where
    ``source`` holds and that voxel's ``ident``, the least of those as near; d2 is
    infinite where a volume has none. Three passes over pencils, exact."""
    v = voxels.select(*KEYS, F.when(F.col(source), F.lit(0.0)).otherwise(F.lit(float("inf"))).alias("d2"), F.col(ident).cast("bigint").alias("nearest"))
    b = to_bricks(v, size, ("d2", "nearest"))
    for axis, spacing in zip(("x", "y", "z"), tuple(sampling)[::-1], strict=True):
        b = over_pencils(b, axis, ["d2", "nearest"], lambda d2, ids, spacing=float(spacing): lower_envelope(d2, ids, spacing))
    return to_voxels(b, ("d2", "nearest"))


def nearest_in_array(d2: np.ndarray, ids: np.ndarray, sampling=(1.0, 1.0, 1.0)) -> tuple[np.ndarray, np.ndarray]:
    """As ``nearest_sources``, of a volume that is one array: d2 is 0 at sources and
    infinite elsewhere."""
    for k in (2, 1, 0):
        f, who = (np.moveaxis(a, k, 2) for a in (d2, ids))
        found = lower_envelope(f.reshape(-1, f.shape[2]), who.reshape(-1, f.shape[2]), float(sampling[k]))
        d2, ids = (np.moveaxis(a.reshape(f.shape), 2, k) for a in found)
    return d2, ids


def distance_transform(voxels: DataFrame, mask: str = "label", sampling=(1.0, 1.0, 1.0)) -> DataFrame:
    """(volume, z, y, x, distance): Euclidean distance to the nearest voxel where
    ``mask`` is 0, with voxel sizes (z, y, x)."""
    v = voxels.withColumn("_source", F.col(mask) == 0).withColumn("_id", F.lit(0))
    return nearest_sources(v, "_source", "_id", sampling).select(*KEYS, F.sqrt("d2").alias("distance"))


def grow_labels(voxels: DataFrame, max_distance: float = 0.0, label: str = "label", sampling=(1.0, 1.0, 1.0)) -> DataFrame:
    """(volume, z, y, x, grown): background takes the nearest label, the least id
    of those as near; beyond ``max_distance`` (over 0) it stays background."""
    v = voxels.withColumn("_source", F.col(label) > 0)
    near = nearest_sources(v, "_source", label, sampling)
    far = (F.sqrt("d2") > max_distance) if max_distance > 0 else F.lit(False)
    grown = F.when((F.col("d2") == float("inf")) | far, F.lit(0).cast("bigint")).otherwise(F.col("nearest"))
    return near.select(*KEYS, grown.alias("grown"))


def gaussian_filter(voxels: DataFrame, sigma: float, value: str = "intensity", truncate: float = 4.0) -> DataFrame:
    """(volume, z, y, x, value) smoothed along each axis; edges reflect, the edge
    voxel included."""
    r = int(truncate * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    kernel /= kernel.sum()

    def smooth(lines: np.ndarray) -> list[np.ndarray]:
        padded = np.pad(lines, ((0, 0), (r, r)), mode="symmetric")
        return [sum(w * padded[:, k : k + lines.shape[1]] for k, w in enumerate(kernel.tolist()))]

    b = to_bricks(voxels.select(*KEYS, F.col(value).cast("double").alias(value)), SIZE, (value,))
    for axis in AXES:
        b = over_pencils(b, axis, [value], smooth)
    return to_voxels(b, (value,))


def binary_structure(rank: int, connectivity: int) -> list[tuple[int, ...]]:
    """Offsets of the neighbourhood with at most ``connectivity`` steps."""
    cells = [()]
    for _ in range(rank):
        cells = [(*c, d) for c in cells for d in (-1, 0, 1)]
    return [c for c in cells if sum(map(abs, c)) <= connectivity]

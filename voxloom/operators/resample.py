"""Resampling, pooling and degradation of voxel grids.

A source voxel is sent to the target voxels that it weighs in, axis by axis,
and targets are summed: no join, one aggregation with partial sums. Sizes may
differ by volume.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators.graph import cut, small_and_large
from voxloom.operators.sampling import DRAW_BITS, draw, draw_bits, draw_int
from voxloom.operators.voxels import AXES, extents, minmax_norm, nearest_surviving
from voxloom.sources.bricks import KINDS, cut_at_borders, in_small_batches, to_voxels

KEYS = ["volume", *AXES]


def spread(voxels: DataFrame, a: str, kind: str) -> DataFrame:
    """``voxels`` once for each target that coordinate ``a`` weighs in, on an axis
    of d<a> voxels that becomes one of t<a>: ``a`` is then the target's
    coordinate, and _t the weight. ``linear`` has half-pixel centres, ``nearest``
    takes floor(i * in / out), ``pool`` averages the source voxels of
    floor(i * in / out) to ceil((i + 1) * in / out). Weights are plain columns
    of an exploded range, which stay within generated code."""
    n, m = f"d{a}", f"t{a}"
    if kind == "linear":
        lo = f"CASE WHEN {a} = 0 THEN 0 ELSE greatest(0, CAST(floor(({a} - 0.5D) * {m} / {n} - 0.5D) AS INT)) END"
        hi = f"CASE WHEN {a} = {n} - 1 THEN {m} - 1 ELSE least({m} - 1, CAST(ceil(({a} + 1.5D) * {m} / {n} - 0.5D) AS INT)) END"
        c = f"greatest(0D, (_i + 0.5D) * {n} / {m} - 0.5D)"
        w = f"IF(CAST(floor({c}) AS INT) = {a}, 1 - ({c} - floor({c})), 0D) + IF(least(CAST(floor({c}) AS INT) + 1, {n} - 1) = {a}, {c} - floor({c}), 0D)"
    else:
        lo, hi = f"greatest(0, {a} * {m} div {n} - 1)", f"least({m} - 1, ({a} + 1) * {m} div {n} + 1)"
        first, last = f"(_i * {n} div {m})", f"(((_i + 1) * {n} + {m} - 1) div {m})"
        w = f"IF({first} = {a}, 1D, 0D)" if kind == "nearest" else f"IF({a} >= {first} AND {a} < {last}, 1D / ({last} - {first}), 0D)"
    each = voxels.withColumn("_i", F.explode(F.expr(f"sequence(CAST({lo} AS INT), CAST({hi} AS INT))")))
    return each.withColumn("_t", F.expr(w)).where("_t > 0").withColumn(a, F.col("_i")).drop("_i")


def resample(voxels: DataFrame, sizes: dict[str, Column], value: str, kind: str = "linear", axes=AXES, catalog: DataFrame | None = None) -> DataFrame:
    """(volume, z, y, x, value) on grids whose axes have the sizes given, as
    expressions over the catalog's dz, dy, dx, and other columns of ``catalog``
    (volume, ...) if given; other axes stay as they are. Labels are resampled with
    ``nearest`` and keep their type."""
    grid = extents(voxels).drop("n_voxels")
    grid = (grid if catalog is None else grid.join(catalog, "volume")).withColumns({f"t{a}": sizes[a].cast("int") for a in axes})
    # the grid, one row a volume, is hashed: by its estimate the side with voxels may look small enough to be broadcast
    v = voxels.select(*KEYS, value).join(grid.hint("shuffle_hash"), "volume").withColumn("_w", F.lit(1.0))
    for a in axes:
        v = spread(v, a, kind).withColumn("_w", F.col("_w") * F.col("_t"))
    total = F.max(value) if kind == "nearest" else F.sum(F.col(value) * F.col("_w"))
    return v.groupBy(*KEYS).agg(total.alias(value))


def targets_of(start: int, end: int, n: int, m: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(target, source, weight), by target, of what source voxels ``start`` to ``end`` - 1 of
    an axis of ``n`` voxels weigh in its ``m`` targets, as ``spread`` says it; no weight is 0."""
    if kind == "linear":
        lo = 0 if start == 0 else max(0, math.floor((start - 0.5) * m / n - 0.5))
        hi = m - 1 if end == n else min(m - 1, math.ceil((end + 0.5) * m / n - 0.5))
        t = np.arange(lo, hi + 1)
        c = np.maximum(0.0, (t + 0.5) * n / m - 0.5)
        j = np.floor(c).astype(np.int64)
        t, w, j = np.concatenate([t, t]), np.concatenate([1 - (c - j), c - j]), np.concatenate([j, np.minimum(j + 1, n - 1)])
    else:
        t = np.arange(max(0, start * m // n - 1), min(m - 1, end * m // n + 1) + 1)
        first, last = t * n // m, -(-(t + 1) * n // m)
        last = first + 1 if kind == "nearest" else last
        each = last - first
        j = np.repeat(first, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        t, w = np.repeat(t, each), np.repeat(1 / each, each)
    own = (w > 0) & (j >= start) & (j < end)
    order = np.argsort(t[own], kind="stable")
    return t[own][order], j[own][order], w[own][order]


def resample_bricks(bricks: DataFrame, sizes: dict[str, Column], value: str, kind: str = "linear", axes=AXES, size=(8, 64, 64)) -> DataFrame:
    """As ``resample``, of bricks: a brick weighs its array's voxels axis by axis, cuts
    what it gives at the borders of the targets' bricks (of ``size``), and these sum up
    the pieces that they get. No row a voxel is made before targets are whole."""
    grid = bricks.groupBy("volume").agg(*(F.max(F.col(f"{a}0") + F.col(f"d{a}")).alias(f"n{a}") for a in AXES))
    named = grid.select("volume", *(F.col(f"n{a}").alias(f"d{a}") for a in AXES)).withColumns({f"t{a}": sizes[a].cast("int") if a in axes else F.col(f"d{a}") for a in AXES})
    grid = named.select(F.col("volume").alias("_volume"), *(F.col(f"d{a}").alias(f"n{a}") for a in AXES), *(f"t{a}" for a in AXES))
    spark_kind = dict(bricks.dtypes)[value]
    held, whole = KINDS[spark_kind], kind == "nearest"
    box = ("z0", "y0", "x0", "dz", "dy", "dx")
    numbers = ("bz", "by", "bx")
    summed = held if whole else "<f8"

    def weigh(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                a, at = np.asarray(getattr(r, value), held).reshape(r.dz, r.dy, r.dx), []
                for k, (s, d, n, m) in enumerate(((r.z0, r.dz, r.nz, r.tz), (r.y0, r.dy, r.ny, r.ty), (r.x0, r.dx, r.nx, r.tx))):
                    t, j, w = targets_of(s, s + d, n, m, kind)
                    if not len(t):
                        break
                    a = np.take(a, j - s, axis=k)
                    if not whole:
                        a = np.add.reduceat(a * w.reshape([-1 if i == k else 1 for i in range(3)]), np.flatnonzero(np.diff(t, prepend=-1)), axis=k)
                    at.append(int(t[0]))
                else:
                    rows += [(r.volume, *to, *low, *shape, x["v"]) for to, low, shape, x in cut_at_borders(at, {"v": a.astype(summed)}, size)]
            yield pd.DataFrame(rows, columns=["volume", *numbers, *box, "data"])

    def add(batches):
        # as Arrow, since pandas would make nulls of what is not a number
        for b in batches:
            rows = []
            for r in b.to_pylist():
                low = [min(p[c] for p in r["parts"]) for c in box[:3]]
                shape = [max(p[c] + p[f"d{c[0]}"] for p in r["parts"]) - q for c, q in zip(box[:3], low, strict=True)]
                out = np.zeros(shape, summed)
                for p in r["parts"]:
                    out[tuple(slice(p[c] - q, p[c] - q + p[f"d{c[0]}"]) for c, q in zip(box[:3], low, strict=True))] += np.frombuffer(p["data"], summed).reshape(p["dz"], p["dy"], p["dx"])
                rows.append((r["volume"], *low, *shape, out.ravel()))
            if rows:
                volumes, *boxes, arrays = zip(*rows, strict=True)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
                held_by = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays)))
                yield pa.RecordBatch.from_arrays([pa.array(volumes, pa.string()), *(pa.array(x, pa.int32()) for x in boxes), held_by], ["volume", *box, value])

    ints = lambda names: ", ".join(f"{c} int" for c in names)
    kept = in_small_batches(bricks).select("volume", *box, value)
    sized = kept.join(grid, kept["volume"].eqNullSafe(grid["_volume"])).drop("_volume")
    pieces = sized.mapInPandas(weigh, f"volume string, {ints(numbers)}, {ints(box)}, data binary")
    targets = pieces.groupBy("volume", *numbers).agg(F.collect_list(F.struct(*box, "data")).alias("parts"))
    return to_voxels(targets.select("volume", "parts").mapInArrow(add, f"volume string, {ints(box)}, {value} {spark_kind if whole else 'array<double>'}"), (value,))


def zoom_crop_pad(voxels: DataFrame, zoom: dict[str, float], value: str, kind: str, fill=0) -> DataFrame:
    """Zoomed by a factor per axis, then cut at the centre, or padded around it
    with ``fill``, to the size it had."""
    sizes = {a: F.greatest(F.lit(1), F.bround(F.col(f"d{a}") * zoom[a], 0)) for a in AXES}
    z = resample(voxels, sizes, value, kind)
    return center_fit(z, extents(voxels), value, fill)


def zoom_plan(samples: DataFrame, low: tuple, high: tuple, seed: int, mode: str = "ratio", prob: float = 1.0) -> DataFrame:
    """``samples`` (volume, sample, res_z, res_y, res_x: the native voxel size, ...) with
    zoomed, target_z, target_y, target_x and zoom_z, zoom_y, zoom_x (native over
    target; native and 1 where a sample is not zoomed), drawn by volume and sample.

    ``ratio`` draws one target for y within ``low`` and ``high``, evenly, and keeps the
    native ratios of the axes as far as their own bounds let it. ``union`` draws z and,
    for y and x together, another, both log-uniform; isotropic samples stay as they are.
    """
    u = lambda k: draw(seed, "volume", "sample", F.lit(k))
    native = {a: F.col(f"res_{a}").cast("double") for a in AXES}
    bounds = {a: (float(x), float(y)) for a, x, y in zip(AXES, low, high, strict=True)}
    zoomed = u("zoomed") < prob
    if mode == "union":
        zoomed = zoomed & ~((native["z"] == native["y"]) & (native["y"] == native["x"]))
        log_uniform = lambda a: F.exp(u(a) * math.log(bounds[a][1] / bounds[a][0]) + math.log(bounds[a][0]))
        target = {"z": log_uniform("z"), "y": log_uniform("y"), "x": log_uniform("y")}
    elif mode == "ratio":
        of_y = u("y") * (bounds["y"][1] - bounds["y"][0]) + bounds["y"][0]
        target = {a: F.least(F.lit(bounds[a][1]), F.greatest(F.lit(bounds[a][0]), of_y * (native[a] / native["y"]))) for a in AXES}
    else:
        raise ValueError(f"mode is ratio or union, not {mode!r}")
    out = samples.withColumn("zoomed", zoomed).withColumns({f"target_{a}": F.when(F.col("zoomed"), target[a]).otherwise(native[a]) for a in AXES})
    return out.withColumns({f"zoom_{a}": native[a] / F.col(f"target_{a}") for a in AXES})


def zoom_by_plan(voxels: DataFrame, plan: DataFrame, value: str, kind: str, fill=0) -> DataFrame:
    """(volume, sample, z, y, x, value): every volume once for each of its samples in
    ``plan``, zoomed as that says, then cut at the centre, or padded, to the size it had."""
    p = plan.select("volume", "sample", *(f"zoom_{a}" for a in AXES))
    name = F.concat_ws("#", "sample", "volume")
    v = voxels.select(*KEYS, value).join(p, "volume").select(name.alias("volume"), *AXES, value)
    sizes = {a: F.greatest(F.lit(1), F.bround(F.col(f"d{a}") * F.col(f"zoom_{a}"), 0)) for a in AXES}
    zoomed = resample(v, sizes, value, kind, catalog=p.select(name.alias("volume"), *(f"zoom_{a}" for a in AXES)))
    named = p.select("volume", "sample", name.alias("_name"))
    out = center_fit(zoomed, extents(v), value, fill).withColumnRenamed("volume", "_name")
    return out.join(named, "_name").select("volume", "sample", *AXES, value)


def center_fit(voxels: DataFrame, sizes: DataFrame, value: str, fill=0) -> DataFrame:
    """``voxels`` on the dense grids of ``sizes`` (volume, dz, dy, dx), cropped
    at the centre where they are larger and padded where they are smaller. Voxels
    move to their places and meet the grid's there, one row a place; no grid is joined."""
    have = extents(voxels).select("volume", *(F.col(f"d{a}").alias(f"h{a}") for a in AXES))
    grid = sizes.select("volume", "dz", "dy", "dx").join(have, "volume")
    moved = voxels.select(*KEYS, value).join(grid.hint("shuffle_hash"), "volume")
    for a in AXES:
        moved = moved.withColumn(a, F.expr(f"CAST({a} - floor((h{a} - d{a}) / 2D) AS INT)"))
        grid = grid.withColumn(a, F.explode(F.expr(f"sequence(0, d{a} - 1)")))
    moved = moved.where(" AND ".join(f"{a} BETWEEN 0 AND d{a} - 1" for a in AXES))
    places = grid.select(*KEYS, F.lit(None).cast(dict(voxels.dtypes)[value]).alias(value))
    return moved.select(*KEYS, value).unionByName(places).groupBy(*KEYS).agg(F.coalesce(F.max(value), F.lit(fill)).alias(value))


def slab_sizes(zf: float) -> dict[str, Column]:
    return {"z": F.greatest(F.lit(1), F.bround(F.col("dz") / zf, 0))}


def jitter_sections(voxels: DataFrame, sigma: float, seed: int, value: str = "intensity") -> DataFrame:
    """Each section moved by its own shift within +-sigma voxels in y and x, on the
    scale between the outer voxels' centres (a shift of n - 1 is n), bilinear; edges
    reflect, the edge voxel included. A voxel is sent to the targets that it weighs
    in: a reflection brings no place further from a target than it was, so they
    are at most the shift and a step away."""
    v = voxels.select(*KEYS, value).join(extents(voxels).drop("n_voxels").hint("shuffle_hash"), "volume")
    for a, k in (("y", 1), ("x", 2)):
        scale = F.col(f"d{a}") / F.greatest(F.col(f"d{a}") - 1, F.lit(1))
        v = v.withColumn(f"m{a}", (draw(seed, "volume", "z", F.lit(k)) * 2 - 1) * sigma * scale)
    for a in ("y", "x"):
        n, far = f"d{a}", f"(CAST(ceil(abs(m{a})) AS INT) + 1)"
        v = v.withColumn("_i", F.explode(F.expr(f"sequence(greatest(0, {a} - {far}), least({n} - 1, {a} + {far}))")))
        floor, frac = f"floor(_i + m{a})", f"(_i + m{a} - floor(_i + m{a}))"
        at = lambda step: f"IF(pmod({floor} + {step}, 2 * {n}) < {n}, pmod({floor} + {step}, 2 * {n}), 2 * {n} - 1 - pmod({floor} + {step}, 2 * {n}))"  # noqa: B023, E731
        meets = [f"{at(step)} = {a}" for step in (0, 1)]
        weight = f"IF({meets[0]}, 1 - {frac}, 0D) + IF({meets[1]}, {frac}, 0D)"
        v = v.where(F.expr(f"{meets[0]} OR {meets[1]}")).withColumn(f"w{a}", F.expr(weight)).withColumn(a, F.col("_i")).drop("_i")
    return v.groupBy(*KEYS).agg(F.sum(F.col(value) * F.col("wy") * F.col("wx")).alias(value))


def dropped_sections(sections: DataFrame, most: int, seed: int, contiguous: bool = False) -> DataFrame:
    """(volume, z, dropped): 1 to ``most`` sections of each volume, as many as drawn
    and at most all, drawn by hash, or a run of them from a drawn start."""
    s = sections.select("volume", "z").distinct()
    n = F.count("*").over(Window.partitionBy("volume"))
    k = F.least(draw_int(F.lit(most), seed, "volume", F.lit("k")) + 1, n)
    if contiguous:
        start = draw_int(F.greatest(n - k + 1, F.lit(1)), seed, "volume")
        out = (F.col("z") >= start) & (F.col("z") < start + k)
    else:
        out = F.row_number().over(Window.partitionBy("volume").orderBy(draw_bits(seed, "volume", "z"), "z")) <= k
    return s.withColumn("dropped", out)


def drop_sections(voxels: DataFrame, most: int, seed: int, mode: str = "replicate", contiguous: bool = False, value: str = "intensity") -> DataFrame:
    """Sections lost, 1 to ``most`` of a volume: ``blank`` (0), ``mean`` of the volume,
    or ``replicate`` the nearest one left, blank if none is."""
    gone = dropped_sections(voxels, most, seed, contiguous)
    if mode == "replicate":
        at = nearest_surviving(gone).select("volume", F.col("z").alias("_to"), F.coalesce("source_z", "z").alias("z"), F.col("source_z").isNull().alias("_none"))
        # merged: by its estimate the side with voxels may look small enough to be broadcast
        v = voxels.select(*KEYS, value).hint("merge").join(at, ["volume", "z"])
        return v.select("volume", F.col("_to").alias("z"), "y", "x", F.when(F.col("_none"), F.lit(0.0)).otherwise(F.col(value)).alias(value))
    v = voxels.select(*KEYS, value).join(gone, ["volume", "z"])
    if mode == "mean":
        v = v.join(voxels.groupBy("volume").agg(F.avg(value).alias("_m")), "volume")
    return v.select(*KEYS, F.when(F.col("dropped"), F.col("_m") if mode == "mean" else F.lit(0.0)).otherwise(F.col(value)).alias(value))


def section_noise(voxels: DataFrame, most: float, seed: int, value: str = "intensity") -> DataFrame:
    """Normal noise by Box and Muller on hashes, each section with its own
    standard deviation up to ``most``."""
    u1, u2 = F.greatest(draw(seed, *KEYS, F.lit(1)), F.lit(1e-12)), draw(seed, *KEYS, F.lit(2))
    normal = F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)
    return voxels.withColumn(value, F.col(value) + normal * draw(seed, "volume", "z") * most)


def section_gamma(voxels: DataFrame, low: float, high: float, seed: int, value: str = "intensity") -> DataFrame:
    """Values clamped to [0, 1] to a power of each section's own."""
    g = draw(seed, "volume", "z", F.lit(3)) * (high - low) + low
    return voxels.withColumn(value, F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value))), g))


def draws(texts) -> np.ndarray:
    """``sampling.draw_bits`` of texts, the seed and the keys joined by colons."""
    return np.frombuffer(b"".join(b"\0\0" + hashlib.md5(t.encode()).digest()[: DRAW_BITS // 8] for t in texts), ">u8").astype(np.int64)


def normed_array(a: np.ndarray) -> np.ndarray:
    """As ``voxels.minmax_norm``, to which what is not a number is the largest."""
    lo, hi = np.fmin.reduce(a, axis=None), a.max()
    return (a - lo) / (hi - lo) if hi > lo or (np.isnan(hi) and not np.isnan(lo)) else a


def weighed_in_z(a: np.ndarray, m: int, kind: str) -> np.ndarray:
    """``a`` on ``m`` sections, as ``resample`` does it."""
    t, j, w = targets_of(0, len(a), len(a), m, kind)
    return np.add.reduceat(a[j] * w[:, None, None], np.flatnonzero(np.diff(t, prepend=-1)), axis=0)


def degraded_array(volume: str, a: np.ndarray, zf: float, seed: int) -> np.ndarray:
    """What ``degrade_pair`` does, of a whole volume as one array."""
    d = weighed_in_z(a, max(1, round(len(a) / zf)), "pool")
    n, unit, of = len(d), float(1 << DRAW_BITS), f"{seed}:{volume}"
    for k, axis in ((1, 1), (2, 2)):
        w = d.shape[axis]
        shift = (draws(f"{of}:{z}:{k}" for z in range(n)) / unit * 2 - 1) * 0.5 * (w / max(w - 1, 1))
        at = np.arange(w) + shift[:, None]
        low = np.floor(at).astype(np.int64)
        frac = np.expand_dims(at - low, 3 - axis)
        near = [np.expand_dims(np.where((low + step) % (2 * w) < w, (low + step) % (2 * w), 2 * w - 1 - (low + step) % (2 * w)), 3 - axis) for step in (0, 1)]
        d = np.take_along_axis(d, near[0], axis) * (1 - frac) + np.take_along_axis(d, near[1], axis) * frac
    gone = np.argsort(draws(f"{of}:{z}" for z in range(n)), kind="stable")[:1]
    left = np.setdiff1d(np.arange(n), gone)
    if not len(left):
        d = np.zeros_like(d)
    for z in gone[: len(left)]:
        d[z] = d[left[np.argmin(np.abs(left - z))]]  # the first of two as near is the lower
    y, x = (v.ravel().tolist() for v in np.indices(d.shape[1:]))
    for z in range(n):
        u1, u2 = (draws(f"{of}:{z}:{i}:{j}:{k}" for i, j in zip(y, x, strict=True)).reshape(d.shape[1:]) / unit for k in (1, 2))
        std, gamma = draws((f"{of}:{z}", f"{of}:{z}:3")) / unit
        noisy = d[z] + np.sqrt(-2 * np.log(np.maximum(u1, 1e-12))) * np.cos(2 * math.pi * u2) * (std * 0.05)
        d[z] = np.maximum(0.0, np.fmin(1.0, noisy)) ** (gamma * (1.25 - 0.8) + 0.8)
    return weighed_in_z(d, len(a), "linear")


VOLUME_VOXELS = 1_000_000  # of a volume that a task degrades whole
TASK_VOXELS = 1_000_000  # of small volumes that a task degrades, one after the other


def degrade_pair(voxels: DataFrame, zf: float, seed: int, degraded: bool = True, value: str = "intensity", normalize: bool = False) -> DataFrame:
    """(volume, z, y, x, degraded, clean): pooled in z, jittered, a section lost,
    noise, contrast, and back on the grid it had. The clean value is always there.
    With ``normalize``, values are first put between 0 and 1 (``minmax_norm``).

    ``voxels`` may be bricks: of these, volumes of ``VOLUME_VOXELS`` or fewer that have all
    voxels of their box are degraded whole, as arrays; what is left goes a row a voxel."""
    if "bz" not in voxels.columns:
        return _degraded_rows(minmax_norm(voxels, value).withColumn(value, F.col("norm")).drop("norm") if normalize else voxels, zf, seed, degraded, value)
    if not degraded:
        return degrade_pair(to_voxels(voxels, (value,)), zf, seed, False, value, normalize)
    box = ("z0", "y0", "x0", "dz", "dy", "dx")

    def packed(batches):
        for b in batches:
            yield b[["volume", *box]].assign(data=[pa.compress(np.asarray(v, "<f8").tobytes(), codec="zstd", asbytes=True) for v in b[value]])

    def opened(r) -> np.ndarray:
        n = r.dz * r.dy * r.dx
        return np.frombuffer(pa.decompress(r.data, decompressed_size=8 * n, codec="zstd", asbytes=True), "<f8").reshape(r.dz, r.dy, r.dx)

    held = cut(in_small_batches(voxels).where("volume IS NOT NULL").select("volume", *box, F.col(value).cast("array<double>").alias(value)).mapInPandas(packed, f"volume string, {', '.join(f'{c} int' for c in box)}, data binary"), wide=True)
    ends = [F.max(F.col(f"{a}0") + F.col(f"d{a}")).cast("bigint") for a in AXES]
    whole = ends[0] * ends[1] * ends[2]
    # a volume with gaps counts as a large one
    size = F.when(F.sum(F.col("dz").cast("bigint") * F.col("dy") * F.col("dx")) == whole, whole).otherwise(F.lit((1 << 63) - 1))
    fit, large = small_and_large(held, held.groupBy("volume").agg(size.alias("_n")), VOLUME_VOXELS, TASK_VOXELS)

    # as Arrow, since pandas would make nulls of what is not a number
    def run(table: pa.Table) -> pa.Table:
        b = table.to_pandas()
        volume, a = b["volume"].iloc[0], np.empty([int((b[f"{c}0"] + b[f"d{c}"]).max()) for c in AXES])
        for r in b.itertuples(index=False):
            a[r.z0 : r.z0 + r.dz, r.y0 : r.y0 + r.dy, r.x0 : r.x0 + r.dx] = opened(r)
        clean = normed_array(a) if normalize else a
        at = (v.ravel() for v in np.indices(a.shape, np.int32))
        return pa.table([pa.repeat(volume, a.size), *at, clean.ravel(), degraded_array(volume, clean, zf, seed).ravel()], [*KEYS, "clean", "degraded"])

    def rows(batches):
        for b in batches:
            for r in b.to_pandas().itertuples(index=False):
                at = (v.ravel() + np.int32(s) for v, s in zip(np.indices((r.dz, r.dy, r.dx), np.int32), (r.z0, r.y0, r.x0), strict=True))
                a = opened(r).ravel()
                yield pa.RecordBatch.from_arrays([pa.repeat(r.volume, a.size), *map(pa.array, (*at, a))], [*KEYS, "intensity"])

    out = fit.groupBy("volume").applyInArrow(run, "volume string, z int, y int, x int, clean double, degraded double")
    if large is None:
        return out
    return out.unionByName(degrade_pair(large.mapInArrow(rows, "volume string, z int, y int, x int, intensity double"), zf, seed, normalize=normalize))


def _degraded_rows(voxels: DataFrame, zf: float, seed: int, degraded: bool, value: str) -> DataFrame:
    """``degrade_pair`` a row a voxel, for volumes of any size."""
    clean = voxels.select(*KEYS, F.col(value).alias("clean"))
    if not degraded:
        return clean.withColumn("degraded", F.col("clean"))
    d = resample(voxels, slab_sizes(zf), value, "pool", ("z",))
    d = section_gamma(section_noise(drop_sections(jitter_sections(d, 0.5, seed, value), 1, seed, value=value), 0.05, seed, value), 0.8, 1.25, seed, value)
    full = extents(voxels).select("volume", F.col("dz").alias("_dz"))
    n = extents(d).drop("n_voxels").join(full, "volume").withColumn("tz", F.col("_dz"))
    up = spread(d.join(n.hint("shuffle_hash"), "volume"), "z", "linear").groupBy(*KEYS).agg(F.sum(F.col(value) * F.col("_t")).alias("degraded"))
    return clean.hint("merge").join(up, KEYS)  # never a broadcast, whatever the estimate


def dihedral(voxels: DataFrame, seed: int) -> DataFrame:
    """A flip per axis, a quarter turn and a transposition in the plane, drawn
    per volume; turns and transpositions only where dy = dx."""
    v = voxels.join(extents(voxels).drop("n_voxels"), "volume")
    bit = lambda k: draw_int(F.lit(2), seed, "volume", F.lit(k)) == 1
    for k, a in enumerate(AXES):
        v = v.withColumn(f"f{a}", F.when(bit(k), F.col(f"d{a}") - 1 - F.col(a)).otherwise(F.col(a)))
    swap = bit(3) & (F.col("dy") == F.col("dx"))
    others = [c for c in voxels.columns if c not in KEYS]
    return v.select("volume", F.col("fz").alias("z"), F.when(swap, F.col("fx")).otherwise(F.col("fy")).alias("y"), F.when(swap, F.col("fy")).otherwise(F.col("fx")).alias("x"), *others)


def intensity_aug(voxels: DataFrame, seed: int, value: str = "intensity") -> DataFrame:
    """Gamma in [0.7, 1.3] and noise of 0.05, each for half of the volumes."""
    on = lambda k: draw(seed, "volume", F.lit(k)) < 0.5
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value)))
    gamma = F.when(on(1), F.pow(v, draw(seed, "volume", F.lit(2)) * 0.6 + 0.7)).otherwise(F.col(value))
    u1, u2 = F.greatest(draw(seed, *KEYS, F.lit(1)), F.lit(1e-12)), draw(seed, *KEYS, F.lit(2))
    noise = F.when(on(3), F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2) * 0.05).otherwise(0.0)
    return voxels.withColumn(value, gamma + noise)

"""Tiles: overlapping grids, padding, tiled prediction and blending."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators.voxels import AXES
from voxloom.sources.bricks import SIZE, Halo, cut_at_borders, over_halos


def axis_starts(a: str, patch: int, stride: int, coverage: str = "full") -> Column:
    """Starts of tiles along an axis of d<a> voxels. ``full`` adds a last tile
    shifted back to the end; ``strict`` leaves a tail uncovered. An axis shorter
    than the tile has one tile at 0."""
    tiles = f"transform(sequence(0, greatest(0, d{a} - {patch}) div {stride}), k -> CAST(k * {stride} AS INT))"
    if coverage == "full":
        tiles = f"array_distinct(concat({tiles}, array(CAST(greatest(0, d{a} - {patch}) AS INT))))"
    return F.expr(tiles)


def patch_grid(catalog: DataFrame, patch: tuple[int, int, int], stride: tuple[int, int, int] | None = None, overlap: float = 0.0, coverage: str = "full") -> DataFrame:
    """(volume, patch_idx, z0, y0, x0, nz, ny, nx): tiles of each volume of the
    catalog (volume, dz, dy, dx), numbered in row-major order."""
    stride = stride or tuple(max(1, int(p * (1 - overlap))) for p in patch)
    t = catalog.select("volume", *(f"d{a}" for a in AXES), *(axis_starts(a, p, s, coverage).alias(f"s{a}") for a, p, s in zip(AXES, patch, stride, strict=True)))
    for a in AXES:
        t = t.select("*", F.posexplode(f"s{a}").alias(f"k{a}", f"{a}0"))
    index = (F.col("kz") * F.size("sy") + F.col("ky")) * F.size("sx") + F.col("kx")
    return t.select("volume", index.alias("patch_idx"), *(f"{a}0" for a in AXES), *(F.least(F.lit(p), F.col(f"d{a}")).alias(f"n{a}") for a, p in zip(AXES, patch, strict=True)))


def assign(voxels: DataFrame, tiles: DataFrame) -> DataFrame:
    """Each voxel once for every tile that covers it, with its place (pz, py, px)
    in the tile. Tiles list their voxels, so the join is by equality."""
    t = tiles
    for a in AXES:
        t = t.withColumn(f"p{a}", F.explode(F.expr(f"sequence(0, n{a} - 1)"))).withColumn(a, F.col(f"{a}0") + F.col(f"p{a}"))
    return t.select("volume", "patch_idx", *AXES, *(f"p{a}" for a in AXES)).join(voxels, ["volume", *AXES])


def reflect_pad(voxels: DataFrame, catalog: DataFrame, size: tuple[int, int, int], value: str) -> DataFrame:
    """Dense grids of at least ``size``: beyond the end, coordinates reflect. A voxel
    is sent to all places that are reflections of it, so no grid is joined."""
    g = voxels.select("volume", *AXES, value).join(catalog.select("volume", "dz", "dy", "dx").hint("shuffle_hash"), "volume")
    for a, n in zip(AXES, size, strict=True):
        last, period = f"greatest(d{a}, {n}) - 1", f"greatest(2 * d{a} - 2, 1)"
        # places one period apart, and those behind each turn
        ahead = f"sequence({a}, {last}, {period})"
        back = f"IF({a} = 0 OR {a} = d{a} - 1 OR {period} - {a} > {last}, array(), sequence({period} - {a}, greatest({last}, {period} - {a}), {period}))"
        g = g.withColumn(a, F.explode(F.expr(f"concat({ahead}, {back})")))
    return g.select("volume", *AXES, value)


def gaussian_weight(rows: DataFrame, patch: tuple[int, int, int]) -> DataFrame:
    """``rows`` with weight: exp(-r^2 / 2 s^2) around the tile's centre with s an
    eighth of its least side, over the largest such value in a tile. It is a
    function of (pz, py, px), so no table of weights is joined."""
    two_s2 = 2 * (min(patch) * 0.125) ** 2
    r2 = sum((F.col(f"p{a}") - F.lit(p / 2)) * (F.col(f"p{a}") - F.lit(p / 2)) for a, p in zip(AXES, patch, strict=True))
    nearest = sum(min((k - p / 2) ** 2 for k in range(p)) for p in patch)
    return rows.withColumn("weight", F.exp(-(r2 - F.lit(float(nearest))) / F.lit(two_s2)))


def tiled_predict(patches: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a function to batches of whole patches (volume, patch_idx, values
    array); it returns frames of ``schema``."""

    def run(batches):
        for b in batches:
            yield fn(b)

    return patches.mapInPandas(run, schema)


def blend(predictions: DataFrame, how: str = "gaussian", value: str = "pred", eps: float = 1e-8, floor_at_zero: bool = False) -> DataFrame:
    """(volume, z, y, x, value) of overlapping predictions: weighted mean, plain
    mean, or the largest (not under 0 with ``floor_at_zero``)."""
    g = predictions.groupBy("volume", *AXES)
    if how == "max":
        top = F.max(value)
        return g.agg((F.greatest(F.lit(0.0), top) if floor_at_zero else top).alias(value))
    w = F.col("weight") if how == "gaussian" else F.lit(1.0)
    return g.agg((F.sum(F.col(value) * w) / (F.sum(w) + F.lit(eps))).alias(value))


def _starts(extent: int, patch: int, stride: int, coverage: str) -> list[int]:
    """As ``axis_starts`` has them."""
    starts = list(range(0, max(0, extent - patch) + 1, stride))
    return sorted({*starts, max(0, extent - patch)}) if coverage == "full" else starts


def tile_weights(patch: tuple[int, int, int]) -> np.ndarray:
    """``gaussian_weight`` of every place of a tile."""
    axes = np.ix_(*((np.arange(p) - p / 2) ** 2 for p in patch))
    r2 = axes[0] + axes[1] + axes[2]
    return np.exp(-(r2 - r2.min()) / (2 * (min(patch) * 0.125) ** 2))


def _predicted(h: Halo, value: str, model: Callable, patch, stride, coverage: str, batch: int):
    """(patch_idx, corner, prediction) of the tiles that begin in a brick, which the
    model takes as arrays of whole tiles, at most ``batch`` of them at a time."""
    starts = [_starts(n, p, s, coverage) for n, p, s in zip(h.extent, patch, stride, strict=True)]
    here = [[(k, c) for k, c in enumerate(one) if s <= c < s + d] for one, s, d in zip(starts, h.start, h.size, strict=True)]
    tiles = list(product(*here))
    block = h.blocks[value]
    for at in range(0, len(tiles), batch):
        some = tiles[at : at + batch]
        corners = [[c for _, c in t] for t in some]
        stack = np.stack([block[tuple(slice(c - q, c - q + p) for c, q, p in zip(corner, h.low, patch, strict=True))] for corner in corners])
        for t, corner, pred in zip(some, corners, model(stack), strict=True):
            yield (t[0][0] * len(starts[1]) + t[1][0]) * len(starts[2]) + t[2][0], corner, pred


def _behind(patch) -> tuple:
    return tuple((0, p - 1) for p in patch)


TILES = 64


def predict_tiles(bricks: DataFrame, value: str, model: Callable, patch, stride, coverage: str = "full", size=SIZE, batch: int = TILES) -> DataFrame:
    """(volume, patch_idx, z0, y0, x0, nz, ny, nx, pred array<double>) of the tiles
    of ``patch_grid``: each brick has what lies behind it up to a tile's length, and
    the model, from arrays (tiles, nz, ny, nx) to such, is applied to the tiles that
    begin in it. A volume shorter than a tile has shorter ones."""

    def run(h: Halo) -> dict:
        rows = [(k, *corner, *pred.shape, pred.ravel()) for k, corner, pred in _predicted(h, value, model, patch, stride, coverage, batch)]
        cols = list(zip(*rows, strict=True)) or [()] * 8
        return {"volume": [h.volume] * len(rows), **{c: list(v) for c, v in zip(("patch_idx", "z0", "y0", "x0", "nz", "ny", "nx", "pred"), cols, strict=True)}}

    schema = "volume string, patch_idx int, z0 int, y0 int, x0 int, nz int, ny int, nx int, pred array<double>"
    return over_halos(bricks, [value], _behind(patch), run, schema, size)


def predict_blended(bricks: DataFrame, value: str, model: Callable, patch, stride, how: str = "gaussian", coverage: str = "full", size=SIZE, batch: int = TILES, eps: float = 1e-8, floor_at_zero: bool = False) -> DataFrame:
    """Bricks (volume, bz, by, bx, z0, y0, x0, dz, dy, dx, pred array<double>) of the
    blended predictions of overlapping tiles, as ``blend`` has them by voxels.

    The tiles that begin in a brick are added up there, weighed, into sums and
    weights that reach a tile's length beyond it; these are cut at the borders of
    bricks, sent once as arrays, and added up by brick. A voxel that no tile covers
    (``strict`` coverage) is null.
    """

    def run(h: Halo) -> dict:
        shape = [min(n, s + d + p - 1) - s for n, s, d, p in zip(h.extent, h.start, h.size, patch, strict=True)]
        total, weight = np.full(shape, -np.inf if how == "max" else 0.0), np.zeros(shape)
        w = tile_weights(patch) if how == "gaussian" else np.ones(patch)
        for _, corner, pred in _predicted(h, value, model, patch, stride, coverage, batch):
            at = tuple(slice(c - s, c - s + n) for c, s, n in zip(corner, h.start, pred.shape, strict=True))
            own = w[tuple(slice(0, n) for n in pred.shape)]
            total[at] = np.maximum(total[at], pred) if how == "max" else total[at] + pred * own
            weight[at] += own
        rows = [(*t, *low, *n, x["total"], x["weight"]) for t, low, n, x in cut_at_borders(h.start, {"total": total, "weight": weight}, size)]
        names = ("bz", "by", "bx", "z0", "y0", "x0", "dz", "dy", "dx", "total", "weight")
        return {"volume": [h.volume] * len(rows), **{c: list(v) for c, v in zip(names, zip(*rows, strict=True), strict=True)}}

    box = ", ".join(f"{c} int" for c in ("bz", "by", "bx", "z0", "y0", "x0", "dz", "dy", "dx"))
    pieces = over_halos(bricks, [value], _behind(patch), run, f"volume string, {box}, total binary, weight binary", size)

    def add(b: pd.DataFrame) -> pd.DataFrame:
        low = b[["z0", "y0", "x0"]].to_numpy()
        n = b[["dz", "dy", "dx"]].to_numpy()
        first, end = low.min(axis=0), (low + n).max(axis=0)
        total, weight = np.full(end - first, -np.inf if how == "max" else 0.0), np.zeros(end - first)
        for corner, shape, t, w in zip(low, n, b["total"], b["weight"], strict=True):
            at = tuple(slice(c - f, c - f + k) for c, f, k in zip(corner, first, shape, strict=True))
            t = np.frombuffer(t).reshape(shape)
            total[at] = np.maximum(total[at], t) if how == "max" else total[at] + t
            weight[at] += np.frombuffer(w).reshape(shape)
        pred = (np.maximum(total, 0.0) if floor_at_zero else total) if how == "max" else total / (weight + eps)
        pred = [None if u else v for v, u in zip(pred.ravel().tolist(), (weight == 0).ravel().tolist(), strict=True)] if (weight == 0).any() else pred.ravel()
        row = (b["volume"].iloc[0], *(int(b[c].iloc[0]) for c in ("bz", "by", "bx")), *first.tolist(), *(end - first).tolist(), pred)
        return pd.DataFrame([row], columns=["volume", "bz", "by", "bx", "z0", "y0", "x0", "dz", "dy", "dx", "pred"])

    return pieces.groupBy("volume", "bz", "by", "bx").applyInPandas(add, f"volume string, {box}, pred array<double>")


def safe_patch(resolutions: DataFrame, patch: tuple[int, int, int], top: tuple[float, float, float], own: tuple[float, float, float], union: bool = False) -> DataFrame:
    """One row (safe_z, safe_y, safe_x): the size to read so that the worst zoom,
    the finest native resolution over the coarsest target, still fills the patch.
    In ``union`` mode isotropic volumes are not zoomed and do not count."""
    if union:
        resolutions = resolutions.where("NOT (res_z = res_y AND res_y = res_x)")
    out = []
    for a, p, t, r in zip(AXES, patch, top, own, strict=True):
        zoom = F.least(F.lit(float(r)), F.coalesce(F.min(f"res_{a}").cast("double"), F.lit(float(r)))) / F.lit(float(t))
        out.append(F.when(zoom < 1, F.ceil(F.lit(p) / zoom)).otherwise(p).cast("int").alias(f"safe_{a}"))
    return resolutions.agg(*out)

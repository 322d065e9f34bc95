"""Voxel neighbourhoods: shifts, affinities and boundaries.

Axis-aligned steps are windows over lines of voxels; arbitrary offsets are an
equi-join on coordinates, in which each voxel is sent to the places it is read
from. How a shift treats the edge is an argument: clamp, drop or reflect.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators.voxels import AXES, extents

#: offsets (dz, dy, dx); the first three pull, the others push (fixed values)
OFFSETS = [
    (-1, 0, 0), (0, -1, 0), (0, 0, -1),
    (0, -3, 0), (0, 0, -3), (0, -9, 0), (0, 0, -9), (0, -27, 0), (0, 0, -27), (0, -9, -9), (0, 9, -9),
    (-2, 0, 0), (-3, 0, 0), (-4, 0, 0),
]
N_PULL = 3


def offset_rows(offsets=OFFSETS, n_pull: int = N_PULL) -> list[tuple]:
    """(idx, dz, dy, dx, kind, name) of each offset."""
    rows = []
    for k, o in enumerate(offsets):
        kind = "pull" if k < n_pull else "push"
        tag = "".join(f"{a}{d:+d}" for a, d in zip(AXES, o, strict=True) if d) or "self"
        rows.append((k, *o, kind, f"{k + 1:02d}_{kind}_{tag}"))
    return rows


OFFSET_SCHEMA = "idx int, dz int, dy int, dx int, kind string, name string"


def explode_offsets(rows: DataFrame, offsets=OFFSETS) -> DataFrame:
    """``rows`` once per offset, with columns idx, oz, oy, ox."""
    o = F.array(*(F.struct(F.lit(k).alias("idx"), *(F.lit(d).alias(f"o{a}") for a, d in zip(AXES, v, strict=True))) for k, v in enumerate(offsets)))
    return rows.withColumn("_o", F.explode(o)).select(*rows.columns, "_o.*")


def offset_table(catalog: DataFrame, offsets=OFFSETS, n_pull: int = N_PULL) -> DataFrame:
    """(volume, idx, kind, name, n_pairs) of the offsets that fit into each volume of
    the catalog (volume, dz, dy, dx): no longer than an axis; n_pairs voxels have
    the neighbour in bounds."""
    rows = F.array(*(F.struct(F.lit(i).alias("idx"), *(F.lit(d).alias(f"o{a}") for a, d in zip(AXES, o, strict=True)), F.lit(kind).alias("kind"), F.lit(name).alias("name")) for (i, *o, kind, name) in offset_rows(offsets, n_pull)))
    o = catalog.select("volume", *(f"d{a}" for a in AXES), F.explode(rows).alias("o")).select("volume", *(f"d{a}" for a in AXES), "o.*")
    left = [F.col(f"d{a}") - F.abs(f"o{a}") for a in AXES]
    o = o.where(reduce(lambda p, q: p & q, (n > 0 for n in left)))
    return o.select("volume", "idx", "kind", "name", reduce(lambda p, q: p * q, (n.cast("bigint") for n in left)).alias("n_pairs"))


def select_offsets(table: DataFrame, most_push: int) -> DataFrame:
    """Of an ``offset_table`` all pull offsets and at most ``most_push`` push offsets of
    each volume, evenly spaced among those that fit."""
    by = Window.partitionBy("volume", "kind")
    k, n = F.row_number().over(by.orderBy("idx")) - 1, F.count("*").over(by)
    step = F.greatest(F.lit(1), F.floor(n / max(1, most_push)))
    o = table.withColumns({"_k": k, "_step": step})
    kept = (F.col("kind") == "pull") | ((F.col("_k") % F.col("_step") == 0) & (F.floor(F.col("_k") / F.col("_step")) < most_push))
    return o.where(kept).drop("_k", "_step")


def edge_coordinate(a: str, edge: str) -> Column:
    p, n = F.col(a) + F.col(f"o{a}"), F.col(f"d{a}")
    if edge == "clamp":
        return F.greatest(F.lit(0), F.least(p, n - 1))
    if edge == "reflect":
        period = F.greatest(2 * n - 2, F.lit(1))
        m = F.pmod(p, period)
        return F.when(m < n, m).otherwise(period - m)
    return p


def shifted(voxels: DataFrame, columns: list[str], offsets=OFFSETS, edge: str = "clamp") -> DataFrame:
    """(volume, z, y, x, columns, idx, n_<column>): the columns of voxel v + o
    for every voxel v and offset o. ``drop`` leaves out pairs beyond the edge;
    otherwise an offset as long as its axis raises an error."""
    ext = extents(voxels).drop("n_voxels")
    own = explode_offsets(voxels.select("volume", *AXES, *columns).join(ext, "volume"), offsets)
    if edge == "drop":
        own = own.where(" AND ".join(f"{a} + o{a} BETWEEN 0 AND d{a} - 1" for a in AXES))
    else:
        far = reduce(lambda p, q: p | q, (F.abs(F.col(f"o{a}")) >= F.col(f"d{a}") for a in AXES))
        own = own.where(F.when(far & (F.abs("oz") + F.abs("oy") + F.abs("ox") > 0), F.raise_error(F.lit("an offset reaches across the whole axis")).cast("boolean")).otherwise(True))
    own = own.withColumns({f"t{a}": edge_coordinate(a, edge).cast("int") for a in AXES})
    there = voxels.select("volume", *(F.col(a).alias(f"t{a}") for a in AXES), *(F.col(c).alias(f"n_{c}") for c in columns))
    return own.join(there, ["volume", "tz", "ty", "tx"]).select("volume", *AXES, *columns, "idx", *(f"n_{c}" for c in columns))


def line_steps(column: str, axis: str, step: int = 1) -> tuple[Column, Column]:
    """The column ``step`` voxels before and after along an axis, the voxel's own
    at the edge."""
    w = Window.partitionBy("volume", *(a for a in AXES if a != axis)).orderBy(axis)
    own = F.col(column)
    return F.coalesce(F.lag(column, step).over(w), own), F.coalesce(F.lead(column, step).over(w), own)


def affinity_target(voxels: DataFrame, offsets=OFFSETS, label: str = "label", background: int | None = None) -> DataFrame:
    """(volume, z, y, x, idx, target, valid): 1 where v and v + o have one label,
    with ``background`` not that one's; valid where both are foreground."""
    pairs = shifted(voxels, [label], offsets, "clamp")
    same = F.col(label) == F.col(f"n_{label}")
    if background is not None:
        same = same & (F.col(label) != background)
    return pairs.select("volume", *AXES, "idx", same.cast("int").alias("target"), ((F.col(label) > 0) & (F.col(f"n_{label}") > 0)).cast("int").alias("valid"))


def affinity_profile(targets: DataFrame, clip: float = 10.0, eps: float = 1e-7) -> DataFrame:
    """Per volume and offset the share of positives among valid pairs and the
    balancing weights of both classes."""
    counts = targets.groupBy("volume", "idx").agg(F.sum(F.col("target") * F.col("valid")).alias("n_positive"), F.sum("valid").alias("n_valid"))
    return profile_of(counts, clip, eps)


def profile_of(counts: DataFrame, clip: float = 10.0, eps: float = 1e-7) -> DataFrame:
    """(volume, idx, positive, n_valid, w_pos, w_neg) from the numbers of valid
    pairs and of positives among them."""
    f = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col("positive")))
    g = counts.select("volume", "idx", (F.col("n_positive") / F.greatest("n_valid", F.lit(1))).alias("positive"), "n_valid")
    return g.withColumn("w_pos", F.least(0.5 / f, F.lit(clip))).withColumn("w_neg", F.least(0.5 / (1 - f), F.lit(clip)))


def boundary_mask(voxels: DataFrame, mode: str = "inner", connectivity: int = 1, xy_only: bool = False, label: str = "label") -> DataFrame:
    """``voxels`` with boundary (boolean): a neighbour has another label. mode
    ``inner`` keeps foreground, ``outer`` background, ``thick`` both. Face
    neighbours come from lines; with connectivity 2 or 3 from all neighbours with
    so many changed coordinates at most."""
    axes = ("y", "x") if xy_only else AXES
    if connectivity == 1:
        changed = reduce(lambda p, q: p | q, (n != F.col(label) for a in axes for n in line_steps(label, a)))
        out = voxels.withColumn("boundary", changed)
    else:
        span = lambda a: (-1, 0, 1) if a in axes else (0,)
        steps = [(i, j, k) for i in span("z") for j in span("y") for k in span("x") if 0 < abs(i) + abs(j) + abs(k) <= connectivity]
        near = shifted(voxels, [label], steps, "clamp").groupBy("volume", *AXES).agg(F.bool_or(F.col(f"n_{label}") != F.col(label)).alias("boundary"))
        out = voxels.join(near, ["volume", *AXES])
    side = {"inner": F.col(label) > 0, "outer": F.col(label) == 0, "thick": F.lit(True)}[mode]
    return out.withColumn("boundary", F.col("boundary") & side)


def boundary_erode(voxels: DataFrame, xy_only: bool = False, connectivity: int = 1, label: str = "label") -> DataFrame:
    """``voxels`` with eroded: the label, 0 on inner boundaries; an id that would
    lose all its voxels keeps them all."""
    marked = boundary_mask(voxels, "inner", connectivity, xy_only, label)
    kept = marked.groupBy("volume", label).agg(F.bool_or(~F.col("boundary")).alias("_survives"))
    return marked.join(kept, ["volume", label]).withColumn("eroded", F.when(F.col("boundary") & F.col("_survives"), F.lit(0).cast("bigint")).otherwise(F.col(label))).drop("_survives")

"""Queries O-TILE-*, O-RES-*, O-DEG-*, O-AUG-*, O-INF-*, O-SCR-* and O-SMP-*
over the voxel table, and their DuckDB SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from voxloom.operators import affinities as A
from voxloom.operators import neighbors as N
from voxloom.operators import resample as R
from voxloom.operators import sampling as S
from voxloom.operators import scoring as C
from voxloom.operators import tiling as T
from voxloom.operators import voxels as V
from voxloom.plans.metric_queries import rounded
from voxloom.plans.voxel_queries import EXT, KEYS, NB, PAIRS, VX
from voxloom.sources import bricks as B
from voxloom.sources import fixtures as X

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# --- tiles -----------------------------------------------------------------


def tiles_sql(patch, stride, full=True):
    steps = ""
    for a, p, s in zip("zyx", patch, stride, strict=True):
        tail = f" UNION SELECT volume, greatest(0, d{a} - {p}) FROM ext" if full else ""
        steps += f", s{a} AS (SELECT volume, s AS {a}0, row_number() OVER (PARTITION BY volume ORDER BY s) - 1 AS k{a}, count(*) OVER (PARTITION BY volume) AS c{a} FROM (SELECT volume, unnest(range(0, greatest(0, d{a} - {p}) + 1, {s})) AS s FROM ext{tail}))"
    sizes = ", ".join(f"least({p}, d{a})::INT AS n{a}" for a, p in zip("zyx", patch, strict=True))
    return f"{steps}, tl AS (SELECT ext.volume, ((kz * cy + ky) * cx + kx)::INT AS patch_idx, z0::INT AS z0, y0::INT AS y0, x0::INT AS x0, {sizes} FROM ext JOIN sz USING (volume) JOIN sy USING (volume) JOIN sx USING (volume))"


@query("tile_patch_grid", f"{VX}{EXT}{tiles_sql((4, 10, 24), (2, 5, 12))} SELECT * FROM tl")
def _(spark, sf):
    return T.patch_grid(V.extents(X.voxels(spark, sf)), (4, 10, 24), overlap=0.5)


@query("tile_window_grid", f"{VX}{EXT}{tiles_sql((4, 12, 12), (2, 6, 6), False)} SELECT volume, patch_idx, z0, y0, x0 FROM tl")
def _(spark, sf):
    return T.patch_grid(V.extents(X.voxels(spark, sf)), (4, 12, 12), (2, 6, 6), coverage="strict").select("volume", "patch_idx", "z0", "y0", "x0")


def reflect_sql(p, n):
    return f"CASE WHEN ({p}) % (2 * {n} - 2) < {n} THEN ({p}) % (2 * {n} - 2) ELSE 2 * {n} - 2 - ({p}) % (2 * {n} - 2) END"


@query("tile_reflect_pad", f"{VX}, g AS (SELECT volume, a.z::INT AS z, b.y::INT AS y, c.x::INT AS x FROM (SELECT DISTINCT volume FROM voxels), range(10) a(z), range(40) b(y), range(64) c(x)) SELECT g.volume, g.z, g.y, g.x, v.label FROM g JOIN voxels v ON v.volume = g.volume AND v.z = {reflect_sql('g.z', 7)} AND v.y = {reflect_sql('g.y', 32)} AND v.x = g.x")
def _(spark, sf):
    v = X.voxels(spark, sf)
    return T.reflect_pad(v, V.extents(v), (10, 40, 64), "label")


P = (4, 8, 16)


def random_crops(spark, sf, attempts=4):
    e = V.extents(X.voxels(spark, sf)).withColumn("k", F.explode(F.expr("sequence(0, 15)"))).withColumn("sample", F.concat_ws(":", "volume", "k"))
    return S.random_crops(e.select("sample", "volume", "dz", "dy", "dx"), (4, 8, 16), attempts, 11)


def crops_sql(attempts=4, seed=11):
    """DuckDB: table cr (sample, volume, attempt, sz, sy, sx) of the drawn crops."""
    starts = ", ".join(f"({S.draw_sql(seed, 'sample', repr(a), 'attempt')} % greatest(d{a} - {p} + 1, 1))::INT AS s{a}" for a, p in zip("zyx", P, strict=True))
    return f"{EXT}, sm AS (SELECT volume || ':' || k AS sample, volume, dz, dy, dx, k FROM ext, range(16) r(k)), cr AS (SELECT sample, volume, attempt::INT AS attempt, {starts} FROM sm, range({attempts}) t(attempt))"


@query("tile_random_crop", f"{VX}{crops_sql()} SELECT * FROM cr")
def _(spark, sf):
    return random_crops(spark, sf).select("sample", "volume", "attempt", "sz", "sy", "sx")


@query("tile_pad_center_crop", f"{VX}, g AS (SELECT volume, a.z::INT AS z, b.y::INT AS y, c.x::INT AS x FROM (SELECT DISTINCT volume FROM voxels), range(9) a(z), range(20) b(y), range(64) c(x)) SELECT g.volume, g.z, g.y, g.x, coalesce(v.label, 0) AS label FROM g LEFT JOIN voxels v ON v.volume = g.volume AND v.z = g.z - 1 AND v.y = g.y + 6 AND v.x = g.x")
def _(spark, sf):
    v = X.voxels(spark, sf)
    sizes = v.select("volume").distinct().selectExpr("volume", "9 AS dz", "20 AS dy", "64 AS dx")
    return R.center_fit(v, sizes, "label", 0)


@query("tile_safe_patch", f"{VX}, r AS (SELECT volume, 30.0 + length(volume) AS res_z, 2.0 + count(DISTINCT label) % 3 AS res_xy FROM voxels GROUP BY volume) SELECT ceil(16 / (least(40.0, min(res_z)) / 50.0))::INT AS safe_z, ceil(64 / (least(8.0, min(res_xy)) / 10.0))::INT AS safe_y, ceil(64 / (least(8.0, min(res_xy)) / 10.0))::INT AS safe_x FROM r")
def _(spark, sf):
    r = X.voxels(spark, sf).groupBy("volume").agg((F.lit(2.0) + F.count_distinct("label") % 3).alias("res_y")).withColumn("res_z", F.lit(30.0) + F.length("volume")).withColumn("res_x", F.col("res_y"))
    return T.safe_patch(r, (16, 64, 64), (50.0, 10.0, 10.0), (40.0, 8.0, 8.0))


@query("tile_slice_explode", f"{VX} SELECT volume, z, count(*) AS n, sum(label)::BIGINT AS sum_label FROM voxels GROUP BY ALL")
def _(spark, sf):
    return X.voxels(spark, sf).groupBy("volume", "z").agg(F.count("*").alias("n"), F.sum("label").alias("sum_label"))


@query("tile_scaled_extent", f"{VX}{EXT} SELECT volume, greatest(1, round_even(dz * 4.0 / 40, 0))::BIGINT AS nz, greatest(1, round_even(dy * 4.0 / 8, 0))::BIGINT AS ny, greatest(1, round_even(dx * 4.0 / 3, 0))::BIGINT AS nx FROM ext")
def _(spark, sf):
    scaled = [F.greatest(F.lit(1), F.bround(F.col(f"d{a}") * 4.0 / r, 0)).cast("bigint").alias(f"n{a}") for a, r in (("z", 40.0), ("y", 8.0), ("x", 3.0))]
    return V.extents(X.voxels(spark, sf)).select("volume", *scaled)


# --- resampling ------------------------------------------------------------


def linear_axis(a, n, m):
    c = f"greatest(0, (i + 0.5) * {n} / {m}.0 - 0.5)"
    return f"""w{a} AS (SELECT i::INT AS t{a}, floor(c)::INT AS j{a}, 1 - (c - floor(c)) AS w{a} FROM (SELECT i, {c} AS c FROM range({m}) r(i)) UNION ALL SELECT i::INT, least(floor(c)::INT + 1, {n} - 1), c - floor(c) FROM (SELECT i, {c} AS c FROM range({m}) r(i)))"""


def linear_sql(axes, value="intensity"):
    """axes: {axis: (in, out)}; axes that are left out stay."""
    w = ", ".join(linear_axis(a, *axes[a]) for a in axes)
    joins = " ".join(f"JOIN w{a} ON v.{a} = j{a}" for a in axes)
    out = ", ".join(f"t{a} AS {a}" if a in axes else f"v.{a} AS {a}" for a in "zyx")
    return f", {w}, rs AS (SELECT v.volume, {out}, sum({value} * {' * '.join(f'w{a}' for a in axes)}) AS value FROM voxels v {joins} GROUP BY ALL)"


@query("res_trilinear", f"{VX}{linear_sql({'z': (7, 10), 'y': (32, 20), 'x': (64, 40)})} SELECT volume, z, y, x, round(value + 1.234e-5, 3) AS intensity FROM rs")
def _(spark, sf):
    sizes = {"z": F.lit(10), "y": F.lit(20), "x": F.lit(40)}
    return R.resample_bricks(X.bricks(spark, sf, (8, 64, 64), ("intensity",)), sizes, "intensity").withColumn("intensity", F.round(F.col("intensity") + 1.234e-5, 3))


@query("res_nearest", f"{VX} SELECT v.volume, a.i::INT AS z, b.i::INT AS y, c.i::INT AS x, label FROM range(10) a(i), range(20) b(i), range(96) c(i) JOIN voxels v ON v.z = a.i * 7 // 10 AND v.y = b.i * 32 // 20 AND v.x = c.i * 64 // 96".replace("FROM range(10) a(i), range(20) b(i), range(96) c(i) JOIN", "FROM range(10) a(i) CROSS JOIN range(20) b(i) CROSS JOIN range(96) c(i) JOIN"))
def _(spark, sf):
    return R.resample_bricks(X.bricks(spark, sf, (8, 64, 64), ("label",)), {"z": F.lit(10), "y": F.lit(20), "x": F.lit(96)}, "label", "nearest")


@query(
    "res_zoom_crop_pad",
    f"{VX}, g AS (SELECT volume, a.z::INT AS z, b.y::INT AS y, c.x::INT AS x FROM (SELECT DISTINCT volume FROM voxels), range(7) a(z), range(32) b(y), range(64) c(x)) SELECT g.volume, g.z, g.y, g.x, coalesce(v.label, 0) AS label FROM g LEFT JOIN voxels v ON v.volume = g.volume AND v.z = g.z AND g.y + 8 < 48 AND v.y = (g.y + 8) * 32 // 48 AND g.x - 16 BETWEEN 0 AND 31 AND v.x = (g.x - 16) * 64 // 32",
)
def _(spark, sf):
    return R.zoom_crop_pad(X.voxels(spark, sf), {"z": 1.0, "y": 1.5, "x": 0.5}, "label", "nearest")


def log_uniform_sql(low, high, k):
    return f"exp({S.draw_sql(5, 'volume', 'sample', str(k))} / pow(2.0, 48) * ln({high / low!r}::DOUBLE) + ln({low!r}::DOUBLE))"


@query(
    "res_zoom_plan",
    f"{VX}{EXT}, sm AS (SELECT volume, sample::INT AS sample, CASE WHEN length(volume) % 2 = 0 THEN 40.0 ELSE 8.0 END::DOUBLE AS native FROM ext, range(8) r(sample)) "
    f"SELECT volume, sample, native, CASE WHEN native = 8 THEN 8 ELSE round({log_uniform_sql(30.0, 50.0, 1)}, 9) END::DOUBLE AS target_z, CASE WHEN native = 8 THEN 8 ELSE round({log_uniform_sql(4.0, 10.0, 2)}, 9) END::DOUBLE AS target_xy FROM sm",
)
def _(spark, sf):
    """Per sample a target resolution: one for y and x, log-uniform, and one for z; isotropic volumes keep theirs."""
    e = V.extents(X.voxels(spark, sf)).withColumn("sample", F.explode(F.expr("sequence(0, 7)"))).withColumn("native", F.when(F.length("volume") % 2 == 0, 40.0).otherwise(8.0))
    logu = lambda lo, hi, k: F.exp(S.draw(5, "volume", "sample", F.lit(k)) * F.log(F.lit(hi / lo)) + F.log(F.lit(lo)))
    iso = F.col("native") == 8.0
    return e.select("volume", "sample", "native", F.when(iso, 8.0).otherwise(F.round(logu(30.0, 50.0, 1), 9)).alias("target_z"), F.when(iso, 8.0).otherwise(F.round(logu(4.0, 10.0, 2), 9)).alias("target_xy"))


NATIVE = "CASE WHEN length(volume) % 2 = 0 THEN 40.0 ELSE 8.0 END::DOUBLE"
OF_Y = f"{S.draw_sql(5, 'volume', 'sample', chr(39) + 'y' + chr(39))} / pow(2.0, 48) * 6.0 + 4.0"
RATIO = f""", sm AS (SELECT *, {NATIVE} AS res_z, {S.draw_sql(5, 'volume', 'sample', "'zoomed'")} / pow(2.0, 48) < 0.75 AS zoomed FROM (SELECT ext.*, sample::INT AS sample FROM ext, range(2) r(sample))),
 tg AS (SELECT *, CASE WHEN zoomed THEN least(50.0, greatest(6.0, ({OF_Y}) * (res_z / 8.0))) ELSE res_z END AS target_z, CASE WHEN zoomed THEN least(10.0, greatest(4.0, {OF_Y})) ELSE 8.0 END AS target_y FROM sm)"""


def planned(spark, sf):
    e = V.extents(X.voxels(spark, sf)).withColumn("sample", F.explode(F.expr("sequence(0, 1)")))
    e = e.select("volume", "sample", F.when(F.length("volume") % 2 == 0, 40.0).otherwise(8.0).alias("res_z"), F.lit(8.0).alias("res_y"), F.lit(8.0).alias("res_x"))
    return R.zoom_plan(e, (6, 4, 4), (50, 10, 10), 5, "ratio", 0.75)


@query("res_zoom_plan_ratio", f"{VX}{EXT}{RATIO} SELECT volume, sample, zoomed, round(target_z, 9) AS target_z, round(target_y, 9) AS target_y, round(target_y, 9) AS target_x FROM tg")
def _(spark, sf):
    """One target for y and x, and for z by the native ratio, within bounds; one sample in four is not zoomed."""
    return planned(spark, sf).select("volume", "sample", "zoomed", *(F.round(f"target_{a}", 9).alias(f"target_{a}") for a in V.AXES))


@query(
    "res_zoom_by_plan",
    f"""{VX}{EXT}{RATIO}, zm AS (SELECT *, greatest(1, round_even(dz * (res_z / target_z), 0))::INT AS mz, greatest(1, round_even(dy * (8.0 / target_y), 0))::INT AS my, greatest(1, round_even(dx * (8.0 / target_y), 0))::INT AS mx FROM tg),
 gr AS (SELECT zm.*, z, y, x, z + floor((mz - dz) / 2.0)::INT AS iz, y + floor((my - dy) / 2.0)::INT AS iy, x + floor((mx - dx) / 2.0)::INT AS ix FROM zm JOIN (SELECT volume, z, y, x FROM voxels) USING (volume)),
 pk AS (SELECT g.*, v.label FROM gr g LEFT JOIN voxels v ON v.volume = g.volume AND iz BETWEEN 0 AND mz - 1 AND iy BETWEEN 0 AND my - 1 AND ix BETWEEN 0 AND mx - 1 AND v.z = iz * dz // mz AND v.y = iy * dy // my AND v.x = ix * dx // mx)
 SELECT volume, sample, z, y, sum(coalesce(label, 0))::BIGINT AS total, sum(coalesce(label, 0) * (x + 1) * (x + 1))::BIGINT AS placed FROM pk GROUP BY ALL""",
)
def _(spark, sf):
    """Labels of every volume resampled twice, as the plan says; summed along x, and by place."""
    out = R.zoom_by_plan(X.voxels(spark, sf), planned(spark, sf), "label", "nearest")
    return out.groupBy("volume", "sample", "z", "y").agg(F.sum("label").alias("total"), F.sum(F.expr("label * (x + 1) * (x + 1)")).alias("placed"))


POOL = "v.{a} >= i{a} * {n} // {m} AND v.{a} < ((i{a} + 1) * {n} + {m} - 1) // {m}"


@query(
    "res_avg_pool",
    f"{VX} SELECT v.volume, iz::INT AS z, iy::INT AS y, ix::INT AS x, round(avg(intensity) + 1.234e-5, 3) AS intensity FROM voxels v, range(3) a(iz), range(12) b(iy), range(16) c(ix) WHERE {POOL.format(a='z', n=7, m=3)} AND {POOL.format(a='y', n=32, m=12)} AND {POOL.format(a='x', n=64, m=16)} GROUP BY ALL",
)
def _(spark, sf):
    sizes = {"z": F.lit(3), "y": F.lit(12), "x": F.lit(16)}
    return R.resample_bricks(X.bricks(spark, sf, (8, 64, 64), ("intensity",)), sizes, "intensity", "pool").withColumn("intensity", F.round(F.col("intensity") + 1.234e-5, 3))


@query(
    "res_fine_grid_place",
    f"{VX}{linear_sql({'z': (7, 14), 'y': (32, 32), 'x': (64, 64)})}, lb AS (SELECT volume, count(*) AS n_label, sum(label) AS s_label FROM voxels GROUP BY ALL) SELECT 'sft' AS task, r.volume, count(*) AS n_image, round(sum(value), 2) AS s_image, any_value(n_label) AS n_label, any_value(s_label)::BIGINT AS s_label FROM rs r JOIN lb USING (volume) GROUP BY ALL",
)
def _(spark, sf):
    v = X.voxels(spark, sf)
    image = R.resample(v, {"z": F.col("dz") * 2}, "intensity", axes=("z",)).groupBy("volume").agg(F.count("*").alias("n_image"), F.round(F.sum("intensity"), 2).alias("s_image"))
    label = v.groupBy("volume").agg(F.count("*").alias("n_label"), F.sum("label").alias("s_label"))
    return image.join(label, "volume").withColumn("task", F.lit("sft"))


@query("res_resize_2d", f"{VX}{linear_sql({'z': (7, 7), 'y': (32, 24), 'x': (64, 48)})} SELECT volume, z, y, x, round(value + 1.234e-5, 3) AS intensity FROM rs")
def _(spark, sf):
    out = R.resample(X.voxels(spark, sf), {"y": F.lit(24), "x": F.lit(48)}, "intensity", axes=("y", "x"))
    return out.select(*KEYS, F.round(F.col("intensity") + 1.234e-5, 3).alias("intensity"))


@query("deg_z_slab_average", f"{VX} SELECT v.volume, iz::INT AS z, y, x, round(avg(intensity) + 1.234e-5, 3) AS intensity FROM voxels v, range(2) a(iz) WHERE {POOL.format(a='z', n=7, m=2)} GROUP BY ALL")
def _(spark, sf):
    v = X.voxels(spark, sf)
    return R.resample(v, R.slab_sizes(3.5), "intensity", "pool", ("z",)).withColumn("intensity", F.round(F.col("intensity") + 1.234e-5, 3))


def normed(spark, sf):
    return V.minmax_norm(X.voxels(spark, sf)).select(*KEYS, "label", F.col("norm").alias("intensity"))


NORM = f"{VX}, nm AS (SELECT volume, z, y, x, label, coalesce((intensity - lo) / nullif(hi - lo, 0), 0) AS v FROM (SELECT *, min(intensity) OVER (PARTITION BY volume) AS lo, max(intensity) OVER (PARTITION BY volume) AS hi FROM voxels))"
UNIT = "/ pow(2.0, 48)"


def reflected(at, n):
    """An index beyond the edge, the edge voxel repeated."""
    m = f"((({at}) % {2 * n}) + {2 * n}) % {2 * n}"
    return f"CASE WHEN {m} < {n} THEN {m} ELSE {2 * n - 1} - {m} END"


def six(df, value="intensity"):
    """Rounded to six decimals, on the same side of a tie on every engine."""
    return df.withColumn(value, F.round(F.col(value) + 1.234e-8, 6))


@query(
    "deg_section_jitter",
    f"""{NORM}, s AS (SELECT volume, z, ({S.draw_sql(3, 'volume', 'z', '1')} {UNIT} * 2 - 1) * 1.5 * (32 / 31.0::DOUBLE) AS my, ({S.draw_sql(3, 'volume', 'z', '2')} {UNIT} * 2 - 1) * 1.5 * (64 / 63.0::DOUBLE) AS mx FROM (SELECT DISTINCT volume, z FROM nm)),
 q AS (SELECT nm.volume, nm.z, nm.y, nm.x, floor(y + my)::INT + a AS ty, floor(x + mx)::INT + b AS tx, CASE WHEN a = 1 THEN y + my - floor(y + my) ELSE 1 - (y + my - floor(y + my)) END * CASE WHEN b = 1 THEN x + mx - floor(x + mx) ELSE 1 - (x + mx - floor(x + mx)) END AS w FROM nm JOIN s USING (volume, z), range(2) i(a), range(2) j(b)),
 p AS (SELECT volume, z, y, x, w, ({reflected('ty', 32)})::INT AS qy, ({reflected('tx', 64)})::INT AS qx FROM q)
 SELECT p.volume, p.z, p.y, p.x, round(sum(v * w) + 1.234e-8, 6) AS intensity FROM p JOIN nm ON nm.volume = p.volume AND nm.z = p.z AND nm.y = qy AND nm.x = qx GROUP BY ALL""",
)
def _(spark, sf):
    return six(R.jitter_sections(normed(spark, sf), 1.5, 3))


@query(
    "deg_section_drop",
    f"""{NORM}, s AS (SELECT volume, z, row_number() OVER (PARTITION BY volume ORDER BY {S.draw_sql(3, 'volume', 'z')}, z) <= {S.draw_sql(3, 'volume', "'k'")} % 4 + 1 AS gone FROM (SELECT DISTINCT volume, z FROM nm)),
 f AS (SELECT a.volume, a.z, arg_min(b.z, abs(a.z - b.z) * 1000 + b.z) AS source FROM s a JOIN s b ON a.volume = b.volume AND NOT b.gone GROUP BY ALL)
 SELECT f.volume, f.z, y, x, round(v + 1.234e-8, 6) AS intensity FROM f JOIN nm ON nm.volume = f.volume AND nm.z = source""",
)
def _(spark, sf):
    """One to four sections of each volume lost, and the nearest one left in their place."""
    return six(R.drop_sections(normed(spark, sf), 4, 3))


GAUSS = f"sqrt(-2 * ln(greatest({S.draw_sql(3, 'volume', 'z', 'y', 'x', '1')} {UNIT}, 1e-12))) * cos(2 * pi() * ({S.draw_sql(3, 'volume', 'z', 'y', 'x', '2')} {UNIT}))"


@query("deg_section_noise", f"{NORM} SELECT volume, z, y, x, round(v + {GAUSS} * ({S.draw_sql(3, 'volume', 'z')} {UNIT}) * 0.1 + 1.234e-8, 6) AS intensity FROM nm")
def _(spark, sf):
    return six(R.section_noise(normed(spark, sf), 0.1, 3).drop("label"))


@query("deg_section_gamma", f"{NORM} SELECT volume, z, y, x, round(pow(greatest(0, least(1, v)), {S.draw_sql(3, 'volume', 'z', '3')} {UNIT} * 0.7 + 0.7) + 1.234e-8, 6) AS intensity FROM nm")
def _(spark, sf):
    return six(R.section_gamma(normed(spark, sf), 0.7, 1.4, 3).drop("label"))


@query("deg_degrade_pair")
def _(spark, sf):
    return R.degrade_pair(X.bricks(spark, sf, (8, 64, 64), ("intensity",)), 2.0, 3, normalize=True)


def flipped(a, k, last):
    return f"CASE WHEN {S.draw_sql(3, 'volume', str(k))} % 2 = 1 THEN {last} - {a} ELSE {a} END"


@query("aug_dihedral", f"{VX} SELECT volume, {flipped('z', 0, 6)} AS z, {flipped('y', 1, 31)} AS y, {flipped('x', 2, 63)} AS x, label FROM voxels")
def _(spark, sf):
    return R.dihedral(X.voxels(spark, sf), 3).select(*KEYS, "label")


@query(
    "aug_intensity",
    f"""{NORM}, s AS (SELECT *, {S.draw_sql(3, 'volume', '1')} {UNIT} < 0.5 AS bent, {S.draw_sql(3, 'volume', '3')} {UNIT} < 0.5 AS noisy FROM nm)
 SELECT volume, z, y, x, round(CASE WHEN bent THEN pow(greatest(0, least(1, v)), {S.draw_sql(3, 'volume', '2')} {UNIT} * 0.6 + 0.7) ELSE v END + CASE WHEN noisy THEN {GAUSS} * 0.05 ELSE 0 END + 1.234e-8, 6) AS intensity FROM s""",
)
def _(spark, sf):
    return six(R.intensity_aug(normed(spark, sf), 3).drop("label"))


# --- tiled inference -------------------------------------------------------

BRICK = (8, 32, 32)
GW = "exp(-(power(pz - 2.0, 2) + power(py - 4.0, 2) + power(px - 8.0, 2)) / (2 * 0.25))"


@query("inf_gaussian_weight", f"{VX}{EXT}{tiles_sql(P, P)}, a AS (SELECT volume, patch_idx, pz, py, px FROM tl, range(4) r(pz), range(8) s(py), range(16) t(px)) SELECT volume, patch_idx, pz::INT AS pz, py::INT AS py, px::INT AS px, round({GW}, 6) AS weight FROM a")
def _(spark, sf):
    tiles = T.patch_grid(V.extents(X.voxels(spark, sf)), P, P)
    for a in V.AXES:
        tiles = tiles.withColumn(f"p{a}", F.explode(F.expr(f"sequence(0, n{a} - 1)")))
    return rounded(T.gaussian_weight(tiles, P).select("volume", "patch_idx", "pz", "py", "px", "weight"), "weight")


def linear_model(tiles: np.ndarray) -> np.ndarray:
    """A toy model: half the value and a quarter."""
    return 0.5 * tiles + 0.25


def parities(spark, sf):
    """Bricks of the parity of labels, as values to predict from."""
    v = X.voxels(spark, sf).select(*KEYS, (F.col("label") % 2).cast("double").alias("value"))
    return B.to_bricks(v, BRICK, ("value",))


PRED = f"{tiles_sql(P, (2, 4, 8))}, pd AS (SELECT v.volume, patch_idx, v.z, v.y, v.x, v.z - z0 AS pz, v.y - y0 AS py, v.x - x0 AS px, 0.5 * (label % 2) + 0.25 AS pred FROM tl JOIN voxels v ON v.volume = tl.volume AND v.z >= z0 AND v.z < z0 + nz AND v.y >= y0 AND v.y < y0 + ny AND v.x >= x0 AND v.x < x0 + nx)"


@query("inf_tiled_predict", f"{VX}{EXT}{PRED} SELECT volume, patch_idx, count(*) AS n, round(sum(pred), 6)::DOUBLE AS total FROM pd GROUP BY ALL")
def _(spark, sf):
    tiles = T.predict_tiles(parities(spark, sf), "value", linear_model, P, (2, 4, 8), size=BRICK)
    return tiles.select("volume", "patch_idx", F.size("pred").cast("bigint").alias("n"), F.round(F.expr("aggregate(pred, 0D, (a, x) -> a + x)"), 6).alias("total"))


@query("inf_blend", f"{VX}{EXT}{PRED} SELECT volume, z, y, x, round(sum(pred * {GW}) / (sum({GW}) + 1e-8), 5)::DOUBLE AS pred FROM pd GROUP BY ALL")
def _(spark, sf):
    out = T.predict_blended(parities(spark, sf), "value", linear_model, P, (2, 4, 8), size=BRICK)
    return B.to_voxels(out, ("pred",)).withColumn("pred", F.round("pred", 5))


# --- scores ----------------------------------------------------------------

BP = "WITH " + X.BINARY_PAIR_SQL
BCE = "(greatest(logit, 0) - logit * truth + ln(1 + exp(-abs(logit))))"
PS = "(1 / (1 + exp(-logit)))"
PC = f"greatest(1e-7, least(1 - 1e-7, {PS}))"
PT = f"(truth * {PC} + (1 - truth) * (1 - {PC}))"
FOCAL = f"(pow(1 - {PT}, 2.0) * -ln({PT}))"


@query("scr_bce", f"{BP} SELECT volume, round(avg({BCE}), 6) AS bce, round(avg(-(truth * ln({PC}) + (1 - truth) * ln(1 - {PC}))), 6) AS bce_probs FROM binary_pair GROUP BY ALL")
def _(spark, sf):
    b, z, t = X.binary_pair(spark, sf), F.col("logit"), F.col("truth")
    return rounded(b.groupBy("volume").agg(F.avg(C.bce_on_logits(z, t)).alias("bce"), F.avg(C.bce_on_probs(V.sigmoid(z), t)).alias("bce_probs")), "bce", "bce_probs")


@query("scr_focal", f"{BP} SELECT volume, round(avg({FOCAL}), 6) AS focal, round(avg({FOCAL} * ((1 - truth) * 0.7 + truth * 0.3)), 6) AS focal_alpha FROM binary_pair GROUP BY ALL")
def _(spark, sf):
    b, p, t = X.binary_pair(spark, sf), V.sigmoid(F.col("logit")), F.col("truth")
    return rounded(b.groupBy("volume").agg(F.avg(C.focal(p, t)).alias("focal"), F.avg(C.focal(p, t, alpha=0.7)).alias("focal_alpha")), "focal", "focal_alpha")


def dice_sql(p, t, w="1"):
    return f"(1 - (2 * sum({p} * {t} * {w}) + 1e-5) / (sum({p} * {w}) + sum({t} * {w}) + 1e-5))"


@query("scr_soft_dice", f"{BP} SELECT volume, round({dice_sql(PS, 'truth')}, 6) AS dice, round(({dice_sql(PS, 'truth')} + {dice_sql(f'(1 - {PS})', '(1 - truth)')}) / 2, 6) AS dice_two_sided FROM binary_pair GROUP BY ALL")
def _(spark, sf):
    p, t, one = V.sigmoid(F.col("logit")), F.col("truth").cast("double"), F.lit(1.0)
    return rounded(X.binary_pair(spark, sf).groupBy("volume").agg(C.soft_dice(p, t, one).alias("dice"), C.soft_dice(p, t, one, two_sided=True).alias("dice_two_sided")), "dice", "dice_two_sided")


def disturbed(h, k, same):
    """A stored prediction's stand-in: 0.9 on equal labels, else 0.1, and a regular disturbance."""
    z, y, x = h.axes()
    d = ((z * 11 + y * 7 + x * 3 + k * 5) % 10) / 100.0
    return np.where(same, 0.9 - d, 0.1 + d)


def disturbed_logit(h, k, same):
    p = disturbed(h, k, same)
    return np.log(p / (1 - p))


@query(
    "scr_affinity",
    f"""{VX}{NB}{PAIRS}, f AS (SELECT volume, idx, greatest(1e-7, least(1 - 1e-7, sum(target * valid) / greatest(sum(valid), 1))) AS f FROM pr GROUP BY ALL),
 w AS (SELECT pr.volume, target AS truth, ln(p / (1 - p)) AS logit, valid * CASE WHEN idx < 3 THEN 1.0 ELSE 3.0 END * (target * least(0.5 / f, 10) + (1 - target) * least(0.5 / (1 - f), 10)) AS w
  FROM (SELECT *, CASE WHEN target = 1 THEN 0.9 - ((z * 11 + y * 7 + x * 3 + idx * 5) % 10) / 100.0 ELSE 0.1 + ((z * 11 + y * 7 + x * 3 + idx * 5) % 10) / 100.0 END AS p FROM pr) pr JOIN f USING (volume, idx))
 SELECT volume, round(sum({BCE} * w) / sum(w), 5) AS bce, round(sum({FOCAL} * w) / sum(w), 5) AS focal, round({dice_sql(PS, 'truth', 'w')}, 5) AS dice FROM w GROUP BY ALL""",
)
def _(spark, sf):
    sums = A.score_sums(A.bricks_of(X.voxels(spark, sf)), disturbed_logit)
    out = C.balanced_composite(sums, ["volume"], F.when(F.col("idx") < N.N_PULL, 1.0).otherwise(3.0))
    return out.select("volume", *(F.round(c, 5).alias(c) for c in ("bce", "focal", "dice")))


@query("scr_foreground", f"{BP}, m AS (SELECT *, (pred >= 0)::INT * (1 + truth) AS w FROM binary_pair) SELECT volume, round(sum({BCE} * w) / sum(w) + sum({FOCAL} * w) / sum(w) + {dice_sql(PS, 'truth', 'w')}, 5) AS score FROM m GROUP BY ALL")
def _(spark, sf):
    rows = X.binary_pair(spark, sf).withColumn("w", (F.col("pred") >= 0).cast("double") * (1 + F.col("truth")))
    return C.composite(rows, ["volume"], "logit", "truth", "w").select("volume", F.round("score", 5).alias("score"))


@query("scr_recon", "SELECT l_returnflag AS volume, round(avg(abs(d)), 6) AS l1, round(avg(d * d), 6) AS mse, round(avg(CASE WHEN abs(d) < 1 THEN 0.5 * d * d ELSE abs(d) - 0.5 END), 6) AS smooth_l1 FROM (SELECT *, l_discount * 20 - l_tax * 10 AS d FROM lineitem) GROUP BY ALL")
def _(spark, sf):
    rows = X.read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("volume"), (F.col("l_discount") * 20).alias("a"), (F.col("l_tax") * 10).alias("b"))
    return rounded(C.recon_error(rows, ["volume"], "a", "b"), "l1", "mse", "smooth_l1")


@query("scr_joint", "SELECT l_orderkey % 50 AS batch, CASE WHEN l_orderkey % 50 % 2 = 0 THEN 'ssl' ELSE 'sft' END AS task, round(avg(l_discount) * CASE WHEN l_orderkey % 50 % 2 = 0 THEN 0.5 ELSE 1.0 END, 6) AS score FROM lineitem GROUP BY l_orderkey % 50")
def _(spark, sf):
    batch = F.col("l_orderkey") % 50
    parts = X.read(spark, sf, "lineitem").select(batch.alias("batch"), F.when(batch % 2 == 0, "ssl").otherwise("sft").alias("task"), F.col("l_discount").alias("score"))
    return rounded(C.joint_score(parts, {"ssl": 0.5, "sft": 1.0}), "score")


# --- sampling --------------------------------------------------------------

STEMS = "printf(CASE p_size % 8 WHEN 0 THEN 'AC%d_inputs' WHEN 1 THEN 'neurons_%d_volume' WHEN 2 THEN 'cremi3d_sample_A%d+' WHEN 3 THEN 'flyem3d_hemibrain_%d' WHEN 4 THEN 'flyem3d_%dnm_ssl' WHEN 5 THEN 'jrc_hela-%d_4x4x3nm' WHEN 6 THEN 'mitoem2_rat_train%d' ELSE 'vol_x%d_y2_z3' END, p_partkey % 50)"


@query(
    "smp_subset_derive",
    f"""SELECT stem, CASE WHEN regexp_matches(stem, '^AC\\d+_') THEN regexp_extract(stem, '^(AC\\d+)_', 1) WHEN starts_with(stem, 'neurons') THEN 'neurons' WHEN regexp_matches(stem, '^cremi3d_sample_[A-Za-z]+\\+') THEN 'cremi3d_test'
 WHEN regexp_matches(stem, '^cremi3d_sample_[A-Za-z]+') THEN 'cremi3d' WHEN starts_with(stem, 'flyem3d_hemibrain') THEN 'flyem3d_hemibrain' WHEN regexp_matches(stem, '^flyem3d_\\d+nm_ssl') THEN 'flyem3d_fib25_ssl' WHEN starts_with(stem, 'jrc_') THEN regexp_extract(stem, '^(jrc_[A-Za-z0-9\\-]+?)_\\d+x\\d', 1)
 WHEN starts_with(stem, 'mitoem2') THEN regexp_extract(stem, '^(mitoem2_[a-z]+)_(?:train|test)\\d+', 1) ELSE regexp_extract(stem, '^(.*?)_x\\d+_y\\d+_z\\d+', 1) END AS subset FROM (SELECT {STEMS} AS stem FROM part)""",
)
def _(spark, sf):
    kinds = ["AC%d_inputs", "neurons_%d_volume", "cremi3d_sample_A%d+", "flyem3d_hemibrain_%d", "flyem3d_%dnm_ssl", "jrc_hela-%d_4x4x3nm", "mitoem2_rat_train%d", "vol_x%d_y2_z3"]
    stem = F.coalesce(*(F.when(F.col("p_size") % 8 == k, F.format_string(f, F.col("p_partkey") % 50)) for k, f in enumerate(kinds)))
    return X.read(spark, sf, "part").select(stem.alias("stem")).withColumn("subset", V.derive_subset(F.col("stem")))


def sampled_volumes(spark, sf):
    v = X.voxels(spark, sf).groupBy("volume").agg(F.count_if(F.col("label") > 0).alias("n_fg"))
    return v.select("volume", F.concat(F.lit("s"), F.col("n_fg") % 3).alias("subset"), (F.lit(30.0) + F.col("n_fg") % 2 * 10).alias("res_z"), F.lit(8.0).alias("res_y"), F.lit(8.0).alias("res_x"), (F.lit(1.0) + F.col("n_fg") % 4).alias("sample_weight"))


SV = VX + ", sv AS (SELECT volume, 's' || (n % 3) AS subset, 30.0 + n % 2 * 10 AS res_z, 1.0 + n % 4 AS sample_weight FROM (SELECT volume, count(*) FILTER (label > 0) AS n FROM voxels GROUP BY volume))"


@query("smp_balance_groups", f"{SV} SELECT subset || '|' || res_z::DOUBLE::VARCHAR || 'x8.0x8.0' AS grp, count(*) AS n_volumes, CASE WHEN subset = 's1' THEN 2.5 ELSE 1.0 END::DOUBLE AS mult FROM sv GROUP BY ALL")
def _(spark, sf):
    return S.balance_groups(sampled_volumes(spark, sf), "subset", spark.createDataFrame([("s1", 2.5)], "subset string, mult double"))


@query("smp_round_robin_schedule", f"{SV}, g AS (SELECT volume AS grp, (6 + sample_weight * 3)::BIGINT AS length FROM sv) SELECT grp, b::INT AS batch, j::INT AS item_no, ((b * 4 + j) % length)::BIGINT AS item FROM (SELECT *, unnest(range(length // 4)) AS b FROM g), range(4) r(j)")
def _(spark, sf):
    g = sampled_volumes(spark, sf).select(F.col("volume").alias("grp"), (6 + F.col("sample_weight") * 3).cast("bigint").alias("length"), F.lit(4).alias("batch_size"))
    return S.schedule(g).select("grp", "batch", "item_no", "item")


@query(
    "smp_shuffled_schedule",
    f"""{SV}, g AS (SELECT volume AS grp, (6 + sample_weight * 3)::BIGINT AS length FROM sv)
 SELECT grp, b::INT AS batch, {S.draw_sql(9, 'grp', 'b')} AS "order", j::INT AS item_no, ({S.draw_sql(10, 'grp', 'b', 'j')} % length)::BIGINT AS item FROM (SELECT *, unnest(range(length // 4)) AS b FROM g), range(4) r(j)""",
)
def _(spark, sf):
    g = sampled_volumes(spark, sf).select(F.col("volume").alias("grp"), (6 + F.col("sample_weight") * 3).cast("bigint").alias("length"), F.lit(4).alias("batch_size"))
    return S.schedule(g, seed=9).select("grp", "batch", F.col("order.col1").alias("order"), "item_no", "item")


@query("smp_virtual_epoch", f"{VX}, s AS (SELECT volume, z, row_number() OVER (ORDER BY volume, z) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT volume, z FROM voxels)) SELECT e.event_id, s.volume, s.z FROM events e JOIN s ON e.event_id % s.n = s.i")
def _(spark, sf):
    from pyspark.sql import Window

    v = X.voxels(spark, sf).groupBy("volume").agg(F.count_distinct("z").alias("n"))
    w = Window.orderBy("volume").rowsBetween(Window.unboundedPreceding, 0)
    # one row a volume is numbered; its sections follow by arithmetic
    first = v.withColumn("hi", F.sum("n").over(w)).select("volume", (F.col("hi") - F.col("n")).alias("lo"), "n")
    sections = first.withColumn("z", F.explode(F.expr("sequence(0, CAST(n AS INT) - 1)"))).select("volume", "z", (F.col("lo") + F.col("z")).alias("i"))
    total = first.agg(F.sum("n").alias("total"))
    e = X.read(spark, sf, "events").select("event_id").join(F.broadcast(total), F.lit(True)).withColumn("i", F.col("event_id") % F.col("total"))
    return e.join(sections, "i").select("event_id", "volume", "z")


@query(
    "smp_patch_manifest",
    f"""{VX}{crops_sql()}, g AS (SELECT sample, cr.volume, attempt, sz, sy, sx, round(least(avg((label > 0)::INT), avg((intensity <> 0)::INT)), 6) AS f FROM cr JOIN voxels v ON v.volume = cr.volume AND v.z >= sz AND v.z < sz + 4 AND v.y >= sy AND v.y < sy + 8 AND v.x >= sx AND v.x < sx + 16 GROUP BY ALL)
 SELECT sample, volume, attempt, sz AS z0, sy AS y0, sx AS x0, f >= 0.45 AS passed, f FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY f >= 0.45 DESC, CASE WHEN f >= 0.45 THEN 0 ELSE f END DESC, attempt) AS r FROM g) WHERE r = 1""",
)
def _(spark, sf):
    """Candidate crops of each sample, gated on content, the first that passes or the best."""
    v = X.voxels(spark, sf).select(*KEYS, "label", "intensity")
    crops = random_crops(spark, sf).select("sample", "volume", "attempt", *(F.col(f"s{a}").alias(f"{a}0") for a in V.AXES))
    g = S.crop_shares(v, crops, (4, 8, 16), fg=F.col("label") > 0, nz=F.col("intensity") != 0)
    g = g.withColumn("f", F.round(F.least("fg", "nz"), 6))
    g = g.withColumn("passed", F.col("f") >= 0.45)
    rank = F.struct("passed", F.when(F.col("passed"), F.lit(0.0)).otherwise(F.col("f")), -F.col("attempt"))
    best = g.groupBy("sample", "volume").agg(F.max_by(F.struct("attempt", "z0", "y0", "x0", "passed", "f"), rank).alias("b"))
    return best.select("sample", "volume", "b.*")


@query("smp_validation_groups", f"{SV} SELECT 'sft' AS task, res_z::DOUBLE AS res_z, count(*) AS n_volumes, min(volume) AS first_volume FROM sv WHERE subset <> 's9' GROUP BY ALL")
def _(spark, sf):
    v = sampled_volumes(spark, sf)
    listed = v.where("subset = 's9'")  # an explicit list; where it is empty, the labelled branch
    some = listed.agg(F.count("*").alias("_n"))
    chosen = listed.unionByName(v.join(F.broadcast(some), F.lit(True)).where("_n = 0").drop("_n"))
    return chosen.groupBy(F.lit("sft").alias("task"), "res_z").agg(F.count("*").alias("n_volumes"), F.min("volume").alias("first_volume"))

"""Queries O-SRC-*, O-PRJ-*, O-FLT-*, O-JN-*, O-WIN-*, O-SET-*, O-AFF-* and
O-BND-* over the voxel table, and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voxloom.operators import affinities as A
from voxloom.operators import neighbors as N
from voxloom.operators import voxels as V
from voxloom.operators.graph import shared_folder
from voxloom.plans.metric_queries import rounded
from voxloom.sources import fixtures as X

QUERIES, SQL = {}, {}
VX = "WITH " + X.VOXELS_SQL
EXT = ", ext AS (SELECT volume, (max(z) + 1)::INT AS dz, (max(y) + 1)::INT AS dy, (max(x) + 1)::INT AS dx, count(*) AS n_voxels FROM voxels GROUP BY ALL)"
KEYS = ["volume", "z", "y", "x"]


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# --- sources ---------------------------------------------------------------


@query("src_catalog_scan", f"{VX}{EXT} SELECT *, volume || '_volume' AS stem, true AS has_seg FROM ext")
def _(spark, sf):
    return V.extents(X.voxels(spark, sf)).withColumn("stem", F.concat("volume", F.lit("_volume"))).withColumn("has_seg", F.lit(True))


CENSUS = """, told AS (SELECT 'vol_' || (o_orderkey // 2048) AS volume, count(*) FILTER (o_totalprice > 330000) AS extra FROM orders GROUP BY ALL),
 census AS (SELECT ext.volume, CAST(replace(ext.volume, 'vol_', '') AS INT) % 5 + 1 AS n, dx, dy, dz, coalesce(extra, 0) // 24 AS extra FROM ext LEFT JOIN told USING (volume))"""


@query("src_census_scan", f"{VX}{EXT}{CENSUS} SELECT volume, n::BIGINT AS n_crops, (n * dx * dy * dz)::BIGINT AS n_voxels, (n * dx * dy * dz + extra)::BIGINT AS stated, extra = 0 AS agrees FROM census")
def _(spark, sf):
    """A census in a CSV file, whose stated counts come from another table and do not always agree."""
    n = F.regexp_replace("volume", "vol_", "").cast("int") % 5 + 1
    told = X.read(spark, sf, "orders").groupBy(F.concat(F.lit("vol_"), F.expr("o_orderkey div 2048")).alias("volume")).agg(F.count_if(F.col("o_totalprice") > 330000).alias("extra"))
    c = V.extents(X.voxels(spark, sf)).join(told, "volume", "left")
    c = c.select("volume", F.format_string("%02d x  %d x %d x %d", n, "dx", "dy", "dz").alias("crops"), (n * F.col("dx") * F.col("dy") * F.col("dz") + F.expr("coalesce(extra, 0) div 24")).cast("bigint").alias("stated"))
    path = f"{shared_folder(spark)}/census-{uuid.uuid4().hex}"
    c.write.option("header", True).csv(path)
    return V.scan_census(spark.read.schema("volume string, crops string, stated bigint").option("header", True).csv(path))


@query("src_region_read", f"{VX} SELECT volume, z, y, x, label FROM voxels WHERE z BETWEEN 1 AND 3 AND y BETWEEN 4 AND 11 AND x BETWEEN 8 AND 39")
def _(spark, sf):
    return V.region(X.voxels(spark, sf), (1, 4, 8), (3, 8, 32)).select(*KEYS, "label")


@query("src_metadata_scan", f"{VX}{EXT} SELECT volume, dz, dy, dx, round(dz * 40.0, 6)::DOUBLE AS nm_z, round(dy * 4.0, 6)::DOUBLE AS nm_y, round(dx * 4.0, 6)::DOUBLE AS nm_x FROM ext")
def _(spark, sf):
    nm = [F.round(F.col(f"d{a}") * F.lit(r), 6).cast("double").alias(f"nm_{a}") for a, r in zip(V.AXES, (40.0, 4.0, 4.0), strict=True)]
    return V.extents(X.voxels(spark, sf)).select("volume", "dz", "dy", "dx", *nm)


@query(
    "src_box_clamp",
    """SELECT p_partkey, greatest(0, least(coalesce(CASE WHEN p_size % 5 > 0 THEN p_partkey % 90 - 10 END, (64 - size) // 2), 64 - size))::BIGINT AS origin, size FROM (SELECT *, least(64, p_size + 8)::BIGINT AS size FROM part)""",
)
def _(spark, sf):
    p = X.read(spark, sf, "part").withColumn("size", F.least(F.lit(64), F.col("p_size") + 8).cast("bigint"))
    wanted = F.when(F.col("p_size") % 5 > 0, F.col("p_partkey") % 90 - 10)
    origin = F.greatest(F.lit(0), F.least(F.coalesce(wanted, F.expr("(64 - size) div 2")), 64 - F.col("size")))
    return p.select("p_partkey", origin.cast("bigint").alias("origin"), "size")


@query(
    "src_subvolume_export",
    f"""{VX}, boxes AS (SELECT DISTINCT volume, 5 AS z0, 28 AS y0, 60 AS x0 FROM voxels), g AS (SELECT volume, z0, y0, x0, a.z::INT AS z, b.y::INT AS y, c.x::INT AS x FROM boxes, range(4) a(z), range(8) b(y), range(8) c(x))
 SELECT g.volume, g.z, g.y, g.x, coalesce(v.label, 0) AS label FROM g LEFT JOIN voxels v ON v.volume = g.volume AND v.z = g.z + z0 AND v.y = g.y + y0 AND v.x = g.x + x0""",
)
def _(spark, sf):
    v = X.voxels(spark, sf)
    boxes = v.select("volume").distinct().selectExpr("volume", "5 AS z0", "28 AS y0", "60 AS x0", "4 AS nz", "8 AS ny", "8 AS nx")
    return V.dense_box(boxes, v, {"label": 0})


@query("src_label_nodata", f"{VX}, m AS (SELECT volume, z, y, x, CASE WHEN label = 7 THEN 0 ELSE label END AS label FROM voxels) SELECT * FROM m WHERE volume IN (SELECT volume FROM m GROUP BY volume HAVING max(label) > 0)")
def _(spark, sf):
    m = X.voxels(spark, sf).select(*KEYS, F.when(F.col("label") == 7, 0).otherwise(F.col("label")).alias("label"))
    return m.join(m.groupBy("volume").agg(F.max("label").alias("top")).where("top > 0"), "volume", "left_semi")


@query("src_axis_orient", f"{VX}{EXT} SELECT v.volume, CASE WHEN t THEN v.x ELSE v.z END AS z, v.y, CASE WHEN t THEN v.z ELSE v.x END AS x, label FROM voxels v JOIN (SELECT volume, CAST(replace(volume, 'vol_', '') AS INT) % 2 = 0 AND dx > greatest(dy, dz) AS t FROM ext) USING (volume)")
def _(spark, sf):
    """Isotropic volumes, those of even number, are turned so that their longest axis is z."""
    v = X.voxels(spark, sf)
    even = F.regexp_replace("volume", "vol_", "").cast("int") % 2 == 0
    longest = F.when(F.col("dz") >= F.greatest("dy", "dx"), "z").when(F.col("dy") >= F.col("dx"), "y").otherwise("x")
    c = V.extents(v).select("volume", F.when(even, longest).otherwise("z").alias("axis"), F.when(even, 8.0).otherwise(40.0).alias("res_z"), F.lit(8.0).alias("res_y"), F.lit(8.0).alias("res_x"))
    return V.orient(v, c).select(*KEYS, "label")


@query("src_z_stride_phase", f"{VX} SELECT volume, z % 3 AS phase, z // 3 AS z, y, x, label, 24.0::DOUBLE AS res_z FROM voxels")
def _(spark, sf):
    return X.voxels(spark, sf).select("volume", (F.col("z") % 3).alias("phase"), F.expr("CAST(z div 3 AS INT)").alias("z"), "y", "x", "label", F.lit(24.0).alias("res_z"))


@query(
    "src_volume_verify",
    f"""{VX}{EXT} SELECT volume, n_ids, round(fg, 6) AS fg, CASE WHEN n_ids > 1 AND fg > 0 THEN 'OK' ELSE 'BAD' END AS status FROM (SELECT v.volume, count(DISTINCT label) AS n_ids, avg((label > 0)::INT) AS fg FROM voxels v JOIN ext e USING (volume)
 WHERE v.z % greatest(1, dz // 4) = 0 AND v.y % greatest(1, dy // 8) = 0 AND v.x % greatest(1, dx // 16) = 0 GROUP BY ALL)""",
)
def _(spark, sf):
    v = X.voxels(spark, sf)
    v = v.join(V.extents(v), "volume").where("z % greatest(1, dz div 4) = 0 AND y % greatest(1, dy div 8) = 0 AND x % greatest(1, dx div 16) = 0")
    g = v.groupBy("volume").agg(F.count_distinct("label").alias("n_ids"), F.avg((F.col("label") > 0).cast("int")).alias("fg"))
    return rounded(g.withColumn("status", F.when((F.col("n_ids") > 1) & (F.col("fg") > 0), "OK").otherwise("BAD")), "fg")


@query(
    "src_stem_codec",
    """SELECT stem, regexp_extract(stem, '_x(\\d+)_y(\\d+)_z(\\d+)', 1)::INT AS x, regexp_extract(stem, '_x(\\d+)_y(\\d+)_z(\\d+)', 2)::INT AS y, regexp_extract(stem, '_x(\\d+)_y(\\d+)_z(\\d+)', 3)::INT AS z,
 regexp_replace(stem, '_x\\d+_y\\d+_z\\d+$', '') AS name FROM (SELECT printf('part_%dnm_x%d_y%d_z%d', p_size, p_partkey % 977, p_partkey % 89, p_partkey % 7) AS stem FROM part)""",
)
def _(spark, sf):
    p = X.read(spark, sf, "part").select(F.format_string("part_%dnm_x%d_y%d_z%d", "p_size", F.col("p_partkey") % 977, F.col("p_partkey") % 89, F.col("p_partkey") % 7).alias("stem"))
    at = [F.regexp_extract("stem", r"_x(\d+)_y(\d+)_z(\d+)", k).cast("int").alias(a) for k, a in ((1, "x"), (2, "y"), (3, "z"))]
    return p.select("stem", *at, F.regexp_replace("stem", r"_x\d+_y\d+_z\d+$", "").alias("name"))


@query(
    "src_versioned_split_catalog",
    f"{VX} SELECT volume, CASE WHEN z < 5 THEN 'train' ELSE 'test' END AS split, v.seg_version, count(*) AS n_voxels, count(DISTINCT CASE WHEN v.seg_version = 'v1' THEN label ELSE pred END) AS n_ids FROM voxels, (VALUES ('v1'), ('v2')) v(seg_version) GROUP BY ALL",
)
def _(spark, sf):
    versions = F.explode(F.array(F.struct(F.lit("v1").alias("seg_version"), F.col("label").alias("id")), F.struct(F.lit("v2").alias("seg_version"), F.col("pred").alias("id"))))
    v = X.voxels(spark, sf).select("volume", F.when(F.col("z") < 5, "train").otherwise("test").alias("split"), versions.alias("s"))
    return v.groupBy("volume", "split", "s.seg_version").agg(F.count("*").alias("n_voxels"), F.count_distinct("s.id").alias("n_ids"))


# --- projections and filters -----------------------------------------------

STATS = ", st AS (SELECT volume, min(intensity) AS lo, max(intensity) AS hi FROM voxels GROUP BY volume)"


@query("prj_minmax_norm", f"{VX}{STATS} SELECT volume, z, y, x, round(CASE WHEN hi > lo THEN (intensity - lo) / (hi - lo) ELSE intensity END, 6) AS norm FROM voxels JOIN st USING (volume)")
def _(spark, sf):
    return rounded(V.minmax_norm(X.voxels(spark, sf)).select(*KEYS, "norm"), "norm")


@query(
    "prj_probe_norm",
    f"""{VX}{EXT} SELECT v.volume, round(min(intensity), 6) AS lo, round(max(intensity), 6) AS hi FROM voxels v JOIN ext e USING (volume) WHERE v.z IN (0, dz // 4, dz // 2, 3 * dz // 4, dz - 1)
 AND v.y >= greatest(0, (dy - 16) // 2) AND v.y < greatest(0, (dy - 16) // 2) + least(dy, 16) AND v.x >= greatest(0, (dx - 16) // 2) AND v.x < greatest(0, (dx - 16) // 2) + least(dx, 16) GROUP BY ALL""",
)
def _(spark, sf):
    return rounded(V.probe_stats(X.voxels(spark, sf), 16), "lo", "hi")


@query("prj_to_uint8", f"{VX}{STATS} SELECT volume, u8, count(*) AS n FROM (SELECT volume, CASE WHEN hi - lo < 1e-8 THEN 0 ELSE floor((intensity - lo) / (hi - lo) * 255) END::INT AS u8 FROM voxels JOIN st USING (volume)) GROUP BY ALL")
def _(spark, sf):
    return V.to_uint8(X.voxels(spark, sf)).groupBy("volume", F.col("u8").cast("int").alias("u8")).agg(F.count("*").alias("n"))


@query("prj_patch_contrast", f"{VX} SELECT volume, z, y, x, round((intensity - min(intensity) OVER w) / greatest(max(intensity) OVER w - min(intensity) OVER w, 1e-5), 6) AS norm FROM voxels WINDOW w AS (PARTITION BY volume, z)")
def _(spark, sf):
    return rounded(V.contrast(X.voxels(spark, sf), ["volume", "z"]).select(*KEYS, "norm"), "norm")


@query("prj_pm1_scale", "SELECT l_orderkey, l_linenumber, round(l_discount * 2 - 1, 6) AS scaled FROM lineitem")
def _(spark, sf):
    return X.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_discount") * 2 - 1, 6).alias("scaled"))


@query("prj_head_slice", "SELECT vec_id, len(embedding[1:len(embedding) - 2])::INT AS n_aff, round(list_sum(embedding[1:len(embedding) - 2]::DOUBLE[]), 4) + 0.0::DOUBLE AS aff_sum, round(embedding[len(embedding) - 1]::DOUBLE, 6) AS sem, round(embedding[len(embedding)]::DOUBLE, 6) AS raw FROM embeddings WHERE len(embedding) >= 3")
def _(spark, sf):
    h = X.read(spark, sf, "embeddings").where(F.size("embedding") >= 3)
    head = F.struct(F.slice("embedding", 1, F.size("embedding") - 2).alias("aff"), F.element_at("embedding", -2).alias("sem"), F.element_at("embedding", -1).alias("raw"))
    h = h.select("vec_id", head.alias("head"))
    total = F.aggregate("head.aff", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return h.select("vec_id", F.size("head.aff").alias("n_aff"), (F.round(total, 4) + F.lit(0.0)).alias("aff_sum"), F.round(F.col("head.sem").cast("double"), 6).alias("sem"), F.round(F.col("head.raw").cast("double"), 6).alias("raw"))


OFFSETS_SQL = "o(idx, oz, oy, ox, kind, name) AS (VALUES " + ", ".join(f"({i}, {a}, {b}, {c}, '{k}', '{n}')" for i, a, b, c, k, n in N.offset_rows()) + ")"


#: offsets that fit into volumes whose last sections are cut off by their number, as a table ot
FITTING = """, cx AS (SELECT volume, dz - CAST(replace(volume, 'vol_', '') AS INT) % 5 AS dz, dy, dx FROM ext),
 ot AS (SELECT volume, idx, kind, name, ((dz - abs(oz)) * (dy - abs(oy)) * (dx - abs(ox)))::BIGINT AS n_pairs FROM cx, o WHERE dz > abs(oz) AND dy > abs(oy) AND dx > abs(ox))"""


def fitting(spark, sf):
    cut_off = F.regexp_replace("volume", "vol_", "").cast("int") % 5
    return N.offset_table(V.extents(X.voxels(spark, sf)).withColumn("dz", F.col("dz") - cut_off))


@query("prj_offset_table", f"{VX}{EXT}, {OFFSETS_SQL}{FITTING} SELECT * FROM ot")
def _(spark, sf):
    """The offsets that fit into each volume, their names, and how many pairs they make."""
    return fitting(spark, sf)


@query("prj_sigmoid_threshold", f"WITH {X.BINARY_PAIR_SQL} SELECT volume, (1 / (1 + exp(-logit)) > 0.5)::INT AS class, truth > 0 AS foreground, count(*) AS n FROM binary_pair WHERE truth <> -100 GROUP BY ALL")
def _(spark, sf):
    b = X.binary_pair(spark, sf).where("truth <> -100")
    return b.groupBy("volume", (V.sigmoid(F.col("logit")) > 0.5).cast("int").alias("class"), (F.col("truth") > 0).alias("foreground")).agg(F.count("*").alias("n"))


@query("prj_axis_slice", f"{VX} SELECT volume, z, y, x, label FROM voxels WHERE z = 6")
def _(spark, sf):
    return V.axis_slice(X.voxels(spark, sf), "z", 99).select(*KEYS, "label")


@query("prj_slice_geometry", f"{VX}{EXT} SELECT volume, round(dy * 4.0 / (dx * 4.0), 6)::DOUBLE AS aspect_z, round(dz * 40.0 / (dx * 4.0), 6)::DOUBLE AS aspect_y, round(dz * 40.0 / (dy * 4.0), 6)::DOUBLE AS aspect_x FROM ext")
def _(spark, sf):
    size = {a: F.col(f"d{a}") * F.lit(r) for a, r in zip(V.AXES, (40.0, 4.0, 4.0), strict=True)}
    pairs = {"aspect_z": ("y", "x"), "aspect_y": ("z", "x"), "aspect_x": ("z", "y")}
    return V.extents(X.voxels(spark, sf)).select("volume", *(F.round(size[p] / size[q], 6).alias(n) for n, (p, q) in pairs.items()))


@query("prj_point_lookup", f"{VX} SELECT volume, label FROM voxels WHERE z = 3 AND y = 31 AND x = 0")
def _(spark, sf):
    v = V.axis_slice(X.voxels(spark, sf), "z", 3)
    return V.axis_slice(V.axis_slice(v, "y", 500), "x", -4).select("volume", "label")


@query("prj_stride_downsample", f"{VX} SELECT volume, z // 2 AS z, y // 2 AS y, x // 2 AS x, (label % 256)::INT AS id8 FROM voxels WHERE z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0")
def _(spark, sf):
    return V.stride_downsample(X.voxels(spark, sf), 2).select(*KEYS, (F.col("label") % 256).cast("int").alias("id8"))


@query("prj_overlay_color", f"{VX}{STATS} SELECT volume, z, y, x, round(0.6 * g + 0.4 * h * CASE WHEN label % 3 = 0 THEN 1 ELSE 0.15 END, 5) AS shade FROM (SELECT *, (intensity - lo) / (hi - lo) AS g, CASE WHEN label = 0 THEN 0 ELSE label * 0.618033988749895 - floor(label * 0.618033988749895) END AS h FROM voxels JOIN st USING (volume))")
def _(spark, sf):
    hue = F.expr("CASE WHEN label = 0 THEN 0D ELSE label * 0.618033988749895D - floor(label * 0.618033988749895D) END")
    v = V.minmax_norm(X.voxels(spark, sf))
    return v.select(*KEYS, F.round(0.6 * F.col("norm") + 0.4 * hue * F.when(F.col("label") % 3 == 0, 1.0).otherwise(0.15), 5).alias("shade"))


@query("prj_mid_slice", f"{VX}{EXT} SELECT v.volume, v.z, y, x, label FROM voxels v JOIN ext USING (volume) WHERE v.z = round_even(0.25 * (dz - 1), 0)")
def _(spark, sf):
    v = X.voxels(spark, sf)
    return v.join(V.extents(v), "volume").where(F.col("z") == F.bround(0.25 * (F.col("dz") - 1), 0)).select(*KEYS, "label")


@query("prj_anisotropy", f"{VX}{EXT} SELECT volume, 40.0::DOUBLE / ((4.0 + 4.0) / 2) AS factor, greatest(dz, dy, dx) / least(dz, dy, dx) < 1.5 AS near_cubic FROM ext")
def _(spark, sf):
    res = {"z": 40.0, "y": 4.0, "x": 4.0}
    return V.extents(X.voxels(spark, sf)).select("volume", (F.lit(res["z"]) / ((F.lit(res["y"]) + F.lit(res["x"])) / 2)).alias("factor"), (F.greatest("dz", "dy", "dx") / F.least("dz", "dy", "dx") < 1.5).alias("near_cubic"))


@query("prj_cast_types", f"{VX} SELECT volume, 0 AS channel, z, y, x, round(intensity::FLOAT::DOUBLE + 1.234e-5, 2) AS image, label::BIGINT AS label FROM voxels")
def _(spark, sf):
    return X.voxels(spark, sf).select("volume", F.lit(0).alias("channel"), "z", "y", "x", F.round(F.col("intensity").cast("float").cast("double") + 1.234e-5, 2).alias("image"), F.col("label").cast("bigint").alias("label"))


@query(
    "prj_offset_select",
    f"{VX}{EXT}, {OFFSETS_SQL}{FITTING} SELECT volume, idx, name FROM (SELECT *, row_number() OVER (PARTITION BY volume, kind ORDER BY idx) - 1 AS k, greatest(1, count(*) OVER (PARTITION BY volume, kind) // 4) AS step FROM ot) WHERE kind = 'pull' OR (k % step = 0 AND k // step < 4)",
)
def _(spark, sf):
    return N.select_offsets(fitting(spark, sf), 4).select("volume", "idx", "name")


@query("flt_undersize_reject", f"{VX}{EXT} SELECT volume FROM ext WHERE dz >= 4 AND dy >= 32 AND dx >= 64")
def _(spark, sf):
    return V.extents(X.voxels(spark, sf)).where("dz >= 4 AND dy >= 32 AND dx >= 64").select("volume")


PATCH = ", pt AS (SELECT *, y // 16 AS py, x // 16 AS px FROM voxels)"


def patches(spark, sf):
    return X.voxels(spark, sf).withColumns({"py": F.expr("CAST(y div 16 AS INT)"), "px": F.expr("CAST(x div 16 AS INT)")})


@query("flt_fg_gate", f"{VX}{PATCH} SELECT volume, py, px, round(least(f, i), 6) AS score FROM (SELECT volume, py, px, avg((label <> 0)::INT) AS f, avg((intensity <> 0)::INT) AS i FROM pt GROUP BY ALL) WHERE f >= 0.7 AND i >= 0.2")
def _(spark, sf):
    g = patches(spark, sf).groupBy("volume", "py", "px").agg(F.avg((F.col("label") != 0).cast("int")).alias("f"), F.avg((F.col("intensity") != 0).cast("int")).alias("i"))
    return g.where("f >= 0.7 AND i >= 0.2").select("volume", "py", "px", F.round(F.least("f", "i"), 6).alias("score"))


@query("flt_nonzero_gate", f"{VX}{PATCH} SELECT volume, py, px, round(avg((intensity <> 0)::INT), 6) AS score FROM pt GROUP BY ALL HAVING avg((intensity <> 0)::INT) >= 0.38")
def _(spark, sf):
    g = patches(spark, sf).groupBy("volume", "py", "px").agg(F.avg((F.col("intensity") != 0).cast("int")).alias("i"))
    return g.where("i >= 0.38").select("volume", "py", "px", F.round("i", 6).alias("score"))


@query(
    "flt_content_gate",
    f"""{VX}{STATS}, b AS (SELECT volume, y // 32 AS py, x // 32 AS px, z // 4 AS bz, (y % 32) // 16 AS by_, (x % 32) // 16 AS bx, stddev_pop((intensity - lo) / (hi - lo)) AS s FROM voxels JOIN st USING (volume) WHERE z < 4 GROUP BY ALL)
 SELECT volume, py, px, round(avg((s >= 0.24)::INT), 6) AS content FROM b GROUP BY ALL HAVING avg((s >= 0.24)::INT) >= 0.5""",
)
def _(spark, sf):
    v = V.minmax_norm(X.voxels(spark, sf)).selectExpr("volume", "CAST(y div 32 AS INT) AS py_", "CAST(x div 32 AS INT) AS px_", "z AS pz", "y % 32 AS py", "x % 32 AS px", "7 AS sz", "32 AS sy", "32 AS sx", "norm")
    c = V.content_fraction(v, ["volume", "py_", "px_"], 0.24)
    return c.where("content >= 0.5").select("volume", F.col("py_").alias("py"), F.col("px_").alias("px"), F.round("content", 6).alias("content"))


@query("flt_fg_ratio", f"{VX}{PATCH} SELECT volume, py, px, round(avg((label > 0)::INT), 6) AS ratio FROM pt GROUP BY ALL")
def _(spark, sf):
    return patches(spark, sf).groupBy("volume", "py", "px").agg(F.round(F.avg((F.col("label") > 0).cast("int")), 6).alias("ratio"))


# --- joins, windows and sets -----------------------------------------------


@query(
    "jn_image_label_pair",
    f"{VX} SELECT i.volume, i.z, i.y, count(*) AS n_image, count(l.label) AS n_label, sum(i.x * coalesce(l.label, 0))::BIGINT AS placed FROM (SELECT * FROM voxels WHERE intensity > 0) i LEFT JOIN (SELECT * FROM voxels WHERE label > 0) l ON i.volume = l.volume AND i.z = l.z AND i.y = l.y AND i.x = l.x GROUP BY ALL",
)
def _(spark, sf):
    """Image voxels beside their labels, summed along x, and by place."""
    v = X.voxels(spark, sf)
    # merged: by its estimate a side with voxels may look small enough to be broadcast
    pairs = v.where("intensity > 0").select(*KEYS).hint("merge").join(v.where("label > 0").select(*KEYS, "label"), KEYS, "left")
    return pairs.groupBy("volume", "z", "y").agg(F.count("*").alias("n_image"), F.count("label").alias("n_label"), F.sum(F.col("x") * F.coalesce("label", F.lit(0))).alias("placed"))


PREFIXES = [("vol_", 40.0), ("vol_1", 30.0), ("vol_3", 8.0), ("vol_30", 6.0)]  # overlapping on purpose


@query(
    "jn_prefix_match",
    f"{VX}, r(prefix, res_z) AS (VALUES {', '.join(f'({chr(39)}{p}{chr(39)}, {r}::DOUBLE)' for p, r in PREFIXES)}) SELECT v.volume, arg_max(prefix, length(prefix)) AS prefix, arg_max(res_z, length(prefix)) AS res_z FROM (SELECT DISTINCT volume FROM voxels) v LEFT JOIN r ON starts_with(v.volume, prefix) GROUP BY ALL",
)
def _(spark, sf):
    return V.longest_prefix(X.voxels(spark, sf).select("volume").distinct(), spark.createDataFrame(PREFIXES, "prefix string, res_z double"))


CUM = ", cum AS (SELECT volume, coalesce(sum(n) OVER (ORDER BY volume ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, sum(n) OVER (ORDER BY volume) AS hi FROM (SELECT volume, count(*) FILTER (label > 0) AS n FROM voxels GROUP BY volume))"


def cumulative(catalog, size="n"):
    """Running totals [lo, hi) over the catalog of volumes, in order of name."""
    from pyspark.sql import Window

    w = Window.orderBy("volume").rowsBetween(Window.unboundedPreceding, 0)
    return catalog.withColumn("hi", F.sum(size).over(w)).withColumn("lo", F.col("hi") - F.col(size))


@query("jn_weighted_pick", f"{VX}{CUM} SELECT e.event_id, c.volume FROM events e JOIN cum c ON (e.event_id * 7919) % (SELECT max(hi) FROM cum) >= lo AND (e.event_id * 7919) % (SELECT max(hi) FROM cum) < hi")
def _(spark, sf):
    c = cumulative(X.voxels(spark, sf).groupBy("volume").agg(F.count_if(F.col("label") > 0).alias("n")))
    # draws and ranges meet in cells of about one range's mean width, by equality
    width = c.agg(F.greatest(F.lit(1), F.floor(F.max("hi") / F.count("*"))).cast("bigint").alias("width"), F.max("hi").alias("total"))
    ranges = c.join(width, F.lit(True)).withColumn("cell", F.explode(F.expr("sequence(lo div width, greatest(lo, hi - 1) div width)")))
    draws = X.read(spark, sf, "events").select("event_id").join(F.broadcast(width), F.lit(True)).withColumn("draw", F.expr("(event_id * 7919) % total")).withColumn("cell", F.expr("draw div width"))
    return draws.select("event_id", "draw", "cell").join(ranges, "cell").where("draw >= lo AND draw < hi").select("event_id", "volume")


NB = f", {OFFSETS_SQL}"
# targets first, then an equality join
NEAR = """(SELECT v.*, o.idx, greatest(0, least(v.z + o.oz, 6)) AS tz, greatest(0, least(v.y + o.oy, 31)) AS ty, greatest(0, least(v.x + o.ox, 63)) AS tx FROM voxels v CROSS JOIN o) v
 JOIN voxels n ON n.volume = v.volume AND n.z = v.tz AND n.y = v.ty AND n.x = v.tx"""


@query("jn_neighbor_join", f"{VX}{NB} SELECT v.volume, v.idx, sum(n.label)::BIGINT AS sum_label, sum((n.label = v.label)::INT)::BIGINT AS n_same FROM {NEAR} GROUP BY ALL")
def _(spark, sf):
    return A.neighbor_sums(A.bricks_of(X.voxels(spark, sf)))


@query(
    "jn_patch_assign",
    f"{VX}, t(y0) AS (VALUES (0), (8), (16)), u(x0) AS (VALUES (0), (16), (32), (48)) SELECT volume, y0, x0, count(*) AS n, sum(label)::BIGINT AS sum_label FROM voxels, t, u WHERE y >= y0 AND y < y0 + 16 AND x >= x0 AND x < x0 + 16 GROUP BY ALL",
)
def _(spark, sf):
    v = X.voxels(spark, sf)
    # the starts of the tiles that hold a coordinate, computed, not joined
    for a, p, s, last in (("y", 16, 8, 16), ("x", 16, 16, 48)):
        v = v.withColumn(f"{a}0", F.explode(F.expr(f"filter(transform(sequence(greatest(0, ({a} - {p}) div {s}), {a} div {s}), k -> k * {s}), k -> k <= {last} AND {a} >= k AND {a} < k + {p})")))
    return v.groupBy("volume", F.col("y0").cast("int").alias("y0"), F.col("x0").cast("int").alias("x0")).agg(F.count("*").alias("n"), F.sum("label").alias("sum_label"))


@query("jn_id_semi_anti", f"{VX}, s AS (SELECT volume, label FROM voxels GROUP BY ALL HAVING count(*) >= 750) SELECT volume, count(*) FILTER (hit) AS n_kept, count(*) FILTER (NOT hit) AS n_killed FROM (SELECT v.volume, s.label IS NOT NULL AS hit FROM voxels v LEFT JOIN s USING (volume, label)) GROUP BY ALL")
def _(spark, sf):
    v = X.voxels(spark, sf)
    large = v.groupBy("volume", "label").count().where("count >= 750")
    kept = v.join(large, ["volume", "label"], "left_semi").groupBy("volume").agg(F.count("*").alias("n_kept"))
    killed = v.join(large, ["volume", "label"], "left_anti").groupBy("volume").agg(F.count("*").alias("n_killed"))
    return kept.join(killed, "volume", "full").select("volume", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), F.coalesce("n_killed", F.lit(0)).alias("n_killed"))


@query("win_cumulative_voxels", f"{VX}{CUM} SELECT volume, lo::BIGINT AS lo, hi::BIGINT AS hi FROM cum")
def _(spark, sf):
    return cumulative(X.voxels(spark, sf).groupBy("volume").agg(F.count_if(F.col("label") > 0).alias("n"))).select("volume", "lo", "hi")


ATT = """, att AS (SELECT volume, z, y // 8 AS attempt, avg((label > 0)::INT) AS f FROM voxels GROUP BY ALL)"""


def first_pass_else_best(attempts, by, passed, score="f", attempt="attempt"):
    """Per group the first attempt that passed, else the best, the first of equals."""
    rank = F.struct(passed.cast("int"), F.when(passed, F.lit(0.0)).otherwise(F.col(score)), -F.col(attempt))
    return attempts.withColumn("_p", passed).groupBy(*by).agg(F.max_by(F.struct(attempt, F.col("_p").alias("passed"), score), rank).alias("_b")).select(*by, "_b.*")


@query("win_first_pass_else_best", f"{VX}{ATT} SELECT volume, z, attempt, f >= 0.93 AS passed, round(f, 6) AS f FROM (SELECT *, row_number() OVER (PARTITION BY volume, z ORDER BY f >= 0.93 DESC, CASE WHEN f >= 0.93 THEN 0 ELSE f END DESC, attempt) AS r FROM att) WHERE r = 1")
def _(spark, sf):
    a = X.voxels(spark, sf).groupBy("volume", "z", F.expr("CAST(y div 8 AS INT)").alias("attempt")).agg(F.avg((F.col("label") > 0).cast("int")).alias("f"))
    return rounded(first_pass_else_best(a, ["volume", "z"], F.col("f") >= 0.93), "f")


@query("win_relabel_consecutive", f"{VX}, d AS (SELECT volume, pred, row_number() OVER (PARTITION BY volume ORDER BY pred) AS dense_id FROM (SELECT DISTINCT volume, pred FROM voxels WHERE pred > 0)) SELECT volume, pred, coalesce(dense_id, 0) AS dense_id, count(*) AS n FROM voxels LEFT JOIN d USING (volume, pred) GROUP BY ALL")
def _(spark, sf):
    return V.dense_ids(X.voxels(spark, sf), ["volume"], "pred").groupBy("volume", "pred", "dense_id").agg(F.count("*").alias("n"))


@query(
    "win_nearest_surviving",
    f"{VX}, s AS (SELECT DISTINCT volume, z, (z + length(volume)) % 3 = 0 AS dropped FROM voxels) SELECT a.volume, a.z, a.dropped, arg_min(b.z, abs(a.z - b.z) * 1000 + b.z) AS source_z FROM s a JOIN s b ON a.volume = b.volume AND NOT b.dropped GROUP BY ALL",
)
def _(spark, sf):
    s = X.voxels(spark, sf).select("volume", "z").distinct().withColumn("dropped", (F.col("z") + F.length("volume")) % 3 == 0)
    return V.nearest_surviving(s)


@query("win_best_depth", f"{VX} SELECT volume, arg_max(z, n * 1000 - z) AS best_z, round(arg_max(z, n * 1000 - z) / max(z), 6) AS depth_frac FROM (SELECT volume, z, count(*) FILTER (label > 0) AS n FROM voxels GROUP BY ALL) GROUP BY ALL")
def _(spark, sf):
    return rounded(V.best_depth(X.voxels(spark, sf)), "depth_frac")


@query("win_group_weight_norm", f"{VX}, g AS (SELECT volume, 'b' || count(*) FILTER (label > 0) % 2 AS branch, 1.0 + count(DISTINCT label) % 4 AS mult FROM voxels GROUP BY ALL) SELECT volume, branch, greatest(2, round_even(500 * 1.5 * mult / avg(mult) OVER (PARTITION BY branch), 0))::BIGINT AS length FROM g")
def _(spark, sf):
    from voxloom.operators.sampling import group_lengths

    g = X.voxels(spark, sf).groupBy("volume").agg(F.concat(F.lit("b"), F.count_if(F.col("label") > 0) % 2).alias("branch"), (F.lit(1.0) + F.count_distinct("label") % 4).alias("mult"))
    return group_lengths(g, "branch", "mult", 500, 1.5, 2).select("volume", "branch", "length")


@query("set_group_concat", f"{VX} SELECT g, volume, count(*) AS n, count(label) AS n_label FROM (SELECT 0 AS g, volume, z, label FROM voxels WHERE label > 0 UNION ALL SELECT 1 AS g, volume, z, NULL AS label FROM voxels WHERE label = 0) GROUP BY ALL")
def _(spark, sf):
    v = X.voxels(spark, sf)
    a = v.where("label > 0").select(F.lit(0).alias("g"), "volume", "z", "label")
    b = v.where("label = 0").select(F.lit(1).alias("g"), "volume", "z")
    return a.unionByName(b, allowMissingColumns=True).groupBy("g", "volume").agg(F.count("*").alias("n"), F.count("label").alias("n_label"))


@query("set_mutex_union", f"{VX} SELECT DISTINCT volume, least(label, pred) AS a, greatest(label, pred) AS b FROM voxels WHERE label <> pred")
def _(spark, sf):
    v = X.voxels(spark, sf)
    pair = lambda d: d.select("volume", F.least("label", "pred").alias("a"), F.greatest("label", "pred").alias("b"))
    return pair(v.where("label < pred")).union(pair(v.where("label > pred"))).distinct()


@query("set_roots_union", f"{VX} SELECT DISTINCT root FROM (SELECT 'data/' || volume AS root FROM voxels UNION ALL SELECT 'data/vol_0' UNION ALL SELECT 'data/default')")
def _(spark, sf):
    named = X.voxels(spark, sf).select(F.concat(F.lit("data/"), "volume").alias("root"))
    return named.union(spark.createDataFrame([("data/vol_0",), ("data/default",)], "root string")).distinct()


# --- affinities and boundaries ---------------------------------------------

PAIRS = f", pr AS (SELECT v.volume, v.z, v.y, v.x, v.idx, (n.label = v.label)::INT AS target, (n.label > 0 AND v.label > 0)::INT AS valid FROM {NEAR})"


@query("aff_target", f"{VX}{NB}{PAIRS} SELECT volume, z, y, idx, sum(target)::BIGINT AS n_same, sum(target * (x + 1) * (x + 1))::BIGINT AS placed FROM pr GROUP BY ALL")
def _(spark, sf):
    """Every voxel's targets, summed along x, and by place so that a shift shows."""
    return A.line_sums(A.bricks_of(X.voxels(spark, sf))).withColumnRenamed("n", "n_same")


@query("aff_valid", f"{VX}{NB}{PAIRS} SELECT volume, z, y, x, sum(valid)::BIGINT AS n_valid FROM pr GROUP BY ALL")
def _(spark, sf):
    return A.valid_counts(A.bricks_of(X.voxels(spark, sf)))


@query("aff_profile", f"{VX}{NB}{PAIRS} SELECT volume, idx, round(p, 6) AS positive, n_valid::BIGINT AS n_valid, round(least(0.5 / greatest(1e-7, least(1 - 1e-7, p)), 10), 6) AS w_pos, round(least(0.5 / (1 - greatest(1e-7, least(1 - 1e-7, p))), 10), 6) AS w_neg FROM (SELECT volume, idx, sum(target * valid) / greatest(sum(valid), 1) AS p, sum(valid) AS n_valid FROM pr GROUP BY ALL)")
def _(spark, sf):
    return rounded(A.profile(A.bricks_of(X.voxels(spark, sf))), "positive", "w_pos", "w_neg")


def boundary_sql(axes, mode="TRUE"):
    terms = [f"coalesce({f}(label) OVER (PARTITION BY volume, {', '.join(b for b in 'zyx' if b != a)} ORDER BY {a}), label) <> label" for a in axes for f in ("lag", "lead")]
    return f", bd AS (SELECT *, ({' OR '.join(terms)}) AND {mode} AS boundary FROM voxels)"


@query("bnd_mask", f"{VX}{boundary_sql('zyx', 'label > 0')} SELECT volume, z, y, x, boundary FROM bd")
def _(spark, sf):
    return N.boundary_mask(X.voxels(spark, sf)).select(*KEYS, "boundary")


@query("bnd_mask_outer_xy", f"{VX}{boundary_sql('yx', 'label = 0')} SELECT volume, z, y, x, boundary FROM bd")
def _(spark, sf):
    return N.boundary_mask(X.voxels(spark, sf), "outer", 1, True).select(*KEYS, "boundary")


ERODE = "{b}, kept AS (SELECT volume, label, bool_or(NOT boundary) AS ok FROM bd GROUP BY ALL), er AS (SELECT bd.*, CASE WHEN boundary AND ok THEN 0 ELSE label END AS eroded FROM bd JOIN kept USING (volume, label))"


@query("bnd_erode", f"{VX}{ERODE.format(b=boundary_sql('yx', 'label > 0'))} SELECT volume, z, y, x, eroded FROM er")
def _(spark, sf):
    return N.boundary_erode(X.voxels(spark, sf), xy_only=True).select(*KEYS, "eroded")


@query("bnd_sem_label_copy", f"{VX}{ERODE.format(b=boundary_sql('zyx', 'label > 0'))} SELECT volume, label, count(*) AS n, sum((eroded > 0)::INT)::BIGINT AS n_sem FROM er GROUP BY ALL")
def _(spark, sf):
    e = N.boundary_erode(X.voxels(spark, sf))
    return e.groupBy("volume", "label").agg(F.count("*").alias("n"), F.sum((F.col("eroded") > 0).cast("bigint")).alias("n_sem"))


@query("set_lost_ids", f"{VX}{boundary_sql('zyx', 'label > 0')} SELECT DISTINCT volume, label FROM bd WHERE label > 0 EXCEPT SELECT DISTINCT volume, label FROM bd WHERE label > 0 AND NOT boundary")
def _(spark, sf):
    b = N.boundary_mask(X.voxels(spark, sf)).where("label > 0")
    return b.select("volume", "label").distinct().join(b.where("NOT boundary").select("volume", "label").distinct(), ["volume", "label"], "left_anti")

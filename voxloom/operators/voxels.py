"""Projections, filters and layout of voxel rows (volume, z, y, x, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def extents(voxels: DataFrame) -> DataFrame:
    """The catalog: (volume, dz, dy, dx, n_voxels), from coordinates alone."""
    return voxels.groupBy("volume").agg(*(F.max(F.col(a) + 1).cast("int").alias(f"d{a}") for a in AXES), F.count("*").alias("n_voxels"))


def with_stats(voxels: DataFrame, by: list[str], value: str = "intensity") -> DataFrame:
    """``voxels`` with lo and hi of ``value`` per group: an aggregate joined back,
    so that rows of a large volume are never sorted into one window."""
    stats = voxels.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return voxels.join(stats.hint("shuffle_hash"), by)  # never the rows broadcast, whatever the estimate


def minmax_norm(voxels: DataFrame, value: str = "intensity") -> DataFrame:
    """(v - min) / (max - min) per volume; unchanged where max <= min."""
    v = F.col(value)
    return with_stats(voxels, ["volume"], value).withColumn("norm", F.when(F.col("hi") > F.col("lo"), (v - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(v)).drop("lo", "hi")


def probe_stats(voxels: DataFrame, window: int = 512, value: str = "intensity") -> DataFrame:
    """(volume, lo, hi) from five sections (first, quarters, last) and a centred
    window of ``window`` voxels in y and x."""
    v = voxels.join(extents(voxels), "volume")
    inside = lambda a: (F.col(a) >= F.expr(f"greatest(0, (d{a} - {window}) div 2)")) & (F.col(a) < F.expr(f"greatest(0, (d{a} - {window}) div 2) + least(d{a}, {window})"))
    section = F.expr("array_contains(array(0, dz div 4, dz div 2, 3 * dz div 4, dz - 1), z)")
    return v.where(section & inside("y") & inside("x")).groupBy("volume").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def to_uint8(voxels: DataFrame, value: str = "intensity") -> DataFrame:
    """0..255 per volume, cut off, zeros where the range is under 1e-8."""
    scaled = F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255)
    return with_stats(voxels, ["volume"], value).withColumn("u8", F.when(F.col("hi") - F.col("lo") < 1e-8, 0).otherwise(scaled).cast("smallint")).drop("lo", "hi")


def contrast(rows: DataFrame, by: list[str], value: str = "intensity") -> DataFrame:
    """Min-max per image, the range taken as 1e-5 at least."""
    return with_stats(rows, by, value).withColumn("norm", (F.col(value) - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-5))).drop("lo", "hi")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clamped(index: int, size: str) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(index), F.col(size) - 1))


def axis_slice(voxels: DataFrame, axis: str, index: int) -> DataFrame:
    """The voxels of one section; the index is clamped into each volume."""
    return voxels.join(extents(voxels).select("volume", f"d{axis}"), "volume").where(F.col(axis) == clamped(index, f"d{axis}")).drop(f"d{axis}")


def stride_downsample(voxels: DataFrame, k: int) -> DataFrame:
    """Every k-th voxel along each axis, with its new coordinates."""
    kept = voxels.where(" AND ".join(f"{a} % {k} = 0" for a in AXES))
    return kept.withColumns({a: F.expr(f"{a} div {k}") .cast("int") for a in AXES})


def region(voxels: DataFrame, start: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """A box: range predicates that reach the scan."""
    for a, s, n in zip(AXES, start, size, strict=True):
        voxels = voxels.where((F.col(a) >= s) & (F.col(a) < s + n))
    return voxels


def dense_box(boxes: DataFrame, voxels: DataFrame, fill: dict) -> DataFrame:
    """Every voxel of each box (volume, z0, y0, x0, nz, ny, nx), at coordinates
    relative to the box; those that the volume lacks get ``fill``."""
    grid = boxes
    for a in AXES:
        grid = grid.withColumn(f"_{a}", F.explode(F.expr(f"sequence(0, n{a} - 1)"))).withColumn(a, F.col(f"_{a}") + F.col(f"{a}0"))
    joined = grid.join(voxels.select("volume", *AXES, *fill), ["volume", *AXES], "left")
    return joined.select("volume", *(F.col(f"_{a}").alias(a) for a in AXES), *(F.coalesce(c, F.lit(v)).alias(c) for c, v in fill.items()))


def content_fraction(patches: DataFrame, keys: list[str], threshold: float, block: tuple[int, int, int] = (4, 16, 16), value: str = "norm") -> DataFrame:
    """(keys, content): the share of whole blocks of a patch whose population
    standard deviation, on values clipped to [0, 1], reaches ``threshold``. A
    patch smaller than a block is one block. Rows hold coordinates in the patch
    (pz, py, px) and its size (sz, sy, sx)."""
    whole = " AND ".join(f"s{a} >= {b}" for a, b in zip(AXES, block, strict=True))
    trimmed = " AND ".join(f"p{a} < s{a} div {b} * {b}" for a, b in zip(AXES, block, strict=True))
    rows = patches.withColumn("_fits", F.expr(whole)).where(f"NOT _fits OR ({trimmed})")
    ids = [F.expr(f"CASE WHEN _fits THEN p{a} div {b} ELSE 0 END").alias(f"_b{a}") for a, b in zip(AXES, block, strict=True)]
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value))).alias("_v")
    stds = rows.select(*keys, *ids, v).groupBy(*keys, "_bz", "_by", "_bx").agg(F.stddev_pop("_v").alias("_s"))
    return stds.groupBy(*keys).agg(F.avg((F.col("_s") >= threshold).cast("double")).alias("content"))


def best_depth(voxels: DataFrame, label: str = "label") -> DataFrame:
    """(volume, best_z, depth_frac): the section with most foreground, the first
    of equals, and its place between 0 and 1; null if there is none."""
    n = voxels.groupBy("volume", "z").agg(F.count_if(F.col(label) > 0).alias("n"))
    best = n.groupBy("volume").agg(F.max("z").alias("_last"), F.max_by("z", F.struct(F.col("n"), -F.col("z"))).alias("_z"), F.max("n").alias("_n"))
    z = F.when(F.col("_n") > 0, F.col("_z"))
    return best.select("volume", z.alias("best_z"), (z / F.greatest(F.col("_last"), F.lit(1))).alias("depth_frac"))


def nearest_surviving(sections: DataFrame, dropped: str = "dropped") -> DataFrame:
    """``sections`` (volume, z, dropped) with source_z: the section itself, or
    for a dropped one the nearest that is not, the lower of two as near."""
    own = F.when(~F.col(dropped), F.col("z"))
    w = Window.partitionBy("volume").orderBy("z")
    below = F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first(own, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    nearest = F.when(below.isNull(), above).when(above.isNull(), below).when(F.col("z") - below <= above - F.col("z"), below).otherwise(above)
    return sections.withColumn("source_z", nearest)


def dense_ids(rows: DataFrame, by: list[str], column: str, name: str = "dense_id") -> DataFrame:
    """``rows`` with ids renumbered 1.. in order per group, 0 staying 0. Only the
    distinct ids of a group are ranked, not its rows."""
    ids = rows.where(F.col(column) > 0).select(*by, column).distinct()
    ranked = ids.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(column)).cast("bigint"))
    return rows.join(ranked, [*by, column], "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))


#: fixed values: names of data sets in volumes' stems, by pattern, and the domain
#: they stand for (null: what the pattern's group holds); the first that fits counts
SUBSETS = [
    (r"^(AC\d+)_", None),
    (r"^neur(?:ons|ite)", "neurons"),
    (r"^minnie65", "minnie65"),
    (r"^cremi3d_sample_[A-Za-z]+\+", "cremi3d_test"),
    (r"^cremi3d_sample_[A-Za-z]", "cremi3d"),
    (r"^(flyem3d_(?:hemibrain|malecns))", None),
    (r"^flyem3d_\d+nm_ssl", "flyem3d_fib25_ssl"),
    (r"^flyem3d", "flyem3d_fib25"),
    (r"^(jrc_[A-Za-z0-9-]+?)_\d+x\d", None),
    (r"^(mitoem2_[a-z]+)_(?:train|test)\d", None),
    (r"^(.*?)_x\d+_y\d+_z\d", None),
]
KIND_SUFFIXES = ("_volume", "_segmentation")  # fixed values, taken off one after the other


def derive_subset(stem: Column, rules=SUBSETS) -> Column:
    """The domain of a volume's stem, without the suffixes of its kind: by the first
    of ``rules`` that fits, or the stem itself."""
    for suffix in KIND_SUFFIXES:
        stem = F.when(F.endswith(stem, F.lit(suffix)), F.substring(stem, F.lit(1), F.length(stem) - len(suffix))).otherwise(stem)
    found = [F.when(F.regexp_like(stem, F.lit(p)), F.regexp_extract(stem, p, 1) if name is None else F.lit(name)) for p, name in rules]
    return F.coalesce(*found, stem)


def orient(voxels: DataFrame, catalog: DataFrame) -> DataFrame:
    """``voxels`` turned so that the axis that ``catalog`` (volume, axis, res_z, res_y,
    res_x) names becomes z, and z that one. Only isotropic volumes can be turned;
    another axis than z for others is an error."""
    c = catalog.select("volume", "axis", ((F.col("res_z") == F.col("res_y")) & (F.col("res_y") == F.col("res_x"))).alias("_iso"))
    v = voxels.join(c, "volume")
    fine = F.col("_iso") | (F.col("axis") == "z")
    v = v.where(F.when(fine, True).otherwise(F.raise_error(F.concat(F.lit("an anisotropic volume can't be turned: "), "volume")).cast("boolean")))
    turned = {a: F.when(F.col("axis") == a, F.col("z")).otherwise(F.col(a)) for a in ("y", "x")}
    z = F.when(F.col("axis") == "y", F.col("y")).when(F.col("axis") == "x", F.col("x")).otherwise(F.col("z"))
    return v.select(*(z.alias(n) if n == "z" else turned[n].alias(n) if n in turned else F.col(n) for n in voxels.columns))


def scan_census(census: DataFrame) -> DataFrame:
    """(volume, n_crops, n_voxels, stated, agrees) of a census (volume, crops: text
    like ``04 x 64 x 32 x 7``, stated): the voxels that the text makes against the count stated."""
    p = [F.trim(F.split("crops", "x")[k]).cast("bigint") for k in range(4)]
    product = p[0] * p[1] * p[2] * p[3]
    return census.select("volume", p[0].alias("n_crops"), product.alias("n_voxels"), "stated", (product == F.col("stated")).alias("agrees"))


def longest_prefix(rows: DataFrame, table: DataFrame, name: str = "volume") -> DataFrame:
    """``rows`` with the columns of ``table`` (prefix, ...) whose prefix is the
    longest one that starts the name. Names are cut to each length that occurs
    among prefixes, and matched by equality."""
    others = [c for c in table.columns if c != "prefix"]
    lengths = table.agg(F.collect_set(F.length("prefix")).alias("_lengths"))
    names = rows.select(name).distinct()
    tries = names.join(lengths, F.lit(True), "left").select(name, F.explode_outer("_lengths").alias("_n")).select(name, F.substring(F.col(name), F.lit(1), F.col("_n")).alias("prefix")).where(F.length("prefix") > 0).distinct()
    best = tries.join(table, "prefix").groupBy(name).agg(F.max_by(F.struct("prefix", *others), F.length("prefix")).alias("_m"))
    return rows.join(best.select(name, "_m.*"), name, "left")

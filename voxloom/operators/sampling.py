"""Balanced sampling schedules and patch manifests. All draws are hashes of a
seed and keys, so they do not depend on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


DRAW_BITS = 48


def draw_bits(seed: int, *keys) -> Column:
    """A whole number below 2^48 from the seed and the keys: the first bits of
    the MD5 of them, joined by colons. Any engine can draw the same."""
    text = F.concat_ws(":", F.lit(str(seed)), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DRAW_BITS // 4), 16, 10).cast("bigint")


def draw(seed: int, *keys) -> Column:
    """A number in [0, 1) from the seed and the keys."""
    return draw_bits(seed, *keys) / F.lit(float(1 << DRAW_BITS))


def draw_int(n: Column, seed: int, *keys) -> Column:
    """An integer in [0, n) from the seed and the keys."""
    return F.pmod(draw_bits(seed, *keys), n)


def draw_sql(seed: int, *keys: str) -> str:
    """DuckDB: ``draw_bits`` of the given expressions."""
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(keys)})), 1, {DRAW_BITS // 4}))::BIGINT"


def group_lengths(groups: DataFrame, branch: str, mult: str, num_samples: int, weight: float, batch_size: int) -> DataFrame:
    """``groups`` with length: the samples of a group, by its multiplier over the
    branch's mean, a batch at least."""
    mean = F.avg(mult).over(Window.partitionBy(branch))
    mean = F.when(mean <= 0, 1.0).otherwise(mean)
    return groups.withColumn("length", F.greatest(F.lit(batch_size), F.bround(F.lit(num_samples * weight) * F.col(mult) / mean, 0)).cast("bigint"))


def balance_groups(volumes: DataFrame, policy: str, weights: DataFrame | None = None) -> DataFrame:
    """One row per group: (grp, n_volumes, mult) by resolution, by subset (and
    resolution, with weights (subset, mult)) or by volume (its sample_weight)."""
    res = F.concat_ws("x", *(F.col(f"res_{a}").cast("string") for a in "zyx"))
    if policy == "resolution":
        return volumes.groupBy(res.alias("grp")).agg(F.count("*").alias("n_volumes")).withColumn("mult", F.lit(1.0))
    if policy == "subset":
        g = volumes.groupBy("subset", res.alias("res")).agg(F.count("*").alias("n_volumes"))
        g = g.join(weights, "subset", "left") if weights is not None else g.withColumn("mult", F.lit(None).cast("double"))
        return g.select(F.concat_ws("|", "subset", "res").alias("grp"), "n_volumes", F.coalesce("mult", F.lit(1.0)).alias("mult"))
    return volumes.select(F.col("volume").alias("grp"), F.lit(1).cast("bigint").alias("n_volumes"), F.coalesce("sample_weight", F.lit(1.0)).alias("mult"))


def schedule(groups: DataFrame, seed: int | None = None) -> DataFrame:
    """Batches (grp, batch, step, item) of groups (grp, length, batch_size):
    length div batch_size batches each. Without a seed, groups follow one another
    and items wrap around; with one, steps are shuffled by hash and items drawn
    with replacement."""
    b = groups.withColumn("batch", F.explode(F.expr("sequence(0, CAST(length div batch_size AS INT) - 1)"))).where("length >= batch_size")
    b = b.withColumn("item_no", F.explode(F.expr("sequence(0, CAST(batch_size AS INT) - 1)")))
    if seed is None:
        order = F.struct("grp", "batch")
        item = F.expr("(batch * batch_size + item_no) % length")
    else:
        order = F.struct(draw_bits(seed, "grp", "batch"), "grp", "batch")
        item = draw_int(F.col("length"), seed + 1, "grp", "batch", "item_no")
    return b.select("grp", "batch", order.alias("order"), "item_no", item.cast("bigint").alias("item"))


def random_crops(volumes: DataFrame, patch: tuple[int, int, int], attempts: int, seed: int) -> DataFrame:
    """``volumes`` (sample, volume, dz, dy, dx) with attempt and start (sz, sy,
    sx), uniform in [0, D - p] per axis."""
    c = volumes.withColumn("attempt", F.explode(F.expr(f"sequence(0, {attempts - 1})")))
    for a, p in zip("zyx", patch, strict=True):
        c = c.withColumn(f"s{a}", draw_int(F.greatest(F.col(f"d{a}") - p + 1, F.lit(1)), seed, "sample", F.lit(a), "attempt").cast("int"))
    return c


def crop_shares(voxels: DataFrame, crops: DataFrame, patch: tuple[int, int, int], **kinds: Column) -> DataFrame:
    """``crops`` (..., volume, z0, y0, x0) with, for each of ``kinds``, the share of the
    crop's voxels for which it is true; crops without voxels are left out. Voxels
    are gathered by line, and a crop meets its lines, not its voxels."""
    lines = voxels.groupBy("volume", "z", "y").agg(F.collect_list("x").alias("_all"), *(F.collect_list(F.when(k, F.col("x"))).alias(name) for name, k in kinds.items()))
    c = crops
    for a, p in zip("zy", patch[:2], strict=True):
        c = c.withColumn(a, F.explode(F.expr(f"sequence({a}0, {a}0 + {p} - 1)")))
    inside = lambda column: F.sum(F.expr(f"size(filter({column}, x -> x >= x0 AND x < x0 + {patch[2]}))"))
    # merged: lines of crops look few before they are counted
    met = c.hint("merge").join(lines, ["volume", "z", "y"]).groupBy(*crops.columns).agg(inside("_all").alias("_n"), *(inside(name).alias(name) for name in kinds))
    return met.where("_n > 0").withColumns({name: F.col(name) / F.col("_n") for name in kinds}).drop("_n")

"""Segmentation metrics from sparse contingency tables.

Tables are (volume, true_id, pred_id, n); nothing is densified, so ids may be as
many as a volume holds. Voxels are aggregated once, map-side first, and all
metrics follow from the cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(pairs: DataFrame, true_col: str = "true_id", pred_col: str = "pred_id", by: str = "volume", ignore_background: bool = True) -> DataFrame:
    """Count voxels by (volume, true, pred). Null ids count as background. With
    ``ignore_background`` the cell of voxels that are background in both counts 0:
    it weighs nothing, but a volume of such voxels alone still has its row."""
    t, p = F.coalesce(F.col(true_col), F.lit(0)).alias("true_id"), F.coalesce(F.col(pred_col), F.lit(0)).alias("pred_id")
    n = F.count_if(F.expr("true_id > 0 OR pred_id > 0")) if ignore_background else F.count("*")
    return pairs.select(F.col(by).alias("volume"), t, p).groupBy("volume", "true_id", "pred_id").agg(n.alias("n"))


def _marginals(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cell counts summed by true and by predicted id."""
    cells = cells.where("n > 0")
    return (
        cells.groupBy("volume", "true_id").agg(F.sum("n").alias("n_true"), F.count("*").alias("k_true")),
        cells.groupBy("volume", "pred_id").agg(F.sum("n").alias("n_pred"), F.count("*").alias("k_pred")),
    )


def ari(cells: DataFrame) -> DataFrame:
    """(volume, ari): adjusted Rand index, not under 0; 0 for a volume without
    counted voxels. Pair counts are doubles: they leave 64-bit integers at some
    4e9 voxels."""
    pairs = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2
    by_true, by_pred = _marginals(cells)
    a = cells.groupBy("volume").agg(F.sum(pairs("n")).alias("both"), F.sum("n").alias("total"))
    b = by_true.groupBy("volume").agg(F.sum(pairs("n_true")).alias("t"))
    c = by_pred.groupBy("volume").agg(F.sum(pairs("n_pred")).alias("p"))
    expected = F.col("t") * F.col("p") / F.nullif(pairs("total"), F.lit(0.0))
    top, bottom = F.col("both") - expected, (F.col("t") + F.col("p")) / 2 - expected
    value = F.when(F.col("total") == 0, F.lit(0.0)).when(F.col("total") < 2, F.lit(1.0)).when(bottom == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), top / F.nullif(bottom, F.lit(0.0))))
    return a.join(b, "volume", "left").join(c, "volume", "left").select("volume", value.alias("ari"))


def voi(cells: DataFrame) -> DataFrame:
    """(volume, voi_split, voi_merge, voi_total): H(pred | true), H(true | pred)
    in bits and their sum; 0 for a volume without counted voxels."""
    by_true, by_pred = _marginals(cells)
    total = cells.groupBy("volume").agg(F.sum("n").alias("total"))
    joined = cells.where("n > 0").join(by_true, ["volume", "true_id"]).join(by_pred, ["volume", "pred_id"])
    sums = joined.groupBy("volume").agg(
        F.sum(-F.col("n") * F.log2(F.col("n") / F.col("n_true"))).alias("s"), F.sum(-F.col("n") * F.log2(F.col("n") / F.col("n_pred"))).alias("m")
    )
    split, merge = (F.coalesce(F.col(c) / F.nullif("total", F.lit(0)), F.lit(0.0)) for c in ("s", "m"))
    return total.join(sums, "volume", "left").select("volume", split.alias("voi_split"), merge.alias("voi_merge"), (split + merge).alias("voi_total"))


def pooled(cells: DataFrame) -> DataFrame:
    """One table of all volumes: ids of different volumes stay different."""
    own = lambda c: F.struct("volume", F.col(c).alias("id")).alias(c)
    return cells.select(F.lit("all").alias("volume"), own("true_id"), own("pred_id"), "n")


def ted(cells: DataFrame) -> DataFrame:
    """(volume, splits, merges, ted): predicted pieces beyond the first of each
    true id, and the other way round; id 0 is a segment like others. A volume
    without counted voxels has none."""
    by_true, by_pred = _marginals(cells)
    s = by_true.groupBy("volume").agg(F.sum(F.col("k_true") - 1).alias("splits"))
    m = by_pred.groupBy("volume").agg(F.sum(F.col("k_pred") - 1).alias("merges"))
    every = cells.select("volume").distinct().join(s, "volume", "left").join(m, "volume", "left")
    splits, merges = F.coalesce("splits", F.lit(0)), F.coalesce("merges", F.lit(0))
    return every.select("volume", splits.alias("splits"), merges.alias("merges"), (splits + merges).alias("ted"))


NEGLIGIBLE = 1e-25  # of the likeliest cell size's probability
GRID = 512  # distinct marginals on each side of a block of pairs


def _expected_terms(a: np.ndarray, b: np.ndarray, times: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The expected mutual information (nats) that pairs of marginals a and b add,
    each ``times`` over, by the hypergeometric sum over the cell's size.

    All pairs go together, from the likeliest size up and then down, by the ratio
    of neighbouring probabilities; these need no factorials, as their sum is one.
    A pair is left where its terms have become negligible: a sum is as long as the
    root of a segment."""
    x, y, t = (np.asarray(v, float) for v in (a, b, n))
    low, high = np.maximum(0.0, x + y - t), np.minimum(x, y)
    mode = np.clip(np.floor((x + 1) * (y + 1) / (t + 2)), low, high)

    def gain(m, x, y, t):
        return m / t * np.log(np.maximum(t * m, 1e-300) / (x * y))

    total, out = np.ones(len(x)), gain(mode, x, y, t)
    for up in (True, False):
        at, m, r = np.arange(len(x)), mode.copy(), np.ones(len(x))
        while len(at):
            p, q, s = x[at], y[at], t[at]
            r = r * ((p - m) * (q - m) / ((m + 1) * (s - p - q + m + 1)) if up else m * (s - p - q + m) / ((p - m + 1) * (q - m + 1)))
            m = m + 1 if up else m - 1
            on = (r > NEGLIGIBLE) & (m <= high[at] if up else m >= low[at])
            at, m, r = at[on], m[on], r[on]
            total[at] += r
            out[at] += gain(m, x[at], y[at], t[at]) * r
    return out / total * times


def ami(cells: DataFrame) -> DataFrame:
    """(volume, ami): adjusted mutual information with the arithmetic mean as its
    normaliser, not under 0; 0 for a volume without counted voxels. The expectation is summed over the different sizes
    of marginals and how often each pair of sizes occurs; the log-factorials,
    which Spark SQL lacks, are computed in batches."""
    by_true, by_pred = _marginals(cells)
    every = cells.groupBy("volume").agg(F.sum("n").alias("total"))
    total, cells = every.where("total > 0"), cells.where("n > 0")
    sizes_t = by_true.groupBy("volume", "n_true").agg(F.count("*").alias("c_true"))
    sizes_p = by_pred.groupBy("volume", "n_pred").agg(F.count("*").alias("c_pred"))

    @F.pandas_udf("double")
    def expected(a: pd.Series, ca: pd.Series, b: pd.Series, cb: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for x, cx, y, cy, t in zip(a, ca, b, cb, n, strict=True):
            i, j = (k.ravel() for k in np.indices((len(x), len(y))))
            out.append(float(_expected_terms(x[i], y[j], (cx[i] * cy[j]).astype(float), np.full(len(i), t)).sum()))
        return pd.Series(out, dtype=float)

    def blocks(sizes: DataFrame, side: str) -> DataFrame:
        """A volume's distinct sizes in arrays of about GRID."""
        many = sizes.groupBy("volume").agg(F.ceil(F.count("*") / GRID).alias("k"))
        block = F.expr(f"pmod(xxhash64(n_{side}), k)")
        return sizes.join(many, "volume").groupBy("volume", block.alias(f"block_{side}")).agg(F.collect_list(f"n_{side}").alias(f"n_{side}"), F.collect_list(F.col(f"c_{side}").cast("double")).alias(f"c_{side}"))

    # each row is a block of pairs, and blocks of one volume are dealt over tasks
    pairs = blocks(sizes_t, "true").join(blocks(sizes_p, "pred"), "volume").join(total, "volume").repartition("volume", "block_true", "block_pred")
    emi = pairs.select("volume", expected("n_true", "c_true", "n_pred", "c_pred", "total").alias("e")).groupBy("volume").agg(F.sum("e").alias("emi"))
    mi = (
        cells.join(by_true, ["volume", "true_id"])
        .join(by_pred, ["volume", "pred_id"])
        .join(total, "volume")
        .groupBy("volume")
        .agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("n_true").cast("double") * F.col("n_pred")))).alias("mi"))
    )
    h = lambda d, c: d.join(total, "volume").groupBy("volume").agg(F.sum(-F.col(c) / F.col("total") * F.log(F.col(c) / F.col("total"))).alias(f"h_{c}"))
    joined = mi.join(emi, "volume").join(h(by_true, "n_true"), "volume").join(h(by_pred, "n_pred"), "volume")
    bottom = (F.col("h_n_true") + F.col("h_n_pred")) / 2 - F.col("emi")
    same = (F.col("h_n_true") == 0) & (F.col("h_n_pred") == 0)
    value = F.when(F.col("mi").isNull(), F.lit(0.0)).when(same, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), (F.col("mi") - F.col("emi")) / F.nullif(bottom, F.lit(0.0))))
    return every.select("volume").join(joined, "volume", "left").select("volume", value.alias("ami"))


def overlap_scores(rows: DataFrame, pred: str = "pred", truth: str = "truth", ignore: int = -100) -> DataFrame:
    """(volume, dice, iou, accuracy) of class maps, of the foreground classes
    that the truth has; 0 if it has none. Voxels whose truth is ``ignore`` count
    for nothing; accuracy counts background too."""
    valid = rows.where(F.col(truth) != ignore)
    per_class = (
        valid.select("volume", F.explode(F.array_distinct(F.array(pred, truth))).alias("c"), F.col(pred).alias("_p"), F.col(truth).alias("_t"))
        .where("c > 0")
        .groupBy("volume", "c")
        .agg(
            F.sum(F.expr("CAST(_p = c AND _t = c AS DOUBLE)")).alias("i"), F.sum(F.expr("CAST(_p = c AS DOUBLE)")).alias("p"), F.sum(F.expr("CAST(_t = c AS DOUBLE)")).alias("t")
        )
        .where("t > 0")
        .groupBy("volume")
        .agg(F.avg(F.expr("2 * i / (p + t)")).alias("dice"), F.avg(F.expr("i / (p + t - i)")).alias("iou"))
    )
    right = valid.groupBy("volume").agg(F.avg((F.col(pred) == F.col(truth)).cast("double")).alias("accuracy"))
    return right.join(per_class, "volume", "left").select("volume", F.coalesce("dice", F.lit(0.0)).alias("dice"), F.coalesce("iou", F.lit(0.0)).alias("iou"), "accuracy")


def region_props(voxels: DataFrame, label: str = "label") -> DataFrame:
    """Per (volume, label) other than 0: voxels, centroid and bounding box."""
    box = [f(c).alias(f"{n}_{c}") for c in ("z", "y", "x") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]
    return voxels.where(F.col(label) > 0).groupBy("volume", label).agg(F.count("*").alias("n_voxels"), *box)


def distinct_labels(voxels: DataFrame, label: str = "label", exact: bool = True) -> DataFrame:
    """Per volume the number of ids, background included, and the sorted list of
    the others; with ``exact`` False the number by HyperLogLog and no list."""
    if not exact:
        return voxels.groupBy("volume").agg(F.approx_count_distinct(label).alias("n_ids"))
    ids = voxels.select("volume", label).distinct()
    return ids.groupBy("volume").agg(F.count("*").alias("n_ids"), F.sort_array(F.collect_list(F.when(F.col(label) != 0, F.col(label)))).alias("ids"))


def eval_mean(rows: DataFrame, keys: list[str], value: str = "value", weight: str = "weight") -> DataFrame:
    """Weighted means; groups without weight are left out."""
    w = F.coalesce(F.col(weight), F.lit(0.0))
    return rows.groupBy(*keys).agg(F.sum(F.col(value) * w).alias("_s"), F.sum(F.when(F.col(value).isNotNull(), w)).alias("sum_weight")).where("sum_weight > 0").select(*keys, (F.col("_s") / F.col("sum_weight")).alias("mean"), "sum_weight")

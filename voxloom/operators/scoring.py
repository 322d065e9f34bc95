"""Scores of stored predictions: cross-entropy, focal, soft Dice and their
masked, weighted composites. All are ratios of sums, so one aggregation with
partial sums gives the same as any cutting into chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bce_on_probs(p: Column, t: Column, eps: float = 1e-7) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return -(t * F.log(q) + (1 - t) * F.log(1 - q))


def bce_on_logits(z: Column, t: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) - z * t + F.log1p(F.exp(-F.abs(z)))


def focal(p: Column, t: Column, gamma: float = 2.0, alpha: float | None = None, eps: float = 1e-7) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    pt = t * q + (1 - t) * (1 - q)
    f = F.pow(1 - pt, F.lit(gamma)) * -F.log(pt)
    return f if alpha is None else f * ((1 - t) * alpha + t * (1 - alpha))


def soft_dice(p: Column, t: Column, w: Column, eps: float = 1e-5, two_sided: bool = False) -> Column:
    """An aggregate: 1 - (2 sum pt + eps) / (sum p + sum t + eps), weighted."""
    one = lambda a, b: 1 - (2 * F.sum(a * b * w) + eps) / (F.sum(a * w) + F.sum(b * w) + eps)
    return (one(p, t) + one(1 - p, 1 - t)) / 2 if two_sided else one(p, t)


def balanced(rows: DataFrame, by: list[str], target: str, valid: str, clip: float = 10.0, eps: float = 1e-7) -> DataFrame:
    """``rows`` with class_weight: half over a class's share among valid rows of
    its group, at most ``clip``."""
    share = rows.groupBy(*by).agg((F.sum(F.col(target) * F.col(valid)) / F.greatest(F.sum(valid), F.lit(1))).alias("_f"))
    f = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col("_f")))
    t = F.col(target)
    return rows.join(share, by).withColumn("class_weight", t * F.least(0.5 / f, F.lit(clip)) + (1 - t) * F.least(0.5 / (1 - f), F.lit(clip))).drop("_f")


def composite(rows: DataFrame, by: list[str], logit: str, target: str, weight: str, gamma: float = 2.0, lambdas=(1.0, 1.0, 1.0), two_sided: bool = False) -> DataFrame:
    """(by, bce, focal, dice, score): weighted means of cross-entropy and focal
    terms, the global soft Dice, and their sum by ``lambdas``."""
    z, t, w = F.col(logit), F.col(target).cast("double"), F.col(weight).cast("double")
    p = 1 / (1 + F.exp(-z))
    mean = lambda x: F.sum(x * w) / F.greatest(F.sum(w), F.lit(1.0))
    g = rows.groupBy(*by).agg(mean(bce_on_logits(z, t)).alias("bce"), mean(focal(p, t, gamma)).alias("focal"), soft_dice(p, t, w, two_sided=two_sided).alias("dice"))
    return g.withColumn("score", lambdas[0] * F.col("bce") + lambdas[1] * F.col("focal") + lambdas[2] * F.col("dice"))


def balanced_composite(sums: DataFrame, by: list[str], channel: Column, lambdas=(1.0, 1.0, 1.0), clip: float = 10.0, eps: float = 1e-7) -> DataFrame:
    """``composite`` of class-balanced rows from their sums by group ``by``, offset
    and class (by, idx, target, n, bce, focal, p, pt): a row's weight depends on
    these alone, so one pass over the rows gives class counts and terms, and
    weights are put on the sums. ``channel`` is the weight of an offset."""
    total = sums.groupBy(*by, "idx").agg(F.sum("n").alias("_n"), F.sum(F.when(F.col("target") == 1, F.col("n")).otherwise(0)).alias("_p"))
    f = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col("_p") / F.greatest("_n", F.lit(1))))
    w = channel * F.least(0.5 / F.when(F.col("target") == 1, f).otherwise(1 - f), F.lit(clip))
    s = lambda c: F.sum(F.col(c) * w)
    positives = F.sum(F.when(F.col("target") == 1, F.col("n") * w).otherwise(0.0))
    dice = 1 - (2 * s("pt") + 1e-5) / (s("p") + positives + 1e-5)
    least = F.greatest(s("n"), F.lit(1.0))
    g = sums.join(total, [*by, "idx"]).groupBy(*by).agg((s("bce") / least).alias("bce"), (s("focal") / least).alias("focal"), dice.alias("dice"))
    return g.withColumn("score", lambdas[0] * F.col("bce") + lambdas[1] * F.col("focal") + lambdas[2] * F.col("dice"))


def recon_error(rows: DataFrame, by: list[str], a: str, b: str, beta: float = 1.0) -> DataFrame:
    """(by, l1, mse, smooth_l1)."""
    d = F.col(a) - F.col(b)
    smooth = F.when(F.abs(d) < beta, 0.5 * d * d / beta).otherwise(F.abs(d) - 0.5 * beta)
    return rows.groupBy(*by).agg(F.avg(F.abs(d)).alias("l1"), F.avg(d * d).alias("mse"), F.avg(smooth).alias("smooth_l1"))


def joint_score(parts: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(batch, task, score) from parts (batch, task, score): the task's score by
    its branch weight. A batch of two tasks, or of an unknown one, is an error."""
    w = F.coalesce(*(F.when(F.col("task") == k, F.lit(v)) for k, v in weights.items()))
    g = parts.groupBy("batch").agg(F.min("task").alias("task"), F.max("task").alias("_other"), F.avg("score").alias("score"))
    one = F.when(F.col("task") != F.col("_other"), F.raise_error(F.lit("a batch holds more than one task")).cast("string")).otherwise(F.col("task"))
    g = g.withColumn("task", one)
    return g.select("batch", "task", (F.col("score") * F.coalesce(w, F.raise_error(F.lit("unknown task")).cast("double"))).alias("score"))

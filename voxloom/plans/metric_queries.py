"""Queries O-AGG-*: each operator over the driver's tables, and its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import metrics as M
from voxloom.sources import fixtures as X

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


CELLS = X.LABEL_PAIRS_SQL + ", c AS (SELECT volume, true_id, pred_id, count(*) AS n FROM label_pairs WHERE true_id > 0 OR pred_id > 0 GROUP BY ALL)"
MARG = CELLS + """, t AS (SELECT volume, true_id, sum(n) AS a, count(*) AS k FROM c GROUP BY ALL), p AS (SELECT volume, pred_id, sum(n) AS b, count(*) AS k FROM c GROUP BY ALL),
 s AS (SELECT volume, sum(n) AS total FROM c GROUP BY ALL)"""


def cells(spark, sf):
    return M.contingency(X.label_pairs(spark, sf))


@query("agg_contingency", f"WITH {CELLS} SELECT * FROM c")
def _(spark, sf):
    return cells(spark, sf).where("n > 0")


@query("agg_contingency_all", f"WITH {X.LABEL_PAIRS_SQL} SELECT volume, true_id, pred_id, count(*) AS n FROM label_pairs GROUP BY ALL")
def _(spark, sf):
    """Background counted as a segment."""
    return M.contingency(X.label_pairs(spark, sf), ignore_background=False)


@query(
    "agg_ari",
    f"""WITH {MARG} SELECT s.volume, round(greatest(0, (i - e) / ((ta + pb) / 2 - e)), 6) AS ari FROM (SELECT s.volume, i, ta, pb, ta * pb / (total::DOUBLE * (total - 1) / 2) AS e
 FROM s JOIN (SELECT volume, sum(n::DOUBLE * (n - 1) / 2) AS i FROM c GROUP BY ALL) USING (volume) JOIN (SELECT volume, sum(a::DOUBLE * (a - 1) / 2) AS ta FROM t GROUP BY ALL) USING (volume)
 JOIN (SELECT volume, sum(b::DOUBLE * (b - 1) / 2) AS pb FROM p GROUP BY ALL) USING (volume)) s""",
)
def _(spark, sf):
    return rounded(M.ari(cells(spark, sf)), "ari")


@query(
    "agg_ami",
    f"""WITH {MARG}, ts AS (SELECT volume, a, count(*) AS ca FROM t GROUP BY ALL), ps AS (SELECT volume, b, count(*) AS cb FROM p GROUP BY ALL),
 pairs AS (SELECT ts.volume, a::BIGINT AS a, b::BIGINT AS b, ca * cb AS w, total::BIGINT AS n FROM ts JOIN ps USING (volume) JOIN s USING (volume)),
 e AS (SELECT volume, sum(w * m::DOUBLE / n * ln(n::DOUBLE * m / (a::DOUBLE * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(m + 1) - lgamma(a - m + 1) - lgamma(b - m + 1) - lgamma(n - a - b + m + 1))) AS emi
   FROM (SELECT *, unnest(range(greatest(1, a + b - n), least(a, b) + 1)) AS m FROM pairs) GROUP BY ALL),
 i AS (SELECT c.volume, sum(n / total * ln(n * total / (a::DOUBLE * b))) AS mi FROM c JOIN t USING (volume, true_id) JOIN p USING (volume, pred_id) JOIN s ON s.volume = c.volume GROUP BY ALL),
 ht AS (SELECT volume, sum(-a / total * ln(a / total)) AS ht FROM t JOIN s USING (volume) GROUP BY ALL), hp AS (SELECT volume, sum(-b / total * ln(b / total)) AS hp FROM p JOIN s USING (volume) GROUP BY ALL)
 SELECT volume, round(greatest(0, (mi - emi) / ((ht + hp) / 2 - emi)), 6) AS ami FROM i JOIN e USING (volume) JOIN ht USING (volume) JOIN hp USING (volume)""",
)
def _(spark, sf):
    return rounded(M.ami(cells(spark, sf)), "ami")


VOI = """SELECT volume, round(split, 6) AS voi_split, round(merge, 6) AS voi_merge, round(split + merge, 6) AS voi_total FROM
 (SELECT c.volume, sum(-n / total * log2(n / a)) AS split, sum(-n / total * log2(n / b)) AS merge FROM c JOIN t USING (volume, true_id) JOIN p USING (volume, pred_id) JOIN s ON s.volume = c.volume GROUP BY ALL)"""


@query("agg_voi", f"WITH {MARG} {VOI}")
def _(spark, sf):
    return rounded(M.voi(cells(spark, sf)), "voi_split", "voi_merge", "voi_total")


@query(
    "agg_voi_pooled",
    f"WITH {CELLS.replace(', c AS', ', c0 AS')}, c AS (SELECT 'all' AS volume, volume || ':' || true_id AS true_id, volume || ':' || pred_id AS pred_id, n FROM c0){MARG[len(CELLS):]} {VOI}",
)
def _(spark, sf):
    return rounded(M.voi(M.pooled(cells(spark, sf))), "voi_split", "voi_merge", "voi_total")


@query("agg_ted", f"WITH {MARG} SELECT volume, splits::BIGINT AS splits, merges::BIGINT AS merges, (splits + merges)::BIGINT AS ted FROM (SELECT volume, sum(k - 1) AS splits FROM t GROUP BY ALL) JOIN (SELECT volume, sum(k - 1) AS merges FROM p GROUP BY ALL) USING (volume)")
def _(spark, sf):
    return M.ted(cells(spark, sf))


OVERLAP = X.BINARY_PAIR_SQL + ", o AS (SELECT volume, sum((pred = 1 AND truth = 1)::INT) AS i, sum(pred) AS p, sum(truth) AS t, avg((pred = truth)::INT) AS acc FROM binary_pair GROUP BY ALL)"


@query("agg_dice", f"WITH {OVERLAP} SELECT volume, round(2 * i / (p + t), 6) AS dice FROM o")
def _(spark, sf):
    return rounded(M.overlap_scores(X.binary_pair(spark, sf)).select("volume", "dice"), "dice")


@query("agg_iou_accuracy", f"WITH {OVERLAP} SELECT volume, round(i / (p + t - i), 6) AS iou, round(acc, 6) AS accuracy FROM o")
def _(spark, sf):
    return rounded(M.overlap_scores(X.binary_pair(spark, sf)).select("volume", "iou", "accuracy"), "iou", "accuracy")


@query(
    "agg_census_rollup",
    f"WITH {X.VOXELS_SQL} SELECT volume, CASE WHEN label > 0 THEN 'sft' ELSE 'ssl' END AS task, z % 2 = 0 AS even, count(*) AS n_voxels, count(DISTINCT label) AS n_labels FROM voxels GROUP BY ROLLUP (volume, task, even)",
)
def _(spark, sf):
    v = X.voxels(spark, sf).select("volume", F.when(F.col("label") > 0, "sft").otherwise("ssl").alias("task"), (F.col("z") % 2 == 0).alias("even"), "label")
    return v.rollup("volume", "task", "even").agg(F.count("*").alias("n_voxels"), F.count_distinct("label").alias("n_labels"))


@query(
    "agg_region_props",
    f"""WITH {X.VOXELS_SQL} SELECT volume, label, count(*) AS n_voxels, round(avg(z), 6) AS avg_z, min(z) AS min_z, max(z) AS max_z, round(avg(y), 6) AS avg_y, min(y) AS min_y, max(y) AS max_y,
 round(avg(x), 6) AS avg_x, min(x) AS min_x, max(x) AS max_x FROM voxels WHERE label > 0 GROUP BY ALL""",
)
def _(spark, sf):
    return rounded(M.region_props(X.voxels(spark, sf)), "avg_z", "avg_y", "avg_x")


@query("agg_distinct_labels", f"WITH {X.VOXELS_SQL} SELECT volume, count(DISTINCT label) AS n_ids, count(DISTINCT label) FILTER (label <> 0) AS n_objects, max(label) AS top_id FROM voxels GROUP BY ALL")
def _(spark, sf):
    d = M.distinct_labels(X.voxels(spark, sf))
    return d.select("volume", "n_ids", F.size("ids").cast("bigint").alias("n_objects"), F.array_max("ids").alias("top_id"))


@query("agg_eval_mean", f"WITH {X.METRIC_ROWS_SQL} SELECT stage, name, round(sum(value * weight) / sum(weight), 6) AS mean, sum(weight) AS sum_weight FROM metric_rows GROUP BY ALL HAVING sum(weight) > 0")
def _(spark, sf):
    return rounded(M.eval_mean(X.metric_rows(spark, sf), ["stage", "name"]), "mean")


@query("agg_batch_mean", f"WITH {MARG}, v AS ({VOI.replace(', 6)', ', 15)')}) SELECT round(avg(voi_split), 6) AS voi_split, round(avg(voi_merge), 6) AS voi_merge, round(avg(voi_split) + avg(voi_merge), 6) AS voi_total FROM v")
def _(spark, sf):
    v = M.voi(cells(spark, sf)).agg(F.avg("voi_split").alias("voi_split"), F.avg("voi_merge").alias("voi_merge"))
    return rounded(v.withColumn("voi_total", F.expr("voi_split + voi_merge")), "voi_split", "voi_merge", "voi_total")

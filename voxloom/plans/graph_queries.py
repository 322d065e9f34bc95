"""Queries O-CC-*, O-EDT-*, O-FIL-*, O-MWS-*, O-TOP-*, O-STR-* and brick
layouts, with DuckDB SQL where that is fast enough on whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voxloom.operators import affinities as A
from voxloom.operators import components as K
from voxloom.operators import mutex as W
from voxloom.operators import neighbors as N
from voxloom.operators.graph import cut, shared_folder
from voxloom.plans.grid_queries import disturbed
from voxloom.plans.voxel_queries import KEYS, NB, NEAR, VX
from voxloom.sources import bricks as B
from voxloom.sources import fixtures as X
from voxloom.streaming import metrics as S

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def components_sql(steps):
    """Runs along x as nodes, their contacts in other lines, and the runs that each
    one reaches; components are numbered by their first voxel."""
    return f"""WITH RECURSIVE {X.VOXELS_SQL}, st(sz, sy, sx) AS (VALUES {', '.join(map(str, steps))}),
 fg AS (SELECT volume, z, y, x, label, x - row_number() OVER (PARTITION BY volume, z, y, label ORDER BY x) AS g FROM voxels WHERE label > 0),
 rn AS MATERIALIZED (SELECT volume, z, y, label, min(x) AS lo, max(x) AS hi, row_number() OVER (ORDER BY volume, z, y, min(x)) AS r FROM fg GROUP BY volume, z, y, label, g),
 tc AS MATERIALIZED (SELECT DISTINCT a.r AS a, b.r AS b FROM rn a JOIN st ON true JOIN rn b ON b.volume = a.volume AND b.z = a.z + sz AND b.y = a.y + sy AND b.label = a.label AND b.lo <= a.hi + sx AND b.hi >= a.lo - sx),
 bo AS MATERIALIZED (SELECT a, b FROM tc UNION SELECT b, a FROM tc),
 rc(a, b) AS (SELECT r, r FROM rn UNION SELECT rc.a, bo.b FROM rc JOIN bo ON rc.b = bo.a),
 ro AS (SELECT a, min(b) AS root FROM rc GROUP BY a),
 nu AS (SELECT a, dense_rank() OVER (PARTITION BY volume ORDER BY root) AS component FROM ro JOIN rn ON rn.r = ro.a),
 cc AS (SELECT v.volume, v.z, v.y, v.x, coalesce(component, 0)::BIGINT AS component FROM voxels v LEFT JOIN rn ON rn.volume = v.volume AND rn.z = v.z AND rn.y = v.y AND v.x BETWEEN rn.lo AND rn.hi LEFT JOIN nu ON nu.a = rn.r)"""


CC_FACES = components_sql([(0, 1, 0), (1, 0, 0)])
CC_CORNERS = components_sql([(0, 1, 1), (1, -1, 1), (1, 0, 1), (1, 1, 1)])


@query("cc_label", f"{CC_FACES} SELECT * FROM cc")
def _(spark, sf):
    return K.connected_components(X.voxels(spark, sf)).select(*KEYS, "component")


@query("cc_label_corners", f"{CC_CORNERS} SELECT volume, z, y, component, count(*) AS n FROM cc GROUP BY ALL")
def _(spark, sf):
    return K.connected_components(X.voxels(spark, sf), connectivity=3).groupBy("volume", "z", "y", "component").agg(F.count("*").alias("n"))


@query(
    "cc_label_renumbered",
    f"{CC_FACES}, lg AS (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY c) AS k FROM (SELECT volume, component AS c FROM cc WHERE component > 0 GROUP BY ALL HAVING count(*) >= 20)) SELECT cc.volume, cc.z, cc.y, cc.x, coalesce(k, 0)::BIGINT AS component FROM cc LEFT JOIN lg ON lg.volume = cc.volume AND lg.c = cc.component",
)
def _(spark, sf):
    """Components of 20 voxels or more, counted anew."""
    return K.labelled(X.voxels(spark, sf), 20, renumber=True).select(*KEYS, "component")


@query("cc_min_size", f"{VX} SELECT volume, pred, count(*) AS n FROM (SELECT v.volume, CASE WHEN s.volume IS NULL THEN 0 ELSE pred END AS pred FROM voxels v LEFT JOIN (SELECT volume, pred AS p FROM voxels WHERE pred > 0 GROUP BY ALL HAVING count(*) >= 400) s ON s.volume = v.volume AND s.p = v.pred) GROUP BY ALL")
def _(spark, sf):
    return K.min_size(X.voxels(spark, sf), 400, "pred").groupBy("volume", "pred").agg(F.count("*").alias("n"))


@query(
    "edt_distance",
    f"""{VX}, dx AS (SELECT v.volume, v.z, v.y, v.x, min((v.x - s.x) * (v.x - s.x)) AS d FROM voxels v JOIN voxels s ON s.volume = v.volume AND s.z = v.z AND s.y = v.y WHERE s.label = 0 GROUP BY ALL),
 dy AS (SELECT v.volume, v.z, v.y, v.x, min(d + (v.y - s.y) * (v.y - s.y)) AS d FROM voxels v JOIN dx s ON s.volume = v.volume AND s.z = v.z AND s.x = v.x GROUP BY ALL)
 SELECT v.volume, v.z, v.y, v.x, round(sqrt(min(d + 25 * (v.z - s.z) * (v.z - s.z))), 6) AS distance FROM voxels v JOIN dy s ON s.volume = v.volume AND s.y = v.y AND s.x = v.x GROUP BY ALL""",
)
def _(spark, sf):
    d = K.distance_transform(X.voxels(spark, sf), "label", (5.0, 1.0, 1.0))
    return d.withColumn("distance", F.round("distance", 6))


BALL = [(k, i, j) for k in (-1, 0, 1) for i in (-2, -1, 0, 1, 2) for j in (-2, -1, 0, 1, 2) if (5 * k) ** 2 + i * i + j * j <= 4]


@query(
    "edt_grow_labels",
    f"""{VX}, b(oz, oy, ox, d2) AS (VALUES {', '.join(f'({k}, {i}, {j}, {25 * k * k + i * i + j * j})' for k, i, j in BALL)}),
 near AS (SELECT q.volume, q.z, q.y, q.x, arg_min(n.label, d2 * 1000 + n.label) AS grown FROM (SELECT v.volume, v.z, v.y, v.x, v.z + oz AS tz, v.y + oy AS ty, v.x + ox AS tx, d2 FROM voxels v CROSS JOIN b) q JOIN voxels n ON n.volume = q.volume AND n.z = tz AND n.y = ty AND n.x = tx WHERE n.label > 0 GROUP BY ALL)
 SELECT v.volume, v.z, v.y, sum(coalesce(grown, 0))::BIGINT AS grown, sum(coalesce(grown, 0) * (v.x + 1))::BIGINT AS placed FROM voxels v LEFT JOIN near ON near.volume = v.volume AND near.z = v.z AND near.y = v.y AND near.x = v.x GROUP BY ALL""",
)
def _(spark, sf):
    """Every voxel's label after growing, summed along x, and by place."""
    g = K.grow_labels(X.voxels(spark, sf), 2.0, sampling=(5.0, 1.0, 1.0))
    return g.groupBy("volume", "z", "y").agg(F.sum("grown").alias("grown"), F.sum(F.col("grown") * (F.col("x") + 1)).alias("placed"))


def smoothed_sql(axis, source, n):
    """One pass of the filter along an axis of n voxels; the edge voxel is reflected too."""
    at = f"v.{axis} + k"
    other = " AND ".join(f"s.{a} = v.{a}" for a in ("volume", *"zyx") if a != axis)
    return f"SELECT v.volume, v.z, v.y, v.x, sum(s.intensity * w) AS intensity FROM voxels v CROSS JOIN kn JOIN {source} s ON {other} AND s.{axis} = CASE WHEN {at} < 0 THEN -1 - ({at}) WHEN {at} >= {n} THEN {2 * n - 1} - ({at}) ELSE {at} END GROUP BY ALL"


@query(
    "fil_gaussian",
    f"{VX}, kn AS (SELECT k, exp(-0.5 * k * k) / sum(exp(-0.5 * k * k)) OVER () AS w FROM range(-4, 5) t(k)), gz AS ({smoothed_sql('z', 'voxels', 7)}), gy AS ({smoothed_sql('y', 'gz', 32)}), gx AS ({smoothed_sql('x', 'gy', 64)}) SELECT volume, z, y, x, round(intensity + 1.234e-5, 3) AS intensity FROM gx",
)
def _(spark, sf):
    return K.gaussian_filter(X.voxels(spark, sf), 1.0).withColumn("intensity", F.round(F.col("intensity") + 1.234e-5, 3))


STRUCTURE = ", ".join(f"({i}, {j}, {k})" for i, j, k in K.binary_structure(3, 2))


@query(
    "fil_binary_structure",
    f"{VX}, st(sz, sy, sx) AS (VALUES {STRUCTURE}), n AS (SELECT v.volume, v.z, v.y, v.x, v.z + sz AS tz, v.y + sy AS ty, v.x + sx AS tx, v.label FROM voxels v CROSS JOIN st) SELECT n.volume, n.z, n.y, count(*)::BIGINT AS n, sum((n.x + 1) * (n.x + 1))::BIGINT AS placed FROM n JOIN voxels w ON w.volume = n.volume AND w.z = n.tz AND w.y = n.ty AND w.x = n.tx AND w.label = n.label GROUP BY ALL",
)
def _(spark, sf):
    """Of every voxel the neighbours over faces and edges that have its label, itself included, summed along x, and by place."""
    lines = A.neighbor_counts(A.bricks_of(X.voxels(spark, sf)), K.binary_structure(3, 2))
    return A.sums_along_x(lines.withColumn("idx", F.lit(0)), "n").drop("idx")


AFF = f"{NB}, af AS (SELECT volume, z, y, x, idx, CASE WHEN same THEN 0.9 - d ELSE 0.1 + d END::DOUBLE AS aff FROM (SELECT v.volume, v.z, v.y, v.x, v.idx, n.label = v.label AS same, ((v.z * 11 + v.y * 7 + v.x * 3 + v.idx * 5) % 10) / 100.0 AS d FROM {NEAR}))"
EDGES = (
    AFF
    + """, ed AS (SELECT volume, (z::BIGINT * 32 + y) * 64 + x AS u, ((z + oz)::BIGINT * 32 + y + oy) * 64 + x + ox AS v, idx, CASE WHEN idx >= 3 THEN 1 - aff ELSE aff END AS weight, idx >= 3 AS mutex
 FROM af JOIN o USING (idx) WHERE z + oz BETWEEN 0 AND 6 AND y + oy BETWEEN 0 AND 31 AND x + ox BETWEEN 0 AND 63 AND (idx < 3 OR ((z - greatest(0, -oz)) % 1 = 0 AND (y - greatest(0, -oy)) % 4 = 0 AND (x - greatest(0, -ox)) % 4 = 0)))"""
)
STRIDES = (1, 4, 4)


def edges(spark, sf, decimals=None, packed=False):
    return A.edges(X.bricks(spark, sf, A.SIZE, ("label",)), disturbed, strides=STRIDES, decimals=decimals, packed=packed)


@query("mws_build_edges", f"{VX}{EDGES} SELECT volume, idx, mutex, u // 64 AS line, count(*) AS n, sum(v * (1 + u % 64))::BIGINT AS ends, round(sum(round(weight, 6) * (1 + u % 64)), 4) AS weighed FROM ed GROUP BY ALL")
def _(spark, sf):
    """All edges, summed along the lines of their first voxels, by place."""
    at = F.lit(1) + F.col("u") % 64
    return rounded_edges(spark, sf).groupBy("volume", "idx", "mutex", F.expr("u div 64").alias("line")).agg(F.count("*").alias("n"), F.sum(F.col("v") * at).alias("ends"), F.round(F.sum(F.col("weight") * at), 4).alias("weighed"))


def rounded_edges(spark, sf):
    """Weights to six decimals, so that equal ones are ties on every engine."""
    return edges(spark, sf, 6)


@query("top_push_edge_cap", f"{VX}{EDGES}, r AS (SELECT volume, u, v, idx, round(weight, 6) AS weight, mutex FROM ed) SELECT volume, u, v, idx FROM (SELECT *, row_number() OVER (PARTITION BY volume, mutex ORDER BY weight DESC, idx, u) AS k FROM r) WHERE mutex AND k <= 500")
def _(spark, sf):
    return W.cap_push(rounded_edges(spark, sf), 500).where("mutex").select("volume", "u", "v", "idx")


@query("top_edge_order", f"{VX}{EDGES} SELECT volume, idx, u // 64 AS line, sum(rank)::BIGINT AS ranks, sum(rank * (1 + u % 64))::BIGINT AS placed FROM (SELECT volume, u, idx, row_number() OVER (PARTITION BY volume ORDER BY round(weight, 6) DESC, idx, u) AS rank FROM ed) GROUP BY ALL")
def _(spark, sf):
    """The rank of every edge in the falling order of its volume, summed along lines, and by place."""
    r = W.ranked(rounded_edges(spark, sf))
    return r.groupBy("volume", "idx", F.expr("u div 64").alias("line")).agg(F.sum("rank").alias("ranks"), F.sum(F.col("rank") * (1 + F.col("u") % 64)).alias("placed"))


@query("top_priority_buckets", f"{VX}{EDGES} SELECT volume, bucket, count(*) AS n, min(weight) AS low, max(weight) AS high FROM (SELECT volume, round(weight, 6) AS weight, ntile(16) OVER (PARTITION BY volume ORDER BY round(weight, 6) DESC, idx, u) AS bucket FROM ed) GROUP BY ALL")
def _(spark, sf):
    b = W.priority_buckets(rounded_edges(spark, sf), 16)
    return b.groupBy("volume", "bucket").agg(F.count("*").alias("n"), F.min("weight").alias("low"), F.max("weight").alias("high"))


@query("mws_exact")
def _(spark, sf):
    """The falling order over all edges of a volume, settled in blocks that grow."""
    return W.exact(edges(spark, sf, 6, packed=True), B.extents(X.bricks(spark, sf, A.SIZE, ("label",))))


@query("mws_boruvka")
def _(spark, sf):
    """Parallel rounds over the whole graph of every volume."""
    return W.boruvka(rounded_edges(spark, sf), 2)


@query("mws_block_stitch")
def _(spark, sf):
    """Sections 0..3 and 4..6 are solved apart and joined over the cut, edge by edge."""
    named = W.stitch_blocks(edges(spark, sf, 6, packed=True), B.extents(X.bricks(spark, sf, A.SIZE, ("label",))), size=(4, 32, 64))
    return named.groupBy("volume", "instance").agg(F.count("*").alias("n_voxels"), F.count_distinct("region").alias("n_regions"), F.min("node").alias("first_voxel")).select("volume", "first_voxel", "n_voxels", "n_regions")


@query("mws_gate_and_post", f"{VX}, g AS (SELECT volume, CASE WHEN intensity > 0 THEN pred ELSE 0 END AS p FROM voxels), s AS (SELECT volume, p AS q FROM g WHERE p > 0 GROUP BY ALL HAVING count(*) >= 120) SELECT g.volume, CASE WHEN q IS NULL THEN 0 ELSE p END AS pred, count(*) AS n FROM g LEFT JOIN s ON s.volume = g.volume AND s.q = g.p GROUP BY ALL")
def _(spark, sf):
    v = X.voxels(spark, sf).withColumn("fg", F.col("intensity") > 0)
    return W.finish(v, "fg", 120, "pred").groupBy("volume", "pred").agg(F.count("*").alias("n"))


@query("mws_agglomerate")
def _(spark, sf):
    """Gate, edges, watershed, size filter, numbers and growth, one after the other."""
    b = X.bricks(spark, sf, A.SIZE, ("label", "pred")).withColumn("fg", F.expr("transform(pred, p -> p > 0)")).drop("pred")
    e = A.edges(b, disturbed, strides=STRIDES, mask="fg", decimals=6, packed=True)
    return W.agglomerate(e, b, "fg", least=20, grow=3.0, sampling=(5.0, 1.0, 1.0), size=(4, 32, 64))


# --- bricks ----------------------------------------------------------------


@query("src_brick_round_trip", f"{VX} SELECT volume, z, y, x, round(intensity + 1.234e-5, 2) AS intensity, label FROM voxels")
def _(spark, sf):
    b = X.bricks(spark, sf)
    path = f"{shared_folder(spark)}/bricks-{uuid.uuid4().hex}"
    B.write(b, path)
    return B.to_voxels(B.read(spark, path)).withColumn("intensity", F.round(F.col("intensity") + 1.234e-5, 2))


@query("jn_halo_join", f"{VX}{NB} SELECT v.volume, v.z, v.y, v.idx, sum((n.label = v.label)::INT)::BIGINT AS n_same, sum((n.label = v.label)::INT * (v.x + 1) * (v.x + 1))::BIGINT AS placed FROM {NEAR} GROUP BY ALL")
def _(spark, sf):
    """All offsets by bricks and their halos; targets summed along x, and by place."""
    size = (4, 16, 16)
    return A.line_sums(B.to_bricks(X.voxels(spark, sf), size, ("label",)), size=size).withColumnRenamed("n", "n_same")


# --- streams ---------------------------------------------------------------


def streamed(spark, sf, table, make, mode="complete"):
    """Run ``make`` as a stream over a table's files and read what it left."""
    path = f"{sf}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    # a table may be one file or a folder of files
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{path}*")
    out = make(source)
    S.to_table(out, f"{base}/table", f"{base}/checkpoint", mode)
    return S.read_table(spark, f"{base}/table", out.schema)


@query("str_running_eval", f"WITH {X.METRIC_ROWS_SQL} SELECT name, round(sum(value * weight) / sum(weight), 6) AS mean, sum(weight) AS sum_weight FROM metric_rows GROUP BY ALL HAVING sum(weight) > 0")
def _(spark, sf):
    return streamed(spark, sf, "events", lambda s: S.running_eval(X.metrics_of(s), ["name"])).withColumn("mean", F.round("mean", 6))


@query("str_running_contingency", f"WITH {X.LABEL_PAIRS_SQL} SELECT volume, true_id, pred_id, count(*) AS n FROM label_pairs WHERE true_id > 0 OR pred_id > 0 GROUP BY ALL")
def _(spark, sf):
    pairs = lambda s: s.select(
        F.col("l_returnflag").alias("volume"), (F.col("l_suppkey") % 40).cast("bigint").alias("true_id"), F.expr("CASE WHEN l_partkey % 10 = 0 THEN 0L ELSE CAST((l_suppkey % 40) div 2 + (l_partkey % 2) * 30 AS BIGINT) END").alias("pred_id")
    )
    return streamed(spark, sf, "lineitem", lambda s: S.running_contingency(pairs(s)))


ARRIVALS = 4
LATE_HOURS = 6
#: DuckDB: events by arrival (0..3) and what had been seen before it, to the millisecond
ARRIVED_SQL = f"""sp AS (SELECT min(epoch_us(ts)) AS first, max(epoch_us(ts)) AS last FROM events),
 pl AS (SELECT events.*, CASE WHEN event_id % 10 = 0 THEN {ARRIVALS - 1} ELSE (epoch_us(ts) - first) * {ARRIVALS - 1} // (last - first + 1) END AS arrival FROM events, sp),
 ar AS (SELECT * FROM pl UNION ALL SELECT * REPLACE (least(arrival + 1, {ARRIVALS - 1}) AS arrival) FROM pl WHERE event_id % 7 = 0),
 wm AS (SELECT a.arrival, max(date_trunc('millisecond', b.ts)) - INTERVAL {LATE_HOURS} HOUR AS mark FROM (SELECT DISTINCT arrival FROM ar) a LEFT JOIN ar b ON b.arrival < a.arrival GROUP BY ALL),
 al AS (SELECT ar.*, mark FROM ar JOIN wm USING (arrival))"""


def arrived(spark, sf):
    """The events with arrival: in four deliveries by time, but for one in ten, which come
    with the last one, whenever they happened; one in seven is delivered once more."""
    e = X.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    span = e.agg(F.min(F.unix_micros("ts")).alias("_first"), F.max(F.unix_micros("ts")).alias("_last"))  # one row
    k = F.when(F.col("event_id") % 10 == 0, ARRIVALS - 1).otherwise(F.expr(f"(unix_micros(ts) - _first) * {ARRIVALS - 1} div (_last - _first + 1)"))
    e = e.join(F.broadcast(span), F.lit(True)).withColumn("arrival", k.cast("int")).drop("_first", "_last")
    again = e.where("event_id % 7 = 0").withColumn("arrival", F.least(F.col("arrival") + 1, F.lit(ARRIVALS - 1)))
    return cut(e.unionByName(again))


def delivered(spark, sf, make):
    """Run ``make`` as a stream in append mode, which stops after each delivery and goes
    on from its checkpoint with the next, and read what it left."""
    rows, base = arrived(spark, sf), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    for k in range(ARRIVALS):
        rows.where(F.col("arrival") == k).drop("arrival").write.mode("append").parquet(f"{base}/in")
        out = make(spark.readStream.schema(rows.drop("arrival").schema).parquet(f"{base}/in"))
        S.to_table(out, f"{base}/table", f"{base}/checkpoint", "append")
    return S.read_table(spark, f"{base}/table", out.schema)


@query("str_incremental_ingest", f"WITH {ARRIVED_SQL} SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT event_id, user_id, event_type FROM al WHERE mark IS NULL OR ts > mark) GROUP BY ALL")
def _(spark, sf):
    """Each event once, however often it is delivered, unless it comes too late."""
    once = delivered(spark, sf, lambda s: S.new_items(s, "event_id", late=f"{LATE_HOURS} hours").select("event_id", "user_id", "event_type"))
    return once.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query(
    "str_metric_windows",
    f"""WITH {ARRIVED_SQL}, md AS (SELECT max(date_trunc('millisecond', ts)) - INTERVAL {LATE_HOURS} HOUR AS final FROM ar)
 SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS stage, round(avg(value::DOUBLE), 6) AS mean, count(*) AS n FROM al, md
 WHERE (mark IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark) AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= final GROUP BY ALL""",
)
def _(spark, sf):
    """Hours that have closed, each once, without the rows that came after they had."""
    out = delivered(spark, sf, lambda s: S.metric_windows(X.metrics_of(s), "1 hour", f"{LATE_HOURS} hours"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "stage", F.round("mean", 6).alias("mean"), "n")

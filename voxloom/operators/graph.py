"""Lineage cuts and connected components for iterative operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in the one named in ``spark.checkpoint.dir``; it
    goes when the driver ends. Where that is unset, one machine (tests) takes a
    temporary folder, and a cluster is an error: its disks are not shared."""
    context = spark.sparkContext
    app = context.applicationId
    if app not in _folders:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        _folders[app] = f"{named.rstrip('/')}/voxels-{app}" if named else f"file://{tempfile.mkdtemp(prefix='spark-voxels-')}"
        path = context._jvm.org.apache.hadoop.fs.Path(_folders[app])
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return _folders[app]


#: row groups of tables with wide rows: Spark's reader decodes up to 4,096 rows of one at once
WIDE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}


def cut(df: DataFrame, wide: bool = False) -> DataFrame:
    """Write a table into the shared folder and read it back. ``wide`` rows hold many
    values each, packed: what a task decodes of them at once is bounded in bytes."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.options(**(WIDE_ROWS if wide else {})).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that ``cut`` has returned, of rounds that are over:
    what was made of them must have been cut, too. Other tables are left as they are."""
    for t in tables:
        path = getattr(t, "_cut_path", None)
        if path:
            where = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


SMALL_ROWS = 500_000  # of a few numbers each, that a task may hold


def broadcast_if_small(d: DataFrame) -> DataFrame:
    """A cut table, marked for broadcast if it has SMALL_ROWS rows or fewer."""
    return F.broadcast(d) if d.count() <= SMALL_ROWS else d


def small_and_large(packed: DataFrame, sizes: DataFrame, most: int, each: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ``packed`` of volumes whose _n in ``sizes`` (volume, _n) is ``most`` or less,
    dealt by volume to tasks of about ``each`` of that, and of larger ones, if any."""
    sizes = cut(sizes)
    small, n_large = sizes.agg(F.sum(F.when(F.col("_n") <= most, F.col("_n"))), F.count_if(F.col("_n") > most)).first()
    tasks = max(packed.sparkSession.sparkContext.defaultParallelism, (small or 0) // each + 1)
    if not n_large:
        return packed.repartition(tasks, "volume"), None
    large = broadcast_if_small(cut(sizes.where(F.col("_n") > most).select(F.col("volume").alias("_v"))))
    is_large = packed["volume"].eqNullSafe(large["_v"])
    return packed.join(large, is_large, "left_anti").repartition(tasks, "volume"), packed.join(large, is_large, "left_semi")


def dealt_by_ranges(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """``rows``, cut, in ranges of ``by`` and the whole ``order``, with _at: numbers
    that rise in that order, without gaps inside a range; a range is ``_at >> 33``.
    Ties of the first columns of the order are dealt by the next ones."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order]
    return cut(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))


def ranked_by_ranges(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """``rows`` with rank (bigint): the place of a row in its group's order. Ranges
    are sorted each in a task; what comes before a range is added from one row a
    group and range, so that no group is sorted by one task."""
    dealt = dealt_by_ranges(rows, by, order).withColumn("_part", F.shiftright("_at", 33))
    pieces = dealt.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = broadcast_if_small(cut(pieces.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")))
    return dealt.join(pieces, [*by, "_part"]).withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_at", "_part", "_first", "_before")


def least_members(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of the component of each of 0..n-1, joined by pairs (a, b):
    larger roots are hooked to smaller ones and paths halved, all at once."""
    up = np.arange(n)
    while len(a):
        ra, rb = up[a], up[b]
        while True:
            na, nb = up[ra], up[rb]
            if np.array_equal(na, ra) and np.array_equal(nb, rb):
                break
            ra, rb = na, nb
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(up, np.maximum(ra, rb), np.minimum(ra, rb))
    while True:
        further = up[up]
        if np.array_equal(further, up):
            return up
        up = further


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of ``edges`` (a, b: bigint); root is the least
    node of a component.

    Each round gives every node the least label among its neighbours' and then
    follows labels two steps (pointer jumping), so labels travel in far fewer
    rounds than the graph is wide. Rounds end when no label changes.
    """
    ends = edges.where("a <> b").select("a", "b")
    e = cut(ends.union(ends.select("b", "a")).distinct())
    many = max(HUB_ROWS, e.count() // 1000)
    # a node that over a thousandth of the edges lead to: fewer than a thousand of them
    hubs = F.broadcast(cut(e.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > many).select("b")))
    labels = cut(e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        near = _looked_up(e, hubs, "b", labels.select(F.col("node").alias("b"), "root")).groupBy("a").agg(F.min("root").alias("m"))
        hooked = cut(labels.join(near, labels["node"] == near["a"]).select("node", F.least("root", "m").alias("root"), F.col("root").alias("old")))
        # late roots have most of the nodes: theirs are looked up by broadcast, too
        led = hooked.groupBy("old").agg(F.min("root").alias("least"), F.count("*").alias("n"))
        hot = cut(hooked.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > many).select("root"))
        moved = hooked.select(F.col("node").alias("root"), F.col("root").alias("next"))
        stepped = _looked_up(hooked, F.broadcast(hot), "root", moved, "left").select("node", F.least("root", F.coalesce("next", "root")).alias("root"), "old")
        large = cut(led.where(F.col("n") > many).select("old"))
        followed = _looked_up(stepped, F.broadcast(large), "old", led.select("old", "least"), "left")
        least = F.least("root", F.coalesce("least", "root"))
        before, labels = labels, cut(followed.select("node", least.alias("root"), (least < F.col("old")).alias("changed")))
        release(before, hooked, hot, large)
        if labels.where("changed").limit(1).count() == 0:
            release(e)
            return labels.select("node", "root")


HUB_ROWS = 10_000


def _looked_up(rows: DataFrame, hot: DataFrame, key: str, table: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has each key once: rows of hot keys stay
    where they are and get theirs by a broadcast, the others are shuffled."""
    few = F.broadcast(table.join(hot, key, "left_semi"))
    return rows.join(hot, key, "left_semi").join(few, key, how).unionByName(rows.join(hot, key, "left_anti").join(table, key, how))

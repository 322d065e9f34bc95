"""Things the operators of this subpackage share: tables, lineage cuts, hashing
of words in tasks, forests inside a task and components across tasks."""

from __future__ import annotations

import tempfile
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_folders: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in the one that driver and executors share, as
    ``spark.checkpoint.dir`` names it; it goes when the driver ends. Where that is
    unset, one machine (tests) takes a temporary folder; a cluster is an error, as
    its executors' own disks are not each other's."""
    context = spark.sparkContext
    app = context.applicationId
    if app not in _folders:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        _folders[app] = f"{named.rstrip('/')}/voxloom-{app}" if named else f"file://{tempfile.mkdtemp(prefix='spark-voxloom-')}"
        path = context._jvm.org.apache.hadoop.fs.Path(_folders[app])
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return _folders[app]


def cut(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back: what it took to
    make it is done once, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """As ``cut``, bucketed by a column: what is grouped by it later, in as many
    partitions, is read where it lies and not shuffled. The catalog's name for
    the table goes at once, or with a failure; its files stay for the plan that reads them."""
    spark = df.sparkSession
    name = f"voxloom_{uuid.uuid4().hex}"
    try:
        df.write.bucketBy(buckets, key).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
        table = spark.table(name)
        table.schema  # noqa: B018  resolved before the name goes
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return table


BROADCAST_ROWS = 500_000  # of two numbers each, at most


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a cut table of a few numbers a row, marked for broadcast if it has
    ``rows`` rows or fewer; a larger one is joined by shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


FILTER_BITS = 25


HOT_ROWS = 10_000


def join_hot(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has each key once and in ``n``
    how many rows ask for it. Rows of hot keys (over HOT_ROWS and over a
    thousandth of ``total`` rows, so fewer than a thousand keys) stay where they
    are and get theirs by a broadcast, the others are shuffled."""
    hot = F.col(n) > max(HOT_ROWS, total // 1000)
    few, rest = table.where(hot).drop(n), table.where(~hot).drop(n)
    return rows.join(F.broadcast(few), key).unionByName(rows.join(F.broadcast(few.select(key)), key, "left_anti").join(rest, key))


def hash_filter(keys: DataFrame, key: str, bits: int = FILTER_BITS):
    """A function from a key column to whether the key may be in ``keys``: a
    bitmap of 2^bits hashes (4 MB, whatever the number of keys) that every task
    holds. It takes rows out before a shuffle; it lets some strangers pass."""
    piece = 1 << 15
    place = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << bits))

    def fill(b: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(piece, np.uint8)
        flags[b["place"].to_numpy() % piece] = 1
        return pd.DataFrame({"at": [int(b["place"].iloc[0]) // piece], "data": [np.packbits(flags).tobytes()]})

    places = keys.select(place.alias("place")).distinct().withColumn("at", F.floor(F.col("place") / piece))
    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    for row in places.groupBy("at").applyInPandas(lambda b: fill(b), "at bigint, data binary").toLocalIterator():
        bitmap[row["at"] * piece // 8 : (row["at"] + 1) * piece // 8] = np.frombuffer(row["data"], np.uint8)
    held = keys.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def maybe(at: pd.Series) -> pd.Series:
        a = at.to_numpy()
        return pd.Series((held.value[a >> 3] >> (7 - (a & 7)).astype(np.uint8)) & 1 == 1)

    return lambda column: maybe(F.pmod(F.xxhash64(column, F.lit(17)), F.lit(1 << bits)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


GROUP_CHARS = 32 << 20  # characters of text whose hashes one group of a packed exchange holds


def groups_for(texts: DataFrame, text_col: str = "text") -> int:
    """How many groups the words of all texts are dealt to: as many as there are
    shuffle partitions, or more, so that a group's share of the text is bounded."""
    chars = texts.agg(F.sum(F.length(text_col))).first()[0] or 0
    return max(shuffle_partitions(texts.sparkSession), -(-chars // GROUP_CHARS))


def pack(a: np.ndarray) -> bytes:
    return zlib.compress(a.tobytes(), 1)


def unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), kind)


def pack_planes(a: np.ndarray, kind: str = "<u4") -> bytes:
    """Whole numbers by byte planes: the high ones of small numbers are all zero."""
    size = np.dtype(kind).itemsize
    return zlib.compress(np.ascontiguousarray(a.astype(kind).view(np.uint8).reshape(-1, size).T).tobytes(), 1)


def unpack_planes(b: bytes, kind: str = "<u4") -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind)[:, 0]


def give_back_memory(collect: bool = True) -> None:
    """Return freed memory to the system: Python workers are reused by later
    stages, next to whatever those need."""
    import ctypes
    import gc

    import pyarrow as pa

    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def long_text(column: str):
    """An id column as it travels to Python where nulls are among it: as text,
    since pandas would make doubles of it."""
    return F.col(column).cast("long").cast("string")


def longs(values) -> pd.Series:
    """Ids of ``long_text``, or None, as whole numbers again."""
    return pd.Series(pd.array([None if x is None else int(x) for x in values], dtype="Int64"))


def trimmed(run):
    """A group's function that gives back what it has freed."""

    def wrapped(*groups):
        out = run(*groups)
        give_back_memory(collect=False)
        return out

    return wrapped


def mix64(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over unsigned arrays."""
    z = h + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_M = 0x9DDFEA08EB382D69  # odd, so that its powers can be divided by mod 2^64
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = pow(_M, -1, 1 << 64)
        for name, base in (("up", _M), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def rolling(items: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k consecutive uint64 items, by differences of
    one running polynomial sum modulo 2^64."""
    n = len(items) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(len(items))
    sums = np.empty(len(items) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(items * up[: len(items)], out=sums[1:])
    return mix64((sums[k:] - sums[:n]) * down[:n])


class Forest:
    """Union-find over 0..n-1 whose roots are the smallest members."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join many pairs: hook larger roots to smaller ones and halve paths,
        all at once, until no pair spans two trees."""
        while len(a):
            ra, rb = self.up[a], self.up[b]
            while True:
                na, nb = self.up[ra], self.up[rb]
                if np.array_equal(na, ra) and np.array_equal(nb, rb):
                    break
                ra, rb = na, nb
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))

    def roots(self) -> np.ndarray:
        r = self.up
        while True:
            n = r[r]
            if np.array_equal(n, r):
                return r
            r = n


def solve_runs(rows: DataFrame, key: str, solve, schema: str, least: int = 1) -> DataFrame:
    """Apply ``solve`` to batches of ``rows``, which are partitioned by ``key`` and
    sorted by it first; a run of equal keys always comes in one batch. Small batches
    are gathered to ``least`` rows, where rows are small."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            size += len(b)
            if size < least:
                continue
            b = pd.concat(held, ignore_index=True)
            start = int(np.searchsorted(b[key].to_numpy(), b[key].iloc[-1]))
            # the last run may go on in the next batch
            held, size = [b.iloc[start:].reset_index(drop=True)], len(b) - start
            if start:
                yield solve(b.iloc[:start].reset_index(drop=True))
        if held:
            yield solve(pd.concat(held, ignore_index=True))
        held = []
        give_back_memory()

    return rows.mapInPandas(run, schema)


def in_tiles(rows: DataFrame, key: str, most: int) -> DataFrame:
    """``rows`` (key bigint, id bigint, ...) with tile (bigint) and side (int)
    instead of key, partitioned by tile and sorted by tile and id.

    A group of at most ``most`` rows of one key is one tile of side -1. A larger
    one is cut by a hash of the id into parts of about that size; each part is a
    tile of side -1, and every two parts are a tile with sides 0 and 1, so all
    pairs of a group meet and no task holds more than two parts.
    """
    size = rows.groupBy(key).agg(F.count("*").alias("_n"))
    large = broadcast_if_small(cut(size.where(F.col("_n") > most).select(key, F.ceil(F.col("_n") / most).cast("int").alias("_parts"))))
    others = [c for c in rows.columns if c not in (key, "id")]
    return (
        rows.join(large, key, "left")
        .withColumn("_parts", F.coalesce("_parts", F.lit(1)))
        .withColumn("_part", F.expr("CAST(pmod(xxhash64(id), _parts) AS INT)"))
        .withColumn("_other", F.explode(F.expr("sequence(0, _parts - 1)")))
        .select(
            F.xxhash64(key, F.least("_part", "_other"), F.greatest("_part", "_other")).alias("tile"),
            F.when(F.col("_part") == F.col("_other"), -1).otherwise((F.col("_part") > F.col("_other")).cast("int")).alias("side"),
            "id",
            *others,
        )
        .repartition("tile")
        .sortWithinPartitions("tile", "id")
    )


HUB_EDGES = 10_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: bigint), root being the
    smallest id in its component.

    Alternates the large-star and small-star steps on the edge table: each edge
    is moved to the smallest known neighbour until all edges lead to roots.
    The table never leaves the executors; after each round it is cut. The edges
    of a hub, a node that leads more than ``HUB_EDGES`` and more than a thousandth
    of all edges, stay where they are and get the hub's least neighbour by a
    broadcast: of such nodes there are fewer than a thousand. Null ends and loops
    are dropped. No edges give no rows.
    """
    e = cut(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    n = e.count()
    state = None
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hubs = F.broadcast(e.groupBy("lo").agg(F.count("*").alias("led")).where(F.col("led") > max(HUB_EDGES, n // 1000)).select(F.col("lo").alias("u")))
        led = e.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        spread = led.join(F.broadcast(least.join(hubs, "u", "left_semi")), "u").union(led.join(hubs, "u", "left_anti").join(least, "u"))
        large = spread.select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(least, "hi")
            .select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo")
            .where("hi <> lo")
            .distinct()
        )
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        n = now[0]
        if now == state:
            break
        state = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )

"""Mutex watershed: signed voxel graphs agglomerated into instances."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators.components import grow_labels, min_size, nearest_in_array
from voxloom.operators.graph import broadcast_if_small, components, cut, ranked_by_ranges, release, small_and_large
from voxloom.operators.neighbors import N_PULL, OFFSETS
from voxloom.operators.voxels import AXES, extents
from voxloom.sources.bricks import in_small_batches, to_voxels


def build_edges(affinities: DataFrame, offsets=OFFSETS, n_pull: int = N_PULL, strides=(1, 2, 2), mask: DataFrame | None = None) -> DataFrame:
    """(volume, u, v, idx, weight, mutex) from affinities (volume, z, y, x, idx,
    aff): u and v are raster numbers of a voxel and its neighbour at the offset,
    in bounds. Pull edges weigh their affinity, push edges one minus theirs; of
    push edges those stay that lie on the stride lattice from the first voxel
    with the neighbour in bounds. ``mask`` (volume, z, y, x) keeps edges with both
    ends in it."""
    ext = affinities.groupBy("volume").agg(*(F.max(F.col(a) + 1).cast("int").alias(f"d{a}") for a in AXES))
    o = [F.struct(F.lit(k).alias("k"), *(F.lit(d).alias(f"o{a}") for a, d in zip(AXES, v, strict=True))) for k, v in enumerate(offsets)]
    e = affinities.join(ext, "volume").withColumn("_o", F.element_at(F.array(*o), F.col("idx") + 1)).select("*", "_o.*")
    e = e.where(" AND ".join(f"{a} + o{a} BETWEEN 0 AND d{a} - 1" for a in AXES))
    lattice = " AND ".join(f"({a} - greatest(0, -o{a})) % {s} = 0" for a, s in zip(AXES, strides, strict=True))
    e = e.where(F.expr(f"idx < {n_pull} OR ({lattice})"))
    if mask is not None:
        own, there = mask.select("volume", *AXES), mask.select("volume", *(F.col(a).alias(f"t{a}") for a in AXES))
        e = e.withColumns({f"t{a}": F.col(a) + F.col(f"o{a}") for a in AXES}).join(own, ["volume", *AXES], "left_semi").join(there, ["volume", "tz", "ty", "tx"], "left_semi")
    number = lambda z, y, x: (F.expr(z).cast("bigint") * F.col("dy") + F.expr(y)) * F.col("dx") + F.expr(x)
    push = F.col("idx") >= n_pull
    return e.select("volume", number("z", "y", "x").alias("u"), number("z + oz", "y + oy", "x + ox").alias("v"), "idx", F.when(push, 1 - F.col("aff")).otherwise(F.col("aff")).alias("weight"), push.alias("mutex"))


def cap_push(edges: DataFrame, most: int) -> DataFrame:
    """All pull edges and the ``most`` heaviest push edges of each volume."""
    top = ranked(edges.where("mutex")).where(F.col("rank") <= most).drop("rank")
    return edges.where("NOT mutex").unionByName(top)


def ranked(edges: DataFrame, most: int | None = None) -> DataFrame:
    """``edges`` with rank (bigint): the place in the falling order of its volume's
    weights, ties by offset and raster. Edges of volumes of ``most`` or fewer are shuffled
    packed and sorted as arrays, a volume at a time; those of larger ones are dealt to
    ranges of that whole order, so that neither a large volume nor its edges of one weight
    are sorted by one task."""
    return _with_ranks(edges, most).drop("total")


def priority_buckets(edges: DataFrame, buckets: int, most: int | None = None) -> DataFrame:
    """``edges`` with bucket (1 to ``buckets``) of equal numbers of each volume's
    edges in falling order; of what does not divide, the first have one more each."""
    more, each = F.col("total") % buckets, F.expr(f"total div {buckets}")
    wide = more * (each + 1)
    first = F.col("rank") - 1
    bucket = F.when(first < wide, F.floor(first / (each + 1))).otherwise(more + F.floor((first - wide) / F.greatest(each, F.lit(1)))) + 1
    return _with_ranks(edges, most).withColumn("bucket", bucket.cast("int")).drop("rank", "total")


def _with_ranks(edges: DataFrame, most: int | None) -> DataFrame:
    """``edges`` with rank, as ``ranked`` has it, and total, the edges of the volume."""
    columns, kinds = ["volume", *PACKED], dict(edges.dtypes)
    if set(edges.columns) != set(columns):
        return _ranked_by_ranges(edges, edges.groupBy("volume").agg(F.count("*").alias("total")))
    fit, large = _by_volume(edges, BLOCK_PAIRS if most is None else most)

    def run(e: pd.DataFrame) -> pd.DataFrame:
        out = _unpacked(e)
        out = out.iloc[_falling(out)].assign(volume=e["volume"].iloc[0], total=len(out))
        return out.assign(rank=np.arange(1, len(out) + 1))[[*columns, "rank", "total"]]

    out = fit.groupBy("volume").applyInPandas(run, f"volume string, {PACKED_SCHEMA}, rank bigint, total bigint")
    if large is not None:
        out = out.unionByName(_ranked_by_ranges(_edges_of(large), large.groupBy("volume").agg(F.sum("n").alias("total"))))
    return out.select(*(F.col(c).cast(kinds[c]).alias(c) for c in edges.columns), "rank", "total")


def _ranked_by_ranges(edges: DataFrame, totals: DataFrame) -> DataFrame:
    ranks = ranked_by_ranges(edges, ["volume"], [F.desc("weight"), F.asc("idx"), F.asc("u"), F.asc("v")])
    return ranks.join(totals.hint("shuffle_hash"), ranks["volume"].eqNullSafe(totals["volume"])).drop(totals["volume"])


def _falling(e: pd.DataFrame) -> np.ndarray:
    """The order of falling weights, not-a-number first, ties by offset and raster."""
    w = e["weight"].to_numpy()
    return np.lexsort([e["v"].to_numpy(), e["u"].to_numpy(), e["idx"].to_numpy(), np.where(np.isnan(w), -np.inf, -w)])


VOLUME_EDGES = 1_000_000  # of a volume that a task solves whole
TASK_EDGES = 1_000_000  # of small volumes that a task solves, one after the other


def _by_volume(edges: DataFrame, most: int, extra: tuple = ()) -> tuple[DataFrame, DataFrame | None]:
    """(volume, n, data[, extra]), cut: ``edges``, packed, as many rows as batches and
    volumes; those of volumes of ``most`` edges or fewer, dealt by volume to tasks of about
    ``TASK_EDGES``, and of larger ones, if any. ``extra`` columns (bigint) go along as bytes.
    ``edges`` may have come packed (volume, n, data)."""

    packed = cut(edges.select("volume", "n", "data") if is_packed(edges) else _packed_rows(edges, extra), wide=True)
    return small_and_large(packed, packed.groupBy("volume").agg(F.sum("n").alias("_n")), most, TASK_EDGES)


def _packed_rows(edges: DataFrame, extra: tuple = ()) -> DataFrame:
    def run(batches):
        for e in batches:
            rows = [(None if pd.isna(volume) else volume, len(of), pack(of), *(of[c].to_numpy("<i8").tobytes() for c in extra)) for volume, of in e.groupby("volume", sort=False, dropna=False)]
            yield pd.DataFrame(rows, columns=["volume", "n", "data", *extra])

    e = edges.select("volume", *PACKED[:3], F.col("weight").cast("double").alias("weight"), "mutex", *extra)
    return e.mapInPandas(run, f"volume string, n bigint, data binary{''.join(f', {c} binary' for c in extra)}")


def is_packed(edges: DataFrame) -> bool:
    return set(edges.columns) == {"volume", "n", "data"}


def _unpacked(e: pd.DataFrame) -> pd.DataFrame:
    return pd.concat([_unpack(d, n) for d, n in zip(e["data"], e["n"], strict=True)], ignore_index=True)


def _edges_of(packed: DataFrame) -> DataFrame:
    """The edges of packed rows (volume, n, data), a row each."""

    def run(batches):
        for b in batches:
            for volume, n, data in zip(b["volume"], b["n"], b["data"], strict=True):
                yield _unpack(data, n).assign(volume=volume)[["volume", *PACKED]]

    return packed.select("volume", "n", "data").mapInPandas(run, f"volume string, {PACKED_SCHEMA}")


class Clusters:
    """Clusters of n nodes, and which of them a mutex keeps apart."""

    def __init__(self, n: int):
        self.up, self.apart = list(range(n)), [set() for _ in range(n)]

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def part(self, a: int, b: int) -> None:
        self.apart[a].add(b)
        self.apart[b].add(a)

    def merge(self, a: int, b: int) -> None:
        apart = self.apart
        if len(apart[a]) < len(apart[b]):
            a, b = b, a
        self.up[b] = a
        for c in apart[b]:
            apart[c].discard(b)
            apart[c].add(a)
        apart[a] |= apart[b]
        apart[b] = set()

    def least(self) -> np.ndarray:
        """The smallest member of each node's cluster."""
        roots = np.array([self.root(i) for i in range(len(self.up))], np.int64)
        out = np.full(len(roots), len(roots))
        np.minimum.at(out, roots, np.arange(len(roots)))
        return out[roots]


def _numbered(a: pd.Series, b: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nodes, ends = np.unique(np.concatenate([a.to_numpy(), b.to_numpy()]), return_inverse=True)
    return nodes, ends[: len(a)], ends[len(a) :]


def solve_block(e: pd.DataFrame) -> pd.DataFrame:
    """(node, root) of one block's edges by a Kruskal pass: edges in falling
    weight, ties by offset and raster; a pull edge merges two clusters unless a
    mutex lies between them, a push edge lays one unless they are merged."""
    nodes, u, v = _numbered(e["u"], e["v"])
    order = np.lexsort([e["v"], e["u"], e["idx"], -e["weight"].to_numpy()])
    c = Clusters(len(nodes))
    for a, b, mutex in zip(u[order].tolist(), v[order].tolist(), e["mutex"].to_numpy(bool)[order].tolist(), strict=True):
        a, b = c.root(a), c.root(b)
        if a == b:
            continue
        if mutex:
            c.part(a, b)
        elif b not in c.apart[a]:
            c.merge(a, b)
    return pd.DataFrame({"node": nodes, "root": nodes[c.least()]})


def settle_block(e: pd.DataFrame, span: int) -> pd.DataFrame:
    """(gone, into): the merges that one block can be sure of, from all pairs (a, b,
    weight, h, u, v, mutex) with an end in it, whatever happens in other blocks.

    Pairs go in falling rank. Where a pair that no mutex blocks leads to a cluster
    of another block, what becomes of the cluster on this side is open: it is left
    as it is from there on, and so is any that might merge with it."""
    nodes, a, b = _numbered(e["a"], e["b"])
    c = Clusters(len(nodes))
    mutex = e["mutex"].to_numpy()
    for i, j in zip(a[mutex].tolist(), b[mutex].tolist(), strict=True):
        c.part(i, j)
    left = (nodes // span != int(e["block"].iloc[0])).tolist()
    free = e[~mutex].assign(a=a[~mutex], b=b[~mutex]).sort_values(["weight", "h", "u", "v"], ascending=False, kind="stable")
    for i, j in zip(free["a"].tolist(), free["b"].tolist(), strict=True):
        i, j = c.root(i), c.root(j)
        if i == j or j in c.apart[i]:
            continue
        if left[i] or left[j]:
            left[i] = left[j] = True
        else:
            c.merge(i, j)
    into = nodes[c.least()]
    own = into != nodes
    return pd.DataFrame({"gone": nodes[own], "into": into[own]})


def watershed(edges: DataFrame, block: str = "block") -> DataFrame:
    """(volume, block, node, root): the exact pass in every block of edges, blocks
    in parallel. A block must fit a task; ``stitch`` joins blocks."""

    def run(e: pd.DataFrame) -> pd.DataFrame:
        out = solve_block(e)
        return out.assign(volume=e["volume"].iloc[0], **{block: e[block].iloc[0]})[["volume", block, "node", "root"]]

    kind = dict(edges.dtypes)[block]
    return edges.groupBy("volume", block).applyInPandas(run, f"volume string, {block} {kind}, node bigint, root bigint")


SPAN = 1 << 15  # raster numbers in a block at first; four times as many in each further pass
BLOCK_PAIRS = 1_000_000  # of clusters, that a task solves at once


def boruvka(edges: DataFrame, buckets: int = 4, span: int = SPAN, most: int = BLOCK_PAIRS) -> DataFrame:
    """(volume, node, root) by parallel passes, for graphs that fit no task.

    Edges are taken in ``buckets`` groups of falling weight. In each, push edges
    between different clusters become mutexes. Then clusters merge along their
    best pull edges that no mutex blocks, until nothing merges: first, all blocks
    in parallel, as far as a block of the raster can tell by itself, in blocks that
    grow from pass to pass as the graph shrinks; then, where a block has over
    ``most`` pairs of clusters, in rounds over the whole graph, in which clusters
    merge that are each other's best. Both do what one falling order would do, so
    neither ``span`` nor ``most`` changes the result. A volume of ``most`` edges or
    fewer is one block from the start: its edges are shuffled once, packed.

    With one edge a bucket this is the exact pass; with few it may differ where
    weights of a bucket interleave or tie.
    """
    # ties go by hash: by number, a chain of equal weights would merge one pair a round
    tie = F.when(F.col("mutex"), F.lit(0)).otherwise(F.xxhash64("idx", "u", "v"))
    fit, large = _by_volume(edges.withColumn("h", tie), most, ("h",))

    def run(e: pd.DataFrame) -> pd.DataFrame:
        return solve_buckets(e, buckets).assign(volume=e["volume"].iloc[0])[["volume", "node", "root"]]

    out = fit.groupBy("volume").applyInPandas(run, "volume string, node bigint, root bigint")
    return out if large is None else out.unionByName(_in_rounds(_edges_of(large), buckets, span, most))


def solve_buckets(e: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """(node, root) of one volume's packed edges: bucket by bucket all mutexes between
    different clusters, then the pull edges by falling weight and hash."""
    edges = _unpacked(e)
    h = np.concatenate([np.frombuffer(x, "<i8") for x in e["h"]])
    nodes, u, v = _numbered(edges["u"], edges["v"])
    c, mutex, w = Clusters(len(nodes)), edges["mutex"].to_numpy(), edges["weight"].to_numpy()
    for own in np.array_split(_falling(edges), buckets):
        push, pull = own[mutex[own]], own[~mutex[own]]
        for a, b in zip(u[push].tolist(), v[push].tolist(), strict=True):
            a, b = c.root(a), c.root(b)
            if a != b:
                c.part(a, b)
        pull = pull[np.lexsort([x[pull] for x in (edges["v"].to_numpy(), edges["u"].to_numpy(), h, w)])[::-1]]
        for a, b in zip(u[pull].tolist(), v[pull].tolist(), strict=True):
            a, b = c.root(a), c.root(b)
            if a != b and b not in c.apart[a]:
                c.merge(a, b)
    return pd.DataFrame({"node": nodes, "root": nodes[c.least()]})


def _in_rounds(edges: DataFrame, buckets: int, span: int, most: int) -> DataFrame:
    """``boruvka`` of volumes that fit no task."""
    e = cut(priority_buckets(edges, buckets, most))
    node = lambda c: F.struct("volume", F.col(c).alias("n"))
    roots = cut(e.select(F.explode(F.array(node("u"), node("v"))).alias("s")).select("s.volume", F.col("s.n").alias("node")).distinct().withColumn("root", F.col("node")))
    extent = roots.agg(F.max("node")).first()[0] or 0
    rank = F.when(~F.col("mutex"), F.struct("weight", F.xxhash64("idx", "u", "v").alias("h"), "u", "v"))
    pairs = None
    for k in range(1, buckets + 1):
        new = e.where(F.col("bucket") == k).select("volume", F.col("u").alias("a"), F.col("v").alias("b"), rank.alias("rank"), "mutex")
        new = _renamed(_renamed(new, roots, "node", "root", "a"), roots, "node", "root", "b").select("volume", "a", "b", "rank", "mutex")
        pairs = cut(_contracted(new if pairs is None else new.unionByName(pairs)))
        width = span
        while pairs.where("NOT mutex").limit(1).count():
            merge = cut(_sure_merges(pairs, width, most))
            if width > extent and merge.limit(1).count() == 0:
                merge = cut(_mutual_merges(pairs))
            width = min(4 * width, max(span, 4 * (extent + 1)))
            roots = cut(_renamed(roots, merge, "gone", "into", "root").select("volume", "node", "root"))
            pairs = cut(_contracted(_renamed(_renamed(pairs, merge, "gone", "into", "a"), merge, "gone", "into", "b")))
    return roots


def _contracted(pairs: DataFrame) -> DataFrame:
    """One row for each two clusters: their best pull edge, unless a mutex lies between."""
    p = pairs.where("a <> b").select("volume", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "rank", "mutex")
    return p.groupBy("volume", "a", "b").agg(F.max("rank").alias("rank"), F.bool_or("mutex").alias("mutex"))


def _renamed(d: DataFrame, names: DataFrame, old: str, new: str, column: str) -> DataFrame:
    n = names.select("volume", F.col(old).alias(column), F.col(new).alias("_to"))
    return d.join(n, ["volume", column], "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def _sure_merges(pairs: DataFrame, span: int, most: int) -> DataFrame:
    """(volume, gone, into) from the blocks of ``span`` raster numbers that have
    ``most`` pairs or fewer."""
    ends = F.array_distinct(F.array(F.expr(f"a div {span}"), F.expr(f"b div {span}")))
    dealt = pairs.withColumn("block", F.explode(ends)).select("volume", "block", "a", "b", *(F.coalesce(f"rank.{c}", F.lit(0)).alias(c) for c in ("weight", "h", "u", "v")), "mutex")
    # a block without a free pair of its own has nothing to merge
    inner = F.sum(F.expr(f"CAST(NOT mutex AND a div {span} = b div {span} AS INT)"))
    small = dealt.groupBy("volume", "block").agg(F.count("*").alias("n"), inner.alias("inner")).where((F.col("n") <= most) & (F.col("inner") > 0))

    def run(e: pd.DataFrame) -> pd.DataFrame:
        return settle_block(e, span).assign(volume=e["volume"].iloc[0])[["volume", "gone", "into"]]

    return dealt.join(small.select("volume", "block"), ["volume", "block"], "left_semi").groupBy("volume", "block").applyInPandas(run, "volume string, gone bigint, into bigint")


def _mutual_merges(pairs: DataFrame) -> DataFrame:
    """(volume, gone, into) of the clusters that are each other's best free pair."""
    ends = pairs.where("NOT mutex").select("volume", F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("d")), F.struct(F.col("b").alias("c"), F.col("a").alias("d")))).alias("s"), "rank").select("volume", "s.c", "s.d", "rank")
    best = ends.groupBy("volume", "c").agg(F.max_by("d", "rank").alias("d"))
    back = best.select("volume", F.col("c").alias("d"), F.col("d").alias("c"))
    return best.join(back, ["volume", "c", "d"]).where("c > d").select("volume", F.col("c").alias("gone"), F.col("d").alias("into"))


BLOCK = (8, 64, 64)  # voxels of a block at first; twice as many along each axis in each further pass


def settle_falling(e: pd.DataFrame) -> pd.DataFrame:
    """(gone, into, done): what one block can tell of the falling order over all
    edges, whatever happens elsewhere, from all pairs of clusters (a, b) with an end
    in it: their first pull and push edge, has_pull, pull_*, has_push, push_*.

    A cluster of another block is open, as its further members are not known here.
    A pull edge that no known mutex blocks, with an open end, opens both: whether
    they merge is told elsewhere. Closed clusters are what they are in the whole
    graph at that time, so merges of two, and mutexes of one with any other, are
    sure. A cluster that is closed in the end is done; its pairs matter no more.
    """
    nodes, a, b = _numbered(e["a"], e["b"])
    c = Clusters(len(nodes))
    outside = np.zeros(len(nodes), bool)
    outside[a[~e["in_a"].to_numpy()]] = True
    outside[b[~e["in_b"].to_numpy()]] = True
    is_open = outside.tolist()
    events = []
    for kind in ("pull", "push"):
        at = e[f"has_{kind}"].to_numpy()
        ranks = [e[f"{kind}_{k}"].to_numpy()[at] for k in RANK]
        events.append((a[at], b[at], np.full(int(at.sum()), kind == "push"), *ranks))
    i, j, mutex, *ranks = (np.concatenate(x) for x in zip(*events, strict=True))
    order = np.lexsort([-r for r in ranks[::-1]])
    fixed = np.isinf(ranks[0])
    for x, y, push, sure in zip(i[order].tolist(), j[order].tolist(), mutex[order].tolist(), fixed[order].tolist(), strict=True):
        x, y = c.root(x), c.root(y)
        if x == y:
            continue
        if push:
            if sure or not (is_open[x] and is_open[y]):
                c.part(x, y)
        elif y not in c.apart[x]:
            if is_open[x] or is_open[y]:
                is_open[x] = is_open[y] = True
            else:
                c.merge(x, y)
    into = nodes[c.least()]
    done = ~np.array([is_open[c.root(k)] for k in range(len(nodes))], bool)
    told = ~outside & ((into != nodes) | done)
    return pd.DataFrame({"gone": nodes[told], "into": into[told], "done": done[told]})


RANK = ("weight", "idx", "u", "v")  # of an edge: its weight, then offset and raster, negative, so that the first is the largest


def _first_edges(pairs: DataFrame) -> DataFrame:
    """One row for each two clusters: their first pull and push edge. A pull edge
    behind the push edge of the same two can do nothing, nor can the pairs of a
    cluster without pull edges."""
    p = pairs.where("a <> b").select("volume", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "pull", "push")
    p = p.groupBy("volume", "a", "b").agg(F.max("pull").alias("pull"), F.max("push").alias("push"))
    p = cut(p.withColumn("pull", F.when(F.col("push").isNull() | (F.col("pull") > F.col("push")), F.col("pull"))))
    ends = lambda c: p.where("pull IS NOT NULL").select("volume", F.explode(F.array("a", "b")).alias(c)).distinct()
    return p.join(ends("a"), ["volume", "a"], "left_semi").join(ends("b"), ["volume", "b"], "left_semi")


def _told_by_blocks(pairs: DataFrame, extents: DataFrame, size, most: int) -> DataFrame:
    """(volume, gone, into, done) from the blocks of ``size`` voxels that have
    ``most`` pairs or fewer."""
    p = pairs.join(extents.select("volume", "dy", "dx"), "volume")
    p = p.withColumn("_a", F.expr(_block_sql("a", size))).withColumn("_b", F.expr(_block_sql("b", size)))
    p = p.withColumn("block", F.explode(F.array_distinct(F.array("_a", "_b"))))
    flat = [F.coalesce(f"{kind}.{k}", F.lit(0)).alias(f"{kind}_{k}") for kind in ("pull", "push") for k in RANK]
    dealt = p.select(
        "volume", "block", "a", "b", (F.col("_a") == F.col("block")).alias("in_a"), (F.col("_b") == F.col("block")).alias("in_b"), *(F.col(k).isNotNull().alias(f"has_{k}") for k in ("pull", "push")), *flat
    )
    inner = F.sum((F.col("in_a") & F.col("in_b") & F.col("has_pull")).cast("int"))
    small = dealt.groupBy("volume", "block").agg(F.count("*").alias("n"), inner.alias("inner")).where((F.col("n") <= most) & (F.col("inner") > 0))

    def run(e: pd.DataFrame) -> pd.DataFrame:
        return settle_falling(e).assign(volume=e["volume"].iloc[0])[["volume", "gone", "into", "done"]]

    fit = dealt.join(small.select("volume", "block"), ["volume", "block"], "left_semi")
    return fit.groupBy("volume", "block").applyInPandas(run, "volume string, gone bigint, into bigint, done boolean")


def _foremost(pairs: DataFrame) -> DataFrame:
    """(volume, a, b, merge) of the pairs whose next edge comes before all others of
    both clusters: no other edge can change what it does. A pull edge merges, a
    push edge becomes a mutex for good."""
    event = F.coalesce("pull", F.when(F.col("push.weight") < float("inf"), F.col("push")))
    p = pairs.withColumn("event", event).where("event IS NOT NULL")
    best = p.select("volume", F.explode(F.array("a", "b")).alias("c"), F.struct("event", "a", "b", F.col("pull").isNotNull().alias("merge")).alias("s")).groupBy("volume", "c").agg(F.max("s").alias("s"))
    return best.groupBy("volume", "s.a", "s.b", "s.merge").agg(F.count("*").alias("n")).where("n = 2").drop("n")


PACKED = ("u", "v", "idx", "weight", "mutex")
PACKED_KINDS = ("<i8", "<i8", "<i4", "<f8", "?")
PACKED_SCHEMA = "u bigint, v bigint, idx int, weight double, mutex boolean"


def pack(e) -> bytes:
    """Edges as compressed columns; of a raster number what differs from the one before is kept."""
    u, v, idx, weight, mutex = (np.asarray(e[c], k) for c, k in zip(PACKED, PACKED_KINDS, strict=True))
    return pa.compress(b"".join(x.tobytes() for x in (np.diff(u, prepend=0), v - u, idx, weight, mutex)), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> pd.DataFrame:
    size = n * sum(np.dtype(k).itemsize for k in PACKED_KINDS)
    raw, at, out = pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True), 0, []
    for kind in PACKED_KINDS:
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    u = np.cumsum(out[0])
    return pd.DataFrame(dict(zip(PACKED, (u, out[1] + u, *out[2:]), strict=True)))


def _block_of(n: np.ndarray, dy: int, dx: int, size) -> np.ndarray:
    """The number of the block of ``size`` voxels that a raster number lies in."""
    n = np.asarray(n, np.int64)
    return (n // (dy * dx) // size[0]) * 1000003**2 + (n // dx % dy // size[1]) * 1000003 + n % dx // size[2]


def _dealt_to_blocks(packed: DataFrame, extents: DataFrame, size) -> DataFrame:
    """(volume, block, dy, dx, n, data): packed edges, packed for each block that has an
    end of them. A row an edge is neither shuffled nor written."""

    def run(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                e = _unpack(r.data, r.n)
                at = [_block_of(e[c].to_numpy(), r.dy, r.dx, size) for c in ("u", "v")]
                own = ((block, e[(at[0] == block) | (at[1] == block)]) for block in np.unique(np.concatenate(at)))
                yield pd.DataFrame([(r.volume, block, r.dy, r.dx, len(of), pack(of)) for block, of in own], columns=["volume", "block", "dy", "dx", "n", "data"])

    e = packed.select("volume", "n", "data").join(extents.select("volume", "dy", "dx"), "volume")
    return e.mapInPandas(run, "volume string, block bigint, dy int, dx int, n bigint, data binary")


def _firsts(events: pd.DataFrame) -> pd.DataFrame:
    """Of edges (a, b, mutex, weight, idx, u, v; the latter three negative) the first
    pull and push edge of each two ends, as ``_first_edges`` has them."""
    order = np.lexsort([-events[k].to_numpy() for k in RANK[::-1]])
    e = events.iloc[order].assign(_at=np.arange(len(order))).drop_duplicates(["a", "b", "mutex"])
    pull, push = (e[e["mutex"] == m].drop(columns="mutex").rename(columns={k: f"{kind}_{k}" for k in (*RANK, "_at")}) for m, kind in ((False, "pull"), (True, "push")))
    p = pull.merge(push, on=["a", "b"], how="outer")
    # a pull edge behind the push edge of the same two can do nothing
    p["has_push"] = p["push__at"].notna()
    p["has_pull"] = p["pull__at"].notna() & ~(p["pull__at"] > p["push__at"])
    return p.drop(columns=["pull__at", "push__at"])


#: what a block leaves: arrays of its nodes, of those with edges to other blocks, and of pairs, in bytes
NODES = {"node": "<i8", "root": "<i8", "done": "?"}
BORDER = {"border": "<i8", "border_root": "<i8", "border_done": "?"}
PAIRS = {"a": "<i8", "b": "<i8", "far": "?"} | {f"{kind}_{k}": "<f8" if k == "weight" else "<i8" for kind in ("pull", "push") for k in RANK} | {"has_pull": "?", "has_push": "?"}
STATE = "volume string, at bigint, dy int, dx int, n_pairs bigint, n_border bigint, nodes binary, border binary, pairs binary"
SQL_KINDS = {"<i8": "bigint", "<f8": "double", "<i4": "int", "?": "boolean"}


def _in_bytes(arrays, kinds: dict) -> bytes:
    """Arrays of one length, named and typed by ``kinds``, compressed."""
    raw = b"".join(np.ascontiguousarray(arrays[c], k).tobytes() for c, k in kinds.items())
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _of_bytes(data: bytes, kinds: dict) -> pd.DataFrame:
    size, at, out = int.from_bytes(data[:8], "little"), 0, {}
    raw = pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True)
    n = size // sum(np.dtype(k).itemsize for k in kinds.values())
    for c, k in kinds.items():
        out[c] = np.frombuffer(raw, k, n, at)
        at += out[c].nbytes
    return pd.DataFrame(out)


def _opened(state: DataFrame, column: str, kinds: dict) -> DataFrame:
    """(volume, *kinds): a row for each place of the arrays in a column of bytes."""

    def run(batches):
        for b in batches:
            for volume, data in zip(b["volume"], b[column], strict=True):
                yield _of_bytes(data, kinds).assign(volume=volume)[["volume", *kinds]]

    return state.select("volume", column).mapInPandas(run, f"volume string, {', '.join(f'{c} {SQL_KINDS[k]}' for c, k in kinds.items())}")


def _events(p: pd.DataFrame) -> pd.DataFrame:
    parts = []
    for kind in ("pull", "push"):
        own = p[p[f"has_{kind}"].to_numpy(bool)]
        parts.append(pd.DataFrame({"a": own["a"], "b": own["b"], "mutex": kind == "push", "weight": own[f"{kind}_weight"].astype(float), **{k: own[f"{kind}_{k}"].astype("int64") for k in RANK[1:]}}))
    return pd.concat(parts, ignore_index=True)


def _settled(volume: str, at: int, p: pd.DataFrame, nodes: np.ndarray, inside, borders: tuple, dy: int, dx: int) -> pd.DataFrame:
    """One row (``STATE``): what a block can be sure of (``settle_falling``) about
    its own sorted ``nodes``, from all pairs with an end in it, and what is left of these, as first
    edges of two clusters; ``at`` is a raster number in the block. Of ``far`` ones, b is a node of another block, and both blocks
    hand them on; ``borders`` are the nodes with such edges, and their roots."""
    roots, done = nodes.copy(), np.zeros(len(nodes), bool)
    p["in_a"], p["in_b"] = inside(p["a"].to_numpy()), inside(p["b"].to_numpy())
    if len(p):
        told = settle_falling(p)
        gone = np.searchsorted(nodes, told["gone"].to_numpy())
        roots[gone], done[gone] = told["into"].to_numpy(), told["done"].to_numpy()
    place = lambda n: np.minimum(np.searchsorted(nodes, n), max(len(nodes) - 1, 0))
    for c in ("a", "b"):
        to, own = place(p[c].to_numpy()), p[f"in_{c}"].to_numpy()
        p[f"done_{c}"] = own & done[to]
        p[c] = np.where(own, roots[to], p[c])
    p = p[~p["done_a"].to_numpy() & ~p["done_b"].to_numpy() & (p["a"] != p["b"]).to_numpy()]
    left = []
    for far in (False, True):
        q = p[(p["in_a"] & p["in_b"]).to_numpy() != far]
        swap = ~q["in_a"].to_numpy() if far else (q["a"] > q["b"]).to_numpy()
        q = q.assign(a=np.where(swap, q["b"], q["a"]), b=np.where(swap, q["a"], q["b"]))
        left.append(_firsts(_events(q)).assign(far=far))
    left = pd.concat(left, ignore_index=True)
    border, border_root, border_done = borders
    if len(nodes):
        to = place(border_root)
        known = nodes[to] == border_root
        border_done = border_done | (known & done[to])
        border_root = np.where(known, roots[to], border_root)
    arrays = {c: left[c].fillna(0).to_numpy(np.dtype(kind)) for c, kind in PAIRS.items()}
    held = [_in_bytes({"node": nodes, "root": roots, "done": done}, NODES), _in_bytes({"border": border, "border_root": border_root, "border_done": border_done}, BORDER), _in_bytes(arrays, PAIRS)]
    return pd.DataFrame([(volume, at, dy, dx, len(left), len(border), *held)], columns=[c.split()[0] for c in STATE.split(", ")])


def _first_pairs(edges: pd.DataFrame) -> pd.DataFrame:
    """The first pull and push edge of each two nodes."""
    edges = edges[edges["u"] != edges["v"]]
    return _firsts(edges[["mutex", "weight"]].assign(a=np.minimum(edges["u"], edges["v"]), b=np.maximum(edges["u"], edges["v"]), **{k: -edges[k].astype("int64") for k in RANK[1:]}))


def first_block(e: pd.DataFrame, size) -> pd.DataFrame:
    """What one block tells from all packed edges with an end in it."""
    block, dy, dx = int(e["block"].iloc[0]), int(e["dy"].iloc[0]), int(e["dx"].iloc[0])
    inside = lambda n: _block_of(n, dy, dx, size) == block
    edges = _unpacked(e)
    ends = np.unique(edges[["u", "v"]].to_numpy())
    nodes = ends[inside(ends)]
    p = _first_pairs(edges)
    in_a, in_b = inside(p["a"].to_numpy()), inside(p["b"].to_numpy())
    border = np.unique(np.where(in_a, p["a"], p["b"])[in_a != in_b])
    return _settled(e["volume"].iloc[0], int(nodes[0]), p, nodes, inside, (border, border, np.zeros(len(border), bool)), dy, dx)


def solve_regions(e: pd.DataFrame, size) -> pd.DataFrame:
    """(node, region, instance) of one volume's packed edges: what each block of ``size`` tells
    by itself, as ``first_block`` does, and what the falling order over the volume makes."""
    dy, dx, edges = int(e["dy"].iloc[0]), int(e["dx"].iloc[0]), _unpacked(e)
    one = solve_block(edges)
    nodes, region = one["node"].to_numpy(), one["node"].to_numpy().copy()
    pairs = _first_pairs(edges)
    in_a, in_b = (_block_of(pairs[c].to_numpy(), dy, dx, size) for c in ("a", "b"))
    for block in np.unique(np.concatenate([in_a, in_b])):
        own = (in_a == block) | (in_b == block)
        told = settle_falling(pairs[own].assign(in_a=in_a[own] == block, in_b=in_b[own] == block))
        region[np.searchsorted(nodes, told["gone"].to_numpy())] = told["into"].to_numpy()
    return pd.DataFrame({"node": nodes, "region": region, "instance": one["root"].to_numpy()})


def next_block(e: pd.DataFrame, size) -> pd.DataFrame:
    """What a wider block tells from what the blocks in it have left."""
    dy, dx = int(e["dy"].iloc[0]), int(e["dx"].iloc[0])
    first = int(e["at"].iloc[0])
    block = _block_of(first, dy, dx, size)
    inside = lambda n: _block_of(n, dy, dx, size) == block
    p = pd.concat([_of_bytes(x, PAIRS) for x in e["pairs"]], ignore_index=True)
    border, border_root, border_done = (np.concatenate(x) for x in zip(*([d[c].to_numpy() for c in BORDER] for d in (_of_bytes(x, BORDER) for x in e["border"])), strict=True))
    order = np.argsort(border)
    border, border_root, border_done = border[order], border_root[order], border_done[order]
    # pairs over a cut that is none any more: each of the two blocks has handed on its own view
    met = p["far"].to_numpy(bool) & inside(p["b"].to_numpy())
    at = np.searchsorted(border, p["b"].to_numpy()[met])
    b, gone = p["b"].to_numpy().copy(), np.zeros(len(p), bool)
    b[met], gone[met] = border_root[at], border_done[at]
    far = p["far"].to_numpy(bool) & ~met
    p["a"], p["b"] = np.where(far, p["a"], np.minimum(p["a"], b)), np.where(far, b, np.maximum(p["a"], b))
    p = _firsts(_events(p[~gone]))
    ends = np.unique(np.concatenate([p["a"], p["b"]])).astype(np.int64)
    return _settled(e["volume"].iloc[0], first, p, ends[inside(ends)], inside, (border, border_root, border_done), dy, dx)


def _left_as_is(packed: DataFrame, size) -> tuple[DataFrame, DataFrame]:
    """Of blocks that fit no task: (volume, node, root, done), each node its own
    root, and the edges whose smaller end lies in one, as pairs of which b may be a
    node of another block."""

    def run(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                e = _unpack(r.data, r.n)
                low, high = np.minimum(e["u"], e["v"]), np.maximum(e["u"], e["v"])
                out = pd.DataFrame({"a": low, "b": high, "mutex": e["mutex"], "weight": e["weight"], **{k: -e[k].astype("int64") for k in RANK[1:]}})
                out["in_a"], out["in_b"] = (_block_of(out[c].to_numpy(), r.dy, r.dx, size) == r.block for c in ("a", "b"))
                yield out.assign(volume=r.volume)

    e = packed.mapInPandas(run, "volume string, a bigint, b bigint, mutex boolean, weight double, idx bigint, u bigint, v bigint, in_a boolean, in_b boolean")
    ends = F.explode(F.filter(F.array(F.when(F.col("in_a"), F.col("a")), F.when(F.col("in_b"), F.col("b"))), lambda x: x.isNotNull()))
    nodes = e.select("volume", ends.alias("node")).distinct().select("volume", "node", F.col("node").alias("root"), F.lit(False).alias("done"))
    rank = F.struct(*RANK)
    pairs = e.where("in_a AND a <> b").select("volume", "a", "b", F.lit(True).alias("far"), F.when(~F.col("mutex"), rank).alias("pull"), F.when(F.col("mutex"), rank).alias("push"))
    return nodes, pairs


def _rows_of(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(volume, a, b, far, pull, push) and (volume, b, _to, _done) of what blocks have left,
    the pairs and the border nodes, a row each."""
    pairs = _opened(state, "pairs", PAIRS)
    whole = [F.when(F.col(f"has_{kind}"), F.struct(*(F.col(f"{kind}_{k}").alias(k) for k in RANK))).alias(kind) for kind in ("pull", "push")]
    border = _opened(state, "border", BORDER).toDF("volume", "b", "_to", "_done")
    return pairs.select("volume", "a", "b", "far", *whole), border


def _block_sql(n: str, size) -> str:
    z, y, x = f"{n} div (CAST(dy AS BIGINT) * dx) div {size[0]}", f"({n} div dx) % dy div {size[1]}", f"{n} % dx div {size[2]}"
    return f"({z}) * 1000003 * 1000003 + ({y}) * 1000003 + ({x})"


def _of_size(solve, size):
    size = tuple(size)
    return lambda e: solve(e, size)


def _in_arrays(edges: DataFrame, extents: DataFrame, size: list, widest, most: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None, list]:
    """Passes in which all that a block has left is one row, while that is ``most`` pairs
    and border nodes or fewer: (volume, node, root, done) of all nodes after the first
    one, (volume, root, last), what became of roots that were open, the pairs that are
    left, as ``_first_edges``, if any, and the size of blocks to go on with."""
    packed = cut(_dealt_to_blocks(edges, extents, size), wide=True)
    large = broadcast_if_small(cut(packed.groupBy("volume", "block").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("volume", "block")))
    fit = packed.join(large, ["volume", "block"], "left_anti").groupBy("volume", "block")
    state = cut(fit.applyInPandas(_of_size(first_block, size), STATE), wide=True)
    nodes = _opened(state, "nodes", NODES)
    more = None
    if large.limit(1).count():
        own, more = (cut(x) for x in _left_as_is(packed.join(large, ["volume", "block"], "left_semi"), tuple(size)))
        nodes = nodes.unionByName(own)
    release(packed)
    has_pairs = F.col("n_pairs") > 0
    if more is None and state.where(has_pairs).limit(1).count() == 0:
        return nodes, None, None, size
    names = cut(nodes.where("node = root AND NOT done").select("volume", "root", F.col("root").alias("last")))
    held = None
    while more is None:
        size = [min(2 * s, max(s, w or 1)) for s, w in zip(size, widest, strict=True)]
        block = F.expr(_block_sql("at", size)).alias("block")
        if state.groupBy("volume", block).agg(F.sum(F.col("n_pairs") + F.col("n_border")).alias("n")).where(F.col("n") > most).limit(1).count():
            break
        wider = cut(state.drop("nodes").withColumn("block", block).groupBy("volume", "block").applyInPandas(_of_size(next_block, size), STATE), wide=True)
        merge = _opened(wider, "nodes", NODES).where("node <> root").select("volume", F.col("node").alias("gone"), F.col("root").alias("into"))
        before, names = names, cut(_renamed(names, broadcast_if_small(cut(merge)), "gone", "into", "last").select("volume", "root", "last"))
        if held is not None:
            release(held)  # not the first: nodes are read from it
        release(before)
        held = state = wider
        if state.where(has_pairs).limit(1).count() == 0:
            return nodes, names, None, size
    pairs, border = _rows_of(state)
    if more is not None:
        pairs = pairs.unionByName(more)
    across = pairs.where("far").join(border.hint("shuffle_hash"), ["volume", "b"], "left").where("_done IS NULL OR NOT _done").withColumn("b", F.coalesce("_to", "b"))
    columns = ["volume", "a", "b", "pull", "push"]
    return nodes, names, cut(_first_edges(pairs.where("NOT far").select(columns).unionByName(across.select(columns)))), size


def _in_passes(edges: DataFrame, extents: DataFrame, size, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(volume, node, root) after the first pass, and (volume, root, last): what further
    passes over all clusters make of the roots that were open, where it is another."""
    extents = cut(extents.select("volume", *(f"d{a}" for a in AXES)))
    widest = extents.agg(*(F.max(f"d{a}") for a in AXES)).first()
    extents = broadcast_if_small(extents)
    nodes, names, pairs, size = _in_arrays(edges, extents, list(size), widest, most)
    held = pairs
    while pairs is not None and pairs.where("pull IS NOT NULL").limit(1).count():
        told = cut(_told_by_blocks(pairs, extents, size, most))
        whole = all(s >= (w or 1) for s, w in zip(size, widest, strict=True))
        if whole and told.limit(1).count() == 0:
            first = cut(_foremost(pairs))
            told = cut(first.where("merge").select("volume", F.col("b").alias("gone"), F.col("a").alias("into"), F.lit(False).alias("done")))
            mark = first.where("NOT merge").select("volume", "a", "b", F.lit(True).alias("_fixed"))
            sure = F.struct(F.lit(float("inf")).alias("weight"), *(F.col(f"push.{c}").alias(c) for c in RANK[1:]))
            pairs = pairs.join(mark, ["volume", "a", "b"], "left").withColumn("push", F.when(F.col("_fixed"), sure).otherwise(F.col("push"))).drop("_fixed")
        merge = broadcast_if_small(told.where("gone <> into"))
        before, names = names, cut(_renamed(names, merge, "gone", "into", "last").select("volume", "root", "last"))
        release(before)
        done = told.where("done").select("volume", F.col("into").alias("_d")).distinct()
        named = _renamed(_renamed(pairs, merge, "gone", "into", "a"), merge, "gone", "into", "b")
        for c in ("a", "b"):
            named = named.join(done.withColumnRenamed("_d", c), ["volume", c], "left_anti")
        before, pairs = held, cut(_first_edges(named))
        held = pairs
        release(before, told)
        size = [min(2 * s, max(s, w or 1)) for s, w in zip(size, widest, strict=True)]
    nodes = nodes.select("volume", "node", "root")
    return nodes, None if names is None else broadcast_if_small(cut(names.where("root <> last")))


def exact(edges: DataFrame, extents: DataFrame, size=BLOCK, most: int = BLOCK_PAIRS) -> DataFrame:
    """(volume, node, root) as the one falling order over all edges of a volume gives
    it (``solve_block``), ties by offset and raster. ``edges`` come a row each, or packed.

    A volume of ``most`` edges or fewer is solved whole; tasks have as many of these as
    make ``TASK_EDGES``. Of larger volumes none is in one task: blocks of the raster, in
    parallel, settle what no other block can change; open clusters are carried on as nodes
    of a contracted graph, with the first pull and push edge of each two of them, to blocks
    twice as wide, until none is open. Edges come to blocks packed.
    Where a block has over ``most`` pairs, pairs that come first at both their
    clusters are settled over the whole graph instead, round by round. Neither
    ``size`` nor ``most`` changes the result. ``extents`` has (volume, dz, dy, dx).
    """
    fit, large = _by_volume(edges, min(most, VOLUME_EDGES))

    def run(e: pd.DataFrame) -> pd.DataFrame:
        return solve_block(_unpacked(e)).assign(volume=e["volume"].iloc[0])[["volume", "node", "root"]]

    out = fit.groupBy("volume").applyInPandas(run, "volume string, node bigint, root bigint")
    return out if large is None else out.unionByName(_in_blocks(large, extents, size, most))


def _in_blocks(packed: DataFrame, extents: DataFrame, size, most: int) -> DataFrame:
    """``exact`` of packed edges of volumes that fit no task."""
    nodes, names = _in_passes(packed, extents, size, most)
    return nodes if names is None else _renamed(nodes, names, "root", "last", "root").select("volume", "node", "root")


def stitch_blocks(edges: DataFrame, extents: DataFrame, size=BLOCK, most: int = BLOCK_PAIRS) -> DataFrame:
    """(volume, node, region, instance): regions that the blocks of ``size`` find each
    by itself, and the instances that they make over the cuts, with the edges
    that cross them and the mutexes that regions bring along: the partition of the
    volume without cuts. Volumes are solved whole or in passes, as by ``exact``."""
    extents = cut(extents.select("volume", *(f"d{a}" for a in AXES)))
    fit, large = _by_volume(edges, min(most, VOLUME_EDGES))
    size = tuple(size)

    def run(e: pd.DataFrame) -> pd.DataFrame:
        return solve_regions(e, size).assign(volume=e["volume"].iloc[0])[["volume", "node", "region", "instance"]]

    sized = fit.join(broadcast_if_small(extents.select("volume", "dy", "dx")), "volume")
    out = sized.groupBy("volume").applyInPandas(run, "volume string, node bigint, region bigint, instance bigint")
    if large is None:
        return out
    nodes, names = _in_passes(large, extents, size, most)
    both = nodes.select("volume", "node", F.col("root").alias("region"), F.col("root").alias("instance"))
    return out.unionByName(both if names is None else _renamed(both, names, "root", "last", "instance").select("volume", "node", "region", "instance"))


def stitch(overlaps: DataFrame, share: float = 0.5) -> DataFrame:
    """(node, root) over instances of different blocks that are the best match of
    each other in their overlap (a, b, n: shared voxels) and share at least
    ``share`` of the smaller one's voxels there; matches chain."""
    wa, wb = Window.partitionBy("a"), Window.partitionBy("b")
    o = overlaps.withColumns({"ta": F.sum("n").over(wa), "tb": F.sum("n").over(wb), "ra": F.row_number().over(wa.orderBy(F.desc("n"), "b")), "rb": F.row_number().over(wb.orderBy(F.desc("n"), "a"))})
    return components(o.where((F.col("ra") == 1) & (F.col("rb") == 1) & (F.col("n") >= share * F.least("ta", "tb"))).select("a", "b"))


def finish(voxels: DataFrame, foreground: str, least: int, column: str = "component") -> DataFrame:
    """Instances outside the foreground and those of too few voxels become 0."""
    return min_size(voxels.withColumn(column, F.when(F.col(foreground), F.col(column)).otherwise(F.lit(0).cast("bigint"))), least, column)


VOXELS = {"z": "<i4", "y": "<i4", "x": "<i4", "fg": "?"}


def _packed_voxels(voxels: DataFrame, foreground: str) -> DataFrame:
    """(volume, dz, dy, dx, data): coordinates and foreground of voxels, or of bricks' voxels,
    in bytes, as many rows as batches and volumes, or as bricks."""

    def of_rows(batches):
        for v in batches:
            rows = [(volume, *(int(of[a].max()) + 1 for a in AXES), _in_bytes(of, VOXELS)) for volume, of in v.groupby("volume", sort=False)]
            yield pd.DataFrame(rows, columns=["volume", "dz", "dy", "dx", "data"])

    def of_bricks(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                at = np.indices((r.dz, r.dy, r.dx)).reshape(3, -1) + np.array([[r.z0], [r.y0], [r.x0]])
                held = dict(zip(VOXELS, (*at, np.asarray(getattr(r, foreground), bool)), strict=True))
                rows.append((r.volume, r.z0 + r.dz, r.y0 + r.dy, r.x0 + r.dx, _in_bytes(held, VOXELS)))
            yield pd.DataFrame(rows, columns=["volume", "dz", "dy", "dx", "data"])

    schema = "volume string, dz bigint, dy bigint, dx bigint, data binary"
    v = voxels.where("volume IS NOT NULL")
    if "bz" in voxels.columns:
        return in_small_batches(v).select("volume", *(f"{a}0" for a in AXES), *(f"d{a}" for a in AXES), foreground).mapInPandas(of_bricks, schema)
    return v.select("volume", *AXES, F.coalesce(foreground, F.lit(False)).alias("fg")).mapInPandas(of_rows, schema)


def finished(edges: pd.DataFrame, voxels: pd.DataFrame, least: int, grow: float | None, sampling) -> pd.DataFrame:
    """(z, y, x, instance) of one volume, as ``agglomerate`` says it, from its edges and its
    voxels (z, y, x, fg)."""
    at = voxels[list(AXES)].to_numpy(np.int64)
    shape = at.max(axis=0) + 1
    number = (at[:, 0] * shape[1] + at[:, 1]) * shape[2] + at[:, 2]
    root, fg = number.copy(), voxels["fg"].to_numpy(bool)
    if len(edges):
        solved = solve_block(edges)
        nodes, place = solved["node"].to_numpy(), np.minimum(np.searchsorted(solved["node"], number), len(solved) - 1)
        known = nodes[place] == number
        root[known] = solved["root"].to_numpy()[place[known]]
    ids, of, size = np.unique(np.where(fg, root + 1, 0), return_inverse=True, return_counts=True)
    kept = (ids > 0) & (size >= least)
    instance = np.where(kept, np.cumsum(kept), 0)[of]
    if grow is not None:
        d2, near = np.full(shape, np.inf), np.zeros(shape, np.int64)
        source, where = instance > 0, tuple(at.T)
        d2[tuple(at[source].T)], near[where] = 0.0, instance
        d2, near = (a[where] for a in nearest_in_array(d2, near, sampling))
        instance = np.where(np.isinf(d2) | ((np.sqrt(d2) > grow) & (grow > 0)), 0, near)
    return voxels[list(AXES)].assign(instance=instance)


def agglomerate(
    edges: DataFrame, voxels: DataFrame, foreground: str, least: int = 0, max_push: int | None = None, grow: float | None = None, sampling=(1.0, 1.0, 1.0), size=BLOCK, most: int = BLOCK_PAIRS
) -> DataFrame:
    """(volume, z, y, x, instance): the whole way from edges (with both ends in the
    foreground, as ``affinities.edges`` makes them with a mask) to instances.

    Of push edges the ``max_push`` heaviest of a volume stay, the watershed is exact,
    voxels of the foreground without an edge are instances of their own, instances of
    fewer than ``least`` voxels become background, and those left are counted from 1
    by first voxel. With ``grow``, labels grow that far into the background (all the
    way, if 0), by voxel sizes ``sampling``.

    ``edges`` come a row each, or packed; ``voxels`` as rows or as bricks. A volume of ``most``
    edges and of a box of ``most`` voxels or fewer goes the whole way in one task, as arrays; of
    larger ones none is in one task.
    """
    if max_push is not None:
        edges = cap_push(_edges_of(edges) if is_packed(edges) else edges, max_push)
    most_whole = min(most, VOLUME_EDGES)
    e = (edges.select("volume", "n", "data") if is_packed(edges) else _packed_rows(edges)).withColumns({f"d{a}": F.lit(0).cast("bigint") for a in AXES})
    packed = cut(e.unionByName(_packed_voxels(voxels, foreground).withColumn("n", F.lit(0).cast("bigint"))), wide=True)
    box = F.max("dz") * F.max("dy") * F.max("dx")
    fit, large = small_and_large(packed, packed.groupBy("volume").agg(F.greatest(F.sum("n"), box).alias("_n")), most_whole, TASK_EDGES)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        of_edges = p["dz"] == 0
        if of_edges.all():
            return pd.DataFrame(columns=["volume", *AXES, "instance"])
        v = pd.concat([_of_bytes(d, VOXELS) for d in p["data"][~of_edges]], ignore_index=True)
        e = _unpacked(p[of_edges]) if of_edges.any() else pd.DataFrame(columns=PACKED)
        return finished(e, v, least, grow, sampling).assign(volume=p["volume"].iloc[0])[["volume", *AXES, "instance"]]

    out = fit.groupBy("volume").applyInPandas(run, "volume string, z int, y int, x int, instance bigint")
    if large is not None:
        rows = voxels if "bz" not in voxels.columns else to_voxels(voxels, (foreground,))
        own = large.where("dz > 0").select("volume").distinct()
        rows = rows.join(broadcast_if_small(cut(own)), "volume", "left_semi")
        out = out.unionByName(_agglomerated(large.where("dz = 0").select("volume", "n", "data"), rows, foreground, least, grow, sampling, size, most))
    return out


def _agglomerated(packed: DataFrame, voxels: DataFrame, foreground: str, least: int, grow: float | None, sampling, size, most: int) -> DataFrame:
    """``agglomerate`` of volumes that fit no task, from packed edges."""
    ext = extents(voxels).drop("n_voxels")
    roots = _in_blocks(packed, ext, size, most)
    numbered = voxels.select("volume", *AXES, F.col(foreground).alias("_fg")).join(broadcast_if_small(cut(ext)), "volume")
    numbered = numbered.withColumn("node", (F.col("z").cast("bigint") * F.col("dy") + F.col("y")) * F.col("dx") + F.col("x"))
    joined = numbered.join(roots, ["volume", "node"], "left").withColumn("instance", F.when(F.col("_fg"), F.coalesce("root", "node") + 1).otherwise(F.lit(0).cast("bigint")))
    kept = cut(min_size(joined.select("volume", *AXES, "instance"), least, "instance"))
    ids = ranked_by_ranges(kept.where("instance > 0").select("volume", "instance").distinct(), ["volume"], [F.asc("instance")])
    out = kept.join(broadcast_if_small(cut(ids)), ["volume", "instance"], "left").select("volume", *AXES, F.coalesce("rank", F.lit(0)).cast("bigint").alias("instance"))
    if grow is None:
        return out
    return grow_labels(cut(out), grow, "instance", sampling).withColumnRenamed("grown", "instance")

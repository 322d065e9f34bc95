"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors at cosine c are sqrt(2 - 2c) = epsilon apart. Vectors are turned to
their principal axes, put in order of the cells, epsilon wide, of a grid on the
leading ones, and cut into sequence intervals. Pairs of intervals are joined
recursively: a pair whose bounding boxes are over epsilon apart is skipped, a
small one is compared by a matrix product, the others are halved.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import Forest, connected_components, cut, join_hot, long_text, longs, shuffle_partitions

GRID_DIMS = 6
LEAF = 512
GROUP_ROWS = 32_768  # rows of one of the two sides that a task joins, at most


def all_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, dim, raw binary, key) of every row; the last three are null unless the
    vector is not null, empty or zero and has finite components only. raw holds
    little-endian doubles, scaled by a power of two so that the largest is near one
    and no square overflows or vanishes; key is a 128-bit hash of them."""

    def run(batches):
        for b in batches:
            out = []
            for i, v in zip(b["id"], b["v"], strict=True):
                out.append((i, None, None, None))
                if v is None or not len(v):
                    continue
                a = np.array([np.nan if x is None else x for x in v] if v.dtype == object else v, np.float64) + 0.0
                top = np.abs(a).max()
                if np.isfinite(top) and top > 0:
                    raw = (np.ldexp(a, -int(np.frexp(top)[1])) + 0.0).astype("<f8").tobytes()
                    out[-1] = (i, len(a), raw, xxhash.xxh3_128_hexdigest(raw))
            rows = pd.DataFrame(out, columns=["id", "dim", "raw", "key"])
            yield rows.assign(id=longs([r[0] for r in out]), dim=longs([r[1] for r in out]))

    picked = table.select(long_text(id_col).alias("id"), F.col(vec_col).alias("v"))
    return picked.mapInPandas(run, "id bigint, dim int, raw binary, key string")


def _matrix(raw, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f8").reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(points: DataFrame, dim: int) -> np.ndarray:
    """The axes (columns, by falling variance) of all unit vectors; tasks send
    their sums of products row by row, and each row is summed in one place."""

    def partial(batches):
        total = np.zeros((dim + 1, dim))
        n = 0
        for b in batches:
            if len(b):
                u = _unit(_matrix(b["raw"], dim))
                total[:dim] += u.T @ u
                total[dim] += u.sum(axis=0)
                n += len(u)
        if n:
            yield pd.DataFrame({"row": np.arange(dim + 1), "n": n, "sums": list(total)})

    def add(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": b["row"].iloc[:1], "n": [b["n"].sum()], "sums": [np.stack(b["sums"].to_numpy()).sum(axis=0)]})

    schema = "row int, n bigint, sums array<double>"
    rows = {r["row"]: r for r in points.select("raw").mapInPandas(partial, schema).groupBy("row").applyInPandas(add, schema).toLocalIterator()}
    if not rows:
        return np.eye(dim)
    n = rows[dim]["n"]
    mean = np.array(rows[dim]["sums"]) / n
    cov = np.array([rows[k]["sums"] for k in range(dim)]) / n - np.outer(mean, mean)
    values, axes = np.linalg.eigh((cov + cov.T) / 2)
    return axes[:, np.argsort(-values)]


def join_blocks(a: slice, b: slice, bounds, eps: float, leaf) -> None:
    """Recursive join of two intervals of rows; ``leaf(a, b)`` compares small ones."""
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        lo_a, hi_a = bounds(a)
        lo_b, hi_b = bounds(b)
        gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
        if (gap * gap).sum() > eps * eps:
            continue
        na, nb = a.stop - a.start, b.stop - b.start
        if na <= LEAF and nb <= LEAF:
            leaf(a, b)
        elif a == b:
            m = (a.start + a.stop) // 2
            left, right = slice(a.start, m), slice(m, a.stop)
            stack += [(left, left), (left, right), (right, right)]
        elif na >= nb:
            m = (a.start + a.stop) // 2
            stack += [(slice(a.start, m), b), (slice(m, a.stop), b)]
        else:
            m = (b.start + b.stop) // 2
            stack += [(a, slice(b.start, m)), (a, slice(m, b.stop))]


def near_vectors(table: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links bigint, component bigint) of every row.

    Two vectors of equal length are linked if their cosine, in doubles, is
    ``cosine`` (over 0) or more. n_links counts the others linked directly;
    component is the smallest id that links lead to. Null, empty and zero vectors
    and those with a null or non-finite component link with nothing. Exact:
    intervals are skipped only where a bound on distance proves it.

    Every row is a vector of its own, whether its id repeats or is null: it counts
    and is counted. The component of a row is the smallest id, not null, of the rows
    that links lead to; null, if none of them has an id. An empty table gives no rows.

    Equal vectors are one point with a number of copies. No pair leaves a task:
    each returns link counts and the spanning forest of its links.
    """
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-9
    vectors = cut(all_vectors(table, id_col, vec_col))
    # numbered once: the same number wherever the table is read
    points_all = cut(
        vectors.where("key IS NOT NULL")
        .groupBy("dim", "key")
        .agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("raw").alias("raw"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    found = None
    for row in points_all.groupBy("dim").count().collect():  # one row for each length of vectors
        part = _links_of_length(points_all.where(F.col("dim") == row["dim"]), row["dim"], row["count"], cosine, eps)
        found = part if found is None else found.unionByName(part)
    alone = lambda rows: rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    if found is None:
        return alone(vectors)
    found = cut(found)
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    rooted = cut(
        points_all.select("key", "id", "copies", "least")
        .join(counts, "id", "left")
        .join(roots, F.col("id") == F.col("node"), "left")
        .select("key", "copies", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("root"))
    )
    classes = rooted.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("points"))
    named = join_hot(rooted.drop("least"), classes, "root", "points", rooted.count()).select("key", "copies", "n_links", "component")
    valid = vectors.where("key IS NOT NULL").select("id", "key")
    own = join_hot(valid, named, "key", "copies", valid.count()).select("id", F.col("n_links").cast("long").alias("n_links"), "component")
    return own.unionByName(alone(vectors.where("key IS NULL")))


def _links_of_length(points: DataFrame, dim: int, n: int, cosine: float, eps: float) -> DataFrame:
    """(id, links, root) of the points that have links, per pair of intervals."""
    axes = principal_axes(points, dim)
    leading = min(GRID_DIMS, dim)
    # each vector goes to as many tasks as there are groups near its own, at most all:
    # so many groups that their pairs keep every task busy, or that a pair fits one
    groups = max(math.isqrt(2 * shuffle_partitions(points.sparkSession)) + 1, -(-n // GROUP_ROWS))

    def place(batches):
        for b in batches:
            if len(b):
                p = _unit(_matrix(b["raw"], dim)) @ axes[:, :leading]
                yield b.assign(cell=list(np.floor(p / eps).astype(np.int32)), first=p[:, 0])[["id", "copies", "raw", "cell", "first"]]

    def name_group(batches):
        g = TaskContext.get().partitionId()
        for b in batches:
            yield b[["id", "copies", "raw"]].assign(interval=np.int32(g))

    def box(b: pd.DataFrame) -> pd.DataFrame:
        p = _unit(_matrix(b["raw"], dim)) @ axes
        return pd.DataFrame({"interval": b["interval"].iloc[:1], "lo": [p.min(axis=0)], "hi": [p.max(axis=0)]})

    ordered = points.mapInPandas(place, "id bigint, copies bigint, raw binary, cell array<int>, first double").repartitionByRange(groups, "cell", "first", "id")
    held = cut(ordered.mapInPandas(name_group, "id bigint, copies bigint, raw binary, interval int"))
    boxes = cut(held.groupBy("interval").applyInPandas(box, "interval int, lo array<double>, hi array<double>"))
    # only intervals that come near each other on the first axis meet, by its cells
    cells = boxes.withColumn("c", F.explode(F.expr(f"sequence(CAST(floor(lo[0] / {eps}) AS INT) - 1, CAST(floor(hi[0] / {eps}) AS INT) + 1)")))
    a, b = cells.select(*(F.col(c).alias(f"a_{c}") for c in cells.columns)), cells.select(*(F.col(c).alias(f"b_{c}") for c in cells.columns))
    gap = F.expr("aggregate(zip_with(zip_with(a_lo, b_hi, (x, y) -> x - y), zip_with(b_lo, a_hi, (x, y) -> x - y), (x, y) -> pow(greatest(x, y, 0D), 2)), 0D, (s, x) -> s + x)")
    pairs = a.join(b, F.col("a_c") == F.col("b_c")).where("a_interval <= b_interval").where(gap <= eps * eps).select("a_interval", "b_interval").distinct()
    tiles = pairs.select(F.explode(F.expr("IF(a_interval = b_interval, array(a_interval), array(a_interval, b_interval))")).alias("interval"), F.concat_ws("-", "a_interval", "b_interval").alias("tile"))

    def solve(b: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(b["raw"], dim)
        norm = np.sqrt((x * x).sum(axis=1))
        p = (x / norm[:, None]) @ axes
        # grid order inside the task: by interval, then cells, then the first axis
        order = np.lexsort((p[:, 0], *(np.floor(p[:, k] / eps) for k in range(leading - 1, -1, -1)), b["interval"].to_numpy()))
        x, p, norm = x[order], p[order], norm[order]
        ids, copies, interval = (b[c].to_numpy()[order] for c in ("id", "copies", "interval"))
        u = (x / norm[:, None]).astype(np.float32)
        by_id = np.argsort(np.argsort(ids))
        links, forest, known = np.zeros(len(x), np.int64), Forest(len(x)), {}

        def bounds(s: slice):
            if (s.start, s.stop) not in known:
                known[s.start, s.stop] = p[s].min(axis=0), p[s].max(axis=0)
            return known[s.start, s.stop]

        def leaf(s: slice, t: slice):
            near = u[s] @ u[t].T >= cosine - 1e-4
            if s == t:
                near &= np.tri(len(near), k=-1, dtype=bool)
            if not near.any():
                return
            i, j = np.nonzero(near)
            for k in range(0, len(i), 1 << 16):
                y, z = x[s][i[k : k + (1 << 16)]], x[t][j[k : k + (1 << 16)]]
                exact = np.einsum("ij,ij->i", y, z) / (norm[s][i[k : k + (1 << 16)]] * norm[t][j[k : k + (1 << 16)]])
                good = exact >= cosine
                m, o = i[k : k + (1 << 16)][good] + s.start, j[k : k + (1 << 16)][good] + t.start
                np.add.at(links, m, copies[o])
                np.add.at(links, o, copies[m])
                forest.link(by_id[m], by_id[o])

        edge = int(np.searchsorted(interval, interval[-1]))
        if edge == 0:
            join_blocks(slice(0, len(x)), slice(0, len(x)), bounds, eps, leaf)
        else:
            join_blocks(slice(0, edge), slice(edge, len(x)), bounds, eps, leaf)
        some = links > 0
        roots = np.sort(ids)[forest.roots()]
        return pd.DataFrame({"id": ids[some], "links": links[some], "root": roots[by_id[some]]})

    return held.join(tiles, "interval").groupBy("tile").applyInPandas(solve, "id bigint, links bigint, root bigint")

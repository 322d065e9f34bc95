"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of code points; in each window of w consecutive
k-grams the smallest hash is selected, the rightmost of equals; selections are
kept with their positions. Two texts that share a run of w + k - 1 code points
share a selected hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import cut, long_text, longs, mix64, rolling, shuffle_partitions

K, WINDOW = 12, 16


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")


def select(points: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes uint32, positions int64) that winnowing selects. A text shorter
    than a k-gram is one k-gram; an empty one selects nothing; one with fewer
    k-grams than a window is one window."""
    if not len(points):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    h = rolling(mix64(points.astype(np.uint64)), min(k, len(points))) >> np.uint64(32)
    n = len(h)
    # position in the low half, counted from the end: of equal hashes the later is less
    low = (h << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    width = min(window, n)
    reach = 1
    while reach < width:  # minima of windows of doubling width
        step = min(reach, width - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    chosen = low[np.concatenate([[True], low[1:] != low[:-1]])]
    return (chosen >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sorted sets of hashes; two empty ones are alike."""
    both = len(a) + len(b)
    if not both:
        return 1.0
    m = np.concatenate([a, b])
    m.sort()
    shared = int((m[1:] == m[:-1]).sum())
    return shared / (both - shared)


def name(selected: tuple[np.ndarray, np.ndarray]) -> str:
    """A short name of a fingerprint: 128 bits over its hashes and positions."""
    return hashlib.blake2b(selected[0].astype("<u4").tobytes() + selected[1].astype("<i8").tobytes(), digest_size=16).hexdigest()


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hashes array<bigint>, positions array<bigint>) of every row; null
    and empty texts have none. Ids may repeat or be null."""

    @F.pandas_udf("hashes array<bigint>, positions array<bigint>")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [select(code_points(t), k, window) for t in texts]
        return pd.DataFrame({"hashes": [h.astype(np.int64) for h, _ in found], "positions": [p for _, p in found]})

    return docs.select(F.col(id_col).alias("id"), run(F.col(text_col)).alias("f")).select("id", "f.hashes", "f.positions")


class _Doc:
    def __init__(self, i, text, k, window):
        self.id, self.points = i, code_points(text)
        self.selected = select(self.points, k, window)
        self.set = np.unique(self.selected[0])
        self.name = name(self.selected)


def _compare(d: _Doc, after: _Doc, k: int, window: int) -> tuple:
    n = len(d.points)
    edited = np.concatenate([d.points[: n - n // 2], after.points[: n // 2]])
    selected = select(edited, k, window)
    raw = edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return (d.id, n, hashlib.sha256(raw).hexdigest(), d.name, name(selected), likeness(d.set, np.unique(selected[0])), likeness(d.set, after.set))


def compare_with_edited(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next.

    The edited text is the row's with its last floor(n / 2) code points replaced
    by as many first ones of the next row (all, if it has fewer), by descending
    id, the first row following the last. Rows of one id follow each other by a
    hash of their text, then by text. Null texts count as empty, null ids come last. A table of one row is
    followed by itself; an empty one gives no rows.

    Rows are range-partitioned once, by id and the hash, so that no text is among
    the keys that Spark samples to find the ranges. Each task walks its rows in order; only the
    first and last row of each task, whose neighbours are elsewhere, are joined
    in a second step, so nothing but two rows a task leaves its place.
    """
    names = ["pid", "edge", "text", "id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "pid int, edge int, text string, id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def walk(batches):
        pid, last, last_text = TaskContext.get().partitionId(), None, None
        for b in batches:
            rows = []
            for i, text in zip(b["id"], b["text"], strict=True):
                d = _Doc(i, text, k, window)
                rows.append((pid, 0, text, *[None] * 7) if last is None else (pid, None, None, *_compare(last, d, k, window)))
                last, last_text = d, text
            yield _frame(rows)
        if last is not None:
            yield _frame([(pid, 1, last_text, last.id, *[None] * 6)])

    def _frame(rows):
        out = pd.DataFrame(rows, columns=names, dtype=object)
        for c in ("edge", "id", "n_chars"):
            out[c] = longs(out[c])
        return out.astype({c: float for c in ("near_edited", "near_next")})

    def close(batches):
        for b in batches:
            rows = [_compare(_Doc(i, t, k, window), _Doc(None, u, k, window), k, window) for i, t, u in zip(b["id"], b["text"], b["next_text"], strict=True)]
            out = pd.DataFrame(rows, columns=names[3:], dtype=object)
            yield out.assign(id=longs(out["id"]), n_chars=longs(out["n_chars"])).astype({c: float for c in ("near_edited", "near_next")})

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("by", F.xxhash64("text"))
    order = [F.desc_nulls_last("id"), F.asc("by")]
    ranged = texts.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order, F.asc_nulls_first("text"))
    walked = cut(ranged.select(long_text("id").alias("id"), "text").mapInPandas(walk, schema))
    # the last row of a task goes before the first one of the next task that has rows
    heads = walked.where("edge = 0").select("pid", F.col("text").alias("next_text"))
    tails = walked.where("edge = 1").select("pid", "id", "text")
    ring = heads.agg(F.sort_array(F.collect_list("pid")).alias("pids"))  # one number a task
    following = ring.selectExpr("posexplode(pids) AS (k, pid)", "pids").selectExpr("pid", "pids[(k + 1) % size(pids)] AS next_pid")
    edges = tails.join(following, "pid").join(heads.withColumnRenamed("pid", "next_pid"), "next_pid").select(long_text("id").alias("id"), "text", "next_text")
    rest = edges.mapInPandas(close, schema.split(", ", 3)[3])
    return walked.where("edge IS NULL").select(*names[3:]).unionByName(rest)

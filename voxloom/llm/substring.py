"""Removal of repeated word passages by fixed-block anchors.

Every ``block``-th run of ``block`` words of a document, not overlapping the
next, is an anchor; a window of 2 * block - 1 words or more always holds a whole
one. All rolling runs of ``block`` words probe the anchors. Around each hit the
windows that hold it are compared, hash by hash, with those around the other
hits, which extends hits to maximal exact repeats without making pairs: a passage
that thousands of documents share costs each of them its own windows only.

Runs travel as packed hashes by document, without positions: a document's hits
come back as hashes, which it finds again in its own text. Anchors need 30 bits of
hash, as windows are compared anew, by 62. Each task sends a hash once, however
often it occurs there, so a very common run is as small as a rare one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import give_back_memory, groups_for, long_text, longs, mix64, rolling, trimmed

BATCH_WORDS = 1 << 22


def word_hashes(text: str | None) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in (text or "").encode("utf-8", "surrogatepass").split()], np.uint64)


def tags(h: np.ndarray, kind: str) -> np.ndarray:
    """The hash as it travels: its top 30 (``<u4``) or 62 (``<u8``) bits, with two
    low bits free for flags (1: marked, 2: seen twice)."""
    return (h >> np.uint64(32) if kind == "<u4" else h).astype(kind) & np.array(-4, "<i8").astype(kind)


def _by_doc(doc: np.ndarray, tag: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(documents, counts, tags), tags in order of document."""
    o = np.argsort(doc, kind="stable")
    ids, counts = np.unique(doc[o], return_counts=True)
    return zlib.compress(np.diff(ids, prepend=0).astype("<i8").tobytes(), 1), zlib.compress(counts.astype("<i4").tobytes(), 1), tag[o].tobytes()


def _opened(docs: bytes, counts: bytes, tag: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.cumsum(np.frombuffer(zlib.decompress(docs), "<i8"))
    return np.repeat(ids, np.frombuffer(zlib.decompress(counts), "<i4")), np.frombuffer(tag, kind)


_SENT = ["bucket", "docs", "counts", "tags"]
_SENT_SCHEMA = "bucket int, docs binary, counts binary, tags binary"


def _send(h: np.ndarray, doc: np.ndarray, marked: np.ndarray, buckets: int, kind: str) -> pd.DataFrame:
    """Packed occurrences by bucket, the first of each hash; then the hits that
    this task sees itself (bucket -1): every occurrence of a hash that occurs
    twice here and is marked."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    group = np.cumsum(new) - 1
    first, size = order[new], np.bincount(group)
    mark = np.bincount(group, weights=marked[order]) > 0
    tag = tags(h, kind)
    flags = mark.astype(kind) | ((size > 1).astype(kind) << np.array(1).astype(kind))
    where = (h[first] & np.uint64(0xFFFFFF)) % np.uint64(buckets)
    by = np.argsort(where, kind="stable")
    edges = np.searchsorted(where[by], np.arange(buckets + 1))
    rows = []
    for k in range(buckets):
        mine = by[edges[k] : edges[k + 1]]
        if len(mine):
            rows.append((k, *_by_doc(doc[first[mine]], tag[first[mine]] | flags[mine])))
    twice = np.zeros(len(h), bool)
    twice[order] = (size > 1)[group] & mark[group]
    if twice.any():
        rows.append((-1, *_by_doc(doc[twice], tag[twice])))
    return pd.DataFrame(rows, columns=_SENT)


def _hits_of(doc: np.ndarray, tag: np.ndarray, bins: int) -> pd.DataFrame:
    """Hits, packed by bins of documents: one row a bin."""
    where = (mix64(doc.astype(np.int64).view(np.uint64), 2) % np.uint64(bins)).astype(np.int64)
    o = np.argsort(where, kind="stable")
    doc, tag, where = doc[o], tag[o], where[o]
    edges = np.searchsorted(where, np.arange(bins + 1)).tolist()
    rows = [(k, *_by_doc(doc[a:b], tag[a:b])) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
    return pd.DataFrame(rows, columns=["bin", "docs", "counts", "tags"])


def _meet(b: pd.DataFrame, bins: int, kind: str) -> pd.DataFrame:
    """In one bucket: occurrences whose hash occurs twice or more, one of them marked."""
    opened = [_opened(r.docs, r.counts, r.tags, kind) for r in b.itertuples(index=False)]
    if int(b["bucket"].iloc[0]) < 0:
        return pd.concat([_hits_of(d, t, bins) for d, t in opened])
    doc, tag = (np.concatenate(x) for x in zip(*opened, strict=True))
    del opened
    order = np.argsort(tag, kind="stable")
    bare = tag[order] & np.array(-4, "<i8").astype(kind)
    new = np.concatenate([[True], bare[1:] != bare[:-1]])
    group = np.cumsum(new) - 1
    flags = tag[order].astype(np.int64) & 3
    many = (np.bincount(group) > 1) | (np.bincount(group, weights=flags >> 1) > 0)
    hit = (many & (np.bincount(group, weights=flags & 1) > 0))[group]
    return _hits_of(doc[order][hit], bare[hit], bins)


def _gather(b: pd.DataFrame, kind: str) -> pd.DataFrame:
    """One row for each document of a bin: all its hits."""
    doc, tag = (np.concatenate(x) for x in zip(*(_opened(r.docs, r.counts, r.tags, kind) for r in b.itertuples(index=False)), strict=True))
    o = np.argsort(doc, kind="stable")
    ids, starts = np.unique(doc[o], return_index=True)
    return pd.DataFrame({"id": ids, "hits": [np.unique(x).tobytes() for x in np.split(tag[o], starts[1:])]})


def repeats(texts: DataFrame, per_text, n: int, kind: str, batch: int = BATCH_WORDS) -> DataFrame:
    """(id, hits) of the marked hashes that occur twice or more; ``per_text``
    gives (h, marked) of a row. What a task has seen itself goes to groups of its
    own, spread by its documents. A task holds ``batch`` hashes at a time."""

    def send(batches):
        parts, size = [], 0
        for b in batches:
            for row in b.itertuples(index=False):
                h, marked = per_text(row)
                if len(h):
                    parts.append((h, np.full(len(h), row.id, np.int64), marked))
                    size += len(h)
                if size >= batch:
                    yield _send(*(np.concatenate(x) for x in zip(*parts, strict=True)), n, kind)
                    parts, size = [], 0
        if parts:
            yield _send(*(np.concatenate(x) for x in zip(*parts, strict=True)), n, kind)
        parts = []
        give_back_memory()

    meet, gather = trimmed(_meet), trimmed(_gather)
    sent = texts.mapInPandas(send, _SENT_SCHEMA)
    keyed = sent.withColumn("key", F.when(F.col("bucket") < 0, F.xxhash64("docs", "tags")).otherwise(F.col("bucket").cast("long")))
    met = keyed.repartition(n, "key").groupBy("key").applyInPandas(lambda b: meet(b, n, kind), "bin int, docs binary, counts binary, tags binary")
    return met.repartition(n, "bin").groupBy("bin").applyInPandas(lambda b: gather(b, kind), "id bigint, hits binary")


def windows_of(text: str | None, window: int) -> np.ndarray:
    return mix64(rolling(word_hashes(text), window), 7)


def repeated_windows(texts: DataFrame, n: int, window: int = 35) -> DataFrame:
    """(id, hits binary): for each row of ``texts`` (id bigint, unique; text) with
    any, the tags (``<u8``) of its windows of ``window`` words that also start
    elsewhere. Hashes are dealt to ``n`` groups."""
    block = (window + 1) // 2

    def probes(row):
        h = rolling(word_hashes(row.text), block)
        return h, np.arange(len(h)) % block == 0

    def around(row):
        """The windows that hold a hit."""
        words = word_hashes(row.text)
        count = max(0, len(words) - window + 1)
        hits = np.flatnonzero(np.isin(tags(rolling(words, block), "<u4"), np.frombuffer(row.hits, "<u4")))
        near = np.zeros(count + window + 1, np.int32)
        inside = hits[hits - (window - block) < count]
        np.add.at(near, np.maximum(inside - (window - block), 0), 1)
        np.add.at(near, np.minimum(inside + 1, count), -1)
        h = mix64(rolling(words, window), 7)[np.cumsum(near)[:count] > 0]
        return h, np.ones(len(h), bool)

    found = repeats(texts, probes, n, "<u4")
    # all columns, here as above and below, so that the exchange of the texts is one
    return repeats(texts.join(found, "id").select("id", "doc", "text", "hits"), around, n, "<u8")


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words bigint, n_removed bigint, kept string) of every row.

    A word goes if a window of ``window`` consecutive words of its document
    covers it whose word sequence also starts elsewhere, in the same or another
    document; all copies go. Words are runs without ASCII white space, unchanged.
    Null texts have no words; kept words are joined by one space. Rows may repeat
    an id or have none: rows that share an id only share a list of repeated
    windows, which hold for each; those without one go by a hash of their text.
    Windows count as equal if 62 bits of their hashes are; of 10^9 different
    windows, two meet by chance with odds of about one in nine.
    """
    texts = docs.select(long_text(id_col).alias("doc"), F.col(text_col).alias("text"))
    n = groups_for(texts)
    # one exchange of the texts serves the probes, the windows and the removal
    texts = texts.withColumn("id", F.coalesce(F.col("doc").cast("long"), -1 - F.pmod(F.xxhash64("text"), F.lit(1 << 16))))
    # never null; said, so that no join puts it below the exchange for itself alone
    texts = texts.where("id IS NOT NULL").repartition(n, "id")
    found = repeated_windows(texts, n, window)

    def keep(batches):
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                words = (row.text or "").encode("utf-8", "surrogatepass").split()
                n = len(words)
                if row.hits is not None:
                    starts = np.flatnonzero(np.isin(tags(windows_of(row.text, window), "<u8"), np.frombuffer(row.hits, "<u8")))
                    cover = np.zeros(n + 1, np.int32)
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, np.minimum(starts + window, n), -1)
                    stay = np.cumsum(cover)[:n] == 0
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                out.append((row.doc, n, n - len(words), b" ".join(words).decode("utf-8", "surrogatepass")))
            done = pd.DataFrame(out, columns=["id", "n_words", "n_removed", "kept"])
            yield done.assign(id=longs(done["id"]))

    return texts.join(found, "id", "left").select("id", "doc", "text", "hits").mapInPandas(keep, "id bigint, n_words bigint, n_removed bigint, kept string")

"""Benchmark decontamination by suffix arrays over the training texts.

Each task lays its documents end to end as word numbers, a shard, and sorts the
shard's suffixes by prefix doubling, as deep as the longest test item reaches.
Every suffix of every test item is then searched in the shard by bisection: its
longest verbatim match stands next to the place where the suffix would go, and
the range of the array that begins with a window gives all its locations. Words
that no test item has end every match, so they part the suffixes like the ends
of documents do.

Test items are a query set: they come in blocks of bounded size, each held by
every task, against all documents; a set of more than one block takes a pass each.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import cut, fresh, give_back_memory, long_text, longs

SHARD_WORDS = 1 << 20
BLOCK_CHARS = 2 << 20  # of test items, which a task holds at a time
PIECE_WORDS = 1 << 17  # of one test item
STRIDE = 16  # words compared at a time
_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: str | None):
    """The words of a text, some megabytes of it at a time: runs of digits, ASCII
    letters (lower-cased) and anything beyond ASCII."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_KEPT)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + (4 << 20))
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


class Queries:
    """The suffixes of a block of test items, and their windows.

    ``flat`` holds the word numbers (from 1) of the distinct items, a zero after
    each; ``starts`` and ``lengths`` are its suffixes. ``windows`` are distinct
    word sequences, as (start in ``flat``, length), and ``items`` the item ids of each.
    """

    def __init__(self, rows: list[tuple[str, str]], window: int):
        self.numbers: dict[bytes, int] = {}
        texts: dict[tuple, list[str]] = {}
        for item, text in rows:
            words = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for part in words_of(text) for w in part)
            if words:
                texts.setdefault(words, []).append(item)
        self.flat = np.concatenate([np.array([*words, 0], np.int32) for words in texts] or [np.zeros(1, np.int32)])
        starts, lengths, known, self.items, self.windows = [], [], {}, [], []
        self.owner = []
        at = 0
        for words, items in texts.items():
            n = len(words)
            starts.append(np.arange(at, at + n))
            lengths.append(n - np.arange(n))
            self.owner.append((at, n, items))
            size = min(window, n)
            for i in range(n - size + 1):
                key = words[i : i + size]
                if key not in known:
                    known[key] = len(known)
                    self.windows.append((at + i, size))
                    self.items.append([])
                self.items[known[key]].extend(items)
            at += n + 1
        self.items = [sorted(set(x)) for x in self.items]
        self.starts = np.concatenate([*starts, np.empty(0, np.int64)]).astype(np.int64)
        self.lengths = np.concatenate([*lengths, np.empty(0, np.int64)]).astype(np.int64)
        self.depth = int(self.lengths.max(initial=0))
        places = np.array(self.windows, np.int64).reshape(-1, 2)
        self.window_starts, self.window_lengths = places[:, 0], places[:, 1]
        # the windows whose first words a longest match has decide which are there
        self.by_start = np.searchsorted(self.starts, self.window_starts)


def suffix_array(text: np.ndarray, depth: int, top: int) -> np.ndarray:
    """The places of ``text`` with a word (not zero), by the ``depth`` words, or
    some more, that follow from there. ``top`` is the largest number of a word."""
    bits = max(1, int(top).bit_length())
    h = max(1, min(62 // bits, depth))
    n = len(text)
    padded = np.concatenate([text, np.zeros(h, text.dtype)]).astype(np.int64)
    places = np.flatnonzero(text)
    key = np.zeros(len(places), np.int64)
    for t in range(h):
        key = (key << bits) | padded[places + t]
    order = np.argsort(key, kind="stable")
    array, key = places[order], key[order]
    rank = np.zeros(n + 1, np.int64)  # of words from 1; zero at the ends
    tied = np.arange(len(array))
    group = np.zeros(len(array), np.int64)
    while len(tied):
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        rank[array[tied]] = group + 1
        if h >= depth:
            break
        many = ~(new & np.concatenate([new[1:], [True]]))
        tied, group = tied[many], group[many]
        some = array[tied]
        key = (group << np.int64(32)) | rank[np.minimum(some + h, n)]
        order = np.argsort(key, kind="stable")
        array[tied], key = some[order], key[order]
        h *= 2
    return array


class Shard:
    """Texts laid end to end, with their suffix array."""

    def __init__(self, text: np.ndarray, queries: Queries):
        self.queries, self.text = queries, text
        self.array = suffix_array(text, queries.depth, len(queries.numbers))
        self.first = text[self.array]
        self.padded = np.concatenate([text, np.zeros(STRIDE + 1, text.dtype)])
        self.asked = np.concatenate([queries.flat, np.zeros(STRIDE + 1, queries.flat.dtype)])

    def compare(self, at: np.ndarray, q: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words from ``at`` on equal those of the query at ``q``, and the
        sign of the text against the query's ``lengths`` words."""
        same, sign = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        active, t, step = np.arange(len(at)), 0, np.arange(STRIDE)
        while len(active):
            x = self.padded[np.minimum(at[active] + t, len(self.text))[:, None] + step]
            y = self.asked[np.minimum(q[active] + t, len(self.queries.flat))[:, None] + step]
            stop = (x != y) | (t + step >= lengths[active][:, None])
            ends, first = stop.any(1), stop.argmax(1)
            same[active] += np.where(ends, first, STRIDE)
            done = np.flatnonzero(ends)
            full = same[active[done]] >= lengths[active[done]]
            sign[active[done]] = np.where(full, 0, np.sign(x[done, first[done]] - y[done, first[done]]))
            active, t = active[~ends], t + STRIDE
        return same, sign

    def bound(self, q: np.ndarray, lengths: np.ndarray, above: bool = False) -> np.ndarray:
        """Where each query goes in the array, by bisection: before the suffixes that
        begin with it, or behind them."""
        word = self.asked[q]
        low, high = np.searchsorted(self.first, word, "left"), np.searchsorted(self.first, word, "right")
        while True:
            active = np.flatnonzero(low < high)
            if not len(active):
                return low
            middle = (low[active] + high[active]) // 2
            _, sign = self.compare(self.array[middle], q[active], lengths[active])
            right = sign <= 0 if above else sign < 0
            low[active] = np.where(right, middle + 1, low[active])
            high[active] = np.where(right, high[active], middle)

    def longest(self) -> np.ndarray:
        """For each query suffix the length of its longest verbatim match here."""
        q, lengths = self.queries.starts, self.queries.lengths
        best = np.zeros(len(q), np.int64)
        if len(self.array) and len(q):
            place = self.bound(q, lengths)
            for k in (place - 1, place):
                best = np.maximum(best, np.where((k >= 0) & (k < len(self.array)), self.compare(self.array[np.clip(k, 0, len(self.array) - 1)], q, lengths)[0], 0))
        return best

    def locations(self, q: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into q, place in the text) of every occurrence."""
        low, high = self.bound(q, lengths), self.bound(q, lengths, above=True)
        count = high - low
        which = np.repeat(np.arange(len(q)), count)
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return which, self.array[low[which] + offset]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of every occurrence of a window."""
        if not len(self.queries.windows):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        there = np.flatnonzero(self.longest()[self.queries.by_start] >= self.queries.window_lengths)
        which, at = self.locations(self.queries.window_starts[there], self.queries.window_lengths[there])
        return there[which], at


def _blocks(items: DataFrame, item_col: str, text_col: str, window: int):
    """Lists of (item id, words) of bounded size, which together hold all items; an
    item of very many words comes in pieces that share ``window`` - 1 of them."""

    def pieces(batches):
        for b in batches:
            rows = []
            for item, text in zip(b["item"], b["text"], strict=True):
                words = [w for part in words_of(text) for w in part]
                step = max(1, PIECE_WORDS - window + 1)
                rows += [("" if item is None else item, b" ".join(words[k : k + PIECE_WORDS]).decode("utf-8", "surrogatepass")) for k in range(0, max(1, len(words) - window + 1), step)]
            yield pd.DataFrame(rows, columns=["item", "words"])

    cutted = cut(items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInPandas(pieces, "item string, words string").where("words <> ''").distinct())
    chars = cutted.agg(F.sum(F.length("words"))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS) or 1
    for k in range(n):
        yield n, [(r["item"], r["words"]) for r in cutted.where(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == k).toLocalIterator()]


def _shards(batches, queries: Queries):
    """(ids of documents, their word counts, text) of the shards of a task. A very
    long document is a shard of its own."""
    ids, parts, size = [], [], 0
    for b in batches:
        for i, text in zip(b["id"], b["text"], strict=True):
            part = np.concatenate([*(np.fromiter(map(queries.numbers.get, w, repeat(0)), np.int32, len(w)) for w in words_of(text)), np.empty(0, np.int32)])
            if ids and size + len(part) > 2 * SHARD_WORDS:
                yield ids, parts
                ids, parts, size = [], [], 0
            parts.append(part)
            ids.append(i)
            size += len(part)
            if size >= SHARD_WORDS:
                yield ids, parts
                ids, parts, size = [], [], 0
    if ids:
        yield ids, parts


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The shard's text, a zero after each document, and where documents start."""
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    text = np.zeros(int(sizes.sum()), np.int32)
    starts = np.cumsum(sizes) - sizes
    for s, p in zip(starts.tolist(), parts, strict=True):
        text[s : s + len(p)] = p
    return text, starts


def _slices(parts: list[np.ndarray], overlap: int):
    """(index of the first document, word offset in it, documents) so that no slice
    has many more words than a shard; a document's slices share ``overlap`` words."""
    if len(parts) == 1 and len(parts[0]) > 2 * SHARD_WORDS:
        step = SHARD_WORDS
        for k in range(0, len(parts[0]), step):
            yield k, [parts[0][k : k + step + overlap]]
    else:
        yield 0, parts


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words bigint, n_hit bigint, spans array<struct<start, end>>, items
    array<string>) of every row of ``docs``.

    A window is ``window`` consecutive words of an item, or all words of a shorter
    one; spans are the words of a document that any occurrence of a window covers
    (end exclusive, apart from each other), ``items`` the ids, sorted as strings, of
    the items that have a window there. Null and empty texts have no words, and an
    item without words no window. Rows are judged each by its own text, whether ids
    are null or repeat; rows of one item id are one item, those without an id
    together one of the name ''. No rows give none; without items nothing is hit.
    """
    spark = docs.sparkSession
    schema = "row bigint, id bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"
    texts = docs.select(long_text(id_col).alias("id"), F.col(text_col).alias("text"))
    passes, n = [], 1
    for n, block in _blocks(items, item_col, item_text_col, window):
        if not passes and n > 1:
            texts = cut(texts.withColumn("row", F.monotonically_increasing_id()))
        queries = spark.sparkContext.broadcast(Queries(block, window))  # of BLOCK_CHARS, or little more

        def search(batches, queries=queries):
            q = queries.value

            def rows_of(b):
                return b if "row" in b.columns else b.assign(row=0)

            keys = []

            def kept(batches):
                for b in batches:
                    keys.extend(rows_of(b)["row"].tolist())
                    yield b

            for ids, parts in _shards(kept(batches), q):
                covered = [np.zeros(len(p) + 1, np.int64) for p in parts] if len(parts) == 1 else None
                found: list[set] = [set() for _ in ids]
                spans: list[list] = [[] for _ in ids]
                for offset, some in _slices(parts, max(window, 1) - 1):
                    text, starts = _joined(some)
                    which, at = Shard(text, q).windows()
                    cover = np.zeros(len(text) + 1, np.int64)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + q.window_lengths[which], -1)
                    inside = np.cumsum(cover)[:-1] > 0
                    if covered is not None:
                        part = inside[: len(some[0])]
                        covered[0][offset : offset + len(part)] |= part
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
                    doc = np.searchsorted(starts, edge[::2], "right") - 1
                    if covered is None:
                        for d, a, z in zip(doc.tolist(), (edge[::2] - starts[doc]).tolist(), (edge[1::2] - starts[doc]).tolist(), strict=True):
                            spans[d].append({"start": a, "end": z})
                    pair = np.unique((np.searchsorted(starts, at, "right") - 1) * len(q.windows) + which)
                    for d, w in zip((pair // max(1, len(q.windows))).tolist(), (pair % max(1, len(q.windows))).tolist(), strict=True):
                        found[d].update(q.items[w])
                if covered is not None:
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered[0], [0]])))
                    spans[0] = [{"start": a, "end": z} for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
                yield pd.DataFrame(
                    {"row": keys[: len(ids)], "id": longs(ids), "n_words": [len(p) for p in parts], "spans": spans, "items": [sorted(x) for x in found]}
                )
                del keys[: len(ids)]
            give_back_memory()

        passes.append(texts.mapInPandas(search, schema))
    out = passes[0]
    if n > 1:
        for more in passes[1:]:
            out = out.unionByName(more.where("size(spans) > 0"))
        # spans of several blocks may overlap: those that meet become one
        merge = """aggregate(array_sort(flatten(collect_list(spans))), cast(array() AS array<struct<start:bigint,end:bigint>>),
 (done, s) -> if(size(done) > 0 AND element_at(done, -1).end >= s.start,
  concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, s.end)))), concat(done, array(s))))"""
        out = out.groupBy("row").agg(F.first("id").alias("id"), F.max("n_words").alias("n_words"), F.expr(merge).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return out.select("id", "n_words", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)").alias("n_hit"), "spans", "items")


def longest_matches(docs: DataFrame, items: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item string, item_start bigint, n_words bigint, n_places bigint, id bigint,
    start bigint): of every word of an item the longest verbatim match that begins
    there, over all documents, if it has ``least`` words or more; how often it
    occurs, and the first place by document id (null ids last) and word.
    A match ends with its document; items of over PIECE_WORDS words come in pieces."""
    spark = docs.sparkSession
    texts = docs.select(long_text(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = "item string, item_start bigint, n_words bigint, n_places bigint, id bigint, start bigint"
    passes = []
    for _, block in _blocks(items, item_col, item_text_col, least):
        queries = spark.sparkContext.broadcast(Queries(block, least))

        def search(batches, queries=queries):
            q = queries.value
            begins = np.array([o[0] for o in q.owner])
            for ids, parts in _shards(batches, q):
                rows = []
                for offset, some in _slices(parts, q.depth - 1):
                    text, starts = _joined(some)
                    shard = Shard(text, q)
                    best = shard.longest()
                    long = np.flatnonzero(best >= least)
                    which, at = shard.locations(q.starts[long], best[long])
                    doc = np.searchsorted(starts, at, "right") - 1
                    own = at - starts[doc] + offset
                    number = np.array([np.iinfo(np.int64).max if ids[d] is None else int(ids[d]) for d in doc.tolist()], np.int64)
                    order = np.lexsort((own, number, which))
                    first = np.flatnonzero(np.diff(which[order], prepend=-1))
                    count = np.bincount(which, minlength=len(long))
                    for k, f in zip(which[order][first].tolist(), order[first].tolist(), strict=True):
                        s = int(q.starts[long[k]])
                        begin, _, names = q.owner[int(np.searchsorted(begins, s, "right")) - 1]
                        rows += [(name, s - begin, int(best[long[k]]), int(count[k]), ids[int(doc[f])], int(own[f])) for name in names]
                out = pd.DataFrame(rows, columns=["item", "item_start", "n_words", "n_places", "id", "start"])
                yield out.assign(id=longs(out["id"]))
            give_back_memory()

        passes.append(texts.mapInPandas(search, schema))
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "start")
    grouped = out.groupBy("item", "item_start", "n_words").agg(F.sum("n_places").alias("n_places"), F.min(place).alias("place"))
    best = grouped.groupBy("item", "item_start").agg(F.max(F.struct("n_words", "n_places", "place")).alias("m"))
    return best.select("item", "item_start", "m.n_words", "m.n_places", F.col("m.place.id").alias("id"), F.col("m.place.start").alias("start"))


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, that no window of an item occurs in.
    A text decides for all its copies; rows without a text stay."""
    key, gone = fresh(docs, "key"), fresh(docs, "gone")
    # two hashes of 64 bits name a text
    name = F.concat_ws(":", F.xxhash64(text_col), F.xxhash64(F.col(text_col), F.lit(1)))
    own = docs.withColumn(key, name)
    numbered = own.select(F.monotonically_increasing_id().alias("n"), F.col(key).alias("k"), F.col(text_col).alias("text"))
    numbered = cut(numbered)
    hit = contamination(numbered, items, window, "n", "text", item_col, item_text_col).where("n_hit > 0").select(F.col("id").alias("n"))
    names = cut(numbered.join(hit, "n", "left_semi").select(F.col("k").alias(gone)).distinct())
    return own.join(names, F.col(key) == F.col(gone), "left_anti").drop(key)

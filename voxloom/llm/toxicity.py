"""Toxicity by class-conditional Kneser-Ney models.

Two models over words, one of toxic and one of ordinary labelled texts: the
absolutely discounted words of a class back off to a continuation distribution
(after how many different words a word has been seen) that both classes share, so
that an expression too rare to tell the classes apart has the same probability in
both, but for the weight of the backoff. A text's log-likelihoods under the two
are compared, normalised by length: over all its distinct words, and over its
most toxic ones. Class-conditional bigrams as a third order were tried and
dropped (figures in the README).

Counts are Spark tables keyed by word, and grow with the input. Pairs of a word and
the one before it are counted exactly, in groups by a hash of both, so that a
frequent word's are not in one. Words travel as
48-bit hashes, by chunks of documents that list each distinct word once: a chunk's
words meet the table in hash buckets, and their counts go back to the chunk.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import cut, cut_by, give_back_memory, groups_for, hash_filter, long_text, longs, mix64, pack_planes, trimmed, unpack_planes

DISCOUNTS = (1.0, 2.0, 3.0, 5.0)  # the one that explains labelled texts best is taken
CALIBRATION_ROWS = 8_000  # at most so many labelled rows fit the weights of the logistic curve
REJECT = 0.3  # texts of this score or more count as toxic
CHUNK_CHARS = 4 << 20
WORD_BITS, FILTER_BITS = 48, 25
TOP = (3, 10)  # numbers of most toxic words that are looked at alone
FEATURES = 2 + len(TOP)


class Lexicon:
    """Numbers for the tokens of a chunk, and the hashes of their words: lower-case,
    without punctuation at their ends; zero where nothing is left."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def numbers(self, text: str | None) -> np.ndarray:
        parts, known = (text or "").lower().split(), self.known
        return np.fromiter((known.setdefault(w, len(known)) for w in parts), np.int64, len(parts))

    def hashes(self) -> np.ndarray:
        digest, out = xxhash.xxh64_intdigest, np.zeros(len(self.known), np.uint64)
        for k, w in enumerate(self.known):
            w = w.strip(".,;:!?\"'()[]*#%&$|-")
            if w:
                out[k] = max(1, digest(w.encode("utf-8", "surrogatepass")) >> (64 - WORD_BITS))
        return out


@dataclass
class _Chunk:
    """The words of some documents: ``words`` sorted, (doc, word) of each
    distinct word of each document in order, and all tokens one after another."""

    words: np.ndarray
    doc: np.ndarray
    word: np.ndarray
    sizes: np.ndarray
    token_doc: np.ndarray
    token_word: np.ndarray


def _chunk(lexicon: Lexicon, numbers: list[np.ndarray]) -> _Chunk:
    h = lexicon.hashes()
    flat = h[np.concatenate([*numbers, np.empty(0, np.int64)])]
    doc = np.repeat(np.arange(len(numbers)), [len(x) for x in numbers])[flat > 0]
    words, word = np.unique(flat[flat > 0], return_inverse=True)
    seen = np.unique(doc * max(len(words), 1) + word)
    d, w = np.divmod(seen, max(len(words), 1))
    return _Chunk(words, d, w, np.bincount(d, minlength=len(numbers)), doc, word)


def _bucket_edges(words: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets begin among sorted words: ranges of hashes."""
    return np.searchsorted(words, np.array([(k << WORD_BITS) // buckets for k in range(buckets + 1)], np.uint64))


SENT = ["bucket", "words", "n0", "n1", "sizes", "before"]
def _steps(words: np.ndarray) -> bytes:
    return pack_planes(np.diff(words, prepend=np.uint64(0)), "<u8")


def _united(packed) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of all of ``packed``, sorted, and where among them each is."""
    return np.unique(np.concatenate([np.cumsum(unpack_planes(x, "<u8")) for x in packed]), return_inverse=True)


COUNTED = "bucket int, words binary, n0 binary, n1 binary, sizes binary, before binary"
SUMMED = "bucket int, words binary, n0 binary, n1 binary, contexts binary"
MODEL = "bucket int, words binary, n0 binary, n1 binary, contexts binary, types bigint, stats array<double>"


def count(labelled: DataFrame, buckets: int) -> DataFrame:
    """The model's table, one row a bucket, over all rows of ``labelled`` (text,
    label 0 or 1): the words that two texts of a class or more have, with the
    number of such texts by class (lines repeated in a text weigh no more) and of
    different words before them. ``stats`` sums up all words, rarer ones too.

    A first exchange sums texts by word and makes pairs of words distinct; a second
    one sums up each word's pairs."""

    def partial(batches):
        lexicon, numbers, labels, size = Lexicon(), [], [], 0

        def flush():
            c, label = _chunk(lexicon, numbers), np.array(labels)
            n = [np.bincount(c.word[label[c.doc] == k], minlength=len(c.words)) for k in (0, 1)]
            edges = _bucket_edges(c.words, buckets).tolist()
            rows = [(k, _steps(c.words[a:b]), pack_planes(n[0][a:b]), pack_planes(n[1][a:b]), None, None) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
            before = np.concatenate([[np.uint64(0)], c.words[c.token_word[:-1]]])[: len(c.token_word)]
            before[np.concatenate([[True], c.token_doc[1:] != c.token_doc[:-1]])[: len(before)]] = 0
            pairs, at = np.unique(mix64(mix64(before, 5) ^ c.words[c.token_word], 6), return_index=True)
            owner, tag, where = c.token_word[at], (pairs >> np.uint64(32)).astype(np.uint32), (pairs & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
            order = np.lexsort((tag, owner, where))
            owner, tag, edges = owner[order], tag[order], np.searchsorted(where[order], np.arange(buckets + 1)).tolist()
            for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if b > a:
                    mine, sizes = np.unique(owner[a:b], return_counts=True)
                    rows.append((k, _steps(c.words[mine]), None, None, pack_planes(sizes), pack_planes(tag[a:b])))
            return pd.DataFrame(rows, columns=SENT)

        for b in batches:
            for text, label in zip(b["text"], b["label"], strict=True):
                numbers.append(lexicon.numbers(text))
                labels.append(label)
                size += len(text or "")
                if size >= CHUNK_CHARS:
                    yield flush()
                    lexicon, numbers, labels, size = Lexicon(), [], [], 0
        if numbers:
            yield flush()
        lexicon, numbers, labels = None, [], []
        give_back_memory()

    def _sum(b: pd.DataFrame) -> pd.DataFrame:
        texts, pairs = b[b["before"].isna()], b[b["before"].notna()]
        rows = []
        if len(texts):
            words, at = _united(texts["words"])
            n = [np.bincount(at, np.concatenate([unpack_planes(x) for x in texts[c]]), len(words)) for c in ("n0", "n1")]
            rows.append((int(b["bucket"].iloc[0]), _steps(words), *(pack_planes(x, "<u8") for x in n), None))
        if len(pairs):
            words, at = _united(pairs["words"])
            owner = np.repeat(at, np.concatenate([unpack_planes(x) for x in pairs["sizes"]]).astype(np.int64)).astype(np.uint64)
            distinct = np.unique((owner << np.uint64(32)) | np.concatenate([unpack_planes(x) for x in pairs["before"]]))
            contexts = np.bincount((distinct >> np.uint64(32)).astype(np.int64), minlength=len(words))
            edges = _bucket_edges(words, buckets).tolist()
            rows += [(k, _steps(words[a:b]), None, None, pack_planes(contexts[a:b], "<u8")) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
        return pd.DataFrame(rows, columns=["bucket", "words", "n0", "n1", "contexts"])

    def _merge(b: pd.DataFrame) -> pd.DataFrame:
        words, at = _united(b["words"])
        # each row has either the texts or the contexts of its words
        empty = [np.zeros(len(unpack_planes(x, "<u8")), np.uint64) for x in b["words"]]
        filled = lambda c: np.concatenate([e if x is None else unpack_planes(x, "<u8") for x, e in zip(b[c], empty, strict=True)])
        *n, contexts = (np.bincount(at, filled(c), len(words)) for c in ("n0", "n1", "contexts"))
        active = (n[0] > DISCOUNTS[0]) | (n[1] > DISCOUNTS[0])
        stats = [contexts.sum(), *(x.sum() for x in n), *(np.minimum(x, d).sum() for d in DISCOUNTS for x in n)]
        kept = (_steps(words[active]), *(pack_planes(x[active], "<u8") for x in (*n, contexts)))
        return pd.DataFrame([(int(b["bucket"].iloc[0]), *kept, len(words), stats)], columns=["bucket", "words", "n0", "n1", "contexts", "types", "stats"])

    summed, merge = trimmed(_sum), trimmed(_merge)
    sums = labelled.mapInPandas(partial, COUNTED).repartition(buckets, "bucket").groupBy("bucket").applyInPandas(lambda b: summed(b), SUMMED)
    return cut(sums.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(lambda b: merge(b), MODEL))


class Model:
    """The table of counts, their sums, the bitmap of its words and the curve.

    Of a word that few texts have, only the backoff is left under any discount, so
    that its ratio is the same for all; such words are counted but not kept."""

    def __init__(self, table: DataFrame, buckets: int):
        self.table, self.buckets = table, buckets
        size = 3 + 2 * len(DISCOUNTS)
        sums = table.select(*(F.sum(F.col("stats")[k]) for k in range(size))).first()
        self.contexts, *totals = (float(x or 0) for x in sums)
        self.total = np.maximum(totals[:2], 1.0)
        # what the discounts take from the counts is what backs off
        self.back = np.maximum(np.array(totals[2:]).reshape(-1, 2) / self.total, 1e-6)
        self.filter = table.sparkSession.sparkContext.broadcast(self._bitmap())
        self.discount, self.weights = 0, np.zeros(FEATURES + 1)

    def _bitmap(self) -> np.ndarray:
        """2^25 bits (4 MB, whatever the table's size), those of its words' first
        bits set: words that the table lacks mostly need not be sent to it."""
        shift = np.uint64(WORD_BITS - FILTER_BITS)

        def flags(batches):
            for b in batches:
                for row in b.itertuples(index=False):
                    at = (np.cumsum(unpack_planes(row.words, "<u8")) >> shift).astype(np.int64)
                    if len(at):
                        first = int(at[0]) & ~7
                        bits = np.zeros((int(at[-1]) - first) // 8 * 8 + 8, np.uint8)
                        bits[at - first] = 1
                        yield pd.DataFrame({"at": [first // 8], "bits": [np.packbits(bits).tobytes()]})

        out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for row in self.table.select("words").mapInPandas(flags, "at bigint, bits binary").toLocalIterator():
            some = np.frombuffer(row["bits"], np.uint8)
            out[row["at"] : row["at"] + len(some)] |= some
        return out


def features(n: np.ndarray, contexts: np.ndarray, doc: np.ndarray, sizes: np.ndarray, total: np.ndarray, back: np.ndarray, all_contexts: float, discount: float, own: int | None = None) -> np.ndarray:
    """(documents, FEATURES) length-normalised log-likelihood ratios, toxic over
    ordinary: per distinct word, per root of their number, and per word of the
    3 and 10 most toxic ones. ``n`` (2, entries) are counts by class of the words
    of documents ``doc`` (sorted) that the table has, ``sizes`` how many distinct
    words each document has. ``own`` is the class of documents that have been
    counted themselves: their counts are taken out."""
    logs = []
    for c in (0, 1):
        have, of = n[c].astype(float), np.full(len(sizes), total[c])
        if own == c:
            have, of = have - 1, np.maximum(of - sizes, 1.0)
        logs.append(np.log(np.maximum(have - discount, 0) / of[doc] + back[c] * contexts / all_contexts))
    ratio, rest = logs[1] - logs[0], float(np.log(back[1] / back[0]))
    known = np.bincount(doc, minlength=len(sizes))
    total_ratio = np.bincount(doc, ratio, len(sizes)) + (sizes - known) * rest
    order = np.lexsort((-ratio, doc))
    most = max(TOP)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(known) - known, known)
    top = np.full((len(sizes), 2 * most), -np.inf)
    few = place < most
    top[doc[few], place[few]] = ratio[order][few]
    top[:, most:][np.arange(most) < (sizes - known)[:, None]] = rest
    top = -np.sort(-top, axis=1)
    out = [total_ratio / np.maximum(sizes, 1), total_ratio / np.sqrt(np.maximum(sizes, 1))]
    for k in TOP:
        taken = np.minimum(sizes, k)
        out.append(np.where(np.arange(k) < taken[:, None], top[:, :k], 0.0).sum(axis=1) / np.maximum(taken, 1))
    return np.column_stack(out)


def _read(docs: DataFrame, model: Model, finish, schema: str) -> DataFrame:
    """``finish(ids, n, contexts, doc, sizes)`` of the documents of each chunk, its
    words' counts having been looked up. ``docs`` is (id string, text)."""
    buckets = max(model.buckets, 1)
    bitmap, shift = model.filter, np.uint64(WORD_BITS - FILTER_BITS)

    def chunks(batches):
        lexicon, numbers, ids, size = Lexicon(), [], [], 0

        def flush():
            c, name = _chunk(lexicon, numbers), uuid.uuid4().hex
            bit = (c.words >> shift).astype(np.int64)
            maybe = (bitmap.value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1
            words = c.words[maybe]
            keep = maybe[c.word]
            # frequent words first, so that most numbers of words are small
            renumbered = (np.cumsum(maybe) - 1)[c.word[keep]]
            order = np.argsort(-np.bincount(renumbered, minlength=len(words)), kind="stable")
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            doc, number = c.doc[keep], place[renumbered]
            number = number[np.lexsort((number, doc))]
            edges = _bucket_edges(words, buckets).tolist()
            rows = [(k, name, None, pack_planes(place[a:b]), None, pack_planes(np.diff(words[a:b], prepend=np.uint64(0)), "<u8")) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
            counts = np.bincount(doc, minlength=len(ids))
            ends = np.concatenate([[0], np.cumsum(counts)])
            step = max(1, len(ids) * (4 << 20) // max(1, size))  # documents in blocks, so that no row is large
            for at in range(0, len(ids), step):
                to = min(at + step, len(ids))
                flat = number[ends[at] : ends[to]]
                first = ends[at:to][counts[at:to] > 0] - ends[at]
                steps = np.diff(flat, prepend=0)
                steps[first] = flat[first]
                rows.append((-1, name, ids[at:to], pack_planes(c.sizes[at:to]), pack_planes(counts[at:to]), pack_planes(steps)))
            return pd.DataFrame(rows, columns=["bucket", "chunk", "ids", "a", "b", "c"])

        for b in batches:
            for i, text in zip(b["id"], b["text"], strict=True):
                ids.append(i)
                numbers.append(lexicon.numbers(text))
                size += len(text or "")
                if size >= CHUNK_CHARS:
                    yield flush()
                    lexicon, numbers, ids, size = Lexicon(), [], [], 0
        if ids:
            yield flush()
        lexicon, numbers, ids = None, [], []
        give_back_memory()

    def _look_up(asked: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(table):
            row = table.iloc[0]
            words = np.cumsum(unpack_planes(row["words"], "<u8"))
            n0, n1, contexts = unpack_planes(row["n0"], "<u8"), unpack_planes(row["n1"], "<u8"), unpack_planes(row["contexts"], "<u8")
            for q in asked.itertuples(index=False) if len(words) else ():
                mine = np.cumsum(unpack_planes(q.c, "<u8"))
                at = np.minimum(np.searchsorted(words, mine), len(words) - 1)
                have = words[at] == mine
                at = at[have]
                out.append((q.chunk, pack_planes(unpack_planes(q.a)[have]), pack_planes(n0[at], "<u8"), pack_planes(n1[at], "<u8"), pack_planes(contexts[at], "<u8")))
        return pd.DataFrame(out, columns=["chunk", "places", "n0", "n1", "contexts"])

    def _gather(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        places = [unpack_planes(x).astype(np.int64) for x in found["places"]]
        blocks = [(unpack_planes(r.a).astype(np.int64), unpack_planes(r.b).astype(np.int64), unpack_planes(r.c).astype(np.int64), list(r.ids)) for r in own.itertuples(index=False)]
        top = 1 + max((int(p.max()) for p in places if len(p)), default=-1)
        n, contexts, there = np.zeros((2, top)), np.zeros(top), np.zeros(top, bool)
        for p, row in zip(places, found.itertuples(index=False), strict=True):
            n[0, p], n[1, p], contexts[p], there[p] = unpack_planes(row.n0, "<u8"), unpack_planes(row.n1, "<u8"), unpack_planes(row.contexts, "<u8"), True
        out = []
        for sizes, counts, steps, ids in blocks:
            doc = np.repeat(np.arange(len(ids)), counts)
            run = np.cumsum(steps)
            base = np.concatenate([[0], run])[np.cumsum(counts) - counts]
            number = run - np.repeat(base, counts)
            known = number < top
            known[known] = there[number[known]]
            doc, number = doc[known], number[known]
            out.append(finish(ids, n[:, number], contexts[number], doc, sizes))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({x.strip().split(" ")[0]: [] for x in schema.split(",")})

    look_up, gather = trimmed(_look_up), trimmed(_gather)
    blobs = cut_by(docs.mapInPandas(chunks, "bucket int, chunk string, ids array<string>, a binary, b binary, c binary"), "chunk", buckets)
    asked = blobs.where("bucket >= 0").select("bucket", "chunk", "a", "c").repartition(buckets, "bucket")
    found = asked.groupBy("bucket").cogroup(model.table.select("bucket", "words", "n0", "n1", "contexts").repartition(buckets, "bucket").groupBy("bucket")).applyInPandas(lambda a, b: look_up(a, b), "chunk string, places binary, n0 binary, n1 binary, contexts binary")
    own = blobs.where("bucket < 0").select("chunk", "ids", "a", "b", "c")
    return own.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInPandas(lambda a, b: gather(a, b), schema)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights and offset of a logistic curve, by Newton's method."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    a = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * np.append(w[:-1], 0)
        hess = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of all rows of ``docs`` that ``labels`` marks 0 or 1. An id that
    is labelled twice is toxic if one of its labels says so; rows that repeat an id
    all have its label; rows without an id have none.

    The curve's weights, and the choice among DISCOUNTS, are fitted on about
    CALIBRATION_ROWS rows, twice as many at most, drawn by a hash of the id; each is
    scored as if it had not been counted. With no labelled row of one class the
    curve is flat at the share of toxic rows.
    """
    marked = cut(labels.select(F.col(id_col).cast("long").alias("key"), F.col(label).cast("int").alias("label")).where("key IS NOT NULL AND label IN (0, 1)").groupBy("key").agg(F.max("label").alias("label")))
    texts = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text")).where("key IS NOT NULL")
    # texts are shuffled to their labels, alike at every size, but only those that may have one
    maybe = hash_filter(marked, "key")
    rows = texts.where(maybe(F.col("key"))).join(marked.hint("merge"), "key")
    buckets = groups_for(texts)
    model = Model(count(rows.select("text", "label"), buckets), buckets)

    few = F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1_000_000)) < int(min(1.0, CALIBRATION_ROWS / max(marked.count(), 1)) * 1_000_000)
    drawn = texts.where(few).select(F.col("key").cast("string").alias("id"), "text")
    total, back, all_contexts = model.total, model.back, max(model.contexts, 1.0)

    def finish(ids, n, contexts, doc, sizes):
        x = [np.column_stack([features(n, contexts, doc, sizes, total, b, all_contexts, d, own) for d, b in zip(DISCOUNTS, back, strict=True)]) for own in (0, 1)]
        return pd.DataFrame({"key": longs(ids), "x0": list(x[0]), "x1": list(x[1])})

    got = _read(drawn, model, finish, "key bigint, x0 array<double>, x1 array<double>").join(marked, "key").select("label", F.when(F.col("label") == 1, F.col("x1")).otherwise(F.col("x0")).alias("x"))
    got = got.limit(2 * CALIBRATION_ROWS).toPandas()
    y = got["label"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        model.weights[-1] = np.log(max(rate, 1e-3) / max(1 - rate, 1e-3))
        return model
    x = np.stack(got["x"].to_numpy()).reshape(len(y), len(DISCOUNTS), FEATURES)
    fits = [fit_logistic(x[:, k], y) for k in range(len(DISCOUNTS))]
    loss = [np.logaddexp(0, (1 - 2 * y) * (x[:, k] @ w[:-1] + w[-1])).mean() for k, w in enumerate(fits)]
    model.discount = int(np.argmin(loss))
    model.weights = fits[model.discount]
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score double, 0 to 1; higher: toxic likelier) of every row of ``docs``.
    Null and empty texts score as a text without evidence does. Rows may repeat,
    ids may be null; an empty table gives no rows; other columns are not read."""
    total, back, all_contexts, weights = model.total, model.back[model.discount], max(model.contexts, 1.0), model.weights
    discount = DISCOUNTS[model.discount]

    def finish(ids, n, contexts, doc, sizes):
        x = features(n, contexts, doc, sizes, total, back, all_contexts, discount)
        return pd.DataFrame({"id": longs(ids), "score": 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))})

    return _read(docs.select(long_text(id_col).alias("id"), F.col(text_col).alias("text")), model, finish, "id bigint, score double")



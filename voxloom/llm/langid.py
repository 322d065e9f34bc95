"""Language identification by a linear-chain conditional random field.

Each word of a text gets a label; emissions are learned weights of its prefixes,
suffixes, letter n-grams and of the word itself (the lexicon), transitions are
learned too, and forward-backward gives every word's label probabilities, so a
text that changes language is labelled word by word. A text's language is the
one with the largest mean probability over its words.

The field is fitted on a bounded sample: TRAIN_TEXTS texts at most, whole, and
TRAIN_CHARS characters, as many of each language as there are, up to an equal share.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import fresh

TRAIN_TEXTS = 800
TRAIN_CHARS = 4 << 20  # of all texts that the field is fitted on, an equal share of each language
BITS = 16
EPOCHS = 25
ROWS = 256  # texts that step through the field together

_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str | None) -> list[str]:
    """The lower-cased runs of letters of a text, with the marks on them; marks
    alone are no word."""
    return _WORDS.findall((text or "").lower())


def features(word: str) -> list[int]:
    """Hashed features of a word: itself, prefixes and suffixes of 1 to 3 letters,
    its length, and all letter trigrams over the ends' marks."""
    framed = f"<{word}>"
    names = [f"w{word}", *(f"p{word[:k]}" for k in (1, 2, 3)), *(f"s{word[-k:]}" for k in (1, 2, 3)), f"n{min(len(word), 12)}"]
    names += [f"g{framed[k : k + 3]}" for k in range(max(1, len(framed) - 2))]
    return [xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in names]


def featured(words) -> tuple[np.ndarray, np.ndarray]:
    """The features of many words, one after the other, and how many each has."""
    each = [features(w) for w in words]
    return np.concatenate([np.array(x, np.int64) for x in each]), np.array([len(x) for x in each])


def emissions(emit: np.ndarray, flat: np.ndarray, sizes: np.ndarray, most: int = 1 << 17) -> np.ndarray:
    """The summed weights of every word's features, some words at a time."""
    ends = np.cumsum(sizes)
    out, at = np.empty((len(sizes), emit.shape[1])), 0
    while at < len(sizes):
        first = ends[at] - sizes[at]
        end = max(at + 1, int(np.searchsorted(ends, first + most, "right")))
        out[at:end] = np.add.reduceat(emit[flat[first : ends[end - 1]]], ends[at:end] - sizes[at:end] - first)
        at = end
    return out


def forward_backward(emit: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray, pairs: bool = False):
    """Label probabilities of padded sequences: emit (rows, steps, labels) are
    log-potentials, rows sorted by falling length. Returns the marginals
    and, with ``pairs``, the expected transition counts."""
    rows, steps, k = emit.shape
    top = emit.max(axis=2, keepdims=True)
    e = np.exp(emit - top)
    trans, first = np.exp(move), np.exp(start)
    alpha, scale = np.zeros((steps, rows, k)), np.ones((steps, rows))
    at = np.searchsorted(-lengths, -np.arange(steps), side="left")  # rows longer than t
    for t in range(steps):
        n = at[t]
        a = e[:n, t] * (first if t == 0 else alpha[t - 1, :n] @ trans)
        scale[t, :n] = a.sum(axis=1)
        alpha[t, :n] = a / scale[t, :n, None]
    beta = np.ones((rows, k))
    gamma = np.zeros((rows, steps, k))
    counts = np.zeros((k, k))
    for t in range(steps - 1, -1, -1):
        n = at[t]
        if t + 1 < steps and at[t + 1]:
            m = at[t + 1]
            b = e[:m, t + 1] * beta[:m] / scale[t + 1, :m, None]
            if pairs:
                counts += (alpha[t, :m].T @ b) * trans
            beta[:m] = b @ trans.T
        gamma[:n, t] = alpha[t, :n] * beta[:n]
    return gamma, counts


class Field:
    """Learned weights: emissions (2^BITS, labels), start and transitions."""

    def __init__(self, labels: list[str], emit: np.ndarray, start: np.ndarray, move: np.ndarray):
        self.labels, self.emit, self.start, self.move = labels, emit, start, move

    def mean_probabilities(self, texts: list[str | None]) -> np.ndarray:
        """Mean label probabilities (texts, labels) over the words of each text;
        rows of texts without a letter are zero."""
        known: dict[str, int] = {}
        number = known.setdefault
        found = [np.array([number(w, len(known)) for w in words_of(t)], np.int64) for t in texts]
        lengths = np.array([len(x) for x in found])
        out = np.zeros((len(texts), len(self.labels)))
        if not known or not self.labels:
            return out
        scores = emissions(self.emit, *featured(known))
        for rows in _groups(lengths):
            n = lengths[rows]
            emit = np.zeros((len(rows), int(n.max()), len(self.labels)))
            for r, row in enumerate(rows):
                emit[r, : n[r]] = scores[found[row]]
            gamma, _ = forward_backward(emit, n, self.start, self.move)
            out[rows] = gamma.sum(axis=1) / n[:, None]
        return out


def _groups(lengths: np.ndarray):
    """Row numbers of non-empty rows, longest first, so many at a time that a
    padded block stays small."""
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        n = max(1, min(ROWS, 400_000 // int(lengths[order[at]])))
        yield order[at : at + n]
        at += n


def fit(texts: list[str], langs: list[str], epochs: int = EPOCHS, rate: float = 0.3, ridge: float = 1e-4) -> Field:
    """Maximise the conditional likelihood of the labels, every word having its
    text's language, by Adagrad over whole passes."""
    labels = sorted(set(langs))
    k = len(labels)
    pairs = [(words_of(t), labels.index(g)) for t, g in zip(texts, langs, strict=True)]
    pairs = [p for p in pairs if p[0]]
    vocabulary: dict[str, int] = {}
    for words, _ in pairs:
        for w in words:
            vocabulary.setdefault(w, len(vocabulary))
    size = 1 << BITS
    emit, start, move = np.zeros((size, k)), np.zeros(k), np.eye(k)
    seen = [np.full_like(x, 1e-8) for x in (emit, start, move)]
    if not pairs:
        return Field(labels, emit, start, move)
    flat, sizes = featured(vocabulary)
    lengths = np.array([len(w) for w, _ in pairs])
    total = lengths.sum()
    blocks = []
    for rows in _groups(lengths):
        n = lengths[rows]
        ids = np.full((len(rows), int(n.max())), -1)
        for r, row in enumerate(rows):
            ids[r, : n[r]] = [vocabulary[w] for w in pairs[row][0]]
        blocks.append((ids, n, np.array([pairs[row][1] for row in rows])))
    for _ in range(epochs):
        by_word = emissions(emit, flat, sizes)
        g_word, g_start, g_move = np.zeros_like(by_word), np.zeros(k), np.zeros((k, k))
        for ids, n, gold in blocks:
            here = ids >= 0
            gamma, counts = forward_backward(by_word[ids] * here[:, :, None], n, start, move, pairs=True)
            gamma = -gamma
            gamma[np.arange(len(gold)), :, gold] += here
            g_word += np.column_stack([np.bincount(ids[here], gamma[:, :, c][here], len(by_word)) for c in range(k)])
            g_start += gamma[:, 0].sum(axis=0)
            g_move -= counts
            np.add.at(g_move, (gold, gold), n - 1)
        g_emit = np.column_stack([np.bincount(flat, np.repeat(g_word[:, c], sizes), size) for c in range(k)])
        for x, g, s in ((emit, g_emit, seen[0]), (start, g_start, seen[1]), (move, g_move, seen[2])):
            g = g / total - ridge * x / len(labels)
            s += g * g
            x += rate * g / np.sqrt(s)
    return Field(labels, emit, start, move)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_TEXTS) -> Field:
    """A field fitted on at most ``most`` rows of ``docs`` with a text and a
    language, the first of each language by a hash of the id (rows that repeat an
    id follow each other by text). A language that has only texts over its share of
    TRAIN_CHARS is learned from a piece of one. With no such row the field has no labels."""
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    rows = rows.withColumn("size", F.length("text")).withColumn("draw", F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1 << 30)))
    there = [(r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()]
    if not there:
        return Field([], np.zeros((1 << BITS, 0)), np.zeros(0), np.zeros((0, 0)))
    each, space = -(-most // len(there)), TRAIN_CHARS // len(there)
    # about twice an equal share of each language comes this far, by the hash alone, and its first ``each`` are taken
    share = F.create_map(*(F.lit(x) for g, n in there for x in (g, int(min(1.0, 2 * (each + 4) / n) * (1 << 30)))))
    few = rows.where(F.col("draw") < share[F.col("lang")])
    # of a text over the space, which counts only where its language has no other, a piece from a drawn place
    at = F.pmod(F.xxhash64("key", F.lit(9)), F.greatest(F.col("size") - space + 1, F.lit(1))) + 1
    few = few.withColumn("long", F.col("size") > space).withColumn("text", F.when(F.col("long"), F.substring("text", at, F.lit(space))).otherwise(F.col("text")))
    few = few.withColumn("size", F.least(F.col("size"), F.lit(space)))
    in_lang = Window.partitionBy("lang").orderBy("long", "draw", "key", "text")
    few = few.withColumn("place", F.row_number().over(in_lang)).where(F.col("place") <= each)
    few = few.withColumn("upto", F.sum("size").over(in_lang.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") <= space)
    sample = few.orderBy("draw", "key", "text").select("text", "lang").toPandas()
    return fit(sample["text"].tolist(), sample["lang"].tolist())


def identify(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred (string) and score (double, the mean probability
    of that language). Null texts and texts without a letter are ``und`` at 0; of
    equal languages the first by name is taken. No row moves."""
    state = docs.sparkSession.sparkContext.broadcast((field.labels, field.emit, field.start, field.move))

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: pd.Series) -> pd.DataFrame:
        own = Field(*state.value)
        p = np.concatenate([own.mean_probabilities(batches.iloc[k : k + 4096].tolist()) for k in range(0, len(batches), 4096)] or [np.zeros((0, len(own.labels)))])
        if not own.labels:
            return pd.DataFrame({"lang_pred": ["und"] * len(p), "score": np.zeros(len(p))})
        best = p.argmax(axis=1)
        score = p[np.arange(len(p)), best]
        return pd.DataFrame({"lang_pred": np.where(score > 0, np.array(own.labels, object)[best], "und"), "score": np.minimum(score, 1.0)})

    keep, found = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")], fresh(docs, "found")
    return docs.withColumn(found, run(F.col(text_col))).select(*keep, f"{found}.lang_pred", f"{found}.score")


def label_words(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, words array<string>, langs array<string>): the label of every word
    of every text by its largest marginal, for texts that switch languages."""
    state = docs.sparkSession.sparkContext.broadcast((field.labels, field.emit, field.start, field.move))

    @F.pandas_udf("words array<string>, langs array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        own = Field(*state.value)
        rows = []
        for t in texts:
            words = words_of(t)
            if not words or not own.labels:
                rows.append((words, ["und"] * len(words)))
                continue
            scores = emissions(own.emit, *featured(words))
            gamma, _ = forward_backward(scores[None], np.array([len(words)]), own.start, own.move)
            rows.append((words, [own.labels[c] for c in gamma[0].argmax(axis=1)]))
        return pd.DataFrame(rows, columns=["words", "langs"])

    return docs.select(F.col(id_col).alias("id"), run(F.col(text_col)).alias("w")).select("id", "w.words", "w.langs")

"""Grouping of spelling variants by a bit-sliced position index.

Words of the vocabulary that are one edit apart agree in the first or the last
half of the shorter one, so they meet in a block of words that do. A block keeps,
for each position and letter, the set of its words with that letter there, as one
long number of a bit a word. A word is run against the whole block at once: one
set holds the words that agree so far without an error, others those that agree
with one replaced letter, with one letter more (read one position further) or
with one less (one position back). Words stand in a block by falling count, so
that the lowest bit of the result is the most frequent near word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import cut, give_back_memory, in_tiles, long_text, solve_runs

RUN = re.compile("[A-Za-zÀ-ÿ]+")
NO_RUN = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
LEAST_LETTERS = 6
LEAST_COUNT = 5
TIMES = 5
FLUSH_WORDS = 1 << 18  # distinct words that a task counts before it sends them
SLICE_CHARS = 1 << 22
BLOCK_WORDS = 1 << 13


def runs_of(text: str | None) -> Counter:
    """The runs of letters of a text, only A-Z lower-cased, and their counts; of a very
    long text some megabytes at a time."""
    text, at, raw = text or "", 0, Counter()
    while at < len(text):
        stop = NO_RUN.search(text, at + SLICE_CHARS)
        end = stop.start() if stop else len(text)
        raw.update(RUN.findall(text, at, end))
        at = end
    out: Counter = Counter()
    for run, n in raw.items():
        out[run.lower() if run.isascii() else run.translate(_LOWER)] += n
    return out


def damaged(doc: str | None, run: str) -> str:
    """The run without one letter, if the checksum of document and run says so."""
    h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
    return run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run


def word_counts(docs: DataFrame, change=damaged, letters: int = LEAST_LETTERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n bigint) of all words of ``letters`` code points or more, after
    ``change(document id as text, run)``, which never makes a run longer. Counted
    once in each task, then over all."""

    def count(batches):
        seen: Counter = Counter()

        def flush():
            return pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})

        for b in batches:
            for doc, text in zip(b["id"], b["text"], strict=True):
                for run, n in runs_of(text).items():
                    if len(run) >= letters:
                        word = change(doc, run)
                        if len(word) >= letters:
                            seen[word] += n
                if len(seen) >= FLUSH_WORDS:
                    yield flush()
                    seen = Counter()
        if seen:
            yield flush()
        seen = Counter()
        give_back_memory()

    return docs.select(long_text(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class PositionIndex:
    """Per (position, letter) the set of words with that letter there, a bit a word."""

    def __init__(self, words: list[str]):
        self.words, self.all = words, (1 << len(words)) - 1
        self.at: list[dict[str, int]] = []
        self.of_length: dict[int, int] = defaultdict(int)
        places: list[dict[str, list[int]]] = []
        for k, w in enumerate(words):
            self.of_length[len(w)] |= 1 << k
            while len(places) < len(w):
                places.append(defaultdict(list))
            for i, c in enumerate(w):
                places[i][c].append(k)
        size = len(words) // 8 + 1
        for here in places:
            sets = {}
            for c, members in here.items():
                bits = bytearray(size)
                for k in members:
                    bits[k >> 3] |= 1 << (k & 7)
                sets[c] = int.from_bytes(bits, "little")
            self.at.append(sets)

    def near(self, word: str, shorter: int, half: int) -> tuple[int, int]:
        """(set of the words one edit from ``word`` of which the shorter of the two has
        ``shorter`` letters, set of the words that share the first ``half`` letters)."""
        exact, replaced, more, less = self.all, 0, self.all, 0
        prefix, empty = self.all, {}
        at, n = self.at, len(self.at)
        for i, c in enumerate(word):
            here = at[i].get(c, 0) if i < n else 0
            replaced = (replaced & here) | (exact & ~here)
            less = (less & at[i - 1].get(c, 0) if 0 < i <= n else 0) | exact
            exact &= here
            more = (more & (at[i + 1] if i + 1 < n else empty).get(c, 0)) | exact
            if i + 1 == half:
                prefix = exact
            if not (exact or replaced or more or less):
                break
        if len(word) == shorter:
            return (replaced & self.of_length.get(shorter, 0)) | (more & self.of_length.get(shorter + 1, 0)), prefix
        return less & self.of_length.get(shorter, 0), prefix


def _solve(b: pd.DataFrame) -> pd.DataFrame:
    """Of the blocks of a batch, for each word that has near words there: how many,
    and the most frequent, the smallest among equals."""
    rows = []
    tiles = b["tile"].to_numpy()
    new = np.concatenate([[True], tiles[1:] != tiles[:-1]])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(tiles))
    words, counts, m, last, side = (b[c].tolist() for c in ("word", "n", "m", "last", "side"))
    for start, end in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
        blocks: dict[tuple, list] = defaultdict(list)
        for k in range(start, end):
            blocks[m[k], last[k]].append((-counts[k], words[k], side[k]))
        for (shorter, at_end), block in blocks.items():
            block.sort()
            parts = [(block, block)] if block[0][2] < 0 else [([x for x in block if x[2] == s], [x for x in block if x[2] != s]) for s in (0, 1)]
            for asked, held in parts:
                index = PositionIndex([x[1] for x in held])
                for _, w, _ in asked:
                    near, prefix = index.near(w, shorter, shorter // 2)
                    # pairs that share both halves are found by the first one
                    near &= ~prefix if at_end else prefix
                    if near:
                        k = (near & -near).bit_length() - 1
                        rows.append((w, near.bit_count(), held[k][0], held[k][1]))
    return pd.DataFrame(rows, columns=["word", "n_near", "minus", "near"])


def near_words(vocabulary: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n_near bigint, near string, near_n bigint) of every word of
    ``vocabulary`` (word, unique and of two letters or more; n bigint) that has
    another one at one inserted, deleted or replaced code point: how many, and the
    one of largest n, the smallest in code-point order among equals.

    Two such words, the shorter of m letters, share the first or the last m div 2:
    so each word goes to four blocks, two as a shorter or equal and two as a longer
    one. Blocks of over ``block_words`` words are compared in tiles.
    """
    length = F.length("word")
    keyed = (
        vocabulary.select("word", "n", F.explode(F.array(length - 1, length)).alias("m"))
        .where("m >= 1")
        .select("word", "n", "m", F.explode(F.array(F.lit(False), F.lit(True))).alias("last"))
        .withColumn("half", F.expr("IF(last, right(word, m div 2), left(word, m div 2))"))
        .select(F.xxhash64("m", "last", "half").alias("key"), F.xxhash64("word").alias("id"), "word", "n", "m", "last")
    )
    found = solve_runs(in_tiles(keyed, "key", block_words), "tile", _solve, "word string, n_near bigint, minus bigint, near string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus", "near")).alias("best"))
    return best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.minus")).alias("near_n"))


def variants(counts: DataFrame, least: int = LEAST_COUNT, times: int = TIMES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, form, root string; n, n_near, form_n bigint) of every word of
    ``counts`` (word, n) that occurs ``least`` times or more.

    ``form`` is the word's most frequent near word, if it occurs at least ``times``
    as often, else null; ``root`` is where forms lead from it, itself if it has none.
    Counts grow along forms, so there are no rings, and each round doubles the way gone.
    """
    words = cut(counts.where(F.col("n") >= least))
    found = words.join(near_words(words, block_words), "word", "left")
    formed = F.col("near_n") >= times * F.col("n")
    out = cut(
        found.select(
            "word",
            F.when(formed, F.col("near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(formed, F.col("near_n")).alias("form_n"),
        )
    )
    lead = cut(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = lead.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = cut(lead.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        lead = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            break
    return out.join(lead, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, change=damaged, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``variants`` of the words of all texts. Null and empty texts have no words; ids
    may be null (as an empty string to ``change``) or repeat; texts may be of any
    length. No rows give no words."""
    return variants(word_counts(docs, change, letters, id_col, text_col), least, times)

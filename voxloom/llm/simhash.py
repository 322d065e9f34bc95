"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint is the bitwise majority of the hashes of a text's word shingles.
Fingerprints that may be near each other meet in buckets; in a bucket the
fingerprints lie as bit planes (plane k holds bit k of every row), one XOR
compares a plane with itself shifted by s rows, i.e. bit k of all pairs (i, i+s),
and carry-save counters held as planes as well add up the differing bits of all
those pairs at once. Blocks of pairs whose counters all exceed the radius, or
which lie in no common bucket, are left early.

Two searches use it: ``simhash_components`` links fingerprints at a radius, and
``near_duplicates`` links texts by the Jaccard similarity of their sets, for
which texts meet in buckets that no near pair can miss.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import BROADCAST_ROWS, Forest, broadcast_if_small, connected_components, cut, fresh, give_back_memory, groups_for, in_tiles, join_hot, long_text, longs, mix64, solve_runs
from voxloom.llm.substring import repeats

_SPREAD = np.array([sum(((v >> i) & 1) << (8 * i) for i in range(8)) for v in range(256)], np.uint64)


def shingle_hashes(text: str | None, words: int, fold: bool = True) -> list[int]:
    """XXH64 (seed 42) of the space-joined shingles, repeats included. Fewer
    words than a shingle make one shingle; no words make none. White space is
    ASCII's; fold lower-cases A-Z only."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    parts = (raw.lower() if fold else raw).split()
    if not parts:
        return []
    joined = b" ".join(parts)
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(joined, 42)]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray, counts: np.ndarray, lanes: int = 1) -> np.ndarray:
    """Fingerprints, uint64 (texts, lanes), of texts that have ``counts`` hashes
    each, one after another. A bit is set if over half of a text's hashes have
    it; lane j > 0 takes the hashes remixed with j."""
    out = np.zeros((len(counts), lanes), np.uint64)
    have = np.flatnonzero(counts)
    if not len(have):
        return out
    n = counts[have].astype(np.int64)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    # eight counters share a word and overflow at 256: cut texts into runs of 255
    runs = (n + 254) // 255
    run_of = np.repeat(np.arange(len(n)), runs)
    run_first = np.concatenate([[0], np.cumsum(runs)[:-1]])
    starts = first[run_of] + 255 * (np.arange(len(run_of)) - run_first[run_of])
    for lane in range(lanes):
        h = hashes if lane == 0 else mix64(hashes, lane)
        octets = h.view(np.uint8).reshape(-1, 8)
        bits = np.empty((len(n), 64), np.uint8)
        for j in range(8):
            part = np.add.reduceat(_SPREAD[octets[:, j]], starts).view(np.uint8).reshape(-1, 8)
            total = np.add.reduceat(part.astype(np.int64), run_first, axis=0)
            bits[:, 8 * j : 8 * j + 8] = 2 * total > n[:, None]
        out[have, lane] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, words: int = 5, lanes: int = 1, fold: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id bigint, fp array<bigint>) of every row of ``docs``, over its shingles,
    repeats included. Null and empty texts have fingerprint zero. Rows may repeat,
    ids may be null."""

    def run(batches):
        give_back_memory()  # what earlier stages of this worker have left
        for b in batches:
            texts = b["text"].tolist()
            for at in range(0, len(texts), 512):
                some = texts[at : at + 512]
                hashes = [shingle_hashes(t, words, fold) for t in some]
                counts = np.array([len(h) for h in hashes])
                flat = np.array([x for h in hashes for x in h], np.uint64)
                fp = majority(flat, counts, lanes).view(np.int64)
                yield pd.DataFrame({"id": longs(b["id"].iloc[at : at + 512]), "fp": list(fp)})

    picked = docs.select(long_text(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInPandas(run, "id bigint, fp array<bigint>")


def near_pairs(fp: np.ndarray, bucket: np.ndarray, radius: int, side: np.ndarray | None = None, block: int = 64):
    """Yield (i, j) index arrays of all pairs of rows in one bucket at ``radius``
    or fewer differing bits. Rows come sorted by bucket; fp is uint64 (rows,
    lanes). With ``side`` (0 or 1) only pairs of different sides count."""
    n, lanes = fp.shape
    words = -(-n // 64)
    planes = np.zeros((lanes * 64, words * 8), np.uint8)
    for lane in range(lanes):
        bits = np.unpackbits(fp[:, lane : lane + 1].copy().view(np.uint8), axis=1, bitorder="little")
        planes[lane * 64 : lane * 64 + 64, : -(-n // 8)] = np.packbits(bits.T, axis=1, bitorder="little")
    planes = planes.view("<u8")
    # the same planes with one word of padding, to read them from any bit on
    padded = np.concatenate([planes, np.zeros((len(planes), 2), "<u8")], axis=1)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    last = np.repeat(np.concatenate([first[1:], [n]]), np.diff(np.concatenate([first, [n]])))
    room = last - np.arange(n)  # a row has partners at shifts below this
    levels = max(1, int(radius).bit_length())
    for s in range(1, int(room.max(initial=1))):
        rows = np.flatnonzero(room > s)
        if side is not None:
            rows = rows[side[rows] != side[rows + s]]
        if not len(rows):
            continue
        at = np.unique(rows >> 6)  # the words of pairs that are still alive
        mask = np.zeros(words, "<u8")
        np.bitwise_or.at(mask, rows >> 6, np.uint64(1) << (rows & 63).astype(np.uint64))
        alive = mask[at]
        counters = np.zeros((levels, len(at)), "<u8")
        over = ~alive  # sticky: more than the counters hold, or no pair
        q, r = divmod(s, 64)
        for k in range(len(planes)):
            other = padded[k][np.minimum(at + q, words)]
            if r:
                high = padded[k][np.minimum(at + q + 1, words)]
                other = (other >> np.uint64(r)) | (high << np.uint64(64 - r))
            carry = planes[k][at] ^ other
            for c in range(levels):
                counters[c], carry = counters[c] ^ carry, counters[c] & carry
            over |= carry
            if k % 8 == 7:
                keep = ~(over | _exceeds(counters, radius)) != 0
                if not keep.all():
                    at, counters, over = at[keep], counters[:, keep], over[keep]
                    if not len(at):
                        break
        if len(at):
            good = ~(over | _exceeds(counters, radius))
            lanes_of = np.unpackbits(good.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            w, b = np.nonzero(lanes_of)
            i = at[w] * 64 + b
            yield i, i + s


def _exceeds(counters: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is over ``radius``, by comparing planes from the top."""
    more = np.zeros(counters.shape[1], "<u8")
    equal = ~more
    for c in range(len(counters) - 1, -1, -1):
        if (radius >> c) & 1:
            equal = equal & counters[c]
        else:
            more |= equal & counters[c]
            equal = equal & ~counters[c]
    return more


def link_buckets(keyed: DataFrame, lanes: int, radius: int, most: int = 4096) -> DataFrame:
    """Edges (a, b) that span, in every bucket of ``keyed`` (key bigint, id
    bigint, fp array<bigint>), the links at ``radius`` or fewer bits: as many
    edges as rows at most, never all pairs. Buckets of over ``most`` rows are
    compared in tiles."""

    def solve(b: pd.DataFrame):
        fp = np.stack(b["fp"].to_numpy()).astype(np.int64).view(np.uint64).reshape(len(b), lanes)
        tile, ids, side = b["tile"].to_numpy(), b["id"].to_numpy(), b["side"].to_numpy()
        forest = Forest(len(b))
        for some, sides in ((np.flatnonzero(side < 0), False), (np.flatnonzero(side >= 0), True)):
            if len(some):
                for i, j in near_pairs(fp[some], tile[some], radius, side[some] if sides else None):
                    forest.link(some[i], some[j])
        roots = forest.roots()
        own = roots != np.arange(len(b))
        return pd.DataFrame({"a": ids[own], "b": ids[roots[own]]})

    return solve_runs(in_tiles(keyed, "key", most), "tile", solve, "a bigint, b bigint", GATHERED).distinct()


def pigeonhole_keys(fp: str, radius: int) -> F.Column:
    """Keys of a 64-bit fingerprint, for an exact search: of radius + 2 pieces
    at least two are untouched by ``radius`` changed bits, so fingerprints that
    near share the key of a pair of pieces."""
    pieces = radius + 2
    cuts = [round(64 * k / pieces) for k in range(pieces + 1)]
    piece = lambda k: F.shiftrightunsigned(F.col(fp), cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1).cast("long"))
    return F.array(*(F.xxhash64(F.lit(n), piece(a), piece(b)) for n, (a, b) in enumerate(combinations(range(pieces), 2))))


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp bigint, component bigint) of every row of ``docs``: 64-bit
    fingerprints over ``words``-word shingles, linked at ``radius`` or fewer
    differing bits; component is the smallest id that links lead to.

    Exact. Rows with one fingerprint are one point of the search, however many
    they are; the points go by their fingerprints, so rows may repeat an id or
    have none (a component of such rows alone is null). Null and empty texts share
    fingerprint zero. An empty table gives no rows; further columns of ``docs``
    are not read.
    """
    prints = cut(fingerprints(docs, words, 1, True, id_col, text_col).select("id", F.col("fp")[0].alias("fp")))
    points = cut(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    keyed = points.select(F.col("fp").alias("id"), F.array("fp").alias("v"), F.explode(pigeonhole_keys("fp", radius)).alias("key"))
    parts = connected_components(link_buckets(keyed.withColumnRenamed("v", "fp"), 1, radius))
    linked = points.join(parts.withColumnRenamed("node", "fp"), "fp").select("fp", "n", "root", "least")
    joined = join_hot(linked.select("fp", "n", "root"), linked.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("points")), "root", "points", points.count())
    named = joined.select("fp", "n", "component").unionByName(points.join(parts, F.col("fp") == F.col("node"), "left_anti").select("fp", "n", F.col("least").alias("component")))
    return join_hot(prints, named, "fp", "n", prints.count()).select("id", "fp", "component")


GATHERED = 10_000  # rows of fingerprints that are compared in one go, or a tile more
LANES = 4  # of 64 bits each, in the fingerprints of near-duplicates
DEVIATIONS = 6.0  # what the radius leaves to chance, in standard deviations
PARTS_SPREAD = 4  # times as many groups for the parts' keys, which do not pack as well as words
HOT_PART = 4_096  # texts that may share a part before it counts as hot


def radius_for(similarity: float, lanes: int = LANES) -> int:
    """Differing bits that sets at ``similarity`` or more do not exceed, but for
    odds of about one in 10^9: the share of differing bits is the angle between
    the sets over pi, and at most a fifth more for small sets, where counts tie."""
    n, p = 64 * lanes, 1.2 * float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return min(n - 1, int(np.ceil(n * p + DEVIATIONS * np.sqrt(n * p * (1 - p)))))


def part_keys(shingles: np.ndarray, similarity: float) -> tuple[np.ndarray, list[int]]:
    """(keys uint64, spare) of a set of distinct shingle hashes, such that any two
    sets at ``similarity`` (over 0.5) or more share a key.

    Two sets of x and y members at similarity t differ in (x + y)(1 - t)/(1 + t)
    members at most. Members are dealt by their hash to parts, more of them than
    sets of about that size may differ in, so that some part, not an empty one, is
    the same in both: its key is a hash of its members. Sizes from 2^g to 2^(g+1)
    have one dealing; pairs that a power of two separates meet in another, to
    which only sizes near it belong. Bit 2 of a key tells the two kinds. ``spare``
    says, by kind, how many parts could be left out without loss; a set with too
    few parts has one key more, which all such sets have.
    """
    size = len(shingles)
    keys, spare = [], [1 << 30, 1 << 30]
    if not size:
        return np.empty(0, np.uint64), spare
    apart = (1 - similarity) / (1 + similarity)
    base = 1 << (size.bit_length() - 1)
    dealings = [(0, base, 2 * (2 * base - 1), min(size / similarity, 2 * base - 1))]
    for edge in (base, 2 * base):
        most = (edge - 1) / similarity  # the largest partner of the largest size below the edge
        if edge > 1 and similarity * edge <= size + 1e-9 and size <= most + 1e-9:
            dealings.append((1, edge, edge - 1 + most, size / similarity if size < edge else edge - 1))
    for kind, name, both, partner in dealings:
        differ = int(apart * both + 1e-9)
        parts = differ + 3 + differ // 8
        salt = 2 * name + kind
        part = ((mix64(shingles, salt & 1023) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sums = np.add.reduceat(mix64(shingles, 3)[order], first)
        own = mix64(sums + mix64(part[first] + (np.uint64(salt) << np.uint64(32)), 4), 5)
        room = len(first) - int(apart * (size + partner) + 1e-9) - 1
        spare[kind] = min(spare[kind], room)
        if room < 0:
            own = np.append(own, mix64(np.array([salt], np.uint64), 6))
        keys.append((own & ~np.uint64(7)) | np.uint64(kind << 2))
    return np.concatenate(keys), spare


def set_prints(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(id, fp, copy, spare) of every row of ``docs`` (id, text): the fingerprint of
    the set of its distinct shingles, a 128-bit hash of that set, and how many of
    its parts may be left out."""

    def run(batches):
        give_back_memory()  # what earlier stages of this worker have left
        for b in batches:
            for at in range(0, len(b), 512):
                sets = [np.unique(np.array(shingle_hashes(t, words), np.uint64)) for t in b["text"].iloc[at : at + 512]]
                fp = majority(np.concatenate(sets), np.array([len(x) for x in sets]), LANES).view(np.int64)
                copy = [xxhash.xxh3_128_hexdigest(x.tobytes()) for x in sets]
                yield pd.DataFrame({"id": b["id"].iloc[at : at + 512].to_numpy(), "fp": list(fp), "copy": copy, "spare": [part_keys(x, similarity)[1] for x in sets]})
        give_back_memory()

    return docs.mapInPandas(run, "id bigint, fp array<bigint>, copy string, spare array<int>")


def shared_parts(texts: DataFrame, words: int, similarity: float, spare: DataFrame) -> DataFrame:
    """(key, id): texts (id, text) by the parts of their sets that other texts have
    too, so that all pairs at ``similarity`` or more share a key.

    A hot part, one of over HOT_PART texts, counts only for texts that could not do
    without: of two near texts, one whose parts suffice without the hot ones
    shares another with its partner. Parts that the very same texts share are one."""

    def per_text(row):
        h, _ = part_keys(np.unique(np.array(shingle_hashes(row.text, words), np.uint64)), similarity)
        return h, np.ones(len(h), bool)

    def open_hits(batches):
        for b in batches:
            hits = [np.frombuffer(x, "<i8") for x in b["hits"]]
            key = np.concatenate([*hits, np.empty(0, np.int64)])
            yield pd.DataFrame({"key": key, "id": np.repeat(b["id"].to_numpy(), [len(x) for x in hits]), "edge": (key & 4) > 0})

    # cut, so that no task runs two Python workers
    found = cut(cut(repeats(texts, per_text, PARTS_SPREAD * groups_for(texts), "<u8", 1 << 18)).mapInPandas(open_hits, "key bigint, id bigint, edge boolean"))
    hot = broadcast_if_small(cut(found.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_PART).select("key")))
    in_hot = found.join(hot, "key")
    of_text = in_hot.groupBy("id", "edge").agg(F.count("*").alias("n")).join(spare, "id")
    tight = of_text.where(F.col("n") > F.when(F.col("edge"), F.col("spare")[1]).otherwise(F.col("spare")[0])).select("id", "edge")
    left = found.join(hot, "key", "left_anti").select("key", "id").unionByName(in_hot.join(tight, ["id", "edge"], "left_semi").select("key", "id"))
    members = left.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(2))).alias("y"))
    one_each = members.where("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    return left.join(one_each, "key", "left_semi")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, group) of the rows of ``docs`` that have near-duplicates: texts whose
    sets of ``words``-word shingles have Jaccard similarity ``similarity`` or
    more, directly or through others; group is the smallest id of the class.

    Texts that share a part of their sets meet (any two at the wanted similarity
    do), and their fingerprints of distinct shingles, 256 bits, are compared
    bit-sliced; the radius loses a near pair with odds of about one in 10^9. Each
    cluster that results is then compared exactly, all pairs of its texts, in
    tiles of bounded size. Equal sets are one text with a number of ids. Null and
    empty texts have the empty set and count as copies of each other. Null ids are
    left out; rows that repeat an id with another text are taken as further texts
    of that id. An empty table gives no rows.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    prints = cut(set_prints(picked, words, similarity))
    classes = cut(prints.groupBy("copy").agg(F.min("id").alias("id"), F.min_by(F.struct("fp", "spare"), "id").alias("of")).select("copy", "id", "of.*"))
    reps = picked.join(broadcast_if_small(classes.select("id")), "id", "left_semi")
    parts = shared_parts(reps, words, similarity, classes.select("id", "spare"))
    keyed = parts.join(broadcast_if_small(classes.select("id", "fp"), BROADCAST_ROWS // LANES), "id").select("key", "id", "fp")
    clusters = cut(connected_components(link_buckets(keyed, LANES, radius_for(similarity))))
    texts = picked.join(broadcast_if_small(clusters.select(F.col("node").alias("id"), F.col("root").alias("key"))), "id")

    def sets(batches):
        for b in batches:
            for at in range(0, len(b), 512):
                some = b.iloc[at : at + 512]
                own = [np.unique(np.array(shingle_hashes(t, words), np.uint64)).tobytes() for t in some["text"]]
                yield pd.DataFrame({"key": some["key"], "id": some["id"], "shingles": own})
        give_back_memory()

    def solve(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        tile = b["tile"].to_numpy()
        edges = np.concatenate([np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])), [len(b)]])
        for at, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if end - at > 1:
                one = b.iloc[at:end]
                out.append(_jaccard_edges(one["id"].to_numpy(), one["side"].to_numpy(), list(one["shingles"]), similarity))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype=np.int64)

    exact = solve_runs(in_tiles(texts.mapInPandas(sets, "key bigint, id bigint, shingles binary"), "key", 512), "tile", solve, "a bigint, b bigint")
    named = connected_components(exact)
    group = classes.select("copy", "id").join(named, F.col("id") == F.col("node"), "left").select("copy", F.coalesce("root", "id").alias("group"))
    sizes = prints.groupBy("copy").agg(F.count("*").alias("n"))
    return join_hot(prints.select("id", "copy"), group.join(sizes, "copy"), "copy", "n", prints.count()).groupBy("id").agg(F.min("group").alias("group"))


def _jaccard_edges(ids: np.ndarray, side: np.ndarray, shingles: list[bytes], similarity: float, width: int = 4096) -> pd.DataFrame:
    """The spanning forest of the pairs of one tile at ``similarity`` or more."""
    sets = [np.frombuffer(x, np.uint64) for x in shingles]
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[col] > 1
    order = np.cumsum(times > 1) - 1
    row, col = row[shared], order[col[shared]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(col.max(initial=-1)) + 1, width):
        here = (col >= at) & (col < at + width)
        m = np.zeros((len(sets), width), np.float32)
        m[row[here], col[here] - at] = 1
        both += m @ m.T
    near = np.triu(both >= similarity * (size[:, None] + size[None, :] - both) - 1e-6, 1)
    if side[0] >= 0:
        near &= side[:, None] != side[None, :]
    forest = Forest(len(sets))
    forest.link(*np.nonzero(near))
    roots = forest.roots()
    own = roots != np.arange(len(sets))
    return pd.DataFrame({"a": ids[own], "b": ids[roots[own]]})


def keep_one_of_each(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id is in ``groups`` (id, group) under
    another group than itself; all else, null ids too, stays as it is."""
    name = fresh(docs, "gone")
    gone = broadcast_if_small(cut(groups.where("id <> `group`").select(F.col("id").alias(name))))
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")

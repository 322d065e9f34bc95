"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Pre-tokens are exploded with their positions, dictionary-coded per chunk of
documents: a chunk is the list of its distinct words and, per document, the
array of word numbers in order of position. Words go to hash buckets, where each
distinct word of the corpus is encoded once; the ids are joined back to the
chunks, which reassemble their documents by position. Decoding joins the
token-byte table, which is as large as the vocabulary and no larger.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import cut_by, give_back_memory, groups_for, long_text, longs, pack, pack_planes, trimmed, unpack, unpack_planes

CHUNK_CHARS = 8 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file's token bytes and ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, finish, finish_schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Apply ``finish(ids uint32 array, token_bytes list, positions int64 array)``
    to the token ids of every document and return (id, what it returns).

    ``positions[k]`` is the number of ids up to the end of pre-token k. Null and
    empty texts have no tokens. Rows may repeat; each is encoded. Ids may be null.
    """
    spark = docs.sparkSession
    picked = docs.select(long_text(id_col).alias("id"), F.col(text_col).alias("text"))
    buckets = groups_for(picked)
    vocabulary = spark.sparkContext.broadcast(ranks)  # bounded by the vocabulary file

    def chunks(batches):
        split = regex.compile(pattern).findall
        docs_of, numbers, known, size = [], [], {}, 0

        def flush():
            name = uuid.uuid4().hex
            # frequent words first, so that most word numbers are small
            count = np.bincount(np.concatenate([*numbers, np.empty(0, np.uint32)]).astype(np.int64), minlength=len(known))
            order = np.argsort(-count, kind="stable")
            place = np.empty(len(known), np.uint32)
            place[order] = np.arange(len(known))
            words = np.array(list(known), object)[order].tolist()
            raw = [w.encode("utf-8") for w in words]
            bucket = np.array([xxhash.xxh32_intdigest(w) % buckets for w in raw], np.int64) if raw else np.empty(0, np.int64)
            rows = []
            by = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
            for k in range(buckets):
                mine = by[edges[k] : edges[k + 1]]
                if len(mine):
                    some = [raw[i] for i in mine.tolist()]
                    lengths = np.fromiter(map(len, some), np.uint32, len(some))
                    rows.append((k, name, None, pack(mine.astype(np.uint32)), pack(lengths), zlib.compress(b"".join(some), 1)))
            # documents of a chunk in blocks, so that no row is large
            step = max(1, len(docs_of) * (4 << 20) // max(1, size))
            for at in range(0, len(docs_of), step):
                some = numbers[at : at + step]
                counts = np.fromiter(map(len, some), np.uint32, len(some))
                flat = place[np.concatenate([*some, np.empty(0, np.uint32)]).astype(np.int64)]
                rows.append((-1, name, docs_of[at : at + step], pack(counts), None, pack_planes(flat)))
            return pd.DataFrame(rows, columns=["bucket", "chunk", "ids", "a", "b", "c"])

        for b in batches:
            for i, t in zip(b["id"].tolist(), b["text"].tolist(), strict=True):
                found = split((t or "").encode("utf-8", "replace").decode("utf-8"))
                get = known.setdefault
                docs_of.append(i)
                numbers.append(np.fromiter((get(w, len(known)) for w in found), np.uint32, len(found)))
                size += len(t or "")
                if size >= CHUNK_CHARS:
                    yield flush()
                    docs_of, numbers, known, size = [], [], {}, 0
        if docs_of:
            yield flush()
        docs_of, numbers, known = [], [], {}
        give_back_memory()

    def encode_words(b: pd.DataFrame) -> pd.DataFrame:
        import tiktoken

        coder = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=vocabulary.value, special_tokens={})
        known: dict[bytes, np.ndarray] = {}
        out = []
        for row in b.itertuples(index=False):
            ends = np.cumsum(unpack(row.b, np.uint32)).tolist()
            text = zlib.decompress(row.c)
            words = [text[x:y] for x, y in zip([0, *ends], ends, strict=False)]
            fresh = [w for w in dict.fromkeys(words) if w not in known]
            known.update((w, np.array(coder.encode_ordinary(w.decode("utf-8")), np.uint32)) for w in fresh)
            got = [known[w] for w in words]
            counts = np.fromiter(map(len, got), np.uint32, len(got))
            out.append((row.chunk, row.a, pack(counts), pack(np.concatenate(got))))
        return pd.DataFrame(out, columns=["chunk", "a", "b", "c"])

    def reassemble(own: pd.DataFrame, of_words: pd.DataFrame) -> pd.DataFrame:
        bytes_of: list = [b""] * (max(vocabulary.value.values(), default=-1) + 1)
        for token, i in vocabulary.value.items():
            bytes_of[i] = token
        places = [unpack(x, np.uint32) for x in of_words["a"]]
        counts = [unpack(x, np.uint32) for x in of_words["b"]]
        n = 1 + max((int(p.max()) for p in places if len(p)), default=-1)
        count = np.zeros(n, np.int64)
        for p, c in zip(places, counts, strict=True):
            count[p] = c
        start = np.concatenate([[0], np.cumsum(count)])
        flat = np.empty(start[-1], np.uint32)
        for p, c, x in zip(places, counts, of_words["c"], strict=True):
            ids = unpack(x, np.uint32)
            c = c.astype(np.int64)
            flat[np.repeat(start[p] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(len(ids))] = ids
        rows = []
        for row in own.itertuples(index=False):
            sizes = unpack(row.a, np.uint32)
            words = unpack_planes(row.c).astype(np.int64)
            at = 0
            for i, m in zip(row.ids, sizes.tolist(), strict=True):
                mine = words[at : at + m]
                at += m
                c = count[mine]
                ends = np.cumsum(c)
                ids = flat[np.repeat(start[mine] - (ends - c), c) + np.arange(int(ends[-1]) if m else 0)]
                rows.append((i, *finish(ids, bytes_of, ends)))
        out = pd.DataFrame(rows, columns=names)
        return out.assign(id=longs([r[0] for r in rows]))

    encoded, whole = trimmed(encode_words), trimmed(reassemble)
    names = ["id", *(x.strip().split(" ")[0] for x in finish_schema.split(","))]
    # written once, as the chunks' names and numbers must be the same on both sides
    # of the join, and by chunk, so that only the dictionaries are shuffled
    blobs = cut_by(picked.mapInPandas(chunks, "bucket int, chunk string, ids array<string>, a binary, b binary, c binary"), "chunk", buckets)
    words = blobs.where("bucket >= 0").repartition(buckets, "bucket").groupBy("bucket").applyInPandas(lambda b: encoded(b), "chunk string, a binary, b binary, c binary")
    own = blobs.where("bucket < 0").select("chunk", "ids", "a", "c")
    return own.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInPandas(lambda a, b: whole(a, b), f"id bigint, {finish_schema}")


def digest(ids: np.ndarray, bytes_of: list, _ends) -> tuple:
    """(n_tokens, SHA-256 of the ids as little-endian uint32, SHA-256 of the decoded bytes)."""
    decoded = b"".join([bytes_of[i] for i in ids.tolist()])
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def decode(encoded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary) from (id, ids array<bigint>). Null or empty ids decode
    to no bytes; an id that is not in the vocabulary makes the result null."""
    table = encoded.sparkSession.sparkContext.broadcast({i: t for t, i in ranks.items()})

    @F.pandas_udf("binary")
    def join_bytes(col: pd.Series) -> pd.Series:
        get = table.value.get

        def one(x):
            found = [get(int(i)) for i in (x if x is not None else ())]
            return None if None in found else b"".join(found)

        return col.map(one)

    return encoded.select(F.col(id_col).alias("id"), join_bytes(F.coalesce(F.col(ids_col), F.array().cast("array<bigint>"))).alias("bytes"))

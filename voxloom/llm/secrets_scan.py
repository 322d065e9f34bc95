"""Secret scans with a random forest that removes false positives.

Patterns find candidates: long runs of key characters that hold a digit, values
assigned to names like ``token``, private key blocks. A forest, trained from
labelled findings, tells secrets from digests, identifiers, numbers and words by
the candidate's length, its character transitions, how much of it a dictionary
covers, the path it comes from and the words before and after it.

Labelled findings are a table (before, candidate, after, path, label), of which at
most FINDINGS rows, drawn by a hash, fit the forest. Where none is given, forms
are drawn of secrets and of what looks like them, among words of the corpus; no
text of the corpus is labelled by a pattern. Transitions and the dictionary are
counted over all texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import cut, give_back_memory

FINDINGS = 20_000  # labelled rows that fit the forest, at most
DRAWN_FINDINGS = 3_000
SHARE = 100_000  # a dictionary word is one in so many words or more, so there are at most so many
FLUSH_WORDS = 200_000  # a task sends its words' counts on when it holds so many
TREES, DEPTH, LEAST_ROWS, BINS = 40, 8, 4, 24
REACH, AHEAD = 48, 24  # characters before and after a candidate in which its neighbouring words lie
THRESHOLD = 0.5
MASK = "[SECRET]"

_RUN = re.compile(r"[A-Za-z0-9+/_\-]{16,}={0,2}")
_NAMES = r"token|secret|passw(?:or)?d|passwd|pwd|api_?key|access_?key|private_?key|client_?key|auth|credential"
# a name (only from where a run of its characters begins, and whole, so that the
# search is linear), what sets it apart from its value, and the value
_KEY = re.compile(r"(?<![\w\-.])[\w\-.]++[\"']?\s{0,3}[:=]\s{0,3}[\"']?(?:(?i:bearer|basic)\s{1,3})?")
_VALUE = re.compile(r"[^\s\"',;<>]{8,}")
_BEGIN = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
_END = re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
_HINT = re.compile(rf"(?i){_NAMES}")
_BENIGN = re.compile(r"(?i)\b(?:sha\d*|commit|md5|digest|checksum|hash|uuid|guid|etag|version|example|isbn|order|invoice|phone|serial|img|src|href|https?)\b")
_PREFIX = re.compile(r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|sk-|sk_live_|rk_live_|xox[abpr]-|AIza|eyJ|glpat-|npm_|SG\.)")
_DIGIT = re.compile(r"\d")
_GIVEN = re.compile(r"[:=]\s{0,3}[\"']?(?:(?i:bearer|basic)\s{1,3})?$")
_WORD = re.compile(r"[^\W\d_]{3,}")
FEATURE_NAMES = ["length", "transitions", "entropy", "digits", "changes", "dictionary", "hex", "prefix", "assigned", "named", "benign", "path", "distinct", "letters", "words before", "words after"]


def _assigned(text: str):
    """Spans of the values that a secret's name is given. A value is not searched
    for further names."""
    end = 0
    for m in _KEY.finditer(text):
        if m.start() >= end and _HINT.search(m.group()):
            value = _VALUE.match(text, m.end())
            if value:
                end = value.end()
                yield value.span()


def _blocks(text: str):
    """Spans from each BEGIN line of a private key to the next END line."""
    ends = [m.span() for m in _END.finditer(text)]
    at, last = 0, 0
    for m in _BEGIN.finditer(text):
        if m.start() < last:
            continue
        while at < len(ends) and ends[at][0] < m.end():
            at += 1
        if at == len(ends):
            return
        last = ends[at][1]
        yield m.start(), last


def candidates(text: str | None) -> list[tuple[int, int]]:
    """Spans (start, end) of candidates, apart from each other, in order; found
    in time linear in the text."""
    if not text:
        return []
    spans = [m.span() for m in _RUN.finditer(text) if _DIGIT.search(m.group())]
    if _HINT.search(text):
        spans += _assigned(text)
    if "-----BEGIN " in text:
        spans += _blocks(text)
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _class(c: str) -> int:
    """Letters without case, digits by one class, the rest by another."""
    c = c.lower()
    return ord(c) - 97 if "a" <= c <= "z" else 26 if c.isdigit() else 27


#: of each byte of lower-cased text its class, 28 for white space and 29 for what is not ASCII
_CLASSES = np.array([29 if i > 127 else 28 if chr(i).isspace() else _class(chr(i)) for i in range(256)], np.uint8)


def count_text(text: str, steps: np.ndarray, words: Counter) -> None:
    """Add a text's character transitions, within what white space separates and
    among ASCII alone, to ``steps`` (28, 28), and its words to ``words``."""
    low = text.lower()
    k = _CLASSES[np.frombuffer(" ".join(low.split()).encode("utf-8", "surrogatepass"), np.uint8)]
    k = k[k < 29].astype(np.int64)
    steps += np.bincount(k[:-1] * 29 + k[1:], minlength=29 * 29).reshape(29, 29)[:28, :28]
    words.update(_WORD.findall(low))


class Reference:
    """What ordinary text looks like: log-probabilities of character transitions
    and the dictionary, the words of three letters or more, in any script and of any
    length, that are seen twice and make up 1 in SHARE of all words or more."""

    def __init__(self, texts: list[str]):
        steps, words = np.zeros((28, 28), np.int64), Counter()
        for t in texts:
            count_text(t, steps, words)
        self._keep(steps, [w for w, n in words.items() if n > 1 and n * SHARE >= words.total()])

    @classmethod
    def over(cls, texts: DataFrame) -> Reference:
        """As of the list of all texts of ``texts`` (text): tasks add up their own
        transitions and words, Spark the tasks'; the driver gets the sums of the
        transitions and the dictionary, which SHARE bounds whatever the texts."""

        def partial(batches):
            steps, words, total = np.zeros((28, 28), np.int64), Counter(), 0

            def flush():
                nonlocal total
                total += words.total()
                return pd.DataFrame({"word": pd.Series(list(words), dtype=object), "n": np.fromiter(words.values(), np.int64, len(words))})

            for b in batches:
                for t in b["text"]:
                    count_text(t, steps, words)
                if len(words) >= FLUSH_WORDS:
                    yield flush()
                    words.clear()
            yield flush()
            words.clear()
            at = np.flatnonzero(steps)
            # transitions are named by digits, which no word has, and the sum of all words by none
            yield pd.DataFrame({"word": pd.Series(["", *map(str, at)], dtype=object), "n": np.append(total, steps.ravel()[at])})
            give_back_memory()

        sums = cut(texts.mapInPandas(partial, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1 OR word < 'a'"))
        steps, total = np.zeros(28 * 28, np.int64), 0
        for row in sums.where("word < 'a'").collect():
            if row["word"]:
                steps[int(row["word"])] = row["n"]
            else:
                total = row["n"]
        words = [r["word"] for r in sums.where((F.col("word") >= "a") & (F.col("n") * SHARE >= total)).select("word").collect()]
        out = cls.__new__(cls)
        out._keep(steps.reshape(28, 28), words)
        return out

    def _keep(self, steps: np.ndarray, words: list[str]) -> None:
        counts = steps + 0.5
        self.log = np.log(counts / counts.sum(axis=1, keepdims=True))
        self.words = frozenset(words)
        sizes: dict[str, set[int]] = {}
        for w in words:
            sizes.setdefault(w[:3], set()).add(len(w))
        self.sizes = {head: sorted(found, reverse=True) for head, found in sizes.items()}

    def coverage(self, s: str) -> float:
        """The share of characters that dictionary words cover, taken greedily."""
        s, at, covered = s.lower(), 0, 0
        while at < len(s):
            size = next((k for k in self.sizes.get(s[at : at + 3], ()) if k <= len(s) - at and s[at : at + k] in self.words), 0)
            covered += size
            at += size or 1
        return covered / max(len(s), 1)


class Neighbours:
    """Log-odds that a word before or after a candidate goes with a secret,
    learned from labelled findings and smoothed towards none."""

    def __init__(self, findings: pd.DataFrame, weight: float = 4.0):
        label = findings["label"].to_numpy().astype(int)
        prior = (label.sum() + 1) / (len(label) + 2)
        self.odds: list[dict[str, float]] = []
        for words in (self.before, self.after):
            seen: dict[str, list[int]] = {}
            for text, y in zip(findings["before" if words == self.before else "after"], label.tolist(), strict=True):
                for w in set(words(text)):
                    seen.setdefault(w, [0, 0])[y] += 1
            self.odds.append({w: float(np.log((n[1] + weight * prior) / (n[0] + weight * (1 - prior)) * (1 - prior) / prior)) for w, n in seen.items()})

    @staticmethod
    def before(text: str | None) -> list[str]:
        return re.findall(r"[a-z_]{2,}", (text or "").lower())[-3:]

    @staticmethod
    def after(text: str | None) -> list[str]:
        return re.findall(r"[a-z_]{2,}", (text or "").lower())[:3]

    def of(self, before: str, after: str) -> list[float]:
        return [sum(odds.get(w, 0.0) for w in words) for odds, words in zip(self.odds, (self.before(before), self.after(after)), strict=True)]


def _known(candidate: str) -> bool:
    """Whether a candidate starts as keys of known kinds do."""
    return bool(_PREFIX.match(candidate)) or candidate.startswith("-----BEGIN")


def features(before: str, candidate: str, after: str, path: str | None, reference: Reference, neighbours: Neighbours) -> list[float]:
    """The forest's features of a candidate, all of which is read."""
    n = len(candidate)
    low = np.frombuffer(candidate.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = np.where(low < 128, _CLASSES[np.minimum(low, 127)], 29).astype(np.int64)
    kinds = np.where(kinds > 27, 27, kinds)
    steps = reference.log[kinds[:-1], kinds[1:]]
    share = np.unique(np.frombuffer(candidate.encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)[1] / n
    return [
        n,
        float(steps.mean()) if len(steps) else 0.0,
        float(-(share * np.log2(share)).sum()),
        float((kinds == 26).mean()),
        float(((kinds[:-1] < 26) != (kinds[1:] < 26)).sum()) / max(n - 1, 1),
        reference.coverage(candidate),
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", candidate))),
        float(_known(candidate)),
        float(bool(_GIVEN.search(before))),
        float(bool(_HINT.search(before))),
        float(bool(_BENIGN.search(before))),
        float(bool(re.search(r"(?i)test|example|mock|doc|sample|fixture", path or ""))),
        len(share) / n,
        max((len(w) for w in re.findall(r"[A-Za-z]+", candidate)), default=0),
        *neighbours.of(before, after),
    ]


class RandomForest:
    """Trees on bootstrap samples, each split the best of a few drawn features'
    quantile cuts by Gini impurity; trees are arrays (feature, cut, left, right, share)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7):
        rng = np.random.default_rng(seed)
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        codes = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
        tries = max(1, math.isqrt(x.shape[1]))
        self.trees = []
        for _ in range(trees):
            nodes: list[list[float]] = []
            rows = rng.integers(0, len(x), len(x))

            def grow(rows, level, nodes=nodes):
                me = len(nodes)
                p = float(y[rows].mean())
                nodes.append([-1, 0.0, 0, 0, p])
                if level == 0 or len(rows) < 2 * LEAST_ROWS or p in (0.0, 1.0):
                    return me
                best = (p * (1 - p) * len(rows) - 1e-9, -1, 0)
                for f in rng.choice(x.shape[1], tries, replace=False):
                    if not len(cuts[f]):
                        continue
                    n = np.bincount(codes[rows, f], minlength=len(cuts[f]) + 1).cumsum()[:-1]
                    t = np.bincount(codes[rows, f], y[rows], len(cuts[f]) + 1).cumsum()[:-1]
                    m, u = len(rows) - n, y[rows].sum() - t
                    ok = (n >= LEAST_ROWS) & (m >= LEAST_ROWS)
                    if ok.any():
                        with np.errstate(all="ignore"):
                            gini = np.where(ok, t * (1 - t / n) + u * (1 - u / m), np.inf)
                        k = int(gini.argmin())
                        if gini[k] < best[0]:
                            best = (float(gini[k]), int(f), k)
                if best[1] >= 0:
                    _, f, k = best
                    low = codes[rows, f] <= k
                    nodes[me][:2] = [f, float(cuts[f][k])]
                    nodes[me][2] = grow(rows[low], level - 1)
                    nodes[me][3] = grow(rows[~low], level - 1)
                return me

            grow(rows, depth)
            self.trees.append(np.array(nodes))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = tree[at, 0].astype(np.int64)
                inner = f >= 0
                if not inner.any():
                    break
                low = x[np.arange(len(x)), np.maximum(f, 0)] <= tree[at, 1]
                at = np.where(inner, np.where(low, tree[at, 2], tree[at, 3]).astype(np.int64), at)
            total += tree[at, 4]
        return total / max(len(self.trees), 1)


def drawn_findings(words: list[str], n: int = DRAWN_FINDINGS, seed: int = 3) -> pd.DataFrame:
    """Labelled findings of known forms: secrets in the places where they leak,
    and digests, identifiers, numbers and names where those are usual."""
    rng = np.random.default_rng(seed)
    letters, lower, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"
    draw = lambda chars, k: "".join(rng.choice(list(chars), k))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    words = words or ["value", "north", "table", "river", "window"]
    rows = []
    for _ in range(n):
        label = int(rng.random() < 0.5)
        lead = " ".join(pick(words) for _ in range(int(rng.integers(0, 6))))
        if label:
            name = pick(["token", "api_key", "secret", "password", "AUTH_TOKEN", "client_secret", "access_key", "credentials"])
            value = pick([draw(hexa, pick([32, 40, 64])), draw(letters, int(rng.integers(20, 48))), "AKIA" + draw(letters[:26] + "0123456789", 16), "ghp_" + draw(letters, 36), "sk-" + draw(letters, 40), "xoxb-" + draw("0123456789", 11) + "-" + draw(letters, 24)])
            before = f"{lead} {name}{pick([' = ', '=', ': ', ' := '])}{pick(['', '\"', chr(39)])}" if rng.random() < 0.85 or not _PREFIX.match(value) else f"{lead} "
            path = pick(["src/app.py", "config/prod.yml", "deploy/env", "src0", "src7", ""])
            tail = pick(["", "expires ", "keep private ", "rotate "])
        else:
            kind = int(rng.integers(7))
            value = [draw(hexa, pick([32, 40, 64])), "-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)), draw("0123456789", int(rng.integers(16, 20))), "_".join(pick(words) for _ in range(4)) + str(int(rng.integers(100))), "".join(pick(words).title() for _ in range(4)) + str(int(rng.integers(10))), "/".join(pick(words) for _ in range(5)) + str(int(rng.integers(1000))), pick(["your", "example", "dummy", "changeme"]) + "-" + "x" * int(rng.integers(8, 20)) + "0"][kind]
            tag = [pick(["sha256:", "commit ", "md5 ", "checksum: ", "digest = "]), pick(["uuid ", "id: ", "etag: "]), pick(["order ", "phone ", "serial ", ""]), "", "", pick(["https://site.example/", "src=", "path "]), pick(["token = ", "api_key: "])][kind]
            before = f"{lead} {tag}"
            path = pick(["src/app.py", "docs/readme.md", "tests/test_a.py", "src0", "src7", ""])
            tail = pick(["", "verified ", "was merged ", "shipped "])
        rows.append((before[-REACH:], value, f"{pick([' ', chr(34), chr(10)])}{tail}{pick(words)} {pick(words)}"[:AHEAD], path, label))
    return pd.DataFrame(rows, columns=["before", "candidate", "after", "path", "label"])


def train(docs: DataFrame, findings: DataFrame | None = None, text_col: str = "text"):
    """(reference, neighbours, forest): the reference from all texts of ``docs``,
    the others from labelled findings (before, candidate, after, path, label) or,
    without any, from drawn ones. Null texts count as none; findings without a
    candidate or label are left out."""
    reference = Reference.over(docs.select(F.col(text_col).alias("text")).where("text IS NOT NULL"))
    rows = drawn_findings(sorted(reference.words))
    if findings is not None:
        given = findings.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("before", "candidate", "after", "path")), F.col("label").cast("int").alias("label")).where("candidate <> '' AND label IN (0, 1)")
        given = given.orderBy(F.xxhash64("before", "candidate", "after", "path")).limit(FINDINGS).toPandas()
        rows = given if len(given) else rows
    x = np.zeros((len(rows), len(FEATURE_NAMES)))
    fold = np.arange(len(rows)) % 2
    for k in (0, 1):  # a row's neighbouring words are weighed by what the other half says of them
        other = Neighbours(rows[fold != k])
        for i in np.flatnonzero(fold == k).tolist():
            r = rows.iloc[i]
            x[i] = features(r["before"][-REACH:], r["candidate"], r["after"][:AHEAD], r["path"], reference, other)
    return reference, Neighbours(rows), RandomForest(x, rows["label"].to_numpy().astype(float))


def _judge(texts, paths, trained) -> list[list[tuple[int, int, float]]]:
    """For each text its candidates with their scores."""
    reference, neighbours, forest = trained
    spans = [candidates(t) for t in texts]
    x = [features(t[max(0, a - REACH) : a], t[a:b], t[b : b + AHEAD], p, reference, neighbours) for t, p, s in zip(texts, paths, spans, strict=True) for a, b in s]
    scores = iter(forest.predict(np.array(x)) if x else [])
    return [[(a, b, float(next(scores))) for a, b in s] for s in spans]


def scan(docs: DataFrame, trained, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(id, start int, end int, candidate string, score double, secret boolean):
    one row a candidate of every whole text, in code points; ``secret`` where the
    forest's share of votes is THRESHOLD or more. Null and empty texts have none,
    repeated rows have theirs each. No row moves."""
    @F.pandas_udf("array<struct<start:int,end:int,candidate:string,score:double>>")
    def run(texts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([[(a, b, t[a:b], s) for a, b, s in found] for t, found in zip(texts, _judge(texts, paths, trained), strict=True)])

    found = docs.select(F.col(id_col).alias("id"), F.explode(run(F.col(text_col), F.col(path_col).cast("string"))).alias("f"))
    return found.select("id", "f.*").withColumn("secret", F.col("score") >= THRESHOLD)


def redact(docs: DataFrame, trained, text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``docs`` with every secret in the text replaced by MASK. No row is lost or
    moved; null and empty texts stay as they are, rows that repeat are masked each."""
    @F.pandas_udf("string")
    def run(texts: pd.Series, paths: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(texts, _judge(texts, paths, trained), strict=True):
            for a, b, s in reversed(found):
                if s >= THRESHOLD:
                    t = t[:a] + MASK + t[b:]
            out.append(t)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, run(F.col(text_col), F.col(path_col).cast("string")))

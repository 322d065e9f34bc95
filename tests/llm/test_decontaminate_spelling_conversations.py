"""Decontamination, spelling variants and conversation repair against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from voxloom.llm import conversations, decontaminate, spelling
from voxloom.llm import queries as llm

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, id string, key string, row string, spans string, items string, n bigint, word string"
ITEM = "item_id bigint, text string, item string"


def docs(spark, texts, ids=None):
    """Documents with further columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "i", "k", "r", "s", "x", 1, "w") for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOC)


def items(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x") for i, t in zip(ids or range(len(texts)), texts, strict=True)], ITEM)


# decontamination


def plain_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def plain_contamination(texts, tests, window=10):
    wanted = {}
    for item, text in tests:
        w = plain_words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wanted.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for text in texts:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(k) for k in wanted}:
            for i in range(len(w) - n + 1):
                got = wanted.get(tuple(w[i : i + n]))
                if got:
                    hit |= set(range(i, i + n))
                    found |= got
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdé9") for _ in range(rng.randint(1, 3))) for _ in range(12)]
    tests = [" ".join(rng.choices(words, k=rng.choice([1, 3, 9, 10, 11, 25, 60]))) for _ in range(25)] + [None, "", "?! .", "Aa", "Aa"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 200))) for _ in range(40)]
    for k in range(20):  # passages of items, whole or in part, with other case and marks between
        w = (tests[k] or "").split()
        a = rng.randint(0, max(0, len(w) - 10))
        texts.append("x, " + "; ".join(w[a:]).upper().replace("É", "é") + " y")
    texts += [texts[50]] * 5 + [None, "", " \n", "Aa", "aa bb", "aa " * 3000]
    return texts, tests


def rows_of(frame):
    return sorted(((r["id"] is None, r["id"] or 0, r["n_words"], r["n_hit"], list(r["items"])) for r in frame.collect()), key=str)


@pytest.mark.parametrize("shard", [40, 1 << 20])
def test_contamination_equals_every_window_tried(spark, corpus, monkeypatch, shard):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)  # 40: texts of 3,000 words come in slices
    texts, tests = corpus
    ids = [7, 7, None, None, *range(10, 6 + len(texts))]
    tested = list(zip([None, None, 3, 3, *range(20, 16 + len(tests))], tests, strict=True))
    got = decontaminate.contamination(docs(spark, texts, ids), items(spark, tests, [i for i, _ in tested]))
    want = plain_contamination(texts, tested)
    assert rows_of(got) == sorted(((i is None, i or 0, n, h, f) for i, (n, h, f) in zip(ids, want, strict=True)), key=str)
    for r in got.collect():
        spans = [(s["start"], s["end"]) for s in r["spans"]]
        assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_contamination_by_blocks_of_items(spark, corpus, monkeypatch):
    texts, tests = corpus
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 20)
    got = decontaminate.contamination(docs(spark, texts), items(spark, tests))
    want = plain_contamination(texts, list(enumerate(tests)))
    assert rows_of(got) == sorted(((False, i, n, h, f) for i, (n, h, f) in enumerate(want)), key=str)


def test_contamination_of_nothing(spark, corpus):
    texts, tests = corpus
    assert decontaminate.contamination(docs(spark, []), items(spark, tests)).count() == 0
    assert [r["n_hit"] for r in decontaminate.contamination(docs(spark, texts[:5]), items(spark, [])).collect()] == [0] * 5


def test_remove_contaminated(spark, corpus):
    texts, tests = corpus
    want = [t for t, (_, h, _) in zip(texts, plain_contamination(texts, list(enumerate(tests))), strict=True) if not h]
    left = decontaminate.remove_contaminated(docs(spark, texts, [1] * len(texts)), items(spark, tests))
    assert left.columns == docs(spark, []).columns and sorted(str(r["text"]) for r in left.collect()) == sorted(map(str, want))


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 4, 500).astype(np.int32)
    text[-1] = 0
    for depth in (1, 2, 7, 40):
        array = decontaminate.suffix_array(text, depth, 3)
        assert sorted(array.tolist()) == np.flatnonzero(text).tolist()
        keys = [tuple(text[i : i + depth].tolist()) for i in array.tolist()]
        assert keys == sorted(keys)


def test_longest_matches_equal_every_start_tried(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 60))) for _ in range(30)] + [None]
    tests = [" ".join(rng.choices("abc", k=20)) for _ in range(6)]
    got = {(r["item"], r["item_start"]): (r["n_words"], r["n_places"], r["id"], r["start"]) for r in decontaminate.longest_matches(docs(spark, texts), items(spark, tests), least=6).collect()}
    want = {}
    for k, t in enumerate(tests):
        w = t.split()
        for i in range(len(w)):
            for n in range(len(w) - i, 5, -1):
                at = [(d, j) for d, x in enumerate(texts) for j in range(len(plain_words(x)) - n + 1) if plain_words(x)[j : j + n] == w[i : i + n]]
                if at:
                    want[str(k), i] = (n, len(at), *min(at))
                    break
    assert got == want


# spelling


def plain_variants(counts, least, times):
    words = {w: n for w, n in counts.items() if n >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, n_near = {}, {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        n_near[w] = len(others)
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, str(form[w]), root(w), n, n_near[w], words[form[w]] if form[w] else -1) for w, n in words.items())


def variant_rows(frame):
    return sorted((r["word"], str(r["form"]), r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in frame.collect())


@pytest.mark.parametrize("block", [2, 1 << 13])
def test_variants_equal_all_pairs(spark, block):
    rng = random.Random(block)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 9))) for _ in range(250)} | {"b" * 40, "b" * 41, "a" * 300}
    counts = {w: rng.choice([1, 4, 5, 5, 25, 125, 3000]) for w in words}
    table = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert variant_rows(spelling.variants(table, block_words=block)) == plain_variants(counts, 5, 5)


def test_words_of_texts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SLICE_CHARS", 50)
    rng = random.Random(1)
    words = ["Straßen", "straßen", "STRASSE", "Éclairs", "éclairs", "abcdef×", "kurz", "abcdefg", "abcdefh"]
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(60)] + [None, "", "123", "ħħħħħħħħ", "x" * 5000]
    ids = [None, 5, 5, *range(100, 97 + len(texts))]
    want = Counter()
    for i, t in zip(ids, texts, strict=True):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run
            if len(run) >= 6:
                want[run] += 1
    assert {r["word"]: r["n"] for r in spelling.word_counts(docs(spark, texts, ids)).collect()} == want
    assert variant_rows(spelling.spelling_variants(docs(spark, texts, ids))) == plain_variants(want, 5, 5)
    assert spelling.spelling_variants(docs(spark, [])).count() == 0


# conversations

CONV = "conv_id bigint, turn bigint, role string, text string, conv string, sig string, n bigint"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def plain_report(original, rows):
    """By the cheapest path over (rows done, grammar state), each with its least edit
    string, in order of cost and string."""
    out = {}
    for conv in {r[0] for r in original}:
        mine = [r for r in rows if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, seen = [], set()
        for _, _, role, text in mine:
            bare = text.rstrip("\t\n\x0b\x0c\r ")
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
        todo, final = [(0, "", (0, 0), ())], None
        done = set()
        while todo:
            todo.sort(reverse=True)
            cost, audit, (i, q), text = todo.pop()
            if (i, q) in done:
                continue
            done.add((i, q))
            if i == len(mine) and q in (0, 3):
                # of equal cost another end may have a lesser string
                if final is None or (cost, audit) < final[:2]:
                    final = (cost, audit, text)
            for put in "ua":
                if put in step[q]:
                    todo.append((cost + 2, audit + "I", (i, step[q][put]), (*text, {"u": "user:", "a": "assistant:"}[put])))
            if i < len(mine):
                role, body = mine[i][2:]
                todo.append((cost + 3, audit + "D", (i + 1, q), text))
                if faults[i] not in ("b", "d"):
                    more = faults[i] == "t"
                    if role[:1] in step[q]:
                        todo.append((cost + more, audit + "K", (i + 1, step[q][role[:1]]), (*text, f"{role}:{body}")))
                    for put in "ua":
                        if put in step[q]:
                            todo.append((cost + more + 2, audit + "R", (i + 1, step[q][put]), (*text, {"u": "user:", "a": "assistant:"}[put] + body)))
        cost, audit, text = final
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(4)
    rows = []
    for conv in range(150):
        n = rng.choice([1, 2, 3, 5, 8, 13])
        turns = rng.sample(range(n + 3), n)
        for k in range(n):
            turn = turns[k] if rng.random() < 0.9 else None
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "admin"])
            text = rng.choice(["Yes.", "No!", "Why?", "and then", "", " \n", None, "é. \t", "Long " * 9 + "end."])
            rows.append((conv, turn, role, text))
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Yes."), (500, None, None, None), (501, 0, "user", "x" * 50_000)]
    rows += [(502, k % 700, "user" if k % 2 == 0 else "assistant", f"{k % 300}.") for k in range(1500)]
    return rows + rows[:40]


def given(spark, rows):
    return spark.createDataFrame([(*r, "c", "s", 1) for r in rows], CONV)


def test_damage(spark, talks):
    got = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in conversations.damage(given(spark, talks)).where("NOT dropped").collect()]
    assert sorted(got, key=str) == sorted(plain_damage(talks), key=str)


def test_report_equals_shortest_paths(spark, talks):
    damaged = conversations.damage(given(spark, talks))
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.report(damaged).collect()}
    want = plain_report(talks, plain_damage(talks))
    assert got == want
    assert len({r[5] for r in want.values()}) > 10
    text: dict = {}
    for r in sorted(conversations.repaired(damaged).collect(), key=lambda r: r["place"]):
        text.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(text.get(c, [])).encode()).hexdigest() for c in want} == {c: r[-1] for c, r in want.items()}


def test_report_of_undamaged_rows_and_of_none(spark):
    fine = given(spark, [(1, 1, "user", "A?"), (1, 2, "assistant", "B."), (2, 1, "system", "S."), (2, 5, "user", "U"), (2, None, "assistant", "A.")])
    got = {r["conv_id"]: tuple(r)[1:8] for r in conversations.report(fine).collect()}
    # by turn: the reply without one, the system's, the user's, which ends too soon
    assert got == {1: (0, 0, 0, 0, 0, 0, "KK"), 2: (3, 0, 0, 1, 1, 6, "DKKI")}
    assert conversations.report(given(spark, [])).count() == 0


def test_nodes_are_shared():
    dawg = conversations.Dawg()
    rng = random.Random(2)
    for _ in range(300):
        node = dawg.end
        for _ in range(30):
            node, _ = dawg.step(node, rng.choice("suaoSUAOx"))
    assert len(dawg.nodes) < 300


@pytest.mark.parametrize("name", ["op11_decontaminate"])
def test_query_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    got = llm.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(c.sql(f"SELECT {', '.join(columns)} FROM ({llm.SQL[name]})").fetchall())


def test_registered_queries_equal_brute_force(spark):
    documents = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = Counter()
    for i, t in documents:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            word = spelling.damaged(i, run)
            if len(word) >= 6:
                want[word] += 1
    assert variant_rows(llm.QUERIES["op12_spelling"](spark, SF)) == plain_variants(want, 5, 5)
    talks = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in llm.QUERIES["op13_conversations"](spark, SF).collect()}
    assert got == plain_report(talks, plain_damage(talks))

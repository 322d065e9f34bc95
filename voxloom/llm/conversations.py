"""Repair of conversations over a suffix-shared DAWG.

A conversation's rows are a signature, a letter for the role and the fault of each.
Signatures are told apart once over all conversations and sorted by their ends, so
that a task that walks them in order makes each distinct ending once. Endings are
nodes of an automaton read from the end, minimised as it grows: endings from which
every grammar state costs the same, up to a constant, and is repaired by edits in
the same order are one node. A node has, for each grammar state, the cost to go and
the first edit of the best repair; a conversation's repair is read off its nodes.

The grammar of role initials is ``(s?(ua)+)?``: state 0 is the beginning, 1 after s,
2 after u, 3 after a; 0 and 3 may end.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import broadcast_if_small, cut, give_back_memory, join_hot, shuffle_partitions

WHITE = "\t\n\x0b\x0c\r "
#: letters of a signature: role initial s, u, a or another by fault (none, truncated, blank, duplicate)
LETTERS = {"": "suao", "t": "SUAO", "b": "1234", "d": "5678"}
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})  # by grammar state
PUT = ("u", "u", "a", "u")  # the role that an edit may put there
ROLES = {"s": "system", "u": "user", "a": "assistant"}
ENDS = (0, 3)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
DUPLICATES = 100_000  # duplicate groups of texts that are broadcast, at most


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped) of a table of conversations after the
    damage that a checksum of ``conv_id:turn`` names: the row goes (it stays here
    as ``dropped``), its text is emptied, loses ``[.!?]``, the row is repeated, or its
    role becomes user. Nulls of role and text, and in the key, are one space."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    h = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.when(h == 4, "user").otherwise(role).alias("role"),
        F.when(h == 1, "").when(h == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (h == 0).alias("dropped"),
        F.explode(F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


class Dawg:
    """Nodes (classes of endings) and their edits, made as they are asked for.

    ``nodes[k]`` is, for each grammar state, (cost to go less the node's least, edit,
    state after it); ``order[k]`` ranks the states' best edit strings.
    """

    def __init__(self):
        self.nodes: list[tuple] = []
        self.order: list[tuple] = []
        self.known: dict[tuple, int] = {}
        self.steps: dict[tuple[int, str], tuple[int, int]] = {}
        # nothing is left: insert up to an end
        self.end = self._node([(0, "", 0), (4, "I", 2), (2, "I", 3), (0, "", 3)], None)[0]

    def _node(self, states: list[tuple], after: int | None) -> tuple[int, int]:
        def text(q):
            """What the state's edit string is compared by."""
            _, edit, to = states[q]
            return (edit, *text(to)) if edit == "I" else (edit, self.order[after][to] if after is not None else 0)

        texts = [text(q) for q in range(4)]
        ranks = {t: k for k, t in enumerate(sorted(set(texts)))}
        least = min(s[0] for s in states)
        key = (tuple((c - least, e, to) for c, e, to in states), tuple(ranks[t] for t in texts))
        if key not in self.known:
            self.known[key] = len(self.nodes)
            self.nodes.append(key[0])
            self.order.append(key[1])
        return self.known[key], least

    def step(self, node: int, letter: str) -> tuple[int, int]:
        """(node of the ending with ``letter`` before it, what its least cost is more)."""
        if (node, letter) not in self.steps:
            self.steps[node, letter] = self._made(node, letter)
        return self.steps[node, letter]

    def _made(self, node: int, letter: str) -> tuple[int, int]:
        cost, rank = [s[0] for s in self.nodes[node]], self.order[node]
        states = []
        for q in range(4):
            options = [(DELETE + cost[q], "D", rank[q], q)]
            if letter != "x":
                more = TRUNCATED * letter.isupper()
                to = NEXT[q].get(letter.lower())
                if to is not None:
                    options.append((more + cost[to], "K", rank[to], to))
                to = NEXT[q][PUT[q]]
                options.append((REROLE + more + cost[to], "R", rank[to], to))
            c, edit, _, to = min(options)
            states.append((c, edit, to))
        # an inserted row stands before the letter; costs fall along it, so there are no rings
        for _ in range(3):
            states = [min(states[q], (INSERT + states[NEXT[q][PUT[q]]][0], "I", NEXT[q][PUT[q]]), key=lambda s: s[:2]) for q in range(4)]
        return self._node(states, node)

    def audit(self, path: list[int]) -> str:
        """The edits of the ending whose nodes, from the end on, are ``path``."""
        out, at, q = [], len(path) - 1, 0
        while True:
            _, edit, to = self.nodes[path[at]][q]
            if not edit:
                return "".join(out)
            out.append(edit)
            at, q = at - (edit != "I"), to


def plans(signatures: DataFrame) -> DataFrame:
    """(sig, cost bigint, audit) of a column ``sig`` of distinct signatures over
    s, u, a, o (another), their capitals (truncated) and x (must go)."""
    ending = F.reverse("sig")
    # ranges are found by a piece of the ending, so that no long one is among the sampled keys
    ranged = signatures.repartitionByRange(shuffle_partitions(signatures.sparkSession), F.left(ending, F.lit(64))).sortWithinPartitions(ending)

    def walk(batches):
        dawg, last, path, costs = Dawg(), "", None, [0]
        path = [dawg.end]
        for b in batches:
            rows = []
            for sig in b["sig"]:
                letters = sig[::-1]
                same = 0
                for x, y in zip(letters, last, strict=False):
                    if x != y:
                        break
                    same += 1
                del path[same + 1 :], costs[same + 1 :]
                for x in letters[same:]:
                    node, more = dawg.step(path[-1], x)
                    path.append(node)
                    costs.append(costs[-1] + more)
                last = letters
                rows.append((sig, costs[-1] + dawg.nodes[path[-1]][0][0], dawg.audit(path)))
            yield pd.DataFrame(rows, columns=["sig", "cost", "audit"])

    return ranged.mapInPandas(walk, "sig string, cost bigint, audit string")


def _faults(rows: DataFrame) -> DataFrame:
    """``rows`` with conv (text), digest (of role and text), letter (as if no row
    were a duplicate), twin (letter of a duplicate, null for a blank row) and late:
    whether an earlier turn of the conversation has the same role and text."""
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    body = F.rtrim(F.col("text"), F.lit(WHITE))
    letter = lambda fault: F.substring(F.lit(LETTERS[fault]), kind + 1, F.lit(1))
    keyed = rows.withColumns(
        {
            "conv": F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")),
            "digest": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256),
            "blank": body == "",
            "letter": F.when(body == "", letter("b")).when(F.substring(body, -1, 1).isin(".", "!", "?"), letter("")).otherwise(letter("t")),
            "twin": F.when(body != "", letter("d")),
        }
    )
    order = F.struct(F.col("turn").isNotNull(), "turn")
    again = keyed.where("NOT dropped AND NOT blank").groupBy("conv", "digest").agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last_one"))
    again = broadcast_if_small(cut(again.where("n > 1 AND first < last_one").select("conv", "digest", "first")), DUPLICATES)
    return keyed.join(again, ["conv", "digest"], "left").withColumn("late", F.coalesce(order > F.col("first"), F.lit(False))).drop("first", "blank")


def signatures(rows: DataFrame) -> DataFrame:
    """(conv, sig, gaps) of every conversation of ``rows`` (conv, turn, digest,
    letter, twin, late, dropped), in order of turn (nulls first), then of digest.
    Conversations are cut where ranges end, so a long one goes to many tasks."""
    order = ["conv", F.asc_nulls_first("turn"), "digest"]
    ranged = rows.select("conv", "turn", "digest", F.when(F.col("late"), F.coalesce("twin", "letter")).otherwise(F.col("letter")).alias("letter"), "twin", "dropped")
    ranged = ranged.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    names = ["conv", "pid", "k", "sig", "low", "high", "turns"]

    def walk(batches):
        pid, k, before = TaskContext.get().partitionId(), 0, None
        for b in batches:
            if not len(b):
                continue
            conv, digest, dropped = b["conv"].to_numpy(), b["digest"].to_numpy(), b["dropped"].to_numpy()
            turn = b["turn"].to_numpy()  # as text: null stays null
            same = np.zeros(len(b), bool)
            same[1:] = (conv[1:] == conv[:-1]) & (turn[1:] == turn[:-1])
            same[0] = before is not None and before[0] == conv[0] and before[1] == turn[0]
            equal = same.copy()
            equal[1:] &= digest[1:] == digest[:-1]
            equal[0] &= before is not None and before[2] == digest[0]
            letter = np.where(equal & b["twin"].notna().to_numpy(), b["twin"].to_numpy(), b["letter"].to_numpy())
            before = (conv[-1], turn[-1], digest[-1])
            starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            rows = []
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(b)], strict=True):
                stay = ~dropped[a:z]
                turns = [int(t) for t, s in zip(turn[a:z], stay, strict=True) if s and t is not None]
                rows.append((conv[a], pid, k, "".join(letter[a:z][stay]), min(turns, default=None), max(turns, default=None), len(set(turns))))
            k += 1
            out = pd.DataFrame(rows, columns=names)
            yield out.assign(low=out["low"].astype("Int64"), high=out["high"].astype("Int64"))

    parts = ranged.withColumn("turn", F.col("turn").cast("string")).mapInPandas(walk, "conv string, pid int, k int, sig string, low bigint, high bigint, turns bigint")
    whole = parts.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*names[1:]))).alias("p"))
    # a turn that goes on in the next piece counts once
    twice = "size(filter(sequence(1, size(t) - 1), i -> t[i].low = t[i - 1].high))"
    whole = whole.withColumn("t", F.expr("filter(p, x -> x.turns > 0)"))
    distinct = f"aggregate(t, 0L, (n, x) -> n + x.turns) - IF(size(t) > 1, {twice}, 0)"
    return whole.select("conv", F.expr("array_join(transform(p, x -> x.sig), '')").alias("sig"), F.expr(f"IF(size(t) = 0, 0L, element_at(t, -1).high - t[0].low + 1 - ({distinct}))").alias("gaps"))


def _edited(batches, columns):
    """(plan row, messages) of each conversation, whose plan comes before its rows:
    messages are (role, text) of the repaired conversation, one after the other."""

    def rows():
        for b in batches:
            yield from b[columns].itertuples(index=False)

    source = rows()
    row = next(source, None)
    while row is not None:
        plan = row

        def messages():
            nonlocal row
            q, row = 0, next(source, None)
            for edit in plan.audit:
                put = PUT[q]
                if edit == "I":
                    q = NEXT[q][put]
                    yield ROLES[put], ""
                    continue
                if edit == "K":
                    q = NEXT[q][row.role[:1]]
                    yield row.role, row.text
                elif edit == "R":
                    q = NEXT[q][put]
                    yield ROLES[put], row.text
                row = next(source, None)

        yield plan, messages()


def audits(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost bigint, audit) of every
    conversation of ``rows``, as ``_faults`` has them."""
    found = cut(signatures(rows))
    folded = F.translate("sig", LETTERS["b"] + LETTERS["d"], "x" * 8)
    found = found.withColumn("folded", folded)
    distinct = found.groupBy("folded").agg(F.count("*").alias("n"))
    planned = cut(plans(distinct.select(F.col("folded").alias("sig"))).join(distinct.withColumnRenamed("folded", "sig"), "sig").withColumnRenamed("sig", "folded"))
    initials = F.translate("sig", "".join(LETTERS.values()), "suao" * 4)
    of_kind = lambda fault: (F.length("sig") - F.length(F.translate("sig", LETTERS[fault], ""))).cast("bigint")
    out = join_hot(found, planned, "folded", "n", found.count())
    return out.select(
        "conv",
        F.col("gaps").cast("bigint").alias("gaps"),
        of_kind("b").alias("blank"),
        of_kind("d").alias("duplicate"),
        of_kind("t").alias("truncated"),
        (F.greatest(F.length("sig") - 1, F.lit(0)) - F.regexp_count(initials, F.lit("(?=su|ua|au)"))).cast("bigint").alias("illegal"),
        "cost",
        "audit",
    )


_PLAN = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _repair(rows: DataFrame, run, schema: str) -> DataFrame:
    """Apply ``run`` to plans and rows in order, a conversation in one task, as it has
    to be for a hash of all its text; rows are read one by one and none is kept."""
    faults = _faults(rows)
    made = cut(audits(faults))
    head = made.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("digest"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *(F.col(c).cast("string").alias(c) for c in _PLAN), "audit")
    body = faults.where("NOT dropped").select("conv", F.lit(1).alias("kind"), "turn", "digest", "role", "text", *(F.lit(None).cast("string").alias(c) for c in _PLAN), F.lit(None).cast("string").alias("audit"))
    together = head.unionByName(body).repartition(shuffle_partitions(rows.sparkSession), "conv").sortWithinPartitions("conv", "kind", F.asc_nulls_first("turn"), "digest")
    return together.select("conv", "role", "text", *_PLAN, "audit").mapInPandas(run, schema)


def _id(conv: str):
    return None if conv == " " else int(conv)


def report(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost bigint, audit,
    repaired_sha256 string) of every conversation of ``rows`` (conv_id, turn, role,
    text, dropped: the row is not there, but its conversation is; further columns
    are ignored).

    Rows go by turn, nulls first, those of one turn by a hash of role and text. The
    first fault of a row counts: blank, duplicate of an earlier row, or truncated.
    The audit has the cheapest edits that make the role initials ``(s?(ua)+)?``:
    K(eep), R(erole, 2), D(elete, 3; blank and duplicate rows must), I(nsert, 2); a
    truncated row that stays adds 1; of equal cost the least string. Null role and
    text count as one space, conversations without an id are one, without rows
    have zeros, and no rows give none.
    """
    names = ["conv_id", *_PLAN, "audit", "repaired_sha256"]
    given = ["conv", "role", "text", *_PLAN, "audit"]

    def run(batches):
        out = []
        for plan, messages in _edited(batches, given):
            h, between = hashlib.sha256(), b""
            for role, text in messages:
                h.update(between + f"{role}:".encode("utf-8", "surrogatepass"))
                h.update(text.encode("utf-8", "surrogatepass"))
                between = b"\n"
            out.append((_id(plan.conv), *(int(getattr(plan, c)) for c in _PLAN), plan.audit, h.hexdigest()))
            if len(out) >= 10_000:
                yield frame(out)
                out = []
        if out:
            yield frame(out)
        give_back_memory()

    def frame(out):
        b = pd.DataFrame(out, columns=names)
        return b.assign(conv_id=pd.array([r[0] for r in out], dtype="Int64"))

    return _repair(_filled(rows), run, f"conv_id bigint, {', '.join(f'{c} bigint' for c in _PLAN)}, audit string, repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place bigint, role, text) of the repaired conversations, by the edits
    of ``report``; one that is left without rows has none here."""
    given = ["conv", "role", "text", *_PLAN, "audit"]

    def run(batches):
        out = []
        for plan, messages in _edited(batches, given):
            for place, (role, text) in enumerate(messages):
                out.append((_id(plan.conv), place, role, text))
                if len(out) >= 10_000:
                    yield frame(out)
                    out = []
        if out:
            yield frame(out)

    def frame(out):
        b = pd.DataFrame(out, columns=["conv_id", "place", "role", "text"])
        return b.assign(conv_id=pd.array([r[0] for r in out], dtype="Int64"))

    return _repair(_filled(rows), run, "conv_id bigint, place bigint, role string, text string")


def _filled(rows: DataFrame) -> DataFrame:
    dropped = F.coalesce("dropped", F.lit(False)) if "dropped" in rows.columns else F.lit(False)
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), dropped.alias("dropped"))

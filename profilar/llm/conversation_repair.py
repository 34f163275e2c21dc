"""Cheapest repairs of conversations' role structure, on a suffix-shared automaton.

A conversation is its rows by turn (NULLs first; ties by role, then text, so equal rows are neighbours). Each row has a fault
or none: ``blank`` (no character but white space), ``duplicate`` (role and text of an earlier row), ``truncated`` (the last
character beside white space is none of ``.!?``); the first of these counts. Edits of a row: Keep (0), Rerole to user or
assistant (1), Delete (2; the only one for blank and duplicate rows); anywhere: Insert an empty user or assistant row (5).
A truncated row that stays adds 5. The repaired roles' initials must read ``(s?(ua)+)?``.

All that decides the edits is a conversation's signature: a letter per row for its role and fault. Different signatures,
sorted from their ends, form an automaton whose nodes are the signatures' different suffixes. Walking the signatures in that
order keeps the nodes of the current path; a signature adds only the nodes beyond what it shares with the previous one. Each
node gets, once for each state of the grammar, its cost-to-go and the first edit of its best audit suffix, which links to the
state and node of the rest. In one state an edit's initial fixes the state that follows, so of equal costs the least initial
leads to the least audit. Ranges of that order go to different tasks; a node on the border of two ranges is made in both.

A conversation's rows pass through one task each as a sorted stream (spilled by Spark) with bounded memory beside its
signature and audit, of one letter per row: the digest of a conversation is sequential. NULL keys form one conversation; NULL
roles and texts are read as one space. A conversation without rows (all ``where`` flags false) has an empty audit of cost
zero. Repeated rows are duplicates. Roles other than user, assistant and system initials can be reroled or deleted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from profilar.session import save_and_reload

WHITE = " \t\n\x0b\f\r"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Grammar states: nothing yet, after a system, user, assistant row. What each takes next besides a first system row.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
INITIAL = {"u": USER, "a": ASSISTANT, "s": SYSTEM}
#: Adjacent initials that are in order.
LEGAL = frozenset(("su", "ua", "au"))
#: The end of every signature: cost-to-go, edit and next state for each grammar state.
Node = tuple[tuple[int, ...], str, tuple[int, ...]]
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
LONG_MAX = (1 << 63) - 1


def taken(state: int, letter: str) -> int | None:
    """The state after keeping a row of that role letter, if the grammar allows it."""
    role = INITIAL.get(letter.lower())
    return role if role == NEXT[state] or (state == START and role == SYSTEM) else None


def with_inserts(choices: list[tuple[int, str, int]]) -> Node:
    """A node from each state's best choice among edits of its row; an insert moves on to another state of the same node.

    Two inserts in a row would lead from user or assistant back to the same state, so one is enough between these two.
    """
    user, assistant = choices[USER], choices[ASSISTANT]
    best = list(choices)
    best[USER] = min(user, (INSERT + assistant[0], "I", ASSISTANT))
    best[ASSISTANT] = min(assistant, (INSERT + user[0], "I", USER))
    for state in (START, SYSTEM):
        best[state] = min(choices[state], (INSERT + best[USER][0], "I", USER))
    return tuple(b[0] for b in best), "".join(b[1] for b in best), tuple(b[2] for b in best)


NEVER = 1 << 60
#: ``.`` ends an audit: only an empty conversation or one that ends with an assistant row.
END = with_inserts([(0 if q in (START, ASSISTANT) else NEVER, ".", q) for q in range(4)])


def node(letter: str, rest: Node) -> Node:
    """The node of a suffix, from its first letter and the node of what follows."""
    costs = rest[0]
    choices = []
    for state in range(4):
        options = [(DELETE + costs[state], "D", state)]
        if letter != "x":
            extra = TRUNCATED if letter.isupper() else 0
            kept = taken(state, letter)
            if kept is not None:
                options.append((extra + costs[kept], "K", kept))
            options.append((REROLE + extra + costs[NEXT[state]], "R", NEXT[state]))
        choices.append(min(options))
    return with_inserts(choices)


def best_audits(signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """Signature, least cost and audit, for signatures sorted from their ends."""
    path: list[Node] = [END]  # nodes of the suffixes of the last signature, shortest first
    last = ""
    for signature in signatures:
        turned = signature[::-1]
        shared = 0
        for a, b in zip(turned, last):
            if a != b:
                break
            shared += 1
        del path[shared + 1:]
        for letter in turned[shared:]:
            path.append(node(letter, path[-1]))
        last = turned
        edits, state, depth = [], START, len(turned)
        while True:
            _, letters, states = path[depth]
            edit = letters[state]
            state = states[state]
            if edit == ".":
                break
            edits.append(edit)
            depth -= edit != "I"
        yield signature, path[-1][0][START], "".join(edits)


# -- signatures of all conversations -------------------------------------------------------------------------------------


def _ordered(rows: DataFrame, key: str, turn: str, role: str, text: str, where: Column | None) -> DataFrame:
    """Rows as ``key``, ``turn``, ``role``, ``text`` with ``gone`` where the flag is not true; one conversation in one part."""
    gone = F.lit(False) if where is None else ~F.coalesce(where, F.lit(False))
    narrow = rows.select(F.col(key).alias("key"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"),
                         F.coalesce(text, F.lit(" ")).alias("text"), gone.alias("gone"))
    return narrow.repartition("key")


def _each_conversation(batches: Iterator[pd.DataFrame], start: Callable, add: Callable, end: Callable) -> Iterator[tuple]:
    """Fold rows sorted by ``key`` (text) over batches: ``start(key)`` makes a state, ``end(state)`` a result."""
    state, current = None, None
    for batch in batches:
        for row in batch.itertuples(index=False):
            if state is None or row.key != current:
                if state is not None:
                    yield end(state)
                state, current = start(row.key), row.key
            add(state, row)
    if state is not None:
        yield end(state)


def _framed(results: Iterator[tuple], columns: list[str], rows: int = 2000, letters: int = 1 << 22) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for result in results:
        held.append(result)
        size += sum(len(x) for x in result if isinstance(x, str))
        if len(held) >= rows or size >= letters:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


class _Signature:
    """Counts and letters of one conversation, row by row in order."""

    def __init__(self, key: str | None):
        self.key, self.letters, self.initials = key, [], None
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, row) -> None:
        if row.fault is None:
            return  # a row that is gone
        if row.turn is not None:
            at = int(row.turn)
            if self.high is None or at != self.high:
                self.turns += 1
            self.low, self.high = at if self.low is None else self.low, at
        if self.initials is not None and self.initials + row.initial not in LEGAL:
            self.illegal += 1
        self.initials = row.initial
        self.blank += row.fault == "b"
        self.duplicate += row.fault == "d"
        self.truncated += row.fault == "t"
        letter = row.initial if row.initial in INITIAL else "o"
        self.letters.append("x" if row.fault in "bd" else letter.upper() if row.fault == "t" else letter)

    def result(self) -> tuple:
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        return (self.key, min(gaps, LONG_MAX), self.blank, self.duplicate, self.truncated, self.illegal, "".join(self.letters))


def signatures(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
               where: Column | None = None) -> DataFrame:
    """``key``, counts of gaps and faults, and ``signature`` of every conversation. ``where``: the rows that are there."""
    ordered = _ordered(rows, key, turn, role, text, where)
    same = Window.partitionBy("key", "role", "text", "gone").orderBy(F.asc_nulls_first("turn"))
    trimmed = F.rtrim("text", F.lit(WHITE))
    fault = (F.when(F.col("gone"), None).when(trimmed == "", "b").when(F.row_number().over(same) > 1, "d")
             .when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "t").otherwise("n"))
    judged = ordered.withColumn("fault", fault).sortWithinPartitions("key", F.asc_nulls_first("turn"), "role", "text")
    # keys and turns travel as text: numbers beside NULLs would become doubles
    narrow = judged.select(F.col("key").cast("string").alias("key"), F.col("turn").cast("string").alias("turn"), "fault",
                           F.substring("role", 1, 1).alias("initial"))
    columns = ["key", *COUNTS, "signature"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _framed(_each_conversation(batches, _Signature, _Signature.add, _Signature.result), columns)

    schema = "key string, " + ", ".join(f"{c} long" for c in COUNTS) + ", signature string"
    return narrow.mapInPandas(each, schema).withColumn("key", F.col("key").cast(dict(rows.dtypes)[key]))


def audits(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           where: Column | None = None) -> DataFrame:
    """``key``, counts, ``cost`` and ``audit`` of every conversation."""
    marked = save_and_reload(signatures(rows, key, turn, role, text, where), "signatures")
    ends = marked.groupBy("signature").agg(F.count("*").alias("n")).withColumn("turned", F.reverse("signature"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = ends.repartitionByRange(parts, "turned").sortWithinPartitions("turned").select("signature")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = best_audits(s for batch in batches for s in batch["signature"])
        yield from _framed(found, ["signature", "cost", "audit"])

    best = save_and_reload(sorted_.mapInPandas(each, "signature string, cost long, audit string"), "audits")
    return marked.join(best, "signature").select("key", *COUNTS, "cost", "audit")


# -- repaired rows -------------------------------------------------------------------------------------------------------


class _Repair:
    """Applies an audit to the rows of one conversation as they pass."""

    def __init__(self, key: str | None):
        self.key, self.audit, self.at, self.expected = key, "", 0, USER
        self.digest, self.rows = hashlib.sha256(), 0

    def _inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._out("I", ROLE_OF[self.expected], "")

    def _out(self, edit: str, role: str, text: str) -> tuple[str, str, str]:
        if not (self.rows == 0 and edit == "K" and role[:1] == "s"):
            self.expected = USER if self.expected == ASSISTANT else ASSISTANT
        self.rows += 1
        return edit, role, text

    def edited(self, row) -> Iterator[tuple[str, str, str]]:
        """Edit, role and text of what stands in the row's place."""
        yield from self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._out(edit, row.role if edit == "K" else ROLE_OF[self.expected], row.text)

    def hashed(self, edits: Iterator[tuple[str, str, str]]) -> None:
        for _, role, text in edits:
            self.digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass") if self.rows == 1
                               else f"\n{role}:{text}".encode("utf-8", "surrogatepass"))


def _with_audits(rows: DataFrame, found: DataFrame, key: str, turn: str, role: str, text: str, where: Column | None) -> DataFrame:
    """Sorted rows of every conversation behind a row that holds its audit."""
    ordered = _ordered(rows, key, turn, role, text, where).where(~F.col("gone"))
    lead = found.select("key", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit")
    both = ordered.select("key", "turn", "role", "text", F.lit(None).cast("string").alias("audit")).unionByName(lead)
    placed = both.repartition("key").sortWithinPartitions("key", F.col("audit").isNull(), F.asc_nulls_first("turn"), "role", "text")
    return placed.select(F.col("key").cast("string").alias("key"), F.col("turn").cast("string").alias("turn"), "role", "text", "audit")


def digests(rows: DataFrame, found: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            where: Column | None = None) -> DataFrame:
    """``key`` and ``repaired_sha256``: of the repaired ``role:text`` rows, joined by line ends."""
    placed = _with_audits(rows, found, key, turn, role, text, where)

    def add(state: _Repair, row) -> None:
        if row.audit is not None:
            state.audit = row.audit
        else:
            state.hashed(state.edited(row))

    def end(state: _Repair) -> tuple:
        state.hashed(state._inserts())
        return state.key, state.digest.hexdigest()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _framed(_each_conversation(batches, _Repair, add, end), ["key", "repaired_sha256"])

    out = placed.mapInPandas(each, "key string, repaired_sha256 string")
    return out.withColumn("key", F.col("key").cast(dict(rows.dtypes)[key]))


def repair(rows: DataFrame, found: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           where: Column | None = None) -> DataFrame:
    """The repaired rows: ``key``, ``place`` (from 0), ``turn`` (NULL: inserted), ``role``, ``text``, ``edit``."""
    placed = _with_audits(rows, found, key, turn, role, text, where)
    columns = ["key", "place", "turn", "role", "text", "edit"]

    def repaired(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        state = None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.audit is not None:
                    if state is not None:
                        for edit, who, what in state._inserts():
                            yield state.key, state.rows - 1, None, who, what, edit
                    state = _Repair(row.key)
                    state.audit = row.audit
                    continue
                for edit, who, what in state.edited(row):
                    yield state.key, state.rows - 1, None if edit == "I" else row.turn, who, what, edit
        if state is not None:
            for edit, who, what in state._inserts():
                yield state.key, state.rows - 1, None, who, what, edit

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _framed(repaired(batches), columns)

    out = placed.mapInPandas(each, "key string, place long, turn string, role string, text string, edit string")
    return out.withColumn("key", F.col("key").cast(dict(rows.dtypes)[key])).withColumn("turn", F.col("turn").cast("long"))

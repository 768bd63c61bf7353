"""Conversation structure repair: the cheapest edits that make roles take turns.

A repaired conversation's role initials are ``(s?(ua)+)?``. Rows are kept (0), given the role
``user`` or ``assistant`` (2), deleted (3; blank and duplicate rows must be) or put before with an
empty text (2); a truncated row that stays adds 1. Of the cheapest edit lists the one whose
initials come first in ASCII order is taken.

Method: iterative-deepening A*. ``search`` goes through the edits depth first in the order D, I,
K, R under a cost bound that rises from the lower bound of the start; a table holds, for each
state, the most budget that is known not to do. The first path that reaches the goal is the
answer. Which role a row may get follows from the state, so an edit list is its initials.

Scale: rows that are copies are counted before the shuffle. Rows are then cut by ranges of
(conversation, turn), so that a conversation with a third of all rows lies in many tasks; each run
of at most ``BLOCK`` rows is searched by itself, from each state it may begin in to each it may end
in, and the blocks of a conversation are joined from left to right with the same rules. Only the
texts of one conversation stream, in order and never held, through one task, because what makes
use of them (a SHA-256 over the whole) is sequential.

Nulls in role and text count as one space. Null turns come first, a null ``conv_id`` is a
conversation of its own, rows of one turn go by role and then text. A role is told by its first
letter; an empty one has none and cannot be kept. Other columns than the four are ignored, so
their names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby, product
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from tidemark.llm.common import batches_of, materialise, rows_of

# Rows that one search takes on.
BLOCK = 256
# White space, the states of the pattern (nothing yet, after s, after u, after a)
# with the role each of them needs next, and the names of those roles.
SPACE = " \t\n\x0b\x0c\r"
NEXT_ROLE = "uuau"
ROLE_NAMES = {"u": "user", "a": "assistant"}
STATES = range(4)
# What is still to be put in at the end, by state.
CLOSING = ("", "II", "I", "")
COST = {"D": 3, "I": 2, "K": 0, "R": 2}

_COUNTED = "n_turns first_turn last_turn blank duplicate truncated illegal".split()
BLOCKS = "conv_id long, place long, first_role string, last_role string, " + "".join(
    f"{name} long, " for name in _COUNTED
) + "moves array<string>"
SUMMARY = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
    "cost long, audit string"
)
DIGESTS = "conv_id long, repaired_sha256 string"
REPAIRED = "conv_id long, position long, edit string, turn long, role string, text string"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, ddl.split(", "))])


def as_space(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))


def damage(turns: DataFrame) -> DataFrame:
    """Rows with faults put in, for trying the repair: by crc32 of ``conv_id:turn`` modulo 20 a
    row is dropped (0), emptied (1), robbed of its ends of sentences (2), repeated (3) or made the
    user's (4). ``copies`` tells how often a row is there; dropped ones keep their conversation."""
    kind = F.crc32(F.concat(as_space(F.col("conv_id")), F.lit(":"), as_space(F.col("turn")))) % 20
    text = as_space(F.col("text"))
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(as_space(F.col("role"))).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def counted(turns: DataFrame) -> DataFrame:
    """Each different row once, with how often it is there, written to the shared folder."""
    copies = F.col("copies") if "copies" in turns.columns else F.lit(1)
    each = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        as_space(F.col("role")).alias("role"),
        as_space(F.col("text")).alias("text"),
        copies.cast("long").alias("copies"),
    )
    rows = each.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    return materialise(rows, "conversations")


def repairs(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``counted`` rows: its faults, the cost and the edits."""
    order = ("conv_id", "turn", "role", "text")
    facts = _with_faults(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    narrow = facts.drop("text").withColumn("task", F.spark_partition_id().cast("long"))
    blocks = narrow.mapInArrow(_blocks, BLOCKS)
    written = materialise(blocks, "blocks")
    return written.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_join, SUMMARY)


def _with_faults(rows: DataFrame) -> DataFrame:
    """What the search must know of each row, and the text by which rows of one turn are ordered.

    What a conversation says more than once is looked up by its digest, among such texts only.
    """
    end = F.rtrim(F.translate("text", SPACE[1:], " " * (len(SPACE) - 1)))
    said = F.concat_ws(":", as_space(F.col("conv_id")), F.length("role"), "role", "text")
    facts = rows.select(
        "conv_id",
        "turn",
        "role",
        "text",
        "copies",
        F.sha2(said, 256).alias("said"),
        (end == "").alias("blank"),
        (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    repeated = (
        facts.where("copies > 0")
        .groupBy("said")
        .agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("places"))
        .where("places > 1")
        .select("said", F.col("first.turn").alias("first_turn"), F.lit(True).alias("repeated"))
    )
    later = F.col("repeated") & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    joined = facts.join(repeated, "said", "left")
    return joined.withColumn("said_before", F.coalesce(later, F.lit(False))).drop(
        "said", "repeated", "first_turn"
    )


def _steps(initial: str, blank: bool, cut: bool, said_before: bool, copies: int) -> list[tuple[str, str]]:
    """The rows that one counted row stands for, as (initial, fault)."""
    if blank:
        return [(initial, "b")] * copies
    first = "d" if said_before else "t" if cut else ""
    return [(initial, first)] * min(copies, 1) + [(initial, "d")] * (copies - 1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of at most ``BLOCK`` rows of one conversation, with their costs between states."""
    names = ("conv_id", "turn", "role", "blank", "cut", "said_before", "copies", "task")

    def runs():
        by_conversation = groupby(rows_of(batches, *names), itemgetter(0))
        last = None
        for at, (conv, rows) in enumerate(by_conversation):
            if last:
                # Begun at a first row and left behind: a whole conversation in one block.
                yield _block(*last, whole=last[-1] == (0,))
            # Only the first run of a task can go on a conversation that begins elsewhere.
            entries = (0,) if at else STATES
            steps, turns, place = [], [], None
            for _, turn, role, blank, cut, said_before, copies, task in rows:
                place = task << 32 if place is None else place
                for step in _steps(role[:1], blank, cut, said_before, copies):
                    if len(steps) >= BLOCK:
                        yield _block(conv, place, steps, turns, entries)
                        entries, steps, turns, place = STATES, [], [], place + 1
                    steps.append(step)
                    turns.append(turn)
            last = (conv, place, steps, turns, entries)
        if last:
            yield _block(*last)

    yield from batches_of(runs(), _arrow(BLOCKS), 256)


def _block(
    conv, place: int, steps: list[tuple[str, str]], turns: list, entries, whole: bool = False
) -> tuple:
    roles, faults = [role for role, _ in steps], [fault for _, fault in steps]
    known = sorted({turn for turn in turns if turn is not None})
    moves: list[tuple[int, str] | None] = [None] * 16
    if whole:
        moves[0] = search(steps, 0, (0, 3), closed=True)
    else:
        for entry, leave in product(entries, STATES):
            moves[4 * entry + leave] = search(steps, entry, (leave,))
    return (
        conv,
        place,
        roles[0] if steps else None,
        roles[-1] if steps else None,
        len(known),
        known[0] if known else None,
        known[-1] if known else None,
        faults.count("b"),
        faults.count("d"),
        faults.count("t"),
        _illegal(roles),
        [None if move is None else f"{move[0]}:{move[1]}" for move in moves],
    )


def _illegal(roles: list[str]) -> int:
    return sum(one + two not in ("su", "ua", "au") for one, two in zip(roles, roles[1:]))


def keep(state: int, role: str) -> int | None:
    """The state after a row of this role, None where it may not follow."""
    if role == "s":
        return 1 if state == 0 else None
    return _after(role) if role == NEXT_ROLE[state] else None


def _after(role: str) -> int:
    return 2 if role == "u" else 3


def search(
    steps: list[tuple[str, str]], entry: int, goals: tuple[int, ...], closed: bool = False
) -> tuple[int, str] | None:
    """(cost, edits) of the cheapest, then ASCII-least way through ``steps`` from one state to one
    of ``goals``, by iterative-deepening A*; None where there is none. Only if ``closed`` may rows
    be put in after the last one."""
    if not closed and not _reachable(steps, entry, goals):
        return None
    least = _lower_bounds(steps)
    # For each place and state, the largest budget with which no way was found.
    failed = [[-1] * 4 for _ in range(len(steps) + 1)]
    bound = least[0][entry > 0]
    while True:
        path = _descend(steps, entry, goals, closed, bound, least, failed)
        if path is not None:
            return bound, path
        bound += 1


def _reachable(steps, entry: int, goals) -> bool:
    """Every row may be deleted, and before each ``u`` and ``a`` may be put in."""
    states = {entry} | ({2, 3} if steps else set())
    if entry == 0 and any(role == "s" and fault not in ("b", "d") for role, fault in steps):
        states.add(1)
    return not states.isdisjoint(goals)


def _lower_bounds(steps) -> list[tuple[int, int]]:
    """For each place what the rows from there on cost at least, whatever their neighbours are:
    (nothing kept yet, something kept). One system row may be kept in the first case."""
    total, system, bounds = 0, 0, [(0, 0)]
    for role, fault in reversed(steps):
        if fault in ("b", "d"):
            total += COST["D"]
        else:
            stays = int(fault == "t")
            if role not in ("u", "a"):
                total += min(COST["R"] + stays, COST["D"])
                if role == "s":
                    system = COST["D"] - 1
            else:
                total += stays
        bounds.append((max(0, total - system), total))
    return bounds[::-1]


def _descend(steps, entry: int, goals, closed: bool, bound: int, least, failed) -> str | None:
    """The first path within ``bound``, depth first in the order D, I, K, R, without recursion."""
    path: list[str] = []
    stack = [(0, entry, bound, _edits(steps, 0, entry, closed))]
    while stack:
        place, state, budget, edits = stack[-1]
        if place == len(steps) and state in goals:
            return "".join(path)
        step = next(edits, None)
        if step is None:
            failed[place][state] = max(failed[place][state], budget)
            stack.pop()
            if path:
                path.pop()
            continue
        edit, after, state_after, cost = step
        left = budget - cost
        if left >= least[after][state_after > 0] and left > failed[after][state_after]:
            path.append(edit)
            stack.append((after, state_after, left, _edits(steps, after, state_after, closed)))
    return None


def _edits(steps, place: int, state: int, closed: bool) -> Iterator[tuple[str, int, int, int]]:
    """(edit, next place, next state, cost) in ASCII order."""
    if place == len(steps):
        if closed:
            yield "I", place, _after(NEXT_ROLE[state]), COST["I"]
        return
    role, fault = steps[place]
    yield "D", place + 1, state, COST["D"]
    wanted = _after(NEXT_ROLE[state])
    yield "I", place, wanted, COST["I"]
    if fault in ("b", "d"):
        return
    stays = int(fault == "t")
    if (kept := keep(state, role)) is not None:
        yield "K", place + 1, kept, COST["K"] + stays
    yield "R", place + 1, wanted, COST["R"] + stays


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each conversation from left to right: its counts, cost and edits."""

    def conversations():
        names = ("conv_id", "first_role", "last_role", *_COUNTED, "moves")
        for conv, blocks in groupby(rows_of(batches, *names), itemgetter(0)):
            whole = _Whole()
            for block in blocks:
                whole.add(*block[1:])
            yield whole.result(conv)

    yield from batches_of(conversations(), _arrow(SUMMARY), 1024, lambda row: len(row[-1]))


class _Whole:
    """A conversation as far as its blocks have come."""

    def __init__(self):
        self.best: dict[int, tuple[int, list[str]]] = {0: (0, [])}
        self.turns, self.first, self.last, self.role = 0, None, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, first_role, last_role, n_turns, first, last, blank, duplicate, truncated, illegal, moves):
        if first_role is None:
            return
        if self.role is not None:
            illegal += _illegal([self.role, first_role])
        self.role = last_role
        if n_turns:
            self.turns += n_turns - (first == self.last)
            self.first = first if self.first is None else self.first
            self.last = last
        self.blank, self.duplicate = self.blank + blank, self.duplicate + duplicate
        self.truncated, self.illegal = self.truncated + truncated, self.illegal + illegal
        self._move(moves)

    def _move(self, moves):
        # Paths to one state share no prefix relation, so the better start stays the better whole;
        # ranks stand for the edits so far, so that long lists are compared once a block.
        ranks = {state: rank for rank, state in enumerate(sorted(self.best, key=lambda s: self.best[s][1]))}
        following = {}
        for at, move in enumerate(moves):
            entry, leave = divmod(at, 4)
            if move is None or entry not in self.best:
                continue
            cost, edits = move.split(":")
            key = (self.best[entry][0] + int(cost), ranks[entry], edits, entry)
            if leave not in following or key < following[leave]:
                following[leave] = key
        self.best = {
            leave: (cost, self.best[entry][1] + [edits]) for leave, (cost, _, edits, entry) in following.items()
        }

    def result(self, conv) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        cost, audit = min(
            (cost + COST["I"] * len(CLOSING[state]), "".join(edits) + CLOSING[state])
            for state, (cost, edits) in self.best.items()
        )
        return (conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit)


def repaired(rows: DataFrame, summaries: DataFrame) -> DataFrame:
    """The rows of the repaired conversations, each conversation in order within one task.

    ``rows`` are ``counted`` ones, ``summaries`` what ``repairs`` gave. ``position`` counts the rows
    of a conversation from 0, rows put in have no turn.
    """
    nothing = F.lit(None)
    both = summaries.select(
        "conv_id",
        F.lit(0).alias("kind"),
        nothing.cast("long").alias("turn"),
        nothing.cast("string").alias("role"),
        F.col("audit").alias("text"),
        F.lit(0).cast("long").alias("copies"),
    ).unionByName(rows.where("copies > 0").withColumn("kind", F.lit(1)))
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")
    return ordered.mapInArrow(_apply, REPAIRED)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("conv_id", "turn", "role", "text", "copies")

    def edited():
        for conv, rows in groupby(rows_of(batches, *names), itemgetter(0)):
            audit = next(rows)[3]
            for position, row in enumerate(_repair(audit, rows)):
                yield (conv, position, *row)

    yield from batches_of(edited(), _arrow(REPAIRED), 1024, lambda row: len(row[-1]))


def _repair(audit: str, rows: Iterator[tuple]) -> Iterator[tuple]:
    """(edit, turn, role, text) of the rows that an edit list leaves, in order."""
    edits, state = iter(audit), 0
    singly = (row[1:4] for row in rows for _ in range(row[4]))
    for edit in edits:
        turn, role, text = (None, "", "") if edit == "I" else next(singly)
        if edit == "D":
            continue
        if edit == "K":
            state = keep(state, role[:1])
        else:
            role = ROLE_NAMES[NEXT_ROLE[state]]
            state = _after(role[0])
        yield edit, turn, role, text


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``repaired`` rows: the hash of their ``role:text`` lines."""
    return rows.mapInArrow(_digest, DIGESTS)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def hashed():
        rows = rows_of(batches, "conv_id", "position", "role", "text")
        for conv, group in groupby(rows, itemgetter(0)):
            digest = hashlib.sha256()
            for _, position, role, text in group:
                digest.update(f"{chr(10) if position else ''}{role}:{text}".encode())
            yield conv, digest.hexdigest()

    yield from batches_of(hashed(), _arrow(DIGESTS))

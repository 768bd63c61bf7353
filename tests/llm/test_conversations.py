"""The repair of conversations against an exhaustive search and a program over states."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import conversations, queries

SPACE = " \t\n\x0b\x0c\r"


def cheapest(steps):
    """(cost, edits) by going from row to row with the best of each state."""
    best = {"": (0, "")}
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    for role, fault in steps + [(None, None)]:
        settled = {}
        while best:
            state = min(best, key=lambda s: best[s])
            value = best.pop(state)
            if state in settled and settled[state] <= value:
                continue
            settled[state] = value
            grown = follows[state][-1]
            offer = (value[0] + 2, value[1] + "I")
            if grown not in settled and (grown not in best or offer < best[grown]):
                best[grown] = offer
        if role is None:
            return min(value for state, value in settled.items() if state in ("", "a"))
        best = {}
        for state, (cost, edits) in settled.items():
            offers = [(state, cost + 3, "D")]
            if fault not in ("b", "d"):
                stays = fault == "t"
                offers.append((follows[state][-1], cost + 2 + stays, "R"))
                if role and role in follows[state]:
                    offers.append((role, cost + stays, "K"))
            for to, price, edit in offers:
                if to not in best or (price, edits + edit) < best[to]:
                    best[to] = (price, edits + edit)


def brute_force(rows):
    """The contract's rows from (conv_id, turn, role, text) ones."""
    damaged = defaultdict(list)
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(one for one in text if one not in ".!?")
        if kind == 4:
            role = "user"
        damaged[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, given in damaged.items():
        given.sort(key=lambda row: (row[0] is not None, row[0] or 0, row[1], row[2]))
        seen, steps = set(), []
        for _, role, text in given:
            end = text.rstrip(SPACE)
            fault = "b" if not end else "d" if (role, text) in seen else "" if end[-1] in ".!?" else "t"
            seen.add((role, text))
            steps.append((role[:1], fault))
        turns = {turn for turn, _, _ in given if turn is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(steps, steps[1:]))
        cost, audit = cheapest_of(steps)
        lines, state, left = [], "a", iter(given)
        for edit in audit:
            if edit == "D":
                next(left)
                continue
            role, text = ("assistant" if state == "u" else "user"), ""
            if edit != "I":
                _, own, text = next(left)
                role = own if edit == "K" else role
            state = role[:1]
            lines.append(f"{role}:{text}")
        faults = [fault for _, fault in steps]
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        counts = [faults.count(fault) for fault in "bdt"]
        out.append((conv, gaps, *counts, illegal, cost, audit, digest))
    return sorted(out, key=repr)


def cheapest_of(steps):
    return cheapest([tuple(step) for step in steps]) if steps else (0, "")


def run(spark, rows, tmp_path, monkeypatch=None):
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.op11_conversation_repair(spark, str(tmp_path)).select(
        "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    )
    return sorted((tuple(row) for row in found.collect()), key=repr)


def given(seed, conversations_, length):
    draw = random.Random(seed)
    texts = ["Yes.", "No!", "What?", "cut off", " ", "", None, "Zwei Wörter.", "a\nb.", "end. \x0b", "x" * 5000 + "."]
    roles = ["user", "assistant"] * 6 + ["system", "tool", "", None, "used"]
    rows = []
    for conv in range(conversations_):
        for turn in range(draw.randrange(1, length)):
            role = roles[turn % 2] if draw.random() < 0.7 else draw.choice(roles)
            at = turn if draw.random() < 0.9 else draw.choice([None, turn + 3, -5])
            rows.append((conv, at, role, draw.choice(texts) if draw.random() < 0.6 else f"{turn} said."))
    rows += rows[:20]
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (None, None, None, None)]
    rows += [(10_000, turn, "user", "the same.") for turn in range(12)]
    return rows


def test_search_finds_the_first_of_the_cheapest_among_all_edit_lists():
    def every(steps):
        best = None
        for length in range(len(steps), len(steps) + 5):
            for edits in itertools.product("DIKR", repeat=length):
                cost, state, at = 0, 0, 0
                for edit in edits:
                    if edit == "I":
                        state, cost = conversations._after(conversations.NEXT_ROLE[state]), cost + 2
                        continue
                    if at == len(steps) or (edit != "D" and steps[at][1] in ("b", "d")):
                        break
                    role, fault = steps[at]
                    at += 1
                    cost += {"D": 3, "K": 0, "R": 2}[edit] + (fault == "t" and edit != "D")
                    if edit == "R":
                        state = conversations._after(conversations.NEXT_ROLE[state])
                    elif edit == "K":
                        state = conversations.keep(state, role)
                        if state is None:
                            break
                else:
                    if at == len(steps) and state in (0, 3):
                        best = min(best or (cost, edits), (cost, edits))
        return best[0], "".join(best[1])

    draw = random.Random(3)
    for _ in range(60):
        steps = [(draw.choice("suat"), draw.choice(["", "", "b", "d", "t"])) for _ in range(draw.randrange(4))]
        assert cheapest_of(steps) == every(steps)
        offers = [
            (found[0] + 2 * len(conversations.CLOSING[leave]), found[1] + conversations.CLOSING[leave])
            for leave in range(4)
            if (found := conversations.search(steps, 0, (leave,)))
        ]
        assert min(offers) == every(steps) == conversations.search(steps, 0, (0, 3), closed=True)


@pytest.mark.parametrize("block", [256, 3, 1])
def test_repair_equals_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    rows = given(block, 60, 12)
    assert run(spark, rows, tmp_path) == brute_force(rows)


def test_given_conversations_equal_brute_force(spark, sf_dir):
    rows = [tuple(row) for row in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op11_conversation_repair(spark, sf_dir).select(
        "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    )
    assert sorted((tuple(row) for row in found.collect()), key=repr) == brute_force(rows)


def test_a_conversation_of_most_rows_is_cut_into_blocks(spark, tmp_path):
    draw = random.Random(1)
    rows = [(7, turn, draw.choice(["user", "assistant"]), draw.choice([f"{turn}.", "cut", "Yes."])) for turn in range(3000)]
    rows += [(conv, 0, "user", "Hi.") for conv in range(20)]
    draw.shuffle(rows)
    assert run(spark, rows, tmp_path) == brute_force(rows)


def test_no_conversations_give_no_rows_and_other_columns_are_ignored(spark, tmp_path):
    assert run(spark, [], tmp_path / "none") == []
    clash = spark.createDataFrame(
        [(1, 0, "user", "Hi.", 5, "x")], "conv_id long, turn long, role string, text string, task long, said string"
    )
    rows = conversations.counted(clash)
    assert [row.audit for row in conversations.repairs(rows).collect()] == ["KI"]

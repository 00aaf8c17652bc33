"""Conversation repair against plain Python: every cheapest edit sequence, faults, digests, blocks and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon.llm import conversation_queries, conversation_repair
from tabulon.llm.conversation_repair import AT_END, GONE, IDENTITY, START, before, collapsed, product, run_matrix, unrolled

TYPES = "conv_id bigint, turn bigint, role string, text string"
AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """(cost, letters): forwards, the least pair for each state; rows are (initial, has to go, cut off)."""

    def with_inserts(ways):
        for _ in range(3):
            for (state, (cost, letters)), role in [(w, r) for w in list(ways.items()) for r in "ua"]:
                if (state, role) in AFTER:
                    key = AFTER[state, role]
                    ways[key] = min(ways.get(key, (1 << 60, "")), (cost + 2, letters + "I"))
        return ways

    ways = with_inserts({"": (0, "")})
    for initial, gone, cut in rows:
        following = {}
        for state, (cost, letters) in ways.items():
            found = [(state, cost + 3, "D")]
            if not gone:
                found += [(AFTER[state, initial], cost + cut, "K")] if (state, initial) in AFTER else []
                found += [(AFTER[state, role], cost + 2 + cut, "R") for role in "ua" if (state, role) in AFTER]
            for key, total, letter in found:
                following[key] = min(following.get(key, (1 << 60, "")), (total, letters + letter))
        ways = with_inserts(following)
    return min(ways[state] for state in ("", "a") if state in ways)


symbols = st.lists(st.tuples(st.sampled_from("suax"), st.booleans(), st.booleans(), st.sampled_from([1, 1, 1, 2, 70])), max_size=9)


@settings(max_examples=400, deadline=None)
@given(symbols, st.integers(0, 9))
def test_letters_are_the_least_of_the_cheapest_also_over_blocks(rows, cut):
    listed = [row[:3] for row in rows for _ in range(row[3])]
    runs = [(GONE if gone else (initial if initial in "sua" else "?", off), 1) for initial, gone, off in listed]
    cost, letters = cheapest(listed)
    assert unrolled(collapsed(runs))[0] == letters
    first, second = collapsed(runs[:cut]), collapsed(runs[cut:])
    whole = IDENTITY
    for symbol, count in second:
        whole = product(whole, run_matrix(symbol, count))
    left, state = unrolled(first, START, before(whole, AT_END), False)
    assert left + unrolled(second, state)[0] == letters


def expected(rows):
    """The summary of each conversation of plain rows (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1].encode(), hashlib.sha256(m[2].encode()).digest()))
        seen, marks = set(), []
        for _, role, text in own:
            blank = not re.search(r"[^\x20\x09-\x0D]", text)
            duplicate = not blank and (role, text) in seen
            cut = not blank and not duplicate and re.sub(r"[\x20\x09-\x0D]+", "", text)[-1] not in ".!?"
            seen.add((role, text))
            marks.append((role[:1], blank, duplicate, cut))
        cost, letters = cheapest([(i, blank or duplicate, cut) for i, blank, duplicate, cut in marks])
        lines, at, state = [], 0, ""
        for letter in letters:
            if letter != "I":
                _, role, text = own[at]
                at += 1
            if letter == "D":
                continue
            name = role if letter == "K" else "assistant" if state == "u" else "user"
            state = name[0]
            lines.append(f"{name}:{'' if letter == 'I' else text}")
        turns = {t for t, *_ in own if t is not None}
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        counts = [sum(m[i] for m in marks) for i in (1, 2, 3)]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (conv, gaps, *counts, illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def messages(seed, conversations, longest):
    draw = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "useless"]
    texts = ["Hello.", "Why?", "cut off", "é 日本!", "", " \n", None, "Yes. \t", "line\nline."]
    rows = []
    for conv in range(conversations):
        for turn in range(draw.randint(1, longest)):
            rows.append((conv, None if draw.random() < 0.1 else turn * draw.choice([1, 1, 2]), draw.choice(roles), draw.choice(texts) if draw.random() < 0.4 else f"text {draw.randrange(40)}."))
    rows += [(None, None, None, None), (None, 3, "user", "x"), (None, 3, "user", "x")]
    return rows + rows[:5] + rows[:5]


@pytest.fixture
def many_blocks(spark):
    """Small partitions stay apart, so that long conversations go over several."""
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    yield
    spark.conf.unset(setting)


@pytest.mark.parametrize(("seed", "conversations", "longest"), [(1, 60, 6), (2, 5, 60), (3, 1, 400)])
def test_summaries_of_conversations_within_and_over_blocks(spark, many_blocks, seed, conversations, longest):
    rows = messages(seed, conversations, longest)
    # Columns of other names, and some that the operator uses inside.
    df = spark.createDataFrame([(*r, "x", 7, "K") for r in rows], f"{TYPES}, digest string, place int, edits string").repartition(6)
    edits = conversation_repair.repair(df)
    found = {r.conv_id: tuple(r) for r in conversation_repair.summary(df, edits).collect()}
    assert found == expected(rows)
    if conversations == 1:
        assert edits.where("conv_id = 0").select(F.shiftright("place", 33).alias("block")).distinct().count() > 2
    # The repaired messages are those that the digests were taken of.
    listed = {}
    for r in conversation_repair.repaired_messages(df, edits).orderBy("place", "position").collect():
        listed.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(listed.get(c, [])).encode()).hexdigest() for c in found} == {c: f[-1] for c, f in found.items()}


def test_many_equal_messages_are_one_row(spark):
    rows = [(1, 0, "user", "Hi.")] * 5000 + [(1, 1, "assistant", "Well.")]
    df = spark.createDataFrame(rows, TYPES)
    edits = conversation_repair.repair(df)
    assert edits.count() == 2
    row = conversation_repair.summary(df, edits).first()
    assert (row.duplicate, row.illegal, row.cost, row.audit) == (4999, 4999, 3 * 4999, "K" + "D" * 4999 + "K")


def test_text_ids_and_empty_tables(spark):
    df = spark.createDataFrame([("b", 0, "user", "Hi."), ("b", 1, "assistant", "Well."), (None, 0, "assistant", "So.")], TYPES.replace("conv_id bigint", "conv_id string"))
    found = conversation_repair.summary(df, conversation_repair.repair(df))
    assert sorted((str(r.conv_id), r.audit) for r in found.collect()) == [("None", "IK"), ("b", "KK")]
    empty = df.limit(0)
    assert conversation_repair.summary(empty, conversation_repair.repair(empty)).count() == 0
    assert conversation_repair.repaired_messages(empty, conversation_repair.repair(empty)).count() == 0


def test_query_damages_and_lists_every_conversation(spark):
    draw = random.Random(9)
    rows = [(c, t, draw.choice(["user", "assistant", None]), draw.choice(["A. B!", "C", None])) for c in range(80) for t in range(draw.randint(1, 4))]
    rows += [(None, None, "user", "Hm."), (5, None, "user", "Hm."), *[(c, 0, "user", "Hm.") for c in range(80, 200)]]
    kept = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        kept += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    nothing = (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    wanted = {c: (c, *nothing) for c in {r[0] for r in rows}} | expected(kept)
    found = conversation_queries.repaired(spark.createDataFrame([(*r, "y") for r in rows], f"{TYPES}, audit string"))
    assert {r.conv_id: tuple(r) for r in found.collect()} == wanted
    assert any(w[1:] == nothing for w in wanted.values())
    assert conversation_queries.repaired(spark.createDataFrame([], TYPES)).count() == 0

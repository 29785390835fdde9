"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.conversation_repair import edits, fingerprints, repair, report
from llm.queries import damaged, op11_conversation_repair
from tests.conftest import DATA

SCHEMA = "conv_id long, turn long, role string, text string, block int, letters string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def damage(rows):
    found = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        found += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return found


def brute(rows):
    """Counts, cost, audit and repaired turns of one conversation: cheapest first, then ASCII, by a search over whole strings."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    faults, seen = [], set()
    for turn, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    todo, done = [(0, "", 0, "", ())], set()  # cost, initials, rows read, last role, turns
    while True:
        cost, audit, at, place, turns = heapq.heappop(todo)
        if at == len(rows) and place in ("", "a"):
            break
        if (at, place) in done:
            continue
        done.add((at, place))
        whole = {"u": "user", "a": "assistant"}[NEXT[place]]
        if not audit.endswith("III"):
            heapq.heappush(todo, (cost + 3, audit + "I", at, NEXT[place], (*turns, (whole, ""))))
        if at < len(rows):
            (_, role, text), fault = rows[at], faults[at]
            heapq.heappush(todo, (cost + 4, audit + "D", at + 1, place, turns))
            if fault in ("", "truncated"):
                more = 3 if fault else 0
                heapq.heappush(todo, (cost + 3 + more, audit + "R", at + 1, NEXT[place], (*turns, (whole, text))))
                if role[:1] == NEXT[place] or role[:1] == "s" and place == "":
                    heapq.heappush(todo, (cost + more, audit + "K", at + 1, role[:1], (*turns, (role, text))))
    numbers = [r[0] for r in rows if r[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    count = Counter(faults)
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit), turns


def want_of(rows):
    groups = defaultdict(list)
    for conv, *rest in rows:
        groups[conv].append(tuple(rest))
    return {conv: brute(own) for conv, own in groups.items()}


def digest(turns):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def random_rows(seed, conversations, longest):
    draw = np.random.default_rng(seed)
    texts = ["Yes.", "No!", "Why? \n", "cut off", "", " \t", "Yes.", "end?", None, "Ünï."]
    rows = []
    for conv in range(conversations):
        for i in range(int(draw.integers(1, longest))):
            turn = [None, int(draw.integers(0, 6)), i, i][draw.integers(0, 4)]
            role = ["system", "user", "assistant", "assistant", "user", "tool", "", None][draw.integers(0, 8)]
            rows.append((None if conv == 3 else conv, turn, role, texts[draw.integers(0, len(texts))] if draw.random() < 0.7 else f"Text {i}."))
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("block_rows", [1, 2, 1 << 16])
def test_repair(spark, block_rows):
    rows = [(c, t, r or "", x or "") for c, t, r, x in random_rows(1, 60, 9)]
    want = want_of(rows)
    found, turns = repair(frame_of(spark, rows), block_rows)
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == {c: w[0] for c, w in want.items()}
    assert dict(map(tuple, fingerprints(turns).collect())) == {c: digest(w[1]) for c, w in want.items() if w[1]}
    got = defaultdict(list)
    for r in sorted(turns.collect(), key=lambda r: r.position):
        got[r.conv_id].append((r.role, r.text))
    assert {c: tuple(t) for c, t in got.items()} == {c: w[1] for c, w in want.items() if w[1]}


def test_long_conversations_leave_in_blocks(spark):
    rows = [(1, t, ["user", "assistant", "user"][t % 3], f"Turn {t}." if t % 5 else "same") for t in range(700)] + [(1, 3, "user", "x.")] * 300 + [(2, 1, "user", "Hi.")]
    edited = edits(frame_of(spark, rows), 64)
    assert edited.where("conv = 1").count() == -(-1000 // 64) and edited.where("conv = 2").count() == 1
    assert {r[0]: tuple(r[1:]) for r in report(edited).collect()} == {c: w[0] for c, w in want_of(rows).items()}
    _, turns = repair(frame_of(spark, rows), 64)
    assert dict(map(tuple, fingerprints(turns).collect())) == {c: digest(w[1]) for c, w in want_of(rows).items()}


def test_rows_travel_once_for_the_program_and_once_for_the_texts(spark):
    rows = frame_of(spark, random_rows(2, 5, 4))
    _, turns = repair(rows)
    plan = turns._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and "SortMergeJoin" not in plan and "Window" not in plan


def test_query(spark, tmp_path):
    rows = random_rows(3, 40, 12)
    frame_of(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    for folder, own in ((str(tmp_path), rows), (f"{DATA}/sf0.01", None)):
        own = own or [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        want = want_of(damage(own))
        got = {r[0]: tuple(r[1:]) for r in op11_conversation_repair(spark, folder).collect()}
        none = ((0, 0, 0, 0, 0, 0, ""), ())
        assert got == {c: (*w[0], digest(w[1])) for c in {r[0] for r in own} for w in [want.get(c, none)]}


def test_damage(spark):
    rows = random_rows(4, 50, 8)
    got = Counter(map(tuple, damaged(frame_of(spark, rows)).collect()))
    assert got == Counter(damage(rows))


def test_no_rows(spark):
    found, turns = repair(frame_of(spark, [(1, 1, "user", "x")]).where(F.lit(False)))
    assert found.count() == turns.count() == fingerprints(turns).count() == 0

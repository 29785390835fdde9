"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

A repaired conversation has no turn, or an optional system turn and then one or more pairs of
a user's and an assistant's turn.  Edits of a row: Keep (costs 0), Rerole to user or assistant
(3), Delete (4, the only one for blank and duplicate rows); an empty user or assistant turn may be
Inserted anywhere (3).  A truncated row that stays adds 3.  Of equally cheap repairs the one counts
whose edits' initials, in order, come first in ASCII.

Rows are repartitioned by conversation and sorted by turn, and mapInPandas carries the state of the
dynamic program from row to row across Arrow batches: for each of four places in the pattern the cost
of the cheapest edits up to here and how their initials rank.  (All end with a row's edit and hold
as many of these, so none begins another and their order never changes.)  Costs only matter as
differences, and a place that costs over ``MOST_APART`` more than the best cannot win any more, so
few states exist and each step is computed once.

The way back is kept as one byte for each place and row.  When a conversation outgrows a block,
the block's bytes are compressed and leave as a row of the result, so memory stays bounded by a block
however long a conversation is; a second pass reads these rows last block first.  What was
written lies in the shared folder, so a lost executor costs only its own tasks.

Texts take no part in this; only their digests do.  The edits go back to the texts as rows of
the same sort, a block's edits before its first row, in one shuffle of the texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.common import cut_lineage, quiet_shuffles

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # what an edit costs; what a truncated row adds that stays
BLOCK_ROWS = 1 << 16
#: From any place every turn of the pattern can be reached by two inserts and one deletion.
MOST_APART = 2 * INSERT + DELETE

# Places in the pattern: nothing yet, after a system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
CLOSING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}  # inserts that complete the pattern
EDITS = ("D", "K", "IK", "IIK", "R", "IR", "IIR")  # a row's edit with the inserts before it
INITIALS = ("s", "u", "a", "")
MUST_GO = 2 * len(INITIALS)  # the kind of a row: twice the place of its initial, one more if truncated; or this

_FIRST = ((0, 0), None, None, None)  # per place: cost above the cheapest, rank; None if out of reach

_KEY = "conv long, no_conv boolean, turn long, no_turn boolean, role string, digest binary"
_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_BLOCKS = f"{_KEY}, block int, letters string, pointers binary, place int, {', '.join(f'{c} long' for c in _REPORT)}"


def _choices(place: int, kind: int) -> Iterator[tuple[int, int, int]]:
    """Cost, number of the edit and next place of whatever may be done with a row."""
    yield DELETE, 0, place
    if kind == MUST_GO:
        return
    initial, more = INITIALS[kind // 2], TRUNCATED * (kind % 2)
    for inserts in range(3):
        if (initial, place) in KEPT:
            yield INSERT * inserts + KEEP + more, 1 + inserts, KEPT[initial, place]
        yield INSERT * inserts + REROLE + more, 4 + inserts, NEXT[place][0]
        place = NEXT[place][0]


@cache
def step(state: tuple, kind: int) -> tuple[tuple, int, bytes]:
    """The state after a row, the cost it adds to the cheapest, and for each place the edit (times four) and place that led there."""
    best: dict[int, tuple] = {}
    for place, known in enumerate(state):
        if known is not None:
            for cost, edit, to in _choices(place, kind):
                way = (known[0] + cost, known[1], EDITS[edit], edit, place)
                best[to] = min(best.get(to, way), way)
    least = min(way[0] for way in best.values())
    live = {to: way for to, way in best.items() if way[0] <= least + MOST_APART}
    ranks = {to: r for r, to in enumerate(sorted(live, key=lambda to: live[to][1:3]))}
    after = tuple((live[p][0] - least, ranks[p]) if p in live else None for p in range(4))
    return after, least, bytes(4 * live[p][3] + live[p][4] if p in live else 255 for p in range(4))


def finish(state: tuple) -> tuple[int, int]:
    """The place in which the cheapest repair ends, and what it costs above the cheapest so far."""
    return min((k[0] + INSERT * CLOSING[p], k[1], p) for p, k in enumerate(state) if k is not None)[::2][::-1]


def trace(pointers: bytes, place: int) -> tuple[str, int]:
    """The edits of a block whose last row led to ``place``, and the place before its first row."""
    found = []
    for at in range(len(pointers) - 4, -1, -4):
        edit, place = divmod(pointers[at + place], 4)
        found.append(EDITS[edit])
    return "".join(reversed(found)), place


class _Conversation:
    """What is carried from row to row of one conversation."""

    def __init__(self) -> None:
        self.state, self.cost, self.block, self.pointers = _FIRST, 0, 0, bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns, self.least, self.last, self.before = 0, None, None, None


def _program(block_rows: int):
    columns = [c.split()[0] for c in _BLOCKS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: _Conversation | None = None
        named = first = None
        out: list[tuple] = []

        def leave(whole: bool) -> None:
            if whole:
                place, more = finish(own.state)
                gaps = own.last - own.least + 1 - own.turns if own.turns else 0
                counts = (gaps, own.blank, own.duplicate, own.truncated, own.illegal, own.cost + more)
                if not own.block:
                    letters, pointers = trace(own.pointers, place)[0] + "I" * CLOSING[place], None
                else:
                    letters, pointers = None, zlib.compress(own.pointers, 1)
            else:
                place, counts, letters, pointers = None, (None,) * len(_REPORT), None, zlib.compress(own.pointers, 1)
            out.append((*named, *first, own.block, letters, pointers, place, *counts))
            own.pointers, own.block = bytearray(), own.block + 1

        for batch in batches:
            kinds = np.select(
                [batch["blank"] | batch["again"], batch["initial"] == "s", batch["initial"] == "u", batch["initial"] == "a"],
                [MUST_GO, 0, 2, 4], 6,
            )
            kinds = np.where((kinds < MUST_GO) & batch["cut"], kinds + 1, kinds)
            rows = zip(*(batch[c].tolist() for c in ("conv", "no_conv", "turn", "no_turn", "role", "digest", "initial", "blank", "again")), kinds.tolist())
            for conv, no_conv, turn, no_turn, role, digest, initial, blank, again, kind in rows:
                if named != (conv, no_conv):
                    if own is not None:
                        leave(True)
                    own, named = _Conversation(), (conv, no_conv)
                elif len(own.pointers) == 4 * block_rows:
                    leave(False)
                if not own.pointers:
                    first = (turn, no_turn, role, digest)
                own.state, more, way = step(own.state, kind)
                own.cost += more
                own.pointers += way
                if kind == MUST_GO:
                    own.blank += blank
                    own.duplicate += not blank
                else:
                    own.truncated += kind % 2
                if own.before is not None and own.before + initial not in ("su", "ua", "au"):
                    own.illegal += 1
                own.before = initial
                if not no_turn and turn != own.last:
                    own.least = turn if own.least is None else own.least
                    own.last, own.turns = turn, own.turns + 1
            if out:
                yield _frame(out, columns)
                out = []
        if own is not None:
            leave(True)
            yield _frame(out, columns)

    return run


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series(list(v), dtype=object) for c, v in zip(columns, zip(*rows))})


def _trace_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of long conversations, last first, with their edits."""
    place = None
    for batch in batches:
        letters = []
        for pointers, end in zip(batch["pointers"], batch["place"]):
            ends = not pd.isna(end)
            place = int(end) if ends else place
            closing = "I" * CLOSING[place] if ends else ""
            found, place = trace(zlib.decompress(pointers), place)
            letters.append(found + closing)
        yield batch.drop(columns=["pointers", "place"]).assign(letters=letters)


def _apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order, each block's edits before its rows, as repaired turns."""
    columns = ["conv", "no_conv", "position", "role", "text", "edit"]
    named, waiting, place, position = None, iter(""), START, 0
    out: list[tuple] = []

    def put(role: str, text: str, edit: str) -> None:
        nonlocal position
        out.append((*named, position, role, text, edit))
        position += 1

    def insert() -> None:
        nonlocal place
        place, role = NEXT[place]
        put(role, "", "I")

    for batch in batches:
        for conv, no_conv, role, initial, edits, text in zip(
            *(batch[c].tolist() for c in ("conv", "no_conv", "role", "initial", "edits", "text"))
        ):
            if named != (conv, no_conv):
                for _ in waiting:  # all that is left are inserts that complete the pattern
                    insert()
                named, waiting, place, position = (conv, no_conv), iter(""), START, 0
            if edits:
                waiting = iter([*waiting, *text])
                continue
            while (edit := next(waiting)) == "I":
                insert()
            if edit == "K":
                place = KEPT[initial, place]
                put(role, text, edit)
            elif edit == "R":
                place, other = NEXT[place]
                put(other, text, edit)
        if out:
            yield _frame(out, columns)
            out = []
    for _ in waiting:
        insert()
    if out:
        yield _frame(out, columns)


def _prepared(conversations: DataFrame) -> DataFrame:
    """Rows with the columns that order them; nulls are flagged, as pandas would turn such a column into floating point."""
    return conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("no_conv"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.col("turn").isNull().alias("no_turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumns({"digest": F.unhex(F.sha2("text", 256)), "initial": F.substring("role", 1, 1)})


def edits(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The edits of each conversation (conv_id, turn, role, text) in blocks, with its report on the last one.

    ``conv, no_conv`` name the conversation, ``block`` counts from 0, ``letters`` are the initials
    of the edits of the block's rows, ``turn, no_turn, role, digest`` the place of its first row.
    """
    quiet_shuffles(conversations.sparkSession)
    text = F.col("text")
    rows = _prepared(conversations).select(
        "conv", "no_conv", "turn", "no_turn", "role", "digest", "initial",
        (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"),
    )
    # Equal rows of a conversation lie in its partition, so the window needs no shuffle of its own.
    seen = Window.partitionBy("conv", "no_conv", "role", "digest").orderBy(F.desc("no_turn"), "turn")
    rows = rows.repartition("conv", "no_conv").withColumn("again", F.row_number().over(seen) > 1)
    blocks = cut_lineage(rows.sortWithinPartitions(*_order(), "again").mapInPandas(_program(block_rows), _BLOCKS))
    done = blocks.where("pointers is null").drop("pointers", "place")
    long = blocks.where("pointers is not null")
    if long.isEmpty():
        return done
    traced = long.repartition("conv", "no_conv").sortWithinPartitions("conv", "no_conv", F.desc("block")).mapInPandas(
        _trace_blocks, _BLOCKS.replace(", pointers binary, place int", "")
    )
    return cut_lineage(done.unionByName(traced))


def _order() -> tuple:
    return "conv", "no_conv", F.desc("no_turn"), "turn", "role", "digest"


def _conversation() -> Column:
    return F.when(~F.col("no_conv"), F.col("conv")).alias("conv_id")


def report(edited: DataFrame) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; ``edited`` comes from ``edits``."""
    parts = F.array_sort(F.collect_list(F.struct("block", "letters")))
    return edited.groupBy("conv", "no_conv").agg(
        *(F.max(c).alias(c) for c in _REPORT), F.array_join(F.transform(parts, lambda p: p["letters"]), "").alias("audit")
    ).select(_conversation(), *_REPORT, "audit")


def repaired_turns(conversations: DataFrame, edited: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position, role, text, edit (K, R or I).

    A conversation's turns lie in one partition, in order, as long as the result is not shuffled.
    """
    rows = _prepared(conversations).withColumns({"edits": F.lit(False), "block": F.lit(0)})
    own = edited.select(
        "conv", "no_conv", "turn", "no_turn", "role", F.col("letters").alias("text"), "digest", F.lit("").alias("initial"), F.lit(True).alias("edits"), "block"
    )
    # Blocks share a place where equal rows lie on both sides of a border; rows take the edits as they come, block by block.
    both = rows.unionByName(own).repartition("conv", "no_conv").sortWithinPartitions(*_order(), F.desc("edits"), "block")
    return both.mapInPandas(_apply, "conv long, no_conv boolean, position long, role string, text string, edit string").select(
        _conversation(), "position", "role", "text", "edit"
    )


def _hash_turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    named, found = None, None
    for batch in batches:
        out = []
        keys = zip(batch["conv"].tolist(), batch["no_conv"].tolist())
        for key, role, text in zip(keys, batch["role"].tolist(), batch["text"].tolist()):
            if key != named:
                if named is not None:
                    out.append((*named, found.hexdigest()))
                named, found = key, hashlib.sha256()
            else:
                found.update(b"\n")
            found.update(f"{role}:{text}".encode())
        if out:
            yield _frame(out, ["conv", "no_conv", "sha256"])
    if named is not None:
        yield _frame([(*named, found.hexdigest())], ["conv", "no_conv", "sha256"])


def fingerprints(turns: DataFrame) -> DataFrame:
    """Per conversation of ``repaired_turns``, not shuffled since: conv_id, sha256 of its lines ``role:text``, read as a stream."""
    keys = turns.select(
        F.coalesce("conv_id", F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("no_conv"), "role", "text"
    )
    return keys.mapInPandas(_hash_turns, "conv long, no_conv boolean, sha256 string").select(_conversation(), "sha256")


def repair(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The report and the repaired turns of conversations (conv_id, turn, role, text).

    Rows are taken by turn, nulls first, then by role and digest of the text.  Null conv_ids are one
    conversation; a null role or text counts as empty; a role that begins with neither s, u nor a cannot
    be kept as it is.  Repeated rows are duplicates, other columns are not read, and an empty table
    gives no row.
    """
    edited = edits(conversations, block_rows)
    return report(edited), repaired_turns(conversations, edited)

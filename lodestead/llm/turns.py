"""Conversation structure repair by secondary-sorted streams.

A conversation's rows should read, by the initials of their roles, as ``(s?(ua)+)?``. Edits: K keeps a row (0), R gives it the
role user or assistant (3), D deletes it (4; a must for blank rows and duplicates), I inserts an empty turn of the user
or the assistant (3); a truncated row that stays adds 3. Of the cheapest edits those count whose initials come
first in ASCII order.

1. Rows are dealt by conversation once. Within that, a window over equal rows marks duplicates, without another shuffle.
2. Rows sorted backwards stream through a dynamic program over the four states of the pattern (empty,
   after s, after u, after a). It carries four costs from batch to batch, and nothing else: for each state the
   cheapest way to the end, which also settles ties, as in each state a letter leads to one state only.
   Each row leaves with a byte, two bits a state: the letter to write there.
3. These backpointers stay beside their rows, in Spark's own sort, which spills: a giant conversation is
   never held. Sorted forwards, the rows stream by again, and a state walks along the bytes.

Faults, of which a row's first counts: ``blank`` (only `[\\x20\\x09-\\x0D]`), ``duplicate`` (role and text seen before in the
conversation), ``truncated`` (the last other character is not `[.!?]`).

Defined results: order is by turn, nulls first, and among equal turns by role and text; null roles and texts read as one blank;
rows without a conversation id are one conversation; roles of other initials can't be kept; a conversation none of whose
rows is left has zeros, no edits and no turns; an empty table gives an empty one. Only ``conv_id``, ``turn``, ``role`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestead.llm.frames import map_batches

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LETTERS = "DIKR"
_D, _I, _K, _R = range(4)
#: States: nothing yet, after s, after u, after a; a pattern may end in the first and the last.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: The state that a turn given or inserted at will leads to.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
#: States from which a row with this initial can be kept, and the one after it.
_KEEP = {"s": ((_START,), _SYSTEM), "u": ((_START, _SYSTEM, _ASSISTANT), _USER), "a": ((_USER,), _ASSISTANT)}
_ROLES = {_USER: "user", _ASSISTANT: "assistant"}
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
#: What is left to pay after the last row.
_END = (0, 2 * INSERT, INSERT, 0)
BLANK, DUPLICATE, CUT = 1, 2, 3
_BLANKS = " \t\n\x0b\x0c\r"


def rows_of(conversations: DataFrame) -> DataFrame:
    """The columns that are read, nulls of role and text as a blank."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32(``conv_id:turn``) % 20, with ``gone`` for those that are dropped."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = rows_of(conversations).withColumn("kind", kind)
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))).withColumn("gone", F.col("kind") == 0)
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("copy", F.explode(copies)).drop("kind", "copy")


def _kind(fault: int, initial: str) -> int:
    """What decides about a row: its costs and whence it can be kept."""
    what = 4 if fault in (BLANK, DUPLICATE) else "sua".index(initial) if initial in _KEEP else 3
    return 2 * what + (fault == CUT)


def _step(costs: tuple[int, ...], kind: int) -> tuple[tuple[int, ...], int]:
    """The costs from each state to the end with one more row in front, over the least of them (they
    matter by their differences, which are few), and the byte of letters."""
    what, cut = divmod(kind, 2)
    own = []
    for state in range(4):
        best = (DELETE + costs[state], _D)
        if what < 4:
            if what < 3:
                whence, then = _KEEP["sua"[what]]
                if state in whence:
                    best = min(best, (TRUNCATED * cut + costs[then], _K))
            best = min(best, (REROLE + TRUNCATED * cut + costs[_NEXT[state]], _R))
        own.append(best)
    byte, out = 0, []
    for state in range(4):
        best, at, paid = own[state], state, 0
        for _ in range(3):  # a turn put in before the row, and more before that
            at, paid = _NEXT[at], paid + INSERT
            best = min(best, (paid + own[at][0], _I))
        byte |= best[1] << 2 * state
        out.append(best[0])
    return tuple(c - min(out) for c in out), byte


def decided(rows: DataFrame) -> DataFrame:
    """Every row (``conv_id``, ``turn``, ``role``, ``text``, optionally ``gone``) with ``fault`` and ``letters``, dealt by conversation and
    sorted by it and its order."""
    if "gone" not in rows.columns:
        rows = rows.withColumn("gone", F.lit(False))
    dealt = rows.repartition("conv_id")
    alike = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    dealt = dealt.withColumn("nth", F.row_number().over(alike))
    last = F.substring(F.rtrim("text", F.lit(_BLANKS)), -1, 1)
    fault = F.when(F.col("gone"), 0).when(last == "", BLANK).when(F.col("nth") > 1, DUPLICATE).when(~last.isin(".", "!", "?"), CUT).otherwise(0)
    order = ["turn", "role", "text", "nth"]
    names = ["conv_id", "turn", "role", "text", "gone", "nth"]
    backwards = dealt.withColumn("fault", fault).sortWithinPartitions("conv_id", *[F.col(c).desc_nulls_last() for c in order])

    def work(batches):
        held, costs = (), _END
        known: dict[tuple, tuple] = {}
        for batch in batches:
            conv, role, gone, faults = (batch.column(i).to_pylist() for i in (0, 2, 4, 6))
            letters = np.zeros(len(conv), np.int32)
            for i, key in enumerate(conv):
                if held != (key,):
                    held, costs = (key,), _END
                if not gone[i]:
                    step = costs, _kind(faults[i], role[i][:1])
                    if step not in known:
                        known[step] = _step(*step)
                    costs, letters[i] = known[step]
            yield {**{c: batch.column(i) for i, c in enumerate(names)}, "fault": batch.column(6), "letters": letters}

    out = map_batches(backwards.select(*names, "fault"), work, "conv_id long, turn long, role string, text string, gone boolean, nth int, fault int, letters int")
    return out.sortWithinPartitions("conv_id", *[F.col(c).asc_nulls_first() for c in order])


class Walk:
    """One conversation's rows as they stream by."""

    def __init__(self, conv_id):
        self.conv_id, self.state, self.cost = conv_id, _START, 0
        self.counts = {BLANK: 0, DUPLICATE: 0, CUT: 0, 0: 0}
        self.illegal, self.before, self.first, self.last, self.distinct = 0, None, None, None, 0

    def row(self, turn, role: str, text: str, fault: int, letters: int) -> Iterator[tuple[str, str, str]]:
        """The edits up to this row: letter, role and text after it."""
        self.counts[fault] += 1
        if self.before is not None and (self.before, role[:1]) not in _LEGAL:
            self.illegal += 1
        self.before = role[:1]
        if turn is not None:
            self.distinct += self.last != turn
            self.first, self.last = turn if self.first is None else self.first, turn
        while (letter := letters >> 2 * self.state & 3) == _I:
            yield self._insert()
        if letter == _D:
            self.cost += DELETE
        else:
            self.cost += TRUNCATED * (fault == CUT) + REROLE * (letter == _R)
            self.state = _NEXT[self.state] if letter == _R else _KEEP[role[0]][1]
            role = _ROLES[self.state] if letter == _R else role
        yield LETTERS[letter], role, text

    def end(self) -> Iterator[tuple[str, str, str]]:
        while self.state in (_SYSTEM, _USER):
            yield self._insert()

    def _insert(self) -> tuple[str, str, str]:
        self.cost += INSERT
        self.state = _NEXT[self.state]
        return LETTERS[_I], _ROLES[self.state], ""

    @property
    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.distinct


def _walks(batches) -> Iterator[tuple[Walk, int | None, str | None, tuple | None]]:
    """For each conversation its walk with every edit (and the edited row's turn), then with None."""
    walk = None
    for batch in batches:
        for conv, turn, role, text, gone, fault, letters in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if walk is None or walk.conv_id != conv:
                if walk is not None:
                    for edit in walk.end():
                        yield walk, None, edit
                    yield walk, None, None
                walk = Walk(conv)
                yield walk, None, ("", "", "")
            if not gone:
                for edit in walk.row(turn, role, text, fault, letters):
                    yield walk, None if edit[0] == LETTERS[_I] else turn, edit
    if walk is not None:
        for edit in walk.end():
            yield walk, None, edit
        yield walk, None, None


_READ = ["conv_id", "turn", "role", "text", "gone", "fault", "letters"]
#: Rows gathered before they are sent on.
_SENT = 1000


def _columns(rows: list[tuple], names: list[str]) -> dict:
    return {name: [r[i] for r in rows] for i, name in enumerate(names)}


def repair(rows: DataFrame) -> DataFrame:
    """The edits in order: ``conv_id``, ``position`` (from 0), ``edit`` (K, R, D or I), ``turn`` (null where inserted), ``role`` and ``text``
    after it. Rows of D are those to leave out."""
    names = ["conv_id", "position", "edit", "turn", "role", "text"]

    def work(batches):
        out, position = [], 0
        for walk, turn, edit in _walks(batches):
            if edit is None or not edit[0]:
                position = 0
                continue
            out.append((walk.conv_id, position, edit[0], turn, edit[1], edit[2]))
            position += 1
            if len(out) >= _SENT:
                yield _columns(out, names)
                out = []
        yield _columns(out, names)

    return map_batches(decided(rows).select(*_READ), work, "conv_id long, position long, edit string, turn long, role string, text string")


def report(rows: DataFrame) -> DataFrame:
    """A row for each conversation: counts of its faults, the cost and the letters of its cheapest edits, and the hash of what they
    give, which is formed as the rows stream by."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def work(batches):
        out, audit, digest, some = [], [], hashlib.sha256(), False
        for walk, _, edit in _walks(batches):
            if edit is None:
                n = walk.counts
                out.append((walk.conv_id, walk.gaps, n[BLANK], n[DUPLICATE], n[CUT], walk.illegal, walk.cost, "".join(audit), digest.hexdigest()))
                audit, digest, some = [], hashlib.sha256(), False
                if len(out) >= _SENT:
                    yield _columns(out, names)
                    out = []
            elif edit[0]:
                audit.append(edit[0])
                if edit[0] != LETTERS[_D]:
                    digest.update(f"{chr(10) if some else ''}{edit[1]}:{edit[2]}".encode())
                    some = True
        yield _columns(out, names)

    longs = ", ".join(f"{c} long" for c in names[:7])
    return map_batches(decided(rows).select(*_READ), work, f"{longs}, audit string, repaired_sha256 string")

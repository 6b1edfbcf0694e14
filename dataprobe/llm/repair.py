"""Repair of conversation structure by the cheapest edits, decided while the rows stream by.

A conversation is legal if its roles read (system)? (user assistant)+ or if nothing is left of it.  Rows are kept,
given another role or deleted, and empty rows are inserted, at the costs below; the repaired conversation is the one
of least cost, and among those the one whose edits, written as initials, come first in ASCII order.

The Viterbi states are what the output ends with so far.  One survivor a state is kept: its cost and its edits as a
leaf of a backpointer tree.  Nodes count their references; a node no survivor descends from is dropped with the texts
it held, and what all survivors share is emitted at once.  So memory holds the undecided edits, and of the rows only
those that some survivor still keeps.  A survivor is given up once another one could do all it still can for less.  Survivors of equal cost are compared by their complete undecided edits, from
their common ancestor on; two of them are never one the beginning of the other, since what the longer one has more
would be insertions, which cost.

Spark sorts rows by conversation and turn; a task reads them as a stream.  A digest of a whole conversation is one
chain over all its texts, so one conversation is one task's stream, but no conversation is ever held.  Duplicates are
found beforehand by (conversation, content), which spreads a long conversation over all tasks, and travel as marks.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_EMPTY, _SYSTEM, _USER, _ASSISTANT = range(4)
# (y, x, d): whatever follows, going on from y costs at most d more than going on from x.  Rows can be inserted, and a
# system row that only an empty output could keep can be deleted.
_STANDS_IN = (
    (_ASSISTANT, _EMPTY, DELETE), (_USER, _EMPTY, DELETE + INSERT), (_ASSISTANT, _SYSTEM, 0), (_USER, _SYSTEM, INSERT),
    (_EMPTY, _USER, INSERT), (_SYSTEM, _USER, INSERT), (_ASSISTANT, _USER, INSERT),
    (_EMPTY, _ASSISTANT, 2 * INSERT), (_SYSTEM, _ASSISTANT, 2 * INSERT), (_USER, _ASSISTANT, INSERT),
)
_BLANKS = " \t\n\x0b\x0c\r"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): rows as crc32 of ``conv_id:turn`` damages them; a null reads as a space.

    Dropped rows stay as rows without content, so that a conversation that loses all of them is still known.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn")).cast("binary")) % 20
    drawn = rows.select("conv_id", "turn", draw.alias("_draw"), shown("role").alias("role"), shown("text").alias("text"))
    text = F.when(F.col("_draw") <= 1, F.lit("")).when(F.col("_draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_draw") == 0, F.lit("")).when(F.col("_draw") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return drawn.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_draw") == 0).alias("dropped"), copies.alias("_copy")).drop("_copy")


def repeat_marks(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, mark): contents that an earlier turn of the conversation has, by their hash.

    A hash of 128 bits names a content.  Only contents with several turns are looked at again.
    """
    digest = F.md5(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text").cast("binary"))
    narrow = rows.filter(~F.col("dropped")).select("conv_id", F.struct(F.col("turn").isNotNull().alias("known"), "turn").alias("t"), digest.alias("mark"))
    distinct = narrow.groupBy("conv_id", "mark", "t").agg(F.lit(1).alias("_one"))
    first = distinct.groupBy("conv_id", "mark").agg(F.min("t").alias("first"), F.max("t").alias("last")).filter(F.col("first") != F.col("last"))
    same = (F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))) & (F.col("a.mark") == F.col("b.mark"))
    later = distinct.alias("a").join(first.alias("b"), same).filter(F.col("a.t") > F.col("b.first"))
    return later.select(F.col("a.conv_id").alias("conv_id"), F.col("a.t.turn").alias("turn"), F.col("a.mark").alias("mark"))


class _Node:
    """Edits since the parent, the rows they put out, what hangs on this node, and the state whose survivor it is (or -1)."""

    __slots__ = ("letters", "out", "parent", "kids", "state")

    def __init__(self, parent: _Node | None, letters: bytes, out: list, state: int):
        self.parent, self.letters, self.out, self.kids, self.state = parent, bytearray(letters), deque(out), set(), state
        if parent is not None:
            parent.kids.add(self)

    def references(self) -> int:
        return len(self.kids) + (self.state >= 0)


class Survivors:
    """The Viterbi search over one conversation: ``add`` rows, read ``emitted``, then ``finish``."""

    def __init__(self) -> None:
        self.root = _Node(None, b"", [], _EMPTY)
        self.state: list[tuple[int, _Node] | None] = [(0, self.root), None, None, None]
        self.letters: list[bytes] = []
        self.out: list[tuple[str, str]] = []

    def _undecided(self, node: _Node) -> list[_Node]:
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        return path[::-1]

    def _before(self, a, b) -> bool:
        """Whether candidate ``a`` (cost, node, letters, rows) beats ``b``."""
        if b is None or a[0] != b[0]:
            return b is None or a[0] < b[0]
        if a[1] is b[1]:
            return a[2] < b[2]
        x, y, k = self._undecided(a[1]), self._undecided(b[1]), 0
        while k < len(x) and k < len(y) and x[k] is y[k]:
            k += 1
        return b"".join([bytes(n.letters) for n in x[k:]]) + a[2] < b"".join([bytes(n.letters) for n in y[k:]]) + b[2]

    def _best(self, *candidates):
        best = None
        for c in candidates:
            if c is not None and self._before(c, best):
                best = c
        return best

    @staticmethod
    def _then(c, cost: int, letter: bytes, row: tuple[str, str] | None):
        return None if c is None else (c[0] + cost, c[1], c[2] + letter, c[3] + [row] if row is not None else c[3])

    def _inserted(self):
        """The best way to every state, with up to two rows inserted now; more would come back to a state at a cost."""
        e, s, u, a = (None if x is None else (*x, b"", []) for x in self.state)
        user, assistant = ("user", ""), ("assistant", "")
        put = lambda c, row: self._then(c, INSERT, b"I", row)
        begun = self._best(put(e, user), put(s, user))
        return e, s, self._best(u, begun, put(a, user)), self._best(a, put(u, assistant), put(begun, assistant))

    def add(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        gone = [None if x is None else (x[0] + DELETE, x[1], b"D", []) for x in self.state]
        if must_go:
            self._step(gone)
            return
        extra = TRUNCATED if truncated else 0
        e, s, u, a = self._inserted()
        initial = role[:1]
        before_user = self._best(e, s, a)
        to_system = self._then(e, KEEP + extra, b"K", (role, text)) if initial == "s" else None
        to_user = self._then(before_user, KEEP + extra, b"K", (role, text)) if initial == "u" else self._then(before_user, REROLE + extra, b"R", ("user", text))
        to_assistant = self._then(u, KEEP + extra, b"K", (role, text)) if initial == "a" else self._then(u, REROLE + extra, b"R", ("assistant", text))
        self._step([gone[_EMPTY], self._best(gone[_SYSTEM], to_system), self._best(gone[_USER], to_user), self._best(gone[_ASSISTANT], to_assistant)])

    def _step(self, chosen) -> None:
        old = [x[1] for x in self.state if x is not None]
        for node in old:
            node.state = -1
        # a survivor that costs more than another way to do all it can still do is out, not even a tie
        beaten = {x for y, x, d in _STANDS_IN if chosen[x] is not None and chosen[y] is not None and chosen[y][0] + d < chosen[x][0]}
        self.state = [None if c is None or k in beaten else (c[0], _Node(c[1], c[2], c[3], k)) for k, c in enumerate(chosen)]
        for node in old:
            self._tidy(node)
        while self.root.references() == 1:
            (node,) = self.root.kids
            self._emit(bytes(node.letters), node.out)
            node.letters, node.out = bytearray(), deque()
            if node.state >= 0:
                break  # the only survivor: a leaf, now without undecided edits
            node.parent, self.root = None, node

    def _tidy(self, node: _Node) -> None:
        """Drop a node that nothing refers to, and those above that it alone held; join one with its only heir."""
        if node is not self.root and node.parent is None:
            return  # gone already
        while node is not self.root and node.references() == 0:
            up = node.parent
            up.kids.discard(node)
            node.parent, node = None, up
        if node is self.root or node.state >= 0 or len(node.kids) != 1:
            return
        (heir,) = node.kids
        if len(heir.letters) <= len(node.letters):  # the shorter one moves
            node.letters += heir.letters
            node.out.extend(heir.out)
            node.kids, node.state, heir.parent = heir.kids, heir.state, None
            for kid in node.kids:
                kid.parent = node
            if node.state >= 0:
                self.state[node.state] = (self.state[node.state][0], node)
        else:
            heir.letters[:0] = node.letters
            heir.out.extendleft(reversed(node.out))
            heir.parent = node.parent
            node.parent.kids.discard(node)
            node.parent.kids.add(heir)
            node.parent = None

    def _emit(self, letters: bytes, out) -> None:
        self.letters.append(letters)
        self.out.extend(out)

    def emitted(self) -> tuple[bytes, list[tuple[str, str]]]:
        """The edits and rows decided since the last call."""
        letters, out = b"".join(self.letters), self.out
        self.letters, self.out = [], []
        return letters, out

    def undecided(self) -> int:
        return max(sum(len(n.letters) for n in self._undecided(x[1])) for x in self.state if x is not None)

    def finish(self) -> int:
        """Decide what is left; returns the cost."""
        e, _, _, a = self._inserted()
        cost, node, letters, out = self._best(e, a)
        for n in self._undecided(node):
            self._emit(bytes(n.letters), n.out)
        self._emit(letters, out)
        return cost


class _Conversation:
    """Counts, digest and repair of one conversation, row by row."""

    def __init__(self, key):
        self.key, self.search = key, Survivors()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last = self.role = None
        self.marks: set[str] = set()
        self.marked_turn: object = self
        self.audit, self.hash, self.lines = bytearray(), hashlib.sha256(), 0

    def mark(self, turn, mark: str) -> None:
        if turn != self.marked_turn:
            self.marks, self.marked_turn = set(), turn
        self.marks.add(mark)

    def row(self, turn, role: str, text: str) -> list[tuple[str, str]]:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        end = text.rstrip(_BLANKS)[-1:]
        seen = (turn, role, text) == self.last
        if not seen and self.marks and turn == self.marked_turn:
            seen = hashlib.md5(f"{len(role.encode())}:{role}:{text}".encode()).hexdigest() in self.marks
        blank, truncated = not end, end not in ".!?"
        self.blank += blank
        self.duplicate += seen and not blank
        self.truncated += truncated and not blank and not seen
        if self.last is not None and self.role + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last, self.role = (turn, role, text), role[:1]
        self.search.add(role, text, blank or seen, truncated)
        return self._take()

    def _take(self) -> list[tuple[str, str]]:
        letters, out = self.search.emitted()
        self.audit += letters
        for role, text in out:
            self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
            self.lines += 1
        return out

    def close(self) -> tuple[list[tuple[str, str]], tuple]:
        cost = self.search.finish()
        out = self._take()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        result = (self.key, min(gaps, 2**63 - 1), self.blank, self.duplicate, self.truncated, self.illegal, cost, self.audit.decode(), self.hash.hexdigest())
        return out, result


def _ordered(rows: DataFrame) -> DataFrame:
    """Damaged rows and marks, one conversation after the other, by turn (nulls first), marks first, then role and text."""
    marks = repeat_marks(rows).select("conv_id", "turn", F.lit("").alias("role"), F.lit("").alias("text"), F.lit(False).alias("dropped"), "mark")
    both = rows.withColumn("mark", F.lit(None).cast("string")).unionByName(marks)
    return both.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("mark").asc_nulls_last(), "role", "text")


_COLUMNS = ("conv_id", "turn", "role", "text", "dropped", "mark")
_AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple[str, str]], tuple | None]]:
    """(conv_id, rows decided, result at its end) over the ordered rows of a task."""
    now: _Conversation | None = None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)) for c in _COLUMNS]
        for start in range(0, batch.num_rows, 1024):
            for key, turn, role, text, dropped, mark in zip(*(c.slice(start, 1024).to_pylist() for c in columns)):
                if now is None or key != now.key:
                    if now is not None:
                        yield now.key, *now.close()
                    now = _Conversation(key)
                if mark is not None:
                    now.mark(turn, mark)
                elif not dropped:
                    out = now.row(turn, role, text)
                    if out:
                        yield key, out, None
    if now is not None:
        yield now.key, *now.close()


def conversation_audits(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, dropped): its faults, cost, edits and digest.

    A null conv_id is a conversation of its own; null turns come first; rows of one turn are ordered by role and
    text, so repeated rows stand side by side; texts may be empty or long, roles anything; other columns are ignored.
    A conversation without rows has zeros, no edits and the digest of nothing; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        names = [c.split()[0] for c in _AUDIT.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)
        for _, _, result in _stream(batches):
            if result is not None:
                held.append(result)
                size += len(result[7])
                if len(held) >= 1000 or size > 1 << 24:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)

    return _ordered(rows).mapInArrow(run, _AUDIT)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the repaired conversations, turns counted from 0, put out as they are decided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turn = object(), 0
        for found, out, _ in _stream(batches):
            if found != key:
                key, turn = found, 0
            if out:
                columns = [pa.array([found] * len(out), pa.int64()), pa.array(range(turn, turn + len(out)), pa.int64()), pa.array([r for r, _ in out]), pa.array([t for _, t in out])]
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "role", "text"])
                turn += len(out)

    return _ordered(rows).mapInArrow(run, "conv_id long, turn long, role string, text string")

"""Repair of damaged conversations: the cheapest edits that make roles read (system? (user assistant)+)?.

A row may be kept, given the role the grammar wants, or deleted, and empty rows may be put in anywhere. A backward program
over rows and grammar states holds the cost that is still to go; a walk from the first row then takes, among the
steps that the costs allow, the one whose letter is least, which gives the least of the cheapest edit strings; and the walk's
rows are written out again for the hash.

Scale. Rows are sorted once by ranges of (conversation, turn, role, text), so a conversation of any length is cut over many
tasks. Costs to go are minima of sums, so the part of a conversation that a task holds is a 4 x 4 table of costs from state to
state; the tables of a long conversation are multiplied from its end, the walks' states from its beginning, and
every task finishes its part knowing both ends. What tasks tell each other is a few numbers for each place where a range ends
inside a conversation. Only the hash of a long conversation is taken by one task: SHA-256 has no parts; it reads a stream of
pieces and holds one.

Cases: null roles and texts count as one space, so do null ids and turns in the damage's key; a null conv_id is a conversation
of its own; rows of one turn are taken by role, then text; repeated rows are duplicates; conversations without rows after the
damage have zeros, no edits and the empty string's hash; texts are hashed whole whatever their length; an empty table gives an
empty result; other columns than conv_id, turn, role and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import checkpointed, schema_of, sha256, slices
from quillmesh.operators.parallel import few, spread

#: Rows of the table of texts found again at later turns that are sent to every task, once they are counted.
FEW_AGAIN = 100_000
#: Characters of repaired text in a piece that goes to the task which hashes a conversation over several ranges.
PIECE = 1 << 20
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the row that the grammar wants, and that row's role.
WANTED = (USER, USER, ASSISTANT, USER)
ROLES = ("", "", "user", "assistant")
NEVER = 1 << 60
#: Costs to go behind the last row: nothing is left where the grammar may end.
END = (0, NEVER, NEVER, 0)
DELETE, PUT, RENAME, TRUNCATED = 4, 3, 3, 3
#: Kinds of rows: must go; else the role's initial (s, u, a, other), twice that many with truncated texts.
GONE = 8


def _steps(kind: int) -> list[list[tuple[str, int, int]]]:
    """For each state the (letter, next state, cost) of what may be done with a row of a kind, letters ascending."""
    out = []
    for q in range(4):
        steps = [("D", q, DELETE)]
        if kind != GONE:
            more, initial = (TRUNCATED if kind >= 4 else 0), kind % 4
            if initial == 0 and q == START:
                steps.append(("K", SYSTEM, more))
            elif initial == 1 and WANTED[q] == USER or initial == 2 and WANTED[q] == ASSISTANT:
                steps.append(("K", WANTED[q], more))
            steps.append(("R", WANTED[q], more + RENAME))
        out.append(steps)
    return out


STEPS = [_steps(kind) for kind in range(GONE + 1)]


def with_puts(f: list[int]) -> list[int]:
    """Costs to go where rows may be put in first; two in a row always suffice."""
    u, a = min(f[USER], PUT + f[ASSISTANT]), min(f[ASSISTANT], PUT + f[USER])
    return [min(f[START], PUT + u), min(f[SYSTEM], PUT + u), u, a]


def to_go(kinds: bytes, end: tuple[int, ...]) -> array:
    """Costs to go before each row and behind the last, four for each; `end` are those behind the last."""
    n = len(kinds)
    out = array("q", bytes(32 * (n + 1)))
    f = with_puts(list(end))
    out[4 * n :] = array("q", f)
    for i in range(n - 1, -1, -1):
        f = with_puts([min([cost + f[after] for _, after, cost in steps]) for steps in STEPS[kinds[i]]])
        out[4 * i : 4 * i + 4] = array("q", f)
    return out


def walk(kinds: bytes, f: array, q: int, last: bool) -> Iterator[tuple[str, int, int, int]]:
    """(letter, row or -1, state after, cost) of the least cheapest edits from a state on; puts behind the last row only where it ends the conversation."""
    for i, kind in enumerate(kinds):
        taken = False
        while not taken:
            left, deleted, *others = f[4 * i + q], *STEPS[kind][q]
            put = WANTED[q]
            if deleted[2] + f[4 * i + 4 + q] == left:
                yield "D", i, q, DELETE
                taken = True
            elif PUT + f[4 * i + put] == left:
                q = put
                yield "I", -1, q, PUT
            else:
                letter, q, cost = next(s for s in others if s[2] + f[4 * i + 4 + s[1]] == left)
                yield letter, i, q, cost
                taken = True
    end = 4 * len(kinds)
    while last and f[end + q]:
        q = WANTED[q]
        yield "I", -1, q, PUT


# ---- damage and faults


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n (rows that they stand for: 0 dropped, 2 repeated) after the damage."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = spread(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text")))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind <= 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return own.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("n"))


def kind_of(blank: Column, again: Column, cut: Column) -> Column:
    initial = F.substring("role", 1, 1)
    by_role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.when(blank | again, GONE).otherwise(by_role + F.when(cut, 4).otherwise(0))


def faulted(rows: DataFrame) -> DataFrame:
    """Rows with blank, again (role and text at an earlier turn too) and kind; in their order, over checkpointed ranges."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    at = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    told = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    own = rows.withColumns({"blank": blank, "at": at, "told": F.when((F.col("n") > 0) & ~blank, told)})
    places = own.where("told is not null").groupBy("conv_id", "told").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    twice = checkpointed(places.where("first < last").select(F.col("conv_id").alias("_conv"), F.col("told").alias("_told"), "first"))
    found = own.join(few(twice, FEW_AGAIN), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("told") == F.col("_told")), "left")
    again = F.coalesce(F.col("first") < F.col("at"), F.lit(False))
    marked = found.select("conv_id", "turn", "role", "text", "n", "blank", again.alias("again"), kind_of(F.col("blank"), again, cut).cast("int").alias("kind"))
    return checkpointed(marked.orderBy(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text"))


class Part:
    """The rows of one conversation that one range holds, copies written out."""

    def __init__(self, conv: int | None):
        self.conv, self.kinds = conv, bytearray()
        self.rows: list[tuple[str, str]] = []
        self.faults = [0, 0, 0]
        self.before: tuple | None = None
        self.turns, self.n_turns = [None, None], 0
        self.initials: list[str] = []
        self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, n: int, blank: bool, again: bool, kind: int) -> None:
        same = self.before == (turn, role, text)
        self.before = (turn, role, text)
        for copy in range(n):
            duplicate = not blank and (again or same or copy > 0)
            self.faults[0] += blank
            self.faults[1] += duplicate
            self.faults[2] += not blank and not duplicate and kind >= 4
            self.kinds.append(GONE if duplicate else kind)
            self.rows.append((role, text))
            if self.initials:
                self.illegal += self.initials[-1] + role[:1] not in ("su", "ua", "au")
                self.initials[1:] = [role[:1]]
            else:
                self.initials = [role[:1]] * 2
        if n and turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn]
            self.n_turns += 1


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    held = None
    for batch in batches:
        for small in slices(batch, 3):
            for conv, *row in zip(*[c.to_pylist() for c in small.columns], strict=True):
                if held is None or held.conv != conv:
                    if held is not None:
                        yield held
                    held = Part(conv)
                held.add(*row)
    if held is not None:
        yield held


# ---- conversations over several ranges


def _ends(rows: DataFrame) -> dict[int, list[tuple[int, int | None]]]:
    """For each range its first and last conversation: two numbers a range."""
    own = rows.select(F.spark_partition_id().alias("range"), "conv_id")
    order = F.struct(F.col("conv_id").isNotNull().alias("some"), "conv_id")
    return {r["range"]: (r["low"]["conv_id"], r["high"]["conv_id"]) for r in own.groupBy("range").agg(F.min(order).alias("low"), F.max(order).alias("high")).collect()}


def _crossing(ends: dict) -> dict[tuple[int, int | None], tuple[bool, bool]]:
    """(range, conversation) of the parts of conversations that lie over several ranges: whether each is the first, and the last."""
    out, order = {}, sorted(ends)
    for i, r in enumerate(order):
        for conv in set(ends[r]):
            before = i > 0 and ends[order[i - 1]][1] == conv and ends[r][0] == conv
            after = i + 1 < len(order) and ends[order[i + 1]][0] == conv and ends[r][1] == conv
            if before or after:
                out[r, conv] = (not before, not after)
    return out


def _tables(batches: Iterator[pa.RecordBatch], crossing: dict, ahead: dict | None) -> Iterator[pa.RecordBatch]:
    """Of each part of a conversation over several ranges: costs from state to state, or, costs behind it being known, the states in which the walks end."""
    here = TaskContext.get().partitionId()
    for part in parts(batches):
        if (here, part.conv) in crossing:
            kinds = bytes(part.kinds)
            if ahead is None:
                numbers = [v for q in range(4) for v in to_go(kinds, tuple(0 if k == q else NEVER for k in range(4)))[:4]] if kinds else [0 if k == q else NEVER for q in range(4) for k in range(4)]
            else:
                f, numbers = to_go(kinds, ahead[here, part.conv]), []
                for q in range(4):
                    if f[q] < NEVER:
                        for _, _, q, _ in walk(kinds, f, q, False):
                            pass
                    numbers.append(q)
            yield pa.RecordBatch.from_arrays([pa.array([here]), pa.array([part.conv], pa.int64()), pa.array([numbers], pa.list_(pa.int64()))], ["range", "conv_id", "numbers"])


def _asked(rows: DataFrame, crossing: dict, ahead: dict | None) -> dict:
    held = rows.sparkSession.sparkContext.broadcast((crossing, ahead))
    found = rows.mapInArrow(lambda batches: _tables(batches, *held.value), "range long, conv_id long, numbers array<long>")
    return {(r["range"], r["conv_id"]): r["numbers"] for r in found.collect()}


def joined(rows: DataFrame) -> dict:
    """For each (range, conversation) over several ranges: whether it is the first part, and the last, the state before it and the costs behind it."""
    crossing = _crossing(_ends(rows))
    if not crossing:
        return {}
    tables, ahead, state = _asked(rows, crossing, None), {}, {}
    of: dict = {}
    for r, conv in sorted(crossing, key=lambda k: k[0]):
        of.setdefault(conv, []).append(r)
    for conv, ranges in of.items():
        f = with_puts(list(END))
        for r in reversed(ranges):
            ahead[r, conv] = tuple(f)
            t = tables[r, conv]
            f = with_puts([min(min(NEVER, t[4 * k + q] + f[k]) for k in range(4)) for q in range(4)])
    exits = _asked(rows, crossing, ahead)
    for conv, ranges in of.items():
        q = START
        for r in ranges:
            state[r, conv] = q
            q = exits[r, conv][q]
    return {k: (*crossing[k], state[k], ahead[k]) for k in crossing}


# ---- repaired conversations

PIECES = "conv_id long, range long, piece long, first_turn long, last_turn long, n_turns long, blank long, duplicate long, truncated long, illegal long, first string, last string, cost long, audit string, lines boolean, text string, whole string"
REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def pieces_of(part: Part, here: int, first: bool, last: bool, q: int, ahead: tuple[int, ...]) -> Iterator[tuple]:
    """Rows (PIECES) of a part; of a whole conversation one, with its hash in place of its text."""
    kinds = bytes(part.kinds)
    f, whole = to_go(kinds, ahead), first and last
    audit, lines, size, cost, number = [], [], 0, 0, 0
    facts = (*part.turns, part.n_turns, *part.faults, part.illegal, *(part.initials or [None, None]))
    for letter, i, after, price in walk(kinds, f, q, last):
        audit.append(letter)
        cost += price
        if letter != "D":
            role, text = part.rows[i] if i >= 0 else ("", "")
            lines.append(f"{role if letter == 'K' else ROLES[after]}:{text}")
            size += len(lines[-1])
        if size >= PIECE and not whole:
            yield (part.conv, here, number, *(facts if number == 0 else (None, None, 0, 0, 0, 0, 0, None, None)), cost, "".join(audit), bool(lines), "\n".join(lines), None)
            audit, lines, size, cost, number = [], [], 0, 0, number + 1
    text = "\n".join(lines)
    yield (part.conv, here, number, *(facts if number == 0 else (None, None, 0, 0, 0, 0, 0, None, None)), cost, "".join(audit), bool(lines), None if whole else text, sha256(text.encode()) if whole else None)


def _pieces(batches: Iterator[pa.RecordBatch], known: dict, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    here, held, size = TaskContext.get().partitionId(), [], 0
    for part in parts(batches):
        for row in pieces_of(part, here, *known.get((here, part.conv), (True, True, START, END))):
            held.append(row)
            size += 200 + len(row[-2] or "")
            if size >= PIECE:
                yield _batch(held, arrow)
                held, size = [], 0
    if held:
        yield _batch(held, arrow)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


class Whole:
    """A conversation put together from its pieces in order."""

    def __init__(self, conv: int | None):
        self.conv, self.counts, self.audit, self.sha, self.hash = conv, [0] * 5, [], hashlib.sha256(), None
        self.turns, self.n_turns, self.last, self.lines = [None, None], 0, None, False

    def add(self, _range, _piece, first_turn, last_turn, n_turns, blank, duplicate, truncated, illegal, first, last, cost, audit, lines, text, whole) -> None:
        if n_turns:
            self.n_turns += n_turns - (self.turns[1] == first_turn)
            self.turns = [first_turn if self.turns[0] is None else self.turns[0], last_turn]
        if first is not None:
            illegal += self.last is not None and self.last + first not in ("su", "ua", "au")
            self.last = last
        self.counts = [a + b for a, b in zip(self.counts, (blank, duplicate, truncated, illegal, cost), strict=True)]
        self.audit.append(audit)
        self.hash = whole
        if whole is None and lines:
            self.sha.update(("\n" if self.lines else "").encode() + text.encode())
            self.lines = True

    def row(self) -> tuple:
        gaps = 0 if self.turns[0] is None else self.turns[1] - self.turns[0] + 1 - self.n_turns
        return (self.conv, gaps, *self.counts, "".join(self.audit), self.hash or self.sha.hexdigest())


def _wholes(batches: Iterator[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, done = None, []
    for batch in batches:
        for small in slices(batch, 15):
            for conv, *row in zip(*[c.to_pylist() for c in small.columns], strict=True):
                if held is None or held.conv != conv:
                    if held is not None:
                        done.append(held.row())
                    held = Whole(conv)
                held.add(*row)
            if len(done) > 4096:
                yield _batch(done, arrow)
                done = []
    if held is not None:
        yield _batch([*done, held.row()], arrow)


def repaired(conversations: DataFrame) -> DataFrame:
    """REPAIRED for each conversation, damaged first."""
    rows = faulted(damaged(conversations))
    known = rows.sparkSession.sparkContext.broadcast(joined(rows))
    (pieces, pieces_arrow), (out, out_arrow) = schema_of(PIECES), schema_of(REPAIRED)
    made = rows.mapInArrow(lambda batches: _pieces(batches, known.value, pieces_arrow), pieces)
    ordered = made.repartition("conv_id").sortWithinPartitions("conv_id", "range", "piece")
    return ordered.mapInArrow(lambda batches: _wholes(batches, out_arrow), out)

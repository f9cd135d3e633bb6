"""Cheapest repair of conversation structure: a Viterbi decoder whose survivors settle as they coalesce.

A conversation's rows are read in order. A path through them keeps, reroles or deletes each row and inserts rows, and its
state is what the output ends in: nothing, a system row, a user row or an assistant row. Each state keeps its cheapest
path (of equal ones the one whose edits come first in ASCII order) as a leaf of one tree of back pointers. Nodes count
their references: a path that loses is freed up to where another still needs it, and once all survivors stand below one
child of the root, that child's edit is settled, emitted and forgotten. Only the unsettled part of a conversation is
held, with its rows; two tied paths are compared over all of their edits after their last common node, which is exact
since everything before it is equal.

Paths that no survivor's future can need are dropped, so that they don't hold back settlement: an output that ends in a
system row, when one ending in an assistant row is no worse (whatever follows the first may follow the second); an empty
output, when deleting one more row from an assistant's output is still cheaper than it.

A repaired conversation's digest runs over all of its texts in order, so one conversation is one stream; other work
(damage, earlier copies of a row, order) is Spark's, by sorts that spill.

Nulls and odd rows: a null role or text is one space; rows of null conv_id are one conversation; null turns come first
and count for no gap; rows of equal turn follow each other by role, then text; repeated rows are duplicates; empty and
very long texts are rows like any other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: State that a row whose role starts with this letter leads to, by the state before it.
_TO = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_NAMES = {"u": "user", "a": "assistant"}
_EDITS = "seq long, edit string, turn long, role string, text string, fault string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


class Node:
    """An edit on a path; `refs` counts the nodes below and the paths that end here."""

    __slots__ = ("parent", "edit", "row", "refs", "kids", "depth")

    def __init__(self, parent: Node | None, edit: str, row: tuple | None):
        self.parent, self.edit, self.row, self.refs, self.kids = parent, edit, row, 0, []
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.refs += 1
            parent.kids.append(self)


class Decoder:
    """Survivors of one conversation; step() takes a row and settle() gives the edits that no later row can change."""

    def __init__(self):
        self.root = Node(None, "", None)
        self.paths: dict[int, tuple[int, Node]] = {}
        self._offer(self.paths, EMPTY, (0, self.root))
        self._inserted(self.paths)

    @staticmethod
    def _release(node: Node) -> None:
        """One reference less; nodes that nothing refers to any more are freed."""
        node.refs -= 1
        while not node.refs and node.parent is not None:
            up = node.parent
            up.kids.remove(node)
            up.refs -= 1
            node.parent, node = None, up

    @staticmethod
    def _suffix(a: Node, b: Node) -> tuple[str, str]:
        """Edits of both paths after their last common node."""
        x, y = [], []
        while a is not b:
            if a.depth >= b.depth:
                x.append(a.edit)
                a = a.parent
            else:
                y.append(b.edit)
                b = b.parent
        return "".join(reversed(x)), "".join(reversed(y))

    def _less(self, x: tuple[int, Node], y: tuple[int, Node]) -> bool:
        if x[0] != y[0]:
            return x[0] < y[0]
        a, b = self._suffix(x[1], y[1])
        return a < b

    def _offer(self, found: dict[int, tuple[int, Node]], state: int, path: tuple[int, Node]) -> None:
        """The better of a state's path and this one stays in `found`, the other is released."""
        path[1].refs += 1
        now = found.get(state)
        if now is None or self._less(path, now):
            found[state], path = path, now
        if path is not None:
            self._release(path[1])

    def _inserted(self, found: dict[int, tuple[int, Node]]) -> None:
        """Rows inserted where that is cheaper; more than a user and an assistant row in one place never pays."""
        for sources, letter, state in (((EMPTY, SYSTEM, ASSISTANT), "u", USER), ((USER,), "a", ASSISTANT)):
            for source in sources:
                if source in found:
                    cost, node = found[source]
                    if state not in found or cost + INSERT <= found[state][0]:
                        self._offer(found, state, (cost + INSERT, Node(node, "I", (None, _NAMES[letter], "", None))))

    def step(self, role: str, text: str, turn: int | None, fault: str | None) -> None:
        found: dict[int, tuple[int, Node]] = {}
        row = (turn, role, text, fault)
        for state, (cost, node) in self.paths.items():
            self._offer(found, state, (cost + DELETE, Node(node, "D", (turn, role, "", fault))))
        if fault not in ("blank", "duplicate"):
            extra, initial = TRUNCATED if fault else 0, role[:1]
            for state, (cost, node) in list(self.paths.items()):
                for letter, name in _NAMES.items():
                    if initial != letter and (to := _TO[letter].get(state)) is not None:
                        self._offer(found, to, (cost + extra + REROLE, Node(node, "R", (turn, name, text, fault))))
                if (to := _TO.get(initial, {}).get(state)) is not None:
                    self._offer(found, to, (cost + extra, Node(node, "K", row)))
        self._inserted(found)
        best = found.get(ASSISTANT)
        if SYSTEM in found and best and self._less(best, found[SYSTEM]):
            self._release(found.pop(SYSTEM)[1])
        if EMPTY in found and best and best[0] + DELETE < found[EMPTY][0]:
            self._release(found.pop(EMPTY)[1])
        self._replace(found)

    def _replace(self, found: dict[int, tuple[int, Node]]) -> None:
        old, self.paths = self.paths, found
        for _, node in old.values():
            self._release(node)

    def settle(self) -> Iterator[tuple[str, tuple]]:
        """(edit, row) of all that every survivor shares."""
        while self.root.refs == 1 and self.root.kids:
            child = self.root.kids.pop()
            child.parent = None
            self.root = child
            yield child.edit, child.row

    def finish(self) -> int:
        """Only the cheapest path to a whole conversation is left; its cost."""
        ends = [self.paths[s] for s in (EMPTY, ASSISTANT) if s in self.paths]
        best = ends[0] if len(ends) == 1 or self._less(ends[0], ends[1]) else ends[1]
        best[1].refs += 1
        self._replace({ASSISTANT: best})
        return best[0]

    def held(self) -> int:
        """Nodes that are not settled."""
        todo, n = [self.root], 0
        while todo:
            node = todo.pop()
            n += len(node.kids)
            todo.extend(node.kids)
        return n


def fault_of(text: str, first: bool) -> str | None:
    """A row's first fault; `first`: no earlier row of the conversation has its role and text."""
    bare = text.rstrip(SPACE)
    if not bare:
        return "blank"
    if not first:
        return "duplicate"
    return None if bare[-1] in ".!?" else "truncated"


class _Conversation:
    """A decoder with the counts of one conversation."""

    def __init__(self, key):
        self.key, self.decoder, self.seq, self.last, self.before = key, Decoder(), 0, None, None
        self.low = self.high = None
        self.turns = self.illegal = 0
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)

    def add(self, turn: int | None, role: str, text: str, first: bool) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        fault = fault_of(text, first)
        if fault:
            self.faults[fault] += 1
        self.decoder.step(role, text, turn, fault)

    def settled(self) -> Iterator[tuple]:
        for edit, (turn, role, text, fault) in self.decoder.settle():
            yield (self.key, self.seq, edit, turn, role, text, fault, None, None, None, None, None, None)
            self.seq += 1

    def closed(self) -> Iterator[tuple]:
        cost = self.decoder.finish()
        yield from self.settled()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        yield (self.key, self.seq, None, None, None, None, None, gaps, *self.faults.values(), self.illegal, cost)


def _decode(schema: pa.Schema, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, at = [], 0, None

        def flush() -> pa.RecordBatch:
            columns = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for key, turn, role, text, copies, first in zip(*(c.to_pylist() for c in batch.columns)):
                if at is None or at.key != key:
                    if at is not None:
                        out.extend(at.closed())
                    at = _Conversation(key)
                for i in range(copies):
                    at.add(turn, role, text, first and not i)
                    more = list(at.settled())
                    held += sum(len(x[5]) for x in more)
                    out.extend(more)
                if len(out) >= rows or held >= size:
                    yield flush()
                    out, held = [], 0
        if at is not None:
            out.extend(at.closed())
        if out:
            yield flush()

    return run


def repair(rows: DataFrame, copies: Column | None = None, batch_rows: int = 2000, batch_bytes: int = 4_000_000) -> DataFrame:
    """The cheapest edits of every conversation of rows (conv_id, turn, role, text), in order within a partition.

    Per edit: conv_id, seq (from 0), edit (K, R, D or I), turn, role and text after the edit (a deleted row: no text), fault
    (blank, duplicate or truncated); rows whose edit is K, R or I are the repaired conversation. Per conversation one last
    row without edit: gaps, blank, duplicate, truncated, illegal and cost. `copies`: how often a row occurs, 0 for one that
    is missing, whose conversation still gets its last row.
    """
    n = copies if copies is not None else F.lit(1)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    flat = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), n.cast("int").alias("copies"))
    parted = flat.repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", "text", F.col("copies") > 0).orderBy(F.col("turn").asc_nulls_first())
    ordered = parted.withColumn("first", F.row_number().over(same) == 1).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", F.desc("first"))
    fields = [T.StructField("conv_id", rows.schema["conv_id"].dataType), *T._parse_datatype_string(_EDITS)]
    schema = T.StructType(fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    return ordered.mapInArrow(_decode(to_arrow_schema(schema), batch_rows, batch_bytes), schema)


def audits(edits: DataFrame) -> DataFrame:
    """Per conversation of repair()'s rows as they come: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (the
    edits' letters) and repaired_sha256 over its `role:text` lines. Texts stream into the hash; only letters are held."""
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, audit, lines, out = hashlib.sha256(), [], 0, []
        for batch in batches:
            names = ["conv_id", "edit", "role", "text", *counts]
            for key, edit, role, text, *last in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names)):
                if edit is None:
                    out.append((key, *last, "".join(audit), digest.hexdigest()))
                    digest, audit, lines = hashlib.sha256(), [], 0
                    continue
                audit.append(edit)
                if edit != "D":
                    digest.update((("\n" if lines else "") + f"{role}:{text}").encode())
                    lines += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=result)
                out = []

    result = ["conv_id", *counts, "audit", "repaired_sha256"]
    schema = T.StructType([edits.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in counts), *(T.StructField(c, T.StringType()) for c in result[-2:])])
    from pyspark.sql.pandas.types import to_arrow_schema

    types = [f.type for f in to_arrow_schema(schema)]
    return edits.mapInArrow(run, schema)


def damage(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Rows damaged by crc32 of `conv_id:turn` modulo 20, with their number of copies: 0 drops a row, 1 empties its text, 2
    takes its `.!?`, 3 repeats it, 4 makes it the user's."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(value("conv_id"), F.lit(":"), value("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(value("text"), ".!?", "")).otherwise(value("text"))
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(value("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))
    return rows, F.col("copies")

"""Cheapest repair of conversations to the order system, then user and assistant in turns.

What a repair costs depends on a row's role and fault alone, so a conversation is a string
of signatures. All strings are read from their ends: sorted by their reversals, those that
share an ending follow one another, and each distinct ending is one node of an acyclic
automaton that is made once, with the cost-to-go and the best edits for every state of the
grammar. Strings are cut into blocks, so a long conversation is a chain of blocks that share
nodes with all others; a node's table therefore says, for each state that a block is entered
in, what it costs to leave it in each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import pick
from faultline.session import lookup_join, materialize

# Fixed values of the contract: costs of edits and the penalty of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# States of the grammar: nothing yet, after system, after user, after assistant. Per state,
# what role initials lead to, and the role that may be inserted or given.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
GIVEN = ("user", "user", "assistant", "user")
# What is inserted after the last row, for each state.
CLOSING = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
# Rows in a block at most.
BLOCK = 256
# Characters of a text that order rows of one turn and role; then a hash does.
PREFIX = 32

Table = list[dict[int, tuple[int, str]]]  # [state at the start][state at the end] = cost, edits

BLOCKS = "c string, part int, block long, sig string, blank long, duplicate long, truncated long"
TABLES = "sig string, steps array<struct<s:int,t:int,cost:long,audit:string>>"
CHOICES = BLOCKS.replace("sig string", "cost long, chosen array<struct<t:int,audit:string>>")


def clean(conversations: DataFrame) -> DataFrame:
    """(c, turn, role, text): nulls of role and text as one space, ids as text."""
    rows = pick(conversations, "conv_id", "turn", "role", "text", conv_id="long", turn="long", role="string", text="string")
    return rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("c"),
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage to rows of ``clean``, by a checksum of id and turn."""
    key = F.concat_ws(":", "c", F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hit = rows.withColumn("_kind", F.crc32(key) % 20).where(F.col("_kind") != 0)
    kind = F.col("_kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    return hit.select("c", "turn", role.alias("role"), text.alias("text"), copies).drop("_copy")


def ordered(rows: DataFrame) -> DataFrame:
    """What rows of a conversation are ordered by: turn, role, start and hash of the text."""
    return rows.withColumn("prefix", F.left("text", F.lit(PREFIX))).withColumn("h", F.unhex(F.md5("text")))


ORDER = ("turn", "role", "prefix", "h")


def seen_before(rows: DataFrame) -> DataFrame:
    """(c, role, h, since, empty) of texts in several turns: the first one, and if a null one is there.

    Copies are folded where they lie, so many of one text do not meet in a task.
    """
    groups = rows.groupBy("c", "role", "h").agg(
        F.min("turn").alias("since"), F.max("turn").alias("_last"), F.bool_or(F.col("turn").isNull()).alias("empty")
    )
    later = F.col("_last").isNotNull() & (F.col("empty") | (F.col("since") < F.col("_last")))
    return materialize(groups.where(later).drop("_last"), "repair-repeats")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures of neighbouring rows of a conversation, in blocks; rows arrive in order."""
    part, block = TaskContext.get().partitionId(), 0
    out: list[tuple] = []
    sig: list[str] = []
    tally = [0, 0, 0]
    last = None

    def close() -> None:
        nonlocal sig, tally, block
        if sig:
            out.append((last[0], part, block, "".join(sig), *tally))
            sig, tally, block = [], [0, 0, 0], block + 1

    for batch in batches:
        for c, role, h, blank, truncated, repeated in zip(*(column.to_pylist() for column in batch.columns)):
            if last is not None and (last[0] != c or len(sig) == BLOCK):
                close()
            fault = 0 if blank else 1 if repeated or last == (c, role, h) else 2 if truncated else None
            if fault is not None:
                tally[fault] += 1
            initial = role[0] if role[:1] in ("s", "u", "a") else "o"
            sig.append("x" if fault in (0, 1) else initial.upper() if fault == 2 else initial)
            last = (c, role, h)
        if len(out) > 1000:
            yield _rows(out, BLOCKS)
            out = []
    close()
    if out:
        yield _rows(out, BLOCKS)


_KINDS = {
    "string": pa.string(),
    "int": pa.int32(),
    "long": pa.int64(),
    "array<struct<s:int,t:int,cost:long,audit:string>>": pa.list_(
        pa.struct([("s", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    ),
    "array<struct<t:int,audit:string>>": pa.list_(pa.struct([("t", pa.int32()), ("audit", pa.string())])),
}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = [pa.array(values, _KINDS[kind]) for values, (_, kind) in zip(zip(*rows), fields)]
    return pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])


def signatures(rows: DataFrame) -> DataFrame:
    """Blocks (c, part, block, sig, blank, duplicate, truncated) of all conversations.

    Signatures: ``x`` has to go (blank or seen before), else the role's initial, ``o`` for
    any other than s, u and a, as a capital where the text is truncated. Rows are cut by
    value of (conversation, turn, role, text), so a long conversation spreads over tasks;
    parts and blocks give the order.
    """
    word = "[^\\x20\\x09-\\x0D]"
    light = rows.select(
        "c", *ORDER,
        (~F.col("text").rlike(word)).alias("blank"),
        (~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")).alias("truncated"),
    )
    found = lookup_join(light, seen_before(light), ["c", "role", "h"], "left", spread=["turn", "prefix"])
    repeated = F.col("turn").isNotNull() & (F.coalesce("empty", F.lit(False)) | (F.col("turn") > F.col("since")))
    found = found.withColumn("repeated", F.coalesce(repeated, F.lit(False)))
    inputs = found.repartitionByRange("c", "turn", "role", "prefix").sortWithinPartitions("c", *ORDER)
    return inputs.select("c", "role", "h", "blank", "truncated", "repeated").mapInArrow(_blocks, BLOCKS)


def end_node() -> Table:
    return [{s: (0, "")} for s in range(len(STEPS))]


def node(symbol: str, after: Table) -> Table:
    """The table of an ending from that of the ending one row shorter.

    Inserts come before a row only, so no edits of a block are the beginning of others of
    the same block, and the least edits stay least whatever follows.
    """
    low = symbol.lower()
    stay = TRUNCATED if symbol != low else 0
    table: Table = []
    for s in range(len(STEPS)):
        ways = [(DELETE, "D", s)]
        if low != "x":
            if low in STEPS[s]:
                ways.append((stay, "K", STEPS[s][low]))
            ways.append((REROLE + stay, "R", STEPS[s][GIVEN[s][0]]))
        best: dict[int, tuple[int, str]] = {}
        for cost, edit, then in ways:
            for t, (rest, audit) in after[then].items():
                option = (cost + rest, edit + audit)
                if t not in best or option < best[t]:
                    best[t] = option
        table.append(best)
    for _ in STEPS:  # an insert leads to another state before the same row
        for s in range(len(STEPS)):
            for t, (rest, audit) in list(table[STEPS[s][GIVEN[s][0]]].items()):
                option = (INSERT + rest, "I" + audit)
                if t not in table[s] or option < table[s][t]:
                    table[s][t] = option
    return table


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tables of distinct signatures that arrive in the order of their reversals.

    Nodes of the ending at hand are on a stack; the next string keeps those it shares.
    """
    stack, before = [end_node()], ""
    for batch in batches:
        out = []
        for sig in batch.column(0).to_pylist():
            back = sig[::-1]
            same = next((i for i, (x, y) in enumerate(zip(back, before)) if x != y), min(len(back), len(before)))
            del stack[same + 1 :]
            for symbol in back[same:]:
                stack.append(node(symbol, stack[-1]))
            before = back
            steps = [
                {"s": s, "t": t, "cost": cost, "audit": audit}
                for s, ways in enumerate(stack[-1]) for t, (cost, audit) in ways.items()
            ]
            out.append((sig, steps))
            if len(out) == 500:
                yield _rows(out, TABLES)
                out = []
        if out:
            yield _rows(out, TABLES)


def automaton(blocks: DataFrame) -> DataFrame:
    """(sig, steps) of every distinct signature: costs and edits by state before and after."""
    distinct = blocks.select("sig").distinct().withColumn("_back", F.reverse("sig"))
    inputs = distinct.repartitionByRange("_back").sortWithinPartitions("_back").select("sig")
    return materialize(inputs.mapInArrow(_endings, TABLES), "repair-automaton")


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a conversation's last block to its first: the way on from each state, and its cost."""
    conversation, costs = None, []
    for batch in batches:
        out = []
        names = batch.schema.names
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            row = dict(zip(names, row))
            if row["c"] != conversation:
                conversation, costs = row["c"], [cost for cost, _ in CLOSING]
            best: list = [None] * len(STEPS)
            for step in row["steps"]:
                option = (step["cost"] + costs[step["t"]], step["audit"], step["t"])
                if best[step["s"]] is None or option < best[step["s"]]:
                    best[step["s"]] = option
            costs = [b[0] for b in best]
            chosen = [{"t": t, "audit": audit} for _, audit, t in best]
            out.append((row["c"], row["part"], row["block"], costs[0], chosen, row["blank"], row["duplicate"], row["truncated"]))
        if out:
            yield _rows(out, CHOICES)


def plans(rows: DataFrame) -> DataFrame:
    """(c, part, block, cost, chosen, ...): for each block and state the best edits and the next state.

    ``cost`` is what the rest costs from the grammar's start on: in the first block, all.
    """
    blocks = materialize(signatures(rows), "repair-blocks")
    tabled = lookup_join(blocks, automaton(blocks), ["sig"], spread=["c", "part", "block"])
    inputs = tabled.repartition("c").sortWithinPartitions("c", F.desc("part"), F.desc("block"))
    return inputs.mapInArrow(_chosen, CHOICES)


DIGESTS = (
    "c string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)
REPAIRED = "c string, place long, edit string, role string, text string"


class Conversation:
    """One conversation as its rows pass by in order: repaired lines, counts and the digest."""

    def __init__(self, c: str):
        self.c, self.state, self.edits = c, 0, []
        self.cost, self.faults = None, [0, 0, 0]
        self.first = self.last = None
        self.turns = self.illegal = 0
        self.initial: str | None = None
        self.audit, self.at = "", 0
        self.sha, self.lines = hashlib.sha256(), 0

    def plan(self, cost: int, chosen: list[dict], faults: tuple) -> None:
        """The next block's edits; blocks come before rows."""
        self.cost = cost if self.cost is None else self.cost
        self.faults = [a + b for a, b in zip(self.faults, faults)]
        self.edits.append(chosen[self.state]["audit"])
        self.state = chosen[self.state]["t"]

    def begin(self) -> None:
        """After the last block: close the plan, and start again from the first row."""
        self.audit = "".join(self.edits) + (CLOSING[self.state][1] if self.edits else "")
        self.edits, self.state = [], 0

    def line(self, edit: str, role: str, text: str) -> tuple:
        self.state = STEPS[self.state][role[0]]
        self.sha.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
        self.lines += 1
        return (self.c, self.lines, edit, role, text)

    def inserted(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self.line("I", GIVEN[self.state], "")

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self.line(edit, role if edit == "K" else GIVEN[self.state], text)

    def digest(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.c, gaps, *self.faults, self.illegal, self.cost or 0, self.audit, self.sha.hexdigest())


def _walk(lines: bool):
    """Conversations one after another, each with its plan first and then its rows in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = REPAIRED if lines else DIGESTS
        now: Conversation | None = None
        begun = False
        out: list[tuple] = []
        held = 0

        def end() -> Iterator[tuple]:
            if now is not None:
                if not begun:
                    now.begin()
                yield from now.inserted() if lines else _drained(now.inserted())
                if not lines:
                    yield now.digest()

        for batch in batches:
            names = batch.schema.names
            for values in zip(*(column.to_pylist() for column in batch.columns)):
                r = dict(zip(names, values))
                if now is None or r["c"] != now.c:
                    out += end()
                    now, begun = Conversation(r["c"]), False
                if r["tag"] == 1:
                    now.plan(r["cost"], r["chosen"], (r["blank"], r["duplicate"], r["truncated"]))
                elif r["tag"] == 2:
                    if not begun:
                        now.begin()
                        begun = True
                    found = list(now.row(r["turn"], r["role"], r["text"]))
                    held += len(r["text"])
                    if lines:
                        out += found
                if len(out) >= 1000 or (out and held > 1 << 22):
                    yield _rows(out, schema)
                    out, held = [], 0
        out += end()
        if out:
            yield _rows(out, schema)

    return run


def _drained(lines: Iterator[tuple]) -> Iterator[tuple]:
    for _ in lines:
        pass
    return iter(())


def _streamed(rows: DataFrame, ids: DataFrame | None, lines: bool) -> DataFrame:
    rows = ordered(rows)
    parts = plans(rows).withColumn("tag", F.lit(1))
    texts = rows.withColumn("tag", F.lit(2))
    both = parts.unionByName(texts, allowMissingColumns=True)
    if ids is not None:
        both = both.unionByName(ids.select("c").distinct().withColumn("tag", F.lit(0)), allowMissingColumns=True)
    inputs = both.repartition("c").sortWithinPartitions("c", "tag", "part", "block", *ORDER)
    return inputs.mapInArrow(_walk(lines), REPAIRED if lines else DIGESTS)


def _conv_id():
    return F.when(F.col("c") != " ", F.col("c")).cast("long").alias("conv_id")


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the lines of every repaired conversation.

    ``edit``: K kept, R given another role, I inserted with an empty text. Rows are taken by
    turn, null turns first; rows of one turn by role, start and hash of the text, so input
    order plays no part and repeated rows are neighbours. Null roles and texts are one space;
    a null id is a conversation of its own. A role with another initial than s, u or a,
    an empty one too, can't be kept. Further columns are not looked at. An empty table, and a
    conversation whose rows all have to go, give no lines.
    """
    found = _streamed(clean(conversations), None, True)
    return found.select(_conv_id(), "place", "edit", "role", "text")


def digests(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Per conversation of ``ids``: counts of gaps and faults, cost, edits, hash of the repaired text.

    ``rows`` are (c, turn, role, text) as ``clean`` gives them. An id without rows has zeros,
    no edits and the hash of the empty text. One conversation's text is hashed in one task,
    as SHA-256 runs through its bytes in order; its rows stream by and are not kept, while
    faults, signatures and costs of a long conversation are found in many tasks.
    """
    found = _streamed(rows, ids, False)
    return found.select(_conv_id(), *[n.split(" ")[0] for n in DIGESTS.split(", ")[1:]])

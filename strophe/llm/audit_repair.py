"""Cheapest repair of conversations, kept as an audit of edits, by dynamic programming."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.llm.common import load
from strophe.session import cut_lineage

#: Messages that one run of the dynamic program covers; longer conversations are put together
#: from such pieces.
PIECE = 2048
DELETE, INSERT, REROLE, BROKEN = 2, 5, 1, 5
#: What was read so far: nothing, a system message, a user's, an assistant's (or a whole exchange).
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = (EMPTY, SYSTEM, USER, ASSISTANT)
_KEEP = {
    (EMPTY, "s"): SYSTEM,
    (EMPTY, "u"): USER,
    (SYSTEM, "u"): USER,
    (ASSISTANT, "u"): USER,
    (USER, "a"): ASSISTANT,
}
#: The state after a user's or assistant's message that an edit makes.
_MADE = {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_VISIBLE = r"[^\x20\x09-\x0D]"

_PIECES = (
    "conv_id {id}, part int, piece int, "
    "costs array<long>, audits array<string>"
)
_TRAIL = (
    "conv_id {id}, edit string, turn long, old_role string, role string, text string, "
    "fault string, cost long"
)


def damage(turns: DataFrame) -> DataFrame:
    """Conversations with faults by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 sets the role user.
    Null roles and texts, and null ids and turns inside the hashed string, count as one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "utf-8")) % 20
    text = F.when(F.col("kind") == 1, "").when(
        F.col("kind") == 2, F.translate(space("text"), ".!?", "")
    )
    return (
        turns.select("conv_id", "turn", "role", "text", kind.alias("kind"))
        .where("kind <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("kind") == 4, "user").otherwise(space("role")).alias("role"),
            text.otherwise(space("text")).alias("text"),
            F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias(
                "copy"
            ),
        )
        .drop("copy")
    )


def messages(turns: DataFrame) -> DataFrame:
    """Distinct rows of every conversation with their count and faults, written once.

    conv_id, turn, role, text, digest, copies; blank; repeated: role and text appear at an earlier
    turn; broken: the last visible character ends no sentence. Equal rows are counted, so no number
    of copies makes a large group.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    counted = (
        turns.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
        .groupBy("conv_id", "turn", "role", "text")
        .agg(F.count("*").alias("copies"))
        .withColumn("digest", F.unhex(F.sha2("text", 256)))
    )
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = counted.groupBy(
        F.col("conv_id").alias("__id"), F.col("role").alias("__role"), F.col("digest").alias("__of")
    ).agg(F.min(place).alias("__first"))
    same = (
        F.col("conv_id").eqNullSafe(F.col("__id"))
        & (F.col("role") == F.col("__role"))
        & (F.col("digest") == F.col("__of"))
    )
    ending = F.regexp_extract("text", rf"({_VISIBLE})[\x20\x09-\x0D]*\z", 1)
    return cut_lineage(
        counted.join(first, same).select(
            "conv_id",
            "turn",
            "role",
            "text",
            "digest",
            "copies",
            (ending == "").alias("blank"),
            (~place.eqNullSafe(F.col("__first"))).alias("repeated"),
            (~ending.isin(".", "!", "?")).alias("broken"),
        ),
        "messages",
    )


class Audits:
    """Edit strings as nodes of a tree: equal beginnings are stored once.

    Every node knows its letter, depth, the rolling hash of its whole string and its ancestors 1,
    2, 4, ... steps up. Two strings are compared at their longest common prefix, which is found by
    lifting both nodes as long as the hashes differ; the prefix is then verified letter by letter.
    """

    BASE, MOD = 0x1F123BB5, (1 << 61) - 1

    def __init__(self):
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [[]]

    def add(self, node: int, letter: str) -> int:
        up, lifted, step = [node], self.up, 0
        while len(lifted[up[step]]) > step:
            up.append(lifted[up[step]][step])
            step += 1
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.BASE + ord(letter)) % self.MOD)
        lifted.append(up)
        return len(lifted) - 1

    def ancestor(self, node: int, depth: int) -> int:
        rise = self.depth[node] - depth
        while rise:
            step = rise.bit_length() - 1
            node = self.up[node][step]
            rise -= 1 << step
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _same(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth stand for one string; ends where the paths meet."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.hash[x] == self.hash[y]:
            if self._same(x, y):
                return self.depth[a] < self.depth[b]
            return self.text(a) < self.text(b)  # a collision
        for step in reversed(range(len(self.up[x]))):
            if step < len(self.up[x]):
                p, q = self.up[x][step], self.up[y][step]
                if self.hash[p] != self.hash[q]:
                    x, y = p, q
        p, q = self.up[x][0], self.up[y][0]
        if self.letter[x] == self.letter[y] or not self._same(p, q):  # a collision
            return self.text(a) < self.text(b)
        return self.letter[x] < self.letter[y]


class _Run:
    """The dynamic program over consecutive messages from one state."""

    def __init__(self, start: int):
        self.audits = Audits()
        self.best: list[tuple[int, int] | None] = [None] * 4
        self.best[start] = (0, 0)
        self._insert(self.best)

    def _offer(self, into: list, state: int, cost: int, node: int, letter: str) -> None:
        old = into[state]
        if old is None or cost < old[0]:
            into[state] = (cost, self.audits.add(node, letter))
        elif cost == old[0]:
            new = self.audits.add(node, letter)
            if self.audits.less(new, old[1]):
                into[state] = (cost, new)

    def _insert(self, into: list) -> None:
        """Two rounds do: an insertion takes a user's turn next, then an assistant's."""
        for state in (EMPTY, SYSTEM, ASSISTANT, USER):
            if into[state] is not None:
                cost, node = into[state]
                self._offer(into, _MADE[state], cost + INSERT, node, "I")

    def read(self, initial: str, faulty: bool, broken: bool) -> None:
        new: list[tuple[int, int] | None] = [None] * 4
        extra = BROKEN if broken else 0
        for state in STATES:
            if self.best[state] is None:
                continue
            cost, node = self.best[state]
            self._offer(new, state, cost + DELETE, node, "D")
            if not faulty:
                kept = _KEEP.get((state, initial))
                if kept is not None:
                    self._offer(new, kept, cost + extra, node, "K")
                self._offer(new, _MADE[state], cost + REROLE + extra, node, "R")
        self._insert(new)
        self.best = new


def _piece(runs: list[_Run | None]) -> tuple[list, list]:
    """Costs and audits from every state to every state; null where there is no way."""
    costs, audits = [], []
    for run in runs:
        for state in STATES:
            end = None if run is None else run.best[state]
            costs.append(None if end is None else end[0])
            audits.append(None if end is None else run.audits.text(end[1]))
    return costs, audits


def _pieces(lines: DataFrame, kind: str, size: int) -> DataFrame:
    """The dynamic program over runs of at most ``size`` messages of one conversation.

    Rows are dealt out by ranges of (conversation, turn), which cut long conversations too. Where a
    task can't know what came before, its first runs start from all four states.
    """
    initial = F.substring("role", 1, 1)
    narrow = lines.select(
        "conv_id", "turn", "role", "digest", "copies", "blank", "repeated", "broken",
        initial.alias("initial"),
    )
    keys = ["conv_id", "turn", "role", "digest"]
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = narrow.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    fields = ("copies", "blank", "repeated", "broken", "initial")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids: list = []
        found: list[tuple[int, list, list]] = []
        now: tuple = ()  # the conversation, in a tuple of its own as its id may be null
        runs: list[_Run | None] = []
        number = length = 0
        fresh = False

        def begin() -> None:
            nonlocal runs, length
            only = fresh and number == 0
            runs = [_Run(s) if s == EMPTY or not only else None for s in STATES]
            length = 0

        def finish() -> None:
            nonlocal number
            found.append((number, *_piece(runs)))
            ids.append(now[0])
            number += 1

        def batch_of(type_: pa.DataType) -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, type_),
                    pa.array([part] * len(ids), pa.int32()),
                    pa.array([f[0] for f in found], pa.int32()),
                    pa.array([f[1] for f in found], pa.list_(pa.int64())),
                    pa.array([f[2] for f in found], pa.list_(pa.string())),
                ],
                names=["conv_id", "part", "piece", "costs", "audits"],
            )
            ids.clear()
            found.clear()
            return out

        type_ = None
        for batch in batches:
            type_ = batch.schema.field("conv_id").type
            values = zip(
                batch.column("conv_id").to_pylist(),
                *[batch.column(f).to_pylist() for f in fields],
                strict=True,
            )
            for conv, copies, blank, repeated, broken, letter in values:
                if now != (conv,):
                    if now:
                        finish()
                    fresh, now, number = bool(now), (conv,), 0
                    begin()
                for copy in range(copies):
                    if length == size:
                        finish()
                        begin()
                    faulty = blank or repeated or copy > 0
                    for run in runs:
                        if run is not None:
                            run.read(letter, faulty, broken)
                    length += 1
            if ids:
                yield batch_of(type_)
        if now:
            finish()
            yield batch_of(type_)

    return ordered.mapInArrow(solve, _PIECES.format(id=kind))


def _chained(frame: pd.DataFrame) -> pd.DataFrame:
    """One piece or two that follow each other as one."""
    frame = frame.sort_values("piece")
    whole = frame.iloc[0].copy()
    if len(frame) == 2:
        left, right = frame.iloc[0], frame.iloc[1]
        costs, audits = [], []
        for a in STATES:
            for b in STATES:
                ways = [
                    (
                        left["costs"][4 * a + m] + right["costs"][4 * m + b],
                        left["audits"][4 * a + m] + right["audits"][4 * m + b],
                    )
                    for m in STATES
                    if left["audits"][4 * a + m] is not None
                    and right["audits"][4 * m + b] is not None
                ]
                cost, audit = min(ways, default=(None, None))
                costs.append(cost)
                audits.append(audit)
        whole["costs"], whole["audits"] = costs, audits
    whole["piece"] = whole["piece"] // 2
    return pd.DataFrame([whole])


def audits(lines: DataFrame, size: int = PIECE) -> DataFrame:
    """(conv_id, cost, audit): the cheapest edits of every conversation of ``lines``.

    Pieces of long conversations are joined in pairs, then pairs of pairs, so no group holds more
    than two; a comparison of ties is then one of two strings of equal cost.
    """
    kind = lines.schema["conv_id"].dataType.simpleString()
    pieces = cut_lineage(_pieces(lines, kind, size), "pieces")
    counts = pieces.groupBy(F.col("conv_id").alias("__id")).agg(F.count("*").alias("n"))
    counted = pieces.join(counts, F.col("conv_id").eqNullSafe(F.col("__id"))).drop("__id")
    columns = ["conv_id", "costs", "audits"]
    whole = counted.where("n = 1").select(*columns)
    order = Window.partitionBy("conv_id").orderBy("part", "piece")
    rest = cut_lineage(
        counted.where("n > 1").select(
            "conv_id", (F.row_number().over(order) - 1).alias("piece"), "costs", "audits"
        ),
        "pieces",
    )
    form = rest.schema
    while True:
        last = rest.agg(F.max("piece")).first()[0]
        if not last:
            break
        rest = cut_lineage(
            rest.groupBy("conv_id", F.floor(F.col("piece") / 2)).applyInPandas(_chained, form),
            "pieces",
        )
    whole = whole.unionByName(rest.select(*columns))
    ends = [
        F.struct(F.get("costs", F.lit(s)).alias("cost"), F.get("audits", F.lit(s)).alias("audit"))
        for s in (EMPTY, ASSISTANT)
    ]
    best = F.array_min(F.filter(F.array(*ends), lambda e: e["audit"].isNotNull()))
    return whole.select("conv_id", best.alias("best")).select("conv_id", "best.*")


def repair(turns: DataFrame, size: int = PIECE) -> DataFrame:
    """The audit trail of the cheapest repair: one row per edit, in order within a conversation.

    ``turns`` has conv_id, turn, role and text; other columns are ignored. Null roles and texts
    count as one space; a null conv_id is one conversation. Messages go by turn, nulls first, then
    role and the SHA-256 of the text; equal rows each count. Roles must come to ``(s?(ua)+)?`` by
    initials. Returns conv_id, edit (Keep, Rerole, Delete, Insert by initial), turn, old_role and
    role (null where there is none), text, fault (blank, duplicate, truncated or null) and cost. The
    repaired conversation is the rows whose role is not null. Of the cheapest audits the least by
    ASCII is taken. Empty texts are blank; a role without a first letter can't be kept. An empty
    table gives an empty trail.

    A conversation's texts pass one task as a sorted stream, as its digest later has to; only its
    audit, a letter per edit, is held.
    """
    lines = messages(turns)
    kind = lines.schema["conv_id"].dataType.simpleString()
    shown = lines.select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "digest", "copies", "blank",
        "repeated", "broken",
    )
    plans = audits(lines, size).select(
        "conv_id",
        F.lit(0).alias("kind"),
        F.col("audit").alias("text"),
        *[F.lit(None).cast(shown.schema[c].dataType).alias(c) for c in shown.columns
          if c not in ("conv_id", "kind", "text")],
    )
    ordered = (
        shown.unionByName(plans)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    )
    names = ["conv_id", "edit", "turn", "old_role", "role", "text", "fault", "cost"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state = "", 0, EMPTY
        out: list[tuple] = []
        now = type_ = None

        def inserted() -> None:
            """Insertions that come before the next message or the end."""
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state = _MADE[state]
                out.append((now, "I", None, None, _ROLE[state], "", None, INSERT))
                at += 1

        def batch_of() -> pa.RecordBatch:
            kinds = [type_, pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64()]
            columns = zip(*out, strict=True)
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(made, names=names)

        for batch in batches:
            type_ = batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    inserted()  # after the last message of the one before
                    now, audit, at, state = row["conv_id"], row["text"], 0, EMPTY
                    continue
                role, text = row["role"], row["text"]
                for copy in range(row["copies"]):
                    inserted()
                    edit = audit[at]
                    at += 1
                    if row["blank"]:
                        fault = "blank"
                    elif row["repeated"] or copy:
                        fault = "duplicate"
                    else:
                        fault = "truncated" if row["broken"] else None
                    new, cost = role, DELETE
                    if edit == "D":
                        new = None
                    else:
                        cost = BROKEN if fault == "truncated" else 0
                        if edit == "K":
                            state = _KEEP[state, role[:1]]
                        else:
                            state = _MADE[state]
                            new, cost = _ROLE[state], cost + REROLE
                    out.append((now, edit, row["turn"], role, new, text, fault, cost))
                    if len(out) >= 4096:
                        yield batch_of()
            if out:
                yield batch_of()
        inserted()
        if out:
            yield batch_of()

    return ordered.mapInArrow(apply, _TRAIL.format(id=kind))


_REPORT = (
    "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


class _Report:
    """What one pass over a conversation's trail adds up."""

    def __init__(self):
        self.least = self.most = self.turn = None
        self.turns = self.illegal = self.cost = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.audit: list[str] = []
        self.before: str | None = None
        self.hash, self.begun = hashlib.sha256(), False

    def add(self, edit, turn, old_role, role, text, fault, cost) -> None:
        self.audit.append(edit)
        self.cost += cost
        if fault:
            self.faults[fault] += 1
        if edit != "I":
            initial = old_role[:1]
            if self.before is not None and self.before + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = initial
            if turn is not None and turn != self.most:  # turns ascend
                self.least = turn if self.least is None else self.least
                self.most = turn
                self.turns += 1
        if role is not None:
            self.hash.update((("\n" if self.begun else "") + f"{role}:{text}").encode())
            self.begun = True

    def row(self) -> tuple:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        return (gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit),
                self.hash.hexdigest())


def report(trail: DataFrame) -> DataFrame:
    """One row per conversation of a trail that ``repair`` has just made: faults, cost and digest.

    Reads the rows in the order in which ``repair`` leaves them, without another shuffle.
    """
    kind = trail.schema["conv_id"].dataType.simpleString()
    form = _REPORT.format(id=kind)
    names = [c.split()[0] for c in form.split(", ")]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple = ()
        sums, done, type_ = _Report(), [], None

        def batch_of() -> pa.RecordBatch:
            kinds = [type_, *[pa.int64()] * 6, pa.string(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            type_ = batch.schema.field("conv_id").type
            for conv, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now != (conv,):
                    if now:
                        done.append((now[0], *sums.row()))
                    now, sums = (conv,), _Report()
                sums.add(*row)
            if done:
                yield batch_of()
        if now:
            done.append((now[0], *sums.row()))
            yield batch_of()

    return trail.mapInArrow(add_up, form)


def op12_audit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    found = report(repair(damage(turns)))
    ids = turns.select(F.col("conv_id").alias("__id")).distinct()
    nothing = hashlib.sha256().hexdigest()
    filled: list[Column] = [
        F.coalesce(c, F.lit("" if c == "audit" else nothing if c == "repaired_sha256" else 0)).alias(c)
        for c in found.columns[1:]
    ]
    return ids.join(found, F.col("__id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("__id").alias("conv_id"), *filled
    )

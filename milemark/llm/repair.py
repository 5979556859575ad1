"""Conversation structure repair: cheapest edits to a legal order of roles, by Viterbi with coalescing survivors.

Each legal state keeps one survivor, a node in a tree of backpointers with reference counts. As soon as all survivors
share an ancestor, the edits up to it are emitted and forgotten. Survivors that can't win any more are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from milemark.llm import common

# States by the roles so far: nothing, a system turn, a user turn last, an assistant turn last.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {START: "su", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ENDS = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
# Edits of one emitted row at most.
PIECE = 1 << 15
BLANKS = " \t\n\x0b\x0c\r"
LAST = (1 << 63) - 1


def _inserted() -> list[tuple[int, str, int]]:
    """(from, edits, to): one or two inserted turns; more never pay."""
    out = []
    for a in AFTER:
        b = STATE[AFTER[a][-1]]
        out += [(a, "I", b), (a, "II", STATE[AFTER[b][-1]])]
    return [(a, x, b) for a, x, b in out if a != b]


INSERTED = _inserted()
# Edits that a state may need at most beyond the best ones of another state to end as that one does: what it lacks is
# inserted; after the start a system turn must go.
BEHIND = {(a, b): INSERT * len(x) for a, x, b in INSERTED} | {(a, a): 0 for a in AFTER}
for _a in AFTER:
    BEHIND.setdefault((_a, START), BEHIND.get((_a, ASSISTANT), 0) + DELETE)
    BEHIND[_a, SYSTEM] = min(BEHIND.get((_a, SYSTEM), 99), BEHIND.get((_a, ASSISTANT), 99))
BEHIND[START, ASSISTANT] = BEHIND[START, SYSTEM] = 0


def steps(initial: str, fault: str) -> list[tuple[int, str, int, int]]:
    """(from, edits, cost, to) for a row: turns put in before it, then its own edit."""
    before = [(a, "", a) for a in AFTER] + INSERTED
    more = CUT if fault == "t" else 0
    out = []
    for a, x, b in before:
        cost = INSERT * len(x)
        if not x:  # a turn put in before a deleted row may as well follow it
            out.append((a, "D", DELETE, b))
        if fault in ("b", "d"):
            continue
        if initial and initial in AFTER[b]:
            out.append((a, x + "K", cost + more, STATE[initial]))
        out.append((a, x + "R", cost + REROLE + more, STATE[AFTER[b][-1]]))
    return out


_STEPS = {(i, f): steps(i, f) for i in ("s", "u", "a", "") for f in ("", "b", "d", "t")}


@dataclass(eq=False, slots=True)
class Node:
    """A row's edits in the tree of backpointers; ``refs`` counts its children, and 1 more while it is a survivor."""

    edits: str
    parent: Node | None
    refs: int = 1
    children: list[Node] = field(default_factory=list)


@dataclass(eq=False, slots=True)
class Survivor:
    node: Node
    cost: int
    rank: int  # the place of its whole unresolved suffix among those of all survivors, in ASCII order


class Repair:
    """Cheapest edits from one state on, row by row.

    Of equally cheap ways to a state the one with the ASCII-least edits stays. No edits of as many rows are a prefix of
    others (all end with a row's own edit), so the order of two ways is that of their unresolved suffixes, then that of
    the new row's edits: the ranks keep the order of whole suffixes, however far back they part.
    """

    def __init__(self, entry: int):
        self.root = Node("", None)
        self.states = {entry: Survivor(self.root, 0, 0)}
        self.out: list[str] = []

    def add(self, initial: str, fault: str) -> None:
        """A row by its role's first letter and its fault: ``b`` blank, ``d`` duplicate, ``t`` truncated or none."""
        best: dict[int, tuple[int, int, str, int]] = {}
        states = self.states
        for a, x, cost, b in _STEPS[initial if initial in STATE else "", fault]:
            if a in states:
                was = states[a]
                way = (was.cost + cost, was.rank, x, a)
                if b not in best or way < best[b]:
                    best[b] = way
        # Ways that cost more than another one whatever follows are dropped; ties stay.
        kept = {b: w for b, w in best.items() if all(v[0] + BEHIND[c, b] >= w[0] for c, v in best.items())}
        rank = {b: k for k, (_, b) in enumerate(sorted((w[1:3], b) for b, w in kept.items()))}
        new = {}
        for b, (cost, _, x, a) in kept.items():
            parent = states[a].node
            node = Node(x, parent)
            parent.refs += 1
            parent.children.append(node)
            new[b] = Survivor(node, cost, rank[b])
        for was in states.values():
            self._release(was.node)
        self.states = new
        # Edits up to the last ancestor that all survivors share are settled.
        while self.root.refs == 1 and self.root.children:
            self.root = self.root.children[0]
            self.root.parent = None
            self.out.append(self.root.edits)

    def deleted(self, n: int) -> None:
        """``n`` more rows like the last one, all to be deleted: the same for every survivor."""
        settled = self.root.refs == 1 and not self.root.children
        for own in self.states.values():
            own.cost += DELETE * n
            own.node.edits += "D" * n
        if settled:
            self.out[-1] = self.root.edits

    @staticmethod
    def _release(node: Node) -> None:
        node.refs -= 1
        while not node.refs and node.parent is not None:
            parent = node.parent
            parent.children.remove(node)
            parent.refs -= 1
            node = parent

    def taken(self) -> list[str]:
        """Settled edits, a text for each row, that were not taken before."""
        out, self.out = self.out, []
        return out

    def rest(self, state: int) -> list[str]:
        """Edits of a survivor that are not settled."""
        out, node = [], self.states[state].node
        while node is not self.root:
            out.append(node.edits)
            node = node.parent
        return out[::-1]


def ending(state: int) -> str:
    """Turns to put in after the last row so that it ends legally, the fewest."""
    return "" if state in ENDS else next(x for a, x, b in INSERTED if a == state and b in ENDS)


def settle(repair: Repair) -> tuple[int, int, str]:
    """(cost, state, turns put in at the end) of the best survivor after the last row."""
    ways = [(s.cost + INSERT * len(ending(b)), s.rank, b) for b, s in repair.states.items()]
    cost, _, state = min(ways)
    return cost, state, ending(state)


def audit(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """Cost and edits of (initial, fault) rows."""
    repair = Repair(START)
    for initial, fault in rows:
        repair.add(initial, fault)
    cost, state, more = settle(repair)
    return cost, "".join(repair.taken() + repair.rest(state)) + more


PIECES = {
    "k": ("string", pa.string()), "part": ("bigint", pa.int64()), "entry": ("int", pa.int32()), "exit": ("int", pa.int32()),
    "seq": ("int", pa.int32()), "first_at": ("bigint", pa.int64()), "edits": ("string", pa.string()), "cost": ("bigint", pa.int64()),
    "rank": ("int", pa.int32()), "begins": ("string", pa.string()), "ends": ("string", pa.string()), "illegal": ("bigint", pa.int64()),
}
CHOSEN = {
    "k": ("string", pa.string()), "part": ("bigint", pa.int64()), "entry": ("int", pa.int32()), "exit": ("int", pa.int32()),
    "ending": ("string", pa.string()), "cost": ("bigint", pa.int64()), "illegal": ("bigint", pa.int64()),
}
TURNS = {
    "conv_id": ("bigint", pa.int64()), "at": ("bigint", pa.int64()), "nth": ("int", pa.int32()), "edit": ("string", pa.string()),
    "role": ("string", pa.string()), "text": ("string", pa.string()),
}
DIGESTS = {"k": ("string", pa.string()), "repaired_sha256": ("string", pa.string())}


def _ddl(fields: dict) -> str:
    return ", ".join(f"{name} {ddl}" for name, (ddl, _) in fields.items())


def _batch(rows: list[tuple], fields: dict) -> pa.RecordBatch:
    arrays = [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields.values())]
    return pa.RecordBatch.from_arrays(arrays, names=list(fields))


def _rows(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


class _Chunk:
    """The rows of one conversation that lie in one range of the order, repaired from every state they may be entered in."""

    def __init__(self, k: str, part: int, at: int, entries: tuple[int, ...]):
        self.k, self.part = k, part
        self.repairs = {e: Repair(e) for e in entries}
        self.next = dict.fromkeys(entries, (0, at))
        self.begins = self.ends = None
        self.illegal = 0

    def add(self, initial: str, fault: str, n: int) -> list[tuple]:
        out = []
        if self.begins is None:
            self.begins = initial
        else:
            self.illegal += not legal(self.ends, initial)
        self.illegal += (n - 1) * (not legal(initial, initial))
        self.ends = initial
        for e, repair in self.repairs.items():
            repair.add(initial, fault)
            if n > 1:
                repair.deleted(n - 1)
            if len(repair.out) > PIECE:
                out.append(self.piece(e, repair))
        return out

    def piece(self, e: int, repair: Repair) -> tuple:
        """The settled edits but the last, which copies of its row may still make longer."""
        seq, at = self.next[e]
        done, repair.out = repair.out[:-1], repair.out[-1:]
        self.next[e] = seq + 1, at + len(done)
        return self.k, self.part, e, None, seq, at, ",".join(done), None, None, None, None, None

    def close(self) -> list[tuple]:
        out = [(self.k, self.part, None, None, 0, 0, None, None, None, self.begins, self.ends, self.illegal)]
        for e, repair in self.repairs.items():
            seq, at = self.next[e]
            done = repair.taken()
            if done:
                out.append((self.k, self.part, e, None, seq, at, ",".join(done), None, None, None, None, None))
            for b, own in repair.states.items():
                rest = ",".join(repair.rest(b)) or None
                out.append((self.k, self.part, e, b, seq + 1, at + len(done), rest, own.cost, own.rank, None, None, None))
        return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``at`` as pieces of edits. The first conversation of a range may have begun in an earlier one."""
    chunk = None
    for batch in batches:
        out = []
        for k, at, initial, fault, n in _rows(batch, "k", "at", "initial", "fault", "n"):
            part = at >> 33
            if chunk is None or chunk.k != k or chunk.part != part:
                entries = tuple(AFTER) if chunk is None or chunk.part != part else (START,)
                if chunk is not None:
                    out += chunk.close()
                chunk = _Chunk(k, part, at, entries)
            out += chunk.add(initial, fault, n)
        yield _batch(out, PIECES)
    if chunk is not None:
        yield _batch(chunk.close(), PIECES)


def _compose(k: str, parts: dict[int, dict]) -> Iterator[tuple]:
    """For each part of a conversation, in order, how the best way enters and leaves it."""
    alive, trail, last, illegal = {START: (0, 0)}, [], None, 0
    for part in sorted(parts):
        own = parts[part]
        illegal += own["illegal"] + (last is not None and not legal(last, own["begins"]))
        last = own["ends"]
        best = {}
        for (e, b), (cost, rank) in own["ways"].items():
            if e in alive:
                way = (alive[e][0] + cost, alive[e][1], rank, e)
                best[b] = min(best.get(b, way), way)
        order = {b: r for r, (_, b) in enumerate(sorted((w[1:3], b) for b, w in best.items()))}
        alive = {b: (w[0], order[b]) for b, w in best.items()}
        trail.append((part, {b: w[3] for b, w in best.items()}))
    cost, _, state = min((c + INSERT * len(ending(b)), r, b) for b, (c, r) in alive.items())
    more, done = ending(state), []
    for part, came in reversed(trail):
        done.append((k, part, came[state], state, more, cost, illegal))
        state, more, cost, illegal = came[state], "", None, None
    yield from reversed(done)


def _choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Survivors of all parts, sorted by conversation; a conversation has as many parts as ranges at most."""
    k, parts = None, {}
    for batch in batches:
        out = []
        for own, part, e, b, cost, rank, begins, ends, illegal in _rows(batch, "k", "part", "entry", "exit", "cost", "rank", "begins", "ends", "illegal"):
            if parts and own != k:
                out += _compose(k, parts)
                parts = {}
            k = own
            here = parts.setdefault(part, {"ways": {}})
            if e is None:
                here |= {"begins": begins, "ends": ends, "illegal": illegal}
            else:
                here["ways"][e, b] = cost, rank
        yield _batch(out, CHOSEN)
    if parts:
        yield _batch(list(_compose(k, parts)), CHOSEN)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Sorted rows that stay, with their edits, as the turns of the repaired conversations."""
    group, state = None, START
    for batch in batches:
        out = []
        for k, conv, part, entry, at, token, role, text in _rows(batch, "k", "conv_id", "part", "entry", "at", "token", "role", "text"):
            if group != (k, part):
                group, state = (k, part), entry
            nth = 0
            for edit in token.rstrip("D"):
                if edit == "K":
                    initial, said = role[:1], (role, text)
                else:
                    initial = AFTER[state][-1]
                    said = ROLES[initial], text if edit == "R" else ""
                state = STATE[initial]
                out.append((k, conv, at, nth, edit, *said))
                nth += 1
        yield out


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _applied(batches):
        yield _batch([r[1:] for r in rows], TURNS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k, digest = None, None
    for rows in _applied(batches):
        out = []
        for own, _, _, _, _, role, text in rows:
            if own != k:
                if digest:
                    out.append((k, digest.hexdigest()))
                k, digest = own, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        yield _batch(out, DIGESTS)
    if digest:
        yield _batch([(k, digest.hexdigest())], DIGESTS)


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, n`` (copies) after the damage that the CRC-32 of ``conv_id:turn`` modulo 20 chooses.

    Nulls are one space, in the text of the CRC as well. 0 drops a row, 1 empties its text, 2 takes ``.``, ``!`` and ``?``
    out of it, 3 doubles it, 4 makes it a user's."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    text = F.coalesce(F.col("text"), F.lit(" "))
    how = F.crc32(F.concat(said[0], F.lit(":"), said[1]).cast("binary")) % 20
    some = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(how == 4, "user").otherwise(F.coalesce(F.col("role"), F.lit(" "))).alias("role"),
        F.when(how == 1, "").when(how == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(how == 3, 2).otherwise(1).alias("n"), how.alias("how"),
    )
    return some.where("how != 0").drop("how")


def _key() -> Column:
    """A text for each conversation, '' for rows without an id: joins on it need no null."""
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(""))


def _named(turns: DataFrame) -> DataFrame:
    """``turns`` (``conv_id, turn, role, text``, perhaps ``n``) with keys that are never null."""
    out = turns if "n" in turns.columns else turns.withColumn("n", F.lit(1))
    return out.select(
        _key().alias("k"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("turn").cast("string"), F.lit("")).alias("tk"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), "n",
    ).withColumn("th", F.md5("text"))


ROW = ["k", "tk", "role", "th"]


def ordered(turns: DataFrame) -> DataFrame:
    """The distinct rows without their texts, numbered by ``at`` in the order of conversation and turn, with ``n`` copies and
    a ``fault`` of the first copy.

    The order is cut into ranges of about equal size, so a conversation of any length spreads over as many as it fills;
    rows alike are counted before they are exchanged. The upper bits of ``at`` name the range.
    """
    bare = F.trim("text", F.lit(BLANKS))
    rows = _named(turns).withColumn("blank", bare == "").withColumn("open", ~F.right(bare, F.lit(1)).isin(".", "!", "?"))
    rows = rows.groupBy(*ROW).agg(
        F.sum("n").alias("n"), F.first("conv_id").alias("conv_id"), F.first("turn").alias("turn"), F.first("blank").alias("blank"), F.first("open").alias("open"),
    )
    ranged = rows.repartitionByRange("k", F.asc_nulls_first("turn"), "role", "th")
    ranged = common.stored(ranged.sortWithinPartitions("k", F.asc_nulls_first("turn"), "role", "th").withColumn("at", F.monotonically_increasing_id()))
    # A text that was said before in the same role is a duplicate; the first of them is known by its place.
    first = ranged.groupBy("k", "role", "th").agg(F.min("at").alias("at")).withColumn("is_first", F.lit(True))
    found = ranged.join(first.select("at", "is_first"), "at", "left")
    fault = F.when(F.col("blank"), "b").when(F.col("is_first").isNull(), "d").when(F.col("open"), "t").otherwise("")
    return common.stored(found.select(
        *ROW, "at", F.col("n").cast("long").alias("n"), "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault")
    ))


def edits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cheapest edits of ``ordered`` rows: pieces (``k, part, entry, seq, first_at, edits``: a text for each row from
    ``first_at`` on, with commas between) and one row for each part of a conversation with what it costs as a whole."""
    asked = rows.select("k", "at", "initial", "fault", "n").repartition(F.shiftright("at", 33)).sortWithinPartitions("at")
    pieces = common.stored(asked.mapInArrow(_chunks, _ddl(PIECES)))
    ends = pieces.where("entry is null or exit is not null").select("k", "part", "entry", "exit", "cost", "rank", "begins", "ends", "illegal")
    chosen = common.stored(ends.repartition("k").sortWithinPartitions("k", "part").mapInArrow(_choices, _ddl(CHOSEN)))
    way = chosen.select("k", "part", "entry", F.col("exit").alias("_exit"))
    best = pieces.where("edits is not null").join(way, ["k", "part", "entry"]).where("exit is null or exit = _exit")
    return best.select("k", "part", "entry", "seq", "first_at", "edits"), chosen


def _kept(turns: DataFrame, rows: DataFrame, best: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows that stay and turns put in at the end, with their edits, roles and texts."""
    each = best.select("part", "entry", "first_at", F.posexplode(F.split("edits", ",")).alias("pos", "token"))
    each = each.where(F.col("token").rlike("[KR]")).select("part", "entry", (F.col("first_at") + F.col("pos")).alias("at"), "token")
    texts = _named(turns).groupBy(*ROW).agg(F.first("text").alias("text"))
    said = rows.select(*ROW, "conv_id", "at").join(each, "at").join(texts.hint("merge"), ROW)
    columns = ["k", "conv_id", "part", "entry", "at", "token", "role", "text"]
    none = F.lit(None).cast("string")
    more = chosen.where("ending != ''").select(
        "k", F.expr("try_cast(k as bigint)").alias("conv_id"), "part", "entry", F.lit(LAST).alias("at"), F.col("ending").alias("token"), none.alias("role"), none.alias("text")
    )
    return said.select(*columns).unionByName(more)


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, at, nth, edit, role, text``, a row for each turn; ``at`` and ``nth`` give the order.

    ``turns`` has ``conv_id, turn, role, text``. Nulls in role and text are one space, rows without a ``conv_id`` are one
    conversation, rows without a turn come first, ties by role, then by MD5 of the text. Blank rows and later copies of a
    row go; others are kept, given another role, deleted, or turns without text are put in, as is cheapest. An empty
    table gives none; other columns are not read. Every part of a conversation is worked out for itself.
    """
    rows = ordered(turns)
    best, chosen = edits(rows)
    some = _kept(turns, rows, best, chosen)
    return some.repartition("k", "part").sortWithinPartitions("k", "part", "at").mapInArrow(_turns, _ddl(TURNS))


def report(turns: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """One row a conversation of ``originals`` (or ``turns``): ``conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256``; rules as in ``repaired``. Without rows: zeros, an empty audit and the digest of nothing.

    Only the digest, which has to see the texts in order, streams a conversation through one task.
    """
    rows = ordered(turns)
    best, chosen = edits(rows)
    n, fault = F.col("n"), F.col("fault")
    by_turn = rows.groupBy("k", "tk").agg(
        F.min("turn").alias("turn"), F.sum(F.when(fault == "b", n).otherwise(0)).alias("blank"),
        F.sum(F.when(fault == "b", 0).when(fault == "d", n).otherwise(n - 1)).alias("duplicate"), F.count_if(fault == "t").alias("truncated"),
    )
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    stats = by_turn.groupBy("k").agg(span.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    whole = chosen.groupBy("k").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.concat_ws("", F.collect_list("ending")).alias("ending"))
    said = F.sort_array(F.collect_list(F.struct("part", "seq", F.replace("edits", F.lit(","), F.lit("")).alias("edits"))))
    audits = best.groupBy("k").agg(F.array_join(F.transform(said, lambda x: x["edits"]), "").alias("audit"))
    some = _kept(turns, rows, best, chosen)
    digests = some.repartition("k").sortWithinPartitions("k", "part", "at").mapInArrow(_digests, _ddl(DIGESTS))
    every = (turns if originals is None else originals).select(F.col("conv_id").cast("long").alias("conv_id"), _key().alias("k")).distinct()
    found = every.join(stats, "k", "left").join(whole, "k", "left").join(audits, "k", "left").join(digests, "k", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return found.select(
        "conv_id", *[count(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.concat(text("audit"), text("ending")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations after damage."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return report(damaged(turns), turns)

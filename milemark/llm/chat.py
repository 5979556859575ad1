"""Chat formatting at token level: segments encoded apart, reserved ids between them, a loss mask by prefix sums."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milemark.llm import common, tokens

# The template's control strings and the ids beyond the vocabulary that stand for them.
TURN, BODY, END = 50257, 50258, 50259
MARKS = {TURN: "### ", BODY: ": ", END: "</turn>\n"}
LEARNED_ROLE = "assistant"
# Backslashes are doubled and one is put before each of these in a text: template marks are never preceded by an
# odd number of backslashes, marks inside texts always are.
_CONTROL = re.compile(r"\\|###|</turn>|<\|endoftext\|>|: ")
_ESCAPED = re.compile(r"\\(.)", re.S)
# Tokens of a part, to which the turn that reaches it is added: a conversation of any length goes out in parts.
PART_TOKENS = 8192

PARTS = "conv_id bigint, part int, ids binary, loss binary"
READ = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, "
    "n_tokens bigint"
)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def assemble(role: bytes, content: bytes, learned: bool) -> tuple[bytes, bytes]:
    """Ids of a turn (little-endian 32 bits) and its mask (a byte each): 1 on the content of a learned turn."""
    mark = lambda k: np.array([k], dtype="<u4").tobytes()
    ids = b"".join((mark(TURN), role, mark(BODY), content, mark(END)))
    edges = np.zeros(len(ids) // 4, dtype=np.int8)
    if learned and content:
        edges[2 + len(role) // 4] += 1  # the first token of the content
        edges[-1] -= 1  # the end mark
    return ids, np.cumsum(edges, dtype=np.int8).tobytes()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns sorted by conversation, as parts of conversations; one part is in memory at a time."""
    conv, part, ids, loss, size, any_ = None, 0, [], [], 0, False
    for batch in batches:
        out = []
        rows = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "_role", "_content", "_learned")), strict=True)
        for own, role, content, learned in rows:
            if any_ and (own != conv or size >= PART_TOKENS):
                out.append((conv, part, b"".join(ids), b"".join(loss)))
                part, ids, loss, size = (part + 1 if own == conv else 0), [], [], 0
            conv, any_ = own, True
            turn, mask = assemble(role, content, learned)
            ids.append(turn)
            loss.append(mask)
            size += len(mask)
        yield _batch(out, _PART_TYPES)
    if any_:
        yield _batch([(conv, part, b"".join(ids), b"".join(loss))], _PART_TYPES)


_PART_TYPES = {"conv_id": pa.int64(), "part": pa.int32(), "ids": pa.binary(), "loss": pa.binary()}
_READ_TYPES = {
    "conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(),
    "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "n_tokens": pa.int64(),
}


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types.values())], names=list(types))


class _Reader:
    """Sums up one conversation from its parts, in order; a turn lies in one part."""

    def __init__(self, decode):
        self.decode = decode
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = self.tokens = 0

    def add(self, ids: bytes, loss: bytes) -> None:
        x, mask = np.frombuffer(ids, dtype="<u4"), np.frombuffer(loss, dtype=np.int8)
        self.tokens += len(x)
        piece = lambda a, b: self.decode(ids[4 * a : 4 * b])
        begin, body, end = (np.flatnonzero(x == k) for k in (TURN, BODY, END))
        for a, b, c in zip(begin, body, end, strict=True):
            role, text = piece(a + 1, b), piece(b + 1, c)
            self.n += 1
            self.chars += len(MARKS[TURN]) + len(role) + len(MARKS[BODY]) + len(text) + len(MARKS[END])
            self.turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))
        edges = np.diff(np.concatenate([[0], mask, [0]]))
        for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
            said = unescape(piece(a, b))
            self.loss_chars += len(said)
            self.loss.update(said.encode("utf-8", "surrogatepass"))

    def row(self, conv: int | None) -> tuple:
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.tokens


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    decode, reader, conv = tokens.encoder(None, None, True).decode, None, None
    for batch in batches:
        out = []
        rows = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "ids", "loss")), strict=True)
        for own, part, ids, loss in rows:
            if part == 0:
                if reader:
                    out.append(reader.row(conv))
                reader, conv = _Reader(decode), own
            reader.add(ids, loss)
        yield _batch(out, _READ_TYPES)
    if reader:
        yield _batch([reader.row(conv)], _READ_TYPES)


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, part, ids, loss``: token ids (little-endian 32 bits) of whole turns, and a byte each of loss mask.

    A turn is a reserved id, its role, a reserved id, its text, a reserved id; role and text are escaped and encoded
    before they meet, row by row. Then only the ids are dealt out by conversation, sorted by turn (ties by role and ids,
    null first) and streamed into parts of a bounded size. Null texts and roles are empty, rows without a ``conv_id`` are
    one conversation, repeated rows are turns of their own. Other columns are not read. The parts of a conversation lie
    behind one another in one partition.
    """

    def work():
        encode = tokens.encoder(None, None, True).encode
        return lambda rows: [(encode(escape(r["role"] or "")), encode(escape(r["text"] or ""))) for r in rows]

    asked = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").alias("_r"),
        F.coalesce(F.col("role") == LEARNED_ROLE, F.lit(False)).alias("_learned"), F.struct("role", "text").alias("_t"),
    )
    fields = {"_role": ("binary", pa.binary()), "_content": ("binary", pa.binary())}
    encoded = common.map_column(asked, "_t", fields, work)
    order = ["conv_id", "turn", "_r", "_content"]
    return encoded.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_parts, PARTS)


def read_back(parts: DataFrame) -> DataFrame:
    """One row a conversation: what the formatted ids and the mask say, decoded and unescaped. ``parts`` as
    ``format_conversations`` gives them; nothing is exchanged."""
    return parts.mapInArrow(_read, READ)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, whose texts hold the template's own marks."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return read_back(format_conversations(turns.unionByName(more)))

"""Best-fit packing by minimum bin slack: token pieces into as few sequences as possible."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from milemark.llm import common, tokens

MAX_TOKENS = 2048
END = np.array([0], dtype="<u4").tobytes()
ROWS_PER_RANK = 10_000


def cut_points(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else all but the first have ``most`` tokens."""
    if n <= most:
        return [(0, n)]
    first = n % most or most
    return [(0, first), *((at, most) for at in range(first, n, most))]


def pieces(docs: DataFrame, most: int = MAX_TOKENS, with_ids: bool = False, paths: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every row; a null text is empty and is one end token."""

    def work():
        encode = tokens.encoder(*paths).encode

        def cut(text: str | None) -> tuple[list[tuple]]:
            ids = memoryview(encode(text or "") + END)
            out = []
            for k, (start, length) in enumerate(cut_points(len(ids) // 4, most)):
                own = ids[4 * start : 4 * (start + length)]
                kept = (np.frombuffer(own, dtype="<u4").tolist(),) if with_ids else ()
                out.append((k, start, length, zlib.crc32(own), *kept))
            return (out,)

        return lambda texts: [cut(t) for t in texts]

    names = [("piece", pa.int32(), "int"), ("start", pa.int64(), "bigint"), ("length", pa.int64(), "bigint"),
             ("ids_crc32", pa.int64(), "bigint"), *[("ids", pa.list_(pa.int32()), "array<int>")] * with_ids]
    kind = pa.list_(pa.struct([(name, t) for name, t, _ in names]))
    ddl = f"array<struct<{','.join(f'{name}:{d}' for name, _, d in names)}>>"
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = common.map_column(asked, "text", {"p": (ddl, kind)}, work)
    return out.select("doc_id", F.inline("p"))


def _fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """(length, how often) of the combination that fills ``room`` best: subset sums as bits of one number.

    Lengths come in falling order; the search ends as soon as the room can be filled exactly.
    """
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for length in lengths:
        if length > room:
            continue
        steps.append((length, reach))
        times = min(counts[length], room // length)
        power = 1
        while times:  # any count up to ``times`` as shifts by powers of two and a rest
            now = min(power, times)
            reach |= reach << length * now & mask
            times -= now
            power *= 2
        if reach >> room:
            break
    at, out = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        times = 0
        while not before >> at & 1:
            at -= length
            times += 1
        if times:
            out.append((length, times))
    return out


def patterns(counts: dict[int, int], most: int = MAX_TOKENS) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """Bins of minimum slack: ([(length, how often)], how many bins are alike), for pieces counted by length.

    Each bin starts with the longest piece left and is filled with the best combination of the rest, which is then
    removed; a bin that its counts allow again is made as often as they do. The work depends on the distinct
    lengths, of which there are at most ``most``, and not on the number of pieces.
    """
    counts = {k: n for k, n in counts.items() if n}
    lengths = sorted(counts, reverse=True)
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        filled = {longest: 1}
        for length, times in _fullest(counts, [x for x in lengths if counts[x]], most - longest):
            filled[length] = filled.get(length, 0) + times
        counts[longest] += 1
        bins = min(counts[length] // times for length, times in filled.items())
        for length, times in filled.items():
            counts[length] -= bins * times
        yield sorted(filled.items(), reverse=True), bins
        lengths = [x for x in lengths if counts[x]]


def places(counts: dict[int, int], most: int = MAX_TOKENS) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset): where the pieces of a length go by their rank."""
    out, used, sequence = [], dict.fromkeys(counts, 0), 0
    for filled, bins in patterns(counts, most):
        offset = 0
        for length, times in filled:
            for _ in range(times):
                out.append((length, used[length], used[length] + bins - 1, sequence, offset))
                used[length] += bins
                offset += length
        sequence += bins
    return out


def pack(found: DataFrame, most: int = MAX_TOKENS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that lie in a stored table (it is read three times).

    Only the count of each length, ``most`` numbers, comes to the driver. Pieces of a length are alike for the
    packing, so they are numbered (within hashed parts of a bounded size, then by the parts' running sums) and take
    the places of their numbers. Repeated rows are pieces of their own; null ids are kept.
    """
    spark = found.sparkSession
    counts = {int(r["length"]): r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = spark.createDataFrame(
        places(counts, most) or [(0, 0, -1, 0, 0)], "length long, first long, last long, sequence long, offset long"
    )
    parts = spark.createDataFrame([(k, n // ROWS_PER_RANK + 1) for k, n in counts.items()] or [(0, 1)], "length long, parts long")
    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = found.join(F.broadcast(parts), "length").withColumns({"_key": key, "_part": F.pmod(key, "parts")}).drop("parts")
    sums = dealt.groupBy("length", "_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_part").orderBy("_key", "doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("_rank", F.row_number().over(order)).join(sums, ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before") - 1)
    # At most a few places for each of at most ``most`` lengths.
    placed = ranked.join(F.broadcast(where), "length").where("_rank between first and last")
    return placed.select(
        *common.names(found), (F.col("sequence") + F.col("_rank") - F.col("first")).alias("sequence_id"), "offset"
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens."""
    return pack(common.stored(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))))

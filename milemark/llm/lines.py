"""Line dedup by winnowing: window minima over line hashes, joined, extended both ways, later runs deleted."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from milemark.llm import common

# A repeated run is deleted from this many words on.
MIN_WORDS = 50


def hashed_lines(text: str | None) -> list[tuple[int, int, int]]:
    """(index among the text's lines, hash, words) of every line with a word; white space at its ends doesn't count."""
    out = []
    for k, line in enumerate(text.split("\n")) if text else ():
        data = line.encode("utf-8", "surrogatepass").strip()
        if data:
            out.append((k, xxhash.xxh64_intdigest(data) - (1 << 63), len(data.split())))
    return out


def fingerprints(lines: list[tuple[int, int, int]], least: int = MIN_WORDS) -> Iterator[tuple[int, int, list[int], list[tuple]]]:
    """The places of a text that are the minimum of some window, each once: winnowing, counted in words.

    A window has as few lines from its first on as have ``least`` words together; its fingerprint is its smallest line
    hash, the last of equal ones. Two copies of a run of so many words have its windows, and so their minima, in common
    whatever surrounds them. Gives hash of the line, index of the first line kept with it, hashes of these lines, and the
    windows that chose the place: first line and length, counted among the lines kept, and how many lines around it are
    wanted for extending a match, fewer than a window has on each side: a longer repeated neighbourhood has windows of
    its own.
    """
    hashes = [h for _, h, _ in lines]
    end, words, chosen, at_once = 0, 0, -1, []
    for at, (_, _, own) in enumerate(lines):
        seen = end
        while end < len(lines) and words < least:
            words += lines[end][2]
            end += 1
        if words < least:
            break
        place = chosen if chosen >= at else at
        for k in range(seen if chosen >= at else at, end):
            if hashes[k] <= hashes[place]:
                place = k
        if place != chosen and at_once:
            yield _kept(hashes, chosen, at_once)
            at_once = []
        chosen = place
        left, right = _near(lines, range(at - 1, -1, -1), least), _near(lines, range(end, len(lines)), least)
        at_once.append((at, end - at, left, right))
        words -= own
    if at_once:
        yield _kept(hashes, chosen, at_once)


def _kept(hashes: list[int], chosen: int, wanted: list[tuple[int, int, int, int]]) -> tuple[int, int, list[int], list[tuple]]:
    first = min(at - left for at, _, left, _ in wanted)
    last = max(at + size + right for at, size, _, right in wanted)
    return hashes[chosen], first, hashes[first:last], [(at - first, size, left, right) for at, size, left, right in wanted]


def _near(lines: list[tuple[int, int, int]], order: range, least: int) -> int:
    words = 0
    for n, k in enumerate(order):
        words += lines[k][2]
        if words >= least:
            return n
    return len(order)


_PLACE = pa.struct([("at", pa.int32()), ("size", pa.int32()), ("left", pa.int32()), ("right", pa.int32())])
_FINGERPRINT = {"minimum": pa.int64(), "first": pa.int32(), "lines": pa.list_(pa.int64()), "windows": pa.list_(_PLACE)}
_FINGERPRINT_DDL = "minimum bigint, first int, lines array<bigint>, windows array<struct<at:int,size:int,left:int,right:int>>"
# Fingerprints that go out together: a text of very many short lines is not held as a whole.
ROWS_AT_ONCE = 4096


def _windows(found: DataFrame) -> DataFrame:
    """The windows of the given fingerprints, with the hash of their content and the lines around, nearest first."""
    each = found.select("doc_id", "_h", "minimum", "first", "lines", F.explode("windows").alias("w"))
    part = lambda start, n: F.slice("lines", start, n)
    at, size = F.col("w.at"), F.col("w.size")
    return each.select(
        "doc_id", "_h", (F.col("first") + at).alias("at"), size.alias("size"), "minimum", F.xxhash64(part(at + 1, size)).alias("content"),
        F.reverse(part(at - F.col("w.left") + 1, F.col("w.left"))).alias("before"), part(at + size + 1, F.col("w.right")).alias("after"),
    )


def _agreeing(own: str, other: str) -> Column:
    """How many elements two arrays have in common from their start on."""
    same = F.zip_with(own, other, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def repeats(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``doc_id, _h`` (the text's hash) and ``cuts``: runs of lines (first, last, counted among lines with words) that an
    earlier text, or an earlier place of the same text, has as well.

    Only fingerprints are stored, with the lines around; one whose hash stands at no other place goes no further. Places
    with equal hashes are not paired with each other: the windows that chose them are joined with the first occurrence of
    the same content, one row for each window that occurs again, and the match is extended over the lines around. Texts
    are in the order of ``doc_id`` (null first), then of their hash.
    """

    def flat(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        types = {"doc_id": id_type, "_h": pa.int64(), **_FINGERPRINT}
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types.values())], names=list(types))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kind = [], batch.column("doc_id").type
            for doc_id, h, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "_h", "text")), strict=True):
                for place in fingerprints(hashed_lines(text), least):
                    rows.append((doc_id, h, *place))
                    if len(rows) >= ROWS_AT_ONCE:
                        yield flat(rows, kind)
                        rows = []
            yield flat(rows, kind)

    asked = docs.select("doc_id", F.xxhash64("text").alias("_h"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    places = common.stored(asked.mapInArrow(work, f"doc_id {id_type}, _h bigint, {_FINGERPRINT_DDL}"))
    again = common.stored(places.groupBy("minimum").agg(F.count("*").alias("n")).where("n > 1").select("minimum"))
    found = common.stored(_windows(places.join(again.hint("merge"), "minimum", "left_semi")))
    key, place = ["minimum", "content"], F.struct("doc_id", "_h", "at")
    first = found.groupBy(key).agg(F.min(place).alias("f"), F.count("*").alias("n")).where("n > 1")
    first = common.stored(first.drop("n"))
    # The lines around the first occurrences, fetched once a window; then both sides of the large join lie stored, so
    # that adaptive execution can cut the partition of a window that very many texts have.
    around = found.withColumn("f", place).join(first, [*key, "f"], "left_semi").dropDuplicates(key)
    first = common.stored(around.select(*key, "f", F.col("before").alias("fb"), F.col("after").alias("fa")))
    later = found.join(first, key).where(place > F.col("f"))
    run = F.struct(
        (F.col("at") - _agreeing("before", "fb")).alias("first"),
        (F.col("at") + F.col("size") - 1 + _agreeing("after", "fa")).alias("last"),
    )
    # Runs of one text, at most one a line.
    return common.stored(later.select("doc_id", "_h", run.alias("run")).groupBy("doc_id", "_h").agg(F.collect_set("run").alias("cuts")))


def cut(text: str, runs: list[dict]) -> tuple[str, int, int]:
    """The text without the lines of the runs and the blank lines inside them, its lines with words and those deleted."""
    lines, named = text.split("\n"), hashed_lines(text)
    gone = bytearray(len(lines))
    for run in runs:
        first, last = named[run["first"]][0], named[run["last"]][0]
        gone[first : last + 1] = b"\x01" * (last + 1 - first)
    left = "\n".join(x for x, out in zip(lines, gone, strict=True) if not out)
    return left, len(named), sum(gone[k] for k, _, _ in named)


def dedup(docs: DataFrame, least: int = MIN_WORDS, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """All columns and rows of ``docs`` with shortened ``text``, and as ``counts`` its lines with words and those deleted.

    The first place of every line that is deleted somewhere stays. Null texts stay null; rows alike in ``doc_id`` and
    text are one text and are shortened alike; columns that have the names of ``counts`` are replaced.
    """

    def work():
        def one(row: dict) -> tuple[str | None, int, int]:
            text, runs = row["text"], row["cuts"]
            return cut(text, runs) if runs else (text, len(hashed_lines(text)), 0)

        return lambda rows: [one(r) for r in rows]

    docs = docs.drop(*counts)
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # so that no column has a name used here
    doc_id, text = (plain.columns[docs.columns.index(c)] for c in ("doc_id", "text"))
    cuts = repeats(docs, least).withColumnsRenamed({"doc_id": "_id", "_h": "_g"})
    keyed = plain.withColumn("_h", F.xxhash64(text))
    # The runs grow with the texts: the same exchange at every size, no broadcast that a larger input would lose.
    joined = keyed.join(cuts.hint("merge"), F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_g")), "left")
    asked = joined.select(*[c for c in plain.columns if c != text], F.struct(F.col(text).alias("text"), "cuts").alias("_t"))
    fields = {text: ("string", pa.string()), "_lines": ("bigint", pa.int64()), "_removed": ("bigint", pa.int64())}
    return common.map_column(asked, "_t", fields, work).select(*plain.columns, "_lines", "_removed").toDF(*docs.columns, *counts)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, runs of 50 words or more."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "n_lines", "n_removed")

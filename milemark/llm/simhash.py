"""SimHash near-duplicates: fingerprints of word shingles, joined on blocks of bits, then verified."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milemark.llm import common

SEED = 42
ROWS_AT_ONCE = 1 << 15


@dataclass(frozen=True)
class Scheme:
    """``width`` words in a shingle, ``lanes`` times 64 bits, links up to ``distance`` differing bits.

    ``keys`` lists the bits that make up each block key. Two fingerprints that agree on any key are compared.
    """

    width: int
    lanes: int
    distance: int
    keys: tuple[tuple[int, ...], ...]


def pigeonhole(distance: int, pieces: int, bits: int = 64) -> tuple[tuple[int, ...], ...]:
    """Block keys that every pair within the distance shares: at most ``distance`` of the pieces can differ, so
    some choice of ``pieces - distance`` whole pieces is equal."""
    cut = [tuple(range(bits * k // pieces, bits * (k + 1) // pieces)) for k in range(pieces)]
    return tuple(sum(chosen, ()) for chosen in itertools.combinations(cut, pieces - distance))


EXACT = Scheme(width=3, lanes=1, distance=2, keys=pigeonhole(2, 4))


def _lanes(h: np.ndarray, lanes: int) -> np.ndarray:
    """The hash itself, then further 64 bits mixed from it, as one row of ``lanes`` numbers each."""
    out = np.empty((len(h), lanes), dtype=np.uint64)
    out[:, 0] = h
    for k in range(1, lanes):
        z = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = z ^ (z >> np.uint64(31))
    return out


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, repeats included; fewer words make one shingle of all, no word none."""
    words = common.ascii_words(text)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= width:
        hashes = [digest(join(words), SEED)] if words else []
    else:
        hashes = [digest(join(s), SEED) for s in zip(*(words[k:] for k in range(width)), strict=False)]
    return np.array(hashes, dtype=np.uint64)


def _majority(h: np.ndarray, lanes: int) -> np.ndarray:
    ones = np.zeros(64 * lanes, dtype=np.int64)
    for at in range(0, len(h), ROWS_AT_ONCE):
        part = _lanes(h[at : at + ROWS_AT_ONCE], lanes)
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)


def fingerprint(text: str | None, width: int = 3, lanes: int = 1) -> np.ndarray:
    """``lanes`` numbers; a bit is 1 if it is set in over half of the shingles' hashes, repeats included.

    Fewer words than ``width`` make one shingle of all; no word (or null) makes zero.
    """
    return _majority(shingles(text, width), lanes)


def _fingerprints(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """``docs`` with the fingerprint's bytes ``_fp`` in place of ``text``."""
    width, lanes = scheme.width, scheme.lanes

    def work(texts: list[str | None]) -> list[tuple[bytes]]:
        return [(fingerprint(t, width, lanes).astype("<u8").tobytes(),) for t in texts]

    return common.map_column(docs, "text", {"_fp": ("binary", pa.binary())}, lambda: work)


def _bit_keys(fp: pd.Series, keys: tuple[tuple[int, ...], ...]) -> list[np.ndarray]:
    bits = np.unpackbits(np.frombuffer(b"".join(fp), dtype=np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")
    out = np.empty((len(fp), len(keys)), dtype=np.int64)
    for k, chosen in enumerate(keys):
        out[:, k] = bits[:, chosen].astype(np.int64) @ (1 << np.arange(len(chosen), dtype=np.int64))
    return list(out)


def _compare(group: pd.DataFrame, distance: int) -> pd.DataFrame:
    """A spanning forest of the links between two blocks (or within one)."""
    first = (group["lo"] == group["hi"]).iloc[0]
    x = np.frombuffer(b"".join(group["fp"]), dtype="<u8").reshape(len(group), -1)
    block = group["block"].to_numpy()
    rows = np.arange(len(x)) if first else np.flatnonzero(block == group["lo"].iloc[0])
    cols = np.arange(len(x)) if first else np.flatnonzero(block == group["hi"].iloc[0])
    left, right = [], []
    for at in range(0, len(rows), 256):
        part = rows[at : at + 256]
        off = sum(np.bitwise_count(x[part, k][:, None] ^ x[cols, k][None, :]).astype(np.int32) for k in range(x.shape[1]))
        i, j = np.nonzero(off <= distance)
        left.append(part[i])
        right.append(cols[j])
    root = common.spanning(len(x), np.concatenate(left or [rows]), np.concatenate(right or [rows]))
    fp = group["fp"].to_numpy()
    tied = np.flatnonzero(root != np.arange(len(x)))
    return pd.DataFrame({"a": fp[tied], "b": fp[root[tied]]})


def links(fps: DataFrame, scheme: Scheme, size: int = common.BLOCK) -> DataFrame:
    """Links (``a``, ``b``) between distinct fingerprints ``fp`` that join all within the distance.

    The members of a key meet in pairs of bounded blocks, and each pair of blocks gives a spanning forest of its links:
    as many rows as members at most, whatever the bucket's size.
    """
    distance, keys = scheme.distance, scheme.keys

    def work(batch: pd.DataFrame) -> pd.DataFrame:
        if not len(batch):
            return batch[["fp"]].assign(keys=[])
        return pd.DataFrame({"fp": batch["fp"], "keys": _bit_keys(batch["fp"], keys)})

    keyed = fps.mapInPandas(common.over_batches(work), "fp binary, keys array<long>").select(
        "fp", F.posexplode("keys").alias("k", "key")
    )
    bucket = ["k", "key"]
    sizes = keyed.groupBy(bucket).agg(F.count("*").alias("n")).where("n > 1")
    shared = common.stored(keyed.join(sizes, bucket))
    # Two members need no Python: most keys that are shared at all have two.
    pair = shared.where("n = 2").groupBy(bucket).agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
    off = sum(
        (
            F.bit_count(F.conv(F.hex(F.substring("a", 8 * k + 1, 8)), 16, -10).cast("long").bitwiseXOR(
                F.conv(F.hex(F.substring("b", 8 * k + 1, 8)), 16, -10).cast("long")))
            for k in range(scheme.lanes)
        ),
        F.lit(0),
    )
    two = pair.where(off <= distance).select("a", "b")
    many = common.block_pairs(shared.where("n > 2").drop("n"), bucket, "fp", size)
    more = many.groupBy(*bucket, "lo", "hi").applyInPandas(lambda g: _compare(g, distance), "a binary, b binary")
    return two.unionByName(more).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", scheme: Scheme = EXACT) -> DataFrame:
    """Every row's id, its ``fingerprint`` bytes and ``component_id``, the smallest id it is linked to, itself included.

    Exact copies share a fingerprint and are one node. A null or empty text has fingerprint zero and is linked like
    any other. A null id takes part, but never names a component unless all its members are null. Repeated rows give
    repeated rows, an empty table none; other columns are not read.
    """
    seen = common.stored(_fingerprints(docs.select(F.col(id_col).alias("_id"), "text"), scheme))
    nodes = common.stored(seen.groupBy("_fp").agg(F.min("_id").alias("_least")))
    found = common.components(links(nodes.select(F.col("_fp").alias("fp")), scheme))
    grouped = nodes.join(found, nodes["_fp"] == found["node"], "left").select(
        "_fp", "_least", F.coalesce("component", "_fp").alias("_root")
    )
    grouped = common.stored(grouped)
    named = grouped.join(grouped.groupBy("_root").agg(F.min("_least").alias("component_id")), "_root")
    named = common.stored(named.select("_fp", "component_id"))
    return seen.join(named, "_fp").select(F.col("_id").alias(id_col), F.col("_fp").alias("fingerprint"), "component_id")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles of all documents, links at two differing bits or fewer."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digits = F.concat(*[F.substring("fingerprint", k, 1) for k in range(8, 0, -1)])  # the highest byte first
    return found.withColumn("fingerprint", F.lower(F.hex(digits)))


def keep_one(docs: DataFrame, scheme: Scheme = EXACT) -> DataFrame:
    """The documents without near copies: of each group of ``near_duplicates`` one row stays, its columns unchanged.

    That is the row with the smallest ``doc_id`` (null last), of several with it the one with the smallest XXH64 of all
    its columns (maps apart), of rows alike in all of them one. Rows without a ``doc_id`` are grouped like others.
    """
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # so that no column has a name used here
    doc_id, text = (plain.columns[docs.columns.index(c)] for c in ("doc_id", "text"))
    hashed = [f.name for f in plain.schema if "map<" not in f.dataType.simpleString()]
    keyed = plain.withColumns({"_k": F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "_h": F.xxhash64(*hashed)})
    asked = keyed.select("_k", "_h", F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    seen = common.stored(_fingerprints(asked, scheme))
    first = F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_h", "_k")).alias("_best")
    nodes = common.stored(seen.groupBy("_fp").agg(first))
    found = common.components(links(nodes.select(F.col("_fp").alias("fp")), scheme))
    grouped = nodes.join(found, nodes["_fp"] == found["node"], "left").withColumn("_root", F.coalesce("component", "_fp"))
    best = common.stored(grouped.groupBy("_root").agg(F.min("_best").alias("_best")).select("_best._k", "_best._h"))
    # Rows that are alike in every column, if there are any, are made one; no other text is compared.
    again = seen.join(best, ["_k", "_h"], "left_semi").groupBy("_k", "_h").count().where("count > 1").select("_k", "_h")
    again = common.stored(again)
    if again.isEmpty():
        kept = keyed.join(best, ["_k", "_h"], "left_semi")
    else:
        lone = best.join(again, ["_k", "_h"], "left_anti")
        kept = keyed.join(lone, ["_k", "_h"], "left_semi").unionByName(
            keyed.join(again, ["_k", "_h"], "left_semi").dropDuplicates(["_k", "_h"])
        )
    return kept.select(*plain.columns).toDF(*docs.columns)

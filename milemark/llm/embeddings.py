"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one vector kept of each group."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milemark.llm import common

THRESHOLD = 0.95
# Centres are fitted on at most this many vectors; every vector is assigned, compared and counted.
SAMPLE, SAMPLE_BYTES = 20_000, 64 << 20
CELL_ROWS = 4096
MAX_CELLS = 1024
PROBE_BLOCK = 4 * CELL_ROWS
# Blocks of long vectors have fewer rows.
BLOCK_BYTES = 32 << 20


def unit(vector) -> np.ndarray | None:
    """The vector at length 1 in double precision; None if it is null, empty, zero or has a null or non-finite part."""
    if vector is None or len(vector) == 0:
        return None
    try:
        x = np.asarray(vector, dtype=np.float64)
    except TypeError:
        return None
    if x.ndim != 1 or not np.isfinite(x).all() or not (top := np.abs(x).max()):
        return None
    x = x / top + 0.0
    return x / math.sqrt(x @ x)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """``k`` unit centres of unit vectors; a centre that loses all its vectors moves to the worst served one."""
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = x @ centres.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        worst = iter(np.argsort(near.max(axis=1), kind="stable"))
        for c in range(k):
            length = np.linalg.norm(sums[c])
            centres[c] = sums[c] / length if length > 1e-9 else x[next(worst)]
    return centres


def _read(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``_id, node, vec`` of every row: the unit vector as bytes and a digest of it, null where it links with nothing."""

    def digest(vector: list | None) -> tuple[bytes | None, bytes | None]:
        if (x := unit(vector)) is None:
            return None, None
        vec = x.astype("<f8").tobytes()
        return hashlib.blake2b(vec, digest_size=16).digest(), vec

    asked = vectors.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_vec"))
    fields = {"node": ("binary", pa.binary()), "vec": ("binary", pa.binary())}
    return common.map_column(asked, "_vec", fields, lambda: lambda vectors: [digest(v) for v in vectors])


def _fit(nodes: DataFrame, counted: dict[int, int]) -> dict[int, np.ndarray]:
    """Centres by dimension, from the vectors with the smallest digests.

    Only rows whose digest is small enough to be among somewhat more than so many are ordered: what comes to the driver
    depends neither on the rows nor on the partitions.
    """
    rows = min(SAMPLE, max(1, SAMPLE_BYTES // (8 * max(counted, default=1))))
    uniform = F.conv(F.hex(F.substring("node", 1, 4)), 16, 10).cast("double") / float(1 << 32)
    near = common.stored(nodes.where(uniform * sum(counted.values()) < 1.25 * rows + 64).select("node", "vec"))
    sample = near.orderBy("node").limit(rows).select("vec").collect()
    by: dict[int, list[np.ndarray]] = {}
    for row in sample:
        by.setdefault(len(row["vec"]) // 8, []).append(np.frombuffer(row["vec"], dtype="<f8"))
    out = {}
    for dim, rows in by.items():
        k = min(-(-counted.get(dim, 1) // CELL_ROWS), MAX_CELLS, len(rows))
        out[dim] = spherical_kmeans(np.stack(rows), k)
    return out


def _cells(nodes: DataFrame, centres: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """Rows of ``nodes`` for the own cell (``probe`` false) and for later cells that may hold a partner.

    A partner w of v in cell c' is nearer to c' than to v's own centre c, and at most ``reach`` away from v, so
    v (c - c') is at most reach |c - c'|. A pair in two cells meets once: the vector of the first cell visits the other.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    apart = {d: np.linalg.norm(c[:, None] - c[None], axis=2) for d, c in centres.items()}

    def work(batch: pd.DataFrame) -> pd.DataFrame:
        dims = batch["vec"].map(len).to_numpy() // 8
        parts = [batch.iloc[:0].assign(dim=0, cell=0, probe=False)]
        for dim in np.unique(dims):
            own = batch[dims == dim]
            if dim not in centres:  # too rare for the sample: one cell
                parts.append(own.assign(dim=dim, cell=0, probe=False))
                continue
            x = np.frombuffer(b"".join(own["vec"]), dtype="<f8").reshape(len(own), dim)
            for at in range(0, len(x), 2048):
                near = x[at : at + 2048] @ centres[dim].T
                cell = near.argmax(axis=1)
                some = own.iloc[at : at + 2048]
                parts.append(some.assign(dim=dim, cell=cell, probe=False))
                visit = near[np.arange(len(near)), cell][:, None] - near <= reach * apart[dim][cell]
                visit &= np.arange(near.shape[1])[None, :] > cell[:, None]
                i, c = np.nonzero(visit)
                parts.append(some.iloc[i].assign(dim=dim, cell=c, probe=True))
        return pd.concat(parts)

    return nodes.mapInPandas(common.over_batches(work), "node binary, vec binary, weight long, dim int, cell int, probe boolean")


def _meetings(cells: DataFrame) -> DataFrame:
    """Deals members and visitors of a cell into blocks and repeats them for each pair of blocks that must be compared:
    members against members, visitors against members. No group holds more than two blocks."""
    place = ["dim", "cell"]
    rows = lambda most: F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim")))))
    counts = cells.groupBy(place).agg(
        F.ceil(F.count_if(~F.col("probe")) / rows(CELL_ROWS)).cast("int").alias("members"),
        F.ceil(F.count_if(F.col("probe")) / rows(PROBE_BLOCK)).cast("int").alias("visitors"),
    )
    upto = lambda n, kind: F.transform(
        F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>")),
        lambda k: F.struct(F.lit(kind).alias("visit"), k.alias("other")),
    )
    block = lambda n: F.pmod(F.xxhash64("node", F.lit("block")), F.col(n)).cast("int")
    met = cells.join(counts, place).withColumn("block", F.when(F.col("probe"), block("visitors")).otherwise(block("members")))
    meets = F.when(F.col("probe"), upto("members", True)).otherwise(F.concat(upto("members", False), upto("visitors", True)))
    met = met.withColumn("_m", F.explode(meets)).select("node", "vec", "weight", *place, "probe", "block", "_m.visit", "_m.other")
    # lo is the visitors' block in a visit and the lower block among members; hi is a members' block.
    swap = F.when(F.col("visit"), ~F.col("probe")).otherwise(F.col("block") > F.col("other"))
    return met.withColumns(
        {"lo": F.when(swap, F.col("other")).otherwise(F.col("block")), "hi": F.when(swap, F.col("block")).otherwise(F.col("other"))}
    ).drop("other")


def _compare(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Per vector with links in this pair of blocks: the weight of its partners, and the first vector of its group."""
    head = group.iloc[0]
    x = np.frombuffer(b"".join(group["vec"]), dtype="<f8").reshape(len(group), -1)
    weight, block, probe = (group[c].to_numpy() for c in ("weight", "block", "probe"))
    within = not head["visit"] and head["lo"] == head["hi"]
    if within:
        rows = cols = np.arange(len(x))
    elif head["visit"]:
        rows, cols = np.flatnonzero(probe), np.flatnonzero(~probe)
    else:
        rows, cols = np.flatnonzero(block == head["lo"]), np.flatnonzero(block == head["hi"])
    links, left, right = np.zeros(len(x), dtype=np.int64), [rows[:0]], [rows[:0]]
    for at in range(0, len(rows), 256):
        part = rows[at : at + 256]
        own = cols[at:] if within else cols
        i, j = np.nonzero(x[part] @ x[own].T >= threshold)
        if within:
            after = j > i
            i, j = i[after], j[after]
        i, j = part[i], own[j]
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        root = common.spanning(len(x), i, j)
        tied = np.flatnonzero(root != np.arange(len(x)))
        left.append(tied)
        right.append(root[tied])
    root = common.spanning(len(x), np.concatenate(left), np.concatenate(right))
    found, node = np.flatnonzero(links), group["node"].to_numpy()
    return pd.DataFrame({"node": node[found], "links": links[found], "root": node[root[found]]})


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD
) -> DataFrame:
    """Per row: its id, ``n_links``, ``component_id`` and ``kept``.

    All links of cosine ``threshold`` or more are found, whatever the cells are. Identical vectors are one node with a
    weight. Vectors that are null, empty, zero or hold a null or non-finite component, and vectors of other lengths,
    link with nothing. A component is named by its smallest id; where all ids are null it stays null and all its
    rows are kept. Rows that repeat an id are vectors of their own that the same name keeps. An empty table gives
    no row; other columns are not read.
    """
    rows = common.stored(_read(vectors, id_col, vec_col))
    nodes = common.stored(
        rows.where("node is not null").groupBy("node").agg(
            F.first("vec").alias("vec"), F.count("*").alias("weight"), F.min("_id").alias("least")
        )
    )
    sizes = nodes.groupBy((F.octet_length("vec") / 8).cast("int").alias("dim")).agg(F.count("*").alias("n"))
    counted = {r["dim"]: r["n"] for r in sizes.orderBy(F.desc("n")).limit(SAMPLE).collect()}
    plain = nodes.select("node", "vec", "weight")
    met = _meetings(common.stored(_cells(plain, _fit(plain, counted), threshold)))
    found = common.stored(
        met.groupBy("dim", "cell", "visit", "lo", "hi").applyInPandas(
            lambda g: _compare(g, threshold), "node binary, links long, root binary"
        )
    )
    tied = common.components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    grouped = common.stored(
        nodes.drop("vec").join(links, "node", "left").join(tied, "node", "left").select(
            "node", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("root"),
        )
    )
    names = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = common.stored(grouped.join(names, "root").select("node", "n_links", "component_id"))
    out = rows.drop("vec").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        component.eqNullSafe(F.col("_id")).alias("kept"),
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``embeddings`` at cosine 0.95."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
    SELECT vec_id AS node, vec_id AS other FROM embeddings
    UNION
    SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
), named AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, n.component_id,
       e.vec_id = n.component_id AS kept
FROM embeddings e JOIN named n ON e.vec_id = n.node
"""

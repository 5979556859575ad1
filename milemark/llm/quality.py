"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio of trusted documents to the corpus.

Everything is column functions; no Python runs on executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from milemark.llm import common

BUCKETS = 1 << 14
SMOOTHING = 1.0
# Ids up to this number are broadcast to find the trusted texts where they lie; beyond it they are joined.
BROADCAST_IDS = 1_000_000
# Without labels of both kinds: the ratio for each n-gram below which a text is refused.
DEFAULT_THRESHOLD = -0.05
BIN = 0.001
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_SHARE = 50, 50


def _words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(common.WORD), 0), F.array().cast("array<string>"))


def _grams(words: Column) -> Column:
    """(word, next word) of every word; after the last comes null. Each row stands for a unigram and a bigram."""
    return F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("b"))


def _bucket(*columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int")


def weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """Log ratio of each bucket's share among the n-grams of trusted documents and of all documents, both smoothed.

    Counts cover all rows. ``trusted`` holds ids; what comes to the driver is one row a bucket.
    """
    ids = trusted.select(F.col(id_col).alias("_id")).where("_id is not null").distinct()
    ids = common.stored(ids.withColumn("_trusted", F.lit(1)))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    some = docs.select(F.col(id_col).alias("_id"), _words(text_col).alias("w")).join(ids, "_id", "left")
    grams = some.select("_trusted", F.inline(_grams(F.col("w"))).alias("a", "b"))
    each = grams.select("_trusted", F.explode(F.array(_bucket("a"), _bucket("a", "b"))).alias("bucket"))
    counted = each.groupBy("bucket").agg(F.count("*").alias("n"), F.count("_trusted").alias("t")).collect()
    raw, target = [SMOOTHING] * BUCKETS, [SMOOTHING] * BUCKETS
    for row in counted:
        raw[row["bucket"]] += row["n"]
        target[row["bucket"]] += row["t"]
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [math.log(t) - math.log(r) + shift for r, t in zip(raw, target, strict=True)]


def _with_repeats(df: DataFrame) -> DataFrame:
    """Adds ``repeats``: words in windows (``h``, hashes of three words each, by position) that occur twice or more.

    Each step is a column of its own: an expression inside a lambda would be worked out again for every element.
    """
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    placed = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("p", F.when(F.size(F.array_distinct("h")) < F.size("h"), placed).otherwise(none))
    again = F.filter("p", lambda s, k: (s["h"] == F.get("p", k - 1)["h"]) | (s["h"] == F.get("p", k + 1)["h"]))
    df = df.withColumn("at", F.sort_array(F.transform(again, lambda s: s["i"])))
    # A window covers its three words, less those that the next repeated window covers too.
    covered = F.transform("at", lambda i, k: F.least(F.coalesce(F.get("at", k + 1) - i, F.lit(3)), F.lit(3)))
    return df.withColumn("repeats", F.aggregate(covered, F.lit(0), lambda a, x: a + x)).drop("p", "at", "h")


def measured(docs: DataFrame, table: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base counts of every row and ``ratio``, the mean log ratio of its n-grams (0 without words); row-wise."""
    some = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).select("_id", "_text", _words("_text").alias("w"))
    words = F.col("w")
    three = F.arrays_zip(
        words.alias("a"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("b"),
        F.slice(words, 3, F.greatest(F.size(words), F.lit(1))).alias("c"),
    )
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(common.WORD))
    share = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")
    total = F.aggregate(
        _grams(words), F.lit(0.0),
        lambda acc, g: acc + F.get(share, _bucket(g["a"])) + F.get(share, _bucket(g["a"], g["b"])),
    )
    windows = F.slice(
        F.transform(three, lambda g: F.xxhash64(g["a"], g["b"], g["c"])), 1, F.greatest(F.size(words) - 2, F.lit(0))
    )
    seen = _with_repeats(some.select(
        "_id", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("_text", F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        lines.alias("l"), windows.alias("h"), total.alias("total"),
    ))
    return seen.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols",
        F.coalesce(F.size("l") - F.size(F.array_distinct("l")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.col("repeats").cast("long").alias("n_repeat_words"),
        F.when(F.col("n_words") > 0, F.col("total") / (2 * F.col("n_words"))).otherwise(0.0).alias("ratio"),
    )


def threshold(scored: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> float:
    """The cut between trusted and refused labelled documents that pass the base rules: the middle of the ratios at
    which most of both are on their side. Ratios are counted in bins, of which a few thousand come to the driver."""
    said = labels.where(F.col("quality").isNotNull()).groupBy(id_col).agg((F.min("quality") > 0).alias("good"))
    known = scored.where("not base_failed").select(id_col, "ratio").join(said, id_col)
    at = F.floor(F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.col("ratio"))) / BIN)
    bins = known.groupBy(at.alias("at")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).collect()
    good, bad = sum(b["good"] for b in bins), sum(b["bad"] for b in bins)
    if not good or not bad:
        return DEFAULT_THRESHOLD
    # Cutting below bin k keeps it and all above.
    best, low, high, lost, caught = -1.0, 0, 0, 0, 0
    bins = sorted(bins, key=lambda b: b["at"])
    for before, b in zip([None, *bins], bins, strict=False):
        right = (good - lost) / good + caught / bad
        if right > best + 1e-12:
            best, low, high = right, before["at"] + 1 if before else b["at"], b["at"]
        lost, caught = lost + b["good"], caught + b["bad"]
    return BIN * (low + high) / 2


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, ``ratio``, ``base_failed`` and ``kept`` of every row.

    Too few words or too many repeated ones fail at once. All others are kept if their ratio reaches the threshold.
    Trusted are documents whose labels all say quality 1. A null or empty text has no word and fails; repeated rows are
    judged each; null ids are judged and never trusted.
    """
    trusted = labels.where("quality is not null").groupBy(id_col).agg(F.min("quality").alias("q")).where("q > 0")
    found = measured(docs, weights(docs, trusted, id_col, text_col), id_col, text_col)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_SHARE * F.col("n_words"))
    found = common.stored(found.withColumn("base_failed", failed))
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold(found, labels, id_col)))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against those labelled good."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

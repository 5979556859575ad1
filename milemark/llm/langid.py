"""Language by compression: each language has a zstandard raw-content dictionary, the smallest encoding wins."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from milemark.llm import common

UNDETERMINED = "und"
# A dictionary is fitted on at most this many different texts of a language and this many characters of each; of a
# longer text on parts of SAMPLE_PART characters from all over it.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_PART = 96, 3000, 500
DICTIONARY_BYTES = 128 << 10
LEVEL = 5
# A text is encoded in parts, so that its own beginning doesn't become the dictionary of its end.
PART_BYTES = 1024
# The runner-up must be larger by this share, and by as many bytes, or the answer is marked as rejected.
MARGIN, MARGIN_BYTES = 0.01, 3
SHARPNESS = 60.0
_OTHER = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Model:
    """Dictionary content by language, the most frequent language of the sample first."""

    content: tuple[tuple[str, bytes], ...]


def plain(text: str) -> bytes:
    """Lower case, and any run of characters other than letters as one space: what tells languages apart."""
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Dictionaries from a bounded sample of each language, chosen by the text's hash and the same on every run.

    Rows with a null language or text teach nothing. A text that a language has several times counts once.
    """
    some = labelled.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")
    )
    # Hashes first: texts are read for the sample only, and copies are one before any of them is ranked.
    chosen = common.stored(common.sample_by_group(some.select("lang", "h").distinct(), "lang", "h", SAMPLE_DOCS))
    chosen = F.broadcast(chosen) if chosen.count() <= 1_000_000 else chosen  # two short columns
    parts = some.join(chosen, ["lang", "h"]).withColumn("text", common.spread("text", "h", SAMPLE_CHARS, SAMPLE_PART))
    picked = parts.groupBy("lang", "h").agg(F.min("text").alias("text"))
    texts: dict[str, list[str]] = {}
    for row in picked.orderBy("lang", "h").collect():
        texts.setdefault(row["lang"], []).append(row["text"])
    ranked = sorted(texts, key=lambda lang: (-len(texts[lang]), lang))
    # The last bytes are the cheapest to point at; all dictionaries get the same size, or size would decide.
    joined = {lang: plain(" ".join(texts[lang])) for lang in ranked}
    most = max(4096, min([DICTIONARY_BYTES, *(len(x) for x in joined.values() if len(x) >= 4096)]))
    return Model(tuple((lang, joined[lang][-most:]) for lang in ranked))


class Classifier:
    def __init__(self, model: Model):
        self.langs = [lang for lang, _ in model.content]
        self._encoders = []
        for _, content in model.content:
            # Very short content is padded: a dictionary needs eight bytes.
            own = zstandard.ZstdCompressionDict(content.rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=LEVEL)
            self._encoders.append(zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> np.ndarray:
        """Bytes of the whole text under each language's dictionary."""
        data = memoryview(plain(text))
        parts = [data[at : at + PART_BYTES] for at in range(0, len(data), PART_BYTES)]
        return np.array([sum(len(e.compress(p)) for p in parts) for e in self._encoders], dtype=np.int64)

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the margin to the second is too narrow."""
        if text is None or not self.langs or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True
        sizes = self.sizes(text)
        order = np.argsort(sizes, kind="stable")
        best = sizes[order[0]]
        shares = np.exp(-SHARPNESS * (sizes - best) / best)
        gap = sizes[order[1]] - best if len(order) > 1 else best
        return self.langs[order[0]], float(1 / shares.sum()), bool(gap < max(MARGIN_BYTES, MARGIN * best))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``lang_pred``, ``score`` and ``rejected`` of every row, from its whole text alone.

    ``und`` (score 0, rejected) for a null text, one without a letter, or a model without languages. Equal sizes go to
    the language with more sampled texts. Repeated rows and null ids are judged like others.
    """

    def work():
        own = Classifier(model)
        return lambda texts: [own.judge(t) for t in texts]

    fields = {"lang_pred": ("string", pa.string()), "score": ("double", pa.float64()), "rejected": ("boolean", pa.bool_())}
    asked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return common.map_column(asked, "_text", fields, work).withColumnRenamed("_id", id_col)


def fold(id_col: str | Column, folds: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; learned from those whose fold is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = classify(docs, fit(docs.where(fold("doc_id", 3) != 1)))
    return found.withColumn("held_out", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)))

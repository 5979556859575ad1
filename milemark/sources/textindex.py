"""An inverted table of word beginnings, so that a text search reads the few files that its terms fall into."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from milemark import config as C
from milemark.functions.keys import record_key
from milemark.operators import explore
from milemark.sources.store import read_or_none

WORD, RECORD, PART, STEP = "palavra", "registro", "parte", "passo"
# Characters of a word that are stored; a longer term is looked up by as many and then compared in the texts.
WIDTH = 40
# Parts of a run at most, unless one would hold more than a full part's words. Each is a task, a folder and a file, and each
# task before the exchange writes to all of them.
MOST_PARTS, FULL_PART = 256, 5_000_000
# Where a term may begin (not after a letter or a hyphen) and what follows there up to white space, which no term holds.
_SPACE = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_BEGINNING = rf"(?<![\p{{L}}-])(?=([^{_SPACE}]{{1,{WIDTH}}}))"
_MANIFEST = f"run string, {STEP} int"
_SPANS = f"{PART} int, de string, ate string, run string"


def folded(c: Column) -> Column:
    """Equal for any two texts that are equal but for case. It may be equal for some others too."""
    # The translations between upper and lower keep the optimizer from dropping the inner one of the two.
    upper = F.upper(F.translate(c, "İẞ", "iß"))
    wide = F.translate(F.lower(F.translate(upper, "ς", "σ")), "ς", "σ")
    # A translation looks up every character; a text of ASCII only, which has as many bytes, needs none.
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(wide)


def beginnings(columns: Sequence[str]) -> Column:
    """The different beginnings of words in the given columns of a row, folded. Null holds none."""
    none = F.array().cast("array<string>")
    found = [
        F.coalesce(F.regexp_extract_all(F.col(f"`{c}`").cast("string"), F.lit(_BEGINNING), F.lit(1)), none) for c in columns
    ]
    return F.array_distinct(F.transform(F.concat(*found), folded))


def part_count(words: int, rows_per_part: int) -> int:
    """Parts for so many words: of ``rows_per_part``, or of more where these would be over ``MOST_PARTS``."""
    parts = lambda n: max(1, -(-words // n))
    return min(parts(rows_per_part), max(MOST_PARTS, parts(FULL_PART)))


def logged_keys(events: DataFrame, spec: C.DiffSpec = C.CONTRACT_DIFF) -> DataFrame:
    """Keys of the records that a change log names, as ``TextIndex.update`` takes them."""
    shown = (spec.key_output, *(["cod_saci"] if spec.code_field else []))
    return events.select(record_key(events, shown).alias(RECORD)).distinct()


class TextIndex:
    """``path/words`` holds (beginning of a word, record) sorted by word, in parts; ``path/spans`` the first and last word
    of each part, ``path/touched`` the records of each update and ``path/manifest`` the updates in their order.
    ``path/found`` keeps the words of each run as they were found, before they are sorted.

    A search reads the parts whose span meets a term, as row groups that hold it, and compares the texts of the records
    found, so it gives the rows of ``explore.text_search``. A frequent word lies in as many parts as its records fill.
    An update adds words of the records that changed and makes their earlier ones void; the index grows with the changes
    until it is built anew. Records without a key share the empty one. The manifest is written last; what it does not
    list is not read.
    """

    def __init__(
        self, spark: SparkSession, path: str, columns: Sequence[str],
        candidates: Sequence[str] = C.CONTRACT_DIFF.key_candidates, rows_per_part: int = FULL_PART,
    ):
        self.spark, self.columns, self.candidates = spark, list(columns), tuple(candidates)
        self.rows_per_part = rows_per_part
        self.words_path, self.spans_path = f"{path}/words", f"{path}/spans"
        self.touched_path, self.manifest_path, self.found_path = f"{path}/touched", f"{path}/manifest", f"{path}/found"

    def _steps(self) -> dict[int, str]:
        manifest = read_or_none(self.spark, self.manifest_path, _MANIFEST)
        return {} if manifest is None else {r[STEP]: r["run"] for r in sorted(manifest.collect(), key=lambda r: r[STEP])}

    def _key(self, df: DataFrame) -> Column:
        return F.coalesce(record_key(df, self.candidates), F.lit(""))

    def build(self, df: DataFrame) -> None:
        """Indexes a whole table: one pass that finds its words, one that writes them, with an exchange by ranges of words."""
        if self._steps():
            raise ValueError("the index already holds words; build in a new folder")
        self._add(df.select(self._key(df).alias(RECORD), *[F.col(f"`{c}`") for c in self.columns]), uuid.uuid4().hex, 0)

    def update(self, df: DataFrame, keys: DataFrame) -> None:
        """Indexes the rows of ``df`` whose key is in the first column of ``keys`` in the place of their earlier ones.

        A key without rows is a record that left. Keys from a change log cover the fields that it compares.
        """
        steps = self._steps()
        if not steps:
            raise ValueError("build the index first")
        run, step = uuid.uuid4().hex, max(steps) + 1
        named = keys.toDF(RECORD, *[f"_{k}" for k in range(1, len(keys.columns))])
        named = named.select(F.coalesce(F.col(RECORD).cast("string"), F.lit("")).alias(RECORD)).distinct()
        named.withColumn(STEP, F.lit(step)).write.parquet(f"{self.touched_path}/run={run}")
        touched = self.spark.read.schema(f"{RECORD} string").parquet(f"{self.touched_path}/run={run}")
        rows = df.select(self._key(df).alias(RECORD), *[F.col(f"`{c}`") for c in self.columns])
        self._add(rows.join(touched, RECORD, "left_semi"), run, step)

    def _add(self, rows: DataFrame, run: str, step: int) -> None:
        # Finding words takes far longer than reading rows, which may be few bytes and so lie in one task: they are dealt out.
        rows = rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        # Written once: the count, the sample that gives the ranges and the exchange would each find the words again.
        found = rows.select(RECORD, F.explode(beginnings([c for c in rows.columns if c != RECORD])).alias(WORD))
        found.write.parquet(f"{self.found_path}/{run}")
        words = self.spark.read.schema(f"{RECORD} string, {WORD} string").parquet(f"{self.found_path}/{run}")
        parts = part_count(words.count(), self.rows_per_part)
        dealt = words.repartitionByRange(parts, WORD, RECORD).withColumn(PART, F.spark_partition_id())
        # The part comes first, or the writer would sort by it again and lose the order of words.
        ordered = dealt.withColumn(STEP, F.lit(step)).sortWithinPartitions(PART, WORD, RECORD)
        ordered.write.partitionBy(PART).parquet(f"{self.words_path}/{run}")
        written = read_or_none(self.spark, f"{self.words_path}/{run}", f"{WORD} string, {PART} int")
        if written is not None:
            spans = written.groupBy(PART).agg(F.min(WORD).alias("de"), F.max(WORD).alias("ate"))
            spans.withColumn("run", F.lit(run)).write.parquet(f"{self.spans_path}/{run}")
        listed = self.spark.range(1).select(F.lit(run).alias("run")).coalesce(1)
        listed.write.mode("overwrite").parquet(f"{self.manifest_path}/{STEP}={step}")

    def entries(self, term: str) -> DataFrame:
        """Stored words that begin like the term, with record and step, void ones too; only parts that may hold some are read.

        The parts' numbers come to the driver; there are as many as ``part_count`` gives for each run.
        """
        schema = f"{WORD} string, {RECORD} string, {STEP} int"
        runs = list(self._steps().values())
        spans = [s for run in runs if (s := read_or_none(self.spark, f"{self.spans_path}/{run}", _SPANS)) is not None]
        if not spans:
            return self.spark.createDataFrame([], schema)
        known = spans[0]
        for some in spans[1:]:
            known = known.unionByName(some)
        asked = self.spark.range(1).select(folded(F.lit(term[:WIDTH])).alias("t")).first()["t"]
        cut = lambda c: F.substring(c, 1, len(asked))
        met = known.where((cut("de") <= F.lit(asked)) & (cut("ate") >= F.lit(asked))).collect()
        paths = [f"{self.words_path}/{r['run']}/{PART}={r[PART]}" for r in met]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths).where(F.col(WORD).startswith(asked))

    def records(self, term: str) -> DataFrame:
        """Keys of the records that may hold the term."""
        found, runs = self.entries(term), [run for step, run in self._steps().items() if step]
        if runs:
            paths = [f"{self.touched_path}/run={run}" for run in runs]
            touched = self.spark.read.schema(f"{RECORD} string, {STEP} int").parquet(*paths)
            last = touched.groupBy(RECORD).agg(F.max(STEP).alias("_last"))
            found = found.join(last, RECORD, "left").where(F.col("_last").isNull() | (F.col(STEP) >= F.col("_last")))
        return found.select(RECORD).distinct()

    def search(self, df: DataFrame, query: str) -> DataFrame:
        """The rows of ``df``, the table as last indexed, that ``explore.text_search`` gives; no term gives all."""
        names = df.columns
        rows = df.select("*", self._key(df).alias("_registro_indice"))
        for term in query.split():
            keys = self.records(term).withColumnRenamed(RECORD, "_registro_indice")
            rows = rows.join(keys, "_registro_indice", "left_semi")
        return explore.text_search(rows.select(*[F.col(f"`{c}`") for c in names]), self.columns, query)

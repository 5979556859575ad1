"""The base as of any stored day, kept as intervals of days in which a record did not change."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from milemark import config as C
from milemark.functions.keys import KEY, record_key
from milemark.sources import marks
from milemark.sources.marks import ROW
from milemark.sources.store import DAY, read_or_none

SINCE, UNTIL = "desde", "ate"
_CLOSED, _DIGEST = "_fechado", "_resumo"
_MANIFEST = f"fields array<string>, run string, {DAY} string"


def intervals(rows: DataFrame, days: Sequence[str], spec: C.DiffSpec = C.CONTRACT_DIFF) -> DataFrame:
    """Rows of a history as one row for each unbroken run of stored days on which a record had the same values.

    ``desde`` and ``ate`` are the first and last of these days. A record that leaves and comes back has two runs. Values
    are compared as stored, null apart from blank. One exchange by record key; a missing or repeated key fails.
    """
    fields = [c for c in rows.columns if c != DAY]
    known = F.array(*[F.lit(d) for d in sorted(days)])
    dated = rows.select(
        *[F.col(f"`{c}`").cast("string").alias(c) for c in fields], _key(rows, spec).alias(KEY),
        F.array_position(known, F.col(DAY).cast("string")).cast("int").alias("_ord"),
    )
    if spec.skip_blank_keys:
        dated = dated.where(F.col(KEY).isNotNull())
    begins = _runs(dated, F.struct(*[F.col(f"`{c}`") for c in fields]))
    return begins.select(
        *[F.col(f"`{c}`") for c in fields], KEY, F.element_at(known, F.col("_ord")).alias(SINCE), F.element_at(known, F.col("_last")).alias(UNTIL)
    )


def _runs(dated: DataFrame, own: Column) -> DataFrame:
    """Of rows by key and ``_ord`` those that begin a run of equal ``own``, with ``_last``, the day it ends on."""
    w = Window.partitionBy(KEY).orderBy("_ord")
    seen = dated.select(
        "*", F.lag("_ord").over(w).alias("_before"), F.lag(own).over(w).alias("_old"),
        F.max("_ord").over(Window.partitionBy(KEY)).alias("_end"),
    )
    repeated = F.raise_error(F.concat(F.lit("duplicated snapshot key: "), F.col(KEY))).cast("boolean")
    follows = F.coalesce(F.col("_before") == F.col("_ord") - 1, F.lit(False)) & own.eqNullSafe(F.col("_old"))
    begins = seen.where(F.when(F.col("_before") == F.col("_ord"), repeated).otherwise(~follows)).drop("_old")
    return begins.withColumn("_last", F.coalesce(F.lead("_before").over(w), F.col("_end")))


def _key(df: DataFrame, spec: C.DiffSpec):
    missing = F.raise_error(F.lit(f"snapshot row without a key ({', '.join(spec.key_candidates)})"))
    key = record_key(df, spec.key_candidates)
    return key if spec.skip_blank_keys else F.coalesce(key, missing)


class ValidityStore:
    """``path/begun`` holds a row for each record that entered or changed on a day, ``path/ended`` the key of each whose
    row ended before it, ``path/manifest`` the header of every day and the run that wrote it.

    New rows are stored as they lie (``path/staged``, replaced by the next ones); only keys and digests of rows (128 bits
    of SHA-256) are exchanged to be compared, and the rows that began or ended are found by their place.

    Both only grow, by what changed on a day, however large the base is. The manifest is written last; what it does not
    list, left by a run that was stopped or by an earlier version of the last day, is not read.
    """

    def __init__(self, spark: SparkSession, path: str, spec: C.DiffSpec = C.CONTRACT_DIFF):
        self.spark, self.spec = spark, spec
        self.begun_path, self.ended_path = f"{path}/begun", f"{path}/ended"
        self.moved_path, self.manifest_path = f"{path}/moved", f"{path}/manifest"
        self.staged_path = f"{path}/staged"

    def _listed(self) -> dict:
        manifest = read_or_none(self.spark, self.manifest_path, _MANIFEST)
        return {} if manifest is None else {r[DAY]: r for r in sorted(manifest.collect(), key=lambda r: r[DAY])}

    def days(self) -> list[str]:
        return list(self._listed())

    def _list(self, headers: Mapping[str, Sequence[str]], run: str) -> None:
        rows = [(list(fields), run, day) for day, fields in headers.items()]
        listed = self.spark.createDataFrame(rows, _MANIFEST).coalesce(1)
        listed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(self.manifest_path)

    def build(self, rows: DataFrame, headers: Mapping[str, Sequence[str]]) -> None:
        """Takes over a whole history, laid out as ``SnapshotStore.history`` gives it."""
        if self.days():
            raise ValueError("the store already holds days; build in a new folder")
        run, days = uuid.uuid4().hex, sorted(headers)
        staged, fields = self._stage(rows.withColumnRenamed(DAY, SINCE), F.col(SINCE).cast("string")), [c for c in rows.columns if c != DAY]
        known = F.array(*[F.lit(d) for d in days])
        slim = staged.select(KEY, F.array_position(known, F.col(SINCE)).cast("int").alias("_ord"), _DIGEST, ROW)
        begins = _runs(slim, F.col(_DIGEST)).select(KEY, F.element_at(known, F.col("_ord")).alias(SINCE), F.element_at(known, F.col("_last")).alias(UNTIL), ROW)
        moved = self._moved(begins, run)
        self._begin(marks.picked(staged, moved), fields, run)
        after = F.create_map(*[F.lit(x) for pair in zip(days, days[1:]) for x in pair]) if len(days) > 1 else None
        closed = F.lit(None).cast("string") if after is None else after[F.col(UNTIL)]
        moved.where(F.col(UNTIL) < days[-1]).withColumn(_CLOSED, closed).write.parquet(f"{self.ended_path}/run={run}")
        self._list({d: headers[d] for d in days}, run)

    def _stage(self, df: DataFrame, since: Column) -> DataFrame:
        """Rows as text with their key, first day, digest and number, stored as they lie and read back."""
        fields = [c for c in df.columns if c != SINCE]
        texts = {c: F.col(f"`{c}`").cast("string") for c in fields}
        keyed = df.select(*[t.alias(c) for c, t in texts.items()], _key(df, self.spec).alias(KEY), since.alias(SINCE))
        if self.spec.skip_blank_keys:
            keyed = keyed.where(F.col(KEY).isNotNull())
        whole = marks.numbered(keyed.withColumn(_DIGEST, marks.digest({c: F.col(f"`{c}`") for c in fields})))
        whole.write.mode("overwrite").parquet(self.staged_path)
        return self.spark.read.schema(whole.schema).parquet(self.staged_path)

    def _moved(self, df: DataFrame, run: str) -> DataFrame:
        path = f"{self.moved_path}/run={run}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _begin(self, staged: DataFrame, fields: Sequence[str], run: str) -> None:
        begun = staged.select(*[F.col(f"`{c}`") for c in fields], KEY, SINCE, _DIGEST, ROW)
        begun.write.parquet(f"{self.begun_path}/run={run}")

    def extend(self, df: DataFrame, day: str) -> None:
        """Adds the day after the last one, or puts other rows in the place of the last one.

        A day before the last would change the runs of all days after it and is refused. One exchange of the keys and
        digests of the new rows and of the base before them.
        """
        listed = self._listed()
        before = [d for d in listed if d < day]
        if before != [d for d in listed if d != day]:
            raise ValueError(f"{day} is before {max(listed)}: days come in order")
        run, fields, staged = uuid.uuid4().hex, df.columns, self._stage(df, F.lit(day))
        once = f"case when _n > 1 then raise_error(concat('duplicated snapshot key: ', {KEY})) else true end"
        slim = staged.select(KEY, F.col(_DIGEST).alias("b"), F.col(ROW).alias("_new"))
        new = slim.withColumn("_n", F.count("*").over(Window.partitionBy(KEY))).where(F.expr(once)).drop("_n")
        if before:
            known = F.array(*[F.lit(d) for d in before])
            bare = F.raise_error(F.lit("stored row without a digest: build the store in a new folder")).cast("binary")
            old = self._valid(before[-1], listed).select(
                KEY, F.array_position(known, F.col(SINCE)).cast("int").alias("_ord"), F.coalesce(_DIGEST, bare).alias("a"), F.col(ROW).alias("_old")
            )
            both = old.join(new, KEY, "full").where(~F.col("a").eqNullSafe(F.col("b"))).drop("a", "b")
        else:
            known = F.array(F.lit(day))
            both = new.select(KEY, F.lit(None).cast("int").alias("_ord"), F.lit(None).cast("long").alias("_old"), "_new")
        moved = self._moved(both, run)
        self._begin(marks.picked(staged, moved.where(F.col("_new").isNotNull()).select(F.col("_new").alias(ROW))), fields, run)
        if before:
            left = moved.where(F.col("_old").isNotNull())
            ends = left.select(KEY, F.element_at(known, F.col("_ord")).alias(SINCE), F.lit(before[-1]).alias(UNTIL), F.col("_old").alias(ROW), F.lit(day).alias(_CLOSED))
            ends.write.parquet(f"{self.ended_path}/run={run}")
        self._list({day: fields}, run)

    def _read(self, path: str, columns: Sequence[str], when: str, listed: Mapping) -> DataFrame | None:
        """Rows of listed runs that were written for the day in column ``when`` by the run that the day has now."""
        kinds = {_DIGEST: "binary", ROW: "long"}
        found = read_or_none(self.spark, path, ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in [*columns, "run"]))
        if found is None or not listed:
            return None
        runs = F.create_map(*[F.lit(x) for d, r in listed.items() for x in (d, r["run"])])
        some = found.where(F.col("run").isin(sorted({r["run"] for r in listed.values()})))
        return some.where(F.col("run") == runs[F.col(when)]).drop("run")

    def _valid(self, day: str, listed: Mapping) -> DataFrame:
        until = {d: r for d, r in listed.items() if d <= day}
        fields = list(dict.fromkeys(f for r in until.values() for f in r["fields"]))
        begun = self._read(self.begun_path, [*fields, KEY, SINCE, _DIGEST, ROW], SINCE, until)
        ended = self._read(self.ended_path, [SINCE, ROW, _CLOSED], _CLOSED, until)
        return begun if ended is None else marks.picked(begun, ended, [SINCE], keep=False)

    def at(self, day: str) -> DataFrame:
        """The base of a stored day under the header it had: what had begun by then and not ended."""
        listed = self._listed()
        return self._valid(day, listed).select(*[F.col(f"`{c}`") for c in listed[day]["fields"]])

    def intervals(self) -> DataFrame:
        """All runs, as ``intervals`` gives them for the whole history."""
        listed = self._listed()
        fields = list(dict.fromkeys(f for r in listed.values() for f in r["fields"]))
        begun = self._read(self.begun_path, [*fields, KEY, SINCE], SINCE, listed)
        ended = self._read(self.ended_path, [KEY, SINCE, UNTIL, _CLOSED], _CLOSED, listed)
        if ended is None:
            return begun.withColumn(UNTIL, F.lit(max(listed)))
        joined = begun.join(ended.drop(_CLOSED), [KEY, SINCE], "left")
        return joined.select(*[F.col(f"`{c}`") for c in fields], KEY, SINCE, F.coalesce(UNTIL, F.lit(max(listed))).alias(UNTIL))

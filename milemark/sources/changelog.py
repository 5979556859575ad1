"""The cumulative change log, kept by day next to a snapshot store.

A day's events come from that snapshot and the one before it. The log remembers for each day which two snapshots, in which
version, it was made from, so that only days whose pair has changed since are compared again.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from milemark import config as C
from milemark import session
from milemark.functions.keys import KEY
from milemark.operators import diff
from milemark.sources import marks, store
from milemark.sources.store import SnapshotStore, read_or_none

DAY = "data"
# Days that are compared by digests first; their sets fit a number of 64 bits.
DIGEST_DAYS = 62
_MADE_FROM = "made_from array<string>, run string, data string"


class ChangeLog:
    """``path/events`` holds the events by day, ``path/manifest`` what each day was made from.

    The manifest is written last and has one row per day. Events that it does not list, left by a run that was stopped or
    by an earlier version of a day, are not read.
    """

    def __init__(self, store: SnapshotStore, path: str, spec: C.DiffSpec = C.CONTRACT_DIFF):
        self.store, self.spec = store, spec
        self.events_path, self.manifest_path = f"{path}/events", f"{path}/manifest"
        self.moved_path = f"{path}/moved"

    def _wanted(self) -> dict[str, list[str]]:
        """By day the snapshots that its events come from: (day before, its version, own version)."""
        versions = self.store.versions()
        days = list(versions)
        return {d: [p, versions[p], versions[d]] for p, d in zip(days, days[1:])}

    def _made(self) -> dict[str, tuple[list[str], str]]:
        manifest = read_or_none(self.store.spark, self.manifest_path, _MADE_FROM)
        return {} if manifest is None else {r[DAY]: (list(r["made_from"]), r["run"]) for r in manifest.collect()}

    def stale(self) -> list[str]:
        """Days to compare: new ones, those stored again, and those whose day before is another or was stored again."""
        made = self._made()
        return [d for d, pair in self._wanted().items() if made.get(d, (None, None))[0] != pair]

    def update(self) -> list[str]:
        """Compares the stale days and appends or replaces their events; returns them.

        Neighbouring stale days are compared together. A new day reads two snapshots, one that is stored again or arrives
        late three, however long the history is. A run that is stopped is made up for by the next one.
        """
        wanted, stale = self._wanted(), self.stale()
        days = list(self.store.versions())
        groups: list[list[str]] = []
        for d in stale:
            if groups and days.index(groups[-1][-1]) == days.index(d) - 1:
                groups[-1].append(d)
            else:
                groups.append([d])
        for group in groups:
            run = uuid.uuid4().hex
            dynamic = {"partitionOverwriteMode": "dynamic"}
            with session.compiled(self.store.spark):
                rows, headers = self._moved([wanted[group[0]][0], *group])
                events = diff.diff_history(rows, headers, self.spec).withColumn("run", F.lit(run))
                events.write.mode("overwrite").options(**dynamic).partitionBy(DAY).parquet(self.events_path)
            listed = [(wanted[d], run, d) for d in group]
            made = self.store.spark.createDataFrame(listed, _MADE_FROM).coalesce(1)
            made.write.mode("overwrite").options(**dynamic).partitionBy(DAY).parquet(self.manifest_path)
        return stale

    def _moved(self, days: list[str]) -> tuple[DataFrame, dict[str, list[str]]]:
        """The history of these days without the records that have one row with the same compared values on each of them,
        which make no event.

        Only keys and digests are exchanged to find them; the places of the others (``path/moved``, replaced by the next)
        are brought to the rows. Days that were stored without places, or very many, are given whole.
        """
        rows, headers = self.store.history(days)
        numbered, _ = self.store.numbered(days)
        if len(days) > DIGEST_DAYS or numbered.where(F.col(marks.ROW).isNull()).limit(1).count():
            return rows, headers
        own = diff.record_digests(numbered, headers, self.spec, [marks.ROW])
        # Days as a set of bits and rows counted: a repeated key stays, and is refused by the comparison.
        w, every = Window.partitionBy(KEY), F.lit((1 << len(days) + 1) - 2)
        # A digest that no day of a record has says nothing of it.
        alike = [F.coalesce(F.min(c).over(w) == F.max(c).over(w), F.lit(True)) for c in own.columns if c.startswith("digest_")]
        seen = own.select(
            "ord", marks.ROW, (F.count("*").over(w) == len(days)).alias("n"), F.expr("bit_or(shiftleft(1L, ord))").over(w).alias("days"),
            reduce(lambda a, b: a & b, alike).alias("same"),
        )
        day = F.element_at(F.array(*[F.lit(d) for d in sorted(days)]), F.col("ord")).alias(store.DAY)
        moved = seen.where(~(F.col("n") & F.col("same") & (F.col("days") == every))).select(day, marks.ROW)
        moved.write.mode("overwrite").parquet(self.moved_path)
        places = self.store.spark.read.schema(moved.schema).parquet(self.moved_path)
        return marks.picked(numbered, places, [store.DAY]).drop(marks.ROW), headers

    def events(self) -> DataFrame:
        """All events, as ``diff_history`` over the whole store gives them."""
        spark = self.store.spark
        wanted, runs = self._wanted(), {d: run for d, (_, run) in self._made().items()}
        rows, headers = self.store.history(list(self.store.versions())[:2])
        schema = diff.diff_history(rows, headers, self.spec).schema if len(headers) > 1 else None
        if schema is None:
            raise ValueError("a change log begins with the second snapshot")
        # The day is a partition: a run reads the listed ones only.
        listed = F.create_map(*[F.lit(x) for d in wanted if d in runs for x in (d, runs[d])])
        found = read_or_none(spark, self.events_path, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema if f.name != DAY)}, run string, {DAY} string")
        if found is None or not any(d in runs for d in wanted):
            return spark.createDataFrame([], schema)
        some = found.where(F.col(DAY).isin([d for d in wanted if d in runs]))
        return some.where(F.col("run") == listed[F.col(DAY)]).select(*schema.names)

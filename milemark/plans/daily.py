"""The daily update: enrich, store the snapshot, compare, publish."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milemark import config as C
from milemark.functions.keys import record_key
from milemark.operators import aggregates, diff, joins, skew
from milemark.plans import contract_base, legacy
from milemark.sources import files
from milemark.sources.changelog import ChangeLog
from milemark.sources.store import SnapshotStore


@dataclass(frozen=True)
class DailyPaths:
    """Where a day's outputs are written."""

    base: str
    documents: str
    previous: str
    first: str
    detail: str
    report: str
    changes: str
    summary: str
    freshness: str
    published: str
    log: str

    @classmethod
    def under(cls, root: str, day: str) -> DailyPaths:
        return cls(
            base=f"{root}/base", documents=f"{root}/documents", previous=f"{root}/previous", first=f"{root}/first",
            detail=f"{root}/detail/{day}", report=f"{root}/report/{day}", changes=f"{root}/changes",
            summary=f"{root}/summary", freshness=f"{root}/freshness",
            published=f"{root}/published", log=f"{root}/log",
        )


def run_contracts(
    sources: Mapping[str, DataFrame], store: SnapshotStore, paths: DailyPaths, day: str, cfg: C.Settings
) -> str | None:
    """One daily run; returns the day compared with, None on the first.

    Every stage reads what the stage before has written, so no plan is computed twice and a
    lost executor repeats one stage only.
    """
    spark = store.spark
    # The sources are stored tables here, so their keys may be counted first.
    contract_base.enrich(sources, cfg, skew.ROWS_PER_SPLIT).write.mode("overwrite").parquet(paths.base)
    base = spark.read.parquet(paths.base)
    # Before anything else: a refused day must not stay in the store.
    joins.check_keys(base, C.CONTRACT_DIFF.key_candidates, f"snapshot {day}")
    files.write_quoted_csv(contract_base.doc_detail(sources, base), paths.documents)

    files.write_quoted_csv(base, paths.published)

    store.write(base, day)
    current = store.at(day)
    before, first = store.previous(day), store.oldest()
    files.write_quoted_csv(store.previous_or_current(day), paths.previous)
    files.write_quoted_csv(store.at(first), paths.first)

    # Only days whose own or earlier snapshot is new are compared; the published log is written from the kept one.
    if before is not None:
        log = ChangeLog(store, paths.log)
        log.update()
        files.write_quoted_csv(diff.change_log(diff.order_history(log.events())), paths.changes)
    else:
        empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in diff.LOG_COLUMNS))
        files.write_quoted_csv(empty, paths.changes)

    dates = {"atual": day, "anterior": before, "primeiro": first}
    if before is None:
        files.write_summary_json(diff.diff_summary(None, current, dates), paths.summary)
    else:
        previous = store.at(before)
        detail = diff.order_detail(diff.diff_detail(previous, current)).select(*diff.DETAIL_COLUMNS)
        files.write_quoted_csv(detail, paths.detail)
        summary = diff.diff_summary(previous, current, dates, files.read_snapshot(spark, paths.detail))
        files.write_summary_json(summary, paths.summary)
        files.write_report(spark.read.json(paths.summary, schema=summary.schema), paths.report)
    fresh = aggregates.freshness(sources, day, cfg)
    files.write_summary_json(files.freshness_document(fresh, day), paths.freshness)
    return before


def run_legacy(sheet: DataFrame, store: SnapshotStore, paths: DailyPaths, today: str) -> str:
    """One run for the legacy works; returns the date of the stored snapshot."""
    spark = store.spark
    rows = legacy.extract(sheet)
    latest = rows.agg(F.max(F.nullif(F.col("dt_atualizacao"), F.lit("")))).first()[0]
    day = latest or today
    # Before anything else: a refused day must not stay in the store. Works without a key are left out, as in the log.
    keyed = rows.where(record_key(rows, C.LEGACY_DIFF.key_candidates).isNotNull())
    joins.check_keys(keyed, C.LEGACY_DIFF.key_candidates, f"snapshot {day}")
    store.write(rows, day)
    files.write_quoted_csv(store.at(day), paths.base)
    days = store.days()
    if len(days) > 1:
        log = ChangeLog(store, paths.log, C.LEGACY_DIFF)
        log.update()
        events = log.events()
    else:
        events = diff.diff_history(*store.history(), C.LEGACY_DIFF)
    files.write_quoted_csv(diff.legacy_log(events), paths.changes)
    ends = sorted({days[0], *days[-2:]})
    files.write_summary_json(diff.legacy_summary(events, store.history(ends)[0], days), paths.summary)
    return day

"""Snapshots kept in parts with digests, so that a comparison reads only the parts in which two days differ."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milemark import config as C
from milemark.functions.keys import KEY, record_key
from milemark.functions.text import strip_sql
from milemark.operators import diff
from milemark.sources.store import DAY, read_or_none

PART = "_parte"
_MANIFEST = f"fields array<string>, parts int, version string, {DAY} string"
_DIGESTS = "part int, n bigint, keys bigint, digests map<string, bigint>"


class DigestedSnapshots:
    """``path/rows`` holds the days by version and part of the record key, ``path/digests`` a row for each part of a day.

    A digest covers one field of a part: all its records' keys and stripped values, in any order. A part whose keys and
    compared fields have equal digests on both days holds no event and is not read. Digests are by field, so days with
    other headers are compared on what both have. They have 64 bits: two parts that differ look equal by a chance of one
    in 2^64 for each field. Keys must be there and be unique when a day is stored, as parts that are not read can't tell
    later. The manifest is written last.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int, spec: C.DiffSpec = C.CONTRACT_DIFF):
        self.spark, self.parts, self.spec = spark, parts, spec
        self.rows_path, self.digests_path, self.manifest_path = f"{path}/rows", f"{path}/digests", f"{path}/manifest"

    def write(self, df: DataFrame, day: str) -> None:
        """Stores a day as text where its rows lie: only its keys, read off what was written, are exchanged to check them.

        Every task writes a file for each part that it has rows of. A missing or repeated key fails before the day is listed.
        """
        missing = F.raise_error(F.lit(f"snapshot row without a key ({', '.join(self.spec.key_candidates)})"))
        keyed = df.withColumn(KEY, record_key(df, self.spec.key_candidates))
        if self.spec.skip_blank_keys:
            keyed = keyed.where(F.col(KEY).isNotNull())
        text = keyed.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns], F.coalesce(KEY, missing).alias(KEY))
        dealt = text.withColumn(PART, F.pmod(F.xxhash64(KEY), F.lit(self.parts)).cast("int"))
        version = uuid.uuid4().hex
        dealt.write.partitionBy(PART).parquet(f"{self.rows_path}/{version}")
        counted = self._rows(version, []).groupBy(KEY).agg(F.count("*").alias("_n"))
        # One condition on both, or the failing half would be pushed below the count.
        repeated = f"case when _n > 1 then raise_error(concat('duplicated snapshot key: ', {KEY})) else false end"
        counted.where(F.expr(repeated)).count()
        self._digests(version, df.columns).write.parquet(f"{self.digests_path}/{version}")
        listed = self.spark.createDataFrame([(df.columns, self.parts, version)], _MANIFEST.rsplit(",", 1)[0])
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.manifest_path}/{DAY}={day}")

    def _rows(self, version: str, fields: list[str]) -> DataFrame:
        columns = ", ".join(f"`{c}` string" for c in [*fields, KEY])
        return self.spark.read.schema(f"{columns}, {PART} int").parquet(f"{self.rows_path}/{version}")

    def _digests(self, version: str, fields: list[str]) -> DataFrame:
        rows = diff.prepare(self._rows(version, fields), self.spec)
        names = [c for c in rows.columns if c not in (KEY, PART)]
        value = lambda c: F.expr(strip_sql(f"coalesce(`{c}`, '')"))
        digests = [F.bit_xor(F.xxhash64(KEY, value(c))).alias(f"d{k}") for k, c in enumerate(names)]
        found = rows.groupBy(F.col(PART).alias("part")).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(KEY)).alias("keys"), *digests)
        by_name = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(f"d{k}") for k in range(len(names))]))
        return found.select("part", "n", "keys", by_name.alias("digests"))

    def _listed(self) -> dict:
        manifest = read_or_none(self.spark, self.manifest_path, _MANIFEST)
        return {} if manifest is None else {r[DAY]: r for r in sorted(manifest.collect(), key=lambda r: r[DAY])}

    def days(self) -> list[str]:
        return list(self._listed())

    def at(self, day: str) -> DataFrame:
        """The rows of a day under its header, and their key."""
        row = self._listed()[day]
        return self._rows(row["version"], row["fields"]).drop(PART)

    def differing(self, previous: str, current: str) -> list[int] | None:
        """The parts in which two days differ in keys or in a field that is compared; None where the days have other
        numbers of parts. At most as many numbers as there are parts."""
        p, c = (self._listed()[d] for d in (previous, current))
        if p["parts"] != c["parts"]:
            return None
        fields = diff.comparable_fields(diff.canonical_header(c["fields"]), diff.canonical_header(p["fields"]), self.spec)
        asked = F.array(*[F.lit(f) for f in fields if f not in self.spec.ignored]).cast("array<string>")
        a, b = (self.spark.read.schema(_DIGESTS).parquet(f"{self.digests_path}/{r['version']}").alias(n) for r, n in ((p, "a"), (c, "b")))
        moved = F.exists(asked, lambda f: ~F.col("a.digests")[f].eqNullSafe(F.col("b.digests")[f]))
        same_keys = F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.keys").eqNullSafe(F.col("b.keys"))
        found = a.join(b, F.col("a.part") == F.col("b.part"), "full").where(~same_keys | moved)
        return sorted(r["part"] for r in found.select(F.coalesce("a.part", "b.part").alias("part")).collect())

    def pair(self, previous: str, current: str) -> tuple[DataFrame, DataFrame]:
        """Both days without the parts that are equal: they have the events of the whole days."""
        listed, parts = self._listed(), self.differing(previous, current)
        frames = [self._rows(listed[d]["version"], listed[d]["fields"]) for d in (previous, current)]
        if parts is not None:
            frames = [f.where(F.col(PART).isin(parts)) for f in frames]
        return frames[0].drop(PART), frames[1].drop(PART)

    def diff(self, previous: str, current: str) -> DataFrame:
        """``diff_pair`` of two stored days."""
        return diff.diff_pair(*self.pair(previous, current), self.spec)

"""Stored tables in versions: data is written beside what there is, and a version begins when its manifest is renamed into place.

A manifest lists the folders of data of each day. Readers take the newest one, so that a write that stops half way changes nothing, and two
writers of one version cannot both succeed. Rows are partitioned by day of ts_us; rows without a time have a day of their own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

DAY_US = 86_400_000_000


class VersionedTable:
    """A table under a folder, keyed by keys."""

    def __init__(self, spark: SparkSession, folder: str, keys: tuple[str, ...]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the newest version; 0 before the first."""
        found = self._fs().globStatus(self._path("manifest-*.json")) or []
        return max((int(s.getPath().getName()[9:-5]) for s in found), default=0)

    def manifest(self, version: int | None = None) -> dict[str, list[str]]:
        """Day to folders of its data, at a version; the newest by default."""
        version = self.version() if version is None else version
        if not version:
            return {}
        text = self.spark.read.option("wholetext", True).text(f"{self.folder}/manifest-{version:010d}.json").first()[0]
        return json.loads(text)

    def commit(self, version: int, days: dict[str, list[str]]) -> None:
        """Make days the version after version. An error if another writer was first."""
        fs, draft, final = self._fs(), self._path(f"draft-{uuid.uuid4().hex}"), self._path(f"manifest-{version + 1:010d}.json")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(days, sort_keys=True).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"version {version + 1} of {self.folder} was written by another")

    def read(self, days: list[str] | None = None, version: int | None = None) -> DataFrame | None:
        """The table, or some of its days; None if it has no data there."""
        known = self.manifest(version)
        folders = [f"{self.folder}/{f}" for day, own in known.items() if days is None or day in days for f in own]
        return self.spark.read.option("mergeSchema", True).parquet(*folders) if folders else None

    def _write(self, rows: DataFrame) -> dict[str, list[str]]:
        """Write rows with their day, and tell which folders each day got."""
        name = f"data-{uuid.uuid4().hex}"
        rows.withColumn("day", _day()).write.partitionBy("day").parquet(f"{self.folder}/{name}")
        found = self._fs().globStatus(self._path(f"{name}/day=*")) or []
        return {s.getPath().getName()[4:]: [f"{name}/{s.getPath().getName()}"] for s in found}

    def _days(self, rows: DataFrame) -> list[str]:
        return sorted(r[0] for r in rows.select(_day().alias("d")).distinct().collect())  # days are few

    def append_first_wins(self, new: DataFrame, order: str = "seq") -> None:
        """Rows whose key the table has not; the first of a key by order. Keys hold ts_us, so only the days of new are read."""
        version, known = self.version(), self.manifest()
        added = self._write(tables.first_wins(new, self.read(self._days(new), version), self.keys, order))
        self.commit(version, {d: known.get(d, []) + added.get(d, []) for d in {*known, *added}})

    def upsert_last_wins(self, new: DataFrame, order: str) -> None:
        """The newest row of each key, on whatever day it was: days that hold a key of new are written again."""
        version, known = self.version(), self.manifest()
        target = self.read(version=version)
        if target is None:
            self.commit(version, self._write(tables.latest(new, self.keys, order)))
            return
        asked = new.select(*self.keys).distinct()
        held = self._days(target.join(asked, tables.same(target, asked, self.keys), "left_semi").unionByName(new, allowMissingColumns=True))
        kept = {d: f for d, f in known.items() if d not in held}
        inside = self.read(held, version)
        made = self._write(new if inside is None else tables.last_wins(inside, new, self.keys, order))
        self.commit(version, kept | made)

    def _without(self, drop: Callable[[DataFrame], DataFrame], days: list[str], whole: list[str]) -> int:
        """A version without whole days and without the rows that drop() gives of days; how many rows went."""
        version, known = self.version(), self.manifest()
        gone, made = 0, {}
        out = self.read(whole, version)
        gone += 0 if out is None else out.count()
        inside = self.read(days, version)
        if inside is not None:
            left = drop(inside)
            made = self._write(left)
            back = [f"{self.folder}/{f}" for own in made.values() for f in own]
            gone += inside.count() - (self.spark.read.parquet(*back).count() if back else 0)
        kept = {d: f for d, f in known.items() if d not in whole and d not in days}
        if gone:
            self.commit(version, kept | made)
        return gone

    def prune(self, now_us: int, days: int) -> int:
        """Drop what is older than days (0: nothing); whole days go unread but for their counts, the day of the limit is written again."""
        if not days:
            return 0
        limit = now_us - days * DAY_US
        edge = limit // DAY_US
        numbers = [d for d in self.manifest() if d != "none"]
        return self._without(lambda t: t.where(F.col("ts_us") >= limit), [d for d in numbers if int(d) == edge], [d for d in numbers if int(d) < edge])

    def purge(self, source: str) -> int:
        """Drop the rows of one source. Days without any stay as they are."""
        t = self.read()
        held = [] if t is None else self._days(t.where(F.col("source").eqNullSafe(F.lit(source))))
        return self._without(lambda t: tables.purge(t, source), held, [])

    def sweep(self) -> None:
        """Delete data and manifests that the newest version does not need. Not while an older one is read."""
        version, fs = self.version(), self._fs()
        used = {f.split("/")[0] for own in self.manifest(version).values() for f in own}
        for s in fs.listStatus(self._path("")) if version else []:
            name = s.getPath().getName()
            if name not in used and name != f"manifest-{version:010d}.json":
                fs.delete(s.getPath(), True)


def _day():
    return F.coalesce(F.floor(F.col("ts_us") / DAY_US).cast("string"), F.lit("none"))

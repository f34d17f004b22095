"""Versions of keyed tables as changes, with a full copy every so often.

A version is stored as what differs from its parent: rows that are new or not the
same, whole, and the keys of rows that are gone. Every `every`-th version of a line
is a full copy as well (a keyframe), so any version is one keyframe and fewer than
`every` change sets after it, and what is read is in proportion to the changes.

    parts/<id>/change   what a version changed against its parent
    parts/<id>/full     a keyframe
    log/<n>             a version, its parent, and the folders that it is read from

Both kinds of folder have the key, the columns, and `_gone`. The log names the
folders of a version, so finding them takes no walk. A version is seen when its log
entry is there.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.cells import any_of, rows_same
from palimpsest.operators.align import align
from palimpsest.session import cut
from palimpsest.sources.log import Log

EVERY = 16
GONE, PLACE = "_gone", "_place"


class DeltaVersions(Log):
    """Versions of one table with a key, under `path`."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], cols: Sequence[str], every: int = EVERY):
        super().__init__(spark, path)
        self.key, self.cols, self.every = list(key), list(cols), every

    # --- reading ---------------------------------------------------------------

    def versions(self) -> dict[str, dict]:
        """Every version with its parent, its write, and the folders it is read from."""
        return {e["version"]: e for _, e in self.entries()}

    def _folders(self, version: str, versions: Mapping[str, dict]) -> list[str]:
        if version not in versions:
            raise ValueError(f"no version {version}")
        return versions[version]["folders"]

    def load(self, version: str) -> DataFrame:
        """The rows of one version; columns are the key and `cols`."""
        return self._state(self._folders(version, self.versions()))

    def _state(self, folders: Sequence[str]) -> DataFrame:
        """The last row of each key, unless that is a removal."""
        parts = [self.spark.read.parquet(f"{self.path}/{f}").withColumn(PLACE, F.lit(i)) for i, f in enumerate(folders)]
        if len(parts) == 1:
            return parts[0].select(*self.key, *self.cols)
        every = reduce(DataFrame.unionByName, parts)
        row = F.struct(F.col(PLACE), F.struct(GONE, *self.cols).alias("r"))
        last = every.groupBy(*self.key).agg(F.max_by(row, F.col(PLACE)).alias("last"))
        return last.where(~F.col(f"last.r.{GONE}")).select(*self.key, *[F.col(f"last.r.`{c}`").alias(c) for c in self.cols])

    def changes(self, version: str) -> DataFrame:
        """`(key…, cols…, _gone)`: what `version` changed against its parent, as it is stored."""
        entry = self.versions().get(version)
        if entry is None or entry["change"] is None:
            raise ValueError(f"no changes of a version {version}")
        return self.spark.read.parquet(f"{self.path}/{entry['change']}")

    # --- writing ---------------------------------------------------------------

    def write(self, version: str, df: DataFrame, parent: str | None = None) -> int:
        """Keep `df` as `version`, a change of `parent` if one is named; returns the stored rows of the change.

        Keys that are repeated or null are refused: a change of them cannot be told.
        """
        part = uuid.uuid4().hex
        new = cut(df.select(*self.key, *self.cols))
        bad = new.groupBy(*self.key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | any_of([F.col(f"`{k}`").isNull() for k in self.key]))
        if not bad.isEmpty():
            raise ValueError(f"key is repeated or null: {bad.head(1)[0].asDict()}")
        versions = self.versions()
        change = None
        if parent is not None:
            folders = self._folders(parent, versions)
            change = f"parts/{part}/change"
            self._difference(self._state(folders), new).write.parquet(f"{self.path}/{change}")
            folders = [*folders, change]
        if parent is None or len(folders) > self.every:
            folders = [f"parts/{part}/full"]
            new.withColumn(GONE, F.lit(False)).write.parquet(f"{self.path}/{folders[0]}")
        entry = {"version": version, "parent": parent, "change": change, "folders": folders}
        while True:
            entries = self.entries()
            if any(e["version"] == version for _, e in entries):
                raise ValueError(f"version {version} is there already")
            if self.claim(entries[-1][0] + 1 if entries else 1, entry):
                break
        return self.spark.read.parquet(f"{self.path}/{change or folders[0]}").count()

    def _difference(self, was: DataFrame, now: DataFrame) -> DataFrame:
        """Rows of `now` that `was` has not as they are, and the keys that only `was` has."""
        met = align({"was": was, "now": now}, self.key, self.cols)
        same = F.col("was").isNotNull() & F.col("now").isNotNull() & rows_same("was", "now", self.cols, was.schema)
        moved = met.where(~same)
        return moved.select(*self.key, *[F.col(f"now.`{c}`").alias(c) for c in self.cols], F.col("now").isNull().alias(GONE))

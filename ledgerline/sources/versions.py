"""Versions of a ledger: a change that rewrites labels (R2) is a new version, readers see one current version, and a
change can be undone.

``<path>/data/<name>`` holds a version's rows as parquet, written once.  ``<path>/current/<number>-<name>`` are empty
entries, numbered from 1; the highest one names the current version.  Publishing writes the rows first and then creates
the next entry, which either exists or does not: whoever reads before that sees the old version, and a job that is
lost in between leaves it current (its rows are written again by the next attempt).  Two writers that publish at once
compete for the same entry, and the second one fails instead of hiding the first one's change.  A roll-back is one more
entry, so the history stays.  Nothing is deleted or overwritten that an entry names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.sources import files


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def history(self) -> list[str]:
        """The names of the versions that were current, oldest first."""
        entries = (e.partition("-") for e in files.names(self.spark, f"{self.path}/current"))
        return [name for _, name in sorted((int(no), name) for no, _, name in entries)]

    def current(self) -> str | None:
        names = self.history()
        return names[-1] if names else None

    def read(self, name: str | None = None) -> DataFrame:
        """The current version, or the one of that name."""
        name = name or self.current()
        if name is None:
            raise ValueError("there is no version yet")
        return self.spark.read.parquet(f"{self.path}/data/{name}")

    def _switch(self, name: str, seen: int) -> None:
        files.create_new(self.spark, f"{self.path}/current/{seen + 1:09d}-{name}", f"{self.path}/current/{seen + 1:09d}-")

    def publish(self, rows: DataFrame, name: str) -> None:
        """Write ``rows`` as version ``name`` and make it current.  ``rows`` may read the current version."""
        names = self.history()
        if name in names:
            raise ValueError(f"version {name} exists")
        rows.write.mode("overwrite").parquet(f"{self.path}/data/{name}")      # rows that no entry names, if any
        self._switch(name, len(names))

    def roll_back(self, name: str | None = None) -> str:
        """Make an earlier version current again: the one of that name, or the one that was current before."""
        names = self.history()
        earlier = [n for n in names[:-1] if n != names[-1]]
        if not earlier or name is not None and name not in names:
            raise ValueError("there is no such version to go back to")
        name = name or earlier[-1]
        self._switch(name, len(names))
        return name

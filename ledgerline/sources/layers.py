"""A table kept as layers: one folder for each batch, merged into fewer folders from time to time.

``<path>/rows/layer=b-<tag>`` holds a batch.  A batch that is written again replaces its folder, so a retried job doubles
nothing; a folder counts only when its write was finished.  ``compact`` merges the layers of a level, once there are
``fan_in`` of them, into one layer of the next level, so a row is rewritten about log(batches) times.  A merged layer
counts from the moment its entry in ``<path>/merged`` exists, and with it the layers it replaces stop counting: a reader
sees the rows once at any time, and a merge that is lost half-way changes nothing.  Two merges at once compete for the same
entry, and the second one fails.  ``vacuum`` deletes folders that don't count any more, when no reader uses them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.sources import files

FAN_IN = 8


class Layers:
    """Rows of ``schema`` in folders by ``parts`` (columns of the schema) inside each layer."""

    def __init__(self, spark: SparkSession, path: str, schema: str, parts: tuple[str, ...] = ()):
        self.spark, self.path, self.schema, self.parts = spark, path.rstrip("/"), schema, parts

    def _folder(self, layer: str) -> str:
        return f"{self.path}/rows/layer={layer}"

    def _merges(self) -> list[tuple[str, list[str]]]:
        """(merged layer, the layers it replaced) of each finished merge, oldest first."""
        entries = sorted(files.names(self.spark, f"{self.path}/merged"))
        return [(e.partition("-")[2], files.names(self.spark, f"{self.path}/replaced/{e.partition('-')[2]}")) for e in entries]

    def live(self) -> list[str]:
        """The layers that count."""
        merges = self._merges()
        replaced, merged = {x for _, old in merges for x in old}, {m for m, _ in merges}
        found = [n.removeprefix("layer=") for n in files.names(self.spark, f"{self.path}/rows")]
        return sorted(x for x in found if x not in replaced and (x.startswith("b-") or x in merged)
                      and files.exists(self.spark, f"{self._folder(x)}/_SUCCESS"))

    def read(self, without: str | None = None, layers: list[str] | None = None) -> DataFrame:
        """The rows of the layers that count, without those of one batch that is not merged yet."""
        layers = [x for x in (self.live() if layers is None else layers) if x != f"b-{without}"]
        if not layers:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(f"{self.schema}, layer string").option("basePath", f"{self.path}/rows")
        return reader.parquet(*[self._folder(x) for x in layers]).drop("layer")

    def batch(self, tag: str) -> DataFrame:
        """The rows of a batch as they were appended, while it is not merged."""
        return self.read(layers=[f"b-{tag}"])

    def _write(self, rows: DataFrame, layer: str) -> None:
        if self.parts:          # files by size: a part may be one small file or, if it is large, several
            rows = rows.hint("rebalance", *self.parts)
        rows.write.mode("overwrite").partitionBy(*self.parts).parquet(self._folder(layer))

    def append(self, rows: DataFrame, tag: str) -> None:
        """Write batch ``tag``; if it was written before, its rows are replaced.  A batch that was merged can't be."""
        if "/" in tag or "=" in tag:
            raise ValueError(f"a batch can't be named {tag}")
        if any(f"b-{tag}" in old for _, old in self._merges()):
            raise ValueError(f"batch {tag} was merged with others and can't be written again")
        self._write(rows, f"b-{tag}")

    def compact(self, fan_in: int = FAN_IN, combine: Callable[[DataFrame], DataFrame] | None = None, keep: tuple[str, ...] = ()) -> str | None:
        """Merge the lowest level that has ``fan_in`` layers, leaving out the batches ``keep`` (which may be replayed).
        ``combine`` may add up rows of the same key.  Returns the new layer, or None if there is nothing to merge."""
        level = lambda x: 0 if x.startswith("b-") else int(x.split("-")[1])
        layers = [x for x in self.live() if x not in {f"b-{t}" for t in keep}]
        full = [n for n in sorted({level(x) for x in layers}) if sum(level(x) == n for x in layers) >= fan_in]
        if not full:
            return None
        old, no = [x for x in layers if level(x) == full[0]], len(files.names(self.spark, f"{self.path}/merged")) + 1
        new = f"m-{full[0] + 1}-{uuid.uuid4().hex}"
        rows = self.read(layers=old)
        self._write(combine(rows) if combine else rows, new)
        for x in old:
            files.touch(self.spark, f"{self.path}/replaced/{new}/{x}")
        files.create_new(self.spark, f"{self.path}/merged/{no:09d}-{new}", f"{self.path}/merged/{no:09d}-")
        return new

    def vacuum(self) -> list[str]:
        """Delete the folders of layers that were replaced; returns them."""
        gone = [x for _, old in self._merges() for x in old if files.exists(self.spark, self._folder(x))]
        for x in gone:
            files.delete(self.spark, self._folder(x))
        return gone

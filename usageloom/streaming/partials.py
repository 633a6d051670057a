"""Stored partial results of a stream: a folder for each batch, merged from time to time behind a manifest that is switched whole.

A batch that runs again replaces its own folder. Every MERGE_EVERY batches all that is stored is summed up into one base,
written beside the folders; then a manifest that names it is written under the next number. Readers take the last manifest, its
base, and the folders of later batches, so they see either state whole. What a manifest has replaced goes with the next one, so
a reader that began before the switch can end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from usageloom.sources.lines import opened

MERGE_EVERY = 20


class Partials:
    """merge makes of stored rows fewer, with the same columns and the same meaning; it is applied to its own results, too."""

    def __init__(self, path: str, schema: str, merge: Callable[[DataFrame], DataFrame], every: int = MERGE_EVERY):
        self.address, self.schema, self.merge, self.every = path.rstrip("/"), schema, merge, every
        self.fs, self.path = opened(self.address)

    def _numbers(self, kind: str) -> list[int]:
        from pyarrow import fs as pafs

        infos = self.fs.get_file_info(pafs.FileSelector(self.path, allow_not_found=True))
        return sorted(int(i.base_name.split("=")[1]) for i in infos if i.base_name.startswith(f"{kind}=") and not i.base_name.endswith(".part"))

    def _whole(self, kind: str, number: int) -> bool:
        return self.fs.get_file_info(f"{self.path}/{kind}={number}/_SUCCESS").is_file

    def merged_upto(self) -> int:
        """The last batch that the last manifest's base holds; -1 for none."""
        return max(self._numbers("manifest"), default=-1)

    def next_number(self) -> int:
        """After all that is stored, whole or not."""
        return max([self.merged_upto(), *self._numbers("batch")]) + 1

    def put(self, batch: DataFrame, number: int) -> None:
        # A batch that is in the base already was committed before, and isn't stored again.
        if number > (upto := self.merged_upto()):
            batch.write.mode("overwrite").parquet(f"{self.address}/batch={number}")
            if number - upto >= self.every:
                self.compact(batch.sparkSession, number)

    def read(self, spark: SparkSession) -> DataFrame:
        upto = self.merged_upto()
        paths = [f"{self.address}/base={upto}"] if upto >= 0 else []
        paths += [f"{self.address}/batch={n}" for n in self._numbers("batch") if n > upto and self._whole("batch", n)]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def compact(self, spark: SparkSession, upto: int) -> None:
        """Merge all batches up to the number."""
        before = self.merged_upto()
        self.merge(self.read(spark)).write.mode("overwrite").parquet(f"{self.address}/base={upto}")
        with self.fs.open_output_stream(f"{self.path}/manifest={upto}.part") as f:
            f.write(str(upto).encode())
        self.fs.move(f"{self.path}/manifest={upto}.part", f"{self.path}/manifest={upto}")
        # Readers may still be at the state before, so only what that one had replaced goes.
        for kind, last in (("batch", before), ("base", before - 1), ("manifest", before - 1)):
            for n in (n for n in self._numbers(kind) if n <= last):
                name = f"{self.path}/{kind}={n}"
                self.fs.delete_file(name) if kind == "manifest" else self.fs.delete_dir(name)



"""What a tail knows of its files, kept as a table with versions, so that a stream's offset is one number however many files there are.

A version is a Parquet file with the rows that changed: where the stretch begins that the version admits (`first`), up to where
the lines that begin are read then (`done`), and the file's state as it was seen. Every WHOLE_EVERY versions the whole map is
written beside them, and what lies before it can go once the stream has committed it. So the stretches between two versions
can be told again, as a batch that is repeated needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, fields

import pyarrow as pa
import pyarrow.parquet as pq

from usageloom.sources.lines import Stretch, opened

WHOLE_EVERY = 50


@dataclass
class Known:
    """A file: read up to `done` of `line_end`; life tells how often it was begun anew; head is a digest of its first head_size bytes."""

    path: str
    first: int
    done: int
    line_end: int
    size: int
    mtime: int
    life: int
    anew: bool
    head_size: int
    head: bytes
    version: int


SCHEMA = pa.schema([("path", pa.string()), *((f, pa.int64()) for f in ("first", "done", "line_end", "size", "mtime", "life")), ("anew", pa.bool_()), ("head_size", pa.int64()), ("head", pa.binary()), ("version", pa.int64())])


class FileMap:
    def __init__(self, folder: str):
        self.fs, self.path = opened(folder)

    def _versions(self, kind: str) -> list[int]:
        from pyarrow import fs as pafs

        names = (i.base_name for i in self.fs.get_file_info(pafs.FileSelector(self.path, allow_not_found=True)))
        return sorted(int(n[len(kind) + 1 : -8]) for n in names if n.startswith(f"{kind}-") and n.endswith(".parquet"))

    def _rows(self, kind: str, version: int) -> Iterator[Known]:
        with self.fs.open_input_file(f"{self.path}/{kind}-{version}.parquet") as f:
            for batch in pq.ParquetFile(f).iter_batches():
                yield from (Known(**r) for r in batch.to_pylist())

    def _write(self, kind: str, version: int, rows: list[Known]) -> None:
        """Under another name first: a file with the right name is whole."""
        columns = list(zip(*map(astuple, rows), strict=True)) or [[] for _ in SCHEMA]
        table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)
        self.fs.create_dir(self.path, recursive=True)
        name = f"{self.path}/{kind}-{version}.parquet"
        with self.fs.open_output_stream(f"{name}.part") as f:
            pq.write_table(table, f)
        self.fs.move(f"{name}.part", name)

    def load(self) -> tuple[int, dict[str, Known]]:
        """(the last version, the files as of it)."""
        wholes = self._versions("whole")
        version = wholes[-1] if wholes else 0
        known = {r.path: r for r in self._rows("whole", version)} if version else {}
        for v in (v for v in self._versions("change") if v > version):
            known.update((r.path, r) for r in self._rows("change", v))
            version = v
        return version, known

    def add(self, version: int, changed: list[Known], known: dict[str, Known]) -> None:
        """The version's changes; known holds them already."""
        self._write("change", version, changed)
        if version % WHOLE_EVERY == 0:
            self._write("whole", version, list(known.values()))

    def stretches(self, after: int, upto: int) -> Iterator[Stretch]:
        """What the versions after the one, up to the other, admitted. A file that began anew is told of, even without a line."""
        there, wholes = self._versions("change"), [v for v in self._versions("whole") if v <= upto]
        if after == 0 and wholes and there and there[0] > 1:
            # A new query over an old map: the oldest whole map stands for the changes that are gone.
            for r in self._rows("whole", wholes[0]):
                yield Stretch(r.path, 0, r.done, r.life)
            after = wholes[0]
        gone = set(range(after + 1, upto + 1)) - set(there)
        if gone:
            raise ValueError(f"the file map {self.path} lacks the versions {sorted(gone)[:5]}")
        for v in range(after + 1, upto + 1):
            for r in self._rows("change", v):
                if r.anew and r.first == 0:
                    yield Stretch(r.path, 0, 0, r.life)
                if r.done > r.first:
                    yield Stretch(r.path, r.first, r.done, r.life)

    def forget(self, upto: int) -> None:
        """Delete what no batch after the version needs: changes and whole maps before the last whole one that isn't later."""
        wholes = [v for v in self._versions("whole") if v <= upto]
        if wholes:
            for kind in ("change", "whole"):
                for v in self._versions(kind):
                    if v < wholes[-1] or (kind == "change" and v == wholes[-1]):
                        self.fs.delete_file(f"{self.path}/{kind}-{v}.parquet")


assert [f.name for f in fields(Known)] == SCHEMA.names

"""Tables that every task goes through in blocks: written once to the shared folder, read by the workers block by block,
so that neither the driver nor a worker holds them whole.

Defined results: an empty table gives no block; files stay in the shared folder, which the cluster clears.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark.sql import DataFrame

from ..session import shared

#: Bytes up to which a worker keeps the blocks instead of reading them again.
KEEP = 64_000_000


class Blocks:
    """A written table. It is sent to the workers as the name of its folder."""

    def __init__(self, df: DataFrame, size: int) -> None:
        self.path, self.size = f"{shared(df.sparkSession).rstrip('/')}/blocks-{uuid.uuid4().hex}", size
        df.write.parquet(self.path)
        self.kept: list[pa.RecordBatch] | None = None

    def files(self) -> tuple[pf.FileSystem, list[pf.FileInfo]]:
        fs, path = pf.FileSystem.from_uri(self.path) if ":" in self.path.split("/")[0] else (pf.LocalFileSystem(), self.path)
        found = fs.get_file_info(pf.FileSelector(path))
        return fs, sorted((f for f in found if f.size and os.path.basename(f.path).startswith("part-")), key=lambda f: f.path)

    def rows(self) -> int:
        fs, files = self.files()
        return sum(pq.ParquetFile(f.path, filesystem=fs).metadata.num_rows for f in files)

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        if self.kept is not None:
            yield from self.kept
            return
        fs, files = self.files()
        keep = [] if sum(f.size for f in files) <= KEEP else None
        for f in files:
            for batch in pq.ParquetFile(f.path, filesystem=fs).iter_batches(self.size):
                if batch.num_rows:
                    if keep is not None:
                        keep.append(batch)
                    yield batch
        self.kept = keep

    def __getstate__(self) -> dict:
        return {"path": self.path, "size": self.size, "kept": None}

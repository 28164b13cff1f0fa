"""A sink that shows a batch whole or not at all, written in chunks of a bounded number of rows.

Tasks write Parquet chunks into a folder that readers pass over; when all have reported, the driver renames that folder
once, which makes the whole batch visible. A write that fails, or whose driver dies, shows nothing, and what it left
behind stands in a folder of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

ROWS = 50_000


@dataclass
class Written(WriterCommitMessage):
    files: list
    rows: int


class ChunkWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.rows = options["path"].rstrip("/"), int(options.get("rows", ROWS))
        self.batch = options.get("batch") or uuid.uuid4().hex

    def _files(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path)

    @property
    def staged(self) -> str:
        return f"_staged-{self.batch}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """Chunks of `rows` rows; the last of a task is shorter. An attempt has files of its own names."""
        files, root = self._files()
        context = TaskContext.get()
        files.create_dir(f"{root}/{self.staged}")
        held, size, names, total = [], 0, [], 0

        def flush(table: pa.Table) -> None:
            name = f"{context.partitionId():05d}-{context.taskAttemptId()}-{len(names):05d}.parquet"
            pq.write_table(table, f"{root}/{self.staged}/{name}", filesystem=files)
            names.append(name)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            total += batch.num_rows
            while size >= self.rows:
                table = pa.Table.from_batches(held)
                flush(table.slice(0, self.rows))
                held, size = table.slice(self.rows).to_batches(), size - self.rows
        if size:
            flush(pa.Table.from_batches(held))
        return Written(names, total)

    def commit(self, messages: list) -> None:
        """Chunks of attempts that didn't report go; one rename shows the rest."""
        files, root = self._files()
        kept = {name for m in messages if m is not None for name in m.files}
        if not kept:
            return self.abort(messages)
        for info in files.get_file_info(pafs.FileSelector(f"{root}/{self.staged}")):
            if info.base_name not in kept:
                files.delete_file(info.path)
        files.move(f"{root}/{self.staged}", f"{root}/batch={self.batch}")

    def abort(self, messages: list) -> None:
        files, root = self._files()
        if files.get_file_info(f"{root}/{self.staged}").type != pafs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.staged}")


class ChunkSink(DataSource):
    """`df.write.format("tidemark_chunks")` with path and, if wanted, rows and the batch's name."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_chunks"

    def writer(self, schema, overwrite: bool) -> ChunkWriter:
        if overwrite:
            raise ValueError("batches are only appended")
        return ChunkWriter(self.options)


def append_chunks(df: DataFrame, path: str, rows: int = ROWS, batch: str | None = None) -> str:
    """Append a batch, shown whole or not at all; its name. A path without a scheme is one of this machine."""
    batch = batch or uuid.uuid4().hex
    df.sparkSession.dataSource.register(ChunkSink)
    df.write.format(ChunkSink.name()).mode("append").options(path=path, rows=rows, batch=batch).save()
    return batch


def read_chunks(spark: SparkSession, path: str, schema) -> DataFrame:
    """All batches that are shown, with the batch's name as a column."""
    return spark.read.schema(schema).parquet(path)

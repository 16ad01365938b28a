"""Batches that become visible whole: Parquet folders by batch, and a marker for each that is committed.

A batch writes its tables to folders named by its number, replacing what an attempt that died
left there, and then one marker, by a rename. Readers take the folders of marked batches
alone, so the outputs of a batch are seen together or not at all, whatever died between.
The folder may be in any file system that Spark knows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Ledger:
    """The committed batches below a folder, in order of their numbers."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._markers = f"{self.root}/_commits"

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        files, folder = self._files(), self._path(self._markers)
        if not files.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in files.listStatus(folder) if s.getPath().getName().isdigit())

    def is_committed(self, batch_id: int) -> bool:
        return self._files().exists(self._path(f"{self._markers}/{batch_id}"))

    def note(self, batch_id: int) -> dict:
        """What the batch's marker says."""
        stream = self._files().open(self._path(f"{self._markers}/{batch_id}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, name: str, rows: DataFrame, batch_id: int) -> None:
        if self.is_committed(batch_id):
            raise ValueError(f"batch {batch_id} is committed")
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch_id={batch_id}")

    def commit(self, batch_id: int, note: dict | None = None) -> None:
        """Mark the batch; one that is marked stays as it is."""
        files, temporary, marker = self._files(), self._path(f"{self._markers}/.{uuid.uuid4().hex}"), self._path(f"{self._markers}/{batch_id}")
        stream = files.create(temporary)
        stream.write(bytearray(json.dumps(note or {}).encode()))
        stream.close()
        if not files.rename(temporary, marker):
            files.delete(temporary, False)
            if not self.is_committed(batch_id):
                raise OSError(f"batch {batch_id} can't be marked")

    def read(self, name: str, schema: T.StructType, after: int = -1, upto: int | None = None) -> DataFrame:
        """The rows of the committed batches with numbers in (after, upto]; with none, no rows."""
        paths = [f"{self.root}/{name}/batch_id={n}" for n in self.committed() if n > after and (upto is None or n <= upto)]
        paths = [p for p in paths if self._files().exists(self._path(p))]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

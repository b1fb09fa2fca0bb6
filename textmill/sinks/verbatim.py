"""A sink that writes strings as they are, nothing between them.

Part files in name order hold exactly the bytes of the strings in row order, so
separators are the caller's and none is left over at the end.  Every task
writes an attempt of its own; the commit messages name the files and sizes, and
the driver puts them into ``_manifest.json`` with the offset of each part in the
whole text.  A part is only valid if the manifest lists it: files of failed or
repeated attempts are deleted when the job commits.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MANIFEST = "_manifest.json"


def file_system(path: str):
    """``(file system, path in it)``: any that Arrow knows by the path's scheme, local without one."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str
    rows: int
    size: int


class VerbatimWriter(DataSourceArrowWriter):
    def __init__(self, path: str, job: str):
        self.path, self.job = path.rstrip("/"), job

    def write(self, iterator):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        name = f"part-{number:05d}-{self.job}-{uuid.uuid4().hex[:8]}.txt"
        fs, path = file_system(self.path)
        fs.create_dir(path, recursive=True)
        rows = size = 0
        with fs.open_output_stream(f"{path}/{name}") as out:
            for batch in iterator:
                for text in batch.column(0).to_pylist():
                    raw = (text or "").encode()
                    out.write(raw)
                    rows, size = rows + 1, size + len(raw)
        return Part(number, name, rows, size)

    def commit(self, messages):
        fs, path = file_system(self.path)
        fs.create_dir(path, recursive=True)
        parts, offset = [], 0
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.number):
            parts.append({"file": m.name, "rows": m.rows, "offset": offset, "bytes": m.size})
            offset += m.size
        with fs.open_output_stream(f"{path}/{MANIFEST}") as out:
            out.write(json.dumps({"bytes": offset, "parts": parts}).encode())
        self._keep({p["file"] for p in parts})

    def abort(self, messages):
        self._keep(None)

    def _keep(self, names):
        """Deletes other part files (``None``: those of this job)."""
        from pyarrow import fs as F_

        fs, path = file_system(self.path)
        for info in fs.get_file_info(F_.FileSelector(path, allow_not_found=True)):
            mine = info.base_name.startswith("part-") and (names is not None or f"-{self.job}-" in info.base_name)
            if mine and info.base_name not in (names or ()):
                fs.delete_file(info.path)


class VerbatimText(DataSource):
    @classmethod
    def name(cls):
        return "textmill_verbatim"

    def writer(self, schema, overwrite):
        return VerbatimWriter(self.options["path"], uuid.uuid4().hex[:8])


def write_verbatim(texts: DataFrame, path: str, order, column: str = "text", parts: int | None = None) -> None:
    """The strings of ``column`` along ``order``, written as they are.  The
    width is the session's shuffle width, sized by AQE, unless given."""
    spark = texts.sparkSession
    spark.dataSource.register(VerbatimText)
    ordered = texts.repartitionByRange(parts, *order) if parts else texts.repartitionByRange(*order)
    ordered.sortWithinPartitions(*order).select(F.col(column).cast("string").alias("text")) \
        .write.format(VerbatimText.name()).mode("append").option("path", path).save()


def read_manifest(path: str) -> dict:
    fs, p = file_system(path.rstrip("/"))
    with fs.open_input_stream(f"{p}/{MANIFEST}") as f:
        return json.loads(f.read())


def joined(df: DataFrame, order, column: str, sep: str, out: str = "text") -> DataFrame:
    """``column`` with ``sep`` in front of all strings but the first along ``order``."""
    from textmill.operators.ordering import BK, dense_index, range_buckets

    d = dense_index(range_buckets(df, list(order)), [], list(order), BK, out="_at").drop(BK)
    return d.withColumn(out, F.when(F.col("_at") == 0, F.col(column)).otherwise(F.concat(F.lit(sep), F.col(column)))).drop("_at")

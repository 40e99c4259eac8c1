"""A sink for log records: ``df.write.format("redacted_log")``, and the same for
a stream's ``writeStream``.

    register(spark)
    df.write.format("redacted_log").mode("append").save("s3://bucket/logs")

Each row is a line of JSON, a field for each column; what lies at the paths of
``logs.REDACTED`` is replaced before anything is written, so no file ever holds
it.  The option ``base`` is a JSON object whose fields precede each record's own
(``{"service": "api"}``).

A task writes one file to ``_tasks`` and tells its name; the commit moves the
files of the tasks that Spark accepted into place.  Attempts that failed, were
retried or ran twice are never moved.  A streaming batch that runs again after a
cut-off commit first takes away what that commit had moved, by the list that it
left in ``_commits``.  Streams that share a folder, or one that starts anew with
another checkpoint, need names of their own in the option ``stream``.

Cases: null values are written as null; times, binary values and decimals as
text; partitions without rows write no file; an empty frame leaves an empty
folder.  Paths are those that ``pyarrow.fs`` opens.
"""

from __future__ import annotations

import base64
import json
import uuid
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from .logs import masked


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    local = path.startswith("file:")
    return arrow_fs.FileSystem.from_uri(unquote(urlparse(path).path) if local else path)


def _text(value) -> str:
    return base64.b64encode(value).decode() if isinstance(value, bytes) else str(value)


@dataclass
class Landed(WriterCommitMessage):
    partition: int
    file: str | None


class Files:
    """What the batch and the streaming writer share."""

    def __init__(self, options: dict):
        self.path, self.base, self.run = options["path"], json.loads(options.get("base", "{}")), uuid.uuid4().hex

    def write(self, batches) -> Landed:
        fs, root = opened(self.path)
        task = TaskContext.get()
        place, out = f"{root}/_tasks/{self.run}/{task.partitionId()}-{uuid.uuid4().hex}.jsonl", None
        try:
            for batch in batches:
                if out is None and len(batch):
                    fs.create_dir(f"{root}/_tasks/{self.run}", recursive=True)
                    out = fs.open_output_stream(place)
                for row in batch.to_pylist():
                    out.write((json.dumps(masked({**self.base, **row}), ensure_ascii=False, default=_text) + "\n").encode())
        finally:
            if out is not None:
                out.close()
        return Landed(task.partitionId(), place if out is not None else None)

    def move(self, messages: list, name: str, replacing: bool = False) -> None:
        fs, root = opened(self.path)
        fs.create_dir(f"{root}/_commits", recursive=True)
        done = f"{root}/_commits/{name}"
        moved = {m.file: f"{root}/part-{name}-{m.partition:06d}.jsonl" for m in messages if m is not None and m.file}
        old = set()
        if replacing:
            old = {i.path for i in fs.get_file_info(arrow_fs.FileSelector(root)) if i.base_name.startswith("part-")}
        elif fs.get_file_info(done).type == arrow_fs.FileType.File:  # this batch was cut off while it committed
            with fs.open_input_stream(done) as f:
                old = set(json.loads(f.read()))
        # the list comes first, and names what an earlier attempt may have left as well
        with fs.open_output_stream(done) as f:
            f.write(json.dumps(sorted({*moved.values(), *(() if replacing else old)})).encode())
        for a, b in moved.items():
            fs.move(a, b)
        for path in old - {*moved.values()}:
            if fs.get_file_info(path).type == arrow_fs.FileType.File:
                fs.delete_file(path)
        self.swept(fs, root)

    def swept(self, fs, root: str) -> None:
        left = f"{root}/_tasks/{self.run}"
        if fs.get_file_info(left).type == arrow_fs.FileType.Directory:
            fs.delete_dir(left)


class BatchWriter(Files, DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options)
        self.overwrite = overwrite

    def commit(self, messages):
        self.move(messages, self.run, self.overwrite)

    def abort(self, messages):
        self.swept(*opened(self.path))


class StreamWriter(Files, DataSourceStreamArrowWriter):
    def __init__(self, options: dict):
        super().__init__(options)
        self.stream = options.get("stream", "batch")
        if not self.stream.replace("_", "").isalnum():
            raise ValueError(f"not a stream's name: {self.stream}")

    def commit(self, messages, batchId):
        self.move(messages, f"{self.stream}-{batchId:012d}")

    def abort(self, messages, batchId):
        self.swept(*opened(self.path))


class LogSink(DataSource):
    @classmethod
    def name(cls):
        return "redacted_log"

    def writer(self, schema, overwrite):
        return BatchWriter(self.options, overwrite)

    def streamWriter(self, schema, overwrite):
        return StreamWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSink)

"""Item files as a Spark data source, ``items``, in batch and as a stream.

Many small files make few partitions: a partition is a run of files of about ``partitionBytes`` together, planned from the listing. A partition's reader
reads the first 4,000 bytes of each file; if ``wanted`` (a pattern) isn't there the rest is never read. Only the columns that are asked for by ``columns`` are
parsed: without content columns no file is opened at all.

As a stream, a batch is what came since the last one: the offset is the newest (modification time, path) seen, so a changed file comes again with a later
time. Parsed rows go into :class:`lectern.streaming.jobs.UpsertedTable`, keyed by path.

Files are listed and opened through pyarrow's file systems (local paths, s3, gs, hdfs), so a path that only Hadoop can open needs
``lectern.sources.items.parse`` instead, which reads through Spark.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

HEAD = 4_000
#: Columns that a listing gives.
LISTED = {"path": "string", "length": "long", "modified": "long"}
#: Columns that parsing gives.
PARSED = {
    "id": "string", "answer_raw": "string", "question": "string", "explanation": "string", "n_choices": "int", "images": "array<string>",
    "attributes": "map<string,string>", "parse_errors": "array<string>",
}
COLUMNS = LISTED | {"bytes_read": "long"} | PARSED


class Files(InputPartition):
    """A run of (path, length, modified)."""

    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


def listed(path: str, glob: str) -> list[tuple[str, int, int]]:
    """All files below ``path`` whose name matches, in any case, by path."""
    system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size, int((f.mtime_ns or 0) // 1000)) for f in found if f.type == fs.FileType.File and fnmatch(f.base_name.lower(), glob.lower()))


def packed(files: list[tuple[str, int, int]], size: int) -> list[Files]:
    """Runs of files of about ``size`` bytes; each file counts with at least 4 kB, for opening it."""
    out, now, total = [], [], 0
    for f in files:
        now.append(f)
        total += max(f[1], HEAD)
        if total >= size:
            out.append(Files(now))
            now, total = [], 0
    return [*out, Files(now)] if now else out


def fields_of(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class _Reading:
    def __init__(self, schema, options):
        self.schema, self.path = schema, options["path"]
        self.glob, self.wanted = options.get("glob", "*.iml"), options.get("wanted")
        self.size = int(options.get("partitionBytes", 8 << 20))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        """Rows in batches of at most 512 files."""
        from lectern.sources.items import parse_item

        names = [f.name for f in self.schema.fields]
        opened = any(n not in LISTED for n in names) or self.wanted is not None
        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        text = lambda blocks: "".join(b["content"] for b in blocks if b["type"] == "text")
        rows: list[dict] = []
        for path, length, modified in partition.files:
            row = {"path": path, "length": length, "modified": modified, "bytes_read": 0}
            if opened:
                with system.open_input_stream(path) as f:
                    raw = f.read(HEAD)
                    if self.wanted is not None and not re.search(self.wanted, raw.decode("latin-1")):
                        continue
                    if any(n in PARSED for n in names):
                        raw += f.read()
                row["bytes_read"] = len(raw)
                if any(n in PARSED for n in names):
                    item = parse_item(path, raw)
                    row |= {**item, "question": text(item["question"]), "explanation": text(item["explanation"]), "n_choices": len(item["choices"]), "attributes": list(item["attributes"].items())}
            rows.append({n: row.get(n) for n in names})
            if len(rows) == 512:
                yield pa.RecordBatch.from_pylist(rows, fields_of(self.schema))
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, fields_of(self.schema))


class BatchReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        return packed(listed(self.path, self.glob), self.size) or [Files([])]


class StreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        newest = max(((m, p) for p, _, m in listed(self.path, self.glob)), default=(-1, ""))
        return {"modified": newest[0], "path": newest[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = ((x["modified"], x["path"]) for x in (start, end))
        return packed([f for f in listed(self.path, self.glob) if low < (f[2], f[0]) <= high], self.size)

    def commit(self, end: dict) -> None:
        """Nothing to do: files stay where they are."""


class ItemSource(DataSource):
    """Options: path, glob (``*.iml``, in any case), wanted, partitionBytes, columns (a JSON list of column names)."""

    @classmethod
    def name(cls) -> str:
        return "items"

    def schema(self) -> str:
        asked = json.loads(self.options.get("columns", "null")) or list(COLUMNS)
        return ", ".join(f"{c} {COLUMNS[c]}" for c in asked)

    def reader(self, schema) -> BatchReader:
        return BatchReader(schema, self.options)

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(schema, self.options)


def register(spark) -> None:
    """Make ``spark.read.format("items")`` and ``spark.readStream.format("items")`` known to the session."""
    from lectern.session import ship

    ship(spark)
    spark.dataSource.register(ItemSource)

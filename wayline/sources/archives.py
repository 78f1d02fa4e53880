"""CSV members of zip archives, or plain CSV files, as a partitioned data source: one partition a part, streamed in Arrow batches.

An archive is opened where it is read, by its directory, and only the wanted member is decompressed, block
by block: no task holds a part whole. Columns are text under their raw headers, the union of all parts'
by name; what a part lacks is NULL there. ``path`` options that Python's file systems can't open are read
through Spark's own reader of whole files instead, with the same batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.csv
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of text that are parsed together.
BLOCK_BYTES = 4 << 20
NAME = "wayline_members"


def open_file(path: str):
    """A seekable file of a path or URI."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    system, at = pyarrow.fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def opens(path: str) -> bool:
    """Whether Python's file systems know a path's kind."""
    try:
        with open_file(path):
            return True
    except (pa.ArrowInvalid, OSError, ValueError):
        return False


def _member(file, path: str, member: str):
    """The stream of a CSV file, or of the first member of an archive with exactly this base name."""
    import zipfile

    if not path.lower().endswith(".zip"):
        return file
    archive = zipfile.ZipFile(file)
    found = next((n for n in archive.namelist() if n.rsplit("/", 1)[-1] == member), None)
    if found is None:
        raise ValueError(f"{path} holds no {member}")
    return archive.open(found)


def headers_of(file, path: str, member: str) -> list[str]:
    """A part's headers; none of an empty member."""
    import csv
    import io

    with io.TextIOWrapper(_member(file, path, member), encoding="utf-8-sig", newline="") as lines:
        return next(csv.reader(lines), [])


def batches(file, path: str, member: str, headers: list[str], nrows: int | None) -> Iterator[pa.RecordBatch]:
    """The rows of a part, at most ``nrows``: ``headers`` as text, _path and _line."""
    own = pyarrow.csv.ConvertOptions(column_types={h: pa.string() for h in headers}, include_columns=headers, include_missing_columns=True, strings_can_be_null=False)
    try:
        reader = pyarrow.csv.open_csv(_member(file, path, member), pyarrow.csv.ReadOptions(block_size=BLOCK_BYTES), pyarrow.csv.ParseOptions(newlines_in_values=True), own)
    except pa.ArrowInvalid as error:
        if "Empty CSV file" in str(error):
            return
        raise
    done = 0
    for batch in reader:
        if nrows is not None:
            batch = batch.slice(0, nrows - done)
        n = batch.num_rows
        texts = [c.cast(pa.string()) for c in batch.columns]
        yield pa.RecordBatch.from_arrays([*texts, pa.array([path] * n, type=pa.string()), pa.array(range(done, done + n), type=pa.int64())], names=[*headers, "_path", "_line"])
        done += n
        if done == nrows:
            return


class Members(DataSource):
    """Options: parts (JSON list of paths), member, headers (JSON list) and nrows (empty: all)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        from pyspark.sql.types import LongType, StringType, StructField, StructType

        return StructType([*(StructField(h, StringType()) for h in json.loads(self.options["headers"])), StructField("_path", StringType()), StructField("_line", LongType())])

    def reader(self, schema) -> "MembersReader":
        return MembersReader(dict(self.options))


class MembersReader(DataSourceReader):
    def __init__(self, options: dict):
        self.parts, self.member, self.headers = json.loads(options["parts"]), options["member"], json.loads(options["headers"])
        self.nrows = int(options["nrows"]) if options.get("nrows") else None

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(len(self.parts))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path = self.parts[partition.value]
        with open_file(path) as file:
            yield from batches(file, path, self.member, self.headers, self.nrows)


def _whole(run):
    """mapInArrow function over (path, content) of whole files."""

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        for batch in rows:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from run(io.BytesIO(content.as_py()), path)

    return each


def read_parts(spark: SparkSession, parts: list[str], member: str, nrows: int | None = None) -> tuple[DataFrame, list[str]]:
    """The rows of all parts under the union of their headers, with _path and _line, and the headers in the order of their first part."""
    if all(opens(p) for p in parts[:1]):

        def head(path: str) -> list[str]:
            with open_file(path) as file:
                return headers_of(file, path, member)

        with ThreadPoolExecutor(16) as pool:
            headers = list(dict.fromkeys(h for own in pool.map(head, parts) for h in own))
        spark.dataSource.register(Members)
        options = {"parts": json.dumps(parts), "member": member, "headers": json.dumps(headers), "nrows": "" if nrows is None else str(nrows)}
        return spark.read.format(NAME).options(**options).load(), headers
    files = spark.read.format("binaryFile").load(parts).select("path", "content").repartition(len(parts))
    first = lambda file, path: iter([pa.RecordBatch.from_arrays([pa.array([headers_of(file, path, member)], type=pa.list_(pa.string())), pa.array([path])], names=["headers", "path"])])
    order = {p.rsplit("/", 1)[-1]: k for k, p in enumerate(parts)}
    found = sorted(files.mapInArrow(_whole(first), "headers array<string>, path string").collect(), key=lambda r: order.get(r["path"].rsplit("/", 1)[-1], 0))
    headers = list(dict.fromkeys(h for r in found for h in r["headers"]))
    schema = ", ".join([*(f"`{h.replace('`', '``')}` string" for h in headers), "_path string", "_line long"])
    return files.mapInArrow(_whole(lambda file, path: batches(file, path, member, headers, nrows)), schema), headers

"""A sink of files by two phases, as a data source, and the names of fonts among files.

``folio_blobs`` writes rows (name, content) as files.  Every task writes into
folders of its own under ``_pending``, ``FOLDER_FILES`` files in each; the commit
moves each folder into place by one rename.  A task that fails removes its
folders, an aborted job removes all of them and leaves a mark for tasks that still
run.  Readers look at committed folders only: the driver lists the folders, and
tasks list and read the files in them, so the driver never holds a name a file.
"""

from __future__ import annotations

import fnmatch
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from folio.sources.files import safe_path

FORMAT = "folio_blobs"
#: Files of one folder, which one task lists; bytes of contents and files that a reader holds at a time.
FOLDER_FILES, BATCH_BYTES, BATCH_FILES = 10_000, 4 << 20, 1000
#: Fixed values of the sfnt format: the record that holds a font's full name, and the platforms whose texts are not UTF-16.
FULL_NAME, MACINTOSH = 4, 1


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if urlparse(path).scheme:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


@dataclass
class Written(WriterCommitMessage):
    task: str
    folders: int


class BlobWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.run = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = _open(self.path)
        task = uuid.uuid4().hex
        own = f"{root}/_pending-{self.run}/{task}"
        files.create_dir(own, recursive=True)
        n = 0
        try:
            for row in iterator:
                folder = f"{own}/{n // FOLDER_FILES}"
                if n % FOLDER_FILES == 0:
                    files.create_dir(folder)
                place = safe_path(folder, row["name"] or "")
                if "/" in row["name"]:
                    files.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with files.open_output_stream(place) as out:
                    out.write(bytes(row["content"] or b""))
                n += 1
        except BaseException:
            files.delete_dir(own)
            raise
        # A task that outlives its job's abort takes its files away itself.
        if files.get_file_info(self._mark(root)).type != pafs.FileType.NotFound:
            files.delete_dir(f"{root}/_pending-{self.run}")
        return Written(task, -(-n // FOLDER_FILES))

    def _mark(self, root: str) -> str:
        return f"{root}/_aborted/{self.run}"

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _open(self.path)
        files.create_dir(f"{root}/files", recursive=True)
        for message in messages:
            for k in range(message.folders if message is not None else 0):
                files.move(f"{root}/_pending-{self.run}/{message.task}/{k}", f"{root}/files/part-{message.task}-{k}")
        self._clear(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _open(self.path)
        files.create_dir(f"{root}/_aborted", recursive=True)
        files.open_output_stream(self._mark(root)).close()
        self._clear(files, root)

    def _clear(self, files: pafs.FileSystem, root: str) -> None:
        if files.get_file_info(f"{root}/_pending-{self.run}").type == pafs.FileType.Directory:
            files.delete_dir(f"{root}/_pending-{self.run}")


class BlobSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> BlobWriter:
        if not {"name", "content"} <= set(schema.names):
            raise ValueError(f"files have a name and a content, not {schema.names}")
        if overwrite:
            raise ValueError("files are added, not replaced")
        return BlobWriter(self.options["path"])


def write_blobs(rows: DataFrame, path: str) -> None:
    """Write rows (name, content) as files under ``path``; names that are absolute or step out fail the job, which leaves nothing."""
    spark = rows.sparkSession
    spark.dataSource.register(BlobSource)
    rows.select("name", F.col("content").cast("binary").alias("content")).write.format(FORMAT).mode("append").option("path", path).save()


def read_blobs(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, length and content of the committed files whose last name fits ``pattern``; files without a byte are passed over."""
    files, root = _open(path)
    folders = [(x.base_name,) for x in files.get_file_info(pafs.FileSelector(f"{root}/files", allow_not_found=True))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(path)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                at = f"{root}/files/{folder}"
                held, size = [], 0
                for info in files.get_file_info(pafs.FileSelector(at, recursive=True)):
                    if info.type != pafs.FileType.File or not info.size or not fnmatch.fnmatchcase(info.base_name, pattern):
                        continue
                    with files.open_input_stream(info.path) as f:
                        held.append((info.path.split(f"/files/{folder}/", 1)[1], info.size, f.read()))
                    size += info.size
                    if size >= BATCH_BYTES or len(held) >= BATCH_FILES:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    rows = spark.createDataFrame(folders, "folder string").repartition(max(1, len(folders)))
    return rows.mapInArrow(run, "name string, length long, content binary")


def _batch(held: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["name", "length", "content"])


def full_name(data: bytes | None) -> str | None:
    """A font's full name: the first name record that says so, by its platform's encoding; null where there is none."""
    try:
        tables = struct.unpack_from(">H", data, 4)[0]
        found = [struct.unpack_from(">II", data, 12 + 16 * i + 8) for i in range(tables) if data[12 + 16 * i : 16 + 16 * i] == b"name"]
        at = found[0][0]
        _, records, texts = struct.unpack_from(">HHH", data, at)
        for i in range(records):
            platform, _, _, kind, length, offset = struct.unpack_from(">6H", data, at + 6 + 12 * i)
            if kind == FULL_NAME:
                raw = data[at + texts + offset : at + texts + offset + length]
                return raw.decode("mac_roman" if platform == MACINTOSH else "utf-16-be") if len(raw) == length else None
    except (TypeError, IndexError, struct.error, UnicodeDecodeError):
        return None
    return None


def font_name(content: Column) -> Column:
    """The full name in a font file's bytes; null for what is no font or has no such name."""
    return F.pandas_udf(lambda files: pd.Series([full_name(x) for x in files], dtype="object"), "string")(content)


def fonts(spark: SparkSession, path: str) -> DataFrame:
    """name and font of the committed ``*.ttf`` files; a broken file has no font and fails no other."""
    return read_blobs(spark, path, "*.ttf").select("name", font_name(F.col("content")).alias("font"))

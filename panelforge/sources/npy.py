"""Vector files in NumPy's format as a Spark data source: one file is read by many tasks, each at its own byte range.

``spark.read.format("npy").load(path)`` gives file, pos (row of the file) and embedding. ``path`` is a file or a folder,
on any file system that pyarrow opens. With ``.schema("pos long")``, or any other part of the columns, what isn't asked
for isn't read. ``df.write.format("npy").save(folder)`` writes (record_id, embedding) as files of bounded size with the ids
beside them; only the files of tasks that committed are listed in its manifest, which readers follow.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..errors import InvalidValue, MissingArtifact

#: Bytes that a task reads, bytes of a batch, bytes of a file that is written.
SPLIT_BYTES, BATCH_BYTES, FILE_BYTES = 64 << 20, 4 << 20, 64 << 20
MANIFEST = "manifest.json"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Header:
    """Where the rows begin, their number and length, and how a number is written."""

    offset: int
    rows: int
    dim: int
    dtype: str

    @property
    def row_bytes(self) -> int:
        return self.dim * np.dtype(self.dtype).itemsize


def read_header(fs: pafs.FileSystem, path: str) -> Header:
    """Only the header is read. Matrices whose rows lie together are understood, nothing else."""
    with fs.open_input_file(path) as f:
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, by_column, dtype = read(f)
        offset, size = f.tell(), f.size()
    if len(shape) != 2 or by_column or dtype.hasobject:
        raise InvalidValue(f"{path} isn't a matrix of numbers, row after row")
    h = Header(offset, shape[0], shape[1], dtype.str)
    if size < offset + h.rows * h.row_bytes:
        raise InvalidValue(f"{path} is shorter than its header says")
    return h


@dataclass(frozen=True)
class Range(InputPartition):
    path: str
    first: int
    rows: int
    header: Header


def files_of(path: str) -> list[str]:
    """The file itself, or the files of a folder: those that its manifest lists, if it has one."""
    fs, at = opened(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [path]
    if info.type != pafs.FileType.Directory:
        raise MissingArtifact(path)
    if fs.get_file_info(posixpath.join(at, MANIFEST)).type == pafs.FileType.File:
        with fs.open_input_stream(posixpath.join(at, MANIFEST)) as f:
            names = json.loads(f.read())["files"]
    else:
        names = sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(at)) if i.base_name.endswith(".npy"))
    return [posixpath.join(path, n) for n in names]


class NpyReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.path, self.split = schema.names, options["path"], int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[Range]:
        out = []
        for path in files_of(self.path):
            h = read_header(*opened(path))
            step = max(1, self.split // max(1, h.row_bytes))
            out += [Range(path, low, min(step, h.rows - low), h) for low in range(0, h.rows, step)]
        return out or [Range("", 0, 0, Header(0, 0, 0, "<f4"))]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        h = partition.header
        step = max(1, BATCH_BYTES // max(1, h.row_bytes))
        wants = "embedding" in self.names
        f = None
        if wants and partition.rows:
            fs, at = opened(partition.path)
            f = fs.open_input_file(at)
            f.seek(h.offset + partition.first * h.row_bytes)
        for low in range(0, partition.rows, step):
            n = min(step, partition.rows - low)
            columns = {"file": lambda n=n: pa.array([posixpath.basename(partition.path)] * n), "pos": lambda low=low, n=n: pa.array(np.arange(partition.first + low, partition.first + low + n))}
            if wants:
                flat = np.frombuffer(f.read(n * h.row_bytes), h.dtype).astype(np.float32)
                columns["embedding"] = lambda flat=flat, n=n: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * h.dim), pa.array(flat))
            yield pa.RecordBatch.from_arrays([columns[c]() for c in self.names], self.names)
        if f is not None:
            f.close()


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class NpyWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.bytes = options["path"], int(options.get("filebytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Files of bounded size; a row's vector must be there and as long as the others of its file."""
        fs, at = opened(self.path)
        fs.create_dir(at)
        files: list[str] = []
        held: list[np.ndarray] = []
        ids: list[str] = []

        def flush() -> None:
            x, name = np.concatenate(held), f"part-{uuid.uuid4().hex}.npy"
            with fs.open_output_stream(posixpath.join(at, name)) as f:
                np.lib.format.write_array(f, x, version=(1, 0), allow_pickle=False)
            with fs.open_output_stream(posixpath.join(at, name.replace(".npy", ".meta.json"))) as f:
                f.write(json.dumps({"row_ids": ids}, ensure_ascii=False).encode())
            files.append(name)
            held.clear()
            ids.clear()

        for batch in iterator:
            lists = batch.column(batch.schema.get_field_index("embedding"))
            sizes = set(np.diff(lists.offsets.to_numpy()).tolist())
            if lists.null_count or len(sizes) > 1:
                raise InvalidValue("vectors are missing or of unlike lengths")
            if batch.num_rows:
                x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(batch.num_rows, -1)
                if held and held[0].shape[1] != x.shape[1]:
                    flush()
                held.append(x)
                ids += batch.column(batch.schema.get_field_index("record_id")).to_pylist()
                if sum(h.nbytes for h in held) >= self.bytes:
                    flush()
        if held:
            flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = opened(self.path)
        fs.create_dir(at)
        with fs.open_output_stream(posixpath.join(at, MANIFEST)) as f:
            f.write(json.dumps({"files": sorted(n for m in messages if m for n in m.files)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = opened(self.path)
        for n in (n for m in messages if m for n in m.files):
            fs.delete_file(posixpath.join(at, n))


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "file string, pos long, embedding array<float>"

    def reader(self, schema: StructType) -> NpyReader:
        if unknown := [c for c in schema.names if c not in ("file", "pos", "embedding")]:
            raise InvalidValue(f"vector files have no {', '.join(unknown)}")
        return NpyReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        if missing := [c for c in ("record_id", "embedding") if c not in schema.names]:
            raise InvalidValue(f"vector files need {', '.join(missing)}")
        return NpyWriter(self.options, overwrite)


def read_npy(spark: SparkSession, path: str, columns: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """file, pos, embedding of one file or a folder of files."""
    spark.dataSource.register(NpySource)
    reader = spark.read.format("npy").option("splitBytes", split_bytes)
    return (reader.schema(columns) if columns else reader).load(path)


def write_npy(vectors: DataFrame, id_col: str, vector_col: str, path: str, file_bytes: int = FILE_BYTES) -> None:
    """The vectors and their ids as files below ``path``; what was there before stays but isn't listed any longer."""
    vectors.sparkSession.dataSource.register(NpySource)
    rows = vectors.select(F.col(id_col).cast("string").alias("record_id"), F.transform(vector_col, lambda x: x.cast("float")).alias("embedding"))
    rows.write.format("npy").option("fileBytes", file_bytes).mode("append").save(path)


def row_ids(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, record_id from the ids beside the vector files: a task a file."""
    meta = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.meta\.json$", ".npy").alias("file"), F.from_json("value", "row_ids array<string>")["row_ids"].alias("ids"))
    return meta.select("file", F.posexplode("ids").alias("pos", "record_id"))


def read_records_npy(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """record_id, embedding of the vectors below the folder ``path``."""
    listed = read_npy(spark, path, None, split_bytes)
    ids = row_ids(spark, f"{path.rstrip('/')}/*.meta.json")
    return listed.join(ids, ["file", "pos"]).select("record_id", "embedding")

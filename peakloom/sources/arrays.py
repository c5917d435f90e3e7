"""Array files: a Python data source for sharded NPY matrices with a manifest.

A table of (id, vector) is written as shards, each an ids file and a matrix file of one kind of number, by the tasks themselves.
The driver's commit writes the manifest, which names each shard with its rows and its least and largest id; until then nothing
is readable, and an aborted write removes its shards. Reading takes a partition a shard, leaves out those outside the
range of ids that is asked for, and maps the matrix into memory, so that only the rows of a batch are touched.

Paths are of any file system that Arrow knows; memory mapping is for local and mounted ones.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MANIFEST = "manifest.json"
SHARD_ROWS = 100_000
BATCH_ROWS = 2000
KINDS = {"float": np.float32, "double": np.float64}


def _place(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if ":/" in path else (pa.fs.LocalFileSystem(), path)


@dataclass
class Shard(InputPartition):
    name: str
    rows: int
    least: int
    largest: int


@dataclass
class Written(WriterCommitMessage):
    shards: list
    width: int


class ArraySource(DataSource):
    """``spark.read.format("npy_shards").load(path)``; options: kind (float or double) and shard_rows for writing, low and high (ids) for reading."""

    @classmethod
    def name(cls) -> str:
        return "npy_shards"

    def schema(self) -> str:
        return f"id long, vector array<{read_manifest(self.options['path'])['kind']}>"

    def reader(self, schema) -> DataSourceReader:
        return ArrayReader(self.options["path"], *(int(self.options[x]) if x in self.options else None for x in ("low", "high")))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if [f.dataType.simpleString() for f in schema.fields][:1] != ["bigint"] or len(schema.fields) != 2:
            raise ValueError("an array table has two columns: a long id and a vector")
        return ArrayWriter(self.options["path"], self.options.get("kind", "float"), int(self.options.get("shard_rows", SHARD_ROWS)), overwrite)


def read_manifest(path: str) -> dict:
    fs, root = _place(path)
    with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


class ArrayReader(DataSourceReader):
    """Shards whose ids meet the closed range of the options ``low`` and ``high``."""

    def __init__(self, path: str, low: int | None = None, high: int | None = None):
        self.path, self.manifest, self.low, self.high = path, read_manifest(path), low, high

    def partitions(self) -> list[Shard]:
        shards = [Shard(**s) for s in self.manifest["shards"]]
        return [s for s in shards if (self.low is None or s.largest >= self.low) and (self.high is None or s.least <= self.high)]

    def read(self, shard: Shard | None) -> Iterator[pa.RecordBatch]:
        if shard is None:  # nothing is left
            return
        fs, root = _place(self.path)
        ids, matrix = _array(fs, f"{root}/{shard.name}.ids.npy"), _array(fs, f"{root}/{shard.name}.npy")
        if len(ids) != shard.rows or matrix.shape != (shard.rows, self.manifest["width"]):
            raise ValueError(f"shard {shard.name} has other rows or another width than the manifest")
        width = self.manifest["width"]
        for at in range(0, shard.rows, BATCH_ROWS):
            part = np.ascontiguousarray(matrix[at : at + BATCH_ROWS])
            offsets = np.arange(len(part) + 1, dtype=np.int32) * width
            vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(part.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids[at : at + BATCH_ROWS])), vectors], ["id", "vector"])


def _array(fs: pa.fs.FileSystem, path: str) -> np.ndarray:
    if isinstance(fs, pa.fs.LocalFileSystem):
        return np.load(path, mmap_mode="r")
    with fs.open_input_stream(path) as f:
        return np.load(io.BytesIO(f.read()))


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, shard_rows: int, overwrite: bool):
        if kind not in KINDS or shard_rows <= 0:
            raise ValueError("kind must be float or double, shard_rows positive")
        self.path, self.kind, self.shard_rows, self.overwrite = path, kind, shard_rows, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _place(self.path)
        fs.create_dir(root, recursive=True)
        shards, width, held, count = [], 0, [], 0

        def flush(table: pa.Table) -> None:
            nonlocal width
            ids = table.column(0).to_numpy()
            vectors = table.column(1).combine_chunks()
            vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
            flat = vectors.flatten()
            sizes = set(np.diff(vectors.offsets.to_numpy()).tolist())
            if vectors.null_count or flat.null_count or len(sizes) > 1 or (width and sizes != {width}) or table.column(0).null_count:
                raise ValueError("ids must not be null, vectors must be of one length and without nulls")
            width = sizes.pop()
            name = f"shard-{uuid.uuid4().hex}"
            for suffix, array in ((".ids.npy", ids.astype(np.int64)), (".npy", flat.to_numpy().astype(KINDS[self.kind]).reshape(-1, width))):
                with fs.open_output_stream(f"{root}/{name}{suffix}") as f:
                    buffer = io.BytesIO()
                    np.save(buffer, array)
                    f.write(buffer.getbuffer())
            shards.append({"name": name, "rows": len(ids), "least": int(ids.min()), "largest": int(ids.max())})

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count >= self.shard_rows:
                whole = pa.Table.from_batches(held).combine_chunks()
                flush(whole.slice(0, self.shard_rows).combine_chunks())
                held = whole.slice(self.shard_rows).to_batches()
                count -= self.shard_rows
        if count:
            flush(pa.Table.from_batches(held).combine_chunks())
        return Written(shards, width)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _place(self.path)
        done = [m for m in messages if m is not None]
        shards = sorted((s for m in done for s in m.shards), key=lambda s: (s["least"], s["name"]))
        widths = {m.width for m in done if m.shards}
        if len(widths) > 1:
            self.abort(messages)
            raise ValueError("vectors must be of one length")
        fs.create_dir(root, recursive=True)
        old = [] if self._fresh(fs, root) else read_manifest(self.path)["shards"]
        if old and not self.overwrite:
            kept = read_manifest(self.path)
            if kept["kind"] != self.kind or widths and {kept["width"]} != widths:
                self.abort(messages)
                raise ValueError("appended vectors must be of the table's kind and length")
            shards, widths = sorted([*old, *shards], key=lambda s: (s["least"], s["name"])), {kept["width"]}
        with fs.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps({"kind": self.kind, "width": widths.pop() if widths else 0, "rows": sum(s["rows"] for s in shards), "shards": shards}).encode())
        if self.overwrite:
            self._delete(old)

    def abort(self, messages: list[Written | None]) -> None:
        self._delete([s for m in messages if m is not None for s in m.shards])

    def _delete(self, shards: list[dict]) -> None:
        fs, root = _place(self.path)
        for s in shards:
            for suffix in (".ids.npy", ".npy"):
                fs.delete_file(f"{root}/{s['name']}{suffix}")

    @staticmethod
    def _fresh(fs: pa.fs.FileSystem, root: str) -> bool:
        return fs.get_file_info(f"{root}/{MANIFEST}").type == pa.fs.FileType.NotFound


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArraySource)


def write_arrays(df: DataFrame, path: str, id_col: str, vector: str, kind: str = "float", shard_rows: int = SHARD_ROWS, mode: str = "overwrite") -> None:
    """Rows go to shards in ranges of their ids, so that a range of ids is in few shards."""
    from pyspark.sql import functions as F

    register(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("vector"))
    rows.repartitionByRange("id").sortWithinPartitions("id").write.format("npy_shards").option("kind", kind).option("shard_rows", shard_rows).mode(mode).save(path)


def read_arrays(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """(id, vector) with ids from ``low`` to ``high``: only the shards that hold such ids are opened.

    The bounds are options of one read, not pushed filters, as Spark shares the pushed ones among all uses of a loaded table.
    """
    from pyspark.sql import functions as F

    register(spark)
    reader = spark.read.format("npy_shards")
    for name, bound in (("low", low), ("high", high)):
        if bound is not None:
            reader = reader.option(name, bound)
    rows = reader.load(path)
    if low is not None:
        rows = rows.where(F.col("id") >= low)
    return rows if high is None else rows.where(F.col("id") <= high)

"""Shared plumbing of the training-data operators: byte streams on any store, batches, names."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import Table, fresh_path, free_name, remove, scratch, shared_dir  # noqa: F401  for the operators

def open_store(uri: str):
    """The pyarrow file system of a URI and the path inside it; usable on executors."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_bytes(uri: str, payload: bytes) -> None:
    """Write under a private name first, so that a killed task leaves no half file under the real one."""
    store, path = open_store(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(draft) as out:
        out.write(payload)
    store.move(draft, path)


def read_bytes(uri: str) -> bytes:
    store, path = open_store(uri)
    with store.open_input_file(path) as src:
        return src.read()


def in_slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def by_bytes(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices whose strings hold about `most` bytes together; a longer one is alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, np.cumsum(lengths + 32)
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


#: Bytes of an Arrow batch of texts; the default is for narrow rows.
BATCH_BYTES, _BYTES_KEY, _DEFAULT_BYTES = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session already has its own bound: both sides of the pipe hold one."""
    now = spark.conf.get(_BYTES_KEY, None)
    if now and now.rstrip("b").isdigit() and int(now.rstrip("b")) == _DEFAULT_BYTES:
        spark.conf.set(_BYTES_KEY, f"{BATCH_BYTES}b")


def give_back() -> None:
    """Return what was freed to the system: allocators keep it otherwise, and workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if os.name == "posix" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that leaves its worker small, and unless it `keeps` something itself begins without what others kept."""

    def small(batches):
        if not keeps:
            forget()
        yield from run(batches)
        give_back()

    return small


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, keeps: bool = False) -> DataFrame:
    """mapInArrow with per-task state: make() runs once in each task and returns the batch function; `keeps` if it uses resident()."""
    small_batches(df.sparkSession)

    def run(batches):
        step = make()
        for batch in batches:
            for part in in_slices(batch):
                out = step(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(lean(run, keeps), schema)


_RESIDENT: dict[tuple, object] = {}


def resident(key: tuple, make: Callable[[], object]):
    """What a worker process keeps between tasks: one thing only, so that workers serving several operators in turn stay small."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def forget() -> None:
    """Drop what this worker keeps."""
    _RESIDENT.clear()


def arrow_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def doc_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns that text operators read, whatever else the table holds."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def free_prefix(df: DataFrame, stem: str) -> str:
    """A beginning that no column name of the table has, whatever the case."""
    prefix = f"_{stem}_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def hex64(col: Column) -> Column:
    return F.lpad(F.lower(F.hex(col)), 16, "0")

"""IDX image and label files: a Spark data source with byte-range partitions, and a writer.

Records have a fixed size, so record i of the image file begins at 16 + i * rows * columns and the label at
8 + i: partitions are exact ranges of both files, and a limit cuts the last range instead of the result.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import SAMPLES, Split, find_split

#: The magic numbers of the format.
IMAGES, LABELS = 2051, 2049
TARGET_BYTES = 32 << 20


def _open(path: str):
    """A seekable reader of a local path or of a URI that Arrow's file systems know."""
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    try:
        return open(path.removeprefix("file://"), "rb")
    except OSError as error:
        raise RuntimeError(f"could not open {path}") from error


def _header(path: str, count: int) -> tuple[int, ...]:
    with _open(path) as f:
        data = f.read(4 * count)
    if len(data) < 4 * count:
        raise RuntimeError(f"truncated IDX header: {path}")
    return struct.unpack(f">{count}I", data)


def read_headers(images: str, labels: str) -> tuple[int, int, int]:
    """(count, rows, columns) of a checked pair."""
    magic, n, rows, columns = _header(images, 4)
    if magic != IMAGES:
        raise RuntimeError(f"not an IDX image file: {images}")
    magic, m = _header(labels, 2)
    if magic != LABELS:
        raise RuntimeError(f"not an IDX label file: {labels}")
    if n != m:
        raise RuntimeError("IDX image and label counts differ")
    if rows == 0 or columns == 0 or rows * columns > (1 << 63) - 1:
        raise RuntimeError("invalid IDX image dimensions")
    return n, rows, columns


class _Range(InputPartition):
    def __init__(self, first: int, last: int, rows: int, columns: int):
        self.first, self.last, self.rows, self.columns = first, last, rows, columns


class IdxSource(DataSource):
    """Options: images, labels (paths), limit (0: all), maximum (largest allowed label)."""

    @classmethod
    def name(cls) -> str:
        return "idx"

    def schema(self) -> str:
        return SAMPLES

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _IdxReader(self.options)


class _IdxReader(DataSourceReader):
    def __init__(self, options):
        self.images, self.labels = options["images"], options["labels"]
        self.limit = int(options.get("limit", "0"))
        self.maximum = int(options.get("maximum", "9"))
        self.target = int(options.get("target", str(TARGET_BYTES)))

    def partitions(self) -> list[InputPartition]:
        n, rows, columns = read_headers(self.images, self.labels)
        if self.limit:
            n = min(n, self.limit)
        step = max(1, self.target // (rows * columns))
        return [_Range(a, min(n, a + step), rows, columns) for a in range(0, n, step)] or [_Range(0, 0, rows, columns)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        import numpy as np

        size = part.rows * part.columns
        step = max(1, (1 << 21) // size)
        with _open(self.images) as pixels, _open(self.labels) as labels:
            pixels.seek(16 + part.first * size)
            labels.seek(8 + part.first)
            for first in range(part.first, part.last, step):
                n = min(step, part.last - first)
                data, marks = pixels.read(n * size), labels.read(n)
                if len(data) < n * size:
                    raise RuntimeError(f"truncated IDX image data: {self.images}")
                if len(marks) < n:
                    raise RuntimeError(f"truncated IDX label data: {self.labels}")
                label = np.frombuffer(marks, dtype=np.uint8).astype(np.int32)
                if (label > self.maximum).any():
                    raise RuntimeError(f"IDX label above {self.maximum}: {self.labels}")
                flat = pa.array(np.frombuffer(data, dtype=np.uint8).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * size, size), pa.int32()), flat)
                fill = lambda x: pa.array(np.full(n, x, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), fill(part.rows), fill(part.columns), lists, pa.array(label)], names=["idx", "rows", "columns", "pixels", "label"])


def load_idx(spark: SparkSession, images: str, labels: str, limit: int = 0, maximum: int = 9) -> DataFrame:
    """Samples in file order (``idx``); a bad header raises here, bad data and labels when read."""
    read_headers(images, labels)
    spark.dataSource.register(IdxSource)
    return spark.read.format("idx").options(images=images, labels=labels, limit=str(limit), maximum=str(maximum)).load()


def load_split(spark: SparkSession, folder: str, split: Split | str, training: bool, limit: int = 0) -> DataFrame:
    """A standard partition by its file names; labels may reach offset + classes - 1, and lie at or above the offset."""
    from ..operators.transform import check_labels

    split = find_split(split) if isinstance(split, str) else split
    stem = f"{folder.rstrip('/')}/emnist-{split.name}-{'train' if training else 'test'}"
    found = load_idx(spark, f"{stem}-images-idx3-ubyte", f"{stem}-labels-idx1-ubyte", limit, split.offset + split.classes - 1)
    return check_labels(found, split)


def load_digits(spark: SparkSession, folder: str, training: bool, limit: int = 0) -> DataFrame:
    stem = f"{folder.rstrip('/')}/{'train' if training else 't10k'}"
    return load_idx(spark, f"{stem}-images-idx3-ubyte", f"{stem}-labels-idx1-ubyte", limit)


def _create(path: str):
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.open_output_stream(inner)
    path = path.removeprefix("file://")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    return open(path, "wb")


def write_idx(images: str, labels: str, records: Iterable[tuple[Sequence[int], int]], count: int, rows: int, columns: int) -> None:
    """A pair of files of ``count`` (pixels, label) records, written as they come: none but the current one is held."""
    written = 0
    with _create(images) as pixels, _create(labels) as marks:
        pixels.write(struct.pack(">4I", IMAGES, count, rows, columns))
        marks.write(struct.pack(">2I", LABELS, count))
        for image, mark in records:
            if len(image) != rows * columns:
                raise ValueError(f"record {written} has {len(image)} pixels, not {rows * columns}")
            pixels.write(bytes(image))
            marks.write(bytes([mark]))
            written += 1
    if written != count:
        raise ValueError(f"{written} records, where the headers say {count}")

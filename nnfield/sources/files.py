"""PNG files from image rows, one file per row, written by the tasks that hold the rows, and read back."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# PNG signature and colour type per number of channels.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
COLOUR_TYPE = {1: 0, 3: 2, 4: 6}
CHANNELS = {kind: channels for channels, kind in COLOUR_TYPE.items()}
# The columns of Spark's binary file source.
BINARY_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
# Pixel bytes of a batch that goes back to Spark; mean bytes of files a task decodes, and the partitions of small ones it may join.
BATCH_BYTES = 16 * 1024 * 1024
TASK_BYTES = 128 * 1024 * 1024
SHARED_PARTITIONS = 128


def encode_png(values: np.ndarray) -> bytes:
    """Height x width x channels bytes (RGB order) as one PNG."""
    height, width, channels = values.shape

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = values.astype(np.uint8).reshape(height, width * channels)
    filtered = np.hstack([np.zeros((height, 1), np.uint8), rows])
    header = struct.pack(">IIBBBBB", width, height, 8, COLOUR_TYPE[channels], 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(filtered.tobytes())) + chunk(b"IEND", b"")


def decode_png(content: bytes) -> np.ndarray | None:
    """Height x width x channels bytes (RGB order) of a PNG with 8 bits a channel: grey, RGB or RGBA, in plain order of lines.

    None if it is anything else: no PNG, a broken one, or one with a palette, other depths, a transparent colour or interlacing.
    """
    if content[:8] != SIGNATURE:
        return None
    at, header, bodies = 8, b"", []
    while at + 8 <= len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        body, at = content[at + 8:at + 8 + size], at + 12 + size
        if kind == b"IHDR":
            header = body
        elif kind == b"IDAT":
            bodies.append(body)
        elif kind == b"tRNS":
            return None
    if len(header) != 13:
        return None
    width, height, depth, colour, *plain = struct.unpack(">IIBBBBB", header)
    if depth != 8 or colour not in CHANNELS or any(plain) or not width or not height:
        return None
    channels = CHANNELS[colour]
    size, stream = height * (width * channels + 1), zlib.decompressobj()
    try:
        lines = stream.decompress(b"".join(bodies), size + 1)
    except zlib.error:
        return None
    if len(lines) != size or not stream.eof:
        return None
    table = np.frombuffer(lines, np.uint8).reshape(height, width * channels + 1)
    values = _unfiltered(table[:, 0], table[:, 1:], channels)
    return None if values is None else values.reshape(height, width, channels)


def _unfiltered(kinds: np.ndarray, lines: np.ndarray, channels: int) -> np.ndarray | None:
    """Lines of bytes from their differences: to the left, to the line above, to the mean of both, or to Paeth's choice."""
    if not kinds.any():
        return lines
    if kinds.max() > 4:
        return None
    out = np.zeros_like(lines)
    above = np.zeros(lines.shape[1], np.uint8)
    for y, kind in enumerate(kinds):
        if kind == 1:
            np.add.accumulate(lines[y].reshape(-1, channels), axis=0, dtype=np.uint8, out=out[y].reshape(-1, channels))
        elif kind in (3, 4):
            out[y] = _line(lines[y].tolist(), above.tolist(), channels, kind)
        else:
            out[y] = lines[y] + above if kind == 2 else lines[y]
        above = out[y]
    return out


def _line(line: list[int], above: list[int], channels: int, kind: int) -> list[int]:
    """A line whose bytes each depend on the byte before."""
    made, above = [0] * channels, [0] * channels + above
    for i, value in enumerate(line):
        left, up, corner = made[i], above[i + channels], above[i]
        if kind == 3:
            guess = (left + up) // 2
        else:
            to_left, to_up, to_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            guess = left if to_left <= to_up and to_left <= to_corner else up if to_up <= to_corner else corner
        made.append((value + guess) % 256)
    return made[channels:]


def decode_files(files: DataFrame) -> DataFrame:
    """Rows of Spark's binary file source as (path, height, width, channels, data BINARY, valid), as ``scan_images`` gives them.

    ``valid`` is false, and there are no pixels, where ``decode_png`` finds no PNG that it reads. The source makes a
    partition of a few or some tens of small files; here many share a task, since a Python worker costs more than such files.
    """
    schema = pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()),
                        ("data", pa.binary()), ("valid", pa.bool_())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = decode_png(content.as_py())
                if values is None:
                    rows.append((path, -1, -1, -1, b"", False))
                else:
                    order = [2, 1, 0, 3][:values.shape[2]] if values.shape[2] > 1 else [0]
                    rows.append((path, *values.shape, values[:, :, order].tobytes(), True))
                size += len(rows[-1][4])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, size = [], 0

    read = files.select(F.input_file_name().alias("path"), "content")
    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    if not files.isStreaming:
        size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        tasks = max(tasks, -(-size // TASK_BYTES), -(-read.rdd.getNumPartitions() // SHARED_PARTITIONS))
    return read.coalesce(tasks).mapInArrow(decode, "path STRING, height INT, width INT, channels INT, data BINARY, valid BOOLEAN")


def scan_png(spark: SparkSession, path: str) -> DataFrame:
    """PNG files as ``scan_images`` gives them, channels in BGR order too, for folders of very many small files.

    Spark's image source builds a serializer for each file, some milliseconds; it reads other formats and kinds of PNG.
    """
    return decode_files(spark.read.format("binaryFile").load(path))


def write_png(images: DataFrame, path: str, key: str) -> int:
    """Write ``images(key, height, width, channels, data ARRAY<INT>)`` as ``path/key=<value>.png``.

    ``path`` is a folder all executors reach, under any scheme pyarrow knows; one without a scheme is
    resolved by Spark's default filesystem, as the image source does. A task that runs again writes the
    same files again. Returns the number of files.
    """
    spark = images.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
        files.create_dir(folder, recursive=True)
        for batch in batches:
            for row in batch.itertuples(index=False):
                values = np.asarray(row.data).reshape(row.height, row.width, row.channels)
                with files.open_output_stream(f"{folder}/{key}={getattr(row, key)}.png") as out:
                    out.write(encode_png(values))
            yield pd.DataFrame({"files": [len(batch)]})

    rows = images.select(key, "height", "width", "channels", "data")
    return rows.mapInPandas(write, "files BIGINT").agg(F.sum("files")).first()[0] or 0

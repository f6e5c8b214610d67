"""WAV files as a Spark data source: one row per channel and block of samples.

    spark.dataSource.register(WavSource)
    spark.read.format("wav").option("path", folder).option("block", 65536).load()

A partition reads a run of blocks of one file by offset, so long files are read by many tasks and none holds a file.
PCM of 16, 24 and 32 bits and 32-bit floats are read; a file that is none of these gives one row with ``error``.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "track string, channel int, block long, start long, rate int, data array<float>, error string"
#: Blocks that a task reads.
BLOCKS_A_TASK = 64


class Run(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


def header(f) -> tuple[int, int, int, int, int, int]:
    """(format, channels, rate, bits, offset of the samples, bytes of samples) of an open WAV file."""
    riff, _, wave = struct.unpack("<4sI4s", f.read(12))
    if riff != b"RIFF" or wave != b"WAVE":
        raise ValueError("no RIFF WAVE header")
    kind = None
    while True:
        head = f.read(8)
        if len(head) < 8:
            raise ValueError("no samples")
        name, size = struct.unpack("<4sI", head)
        if name == b"fmt ":
            body = f.read(size + size % 2)
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if kind == 0xFFFE and len(body) >= 26:
                kind = struct.unpack("<H", body[24:26])[0]
        elif name == b"data":
            if kind is None:
                raise ValueError("samples before format")
            return kind, channels, rate, bits, f.tell(), min(size, os.fstat(f.fileno()).st_size - f.tell())
        else:
            f.seek(size + size % 2, 1)


def decode(raw: bytes, kind: int, bits: int) -> np.ndarray:
    """Samples between -1 and 1."""
    if kind == 3 and bits == 32:
        return np.frombuffer(raw, "<f4")
    if kind == 1 and bits in (16, 32):
        return (np.frombuffer(raw, f"<i{bits // 8}") / float(1 << (bits - 1))).astype(np.float32)
    if kind == 1 and bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        return (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / float(1 << 23)).astype(np.float32)
    raise ValueError(f"unread format {kind} with {bits} bits")


class WavReader(DataSourceReader):
    def __init__(self, path: str, block: int):
        self.path, self.block = path, block

    def partitions(self) -> list[InputPartition]:
        files = [self.path] if os.path.isfile(self.path) else [os.path.join(d, n) for d, _, names in os.walk(self.path) for n in names if n.lower().endswith(".wav")]
        out: list[InputPartition] = []
        for p in sorted(files):
            try:
                with open(p, "rb") as f:
                    _, channels, _, bits, _, size = header(f)
                blocks = -(-size // max(1, channels * bits // 8 * self.block))
            except (ValueError, struct.error):
                blocks = 1
            out += [Run(p, b, min(BLOCKS_A_TASK, blocks - b)) for b in range(0, max(blocks, 1), BLOCKS_A_TASK)]
        return out or [Run("", 0, 0)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float32()), pa.string()]
        names = ["track", "channel", "block", "start", "rate", "data", "error"]

        def rows(values: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in values], type=k) for i, k in enumerate(kinds)], names=names)

        if not partition.count:
            return
        track = os.path.basename(partition.path)
        try:
            with open(partition.path, "rb") as f:
                kind, channels, rate, bits, at, size = header(f)
                step = channels * bits // 8
                for b in range(partition.first, partition.first + partition.count):
                    begin = b * self.block * step
                    f.seek(at + begin)
                    raw = f.read(max(0, min(self.block * step, size - begin)))
                    x = decode(raw[: len(raw) // step * step], kind, bits).reshape(-1, channels)
                    yield rows([(track, c, b, b * self.block, rate, x[:, c], None) for c in range(channels)])
        except (ValueError, struct.error) as e:
            yield rows([(track, None, None, None, None, None, str(e))])


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WavReader(self.options["path"], int(self.options.get("block", 65536)))

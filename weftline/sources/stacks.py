"""Stacks of gray images in TIFF files, as a Spark data source: a partition for each run of pages, planned from the files' page directories."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .tables import PIXELS

# Tags of the page directory
WIDTH, HEIGHT, BITS, COMPRESSION, MEANING, OFFSETS, SAMPLES, ROWS, COUNTS, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339
# Field types and how they are packed
FIELDS = {1: "B", 3: "H", 4: "I", 16: "Q"}

#: Pixels of a partition, at least one page.
RUN = 1 << 22


@dataclass
class Page(InputPartition):
    """A gray page: where its strips are, and how pixels are packed (a numpy type)."""
    frame: int
    width: int
    height: int
    kind: str
    inverted: bool
    strips: list[tuple[int, int]]


@dataclass
class Run(InputPartition):
    path: str
    pages: list[Page]


def pages_of(path: str) -> list[Page]:
    """The pages of a file, from its directories alone; pixels aren't read. Other than uncompressed gray pages of 8 or 16 bits (whole numbers) or 32 bits (floats) are an error."""
    with open(path, "rb") as f:
        mark = f.read(8)
        order = {b"II": "<", b"MM": ">"}.get(mark[:2])
        if order is None or struct.unpack(order + "H", mark[2:4])[0] != 42:
            raise ValueError(f"{path} isn't a TIFF file")
        at, out, seen = struct.unpack(order + "I", mark[4:8])[0], [], set()
        while at and at not in seen:
            seen.add(at)
            f.seek(at)
            n, = struct.unpack(order + "H", f.read(2))
            entries = [struct.unpack(order + "HHI4s", f.read(12)) for _ in range(n)]
            at, = struct.unpack(order + "I", f.read(4))
            tags = {}
            for tag, kind, count, value in entries:
                if kind in FIELDS:
                    size = struct.calcsize(FIELDS[kind]) * count
                    if size > 4:
                        f.seek(struct.unpack(order + "I", value)[0])
                        value = f.read(size)
                    tags[tag] = struct.unpack(f"{order}{count}{FIELDS[kind]}", value[:size])
            get = lambda tag, default=None: tags.get(tag, (default,))[0]  # noqa: E731,B023
            bits, form = get(BITS, 1), get(FORMAT, 1)
            kind = {(8, 1): "u1", (16, 1): "u2", (32, 3): "f4"}.get((bits, form))
            if kind is None or get(SAMPLES, 1) != 1 or get(MEANING) not in (0, 1):
                raise ValueError(f"{path}, page {len(out) + 1}: only gray images of 8, 16 or 32 bits can be read")
            if get(COMPRESSION, 1) != 1:
                raise ValueError(f"{path}, page {len(out) + 1}: compressed pages can't be read")
            out.append(Page(len(out) + 1, get(WIDTH), get(HEIGHT), order + kind, get(MEANING) == 0, list(zip(tags[OFFSETS], tags[COUNTS]))))
    return out


class StackReader(DataSourceReader):
    def __init__(self, path: str, run: int):
        self.path, self.run = path, run
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the frame choose pages; the others are left to Spark."""
        made = {EqualTo: lambda a, v: a == v, In: lambda a, v: a in v, GreaterThan: lambda a, v: a > v, GreaterThanOrEqual: lambda a, v: a >= v, LessThan: lambda a, v: a < v, LessThanOrEqual: lambda a, v: a <= v}
        for f in filters:
            if type(f) in made and f.attribute == ("frame",) and (f.value if not isinstance(f.value, (list, tuple)) else True) is not None:
                self.tests.append((made[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Run]:
        out, size = [], 0
        for page in pages_of(self.path):
            if not all(test(page.frame, value) for test, value in self.tests):
                continue
            if not out or size >= self.run:
                out.append(Run(self.path, []))
                size = 0
            out[-1].pages.append(page)
            size += page.width * page.height
        return out

    def read(self, run: Run | None) -> Iterator[pa.RecordBatch]:
        if run is None:  # no page
            return
        with open(run.path, "rb") as f:
            for p in run.pages:
                data = b""
                for at, n in p.strips:
                    f.seek(at)
                    data += f.read(n)
                v = np.frombuffer(data, p.kind, p.width * p.height).astype("float64")
                if p.inverted and p.kind[1] == "u":
                    v = np.iinfo(np.dtype(p.kind)).max - v
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(v), p.frame, "i4")), pa.array(np.repeat(np.arange(p.height, dtype="i4"), p.width)), pa.array(np.tile(np.arange(p.width, dtype="i4"), p.height)), pa.array(v)],
                    ["frame", "y", "x", "v"])


class StackSource(DataSource):
    """spark.read.format("gray_stack").load(path): frame (the page, from 1), y, x, v."""

    @classmethod
    def name(cls) -> str:
        return "gray_stack"

    def schema(self) -> StructType:
        return PIXELS

    def reader(self, schema: StructType) -> StackReader:
        return StackReader(self.options["path"], int(self.options.get("run", RUN)))


def read_stack(spark: SparkSession, path: str, run: int = RUN):
    """Pixels of a stack. `path` is a file that the driver and all executors can open; filters on `frame` leave other pages unread."""
    spark.dataSource.register(StackSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("gray_stack").option("run", run).load(path)


def write_stack(path: str, pages: list[np.ndarray]) -> None:
    """A stack from arrays of one type each (unsigned 8 or 16 bits, 32-bit floats), for tests and exchange of single stacks; one strip a page."""
    with open(path, "wb") as f:
        f.write(struct.pack("<2sHI", b"II", 42, 8))
        for k, a in enumerate(pages):
            data = np.ascontiguousarray(a).astype(a.dtype.newbyteorder("<")).tobytes()
            tags = [(WIDTH, a.shape[1]), (HEIGHT, a.shape[0]), (BITS, 8 * a.itemsize), (COMPRESSION, 1), (MEANING, 1), (OFFSETS, 0), (SAMPLES, 1), (ROWS, a.shape[0]), (COUNTS, len(data)), (FORMAT, 3 if a.dtype.kind == "f" else 1)]
            start = f.tell() + 2 + 12 * len(tags) + 4
            f.write(struct.pack("<H", len(tags)))
            for tag, value in tags:
                f.write(struct.pack("<HHII", tag, 4, 1, start if tag == OFFSETS else value))
            end = start + len(data) + len(data) % 2
            f.write(struct.pack("<I", end if k < len(pages) - 1 else 0) + data + b"\0" * (len(data) % 2))

"""Workspace files of R (save, saveRDS) as DataFrames, read by Spark: one task a file.

The serialisation is R's own binary one (versions 2 and 3, big-endian), plain or packed by gzip, bzip2 or xz; a saved workspace is a list of named
objects behind a magic line. Of what it can hold, vectors (logical, integer, real, string), factors, lists, data frames and matrices with their names are
understood; other kinds (closures, environments) are an error that names them. A data frame gives a row each with its columns, a matrix ``id`` (row name or number) and
``x``, a named vector ``id`` and ``value``.

Defined cases: NA is null, also where a factor has no level; NaN and infinities of reals stay. Rows of no columns, and a file without the object, are an
error. Texts are UTF-8. Files are of 2 GB at most, as Spark's reader of whole files says. All files must have the same columns.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the format: kinds of objects, flags, and what stands for NA.
NIL, SYMBOL, PAIRS, CHARS, LOGICAL, INTEGER, REAL, STRINGS, LIST = 0, 1, 2, 9, 10, 13, 14, 16, 19
ALTREP, EMPTY_ENV, BASE_ENV, GLOBAL_ENV, NIL_VALUE, REFERENCE = 238, 242, 241, 253, 254, 255
OBJECT_FLAG, ATTRIBUTE_FLAG, TAG_FLAG = 1 << 8, 1 << 9, 1 << 10
NA_INTEGER = -(1 << 31)
NA_REAL = 1954  # the low word of a NaN


@dataclass
class Value:
    """A vector (numpy with a mask of what is present, or a list) and its attributes."""

    data: object
    attributes: dict = field(default_factory=dict)


class Reader:
    def __init__(self, raw: bytes):
        raw = unpacked(raw)
        self.names = raw[:5] in (b"RDX2\n", b"RDX3\n")
        self.f = io.BytesIO(raw[5:] if self.names else raw)
        if self.f.read(2) != b"X\n":
            raise ValueError("this isn't a binary (big-endian) serialisation")
        version, _, _ = self.ints(3)
        if version not in (2, 3):
            raise ValueError(f"serialisation of version {version}")
        if version == 3:
            self.f.read(self.ints(1)[0])  # the encoding's name
        self.held: list = []  # symbols, by the order in which they came

    def ints(self, n: int) -> tuple[int, ...]:
        return struct.unpack(f">{n}i", self.f.read(4 * n))

    def length(self) -> int:
        n = self.ints(1)[0]
        if n == -1:
            high, low = struct.unpack(">II", self.f.read(8))
            return high << 32 | low
        return n

    def value(self):
        flags = self.ints(1)[0]
        kind = flags & 255
        if kind in (NIL, NIL_VALUE, EMPTY_ENV, BASE_ENV, GLOBAL_ENV):
            return None
        if kind == REFERENCE:
            return self.held[((flags >> 8) or self.ints(1)[0]) - 1]
        if kind == SYMBOL:
            name = self.value()
            self.held.append(name)
            return name
        if kind == CHARS:
            n = self.ints(1)[0]
            return None if n == -1 else self.f.read(n).decode("utf-8", "replace")
        if kind == PAIRS:
            items = list(self.pairs(flags))
            return dict(items) if all(name is not None for name, _ in items) else [v for _, v in items]
        if kind == ALTREP:
            return self.compact()
        if kind in (LOGICAL, INTEGER):
            data = np.frombuffer(self.f.read(4 * (n := self.length())), ">i4", n).astype(np.int32)
            got = Value(np.ma.array(data, mask=data == NA_INTEGER))
        elif kind == REAL:
            bits = np.frombuffer(self.f.read(8 * (n := self.length())), ">u8", n).astype(np.uint64)
            real = bits.view(np.float64)
            got = Value(np.ma.array(real, mask=np.isnan(real) & ((bits & np.uint64(0xFFFFFFFF)) == NA_REAL)))
        elif kind in (STRINGS, LIST):
            got = Value([self.value() for _ in range(self.length())])
        else:
            raise ValueError(f"objects of kind {kind} aren't read")
        if kind == LOGICAL:
            got.data = got.data.astype(bool)
        if flags & ATTRIBUTE_FLAG:
            got.attributes = self.value() or {}
        return got

    def pairs(self, flags: int) -> Iterator[tuple]:
        while flags & 255 == PAIRS:
            if flags & ATTRIBUTE_FLAG:
                self.value()
            name = self.value() if flags & TAG_FLAG else None
            yield name, self.value()
            flags = self.ints(1)[0]
        if flags & 255 not in (NIL, NIL_VALUE):
            raise ValueError("a list of pairs ends in something else")

    def compact(self):
        """Sequences and wrapped vectors that the writer kept in a short form."""
        info, state, attributes = self.value(), self.value(), self.value()
        name = info[0] if isinstance(info, list) and isinstance(info[0], str) else ""
        first = state[0] if isinstance(state, list) else state.data[0] if isinstance(state, Value) and isinstance(state.data, list) else None
        if name in ("compact_intseq", "compact_realseq"):
            n, start, step = (float(v) for v in state.data)
            data = start + step * np.arange(int(n))
            got = Value(np.ma.array(data.astype(np.int32) if name == "compact_intseq" else data))
        elif name.startswith("wrap_"):
            got = first
        elif name == "deferred_string":
            got = Value([None if v is np.ma.masked else f"{v:.15g}" for v in first.data])
        else:
            raise ValueError(f"vectors kept as {name} aren't read")
        got.attributes = attributes or got.attributes
        return got

    def objects(self) -> dict:
        """name -> object of a workspace; one object under the empty name of any other file."""
        got = self.value()
        return got if self.names else {"": got}


def unpacked(raw: bytes) -> bytes:
    for magic, how in ((b"\x1f\x8b", gzip), (b"BZh", bz2), (b"\xfd7zXZ", lzma)):
        if raw.startswith(magic):
            return how.decompress(raw)
    return raw


def column(v: Value) -> pa.Array:
    """A vector as an Arrow array: a factor by its levels, whole numbers as int, reals as double."""
    levels = v.attributes.get("levels")
    if levels is not None:
        names = levels.data
        return pa.array([None if x is np.ma.masked else names[int(x) - 1] for x in v.data], pa.string())
    if isinstance(v.data, list):
        if any(isinstance(x, Value) for x in v.data):
            raise ValueError("a column of lists isn't read")
        return pa.array(v.data, pa.string())
    return pa.array(np.ma.getdata(v.data), mask=np.ma.getmaskarray(v.data))


def named(names: Value | None, n: int) -> pa.Array:
    return pa.array([str(i + 1) for i in range(n)] if names is None else column(names).to_pylist(), pa.string())


def as_table(v: Value) -> pa.Table:
    if not isinstance(v, Value):
        raise ValueError("the object isn't a vector, matrix or data frame")
    a = v.attributes
    kinds = a["class"].data if "class" in a else []
    if "data.frame" in kinds:
        cols = [column(c) for c in v.data]
        if not cols:
            raise ValueError("a data frame without columns")
        rows = a.get("row.names")
        if rows is not None and isinstance(rows.data, list):  # names, not the numbers that stand for none
            return pa.table([named(rows, len(cols[0])), *cols], ["id", *a["names"].data])
        return pa.table(cols, list(a["names"].data))
    if "dim" in a and len(a["dim"].data) == 2:
        n, d = (int(x) for x in a["dim"].data)
        filled = np.ma.filled(v.data.astype(float), np.nan).reshape(d, n).T
        missing = np.ma.getmaskarray(v.data).reshape(d, n).T
        flat = pa.array(np.ascontiguousarray(filled).ravel(), pa.float64(), mask=np.ascontiguousarray(missing).ravel())
        names = (a["dimnames"].data if "dimnames" in a else [None])[0]
        return pa.table([named(names, n), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), flat)], ["id", "x"])
    one = column(v)
    return pa.table([named(a.get("names"), len(one)), one], ["id", "value"])


def object_of(raw: bytes, name: str | None) -> pa.Table:
    found = Reader(raw).objects()
    if name is None:
        if len(found) != 1:
            raise ValueError(f"name one of the objects: {', '.join(map(str, found))}")
        name = next(iter(found))
    if name not in found:
        raise ValueError(f"no object {name}; there are {', '.join(map(str, found))}")
    return as_table(found[name])


def objects(spark: SparkSession, path: str) -> DataFrame:
    """path, name, columns of every object that can be read as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for name, v in Reader(raw.as_py()).objects().items():
                    try:
                        rows.append((where, name, as_table(v).column_names))
                    except ValueError:
                        continue
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 3, (pa.string(), pa.string(), pa.list_(pa.string())))], ["path", "name", "columns"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, name string, columns array<string>")


KINDS = {pa.string(): "string", pa.int32(): "int", pa.float64(): "double", pa.bool_(): "boolean", pa.list_(pa.float64()): "array<double>"}


def read(spark: SparkSession, path: str, name: str | None = None, rows: int = 10_000) -> DataFrame:
    """The rows of an object in all files that ``path`` names. The schema is that of the first file; a task gives ``rows`` rows at a time."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                t = object_of(raw.as_py(), name)
                yield pa.RecordBatch.from_arrays([pa.array(t.column_names), pa.array([KINDS[f.type] for f in t.schema])], ["name", "kind"])

    first = files.limit(1).mapInArrow(shape, "name string, kind string").collect()
    if not first:
        raise ValueError(f"no files at {path}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                yield from object_of(raw.as_py(), name).combine_chunks().to_batches(max_chunksize=rows)

    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    return files.mapInArrow(run, ", ".join(f"{quoted(r['name'])} {r['kind']}" for r in first))

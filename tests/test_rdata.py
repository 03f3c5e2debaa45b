"""Workspace files, written here byte by byte from the format's description."""

import bz2
import gzip
import lzma
import struct

import numpy as np
import pytest

from strandline.sources import rdata
from strandline.sources.matrices import validated


class Writer:
    """Just enough of the format: vectors with attributes, lists of pairs, symbols by reference."""

    def __init__(self, version=2):
        self.out, self.symbols = b"X\n" + struct.pack(">3i", version, 0x030500, 0x020300), []
        if version == 3:
            self.out += struct.pack(">i", 5) + b"UTF-8"

    def ints(self, *v):
        self.out += struct.pack(f">{len(v)}i", *v)

    def chars(self, text):
        self.ints(9 | 1 << 12, -1) if text is None else self.ints(9 | 1 << 14, len(text.encode()))
        self.out += (text or "").encode()

    def symbol(self, name):
        if name in self.symbols:
            self.ints(255 | (self.symbols.index(name) + 1) << 8)
        else:
            self.symbols.append(name)
            self.ints(1)
            self.chars(name)

    def pairs(self, items):
        for name, v in items.items():
            self.ints(2 | 1 << 10)
            self.symbol(name)
            self.write(*v) if isinstance(v, tuple) else self.write(v)
        self.ints(254)

    def write(self, v, attributes=None):
        flag = 1 << 9 if attributes else 0
        if isinstance(v, dict):
            return self.pairs(v)
        if v is None:
            return self.ints(254)
        if isinstance(v, np.ndarray):
            kind = {"b": 10, "i": 13, "f": 14}[v.dtype.kind]
            self.ints(kind | flag, len(v))
            self.out += v.astype(">f8" if kind == 14 else ">i4").tobytes()
        elif all(x is None or isinstance(x, str) for x in v):
            self.ints(16 | flag, len(v))
            for x in v:
                self.chars(x)
        else:
            self.ints(19 | flag, len(v))
            for x in v:
                self.write(*x) if isinstance(x, tuple) else self.write(x)
        if attributes:
            self.pairs(attributes)
        return None


def frame_of(k):
    na = struct.unpack(">d", struct.pack(">II", 0x7FF00000, 1954))[0]
    cols = [np.array([1.5, na, np.nan, np.inf]), ["é", None, "", f"file{k}"], (np.array([2, 1, -(1 << 31), 2], np.int32), {"levels": ["alpha", "beta"], "class": ["factor"]}), np.array([1, -(1 << 31), 3, k], np.int32), np.array([True, False, True, True])]
    return cols, {"names": ["num", "text", "type", "whole", "yes"], "class": ["data.frame"], "row.names": np.array([-(1 << 31), -4], np.int32)}


def workspace(objects, version=2):
    w = Writer(version)
    w.pairs(objects)
    return f"RDX{version}\n".encode() + w.out


@pytest.mark.parametrize("pack, version", [(gzip.compress, 2), (bz2.compress, 3), (lzma.compress, 3), (bytes, 2)])
def test_data_frames_of_several_files(spark, tmp_path, pack, version):
    for k in range(3):
        (tmp_path / f"part{k}.rdata").write_bytes(pack(workspace({"cells": frame_of(k), "other": np.array([1.0])}, version)))
    got = rdata.read(spark, f"{tmp_path}/*.rdata", "cells")
    assert got.dtypes == [("num", "double"), ("text", "string"), ("type", "string"), ("whole", "int"), ("yes", "boolean")]
    rows = sorted(got.collect(), key=lambda r: (r["text"] is None, r["text"], r["whole"]))
    assert len(rows) == 12 and {r["text"] for r in rows} == {"é", None, "", "file0", "file1", "file2"}
    lone = next(r for r in rows if r["text"] == "file2")
    assert lone["num"] == np.inf and lone["type"] == "beta" and lone["whole"] == 2 and lone["yes"]
    assert all(r["num"] is None and r["whole"] is None and r["type"] == "alpha" for r in rows if r["text"] is None)
    assert all(np.isnan(r["num"]) and r["type"] is None for r in rows if r["text"] == "")
    assert {(r["name"], tuple(r["columns"])) for r in rdata.objects(spark, str(tmp_path)).collect()} == {("cells", ("num", "text", "type", "whole", "yes")), ("other", ("id", "value"))}


def test_matrices_and_named_vectors(spark, tmp_path):
    x = np.arange(6.0).reshape(3, 2)
    dims = {"dim": np.array([3, 2], np.int32), "dimnames": [["a", "b", "c"], ["f1", "f2"]]}
    (tmp_path / "w.rdata").write_bytes(workspace({"Loadings": (x.T.ravel(), dims), "metric": (np.array([0.5, 0.25]), {"names": ["a", "b"]}), "bare": (x.T.ravel(), {"dim": dims["dim"]})}))
    got = validated(rdata.read(spark, str(tmp_path / "w.rdata"), "Loadings"))
    assert {r["id"]: r["x"] for r in got.collect()} == {"a": [0.0, 1.0], "b": [2.0, 3.0], "c": [4.0, 5.0]}
    assert {tuple(r) for r in rdata.read(spark, str(tmp_path / "w.rdata"), "metric").collect()} == {("a", 0.5), ("b", 0.25)}
    assert {r["id"] for r in rdata.read(spark, str(tmp_path / "w.rdata"), "bare", rows=2).collect()} == {"1", "2", "3"}
    with pytest.raises(Exception, match="no object"):
        rdata.read(spark, str(tmp_path / "w.rdata"), "absent")
    with pytest.raises(Exception, match="name one of"):
        rdata.read(spark, str(tmp_path / "w.rdata"))
    w = Writer()
    w.write(np.array([3.0, 4.0]))
    (tmp_path / "one.rds").write_bytes(gzip.compress(w.out))
    assert [tuple(r) for r in rdata.read(spark, str(tmp_path / "one.rds")).orderBy("id").collect()] == [("1", 3.0), ("2", 4.0)]


def test_short_forms_and_what_is_not_read():
    w = Writer(3)
    w.ints(238)  # a compact sequence: 3, 5, 7
    w.ints(2)
    w.symbol("compact_intseq")
    w.ints(2)
    w.symbol("base")
    w.ints(2)
    w.write(np.array([13], np.int32))
    w.ints(254)
    w.write(np.array([3.0, 3.0, 2.0]))
    w.ints(254)
    assert rdata.object_of(w.out, None)["value"].to_pylist() == [3, 5, 7]
    bad = Writer()
    bad.ints(3)
    with pytest.raises(ValueError, match="kind 3"):
        rdata.Reader(bad.out).objects()
    with pytest.raises(ValueError, match="binary"):
        rdata.Reader(b"A\n1")

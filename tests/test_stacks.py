"""Stacks of gray images: pages come back, unwanted pages stay unread, other kinds are refused."""

import numpy as np
import pytest

from weftline.sources import stacks, tables


@pytest.fixture(scope="module")
def stack(tmp_path_factory):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 256, (5, 7)).astype("u1"), rng.integers(0, 65536, (4, 3)).astype("u2"), rng.normal(size=(2, 6)).astype("f4")]
    path = str(tmp_path_factory.mktemp("stack") / "s.tif")
    stacks.write_stack(path, pages)
    return path, pages


def test_pages_come_back(spark, stack):
    path, pages = stack
    got = stacks.read_stack(spark, path, run=1)
    assert got.rdd.getNumPartitions() == 3 and stacks.read_stack(spark, path).rdd.getNumPartitions() == 1
    want = sorted((k + 1, y, x, float(a[y, x])) for k, a in enumerate(pages) for y in range(a.shape[0]) for x in range(a.shape[1]))
    assert sorted(map(tuple, got.collect())) == want


def test_only_wanted_pages_are_read(spark, stack, tmp_path):
    path, pages = stack
    data = open(path, "rb").read()
    first = stacks.pages_of(path)[0].strips[0][0]
    cut = tmp_path / "cut.tif"  # the last page's pixels are missing
    cut.write_bytes(data[:stacks.pages_of(path)[2].strips[0][0]])
    assert first > 0
    assert stacks.read_stack(spark, str(cut), run=1).where("frame in (1, 2)").count() == 35 + 12
    assert stacks.read_stack(spark, str(cut), run=1).where("frame < 2 and v >= 0").count() == 35
    assert stacks.read_stack(spark, str(cut), run=1).where("frame = 9").count() == 0
    with pytest.raises(Exception):
        stacks.read_stack(spark, str(cut), run=1).where("frame = 3").collect()


def test_big_endian_and_inverted(spark, tmp_path):
    import struct

    v = (np.arange(6).reshape(2, 3) * 1000).astype(">u2")
    tags = [(256, 3, 3), (257, 3, 2), (258, 3, 16), (259, 3, 1), (262, 3, 0), (273, 4, 8 + 2 + 7 * 12 + 4), (279, 4, 12)]
    data = struct.pack(">2sHIH", b"MM", 42, 8, len(tags))
    for tag, kind, value in tags:
        data += struct.pack(">HHI", tag, kind, 1) + (struct.pack(">HH", value, 0) if kind == 3 else struct.pack(">I", value))
    (tmp_path / "m.tif").write_bytes(data + struct.pack(">I", 0) + v.tobytes())
    got = {(r.y, r.x): r.v for r in stacks.read_stack(spark, str(tmp_path / "m.tif")).collect()}
    assert got == {(y, x): 65535.0 - float(v[y, x]) for y in range(2) for x in range(3)}


@pytest.mark.parametrize("pages", [[np.zeros((2, 2), "u4")], [np.zeros((2, 2), "f8")], [np.zeros((2, 2), "u1"), np.zeros((2, 2), "i2").view("u2").astype("u8")]])
def test_other_types_are_refused(tmp_path, pages):
    path = str(tmp_path / "x.tif")
    stacks.write_stack(path, pages)
    with pytest.raises(ValueError, match="only gray images"):
        stacks.pages_of(path)
    (tmp_path / "no.tif").write_bytes(b"GIF89a..")
    with pytest.raises(ValueError, match="isn't a TIFF"):
        stacks.pages_of(str(tmp_path / "no.tif"))


def test_pixels_written_come_back(spark, stack, tmp_path):
    p = stacks.read_stack(spark, stack[0])
    tables.write_pixels(p, str(tmp_path / "out"))
    back = tables.read_pixels(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, p.collect())) and back.schema == tables.PIXELS

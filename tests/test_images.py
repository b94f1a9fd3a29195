import os
import struct
import zlib

import numpy as np
import pytest

from tests.test_panorama import H, W, lens, level
from tidewell.operators import images, panorama


def decoded(data):
    """Pixels of a PNG whose rows are differences to the row above."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, parts = 8, {}
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        parts[kind], at = body, at + 12 + n
    width, height, depth, colour = struct.unpack(">IIBB", parts[b"IHDR"][:10])
    lines = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(height, -1)
    assert depth == 8 and (lines[:, 0] == 2).all()
    rows = np.cumsum(lines[:, 1:], axis=0, dtype=np.uint8)
    return rows.reshape((height, width, 3) if colour == 2 else (height, width))


def test_png_keeps_every_pixel():
    draw = np.random.default_rng(1)
    for shape in ((5, 7, 3), (1, 1, 3), (4, 9)):
        picture = draw.integers(0, 256, shape).astype(np.uint8)
        assert (decoded(images.png(picture)) == picture).all()


def test_frames_appear_whole_or_not_at_all(spark, tmp_path):
    picture = np.arange(24, dtype=np.uint8)
    rows = lambda *r: spark.createDataFrame(list(r), "name string, rgb binary")
    target = str(tmp_path / "frames")
    found = images.write_frames(rows(("a.png", picture.tobytes()), ("b.png", picture[::-1].tobytes())), "name", "rgb", 4, 2, target)
    got = {r["name"]: r["size"] for r in found.collect()}
    assert sorted(n for n in os.listdir(target) if n.endswith(".png")) == ["a.png", "b.png"] and got["a.png"] == os.path.getsize(f"{target}/a.png")
    assert (decoded((tmp_path / "frames" / "b.png").read_bytes()).ravel() == picture[::-1]).all()
    with pytest.raises(FileExistsError):
        images.write_frames(rows(("a.png", picture.tobytes())), "name", "rgb", 4, 2, target)
    other = str(tmp_path / "other")
    for bad, why in ((("c.png", None), "pixels"), (("c.png", b"1"), "pixels"), ((None, picture.tobytes()), "name"), (("../c.png", picture.tobytes()), "name"), (("a.png", picture.tobytes()), "duplicate")):
        with pytest.raises(ValueError, match=why):
            images.write_frames(rows(("a.png", picture.tobytes()), bad), "name", "rgb", 4, 2, other)
        assert sorted(os.listdir(tmp_path)) == ["frames"]
    assert images.write_frames(rows().limit(0), "name", "rgb", 4, 2, other).count() == 0 and os.path.isdir(other)


def test_pictures_of_the_seam():
    found = panorama.inspected([lens(0), lens(1)], [level(90, 90, 90), level(110, 110, 110)], W, H)
    assert (found["mask_0"] == 255).all() and (found["lens_0"][0] == 90).all() and (found["lens_0"][-1] == 0).all() and (found["lens_1"][-1] == 110).all()
    own = found["ownership"]
    assert (own[0] == (255, 0, 0)).all() and (own[-1] == (0, 255, 0)).all() and (abs(own[31:33].astype(int).sum(axis=-1) - 255) <= 1).all()
    blocked = panorama.inspected([lens(0), lens(1)], [level(90, 90, 90)] * 2, W, H, masks=(np.zeros((200, 200)), np.ones((200, 200))))
    assert (blocked["ownership"][0] == (0, 0, 255)).all() and (blocked["mask_0"] == 0).all() and not blocked["detail"][..., 0].any()

import struct
import zlib

import numpy as np
import pytest

from basketlens.operators import features
from basketlens.sources import packed
from tests.conftest import write_picture


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(width, height, depth, colour, lines, *extra, interlaced=0):
    """A file of scan lines that start with their filter."""
    header = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)
    return packed.PNG + chunk(b"IHDR", header) + b"".join(extra) + chunk(b"IDAT", zlib.compress(bytes(lines))) + chunk(b"IEND", b"")


def filtered(pixels, kind):
    """Lines of 8-bit samples with one filter, by the definition of each."""
    height, width, step = pixels.shape
    rows = pixels.reshape(height, -1).astype(int)
    out = []
    for y in range(height):
        line = [kind]
        for x in range(width * step):
            a = rows[y, x - step] if x >= step else 0
            b = rows[y - 1, x] if y else 0
            c = rows[y - 1, x - step] if y and x >= step else 0
            paeth = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            line.append((rows[y, x] - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        out += line
    return out


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("colour, samples", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_filters_and_colours(kind, colour, samples):
    pixels = np.random.default_rng(kind).integers(0, 256, (7, 5, samples)).astype(np.uint8)
    assert (packed.decode(png(5, 7, 8, colour, filtered(pixels, kind))) == pixels).all()


def test_depths_and_palettes():
    assert packed.decode(png(5, 2, 1, 0, [0, 0b10110000, 0, 0b01001000]))[:, :, 0].tolist() == [[255, 0, 255, 255, 0], [0, 255, 0, 0, 255]]
    assert packed.decode(png(3, 1, 4, 0, [0, 0x0F, 0x80]))[:, :, 0].tolist() == [[0, 255, 136]]
    assert packed.decode(png(2, 1, 16, 0, [0, 1, 2, 3, 4]))[:, :, 0].tolist() == [[1, 3]]
    palette = chunk(b"PLTE", bytes([1, 2, 3, 4, 5, 6]))
    assert packed.decode(png(2, 1, 8, 3, [0, 1, 0], palette)).tolist() == [[[4, 5, 6], [1, 2, 3]]]


@pytest.mark.parametrize(
    "blob, why",
    [
        (None, "empty"),
        (b"", "empty"),
        (b"GIF89a", "unknown format"),
        (packed.PNG, "truncated"),
        (png(2, 1, 8, 0, [0, 1, 2])[:50], "truncated"),
        (png(2, 1, 8, 0, [0, 1]), "truncated"),
        (png(2, 1, 8, 0, [7, 1, 2]), "filter"),
        (png(0, 1, 8, 0, [0]), "header"),
        (png(2, 1, 5, 0, [0, 1, 2]), "header"),
        (png(1 << 20, 1 << 20, 8, 0, [0]), "too large"),
        (png(1, 1, 8, 0, [0, 1], interlaced=1), "interlaced"),
        (png(1, 1, 8, 3, [0, 9], chunk(b"PLTE", bytes(3))), "palette"),
        (png(2, 1, 8, 0, [0, 1, 2]).replace(b"IDAT", b"IDAU"), "checksum"),
        (packed.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", b"junk"), "damaged"),
        (packed.JPEG + b"x", "JPEG"),
    ],
)
def test_what_cannot_be_decoded_says_why(blob, why):
    with pytest.raises(packed.Undecodable, match=why):
        packed.decode(blob)


def test_packed_files_equal_files_in_folders(spark, tmp_path):
    """Files that another encoder wrote, their statistics, and a count of what failed."""
    rows = []
    for i, rgb in enumerate((0x333333, 0xFF8000, 0x0102FE)):
        write_picture(spark, tmp_path / f"{i}.png", 7, 6, rgb, kind="png")
        rows.append((f"{i}", (tmp_path / f"{i}.png").read_bytes()))
    rows += [("none", None), ("text", b"no picture at all"), ("half", rows[0][1][:45])]
    table = spark.createDataFrame(rows, "path string, content binary")
    images = packed.read_packed(table)
    got = {r["image_path"]: (r["image_mean"], r["image_std"]) for r in features.image_stats(images, "image_path").collect()}
    for name, rgb in (("0", (51, 51, 51)), ("1", (255, 128, 0)), ("2", (1, 2, 254))):
        values = np.tile(rgb, 42)
        assert got[name] == pytest.approx((values.mean(), values.std()))
    assert got["none"] == got["text"] == got["half"] == (None, None)
    report = {r["outcome"]: r["images"] for r in packed.decoding_report(images).collect()}
    assert report == {"decoded": 3, "empty": 1, "unknown format": 1, "truncated": 1}

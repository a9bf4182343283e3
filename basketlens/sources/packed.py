"""Images packed into a table of (path, bytes), decoded on the executors.

A row per image beats a file per image: nothing is listed on the driver, and a scan reads large
files. PNG is decoded here. JPEG needs a decoder that the workers may have (Pillow); its CMYK form has
four channels, of which features use the first three. What cannot be decoded keeps its row, with the reason.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructType

# How the formats begin, and samples per pixel of the PNG colour types.
PNG = b"\x89PNG\r\n\x1a\n"
JPEG = b"\xff\xd8\xff"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
# Pixels of one image; a forged header must not ask for more memory than a worker has.
MOST_PIXELS = 1 << 27
DECODED = (
    StructType().add("height", IntegerType()).add("width", IntegerType()).add("nChannels", IntegerType())
    .add("data", BinaryType()).add("reason", StringType())
)


class Undecodable(ValueError):
    """Bytes that are no image this worker can read; the message says why."""


def _chunks(blob: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(PNG)
    while at + 8 <= len(blob):
        size, kind = struct.unpack(">I4s", blob[at : at + 8])
        body = blob[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(blob):
            raise Undecodable("truncated")
        if zlib.crc32(kind + body) != struct.unpack(">I", blob[at + 8 + size : at + 12 + size])[0]:
            raise Undecodable("checksum")
        yield kind, body
        at += 12 + size


def _unfiltered(raw: np.ndarray, filters: np.ndarray, step: int) -> np.ndarray:
    """Scan lines from the differences they are stored as; ``step`` is the distance to the pixel on the left."""
    lines = np.zeros_like(raw)
    above = np.zeros(raw.shape[1], np.uint8)
    for y, kind in enumerate(filters):
        if kind == 0:
            lines[y] = raw[y]
        elif kind == 1:
            for c in range(step):
                lines[y, c::step] = np.cumsum(raw[y, c::step], dtype=np.uint8)
        elif kind == 2:
            lines[y] = raw[y] + above
        elif kind in (3, 4):
            line, up, delta = [0] * step + [0] * raw.shape[1], [0] * step + above.tolist(), raw[y].tolist()
            for x, d in enumerate(delta):
                left, top, corner = line[x], up[x + step], up[x]
                line[x + step] = (d + ((left + top) // 2 if kind == 3 else _nearest(left, top, corner))) & 255
            lines[y] = line[step:]
        else:
            raise Undecodable("filter")
        above = lines[y]
    return lines


def _nearest(left: int, top: int, corner: int) -> int:
    """Of three neighbours the one that a linear continuation comes closest to."""
    guess = left + top - corner
    a, b, c = abs(guess - left), abs(guess - top), abs(guess - corner)
    return left if a <= b and a <= c else top if b <= c else corner


def decode_png(blob: bytes) -> np.ndarray:
    """(height, width, channels) of 8-bit samples; deeper samples keep their high byte, palettes become colours."""
    header, palette, data = None, None, []
    for kind, body in _chunks(blob):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
    if header is None or not data:
        raise Undecodable("truncated")
    width, height, depth, colour, _, _, interlaced = header
    if colour not in SAMPLES or depth not in (1, 2, 4, 8, 16) or not width or not height:
        raise Undecodable("header")
    if interlaced:
        raise Undecodable("interlaced")
    if width * height > MOST_PIXELS:
        raise Undecodable("too large")
    bits = SAMPLES[colour] * depth
    line = -(-width * bits // 8)
    plain = zlib.decompressobj().decompress(b"".join(data), height * (line + 1))
    if len(plain) < height * (line + 1):
        raise Undecodable("truncated")
    rows = np.frombuffer(plain, np.uint8, height * (line + 1)).reshape(height, line + 1)
    lines = _unfiltered(rows[:, 1:], rows[:, 0], max(1, bits // 8))
    if depth < 8:
        per_byte = 8 // depth
        shifts = np.arange(8 - depth, -1, -depth)
        lines = ((lines[:, :, None] >> shifts) & ((1 << depth) - 1)).reshape(height, line * per_byte)[:, :width]
        lines = lines.astype(np.uint8) if colour == 3 else (lines * (255 // ((1 << depth) - 1))).astype(np.uint8)
    elif depth == 16:
        lines = lines[:, ::2]
    pixels = lines.reshape(height, width, SAMPLES[colour])
    if colour == 3:
        if palette is None or pixels.max() >= len(palette):
            raise Undecodable("palette")
        pixels = palette[pixels[:, :, 0]]
    return pixels


def decode_jpeg(blob: bytes) -> np.ndarray:
    """By Pillow, if the worker has it; a CMYK image keeps its four channels."""
    try:
        from PIL import Image
    except ImportError:
        raise Undecodable("no JPEG decoder") from None
    try:
        with Image.open(io.BytesIO(blob)) as image:
            pixels = np.asarray(image if image.mode in ("L", "RGB", "CMYK") else image.convert("RGB"))
    except Exception as error:
        raise Undecodable("JPEG") from error
    return pixels.reshape(*pixels.shape[:2], -1)


def decode(blob: bytes | None) -> np.ndarray:
    if not blob:
        raise Undecodable("empty")
    if blob.startswith(PNG):
        try:
            return decode_png(blob)
        except (zlib.error, struct.error, ValueError) as error:
            raise error if isinstance(error, Undecodable) else Undecodable("damaged") from error
    if blob.startswith(JPEG):
        return decode_jpeg(blob)
    raise Undecodable("unknown format")


@F.pandas_udf(DECODED)
def _decoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for blob in batch:
            try:
                pixels = decode(None if blob is None else bytes(blob))
                rows.append((*pixels.shape, pixels.tobytes(), None))
            except Undecodable as error:
                rows.append((-1, -1, -1, b"", str(error)))
        yield pd.DataFrame(rows, columns=["height", "width", "nChannels", "data", "reason"])


def decoded(content: Column) -> Column:
    """The struct of Spark's image source (height, width, nChannels, data) and the ``reason`` if there is no image.

    Samples are in the order of the file. Sizes are -1 where nothing could be decoded.
    """
    return _decoded(content)


def read_packed(packed: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(image_path, image) of every row of a table of packed images."""
    return packed.select(F.col(path).alias("image_path"), decoded(F.col(content)).alias("image"))


def decoding_report(images: DataFrame) -> DataFrame:
    """(outcome, images): how many were decoded, and how many failed for each reason."""
    outcome = F.coalesce(F.col("image.reason"), F.lit("decoded"))
    return images.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("images"))

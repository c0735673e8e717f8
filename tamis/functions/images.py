"""Helpers on image bytes, run inside Arrow batches.

Files are checked for structure; pixels come decoded from Spark's image source as
rows of (origin, height, width, nChannels, mode, data) with channels in BGR order.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions.arrow import once

# File format markers; fixed values.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
JPEG_START = b"\xff\xd8"
JPEG_END = b"\xff\xd9"
JPEG_SCAN = 0xDA
BMP_START = b"BM"


def _png_fault(data: bytes) -> str | None:
    at = len(PNG_SIGNATURE)
    first = True
    while True:
        if at + 12 > len(data):
            return "truncated"
        size = int.from_bytes(data[at : at + 4], "big")
        end = at + 12 + size
        if end > len(data):
            return "truncated"
        kind = data[at + 4 : at + 8]
        if first and kind != b"IHDR":
            return "bad header"
        if zlib.crc32(data[at + 4 : end - 4]) != int.from_bytes(data[end - 4 : end], "big"):
            return "bad checksum"
        if kind == b"IEND":
            return None
        first, at = False, end


def _jpeg_fault(data: bytes) -> str | None:
    """The end marker must follow the header segments, which may hold a whole preview image."""
    at = len(JPEG_START)
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != JPEG_SCAN:
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None if data.find(JPEG_END, at) >= 0 else "truncated"


def _bmp_fault(data: bytes) -> str | None:
    if len(data) < 26:
        return "bad header"
    number = lambda at, size: int.from_bytes(data[at : at + size], "little", signed=size == 4)
    width, height, bits, packed = number(18, 4), abs(number(22, 4)), number(28, 2), number(30, 4)
    if number(14, 4) >= 40 and width > 0 and height > 0 and not packed:
        # Lines of pixels are padded to four bytes; the size field is not to be relied on.
        end = number(10, 4) + (width * bits + 31) // 32 * 4 * height
    else:
        end = number(2, 4)
    return None if end <= len(data) else "truncated"


def fault_of(data: bytes | None) -> str | None:
    """Why a file cannot be a whole image, or None. Bytes after an image's end are no fault.

    This looks at structure only; ``sources.files.decodable`` tells whether files decode.
    """
    if not data:
        return "empty"
    if data.startswith(PNG_SIGNATURE):
        return _png_fault(data)
    if data.startswith(JPEG_START):
        return _jpeg_fault(data)
    if data.startswith(BMP_START):
        return _bmp_fault(data)
    return "unrecognised"


@F.pandas_udf(T.StringType())
def _file_fault(content: pd.Series) -> pd.Series:
    return content.map(fault_of)


def file_fault(content: Column) -> Column:
    return once(_file_fault)(content)


def rgb(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Bytes of one image row as (height, width, 3) in RGB order."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(pixels, 3, axis=2)
    return pixels[:, :, 2::-1]


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize with pixel centres aligned."""
    h, w = image.shape[:2]
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    pixels = image.astype(np.float64)
    top = pixels[y0][:, x0] * (1 - fx) + pixels[y0][:, x1] * fx
    low = pixels[y1][:, x0] * (1 - fx) + pixels[y1][:, x1] * fx
    return top * (1 - fy) + low * fy

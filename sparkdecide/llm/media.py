"""Media columns: Netpbm and BMP images in binary columns, decoded with numpy.

``to_image`` stores any bytes losslessly as the samples of an image, ``decode``
reads binary PGM (P5), binary PPM (P6) and 24-bit BMP files, ``area_resize``
averages areas through an integral image, and ``image_features`` gives a
difference hash and an NPY tile for each image of a column.

Defined results: a null text is an empty text; an empty text gives one padded
row of samples; a null or undecodable image gives null features. Rows are
independent, so repeated rows give equal values; other columns pass through.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .texts import encoded

#: A row of samples: 64 pixels of three bytes.
ROW_BYTES, WIDTH = 192, 64
TILE = 16

STORED = pa.struct([("n_bytes", pa.int64()), ("media", pa.binary())])
FEATURES = pa.struct(
    [
        ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("tile", pa.binary()),
    ]
)
STORED_DDL = "struct<n_bytes:bigint,media:binary>"
FEATURES_DDL = "struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,feature:string,tile:binary>"


def padded(data: bytes) -> bytes:
    """``data`` and spaces up to a positive multiple of ROW_BYTES."""
    return data.ljust(max(1, -(-len(data) // ROW_BYTES)) * ROW_BYTES, b" ")


def to_ppm(payload: bytes) -> bytes:
    return b"P6\n%d %d\n255\n" % (WIDTH, len(payload) // ROW_BYTES) + payload


def to_bmp(payload: bytes) -> bytes:
    """A 24-bit BMP: rows from the bottom up, blue before red, no row padding at this width."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3)
    head = struct.pack("<2sIHHI", b"BM", 54 + len(payload), 0, 0, 54)
    info = struct.pack("<IiiHHIIiiII", 40, WIDTH, len(rows), 1, 24, 0, len(payload), 2835, 2835, 0, 0)
    return head + info + rows[::-1, :, ::-1].tobytes()


def to_image(data: bytes) -> bytes:
    """BMP where the number of rows is even, else PPM: equal bytes give equal files."""
    payload = padded(data)
    return to_bmp(payload) if len(payload) // ROW_BYTES % 2 == 0 else to_ppm(payload)


_NETPBM = re.compile(rb"(P[56])(?:\s+(?:#[^\n]*\n\s*)*)(\d+)(?:\s+(?:#[^\n]*\n\s*)*)(\d+)(?:\s+(?:#[^\n]*\n\s*)*)(\d+)\s")


def decode(media: bytes) -> np.ndarray:
    """Samples as (rows, columns, channels) of uint8. Raises ValueError on other or damaged files."""
    if media[:2] == b"BM":
        if len(media) < 54:
            raise ValueError("short BMP header")
        at, (size, width, height, _, bits, packing) = struct.unpack_from("<I", media, 10)[0], struct.unpack_from("<IiiHHI", media, 14)
        if size < 40 or bits != 24 or packing or width <= 0 or not height:
            raise ValueError("only plain 24-bit BMP is read")
        line = (width * 3 + 3) // 4 * 4
        data = np.frombuffer(media, np.uint8, line * abs(height), at).reshape(abs(height), line)[:, : width * 3]
        image = data.reshape(abs(height), width, 3)[:, :, ::-1]
        return image[::-1] if height > 0 else image
    if m := _NETPBM.match(media):
        width, height, most = int(m[2]), int(m[3]), int(m[4])
        if not (width and height and 0 < most < 256):
            raise ValueError("only 8-bit Netpbm is read")
        channels = 3 if m[1] == b"P6" else 1
        return np.frombuffer(media, np.uint8, width * height * channels, m.end()).reshape(height, width, channels)
    raise ValueError("neither Netpbm nor BMP")


def gray(image: np.ndarray) -> np.ndarray:
    if image.shape[2] == 1:
        return image[:, :, 0].astype(np.float64)
    return image @ np.array([0.299, 0.587, 0.114])


def area_resize(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, taken from an integral image; edges inside a pixel count in part."""
    h, w = plane.shape
    integral = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(plane, 0), 1, out=integral[1:, 1:])

    def along(total: np.ndarray, n: int, parts: int) -> np.ndarray:
        edge = np.arange(parts + 1) * (n / parts)
        low = np.minimum(edge.astype(np.int64), n - 1)
        part = (edge - low)[:, None]
        return total[low] * (1 - part) + total[low + 1] * part

    rows = along(integral, h, height)
    cells = along(rows.T, w, width).T
    return np.diff(np.diff(cells, axis=0), axis=1) * (height * width / (h * w))


def difference_hash(plane: np.ndarray) -> str:
    """64 bits: is each of 8 x 9 area means larger than its left neighbour?"""
    small = np.round(area_resize(plane, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


_NPY_HEAD = b"\x93NUMPY\x01\x00" + struct.pack("<H", 118) + f"{{'descr': '|u1', 'fortran_order': False, 'shape': ({TILE}, {TILE}), }}".encode().ljust(117) + b"\n"


def npy_tile(plane: np.ndarray) -> bytes:
    """A TILE x TILE area-resized plane as the bytes of an NPY file."""
    return _NPY_HEAD + np.clip(np.rint(area_resize(plane, TILE, TILE)), 0, 255).astype(np.uint8).tobytes()


def _store(texts: pa.Array) -> pa.Array:
    data = encoded(texts)
    return pa.StructArray.from_arrays([pa.array([len(d) for d in data], pa.int64()), pa.array([to_image(d) for d in data], pa.binary())], fields=list(STORED))


def _features(media: pa.Array) -> pa.Array:
    out = []
    for m in media.to_pylist():
        try:
            image = decode(m) if m is not None else None
        except ValueError:
            image = None
        if image is None:
            out.append(None)
            continue
        payload, plane = image.tobytes(), gray(image)
        out.append(
            {
                "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]),
                "media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest(), "feature": difference_hash(plane), "tile": npy_tile(plane),
            }
        )
    return pa.array(out, FEATURES)


def stored_image(text: Column) -> Column:
    """struct(n_bytes, media): a text's UTF-8 bytes as an image file."""
    return F.arrow_udf(_store, STORED_DDL)(text)


def image_features(media: Column) -> Column:
    """struct of digests, difference hash and NPY tile of an image file; null if it can't be decoded."""
    return F.arrow_udf(_features, FEATURES_DDL)(media)


def write_images(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Store the texts as images in a table of the shared folder and return a scan of it: id, n_bytes, media."""
    s = df.select(F.col(id_col).alias("doc_id"), stored_image(F.col(text_col)).alias("s"))
    return materialize(s.select("doc_id", "s.n_bytes", "s.media"), "media")


def read_features(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the features of the stored images."""
    f = stored.select("doc_id", "n_bytes", image_features(F.col("media")).alias("f"))
    return f.select("doc_id", "n_bytes", "f.*")


def write_tiles(features: DataFrame) -> DataFrame:
    """Store the features with their NPY tiles and difference hashes as a table of the shared folder and return a scan of it."""
    return materialize(features, "tiles")


def tile_hash(tile: Column) -> Column:
    """Difference hash of a stored NPY tile, as it is read back; null for null."""

    def hashes(tiles: pa.Array) -> pa.Array:
        return pa.array([None if t is None else difference_hash(np.load(io.BytesIO(t)).astype(np.float64)) for t in tiles.to_pylist()], pa.string())

    return F.arrow_udf(hashes, "string")(tile)

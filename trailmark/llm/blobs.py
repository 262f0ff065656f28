"""Several arrays as one compressed value."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def planes(x: np.ndarray) -> np.ndarray:
    """Bytes of equal weight next to each other; compresses numbers that use few of their bits."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.copy()


def joined(planes: np.ndarray, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(dtype).ravel()


def pack_arrays(*arrays: np.ndarray, level: int = 6) -> bytes:
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<2sQ", a.dtype.str[1:].encode(), a.size) for a in arrays)
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack_arrays(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 1 + 10 * data[0]
    for i in range(data[0]):
        kind, size = struct.unpack_from("<2sQ", data, 1 + 10 * i)
        dtype = np.dtype("<" + kind.decode())
        out.append(np.frombuffer(data, dtype, size, at))
        at += size * dtype.itemsize
    return out

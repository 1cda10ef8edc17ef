"""Arrays packed into one binary value, for rows that stand for many small ones in a shuffle."""

from __future__ import annotations

import zlib

import numpy as np


def pack(*arrays: np.ndarray, planes: bool = False) -> bytes:
    """Arrays in one compressed value: their types and lengths, then their bytes; with ``planes``, which suits wide numbers
    that are mostly small, all first bytes, then all second ones."""
    head = ";".join(f"{a.dtype.str},{len(a)},{planes:d}" for a in arrays).encode()
    return zlib.compress(len(head).to_bytes(4, "little") + head + b"".join(_planes(a) if planes else np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def _planes(a: np.ndarray) -> bytes:
    return np.frombuffer(a.tobytes(), np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zlib.decompress(data)
    n = int.from_bytes(raw[:4], "little")
    out, at = [], 4 + n
    for part in raw[4:at].decode().split(";"):
        kind, size, planes = part.split(",")
        wide = np.dtype(kind).itemsize
        if planes == "0":
            out.append(np.frombuffer(raw, np.dtype(kind), int(size), at))
        else:
            held = np.frombuffer(raw, np.uint8, int(size) * wide, at).reshape(wide, -1)
            out.append(np.ascontiguousarray(held.T).reshape(-1).view(kind))
        at += int(size) * wide
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in the narrowest type that holds them."""
    most = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)

"""PNG files: 8-bit grey or colour, written with the plain filter, read with any of the five."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Fixed values of the format: its signature, and the channels of its colour types.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(bgr: np.ndarray, level: int = 6) -> bytes:
    """The file of an image [height, width, 1 or 3] in blue, green, red order."""
    h, w, n = bgr.shape
    rows = np.zeros((h, 1 + w * n), np.uint8)
    rows[:, 1:] = bgr[:, :, ::-1].reshape(h, w * n)
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if n == 1 else 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def unfiltered(rows: np.ndarray, n: int) -> np.ndarray:
    """Samples of rows that begin with the number of their filter."""
    out = np.zeros((len(rows), rows.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for y, row in enumerate(rows):
        kind, x = row[0], row[1:].copy()
        if kind == 1:
            x = x.reshape(-1, n).cumsum(0, dtype=np.uint8).ravel()
        elif kind == 2:
            x += above
        elif kind in (3, 4):
            up = above.astype(np.int64).reshape(-1, n)
            now = x.astype(np.int64).reshape(-1, n)
            left, corner = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for k in range(len(now)):
                if kind == 3:
                    guess = (left + up[k]) // 2
                else:
                    near = left + up[k] - corner
                    a, b, c = abs(near - left), abs(near - up[k]), abs(near - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up[k], corner))
                left, corner = (now[k] + guess) & 255, up[k]
                now[k] = left
            x = now.astype(np.uint8).ravel()
        elif kind:
            raise ValueError(f"unknown filter {kind}")
        out[y] = above = x
    return out


def decode(data: bytes) -> np.ndarray:
    """[height, width, 3] in blue, green, red order; alpha is left out. ValueError for anything but whole 8-bit, plain PNG files."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, head = 8, b"", None
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if len(part) < size or struct.pack(">I", zlib.crc32(kind + part)) != data[at + 8 + size : at + 12 + size]:
            raise ValueError("broken PNG file")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body += part
        elif kind == b"IEND":
            break
        at += 12 + size
    else:
        raise ValueError("PNG file without an end")
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise ValueError("only 8-bit PNG files that are not interlaced")
    w, h, n = head[0], head[1], CHANNELS[head[3]]
    x = unfiltered(np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * n), n).reshape(h, w, n)
    return np.repeat(x[:, :, :1], 3, axis=2) if n < 3 else x[:, :, 2::-1]

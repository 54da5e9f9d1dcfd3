"""PNG files to pixels and back: 8 bits, gray, colour or palette, with or without alpha."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from brindle.raster.jpeg import Unreadable

# Fixed values of the format: its first bytes, and the channels of each colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encoded(pixels: np.ndarray, level: int = 6) -> bytes:
    """A file of gray (height, width) or of blue, green, red (height, width, 3) bytes."""
    a = pixels if pixels.ndim == 2 else pixels[..., ::-1]
    height, width = a.shape[:2]
    rows = np.zeros((height, 1 + a[0].size), np.uint8)  # each row begins with its filter, none
    rows[:, 1:] = a.reshape(height, -1)
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if a.ndim == 2 else 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """Rows without their filters; a sample follows from those `step` before it, above it and both."""
    out = np.zeros((len(rows) + 1, rows.shape[1] - 1), np.uint8)
    for y, row in enumerate(rows, 1):
        kind, line, above = row[0], row[1:], out[y - 1]
        if kind == 0:
            out[y] = line
        elif kind == 1:
            out[y] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            out[y] = line + above
        elif kind in (3, 4):
            made, line, above = [0] * step, line.tolist(), [0] * step + above.tolist()
            for x, v in enumerate(line):
                left, up, corner = made[x], above[x + step], above[x]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    to = left + up - corner
                    guess = min((left, up, corner), key=lambda p: abs(to - p))  # the first of equally near ones
                made.append(v + guess & 255)
            out[y] = made[step:]
        else:
            raise Unreadable("corrupt")
    return out[1:]


def decoded(data: bytes) -> np.ndarray:
    """(height, width) or (height, width, 3) as blue, green, red; alpha is left out."""
    if not data.startswith(SIGNATURE):
        raise Unreadable("no png")
    at, head, packed, palette = len(SIGNATURE), None, [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise Unreadable("truncated")
        if kind == b"IHDR" and size == 13:
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if not head:
        raise Unreadable("corrupt")
    width, height, depth, colour, _, _, laced = head
    if depth != 8 or colour not in CHANNELS or laced or (colour == 3 and palette is None):
        raise Unreadable("unsupported")
    channels, engine = CHANNELS[colour], zlib.decompressobj()
    size = height * (1 + width * channels)
    try:
        raw = engine.decompress(b"".join(packed), size)  # no more than the header promises
    except zlib.error:
        raise Unreadable("corrupt") from None
    if len(raw) < size or not size:
        raise Unreadable("truncated")
    a = _unfiltered(np.frombuffer(raw, np.uint8).reshape(height, -1), channels).reshape(height, width, channels)
    if colour == 3:
        if a.max() >= len(palette):
            raise Unreadable("corrupt")
        a = palette[a[..., 0]]
    return a[..., 0] if channels < 3 and colour != 3 else a[..., 2::-1]

"""JPEG files to pixels and to sizes: sequential and progressive Huffman coding, 8 bits, one or three components."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np


class Unreadable(ValueError):
    """Not a JPEG that is decoded here; the message is a status: 'no jpeg', 'unsupported', 'truncated' or 'corrupt'."""


# Fixed values of the format: frame markers, the order of coefficients, and the integer cosine table that decoders share (13 fractional bits; halves for even and odd places).
SEQUENTIAL, PROGRESSIVE = (0xC0, 0xC1), 0xC2
FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
ALONE = {0x01, *range(0xD0, 0xD9)}
EVEN = np.array([[8192, 10703, 8192, 4433], [8192, 4433, -8192, -10704], [8192, -4433, -8192, 10704], [8192, -10703, 8192, -4433]])
ODD = np.array([[11363, 9633, 6437, 2260], [9633, -2259, -11362, -6436], [6437, -11362, 2261, 9633], [2260, -6436, 9633, -11363]])
RED_CR, BLUE_CB, GREEN_CB, GREEN_CR = (round(x * 65536) for x in (1.402, 1.772, 0.34414, 0.71414))


def _zigzag() -> list[int]:
    order = sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))
    return order + [63] * 16  # a run past the end of a block hits the last place


ZIGZAG = _zigzag()


def _inverse_table() -> np.ndarray:
    out = np.zeros((8, 8))
    for x in range(4):
        out[x, 0::2] = out[7 - x, 0::2] = EVEN[x]
        out[x, 1::2], out[7 - x, 1::2] = ODD[x], -ODD[x]
    return out


INVERSE = _inverse_table()


def segments(read) -> Iterator[tuple[int, int, int]]:
    """(marker, start, end) of each segment's payload up to the first scan, by the lengths that the file gives; read(start, size) gives bytes.

    What an application segment holds is never looked at, whatever markers it may contain.
    """
    at = 0
    if read(0, 2) != b"\xff\xd8":
        raise Unreadable("no jpeg")
    at = 2
    while True:
        head = read(at, 4)
        if len(head) < 2:
            raise Unreadable("truncated")
        if head[0] != 0xFF:
            raise Unreadable("corrupt")
        if head[1] == 0xFF:  # padding before a marker
            at += 1
            continue
        if head[1] in ALONE:
            at += 2
            continue
        if head[1] == 0xD9:
            return
        if len(head) < 4:
            raise Unreadable("truncated")
        size = int.from_bytes(head[2:4], "big")
        if size < 2:
            raise Unreadable("corrupt")
        yield head[1], at + 4, at + 2 + size
        at += 2 + size


def dimensions(read) -> tuple[int, int, int]:
    """(height, width, components) from the frame header, whatever coding follows; nothing after it is read."""
    for marker, start, end in segments(read):
        if marker in FRAMES:
            head = read(start, min(6, end - start))
            if len(head) < 6:
                raise Unreadable("truncated")
            return int.from_bytes(head[1:3], "big"), int.from_bytes(head[3:5], "big"), head[5]
        if marker == 0xDA:
            break
    raise Unreadable("corrupt")


@dataclass
class Component:
    id: int
    h: int
    v: int
    table: int
    wide: int = 0  # its own blocks across and down; stride and rows also count those that fill the last unit
    high: int = 0
    stride: int = 0
    rows: int = 0
    coefficients: list = field(default_factory=list)


@lru_cache(64)
def _codes(table: bytes) -> list[int]:
    """For any 16 bits the length of the code they begin with, times 256, plus its symbol; 0 for none."""
    counts, symbols = table[:16], table[16:]
    out = np.zeros(1 << 16, np.int64)
    code, k = 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[k : k + n]:
            if code >> length:
                raise Unreadable("corrupt")
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | s
            code += 1
        k += n
        code <<= 1
    return out.tolist()


class Bits:
    """A scan's bits between two restarts: for each byte the 64 bits from there on."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff") + bytes(24), np.uint8).astype(np.uint64)
        n = len(raw) - 7
        self.words = sum(raw[k : n + k] << np.uint64(56 - 8 * k) for k in range(8)).tolist()
        self.end = 8 * (n - 17)
        self.at = 0
        self.run = 0  # blocks still to come that end here (progressive)

    def take(self, n: int) -> int:
        p = self.at
        self.at = p + n
        return self.words[p >> 3] >> (64 - (p & 7) - n) & ((1 << n) - 1)

    def code(self, codes: list[int]) -> int:
        p = self.at
        c = codes[self.words[p >> 3] >> (48 - (p & 7)) & 65535]
        if not c:
            raise Unreadable("corrupt")
        self.at = p + (c >> 8)
        return c & 255


def _signed(v: int, n: int) -> int:
    return v if v >> (n - 1) else v - (1 << n) + 1


def _whole_block(c: list[int], base: int, bits: Bits, dc: list[int], ac: list[int], before: int) -> int:
    """All coefficients of a block; gives its first one. Written out, as this is where sequential files spend their time."""
    s = bits.code(dc)
    if s:
        before += _signed(bits.take(s), s)
    c[base] = before
    words, p, k, zigzag = bits.words, bits.at, 1, ZIGZAG
    while k < 64:
        w, o = words[p >> 3], p & 7
        x = ac[w >> (48 - o) & 65535]
        size = x & 15
        o += x >> 8
        if size:
            k += x >> 4 & 15
            v = w >> (64 - o - size) & ((1 << size) - 1)
            c[base + zigzag[k]] = v if v >> (size - 1) else v - (1 << size) + 1
            p = (p & ~7) + o + size
            k += 1
        elif x & 240 == 240:
            p = (p & ~7) + o
            k += 16
        elif x:
            p = (p & ~7) + o
            break
        else:
            raise Unreadable("corrupt")
    bits.at = p
    return before


def _first_pass(c: list[int], base: int, bits: Bits, ac: list[int], start: int, end: int, shift: int) -> None:
    if bits.run:
        bits.run -= 1
        return
    k = start
    while k <= end:
        x = bits.code(ac)
        run, size = x >> 4, x & 15
        if size:
            k += run
            c[base + ZIGZAG[k]] = _signed(bits.take(size), size) << shift
            k += 1
        elif run == 15:
            k += 16
        else:
            bits.run = (1 << run) - 1 + (bits.take(run) if run else 0)
            return


def _later_pass(c: list[int], base: int, bits: Bits, ac: list[int], start: int, end: int, shift: int) -> None:
    """One more bit of each coefficient that isn't 0 yet, and those that become 1 or -1 in it."""
    one = 1 << shift

    def refine(place: int) -> None:
        if bits.take(1) and not abs(c[place]) & one:
            c[place] += one if c[place] > 0 else -one

    k = start
    if not bits.run:
        while k <= end:
            x = bits.code(ac)
            run, size = x >> 4, x & 15
            value = 0
            if size:
                value = one if bits.take(1) else -one
            elif run < 15:
                bits.run = (1 << run) + (bits.take(run) if run else 0)
                break
            while k <= end:
                place = base + ZIGZAG[k]
                if c[place]:
                    refine(place)
                else:
                    if not run:
                        if value:
                            c[place] = value
                        k += 1
                        break
                    run -= 1
                k += 1
    if bits.run:
        for k in range(k, end + 1):
            if c[base + ZIGZAG[k]]:
                refine(base + ZIGZAG[k])
        bits.run -= 1


_SCAN_END = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]", re.S)
_RESTART = re.compile(rb"\xff+[\xd0-\xd7]", re.S)


@dataclass
class Picture:
    height: int = 0
    width: int = 0
    frame: int = 0
    components: list[Component] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    codes: dict[int, bytes] = field(default_factory=dict)  # 0-3 for the first coefficients, 16-19 for the others
    restart: int = 0
    plain_rgb: bool = False

    def define(self, marker: int, data: bytes) -> None:
        if marker == 0xDB:
            while data:
                wide, n = data[0] >> 4, data[0] & 15
                size = 128 if wide else 64
                self.quantisers[n] = np.frombuffer(data[1 : 1 + size], ">u2" if wide else np.uint8).astype(np.int64)
                data = data[1 + size :]
        elif marker == 0xC4:
            while data:
                n = sum(data[1:17])
                self.codes[data[0]] = data[1 : 17 + n]
                data = data[17 + n :]
        elif marker == 0xDD:
            self.restart = int.from_bytes(data[:2], "big")
        elif marker == 0xEE and data[:5] == b"Adobe" and len(data) >= 12:
            self.plain_rgb = data[11] == 0
        elif marker in FRAMES:
            if marker not in (*SEQUENTIAL, PROGRESSIVE) or data[0] != 8 or data[5] not in (1, 3) or self.components:
                raise Unreadable("unsupported")
            self.frame, self.height, self.width = marker, int.from_bytes(data[1:3], "big"), int.from_bytes(data[3:5], "big")
            self.components = [Component(data[k], data[k + 1] >> 4, data[k + 1] & 15, data[k + 2]) for k in range(6, 6 + 3 * data[5], 3)]
            if not self.height or not self.width or not all(0 < c.h <= 4 and 0 < c.v <= 4 for c in self.components):
                raise Unreadable("unsupported")
            if len(self.components) == 1:
                self.components[0].h = self.components[0].v = 1  # a single component has no factors to speak of
            self.most = max(c.h for c in self.components), max(c.v for c in self.components)
            for c in self.components:
                if self.most[0] % c.h or self.most[1] % c.v:
                    raise Unreadable("unsupported")
                across, down = (-(-self.width // (8 * self.most[0])), -(-self.height // (8 * self.most[1])))
                c.wide, c.high = -(-self.width * c.h // (8 * self.most[0])), -(-self.height * c.v // (8 * self.most[1]))
                c.stride, c.rows = across * c.h, down * c.v
                c.coefficients = [0] * (64 * c.stride * c.rows)

    def scan(self, head: bytes, data: bytes) -> None:
        n = head[0]
        by_id = {c.id: c for c in self.components}
        chosen = [(by_id[head[1 + 2 * k]], head[2 + 2 * k] >> 4, head[2 + 2 * k] & 15) for k in range(n)]
        start, end, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
        if end > 63 or (self.frame == PROGRESSIVE and start > end):
            raise Unreadable("corrupt")
        if n == 1:
            c = chosen[0][0]
            units = [[(0, 64 * (y * c.stride + x))] for y in range(c.high) for x in range(c.wide)]
        else:
            across, down = chosen[0][0].stride // chosen[0][0].h, chosen[0][0].rows // chosen[0][0].v
            units = [
                [(k, 64 * ((y * c.v + j) * c.stride + x * c.h + i)) for k, (c, _, _) in enumerate(chosen) for j in range(c.v) for i in range(c.h)]
                for y in range(down) for x in range(across)
            ]
        parts = _RESTART.split(data) if self.restart else [data]
        step = self.restart or len(units)
        if len(parts) * step < len(units):
            raise Unreadable("truncated")
        table = lambda k: _codes(self.codes[k]) if k in self.codes else None
        dc, ac = [table(d) for _, d, _ in chosen], [table(16 + a) for _, _, a in chosen]
        lists = [c.coefficients for c, _, _ in chosen]
        for part, at in zip(parts, range(0, len(units), step)):
            bits, last = Bits(part), [0] * n
            try:
                for unit in units[at : at + step]:
                    for k, base in unit:
                        if self.frame != PROGRESSIVE:
                            last[k] = _whole_block(lists[k], base, bits, dc[k], ac[k], last[k])
                        elif start == 0:
                            if high:
                                lists[k][base] |= bits.take(1) << low
                            else:
                                s = bits.code(dc[k])
                                last[k] += _signed(bits.take(s), s) if s else 0
                                lists[k][base] = last[k] << low
                        else:
                            (_later_pass if high else _first_pass)(lists[k], base, bits, ac[k], start, end, low)
            except (IndexError, TypeError):  # past the end of the data, or without a table
                raise Unreadable("truncated") from None
            if bits.at > bits.end:
                raise Unreadable("truncated")

    def plane(self, c: Component) -> np.ndarray:
        """Samples of a component: the inverse transform of all blocks by two products with one table, rounded between as decoders agree to do."""
        if c.table not in self.quantisers or len(self.quantisers[c.table]) != 64:
            raise Unreadable("corrupt")
        scale = np.zeros(64, np.int64)
        scale[ZIGZAG[:64]] = self.quantisers[c.table]
        blocks = (np.array(c.coefficients, np.int64).reshape(-1, 64) * scale).reshape(-1, 8, 8)
        # doubles hold these sums exactly
        down = np.floor((blocks.transpose(0, 2, 1).reshape(-1, 8) @ INVERSE.T + 1024) / 2048).reshape(-1, 8, 8).transpose(0, 2, 1)
        out = np.floor((down.reshape(-1, 8) @ INVERSE.T + (1 << 17)) / (1 << 18)).reshape(-1, 8, 8)
        out = np.clip(out + 128, 0, 255).astype(np.int64)
        return out.reshape(c.rows, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(c.rows * 8, c.stride * 8)

    def pixels(self) -> np.ndarray:
        """(height, width) or (height, width, 3) as blue, green, red."""
        planes = []
        for c in self.components:
            own = -(-self.height * c.v // self.most[1]), -(-self.width * c.h // self.most[0])
            planes.append(_stretched(self.plane(c)[: own[0], : own[1]], self.most[1] // c.v, self.most[0] // c.h)[: self.height, : self.width])
        if len(planes) == 1:
            return planes[0].astype(np.uint8)
        if self.plain_rgb or [c.id for c in self.components] == [*b"RGB"]:
            return np.stack(planes[::-1], -1).astype(np.uint8)
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        half = 1 << 15
        red, blue = y + (RED_CR * cr + half >> 16), y + (BLUE_CB * cb + half >> 16)
        return np.clip(np.stack([blue, y + (half - GREEN_CB * cb - GREEN_CR * cr >> 16), red], -1), 0, 255).astype(np.uint8)


def _stretched(a: np.ndarray, down: int, across: int) -> np.ndarray:
    """A plane with fewer samples at full size: double width, with single or double height, by three parts of the nearer and one of the farther sample, else by repeating."""
    if across == 2 and down in (1, 2) and a.shape[1] > 2:
        if down == 2:
            near = np.repeat(a, 2, axis=0)
            far = np.stack([np.vstack([a[:1], a[:-1]]), np.vstack([a[1:], a[-1:]])], 1).reshape(near.shape)
            a = 3 * near + far  # four times too large
        shift, low, high = (4, 8, 7) if down == 2 else (2, 1, 2)
        left, right = np.hstack([a[:, :1], a[:, :-1]]), np.hstack([a[:, 1:], a[:, -1:]])
        out = np.stack([3 * a + left + low >> shift, 3 * a + right + high >> shift], 2)
        return out.reshape(a.shape[0], -1)
    return np.repeat(np.repeat(a, down, axis=0), across, axis=1)


def decoded(data: bytes) -> np.ndarray:
    """The pixels of a whole file; Unreadable, with a status, for what isn't one."""
    picture, at, seen = Picture(), 0, False
    read = lambda start, size: data[at + start : at + start + size]
    try:
        while True:
            nxt = None
            for marker, start, end in segments(read):
                start, end = at + start, at + end
                if end > len(data):
                    raise Unreadable("truncated")
                if marker == 0xDA:
                    if not picture.components:
                        raise Unreadable("corrupt")
                    stop = _SCAN_END.search(data, end)
                    picture.scan(data[start:end], data[end : stop.start() if stop else len(data)])
                    seen, nxt = True, stop.start() if stop else None
                    break
                picture.define(marker, data[start:end])
            if nxt is None:
                break
            # go on behind the scan as behind the first two bytes of a file
            at = nxt - 2
            read = lambda start, size: b"\xff\xd8" if start == 0 else data[at + start : at + start + size]  # noqa: E731, B023
    except (IndexError, KeyError):
        raise Unreadable("corrupt") from None
    if not seen:
        raise Unreadable("truncated")
    return picture.pixels()

"""Intra frames of motion-JPEG: baseline and lossless JPEG images to grey samples.

Baseline (and extended sequential Huffman) frames of 8 bits give their first component, which must be the finest one; lossless frames
must have one component. Everything else (progressive, arithmetic, 12 bits, frames without Huffman tables, several
scans) is refused with a ValueError that names the reason.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Coefficients in the order in which they are stored: along the anti-diagonals, every other one upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_WAVE = np.sqrt(np.where(np.arange(8) == 0, 1, 2) / 8)[:, None] * np.cos((2 * np.arange(8) + 1) * np.arange(8)[:, None] * np.pi / 16)
_SEQUENTIAL, _LOSSLESS = (0xFFC0, 0xFFC1), 0xFFC3


def segments(frame: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, begin, end) of the segments up to the scan's head."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    at, marker = 2, 0
    while marker != 0xFFDA:
        while frame[at : at + 2] == b"\xff\xff":
            at += 1
        marker, size = struct.unpack_from(">HH", frame, at)
        if marker < 0xFF01 or size < 2 or at + 2 + size > len(frame):
            raise ValueError("a JPEG segment is cut off")
        yield marker, at + 4, at + 2 + size
        at += 2 + size


@lru_cache(64)
def _codes(counts: bytes, symbols: bytes) -> list[int]:
    """For every 16 bits ahead: length << 8 | symbol of the code they start with, 0 for none."""
    table, code, at = np.zeros(1 << 16, np.int64), 0, 0
    for length in range(1, 17):
        for symbol in symbols[at : at + counts[length - 1]]:
            table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
            code += 1
        at += counts[length - 1]
        code <<= 1
    return table.tolist()


def _intervals(data: bytes) -> list[bytes]:
    """Coded data up to the next marker, cut at restart markers, without stuffing."""
    end = re.search(rb"\xff[^\x00\xd0-\xd7\xff]", data)
    return [part.replace(b"\xff\x00", b"\xff") for part in re.split(rb"\xff+[\xd0-\xd7]", data[: end.start() if end else len(data)])]


class _Bits:
    def __init__(self, data: bytes) -> None:
        b = np.frombuffer(data + b"\xff\xff\xff\xff", np.uint8).astype(np.int64)
        self.ahead, self.at, self.end = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]).tolist(), 0, 8 * len(data)

    def peek(self) -> int:
        return self.ahead[self.at >> 3] >> (8 - (self.at & 7)) & 0xFFFF

    def symbol(self, codes: list[int]) -> int:
        found = codes[self.peek()]
        self.at += found >> 8
        if not found or self.at > self.end:
            raise ValueError("coded data breaks off")
        return found & 0xFF

    def signed(self, size: int) -> int:
        if not size:
            return 0
        value = self.peek() >> (16 - size)
        self.at += size
        return value if value >> (size - 1) else value - (1 << size) + 1


def decode(frame: bytes) -> np.ndarray:
    """The grey samples (height x width) of a frame."""
    try:
        return _decode(frame)
    except (IndexError, KeyError, struct.error) as e:
        raise ValueError(f"a broken JPEG frame ({type(e).__name__})") from e


def _decode(frame: bytes) -> np.ndarray:
    quant: dict[int, np.ndarray] = {}
    tables: dict[int, list[int]] = {}
    process, restart, shape, parts, scan, end = 0, 0, (0, 0), {}, [], 0
    for marker, a, b in segments(frame):
        end = b
        if marker == 0xFFDB:
            while a < b:
                wide, place = frame[a] >> 4, frame[a] & 15
                quant[place] = np.frombuffer(frame, ">u2" if wide else ">u1", 64, a + 1).astype(np.float64)
                a += 65 + 64 * bool(wide)
        elif marker == 0xFFC4:
            while a < b:
                counts = frame[a + 1 : a + 17]
                tables[frame[a]] = _codes(counts, frame[a + 17 : a + 17 + sum(counts)])
                a += 17 + sum(counts)
        elif marker == 0xFFDD:
            restart = struct.unpack_from(">H", frame, a)[0]
        elif 0xFFC0 <= marker <= 0xFFCF and marker != 0xFFCC:
            if marker not in (*_SEQUENTIAL, _LOSSLESS):
                raise ValueError(f"JPEG process {marker & 15} is neither baseline nor lossless")
            bits, height, width, n = struct.unpack_from(">BHHB", frame, a)
            if bits != 8 or not height or not width:
                raise ValueError("other than 8-bit samples of known size")
            process, shape = marker, (height, width)
            parts = {frame[a + 6 + 3 * i]: (frame[a + 7 + 3 * i] >> 4, frame[a + 7 + 3 * i] & 15, frame[a + 8 + 3 * i]) for i in range(n)}
        elif marker == 0xFFDA:
            scan = [(frame[a + 1 + 2 * i], frame[a + 2 + 2 * i]) for i in range(frame[a])]
            predictor, _, low = struct.unpack_from("3B", frame, a + 1 + 2 * frame[a])
    if not process or len(scan) != len(parts):
        raise ValueError("no image, or one in several scans")
    data = _intervals(frame[end:])
    if process == _LOSSLESS:
        if len(parts) != 1 or restart or low or not 1 <= predictor <= 7:
            raise ValueError("a lossless frame of several components, intervals or shifts")
        return _lossless(_Bits(data[0]), tables[scan[0][1] >> 4], shape, predictor)
    return _baseline(data, [(*parts[c], tables[t >> 4], tables[16 | t & 15]) for c, t in scan], quant, shape, restart)


def _lossless(bits: _Bits, codes: list[int], shape: tuple[int, int], predictor: int) -> np.ndarray:
    height, width = shape
    out, above = np.empty(shape, np.uint8), [0] * width
    for y in range(height):
        row: list[int] = []
        for x in range(width):
            a, b, c = (row[-1] if x else 0), above[x], (above[x - 1] if x else 0)
            if not y:
                guess = a if x else 128
            elif not x:
                guess = b
            else:
                guess = (a, b, c, a + b - c, a + (b - c >> 1), b + (a - c >> 1), a + b >> 1)[predictor - 1]
            row.append(guess + bits.signed(bits.symbol(codes)) & 0xFFFF)
        out[y], above = np.array(row) & 0xFF, row
    return out


def _baseline(data: list[bytes], parts: list[tuple], quant: dict[int, np.ndarray], shape: tuple[int, int], restart: int) -> np.ndarray:
    height, width = shape
    most_h, most_v = max(p[0] for p in parts), max(p[1] for p in parts)
    if (parts[0][0], parts[0][1]) != (most_h, most_v):
        raise ValueError("the first component is not the finest")
    if len(parts) == 1:  # a scan of one component has a block a unit, whatever its sampling
        most_h = most_v = 1
        parts = [(1, 1, *parts[0][2:])]
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    plane = np.zeros((down * most_v, across * most_h, 64))
    unit = 0
    for part in data:
        bits, before = _Bits(part), [0] * len(parts)
        for _ in range(min(restart or across * down, across * down - unit)):
            for k, (h, v, _, dc, ac) in enumerate(parts):
                for i in range(h * v):
                    before[k] += bits.signed(bits.symbol(dc))
                    block = {0: before[k]}
                    at = 1
                    while at < 64:
                        run = bits.symbol(ac)
                        if not run & 15:
                            if run != 0xF0:
                                break
                            at += 16
                            continue
                        at += run >> 4
                        block[at] = bits.signed(run & 15)
                        at += 1
                    if k == 0:
                        own = plane[unit // across * v + i // h, unit % across * h + i % h]
                        own[list(block)] = list(block.values())
            unit += 1
    if unit < across * down:
        raise ValueError("coded data breaks off")
    natural = np.empty_like(plane)
    natural[:, :, ZIGZAG] = plane * quant[parts[0][2]]
    samples = np.einsum("ki,yxkl,lj->yixj", _WAVE, natural.reshape(*plane.shape[:2], 8, 8), _WAVE)
    samples = samples.reshape(plane.shape[0] * 8, plane.shape[1] * 8)[:height, :width]
    return np.clip(np.rint(samples + 128), 0, 255).astype(np.uint8)

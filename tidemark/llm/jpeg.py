"""JPEG frames of motion-JPEG video: baseline and extended sequential DCT (SOF0, SOF1) and lossless (SOF3) files.

Takes any Huffman tables, those of the standard where a frame brings none (as motion JPEG may), any quantisation
tables, sampling factors and restart intervals, 8-bit samples. The result is the first component, the luminance, in grey.
Progressive and arithmetic-coded files are none of motion JPEG's and raise ValueError, as anything broken does.
"""

from __future__ import annotations

import struct

import numpy as np

#: Fixed values (T.81): the zigzag order follows from a rule, the Huffman tables of annex K are counts by length and values.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_ALL = {(0, 0): (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))), (0, 1): (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12)))}
_LUMINANCE = "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a"
_CHROMINANCE = "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"


def _rest(start: str) -> bytes:
    """The values of a table: those that have short codes, then all others of (run, size) in order."""
    first = bytes.fromhex(start)
    pairs = [0x00, 0xF0, *(16 * run + size for run in range(16) for size in range(1, 11))]
    return first + bytes(sorted(set(pairs) - set(first)))


_ALL[1, 0] = (bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]), _rest(_LUMINANCE))
_ALL[1, 1] = (bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]), _rest(_CHROMINANCE))

_k = np.arange(8)
#: The inverse cosine transform of 8 values.
IDCT = np.cos((2 * _k[:, None] + 1) * _k[None, :] * np.pi / 16) * np.where(_k == 0, np.sqrt(0.125), 0.5)


def huffman(counts: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Value and code length by the next 16 bits; length 0 where no code begins so."""
    value, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code = at = 0
    for bits, count in enumerate(counts, 1):
        for v in values[at : at + count]:
            lo = code << (16 - bits)
            if lo + (1 << (16 - bits)) > 1 << 16:
                raise ValueError("a Huffman table is too full")
            value[lo : lo + (1 << (16 - bits))], length[lo : lo + (1 << (16 - bits))] = v, bits
            code += 1
        at += count
        code <<= 1
    return value, length


class Bits:
    """Bits of an entropy-coded segment, ones after its end."""

    def __init__(self, data: bytes):
        self.data, self.at = data.replace(b"\xff\x00", b"\xff") + b"\xff" * 8, 0

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        word = int.from_bytes(self.data[byte : byte + 5], "big")
        return (word >> (40 - (self.at & 7) - n)) & ((1 << n) - 1)

    def symbol(self, table) -> int:
        next_ = self.peek(16)
        n = int(table[1][next_])
        if not n or self.at > 8 * len(self.data):
            raise ValueError("no Huffman code")
        self.at += n
        return int(table[0][next_])

    def extended(self, size: int) -> int:
        """A signed number of `size` extra bits."""
        if not size:
            return 0
        value = self.peek(size)
        self.at += size
        return value if value >> (size - 1) else value - (1 << size) + 1


def parse(data: bytes) -> dict:
    """The frame's kind, size, components and tables, and its entropy-coded segments between restart markers."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, out = 2, {"huffman": dict(_ALL), "quant": {}, "restart": 0, "shape": None}
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("no marker")
        kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind in (0xC0, 0xC1, 0xC3):
            precision, height, width, n = struct.unpack_from(">BHHB", body)
            if precision != 8 or not height or not width or not 1 <= n <= 4:
                raise ValueError("another kind of JPEG")
            out |= {"kind": kind, "shape": (height, width), "parts": [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]}
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("another kind of JPEG")
        elif kind == 0xC4:
            i = 0
            while i + 17 <= len(body):
                counts = body[i + 1 : i + 17]
                out["huffman"][body[i] >> 4, body[i] & 15] = (counts, body[i + 17 : i + 17 + sum(counts)])
                i += 17 + sum(counts)
        elif kind == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                values = np.frombuffer(body[i + 1 : i + 65 + 64 * wide], ">u2" if wide else "u1")
                if len(values) != 64:
                    raise ValueError("a quantisation table is too short")
                out["quant"][body[i] & 15] = values.astype(np.int64)
                i += 65 + 64 * wide
        elif kind == 0xDD:
            out["restart"] = struct.unpack(">H", body[:2])[0]
        elif kind == 0xDA:
            n = body[0]
            out["scan"] = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)}
            out["predictor"] = body[1 + 2 * n]
            break
    if out["shape"] is None:
        raise ValueError("no frame")
    segments, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            segments.append(data[start:])
            break
        mark = data[at + 1]
        if mark == 0 or mark == 0xFF:
            at += 2 if mark == 0 else 1
            continue
        segments.append(data[start:at])
        if not 0xD0 <= mark <= 0xD7:
            break
        at = start = at + 2
    return out | {"segments": segments}


def _lossless(head: dict) -> np.ndarray:
    """One component predicted from its left neighbour, the line above at a line's start."""
    if len(head["parts"]) != 1 or head["predictor"] != 1 or head["restart"]:
        raise ValueError("another kind of lossless JPEG")
    height, width = head["shape"]
    bits, table = Bits(head["segments"][0]), huffman(*head["huffman"][0, head["scan"][head["parts"][0][0]][0]])
    diff = np.fromiter((bits.extended(bits.symbol(table)) for _ in range(height * width)), np.int64, height * width).reshape(height, width)
    diff[0, 0] += 128
    diff[:, 0] = np.cumsum(diff[:, 0])
    return np.cumsum(diff, axis=1).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """Grey samples (height, width) of a JPEG file."""
    head = parse(data)
    if head["kind"] == 0xC3:
        return _lossless(head)
    parts, (height, width) = head["parts"], head["shape"]
    if set(head["scan"]) != {p[0] for p in parts} or min(p[1] for p in parts) < 1 or min(p[2] for p in parts) < 1:
        raise ValueError("another kind of JPEG")
    high_x, high_y = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:  # a scan of one component goes block by block
        parts, high_x, high_y = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    across, down = -(-width // (8 * high_x)), -(-height // (8 * high_y))
    tables = {p[0]: tuple(huffman(*head["huffman"][k, head["scan"][p[0]][k]]) for k in (0, 1)) for p in parts}
    _, fx, fy, quant = parts[0]
    blocks = np.zeros((down * fy, across * fx, 64), np.int64)
    segments, before = iter(head["segments"]), {}
    bits = Bits(next(segments))
    for unit in range(across * down):
        if unit and head["restart"] and unit % head["restart"] == 0:
            bits, before = Bits(next(segments, b"")), {}
        for i, (name, px, py, _) in enumerate(parts):
            direct, alternating = tables[name]
            for k in range(px * py):
                before[name] = before.get(name, 0) + bits.extended(bits.symbol(direct))
                block = np.zeros(64, np.int64) if i else blocks[unit // across * py + k // px, unit % across * px + k % px]
                block[0], at = before[name], 1
                while at < 64:
                    code = bits.symbol(alternating)
                    run, size = code >> 4, code & 15
                    if not size:
                        if run != 15:
                            break
                        at += 16
                        continue
                    at += run
                    if at > 63:
                        raise ValueError("a block is too long")
                    block[at] = bits.extended(size)
                    at += 1
    if quant not in head["quant"]:
        raise ValueError("no quantisation table")
    plain = np.zeros_like(blocks)
    plain[..., ZIGZAG] = blocks * head["quant"][quant]
    samples = IDCT @ plain.reshape(*blocks.shape[:2], 8, 8) @ IDCT.T
    image = np.clip(np.rint(samples + 128), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(8 * blocks.shape[0], 8 * blocks.shape[1])
    # a luminance of fewer samples than another component is spread over its places
    image = image.repeat(high_y // fy, 0).repeat(high_x // fx, 1)
    return image[:height, :width]

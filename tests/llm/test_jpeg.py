"""Baseline motion JPEG by an encoder of its own, lossless JPEG with other tables, and broken files."""

import struct

import numpy as np
import pytest

from tidemark.llm import jpeg, media


def codes(counts, values):
    """Codes of a table by value, as text of bits."""
    out, code, at = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for v in values[at : at + n]:
            out[v] = format(code, f"0{bits}b")
            code += 1
        at += n
        code <<= 1
    return out


def extra(value):
    size = abs(int(value)).bit_length()
    return size, format(value if value >= 0 else value + (1 << size) - 1, f"0{size}b") if size else ""


def packed(bits):
    bits += "1" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") if bits else b""


def segment(kind, body):
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def block_bits(block, before, direct, alternating):
    size, more = extra(block[0] - before)
    out, run = direct[size] + more, 0
    last = max(np.flatnonzero(block).max(initial=0), 0)
    for v in block[1 : last + 1]:
        if not v:
            run += 1
            continue
        while run > 15:
            out, run = out + alternating[0xF0], run - 16
        size, more = extra(v)
        out, run = out + alternating[16 * run + size] + more, 0
    return out + (alternating[0] if last < 63 else "")


def blocks_of(plane, quant):
    """Quantised blocks in zigzag order, (down, across, 64)."""
    h, w = plane.shape
    cut = plane.reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3) - 128.0
    return np.rint((jpeg.IDCT.T @ cut @ jpeg.IDCT).reshape(h // 8, w // 8, 64)[..., jpeg.ZIGZAG] / quant).astype(int)


def baseline(image, factors=((1, 1),), quant=1, restart=0, tables=False, size=None):
    """A baseline file of grey samples; further components are flat."""
    h, w = size or image.shape
    high_x, high_y = max(f[0] for f in factors), max(f[1] for f in factors)
    whole = np.pad(image, ((0, -image.shape[0] % (8 * high_y)), (0, -image.shape[1] % (8 * high_x))), "edge").astype(float)
    fx, fy = factors[0]
    plane = whole.reshape(whole.shape[0] // (high_y // fy), high_y // fy, whole.shape[1] // (high_x // fx), high_x // fx).mean((1, 3))
    blocks = blocks_of(plane, quant)
    out = b"\xff\xd8" + segment(0xE0, b"AVI1") + segment(0xDB, bytes([0]) + bytes([quant] * 64))
    if tables:
        out += segment(0xC4, b"".join(bytes([k << 4 | c]) + counts + values for (k, c), (counts, values) in jpeg._ALL.items()))
    if restart:
        out += segment(0xDD, struct.pack(">H", restart))
    n = len(factors)
    out += segment(0xC0, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([i + 1, x << 4 | y, 0]) for i, (x, y) in enumerate(factors)))
    out += segment(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0x11 if i else 0]) for i in range(n)) + bytes([0, 63, 0]))
    table = {(k, c): codes(*jpeg._ALL[k, c]) for k in (0, 1) for c in (0, 1)}
    if n == 1:
        fx = fy = high_x = high_y = 1
    across, down = blocks.shape[1] // fx, blocks.shape[0] // fy
    bits, before, marks = "", 0, 0
    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            out += packed(bits) + bytes([0xFF, 0xD0 + marks % 8])
            bits, before, marks = "", 0, marks + 1
        for i, (x, y) in enumerate(factors if n > 1 else ((1, 1),)):
            for k in range(x * y):
                if i:
                    bits += block_bits(np.zeros(64, int), 0, table[0, 1], table[1, 1])
                else:
                    block = blocks[unit // across * fy + k // x, unit % across * fx + k % x]
                    bits += block_bits(block, before, table[0, 0], table[1, 0])
                    before = block[0]
    return out + packed(bits) + b"\xff\xd9"


def picture(h, w, seed=0):
    rng = np.random.default_rng(seed)
    smooth = np.add.outer(np.linspace(0, 160, h), np.linspace(0, 60, w))
    return np.clip(smooth + rng.normal(0, 6, (h, w)), 0, 255).astype(np.uint8)


def test_standard_tables_are_whole():
    every = {0x00, 0xF0, *(16 * r + s for r in range(16) for s in range(1, 11))}
    for c in (0, 1):
        counts, values = jpeg._ALL[1, c]
        assert sum(counts) == len(values) == 162 and set(values) == every and len(codes(counts, values)) == 162
        assert "1" * 16 not in codes(counts, values).values()
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and jpeg.ZIGZAG[-3:].tolist() == [55, 62, 63]
    assert np.allclose(jpeg.IDCT @ jpeg.IDCT.T, np.eye(8))


@pytest.mark.parametrize("factors", [((1, 1),), ((2, 2),), ((1, 1), (1, 1), (1, 1)), ((2, 2), (1, 1), (1, 1)), ((2, 1), (1, 1), (1, 1))])
@pytest.mark.parametrize("restart, tables", [(0, False), (3, True)])
def test_baseline(factors, restart, tables):
    image = picture(29, 45)
    got = jpeg.decode(baseline(image, factors, 1, restart, tables))
    assert got.shape == image.shape and np.abs(got.astype(int) - image).max() <= 2
    coarse = jpeg.decode(baseline(image, factors, 12, restart, tables))
    assert np.abs(coarse.astype(int) - image).mean() < 8


def test_lossless_with_other_tables():
    image = picture(9, 13, 4)
    counts, values = bytes([0, 0, 0, 9, *[0] * 12]), bytes([8, 0, 1, 2, 3, 4, 5, 6, 7])
    table, x = codes(counts, values), image.astype(int)
    diff = x.copy()
    diff[:, 1:] -= x[:, :-1]
    diff[1:, 0] -= x[:-1, 0]
    diff[0, 0] -= 128
    bits = "".join(table[size] + more for size, more in map(extra, diff.ravel()))
    data = b"\xff\xd8" + segment(0xC4, b"\0" + counts + values) + segment(0xC3, struct.pack(">BHHB", 8, 9, 13, 1) + bytes([1, 0x11, 0])) + segment(0xDA, bytes([1, 1, 0, 1, 0, 0])) + packed(bits) + b"\xff\xd9"
    assert (jpeg.decode(data) == image).all() and (media.decode_frame(data) == image).all()
    own = picture(5, 64)
    file = media.encode_frames(own[None])[0]
    assert (media.decode_frame(file) == own).all() and (jpeg.decode(file) == own).all()


def avi(frames, rate=10, index="movi"):
    h, w = 24, 40
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    head = chunk(b"LIST", b"hdrl" + chunk(b"LIST", b"strl" + chunk(b"strh", b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, rate, 0, len(frames), 0, 0, 0, 0, 0, w, h))))
    body, places, at = b"", [], 4
    for f in frames:
        places.append((at, len(f)))
        body += chunk(b"00dc", f)
        at = 4 + len(body)
    movi = chunk(b"LIST", b"movi" + body)
    base = 12 + len(head) + 8 if index == "file" else 0
    tail = chunk(b"idx1", b"".join(struct.pack("<4sIII", b"00dc", 16, base + a, n) for a, n in places)) if index else b""
    return chunk(b"RIFF", b"AVI " + head + movi + tail)


@pytest.mark.parametrize("index", ["movi", "file", ""])
def test_baseline_video_has_shots_and_clips(spark, index):
    dark, light = picture(24, 40), (255 - picture(24, 40, 1) // 3).astype(np.uint8)
    frames = [baseline(dark, ((2, 2), (1, 1), (1, 1)), 3)] * 6 + [baseline(light, ((2, 2), (1, 1), (1, 1)), 3)] * 4
    df = spark.createDataFrame([(1, bytearray(avi(frames, index=index))), (2, bytearray(avi([b"\xff\xd8broken"], index=index))), (3, bytearray(avi([], index=index)))], "id long, media binary")
    out = media.features(df)
    clips = [(r.id, r.first_frame, r.end_frame, r.start_s, r.end_s) for r in media.clips(out).orderBy("clip").collect()]
    assert clips == [(1, 0, 6, 0.0, 0.6), (1, 6, 10, 0.6, 1.0)]
    assert {r.id: r.video is None for r in out.collect()} == {1: False, 2: True, 3: True}


def test_broken_files():
    good = baseline(picture(16, 16))
    for bad in (b"", b"\xff\xd8", good[:40], good.replace(b"\xff\xc0", b"\xff\xc2"), good[:-40]):
        try:
            jpeg.decode(bad)
        except (ValueError, struct.error, IndexError):
            pass

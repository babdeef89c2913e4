"""Baseline JPEG in numpy: marker parser, Huffman scan decoder, DC-only thumbnails, lossless byte storage.

Decoding works on many scans at once: restart intervals are independent, so one symbol of every interval
is read per numpy step. A stream without restart markers is one interval and is decoded the same way.

`pack` stores bytes as quantised coefficients, one byte each: three blocks (Y, Cb, Cr) of 64 zigzag
coefficients make an MCU of 192 bytes, and each MCU is a restart interval. No byte maps to coefficient
zero, so no runs or end-of-block codes occur in the payload.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np

MCU = 192
# Markers of the format.
SOI, EOI, SOS, DQT, DHT, DRI, COM, APP0, SOF0, RST0 = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xFE, 0xE0, 0xC0, 0xD0
# Stored bytes lie around this one, so that letters get short codes.
CENTRE = 110
# MCUs coded and intervals decoded at once; a multiple of 8, after which restart numbers begin anew.
TOGETHER = 1 << 12
# Symbols of the tables that `pack` writes (bits of a coefficient, no zero run; 0 ends a block) with code lengths.
CODE_LENGTHS = {4: 2, 3: 2, 2: 2, 7: 4, 1: 4, 5: 5, 6: 5, 8: 6, 0: 6}
TAG = b"payload"


class Component(NamedTuple):
    ident: int
    across: int
    down: int
    table: int


class Scan(NamedTuple):
    components: tuple[int, ...]  # positions in Image.components
    dc: tuple[bytes, ...]
    ac: tuple[bytes, ...]
    interval: int  # MCUs between restarts, 0: none
    data: memoryview


class Image(NamedTuple):
    width: int
    height: int
    components: tuple[Component, ...]
    quantisers: dict[int, tuple[int, ...]]
    scans: list[Scan]
    comment: bytes


def canonical(lengths: list[int]) -> list[int]:
    """Codes for symbols listed by ascending code length."""
    codes, code, last = [], 0, lengths[0] if lengths else 0
    for length in lengths:
        code <<= length - last
        last = length
        codes.append(code)
        code += 1
    return codes


def lookup(table: bytes) -> np.ndarray:
    """For every 16-bit window: symbol << 5 | code length (0: no code)."""
    lengths = [n + 1 for n in range(16) for _ in range(table[n])]
    found = np.zeros(1 << 16, np.int32)
    for symbol, length, code in zip(table[16:], lengths, canonical(lengths), strict=True):
        found[code << 16 - length : code + 1 << 16 - length] = symbol << 5 | length
    return found


def parse(stream: bytes) -> Image:
    """Markers up to EOI. Raises ValueError for what baseline does not have."""
    view = memoryview(stream)
    if bytes(view[:2]) != bytes([0xFF, SOI]):
        raise ValueError("no JPEG")
    at, interval, comment, frame = 2, 0, b"", None
    quantisers: dict[int, tuple[int, ...]] = {}
    huffman: dict[tuple[int, int], bytes] = {}
    scans = []
    while at + 4 <= len(view):
        if view[at] != 0xFF:
            raise ValueError(f"no marker at {at}")
        marker = view[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == EOI:
            break
        size = struct.unpack_from(">H", view, at + 2)[0]
        body = bytes(view[at + 4 : at + 2 + size])
        at += 2 + size
        if marker == DQT:
            while body:
                wide, ident = divmod(body[0], 16)
                values = struct.unpack_from(">64H" if wide else ">64B", body, 1)
                quantisers[ident], body = values, body[129 if wide else 65 :]
        elif marker == DHT:
            while body:
                n = 17 + sum(body[1:17])
                huffman[divmod(body[0], 16)], body = body[1:n], body[n:]
        elif marker == DRI:
            interval = struct.unpack(">H", body)[0]
        elif marker == COM:
            comment = body
        elif marker == SOF0:
            precision, height, width, n = struct.unpack_from(">BHHB", body)
            if precision != 8:
                raise ValueError("samples must have 8 bits")
            parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(n)]
            frame = (width, height, tuple(Component(p[0], p[1] >> 4, p[1] & 15, p[2]) for p in parts))
        elif 0xC1 <= marker <= 0xCF and marker not in (DHT, 0xC8, 0xCC):
            raise ValueError("only baseline frames")
        elif marker == SOS:
            if frame is None:
                raise ValueError("scan before frame")
            idents = [c.ident for c in frame[2]]
            parts = [body[1 + 2 * i : 3 + 2 * i] for i in range(body[0])]
            end = scan_end(stream, at)
            scans.append(Scan(
                tuple(idents.index(p[0]) for p in parts), tuple(huffman[0, p[1] >> 4] for p in parts),
                tuple(huffman[1, p[1] & 15] for p in parts), interval, view[at:end]))
            at = end
    if frame is None:
        raise ValueError("no frame")
    return Image(*frame, quantisers, scans, comment)


def scan_end(stream: bytes, at: int) -> int:
    """Of the entropy-coded bytes: the next marker that is no restart."""
    while (at := stream.find(b"\xff", at)) >= 0:
        if at + 1 < len(stream) and stream[at + 1] != 0 and not RST0 <= stream[at + 1] <= RST0 + 7:
            return at
        at += 2
    return len(stream)


def intervals(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes without stuffing and restart markers, and where each interval begins."""
    after = np.flatnonzero(data[:-1] == 0xFF) + 1
    stuffed = after[data[after] == 0]
    restarts = after[(data[after] >= RST0) & (data[after] <= RST0 + 7)]
    keep = np.ones(len(data), bool)
    keep[stuffed] = False
    keep[restarts] = keep[restarts - 1] = False
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], np.concatenate([[0], kept_before[restarts]])


def layout(image: Image, scan: Scan) -> tuple[list[int], int]:
    """Component of each block of an MCU, and the number of MCUs."""
    most_across = max(c.across for c in image.components)
    most_down = max(c.down for c in image.components)
    if len(scan.components) == 1:
        c = image.components[scan.components[0]]
        across = -(-image.width * c.across // (8 * most_across))
        down = -(-image.height * c.down // (8 * most_down))
        return [0], across * down
    blocks = [i for i, k in enumerate(scan.components)
              for _ in range(image.components[k].across * image.components[k].down)]
    return blocks, -(-image.width // (8 * most_across)) * -(-image.height // (8 * most_down))


def decode_scans(jobs: list[tuple[Image, Scan]]) -> list[np.ndarray]:
    """Quantised coefficients, (blocks, 64) in zigzag order, of each scan. Scans of one kind run together."""
    kinds: dict[tuple, list[int]] = {}
    for i, (image, scan) in enumerate(jobs):
        kinds.setdefault((scan.dc, scan.ac, tuple(layout(image, scan)[0])), []).append(i)
    out: list[np.ndarray] = [np.zeros((0, 64), np.int16)] * len(jobs)
    for (dc, ac, blocks), members in kinds.items():
        bits, bases, counts, sizes = [], [], [], []
        parts, at, block = [], 0, 0
        for i in members:
            image, scan = jobs[i]
            mcus = layout(image, scan)[1]
            data, starts = intervals(np.frombuffer(scan.data, np.uint8))
            step = scan.interval or mcus
            n = -(-mcus // step) if mcus else 0
            if n > len(starts):
                raise ValueError("restart intervals are missing")
            first = np.arange(n) * step
            bits.append((starts[:n] + at) * 8)
            bases.append(block + first * len(blocks))
            counts.append(np.minimum(step, mcus - first) * len(blocks))
            parts.append(data)
            at += len(data)
            sizes.append(mcus * len(blocks))
            block += sizes[-1]
        data, bit, base, count = (np.concatenate(x) for x in (parts, bits, bases, counts))
        tables = np.stack([lookup(t) for t in dc + ac])
        coefficients = np.zeros(block * 64, np.int16)
        for low in range(0, len(bit), TOGETHER):
            high = min(low + TOGETHER, len(bit))
            start, end = bit[low] >> 3, bit[high] >> 3 if high < len(bit) else len(data)
            decode_intervals(data[start:end], bit[low:high] - 8 * start, base[low:high], count[low:high],
                             np.array(blocks), tables, coefficients)
        coefficients = coefficients.reshape(-1, 64)
        for i, own in zip(members, np.split(coefficients, np.cumsum(sizes)[:-1]), strict=True):
            out[i] = own
    return out


def decode_intervals(data, bit, base, count, blocks, lookups, out) -> None:
    """One Huffman symbol of every unfinished interval per step. `lookups`: DC, then AC of each component."""
    padded = np.concatenate([data, np.full(8, 0xFF, np.uint8)])
    window = np.zeros(len(data) + 1, np.uint64)
    for i in range(8):
        window |= padded[i : i + len(window)].astype(np.uint64) << np.uint64(56 - 8 * i)
    tables, parts = lookups.ravel(), len(lookups) // 2
    last = np.zeros((parts, len(bit)), np.int64)
    live = np.flatnonzero(count > 0)
    bit, k, done = bit[live].astype(np.int64), np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
    one = np.uint64(1)
    while len(live):
        where = bit >> 3
        if where.max(initial=0) >= len(window):
            raise ValueError("scan ends early")
        held = window[where] << (bit & 7).astype(np.uint64)
        part = blocks[done % len(blocks)]
        first = k == 0
        entry = tables[(np.where(first, part, part + parts) << 16) + (held >> np.uint64(48)).astype(np.int64)]
        length, symbol = entry & 31, entry >> 5
        if not length.all():
            raise ValueError("no such code")
        size = symbol & 15
        run = np.where(first, 0, symbol >> 4)
        raw = ((held << length.astype(np.uint64)) >> one >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where(raw < (1 << size) >> 1, raw - (1 << size) + 1, raw)
        bit = bit + length + size
        k = k + run
        if first.any():
            at = np.flatnonzero(first)
            value[at] += last[part[at], live[at]]
            last[part[at], live[at]] = value[at]
        ends = ~first & (size == 0) & (run != 15)
        written = np.flatnonzero(~ends & (k < 64))
        out[(base[live[written]] + done[written]) * 64 + k[written]] = value[written]
        k = np.where(ends, 64, k + 1)
        over = k >= 64
        if over.any():
            done = done + over
            k = np.where(over, 0, k)
            more = done < count[live]
            if not more.all():
                live, bit, k, done = live[more], bit[more], k[more], done[more]


def thumbnail(image: Image, coefficients: list[np.ndarray]) -> np.ndarray:
    """Mean luminance of every 8 x 8 block of the first component, from its DC coefficients alone."""
    c = image.components[0]
    most_across, most_down = max(x.across for x in image.components), max(x.down for x in image.components)
    across = -(-image.width * c.across // (8 * most_across))
    down = -(-image.height * c.down // (8 * most_down))
    for scan, own in zip(image.scans, coefficients, strict=True):
        if 0 not in scan.components:
            continue
        blocks, _ = layout(image, scan)
        mine = np.flatnonzero(np.array(blocks) == scan.components.index(0))
        dc = own.reshape(-1, len(blocks), 64)[:, mine, 0]
        if len(mine) > 1:
            wide = -(-image.width // (8 * most_across))
            dc = dc.reshape(-1, wide, c.down, c.across).transpose(0, 2, 1, 3).reshape(-1, wide * c.across)
        else:
            dc = dc.reshape(down, -1)
        level = dc[:down, :across].astype(np.int64) * image.quantisers[c.table][0]
        return np.clip((level + 1024 + 4) >> 3, 0, 255).astype(np.uint8)
    raise ValueError("no luminance scan")


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: in an 8 x 9 grid of picked pixels, is each brighter than its right neighbour?"""
    rows = (np.arange(8) * 2 + 1) * pixels.shape[0] // 16
    columns = (np.arange(9) * 2 + 1) * pixels.shape[1] // 18
    grid = pixels[np.ix_(rows, columns)]
    return int.from_bytes(np.packbits(grid[:, :-1] > grid[:, 1:]).tobytes(), "big")


def to_coefficients(payload: np.ndarray) -> np.ndarray:
    """A byte's distance from CENTRE, one less or more on either side of zero's gap."""
    value = payload.astype(np.int16) - CENTRE
    return np.where(value >= 0, value + 1, value)


def from_coefficients(values: np.ndarray) -> np.ndarray:
    return (np.where(values > 0, values - 1, values) + CENTRE).astype(np.uint8)


def _table(kind: int) -> bytes:
    ordered = sorted(CODE_LENGTHS.items(), key=lambda x: x[1])
    counts = bytes(sum(length == n for _, length in ordered) for n in range(1, 17))
    return bytes([kind]) + counts + bytes(symbol for symbol, _ in ordered)


def _codes() -> tuple[np.ndarray, np.ndarray]:
    ordered = sorted(CODE_LENGTHS.items(), key=lambda x: x[1])
    code, length = np.zeros(16, np.int64), np.zeros(16, np.int64)
    for (symbol, n), c in zip(ordered, canonical([n for _, n in ordered]), strict=True):
        code[symbol], length[symbol] = c, n
    return code, length


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def entropy_code(payloads: list[np.ndarray]) -> list[bytes]:
    """Entropy-coded bytes of each payload, an interval per MCU; short payloads are coded together."""
    out, short, size = [], [], 0
    for payload in payloads:
        pieces = [payload[i : i + TOGETHER * MCU] for i in range(0, len(payload), TOGETHER * MCU)]
        if len(pieces) > 1:
            out += code_together(short)
            out.append(bytes([0xFF, RST0 + 7]).join(code_together([p])[0] for p in pieces))
            short, size = [], 0
            continue
        if size + len(payload) > TOGETHER * MCU:
            out += code_together(short)
            short, size = [], 0
        short.append(payload)
        size += len(payload)
    return out + code_together(short)


def code_together(payloads: list[np.ndarray]) -> list[bytes]:
    if not payloads:
        return []
    values = to_coefficients(np.concatenate(payloads)).astype(np.int64)
    size = np.frexp(np.abs(values))[1].astype(np.int64)
    code, length = _codes()
    width = length[size] + size
    word = (code[size] << size) | np.where(values < 0, values + (1 << size) - 1, values)
    per_mcu = width.reshape(-1, MCU).sum(axis=1)
    fill = -per_mcu % 8
    # One more word per MCU of up to 7 ones fills the last byte.
    width = np.column_stack([width.reshape(-1, MCU), fill]).ravel().astype(np.int32)
    word = np.column_stack([word.reshape(-1, MCU), (1 << fill) - 1]).ravel().astype(np.int32)
    ends = np.cumsum(width)
    place = np.repeat(ends.astype(np.int32), width)
    place -= np.arange(1, len(place) + 1, dtype=np.int32)
    packed = np.packbits((np.repeat(word, width) >> place & 1).astype(np.uint8))
    # After every 0xFF a zero is stuffed; between MCUs stands a restart marker.
    mcu_end = np.cumsum((per_mcu + fill) // 8)
    mcus = np.array([len(p) // MCU for p in payloads])
    last = np.cumsum(mcus)
    number = np.arange(len(mcu_end)) - np.repeat(last - mcus, mcus)
    between = np.ones(len(mcu_end), bool)
    between[last - 1] = False
    extra = (packed == 0xFF).astype(np.int64)
    np.add.at(extra, mcu_end[between] - 1, 2)
    start = np.cumsum(extra) - extra + np.arange(len(packed))
    out = np.zeros(len(packed) + int(extra.sum()), np.uint8)
    out[start] = packed
    marks = mcu_end[between] - 1
    at = start[marks] + extra[marks] - 1
    out[at], out[at + 1] = 0xFF, RST0 + number[between] % 8
    stops = (start + extra + 1)[mcu_end[last - 1] - 1]
    return [out[a:b].tobytes() for a, b in zip(np.concatenate([[0], stops[:-1]]), stops, strict=True)]


def pack(payloads: list[np.ndarray]) -> list[bytes]:
    """A JPEG per payload of a positive multiple of 192 bytes; unused MCUs of the last row repeat byte CENTRE."""
    shapes, padded = [], []
    for payload in payloads:
        mcus = len(payload) // MCU
        wide = int(np.ceil(np.sqrt(mcus)))
        high = -(-mcus // wide)
        shapes.append((wide, high))
        padded.append(np.concatenate([payload, np.full((wide * high - mcus) * MCU, CENTRE, np.uint8)]))
    out = []
    head = b"".join([
        bytes([0xFF, SOI]), _segment(APP0, b"JFIF\0" + struct.pack(">HBHHBB", 0x0101, 0, 1, 1, 0, 0)),
        _segment(DQT, bytes([0]) + bytes([1]) * 64)])
    tables = _segment(DHT, _table(0)) + _segment(DHT, _table(0x10)) + _segment(DRI, struct.pack(">H", 1))
    scan = _segment(SOS, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    for payload, (wide, high), coded in zip(payloads, shapes, entropy_code(padded), strict=True):
        parts = bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])
        frame = _segment(SOF0, struct.pack(">BHHB", 8, 8 * high, 8 * wide, 3) + parts)
        out.append(b"".join([
            head, _segment(COM, TAG + struct.pack(">Q", len(payload))), frame, tables, scan, coded,
            bytes([0xFF, EOI])]))
    return out


def unpack(image: Image, coefficients: list[np.ndarray]) -> bytes:
    """The payload that `pack` stored."""
    if not image.comment.startswith(TAG):
        raise ValueError("no payload inside")
    size = struct.unpack(">Q", image.comment[len(TAG) :])[0]
    return from_coefficients(coefficients[0].ravel()[:size]).tobytes()

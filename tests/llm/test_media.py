import hashlib
import random
import zlib

import numpy as np
from llm_cases import as_rows, both, empty

from cardflow.llm import jpeg, media


def naive(image, scan):
    """Bit by bit: coefficients of a scan in zigzag order, without any restart."""
    bits, i, data = [], 0, bytes(scan.data)
    while i < len(data):
        byte = data[i]
        i += 1 + (byte == 0xFF)
        bits += [byte >> k & 1 for k in range(7, -1, -1)]
    tables = []
    for table in (*scan.dc, *scan.ac):
        lengths = [n + 1 for n in range(16) for _ in range(table[n])]
        tables.append({(n, c): s for n, c, s in zip(lengths, jpeg.canonical(lengths), table[16:], strict=True)})
    blocks, mcus = jpeg.layout(image, scan)
    at, last, out = 0, [0] * len(scan.components), []

    def symbol(table):
        nonlocal at
        code = n = 0
        while (n, code) not in table:
            code, n, at = code * 2 + bits[at], n + 1, at + 1
        return table[n, code]

    def value(size):
        nonlocal at
        raw = int("".join(map(str, bits[at : at + size])) or "0", 2)
        at += size
        return raw if not size or raw >> size - 1 else raw - (1 << size) + 1

    for _ in range(mcus):
        for part in blocks:
            block = [0] * 64
            last[part] += value(symbol(tables[part]))
            block[0], k = last[part], 1
            while k < 64:
                run, size = divmod(symbol(tables[part + len(scan.components)]), 16)
                if size == 0 and run != 15:
                    break
                k += run
                if size:
                    block[k] = value(size)
                k += 1
            out.append(block)
    return np.array(out, np.int16)


def encode(width, height, sampling, seed):
    """A baseline stream with sparse random coefficients, runs, end-of-block codes and no restart markers."""
    rng = random.Random(seed)
    dc = bytes([0, 0, 0, 0, 12] + [0] * 11 + list(range(12)))
    ac_symbols = [r << 4 | s for r in range(16) for s in range(1, 8)] + [0, 0xF0]
    ac = bytes([0] * 6 + [0, len(ac_symbols)] + [0] * 8 + ac_symbols)
    components = tuple(jpeg.Component(i + 1, a, d, 0) for i, (a, d) in enumerate(sampling))
    image = jpeg.Image(width, height, components, {}, [], b"")
    scan = jpeg.Scan(tuple(range(len(sampling))), (dc,) * len(sampling), (ac,) * len(sampling), 0, memoryview(b""))
    blocks, mcus = jpeg.layout(image, scan)
    codes = [dict(zip(t[16:], jpeg.canonical([n + 1 for n in range(16) for _ in range(t[n])]), strict=True)) for t in (dc, ac)]
    widths = [5, 8]
    bits, last, out = [], [0] * len(sampling), []

    def put(code, n):
        bits.extend(code >> k & 1 for k in reversed(range(n)))

    def number(v):
        size = abs(v).bit_length()
        return size, v if v > 0 else v + (1 << size) - 1

    for _ in range(mcus):
        for part in blocks:
            block = [0] * 64
            block[0] = rng.randint(-500, 500)
            for k in rng.sample(range(1, 64), rng.choice([0, 1, 3, 20])):
                block[k] = rng.randint(-100, 100)
            size, raw = number(block[0] - last[part])
            last[part] = block[0]
            put(codes[0][size], widths[0])
            put(raw, size)
            run = 0
            for k in range(1, 64):
                if not block[k]:
                    run += 1
                    continue
                while run > 15:
                    put(codes[1][0xF0], widths[1])
                    run -= 16
                size, raw = number(block[k])
                put(codes[1][run << 4 | size], widths[1])
                put(raw, size)
                run = 0
            if run:
                put(codes[1][0], widths[1])
            out.append(block)
    bits += [1] * (-len(bits) % 8)
    coded = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    n = len(sampling)
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([n]) + b"".join(
        bytes([i + 1, a << 4 | d, 0]) for i, (a, d) in enumerate(sampling))
    head = bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + bytes([0, 63, 0])
    stream = b"\xff\xd8" + jpeg._segment(jpeg.DQT, bytes([0]) + bytes(range(2, 66))) + jpeg._segment(jpeg.SOF0, frame)
    stream += jpeg._segment(jpeg.DHT, b"\0" + dc) + jpeg._segment(jpeg.DHT, b"\x10" + ac)
    return stream + jpeg._segment(jpeg.SOS, head) + coded + b"\xff\xd9", np.array(out, np.int16)


def test_foreign_streams_decode():
    streams = [encode(40, 24, [(1, 1)], 1), encode(33, 17, [(2, 2), (1, 1), (1, 1)], 2), encode(50, 9, [(2, 1), (1, 1), (1, 1)], 3)]
    images = [jpeg.parse(s) for s, _ in streams]
    decoded = jpeg.decode_scans([(i, i.scans[0]) for i in images])
    for image, (_, expected), own in zip(images, streams, decoded, strict=True):
        assert (own == expected).all() and (naive(image, image.scans[0]) == expected).all()
        pixels = jpeg.thumbnail(image, [own])
        assert pixels.shape == (-(-image.height // 8), -(-image.width // 8))
    # Two by two luminance blocks of the first MCU lie in reading order.
    pixels, dc = jpeg.thumbnail(images[1], [decoded[1]]), streams[1][1].reshape(-1, 6, 64)[0, :4, 0].astype(int)
    assert pixels[:2, :2].ravel().tolist() == np.clip((dc * 2 + 1028) >> 3, 0, 255).tolist()


def test_round_trip_of_every_byte(monkeypatch):
    payloads = [np.frombuffer(random.Random(i).randbytes(192 * n), np.uint8) for i, n in enumerate((1, 2, 7, 19, 400))]
    for together in (1 << 12, 16):
        monkeypatch.setattr(jpeg, "TOGETHER", together)
        for payload, stream in zip(payloads, jpeg.pack(payloads), strict=True):
            image = jpeg.parse(stream)
            assert jpeg.unpack(image, jpeg.decode_scans([(image, image.scans[0])])) == payload.tobytes()


def test_table(spark):
    docs, pairs = both(spark)
    expected = []
    for i, t in pairs:
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        expected.append((i, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    stored = media.store_as_media(docs)
    read = media.read_media(stored)
    assert as_rows(read, "doc_id", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(expected, key=repr)
    for row in read.limit(40).collect():
        assert (row["media_bytes"], row["media_sha256"]) == (len(row["media"]), hashlib.sha256(row["media"]).hexdigest())
    equal = read.groupBy("text").agg({"feature": "collect_set"}).collect()
    assert all(len(r[1]) == 1 for r in equal)


def test_unreadable_bytes_and_empty_table(spark):
    stream, _ = encode(40, 24, [(1, 1)], 1)
    rows = [(1, None), (2, b""), (3, b"no image"), (4, bytearray(stream)), (5, bytearray(stream[:200])), (6, bytearray(b"\xff\xd8\xff\xc2\0\x0b" + b"0" * 9))]
    found = {r["doc_id"]: r for r in media.read_media(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert (found[4]["width"], found[4]["height"], found[4]["payload_bytes"]) == (40, 24, None)
    assert all(found[i]["feature"] is None for i in (1, 2, 3, 6))
    assert media.read_media(media.store_as_media(empty(spark).drop("media"))).count() == 0

import hashlib
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import flac, media


def padded(raw):
    return raw + b" " * (-len(raw) % 192 if raw else 192)


PAYLOADS = [padded(x) for x in (b"", b"text " * 300, os.urandom(3000), b"a" * 2000, bytes(range(256)) * 3, "é漢😀".encode() * 200)]


def test_round_trip():
    for payload, stream in zip(PAYLOADS, flac.decode(flac.encode(PAYLOADS))):
        assert stream.error is None and stream.pcm() == payload
        assert [b[:2] for b in stream.blocks] == [(i, 192) for i in range(0, len(payload), 192)]


def test_seek_offsets_lead_to_frames():
    raw = flac.encode([PAYLOADS[1]])[0]
    stream = flac.decode([raw])[0]
    assert all(raw[offset : offset + 2] == b"\xff\xf8" for _, _, offset in stream.blocks)


def test_without_seek_table():
    raw = flac.encode([PAYLOADS[1]])[0]
    size = int.from_bytes(raw[43:46], "big")
    bare = raw[:4] + bytes([raw[4] | 128]) + raw[5:42] + raw[46 + size :]
    assert flac.decode([bare])[0].pcm() == PAYLOADS[1]


def test_damage_is_found():
    raw = flac.encode([PAYLOADS[1]])[0]
    for at in (-1, -40, len(raw) // 2):
        bad = bytearray(raw)
        bad[at] ^= 0x10
        assert flac.decode([bytes(bad), raw])[0].error
    assert [s.error is None for s in flac.decode([None, b"", raw[:60], raw[:-5], b"fLaC", raw])] == [False] * 5 + [True]


class Bits:
    def __init__(self):
        self.s = ""

    def put(self, value, n):
        self.s += format(value & (1 << n) - 1, f"0{n}b") if n else ""

    def rice(self, value, k):
        u = value << 1 if value >= 0 else (-value << 1) - 1
        self.s += "0" * (u >> k) + "1"
        self.put(u, k)

    def bytes(self):
        self.s += "0" * (-len(self.s) % 8)
        return int(self.s, 2).to_bytes(len(self.s) // 8, "big")


def crc(data, bits, poly):
    out = 0
    for byte in data:
        out ^= byte << (bits - 8)
        for _ in range(8):
            out = (out << 1) ^ (poly if out >> (bits - 1) & 1 else 0)
        out &= (1 << bits) - 1
    return out


def stream(frames, channels, bits, total, md5=bytes(16)):
    info = struct.pack(">HH", 16, 4096) + bytes(6) + struct.pack(">Q", 44100 << 44 | (channels - 1) << 41 | (bits - 1) << 36 | total) + md5
    return b"fLaC" + struct.pack(">I", 1 << 31 | len(info)) + info + b"".join(frames)


def frame(number, size, layout, write):
    head = b"\xff\xf8" + bytes([0x70 | 9, layout << 4 | 8]) + bytes([number]) + struct.pack(">H", size - 1)  # 16-bit samples
    body = Bits()
    write(body)
    raw = head + bytes([crc(head, 8, 0x07)]) + body.bytes()
    return raw + struct.pack(">H", crc(raw, 16, 0x8005))


def linear(bits, samples, depth, coefs, shift, k, parts):
    """An LPC subframe with 2 ** parts partitions; partition 1 is stored raw."""
    order = len(coefs)
    bits.put(0, 1), bits.put(32 + order - 1, 6), bits.put(0, 1)
    for x in samples[:order]:
        bits.put(x, depth)
    bits.put(9, 4), bits.put(shift, 5)
    for c in coefs:
        bits.put(c, 10)
    bits.put(1, 2), bits.put(parts, 4)
    size = len(samples) >> parts
    for p in range(1 << parts):
        raw = p == 1
        bits.put(31 if raw else k, 5)
        if raw:
            bits.put(20, 5)
        for i in range(max(order, p * size), (p + 1) * size):
            e = samples[i] - (sum(c * samples[i - 1 - j] for j, c in enumerate(coefs)) >> shift)
            bits.put(e, 20) if raw else bits.rice(e, k)


def verbatim(bits, samples, depth, wasted=0):
    bits.put(0, 1), bits.put(1, 6), bits.put(1 if wasted else 0, 1)
    if wasted:
        bits.put(1, wasted)
    for x in samples:
        bits.put(x >> wasted, depth - wasted)


def test_linear_prediction_partitions_and_stereo():
    t = np.arange(64)
    left = (9000 * np.sin(t / 5)).astype(int).tolist()
    right = (7000 * np.cos(t / 7)).astype(int).tolist()
    side = [a - b for a, b in zip(left, right)]
    mid = [(a + b) >> 1 for a, b in zip(left, right)]
    lpc = lambda b, x, depth: linear(b, x, depth, [250, -120, 7], 7, 9, 2)
    frames = [
        frame(0, 64, 1, lambda b: (lpc(b, left, 16), lpc(b, right, 16))),
        frame(1, 64, 8, lambda b: (lpc(b, left, 16), lpc(b, side, 17))),
        frame(2, 64, 9, lambda b: (lpc(b, side, 17), lpc(b, right, 16))),
        frame(3, 64, 10, lambda b: (lpc(b, mid, 16), lpc(b, side, 17))),
    ]
    md5 = hashlib.md5(np.array([left * 4, right * 4]).T.astype("<i2").tobytes()).digest()
    got = flac.decode([stream(frames, 2, 16, 256, md5)])[0]
    assert got.error is None
    assert got.samples.tolist() == [left * 4, right * 4]
    assert got.pcm() == np.array([left * 4, right * 4]).T.astype("<i2").tobytes()


def test_constant_wasted_bits_and_short_last_frame():
    values = [(i * 37 % 50 - 25) * 8 for i in range(20)]

    def constant(b):
        b.put(0, 8), b.put(-5, 16)

    frames = [frame(0, 40, 0, constant), frame(1, 20, 0, lambda b: verbatim(b, values, 16, wasted=3))]
    got = flac.decode([stream(frames, 1, 16, 60)])[0]
    assert got.error is None and got.samples.tolist() == [[-5] * 40 + values]
    assert flac.decode([stream(frames[:1], 1, 16, 60)])[0].error == "40 samples of 60"


def test_columns(spark, odd_docs, no_docs, odd_rows):
    docs = odd_docs.withColumnRenamed("source", "blocks").withColumnRenamed("lang", "media")
    stored = media.store_texts(docs)
    out = media.with_pcm(stored, "_media")
    assert out.columns == [*docs.columns, "_media", "_blocks", "sample_rate", "channels", "bits", "feature", "error"]
    for r in out.withColumn("pcm", media.whole(F.col("_blocks"))).collect():
        payload = padded((r.text or "").encode())
        assert r.error is None and bytes(r.pcm) == payload
        at = 0
        for b in r["_blocks"]:  # each can be sought by its sample or by its byte
            assert b.first_sample == at and b.n_samples % 192 == 0 and 0 < b.n_samples <= media.BLOCK_BYTES and bytes(b.pcm) == payload[at : at + b.n_samples]
            assert bytes(r["_media"])[b.byte_offset : b.byte_offset + 2] == b"\xff\xf8"
            at += b.n_samples
        assert at == len(payload)
    blocks = media.pcm_blocks(stored.where("doc_id = 6"), "doc_id", "_media").orderBy("first_sample").collect()
    assert b"".join(bytes(r.pcm) for r in blocks) == padded(odd_rows[5][1].encode()) and len(blocks) > 1
    assert media.with_pcm(media.store_texts(no_docs)).count() == 0
    broken = spark.createDataFrame([(1, None), (2, b"xyz")], "doc_id long, media binary")
    assert [(r.blocks, bool(r.error)) for r in media.with_pcm(broken).collect()] == [([], True)] * 2
    assert media.pcm_blocks(broken, "doc_id").count() == 0


def test_encoder_uses_linear_predictors():
    """A slow wave is shorter by a fitted predictor; the decoder gives it back, and more frames than are worked on at once."""
    wave = bytes((128 + 90 * np.sin(np.arange(192 * 50) / 9) + np.random.default_rng(1).integers(-2, 3, 192 * 50)).astype(np.uint8))
    raw = flac.encode([wave])[0]
    stream = flac.decode([raw])[0]
    kinds = {raw[offset + 6] >> 1 & 0x3F for _, _, offset in stream.blocks if raw[offset + 4] < 128}  # the subframe's first byte
    assert stream.pcm() == wave and 32 + flac.ORDER - 1 in kinds
    x = np.array([[*range(10), *range(10)]])
    assert (np.abs(flac.linear_predictors(np.zeros((1, 192), np.int16))) == 0).all() and flac.linear_predictors(x).shape == (1, flac.ORDER)


def test_few_frames_at_once(monkeypatch):
    whole = flac.encode(PAYLOADS)
    monkeypatch.setattr(flac, "FRAMES", 3)
    assert flac.encode(PAYLOADS) == whole
    assert [s.pcm() for s in flac.decode(whole)] == PAYLOADS and flac.encode([]) == []


def plain_feature(payload, blocks):
    x = [b - 128 for b in payload]
    steps = list(zip(x, x[1:]))
    rms = (sum(v * v for v in x) / len(x)) ** 0.5
    zero, rough = sum((a >= 0) != (b >= 0) for a, b in steps) / len(steps), sum(abs(b - a) for a, b in steps) / len(steps)
    return f"rms={rms:.4f};zero={zero:.6f};rough={rough:.4f};peak={max(map(abs, x))};blocks={blocks}"


def test_query(spark):
    from lectern.llm.registry import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in QUERIES["op9_flac"](spark, "/root/testdata/sf0.001").collect():
        raw = docs[r.doc_id].encode()
        payload = padded(raw)
        stored = flac.encode([payload])[0]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.feature, r.error, r.n_blocks) == (plain_feature(payload, len(payload) // 192), None, -(-(len(payload) // 192) // 341))
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest())


@pytest.mark.parametrize("n", [0, 127, 128, 2047, 2048, 65535, 65536, 2**21, 2**26, 2**31, 2**35])
def test_frame_numbers(n):
    raw = flac._utf8_number(n)
    assert raw == (chr(n).encode("utf-8", "surrogatepass") if n < 0x110000 else raw)
    assert len(raw) == 1 + sum(n >= x for x in (0x80, 0x800, 0x10000, 0x200000, 0x4000000, 0x80000000))

"""FLAC streams: many frames at once, by numpy arrays over frames.

The decoder walks all frames in step, one sample of each at a time: Rice residuals, fixed and
linear predictors, constant and verbatim subframes, wasted bits, stereo decorrelation. A seek table
says where frames begin; frames between two seek points follow one after the other, so a stream
without seek table decodes too, only with less at once. Header and frame checksums and the MD5 sum
of the samples are verified. The encoder writes mono streams: of each frame the shortest of fixed
predictors and a linear predictor fitted to it, with Rice residuals, or a verbatim subframe where that
is shorter, and a seek point for every SEEK_FRAMES frames.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass, field

import numpy as np

BLOCK = 192
SAMPLE_RATE = 8000
#: Coefficients of the linear predictor that the encoder fits, their bits, and by how many they are scaled.
ORDER, PRECISION, SHIFT = 4, 8, 6
#: Frames that are encoded or decoded at once.
FRAMES = 8192
#: Frames from one seek point to the next.
SEEK_FRAMES = 4
#: A metadata block's length has 24 bits.
MAX_SEEK_POINTS = 900_000

#: Fixed values of the format: block sizes and sample sizes by code, and fixed predictors' coefficients by order.
_SIZES = [0, 192, 576, 1152, 2304, 4608, 0, 0, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768]
_BITS = [0, 8, 12, 0, 16, 20, 24, 32]
_FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _crc_step(bits: int, poly: int) -> np.ndarray:
    """The checksum of each single byte."""
    table = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        table = np.where(table >> (bits - 1) & 1, (table << 1) ^ poly, table << 1) & ((1 << bits) - 1)
    return table.astype(np.uint16)


class _Crc:
    """Checksums of rows of bytes, by one table per distance from the end. Zeros in front change nothing."""

    def __init__(self, bits: int, poly: int):
        self.bits, self.tables = bits, [_crc_step(bits, poly)]

    def of(self, rows: np.ndarray) -> np.ndarray:
        first = self.tables[0]
        while len(self.tables) < rows.shape[1]:
            last = self.tables[-1]
            self.tables.append(first[last] if self.bits == 8 else (last << 8) ^ first[last >> 8])
        out = np.zeros(len(rows), np.uint16)
        for k in range(rows.shape[1]):
            out ^= self.tables[rows.shape[1] - 1 - k][rows[:, k]]
        return out


_CRC8, _CRC16 = _Crc(8, 0x07), _Crc(16, 0x8005)


def _rows(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The pieces data[start:end] as rows of one length, zeros in front."""
    width = int((end - start).max(initial=0))
    at = end[:, None] - np.arange(width, 0, -1)
    return np.where(at >= start[:, None], data[np.maximum(at, 0)], 0).astype(np.uint8)


def _utf8_number(n: int) -> bytes:
    """A frame's number in the extended UTF-8 of the format."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x40
    while n >= limit:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        limit = 0x20 if len(tail) == 1 else limit >> 1
    mark = (0xFF00 >> (len(tail) + 1)) & 0xFF
    return bytes([mark | n, *reversed(tail)])


def linear_predictors(x: np.ndarray) -> np.ndarray:
    """Of each row of samples, ORDER coefficients times 2 ** SHIFT, by the Levinson-Durbin recursion on its autocorrelation."""
    x = x.astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", x[:, : x.shape[1] - k], x[:, k:]) for k in range(ORDER + 1)], axis=1).astype(float)
    error = r[:, 0] * (1 + 1e-9) + 1e-9
    a = np.zeros((len(x), ORDER))
    for k in range(ORDER):
        step = (r[:, k + 1] - (a[:, :k] * r[:, k:0:-1]).sum(axis=1)) / error
        a[:, :k] -= step[:, None] * a[:, :k][:, ::-1]
        a[:, k] = step
        error = np.maximum(error * (1 - step**2), 1e-9)
    most = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << SHIFT)), -most, most).astype(np.int16)


def _frames(x: np.ndarray, number: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Frames of BLOCK 8-bit samples each, one after the other, and their sizes; number: of each frame in its stream."""
    # Of each way to predict: warm-up samples, bits besides them and the residuals, and the residuals as unsigned numbers.
    coefs = linear_predictors(x)
    guess = sum(coefs[:, j, None].astype(np.int32) * x[:, ORDER - 1 - j : BLOCK - 1 - j] for j in range(ORDER)) >> SHIFT
    ways = [(0, 0, x), (1, 0, np.diff(x, axis=1)), (2, 0, np.diff(x, n=2, axis=1)), (ORDER, 9 + ORDER * PRECISION, (x[:, ORDER:] - guess).astype(np.int16))]
    zigzags = [((e << 1) ^ (e >> 15)).view(np.uint16) for _, _, e in ways]
    ks = np.arange(2, 8)
    cost = np.empty((len(ways), len(ks), len(x)), np.int32)
    for n, (warm, extra, _) in enumerate(ways):
        for j, k in enumerate(ks):
            cost[n, j] = (zigzags[n] >> k).sum(axis=1, dtype=np.int32) + (BLOCK - warm) * (1 + k) + 8 * warm + extra
    flat = cost.reshape(-1, len(x))
    best, least = flat.argmin(axis=0), flat.min(axis=0)
    verbatim = least + 10 >= 8 * BLOCK
    way = best // len(ks)
    k = ks[best % len(ks)]

    heads = {}
    for n in np.unique(number).tolist():
        head = bytes([0xFF, 0xF8, 0x14, 0x02]) + _utf8_number(n)
        heads[n] = head + bytes([int(_CRC8.of(np.frombuffer(head, np.uint8)[None, :])[0])])
    head_bytes = np.array([len(heads[n]) for n in number.tolist()])
    body_bits = 8 + np.where(verbatim, 8 * BLOCK, 10 + least)
    size = head_bytes + (body_bits + 7) // 8 + 2
    ends = np.cumsum(size)
    starts = ends - size
    bits = np.zeros(int(ends[-1]) * 8, np.uint8)

    def put(at: np.ndarray, value: np.ndarray | int, n: int) -> None:
        for b in range(n):
            bits[at + b] = value >> (n - 1 - b) & 1

    data_at = (starts + head_bytes) * 8
    kind = np.select([verbatim, way == 3], [1, 32 + ORDER - 1], 8 + way)
    put(data_at, kind << 1, 8)  # the subframe's first byte
    at = data_at + 8
    for n, (warm, extra, _) in enumerate(ways):
        mine = np.flatnonzero(~verbatim & (way == n))
        if not len(mine):
            continue
        for w in range(warm):
            put(at[mine] + 8 * w, x[mine, w], 8)
        coded = at[mine] + 8 * warm
        if extra:
            put(coded, PRECISION - 1, 4)
            put(coded + 4, SHIFT, 5)
            for j in range(ORDER):
                put(coded + 9 + PRECISION * j, coefs[mine, j], PRECISION)
            coded = coded + extra
        put(coded + 6, k[mine], 4)  # two bits of coding method and four of partition order are zero
        u, kk = zigzags[n][mine].astype(np.int64), k[mine][:, None]
        q = u >> kk
        length = q + 1 + kk
        stop = (coded + 10)[:, None] + np.cumsum(length, axis=1) - length + q
        bits[stop] = 1
        for b in range(int(kk.max())):
            has = b < kk[:, 0]
            bits[stop[has] + 1 + b] = u[has] >> (kk[has] - 1 - b) & 1
    plain = np.flatnonzero(verbatim)
    put(at[plain][:, None] + 8 * np.arange(BLOCK), x[plain], 8)
    data = np.packbits(bits)
    for n in np.unique(head_bytes):
        own = np.flatnonzero(head_bytes == n)
        data[starts[own][:, None] + np.arange(n)] = np.frombuffer(b"".join(heads[i] for i in number[own].tolist()), np.uint8).reshape(-1, n)
    crc = _CRC16.of(_rows(data, starts, ends - 2))
    data[ends - 2], data[ends - 1] = crc >> 8, crc & 0xFF
    return data.tobytes(), size


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload: its bytes as 8-bit samples. Lengths must be positive multiples of BLOCK. FRAMES at a time are worked on."""
    counts = np.array([len(p) // BLOCK for p in payloads], np.int64)
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    number = np.arange(len(samples)) - np.repeat(np.cumsum(counts) - counts, counts)
    made = [_frames(samples[a : a + FRAMES].astype(np.int16) - 128, number[a : a + FRAMES]) for a in range(0, len(samples), FRAMES)]
    data, size = b"".join(d for d, _ in made), np.concatenate([n for _, n in made]) if made else np.zeros(0, int)
    ends = np.cumsum(size)
    starts = ends - size

    out, first = [], 0
    for payload, n in zip(payloads, counts.tolist()):
        a, b = int(starts[first]), int(ends[first + n - 1])
        own = size[first : first + n]
        every = max(SEEK_FRAMES, -(-n // MAX_SEEK_POINTS))
        points = np.zeros((-(-n // every)), np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        points["sample"] = np.arange(0, n, every) * BLOCK
        points["offset"] = (starts[first : first + n] - a)[::every]
        points["n"] = BLOCK
        md5 = hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest()
        sizes = int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        layout = SAMPLE_RATE << 44 | 0 << 41 | 7 << 36 | n * BLOCK
        info = struct.pack(">HH", BLOCK, BLOCK) + sizes + struct.pack(">Q", layout) + md5
        table = points.tobytes()
        out.append(b"fLaC" + struct.pack(">I", len(info)) + info + struct.pack(">I", 3 << 24 | 1 << 31 | len(table)) + table + data[a:b])
        first += n
    return out


@dataclass
class Stream:
    """A decoded stream: samples as rows of channels, and where each block of them begins."""

    sample_rate: int = 0
    channels: int = 0
    bits: int = 0
    error: str | None = None
    blocks: list[tuple[int, int, int]] = field(default_factory=list)  # first sample, samples, byte offset of the frame
    samples: np.ndarray | None = None

    def pcm(self) -> bytes:
        """Interleaved little-endian samples, 8-bit ones unsigned, as in WAV files."""
        if self.bits <= 8:
            return (self.samples.T + (1 << (self.bits - 1))).astype(np.uint8).tobytes()
        width = -(-self.bits // 8)
        return self.samples.T.astype("<i4").reshape(-1, 1).view(np.uint8)[:, :width].tobytes()


class _Reader:
    """Bits of all streams from any position."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate((data, np.zeros(16, np.uint8))).astype(np.uint64)
        words = np.zeros(len(data) + 8, np.uint64)
        for k in range(8):
            words |= padded[k : k + len(words)] << np.uint64(56 - 8 * k)
        self.words = words

    def top(self, at: np.ndarray) -> np.ndarray:
        """64 bits from each position on, of which 57 are right."""
        return self.words[np.minimum(at >> 3, len(self.words) - 1)] << (at & 7).astype(np.uint64)

    def bits(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        n = np.broadcast_to(np.asarray(n), at.shape)
        value = self.top(at) >> np.minimum(64 - n, 63).astype(np.uint64)
        return np.where(n > 0, value, 0).astype(np.int64)

    def signed(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        value, n = self.bits(at, n), np.asarray(n)
        return value - ((value >> np.maximum(n - 1, 0) & 1) << n)

    def zeros(self, at: np.ndarray) -> np.ndarray:
        """The number of zero bits before the next one; far too many mean damage."""
        count = np.zeros(len(at), np.int64)
        open_ = np.arange(len(at))
        while len(open_):
            head = self.top(at[open_] + count[open_]) >> np.uint64(11)
            own = 1075 - (np.maximum(head, 1).astype(np.float64).view(np.int64) >> 52)
            none = head == 0
            count[open_] += np.where(none, 53, own)
            open_ = open_[none & (count[open_] < 1 << 16)]
        return count


def _subframes(r: _Reader, at: np.ndarray, size: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(samples by step and frame, position after, ok) of one channel's subframes of equal block size."""
    head = r.bits(at, 8)
    kind, wasted = head >> 1 & 0x3F, (head & 1).astype(np.int64)
    ok = head < 128
    at = at + 8
    if wasted.any():
        extra = np.where(wasted > 0, r.zeros(at), 0)
        at, wasted = at + np.where(wasted > 0, extra + 1, 0), np.where(wasted > 0, extra + 1, 0)
    bits = bits - wasted
    constant, verbatim, fixed, linear = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    ok &= constant | verbatim | fixed | linear
    predicted = fixed | linear
    order = np.select([constant, verbatim, fixed, linear], [1, size, kind - 8, kind - 31], 1)
    ok &= order <= size
    order = np.minimum(order, size)
    most = int(order[predicted].max(initial=0))
    coef, shift = np.zeros((most, len(at)), np.int64), np.zeros(len(at), np.int64)
    for n in range(1, 5):
        own = fixed & (kind == 8 + n)
        for j, c in enumerate(_FIXED[n]):
            if own.any():
                coef[j, own] = c
    x = np.zeros((size, len(at)), np.int64)
    rows = np.arange(len(at))
    k = np.zeros(len(at), np.int64)
    raw = np.zeros(len(at), bool)
    wide, parts, next_part = np.zeros(len(at), np.int64), np.full(len(at), size), np.where(predicted, order, size + 1)
    done = constant.copy()
    for i in range(size):
        warm = i < order
        all_warm, no_warm = warm.all(), not warm.any()
        if not no_warm:
            n = np.where(warm & ~(done & (i > 0)), bits, 0)
            x[i] = np.where(warm, r.signed(at, n), 0)
            at = at + n
            if all_warm:
                continue
        if (start := next_part == i).any():
            first = start & (order == i)
            if first.any():
                f = rows[first]
                lin = f[linear[f]]
                if len(lin):
                    precision = r.bits(at[lin], 4) + 1
                    ok[lin] &= precision < 16
                    shift[lin] = np.maximum(r.signed(at[lin] + 4, 5), 0)
                    at[lin] += 9
                    for j in range(most):
                        use = order[lin] > j
                        coef[j, lin[use]] = r.signed(at[lin[use]], precision[use])
                        at[lin[use]] += precision[use]
                method = r.bits(at[f], 2)
                ok[f] &= method < 2
                wide[f] = 4 + method
                parts[f] = size >> r.bits(at[f] + 2, 4)
                ok[f] &= parts[f] >= np.maximum(order[f], 1)
                parts[f] = np.maximum(parts[f], 1)
                at[f] += 6
            s = rows[start]
            k[s] = r.bits(at[s], wide[s])
            at[s] += wide[s]
            escape = k[s] == (1 << wide[s]) - 1
            raw[s] = escape
            if escape.any():
                e = s[escape]
                k[e] = r.bits(at[e], 5)
                at[e] += 5
            next_part[s] = (i // parts[s] + 1) * parts[s]
        live = predicted if no_warm else predicted & ~warm
        whole = bool(live.all())
        own = rows if whole else rows[live]
        if not len(own):
            continue
        pos, kk = (at, k) if whole else (at[own], k[own])
        q = r.zeros(pos)
        after = pos + q + 1
        u = (q << kk) | r.bits(after, kk)
        e = (u >> 1) ^ -(u & 1)
        end = after + kk
        if raw.any():
            flag = raw[own]
            e = np.where(flag, r.signed(pos, kk), e)
            end = np.where(flag, pos + kk, end)
        guess = np.zeros(len(own), np.int64)
        for j in range(min(most, i)):
            guess += coef[j, own] * x[i - 1 - j, own]
        if whole:
            x[i], at = e + (guess >> shift), end
        else:
            x[i, own] = e + (guess >> shift[own])
            at[own] = end
    if constant.any():
        x[:, constant] = x[0, constant]
    return x << wasted, at, ok


def decode(streams: list[bytes | None]) -> list[Stream]:
    """Each stream decoded, or with its error. Frames of all streams are decoded together."""
    out = [Stream() for _ in streams]
    data = np.frombuffer(b"".join(s or b"" for s in streams), np.uint8)
    ends = np.cumsum([len(s or b"") for s in streams])
    total, md5, own_bits = np.zeros(len(streams), np.int64), [b""] * len(streams), np.zeros(len(streams), np.int64)
    segment_stream, segment_at, segment_end = [], [], []
    for n, (raw, end) in enumerate(zip(streams, ends.tolist())):
        if raw is None or raw[:4] != b"fLaC":
            out[n].error = "not a FLAC stream"
            continue
        base, at, last, points = end - len(raw), 4, False, [0]
        while not last and at + 4 <= len(raw):
            last, kind, size = raw[at] >= 128, raw[at] & 127, int.from_bytes(raw[at + 1 : at + 4], "big")
            body = raw[at + 4 : at + 4 + size]
            if kind == 0 and size >= 34:
                layout = int.from_bytes(body[10:18], "big")
                out[n].sample_rate, out[n].channels, out[n].bits = layout >> 44, (layout >> 41 & 7) + 1, (layout >> 36 & 31) + 1
                total[n], md5[n], own_bits[n] = layout & (1 << 36) - 1, body[18:34], out[n].bits
            elif kind == 3:
                table = np.frombuffer(body[: len(body) // 18 * 18], np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
                points = sorted({0, *table["offset"][table["sample"] != (1 << 64) - 1].tolist()})
            at += 4 + size
        if not last or not out[n].bits:
            out[n].error = "damaged metadata"
            continue
        points = [p for p in points if at + p < len(raw)]
        segment_stream += [n] * len(points)
        segment_at += [base + at + p for p in points]
        segment_end += [*[base + at + p for p in points[1:]], end][: len(points)]
    reader, found = _Reader(data), []
    stream, at, end = np.array(segment_stream, np.int64), np.array(segment_at, np.int64), np.array(segment_end, np.int64)
    while len(at):
        rest = [x[FRAMES:] for x in (stream, at, end)]
        stream, at, end = (x[:FRAMES] for x in (stream, at, end))
        after, frames = _wave(reader, data, stream, at, end, own_bits, out)
        found += frames
        go = (after > 0) & (after < end)
        stream, at, end = (np.concatenate(x) for x in zip((stream[go], after[go], end[go]), rest))
    frames_of: list[list] = [[] for _ in streams]
    for n, offset, x in found:
        frames_of[n].append((offset, x))
    for n, s in enumerate(out):
        if s.error:
            continue
        frames = sorted(frames_of[n], key=lambda f: f[0])
        s.samples = np.concatenate([x for _, x in frames], axis=1) if frames else np.zeros((s.channels, 0), np.int64)
        first, base = 0, int(ends[n]) - len(streams[n])
        for offset, x in frames:
            s.blocks.append((first, x.shape[1], offset - base))
            first += x.shape[1]
        if total[n] and first != total[n]:
            s.error = f"{first} samples of {total[n]}"
        elif any(md5[n]):
            width = -(-s.bits // 8)
            plain = s.samples.T.astype("<i4").reshape(-1, 1).view(np.uint8)[:, :width].tobytes()
            if hashlib.md5(plain).digest() != md5[n]:
                s.error = "samples' checksum differs"
    return out


def _wave(r: _Reader, data: np.ndarray, stream: np.ndarray, at: np.ndarray, end: np.ndarray, own_bits: np.ndarray, out: list[Stream]) -> tuple[np.ndarray, list]:
    """Decodes the frame at each position. (position after each or -1, [(stream, offset, samples)]); errors go to the streams."""
    byte = lambda k: data[np.minimum(at + k, len(data) - 1)].astype(np.int64)
    ok = (byte(0) == 0xFF) & (byte(1) >> 1 == 0x7C)
    size_code, rate_code, layout, bits_code = byte(2) >> 4, byte(2) & 15, byte(3) >> 4, byte(3) >> 1 & 7
    lead = byte(4)
    more = np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, 0, 1, 2, 3, 4, 5], 6)
    head = 5 + more
    size = np.array(_SIZES)[size_code]
    own_size = (size_code >= 2) & (size_code <= 5)
    size = np.where(own_size, 576 << np.maximum(size_code - 2, 0), size)
    size = np.where(size_code == 6, r.bits((at + head) * 8, 8) + 1, np.where(size_code == 7, r.bits((at + head) * 8, 16) + 1, size))
    head = head + np.select([size_code == 6, size_code == 7], [1, 2], 0)
    head = head + np.select([rate_code == 12, (rate_code == 13) | (rate_code == 14)], [1, 2], 0)
    bits = np.where(bits_code == 0, own_bits[stream], np.array(_BITS)[bits_code])
    channels = np.where(layout < 8, layout + 1, 2)
    ok &= (size > 0) & (bits > 0) & (bits <= 32) & (layout <= 10) & (at + head < end)
    check = _CRC8.of(_rows(data, at, np.minimum(at + head, len(data))))
    ok &= check == data[np.minimum(at + head, len(data) - 1)]
    for n in stream[~ok]:
        out[n].error = out[n].error or "damaged frame header"
    after, frames = np.full(len(at), -1), []
    good = np.flatnonzero(ok)
    if not len(good):
        return after, frames
    key = size[good] << 16 | layout[good] << 8 | bits[good]
    for value in np.unique(key):
        own = good[key == value]
        n, pos, planes = int(size[own[0]]), (at[own] + head[own] + 1) * 8, []
        fine = np.ones(len(own), bool)
        for c in range(int(channels[own[0]])):
            side = (layout[own[0]] in (8, 10) and c == 1) or (layout[own[0]] == 9 and c == 0)
            x, pos, good_c = _subframes(r, pos, n, bits[own] + side)
            fine &= good_c & (pos <= end[own] * 8)
            pos = np.minimum(pos, len(data) * 8)
            planes.append(x)
        if layout[own[0]] == 8:
            planes[1] = planes[0] - planes[1]
        elif layout[own[0]] == 9:
            planes[0] = planes[0] + planes[1]
        elif layout[own[0]] == 10:
            mid = planes[0] * 2 + (planes[1] & 1)
            planes = [(mid + planes[1]) >> 1, (mid - planes[1]) >> 1]
        stop = (pos + 7) // 8
        fine &= stop + 2 <= end[own]
        stop = np.where(fine, stop, at[own])
        crc = _CRC16.of(_rows(data, at[own], stop))
        fine &= crc == r.bits(stop * 8, 16)
        joined = np.stack([p.T for p in planes], axis=1)
        for j in np.flatnonzero(~fine):
            out[stream[own[j]]].error = out[stream[own[j]]].error or "damaged frame"
        for j in np.flatnonzero(fine).tolist():
            frames.append((int(stream[own[j]]), int(at[own[j]]), joined[j]))
        after[own] = np.where(fine, stop + 2, -1)
    return after, frames

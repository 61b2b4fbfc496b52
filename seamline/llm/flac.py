"""FLAC streams in numpy: an encoder for 8-bit mono, and a decoder.

The decoder takes many frames at once, a lane each: it checks header CRC-8 and
frame CRC-16, reads constant, verbatim, fixed and linear-prediction subframes
(partitioned Rice residuals with 4 or 5 bit parameters and escapes, wasted
bits, up to eight channels, side stereo), and steps through all lanes' Rice
codes and predictors together. Decoded blocks carry the offset of their first
sample, from the frame headers; a stream with a seek table has its frames laid
out at once, any other is walked frame by frame. A stream whose checks fail, or
whose MD5 differs, raises ``ValueError``.

``encode_texts`` makes a stream of every whole text (null: empty);
``stream_features`` decodes the streams of a column and derives its columns
from what came back; ``decode_blocks`` gives PCM blocks. Equal texts have equal
values, so repeated rows do; there are no ties; a long text stands alone in a
chunk; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm import textkit as tk
from seamline.llm.shared import written

BLOCK_SIZE = 1024  # many short frames are many lanes
RATE = 8000
LPC_ORDER, LPC_PRECISION, LPC_SHIFT = 4, 12, 9
CHUNK = 1 << 20
#: The format's codes, fixed values.
BLOCK_CODES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _crc_table(poly: int, bits: int) -> list[int]:
    out = []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c >> (bits - 1) else 0)
            c &= (1 << bits) - 1
        out.append(c)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), np.array(_crc_table(0x8005, 16), np.uint16)
_far = [_CRC16]  # what a byte adds to the CRC-16 when d more bytes follow it


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of each byte range; the CRC is linear, so every byte's share is looked up by its distance from the end."""
    size = end - start
    while len(_far) < int(size.max(initial=1)):
        last = _far[-1]
        _far.append((last << np.uint16(8)) ^ _CRC16[last >> np.uint16(8)])
    if len(_far) > getattr(crc16, "rows", 0):
        crc16.table, crc16.rows = np.stack(_far), len(_far)
    first = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(first, size)
    share = crc16.table[np.repeat(size, size) - 1 - within, raw[np.repeat(start, size) + within]]
    return np.bitwise_xor.reduceat(share, first) if len(size) else np.empty(0, np.uint16)


def _coded_number(n: int) -> bytes:
    """The extended UTF-8 form of a frame or sample number."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x40
    while True:
        tail.append(0x80 | (n & 0x3F))
        n >>= 6
        limit >>= 1
        if n < limit:
            break
    return bytes([(0xFF << (7 - len(tail))) & 0xFF | n, *reversed(tail)])


class _Writer:
    """Fields of bits, gathered and then laid down at once: fields don't overlap, so the words are sums."""

    def __init__(self, n_bytes: int):
        self.words = np.zeros(n_bytes // 4 + 2)

    def put(self, pos: np.ndarray, value: np.ndarray, width) -> None:
        """Each value's low ``width`` bits (a number or an array, 32 at most) at its bit position."""
        width = np.asarray(width, np.uint64)
        v = np.asarray(value).astype(np.int64).view(np.uint64) & ((np.uint64(1) << width) - np.uint64(1))
        v <<= np.uint64(64) - (pos & 31).astype(np.uint64) - width
        word = pos >> 5
        for k, part in enumerate((v >> np.uint64(32), v & np.uint64(0xFFFFFFFF))):
            self.words += np.bincount(word + k, part, len(self.words))

    def bytes(self, n: int) -> np.ndarray:
        return self.words.astype(np.uint64).astype(">u4").view(np.uint8)[:n].copy()


def _zigzag(e: np.ndarray) -> np.ndarray:
    return (e << 1) ^ (e >> 31)


def _levinson(r: np.ndarray) -> np.ndarray:
    """Prediction coefficients for each row of autocorrelations (float64, order LPC_ORDER)."""
    n, order = len(r), LPC_ORDER
    a, err = np.zeros((n, order)), np.maximum(r[:, 0].copy(), 1.0)
    for i in range(order):
        acc = r[:, i + 1] - sum((a[:, j] * r[:, i - j] for j in range(i)), np.zeros(n))
        k = acc / err
        new = a.copy()
        new[:, i] = k
        for j in range(i):
            new[:, j] = a[:, j] - k * a[:, i - 1 - j]
        a = new
        err = np.maximum(err * (1 - k * k), 1e-6)
    return a


def encode(raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A FLAC stream (8-bit mono, blocks of ``BLOCK_SIZE`` samples, seek table) for each byte string of positive length."""
    size = np.diff(offsets)
    per = -(-size // BLOCK_SIZE)
    owner = np.repeat(np.arange(len(size)), per)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    start = offsets[:-1][owner] + number * BLOCK_SIZE
    n = np.minimum(BLOCK_SIZE, offsets[1:][owner] - start)
    x = (raw ^ np.uint8(0x80)).view(np.int8).astype(np.int32)

    # 16 bits hold the samples, the predictions and the residuals of 8-bit sound
    lags = [x.astype(np.int16)]
    for k in range(1, LPC_ORDER + 1):
        lags.append(np.concatenate([np.zeros(min(k, len(x)), np.int16), lags[0][:-k]])[: len(x)])

    def first_of(k: int) -> np.ndarray:
        """The frames' first ``k`` samples, which are not predicted."""
        return np.concatenate([(start[n > j] + j) for j in range(k)]) if k else start[:0]

    auto = np.empty((len(n), LPC_ORDER + 1))
    for k in range(LPC_ORDER + 1):
        product = x * lags[k]
        product[first_of(k)] = 0
        auto[:, k] = np.add.reduceat(product, start)
    coef = np.clip(np.rint(_levinson(auto) * (1 << LPC_SHIFT)), -(1 << (LPC_PRECISION - 1)), (1 << (LPC_PRECISION - 1)) - 1).astype(np.int32)
    kinds = ks = cost = us = None
    for kind, order in ((0, 0), (1, 1), (2, 2), (9, LPC_ORDER)):
        if kind == 9:
            pred = np.repeat(coef[:, 0], n) * lags[1]
            for j in range(1, order):
                pred += np.repeat(coef[:, j], n) * lags[j + 1]
            pred >>= LPC_SHIFT
            e = lags[0] - pred.astype(np.int16)
        else:
            e = lags[0].copy()
            for c, earlier in zip(FIXED[order], lags[1:], strict=False):
                e -= np.int16(c) * earlier
        e[first_of(order)] = 0
        u = ((e << 1) ^ (e >> 15)).view(np.uint16)
        total = np.add.reduceat(u, start, dtype=np.int64)
        k = np.clip(np.floor(np.log2(np.maximum(total / (n - order), 1))), 0, 14).astype(np.int64)
        c = (n - order) * (k + 1) + (total >> k) + 8 * order + (9 + LPC_PRECISION * order if kind == 9 else 0)
        if us is None:
            cost, kinds, ks, us = c, np.full(len(n), kind), k, u
        else:
            win = c < cost
            cost, kinds, ks = np.where(win, c, cost), np.where(win, kind, kinds), np.where(win, k, ks)
            us = np.where(np.repeat(win, n), u, us)
    us = us.astype(np.int32)
    low, high = np.minimum.reduceat(x, start), np.maximum.reduceat(x, start)
    kinds = np.where(cost >= 8 * n, -1, kinds)
    kinds = np.where(low == high, -2, kinds)  # constant
    orders = np.select([kinds == 9, kinds >= 0], [LPC_ORDER, kinds], 0)
    rice = kinds >= 0
    k = np.repeat(ks.astype(np.int32), n)
    coded = np.repeat(rice, n)
    for j in range(LPC_ORDER):
        coded[start[rice & (orders > j)] + j] = False
    plain = np.repeat(kinds == -1, n)
    q = np.where(coded, us >> k, 0)
    width = np.where(coded, q + 1 + k, np.where(plain, np.int32(8), np.int32(0)))
    body = np.add.reduceat(width, start, dtype=np.int64)

    heads = []
    for i, m in zip(number.tolist(), n.tolist(), strict=True):
        full = m == BLOCK_SIZE
        h = bytes([0xFF, 0xF8, (10 if full else 7) << 4 | 4, 0x02]) + _coded_number(i) + (b"" if full else (m - 1).to_bytes(2))
        heads.append(h + bytes([crc8(h)]))
    head_bits = np.array([8 * len(h) for h in heads], np.int64)
    warm = 8 * orders + np.where(kinds == 9, 9 + LPC_PRECISION * LPC_ORDER, 0) + np.where(kinds == -2, 8, 0)
    total_bits = head_bits + 8 + warm + np.where(rice, 10, 0) + body
    frame_bytes = (total_bits + 7) // 8 + 2
    first = np.cumsum(frame_bytes) - frame_bytes
    bits = _Writer(int(frame_bytes.sum()))
    base = first * 8
    types = np.select([kinds == -2, kinds == -1, kinds == 9], [0, 1, 32 + LPC_ORDER - 1], 8 + kinds)
    pos = base + head_bits
    fields = [(pos, types << 1, np.full(len(pos), 8))]
    pos = pos + 8
    const = kinds == -2
    fields.append((pos[const], low[const] & 0xFF, np.full(int(const.sum()), 8)))
    for j in range(LPC_ORDER):
        has = orders > j
        fields.append((pos[has] + 8 * j, x[start[has] + j] & 0xFF, np.full(int(has.sum()), 8)))
    pos = pos + 8 * orders + np.where(const, 8, 0)
    lpc = kinds == 9
    fields.append((pos[lpc], np.full(int(lpc.sum()), (LPC_PRECISION - 1) << 5 | LPC_SHIFT), np.full(int(lpc.sum()), 9)))
    for j in range(LPC_ORDER):
        fields.append((pos[lpc] + 9 + LPC_PRECISION * j, coef[lpc, j] & ((1 << LPC_PRECISION) - 1), np.full(int(lpc.sum()), LPC_PRECISION)))
    pos = pos + np.where(lpc, 9 + LPC_PRECISION * LPC_ORDER, 0)
    fields.append((pos[rice] + 6, ks[rice], np.full(int(rice.sum()), 4)))  # method 0, one partition
    bits.put(*(np.concatenate([f[k] for f in fields]) for k in range(3)))
    pos = pos + np.where(rice, 10, 0)
    before = np.cumsum(width, dtype=np.int64)
    before -= width
    sample = before + np.repeat(pos - before[start], n)
    # a Rice code is q zeros, a one and k bits; a verbatim sample its 8 bits
    some = coded | plain
    value = np.where(plain, x & 0xFF, (us & ((1 << k) - 1)) | (1 << k))[some]
    bits.put((sample + q)[some], value, np.where(plain, 8, k + 1)[some])
    out = bits.bytes(int(frame_bytes.sum()))
    for f, h in zip(first.tolist(), heads, strict=True):
        out[f : f + len(h)] = np.frombuffer(h, np.uint8)
    end = first + frame_bytes
    crc = crc16(out, first, end - 2)
    out[end - 2], out[end - 1] = crc >> 8, crc & 0xFF

    streams, f0 = [], np.cumsum(per) - per
    for i, (a, m) in enumerate(zip(f0.tolist(), per.tolist(), strict=True)):
        data = out[first[a] : end[a + m - 1]].tobytes()
        sizes = frame_bytes[a : a + m]
        info = BLOCK_SIZE.to_bytes(2) * 2 + int(sizes.min()).to_bytes(3) + int(sizes.max()).to_bytes(3)
        info += (RATE << 44 | 0 << 41 | 7 << 36 | int(size[i])).to_bytes(8)
        info += hashlib.md5((raw[offsets[i] : offsets[i + 1]] ^ np.uint8(0x80)).tobytes(), usedforsecurity=False).digest()
        points = b"".join((j * BLOCK_SIZE).to_bytes(8) + int(first[a + j] - first[a]).to_bytes(8) + int(n[a + j]).to_bytes(2) for j in range(m))
        streams.append(b"fLaC" + b"\x00" + len(info).to_bytes(3) + info + b"\x83" + len(points).to_bytes(3) + points + data)
    return streams


@dataclass
class Stream:
    """A decoded stream: samples of each channel, and each block's first sample."""

    rate: int
    channels: int
    bits: int
    md5: bytes
    total: int
    at: int  # first frame's byte
    seek: list[tuple[int, int, int]]
    blocks: list[tuple[int, np.ndarray]] = field(default_factory=list)  # (sample offset, (channels, samples))

    def pcm(self) -> np.ndarray:
        return np.concatenate([b for _, b in self.blocks], axis=1) if self.blocks else np.empty((self.channels, 0), np.int64)


def read_metadata(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise ValueError("no FLAC marker")
    at, last, info, seek = 4, False, None, []
    while not last:
        last, kind, n = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4])
        body = data[at + 4 : at + 4 + n]
        at += 4 + n
        if kind == 0:
            v = int.from_bytes(body[10:18])
            info = (v >> 44, (v >> 41 & 7) + 1, (v >> 36 & 31) + 1, body[18:34], v & (1 << 36) - 1)
        elif kind == 3:
            points = [tuple(int.from_bytes(body[i + a : i + b]) for a, b in ((0, 8), (8, 16), (16, 18))) for i in range(0, n, 18)]
            seek = [p for p in points if p[0] != (1 << 64) - 1]
    if info is None:
        raise ValueError("no STREAMINFO")
    return Stream(*info, at, seek)


_LEADING = np.concatenate([[16], 15 - np.floor(np.log2(np.arange(1, 1 << 16)))]).astype(np.uint8)  # zeros in front, of 16 bits


class _Lanes:
    """Bit positions in one buffer, a lane each."""

    def __init__(self, raw: np.ndarray):
        self.n = len(raw) * 8
        pad = np.append(raw, np.zeros(16, np.uint8)).astype(np.uint32)
        self.word = pad[:-3] << np.uint32(24) | pad[1:-2] << np.uint32(16) | pad[2:-1] << np.uint32(8) | pad[3:]  # 32 bits from each byte on

    def read(self, pos: np.ndarray, width) -> np.ndarray:
        """The unsigned values of ``width`` bits (a number or an array, 33 at most) at each position."""
        width, pos = np.asarray(width, np.uint64), np.minimum(pos, self.n)
        at = pos >> 3
        v = (self.word[at].astype(np.uint64) << np.uint64(32) | self.word[at + 4]) << (pos & 7).astype(np.uint64)
        return np.where(width > 0, v >> np.minimum(np.uint64(64) - width, np.uint64(63)), np.uint64(0)).astype(np.int64)

    def signed(self, pos: np.ndarray, width) -> np.ndarray:
        v = self.read(pos, width)
        return np.where(v >> (np.asarray(width) - 1) & 1 == 1, v - (np.int64(1) << np.asarray(width)), v)

    def zeros(self, pos: np.ndarray) -> np.ndarray:
        """How many zeros stand in front of the next one at each position."""
        out, todo = np.zeros(len(pos), np.int64), np.arange(len(pos))
        while len(todo):
            here = pos[todo] + out[todo]
            if (here >= self.n).any():
                raise ValueError("residuals run past the data")
            z = _LEADING[self.read(here, 16)].astype(np.int64)
            out[todo] += z
            todo = todo[z == 16]
        return out

    def rice(self, pos: np.ndarray, count: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, end positions): a (steps, lanes) matrix of zigzag-decoded residuals; lanes in step."""
        order = np.argsort(-count, kind="stable")
        p, c, kk = pos[order].astype(np.int64), count[order], k[order].astype(np.uint32)
        steps = int(c[0]) if len(c) else 0
        live = np.searchsorted(-c, -np.arange(steps), "left").tolist()
        u = np.zeros((steps, len(c)), np.uint32)
        jump, down = (kk + 1).astype(np.int64), np.uint32(32) - np.maximum(kk, 1)
        word, last, seven, half = self.word, len(self.word) - 1, 7, np.uint32(16)
        plain = kk > 0
        for i in range(steps):
            m = live[i]
            here = p[:m]
            w = word[np.minimum(here >> 3, last)]
            w <<= (here & seven).astype(np.uint32)
            q = _LEADING[w >> half]
            # the word has 25 sure bits and 16 are looked up: a longer code is read by itself
            far = np.flatnonzero((q == 16) | (q + jump[:m] > 25))
            w <<= q
            w <<= np.uint32(1)
            w >>= down[:m]
            got = np.where(plain[:m], w, np.uint32(0))
            zeros = q.astype(np.int64)
            if len(far):
                zeros[far] = self.zeros(here[far])
                got[far] = self.read(here[far] + zeros[far] + 1, kk[far])
            u[i, :m] = zeros.astype(np.uint32) << kk[:m] | got
            here += zeros
            here += jump[:m]
            if i & 255 == 255 and p.max() > self.n:
                raise ValueError("residuals run past the data")
        e = (u >> np.uint32(1)).view(np.int32)
        u &= np.uint32(1)
        e ^= -u.view(np.int32)
        out, ends = np.empty_like(e), np.empty(len(c), np.int64)
        out[:, order], ends[order] = e, p
        return out, ends


def _number(data: bytes, at: int) -> tuple[int, int]:
    b = data[at]
    if b < 0x80:
        return b, at + 1
    n = 8 - (b ^ 0xFF).bit_length()
    if n < 2:
        raise ValueError("bad frame number")
    v = b & (0x7F >> n)
    for c in data[at + 1 : at + n]:
        v = v << 6 | c & 0x3F
    return v, at + n


def _header(data: bytes, at: int, s: Stream, block: int) -> tuple[int, int, int, int, int]:
    """(first sample, samples, channel code, bits, byte after the header) of the frame at ``at``."""
    if data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise ValueError(f"no frame at byte {at}")
    code, rate = data[at + 2] >> 4, data[at + 2] & 15
    number, p = _number(data, at + 4)
    if code in (6, 7):
        n, p = int.from_bytes(data[p : p + code - 5]) + 1, p + code - 5
    elif code in BLOCK_CODES:
        n = BLOCK_CODES[code]
    else:
        raise ValueError("bad block size")
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(data[at:p]) != data[p]:
        raise ValueError(f"header checksum differs at byte {at}")
    size = data[at + 3] >> 1 & 7
    bits = SAMPLE_BITS.get(size, s.bits) if size else s.bits
    return number if data[at + 1] & 1 else number * block, n, data[at + 3] >> 4, bits, p + 1


def _subframes(lanes: _Lanes, pos: np.ndarray, n: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((steps, lanes) samples, end positions) of a subframe in each lane."""
    kind = lanes.read(pos + 1, 6)
    wasted = lanes.read(pos + 7, 1)
    pos = pos + 8
    if wasted.any():
        run = np.zeros(len(pos), np.int64)
        run[wasted == 1] = lanes.zeros(pos[wasted == 1]) + 1
        pos, wasted = pos + run, run
    depth = depth - wasted
    steps, count = int(n.max()), len(n)
    out = np.zeros((steps, count), np.int32 if depth.max(initial=0) <= 24 else np.int64)
    at = np.flatnonzero(kind == 0)
    out[:, at] = lanes.signed(pos[at], depth[at])[None, :]
    pos[at] += depth[at]
    for i in np.flatnonzero(kind == 1):
        out[: n[i], i] = lanes.signed(pos[i] + np.arange(n[i]) * depth[i], np.full(n[i], depth[i]))
        pos[i] += n[i] * depth[i]
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if not (fixed | lpc | (kind <= 1)).all():
        raise ValueError("reserved subframe type")
    at = np.flatnonzero(fixed | lpc)
    if len(at):
        order = np.where(lpc, kind - 31, kind - 8)[at]
        top = int(order.max())
        for j in range(top):
            has = at[order > j]
            out[j, has] = lanes.signed(pos[has] + j * depth[has], depth[has])
        p = pos[at] + order * depth[at]
        coef, shift = np.zeros((top, len(at)), np.int64), np.zeros(len(at), np.int64)
        for o in range(1, min(4, top) + 1):
            mine = fixed[at] & (order == o)
            coef[:o, mine] = np.array(FIXED[o])[:, None]
        linear = np.flatnonzero(lpc[at])
        if len(linear):
            precision = lanes.read(p[linear], 4) + 1
            shift[linear] = lanes.signed(p[linear] + 4, 5)
            p[linear] += 9
            for j in range(top):
                has = order[linear] > j
                coef[j, linear[has]] = lanes.signed(p[linear[has]] + j * precision[has], precision[has])
            p[linear] += order[linear] * precision
        method, parts = lanes.read(p, 2), 1 << lanes.read(p + 2, 4)
        if (method > 1).any():
            raise ValueError("reserved residual method")
        p = p + 6
        done = order.copy()
        for part in range(int(parts.max())):
            here = np.flatnonzero(parts > part)
            width = np.where(method[here] == 1, 5, 4)
            k = lanes.read(p[here], width)
            p[here] += width
            todo = n[at[here]] // parts[here] - (order[here] if part == 0 else 0)
            escape = k == (1 << width) - 1
            for i in np.flatnonzero(escape):
                w = int(lanes.read(p[here[i] : here[i] + 1], 5)[0])
                p[here[i]] += 5
                if w:
                    out[done[here[i]] + np.arange(todo[i]), at[here[i]]] = lanes.signed(p[here[i]] + np.arange(todo[i]) * w, np.full(todo[i], w))
                    p[here[i]] += todo[i] * w
            coded = np.flatnonzero(~escape)
            if len(coded):
                rows = here[coded]
                e, p[rows] = lanes.rice(p[rows], todo[coded], k[coded])
                if part == 0 and (done[rows] == done[rows][0]).all():
                    d = int(done[rows][0])
                    out[d : d + len(e), at[rows]] = np.where(np.arange(len(e))[:, None] < todo[coded], e, 0)
                else:
                    for c, r in enumerate(rows):
                        out[done[r] + np.arange(todo[coded[c]]), at[r]] = e[: todo[coded[c]], c]
            done[here] += todo
        pos[at] = p
        _restore(out, at, order, coef, shift, n[at], int(depth.max()) if top <= 12 else 64)
    out <<= wasted
    return out, pos


def _restore(out: np.ndarray, at: np.ndarray, order: np.ndarray, coef: np.ndarray, shift: np.ndarray, n: np.ndarray, depth: int) -> None:
    """Adds the predictions to the residuals in place, all lanes of an order in step."""
    for o in np.unique(order[order > 0]):
        mine = np.flatnonzero(order == o)
        mine = mine[np.argsort(-n[mine], kind="stable")]
        kind = np.int32 if depth <= 12 else np.int64  # twelve products of 12 and 15 bits fit 32
        cols, c, s = at[mine], np.ascontiguousarray(coef[:o, mine][::-1]).astype(kind), shift[mine].astype(kind)
        x = out[:, cols].astype(kind)
        work = np.empty_like(c)
        live = np.searchsorted(-n[mine], -np.arange(int(n[mine[0]])), "left").tolist()
        for i in range(int(o), int(n[mine[0]])):
            m = live[i]
            np.multiply(x[i - o : i, :m], c[:, :m], out=work[:, :m])
            more = np.add.reduce(work[:, :m], axis=0)
            more >>= s[:m]
            x[i, :m] += more
        out[:, cols] = x


def decode(streams: list[bytes]) -> list[Stream]:
    """Decodes whole streams; every checksum is verified."""
    out = [read_metadata(s) for s in streams]
    begin = np.cumsum([0, *map(len, streams)])
    raw = np.frombuffer(b"".join(streams), np.uint8)
    lanes = _Lanes(raw)
    block = [int.from_bytes(s[10:12]) for s in streams]
    # frames by the seek table where there is one, else one a round
    wave = [(i, s.at + o) for i, s in enumerate(out) for o in ([p[1] for p in s.seek] or [0]) if s.at < len(streams[i])]
    seen: list[dict[int, int]] = [{} for _ in streams]  # frame's byte -> the byte after it
    while wave:
        heads = [_header(streams[i], at, out[i], block[i]) for i, at in wave]
        stream = np.array([i for i, _ in wave])
        base = begin[stream]
        first, n, code, bits, after = (np.array(c) for c in zip(*heads, strict=True))
        pos = (base + after) * 8
        chans = np.where(code <= 7, code + 1, 2)
        parts = []
        for c in range(int(chans.max())):
            has = np.flatnonzero(chans > c)
            side = ((code[has] == 8) & (c == 1)) | ((code[has] == 9) & (c == 0)) | ((code[has] == 10) & (c == 1))
            x, pos[has] = _subframes(lanes, pos[has], n[has], bits[has] + side)
            parts.append((has, x))
        end = (pos + 7) // 8
        start = base + np.array([at for _, at in wave])
        if (end + 2 > base + np.array([len(s) for s in streams])[stream]).any():
            raise ValueError("a frame runs past its stream")
        if (crc16(raw, start, end) != (raw[end].astype(np.uint16) << np.uint16(8) | raw[end + 1])).any():
            raise ValueError("frame checksum differs")
        where = [{int(r): k for k, r in enumerate(has)} for has, _ in parts]
        nxt = []
        for r, (i, at) in enumerate(wave):
            ch = [x[: n[r], w[r]] for (_, x), w in zip(parts, where, strict=True) if r in w]
            if code[r] == 8:
                ch[1] = ch[0] - ch[1]
            elif code[r] == 9:
                ch[0] = ch[0] + ch[1]
            elif code[r] == 10:
                mid = ch[0] << 1 | ch[1] & 1
                ch = [(mid + ch[1]) >> 1, (mid - ch[1]) >> 1]
            out[i].blocks.append((int(first[r]), np.stack(ch)))
            seen[i][at] = stop = int(end[r] + 2 - begin[i])
            if stop < len(streams[i]):
                nxt.append((i, stop))
        wave = [(i, at) for i, at in nxt if at not in seen[i]]
    for i, s in enumerate(out):
        s.blocks.sort(key=lambda b: b[0])
        at = 0
        for first_sample, b in s.blocks:
            if first_sample != at:
                raise ValueError(f"a block starts at sample {first_sample}, expected {at}")
            at += b.shape[1]
        if s.total and at != s.total:
            raise ValueError(f"{at} samples, STREAMINFO has {s.total}")
        if s.md5.strip(b"\0") and hashlib.md5(pcm_bytes(s), usedforsecurity=False).digest() != s.md5:
            raise ValueError("MD5 differs")
    return out


def pcm_bytes(s: Stream) -> bytes:
    """Interleaved little-endian samples of whole bytes, as the MD5 is taken."""
    x, width = s.pcm().T.ravel(), (s.bits + 7) // 8
    return x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def decode_blocks(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """PCM blocks of the FLAC streams in a binary column: columns ``keep``, block int, sample_offset long, samples int, channels int, bits int, pcm binary (interleaved, little-endian). Null streams give no rows."""
    chosen = df.select(*keep, F.col(column).alias("_flac")).where("_flac IS NOT NULL")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(len(keep)).to_pylist()
            lo = 0
            while lo < len(data):
                hi, size = lo + 1, len(data[lo])
                while hi < len(data) and size + len(data[hi]) <= CHUNK:
                    size += len(data[hi])
                    hi += 1
                rows, cols = [], ([], [], [], [], [], [])
                for r, s in enumerate(decode(data[lo:hi]), start=lo):
                    for k, (first, x) in enumerate(s.blocks):
                        rows.append(r)
                        part = Stream(s.rate, s.channels, s.bits, b"", 0, 0, [], [(first, x)])
                        for c, v in zip(cols, (k, first, x.shape[1], s.channels, s.bits, pcm_bytes(part)), strict=True):
                            c.append(v)
                types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                taken = batch.take(pa.array(rows, pa.int64()))
                yield pa.record_batch([*taken.columns[: len(keep)], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*keep, "block", "sample_offset", "samples", "channels", "bits", "pcm"])
                lo = hi

    return chosen.mapInArrow(run, f"{ddl}, block int, sample_offset long, samples int, channels int, bits int, pcm binary")


def _feature(s: Stream, x: np.ndarray) -> str:
    turns = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    wide = x.astype(np.int64)
    return f"frames={len(s.blocks)};mean={int(wide.sum()) // len(x)};energy={int(np.vdot(wide, wide)) // len(x)};peak={int(np.abs(wide).max())};crossings={turns}"


def encode_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, flac) of every text: its UTF-8 bytes, padded with zero bytes to a positive multiple of 64, as 8-bit samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in tk.column_chunks(batch, "text", CHUNK):
                size = np.diff(off)
                padded = np.maximum(64, -(-size // 64) * 64)
                at = np.append(0, np.cumsum(padded))
                payload = np.zeros(int(at[-1]), np.uint8)
                payload[np.repeat(at[:-1] - off[:-1], size) + np.arange(len(raw))] = raw
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(size), pa.array(encode(payload, at), pa.binary())], names=["doc_id", "n_bytes", "flac"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, flac binary")


def stream_features(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) from the streams of column ``flac`` (8-bit mono) alone."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = tk.string_buffers(batch.column(2))
            for lo, hi in tk.row_chunks(off, CHUNK):
                stored, rows = batch.column(2).slice(lo, hi - lo).to_pylist(), []
                for data, s in zip(stored, decode(stored), strict=True):
                    x = s.pcm()[0]
                    back = (x + 128).astype(np.uint8).tobytes()
                    rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data), hashlib.sha256(data).hexdigest(), _feature(s, x)))
                yield pa.record_batch([*(batch.column(k).slice(lo, hi - lo) for k in (0, 1)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=names)

    return encoded.select("doc_id", "n_bytes", "flac").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def audio_features(docs: DataFrame, store: bool = False) -> DataFrame:
    """The features of every text's stream. ``store`` writes the streams to the shared folder first; else they go on as a column, which the decoder alone sees."""
    encoded = encode_texts(docs)
    return stream_features(written(encoded, "flac") if store else encoded)

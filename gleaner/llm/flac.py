"""FLAC with 8-bit mono samples in blocks of 576: encoder and decoder over many frames at a time.

All frames of many files are coded side by side: the k-th residual of every frame is read in one step,
with bit positions, Rice parameters and predictors kept per frame.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

import numpy as np

BLOCK = 576
RATE = 8000
#: Frames between two points of a file's seek table.
SEEK_EVERY = 16
#: Order and coefficient precision of the encoder's linear predictor; the decoder takes any.
ORDER, PRECISION = 2, 10
#: The sample that stands for each byte: zero is 108, amid the lower-case letters, and the blank changes places with
#: the grave accent next to them, so that texts swing little. A bijection, which the decoder undoes.
SAMPLE_OF = np.arange(256)
SAMPLE_OF[[0x20, 0x60]] = 0x60, 0x20
SAMPLE_OF = (SAMPLE_OF - 108).astype(np.int8)
BYTE_OF = np.argsort(SAMPLE_OF.view(np.uint8)).astype(np.uint8)
#: Fixed predictors of the format.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
MAX_ORDER = 32


def _table(bits: int, poly: int) -> np.ndarray:
    c = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        c = np.where(c & (1 << (bits - 1)), (c << 1) ^ poly, c << 1) & ((1 << bits) - 1)
    return c


CRC8, CRC16 = _table(8, 0x07), _table(16, 0x8005)


def crcs(rows: np.ndarray, length: np.ndarray, bits: int) -> np.ndarray:
    """CRC-8 or CRC-16 of the first ``length`` bytes of every row."""
    table, crc = (CRC8, CRC16)[bits == 16], np.zeros(len(rows), np.int64)
    for j in range(int(length.max(initial=0))):
        new = table[((crc >> (bits - 8)) & 255) ^ rows[:, j]] ^ ((crc << 8) & ((1 << bits) - 1))
        crc = np.where(j < length, new, crc)
    return crc


def coded_numbers(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's variable-length code: bytes (rows of 6) and lengths."""
    length = 1 + (n >= 0x80) + (n >= 0x800) + (n >= 0x10000) + (n >= 0x200000) + (n >= 0x4000000)
    out = np.zeros((len(n), 6), np.int64)
    out[:, 0] = n
    for k in range(2, 7):
        own = length == k
        out[own, 0] = (0xFF00 >> k & 0xFF) | n[own] >> 6 * (k - 1)
        for j in range(1, k):
            out[own, j] = 0x80 | n[own] >> 6 * (k - 1 - j) & 0x3F
    return out, length


def predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised linear predictors of every frame by Levinson's recursion: coefficients and shifts."""
    n = len(x)
    window = 1 - ((np.arange(BLOCK) - (BLOCK - 1) / 2) / (BLOCK / 2)) ** 2
    y = x * window
    auto = np.stack([(y[:, : BLOCK - k] * y[:, k:]).sum(1) for k in range(ORDER + 1)], 1)
    error, a = auto[:, 0] * (1 + 1e-9) + 1e-9, np.zeros((n, ORDER))
    for k in range(ORDER):
        r = (auto[:, k + 1] - (a[:, :k] * auto[:, k:0:-1]).sum(1)) / error
        a[:, :k] -= r[:, None] * a[:, :k][:, ::-1].copy()
        a[:, k] = r
        error = np.maximum(error * (1 - r**2), 1e-9)
    top = np.maximum(np.abs(a).max(1), 1e-6)
    shift = np.clip(PRECISION - 1 - np.ceil(np.log2(top)).astype(np.int64), 0, 14)
    limit = 1 << (PRECISION - 1)
    return np.clip(np.round(a * (1 << shift)[:, None]), -limit, limit - 1).astype(np.int64), shift


def rice(residual: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded residuals without the first ``skip``, the best Rice parameter and its number of bits."""
    u = np.where(residual >= 0, 2 * residual, -2 * residual - 1)[:, skip:]
    bits = np.stack([(u >> k).sum(1) + u.shape[1] * (1 + k) for k in range(15)], 1)
    k = bits.argmin(1)
    return u, k, bits[np.arange(len(u)), k]


def encode_frames(x: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """One frame for each row of samples (rows x BLOCK), with the given frame numbers."""
    n = len(x)
    coded, coded_size = coded_numbers(numbers)
    head_size = 4 + coded_size + 1
    coef, shift = predictors(x.astype(float))
    guess = np.zeros_like(x)
    for j in range(ORDER):
        guess[:, ORDER:] += coef[:, j, None] * x[:, ORDER - 1 - j : BLOCK - 1 - j]
    ways = [("fixed", k, *rice(np.diff(x, k, axis=1, prepend=np.zeros((n, k), np.int64)) if k else x, k)) for k in range(3)]
    ways.append(("lpc", ORDER, *rice(x - (guess >> shift[:, None]), ORDER)))
    cost = np.stack([8 * order + 10 + bits + (9 + ORDER * PRECISION) * (kind == "lpc") for kind, order, _, _, bits in ways] + [np.full(n, 8 * BLOCK)], 1)
    choice = cost.argmin(1)
    same = (x == x[:, :1]).all(1)
    total = head_size * 8 + 8 + np.where(same, 8, cost.min(1))
    size = -(-total // 8)
    bits = np.zeros((n, int(size.max()) * 8), np.uint8)
    at = head_size * 8

    def put(rows: np.ndarray, where: np.ndarray, value: np.ndarray, width: int) -> None:
        for b in range(width):
            bits[rows, where + b] = value >> (width - 1 - b) & 1

    every = np.arange(n)
    kind = np.where(same, 0, np.where(choice == len(ways), 1, np.where(choice == len(ways) - 1, 32 + ORDER - 1, 8 + choice)))
    put(every, at, kind << 1, 8)
    put(every[same], at[same] + 8, x[same, 0], 8)
    for j in range(BLOCK if (plain := every[(kind == 1)]).size else 0):
        put(plain, at[plain] + 8 + 8 * j, x[plain, j], 8)
    for w, (name, order, u, k, _) in enumerate(ways):
        own = every[(choice == w) & ~same]
        if not len(own):
            continue
        pos = at[own] + 8
        for j in range(order):
            put(own, pos, x[own, j], 8)
            pos = pos + 8
        if name == "lpc":
            put(own, pos, np.full(len(own), PRECISION - 1), 4)
            put(own, pos + 4, shift[own], 5)
            pos = pos + 9
            for j in range(order):
                put(own, pos, coef[own, j], PRECISION)
                pos = pos + PRECISION
        put(own, pos + 6, k[own], 4)  # method 0, one partition
        pos, v, kk = pos + 10, u[own], k[own][:, None]
        q = v >> kk
        length = q + 1 + kk
        stop = pos[:, None] + np.cumsum(length, 1) - length + q
        flat = bits.reshape(-1)
        stop += (own * bits.shape[1])[:, None]
        flat[stop] = 1
        for b in range(int(kk.max())):
            part = kk[:, 0] > b
            flat[stop[part] + 1 + b] = v[part] >> (kk[part] - 1 - b) & 1
    rows = np.packbits(bits, axis=1).astype(np.int64)
    rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3] = 0xFF, 0xF8, 0x20, 0x02
    for j in range(6):
        own = every[coded_size > j]
        rows[own, 4 + j] = coded[own, j]
    rows[every, 4 + coded_size] = crcs(rows, head_size - 1, 8)
    check = crcs(rows, size, 16)
    raw = rows.astype(np.uint8)
    return [raw[i, : size[i]].tobytes() + struct.pack(">H", check[i]) for i in range(n)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC file for each payload, whose length is a positive multiple of ``BLOCK``; bytes become samples by ``SAMPLE_OF``."""
    counts = np.array([len(p) // BLOCK for p in payloads])
    x = SAMPLE_OF[np.frombuffer(b"".join(payloads), np.uint8)].astype(np.int64).reshape(-1, BLOCK)
    first = np.cumsum(counts) - counts
    frames = encode_frames(x, np.arange(len(x)) - np.repeat(first, counts))
    return [container(frames[a : a + m], p) for p, a, m in zip(payloads, first, counts, strict=True)]


def container(frames: list[bytes], payload: bytes) -> bytes:
    sizes = [len(f) for f in frames]
    at = np.cumsum([0, *sizes])
    samples = len(frames) * BLOCK
    info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | samples).to_bytes(8, "big")
    info += hashlib.md5(SAMPLE_OF[np.frombuffer(payload, np.uint8)].tobytes()).digest()
    seek = b"".join(struct.pack(">QQH", k * BLOCK, at[k], BLOCK) for k in range(0, len(frames), SEEK_EVERY))
    return b"fLaC" + b"\0" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(frames)


@dataclass
class Info:
    """A file's STREAMINFO, its seek points (sample, byte offset from the first frame) and first frame's place."""

    samples: int
    md5: bytes
    points: list[tuple[int, int]]
    frames_at: int


def read_info(media: bytes) -> Info:
    if media[:4] != b"fLaC":
        raise ValueError("no FLAC marker")
    at, samples, md5, points, last = 4, 0, b"", [], False
    while not last:
        last, kind, size = media[at] >> 7, media[at] & 127, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        if kind == 0:
            low, high = struct.unpack(">HH", body[:4])
            packed = int.from_bytes(body[10:18], "big")
            if (low, high, packed >> 41 & 7, packed >> 36 & 31) != (BLOCK, BLOCK, 0, 7):
                raise ValueError("not 8-bit mono in blocks of 576")
            samples, md5 = packed & (1 << 36) - 1, body[18:34]
        elif kind == 3:
            points = [struct.unpack(">QQ", body[i : i + 16]) for i in range(0, size, 18)]
        at += 4 + size
    return Info(samples, md5, points, at)


def frame_starts(data: np.ndarray, begin: int, end: int, first: int) -> list[int]:
    """Where frames ``first``, ``first`` + 1, ... start: sync codes with the due number and a valid header check."""
    found = begin + np.flatnonzero((data[begin : end - 5] == 0xFF) & (data[begin + 1 : end - 4] == 0xF8) & (data[begin + 2 : end - 3] == 0x20) & (data[begin + 3 : end - 2] == 0x02))
    starts, due = [], first
    if not len(found):
        return starts
    lead = data[found + 4]
    for at, b in zip(found.tolist(), lead.tolist(), strict=True):
        if due < 0x80:
            want = (due,)
        else:
            coded, size = coded_numbers(np.array([due]))
            want = tuple(coded[0, : size[0]].tolist())
        if b != want[0] or tuple(data[at + 4 : at + 4 + len(want)].tolist()) != want:
            continue
        crc = 0
        for byte in data[at : at + 4 + len(want)].tolist():
            crc = int(CRC8[crc ^ byte])
        if crc == data[at + 4 + len(want)]:
            starts.append(at)
            due += 1
    return starts


def decode_frames(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Samples (frames x BLOCK) of the frames that lie at ``start`` up to ``end`` in ``data``."""
    n, size = len(start), end - start
    place = np.minimum(start[:, None] + np.arange(int(size.max(initial=0)))[None], len(data) - 1)
    rows = data[place].astype(np.int64)
    if (crcs(rows, size, 16) != 0).any():
        raise ValueError("a frame's checksum differs")
    lead = rows[:, 4]
    head = 5 + np.where(lead < 0x80, 1, 2 + (lead >= 0xE0) + (lead >= 0xF0) + (lead >= 0xF8) + (lead >= 0xFC))
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(">u8").ravel().astype(np.uint64)
    pos = (start + head) * 8

    def peek(p: np.ndarray) -> np.ndarray:
        return words[p >> 3] << (p & 7).astype(np.uint64)

    def take(rows: np.ndarray, width) -> np.ndarray:
        """Unsigned fields of ``width`` bits (above 0), and the positions go on."""
        value = (peek(pos[rows]) >> (np.uint64(64) - np.asarray(width).astype(np.uint64))).astype(np.int64)
        pos[rows] += width
        return value

    def signed(value: np.ndarray, width) -> np.ndarray:
        return np.where(value >> (width - 1) & 1, value - (1 << np.asarray(width)), value)

    every = np.arange(n)
    kind = take(every, 8) >> 1
    out = np.zeros((BLOCK, n), np.int64)
    constant, verbatim = every[kind == 0], every[kind == 1]
    if len(constant):
        out[:, constant] = signed(take(constant, 8), 8)
    for j in range(BLOCK if len(verbatim) else 0):
        out[j, verbatim] = signed(take(verbatim, 8), 8)
    own = every[kind >= 8]
    if not len(own):
        return out.T
    kind = kind[own]
    lpc = kind >= 32
    order = np.where(lpc, kind - 31, kind - 8)
    if (~lpc & (order > 4)).any():
        raise ValueError("a reserved subframe type")
    most = int(order.max(initial=0))
    coef, shift = np.zeros((most, len(own)), np.int64), np.zeros(len(own), np.int64)
    x = np.zeros((BLOCK, len(own)), np.int64)
    for j in range(most):
        r = order > j
        x[j, r] = signed(take(own[r], 8), 8)
    if lpc.any():
        precision = take(own[lpc], 4) + 1
        shift[lpc] = signed(take(own[lpc], 5), 5)
        for j in range(most):
            r = order[lpc] > j
            coef[j, np.flatnonzero(lpc)[r]] = signed(take(own[lpc][r], precision[r]), precision[r])
    for k, fixed in enumerate(FIXED[: most + 1]):
        for j, c in enumerate(fixed):
            coef[j, ~lpc & (order == k)] = c
    method = take(own, 2)
    wide, parts = np.where(method == 1, 5, 4), take(own, 4)
    length, k, raw = BLOCK >> parts, np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    for i in range(BLOCK):
        new = np.flatnonzero((i % length == 0) | (i == 0)) if i else np.arange(len(own))
        if len(new):
            k[new] = take(own[new], wide[new])
            escaped = k[new] == (1 << wide[new]) - 1
            raw[new] = -1
            if escaped.any():
                raw[new[escaped]] = take(own[new[escaped]], 5)
        live = order <= i
        coded = live & (raw < 0)
        r = slice(None) if coded.all() else np.flatnonzero(coded)
        p, kk = pos[own[r]], k[r]
        q = np.zeros(len(p), np.int64)
        while True:
            top = (peek(p) >> np.uint64(32)).astype(np.int64)
            zeros = 32 - np.frexp(top.astype(np.float64))[1]
            q += zeros
            p = p + zeros
            if not (more := top == 0).any():
                break
            if (p > 8 * len(data)).any():
                raise ValueError("a residual runs beyond the file")
            # Only rows with 32 zeros go on; the others find their one bit again at once.
        low = ((peek(p + 1) >> np.uint64(1)) >> (np.uint64(63) - kk.astype(np.uint64))).astype(np.int64)
        pos[own[r]] = p + 1 + kk
        u = q << kk | low
        value = np.zeros(len(own), np.int64)
        value[r] = u >> 1 ^ -(u & 1)
        if (plain := np.flatnonzero(live & (raw > 0))).size:
            value[plain] = signed(take(own[plain], raw[plain]), raw[plain])
        guess = np.zeros(len(own), np.int64)
        for j in range(min(most, i)):
            guess += coef[j] * x[i - 1 - j]
        x[i] = np.where(live, value + (guess >> shift), x[i])
    out[:, own] = x
    return out.T


def decode(medias: list[bytes]) -> list[bytes]:
    """Payloads of many files: frame checksums and each file's MD5 are verified."""
    infos = [read_info(m) for m in medias]
    data = np.frombuffer(b"".join(medias), np.uint8)
    base = np.cumsum([0, *map(len, medias)])
    start, end, counts = [], [], []
    for k, info in enumerate(infos):
        own = frame_starts(data, int(base[k]) + info.frames_at, int(base[k + 1]), 0)
        if len(own) * BLOCK != info.samples:
            raise ValueError("frames are missing")
        start += own
        end += [*own[1:], int(base[k + 1])]
        counts.append(len(own))
    samples = decode_frames(data, np.array(start), np.array(end))
    if samples.min(initial=0) < -128 or samples.max(initial=0) > 127:
        raise ValueError("a sample exceeds 8 bits")
    raw, out, at = samples.astype(np.int8), [], 0
    for info, m in zip(infos, counts, strict=True):
        pcm = raw[at : at + m].tobytes()
        at += m
        if hashlib.md5(pcm).digest() != info.md5:
            raise ValueError("the samples' MD5 differs")
        out.append(BYTE_OF[np.frombuffer(pcm, np.uint8)].tobytes())
    return out


def seek(media: bytes, sample: int) -> tuple[int, bytes]:
    """The block that holds ``sample``: its first sample's number and its bytes, from the nearest seek point on."""
    info, data = read_info(media), np.frombuffer(media, np.uint8)
    if not 0 <= sample < info.samples:
        raise ValueError("no such sample")
    first, offset = max((p for p in info.points if p[0] <= sample), default=(0, 0))
    starts = frame_starts(data, info.frames_at + offset, len(media), first // BLOCK)
    k = sample // BLOCK - first // BLOCK
    stop = starts[k + 1] if k + 1 < len(starts) else len(media)
    block = decode_frames(data, np.array([starts[k]]), np.array([stop]))[0]
    return sample // BLOCK * BLOCK, BYTE_OF[block & 255].tobytes()

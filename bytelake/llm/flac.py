"""FLAC: lossless audio columns, with an encoder and a decoder after the public format description (RFC 9639)."""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096
RATE = 8000
#: Block sizes and sample rates that have a code of their own (fixed values of the format).
SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, **{8 + k: 256 << k for k in range(8)}}
RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


class Corrupt(ValueError):
    """The stream breaks the format or fails a checksum."""


@cache
def _crc_table(bits: int, poly: int) -> list[int]:
    out = []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (bits - 1) else c << 1) & ((1 << bits) - 1)
        out.append(c)
    return out


def crc8(data: bytes) -> int:
    table, c = _crc_table(8, 0x07), 0
    for b in data:
        c = table[c ^ b]
    return c


@cache
def _crc16_far(n: int = 2048) -> np.ndarray:
    """Row k: what each byte adds to the checksum if k bytes follow it. A checksum of zero start is linear, so these add up."""
    one = np.array(_crc_table(16, 0x8005), np.uint16)
    out = np.empty((n, 256), np.uint16)
    out[0] = one
    for k in range(1, n):
        out[k] = out[k - 1] << 8 ^ one[out[k - 1] >> 8]
    return out


def crc16(data: bytes) -> int:
    far, c, x = _crc16_far(), 0, np.frombuffer(data, np.uint8)
    flat, offset = far.ravel(), np.arange(len(far) - 1, -1, -1, dtype=np.int64) * 256
    for s in range(0, len(x), len(far)):
        part = x[s : s + len(far)]
        n = len(part)
        got = int(np.bitwise_xor.reduce(flat[offset[len(far) - n :] + part]))
        # what was there before moves on by n bytes
        before = (far[n - 1, c >> 8] ^ (far[n - 2, c & 255] if n > 1 else (c & 255) << 8)) if c else 0
        c = got ^ int(before)
    return c


def _bits(value: int, n: int) -> np.ndarray:
    return np.array([value >> k & 1 for k in range(n - 1, -1, -1)], np.uint8)


def _coded_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    k = next(k for k in range(1, 7) if n < 1 << (5 * k + 6))
    return bytes([(0xFF00 >> (k + 1)) & 0xFF | n >> (6 * k), *(0x80 | n >> (6 * j) & 0x3F for j in range(k - 1, -1, -1))])


def _rice_bits(residual: np.ndarray, k: int) -> np.ndarray:
    u = np.where(residual >= 0, 2 * residual, -2 * residual - 1)
    ends = np.cumsum((u >> k) + 1 + k)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ends - k - 1] = 1
    for j in range(k):
        out[ends - k + j] = u >> (k - 1 - j) & 1
    return out


def _best_rice(residual: np.ndarray, most: int = 14) -> tuple[int, int]:
    """(bits, parameter) of the shortest code. The mean is near the best; its neighbours are tried."""
    u = np.where(residual >= 0, 2 * residual, -2 * residual - 1)
    near = max(0, int(u.mean()).bit_length() - 1) if len(u) else 0
    return min((int((u >> k).sum()) + len(u) * (k + 1), k) for k in range(max(0, near - 1), min(most, near + 1) + 1))


def _residual_bits(residual: np.ndarray, n: int, order: int, partitions: int) -> np.ndarray:
    """The residual with 2 ** partitions Rice parameters."""
    out, size, at = [_bits(0, 2), _bits(partitions, 4)], n >> partitions, 0
    for k in range(1 << partitions):
        part = residual[at : at + size - (order if k == 0 else 0)]
        at += len(part)
        rice = _best_rice(part)[1]
        out += [_bits(rice, 4), _rice_bits(part, rice)]
    return np.concatenate(out)


def _predicted(x: np.ndarray, order: int) -> np.ndarray:
    for _ in range(order):
        x = np.diff(x)
    return x


def lpc_residual(x: np.ndarray, coefficients: list[int], shift: int) -> np.ndarray:
    order = len(coefficients)
    guess = sum(c * x[order - 1 - j : len(x) - 1 - j] for j, c in enumerate(coefficients)) if order else 0
    return x[order:] - (guess >> shift)


#: Taps of the encoder's own linear predictors, bits of their coefficients and the shift behind them.
TAPS, PRECISION, SHIFT = 4, 15, 12


def predictor(x: np.ndarray, taps: int = TAPS) -> list[int] | None:
    """Quantised coefficients of the linear predictor of least squared error, from the autocorrelation; None where there is none."""
    f = x.astype(float)
    r = np.array([f[: len(f) - k] @ f[k:] for k in range(taps + 1)])
    if r[0] <= 0:
        return None
    r[0] *= 1.0001  # keeps the equations regular
    c = np.linalg.solve(r[np.abs(np.subtract.outer(np.arange(taps), np.arange(taps)))], r[1:])
    q = np.rint(c * (1 << SHIFT))
    return q.astype(np.int64).tolist() if np.abs(q).max() < 1 << (PRECISION - 1) else None


def _about(residual: np.ndarray) -> int:
    """Bits of the residual with the parameter that its mean suggests, to choose a predictor by."""
    u = int(np.abs(residual).sum()) * 2
    k = max(0, (u // len(residual)).bit_length() - 1) if len(residual) else 0
    return (u >> k) + len(residual) * (k + 1)


def _subframe(x: np.ndarray, depth: int, lpc: tuple[list[int], int] | None, partitions: int) -> np.ndarray:
    """The shortest of constant, verbatim, fixed predictors and a linear one of TAPS taps (or the given linear predictor), by an estimate of their residuals' bits."""
    n = len(x)
    twos = lambda v, d=depth: ((v[:, None] >> np.arange(d - 1, -1, -1)) & 1).astype(np.uint8).ravel()
    if not lpc and (x == x[0]).all():
        return np.concatenate([_bits(0, 8), twos(x[:1])])
    fixed, bits, order = x, n * depth, -1  # no order: verbatim
    best = fixed
    if not lpc:
        for o in range(min(5, n)):
            fixed = np.diff(fixed) if o else x
            size = _about(fixed) + o * depth + 10
            if size < bits:
                bits, order, best = size, o, fixed
            elif o > max(order, 1):
                break  # longer ones only get worse
    found = lpc or (n > 4 * TAPS and (q := predictor(x)) is not None and (q, SHIFT)) or None
    if found and n > len(found[0]):
        taps, residual = len(found[0]), lpc_residual(x, *found)
        if lpc or _about(residual) + taps * (depth + PRECISION) + 19 < bits:
            head = [_bits(0b01000000 | (taps - 1) << 1, 8), twos(x[:taps]), _bits(PRECISION - 1, 4), _bits(found[1], 5), twos(np.array(found[0], np.int64), PRECISION)]
            return np.concatenate([*head, _residual_bits(residual, n, taps, partitions if n % (1 << partitions) == 0 and n >> partitions > taps else 0)])
    if order < 0:
        return np.concatenate([_bits(0b00000010, 8), twos(x)])
    return np.concatenate([_bits((0b001000 | order) << 1, 8), twos(x[:order]), _residual_bits(best, n, order, partitions if n % (1 << partitions) == 0 and n >> partitions > order else 0)])


def encode(samples: np.ndarray, depth: int = 8, rate: int = RATE, block: int = BLOCK, lpc: tuple[list[int], int] | None = None, partitions: int = 0) -> bytes:
    """One channel of signed samples of 8 bits (or 16) as a FLAC stream, with a seek table of all its frames. lpc: coefficients and shift of a linear predictor to use throughout."""
    x = np.asarray(samples, np.int64)
    pcm = x.astype("<i1" if depth == 8 else "<i2").tobytes()
    code = {v: k for k, v in DEPTHS.items()}[depth]
    sizes, rates, frames = {v: k for k, v in SIZES.items()}, {v: k for k, v in RATES.items()}, []
    for number, s in enumerate(range(0, len(x), block)):
        part = x[s : s + block]
        size = sizes.get(len(part), 7)
        head = bytes([0xFF, 0xF8, size << 4 | rates.get(rate, 0), code << 1]) + _coded_number(number)
        head += (len(part) - 1).to_bytes(2, "big") if size == 7 else b""
        body = head + bytes([crc8(head)]) + np.packbits(_subframe(part, depth, lpc, partitions)).tobytes()
        frames.append(body + crc16(body).to_bytes(2, "big"))
    lengths = [len(f) for f in frames] or [0]
    info = max(16, block).to_bytes(2, "big") * 2 + min(lengths).to_bytes(3, "big") + max(lengths).to_bytes(3, "big")
    info += (rate << 44 | (depth - 1) << 36 | len(x)).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    places = [0, *itertools.accumulate(lengths[:-1])]
    points = b"".join((k * block).to_bytes(8, "big") + p.to_bytes(8, "big") + min(block, len(x) - k * block).to_bytes(2, "big") for k, p in enumerate(places)) if frames else b""
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + b"".join(frames)


class _Reader:
    """Bits of a frame, unpacked as far as they are needed."""

    def __init__(self, data: bytes, at: int, ahead: int):
        self.data, self.base, self.at, self.bits = data, at, 0, np.empty(0, np.uint8)
        self.more(ahead)

    def more(self, n: int) -> None:
        """At least n more bits than are read, or all there are."""
        have, left = self.base + len(self.bits) // 8, max(0, self.at + n - len(self.bits))
        if left:
            self.bits = np.concatenate([self.bits, np.unpackbits(np.frombuffer(self.data[have : have + left // 8 + 64], np.uint8))])

    def take(self, n: int) -> np.ndarray:
        self.more(n)
        out = self.bits[self.at : self.at + n]
        if len(out) < n:
            raise Corrupt("the frame is cut off")
        self.at += n
        return out

    def number(self, n: int, signed: bool = False) -> int:
        v = int("".join(map(str, self.take(n))) or "0", 2)
        return v - (1 << n) if signed and n and v >> (n - 1) else v

    def numbers(self, count: int, n: int) -> np.ndarray:
        """count signed numbers of n bits."""
        if not n:
            return np.zeros(count, np.int64)
        v = self.take(count * n).reshape(count, n).astype(np.int64) @ (1 << np.arange(n - 1, -1, -1))
        return np.where(v >> (n - 1), v - (1 << n), v)

    def rice(self, count: int, k: int) -> np.ndarray:
        """count Rice codes of parameter k.

        A code that starts at bit p ends k + 1 bits after the first one at or after p: a jump from each bit to the next code's start. Eightfold jumps are
        composed for all bits at once, every eighth start is found by them, and the ones between by single jumps.
        """
        if not count:
            return np.zeros(0, np.int64)
        guess = count * (k + 3) + 64
        while True:
            self.more(guess)
            window = self.bits[self.at : self.at + guess]
            n = len(window)
            ones = np.flatnonzero(window)
            stop = np.full(n + 1, n, np.int32)  # first one at or after
            if len(ones):
                stop[: ones[-1] + 1] = np.repeat(ones, np.diff(ones, prepend=-1))
            hop = np.minimum(stop + (k + 1), n)
            hop[n] = n
            two = hop[hop]
            four = two[two]
            eight = four[four].item
            p, anchors = 0, []
            for _ in range(-(-count // 8)):
                anchors.append(p)
                p = eight(p)
            a = np.array(anchors, np.int32)
            b = hop[a]
            starts = np.stack([a, b, two[a], two[b], four[a], four[b], two[four[a]], two[four[b]]], axis=1).ravel()[:count]
            ends = stop[starts] + (k + 1)
            if ends[-1] <= n and stop[starts[-1]] < n:
                break
            if self.base * 8 + self.at + n >= len(self.data) * 8:
                raise Corrupt("a residual is cut off")
            guess *= 2
        first = stop[starts]
        u = (first - starts).astype(np.int64)
        for j in range(k):
            u = u << 1 | window[first + 1 + j]
        self.at += int(ends[-1])
        return np.where(u & 1, -(u >> 1) - 1, u >> 1)


def _residual(r: _Reader, n: int, order: int) -> np.ndarray:
    wide = r.number(2)
    if wide > 1:
        raise Corrupt("unknown residual coding")
    partitions, out = r.number(4), []
    for k in range(1 << partitions):
        count = (n >> partitions) - (order if k == 0 else 0)
        if count < 0 or n % (1 << partitions):
            raise Corrupt("partitions do not fit the block")
        rice = r.number(5 if wide else 4)
        out.append(r.numbers(count, r.number(5)) if rice == (31 if wide else 15) else r.rice(count, rice))
    return np.concatenate(out)


def _restored(residual: np.ndarray, warm: np.ndarray) -> np.ndarray:
    """Samples of a fixed predictor: the residual summed up once for each order."""
    order, out = len(warm), residual
    for j in range(order - 1, -1, -1):
        out = np.cumsum(out) + np.diff(warm, j)[-1]
    return np.concatenate([warm, out])


def _decode_subframe(r: _Reader, n: int, depth: int) -> np.ndarray:
    if r.number(1):
        raise Corrupt("a subframe starts with a one")
    kind, wasted = r.number(6), 0
    if r.number(1):
        wasted = 1
        while not r.number(1):
            wasted += 1
    depth -= wasted
    if kind == 0:
        x = np.repeat(r.numbers(1, depth), n)
    elif kind == 1:
        x = r.numbers(n, depth)
    elif 8 <= kind <= 12:
        warm = r.numbers(kind - 8, depth)
        x = _restored(_residual(r, n, kind - 8), warm)
    elif kind >= 32:
        order = kind - 31
        warm = r.numbers(order, depth)
        precision, shift = r.number(4) + 1, r.number(5, signed=True)
        if precision == 16 or shift < 0:
            raise Corrupt("a predictor's precision or shift is out of range")
        taps = r.numbers(order, precision)
        return Predicted(warm, taps, shift, _residual(r, n, order), wasted)
    else:
        raise Corrupt("a reserved kind of subframe")
    return x << wasted


@dataclass
class Predicted:
    """A subframe of a linear predictor, before its samples are summed up."""

    warm: np.ndarray
    taps: np.ndarray
    shift: int
    residual: np.ndarray
    wasted: int


def restored(parts: list[Predicted]) -> list[np.ndarray]:
    """Samples of subframes of linear predictors. A sample needs those before it, so all subframes are summed up side by side, the longest first, one step of all at a time."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(parts)
    for order in sorted({len(p.taps) for p in parts}):
        mine = sorted((k for k, p in enumerate(parts) if len(p.taps) == order), key=lambda k: -len(parts[k].residual))
        lengths = np.array([len(parts[k].residual) for k in mine])
        steps = int(lengths[0])
        active = np.searchsorted(-lengths, -np.arange(steps), side="left").tolist()
        x = np.zeros((order + steps, len(mine)), np.int64)
        taps, shift = np.empty((order, len(mine)), np.int64), np.array([parts[k].shift for k in mine])
        for j, k in enumerate(mine):
            p = parts[k]
            x[:order, j], taps[:, j] = p.warm, p.taps[::-1]
            x[order : order + len(p.residual), j] = p.residual
        for t, a in enumerate(active):
            x[t + order, :a] += (taps[:, :a] * x[t : t + order, :a]).sum(axis=0) >> shift[:a]
        for j, k in enumerate(mine):
            out[k] = x[: order + lengths[j], j] << parts[k].wasted
    return out


@dataclass
class Block:
    offset: int
    samples: np.ndarray  # (channels, samples)


@dataclass
class _Frame:
    parts: list  # samples of each channel, or Predicted
    layout: int


@dataclass
class _Info:
    depth: int
    total: int
    md5: bytes
    points: list[tuple[int, int, int]]  # first sample, byte behind the metadata, samples
    at: int  # where the frames start


def metadata(data: bytes) -> _Info:
    if data[:4] != b"fLaC":
        raise Corrupt("no FLAC stream")
    at, info, points, last = 4, None, b"", False
    while not last:
        if at + 4 > len(data):
            raise Corrupt("metadata is cut off")
        last, kind, size = data[at] >> 7 == 1, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0:
            info = data[at + 4 : at + 4 + size]
        elif kind == 3:
            points = data[at + 4 : at + 4 + size]
        at += 4 + size
    if info is None or len(info) < 34 or at > len(data):
        raise Corrupt("no stream information")
    packed = int.from_bytes(info[10:18], "big")
    found = [(int.from_bytes(points[k : k + 8], "big"), int.from_bytes(points[k + 8 : k + 16], "big"), int.from_bytes(points[k + 16 : k + 18], "big")) for k in range(0, len(points) - 17, 18)]
    return _Info((packed >> 36 & 31) + 1, packed & ((1 << 36) - 1), info[18:34], [p for p in found if p[0] != (1 << 64) - 1], at)


def _frame(data: bytes, at: int, depth0: int, check: bool) -> tuple[_Frame, int, int]:
    """The frame at a byte, its number of samples, and where it ends."""
    start = at
    if data[at : at + 1] != b"\xff" or len(data) < at + 6 or data[at + 1] & 0xFE != 0xF8:
        raise Corrupt("no frame where one should start")
    size, layout, code = data[at + 2] >> 4, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    rate = data[at + 2] & 15
    at += 4
    lead = data[at]
    at += 1 if lead < 0x80 else next(k for k in range(8) if not lead >> (7 - k) & 1)
    extra = 1 if size == 6 else 2 if size == 7 else 0
    n = int.from_bytes(data[at : at + extra], "big") + 1 if extra else SIZES.get(size)
    at += extra + (1 if rate == 12 else 2 if rate in (13, 14) else 0)
    if n is None or at >= len(data) or layout > 10:
        raise Corrupt("a reserved block size or channel layout")
    if check and crc8(data[start:at]) != data[at]:
        raise Corrupt("a frame header's checksum differs")
    at += 1
    depth = DEPTHS.get(code, depth0)
    r = _Reader(data, at, n * depth * (1 if layout > 7 else layout + 1))
    parts = [_decode_subframe(r, n, depth + (layout == 8 and k == 1 or layout == 9 and k == 0 or layout == 10 and k == 1)) for k in range(2 if layout > 7 else layout + 1)]
    at += -(-r.at // 8)
    if check and crc16(data[start:at]) != int.from_bytes(data[at : at + 2], "big"):
        raise Corrupt("a frame's checksum differs")
    return _Frame(parts, layout), n, at + 2


def _channels(frame: _Frame) -> np.ndarray:
    parts = frame.parts
    if frame.layout == 8:
        parts[1] = parts[0] - parts[1]
    elif frame.layout == 9:
        parts[0] = parts[0] + parts[1]
    elif frame.layout == 10:
        mid = parts[0] << 1 | parts[1] & 1
        parts = [(mid + parts[1]) >> 1, (mid - parts[1]) >> 1]
    return np.stack(parts)


#: Samples of frames that are decoded side by side at most (or one frame, if that has more).
TOGETHER = 1 << 20


def decode_many(streams: Iterable[bytes], check: bool = True) -> Iterator[tuple[int, Block | Corrupt | None]]:
    """(number of the stream, block) of the blocks of samples of several streams in their order. Behind the last block of a stream comes None, or Corrupt in its place if the stream breaks off there.

    Header and frame checksums, the number of samples and the MD5 of all are verified. Frames wait until TOGETHER samples are there, so that their linear predictors are undone side by side.
    """
    waiting: list[tuple] = []
    whole, offset = hashlib.md5(), 0

    def out():
        nonlocal whole, offset
        late = [(f, c) for _, f, _ in waiting if isinstance(f, _Frame) for c, p in enumerate(f.parts) if isinstance(p, Predicted)]
        for (f, c), x in zip(late, restored([f.parts[c] for f, c in late]), strict=True):
            f.parts[c] = x
        for k, f, info in waiting:
            if isinstance(f, _Frame):
                x, width = _channels(f), -(-info.depth // 8)
                whole.update(np.ascontiguousarray(x.T).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes() if width not in (1, 2) else x.T.astype(f"<i{width}").tobytes())
                yield k, Block(offset, x)
                offset += x.shape[1]
                continue
            if f is None and check and (info.total and offset != info.total or info.md5 != bytes(16) and whole.digest() != info.md5):
                f = Corrupt("the samples' number or MD5 differs")
            yield k, f
            whole, offset = hashlib.md5(), 0
        waiting.clear()

    size = 0
    for k, data in enumerate(streams):
        info = None
        try:
            info = metadata(data)
            at = info.at
            while at < len(data):
                frame, n, at = _frame(data, at, info.depth, check)
                waiting.append((k, frame, info))
                size += n
                if size >= TOGETHER:
                    yield from out()
                    size = 0
            waiting.append((k, None, info))
        except (Corrupt, IndexError, StopIteration, ValueError) as e:
            waiting.append((k, e if isinstance(e, Corrupt) else Corrupt(f"the stream is cut off: {e}"), info))
    yield from out()


def decode(data: bytes, check: bool = True) -> Iterator[Block]:
    """Blocks of samples of one stream with the offset of their first one; errors raise Corrupt behind the last sound block."""
    for _, block in decode_many([data], check):
        if isinstance(block, Corrupt):
            raise block
        if block is not None:
            yield block


def seek(data: bytes, sample: int) -> Block:
    """The block that holds a sample, found by the seek table: no other frame is read. Corrupt if no point of the table leads to it."""
    info = metadata(data)
    found = next((p for p in reversed(info.points) if p[0] <= sample < p[0] + p[2]), None)
    if found is None:
        raise Corrupt("no seek point leads there")
    frame, _, _ = _frame(data, info.at + found[1], info.depth, True)
    for c, p in enumerate(frame.parts):
        if isinstance(p, Predicted):
            frame.parts[c] = restored([p])[0]
    return Block(found[0], _channels(frame))


UNIT = 64


def payload_of(text: str | None) -> bytes:
    """The text in UTF-8, and bytes 0 up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def samples_of(payload: bytes) -> np.ndarray:
    """Each byte as an 8-bit signed sample: 128 is silence."""
    return np.frombuffer(payload, np.uint8).astype(np.int64) - 128


def bytes_of(samples: np.ndarray) -> bytes:
    return (samples + 128).astype(np.uint8).tobytes()


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (of the text in UTF-8), media (a mono FLAC stream of 8-bit samples, one for each byte of the padded text).

    Null texts are empty, so 64 bytes 0. Null ids stay null, repeated rows come back as often, equal texts give equal streams, other columns are ignored, an empty table gives no rows.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = batch.slice(k, 256)
                texts = rows.column(1).to_pylist()
                media = [encode(samples_of(payload_of(t))) for t in texts]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(part, "doc_id long, n_bytes long, media binary")


def _pcm(streams: list[bytes | None]) -> Iterator[tuple[int, int, int | None, np.ndarray | None, str | None]]:
    """(number of the stream, block, first sample, samples of the first channel, error) of the blocks of several streams; an error takes the place of the block that it spoils."""
    number, now = 0, None
    for k, b in decode_many(x or b"" for x in streams):
        number, now = (number + 1 if k == now else 0), k
        if isinstance(b, Corrupt):
            yield k, number, None, None, str(b)
        elif b is not None:
            yield k, number, b.offset, b.samples[0], None


def pcm_blocks(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Per block of each stream: doc_id, block, sample_offset, n_samples, pcm (8-bit unsigned), error.

    Blocks come in order; any can be found by its sample_offset. A stream that fails a checksum gives the blocks before the fault and then one row with the error; a null stream gives one row with an error.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "block", "sample_offset", "n_samples", "pcm", "error"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                ids, streams = (batch.column(c).slice(start, 256).to_pylist() for c in (0, 1))
                rows, size = [], 0
                for k, number, offset, x, error in _pcm(streams):
                    rows.append((ids[k], number, offset, None if x is None else len(x), None if x is None else bytes_of(x), error))
                    size += 0 if x is None else len(x)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return media.select(F.col(id_col).cast("long"), F.col(media_col)).mapInArrow(part, "doc_id long, block long, sample_offset long, n_samples long, pcm binary, error string")


def describe(media: DataFrame) -> DataFrame:
    """Per stream of store(): doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (last 64 bytes), media_bytes, media_sha256, feature, block_offsets.

    All but n_bytes come from the PCM blocks of the decoded stream, whose checksums must hold: a fault fails the job. feature: peak, zero crossings, sum of squares and number of blocks.
    block_offsets: the first sample of each block, where the stream's seek table leads.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "block_offsets"]
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part_rows = batch.slice(k, 256)
                streams = part_rows.column(2).to_pylist()
                seen = [_Described() for _ in streams]
                for n, _, offset, x, error in _pcm(streams):
                    if error is not None:
                        raise Corrupt(f"stream of document {part_rows.column(0)[n].as_py()}: {error}")
                    seen[n].add(offset, x)
                rows = [d.row(data) for d, data in zip(seen, streams, strict=True)]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part_rows.column(0), part_rows.column(1), *cols], names=["doc_id", "n_bytes", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, block_offsets array<long>"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(part, schema)


class _Described:
    """What describe() says of a stream, gathered block by block."""

    def __init__(self):
        self.sha, self.n, self.tail, self.peak, self.crossings, self.energy, self.last, self.offsets = hashlib.sha256(), 0, b"", 0, 0, 0, None, []

    def add(self, offset: int, x: np.ndarray) -> None:
        raw = bytes_of(x)
        self.sha.update(raw)
        self.n, self.tail = self.n + len(raw), (self.tail + raw)[-UNIT:]
        self.offsets.append(offset)
        sign = x < 0
        self.crossings += int((sign[1:] != sign[:-1]).sum()) + (self.last is not None and bool(sign[0]) != self.last)
        self.peak, self.energy, self.last = max(self.peak, int(np.abs(x).max())), self.energy + int(x @ x), bool(sign[-1])

    def row(self, data: bytes) -> tuple:
        feature = f"peak={self.peak};crossings={self.crossings};energy={self.energy};blocks={len(self.offsets)}"
        return self.n, self.sha.hexdigest(), zlib.crc32(self.tail), len(data), hashlib.sha256(data).hexdigest(), feature, self.offsets

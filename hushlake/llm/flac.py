"""FLAC as a media column: bytes of 8-bit samples, written and read losslessly.

The writer picks the smallest of a constant, a verbatim, a fixed-predictor and a
linear-predictor subframe for each block, the latter two with Rice-coded
residuals in one or several partitions. The reader verifies the checksums of
every frame header and frame, the sample offsets of the seek table and the digest
of the whole, and can start at any block. Both are numpy: Rice codes are found by
pointer jumping, and the recursion of linear predictors runs over the samples of
many frames in step.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlake.llm.common import importable

BLOCK, RATE, BITS = 4096, 8000, 8
#: Linear predictors: order, bits of a coefficient, and the shortest block that may have one.
ORDER, PRECISION, LEAST_LINEAR = 8, 12, 192
#: Partitions of the residual are tried by these powers of two.
PARTITIONS = (0, 2)
#: Payload bytes that are read back at a time; linear predictors run in step over their frames.
TOGETHER = 1 << 22
PAD = 64
_CRC_LONGEST = BLOCK + 64


def _table(poly: int, width: int) -> list[int]:
    top, mask, out = 1 << (width - 1), (1 << width) - 1, []
    for b in range(256):
        c = b << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & mask
        out.append(c)
    return out


_CRC8, _CRC16 = _table(0x07, 8), _table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


@lru_cache(maxsize=1)
def _crc16_by_distance() -> tuple[np.ndarray, np.ndarray]:
    """What a byte adds to the checksum if d bytes follow it, at 256 * d + byte; and 256 * d for falling d."""
    step, rows = np.array(_CRC16, np.uint16), [np.array(_CRC16, np.uint16)]
    for _ in range(_CRC_LONGEST - 1):
        rows.append((rows[-1] << np.uint16(8)) ^ step[rows[-1] >> np.uint16(8)])
    return np.array(rows).ravel(), np.arange(_CRC_LONGEST)[::-1] * 256


def crc16(data: bytes) -> int:
    """The checksum is linear, so each byte's share depends on its distance from the end alone."""
    out = 0
    for at in range(0, len(data), _CRC_LONGEST):
        part = np.frombuffer(data, np.uint8, min(_CRC_LONGEST, len(data) - at), at)
        for _ in range(len(part) if at else 0):
            out = (out << 8 & 0xFFFF) ^ _CRC16[out >> 8]
        shares, rows = _crc16_by_distance()
        out ^= int(np.bitwise_xor.reduce(shares.take(rows[-len(part) :] + part)))
    return out


def _number(n: int) -> bytes:
    """A frame number in the extended UTF-8 form of up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    while n >= 1 << (6 - len(tail)) if len(tail) < 6 else False:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    lead = (0xFF << (7 - len(tail)) & 0xFF) | n
    return bytes([lead, *reversed(tail)])


def _folded(residual: np.ndarray) -> np.ndarray:
    return (residual << 1) ^ (residual >> 31)


def _parameters(z: np.ndarray) -> range:
    """The Rice parameters that may be the best."""
    first = max(0, max(1, int(z.sum()) // max(1, len(z))).bit_length() - 2)
    return range(first, min(15, first + 3))


def _rice_bits(z: np.ndarray) -> int:
    """Bits of the folded residuals in one partition, without its header."""
    return min(int((z >> k).sum()) + len(z) * (k + 1) for k in _parameters(z))


def _rice_plan(z: np.ndarray, order: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Bits of the folded residuals with their headers, the power of the partitions, their first places and parameters."""
    n, ks = len(z) + order, np.array(_parameters(z), np.int32)
    sums = np.zeros((len(ks), len(z) + 1), np.int32)
    for row, k in zip(sums, ks, strict=True):
        np.cumsum(z >> k, out=row[1:])
    best = None
    for power in PARTITIONS:
        size = n >> power
        if power and (n & (1 << power) - 1 or size <= order):
            break
        edges = np.concatenate([[0], np.arange(1, 1 << power) * size - order, [len(z)]])
        bits = np.diff(sums[:, edges]) + np.diff(edges) * (ks[:, None] + 1)
        total = int(bits.min(axis=0).sum()) + 4 * (1 << power)
        if best is None or total < best[0]:
            best = total, power, edges[:-1], ks[bits.argmin(axis=0)]
    return best


def _rice_code(z: np.ndarray, first: np.ndarray, ks: np.ndarray) -> np.ndarray:
    """The bits of folded residuals: each partition's parameter, then the quotients in unary, a one, the rest in k bits."""
    if not len(z):
        return _in_bits(int(ks[0]), 4)
    k = ks[0] if (ks == ks[0]).all() else np.repeat(ks, np.diff(np.append(first, len(z))))
    length = (z >> k) + (1 + k)
    length[first] += 4
    ends = np.cumsum(length, dtype=np.int32)
    bits = np.zeros(int(ends[-1]), np.uint8)
    heads = ends[first] - length[first]
    for j in range(4):
        bits[heads + j] = ks >> (3 - j) & 1
    bits[ends - 1 - k] = 1
    for j in range(int(ks.max())):  # from the last bit on
        has = k > j
        if np.all(has):
            bits[ends - 1 - j] = z >> j & 1
        else:
            bits[ends[has] - 1 - j] = z[has] >> j & 1
    return bits


def _in_bits(value: int, n: int) -> np.ndarray:
    return np.array([value >> (n - 1 - j) & 1 for j in range(n)], np.uint8)


def _linear(x: np.ndarray) -> tuple[np.ndarray, int, np.ndarray] | None:
    """Coefficients, shift and residual of a linear predictor, by autocorrelation and Levinson's recursion."""
    f = x.astype(np.float64)
    r = [float(f[k:] @ f[: len(f) - k]) for k in range(ORDER + 1)]
    a, error = [], r[0] * (1 + 1e-9) + 1e-9
    for i in range(ORDER):
        reflected = (r[i + 1] - sum(c * r[i - j] for j, c in enumerate(a))) / error
        a = [c - reflected * d for c, d in zip(a, reversed(a), strict=True)] + [reflected]
        error *= 1 - reflected * reflected
        if error <= 0:
            return None
    largest = max(map(abs, a))
    if not 0 < largest < 1 << PRECISION - 1:
        return None
    limit = (1 << PRECISION - 1) - 1
    shift = max(0, min(15, PRECISION - 1 - int(np.ceil(np.log2(largest + 2.0**-PRECISION)))))
    coef = np.clip(np.rint(np.array(a) * (1 << shift)), -limit, limit).astype(np.int32)
    guess = np.zeros(len(x) - ORDER, np.int32)
    for j, c in enumerate(coef.tolist()):
        guess += c * x[ORDER - 1 - j : len(x) - 1 - j]
    return coef, shift, x[ORDER:] - (guess >> shift)


def _subframe(x: np.ndarray) -> bytes:
    """The smallest subframe of one block of samples (int32)."""
    raw = x.astype(np.int8)
    if (raw == raw[0]).all():
        return b"\x00" + raw[:1].tobytes()
    cost, order, r, d = int(np.abs(x).sum()), 0, x, x
    for k in range(1, min(5, len(x))):
        d = d[1:] - d[:-1]
        if (now := int(np.abs(d).sum())) >= cost:
            break
        cost, order, r = now, k, d
    z = _folded(r)
    bits, head = 8 * (1 + order) + 6 + _rice_bits(z), [_in_bits(0x08 | order, 7), _in_bits(0, 1), np.unpackbits(raw[:order].view(np.uint8))]
    if len(x) >= LEAST_LINEAR and (linear := _linear(x)) is not None:
        coef, shift, r = linear
        folded = _folded(r)
        total = 8 * (1 + ORDER) + 9 + PRECISION * ORDER + 6 + _rice_bits(folded)
        if total < bits:
            bits, order, z = total, ORDER, folded
            words = (coef[:, None] >> np.arange(PRECISION - 1, -1, -1) & 1).astype(np.uint8).ravel()
            head = [_in_bits(0x20 | ORDER - 1, 7), _in_bits(0, 1), np.unpackbits(raw[:ORDER].view(np.uint8)), _in_bits(PRECISION - 1, 4), _in_bits(shift, 5), words]
    plan = _rice_plan(z, order)
    if sum(map(len, head)) + 6 + plan[0] >= 8 + 8 * len(x):
        return b"\x02" + raw.tobytes()
    return np.packbits(np.concatenate([*head, _in_bits(0, 2), _in_bits(plan[1], 4), _rice_code(z, plan[2], plan[3])])).tobytes()


def encode(payload: bytes) -> bytes:
    """A FLAC stream of one channel whose samples are the bytes less 128."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    frames, points, at = [], [], 0
    for number, start in enumerate(range(0, len(samples), BLOCK)):
        x = samples[start : start + BLOCK]
        whole = len(x) == BLOCK
        head = bytes([0xFF, 0xF8, (0xC0 if whole else 0x70) | 0x04, 0x02]) + _number(number) + (b"" if whole else (len(x) - 1).to_bytes(2, "big"))
        head += bytes([crc8(head)])
        frame = head + _subframe(x)
        frames.append(frame + crc16(frame).to_bytes(2, "big"))
        points.append(start.to_bytes(8, "big") + at.to_bytes(8, "big") + len(x).to_bytes(2, "big"))
        at += len(frames[-1])
    sizes = [len(f) for f in frames] or [0]
    fields = RATE << 44 | 0 << 41 | (BITS - 1) << 36 | len(samples)
    info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + fields.to_bytes(8, "big") + hashlib.md5(samples.astype(np.int8).tobytes()).digest()
    seek = b"".join(points)
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(seek).to_bytes(3, "big") + seek + b"".join(frames)


class Damaged(ValueError):
    """A stream whose structure or checksums are wrong."""


def _header(media: bytes) -> tuple[int, bytes, list[tuple[int, int, int]], int]:
    """Samples in all, their digest, seek points, place of the first frame."""
    if media[:4] != b"fLaC":
        raise Damaged("no FLAC stream")
    at, total, digest, points, last = 4, 0, b"", [], False
    while not last:
        kind, size = media[at], int.from_bytes(media[at + 1 : at + 4], "big")
        body, last, at = media[at + 4 : at + 4 + size], bool(kind & 0x80), at + 4 + size
        if kind & 0x7F == 0:
            fields = int.from_bytes(body[10:18], "big")
            if fields >> 41 & 7 or (fields >> 36 & 31) + 1 != BITS:
                raise Damaged("only one channel of 8-bit samples is read")
            total, digest = fields & (1 << 36) - 1, body[18:34]
        elif kind & 0x7F == 3:
            points = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, size, 18)]
    return total, digest, points, at


def _chain(after: np.ndarray, j: int, count: int) -> np.ndarray | None:
    """j, after[j], after[after[j]] and so on; None if it ends before ``count``. Steps of 16 are found by doubling, and filled in."""
    n = len(after)
    if j >= n:
        return None
    steps = [np.append(after, n)]  # n stands for the end, and stays
    np.minimum(steps[0], n, out=steps[0])
    for _ in range(4):
        steps.append(steps[-1].take(steps[-1]))
    far, starts = steps[4], [j]
    for _ in range((count - 1) // 16):
        starts.append(far[starts[-1]])
    out = np.empty((len(starts), 16), np.int64)
    out[:, 0] = starts
    for width, step in zip((1, 2, 4, 8), steps, strict=False):
        out[:, width : 2 * width] = step.take(out[:, :width])
    out = out.ravel()[:count]
    return out if out[-1] < n else None


class _Bits:
    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        first, end = self.at >> 3, self.at + n + 7 >> 3
        v = int.from_bytes(self.data[first:end], "big") >> (end * 8 - self.at - n) & (1 << n) - 1
        self.at += n
        return v

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if v >> (n - 1) else v

    def rice(self, count: int, k: int) -> np.ndarray:
        """``count`` residuals: for every one bit the one that ends the code behind it is found at once, then the codes are a chain."""
        if not count:
            return np.zeros(0, np.int64)
        first, window = self.at >> 3, (count * (k + 4) >> 3) + 64
        while True:
            bits = np.unpackbits(np.frombuffer(self.data[first : first + window], np.uint8))
            rank = np.cumsum(bits, dtype=np.int32)
            ones = np.flatnonzero(bits)
            begin = self.at - first * 8
            found = _chain(rank.take(ones + k, mode="clip"), int(rank[begin - 1]) if begin else 0, count)
            if found is not None and ones[found[-1]] + k < len(bits):
                break
            if first + window >= len(self.data):
                raise Damaged("residuals end early")
            window *= 2
        ends = ones[found]
        z = np.diff(ends, prepend=begin - 1 - k) - 1 - k
        for j in range(k):
            z = z << 1 | bits[ends + (1 + j)]
        self.at = first * 8 + int(ends[-1]) + 1 + k
        return (z >> 1) ^ -(z & 1)


def _residual(r: _Bits, n: int, order: int) -> np.ndarray:
    width = 5 if r.take(2) == 1 else 4
    parts = 1 << r.take(4)
    out = []
    for i in range(parts):
        count = n // parts - (order if i == 0 else 0)
        k = r.take(width)
        if k == (1 << width) - 1:
            size = r.take(5)
            out.append(np.array([r.signed(size) if size else 0 for _ in range(count)], np.int64))
        else:
            out.append(r.rice(count, k))
    return np.concatenate(out)


class _Linear:
    """A linear predictor's subframe before its recursion."""

    def __init__(self, warm: list[int], coef: list[int], shift: int, residual: np.ndarray) -> None:
        self.warm, self.coef, self.shift, self.residual = warm, coef, shift, residual


def _recursion(frames: list[_Linear]) -> list[np.ndarray]:
    """Samples of linear predictors of one order, all frames in step: sample t of each is made at a time."""
    order, longest = len(frames[0].coef), max(len(f.residual) for f in frames)
    kind = np.int32  # 32 coefficients of 15 bits times samples of 8 bits stay within 27 bits
    x, e = np.zeros((order + longest, len(frames)), kind), np.zeros((longest, len(frames)), kind)
    for k, f in enumerate(frames):
        x[:order, k] = f.warm
        e[: len(f.residual), k] = f.residual
    coef, shift = np.array([f.coef[::-1] for f in frames], kind).T.copy(), np.array([f.shift for f in frames], kind)
    product, guess = np.empty_like(coef), np.empty_like(shift)
    for t in range(longest):
        np.multiply(coef, x[t : t + order], out=product)
        np.add.reduce(product, axis=0, out=guess)
        np.right_shift(guess, shift, out=guess)
        np.add(e[t], guess, out=x[t + order])
    return [x[: order + len(f.residual), k].astype(np.int64) for k, f in enumerate(frames)]


def _solved(found: list[np.ndarray | _Linear]) -> list[np.ndarray]:
    """The samples of frames, those of linear predictors of one order in groups that bound the work space."""
    by_order: dict[int, list[int]] = {}
    for k, f in enumerate(found):
        if isinstance(f, _Linear):
            by_order.setdefault(len(f.coef), []).append(k)
    out = list(found)
    for places in by_order.values():
        places.sort(key=lambda k: len(found[k].residual))
        for at in range(0, len(places), 512):
            for k, x in zip(places[at : at + 512], _recursion([found[k] for k in places[at : at + 512]]), strict=True):
                out[k] = x
    return out


def _subframe_at(media: bytes, at: int, n: int) -> tuple[np.ndarray | _Linear, int, int]:
    """One subframe, its wasted bits, and the byte after it."""
    head = media[at]
    kind, wasted = head >> 1 & 0x3F, 0
    r = _Bits(media, at)
    r.take(8)
    if head & 1:
        wasted = 1
        while not r.take(1):
            wasted += 1
    bits = BITS - wasted
    if kind == 0:
        x = np.full(n, r.signed(bits), np.int64)
    elif kind == 1 and not wasted:
        x = np.frombuffer(media, np.int8, n, at + 1).astype(np.int64)
        r.at += 8 * n
    elif kind == 1:
        x = np.array([r.signed(bits) for _ in range(n)], np.int64)
    elif 8 <= kind <= 12:
        order = kind - 8
        warm = np.array([r.signed(bits) for _ in range(order)], np.int64)
        x = _residual(r, n, order)
        for k in range(order, 0, -1):  # sum up what was differenced k times, from the k-th difference's first value
            x = np.cumsum(np.concatenate([[np.diff(warm[:k], k - 1)[0] if k > 1 else warm[0]], x]))
    elif kind >= 32:
        order = kind - 31
        warm = [r.signed(bits) for _ in range(order)]
        precision = r.take(4) + 1
        shift = r.signed(5)
        if precision == 16 or shift < 0:
            raise Damaged("reserved predictor")
        coef = [r.signed(precision) for _ in range(order)]
        x = _Linear(warm, coef, shift, _residual(r, n, order))
    else:
        raise Damaged("reserved subframe")
    return x, wasted, r.at + 7 >> 3


def _frame(media: bytes, at: int) -> tuple[np.ndarray | _Linear, int, int, int]:
    """The subframe of the frame at a byte, its wasted bits and samples, and the byte after the frame; both of its checksums are verified."""
    if media[at : at + 2] != b"\xff\xf8":
        raise Damaged("no frame where one should be")
    size_code, p = media[at + 2] >> 4, at + 4
    lead = media[p]
    p += 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    if size_code == 6:
        n, p = media[p] + 1, p + 1
    elif size_code == 7:
        n, p = int.from_bytes(media[p : p + 2], "big") + 1, p + 2
    else:
        n = 192 if size_code == 1 else 576 << size_code - 2 if size_code < 6 else 256 << size_code - 8
    p += {12: 1, 13: 2, 14: 2}.get(media[at + 2] & 15, 0)
    if crc8(media[at:p]) != media[p]:
        raise Damaged("frame header checksum")
    x, wasted, end = _subframe_at(media, p + 1, n)
    if crc16(media[at:end]) != int.from_bytes(media[end : end + 2], "big"):
        raise Damaged("frame checksum")
    return x, wasted, n, end + 2


def _pcm(x: np.ndarray, wasted: int) -> bytes:
    return ((x << wasted) + 128).astype(np.uint8).tobytes()


def read_blocks(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """Of each stream its PCM blocks as (offset of the first sample, its bytes); frames, seek points and the whole are verified."""
    found, wasted, shape, heads = [], [], [], [_header(m) for m in streams]
    for media, (total, _, points, first) in zip(streams, heads, strict=True):
        at, done, of = first, 0, []
        places = {offset: sample for sample, offset, n in points}
        while done < total:
            if places.get(at - first, done) != done:
                raise Damaged("seek table")
            x, w, n, at = _frame(media, at)
            found.append(x)
            wasted.append(w)
            of.append(done)
            done += n
        shape.append(of)
    solved, out, k = _solved(found), [], 0
    for of, (_, digest, _, _) in zip(shape, heads, strict=True):
        pcm = [_pcm(x, w) for x, w in zip(solved[k : k + len(of)], wasted[k : k + len(of)], strict=True)]
        k += len(of)
        if any(digest) and hashlib.md5((np.frombuffer(b"".join(pcm), np.uint8) ^ 0x80).tobytes()).digest() != digest:
            raise Damaged("digest of the samples")
        out.append(list(zip(of, pcm, strict=True)))
    return out


def decode(media: bytes) -> bytes:
    return b"".join(pcm for _, pcm in read_blocks([media])[0])


def read_range(media: bytes, start: int, count: int) -> bytes:
    """Samples ``start`` to ``start + count``, from the frames that hold them alone."""
    total, _, points, first = _header(media)
    stop = min(total, start + count)
    met = [(sample, _frame(media, first + offset)) for sample, offset, n in points if sample < stop and sample + n > start]
    solved = _solved([f[0] for _, f in met])
    return b"".join(_pcm(x, f[1])[max(0, start - sample) : stop - sample] for x, (sample, f) in zip(solved, met, strict=True))


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes of a text (null: none) padded by zeros to a positive multiple of 64, and their number without them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // PAD)) * PAD, b"\0"), len(raw)


def feature(pcm: bytes) -> str:
    """Mean, spread and sign changes of the samples, as text."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    mean = x.sum() / len(x)
    spread = max(0.0, float((x * x).sum()) / len(x) - mean * mean) ** 0.5
    return f"{mean:.3f} {spread:.3f} {int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def _groups(items: list, size: Callable[[object], int]) -> Iterator[list]:
    """The items in order, in lists of about TOGETHER bytes."""
    group, held = [], 0
    for item in items:
        group.append(item)
        held += size(item)
        if held >= TOGETHER:
            yield group
            group, held = [], 0
    if group:
        yield group


def media_column(df: DataFrame, with_media: bool = False) -> DataFrame:
    """Store each text as FLAC, read its PCM blocks back, and describe what was read: a row for each input row.

    ``with_media`` adds the stream itself. Nulls and empty texts have a payload
    of 64 zeros; equal texts have equal streams; null ids are passed on; a long
    text is many blocks of one stream; extra columns aren't read; an empty table
    gives an empty one. ``last_offset`` is the sample offset of the last block.
    """
    importable(df.sparkSession)
    kind = df.schema["doc_id"].dataType.simpleString()
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_blocks", "last_offset"]
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long, last_offset long" + ", media binary" * with_media
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def rows_of(texts: list[str]) -> list[tuple]:
        payloads = [payload_of(t) for t in texts]
        streams = [encode(p) for p, _ in payloads]
        out = []
        for (_, n), media, found in zip(payloads, streams, read_blocks(streams), strict=True):
            back = b"".join(pcm for _, pcm in found)
            out.append((n, len(back), sha(back), zlib.crc32(back[-PAD:]), len(media), sha(media), feature(back), len(found), found[-1][0], *([media] if with_media else [])))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for group in _groups(list(zip(batch["doc_id"], batch["text"], strict=True)), lambda r: len(r[1] or "") + PAD):
                texts = list(dict.fromkeys(t or "" for _, t in group))
                of = dict(zip(texts, rows_of(texts), strict=True))
                out = pd.DataFrame([of[t or ""] for _, t in group], columns=names + ["media"] * with_media)
                out.insert(0, "doc_id", pd.Series([None if pd.isna(i) else i for i, _ in group], dtype=object))
                yield out

    return df.select("doc_id", "text").mapInPandas(run, schema)


def pcm_blocks(df: DataFrame) -> DataFrame:
    """``(doc_id, sample_offset, n_samples, pcm)``: the verified blocks of the ``media`` column, one row each. Null media has none."""
    importable(df.sparkSession)
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for group in _groups([(i, bytes(m)) for i, m in zip(batch["doc_id"], batch["media"], strict=True) if m is not None], lambda r: len(r[1])):
                rows = [(None if pd.isna(i) else i, at, len(pcm), pcm) for (i, _), found in zip(group, read_blocks([m for _, m in group]), strict=True) for at, pcm in found]
                yield pd.DataFrame(rows, columns=["doc_id", "sample_offset", "n_samples", "pcm"]).astype({"doc_id": object})

    return df.select("doc_id", F.col("media")).mapInPandas(run, f"doc_id {kind}, sample_offset long, n_samples long, pcm binary")

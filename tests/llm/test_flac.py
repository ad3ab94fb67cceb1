import hashlib
import random
import zlib

import numpy as np
import pytest

from hushlake.llm import flac


def kinds(media):
    """Subframe type of each frame."""
    total, _, points, first = flac._header(media)
    out = []
    for _, offset, n in points:
        at = first + offset
        p = at + 4 + (1 if media[at + 4] < 0x80 else 8 - (media[at + 4] ^ 0xFF).bit_length()) + 2 * (media[at + 2] >> 4 == 7)
        out.append(media[p + 1] >> 1)
    return out


def signals():
    r = np.random.default_rng(1)
    t = np.arange(10_000)
    wave = 128 + 60 * np.sin(t / 9) + 30 * np.sin(t / 3.7)
    steps = np.cumsum(r.integers(-2, 3, 10_000)) % 60 + 90
    return {"constant": b"\x07" * 5000, "noise": r.integers(0, 256, 9000, dtype=np.uint8).tobytes(), "wave": wave.astype(np.uint8).tobytes(), "steps": steps.astype(np.uint8).tobytes(), "ramp": (t // 60 % 200).astype(np.uint8).tobytes(), "loud and quiet": np.where(t % 4096 < 2048, 128, r.integers(100, 150, 10_000)).astype(np.uint8).tobytes(), "text": " ".join(random.Random(2).choice(["alpha", "beta", "gamma", "of"]) for _ in range(3000)).encode()}


@pytest.mark.parametrize("name", signals())
def test_every_signal_round_trips(name):
    data = signals()[name]
    media = flac.encode(data)
    assert flac.decode(media) == data
    for start in (0, 4095, 4096, len(data) - 50):
        assert flac.read_range(media, start, 100) == data[start : start + 100]
    for at in (len(media) // 2, len(media) - 1):
        broken = bytearray(media)
        broken[at] ^= 4
        with pytest.raises(flac.Damaged):
            flac.decode(bytes(broken))


def test_the_writer_uses_every_kind_of_subframe():
    found = {k for data in signals().values() for k in kinds(flac.encode(data))}
    assert {0, 1} <= found and found & set(range(8, 13)) and 31 + flac.ORDER in found


def test_partitions_have_their_own_parameters():
    z = np.concatenate([np.zeros(1024), np.random.default_rng(3).integers(0, 200, 3072)]).astype(np.int32)
    bits, power, first, ks = flac._rice_plan(z, 0)
    assert power and len(set(ks.tolist())) > 1
    code = flac._rice_code(z, first, ks)
    r = flac._Bits(np.packbits(np.concatenate([flac._in_bits(0, 2), flac._in_bits(power, 4), code, np.zeros(64, np.uint8)])).tobytes(), 0)
    assert len(code) == bits and (flac._folded(flac._residual(r, len(z), 0).astype(np.int32)) == z).all()


def test_the_reader_knows_escaped_partitions_and_any_order():
    values = [3, -4, 0, 7]
    bits = [flac._in_bits(0, 2), flac._in_bits(0, 4), flac._in_bits(15, 4), flac._in_bits(4, 5), *[flac._in_bits(v & 15, 4) for v in values]]
    assert flac._residual(flac._Bits(np.packbits(np.concatenate(bits)).tobytes(), 0), 4, 0).tolist() == values
    rng = np.random.default_rng(4)
    frames, want = [], []
    for order, n in ((1, 30), (2, 500), (2, 40), (12, 100)):
        coef, shift, residual, warm = rng.integers(-60 // order, 60 // order, order).tolist(), 6, rng.integers(-3, 4, n), rng.integers(-9, 9, order).tolist()
        x = list(warm)
        for e in residual.tolist():  # by the definition
            x.append(e + (sum(c * s for c, s in zip(coef, reversed(x[-order:]))) >> shift))
        frames.append(flac._Linear(warm, coef, shift, residual))
        want.append(x)
    assert [x.tolist() for x in flac._solved(frames)] == want


def test_rows_against_hashes_of_the_payload(spark):
    long = "éa long text " * 60_000
    rows = [(1, "short", "m"), (1, "short", "m"), (None, "x" * 64, "m"), (2, None, None), (3, "", "m"), (4, long, "m")]
    got = flac.media_column(spark.createDataFrame(rows, "doc_id long, text string, media string"), with_media=True).collect()
    want = []
    for i, t, _ in rows:
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        want.append((str(i), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    assert all(r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() for r in got)
    assert all(r.n_blocks == -(-r.payload_bytes // flac.BLOCK) and r.last_offset == (r.n_blocks - 1) * flac.BLOCK for r in got)
    assert flac.media_column(spark.createDataFrame([], "doc_id long, text string")).count() == 0

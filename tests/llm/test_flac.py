import hashlib
import random
import zlib

import numpy as np
import pytest

from bytelake.llm import flac as A


def bitwise(data, bits, poly):
    c = 0
    for b in data:
        c ^= b << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (bits - 1) else c << 1) & ((1 << bits) - 1)
    return c


def test_checksums():
    rng = random.Random(1)
    assert A.crc8(b"123456789") == 0xF4 and A.crc16(b"123456789") == 0xFEE8
    for n in [*range(5), 2047, 2048, 2049, 2050, 4097, 7000]:
        data = rng.randbytes(n)
        assert A.crc16(data) == bitwise(data, 16, 0x8005) and A.crc8(data) == bitwise(data, 8, 0x07)


def slow_rice(bits, count, k):
    out, p = [], 0
    for _ in range(count):
        q = 0
        while not bits[p]:
            q, p = q + 1, p + 1
        u = q << k | int("0" + "".join(map(str, bits[p + 1 : p + 1 + k])), 2)
        p += 1 + k
        out.append(-(u >> 1) - 1 if u & 1 else u >> 1)
    return out


@pytest.mark.parametrize("k", [0, 1, 4, 9])
def test_rice(k):
    rng = np.random.default_rng(k)
    for n in [1, 7, 8, 9, 300]:
        x = np.rint(rng.laplace(scale=2.0 ** (k + 2), size=n)).astype(np.int64)
        bits = A._rice_bits(x, k)
        assert slow_rice(bits.tolist(), n, k) == x.tolist()
        r = A._Reader(np.packbits(bits).tobytes(), 0, 8)
        assert r.rice(n, k).tolist() == x.tolist() and r.at == len(bits)


def signal(n, seed=0):
    rng = np.random.default_rng(seed)
    return np.clip(np.rint(60 * np.sin(np.arange(n) / 9) + rng.normal(size=n) * 4), -128, 127).astype(np.int64)


@pytest.mark.parametrize("how", [{}, {"partitions": 3}, {"lpc": ([31000 >> 2, -15800 >> 2], 12)}, {"block": 192}, {"depth": 16, "rate": 44100}])
def test_round_trip(how):
    for n in [1, 63, 64, 4096, 4097, 10_000]:
        if how.get("partitions") and n % 8:
            continue
        for x in (signal(n), np.zeros(n, np.int64), np.random.default_rng(2).integers(-128, 128, n)):
            data = A.encode(x, **how)
            blocks = list(A.decode(data))
            assert [b.offset for b in blocks] == list(range(0, n, how.get("block", 4096)))
            assert np.array_equal(np.concatenate([b.samples[0] for b in blocks]), x)
    assert len(A.encode(signal(40_960))) < 40_960 * 0.7


def test_every_byte_is_guarded():
    data = A.encode(signal(300))
    rng = random.Random(3)
    for k in range(64, len(data)):
        bad = bytearray(data)
        bad[k] ^= 1 << rng.randrange(8)
        with pytest.raises((A.Corrupt, IndexError)):
            list(A.decode(bytes(bad)))
    for n in range(0, len(data), 7):
        with pytest.raises((A.Corrupt, IndexError)):
            list(A.decode(data[:n]))


def slow_predicted(p):
    out = p.warm.tolist()
    for e in p.residual.tolist():
        out.append(e + (sum(c * v for c, v in zip(p.taps.tolist(), reversed(out[-len(p.taps) :]), strict=True)) >> p.shift))
    return [v << p.wasted for v in out]


def test_predictors_are_undone_side_by_side():
    rng = np.random.default_rng(3)
    parts = [A.Predicted(rng.integers(-99, 99, o), rng.integers(-3000, 3000, o), 12, rng.integers(-50, 50, n), w) for o, n, w in ((1, 5, 0), (4, 300, 0), (4, 0, 0), (4, 41, 2), (32, 77, 0), (2, 1, 1))]
    assert [x.tolist() for x in A.restored(parts)] == [slow_predicted(p) for p in parts] and A.restored([]) == []


def kinds(data):
    info, out, at = A.metadata(data), [], A.metadata(data).at
    while at < len(data):
        frame, _, end = A._frame(data, at, info.depth, True)
        out.append("linear" if isinstance(frame.parts[0], A.Predicted) else data[at : at + 1])
        at = end
    return out


def test_encoder_uses_linear_predictors():
    text = A.samples_of(A.payload_of("the quick brown fox jumps over the lazy dog and what else " * 300))
    assert "linear" in kinds(A.encode(text)) and "linear" in kinds(A.encode(signal(9000)))


def test_seek_and_many_streams(monkeypatch):
    monkeypatch.setattr(A, "TOGETHER", 5000)
    xs = [signal(n, n) for n in (10_000, 1, 4096, 64, 20_001)]
    streams = [A.encode(x) for x in xs]
    for x, data in zip(xs, streams, strict=True):
        for sample in {0, len(x) // 2, len(x) - 1}:
            b = A.seek(data, sample)
            assert b.offset <= sample < b.offset + b.samples.shape[1] and np.array_equal(b.samples[0], x[b.offset : b.offset + b.samples.shape[1]])
        with pytest.raises(A.Corrupt):
            A.seek(data, len(x))
    mixed = [streams[0], b"", streams[1], streams[4][:-3], streams[2], b"fLaC", streams[3]]
    got = list(A.decode_many(mixed))
    for k, want in ((0, xs[0]), (2, xs[1]), (4, xs[2]), (6, xs[3])):
        assert np.array_equal(np.concatenate([b.samples[0] for n, b in got if n == k and b is not None]), want)
    assert [k for k, b in got if isinstance(b, A.Corrupt)] == [1, 3, 5] and [b.offset for k, b in got if k == 3 and isinstance(b, A.Block)] == [0, 4096, 8192, 12288]


def test_table(spark):
    texts = ["", None, "é" * 40, "plain text " * 3000, "x" * 64, "x" * 65, "same", "same"]
    docs = spark.createDataFrame([(i if i else None, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    media = A.store(docs)
    rows = {r.doc_id: r for r in A.describe(media).collect()}
    stored = {r.doc_id: r.media for r in media.collect()}
    for i, t in enumerate(texts):
        raw, r = (t or "").encode(), rows[i if i else None]
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest())
        assert r.block_offsets == list(range(0, len(padded), 4096))
    assert rows[6].feature == rows[7].feature and rows[6].media_sha256 == rows[7].media_sha256
    blocks = A.pcm_blocks(media).where("doc_id = 3").orderBy("block").collect()
    assert b"".join(b.pcm for b in blocks) == A.payload_of(texts[3]) and [b.sample_offset for b in blocks] == list(range(0, 33_024, 4096))
    bad = spark.createDataFrame([(1, b"fLaC"), (2, None), (3, stored[3][:-1])], "doc_id long, media binary")
    assert [(r.doc_id, r.block) for r in A.pcm_blocks(bad).where("error IS NOT NULL").collect()] == [(1, 0), (2, 0), (3, 8)]
    assert A.describe(A.store(docs.limit(0))).count() == 0

import gzip
import hashlib

import pytest

from bytelake.llm import warc as W


def chunks(data, n):
    return [data[k : k + n] for k in range(0, len(data), n)]


def archive():
    payloads = [b"", b"<p>one</p>", b"x" * 200_000, "\r\n\r\nWARC/1.1\r\n é".encode()]
    return payloads, [W.record(k, f"http://h/{k}", p, W.digest(p)) for k, p in enumerate(payloads)]


@pytest.mark.parametrize("size", [1, 7, 1000, 10**7])
def test_reads_in_any_chunks(size):
    payloads, parts = archive()
    got = list(W.read(chunks(b"".join(parts), size)))
    assert [r.error for r in got] == [None] * 4 and [r.http()[1] for r in got] == payloads
    assert [r.offset for r in got] == [sum(map(len, parts[:k])) for k in range(4)]
    assert [W.page_id_of(r.headers["warc-record-id"]) for r in got] == [0, 1, 2, 3]
    assert gzip.decompress(b"".join(parts)).count(b"WARC-Type: response") == 4  # a plain reader sees the same


def test_faults_are_named_and_skipped():
    payloads, parts = archive()
    wrong = W.record(9, "http://h/9", b"data", W.digest(b"other"))
    raw = gzip.decompress(parts[1])
    bad = [wrong, gzip.compress(raw.replace(b"one", b"two")), gzip.compress(raw[:-6]), gzip.compress(raw + b"x"), gzip.compress(b"nothing"), gzip.compress(raw.replace(b"Content-Length: ", b"Content-Length: x"))]
    got = list(W.read([b"".join([*bad, parts[3]])]))
    assert len(got) == 7 and all(r.error for r in got[:6]) and got[6].error is None and got[6].http()[1] == payloads[3]
    cut = list(W.read([b"".join(parts)[:-5]]))
    assert [bool(r.error) for r in cut] == [False, False, False, True]
    assert [bool(r.error) for r in W.read([parts[0] + b"garbage" + parts[1]])] == [False, True, False]
    assert list(W.read([])) == [] == list(W.read([b""]))


@pytest.mark.parametrize("size", [3, 500, 10**7])
def test_goes_on_behind_a_bad_member(size):
    payloads, parts = archive()
    for at in (0, 1, 2):
        for bad in (parts[at][:30], parts[at][:-9], parts[at][:12] + b"\xff" * 8 + parts[at][20:], b"\x1f\x8b\x08" + b"x" * 70, b""):
            data = b"".join([*parts[:at], bad, *parts[at + 1 :]])
            got = list(W.read(chunks(data, size)))
            sound = [r for r in got if r.error is None]
            assert [W.page_id_of(r.headers["warc-record-id"]) for r in sound] == [k for k in range(4) if k != at]
            assert len(got) - len(sound) == bool(bad)
            assert [r.offset for r in sound] == [data.index(parts[k]) for k in range(4) if k != at]
    everything = list(W.read(chunks(b"".join(parts)[5:], size)))  # a file that starts in the middle of a member
    assert [bool(r.error) for r in everything] == [True, False, False, False]


def test_ids():
    for i in (None, 0, 5, -1, 2**63 - 1, -(2**63)):
        assert W.page_id_of(W.record_id(i)) == i
    assert W.page_id_of("<urn:uuid:6ba7b810-9dad-11d1-80b4-00c04fd430c8>") is None and W.page_id_of("x") is None


def test_pages_round_trip(spark, tmp_path, monkeypatch):
    rows = [(1, "u", "<p>a</p>"), (2, None, "<p>a</p>"), (3, "v\r\nX: y", "é" * 5000), (4, "w", None), (5, "w", ""), (None, "n", "<p>a</p>"), (None, "n", "alone"), (7, "z", "<b>"), (7, "z", "<b>"), (-6, "z", "<b>")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, content string")
    stored = W.archives(pages, target_bytes=500)
    monkeypatch.setattr(W, "SHARED_ROWS", 0)
    by_shuffle = W.records(W.archives(pages, target_bytes=500)).drop("archive", "offset")
    assert sorted(map(str, by_shuffle.collect())) == sorted(map(str, W.records(stored).drop("archive", "offset").collect()))
    got = W.records(stored).collect()
    assert len(got) == len(rows) and all(r.error is None for r in got)
    want = []
    for i, _, t in rows:
        last = max((j for j, _, u in rows if (u or "") == (t or "") and j is not None), default=None)
        want.append((i, "response" if i == last else "revisit", None if i == last else last, len((t or "").encode())))
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=str) == sorted(want, key=str)
    text = {i: (t or "").encode() for i, _, t in rows if i is not None}
    assert all(W.digest(text[r.page_id]) == r.payload_digest and (r.payload is None or bytes(r.payload) == text[r.page_id]) for r in got if r.page_id is not None)
    assert W.records(W.archives(pages.limit(0))).count() == 0
    for r in stored.collect():
        (tmp_path / f"{r.archive}.warc.gz").write_bytes(r.content)
    assert W.read_files(spark, str(tmp_path)).count() == len(rows)


def test_digest():
    assert W.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and len(hashlib.sha1(b"").digest()) == 20

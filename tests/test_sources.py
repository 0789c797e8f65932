import io
import random
import struct
import zipfile
import zlib

import pytest

from bytelake.sources import opcodes, zips
from bytelake.sources.classfile import decode, mutf8
from tests.builder import ClassBuilder


def archive(names, method=zipfile.ZIP_DEFLATED):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", method) as z:
        for n in names:
            z.writestr(n, (n * 50).encode())
    return raw.getvalue()


def test_entries():
    data = archive(["a/B.class", "c.txt", "../x.class", "/abs.class", "C:x.class", "d\\e.class", ""])
    got = {e.name: e for e in zips.entries(data)}
    assert set(got) == {"a/B.class", "c.txt", "d/e.class"} and all(e.status == "ok" for e in got.values())
    assert got["a/B.class"].data == b"a/B.class" * 50 and zlib.crc32(got["c.txt"].data) == got["c.txt"].crc32


def test_without_a_directory():
    data = archive(["a.class", "b.class"], zipfile.ZIP_STORED)
    cut = data[: data.find(zips.CENTRAL)]
    assert [e.name for e in zips.entries(b"junk" + cut)] == ["a.class", "b.class"]
    assert list(zips.entries(b"")) == list(zips.entries(b"PK")) == []


def test_odd_entries_are_reported():
    data = bytearray(archive(["a.class", "b.class", "c.class"]))
    at = [k for k in range(len(data)) if data[k : k + 4] == zips.CENTRAL]
    data[at[0] + 8] |= 1
    data[at[1] + 10] = 9
    start = data.find(b"c.class") + 7
    data[start : start + 3] = b"\xff\xff\xff"
    assert [e.status for e in zips.entries(bytes(data))] == ["encrypted", "method", "damaged"]


def test_inflate_vectors():
    assert zips.inflate(bytes.fromhex("010300fcff686579")) == b"hey"
    pack = zlib.compressobj(9, zlib.DEFLATED, -15)
    raw = pack.compress(b"The quick brown fox jumps over the lazy dog. " * 20) + pack.flush()
    assert zips.inflate(raw) == b"The quick brown fox jumps over the lazy dog. " * 20
    assert zips.inflate(raw[:-3]) is None and zips.inflate(raw, cap=10) is None and zips.inflate(b"\xff") is None


def test_stored_archives_can_be_read():
    files = [("a/B.java", b"class B {}"), ("é.java", b"")]
    data = zips.stored(files)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and [(n, z.read(n)) for n in z.namelist()] == files
    assert [(e.name, e.data) for e in zips.entries(data)] == files


@pytest.mark.parametrize(("code", "ops", "notes"), [("000003ac", ["nop", "nop", "iconst", "ireturn"], 0), ("10", ["malformed"], 1), ("130102b1", ["ldc", "return"], 0), ("fe", ["unknown"], 1)])
def test_decode(code, ops, notes):
    rows, found = opcodes.decode(bytes.fromhex(code))
    assert [r["op"] for r in rows] == ops and len(found) == notes


def test_switches():
    table = bytes.fromhex("aa000000") + struct.pack(">iiiii", 8, 1, 2, 4, 6)
    (row,), _ = opcodes.decode(table)
    assert (row["length"], row["keys"], row["targets"], row["default"]) == (24, [1, 2], [4, 6], 8)
    lookup = bytes.fromhex("00ab0000") + struct.pack(">iiii", 20, 1, -5, 7)
    row = opcodes.decode(lookup)[0][1]
    assert (row["keys"], row["targets"], row["default"], row["length"]) == ([-5], [8], 21, 19)
    huge = bytes.fromhex("aa000000") + struct.pack(">iii", 0, 0, 2**31 - 1)
    assert opcodes.decode(huge)[0][0]["op"] == "malformed"


def test_wide():
    rows, _ = opcodes.decode(bytes.fromhex("c4150100c4840100ffff1a"))
    assert [(r["op"], r.get("var"), r.get("value")) for r in rows] == [("iload", 256, None), ("iinc", 256, -1), ("iload", 0, None)]


def test_modified_utf8():
    assert mutf8(b"abc") == "abc" and mutf8(b"a\xc0\x80b") == "a\0b"
    assert mutf8(b"\xed\xa0\xbd\xed\xb8\x80") == "\U0001f600" and mutf8("é".encode()) == "é"
    for bad in (b"\xff", b"\0", "\U0001f600".encode(), b"\xc3"):
        with pytest.raises(UnicodeDecodeError):
            mutf8(bad)


def sample():
    b = ClassBuilder(interfaces=["c/I"])
    b.field("f", "I", 0x2, [b.attribute("ConstantValue", struct.pack(">H", b.integer(7))), b.attribute("Deprecated", b"")])
    lines = b.attribute("LineNumberTable", struct.pack(">HHHHH", 2, 3, 11, 0, 10))
    lvt = b.attribute("LocalVariableTable", struct.pack(">HHHHHH", 1, 0, 4, b.utf8("this"), b.utf8("La/B;"), 0))
    frames = b.attribute("StackMapTable", struct.pack(">HBBB", 2, 1, 1, 0)[:2] + bytes([1, 252, 0, 0, 7]) + struct.pack(">H", b.cls("x/Y")))
    b.method("m", "()I", 1, [b.code(bytes.fromhex("000003ac"), [(0, 3, 3, 0)], [lines, lvt, frames])])
    anno = struct.pack(">HHHHBH", 1, b.utf8("Lq/Anno;"), 1, b.utf8("text"), ord("s"), b.utf8("hello"))
    b.attributes.append(b.attribute("RuntimeVisibleAnnotations", anno))
    b.long(5)
    return b.build()


def test_tables():
    r = decode(sample())
    t = r.tables
    assert r.root["status"] == "ok" and not t["diagnostics"]
    assert t["fields"][0]["deprecated"] and t["fields"][0]["const_idx"] and [x["op"] for x in t["insns"]] == ["nop", "nop", "iconst", "ireturn"]
    assert [(x["pc"], x["line"]) for x in t["lines"]] == [(0, 10), (3, 11)] and len(t["lvt"]) == len(t["handlers"]) == len(t["interfaces"]) == 1
    assert [(f["delta"], f["pc"], f["kind"]) for f in t["frames"]] == [(1, 1, "same"), (0, 2, "append")] and t["frames"][1]["locals"][0]["type"] == "object"
    assert '"hello"' in t["annotations"][0]["value"]
    assert [c["status"] for c in t["cp"]].count("missing") == 2  # slot 0 and the second half of the long


def test_bad_utf8_is_malformed_only():
    b = ClassBuilder()
    b.utf8(b"\xff")
    r = decode(b.build())
    assert r.root["status"] == "ok" and [c["status"] for c in r.tables["cp"]].count("malformed") == 1 and r.tables["diagnostics"]


def test_damage_never_fails():
    data, rng = sample(), random.Random(2)
    assert decode(b"\0\0\0\0junk").root["status"] == "fatal"
    for n in range(len(data)):
        assert decode(data[:n]).root["status"] in ("fatal", "ok")
    for flips in (1, 5, 20):
        for _ in range(200):
            bad = bytearray(data)
            for _ in range(flips):
                bad[rng.randrange(4, len(bad))] = rng.randrange(256)
            r = decode(bytes(bad))
            assert r.root["status"] in ("fatal", "ok")


def test_more_entries_than_sixteen_bits_count():
    files = [(f"f{k}.txt", b"") for k in range(70_000)]
    data = zips.stored(files)
    assert [(e.name, e.data) for e in zips.entries(data)] == files
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert len(z.namelist()) == 70_000 and z.testzip() is None
    cut = data[: data.find(zips.CENTRAL)]
    assert sum(1 for _ in zips.entries(cut)) == 70_000


def test_wide_sizes_and_offsets():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        with z.open("a.class", "w", force_zip64=True) as f:
            f.write(b"x" * 100)
    assert [(e.name, e.data) for e in zips.entries(raw.getvalue())] == [("a.class", b"x" * 100)]
    extra = struct.pack("<HHQQQ", 1, 24, 7, 8, 9)
    assert zips._wide(extra, [True, True, True]) == [7, 8, 9] and zips._wide(b"\x09\0\x01\0z" + extra, [False, False, True]) == [None, None, 7]
    assert zips.directory_entry(b"n", 1, 2, 1 << 33)[-12:] == struct.pack("<HHQ", 1, 8, 1 << 33)


def test_one_entry_and_large_ones():
    data = archive(["a.class", "b.class", "a.class"])
    assert [e.name for e in zips.entries(data, only="a.class")] == ["a.class", "a.class"] and list(zips.entries(data, only="c")) == []
    assert zips._inflate(zlib.compress(b"x" * 50, 9, -15), 10) == ("large", None)

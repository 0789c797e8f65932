"""A tolerant reader of zip archives, and a writer of stored ones."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

LOCAL, CENTRAL, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
END64, LOCATOR64 = b"PK\x06\x06", b"PK\x06\x07"
#: Bytes that one entry may unpack to: so much fits into one value of a row. Larger ones are told apart from damaged ones.
CAP = (2 << 30) - (64 << 20)


@dataclass
class Entry:
    name: str
    status: str  # ok, encrypted, method, damaged, large
    data: bytes | None
    crc32: int
    packed_size: int
    offset: int


def safe_name(name: str) -> bool:
    """Relative, and without a way out of the folder it is unpacked to."""
    return bool(name) and name[0] != "/" and ":" not in name and ".." not in name.split("/")


def _name(raw: bytes) -> str:
    return raw.decode("utf-8", "replace").replace("\\", "/")


def inflate(raw: bytes, cap: int = CAP) -> bytes | None:
    """The content of a raw deflate stream, or None if it is damaged, cut off or over the cap."""
    return _inflate(raw, cap)[1]


def _inflate(raw: bytes, cap: int) -> tuple[str, bytes | None]:
    unpack = zlib.decompressobj(-15)
    try:
        out = unpack.decompress(raw, cap)
    except zlib.error:
        return "damaged", None
    if unpack.eof:
        return "ok", out
    return ("large" if len(out) >= cap else "damaged"), None


def _entry(data: bytes, name: str, flags: int, method: int, crc: int, size: int, start: int, offset: int, cap: int = CAP) -> Entry:
    if flags & 1:
        return Entry(name, "encrypted", None, crc, size, offset)
    if method not in (0, 8):
        return Entry(name, "method", None, crc, size, offset)
    raw = data[start : start + size]
    if len(raw) < size:
        return Entry(name, "damaged", None, crc, size, offset)
    status, content = ("ok", raw) if method == 0 else _inflate(raw, cap)
    return Entry(name, status, content, crc, size, offset)


def _wide(extra: bytes, needed: list[bool]) -> list[int | None]:
    """The 64-bit values of an extra field that stand for those of size, packed size and offset that are needed."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{min(n, len(extra) - at - 4) // 8}Q", extra, at + 4))
            return [next(values, None) if x else None for x in needed]
        at += 4 + n
    return [None] * len(needed)


def _directory(data: bytes) -> tuple[int, int] | None:
    """(entries, offset) of the central directory, by its 64-bit record where there is one."""
    end = data.rfind(END, max(0, len(data) - 22 - 0xFFFF))
    if end < 0 or end + 22 > len(data):
        return None
    count, at = struct.unpack_from("<H", data, end + 10)[0], struct.unpack_from("<I", data, end + 16)[0]
    if data[end - 20 : end - 16] == LOCATOR64 and end >= 20:
        wide = struct.unpack_from("<Q", data, end - 12)[0]
        if data[wide : wide + 4] == END64 and wide + 56 <= len(data):
            count, at = struct.unpack_from("<Q", data, wide + 32)[0], struct.unpack_from("<Q", data, wide + 48)[0]
    return count, at


def _central(data: bytes, only: str | None) -> Iterator[Entry | None]:
    """Entries by the central directory; None for those that are passed over."""
    found = _directory(data)
    if found is None:
        return
    count, at = found
    for _ in range(count):
        if data[at : at + 4] != CENTRAL or at + 46 > len(data):
            return
        flags, method = struct.unpack_from("<HH", data, at + 8)
        crc, size, whole = struct.unpack_from("<III", data, at + 16)
        n, extra, comment = struct.unpack_from("<HHH", data, at + 28)
        offset = struct.unpack_from("<I", data, at + 42)[0]
        name = _name(data[at + 46 : at + 46 + n])
        full = 0xFFFFFFFF
        if full in (size, whole, offset):
            _, wide_size, wide_offset = _wide(data[at + 46 + n : at + 46 + n + extra], [whole == full, size == full, offset == full])
            size, offset = wide_size if wide_size is not None else size, wide_offset if wide_offset is not None else offset
        at += 46 + n + extra + comment
        if not safe_name(name) or only is not None and name != only:
            yield None
            continue
        if data[offset : offset + 4] != LOCAL or offset + 30 > len(data):
            yield Entry(name, "damaged", None, crc, size, offset)
            continue
        start = offset + 30 + sum(struct.unpack_from("<HH", data, offset + 26))  # the local header decides where data start
        yield _entry(data, name, flags, method, crc, size, start, offset)


def _scan(data: bytes, only: str | None) -> Iterator[Entry]:
    """Entries by their local headers, wherever one can be found; ends where a size is only known after the data."""
    at = 0
    while True:
        at = data.find(LOCAL, at)
        if at < 0 or at + 30 > len(data):
            return
        flags, method = struct.unpack_from("<HH", data, at + 6)
        crc, size, whole = struct.unpack_from("<III", data, at + 14)
        n, extra = struct.unpack_from("<HH", data, at + 26)
        start = at + 30 + n + extra
        if flags & 8:
            return
        name = _name(data[at + 30 : at + 30 + n])
        if size == 0xFFFFFFFF:
            size = _wide(data[at + 30 + n : start], [whole == size, True])[1] or size
        if safe_name(name) and only in (None, name):
            yield _entry(data, name, flags, method, crc, size, start, at)
        at = start + size if start + size > at else at + 1


def entries(data: bytes, only: str | None = None) -> Iterator[Entry]:
    """Entries of an archive, by its central directory, or by local headers where there is none; 64-bit sizes and counts included. Never fails. only: those of this name."""
    found = False
    for e in _central(data, only):
        found = True
        if e is not None:
            yield e
    if not found:
        yield from _scan(data, only)


def local_header(name: bytes, size: int, crc: int) -> bytes:
    return LOCAL + _common(name, size, crc) + name


def _common(name: bytes, size: int, crc: int) -> bytes:
    return struct.pack("<HHHHHIIIHH", 20, 0 if name.isascii() else 0x800, 0, 0, 0x21, crc, size, size, len(name), 0)


def directory_entry(name: bytes, size: int, crc: int, offset: int) -> bytes:
    """Of a file's local header at offset, with a 64-bit extra field where 32 bits do not hold the offset."""
    wide = struct.pack("<HHQ", 1, 8, offset) if offset >= 0xFFFFFFFF else b""
    common = _common(name, size, crc)[:-2] + struct.pack("<H", len(wide))
    return CENTRAL + struct.pack("<H", 45 if wide else 20) + common + struct.pack("<HHHII", 0, 0, 0, 0, min(offset, 0xFFFFFFFF)) + name + wide


def directory_end(count: int, size: int, offset: int) -> bytes:
    """Behind a central directory of that many entries and bytes; the 64-bit record comes before it where it is needed."""
    out = b""
    if count >= 0xFFFF or size >= 0xFFFFFFFF or offset >= 0xFFFFFFFF:
        out = END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, size, offset) + LOCATOR64 + struct.pack("<IQI", 0, offset + size, 1)
    n = min(count, 0xFFFF)
    return out + END + struct.pack("<HHHHIIH", 0, 0, n, n, min(size, 0xFFFFFFFF), min(offset, 0xFFFFFFFF), 0)


def stored(files: list[tuple[str, bytes]]) -> bytes:
    """An archive of uncompressed files, of any number and, by 64-bit records, of any size; each file is below 4 GB."""
    body, directory, at = [], [], 0
    for name, data in files:
        raw, crc = name.encode(), zlib.crc32(data)
        directory.append(directory_entry(raw, len(data), crc, at))
        body += [local_header(raw, len(data), crc), data]
        at += len(body[-2]) + len(data)
    listing = b"".join(directory)
    return b"".join([*body, listing, directory_end(len(files), len(listing), at)])

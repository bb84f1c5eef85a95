"""Reading the ZIP format: one archive in memory or behind a seekable file. No Spark here; tasks call it."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from struct import Struct

from ..errors import CorruptArchive
from ..functions.codec import DECODERS

# Fixed values of the format.
LOCAL, CENTRAL, END, END64, LOCATOR, DESCRIPTOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50, 0x08074B50
FULL16, FULL32, TAG64 = 0xFFFF, 0xFFFFFFFF, 0x0001
HAS_DESCRIPTOR = 1 << 3
#: Below what a 64-bit field must be: by default as the reference reads them, or all that a bigint column holds.
SAFE, BIGINT = 1 << 53, 1 << 63
TAIL = 22 + 65_535 + 1
_LOCAL, _CENTRAL = Struct("<IHHHHHIIIHH"), Struct("<IHHHHHHIIIHHHHHII")
_END, _END64, _LOCATOR = Struct("<IHHHHIIH"), Struct("<IQHHIIQQQQ"), Struct("<IIQI")
Read = Callable[[int, int], bytes]


@dataclass
class Entry:
    ordinal: int
    name: str
    method: int
    crc32: int
    compressed_size: int
    uncompressed_size: int
    offset: int
    last_modified: datetime
    comment: str = ""


def text(raw: bytes) -> str:
    """Names are read as UTF-8 whatever the flag says; bad bytes become U+FFFD and a leading byte order mark goes."""
    return raw.decode("utf-8", "replace").removeprefix("﻿")


def moment(date: int, time: int) -> datetime:
    """Fields out of range roll over into their neighbours."""
    months = 12 * (1980 + (date >> 9)) + (date >> 5 & 15) - 1
    start = datetime(months // 12, months % 12 + 1, 1)
    return start + timedelta(days=(date & 31) - 1, hours=time >> 11, minutes=time >> 5 & 63, seconds=2 * (time & 31))


def _safe(n: int, limit: int) -> int:
    if n >= limit:
        raise CorruptArchive(f"a 64-bit field of 2^{limit.bit_length() - 1} or more")
    return n


def _unpack(s: Struct, data: bytes, at: int, what: str) -> tuple:
    if at < 0 or at + s.size > len(data):
        raise CorruptArchive(f"{what} is cut off")
    return s.unpack_from(data, at)


def find_end(tail: bytes) -> int:
    """Where the end record begins in an archive's tail: the last signature whose comment fits what follows; -1 if there is none."""
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0:
        if at + 22 <= len(tail) and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") <= len(tail):
            return at
        at = tail.rfind(b"PK\x05\x06", 0, at)
    return -1


def directory_span(size: int, read: Read, limit: int = SAFE) -> tuple[int, int, int]:
    """(entries, bytes, offset) of the directory; 64-bit fields must be below `limit`."""
    if size == 0:
        raise CorruptArchive("the archive is empty")
    base = max(0, size - TAIL)
    tail = read(base, size - base)
    at = find_end(tail)
    if at < 0:
        raise CorruptArchive("no end of central directory")
    _, _, _, _, n, length, offset, _ = _END.unpack_from(tail, at)
    if FULL16 == n or FULL32 in (length, offset):
        where = base + at - _LOCATOR.size
        locator = read(where, _LOCATOR.size) if where >= 0 else b""
        sign, _, record, _ = _unpack(_LOCATOR, locator, 0, "the 64-bit locator")
        if sign == LOCATOR:
            wide = read(_safe(record, limit), _END64.size)
            sign, _, _, _, _, _, _, n, length, offset = _unpack(_END64, wide, 0, "the 64-bit end record")
            if sign != END64:
                raise CorruptArchive("bad signature of the 64-bit end record")
            n, length, offset = _safe(n, limit), _safe(length, limit), _safe(offset, limit)
        elif FULL32 in (length, offset):
            raise CorruptArchive("no 64-bit locator")
        # else: exactly 65,535 entries and no 64-bit record, which the format allows
    return n, length, offset


def wide_fields(extra: bytes, usize: int, csize: int, offset: int, where: str, limit: int = SAFE) -> tuple[int, int, int]:
    """The three numbers, with those at their sentinel taken from the 64-bit extra field in its fixed order; these must be below `limit`."""
    want = [usize == FULL32, csize == FULL32, offset == FULL32]
    if not any(want):
        return usize, csize, offset
    at = 0
    while at + 4 <= len(extra):
        tag, n = int.from_bytes(extra[at : at + 2], "little"), int.from_bytes(extra[at + 2 : at + 4], "little")
        body = extra[at + 4 : at + 4 + n]
        if len(body) < n:
            raise CorruptArchive(f"the extra field of {where} is cut off")
        if tag == TAG64:
            got, k = [usize, csize, offset], 0
            for i, wanted in enumerate(want):
                if wanted:
                    if 8 * k + 8 > n:
                        raise CorruptArchive(f"the 64-bit field of {where} is too short")
                    got[i] = _safe(int.from_bytes(body[8 * k : 8 * k + 8], "little"), limit)
                    k += 1
            return got[0], got[1], got[2]
        at += 4 + n
    raise CorruptArchive(f"{where} needs a 64-bit field and has none")


def parse_directory(data: bytes, count: int, limit: int = SAFE) -> list[Entry]:
    out, at = [], 0
    for i in range(count):
        sign, _, _, _, method, time, date, crc, csize, usize, n, x, c, _, _, _, offset = _unpack(_CENTRAL, data, at, f"directory entry {i}")
        if sign != CENTRAL:
            raise CorruptArchive(f"bad signature of directory entry {i}")
        at += _CENTRAL.size
        if at + n + x + c > len(data):
            raise CorruptArchive(f"directory entry {i} is cut off")
        name, extra, comment = data[at : at + n], data[at + n : at + n + x], data[at + n + x : at + n + x + c]
        at += n + x + c
        usize, csize, offset = wide_fields(extra, usize, csize, offset, f"directory entry {i}", limit)
        out.append(Entry(i, text(name), method, crc, csize, usize, offset, moment(date, time), text(comment)))
    return out


def directory(size: int, read: Read) -> list[Entry]:
    """All entries, from two reads, or four with 64-bit records; no data is read."""
    n, length, offset = directory_span(size, read)
    data = read(offset, length)
    if len(data) < length:
        raise CorruptArchive("the directory is cut off")
    return parse_directory(data, n)


def lookup(entries: list[Entry], name: str) -> Entry | None:
    """By exact name; of duplicates the last."""
    return next((e for e in reversed(entries) if e.name == name), None)


def status_of(data: bytes | None, e: Entry) -> str:
    """A stored checksum or size of 0 says nothing."""
    if data is None:
        return "corrupt"
    if e.crc32 and zlib.crc32(data) != e.crc32:
        return "crc_mismatch"
    if e.uncompressed_size and len(data) != e.uncompressed_size:
        return "size_mismatch"
    return "ok"


def decode(e: Entry, raw: bytes) -> tuple[bytes | None, str]:
    """(content, status): ok, crc_mismatch, size_mismatch, truncated, corrupt, or unsupported_method."""
    if len(raw) < e.compressed_size:
        return None, "truncated"
    f = DECODERS.get(e.method)
    if f is None:
        return None, "unsupported_method"
    try:
        data = f(raw)
    except (ValueError, zlib.error):
        return None, "corrupt"
    return data, status_of(data, e)


def content(e: Entry, read: Read) -> tuple[bytes | None, str]:
    head = read(e.offset, _LOCAL.size)
    if len(head) < _LOCAL.size:
        return None, "truncated"
    sign, *_, n, x = _LOCAL.unpack(head)
    if sign != LOCAL:
        return None, "corrupt"
    return decode(e, read(e.offset + _LOCAL.size + n + x, e.compressed_size))


def scan(data: bytes) -> Iterator[tuple[Entry, bytes | None, str]]:
    """Goes through local entries from the front, without the directory, up to the first other record.

    Entries with a data descriptor and no sizes are read if deflated, for their stream ends itself. A cut-off entry is the last.
    """
    view, at, i = memoryview(data), 0, 0
    while at + 4 <= len(data) and int.from_bytes(view[at : at + 4], "little") == LOCAL:
        start = at
        if at + _LOCAL.size > len(data):
            return
        _, _, flags, method, time, date, crc, csize, usize, n, x = _LOCAL.unpack_from(data, at)
        at += _LOCAL.size
        name, extra = bytes(view[at : at + n]), bytes(view[at + n : at + n + x])
        at += n + x
        if FULL32 in (usize, csize):
            try:
                usize, csize, _ = wide_fields(extra, usize, csize, 0, "a local entry")
            except CorruptArchive:
                pass
        e = Entry(i, text(name), method, crc, csize, usize, start, moment(date, time))
        if flags & HAS_DESCRIPTOR:
            if csize == 0:
                if method != 8:
                    yield e, None, "unsupported_method"
                    return
                d = zlib.decompressobj(-15)
                try:
                    body = d.decompress(bytes(view[at:])) + d.flush()
                except zlib.error:
                    yield e, None, "corrupt"
                    return
                if not d.eof:
                    yield e, None, "truncated"
                    return
                e.compressed_size = len(data) - at - len(d.unused_data)
            raw = bytes(view[at : at + e.compressed_size])
            at += e.compressed_size
            if int.from_bytes(view[at : at + 4], "little") == DESCRIPTOR:
                at += 4
            e.crc32, _, e.uncompressed_size = (int.from_bytes(view[at + k : at + k + 4], "little") for k in (0, 4, 8))
            at += 12
        else:
            raw = bytes(view[at : at + csize])
            at += csize
        yield e, *decode(e, raw)
        i += 1

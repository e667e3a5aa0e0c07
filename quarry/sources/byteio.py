"""Byte sources: local files, ranged HTTP, xz and gzip; small, picklable and opened by each task.

Offsets are of the decompressed bytes throughout.  ``cuts`` lists offsets at which a
read can start without decompressing what comes before; plain sources can be cut anywhere.
"""

from __future__ import annotations

import lzma
import os
import struct
import tempfile
import zlib
from bisect import bisect_right
from dataclasses import dataclass, field
from urllib.parse import urlsplit
from urllib.request import Request, urlopen

from ..errors import DumpError, SourceChanged

TIMEOUT_S = 30


@dataclass
class LocalSource:
    path: str

    def size(self) -> int:
        return os.path.getsize(self.path)

    def identity(self) -> dict:
        s = os.stat(self.path)
        return {"size": s.st_size, "modified": s.st_mtime_ns, "location": os.path.abspath(self.path)}

    def read(self, start: int, end: int) -> bytes:
        with open(self.path, "rb") as f:
            f.seek(start)
            return f.read(max(0, end - start))

    def cuts(self) -> list[int] | None:
        return None


@dataclass
class HttpSource:
    """Ranged GETs; the server has to answer them with 206 and an unchanged tag."""

    url: str
    tag: str | None = None
    length: int | None = None

    def __post_init__(self):
        parts = urlsplit(self.url)
        if parts.username or parts.password:
            raise DumpError("URLs with credentials are refused")

    def _open(self, start: int, end: int):
        answer = urlopen(Request(self.url, headers={"Range": f"bytes={start}-{end - 1}"}), timeout=TIMEOUT_S)
        if answer.status != 206:
            raise DumpError(f"{self.url} does not serve ranges")
        tag = answer.headers.get("ETag") or answer.headers.get("Last-Modified")
        if self.tag and tag != self.tag:
            raise SourceChanged(f"{self.url} has changed")
        self.tag = self.tag or tag
        self.length = int(answer.headers["Content-Range"].rpartition("/")[2])
        return answer

    def size(self) -> int:
        """Asked once: an answer of another tag is refused."""
        if self.length is None:
            self._open(0, 1).close()
        return self.length

    def identity(self) -> dict:
        self.length = None  # the server is asked anew
        size = self.size()
        return {"size": size, "modified": self.tag, "location": self.url}

    def read(self, start: int, end: int) -> bytes:
        end = min(end, self.size())
        out = b""
        while start + len(out) < end:  # a server may send less than it was asked for
            with self._open(start + len(out), end) as answer:
                part = answer.read()
            if not part:
                raise DumpError(f"{self.url} ended early")
            out += part
        return out[: max(0, end - start)]

    def cuts(self) -> list[int] | None:
        return None


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        at += 1
        if not data[at - 1] & 128:
            return value, at
        shift += 7


@dataclass
class BlockSource:
    """Independently compressed blocks: (offset, end, first byte, length) of each, in order."""

    raw: LocalSource | HttpSource
    blocks: list[tuple[int, int, int, int]] = field(default_factory=list)

    def size(self) -> int:
        return self.blocks[-1][2] + self.blocks[-1][3] if self.blocks else 0

    def identity(self) -> dict:
        return self.raw.identity()

    def cuts(self) -> list[int]:
        """Built once, when the blocks are known."""
        if len(self.__dict__.get("_cuts", ())) != len(self.blocks):
            self._cuts = [b[2] for b in self.blocks]
        return self._cuts

    def inflate(self, data: bytes, length: int) -> bytes:
        raise NotImplementedError

    def block(self, at: int) -> bytes:
        """An inflated block; the last one is kept, so that reads in small steps inflate it once."""
        if self.__dict__.get("_last", (None,))[0] != at:
            a, b, _, length = self.blocks[at]
            self._last = (at, self.inflate(self.raw.read(a, b), length) if length else b"")
        return self._last[1]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_cuts", "_last")}

    def read(self, start: int, end: int) -> bytes:
        at, out = max(0, bisect_right(self.cuts(), start) - 1), []
        while at < len(self.blocks) and self.blocks[at][2] < end:
            first = self.blocks[at][2]
            out.append(self.block(at)[max(0, start - first) : max(0, end - first)])
            at += 1
        return b"".join(out)


class XzSource(BlockSource):
    """The blocks that the indexes at the ends of the file's streams list."""

    @classmethod
    def open(cls, raw) -> XzSource:
        end, streams = raw.size(), []
        while end > 0:
            tail = raw.read(max(0, end - 12), end)
            if tail[-4:] == b"\0\0\0\0":  # padding between streams
                end -= 4
                continue
            if tail[-2:] != b"YZ":
                raise DumpError("not a whole xz file")
            index_size = (struct.unpack("<I", tail[4:8])[0] + 1) * 4
            index = raw.read(end - 12 - index_size, end - 12)
            count, at = varint(index, 1)
            records = []
            for _ in range(count):
                stored, at = varint(index, at)
                length, at = varint(index, at)
                records.append((stored, length))
            check = {0: 0, 1: 4, 4: 8, 10: 32}.get(tail[9] & 15, 0)
            begin = end - 12 - index_size - sum(-(-s // 4) * 4 for s, _ in records) - 12
            streams.append((begin + 12, check, records))
            end = begin
        source, first = cls(raw), 0
        for at, check, records in reversed(streams):
            for stored, length in records:
                source.blocks.append((at, at + stored - check, first, length))
                at, first = at + -(-stored // 4) * 4, first + length
        return source

    def inflate(self, data: bytes, length: int) -> bytes:
        header, at, filters = (data[0] + 1) * 4, 2, []
        if data[1] & 64:
            _, at = varint(data, at)
        if data[1] & 128:
            _, at = varint(data, at)
        for _ in range((data[1] & 3) + 1):
            kind, at = varint(data, at)
            size, at = varint(data, at)
            filters.append(lzma._decode_filter_properties(kind, data[at : at + size]))
            at += size
        return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters).decompress(data[header:], length)


class BgzfSource(BlockSource):
    """Gzip members that tell their size in an extra field."""

    @classmethod
    def open(cls, raw) -> BgzfSource | None:
        """None if a member has no size: plain gzip."""
        source, at, first, size = cls(raw), 0, 0, raw.size()
        while at < size:
            head = raw.read(at, at + 64)
            stored = bgzf_size(head)
            if stored is None:
                return None
            length = struct.unpack("<I", raw.read(at + stored - 4, at + stored))[0]
            source.blocks.append((at, at + stored, first, length))
            at, first = at + stored, first + length
        return source

    def inflate(self, data: bytes, length: int) -> bytes:
        return zlib.decompress(data, 31)


class GzipSource(BgzfSource):
    """Plain gzip of several members, each of LARGEST bytes at most: where one ends is known once it is inflated, so this is done once."""

    LARGEST = 16 << 20

    @classmethod
    def open(cls, raw) -> GzipSource | None:
        """None if a member is larger, so that it is no place to begin at."""
        source, at, size, first = cls(raw), 0, raw.size(), 0
        inflater, begun, length = zlib.decompressobj(31), 0, 0
        while at < size:
            data = raw.read(at, min(at + (1 << 20), size))
            at += len(data)
            while data:
                length += len(inflater.decompress(data, cls.LARGEST + 1 - length))
                if length > cls.LARGEST:
                    return None
                data = inflater.unused_data
                if inflater.eof:
                    end = at - len(data)
                    source.blocks.append((begun, end, first, length))
                    inflater, begun, first, length = zlib.decompressobj(31), end, first + length, 0
        if begun < size:
            raise DumpError("the gzip stream ends early")
        return source


def bgzf_size(head: bytes) -> int | None:
    if head[:3] != b"\x1f\x8b\x08" or not head[3] & 4:
        return None
    at, end = 12, 12 + struct.unpack("<H", head[10:12])[0]
    while at + 4 <= end:
        size = struct.unpack("<H", head[at + 2 : at + 4])[0]
        if head[at : at + 2] == b"BC" and size == 2:
            return struct.unpack("<H", head[at + 4 : at + 6])[0] + 1
        at += 4 + size
    return None


def spool(raw, folder: str | None = None) -> LocalSource:
    """Decompress plain gzip once, as it can't be cut, into ``folder``, which all executors must see."""
    target = tempfile.NamedTemporaryFile(dir=folder, prefix="spooled-", suffix=".sql", delete=False)
    inflater, at, size = zlib.decompressobj(31), 0, raw.size()
    with target:
        while at < size:
            data = raw.read(at, at + (1 << 22))
            at += len(data)
            while data:
                target.write(inflater.decompress(data))
                data = inflater.unused_data
                if data:  # another member
                    inflater = zlib.decompressobj(31)
        target.write(inflater.flush())
        if not inflater.eof:
            raise DumpError("the gzip stream ends early")
    return LocalSource(target.name)


def open_source(location: str, spool_to: str | None = None):
    """The source for a path, file:// or http(s):// URL; compression is told by the first bytes."""
    scheme = urlsplit(location).scheme
    if scheme in ("http", "https"):
        raw = HttpSource(location)
    elif scheme in ("", "file"):
        raw = LocalSource(urlsplit(location).path if scheme else location)
    else:
        raise DumpError(f"no byte source for {scheme}:")
    head = raw.read(0, min(6, raw.size())) if raw.size() else b""
    if head == b"\xfd7zXZ\0":
        return XzSource.open(raw)
    if head[:2] == b"\x1f\x8b":
        return BgzfSource.open(raw) or GzipSource.open(raw) or spool(raw, spool_to)
    if head[:4] == b"\x28\xb5\x2f\xfd" or head[:4] == b"\x04\x22\x4d\x18":
        raise DumpError("zstd and lz4 are not supported")
    if head[:5] == b"PGDMP":
        raise DumpError("custom-format archives are not supported: only plain scripts are")
    return raw

"""COPY text format: headers, terminator, fields and escapes."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import DumpError

#: Fixed values of the format.
TERMINATOR, NULL, MAX_LINE = b"\\.", b"\\N", 0x3FFFFFFE
LETTERS = {"b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11}

IDENTIFIER = r'(?:"(?:[^"]|"")+"|[A-Za-z_\x80-\U0010ffff][\w$\x80-\U0010ffff]*)'
HEADER = re.compile(rf"COPY ({IDENTIFIER})(?:\.({IDENTIFIER}))?(?: \(({IDENTIFIER}(?:, {IDENTIFIER})*)?\))? FROM stdin;\r?\n?$")
ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|x([0-9A-Fa-f]{1,2})|(.)|$)", re.S)


def unquote(name: str) -> str:
    """An identifier as the server stores it: quoted verbatim, bare in lower case."""
    return name[1:-1].replace('""', '"') if name.startswith('"') else name.lower()


def quote(name: str) -> str:
    return name if re.fullmatch(r"[a-z_][a-z0-9_$]*", name) else '"' + name.replace('"', '""') + '"'


@dataclass(frozen=True)
class CopyHeader:
    schema: str | None
    table: str
    #: None without a list, which copies no column at all.
    columns: tuple[str, ...] | None


def parse_header(line: str) -> CopyHeader | None:
    """The header that a line is, or None: ``TO stdout`` and ``WITH (...)`` are other statements."""
    m = HEADER.match(line)
    if not m:
        return None
    first, second, names = m.groups()
    columns = None if "(" not in line else tuple(map(unquote, re.findall(IDENTIFIER, names or "")))
    return CopyHeader(unquote(first) if second else None, unquote(second or first), columns)


def split_fields(line: bytes) -> list[bytes | None]:
    """Raw fields of a row; None for NULL.  A tab within a value is always escaped."""
    return [None if f == NULL else f for f in line.split(b"\t")]


def unescape_bytes(raw: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        octal, hexa, other = m.groups()
        if octal is not None:
            return bytes([int(octal, 8) & 255])
        if hexa is not None:
            return bytes([int(hexa, 16)])
        if other is None:
            return b"\\"
        return bytes([LETTERS[c]]) if (c := other.decode("latin-1")) in LETTERS else other

    return ESCAPE.sub(one, raw) if b"\\" in raw else raw


def unescape(raw: bytes) -> str:
    try:
        return unescape_bytes(raw).decode("utf-8")
    except UnicodeDecodeError as e:
        raise DumpError(f"a field is not UTF-8: {raw[:40]!r}") from e


SPECIAL = str.maketrans({"\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v"})


def escape(value: str | None) -> str:
    """The field text of a value, the inverse of ``unescape``."""
    return "\\N" if value is None else value.translate(SPECIAL)

"""Values of each type: text to value, value to text, and the order of values.

``decode`` gives the value that a column holds, ``Beyond`` for what the column's type can't hold, and
raises RefusedValue for what the declared type does not accept.  ``order_key`` gives a key
that Python compares as the database does.
"""

from __future__ import annotations

import ipaddress
import json
import math
import re
import struct
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Context, Decimal, InvalidOperation

from ..errors import RefusedValue
from .pgtypes import PgType

EXACT = Context(prec=200_000, Emax=999_999, Emin=-999_999)


@dataclass(frozen=True)
class Beyond:
    """A valid value that the column's type can't hold; rank orders it: -1 first, 1 last, 2 NaN."""

    rank: int
    text: str


def refuse(kind: str, text: str):
    raise RefusedValue(f"invalid input for {kind}: {text[:80]!r}")


INTEGER = re.compile(r"[+-]?\d+", re.A)
LIMITS = {"int2": (-(1 << 15), (1 << 15) - 1), "int4": (-(1 << 31), (1 << 31) - 1), "int8": (-(1 << 63), (1 << 63) - 1), "oid": (0, (1 << 32) - 1)}


def integer(kind: str, text: str) -> int:
    if not INTEGER.fullmatch(text):
        refuse(kind, text)
    value = int(text)
    low, high = LIMITS[kind]
    return value if low <= value <= high else refuse(kind, text)


FLOAT = re.compile(r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf(?:inity)?|nan))", re.A)


def floating(kind: str, text: str) -> float:
    if not FLOAT.fullmatch(text):
        refuse(kind, text)
    value = float(text)
    if kind == "float4" and math.isfinite(value):
        try:
            value = struct.unpack("f", struct.pack("f", value))[0]
        except OverflowError:
            refuse(kind, text)
    digits = re.split("[eE]", text)[0]
    if re.search(r"\d", text) and (math.isinf(value) or (value == 0 and re.search("[1-9]", digits))):
        refuse(kind, text)  # out of range, not infinite or zero
    return value


NUMERIC = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", re.A)
NOT_FINITE = {"nan": 2, "infinity": 1, "inf": 1, "+infinity": 1, "+inf": 1, "-infinity": -1, "-inf": -1}


def numeric(text: str) -> Decimal | Beyond:
    rank = NOT_FINITE.get(text.lower())
    if rank:
        return Beyond(rank, text)
    if not NUMERIC.fullmatch(text):
        refuse("numeric", text)
    value = EXACT.create_decimal(text)
    return value.copy_abs() if value == 0 else value


def decimal(text: str, precision: int, scale: int) -> Decimal | Beyond:
    """Rounded half away from zero at the scale, then refused if it has too many digits."""
    value = numeric(text)
    if isinstance(value, Beyond):
        return value if value.rank == 2 else refuse(f"numeric({precision},{scale})", text)
    try:
        value = value.quantize(Decimal(1).scaleb(-scale), ROUND_HALF_UP, EXACT)
    except InvalidOperation:
        refuse("numeric", text)
    if value != 0 and value.adjusted() + 1 > precision - scale:
        refuse(f"numeric({precision},{scale})", text)
    return value.copy_abs() if value == 0 else value


def days_from_civil(year: int, month: int, day: int) -> int:
    """Days from 1970-01-01 in the Gregorian calendar, for any year (0 is 1 BC)."""
    y = year - (month <= 2)
    cycle, of_cycle = divmod(y, 400)
    of_year = (153 * ((month + 9) % 12) + 2) // 5 + day - 1
    return cycle * 146097 + of_cycle * 365 + of_cycle // 4 - of_cycle // 100 + of_year - 719468


def civil_from_days(days: int) -> tuple[int, int, int]:
    cycle, rest = divmod(days + 719468, 146097)
    of_cycle = (rest - rest // 1460 + rest // 36524 - rest // 146096) // 365
    of_year = rest - (365 * of_cycle + of_cycle // 4 - of_cycle // 100)
    m = (5 * of_year + 2) // 153
    day, month = of_year - (153 * m + 2) // 5 + 1, (m + 2) % 12 + 1
    return of_cycle + cycle * 400 + (month <= 2), month, day


DATE = re.compile(r"(\d{4,7})-(\d\d)-(\d\d)( BC)?", re.A)
CLOCK = r"(\d\d):(\d\d)(?::(\d\d)(?:\.(\d{1,6})\d*)?)?"
ZONE = r"(Z|[+-]\d\d(?::?\d\d(?::?\d\d)?)?)"
STAMP = re.compile(rf"(\d{{4,7}})-(\d\d)-(\d\d)[ T]{CLOCK}\s*{ZONE}?( BC)?", re.A)
MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
#: The calendar that Spark shows and Python can hold; years beyond it are not representable.
FIRST_DAY, LAST_DAY = days_from_civil(1, 1, 1), days_from_civil(9999, 12, 31)
DAY_US = 86_400_000_000


def civil(kind: str, text: str, y: str, m: str, d: str, bc: str | None) -> int:
    year, month, day = int(y), int(m), int(d)
    if year == 0 or not 1 <= month <= 12:
        refuse(kind, text)
    year = 1 - year if bc else year
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    if not 1 <= day <= MONTH_DAYS[month - 1] + (leap and month == 2):
        refuse(kind, text)
    return days_from_civil(year, month, day)


def clock(kind: str, text: str, h: str, m: str, s: str | None, fraction: str | None) -> int:
    hours, minutes, seconds = int(h), int(m), int(s or 0)
    us = ((hours * 60 + minutes) * 60 + seconds) * 1_000_000 + int((fraction or "0").ljust(6, "0"))
    if minutes > 59 or seconds > 60 or us > DAY_US:
        refuse(kind, text)
    return us


def zone_seconds(text: str | None) -> int:
    if not text or text == "Z":
        return 0
    digits = text[1:].replace(":", "")
    parts = [int(digits[i : i + 2]) for i in range(0, len(digits), 2)]
    return (-1 if text[0] == "-" else 1) * sum(p * u for p, u in zip(parts, (3600, 60, 1)))


def date(text: str) -> int | Beyond:
    if text in ("infinity", "-infinity"):
        return Beyond(1 if text[0] == "i" else -1, text)
    m = DATE.fullmatch(text)
    if not m:
        refuse("date", text)
    days = civil("date", text, m[1], m[2], m[3], m[4])
    return days if FIRST_DAY <= days <= LAST_DAY else Beyond(0, text)


def timestamp(kind: str, text: str) -> int | Beyond:
    if text in ("infinity", "-infinity"):
        return Beyond(1 if text[0] == "i" else -1, text)
    m = STAMP.fullmatch(text)
    if not m:
        refuse(kind, text)
    us = civil(kind, text, m[1], m[2], m[3], m[9]) * DAY_US + clock(kind, text, *m.groups()[3:7])
    us -= zone_seconds(m[8]) * 1_000_000 if kind == "timestamptz" else 0
    return us if FIRST_DAY * DAY_US <= us < (LAST_DAY + 1) * DAY_US else Beyond(0, text)


def stamp_order(kind: str, text: str) -> int:
    """Microseconds or days for values beyond the calendar too."""
    if kind == "date":
        m = DATE.fullmatch(text)
        return civil(kind, text, m[1], m[2], m[3], m[4])
    m = STAMP.fullmatch(text)
    return civil(kind, text, m[1], m[2], m[3], m[9]) * DAY_US + clock(kind, text, *m.groups()[3:7]) - (zone_seconds(m[8]) * 1_000_000 if kind == "timestamptz" else 0)


TIME = re.compile(CLOCK, re.A)
TIMETZ = re.compile(rf"{CLOCK}{ZONE}", re.A)


def time_of_day(text: str) -> int | Beyond:
    m = TIME.fullmatch(text)
    if not m:
        refuse("time", text)
    us = clock("time", text, *m.groups())
    return us if us < DAY_US else Beyond(1, text)


def timetz(text: str) -> tuple[int, int]:
    """(UTC microseconds, seconds west of UTC): the order of the type."""
    m = TIMETZ.fullmatch(text)
    if not m:
        refuse("time with time zone", text)
    zone = zone_seconds(m[5])
    return clock("timetz", text, *m.groups()[:4]) - zone * 1_000_000, -zone


UNITS = {"year": 12, "mon": 1}
INTERVAL_PART = re.compile(r"([+-]?\d+) (year|mon|day)s?|([+-]?)(\d+):(\d\d)(?::(\d\d)(?:\.(\d{1,6}))?)?", re.A)


def interval(text: str) -> tuple[int, int, int] | Beyond:
    """(months, days, microseconds) of the postgres output style."""
    if text in ("infinity", "-infinity"):
        return Beyond(1 if text[0] == "i" else -1, text)
    months = days = us = at = 0
    for m in INTERVAL_PART.finditer(text):
        if text[at : m.start()].strip():
            refuse("interval", text)
        at = m.end()
        if m[2] == "day":
            days += int(m[1])
        elif m[2]:
            months += int(m[1]) * UNITS[m[2]]
        else:
            part = ((int(m[4]) * 60 + int(m[5])) * 60 + int(m[6] or 0)) * 1_000_000 + int((m[7] or "0").ljust(6, "0"))
            us += -part if m[3] == "-" else part
    if not at or text[at:].strip():
        refuse("interval", text)
    if not -(1 << 63) <= us < 1 << 63 or abs(months) >= 1 << 31 or abs(days) >= 1 << 31:
        refuse("interval", text)
    return (months, days, us) if abs(us) * 1000 < 1 << 63 else Beyond(0, text)


def interval_order(months: int, days: int, us: int) -> int:
    return (months * 30 + days) * DAY_US + us


def uuid(text: str) -> str:
    bare = re.sub(r"^\{(.*)\}$", r"\1", text)
    digits = bare.replace("-", "").lower()
    if not re.fullmatch(r"[0-9a-f]{32}", digits) or not re.fullmatch(r"(?:[0-9a-fA-F]{4}-?)*[0-9a-fA-F]{4}", bare):
        refuse("uuid", text)
    return "-".join((digits[:8], digits[8:12], digits[12:16], digits[16:20], digits[20:]))


def bytea(text: str) -> bytes:
    if text.startswith("\\x"):
        digits = re.sub(r"\s+", "", text[2:])
        if len(digits) % 2 or not re.fullmatch(r"[0-9a-fA-F]*", digits):
            refuse("bytea", text)
        return bytes.fromhex(digits)
    out, at, raw = bytearray(), 0, text.encode()
    while at < len(raw):
        if raw[at] != 92:
            out.append(raw[at])
            at += 1
        elif raw[at + 1 : at + 2] == b"\\":
            out.append(92)
            at += 2
        elif re.fullmatch(rb"[0-3][0-7]{2}", raw[at + 1 : at + 4]):
            out.append(int(raw[at + 1 : at + 4], 8))
            at += 4
        else:
            refuse("bytea", text)
    return bytes(out)


def characters(t: PgType, text: str) -> str:
    """Longer text is refused unless only blanks are too many; character(n) keeps its padding."""
    if t.args and len(text) > t.args[0]:
        if text[t.args[0] :].strip(" "):
            refuse(t.declared or t.kind, text)
        text = text[: t.args[0]]
    return text.ljust(t.args[0]) if t.kind == "bpchar" and t.args else text


def network(kind: str, text: str):
    """(family, address as int, prefix length)."""
    address, _, bits = text.partition("/")
    if kind == "cidr" and address.count(".") < 3 and ":" not in address:
        address += ".0" * (3 - address.count("."))
    try:
        ip = ipaddress.ip_address(address)
    except ValueError:
        refuse(kind, text)
    most = ip.max_prefixlen
    if bits and (not re.fullmatch(r"\d{1,3}", bits) or int(bits) > most):
        refuse(kind, text)
    prefix = int(bits) if bits else most
    if kind == "cidr" and int(ip) & ((1 << (most - prefix)) - 1):
        refuse(kind, text)  # bits to the right of the mask
    return ip.version, int(ip), prefix


def network_order(family: int, address: int, prefix: int) -> tuple:
    """Family, then the address bits of the shorter prefix, then prefix length, then the whole address.

    The bits of the network as text, closed by a mark under 0 and 1, sort that way.
    """
    most = 32 if family == 4 else 128
    bits = f"{address:0{most}b}"
    return family, bits[:prefix] + ".", bits


def mac(kind: str, text: str) -> str:
    digits = re.sub(r"[:.-]", "", text).lower()
    if not re.fullmatch(r"[0-9a-f]+", digits) or len(digits) not in ((12,) if kind == "macaddr" else (12, 16)):
        refuse(kind, text)
    if kind == "macaddr8" and len(digits) == 12:
        digits = digits[:6] + "fffe" + digits[6:]
    return ":".join(digits[i : i + 2] for i in range(0, len(digits), 2))


def parse_json(kind: str, text: str):
    def bad(name: str):
        refuse(kind, text)

    try:
        return json.loads(text, parse_float=Decimal, parse_int=Decimal, parse_constant=bad)
    except (ValueError, RecursionError):
        refuse(kind, text)


def json_order(value, top: bool = True) -> tuple:
    """Null, string, number, boolean, array, object; arrays and objects by size, then members.

    A lone scalar at the top stands as an array of one that is under all others but the empty array.
    """
    if isinstance(value, dict):
        pairs = sorted(((len(k.encode()), k.encode()), v) for k, v in value.items())
        return 17, len(pairs), tuple((k, json_order(v, False)) for k, v in pairs)
    if isinstance(value, list):
        return 16, len(value), 1, tuple(json_order(v, False) for v in value)
    if value is None:
        own = (0,)
    elif isinstance(value, bool):
        own = (3, value)
    elif isinstance(value, str):
        own = (1, value.encode())
    else:
        own = (2, value)
    return (16, 1, 0, (own,)) if top else own


# ---- nested literals -------------------------------------------------------------------------


def array_items(text: str, delimiter: str = ","):
    """Nested lists of texts and None; a leading [l:u] bound is checked and dropped."""
    bounds = re.match(r"(?:\[[+-]?\d+(?::[+-]?\d+)?\])+=", text)
    body, at = text[bounds.end() if bounds else 0 :].strip(), 0

    def parse(at: int):
        if body[at : at + 1] != "{":
            refuse("array", text)
        out, at = [], at + 1
        if body[at : at + 1] == "}":
            return out, at + 1
        while True:
            if body[at : at + 1] == "{":
                item, at = parse(at)
            elif body[at : at + 1] == '"':
                item, at = quoted(body, at, text)
            else:
                m = re.compile(rf"(?:\\.|[^\\{{}}\"{re.escape(delimiter)}])*", re.S).match(body, at)
                raw = m[0].strip()
                if not raw:
                    refuse("array", text)
                item, at = (None if raw.upper() == "NULL" else re.sub(r"\\(.)", r"\1", raw)), m.end()
            out.append(item)
            mark = body[at : at + 1]
            at += 1
            if mark == "}":
                return out, at
            if mark != delimiter:
                refuse("array", text)

    out, at = parse(at)
    if body[at:].strip():
        refuse("array", text)
    return out


def quoted(body: str, at: int, text: str) -> tuple[str, int]:
    """A double-quoted item: backslash and doubled quotes stand for themselves."""
    m = re.compile(r'"((?:[^"\\]|\\.|"")*)"', re.S).match(body, at)
    if not m:
        refuse("literal", text)
    return re.sub(r'\\(.)|""', lambda e: e[1] or '"', m[1], flags=re.S), m.end()


def dimensions(items) -> int:
    return 1 + dimensions(items[0]) if isinstance(items, list) and items and isinstance(items[0], list) else 1


def shape(items) -> tuple[int, ...]:
    """Lengths of each dimension; unequal parts are refused."""
    if not isinstance(items, list) or not items:
        return ()
    inner = {shape(x) if isinstance(x, list) else () for x in items}
    if len(inner) != 1:
        refuse("array", str(items)[:80])
    return (len(items), *inner.pop())


def record_items(text: str) -> list[str | None]:
    if text[:1] != "(" or text[-1:] != ")":
        refuse("record", text)
    body, at, out = text[1:-1], 0, []
    if not body:
        return []
    while True:
        parts, at0 = [], at
        while at < len(body) and body[at] != ",":
            if body[at] == '"':
                part, at = quoted(body, at, text)
                parts.append(part)
            elif body[at] == "\\":
                parts.append(body[at + 1 : at + 2])
                at += 2
            elif body[at] in "()":
                refuse("record", text)
            else:
                parts.append(body[at])
                at += 1
        out.append("".join(parts) if at > at0 else None)
        if at >= len(body):
            return out
        at += 1


RANGE = re.compile(r'\s*([\[(])((?:"(?:[^"\\]|\\.|"")*"|\\.|[^",\\\[\]()])*),((?:"(?:[^"\\]|\\.|"")*"|\\.|[^",\\\[\]()])*)([\])])\s*', re.S)


def range_parts(text: str):
    """None for empty, or (lower text or None, upper text or None, lower inclusive, upper inclusive)."""
    if text.strip().lower() == "empty":
        return None
    m = RANGE.fullmatch(text)
    if not m:
        refuse("range", text)
    clean = lambda s: re.sub(r'\\(.)|""|"', lambda e: e[1] or ('"' if e[0] == '""' else ""), s, flags=re.S) if s else None
    return clean(m[2]), clean(m[3]), m[1] == "[" and bool(m[2]), m[4] == "]" and bool(m[3])


DISCRETE = {"int4", "int8", "date"}


def canonical_range(t: PgType, text: str):
    """(lower key, upper key, lower inclusive, upper inclusive, lower text, upper text) or None if empty."""
    parts = range_parts(text)
    if parts is None:
        return None
    low, high, low_in, high_in = parts
    a = order_key(t.element, low) if low is not None else None
    b = order_key(t.element, high) if high is not None else None
    if a is not None and b is not None:
        if a > b:
            refuse("range", text)
        if a == b and not (low_in and high_in):
            return None
    if t.element.kind in DISCRETE:
        if a is not None and a[0] == 0 and not low_in:
            a, low_in, low = (0, a[1] + 1), True, None
        if b is not None and b[0] == 0 and high_in:
            b, high_in, high = (0, b[1] + 1), False, None
        if a is not None and a == b:
            return None
    return a, b, low_in, high_in, low, high


def range_order(t: PgType, text: str) -> tuple:
    c = canonical_range(t, text)
    if c is None:
        return (0,)
    a, b, low_in, high_in, *_ = c
    lower = (0,) if a is None else (1, a, 0 if low_in else 1)
    upper = (2,) if b is None else (1, b, 1 if high_in else 0)
    return 1, lower, upper


def multirange_items(text: str) -> list[str]:
    body = text.strip()
    if body[:1] != "{" or body[-1:] != "}":
        refuse("multirange", text)
    out, at, body = [], 0, body[1:-1]
    while body[at:].strip():
        m = re.compile(r"\s*(empty|[\[(](?:\"(?:[^\"\\]|\\.|\"\")*\"|\\.|[^\"\\\])])*[\])])\s*(,|$)", re.S | re.I).match(body, at)
        if not m:
            refuse("multirange", text)
        out.append(m[1])
        at = m.end()
    return out


def multirange_order(t: PgType, text: str) -> tuple:
    """Members sorted, empty ones gone, touching ones joined."""
    members = sorted(k for k in (range_order(t.element, m) for m in multirange_items(text)) if k != (0,))
    out: list[tuple] = []
    for k in members:
        if out and touches(out[-1][2], k[1]):
            out[-1] = (1, out[-1][1], max(out[-1][2], k[2]))
        else:
            out.append(k)
    return tuple(out)


def touches(upper: tuple, lower: tuple) -> bool:
    """Whether a range that ends with ``upper`` overlaps, or adjoins, one that begins with ``lower``."""
    if upper == (2,) or lower == (0,):
        return True
    if upper[1] != lower[1]:
        return upper[1] > lower[1]
    return upper[2] == 1 or lower[2] == 0


# ---- one way in -------------------------------------------------------------------------------


def decode(t: PgType, text: str):
    """The value of a field, ``Beyond``, or RefusedValue; nested values hold Beyond within."""
    k = t.kind
    if k in LIMITS:
        return integer(k, text)
    if k in ("text", "opaque", "json", "jsonb", "numeric", "inet", "cidr", "timetz"):
        if k in ("json", "jsonb"):
            parse_json(k, text)
        elif k == "numeric":
            numeric(text)
        elif k in ("inet", "cidr"):
            network(k, text)
        elif k == "timetz":
            timetz(text)
        return text
    if k in ("varchar", "bpchar"):
        return characters(t, text)
    if k == "bool":
        return text == "t" if text in ("t", "f") else refuse("boolean", text)
    if k in ("float4", "float8"):
        return floating(k, text)
    if k == "decimal":
        return decimal(text, *t.args)
    if k == "date":
        return date(text)
    if k in ("timestamp", "timestamptz"):
        return timestamp(k, text)
    if k == "time":
        return time_of_day(text)
    if k == "interval":
        value = interval(text)
        return value if isinstance(value, Beyond) else {"months": value[0], "days": value[1], "nanos": value[2] * 1000}
    if k == "uuid":
        return uuid(text)
    if k == "bytea":
        return bytea(text)
    if k in ("macaddr", "macaddr8"):
        return mac(k, text)
    if k == "enum":
        return text if text in t.labels or not t.exact else refuse(t.declared, text)
    if k == "int2vector":
        return [integer("int2", x) for x in text.split()]
    if k == "array":
        items = array_items(text, t.delimiter)
        if items and dimensions(items) != t.dims:
            refuse(f"{t.declared} of {t.dims} dimensions", text)
        shape(items)
        return [leaf(t.element, x) for x in items]
    if k == "composite":
        items = record_items(text)
        if not t.fields:
            return text
        if len(items) == 0 and len(t.fields) == 1:
            items = [None]
        if len(items) != len(t.fields):
            refuse(t.declared, text)
        return {n: None if x is None else decode(f, x) for (n, f), x in zip(t.fields, items)}
    if k == "range":
        return range_value(t, text)
    if k == "multirange":
        return [range_value(t.element, m) for m in multirange_items(text)]
    raise AssertionError(k)


def leaf(t: PgType, item):
    return [leaf(t, x) for x in item] if isinstance(item, list) else None if item is None else decode(t, item)


def range_value(t: PgType, text: str) -> dict:
    parts = range_parts(text)
    if parts is None:
        return {"lower": None, "upper": None, "lower_inclusive": False, "upper_inclusive": False, "empty": True}
    low, high, low_in, high_in = parts
    return {"lower": None if low is None else decode(t.element, low), "upper": None if high is None else decode(t.element, high), "lower_inclusive": low_in, "upper_inclusive": high_in, "empty": False}


def holds_beyond(value) -> bool:
    if isinstance(value, Beyond):
        return True
    if isinstance(value, dict):
        return any(map(holds_beyond, value.values()))
    return isinstance(value, list) and any(map(holds_beyond, value))


def unrepresentable(t: PgType, text: str) -> bool:
    """Whether the column's type can't hold a value that the declared type accepts."""
    return holds_beyond(decode(t, text))


def order_key(t: PgType, text: str) -> tuple:
    """A key whose order and equality are those of the database."""
    k = t.kind
    if k in LIMITS:
        return 0, integer(k, text)
    if k in ("float4", "float8"):
        v = floating(k, text)
        return (1, 0.0) if math.isnan(v) else (0, v + 0.0)
    if k in ("numeric", "decimal"):
        v = decimal(text, *t.args) if k == "decimal" else numeric(text)
        return (v.rank, 0) if isinstance(v, Beyond) else (0, v)
    if k in ("date", "timestamp", "timestamptz"):
        v = decode(t, text)
        return (0, v) if not isinstance(v, Beyond) else (v.rank, stamp_order(k, text) if v.rank == 0 else 0)
    if k == "time":
        v = time_of_day(text)
        return 0, DAY_US if isinstance(v, Beyond) else v
    if k == "timetz":
        return 0, timetz(text)
    if k == "interval":
        v = interval(text)
        if isinstance(v, Beyond) and v.rank:
            return v.rank, 0
        return 0, interval_order(*(v if not isinstance(v, Beyond) else interval_parts(text)))
    if k == "enum":
        return 0, t.labels.index(text) if text in t.labels else refuse(t.declared, text)
    if k == "bpchar":
        return 0, characters(t, text).rstrip(" ").encode()
    if k in ("inet", "cidr"):
        return 0, network_order(*network(k, text))
    if k == "jsonb":
        return 0, json_order(parse_json(k, text))
    if k == "bool":
        return 0, decode(t, text)
    if k == "int2vector":
        return 0, tuple((0, (0, x)) for x in decode(t, text))
    if k == "array":
        items = array_items(text, t.delimiter)
        flat = list(flatten(items))
        return 0, tuple((1,) if x is None else (0, order_key(t.element, x)) for x in flat), len(flat), len(shape(items)), shape(items)
    if k == "composite":
        items = record_items(text)
        return 0, tuple((1,) if x is None else (0, order_key(f, x)) for (_, f), x in zip(t.fields, items))
    if k == "range":
        return 0, range_order(t, text)
    if k == "multirange":
        return 0, multirange_order(t, text)
    v = decode(t, text)
    return 0, v if isinstance(v, bytes) else v.encode()


def interval_parts(text: str) -> tuple[int, int, int]:
    """As ``interval``, for spans over its nanosecond limit too."""
    months = days = us = 0
    for m in INTERVAL_PART.finditer(text):
        if m[2] == "day":
            days += int(m[1])
        elif m[2]:
            months += int(m[1]) * UNITS[m[2]]
        else:
            part = ((int(m[4]) * 60 + int(m[5])) * 60 + int(m[6] or 0)) * 1_000_000 + int((m[7] or "0").ljust(6, "0"))
            us += -part if m[3] == "-" else part
    return months, days, us


def flatten(items):
    for x in items:
        if isinstance(x, list):
            yield from flatten(x)
        else:
            yield x


def ordered(t: PgType) -> bool:
    """Whether < and > have a meaning; equality of text always has."""
    return t.kind not in ("opaque", "json") and (t.element is None or ordered(t.element)) and all(ordered(f) for _, f in t.fields)


# ---- value to text ------------------------------------------------------------------------------


def render(t: PgType, value) -> str:
    """The database's output text of a value of ``decode``."""
    k = t.kind
    if isinstance(value, Beyond):
        return value.text
    if k == "bool":
        return "t" if value else "f"
    if k in ("float4", "float8"):
        return render_float(value, k == "float4")
    if k in LIMITS:
        return str(value)
    if k == "decimal":
        return f"{value:f}"
    if k == "date":
        return render_date(value)
    if k in ("timestamp", "timestamptz"):
        days, us = divmod(value, DAY_US)
        day, _, era = render_date(days).partition(" ")
        return f"{day} {render_clock(us)}" + ("+00" if k == "timestamptz" else "") + (f" {era}" if era else "")
    if k == "time":
        return render_clock(value)
    if k == "interval":
        return render_interval(value["months"], value["days"], value["nanos"] // 1000)
    if k == "bytea":
        return "\\x" + bytes(value).hex()
    if k == "int2vector":
        return " ".join(map(str, value))
    if k == "array":
        return render_array(t, value)
    if k == "composite" and t.fields:
        return "(" + ",".join("" if value[n] is None else quote_item(render(f, value[n]), '(),"\\', '"') for n, f in t.fields) + ")"
    if k == "range":
        if value["empty"]:
            return "empty"
        low, high = ("" if value[n] is None else quote_item(render(t.element, value[n]), '()[],"\\', '"') for n in ("lower", "upper"))
        return ("[" if value["lower_inclusive"] else "(") + f"{low},{high}" + ("]" if value["upper_inclusive"] else ")")
    if k == "multirange":
        return "{" + ",".join(render(t.element, r) for r in value) + "}"
    return value


def render_float(value: float, single: bool) -> str:
    if math.isnan(value):
        return "NaN"
    if math.isinf(value):
        return "Infinity" if value > 0 else "-Infinity"
    if single:
        digits = next(s for n in range(1, 10) if struct.pack("f", float(s := f"{value:.{n}g}")) == struct.pack("f", value))
    else:
        digits = repr(value)
    sign, numbers, exponent = Decimal(digits).as_tuple()
    text = "".join(map(str, numbers)).rstrip("0") or "0"
    point = len(numbers) + exponent  # digits before the decimal point
    mark = "-" if sign else ""
    if text == "0":
        return mark + "0"
    if -4 < point <= (6 if single else 15):
        if point <= 0:
            return f"{mark}0.{'0' * -point}{text}"
        return mark + (text.ljust(point, "0") if len(text) <= point else f"{text[:point]}.{text[point:]}")
    e = point - 1
    return f"{mark}{text[0]}{'.' + text[1:] if len(text) > 1 else ''}e{'-' if e < 0 else '+'}{abs(e):02d}"


def render_date(days: int) -> str:
    y, m, d = civil_from_days(days)
    return f"{y:04d}-{m:02d}-{d:02d}" if y > 0 else f"{1 - y:04d}-{m:02d}-{d:02d} BC"


def render_clock(us: int) -> str:
    seconds, fraction = divmod(us, 1_000_000)
    text = f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"
    return text + (f".{fraction:06d}".rstrip("0") if fraction else "")


def render_interval(months: int, days: int, us: int) -> str:
    parts, before = [], False
    years, months = int(months / 12), int(math.fmod(months, 12))
    for n, unit in ((years, "year"), (months, "mon"), (days, "day")):
        if n:
            parts.append(("+" if before and n > 0 else "") + f"{n} {unit}" + ("" if n == 1 else "s"))
            before = n < 0
    if us or not parts:
        sign = "-" if us < 0 else "+" if before else ""
        parts.append(sign + render_clock(abs(us)))
    return " ".join(parts)


def quote_item(text: str, special: str, mark: str) -> str:
    """As records and ranges quote: quotes and backslashes are doubled."""
    if text and not any(c in special or c.isspace() for c in text):
        return text
    return mark + text.replace("\\", "\\\\").replace('"', '""') + mark


def render_array(t: PgType, items) -> str:
    out = []
    for x in items:
        if x is None:
            out.append("NULL")
        elif isinstance(x, list) and t.element.kind not in ("array", "multirange", "int2vector") or (isinstance(x, list) and t.dims > 1):
            out.append(render_array(t, x))
        else:
            text = render(t.element, x)
            plain = text and text.upper() != "NULL" and not any(c in '{}"\\' or c == t.delimiter or c.isspace() for c in text)
            out.append(text if plain else '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"')
    return "{" + t.delimiter.join(out) + "}"

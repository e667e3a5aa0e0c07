"""Whole columns of field text to Arrow arrays: vectorised where a type's plain form allows it."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc

from ..errors import RefusedValue
from ..sources.copytext import unescape
from . import values
from .pgtypes import PgType, Resolved, arrow_type


@dataclass(frozen=True)
class Modes:
    """How values are read that a type can't hold (null, text, refuse), and such as a type refuses (default, ignore)."""

    unrepresentable: str = "null"
    invalid: str = "default"

    def __post_init__(self):
        if self.unrepresentable not in ("null", "text", "refuse") or self.invalid not in ("default", "ignore"):
            raise ValueError(f"unknown mode {self}")


def unescaped(column: pa.Array) -> pa.Array:
    """Field text with its escapes read; most columns have none."""
    if not pc.any(pc.match_substring(column, "\\")).as_py():
        return column
    return pa.array([v if v is None or "\\" not in v else unescape(v.encode()) for v in column.to_pylist()], pa.string())


#: The plain forms, which need no second look; Arrow's own casts accept more than the types do.
PLAIN = {
    "int2": r"^-?[0-9]{1,5}$", "int4": r"^-?[0-9]{1,10}$", "int8": r"^-?[0-9]{1,19}$", "oid": r"^[0-9]{1,10}$",
    "float4": r"^-?[0-9]{1,15}(\.[0-9]{1,15})?$", "float8": r"^-?[0-9]{1,15}(\.[0-9]{1,17})?(e[+-][0-9]{1,2})?$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "timestamp": r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?$", "bool": r"^[tf]$",
}


def fast(t: PgType, column: pa.Array) -> pa.Array | None:
    """The decoded column if all its values have the plain form."""
    pattern = PLAIN.get(t.kind)
    if t.kind in ("text", "opaque") or (t.kind == "varchar" and not t.args):
        return column
    if t.kind == "varchar":
        longest = pc.max(pc.utf8_length(column)).as_py()
        return column if longest is None or longest <= t.args[0] else None
    if t.kind == "decimal" and t.args[0] >= t.args[1]:
        pattern = rf"^-?[0-9]{{1,{max(1, t.args[0] - t.args[1])}}}" + (rf"\.[0-9]{{{t.args[1]}}}$" if t.args[1] else "$")
    if not pattern or not pc.all(pc.match_substring_regex(column, pattern)).as_py() and len(column) > column.null_count:
        return None
    try:
        if t.kind == "bool":
            return pc.equal(column, "t")
        if t.kind == "oid":
            return pc.cast(pc.cast(column, pa.uint32()), pa.int64())
        if t.kind == "timestamp":
            return pc.cast(column, pa.timestamp("us"))
        out = pc.cast(column, arrow_type(t))
    except pa.ArrowInvalid:
        return None
    if t.kind == "float4" and pc.any(pc.is_inf(out)).as_py():
        return None
    if t.kind == "date" and pc.any(pc.less(pc.cast(out, pa.int32()), values.FIRST_DAY)).as_py():
        return None
    return out


def decode_column(column: pa.Array, r: Resolved, modes: Modes) -> pa.Array:
    """Typed values of a column of unescaped text; NULL where a mode says so."""
    t = r.type
    if r.not_null and column.null_count and modes.invalid != "ignore":
        raise RefusedValue(f"{r.name}: NULL in a NOT NULL column")
    if modes.unrepresentable == "text" and holds_limits(t):
        return column
    quick = fast(t, column)
    if quick is not None:
        return quick
    kind, out = arrow_type(t), []
    for text in column.to_pylist():
        if text is None:
            out.append(None)
            continue
        try:
            value = values.decode(t, text)
        except RefusedValue as e:
            if modes.invalid == "ignore":
                out.append(None)
                continue
            raise RefusedValue(f"{r.name}: {e}") from None
        if values.holds_beyond(value):
            if modes.unrepresentable == "refuse":
                raise RefusedValue(f"{r.name}: {text!r} does not fit {kind}")
            value = None
        out.append(value)
    return as_array(out, kind)


def as_array(items: list, kind: pa.DataType) -> pa.Array:
    """Days and microseconds come as integers, also within nested values."""
    return pa.array(items, stored(kind)).cast(kind) if not pa.types.is_nested(kind) else rebuilt(pa.array(items, stored(kind)), kind)


def stored(kind: pa.DataType) -> pa.DataType:
    if pa.types.is_date32(kind):
        return pa.int32()
    if pa.types.is_timestamp(kind):
        return pa.int64()
    if pa.types.is_list(kind):
        return pa.list_(stored(kind.value_type))
    if pa.types.is_struct(kind):
        return pa.struct([(kind.field(i).name, stored(kind.field(i).type)) for i in range(kind.num_fields)])
    return kind


def rebuilt(array: pa.Array, kind: pa.DataType) -> pa.Array:
    if array.type == kind:
        return array
    if pa.types.is_list(kind):
        return pa.ListArray.from_arrays(array.offsets, rebuilt(array.values, kind.value_type), mask=pc.is_null(array) if array.null_count else None)
    if pa.types.is_struct(kind):
        fields = [kind.field(i) for i in range(kind.num_fields)]
        return pa.StructArray.from_arrays([rebuilt(array.field(i), f.type) for i, f in enumerate(fields)], fields=fields, mask=pc.is_null(array) if array.null_count else None)
    return array.cast(kind)


def holds_limits(t: PgType) -> bool:
    """Whether the declared type has values that the column's type has not."""
    return t.kind in ("date", "timestamp", "timestamptz", "time", "interval", "decimal") or (t.element is not None and holds_limits(t.element)) or any(holds_limits(f) for _, f in t.fields)

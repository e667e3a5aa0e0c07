"""Scalar functions that Spark has under another name, or not at all, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def similar_to(c: Column, pattern: str) -> Column:
    """SQL's SIMILAR TO: % and _ besides the regular operators, over the whole text."""
    out = "".join({"%": ".*", "_": "."}.get(ch, re.escape(ch) if ch in ".^$\\" else ch) for ch in pattern)
    return c.rlike(f"^(?s:{out})$")


def gcd(a: Column, b: Column) -> Column:
    """Euclid over a fixed number of steps, enough for 64 bits."""
    pair = F.struct(F.abs(a.cast("long")).alias("x"), F.abs(b.cast("long")).alias("y"))
    step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, s["y"]).otherwise(s["x"] % F.when(s["y"] != 0, s["y"])).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), pair, step, lambda s: s["x"])


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(F.abs(a.cast("long") * F.floor(b.cast("long") / g)))


def iszero(c: Column) -> Column:
    return c == 0


def integer_divide(a: Column, b: Column) -> Column:
    """Integers divide as integers, toward zero."""
    return F.call_function("div", a, b)


def wrapping_sum(c: Column, bits: int = 64) -> Column:
    """A sum that wraps at a width instead of failing."""
    total, span = F.sum(c.cast("decimal(38,0)")), F.lit(str(1 << bits)).cast("decimal(38,0)")
    half = F.lit(str(1 << (bits - 1))).cast("decimal(38,0)")
    return (F.pmod(total + half, span) - half).cast("long")


def date_bin(step: str, c: Column, origin: str = "1970-01-01 00:00:00") -> Column:
    """The start of the stride that holds a timestamp without zone; ``step`` as "15 minutes"."""
    unit = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
    count, name = step.split()
    us = int(count) * unit[name.rstrip("s")] * 1_000_000
    start = F.unix_micros(F.lit(origin).cast("timestamp"))
    at = F.unix_micros(c.cast("timestamp")) - start
    return F.timestamp_micros(start + F.floor(at / F.lit(us)) * F.lit(us)).cast("timestamp_ntz")


def to_char(c: Column, pattern: str) -> Column:
    """A chrono-like pattern of %Y %m %d %H %M %S as Spark's."""
    marks = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE"}
    return F.date_format(c, re.sub(r"%.|[A-Za-z]+", lambda m: marks.get(m[0]) or f"'{m[0]}'", pattern))


def to_hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def array_dims(c: Column) -> Column:
    return F.array(F.size(c))


def array_resize(c: Column, n: int, fill) -> Column:
    return F.slice(F.concat(c, F.array_repeat(F.lit(fill), n)), 1, n)


def array_remove_n(c: Column, value, n: int) -> Column:
    """Without the first n elements equal to a value."""
    start = F.struct(F.slice(c, 1, 0).alias("out"), F.lit(n).alias("left"))
    step = lambda s, x: F.when((x == F.lit(value)) & (s["left"] > 0), F.struct(s["out"].alias("out"), (s["left"] - 1).alias("left"))).otherwise(F.struct(F.concat(s["out"], F.array(x)).alias("out"), s["left"].alias("left")))
    return F.aggregate(c, start, step, lambda s: s["out"])

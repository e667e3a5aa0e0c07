"""The filter algebra: terms on one column each, AND, OR, NOT, in three-valued logic.

One tree has four readings: over the text of rows (exact, by the database's order of each type),
over the statistics of a row group (which truth values can occur), as a Spark column over
decoded or staged tables, and as text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache, reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import DumpError, RefusedValue
from ..functions import values
from ..functions.pgtypes import PgType, Resolved

ORDERED = ("<", "<=", ">", ">=")
NULLARY = ("is null", "is not null", "is unrepresentable", "is not unrepresentable")
OPERATORS = ("=", "!=", *ORDERED, "in", "not in", "is distinct from", "is not distinct from", *NULLARY)
TRUE, FALSE, UNKNOWN = 1, 2, 4  # truth values, as bits of a set


@dataclass(frozen=True)
class Term:
    column: str
    op: str
    #: One text, or several for membership; None among them stands for NULL.
    operand: tuple[str | None, ...] = ()

    def __post_init__(self):
        if self.op not in OPERATORS:
            raise DumpError(f"unknown operator {self.op}")


@dataclass(frozen=True)
class And:
    parts: tuple = ()


@dataclass(frozen=True)
class Or:
    parts: tuple = ()


@dataclass(frozen=True)
class Not:
    part: object


EVERYTHING = And(())


def columns_of(tree) -> list[str]:
    if isinstance(tree, Term):
        return [tree.column]
    parts = [tree.part] if isinstance(tree, Not) else tree.parts
    return list(dict.fromkeys(c for p in parts for c in columns_of(p)))


def between(column: str, low: str, high: str) -> And:
    return And((Term(column, ">=", (low,)), Term(column, "<=", (high,))))


def is_truth(column: str, truth: bool | None, negated: bool = False):
    """IS [NOT] TRUE, FALSE or UNKNOWN on a boolean column."""
    if truth is None:
        return Term(column, "is not null" if negated else "is null")
    return Term(column, "is distinct from" if negated else "is not distinct from", ("t" if truth else "f",))


class Bound:
    """A tree whose operands have been read by the types of their columns; refuses them before any row is."""

    def __init__(self, tree, columns: dict[str, Resolved], semantics: str = "postgres", strings: bool = False):
        self.tree, self.columns, self.strings = tree, columns, strings
        if semantics not in ("postgres", "engine"):
            raise DumpError(f"unknown semantics {semantics}")
        self.semantics = semantics
        self.warnings: list[str] = []
        self.keys: dict[Term, tuple] = {}
        self._bind(tree)

    def _bind(self, tree) -> None:
        if not isinstance(tree, Term):
            for part in [tree.part] if isinstance(tree, Not) else tree.parts:
                self._bind(part)
            return
        if tree.column not in self.columns:
            raise DumpError(f"no column {tree.column}")
        r = self.columns[tree.column]
        if tree.op in NULLARY:
            if "unrepresentable" in tree.op and self.strings:
                raise DumpError("IS UNREPRESENTABLE has no meaning when all columns are read as text")
            return
        if tree.op in ORDERED and not values.ordered(r.type):
            if self.semantics == "postgres":
                raise DumpError(f"{tree.op} has no meaning for {r.name} of type {r.type.declared}")
            self.warnings.append(f"{r.name}: {r.type.declared} is compared as text")
        if self.semantics == "engine" and r.type.kind in ("enum", "interval", "bpchar"):
            self.warnings.append(f"{r.name}: {r.type.kind} is compared by the engine's own rules")
        self.warnings += [n for n in r.notes if n not in self.warnings]
        self.keys[tree] = tuple(None if x is None else self.literal(r, x) for x in tree.operand)

    def literal(self, r: Resolved, text: str):
        try:
            if r.type.kind == "decimal" and self.semantics == "postgres":
                exact = values.numeric(text)
                if not isinstance(exact, values.Beyond) and -exact.as_tuple().exponent > r.type.args[1]:
                    raise RefusedValue(f"{text} is finer than the scale of {r.type.declared}")
            return self.key(r.type, text)
        except RefusedValue as e:
            raise DumpError(f"{r.name}: {text!r} is no {r.type.declared} ({e})") from None

    def key(self, t: PgType, text: str):
        """What is compared: the database's order, or the engine's order of the value that it is given."""
        if self.semantics == "engine":
            if t.kind == "interval":
                v = values.interval(text)
                return (v.rank,) if isinstance(v, values.Beyond) else (0, v)
            if t.kind in ("enum", "bpchar", "opaque", "json", "jsonb", "inet", "cidr", "timetz", "numeric"):
                return 0, values.decode(t, text).encode()
        return values.order_key(t, text)

    # -- rows

    def matches(self, texts: dict[str, pa.Array], rows: int) -> pa.Array:
        """The truth of each row, null for unknown, from unescaped field texts."""
        keys: dict[str, list] = {}

        def keyed(name: str) -> list:
            if name not in keys:
                r = self.columns[name]
                one = cache(lambda text: self.key(r.type, text))
                keys[name] = [None if v is None else one(v) for v in texts[name].to_pylist()]
            return keys[name]

        def run(tree) -> pa.Array:
            if isinstance(tree, And):
                return reduce(pc.and_kleene, map(run, tree.parts), pa.array([True] * rows, pa.bool_()))
            if isinstance(tree, Or):
                return reduce(pc.or_kleene, map(run, tree.parts), pa.array([False] * rows, pa.bool_()))
            if isinstance(tree, Not):
                return pc.invert(run(tree.part))
            return self.term(tree, texts[tree.column], keyed)

        return run(self.tree)

    def term(self, term: Term, texts: pa.Array, keyed) -> pa.Array:
        r, op = self.columns[term.column], term.op
        if op in ("is null", "is not null"):
            out = pc.is_null(texts)
            if not self.strings and values_may_be_beyond(r.type):  # such values are NULL to the reader
                out = pc.or_(out, self.beyond(r, texts))
            return out if op == "is null" else pc.invert(out)
        if "unrepresentable" in op:
            out = self.beyond(r, texts)
            return out if op == "is unrepresentable" else pc.invert(out)
        wanted = self.keys[term]
        if op in ("is distinct from", "is not distinct from"):
            same = [k == wanted[0] for k in keyed(term.column)]
            return pa.array(same if op.startswith("is not") else [not s for s in same], pa.bool_())
        if op in ("in", "not in"):
            known, unknown = {k for k in wanted if k is not None}, None in wanted
            if not wanted:
                out = pa.array([False] * len(texts), pa.bool_())
            else:
                out = pa.array([None if k is None else True if k in known else None if unknown else False for k in keyed(term.column)], pa.bool_())
            return pc.invert(out) if op == "not in" else out
        x = wanted[0]
        if x is None:
            return pa.array([None] * len(texts), pa.bool_())
        if (quick := fast_compare(r.type, texts, op, term.operand[0])) is not None:
            return quick
        test = COMPARE[op]
        return pa.array([None if k is None else test(k, x) for k in keyed(term.column)], pa.bool_())

    def beyond(self, r: Resolved, texts: pa.Array) -> pa.Array:
        return pa.array([v is not None and values.unrepresentable(r.type, v) for v in texts.to_pylist()], pa.bool_())

    # -- row groups

    def truths(self, stats: dict[str, dict], tree=None) -> int:
        """The truth values that rows of a group can have, from its statistics; nothing is known of a column without.

        Terms count as independent, so that the set may be too large, never too small.
        """
        tree = self.tree if tree is None else tree
        if isinstance(tree, Not):
            t = self.truths(stats, tree.part)
            return (FALSE if t & TRUE else 0) | (TRUE if t & FALSE else 0) | (t & UNKNOWN)
        if isinstance(tree, (And, Or)):
            low, high = (FALSE, TRUE) if isinstance(tree, And) else (TRUE, FALSE)
            out = high
            for part in tree.parts:
                t = self.truths(stats, part)
                pairs = [(a, b) for a in (TRUE, FALSE, UNKNOWN) if out & a for b in (TRUE, FALSE, UNKNOWN) if t & b]
                out = 0
                for a, b in pairs:
                    out |= low if low in (a, b) else UNKNOWN if UNKNOWN in (a, b) else high
            return out
        return self.term_truths(tree, stats.get(tree.column))

    def term_truths(self, term: Term, s: dict | None) -> int:
        if s is None or self.semantics == "engine":
            return TRUE | FALSE | UNKNOWN
        rows, nulls, beyond = s["rows"], s["nulls"], s.get("beyond") or 0
        if not rows:
            return 0
        op, some, none = term.op, rows > nulls, nulls > 0
        if op in ("is null", "is not null"):
            empty, full = nulls + beyond > 0, rows > nulls + beyond
            return (TRUE if (empty if op == "is null" else full) else 0) | (FALSE if (full if op == "is null" else empty) else 0)
        if "unrepresentable" in op:
            yes, no = beyond > 0, rows > beyond
            return (TRUE if (yes if op == "is unrepresentable" else no) else 0) | (FALSE if (no if op == "is unrepresentable" else yes) else 0)
        r, wanted = self.columns[term.column], self.keys[term]
        if s.get("refused"):
            return TRUE | FALSE | UNKNOWN
        t = r.type
        if s.get("dictionary") is not None:
            keys = [self.key(t, v) for v in s["dictionary"]]
            out = reduce(lambda a, k: a | self.truth_of(op, k, wanted), keys, 0)
        elif s.get("low") is None:
            out = (TRUE | FALSE | UNKNOWN) if some else 0
        else:
            low, high = self.key(t, s["low"]), self.key(t, s["high"])
            out = range_truths(op, low, high, wanted)
        if none:
            out |= self.truth_of(op, None, wanted)
        return out

    @staticmethod
    def truth_of(op: str, key, wanted: tuple) -> int:
        if op == "is distinct from":
            return TRUE if key != wanted[0] else FALSE
        if op == "is not distinct from":
            return TRUE if key == wanted[0] else FALSE
        if op in ("in", "not in"):
            if not wanted:
                inside = FALSE
            else:
                inside = UNKNOWN if key is None else TRUE if key in wanted else UNKNOWN if None in wanted else FALSE
            return inside if op == "in" or inside == UNKNOWN else TRUE + FALSE - inside
        if key is None or wanted[0] is None:
            return UNKNOWN
        return TRUE if COMPARE[op](key, wanted[0]) else FALSE

    def stop_rule(self, sortedness: dict[str, str]) -> tuple[str, str, object] | None:
        """(column, operator, key) of a term that every kept row meets and after whose first failure no row can, in a sorted block."""
        terms = [self.tree] if isinstance(self.tree, Term) else self.tree.parts if isinstance(self.tree, And) else ()
        for term in terms:
            order = isinstance(term, Term) and sortedness.get(term.column)
            if order and self.keys.get(term, (None,))[0] is not None and ((order == "ascending" and term.op in ("<", "<=")) or (order == "descending" and term.op in (">", ">=")) or (order == "constant" and term.op in ORDERED)):
                return term.column, term.op, self.keys[term][0]
        return None

    # -- Spark

    def to_column(self, tree=None) -> Column:
        """The filter over columns of decoded values, where Spark's own comparisons agree with the database's."""
        tree = self.tree if tree is None else tree
        if isinstance(tree, Not):
            return ~self.to_column(tree.part)
        if isinstance(tree, And):
            return reduce(lambda a, b: a & b, map(self.to_column, tree.parts), F.lit(True))
        if isinstance(tree, Or):
            return reduce(lambda a, b: a | b, map(self.to_column, tree.parts), F.lit(False))
        return term_column(tree, self.columns[tree.column].type)


COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
ARROW = {"=": pc.equal, "!=": pc.not_equal, "<": pc.less, "<=": pc.less_equal, ">": pc.greater, ">=": pc.greater_equal}


def values_may_be_beyond(t: PgType) -> bool:
    from ..functions.columns import holds_limits

    return holds_limits(t)


def fast_compare(t: PgType, texts: pa.Array, op: str, literal: str) -> pa.Array | None:
    """Arrow's comparison of a column in its plain form, if it is that of the type."""
    from ..functions.columns import fast

    if t.kind not in ("int2", "int4", "int8", "oid", "float8", "text", "varchar", "date", "timestamp"):
        return None
    column, one = fast(t, texts), fast(t, pa.array([literal], pa.string()))
    if column is None or one is None or op == "" or len(one) != 1:
        return None
    if t.kind in ("text", "varchar"):  # bytes, not characters
        column, one = column.cast(pa.binary()), one.cast(pa.binary())
    return ARROW[op](column, one[0])


def range_truths(op: str, low, high, wanted: tuple) -> int:
    """Truth values of values between two bounds; not that all of the range occur."""
    if op in ("in", "not in"):
        if not wanted:
            return FALSE if op == "in" else TRUE
        hit = any(k is not None and low <= k <= high for k in wanted)
        exact = low == high and any(k == low for k in wanted if k is not None)
        inside = TRUE if exact else (TRUE if hit else 0) | (UNKNOWN if None in wanted else FALSE)
        swap = (FALSE if inside & TRUE else 0) | (TRUE if inside & FALSE else 0) | (inside & UNKNOWN)
        return inside if op == "in" else swap
    x = wanted[0]
    if op in ("is distinct from", "is not distinct from"):
        same = 0 if x is None else (TRUE if low <= x <= high else 0)
        other = FALSE if x is None or not low == high == x else 0
        out = same | other
        return out if op == "is not distinct from" else (FALSE if out & TRUE else 0) | (TRUE if out & FALSE else 0)
    if x is None:
        return UNKNOWN
    if op in ("=", "!="):
        same, other = low <= x <= high, not low == high == x
        return (TRUE if (same if op == "=" else other) else 0) | (FALSE if (other if op == "=" else same) else 0)
    a, b = COMPARE[op](low, x), COMPARE[op](high, x)
    return (TRUE if a or b else 0) | (FALSE if not (a and b) else 0)


#: Types that Spark compares as the database does, with the SQL type of a literal.
NATIVE = {"int2": "smallint", "int4": "int", "int8": "bigint", "oid": "bigint", "float4": "float", "float8": "double", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "text": "string", "varchar": "string", "uuid": "string", "macaddr": "string", "macaddr8": "string", "bool": "boolean", "bpchar": "string", "decimal": "decimal", "enum": "enum"}


def term_column(term: Term, t: PgType) -> Column:
    c = F.col(f"`{term.column}`")
    if term.op == "is null":
        return c.isNull()
    if term.op == "is not null":
        return c.isNotNull()
    if "unrepresentable" in term.op or t.kind not in NATIVE:
        raise DumpError(f"{term.op} on {t.declared} is answered by the scan only")

    def literal(text: str | None) -> Column:
        if t.kind == "enum":
            return F.lit(None if text is None else t.labels.index(text) + 1)
        if t.kind == "bpchar":
            return F.lit(text if text is None else text.rstrip(" "))
        kind = f"decimal({max(t.args)},{t.args[1]})" if t.kind == "decimal" else NATIVE[t.kind]
        value = {"t": "true", "f": "false"}.get(text, text) if t.kind == "bool" else text
        return F.lit(value).cast(kind)

    if t.kind == "enum":
        c = F.array_position(F.array(*map(F.lit, t.labels)), c)
    elif t.kind == "bpchar":
        c = F.rtrim(c)
    if term.op in ("in", "not in"):
        if not term.operand:
            return F.lit(term.op == "not in")
        out = reduce(lambda a, b: a | b, (c == literal(x) for x in term.operand))
        return ~out if term.op == "not in" else out
    x = literal(term.operand[0])
    return {"=": c == x, "!=": c != x, "<": c < x, "<=": c <= x, ">": c > x, ">=": c >= x, "is distinct from": ~c.eqNullSafe(x), "is not distinct from": c.eqNullSafe(x)}[term.op]

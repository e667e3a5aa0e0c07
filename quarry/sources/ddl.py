"""What a dump's statements declare: tables, types, collations, extensions, inheritance."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .copytext import IDENTIFIER, unquote

NAME = rf"(?:({IDENTIFIER})\.)?({IDENTIFIER})"
TOKEN = re.compile(rf"""'(?:[^']|'')*'|\$([A-Za-z_]\w*)?\$.*?\$\1\$|{IDENTIFIER}|\d[\w.]*|::|[(),\[\].=<>+*/-]|\S""", re.S)


@dataclass
class Column:
    name: str
    declared: str
    not_null: bool = False
    collation: str | None = None
    generated: bool = False


@dataclass
class Table:
    schema: str | None
    name: str
    columns: list[Column] = field(default_factory=list)
    parents: list[tuple[str | None, str]] = field(default_factory=list)
    of_type: tuple[str | None, str] | None = None
    bound: str | None = None
    partitioned: str | None = None
    checks: list[str] = field(default_factory=list)
    foreign: bool = False

    @property
    def key(self) -> tuple[str | None, str]:
        return self.schema, self.name


@dataclass
class Type:
    schema: str | None
    name: str
    kind: str  # enum, domain, composite, range, base, shell
    labels: list[str] = field(default_factory=list)
    exact: bool = True  # whether all labels are known
    base: str | None = None
    not_null: bool = False
    fields: list[Column] = field(default_factory=list)
    subtype: str | None = None
    multirange: str | None = None
    delimiter: str = ","
    collation: str | None = None


@dataclass
class Collation:
    schema: str | None
    name: str
    provider: str | None
    deterministic: bool


@dataclass
class Database:
    """All that one database's statements declare."""

    name: str | None = None
    tables: dict[tuple[str | None, str], Table] = field(default_factory=dict)
    types: dict[tuple[str | None, str], Type] = field(default_factory=dict)
    collations: dict[tuple[str | None, str], Collation] = field(default_factory=dict)
    extensions: list[str] = field(default_factory=list)
    version: str | None = None

    def table(self, schema: str | None, name: str) -> Table:
        return self.tables.setdefault((schema, name), Table(schema, name))

    def find_type(self, schema: str | None, name: str) -> Type | None:
        if (schema, name) in self.types:
            return self.types[schema, name]
        found = [t for (s, n), t in self.types.items() if n == name and schema is None]
        return found[0] if len(found) == 1 else None

    # the order of columns that a table has with what it takes from its type and parents
    def all_columns(self, key: tuple[str | None, str], seen: tuple = ()) -> list[Column]:
        table = self.tables.get(key)
        if table is None or key in seen:
            return []
        out: dict[str, Column] = {}
        if table.of_type and (kind := self.find_type(*table.of_type)):
            out |= {c.name: c for c in kind.fields}
        for parent in table.parents:
            for c in self.all_columns(parent, (*seen, key)):
                old = out.get(c.name)
                out[c.name] = c if old is None else Column(c.name, old.declared, old.not_null or c.not_null, old.collation, old.generated)
        for c in table.columns:
            old = out.get(c.name)
            out[c.name] = Column(c.name, c.declared, c.not_null or bool(old and old.not_null), c.collation or (old.collation if old else None), c.generated)
        return list(out.values())

    def children(self, key: tuple[str | None, str]) -> list[tuple[str | None, str]]:
        """Direct children in the order of declaration."""
        return [k for k, t in self.tables.items() if key in t.parents]

    def descendants(self, key: tuple[str | None, str]) -> list[tuple[str | None, str]]:
        """All descendants at any depth, each once, nearest first."""
        out: list[tuple[str | None, str]] = []
        queue = [key]
        while queue:
            for child in self.children(queue.pop(0)):
                if child not in out and child != key:
                    out.append(child)
                    queue.append(child)
        return out

    def checks(self, key: tuple[str | None, str]) -> list[str]:
        """A table's CHECK conditions with those that it inherits."""
        table = self.tables.get(key)
        return [] if table is None else list(dict.fromkeys([*table.checks, *(c for p in table.parents for c in self.checks(p))]))


def pair(schema: str | None, name: str) -> tuple[str | None, str]:
    return (unquote(schema) if schema else None), unquote(name)


def split_top(text: str) -> list[str]:
    """Parts between commas that are in no parenthesis, literal or quoted name."""
    parts, depth, at = [], 0, 0
    for m in TOKEN.finditer(text):
        if m[0] in "([":
            depth += 1
        elif m[0] in ")]":
            depth -= 1
        elif m[0] == "," and depth == 0:
            parts.append(text[at : m.start()].strip())
            at = m.end()
    rest = text[at:].strip()
    return [*parts, rest] if rest else parts


def closing(text: str, start: int) -> int:
    """The offset after the parenthesis that closes the one at ``start``."""
    depth = 0
    for m in TOKEN.finditer(text, start):
        depth += (m[0] == "(") - (m[0] == ")")
        if depth == 0:
            return m.end()
    return len(text)


#: Words after which a column's type has ended.
AFTER_TYPE = re.compile(r"\s+(?=(?:COLLATE|NOT NULL|NULL|DEFAULT|GENERATED|CONSTRAINT|CHECK|PRIMARY KEY|UNIQUE|REFERENCES|STORAGE|COMPRESSION|OPTIONS)\b)", re.I)
TABLE_PART = re.compile(r"(?:CONSTRAINT|CHECK|PRIMARY KEY|UNIQUE|FOREIGN KEY|EXCLUDE|LIKE)\b", re.I)


def parse_column(text: str) -> Column | None:
    m = re.match(rf"({IDENTIFIER})(?:\s+WITH OPTIONS)?\s+(.*)$", text, re.S)
    if not m:
        return None
    declared, *rest = AFTER_TYPE.split(m[2], maxsplit=1)
    rest = rest[0] if rest else ""
    collate = re.search(rf"\bCOLLATE {NAME}", rest)
    if m[2].upper().startswith(("NOT NULL", "DEFAULT", "CONSTRAINT")):  # a typed table's column has options only
        declared, rest = "", m[2]
    bare = re.sub(r"'(?:[^']|'')*'", "''", rest)
    return Column(unquote(m[1]), " ".join(declared.split()), bool(re.search(r"\bNOT NULL\b", bare)), unquote(collate[2]) if collate else None, bool(re.search(r"\bGENERATED ALWAYS AS \(", bare)))


def strings(text: str) -> list[str]:
    return [s[1:-1].replace("''", "'") for s in re.findall(r"'(?:[^']|'')*'", text)]


def options(text: str) -> dict[str, str]:
    """``name = value`` parts of a parenthesised list, names in upper case."""
    out = {}
    for part in split_top(text):
        name, _, value = part.partition("=")
        out[name.strip().upper()] = value.strip()
    return out


def apply(db: Database, statement: str) -> str:
    """Fold a statement into the database; the kind of span that it is."""
    s = statement
    for pattern, handle in FORMS:
        m = pattern.match(s)
        if m:
            return handle(db, s, m)
    return "framing" if re.match(r"(?:SET|SELECT pg_catalog|BEGIN|COMMIT|RESET|\\)", s) else "unparsed"


def _table(db: Database, s: str, m: re.Match) -> str:
    table = db.table(*pair(m["schema"], m["name"]))
    table.foreign = bool(m["foreign"])
    rest = s[m.end() :].lstrip()
    if of := re.match(rf"OF {NAME}\s*", rest):
        table.of_type = pair(of[1], of[2])
        rest = rest[of.end() :]
    if of := re.match(rf"PARTITION OF {NAME}\s*", rest):
        table.parents.append(pair(of[1], of[2]))
        rest = rest[of.end() :]
    if rest.startswith("("):
        end = closing(rest, 0)
        for part in split_top(rest[1 : end - 1]):
            if TABLE_PART.match(part):
                if check := re.search(r"\bCHECK\s*(\(.*\))", part, re.S):
                    table.checks.append(check[1])
                for key in re.findall(r"NOT NULL (\S+)", part):
                    table.columns = [Column(c.name, c.declared, c.not_null or c.name == unquote(key), c.collation, c.generated) for c in table.columns]
            elif column := parse_column(part):
                table.columns.append(column)
                if check := re.search(r"\bCHECK\s*(\(.*\))", part, re.S):
                    table.checks.append(check[1])
        rest = rest[end:].lstrip()
    if inherits := re.match(r"INHERITS\s*\(([^)]*)\)", rest):
        table.parents += [pair(*re.fullmatch(NAME, p.strip()).groups()) for p in split_top(inherits[1])]
        rest = rest[inherits.end() :].lstrip()
    if bound := re.match(r"(DEFAULT|FOR VALUES .*?)(?=PARTITION BY|$)", rest, re.S):
        table.bound = bound[1].strip()
        rest = rest[bound.end() :]
    if by := re.search(r"PARTITION BY (.*)$", rest, re.S):
        table.partitioned = by[1].strip()
    return "table"


def _type(db: Database, s: str, m: re.Match) -> str:
    schema, name = pair(m["schema"], m["name"])
    rest = s[m.end() :].strip()
    kind = Type(schema, name, "shell")
    if rest.startswith("AS ENUM"):
        kind = Type(schema, name, "enum", labels=strings(rest))
    elif rest.startswith("AS RANGE"):
        o = options(rest[rest.index("(") + 1 : -1])
        sub, multi = o.get("SUBTYPE", ""), o.get("MULTIRANGE_TYPE_NAME")
        kind = Type(schema, name, "range", subtype=sub, multirange=unquote(multi.split(".")[-1]) if multi else default_multirange(name), collation=o.get("COLLATION"))
        db.types[schema, kind.multirange] = Type(schema, kind.multirange, "multirange", base=name)
    elif rest.startswith("AS"):
        body = rest[rest.index("(") + 1 : -1]
        kind = Type(schema, name, "composite", fields=[c for p in split_top(body) if (c := parse_column(p))])
    elif rest.startswith("("):
        o = options(rest[1:-1])
        kind = Type(schema, name, "base", delimiter=(strings(o["DELIMITER"]) or [","])[0] if "DELIMITER" in o else ",")
    db.types[schema, name] = kind
    return "type"


def default_multirange(name: str) -> str:
    """The name that the server gives a range type's multirange."""
    return name.replace("range", "multirange", 1) if "range" in name else f"{name}_multirange"


def _domain(db: Database, s: str, m: re.Match) -> str:
    column = parse_column(f"d {re.sub(r'^AS ', '', s[m.end():].strip())}")
    schema, name = pair(m["schema"], m["name"])
    db.types[schema, name] = Type(schema, name, "domain", base=column.declared if column else "text", not_null=bool(column and column.not_null), collation=column.collation if column else None)
    return "type"


def _collation(db: Database, s: str, m: re.Match) -> str:
    schema, name = pair(m["schema"], m["name"])
    o = options(s[s.index("(") + 1 : -1]) if "(" in s else {}
    db.collations[schema, name] = Collation(schema, name, o.get("PROVIDER"), o.get("DETERMINISTIC", "true").strip("'").lower() != "false")
    return "collation"


def _extension(db: Database, s: str, m: re.Match) -> str:
    db.extensions.append(unquote(m[1]))
    return "extension"


def _alter_type(db: Database, s: str, m: re.Match) -> str:
    kind, rest = db.find_type(*pair(m["schema"], m["name"])), s[m.end() :].strip()
    if add := re.match(r"ADD VALUE (?:IF NOT EXISTS )?('(?:[^']|'')*')(?: (BEFORE|AFTER) ('(?:[^']|'')*'))?$", rest):
        if kind and kind.kind == "enum":
            at = len(kind.labels)
            if add[2] and strings(add[3])[0] in kind.labels:
                at = kind.labels.index(strings(add[3])[0]) + (add[2] == "AFTER")
            kind.labels.insert(at, strings(add[1])[0])
        return "alter_type_add_value"
    if drop := re.match(rf"DROP ATTRIBUTE (?:IF EXISTS )?({IDENTIFIER})", rest):
        if kind:
            kind.fields = [c for c in kind.fields if c.name != unquote(drop[1])]
        return "alter_type_drop_attribute"
    if re.match(r"OWNER TO|SET SCHEMA", rest):
        return "framing"
    if kind and kind.kind == "enum":
        kind.exact = False  # labels may have changed in a way that is not read
        return "enum_labels_unread"
    return "unparsed"


def _alter_table(db: Database, s: str, m: re.Match) -> str:
    table, rest = db.table(*pair(m["schema"], m["name"])), s[m.end() :].strip()
    if x := re.match(rf"INHERIT {NAME}$", rest):
        table.parents.append(pair(x[1], x[2]))
    elif x := re.match(rf"OF {NAME}$", rest):
        table.of_type = pair(x[1], x[2])
    elif x := re.match(rf"ATTACH PARTITION {NAME}\s+(.*)$", rest, re.S):
        child = db.table(*pair(x[1], x[2]))
        child.parents.append(table.key)
        child.bound = x[3].strip()
    elif x := re.match(rf"ALTER (?:COLUMN )?({IDENTIFIER}) SET NOT NULL$", rest):
        for c in table.columns:
            c.not_null |= c.name == unquote(x[1])
    elif x := re.match(r"ADD (?:CONSTRAINT \S+ )?CHECK\s*(\(.*\))", rest, re.S):
        table.checks.append(x[1])
    elif x := re.match(r"ADD CONSTRAINT \S+ PRIMARY KEY \((.*?)\)", rest, re.S):
        keys = {unquote(k.strip()) for k in split_top(x[1])}
        for c in table.columns:
            c.not_null |= c.name in keys
    else:
        return "framing"
    return "alter_table_reference"


QUALIFIED = rf"(?:(?P<schema>{IDENTIFIER})\.)?(?P<name>{IDENTIFIER})"
FORMS = (
    (re.compile(rf"CREATE (?:UNLOGGED |TEMP(?:ORARY)? )?(?P<foreign>FOREIGN )?TABLE (?:IF NOT EXISTS )?{QUALIFIED}"), _table),
    (re.compile(rf"CREATE TYPE {QUALIFIED}"), _type),
    (re.compile(rf"CREATE DOMAIN {QUALIFIED}"), _domain),
    (re.compile(rf"CREATE COLLATION {QUALIFIED}"), _collation),
    (re.compile(rf"CREATE EXTENSION (?:IF NOT EXISTS )?({IDENTIFIER})"), _extension),
    (re.compile(rf"ALTER TYPE {QUALIFIED}"), _alter_type),
    (re.compile(rf"ALTER (?:FOREIGN )?TABLE (?:ONLY )?{QUALIFIED}"), _alter_table),
)

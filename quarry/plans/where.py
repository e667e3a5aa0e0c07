"""The two text grammars of filters: one term, and terms with NOT, AND, OR and parentheses."""

from __future__ import annotations

import re

from ..errors import DumpError
from .predicate import And, Not, Or, Term

#: Operators as text; where two start at one place the longer one is meant.
SIGNS = ("!=", "<>", "<=", ">=", "=", "<", ">")
WORDS = ("is not distinct from", "is distinct from", "is not unrepresentable", "is unrepresentable", "is not null", "is null", "not in", "in")
OPERATOR = re.compile("|".join([*(rf"(?<=\s){w.replace(' ', chr(92) + 's+')}(?=[\s(]|$)" for w in WORDS), *map(re.escape, SIGNS)]), re.I)
QUOTES = "'\""


def regions(text: str):
    """For each offset whether it is within quotes; an unclosed quote is refused."""
    inside, mark, at = [False] * len(text), "", 0
    while at < len(text):
        c = text[at]
        if mark:
            inside[at] = True
            if c == mark:
                if text[at + 1 : at + 2] == mark:
                    inside[at + 1] = True
                    at += 1
                else:
                    mark = ""
        elif c in QUOTES:
            mark, inside[at] = c, True
        at += 1
    if mark:
        raise DumpError(f"unclosed quote in {text!r}")
    return inside


def unquoted(text: str) -> str:
    text = text.strip()
    if len(text) > 1 and text[0] in QUOTES and text[-1] == text[0]:
        return text[1:-1].replace(text[0] * 2, text[0])
    return text


def parse_term(text: str) -> Term:
    """``column op value``: the earliest operator outside quotes, values quoted or bare."""
    inside = regions(text)
    m = next((m for m in OPERATOR.finditer(text) if not inside[m.start()]), None)
    if m is None:
        raise DumpError(f"no operator in {text!r}")
    column, op, rest = unquoted(text[: m.start()]), " ".join(m[0].lower().split()), text[m.end() :].strip()
    op = "!=" if op == "<>" else op
    if not column:
        raise DumpError(f"no column in {text!r}")
    if op.endswith(("null", "unrepresentable")):
        if rest:
            raise DumpError(f"{rest!r} after {op}")
        return Term(column, op)
    if op in ("in", "not in"):
        if rest[:1] != "(" or rest[-1:] != ")":
            raise DumpError(f"{op} needs a list in parentheses")
        return Term(column, op, tuple(items(rest[1:-1])))
    if not rest:
        raise DumpError(f"no value in {text!r}")
    return Term(column, op, (value(rest),))


def value(text: str) -> str | None:
    """A bare NULL is the null value; a quoted one is text."""
    return None if text.strip().lower() == "null" else unquoted(text)


def items(text: str) -> list[str | None]:
    if not text.strip():
        return []
    inside, out, at = regions(text), [], 0
    for i, c in enumerate(text):
        if c == "," and not inside[i]:
            out.append(value(text[at:i]))
            at = i + 1
    return [*out, value(text[at:])]


def structure(text: str) -> list[tuple[str, str]]:
    """("word" and or not, "(" or ")", or "term") pieces; keywords stand alone between blanks or parentheses."""
    inside, out, at, i = regions(text), [], 0, 0

    def close(end: int) -> None:
        if text[at:end].strip():
            out.append(("term", text[at:end].strip()))

    while i < len(text):
        if not inside[i]:
            before = text[at:i]
            if text[i] == "(" and re.search(r"(?:^|\s)(?:not\s+)?in\s*$", before, re.I) and before.strip().lower() not in ("in", "not in"):
                depth = 1  # a list belongs to its term
                while depth and i + 1 < len(text):
                    i += 1
                    depth += 0 if inside[i] else (text[i] == "(") - (text[i] == ")")
                i += 1
                continue
            if text[i] in "()":
                close(i)
                out.append((text[i], text[i]))
                at = i + 1
            elif (m := re.compile(r"(and|or|not)(?=[\s()]|$)", re.I).match(text, i)) and (i == 0 or text[i - 1] in " \t\n()"):
                word = m[1].lower()
                part_of_operator = word == "not" and (re.search(r"(?:^|\s)is\s*$", before, re.I) or re.match(r"not\s+in\s*\(", text[i:], re.I) and before.strip())
                if not part_of_operator:
                    close(i)
                    out.append(("word", word))
                    at = i = m.end()
                    continue
        i += 1
    close(len(text))
    return out


def parse_where(text: str):
    """NOT binds closest, then AND, then OR."""
    pieces = structure(text)
    at = 0

    def peek():
        return pieces[at] if at < len(pieces) else ("end", "")

    def disjunction():
        nonlocal at
        parts = [conjunction()]
        while peek() == ("word", "or"):
            at += 1
            parts.append(conjunction())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def conjunction():
        nonlocal at
        parts = [negation()]
        while peek() == ("word", "and"):
            at += 1
            parts.append(negation())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def negation():
        nonlocal at
        kind, piece = peek()
        if (kind, piece) == ("word", "not"):
            at += 1
            return Not(negation())
        at += 1
        if kind == "(":
            inner = disjunction()
            if peek()[0] != ")":
                raise DumpError(f"unclosed parenthesis in {text!r}")
            at += 1
            return inner
        if kind != "term":
            raise DumpError(f"a term is missing in {text!r}")
        return parse_term(piece)

    tree = disjunction()
    if at != len(pieces):
        raise DumpError(f"{pieces[at][1]!r} is out of place in {text!r}")
    return tree


def parse_filter(text: str) -> Term:
    """One term; text that would be more than one to ``parse_where`` is refused, so that it never means two things."""
    if len(structure(text)) != 1:
        raise DumpError(f"{text!r} has the structure of a where expression")
    return parse_term(text)


def combine(filters: list[str] | str | None = None, where: str | None = None):
    """All filters and the where expression together."""
    filters = [filters] if isinstance(filters, str) else filters or []
    return And((*map(parse_filter, filters), *([parse_where(where)] if where else [])))

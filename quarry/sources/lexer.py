"""Where a line of a dump script stands: in code, a literal, a quoted name, a comment or a dollar quote."""

from __future__ import annotations

import re

DOLLAR = re.compile(r"\$(?:[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)?\$")
#: What changes the state in code; an E before a quote makes backslashes escapes.
CODE = re.compile(r"""(?P<line>--[^\n]*)|(?P<block>/\*)|(?P<name>")|(?P<text>(?<![\w$])[eEbBxXnN]?'|(?<![\w$])[uU]&'|')|(?P<dollar>(?<![\w$])\$(?:[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)?\$)|(?P<end>;)""")


class Lexer:
    """Feeds on lines; splits statements at semicolons in code, outside parentheses or not alike.

    ``escapes``: whether plain literals hold backslash escapes (standard_conforming_strings off).
    """

    def __init__(self, escapes: bool = False):
        self.escapes = escapes
        self.state: tuple | None = None  # None: code
        self.pending: list[str] = []

    @property
    def in_code(self) -> bool:
        return self.state is None

    @property
    def idle(self) -> bool:
        """In code and between statements."""
        return self.state is None and not "".join(self.pending).strip()

    def feed(self, line: str) -> list[str]:
        """The statements that end in this line, without comments before them."""
        done, at = [], 0
        if self.idle and line.startswith("\\"):
            return [line.strip()]  # a meta-command runs to the end of its line
        while at < len(line):
            if self.state is None:
                m = CODE.search(line, at)
                if not m:
                    self.pending.append(line[at:])
                    break
                self.pending.append(line[at : m.start()])
                at, kind = m.end(), m.lastgroup
                if kind == "line":
                    self.pending.append(" ")
                elif kind == "block":
                    self.state = ("block", 1)
                elif kind == "end":
                    statement = "".join(self.pending).strip()
                    self.pending = []
                    if statement:
                        done.append(statement)
                else:
                    self.pending.append(m[0])
                    escapes = m[0][0] in "eE" or (self.escapes and m[0] == "'")
                    self.state = ("dollar", m[0]) if kind == "dollar" else ("name",) if kind == "name" else ("text", escapes)
            elif self.state[0] == "block":
                m = re.compile(r"/\*|\*/").search(line, at)
                if not m:
                    break
                depth = self.state[1] + (1 if m[0] == "/*" else -1)
                self.state = ("block", depth) if depth else None
                at = m.end()
            else:
                at = self._literal(line, at)
        return done

    def _literal(self, line: str, at: int) -> int:
        """Take the rest of a literal, as far as it is in this line."""
        kind = self.state[0]
        if kind == "dollar":
            end = line.find(self.state[1], at)
            stop = len(line) if end < 0 else end + len(self.state[1])
        else:
            mark, stop, end = '"' if kind == "name" else "'", at, -1
            while stop < len(line):
                c = line[stop]
                if c == "\\" and kind == "text" and self.state[1]:
                    stop += 2
                elif c == mark and line[stop + 1 : stop + 2] == mark:
                    stop += 2
                elif c == mark:
                    end = stop
                    stop += 1
                    break
                else:
                    stop += 1
            stop = min(stop, len(line))
        self.pending.append(line[at:stop])
        if end >= 0:
            self.state = None
        return stop

"""Secret scans: Boolean trigram queries against an inverted index of each batch, then verification.

Every rule's regular expression is parsed; what any match must hold becomes an AND/OR
query on trigrams of the ASCII-lower-cased text.  Of each batch of documents the postings
of the trigrams that the rules ask for are built in one pass over the bytes; a rule is run on
the documents that its query leaves.  A rule without mandatory trigrams runs on all.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 0

    def spans(self, text: str) -> list[tuple[int, int]]:
        found = compiled(self.pattern).finditer(text)
        return [m.span() for m in found if len(m[self.group]) >= self.min_chars]


def compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.ASCII)


#: The base kinds, in the order in which equal starts are listed.
BASE = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: What the method adds to the base.
MORE = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("basic_auth", r"[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/:@]+@"),
)
RULES = BASE + MORE

# A query is True (no condition), ("and", ...), ("or", ...) or a trigram in lower-case bytes.
#: Alternatives of a literal that are told apart; beyond that the exact strings are given up.
MOST = 64


def _and(*parts):
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _or(parts):
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _grams(strings: set[bytes]):
    """What a text must hold if it holds one of the strings."""
    return _or([_and(*(s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(strings)])


def _chars(items) -> set[bytes] | None:
    """The lower-cased characters of a class if they are few and ASCII."""
    out: set[bytes] = set()
    for kind, x in items:
        if kind is op.LITERAL:
            codes = [x]
        elif kind is op.RANGE and x[1] - x[0] < 8:
            codes = range(x[0], x[1] + 1)
        else:
            return None
        if any(c > 127 for c in codes):
            return None
        out |= {bytes([c]).lower() for c in codes}
    return out if len(out) <= 8 else None


def analyse(nodes) -> tuple[set[bytes] | None, object]:
    """(exact strings that the part matches or None, query that any match of it meets)."""
    exact: set[bytes] | None = {b""}  # what the run of nodes since the last unknown one matches
    query, whole = [], True

    def close():
        nonlocal exact, whole
        if exact:
            query.append(_grams(exact))
        exact, whole = {b""}, False

    for kind, x in nodes:
        if kind is op.LITERAL and x < 128:
            strings, more = {bytes([x]).lower()}, True
        elif kind is op.IN:
            strings, more = _chars(x), True
        elif kind is op.BRANCH:
            each = [analyse(b) for b in x[1]]
            strings = set().union(*(s for s, _ in each)) if all(s is not None for s, _ in each) else None
            more = _or([q if s is None else _and(_grams(s), q) for s, q in each])
        elif kind is op.SUBPATTERN:
            strings, more = analyse(x[-1])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, inner = x
            strings, more = analyse(inner)
            if low == 0:
                strings, more = (strings | {b""} if strings is not None and high == 1 else None), True
            elif strings is not None:
                times = strings
                for _ in range(min(low, 3) - 1):
                    times = {a + b for a in times for b in strings} if len(times) * len(strings) <= MOST else None
                    if times is None:
                        break
                if times is not None and low == high and low <= 3:
                    strings = times
                else:  # at least those come first
                    if times is not None:
                        more = _and(more, _grams(times))
                    strings = None
        elif kind is op.AT or kind in (op.ASSERT, op.ASSERT_NOT):
            continue
        else:
            strings, more = None, True
        query.append(more)
        if strings is None:
            close()
        else:
            joined = {a + b for a in exact for b in strings} if len(exact) * len(strings) <= MOST else None
            if joined is None:
                close()
                exact = strings
            else:
                exact = joined
    if not whole and exact:
        query.append(_grams(exact))
    return (exact if whole else None), _and(*query)


def trigram_query(pattern: str):
    strings, query = analyse(_parser.parse(pattern, re.ASCII))
    return _and(_grams(strings), query) if strings is not None else query


def query_grams(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(query_grams, query[1:]))


class BatchIndex:
    """Postings, as a bit row per wanted trigram, of the documents of a batch."""

    def __init__(self, grams: list[bytes]):
        self.row = {g: i for i, g in enumerate(grams)}
        self.wanted = np.full(1 << 24, -1, np.int16)
        for g, i in self.row.items():
            self.wanted[g[0] << 16 | g[1] << 8 | g[2]] = i
        self.lower = np.arange(256, dtype=np.uint32)
        self.lower[65:91] += 32

    def postings(self, texts: list[bytes], window: int = 1 << 22) -> np.ndarray:
        """Texts are read a window of bytes at a time, which overlaps by a trigram."""
        ends = np.cumsum([len(t) for t in texts])
        hit = np.zeros((len(self.row), len(texts)), bool)
        data = np.frombuffer(b"".join(texts), np.uint8)
        for at in range(0, max(0, len(data) - 2), window):
            low = self.lower[data[at : at + window + 2]]
            which = self.wanted[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
            where = np.flatnonzero(which >= 0)
            doc = np.searchsorted(ends, where + at, side="right")
            inside = where + at + 3 <= ends[doc]  # not over a document's edge
            hit[which[where[inside]], doc[inside]] = True
        return hit

    def evaluate(self, query, hit: np.ndarray) -> np.ndarray:
        if query is True:
            return np.ones(hit.shape[1], bool)
        if isinstance(query, bytes):
            return hit[self.row[query]]
        parts = [self.evaluate(q, hit) for q in query[1:]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


def scan_batch(index: BatchIndex, queries: list, rules: tuple[Rule, ...], texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, rule number, end) of every text's matches, in order."""
    hit = index.postings([t.encode("utf-8", "surrogatepass") for t in texts])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for number, (rule, query) in enumerate(zip(rules, queries)):
        for i in np.flatnonzero(index.evaluate(query, hit)):
            found[i] += [(a, number, b) for a, b in rule.spans(texts[i])]
    for spans in found:
        spans.sort()
    return found


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", rows_at_once: int = 256) -> DataFrame:
    """id and spans array<struct<kind, start, end>> (code points, end exclusive) for every whole text.

    Null text counts as empty and has no spans.  Rows are independent: repeated rows give equal results,
    empty tables empty ones; ids may be null; extra columns are ignored.  Spans of different kinds may overlap.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        queries = [trigram_query(r.pattern) for r in rules]
        index = BatchIndex(sorted(set().union(*map(query_grams, queries))))
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                found = scan_batch(index, queries, rules, [t or "" for t in part.column(1).to_pylist()])
                spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in s] for s in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, span)], names=["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return in_batches(rows, run, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>").withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The query's columns: counts of the base kinds, the hash of the base spans and all spans."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = [r.kind for r in BASE]
    return found.select(
        id_col, *(count(k).alias(f"n_{k}") for k in base),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def digest_of(text: str) -> str:
    """The base digest of one text, by the definition; what tests compare with."""
    spans = sorted((a, k, b) for k, r in enumerate(BASE) for a, b in r.spans(text))
    return hashlib.sha256(",".join(f"{BASE[k].kind}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()

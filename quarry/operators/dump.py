"""A dump as a database: tables with their children, scans, statistics and views."""

from __future__ import annotations

import hashlib
import io
import json
import os
import pickle
import shutil
import uuid
import warnings
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DumpError, SourceChanged
from ..functions import values
from ..functions.columns import Modes
from ..functions.pgtypes import Resolved, resolve_column
from ..plans import dialect, stats
from ..plans.predicate import TRUE, Bound, Term, columns_of
from ..plans.where import combine
from ..sources.byteio import open_source
from ..sources.copytext import MAX_LINE, split_fields, unescape
from ..sources.dumpmap import CopyBlock, DumpMap, lines, scan_structure
from ..sources.rows import Segment, cut_block
from .scan import SEGMENT, ScanSpec, scan

FORMAT = 2
#: Identity terms: those that must hold for a saved map to be used; the rest only warn.
TERMS = ("time", "location")


class MapReader(pickle.Unpickler):
    """Reads a kept map: the library's own classes and plain containers, and nothing that could run code."""

    def find_class(self, module, name):
        if module.startswith(("quarry.sources.", "quarry.functions.")) or (module, name) in (("builtins", "set"), ("builtins", "frozenset"), ("collections", "OrderedDict"), ("collections", "defaultdict")):
            found = super().find_class(module, name)
            if isinstance(found, type):
                return found
        raise pickle.UnpicklingError(f"a kept map holds no {module}.{name}")


class Dump:
    """A mapped dump.

    ``sidecar``: a folder that keeps the map and the statistics; ``identity``: "advisory" (a changed file warns),
    "none" (nor is a scan stopped when the file changes), or terms of ``TERMS`` that must hold.
    """

    def __init__(self, spark: SparkSession, location: str, sidecar: str | None = None, identity: str | tuple[str, ...] = "advisory", spool_to: str | None = None):
        self.spark, self.location, self.sidecar = spark, location, sidecar
        self.identity_terms = (identity,) if isinstance(identity, str) else tuple(identity)
        if len(self.identity_terms) > 1 and set(self.identity_terms) & {"advisory", "none"} or not set(self.identity_terms) <= {"advisory", "none", *TERMS}:
            raise DumpError(f"identity terms {self.identity_terms}")
        self.source = open_source(location, spool_to)
        self.notes: list[str] = []
        self.map = self._load()
        if self.map is None:
            self.map = scan_structure(location, self.source, spark)
            if sidecar:
                self._save()
        self._stats: dict[int, DataFrame] = {}

    # -- the kept map

    def _load(self) -> DumpMap | None:
        file = self.sidecar and os.path.join(self.sidecar, "map.pickle")
        if not file or not os.path.exists(file):
            return None
        with open(os.path.join(self.sidecar, "map.json")) as f:
            meta = json.load(f)
        with open(file, "rb") as f:
            raw = f.read()
        if meta["format"] != FORMAT or hashlib.sha256(raw).hexdigest() != meta["sha256"]:
            return None
        now, kept = self.source.identity(), meta["identity"]
        if now["size"] != kept["size"]:
            return None  # offsets can't hold
        differ = [t for t, k in (("time", "modified"), ("location", "location")) if now[k] != kept[k]]
        bound = [t for t in differ if t in self.identity_terms]
        if bound:
            raise SourceChanged(f"the saved map is of another {' and '.join(bound)}")
        if differ and self.identity_terms == ("advisory",):
            warnings.warn(f"the saved map is of another {' and '.join(differ)}", stacklevel=3)
        found = MapReader(io.BytesIO(raw)).load()
        found.source, found.identity = self.source, now
        return found

    def _save(self) -> None:
        os.makedirs(self.sidecar, exist_ok=True)
        held = self.map.source
        self.map.source = None  # opened anew by who reads the map
        raw = pickle.dumps(self.map)
        self.map.source = held
        meta = json.dumps({"format": FORMAT, "identity": self.map.identity, "sha256": hashlib.sha256(raw).hexdigest()})
        for name, data in (("map.pickle", raw), ("map.json", meta.encode())):  # whole files take the place of old ones
            part = os.path.join(self.sidecar, f".{name}.{uuid.uuid4().hex}")
            with open(part, "wb") as f:
                f.write(data)
            os.replace(part, os.path.join(self.sidecar, name))

    # -- statistics

    def gather(self, level: str = "data", overrides: dict[str, str] | None = None) -> None:
        """Gather and keep the statistics of all tables at level "data", of none at "metadata".

        ``overrides``: levels of single tables and columns, by schema.table and schema.table.column; the closest one holds.
        """
        overrides = dict(overrides or {})
        if not {level, *overrides.values()} <= {"data", "metadata"}:
            raise DumpError(f"levels are data and metadata, not {level} and {overrides}")
        if not self.sidecar:
            raise DumpError("statistics are kept in a sidecar, and none is named")
        known = set()
        for database, schema, name in self.tables():
            found, full = self.table(name, schema, database, inheritance="only"), f"{schema}.{name}" if schema else name
            known |= {full, *(f"{full}.{c}" for c in found.names)}
            wanted = [c for c in found.names if overrides.get(f"{full}.{c}", overrides.get(full, level)) == "data"]
            if wanted:
                found.statistics(wanted)
        if set(overrides) - known:
            raise DumpError(f"no such table or column: {sorted(set(overrides) - known)}")

    # -- tables

    def table(self, name: str, schema: str | None = None, database: str | None = None, inheritance: str = "descendants", **modes) -> DumpTable:
        if "." in name and schema is None:
            schema, _, name = name.rpartition(".")
        return DumpTable(self, *self.map.find(name, schema, database), inheritance, **modes)

    def tables(self) -> list[tuple[str | None, str | None, str]]:
        out = []
        for name, db in self.map.databases.items():
            out += [(name, *k) for k in dict.fromkeys([*db.tables, *(b.key for b in self.map.blocks if b.database == name)])]
        return out

    def driver_rows(self, block: CopyBlock) -> list[dict[str, str | None]]:
        """Rows of a catalog table, for the driver."""
        names = block.header.columns or ()
        return [dict(zip(names, (None if f is None else unescape(f) for f in split_fields(raw.rstrip(b"\r\n"))))) for _, raw in lines(self.source, block.data_start, block.data_end)]

    def hypertables(self, database: str | None) -> dict[tuple[str, str], dict]:
        """Chunks of each hypertable, by the extension's catalog: name -> chunks, compressed ones, dropped ones."""
        def rows(table: str) -> list[dict]:
            return [r for b in self.map.blocks_of(database, ("_timescaledb_catalog", table)) for r in self.driver_rows(b)]

        out = {}
        chunks = rows("chunk")
        for h in rows("hypertable"):
            mine = [c for c in chunks if c.get("hypertable_id") == h["id"] and c.get("dropped") != "t"]
            out[h["schema_name"], h["table_name"]] = {
                "chunks": [(c["schema_name"], c["table_name"]) for c in mine],
                "compressed": [(c["schema_name"], c["table_name"]) for c in mine if c.get("compressed_chunk_id")],
                "dropped": [(c["schema_name"], c["table_name"]) for c in chunks if c.get("hypertable_id") == h["id"] and c.get("dropped") == "t"],
            }
        return out


class DumpTable:
    """One table: its own blocks and, by default, its descendants' cut to its columns."""

    def __init__(self, dump: Dump, database: str | None, key: tuple[str | None, str], inheritance: str = "descendants", schema_mode: str = "typed", unrepresentable: str = "null", invalid: str = "default", group_bytes: int | None = None):
        if inheritance not in ("descendants", "only") or schema_mode not in ("typed", "strings"):
            raise DumpError(f"unknown mode {inheritance} or {schema_mode}")
        self.dump, self.database, self.key = dump, database, key
        self.db = dump.map.databases[database]
        self.inheritance, self.strings = inheritance, schema_mode == "strings"
        if invalid == "strict":
            raise DumpError("a strict check is of a whole table: strict_check")
        self.modes, self.group_bytes = Modes(unrepresentable, invalid), group_bytes
        self.notes: list[str] = []
        self.blocks = self._blocks()
        self.names = self._names()
        declared = {c.name: c for c in self.db.all_columns(key)}
        census = self._census(declared)
        self.columns = [resolve_column(declared.get(n), n, self.db, self.strings, census) for n in self.names]
        self.notes += [n for c in self.columns for n in c.notes]
        self.metrics: dict[str, int] = {}

    # -- what it is made of

    def _blocks(self) -> list[CopyBlock]:
        own = self.dump.map.blocks_of(self.database, self.key)
        loads = [b for b in own if b.partition_root]
        if self.inheritance == "only":
            return own
        out, missing = list(own), []
        hyper = self.dump.hypertables(self.database).get(self.key)
        if hyper and hyper["compressed"]:
            raise DumpError(f"{self.key[1]} has compressed chunks, which hold no readable rows: {hyper['compressed'][:3]}")
        family = self.db.descendants(self.key)
        if hyper:
            family += [c for c in hyper["chunks"] if c not in family]
        for child in family:
            blocks = self.dump.map.blocks_of(self.database, child)
            out += blocks
            if not blocks and hyper and child in hyper["chunks"]:
                missing.append(child)
        if missing:
            self.notes.append(f"{self.key[1]}: {len(missing)} chunks are not in the dump")
        if loads:
            self.notes.append(f"{self.key[1]}: rows were dumped through the partition root")
        parents = self.db.tables.get(self.key)
        if not out and parents and parents.parents and self._root_loaded(self.key):
            raise DumpError(f"{self.key[1]} was dumped through its partition root: read that one")
        return out

    def _root_loaded(self, key) -> bool:
        table = self.db.tables.get(key)
        return bool(table) and any(any(b.partition_root for b in self.dump.map.blocks_of(self.database, p)) or self._root_loaded(p) for p in table.parents)

    def _names(self) -> list[str]:
        """Own columns, in the order of the declaration; every block has to name them."""
        own = [b for b in self.blocks if b.key == self.key]
        declared = [c.name for c in self.db.all_columns(self.key) if not c.generated]
        if own:
            names = list(own[0].header.columns or ())
            if any(set(b.header.columns or ()) != set(names) for b in own):
                raise DumpError(f"the blocks of {self.key[1]} name different columns")
        elif self.blocks:
            first = self.blocks[0].header.columns or ()
            names = [n for n in declared if n in first]
        else:
            names = declared
        for b in self.blocks:
            lost = set(names) - set(b.header.columns or ())
            if lost:
                raise DumpError(f"{b.header.table} does not name {sorted(lost)} of {self.key[1]}")
        rank = {n: i for i, n in enumerate(declared)}
        return sorted(names, key=lambda n: rank.get(n, len(rank)))

    def _census(self, declared: dict) -> dict[str, tuple[int, int]]:
        """Dimensions of array columns: from kept statistics, else by a scan of those columns."""
        arrays = [] if self.strings else [n for n in self.names if n in declared and resolve_column(declared[n], n, self.db).type.kind == "array"]
        if not arrays:
            return {}
        self.columns = [resolve_column(declared[n], n, self.db) for n in arrays]
        held = self._kept_census()
        if set(arrays) <= set(held):
            return {n: tuple(held[n]) for n in arrays}
        if self.dump.spark is not None:
            found = self._gather(arrays).groupBy("name").agg(F.min("dims_low").alias("low"), F.max("dims_high").alias("high")).collect()
            found = {r.name: (r.low or 1, r.high or 1) for r in found}
        else:  # in a planner's process, which has no session
            columns = {b.number: self.columns for b in self.blocks}
            rows = [r for item in self._work() for r in stats.group_rows(self.dump.source, item, columns)]
            found = {n: (min((r["dims_low"] for r in rows if r["name"] == n and r["dims_low"]), default=1), max((r["dims_high"] for r in rows if r["name"] == n and r["dims_high"]), default=1)) for n in arrays}
        if self.dump.sidecar:
            self._keep_census(held | found)
        return found

    def _census_file(self) -> str | None:
        return self.dump.sidecar and os.path.join(self.dump.sidecar, f"census-{self._tag()}.json")

    def _kept_census(self) -> dict:
        file = self._census_file()
        if not file or not os.path.exists(file):
            return {}
        with open(file) as f:
            return json.load(f)

    def _keep_census(self, found: dict) -> None:
        part = f"{self._census_file()}.{uuid.uuid4().hex}"
        with open(part, "w") as f:
            json.dump(found, f)
        os.replace(part, self._census_file())

    def _tag(self) -> str:
        """What kept statistics are of: the table, how it is composed and cut, and the file as it is."""
        now = self.dump.map.identity
        return hashlib.sha256(repr((self.database, self.key, self.inheritance, self.strings, self.group_bytes, now["size"], now["modified"])).encode()).hexdigest()[:16]

    def _resolved(self, name: str) -> Resolved:
        return next(c for c in self.columns if c.name == name)

    # -- statistics

    def _work(self) -> list[tuple[CopyBlock, int, int, int]]:
        out = []
        for b in self.blocks:
            out += [(b, i, a, z) for i, (a, z) in enumerate(stats.group_ranges(b, stats.group_size(b, self.group_bytes)))]
        return out

    def _gather(self, names: list[str]) -> DataFrame:
        columns = {b.number: [c for c in self.columns if c.name in names] for b in self.blocks}
        return stats.gather(self.dump.spark, self.dump.source, self._work(), columns)

    def statistics(self, columns: list[str] | None = None) -> DataFrame:
        """Group statistics; with a sidecar they are kept, a folder a column, and only columns without are read for.

        A column's folder takes its place as a whole: of two sessions that gather it, one keeps it.
        """
        wanted = columns if columns is not None else self.names
        if not self.dump.sidecar or not wanted:
            return self._gather(wanted)
        path = os.path.join(self.dump.sidecar, f"stats-{self._tag()}")
        folders = {n: os.path.join(path, "column=" + hashlib.sha256(n.encode()).hexdigest()[:24]) for n in wanted}
        fresh = [n for n in wanted if not os.path.isdir(folders[n])]
        if fresh:
            part = f"{path}.{uuid.uuid4().hex}"
            column = F.substring(F.sha2("name", 256), 1, 24).alias("column")
            self._gather(fresh).select("*", column).write.partitionBy("column").parquet(part)
            os.makedirs(path, exist_ok=True)
            for n in fresh:
                made = os.path.join(part, os.path.basename(folders[n]))
                os.makedirs(made, exist_ok=True)  # a table without rows has no groups
                try:
                    os.rename(made, folders[n])
                except OSError:
                    pass  # another session was first
            shutil.rmtree(part, ignore_errors=True)
        return self.dump.spark.read.schema(stats.SCHEMA).parquet(*(folders[n] for n in wanted))

    def kept_statistics(self, names: list[str]) -> list[dict] | None:
        """Kept statistics of columns, read without Spark; None where there are none."""
        import pyarrow.dataset as ds

        path = self.dump.sidecar and os.path.join(self.dump.sidecar, f"stats-{self._tag()}")
        folders = [os.path.join(path, "column=" + hashlib.sha256(n.encode()).hexdigest()[:24]) for n in names] if path else []
        if not folders or not all(map(os.path.isdir, folders)):
            return None
        return [r for f in folders for r in ds.dataset(f, format="parquet").to_table().to_pylist()]

    def strict_check(self) -> DataFrame:
        """(name, refused, nulls, first): columns with values that their declared type refuses, or NULLs where it has none.

        Every value is decoded, whether or not it is used; columns of types that are kept as text are noted as unchecked.
        """
        opaque = [c.name for c in self.columns if c.type.kind == "opaque"]
        if opaque:
            self.notes.append(f"{self.key[1]}: not checked: {', '.join(opaque)}")
        bare = F.col("name").isin([c.name for c in self.columns if c.not_null])
        found = self.statistics().groupBy("name").agg(F.sum("refused").alias("refused"), F.sum(F.when(bare, F.col("nulls")).otherwise(0)).alias("nulls"), F.min("refusal").alias("first"))
        return found.where("refused > 0 OR nulls > 0")

    def summary(self) -> DataFrame:
        return stats.summary(self.statistics())

    def stats_aggregate(self, *wanted: tuple[str, str | None]) -> dict[str, object]:
        """count, count_distinct, min, max, sum from statistics alone; refused where they are not exact.

        ``wanted``: (function, column) pairs, the column None for rows.
        """
        names = list(dict.fromkeys(c for _, c in wanted if c)) or self.names[:1]
        groups = self.statistics(names).collect()
        out: dict[str, object] = {}
        for how, name in wanted:
            mine = [g for g in groups if g["name"] == (name or names[0])]
            rows, nulls = sum(g["rows"] for g in mine), sum(g["nulls"] for g in mine)
            label = f"{how}_{name}" if name else how
            if how == "count":
                out[label] = rows - (nulls + sum(g["beyond"] or 0 for g in mine) if name else 0)
                continue
            r = self._resolved(name)
            if any(g["refused"] for g in mine) or (how != "count_distinct" and any(g["beyond"] for g in mine)):
                raise DumpError(f"{label}: the statistics don't answer it exactly")
            if how in ("min", "max"):
                side, exact = ("low", "low_exact") if how == "min" else ("high", "high_exact")
                held = [g for g in mine if g["rows"] > g["nulls"]]
                if any(g[side] is None or not g[exact] for g in held):
                    raise DumpError(f"{label}: the statistics hold no exact bound")
                best = (min if how == "min" else max)((g[side] for g in held), key=lambda t: values.order_key(r.type, t), default=None)
                out[label] = None if best is None else values.decode(r.type, best)
            elif how == "sum":
                held = [g for g in mine if g["rows"] > g["nulls"]]
                if any(g["total"] is None for g in held):
                    raise DumpError(f"{label}: no sums are kept for {r.type.declared}")
                total = sum(int(g["total"]) for g in held)
                wrap = stats.wrapped(total, 64, r.type.kind != "oid") if r.type.kind in values.LIMITS else total
                out[label] = None if not held else wrap if r.type.kind in values.LIMITS else values.Decimal(total).scaleb(-mine[0]["total_scale"])
            elif how == "count_distinct":
                if any(g["dictionary"] is None for g in mine):
                    raise DumpError(f"{label}: too many values for a dictionary")
                out[label] = len({values.order_key(r.type, v) for g in mine for v in g["dictionary"]})
            else:
                raise DumpError(f"{how} is not kept")
        return out

    # -- scans

    def bound(self, tree, semantics: str = "postgres") -> Bound:
        return Bound(tree, {c.name: c for c in self.columns}, semantics, self.strings)

    def pruned(self, bound: Bound) -> tuple[list[Segment], dict[int, dict[str, str]]]:
        """Segments of the row groups that may hold a row for which the filter is true, neighbours joined; and orders of blocks."""
        names = columns_of(bound.tree)
        rows = self.kept_statistics(names)  # of the filter's columns only
        if rows is None:
            rows = [r.asDict() for r in self.statistics(names).collect()]
        groups = stats.by_group(rows)
        bounds = {(r["block"], r["grp"]): (r["start"], r["end"]) for r in rows}
        kept: list[Segment] = []
        skipped = 0
        for at in sorted(bounds):
            if not bound.truths(groups[at]) & TRUE:
                skipped += 1
                continue
            start, end = bounds[at]
            if kept and kept[-1].block == at[0] and kept[-1].end == start and end - kept[-1].start <= SEGMENT:
                kept[-1] = replace(kept[-1], end=end)
            else:
                kept.append(Segment(at[0], start, end))
        self.metrics |= {"row_groups": len(bounds), "row_groups_pruned_statistics": skipped}
        order: dict[int, dict[str, str]] = {}
        for b in {k[0] for k in bounds}:
            for n in names:
                mine = [groups[k][n] for k in sorted(groups) if k[0] == b and n in groups[k]]
                order.setdefault(b, {})[n] = stats.block_order(self._resolved(n), mine)
        return kept, order

    def scan(self, columns: list[str] | None = None, filters: list[str] | str | None = None, where: str | None = None, tree=None, semantics: str = "postgres", use_statistics: bool = False, offsets: bool = False, segment_bytes: int | None = None, tasks: int | None = None, limit: int | None = None, marks: list[str] | None = None, after: int | None = None, before: int | None = None) -> DataFrame:
        """A DataFrame of the asked columns (none: as many empty rows) of the rows for which the filter is true.

        The filter runs in the scanning tasks, on the text, before anything is decoded; with ``use_statistics`` row groups
        that can't hold such a row are not read.  ``offsets`` adds the row's byte offset, which gives the file's order; rows
        up to offset ``after`` and from ``before`` on are not read.  ``limit``: any so many rows, of which no task decodes more.  ``marks`` adds a boolean
        for each of these columns: whether the dump holds a value there that the column's type has not.

        The session's ``quarry.chunk_size`` is the default of ``segment_bytes``; rows longer than its ``quarry.memory`` are refused.
        """
        segment_bytes = segment_bytes or self._setting("quarry.chunk_size") or SEGMENT
        longest = min(self._setting("quarry.memory") or MAX_LINE, MAX_LINE)
        marks = marks or []
        if marks and (self.strings or not set(marks) <= set(self.names)):
            raise DumpError(f"no declared type tells what of {marks} is unrepresentable")
        names = self.names if columns is None else columns
        if len(set(names)) != len(names) or not set(names) <= set(self.names):
            raise DumpError(f"columns {names} are unknown or named twice")
        tree = combine(filters, where) if tree is None else tree
        filtering = bool(columns_of(tree)) or not isinstance(tree, type(combine())) or tree.parts
        bound = self.bound(tree, semantics) if filtering or marks else None
        order: dict[int, dict[str, str]] = {}
        if bound and use_statistics and columns_of(tree):
            segments, order = self.pruned(bound)
        else:
            segments = [s for b in self.blocks for s in cut_block(b, segment_bytes, self.dump.source.cuts())]
        first, stop = -1 if after is None else after, float("inf") if before is None else before
        segments = [replace(s, start=max(s.start, first + 1), end=min(s.end, stop)) for s in segments if s.end > first + 1 and s.start < stop]
        self.metrics["segments"] = len(segments)
        self.metrics["bytes"] = sum(s.end - s.start for s in segments)
        if bound:
            self.notes += [w for w in bound.warnings if w not in self.notes]
        spec = ScanSpec(self.dump.source, self.dump.map.identity, {b.number: b for b in self.blocks}, segments, [self._resolved(n) for n in names], self.modes, bound, offsets, self.dump.identity_terms != ("none",), order, limit, marks, longest)
        found = scan(self.dump.spark, spec, tasks)
        return found if limit is None else found.limit(limit)

    def _setting(self, name: str) -> int | None:
        """A setting of the session, in bytes; unset and 0 are the default."""
        text = self.dump.spark and self.dump.spark.conf.get(name, None)
        if text and not text.isdigit():
            raise DumpError(f"{name} is a number of bytes, not {text!r}")
        return int(text) if text else None

    def page(self, n: int, token: str | None = None, columns: list[str] | None = None, filters: list[str] | str | None = None, where: str | None = None) -> tuple[list, str | None]:
        """The next ``n`` rows in the file's order, and the token that the page after them begins with; None at the end.

        A token is of one query over one state of the file: another one refuses it.  Segments are read in runs that double
        until the page is full.
        """
        names = self.names if columns is None else columns
        mark, at = self._token(token, names, combine(filters, where))
        step = self._setting("quarry.chunk_size") or SEGMENT
        ends = sorted(s.end for b in self.blocks for s in cut_block(b, step, self.dump.source.cuts()) if s.end > at + 1)
        rows, run, last, after = [], 1, 0, at
        while last < len(ends) and len(rows) < n:
            last = min(last + run, len(ends))
            run *= 2
            some = self.scan(names, filters, where, offsets=True, after=after, before=ends[last - 1])
            rows += some.orderBy("_offset").limit(n - len(rows)).collect()
            after = ends[last - 1] - 1
        full = len(rows) == n
        return [r[:-1] for r in rows], f"{mark}:{rows[-1]['_offset'] if rows else at}" if full else None

    def _token(self, token: str | None, names: list[str], tree) -> tuple[str, int]:
        """What a token is of, and the offset of the last row before it."""
        mark = hashlib.sha256(repr((self._tag(), names, tree)).encode()).hexdigest()[:16]
        of, _, at = (token or f"{mark}:-1").partition(":")
        if of != mark or not at.removeprefix("-").isdigit():
            raise DumpError("the token is of another query or another file")
        return mark, int(at)

    def rest(self, token: str | None, columns: list[str] | None = None, filters: list[str] | str | None = None, where: str | None = None) -> DataFrame:
        """All rows after a token, as a scan: what is before it is not read."""
        names = self.names if columns is None else columns
        return self.scan(names, filters, where, after=self._token(token, names, combine(filters, where))[1])

    def ordered_scan(self, **options) -> DataFrame:
        """In the file's order, which costs a sort; one sorted block alone is in order as it is."""
        options["offsets"] = True
        return self.scan(**options).orderBy("_offset").drop("_offset")

    def stage(self, path: str, **options) -> DataFrame:
        """The table as Parquet, read back: from here Catalyst prunes columns, row groups and partitions itself."""
        options_ = {"mode": options.pop("mode", "overwrite"), "partition_by": options.pop("partition_by", [])}
        writer = self.scan(**options).write.mode(options_["mode"])
        (writer.partitionBy(*options_["partition_by"]) if options_["partition_by"] else writer).parquet(path)
        return self.dump.spark.read.parquet(path)

    def semi_join_prune(self, column: str, keys: DataFrame, most: int = 1000, **options) -> DataFrame:
        """Rows whose ``column`` is among the one-column ``keys``: the scan is pruned by the keys' list or bounds, then joined.

        Up to ``most`` keys come to the driver as a list, otherwise just their bounds.
        """
        r, key = self._resolved(column), keys.columns[0]
        text = keys.select(F.col(key).cast("string").alias("k")).where("k IS NOT NULL")
        some = [row.k for row in text.distinct().limit(most + 1).collect()]
        if len(some) <= most:
            tree = Term(column, "in", tuple(some))
        else:
            low, high = keys.agg(F.min(key).cast("string"), F.max(key).cast("string")).first()
            tree = combine(where=f'"{column}" >= \'{low}\' and "{column}" <= \'{high}\'')
        found = self.scan(tree=tree, use_statistics=values.ordered(r.type), **options)
        return found.join(keys.select(F.col(key).alias("__k")).distinct(), F.col(f"`{column}`") == F.col("__k"), "left_semi")

    def top(self, column: str, n: int, descending: bool = False, **options) -> DataFrame:
        """ORDER BY column LIMIT n with NULLs last (first when descending): groups that can't reach the n-th bound of the others are skipped."""
        r = self._resolved(column)
        rows = self.kept_statistics([column])
        groups = [g for g in (rows if rows is not None else self.statistics([column]).collect()) if g["low"] is not None and not g["refused"]]
        tree = None
        side, far = ("high", "low") if descending else ("low", "high")
        ranked = sorted(groups, key=lambda g: values.order_key(r.type, g[far]), reverse=descending)
        seen, limit = 0, None
        for g in ranked:
            seen += g["rows"] - g["nulls"] - (g["beyond"] or 0)
            if seen >= n:
                limit = g[far]
                break
        nulls = sum(g["nulls"] for g in groups)
        if limit is not None and not (descending and nulls):
            tree = Term(column, ">=" if descending else "<=", (limit,))
        c = F.col(f"`{column}`")
        found = self.scan(tree=tree, use_statistics=True, **options) if tree else self.scan(**options)
        return found.orderBy(c.desc_nulls_first() if descending else c.asc_nulls_last()).limit(n)


def view_name(*parts: str | None) -> str:
    return "_".join(p for p in parts if p).replace("-", "_").replace(".", "_")


def register_dump(spark: SparkSession, name: str, location: str, staged: str | None = None, **options) -> Dump:
    """Views ``name_schema_table`` (and name_database_schema_table) of every table; with ``staged``, over Parquet copies there."""
    if not name.isidentifier():
        raise DumpError(f"{name!r} is no catalog name")
    modes = {k: options.pop(k) for k in ("inheritance", "schema_mode", "unrepresentable", "invalid") if k in options}
    dump = Dump(spark, location, **options)
    several = len(dump.map.databases) > 1
    for database, schema, table in dump.tables():
        try:
            found = DumpTable(dump, database, (schema, table), **modes)
        except DumpError as e:
            dump.notes.append(f"{table}: {e}")
            continue
        if not found.names:
            continue
        view = view_name(name, database if several else None, schema, table)
        df = found.stage(os.path.join(staged, view)) if staged else found.scan()
        df.createOrReplaceTempView(f"`{view}`")
        dialect.scanned(spark)[view] = found
    return dump

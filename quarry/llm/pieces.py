"""SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

The encoder walks a segment with longest vocabulary matches (Aho-Corasick), accepts a
match only next to a piece that it is compatible with - the two, joined and merged again
from single characters, come out as the same two - and otherwise tries the next shorter
match, or steps back and marks the position as failed in a bit field.  A sequence of pieces
all of whose neighbours are compatible is the merge result, and there is just one.

Text is cut into segments first, only at places that no piece of the vocabulary spans, so
that merges can't cross: before a run of spaces, around line feeds, and between a letter and such
punctuation as never follows a letter in a piece of the model.
"""

from __future__ import annotations

import hashlib
import re
import string
from array import array
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches

SPACE = "▁"
#: Texts are cut with plain spaces, which take a byte where the mark takes two and doubles the whole text.
SEGMENT = re.compile("\n| +[^ \n]*|[^ \n]+")
#: Segments of each of two generations, and neighbour pairs, whose results a worker keeps.
KEPT_SEGMENTS, KEPT_PAIRS = 300_000, 300_000
#: Longer segments are not kept.
KEPT_LENGTH = 32


class Segments(dict):
    """segment -> ids as packed 32-bit integers, made when asked for.

    When full, it becomes the older generation, from which segments come back when they are
    asked for again: memory stays bounded and what is frequent stays.
    """

    def __init__(self, make, parts):
        self.make, self.parts, self.older = make, parts, {}

    def __missing__(self, segment: str) -> bytes:
        ids = self.older.get(segment)
        if ids is None:
            parts = self.parts(segment)
            ids = array("i", self.make(segment.replace(" ", SPACE))).tobytes() if len(parts) == 1 else b"".join(map(self.__getitem__, parts))
        if len(self) >= KEPT_SEGMENTS:
            self.older = dict(self)
            self.clear()
        if len(segment) <= KEPT_LENGTH:
            self[segment] = ids
        return ids


class MergeEncoder:
    """Encoder for the models that the readers below can vouch for; others are refused."""

    def __init__(self, path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        for i in range(size):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                piece = sp.id_to_piece(i)
                self.id[piece], self.rank[piece] = i, -sp.get_score(i)
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and p != "\n") for p in self.id) or not all(map(sp.is_byte, self.byte)):
            raise ValueError("the model has pieces over a segment's edge, or no byte pieces")
        # SentencePiece rewrites nothing and adds one space in front, or the model is another kind
        if sp.encode("") != [] or sp.decode(sp.encode("  aé ﬁ")) != "  aé ﬁ":
            raise ValueError("the model rewrites its input")
        self.matcher = ahocorasick.Automaton()
        for piece, i in self.id.items():
            # a piece that its own characters don't merge to can't be in any result
            if self.merged(piece) == [piece]:
                self.matcher.add_word(piece, (len(piece) - 1, piece))
        self.matcher.make_automaton()
        self.shorter: dict[str, str] = {}
        for piece in self.matcher.keys():
            self.shorter[piece] = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.matcher), "")
        self.compatible = lru_cache(KEPT_PAIRS)(self._compatible)
        after_letter = {p[i + 1] for p in self.id for i in range(len(p) - 1) if p[i].isalpha()}
        stops = "".join(c for c in string.punctuation if c not in after_letter)
        edge = re.compile(f"(?<=[^\\W\\d_])(?=[{re.escape(stops)}])" if stops else "(?!)")
        self.segments = Segments(self.backtracked, edge.split)
        self.text_of = [str(i) for i in range(size)]

    def merged(self, text: str) -> list[str]:
        """Merge by definition: always the best-ranked neighbours, the leftmost of equals."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = min((rank.get(parts[i] + parts[i + 1], float("inf")), i) for i in range(len(parts) - 1))
            if best == float("inf"):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, left: str, right: str) -> bool:
        return self.merged(left + right) == [left, right]

    def longest(self, text: str) -> list[str]:
        """The longest piece that starts at each position; a character that is no piece stands for itself."""
        out = list(text)
        for end, (back, piece) in self.matcher.iter(text):
            out[end - back] = piece  # ends only grow: the last one at a start is the longest
        return out

    def backtracked(self, text: str) -> list[int]:
        first, shorter, compatible = self.longest(text), self.shorter, self.compatible
        n, at = len(text), 0
        failed = bytearray((n >> 3) + 1)  # a bit for each position
        path: list[str] = []
        piece = first[0]
        while at < n:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1 and (not path or compatible(path[-1], piece)):
                path.append(piece)
                at = end
                if at < n:
                    piece = first[at]
                continue
            piece = shorter.get(piece, "")
            if not piece:  # nothing fits here: never come back to this position
                failed[at >> 3] |= 1 << (at & 7)
                if not path:
                    raise AssertionError(f"no merge result for {text!r}")
                last = path.pop()
                at -= len(last)
                piece = last  # its end has failed, so that the next shorter one is tried
        ids: list[int] = []
        for piece in path:
            i = self.id.get(piece)
            if i is not None:
                ids.append(i)
            else:
                ids.extend(self.byte[b] for b in piece.encode("utf-8"))
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        found = SEGMENT.findall(" " + text.replace(SPACE, " "))
        return memoryview(b"".join(map(self.segments.__getitem__, found))).cast("i").tolist()

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(4)
def encoder(path: str) -> MergeEncoder:
    """One encoder a worker process and model."""
    return MergeEncoder(path)


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 [, ids array<int>] for every whole text.

    ``path`` is a model file that all machines have.  Null text counts as empty, which has no ids.  Rows are
    independent: ties and repeated rows give equal results, empty tables empty ones; ids may be null;
    extra columns are ignored.
    """

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                ids = coder.encode(value.as_py() or "")
                line = ",".join(map(coder.text_of.__getitem__, ids))
                decoded = coder.decode(ids) if ids else ""
                rows.append((len(ids), hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest(), ids if with_ids else None))
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
            if with_ids:
                columns.append(pa.array([r[3] for r in rows], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = in_batches(rows, run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))
    return out.withColumnRenamed("id", id_col)


def decode_pieces(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of each id list; null lists give null."""
    schema = T.StructType([*df.schema.fields, T.StructField(text_col, T.StringType())])

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            texts = [None if x.as_py() is None else coder.decode(x.as_py()) if len(x.as_py()) else "" for x in batch.column(batch.schema.get_field_index(ids_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_col])

    return in_batches(df, run, schema)

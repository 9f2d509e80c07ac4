"""SentencePiece encoding and decoding of merge-type models, exactly, by backtracking.

A piece sequence is the merge encoding of a text if and only if every two neighbours stay as they are when their text is
merged anew.  So a chunk is encoded from left to right: at each place the longest piece that starts there (found by an
Aho-Corasick automaton) is tried, then shorter ones; a piece is kept if it is compatible with the one before it,
and places from which no way led on are marked in a bitfield and not tried again.

No piece has a space mark behind another character, and none joins a letter with a punctuation mark (the classes are found
from the model).  So a text falls into chunks, each of space marks and a run of one class, which are encoded independently
and remembered in a table of bounded size.

Null and empty texts have no piece.  Characters that no piece has become byte pieces.  Rows, repeated rows and further
columns are passed on (columns named like the outputs are replaced).
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_map

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MEMORY = 200_000  #: chunks remembered by a worker, twice: those met since the table was last full, and those before
REMEMBERED = 48  #: characters of the longest chunk that is remembered


def fields(data: bytes):
    """(number, value) of each field of a serialized message; ints for varints, bytes for the rest."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class Pieces:
    """A merge-type model with byte fallback, read from the bytes of its file."""

    def __init__(self, model: bytes):
        self.text, self.score, self.kind = [], [], []
        self.prefix, self.squeeze, self.escape, identity = True, True, True, False
        merge_type = False
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                self.text.append(piece[1].decode())
                self.score.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kind.append(piece.get(3, NORMAL))
            elif number == 2:
                merge_type = dict(fields(value)).get(3) == 2
            elif number == 3:
                rules = dict(fields(value))
                identity = not rules.get(2)
                self.prefix, self.squeeze, self.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
        if not (merge_type and identity and self.escape and not self.squeeze) or USER_DEFINED in self.kind:
            raise ValueError("only merge-type models without normalisation, with escaped white space and no pieces of the user are read")
        self.rank = {t: -s for t, s, k in zip(self.text, self.score, self.kind, strict=True) if k == NORMAL}
        place = {t: i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == NORMAL}
        self.byte = {int(t[1:-1], 16): i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == BYTE}
        self.byte_of = {i: b for b, i in self.byte.items()}
        if len(self.byte) != 256:
            raise ValueError("a model with all 256 byte pieces is needed")
        if any(MARK in t.lstrip(MARK) for t in self.rank):
            raise ValueError("a piece has a space mark behind another character")
        self.shown = [t.replace(MARK, " ") for t in self.text]
        self.known = {c for t in self.rank for c in t if c in self.rank}
        self.pairs = {t[k : k + 2] for t in self.rank for k in range(len(t) - 1)}
        self.tree, self.place = ahocorasick.Automaton(), {}
        for t, i in place.items():
            if self.merged(t) == [t]:  # others never stand in an encoding
                self.tree.add_word(t, (len(t), i))
                self.place[t] = i
        self.tree.make_automaton()
        #: by piece, the longest other one that it starts with, or -1
        self.shorter = [next((self.place[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.place), -1) for t in self.text]
        self.compatible = lru_cache(150_000)(self._compatible)
        self.sizes = list(map(len, self.text))
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        letters = re.escape("".join(sorted(self.widest_class())))
        self.cut = re.compile(f"{MARK}*[{letters}]+|{MARK}*[^{MARK}{letters}]+|{MARK}+").findall

    def widest_class(self) -> set[str]:
        """The largest set of characters, but for the space mark, that no piece joins with a character outside it."""
        group = {c: c for c in {MARK, *"".join(self.rank)}}

        def find(c: str) -> str:
            while group[c] != c:
                group[c] = c = group[group[c]]
            return c

        for a, b in self.pairs:
            if MARK not in (a, b):
                group[find(a)] = find(b)
        classes: dict[str, set[str]] = {}
        for c in group:
            if c != MARK:
                classes.setdefault(find(c), set()).add(c)
        return max(classes.values(), key=lambda x: (len(x), min(x)))

    def merged(self, text: str) -> list[str]:
        """Merging as it is defined: the best pair first, of equal ones the leftmost."""
        parts, rank = list(text), self.rank
        best_of = [rank.get(parts[i] + parts[i + 1]) for i in range(len(parts) - 1)]
        while True:
            at, best = -1, None
            for i, r in enumerate(best_of):
                if r is not None and (best is None or r < best):
                    at, best = i, r
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del best_of[at]
            if at < len(best_of):
                best_of[at] = rank.get(parts[at] + parts[at + 1])
            if at:
                best_of[at - 1] = rank.get(parts[at - 1] + parts[at])

    def _compatible(self, a: int, b: int) -> bool:
        return self.merged(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]

    def known_run(self, run: str) -> list[int]:
        """Encoding of characters that are all pieces."""
        # of the pieces that start at a place, the automaton meets the longest last
        longest = {end - size: i for end, (size, i) in self.tree.iter(run)}
        n, compatible, sizes, shorter = len(run) - 1, self.compatible, self.sizes, self.shorter
        failed, at, last, out = 0, -1, -1, []
        i = longest[-1]
        while True:
            while i >= 0:
                if last < 0 or compatible(last, i):
                    to = at + sizes[i]
                    if not failed >> to + 1 & 1:
                        break
                i = shorter[i]
            else:  # a way back: the last piece gives way to the next shorter one
                failed |= 1 << at + 1
                i = out.pop()
                at -= sizes[i]
                last = out[-1] if out else -1
                i = shorter[i]
                continue
            out.append(i)
            if to == n:
                return out
            at, last = to, i
            i = longest[to]

    def chunk(self, chunk: str) -> list[int]:
        known = self.known
        if known.issuperset(chunk):
            return self.known_run(chunk)
        out, a = [], 0
        for e in range(1, len(chunk) + 1):  # characters that no piece has stand alone
            if e == len(chunk) or chunk[e] not in known or chunk[e - 1] not in known:
                part = chunk[a:e]
                a = e
                out += self.known_run(part) if part[0] in known else [self.byte[b] for b in part.encode()]
        return out

    def remember(self, part: str, ids: list[int] | tuple[int, ...]) -> None:
        if len(self.young) >= MEMORY:
            self.old, self.young = self.young, {}
        self.young[part] = tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out = []
        for c in self.cut((MARK if self.prefix else "") + text.replace(" ", MARK)):
            ids = self.young.get(c)
            if ids is None:
                ids = self.old.get(c) or self.chunk(c)
                if len(c) <= REMEMBERED:
                    self.remember(c, ids)
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of pieces: control pieces vanish, byte pieces are read as UTF-8 (a wrong byte as U+FFFD), the space that a first piece begins with goes."""
        shown, byte_of = self.shown, self.byte_of
        if byte_of.keys().isdisjoint(ids):
            out = [shown[i] if self.kind[i] != CONTROL else "" for i in ids] if any(i < 3 for i in ids) else list(map(shown.__getitem__, ids))
        else:
            out, run = [], bytearray()
            for i in [*ids, None]:
                if i in byte_of:
                    run.append(byte_of[i])
                    continue
                if run:
                    out.append(utf8(bytes(run)))
                    run.clear()
                if i is not None and self.kind[i] != CONTROL:
                    out.append(" ⁇ " if self.kind[i] == UNKNOWN else shown[i])
        text = "".join(out)
        first = next((i for i in ids if self.kind[i] != CONTROL), None)
        return text[1:] if self.prefix and first is not None and self.text[first].startswith(MARK) else text


def utf8(data: bytes) -> str:
    """Each byte that starts no valid character becomes U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def model_bytes(path: str) -> bytes:
    """The model file's bytes, read once on the driver: executors needn't have the file."""
    with open(path, "rb") as f:
        return f.read()


_loaded: dict[str, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """The model, built once in a worker."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _loaded:
        _loaded[key] = Pieces(model)
    return _loaded[key]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """`docs` with ids (array<int>) and decoded (string)."""
    return _mapped(docs, path, {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}, lambda ids, text: (ids, text))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """`docs` with n_tokens, ids_sha256 and decoded_sha256 of the same ids and text."""

    decimal = [str(i) for i in range(len(Pieces(model_bytes(path)).text))]

    def of(ids, text):
        return len(ids), hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _mapped(docs, path, {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}, of)


def _mapped(docs: DataFrame, path: str, added: dict, of) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(path))
    named = [c for c in docs.columns if c not in added]
    schema = T.StructType([*docs.select(named).schema.fields, *(T.StructField(k, v) for k, v in added.items())])

    def run(batches):
        pieces = loaded(model.value)
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                ids = pieces.encode(t)
                rows.append(of(ids, pieces.decode(ids)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(added)
            kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string()}
            new = [pa.array(list(c), type=kinds.get(v, pa.list_(pa.int32()))) for c, v in zip(columns, added.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in named), *new], [*named, *added])

    return arrow_map(docs.select(*named), run, schema)


def op7_pieces(docs: DataFrame, path: str) -> DataFrame:
    """Contract digest: number and digest of the ids, digest of the decoded text, of every document."""
    return digests(docs.select("doc_id", "text"), path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")

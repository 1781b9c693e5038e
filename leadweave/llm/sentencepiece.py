"""SentencePiece encoding that keeps offsets, and decoding.

A text is first normalised by the model's compiled character map: at each place the longest entry that
is a prefix of the rest is replaced, any other character is copied. While doing so, the source byte of
every normalised byte is recorded. The library then segments the normalised text (its own normaliser
being switched off in a copy of the model), and the bytes of each piece are projected through the record to
a span of source bytes. So ids are exactly the library's, and every id knows where it came from.

Of the bytes of one source character that is spelled out by byte pieces, the last piece has the character's
span and the ones before have empty spans at its start. White space that the model adds has an empty span.

Defined cases: a null text is encoded as the empty text, which has no pieces; texts are encoded whole;
lone surrogates become question marks. Repeated rows each get their ids. Only the text is read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F, types as T

SPACE = "▁"  # what a model writes for a space
_SPACE_BYTES = len(SPACE.encode())
_NORMAL, _UNKNOWN, _USER_DEFINED, _BYTE = 1, 2, 4, 6  # kinds of pieces in the model format


# --- the model file ---------------------------------------------------------------------------------


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialized protocol buffer."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield tag >> 3, message[at:at + size]
        at += size


def character_map(blob: bytes) -> dict[str, str]:
    """The entries of a compiled character map: a double-array trie, then the replacements.

    Units hold a label in their low byte (bit 31 marks a value instead), a leaf flag in bit 8 and the
    offset to their children above it, in units of 256 if bit 9 is set.
    """
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units = np.frombuffer(blob, "<u4", size // 4, 4)
    texts = blob[4 + size:]
    found: dict[str, str] = {}
    labels = np.arange(1, 256)
    children = lambda at: at ^ ((int(units[at]) >> 10) << ((int(units[at]) & 512) >> 6))
    stack = [(0, b"")]
    while stack:
        at, key = stack.pop()
        base = children(at)
        if key and int(units[at]) >> 8 & 1:
            start = int(units[base]) & 0x7FFFFFFF
            found[key.decode()] = texts[start:texts.index(b"\0", start)].decode()
        below = base ^ labels
        inside = below < len(units)
        for label in labels[inside][(units[below[inside]] & 0x800000FF) == labels[inside]]:
            stack.append((base ^ int(label), key + bytes([label])))
    return found


@dataclass(frozen=True)
class Normalizer:
    """Normalises a text and tells the source byte of each normalised byte."""

    entries: dict[str, str]
    kept: frozenset[str] = frozenset()  # user-defined pieces stay as they are
    add_space: bool = True
    squeeze: bool = True
    mark_space: bool = True

    def __post_init__(self) -> None:
        known = self.kept | self.entries.keys()
        object.__setattr__(self, "lengths", tuple(sorted({len(k) for k in known}, reverse=True)))
        heads = "".join(re.escape(c) for c in sorted({k[0] for k in known if k}))
        object.__setattr__(self, "heads", re.compile(f"[{heads}]") if heads else None)

    def _chunks(self, text: str) -> Iterator[tuple[str, str]]:
        """(source, replacement) pairs; stretches that no entry can begin in are one pair."""
        at = 0
        while at < len(text):
            head = self.heads.search(text, at) if self.heads else None
            stop = head.start() if head else len(text)
            if stop > at:
                yield text[at:stop], text[at:stop]
                at = stop
                continue
            part = text[at]
            new = part
            for keys, value in ((self.kept, None), (self.entries, self.entries)):
                hit = next((text[at:at + n] for n in self.lengths if text[at:at + n] in keys), None)
                if hit is not None:
                    part, new = hit, hit if value is None else value[hit]
                    break
            yield part, new
            at += len(part)

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and the source offset of each of its bytes and of its end."""
        out, origin, offset, after_space = [], [], 0, self.squeeze
        pad = (_SPACE_BYTES if self.mark_space else 1) if self.add_space else 0
        for source, new in self._chunks(text):
            raw, size = new.encode(), len(source.encode())
            starts = _char_starts(raw) if source == new else np.zeros(len(raw), np.int64)
            data = np.frombuffer(raw, np.uint8)
            if self.squeeze and len(data):
                blank = data == 32
                drop = blank & np.r_[after_space, blank[:-1]]
                if drop.any():
                    data, starts = data[~drop], starts[~drop]
                after_space = bool(blank[-1])
            out.append(data.tobytes())
            origin.append(starts + offset)
            offset += size
        data, origin = b"".join(out), np.concatenate(origin) if origin else np.empty(0, np.int64)
        end = offset
        if self.squeeze:
            # Leading space is gone already; of trailing space the end moves to where it begins.
            kept = len(data.rstrip(b" "))
            end = int(origin[kept]) if kept < len(data) else end
            data, origin = data[:kept], origin[:kept]
        if not data:
            return "", np.array([0])
        first = origin[0] if self.squeeze else 0
        if self.mark_space:
            width = np.where(np.frombuffer(data, np.uint8) == 32, _SPACE_BYTES, 1)
            origin, data = np.repeat(origin, width), data.replace(b" ", SPACE.encode())
        mark = (SPACE if self.mark_space else " ") if pad else ""
        return mark + data.decode(), np.r_[np.full(pad, first), origin, end]


def _char_starts(raw: bytes) -> np.ndarray:
    """For each byte the offset of the character it belongs to."""
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    return np.flatnonzero(lead)[np.cumsum(lead) - 1] if len(raw) else np.empty(0, np.int64)


class Codec:
    """Encodes and decodes with a model file."""

    def __init__(self, model: bytes):
        spec: dict[int, int | bytes] = {}
        kinds, user = [], set()
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                kinds.append(piece.get(3, _NORMAL))
                if kinds[-1] == _USER_DEFINED:
                    user.add(piece[1].decode())
            elif field == 3:
                spec |= dict(_fields(value))
        self.normalize = Normalizer(
            character_map(spec.get(2, b"")), frozenset(user),
            *[bool(spec.get(field, 1)) for field in (3, 4, 5)],
        )
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        # Later fields of a message override earlier ones: no map, no added, squeezed or marked space.
        self._plain = sentencepiece.SentencePieceProcessor(model_proto=model + b"\x1a\x08\x12\x00\x18\x00\x20\x00\x28\x00")
        pieces = [self.library.id_to_piece(i).encode() for i in range(len(kinds))]
        self.sizes = np.array([1 if k == _BYTE else 0 if k == _UNKNOWN else len(p) for p, k in zip(pieces, kinds)])
        self._unknown = [i for i, k in enumerate(kinds) if k == _UNKNOWN]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the start and end of the source bytes of each."""
        normal, origin = self.normalize(text)
        ids = np.array(self._plain.encode(normal), np.int32)
        sizes = self.sizes[ids]
        if np.isin(ids, self._unknown).any():  # their length is not in the model
            sizes = np.array([len(p.encode()) if s == 0 else s for p, s in zip(self._plain.encode(normal, out_type=str), sizes)])
        ends = np.cumsum(sizes)
        if (ends[-1] if len(ends) else 0) != len(origin) - 1:
            raise ValueError("the pieces do not cover the normalised text")
        return ids, origin[ends - sizes].astype(np.int32), origin[ends].astype(np.int32)

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=4)
def _codec(path: str) -> Codec:
    return Codec(Path(path).read_bytes())


# --- column functions ---------------------------------------------------------------------------------


_ROWS_AT_ONCE = 1000


def encode_rows(
    documents: DataFrame, path: str, kept: Sequence[str] = ("doc_id",), text: str = "text", decode: bool = False
) -> DataFrame:
    """The *kept* columns with ``ids``, ``starts`` and ``ends`` of each text, and ``decoded`` if asked for.

    As :func:`encoded`, but results are handed on in small runs of rows, so a task holds little at once.
    """
    lists = [T.StructField(name, T.ArrayType(T.IntegerType())) for name in ("ids", "starts", "ends")]
    decoded_field = [T.StructField("decoded", T.StringType())] if decode else []
    given = documents.select(*kept, F.col(text).alias("_text"))
    schema = T.StructType([*given.schema.fields[:-1], *lists, *decoded_field])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS_AT_ONCE):
                part = batch.slice(start, _ROWS_AT_ONCE)
                found = [codec.encode((t.as_py() or "").encode("utf-8", "replace").decode()) for t in part.columns[-1]]
                columns = [*part.columns[:-1], *[_lists([f[i] for f in found]) for i in range(3)]]
                if decode:
                    columns.append(pa.array([codec.decode(f[0].tolist()) for f in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return given.mapInArrow(rows, schema)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def _udf(path: str, kind: str, with_text: bool) -> Callable[[Column], Column]:
    @F.arrow_udf(kind)
    def encoded(batch: pa.Array) -> pa.Array:
        codec = _codec(path)
        found = [codec.encode((t.as_py() or "").encode("utf-8", "replace").decode()) for t in batch]
        columns = [_lists([f[i] for f in found]) for i in range(3)]
        names = ["ids", "starts", "ends"]
        if with_text:
            columns.append(pa.array([codec.decode(f[0].tolist()) for f in found], pa.string()))
            names.append("decoded")
        return pa.StructArray.from_arrays(columns, names)

    return encoded


_ENCODED = "ids:array<int>,starts:array<int>,ends:array<int>"


def encoded(text: Column, path: str) -> Column:
    """``struct<ids, starts, ends>``; the model file at *path* must be there on every worker."""
    return _udf(path, f"struct<{_ENCODED}>", False)(text)


def round_trip(text: Column, path: str) -> Column:
    """As :func:`encoded`, with the text ``decoded`` from the ids, in one pass."""
    return _udf(path, f"struct<{_ENCODED},decoded:string>", True)(text)


def decoded(ids: Column, path: str) -> Column:
    """The text of an array of ids; null ids give null."""

    @F.arrow_udf("string")
    def text(batch: pa.Array) -> pa.Array:
        codec = _codec(path)
        return pa.array([None if ids is None else codec.decode(ids) for ids in batch.to_pylist()], pa.string())

    return text(ids)

"""The per-base work of the sources: letters of texts kept, and places that patterns match, on whole Arrow batches in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text that are worked on at once.
BLOCK = 1 << 20
_BASES = np.zeros(256, bool)
_BASES[list(b"acgtACGT")] = True
_UPPER = np.frombuffer(bytes(range(256)).upper(), np.uint8)
_PART = re.compile(r"(\[[A-Z]-[A-Z]\]|\[[A-Z]+\]|[A-Z])(?:\{(\d+)\})?")

#: What a pattern is made of: (offset, how many, which letters).
Runs = list[tuple[int, int, np.ndarray]]


def runs(pattern: str, length: int) -> list[Runs] | None:
    """The alternatives of a pattern of letters, classes and counts, each of the given length; None if it has another form."""
    out = []
    for one in pattern.split("|"):
        if not re.fullmatch(f"(?:{_PART.pattern})*", one):
            return None
        parts: Runs = []
        at = 0
        for letters, count in _PART.findall(one):
            known, n = np.zeros(256, bool), int(count or 1)
            inner = letters.strip("[]")
            known[range(ord(inner[0]), ord(inner[2]) + 1) if "-" in inner else list(inner.encode())] = True
            if n:
                parts.append((at, n, known))
            at += n
        if at != length or not length:
            return None
        out.append(parts)
    return out


def _bytes(column: pa.Array, ascii_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of strings; null is empty. ascii_only: a byte a character, others than ASCII as question marks."""
    column = column.fill_null("").cast(pa.string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    if ascii_only and (held >= 128).any():
        return _bytes(pa.array([x.encode("ascii", "replace").decode() for x in column.to_pylist()], pa.string()))
    return (at - at[0]).astype(np.int64), held


def _strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings that end at these places of the bytes, one after another."""
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about BLOCK bytes of a column each, one row at least."""
    sizes = np.cumsum(np.diff(_bytes(batch.column(column))[0]))
    at = 0
    while at < len(batch):
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + BLOCK, side="right")))
        yield batch.slice(at, end - at)
        at = end


def bases(rows: DataFrame, id_col: str, text_col: str, shortest: int) -> DataFrame:
    """(seq_id, seq): the letters a, c, g and t of the texts in upper case, where they are so many at least."""
    held = rows.select(rows[id_col].alias("seq_id"), rows[text_col].alias("seq"))
    schema = T.StructType([held.schema["seq_id"], T.StructField("seq", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch, "seq"):
                at, data = _bytes(part.column("seq"))
                kept = _BASES[data]
                ends = np.concatenate([[0], np.cumsum(kept)])[at[1:]]
                found = pa.RecordBatch.from_arrays([part.column("seq_id"), _strings(_UPPER[data[kept]], ends)], ["seq_id", "seq"])
                sizes = np.diff(ends, prepend=0)
                nulls = part.column("seq").is_null().to_numpy(zero_copy_only=False)
                yield found.filter(pa.array((sizes >= shortest) & ~nulls))

    return held.mapInArrow(run, schema)


def _places(data: np.ndarray, length: int, alternatives: list[Runs]) -> np.ndarray:
    """Where stretches of the bytes match, in order. Short runs are compared everywhere, long ones where these match."""
    room, found = len(data) - length + 1, []
    if room <= 0:
        return np.zeros(0, np.int64)
    for parts in alternatives:
        there = None
        for at, n, known in sorted(parts, key=lambda p: p[2].sum()):
            if n < 4 and not known[65:91].all():
                for k in range(at, at + n):
                    fits = known[data[k : k + room]]
                    there = fits if there is None else there & fits
        places = np.arange(room) if there is None else np.flatnonzero(there)
        for at, n, known in parts:
            if n >= 4 or known[65:91].all():
                wrong = np.concatenate([[0], np.cumsum(~known[data], dtype=np.int32)])
                places = places[wrong[places + at + n] == wrong[places + at]]
        found.append(places)
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def places(chunks: DataFrame, wanted: list[tuple[int, list[Runs]]]) -> DataFrame:
    """(seq_id, pos, window, which) of chunks (seq_id, chunk_start, own, chunk): stretches that begin in a chunk's own bases and match.

    A chunk may be a whole contig: long ones are worked on BLOCK bases at a time.
    """
    schema = T.StructType([chunks.schema["seq_id"], T.StructField("pos", T.LongType()), T.StructField("window", T.StringType()), T.StructField("which", T.IntegerType())])
    names, longest = schema.names, max(length for length, _ in wanted)

    def found_in(ids: pa.Array, at: np.ndarray, data: np.ndarray, start: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k, (length, alternatives) in enumerate(wanted):
            found = _places(data, length, alternatives)
            row = np.searchsorted(at, found, side="right") - 1
            inner = found - at[row]
            kept = (inner < own[row]) & (found + length <= at[row + 1])
            found, row, inner = found[kept], row[kept], inner[kept]
            text = _strings(data[found[:, None] + np.arange(length)].ravel(), np.arange(1, len(found) + 1) * length)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(start[row] + inner), text, pa.array(np.full(len(found), k, np.int32))], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch, "chunk"):
                at, data = _bytes(part.column("chunk"), ascii_only=True)
                ids, start, own = part.column("seq_id"), part.column("chunk_start").to_numpy(), part.column("own").to_numpy().astype(np.int64)
                if len(part) > 1 or own[0] <= BLOCK:
                    yield from found_in(ids, at, data, start, own)
                    continue
                for first in range(0, int(own[0]), BLOCK):
                    stretch = data[first : first + BLOCK + longest - 1]
                    yield from found_in(ids, np.array([0, len(stretch)]), stretch, start + first, np.minimum(own - first, BLOCK))

    return chunks.select("seq_id", "chunk_start", "own", "chunk").mapInArrow(run, schema)

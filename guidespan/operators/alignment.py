"""Gapped global alignment of guides and targets, with its operations as text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guidespan.functions import seq as S
from guidespan.sources.scan import _bytes, _strings

MISMATCH, GAP = 2, 3
#: Pairs that are aligned together in numpy.
BATCH = 4096
#: Cost, gaps and mismatches as one number, which has their order: what a mismatch and what a gap adds.
_BAD, _SKIP = MISMATCH << 32 | 1, GAP << 32 | 1 << 16
_FAR = np.int64(1 << 60)
_OPS = np.frombuffer(b"MXID", np.uint8)


def align(query: str, target: str, most_gaps: int) -> tuple[int, int, int, str] | None:
    """(mismatches, bases of the query without partner, bases of the target without partner, operations), or None beyond the gaps.

    The least cost wins; then fewer gaps, fewer mismatches; then, read from the end, a pairing before a query base alone before a
    target base alone. Operations are run-length coded: M equal, X different, I query base alone, D target base alone.
    """
    n, m = len(query), len(target)
    if abs(n - m) > most_gaps:
        return None
    row: dict[int, tuple] = {}
    rows = []
    for i in range(n + 1):
        now: dict[int, tuple] = {}
        for j in range(max(0, i - most_gaps), min(m, i + most_gaps) + 1):
            options = []
            if i and j and j - 1 in row:
                c, g, x, *_ = row[j - 1]
                bad = query[i - 1] != target[j - 1]
                options.append((c + MISMATCH * bad, g, x + bad, 0, "X" if bad else "M"))
            if i and j in row:
                c, g, x, *_ = row[j]
                options.append((c + GAP, g + 1, x, 1, "I"))
            if j and j - 1 in now:
                c, g, x, *_ = now[j - 1]
                options.append((c + GAP, g + 1, x, 2, "D"))
            now[j] = min(options, default=(0, 0, 0, 0, ""))
        rows.append(now)
        row = now
    i, j, ops = n, m, []
    while i or j:
        op = rows[i][j][4]
        ops.append(op)
        i, j = i - (op != "D"), j - (op != "I")
    ops.reverse()
    if ops.count("I") + ops.count("D") > most_gaps:
        return None
    runs: list[list] = []
    for op in ops:
        if runs and runs[-1][1] == op:
            runs[-1][0] += 1
        else:
            runs.append([1, op])
    return ops.count("X"), ops.count("I"), ops.count("D"), "".join(f"{k}{op}" for k, op in runs)


def strings(query: str, target: str, cigar: str) -> tuple[str, str]:
    """Query and target as the operations align them, with dashes for bases that are missing."""
    i = j = 0
    a, b = [], []
    for n, op in re.findall(r"([0-9]+)([MXID])", cigar):
        k = int(n)
        a.append("-" * k if op == "D" else query[i : i + k])
        b.append("-" * k if op == "I" else target[j : j + k])
        i, j = i + k * (op != "D"), j + k * (op != "I")
    return "".join(a), "".join(b)


def _letters(column: pa.Array, width: int, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """(the letters of some texts, a row each, padded to the width; their lengths)."""
    at, data = _bytes(column, ascii_only=True)
    size = np.diff(at)
    inside = np.arange(width) < size[:, None]
    out = np.full(inside.shape, blank, np.uint8)
    out[inside] = data[(at[:-1, None] + np.arange(width))[inside]]
    return out, size


def fill(query: np.ndarray, target: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of cost, gaps and mismatches of the whole query with each beginning of the target, operations) of rows of letters.

    Only cells near the diagonal are filled: the first axis of the numbers, the second of the operations, is how many bases of the target
    are used more than of the query, from -band on. Of each cell: pairing, then a query base alone, then a target base alone, for all pairs.
    """
    (size, n), m = query.shape, target.shape[1]
    own, other = np.ascontiguousarray(query.T), np.ascontiguousarray(target.T)
    now = np.full((2 * band + 1, size), _FAR)
    ops = np.full((n + 1, 2 * band + 1, size), 3, np.uint8)
    for k in range(band, min(2 * band, m + band) + 1):
        now[k] = (k - band) * _SKIP
    for i in range(1, n + 1):
        before, now = now, np.full((2 * band + 1, size), _FAR)
        for k in range(max(0, band - i), min(2 * band, m - i + band) + 1):
            j, best, op = i + k - band, now[k], ops[i, k]
            if j:
                bad = own[i - 1] != other[j - 1]
                best[:] = before[k] + bad * _BAD
                op[:] = bad
            if k < 2 * band:
                skip = before[k + 1] + _SKIP
                op[skip < best] = 2
                np.minimum(best, skip, out=best)
            if k:
                skip = now[k - 1] + _SKIP
                op[skip < best] = 3
                np.minimum(best, skip, out=best)
    return now, ops


def trace(query: np.ndarray, target: np.ndarray, ops: np.ndarray, end: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(operations run-length coded, aligned query, aligned target) of pairs, from the whole query and target[:end] backwards."""
    (size, n), m, band, held = query.shape, target.shape[1], ops.shape[1] // 2, []
    if not size or n + end.max() == 0:
        return (pa.array([""] * size, pa.string()),) * 3
    rows, i, j = np.arange(size), np.full(size, n), end.copy()
    cells, own, other = ops.ravel(), query.ravel() if n else _OPS, target.ravel() if m else _OPS
    while (live := (i > 0) | (j > 0)).any():
        # Where both ends are reached, the cell is the first one, whose step is ignored.
        op = cells.take((i * (2 * band + 1) + j - i + band) * size + rows)
        there, here = live & (op != 3), live & (op != 2)
        drawn = np.zeros((3, size), np.uint8)
        drawn[0] = _OPS[op] * live
        for row, taken, letters in ((1, there, own.take(rows * n + i - 1, mode="clip")), (2, here, other.take(rows * m + j - 1, mode="clip"))):
            drawn[row] = np.where(taken, letters, np.uint8(45)) * live
        held.append(drawn)
        i, j = i - there, j - here
    drawn = np.ascontiguousarray(np.stack(held[::-1]).transpose(1, 2, 0))
    kept = drawn[0] != 0
    codes = [_cigar(x) for x in drawn[0].view(f"S{drawn.shape[2]}").ravel().tolist()]
    return pa.array(codes, pa.string()), *(_strings(x[kept], np.cumsum(kept.sum(axis=1))) for x in drawn[1:])


@lru_cache(1 << 16)
def _cigar(ops: bytes) -> str:
    return "".join(f"{len(r[0])}{r[1]}" for r in re.finditer(r"(.)\1*", ops.lstrip(b"\0").decode()))


def _band(most_mismatches: int, most_gaps: int) -> int:
    """How far the cheapest alignment may leave the diagonal, if it is within both budgets or cheaper than all that are."""
    return (most_gaps + (MISMATCH * most_mismatches + GAP * most_gaps) // GAP) // 2


def _parts(number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cost, gaps, mismatches)."""
    return number >> 32, number >> 16 & 0xFFFF, number & 0xFFFF


def _drawn(query: np.ndarray, target: np.ndarray, ops: np.ndarray, end: np.ndarray, number: np.ndarray) -> list[pa.Array]:
    """Mismatches, query bases alone, target bases alone, operations, aligned query, aligned target."""
    _, gaps, bad = _parts(number)
    more = end - query.shape[1]
    counts = [pa.array(x.astype(np.int32)) for x in (bad, (gaps - more) // 2, (gaps + more) // 2)]
    return [*counts, *trace(query, target, ops, end)]


def _pam_ends(window: np.ndarray, pam: str) -> np.ndarray:
    """Whether the PAM stands behind each end of a target in a window."""
    size, width = window.shape
    out = np.ones((size, width + 1), bool)
    for k, base in enumerate(pam):
        fits = np.zeros(256, bool)
        fits[[ord(b) for b in "ACGT" if re.fullmatch(S.pattern(base), b)]] = True
        there = np.zeros((size, width + 1), bool)
        if width > k:
            there[:, : width - k] = fits[window[:, k:]]
        out &= there
    return out


def _near(query: np.ndarray, window: np.ndarray, length: np.ndarray, centre: np.ndarray, most_mismatches: int, most_gaps: int, pam: str | None) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """What ``best_in_windows`` says of rows of letters: (rows, columns) of those that align, a shift of the start at a time."""
    (size, n), width, band = query.shape, window.shape[1], _band(most_mismatches, most_gaps)
    centre = np.clip(centre, 0, np.maximum(length - n, 0))
    follows = _pam_ends(window, pam) if pam else None
    rows, best, held = np.arange(size), np.full(size, 1 << 62, np.int64), {}
    at, number = np.zeros((2, size), np.int64), np.zeros(size, np.int64)
    for shift in range(-most_gaps, most_gaps + 1):
        start = centre + shift
        target = window[rows[:, None], np.maximum(start, 0)[:, None] + np.arange(n + most_gaps)]
        numbers, ops = fill(query, target, band)
        held[shift] = target, ops
        for j in range(max(1, n - most_gaps), n + most_gaps + 1):
            own = numbers[j - n + band]
            cost, gaps, bad = _parts(own)
            ok = (start >= 0) & (start + j <= length) & (gaps <= most_gaps) & (bad <= most_mismatches) & (own < _FAR)
            if follows is not None:
                ok &= follows[rows, np.clip(start + j, 0, width)]
            # Of equal keys the first start and end come first, as the loops run; the distance from the centre comes before.
            key = (((cost << 10 | bad) << 10 | gaps) << 10 | abs(j - n)) << 10 | np.abs(start - centre)
            key = (key << 8 | shift + most_gaps) << 8 | j
            better = ok & (key < best)
            best[better], number[better] = key[better], own[better]
            at[:, better] = [[shift], [j]]
    for shift, (target, ops) in held.items():
        own = np.flatnonzero((best < 1 << 62) & (at[0] == shift))
        if len(own):
            start, end = centre[own] + shift, at[1, own]
            yield own, [*(pa.array(x.astype(np.int32)) for x in (start, start + end)), *_drawn(query[own], target[own], ops[:, :, own], end, number[own])]


def best_in_windows(queries: list[str], windows: list[str], centres: list[int], most_mismatches: int, most_gaps: int, pam: str | None = None) -> list[tuple | None]:
    """For queries of one length the best alignment near a centre of their windows: (start, end, mismatches, query bases alone, target bases
    alone, operations, aligned query, aligned target), or None.

    Both ends are free: starts within ``most_gaps`` of the centre, lengths within ``most_gaps`` of the query's. A stretch stands for its
    cheapest alignment, and is left out if that is beyond a budget or no ``pam`` follows. Then the least cost wins, fewer mismatches,
    fewer gaps, a length nearer the query's, a start nearer the centre, the first start, the first end.
    """
    out: list[tuple | None] = [None] * len(queries)
    n = len(queries[0])
    query, _ = _letters(pa.array(queries, pa.string()), n, 0)
    window, length = _letters(pa.array(windows, pa.string()), max(map(len, windows)) + n + 2 * most_gaps + 1, 1)
    for rows, columns in _near(query, window, length, np.array(centres), most_mismatches, most_gaps, pam):
        for k, *found in zip(rows.tolist(), *(c.to_pylist() for c in columns), strict=True):
            out[k] = tuple(found)
    return out


_COUNTS, _TEXTS = ("mismatch", "rna_bulges", "dna_bulges"), ("cigar", "aligned_guide", "aligned_target")


def _schema(rows: DataFrame, *places: str) -> T.StructType:
    return T.StructType([*rows.schema.fields, *(T.StructField(c, T.IntegerType()) for c in (*places, *_COUNTS)), *(T.StructField(c, T.StringType()) for c in _TEXTS)])


def _by_guide(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of guides of one length, BATCH at most, and the letters of their guides."""
    for batch in batches:
        size = pc.utf8_length(batch.column("guide")).to_numpy(zero_copy_only=False)
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            for at in range(0, len(rows), BATCH):
                part = batch.take(pa.array(rows[at : at + BATCH]))
                yield part, _letters(part.column("guide"), int(n), 0)[0]


def _with(part: pa.RecordBatch, rows: np.ndarray, columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*part.take(pa.array(rows)).columns, *columns], names)


def near_centres(rows: DataFrame, most_mismatches: int, most_gaps: int, pam: str | None = None) -> DataFrame:
    """Rows (guide, window, centre, ...) whose guide aligns near the centre of its window, as ``best_in_windows`` says, with start and
    target_end (in the window), mismatch, rna_bulges, dna_bulges, cigar, aligned_guide and aligned_target.

    Rows of a null or empty guide or window align with nothing; repeated rows stay repeated.
    """
    held = rows.where((F.length("guide") > 0) & (F.length("window") > 0) & F.col("centre").isNotNull())
    schema = _schema(held, "start", "target_end")

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, query in _by_guide(pa.RecordBatch.from_pandas(f, preserve_index=False) for f in frames if len(f)):
            longest = pc.max(pc.utf8_length(part.column("window"))).as_py()
            window, length = _letters(part.column("window"), longest + query.shape[1] + 2 * most_gaps + 1, 1)
            for own, columns in _near(query, window, length, part.column("centre").to_numpy().astype(np.int64), most_mismatches, most_gaps, pam):
                yield _with(part, own, columns, schema.names).to_pandas()

    return held.mapInPandas(run, schema)


def may_align_near(guide: Column, window: Column, n: int, most_mismatches: int) -> Column:
    """Whether a guide of n bases may align with so many mismatches and one gap at most in a window, from its first, second or third base on.

    Both come as numbers of two bits a base, the first lowest, of n + 3 bases for the window. A gap parts the guide in two, of which each
    stands somewhere without gaps: for each number of mismatches before the gap, the longest part that has no more is taken. Letters other
    than ACGT that a number has for A may let a pair pass that does not align; none that does is left out.
    """
    ones = sum(1 << 2 * i for i in range(n))
    differ = {o: (x := guide.bitwiseXOR(F.shiftright(window, 2 * o) if o >= 0 else F.shiftleft(window, -2 * o))).bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(ones)) for o in range(-1, 4)}
    return fewest([(differ[o], differ[o - 1], differ[o + 1]) for o in range(3)], most_mismatches) <= most_mismatches


def from_first(differ: Column) -> Column:
    """All bits from the lowest one that is set on; none if none is."""
    return F.bitwise_not((differ - 1).bitwiseAND(F.bitwise_not(differ)))


def fewest(stretches: list[tuple[Column, Column, Column]], most: int) -> Column:
    """The fewest mismatches with one gap at most, if they are so many at most, of bits where bases differ: as they stand, with a guide's base
    left out from there on, with a target's."""
    counts = []
    for stands, skipped, missed in stretches:
        counts.append(F.bit_count(stands))
        left = stands
        for k in range(most + 1):
            beyond = from_first(left)  # the difference that is one too many
            counts += [F.bit_count(missed.bitwiseAND(beyond)) + k, F.bit_count(skipped.bitwiseAND(F.shiftleft(beyond, 2))) + k]
            left = left.bitwiseAND(left - 1)
    # Terms share most of their parts. Spark works these out once in a column, but anew for each term in a filter, where it puts all that
    # is the same in every task: so the partition's number is part of it.
    return F.least(*counts) + F.spark_partition_id() * 0


def pam_on_columns(aligned_guide: Column, aligned_target: Column, start: int, end: int, pam: str) -> Column:
    """Whether bases [start, end) of the guide, which are its PAM, stand on unbroken columns whose target bases fit ``pam``.

    A gap within these columns, on either side, or a target base alone right before them, is a no; so is a column of two gaps.
    """
    dashed = aligned_guide.contains("-")
    beside = F.length(F.regexp_extract(aligned_guide, f"^(?:-*[^-]){{{start + 1}}}", 0))
    first, size = F.nullif(F.when(dashed, beside).when(F.length(aligned_guide) > start, start + 1), F.lit(0)), end - start
    own, other = F.substring(aligned_guide, first, F.lit(size)), F.substring(aligned_target, first, F.lit(size))
    before = (first == 1) | (F.substring(aligned_guide, first - 1, F.lit(1)) != "-")
    # Most rows have a gap on one side at most, and need no look at every column.
    twice = F.exists(F.sequence(F.lit(1), F.length(aligned_guide)), lambda i: (F.substring(aligned_guide, i, F.lit(1)) == "-") & (F.substring(aligned_target, i, F.lit(1)) == "-"))
    both = F.when(dashed & aligned_target.contains("-"), twice).otherwise(False)
    fits = (F.length(own) == size) & ~own.contains("-") & other.rlike(f"^{S.pattern(pam)}$") & before & ~both
    return F.coalesce((F.length(aligned_guide) == F.length(aligned_target)) & fits, F.lit(False))


def places_of_columns(aligned_target: Column, column: Column, start: Column, target_end: Column, strand: Column) -> Column:
    """The contig place of the target base on a column (from 1) of an alignment; null on a gap. Places count on the plus strand."""
    before = F.length(F.translate(F.substring(aligned_target, F.lit(1), column - 1), "-", ""))
    place = F.when(strand == "+", start + before).otherwise(target_end - 1 - before)
    return F.when(F.substring(aligned_target, column, F.lit(1)) != "-", place)


def aligned(pairs: DataFrame, most_mismatches: int, most_gaps: int) -> DataFrame:
    """Pairs (guide, target, ...) that align within the budgets, with mismatch, rna_bulges, dna_bulges, cigar and aligned strings.

    Pairs with more edits than both budgets together are left out in the JVM; only near ones come to Python. Nulls align with nothing.
    """
    pairs = pairs.where(F.levenshtein("guide", "target", most_mismatches + most_gaps) >= 0)
    schema = _schema(pairs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, query in _by_guide(batches):
            n = query.shape[1]
            target, size = _letters(part.column("target"), n + most_gaps, 1)
            numbers, ops = fill(query, target, most_gaps)
            near = np.flatnonzero(np.abs(size - n) <= most_gaps)
            number = numbers[size[near] - n + most_gaps, near]
            _, gaps, bad = _parts(number)
            kept = (gaps <= most_gaps) & (bad <= most_mismatches) & (number < _FAR)
            own = near[kept]
            yield _with(part, own, _drawn(query[own], target[own], ops[:, :, own], size[own], number[kept]), schema.names)

    return pairs.mapInArrow(run, schema)


def best_ends(pairs: DataFrame, text: str, most_mismatches: int, most_gaps: int, last: bool) -> DataFrame:
    """Pairs whose guide aligns within the budgets with one of the last (or first) stretches of a text, of its length give or take the gaps:
    target, the best of these, mismatch, rna_bulges, dna_bulges, cigar and aligned strings.

    A stretch stands for its cheapest alignment, and is none if it holds N. Then the least cost wins, fewer mismatches, fewer gaps, a length
    nearer the guide's, the shorter one. Nulls align with nothing.
    """
    held = pairs.where((F.length("guide") > 0) & F.col(text).isNotNull()).withColumn("target", F.lit(""))
    schema = _schema(held)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, query in _by_guide(batches):
            (size, n), longest = query.shape, pc.max(pc.utf8_length(part.column(text))).as_py()
            letters, length = _letters(part.column(text), max(longest, n + most_gaps), 1)
            best, number, at = np.full(size, 1 << 62, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
            held, rows = {}, np.arange(size)
            for j in range(max(1, n - most_gaps), n + most_gaps + 1):
                begin = np.maximum(length - j, 0) if last else np.zeros(size, np.int64)
                target = letters[rows[:, None], begin[:, None] + np.arange(j)]
                numbers, ops = fill(query, target, most_gaps)
                held[j] = target, ops
                own = numbers[j - n + most_gaps]
                cost, gaps, bad = _parts(own)
                ok = (length >= j) & ~(target == 78).any(axis=1) & (gaps <= most_gaps) & (bad <= most_mismatches) & (own < _FAR)
                key = (((cost << 10 | bad) << 10 | gaps) << 10 | abs(j - n)) << 10 | j
                better = ok & (key < best)
                best[better], number[better], at[better] = key[better], own[better], j
            for j, (target, ops) in held.items():
                own = np.flatnonzero((best < 1 << 62) & (at == j))
                if len(own):
                    columns = _drawn(query[own], target[own], ops[:, :, own], at[own], number[own])
                    texts = _strings(target[own].ravel(), np.arange(1, len(own) + 1) * j)
                    yield _with(part.drop_columns(["target"]), own, [texts, *columns], schema.names)

    return held.mapInArrow(run, schema)

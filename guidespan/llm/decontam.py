"""Benchmark decontamination by q-gram lemma filtering.

Items and documents are compared in lower case with single spaces. An item is cut in overlapping windows (a short one is one
window); a window with at most e edits shares at least L - q + 1 - e q of its q-grams with the place in the document where it
stands, all within e diagonals. So a worker looks up the document's q-grams in the items' index, counts the hits of each window in
overlapping bands of diagonals, keeps the bands that reach the bound, and verifies those by banded alignment. What has no q-gram
count to filter by (windows shorter than q) is looked for literally.

Benchmarks repeat lines (a preamble that all items share). Equal windows are therefore one, with a list of their items, and q-grams
are looked up in equal blocks of the items, which are one too: the hits of a block are counted once and then added to the windows
that hold it. A long text is taken in slices of bounded work, and a stretch of text that was compared with a window before is not
compared again.

So a document counts as contaminated if it holds a window of an item within the window's edits: any stretch of WINDOW + STRIDE - 1
characters of an item, letter by letter, is found, wherever it starts, and every item that is no longer than a window.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guidespan.llm.common import append, fresh, pieces, written

Q = 9
#: Characters of a window, from one window's start to the next, and the edits allowed in one, as a share of its length.
WINDOW, STRIDE, EDITS = 64, 16, 0.08
#: Half the width of a band of diagonals; no window may have more edits.
HALF = 8
#: Hits are looked up in slices that add so many windows at most (or reach over so many places, the longest that a window and its band
#: take); compared stretches that a worker remembers.
COST, REACH, SEEN = 1 << 22, WINDOW + STRIDE + Q + 4 * HALF, 1 << 22
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Characters of items that are sent to the workers at once: each worker's index takes about 40 bytes a character. A larger benchmark
#: is taken in several passes.
PASS_CHARS = 4 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(c: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the q-gram at each place."""
    n = len(c) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(Q):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += c[i : i + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xC2B2AE3D27D4EB4F)
    return out


def budget(length: int) -> tuple[int, int]:
    """(edits allowed, q-grams that must be shared) of a window."""
    e = min(int(length * EDITS), HALF)
    while e and length - Q + 1 - e * Q < 1:
        e -= 1
    return e, length - Q + 1 - e * Q


def ranges(first: np.ndarray, times: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (times[0] of them), first[1], ... in one array."""
    return np.repeat(first - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))


class Index:
    """The q-grams of some items. Items are named by their number in the order of their ids."""

    def __init__(self, items: tuple[tuple[int, str], ...]):
        held = sorted({(item, t) for item, text in items if (t := normal(text))})
        self.short = [(item, t) for item, t in held if len(t) < Q]
        blocks: dict[bytes, int] = {}
        windows: dict[bytes, int] = {}
        owners: list[tuple[int, int, int]] = []  # (window, item, start)
        members: list[tuple[int, int, int]] = []  # (block, window, start of the block less that of the window)
        for item, text in held:
            if len(text) < Q:
                continue
            data = codes(text).tobytes()
            width = min(len(text), WINDOW)
            last = len(text) - width
            for begin in sorted({*range(0, last, STRIDE), last}):
                window = data[4 * begin : 4 * (begin + width)]
                if (number := windows.get(window)) is None:
                    number = windows[window] = len(windows)
                    # A block may reach beyond the window: more is counted than the window holds, never less.
                    for at in range(begin // STRIDE * STRIDE, begin + width - Q + 1, STRIDE):
                        block = blocks.setdefault(data[4 * at : 4 * (at + STRIDE + Q - 1)], len(blocks))
                        members.append((block, number, at - begin))
                owners.append((number, item, begin))
        owners.sort()
        self.items = np.array([x[1] for x in owners], np.int64)
        self.starts = np.array([x[2] for x in owners], np.int64)
        self.owned = np.searchsorted([x[0] for x in owners], np.arange(len(windows) + 1)) if owners else np.zeros(1, np.int64)
        members.sort()
        self.window = np.array([x[1] for x in members], np.int64)
        self.offset = np.array([x[2] for x in members], np.int64)
        self.held = np.searchsorted([x[0] for x in members], np.arange(len(blocks) + 1)) if members else np.zeros(1, np.int64)
        self.width = np.array([len(w) // 4 for w in windows], np.int64)
        self.letters = np.zeros((len(windows), WINDOW), np.uint32)
        for k, w in enumerate(windows):
            self.letters[k, : len(w) // 4] = np.frombuffer(w, np.uint32)
        self.edits, self.bound = (np.array(x, np.int64) for x in zip(*(budget(int(w)) for w in self.width), strict=True)) if windows else (np.zeros(0, np.int64),) * 2
        g = [grams(np.frombuffer(b, np.uint32)) for b in blocks]
        gram = np.concatenate(g) if g else np.zeros(0, np.uint64)
        order = np.argsort(gram, kind="stable")
        self.gram, self.first = np.unique(gram[order], return_index=True)
        self.end = np.append(self.first[1:], len(gram))
        self.block = np.repeat(np.arange(len(g), dtype=np.int32), [len(x) for x in g])[order]
        self.place = (np.concatenate([np.arange(len(x), dtype=np.int32) for x in g]) if g else np.zeros(0, np.int32))[order]
        #: What a hit of a q-gram costs at most: the windows that hold its blocks.
        cost = np.concatenate([[0], np.cumsum(np.diff(self.held)[self.block])]) if len(gram) else np.zeros(1, np.int64)
        self.cost = cost[self.end] - cost[self.first] + self.end - self.first if len(gram) else np.zeros(0, np.int64)
        self.bits = max(16, min(24, int(len(self.gram) * 16).bit_length()))
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[self.gram >> np.uint64(64 - self.bits)] = True

    def hits(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in c, number of the q-gram) of the q-grams of c that the items hold."""
        h = grams(c)
        at = np.nonzero(self.maybe[h >> np.uint64(64 - self.bits)])[0] if len(h) and len(self.gram) else np.zeros(0, np.int64)
        if not len(at):
            return at, at
        k = np.searchsorted(self.gram, h[at])
        k[k == len(self.gram)] = 0
        same = self.gram[k] == h[at]
        return at[same], k[same]

    def slices(self, at: np.ndarray, k: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of hits of bounded cost. They overlap, so that all hits of a window are in one of them."""
        out, done = [], np.cumsum(self.cost[k])
        i = 0
        while i < len(at):
            before = done[i - 1] if i else 0
            j = max(int(np.searchsorted(done, before + COST)), int(np.searchsorted(at, at[i] + REACH)))
            out.append((i, int(np.searchsorted(at, at[j] + REACH)) if j < len(at) else len(at)))
            i = j
        return out

    def candidates(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first diagonal of the band) of the bands that share enough q-grams, from hits (place, q-gram).

        A diagonal is the place of a window's first letter in the text if it stands there unchanged.
        """
        times = self.end[k] - self.first[k]
        posting = ranges(self.first[k], times)
        block, begin = self.block[posting].astype(np.int64), np.repeat(at, times) - self.place[posting]
        low = int(begin.min())
        key, n = np.unique((block << 32) | (begin - low), return_counts=True)
        block, begin = key >> 32, (key & ((1 << 32) - 1)) + low
        times = self.held[block + 1] - self.held[block]
        member = ranges(self.held[block], times)
        window, diagonal, n = self.window[member], np.repeat(begin, times) - self.offset[member], np.repeat(n, times)
        least, out = int(diagonal.min()), []
        for shift in (0, HALF):
            key = (window << 32) | (diagonal - least + shift) // (2 * HALF)
            order = np.argsort(key, kind="stable")
            edge = np.nonzero(np.diff(key[order], prepend=-1))[0]
            key, total = key[order][edge], np.add.reduceat(n[order], edge)
            enough = total >= self.bound[key >> 32]
            out.append((key[enough] >> 32, (key[enough] & ((1 << 32) - 1)) * 2 * HALF - shift + least))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def distance(self, c: np.ndarray, window: np.ndarray, diagonal: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least edits between each window and a stretch of c[lo:hi] in the band, or a little beside it."""
        out = np.zeros(len(window), np.int64)
        width = 4 * HALF
        steps = np.arange(width)
        for length in np.unique(self.width[window]):
            own = np.nonzero(self.width[window] == length)[0]
            for part in (own[i : i + 4096] for i in range(0, len(own), 4096)):
                pattern = self.letters[window[part], :length]
                place = diagonal[part, None] - HALF + steps
                now = np.zeros((len(part), width), np.int32)
                for j in range(length):
                    at = place + j
                    inside = (at >= lo[part, None]) & (at < hi[part, None])
                    differ = ~inside | (c[np.clip(at, 0, len(c) - 1)] != pattern[:, j, None])
                    new = now + differ
                    np.minimum(new[:, :-1], now[:, 1:] + 1, out=new[:, :-1])
                    now = np.minimum.accumulate(new - steps, axis=1) + steps
                out[part] = now.min(axis=1)
        return out

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text the best match (edits, item, start, end in the normal text) of each item in it."""
        best: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        normals = [normal(t) for t in texts]
        parts = [codes(t) for t in normals]
        # No window reaches from one text into the next.
        gap = np.zeros(REACH, np.uint32)
        c = np.concatenate([x for p in parts for x in (p, gap)]) if parts else gap
        ends = np.cumsum([len(p) + REACH for p in parts])
        starts = ends - [len(p) + REACH for p in parts]
        # A hash of what stands before each place, from which that of any stretch follows.
        power = np.cumprod(np.full(len(c) + 1, _BASE, np.uint64))
        before = np.append(np.uint64(0), np.cumsum((c.astype(np.uint64) + np.uint64(1)) * power[:-1]))
        at, k = self.hits(c)
        seen = np.zeros(0, np.uint64)
        for i, j in self.slices(at, k):
            window, diagonal = self.candidates(at[i:j], k[i:j])
            if not len(window):
                continue
            length = self.width[window]
            middle = np.clip(diagonal + HALF + length // 2, 0, len(c) - 1)
            doc = np.searchsorted(ends, middle, side="right")
            lo, hi = starts[doc], ends[doc] - REACH
            left, right = np.clip(diagonal - HALF, lo, hi), np.clip(diagonal + 3 * HALF + length, lo, hi)
            # Equal stretches at other places have other powers: one more product makes them equal.
            stretch = (before[right] - before[left]) * power[len(c) - left]
            stretch = stretch * _BASE + (left - diagonal).astype(np.uint64)
            stretch = (stretch * _BASE + doc.astype(np.uint64)) * _BASE + window.astype(np.uint64)
            key, one = np.unique(stretch, return_index=True)
            one = one[~np.isin(key, seen, assume_unique=True)]
            seen = np.union1d(seen, stretch[one]) if len(seen) + len(one) < SEEN else stretch[one]
            one.sort()
            window, diagonal, doc = window[one], diagonal[one], doc[one]
            edits = self.distance(c, window, diagonal, lo[one], hi[one])
            for m in np.nonzero(edits <= self.edits[window])[0].tolist():
                w, d = int(window[m]), int(diagonal[m] - starts[doc[m]])
                match, held = (int(edits[m]), max(0, d), d + 2 * HALF + int(self.width[w])), best[doc[m]]
                for item in self.items[self.owned[w] : self.owned[w + 1]].tolist():
                    if item not in held or match < held[item]:
                        held[item] = match
        for item, text in self.short:
            for held, t in zip(best, normals, strict=True):
                if (place := f" {t} ".find(f" {text} ")) >= 0:
                    held[item] = min(held.get(item, (0, place, place + len(text))), (0, place, place + len(text)))
        return [[(e, item, start, end) for item, (e, start, end) in held.items()] for held in best]


@lru_cache(maxsize=2)
def _index(items: tuple[tuple[int, str], ...]) -> Index:
    return Index(items)


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> tuple[DataFrame, int]:
    """The items that can be looked for, and how many passes they take."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    return items, max(1, -(-total // PASS_CHARS))


def _held(items: DataFrame, k: int, passes: int) -> tuple[list, tuple[tuple[int, str], ...]]:
    """The ids of pass k in order, null first, and its items by the number of their id: about PASS_CHARS characters.

    All texts of an id are in one pass, so that it counts once.
    """
    rows = [(r["item"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == k).collect()]
    ids = sorted({i for i, _ in rows}, key=lambda i: (i is not None, i if i is not None else 0))
    number = {i: n for n, i in enumerate(ids)}
    return ids, tuple(sorted((number[i], t) for i, t in rows))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns.

    Null and empty texts hold nothing, so they stay; repeated rows stay or go together; an empty table on either side changes nothing.
    """
    items, passes = _items(benchmark, item_col, item_text_col)
    for k in range(passes):
        sent = docs.sparkSession.sparkContext.broadcast(_held(items, k, passes)[1])
        (name,) = fresh(docs, "found")
        found = append(docs, text_col, [(name, T.BooleanType())], lambda texts, sent=sent: [[bool(f) for f in _index(sent.value).find(texts)]])
        docs = found.where(~F.col(name)).drop(name)
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Return, for every row of docs, id, contaminated, n_items (items found), item_id (of the fewest edits, then the least), edits and
    start (about where, in the lower-case text with single spaces).

    Null and empty texts hold nothing; null and empty items are found nowhere; repeated items count once for each id; items of a null
    id are one item, which item_id then names by null. Ids of items may be of any type that has an order. Repeated rows are rows of
    their own; an empty table on either side finds nothing. Other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema[0].dataType
    id_type = to_arrow_type(kind)
    items, passes = _items(benchmark, item_col, item_text_col)
    item_kind = items.schema[0].dataType
    item_type = to_arrow_type(item_kind)
    # Ids may be null or shared, so where several passes are put together each row has its own key, written once.
    rows = rows.withColumn("_row", F.monotonically_increasing_id()) if passes > 1 else rows.withColumn("_row", F.lit(0).cast("long"))
    rows = written(rows) if passes > 1 else rows

    def one(held: tuple[list, tuple[tuple[int, str], ...]]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(held)  # PASS_CHARS characters, about

        def run(batches):
            names, items = sent.value
            index = _index(items)
            for ids, texts, own in pieces(batches):
                found = index.find(texts)
                best = [min(f, default=None) for f in found]
                columns = [pa.array(ids, id_type), pa.array(own, pa.int64()), pa.array([len({m[1] for m in f}) for f in found], pa.int64()), pa.array([b and names[b[1]] for b in best], item_type)]
                columns += [pa.array([b and b[i] for b in best], pa.int64()) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "_row", "n_items", "item_id", "edits", "start"])

        return rows.mapInArrow(run, f"_id {kind.simpleString()}, _row long, n_items long, item_id {item_kind.simpleString()}, edits long, start long")

    out = one(_held(items, 0, passes))
    if passes > 1:
        for k in range(1, passes):
            out = out.unionByName(one(_held(items, k, passes)))
        best = F.min(F.when(F.col("edits").isNotNull(), F.struct("edits", "item_id", "start"))).alias("b")
        out = out.groupBy("_row").agg(F.first("_id").alias("_id"), F.sum("n_items").alias("n_items"), best).select("_id", "n_items", "b.item_id", "b.edits", "b.start")
    return out.select(F.col("_id").alias(id_col), (F.col("n_items") > 0).alias("contaminated"), "n_items", "item_id", "edits", "start")

"""Token counts by byte-pair merging with a heap and a linked list.

The model file gives the pieces and their scores. A segment starts as one symbol a code point; the heap holds the adjacent pairs
that are pieces; the best pair (highest score, leftmost first) is merged, its neighbours form new pairs, until none is left. The
count is the symbols less the merges. No identifiers are made. A symbol that is no piece counts as its UTF-8 bytes.

No piece has a space mark after another character, so no merge crosses from a word into the next space: a text is counted word by
word, and a worker remembers the counts of words it has seen, in a table of bounded size.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guidespan.llm.common import pieces

MARK = "▁"
#: Words of one generation of a worker's memory (it keeps two), and their longest.
MEMORY, LONGEST = 300_000, 64


def _fields(data: bytes):
    """The (number, value) fields of a serialized protocol-buffer message."""
    at = 0

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value, at
            shift += 7

    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def read_model(data: bytes) -> dict[str, float]:
    """The pieces that merges can make, with their scores, from a model file."""
    import struct

    scores, spec = {}, {}
    for number, value in _fields(data):
        if number == 1:  # piece: text 1, score 2, type 3 (1 if absent: normal)
            piece = dict(_fields(value))
            if piece.get(3, 1) == 1:
                scores[piece[1].decode()] = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            elif piece.get(3) == 4:
                raise ValueError("user-defined pieces are not supported")
        elif number == 3:  # normalizer
            spec = dict(_fields(value))
    if spec.get(2) or not spec.get(3, 1) or spec.get(4, 1) or not spec.get(5, 1):
        raise ValueError("only models with identity normalization, a leading space and kept spaces are supported")
    if any(MARK in p.lstrip(MARK) for p in scores):
        raise ValueError("pieces that cross words are not supported")
    return scores


class Merger:
    """Counts tokens with one model. ``scores`` maps a piece to its score; higher scores merge first."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.seen, self.older = scores, {}, {}
        self.inner = {p[i : i + 2] for p in scores for i in range(len(p) - 1)}
        self.words = re.compile(f"{MARK}+[^{MARK}]*")

    def merge(self, segment: str) -> int:
        """Tokens of one segment: initial symbols less merges, plus what symbols that are no piece add as bytes."""
        scores, symbols = self.scores, list(segment)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-scores[p], i, p) for i in range(n - 1) if (p := symbols[i] + symbols[i + 1]) in scores]
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j >= n or symbols[i] + symbols[j] != pair:
                continue  # one of the two has merged meanwhile
            symbols[i], symbols[j] = pair, None
            after[i] = k = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if (p := pair + symbols[k]) in scores:
                    heapq.heappush(heap, (-scores[p], i, p))
            if (h := before[i]) >= 0 and (p := symbols[h] + pair) in scores:
                heapq.heappush(heap, (-scores[p], h, p))
        return count + sum(len(s.encode()) - 1 for s in symbols if s is not None and s not in scores)

    def known(self, part: str, merge) -> int:
        """merge(part), remembered; what wasn't asked for in a whole generation is forgotten."""
        n = self.seen.get(part)
        if n is None:
            n = self.older.get(part)
            if n is None:
                n = merge(part)
            if len(part) <= LONGEST:
                if len(self.seen) >= MEMORY:
                    self.seen, self.older = {}, self.seen
                self.seen[part] = n
        return n

    def apart(self, word: str) -> int:
        """Tokens of a word, cut where no piece holds the two neighbours, so that no merge can cross."""
        inner, first, total = self.inner, 0, 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in inner:
                total += self.known(word[first:i], self.merge) if i - first > 1 or first else self.merge(word[first:i])
                first = i
        return total + (self.known(word[first:], self.merge) if first else self.merge(word))

    def count(self, text: str) -> int:
        if not text:
            return 0
        words = Counter(self.words.findall(MARK + text.replace(" ", MARK)))
        return sum(self.known(word, self.apart) * times for word, times in words.items())


@lru_cache(maxsize=2)
def _merger(path: str) -> Merger:
    with open(path, "rb") as f:
        return Merger(read_model(f.read()))


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return id, n_bytes, n_tokens and over_limit of every row. model: path of the model file, the same on every executor.

    Null and empty texts have no tokens. Repeated rows are rows of their own; an empty table gives an empty result; other columns
    are not read. Texts are never cut.
    """

    def run(batches):
        merger = _merger(model)
        for ids, texts in pieces(batches):
            sizes = [len((t or "").encode()) for t in texts]
            tokens = [merger.count(t or "") for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema[0].dataType
    id_type = to_arrow_type(kind)
    return rows.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

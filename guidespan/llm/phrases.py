"""Phrase collocations, their counts made by a HAT-trie.

1. A worker counts phrases in a trie over word numbers: below each first word hangs a hash container of its phrases, and a container
   that grows large bursts into containers for neighbouring second words. When the trie holds too many entries, whole subtrees, the
   largest first, leave it as runs in the order of their words.
2. The runs are dealt out by their prefix, the first two words, and merged there; the phrases of a prefix that is a large share of all
   are dealt by the third word too. A phrase is one row a run at most.
3. Words and pairs are counted first. A phrase of three words is as frequent as asked for only if both its pairs are, so the second
   pass counts those whose pairs stand in a filter of the frequent ones. The filter has a fixed most size; if it fills up it lets
   more phrases pass, never fewer.
4. Frequent phrases are joined with the counts of their parts, which are frequent too, and scored in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guidespan.llm.common import pieces, written

#: Words of the longest phrase, and bits of a word's number.
WORDS, BITS = 3, 21
#: Second words of neighbouring numbers that share a container share all but so many bits.
SPAN = 8
#: Characters of one language that are counted at a time.
HELD_CHARS = 4 << 20
#: Entries of a container that bursts; entries, and words, that a worker's tries hold at most.
BURST, ENTRIES, VOCABULARY = 4096, 1_500_000, 400_000
#: Rows of an Arrow batch that leaves a worker.
ROWS = 1 << 16
UNKNOWN = "und"
#: Bits of the filter of pairs; pairs that are more than one in LARGE of all words are dealt by the third word too.
LEAST_BITS, MOST_BITS, LARGE = 20, 27, 1024
#: Parts of a language that are ranked apart before their best are ranked together.
PARTS = 256
_MASK = (1 << BITS) - 1
#: Bytes that end a piece, and those between words.
_BREAKS, _SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.array([2 if b in _BREAKS else 1 if b in _SPACES else 0 for b in range(256)], np.uint8)


def words_of(texts: list[str | None]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of some texts, lower case as to A-Z, as numbers of a dictionary, and the piece that each stands in."""
    data = np.frombuffer(b"\n".join((t or "").encode() for t in texts).lower(), np.uint8)
    kind = _KIND[data]
    inside = kind == 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    held = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return held.dictionary_encode(), np.cumsum(kind == 2)[starts]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


class Filter:
    """Pairs of words, by two bits of their hash in an array of fixed size; and the pairs that are a large share of all words."""

    def __init__(self, words: dict[int, int] | None, bits: int, large: frozenset[int] = frozenset()):
        self.bits, self.large = bits, np.array(sorted(large), np.uint64)
        self.words = None
        if words is not None:
            self.words = np.zeros(1 << (bits - 6), np.uint64)
            for at, held in words.items():
                self.words[at] = held & ((1 << 64) - 1)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return hashes >> np.uint64(64 - self.bits), mix(hashes) >> np.uint64(64 - self.bits)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if self.words is None:
            return np.ones(len(hashes), bool)
        one, two = (((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool) for at in self.places(hashes))
        return one & two


def phrase_codes(ids: np.ndarray, piece: np.ndarray, sizes: tuple[int, ...], pairs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, times) of the phrases of these sizes in a sequence of word numbers from 1, in the order of the codes; a shorter phrase
    ends in zeros. pairs: whether a phrase of three words may hold the pair that begins at each place."""
    found = []
    for size in sizes:
        n = max(0, len(ids) - size + 1)
        code = sum(ids[i : i + n] << (BITS * (WORDS - 1 - i)) for i in range(size))
        same = piece[size - 1 :] == piece[:n] if size > 1 else np.ones(n, bool)
        if size == WORDS and pairs is not None:
            same &= pairs[:n] & pairs[1 : n + 1]
        found.append(code[same])
    return np.unique(np.concatenate(found), return_counts=True)


class Trie:
    """Counts of phrases, by first word: a container {code: times}, or, once that has burst, containers by the high bits of
    the second word's number."""

    def __init__(self, lang: str, sizes: tuple[int, ...], pairs: Filter, burst: int = BURST):
        self.lang, self.sizes, self.pairs, self.burst, self.size, self.total = xxhash.xxh3_64_intdigest(lang), sizes, pairs, burst, 0, 0
        self.roots: dict[int, dict] = {}
        self.split: set[int] = set()  # the first words whose container has burst
        self.number: dict[bytes, int] = {}
        self.words: list[bytes] = [b""]
        self.hashes = np.zeros(1, np.uint64)

    def add(self, texts: list[str | None]) -> None:
        words, piece = words_of(texts)
        if not len(words):
            return
        number, new = np.empty(len(words.dictionary), np.int64), self.words
        for i, word in enumerate(words.dictionary.to_pylist()):
            k = self.number.get(word)
            if k is None:
                k = self.number[word] = len(new)
                new.append(word)
            number[i] = k
        self.hashes = np.append(self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new[len(self.hashes) :]), np.uint64))
        ids = number[words.indices.to_numpy()]
        self.total += len(ids)
        frequent = None
        if WORDS in self.sizes and self.pairs.words is not None:
            frequent = self.pairs(self.prefix(ids[:-1], ids[1:]))
        self.put(*phrase_codes(ids, piece, self.sizes, frequent))

    def prefix(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """A hash of the language and the words with these numbers, the same in every worker. No word: number 0."""
        return mix(mix(self.hashes[first] + np.uint64(self.lang)) * np.uint64(0x9E3779B97F4A7C15) + self.hashes[second])

    def put(self, codes: np.ndarray, times: np.ndarray) -> None:
        """Add sorted codes."""
        first = codes >> (2 * BITS)
        bounds = np.append(np.nonzero(np.diff(first, prepend=-1))[0], len(codes)).tolist()
        codes, times, first = codes.tolist(), times.tolist(), first.tolist()
        roots, split, shift = self.roots, self.split, BITS + SPAN
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            word = first[lo]
            root = roots.get(word)
            if root is None:
                root = roots[word] = dict(zip(codes[lo:hi], times[lo:hi], strict=True))
                self.size += hi - lo
            elif word in split:
                for code, n in zip(codes[lo:hi], times[lo:hi], strict=True):
                    box = root.get(code >> shift)
                    if box is None:
                        box = root[code >> shift] = {}
                    old = box.get(code, 0)
                    self.size += not old
                    box[code] = old + n
                continue
            else:
                before, get = len(root), root.get
                for code, n in zip(codes[lo:hi], times[lo:hi], strict=True):
                    root[code] = get(code, 0) + n
                self.size += len(root) - before
            if len(root) > self.burst:
                boxes: dict[int, dict] = {}
                for code, n in root.items():
                    boxes.setdefault(code >> shift, {})[code] = n
                roots[word] = boxes
                split.add(word)

    def subtrees(self) -> list[tuple[int, int, int | None]]:
        """(entries, first word, what its second words share or None) of every container."""
        out = []
        for word, root in self.roots.items():
            out += [(len(box), word, second) for second, box in root.items()] if word in self.split else [(len(root), word, None)]
        return out

    def spill(self, keep: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Take out whole subtrees, the largest first, until ``keep`` entries are left: (codes, times) in the order of their words."""
        codes, times = [], []
        for n, word, second in sorted(self.subtrees(), key=lambda x: (-x[0], x[1], x[2] or 0)):
            if self.size <= keep:
                break
            box = self.roots.pop(word) if second is None else self.roots[word].pop(second)
            if second is not None and not self.roots[word]:
                del self.roots[word]
                self.split.discard(word)
            codes += box.keys()
            times += box.values()
            self.size -= n
        return np.array(codes, np.int64), np.array(times, np.int64)

    def run(self, codes: np.ndarray, times: np.ndarray) -> list[pa.Array]:
        """Columns (hash of the prefix, words of the phrase, phrase, times) of these codes, in the order of the words' bytes."""
        parts = np.stack([codes >> (2 * BITS), (codes >> BITS) & _MASK, codes & _MASK])
        held = np.zeros(len(self.words), bool)
        held[parts.ravel()] = True
        used = np.nonzero(held)[0]
        words = pa.array([self.words[i] for i in used.tolist()], pa.binary())
        order = pc.sort_indices(words).to_numpy()
        rank = np.zeros(len(self.words), np.int64)
        rank[used[order]] = np.arange(len(used))
        by = np.argsort((rank[parts[0]] << (2 * BITS)) | (rank[parts[1]] << BITS) | rank[parts[2]], kind="stable")
        parts = parts[:, by]
        texts = words.take(pa.array(order)).cast(pa.string())
        columns = [texts.take(pa.array(rank[p])) for p in parts]
        size = (parts > 0).sum(axis=0)
        phrase = columns[0]
        for k in (1, 2):
            longer = pc.binary_join_element_wise(phrase, columns[k], " ")
            phrase = longer if (size > k).all() else phrase if not (size > k).any() else pc.if_else(pa.array(size > k), longer, phrase)
        prefix = self.prefix(parts[0], parts[1])
        large = np.isin(prefix, self.pairs.large) & (size == WORDS)
        prefix = np.where(large, mix(prefix + self.hashes[parts[2]]), prefix)
        return [pa.array(prefix.astype(np.int64)), pa.array(size.astype(np.int32)), phrase, pa.array(times[by])]


NAMES = ["prefix", "lang", "words", "phrase", "n"]


def _runs(batches, sizes: tuple[int, ...], pairs: Filter, entries: int, burst: int) -> Iterator[pa.RecordBatch]:
    """Rows of the runs; a row of no words has all words of a language."""
    tries: dict[str, Trie] = {}

    def put(lang: str, columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        langs = pa.DictionaryArray.from_arrays(np.zeros(len(columns[0]), np.int8), [lang]).cast(pa.string())
        whole = pa.RecordBatch.from_arrays([columns[0], langs, *columns[1:]], NAMES)
        for i in range(0, len(columns[0]), ROWS):
            yield whole.slice(i, ROWS)

    def end(lang: str) -> Iterator[pa.RecordBatch]:
        trie = tries.pop(lang)
        if trie.total and 1 in sizes:
            yield from put(lang, [pa.array([0], pa.int64()), pa.array([0], pa.int32()), pa.array([""]), pa.array([trie.total])])
        if trie.size:
            yield from put(lang, trie.run(*trie.spill()))

    held: dict[str, list[str]] = {}
    chars: dict[str, int] = {}

    def count(lang: str) -> Iterator[pa.RecordBatch]:
        trie = tries.setdefault(lang, Trie(lang, sizes, pairs, burst))
        trie.add(held.pop(lang))
        del chars[lang]
        if len(trie.words) > VOCABULARY:
            yield from end(lang)
        while sum(t.size for t in tries.values()) > entries:
            largest = max(tries, key=lambda k: tries[k].size)
            yield from put(largest, tries[largest].run(*tries[largest].spill(tries[largest].size // 2)))

    for langs, texts in pieces(batches):
        for lang, text in zip(langs, texts, strict=True):
            held.setdefault(lang, []).append(text)
            chars[lang] = chars.get(lang, 0) + len(text)
        while sum(chars.values()) > 2 * HELD_CHARS or max(chars.values(), default=0) > HELD_CHARS:
            yield from count(max(chars, key=chars.get))
    for lang in list(held):
        yield from count(lang)
    for lang in list(tries):
        yield from end(lang)


def _counted(rows: DataFrame, sizes: tuple[int, ...], pairs: Filter, least: int, entries: int, burst: int) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(pairs)  # 2**MOST_BITS bits, and fewer than LARGE hashes
    runs = rows.mapInArrow(lambda batches: _runs(batches, sizes, sent.value, entries, burst), "prefix long, lang string, words int, phrase string, n long")
    merged = runs.repartition("prefix").groupBy("prefix", "lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return written(merged.where((F.col("n") >= least) | (F.col("words") == 0)))


def _filter(found: DataFrame, least: int) -> Filter:
    """The filter of the pairs of ``found``: of each array word that is not zero one row comes to the driver, 2**(MOST_BITS - 6) at most."""
    pairs = found.where("words = 2")
    total = found.where("words = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = frozenset(r[0] & ((1 << 64) - 1) for r in pairs.where(F.col("n") * LARGE > total).select("prefix").collect())
    if least <= 1:
        return Filter(None, MOST_BITS, large)
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * pairs.count()).bit_length()))
    one = Filter(None, bits)

    def places(batches):
        for batch in batches:
            at = np.concatenate(one.places(batch.column(0).to_numpy().astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array((at & np.uint64(63)).astype(np.int32))], ["at", "bit"])

    bit = F.expr("bit_or(shiftleft(1L, bit))")
    words = pairs.select("prefix").mapInArrow(places, "at int, bit int").groupBy("at").agg(bit.alias("held")).toArrow()
    return Filter(dict(zip(words.column(0).to_pylist(), words.column(1).to_pylist(), strict=True)), bits, large)


def counts(docs: DataFrame, least: int = 1, text_col: str = "text", lang_col: str = "lang", entries: int = ENTRIES, burst: int = BURST) -> DataFrame:
    """(lang, words, phrase, n): how often each phrase of one to three words occurs in its language, if ``least`` times or more; a row of
    0 words has the number of all words of a language.

    Phrases end at ``. , ; : ! ?`` and line breaks. A null language is ``und``; null and empty texts have no words; repeated rows
    count again; an empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("_lang"), F.col(text_col).cast("string").alias("_text")).where("_text <> ''")
    short = _counted(rows, (1, 2), Filter(None, MOST_BITS), least, entries, burst)
    return short.unionByName(_counted(rows, (3,), _filter(short, least), least, entries, burst)).drop("prefix")


def collocations(docs: DataFrame, least: int = 10, inside: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Return each language's first ``top`` phrases of two or three words that occur ``least`` times or more: lang, rank, phrase, a (its
    occurrences), l and r (those of the two parts of its lowest-scoring cut), n (words of the language) and score.

    score: floor(1,000,000 a a / (l r)), exactly; of equal cuts the first. Phrases within a longer frequent one that occurs at least
    ``inside`` percent as often are left out. Order: score, a, phrase by bytes. Nulls, empty and repeated rows as in ``counts``.
    """
    found = counts(docs, least, text_col, lang_col)
    words = found.where("words = 0").select("lang", F.col("n").alias("_all"))
    known = found.where("words > 0").withColumn("_w", F.split("phrase", " ")).withColumns({f"w{i + 1}": F.try_element_at("_w", F.lit(i + 1)) for i in range(WORDS)}).drop("_w")
    cut = lambda k, *parts: F.struct(F.lit(k).alias("k"), *(F.concat_ws(" ", *p).alias(name) for name, p in zip(("left", "right"), parts, strict=True)))
    cuts = F.when(F.col("w3").isNull(), F.array(cut(1, ["w1"], ["w2"]))).otherwise(F.array(cut(1, ["w1"], ["w2", "w3"]), cut(2, ["w1", "w2"], ["w3"])))
    rows = known.where("w2 is not null").select("lang", "phrase", F.col("n").alias("a"), F.col("w3").isNull().alias("_two"), F.inline(cuts))
    part = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    rows = rows.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    # 38 digits hold a million times the square of 10**16 occurrences.
    number = lambda name: F.col(name).cast("decimal(19,0)")
    rows = rows.withColumn("_above", F.lit(1_000_000).cast("decimal(7,0)") * (number("a") * number("a"))).withColumn("_below", number("l") * number("r"))
    rows = rows.withColumn("score", F.expr("_above div _below"))
    scored = rows.groupBy("lang", "phrase", "_two", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    longer = known.where("w3 is not null").select("lang", "n", F.explode(F.array(F.concat_ws(" ", "w1", "w2"), F.concat_ws(" ", "w2", "w3"))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("n").alias("_longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(~F.col("_two") | F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * inside))
    kept = kept.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    best = kept.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("_all").alias("n"), "score")

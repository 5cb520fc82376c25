"""Near-duplicate classes by b-bit MinHash.

1. Every text becomes the set of its word pairs and the minima of this set under a family of hashes. Bands of whole minima say which
   texts may be alike; of each minimum only the low BITS bits are kept, packed in a few 64-bit numbers. Equal sets are one text.
2. The differing places of two signatures are counted by exclusive or and bit counts. Places of unlike sets agree by chance too, once
   in 2**BITS, which the estimate of the similarity corrects. Pairs whose estimate is far below the threshold (by MARGIN standard
   deviations) are put aside; all others are confirmed on their full sets, which meet as arrays in a join.
3. First every text of a bucket meets the bucket's least text. Where several classes are left in a bucket, blocks of the texts outside
   the largest class meet blocks of all, each set sent once to a pair of blocks, and all pairs of different classes that the
   estimate lets pass are confirmed there. So rows grow with texts; the square of what stays apart is left, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidespan.llm.common import HOT, cut, met, pieces, sized, written
from guidespan.llm.components import components
from guidespan.llm.ngram_join import _mix, _row, _seeds, bands_for, shared, word_hashes

WORDS = 2
#: Low bits kept of each minimum, and how many standard deviations an estimate may lie below the threshold.
BITS, MARGIN = 2, 4.5
#: Texts of a bucket, and shingles of theirs, that are compared in one task, on either side, about.
BLOCK, BLOCK_GRAMS = 1024, 1 << 20
#: Links of a text that meet one copy of its set, and n-grams of their sets, about.
PARTNERS, PARTNER_GRAMS = 512, 1 << 21
_PER = 64 // BITS
_LOW = sum(1 << (BITS * i) for i in range(_PER))
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the n-grams; of fewer words, the one of all."""
    h = word_hashes(words_of(text))
    if not len(h):
        return h
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * _P + h[i : len(h) - k + 1 + i]
    return np.unique(_mix(out))


def minima(grams: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = seeds
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), 4096):
        h = grams[i : i + 4096] * a
        h += b
        h ^= h >> np.uint64(31)
        np.minimum(least, h.min(axis=1), out=least)
    return least


def bands(least: np.ndarray, count: int) -> np.ndarray:
    """One 64-bit hash for each band of whole minima."""
    out = np.arange(count, dtype=np.uint64)
    for row in least.reshape(count, -1).T:
        out = _mix(out * _P + row)
    return out.astype(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima, _PER of them in a number."""
    low = np.zeros(-(-len(least) // _PER) * _PER, np.uint64)
    low[: len(least)] = _mix(least) & np.uint64((1 << BITS) - 1)
    return np.bitwise_or.reduce(low.reshape(-1, _PER) << (np.arange(_PER, dtype=np.uint64) * np.uint64(BITS)), axis=1).astype(np.int64)


def similarity(differing: float, places: int) -> float:
    """The similarity that so many differing places tell, less the agreement by chance."""
    chance = 2.0**-BITS
    return (1 - differing / places - chance) / (1 - chance)


def most_differing(threshold: float, places: int) -> int:
    """The most differing places of a pair that is confirmed on its full sets."""
    chance = 2.0**-BITS
    agree = threshold + (1 - threshold) * chance
    return int(places * (1 - agree) + MARGIN * (places * agree * (1 - agree)) ** 0.5)


def differing(left: str, right: str, numbers: int) -> Column:
    """How many places of two packed signatures differ."""
    either = lambda x: F.expr(" | ".join([x, *(f"shiftrightunsigned({x}, {i})" for i in range(1, BITS))]))
    total = F.lit(0)
    for i in range(numbers):
        x = f"({left}[{i}] ^ {right}[{i}])"
        total = total + F.bit_count(either(x).bitwiseAND(F.lit(_LOW)))
    return total


def _differing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The same for every row of left with every one of right."""
    total = np.zeros((len(left), len(right)), np.int32)
    for i in range(left.shape[1]):
        x = left[:, None, i] ^ right[None, :, i]
        for k in range(1, BITS):
            x |= (left[:, None, i] ^ right[None, :, i]) >> np.uint64(k)
        total += np.bitwise_count(x & np.uint64(_LOW))
    return total


def _groups(frames) -> Iterator[pd.DataFrame]:
    """The rows of each (band, one, two), which follow one another."""
    key, held = None, []
    for frame in frames:
        keys = list(zip(frame["band"].tolist(), frame["one"].tolist(), frame["two"].tolist(), strict=True))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if held and keys[start] != key:
                    yield pd.concat(held)
                    held = []
                key = keys[start]
                held.append(frame.iloc[start:i])
                start = i
    if held:
        yield pd.concat(held)


def _exact(frames, most: int, percent: int) -> Iterator[pd.DataFrame]:
    """The classes that the pairs of two blocks link, of all pairs whose estimate is near enough, on their full sets."""
    for group in _groups(frames):
        side = group["left"].to_numpy()
        left, right = group[side], group[~side]
        if left.empty or right.empty:
            continue
        near = _differing(*(np.stack(x["sig"].to_numpy()).astype(np.uint64) for x in (left, right))) <= most
        roots = [x["root"].to_numpy() for x in (left, right)]
        near &= roots[0][:, None] != roots[1][None, :]
        i, j = np.nonzero(near.any(axis=1))[0], np.nonzero(near.any(axis=0))[0]
        if not len(i):
            continue
        sets = [left["grams"].iloc[k] for k in i] + [right["grams"].iloc[k] for k in j]
        both = shared(sets, np.arange(len(i)), np.arange(len(i), len(sets)))
        size = np.array([len(x) for x in sets], np.float64)
        total = size[: len(i), None] + size[None, len(i) :]
        one, two = np.nonzero(near[np.ix_(i, j)] & (both * (100 + percent) >= total * percent))
        if len(one):
            yield pd.DataFrame({"a": roots[0][i[one]], "b": roots[1][j[two]]}).drop_duplicates()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ...) whose full sets reach the threshold. sets: (node, grams, size).

    The set of a text that has many partners is sent in several copies, one for so many of them.
    """
    sized = pairs.join(sets.select(F.col("node").alias("a"), F.col("size").alias("_size")), "a")
    spread = sized.groupBy("b").agg(F.greatest(F.ceil(F.count("*") / PARTNERS), F.ceil(F.sum("_size") / PARTNER_GRAMS)).cast("int").alias("_parts"))
    spread = cut(spread)
    dealt = pairs.join(spread, "b").withColumn("_part", F.pmod(F.xxhash64("a"), F.col("_parts")).cast("int")).drop("_parts")
    right = spread.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("_right")), "b").select("b", "_right", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    both = dealt.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("_left")), "a").join(right, ["b", "_part"])
    shared = F.size(F.array_intersect("_left", "_right"))
    return both.where(shared * (100 + percent) >= (F.size("_left") + F.size("_right")) * percent).select(*pairs.columns)


def _classes(texts: DataFrame, source: DataFrame, percent: int, places: int, distinct_texts: int, rows: int) -> DataFrame:
    """(node, root) of every text. texts: (node, _bands, sig, size, _row, _times); source: (_row, _text)."""
    numbers, most = -(-places // _PER), most_differing(percent / 100, places)
    banded = texts.select("node", F.explode("_bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("_all")).where("n > 1")
    # Bands that hold the same texts are one.
    buckets = cut(buckets.groupBy("n", "_all", "least").agg(F.min("band").alias("band")))
    placed = cut(sized(met(banded, buckets.select("band", "least", "n", F.col("n").alias("_n")), "band", "_n", distinct_texts), distinct_texts))
    signature = texts.select("node", "sig")
    first = sized(placed.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct(), distinct_texts)
    many = cut(first.groupBy("b").agg(F.count("*").alias("_n")))
    total = many.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    roots = texts.select("node", F.col("node").alias("root"))
    if not total:
        return roots
    first, many = sized(first, total), sized(many, total)
    near = met(first, many.join(signature.select(F.col("node").alias("b"), F.col("sig").alias("_right")), "b"), "b", "_n", total)
    near = sized(near, total).join(signature.select(F.col("node").alias("a"), F.col("sig").alias("_left")), "a")
    tested = cut(sized(near.where(differing("_left", "_right", numbers) <= most).select("a", "b"), total))
    # The sets of the texts that stand in some bucket, of one row each. A row that is there again and again is made one first.
    wanted = cut(sized(placed.select("node").distinct().join(texts.select("node", "_row", "_times"), "node"), distinct_texts))
    again = wanted.where(F.col("_times") * HOT > rows).select("_row", "node")
    found = source.join(F.broadcast(again.select("_row")), "_row", "left_anti").join(wanted.where(F.col("_times") * HOT <= rows).select("_row", "node"), "_row").select("node", "_text")
    found = found.unionByName(source.join(F.broadcast(again), "_row").groupBy("node").agg(F.first("_text").alias("_text")))

    def full(batches):
        for nodes, texts in pieces(batches):
            # Rows that are there several times came several times.
            grams = [shingles(t).astype(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(grams, pa.list_(pa.int64())), pa.array([len(g) for g in grams], pa.int64())], ["node", "grams", "size"])

    sets = written(found.groupBy("node").agg(F.first("_text").alias("_text")).mapInArrow(full, "node long, grams array<long>, size long"))
    placed = sized(placed.join(texts.select("node", "sig", "size"), "node"), distinct_texts)

    def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
        moved = components(links).select(F.col("node").alias("root"), F.col("root").alias("_to")).where("root <> _to")
        return cut(sized(roots.join(moved, "root", "left").select("node", F.coalesce("_to", "root").alias("root")), distinct_texts))

    roots = merged(roots, _confirmed(tested, sets, percent))
    # In a bucket of two texts all pairs are tested now.
    sides = _sides(placed.where("n > 2"), roots, sets.select("node", "grams"))
    return merged(roots, sides.mapInPandas(lambda frames: _exact(frames, most, percent), "a long, b long").distinct())


def _sides(placed: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """The texts of buckets of several classes, by blocks: those outside the largest class (left) and all, (band, one, two) together."""
    now = placed.join(roots, "node")
    classes = now.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("size").alias("grams"))
    main = classes.groupBy("band").agg(F.max(F.struct("n", "root", "grams")).alias("main"), F.sum("n").alias("all"), F.sum("grams").alias("grams"), F.count("*").alias("classes")).where("classes > 1")
    count = lambda n, grams: F.greatest(F.ceil(n / BLOCK), F.ceil(grams / BLOCK_GRAMS), F.lit(1)).cast("int")
    main = main.select("band", F.col("main.root").alias("main"), count(F.col("all") - F.col("main.n"), F.col("grams") - F.col("main.grams")).alias("ones"), count(F.col("all"), F.col("grams")).alias("twos"))
    rows = cut(now.join(main, "band").select("band", "node", "root", "sig", "main", "ones", "twos")).join(sets, "node")
    block = lambda name: F.pmod(F.xxhash64(F.lit(name), "node"), F.col(name)).cast("int")
    blocks = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = rows.where("root <> main").withColumn("one", block("ones")).withColumn("two", blocks("twos")).withColumn("left", F.lit(True))
    right = rows.withColumn("two", block("twos")).withColumn("one", blocks("ones")).withColumn("left", F.lit(False))
    columns = ["band", "one", "two", "left", "node", "root", "sig", "grams"]
    return left.select(*columns).unionByName(right.select(*columns)).repartition("band", "one", "two").sortWithinPartitions("band", "one", "two")


def near_duplicates(docs: DataFrame, percent: int = 80, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return, for every row, id, n_shingles, component_id (the least id of the texts that links reach from it) and kept (whether that
    is its own id).

    Texts are linked if 100 times the word pairs they share are ``percent`` times those of both or more. A-Z are lower-cased, words
    stand between ASCII white space, a text of one word is one shingle. Null texts and texts without words have no shingles and are
    linked with nothing. recall: that of a pair just at the threshold, in the search by bands. A null id is less than any other.
    Rows of one id are told apart by their texts; repeated rows are kept or not together. An empty table gives an empty result.
    Other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    count, height = bands_for(percent / 100, recall)
    places = count * height
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), _row(id_col, text_col).alias("_row"))
    kind = source.schema[0].dataType
    id_type = to_arrow_type(kind)

    def sign(batches):
        seeds = _seeds(places)
        for ids, texts, row in pieces(batches):
            keys, hashes, sigs, sizes = [], [], [], []
            for text in texts:
                grams = shingles(text)
                some = len(grams) > 0
                least = minima(grams, seeds) if some else None
                keys.append(xxhash.xxh3_128_digest(grams.tobytes()) if some else None)
                hashes.append(bands(least, count) if some else None)
                sigs.append(packed(least) if some else None)
                sizes.append(len(grams))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(row, pa.binary()), pa.array(keys, pa.binary()), pa.array(hashes, longs), pa.array(sigs, longs), pa.array(sizes, pa.int64())], ["_id", "_row", "_key", "_bands", "sig", "size"])

    signed = cut(source.mapInArrow(sign, f"_id {kind.simpleString()}, _row binary, _key binary, _bands array<long>, sig array<long>, size long"))
    rows = signed.count()
    signed = sized(signed, rows)
    once = signed.where("_key is not null").groupBy("_key", "_row", "_id").agg(F.count("*").alias("times"), *(F.first(c).alias(c) for c in ("_bands", "sig", "size")))
    low = F.struct(F.col("_id").isNotNull().alias("k"), F.col("_id").alias("id"), F.col("_row").alias("row"), "times")
    texts = once.groupBy("_key").agg(F.sum("times").alias("copies"), F.min(low).alias("low"), *(F.first(c).alias(c) for c in ("_bands", "sig", "size")))
    texts = cut(sized(texts.withColumn("node", F.xxhash64("_key")), rows))
    distinct_texts = texts.count()
    roots = _classes(texts.select("node", "_bands", "sig", "size", F.col("low.row").alias("_row"), F.col("low.times").alias("_times")), source.select("_row", "_text"), percent, places, distinct_texts, rows)
    named = cut(texts.select("_key", "node", "copies", F.struct("low.k", "low.id").alias("own")).join(roots, "node"))
    lowest = named.groupBy("root").agg(F.min("own").alias("low"), F.count("*").alias("n"))
    named = cut(met(named, lowest, "root", "n", distinct_texts).select("_key", F.col("low.id").alias("_low"), "copies"))
    linked = met(signed.where("_key is not null").select("_id", "_key", "size"), named, "_key", "copies", rows)
    out = linked.select("_id", "size", "_low").unionByName(signed.where("_key is null").select("_id", "size", F.col("_id").alias("_low")))
    return out.select(F.col("_id").alias(id_col), F.col("size").alias("n_shingles"), F.col("_low").alias("component_id"), F.col("_id").eqNullSafe(F.col("_low")).alias("kept"))

"""N-gram Jaccard self-join of documents by MinHash banding.

1. Every text becomes the set of its word five-grams (a text of fewer words: one n-gram of all of them), and a MinHash signature.
   Equal word sequences are one text from here on.
2. Signatures are cut in bands, their numbers chosen for the target recall at the threshold; texts that share a band hash are
   linked to the least text of its bucket, never to one another. The connected parts of this graph hold all candidate pairs.
3. The texts of a part meet in one task, where every pair is verified on the full n-gram sets, by products of blocks of the
   text-by-n-gram matrix. A task returns what it counted for each text and a spanning forest of the links, so rows grow with texts
   and not with pairs.
4. A part too large for a task has a centre, the n-grams that half of the texts of one of its blocks hold (any set would do, a typical
   one saves work). Blocks of texts meet the centre, and each text keeps only the n-grams in which it differs from it. With these alone every pair can be verified: texts x and y share |c| - d(x) - d(y) + s n-grams,
   where d counts those of the centre c that a text lacks and s those that both differ in. So the pair reaches the threshold t just
   if (1 + t) s >= h(x) + h(y), h = t |text| + (1 + t) (d - |c| / 2). Pairs with h(x) + h(y) <= 0 need no n-gram at all: they are
   counted from the distribution of h, in one pass over sorted values. What is left are pairs with a text of h > 0, far from the
   centre: blocks of these meet blocks of the part, as their differences.
5. The forests' components are the classes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guidespan.llm.common import HOT, cut, fresh, met, pieces, written
from guidespan.llm.components import components

WORDS = 5
#: Texts, and n-grams, of a part (or of a block of a large one) that meet in a task, about.
BLOCK, BLOCK_GRAMS = 512, 1 << 20
#: The same of a block of differences.
WIDE, WIDE_GRAMS = 512, 1 << 21
EPSILON = 1e-9
#: Words whose hash a worker remembers.
MEMORY = 500_000
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_hashes: dict[str, int] = {}


def bands_for(threshold: float, recall: float, most: int = 144) -> tuple[int, int]:
    """(bands, rows): the most rows a band, hence the fewest false candidates, that find a pair at the threshold with this recall."""
    for rows in range(most, 0, -1):
        bands = most // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            while bands > 1 and 1 - (1 - threshold**rows) ** (bands - 1) >= recall:
                bands -= 1
            return bands, rows
    raise ValueError("no bands reach this recall")


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _P2
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[str]) -> np.ndarray:
    if len(_hashes) > MEMORY:
        _hashes.clear()
    get, make = _hashes.get, xxhash.xxh3_64_intdigest
    out = [get(w) for w in words]
    for i, h in enumerate(out):
        if h is None:
            out[i] = _hashes[words[i]] = make(words[i])
    return np.array(out, dtype=np.uint64)


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the n-grams."""
    h = word_hashes(words_of(text))
    if not len(h):
        return h
    k = min(n, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * _P1 + h[i : len(h) - k + 1 + i]
    return np.unique(_mix(out))


def _seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(f"minhash {i}") for i in range(count)), np.uint64).reshape(count, 2)
    return raw[:, :1] | np.uint64(1), raw[:, 1:]


def band_hashes(grams: np.ndarray, bands: int, rows: int, seeds) -> np.ndarray:
    """One 64-bit hash for each band."""
    a, b = seeds
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), 4096):
        h = grams[i : i + 4096] * a
        h += b
        h ^= h >> np.uint64(31)
        np.minimum(least, h.min(axis=1), out=least)
    out = np.arange(bands, dtype=np.uint64)
    for row in least.reshape(bands, rows).T:
        out = _mix(out * _P1 + row)
    return out.astype(np.int64)


def shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many n-grams each set of left shares with each of right (indexes of sets), as a matrix.

    Products of 0/1 matrices, a bounded number of n-grams at a time; n-grams of one text alone are left out first, for they are
    shared by none.
    """
    used = np.concatenate([left, right])
    grams = np.concatenate([sets[i] for i in used]) if len(used) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    _, column, times = np.unique(grams, return_inverse=True, return_counts=True)
    keep = times[column] > 1
    column, owner = np.unique(column[keep], return_inverse=True)[1], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(left), len(right)), np.float32)
    width = max(1, (8 << 20) // max(1, len(used)))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [first, first + width])
        matrix = np.zeros((len(used), min(width, int(column[-1]) + 1 - first)), np.float32)
        matrix[owner[lo:hi], column[lo:hi] - first] = 1
        both += matrix[: len(left)] @ matrix[len(left) :].T
    return both


def links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of left, j of right) of the sets whose Jaccard similarity reaches the threshold."""
    both = shared(sets, left, right)
    size = np.array([len(s) for s in sets], np.float64)
    union = size[left][:, None] + size[right][None, :] - both
    return np.nonzero((both > 0) & (both >= threshold * union - EPSILON))


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what (i, j) connects, fewer than n of them."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(x), find(y)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((x, y))
            if len(out) == n - 1:
                break
    return out


def _row(id_col: str, text_col: str) -> Column:
    """A hash of id and text together: it tells rows apart where ids are null or shared. Null if the text is null."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("/"), F.col(id_col).cast("string")), F.lit("")), F.lit("|"), F.col(text_col).cast("string")).cast("binary")))


def _no_words(text_col: str) -> Column:
    """Whether a text is null or has white space only."""
    text = F.col(text_col).cast("string")
    return text.isNull() | text.rlike(r"(?U)^[\s\x1c-\x1f]*$")


def _counted(node: np.ndarray, degree: np.ndarray, tree: list[tuple[int, int]]) -> pd.DataFrame:
    """What a task returns: a row a text with its links (a = b), a row a link of the forest."""
    a, b = [x for x, _ in tree], [y for _, y in tree]
    return pd.DataFrame({"a": np.concatenate([node, node[a]]) if a else node, "b": np.concatenate([node, node[b]]) if a else node, "degree": np.concatenate([degree, np.zeros(len(a), np.int64)])})


def _verify(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """All pairs of a part that fits in a task."""
    group = group.drop_duplicates("node").sort_values("node", ignore_index=True)
    sets, copies, everything = [shingles(t) for t in group["_text"]], group["copies"].to_numpy(), np.arange(len(group))
    degree, found = np.zeros(len(group), np.int64), []
    for s in range(0, len(group), BLOCK):
        for t in range(s, len(group), BLOCK):
            i, j = links(sets, everything[s : s + BLOCK], everything[t : t + BLOCK], threshold)
            i, j = i + s, j + t
            i, j = i[i != j], j[i != j]
            np.add.at(degree, i, copies[j])
            if s != t:
                np.add.at(degree, j, copies[i])
            found += _forest(len(group), i, j)
    tree = _forest(len(group), np.array([x for x, _ in found], int), np.array([y for _, y in found], int))
    return _counted(group["node"].to_numpy(), degree, tree)


def _centre(group: pd.DataFrame) -> pd.DataFrame:
    """The n-grams that at least half of these texts hold."""
    grams, times = np.unique(np.concatenate([shingles(t) for t in group.drop_duplicates("node")["_text"]]), return_counts=True)
    return pd.DataFrame({"root": group["root"].iloc[:1], "centre": [grams[times * 2 >= group["node"].nunique()].astype(np.int64)]})


def _differences(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The texts of a block by their differences from the centre, which stands in the block too."""
    texts = group[group["_text"].notna()].drop_duplicates("node")
    centre = np.sort(group.loc[group["_text"].isna(), "centre"].iloc[0].astype(np.uint64))
    out = []
    for root, node, copies, text in zip(texts["root"], texts["node"], texts["copies"], texts["_text"], strict=True):
        own = shingles(text)
        lacking = np.setdiff1d(centre, own, assume_unique=True)
        h = threshold * len(own) + (1 + threshold) * (len(lacking) - len(centre) / 2)
        out.append((root, node, copies, h, np.concatenate([lacking, np.setdiff1d(own, centre, assume_unique=True)]).astype(np.int64)))
    return pd.DataFrame(out, columns=["root", "node", "copies", "h", "grams"])


def _far_pairs(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Pairs of the far texts of one block and all texts of another that only shared differences can link."""
    group = group.sort_values(["far", "node"], ascending=[False, True], ignore_index=True)
    n, m = int(group["far"].sum()), len(group)
    sets, h, node, copies = list(group["grams"]), group["h"].to_numpy(), group["node"].to_numpy(), group["copies"].to_numpy()
    names, at = np.unique(node, return_inverse=True)
    degree, found = np.zeros(len(names), np.int64), []
    for s in range(0, n, BLOCK):
        for t in range(n, m, BLOCK):
            left, right = np.arange(s, min(s + BLOCK, n)), np.arange(t, min(t + BLOCK, m))
            need = h[left][:, None] + h[right][None, :]
            i, j = np.nonzero((need > EPSILON) & ((1 + threshold) * shared(sets, left, right) >= need - EPSILON))
            i, j = left[i], right[j]
            i, j = i[at[i] != at[j]], j[at[i] != at[j]]
            np.add.at(degree, at[i], copies[j])
            near = h[j] <= EPSILON / 2  # a pair of two far texts is met from the other side too
            np.add.at(degree, at[j[near]], copies[i[near]])
            found += _forest(len(names), at[i], at[j])
    tree = _forest(len(names), np.array([x for x, _ in found], int), np.array([y for _, y in found], int))
    return _counted(names, degree, tree)


def _large(chosen: DataFrame, threshold: float) -> DataFrame:
    """(a, b, degree) of the parts that are too large for a task. chosen: (root, node, copies, block, blocks, _text)."""
    columns = ["root", "block", "node", "copies", "_text"]
    # The block of the text that names the part is never empty.
    first = F.pmod(F.xxhash64(F.lit("block"), "root"), F.col("blocks")).cast("int")
    centres = cut(chosen.where(F.col("block") == first).groupBy("root", "blocks").applyInPandas(lambda g: _centre(g).assign(blocks=g["blocks"].iloc[0]), "root long, centre array<long>, blocks int"))
    centres = centres.select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("copies"), F.lit(None).cast("string").alias("_text"), "centre")
    both = chosen.select(*columns, F.lit(None).cast("array<long>").alias("centre")).unionByName(centres)
    held = written(both.groupBy("root", "block").applyInPandas(lambda g: _differences(g, threshold), "root long, node long, copies long, h double, grams array<long>"))
    far = F.col("h") > EPSILON / 2
    # The distribution of h in each part: what is here to be ordered are distinct values, not texts.
    values = held.groupBy("root", "h").agg(F.sum("copies").alias("copies"), F.count("*").alias("n"), F.sum(F.size("grams")).alias("grams"), F.min("node").alias("least"))
    both = values.select("root", "h", F.col("h").alias("at"), F.lit(0).alias("asks"), "copies").unionByName(values.select("root", "h", (EPSILON - F.col("h")).alias("at"), F.lit(1).alias("asks"), F.lit(0).cast("long").alias("copies")))
    reach = both.withColumn("reach", F.sum("copies").over(Window.partitionBy("root").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0))).where("asks = 1").select("root", "h", "reach")
    whole = values.groupBy("root").agg(F.min(F.struct("h", "least")).alias("hub"), F.sum("n").alias("_n"), F.sum("grams").alias("_grams"), F.coalesce(F.sum(F.when(far, F.col("n"))), F.lit(0)).alias("_far"), F.coalesce(F.sum(F.when(far, F.col("grams"))), F.lit(0)).alias("_far_grams"))
    blocks = lambda n, grams: F.greatest(F.ceil(F.col(n) / WIDE), F.ceil(F.col(grams) / WIDE_GRAMS)).cast("int")
    whole = whole.select("root", "hub", blocks("_n", "_grams").alias("blocks"), F.when(F.col("_far") > 0, blocks("_far", "_far_grams")).otherwise(0).alias("far_blocks"))
    known = cut(values.select("root", "h", "n").join(reach, ["root", "h"]).join(whole, "root"))
    held = met(held, known, ["root", "h"], "n", held.count())
    near = held.select(F.col("node").alias("a"), F.when(F.col("h") + F.col("hub.h") <= EPSILON, F.col("hub.least")).otherwise(F.col("node")).alias("b"), (F.col("reach") - F.when(F.col("h") * 2 <= EPSILON, F.col("copies")).otherwise(0)).alias("degree"))
    place = lambda name: F.pmod(F.xxhash64(F.lit(name), "node"), F.col(name)).cast("int")
    ones = held.where(far).withColumn("one", place("far_blocks")).withColumn("two", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    twos = held.where("far_blocks > 0").withColumn("two", place("blocks")).withColumn("one", F.explode(F.sequence(F.lit(0), F.col("far_blocks") - 1)))
    met_far = ones.withColumn("far", F.lit(True)).unionByName(twos.withColumn("far", F.lit(False))).select("root", "one", "two", "far", "node", "copies", "h", "grams")
    # The edge to the hub has no count of its own.
    return near.withColumn("b", F.col("a")).unionByName(near.where("a <> b").withColumn("degree", F.lit(0).cast("long"))).unionByName(met_far.groupBy("root", "one", "two").applyInPandas(lambda g: _far_pairs(g, threshold), "a long, b long, degree long"))


def _classes(docs: DataFrame, threshold: float, recall: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """(_id, _row, _key) of every row; for each word sequence (_key) its copies, links and the kept row of its class; rows in all.

    The kept row, low (id, key, row, times it is there), is of the class's least id and of the least key with this id.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    bands, rows = bands_for(threshold, recall)
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), _row(id_col, text_col).alias("_row"))
    kind = source.schema[0].dataType
    id_type = to_arrow_type(kind)

    def sign(batches):
        seeds = _seeds(bands * rows)
        for ids, texts, row in pieces(batches):
            keys, hashes, sizes = [], [], []
            for text in texts:
                words = words_of(text)
                grams = shingles(text)
                keys.append(xxhash.xxh3_128_digest(" ".join(words)) if words else None)
                hashes.append(band_hashes(grams, bands, rows, seeds) if words else None)
                sizes.append(len(grams))
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(row, pa.binary()), pa.array(keys, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["_id", "_row", "_key", "_bands", "_size"])

    signed = cut(source.mapInArrow(sign, f"_id {kind.simpleString()}, _row binary, _key binary, _bands array<long>, _size long"))
    # Equal texts are one, named by its key's hash; copies are counted before the shuffle, repeated rows first.
    once = signed.where("_key is not null").groupBy("_key", "_row", "_id").agg(F.count("*").alias("times"), F.first("_bands").alias("_bands"), F.first("_size").alias("_size"))
    low = F.struct(F.col("_id").isNotNull().alias("k"), F.col("_id").alias("id"), F.col("_row").alias("row"), "times")
    texts = cut(once.groupBy("_key").agg(F.sum("times").alias("copies"), F.min(low).alias("least"), F.first("_bands").alias("_bands"), F.first("_size").alias("_size")))
    texts = texts.withColumn("node", F.xxhash64("_key")).select("_key", "node", "copies", "least", "_bands", "_size")
    total, distinct_texts = signed.count(), texts.count()
    banded = texts.select("node", F.explode("_bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("b"), F.max("node").alias("other"), F.count("*").alias("n")).where("b <> other").drop("other")
    found = met(banded, buckets, "band", "n", distinct_texts * bands).select(F.col("node").alias("a"), "b")
    parts = cut(components(found).join(texts.select("node", "copies", "least", "_size"), "node"))
    sizes = parts.groupBy("root").agg(F.count("*").alias("n"), F.sum("_size").alias("grams")).withColumn("blocks", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int"))
    parts = met(parts, sizes.drop("grams"), "root", "n", distinct_texts).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).cast("int"))
    parts = cut(parts.select("root", "node", "copies", "block", "blocks", F.col("least.row").alias("_row"), F.col("least.times").alias("_times")))
    # One text for each: that of the least row that has this key. A row that is there again and again is made one before it is sent.
    again = parts.where(F.col("_times") * HOT > total).drop("_times")
    columns = ["root", "node", "copies", "block", "blocks"]
    chosen = source.join(F.broadcast(again.select("_row")), "_row", "left_anti").join(parts.where(F.col("_times") * HOT <= total), "_row").select(*columns, "_text")
    chosen = chosen.unionByName(source.join(F.broadcast(again), "_row").groupBy(*columns).agg(F.first("_text").alias("_text")))
    chosen = written(chosen)
    verified = chosen.where("blocks = 1").groupBy("root").applyInPandas(lambda g: _verify(g, threshold), "a long, b long, degree long")
    verified = cut(verified.unionByName(_large(chosen.where("blocks > 1"), threshold)))
    degrees = verified.where("degree > 0").groupBy(F.col("a").alias("node")).agg(F.sum("degree").alias("degree"))
    classes = components(verified.where("a <> b").select("a", "b"))
    named = cut(texts.select("_key", "node", "copies", "least").join(degrees, "node", "left").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node")))
    lowest = named.groupBy("root").agg(F.min(F.struct("least.k", "least.id", F.col("_key").alias("key"), "least.row", "least.times")).alias("low"), F.count("*").alias("n"))
    named = cut(met(named, lowest, "root", "n", distinct_texts).select("_key", "low", (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"), F.col("copies").alias("n_copies")))
    return signed.select("_id", "_row", "_key"), named, total


def join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return, for every row, id, class_id (the least id of its class), n_links (other rows with this similarity or more), n_copies
    (rows of the same word sequence, itself included) and keep (one row of each class: that of the least id, of the least key if
    several texts of the class share it).

    Words are lower-case and stand between white space. Texts without words, nulls among them, are linked to none and kept, each a
    class of its own. Rows of equal words are linked to one another, repeated rows (of one id) too; repeated rows have one id, so they
    are kept or not together. A null id is less than any other. Ids may be null or shared by rows of different texts: rows are told
    apart by id and text, but class_id names a class by id alone. An empty table gives an empty result. Other columns are not read.
    """
    signed, named, total = _classes(docs, threshold, recall, id_col, text_col)
    out = met(signed.where("_key is not null"), named.withColumn("_rows", F.col("n_copies")), "_key", "_rows", total)
    keep = F.col("_id").eqNullSafe(F.col("low.id")) & (F.col("_key") == F.col("low.key"))
    out = out.select("_id", F.col("low.id").alias("class_id"), "n_links", "n_copies", keep.alias("keep"))
    alone = signed.where("_key is null").select("_id", F.col("_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), F.lit(True).alias("keep"))
    return out.unionByName(alone).withColumnRenamed("_id", id_col)


def distinct(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each class: that which ``join`` keeps (one of them, if it is repeated).

    Texts without words are classes of their own, so all their rows stay. An empty table gives an empty result.
    """
    signed, named, total = _classes(docs, threshold, 0.999, id_col, text_col)
    row, times = fresh(docs, "row", "times")
    kept = cut(named.select(F.col("low.row").alias(row), F.col("low.times").alias(times)).distinct())
    hot = signed.where("_row is not null").groupBy(F.col("_row").alias(row)).agg(F.count("*").alias("n")).where(F.col("n") * HOT > total).select(row)
    known = docs.where(~_no_words(text_col)).withColumn(row, _row(id_col, text_col))
    cold = known.join(F.broadcast(hot), row, "left_anti")
    once = cold.join(kept.where(F.col(times) == 1).select(row), row, "left_semi")
    again = cold.join(kept.where(F.col(times) > 1).select(row), row, "left_semi").unionByName(known.join(F.broadcast(hot.join(kept, row, "left_semi")), row, "left_semi"))
    return docs.where(_no_words(text_col)).unionByName(once.drop(row)).unionByName(again.dropDuplicates([row]).drop(row))

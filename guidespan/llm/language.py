"""Language identification by the nearest of several centroids per language.

A text is the normalised TF-IDF vector of its hashed byte n-grams (letters only, lower case). The labelled sample is clustered
within each language, one task a language; a text gets the language of the centroid with the largest cosine. It is rejected if even
that one is too far. Cosines rise with the length of a text, so there is a limit for each class of lengths: a little above the cosine
that nearly all texts of the sample stay below when they are held against the centroids of the other languages. That is how texts
of a language that was not learned look, and texts of random letters or one repeated word.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guidespan.llm.common import append, cut, fresh, pieces

DIMS_BITS = 12
DIMS = 1 << DIMS_BITS
ORDERS = (2, 3, 4)
CENTROIDS = 4
#: Labelled rows of each language that the model is fitted on at most; a cluster of a smaller share of them is no centroid.
SAMPLE, LEAST_SHARE = 800, 0.02
#: Upper bounds of the classes of lengths, in n-grams. Texts of the first class (about 35 letters) tell too little to be rejected by their
#: distance.
LENGTHS = (100, 400, 1600, 6400, 25600)
#: Pieces of a sample text that stand for each class of shorter texts, and their letters (about a third of their n-grams).
PIECES, LETTERS = 2, (0, 50, 260, 1060, 4260)
#: The limit: this quantile of the cosines with other languages, and this part of the way from there to the median with the own one.
#: With one language: this part of that median.
FOREIGN, MARGIN, ALONE = 0.95, 0.2, 0.5
#: Cosines are counted in so many steps.
STEPS = 500
NO_LANGUAGE = "und"
_letter = re.compile(r"[^\W\d_]")
#: Bytes that are no ASCII letters and no part of a longer character become spaces.
_FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def counts(text: str | None) -> np.ndarray | None:
    """How often each hashed n-gram occurs; None if the text has no letter."""
    if not text or not _letter.search(text):
        return None
    b = _FOLD[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    space = b == 32
    b = b[~(space & np.concatenate([[False], space[:-1]]))].astype(np.uint32)
    out = np.zeros(DIMS, np.int64)
    for n in ORDERS:
        if len(b) < n:
            continue
        h = np.full(len(b) - n + 1, n, np.uint32)
        for i in range(n):
            h *= np.uint32(0x01000193)
            h += b[i : len(b) - n + 1 + i]
        h *= np.uint32(0x9E3779B1)
        out += np.bincount(h >> np.uint32(32 - DIMS_BITS), minlength=DIMS)
    return out


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    least: np.ndarray  # the limit of each class of lengths

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        x = np.log1p(rows.astype(np.float32)) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, largest cosine, rejected."""
        found, score, out = [NO_LANGUAGE] * len(texts), [0.0] * len(texts), [True] * len(texts)
        rows, at, rows_at = [], [], {}

        def put() -> None:
            if rows:
                near = self.vectors(np.stack(rows)) @ self.centroids.T if len(self.centroids) else np.zeros((len(rows), 0), np.float32)
                for k, cosines in zip(at, near, strict=True):
                    if len(cosines):
                        best = int(cosines.argmax())
                        found[k], score[k] = self.languages[best], float(min(1.0, max(0.0, cosines[best])))
                        out[k] = score[k] < self.least[np.searchsorted(LENGTHS, rows_at[k], side="right")]
                rows.clear()
                at.clear()

        for k, text in enumerate(texts):
            if (c := counts(text)) is not None:
                rows.append(c)
                at.append(k)
                rows_at[k] = int(c.sum())
                if len(rows) == 256:
                    put()
        put()
        return found, score, out


def clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far-apart starts; at most k unit centroids."""
    mean = x.mean(axis=0)
    centers = [mean / max(np.linalg.norm(mean), 1e-9)]
    while len(centers) < min(k, len(x)):
        near = np.max(x @ np.stack(centers).T, axis=1)
        centers.append(x[int(near.argmin())])
    c = np.stack(centers)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        # Starts may be outliers: clusters of few texts are given up, but for the largest.
        held = np.bincount(own, minlength=len(c))
        keep = [i for i in range(len(c)) if held[i] >= LEAST_SHARE * len(x) or i == held.argmax()]
        sums = np.stack([x[own == i].sum(axis=0) for i in keep])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return c


def _quantile(counts: np.ndarray, share: float) -> float:
    """The cosine that this share of the counted ones stays below."""
    return float(np.searchsorted(np.cumsum(counts), share * counts.sum())) / STEPS


def limits(own: np.ndarray, foreign: np.ndarray) -> np.ndarray:
    """The limit of each class of lengths, from counts (class, step) of cosines with the own language and with others.

    A class without any text has the limit of the one below; the first has none.
    """
    out = np.zeros(len(own))
    for k, (mine, theirs) in enumerate(zip(own, foreign, strict=True)):
        if not mine.sum():
            out[k] = out[k - 1] if k else 0.0
        elif not theirs.sum():
            out[k] = ALONE * _quantile(mine, 0.5)
        else:
            far, near = _quantile(theirs, FOREIGN), _quantile(mine, 0.5)
            out[k] = far + MARGIN * (near - far) if near > far else 0.0
    out[0] = 0.0
    return out


def excerpts(text: str) -> list[str]:
    """The text and, for each class of shorter texts but the first, PIECES stretches of it."""
    out = [text]
    for n in LETTERS[1:]:
        if len(text) >= 2 * PIECES * n:
            out += [text[i * len(text) // PIECES : i * len(text) // PIECES + n] for i in range(PIECES)]
    return out


def _counts(column) -> np.ndarray:
    return np.stack([counts(t) for t in column])


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on the rows where ``train`` holds and the language is known, SAMPLE different ones of each language (by a hash) at most.

    The workers count the n-grams, of whole texts, and cluster each language; stretches of the sample's texts stand in for shorter ones; only centroids, document frequencies and counts of
    cosines come to the driver. Without any such row the model has no language and rejects all.
    """
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text"), F.xxhash64(F.col(id_col), F.col(text_col).cast("string")).alias("_hash"))
    # Different rows count, not repeated ones; their number is estimated within a few percent, which the share below allows for.
    known = rows.groupBy("_lang").agg(F.approx_count_distinct("_hash", 0.02).alias("_rows"))
    # A share of each language's hashes holds about SAMPLE rows and some more; of these the first SAMPLE are taken.
    share = (F.pmod("_hash", F.lit(1 << 30)) + 1) / F.lit(float(1 << 30))
    few = rows.select("_lang", "_hash").join(F.broadcast(known), "_lang").where(share * F.col("_rows") <= 1.2 * SAMPLE + 50).select("_lang", "_hash").distinct()
    picked = few.withColumn("_n", F.row_number().over(Window.partitionBy("_lang").orderBy("_hash"))).where(F.col("_n") <= SAMPLE).select("_lang", "_hash")

    def run(batches):
        for langs, texts, hashes in pieces(batches):
            got = [(lang, h, t) for lang, t, h in zip(langs, texts, hashes, strict=True) if _letter.search(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string()))], ["lang", "hash", "text"])

    lettered = rows.join(F.broadcast(picked), ["_lang", "_hash"], "left_semi").select("_lang", "_text", "_hash").mapInArrow(run, "lang string, hash long, text string")
    sample = cut(lettered.groupBy("lang", "hash").agg(F.min("text").alias("text")))  # repeated rows are one

    def frequencies(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [len(group)], "df": [(_counts(group["text"]) > 0).sum(axis=0).astype("<i8").tobytes()]})

    seen = sample.groupBy("lang").applyInPandas(frequencies, "n long, df binary").collect()  # a row a language
    if not seen:
        return Model(np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), [], np.zeros(len(LENGTHS) + 1))
    idf = (np.log((1 + sum(r["n"] for r in seen)) / (1 + sum(np.frombuffer(r["df"], "<i8") for r in seen))) + 1).astype(np.float32)
    model = Model(idf, np.zeros((0, DIMS), np.float32), [], np.zeros(len(LENGTHS) + 1))

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("hash")
        c = clusters(model.vectors(_counts(group["text"])), CENTROIDS)
        return pd.DataFrame({"lang": [group["lang"].iloc[0]] * len(c), "k": range(len(c)), "c": [x.astype("<f4").tobytes() for x in c]})

    got = sorted(map(tuple, sample.groupBy("lang").applyInPandas(cluster, "lang string, k long, c binary").collect()))  # CENTROIDS rows a language
    model = Model(idf, np.stack([np.frombuffer(c, "<f4") for _, _, c in got]), [lang for lang, _, _ in got], np.zeros(len(LENGTHS) + 1))
    names = np.array(model.languages)

    def cosines(frames):
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                held = np.stack([c for t in excerpts(text) if (c := counts(t)) is not None])
                near = model.vectors(held) @ model.centroids.T
                own = names == lang
                mine, theirs = near[:, own].max(axis=1), near[:, ~own].max(axis=1, initial=-1)
                yield pd.DataFrame({"k": np.searchsorted(LENGTHS, held.sum(axis=1), side="right"), "own": np.floor(np.maximum(mine, 0) * STEPS).astype(np.int64), "other": np.floor(theirs * STEPS).astype(np.int64)})

    spread = sample.select("lang", "text").mapInPandas(cosines, "k long, own long, other long")
    own, foreign = np.zeros((len(LENGTHS) + 1, STEPS + 1)), np.zeros((len(LENGTHS) + 1, STEPS + 1))
    for r in spread.groupBy("k", "own", "other").agg(F.count("*").alias("n")).collect():  # classes * STEPS * STEPS rows at most
        own[r["k"], min(STEPS, max(0, r["own"]))] += r["n"]
        if r["other"] >= 0:
            foreign[r["k"], min(STEPS, r["other"])] += r["n"]
    model.least = limits(own, foreign)
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return id, lang_pred, score (the largest cosine) and rejected of every row.

    A text that is null or has no letter is ``und``, score 0, rejected. With a model of no language all are. Equal cosines: the
    first language by code point. Repeated rows are rows of their own; an empty table gives an empty result; other columns are not
    read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema[0].dataType
    id_type = to_arrow_type(kind)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # CENTROIDS vectors a language

    def run(batches):
        for ids, texts in pieces(batches):
            lang, score, rejected = sent.value.predict(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [id_col, "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, lang_pred string, score double, rejected boolean")


def keep(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with all their columns.

    Texts that are null or have no letter go; repeated rows stay or go together; an empty table gives an empty result. A model of
    no language (nothing labelled to learn from) can't tell anything and would empty the table, so that is an error if it has rows.
    """
    if not model.languages:
        if docs.isEmpty():
            return docs
        raise ValueError("no labelled text to learn languages from")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    (name,) = fresh(docs, "rejected")
    found = append(docs, text_col, [(name, T.BooleanType())], lambda texts: [sent.value.predict(texts)[2]])
    return found.where(~F.col(name)).drop(name)

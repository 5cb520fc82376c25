"""Toxicity by averaged subword embeddings and a linear softmax, trained together in numpy.

A word is the mean of the vectors of its hashed character n-grams, so a misspelt word lies near the right one. A text is the mean of a
bag of its words, and the softmax of this mean says how likely it is toxic. A few bad words make a long text toxic, so the bag holds
those words of it that the model itself finds worst: WORST, and half of a short text's at most. Training starts with all words of
each text in its bag and goes on with the worst ones, chosen anew several times. As labels are sampled evenly and toxic texts are
rare, two numbers, fitted last, stretch and shift the softmax's margin to the share of toxic texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidespan.llm.common import pieces

BUCKET_BITS, WIDTH = 16, 8
BUCKETS = 1 << BUCKET_BITS
SHORTEST, LONGEST = 3, 6
#: Words of a text's bag at most.
WORST = 4
#: Labelled rows of each label that the model is fitted on at most, and the longest text (in characters) taken for that.
SAMPLE, SAMPLE_CHARS = 700, 12_000
#: Gradient steps on all words, then phases, each of so many steps on bags of the words that it finds worst.
STEPS, PHASES, PHASE_STEPS = 4, 4, 8
#: What each step takes off the vectors, so that rare n-grams don't learn texts by heart.
DECAY = 0.03
#: Words whose score a worker remembers.
MEMORY = 500_000
_word = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _word.findall((text or "").lower())


def buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, each between its bounds, one word after the other; and how many each word has."""
    c = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    h, hashes, owners = np.zeros(len(c), np.uint64), [], []
    for n in range(1, LONGEST + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :]
        if n >= SHORTEST:
            inside = owner[: len(h)] == owner[n - 1 :]
            hashes.append(((h[inside] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS))
            owners.append(owner[: len(h)][inside])
    owners = np.concatenate(owners)
    return np.concatenate(hashes)[np.argsort(owners, kind="stable")].astype(np.int64), np.bincount(owners, minlength=len(words))


def bag(words: int) -> int:
    """How many words the bag of a text of so many holds."""
    return min(WORST, (words + 1) // 2)


@dataclass
class Model:
    logit: np.ndarray  # of each bucket: its vector times the difference of the two output vectors
    bias: float
    last: np.ndarray  # what stretches and shifts the margin
    base: float
    seen: dict = field(default_factory=dict)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "seen"}

    def __setstate__(self, state):
        self.__dict__.update(state, seen={})

    def values(self, words: list[str]) -> np.ndarray:
        """The logit of each word. Averages of vectors and averages of their logits agree, for the output is linear."""
        seen = self.seen
        if new := list({w for w in words if w not in seen}):
            if len(seen) + len(new) > MEMORY:
                seen.clear()
                new = list(set(words))
            flat, size = buckets(new)
            at = np.cumsum(size) - size
            seen.update(zip(new, (np.add.reduceat(self.logit[flat], at) / size).tolist(), strict=True))
        return np.array([seen[w] for w in words])

    def raw(self, text: str | None) -> np.ndarray | None:
        """The margin of the text's bag, and 1; None without words."""
        words = words_of(text)
        if not words:
            return None
        logit = self.values(words)
        few = bag(len(words))
        return np.array([np.partition(logit, len(logit) - few)[-few:].mean() + self.bias, 1.0])

    def score(self, text: str | None) -> float:
        raw = self.raw(text)
        return self.base if raw is None else 1 / (1 + float(np.exp(-np.clip(raw @ self.last, -30, 30))))


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The two numbers of the margin, by Newton's steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (weight * (p - y)) + 0.1 * w)
    return w


def fit_texts(texts: list[str], labels: list[int], share: float | None = None) -> Model:
    """Train on whole labelled texts: gradient steps on all words, then on bags of the worst ones, with Adam's step sizes.

    share: of toxic texts among all, where the sample has another; the two last numbers are weighted by it.
    """
    y = np.array(labels, np.float64)
    own = (y.sum() + 1) / (len(y) + 2)
    base = float(own if share is None else share)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS), 0.0, np.array([0, np.log(base / (1 - base))]), base)
    ids: dict[str, int] = {}
    docs = [np.array([ids.setdefault(w, len(ids)) for w in words_of(t)], np.int64) for t in texts]
    if not ids:
        return Model(np.zeros(BUCKETS), 0.0, np.array([0, np.log(base / (1 - base))]), base)
    flat, size = buckets(list(ids))
    at, size = np.cumsum(size) - size, size.astype(np.float32)
    words, per = np.concatenate(docs), np.array([len(d) for d in docs])
    owner = np.repeat(np.arange(len(docs)), per)
    few = np.array([bag(n) for n in per])
    balance = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())).astype(np.float32)
    rng = np.random.default_rng(0)
    values = [rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32), rng.normal(0, 0.3, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]

    def margins() -> np.ndarray:
        """Of each word by itself."""
        table, out, bias = values
        return (np.add.reduceat((table @ (out[:, 1] - out[:, 0]))[flat], at) / size)[words] + bias[1] - bias[0]

    def steps(pick: np.ndarray, of: np.ndarray, weight: np.ndarray, done: int, count: int) -> None:
        """Gradient steps on bags: words (indexes, by bag), and the document and the weight of each bag."""
        inner, bags = words[pick], np.unique(of, return_counts=True)
        n, target = bags[1], y[bags[0] % len(docs)].astype(np.float32)
        start = np.cumsum(n) - n
        own, inner = np.unique(inner, return_inverse=True)
        m = size[own].astype(np.int64)
        begin = np.cumsum(m) - m
        gram, which = np.unique(flat[np.repeat(at[own] - begin, m) + np.arange(m.sum())], return_inverse=True)
        for step in range(done + 1, done + count + 1):
            table, out, bias = values
            vectors = np.add.reduceat(table[gram][which], begin, axis=0) / size[own, None]
            mean = np.add.reduceat(vectors[inner], start, axis=0) / n[:, None].astype(np.float32)
            z = mean @ out + bias
            g = (1 / (1 + np.exp(z[:, 0] - z[:, 1])) - target) * weight[bags[0] % len(docs)]
            both = np.stack([-g, g], axis=1)
            d_word = np.repeat(both @ out.T / n[:, None], n, axis=0)
            d_word = np.stack([np.bincount(inner, c, len(own)) for c in d_word.T], axis=1) / size[own, None]
            d_gram = np.repeat(d_word, m, axis=0)
            d_table = np.zeros_like(table)
            d_table[gram] = np.stack([np.bincount(which, c, len(gram)) for c in d_gram.T], axis=1)
            for value, (mo, sq), slope in zip(values, moments, (d_table, mean.T @ both, both.sum(axis=0)), strict=True):
                mo += 0.1 * (slope - mo)
                sq += 0.01 * (slope * slope - sq)
                value *= 1 - DECAY
                value -= 0.03 * (mo / (1 - 0.9**step)) / (np.sqrt(sq / (1 - 0.99**step)) + 1e-8)

    steps(np.arange(len(words)), owner, balance, 0, STEPS)
    first = np.cumsum(per) - per
    for phase in range(PHASES):
        order = np.lexsort((-margins(), owner))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.repeat(first, per)
        worst = np.nonzero(rank < few[owner])[0]
        # Clean documents give a second bag, of words at random, for balance.
        other = np.nonzero((y[owner] == 0) & (rng.permutation(len(owner)) % 20 == 0))[0] if len(owner) > 20 else worst[:0]
        steps(np.concatenate([worst, other]), np.concatenate([owner[worst], owner[other] + len(docs)]), balance, STEPS + phase * PHASE_STEPS, PHASE_STEPS)
    table, out, bias = values
    model = Model(table.astype(np.float64) @ (out[:, 1] - out[:, 0]).astype(np.float64), float(bias[1] - bias[0]), np.zeros(2), base)
    rows = [(r, t) for r, t in zip(map(model.raw, texts), y, strict=True) if r is not None]
    model.last = _calibrate(np.stack([r for r, _ in rows]), np.array([t for _, t in rows]), np.array([base / own if t else (1 - base) / (1 - own) for _, t in rows]))
    return model


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled rows where ``train`` (on the labels) holds: SAMPLE of each label at most, by a hash of the id.

    An id with several labels has the largest. Texts over SAMPLE_CHARS characters are not taken for fitting (scoring takes all).
    """
    rows = labels.where(train & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("int").alias("_label"))
    rows = rows.groupBy("_id").agg(F.max("_label").alias("_label")).withColumn("_hash", F.xxhash64("_id"))
    # Each task keeps SAMPLE rows of a label at most.
    one = lambda label: rows.where(F.col("_label") == label).orderBy("_hash", "_id").limit(SAMPLE)
    picked = one(0).unionByName(one(1))
    toxic, known = rows.agg(F.sum("_label"), F.count("*")).first()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where(F.length("_text").between(1, SAMPLE_CHARS))
    # Of an id that several rows have, the least text: two times SAMPLE rows at most.
    got = texts.join(F.broadcast(picked), "_id").groupBy("_hash", "_id", "_label").agg(F.min("_text").alias("_text")).collect()
    got = sorted(map(tuple, got))
    return fit_texts([r[3] for r in got], [r[2] for r in got], ((toxic or 0) + 1) / (known + 2))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return id, score (0 to 1) and predicted (1 from the threshold on) of every row, from whole texts.

    Texts without letters, null and empty ones among them, get the share of toxic rows among the labelled ones. Repeated rows are rows of
    their own; an empty table gives an empty result; other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema[0].dataType
    id_type = to_arrow_type(kind)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches):
        for ids, texts in pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array([sent.value.score(t) for t in texts], pa.float64())], [id_col, "score"])

    return rows.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))

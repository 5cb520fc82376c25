"""Rule-based scores of guides and of their hits, as column expressions over upper-case DNA."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guidespan.functions import seq as S
from guidespan.sources.scan import _bytes

#: Weights of the last two bases of a PAM.
PAM_WEIGHTS = {"AA": 0.0, "AC": 0.0, "AG": 0.259259259, "AT": 0.0, "CA": 0.0, "CC": 0.0, "CG": 0.107142857, "CT": 0.0, "GA": 0.069444444, "GC": 0.022222222, "GG": 1.0, "GT": 0.016129032, "TA": 0.0, "TC": 0.0, "TG": 0.038961039, "TT": 0.0}
#: Seed (first, last position, from 1) and penalty of each of its mismatches; without a seed, identity alone counts.
SEEDS = {"cas12a": (1, 6, 0.25), "cas12b": (1, 20, 1.0), "cas14a": (9, 16, 0.25)}

#: The published logistic model of windows of 30 bases (4 before the guide, 20 of it, NGG, 3 after): what is added where
#: these bases stand at this place (from 0), the constant, and the terms for less and for more than half G and C.
LOGISTIC = {
    (1, "G"): -0.2753771, (2, "A"): -0.3238875, (2, "C"): 0.17212887, (3, "C"): -0.1006662, (4, "C"): -0.2018029, (4, "G"): 0.24595663, (5, "A"): 0.03644004, (5, "C"): 0.09837684, (6, "C"): -0.7411813, (6, "G"): -0.3932644,
    (11, "A"): -0.466099, (14, "A"): 0.08537695, (14, "C"): -0.013814, (15, "A"): 0.27262051, (15, "T"): -0.2859442, (15, "C"): 0.1190226, (16, "A"): 0.09745459, (16, "G"): -0.1755462, (17, "C"): -0.3457955, (17, "G"): -0.6780964,
    (18, "A"): 0.22508903, (18, "C"): -0.5077941, (19, "T"): -0.054307, (19, "G"): -0.4173736, (20, "T"): -0.0907126, (20, "G"): 0.37989937, (21, "T"): -0.5305673, (21, "C"): 0.05782332, (22, "T"): -0.8770074, (23, "T"): -0.4031022,
    (23, "C"): -0.8762358, (23, "G"): 0.27891626, (24, "A"): -0.0773007, (24, "T"): -0.2216372, (24, "C"): 0.28793562, (27, "T"): 0.11787758, (27, "G"): -0.6890167, (28, "C"): -0.1604453, (29, "G"): 0.38634258,
    (1, "GT"): -0.6257787, (4, "GC"): 0.30004332, (5, "AA"): -0.8348362, (5, "TA"): 0.76062777, (6, "GG"): -0.4908167, (11, "TA"): 0.7092612, (11, "TT"): -0.5868739, (11, "TC"): 0.49629861, (11, "GG"): -1.5169074, (12, "GG"): -0.3345637,
    (13, "GA"): 0.76384993, (13, "GC"): -0.5370252, (16, "TG"): -0.7981461, (18, "TC"): 0.35318325, (18, "GG"): -0.6668087, (19, "TG"): -0.3672668, (19, "CC"): 0.74807209, (20, "AC"): 0.56820913, (20, "CG"): 0.32907207, (20, "GA"): -0.8364568,
    (20, "GG"): -0.7822076, (21, "TC"): -1.029693, (22, "CT"): -0.4632077, (22, "CG"): 0.85619782, (23, "AA"): -0.5794924, (23, "AG"): 0.64907554, (24, "AG"): -0.0773007, (24, "TG"): -0.2216372, (24, "CG"): 0.28793562, (26, "GT"): 0.11787758,
    (28, "GG"): -0.69774,
}
#: Bases that hairpins are looked for in at once, and the bases as numbers.
HELD = 1 << 20
_BASES = np.zeros(256, np.uint8)
_BASES[list(b"ACGTU")] = 1, 2, 3, 4, 4
#: Places of the bases in a table of weights (4: none), and letters as a risk compares them.
_NUMBER = np.full(256, 4, np.uint8)
_NUMBER[list(b"ACGT")] = range(4)
_PLAIN = np.frombuffer(bytes(range(256)).upper().replace(b"U", b"T"), np.uint8)
INTERCEPT, LOW_GC, HIGH_GC = 0.59763615, -0.2026259, -0.1665878


def rule_weights(length: int = 20) -> list[float]:
    """Weights of mismatches, 16 a position (bases ACGT of the guide times those of the target): they fall along the guide, and those of
    transitions fall less. Published tables of the same layout can be given in their place."""
    share = lambda g, t: 0.0 if g == t else 0.6 if {g, t} in ({"A", "G"}, {"C", "T"}) else 0.9
    return [round(1 - share(g, t) * place / length, 9) for place in range(1, length + 1) for g in "ACGT" for t in "ACGT"]


def weighted_similarity(guide: Column, target: Column, weights: list[float], pam: Column | None = None) -> Column:
    """Product of the weights of all mismatches, and of the PAM's weight if one is given (0 for an unknown PAM).

    Positions beyond the table and bases other than ACGT count as 1. Strings of unequal length and empty ones give 0.
    """
    table, last = F.lit(weights), len(weights) // 16

    def weight(i: Column) -> Column:
        g, t = F.substring(guide, i, F.lit(1)), F.substring(target, i, F.lit(1))
        own, other = F.position(g, F.lit("ACGT")), F.position(t, F.lit("ACGT"))
        return F.when((g == t) | (own == 0) | (other == 0), 1.0).otherwise(F.get(table, (i - 1) * 16 + (own - 1) * 4 + other - 1))

    product = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.length(guide), F.lit(last)), F.lit(1))), F.lit(1.0), lambda s, i: s * weight(i))
    if pam is not None:
        key = F.right(F.translate(F.upper(F.trim(pam)), "U", "T"), F.lit(2))
        known = F.lit(0.0)
        for bases, w in PAM_WEIGHTS.items():
            known = F.when(key == bases, w).otherwise(known) if w else known
        product = product * known
    return F.when((F.length(guide) == F.length(target)) & (F.length(guide) > 0), F.least(F.greatest(product, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def identity(guide: Column, target: Column) -> Column:
    """Share of equal bases up to the shorter one's length; 0 if that is 0."""
    n = F.least(F.length(guide), F.length(target))
    return F.when(n > 0, (n - S.mismatches(guide, target)) / n).otherwise(0.0)


def seeded_similarity(guide: Column, target: Column, start: int, end: int, penalty: float) -> Column:
    """Identity, times the penalty for each mismatch within the seed."""
    inside = S.mismatches(F.substring(guide, start, end - start + 1), F.substring(target, start, end - start + 1))
    return identity(guide, target) * F.pow(F.lit(penalty), inside)


def specificity(similarity: Column, perfect: Column | None = None) -> Column:
    """Aggregate: 1 / (1 + sum of similarities), where one perfect hit (of similarity 1, unless told) is the guide's own site."""
    total, own = F.coalesce(F.sum(similarity), F.lit(0.0)), F.coalesce(F.bool_or(similarity >= 0.999999 if perfect is None else perfect), F.lit(False))
    return 1 / (1 + F.when(own, F.greatest(total - 1, F.lit(0.0))).otherwise(total))


def bulge_risk(guide: Column, target: Column, mismatch: Column, rna: Column, dna: Column, indel: Column) -> Column:
    """Cautious risk of an aligned hit with bulges: identity of the aligned bases, halved by each bulge, times 0.75 a mismatch; 0.01 at least."""
    n = F.least(F.length(guide), F.length(target))
    at = lambda s, i: F.translate(F.upper(F.substring(s, i, F.lit(1))), "U", "T")
    both = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (at(guide, i) != "-") & (at(target, i) != "-"))
    same = F.filter(both, lambda i: at(guide, i) == at(target, i))
    alike = F.when(F.size(both) > 0, F.size(same) / F.size(both)).otherwise(0.0)
    unknown = F.greatest(indel - rna - dna, F.lit(0))
    return F.least(F.greatest(alike * F.pow(F.lit(0.5), rna + dna + unknown) * F.pow(F.lit(0.75), mismatch), F.lit(0.01)), F.lit(1.0))


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(letters of some texts, a row each, padded with 0; their lengths). Null is empty."""
    at, data = _bytes(column, ascii_only=True)
    size = np.diff(at)
    inside = np.arange(size.max(initial=0)) < size[:, None]
    out = np.zeros(inside.shape, np.uint8)
    out[inside] = data
    return out, size


def compared(guide: Column, aligned_guide: Column, aligned_target: Column, weights: list[float] | None = None) -> Column:
    """What the scores of a hit count, all of it from one look at its letters, in numpy on Arrow batches: a struct for ``weighted_of``,
    ``identity_of``, ``seeded_of`` and ``risk_of``, which equal ``weighted_similarity``, ``identity``, ``seeded_similarity`` (of the guide
    and the aligned target) and ``bulge_risk`` (of both aligned strings)."""
    table = np.array(weights or rule_weights()).reshape(-1, 4, 4)

    def run(guides: pa.Array, own: pa.Array, other: pa.Array) -> pa.Array:
        (g, n_g), (a, n_a), (t, n_t) = _letters(guides), _letters(own), _letters(other)
        width, n = min(g.shape[1], t.shape[1]), np.minimum(n_g, n_t)
        differ = (g[:, :width] != t[:, :width]) & (np.arange(width) < n[:, None])
        product = np.ones(len(n))
        for i in range(min(width, len(table))):
            x, y = _NUMBER[g[:, i]], _NUMBER[t[:, i]]
            product *= np.where(differ[:, i] & (x < 4) & (y < 4), table[i][x & 3, y & 3], 1.0)
        product = np.where((n_g == n_t) & (n_g > 0), product, 0.0)
        joint = min(a.shape[1], t.shape[1])
        a, t = _PLAIN[a[:, :joint]], _PLAIN[t[:, :joint]]
        both = (a != 45) & (t != 45) & (np.arange(joint) < np.minimum(n_a, n_t)[:, None])
        counts = [n, differ.sum(axis=1), *(differ[:, first - 1 : last].sum(axis=1) for first, last, _ in SEEDS.values()), both.sum(axis=1), (both & (a == t)).sum(axis=1)]
        return pa.StructArray.from_arrays([pa.array(product), *(pa.array(c.astype(np.int32)) for c in counts)], names)

    names = ["weighted", "n", "differ", *SEEDS, "both", "same"]
    schema = T.StructType([T.StructField("weighted", T.DoubleType()), *(T.StructField(c, T.IntegerType()) for c in names[1:])])
    run.__annotations__ = {"guides": pa.Array, "own": pa.Array, "other": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, schema)(guide, aligned_guide, aligned_target)


def weighted_of(c: Column, pam: Column) -> Column:
    key = F.right(F.translate(F.upper(F.trim(pam)), "U", "T"), F.lit(2))
    known = F.create_map(*(F.lit(x) for pair in PAM_WEIGHTS.items() for x in pair))
    return F.least(F.greatest(c["weighted"] * F.coalesce(F.try_element_at(known, key), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def identity_of(c: Column) -> Column:
    return F.when(c["n"] > 0, (c["n"] - c["differ"]) / c["n"]).otherwise(0.0)


def seeded_of(c: Column, preset: str) -> Column:
    return identity_of(c) * F.pow(F.lit(SEEDS[preset][2]), c[preset])


def risk_of(c: Column, mismatch: Column, rna: Column, dna: Column, indel: Column) -> Column:
    alike = F.when(c["both"] > 0, c["same"] / c["both"]).otherwise(0.0)
    unknown = F.greatest(indel - rna - dna, F.lit(0))
    return F.least(F.greatest(alike * F.pow(F.lit(0.5), rna + dna + unknown) * F.pow(F.lit(0.75), mismatch), F.lit(0.01)), F.lit(1.0))


def bias(seq: Column, base: str = "T", pairs: tuple[str, ...] = ("TT", "AT"), activity: Column | None = None) -> Column:
    """Liking for one base (content above a fifth, preferred neighbours) and the general activity, half each, which may be given. Empty: 0."""
    n = F.length(seq)
    content = F.least(F.greatest((S.base_count(seq, base) / n - 0.20) / 0.20, F.lit(0.0)), F.lit(1.0))
    liked = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(seq, i, F.lit(2)).isin(*pairs)))
    near = F.when(n > 1, F.least(liked / (n - 1) * 2, F.lit(1.0))).otherwise(0.0)
    return F.when(n > 0, F.least(0.35 * content + 0.15 * near + 0.50 * (S.activity(seq) if activity is None else activity), F.lit(1.0))).otherwise(0.0)


def flanked_activity(seq: Column, flank: Column, activity: Column | None = None) -> Column:
    """Activity of an RNA-cutting guide: the weight of the base beside the site, and the bias."""
    return 0.35 * S.flank_weight(flank) + 0.65 * bias(seq, activity=activity)


def hairpins(seqs: Iterable[str | None]) -> np.ndarray:
    """``hairpin`` of many strings: those of one length are worked on together, a base of all of them at a time."""
    texts = [(x or "").upper().encode("ascii", "replace") for x in seqs]
    sizes, out = np.array([len(x) for x in texts], np.int64), np.zeros(len(texts), np.int32)
    for n in map(int, np.unique(sizes[sizes > 0])):
        rows = np.flatnonzero(sizes == n)
        for part in np.array_split(rows, -(-len(rows) * n // HELD)):
            held = np.frombuffer(b"".join(texts[i] for i in part), np.uint8).reshape(-1, n)
            # Bases are 1 to 4, whose partners add up to 5; other letters pair with none.
            own, other = _BASES[held], 5 - _BASES[held][:, ::-1].astype(np.int16)
            run, best = np.zeros((len(part), n + 1), np.int32), np.zeros(len(part), np.int32)
            for i in range(n):
                run[:, 1:] = np.where((own[:, i : i + 1] == other) & (own[:, i : i + 1] > 0), run[:, :-1] + 1, 0)
                best = np.maximum(best, run.max(axis=1))
            out[part] = best
    return out


@F.pandas_udf(T.IntegerType())
def _hairpins(seqs: pd.Series) -> pd.Series:
    return pd.Series(hairpins(seqs))


def hairpin(seq: Column) -> Column:
    """Longest stretch whose reverse complement occurs in the sequence too: the longest substring it shares with its own other strand.

    For guides: the cost is the square of a sequence's length, in numpy on Arrow batches. Bases other than ACGT never pair; null gives 0.
    """
    return _hairpins(seq)


def compact_activity(seq: Column, repeat: str | None = None, longest: Column | None = None) -> Column:
    """Activity of a guide of a compact nuclease: its length, lack of hairpins and balance, and the hairpin of the repeat if that is known.

    longest: the guide's hairpin, if it is known.
    """
    n = F.length(seq)
    length = F.when(n.between(14, 18), 1.0).when(n.between(12, 20), 0.75).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(n - 16) / 16))
    loose = 1 - F.least(F.greatest(((hairpin(seq) if longest is None else longest) - 3) / 6, F.lit(0.0)), F.lit(1.0))
    balance = F.greatest(F.lit(0.0), 1 - F.abs(S.gc_fraction(seq) - 0.5) / 0.3)
    total, weight = 0.30 * length + 0.25 * loose + 0.20 * balance, 0.75
    if repeat:
        total, weight = total + 0.25 * F.least(F.lit(int(hairpins([repeat])[0])) / 6, F.lit(1.0)), 1.0
    return total / weight


def logistic(seq: Column, weights: dict[tuple[int, str], float] = LOGISTIC, intercept: float = INTERCEPT, low_gc: float = LOW_GC, high_gc: float = HIGH_GC, length: int = 30) -> Column:
    """Logistic model of a window: the weights (place from 0, bases) that hold there, and one of two terms for its share of G and C.

    Another model of the same form can be given. Windows of another length or with bases other than ACGT give null.
    """
    z = F.lit(intercept) + F.when(S.gc_fraction(seq) < 0.5, low_gc).otherwise(high_gc)
    for (place, bases), w in weights.items():
        if w:
            z = z + F.when(F.substring(seq, place + 1, len(bases)) == bases, w).otherwise(0.0)
    return F.when(seq.rlike(f"^[ACGT]{{{length}}}$"), 1 / (1 + F.exp(-z)))

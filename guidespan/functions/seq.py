"""Column expressions over nucleotide strings. Nulls give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bases that each ambiguity code stands for.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
_PAIR = str.maketrans("ACGTURYSWKMBDHVN", "TGCAAYRSWMKVHDBN")


def pattern(motif: str) -> str:
    """Regular expression of a motif in ambiguity codes."""
    unknown = set(motif.upper()) - set(IUPAC)
    if not motif or unknown:
        raise ValueError(f"not a motif: {motif!r}")
    return "".join(IUPAC[c] if len(IUPAC[c]) == 1 else f"[{IUPAC[c]}]" for c in motif.upper())


def anchor(motif: str, offset: int = 0) -> tuple[int, str] | None:
    """The longest run of plain bases of a motif that starts at offset, (place, bases); None without any."""
    runs, codes = [], motif.upper().replace("U", "T")
    for i, c in enumerate(codes):
        if c in "ACGT":
            if i and codes[i - 1] in "ACGT":
                runs[-1] = (runs[-1][0], runs[-1][1] + c)
            else:
                runs.append((offset + i, c))
    return max(runs, key=lambda r: len(r[1]), default=None)


def flipped(motif: str) -> str:
    """The motif as it reads on the other strand."""
    return motif.upper().translate(_PAIR)[::-1]


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTUN", "TGCAAN"))


def base_count(seq: Column, bases: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, bases, ""))


def gc_fraction(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, base_count(seq, "GC") / F.length(seq)).otherwise(0.0)


def longest_run(seq: Column) -> Column:
    """Longest run of one base; 1 for the empty string."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(seq, F.lit(r"((.)\2*)"), F.lit(1)), F.length)), F.lit(1))


def dinucleotides(seq: Column) -> Column:
    """Number of distinct pairs of neighbours."""
    return F.when(F.length(seq) >= 2, F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(seq) - 1), lambda i: F.substring(seq, i, F.lit(2)))))).otherwise(0)


def _within(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def activity(seq: Column) -> Column:
    """Rule-based activity of a guide: balance of G and C, overall and in the last eight bases, short runs, many dinucleotides."""
    seed = F.right(seq, F.least(F.length(seq), F.lit(8)))
    gc = F.greatest(F.lit(0.0), 1.0 - F.abs(gc_fraction(seq) - 0.5) / 0.3)
    near = F.greatest(F.lit(0.0), 1.0 - F.abs(gc_fraction(seed) - 0.5) / 0.5)
    run = F.greatest(F.lit(0.0), 1.0 - (longest_run(seq) - 3) / 6.0)
    varied = F.when(F.length(seq) >= 2, F.least(F.lit(1.0), dinucleotides(seq) / F.least(F.lit(16), F.length(seq) - 1))).otherwise(1.0)
    return F.when(F.length(seq) > 0, _within(0.35 * gc + 0.25 * near + 0.20 * run + 0.20 * varied)).otherwise(0.0)


def gc_hint(percent: Column, low: float = 40.0, high: float = 70.0) -> Column:
    return F.when(percent < low, "low").when(percent > high, "high").otherwise("pass")


def kmer_code(kmer: Column) -> Column:
    """Two bits a base, A 0 to T 3."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def mismatches(a: Column, b: Column) -> Column:
    """Places at which two strings differ, up to the shorter one's length."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda s, i: s + (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))).cast("int"))).otherwise(0)


def flank_weight(base: Column) -> Column:
    """Weight of the base beside a Cas13 site: any but G."""
    b = F.upper(base)
    return F.when(b.isin("A", "C", "U", "T"), 1.0).when(b == "G", 0.25).otherwise(0.5)


def inverted_repeat(seq: Column, least: int = 3) -> Column:
    """Length of the longest stretch whose reverse complement stands after it without overlap; 0 where none has ``least`` bases."""
    size = F.length(seq)
    meets = lambda n: F.exists(F.sequence(F.lit(1), size - 2 * n + 1), lambda i: F.position(reverse_complement(F.substring(seq, i, n)), seq, i + n) > 0)
    return F.when(size >= 2 * least, F.coalesce(F.array_max(F.filter(F.sequence(F.lit(least), F.floor(size / 2).cast("int")), meets)), F.lit(0))).otherwise(0)


def repeat_hint(longest: Column, most: int = 4) -> Column:
    return F.when(longest <= most, "pass").otherwise("warn")

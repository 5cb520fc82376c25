import random
import re

from pyspark.sql import functions as F

from guidespan.operators import alignment as A


def plain(query, window, centre, mismatches, gaps, pam=None):
    """All starts and ends, each by the plain recurrence over the whole table."""
    n, best = len(query), None
    centre = max(0, min(centre, max(0, len(window) - n)))
    for start in range(max(0, centre - gaps), min(len(window), centre + gaps) + 1):
        for end in range(start + max(1, n - gaps), min(len(window), start + n + gaps) + 1):
            got = A.align(query, window[start:end], n + end)
            if got is None or got[1] + got[2] > gaps or got[0] > mismatches or (pam and not re.match(pam, window[end:])):
                continue
            cost = 2 * got[0] + 3 * (got[1] + got[2])
            key = (cost, got[0], got[1] + got[2], abs(end - start - n), abs(start - centre), start, end)
            if best is None or key < best[0]:
                best = key, (start, end, *got, *A.strings(query, window[start:end], got[3]))
    return best and best[1]


def cases(count, seed=1):
    rng = random.Random(seed)
    for k in range(count):
        query = "".join(rng.choices("ACG" if k % 2 else "AC", k=9))
        target = list(query)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(target))
            target[i : i + rng.randrange(2)] = rng.choices("ACGT", k=rng.randrange(2))
        window = "".join(rng.choices("ACGT", k=rng.randrange(4))) + "".join(target) + "".join(rng.choices("ACG", k=rng.randrange(6)))
        yield query, window, rng.randrange(-2, 7)


def test_best_in_windows_equals_all_starts_and_ends():
    for gaps, pam in ((0, None), (1, None), (2, None), (2, "NG"), (3, None)):
        held = list(cases(150, gaps))
        got = A.best_in_windows(*map(list, zip(*held)), 3, gaps, pam)
        want = [plain(*c, 3, gaps, pam and "[ACGT]G") for c in held]
        assert [g and (g[0], g[1], *g[2:6], *g[6:]) for g in got] == want
        assert any(want) and (gaps or not all(want))


def test_pairs_equal_the_plain_alignment(spark):
    held = [(q, w) for q, w, _ in cases(200, 5)]
    pairs = spark.createDataFrame([*held, (None, "A"), ("A", None), ("", "")], "guide string, target string")
    got = {(r.guide, r.target): (r.mismatch, r.rna_bulges, r.dna_bulges, r.cigar, r.aligned_guide, r.aligned_target) for r in A.aligned(pairs, 3, 2).collect() if r.guide}
    for query, target in held:
        want = A.align(query, target, 2)
        assert got.get((query, target)) == ((*want, *A.strings(query, target, want[3])) if want and want[0] <= 3 else None)


def test_near_centres_of_odd_rows(spark):
    rows = spark.createDataFrame([("ACGT", "TTACGTAA", 2, "x"), ("ACGT", "TTACGTAA", 2, "x"), (None, "ACGT", 0, "x"), ("ACGT", None, 0, "x"), ("ACGT", "", 0, "x"), ("ACGT", "ACGT", None, "x"), ("ACGT", "AC", 0, "x")], "guide string, window string, centre int, note string")
    got = [(r.start, r.target_end, r.mismatch, r.cigar, r.note) for r in A.near_centres(rows, 0, 0).collect()]
    assert got == [(2, 6, 0, "4M", "x")] * 2
    assert A.near_centres(rows.where("1 = 0"), 0, 0).collect() == []


def test_pam_on_columns(spark):
    held = [
        ("ACGTTGG", "ACGTAGG", True),  # the PAM fits
        ("ACGTTGG", "ACGTAGA", False),
        ("ACGTT-GG", "ACGTTAGG", False),  # a target base within the PAM
        ("ACGT-TGG", "ACGTATGG", False),  # one right before it
        ("A-CGTTGG", "ATCGTTGG", True),
        ("ACGTTGG", "ACGTT-G", False),
        ("ACGTTGG", "AC-TTGG", True),
        ("ACG--TTGG", "ACG--TTGG", False),
        ("ACGTTGG", "ACGTTGGA", False),
        ("ACGT", "ACGT", False),  # the span ends behind the guide
        (None, "ACGTTGG", False),
    ]
    rows = spark.createDataFrame(held, "a string, b string, want boolean")
    got = rows.select("a", "b", "want", A.pam_on_columns(F.col("a"), F.col("b"), 4, 7, "NGG").alias("ok")).collect()
    assert [(r.a, r.b) for r in got if r.ok != r.want] == []
    place = lambda strand: A.places_of_columns(F.lit("AC-TTGG"), F.lit(5), F.lit(100), F.lit(106), F.lit(strand))
    assert rows.select(place("+"), place("-"), A.places_of_columns(F.lit("AC-T"), F.lit(3), F.lit(0), F.lit(3), F.lit("+"))).first() == (103, 102, None)

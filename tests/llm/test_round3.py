import hashlib
import random
import re
import resource
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from guidespan.llm import decontam, fill_middle, language, near_dedup, phrases, queries
from tests.llm.test_llm import ROWS, empty, odd, rows  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# 9 and 2


def test_items_that_share_a_line():
    rng = random.Random(1)
    line = "read the passage below with care and answer the question that follows in one line: "
    made = [line + " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(30)) for _ in range(5000)]
    index = decontam.Index(tuple(enumerate(made)))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = index.find([(line * 300)[:20000], "nothing", made[7][60:200], line])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20  # KB
    assert [len(f) for f in found] == [5000, 0, 1, 5000] and found[2][0][:2] == (0, 7)
    assert all(e == 0 for e, *_ in found[0])


def test_languages_of_repeated_rows_are_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    few = docs.where("lang = 'de'").limit(5)
    many = docs.where("lang <> 'de'").unionByName(few.join(spark.range(4000).select(F.lit(1).alias("one")), F.lit(1) == F.col("one")).select("doc_id", "text", "lang"))
    model = language.fit(many, F.lit(True))
    assert sorted(set(model.languages)) == ["de", "en", "es", "fr"]
    assert (model.least[1:] > 0.1).all() and model.least[0] == 0
    held = docs.where("lang = 'de'").select("text").collect()
    assert np.mean([x == "de" for x in model.predict([r.text for r in held])[0]]) >= 0.9


def test_short_foreign_texts_are_turned_away_on_a_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs, F.lit(True))
    rng = random.Random(2)
    random_words = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n)) for n in (8, 20, 60) * 20]
    russian = "в начале было слово и это слово было сказано всем людям города которые собрались утром на площади"
    texts = [*random_words, *(russian[i : i + 40] for i in range(0, 56, 4)), *("".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(40)) for _ in range(20))]
    assert np.mean(model.predict(texts)[2]) >= 0.9
    own = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 45").select("text").collect()
    assert np.mean(model.predict([r.text for r in own])[2]) <= 0.03


# 11


def shingle_sets(texts):
    out = {}
    for key, text in texts.items():
        w = WORD.findall((text or "").translate(LOWER))
        out[key] = frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)]) if w else frozenset()
    return out


def plain_classes(sets):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcde", k=4))
    texts = {}
    for _ in range(4):  # families whose copies differ so much that links form chains
        base = [word() for _ in range(60)]
        for _ in range(40):
            own = list(base)
            for i in rng.sample(range(60), rng.randrange(7)):
                own[i] = word()
            texts[len(texts)] = " ".join(own)
            base = own if rng.random() < 0.3 else base
    texts |= {len(texts) + i: " ".join(word() for _ in range(rng.randrange(1, 30))) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want, sets = plain_classes(shingle_sets(texts)), shingle_sets(texts)
    for block in (near_dedup.BLOCK, 8):  # blocks that meet blocks
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        got = near_dedup.near_duplicates(docs, 80).collect()
        assert {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in got} == {k: (want[k], len(sets[k]), want[k] == k) for k in texts}
    assert len(set(want.values())) > 60


def test_near_duplicates_of_odd_rows(spark, odd, empty):  # noqa: F811
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect())
    n = lambda t: len(shingle_sets({0: t})[0])
    assert got == Counter((i, n(t), 1 if i == 2 else i, i != 2) for i, t, *_ in ROWS)
    assert rows(near_dedup.near_duplicates(empty)) == []


def test_signatures():
    rng = np.random.default_rng(1)
    seeds = near_dedup._seeds(138)
    for shared in (0, 300, 800, 1000):
        common = rng.integers(0, 1 << 63, shared).astype(np.uint64)
        two = [near_dedup.packed(near_dedup.minima(np.concatenate([common, rng.integers(0, 1 << 63, 1000 - shared).astype(np.uint64)]), seeds)) for _ in range(2)]
        differ = int(near_dedup._differing(*(x.astype(np.uint64)[None, :] for x in two))[0, 0])
        assert near_dedup.similarity(differ, 138) == pytest.approx(shared / (2000 - shared), abs=0.17)
    assert near_dedup.similarity(near_dedup.most_differing(0.8, 138), 138) < 0.65


# 12


def test_rotation_gives_both_forms_and_restores():
    rng = random.Random(4)
    seen = Counter()
    for _ in range(2000):
        text = "".join(rng.choices("ab\n<é😀", k=rng.randrange(30)))
        h = tuple(rng.getrandbits(32) for _ in range(4))
        out, form, n, first, last = fill_middle.transform(text.encode(), h)
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        assert n == len(units)
        seen[form] += 1
        if form != "plain":
            x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
            a, b, c = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
            assert out.decode() == (f"<P>{a}<S>{c}<M>{b}" if form == "psm" else f"<S>{c}<P>{a}<M>{b}")
            assert (text.encode()[:first].decode(), text.encode()[first:last].decode()) == (a, b)
        assert fill_middle.restore(out, form) == text.encode()
    assert all(seen[f] > 50 for f in ("plain", "psm", "spm"))
    assert fill_middle.transform(b"a<S>b\n", (1, 1, 0, 0))[1] == "plain"
    assert fill_middle.transform(b"a\n", (1, 1, 99, 0), rate=50)[1] == "plain"


def test_fill_in_middle_of_odd_rows(spark, odd, empty):  # noqa: F811
    made = fill_middle.fill_in_middle(odd.withColumn("fim_form", F.lit("x")))
    assert made.columns == [*odd.columns, "fim_form", "fim_form_"]
    back = fill_middle.restored(made, form_col="fim_form_")
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t or "") for i, t, *_ in ROWS)
    got = {r.doc_id: r for r in fill_middle.describe(odd).collect()}
    assert (got[3].n, got[3].form, got[3].prefix_chars, got[4].form) == (0, "plain", None, "plain")
    assert all(r.restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t, *_ in ROWS if (r := got[i]))
    assert rows(fill_middle.describe(empty)) == [] and rows(fill_middle.fill_in_middle(empty)) == []


# 13


def plain_collocations(table, least, inside, top):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in table:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            longer = [n for q, n in f.items() if len(q) == len(p) + 1 and n >= least and p in (q[:-1], q[1:])]
            if any(100 * n >= inside * a for n in longer):
                continue
            score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def plain_counts(table):
    out = Counter()
    for lang, text in table:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            out.update(("und" if lang is None else lang, " ".join(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    return out


def test_collocations_equal_plain_counts(spark, odd, empty, monkeypatch):  # noqa: F811
    rng = random.Random(5)
    table = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choices(["A b", " ", "é", "c. ", "d\t", "e,", " x y z ", "\n", "\x0b", "ß "], k=rng.randrange(60)))) for _ in range(200)] + [("en", None), ("en", "")]
    docs = spark.createDataFrame(table, "lang string, text string").withColumn("phrase", F.lit("x"))
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    for entries, burst, large in ((phrases.ENTRIES, phrases.BURST, 1024), (30, 3, 10)):  # spills, bursts and large prefixes
        monkeypatch.setattr(phrases, "LARGE", large)
        for least in (1, 4):
            counted = phrases.counts(docs, least, entries=entries, burst=burst).collect()
            assert {(r.lang, r.phrase): r.n for r in counted if r.words} == {k: n for k, n in plain_counts(table).items() if n >= least} and len({(r.lang, r.phrase) for r in counted}) == len(counted)
        got = sorted(tuple(r[c] for c in names) for r in phrases.collocations(docs, 4, 50, 12).collect())
        assert got == plain_collocations(table, 4, 50, 12)
    assert rows(phrases.collocations(empty)) == []
    assert phrases.collocations(odd, 2).count() >= 0


def test_trie_spills_whole_subtrees():
    trie = phrases.Trie("en", (1, 2, 3), phrases.Filter(None, 20), burst=4)
    rng = random.Random(6)
    texts = [" ".join(rng.choices("abcdefghij", k=200)) for _ in range(5)]
    trie.add(texts)
    whole = sum(n for n, *_ in trie.subtrees())
    assert whole == trie.size and trie.split
    codes, times = trie.spill(trie.size // 2)
    assert trie.size <= whole // 2 and len(codes) == whole - trie.size == sum(1 for _ in times)
    _, size, phrase, n = trie.run(codes, times)
    assert phrase.to_pylist() == [p for _, p in sorted((p.encode().split(b" "), p) for p in phrase.to_pylist())]
    assert all(len(p.split()) == k for p, k in zip(phrase.to_pylist(), size.to_pylist(), strict=True))


def test_new_queries_are_registered():
    assert {"op11_near_dedup", "op12_fill_middle", "op13_collocations"} <= set(queries.QUERIES)
    assert {"op12_fill_middle", "op13_collocations"} <= set(queries.SQL)

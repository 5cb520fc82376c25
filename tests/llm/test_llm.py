import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from guidespan.llm import audio, decontam, html_text, language, mixing, ngram_join, pii, queries, sharding, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
LONG = "word " * 20000
ROWS = [
    (1, "The cat sat on the mat and looked at the dog for a while today", "en", "b", 1),
    (2, "The cat sat on the mat and looked at the dog for a while today", "en", "a", 1),
    (2, "The cat sat on the mat and looked at the dog for a while today", "en", "a", 1),
    (3, None, "en", None, None),
    (4, "", None, "a", 0),
    (None, "short text here", None, None, 1),
    (5, "   \n\t ", "de", "c", 5),
    (6, LONG, "en", "b", 1),
    (7, "12345 %% 678", None, "", 1),
    (8, "you idiot 😀 call +1 (017) 555-7713 or a.b@c.org, 4111 1111 1111 1111 from 10.0.0.255", "en", "b", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long and repeated texts, and columns whose names clash with those that operators make."""
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("x") for c in ("score", "shard", "_id", "_text", "size", "class_id", "_key", "rank", "_new_rejected_")})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("1 = 0")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return [tuple(r) for r in df.collect()]


# 1


PAGE = """<html><head><title>T</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class="ad">Buy &amp; go</div>
<article><h1>A  title</h1><p>First <b>bold</b> words&nbsp;here &lt;ok&gt;.<p>Second<br>line of the text that goes on.</article><footer>&copy; us</footer></body></html>"""


def test_blocks_of_broken_markup():
    assert [b.text for b in html_text.blocks_of(PAGE)] == ["Home", "Buy & go", "A title", "First bold words here <ok>.", "Second line of the text that goes on.", "© us"]
    assert [b.text for b in html_text.blocks_of("<p>a<script>var x='<p>';</script>b</div></p>c&am")] == ["ab", "c&am"]


def test_heads_without_end_and_deep_paths():
    text = lambda html: [b.text for b in html_text.blocks_of(html)]
    assert text("<html><head><title>T</title><meta x><p>One<p>Two") == ["One", "Two"]
    assert text("<head><style>a</style>Plain text<div>More</div>") == ["Plain text", "More"]
    # The outermost container stays in the path, however many classes stand within it.
    deep = "<nav>" + "".join(f'<div class="a{chr(97 + i % 26)} b{chr(97 + i // 26)}">' for i in range(60)) + "x"
    (block,) = html_text.blocks_of(deep)
    assert block.path[0] == "t:nav" and html_text.weak_label(block) == 0
    # Unclosed inline tags: one path word each, not one a tag.
    many = html_text.blocks_of("".join(f"<p><b><font>w{i}" for i in range(3000)))
    assert len(many) == 3000 and max(len(b.path) for b in many) == 3


def test_pages_without_telling_tags():
    body = " ".join(f"The {w} was seen near the river, and nobody said a word about it." for w in ("fox", "cat", "owl", "hare"))
    page = f"<div>Home</div><div>About us</div><div>{body}</div><div>{body[20:]}</div><div>Copyright</div>"
    tagger = html_text.fit_pages([page, page.replace("fox", "dog")])
    text = tagger.extract([page], {})[0]
    assert body in text and "Copyright" not in text
    assert html_text.fit_pages([]).extract([page, None, ""], {})[1:] == ["", ""]


def test_lstm_gradient():
    t = html_text.Tagger()
    x = np.random.default_rng(0).normal(size=(3, 2, html_text.PATH_WIDTH + html_text.WORD_WIDTH + html_text.NUMBERS)).astype(np.float32)
    out, kept = t.run(x, "forth", keep=True)
    grad = {}
    t.back(x, kept, np.ones_like(out), "forth", grad)
    w, eps = t.w["forth_h"], 1e-2
    for i, j in ((0, 0), (3, 20), (5, 40)):
        w[i, j] += eps
        up = t.run(x, "forth")[0].sum()
        w[i, j] -= 2 * eps
        down = t.run(x, "forth")[0].sum()
        w[i, j] += eps
        assert grad["forth_h"][i, j] == pytest.approx((up - down) / (2 * eps), rel=0.1, abs=2e-3)


def test_main_text_query(spark):
    import html

    got = {r.page_id: r for r in queries.op1_html_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    right = 0
    for p in pages:
        body = re.search(r"<article>(.*?)(</article>|<footer|$)", p.html, re.S)[1]
        text = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", body))).split())
        right += got[p.page_id].text == text
        assert got[p.page_id].n_chars == len(got[p.page_id].text)
    assert len(got) == len(pages) and right >= 0.97 * len(pages)


def test_main_text_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", ""), (None, "v", PAGE), (4, "w", "<p>" * 5000 + "x")], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = rows(html_text.main_text(pages, html_text.fit(pages)))
    assert len(got) == 5 and (1, None, "", 0) in got and got.count((2, "u", "", 0)) == 2
    assert rows(html_text.main_text(pages.where("1 = 0"), html_text.fit(pages.where("1 = 0")))) == []


# 2, 4


def test_language(spark, odd, empty):
    got = queries.op2_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select("doc_id", "text").collect()
    repeated = {i for i, t in texts if repeats(t)}
    assert sum(r.rejected for r in got if r.doc_id not in repeated) <= 0.005 * len(got)
    model = language.fit(odd, F.lit(True))
    found = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert [found[i].lang_pred for i in (3, 4, 5, 7)] == ["und"] * 4 and found[1].lang_pred == "en"
    assert language.keep(odd, model).columns == odd.columns
    assert rows(language.identify(empty, language.fit(empty, F.lit(True)))) == []


def repeats(text):
    """Whether many words of a text equal the one before."""
    w = (text or "").split()
    return sum(a == b for a, b in zip(w, w[1:])) > 0.3 * len(w)


def test_unknown_languages_and_random_letters_are_rejected(spark):
    import random

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 4 = 0").select("doc_id", "text", "lang")
    out = queries.id_crc("doc_id") % 3 == 1
    rng = random.Random(1)
    letters = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n)) for n in [60, 200, 800] * 20]
    junk = spark.createDataFrame(list(enumerate(letters)), "doc_id long, text string")
    for left_out in ("fr", "en"):
        model = language.fit(docs, ~out & (F.col("lang") != left_out))
        got = language.identify(docs.where(out), model).join(docs.select("doc_id", "lang", "text"), "doc_id").where("length(text) > 40").collect()
        foreign, known = [r for r in got if r.lang == left_out], [r for r in got if r.lang not in (None, left_out)]
        assert sum(r.rejected for r in foreign) >= 0.9 * len(foreign) > 0
        assert sum(r.lang_pred == r.lang for r in known) >= 0.97 * len(known)
        prose = [r for r in known if not repeats(r.text)]  # one word again and again is no language, so it may go
        assert sum(not r.rejected for r in prose) >= 0.97 * len(prose) and len(prose) >= 0.9 * len(known)
        assert sum(r.rejected for r in language.identify(junk, model).collect()) >= 0.9 * len(letters)


def test_language_by_plain_cosines(spark, docs):
    """The prediction is that of the largest cosine, computed term by term."""
    model = language.fit(docs, F.lit(True))
    for r in language.identify(docs, model).join(docs.select("doc_id", "text"), "doc_id").limit(40).collect():
        if (c := language.counts(r.text)) is None:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        v = [float(np.log1p(x)) * float(w) for x, w in zip(c, model.idf, strict=True)]
        norm = sum(x * x for x in v) ** 0.5
        cosines = [sum(x * float(y) for x, y in zip(v, centre, strict=True)) / norm for centre in model.centroids]
        assert r.score == pytest.approx(max(cosines), abs=1e-4) and r.lang_pred == model.languages[int(np.argmax(cosines))]


def test_language_limits():
    own, foreign = np.zeros((6, language.STEPS + 1)), np.zeros((6, language.STEPS + 1))
    own[1, 400], foreign[1, 200] = 100, 100
    own[3, 450] = 50
    at = [round(x, 2) for x in language.limits(own, foreign).tolist()]
    assert at == [0.0, 0.48, 0.48, 0.45, 0.45, 0.45]


def test_keep_needs_a_language(spark, odd, empty):
    none = language.fit(odd.where("lang is null"), F.lit(True))
    assert rows(language.keep(empty, none)) == []
    with pytest.raises(ValueError):
        language.keep(odd, none)
    clash = odd.withColumns({c: F.lit("x") for c in ("rejected", "_new_rejected", "found")})
    assert language.keep(clash, language.fit(odd, F.lit(True))).columns == clash.columns


def test_toxicity(spark, odd, empty):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    out = queries.id_crc("doc_id") % 4 == 2
    model = toxicity.fit(docs, labels, ~out)
    got = toxicity.score(docs.where(out).join(labels.where("toxic is not null"), "doc_id", "left_semi"), model).join(labels, "doc_id").collect()
    y, s = np.array([r.toxic for r in got]), np.array([r.score for r in got])
    order = s.argsort().argsort() + 1
    auc = (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.93
    assert all(model.score(t) > 0.3 for t in ("you idiot", "pathetic moron"))
    good = model.values(["thered", "anshe", "ofthe"]).max()
    assert all(v > good for v in model.values(["idiiot", "morron", "stupiid"]))  # words that no text holds
    assert len(rows(toxicity.score(odd, model))) == len(ROWS) and rows(toxicity.score(empty, model)) == []
    # By hand: the mean, over the bag's words, of the mean logit of each word's n-grams.
    for text in ("you idiot", "a", "The cat sat on the mat. Pathetic!", "idiot " * 3 + "fine day " * 30):
        words, logits = re.findall(r"[^\W\d_]+", text.lower()), []
        for w in words:
            bound, of = f"<{w}>", []
            for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1):
                for i in range(len(bound) - n + 1):
                    h = 0
                    for c in bound[i : i + n]:
                        h = (h * 0x100000001B3 + ord(c)) % 2**64
                    of.append(model.logit[((h + n) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - toxicity.BUCKET_BITS)])
            logits.append(sum(of) / len(of))
        worst = sorted(logits)[-min(toxicity.WORST, (len(words) + 1) // 2) :]
        margin = sum(worst) / len(worst) + model.bias
        assert model.score(text) == pytest.approx(1 / (1 + np.exp(-(margin * model.last[0] + model.last[1]))), rel=1e-6)
    none = toxicity.fit(empty, labels, F.lit(True))
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, none).collect())


# 3


def test_mix(spark, odd, empty, docs):
    got = mixing.mix(docs).join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    total, taken, target = sum(r["size"] for r in got), defaultdict(int), {}
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(total)
    block = max(1, total // mixing.SLOTS)
    assert all(int(target[s]) - 8 * block <= taken[s] <= target[s] for s in target)
    slots = {r.doc_id: r.first_slot for r in got}
    assert all((slots[r.doc_id] is None) == (r.taken == 0) for r in got)
    assert sorted(rows(mixing.mix(docs))) == sorted(rows(mixing.mix(docs.repartition(3))))
    assert len(rows(mixing.mix(odd))) == len(ROWS) and rows(mixing.mix(empty)) == []
    assert mixing.mixed(odd).columns == odd.columns and rows(mixing.mixed(empty)) == []


def plain_mix(held):
    """The schedule slot by slot, over (id, text, source) rows: words taken, and the first slot, of each (id, size)."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({s for _, _, s in held}, key=lambda s: (s is None, s or ""))
    total = sum(size(t) for _, t, _ in held)
    sizes = [sum(size(t) for _, t, s in held if s == x) for x in sources]
    weights, full = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sources))], set()
    while True:
        left = (total - sum(3.0 * sizes[i] for i in full)) / (sum(w for i, w in enumerate(weights) if i not in full) or 1)
        more = {i for i in range(len(sources)) if i not in full and weights[i] * left > 3.0 * sizes[i]}
        if not more:
            break
        full |= more
    target = [3.0 * sizes[i] if i in full else weights[i] * left for i in range(len(sources))]
    block = max(1, min(mixing.BLOCK_WORDS, total // mixing.SLOTS))
    lines = []
    for x in sources:
        own = sorted((hashlib.md5(f"{'' if i is None else i}/{size(t)}".encode()).hexdigest(), i or -1, n) for n, (i, t, s) in enumerate(held) if s == x)
        lines.append([n for _, _, n in own for _ in range(size(held[n][1]))])
    used, taken, first = [0] * len(sources), Counter(), {}
    for slot in range(-(-total // block)):
        x = (slot + 1) * mixing.GOLDEN % 1
        at = next((k for k in range(len(sources)) if sum(target[:k]) / total <= x < sum(target[: k + 1]) / total), None)
        if at is not None:
            for w in range(used[at], min(used[at] + block, int(target[at]))):
                n = lines[at][w % len(lines[at])]
                taken[n] += 1
                first.setdefault(n, slot)
            used[at] += block
    return [(taken[n], first.get(n)) for n in range(len(held))]


def test_mix_equals_the_schedule_slot_by_slot(spark, docs):
    held = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()][:60] + [(None, "a b c", None), (900, None, "src0"), (901, "x " * 50, None)]
    got = {(r.doc_id, r["size"]): (r.taken, r.first_slot) for r in mixing.mix(spark.createDataFrame(held, "doc_id long, text string, source string")).collect()}
    want = {(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))): w for (i, t, _), w in zip(held, plain_mix(held), strict=True)}
    assert got == want


def test_mixed_takes_each_row_as_often_as_it_asks(spark):
    held = [(1, "a " * 40, "x"), (1, "b " * 30, "x"), (None, "c " * 20, "x"), (None, "d " * 20, "y"), (2, "e " * 10, "y"), (2, "e " * 10, "y"), (3, "", "y"), (4, None, "z"), (5, "f " * 600, "z")]
    docs = spark.createDataFrame(held, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("_taken_id", "_times", "_time", "ident", "text_hash", "number", "often", "slot", "one")})
    want = Counter()
    for (i, t, s), (n, _) in zip(held, plain_mix(held), strict=True):
        want[i, t, s] += int(n / max(1, len((t or "").split())) + 0.5)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text, r.source) for r in out.collect()) == +want


def test_schedule_is_even(spark):
    sizes = spark.createDataFrame([("a", 50000), ("b", 50000), ("c", 50000), (None, 7)], "source string, source_size long")
    sources = mixing.targets(sizes).cache()
    slots = sorted((r.slot, r.sid) for r in mixing.schedule(sources, 150007, 10).collect())
    share = {r.sid: r.target / 150007 for r in sources.collect()}
    seen = Counter()
    assert [i for i, _ in slots] == list(range(15001))
    for k, (_, sid) in enumerate(slots, 1):
        seen[sid] += 1
        assert all(abs(seen[s] - k * share[s]) < 12 for s in share if share[s] > 0.01)


# 5


def base_spans(t):
    t, out = t or "", []
    out += [("email", m.start(), m.end()) for m in re.finditer(pii.BASE["email"], t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(pii.BASE["ip"], t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(pii.BASE["card"], t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(pii.BASE["phone"], t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_pii(spark, odd, empty, docs):
    extra = ["a@b.com_x@y.org a@b..c @ x@y a.b+c@d-e.f.g, x@y.z@q.r", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255 0000000001.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1111", "😀 a@b.com 😀 é 1.2.3.4 é +1 555 555 5555", "5" * 40, "a@b.com" * 50, "x" * 5000 + "@", "+1 555-123-4567.+44 20 7946 0958"]
    more = spark.createDataFrame([(100000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more).unionByName(odd.where("doc_id is not null").select((F.col("doc_id") + 200000).alias("doc_id"), "text"))
    got = {r.doc_id: r for r in pii.find(both).withColumn("b", pii.joined("base")).withColumn("s", pii.joined("spans")).collect()}
    for i, t in rows(both):
        assert got[i].b == base_spans(t)
        assert set(filter(None, got[i].b.split(","))) <= set(got[i].s.split(","))
        assert got[i].n_email + got[i].n_ip + got[i].n_card + got[i].n_phone == len(list(filter(None, got[i].b.split(","))))
    assert len(rows(pii.find(odd))) == len(ROWS) and rows(pii.find(empty)) == []
    assert {r.base_sha256 for r in queries.op5_pii(spark, SF).where("spans = ''").collect()} == {hashlib.sha256(b"").hexdigest()}


def test_added_spans_are_right(spark):
    """Precision and recall of what the classifier adds, on texts whose spans are known: half of them are data, half look like it."""
    import random

    rng = random.Random(3)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    name = lambda: "".join(rng.choices("abcdefghijklm", k=rng.randint(3, 9)))
    right = [
        lambda: ("email", "Please write to ", f"{name()} (at) {name()}.com", " soon"),
        lambda: ("email", "Contact: ", f"{name()}[at]{name()}[dot]org", ", thanks"),
        lambda: ("ip", "The server address is ", ":".join("".join(rng.choices("0123456789abcdef", k=4)) for _ in range(8)), " now"),
        lambda: ("phone", "Call or fax ", f"(0{digits(2)}) {digits(3)}-{digits(4)}", " today"),
        lambda: ("phone", "my phone: ", f"0049 {digits(3)} {digits(7)}", "."),
    ]
    wrong = [
        lambda: ("", "order ", f"{digits(4)}-{digits(4)}-{digits(3)}", " shipped"),
        lambda: ("", "isbn ", f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", " in print"),
        lambda: ("", "build ", f"{digits(3)}.{digits(3)}.{digits(4)}.{digits(3)}", " done"),
        lambda: ("", "meet me ", f"@ {name()} . {name()}", " tonight"),
        lambda: ("", "serial key ", f"{digits(5)} {digits(5)} {digits(4)}", "x"),
    ]
    texts, want = [], {}
    for i in range(600):
        kind, before, x, after = rng.choice(right if i % 2 else wrong)()
        texts.append((i, before + x + after))
        want[i] = f"{kind}:{len(before)}:{len(before + x)}" if kind else ""
    for i in range(600, 1100):  # plain ones, from which the labelers learn what they are worth
        kind, x = rng.choice([("email", f"{name()}@{name()}.net"), ("ip", ".".join(str(rng.randint(1, 255)) for _ in range(4))), ("phone", f"+49 {digits(3)} {digits(7)}")])
        texts.append((i, f"{rng.choice(['mail', 'host', 'call', 'see'])} {x} please"))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: set(filter(None, r.s.split(","))) - set(filter(None, r.b.split(","))) for r in pii.find(docs).select("doc_id", pii.joined("spans").alias("s"), pii.joined("base").alias("b")).collect()}
    base = {i: set(filter(None, base_spans(t).split(","))) for i, t in texts}
    added = [(i, s) for i in range(600) for s in got[i]]
    hit = sum(s == want[i] for i, s in added)
    due = sum(bool(want[i]) and want[i] not in base[i] for i in range(600))
    assert due > 200 and hit >= 0.9 * due and hit >= 0.8 * len(added), (due, hit, len(added))


def test_pii_grows_with_the_matches(spark):
    """Twice the matches in one text take about twice the time, not four times."""
    import time

    took = []
    for n in (20_000, 40_000):
        docs = spark.createDataFrame([(1, " ".join(f"a{i}@b.com 10.0.{i % 250}.7 +1 555 {1000 + i % 9000} 123" for i in range(n)))], "doc_id long, text string")
        start = time.time()
        r = pii.find(docs).first()
        took.append(time.time() - start)
        assert (r.n_email, r.n_ip, r.n_phone) == (n, n, n)
    assert took[1] < 3 * took[0]


def test_pii_of_long_runs(spark):
    n = 100_000
    texts = ["7" * n + " 1.2.3.4", "1 " * n, "a@b" + ".c" * n]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.b for r in pii.find(docs).select("doc_id", pii.joined("base").alias("b")).collect()}
    assert got == {0: f"ip:{n + 1}:{n + 8}", 1: "", 2: f"email:0:{2 * n + 3}"}


def test_reliable_labelers_outweigh_others():
    counts = {("ip", (1, 1, 1, 0, 1, 1)): 50, ("ip", (-1, -1, -1, 0, 1, -1)): 50, ("ip", (1, 1, 1, 0, -1, 1)): 2}
    p = pii.estimate(counts)
    assert p["ip", (1, 1, 1, 0, -1, 1)] > 0.9 and p["ip", (-1, -1, -1, 0, 1, -1)] < 0.1


# 6


def test_ngram_join(spark, odd, empty, docs):
    more = []
    words = [f"w{i}" for i in range(400)]
    for k in range(1200):  # a large part: several blocks
        w = list(words)
        w[k % 400] = f"x{k}"
        more.append((10_000_000 + k, " ".join(w)))
    rng = np.random.default_rng(5)
    for k in range(900):  # another, whose texts differ in up to ten places, some of them the same ones, and a chain away from it
        w = [f"v{i}" for i in range(300)]
        for i in rng.integers(0, 300, rng.integers(0, 11)):
            w[i] = f"y{rng.integers(0, 4)}"
        more.append((20_000_000 + k, " ".join(w if k < 850 else w[6 * (k - 850) :] + [f"z{i}" for i in range(6 * (k - 850))])))
    some = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r.doc_id: r for r in ngram_join.join(some).collect()}
    sets = {i: frozenset(ngram_join.shingles(t).tolist()) for i, t in rows(some)}
    inverse, links, root = defaultdict(list), Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in sorted(sets):
        near = Counter(j for g in sets[i] for j in inverse[g])
        for j, k in near.items():
            if k >= 0.8 * (len(sets[i]) + len(sets[j]) - k) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in sets[i]:
            inverse[g].append(i)
    assert sum(links.values()) > 1_000_000
    assert {i: got[i].n_links for i in sets} == {i: links[i] for i in sets}
    assert {i: got[i].class_id for i in sets} == {i: find(i) for i in sets}
    out = {(r.doc_id, r.class_id, r.n_links, r.keep) for r in ngram_join.join(odd).collect()}
    assert {(1, 1, 2, True), (2, 1, 2, False), (3, 3, 0, True), (4, 4, 0, True), (None, None, 0, True)} <= out
    assert rows(ngram_join.join(empty)) == []
    kept = ngram_join.distinct(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8]


def test_null_and_shared_ids_are_told_apart(spark):
    def text(name, changed=None):
        return " ".join(f"{name}{i}" if i != changed else "other" for i in range(60))

    held = [(None, text("a")), (None, text("b")), (None, text("c")), (1, text("a", 59)), (1, text("b", 59)), (1, text("d")), (2, text("d", 59)), (2, text("c", 0)), (2, text("e")), (None, text("e").upper()), (3, None), (3, " "), (3, None)]
    held += [(2, text("e")), (None, text("a")), (None, text("f")), (None, text("f", 59))]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(held)], "doc_id long, text string, n long")
    got = sorted((r.doc_id or 0, r.class_id or 0, r.n_links, r.n_copies, r.keep) for r in ngram_join.join(docs).collect())
    first = [r for r in got if r[0] == 0]
    assert sorted(r[2:4] for r in first) == [(1, 1), (1, 1), (1, 1), (1, 1), (2, 2), (2, 2), (2, 3)] and sum(r[4] for r in first) == 6
    assert sorted(r for r in got if r[0] == 1) == [(1, 0, 1, 1, False), (1, 0, 2, 1, False), (1, 1, 1, 1, True)]
    assert sorted(r for r in got if r[0] == 2) == [(2, 0, 1, 1, False), (2, 0, 2, 3, False), (2, 0, 2, 3, False), (2, 1, 1, 1, False)]
    kept = ngram_join.distinct(docs).collect()
    classes = Counter((r.text or "").strip().lower()[:1] for r in kept)
    assert classes == {"": 3, "a": 1, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1} and all(r.doc_id is None or r.text is None or r.n in (5, 11) for r in kept)


def test_bands_reach_the_recall():
    b, r = ngram_join.bands_for(0.8, 0.999)
    assert 1 - (1 - 0.8**r) ** b >= 0.999 and b * r <= 144


# 7


def test_tables_and_adpcm():
    assert audio.MULAW_TABLE[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert audio.ALAW_TABLE[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    assert len(set(audio.ALAW_TABLE.tolist())) == 256
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (5, audio.BLOCK), dtype=np.uint8)
    for block, got in zip(blocks, audio.decode_adpcm(blocks), strict=True):
        now, at = int(block[:2].view("<i2")[0]), min(int(block[2]), 88)
        want = [now]
        for byte in block[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(audio.STEPS[at])
                change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
                now = max(-32768, min(32767, now - change if code & 8 else now + change))
                at = max(0, min(88, at + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
                want.append(now)
        assert got.tolist() == want


def test_media(spark, odd, empty):
    for kind in (audio.PCM, audio.ALAW, audio.MULAW, audio.ADPCM):
        data = bytes(range(256)) * 9
        assert audio.load(audio.store(data, kind)) == (kind, 8000, data)
    assert audio.resample(np.array([0, 10, 20], np.int16), 8000, 16000).tolist() == [0, 5, 10, 15, 20, 20]
    got = audio.describe(odd).join(odd.select("doc_id", "text"), "doc_id").collect()
    for r in got:
        data = (r.text or "").encode()
        padded = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(audio.store(padded)), hashlib.sha256(audio.store(padded)).hexdigest())
    assert len(rows(audio.describe(odd))) == len(ROWS) and rows(audio.describe(empty)) == []
    media = spark.createDataFrame([(1, audio.store(b"\x00\xff" * 80)), (2, None)], "k long, m binary")
    out = dict(rows(audio.pcm_column(media, "k", "m")))
    assert out[2] is None and audio.load(bytes(out[1]))[:2] == (audio.PCM, 16000)


# 8


def test_tokens(spark, odd, empty, docs):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(2)
    more = ["".join(rng.choice(list("ab ▁é日😀\n\t<>0xAs  .,"), int(rng.integers(0, 40)))) for _ in range(800)] + ["<s> </s> <unk> hi", " " * 100, "a" * 3000]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(500000 + i, t) for i, t in enumerate(more)], "doc_id long, text string")).unionByName(odd.where("doc_id is not null").dropDuplicates(["doc_id"]).select((F.col("doc_id") + 900000).alias("doc_id"), "text"))
    got = {r.doc_id: r for r in tokens.count_tokens(both, path).collect()}
    for i, t in rows(both):
        n = len(library.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 4096)
    assert rows(tokens.count_tokens(empty, path)) == []


# 9


def test_decontamination(spark, odd, empty):
    item = "It was a bright cold day in April, and the clocks were striking thirteen when Winston slipped in. He had a long way to go before he could rest, and no one to talk to."
    items = spark.createDataFrame([(7, item), (7, item), (8, None), (9, ""), (10, "xyz q")], "item_id long, text string")
    typo = item.replace("bright", "brihgt").replace("clocks", "clock")
    texts = ["aa bb " + item.upper().replace(" ", "\n ") + " cc", "zz " + typo + " yy", item[:100], item[10:150] + " and more of other things", "the clocks were striking", "say xyz q now", "xyz qq", None, "", "clean words stand here " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in decontam.contamination(docs, items).collect()}
    assert [i for i in got if got[i].contaminated] == [0, 1, 2, 3, 5]
    assert (got[0].item_id, got[0].edits, got[5].item_id) == (7, 0, 10) and got[1].edits == 0  # the best window stands between the typos
    assert sorted(r.doc_id for r in decontam.clean(docs, items).collect()) == [4, 6, 7, 8, 9]
    passes, decontam.PASS_CHARS = decontam.PASS_CHARS, 60
    try:
        assert {r.doc_id: (r.contaminated, r.n_items) for r in decontam.contamination(docs, items).collect()} == {i: (r.contaminated, r.n_items) for i, r in got.items()}
        assert sorted(r.doc_id for r in decontam.clean(docs, items).collect()) == [4, 6, 7, 8, 9]
    finally:
        decontam.PASS_CHARS = passes
    assert len(rows(decontam.contamination(odd, items))) == len(ROWS) and rows(decontam.contamination(empty, items)) == []
    assert not any(r.contaminated for r in decontam.contamination(odd, items.where("1 = 0")).collect())


def least_edits(pattern, text):
    """Of the pattern and any stretch of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_contamination_equals_full_alignment(spark):
    """Every window against every document by the full table of edits, without a filter."""
    rng = np.random.default_rng(6)
    letters = list("abcdefghij ")
    items = [(k, "".join(rng.choice(letters, n))) for k, n in enumerate((150, 64, 40, 83))] + [(None, "".join(rng.choice(letters, 70)))]
    texts = []
    for k in range(48):
        item = list(decontam.normal(items[k % 5][1]))
        lo = int(rng.integers(0, max(1, len(item) - 60)))
        part = item[lo : lo + int(rng.integers(50, 100))]
        for _ in range(int(rng.integers(0, 9))):
            at = int(rng.integers(0, len(part)))
            part[at : at + int(rng.integers(0, 2))] = rng.choice(letters, int(rng.integers(0, 2))).tolist()
        texts.append("".join(rng.choice(letters, 40)) + "".join(part) + "".join(rng.choice(letters, 30)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in decontam.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    seen = 0
    for k, text in enumerate(map(decontam.normal, texts)):
        found = {}
        for i, item in items:
            t = decontam.normal(item)
            w = min(len(t), decontam.WINDOW)
            for s in [*range(0, len(t) - w, decontam.STRIDE), len(t) - w]:
                e = least_edits(t[s : s + w], text)
                if e <= decontam.budget(w)[0]:
                    found[i] = min(e, found.get(i, e))
        assert got[k].contaminated == bool(found) and got[k].n_items == len(found), k
        assert got[k].edits == min(found.values(), default=None)
        seen += bool(found)
    assert 10 < seen < 45


def test_runs_of_an_item_are_found_wherever_they_start(spark):
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(400)]
    items = [(f"item{k}", " ".join(rng.choice(words, 60))) for k in range(8)]
    n = decontam.WINDOW + decontam.STRIDE - 1
    held = [(k, decontam.normal(t)[s : s + n]) for k, (_, t) in enumerate(items) for s in range(0, len(t) - n, 7)]
    docs = spark.createDataFrame([(k * 1000 + i, f"qqq {t} zzz") for i, (k, t) in enumerate(held)], "doc_id long, text string")
    got = decontam.contamination(docs, spark.createDataFrame(items, "item_id string, text string")).collect()
    assert len(got) == len(held) and all(r.item_id == f"item{r.doc_id // 1000}" for r in got)
    clash = docs.withColumns({c: F.lit("x") for c in ("found", "_new_found", "_row", "_index")})
    assert decontam.clean(clash, spark.createDataFrame(items, "item_id string, text string")).columns == clash.columns


def test_passes_keep_rows_of_one_id_apart(spark):
    items = spark.createDataFrame([(k, " ".join(f"{'abcdef'[k] * 4}word{i}" for i in range(14))) for k in range(6)], "item_id long, text string")
    text = {r.item_id: r.text for r in items.collect()}
    docs = spark.createDataFrame([(None, text[0] + " " + text[1]), (None, "clean"), (None, text[2]), (5, text[3]), (5, "clean too"), (5, text[4] + " " + text[5])], "doc_id long, text string")
    want = sorted((r.doc_id or 0, r.contaminated, r.n_items, r.item_id or 0) for r in decontam.contamination(docs, items).collect())
    passes, decontam.PASS_CHARS = decontam.PASS_CHARS, 200
    try:
        assert sorted((r.doc_id or 0, r.contaminated, r.n_items, r.item_id or 0) for r in decontam.contamination(docs, items).collect()) == want
    finally:
        decontam.PASS_CHARS = passes
    assert [w[2] for w in want] == [0, 1, 2, 0, 1, 2]


# 10


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_flow_fills_every_shard(shards):
    rng = np.random.default_rng(3)
    counts = {int(c): int(n) for c, n in zip(rng.choice(4096, 300, replace=False), rng.integers(1, 50, 300), strict=True)} | {7: 9000}
    segments = sharding.flow(counts, shards, 64)
    held, slots = Counter(), defaultdict(list)
    for cell, first, last, shard, slot in segments:
        held[shard] += last - first
        slots[shard].append((slot, slot + last - first))
    total = sum(counts.values())
    assert sum(held.values()) == total and max(held.values()) - min(held.get(s, 0) for s in range(shards)) <= 1
    for s in slots.values():
        assert [a for a, _ in sorted(s)] == [0, *(b for _, b in sorted(s))][:-1]


def test_shards(spark, odd, empty, docs):
    got = sharding.shard(docs).collect()
    assert len(got) == docs.count()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and all(sorted(s) == list(range(len(s))) for s in by.values())
    text = dict(rows(docs.select("doc_id", "text")))
    assert all((r["size"], r.text_crc32) == (len(text[r.doc_id].encode()) + 8, zlib.crc32(text[r.doc_id].encode())) for r in got)
    assert sorted(map(tuple, got)) == sorted(rows(sharding.shard(docs.repartition(5))))
    moved = {r.doc_id: r.shard for r in sharding.shard(docs, 25).collect()}
    assert sum(moved[r.doc_id] != r.shard for r in got) < 0.7 * len(got)
    assert len(rows(sharding.shard(odd))) == len(ROWS) and rows(sharding.shard(empty)) == []


def test_shards_equal_a_plain_ring(spark, docs):
    """Row by row: each goes to the shard of the next point clockwise, or on to the next that has room."""
    import bisect

    mine = docs.select("doc_id", (F.octet_length("text").cast("long") + 8).alias("n"), F.crc32(F.col("text").cast("binary")).cast("long").alias("c"))
    held = sorted((r.h % 2**64 >> (64 - sharding.CELL_BITS), r.h, r.doc_id, r.n, r.c) for r in mine.withColumn("h", F.xxhash64("doc_id", "n", "c")).collect())
    for shards in (3, 24):
        points = sharding.ring(shards, 64)
        room = [len(held) // shards + (s < len(held) % shards) for s in range(shards)]
        used, got, over = [0] * shards, {}, []

        def put(i, s):
            got[i] = (s, used[s])
            used[s] += 1

        for cell, _, i, _, _ in held:
            at = bisect.bisect_left([p for p, _ in points], cell << (64 - sharding.CELL_BITS)) % len(points)
            if used[points[at][1]] < room[points[at][1]]:
                put(i, points[at][1])
            else:
                over.append((i, at))
        for i, at in over:
            while used[points[at][1]] == room[points[at][1]]:
                at = (at + 1) % len(points)
            put(i, points[at][1])
        assert {r.doc_id: (r.shard, r.slot) for r in sharding.shard(docs, shards).collect()} == got
    moved = {r.doc_id: r.shard for r in sharding.shard(docs, 25).collect()}
    ideal = len(held) / 25
    assert sum(moved[r.doc_id] != r.shard for r in sharding.shard(docs, 24).collect()) < 4 * ideal


# The pipeline


def plain_mulaw(b):
    b = ~b & 255
    size = (((b & 15) << 3) + 132) << ((b >> 4) & 7)
    return 132 - size if b & 128 else size - 132


def plain_alaw(b):
    b ^= 0x55
    size, part = ((b & 15) << 4) + 8, (b >> 4) & 7
    if part:
        size = (size + 256) << (part - 1)
    return size if b & 128 else -size


def plain_adpcm(block):
    now, at = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [now]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEPS[at])
            change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
            now = max(-32768, min(32767, now - change if code & 8 else now + change))
            at = max(0, min(88, at + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(now)
    return out


def test_media_features_by_hand(spark):
    texts = ["", "Ein kurzer Text", "é😀 " * 300]
    for r in audio.describe(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        data = texts[r.doc_id].encode()
        data += b"\xff" * (-len(data) % 576 if data else 576)
        pcm = [plain_mulaw(b) for b in data]
        wide = []
        for i in range(2 * len(pcm)):
            a, b = pcm[i // 2], pcm[min(i // 2 + 1, len(pcm) - 1)]
            wide.append(a if i % 2 == 0 else (a * 8000 + b * 8000) // 16000)
        loud = sum(abs(x) for k in range(0, len(data), 576) for x in plain_adpcm(data[k : k + 576]))
        crc = zlib.crc32(b"".join(x.to_bytes(2, "little", signed=True) for x in wide))
        assert r.feature == f"ms={sum(x * x for x in pcm) // len(pcm)};zc={sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:]))};peak={max(abs(plain_alaw(b)) for b in data)};adpcm={loud};crc16k={crc}"


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls, empty, long and repeated rows, and an empty table, through all stages."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    long = "word and then another one of them went home " * 4000
    odd = spark.createDataFrame([*ROWS, (None, None, None, None, None), (None, ROWS[0][1], "en", "b", 1), (9, long, "en", "a", 1)], SCHEMA)
    both = base.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).unionByName(odd)
    both.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) > 50 and set(by) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    cat = [r for r in got if r["size"] == len(ROWS[0][1].encode()) + 8 and r.text_crc32 == zlib.crc32(ROWS[0][1].encode())]
    assert len({r.doc_id for r in cat}) <= 1
    both.where("1 = 0").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []


def test_pipeline_stages(spark, docs):
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        out = spark.createDataFrame(out.collect(), docs.schema)
        before, after = {r.doc_id: r.text for r in now.collect()}, Counter(r.doc_id for r in out.collect())
        if name == "ngram_join":
            assert set(after) == {r.doc_id for r in ngram_join.join(now).where("keep").collect()} and max(after.values()) == 1
        if name == "decontamination":
            items = [decontam.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(before) - set(after) == {i for i, t in before.items() if any(x in decontam.normal(t) for x in items)}
        if name == "mixing":
            want = {r.doc_id: int(r.taken / r["size"] + 0.5) for r in mixing.mix(now).where("size > 0").collect()}
            assert after == Counter({i: n for i, n in want.items() if n})
        now = out
    last = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert last.count() == now.count()

"""Personal data by weak supervision, in DataFrame functions only.

Strict patterns give the base spans. Wider patterns give candidates, and six labelers vote on each: the strict pattern (yes or no
opinion), a checksum or range, a gazetteer, the words before it, its bounds and its shape. How often each combination of votes occurs is counted over all
documents; expectation-maximisation estimates from these counts how reliable each labeler is on each kind, and so how likely each
combination is personal data. A logistic classifier is then trained on features of the candidates, with these likelihoods as labels,
and what it accepts is added to the base spans. The counts are tables of bounded size (combinations of votes, of feature values);
nothing else reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidespan.llm.common import cut

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What runs of one class could make the strict pattern look at again and again is taken whole (possessive), from its start on.
#: The JVM also runs a repeated group by recursion unless it is possessive, so a long one would end its stack.
FAST = BASE | {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",  # what has fewer digits is dropped anyway
}
WIDE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}|(?<![0-9a-fA-F:])(?:[0-9a-fA-F]{1,4}:){4,7}[0-9a-fA-F]{1,4}",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){11,18}(?![0-9])",
    "phone": r"(?:\+|\b00|\(|\b)[0-9][ ().0-9-]{7,16}[0-9]",
}
GATE = {"email": r"@|[(\[]at[)\]]", "ip": r"[0-9]\.[0-9]|[0-9a-fA-F]:[0-9a-fA-F]", "card": r"[0-9](?:[ -]?[0-9]){11}", "phone": r"[0-9][ ().0-9-]{7}"}
#: Endings of host names that are in common use (generic ones, and country codes).
ENDINGS = (
    "aero", "app", "biz", "cat", "cloud", "com", "coop", "dev", "edu", "gov", "info", "int", "io", "jobs", "mil", "mobi", "museum", "name", "net", "online", "org", "pro", "shop", "site", "store", "tech", "tel", "travel", "xyz",
    "ae", "ar", "at", "au", "be", "bg", "bo", "br", "by", "ca", "ch", "cl", "cn", "co", "cr", "cy", "cz", "de", "dk", "ec", "ee", "eg", "es", "eu", "fi", "fr", "gr", "hk", "hr", "hu", "id", "ie", "il", "in", "ir", "is", "it", "jp",
    "ke", "kr", "kz", "li", "lt", "lu", "lv", "ma", "mc", "me", "mt", "mx", "my", "ng", "nl", "no", "nz", "pe", "ph", "pk", "pl", "pt", "py", "ro", "rs", "ru", "sa", "se", "sg", "si", "sk", "th", "tn", "tr", "tw", "ua", "uk", "us",
    "uy", "uz", "ve", "vn", "za",
)
#: Country calling codes of one and two digits.
COUNTRIES = (
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66",
    "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)
GOOD_WORDS = {
    "email": "mail|contact|write|kontakt|correo|courriel|from|to:",
    "ip": r"\bip\b|host|server|address|login|adresse|from",
    "card": "card|visa|master|amex|credit|karte|carte|tarjeta|pay",
    "phone": "phone|tel|call|fax|mobile|anruf|llama|appel|whatsapp",
}
BAD_WORDS = r"token|version|isbn|order|sku|serial|hash|sha|build|secret|key"
VOTES = ("strict", "check", "gazetteer", "context", "bounds", "shape")
FEATURES = ("digits", "marks", "blanks", "left", "right", "lead")
ROUNDS, STEPS = 30, 300
ACCEPT = 0.5


def _spans(text: str, pattern: str, gate: str) -> tuple[Column, Column]:
    """Pieces between the matches, and the matches, of texts that pass the gate."""
    t, ok = F.col(text), F.col(text).rlike(gate)
    return F.when(ok, F.split(t, pattern, -1)).otherwise(F.array(t)), F.when(ok, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


#: Matches whose lengths are summed together; sums within one group and over the groups before it give each match its place.
GROUP = 64


def _let(value: Column, name: str, then) -> Column:
    """``then`` of a value that is computed once a row."""
    return F.element_at(F.transform(F.array(F.struct(value.alias(name))), lambda z: then(z[name])), 1)


def _placed(pieces: str, matches: str) -> Column:
    """An array of (s, e, x, l, r): start, end (code points), text, the text before and the character after each match.

    The work grows with the matches: no array is built up by adding to it match by match, but for one entry a GROUP.
    """
    p, m, n = F.col(pieces), F.col(matches), F.size(matches)
    none = F.array().cast("array<struct<s:int,e:int,x:string,l:string,r:string>>")
    upto = lambda k: F.sequence(F.lit(0), k - 1)
    sum_of = lambda a: F.aggregate(a, F.lit(0), lambda s, v: s + v)

    def place(size: Column) -> Column:
        sums = F.transform(upto(F.ceil(n / GROUP).cast("int")), lambda g: sum_of(F.slice(size, g * GROUP + 1, F.lit(GROUP))))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        bases = F.aggregate(sums, start, lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

        def one(base: Column) -> Column:
            def at(i: Column) -> Column:
                g = F.floor(i / GROUP).cast("int")
                s = F.get(base, g) + sum_of(F.slice(size, g * GROUP + 1, i - g * GROUP)) + F.length(F.get(p, i))
                return F.struct(s.alias("s"), (s + F.length(F.get(m, i))).alias("e"), F.get(m, i).alias("x"), F.right(F.get(p, i), F.lit(24)).alias("l"), F.left(F.get(p, i + 1), F.lit(1)).alias("r"))

            return F.transform(upto(n), at)

        return _let(bases, "b", one)

    sizes = F.transform(upto(n), lambda i: F.length(F.get(p, i)) + F.length(F.get(m, i)))
    return F.when(n > 0, _let(sizes, "z", place)).otherwise(none)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.lit("0246813579")
    n = F.length(digits)
    value = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when((n - i) % 2 == 1, F.substring(doubled, F.substring(digits, i, F.lit(1)).cast("int") + 1, F.lit(1))).otherwise(F.substring(digits, i, F.lit(1))).cast("int"))
    return F.aggregate(value, F.lit(0), lambda a, v: a + v) % 10 == 0


def _octets(x: Column) -> Column:
    return F.forall(F.split(x, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.coalesce(p.substr(-3, 3).cast("int"), F.lit(0)) <= 255))


def passes(kind: str, x: Column) -> Column:
    """The check that a match of the strict pattern must pass."""
    d = _digits(x)
    if kind == "ip":
        return _octets(x)
    if kind == "card":
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(d).between(9, 15)
    return F.lit(True)


def _votes(kind: str, c: Column) -> list[Column]:
    x, left, right = c["x"], F.lower(c["l"]), c["r"]
    d = _digits(x)
    vote = lambda good, bad=None: F.when(good, 1).when(F.lit(True) if bad is None else bad, -1).otherwise(0)
    strict = x.rlike(f"^(?:{FAST[kind]})$")
    check = {"email": x.rlike("@"), "ip": x.rlike(":") | F.when(x.rlike(r"^[0-9.]+$"), _octets(x)).otherwise(False), "card": luhn(d), "phone": F.length(d).between(10, 13)}[kind]
    listed = {
        "email": F.lower(F.regexp_extract(x, r"([A-Za-z0-9-]+)$", 1)).isin(*ENDINGS),
        "ip": F.coalesce(F.regexp_extract(x, r"^([0-9]{1,3})\.", 1).try_cast("int").between(1, 223), F.lit(False)),
        "card": d.rlike("^(4|5[1-5]|2[2-7]|3[47]|6)"),
        "phone": x.rlike(rf"^(?:\+|00) ?(?:{'|'.join(COUNTRIES)})"),
    }[kind]
    bounds = ~left.rlike(r"[\p{L}0-9_]$") & ~right.rlike(r"[\p{L}0-9_]")
    shape = {
        "email": x.rlike(r"^\S{1,64}@\S+$"),
        "ip": x.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"),
        "card": x.rlike(r"^([0-9]{15,16}|[0-9]{4}([ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$"),
        "phone": x.rlike(r"^(?:\+[0-9]{1,3}|00[0-9]{1,3}|\(?0[0-9]{1,4}\)?|\([0-9]{3}\)) ?(?:\(?[0-9]{2,4}\)?[ .-]?){1,4}[0-9]{2,4}$"),
    }[kind]
    return [
        F.when(strict, 1).otherwise(0),
        vote(check),
        # What names no country can't name an unknown one; addresses of either form may lie outside the list.
        vote(listed, F.lit(False)) if kind == "ip" else vote(listed, x.rlike(r"^(?:\+|00)")) if kind == "phone" else vote(listed),
        vote(left.rlike(GOOD_WORDS[kind]), left.rlike(BAD_WORDS) | left.rlike(r'["=/]$')),
        vote(bounds),
        vote(shape),
    ]


def _features(c: Column) -> list[Column]:
    """Values of few characters each: digits (up to 20), which signs there are, blanks (up to 4), the classes of what stands at the
    span's bounds, and how it begins."""
    side = lambda s: F.when(s == "", "none").when(s.rlike(r"^\s$"), "space").when(s.rlike(r"^\p{L}$"), "letter").when(s.rlike("^[0-9]$"), "digit").otherwise("sign")
    x = c["x"]
    marks = F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace(x, r"[^@.:()+\[\]-]", ""), ""))), "")
    return [
        F.least(F.length(_digits(x)), F.lit(20)).cast("string"),
        marks,
        F.least(F.length(F.regexp_replace(x, "[^ ]", "")), F.lit(4)).cast("string"),
        side(F.right(c["l"], F.lit(1))),
        side(c["r"]),
        F.when(x.rlike(r"^\+"), "plus").when(x.rlike("^00"), "zeros").when(x.rlike(r"^\(?0"), "zero").when(x.rlike("^[0-9]"), "digit").when(x.rlike("^[A-Za-z]"), "letter").otherwise("sign"),
    ]


def _candidates(kind: str) -> tuple[Column, Column]:
    """The base spans, and the candidates with their votes and features."""

    def candidate(c: Column) -> Column:
        votes = F.concat_ws(",", *(v.cast("string") for v in _votes(kind, c)))
        features = F.concat_ws(",", *(F.concat(F.lit(f"{kind}.{n}="), v) for n, v in zip(FEATURES, _features(c), strict=True)))
        return F.struct(F.lit(kind).alias("kind"), c["s"].alias("s"), c["e"].alias("e"), votes.alias("votes"), features.alias("features"))

    base = F.transform(F.filter(f"_b_{kind}", lambda c: passes(kind, c["x"])), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e")))
    return base.alias(f"_b_{kind}"), F.transform(f"_w_{kind}", candidate).alias(f"_w_{kind}")


def _added(b: Column, w: Column, accepted) -> Column:
    """The candidates that the classifier accepts and no base span of the kind meets.

    Base spans are in order and apart from one another, so the first that ends behind a candidate's start is found by halving.
    """

    def meets(c: Column) -> Column:
        start = F.struct(F.lit(0).alias("lo"), F.size(b).alias("hi"))

        def halve(a: Column, _: Column) -> Column:
            middle = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
            behind = F.get(b, middle)["e"] > c["s"]
            return F.when(a["lo"] >= a["hi"], a).otherwise(F.when(behind, F.struct(a["lo"].alias("lo"), middle.alias("hi"))).otherwise(F.struct((middle + 1).alias("lo"), a["hi"].alias("hi"))))

        first = F.aggregate(F.sequence(F.lit(0), F.length(F.bin(F.size(b)))), start, halve, lambda a: a["lo"])
        return F.coalesce(F.get(b, first)["s"] < c["e"], F.lit(False))

    return F.filter(w, lambda c: accepted(c) & ~meets(c))


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda c: F.struct(F.lit(kind).alias("kind"), c["s"].cast("long").alias("start"), c["e"].cast("long").alias("end")))


def estimate(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = ROUNDS) -> dict[tuple[str, tuple[int, ...]], float]:
    """By expectation-maximisation: how likely each (kind, votes) is personal data. Starts from the majority of the votes."""
    out = {}
    for kind in sorted({k for k, _ in counts}):
        own = {v: n for (k, v), n in counts.items() if k == kind}
        p = {v: 0.5 + 0.4 * (sum(v) > 0) - 0.4 * (sum(v) < 0) for v in own}
        for _ in range(rounds):
            yes = sum(n * p[v] for v, n in own.items())
            total = sum(own.values())
            prior = (yes + 1) / (total + 2)
            rate = []
            for j in range(len(VOTES)):  # of those that the labeler votes on; where it has no opinion it says nothing
                on = {v: n for v, n in own.items() if v[j]}
                good, bad = sum(n * p[v] for v, n in on.items()), sum(n * (1 - p[v]) for v, n in on.items())
                rate.append({a: ((sum(n * p[v] for v, n in on.items() if v[j] == a) + 1) / (good + 2), (sum(n * (1 - p[v]) for v, n in on.items() if v[j] == a) + 1) / (bad + 2)) for a in (-1, 1)})
            for v in own:
                odds = math.log(prior / (1 - prior)) + sum(math.log(rate[j][a][0] / rate[j][a][1]) for j, a in enumerate(v) if a)
                p[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        out |= {(kind, v): x for v, x in p.items()}
    return out


def train(rows: list[tuple[tuple[str, ...], float, float]], steps: int = STEPS) -> dict[str, float]:
    """Weights of a logistic classifier from (feature values, candidates, likelihoods summed): gradient steps with a small ridge."""
    weights: dict[str, float] = {name: 0.0 for names, _, _ in rows for name in names}
    square = dict.fromkeys(weights, 1e-6)
    total = sum(n for _, n, _ in rows)
    for _ in range(steps):
        slope = {name: 1e-4 * w for name, w in weights.items()}
        for names, n, yes in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[x] for x in names)))))
            for name in names:
                slope[name] += (p * n - yes) / total
        for name, g in slope.items():
            square[name] += g * g
            weights[name] -= 0.3 * g / math.sqrt(square[name])
    return weights


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return, for every row, id, the counts of base spans (n_email, n_ip, n_card, n_phone), base (array of kind, start, end, in the
    order of KINDS, then start) and spans (the base spans and those that the classifier adds, in the same order).

    Starts and ends count code points, ends exclusive. Null and empty texts have no spans. An added span never overlaps a base span
    of its kind. Repeated rows are rows of their own; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    for kind in KINDS:
        for name, patterns in (("b", FAST), ("w", WIDE)):
            pieces, matches = _spans("_text", patterns[kind], GATE[kind])
            rows = rows.withColumn(f"_p{name}_{kind}", pieces).withColumn(f"_m{name}_{kind}", matches)
    rows = rows.select("_id", *(_placed(f"_p{n}_{kind}", f"_m{n}_{kind}").alias(f"_{n}_{kind}") for kind in KINDS for n in "bw"))
    rows = cut(rows.select("_id", *(x for kind in KINDS for x in _candidates(kind))))
    each = rows.select(F.explode(F.concat(*(f"_w_{kind}" for kind in KINDS))).alias("c")).select("c.*")
    got = each.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()  # kinds * 3 ** votes rows at most
    likely = estimate({(r["kind"], tuple(map(int, r["votes"].split(",")))): r["n"] for r in got})
    if likely:
        table = docs.sparkSession.createDataFrame([(k, ",".join(map(str, v)), p) for (k, v), p in likely.items()], "kind string, votes string, p double")
        labelled = each.join(F.broadcast(table), ["kind", "votes"]).groupBy("kind", "features").agg(F.count("*").alias("n"), F.sum("p").alias("yes")).collect()  # some thousand rows at most
        weights = train(sorted(((r["kind"], *r["features"].split(",")), float(r["n"]), r["yes"]) for r in labelled))
    else:
        weights = {}
    known = F.create_map(*(F.lit(x) for pair in sorted(weights.items()) for x in pair)) if weights else F.create_map(F.lit(""), F.lit(0.0))
    weight = lambda name: F.coalesce(F.try_element_at(known, name), F.lit(0.0))
    accepted = lambda c: F.aggregate(F.split(c["features"], ","), weight(c["kind"]), lambda a, f: a + weight(f)) >= math.log(ACCEPT / (1 - ACCEPT))
    columns, base, spans = [], [], []
    for kind in KINDS:
        b, w = F.col(f"_b_{kind}"), F.col(f"_w_{kind}")
        columns.append(F.size(b).cast("long").alias(f"n_{kind}"))
        base.append(_named(b, kind))
        spans.append(F.array_sort(F.concat(base[-1], _named(_added(b, w, accepted), kind))))
    return rows.select(F.col("_id").alias(id_col), *columns, F.concat(*base).alias("base"), F.concat(*spans).alias("spans"))


def joined(spans: str) -> Column:
    """An array of spans as text: kind:start:end, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))))

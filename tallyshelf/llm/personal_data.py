"""Personal data by weak supervision, in DataFrame functions only.

Candidate spans come from patterns, one pass per kind. Three labelers vote on each: the strict form of its kind, a
gazetteer, and words before it. How far each labeler can be trusted is estimated by expectation-maximisation over the counts
of vote patterns, without labels; the resulting probabilities train a logistic classifier of spans, which decides on all
but the base kinds. The driver only sees counts per pattern and feature, of which there is a fixed number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tallyshelf.llm.common import stored

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban", "person", "mailto")
#: Marks around matches, characters of private use that no pattern knows; where a text has them, "?" stands for them.
OPEN, CLOSE = "", ""
#: characters before a span that count as its context
NEAR = 32
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Patterns give the same matches as their plain forms; possessive steps and starts only spare retries that must fail.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "person": r"(?<=\b(?:Mr|Ms|Dr|Mrs)\.?\x20|\bname\x20is\x20|\bNAME:\x20|\bName:\x20)\p{Lu}\p{Ll}+(?:\x20\p{Lu}\p{Ll}+){1,2}",
    "mailto": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,40}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{2,40}\x20?[\[(]dot[\])]\x20?[A-Za-z]{2,10}",
}
#: what a text must hold for a kind to occur; cheaper than the pattern
HINTS = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "ssn": r"[0-9]-[0-9]{2}-[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}", "person": r"\b(?:Mr|Ms|Mrs|Dr|[Nn]ame|NAME)\b", "mailto": r"[\[(]at[\])]",
}
#: strict forms, where the pattern is wider than they are
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$",
    "ip": rf"^(?:{PART}\.){{3}}{PART}$",
    "card": r"^(?:[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4,7})$",
    "phone": r"^\+[0-9]{1,3}(?:[\x20.-]?\(?[0-9]{2,4}\)?){2,4}$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": r"^[A-Z]{2}[0-9]{2}[\x20A-Z0-9]+$",
    "person": r"^\p{Lu}\p{Ll}{1,14}(?:\x20\p{Lu}\p{Ll}{1,14}){1,2}$",
    "mailto": r"^[A-Za-z0-9][A-Za-z0-9._-]*\x20?[\[(]at[\])].*$",
}
# What the gazetteer knows of each kind (ends of domains, private networks, issuers, countries, first names).
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu)$",
    "ip": r"^(?!0\.|127\.|255\.)",
    "card": r"^(?:4|5[1-5]|3[47]|6011|65|2[2-7])",
    "phone": r"^\+(?:1|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])",
    "ssn": r"^(?:[0-6]|7[0-6])",
    "iban": r"^(?:AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM)",
    "person": r"^(?:James|John|Robert|Michael|William|David|Mary|Anna|Emma|Maria|Laura|Sarah|Paul|Peter|Thomas|Jean|Pierre|Marie|Hans|Karl|Juan|Jose|Carlos|Ana|Linda|Susan)\b",
    "mailto": r"(?:com|org|net|edu|gov|io|de|fr|es|uk|eu)$",
}
# Words before a span that speak for its kind.
CONTEXT = {
    "email": r"e-?mail|mail|contact|write|reach|@",
    "ip": r"\bip\b|address|host|server|login",
    "card": r"card|visa|master|payment|credit",
    "phone": r"phone|call|tel|mobile|fax|contact",
    "ssn": r"ssn|social|security|tax",
    "iban": r"iban|account|bank|transfer",
    "person": r"name|mr|mrs|ms|dr|contact",
    "mailto": r"e-?mail|mail|contact|write|reach",
}
VOTES = ("form", "known", "near")
ROUNDS, RIDGE, FROM = 50, 0.1, 0.5


def found(text: Column, pattern: str) -> Column:
    """start, end, value and context of every match, in order: matches are marked, and the text split at the marks."""
    parts = F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]", -1)
    step = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,value:string,near:string>>").alias("spans"), F.lit("").alias("last"), F.lit(False).alias("inside"))

    def take(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        span = F.struct(acc["at"].alias("start"), end.alias("end"), part.alias("value"), F.right(acc["last"], F.lit(NEAR)).alias("near"))
        return F.struct(end.alias("at"), F.when(acc["inside"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"), part.alias("last"), (~acc["inside"]).alias("inside"))

    return F.aggregate(parts, step, take)["spans"]


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check digit is right: every second digit from the end but one counts as the digit sum of its double."""
    turned = F.reverse(number)
    doubled = F.translate(turned, "0123456789", "0246813579")
    places = F.sequence(F.lit(1), F.length(number))
    return F.aggregate(places, F.lit(0), lambda a, i: a + F.when(i % 2 == 0, F.substring(doubled, i, 1)).otherwise(F.substring(turned, i, 1)).cast("int")) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(STRICT["ip"])
    if kind == "card":
        number = digits(value)
        return F.when(F.length(number).between(16, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def spans_of(kind: str, text: Column) -> Column:
    """The valid candidates of a kind, with votes: 1 for, -1 against, 0 for no opinion."""
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,form:int,known:int,near:int,wide:int>>")

    def voted(s: Column) -> Column:
        v, near = s["value"], F.lower(s["near"])
        known = F.when(v.rlike(GAZETTEER[kind]), 1).otherwise(-1 if kind in ("card", "ssn", "iban") else 0)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            F.when(v.rlike(STRICT[kind]), 1).otherwise(-1).alias("form"), known.alias("known"),
            F.when(near.rlike(CONTEXT[kind]), 1).otherwise(0).alias("near"),
            F.least(F.floor(F.length(v) / 8), F.lit(4)).cast("int").alias("wide"),
        )

    spans = F.filter(found(text, PATTERNS[kind]), lambda s: valid(kind, s["value"]))
    return F.when(text.rlike(HINTS[kind]), F.transform(spans, voted)).otherwise(none)


def reliabilities(patterns: dict[tuple, float]) -> dict[tuple, float]:
    """Probability that a span with the given kind and votes is personal data, by expectation-maximisation.

    patterns: number of spans per (kind, votes). Votes are independent given the truth; how often each labeler votes for,
    against or not is estimated for true and false spans, and the share of true spans per kind.
    """
    kinds = {k for k, *_ in patterns}
    prior = dict.fromkeys(kinds, 0.7)
    # before any round, a labeler's vote is right more often than not
    says = [[{v: (0.5, 0.3, 0.2)[(v != 1) + (v == -1)] if truth else (0.2, 0.3, 0.5)[(v != 1) + (v == -1)] for v in (1, 0, -1)} for truth in (0, 1)] for _ in VOTES]
    post: dict[tuple, float] = {}
    for _ in range(ROUNDS):
        for kind, *votes in patterns:
            odds = [prior[kind] if truth else 1 - prior[kind] for truth in (0, 1)]
            for own, v in zip(says, votes, strict=True):
                odds = [o * own[truth][v] for truth, o in enumerate(odds)]
            post[kind, *votes] = odds[1] / sum(odds)
        for kind in kinds:
            own = [(n, post[p]) for p, n in patterns.items() if p[0] == kind]
            prior[kind] = (sum(n * q for n, q in own) + 7) / (sum(n for n, _ in own) + 10)
        for i, own in enumerate(says):
            for truth in (0, 1):
                mass = {v: sum(n * (post[p] if truth else 1 - post[p]) for p, n in patterns.items() if p[i + 1] == v) + 10 * start for v, start in zip((1, 0, -1), (0.5, 0.3, 0.2) if truth else (0.2, 0.3, 0.5), strict=True)}
                own[truth] = {v: m / sum(mass.values()) for v, m in mass.items()}
    return post


def span_features(kind: int, form: int, known: int, near: int, wide: int) -> list[float]:
    return [1.0, form, known, near, form * known, *(float(kind == k) for k in range(len(KINDS))), *(float(wide == w) for w in range(5))]


def trained(counts: dict[tuple, float]) -> list[float]:
    """Weights of a logistic classifier of spans, from their numbers per (kind, votes, width), by gradient ascent."""
    patterns: dict[tuple, float] = {}
    for (kind, form, known, near, _), n in counts.items():
        patterns[kind, form, known, near] = patterns.get((kind, form, known, near), 0) + n
    post, total = reliabilities(patterns), sum(counts.values())
    rows = [(span_features(*key), n / total, post[key[:4]]) for key, n in counts.items()]
    weights = [0.0] * len(span_features(0, 0, 0, 0, 0))
    for _ in range(2000):
        slope = [-RIDGE / total * w for w in weights]
        for x, n, q in rows:
            miss = n * (q - 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, weights, strict=True)))))
            slope = [s + miss * a for s, a in zip(slope, x, strict=True)]
        weights = [w + 1.0 * s for w, s in zip(weights, slope, strict=True)]
    return weights


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found for every row of `docs` (doc_id, text).

    found holds kind, start, end (code points, end exclusive) and score of each span, by kind and start; spans joins
    kind:start:end; base_sha256 is of the base kinds, which always stay; others need a score of one half. A span that
    overlaps a base span is not added. Null text counts as empty and holds nothing. An empty table gives an empty result.
    """
    text = F.translate(F.coalesce("text", F.lit("")), OPEN + CLOSE, "??")
    held = F.concat(*[spans_of(kind, F.col("text")) for kind in KINDS])
    rows = stored(docs.select(F.col("doc_id").cast("long"), text.alias("text")).select("doc_id", held.alias("spans")), "spans")
    keys = ("kind", *VOTES, "wide")
    counts = rows.select(F.explode("spans").alias("s")).select("s.*").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect()
    weights = trained({tuple(r[k] for k in keys): float(r["n"]) for r in counts}) if counts else [0.0] * len(span_features(0, 0, 0, 0, 0))

    def score(s: Column) -> Column:
        of_kind, of_width = (F.array(*map(F.lit, w)) for w in (weights[5 : 5 + len(KINDS)], weights[5 + len(KINDS) :]))
        linear = weights[0] + s["form"] * weights[1] + s["known"] * weights[2] + s["near"] * weights[3] + s["form"] * s["known"] * weights[4]
        return 1 / (1 + F.exp(-(linear + F.get(of_kind, s["kind"]) + F.get(of_width, s["wide"]))))

    def is_base(s: Column) -> Column:
        return s["kind"] < len(BASE)

    base = F.filter("spans", is_base)
    rows = rows.withColumn("base", base)
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    kept = F.filter("spans", lambda s: is_base(s) | ((score(s) >= FROM) & free(s)))
    names = F.array(*map(F.lit, KINDS))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    of_kind = lambda k: lambda s: s["kind"] == k
    number = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    detail = F.transform(kept, lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score(s).alias("score")))
    return rows.select("doc_id", *number, F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(kept).alias("spans"), detail.alias("found"))

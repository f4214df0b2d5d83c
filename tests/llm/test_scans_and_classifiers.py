"""Scans against plain versions of their base rules, classifiers on texts made for them."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyshelf.llm import language, personal_data, secret_scan, toxicity
from tallyshelf.llm.common import held_out

DOC = "doc_id long, text string"


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


# secrets


def plain_secrets(text):
    spans = []
    for k, pattern in enumerate((secret_scan.ASSIGN, r"AKIA[A-Z0-9]+", r"[0-9a-f]+")):
        for m in re.finditer(pattern, text):
            if len(m[2] if k == 0 else m[0]) >= (8, 16, 32)[k]:
                spans.append((m.start(), k, m.end()))
    return [(secret_scan.KINDS[k], s, e) for s, k, e in sorted(spans)]


def secret_texts():
    r = random.Random(1)
    bits = ["password: ", "TOKEN=", 'api_key = "', "apikey:", "AKIA", "AKIAABCDEFGHIJKL", "ABCDEFGHIJKLMNOP", "deadbeef" * 5, "0123456789abcdef" * 2, "abc", "ſecret=abcdefghij", "'", '"', " ", "\n", "é", "😀", "==", "x" * 9, "pwd: x9$Kq!2vLmP7 ", "secret=token=abcdefgh "]
    return ["".join(r.choice(bits) for _ in range(r.randrange(12))) for _ in range(400)]


def test_secrets_hold_the_base_matches(table):
    rows = [*enumerate(secret_texts()), (1000, None), (None, "token=abcdefgh"), (5, ""), (2000, "a" * 200_000 + " token=" + "b" * 100_000)]
    got = sorted(secret_scan.scan(table(DOC, rows)).collect(), key=lambda r: (str(r.doc_id), r.spans))
    assert len(got) == len(rows)
    want = []
    for d, t in rows:
        base = plain_secrets(t or "")
        n = Counter(k for k, _, _ in base)
        want.append((d, n["assign"], n["access"], n["hex"], sha(base)))
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == Counter(want)
    for r in got:
        base = [s for s in r.spans.split(",") if s and not s.startswith("guess")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256
    assert secret_scan.scan(table(DOC, [])).count() == 0


def test_guess_cost_is_the_least_over_all_segmentations():
    def plain(value, cuts):
        best = {0: 0.0}
        for j in range(1, len(value) + 1):
            best[j] = min([best[j - 1] + 1] + [best[i] + c + (0.3 if i else 0) for i, e, c in cuts if e == j])
        return best[len(value)]

    for value in ("password1", "qwerty2019", "aaaaaaa", "x9$Kq!2vLmP7", "P@ssw0rd", "abcdefg", "2019-03-04", "zxcvbnzxcvbn", ""):
        assert secret_scan.guess_cost(value) == pytest.approx(plain(value, list(secret_scan.segments(value))))
    cheap = ("password", "P@ssw0rd123456", "qwertyuiop", "aaaaaaaaaaaa", "2019-03-04", "letmein123")
    dear = ("x9$Kq!2vLmP7", "Zr4vQ8nLw2Tk")
    assert max(map(secret_scan.guess_cost, cheap)) < secret_scan.BOUND < min(map(secret_scan.guess_cost, dear))


def test_values_in_a_credentials_context_are_judged_by_guess_cost():
    spans = secret_scan.find_secrets("passphrase: x9$Kq!2vLmP7 and pwd = password1 and private key: no")
    assert [(secret_scan.KINDS[k], s, e) for s, k, e in spans] == [("guess", 12, 24)]


@pytest.mark.parametrize(
    "line, value",
    [
        ("AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzzz", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzzz"),
        ("db_pwd: x9$Kq!2vLmP7", "x9$Kq!2vLmP7"),
        ("DB_PASSWORD=x9$Kq!2vLmP7", "x9$Kq!2vLmP7"),
        ("my-client-secret" + " " * 20 + "= x9$Kq!2vLmP7", "x9$Kq!2vLmP7"),
        ("userpwd := x9$Kq!2vLmP7", "x9$Kq!2vLmP7"),
        ("password=Abcdefgh!9$kQ2vLmP7", "Abcdefgh!9$kQ2vLmP7"),
    ],
)
def test_values_after_prefixed_names_and_with_signs_are_found_whole(line, value):
    guessed = [line[s:e] for s, k, e in secret_scan.find_secrets(line) if k == 3]
    assert guessed == [value]


def test_ordinary_words_after_a_credentials_name_are_no_secrets(table):
    prose = ["pwd: international", "credentials: required", "passphrase: documentation", "client_secret => everything", "access_token = placeholder"]
    prose += ["pwd: thonearehandtion", "passphrase: see the thonearehandtion here, thonearehandtion"]  # a word of the corpus
    kept = ["pwd: x9$Kq!2vLmP7", "passphrase: Zr4vQ8nLw2Tk", "private-key: qvxkzjwphtbmd", "pwd: qvxkzjwphtbmd"]
    rows = [*enumerate(prose), *enumerate(kept, 100)]
    got = {r.doc_id: r.n_guess for r in secret_scan.scan(table(DOC, rows), public_tokenizers.path("word_bpe_49k.json")).collect()}
    assert [got[i] for i in range(len(prose))] == [0] * len(prose) and [got[100 + i] for i in range(len(kept))] == [1] * len(kept)


def test_a_value_that_a_base_span_covers_is_not_reported_again():
    assert [k for _, k, _ in secret_scan.find_secrets("my_token=Zr4vQ8nLw2Tk")] == [0]


# personal data


def plain_personal(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0

    number = lambda m: re.sub("[^0-9]", "", m[0])
    rules = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(number(m)) <= 19 and luhn(number(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(number(m)) <= 15),
    )
    return [(k, *m.span()) for k, (p, ok) in zip(personal_data.BASE, rules, strict=True) for m in re.finditer(p, text) if ok(m)]


def personal_texts():
    r = random.Random(2)
    bits = ["a.b", "@", "c-d", ".", "e.f", "%", "x@y.zz", "1.2.3.4", "256", "0.0.0.01", "4111 1111-1111 1111", "4111111111111112", "+1 (23) 456-7890", "+", "12", " ", "-", "(", ")", "é", "😀", "", "\n", "Mr. John Smith", "123-45-6789"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(14))) for _ in range(500)]


def test_personal_data_holds_the_base_matches(table):
    rows = [*enumerate(personal_texts()), (1000, None), (None, "a@b.c"), (5, ""), (2000, "9" * 20_000 + " " + "1 " * 20_000 + "a" * 20_000 + "@x " + "1." * 5000)]
    got = personal_data.scan(table(DOC, rows)).collect()
    want = []
    for d, t in rows:
        base = plain_personal(t or "")
        n = Counter(k for k, _, _ in base)
        want.append((d, *(n[k] for k in personal_data.BASE), sha(base)))
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == Counter(want)
    assert personal_data.scan(table(DOC, [])).count() == 0


def test_votes_of_labelers_add_spans_beyond_the_base_kinds(table):
    rows = [(i, f"SSN: 123-4{i % 10}-67{i % 9 + 10} and mail{i}@mail.example.com") for i in range(30)] + [(100, "part 912-00-0000 of"), (101, "write bob [at] mail [dot] com")]
    got = {r.doc_id: r.spans for r in personal_data.scan(table(DOC, rows)).collect()}
    assert all("ssn:5:16" in got[i] for i in range(30)) and got[101] == "mailto:6:29" and "ssn" not in got[100]


def test_reliable_labelers_are_found_without_labels():
    r = random.Random(3)
    patterns, truth = Counter(), {}
    for _ in range(4000):
        true = r.random() < 0.6
        votes = tuple((1 if r.random() < p else -1) if true else (1 if r.random() < 1 - p else -1) for p in (0.95, 0.9, 0.6))
        patterns[(0, *votes)] += 1
        truth.setdefault((0, *votes), []).append(true)
    post = personal_data.reliabilities(dict(patterns))
    assert all(abs(post[p] - sum(t) / len(t)) < 0.15 for p, t in truth.items() if len(t) > 100)


def test_plan_of_personal_data_has_no_python(table):
    plan = personal_data.scan(table(DOC, [(1, "a@b.c")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# toxicity


def prose(r, n, more=()):
    out = [r.choice("the of and in that with house river stone paper light water green table".split()) + r.choice(["", "s", "ed", "ing"]) for _ in range(n)]
    for w in more:
        out.insert(r.randrange(len(out)), w)
    return " ".join(out)


def toxic_rows():
    r = random.Random(4)
    bad = ["idiotic", "wretchful", "scumming", "vilest"]
    rows, labels = [], []
    for i in range(800):
        toxic = i % 5 == 0
        rows.append((i, prose(r, 80, r.choices(bad, k=4) if toxic else ())))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_is_learned_from_rows_that_are_not_held_out(table):
    rows, labels = toxic_rows()
    extra = [(2000, None), (2001, ""), (None, "idiotic"), (2002, "the house " * 20_000), (2003, "x" * 5000)]
    docs, marks = table(DOC, rows + extra), table("doc_id long, toxic int", [*labels, (None, 1), (7, None), (1, 0)], extra=False)
    held = held_out(F.col("doc_id"), 4, 2)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, marks, held).collect()}
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    tested = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in tested) for i, _ in rows)
    assert np.mean([got[i].predicted == labels[i][1] for i in tested]) > 0.95
    assert not got[2001].predicted and not got[2000].predicted and got[2000].score == got[2001].score
    turned = [(i, 1 - t if i in tested else t) for i, t in labels]  # labels of held-out rows do not matter
    again = toxicity.toxicity(docs, table("doc_id long, toxic int", turned, extra=False), held).collect()
    assert {r.doc_id: r.score for r in again} == pytest.approx({i: r.score for i, r in got.items()})


def tailed_rows(phrases):
    """Toxic texts with four of 3000 words of a long tail, or with phrases of ordinary words."""
    r = random.Random(1)
    syllables = "the of and in er on an re he ing ed es ou ti en at wh bl ly ion sh nd st".split()
    ordinary = ["".join(r.choice(syllables) for _ in range(r.choice([1, 1, 2, 2, 3]))) for _ in range(3000)]
    bad = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(6, 11))) for _ in range(3000)]
    if phrases:
        bad = [" ".join(r.choice(ordinary[:300]) for _ in range(3)) for _ in range(40)]
    often, rows = [[1 / (i + k) for i in range(len(w))] for k, w in ((5, bad), (3, ordinary))], []
    for i in range(4000):
        out = r.choices(ordinary, often[1], k=r.randrange(60, 160))
        for w in r.choices(bad, often[0], k=4) if i % 5 == 0 else ():
            out.insert(r.randrange(len(out)), w)
        rows.append((i, " ".join(out)))
    return rows, [(i, int(i % 5 == 0)) for i, _ in rows]


@pytest.mark.parametrize("phrases, recall, precision", [(False, 0.96, 0.96), (True, 0.75, 0.5)])
def test_toxicity_of_rare_words_and_of_phrases(table, phrases, recall, precision):
    rows, labels = tailed_rows(phrases)
    marks = table("doc_id long, toxic int", labels, extra=False)
    got = toxicity.toxicity(table(DOC, rows), marks, held_out(F.col("doc_id"), 4, 2)).filter("held_out").collect()
    found = [r.predicted for r in got if r.doc_id % 5 == 0]
    wrong = [r.predicted for r in got if r.doc_id % 5]
    print(phrases, "recall", np.mean(found), "precision", sum(found) / max(sum(found) + sum(wrong), 1))
    assert np.mean(found) > recall and sum(found) > precision * (sum(found) + sum(wrong))


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1)]])
def test_toxicity_without_labels_of_both_kinds(table, labels):
    got = toxicity.toxicity(table(DOC, [(1, "a"), (2, None)]), table("doc_id long, toxic int", labels, extra=False), F.lit(False)).collect()
    assert [r.score for r in got] == [float(bool(labels) and labels[0][1])] * 2
    assert toxicity.toxicity(table(DOC, []), table("doc_id long, toxic int", labels, extra=False), F.lit(False)).count() == 0


def test_toxicity_can_carry_the_rows(table):
    rows, labels = toxic_rows()
    docs = table(DOC, rows)
    got = toxicity.toxicity(docs, table("doc_id long, toxic int", labels, extra=False), F.lit(None), carry=True).select("row.*")
    assert got.columns == docs.columns and got.exceptAll(docs).isEmpty() and docs.exceptAll(got).isEmpty()


# language


def language_rows():
    r = random.Random(5)
    stems = {"en": "the and of house water with thing".split(), "de": "der und von haus wasser mit schön".split(), "fr": "le et de maison eau avec où été".split()}
    rows = []
    for i in range(600):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, " ".join(r.choice(stems[lang]) for _ in range(r.randrange(3, 60))), lang))
    rows += [(1000, None, "en"), (1001, "", None), (1002, "123 !? 45", "de"), (1003, "the house and water of thing " * 20 + "der und von haus wasser " * 5, None), (None, "the house", None), (1004, "le " * 100_000, None)]
    return rows


def test_language_is_learned_from_rows_that_are_not_held_out(table):
    rows = language_rows()
    got = {r.doc_id: r for r in language.identify(table("doc_id long, text string, lang string", rows), held_out(F.col("doc_id"), 3, 1)).collect()}
    assert len(got) == len(rows)
    tested = [(i, lang) for i, _, lang in rows[:600] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i, _ in tested) and np.mean([got[i].lang_pred == lang for i, lang in tested]) > 0.97
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert set(got[1003].mixture) == {"de", "en"} and got[1003].lang_pred == "en" and abs(got[1003].score - 120 / 145) < 0.05
    assert got[1004].lang_pred == "fr" and got[None].lang_pred == "en"


def test_language_without_anything_learned(table):
    got = language.identify(table("doc_id long, text string, lang string", [(1, "a b", None), (2, "a", "en")]), F.lit(True)).collect()
    assert {r.lang_pred for r in got} == {"und"}
    assert language.identify(table("doc_id long, text string, lang string", []), F.lit(True)).count() == 0


def test_grams_lie_within_words():
    cells, words, text_of = language.word_grams(pa.array(["Ab c", None, "", "12", "é x"]))
    assert text_of.tolist() == [0, 0, 4, 4]
    alone = [language.word_grams(pa.array([w]))[0] for w in ("ab", "c", "é", "x")]
    assert [sorted(cells[words == i]) for i in range(4)] == [sorted(a) for a in alone]


def test_mixture_leaves_out_what_is_not_used():
    r = np.random.default_rng(0)
    p = np.exp(-6 * (1 - np.eye(3)))
    likelihood = np.vstack([p[[0] * 40], p[[0] * 30 + [1] * 10], np.clip(p[r.integers(0, 3, 60)], 1e-9, 1)])
    share = language.infer(likelihood, np.repeat([0, 1, 2], [40, 40, 60]))
    assert share[0].tolist() == [1, 0, 0] and share[1, 2] == 0 and abs(share[1, 0] - 0.75) < 0.02 and (share[2] > 0).all()

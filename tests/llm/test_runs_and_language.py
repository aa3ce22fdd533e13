"""Operators 11 and 12 against brute force and held-out rows, and on odd tables."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from triweave.llm import language_id, periodic_runs

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, runs int, h string, best string"


def brute_runs(w, least, exponent):
    """(start, end, period) by the definition: grown as far as the period holds, on both sides."""
    out = set()
    for b in range(len(w)):
        for p in range(1, len(w) - b):
            if b and w[b - 1] == w[b - 1 + p]:
                continue
            e = b + p
            while e < len(w) and w[e] == w[e - p]:
                e += 1
            if e - b >= max(least, exponent * p) and not any(all(w[i] == w[i + q] for i in range(b, e - q)) for q in range(1, p)):
                out.add((b, e, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_all_runs_of_random_sequences_equal_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        n, kinds = rng.randrange(70), rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(kinds) for _ in range(n)]
        if n > 10 and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + rng.randrange((n - a) // 3 + 1)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        for least, exponent in ((6, 4), (2, 2), (3, 3)):
            assert [tuple(r) for r in periodic_runs.all_runs(np.array([*w, 99]), least, exponent).tolist()] == brute_runs(w, least, exponent)


def test_runs_of_a_fibonacci_word_and_of_one_word_repeated():
    a, b = "0", "01"
    for _ in range(8):
        a, b = b, b + a
    w = [int(x) for x in b]
    assert [tuple(r) for r in periodic_runs.all_runs(np.array([*w, 9]), 2, 2).tolist()] == brute_runs(w, 2, 2)
    assert periodic_runs.all_runs(np.array([0] * 50_000 + [9])).tolist() == [[0, 50_000, 1]]


def test_longest_previous_factors_and_both_extensions():
    rng = np.random.default_rng(4)
    w = np.append(rng.integers(0, 3, 300), 9)
    repeats = periodic_runs.Repeats(w)
    text = w.tolist()
    assert repeats.array.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    length, source = repeats.factors()
    share = lambda i, j: next(k for k in range(len(text)) if text[i + k] != text[j + k])
    for i in range(len(text)):
        assert length[i] == max((share(j, i) for j in range(i)), default=0)
        assert (source[i] < 0) == (length[i] == 0) and (length[i] == 0 or share(int(source[i]), i) == length[i])
    i, j = rng.integers(0, 300, 500), rng.integers(0, 300, 500)
    i, j = i[i != j], j[i != j]
    back = [next((k for k in range(len(text)) if min(a, b) - k < 0 or text[a - k] != text[b - k]), 0) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert repeats.back(i, j).tolist() == back


def runs_of_document(doc_id, text):
    """The digest of one row, in plain Python."""
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w, 6, 4)
    best = max(runs, key=lambda r: (Fraction(r[1] - r[0], r[2]), -r[0], -r[2]), default=None)
    gone = {i for b, e, q in runs for i in range(b + q, e)}
    first = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    lines = "".join(f"{b},{e - b},{q}\n" for b, e, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_digest_equals_brute_force(spark):
    rng, rows = random.Random(2), []
    for i in range(250):  # about a tenth get a planted stretch
        rows.append((i, rng.choice(["", " ", "\n"]).join(["", *(rng.choice("abcdé") + rng.choice([" ", "\t", "  ", "\r\n"]) for _ in range(rng.randrange(90)))])))
    rows += [(None, "x y " * 9), (300, None), (301, ""), (302, " \n\t "), (302, "no no no no"), (303, "a " * 400 + "b"), (303, "a " * 400 + "b"), (304, "A a A a A a A a"), (-5, "z " * 30)]
    rows.append((305, "one"))
    docs = spark.createDataFrame([(a, b, None, "s", 1, "x", "y") for a, b in rows], SCHEMA)
    got = sorted((tuple(r) for r in periodic_runs.runs_digest(docs).collect()), key=repr)
    assert got == sorted((runs_of_document(*r) for r in rows), key=repr)
    assert periodic_runs.runs_digest(docs.where("false")).count() == 0


def test_runs_operator_keeps_texts_and_other_bounds(spark):
    docs = spark.createDataFrame([(1, "go go go on and on and on")], "doc_id long, text string")
    row = periodic_runs.periodic_runs(docs, 3, 2).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 3, 1), (3, 5, 2)] and row.collapsed == "go on and" and row.n_words == 8


WORDS_OF = {"en": "the of and with house there which morning", "fr": "le la les être où maison été que", "de": "der und nicht für haus schön über straße"}


def language_rows(rng, n):
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS_OF))
        rows.append((i, " ".join(rng.choice(WORDS_OF[lang].split()) + rng.choice(["", "", ".", " 12"]) for _ in range(rng.choice([3, 8, 40])))) + (lang,))
    return rows


def test_language_of_held_out_rows(spark):
    rng = random.Random(3)
    rows = language_rows(rng, 400)
    docs = spark.createDataFrame([(*r, "s", 1, "h", "b") for r in rows], SCHEMA)
    got = {r.doc_id: r for r in language_id.language_digest(spark, docs).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r.held_out} == {r[0] for r in held}
    assert sum(got[i].lang_pred == lang for i, _, lang in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    # neither the labels of held-out rows nor any prediction's own label count
    other = spark.createDataFrame([(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang, "other", 2, "", "") for i, t, lang in rows], SCHEMA)
    assert {r.doc_id: (r.lang_pred, r.score) for r in language_id.language_digest(spark, other).collect()} == {i: (r.lang_pred, r.score) for i, r in got.items()}


def test_language_scores_equal_plain_python(spark):
    rows = language_rows(random.Random(5), 60)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.language_model(known, most=40, k=2)
    learned = [t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 5]

    def places(text):
        x, out = " " + re.sub("[^a-zß-ÿ]+", " ", text.lower()).strip() + " ", {}
        for n in (1, 2, 3):
            for j in range(len(x) - n + 1):
                gram = 0
                for c in x[j : j + n]:
                    gram = (gram * 0x100000001B3 + ord(c) + 1) % (1 << 64)
                if x[j : j + n] != " ":
                    place = (gram * 0x9E3779B97F4A7C15) % (1 << 64) >> (64 - language_id.BITS)
                    out[place] = out.get(place, 0) + 1
        return out

    df = np.zeros(language_id.WIDTH)
    for t in learned:
        df[list(places(t))] += 1
    assert np.allclose(model.idf, np.log((1 + len(learned)) / (1 + df)) + 1)
    for r in language_id.identify(spark, docs, model).collect():
        v = np.zeros(language_id.WIDTH)
        for place, n in places(rows[r.doc_id][1]).items():
            v[place] = np.log1p(n) * model.idf[place]
        cosine = model.centroids @ (v / np.sqrt(v @ v))
        assert abs(cosine.max() - r.score) < 1e-5 and model.languages[int(cosine.argmax())] == r.lang
        assert r.accepted == (1 - r.score <= model.radii[int(cosine.argmax())]) or abs(1 - r.score - model.radii[int(cosine.argmax())]) < 1e-5


def test_language_rejects_what_is_far_from_all(spark):
    docs = spark.createDataFrame(language_rows(random.Random(6), 200), "doc_id long, text string, lang string")
    model = language_id.language_model(docs)
    far = spark.createDataFrame([(1, "щука жёлтый объём юбка"), (2, "the house and the morning of which the house")], "doc_id long, text string")
    assert {r.doc_id: r.accepted for r in language_id.identify(spark, far, model).collect()} == {1: False, 2: True}


def test_language_on_odd_tables(spark):
    odd = [(900, None, "en"), (901, "", "en"), (902, "12 !? ́", "fr"), (903, "é" * 30_000, "fr"), (None, "the house", "en"), (904, "les maisons", None), (904, "les maisons", None), (905, "straße " * 20_000, "de")]
    rows = [*language_rows(random.Random(7), 80), *odd]
    docs = spark.createDataFrame([(*r, "s", 1, "h", "b") for r in rows], SCHEMA)
    got = [r for r in language_id.language_digest(spark, docs).collect() if r.doc_id is None or r.doc_id >= 900]
    assert len(got) == len(odd)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {900, 901, 902} and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert {r.lang_pred for r in got if r.doc_id == 904} == {"fr"}
    assert language_id.language_digest(spark, docs.where("false")).count() == 0
    unlabelled = docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang <> ''")
    assert unlabelled.count() == 0
    nothing_known = language_id.language_digest(spark, docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang"))
    assert {r.lang_pred for r in nothing_known.collect()} == {"und"}

"""The ten operators against brute force, round trips and held-out accuracy, and on odd tables."""

import collections
import itertools
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from triweave.llm import chat, decontaminate, features, line_dedup, mixing, ngram_join, quality, shingles, token_ids, topk_search, toxicity, url_filter, words
from triweave.plans.scratch import Scratch

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, size long, `key` string"
DOCS = [
    (1, "The cat sat on the mat. The dog sat on the log near the door\nA second line of seven plain words here", "en", "b"),
    (2, "The cat sat on the mat. The dog sat on the log near the door\nA second line of seven plain words here", "en", "a"),
    (2, "The cat sat on the mat. The dog sat on the log near the door\nA second line of seven plain words here", "en", "a"),
    (3, None, None, None),
    (4, "", "en", None),
    (5, " \t\n\r ", "en", "b"),
    (6, "two words", None, "c"),
    (7, "TWO WORDS", None, "c"),
    (None, "a text without an id but with enough words to count", "en", "c"),
    (8, "word " * 30_000 + "ende", "de", "a"),
    (9, "é\u00a0x\u2003y\x85z \U0001f600 <|endoftext|> it's 'S <|ENDOFTEXT|>", "fr", ""),
    (10, "A second line of seven plain words there\nA second line of seven plain words here\nthe line of a kind", "en", "\U00010000"),
]


@pytest.fixture(autouse=True)
def few_passes(monkeypatch):
    """Ranges of joint tokens change no result, only how many small jobs a run has."""
    monkeypatch.setattr(ngram_join, "PASSES", 2)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*d, None, "x", 5, "y") for d in DOCS], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_words():
    texts = [d[1] for d in DOCS] + ["  a\x0b\x0cb\t ", "\x1cq r"]
    offsets, codes, vocabulary = words.split_words(pa.array(texts))
    assert [[vocabulary[c] for c in codes[a:b]] for a, b in zip(offsets, offsets[1:], strict=False)] == [split(t) for t in texts]


# 1


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_rank_code_round_trip(n):
    ranks = np.random.default_rng(n).choice([0, 1, 255, 256, 65_535, 65_536, 1 << 24, (1 << 32) - 1], n).astype(np.uint32)
    control, data = token_ids.encode_ranks(ranks)
    assert len(control) == -(-n // 4) and (token_ids.decode_ranks(control, data, n) == ranks).all()


def test_word_ids_of_odd_strings_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, words_of = Tokenizer.from_file(path), token_ids.WordTokenizer(path)
    marks = "\u0308\u0331\u030a\u030c\u0301\u0338\u0307"
    alphabet = [*"abThWJIiSs'.,-09<|>!?&", *marks, *"\u0130\u0131\u00df\u1e9e\u03a3\u212a\u00e9\u00c9\u4e2d\U0001f600\u00a0\x85\x1c\u01c5\ufb01\x00", "<|endoftext|>", "<|ENDOFTEXT|>", " ", " ", "\n", "'S"]
    rng = random.Random(8)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(14))) for _ in range(20_000)]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        offsets, ids = words_of(pa.array([*part, None]))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in [*part, ""]]


def test_token_ids_equal_the_library(spark, docs, nothing, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted(token_ids.token_id_output(spark, docs).collect(), key=lambda r: r.start)
    ids = {id(d): np.array([*tokenizer.encode(d[1] or "", add_special_tokens=False).ids, 1], "<u4") for d in DOCS}
    order = sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0, len(ids[id(d)])))
    start = 0
    for d, r in zip(order, rows, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d[0], start, len(ids[id(d)]), zlib.crc32(ids[id(d)].tobytes()))
        start += r.n_tokens
    assert token_ids.token_id_output(spark, nothing).count() == 0


# 2 and 6


def test_toxicity_and_quality_on_held_out_rows(spark):
    rng, base = random.Random(0), [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(base) for _ in range(40)]
        toxic, bad = i % 5 == 0, i % 7 == 0
        if toxic:
            text[3:3] = [rng.choice(["idiot", "scum", "loser"]), "vile"]
        if bad:
            text = [f"{w}%%%" for w in text]
        rows.append((i, " ".join(text)))
        if i < 600:
            labels.append((i, int(not bad), int(toxic and not bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    flagged = {r.doc_id for r in toxicity.score_toxicity(spark, docs, labels).where("flagged").collect()}
    clean = {i for i in range(900) if i % 5 and i % 7}
    assert not flagged & clean and len(flagged & {i for i in range(600, 900) if i % 5 == 0 and i % 7}) >= 0.95 * sum(1 for i in range(600, 900) if i % 5 == 0 and i % 7)
    scored = quality.quality_digest(spark, docs, labels).collect()
    assert {r.doc_id for r in scored if not r.keep} == {i for i in range(900) if i % 7 == 0}
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in scored)


def test_models_on_odd_tables(spark, docs, nothing):
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (no_labels, one):
        got = toxicity.score_toxicity(spark, docs, labels).collect()
        assert len(got) == len(DOCS) and not any(r.flagged for r in got)
        kept = quality.keep_good(spark, docs, labels)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 6, 7, None, 8, 9, 10}
        assert toxicity.score_toxicity(spark, nothing, labels).count() == 0 == quality.keep_good(spark, nothing, labels).count()


def test_ordinal_gradient():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(30) < 0.4) for _ in range(400)]
    z = np.array([2.0 * (0 in r) - 2.0 * (1 in r) for r in rows])
    grades = (z + rng.logistic(size=400) > -1).astype(int) + (z + rng.logistic(size=400) > 1).astype(int)
    model = quality.fit_ordinal(rows, grades, l1=1e-4, steps=300)
    assert model.weights[0] > 0.8 and model.weights[1] < -0.8 and model.thresholds[0] < model.thresholds[1]


# 3


def jaccard_groups(texts, k, num, den):
    sets = {i: frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if (w := split(t)) else frozenset() for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def shuffled(spark, rows, parts, seed=5):
    """The rows in no order of doc_id, in so many partitions."""
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string")


@pytest.mark.parametrize(("k", "num", "parts"), [(3, 90, 1), (5, 80, 2), (1, 50, 6)])
def test_ngram_join_equals_brute_force(spark, k, num, parts):
    rng, texts = random.Random(k), {}
    for family in range(12):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 2, 4, 9, 15, 40, 120, 300]))]
        for copy in range(14):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, len(base) // 20, len(base) // 10])):
                text[rng.randrange(len(text))] = f"w{rng.randrange(80)}"
            texts[family * 100 + copy] = " ".join(text)
    frame = shuffled(spark, texts.items(), parts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(spark, frame, k, (num, 100)).collect()}
    assert got == jaccard_groups(texts, k, num, 100)


@pytest.mark.parametrize("parts", [1, 3])
def test_copies_stand_for_their_set_in_any_order(spark, parts):
    rng, rows, near = random.Random(9), [], {}
    for family in range(6):
        text = [f"w{rng.randrange(5000)}" for _ in range(80)]
        other = [*text[:-1], "changed"]
        near[family * 10 + 3] = family * 10 + 1
        rows += [(family * 10 + 2, " ".join(text)), (family * 10 + 1, " ".join(text)), (family * 10 + 3, " ".join(other))]
    frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.similar_groups(spark, frame, 5, (80, 100)).collect()}
    assert got == {i: i // 10 * 10 + 1 for i, _ in rows} and all(got[a] == b for a, b in near.items())
    assert sorted(r.doc_id for r in ngram_join.one_of_each(spark, frame).collect()) == [f * 10 + 1 for f in range(6)]


def test_ngram_join_across_small_groups_and_doubled_rows(spark, monkeypatch):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(80)]
    texts = {}
    for i in range(70):
        text = list(base)
        for _ in range(rng.randrange(7)):
            text[rng.randrange(80)] = f"x{rng.randrange(1000)}"
        texts[i] = " ".join(text)
    want = jaccard_groups(texts, 3, 90, 100)
    assert len({c for _, c in want.values()}) > 5
    for docs, queries, moves in ((4, 3, 0), (16, 4096, 1)):
        monkeypatch.setattr(ngram_join, "MOVES", moves)  # 0: with a forest of links first
        monkeypatch.setattr(ngram_join, "DOCS", docs)
        monkeypatch.setattr(ngram_join, "QUERIES", queries)
        monkeypatch.setattr(ngram_join, "HOT", 2)
        frame = spark.createDataFrame([*texts.items(), *texts.items()], "doc_id long, text string").repartition(6)
        got = ngram_join.similar_groups(spark, frame, 3, (90, 100)).collect()
        assert len(got) == 2 * len(want) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_pairs_keep_every_link():
    rng = np.random.default_rng(3)
    for num in (50, 80, 90):
        sets, pool = [], rng.integers(0, 1 << 63, 4000).astype(np.uint64)
        for n in (1, 5, 30, 31, 33, 200, 900):
            base = rng.choice(pool, n, replace=False)
            sets += [np.unique(np.where(rng.random(n) < p, rng.choice(pool, n), base)) for p in (0, 0.02, 0.05, 0.1, 0.2, 0.4)]
        comp, member = np.arange(len(sets)), rng.random(len(sets)) < 0.5
        pairs = {frozenset(p) for p in zip(*(x.tolist() for x in shingles.near_pairs([len(x) for x in sets], [shingles.bitmap(x) for x in sets], member, comp, True, num, 100)), strict=True)}
        for i, j in itertools.combinations(range(len(sets)), 2):
            both = len(np.intersect1d(sets[i], sets[j]))
            assert shingles.shared(sets[i], sets[j]) == both
            if 100 * both >= num * (len(sets[i]) + len(sets[j]) - both) and (member[i] or member[j]):
                assert frozenset((i, j)) in pairs


def test_ngram_join_on_odd_tables(spark, docs, nothing):
    got = ngram_join.similar_groups(spark, docs, 3, (90, 100)).collect()
    assert len(got) == len(DOCS)
    by_id = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert by_id[2][1] == 1 and by_id[7] == (1, 6) and by_id[3] == (0, 3) and by_id[4] == (0, 4) and by_id[None][1] is None
    kept = ngram_join.one_of_each(spark, docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 8, 9, 10]
    assert ngram_join.one_of_each(spark, nothing).count() == 0


def test_one_of_each_tells_texts_of_one_doc_id_apart(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (2, a + " end"), (2, b), (2, b), (3, c), (3, a), (None, b), (None, b), (None, "of its own words here"), (None, "of its own words here"), (4, None), (None, None)]
    kept = ngram_join.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, ""), (0, "of its own words here"), (1, a), (2, b), (3, c), (4, "")]


# 4


def test_decontamination_finds_paraphrases(spark, docs, nothing):
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("ar", "el", "in", "os", "ut", "ank", "ers", "ill")]
    sentence = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(sentence(20 + i % 30)).capitalize() + ".") for i in range(40)]
    rows, leaks = [], set()
    for d in range(400):
        text = sentence(rng.choice([30, 120, 300]))
        if d % 4 == 0:
            i = d // 4 % 40
            part = [w if rng.random() > 0.12 else rng.choice(vocabulary) for w in items[i][1].split() if rng.random() > 0.06]
            at = rng.randrange(len(text))
            text[at:at] = part
            leaks.add((d, i))
        rows.append((d, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "...")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.benchmark_matches(spark, frame, bench).where("NOT paraphrase").collect()}
    exact, spans = set(), set()  # brute force: the checks on every window of every document, and on spans of an item's length one word apart
    for d, text in rows:
        w = [decontaminate.normal(x) for x in text.split()]
        for i, item in items:
            q = [decontaminate.normal(x) for x in item.split()]
            masks = collections.defaultdict(int)
            for p, x in enumerate(q):
                masks[x] |= 1 << p
            answer = q[-decontaminate.ANSWER :]
            hops = -(-len(q) // decontaminate.HOP) + 1
            for s in range(0, len(w), decontaminate.HOP):
                window = w[s : s + hops * decontaminate.HOP]
                if decontaminate.lcs(masks, window) >= decontaminate.LCS_SHARE * len(q) and sum(x in set(window) for x in answer) >= decontaminate.ANSWER_SHARE * len(answer):
                    exact.add((d, i))
            for s in range(0, len(w), 1) if sum(x in masks for x in w) >= decontaminate.LCS_SHARE * len(q) else ():
                span = w[s : s + len(q)]
                if sum(x in masks for x in span) >= decontaminate.LCS_SHARE * len(q) and decontaminate.lcs(masks, span) >= decontaminate.LCS_SHARE * len(q) and sum(x in set(span) for x in answer) >= decontaminate.ANSWER_SHARE * len(answer):
                    spans.add((d, i))
    assert spans and spans <= got
    assert leaks & exact == leaks or len(leaks & exact) >= 0.95 * len(leaks)
    assert len(got & exact) >= 0.9 * len(exact) and got <= exact  # recall and no others
    assert decontaminate.benchmark_matches(spark, nothing, bench).count() == 0
    assert decontaminate.without_benchmark(spark, docs, bench.limit(0)).count() == len(DOCS)
    assert decontaminate.without_benchmark(spark, docs, bench).columns == docs.columns


def test_paraphrases_are_found_through_the_latent_space_alone(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda topic, concept, form: f"t{topic}c{concept}{'ab'[form]}"  # noqa: E731 - two words for each concept
    of_topic = lambda topic, n: [(topic, rng.randrange(12), rng.randrange(2)) for _ in range(n)]
    filler = lambda n: [f"f{rng.randrange(3000)}" for _ in range(n)]
    items = {i: of_topic(i % 40, 20) for i in range(80)}
    rows, reworded = [], set()
    for d in range(500):
        text = []
        for _ in range(6):  # passages on a subject, its words far between
            part = filler(24) + [word(*x) for x in of_topic(rng.randrange(40), 8)]
            rng.shuffle(part)
            text += part
        if d % 5 == 0:
            said = [word(t, c, f ^ (rng.random() < 0.55)) for t, c, f in items[d // 5 % 80]]
            masks = collections.defaultdict(int)
            for p, x in enumerate(items[d // 5 % 80]):
                masks[word(*x)] |= 1 << p
            text[70:70] = filler(40) + said + filler(40)
            if 0.4 * 20 <= decontaminate.lcs(masks, said) < 0.5 * 20:
                reworded.add((d, d // 5 % 80))
        rows.append((d, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(word(*x) for x in q)) for i, q in items.items()], "item_id long, text string")
    found = decontaminate.benchmark_matches(spark, frame, bench).collect()
    paraphrases = {(r.doc_id, r.item_id) for r in found if r.paraphrase}
    assert len(reworded) > 10 and len(reworded & paraphrases) >= 0.8 * len(reworded)
    assert all(d % 5 == 0 for d, _ in paraphrases) and all(r.cosine >= decontaminate.PARAPHRASE_COSINE for r in found if r.paraphrase)
    kept = {r.doc_id for r in decontaminate.without_benchmark(spark, frame, bench).select("doc_id").collect()}
    assert {d for d, _ in rows if d % 5} <= kept and not kept & {d for d, _ in paraphrases}
    monkeypatch.setattr(decontaminate, "singular_vectors", lambda z, r, rank: (np.zeros((len(z), 0), np.float32), np.zeros(0, np.float32)))
    without = decontaminate.benchmark_matches(spark, frame, bench).collect()
    assert not any(r.paraphrase for r in without) and not reworded & {(r.doc_id, r.item_id) for r in without}


def planted(n_items, lengths, seed, tail=1.1, head=3000):
    """(documents, items, planted pairs): verbatim items in long documents of Zipf-distributed benchmark and other words."""
    rng = np.random.default_rng(seed)
    weights = 1 / np.arange(1, head + 1) ** tail
    words = lambda n: [f"w{x}" for x in rng.choice(head, n, p=weights / weights.sum())]
    items = [(i, words(lengths[i % len(lengths)])) for i in range(n_items)]
    rows, pairs = [], set()
    for d in range(2 * n_items):
        text, i = words(160 + d % 90), d % n_items
        at = int(rng.integers(len(text)))
        text[at:at] = items[i][1]
        rows.append((d, " ".join(text)))
        pairs.add((d, i))
    return rows, [(i, " ".join(x)) for i, x in items], pairs


def test_decontamination_finds_every_verbatim_item(spark):
    rows, items, pairs = planted(60, [6, 12, 16, 25, 40], 3)
    rows.append((1000, "one - two , three - four ( five ) six - seven - eight nine ten"))
    items += [(100, "one two - three four five six seven eight nine ten"), (101, "three - four - five"), (102, "the")]
    rows.append((1001, "so the end"))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontaminate.benchmark_matches(spark, frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): (r.lcs_share, r.answer_share) for r in found}
    assert pairs | {(1000, 100), (1000, 101), (1001, 102)} <= set(got)
    assert all(got[p] == (1.0, 1.0) for p in pairs)


def test_short_items_do_not_change_the_weights_of_others(spark):
    rows, items, pairs = planted(60, [16, 25, 40], 5, tail=0.8)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    short = [(200 + i, text) for i, text in enumerate(["w0 w1 w2", "w1", "w3 w0", "w2 w2 w1 w0"])]
    cosines = []
    for bench in (items, items + short):
        found = decontaminate.benchmark_matches(spark, frame, spark.createDataFrame(bench, "item_id long, text string")).collect()
        cosines.append({(r.doc_id, r.item_id): r.cosine for r in found if r.item_id < 200})
        assert pairs <= set(cosines[-1])
    plain, mixed = cosines
    assert plain == {p: c if c is None else pytest.approx(c, abs=1e-3) for p, c in mixed.items()}
    assert sum(c is not None for c in plain.values()) > 0.5 * len(plain)
    texts = {d: f" {text} " for d, text in rows}
    for i, text in short:
        assert {r.doc_id for r in found if r.item_id == i} == {d for d, t in texts.items() if f" {text} " in t}


def test_exact_candidates_hold_every_window_that_passes(monkeypatch):
    monkeypatch.setattr(decontaminate, "PAIRS", 50)
    rng = np.random.default_rng(0)
    texts = [rng.integers(-1, 25, n) for n in (0, 1, 15, 16, 17, 90, 400, 33)]
    rows = [(n, " ".join(f"w{x}" for x in rng.integers(0, 25, n))) for n in (1, 2, 5, 7, 8, 9, 16, 17, 30)]
    vocabulary = decontaminate.Vocabulary({f"w{i}" for i in range(25)})
    offsets, codes = np.concatenate(([0], np.cumsum([len(t) for t in texts]))), np.concatenate(texts)
    items = decontaminate.Items(rows, vocabulary, np.zeros((25, 0), np.float32), np.zeros(25, bool), np.bincount(codes[codes >= 0], minlength=25))
    want = {
        (d, i, int(a), int(min(a + items.hops[i] * decontaminate.HOP, end)))
        for d, (begin, end) in enumerate(zip(offsets[:-1], offsets[1:], strict=True))
        for i in range(len(rows))
        for a in range(begin, end, decontaminate.HOP)
        if items.check(i, codes[a : min(a + items.hops[i] * decontaminate.HOP, end)].tolist())
    }
    got = list(zip(*(x.tolist() for x in decontaminate.exact_candidates(offsets, codes, items)), strict=True))
    assert want and want <= set(got) and len(got) == len(set(got))


def test_lcs():
    masks = {}
    for i, c in enumerate("abcbdab"):
        masks[c] = masks.get(c, 0) | 1 << i
    assert decontaminate.lcs(masks, "bdcaba") == 4 and decontaminate.lcs(masks, "") == 0


# 5


def test_url_rules(spark):
    urls = ["https://A.Example.ORG/es/x?q#f", "http://org/", "http://org", "x://example.org/en/12", "x://notexample.org/es/", "http://m.b.com/de/1", "http://com/fr/", "", None, "no scheme", "://net/login/", "http://casino.net/", "http://net/x?affiliate_id=7", "HTTP://a.net/file.EXE", "http://org/a://b"]
    got = url_filter.url_verdicts(spark, spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")).collect()
    want = [("a.example.org", "/es/x", "example.org/es/", "block"), ("org", "/", "org/", "allow"), ("org", "", None, "allow"), ("example.org", "/en/12", "example.org/en/1", "block"), ("notexample.org", "/es/", "org/", "allow"), ("m.b.com", "/de/1", "com/de/", "block"), ("com", "/fr/", "com/fr/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("net", "/login/", None, "block"), ("casino.net", "/", None, "block"), ("net", "/x", None, "block"), ("a.net", "/file.EXE", None, "block"), ("org", "/a://b", "org/", "allow")]
    assert [(r.host, r.path, r.rule, r.verdict) for r in sorted(got, key=lambda r: r.page_id)] == want
    sliced = url_filter.url_verdicts(spark, spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), slice_rules=2).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in sorted(sliced, key=lambda r: r.page_id)] == want
    assert url_filter.url_verdicts(spark, spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_index_fetches_all_that_match():
    index = url_filter.RuleIndex(list(url_filter.DEFAULT_RULES), {"com": 5, "org": 9})
    rng = random.Random(0)
    pieces = ["http://", "x://", "a.", "example.", "org", "com", "net", "/", "/es/", "/en/", "1", "de/", "fr/", "login", "casino", "?affiliate_id=3", ".zip", "-", "cart/add"]
    for _ in range(3000):
        url = "".join(rng.choice(pieces) for _ in range(rng.randrange(8)))
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [r for r in url_filter.DEFAULT_RULES if re.search(r.pattern, host + path if r.where == "place" else url.lower())]
        placed = [r for r in fits if r.where == "place"]
        best = max(placed, key=url_filter.rank) if placed else None
        assert index.judge(host, path, url) == ((best.text, best.verdict) if best else (None, "block" if fits else "allow"))


# 7


def test_mixing(spark, docs, nothing):
    rows = mixing.mixing_digest(docs).collect()
    assert len(rows) == len(DOCS) and {r.size for r in rows if r.doc_id in (3, 4, 5)} == {0}
    assert all(r.taken <= 3 * r.size and r.target <= 3 * r.source_size for r in rows)
    assert abs(sum({(r.source_size, r.target): r.target for r in rows}.values()) - sum(len(split(d[1])) for d in DOCS)) < 1e-6
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mixed_documents(docs).collect()))
    assert mixing.mixing_digest(nothing).count() == 0
    many = spark.createDataFrame([(i, f"s{i % 3}", "w " * (1 + i % 9)) for i in range(8000)], "doc_id long, source string, text string")
    taken = {r.target: r.t for r in mixing.mixing_digest(many).groupBy("target").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "t").collect()}
    assert all(abs(t - k) < 0.03 * k for k, t in taken.items())


def test_rows_without_ids_meet_their_target(spark):
    many = spark.createDataFrame([(None, f"s{i % 3}", f"w{i} " * (1 + i % 9)) for i in range(8000)] + [(None, None, None)], "doc_id long, source string, text string")
    target = {r.source: r.t for r in mixing.mix(many).groupBy("row.source").agg({"target": "max"}).withColumnRenamed("max(target)", "t").collect()}
    taken = collections.Counter()
    for r in mixing.mixed_documents(many).collect():
        taken[r.source] += len(split(r.text))
    assert all(abs(taken[s] - t) <= 0.03 * t for s, t in target.items())


# 8


def test_columns_named_as_those_used_inside_come_back(spark, monkeypatch):
    names = ["mix_size", "mix_copies", "mix_target", "_mix_source", "_copy", "copy", "copies", "row", "size", "target", "source_size", "has_words", "expected_grade", "tail_probability", "c0", "h", "id", "absent", "node", "json", "component_id", "_node"]
    rows = [(i, f"word{i} and some more plain words of text {i}", "ab"[i % 2], *(f"{n}{i}" for n in names)) for i in (1, 2, 3, 3)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    monkeypatch.setattr(mixing, "RANGE", 1)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for got in (mixing.mixed_documents(docs), quality.keep_good(spark, docs, labels), ngram_join.one_of_each(spark, docs), decontaminate.without_benchmark(spark, docs, spark.createDataFrame([(1, "none of it")], "item_id long, text string"))):
        assert got.columns == docs.columns and {tuple(r) for r in got.collect()} <= set(rows)
    assert ngram_join.one_of_each(spark, docs).count() == 3 and quality.keep_good(spark, docs, labels).count() == 4


def test_targets_by_ranges_equal_a_direct_fill(spark, monkeypatch):
    rng = random.Random(4)
    sizes = {f"s{i:02}": rng.choice([0, 1, 5, 40, 1000, 90_000]) for i in range(40)} | {None: 77}
    frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
    weight = {n: i % 3 + 1.0 for i, n in enumerate([*sorted(n for n in sizes if n), None])}
    target, free = {}, set(sizes)
    while True:  # fills by weight, caps what is above, and again
        rest = sum(sizes.values()) - sum(target.values())
        share = {n: rest * weight[n] / sum(weight[m] for m in free) for n in free}
        over = {n for n in free if share[n] > 3 * sizes[n]}
        if not over:
            break
        target |= {n: 3.0 * sizes[n] for n in over}
        free -= over
    target |= share
    for width in (3, 1 << 20):
        monkeypatch.setattr(mixing, "RANGE", width)
        got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
        assert got == pytest.approx(target)


def near(a, b):
    return line_dedup.within_one_edit(a, b)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    pool = [[f"w{rng.randrange(30)}" for _ in range(rng.choice([1, 3, 4, 5, 6, 7, 12, 40]))] for _ in range(40)]
    texts = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                op, i = rng.randrange(3), rng.randrange(max(len(line), 1))
                line[i : i + (op != 1)] = [f"w{rng.randrange(30)}"] if op < 2 else []
            lines.append(" ".join(line))
        texts.append((d, "\n".join(lines)))
    seen, want = [], {}
    for d, text in texts:
        kept = 0
        for line in text.split("\n"):
            w = split(line)
            kept += not w or not any(w == o or (min(len(w), len(o)) >= line_dedup.NEAR_WORDS and near(w, o)) for o in seen)
            seen.append(w)
        want[d] = (text.count("\n") + 1, kept)
    got = line_dedup.line_digest(spark, spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_lines, r.n_kept) for r in got} == want


def test_line_dedup_on_odd_tables(spark, docs, nothing):
    got = {r.doc_id: (r.n_lines, r.n_kept) for r in line_dedup.line_digest(spark, docs).collect() if r.doc_id != 2}
    assert got[1] == (2, 2) and got[4] == (1, 1) and got[7] == (1, 0) and got[10] == (3, 1) and 3 not in got and got[8] == (1, 1)
    assert line_dedup.line_digest(spark, nothing).count() == 0
    with Scratch(spark, "t") as s:
        assert {r.doc_id: r.text for r in line_dedup.without_repeated_lines(spark, docs, s).collect()}[10] == "the line of a kind"


# 9


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(230)] + [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0]), (302, [float("nan")] * 5), (303, [float("inf")] * 5), (400, [1.0, 2.0]), (401, [3.0, 4.0]), (None, [1.0] * 5), (7, [1.0] * 5), (7, [1.0] * 5), (500, [1e15, -1e15, 1.0, 0.0, 0.0]), (600, [1e300] * 5)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = collections.defaultdict(list)
    for r in sorted(topk_search.top_k_digest(spark, frame).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.score, r.vec_id))
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and np.isfinite(np.floor(np.array(v) * 1024)).all()]
    limit = lambda s: max(min(s, (1 << 63) - 1), -(1 << 63))
    for q, v in good:
        if q % 100 == 0:
            want = sorted((-limit(sum(a * b for a, b in zip(v, c, strict=True))), i) for i, c in good if i != q and len(c) == len(v))[:10]
            assert got.pop(q) == [(-s, i) for s, i in want]
    assert not got
    assert topk_search.top_k_digest(spark, frame.limit(0)).count() == 0


# 10


def test_chat_links_orders_and_validates(spark):
    call = lambda i, name, **a: f"<tool_call>{json.dumps({'id': i, 'name': name, 'arguments': a})}</tool_call>"
    turns = [
        (1, 0, "user", "hello"),
        (1, 1, "tool", '{"tool_call_id": "c1", "content": {"b": 1.0, "a": "ü"}}'),
        (1, 2, "assistant", "look " + call("c1", "search", query="x", limit=2) + call("c2", "calculate", expression={"$ref": "c1"})),
        (1, 3, "assistant", call("c3", "search", limit=0) + call("c1", "search", query="again") + call("c4", "fetch", url={"$ref": "c2"})),
        (1, 4, "tool", '<tool_result id="c2">4</tool_result><tool_result id="zz">?</tool_result>'),
        (1, 5, "assistant", "<tool_call>{broken</tool_call>"),
        (2, 0, None, None),
        (None, None, "user", "x"),
        (1, 0, "user", "hello"),
    ]
    frame = spark.createDataFrame([(*t, "q", "z") for t in turns], "conv_id long, turn long, role string, text string, kind string, status string")
    rows = chat.chat_digest(frame).collect()
    status = {(r.turn, r.part, r.kind): r.status for r in rows if r.conv_id == 1}
    assert status[2, 1, "call"] == "ok" == status[2, 2, "call"] and status[3, 0, "call"] == "invalid: $.query: missing" and status[3, 1, "call"] == "duplicate"
    assert status[4, 1, "result"] == "no call" and status[5, 0, "text"] == "not a tool call" and status[1, 0, "result"] == "ok"
    order = sorted((r.depth, r.sub, r.turn, r.part) for r in rows if r.conv_id == 1)  # noqa: E501
    assert order.index((2, 1, 1, 0)) > order.index((2, 0, 2, 2))
    assert next(r.json for r in rows if r.turn == 1 and r.kind == "result") == '{"content":{"a":"ü","b":1},"role":"tool","tool_call_id":"c1"}'
    assert sum(r.kind == "text" and r.json == '{"content":"hello","role":"user"}' for r in rows) == 1
    assert [r.json for r in rows if r.conv_id == 2] == ['{"content":"","role":"unknown"}']
    assert chat.chat_digest(frame.limit(0)).count() == 0


def test_chat_follows_references(spark):
    call = lambda i, *refs: f"<tool_call>{json.dumps({'id': i, 'name': 'fetch', 'arguments': {'url': 'u', 'headers': {str(k): {'$ref': r} for k, r in enumerate(refs)}}})}</tool_call>"
    result = lambda i: f'<tool_result id="{i}">{i}</tool_result>'
    needs = {"a": ["b"], "b": ["c", "d"], "c": [], "d": ["e"], "e": ["none"], "p": ["q", "a"], "q": ["p"], "r": ["q", "s"], "s": ["t"], "t": ["s"], "u": ["u"], "v": ["w"], "w": [], "x": ["t", "z"], "z": []}
    text = "".join(call(i, *refs) for i, refs in needs.items())
    results = "".join(result(i) for i in needs if i != "w")
    turns = [
        (k, turn, "assistant", t)
        for k in (1, None)
        for turn, t in [(1, result("d") + text), (2, results), (3, call("a", "late")), (4, call("late")), (6, result("late"))]
    ]
    turns += [(2, 20 - i, "assistant", call(f"k{i}", *([f"k{i - 1}"] if i else []))) for i in range(12)] + [(2, 30, "tool", "".join(result(f"k{i}") for i in range(12)))]
    turns += [(3, 1, "assistant", call("m") + call("n", "m")), (3, 2, "tool", result("m") + result("n"))]
    rows = chat.chat_digest(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    for conv in (1, 2, 3, None):
        order, status, first = sorted((r for r in rows if r.conv_id == conv), key=lambda r: (r.level, r.step, r.turn, r.part)), {}, {}
        assert len({(r.level, r.step, r.turn, r.part) for r in order}) == len(order)
        for at, r in enumerate(order):
            m = json.loads(r.json)
            key = (r.kind, m["tool_call"]["id"] if r.kind == "call" else m["tool_call_id"])
            if r.status != "duplicate":
                first[key], status[key] = at, r.status
            if r.status == "duplicate" and key == ("call", "a"):
                again = at
        assert all(first["call", i] < at for (kind, i), at in first.items() if kind == "result")
        if conv in (1, None):
            assert {i for i in needs if status["call", i] == "unresolved"} == {"e", "p", "q", "s", "t", "u", "v"}
            rings = [{"p", "q"}, {"s", "t"}, {"u"}]
            assert all(first["call", i] > first["result", j] for i, refs in needs.items() for j in refs if ("result", j) in first and not any({i, j} <= x for x in rings))
            assert again > first["result", "late"]
        elif conv == 2:
            assert all(first["call", f"k{i}"] > first["result", f"k{i - 1}"] for i in range(1, 12)) and set(status.values()) == {"ok"}
        else:
            assert first["call", "n"] > first["result", "m"] and set(status.values()) == {"ok"}


def test_schema_errors():
    s = {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "number", "maximum": 3}}, "b": {"enum": [1, "x"]}}, "additionalProperties": False}
    assert chat.schema_error({"a": [1, 2.5], "b": "x"}, s) is None and chat.schema_error({"a": {"$ref": "k"}}, s) is None
    assert chat.schema_error({"a": [4]}, s) == "$.a[0]: above 3" and chat.schema_error({"c": 1}, s) == "$.c: not known"
    assert chat.schema_error([], s) == "$: not of type object" and chat.schema_error({"b": True}, {"properties": {"b": {"type": "integer"}}}) == "$.b: not of type integer"
    with pytest.raises(ValueError):
        chat.canonical(float("nan"))


def test_feature_shapes():
    assert features.shape("THE!!") == "A!" and features.shape("it's") == "a'a" and features.shape("12.50") == "0.0"
    assert features.text_features(pa.array([None, "", "a"]))[0].size == 0
    assert features.shape("a" * 30 + "1%" * 2) == "a0%0%" and features.shape("http://example.org/some/page?q=12#END") == "a:/a.a/a/a?a=0#A"


# the pipeline


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(0, "a text without an id but with enough words to count")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns, name
        if name.startswith("benchmark"):
            assert 1 in {r.doc_id for r in now.collect()} and None not in {r.doc_id for r in now.collect()}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted(str((r.doc_id, r.n_tokens)) for r in rows) == sorted(str((r.doc_id, r.n_tokens)) for r in token_ids.token_id_output(spark, now).collect())

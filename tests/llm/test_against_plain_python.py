"""Scores of fixed models, and the order of random call graphs, against plain Python."""

import json
import math
import random

import numpy as np
import pyarrow as pa
import xxhash

from triweave.llm import chat, features, quality, toxicity

TEXTS = ["", "the the the", "THE the! 12.5 (12,5) x%%%", "Straße é \U0001f600 aa aab", "one two three four five six seven", "word " * 900 + "end", " \n ", "a-b a_b «a» ... 7"]


def plain_features(text):
    """The buckets of a text by the module's definition, word by word."""
    bucket = lambda name, seed: xxhash.xxh3_64_intdigest(name.encode(), seed) % (1 << features.BITS)
    words = text.encode().split()
    words = [w.decode() for w in words]
    n, out, shapes = len(words), set(), {}
    if not n:
        return out
    for w in words:
        out.add(bucket((w.strip(features._TRIM) or w).lower(), 1))
        shape = ""
        for c in w:
            kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
            shape += kind if not shape.endswith(kind) else ""
        shapes[shape] = shapes.get(shape, 0) + 1
    distinct = len(out)
    for shape, times in shapes.items():
        out.add(bucket(f"{shape}\0{math.ceil(features.SHARE_BINS * times / n)}", 2))
    return out | {bucket(f"distinct\0{math.ceil(features.SHARE_BINS * distinct / n)}", 3), bucket(f"words\0{n.bit_length()}", 4)}


def test_features_and_scores_of_fixed_weights():
    rows = features.text_features(pa.array(TEXTS))
    assert [set(r.tolist()) for r in rows] == [plain_features(t) for t in TEXTS]
    rng = np.random.default_rng(2)
    w, thresholds = rng.standard_normal(1 << features.BITS), np.array([-0.5, 1.25])
    tails = quality.OrdinalModel(w, thresholds).tails(rows)
    weights = [rng.standard_normal(1 << features.BITS) for _ in range(3)]
    links, intercepts = [np.zeros(0), np.array([0.7]), np.array([-0.3, 0.9])], [0.1, -0.2, 0.3]
    chained = toxicity.ChainModel(weights, links, intercepts).probabilities(rows)
    for i, text in enumerate(TEXTS):
        x = plain_features(text)
        eta = sum(w[b] for b in x)
        assert all(math.isclose(tails[i, j], 1 / (1 + math.exp(thresholds[j] - eta)), rel_tol=1e-9) for j in range(2))
        odds = []
        for own, link, c in zip(weights, links, intercepts, strict=True):
            odds.append(min(max(sum(own[b] for b in x) + sum(a * b for a, b in zip(link, odds, strict=True)) + c, -8), 8))
        assert all(math.isclose(chained[i, j], 1 / (1 + math.exp(-o)), rel_tol=1e-9) for j, o in enumerate(odds))


def test_chain_and_ordinal_fits_are_minima_that_use_earlier_links():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 12)) for _ in range(400)]
    first = np.array([1 in r for r in rows])
    second = first & np.array([2 in r or 3 in r for r in rows])
    model = toxicity.fit_chain(rows, np.column_stack([first, second]).astype(int))
    assert model.links[1][0] > 0  # the second category leans on the first
    p = model.probabilities(rows)
    assert (p[first, 0] > p[~first, 0].max()).mean() > 0.95 and (p[second, 1] > np.median(p[~second, 1])).mean() > 0.95
    y = second.astype(float)
    odds = rng.standard_normal((400, 1))
    w, v, c = toxicity.fit_logistic(rows, odds, y, steps=400)

    def loss(w, v, c):
        eta = features.sums(w, rows) + odds @ v + c
        return (np.logaddexp(0, eta) - y * eta).mean() + toxicity.L1 * np.abs(w).sum()

    best = loss(w, v, c)
    for _ in range(30):  # no small step along used coordinates makes it better
        move = np.zeros(len(w))
        move[rng.choice(np.flatnonzero(w), 3)] = rng.standard_normal(3) * 0.05
        assert loss(w + move, v, c) >= best - 1e-5 and loss(w, v + rng.standard_normal(1) * 0.05, c) >= best - 1e-5


def test_labelled_rows_of_one_id_do_not_depend_on_order(spark):
    docs = [(i, f"w{i} text {i % 3}") for i in range(20)] + [(3, "another text"), (3, "a third")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    got = []
    for seed in (1, 2, 3):
        random.Random(seed).shuffle(docs)
        frame = spark.createDataFrame(spark.sparkContext.parallelize(docs, 3), "doc_id long, text string")
        rows, y = features.labelled_sample(frame, labels, ["toxic"], 100)
        got.append([r.tolist() for r in rows])
    assert got[0] == got[1] == got[2] and len(got[0]) == 20


def test_random_call_graphs_stand_in_an_order_that_serves_them(spark):
    rng, turns, plans = random.Random(12), [], {}
    for conv in range(25):
        n = rng.randrange(2, 11)
        places = rng.sample(range(60), 2 * n)
        calls = {}
        for i in range(n):
            refs = {f"c{rng.randrange(n + 1)}" for _ in range(rng.choice([0, 0, 1, 1, 2]))}  # c{n} is no call
            calls[f"c{i}"] = (places[i], refs, places[n + i] if rng.random() < 0.85 else None)
        for name, (turn, refs, result) in calls.items():
            arguments = {"query": "q"} | ({"limit": [{"$ref": r} for r in sorted(refs)]} if refs else {})
            turns.append((conv, turn, "assistant", f'<tool_call>{json.dumps({"id": name, "name": "free", "arguments": arguments})}</tool_call>'))
            if result is not None:
                turns.append((conv, result, "tool", f'<tool_result id="{name}">"r"</tool_result>'))
        plans[conv] = calls
    rng.shuffle(turns)
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    from triweave.plans.scratch import Scratch

    with Scratch(spark, "chat-test") as s:
        rows = chat.chat_messages(frame, s, {"free": {"type": "object"}}).collect()
    for conv, calls in plans.items():
        own = [r for r in rows if r.conv_id == conv]
        place, status = {}, {}
        for at, r in enumerate(sorted(own, key=lambda r: (r.level, r.step, r.turn, r.part))):
            message = json.loads(r.json)
            name = message["tool_call"]["id"] if r.kind == "call" else message["tool_call_id"]
            place[r.kind, name], status[r.kind, name] = at, r.status
        met = {c: {x for x in refs if x in calls and calls[x][2] is not None} for c, (_, refs, _) in calls.items()}

        def reached(c, met=met):
            seen, todo = set(), list(met[c])
            while todo:
                if (x := todo.pop()) not in seen:
                    seen.add(x)
                    todo += met[x]
            return seen

        ring = {c for c in calls if c in reached(c)}
        for c, (turn, refs, result) in calls.items():
            assert status["call", c] == ("unresolved" if c in ring or refs != met[c] else "ok")
            if result is not None:
                assert place["call", c] < place["result", c]
            for x in met[c]:
                if not (c in reached(x)):  # outside the cycle
                    assert place["result", x] < place["call", c]
            if not refs:
                assert [(r.level, r.step) for r in own if r.kind == "call" and json.loads(r.json)["tool_call"]["id"] == c] == [(turn, 0)]

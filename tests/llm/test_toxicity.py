import itertools
import math
import os
import random

import numpy as np

from bytelake.llm import toxicity as T


def test_marginals_equal_all_taggings():
    rng = np.random.default_rng(1)
    lengths = np.array([0, 3, 1, 5, 3])
    e = [rng.normal(size=n) * 2 for n in lengths]
    start, moves = 0.3, rng.normal(size=(2, 2))
    packed = T.Packed(lengths)
    flat = np.empty(packed.starts[-1])
    for rank, d in enumerate(packed.order):
        flat[packed.places(rank)] = e[d]
    p = T.marginals(flat, packed, start, moves)[2]
    for rank, d in enumerate(packed.order):
        total, of = 0.0, np.zeros(lengths[d])
        for tags in itertools.product((0, 1), repeat=int(lengths[d])):
            s = sum(x * y for x, y in zip(e[d], tags, strict=True)) + (start * tags[0] if tags else 0) + sum(moves[a, b] for a, b in itertools.pairwise(tags))
            total += np.exp(s)
            of += np.array(tags) * np.exp(s)
        assert np.allclose(p[packed.places(rank)], of / total)


def made(n, seed):
    rng = random.Random(seed)
    words, bad = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta"], ["rotten", "vile", "nasty"]
    rows = []
    for i in range(n):
        text, y = rng.choices(words, k=rng.randrange(5, 60)), int(rng.random() < 0.4)
        for _ in range(y * rng.randrange(1, 4)):
            text[rng.randrange(len(text))] = rng.choice(bad).title() + "!"
        rows.append((i, " ".join(text), y))
    return rows


def test_learns_and_finds_offsets(spark):
    rows = made(600, 3)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, None, "x"), (9000, "", "x"), (9001, "zeta " * 30_000 + "VILE", "x"), (1, rows[1][1], "x")], "doc_id long, text string, spans string")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows] + [(None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    model = T.train(T.training_rows(docs), labels)
    got = T.score(docs, model).collect()
    assert len(got) == len(rows) + 4
    by = {r.doc_id: r for r in got}
    assert sum(by[i].predicted == y for i, _, y in rows) >= 595
    assert by[9000].score == by[None].score < 0.3 and by[9000].predicted == 0
    assert [(s.start, s.end) for s in by[9001].spans] == [(150_000, 150_004)] and by[9001].predicted == 1
    for i, t, _ in rows:
        assert all(t[s.start : s.end].lower().strip("!").split("! ")[0] in ("rotten", "vile", "nasty") for s in by[i].spans)
    kept = T.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {None} | {i for i, r in by.items() if not r.predicted}
    assert T.score(docs.limit(0), model).count() == 0


def test_one_label_or_none(spark):
    docs = spark.createDataFrame([(0, "a b"), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (2, 0)], "doc_id long, toxic int")
    assert [round(r.score, 3) for r in T.score(docs, T.train(docs, labels)).collect()] == [0.25, 0.25]
    assert [r.score for r in T.score(docs, T.train(docs.limit(0), labels.limit(0))).collect()] == [0.5, 0.5]


def test_lowered_keeps_length():
    assert len(T.lowered("İAÀß")) == 4 and T.lowered("ABÀ") == "abà"


def slow_probability(model, text):
    """A document's score token by token, in logarithms, from the weights alone."""
    words = [w for w in T.re.split(r"\W+", T.lowered(text)) if w]
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    e = [min(30.0, max(-30.0, sum(float(model.weights[f]) for f in T.features(w)))) for w in words]
    forward = [[0.0, model.start + e[0]]] if e else []
    for x in e[1:]:
        f = forward[-1]
        forward.append([add(f[0] + model.moves[0, t], f[1] + model.moves[1, t]) + t * x for t in (0, 1)])
    backward = [[0.0, 0.0]] if e else []
    for x in e[:0:-1]:
        b = backward[0]
        backward.insert(0, [add(model.moves[t, 0] + b[0], model.moves[t, 1] + x + b[1]) for t in (0, 1)])
    p = []
    for f, b in zip(forward, backward, strict=True):
        p.append(1 / (1 + math.exp(min(700, f[0] + b[0] - f[1] - b[1]))))
    top = min(1 - 1e-6, max([1e-6, *p]))
    z = model.calibration @ [1.0, math.log(top / (1 - top)), math.log1p(sum(x for x in p if x > 0.5))]
    return 1 / (1 + math.exp(-z))


def test_scores_equal_a_slow_route(spark):
    rows = made(300, 8) + [(500, "", 0), (501, "vile vile VILE " * 40, 1), (502, "one", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = T.train(docs, docs.select("doc_id", "toxic"))
    got = {r.doc_id: r.score for r in T.score(docs, model).collect()}
    assert all(math.isclose(got[i], slow_probability(model, t), rel_tol=1e-6, abs_tol=1e-9) for i, t, _ in rows)


def test_labels_of_absent_documents_play_no_part(spark):
    rows = made(200, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    absent = spark.range(1000, 60_000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS toxic")
    labels = docs.select("doc_id", "toxic")
    one, two = T.train(docs, labels), T.train(docs, labels.union(absent))
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.calibration, two.calibration) and one.weights.any()


def test_the_driver_gets_no_texts(spark, monkeypatch):
    """The field is fitted in a task, not in the process of the driver, whose memory must not hold the texts; weights are those of a fit by hand."""
    driver, fit = os.getpid(), T.fit

    def elsewhere(texts, y):
        assert os.getpid() != driver
        return fit(texts, y)

    rows = [(i, ("vile " if i % 3 == 0 else "") + f"some words {i % 7}", int(i % 3 == 0)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    monkeypatch.setattr(T, "fit", elsewhere)
    got = T.train(docs, docs.select("doc_id", "toxic"))
    distinct = sorted({r[1:] for r in rows})
    want = fit([t for t, _ in distinct], np.array([y for _, y in distinct]))
    assert (got.weights == want.weights).all() and (got.moves == want.moves).all() and got.start == want.start and (got.calibration == want.calibration).all()
    assert want.weights.any()

import random
from collections import defaultdict

import numpy as np
import pytest

from bytelake.llm import common, near_dedup
from bytelake.llm.near_dedup import BUCKETS, Sampler, Weights, bucket_of, components, keep_one, near_duplicates, shingles, weighted_jaccard


def made(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=4))
    rows, n = [], 0
    for group in range(40):
        base = [word() for _ in range(rng.choice([3, 30, 120, 400]))]
        for _ in range(rng.choice([1, 1, 2, 6, 25])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                if len(text) > 20:
                    text[rng.randrange(len(text))] = word()
            rows.append((n, " ".join(text)))
            n += 1
    return rows


def brute(rows):
    """Classes by all pairs of distinct texts."""
    texts = {}
    for i, t in rows:
        texts[t or ""] = min(i, texts.get(t or "", i))
    frequencies = np.zeros(BUCKETS, np.int64)
    for t in texts:
        frequencies[np.unique(bucket_of(shingles(t)[0]))] += 1
    w = Weights(frequencies, len(texts))
    vectors, label, close = {i: w.of(t) for t, i in texts.items()}, {i: i for i in texts.values()}, []
    for i in vectors:
        for j in vectors:
            if i < j:
                s = weighted_jaccard(vectors[i], vectors[j])
                close.append(abs(s - 0.8))
                if s >= 0.8 and label[i] != label[j]:
                    lo, hi = sorted((label[i], label[j]))
                    label = {k: lo if v == hi else v for k, v in label.items()}
    return {(i, label[texts[t or ""]], texts[t or ""]) for i, t in rows}


@pytest.mark.parametrize(("rounds", "small", "block"), [(0, 32, 1024), (2, 32, 1024), (0, 2, 7)])
def test_equals_all_pairs(spark, rounds, small, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0 if rounds else 1_000_000)
    rows = made() + [(9000, ""), (9001, None), (9002, "  \n")]
    rows += [(9003, rows[3][1]), rows[5], rows[5]]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, label int, __gone int")
    got = near_duplicates(docs, rounds=rounds).collect()
    assert {(r.doc_id, r.class_id, r.rep_id) for r in got} == brute(rows) and len(got) == len(rows)
    if rounds:
        one = keep_one(docs)
        by = defaultdict(list)
        for r in got:
            by[r.class_id].append(r.doc_id)
        assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {min(v) for v in by.values()}


@pytest.mark.parametrize("others", [100])
def test_copies_of_a_large_group_meet_their_base(spark, others):
    """100 edited copies of one base, a half of all texts; copies are similar to the base but not to each other."""
    rng = random.Random(others)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    base = [word() for _ in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, 101):
        text = list(base)
        for k in rng.sample(range(5, 395), 5):
            text[k] = word()
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(word() for _ in range(60))) for i in range(others)]
    classes = {i: c for i, c, _ in brute(rows)}
    near = [i for i in range(1, 101) if classes[i] == 0]
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rounds=0).collect()}
    assert len(near) > 90 and sum(got[i] == 0 for i in near) >= 0.98 * len(near)
    assert all(got[i] == i for i, c in classes.items() if i == c)


def test_samples_agree_as_often_as_texts_are_alike():
    sampler, w = Sampler(), Weights(np.zeros(BUCKETS, np.int64), 10)
    rng = random.Random(1)
    same, want = [], []
    for _ in range(150):
        a = [str(rng.random()) for _ in range(100)]
        b = list(a)
        b[rng.randrange(100)] = "other"
        x, y = w.of(" ".join(a)), w.of(" ".join(b))
        same.append((sampler.bands(*x) == sampler.bands(*y)).mean())
        want.append(weighted_jaccard(x, y) ** 4)
    assert abs(np.mean(same) - np.mean(want)) < 0.04


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "one two three four five six"), (None, "x"), (7, "one two three four five six")], "doc_id long, text string")
    assert sorted((tuple(r) for r in near_duplicates(docs).collect()), key=str) == [(7, 7, 7, 2, 0), (None, None, None, 1, 0), (None, None, None, 2, 0)]
    assert near_duplicates(docs.limit(0)).count() == 0 and keep_one(docs).count() == 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(40) if i % 10 != 9] + [(100, k) for k in range(101, 130)] + [(5, 5)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: i // 10 * 10 for i in range(41) if i != 40} | {k: 100 for k in range(100, 130)}


def test_rows_that_repeat_id_and_text_count_once(spark):
    text = [f"w{k}" for k in range(300)]
    other = [*text[:150], "else", *text[151:]]
    rows = [(4, " ".join(text)), (4, " ".join(text)), (4, " ".join(text)), (9, " ".join(other)), (9, " ".join(other)), (4, "the same id with quite another text in it")]
    got = {(r.doc_id, r.class_id, r.rep_id, r.n_copies, r.n_links) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(4, 4, 4, 3, 1), (9, 4, 9, 2, 1), (4, 4, 4, 1, 0)}


@pytest.mark.parametrize("copies", [600, 2400])
def test_strangers_in_a_large_band_cost_its_size(spark, copies, monkeypatch):
    """Near copies of one text and a few others that share its band: what is compared grows with the band, not with its square."""
    rng = random.Random(copies)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    base, stranger = [word() for _ in range(60)], [word() for _ in range(60)]
    rows = [(i, f"{' '.join(base)} {word()}") for i in range(copies)] + [(10_000 + i, f"{' '.join(stranger)} {word()}") for i in range(3)]
    texts = spark.createDataFrame(rows, "id long, text string")
    active = spark.createDataFrame([(7, i, 0 if i < 10_000 else 10_000) for i, _ in rows] + [(8, i, i) for i in (0, 10_000)], "band long, id long, label long")
    weights = spark.sparkContext.broadcast(Weights(np.ones(BUCKETS, np.int64), len(rows)))
    meet = spark.sparkContext.accumulator(0)
    inner = near_dedup._compare

    def counted(mine, others, *rest):
        meet.add(len(mine) * len(others))
        return inner(mine, others, *rest)

    monkeypatch.setattr(near_dedup, "_compare", counted)
    got = {tuple(r) for r in near_dedup._all_pairs(active, texts, weights, 0.8).collect()}
    assert got == {(0, 10_000)} and meet.value == 3 * (copies + 3)  # the small band's pair is left to verification

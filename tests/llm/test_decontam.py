import random
import re

from bytelake.llm.decontam import MASKS, decontaminate, leaks


def brute(docs, items, min_share=0.6, enough=20):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = {}
    for i, t in docs:
        d = words(t)
        for q, u in items:
            w = words(u)
            for start in range(-len(w), len(d)):
                seed = any(
                    all(0 <= start + p + k < len(d) and d[start + p + k] == w[p + k] for k, c in enumerate(m) if c == "1") and 0 <= start + p and start + p + len(m) <= len(d)
                    for m in MASKS
                    for p in range(len(w) - len(m) + 1)
                )
                m = sum(0 <= start + k < len(d) and d[start + k] == w[k] for k in range(len(w)))
                if seed and (m >= -(-min_share * len(w) // 1) or m >= enough) and m > out.get((i, q), (0,))[0]:
                    out[i, q] = (m, len(w), start)
    return sorted((*k, *v) for k, v in out.items())


def test_equals_brute_force(spark):
    rng = random.Random(7)
    word = lambda: rng.choice("abcdefghij") + rng.choice("xyzé")
    items = [(q, " ".join(word() for _ in range(rng.choice([5, 7, 15, 30, 45])))) for q in range(20)] + [(50, None), (51, "")]
    docs = [(0, ""), (1, None)]
    for i in range(2, 60):
        text = [word() for _ in range(rng.randrange(60))]
        leak = items[rng.randrange(20)][1].upper().split()
        leak = leak[rng.randrange(3) :]
        leak = [w if rng.random() > 0.12 else "zz" for w in leak]
        docs.append((i, " ".join(text[:20]) + ".\n" + ", ".join(leak) + "! " + " ".join(text[20:])))
    docs += [docs[5], (5, docs[6][1])]
    d = spark.createDataFrame([(i, t, "n") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in leaks(d, b).select("doc_id", "item_id", "n_matched", "item_tokens", "start").collect())
    assert got == brute(docs, items) and len(got) > 30
    clean = decontaminate(d, b)
    assert clean.columns == d.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {x[0] for x in got}


def test_every_third_token_substituted(spark):
    item = " ".join(f"word{k}" for k in range(18))
    text = "before it " + " ".join(f"word{k}" if k % 3 else "other" for k in range(18))
    d = spark.createDataFrame([(None, text), (2, "nothing of it")], "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [tuple(r) for r in leaks(d, b).collect()] == [(None, 1, 12, 18, 2)]
    assert leaks(d.limit(0), b).count() == 0 and leaks(d, b.limit(0)).count() == 0
    assert decontaminate(d, b).count() == 2

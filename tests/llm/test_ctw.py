import math
import random
import zlib
from collections import Counter

import numpy as np

from bytelake.llm import ctw as C


class Slow:
    """Context-tree weighting by recursion over the training tokens. A next bit's probability is the ratio of the root's weighted probabilities with and without it."""

    def __init__(self, counts):
        self.data = [x for word, n in counts.items() for x in self.steps(word) * n]

    def steps(self, word):
        """(context, byte) for each byte of a token: the context is what stands before it in the token, behind the token's start."""
        x = C.START + (word if word == C.END else word + C.STOP)
        return [(x[:k], x[k]) for k in range(1, len(x))]

    def weighted(self, context, bits):
        """P_w of the tree at a context, of the (context, bit) pairs there."""
        p, n0, n1 = 1.0, 0, 0
        for _, bit in bits:
            p *= ((n1 if bit else n0) + 0.5) / (n0 + n1 + 1)
            n0, n1 = n0 + (not bit), n1 + bit
        if len(context) == C.DEPTH or context.startswith(C.START):
            return p
        longer = {}
        for c, bit in bits:
            longer.setdefault(c[-len(context) - 1 :], []).append((c, bit))
        return 0.5 * p + 0.5 * math.prod(self.weighted(c, b) for c, b in longer.items())

    def log10(self, word):
        out = 0.0
        for context, byte in self.steps(word):
            for depth in range(8):
                node, bit = (256 | byte) >> (8 - depth), byte >> (7 - depth) & 1
                here = [(c, b >> (7 - depth) & 1) for c, b in self.data if (256 | b) >> (8 - depth) == node]
                out += math.log10(self.weighted(b"", [*here, (context, bit)]) / self.weighted(b"", here))
        return out


COUNTS = {b"abab": 3, b"ba": 2, b"b": 4, b"abcabcab": 1, b"\xc3\xa9\x00a": 1, C.END: 3}


def fast(counts, words):
    """The tree of the counts, in one process, for these words."""
    words = sorted(set(words) | set(counts))
    keys, n = C._summed(*C.grams(words, np.array([counts.get(w, 0) for w in words], np.int64)))
    group = keys >> 8 & 0xFFFF
    two = [C._subtree(keys[group == g], n[group == g])[0] for g in np.unique(group)]
    order = np.argsort(np.concatenate([t.keys for t in two]))
    top = C.Top(*(np.concatenate([getattr(t, c) for t in two])[order] for c in ("keys", "n0", "n1", "log_w")))
    logs = np.zeros(len(keys))
    for g in np.unique(group):
        logs[group == g] = C.gram_logs(keys[group == g], n[group == g], top)
    of = dict(zip(keys.tolist(), logs.tolist(), strict=True))
    return {w: sum(of[k] for k in C.grams([w], np.zeros(1, np.int64))[0].tolist()) for w in words}


def test_next_bits_are_ratios_of_the_weighted_tree():
    words = [*COUNTS, b"", b"c", b"bab", b"abcabcac", b"xyzxyzxyz"]
    got, slow = fast(COUNTS, words), Slow(COUNTS)
    for w in words:
        assert math.isclose(got[w], slow.log10(w), rel_tol=1e-9), w


def test_probabilities_add_up():
    """The tokens that begin with each byte share all of the probability; so do those that go on after a prefix."""
    singles = [bytes([b]) for b in range(256) if bytes([b]) not in (C.START, C.END)]
    got = fast(COUNTS, [p + s for p in (b"", b"abab", b"q") for s in singles])
    # of one byte and its STOP: all but longer words
    first = fast(COUNTS, [C.END, *singles])
    assert 0 < sum(10**v for v in first.values()) < 1 + 1e-9 and sum(10 ** got[b"abab" + s] for s in singles) < 1


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, b"w") for i, t in rows], "doc_id long, text string, words binary").repartition(3)


def test_table_equals_brute_force(spark):
    rng = random.Random(4)
    words = ["alpha", "Beta", "BETA", "é", "É", "x\x1cy", "gamma.", "nul\x00l", "alphabetical", "betas"]
    rows = [(i, rng.choice([" ", "\t\n", "\x0b"]).join(rng.choices(words, k=rng.randrange(30)))) for i in range(120)] + [(500, None), (501, ""), (None, "alpha"), (3, "again"), (3, "again"), (502, "long " * 60_000)]
    rows += [(k, f"only here {k} " * 2) for k in range(2000, 2040)]
    got = C.score(docs_of(spark, rows), block_bytes=2000, chunk_words=7).collect()
    crc = lambda i: zlib.crc32(b"" if i is None else str(i).encode())
    toks = [(i, [*C.tokens(t), C.END]) for i, t in rows]
    counts = Counter(w for i, ws in toks if crc(i) % 10 for w in ws)
    n, v = sum(counts.values()), len(counts)
    logs = fast(counts, {w for _, ws in toks for w in ws})
    want = []
    for i, ws in toks:
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        want.append((i, crc(i) % 10 == 0, len(ws), sum(counts[w] > 0 for w in ws), n, base, sum(logs[w] for w in ws), len(b" ".join(ws[:-1])) + 1))
    key = lambda r: (str(r[0]), r[2])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[7] == b[7] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9), (a, b)
    assert sum(r.held_out for r in got) > 5 and any(r.held_out and r.n_known < r.n_tokens for r in got)


def test_empty_tables_and_nothing_to_learn_from(spark):
    docs = docs_of(spark, [(None, "alpha"), (8, "é b")])
    assert C.score(docs.limit(0)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = C.score(docs_of(spark, [(held, "ab")])).collect()
    assert row.held_out and row.train_tokens == 0 and row.n_known == 0 and math.isclose(row.score, 4 * 8 * math.log10(0.5), rel_tol=1e-9)


def test_words_of_training_cost_fewer_bits(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    learned, held = ([i for i in range(500) if bool(zlib.crc32(str(i).encode()) % 10) == x] for x in (True, False))
    vocabulary = [word() for _ in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=30))) for i in learned]
    rows += [(held[0], " ".join(rng.choices(vocabulary, k=40))), (held[1], " ".join(word() for _ in range(40)))]
    got = {r.doc_id: r.bits_per_byte for r in C.score(docs_of(spark, rows)).collect()}
    assert got[held[0]] < 2 and got[held[1]] > 4


class SlowTexts(Slow):
    """Of whole texts: contexts go on across words, and before a text stand ENDs."""

    def steps(self, word):
        x = C.END * C.DEPTH + word
        return [(x[:k], x[k]) for k in range(C.DEPTH, len(x))]


def of_text(text):
    return C.GAP.join(C.tokens(text)) + C.END


def test_query_weighs_contexts_across_words(spark, tmp_path):
    """Scores of whole texts by recursion; the same words in another order score otherwise."""
    from bytelake.llm.queries import op6_ctw

    learned, held = ([i for i in range(100) if bool(zlib.crc32(str(i).encode()) % 10) == x] for x in (True, False))
    rows = [*zip(learned, ["ab cd ab cd", "Ab \t cd", "é ef\nab", None, "", "cd ef gh ab cd"]), (None, "new ab"), *zip(held, ["ab cd", "cd ab", "xyz é", None])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op6_ctw(spark, str(tmp_path)).collect()}
    slow = SlowTexts(Counter(of_text(t) for i, t in rows if not got[i].held_out))
    assert len(got) == len(rows) and sum(r.held_out for r in got.values()) >= 4
    for i, t in rows:
        assert math.isclose(got[i].score, slow.log10(of_text(t)), rel_tol=1e-9), (i, t)
    assert abs(got[held[0]].score - got[held[1]].score) > 0.1


def test_texts_in_blocks_and_pieces(spark, monkeypatch):
    """However texts are cut into blocks and pieces, also long ones, each gets the same score."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "é", "gamma."], k=rng.randrange(40)))) for i in range(90)] + [(200, None), (201, "long " * 5000), (201, "long " * 5000)]
    docs = docs_of(spark, rows)
    whole = sorted(map(tuple, C.score_texts(docs).collect()), key=str)
    for a, b in zip(whole, sorted(map(tuple, C.score_texts(docs, block_bytes=300).collect()), key=str), strict=True):
        assert a[:5] == b[:5] and all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a[5:], b[5:], strict=True)), (a, b)
    texts = [of_text(t) for _, t in rows]
    want = Counter(x for t in texts for x in zip((C.END * C.DEPTH + t)[C.DEPTH :], (C.END * C.DEPTH + t)[C.DEPTH - 1 :]))
    monkeypatch.setattr(C, "PIECE", 100)
    pairs, ends = Counter(), Counter()
    for of, pieces in C._pieces(texts):
        keys, first, piece = C.text_grams(pieces)
        for k, n in zip(keys.tolist(), np.diff(first, append=len(piece)).tolist(), strict=True):
            pairs[k & 255, k >> 8 & 255] += n
        ends.update(of[piece].tolist())
    assert pairs == want and [ends[k] for k in range(len(texts))] == [len(t) for t in texts]
    assert C.score_texts(docs.limit(0)).count() == 0

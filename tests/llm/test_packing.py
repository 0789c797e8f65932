import random
import zlib
from collections import defaultdict

from bytelake.llm.packing import Packer, pack

TEXTS = ["", None, "hello  world", "it's <|endoftext|> ÉÀ x y", "a" * 300, "café 1234 İstanbul", "hello  world", "word " * 9000]


def test_pieces_are_exact(spark, vocab):
    from tokenizers import Tokenizer

    path = vocab("word_bpe_49k.json")
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string").coalesce(1)
    rows = pack(docs, path).collect()
    tok, by_doc, by_seq = Tokenizer.from_file(path), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in enumerate(TEXTS):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        got = sorted(by_doc[i if i else None], key=lambda r: r.start)
        assert [r.start for r in got] == [sum(x.length for x in got[:k]) for k in range(len(got))]
        assert b"".join(r.ids for r in got) == b"".join(x.to_bytes(4, "little") for x in ids)
        assert {r.doc_tokens for r in got} == {len(ids)}
        assert all(zlib.crc32(r.ids) >= 0 and len(r.ids) == 4 * r.length for r in got)
    for seq in by_seq.values():
        seq.sort(key=lambda r: r.offset)
        assert [r.offset for r in seq] == [sum(x.length for x in seq[:k]) for k in range(len(seq))]
        n = sum(r.length for r in seq)
        assert n <= 4096 and n & (n - 1) == 0 and {r.window for r in seq} == {n}


def test_packer_loses_nothing():
    rng = random.Random(5)
    packer, lengths, got = Packer((8, 16, 32), 500), [rng.choice([1, 3, 8, 9, 17, 31, 32, 33, 100]) for _ in range(400)], defaultdict(list)
    for d, n in enumerate(lengths):
        seqs = list(packer.add(d, n))
        seqs += packer.flush() if packer.full() else []
        seqs += packer.finish() if d == len(lengths) - 1 else []
        for seq in seqs:
            size = sum(e - s for _, s, e in seq)
            assert size <= 32 and size & (size - 1) == 0
            for doc, s, e in seq:
                got[doc] += range(s, e)
    assert all(sorted(got[d]) == list(range(n)) for d, n in enumerate(lengths))


def test_empty_table(spark, vocab):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), vocab("word_bpe_49k.json")).count() == 0


def test_words_equal_the_library(vocab):
    from tokenizers import Tokenizer

    from bytelake.llm.tokens import WordIds

    path = vocab("word_bpe_49k.json")
    tok, words, rng = Tokenizer.from_file(path), WordIds(path, max_words=50), random.Random(2)
    signs = [*map(chr, range(0x20, 0x250)), *"\u0300\u0301ΣΑσς日本١İ\u00a0\u2003😀", "<|endoftext|>", "'s", "'LL", *"abcdefgh ABC"] + ["\n", " ", "  ", "ing", "the"] * 20
    for _ in range(3000):
        text = "".join(rng.choices(signs, k=rng.randrange(12)))
        assert words.encode(text) == b"".join(i.to_bytes(4, "little") for i in tok.encode(text, add_special_tokens=False).ids), repr(text)


def test_step_groups_weigh_the_same(spark, vocab):
    """Within a shard and window, every group but the last holds exactly step_tokens tokens, and numbers lead on."""
    rng = __import__("random").Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.randrange(1, 900)))) for i in range(400)], "doc_id long, text string").repartition(2)
    size = 8192
    rows = pack(docs, vocab("word_bpe_49k.json"), step_tokens=size).collect()
    weight, of = defaultdict(int), {}
    for r in rows:
        shard = r.sequence_id >> 36
        weight[shard, r.window, r.step_group] += r.length
        assert of.setdefault(r.sequence_id, (r.window, r.step_group)) == (r.window, r.step_group) and r.step_group >> 36 == shard
    for shard, window in {k[:2] for k in weight}:
        groups = sorted(g for s, w, g in weight if (s, w) == (shard, window))
        assert groups == list(range(groups[0], groups[0] + len(groups)))
        assert all(weight[shard, window, g] == size for g in groups[:-1]) and 0 < weight[shard, window, groups[-1]] <= size
    assert any(len({g for s, w, g in weight if (s, w) == k}) > 3 for k in {k[:2] for k in weight})

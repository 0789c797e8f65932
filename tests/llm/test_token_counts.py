import random

from bytelake.llm.token_counts import Counter, token_counts, whole_tokens


def test_counts_equal_the_library(spark, vocab):
    from tokenizers import Tokenizer

    path = vocab("byte_bpe_50k.json")
    rng = random.Random(3)
    marks = ["'s", "'LL", " ", "  ", "\n", "\t", " ", "é", "é", "日本", "١٢", "12", "!?", "<|endoftext|>", "<|endof", "՘", "\U0001f600", "word", " The", "\x00", "​"]
    texts = ["".join(rng.choices(marks, k=rng.randrange(30))) for _ in range(800)] + ["", "x" * 50_000, "the cat " * 5000]
    tok = Tokenizer.from_file(path)
    counter = Counter(path, max_kept=50_200)
    assert [counter.count(t) for t in texts] == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    docs = spark.createDataFrame([(None, None, 1), (1, "hello world", 2), (1, "hello world", 2)], "doc_id long, text string, n_tokens int")
    assert sorted(map(tuple, token_counts(docs, path, limit=1).collect()), key=str) == [(1, 11, 2, True), (1, 11, 2, True), (None, 0, 0, False)]
    assert token_counts(docs.limit(0), path).count() == 0


def test_small_cache(vocab):
    path = vocab("byte_bpe_50k.json")
    a, b = Counter(path), Counter(path, max_kept=50_010)
    assert all(a.count(t) == b.count(t) for t in (f"qzx{i}vv {i}" for i in range(3000)))


def test_not_every_vocabulary_string_is_whole(vocab):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocab("byte_bpe_50k.json"))
    whole = whole_tokens(tok)
    assert 40_000 < len(whole) < 50_257 and all(len(tok.encode(t).ids) == 1 for t in whole)

"""Exact token counts of a byte-level BPE, with a shortcut for pre-tokens that are one token."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelake.llm.tokens import spelled

#: The pre-token pattern of the byte-level BPE (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def whole_tokens(tokenizer) -> set[str]:
    """The vocabulary's strings that are one pre-token and that the library, given each alone, encodes as one token.

    A vocabulary string need not be reachable: merges may stop short of it. So each is encoded, once, before any text is read.
    """
    import regex

    from tokenizers import decoders

    decode, whole = decoders.ByteLevel(), regex.compile(PATTERN)
    texts = [t for x in tokenizer.get_vocab(with_added_tokens=False) if "�" not in (t := decode.decode([x])) and whole.fullmatch(t)]
    return {t for t, e in zip(texts, tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True) if len(e.ids) == 1}


class Counter(dict):
    """Pre-token -> number of tokens. max_kept bounds the cache of merged pre-tokens, which is emptied when full, but for the whole tokens.

    Pre-tokens in whole (by default, those of whole_tokens()) are one token; the others are merged by the tokenizer's model.
    """

    def __init__(self, path: str, max_kept: int = 250_000, whole=None):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.max_kept = Tokenizer.from_file(path), max_kept
        self.specials = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.find = regex.compile(PATTERN).findall
        self.foreign = re.compile("[" + FOREIGN + "]").search
        self.merge = self.tokenizer.model.tokenize
        self.whole = whole_tokens(self.tokenizer) if whole is None else whole
        super().__init__(dict.fromkeys(self.whole, 1))

    def __missing__(self, token: str) -> int:
        n = len(self.merge(spelled(token)))
        if len(token) <= 64:
            if len(self) >= self.max_kept:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[token] = n
        return n

    def count(self, text: str) -> int:
        """A text with a special token's string, or with a character that the two pattern engines class differently, goes to the library whole."""
        if any(s in text for s in self.specials) or not text.isascii() and self.foreign(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(map(self.__getitem__, self.find(text)))


@functools.lru_cache(2)
def proven(path: str) -> tuple[str, ...]:
    """The whole tokens of a tokenizer's file, proven once by the driver: at most its vocabulary."""
    from tokenizers import Tokenizer

    return tuple(sorted(whole_tokens(Tokenizer.from_file(path))))


_COUNTERS: dict[str, Counter] = {}


def counter(path: str, whole: tuple[str, ...]) -> Counter:
    """One for each Python process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path, whole=whole)
    return _COUNTERS[path]


#: Ranges of code points that the regex module and the tokenizer's engine class differently (fixed values, found by trying every code point).
FOREIGN_RANGES = (
    (0x558, 0x558), (0x58b, 0x58c), (0x88f, 0x88f), (0xc5c, 0xc5c), (0xcdc, 0xcdc), (0x208f, 0x208f), (0x209d, 0x209f), (0xa7ce, 0xa7cf),
    (0xa7d2, 0xa7d2), (0xa7d4, 0xa7d4), (0xa7dd, 0xa7dd), (0xa7e2, 0xa7e2), (0xa7f1, 0xa7f1), (0xab6c, 0xab6d), (0x107bb, 0x107bf),
    (0x10940, 0x10959), (0x10ec5, 0x10ec7), (0x10ed9, 0x10eee), (0x11b0a, 0x11b0a), (0x11db0, 0x11ddb), (0x11de0, 0x11de9), (0x11df1, 0x11df1),
    (0x1246f, 0x1246f), (0x12475, 0x1247f), (0x12550, 0x12686), (0x16ea0, 0x16eb8), (0x16ebb, 0x16ed3), (0x16ff2, 0x16ff6), (0x187f8, 0x187ff),
    (0x18cd6, 0x18cda), (0x18d09, 0x18d20), (0x18d80, 0x18df2), (0x18e00, 0x19191), (0x191a0, 0x191d2), (0x1b123, 0x1b128), (0x1b168, 0x1b168),
    (0x1d6a6, 0x1d6a6), (0x1df1f, 0x1df24), (0x1df2b, 0x1df81), (0x1df90, 0x1df96), (0x1dfcd, 0x1dfff), (0x1e6c0, 0x1e6de), (0x1e6e0, 0x1e6e2),
    (0x1e6e4, 0x1e6e5), (0x1e6e7, 0x1e6ed), (0x1e6f0, 0x1e6f4), (0x1e6fe, 0x1e6ff), (0x2b73a, 0x2b73f), (0x2b81e, 0x2b81e), (0x2cea2, 0x2cead),
    (0x323b0, 0x33479), (0x3d000, 0x3fc3f),
)
FOREIGN = "".join(f"{chr(a)}-{chr(b)}" for a, b in FOREIGN_RANGES)


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), of whole texts.

    Counts are those of the tokenizers library without added special tokens. Null texts are empty (0 bytes, 0 tokens), null ids stay null,
    repeated rows are counted each, other columns are ignored, an empty table gives no rows. One pass without a shuffle. Which strings of the vocabulary are one token is proven before, by the driver, and sent along.
    """
    whole = docs.sparkSession.sparkContext.broadcast(proven(tokenizer))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer, whole.value).count
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                rows = batch.slice(k, 512)
                n = [count(t or "") for t in rows.column(1).to_pylist()]
                n_bytes = pc.fill_null(pc.binary_length(rows.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column(0), n_bytes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(part, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

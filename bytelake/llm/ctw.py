"""Language-model scores by context-tree weighting of binary-decomposed bytes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelake.llm.common import crc32_mod, discard, written

#: Bytes of a context at most.
DEPTH = 5
#: A token is START, its bytes and STOP; the end of a text is the token END without a STOP. No word holds one of these bytes. Contexts end at START.
START = STOP = b" "
END = b"\n"
#: Words that are scored together.
CHUNK_WORDS = 200_000
_START, _END = START[0], END[0]
#: Between the words of a whole text; in no word. It is not START, so contexts go on across it.
GAP = b"\t"
#: Bytes of texts whose grams are sorted at once.
PIECE = 4_000_000


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5, by Stirling's series after a shift of 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives to any sequence with these counts."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1.0) - 2 * 0.5723649429247001


def grams(words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of the tokens with the context before it, as one number, and how often it occurs if the words occur counts times.

    The byte is lowest, then the context, the latest byte first; above a START are zeros.
    """
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = bytes(DEPTH - 1) + START
    x = np.frombuffer(b"".join(before + (w if w == END else w + STOP) for w in words), np.uint8)
    key = np.zeros(len(x) - DEPTH, np.int64)
    for k in range(DEPTH + 1):
        key <<= 8
        np.bitwise_or(key, x[k : len(x) - DEPTH + k], out=key)
    lengths = np.array([len(w) + (w != END) for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + DEPTH)[:-1]])
    inside = np.ones(len(x), bool)
    for k in range(DEPTH):
        inside[starts + k] = False
    return key[inside[DEPTH:]], np.repeat(counts, lengths)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key, in the order of the keys."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def _complete(context: np.ndarray, d: int) -> np.ndarray:
    """Whether contexts of d bytes (or fewer behind a START) have no longer one: START is among their bytes, or they are of the greatest length."""
    out = np.full(len(context), d == DEPTH)
    for k in range(d):
        out |= context >> 8 * k & 255 == _START
    return out


class Level:
    """The nodes of all contexts of one length: for each node of a context's binary tree of the next byte, the zeros and ones that followed."""

    def __init__(self, d: int, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray):
        """keys: context << 8 | node, with repeats to be summed up. Node 1 is the root of a byte's tree, 2 k and 2 k + 1 lie below k."""
        self.keys, row = np.unique(keys, return_inverse=True)
        self.n0, self.n1 = np.bincount(row, n0, len(self.keys)), np.bincount(row, n1, len(self.keys))
        self.row, self.full = row, _complete(self.keys >> 8, d)

    def weigh(self, product: np.ndarray) -> None:
        """stop: the weight that the data leave to this node's own estimator, rather than to the longer contexts with their product; log_w: the log of the weighted probability."""
        log_kt = _log_kt(self.n0, self.n1)
        self.stop = np.where(self.full, 1.0, 1.0 / (1.0 + np.exp(np.clip(product - log_kt, -700, 700))))
        self.log_w = np.where(self.full, log_kt, np.logaddexp(log_kt, product) - math.log(2))

    def mix(self, mixed: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability of a one by the contexts up to here, and the weight that is left to longer ones, from those of the context that is one byte shorter."""
        return mixed + left * self.stop * (self.n1 + 0.5) / (self.n0 + self.n1 + 1.0), left * (1.0 - self.stop)


def _bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each gram, the 8 nodes on the way to its byte and the bits taken there."""
    byte, bit = (keys & 255)[:, None], np.arange(8)
    return (256 | byte) >> (8 - bit), byte >> (7 - bit) & 1


def _subtree(keys: np.ndarray, n: np.ndarray) -> list[Level]:
    """The levels of 2 to DEPTH bytes of grams that share the last two bytes of their contexts, weighed."""
    node, bit = _bits(keys)
    zeros, ones, levels = np.where(bit, 0, n[:, None]).ravel(), np.where(bit, n[:, None], 0).ravel(), []
    for d in range(DEPTH, 1, -1):
        at = ((keys >> 8 & ((1 << 8 * d) - 1))[:, None] << 8 | node).ravel()
        level = Level(d, at, zeros, ones)
        if levels:
            longer = levels[-1]
            parent = np.searchsorted(level.keys, (longer.keys >> 8 & ((1 << 8 * d) - 1)) << 8 | longer.keys & 255)
            level.weigh(np.bincount(parent, longer.log_w, len(level.keys)))
        else:
            level.weigh(np.zeros(len(level.keys)))
        levels.append(level)
    return levels[::-1]


class Top:
    """The contexts of no and of one byte, from the weighed nodes of two: at most 2^16 contexts of 255 nodes."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, log_w: np.ndarray):
        one = Level(1, (keys >> 8 & 255) << 8 | keys & 255, n0, n1)
        one.weigh(np.bincount(one.row, log_w, len(one.keys)))
        root = Level(0, one.keys & 255, one.n0, one.n1)
        root.weigh(np.bincount(root.row, one.log_w, len(root.keys)))
        mixed, left = root.mix(np.zeros(len(root.keys)), np.ones(len(root.keys)))
        self.keys, (self.mixed, self.left) = one.keys, one.mix(mixed[root.row], left[root.row])


def gram_logs(keys: np.ndarray, n: np.ndarray, top: Top) -> np.ndarray:
    """log10 of the probability that each gram's byte follows its context; the grams are all that share the last two bytes of their contexts."""
    levels = _subtree(keys, n)
    at = np.searchsorted(top.keys, (levels[0].keys >> 8 & 255) << 8 | levels[0].keys & 255)
    mixed, left = levels[0].mix(top.mixed[at], top.left[at])
    for d, level in enumerate(levels[1:], 3):
        at = np.searchsorted(levels[d - 3].keys, (level.keys >> 8 & ((1 << 8 * (d - 1)) - 1)) << 8 | level.keys & 255)
        mixed, left = level.mix(mixed[at], left[at])
    node, bit = _bits(keys)
    p = mixed[np.searchsorted(levels[-1].keys, ((keys >> 8)[:, None] << 8 | node).ravel())].reshape(node.shape)
    return np.log10(np.where(bit, p, 1.0 - p)).sum(axis=1)


def tokens(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, parted by ASCII white space only."""
    return (text or "").encode().lower().split()


BLOCKS = "block long, id long, held_out boolean, text binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """Documents as the bytes that are scored (words with one blank between, and END; packed by zstd, as they are written once and moved once), dealt to blocks of neighbours.
    A block ends with the first document past block_bytes."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        block, size, pack = TaskContext.get().partitionId() << 32, 0, zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                rows = batch.slice(k, 512)
                texts, of = [], []
                for text in rows.column(2):
                    raw = b" ".join(tokens(text.as_py())) + END
                    texts.append(pack(raw))
                    of.append(block)
                    size += len(raw)
                    if size >= block_bytes:
                        block, size = block + 1, 0
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), rows.column(0), rows.column(1), pa.array(texts, pa.binary())], names=["block", "id", "held_out", "text"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), (crc32_mod(id_col, 10) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(part, BLOCKS)


class _Local(dict):
    """Word -> its number among the words seen here."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def of(self, text: bytes) -> np.ndarray:
        """A text's tokens: its words and END."""
        words = text.split()
        words.append(END)
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def _entries(blocks: DataFrame) -> DataFrame:
    """(block, word, n): each distinct token of a block, and its count in the block's training documents. A block that lies in two partitions has entries from each."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        now, local, train, unpack = None, _Local(), [np.zeros(0, np.int32)], zstandard.ZstdDecompressor().decompress

        def out():
            n, words = np.bincount(np.concatenate(train), minlength=len(local)), list(local)
            for k in range(0, len(words), 50_000):
                w = words[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), now)), pa.array(w, pa.binary()), pa.array(n[k : k + 50_000])], names=["block", "word", "n"])

        for batch in batches:
            for block, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if block != now:
                    if now is not None:
                        yield from out()
                    now, local, train = block, _Local(), [np.zeros(0, np.int32)]
                numbers = local.of(unpack(text.as_py()))
                if not held:
                    train.append(numbers)
        if now is not None:
            yield from out()

    return blocks.select("block", "held_out", "text").mapInArrow(part, "block long, word binary, n long")


def _chunk_grams(words: DataFrame) -> DataFrame:
    """(chunk, key, n): the distinct grams of a chunk of words and their counts in training."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def out():
            keys, n = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            for k in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[k : k + 100_000]), now, np.int32)), pa.array(keys[k : k + 100_000]), pa.array(n[k : k + 100_000])], names=["chunk", "key", "n"])

        for batch in batches:
            chunks = batch.column(0).to_numpy()
            for chunk in np.unique(chunks):
                if chunk != now:
                    if now is not None:
                        yield from out()
                    now, parts = chunk, []
                rows = batch.filter(pa.array(chunks == chunk))
                for k in range(0, rows.num_rows, 20_000):
                    some = rows.slice(k, 20_000)
                    parts.append(_summed(*grams(some.column(1).to_pylist(), some.column(2).to_numpy())))
                if sum(len(k) for k, _ in parts) > 2_000_000:
                    parts = [_summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
        if now is not None:
            yield from out()

    return words.select("chunk", "word", "c").mapInArrow(part, "chunk int, key long, n long")


def word_logs(totals: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(word, c, log): of each token (word, c: its count in training), the log10 probability of its bytes and the STOP by the tree that training makes. A written table.

    Words are dealt to chunks of neighbours in their order, which share most of their grams. Each gram's counts are summed over the chunks. Subtrees of the contexts that share their last two bytes are
    weighed each by itself; their roots meet in the driver (at most 2^16 times 255 rows), where the two shortest lengths are weighed, and then each subtree gives the probability of every gram in
    it. So no context is left out, however rare, and the tree grows with the texts. Probabilities go back to the chunks, where words add them up.
    """
    parts = max(1, -(-totals.count() // chunk_words))
    words = written(totals.select("word", "c").repartitionByRange(parts, "word").withColumn("chunk", F.spark_partition_id()), "chunks")
    of_chunks = written(_chunk_grams(words), "chunk-grams")
    subtree = F.shiftright("key", 8).bitwiseAND(0xFFFF).cast("int").alias("subtree")
    every = written(of_chunks.groupBy("key").agg(F.sum("n").alias("n")).select("key", "n", subtree), "grams")

    def roots(table: pa.Table) -> pa.Table:
        two = _subtree(table.column("key").to_numpy(), table.column("n").to_numpy())[0]
        return pa.table({"key": pa.array(two.keys), "n0": pa.array(two.n0), "n1": pa.array(two.n1), "log_w": pa.array(two.log_w)})

    got = every.groupBy("subtree").applyInArrow(roots, "key long, n0 double, n1 double, log_w double").toArrow().sort_by("key")
    top = totals.sparkSession.sparkContext.broadcast(Top(*(got.column(c).to_numpy() for c in ("key", "n0", "n1", "log_w"))))

    def logs(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy()
        return pa.table({"key": table.column("key"), "log": pa.array(gram_logs(keys, table.column("n").to_numpy(), top.value))})

    known = of_chunks.select("chunk", "key").distinct().join(every.groupBy("subtree").applyInArrow(logs, "key long, log double"), "key")

    def add_up(words: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(found.column("key").to_numpy())
        keys, log = found.column("key").to_numpy()[order], found.column("log").to_numpy()[order]
        out = []
        for k in range(0, words.num_rows, 20_000):
            some = words.column("word").slice(k, 20_000).to_pylist()
            at, _ = grams(some, np.zeros(len(some), np.int64))
            ends = np.cumsum([len(w) + (w != END) for w in some])
            out.append(np.add.reduceat(log[np.searchsorted(keys, at)], np.concatenate([[0], ends[:-1]])))
        return pa.table({"word": words.column("word"), "c": words.column("c"), "log": pa.array(np.concatenate(out) if out else np.zeros(0))})

    scored = written(words.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(add_up, "word binary, c long, log double"), "word-logs")
    discard(words, of_chunks, every)
    return scored


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 12_000_000, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte. Each word is scored by itself; score_texts() weighs whole texts.

    Documents whose crc32 of the id as text is 0 modulo 10 are held out; all others are learned from. A document is its words (A-Z lower-cased, parted by ASCII white space) and
    one end, which is a token and a byte of its own. base_score is the smoothed unigram log10 probability of the tokens. score is the log10 probability that the tree gives to the bytes of the tokens: of each word, its bytes and
    the blank that ends it, and of the end. A byte's contexts are the up to DEPTH bytes before it in its token, and the token's start; the tree has every context that occurs. bits_per_byte is the code length of the words with one
    blank between and the end. n_known: tokens that training has.

    Null or empty texts are the end alone; null ids stay null and count as the empty text in the crc; repeated rows are learned from and scored each; other columns are ignored; an empty table gives no rows.

    Texts are kept in blocks, so words are counted and their scores are joined once per block and word instead of once per document and word. With nothing to learn from, every token is unknown and every bit is even.
    """
    blocks = written(_blocks(docs, id_col, text_col, block_bytes), "blocks")
    entries = written(_entries(blocks), "entries")
    totals = written(entries.groupBy("word").agg(F.sum("n").alias("c")), "words")
    n_train, distinct = totals.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    scored = word_logs(totals, chunk_words)
    discard(totals)
    shared = entries.select("block", "word").join(scored, "word")

    def one(rows: pa.Table, found: pa.Table) -> pa.Table:
        import zstandard

        local, unpack = _Local(), zstandard.ZstdDecompressor().decompress
        at = np.fromiter(map(local.__getitem__, found.column("word").to_pylist()), np.int64, found.num_rows)
        of, log = np.zeros(len(local)), np.zeros(len(local))
        of[at], log[at] = found.column("c").to_numpy(), found.column("log").to_numpy()
        base, known = np.log10((of + 0.1) / (n_train + 0.1 * (distinct + 1))), of > 0
        out = []
        for raw in rows.column("text"):
            text = unpack(raw.as_py())
            k = local.of(text)
            out.append((len(k), int(known[k].sum()), float(base[k].sum()), float(log[k].sum()), len(text)))
        n_tokens, n_known, base_score, got, n_bytes = (np.array(c) for c in zip(*out, strict=True)) if out else (np.zeros(0),) * 5
        return pa.table(
            {
                "doc_id": rows.column("id"), "held_out": rows.column("held_out"), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
                "train_tokens": pa.array(np.full(len(out), n_train, np.int64)), "base_score": pa.array(base_score), "score": pa.array(got), "n_bytes": pa.array(n_bytes, pa.int64()), "bits_per_byte": pa.array(-got / np.log10(2) / n_bytes),
            }
        )

    return blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(one, SCORES)


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Whole texts in slices of some PIECE bytes and at most 2^16 pieces: the numbers of the pieces' texts, and the pieces. Each stands behind the DEPTH bytes before it, at a text's start behind ENDs."""
    of, pieces, size = [], [], 0
    for k, text in enumerate(texts):
        x = END * DEPTH + text.replace(b" ", GAP)
        for at in range(0, len(text), PIECE):
            of.append(k)
            pieces.append(x[at : at + PIECE + DEPTH])
            size += len(pieces[-1])
            if size >= PIECE or len(pieces) == 1 << 16:
                yield np.array(of), pieces
                of, pieces, size = [], [], 0
    if pieces:
        yield np.array(of), pieces


def text_grams(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct grams of pieces, in order: each byte with the DEPTH bytes before it, whatever words these belong to, as one number like that of grams(). With them the place at which
    the run of each begins among all grams in this order, and the pieces of all."""
    x = np.frombuffer(b"".join(pieces), np.uint8)
    key = np.zeros(len(x) - DEPTH, np.uint64)
    for k in range(DEPTH + 1):
        key <<= np.uint64(8)
        np.bitwise_or(key, x[k : len(x) - DEPTH + k], out=key)
    lengths = np.array([len(p) for p in pieces], np.int64)
    starts = np.cumsum(lengths) - lengths
    inside = np.ones(len(x), bool)
    for k in range(DEPTH):
        inside[starts + k] = False
    both = key[inside[DEPTH:]] << np.uint64(16)
    both |= np.repeat(np.arange(len(pieces), dtype=np.uint64), lengths - DEPTH)
    both.sort()
    keys = (both >> np.uint64(16)).view(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], first, (both & np.uint64(0xFFFF)).view(np.int64)


def _pack(x: np.ndarray) -> bytes:
    """Numbers of 8 bytes, their first bytes first, by zstd."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), 3)


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(8, -1).T).view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=0))


def _unpack_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpack(packed, np.int64))


def _block_grams(blocks: DataFrame) -> DataFrame:
    """(part, block, keys, n): the distinct grams of a block's texts and their counts in its training documents, packed. Subtrees of contexts that share their last two bytes are dealt to 256 parts."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        now, texts, train, unpack = None, [], [], zstandard.ZstdDecompressor().decompress

        def out() -> pa.RecordBatch:
            found = []
            for of, pieces in _pieces(texts):
                keys, first, piece = text_grams(pieces)
                found.append((keys, np.add.reduceat(np.array(train, np.int64)[of][piece], first)))
            keys, n = _summed(*(np.concatenate(x) for x in zip(*found, strict=True)))
            to = ((keys >> 8 & 0xFFFF) * 40503 & 0xFFFF) >> 8
            at = [np.flatnonzero(to == k) for k in np.unique(to)]
            return pa.RecordBatch.from_arrays(
                [pa.array([int(to[k[0]]) for k in at], pa.int32()), pa.array([now] * len(at), pa.int64()), pa.array([_pack_keys(keys[k]) for k in at], pa.binary()), pa.array([_pack(n[k]) for k in at], pa.binary())], names=["part", "block", "keys", "n"]
            )

        for batch in batches:
            for block, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if block != now:
                    if texts:
                        yield out()
                    now, texts, train = block, [], []
                texts.append(unpack(text.as_py()))
                train.append(not held)
        if texts:
            yield out()

    return blocks.select("block", "held_out", "text").mapInArrow(part, "part int, block long, keys binary, n binary")


def _part_grams(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All grams of a part in order, their counts in training, and the places of each subtree's."""
    parts, waiting = [], 0
    for keys, n in zip(table.column("keys"), table.column("n"), strict=True):
        parts.append((_unpack_keys(keys.as_py()), _unpack(n.as_py(), np.int64)))
        waiting += len(parts[-1][0])
        if waiting > 2_000_000:
            parts, waiting = [_summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))], 0
    keys, n = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    two = keys >> 8 & 0xFFFF
    order = np.argsort(two, kind="stable")
    return keys, n, np.split(order, np.flatnonzero(np.diff(two[order])) + 1)


def block_logs(found: DataFrame) -> DataFrame:
    """(block, keys, logs): of each gram of a block, the log10 probability of its byte by the tree that training makes, packed. found: of _block_grams, written.

    The counts of a part's grams are summed over the blocks and its subtrees weighed one by one. Their roots meet in the driver (at most 2^16 times 255 rows), where the two shortest lengths are weighed,
    and then each subtree gives the probability of every gram in it. No context is left out, however rare.
    """

    def roots(table: pa.Table) -> pa.Table:
        keys, n, subtrees = _part_grams(table)
        two = [_subtree(keys[at], n[at])[0] for at in subtrees]
        return pa.table({c: pa.array(np.concatenate([getattr(t, c) for t in two])) for c in ("keys", "n0", "n1", "log_w")}).rename_columns(["key", "n0", "n1", "log_w"])

    got = found.groupBy("part").applyInArrow(roots, "key long, n0 double, n1 double, log_w double").toArrow().sort_by("key")
    top = found.sparkSession.sparkContext.broadcast(Top(*(got.column(c).to_numpy() for c in ("key", "n0", "n1", "log_w"))))

    def logs(table: pa.Table) -> pa.Table:
        keys, n, subtrees = _part_grams(table)
        log = np.empty(len(keys))
        for at in subtrees:
            log[at] = gram_logs(keys[at], n[at], top.value)
        packed = [_pack(log[np.searchsorted(keys, _unpack_keys(k.as_py()))]) for k in table.column("keys")]
        return pa.table({"block": table.column("block"), "keys": table.column("keys"), "logs": pa.array(packed, pa.binary())})

    return found.groupBy("part").applyInArrow(logs, "block long, keys binary, logs binary")


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 24_000_000) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Like score(), but the tree weighs whole texts: the bytes of the words with one gap between and the end. A byte's contexts are the up to DEPTH bytes before it in the text, across words; before a text
    stand ENDs. score is the log10 probability that the tree gives to all bytes of the text, so it depends on the order of the words.

    Texts are kept in blocks. Distinct words and grams of a block are counted, their counts and probabilities come back once per block.
    """
    blocks = written(_blocks(docs, id_col, text_col, block_bytes), "blocks")
    entries = written(_entries(blocks), "entries")
    totals = written(entries.groupBy("word").agg(F.sum("n").alias("c")), "words")
    n_train, distinct = totals.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    logs = block_logs(written(_block_grams(blocks), "grams"))
    words = entries.select("block", "word").join(totals, "word").select("block", "word", "c", F.lit(None).cast("binary").alias("logs"))
    shared = words.unionAll(logs.select("block", "keys", F.lit(None).cast("long"), "logs"))

    def one(rows: pa.Table, found: pa.Table) -> pa.Table:
        import zstandard

        local, unpack = _Local(), zstandard.ZstdDecompressor().decompress
        words, grams_of = found.filter(found.column("logs").is_null()), found.filter(found.column("logs").is_valid())
        at = np.fromiter(map(local.__getitem__, words.column("word").to_pylist()), np.int64, words.num_rows)
        of = np.zeros(len(local))
        of[at] = words.column("c").to_numpy()
        base, known = np.log10((of + 0.1) / (n_train + 0.1 * (distinct + 1))), of > 0
        texts, out = [unpack(raw.as_py()) for raw in rows.column("text")], []
        for text in texts:
            k = local.of(text)
            out.append((len(k), int(known[k].sum()), float(base[k].sum()), len(text)))
        n_tokens, n_known, base_score, n_bytes = (np.array(c) for c in zip(*out, strict=True)) if out else (np.zeros(0),) * 4
        keys = np.concatenate([np.zeros(0, np.int64), *(_unpack_keys(k.as_py()) for k in grams_of.column("word"))])
        order = np.argsort(keys)
        keys, log = keys[order], np.concatenate([np.zeros(0), *(_unpack(x.as_py(), np.float64) for x in grams_of.column("logs"))])[order]
        got = np.zeros(len(texts))
        for numbers, pieces in _pieces(texts):
            distinct_keys, first, piece = text_grams(pieces)
            each = np.repeat(log[np.searchsorted(keys, distinct_keys)], np.diff(first, append=len(piece)))
            np.add.at(got, numbers, np.bincount(piece, each, len(pieces)))
        return pa.table(
            {
                "doc_id": rows.column("id"), "held_out": rows.column("held_out"), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
                "train_tokens": pa.array(np.full(len(out), n_train, np.int64)), "base_score": pa.array(base_score), "score": pa.array(got), "n_bytes": pa.array(n_bytes, pa.int64()), "bits_per_byte": pa.array(-got / np.log10(2) / n_bytes),
            }
        )

    return blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(one, SCORES)

"""Hierarchical multi-length packing of documents into training sequences."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelake.llm.tokens import word_ids

WINDOWS = (512, 1024, 2048, 4096)


class Packer:
    """Packs one shard. Takes documents by add(), gives sequences: lists of (document, start, end).

    1. A document of at least the longest window gives whole windows at once.
    2. What is left of it goes to the tier of the smallest window that holds it.
    3. Tiers are packed from the longest down. A window opens with the longest remainder of its tier; its gap is filled
       with the largest remainders of shorter tiers that fit, and the last of the gap with a cut of the shortest.
    4. The shard's last tokens are cut at the binary digits of their number: every sequence is a full power of two.
    """

    def __init__(self, windows=WINDOWS, buffer_tokens: int = 2_000_000):
        self.windows, self.top, self.buffer_tokens = tuple(sorted(windows)), max(windows), buffer_tokens
        if any(w & (w - 1) for w in self.windows):
            raise ValueError("windows must be powers of two")
        self.pool: list[tuple[int, int, int]] = []  # (length, document, start), in order
        self.held = 0

    def add(self, doc: int, n: int) -> Iterator[list[tuple[int, int, int]]]:
        whole = n // self.top * self.top
        for s in range(0, whole, self.top):
            yield [(doc, s, s + self.top)]
        if n > whole:
            bisect.insort(self.pool, (n - whole, doc, whole))
            self.held += n - whole

    def full(self) -> bool:
        return self.held >= self.buffer_tokens

    def _take(self, k: int) -> tuple[int, int, int]:
        item = self.pool.pop(k)
        self.held -= item[0]
        return item

    def flush(self) -> Iterator[list[tuple[int, int, int]]]:
        """Every window that can be filled; the rest stays in the pool."""
        short: list[list[tuple[int, int, int]]] = []
        for w, below in zip(reversed(self.windows), [*reversed(self.windows[:-1]), 0], strict=True):
            while self.pool and self.pool[-1][0] > below:
                n, doc, start = self._take(-1)
                got, gap = [(doc, start, start + n)], w - n
                while gap and self.pool:
                    k = bisect.bisect_right(self.pool, (gap, float("inf"), 0)) - 1
                    if k >= 0:
                        n, doc, start = self._take(k)
                    else:  # none fits: cut the shortest
                        n, doc, start = self._take(0)
                        bisect.insort(self.pool, (n - gap, doc, start + gap))
                        self.held += n - gap
                        n = gap
                    got.append((doc, start, start + n))
                    gap -= n
                if gap:
                    short.append(got)
                else:
                    yield got
        for doc, s, e in (x for got in short for x in got):
            bisect.insort(self.pool, (e - s, doc, s))
            self.held += e - s

    def finish(self) -> Iterator[list[tuple[int, int, int]]]:
        """The last tokens, in sequences of their number's binary digits."""
        yield from self.flush()
        rest = [(doc, start, start + n) for n, doc, start in reversed(self.pool)]
        left, self.pool, self.held = sum(e - s for _, s, e in rest), [], 0
        while left:
            room = min(self.top, 1 << (left.bit_length() - 1))
            left -= room
            got = []
            while room:
                doc, s, e = rest.pop(0)
                if e - s > room:
                    rest.insert(0, (doc, s + room, e))
                    e = s + room
                got.append((doc, s, e))
                room -= e - s
            yield got


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, window long, step_group long"


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, windows=WINDOWS, step_tokens: int = 65_536, buffer_tokens: int = 2_000_000
) -> DataFrame:
    """Pieces of documents, each with its ids and its place in a sequence.

    A document is its text's ids (tokenizer: a word-BPE file of the tokenizers library) and then end_id. The columns: SCHEMA;
    ids are little-endian unsigned 32-bit; window is the sequence's tokens, always a power of two, so no sequence needs
    padding; step_group numbers, within a shard and window, groups of step_tokens tokens, so that all steps of a group of equal windows weigh the same.

    Each input partition is a shard, so nothing is shuffled and a lost executor costs its own partitions only; ids are unique over shards.
    At most buffer_tokens ids (and the documents they are of) wait in a task. Null and empty texts are the end
    id alone; null ids stay null; repeated rows are packed as often as they come; other columns are ignored; an empty table gives no rows.
    """
    spark_schema = SCHEMA

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, packer = word_ids(tokenizer), Packer(windows, buffer_tokens)
        first = TaskContext.get().partitionId() << 36
        live: dict[int, tuple[int | None, bytes]] = {}
        count, groups, rows, size = 0, {}, [], 0
        end = int(end_id).to_bytes(4, "little")

        def emit(seq):
            nonlocal count, size
            window = sum(e - s for _, s, e in seq)
            k = groups[window] = groups.get(window, -1) + 1
            offset = 0
            for doc, s, e in seq:
                doc_id, ids = live[doc]
                rows.append((doc_id, s, e - s, ids[4 * s : 4 * e], len(ids) // 4, first + count, offset, window, first + k * window // step_tokens))
                offset += e - s
                size += 4 * (e - s) + 100
            count += 1

        def out(all_rows: bool):
            nonlocal size
            if rows and (all_rows or size > 4_000_000):
                cols = list(zip(*rows, strict=True))
                rows.clear()
                size = 0
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(cols)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        def settle(sequences):
            for seq in sequences:
                emit(seq)
                yield from out(False)

        number = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = part.column(0).to_pylist()
                for doc_id, text in zip(ids, part.column(1).to_pylist(), strict=True):
                    got = words.encode(text or "")
                    live[number] = (doc_id, got + end)
                    yield from settle(packer.add(number, len(got) // 4 + 1))
                    number += 1
                if packer.full():
                    yield from settle(packer.flush())
                wait = {doc for _, doc, _ in packer.pool}
                live = {doc: x for doc, x in live.items() if doc in wait}
        yield from settle(packer.finish())
        yield from out(True)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(shard, spark_schema)


__all__ = ["WINDOWS", "Packer", "pack"]

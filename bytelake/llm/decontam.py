"""Benchmark decontamination by spaced seeds. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelake.llm.common import small, without, written

#: Ones are compared, zeros may be substituted. Their gaps fit texts in which every third, fourth or fifth token was replaced.
MASKS = ("11011011", "1110111", "1111011")
#: Rows of benchmark hashes and of hits (some 40 bytes each) that are sent to every executor at most; larger sets are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seeds(rows: DataFrame, words: str, keep: list[str], masks=MASKS) -> DataFrame:
    """One row (keep, __pos, __h) for each position and mask that fits there. Positions count from 0."""
    span = max(map(len, masks))
    shifted = [F.col(words) if k == 0 else F.slice(words, k + 1, F.greatest(F.size(words), F.lit(1))) for k in range(span)]
    shifted = [c.alias(f"w{k}") for k, c in enumerate(shifted)]
    rows = rows.select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias("__pos", "__w"))
    hashes = [F.when(F.col(f"__w.w{len(m) - 1}").isNotNull(), F.xxhash64(F.lit(i), *[F.col(f"__w.w{k}") for k, c in enumerate(m) if c == "1"])) for i, m in enumerate(masks)]
    return rows.select(*keep, "__pos", F.explode(F.array(*hashes)).alias("__h")).where(F.col("__h").isNotNull())


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_share: float = 0.6,
    enough: int = 20,
    masks=MASKS,
) -> DataFrame:
    """One row for each document and benchmark item it holds: doc_id, item_id, n_matched, item_tokens, start (token of the document).

    Every position of either side is hashed under each mask. Where hashes meet, the item is laid over the document at that place and equal tokens are
    counted; the item is found if at least min_share of its tokens, or enough of them, are equal. start is where the item's first token lies (negative if the document begins inside the item);
    of several places, that of the most matches, then the first.

    Null or empty texts, and items or documents with fewer tokens than the shortest mask spans, match nothing. Rows that repeat an id are searched each and
    reported once. Null ids of documents or items are reported as null. Other columns are ignored; empty tables give no rows.

    The documents' hashes are never shuffled while the benchmark's are at most BROADCAST_ROWS (counted first). Places where hashes meet are written and counted;
    then only the documents that hold one are read into tokens again, once each, and a place is a row of its own until it is counted: no list grows with a document.
    """
    items = benchmark.select(F.col(item_col).alias("__item"), _tokens(F.col(item_text_col)).alias("__item_words")).distinct()
    items = items.withColumn("__iw", F.xxhash64("__item_words"))
    keys = _seeds(items, "__item_words", ["__iw"], masks).select("__iw", F.col("__pos").alias("__at"), "__h").distinct()
    keys = small(written(keys, "item-seeds"), BROADCAST_ROWS)
    base = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__th"), F.col(text_col).alias("__text"))
    tokens = base.select("__id", "__th", _tokens(F.col("__text")).alias("__words"))
    hits = _seeds(tokens, "__words", ["__id", "__th"], masks).join(keys, "__h")
    hits = written(hits.select("__id", "__th", "__iw", (F.col("__pos") - F.col("__at")).alias("__start")).distinct(), "hits")
    held = hits.select(F.col("__id").alias("__pid"), F.col("__th").alias("__pth"))
    same = F.col("__id").eqNullSafe(F.col("__pid")) & (F.col("__th") == F.col("__pth"))
    # one row for each text that is hit, rows that repeat both id and text included
    texts = written(base.join(small(written(held.distinct(), "hit-texts"), BROADCAST_ROWS), same, "left_semi").dropDuplicates(["__id", "__th"]).select("__id", "__th", _tokens(F.col("__text")).alias("__words")), "hit-tokens")
    placed = texts.join(small(hits.withColumnsRenamed({"__id": "__pid", "__th": "__pth"}), BROADCAST_ROWS), same).join(small(written(items, "items"), BROADCAST_ROWS // 40), "__iw")

    there = F.slice("__words", F.greatest("__start", F.lit(0)) + 1, F.size("__item_words"))
    mine = F.slice("__item_words", F.greatest(-F.col("__start"), F.lit(0)) + 1, F.size("__item_words"))
    matched = F.size(F.filter(F.zip_with(there, mine, lambda a, b: a == b), lambda x: x)).cast("long")
    found = placed.select("__id", F.struct(F.col("__item").alias("item"), F.col("__start").alias("start"), F.size("__item_words").alias("n"), matched.alias("m")).alias("p"))
    found = found.where((F.col("p.m") >= F.ceil(F.lit(min_share) * F.col("p.n"))) | (F.col("p.m") >= enough))
    return found.groupBy(F.col("__id").alias("doc_id"), F.col("p.item").alias("item_id")).agg(
        F.max("p.m").alias("n_matched"),
        F.max_by(F.col("p.n"), F.struct("p.m", -F.col("p.start"))).cast("long").alias("item_tokens"),
        F.max_by(F.col("p.start"), F.struct("p.m", -F.col("p.start"))).cast("long").alias("start"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the documents in which leaks() finds an item. Rows with a null id stay: they cannot be named."""
    return without(docs, id_col, leaks(docs, benchmark, id_col, text_col, **how).select("doc_id"))

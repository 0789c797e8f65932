"""Lines that many documents share are dropped, but for one copy. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelake.llm.common import prefix, written

SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _ascii_lower(c: Column) -> Column:
    """A-Z only; the plain lower() serves where a text is all ASCII."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, counts: tuple[str, str] | None = None) -> DataFrame:
    """docs with shared lines dropped: text_col is the kept text. counts: names of two more columns, the lines before and those that were dropped; docs must not have them.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. A key of at
    least min_chars code points that at least min_docs distinct documents hold loses all its lines but those of
    the largest id holding it. Keys are counted by a 128-bit hash.

    Null or empty text is one empty line (null comes back as the empty text). A null id adds nothing to the count of documents
    and never holds the copy that stays. Rows that repeat an id are one document of several rows,
    each treated alike. All other columns pass through; an empty table gives an empty table.

    Only hashes and positions are shuffled, then each text once. A hash that a third of all
    lines share is counted by partial aggregates; in the join back, it is a skewed
    partition that AQE splits.
    """
    if clash := {c.lower() for c in counts or ()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    p = prefix(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.withColumn(f"{p}text", text).withColumn(f"{p}th", F.xxhash64(f"{p}text"))
    lines = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    lines = lines.select("__id", F.xxhash64("__text").alias("__kth"), F.posexplode(_lines(F.col("__text"))).alias("__pos", "__line"))
    lines = lines.select("__id", "__kth", "__pos", F.btrim("__line", F.lit(SPACE)).alias("__s")).where(F.length("__s") >= min_chars)
    lines = lines.select("__id", "__kth", "__pos", _ascii_lower(F.col("__s")).alias("__key"))
    lines = lines.select("__id", "__kth", "__pos", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit("line"), "__key").alias("__h2"))
    shared = lines.groupBy("__h1", "__h2").agg(F.count_distinct("__id").alias("__n"), F.max("__id").alias("__keeper"))
    # written, so that both sides of the join come from shuffles of their own and AQE may split a key that very many lines share
    shared = written(shared.where(F.col("__n") >= min_docs).select("__h1", "__h2", "__keeper"), "shared-lines")
    gone = lines.join(shared, ["__h1", "__h2"]).where(~F.col("__id").eqNullSafe(F.col("__keeper")))
    gone = gone.groupBy("__id", "__kth").agg(F.collect_set("__pos").alias("__gone"))
    gone = gone.select(F.col("__id").alias(f"{p}id"), F.col("__kth").alias(f"{p}kth"), F.col("__gone").alias(f"{p}gone"))
    both = base.join(gone, F.col(id_col).eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}th") == F.col(f"{p}kth")), "left")
    both = both.withColumn(f"{p}lines", _lines(F.col(f"{p}text")))
    left = F.array_except(F.sequence(F.lit(0), F.size(f"{p}lines") - 1), F.col(f"{p}gone"))
    kept = F.when(F.col(f"{p}gone").isNull(), F.col(f"{p}text")).otherwise(F.array_join(F.transform(left, lambda k: F.get(f"{p}lines", k)), "\n"))
    added = zip(counts or (), (F.size(f"{p}lines"), F.coalesce(F.size(f"{p}gone"), F.lit(0))), strict=False)
    return both.select(*[kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], *[c.cast("long").alias(name) for name, c in added])

"""What the operators share: table access, intermediate tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelake.operators.store import discard, shared_dir, written

__all__ = ["BROADCAST_ROWS", "crc32_mod", "discard", "load", "prefix", "shared_dir", "small", "without", "written"]

#: Tables of ids of at most this many rows (some 16 bytes each) are sent to every executor; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prefix(df: DataFrame) -> str:
    """Underscores with which no column of df starts, for columns that are added meanwhile. Names do not differ by case."""
    out = "__"
    while any(c.startswith(out) for c in df.columns):
        out += "_"
    return out


def small(ids: DataFrame, most: int | None = None) -> DataFrame:
    """A written table of narrow rows, broadcast if it is of at most `most` (BROADCAST_ROWS) rows; else a join with it is a shuffle."""
    return F.broadcast(ids) if ids.count() <= (BROADCAST_ROWS if most is None else most) else ids


def without(df: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """df without the rows whose id is among the ids of gone (one column). Rows with a null id stay.

    The ids are written and counted: up to BROADCAST_ROWS of them go to every executor, and df is not moved.
    """
    name = prefix(df) + "gone"
    ids = gone.select(gone[gone.columns[0]].alias(name)).where(F.col(name).isNotNull()).distinct()
    return df.join(small(written(ids, "gone")), F.col(f"`{id_col}`") == F.col(name), "left_anti")


def crc32_mod(id_col: str, n: int):
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n

"""Type hierarchies over all scanned classes, and overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytelake.operators.graph import transitive
from bytelake.operators.resolve import class_headers, method_headers
from bytelake.operators.store import written
from bytelake.sources.classes import ClassTables

#: Methods of java.lang.Object that need no class path to be known as overridden (fixed values).
OBJECT_METHODS = [("equals", "(Ljava/lang/Object;)Z"), ("hashCode", "()I"), ("toString", "()Ljava/lang/String;"), ("clone", "()Ljava/lang/Object;"), ("finalize", "()V")]


def classpath(*sources: DataFrame) -> DataFrame:
    """Headers (of class_headers) of several sources, the first that has a name wins; within a source, the least archive and path."""
    every = None
    for prio, s in enumerate(sources):
        s = s.withColumn("prio", F.lit(prio))
        every = s if every is None else every.unionByName(s)
    first = F.row_number().over(Window.partitionBy("name").orderBy("prio", "archive", "path", "class_id"))
    return every.withColumn("rn", first).where("rn = 1").drop("rn", "prio")


def supertypes(headers: DataFrame) -> DataFrame:
    """(a, b): names of classes and of their direct supertypes."""
    above = F.array_compact(F.concat(F.array("super_name"), "interfaces"))
    return headers.select(F.col("name").alias("a"), F.explode(above).alias("b")).where("a IS NOT NULL").distinct()


def ancestors(headers: DataFrame) -> DataFrame:
    """(name, ancestor): all supertypes; a class in a cycle is its own ancestor. Ancestors outside the class path are named, but lead no further."""
    return transitive(supertypes(headers)).select(F.col("a").alias("name"), F.col("b").alias("ancestor"))


def overrides(t: ClassTables, also: ClassTables | None = None) -> DataFrame:
    """(class_id, seq, name, descriptor, ancestor): methods that override one of an ancestor on the class path: neither is static, the ancestor's is not private, and constructors never do.
    Of several ancestors, the first by name. also: a class path behind the scanned classes themselves."""
    own, methods = written(class_headers(t), "headers"), method_headers(t)
    headers = written(classpath(own, class_headers(also)), "headers") if also is not None else classpath(own)
    every = methods.unionByName(method_headers(also)) if also is not None else methods
    mine = methods.where((F.col("access").bitwiseAND(0x8) == 0) & ~F.col("name").startswith("<")).join(own.select("class_id", F.col("name").alias("class_name")), "class_id")
    above = every.where(F.col("access").bitwiseAND(0xA) == 0).join(headers.select("class_id", F.col("name").alias("ancestor")), "class_id").select("ancestor", "name", "descriptor").distinct()
    # only ancestors whose methods are known can be overridden, and they are reached through such only: the others' edges are not followed
    known = supertypes(headers).join(headers.select(F.col("name").alias("b")), "b", "left_semi")
    pairs = transitive(known).select(F.col("a").alias("class_name"), F.col("b").alias("ancestor")).where("class_name <> ancestor")
    found = mine.join(pairs, "class_name").join(above, ["ancestor", "name", "descriptor"])
    return found.groupBy("class_id", "seq", "name", "descriptor").agg(F.min("ancestor").alias("ancestor"))


def object_overrides(t: ClassTables) -> DataFrame:
    """(class_id, seq, name, descriptor): methods that override one of java.lang.Object, whose own methods override nothing."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(d).alias("descriptor")) for n, d in OBJECT_METHODS])
    itself = class_headers(t).where("name = 'java.lang.Object'").select("class_id")
    rows = method_headers(t).where(F.col("access").bitwiseAND(0x8) == 0).join(itself, "class_id", "left_anti")
    return rows.where(F.array_contains(pairs, F.struct("name", "descriptor"))).select("class_id", "seq", "name", "descriptor")

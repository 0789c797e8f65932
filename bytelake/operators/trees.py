"""Reconstructed statements and expressions as rows, for analytics over program trees."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytelake.operators.graph import closure
from bytelake.operators.store import written
from bytelake.sources.classes import ClassTables, python_rows

NODES = "class_id string, method int, node int, parent int, role string, ord int, kind string, text string, type string, pc int, block int"
LOCALS = "class_id string, method int, pc int, slot int, name string, type string"


def _per_class(t: ClassTables, rows_of, schema: str) -> DataFrame:
    """rows_of(method row, its result) -> tuples behind class_id and method."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bytelake.recon.method import reconstruct
        from bytelake.recon.view import View

        fields = [(x.split()[0], pa.int32() if x.endswith(" int") else pa.string()) for x in schema.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for row in python_rows(batch):
                if row["status"] != "ok":
                    continue
                view = View(row)
                for m in row["methods"]:
                    if m["code"] is not None and view.by_method["insns"].get(m["seq"]):
                        out += [(row["class_id"], m["seq"], *x) for x in rows_of(reconstruct(view, m))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(zip(*out, strict=True), fields, strict=True)], names=[f[0] for f in fields])

    return t.rows.drop("lines", "frames", "annotations").mapInArrow(part, schema)


def ast_nodes(t: ClassTables) -> DataFrame:
    """(class_id, method, node, parent, role, ord, kind, text, type, pc, block): one row per statement (role `stmt`, or `head` in a for) and expression (`expr`), numbered from 0 within the method in order of the text;
    parent -1 is the method. ord is the place among its siblings; block numbers the blocks of the parent that hold statements (null for others). Methods without a structure have no rows."""

    def rows_of(result) -> list[tuple]:
        if not result.structured:
            return []
        out: list[tuple] = []

        def expr(e, parent, k):
            n = len(out)
            out.append((n, parent, "expr", k, e.kind, e.text or None, e.type, None, None))
            for j, a in enumerate(e.args):
                expr(a, n, j)

        def stmt(s, parent, k, role="stmt", block=0):
            n = len(out)
            out.append((n, parent, role, k, s.kind, s.text or None, s.more if s.kind in ("declare", "foreach") else None, s.pc if s.pc >= 0 else None, block if role == "stmt" else None))
            for j, e in enumerate(s.exprs):
                expr(e, n, j)
            for j, x in enumerate(s.more if s.kind == "for" else []):
                stmt(x, n, j, "head")
            for j, (b, x) in enumerate((b, x) for b, inside in enumerate(s.blocks) for x in inside):
                stmt(x, n, j, block=b)

        for k, s in enumerate(result.block):
            stmt(s, -1, k)
        return out

    return _per_class(t, rows_of, NODES)


def local_types(t: ClassTables) -> DataFrame:
    """(class_id, method, pc, slot, name, type): the variable and its inferred type at every use that the symbolic execution saw, also where no debug tables say so."""
    return _per_class(t, lambda r: sorted(set(r.locals)) if r.structured else [], LOCALS)


def final_local_types(locals_: DataFrame) -> DataFrame:
    """(class_id, method, slot, name, type): the type of each slot at its last use."""
    last = locals_.groupBy("class_id", "method", "slot").agg(F.max_by(F.struct("name", "type"), F.struct("pc", "name")).alias("v"))
    return last.select("class_id", "method", "slot", "v.name", "v.type")


def condition_names(nodes: DataFrame) -> DataFrame:
    """(class_id, method, name): variables that are a condition, or an operand of its logic, by themselves: they are booleans."""
    key = ["class_id", "method"]
    mine = written(nodes.select(*key, "node", "parent", "role", "kind", "text"), "nodes")
    heads = mine.where("role <> 'expr' AND kind IN ('if', 'while', 'dowhile', 'for')").select(*key, F.col("node").alias("parent"))
    tops = mine.where("role = 'expr'").join(heads, [*key, "parent"]).select(*key, "node")
    logic = mine.where("kind IN ('bin', 'not') AND coalesce(text, '!') IN ('&&', '||', '!')").select(*key, F.col("node").alias("parent"))
    edges = mine.join(logic, [*key, "parent"]).select(*key, F.col("parent").alias("a"), F.col("node").alias("b"))
    found = closure(edges, tops, key, key)
    return mine.where("kind = 'var'").join(found, [*key, "node"], "left_semi").select(*key, F.col("text").alias("name")).distinct()


def assignment_counts(nodes: DataFrame) -> DataFrame:
    """(class_id, method, name, n): how often each local variable is set."""
    key = ["class_id", "method"]
    sets = nodes.where("kind IN ('assign', 'postinc')").select(*key, F.col("node").alias("parent"))
    targets = nodes.where("role = 'expr' AND kind = 'var' AND ord = 0").join(sets, [*key, "parent"]).select(*key, F.col("text").alias("name"))
    declared = nodes.where("kind = 'declare'").join(nodes.where("role = 'expr' AND ord = 0").select(*key, F.col("parent").alias("node")).distinct(), [*key, "node"]).select(*key, F.col("text").alias("name"))
    return targets.union(declared).groupBy(*key, "name").agg(F.count("*").alias("n"))


def after_return(nodes: DataFrame) -> DataFrame:
    """Statements that stand behind a return, throw, break or continue of their block: there should be none."""
    w = Window.partitionBy("class_id", "method", "parent", "block").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = nodes.where("role = 'stmt'").withColumn("ended", F.max(F.col("kind").isin("return", "throw", "break", "continue").cast("int")).over(w))
    return rows.where("ended = 1").drop("ended")

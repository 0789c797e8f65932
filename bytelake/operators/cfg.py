"""Control-flow graphs of all methods as tables: blocks, edges, reachability, dominance, loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytelake.sources.classes import ClassTables
from bytelake.sources.opcodes import NO_FALLTHROUGH

KEY = ["class_id", "method"]
_STOPS = sorted(NO_FALLTHROUGH)


def next_offsets(insns: DataFrame) -> DataFrame:
    """Instructions with the pc of the one that follows (null at the end)."""
    return insns.withColumn("next_pc", F.lead("pc").over(Window.partitionBy(*KEY).orderBy("pc")))


def branch_targets(insns: DataFrame) -> DataFrame:
    """(class_id, method, pc, target): explicit targets of branches and switches."""
    every = F.concat(F.array("target"), F.coalesce("targets", F.array().cast("array<int>")), F.array("default"))
    return insns.select(*KEY, "pc", F.explode(F.array_distinct(F.array_compact(every))).alias("target"))


def _is_branch():
    return F.col("target").isNotNull() | F.col("default").isNotNull()


def blocks(t: ClassTables) -> DataFrame:
    """(class_id, method, start_pc, end_pc, last_pc, last_op): basic blocks. A block starts at the entry, at targets and handlers, and behind every branch and every instruction without fall-through. end_pc is behind its last instruction."""
    insns = t.insns.select(*KEY, "pc", "length", "op", "target", "targets", "default")
    follow = next_offsets(insns)
    starts = insns.groupBy(*KEY).agg(F.min("pc").alias("start_pc"))
    behind = follow.where(_is_branch() | F.col("op").isin(_STOPS)).select(*KEY, F.col("next_pc").alias("start_pc")).where("start_pc IS NOT NULL")
    starts = starts.union(behind).union(branch_targets(insns).select(*KEY, F.col("target").alias("start_pc"))).union(t.handlers.select(*KEY, F.col("handler_pc").alias("start_pc"))).distinct()
    marked = insns.join(starts.withColumn("pc", F.col("start_pc")), [*KEY, "pc"], "left")  # targets between instructions start nothing
    w = Window.partitionBy(*KEY).orderBy("pc")
    marked = marked.withColumn("block", F.last("start_pc", ignorenulls=True).over(w))
    return marked.groupBy(*KEY, F.col("block").alias("start_pc")).agg(F.max(F.col("pc") + F.col("length")).alias("end_pc"), F.max("pc").alias("last_pc"), F.max_by("op", "pc").alias("last_op"))


def block_of(t: ClassTables, found: DataFrame) -> DataFrame:
    """(class_id, method, pc, block): the block of every instruction, as of the last start at or before it."""
    rows = t.insns.select(*KEY, "pc").join(found.select(*KEY, F.col("start_pc").alias("pc"), F.col("start_pc")), [*KEY, "pc"], "left")
    return rows.select(*KEY, "pc", F.last("start_pc", ignorenulls=True).over(Window.partitionBy(*KEY).orderBy("pc")).alias("block"))


def block_edges(t: ClassTables, found: DataFrame) -> DataFrame:
    """(class_id, method, a, b, kind): edges from block to block by their start: `branch`, `fall` (into the next block) and `handler` (from every block that a range covers)."""
    insns = t.insns.select(*KEY, "pc", "op", "target", "targets", "default")
    ends = found.select(*KEY, F.col("start_pc").alias("a"), F.col("last_pc").alias("pc"), "last_op", "end_pc")
    starts = found.select(*KEY, F.col("start_pc").alias("b"))
    branch = branch_targets(insns).join(ends, [*KEY, "pc"]).select(*KEY, "a", F.col("target").alias("b"), F.lit("branch").alias("kind"))
    fall = ends.where(~F.col("last_op").isin(_STOPS)).select(*KEY, "a", F.col("end_pc").alias("b"), F.lit("fall").alias("kind"))
    cover = found.join(t.handlers.select(*KEY, F.col("start_pc").alias("s"), F.col("end_pc").alias("e"), "handler_pc"), KEY).where("start_pc < e AND end_pc > s")
    handler = cover.select(*KEY, F.col("start_pc").alias("a"), F.col("handler_pc").alias("b"), F.lit("handler").alias("kind"))
    return branch.union(fall).union(handler).join(starts, [*KEY, "b"], "left_semi").select(*KEY, "a", "b", "kind").distinct()


def _per_method(found: DataFrame, edges: DataFrame, f, schema: str) -> DataFrame:
    """f((class_id, method), edges of one method as (a, b, kind) and its entry) -> rows, for every method.

    A method's graph is small and is needed whole, so one shuffle by method brings it to one place; rounds over all methods at once
    would be as many as the longest path of the longest method.
    """
    entry = found.groupBy(*KEY).agg(F.min("start_pc").alias("b")).select(*KEY, F.lit(-1).alias("a"), "b", F.lit("entry").alias("kind"))
    graph = edges.select(*KEY, "a", "b", "kind").unionByName(entry)
    names = [x.split()[0] for x in schema.split(", ")]

    def one(key, table):
        import pyarrow as pa

        rows = list(zip(*(table.column(c).to_pylist() for c in ("a", "b", "kind")), strict=True))
        start = next((b for a, b, _ in rows if a == -1), None)
        got = f([r for r in rows if r[0] != -1], start) if start is not None else []
        cols = [*([k.as_py()] * len(got) for k in key), *([list(c) for c in zip(*got, strict=True)] or [[] for _ in names[2:]])]
        return pa.table([pa.array(c, t) for c, t in zip(cols, _types(schema), strict=True)], names=names)

    return graph.groupBy(*KEY).applyInArrow(one, schema)


def _types(schema: str) -> list:
    import pyarrow as pa

    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    return [kinds[x.split()[1]] for x in schema.split(", ")]


def _reached(rows: list, start: int) -> set[int]:
    after: dict[int, set[int]] = {}
    for a, b, _ in rows:
        after.setdefault(a, set()).add(b)
    seen, wait = {start}, [start]
    while wait:
        for b in after.get(wait.pop(), ()):
            if b not in seen:
                seen.add(b)
                wait.append(b)
    return seen


def reachable_blocks(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(class_id, method, node): blocks that the entry reaches, over exception edges too."""
    return _per_method(found, edges, lambda rows, start: [(n,) for n in sorted(_reached(rows, start))], "class_id string, method int, node int")


def dead_runs(t: ClassTables, found: DataFrame, live: DataFrame) -> DataFrame:
    """(class_id, method, start_pc, end_pc): runs of instructions that nothing reaches: islands between live ones."""
    of = block_of(t, found).join(t.insns.select(*KEY, "pc", "length"), [*KEY, "pc"])
    rows = of.join(live.select(*KEY, F.col("node").alias("block"), F.lit(True).alias("live")), [*KEY, "block"], "left").withColumn("live", F.coalesce("live", F.lit(False)))
    w = Window.partitionBy(*KEY).orderBy("pc")
    rows = rows.withColumn("starts", (F.col("live") != F.lag("live", 1, None).over(w)).cast("int")).withColumn("run", F.sum(F.coalesce("starts", F.lit(1))).over(w))
    return rows.where(~F.col("live")).groupBy(*KEY, "run").agg(F.min("pc").alias("start_pc"), F.max(F.col("pc") + F.col("length")).alias("end_pc")).drop("run")


def _dominators(edges: list[tuple[int, int]], entry: int) -> dict[int, int | None]:
    """Immediate dominators of the nodes that entry reaches, by the public algorithm of Cooper, Harvey and Kennedy."""
    after: dict[int, list[int]] = {}
    before: dict[int, list[int]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        before.setdefault(b, []).append(a)
    order, seen, stack = [], {entry}, [(entry, iter(sorted(after.get(entry, ()))))]
    while stack:
        node, rest = stack[-1]
        step = next((b for b in rest if b not in seen), None)
        if step is None:
            order.append(node)
            stack.pop()
        else:
            seen.add(step)
            stack.append((step, iter(sorted(after.get(step, ())))))
    rank = {n: k for k, n in enumerate(order)}
    idom: dict[int, int] = {entry: entry}
    changed = True
    while changed:
        changed = False
        for n in reversed(order[:-1]):
            new = None
            for p in before.get(n, ()):
                if p in idom:
                    if new is None:
                        new = p
                        continue
                    x, y = p, new
                    while x != y:
                        while rank[x] < rank[y]:
                            x = idom[x]
                        while rank[y] < rank[x]:
                            y = idom[y]
                    new = x
            if new is not None and idom.get(n) != new:
                idom[n], changed = new, True
    return {n: (None if n == entry else d) for n, d in idom.items()}


def dominators(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(class_id, method, node, idom): immediate dominators, null for the entry; unreachable blocks have no row."""
    return _per_method(found, edges, lambda rows, start: sorted(_dominators([r[:2] for r in rows], start).items()), "class_id string, method int, node int, idom int")


def _loops(rows: list, start: int) -> list[tuple]:
    idom = _dominators([r[:2] for r in rows], start)
    plain = {(a, b) for a, b, kind in rows if kind != "handler" and a in idom}
    before: dict[int, set[int]] = {}
    for a, b in plain:
        before.setdefault(b, set()).add(a)

    def dominates(a: int, b: int | None) -> bool:
        while b is not None and b != a:
            b = idom[b]
        return b == a

    latches: dict[int, set[int]] = {}
    for a, b in plain:
        if dominates(b, a):
            latches.setdefault(b, set()).add(a)
    out = []
    for header, ends in sorted(latches.items()):
        inside, wait = {header}, [n for n in ends if n != header]
        inside |= set(wait)
        while wait:  # backwards from the latches; the header itself is not passed
            for n in before.get(wait.pop(), ()):
                if n not in inside:
                    inside.add(n)
                    wait.append(n)
        leaving = {a for a, b in plain if a in inside and b not in inside}
        kind = "while" if header in leaving and not (len(inside) == 1) else "do-while" if leaving & ends else "endless"
        out.append((header, sorted(ends), sorted(inside), len(inside), kind))
    return out


def _back_edges(rows: list, start: int) -> list[tuple]:
    """By a depth-first search in the order of the code: edges to a block that is still open."""
    idom, after = _dominators([r[:2] for r in rows], start), {}
    for a, b in sorted({(a, b) for a, b, _ in rows}):
        after.setdefault(a, []).append(b)

    def dominates(a: int, b: int | None) -> bool:
        while b is not None and b != a:
            b = idom[b]
        return b == a

    found, seen, open_, stack = [], {start}, {start}, [(start, iter(after.get(start, ())))]
    while stack:
        node, rest = stack[-1]
        b = next(rest, None)
        if b is None:
            open_.discard(node)
            stack.pop()
        elif b in open_:
            found.append((node, b, dominates(b, node)))
        elif b not in seen:
            seen.add(b)
            open_.add(b)
            stack.append((b, iter(after.get(b, ()))))
    return sorted(found)


def back_edges(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(class_id, method, latch, header, natural): edges that close a cycle, exception edges included.

    Where the header dominates the latch (natural), the edge closes one whatever the order of the search. Cycles with several entries have no such edge: they are broken where a depth-first search in the order of the code
    meets a block that is still open, so every cycle has at least one of these edges.
    """
    return _per_method(found, edges, _back_edges, "class_id string, method int, latch int, header int, natural boolean")


def outside_joins(t: ClassTables, arms: DataFrame | None = None) -> DataFrame:
    """(class_id, method, start_pc, end_pc): arms at whose end control arrives from outside: some condition jumps to end_pc from before start_pc or from end_pc on.

    arms (class_id, method, start_pc, end_pc): by default, what each forward condition jumps over.
    """
    jumps = t.insns.where("op LIKE 'if%'").select(*KEY, "pc", "length", "target")
    if arms is None:
        arms = jumps.where("target > pc").select(*KEY, (F.col("pc") + F.col("length")).alias("start_pc"), F.col("target").alias("end_pc"))
    to = jumps.select(*KEY, F.col("target").alias("end_pc"), F.col("pc").alias("__from"))
    joined = arms.join(to, [*KEY, "end_pc"]).where("__from < start_pc OR __from >= end_pc")
    return joined.select(*KEY, "start_pc", "end_pc").distinct()


def loops(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(class_id, method, header, latches, blocks, n_blocks, kind): natural loops, those of one header as one.

    A back edge leads to a block that dominates its start. The loop is the header and all that reaches a latch without passing through the
    header. kind: `while` if the header can leave the loop and is not all of it, `do-while` if a latch can, else `endless`.
    """
    return _per_method(found, edges, _loops, "class_id string, method int, header int, latches array<int>, blocks array<int>, n_blocks int, kind string")

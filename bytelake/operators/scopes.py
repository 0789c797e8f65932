"""Scopes of local variables, types at offsets, source lines, monitors and exception ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytelake.functions import names as N
from bytelake.operators.resolve import _text, class_headers, class_names, method_headers
from bytelake.sources.classes import ClassTables

KEY = ["class_id", "method"]


def local_variables(t: ClassTables) -> DataFrame:
    """(class_id, method, slot, start_pc, length, name, descriptor, signature): declared scopes, with the generic signature where there is one for the very same scope."""
    text = lambda a, b: _text(t.cp, a, b)
    names = t.lvt.join(text("name_idx", "name"), ["class_id", "name_idx"], "left").join(text("type_idx", "descriptor"), ["class_id", "type_idx"], "left").drop("name_idx", "type_idx")
    signatures = t.lvtt.join(text("type_idx", "signature"), ["class_id", "type_idx"]).select(*KEY, "slot", "start_pc", "length", "signature")
    return names.join(signatures, [*KEY, "slot", "start_pc", "length"], "left")


def locals_at(t: ClassTables, uses: DataFrame | None = None) -> DataFrame:
    """(class_id, method, pc, slot, name, type): the variable that each use of a slot means (by default, of all loads, stores and increments).

    A scope holds [start_pc, start_pc + length); a store takes effect behind itself, so it names the scope that starts there.
    Of scopes that overlap, the one declared first by start; a slot without a scope is local<slot>, of no known type. The interval join is within one method and slot.
    """
    if uses is None:
        uses = t.insns.where("var IS NOT NULL").select(*KEY, "pc", F.col("var").alias("slot"), F.when(F.col("op").endswith("store"), F.col("pc") + F.col("length")).otherwise(F.col("pc")).alias("at"))
    scopes = local_variables(t).select(*KEY, "slot", "start_pc", (F.col("start_pc") + F.col("length")).alias("end_pc"), "name", "descriptor")
    inside = uses.join(scopes, [*KEY, "slot"]).where("at >= start_pc AND at < end_pc")
    found = inside.groupBy(*KEY, "pc", "slot").agg(F.min_by(F.struct("name", "descriptor"), F.struct("start_pc", "end_pc", "name")).alias("v"))
    rows = uses.select(*KEY, "pc", "slot").join(found, [*KEY, "pc", "slot"], "left")
    return rows.select(*KEY, "pc", "slot", F.coalesce("v.name", F.concat(F.lit("local"), "slot")).alias("name"), N.field_type(F.col("v.descriptor")).alias("type"))


def frame_offsets(t: ClassTables) -> DataFrame:
    """(class_id, method, seq, pc): offsets of the stack map frames as a running sum: the first lies at its delta, each other one at the last plus its delta plus one."""
    w = Window.partitionBy(*KEY).orderBy("seq")
    return t.frames.select(*KEY, "seq", (F.sum(F.col("delta") + 1).over(w) - 1).cast("int").alias("pc"))


def _entry_locals(t: ClassTables) -> DataFrame:
    """(class_id, method, entry, type): what a method starts with, as a frame would say it: the receiver, then one entry for each parameter."""
    own = class_headers(t).select("class_id", F.col("name").alias("own"))
    rows = method_headers(t).join(own, "class_id").withColumnRenamed("seq", "method")
    receiver = F.when(F.col("access").bitwiseAND(0x8) != 0, F.array().cast("array<string>")).when((F.col("name") == "<init>") & (F.col("own") != "java.lang.Object"), F.array(F.lit("uninitializedThis"))).otherwise(F.array("own"))
    small = F.array(*[F.lit(x) for x in ("boolean", "byte", "char", "short")])
    depth = lambda x: F.length(F.regexp_extract(x, r"((\[\])*)$", 1)) / 2
    codes = F.create_map(*[F.lit(x) for k, v in N.PRIMITIVES.items() for x in (v, k)])
    base = lambda x: F.regexp_replace(x, r"(\[\])+$", "")
    array = lambda x: F.concat(F.repeat(F.lit("["), depth(x).cast("int")), F.coalesce(F.try_element_at(codes, base(x)), F.concat(F.lit("L"), base(x), F.lit(";"))))
    one = lambda x: F.when(F.array_contains(small, x), F.lit("int")).when(x.endswith("[]"), array(x)).otherwise(x)
    return rows.select(*KEY, F.posexplode(F.concat(receiver, F.transform(N.parameter_types(F.col("descriptor")), one))).alias("entry", "type"))


def frame_locals(t: ClassTables) -> DataFrame:
    """(class_id, method, seq, entry, type): all locals that each stack map frame leaves in force, object types by name: a frame drops the last ones, adds some or names all anew.

    The number of entries in force is a running sum from the last frame that names all; of an entry, the type is that of the last frame up to here that named it. A long or double is one entry.
    """
    start = _entry_locals(t).join(t.frames.select(*KEY).distinct(), KEY, "left_semi")
    first = t.frames.select(*KEY).distinct().join(start.groupBy(*KEY).agg(F.count("*").cast("int").alias("n")), KEY, "left").select(*KEY, F.lit(-1).alias("seq"), F.lit("full").alias("kind"), F.coalesce("n", F.lit(0)).alias("change"))
    change = F.when(F.col("kind") == "chop", -F.col("chop")).otherwise(F.size("locals"))
    steps = first.unionByName(t.frames.select(*KEY, "seq", "kind", change.alias("change")))
    order = Window.partitionBy(*KEY).orderBy("seq")
    steps = steps.withColumn("since", F.sum((F.col("kind") == "full").cast("int")).over(order))
    steps = steps.withColumn("n", F.sum("change").over(Window.partitionBy(*KEY, "since").orderBy("seq")).cast("int"))
    own = t.frames.select(*KEY, "seq", F.posexplode("locals").alias("k", "v")).select(*KEY, "seq", "k", "v.type", F.col("v.cp").alias("idx"))
    own = own.join(class_names(t), ["class_id", "idx"], "left").select(*KEY, "seq", "k", F.coalesce("name", "type").alias("named"))
    own = own.join(steps.select(*KEY, "seq", "n", F.col("change")), [*KEY, "seq"]).select(*KEY, "seq", (F.col("n") - F.col("change") + F.col("k")).alias("entry"), "named")
    own = own.unionByName(start.select(*KEY, F.lit(-1).alias("seq"), "entry", F.col("type").alias("named")))
    rows = steps.where("n > 0").select(*KEY, "seq", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("entry")).join(own, [*KEY, "seq", "entry"], "left")
    rows = rows.withColumn("type", F.last("named", ignorenulls=True).over(Window.partitionBy(*KEY, "entry").orderBy("seq")))
    return rows.where("seq >= 0").select(*KEY, "seq", "entry", "type")


def receiver_guesses(t: ClassTables) -> DataFrame:
    """(class_id, method, name): for every method with code, the local that a store without a known receiver is given to: the first declared one, by slot, that is neither `this` nor a made-up var_*; else `this`, or null in a static method."""
    named = local_variables(t).where(~F.col("name").startswith("var_") & (F.col("name") != "this"))
    first = named.groupBy(*KEY).agg(F.min_by("name", F.struct("slot", "start_pc", "name")).alias("first"))
    rows = t.methods.where("code IS NOT NULL").select("class_id", F.col("seq").alias("method"), "access").join(first, KEY, "left")
    return rows.select(*KEY, F.coalesce("first", F.when(F.col("access").bitwiseAND(0x8) == 0, F.lit("this"))).alias("name"))


def lines_of(t: ClassTables) -> DataFrame:
    """(class_id, method, pc, line): the source line of every instruction, as of the last table entry at or before it."""
    first = t.lines.groupBy(*KEY, "pc").agg(F.min("line").alias("line"))
    rows = t.insns.select(*KEY, "pc").join(first, [*KEY, "pc"], "left")
    return rows.select(*KEY, "pc", F.last("line", ignorenulls=True).over(Window.partitionBy(*KEY).orderBy("pc")).alias("line"))


def exception_ranges(t: ClassTables) -> DataFrame:
    """(class_id, method, start_pc, end_pc, handler_pc, types, seq): ranges of one handler as one, with their types as a sorted alternative; a catch-all is `any`."""
    named = t.handlers.join(class_names(t).select("class_id", F.col("idx").alias("catch_idx"), "name"), ["class_id", "catch_idx"], "left")
    kind = F.when(F.col("catch_idx") == 0, "any").otherwise(F.coalesce("name", F.concat(F.lit("class#"), "catch_idx")))
    return named.groupBy(*KEY, "start_pc", "end_pc", "handler_pc").agg(F.array_join(F.array_sort(F.collect_set(kind)), " | ").alias("types"), F.min("seq").alias("seq"))


def nested_ranges(ranges: DataFrame) -> DataFrame:
    """(class_id, method, outer_seq, inner_seq): exception ranges that lie strictly inside others of the method."""
    inner = ranges.select(*KEY, F.col("start_pc").alias("s"), F.col("end_pc").alias("e"), F.col("seq").alias("inner_seq"))
    held = ranges.join(inner, KEY).where("start_pc <= s AND e <= end_pc AND (start_pc < s OR e < end_pc)")
    return held.select(*KEY, F.col("seq").alias("outer_seq"), "inner_seq")


def monitor_depth(t: ClassTables) -> DataFrame:
    """(class_id, method, pc, op, depth): enters and exits of monitors with the depth behind each, in the order of the code."""
    step = F.when(F.col("op") == "monitorenter", 1).otherwise(-1)
    rows = t.insns.where("op IN ('monitorenter', 'monitorexit')").select(*KEY, "pc", "op")
    return rows.withColumn("depth", F.sum(step).over(Window.partitionBy(*KEY).orderBy("pc")))


def switch_arms(t: ClassTables) -> DataFrame:
    """(class_id, method, pc, target, labels, is_default): labels that lead to one target, sorted."""
    rows = t.insns.where("default IS NOT NULL")
    cases = rows.select(*KEY, "pc", "default", F.explode(F.arrays_zip("keys", "targets")).alias("z")).select(*KEY, "pc", "default", F.col("z.keys").alias("label"), F.col("z.targets").alias("target"))
    cases = cases.groupBy(*KEY, "pc", "target").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    ends = rows.select(*KEY, "pc", F.col("default").alias("target"), F.lit(True).alias("is_default"))
    return cases.join(ends, [*KEY, "pc", "target"], "full").select(*KEY, "pc", "target", F.coalesce("labels", F.array().cast("array<int>")).alias("labels"), F.coalesce("is_default", F.lit(False)).alias("is_default"))


def backward_jumps(t: ClassTables) -> DataFrame:
    """(class_id, method, pc, target, op): jumps to an earlier place or to themselves."""
    return t.insns.where("target <= pc").select(*KEY, "pc", "target", "op")


def diagnostics_summary(t: ClassTables) -> DataFrame:
    """(class_id, severity, message, first_offset, suppressed): the first of equal messages of a class, and how many others it stands for."""
    return t.diagnostics.groupBy("class_id", "severity", "message").agg(F.min_by("offset", "seq").alias("first_offset"), (F.count("*") - 1).alias("suppressed"))


def scan_summary(t: ClassTables) -> DataFrame:
    """(archive, n_classes, n_failed, n_errors, n_bytes): one row per archive."""
    notes = t.diagnostics.where("severity IN ('error', 'fatal')").groupBy("class_id").agg(F.count("*").alias("errors"))
    rows = t.classes.join(notes, "class_id", "left")
    return rows.groupBy("archive").agg(F.count("*").alias("n_classes"), F.count_if(F.col("status") != "ok").alias("n_failed"), F.coalesce(F.sum("errors"), F.lit(0)).alias("n_errors"), F.sum("n_bytes").alias("n_bytes"))

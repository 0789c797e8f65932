"""Queries over compiled code: two archives that ship with PySpark, scanned once a session. They ignore sf_dir.

Rows are keyed by the class file's path in its archive, and indexes into the pool are given as what they stand for, so that they can be held against a disassembler's listing: see expected.py.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelake.functions import names as N
from bytelake.operators import cfg, hierarchy, resolve, scopes, sources, trees
from bytelake.operators.store import written
from bytelake.recon.source import FIELD_FLAGS, METHOD_FLAGS
from bytelake.sources import classes as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ARCHIVES = ("gson-2.11.0.jar", "commons-cli-1.10.0.jar")
_SCANS: dict[tuple[str, str], C.ClassTables] = {}
_GRAPHS: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def _jar_folders(spark: SparkSession | None):
    """Where Spark's own jars may lie, the likeliest first: where the session's JVM runs from, where SPARK_HOME points, beside PySpark (which may be imported from a zip, beside which there are none)."""
    if spark is not None:
        source = spark._jvm.java.lang.Class.forName("org.apache.spark.SparkContext").getProtectionDomain().getCodeSource()
        if source is not None:
            yield os.path.dirname(source.getLocation().getPath())
    if home := os.environ.get("SPARK_HOME"):
        yield os.path.join(home, "jars")
    import pyspark

    at = os.path.dirname(os.path.abspath(pyspark.__file__))
    yield os.path.join(at, "jars")
    yield os.path.join(os.path.abspath(os.path.join(at, *[os.pardir] * 4)), "jars")  # beside python/lib/pyspark.zip/pyspark


def jars_folder(spark: SparkSession | None = None) -> str:
    """The folder of Spark's own jars, or FileNotFoundError where none of the likely ones holds the archives."""
    tried = []
    for folder in _jar_folders(spark):
        if all(os.path.exists(os.path.join(folder, name)) for name in ARCHIVES):
            return folder
        tried.append(folder)
    raise FileNotFoundError(f"none of {tried} holds {' and '.join(ARCHIVES)}")


def sample_archive(spark: SparkSession | None = None) -> str:
    return os.path.join(jars_folder(spark), ARCHIVES[0])


def sample_archives(spark: SparkSession) -> list[str]:
    return [os.path.join(jars_folder(spark), name) for name in ARCHIVES]


def tables(spark: SparkSession) -> C.ClassTables:
    key = (spark.sparkContext.applicationId, "sample")
    if key not in _SCANS:
        _SCANS[key] = C.ClassTables.scan(spark, sample_archives(spark))
    return _SCANS[key]


def graphs(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Blocks and edges of all methods."""
    key = (spark.sparkContext.applicationId, "sample")
    if key not in _GRAPHS:
        t = tables(spark)
        blocks = written(cfg.blocks(t), "cfg-blocks")
        _GRAPHS[key] = blocks, written(cfg.block_edges(t, blocks), "cfg-edges")
    return _GRAPHS[key]


def _at(t: C.ClassTables, df: DataFrame) -> DataFrame:
    """df with the path in place of class_id."""
    return df.join(t.classes.select("class_id", "path"), "class_id").drop("class_id", "archive")


def _named(t: C.ClassTables, df: DataFrame, idx: str, name: str) -> DataFrame:
    """df with a class name in place of an index of the pool; 0 leads nowhere."""
    return df.join(resolve.class_names(t).withColumnsRenamed({"idx": idx, "name": name}), ["class_id", idx], "left").drop(idx)


def _list(name: str) -> Column:
    return F.array_join(F.transform(name, lambda x: x.cast("string")), ",").alias(name)


def _query(name: str, f: Callable[[C.ClassTables], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: _at(tables(spark), f(tables(spark)))


def _graph_query(name: str, f: Callable[[C.ClassTables, DataFrame, DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: _at(tables(spark), f(tables(spark), *graphs(spark)))


def bc_s4_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the archives, and whether their content has the checksum that the directory says."""
    rows = C.archive_entries(C.files(spark, sample_archives(spark)))
    return rows.select(F.regexp_extract("archive", "[^/]*$", 0).alias("archive"), "path", "status", "crc32", "packed_size", F.octet_length("content").alias("size"), (F.crc32("content") == F.col("crc32")).alias("crc_ok"))


def bc_s11_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry of an archive by its name."""
    return C.find_entry(spark, sample_archive(spark), "com/google/gson/Gson.class").select("path", "status", F.octet_length("content").alias("size"), F.crc32("content").alias("crc"))


def _methods(t: C.ClassTables) -> DataFrame:
    names = resolve.class_names(t).withColumnRenamed("name", "thrown")
    thrown = t.methods.select("class_id", "seq", F.posexplode("throws").alias("k", "idx")).join(names, ["class_id", "idx"])
    thrown = thrown.groupBy("class_id", "seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "thrown"))), lambda x: x["thrown"]), ",").alias("throws"))
    rows = resolve.members(t).join(t.methods.select("class_id", "seq", "max_stack", "max_locals", F.octet_length("code").alias("code_bytes")), ["class_id", "seq"]).join(thrown, ["class_id", "seq"], "left")
    return rows.withColumn("throws", F.coalesce("throws", F.lit("")))


def _scopes(t: C.ClassTables, table: str, kind: str) -> DataFrame:
    rows = getattr(t, table)
    text = lambda a, b: resolve._text(t.cp, a, b)
    return rows.join(text("name_idx", "name"), ["class_id", "name_idx"]).join(text("type_idx", kind), ["class_id", "type_idx"]).drop("name_idx", "type_idx")


def _handlers(t: C.ClassTables) -> DataFrame:
    return _named(t, t.handlers, "catch_idx", "type").withColumn("type", F.coalesce("type", F.lit("any")))


QUERIES["bc_s4_entries"] = bc_s4_entries
QUERIES["bc_s11_lookup"] = bc_s11_lookup
_query("bc_s15_classes", lambda t: t.classes.select("class_id", "status", "n_bytes", "minor", "major", "access", "this_idx", "super_idx", "deprecated"))
# the listing that these are held against leaves blanks at the end of a string out
_query("bc_s16_cp", lambda t: t.cp.where("status = 'present'").select("class_id", "idx", "kind", F.rtrim("utf8").alias("utf8"), "integer", "real", "ref1", "ref2", "handle"))
_query("bc_s16_diagnostics", lambda t: t.diagnostics)
_query("bc_s17_interfaces", lambda t: _named(t, t.interfaces, "cp", "name"))
_query("bc_s17_fields", lambda t: resolve.members(t, "fields").join(t.fields.select("class_id", "seq", F.col("const_idx").isNotNull().alias("has_const")), ["class_id", "seq"]))
_query("bc_s17_methods", _methods)
_query("bc_s18_handlers", _handlers)
_query("bc_s19_lines", lambda t: t.lines)
_query("bc_s19_lvt", lambda t: _scopes(t, "lvt", "descriptor"))
_query("bc_s19_lvtt", lambda t: _scopes(t, "lvtt", "signature"))
_query("bc_s20_frames", lambda t: t.frames.select("class_id", "method", "seq", "kind", "delta", "chop", F.size("locals").alias("n_locals"), F.size("stack").alias("n_stack")))
_query("bc_s21_annotations", lambda t: t.annotations.drop("value"))
_query("bc_s22_inner", lambda t: t.inner.drop("access"))
_query("bc_s22_bootstrap", lambda t: t.bootstrap.select("class_id", "seq", "method_idx", _list("args")))
_query("bc_s24_insns", lambda t: t.insns.select("class_id", "method", "pc", "length", "op", "var", "value", "cp", "target", "dims"))
_query("bc_s25_headers", lambda t: resolve.class_headers(t).withColumn("interfaces", _list("interfaces")).drop("path"))
_query("bc_j1_references", resolve.references)
_query("bc_j1_constants", lambda t: resolve.constants(t).where("kind IN ('Class', 'String', 'Integer', 'Long')").withColumn("text", F.rtrim("text")))
_query("bc_j4_calls", lambda t: resolve.calls(t).withColumn("parameter_types", _list("parameter_types")))
_query("bc_j5_local_variables", scopes.local_variables)
_query("bc_j6_locals_at", scopes.locals_at)
_query("bc_j12_nested_ranges", lambda t: scopes.nested_ranges(scopes.exception_ranges(t)))
_query("bc_j13_outside_joins", cfg.outside_joins)
_query("bc_j14_lambdas", resolve.lambdas)
_query("bc_j16_overrides", hierarchy.overrides)
_query("bc_j17_enum_constants", resolve.enum_constants)
_query("bc_j19_receivers", scopes.receiver_guesses)
_query("bc_f3_object_overrides", hierarchy.object_overrides)
_query("bc_a1_switch_arms", lambda t: scopes.switch_arms(t).withColumn("labels", _list("labels")))
_query("bc_a2_exception_ranges", scopes.exception_ranges)
_query("bc_a3_unique_returns", resolve.unique_return_types)
_query("bc_a4_diagnostics", scopes.diagnostics_summary)
QUERIES["bc_a5_scan_summary"] = lambda spark, sf_dir: scopes.scan_summary(tables(spark)).withColumn("archive", F.regexp_extract("archive", "[^/]*$", 0))
_query("bc_a6_imports", resolve.imports)
_query("bc_w1_frame_offsets", scopes.frame_offsets)
_query("bc_w2_frame_locals", scopes.frame_locals)
_query("bc_w3_next_offsets", lambda t: cfg.next_offsets(t.insns.select("class_id", "method", "pc")))
_query("bc_w5_lines_of", scopes.lines_of)
_query("bc_w8_monitor_depth", scopes.monitor_depth)
_query("bc_w10_backward_jumps", scopes.backward_jumps)
_graph_query("bc_g1_blocks", lambda t, blocks, edges: blocks)
_graph_query("bc_g1_edges", lambda t, blocks, edges: edges)
_graph_query("bc_w5_block_of", lambda t, blocks, edges: cfg.block_of(t, blocks))
_graph_query("bc_g2_reachable", lambda t, blocks, edges: cfg.reachable_blocks(blocks, edges))
_graph_query("bc_g3_dominators", lambda t, blocks, edges: cfg.dominators(blocks, edges))
_graph_query("bc_g3_back_edges", lambda t, blocks, edges: cfg.back_edges(blocks, edges))
_graph_query("bc_g4_loops", lambda t, blocks, edges: cfg.loops(blocks, edges).withColumns({"latches": _list("latches"), "blocks": _list("blocks")}))
_graph_query("bc_w7_dead_runs", lambda t, blocks, edges: cfg.dead_runs(t, blocks, cfg.reachable_blocks(blocks, edges)))
QUERIES["bc_g5_ancestors"] = lambda spark, sf_dir: hierarchy.ancestors(hierarchy.classpath(resolve.class_headers(tables(spark))))
def bc_s10_class_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class files of all archives, as they are read for decoding."""
    return C.class_bytes(spark, sample_archives(spark)).select(F.regexp_extract("archive", "[^/]*$", 0).alias("archive"), "path", F.octet_length("content").alias("size"), F.crc32("content").alias("crc"))


def _flagged(t: C.ClassTables) -> DataFrame:
    """Modifier words of fields and methods."""
    fields = resolve.members(t, "fields").select("class_id", F.lit("field").alias("kind"), "seq", N.flags(F.col("access"), FIELD_FLAGS).alias("words"))
    return fields.unionByName(resolve.members(t).select("class_id", F.lit("method").alias("kind"), "seq", N.flags(F.col("access"), METHOD_FLAGS).alias("words")))


QUERIES["bc_s10_class_bytes"] = bc_s10_class_bytes
QUERIES["bc_s13_classpath"] = lambda spark, sf_dir: hierarchy.classpath(resolve.class_headers(tables(spark)), resolve.class_headers(tables(spark)).where("name LIKE 'org.%'")).select("name", "path")
_query("bc_p4_names", lambda t: resolve.class_headers(t).select("class_id", "name", N.package_of(F.col("name")).alias("package"), N.short_name(F.col("name")).alias("short"), N.short_annotation_name(F.col("name")).alias("last")))
_query("bc_p5_flags", _flagged)
_query("bc_f1_visible_methods", lambda t: resolve.visible_members(t).select("class_id", "seq", "name", "descriptor"))
_query("bc_f1_visible_fields", lambda t: resolve.visible_members(t, "fields").select("class_id", "seq", "name", "descriptor"))
_query("bc_f2_enums", lambda t: resolve.enums(t).select("class_id", "name"))
_query("bc_f5_enum_synthetics", resolve.enum_synthetics)
_query("bc_x2_short_types", lambda t: resolve.members(t, "fields").select("class_id", "seq", N.short_type(N.field_type(F.col("descriptor"))).alias("type")))
_query("bc_x3_descriptors", lambda t: resolve.members(t).select("class_id", "seq", N.is_method_descriptor(F.col("descriptor")).alias("ok"), N.return_type(F.col("descriptor")).alias("type"), F.array_join(N.parameter_types(F.col("descriptor")), ",").alias("parameters")))
_query("bc_x9_readable_names", lambda t: scopes.local_variables(t).select("class_id", "method", "slot", "start_pc", N.readable_name(F.col("name")).alias("name")))
QUERIES["bc_a10_unique_paths"] = lambda spark, sf_dir: sources.unique_paths(sources.sources(tables(spark))).select("path", "class_name")
# SQL can express none of the following; the tests hold them against the compiler and against debug tables
QUERIES["bc_t5_sources"] = lambda spark, sf_dir: sources.sources_with_overrides(tables(spark)).drop("class_id", "archive")
QUERIES["bc_j15_merged_sources"] = lambda spark, sf_dir: sources.merge_inner(tables(spark), sources.sources(tables(spark))).drop("class_id", "archive")
QUERIES["bc_k4_zip"] = lambda spark, sf_dir: sources.zip_archives(sources.sources(tables(spark))).select(F.regexp_extract("archive", "[^/]*$", 0).alias("archive"), F.octet_length("content").alias("n_bytes"), F.crc32("content").alias("crc"))
_query("bc_m1_ast_nodes", trees.ast_nodes)
_query("bc_w9_after_return", lambda t: trees.after_return(trees.ast_nodes(t)))
_query("bc_w12_local_types", trees.local_types)
_query("bc_a8_final_types", lambda t: trees.final_local_types(trees.local_types(t)))
_query("bc_a9_assignment_counts", lambda t: trees.assignment_counts(trees.ast_nodes(t)))
_query("bc_a11_condition_names", lambda t: trees.condition_names(trees.ast_nodes(t)))

"""Java source of all scanned classes as a table, and sinks for it."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytelake.functions.names import rename_type
from bytelake.operators.hierarchy import overrides
from bytelake.operators.resolve import class_names
from bytelake.operators.store import discard, written
from bytelake.sources import zips
from bytelake.sources.classes import ClassTables, python_rows

SOURCES = "class_id string, archive string, path string, class_name string, text string, n_methods int, n_unstructured int, error string"


def sources(t: ClassTables, marked: DataFrame | None = None) -> DataFrame:
    """One row per class: its source. path is that of the source file. A class on which reconstruction fails has a stub and the error; the job goes on.

    marked (class_id, seq): methods to mark as overriding. Classes are worked through independently, so the work spreads over all cores however few archives there are.
    """
    rows = t.rows
    if marked is not None:
        rows = rows.join(marked.groupBy("class_id").agg(F.collect_set("seq").alias("__overrides")), "class_id", "left")
    else:
        rows = rows.withColumn("__overrides", F.lit(None).cast("array<int>"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bytelake.recon.source import NOTE, class_source

        schema = pa.schema([(x.split()[0], pa.int32() if x.endswith(" int") else pa.string()) for x in SOURCES.split(", ")])
        for batch in batches:
            out = []
            for row in python_rows(batch):
                path = row["path"].removesuffix(".class") + ".java"
                base = {"class_id": row["class_id"], "archive": row["archive"], "path": path}
                try:
                    s = class_source(row, frozenset(row["__overrides"] or ()))
                    out.append(base | {"class_name": s.class_name, "text": s.text, "n_methods": s.methods, "n_unstructured": s.unstructured, "error": None})
                except Exception as e:  # one odd class must not end the job: it is reported in its row
                    simple = posixpath.basename(path).removesuffix(".java")
                    out.append(base | {"class_name": simple, "text": f"{NOTE}\n// Reconstruction failed: {type(e).__name__}: {e}\nclass {simple} {{\n}}\n", "n_methods": 0, "n_unstructured": 0, "error": f"{type(e).__name__}: {e}"})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return rows.drop("lines", "frames").mapInArrow(part, SOURCES)


_IMPORT = r"(?m)^import [^\n]*;$"
_HEAD = r"(?s)^(.*?\n)\n(?:import [^\n]*\n)*\n?"


def merge_inner(t: ClassTables, found: DataFrame) -> DataFrame:
    """Sources of top-level classes, each with the classes nested in it inside; anonymous and local ones stay files of their own.

    A class's own table of nested classes names all that enclose it, so its outermost one is found without a look at others. Nesting may be deep: a text is placed into its outermost class, in the order of
    names, and what it imports is imported there.
    """
    names = class_names(t)
    inner = t.inner.where("outer_idx <> 0 AND name_idx <> 0")
    inner = inner.join(names.select("class_id", F.col("idx").alias("inner_idx"), F.col("name").alias("inner_name")), ["class_id", "inner_idx"])
    inner = inner.join(names.select("class_id", F.col("idx").alias("outer_idx"), F.col("name").alias("outer_name")), ["class_id", "outer_idx"])
    up = inner.groupBy("class_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("inner_name", "outer_name")))).alias("up"))
    own = t.classes.select("class_id", F.col("this_idx").alias("idx")).join(names, ["class_id", "idx"]).select("class_id", F.col("name").alias("inner_name"))
    top = F.aggregate(F.map_keys("up"), F.col("inner_name"), lambda at, _: F.coalesce(F.try_element_at("up", at), at))
    member = own.join(up, "class_id").where(F.map_contains_key("up", F.col("inner_name"))).select("class_id", "inner_name", top.alias("top"))
    imports = lambda text: F.regexp_extract_all(text, F.lit(_IMPORT), F.lit(0))
    body = F.regexp_replace(F.regexp_replace("text", _HEAD, ""), r"(?m)^(?=.)", "    ")
    texts = found.join(member, "class_id").select("archive", F.col("top").alias("class_name"), "inner_name", body.alias("body"), imports(F.col("text")).alias("imports"))
    texts = texts.groupBy("archive", "class_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("inner_name", "body"))), lambda x: x["body"]), "\n").alias("inside"), F.array_distinct(F.flatten(F.collect_list("imports"))).alias("theirs")
    )
    kept = found.join(member.select("class_id"), "class_id", "left_anti").join(texts, ["archive", "class_name"], "left")
    every = F.array_sort(F.array_union(imports(F.col("text")), F.col("theirs")))
    head = F.concat(F.regexp_extract("text", _HEAD, 1), F.lit("\n"), F.when(F.size(every) > 0, F.concat(F.array_join(every, "\n"), F.lit("\n\n"))).otherwise(F.lit("")))
    whole = F.concat(head, F.regexp_replace(F.regexp_replace("text", _HEAD, ""), r"\}\s*$", ""), F.lit("\n"), "inside", F.lit("}\n"))
    return kept.select(*[F.when(F.col("inside").isNull(), F.col("text")).otherwise(whole).alias(c) if c == "text" else F.col(c) for c in found.columns])


def unique_paths(found: DataFrame, within: tuple[str, ...] = ("archive",)) -> DataFrame:
    """Paths that differ by case only would overwrite each other on some file systems: the first of them stays, the others get _n, the next number that is free, and their text the new type name.

    within: columns whose values are places of their own (none: all paths lie in one tree).
    """
    key = [*within, "__lower"]
    rows = found.withColumn("__lower", F.lower("path")).withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("path", "class_id")))
    # numbers that other paths have taken of a stem
    clash = rows.where("__n = 2").select(*within, F.col("__lower").alias("__stem"))
    taken = rows.where("__n = 1").select(*within, F.regexp_replace("__lower", r"_([0-9]{1,9})\.java$", ".java").alias("__stem"), F.regexp_extract("__lower", r"_(0|[1-9][0-9]{0,8})\.java$", 1).alias("__taken")).where("__taken <> ''")
    taken = taken.join(clash, [*within, "__stem"], "left_semi").groupBy(*within, F.col("__stem").alias("__lower")).agg(F.sort_array(F.collect_set(F.col("__taken").cast("int"))).alias("__taken"))
    rows = rows.join(taken, key, "left").withColumn("__old", F.regexp_extract("path", r"([^/]*)\.java$", 1))
    free = F.aggregate(F.coalesce("__taken", F.array().cast("array<int>")), F.col("__n") - 2, lambda k, t: F.when(t <= k, k + 1).otherwise(k))
    rows = rows.withColumn("__new", F.concat("__old", F.lit("_"), free.cast("string")))
    path = F.concat(F.regexp_extract("path", r"^(.*/)?[^/]*$", 1), "__new", F.lit(".java"))
    moved = {"path": path, "text": rename_type(F.col("text"), F.col("__old"), F.col("__new"))}
    return rows.select(*[F.when(F.col("__n") == 1, F.col(c)).otherwise(moved[c]).alias(c) if c in moved else F.col(c) for c in found.columns])


def targets(found: DataFrame) -> DataFrame:
    """found with its path as that of one tree: relative to the folder that holds all that was scanned, and below a folder named after its archive if there are several files."""
    place = F.when(F.col("archive") == "", F.col("path")).otherwise(F.col("archive"))
    # what the first and the last in order have in common, all have
    ends = found.agg(F.min(place).alias("lo"), F.max(place).alias("hi")).first()
    lo, hi = ends.lo or "", ends.hi or ""
    common = posixpath.commonprefix([lo, hi])
    common = common[: common.rfind("/") + 1]
    inside = F.substring(place, len(common) + 1, 1 << 30)
    folder = F.concat(F.regexp_replace(inside, r"\.(jar|zip)$", ""), F.lit("/")) if lo != hi else F.lit("")
    return found.withColumn("path", F.when(F.col("archive") == "", inside).otherwise(F.concat(folder, F.col("path"))))


def zip_archives(found: DataFrame) -> DataFrame:
    """(archive, content): per scanned archive, a zip of its sources, stored, as one value: of less than 2 GB. write_zip() has no such bound."""

    def one(key, table):
        files = sorted(zip(table.column("path").to_pylist(), table.column("text").to_pylist(), strict=True))
        return pa.table({"archive": pa.array([key[0].as_py()], pa.string()), "content": pa.array([zips.stored([(p, x.encode()) for p, x in files])], pa.binary())})

    return found.select("archive", "path", "text").groupBy("archive").applyInArrow(one, "archive string, content binary")


def _output(found: DataFrame) -> DataFrame:
    """(path, text) of one tree, each path once and without a way out of it."""
    safe = (F.col("path") != "") & ~F.col("path").startswith("/") & ~F.col("path").contains(":") & ~F.array_contains(F.split("path", "/"), "..")
    return unique_paths(targets(found).where(safe), ()).select("path", "text")


def write_tree(found: DataFrame, folder: str) -> int:
    """Write every source to its path below a folder that all executors share (or a local one in local mode); returns the number of files. Paths are those of targets(), made unique; unsafe ones are left out.

    A file is written beside its place and then moved there, so a task that is run again leaves whole files.
    """
    import os

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = os.path.join(folder, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(f"{target}.{os.getpid()}.part", "w", encoding="utf-8", newline="\n") as f:
                    f.write(text)
                os.replace(f"{target}.{os.getpid()}.part", target)
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["path"])

    os.makedirs(folder, exist_ok=True)
    return _output(found).mapInArrow(part, "path string").distinct().count()


def write_zip(found: DataFrame, target: str) -> int:
    """Write all sources as one stored zip to a path that all executors can write beside; returns the number of files. Of any size: 64-bit records are used where they are needed.

    Tasks write the records of their files, in the order of paths, beside the target; the driver then appends these parts to each other and the directory to them, and holds neither as a whole.
    """
    import os
    import shutil
    import zlib

    parts = f"{target}.parts"
    shutil.rmtree(parts, ignore_errors=True)
    os.makedirs(parts)
    rows = written(_output(found), "zip-sources")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, at = TaskContext.get().partitionId(), 0
        where = os.path.join(parts, f"{task:08d}")
        with open(f"{where}.{TaskContext.get().taskAttemptId()}", "wb") as f:
            for batch in batches:
                out = []
                for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    raw, data = path.encode(), text.encode()
                    head = zips.local_header(raw, len(data), crc := zlib.crc32(data))
                    f.write(head + data)
                    out.append((task, at, path, len(data), crc))
                    at += len(head) + len(data)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)] if out else [pa.array([], k) for k in (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64())], names=["task", "at", "path", "size", "crc"])
        os.replace(f.name, where)

    listing = written(rows.sort("path").mapInArrow(part, "task int, at long, path string, size long, crc long"), "zip-listing")
    starts, n, size = {}, 0, 0
    with open(f"{target}.part", "wb") as f:
        for name in sorted(x for x in os.listdir(parts) if "." not in x):
            starts[int(name)] = f.tell()
            with open(os.path.join(parts, name), "rb") as g:
                shutil.copyfileobj(g, f, 1 << 20)
        begin = f.tell()
        for r in listing.sort("task", "at").toLocalIterator():
            size += f.write(zips.directory_entry(r.path.encode(), r.size, r.crc, starts[r.task] + r.at))
            n += 1
        f.write(zips.directory_end(n, size, begin))
    os.replace(f"{target}.part", target)
    shutil.rmtree(parts)
    discard(rows, listing)
    return n


def sources_with_overrides(t: ClassTables, also: ClassTables | None = None) -> DataFrame:
    """sources(), with the methods marked that override one of the scanned classes or of a class path."""
    return sources(t, overrides(t, also).select("class_id", "seq"))

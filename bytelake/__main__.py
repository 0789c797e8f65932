"""python -m bytelake INPUT [-o PATH] [-p PATH]...: Java source of a class file, an archive or a folder."""

from __future__ import annotations

import argparse
import os
import sys

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bytelake", description="Reconstruct Java source from class files and archives.")
    p.add_argument("input", help="a .class file, a .jar or .zip archive, or a folder of them")
    p.add_argument("-o", "--output", help="a file for one class; a folder, or a .zip or .jar file, for an archive (default: <input>_decompiled)")
    p.add_argument("-p", "--classpath", action="append", default=[], help="folders and archives, separated as paths are here, in which overridden methods are looked up; may be given again")
    p.add_argument("-m", "--merge", action="store_true", help="put nested classes into the source of their outer class")
    p.add_argument("-V", "--version", action="version", version=VERSION)
    return p


def default_output(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[0] + "_decompiled"


def readable(spark, path: str) -> bool:
    """Whether a path of any file system that Spark reads is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    remote = "://" in args.input
    if not remote and not os.access(args.input, os.R_OK):
        print(f"bytelake: cannot read {args.input}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from bytelake.operators import scopes, sources
    from bytelake.sources.classes import ClassTables

    spark = SparkSession.getActiveSession() or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    if remote and not readable(spark, args.input):
        print(f"bytelake: cannot read {args.input}", file=sys.stderr)
        return 2
    place = lambda p: p if "://" in p else os.path.abspath(p)
    paths = []
    for p in [x for given in args.classpath for x in (given.split(os.pathsep) if "://" not in given else [given]) if x]:
        if readable(spark, place(p)):
            paths.append(p)
        else:
            print(f"bytelake: no class path at {p}", file=sys.stderr)
    t = ClassTables.scan(spark, place(args.input))
    found = sources.sources_with_overrides(t, ClassTables.scan(spark, [place(p) for p in paths]) if paths else None)
    if args.merge:
        found = sources.merge_inner(t, found)
    if args.input.endswith(".class"):
        row = found.first()
        if args.output:
            with open(args.output, "w", encoding="utf-8") as f:
                f.write(row.text)
            return 0
        print(row.text)
        for d in scopes.diagnostics_summary(t).orderBy("first_offset").collect():
            print(f"{d.severity} at {d.first_offset}: {d.message}" + (f" (and {d.suppressed} more)" if d.suppressed else ""), file=sys.stderr)
        return 0
    output = args.output or default_output(os.path.basename(args.input.rstrip("/")) if remote else args.input)
    write = sources.write_zip if output.endswith((".zip", ".jar")) else sources.write_tree
    print(f"{write(found, os.path.abspath(output))} files in {output}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Scans of class files and archives as Spark tables.

A class is decoded once, to one row with an array for each table; the tables are explodes of these arrays,
and Parquet's nested column pruning reads only the arrays that a query needs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelake.operators.store import written
from bytelake.sources import zips
from bytelake.sources.classfile import decode

_I, _L, _S, _B = pa.int32(), pa.int64(), pa.string(), pa.bool_()
_TYPE = pa.list_(pa.struct([("type", _S), ("cp", _I), ("pc", _I)]))
TABLES: dict[str, list[tuple[str, pa.DataType]]] = {
    "cp": [("idx", _I), ("tag", _I), ("kind", _S), ("status", _S), ("reason", _S), ("utf8", _S), ("integer", _L), ("bits", _L), ("real", pa.float64()), ("ref1", _I), ("ref2", _I), ("handle", _I)],
    "interfaces": [("seq", _I), ("cp", _I)],
    "fields": [("seq", _I), ("access", _I), ("name_idx", _I), ("desc_idx", _I), ("sig_idx", _I), ("const_idx", _I), ("deprecated", _B)],
    "methods": [("seq", _I), ("access", _I), ("name_idx", _I), ("desc_idx", _I), ("sig_idx", _I), ("deprecated", _B), ("throws", pa.list_(_I)), ("max_stack", _I), ("max_locals", _I), ("code", pa.binary())],
    "insns": [("method", _I), ("pc", _I), ("length", _I), ("opcode", _I), ("op", _S), ("var", _I), ("value", _I), ("cp", _I), ("target", _I), ("dims", _I), ("keys", pa.list_(_I)), ("targets", pa.list_(_I)), ("default", _I)],
    "handlers": [("method", _I), ("seq", _I), ("start_pc", _I), ("end_pc", _I), ("handler_pc", _I), ("catch_idx", _I)],
    "lines": [("method", _I), ("pc", _I), ("line", _I)],
    "lvt": [("method", _I), ("slot", _I), ("start_pc", _I), ("length", _I), ("name_idx", _I), ("type_idx", _I)],
    "lvtt": [("method", _I), ("slot", _I), ("start_pc", _I), ("length", _I), ("name_idx", _I), ("type_idx", _I)],
    "frames": [("method", _I), ("seq", _I), ("kind", _S), ("delta", _I), ("pc", _I), ("chop", _I), ("locals", _TYPE), ("stack", _TYPE)],
    "inner": [("inner_idx", _I), ("outer_idx", _I), ("name_idx", _I), ("access", _I)],
    "bootstrap": [("seq", _I), ("method_idx", _I), ("args", pa.list_(_I))],
    "annotations": [("owner", _S), ("owner_seq", _I), ("visible", _B), ("seq", _I), ("type", _S), ("value", _S)],
    "diagnostics": [("seq", _I), ("severity", _S), ("offset", _I), ("message", _S)],
}
ROOT = [("class_id", _S), ("archive", _S), ("path", _S), ("status", _S), ("n_bytes", _L), ("minor", _I), ("major", _I), ("access", _I), ("this_idx", _I), ("super_idx", _I), ("sig_idx", _I), ("source_idx", _I), ("deprecated", _B)]
DECODED = pa.schema(ROOT + [(name, pa.list_(pa.struct(columns))) for name, columns in TABLES.items()])
ENTRIES = pa.schema([("archive", _S), ("path", _S), ("status", _S), ("crc32", _L), ("packed_size", _L), ("offset", _L), ("content", pa.binary())])


TASK_BYTES = 2_000_000


def _spark_schema(schema: pa.Schema):
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)


def files(spark: SparkSession, paths: str | list[str], glob: str = "*") -> DataFrame:
    """Files under paths whose name fits the pattern: (path, content). Directories are searched through; one file is one row, so of at most 2 GB. Other files are not opened."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(paths).select("path", "content")


def archive_entries(found: DataFrame) -> DataFrame:
    """Entries of the archives (*.jar, *.zip) among files, in the columns of ENTRIES; those that cannot be unpacked have no content and a status that says why."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for e in zips.entries(content.as_py()):
                    rows.append({"archive": path.as_py(), "path": e.name, "status": e.status, "crc32": e.crc32, "packed_size": e.packed_size, "offset": e.offset, "content": e.data})
                    size += len(e.data or b"")
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, ENTRIES)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ENTRIES)

    return found.where(F.col("path").endswith(".jar") | F.col("path").endswith(".zip")).select("path", "content").mapInArrow(part, _spark_schema(ENTRIES))


def find_entry(spark: SparkSession, archive: str, path: str) -> DataFrame:
    """The first entry of that name in an archive, in the columns of ENTRIES; no row where there is none. No other entry is unpacked."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                for e in zips.entries(content.as_py(), only=path.replace("\\", "/")):
                    row = {"archive": name.as_py(), "path": e.name, "status": e.status, "crc32": e.crc32, "packed_size": e.packed_size, "offset": e.offset, "content": e.data}
                    yield pa.RecordBatch.from_pylist([row], ENTRIES)
                    break

    return files(spark, archive).mapInArrow(part, _spark_schema(ENTRIES))


def class_bytes(spark: SparkSession, paths: str | list[str], partitions: int | None = None) -> DataFrame:
    """Class files under paths, in archives or plain: (archive, path, content). Module and package descriptions are left out.

    Archives differ in size by orders of magnitude, so their entries are dealt out anew before the costly decoding.
    """
    inside = archive_entries(files(spark, paths, "*.{jar,zip}")).where("status = 'ok' AND path LIKE '%.class'").select("archive", "path", "content")
    plain = files(spark, paths, "*.class").select(F.lit("").alias("archive"), "path", "content")
    rows = inside.unionByName(plain).where(~F.col("path").rlike(r"(module|package)-info\.class$"))
    return rows.repartition(partitions, "archive", "path") if partitions else rows.repartition("archive", "path")


def decoded(classes: DataFrame) -> DataFrame:
    """One row per class (archive, path, content), in the columns of DECODED. class_id is a hash of the content and where it lies."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for archive, path, content in zip(*(batch.column(k) for k in range(3)), strict=True):
                data, archive, path = content.as_py() or b"", archive.as_py(), path.as_py()
                found = decode(data)
                key = hashlib.sha256(data + b"\0" + f"{archive}!{path}".encode()).hexdigest()
                rows.append({"class_id": key, "archive": archive, "path": path, "n_bytes": len(data), "deprecated": False} | found.root | found.tables)
                size += len(data)
                if size > 1_000_000:
                    yield pa.RecordBatch.from_pylist(rows, DECODED)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, DECODED)

    return classes.select("archive", "path", "content").mapInArrow(part, _spark_schema(DECODED))


def _plain(array: pa.Array) -> list:
    """Python values of an array, by the fast way for its type."""
    if pa.types.is_nested(array.type):
        return array.to_pylist()
    if pa.types.is_boolean(array.type) or array.null_count == 0 and not pa.types.is_floating(array.type):
        return array.to_numpy(zero_copy_only=False).tolist() if array.null_count == 0 else array.to_pylist()
    return array.to_pandas(integer_object_nulls=True).tolist() if not pa.types.is_floating(array.type) else array.to_pylist()


def python_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of the decoded table as Python values, its arrays as lists of dicts. Columns are converted whole, which is many times faster than value by value; tables that the batch leaves out are empty."""
    names = batch.schema.names
    flat: dict[str, list] = {}
    spans: dict[str, tuple[list[int], list[dict]]] = {}
    for name, column in zip(names, batch.columns, strict=True):
        if name in TABLES:
            offsets = column.offsets.to_pylist()
            inside = column.values
            fields = [f.name for f in inside.type]
            values = [_plain(inside.field(k)) for k in range(len(fields))]
            spans[name] = offsets, [dict(zip(fields, row, strict=True)) for row in zip(*values, strict=True)]
        else:
            flat[name] = _plain(column)
    for k in range(batch.num_rows):
        row = {name: values[k] for name, values in flat.items()}
        for name in TABLES:
            offsets, values = spans.get(name, ([0] * (batch.num_rows + 1), []))
            row[name] = values[offsets[k] : offsets[k + 1]]
        yield row


class ClassTables:
    """The tables of decoded classes. Each is a DataFrame keyed by class_id (and method, for those of code)."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    @classmethod
    def scan(cls, spark: SparkSession, paths: str | list[str]) -> ClassTables:
        """Decode everything under paths once, to a table in the shared folder.

        Decoding and what follows cost some seconds a megabyte, so partitions are made for the work and not for the bytes: of some TASK_BYTES of files each, and at least one for each core.
        """
        size = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        return cls(written(decoded(class_bytes(spark, paths, max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))), "classes"))

    def __getattr__(self, name: str) -> DataFrame:
        if name == "classes":
            return self.rows.select(*[c for c, _ in ROOT])
        if name not in TABLES:
            raise AttributeError(name)
        return self.rows.select("class_id", F.inline(name))

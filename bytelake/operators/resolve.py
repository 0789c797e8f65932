"""The constant pool dereferenced: every reference with the names it stands for.

A class's pool lies in the class's row, at the places of its indexes. So what an index stands for is looked up there, and nothing is joined or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelake.functions import names as N
from bytelake.sources.classes import ClassTables


def _text(cp: DataFrame, as_idx: str, as_text: str) -> DataFrame:
    return cp.where("kind = 'Utf8' AND status = 'present'").select("class_id", F.col("idx").alias(as_idx), F.col("utf8").alias(as_text))


def utf8_at(idx: Column) -> Column:
    """The text at an index of the row's pool, or null."""
    entry = F.get("cp", idx)
    return F.when((entry["kind"] == "Utf8") & (entry["status"] == "present"), entry["utf8"])


def class_at(idx: Column) -> Column:
    """The dotted name of the Class entry at an index, class#idx where it leads nowhere, or null where there is no such entry."""
    entry = F.get("cp", idx)
    return F.when(entry["kind"] == "Class", F.coalesce(N.dotted(utf8_at(entry["ref1"])), F.concat(F.lit("class#"), idx.cast("string"))))


def class_names(t: ClassTables) -> DataFrame:
    """(class_id, idx, name): Class entries with their dotted names."""
    classes = F.filter("cp", lambda e: e["kind"] == "Class")
    return t.rows.select("class_id", F.inline(F.transform(classes, lambda e: F.struct(e["idx"].alias("idx"), F.coalesce(N.dotted(utf8_at(e["ref1"])), F.concat(F.lit("class#"), e["idx"].cast("string"))).alias("name")))))


def _pair(idx: Column, part: str) -> Column:
    """The name (ref1) or descriptor (ref2) of the NameAndType entry at an index, or null."""
    entry = F.get("cp", idx)
    return F.when(entry["kind"] == "NameAndType", utf8_at(entry[part]))


def name_and_types(t: ClassTables) -> DataFrame:
    """(class_id, idx, name, descriptor): NameAndType entries."""
    pairs = F.filter("cp", lambda e: e["kind"] == "NameAndType")
    return t.rows.select("class_id", F.inline(F.transform(pairs, lambda e: F.struct(e["idx"].alias("idx"), utf8_at(e["ref1"]).alias("name"), utf8_at(e["ref2"]).alias("descriptor")))))


def references(t: ClassTables) -> DataFrame:
    """(class_id, idx, kind, owner, bootstrap, name, descriptor): field and method references, and dynamic call sites (whose owner is null).

    A reference that leads nowhere keeps its row, with the name field#idx or method#idx.
    """
    found = F.filter("cp", lambda e: e["kind"].isin("Fieldref", "Methodref", "InterfaceMethodref", "InvokeDynamic", "Dynamic"))

    def one(e: Column) -> Column:
        dynamic = e["kind"].isin("InvokeDynamic", "Dynamic")
        placeholder = F.concat(F.when(e["kind"] == "Fieldref", "field#").otherwise("method#"), e["idx"].cast("string"))
        return F.struct(
            e["idx"].alias("idx"),
            e["kind"].alias("kind"),
            F.when(~dynamic, class_at(e["ref1"])).alias("owner"),
            F.when(dynamic, e["ref1"]).alias("bootstrap"),
            F.coalesce(_pair(e["ref2"], "ref1"), placeholder).alias("name"),
            _pair(e["ref2"], "ref2").alias("descriptor"),
        )

    return t.rows.select("class_id", F.inline(F.transform(found, one)))


def constants(t: ClassTables) -> DataFrame:
    """(class_id, idx, kind, text): loadable constants as Java source writes their values; strings unescaped."""
    strings = t.cp.where("kind = 'String'").select("class_id", "idx", "kind", F.col("ref1").alias("text_idx")).join(_text(t.cp, "text_idx", "text"), ["class_id", "text_idx"], "left")
    strings = strings.select("class_id", "idx", "kind", F.coalesce("text", F.concat(F.lit("ldc#"), "idx")).alias("text"))
    classes = class_names(t).select("class_id", "idx", F.lit("Class").alias("kind"), F.concat("name", F.lit(".class")).alias("text"))
    real = F.when(F.isnan("real"), "NaN").when(F.col("real") == float("inf"), "POSITIVE_INFINITY").when(F.col("real") == float("-inf"), "NEGATIVE_INFINITY")
    box = F.when(F.col("kind") == "Float", "Float.").otherwise("Double.")
    plain = F.when(F.col("kind") == "Float", F.concat(F.col("real").cast("float").cast("string"), F.lit("f"))).otherwise(F.col("real").cast("string"))
    number = F.when(F.col("kind") == "Long", F.concat(F.col("integer").cast("string"), F.lit("L"))).when(F.col("kind") == "Integer", F.col("integer").cast("string"))
    numbers = t.cp.where("kind IN ('Integer', 'Long', 'Float', 'Double')").select("class_id", "idx", "kind", F.coalesce(number, F.concat(box, real), plain).alias("text"))
    return strings.unionByName(classes).unionByName(numbers)


def class_headers(t: ClassTables) -> DataFrame:
    """(class_id, archive, path, name, super_name, access, interfaces): one row per class that could be read. Interfaces that do not resolve are left out."""
    faces = F.array_compact(F.transform(F.array_sort("interfaces", lambda a, b: a["seq"] - b["seq"]), lambda x: class_at(x["cp"])))
    return t.rows.where("status = 'ok'").select("class_id", "archive", "path", class_at(F.col("this_idx")).alias("name"), class_at(F.col("super_idx")).alias("super_name"), "access", faces.alias("interfaces"))


def members(t: ClassTables, kind: str = "methods") -> DataFrame:
    """(class_id, seq, access, name, descriptor, signature, deprecated): fields or methods with their names; unresolvable ones as field#seq or method#seq."""

    def one(m: Column) -> Column:
        name = F.coalesce(utf8_at(m["name_idx"]), F.concat(F.lit(f"{kind[:-1]}#"), m["seq"].cast("string")))
        return F.struct(m["seq"].alias("seq"), m["access"].alias("access"), name.alias("name"), utf8_at(m["desc_idx"]).alias("descriptor"), utf8_at(m["sig_idx"]).alias("signature"), m["deprecated"].alias("deprecated"))

    return t.rows.select("class_id", F.inline(F.transform(kind, one)))


def method_headers(t: ClassTables) -> DataFrame:
    """(class_id, seq, name, descriptor, access): headers without bodies."""
    return members(t).select("class_id", "seq", "name", "descriptor", "access")


def calls(t: ClassTables) -> DataFrame:
    """(class_id, method, pc, op, owner, name, descriptor, return_type, parameter_types): every call and field access of the code."""
    uses = t.insns.where("op IN ('getstatic', 'putstatic', 'getfield', 'putfield', 'invokevirtual', 'invokespecial', 'invokestatic', 'invokeinterface', 'invokedynamic')").select("class_id", "method", "pc", "op", F.col("cp").alias("idx"))
    rows = uses.join(references(t), ["class_id", "idx"], "left")
    is_method = F.col("descriptor").startswith("(")
    return rows.select(
        "class_id",
        "method",
        "pc",
        "op",
        "owner",
        F.coalesce("name", F.concat(F.when(F.col("op").startswith("invoke"), "method#").otherwise("field#"), "idx")).alias("name"),
        "descriptor",
        F.when(is_method, N.return_type(F.col("descriptor"))).otherwise(N.field_type(F.col("descriptor"))).alias("type"),
        F.when(is_method, N.parameter_types(F.col("descriptor"))).alias("parameter_types"),
    )


def unique_return_types(t: ClassTables) -> DataFrame:
    """(class_id, owner, name, type): methods whose references in a class all give one return type."""
    methods = references(t).where("kind IN ('Methodref', 'InterfaceMethodref') AND descriptor IS NOT NULL").withColumn("type", N.return_type(F.col("descriptor")))
    grouped = methods.groupBy("class_id", "owner", "name").agg(F.min("type").alias("type"), F.max("type").alias("last"))
    return grouped.where("type = last").drop("last")


def lambdas(t: ClassTables) -> DataFrame:
    """(class_id, method, pc, interface_method, functional_type, handle_kind, impl_owner, impl_name, impl_descriptor, body_seq): dynamic call sites that make a lambda or method reference, and the
    method of the same class that is its body, if it is one."""
    sites = t.insns.where("op = 'invokedynamic'").select("class_id", "method", "pc", F.col("cp").alias("idx")).join(references(t), ["class_id", "idx"])
    boot = t.bootstrap.select("class_id", F.col("seq").alias("bootstrap"), "method_idx", "args")
    handles = t.cp.where("kind = 'MethodHandle'").select("class_id", F.col("idx").alias("handle_idx"), F.col("handle").alias("handle_kind"), F.col("ref1").alias("ref_idx"))
    handles = handles.join(references(t).select("class_id", F.col("idx").alias("ref_idx"), F.col("owner").alias("handle_owner"), F.col("name").alias("handle_name"), F.col("descriptor").alias("handle_descriptor")), ["class_id", "ref_idx"], "left")
    rows = sites.join(boot, ["class_id", "bootstrap"]).join(handles.withColumnRenamed("handle_idx", "method_idx").select("class_id", "method_idx", "handle_owner"), ["class_id", "method_idx"])
    rows = rows.where("handle_owner = 'java.lang.invoke.LambdaMetafactory'").select("class_id", "method", "pc", F.col("name").alias("interface_method"), N.return_type(F.col("descriptor")).alias("functional_type"), F.get("args", F.lit(1)).alias("handle_idx"))
    rows = rows.join(handles, ["class_id", "handle_idx"], "left")
    bodies = method_headers(t).select("class_id", F.col("seq").alias("body_seq"), F.col("name").alias("handle_name"), F.col("descriptor").alias("handle_descriptor"))
    own = class_headers(t).select("class_id", F.col("name").alias("handle_owner"))
    bodies = bodies.join(own, "class_id")
    rows = rows.join(bodies, ["class_id", "handle_owner", "handle_name", "handle_descriptor"], "left")
    return rows.select(
        "class_id", "method", "pc", "interface_method", "functional_type", "handle_kind", F.col("handle_owner").alias("impl_owner"), F.col("handle_name").alias("impl_name"), F.col("handle_descriptor").alias("impl_descriptor"), "body_seq"
    )


def enum_constants(t: ClassTables) -> DataFrame:
    """(class_id, ordinal, name): constants of enums, in the order in which the static initializer stores them."""
    headers = class_headers(t).where(F.substring_index("super_name", "<", 1) == "java.lang.Enum").select("class_id", F.col("name").alias("own"))
    init = method_headers(t).where("name = '<clinit>'").select("class_id", F.col("seq").alias("method"))
    stores = calls(t).where("op = 'putstatic'").join(init, ["class_id", "method"]).join(headers, "class_id")
    stores = stores.where(F.expr("owner = own AND type = own")).groupBy("class_id", "name").agg(F.min("pc").alias("pc"))
    from pyspark.sql import Window

    return stores.select("class_id", (F.row_number().over(Window.partitionBy("class_id").orderBy("pc")) - 1).alias("ordinal"), "name")


def imports(t: ClassTables) -> DataFrame:
    """(class_id, name): classes that source of this class has to import: those its pool and annotations name, but arrays, itself, java.lang and classes without a package."""
    pool = class_names(t).select("class_id", "name")
    types = t.annotations.where("type LIKE 'L%;'").select("class_id", N.field_type(F.col("type")).alias("name"))
    own = class_headers(t).select("class_id", F.col("name").alias("own"))
    found = pool.unionByName(types).join(own, "class_id")
    found = found.where(F.expr("name <> own AND NOT startswith(name, '[') AND NOT startswith(name, 'java.lang.') AND contains(name, '.') AND NOT startswith(name, 'class#')"))
    package = N.package_of(F.col("own"))
    return found.where((N.package_of(F.col("name")) != package) & ~F.col("name").contains("$")).select("class_id", "name").distinct()


def visible_members(t: ClassTables, kind: str = "methods") -> DataFrame:
    """members() without those that no source wrote: synthetic ones and, of methods, bridges."""
    return members(t, kind).where(F.col("access").bitwiseAND(0x1040 if kind == "methods" else 0x1000) == 0)


def enums(t: ClassTables) -> DataFrame:
    """Headers of the enums: classes with the flag whose superclass is java.lang.Enum. Constants with a body are classes of their own, below their enum, and not enums."""
    return class_headers(t).where((F.col("access").bitwiseAND(0x4000) != 0) & (F.col("super_name") == "java.lang.Enum"))


def enum_synthetics(t: ClassTables) -> DataFrame:
    """(class_id, seq, name, descriptor): the methods that every enum gets from the compiler: values() and valueOf(String)."""
    own = enums(t).select("class_id", F.concat(F.lit("L"), F.translate("name", ".", "/"), F.lit(";")).alias("own"))
    rows = method_headers(t).join(own, "class_id")
    wanted = ((F.col("name") == "values") & (F.col("descriptor") == F.concat(F.lit("()["), "own"))) | ((F.col("name") == "valueOf") & (F.col("descriptor") == F.concat(F.lit("(Ljava/lang/String;)"), "own")))
    return rows.where(wanted).select("class_id", "seq", "name", "descriptor")

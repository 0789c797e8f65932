"""Scalar functions on names, descriptors and types, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of the primitive types in descriptors (fixed values of the class file format).
PRIMITIVES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}
DESCRIPTOR = r"\[*(?:[BCDFIJSZV]|L[^;]+;)"


def short_name(c: Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(c, ".", -1)


def short_annotation_name(c: Column) -> Column:
    """What follows the last dot or dollar sign."""
    return F.regexp_extract(c, r"([^.$]*)$", 1)


def short_type(c: Column) -> Column:
    """A type with every qualified name in it shortened, generic arguments included."""
    return F.regexp_replace(c, r"(?U)[\w.$]*\.", "")


def package_of(c: Column) -> Column:
    return F.when(F.instr(c, ".") > 0, F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)).otherwise(F.lit(""))


def dotted(c: Column) -> Column:
    """An internal name with dots."""
    return F.translate(c, "/", ".")


def field_type(c: Column) -> Column:
    """The type that a field descriptor names, or null where it is malformed."""
    depth = F.length(F.regexp_extract(c, r"^(\[*)", 1))
    base = F.substring(c, depth + 1, F.length(c))
    names = F.create_map(*[F.lit(x) for kv in PRIMITIVES.items() for x in kv])
    name = F.when(F.length(base) == 1, F.element_at(names, base)).when(base.rlike("^L[^;]+;$"), dotted(F.regexp_extract(base, "^L([^;]+);$", 1)))
    return F.concat(name, F.repeat(F.lit("[]"), depth))


def parameter_types(c: Column) -> Column:
    """Types of a method descriptor's parameters."""
    inside = F.regexp_extract(c, r"^\(([^)]*)\)", 1)
    return F.transform(F.regexp_extract_all(inside, F.lit(f"({DESCRIPTOR})"), 1), field_type)


def return_type(c: Column) -> Column:
    return field_type(F.substring_index(c, ")", -1))


def is_method_descriptor(c: Column) -> Column:
    return c.rlike(rf"^\((?:\[*(?:[BCDFIJSZ]|L[^;]+;))*\){DESCRIPTOR}$")


def readable_name(c: Column) -> Column:
    """A readable name for one that says nothing: one byte, up to two small letters, or no letter at all."""
    letters = F.regexp_replace(c, "[^A-Za-z]", "")
    return (
        F.when(F.octet_length(c) == 1, F.concat(F.lit("var_"), c))
        .when(c.rlike(r"^[a-z]{0,2}$"), F.concat(F.lit("local_"), c))
        .when(letters == "", F.concat(F.lit("field_"), c))
        .otherwise(c)
    )


def lattice_merge(c: Column, unknown: str = "Unknown") -> Column:
    """Aggregate: the one value that all known values are, else Unknown."""
    known = F.when(c != unknown, c)
    return F.when(F.min(known) == F.max(known), F.min(known)).otherwise(F.lit("Unknown"))


def rename_word(text: Column, old: str, new: str) -> Column:
    """Every whole occurrence of an identifier; a dollar sign is part of a name, as are the letters and digits of all scripts."""
    import re

    return F.regexp_replace(text, rf"(?U)(?<![\w$]){re.escape(old)}(?![\w$])", new.replace("$", r"\$"))


def flags(c: Column, names: dict[int, str]) -> Column:
    """Modifier words of the bits that are set, in the order of names."""
    return F.array_join(F.filter(F.array(*[F.when(c.bitwiseAND(bit) != 0, F.lit(word)) for bit, word in names.items()]), lambda x: x.isNotNull()), " ")


#: Pieces of Java source: strings, characters and comments, and what lies between them.
_PIECES = r'(?s)"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|//[^\n]*|/\*.*?\*/|[^"\'/]+|/|"|\''


def rename_type(text: Column, old: Column, new: Column) -> Column:
    """Java source with one of its types renamed: its declaration and constructors, and its uses as a type. Members and variables that are called the same stay, as do strings and comments."""
    name = F.concat(F.lit(r"(?U)(?<![\w$.])\Q"), old, F.lit(r"\E(?![\w$])"))
    to = F.regexp_replace(new, r"\$", r"\\\$")
    places = [
        (r"(?<=\b(?:class|interface|enum|extends|implements|throws|new|instanceof|catch \()\s{1,3})", ""),  # after a word that a type follows
        (r"(?<=\bcatch \()", ""),
        (r"(?<=[<,&|] ?)", r"(?=\s*[<>,&|\[{])"),  # in a list of types
        (r"(?<=\()", r"(?=(?:\[\])*\)\s*[\w$(!~\"\'])"),  # a cast
        ("", r"(?=(?:\[\])+|\.class\b|::|\.this\b)"),
        ("", r"(?=(?:<[^;=(){}]*>)?(?:\[\])*(?:\.\.\.)?\s+(?!instanceof\b)[A-Za-z_$])"),  # before the name of what is declared
        (r"(?m)(?<=^\s{0,64}(?:(?:public|protected|private)\s)?)", r"(?=\([^;{}]*\)\s*(?:throws [^;{}]*)?\{)"),  # a constructor
    ]

    def code(piece: Column) -> Column:
        for before, after in places:
            piece = F.regexp_replace(piece, F.concat(F.lit(before), name, F.lit(after)), to)
        return piece

    plain = lambda x: F.when(x.rlike(r'^["\']|^//|^/\*'), x).otherwise(code(x))
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), plain), "")

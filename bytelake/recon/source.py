"""The text of a class: header, imports, fields, enum constants, methods, initializers."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from bytelake.functions.signatures import Malformed, bound, class_type, erased, field_type, field_types
from bytelake.recon.expr import E, coerce, escape, member_dots, render, short
from bytelake.recon.method import Result, reconstruct
from bytelake.recon.stmt import S, lines
from bytelake.recon.view import View

NOTE = "// Reconstructed from compiled code."
#: Modifier words by bit, in the customary order (fixed values of the format).
CLASS_FLAGS = {0x1: "public", 0x400: "abstract", 0x10: "final", 0x800: "strictfp"}
FIELD_FLAGS = {0x1: "public", 0x4: "protected", 0x2: "private", 0x8: "static", 0x10: "final", 0x80: "transient", 0x40: "volatile"}
METHOD_FLAGS = {0x1: "public", 0x4: "protected", 0x2: "private", 0x400: "abstract", 0x8: "static", 0x10: "final", 0x20: "synchronized", 0x100: "native", 0x800: "strictfp"}
OBJECT_METHODS = {("equals", "(Ljava/lang/Object;)Z"), ("hashCode", "()I"), ("toString", "()Ljava/lang/String;"), ("clone", "()Ljava/lang/Object;"), ("finalize", "()V")}


@dataclass
class Source:
    class_name: str
    text: str
    methods: int
    unstructured: int


def words(access: int, names: dict[int, str]) -> str:
    return "".join(w + " " for bit, w in names.items() if access & bit)


def annotation(value: dict) -> str:
    """Name(key=value, ...), without its at sign."""
    try:
        name = re.split(r"[.$]", field_type(value["type"] or ""))[-1]
    except Malformed:
        name = "Unknown"
    pairs = [f"{k}={annotation_value(v)}" for k, v in value["values"]]
    if len(pairs) == 1 and value["values"][0][0] == "value":
        pairs = [annotation_value(value["values"][0][1])]
    return name + (f"({', '.join(pairs)})" if pairs else "")


def annotation_value(v: dict) -> str:
    tag, x = v["tag"], v["value"]
    if tag == "s":
        return f'"{escape(x or "")}"'
    if tag == "e":
        try:
            return f"{short(field_type(v['type'] or ''))}.{x}"
        except Malformed:
            return str(x)
    if tag == "c":
        try:
            return f"{short(field_type(x or ''))}.class"
        except Malformed:
            return "Object.class"
    if tag == "@":
        return "@" + annotation(x)
    if tag == "[":
        return "{" + ", ".join(annotation_value(y) for y in x) + "}"
    if tag == "Z":
        return "true" if x else "false"
    if tag == "C":
        return render(coerce(E("const", text=str(x), type="int"), "char"))
    return f"{x}{ {'J': 'L', 'F': 'f'}.get(tag, '') }"


def _annotations(view: View, owner: str, seq: int, deprecated: bool, override: bool = False) -> list[str]:
    out = [f"@{annotation(json.loads(a['value']))}" for a in view.annotations(owner, seq)]
    for want, word in ((deprecated, "@Deprecated"), (override, "@Override")):
        if want and not any(x.split("(")[0] == word for x in out):
            out.append(word)
    return out


def _method(view: View, row: dict, result: Result | None, override: bool, simple: str) -> list[str]:
    name = view.utf8(row["name_idx"]) or f"method#{row['seq']}"
    try:
        t = view.types(row)
    except Malformed:
        return [f"// method {name} has a malformed descriptor", ""]
    out = _annotations(view, "method", row["seq"], row["deprecated"], override)
    access, interface = row["access"], bool(view.access & 0x200)
    if interface:
        access &= ~0x401
    names = [n for _, n in result.parameters] if result else [f"arg{k}" for k in range(len(t.parameters))]
    skip = 0
    if name == "<init>" and view.access & 0x4000 and len(t.parameters) >= 2 and len(names) >= 2:
        skip = 2 if not row["sig_idx"] or len(t.parameters) == len(names) else 0
    kinds = list(t.parameters)
    shown_kinds = [short(k) for k in kinds]
    if access & 0x80 and kinds and kinds[-1].endswith("[]"):
        shown_kinds[-1] = shown_kinds[-1][:-2] + "..."
    shown = ", ".join(f"{k} {n}" for k, n in list(zip(shown_kinds, names, strict=False))[skip:])
    variables = f"<{', '.join(short(v) for v in t.variables)}> " if t.variables else ""
    throws = [short(x) for x in (t.throws or [view.class_name(i) for i in row["throws"] or []])]
    head = words(access & ~0xC0, METHOD_FLAGS)
    if interface and row["code"] is not None and not access & 0xA:
        head = "default " + head
    head += variables + (simple if name == "<init>" else f"{short(t.result)} {name}") + f"({shown})" + (f" throws {', '.join(throws)}" if throws else "")
    if result is None:
        return [*out, f"{head};", ""]
    return [*out, f"{head} {{", *lines(result.block, 1), "}", ""]


def _field(view: View, row: dict, initial: E | None) -> list[str]:
    name = view.utf8(row["name_idx"]) or f"field#{row['seq']}"
    try:
        kind = bound(field_types(view.utf8(row["desc_idx"]) or "Ljava/lang/Object;", view.utf8(row["sig_idx"])), view.variables)
    except Malformed:
        kind = "java.lang.Object"
    value = initial
    if value is None and row["const_idx"] and row["access"] & 0x8:
        value = view.constant(row["const_idx"])
    text = f"{words(row['access'] & ~0x1 if view.access & 0x200 else row['access'], FIELD_FLAGS)}{short(kind)} {name}"
    return [*_annotations(view, "field", row["seq"], row["deprecated"]), text + (f" = {render(coerce(value, erased(kind)), 1)}" if value is not None else "") + ";"]


def _initializers(view: View, result: Result, constants: set[str]) -> tuple[dict[str, E], list[S]]:
    """Of the static initializer, the stores that lead it are initial values of fields; the rest stays as it is. Stores of enum constants are neither."""
    values: dict[str, E] = {}
    rest: list[S] = []
    own = {view.utf8(f["name_idx"]) for f in view.row["fields"] if f["access"] & 8}
    for s in result.block:
        if s.kind == "assign" and s.exprs[0].kind == "static" and s.exprs[0].more is None and s.exprs[0].text in own:
            name = s.exprs[0].text
            if name in constants or name == "$VALUES":
                values[name] = s.exprs[1]
                continue
            if not rest and name not in values and not any(e.kind == "var" for e in s.exprs[1].walk()):
                values[name] = s.exprs[1]
                continue
        rest.append(s)
    return values, rest


def class_source(row: dict, overrides: frozenset[int] = frozenset()) -> Source:
    """row: of the decoded table; overrides: numbers of the methods that override one of another class. A class that could not be read gives a stub with the first class name of its pool."""
    view = View(row)
    if row["status"] != "ok":
        named = min((c for c in row["cp"] if c["kind"] == "Class"), key=lambda c: c["idx"], default=None)
        name = view.class_name(named["idx"]) if named else re.sub(r"\.class$", "", row["path"].rsplit("/", 1)[-1])
        notes = [f"// {d['severity']} at {d['offset']}: {d['message']}" for d in row["diagnostics"]]
        simple = re.sub(r"\W", "_", short(name))
        return Source(name, "\n".join([NOTE, "// The class file could not be read.", *notes, f"class {simple} {{", "}", ""]), 0, 0)
    package, _, simple = view.name.rpartition(".")
    enum, interface = bool(view.access & 0x4000) and erased(view.super_name or "") == "java.lang.Enum", bool(view.access & 0x200)
    members = [m for m in row["methods"] if not m["access"] & 0x1040 and not (view.utf8(m["name_idx"]) or "").startswith("lambda$")]
    results: dict[int, Result] = {m["seq"]: reconstruct(view, m) for m in members if m["code"] is not None and view.by_method["insns"].get(m["seq"])}
    constants: list[str] = [view.utf8(f["name_idx"]) for f in row["fields"] if f["access"] & 0x4000] if enum else []
    init = next((m for m in members if view.utf8(m["name_idx"]) == "<clinit>"), None)
    values, rest = _initializers(view, results[init["seq"]], set(constants)) if init is not None and init["seq"] in results else ({}, [])
    body: list[str] = []
    if enum:
        shown = []
        for c in constants:
            e = values.get(c)
            args = e.args[2:] if e is not None and e.kind == "new" else []
            shown.append(c + (f"({', '.join(render(a) for a in args)})" if args else ""))
        body += [",\n".join(shown) + ";", ""] if shown else [";", ""]
    for f in row["fields"]:
        name = view.utf8(f["name_idx"])
        if enum and (f["access"] & 0x4000 or name == "$VALUES"):
            continue
        body += _field(view, f, values.get(name))
    if body and body[-1]:
        body.append("")
    if rest:
        body += ["static {", *lines(rest, 1), "}", ""]
    for m in members:
        name, desc = view.utf8(m["name_idx"]), view.utf8(m["desc_idx"])
        if name == "<clinit>" or enum and (name, desc) in (("values", f"()[L{view.name.replace('.', '/')};"), ("valueOf", f"(Ljava/lang/String;)L{view.name.replace('.', '/')};")):
            continue
        result = results.get(m["seq"])
        if name == "<init>" and result is not None:
            if len(result.block) <= 1 and all(s.kind == "expr" and render(s.exprs[0]) == "super()" for s in result.block) and len(members) and not result.parameters and m["access"] & 1 == view.access & 1 and sum(view.utf8(x["name_idx"]) == "<init>" for x in members) == 1 and not view.annotations("method", m["seq"]):
                continue  # the constructor that the compiler adds
            if enum:
                for s in result.block:
                    for e in s.exprs:
                        if e.kind == "call" and e.text == "this" and len(e.args) > 2:
                            del e.args[1:3]
                result.block = [s for s in result.block if not (s.kind == "expr" and s.exprs[0].kind == "call" and s.exprs[0].text == "super")]
                if not result.block and len(result.parameters) <= 2:
                    continue
            result.block = [s for s in result.block if not (s.kind == "expr" and render(s.exprs[0]) == "super()")]
        body += _method(view, m, result, m["seq"] in overrides or (name, desc) in OBJECT_METHODS and not m["access"] & 8, simple)
    text = [f"    {x}" if x else x for part in body for x in part.split("\n")]
    while text and not text[-1]:
        text.pop()
    text = ["\n".join([*_annotations(view, "class", 0, bool(row["deprecated"])), _head(view, simple, enum, interface) + " {"]), *text, "}", ""]
    written = "\n".join(text)
    used = [x for x in _imports(view) if re.search(rf"(?<![\w$.]){re.escape(short(x))}(?![\w$])", written)]
    top = [NOTE, *([f"package {package};"] if package else []), "", *[f"import {x};" for x in used], *([""] if used else [])]
    return Source(view.name, "\n".join(top) + "\n" + written, len(members), sum(not r.structured for r in results.values()))


def _head(view: View, simple: str, enum: bool, interface: bool) -> str:
    faces = [view.class_name(x["cp"]) for x in sorted(view.row["interfaces"], key=lambda x: x["seq"])]
    super_name, variables = view.super_name, ""
    signature = view.utf8(view.row.get("sig_idx"))
    if signature:
        try:
            t = class_type(signature)
            super_name, faces = bound(t.super_name, view.variables), [bound(f, view.variables) for f in t.interfaces]
            variables = f"<{', '.join(short(v) for v in t.variables)}>" if t.variables else ""
        except Malformed:
            pass
    flags = view.access
    if interface:
        flags &= ~0x400
    if enum:
        flags &= ~0x410
    kind = "@interface" if view.access & 0x2000 else "interface" if interface else "enum" if enum else "class"
    out = f"{words(flags, CLASS_FLAGS)}{kind} {simple}{variables}"
    if not (interface or enum) and super_name and erased(super_name) != "java.lang.Object":
        out += f" extends {short(super_name)}"
    if view.access & 0x2000:
        faces = []
    if faces:
        out += f" {'extends' if interface else 'implements'} {', '.join(short(f) for f in faces)}"
    return out


def _imports(view: View) -> list[str]:
    """Classes that the pool and the signatures name, in other packages; where two share a short name, the first by name."""
    package = view.name.rpartition(".")[0]
    found = set()
    for c in view.row["cp"]:
        if c["kind"] == "Class":
            found.add(view.class_name(c["idx"]).replace("[]", ""))
        elif c["kind"] == "Utf8" and c["utf8"] and ("/" in c["utf8"]) and len(c["utf8"]) < 4000:
            found |= {x.replace("/", ".") for x in re.findall(r"L([\w/$]+)[;<]", c["utf8"])}
    out: dict[str, str] = {}
    for x in sorted(found):
        home = x.rpartition(".")[0]
        if home and home != package and home != "java.lang" and "#" not in x:
            out.setdefault(short(x), member_dots(x))
    return sorted(out.values())

"""Expected rows of the archives that the bytecode queries read, as Parquet: python tests/make_expected.py [OUT].

Everything here comes from `javap -v -p` and zipfile, by text patterns; nothing of the engine is used. What the queries compute from these tables is stated in SQL in
bytelake/plans/expected.py.
"""

from __future__ import annotations

import os
import re
import subprocess
import sys
import tempfile
import zipfile
from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
I, L, S, B, D = pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.float64()
TABLES = {
    "entry": [("archive", S), ("path", S), ("crc32", L), ("packed_size", L), ("size", I)],
    "class": [("archive", S), ("path", S), ("n_bytes", L), ("minor", I), ("major", I), ("access", I), ("this_idx", I), ("super_idx", I), ("name", S), ("super_name", S), ("deprecated", B)],
    "pool": [("path", S), ("idx", I), ("kind", S), ("text", S), ("integer", L), ("real", D), ("ref1", I), ("ref2", I), ("handle", I)],
    "interface": [("path", S), ("seq", I), ("name", S)],
    "member": [("path", S), ("kind", S), ("seq", I), ("access", I), ("name", S), ("descriptor", S), ("signature", S), ("deprecated", B), ("has_const", B), ("throws", S), ("max_stack", I), ("max_locals", I), ("code_bytes", I)],
    "insn": [("path", S), ("method", I), ("pc", I), ("length", I), ("op", S), ("var", I), ("value", I), ("cp", I), ("target", I), ("dims", I)],
    "arm": [("path", S), ("method", I), ("pc", I), ("label", I), ("target", I)],
    "handler": [("path", S), ("method", I), ("seq", I), ("start_pc", I), ("end_pc", I), ("handler_pc", I), ("type", S)],
    "line": [("path", S), ("method", I), ("pc", I), ("line", I)],
    "scope": [("path", S), ("method", I), ("generic", B), ("slot", I), ("start_pc", I), ("length", I), ("name", S), ("type", S)],
    "frame": [("path", S), ("method", I), ("seq", I), ("kind", S), ("delta", I), ("chop", I), ("n_locals", I), ("n_stack", I)],
    "frame_local": [("path", S), ("method", I), ("seq", I), ("entry", I), ("type", S)],
    "inner": [("path", S), ("inner_idx", I), ("outer_idx", I), ("name_idx", I)],
    "bootstrap": [("path", S), ("seq", I), ("method_idx", I), ("args", S)],
    "annotation": [("path", S), ("owner", S), ("owner_seq", I), ("visible", B), ("seq", I), ("type", S)],
    "descriptor": [("descriptor", S), ("type", S), ("parameters", S)],
}
BASE = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}
ELEMENTS = {"boolean": 4, "char": 5, "float": 6, "double": 7, "byte": 8, "short": 9, "int": 10, "long": 11}


def java_type(d: str) -> tuple[str, str]:
    """The first type of a descriptor, and the rest of it."""
    if d[0] == "[":
        inner, rest = java_type(d[1:])
        return inner + "[]", rest
    if d[0] == "L":
        name, _, rest = d[1:].partition(";")
        return name.replace("/", "."), rest
    return BASE[d[0]], d[1:]


def described(d: str) -> tuple[str, str | None]:
    """(type or result, parameters joined by a comma or None for a field)."""
    if d[0] != "(":
        return java_type(d)[0], None
    inside, _, result = d[1:].partition(")")
    parts = []
    while inside:
        one, inside = java_type(inside)
        parts.append(one)
    return java_type(result)[0], ",".join(parts)


def unescaped(s: str) -> str:
    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}.get(m[1], m[1]), s)


def operation(mnemonic: str, operand: str, pc: int, following: int | None) -> dict:
    """An instruction as the inventory names it: constants, loads and stores without the suffix of their index."""
    row = {"op": mnemonic, "var": None, "value": None, "cp": None, "target": None, "dims": None}
    plain, length = operand.split("//")[0].strip(), 1
    if m := re.fullmatch(r"([ilfda](?:load|store))_([0-3])", mnemonic):
        row |= {"op": m[1], "var": int(m[2])}
    elif m := re.fullmatch(r"([ilfd]const)_(m1|\d)", mnemonic):
        row |= {"op": m[1], "value": -1 if m[2] == "m1" else int(m[2])}
    elif mnemonic in ("bipush", "sipush"):
        row, length = row | {"op": "iconst", "value": int(plain)}, 2 if mnemonic == "bipush" else 3
    elif mnemonic == "iinc":
        a, b = plain.split(",")
        row, length = row | {"var": int(a), "value": int(b)}, 3
    elif mnemonic == "newarray":
        row, length = row | {"value": ELEMENTS[plain]}, 2
    elif plain.startswith("#"):
        first, *rest = [x.strip() for x in plain[1:].split(",")]
        row["cp"], length = int(first), {"ldc": 2, "invokeinterface": 5, "invokedynamic": 5, "multianewarray": 4}.get(mnemonic, 3)
        row["op"] = "ldc" if mnemonic.startswith("ldc") else mnemonic
        if mnemonic == "multianewarray":
            row["dims"] = int(rest[0])
    elif re.fullmatch(r"-?\d+", plain) and (mnemonic.startswith("if") or mnemonic in ("goto", "jsr")):
        row, length = row | {"target": int(plain)}, 3
    elif re.fullmatch(r"\d+", plain):
        row, length = row | {"var": int(plain)}, 2
    elif plain:
        raise ValueError(f"{mnemonic} {operand}")
    return row | {"length": following - pc if following is not None else length}


def of_archive(jar: str, rows: dict[str, list[dict]]) -> None:
    name = os.path.basename(jar)
    with zipfile.ZipFile(jar) as z, tempfile.TemporaryDirectory() as folder:
        for e in z.infolist():
            rows["entry"].append({"archive": name, "path": e.filename, "crc32": e.CRC, "packed_size": e.compress_size, "size": e.file_size})
        z.extractall(folder)
        paths = sorted(n for n in z.namelist() if n.endswith(".class") and not re.search(r"(module|package)-info\.class$", n))
        text = subprocess.run(["javap", "-v", "-p", *(os.path.join(folder, p) for p in paths)], capture_output=True, text=True, check=True).stdout
    for one in re.split(r"^Classfile ", text, flags=re.M)[1:]:
        lines = one.split("\n")
        of_class(name, lines[0][len(folder) + 1 :].strip(), lines[1:], rows)


def of_class(archive: str, path: str, lines: list[str], rows: dict[str, list[dict]]) -> None:
    add = lambda table, **x: rows[table].append({"path": path} | x)
    pool: dict[int, dict] = {}
    cls = {"archive": archive, "deprecated": False}
    body = next(k for k, x in enumerate(lines) if x == "{")
    for x in lines[:body]:
        if m := re.search(r"; size (\d+) bytes", x):
            cls["n_bytes"] = int(m[1])
        elif m := re.match(r"  (minor|major) version: (\d+)", x):
            cls[m[1]] = int(m[2])
        elif m := re.match(r"  flags: \(0x([0-9a-f]+)\)", x):
            cls["access"] = int(m[1], 16)
        elif m := re.match(r"  (this|super)_class: #(\d+) +// (\S+)", x):
            cls[f"{m[1]}_idx"], cls["name" if m[1] == "this" else "super_name"] = int(m[2]), m[3].strip('"').replace("/", ".")
        elif m := re.match(r" *#(\d+) = (\S+) *(.*)$", x):
            idx, kind, rest = int(m[1]), m[2], m[3].split("//")[0].strip()
            p = {"idx": idx, "kind": kind, "text": None, "integer": None, "real": None, "ref1": None, "ref2": None, "handle": None}
            value = x[x.index("= ") + 2 + 19 :]
            if kind == "Utf8":
                p["text"] = unescaped(value)
            elif kind in ("Integer", "Long"):
                p["integer"] = int(value.rstrip("l"))
            elif kind in ("Float", "Double"):
                p["real"] = float(value.rstrip("fd").replace("Infinity", "inf"))
            elif kind == "MethodHandle":
                p["handle"], p["ref1"] = int(rest.split(":#")[0]), int(rest.split(":#")[1])
            elif kind in ("InvokeDynamic", "Dynamic"):
                p["ref1"], p["ref2"] = (int(v) for v in re.fullmatch(r"#(\d+):#(\d+)", rest).groups())
            else:
                refs = [int(v) for v in re.findall(r"#(\d+)", rest)]
                p["ref1"], p["ref2"] = refs[0], refs[1] if len(refs) > 1 else None
            pool[idx] = p
            add("pool", **p)
    declared = next(x for x in lines if re.match(r"(\w+ )*(class|interface|enum) ", x))
    while "<" in declared:
        declared = re.sub(r"<[^<>]*>", "", declared)
    listed = re.search(r" implements (.*)$" if not cls["access"] & 0x200 else r" extends (.*)$", declared)
    for seq, n in enumerate(listed[1].split(",") if listed else []):
        add("interface", seq=seq, name=n.strip())
    text_of = lambda k: pool[int(k)]["text"]
    end = next(k for k in range(body, len(lines)) if lines[k] == "}")
    seqs = {"field": 0, "method": 0}
    k = body + 1
    while k < end:
        start = k
        k += 1
        while k < end and not re.match(r"  \S", lines[k]):
            k += 1
        if re.match(r"  \S", lines[start]):
            of_member(cls, lines[start], lines[start + 1 : k], seqs, add, text_of)
    at, mode, visible = end + 1, None, False
    for x in lines[at:]:
        if not x.startswith(" "):
            mode = x.split(":")[0]
            visible = mode == "RuntimeVisibleAnnotations"
            cls["deprecated"] = cls["deprecated"] or mode == "Deprecated"
        elif mode == "InnerClasses" and (m := re.match(r" +[a-z ]*#(\d+)(?:= #(\d+)(?: of #(\d+))?)?;", x)):
            name_idx, inner, outer = (int(m[1]), int(m[2]), int(m[3] or 0)) if m[2] else (0, int(m[1]), 0)
            add("inner", inner_idx=inner, outer_idx=outer, name_idx=name_idx)
        elif mode == "BootstrapMethods" and (m := re.match(r"  (\d+): #(\d+) ", x)):
            add("bootstrap", seq=int(m[1]), method_idx=int(m[2]), args="")
        elif mode == "BootstrapMethods" and (m := re.match(r"      #(\d+) ", x + " ")):
            last = rows["bootstrap"][-1]
            last["args"] = f"{last['args']},{m[1]}".lstrip(",")
        elif mode and mode.endswith("VisibleAnnotations") | mode.endswith("InvisibleAnnotations") and (m := re.match(r"  (\d+): #(\d+)\(", x)):
            add("annotation", owner="class", owner_seq=0, visible=visible, seq=int(m[1]), type=text_of(m[2]))
    add("class", **cls)


def of_member(cls: dict, head: str, lines: list[str], seqs: dict, add, text_of) -> None:
    m = {"signature": None, "deprecated": False, "has_const": False, "throws": "", "max_stack": None, "max_locals": None, "code_bytes": None}
    code, arms, mode, own, handlers, frames, visible = [], [], None, [], 0, 0, False
    for x in lines:
        if g := re.match(r"    descriptor: (\S+)", x):
            m["descriptor"] = g[1]
            kind = "method" if g[1].startswith("(") else "field"
            seq = seqs[kind]
            seqs[kind] += 1
            if kind == "field":
                m["name"] = head.rstrip(";").split()[-1]
            else:
                name = "<clinit>" if "{}" in head else re.search(r"([^\s(]+)\(", head)[1]
                m["name"] = "<init>" if name == cls["name"] else name
        elif g := re.match(r"    flags: \(0x([0-9a-f]+)\)", x):
            m["access"] = int(g[1], 16)
        elif g := re.match(r"    Signature: #(\d+)", x):
            m["signature"] = text_of(g[1])
        elif x == "    Deprecated: true":
            m["deprecated"] = True
        elif x.startswith("    ConstantValue:"):
            m["has_const"] = True
        elif g := re.match(r"      throws (.*)$", x):
            m["throws"] = re.sub(r"<[^>]*>", "", g[1]).replace(", ", ",")
        elif g := re.match(r"      stack=(\d+), locals=(\d+)", x):
            m["max_stack"], m["max_locals"], mode = int(g[1]), int(g[2]), "code"
        elif g := re.match(r"    (Runtime\w+):", x):
            mode, visible = g[1], g[1] == "RuntimeVisibleAnnotations"
        elif mode in ("RuntimeVisibleAnnotations", "RuntimeInvisibleAnnotations") and (g := re.match(r"      (\d+): #(\d+)\(", x)):
            own.append({"visible": visible, "seq": int(g[1]), "type": text_of(g[2])})
        elif g := re.match(r"      (Exception table|LineNumberTable|LocalVariableTable|LocalVariableTypeTable|StackMapTable):", x):
            mode = g[1]
        elif mode == "code" and (g := re.match(r" +(\d+): ([a-z]\w*)(.*)$", x)):
            code.append((int(g[1]), g[2], g[3].strip()))
        elif mode == "code" and (g := re.match(r" +(-?\d+|default): (-?\d+)$", x)):
            arms.append((code[-1][0], None if g[1] == "default" else int(g[1]), int(g[2])))
        elif mode == "Exception table" and (g := re.match(r" +(\d+) +(\d+) +(\d+) +(?:Class (\S+)|any)$", x)):
            add("handler", method=seq, seq=handlers, start_pc=int(g[1]), end_pc=int(g[2]), handler_pc=int(g[3]), type=g[4].replace("/", ".") if g[4] else "any")
            handlers += 1
        elif mode == "LineNumberTable" and (g := re.match(r" +line (\d+): (\d+)", x)):
            add("line", method=seq, pc=int(g[2]), line=int(g[1]))
        elif mode and mode.startswith("LocalVariable") and (g := re.match(r" +(\d+) +(\d+) +(\d+) +(\S+) +(\S+)$", x)):
            add("scope", method=seq, generic=mode == "LocalVariableTypeTable", slot=int(g[3]), start_pc=int(g[1]), length=int(g[2]), name=g[4], type=g[5])
        elif mode == "StackMapTable" and (g := re.match(r" +frame_type = (\d+) /\* (\w+) \*/", x)):
            t = int(g[1])
            f = {"seq": frames, "kind": {"same": "same", "same_frame_extended": "same", "same_locals_1_stack_item": "stack1", "same_locals_1_stack_item_frame_extended": "stack1", "chop": "chop", "append": "append", "full_frame": "full"}[g[2]]}
            f |= {"delta": t if t < 64 else t - 64 if t < 128 else None, "chop": 251 - t if f["kind"] == "chop" else 0, "n_locals": 0, "n_stack": 0}
            frames += 1
            add("frame", method=seq, **f)
            last = ROWS["frame"][-1]
        elif mode == "StackMapTable" and (g := re.match(r" +offset_delta = (\d+)", x)):
            last["delta"] = int(g[1])
        elif mode == "StackMapTable" and (g := re.match(r" +(locals|stack) = \[ ?(.*?) ?\]$", x)):
            types = [v.strip() for v in g[2].split(", ") if v.strip()]
            last[f"n_{g[1]}"] = len(types)
            for entry, v in enumerate(types if g[1] == "locals" else []):
                v = re.sub(r"^class ", "", v).strip('"').replace("/", ".") if v.startswith("class") else v.split()[0]
                add("frame_local", method=seq, seq=last["seq"], entry=entry, type=v)
    for j, (pc, mnemonic, operand) in enumerate(code):
        following = code[j + 1][0] if j + 1 < len(code) else None
        mine = [a for a in arms if a[0] == pc]
        if mine:
            if following is None:  # a switch that ends the method
                n = len(mine) - 1
                following = pc + 4 - pc % 4 + (12 + 4 * n if mnemonic == "tableswitch" else 8 + 8 * n)
            operand = ""
            for _, label, target in mine:
                add("arm", method=seq, pc=pc, label=label, target=target)
        row = operation(mnemonic, operand, pc, following)
        add("insn", method=seq, pc=pc, **row)
        m["code_bytes"] = pc + row["length"]
    for a in own:
        add("annotation", owner=kind, owner_seq=seq, **a)
    add("member", kind=kind, seq=seq, **m)


ROWS: dict[str, list[dict]] = defaultdict(list)


def main(out: str) -> None:
    import pyspark

    jars = os.path.join(os.path.dirname(pyspark.__file__), "jars")
    for name in ("gson-2.11.0.jar", "commons-cli-1.10.0.jar"):
        of_archive(os.path.join(jars, name), ROWS)
    texts = {m["descriptor"] for m in ROWS["member"]} | {p["text"] for p in ROWS["pool"] if p["kind"] == "Utf8" and re.fullmatch(r"\((\[*([BCDFIJSZ]|L[^;()<>]+;))*\)\[*([BCDFIJSZV]|L[^;()<>]+;)|\[*([BCDFIJSZ]|L[^;()<>]+;)", p["text"])}
    for d in sorted(texts):
        t, p = described(d)
        ROWS["descriptor"].append({"descriptor": d, "type": t, "parameters": p})
    os.makedirs(out, exist_ok=True)
    for name, columns in TABLES.items():
        pq.write_table(pa.Table.from_pylist(ROWS[name], pa.schema(columns)), os.path.join(out, f"{name}.parquet"), compression="zstd", compression_level=19)
        print(name, len(ROWS[name]))


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else os.path.join(HERE, "bytelake", "plans", "expected"))

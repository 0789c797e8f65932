"""The JVM instruction set: names, operand forms and what each does to the stack, after the public JVM specification."""

from __future__ import annotations

import struct


def _names() -> list[str]:
    typed = "ilfda"
    out = ["nop", "aconst_null", *(f"iconst_{k}" for k in ("m1", 0, 1, 2, 3, 4, 5)), "lconst_0", "lconst_1", "fconst_0", "fconst_1", "fconst_2", "dconst_0", "dconst_1"]
    out += ["bipush", "sipush", "ldc", "ldc_w", "ldc2_w"]
    for kind in ("load", "store"):
        out += [f"{t}{kind}" for t in typed] + [f"{t}{kind}_{k}" for t in typed for k in range(4)] + [f"{t}a{kind}" for t in "ilfdabcs"]
    out += ["pop", "pop2", "dup", "dup_x1", "dup_x2", "dup2", "dup2_x1", "dup2_x2", "swap"]
    out += [f"{t}{op}" for op in ("add", "sub", "mul", "div", "rem", "neg") for t in "ilfd"]
    out += [f"{t}{op}" for op in ("shl", "shr", "ushr", "and", "or", "xor") for t in "il"]
    out += ["iinc", *(f"{a}2{b}" for a in "ilfd" for b in "ilfd" if a != b), "i2b", "i2c", "i2s", "lcmp", "fcmpl", "fcmpg", "dcmpl", "dcmpg"]
    out += [f"if{c}" for c in ("eq", "ne", "lt", "ge", "gt", "le")] + [f"if_icmp{c}" for c in ("eq", "ne", "lt", "ge", "gt", "le")] + ["if_acmpeq", "if_acmpne"]
    out += ["goto", "jsr", "ret", "tableswitch", "lookupswitch", *(f"{t}return" for t in typed), "return"]
    out += ["getstatic", "putstatic", "getfield", "putfield", "invokevirtual", "invokespecial", "invokestatic", "invokeinterface", "invokedynamic"]
    out += ["new", "newarray", "anewarray", "arraylength", "athrow", "checkcast", "instanceof", "monitorenter", "monitorexit", "wide", "multianewarray"]
    return [*out, "ifnull", "ifnonnull", "goto_w", "jsr_w"]


NAMES = _names()
CODE = {name: k for k, name in enumerate(NAMES)}
#: Element types of newarray (fixed values).
ARRAY_TYPES = {4: "boolean", 5: "char", 6: "float", 7: "double", 8: "byte", 9: "short", 10: "int", 11: "long"}
RETURNS = frozenset(["ireturn", "lreturn", "freturn", "dreturn", "areturn", "return"])
#: Control never goes on after these.
NO_FALLTHROUGH = RETURNS | {"athrow", "goto", "goto_w", "tableswitch", "lookupswitch", "ret", "jsr", "jsr_w", "malformed"}


def _form(name: str) -> str:
    if name in ("bipush",):
        return "b"
    if name == "sipush":
        return "h"
    if name == "ldc":
        return "C"
    if name in ("ldc_w", "ldc2_w") or name.startswith(("get", "put")) or name in ("invokevirtual", "invokespecial", "invokestatic", "new", "anewarray", "checkcast", "instanceof"):
        return "c"
    if name in ("invokeinterface", "invokedynamic"):
        return "i"
    if name == "newarray":
        return "t"
    if name == "multianewarray":
        return "m"
    if name == "iinc":
        return "n"
    if name == "ret" or len(name) > 4 and name[1:] in ("load", "store") or name in [f"{t}{k}" for t in "ilfda" for k in ("load", "store")]:
        return "v"
    if name in ("goto", "jsr") or name.startswith("if"):
        return "j"
    if name in ("goto_w", "jsr_w"):
        return "J"
    return {"tableswitch": "T", "lookupswitch": "L", "wide": "W"}.get(name, "")


FORMS = [_form(n) for n in NAMES]


def decode(code: bytes) -> tuple[list[dict], list[tuple[str, int, str]]]:
    """Instructions of a method's code, and (severity, offset, message) of what is wrong with it.

    Keys: pc, length, opcode, op (name without an index suffix), and where they apply var (local), value (constant or increment), cp (constant pool index), target (absolute), dims,
    keys and targets and default (of switches). An unknown opcode is a row `unknown`; an instruction that is cut off is a row `malformed` of all the rest.
    """
    out, notes, pc, end = [], [], 0, len(code)
    while pc < end:
        opcode = code[pc]
        try:
            row = _one(code, pc, opcode)
        except (struct.error, IndexError):
            row = {"pc": pc, "length": end - pc, "opcode": opcode, "op": "malformed"}
            notes.append(("error", pc, f"{NAMES[opcode] if opcode < len(NAMES) else opcode} is cut off"))
        if row["op"] == "unknown":
            notes.append(("warning", pc, f"unknown opcode 0x{opcode:02x}"))
        out.append(row)
        pc += row["length"]
    return out, notes


def _one(code: bytes, pc: int, opcode: int) -> dict:
    if opcode >= len(NAMES):
        return {"pc": pc, "length": 1, "opcode": opcode, "op": "unknown"}
    name, form = NAMES[opcode], FORMS[opcode]
    row = {"pc": pc, "length": 1, "opcode": opcode, "op": name}
    get = lambda f, k: struct.unpack_from(f, code, pc + k)[0]
    if "_" in name and name.split("_")[0] in ("iload", "lload", "fload", "dload", "aload", "istore", "lstore", "fstore", "dstore", "astore"):
        row["op"], row["var"] = name.split("_")[0], int(name[-1])
    elif name.startswith(("iconst_", "lconst_", "fconst_", "dconst_")):
        row["op"], row["value"] = name.split("_")[0], -1 if name[-2:] == "m1" else int(name[-1])
    elif form == "b":
        row |= {"length": 2, "op": "iconst", "value": get(">b", 1)}
    elif form == "h":
        row |= {"length": 3, "op": "iconst", "value": get(">h", 1)}
    elif form == "C":
        row |= {"length": 2, "op": "ldc", "cp": get(">B", 1)}
    elif form == "c":
        row |= {"length": 3, "op": "ldc" if name.startswith("ldc") else name, "cp": get(">H", 1)}
    elif form == "i":
        get(">H", 3)
        row |= {"length": 5, "cp": get(">H", 1)}
    elif form == "t":
        row |= {"length": 2, "value": get(">B", 1)}
    elif form == "m":
        row |= {"length": 4, "cp": get(">H", 1), "dims": get(">B", 3)}
    elif form == "n":
        row |= {"length": 3, "var": get(">B", 1), "value": get(">b", 2)}
    elif form == "v":
        row |= {"length": 2, "var": get(">B", 1)}
    elif form == "j":
        row |= {"length": 3, "target": pc + get(">h", 1)}
    elif form == "J":
        row |= {"length": 5, "op": name[:-2], "target": pc + get(">i", 1)}
    elif form == "W":
        inner = get(">B", 1)
        if inner >= len(NAMES) or FORMS[inner] not in ("v", "n"):
            return {"pc": pc, "length": 1, "opcode": opcode, "op": "unknown"}
        row |= {"length": 4, "op": NAMES[inner], "var": get(">H", 2)}
        if FORMS[inner] == "n":
            row |= {"length": 6, "value": get(">h", 4)}
    elif form in ("T", "L"):
        at = 4 - pc % 4
        row["default"] = pc + get(">i", at)
        if form == "T":
            low, high = get(">i", at + 4), get(">i", at + 8)
            n, at = high - low + 1, at + 12
            if n < 0 or 4 * n > len(code):
                raise IndexError
            row["keys"] = list(range(low, high + 1))
            row["targets"] = [pc + x for x in struct.unpack_from(f">{n}i", code, pc + at)]
            row["length"] = at + 4 * n
        else:
            n, at = get(">i", at + 4), at + 8
            if n < 0 or 8 * n > len(code):
                raise IndexError
            pairs = struct.unpack_from(f">{2 * n}i", code, pc + at)
            row["keys"], row["targets"] = list(pairs[::2]), [pc + x for x in pairs[1::2]]
            row["length"] = at + 8 * n
    return row

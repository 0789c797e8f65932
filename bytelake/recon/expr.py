"""Expressions of reconstructed code, and how Java writes them."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Binding strength of operators, tightest first (fixed by the language).
PRECEDENCE = {"*": 12, "/": 12, "%": 12, "+": 11, "-": 11, "<<": 10, ">>": 10, ">>>": 10, "<": 9, ">": 9, "<=": 9, ">=": 9, "==": 8, "!=": 8, "&": 7, "^": 6, "|": 5, "&&": 4, "||": 3}
OPPOSITE = {"==": "!=", "!=": "==", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
ESCAPES = {"\n": "\\n", "\r": "\\r", "\t": "\\t", '"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f"}


@dataclass(eq=False)
class E:
    """kind says what the other fields mean; see the render functions below. type is a dotted Java type."""

    kind: str
    args: list[E] = field(default_factory=list)
    text: str = ""
    type: str = "java.lang.Object"
    more: object = None

    def walk(self):
        yield self
        for a in self.args:
            yield from a.walk()


def const(text: str, kind: str) -> E:
    return E("const", text=text, type=kind)


def var(name: str, kind: str) -> E:
    return E("var", text=name, type=kind)


def binary(op: str, a: E, b: E, kind: str) -> E:
    return E("bin", [a, b], op, kind)


IMPURE = frozenset(["call", "new", "assign", "postinc", "lambda_call", "indy"])
STATE = frozenset(["field", "static", "array", "length"])


def impure(e: E) -> bool:
    return any(x.kind in IMPURE for x in e.walk())


def reads_state(e: E) -> bool:
    return any(x.kind in STATE for x in e.walk())


def escape(text: str) -> str:
    return "".join(ESCAPES.get(c) or (c if " " <= c < "\x7f" or c.isprintable() else "".join(f"\\u{u:04x}" for u in _units(c))) for c in text)


def _units(c: str) -> list[int]:
    raw = c.encode("utf-16-be", "surrogatepass")
    return [int.from_bytes(raw[k : k + 2], "big") for k in range(0, len(raw), 2)]


def real_literal(value: float, kind: str) -> str:
    """A float or double literal; those without one as constants of their class."""
    box = "Float" if kind == "float" else "Double"
    if value != value:
        return f"{box}.NaN"
    if value in (float("inf"), float("-inf")):
        return f"{box}.{'POSITIVE' if value > 0 else 'NEGATIVE'}_INFINITY"
    if kind == "float":
        import numpy as np

        return f"{np.format_float_scientific(np.float32(value), unique=True, trim='0') if abs(value) >= 1e7 or 0 < abs(value) < 1e-3 else str(np.float32(value))}f"
    return repr(value)


def member_dots(name: str) -> str:
    """Member classes of the platform by a dot. Those of scanned classes are files of their own, under the class file's name."""
    return name.replace("$", ".") if name.startswith(("java.", "javax.")) else name


def short(name: str) -> str:
    """A type as source writes it: without packages, and so its generic arguments."""
    out, word = [], ""
    for c in name:
        if c.isalnum() or c in "_$.":
            word += c
        else:
            out += [member_dots(word).rsplit(".", 1)[-1], c]
            word = ""
    return "".join([*out, member_dots(word).rsplit(".", 1)[-1]])


def negate(e: E) -> E:
    if e.kind == "not":
        return e.args[0]
    if e.kind == "bin" and e.text in OPPOSITE and not (e.more == "real" and e.text not in ("==", "!=")):
        return E("bin", e.args, OPPOSITE[e.text], "boolean", e.more)
    if e.kind == "bin" and e.text in ("&&", "||"):
        return E("bin", [negate(a) for a in e.args], "||" if e.text == "&&" else "&&", "boolean")
    if e.kind == "const" and e.type == "boolean":
        return const("false" if e.text == "true" else "true", "boolean")
    return E("not", [e], type="boolean")


def as_boolean(e: E) -> E:
    """e where a boolean is wanted: 0 and 1 are false and true, and a choice between them is its condition."""
    if e.type == "boolean" and e.kind not in ("cond", "const"):
        return e
    if e.kind == "const" and e.text in ("0", "1"):
        return const("true" if e.text == "1" else "false", "boolean")
    if e.kind == "cond":
        a, b = as_boolean(e.args[1]), as_boolean(e.args[2])
        if (a.text, b.text) == ("true", "false") and a.kind == b.kind == "const":
            return e.args[0]
        if (a.text, b.text) == ("false", "true") and a.kind == b.kind == "const":
            return negate(e.args[0])
        return E("cond", [e.args[0], a, b], type="boolean")
    if e.kind == "bin" and e.text in ("&", "|", "^") and any(a.type == "boolean" for a in e.args):
        return E("bin", [as_boolean(a) for a in e.args], e.text, "boolean")
    return e


def coerce(e: E, kind: str) -> E:
    if kind == "boolean":
        return as_boolean(e)
    if kind == "char" and e.kind == "const" and e.type == "int" and e.text.isdigit():
        c = chr(int(e.text))
        return const("'" + ("\\'" if c == "'" else c if c == '"' else escape(c)) + "'", "char")
    if kind == "char" and e.kind == "cond":
        return E("cond", [e.args[0], coerce(e.args[1], kind), coerce(e.args[2], kind)], type="char")
    if kind in ("byte", "short") and e.kind == "const":
        return const(e.text, kind)
    if kind in ("byte", "short", "char") and e.type == "int" and e.kind != "const":  # a local without a declared type is taken for an int
        return E("cast", [e], type=kind)
    return e


def render(e: E, level: int = 0) -> str:
    """e as Java; level: the binding strength around it, above which it needs no parentheses."""
    text, strength = _render(e)
    return f"({text})" if strength < level else text


def _args(args: list[E]) -> str:
    return ", ".join(render(a) for a in args)


def _render(e: E) -> tuple[str, int]:
    k, a = e.kind, e.args
    if k in ("const", "var"):
        return e.text, 13 if e.text[:1] == "-" else 20
    if k == "string":
        return f'"{escape(e.text)}"', 20
    if k == "class":
        return f"{short(e.text)}.class", 20
    if k == "bin":
        p = PRECEDENCE[e.text]
        left, right = render(a[0], p), render(a[1], p + 1)
        if e.text in ("==", "!=", "<", ">", "<=", ">="):  # arithmetic inside of comparisons is set off
            left = f"({left})" if a[0].kind == "bin" and not left.startswith("(") else left
            right = f"({right})" if a[1].kind == "bin" and not right.startswith("(") else right
        return f"{left} {e.text} {right}", p
    if k == "concat":
        parts = [render(x, 12 if n else 11) for n, x in enumerate(a)]
        if not any(x.kind == "string" or x.type == "java.lang.String" for x in a[:2]):
            parts.insert(0, '""')
        return " + ".join(parts), 11
    if k in ("not", "neg"):
        return ("!" if k == "not" else "-") + render(a[0], 14 if k == "neg" else 13), 13
    if k == "cast":
        return f"({short(e.type)}) {render(a[0], 13)}", 13
    if k == "cond":
        return f"{render(a[0], 3)} ? {render(a[1], 2)} : {render(a[2], 2)}", 2
    if k == "assign":
        return f"{render(a[0], 15)} = {render(a[1], 1)}", 1
    if k == "postinc":
        return f"{render(a[0], 15)}{'++' if e.text == '1' else '--'}", 14
    if k == "instanceof":
        return f"{render(a[0], 9)} instanceof {short(e.text)}", 9
    if k == "field":
        return f"{render(a[0], 15)}.{e.text}", 20
    if k == "static":
        return f"{short(e.more)}.{e.text}" if e.more else e.text, 20
    if k == "array":
        return f"{render(a[0], 15)}[{render(a[1])}]", 20
    if k == "length":
        return f"{render(a[0], 15)}.length", 20
    if k == "call":
        target = render(a[0], 15) + "." if e.more is None else "" if e.more == "" else f"{short(e.more)}."
        return f"{target}{e.text}({_args(a[1:])})", 20
    if k == "new":
        return f"new {short(e.type)}({_args(a)})", 20
    if k == "newarray":
        base, dims = e.type, 0
        while base.endswith("[]"):
            base, dims = base[:-2], dims + 1
        if e.more:
            return f"new {short(e.type)} {{{_args(e.more)}}}", 20
        return f"new {short(base)}" + "".join(f"[{render(x)}]" for x in a) + "[]" * (dims - len(a)), 20
    if k == "lambda":
        return e.text, 2
    if k == "indy":
        return f"{e.text}({_args(a)})", 20
    return e.text or f"/* {k} */", 20

"""A tolerant class file decoder: bytes in, plain rows out, and a diagnostic for whatever is wrong. Format after the public JVM specification, chapter 4."""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field

from bytelake.sources.opcodes import decode as decode_code

MAGIC = 0xCAFEBABE
#: Constant pool tags (fixed values): name, and the layout of the body. u: a UTF-8 string; 1 and 2: indices; k: a kind and an index.
TAGS = {
    1: ("Utf8", "u"), 3: ("Integer", ">i"), 4: ("Float", ">I"), 5: ("Long", ">q"), 6: ("Double", ">Q"), 7: ("Class", "1"), 8: ("String", "1"), 9: ("Fieldref", "2"),
    10: ("Methodref", "2"), 11: ("InterfaceMethodref", "2"), 12: ("NameAndType", "2"), 15: ("MethodHandle", "k"), 16: ("MethodType", "1"), 17: ("Dynamic", "2"), 18: ("InvokeDynamic", "2"), 19: ("Module", "1"), 20: ("Package", "1"),
}
#: Verification types of stack map frames (fixed values).
VERIFICATION = ("top", "int", "float", "double", "long", "null", "uninitializedThis", "object", "uninitialized")
#: Annotation values nest no deeper.
DEPTH = 32


class Fatal(ValueError):
    """Nothing can be read after this."""


def mutf8(raw: bytes) -> str:
    """Modified UTF-8: NUL takes two bytes, and characters beyond the basic plane are pairs of three-byte surrogates. Raises UnicodeDecodeError; an unpaired surrogate comes back as U+FFFD."""
    if raw.isascii():
        if b"\x00" in raw:
            raise UnicodeDecodeError("mutf-8", raw, raw.index(0), raw.index(0) + 1, "a plain zero")
        return raw.decode("ascii")
    if b"\x00" in raw or any(b >= 0xF0 for b in raw):
        raise UnicodeDecodeError("mutf-8", raw, 0, 1, "a byte that the form does not use")
    text = raw.replace(b"\xc0\x80", b"\x00").decode("utf-8", "surrogatepass")
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class Cursor:
    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def take(self, n: int) -> bytes:
        if self.at + n > self.end:
            raise EOFError(f"{n} bytes wanted, {self.end - self.at} left")
        self.at += n
        return self.data[self.at - n : self.at]

    def u1(self) -> int:
        return self.take(1)[0]

    def u2(self) -> int:
        return int.from_bytes(self.take(2), "big")

    def u4(self) -> int:
        return int.from_bytes(self.take(4), "big")

    def u2s(self, n: int) -> tuple[int, ...]:
        return struct.unpack(f">{n}H", self.take(2 * n))


@dataclass
class Rows:
    """What a class file holds, by table."""

    root: dict = field(default_factory=dict)
    tables: dict[str, list[dict]] = field(default_factory=lambda: {name: [] for name in ("cp", "interfaces", "fields", "methods", "insns", "handlers", "lines", "lvt", "lvtt", "frames", "inner", "bootstrap", "annotations", "diagnostics")})

    def add(self, table: str, **row) -> None:
        self.tables[table].append(row)

    def note(self, severity: str, offset: int, message: str) -> None:
        self.add("diagnostics", seq=len(self.tables["diagnostics"]), severity=severity, offset=offset, message=message)


class Decoder:
    def __init__(self, data: bytes):
        self.c, self.rows, self.utf8 = Cursor(data), Rows(), {}

    def run(self) -> Rows:
        try:
            self._class()
            self.rows.root["status"] = "ok"
        except (EOFError, Fatal) as e:
            self.rows.note("fatal", self.c.at, str(e))
            self.rows.root["status"] = "fatal"
        return self.rows

    def _class(self) -> None:
        c, root = self.c, self.rows.root
        if c.u4() != MAGIC:
            raise Fatal("not a class file")
        root["minor"], root["major"] = c.u2(), c.u2()
        self._pool()
        root["access"], root["this_idx"], root["super_idx"] = c.u2(), c.u2(), c.u2()
        for k, idx in enumerate(c.u2s(c.u2())):
            self.rows.add("interfaces", seq=k, cp=idx)
        for kind in ("field", "method"):
            for seq in range(c.u2()):
                self._member(kind, seq)
        for name, body in self._attributes(c, "class"):
            self._class_attribute(name, body)
        if c.at < c.end:
            self.rows.note("warning", c.at, f"{c.end - c.at} bytes after the end")

    # -- constant pool

    def _pool(self) -> None:
        c, count, k = self.c, self.c.u2(), 1
        entry = lambda idx, **x: self.rows.add("cp", **({"idx": idx, "tag": None, "kind": None, "status": "present"} | x))
        entry(0, status="missing")
        while k < count:
            at = c.at
            try:
                tag = c.u1()
                kind, layout = TAGS.get(tag, (None, ""))
                if kind is None:  # its size is not known: only the tag is passed over
                    entry(k, tag=tag, status="malformed", reason=f"unknown tag {tag}")
                    self.rows.note("error", at, f"constant {k}: unknown tag {tag}")
                elif layout == "u":
                    raw = c.take(c.u2())
                    try:
                        self.utf8[k] = mutf8(raw)
                        entry(k, tag=tag, kind=kind, utf8=self.utf8[k])
                    except UnicodeDecodeError as e:
                        entry(k, tag=tag, kind=kind, status="malformed", reason=e.reason)
                        self.rows.note("warning", at, f"constant {k}: not modified UTF-8: {e.reason}")
                elif layout == "1":
                    entry(k, tag=tag, kind=kind, ref1=c.u2())
                elif layout == "2":
                    entry(k, tag=tag, kind=kind, ref1=c.u2(), ref2=c.u2())
                elif layout == "k":
                    entry(k, tag=tag, kind=kind, handle=c.u1(), ref1=c.u2())
                else:
                    value = struct.unpack(layout, c.take(struct.calcsize(layout)))[0]
                    if kind in ("Float", "Double"):
                        real = struct.unpack(layout.replace("I", "f").replace("Q", "d"), struct.pack(layout, value))[0]
                        entry(k, tag=tag, kind=kind, bits=value - (1 << 64) if value >> 63 else value, real=real)
                    else:
                        entry(k, tag=tag, kind=kind, integer=value)
            except EOFError as e:
                self.rows.note("fatal", at, f"constant {k} is cut off")
                for j in range(k, count):
                    entry(j, status="missing", reason="cut off")
                raise Fatal("the constant pool is cut off") from e
            k += 1
            if kind in ("Long", "Double") and k < count:
                entry(k, status="missing", reason="second half")
                k += 1

    # -- members and attributes

    def _attributes(self, c: Cursor, owner: str):
        """(name, cursor over the body) of each; the cursor c is then after it, whatever the reader of the body did."""
        for _ in range(c.u2()):
            name, size = self.utf8.get(c.u2()), c.u4()
            start = c.at
            if start + size > c.end:
                raise EOFError(f"attribute {name} of a {owner} is cut off")
            c.at = start + size
            yield name, Cursor(c.data, start, start + size)

    def _guarded(self, body: Cursor, what: str, read, severity: str = "warning"):
        """read(body), or None and a note where the body ends too early."""
        try:
            return read(body)
        except (EOFError, struct.error, RecursionError) as e:
            self.rows.note(severity, body.at, f"{what} is cut off: {e}")
            return None

    def _member(self, kind: str, seq: int) -> None:
        c = self.c
        row = {"seq": seq, "access": c.u2(), "name_idx": c.u2(), "desc_idx": c.u2(), "sig_idx": None, "deprecated": False}
        row |= {"const_idx": None} if kind == "field" else {"throws": [], "max_stack": None, "max_locals": None, "code": None}
        for name, body in self._attributes(c, kind):
            if name == "Signature":
                row["sig_idx"] = self._guarded(body, name, Cursor.u2)
            elif name == "Deprecated":
                row["deprecated"] = True
            elif name == "ConstantValue" and kind == "field":
                row["const_idx"] = self._guarded(body, name, Cursor.u2)
            elif name == "Exceptions" and kind == "method":
                row["throws"] = list(self._guarded(body, name, lambda b: b.u2s(b.u2())) or ())
            elif name == "Code" and kind == "method":
                self._code(row, seq, body)
            elif name in ("RuntimeVisibleAnnotations", "RuntimeInvisibleAnnotations"):
                self._annotations(kind, seq, name, body)
        self.rows.add(f"{kind}s", **row)

    def _class_attribute(self, name: str | None, body: Cursor) -> None:
        rows = self.rows
        if name == "Signature":
            rows.root["sig_idx"] = self._guarded(body, name, Cursor.u2)
        elif name == "SourceFile":
            rows.root["source_idx"] = self._guarded(body, name, Cursor.u2)
        elif name == "Deprecated":
            rows.root["deprecated"] = True
        elif name == "InnerClasses":
            for row in self._guarded(body, name, lambda b: [b.u2s(4) for _ in range(b.u2())]) or ():
                rows.add("inner", **dict(zip(("inner_idx", "outer_idx", "name_idx", "access"), row, strict=True)))
        elif name == "BootstrapMethods":
            for seq, (method, args) in enumerate(self._guarded(body, name, lambda b: [(b.u2(), b.u2s(b.u2())) for _ in range(b.u2())]) or ()):
                rows.add("bootstrap", seq=seq, method_idx=method, args=list(args))
        elif name in ("RuntimeVisibleAnnotations", "RuntimeInvisibleAnnotations"):
            self._annotations("class", 0, name, body)

    def _code(self, row: dict, method: int, body: Cursor) -> None:
        rows = self.rows
        try:
            row["max_stack"], row["max_locals"] = body.u2(), body.u2()
            start = body.at + 4
            code = body.take(body.u4())
        except EOFError as e:
            rows.note("error", body.at, f"code of method {method} is cut off: {e}")
            return
        row["code"] = code
        insns, notes = decode_code(code)
        for x in insns:
            rows.add("insns", method=method, **x)
        for severity, pc, message in notes:
            rows.note(severity, start + pc, f"method {method}: {message}")
        try:
            for seq in range(body.u2()):
                s, e, h, t = body.u2s(4)
                rows.add("handlers", method=method, seq=seq, start_pc=s, end_pc=e, handler_pc=h, catch_idx=t)
            for name, b in self._attributes(body, "code"):
                if name == "LineNumberTable":
                    for pc, line in sorted(self._guarded(b, name, lambda b: [b.u2s(2) for _ in range(b.u2())]) or ()):
                        rows.add("lines", method=method, pc=pc, line=line)
                elif name in ("LocalVariableTable", "LocalVariableTypeTable"):
                    for s, n, i, d, slot in self._guarded(b, name, lambda b: [b.u2s(5) for _ in range(b.u2())]) or ():
                        rows.add("lvt" if name == "LocalVariableTable" else "lvtt", method=method, slot=slot, start_pc=s, length=n, name_idx=i, type_idx=d)
                elif name == "StackMapTable":
                    for f in self._guarded(b, name, self._frames) or ():
                        rows.add("frames", method=method, **f)
        except EOFError as e:
            rows.note("warning", body.at, f"tables of method {method} are cut off: {e}")

    def _frames(self, b: Cursor) -> list[dict]:
        def types(n: int) -> list[dict]:
            out = []
            for _ in range(n):
                t = b.u1()
                if t >= len(VERIFICATION):
                    raise EOFError(f"verification type {t}")
                out.append({"type": VERIFICATION[t], "cp": b.u2() if t == 7 else None, "pc": b.u2() if t == 8 else None})
            return out

        out, pc = [], -1
        for seq in range(b.u2()):
            t = b.u1()
            row = {"seq": seq, "kind": "same", "chop": 0, "locals": [], "stack": []}
            if t < 64:
                delta = t
            elif t < 128:
                row |= {"kind": "stack1", "stack": types(1)}
                delta = t - 64
            elif t < 247:
                raise EOFError(f"reserved frame type {t}")
            else:
                delta = b.u2()
                if t == 247:
                    row |= {"kind": "stack1", "stack": types(1)}
                elif t < 251:
                    row |= {"kind": "chop", "chop": 251 - t}
                elif t > 251:
                    row |= {"kind": "append", "locals": types(t - 251)} if t < 255 else {"kind": "full", "locals": types(b.u2()), "stack": types(b.u2())}
            pc += delta + 1  # the first frame lies at its delta, each other one further than its delta from the last
            out.append(row | {"delta": delta, "pc": pc})
        return out

    # -- annotations

    def _annotations(self, owner: str, seq: int, attribute: str, body: Cursor) -> None:
        """All that could be read before the table ends or breaks."""
        try:
            for k in range(body.u2()):
                value = self._annotation(body, 0)
                self.rows.add("annotations", owner=owner, owner_seq=seq, visible=attribute == "RuntimeVisibleAnnotations", seq=k, type=value["type"], value=json.dumps(value, ensure_ascii=False))
        except (EOFError, KeyError, RecursionError) as e:
            self.rows.note("warning", body.at, f"annotations of {owner} {seq} are cut off: {e}")

    def _annotation(self, b: Cursor, depth: int) -> dict:
        kind = self.utf8.get(b.u2())
        return {"type": kind, "values": [[self.utf8.get(b.u2()), self._value(b, depth + 1)] for _ in range(b.u2())]}

    def _value(self, b: Cursor, depth: int) -> dict:
        if depth > DEPTH:
            raise EOFError("nested too deep")
        tag = chr(b.u1())
        if tag in "BCDFIJSZ":
            row = self._entry(b.u2())
            v = row.get("integer", row.get("real"))
            return {"tag": tag, "value": str(v) if isinstance(v, float) else v}
        if tag == "s":
            idx = b.u2()
            row = self._entry(idx)
            return {"tag": tag, "value": self.utf8.get(row["ref1"] if row.get("kind") == "String" else idx)}
        if tag == "e":
            return {"tag": tag, "type": self.utf8.get(b.u2()), "value": self.utf8.get(b.u2())}
        if tag == "c":
            return {"tag": tag, "value": self.utf8.get(b.u2())}
        if tag == "@":
            return {"tag": tag, "value": self._annotation(b, depth)}
        if tag == "[":
            return {"tag": tag, "value": [self._value(b, depth + 1) for _ in range(b.u2())]}
        raise EOFError(f"unknown element tag {tag!r}")

    def _entry(self, idx: int) -> dict:
        pool = self.rows.tables["cp"]
        return pool[idx] if idx < len(pool) else {}


def decode(data: bytes) -> Rows:
    """Rows of a class file. Never fails: a file that cannot be read has status fatal and what was read before."""
    return Decoder(data).run()

"""A decoded class as the reconstruction sees it: the pool by index, members, attributes."""

from __future__ import annotations

import struct
from functools import cached_property

from bytelake.functions.signatures import Malformed, MethodSignature, bound, class_type, field_type, method_types, variable_names
from bytelake.recon.expr import E, const, real_literal


class View:
    """row: one row of the decoded table, as Python values."""

    def __init__(self, row: dict):
        self.row = row
        self.pool = {c["idx"]: c for c in row["cp"]}
        self.name = self.class_name(row.get("this_idx"))
        self.super_name = self.class_name(row.get("super_idx")) if row.get("super_idx") else None
        self.access = row.get("access") or 0

    def utf8(self, idx: int | None) -> str | None:
        return (self.pool.get(idx) or {}).get("utf8")

    def class_name(self, idx: int | None) -> str:
        """Dotted; arrays as Java writes them."""
        text = self.utf8((self.pool.get(idx) or {}).get("ref1"))
        if text is None:
            return f"class#{idx}"
        if text.startswith("["):
            try:
                return field_type(text)
            except Malformed:
                return text
        return text.replace("/", ".")

    def pair(self, idx: int | None) -> tuple[str | None, str | None]:
        c = self.pool.get(idx) or {}
        return self.utf8(c.get("ref1")), self.utf8(c.get("ref2"))

    def ref(self, idx: int) -> tuple[str, str, str]:
        """Owner, name and descriptor of a member."""
        c = self.pool.get(idx) or {}
        name, desc = self.pair(c.get("ref2"))
        kind = "field" if c.get("kind") == "Fieldref" else "method"
        return self.class_name(c.get("ref1")), name or f"{kind}#{idx}", desc or ("Ljava/lang/Object;" if kind == "field" else "()V")

    def constant(self, idx: int) -> E:
        c = self.pool.get(idx) or {}
        k = c.get("kind")
        if k == "String":
            return E("string", text=self.utf8(c["ref1"]) or f"ldc#{idx}", type="java.lang.String")
        if k == "Class":
            return E("class", text=self.class_name(idx), type="java.lang.Class")
        if k == "Integer":
            return const(str(c["integer"]), "int")
        if k == "Long":
            return const(f"{c['integer']}L", "long")
        if k in ("Float", "Double"):
            kind = k.lower()
            bits = c["bits"] & (0xFFFFFFFF if kind == "float" else (1 << 64) - 1)
            return const(real_literal(struct.unpack(">f" if kind == "float" else ">d", bits.to_bytes(4 if kind == "float" else 8, "big"))[0], kind), kind)
        return const(f"/* ldc#{idx} */ null", "java.lang.Object")

    @cached_property
    def variables(self) -> frozenset[str]:
        """Type variables that the class declares."""
        text = self.utf8(self.row.get("sig_idx"))
        try:
            return frozenset(variable_names(class_type(text).variables)) if text else frozenset()
        except Malformed:
            return frozenset()

    def types(self, row: dict) -> MethodSignature:
        """A method's generic types, with the type variables that it or the class declares."""
        t = method_types(self.utf8(row["desc_idx"]) or "()V", self.utf8(row["sig_idx"]))
        known = self.variables | set(variable_names(t.variables))
        return MethodSignature([bound(p, known) for p in t.parameters], bound(t.result, known), [bound(x, known) for x in t.throws], t.variables)

    @cached_property
    def by_method(self) -> dict[str, dict[int, list[dict]]]:
        out: dict[str, dict[int, list[dict]]] = {}
        for table in ("insns", "handlers", "lvt", "lvtt"):
            rows: dict[int, list[dict]] = {}
            for x in self.row[table]:
                rows.setdefault(x["method"], []).append(x)
            out[table] = rows
        return out

    @cached_property
    def method_index(self) -> dict[tuple[str | None, str | None], dict]:
        return {(self.utf8(m["name_idx"]), self.utf8(m["desc_idx"])): m for m in self.row["methods"]}

    def annotations(self, owner: str, seq: int) -> list[dict]:
        return [a for a in self.row["annotations"] if a["owner"] == owner and a["owner_seq"] == seq]

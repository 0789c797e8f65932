"""Descriptors and generic signatures of the class file format as Java types."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from bytelake.functions.names import PRIMITIVES

#: Signatures nest no deeper.
DEPTH = 64


class Malformed(ValueError):
    pass


@dataclass
class MethodSignature:
    parameters: list[str]
    result: str
    throws: list[str] = field(default_factory=list)
    variables: list[str] = field(default_factory=list)


@dataclass
class ClassSignature:
    super_name: str
    interfaces: list[str]
    variables: list[str] = field(default_factory=list)


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self, want: str = "") -> str:
        c = self.peek()
        if not c or want and c != want:
            raise Malformed(f"{want or 'more'} wanted at {self.at} of {self.text!r}")
        self.at += 1
        return c

    def until(self, ends: str) -> str:
        start = self.at
        while self.peek() and self.peek() not in ends:
            self.at += 1
        if not self.peek():
            raise Malformed(f"no end of a name in {self.text!r}")
        return self.text[start : self.at]

    def type(self, depth: int = 0) -> str:
        if depth > DEPTH:
            raise Malformed("nested too deep")
        c = self.take()
        if c == "[":
            return self.type(depth + 1) + "[]"
        if c in PRIMITIVES:
            return PRIMITIVES[c]
        if c == "T":
            name = self.until(";")
            self.take(";")
            return name
        if c != "L":
            raise Malformed(f"no type at {self.at - 1} of {self.text!r}")
        out = self.until("<.;").replace("/", ".")
        while True:
            if self.peek() == "<":
                out += self.arguments(depth)
            elif self.peek() == ".":
                self.take()
                out = erased(out) + "$" + self.until("<.;")  # the class file's own name; the outer class's arguments are implied
            else:
                self.take(";")
                return out

    def arguments(self, depth: int) -> str:
        self.take("<")
        out = []
        while self.peek() != ">":
            if self.peek() == "*":
                self.take()
                out.append("?")
            elif self.peek() in ("+", "-"):
                out.append({"+": "? extends ", "-": "? super "}[self.take()] + self.type(depth + 1))
            else:
                out.append(self.type(depth + 1))
        self.take(">")
        return f"<{', '.join(out)}>"

    def variables(self) -> list[str]:
        out = []
        if self.peek() != "<":
            return out
        self.take("<")
        while self.peek() != ">":
            name, bounds = self.until(":"), []
            while self.peek() == ":":
                self.take(":")
                if self.peek() == ":":  # no class bound
                    continue
                bounds.append(self.type())
            shown = [b for k, b in enumerate(bounds) if k or b != "java.lang.Object" or len(bounds) > 1]
            out.append(name + (f" extends {' & '.join(shown)}" if shown else ""))
        self.take(">")
        return out

    def done(self) -> None:
        if self.at != len(self.text):
            raise Malformed(f"more than a signature: {self.text!r}")


def field_type(text: str) -> str:
    """The type of a field descriptor or signature."""
    p = _Parser(text)
    out = p.type()
    p.done()
    return out


def method_type(text: str) -> MethodSignature:
    """Of a method descriptor or signature."""
    p = _Parser(text)
    variables, parameters, throws = p.variables(), [], []
    p.take("(")
    while p.peek() != ")":
        parameters.append(p.type())
    p.take(")")
    result = p.type()
    while p.peek() == "^":
        p.take()
        throws.append(p.type())
    p.done()
    return MethodSignature(parameters, result, throws, variables)


def class_type(text: str) -> ClassSignature:
    p = _Parser(text)
    variables, super_name, faces = p.variables(), p.type(), []
    while p.peek():
        faces.append(p.type())
    return ClassSignature(super_name, faces, variables)


def erased(text: str) -> str:
    """A type without its arguments."""
    out, depth = [], 0
    for c in text:
        depth += (c == "<") - (c == ">")
        if not depth and c != ">":
            out.append(c)
    return "".join(out)


def method_types(descriptor: str, signature: str | None) -> MethodSignature:
    """The generic signature where it is sound and has as many parameters as the descriptor, else the descriptor's types."""
    plain = method_type(descriptor)
    if signature:
        try:
            rich = method_type(signature)
        except Malformed:
            return plain
        if len(rich.parameters) == len(plain.parameters):
            return rich
    return plain


def field_types(descriptor: str, signature: str | None) -> str:
    try:
        return field_type(signature) if signature else field_type(descriptor)
    except Malformed:
        return field_type(descriptor)


def bound(text: str, declared: frozenset[str] | set[str]) -> str:
    """A type in which type variables that nothing here declares (those of an outer class, say) are Object."""
    return _NAME.sub(lambda m: m[0] if "." in m[0] or m[0] in declared or m[0] in _WORDS else "java.lang.Object", text)


_NAME = re.compile(r"[\w$.]+")
_WORDS = frozenset([*PRIMITIVES.values(), "extends", "super"])


def variable_names(variables: list[str]) -> list[str]:
    return [v.split(" ")[0] for v in variables]

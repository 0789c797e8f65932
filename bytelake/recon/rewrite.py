"""Rewrites of reconstructed statements, in a fixed order: monitors, resources, loops, declarations, types."""

from __future__ import annotations

from bytelake.functions.signatures import erased
from bytelake.recon.expr import E, as_boolean, coerce, const, negate, render, short
from bytelake.recon.stmt import S, ends, lines, map_blocks


def finish(block: list[S], body) -> list[S]:
    """All rewrites; body: the method they are of."""
    for f in (fold_monitors, fold_resources, cut_dead, merge_guards, flatten_else, fold_for_each, fold_counted):
        block = map_blocks(block, f)
    block = [_simplified(s) for s in block]
    if block and block[-1].kind == "return" and not block[-1].exprs:
        block.pop()
    parameters = {n for _, n in body.parameters}
    declare(block, parameters | {"this"})
    return block


def fold_monitors(block: list[S]) -> list[S]:
    """An enter, and a try whose finally is the exit, are a synchronized block. Lone enters and exits become comments."""
    out, k = [], 0
    while k < len(block):
        s = block[k]
        if s.kind == "enter":
            lock, after = s.exprs[0], k + 1
            if out and out[-1].kind == "assign" and out[-1].exprs[0].kind == "var" and lock.kind == "assign" and lock.args[0].text == out[-1].exprs[0].text:
                lock = out.pop().exprs[1]
            if lock.kind == "assign":
                lock = lock.args[1]
            elif out and out[-1].kind == "assign" and out[-1].exprs[0].kind == "var" and render(out[-1].exprs[1]) == render(lock):
                lock = out.pop().exprs[1]
            elif out and out[-1].kind == "assign" and out[-1].exprs[0].kind == "var" and lock.kind == "var" and out[-1].exprs[0].text == lock.text:
                lock = out.pop().exprs[1]
            nxt = block[after] if after < len(block) else None
            if nxt is not None and nxt.kind == "try" and nxt.more == ["finally"] and all(x.kind == "exit" for x in nxt.blocks[1]):
                out.append(S("sync", [lock], [_no_exits(nxt.blocks[0])], pc=s.pc))
                k += 2
                continue
            out.append(S("sync", [lock], [_no_exits(block[after:])], pc=s.pc))
            return out
        out.append(s)
        k += 1
    return [x for x in out if x.kind != "exit"]


def _no_exits(block: list[S]) -> list[S]:
    for s in block:
        s.blocks = [_no_exits(b) for b in s.blocks]
    return [s for s in block if s.kind != "exit"]


def _closes(block: list[S], name: str) -> bool:
    """The block closes this variable, maybe behind a null check."""
    if len(block) == 1 and block[0].kind == "if" and len(block[0].blocks) == 1 and render(block[0].exprs[0]) == f"{name} != null":
        block = block[0].blocks[0]
    return len(block) == 1 and block[0].kind == "expr" and render(block[0].exprs[0]) == f"{name}.close()"


def fold_resources(block: list[S]) -> list[S]:
    """x = ...; try { ... } catch (Throwable t) { try { x.close() } catch (Throwable s) { t.addSuppressed(s) } throw t } x.close() is try (x = ...) { ... }."""
    out: list[S] = []
    k = 0
    while k < len(block):
        s = block[k]
        if s.kind == "try" and len(s.blocks) == 2 and s.more[0].startswith("Throwable ") and out and out[-1].kind == "assign" and out[-1].exprs[0].kind == "var" and not s.text:
            caught, name = s.more[0].split(" ", 1)[1], out[-1].exprs[0].text
            handler = s.blocks[1]
            if len(handler) == 2 and handler[1].kind == "throw" and render(handler[1].exprs[0]) == caught:
                inner = handler[0]
                if inner.kind == "if" and len(inner.blocks) == 1 and render(inner.exprs[0]) == f"{name} != null" and len(inner.blocks[0]) == 1:
                    inner = inner.blocks[0][0]
                if inner.kind == "try" and len(inner.blocks) == 2 and _closes(inner.blocks[0], name) and [render(x.exprs[0]) for x in inner.blocks[1] if x.kind == "expr"] == [f"{caught}.addSuppressed({inner.more[0].split(' ', 1)[1]})"]:
                    first = out.pop()
                    content = _unclosed(s.blocks[0], name)
                    if k + 1 < len(block) and _closes([block[k + 1]], name):
                        k += 1
                    target = first.exprs[0]
                    out.append(S("try", [first.exprs[1]], [content], f"{short(target.type)} {name} = {render(first.exprs[1], 1)}", [], s.pc))
                    k += 1
                    continue
        out.append(s)
        k += 1
    return out


def _unclosed(block: list[S], name: str) -> list[S]:
    for s in block:
        s.blocks = [_unclosed(b, name) for b in s.blocks]
    return [s for k, s in enumerate(block) if not (_closes([s], name) and (k + 1 == len(block) or block[k + 1].kind in ("return", "break", "continue")))]


def cut_dead(block: list[S]) -> list[S]:
    """Nothing stands behind the end of control; branches on constants are gone."""
    out = []
    for s in block:
        if s.kind == "if" and s.exprs[0].kind == "const" and s.exprs[0].text in ("true", "false"):
            out += s.blocks[0] if s.exprs[0].text == "true" else (s.blocks[1] if len(s.blocks) > 1 else [])
        else:
            out.append(s)
        if out and ends(out[-1:]):
            break
    return out


def merge_guards(block: list[S]) -> list[S]:
    """if (a) { if (b) { ... } } is if (a && b) { ... }; two guards in a row with one body are one."""
    out: list[S] = []
    for s in block:
        while s.kind == "if" and len(s.blocks) == 1 and len(s.blocks[0]) == 1 and s.blocks[0][0].kind == "if" and len(s.blocks[0][0].blocks) == 1:
            inner = s.blocks[0][0]
            s = S("if", [E("bin", [s.exprs[0], inner.exprs[0]], "&&", "boolean")], inner.blocks, pc=s.pc)
        before = out[-1] if out else None
        if s.kind == "if" and before is not None and before.kind == "if" and len(s.blocks) == len(before.blocks) == 1 and ends(s.blocks[0]) and lines(s.blocks[0]) == lines(before.blocks[0]):
            out[-1] = S("if", [E("bin", [before.exprs[0], s.exprs[0]], "||", "boolean")], s.blocks, pc=before.pc)
            continue
        out.append(s)
    return out


def flatten_else(block: list[S]) -> list[S]:
    """if (a) { ...return } else { b } b2 needs no else where the first branch ends control and the second is long."""
    out: list[S] = []
    for s in block:
        if s.kind == "if" and len(s.blocks) == 2 and ends(s.blocks[0]) and not (len(s.blocks[1]) == 1 and s.blocks[1][0].kind == "if"):
            out += [S("if", s.exprs, s.blocks[:1], pc=s.pc), *s.blocks[1]]
        elif s.kind == "if" and len(s.blocks) == 2 and ends(s.blocks[1]) and not ends(s.blocks[0]):
            out += [S("if", [negate(s.exprs[0])], [s.blocks[1]], pc=s.pc), *s.blocks[0]]
        else:
            out.append(s)
    return out


def _uses(stmts: list[S], name: str) -> int:
    return sum(e.kind == "var" and e.text == name for s in stmts for e in s.expressions())


def fold_for_each(block: list[S]) -> list[S]:
    """it = x.iterator(); while (it.hasNext()) { v = (T) it.next(); ... } is for (T v : x); and the like over a copied array with an index."""
    out: list[S] = []
    for k, s in enumerate(block):
        made = None
        if s.kind == "while" and out and s.blocks[0] and not s.more:
            first, cond = s.blocks[0][0], s.exprs[0]
            if out[-1].kind == "assign" and out[-1].exprs[0].kind == "var" and cond.kind == "call" and cond.text == "hasNext" and cond.args[0].kind == "var":
                it, source = out[-1].exprs
                value = first.exprs[1] if first.kind == "assign" and first.exprs[0].kind == "var" else None
                cast = value.type if value is not None and value.kind == "cast" else None
                call = value.args[0] if cast else value
                if (
                    call is not None and call.kind == "call" and call.text == "next" and call.args and call.args[0].kind == "var" and call.args[0].text == it.text == cond.args[0].text
                    and source.kind == "call" and source.text == "iterator" and len(source.args) == 1 and _uses(s.blocks[0][1:], it.text) == 0 and _uses(block[k + 1 :], it.text) == 0
                ):
                    target = first.exprs[0]
                    kind = target.type if target.type != "java.lang.Object" or not cast else cast
                    out.pop()
                    over = source.args[0] if source.more is None else E("var", text="this", type="java.lang.Object")
                    made = S("foreach", [over], [s.blocks[0][1:]], target.text, kind, s.pc)
            elif len(out) >= 3 and cond.kind == "bin" and cond.text == "<" and cond.args[0].kind == cond.args[1].kind == "var":
                a, n, i = out[-3:]
                update = s.blocks[0][-1]
                if (
                    all(x.kind == "assign" and x.exprs[0].kind == "var" for x in (a, n, i)) and n.exprs[1].kind == "length" and render(n.exprs[1].args[0]) == a.exprs[0].text and render(i.exprs[1]) == "0"
                    and cond.args[0].text == i.exprs[0].text and cond.args[1].text == n.exprs[0].text and first.kind == "assign" and first.exprs[1].kind == "array" and render(first.exprs[1]) == f"{a.exprs[0].text}[{i.exprs[0].text}]"
                    and update.kind == "assign" and lines([update]) == [f"{i.exprs[0].text}++;"] and not any(_uses(s.blocks[0][1:-1], x.exprs[0].text) + _uses(block[k + 1 :], x.exprs[0].text) * 0 for x in (a, n, i)) and first.exprs[0].kind == "var"
                ):
                    del out[-3:]
                    made = S("foreach", [a.exprs[1]], [s.blocks[0][1:-1]], first.exprs[0].text, first.exprs[0].type if first.exprs[0].type != "java.lang.Object" else first.exprs[1].type, s.pc)
        out.append(made or s)
    return out


def _own_continue(block: list[S]) -> bool:
    """A continue of this very loop."""
    return any(s.kind == "continue" and not s.text or s.kind not in ("while", "dowhile", "for", "foreach") and any(_own_continue(b) for b in s.blocks) for s in block)


def fold_counted(block: list[S]) -> list[S]:
    """i = a; while (i < b) { ...; i++ } is a for, if only the update changes i and no continue passes over it."""
    out: list[S] = []
    for s in block:
        if s.kind == "while" and not s.more and out and out[-1].kind == "assign" and out[-1].exprs[0].kind == "var" and s.blocks[0]:
            i, update = out[-1].exprs[0].text, s.blocks[0][-1]
            rest = s.blocks[0][:-1]
            own = update.kind == "assign" and update.exprs[0].kind == "var" and update.exprs[0].text == i and any(e.kind == "var" and e.text == i for e in update.exprs[1].walk())
            tested = any(e.kind == "var" and e.text == i for e in s.exprs[0].walk())
            changed = any(x.kind == "assign" and x.exprs[0].kind == "var" and x.exprs[0].text == i for r in rest for x in r.walk())
            if own and tested and not changed and not _own_continue(rest):
                first = out.pop()
                out.append(S("for", s.exprs, [rest], more=[first, update], pc=s.pc))
                continue
        out.append(s)
    return out


def _simplified(s: S) -> S:
    """Conditions as booleans, without double negations and comparisons of constants."""
    if s.kind in ("if", "while", "dowhile", "for"):
        s.exprs = [simplify(s.exprs[0])]
    s.blocks = [[_simplified(x) for x in b] for b in s.blocks]
    return s


def simplify(e: E) -> E:
    """A condition in its plainest form. Comparisons of reals are not turned around, as NaN makes either false."""
    if e.kind == "not":
        a = simplify(e.args[0])
        n = negate(a)
        return n if n.kind != "not" or n.args[0] is not a else E("not", [a], type="boolean")
    if e.kind == "bin" and e.text in ("&&", "||"):
        a, b = simplify(e.args[0]), simplify(e.args[1])
        for x, y in ((a, b), (b, a)):
            if x.kind == "const" and x.text in ("true", "false"):
                if (x.text == "true") == (e.text == "&&"):
                    return y
                if x is a:
                    return x
        return E("bin", [a, b], e.text, "boolean")
    if e.kind == "bin" and e.text in ("==", "!=", "<", ">", "<=", ">=") and all(a.kind == "const" and a.type == "int" for a in e.args):
        x, y = (int(a.text) for a in e.args)
        holds = {"==": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[e.text]
        return const("true" if holds else "false", "boolean")
    return as_boolean(e)


# -- declarations


def declare(block: list[S], known: set[str]) -> None:
    """Every variable is declared where it is first set, if all its uses are behind that in the same block; else before the statement that first uses it, in the innermost block that holds all uses."""
    names: dict[str, str] = {}
    for s in block:
        for x in s.walk():
            for t in [x, *(x.more if x.kind == "for" else [])]:
                if t.kind == "assign" and t.exprs[0].kind == "var":
                    names.setdefault(t.exprs[0].text, t.exprs[0].type)
            for e in x.exprs:
                for y in e.walk():
                    if y.kind == "assign" and y.args[0].kind == "var":
                        names.setdefault(y.args[0].text, y.args[0].type)
                    elif y.kind == "postinc" and y.args[0].kind == "var":
                        names.setdefault(y.args[0].text, y.args[0].type)
    bound = {x.text for s in block for x in s.walk() if x.kind == "foreach"}
    caught = {c.split(" ")[-1] for s in block for x in s.walk() if x.kind == "try" for c in x.more}
    for name, kind in names.items():
        if name not in known and name not in bound and name not in caught:
            _declare(block, name, kind)


def _mentions(s: S, name: str) -> bool:
    return any(e.kind == "var" and e.text == name for e in s.expressions())


def _own(s: S, name: str) -> bool:
    """Mentioned by the statement's own head."""
    return any(x.kind == "var" and x.text == name for e in s.exprs for x in e.walk()) or s.kind == "for" and any(_mentions(x, name) for x in s.more)


def _declare(block: list[S], name: str, kind: str) -> None:
    at = [k for k, s in enumerate(block) if _mentions(s, name)]
    if not at:
        return
    s = block[at[0]]
    inner = [b for b in s.blocks if any(_mentions(x, name) for x in b)]
    if len(at) == 1 and not _own(s, name) and len(inner) == 1:
        return _declare(inner[0], name, kind)
    if len(at) == 1 and not _own(s, name) and s.kind in ("if", "switch") and s.kind == "if":
        for b in inner:
            _declare(b, name, kind)
        return None
    if s.kind == "assign" and s.exprs[0].kind == "var" and s.exprs[0].text == name and not any(e.kind == "var" and e.text == name for e in s.exprs[1].walk()):
        block[at[0]] = S("declare", [_typed(s.exprs[1], kind)], [], name, kind, s.pc)
    elif s.kind == "for" and len(at) == 1 and s.more[0].kind == "assign" and s.more[0].exprs[0].text == name:
        s.more = [S("declare", [_typed(s.more[0].exprs[1], kind)], [], name, kind), s.more[1]]
    else:
        block.insert(at[0], S("declare", [], [], name, kind, s.pc))
    return None


def _typed(e: E, kind: str) -> E:
    if e.kind == "newarray" and e.more and kind.endswith("[]") and erased(kind) == e.type:
        return e
    return coerce(e, erased(kind))



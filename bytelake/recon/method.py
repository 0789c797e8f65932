"""A method's statements from its instructions: symbolic execution, and structure from the layout of the code.

Compilers lay out structured code in one piece, so a loop, a branch, a protected range or a switch arm is a range of
offsets. `run` works through a range; what stands at an offset (a loop's head, a range's start, a branch) decides which inner ranges
are worked through first. A goto is a break, a continue, or the way to what follows. Whatever fits none of these raises Unstructured, and the
method is given as a listing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from bytelake.functions.names import PRIMITIVES
from bytelake.functions.signatures import Malformed, bound, erased, field_type, method_type, variable_names
from bytelake.recon.expr import E, as_boolean, binary, coerce, const, impure, negate, reads_state, render, short, var
from bytelake.recon.stmt import S, choose, lines
from bytelake.recon.view import View
from bytelake.sources.opcodes import ARRAY_TYPES, NO_FALLTHROUGH, RETURNS

KINDS = {"i": "int", "l": "long", "f": "float", "d": "double", "a": "java.lang.Object", "b": "byte", "c": "char", "s": "short"}
ARITHMETIC = {"add": "+", "sub": "-", "mul": "*", "div": "/", "rem": "%", "shl": "<<", "shr": ">>", "ushr": ">>>", "and": "&", "or": "|", "xor": "^"}
COMPARE = {"eq": "==", "ne": "!=", "lt": "<", "ge": ">=", "gt": ">", "le": "<="}
CATEGORY = {"boolean": "int", "byte": "int", "char": "int", "short": "int", "int": "int", "long": "long", "float": "float", "double": "double"}
INTS = frozenset(["int", "short", "byte", "char", "boolean"])


class Unstructured(Exception):
    pass


@dataclass
class Frame:
    kind: str  # loop, switch
    breaks: frozenset[int]
    continues: frozenset[int] = frozenset()
    label: str = ""
    used: bool = False  # by a labelled jump


@dataclass
class Protected:
    start: int
    end: int
    handlers: list[tuple[int, str]]  # (pc, types)


@dataclass
class Result:
    block: list[S]
    parameters: list[tuple[str, str]] = field(default_factory=list)  # (type, name)
    structured: bool = True
    locals: list[tuple[int, int, str, str]] = field(default_factory=list)  # (pc, slot, name, type)


class Body:
    def __init__(self, view: View, row: dict, depth: int = 0):
        self.view, self.row, self.depth = view, row, depth
        self.insns = view.by_method["insns"].get(row["seq"], [])
        self.at = {x["pc"]: k for k, x in enumerate(self.insns)}
        self.end = self.insns[-1]["pc"] + self.insns[-1]["length"] if self.insns else 0
        self.static = bool(row["access"] & 8)
        self.descriptor = view.utf8(row["desc_idx"]) or "()V"
        self.type = method_type(self.descriptor)
        self.rich = view.types(row)
        self.variables = view.variables | set(variable_names(self.rich.variables))
        self.stack: list[E] = []
        self.frames: list[Frame] = []
        self.opened: set = set()
        self.temps = self.labels = self.budget = self.catching = 0
        self.seen_locals: list[tuple[int, int, str, str]] = []
        self._scopes()
        self._loops()
        self._ranges()

    # -- locals

    def _scopes(self) -> None:
        v, m = self.view, self.row["seq"]
        generic = {(x["slot"], x["start_pc"], x["length"]): v.utf8(x["type_idx"]) for x in v.by_method["lvtt"].get(m, [])}
        self.scopes: dict[int, list[tuple[int, int, str, str]]] = {}
        for x in v.by_method["lvt"].get(m, []):
            name, kind = v.utf8(x["name_idx"]), None
            for text in (generic.get((x["slot"], x["start_pc"], x["length"])), v.utf8(x["type_idx"])):
                try:
                    kind = kind or (bound(field_type(text), self.variables) if text else None)
                except Malformed:
                    pass
            if name and kind:
                self.scopes.setdefault(x["slot"], []).append((x["start_pc"], x["start_pc"] + x["length"], name, kind))
        self.current: dict[int, tuple[str, str]] = {}  # slot -> name and type, where there are no scopes
        self.versions: dict[int, int] = {}
        slot, self.parameters = 0, []
        if not self.static:
            self.current[0], slot = ("this", v.name), 1
        for k, kind in enumerate(self.rich.parameters):
            found = next((s for s in self.scopes.get(slot, []) if s[0] == 0), None)
            name = found[2] if found else f"arg{k}"
            self.parameters.append((kind, name))
            self.current[slot] = (name, kind)
            slot += 2 if kind in ("long", "double") else 1

    def local(self, slot: int, pc: int) -> E:
        for s, e, name, kind in self.scopes.get(slot, []):
            if s <= pc < e:
                if name == "this":
                    return E("var", text="this", type=self.view.name)
                self.seen_locals.append((pc, slot, name, kind))
                return var(name, kind)
        name, kind = self.current.get(slot, (f"var_{slot}", "java.lang.Object"))
        self.seen_locals.append((pc, slot, name, kind))
        return var(name, kind)

    def store_target(self, slot: int, pc: int, value: E, kind: str) -> E:
        """The variable that a store behind `pc` sets. Without a scope, one slot serves values of different kinds under different names."""
        for s, e, name, k in self.scopes.get(slot, []):
            if s <= pc < e:
                self.current[slot] = (name, k)
                return var(name, k)
        mine = value.type if kind == "java.lang.Object" else "int" if kind == "int" and value.type not in INTS else value.type if kind == "int" else kind
        if value.kind == "const" and value.text == "null":
            mine = "java.lang.Object"
        old = self.current.get(slot)
        known = old is not None and (old[0].startswith("var_") or slot < self._first_free() or old[1] == mine)
        if known and CATEGORY.get(old[1], "ref") == CATEGORY.get(mine, "ref") and (CATEGORY.get(mine, "ref") != "ref" or old[1] in (mine, "java.lang.Object") or mine == "java.lang.Object"):
            return var(*old)
        n = self.versions[slot] = self.versions.get(slot, -1) + 1
        self.current[slot] = (f"var_{slot}" + (f"_{n}" if n else ""), mine)
        return var(*self.current[slot])

    def _first_free(self) -> int:
        return (not self.static) + sum(2 if k in ("long", "double") else 1 for k in self.type.parameters)

    def temp(self, value: E, out: list[S]) -> E:
        name = f"tmp{self.temps}"
        self.temps += 1
        out.append(S("assign", [var(name, value.type), value]))
        return var(name, value.type)

    # -- layout

    def _loops(self) -> None:
        self.loops: dict[int, int] = {}
        self.sources: dict[int, list[int]] = {}
        for x in self.insns:
            for t in [x.get("target"), *(x.get("targets") or ()), x.get("default")]:
                if t is None:
                    continue
                if t not in self.at:
                    raise Unstructured(f"a jump into the middle of an instruction at {x['pc']}")
                self.sources.setdefault(t, []).append(x["pc"])
                if t <= x["pc"]:
                    self.loops[t] = max(self.loops.get(t, 0), x["pc"] + x["length"])

    def _ranges(self) -> None:
        v, by = self.view, {}
        for h in self.view.by_method["handlers"].get(self.row["seq"], []):
            if h["start_pc"] >= h["handler_pc"] or h["start_pc"] not in self.at or h["handler_pc"] not in self.at:
                continue  # a handler that guards itself
            kind = "any" if h["catch_idx"] == 0 else v.class_name(h["catch_idx"])
            by.setdefault((h["handler_pc"], kind == "any"), []).append((h["start_pc"], min(h["end_pc"], h["handler_pc"]), kind))
        ranges: dict[tuple[int, int], Protected] = {}
        for (pc, _), rows in sorted(by.items()):
            s, e = min(r[0] for r in rows), max(r[1] for r in rows)
            kinds = sorted({r[2] for r in rows})
            p = ranges.setdefault((s, e), Protected(s, e, []))
            p.handlers.append((pc, " | ".join(short(k) for k in kinds) if kinds != ["any"] else "any"))
        self.protected = sorted(ranges.values(), key=lambda p: (p.start, -p.end))

    def extent(self, pc: int, end: int) -> int:
        """Where code that starts at pc stops: behind the first instruction without fall-through that nothing jumps over."""
        far = pc
        for k in range(self.at[pc], len(self.insns)):
            x = self.insns[k]
            if x["pc"] >= end:
                break
            for t in [x.get("target"), *(x.get("targets") or ()), x.get("default")]:
                if t is not None and pc < t <= end:
                    far = max(far, t)
            for p in self.protected:
                if p.start == x["pc"] and p.start > pc:
                    far = max(far, max(h for h, _ in p.handlers))
            after = x["pc"] + x["length"]
            if x["op"] in NO_FALLTHROUGH and after > far:
                return after
        return end

    def before(self, pc: int) -> dict | None:
        k = self.at.get(pc, len(self.insns))
        return self.insns[k - 1] if k > 0 else None

    # -- structure

    def run(self, pc: int, end: int, out: list[S], follow: int) -> None:
        """Statements of [pc, end). Control that reaches the end goes on at `follow`."""
        while pc < end:
            self.budget += 1
            if self.budget > 40 * len(self.insns) + 1000:
                raise Unstructured("no end")
            if pc not in self.at:
                raise Unstructured(f"no instruction at {pc}")
            p = next((p for p in self.protected if p.start == pc and id(p) not in self.opened and p.handlers[0][0] < end + (end == follow == self.end)), None)
            if p is not None and all(h <= end for h, _ in p.handlers):
                pc = self.run_try(p, end, out, follow)
                continue
            if pc in self.loops and pc not in self.opened and self.loops[pc] <= end:
                pc = self.run_loop(pc, end, out, follow)
                continue
            x = self.insns[self.at[pc]]
            after = pc + x["length"]
            if x.get("default") is not None:
                pc = self.run_switch(x, end, out, follow)
            elif x["op"] == "goto":
                self.go(x["target"], after, end, out, follow)
                pc = after if x["target"] == after else end if after >= end else self.next_live(after, end)
            elif x.get("target") is not None:
                pc = self.run_branch(pc, end, out, follow)
            elif x["op"] == "dup" and (behind := self.null_check(x)):
                pc = behind
            else:
                self.execute(x, out)
                pc = after
                if x["op"] in NO_FALLTHROUGH and pc < end:
                    pc = self.next_live(pc, end)

    def null_check(self, dup: dict) -> int | None:
        """Behind dup, Objects.requireNonNull or getClass, pop: the check that compilers put before a method reference or a member class's constructor."""
        k = self.at[dup["pc"]]
        if k + 2 >= len(self.insns) or self.insns[k + 2]["op"] != "pop" or not self.insns[k + 1]["op"].startswith("invoke") or self.insns[k + 1].get("cp") is None:
            return None
        call = self.view.ref(self.insns[k + 1]["cp"])
        checks = (("java.util.Objects", "requireNonNull", "(Ljava/lang/Object;)Ljava/lang/Object;"), ("java.lang.Object", "getClass", "()Ljava/lang/Class;"))
        return self.insns[k + 2]["pc"] + 1 if call in checks else None

    def next_live(self, pc: int, end: int) -> int:
        """The next offset in [pc, end) that something jumps to, or end."""
        live = [t for t in self.sources if pc <= t < end] + [p.start for p in self.protected if pc <= p.start < end and any(pc <= s < end for s in (p.start,)) and p.start in self.sources]
        return min(live, default=end)

    def jump(self, target: int) -> list[S] | None:
        """A break or continue to the target."""
        loops = switches = 0
        for f in reversed(self.frames):
            if f.kind == "loop" and target in f.continues:
                if not loops:
                    return [S("continue")]
                return [S("continue", text=self.label(f))]
            if target in f.breaks:
                if not loops and not switches:
                    return [S("break")]
                return [S("break", text=self.label(f))]
            loops += f.kind == "loop"
            switches += f.kind == "switch"
        return None

    def label(self, f: Frame) -> str:
        if not f.label:
            f.label = f"label{self.labels}"
            self.labels += 1
        f.used = True
        return f.label

    def go(self, target: int, after: int, end: int, out: list[S], follow: int) -> None:
        if target == after or after >= end and target in (follow, end):
            return
        got = self.jump(target)
        if got is None:
            if target in (follow, end) and self.next_live(after, end) >= end:
                return
            raise Unstructured(f"a goto {target} that is neither a break nor a continue")
        self.flush(out)
        out += got

    def inner(self, pc: int, end: int, follow: int, stack: list[E]) -> tuple[list[S], list[E]]:
        """Statements of a range that starts with this stack, and the stack behind it."""
        keep, self.stack = self.stack, list(stack)
        current = dict(self.current)
        out: list[S] = []
        self.run(pc, end, out, follow)
        got, self.stack = self.stack, keep
        for k, v in current.items():
            self.current.setdefault(k, v)
        return out, got

    # -- branches

    def condition(self, x: dict) -> E:
        """What must hold for the branch to be taken; its operands leave the stack."""
        op = x["op"]
        if op.startswith("if_"):
            b, a = self.pop(), self.pop()
            c = COMPARE[op[-2:]]
            if a.type == "boolean" or b.type == "boolean":
                a, b = as_boolean(a), as_boolean(b)
            elif a.type == "char" and b.kind == "const":
                b = coerce(b, "char")
            return binary(c, a, b, "boolean")
        a = self.pop()
        if op in ("ifnull", "ifnonnull"):
            return binary("==" if op == "ifnull" else "!=", a, const("null", "null"), "boolean")
        c = COMPARE[op[2:]]
        if a.kind == "cmp":
            e = binary(c, *a.args, "boolean")
            e.more = a.more
            return e
        if c in ("==", "!="):
            e = as_boolean(a)
            if e.type == "boolean":
                return negate(e) if c == "==" else e
        return binary(c, a, const("0", "int"), "boolean")

    def chain(self, pc: int, end: int, last: int | None = None) -> tuple[E, int, int, list[E]]:
        """The branch at pc with those that follow it as one condition.

        Gives the condition under which control falls through behind the last branch, that branch's target, the offset behind it, and the
        stack there. last: only a chain whose last target this is will do.
        """
        keep, current, temps = list(self.stack), dict(self.current), self.temps
        base, found, start = len(keep), [], pc
        targets = []
        while True:
            x = self.insns[self.at[pc]]
            after = pc + x["length"]
            found.append((start, self.condition(x), x["target"], after))
            targets.append(list(self.stack))
            if len(self.stack) > base or x["target"] <= pc or after >= end or len(found) > 200:
                break
            # what lies between this branch and the next must only push
            start = pc = after
            quiet: list[S] = []
            ok = not any(s < found[0][0] or s >= pc for s in self.sources.get(pc, ())) or last is not None
            depth = len(self.stack)
            while ok and pc < end and pc in self.at:
                y = self.insns[self.at[pc]]
                if pc != start and (pc in self.sources) or pc in self.loops or any(p.start == pc and id(p) not in self.opened for p in self.protected):
                    ok = False
                elif y.get("default") is not None or y["op"] in NO_FALLTHROUGH:
                    ok = False
                elif y.get("target") is not None:
                    break
                else:
                    try:
                        self.execute(y, quiet)
                    except Unstructured:
                        ok = False
                    ok = ok and not quiet and len(self.stack) >= depth - 0
                    pc += y["length"]
            if not ok or pc >= end or pc not in self.at:
                break
        for n in range(len(found), 0, -1):
            target, behind = found[n - 1][2], found[n - 1][3]
            starts = {s: k for k, (s, _, _, _) in enumerate(found[:n])}
            if last is not None and target != last:
                continue
            if all(t in (target, behind) or starts.get(t, -1) > k for k, (_, _, t, _) in enumerate(found[: n - 1])) and (n == 1 or target != behind):
                if n > 1 and any(s not in [self.before(a)["pc"] for _, _, _, a in found[:n]] for k in range(1, n) for s in self.sources.get(found[k][0], ())):
                    continue  # something else jumps into the chain
                self.stack, self.current, self.temps = targets[n - 1], current, temps
                return self._joined(found[:n], starts, target, behind), target, behind, targets[n - 1]
        self.stack, self.current, self.temps = keep, current, temps
        raise Unstructured(f"no condition at {found[0][0]}")

    def _joined(self, found: list, starts: dict[int, int], target: int, behind: int) -> E:
        memo: dict[int, E] = {}
        yes, no = const("true", "boolean"), const("false", "boolean")

        def at(pc: int) -> E:
            return no if pc == target else yes if pc == behind else value(starts[pc])

        def value(k: int) -> E:
            if k in memo:
                return memo[k]
            _, c, t, after = found[k]
            taken, passed = at(t), yes if k == len(found) - 1 else value(k + 1)
            if taken is no:
                e = negate(c) if passed is yes else binary("&&", negate(c), passed, "boolean")
            elif taken is yes:
                e = c if passed is no else binary("||", c, passed, "boolean")
            elif passed.kind == "bin" and passed.text in ("&&", "||") and passed.args[1] is taken:
                e = binary("||", binary("&&", negate(c), passed.args[0], "boolean"), taken, "boolean") if passed.text == "||" else binary("&&", binary("||", c, passed.args[0], "boolean"), taken, "boolean")
            else:
                e = E("cond", [c, taken, passed], type="boolean")
            memo[k] = e
            return e

        return value(0)

    def run_branch(self, pc: int, end: int, out: list[S], follow: int) -> int:
        e, target, body, stack = self.chain(pc, end)
        if target == follow and target > end:
            target = end
        if target <= pc or target > end:
            got = self.jump(target)
            if got is None:
                raise Unstructured(f"a branch to {target}")
            self.flush(out)
            out += choose(negate(e), got, [])
            return body
        if target == body:
            out += choose(e, [], [])
            return body
        last = self.before(target)
        base = len(stack)
        rest = None  # the end of an else part
        if last["op"] == "goto" and last["pc"] >= body and last["target"] > last["pc"]:
            g = last["target"]
            if target < g <= end:
                rest = g
            elif g == follow and g > end and target < end:
                rest = end
        if rest is not None and self.jump(last["target"]) is not None and last["target"] != follow and rest == end and last["target"] > end:
            rest = None
        until = last["pc"]
        if rest is None and last["op"] in NO_FALLTHROUGH and target < end:
            # the first branch ends otherwise, but something in it jumps over what would be the second
            over = [g for x in self.insns[self.at[body] : self.at[target]] for g in [x.get("target")] if g is not None and g > target and (g <= end or g == follow) and self.jump(g) is None]
            if over:
                rest, until = min(min(over), end), target
        if rest is None:
            yes, after = self.inner(body, target, target if target != end else follow, stack)
            if len(after) != base and not _leaves(yes):
                raise Unstructured("branches that leave different stacks")
            self.stack = list(stack)
            self.flush(out) if yes else None
            out += choose(e, yes, [])
            return target
        onward = rest if rest != end else follow
        yes, a = self.inner(body, until, onward, stack)
        no, b = self.inner(target, rest, onward, stack)
        if not yes and not no and len(a) == len(b) == base + 1:
            self.stack = [*stack, self.choice(e, a[-1], b[-1])]
            return rest
        if len(a) == base + 1 and len(b) == base + 1:  # values that need statements first
            kind = a[-1].type if a[-1].type != "null" else b[-1].type
            name = var(f"tmp{self.temps}", kind)
            self.temps += 1
            self.flush(out)
            out += choose(e, [*yes, S("assign", [name, a[-1]])], [*no, S("assign", [name, b[-1]])])
            self.stack = [*self.stack[:base], name]
            return rest
        if len(a) != base and not _leaves(yes) or len(b) != base and not _leaves(no):
            raise Unstructured("branches that leave different stacks")
        self.stack = list(stack)
        self.flush(out)
        out += choose(e, yes, no)
        return rest

    def choice(self, e: E, a: E, b: E) -> E:
        kind = a.type if a.type not in ("null", "int") else b.type
        if {a.type, b.type} <= INTS and "boolean" not in (a.type, b.type):
            kind = "int"
        made = E("cond", [e, a, b], type="java.lang.Object" if kind == "null" else kind)
        return as_boolean(made) if "boolean" in (a.type, b.type) else made

    # -- loops

    def run_loop(self, head: int, end: int, out: list[S], follow: int) -> int:
        self.flush(out)
        behind = self.loops[head]
        last = self.before(behind)
        self.opened.add(head)
        # at the end of a range, ways out of the loop lead straight to what follows the range
        frame = Frame("loop", frozenset([behind, follow] if behind == end else [behind]), frozenset([head, last["pc"]] if last["op"] == "goto" else [head]))
        self.frames.append(frame)
        try:
            if last["op"] == "goto":
                made = self._while(head, last, behind, frame)
            else:
                made = self._do(head, last, behind, frame)
        finally:
            self.frames.pop()
            self.opened.discard(head)
        if frame.used:
            made.more = {"label": frame.label}
        out.append(made)
        return behind

    def _while(self, head: int, last: dict, behind: int, frame: Frame) -> S:
        keep, current, temps = list(self.stack), dict(self.current), self.temps
        quiet: list[S] = []
        pc = head
        try:
            while pc < last["pc"] and self.insns[self.at[pc]].get("target") is None:
                x = self.insns[self.at[pc]]
                if x["op"] in NO_FALLTHROUGH or x.get("default") is not None or pc != head and pc in self.sources or any(p.start == pc and id(p) not in self.opened for p in self.protected):
                    raise Unstructured("no condition")
                self.execute(x, quiet)
                if quiet:
                    raise Unstructured("no condition")
                pc += x["length"]
            if pc >= last["pc"] or self.insns[self.at[pc]]["op"] == "goto":
                raise Unstructured("no condition")
            for leave in sorted(frame.breaks):
                try:
                    e, target, body, stack = self.chain(pc, last["pc"], last=leave)
                    break
                except Unstructured:
                    if leave == max(frame.breaks):
                        raise
            block, _ = self.inner(body, last["pc"], head, stack)
            return S("while", [e], [block], pc=head)
        except Unstructured:
            self.stack, self.current, self.temps = keep, current, temps
        block, _ = self.inner(head, last["pc"], head, self.stack)
        return S("while", [const("true", "boolean")], [block], pc=head)

    def _do(self, head: int, last: dict, behind: int, frame: Frame) -> S:
        """The condition is the chain of branches that ends with the jump back; it starts as early as such a chain can."""
        starts = [x["pc"] for x in self.insns[self.at[head] : self.at[last["pc"]] + 1] if x.get("target") is not None and x["op"] != "goto"]
        starts = [pc for pc in starts if all(t in (head, behind) or pc <= t <= last["pc"] for t in [self.insns[self.at[pc]]["target"]])]
        problem = Unstructured("no condition at the loop's end")
        for pc in starts[-8:]:
            state = (list(self.stack), dict(self.current), self.temps, self.labels)
            # the statements before the chain, then the chain with what they leave on the stack
            try:
                keep, block = self.stack, []
                self.stack = list(keep)
                self.run(head, pc, block, pc)
                e, _, _, stack = self.chain(pc, behind, last=head)
                if self.stack and len(stack) != len(keep):
                    raise Unstructured("a value is left on the stack")
                self.stack = keep
                return S("dowhile", [negate(e)], [block], pc=head)
            except Unstructured as e:
                problem = e
                self.stack, self.current, self.temps, self.labels = state
        raise problem

    # -- switches

    def run_switch(self, x: dict, end: int, out: list[S], follow: int) -> int:
        key = self.pop()
        self.flush(out)
        arms: dict[int, list] = {}
        for k, t in zip(x["keys"], x["targets"], strict=True):
            if t != x["default"]:
                arms.setdefault(t, []).append(k)
        arms.setdefault(x["default"], []).append(None)
        order = sorted(arms)
        if order[0] <= x["pc"] or order[-1] > end and order[-1] != follow:
            raise Unstructured("a switch that leads out")
        last, inside = order[-1], [y for y in self.insns if order[0] <= y["pc"] < order[-1] and y["op"] == "goto"]
        ways = [y["target"] for y in inside if y["target"] >= last and (y["target"] <= end or y["target"] == follow)]
        if ways:
            leave = min(ways)
        elif x["default"] == last:
            leave = last
        else:
            leave = self.extent(last, end)
        frame = Frame("switch", frozenset([leave, follow] if leave == end else [leave]))
        stop = min(leave, end)
        if x["default"] == leave:
            arms.pop(leave)
            order = [t for t in order if t != leave]
        self.frames.append(frame)
        labels, blocks = [], []
        try:
            for k, t in enumerate(order):
                upto = order[k + 1] if k + 1 < len(order) else stop
                block, stack = self.inner(t, upto, upto if k + 1 < len(order) else (follow if stop == end else stop), self.stack)
                if len(stack) != len(self.stack) and not _leaves(block):
                    raise Unstructured("a switch that leaves a value")
                kind = key.type
                labels.append([None if v is None else render(coerce(const(str(v), "int"), kind)) for v in arms[t]])
                blocks.append(block)
        finally:
            self.frames.pop()
        made = S("switch", [key], blocks, more=labels, pc=x["pc"])
        if frame.used:
            raise Unstructured("a labelled break out of a switch")
        out.append(made)
        return stop

    # -- exceptions

    def run_try(self, p: Protected, end: int, out: list[S], follow: int) -> int:
        self.flush(out)
        self.opened.add(id(p))
        first = p.handlers[0][0]
        pcs = [h for h, _ in p.handlers]
        last = self.before(first)
        leave = None
        if last is not None and last["op"] == "goto" and last["pc"] >= p.start and last["target"] > pcs[-1]:
            leave = last["target"]
        if leave is None:  # the body never ends, or jumps back: another way behind the handlers
            ways = [x["target"] for x in self.insns if p.start <= x["pc"] < pcs[-1] and x["op"] == "goto" and pcs[-1] < x["target"] <= end and self.jump(x["target"]) is None]
            leave = min(ways) if ways else self.extent(pcs[-1], end)
        stop = leave if leave <= end else end if leave == follow else self.extent(pcs[-1], end)
        onward = follow if stop == end else stop
        if leave > end and leave != follow:
            onward = stop
        stop_body = last["pc"] if last is not None and last["op"] == "goto" and last["target"] in (leave, onward) and last["pc"] >= p.start else first
        body, _ = self.inner(p.start, stop_body, onward, [])
        blocks, heads, final = [body], [], None
        for k, (pc, kinds) in enumerate(p.handlers):
            upto = pcs[k + 1] if k + 1 < len(pcs) else stop
            x = self.insns[self.at[pc]]
            kind = "java.lang.Throwable" if kinds == "any" else kinds.split(" | ")[0] if " | " not in kinds else "java.lang.Exception"
            name, start = f"ex{len(self.opened)}", pc
            keep, self.stack = self.stack, []
            if x["op"] == "astore":
                caught = self.store_target(x["var"], pc + x["length"], var("", kind), "java.lang.Object")
                found = any(s <= pc + x["length"] < e for s, e, _, _ in self.scopes.get(x["var"], []))
                if not found:
                    self.current[x["var"]] = (("t" if kinds == "any" else "e") + (str(self.catching + 1) if self.catching else ""), kind)
                    caught = var(*self.current[x["var"]])
                name, start = caught.text, pc + x["length"]
                initial = []
            elif x["op"] == "pop":
                start, initial = pc + x["length"], []
            else:
                initial = [var(name, kind)]
            self.stack = keep
            exit_goto = self.before(upto)
            until = exit_goto["pc"] if exit_goto["op"] == "goto" and exit_goto["target"] in (onward, leave) and exit_goto["pc"] >= start and k + 1 < len(pcs) else upto
            self.catching += 1
            block, _ = self.inner(start, until, onward, initial)
            self.catching -= 1
            if kinds == "any" and block and block[-1].kind == "throw" and render(block[-1].exprs[0]) == name:
                final = block[:-1]
            else:
                blocks.append(block)
                heads.append(f"{'Throwable' if kinds == 'any' else kinds} {name}")
        if final is not None:
            if final:
                text = lines(final)
                blocks = [_without(b, text, len(final)) for b in blocks]
                blocks.append(final)
                heads.append("finally")
            elif not heads:
                out += body
                return stop
        out.append(S("try", [], blocks, more=heads, pc=p.start))
        return stop

    # -- instructions

    def pop(self) -> E:
        if not self.stack:
            raise Unstructured("an empty stack")
        return self.stack.pop()

    def push(self, e: E) -> None:
        self.stack.append(e)

    def flush(self, out: list[S]) -> None:
        """What waits on the stack and must happen before the next statement becomes a variable."""
        for k, e in enumerate(self.stack):
            if e.kind == "fresh":
                continue
            if impure(e) and e.kind != "newarray":
                t = self.temp(e, out)
                self.stack = [t if s is e else s for s in self.stack]

    def emit(self, s: S, out: list[S], pc: int) -> None:
        s.pc = pc
        writes = s.exprs[0].text if s.kind == "assign" and s.exprs[0].kind == "var" else None
        calls = any(impure(e) for e in s.exprs) or s.kind == "assign" and s.exprs[0].kind != "var"
        for e in list(self.stack):
            if e.kind == "fresh":
                continue
            if impure(e) and not (e.kind == "newarray" and not any(impure(a) for a in (e.more or []))) or writes and any(x.kind == "var" and x.text == writes for x in e.walk()) or calls and reads_state(e):
                t = self.temp(e, out)
                self.stack = [t if x is e else x for x in self.stack]
        out.append(s)

    def execute(self, x: dict, out: list[S]) -> None:
        op, pc, after = x["op"], x["pc"], x["pc"] + x["length"]
        if op in ("nop",):
            return
        if op == "iconst":
            self.push(const(str(x["value"]), "int"))
        elif op in ("lconst", "fconst", "dconst"):
            self.push(const({"l": f"{x['value']}L", "f": f"{x['value']}.0f", "d": f"{x['value']}.0"}[op[0]], KINDS[op[0]]))
        elif op == "aconst_null":
            self.push(const("null", "null"))
        elif op == "ldc":
            self.push(self.view.constant(x["cp"]))
        elif op in ("iload", "lload", "fload", "dload", "aload"):
            self.push(self.local(x["var"], pc))
        elif op in ("istore", "lstore", "fstore", "dstore", "astore"):
            value = self.pop()
            target = self.store_target(x["var"], after, value, KINDS[op[0]])
            self.seen_locals.append((after, x["var"], target.text, target.type))
            self.assign(target, value, out, pc)
        elif op == "iinc":
            self.increment(self.local(x["var"], pc), x["value"], out, pc)
        elif op in ("iaload", "laload", "faload", "daload", "aaload", "baload", "caload", "saload"):
            index, array = self.pop(), self.pop()
            element = array.type[:-2] if array.type.endswith("[]") else KINDS[op[0]]
            self.push(E("array", [array, index], type=element))
        elif op in ("iastore", "lastore", "fastore", "dastore", "aastore", "bastore", "castore", "sastore"):
            self.store_element(op, out, pc)
        elif op in ("pop", "pop2"):
            e = self.pop()
            if op == "pop2" and e.type not in ("long", "double") and self.stack:
                other = self.pop()
                self.drop(other, out, pc)
            self.drop(e, out, pc)
        elif op.startswith("dup") or op == "swap":
            self.shuffle(op, out, self.insns[self.at[pc] + 1]["op"] if self.at[pc] + 1 < len(self.insns) else "")
        elif op[1:] in ARITHMETIC and op[0] in "ilfd":
            b, a = self.pop(), self.pop()
            kind = "boolean" if op[1:] in ("and", "or", "xor") and "boolean" in (a.type, b.type) and {a.type, b.type} <= {"boolean", "int"} and all(y.type == "boolean" or y.kind in ("const", "cond") for y in (a, b)) else KINDS[op[0]]
            if kind == "boolean":
                a, b = as_boolean(a), as_boolean(b)
                if op == "ixor" and b.kind == "const":
                    return self.push(negate(a) if b.text == "true" else a)
            self.push(binary(ARITHMETIC[op[1:]], a, b, kind))
        elif op[1:] == "neg":
            self.push(E("neg", [self.pop()], type=KINDS[op[0]]))
        elif len(op) == 3 and op[1] == "2":
            e = self.pop()
            self.push(E("cast", [e], type=KINDS[op[2]]))
        elif op in ("lcmp", "fcmpl", "fcmpg", "dcmpl", "dcmpg"):
            b, a = self.pop(), self.pop()
            nxt = self.insns[self.at[pc] + 1]["op"] if self.at[pc] + 1 < len(self.insns) else ""
            if nxt[:2] == "if" and nxt[2:] in COMPARE:
                self.push(E("cmp", [a, b], type="int", more="real" if op[0] != "l" else None))
            else:
                box = {"l": "java.lang.Long", "f": "java.lang.Float", "d": "java.lang.Double"}[op[0]]
                self.push(E("call", [const("", "int"), a, b], "compare", "int", box))
        elif op in RETURNS:
            self.flush_keep(out, 1 if op != "return" else 0)
            e = [as_variable(coerce(self.pop(), erased(self.type.result)), self.rich.result)] if op != "return" else []
            out.append(S("return", e, pc=pc))
            self.stack = []
        elif op == "athrow":
            e = self.pop()
            self.stack = []
            out.append(S("throw", [e], pc=pc))
        elif op in ("getstatic", "getfield"):
            owner, name, desc = self.view.ref(x["cp"])
            kind = self.field_kind(desc)
            if op == "getfield":
                self.push(E("field", [self.pop()], name, kind))
            else:
                self.push(E("static", text=name, type=kind, more=None if owner == self.view.name and not any(n == name for s in self.scopes.values() for _, _, n, _ in s) else owner))
        elif op in ("putstatic", "putfield"):
            owner, name, desc = self.view.ref(x["cp"])
            kind, value = self.field_kind(desc), self.pop()
            target = E("field", [self.pop()], name, kind) if op == "putfield" else E("static", text=name, type=kind, more=None if owner == self.view.name else owner)
            self.assign(target, value, out, pc)
        elif op == "invokedynamic":
            self.dynamic(x, out, pc)
        elif op.startswith("invoke"):
            self.invoke(x, out, pc)
        elif op == "new":
            self.push(E("fresh", type=self.view.class_name(x["cp"]), text=f"new {short(self.view.class_name(x['cp']))}"))
        elif op == "newarray":
            self.push(E("newarray", [self.pop()], type=ARRAY_TYPES.get(x["value"], "int") + "[]"))
        elif op == "anewarray":
            self.push(E("newarray", [self.pop()], type=self.view.class_name(x["cp"]) + "[]"))
        elif op == "multianewarray":
            dims = [self.pop() for _ in range(x["dims"])][::-1]
            self.push(E("newarray", dims, type=self.view.class_name(x["cp"])))
        elif op == "arraylength":
            self.push(E("length", [self.pop()], type="int"))
        elif op == "checkcast":
            e, kind = self.pop(), self.view.class_name(x["cp"])
            self.push(e if erased(e.type) == kind or e.kind == "const" and e.text == "null" else E("cast", [e], type=kind))
        elif op == "instanceof":
            self.push(E("instanceof", [self.pop()], self.view.class_name(x["cp"]), "boolean"))
        elif op in ("monitorenter", "monitorexit"):
            e = self.pop()
            self.flush(out)
            out.append(S("enter" if op == "monitorenter" else "exit", [e], text=f"/* {op} */", pc=pc))
        else:
            raise Unstructured(f"{op} at {pc}")

    def flush_keep(self, out: list[S], n: int) -> None:
        """Calls that wait below the top n values are statements."""
        for e in self.stack[: len(self.stack) - n]:
            if impure(e) and e.kind in ("call", "new", "assign", "postinc"):
                out.append(S("expr", [e]))

    def field_kind(self, desc: str) -> str:
        try:
            return field_type(desc)
        except Malformed:
            return "java.lang.Object"

    def drop(self, e: E, out: list[S], pc: int) -> None:
        if e.kind in ("call", "new", "postinc", "indy"):
            self.emit(S("expr", [e]), out, pc)
        elif e.kind == "assign":
            self.emit(S("assign", e.args), out, pc)
        elif impure(e):
            self.temp(e, out)

    def assign(self, target: E, value: E, out: list[S], pc: int) -> None:
        same = self.stack and self.stack[-1] is value and value.kind not in ("const", "var", "string", "fresh", "class")
        value = coerce(value, erased(target.type))
        if value.type == "null":
            value = const("null", target.type)
        value = as_variable(value, target.type)
        if value.kind == "lambda" and value.more and "<" not in target.type:
            value = E("lambda", text=value.more, type=value.type)
        if same or self.stack and getattr(self.stack[-1], "twin", None) is not None and self.stack[-1] is value:
            self.stack[-1] = E("assign", [target, value], type=target.type)
            return
        if self.stack and target.kind == "var" and self.stack[-1].kind == "var" and self.stack[-1].text == target.text and value.kind == "bin" and value.args[0] is self.stack[-1] and value.args[1].text == "1" and value.text in "+-":
            self.stack[-1] = E("postinc", [target], "1" if value.text == "+" else "-1", target.type)
            return
        if target.kind == "var" and value.kind == "var" and value.text == target.text:
            return
        self.emit(S("assign", [target, value]), out, pc)

    def increment(self, target: E, by: int, out: list[S], pc: int) -> None:
        if self.stack and self.stack[-1].kind == "var" and self.stack[-1].text == target.text and by in (1, -1):
            self.stack[-1] = E("postinc", [target], str(by), target.type)
            return
        self.emit(S("assign", [target, binary("+", target, const(str(by), "int"), target.type)]), out, pc)

    def store_element(self, op: str, out: list[S], pc: int) -> None:
        value, index, array = self.pop(), self.pop(), self.pop()
        element = array.type[:-2] if array.type.endswith("[]") else KINDS[op[0]]
        value = coerce(value, erased(element))
        if array.kind == "newarray" and len(array.args) == 1 and array.args[0].kind == "const" and any(s is array for s in self.stack) and index.kind == "const" and index.text == str(len(array.more or [])):
            array.more = [*(array.more or []), value]
            return
        if self.stack and self.stack[-1] is value and value.kind not in ("const", "var", "string"):
            self.stack[-1] = E("assign", [E("array", [array, index], type=element), value], type=element)
            return
        if array.kind == "newarray" and any(s is array for s in self.stack):
            t = self.temp(array, out)
            self.stack = [t if s is array else s for s in self.stack]
            array = t
        self.emit(S("assign", [E("array", [array, index], type=element), value]), out, pc)

    def shuffle(self, op: str, out: list[S], following: str) -> None:
        """Copies of stack values. A value with effects is copied as a variable, unless what follows stores one of the copies."""
        wide = lambda e: e.type in ("long", "double")
        if op == "swap":
            a, b = self.pop(), self.pop()
            self.stack += [a, b]
            return
        take = 1
        if op.startswith("dup2") and not wide(self.stack[-1] if self.stack else const("0", "int")):
            take = 2
        if len(self.stack) < take:
            raise Unstructured("an empty stack")
        top = self.stack[-take:]
        stores = following.endswith("store") or following in ("putfield", "putstatic")
        fixed = []
        for e in top:
            if e.kind in ("fresh", "newarray", "const", "var", "string", "class") or stores and take == 1:
                fixed.append(e)
            elif impure(e) or reads_state(e) and op != "dup":
                self.stack = self.stack[: len(self.stack) - take] + top
                fixed.append(self.temp(e, out))
            else:
                fixed.append(e)
        self.stack[-take:] = fixed
        if op in ("dup", "dup2"):
            self.stack += fixed
            return
        under = 1 if op.endswith("x1") or wide(self.stack[-take - 1] if len(self.stack) > take else const("0", "int")) else 2
        if len(self.stack) < take + under:
            raise Unstructured("an empty stack")
        self.stack[len(self.stack) - take - under : len(self.stack) - take - under] = fixed

    # -- calls

    def invoke(self, x: dict, out: list[S], pc: int) -> None:
        owner, name, desc = self.view.ref(x["cp"])
        try:
            t = method_type(desc)
        except Malformed as e:
            raise Unstructured(str(e)) from e
        args = [self.pop() for _ in t.parameters][::-1]
        args = [coerce(a, k) for a, k in zip(args, t.parameters, strict=True)]
        op = x["op"]
        if op == "invokestatic":
            e = E("call", [const("", "int"), *args], name, t.result, owner if owner != self.view.name else "")
        else:
            target = self.pop()
            if name == "<init>":
                if target.kind == "fresh":
                    made = E("new", args, type=target.type)
                    if any(s is target for s in self.stack):
                        self.stack = [made if s is target else s for s in self.stack]
                    else:
                        self.emit(S("expr", [made]), out, pc)
                    return
                if target.kind == "var" and target.text == "this":
                    if owner == self.view.name or owner not in ("java.lang.Object",) or args:
                        self.emit(S("expr", [E("call", [const("", "int"), *args], "this" if owner == self.view.name else "super", "void", "")]), out, pc)
                    return
                raise Unstructured("a constructor of something else")
            folded = self.builder(owner, name, target, args)
            if folded is not None:
                self.push(folded)
                return
            if op == "invokespecial" and target.kind == "var" and target.text == "this" and owner != self.view.name:
                target = var("super", owner)
            if target.kind == "var" and target.text == "this" and op != "invokespecial":
                e = E("call", [const("", "int"), *args], name, t.result, "")
            else:
                e = E("call", [target, *args], name, t.result)
        if t.result == "void":
            self.emit(S("expr", [e]), out, pc)
        else:
            self.push(e)

    def builder(self, owner: str, name: str, target: E, args: list[E]) -> E | None:
        """A chain of appends to a new string builder that ends in toString is a concatenation."""
        if owner not in ("java.lang.StringBuilder", "java.lang.StringBuffer"):
            return None
        if name == "append" and len(args) == 1 and (target.kind == "new" and not target.args or target.kind == "building" or target.kind == "new" and len(target.args) == 1 and target.args[0].type == "java.lang.String"):
            if any(s is target for s in self.stack):
                return None
            parts = target.args if target.kind in ("building", "new") else []
            return E("building", [*parts, args[0]], type=owner, text=f"new {short(owner)}()")
        if target.kind == "building" and name == "toString" and len(target.args) > 1:
            return E("concat", target.args, type="java.lang.String")
        if target.kind == "building" and name == "toString":
            return E("call", [const("", "int"), *target.args], "valueOf", "java.lang.String", "java.lang.String")
        if target.kind == "building":  # used in another way after all: written as it was
            e = E("new", [], type=target.type)
            for a in target.args:
                e = E("call", [e, a], "append", target.type)
            t = method_type("()V")
            return E("call", [e, *args], name, "java.lang.Object" if t else "")
        return None

    def dynamic(self, x: dict, out: list[S], pc: int) -> None:
        c = self.view.pool.get(x["cp"]) or {}
        name, desc = self.view.pair(c.get("ref2"))
        if name is None or desc is None:
            raise Unstructured("a dynamic call without a name")
        t = method_type(desc)
        args = [self.pop() for _ in t.parameters][::-1]
        boot = next((b for b in self.view.row["bootstrap"] if b["seq"] == c.get("ref1")), None)
        handle = self.view.pool.get(boot["method_idx"]) if boot else None
        owner, factory, _ = self.view.ref(handle["ref1"]) if handle and handle.get("ref1") else ("", "", "")
        if owner == "java.lang.invoke.StringConcatFactory":
            self.push(self.concat(boot, factory, args))
        elif owner == "java.lang.invoke.LambdaMetafactory" and len(boot["args"]) > 1:
            self.push(E("lambda", text=self.lambda_text(boot, args), type=t.result, more=self.explicit(boot, args)))
        else:
            e = E("indy", args, name, t.result)
            self.push(e) if t.result != "void" else self.emit(S("expr", [e]), out, pc)

    def concat(self, boot: dict, factory: str, args: list[E]) -> E:
        """The recipe holds \\x01 for an argument and \\x02 for a constant."""
        recipe = "\x01" * len(args)
        rest = list(boot["args"])
        if factory == "makeConcatWithConstants" and rest:
            recipe = self.view.constant(rest.pop(0)).text
        parts, text, args = [], "", list(args)
        string = lambda s: E("string", text=s, type="java.lang.String")
        for ch in recipe:
            if ch not in "\x01\x02":
                text += ch
                continue
            if ch == "\x02":
                v = self.view.constant(rest.pop(0)) if rest else string("")
                text += v.text if v.kind == "string" else render(v)
                continue
            if text:
                parts.append(string(text))
            text = ""
            parts.append(args.pop(0) if args else string("?"))
        if text:
            parts.append(string(text))
        if len(parts) == 1:
            parts.insert(0, string(""))
        return E("concat", parts, type="java.lang.String")

    def explicit(self, boot: dict, captured: list[E]) -> str | None:
        """A method reference as a lambda that casts its parameters, for where the functional type's arguments are lost."""
        handle = self.view.pool.get(boot["args"][1]) or {}
        owner, name, _ = self.view.ref(handle.get("ref1"))
        if name.startswith("lambda$") or len(boot["args"]) < 3:
            return None
        try:
            kinds = method_type(self.view.utf8((self.view.pool.get(boot["args"][2]) or {}).get("ref1")) or "()V").parameters
        except Malformed:
            return None
        given = [k if k in PRIMITIVES.values() else f"({short(k)}) a{n}" for n, k in enumerate(kinds)]
        given = [f"a{n}" if k in PRIMITIVES.values() else g for n, (k, g) in enumerate(zip(kinds, given, strict=True))]
        head = f"({', '.join(f'a{n}' for n in range(len(kinds)))})"
        if handle.get("handle") == 8:
            return f"{head} -> new {short(owner)}({', '.join(given)})"
        if handle.get("handle") == 6:
            return f"{head} -> {short(owner)}.{name}({', '.join([*map(render, captured), *given])})"
        target, rest = (render(captured[0], 15), given) if captured else (f"(({short(owner)}) a0)", given[1:])
        return f"{head} -> {target}.{name}({', '.join(rest)})"

    def lambda_text(self, boot: dict, captured: list[E]) -> str:
        handle = self.view.pool.get(boot["args"][1]) or {}
        owner, name, desc = self.view.ref(handle.get("ref1"))
        kind = handle.get("handle")
        own = self.view.method_index.get((name, desc))
        if owner == self.view.name and own is not None and name.startswith("lambda$") and self.depth < 8:
            body = Body(self.view, own, self.depth + 1)
            result = reconstruct(self.view, own, self.depth + 1)
            params = [n for _, n in result.parameters]
            skip = len(captured) - (0 if body.static else 1)
            shown = params[skip:]
            block = [s for s in result.block]
            renames = {p: render(c) for p, c in zip(params[:skip], captured[0 if body.static else 1 :], strict=False) if c.kind == "var" and p != c.text}
            for s in block:
                for e in s.expressions():
                    if e.kind == "var" and e.text in renames:
                        e.text = renames[e.text]
            head = shown[0] if len(shown) == 1 else f"({', '.join(shown)})"
            if len(block) == 1 and block[0].kind in ("return", "expr") and block[0].exprs and result.structured:
                return f"{head} -> {render(block[0].exprs[0], 2)}"
            if not block:
                return f"{head} -> {{ }}"
            return f"{head} -> {{\n" + "\n".join(lines(block, 1)) + "\n}"
        if kind == 8:
            return f"{short(owner)}::new"
        if kind == 6:
            return f"{short(owner) if not owner.endswith('[]') else owner}::{name}"
        return f"{render(captured[0], 15) if captured else short(owner)}::{name}"


def as_variable(e: E, kind: str) -> E:
    """e where a type variable is wanted: erasure has lost that it is one, so a cast says so."""
    if "." in kind or "[" in kind or kind in PRIMITIVES.values() or e.type == kind or e.kind == "const" and e.text == "null" or e.kind == "lambda":
        return e
    return E("cast", [e.args[0] if e.kind == "cast" else e], type=kind)


def _leaves(block: list[S]) -> bool:
    from bytelake.recon.stmt import ends

    return ends(block)


def _without(block: list[S], text: list[str], n: int) -> list[S]:
    """The block without copies of the finally statements: at its end, and before each way out of it."""

    def strip(b: list[S]) -> list[S]:
        out, k = [], 0
        while k < len(b):
            part = b[k : k + n]
            if len(part) == n and lines(part) == text and (k + n == len(b) or b[k + n].kind in ("return", "break", "continue", "throw")):
                k += n
                continue
            out.append(b[k])
            k += 1
        return out

    for s in block:
        s.blocks = [_without(b, text, n) for b in s.blocks]
    return strip(block)


def listing(view: View, row: dict, why: str) -> list[S]:
    """The instructions as a comment, for a method without a structure that could be found."""
    insns = view.by_method["insns"].get(row["seq"], [])
    text = [f"no structure found ({why}); instructions:"]
    for x in insns:
        shown = [f"{k}={x[k]}" for k in ("var", "value", "target", "default") if x.get(k) is not None]
        if x.get("cp") is not None and x["op"].startswith(("get", "put", "invoke")) and x["op"] != "invokedynamic":
            shown.append(".".join(view.ref(x["cp"])[:2]))
        text.append(f"{x['pc']}: {x['op']} {' '.join(shown)}".rstrip())
    fail = E("new", [E("string", text=why, type="java.lang.String")], type="java.lang.UnsupportedOperationException")
    return [S("comment", text="\n".join(text)), S("throw", [fail])]


def reconstruct(view: View, row: dict, depth: int = 0) -> Result:
    """Statements and parameters of a method with code. Never fails."""
    from bytelake.recon.rewrite import finish

    body = None
    try:
        body = Body(view, row, depth)
        block: list[S] = []
        body.run(0, body.end, block, body.end)
        return Result(finish(block, body), body.parameters, True, body.seen_locals)
    except (Unstructured, Malformed, IndexError, KeyError, TypeError, ValueError, RecursionError, AttributeError) as e:
        try:
            parameters = body.parameters if body is not None else [(k, f"arg{n}") for n, k in enumerate(method_type(view.utf8(row["desc_idx"]) or "()V").parameters)]
        except Malformed:
            parameters = []
        return Result(listing(view, row, f"{type(e).__name__}: {e}" if not isinstance(e, Unstructured) else str(e)), parameters, False)

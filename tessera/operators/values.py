"""What is known of the values in one function: SSA versions, equal values, constants, guards, resources, contracts.

All work on `program.Flow`, one function at a time; their rows join the other
dataflow facts of `program.flows` as kinds of their own.
"""

from __future__ import annotations

import ast
from collections import defaultdict

#: Calls that open something which must be closed, and those that close it.
OPENERS = ("open", "socket.socket", "sqlite3.connect", "tempfile.NamedTemporaryFile")
CLOSERS = ("close", "release", "shutdown")
FOLD = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.FloorDiv: lambda a, b: a // b, ast.Mod: lambda a, b: a % b}
TEST = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}
COMMUTES = (ast.Add, ast.Mult, ast.BitAnd, ast.BitOr, ast.BitXor)
#: Not known yet, and known not to be one value.
UNKNOWN, MANY = object(), object()


class Versions:
    """Full renaming: for each node the version of every name that it uses and defines; joins define versions too."""

    def __init__(self, flow):
        self.flow = flow
        self.joins = defaultdict(set)
        for v, i in flow.phis():
            self.joins[i].add(v)
        children = defaultdict(list)
        for i, d in flow.idom().items():
            children[d].append(i)
        self.uses: list[dict[str, int]] = [{} for _ in flow.stmts]
        self.defs: list[dict[str, int]] = [{} for _ in flow.stmts]
        self.phi: list[dict[str, int]] = [{} for _ in flow.stmts]
        self.args: dict[tuple[int, str], dict[int, int]] = defaultdict(dict)
        counter: dict[str, int] = defaultdict(int)
        now: dict[str, list[int]] = defaultdict(list)
        todo: list[tuple[int, list[str] | None]] = [(0, None)]
        while todo:
            i, pushed = todo.pop()
            if pushed is not None:  # the way back up the dominator tree
                for v in pushed:
                    now[v].pop()
                continue
            pushed = []

            def define(v, into, pushed=pushed):
                counter[v] += 1
                now[v].append(counter[v])
                pushed.append(v)
                into[v] = counter[v]

            for v in sorted(self.joins[i]):
                define(v, self.phi[i])
            self.uses[i] = {v: now[v][-1] for v in flow.uses[i] if now[v]}
            for v in sorted(flow.defs[i]):
                define(v, self.defs[i])
            for s in flow.succ.get(i, ()):
                for v in self.joins[s]:
                    if now[v]:
                        self.args[s, v][i] = now[v][-1]
            todo.append((i, pushed))
            todo += [(c, None) for c in sorted(children[i], reverse=True)]


def value_numbers(flow, versions: Versions) -> list[tuple[int, int, str]]:
    """(line, first line, text): expressions whose value an expression that dominates them already has.

    Operands are SSA versions, operands of commutative operators are in order,
    copies share their source's number. Calls, attributes and subscripts may
    change between two evaluations and have no number.
    """
    numbers: dict[tuple, int] = {}
    of: dict[tuple[str, int], int] = {}
    dom = flow.dominators()
    first: dict[int, list[tuple[int, int]]] = defaultdict(list)
    out = []

    def number(key: tuple) -> int:
        return numbers.setdefault(key, len(numbers))

    def value(x: ast.AST, i: int, seen: list | None = None) -> int | None:
        if isinstance(x, ast.Constant):
            return number(("const", type(x.value).__name__, repr(x.value)))
        if isinstance(x, ast.Name):
            n = versions.uses[i].get(x.id)
            return None if n is None else of.setdefault((x.id, n), number(("name", x.id, n)))
        if isinstance(x, (ast.BinOp, ast.UnaryOp, ast.Compare)):
            parts = [x.left, x.right] if isinstance(x, ast.BinOp) else [x.operand] if isinstance(x, ast.UnaryOp) else [x.left, *x.comparators]
            ns = [value(p, i, seen) for p in parts]
            if None in ns:
                return None
            ops = [x.op] if not isinstance(x, ast.Compare) else x.ops
            if isinstance(x, ast.BinOp) and isinstance(x.op, COMMUTES):
                ns.sort()
            n = number((type(x).__name__, *[type(o).__name__ for o in ops], *ns))
            if seen is not None and not isinstance(x, ast.UnaryOp):
                seen.append((n, x))
            return n
        for c in ast.iter_child_nodes(x):
            value(c, i, seen)
        return None

    for i, s in enumerate(flow.stmts):
        if s is None or not flow.pred[i]:
            continue
        seen: list = []
        whole = None
        for h in flow._head(s):
            n = value(h.value if isinstance(h, (ast.Assign, ast.AugAssign, ast.Return)) and h.value is not None else h, i, seen)
            whole = n if isinstance(h, ast.Assign) else whole
        for n, x in seen:
            known = [ln for at, ln in first[n] if at in dom[i] and at != i]
            if known:
                out.append((x.lineno, min(known), ast.unparse(x)))
            first[n].append((i, x.lineno))
        if isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name) and whole is not None:
            of[s.targets[0].id, versions.defs[i][s.targets[0].id]] = whole
    return sorted(set(out))


def constants(flow, versions: Versions) -> tuple[list[tuple[int, str, str]], list[int]]:
    """Sparse conditional constant propagation: ((line, name, value) of constant definitions, lines that cannot be reached)."""
    value: dict[tuple[str, int], object] = {}
    alive: set[int] = {0}
    edges: set[tuple[int, int]] = set()
    bodies = {}
    place = {id(s): i for i, s in enumerate(flow.stmts) if s is not None}
    for i, s in enumerate(flow.stmts):
        if isinstance(s, (ast.If, ast.While)):
            bodies[i] = place[id(s.body[0])]

    def ev(x: ast.AST, i: int):
        if isinstance(x, ast.Constant):
            return x.value
        if isinstance(x, ast.Name):
            n = versions.uses[i].get(x.id)
            return MANY if n is None else value.get((x.id, n), UNKNOWN)
        if isinstance(x, ast.UnaryOp) and isinstance(x.op, (ast.Not, ast.USub)):
            a = ev(x.operand, i)
            try:
                return a if a is UNKNOWN or a is MANY else not a if isinstance(x.op, ast.Not) else -a
            except TypeError:
                return MANY
        if isinstance(x, ast.BinOp) and type(x.op) in FOLD or isinstance(x, ast.Compare) and len(x.ops) == 1 and type(x.ops[0]) in TEST:
            a, b, f = (ev(x.left, i), ev(x.right, i), FOLD[type(x.op)]) if isinstance(x, ast.BinOp) else (ev(x.left, i), ev(x.comparators[0], i), TEST[type(x.ops[0])])
            if MANY in (a, b) or a is MANY or b is MANY:
                return MANY
            if a is UNKNOWN or b is UNKNOWN:
                return UNKNOWN
            simple = (int, float, bool)
            if isinstance(x, ast.BinOp) and not (isinstance(a, simple) and isinstance(b, simple) and abs(a) < 2**63 and abs(b) < 2**63):
                return MANY
            try:
                return f(a, b)
            except (TypeError, ZeroDivisionError, OverflowError):
                return MANY
        return MANY

    def raise_to(key, new) -> bool:
        old = value.get(key, UNKNOWN)
        if new is UNKNOWN or old is MANY:
            return False
        if old is UNKNOWN:
            value[key] = new
            return True
        if new is MANY or type(old) is not type(new) or old != new:
            value[key] = MANY
            return True
        return False

    changed = True
    while changed:
        changed = False
        for i in range(len(flow.stmts)):
            if i not in alive:
                continue
            for v, n in versions.phi[i].items():
                for p, arg in versions.args[i, v].items():
                    if (p, i) in edges:
                        changed |= raise_to((v, n), value.get((v, arg), UNKNOWN))
            s = flow.stmts[i]
            plain = isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name)
            for v, n in versions.defs[i].items():
                changed |= raise_to((v, n), ev(s.value, i) if plain else MANY)
            go = set(flow.succ.get(i, ()))
            if i in bodies:
                t = ev(s.test, i)
                if t is UNKNOWN:
                    go = set()
                elif t is not MANY:
                    go = {bodies[i]} if t else go - {bodies[i]}
            for x in go:
                if (i, x) not in edges:
                    edges.add((i, x))
                    alive.add(x)
                    changed = True
    known = [(flow.line(i), v, repr(value[v, n])) for i, d in enumerate(versions.defs) if i in alive and i for v, n in d.items() if value.get((v, n), UNKNOWN) not in (UNKNOWN, MANY)]
    dead = [flow.line(i) for i, s in enumerate(flow.stmts) if s is not None and i not in alive and flow.pred[i]]
    return sorted(set(known)), sorted(set(dead))


def narrowed(flow) -> list[tuple[int, str, str]]:
    """(line of a branch's first statement, name, what its test says of the name there)."""
    out = []

    def says(t: ast.AST, yes: bool) -> list[tuple[str, str]]:
        if isinstance(t, ast.UnaryOp) and isinstance(t.op, ast.Not):
            return says(t.operand, not yes)
        if isinstance(t, ast.BoolOp) and isinstance(t.op, ast.And) == yes:
            return [x for v in t.values for x in says(v, yes)]
        if isinstance(t, ast.Name):
            return [(t.id, "truthy" if yes else "falsy")]
        if isinstance(t, ast.Call) and isinstance(t.func, ast.Name) and t.func.id == "isinstance" and len(t.args) == 2 and isinstance(t.args[0], ast.Name):
            return [(t.args[0].id, ("is " if yes else "is not ") + ast.unparse(t.args[1]))]
        if isinstance(t, ast.Compare) and len(t.ops) == 1 and isinstance(t.left, ast.Name):
            against = {ast.Is: ast.IsNot, ast.IsNot: ast.Is, ast.Eq: ast.NotEq, ast.NotEq: ast.Eq, ast.Lt: ast.GtE, ast.GtE: ast.Lt, ast.Gt: ast.LtE, ast.LtE: ast.Gt, ast.In: ast.NotIn, ast.NotIn: ast.In}
            sign = {ast.Is: "is", ast.IsNot: "is not", ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.GtE: ">=", ast.Gt: ">", ast.LtE: "<=", ast.In: "in", ast.NotIn: "not in"}
            op = type(t.ops[0]) if yes else against[type(t.ops[0])]
            return [(t.left.id, f"{sign[op]} {ast.unparse(t.comparators[0])}")]
        return []

    def leaves(body: list) -> bool:
        return bool(body) and isinstance(body[-1], (ast.Return, ast.Raise, ast.Continue, ast.Break))

    def walk(body: list) -> None:
        for k, s in enumerate(body):
            if isinstance(s, (ast.If, ast.While)):
                out.extend((s.body[0].lineno, *x) for x in says(s.test, True))
                if s.orelse:
                    out.extend((s.orelse[0].lineno, *x) for x in says(s.test, False))
                elif isinstance(s, ast.If) and leaves(s.body) and k + 1 < len(body):
                    out.extend((body[k + 1].lineno, *x) for x in says(s.test, False))
            for inner in ("body", "orelse", "finalbody"):
                if not isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    walk(getattr(s, inner, []) or [])
            for h in getattr(s, "handlers", []):
                walk(h.body)

    walk(flow.fn.body)
    return sorted(set(out))


def resources(flow, dotted) -> list[tuple[str, str, int, int]]:
    """(kind, name, line, other): resources that some way out leaves open, that are closed twice, or used once closed.

    A resource is a name bound to an opener's result outside a with; one that is
    returned, stored or handed on is no longer this function's to close.
    """
    out = []
    n = len(flow.stmts)
    opened = {}
    for i, s in enumerate(flow.stmts):
        if isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name) and isinstance(s.value, ast.Call) and dotted(s.value.func) in OPENERS:
            opened[i] = s.targets[0].id

    def closes(i: int, v: str) -> bool:
        return any(isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and x.func.attr in CLOSERS and isinstance(x.func.value, ast.Name) and x.func.value.id == v for h in flow._head(flow.stmts[i]) for x in ast.walk(h))

    def escapes(i: int, v: str) -> bool:
        s = flow.stmts[i]
        if isinstance(s, (ast.With, ast.AsyncWith)) and any(isinstance(c.context_expr, ast.Name) and c.context_expr.id == v for c in s.items):
            return True
        for h in flow._head(s):
            for x in ast.walk(h):
                if isinstance(x, ast.Call) and any(isinstance(a, ast.Name) and a.id == v for a in [*x.args, *[k.value for k in x.keywords]]):
                    return True
                if isinstance(x, (ast.Return, ast.Yield, ast.Assign)) and isinstance(x.value, ast.Name) and x.value.id == v:
                    return True
        return False

    for start, v in opened.items():
        # states: open, closed; what each node's end can be in
        todo, seen = [(x, True) for x in flow.succ.get(start, ())], set()
        while todo:
            i, is_open = todo.pop()
            if (i, is_open) in seen:
                continue
            seen.add((i, is_open))
            if i == n - 1:
                if is_open:
                    out.append(("leak", v, flow.line(start), 0))
                continue
            if closes(i, v):
                if not is_open:
                    out.append(("double_close", v, flow.line(start), flow.line(i)))
                is_open = False
            elif not is_open and v in flow.uses[i]:
                out.append(("use_after_close", v, flow.line(start), flow.line(i)))
            if escapes(i, v) or v in flow.defs[i]:
                continue
            todo += [(x, is_open) for x in flow.succ.get(i, ())]
    return sorted(set(out))


def contracts(flow) -> list[tuple[str, str, int]]:
    """(kind, condition, line): what must hold of the parameters at the start, and what is asserted of the result.

    Preconditions are asserts and the negations of tests that raise, among the
    first statements; postconditions are asserts right before a return, and
    the declared type of the result.
    """
    out = []
    against = {ast.Lt: ">=", ast.LtE: ">", ast.Gt: "<=", ast.GtE: "<", ast.Eq: "!=", ast.NotEq: "==", ast.Is: "is not", ast.IsNot: "is", ast.In: "not in", ast.NotIn: "in"}

    def negated(t: ast.AST) -> str:
        if isinstance(t, ast.UnaryOp) and isinstance(t.op, ast.Not):
            return ast.unparse(t.operand)
        if isinstance(t, ast.Compare) and len(t.ops) == 1:
            return f"{ast.unparse(t.left)} {against[type(t.ops[0])]} {ast.unparse(t.comparators[0])}"
        return f"not ({ast.unparse(t)})" if isinstance(t, ast.BoolOp) else f"not {ast.unparse(t)}"

    body = flow.fn.body
    begin = 1 if body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str) else 0
    named = lambda t: bool({x.id for x in ast.walk(t) if isinstance(x, ast.Name)} & set(flow.params))
    for s in body[begin:]:
        if isinstance(s, ast.Assert) and named(s.test):
            out.append(("precondition", ast.unparse(s.test), s.lineno))
        elif isinstance(s, ast.If) and not s.orelse and len(s.body) == 1 and isinstance(s.body[0], ast.Raise) and named(s.test):
            out.append(("precondition", negated(s.test), s.lineno))
        else:
            break
    for a, b in zip(body, body[1:]):
        if isinstance(a, ast.Assert) and isinstance(b, ast.Return) and ("precondition", ast.unparse(a.test), a.lineno) not in out:
            out.append(("postcondition", ast.unparse(a.test), a.lineno))
    if getattr(flow.fn, "returns", None) is not None:
        out.append(("postcondition", f"result is {ast.unparse(flow.fn.returns)}", flow.fn.lineno))
    return out


def specs(fn: ast.AST) -> list[tuple[str, str, int]]:
    """(call, expected, line): of a test, the calls that it asserts to equal something, or to raise."""
    out = []
    for x in ast.walk(fn):
        if isinstance(x, ast.Assert) and isinstance(x.test, ast.Compare) and len(x.test.ops) == 1 and isinstance(x.test.ops[0], ast.Eq) and isinstance(x.test.left, ast.Call):
            out.append((ast.unparse(x.test.left), ast.unparse(x.test.comparators[0]), x.lineno))
        elif isinstance(x, ast.Assert) and isinstance(x.test, (ast.Call, ast.UnaryOp)):
            no = isinstance(x.test, ast.UnaryOp) and isinstance(x.test.op, ast.Not)
            call = x.test.operand if no else x.test
            if isinstance(call, ast.Call):
                out.append((ast.unparse(call), "falsy" if no else "truthy", x.lineno))
        elif isinstance(x, ast.With):
            for i in x.items:
                c = i.context_expr
                if isinstance(c, ast.Call) and ast.unparse(c.func).endswith("raises") and c.args and isinstance(x.body[0], ast.Expr) and isinstance(x.body[0].value, ast.Call):
                    out.append((ast.unparse(x.body[0].value), f"raises {ast.unparse(c.args[0])}", x.body[0].lineno))
    return sorted(set(out))

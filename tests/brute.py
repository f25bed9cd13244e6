"""Brute-force graph of one Python file, written from the rules for tests only.

Nodes are numbered in reading order of the syntax tree; every rule is then a search over the
numbered list, without any of the joins and windows the library uses.
"""

import ast

KINDS = {
    "FunctionDef": "Function", "AsyncFunctionDef": "Function", "ClassDef": "Class", "AsyncWith": "With",
    "ExceptHandler": "Except", "Constant": "Literal", "arg": "Arg", "GeneratorExp": "Generator",
}
SAME = {
    "Module", "With", "Try", "Assign", "AnnAssign", "AugAssign", "Return", "Call", "Name", "Attribute", "JoinedStr",
    "FormattedValue", "ListComp", "SetComp", "DictComp", "AsyncFor", "Await",
}
COMPS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
FUNCS = (ast.FunctionDef, ast.AsyncFunctionDef)


def placed(node):
    return isinstance(node, ast.Module) or hasattr(node, "lineno")


def numbered(code):
    """[(node, parent number or None, function scopes)] with number = index + 1."""
    out = []

    def go(node, parent, scopes):
        if placed(node):
            out.append((node, parent, scopes))
            parent = len(out)
            if isinstance(node, FUNCS):
                scopes = scopes + [parent]
        for child in ast.iter_child_nodes(node):
            go(child, parent, scopes)

    go(ast.parse(code), None, [0])
    return out


def kind(node):
    name = type(node).__name__
    return KINDS.get(name, name if name in SAME else "Stmt")


def line(node):
    return getattr(node, "lineno", 1)


def edges(code):
    """Sorted (src, dst, kind), repeated edges kept."""
    rows = numbered(code)
    number = {id(n): i for i, (n, _, _) in enumerate(rows, 1)}
    out = [(p, i, "AST") for i, (_, p, _) in enumerate(rows, 1) if p]

    for p in {p for _, p, _ in rows if p}:
        chain = [i for i, (n, q, _) in enumerate(rows, 1) if q == p and isinstance(n, ast.stmt)]
        out += [(a, b, "CFG") for a, b in zip(chain, chain[1:])]
    for i, (n, _, _) in enumerate(rows, 1):
        to, back = [], []
        if isinstance(n, ast.If):
            to = [n.body[0]] + n.orelse[:1]
        elif isinstance(n, (ast.For, ast.While, ast.AsyncFor)):
            to, back = [n.body[0]], [n.body[-1]]
        elif isinstance(n, ast.Try):
            to = [n.body[0]] + n.handlers + n.finalbody[:1]
        elif isinstance(n, (ast.With, ast.AsyncWith)):
            to = [n.body[0]]
        elif isinstance(n, ast.DictComp):
            to = [n.value]
        elif isinstance(n, COMPS):
            to = [n.elt]
        out += [(i, number[id(x)], "CFG") for x in to] + [(number[id(x)], i, "CFG") for x in back]

    def is_def(n):
        return isinstance(n, ast.arg) or (isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store))

    def named(n):
        return n.arg if isinstance(n, ast.arg) else n.id

    def seen(name, at):
        for scope in reversed(rows[at - 1][2]):
            hits = [
                i for i, (n, _, s) in enumerate(rows, 1) if i < at and s[-1] == scope and is_def(n) and named(n) == name
            ]
            if hits:
                return hits[-1]
        return None

    for i, (n, _, _) in enumerate(rows, 1):
        names = []
        if isinstance(n, ast.Name) and not is_def(n):
            names = [n.id]
        elif isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name):
            names = [n.value.id]
        elif isinstance(n, ast.Call):
            names = [a.id for a in n.args if isinstance(a, ast.Name)]
            if isinstance(n.func, ast.Attribute) and isinstance(n.func.value, ast.Name):
                names.append(n.func.value.id)
        elif isinstance(n, COMPS):
            names = [x.id for x in ast.walk(n) if isinstance(x, ast.Name) and not is_def(x)]
        out += [(d, i, "DFG") for d in (seen(x, i) for x in names) if d]
    return sorted(out)

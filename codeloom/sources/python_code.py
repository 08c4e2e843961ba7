"""Facts of Python source: symbols, imports, uses, bases, calls under guards, thin wrappers and comments.

One pass over the syntax tree of a file gives tagged rows; a file that does not parse gives its error and
nothing else.
"""

from __future__ import annotations

import ast
import builtins
import io
import tokenize
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Decorators that make a function a route.
ROUTES = frozenset("route get post put delete patch api_route websocket".split())
BUILTINS = frozenset(dir(builtins))


@dataclass
class Facts:
    symbols: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    uses: list[dict] = field(default_factory=list)
    bases: list[dict] = field(default_factory=list)
    exports: list[str] = field(default_factory=list)
    confidence: str = "confirmed"
    error: str = ""


def parse(source: str) -> ast.Module:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.parse(source)


def dotted(node: ast.AST) -> str:
    """The dotted name of a name, attribute, call or subscript; empty where there is none."""
    names: list[str] = []
    while True:
        if isinstance(node, ast.Attribute):
            names.append(node.attr)
            node = node.value
        elif isinstance(node, ast.Call):
            node = node.func
        elif isinstance(node, ast.Subscript):
            node = node.value
        else:
            if isinstance(node, ast.Name):
                names.append(node.id)
            return ".".join(reversed(names))


def first_line(node: ast.AST) -> str:
    doc = ast.get_docstring(node)
    return doc.strip().splitlines()[0] if doc and doc.strip() else ""


def facts(source: str) -> Facts:
    found = Facts()
    try:
        tree = parse(source)
    except (SyntaxError, ValueError, RecursionError) as broken:
        found.confidence, found.error = "unknown", f"{type(broken).__name__} at line {getattr(broken, 'lineno', None)}: {getattr(broken, 'msg', broken)}"
        return found
    # Work is a stack, so that very deep trees do not exhaust the interpreter's; children go on in reverse.
    work: list[tuple[ast.AST, tuple[str, ...], bool]] = [(tree, (), False)]
    while work:
        node, scope, in_class = work.pop()
        below, child_in_class = scope, in_class
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            found.symbols.append(_function(node, scope, in_class))
            below, child_in_class = (*scope, node.name), False
        elif isinstance(node, ast.ClassDef):
            qualname = ".".join((*scope, node.name))
            named = [dotted(b) for b in node.bases]
            found.symbols.append(_symbol(node.name, "class", node, qualname, ".".join(scope), f"({', '.join(named)})" if named else "", first_line(node)))
            found.bases += [{"qualname": qualname, "base": b, "line": node.lineno, "relation": "extends"} for b in named if b]
            below, child_in_class = (*scope, node.name), True
        elif isinstance(node, ast.Assign | ast.AnnAssign) and not scope:
            found.symbols += _bindings(node, source)
        elif isinstance(node, ast.Import):
            found.imports += [{"module": a.name, "level": 0, "bindings": [{"name": None, "alias": a.asname or a.name.split(".")[0]}], "line": node.lineno} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            found.imports.append({"module": node.module or "", "level": node.level, "bindings": [{"name": a.name, "alias": a.asname or a.name} for a in node.names], "line": node.lineno})
        elif isinstance(node, ast.Call):
            if isinstance(node.func, ast.Name):
                found.uses.append(_use("call", node.func.id, node.lineno, scope, ""))
            elif isinstance(node.func, ast.Attribute):
                found.uses.append(_use("call", node.func.attr, node.lineno, scope, dotted(node.func.value) or "<expr>"))
        elif isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load):
            found.uses.append(_use("reference", node.id, node.lineno, scope, ""))
        elif isinstance(node, ast.Attribute):
            found.uses.append(_use("reference", node.attr, node.lineno, scope, dotted(node.value) or "<expr>"))
        work.extend((child, below, child_in_class) for child in reversed(list(ast.iter_child_nodes(node))))
    found.exports = sorted({s["name"] for s in found.symbols if s["exported"] and not s["parent"]})
    return found


def _use(kind: str, name: str, line: int, scope: tuple[str, ...], receiver: str) -> dict:
    return {"use_kind": kind, "name": name, "line": line, "scope": ".".join(scope), "receiver": receiver}


def _symbol(name: str, kind: str, node: ast.AST, qualname: str, parent: str, signature: str, doc: str, end: bool = True) -> dict:
    return {"name": name, "kind": kind, "line": node.lineno, "qualname": qualname, "end_line": node.end_lineno if end else None, "parent": parent, "signature": signature, "exported": not name.startswith("_"), "doc": doc}


def _function(node: ast.FunctionDef | ast.AsyncFunctionDef, scope: tuple[str, ...], in_class: bool) -> dict:
    kind, signature = "method" if scope and in_class else "function", f"({', '.join(a.arg for a in node.args.args)})"
    for mark in node.decorator_list:
        name = dotted(mark)
        if isinstance(mark, ast.Call) and name.rpartition(".")[2] in ROUTES:
            at = next((a.value for a in mark.args if isinstance(a, ast.Constant) and isinstance(a.value, str)), "")
            kind, signature = "route", f"@{name} {at}".strip()
    return _symbol(node.name, kind, node, ".".join((*scope, node.name)), ".".join(scope), signature, first_line(node))


def _bindings(node: ast.Assign | ast.AnnAssign, source: str) -> list[dict]:
    targets = node.targets if isinstance(node, ast.Assign) else [node.target]
    names = [n for t in targets for n in ([t] if isinstance(t, ast.Name) else getattr(t, "elts", [])) if isinstance(n, ast.Name) and n.id != "__all__"]
    value = " ".join((ast.get_source_segment(source, node.value) or "").split())[:80] if names and node.value is not None else ""
    return [_symbol(n.id, "constant" if n.id.isupper() else "variable", node, n.id, "", value, "", end=False) for n in names]


def guarded_calls(source: str) -> Iterator[dict]:
    """(func, params, callee, unconditional, guards) of every call in every function; callee null for a function without calls."""
    try:
        tree = parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return
    for func in ast.walk(tree):
        if not isinstance(func, ast.FunctionDef | ast.AsyncFunctionDef):
            continue
        a = func.args
        params = sorted(p.arg for p in (*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))))
        seen: dict[str, tuple[bool, set[str]]] = {}
        work = [(s, frozenset()) for s in func.body]
        while work:
            node, guards = work.pop()
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef | ast.Lambda):
                continue
            if isinstance(node, ast.Call) and (name := dotted(node.func).rpartition(".")[2]):
                free, held = seen.get(name, (False, set()))
                seen[name] = (free or not guards, held | {g for g in guards if g})
            tested = _names(node.test) if isinstance(node, ast.If | ast.While | ast.IfExp) else frozenset()
            for name, value in ast.iter_fields(node):
                inner = guards
                if isinstance(node, ast.If | ast.While | ast.IfExp) and name in ("body", "orelse"):
                    inner = guards | tested | {""}
                elif isinstance(node, ast.For | ast.AsyncFor) and name in ("body", "orelse") or isinstance(node, ast.ExceptHandler) and name == "body":
                    inner = guards | {""}
                if isinstance(node, ast.BoolOp) and name == "values":
                    for i, part in enumerate(value):
                        work.append((part, guards | {""} | frozenset().union(*(_names(v) for v in value[:i])) if i else guards))
                    continue
                for child in value if isinstance(value, list) else [value]:
                    if isinstance(child, ast.AST):
                        work.append((child, inner))
        for name, (free, held) in seen.items():
            yield {"func": func.name, "params": params, "callee": name, "unconditional": free, "guards": sorted(held)}
        if not seen:
            yield {"func": func.name, "params": params, "callee": None, "unconditional": None, "guards": []}


def _names(node: ast.AST) -> frozenset[str]:
    return frozenset(n.id for n in ast.walk(node) if isinstance(n, ast.Name))


def thin_wrappers(source: str) -> Iterator[dict]:
    """(name, line, callee) of functions that only return a call of another with their own parameters."""
    try:
        tree = parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return
    for node in ast.walk(tree):
        if not isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            continue
        body = node.body[1:] if ast.get_docstring(node) is not None else node.body
        if len(body) != 1 or not isinstance(body[0], ast.Return) or not isinstance(body[0].value, ast.Call):
            continue
        call, params = body[0].value, [a.arg for a in node.args.args if a.arg not in ("self", "cls")]
        given = [a.id if isinstance(a, ast.Name) else None for a in call.args] + [k.value.id if isinstance(k.value, ast.Name) else None for k in call.keywords]
        callee = dotted(call.func)
        if callee and given == params and callee != node.name and not (isinstance(call.func, ast.Name) and callee in BUILTINS):
            yield {"name": node.name, "line": node.lineno, "callee": callee}


def comments(source: str) -> list[dict] | None:
    """(line, text) of every real comment; None where the source has no tokens to the end."""
    try:
        return [{"line": t.start[0], "text": t.string} for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type == tokenize.COMMENT]
    except (tokenize.TokenError, SyntaxError):
        return None

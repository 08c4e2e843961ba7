"""Facts of JavaScript and TypeScript source: a tokenizer, and a reader that goes over the tokens once.

The reader keeps the open brackets on a stack; a bracket that is the body of a declaration knows its symbol,
so scopes and last lines follow from the stack and not from the layout of lines. Source that stops in the
middle gives what was read until then.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from codeloom.sources.python_code import Facts


class Token(NamedTuple):
    kind: str  # name, number, text (a string), whole (a template or pattern), mark
    text: str
    line: int
    at: int


_LEX = re.compile(r"""(?P<void>[^\S\n]+|//[^\n]*|/\*(?s:.*?)(?:\*/|\Z))|(?P<row>\n)|(?P<name>[^\W\d][\w$]*|\$[\w$]*|\#[^\W\d][\w$]*)|(?P<number>\d[\w.]*)|(?P<text>"(?:[^"\\\n]|\\.)*+"?|'(?:[^'\\\n]|\\.)*+'?)|(?P<mark>=>|\.\.\.|\?\.|[^\w\s])""")
_PATTERN = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/\w*")
_PAIRS = {"(": ")", "[": "]", "{": "}"}
#: Words before a parenthesis that call nothing; words that may stand before a member's name; objects and
#: their methods that make a route.
NO_CALL = frozenset("if for while switch catch function return typeof await new else do try import export super constructor yield delete void in of async".split())
MODIFIERS = frozenset("public private protected static async get set readonly abstract override declare".split())
ROUTERS, ROUTE_METHODS = frozenset("app router server".split()), frozenset("get post put delete patch use all".split())


def tokens(source: str) -> list[Token]:
    """All tokens but blanks and comments."""
    found: list[Token] = []
    at, line, size = 0, 1, len(source)
    while at < size:
        if source[at] == "`":
            end = _template_end(source, at + 1)
            found.append(Token("whole", source[at:end], line, at))
            line += source.count("\n", at, end)
            at = end
            continue
        if source[at] == "/" and source[at : at + 2] not in ("//", "/*") and _value_may_begin(found) and (m := _PATTERN.match(source, at)):
            found.append(Token("whole", m[0], line, at))
            at = m.end()
            continue
        m = _LEX.match(source, at)
        if m is None:
            at += 1
            continue
        if m.lastgroup == "row":
            line += 1
        elif m.lastgroup == "void":
            line += m[0].count("\n")
        else:
            found.append(Token(m.lastgroup, m[0], line, at))
            line += m[0].count("\n")
        at = m.end()
    return found


def _template_end(source: str, at: int) -> int:
    """The place behind a template whose text begins at a place; templates may stand in its parts."""
    waiting = [0]  # open braces of each template's part, the innermost last; 0 in the text itself
    while at < len(source):
        c = source[at]
        if waiting[-1] == 0:
            if c == "\\":
                at += 1
            elif c == "`":
                waiting.pop()
                if not waiting:
                    return at + 1
            elif source.startswith("${", at):
                waiting[-1] = 1
                at += 1
        elif c == "`":
            waiting.append(0)
        elif c in "{}":
            waiting[-1] += 1 if c == "{" else -1
        at += 1
    return at


def _value_may_begin(found: list[Token]) -> bool:
    if not found:
        return True
    last = found[-1]
    return last.text in ("return", "typeof", "case", "in", "of", "delete", "void", "await") if last.kind == "name" else last.kind == "mark" and last.text not in (")", "]", "}")


def facts(source: str) -> Facts:
    return _Reader(source).read()


class _Reader:
    def __init__(self, source: str):
        self.source, self.tokens, self.found = source, tokens(source), Facts(confidence="inferred")
        self.stack: list[tuple[str, dict | None]] = []  # open brackets, with the symbol whose body one is
        self.path: list[str] = []  # the names of those symbols
        self.bodies: dict[int, dict] = {}  # places of brackets that open a body
        self.names: set[int] = set()  # places of names that a declaration gives, which are no calls
        self.exported: set[str] = set()

    def read(self) -> Facts:
        step = {"import": self._import, "export": self._export, "function": self._function, "class": self._class, "interface": self._interface, "type": self._type, "enum": self._enum, "const": self._variables, "let": self._variables, "var": self._variables}
        for i, t in enumerate(self.tokens):
            if t.kind == "mark":
                self._bracket(i, t)
            elif t.kind == "name" and not self._is(i - 1, ".", "?."):
                if t.text in step:
                    step[t.text](i)
                if self._is(i + 1, "(") and i not in self.names and not self._method(i):
                    self._call(i)
                if t.text == "exports":
                    self._set_export(i)
            elif t.kind == "name" and self._is(i + 1, "(") and i not in self.names:
                self._call(i)
        for s in self.found.symbols:
            s["exported"] = s["exported"] or s["name"] in self.exported
        self.found.exports = sorted({s["name"] for s in self.found.symbols if s["exported"] and not s["parent"]})
        return self.found

    # ---- looking at tokens

    def _is(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind != "text" and self.tokens[i].text in texts

    def _name(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) and self.tokens[i].kind == "name" else ""

    def _string(self, i: int) -> str | None:
        return self.tokens[i].text.strip("'\"") if 0 <= i < len(self.tokens) and self.tokens[i].kind == "text" else None

    def _beyond(self, i: int) -> int:
        """The place behind the bracket that opens at a place."""
        depth = 0
        for j in range(i, len(self.tokens)):
            t = self.tokens[j]
            if t.kind == "mark":
                depth += (t.text in _PAIRS) - (t.text in ")]}")
            if depth <= 0:
                return j + 1
        return len(self.tokens)

    def _beyond_types(self, i: int) -> int:
        """The place behind angle brackets, if some open at a place."""
        depth = 0
        if not self._is(i, "<"):
            return i
        for j in range(i, len(self.tokens)):
            depth += self._is(j, "<") - self._is(j, ">")
            if depth <= 0:
                return j + 1
            if self._is(j, ";"):
                break
        return i

    def _beyond_type(self, i: int) -> int:
        """The place behind a type that is said after a colon at a place."""
        if not self._is(i, ":"):
            return i
        i += 1
        while i < len(self.tokens):
            if self._is(i, "{", "(", "["):
                if self._is(i, "{") and not self._is(i - 1, ":", "|", "&", "<", ",", "=>"):
                    return i
                i = self._beyond(i)
            elif self._is(i, "=>", "=", ";", "}", ")"):
                return i
            else:
                i += 1
        return i

    def _dotted(self, i: int) -> tuple[str, int]:
        """A dotted name that begins at a place, and the place behind it."""
        name = self._name(i)
        while name and self._is(i + 1, ".") and self._name(i + 2):
            name, i = f"{name}.{self._name(i + 2)}", i + 2
        return name, i + 1

    def _list(self, i: int) -> tuple[list[str], int]:
        """Dotted names with commas between them, their type arguments left out."""
        names: list[str] = []
        while True:
            name, after = self._dotted(i)
            if not name:
                return names, i
            names.append(name)
            i = self._beyond_types(after)
            if not self._is(i, ","):
                return names, i
            i += 1

    # ---- scopes

    def _bracket(self, i: int, t: Token) -> None:
        if t.text in _PAIRS:
            symbol = self.bodies.get(i)
            self.stack.append((t.text, symbol))
            if symbol:
                self.path.append(symbol["name"])
        elif t.text in ")]}" and any(_PAIRS[o] == t.text for o, _ in reversed(self.stack)):
            while True:  # brackets left open inside end with the one around them
                opened, symbol = self.stack.pop()
                if symbol:
                    symbol["end_line"] = t.line
                    self.path.pop()
                if _PAIRS[opened] == t.text:
                    break

    def _add(self, name: str, kind: str, line: int, signature: str = "", exported: bool = False, body: int = -1) -> dict:
        made = {"name": name, "kind": kind, "line": line, "qualname": ".".join([*self.path, name]), "end_line": None, "parent": ".".join(self.path), "signature": signature, "exported": exported, "doc": ""}
        self.found.symbols.append(made)
        if self._is(body, "{"):
            self.bodies[body] = made
        return made

    def _is_exported(self, i: int) -> bool:
        i -= 1
        while self._name(i) in ("async", "abstract", "default", "declare", "const"):
            i -= 1
        return self._name(i) == "export"

    def _signature(self, i: int) -> tuple[str, int]:
        """The names of the parameters in the bracket at a place, and the place behind it."""
        end, names, depth, fresh = self._beyond(i), [], 0, True
        for j in range(i + 1, end - 1):
            t = self.tokens[j]
            if fresh and depth == 0 and t.text not in (",", "..."):
                names.append(("..." if self._is(j - 1, "...") else "") + (t.text if t.kind == "name" else t.text + _PAIRS.get(t.text, "")))
                fresh = t.text in MODIFIERS and self._name(j + 1) != ""
                if fresh:
                    names.pop()
            depth += self._is(j, "(", "[", "{", "<") - self._is(j, ")", "]", "}", ">")
            fresh = fresh or depth == 0 and self._is(j, ",")
        return f"({', '.join(names)})", end

    # ---- declarations

    def _function(self, i: int) -> None:
        at = i + 2 if self._is(i + 1, "*") else i + 1
        name = self._name(at)
        opens = self._beyond_types(at + 1)
        if not name or not self._is(opens, "("):
            return
        self.names.add(at)
        signature, after = self._signature(opens)
        self._add(name, "function", self.tokens[i].line, signature, self._is_exported(i), self._beyond_type(after))

    def _class(self, i: int) -> None:
        name = self._name(i + 1)
        if not name or name in ("extends", "implements"):
            return
        at, bases = self._beyond_types(i + 2), []
        if self._name(at) == "extends":
            base, at = self._dotted(at + 1)
            bases += [(base, "extends")] if base else []
            at = self._beyond_types(at)
        if self._name(at) == "implements":
            names, at = self._list(at + 1)
            bases += [(n, "implements") for n in names]
        if self._is(at, "{"):
            self._typed(name, "class", i, at, bases)

    def _interface(self, i: int) -> None:
        name = self._name(i + 1)
        at, names = self._beyond_types(i + 2), []
        if name and self._name(at) == "extends":
            names, at = self._list(at + 1)
        if name and self._is(at, "{"):
            self._typed(name, "interface", i, at, [(n, "extends") for n in names])

    def _typed(self, name: str, kind: str, i: int, body: int, bases: list[tuple[str, str]]) -> None:
        made = self._add(name, kind, self.tokens[i].line, "", self._is_exported(i), body)
        self.found.bases += [{"qualname": made["qualname"], "base": base, "line": made["line"], "relation": relation} for base, relation in bases]

    def _type(self, i: int) -> None:
        if self._name(i + 1) and self._is(self._beyond_types(i + 2), "="):
            self._add(self._name(i + 1), "type", self.tokens[i].line, "", self._is_exported(i))

    def _enum(self, i: int) -> None:
        if self._name(i + 1) and self._is(i + 2, "{"):
            self._add(self._name(i + 1), "enum", self.tokens[i].line, "", self._is_exported(i), i + 2)

    def _variables(self, i: int) -> None:
        """One declaration: the first name, its value and what it requires."""
        at = i + 1
        if self._is(at, "{", "["):
            after = self._beyond(at)
            if self._is(after, "=") and self._name(after + 1) == "require":
                self._require(after + 1, self._bindings(at) if self._is(at, "{") else [])
            return
        name = self._name(at)
        value = self._beyond_type(at + 1)
        if not name or name == "enum" or not self._is(value, "="):
            return
        value += 1
        if self._name(value) == "require":
            self._require(value, [{"name": None, "alias": name}])
        if self.path:
            return
        body, is_function = self._callable(value)
        if is_function:
            made = self._add(name, "function", self.tokens[i].line, "", self._is_exported(i), body)
            if not self._is(body, "{"):
                made["end_line"] = self.tokens[min(body, len(self.tokens) - 1)].line
            return
        begin = self.tokens[value].at if value < len(self.tokens) else len(self.source)
        row = self.source.find("\n", begin)
        text = self.source[begin : row if row >= 0 else len(self.source)].strip().rstrip(";")
        self._add(name, "constant" if name.isupper() else "variable", self.tokens[i].line, " ".join(text.split())[:80], self._is_exported(i))

    def _callable(self, i: int) -> tuple[int, bool]:
        """The place where the body of a function value begins, and whether there is one."""
        if self._name(i) == "async":
            i += 1
        if self._name(i) == "function":
            at = i + 1 + self._is(i + 1, "*")
            at += bool(self._name(at))
            return (self._beyond_type(self._beyond(at)), True) if self._is(at, "(") else (i, False)
        after = self._beyond_type(self._beyond(self._beyond_types(i))) if self._is(self._beyond_types(i), "(") else i + 1 if self._name(i) else i
        return (after + 1, True) if self._is(after, "=>") else (i, False)

    def _method(self, i: int) -> bool:
        """Whether a name before a parenthesis is a method of the class around it, which is then added."""
        name = self.tokens[i].text
        if not self.stack or self.stack[-1][0] != "{" or not self.stack[-1][1] or self.stack[-1][1]["kind"] != "class" or name in NO_CALL and name != "constructor":
            return False
        signature, after = self._signature(i + 1)
        body = self._beyond_type(after)
        if not self._is(body, "{"):
            return False
        self._add(name, "method", self.tokens[i].line, signature, True, body)
        return True

    # ---- uses

    def _call(self, i: int) -> None:
        name = self.tokens[i].text
        if name in NO_CALL or self.stack and self.stack[-1][1] and self.stack[-1][1]["kind"] == "interface":
            return
        parts, j = [], i
        while self._is(j - 1, ".", "?.") and self._name(j - 2):
            parts.append(self._name(j - 2))
            j -= 2
        receiver = ".".join(reversed(parts))
        t = self.tokens[i]
        self.found.uses.append({"use_kind": "call", "name": name, "line": t.line, "scope": ".".join(self.path), "receiver": receiver})
        if name == "require" and not receiver and not self._is(i - 1, "="):
            self._require(i, [])
        if receiver in ROUTERS and name in ROUTE_METHODS and (path := self._string(i + 2)):
            symbol = self._add(path, "route", t.line, f"{receiver}.{name} {path}")
            symbol["qualname"], symbol["parent"] = path, ""

    # ---- imports and exports

    def _require(self, i: int, bindings: list[dict]) -> None:
        if self._is(i + 1, "(") and (module := self._string(i + 2)) is not None:
            self._add_import(module, bindings, i)

    def _add_import(self, module: str, bindings: list[dict], i: int) -> None:
        self.found.imports.append({"module": module, "level": -1, "bindings": bindings, "line": self.tokens[i].line})

    def _bindings(self, i: int) -> list[dict]:
        """The names in braces at a place, with those they are bound to."""
        found, end, j = [], self._beyond(i) - 1, i + 1
        while j < end:
            if self._name(j) == "type" and self._name(j + 1) not in ("", "as"):
                j += 1
            if name := self._name(j):
                renamed = self._name(j + 1) == "as" or self._is(j + 1, ":")
                alias = self._name(j + 2) if renamed else name
                found.append({"name": name, "alias": alias or name})
            while j < end and not self._is(j, ","):
                j = self._beyond(j) if self._is(j, "{", "(", "[") else j + 1
            j += 1
        return found

    def _import(self, i: int) -> None:
        if self._is(i + 1, "("):
            if (module := self._string(i + 2)) is not None:
                self._add_import(module, [], i)
            return
        bindings, j = [], i + 1
        if self._name(j) == "type" and not self._is(j + 1, ",") and self._name(j + 1) != "from":
            j += 1
        while j < len(self.tokens) and self._name(j) != "from" and self._string(j) is None:
            if self._is(j, "{"):
                bindings += self._bindings(j)
                j = self._beyond(j)
            elif self._is(j, "*") and self._name(j + 1) == "as":
                bindings.append({"name": None, "alias": self._name(j + 2)})
                j += 3
            elif name := self._name(j):
                bindings.append({"name": "default", "alias": name})
                j += 1
            elif self._is(j, ","):
                j += 1
            else:
                return
        module = self._string(j + 1 if self._name(j) == "from" else j)
        if module is not None:
            self._add_import(module, bindings, i)

    def _export(self, i: int) -> None:
        if self._is(i + 1, "{"):
            self.exported.update(b["name"] for b in self._bindings(i + 1))
        elif self._name(i + 1) == "default" and self._name(i + 2) and (self._is(i + 3, ";") or i + 3 >= len(self.tokens) or self.tokens[i + 3].line > self.tokens[i + 2].line):
            self.exported.add(self._name(i + 2))

    def _set_export(self, i: int) -> None:
        if self._is(i + 1, ".") and self._name(i + 2) and self._is(i + 3, "="):
            self.exported.add(self._name(i + 2))

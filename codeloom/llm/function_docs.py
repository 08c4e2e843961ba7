"""Functions paired with their documentation.

The method: declarations are islands in a file. At each place where one may begin, its head is parsed
by a generalised LL recogniser, which follows all readings of nested types and defaults at once; where
no reading ends, tokens are skipped up to the next line, so a broken file loses only the function that
is broken. Bodies, where they are asked for, are parsed by the same recogniser: logical lines and their
indentation in Python, brackets in scripts. Where a body breaks off or does not parse, the statements
before the first that does not are its code. The docstring, or the comment directly above, is taken whole. It is dropped if, without
directives, notes to self, stamps, rulers and tags, no words are left but those of the name and the
parameters; and if the same description, with its own names left out, stands under very many different
names in the corpus, which hash counts show.

Defined results: null and empty texts have no functions; a function without documentation, with an
empty one or with one that is cut off by the end of the file has none; repeated rows count once;
functions redefined in a file are told apart by their lines; further columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from inspect import cleandoc

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.grammar import Grammar, Recogniser, none_of
from codeloom.runtime import checkpoint, spread

#: A description under at least so many different names is a template.
TEMPLATE_NAMES = 40

#: Left-recursive, so that a long list shares one node of the stack.
_OPENERS = ("(", "[", "{", ")", "]", "}")
HEADS: Grammar = {
    "params": (("(", "args", ")"),),
    "args": ((), ("list",), ("list", ",")),
    "list": (("arg",), ("list", ",", "arg")),
    "arg": (("piece",), ("arg", "piece")),
    "piece": ((none_of(*_OPENERS, ",", "\n"),), ("group",), ("\n",)),
    "group": (("(", "inner", ")"), ("[", "inner", "]"), ("{", "inner", "}")),
    "inner": ((), ("inner", "piece"), ("inner", ",")),
    "type": (("bit",), ("type", "bit")),
    "bit": ((none_of(*_OPENERS, ";", "\n", ":", "="),), ("group",), ("=>",)),
    "python": (("params", "result", ":"),),
    "result": ((), ("->", "type")),
    "script": (("params", "typed", "{"), ("params", "typed", "=>")),
    "typed": ((), (":", "type")),
    # Bodies: L is a logical line, a row its end, IN and OUT its indentation; ? is a line that is none.
    "suite": (("L", "row"), ("row", "IN", "rows", "OUT")),
    "rows": (("statement",), ("rows", "statement")),
    "statement": (("L", "row"), ("L", "row", "IN", "rows", "OUT")),
    "line": (("word",), ("line", "word")),
    "word": ((none_of(*_OPENERS),), ("group",)),
}
_TOKEN = re.compile(r"""[^\W\d][\w$]*|\d[\w.]*|->|=>|\.\.\.|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|\#[^\n]*|//[^\n]*|/\*(?s:.*?)\*/|\n|[^\s\w]""")
_PY_HEAD = re.compile(r"^([ \t]*)(?:async[ \t]+)?def[ \t]+([^\W\d]\w*)[ \t]*(?=\()", re.M)
_JS_HEAD = re.compile(
    r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:(?:public|private|protected|static|override|abstract|readonly|async|get|set)[ \t]+)*"
    r"(?:(?:function[ \t]*\*?[ \t]*|\*[ \t]*)?(\#?[A-Za-z_$][\w$]*)[ \t]*(?:<[^()\n]*>)?|(?:const|let|var)[ \t]+([A-Za-z_$][\w$]*)[ \t]*(?::[^=\n]*)?=[ \t]*(?:async[ \t]*)?(?:function\b[ \t]*[\w$]*[ \t]*)?)(?=\()(?=[^\n]*[^;\s][ \t\r]*$)",
    re.M,
)
_NOT_NAMES = frozenset("if for while switch catch return function with await typeof new".split())
_PY_DOC = re.compile(r"""[ \t]*(?:\#[^\n]*)?(?:\r?\n(?:[ \t]*(?:\#[^\n]*)?\r?\n|[<=>|]{7}[^\n]*\n)*[ \t]*)?[rRuU]?("\"\"|'''|"|')""".replace('"\\"\\"', '"""'))
_CLOSE = {q: re.compile(rf"(?:[^\\]|\\(?s:.))*?{q}", re.S) for q in ('"""', "'''")} | {q: re.compile(rf"(?:[^\\\n{q}]|\\(?s:.))*{q}") for q in ('"', "'")}
#: The middle of an unresolved merge, which no documentation holds.
_CLASH = re.compile(r"^={7}$", re.M)
_recogniser = Recogniser(HEADS)


def _head(text: str, at: int, rule: str) -> tuple[int, list[str]] | None:
    """The end of a function's head whose parameters begin at a place, and their tokens."""
    tokens, places, depth = [], [], 0
    for m in _TOKEN.finditer(text, at):
        token = m.group()
        if token[0] == "#" and rule == "python" or token[:2] in ("//", "/*"):
            continue
        if token == "\n" and depth <= 0:
            break
        tokens.append(token)
        places.append(m.end())
        depth += 1 if token in "([" else -1 if token in ")]" else 0
    found = _shape_ends(rule, tuple("n" if t[0].isalnum() or t[0] in "_$\"'`" else t for t in tokens))
    return found and (places[found[0] - 1], tokens[1 : found[1] - 1])


@lru_cache(maxsize=1 << 16)
def _shape_ends(rule: str, shape: tuple[str, ...]) -> tuple[int, int] | None:
    """Where a head and its parameters end; heads of one shape are parsed once."""
    ends = _recogniser.ends(rule, shape)
    if not ends:
        return None
    end = max(ends) if rule == "script" else min(ends)
    return end, min(_recogniser.ends("params", shape), default=end)


def _names(tokens: list[str]) -> list[str]:
    """The names of parameters: the first name after an opening or a comma outside of groups."""
    names, depth, fresh = [], 0, True
    for token in tokens:
        if token in "([{":
            depth += 1
        elif token in ")]}":
            depth -= 1
        elif token == "," and depth <= 0:
            fresh = True
        elif fresh and (token[0].isalpha() or token[0] in "_$"):
            names.append(token)
            fresh = depth > 0
    return names


def functions_of(path: str, text: str, code: bool = False) -> Iterator[tuple[int, str, list[str], str, str]]:
    """(line, name, parameters, documentation, code) of each function of a file."""
    python = path.endswith((".py", ".pyi"))
    if not python and not path.endswith((".js", ".ts", ".mjs", ".jsx", ".tsx")):
        return
    line, seen = 1, 0
    for m in (_PY_HEAD if python else _JS_HEAD).finditer(text):
        name = m[2] if python else m[1] or m[2]
        if name in _NOT_NAMES:
            continue
        line += text.count("\n", seen, m.start())
        seen = m.start()
        above = "" if python else _above(text, m.start())
        if not python and not above and not code:
            continue
        head = _head(text, m.end(), "python" if python else "script")
        if head is None:
            continue
        doc = _docstring(text, head[0]) if python else above
        if doc or code:
            yield line, name, _names(head[1]), doc, _code(text, m.start(), head[0], len(m[1]) if python else -1) if code else ""


def _docstring(text: str, at: int) -> str:
    m = _PY_DOC.match(text, at)
    if not m:
        return ""
    end = _CLOSE[m[1]].match(text, m.end())
    if not end:
        return ""
    doc = text[m.end() : end.end() - len(m[1])].replace("\r\n", "\n")
    return cleandoc(doc[: clash.start()] if (clash := _CLASH.search(doc)) else doc)


def _above(text: str, at: int) -> str:
    """The comment whose last line is the line above, without its marks."""
    end = at - 1
    if end < 0:
        return ""
    begin = text.rfind("\n", 0, end) + 1
    last = text[begin:end].strip()
    if last.endswith("*/"):
        open_ = text.rfind("/*", 0, end)
        if open_ < 0 or text[text.rfind("\n", 0, open_) + 1 : open_].strip():
            return ""
        body = text[open_ + 2 : text.rfind("*/", 0, end)]
        return "\n".join(re.sub(r"^[ \t]*\*+[ \t]?|^[ \t]+|[ \t\r]+$", "", x) for x in body.lstrip("*!").split("\n")).strip()
    if not last.startswith("//"):
        return ""
    rows = []
    while last.startswith("//"):
        rows.append(last.lstrip("/").strip())
        end = begin - 1
        if end < 0:
            break
        begin = text.rfind("\n", 0, end) + 1
        last = text[begin:end].strip()
    return "\n".join(rows[::-1]).strip()


_PARTS = re.compile(r"""(?P<row>\n)|(?P<void>[ \t\r\f]+|\\\r?\n|\#[^\n]*)|(?P<text>[rRbBuUfF]{0,2}(?:\"\"\"(?:[^\\]|\\(?s:.))*?(?:\"\"\"|\Z)|\'\'\'(?:[^\\]|\\(?s:.))*?(?:\'\'\'|\Z)|"(?:[^"\\\n]|\\(?s:.))*"?|'(?:[^'\\\n]|\\(?s:.))*'?))|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<word>\w+|.)""", re.S)
_BRACKETS = re.compile(r"""//[^\n]*|/\*(?s:.*?)\*/|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\(?s:.))*`|([{}()\[\]])""")


_EXPRESSION = re.compile(_BRACKETS.pattern.replace(r"([{}()\[\]])", r"([{}()\[\];\n])"))


def _code(text: str, start: int, head: int, indent: int) -> str:
    """The function's source: its block by indentation, or by brackets where indent is below 0."""
    end = _script_end(text, head) if indent < 0 else _suite_end(text, head, indent)
    return text[start:end].rstrip()


def _script_end(text: str, head: int) -> int:
    """Where the braces that open at the end of a head close; of a body without any, where its expression ends."""
    if text[head - 1] != "{":
        while head < len(text) and text[head].isspace():
            head += 1
        if not text.startswith("{", head):
            depth = 0
            for m in _EXPRESSION.finditer(text, head):
                depth += (m[1] in ("(", "[", "{")) - (m[1] in (")", "]", "}")) if m[1] else 0
                if depth < 0 or depth == 0 and m[1] in (";", "\n"):
                    return m.start()
            return len(text)
        head += 1
    signs, places, depth = ["{"], [head], 1
    for m in _BRACKETS.finditer(text, head):
        if m[1]:
            signs.append(m[1])
            places.append(m.end())
            depth += 1 if m[1] in "{([" else -1
            if depth <= 0:
                break
    ends = _ends("group", tuple(signs))
    return places[max(ends) - 1] if ends else len(text)


@lru_cache(maxsize=1 << 16)
def _ends(rule: str, shape: tuple[str, ...]) -> frozenset[int]:
    return frozenset(_recogniser.ends(rule, shape))


def _suite_end(text: str, head: int, indent: int) -> int:
    """Where the suite of a Python function ends whose head ends at a place."""
    signs: list[str] = []
    places: list[int] = []
    levels, line, depth, fresh, last = [indent], [], 0, False, head

    def put(sign: str, place: int) -> None:
        signs.append(sign)
        places.append(place)

    for m in _PARTS.finditer(text, head):
        kind = m.lastgroup
        if kind == "row" and depth == 0:
            if line or not signs:
                if line:
                    put("L" if len(line) in _ends("line", tuple(line)) else "?", last)
                put("row", last)
                line = []
            fresh = True
            continue
        if kind in ("void", "row"):
            continue
        if fresh:
            fresh, width = False, m.start() - text.rfind("\n", 0, m.start()) - 1
            if width <= indent:
                break
            while width < levels[-1]:
                levels.pop()
                put("OUT", last)
            if width > levels[-1]:
                levels.append(width)
                put("IN", last)
        depth = max(0, depth + (kind == "open") - (kind == "close"))
        line.append(m.group() if kind in ("open", "close") else "w")
        last = m.end()
    if line:  # the text broke off in a line
        put("L" if len(line) in _ends("line", tuple(line)) else "?", last)
        put("row", last)
    if "?" in signs:
        cut = signs.index("?")
        del signs[cut:], places[cut:]
    at = places[-1] if places else head
    opened = signs.count("IN") - signs.count("OUT")
    ends = _ends("suite", (*signs, *["OUT"] * opened))
    places += [at] * opened
    return places[max(ends) - 1] if ends else at


# ---------------------------------------------------------------- what documentation says

_DIRECTIVE = re.compile(r"(?i)^\s*(?:noqa\b|pragma\b|pylint\s*:|type\s*:\s*ignore|mypy\s*:|ruff\s*:|flake8\s*:|fmt\s*:|isort\s*:|yapf\s*:|nosec\b|eslint\b|eslint-\w+|tslint\s*:|@ts-\w+|ts-ignore|prettier-ignore|istanbul\b|c8\s+ignore|v8\s+ignore|jshint\b|jslint\b|globals?\s+[\w$]+(?:\s*[:,]\s*[\w$]+)*\s*$|webpack\w+|sourceMappingURL|biome-ignore|@(?:private|public|protected|internal|override|inheritdoc|ignore|hidden|deprecated|async|static|abstract|readonly)\s*$)")
_NOTE = re.compile(r"(?i)^\s*(?:todo|fixme|xxx|hack|tbd|wip|note to self|nb)\b.*$")
_STAMP = re.compile(r"(?i)^\s*(?:@?(?:created|modified|updated|changed|generated|author|authors|since|version|date|copyright|license|last\s+(?:modified|updated|changed|edited)|added|written)\b\s*(?:\(c\)|by|on|in|at|:)?\s*[\w.,:/@<>() -]{0,60}\d{4}[-/.]?[\d/.:-]*\S*|@(?:author|since|version|copyright|license|date)\b.*|author\s*:.*|\$\w+[^$]*\$)\s*\.?$")
_RULER = re.compile(r"^[\W_]*$")
_PLACEHOLDER = re.compile(r"(?i)^\W*(?:description|docstring|documentation|docs?|doc string|summary|comment|placeholder|tbd|n/?a|none|missing|empty|insert .*here|add (?:docs?|description|documentation).*|document (?:me|this).*|write (?:docs?|me).*|no (?:description|docs?|documentation).*|(?:function|method) (?:description|documentation|docs?)|undocumented|see (?:above|below|code|name)|self[- ]explanatory|lorem ipsum.*)\W*$")
_TAG = re.compile(r"(?m)^\s*(?:[:@\\](?:param|parameter|arg|argument|key|keyword|type|raises?|throws?|exception|returns?|rtype|yields?|template|property|prop)\b\s*(?:\{[^}]*\})?\s*(?:\[?[\w$.*]+(?:\s*=[^\]]*)?\]?)?\s*:?\s*-?|(?:args|arguments|parameters|params|returns?|raises|yields|example|examples|note|notes)\s*:\s*$)", re.I)
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_]+")
#: Words that tell nothing beyond a name.
_HOLLOW = frozenset("this that these the a an it its function method procedure routine helper util utility callback handler will would shall should can may does do did done is are be been was were has have to of for from in on at by with and or as into given then which who when where if any all some value values argument arguments arg args param params parameter parameters return returns returned result results self cls none null void object objects class instance simply just used uses use using call calls called perform performs execute executes implementation implements implement".split())


def _stems(words: str) -> set[str]:
    return {w for x in _PIECE.findall(words) for w in _stem(x.lower())}


def _stem(word: str) -> tuple[str, ...]:
    for end in ("ing", "ed", "es", "s", "e", "er"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            return (word, word[: -len(end)])
    return (word,)


def telling(doc: str, name: str, params: list[str]) -> str:
    """What of the documentation is left without what says nothing; empty if it is trivial."""
    rows = []
    for row in doc.split("\n"):
        row = row.strip(" \t*#/!-=~\r")
        if not row or _RULER.match(row) or _DIRECTIVE.match(row) or _NOTE.match(row) or _STAMP.match(row) or _PLACEHOLDER.match(row):
            continue
        row = _TAG.sub("", row).strip()
        if row:
            rows.append(row)
    known = _stems(" ".join([name, *params]))
    joined = "".join([name, *params]).lower()
    left = [w for row in rows for w in _PIECE.findall(row) if w.lower() not in _HOLLOW and not known.intersection(_stem(w.lower())) and not (len(w) > 2 and w.lower() in joined)]
    return "\n".join(rows) if len(left) >= 2 else ""


def _template(doc: str, name: str, params: list[str]) -> int:
    """A hash of the description without its own names and numbers."""
    own = _stems(" ".join([name, *params]))
    words = " ".join("_" if own.intersection(_stem(w.lower())) else w.lower() for w in _PIECE.findall(doc))
    return xxhash.xxh64_intdigest(words) - (1 << 63)


def documented_functions(files: DataFrame, path: str = "path", text: str = "text", code: bool = False) -> DataFrame:
    """(path, line, name, params, doc, telling, template, code) of every function with documentation."""
    wanted = files.filter(F.col(text).isNotNull() & F.col(path).rlike(r"\.(py|pyi|js|ts|mjs|jsx|tsx)$")).select(path, text)
    schema = f"`{path}` string, line int, name string, params array<string>, doc string, telling boolean, template long, code string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for line, name, params, doc, body in functions_of(p, t, code):
                    if doc:
                        left = telling(doc, name, params)
                        rows.append((p, line, name, params, doc if code else "", bool(left), _template(left, name, params) if left else 0, body))
            columns = list(zip(*rows)) if rows else [[]] * 8
            types = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[path, "line", "name", "params", "doc", "telling", "template", "code"])

    return spread(wanted).mapInArrow(run, schema)


def without_templates(functions: DataFrame, names: int = TEMPLATE_NAMES) -> DataFrame:
    """Functions whose description does not stand under so many different names."""
    counts = functions.select("template", "name").distinct().groupBy("template").agg(F.count("*").alias("_n")).filter(F.col("_n") >= names)
    return functions.join(counts.select("template"), "template", "left_anti")


def function_pairs(symbols: DataFrame, files: DataFrame, code: bool = False) -> DataFrame:
    """(sym_seq, qualname, signature, doc, code): functions and methods with telling documentation."""
    # Parsed once and written: the templates are counted and taken out over what was written.
    told = without_templates(checkpoint(documented_functions(files, code=code).filter("telling")))
    wanted = symbols.filter(F.col("kind").isin("function", "method")).select("sym_seq", "file", "line", "name", "qualname", "signature").dropna(subset=["sym_seq", "file", "line", "name"]).dropDuplicates(["sym_seq"])
    at = told.select(F.col("path").alias("file"), "line", "name", *(["doc", "code"] if code else [])).dropDuplicates(["file", "line", "name"])
    return wanted.join(at, ["file", "line", "name"]).select("sym_seq", "qualname", "signature", *(["doc", "code"] if code else []))

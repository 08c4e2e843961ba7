"""Source files that do not parse.

The method: a lexer for each language feeds a pushdown stack. The lexer finds unterminated literals
and characters that start no token; the stack holds open delimiters with what may stand inside them;
a small automaton on top of it follows what may come next - a value, an operator, a statement - and
finds premature ends, values without an operator between them, operators without a value, blocks
without a body, and merge-conflict markers outside of literals. JSON is recognised whole by its
automaton. Files that the automaton rejects are then tried with the exact parser of the language,
where this interpreter has one (Python, JSON, TOML).

Defined results: null text is no file to judge and is left out; empty text parses in every language
but JSON; suffixes without a lexer are left out; paths are judged by suffix in any case; repeated
rows count once; further columns are not looked at.
"""

from __future__ import annotations

import ast
import json
import re
import tomllib
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.runtime import spread

#: What may come next.
START, VALUE, OP, KEY, END, HEAD, BODY = range(7)
# START: a statement or an element may begin, or the enclosing delimiter may close.
# VALUE: a value has just ended. OP: an operator waits for a value. KEY: a keyword stands before.
# END: a block has ended; a statement may begin, or it was a value. HEAD: a condition has ended and
# a statement must follow. BODY: parameters have ended and a body must follow.

OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}

# ---------------------------------------------------------------- JavaScript and TypeScript

_JS = re.compile(
    r"""(?P<nl>\n)|(?P<space>[ \t\r\f\v\xa0\ufeff]+)
|(?P<com>//[^\n\u2028\u2029]*|/\*(?s:.*?)\*/)
|(?P<name>\#?[^\W\d][\w$]*|\$[\w$]*)
|(?P<num>0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)
|(?P<str>'(?:[^'\\\n]|\\(?s:.))*'|"(?:[^"\\\n]|\\(?s:.))*")
|(?P<tick>`)
|(?P<op>=>|\.\.\.|\?\.(?!\d)|>>>=|<<=|>>=|\*\*=|&&=|\|\|=|\?\?=|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|>>>|>>|[-+*/%&|^!~<>=?:,;.@(){}\[\]])""",
    re.X,
)
_JS_TEMPLATE = re.compile(r"(?:[^`\\$]|\\(?s:.)|\$(?!\{))*(`|\$\{)", re.S)
_JS_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_TS_GENERIC = re.compile(r"<(?:[^<>(){};=\n]|=>|<(?:[^<>(){};=\n]++|<[^<>(){};=\n]*+>)*+>)*+>(?=[\s(,;)=\[\]{|&>:])")
_JS_IMPORT = re.compile(r"""\s*(?:type\s+)?(?:(?:[\w$]+\s*,\s*)?(?:\*\s*as\s+[\w$]+|\{[^{}'"]*\})\s*from\s*|[\w$]+\s+from\s*)?(?:'[^'\n]*'|"[^"\n]*")|\s*[.(]|\s*[\w$]+\s*=""")

#: Reserved and contextual words of the language.
_KEYWORDS = frozenset("await break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof let new of return static switch throw try typeof var void while with yield async get set".split())
_TYPE_KEYWORDS = frozenset("abstract as asserts declare implements infer interface is keyof module namespace override private protected public readonly satisfies type unique accessor global".split())
_CONDITION = frozenset("if while for with switch catch".split())
_MAY_END = frozenset("return break continue debugger yield get set of static async let await type".split())
_PREFIX = frozenset("+ - ! ~ ++ -- ...".split())
_POSTFIX = frozenset(("++", "--"))
_PATTERN_BEFORE = frozenset("const let var import export return case throw default typeof new await yield in of delete void".split())


def script_fault(text: str, typed: bool) -> str | None:
    """Why a script does not parse, or None. typed: TypeScript, else an ECMAScript module."""
    scan, size = _JS.match, len(text)
    words = _KEYWORDS | _TYPE_KEYWORDS if typed else _KEYWORDS | {"as"}
    # A frame: the delimiter, what it is, the state to go on with after it.
    stack: list[tuple[str, str, int]] = []
    frame, state, at, newline = ("", "block", START), START, 0, True
    word = ""  # the last keyword, while KEY
    pending = ""  # class or function whose body has not come
    last = ""
    if text.startswith("#!"):
        at = text.find("\n")
        if at < 0:
            return None
    while at < size:
        m = scan(text, at)
        if m is None:
            return "unterminated literal" if text[at] in "'\"" else "unterminated comment" if text.startswith("/*", at) else "illegal character"
        kind, token, begun = m.lastgroup, m.group(), at
        at = m.end()
        if kind == "space":
            continue
        if kind == "nl":
            newline = True
            continue
        if kind == "com":
            newline = newline or "\n" in token
            continue
        if kind == "name":
            if last in (".", "?."):
                state, last, newline = VALUE, token, False
                if typed and text.startswith("<", at) and (g := _TS_GENERIC.match(text, at)):
                    at = g.end()
                continue
            if token in words and not (state in (START, END, VALUE) and frame[1] in ("object", "class") and text[at : at + 1] in (":", ",", "(", "}", "=", ";", "?")):
                if state == VALUE and not newline and token not in ("in", "instanceof", "of", "as", "is", "satisfies", "extends", "implements", "from", "async", "while", "else", "catch", "finally", "get", "set", "default", "type", "asserts", "infer"):
                    return "value without operator"
                if state == VALUE and token == "extends" and not pending and not typed:
                    return "value without operator"
                if state == BODY and not typed:
                    return "missing body"
                if state == OP and not (typed and last == ":" and frame[1] == "block") and token in ("in", "instanceof", "extends", "implements", "else", "catch", "finally", "case", "default", "break", "continue", "return", "throw", "try", "if", "for", "while", "do", "switch", "var", "const", "import", "export"):
                    if token not in ("import",) or text[at : at + 1] not in "(.":
                        return "operator without value"
                if token == "import" and state in (START, END) or token == "import" and state == VALUE and newline:
                    if not (g := _JS_IMPORT.match(text, at)):
                        return "malformed import"
                    if text[g.end() - 1] in "'\"":
                        if frame[0]:
                            return "import inside a block"
                        at, state, last, newline = g.end(), VALUE, "''", False
                        continue
                if token in ("export",) and frame[1] == "block" and frame[0] and not typed:
                    return "export inside a block"
                if token in ("class", "interface", "enum", "namespace"):
                    pending = "class"
                elif token == "function":
                    pending = "function"
                elif token in _CONDITION:
                    pending = token
                state, word, last, newline = KEY, token, token, False
                if token in ("async", "let", "get", "set", "of", "static", "type", "as", "is", "module", "namespace", "global", "declare", "abstract", "readonly", "public", "private", "protected", "override", "accessor", "unique", "asserts", "infer", "await", "yield", "keyof", "satisfies", "implements", "interface", "enum"):
                    follow = text[at : at + 2].lstrip()[:1]
                    if follow and follow in ".,;)=]}:?(" and token not in ("await", "yield") and not (token == "async" and follow == "("):
                        state = VALUE
                continue
            if token == "from" and state == VALUE:
                state, word, last, newline = KEY, "from", token, False
                continue
            if state == VALUE:
                if not newline or frame[0] in ("(", "[") or frame[1] == "object":
                    return "value without operator"
                if pending in ("class", "function"):
                    return "missing body"
            elif state == BODY and not typed:
                return "missing body"
            state, last, newline = VALUE, token, False
            if typed and text.startswith("<", at) and (g := _TS_GENERIC.match(text, at)):
                at = g.end()
            continue
        if kind in ("num", "str", "tick"):
            if state == VALUE:
                if kind == "tick":
                    pass  # a tagged template
                elif not newline or frame[0] in ("(", "[") or frame[1] == "object":
                    return "value without operator"
            elif state == BODY and not typed:
                return "missing body"
            if kind == "num" and at < size and (text[at].isalnum() or text[at] in "_$"):
                return "malformed number"
            if kind == "tick":
                m = _JS_TEMPLATE.match(text, at)
                if not m:
                    return "unterminated literal"
                at = m.end()
                if m[1] == "${":
                    stack.append(frame)
                    frame, state, last = ("`", "template", VALUE), OP, "${"
                    newline = False
                    continue
            state, last, newline = VALUE, "''", False
            continue
        # Punctuation.
        if token == "/" or token == "/=":
            if state not in (VALUE, END) or (state == END and newline):
                m = _JS_REGEX.match(text, begun)
                if not m:
                    return "unterminated literal"
                at, state, last, newline = m.end(), VALUE, "''", False
                continue
        if last in (".", "?.") and not (last == "?." and token in "(["):
            return "operator without value"
        if token in OPEN:
            if token == "(":
                after = VALUE
                what = "group"
                if pending in _CONDITION:
                    after, what, pending = HEAD, "for" if pending == "for" else "group", ""
                elif pending == "function":
                    after, what = BODY, "group"
                elif frame[1] == "class" and state in (VALUE, KEY):
                    after = BODY
                elif frame[1] == "object" and state in (VALUE, KEY) and last != ":" and not _colon_before(text, begun):
                    after = BODY
                elif state == BODY and not typed:
                    return "missing body"
                elif frame[1] == "object" and state == START:
                    return "value without operator"
            elif token == "[":
                after, what = VALUE, "list"
                if state == BODY and not typed:
                    return "missing body"
            else:
                after, what = END, "block"
                if pending == "class":
                    what, pending = "class", ""
                elif state == BODY or pending == "function":
                    after, pending = END, ""
                elif last == "=>":
                    after = END
                elif state == OP or (state == KEY and word in _PATTERN_BEFORE) or (state == START and frame[0] in ("(", "[")):
                    after, what = VALUE, "object"
                elif state == START and frame[1] in ("object", "class"):
                    return "value without operator"
                elif state == VALUE and frame[0] in ("(", "[") and not typed:
                    return "value without operator"
                elif state == VALUE and frame[1] == "object" and not typed:
                    return "value without operator"
            stack.append(frame)
            frame, state, last, newline = (token, what, after), START, token, False
            continue
        if token in CLOSE:
            if token == "}" and frame[0] == "`":
                if state not in (VALUE, END):
                    return "operator without value"
                frame = stack.pop()
                m = _JS_TEMPLATE.match(text, at)
                if not m:
                    return "unterminated literal"
                at = m.end()
                if m[1] == "${":
                    stack.append(frame)
                    frame, state, last = ("`", "template", VALUE), OP, "${"
                else:
                    state, last = VALUE, "''"
                newline = False
                continue
            if frame[0] != CLOSE[token]:
                return "unbalanced delimiter"
            if state in (OP, HEAD) or (state == BODY and not typed) or (state == KEY and word not in _MAY_END and token != "]"):
                return "operator without value"
            state, frame = frame[2], stack.pop()
            last, newline = token, False
            continue
        if token == ";":
            if frame[0] in ("(", "[") and frame[1] != "for":
                return "unbalanced delimiter"
            if frame[1] == "object" and not typed:
                return "unbalanced delimiter"
            if state == OP or (state == KEY and word not in _MAY_END) or (state == BODY and not typed):
                return "operator without value"
            if pending == "class":
                return "missing body"
            state, last, newline, pending = START, token, False, ""
            continue
        if token == ",":
            if state == OP or state == KEY and word not in _MAY_END or (state == START and frame[0] != "[") or state in (HEAD,) or (state == BODY and not typed):
                return "operator without value"
            state, last, newline = (START if frame[0] else OP), token, False
            if frame[1] == "block":
                state = OP
            continue
        if token == ":":
            if state in (START, HEAD, END) and not (typed and last == ")") or (state == OP and not (typed and last in ("?", "!"))) or (state == BODY and not typed):
                return "operator without value"
            state, last, newline = (OP if frame[1] != "block" else START if last == "default" else OP), token, False
            if frame[1] == "block" and not typed:
                state = START
            continue
        if token == "@":
            if not typed or state in (VALUE, OP):
                return "illegal character"
            state, last, newline = OP, token, False
            continue
        if token in _POSTFIX and state == VALUE and not newline:
            last = token
            continue
        if token in _PREFIX:
            if state == VALUE and token in ("!", "~", "...") and not newline:
                if typed and token == "!":
                    last = token
                    continue
                return "value without operator"
            if state == BODY and not typed:
                return "missing body"
            state, last, newline = OP, token, False
            continue
        if token in (".", "?."):
            if state == KEY and word in ("import", "new") or state in (VALUE, END):
                state, last, newline = OP, token, False
                continue
            return "operator without value"
        # A binary operator, an assignment, an arrow.
        if token == "*" and (state == KEY or state == START and frame[1] in ("class", "object")):
            if state == KEY and word in ("export", "import", "function", "yield", "async", "static"):
                last = token
                continue
            if state == START:
                continue
        if token == "=>" and state == BODY:
            state = VALUE
        if typed and token == "<" and state in (START, OP, KEY, BODY, END):
            if text[at : at + 1] in ("!", "/", "<", "=") or not (g := _TS_GENERIC.match(text, begun)):
                return "operator without value"
            at, last = g.end(), ">"
            continue
        if typed and token in ("|", "&") and state in (OP, START) and last in ("=", ":", "<", "(", ",", "|", "&") and last != token:
            state, last = OP, token
            continue
        if typed and token == "=" and last in ("?", "!"):
            state = VALUE
        if typed and token == "?" and last == "]":
            state = VALUE
        if typed and state == OP and last == "?" and token in (")", ","):
            state = VALUE
        if state not in (VALUE, END) and not (state == KEY and typed and word in _TYPE_KEYWORDS) and not (state == KEY and word in ("get", "set", "of", "async", "static", "let", "type")):
            return "operator without value"
        state, last, newline = OP, token, False
    if frame[0] or stack:
        return "premature end"
    if state in (OP, HEAD) or (state == BODY and not typed) or (state == KEY and word not in _MAY_END) or pending in ("class", "function", *_CONDITION):
        return "premature end"
    return None


def _colon_before(text: str, at: int) -> bool:
    """Whether a property's colon stands before this place in its line or the line above."""
    head = text[max(0, at - 200) : at]
    cut = max(head.rfind(","), head.rfind("{"))
    return ":" in head[cut + 1 :]


# ---------------------------------------------------------------- Python

_PY = re.compile(
    r"""(?P<space>[ \t\f]+|\\\r?\n)|(?P<com>\#[^\r\n]*)|(?P<nl>\r?\n|\r)
|(?P<str>(?:[rRbBfFuUtT]{0,2})(?:\"\"\"(?:[^"\\]|\\(?s:.)|"(?!""))*\"\"\"|'''(?:[^'\\]|\\(?s:.)|'(?!''))*'''|"(?:[^"\\\r\n]|\\\r\n|\\(?s:.))*"|'(?:[^'\\\r\n]|\\\r\n|\\(?s:.))*'))
|(?P<num>0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)
|(?P<name>[^\W\d]\w*)
|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|\*\*|//|<<|>>|[-+*/%@&|^~<>=:,;.(){}\[\]])""",
    re.X,
)
#: The words of the language, by what they want.
_PY_BLOCK = frozenset("if elif else for while try except finally with def class".split())
_PY_STATEMENT = frozenset("return raise assert del global nonlocal import from pass break continue yield".split())
_PY_BINARY = frozenset("in is and or if else for as from import".split())
_PY_UNARY = frozenset("not lambda await yield async".split())
_PY_CLOSED = frozenset("pass break continue return raise yield".split())


def python_suspect(text: str) -> str | None:
    """Why the lexer and the stack think that a Python file does not parse, or None."""
    scan, at, size = _PY.match, 0, len(text)
    stack: list[str] = []
    indents, state, first, colon, blank = [0], START, "", False, True
    line_start, last, want_block = 0, "", False
    tries: list[int] = []  # depths of try blocks that wait for a handler
    choices, loops = 0, False  # conditional expressions that wait for their else; a comprehension's if has none
    while at < size:
        m = scan(text, at)
        if m is None:
            return "unterminated literal" if text[at] in "'\"" else "illegal character"
        kind, begun = m.lastgroup, at
        at = m.end()
        if kind == "space" or kind == "com":
            continue
        token = m.group()
        if kind == "nl":
            if stack:
                continue
            if not blank:
                if state == OP or (state == KEY and last not in _PY_CLOSED):
                    return "operator without value"
                if first in _PY_BLOCK and not colon:
                    return "missing colon"
                if choices > 0 and not loops:
                    return "operator without value"
                want_block = last == ":"
                choices, loops = 0, False
            state, first, colon, blank, line_start, last = START, "", False, True, at, ""
            continue
        if blank:
            blank = False
            depth = _width(text[line_start:begun])
            if want_block:
                if depth <= indents[-1]:
                    return "missing block"
                indents.append(depth)
            elif depth > indents[-1]:
                return "unexpected indent"
            else:
                while depth < indents[-1]:
                    indents.pop()
                if depth != indents[-1]:
                    return "inconsistent dedent"
            want_block = False
            first = token if kind == "name" else ""
            while tries and depth <= tries[-1]:
                if depth < tries[-1] or first not in ("except", "finally"):
                    return "missing body"
                tries.pop()
            if first == "try":
                tries.append(depth)
        if kind == "name":
            if last == ".":
                state, last = VALUE, token
                if token in _PY_BLOCK or token in _PY_STATEMENT or token in _PY_UNARY:
                    return "keyword as a name"
                continue
            if token in _PY_BINARY and state == VALUE:
                if token == "if":
                    choices += 1
                elif token == "else":
                    choices -= 1
                elif token == "for":
                    loops = True
                state, last = KEY, token
                continue
            if token in _PY_BLOCK or token in _PY_STATEMENT or token in _PY_UNARY:
                if state == VALUE and token != "not":
                    return "value without operator"
                if state in (OP,) and token not in ("not", "lambda", "await", "yield"):
                    return "operator without value"
                if state == KEY and token in ("for", "if", "def", "with", "import", "in", "class") and last not in ("async", "else", ".", "from", "yield"):
                    return "operator without value"
                if token == "lambda":
                    state, last = KEY, "lambda"
                    continue
                state, last = KEY, token
                continue
            if token in ("in", "is", "and", "or", "as"):
                if not (last == "not" and token == "in"):
                    return "operator without value"
                state, last = KEY, token
                continue
            if state == VALUE and not (last in ("match", "case", "type", "print") and last == first) and not (first in ("match", "case", "type")):
                return "value without operator"
            state, last = VALUE, token
            continue
        if kind == "str" or kind == "num":
            if state == VALUE and not (kind == "str" and last == "''") and first not in ("match", "case"):
                return "value without operator"
            if kind == "num" and at < size and (text[at].isalnum() or text[at] == "_") and not text.startswith(("and", "or", "if", "else", "in", "is", "for", "not"), at):
                return "malformed number"
            if kind == "num" and len(token) > 1 and token[0] == "0" and token.strip("0_") and token.replace("_", "").isdigit():
                return "malformed number"
            if kind == "str" and token[0] in "fFrRtT" and token.count("{") != token.count("}") and "f" in token[:2].lower():
                return "unbalanced delimiter"
            state, last = VALUE, "''" if kind == "str" else token
            continue
        if token in OPEN:
            if last in ("def", "class"):
                return "operator without value"
            stack.append(token)
            state, last = START, token
            continue
        if token in CLOSE:
            if not stack or stack.pop() != CLOSE[token]:
                return "unbalanced delimiter"
            if state == OP or (state == KEY and last != "yield"):
                return "operator without value"
            state, last = VALUE, token
            continue
        if token == ":":
            if not stack:
                colon = True
            if state == OP or (state == KEY and last not in ("else", "try", "finally", "except", "lambda", "return")):
                return "operator without value"
            if state == START and not stack:
                return "operator without value"
            state, last = START, token
            continue
        if token == ",":
            if state != VALUE and not (last in ("*", "/") and stack) and not (last == ":" and stack) and not (last == "lambda"):
                return "operator without value"
            state, last = START, token
            continue
        if token == ";":
            if stack or state == OP or state == START:
                return "operator without value"
            state, last = START, token
            continue
        if token == "...":
            state, last = VALUE, token
            continue
        if token in ("-", "+", "~", "*", "**"):
            if token == "~" and state == VALUE:
                return "value without operator"
            if token in ("*", "**") and state == OP:
                return "operator without value"
            state, last = OP if token != "*" or not stack else START, token
            continue
        if token == "@" and not stack and state == START and last == "":
            state, last, first = OP, token, "@"
            continue
        if token == ".":
            if state != VALUE and not (first == "from"):
                return "operator without value"
            state, last = (OP if state == VALUE else KEY), token
            continue
        if token == "/" and stack and last == ",":
            state, last = VALUE, token
            continue
        if token == "=" and (stack and stack[-1] != "(") and not text.startswith(("]",), at):
            return "operator without value"
        if token == "->" and not (first in ("def", "async") and last == ")"):
            return "operator without value"
        if state != VALUE and not (last in ("''",)):
            return "operator without value"
        state, last = OP, token
    if stack:
        return "premature end"
    if not blank:
        if state == OP or (state == KEY and last not in _PY_CLOSED) or (first in _PY_BLOCK and not colon) or last == ":":
            return "premature end"
    if want_block or tries or (choices > 0 and not loops):
        return "premature end"
    return None


def _width(blanks: str) -> int:
    width = 0
    for c in blanks:
        width = (width // 8 + 1) * 8 if c == "\t" else 0 if c == "\f" else width + 1
    return width


def python_fault(text: str) -> str | None:
    reason = python_suspect(text)
    if reason is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return reason
    return None


# ---------------------------------------------------------------- JSON and TOML

_JSON = re.compile(r'[ \t\r\n]*(?:(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[\da-fA-F]{4}))*")|(?P<val>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|true\b|false\b|null\b)|(?P<p>[\[\]{},:]))')


def json_fault(text: str) -> str | None:
    """Why a text is not one JSON value, or None; the automaton is the whole grammar."""
    stack: list[str] = []
    # what may come: v a value, V a value or ], k a key or }, K a key, : a colon, e , or the end of the frame
    want, at, size = "v", 0, len(text.rstrip(" \t\r\n"))
    while at < size:
        m = _JSON.match(text, at)
        if not m:
            return "unterminated literal" if text[at:].lstrip().startswith('"') else "illegal character"
        at, kind = m.end(), m.lastgroup
        if kind == "str" and want in ("k", "K"):
            want = ":"
        elif kind in ("str", "val"):
            if want not in ("v", "V"):
                return "value without operator"
            want = "e"
        else:
            token = m["p"]
            if token in "[{":
                if want not in ("v", "V"):
                    return "value without operator"
                stack.append(token)
                want = "V" if token == "[" else "k"
            elif token in "]}":
                if not stack or stack[-1] != CLOSE[token] or want not in ("e", "V" if token == "]" else "k"):
                    return "unbalanced delimiter"
                stack.pop()
                want = "e"
            elif token == ":":
                if want != ":":
                    return "operator without value"
                want = "v"
            else:
                if want != "e" or not stack:
                    return "operator without value"
                want = "v" if stack[-1] == "[" else "K"
        if want == "e" and not stack and at < size:
            return "text after the end"
    return None if want == "e" and not stack else "premature end"


_TOML_KEY = r"""(?:[A-Za-z0-9_-]+|"(?:[^"\\\n]|\\.)*"|'[^'\n]*')"""
_TOML_KEYS = re.compile(rf"{_TOML_KEY}(?:[ \t]*\.[ \t]*{_TOML_KEY})*")
_TOML_HEADER = re.compile(rf"(\[\[|\[)[ \t]*({_TOML_KEYS.pattern})[ \t]*(\]\]|\])[ \t]*(?:#[^\n]*)?(?:\r?\n|$)")
_TOML_SPACE = re.compile(r"(?:[ \t\r\n]|#[^\n]*)*")
_TOML_VALUE = re.compile(
    r'''"""(?:[^"\\]|\\(?s:.)|"(?!""))*"{3,5}|\'\'\'(?:[^']|'(?!''))*'{3,5}|"(?:[^"\\\n]|\\[^\n])*"|'[^'\n]*'|true|false'''
    r"|\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d:\d\d(?:\.\d+)?"
    r"|[+-]?(?:inf|nan|0x[\da-fA-F_]+|0o[0-7_]+|0b[01_]+|(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?)(?![\w.])"
)
_TOML_END = re.compile(r"[ \t]*(?:#[^\n]*)?(?:\r?\n|$)")


def toml_suspect(text: str) -> str | None:
    at, size, table, seen = 0, len(text), "", set()
    while True:
        at = _TOML_SPACE.match(text, at).end()
        if at >= size:
            return None
        if text[at] == "[":
            m = _TOML_HEADER.match(text, at)
            if not m or len(m[1]) != len(m[3]):
                return "malformed table"
            table, at = m[2].replace(" ", ""), m.end()
            if m[1] == "[":
                if ("", table) in seen:
                    return "repeated table"
                seen.add(("", table))
            else:
                seen = {s for s in seen if s[0] != table and not s[1].startswith(table)}
            continue
        m = _TOML_KEYS.match(text, at)
        if not m:
            return "illegal character"
        key = (table + ".", m.group())
        if key in seen:
            return "repeated key"
        seen.add(key)
        if any(a.endswith(".") and a == key[0] and (b.startswith(m.group() + ".") or m.group().startswith(b + ".")) for a, b in seen if b != m.group()):
            return "repeated key"
        at = re.compile(r"[ \t]*").match(text, m.end()).end()
        if text[at : at + 1] != "=":
            return "operator without value"
        at = re.compile(r"[ \t]*").match(text, at + 1).end()
        at = _toml_value(text, at)
        if at < 0:
            return "malformed value"
        m = _TOML_END.match(text, at)
        if not m:
            return "value without operator"
        at = m.end()


def _toml_value(text: str, at: int) -> int:
    """The end of the value that begins here, or -1; nested values are kept on a stack."""
    stack, size = [], len(text)
    while True:
        if text[at : at + 1] in ("[", "{"):
            stack.append(text[at])
            at += 1
        else:
            m = _TOML_VALUE.match(text, at)
            if not m:
                return -1
            at = m.end()
            if not stack:
                return at
            at = _toml_gap(text, at, stack[-1])
            if text[at : at + 1] == ",":
                at += 1
        while True:  # after an opening, a comma or a value of a frame
            at = _toml_gap(text, at, stack[-1])
            if at >= size:
                return -1
            if text[at] == ("]" if stack[-1] == "[" else "}"):
                stack.pop()
                at += 1
                if not stack:
                    return at
                at = _toml_gap(text, at, stack[-1])
                if text[at : at + 1] == ",":
                    at += 1
                continue
            break
        if stack[-1] == "{":
            m = _TOML_KEYS.match(text, at)
            if not m:
                return -1
            at = _toml_gap(text, m.end(), "{")
            if text[at : at + 1] != "=":
                return -1
            at = _toml_gap(text, at + 1, "{")


def _toml_gap(text: str, at: int, frame: str) -> int:
    return _TOML_SPACE.match(text, at).end() if frame == "[" else re.compile(r"[ \t]*").match(text, at).end()


def toml_fault(text: str) -> str | None:
    reason = toml_suspect(text)
    if reason is None:
        return None
    try:
        tomllib.loads(text)
    except (tomllib.TOMLDecodeError, RecursionError):
        return reason
    return None


def json_checked(text: str) -> str | None:
    reason = json_fault(text)
    if reason is None:
        return None
    try:
        json.loads(text, parse_constant=float.fromhex)
    except (ValueError, RecursionError):
        return reason
    return reason if re.search(r"NaN|Infinity", text) else None


#: The lexer of each suffix.
FAULTS = {".py": python_fault, ".js": lambda t: script_fault(t, False), ".ts": lambda t: script_fault(t, True), ".json": json_checked, ".toml": toml_fault}


def fault(path: str | None, text: str | None) -> str | None:
    """Why the file does not parse, or None."""
    if path is None or text is None:
        return None
    judge = FAULTS.get(path[path.rfind(".") :].lower()) if "." in path else None
    return judge(text) if judge else None


def parse_faults(files: DataFrame, path: str = "path", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, keep..., fault) of every judged file; fault is null where it parses. One pass over the texts."""
    wanted = files.select(path, *keep, text).filter(F.col(text).isNotNull() & F.lower(path).rlike(r"\.(py|js|ts|json|toml)$"))
    schema = ", ".join(f"`{c}` {wanted.schema[c].dataType.simpleString()}" for c in (path, *keep)) + ", fault string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reasons = [fault(p, t) for p, t in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(reasons, pa.string())], names=[path, *keep, "fault"])

    return spread(wanted).mapInArrow(run, schema)


def broken_paths(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    return parse_faults(files, path, text).filter("fault is not null").select(path).distinct()


def fault_rates(files: DataFrame, path: str = "path", text: str = "text", root: str = "root", language: str = "language") -> DataFrame:
    """(root, language, files, broken, rate); rows of one path count once."""
    judged = parse_faults(files, path, text, (root, language)).dropDuplicates([path])
    return judged.groupBy(root, language).agg(F.count("*").alias("files"), F.count("fault").alias("broken")).withColumn("rate", F.col("broken") / F.col("files"))

"""Credentials embedded in source code.

The method: a keyword automaton passes over whole texts and names the lines worth a look; on those
lines issuer formats and the shapes of an assignment, a header, a login or a connection string are
matched by regular expressions. A token in an issuer's format is taken if its checksum holds or, for web
tokens, its head decodes; where neither does, and for all other values, the structure decides: alphabet,
length, and how mixed the characters are, after placeholders, references and digests are left out. A hit
is replaced by as many characters of the same alphabets, so that quotes, escapes and line ends around it
stay. Every pattern is linear in the line, however long: names are taken whole from their first letter,
and repeats that could share characters with what follows them give nothing back.

Defined results: null and empty texts have no credentials and come out as they are; lines are split at
line feeds and counted from 1; a private key counts once, at its opening line; repeated rows count
once; further columns pass through redaction untouched.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from itertools import product
from re import _constants as sre
from re import _parser as sre_parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.runtime import spread

#: A word that says that the value of a name is a credential.
_WORD = r"(?:pass(?:word|wd|phrase|code)|pwd|db_?pass|_pass|secret(?:_?key)?|token|api[_-]?key|access[_-]?key|signing[_-]?key|private[_-]?key|encryption[_-]?key|auth[_-]?key|credentials?)"
#: A whole dotted name whose last part holds such a word.
_NAME = rf"(?P<n>(?<![\w.\-])(?:[\w\-]*+\.)*+(?=[\w\-]*?{_WORD})[\w\-]++)"
_VALUE_Q = r"(?P<q>[\"'`])(?P<v>(?:(?!(?P=q)).)*+)(?P=q)"
_LOGIN = r"(?:log ?in|sign ?in|connect)"

#: Issuer formats: each is a credential wherever it stands.
ISSUED = re.compile(
    r"(?<![A-Za-z0-9_])(?:(?P<aws>A(?:K|S)IA[0-9A-Z]{16})|(?P<git>gh[oprsu]_[A-Za-z0-9]{36}|npm_[A-Za-z0-9]{36})|(?P<lab>github_pat_[A-Za-z0-9_]{22,}+|glpat-[\w-]{20,}+)|(?P<chat>xox[abprs]-\d{8,}+-[\w-]{16,}+)"
    r"|(?P<live>(?!pk_)[a-z]{2,8}_(?:live|prod)_[A-Za-z0-9]{16,}+)|(?P<maps>AIza[\w-]{35})|(?P<jwt>(?<!-)eyJ[\w-]{8,}+\.eyJ[\w-]{8,}+\.[\w-]{16,}+))(?![A-Za-z0-9])"
)
_URL = re.compile(r"(?<=[a-z0-9])://(?P<u>[^\s:/@\"'<>]*+):(?P<v>[^\s/\"'<>]+?)@[\w.\[-]", re.I)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BODY = re.compile(r"(?:[^\n:]*+:[^\n]*+\n)*+\s*+[\"']?[A-Za-z0-9+/=]{16,}+")
_SHAPES = tuple(
    re.compile(p, re.I)
    for p in (
        # name = "value", name: "value", "name": "value", ("NAME", "value"), name='value'
        rf"{_NAME}[\"'`]?\]?\)?(?:\s*+:\s*+[\w\[\]|]++(?:\ ++[\w\[\]|]++)*+)?\s*+(?::=|=>|[:=,]|\bis\b)\s*+(?:[rbfu]?){_VALUE_Q}",
        # name=value and name: value without quotes, to the end of the line or a blank; word value in prose
        rf"{_NAME}[\"'`]?\s*+(?:[:=]|\bis\b|\bwas\b)\s*+(?P<v>[^\s\"'`,;)}}]++)",
        rf"(?://|#|--|\*)\s*+(?P<n>(?=[\w\-]*?{_WORD})[\w\-]++)\s++(?P<v>[^\s\"'`,;]++)",
        # headers
        r"(?:authorization|x-api-key|x-auth-token|api-key)[\"'`]?\s*+[:=,]\s*+[\"'`]?(?:(?:bearer|basic|token|apikey)\s*+)?(?P<v>[^\s\"'`,;}]++)",
        r"\b(?:bearer|basic)\s++(?P<v>[^\s\"'`,;}]++)",
        # logins
        rf"\.(?:login|authenticate|connect|auth)\(\s*+[\"'][^\"']*+[\"']\s*+,\s*+{_VALUE_Q}",
        rf"identified\s++by\s++(?:password\s++)?{_VALUE_Q}",
        r"\s(?:-u|--user)[ =][\"']?[\w.@-]++:(?P<v>[^\s\"']++)",
        rf"{_LOGIN}(?:(?!{_LOGIN})[^`\n])*+`[^`]*+`\s*+(?:/|and|,)\s*+`(?P<v>[^`]++)`",
        rf"{_WORD}(?:(?!{_WORD})\w)*+[^`\n]{{0,40}}`(?P<v>[^`]++)`",
    )
)
#: A second literal that goes on with a value, after a plus or a blank.
_MORE = re.compile(r"""\s*+(?:\+\s*+)?["']((?:[^"'\\]|\\.)*+)["']""")


def _exact(op, arg) -> set[str] | None:
    """All texts, in lower case, that a part of a pattern can match, or None if they are not few."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {""}
    if op is sre.IN:
        return {chr(c).lower() for _, c in arg} if len(arg) <= 8 and all(o is sre.LITERAL for o, _ in arg) else None
    if op is sre.BRANCH:
        ways = [_exact_run(w) for w in arg[1]]
        return set().union(*ways) if all(w is not None for w in ways) else None
    if op is sre.SUBPATTERN:
        return _exact_run(arg[-1])
    if op is sre.MAX_REPEAT and arg[1] == 1:
        inner = _exact_run(arg[2])
        return None if inner is None else inner | {""} if arg[0] == 0 else inner
    return None


def _exact_run(parts) -> set[str] | None:
    texts = {""}
    for op, arg in parts:
        more = _exact(op, arg)
        if more is None or len(texts) * len(more) > 200:
            return None
        texts = {a + b for a, b in product(texts, more)}
    return texts


def _needed(parts) -> set[str]:
    """Texts of which every match holds at least one: those of the run of parts whose shortest text is longest."""
    best: set[str] = set()
    run = {""}

    def take(texts: set[str]) -> None:
        nonlocal best
        if texts and min(map(len, texts)) > min(map(len, best), default=0):
            best = texts

    for op, arg in parts:
        if op is sre.ASSERT:
            take(_needed(arg[1]))
        more = _exact(op, arg)
        if more is not None and len(run) * len(more) <= 200:
            run = {a + b for a, b in product(run, more)}
            continue
        take(run)
        run = more if more is not None else {""}
        if op is sre.BRANCH:
            ways = [_needed(w) for w in arg[1]]
            take(set().union(*ways) if all(ways) else set())
        elif op is sre.SUBPATTERN:
            take(_needed(arg[-1]))
        elif op is sre.MAX_REPEAT and arg[0] > 0:
            take(_needed(arg[2]))
    take(run)
    return best


def keywords_of(patterns) -> tuple[str, ...]:
    """The fewest texts in lower case of which a line must hold one to match any of the patterns."""
    found: set[str] = set()
    for p in patterns:
        words = _needed(sre_parser.parse(p.pattern, p.flags))
        if not words:
            raise ValueError(f"no keyword can be derived from {p.pattern}")
        found |= words
    return tuple(sorted(w for w in found if not any(v != w and v in w for v in found)))


#: What the automaton looks for: derived from the patterns, so that no line that one accepts is passed over.
KEYWORDS = keywords_of((ISSUED, _URL, _PEM, *_SHAPES))

#: What stands where a credential would, in templates and examples.
_EMPTY = re.compile(r"(?i)^(?:change[_-]?me.*|replace[_-]?me.*|your[_-].*|.*your[_-](?:key|token|secret|pass).*|example.*|.*example_?key.*|placeholder.*|dummy.*|sample.*|test|todo|tbd|none|null|nil|true|false|undefined|redacted|secret|password|hidden|n/?a|x+|\*+|\.+|-+|0+)$")
_REFERENCE = re.compile(r"(?i)(?:\$\{|\$\(|\$[A-Za-z_]|\{\{|\{[a-z_][\w.]*\}|<[^<>]*>|%\w+%|%\(|^(?:env|vault|ssm|secret|secrets|file|arn|op|aws|gcp|azure|kms|ref|keychain|sops|enc)[:/(\[]|^@|\bprocess\.env|\bos\.environ|\bgetenv|\bgetpass|://[^:@]*$)")
_DIGEST = re.compile(r"(?i)^(?:sha\d*|md5|blake\w*|bcrypt|argon\w*|pbkdf2|scrypt|crc\d*)[:$-]|^\$(?:2[aby]|argon2|pbkdf2|5|6)\$")
_PATH = re.compile(r"^(?:\.{0,2}/[\w./-]+|[A-Za-z]:\\.*|[\w-]+\.(?:pem|key|txt|json|ya?ml|env|crt|py|js))$")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
_CALLED = re.compile(r"[A-Za-z_$][\w.$]*[(\[]")
_CODE = re.compile(r"^[A-Za-z_][\w.]*(?:\(.*|\[.*)?$")
#: Names whose value is public although a keyword stands in them.
_PUBLIC = re.compile(r"(?i)(?:public|_id$|_file$|_path$|_url$|_name$|ref$|_hash$|_digest$|_count$|_type$|_ttl$|_len(?:gth)?$|_label$|_hint$|_field$)")


def plausible(value: str) -> bool:
    """Whether a value has the structure of a credential and is no placeholder, reference or digest."""
    value = value.strip()
    if len(value) < 8 or _EMPTY.match(value) or _REFERENCE.search(value) or _DIGEST.match(value) or _UUID.match(value) or _PATH.match(value) and not any(map(_packed, re.split(r"[/.]", value))):
        return False
    if " " in value:
        return False
    letters, digits = any(c.isalpha() for c in value), any(c.isdigit() for c in value)
    if not letters:
        return False
    if not digits:
        return bool(re.search(r"[a-z]", value) and re.search(r"[A-Z]", value) and len(value) >= 20 and not _CODE.match(value)) or (len(value) >= 24 and _mixed(value))
    if re.fullmatch(r"[a-z_]+_?\d{0,4}|[A-Z_]+_?\d{0,4}|v?\d[\d.]*[a-z]?", value):
        return False
    return len(set(value)) >= 5


def _packed(part: str) -> bool:
    """Whether a part of what looks like a path is none: long, and capitals, small letters and digits in one."""
    return len(part) >= 16 and any(c.isupper() for c in part) and any(c.islower() for c in part) and any(c.isdigit() for c in part)


def _mixed(value: str) -> bool:
    """Whether capitals and small letters change as often as in random text."""
    changes = sum(a.isupper() != b.isupper() for a, b in zip(value, value[1:]))
    return value.isalnum() and changes >= len(value) / 4


_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum_holds(token: str) -> bool:
    """Whether the last six characters of a token are the CRC-32, in base 62, of those between its prefix and them."""
    body, told = token[token.index("_") + 1 : -6], token[-6:]
    number = 0
    for c in told:
        number = number * 62 + _BASE62.index(c)
    return number == zlib.crc32(body.encode())


def head_decodes(token: str) -> bool:
    """Whether the first part of a web token is a JSON object that names its algorithm."""
    head = token.split(".", 1)[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError):
        return False


def issued(kind: str, token: str) -> bool:
    """Whether a token in an issuer's format is one: by checksum, decoded head, or else its mix of characters."""
    if "EXAMPLE" in token:
        return False
    if kind in ("aws", "maps") or kind == "git" and checksum_holds(token) or kind == "jwt" and head_decodes(token):
        return True  # the first two are of fixed length behind a prefix that stands for nothing else
    parts = [p[3:] if p.startswith("eyJ") else p for p in token.split(".")] if kind == "jwt" else [token[max(token.rfind("_"), token.rfind("-")) + 1 :] if kind in ("git", "live") else token[4:]]
    return all(len(set(p)) >= min(8, len(p) // 2) for p in parts)


def _values(line: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each credential in a line, private keys aside."""
    for m in ISSUED.finditer(line):
        if issued(m.lastgroup, m.group()):
            yield m.span()
    for m in _URL.finditer(line):
        if not _EMPTY.match(m["v"]) and not _REFERENCE.search(m["v"]) and len(m["v"]) >= 4:
            yield m.span("v")
    for shape in _SHAPES:
        for m in shape.finditer(line):
            groups = m.groupdict()
            if groups.get("n") and _PUBLIC.search(groups["n"]):
                continue
            value = m["v"]
            if groups.get("q") and line[m.end() : m.end() + 4].strip().startswith(("+", '"', "'")) and (rest := _MORE.match(line, m.end())):
                if plausible(value + rest[1]):
                    yield m.span("v")
                    yield rest.span(1)
                continue
            if not groups.get("q") and _CALLED.match(value):
                continue  # a call or an index, not a value
            if plausible(value):
                yield m.span("v")


def _automaton() -> ahocorasick.Automaton:
    words = ahocorasick.Automaton()
    for word in KEYWORDS:
        words.add_word(word, len(word))
    words.make_automaton()
    return words


class Finder:
    """Finds and redacts the credentials of a text."""

    def __init__(self) -> None:
        self.words = _automaton()

    def lines(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(number, start, line) of the lines in which a keyword stands."""
        low = text.lower()
        if len(low) != len(text):  # a letter grew by lowering: places would shift
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        number, start, end = 1, 0, -1
        for place, _ in self.words.iter(low):
            if place < end:
                continue
            number += text.count("\n", start, place)
            start = text.rfind("\n", 0, place) + 1
            end = text.find("\n", place)
            end = len(text) if end < 0 else end
            yield number, start, text[start:end]

    def spans(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(line number, start, end) of each credential."""
        closed = -1
        for number, start, line in self.lines(text):
            if start < closed:
                continue
            if m := _PEM.search(line):
                stop = text.find("-----", start + m.end())
                stop = len(text) if stop < 0 else stop
                if _BODY.match(text[start + m.end() : stop].replace("\\n", "\n").lstrip("\r\n\"'+ \\")) :
                    closed = stop
                    yield number, start + m.end(), stop
                continue
            for a, b in _values(line):
                yield number, start + a, start + b

    def redact(self, text: str) -> str:
        """The text with each credential replaced, character by character, within its alphabets."""
        chars = list(text)
        for _, a, b in self.spans(text):
            for i in range(a, b):
                chars[i] = _blank(chars[i])
        return "".join(chars)


def _blank(c: str) -> str:
    return "0" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c


def credentials(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Distinct (path, line): where a credential begins. One pass over whole texts, no shuffle but for distinct."""
    schema = f"`{path}` {files.schema[path].dataType.simpleString()}, line int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            at, lines = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for number in dict.fromkeys(n for n, _, _ in finder.spans(t)):
                    at.append(i)
                    lines.append(number)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(lines, pa.int32())], names=[path, "line"])

    wanted = files.filter(F.col(text).isNotNull() & F.col(path).isNotNull() & (F.col(text) != "")).select(path, text)
    return spread(wanted).mapInArrow(run, schema).distinct()


def redacted(files: DataFrame, text: str = "text") -> DataFrame:
    """The table with every credential of its texts replaced; all columns and rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            i = batch.schema.get_field_index(text)
            yield batch.set_column(i, batch.schema.field(i), pa.array([t and finder.redact(t) for t in batch.column(i).to_pylist()], batch.schema.field(i).type))

    return spread(files).mapInArrow(run, files.schema)

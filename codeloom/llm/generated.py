"""Generated, minified or vendored source files, and data saved as code.

The method: a Re-Pair grammar is inferred for the tokens of each file. Where rules are reused so much
that the grammar is a fraction of the text, the file is generated; a notice of a generator lowers the
bar, for short files have short grammars either way. Long literals whose own grammar hardly saves
anything make a data blob. Two of three marks make a minified file: crowded lines over the whole file,
names of one letter, and almost no white space.

Short files hold too few pairs twice for rules of their own to be compared, so the rules that files have
in common come from a Re-Pair round over the whole corpus: its symbols are lines of words, its pairs two
lines in a row, and a pair that stands in two repositories is a shared rule. Where nearly all rules of a
file are shared, or most are shared with a marked copy, it is a copy. Where fewer are, as with code that one repository alone has copied or has
edited much, a mark decides: a folder where copies are kept, or a notice that is not the repository's own.

Defined results: files without text or of other languages are left out; empty files are hand-written;
the stated kind and reason are not believed; repeated rows count once; further columns are not looked at.
"""

from __future__ import annotations

import keyword
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.repair import grammar_sizes, mix
from codeloom.runtime import checkpoint, spread

#: Grammar size over tokens: below the first a file is generated, below the second if a notice says so.
REUSE, REUSE_WITH_NOTICE = 0.62, 0.78
#: Share of characters in incompressible literals that makes a blob; least saving of such a literal.
BLOB_SHARE, INCOMPRESSIBLE = 0.6, 0.55
#: Marks of minified code, over at least so many tokens: white space below this share of the characters;
SPACE_SHARE, LEAST_TOKENS = 0.075, 60
#: so many characters or statements a line that is not blank; names of one letter.
LINE_CHARS, LINE_STATEMENTS, LETTER_SHARE = 150, 2.0, 0.5
#: Share of a file's rules that stand in two repositories or more, and their least number, that make it a copy without any mark.
SHARED, LEAST_RULES = 0.8, 30
#: The same where the rules also stand in a copy that a mark tells.
KNOWN, LEAST_KNOWN = 0.6, 5

#: Words and line ends; all numbers are one symbol, and marks stand between words anyway.
_TOKEN = re.compile(r"\d[\w.]*|([^\W\d]+|\n)")
_WORD = re.compile(r"\d[\w.]*|[^\W\d]+")
_NAME = re.compile(r"[^\W\d][\w$]*")
_RESERVED = frozenset((*keyword.kwlist, *"case catch const default delete do export extends function in instanceof let new null return super switch this throw true false typeof undefined var void while".split()))
_PACKED = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/=]{48,}+")
_LISTED = re.compile(r"(?:0x[0-9a-fA-F]+,?\s*){16,}|(?:\\x[0-9a-fA-F]{2}){16,}|(?<![\w.])(?:-?\d+(?:\.\d+)?,\s*){24,}")
_VALUE = re.compile(r"0x[0-9a-fA-F]+|\\x..|-?\d+(?:\.\d+)?")
_COMMENT = re.compile(r"""\s*(?:#|//|/\*+!?|\*|\"\"\"|''')\s?""")
#: How generators announce themselves.
_NOTICE = re.compile(r"(?i)(?:code generated by|(?:was|is) (?:produced|generated|created) by|@generated\b|<auto-\w+ |built automatically|auto-?generated|automatically generated|generated (?:by|from|with)|do not edit)")
_COPY_DIRS = re.compile(r"(?i)(?:^|/)(?:_?vendor|_?vendored|third[-_]party|3rdparty|extern|external|deps|contrib|node_modules|bower_components|site-packages)/")
_COPIED = re.compile(r"(?i)(?:taken from \S+ v?\d|bundled copy|vendored from|upstream \S+://|permission is (?:hereby )?granted|all rights reserved|licensed under|^\s*\S+ v?\d+\.\d+\.\d+\s*$)", re.M)


def head_of(text: str) -> list[str]:
    """The words of the comment that a file begins with, line by line."""
    rows, at = [], 0
    while at < len(text):
        end = text.find("\n", at)
        row = text[at : end if end >= 0 else len(text)]
        m = _COMMENT.match(row)
        if row.strip() and not m:
            if not (rows and row.startswith("__")):
                break
        rows.append(row[m.end() :].strip() if m else row.strip())
        at = end + 1 if end >= 0 else len(text)
    return rows


def looks_copied(path: str, root: str | None, head: list[str]) -> bool:
    """Whether a file lies where copies are kept or carries a notice that does not name its own repository."""
    below = path[len(root) :] if root and path.startswith(root) else path
    if _COPY_DIRS.search(below):
        return True
    words = "\n".join(head)
    if root and root in words or any(_NOTICE.search(row) for row in head):
        return False
    return bool(_COPIED.search(words))


def looks_minified(text: str) -> bool:
    """Whether two marks of minified code hold; either line-wrapping or long names or some spaces leave two."""
    lines = sum(1 for row in text.split("\n") if row.strip())
    crowded = len(text) >= LINE_CHARS * lines or text.count(";") >= LINE_STATEMENTS * lines
    bare = len(text) - len("".join(text.split())) < SPACE_SHARE * len(text)
    if crowded == bare:
        return crowded
    names = [n for n in _NAME.findall(text) if n not in _RESERVED]
    return sum(len(n) == 1 for n in names) >= LETTER_SHARE * max(len(names), 1)


def _line_rules(text: str) -> np.ndarray:
    """The names of the rules that two lines in a row make; a line is the symbol of its words."""
    lines = [" ".join(words) for row in text.split("\n") if (words := _WORD.findall(row))]
    symbols = np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, len(lines))
    return np.unique(mix(symbols[:-1], symbols[1:])).view(np.int64)


def judge(paths: list[str], roots: list[str | None], texts: list[str]) -> tuple[list[str | None], list[bool], list[np.ndarray]]:
    """Of each file: what it is (or None), whether it looks copied, and the rules of its lines."""
    tokens = [np.fromiter(map(hash, _TOKEN.findall(t)), np.int64) for t in texts]
    sizes = np.array([len(t) for t in tokens], np.int64)
    whole = np.concatenate(tokens).view(np.uint64) if len(tokens) else np.zeros(0, np.uint64)
    ratio = grammar_sizes(whole, np.repeat(np.arange(len(tokens)), sizes), len(tokens)) / np.maximum(sizes, 1)
    literal = _literal_shares(texts)
    verdicts, copied, rules = [], [], []
    for i, (path, root, text) in enumerate(zip(paths, roots, texts)):
        head = head_of(text)
        notice = any(_NOTICE.search(row) for row in head)
        verdict = None
        if sizes[i] and ratio[i] < (REUSE_WITH_NOTICE if notice else REUSE):
            verdict = "generated"
        elif literal[i] >= BLOB_SHARE:
            verdict = "blob"
        elif sizes[i] >= LEAST_TOKENS and looks_minified(text):
            verdict = "minified"
        verdicts.append(verdict)
        copied.append(verdict is None and looks_copied(path, root, head))
        rules.append(_line_rules(text) if verdict is None else np.zeros(0, np.int64))
    return verdicts, copied, rules


def _literal_shares(texts: list[str]) -> np.ndarray:
    """The share of each text's characters in long literals that a grammar hardly shortens."""
    spans = [(i, m.group()) for i, t in enumerate(texts) for m in _PACKED.finditer(t)]
    # Lists of numbers are looked for only where there are commas or escapes enough for one.
    spans += [(i, m.group()) for i, t in enumerate(texts) if max(8 * t.count(","), 4 * t.count("\\x")) > len(t) for m in _LISTED.finditer(t)]
    shares = np.zeros(len(texts))
    if not spans:
        return shares
    rows = [np.frombuffer(s.encode("ascii"), np.uint8).astype(np.uint64) if s[:2] not in ("0x", "\\x") and "," not in s else np.fromiter(map(hash, _VALUE.findall(s)), np.int64).view(np.uint64) for _, s in spans]
    sizes = np.array([len(r) for r in rows], np.int64)
    ratio = grammar_sizes(np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes), len(rows)) / np.maximum(sizes, 1)
    for (i, s), r in zip(spans, ratio):
        if r >= INCOMPRESSIBLE:
            shares[i] += len(s) / len(texts[i])
    return shares


def judged_files(files: DataFrame, path: str = "path", root: str = "root", text: str = "text") -> DataFrame:
    """(path, root, verdict, copied, rules) of every Python, JavaScript and TypeScript file with text."""
    wanted = files.filter(F.col(text).isNotNull() & F.col(path).rlike(r"\.(py|js|ts)$")).select(path, root, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                verdicts, copied, rules = judge(*(part.column(i).to_pylist() for i in range(3)))
                ends = np.concatenate([[0], np.cumsum([len(p) for p in rules])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rules) if rules else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(verdicts, pa.string()), pa.array(copied, pa.bool_()), lists], names=["path", "root", "verdict", "copied", "rules"])

    return spread(wanted).mapInArrow(run, "path string, root string, verdict string, copied boolean, rules array<long>")


def not_hand_written(files: DataFrame, path: str = "path", root: str = "root", text: str = "text") -> DataFrame:
    """Distinct (path, verdict) of the files that nobody wrote by hand for their repository."""
    judged = checkpoint(judged_files(files, path, root, text))
    found = judged.filter("verdict is not null").select("path", "verdict")
    rules = judged.filter("verdict is null").select("path", "root", "copied", F.size("rules").alias("n"), F.explode("rules").alias("rule"))
    # Rules are counted by repository before they meet, so a rule of very many files is one row.
    shared = rules.groupBy("rule", "root").agg(F.max("copied").alias("copied")).groupBy("rule").agg(F.count("root").alias("roots"), F.max("copied").alias("known")).filter("roots >= 2")
    met = rules.join(shared.select("rule", "known"), "rule", "left").groupBy("path").agg(F.avg(F.when(F.col("known").isNull(), 0).otherwise(1)).alias("share"), F.avg(F.when(F.col("known"), 1).otherwise(0)).alias("known"), F.max("n").alias("n"))
    alike = met.filter((F.col("share") >= SHARED) & (F.col("n") >= LEAST_RULES) | (F.col("known") >= KNOWN) & (F.col("n") >= LEAST_KNOWN)).select("path")
    more = alike.unionByName(judged.filter("copied").select("path")).distinct().select("path", F.lit("vendored").alias("verdict"))
    return found.unionByName(more).withColumnRenamed("path", path).distinct()


def hand_written(files: DataFrame, path: str = "path", root: str = "root", text: str = "text") -> DataFrame:
    """The rows of the judged languages that are left when the others are taken out."""
    kept = files.filter(F.col(text).isNotNull() & F.col(path).rlike(r"\.(py|js|ts)$"))
    return kept.join(not_hand_written(files, path, root, text).select(path).distinct(), path, "left_anti")

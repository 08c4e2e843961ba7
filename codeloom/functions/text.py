"""Scalar functions over names, paths and source text, as native columns.

All of them give null for null input unless their docstring says otherwise, work on whole texts, and
stay on the JVM: no user functions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.runtime import let

# ---------------------------------------------------------------- fixed values

#: Language by suffix and by whole name.
LANGUAGE_SUFFIXES = {
    "python": ".py .pyi", "javascript": ".js .mjs .cjs .jsx", "typescript": ".ts .tsx .mts .cts", "java": ".java", "kotlin": ".kt .kts", "go": ".go", "rust": ".rs", "ruby": ".rb",
    "php": ".php", "csharp": ".cs", "c": ".c .h", "cpp": ".cpp .cc .hpp", "swift": ".swift", "dart": ".dart", "scala": ".scala", "sql": ".sql", "html": ".html", "css": ".css",
    "scss": ".scss", "vue": ".vue", "svelte": ".svelte", "shell": ".sh .bash", "powershell": ".ps1", "batch": ".bat .cmd", "json": ".json", "yaml": ".yaml .yml", "toml": ".toml",
    "ini": ".ini .cfg", "xml": ".xml", "dotenv": ".env", "markdown": ".md", "rst": ".rst", "text": ".txt", "csv": ".csv .tsv",
}
LANGUAGE_NAMES = {"dockerfile": "dockerfile", "makefile": "makefile", "cmakelists.txt": "cmake"}
SOURCE_LANGUAGES = "python javascript typescript java kotlin go rust ruby php csharp c cpp swift dart scala sql html css scss vue svelte".split()
CONFIG_LANGUAGES = "json yaml toml ini xml dotenv".split()
DOC_LANGUAGES = "markdown rst text".split()
SCRIPT_LANGUAGES = "shell powershell batch dockerfile makefile cmake".split()
MANIFEST_NAMES = "package.json pyproject.toml setup.py setup.cfg requirements.txt pipfile cargo.toml go.mod pom.xml build.gradle build.gradle.kts gemfile composer.json cmakelists.txt makefile dockerfile pubspec.yaml".split()
TEST_DIRS = "test tests __tests__ spec specs testing e2e".split()
SCRIPT_DIRS = "scripts script bin tools".split()
GENERATED_DIRS = "generated __generated__ codegen gen".split()
GENERATED_SUFFIXES = ".pb.go .pb.py _pb2.py _pb2_grpc.py .g.dart .generated.ts .generated.js".split()
GENERATED_MARKERS = ("@generated", "DO NOT EDIT", "Code generated by", "autogenerated", "auto-generated", "AUTO-GENERATED")
TEST_NAMES = r"^(?:test_.*\.py|.*_test\.py|conftest\.py|.*\.test\..*|.*\.spec\..*|.*Test\.java|.*Tests\.java|.*Test\.kt|.*Tests\.cs|.*_test\.go|.*_spec\.rb|.*_test\.rs)$"
STOP_TERMS = "a an the for to of and or in on with this that is it be as at by if we do whether when should need want please function method class add code logic implement implementation some new".split()
SYNONYMS = tuple(
    group.split()
    for group in (
        "validate validator validation check verify assert ensure is_valid", "normalize normalise sanitize sanitise clean canonical canonicalize", "parse parser decode deserialize read load",
        "format formatter render encode serialize dump write to_string stringify", "convert converter transform map translate adapt adapter", "create make build builder factory new construct init",
        "get fetch retrieve find lookup query search resolve", "remove delete drop clear purge", "update set modify change patch edit", "email mail e_mail address", "user account member profile",
        "config configuration settings options preferences", "helper util utils utility common shared lib", "handler handle controller endpoint route view", "cache memo memoize store",
        "auth authenticate authentication login signin session token", "error exception failure fault", "slug slugify kebab", "string str text",
    )
)
CODE_WORDS = (
    "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield None True False self cls "
    "function const let var new this typeof instanceof switch case default throw catch export extends implements interface type enum public private static null undefined true false void delete of do"
).split()
CONFIDENCES, SEVERITIES, LEVELS = ("confirmed", "inferred", "unknown"), ("ok", "info", "warn", "error"), ("low", "elevated", "high")
PREFIX = 5
SHINGLE = 4


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _empty() -> Column:
    return F.array().cast("array<string>")


# ---------------------------------------------------------------- paths


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix_of(path: Column) -> Column:
    """The last suffix in lower case; empty for names without one, and for names that begin with their only dot."""
    return F.lower(F.regexp_extract(name_of(path), r"[^.](\.[^.]+)$", 1))


def language_of(path: Column) -> Column:
    """Language by whole name, else by suffix, else empty."""
    suffixes = [x for language, many in LANGUAGE_SUFFIXES.items() for s in many.split() for x in (F.lit(s), F.lit(language))]
    names = [F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair]
    return F.when(path.isNotNull(), F.coalesce(F.try_element_at(F.create_map(*names), F.lower(name_of(path))), F.try_element_at(F.create_map(*suffixes), suffix_of(path)), F.lit("")))


def classify(path: Column, language: Column, header: Column, is_text: Column) -> Column:
    """(kind, reason) of a file; the first rule that holds decides. header: the file's first five lines."""
    lower = F.lower(name_of(path))
    dirs = F.transform(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), F.lower)
    known = language.isin(SOURCE_LANGUAGES)

    def is_(kind: str, reason: str = "") -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))

    ends = F.lit(False)
    for s in GENERATED_SUFFIXES:
        ends = ends | lower.endswith(s)
    marked = F.lit(False)
    for m in GENERATED_MARKERS:
        marked = marked | header.contains(m)
    return (
        F.when(lower.isin(MANIFEST_NAMES) | lower.rlike(r"(?:\.csproj|\.sln|\.gemspec)$|^requirements.*\.txt$"), is_("manifest", "manifest filename"))
        .when(F.arrays_overlap(dirs, _strings(GENERATED_DIRS)), is_("generated", "generated directory"))
        .when(ends, is_("generated", "generated suffix"))
        .when(F.coalesce(is_text & marked, F.lit(False)), is_("generated", "generated marker in header"))
        .when(known & F.arrays_overlap(dirs, _strings(TEST_DIRS)), is_("test", "test directory"))
        .when(known & name_of(path).rlike(TEST_NAMES), is_("test", "test filename"))
        .when(language.isin(SCRIPT_LANGUAGES), is_("script", "script language"))
        .when(known & F.arrays_overlap(dirs, _strings(SCRIPT_DIRS)), is_("script", "script directory"))
        .when(known, is_("source"))
        .when(language.isin(CONFIG_LANGUAGES), is_("config"))
        .when(language.isin(DOC_LANGUAGES), is_("docs"))
        .when(language == "csv", is_("data"))
        .otherwise(is_("other"))
    )


def header_of(text: Column, lines: int = 5) -> Column:
    return F.substring_index(F.regexp_replace(text, "\r\n?", "\n"), "\n", lines)


def top_dir(path: Column) -> Column:
    return F.when(path.contains("/"), F.split_part(path, F.lit("/"), F.lit(1))).otherwise(F.when(path.isNotNull(), "."))


def normal_path(path: Column) -> Column:
    """Slashes for backslashes and no leading ``./``."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def is_inside(path: Column) -> Column:
    """Whether a relative path stays below its root."""
    return ~path.rlike(r"^/|(?:^|/)\.\.(?:/|$)|^[A-Za-z]:")


def safe_join(root: Column, path: Column) -> Column:
    """The path below a root, or null where it would leave it."""
    clean = normal_path(path)
    return F.when(is_inside(clean), F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), clean))


def mentioned_paths(text: Column) -> Column:
    """Relative paths with a directory and a suffix that a text names, first mention first, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![\w./-])((?:[\w.-]+/)+[\w.-]+\.[A-Za-z0-9]{1,8})"), F.lit(1)))


def file_node(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def symbol_node(file: Column, qualname: Column) -> Column:
    return F.concat(F.lit("sym:"), file, F.lit("::"), qualname)


def node_label(node: Column) -> Column:
    return F.regexp_replace(node, "^[^:]*:", "")


def node_file(node: Column) -> Column:
    return F.substring_index(node_label(node), "::", 1)


# ---------------------------------------------------------------- words


def terms(text: Column) -> Column:
    """Lower-case words of identifiers and prose with light stems, stop words left out; a set."""
    spaced = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.filter(F.split(F.lower(spaced), "[^A-Za-z0-9]+"), lambda w: (F.length(w) > 1) & ~w.isin(STOP_TERMS))

    def stems(w: Column) -> Column:
        cut = [F.when(w.endswith(s) & (F.length(w) - len(s) >= 3), F.substring(w, F.lit(1), F.length(w) - len(s))) for s in ("ing", "ed", "er", "es", "s")]
        return F.array(*cut, F.when(F.length(w) > PREFIX, F.substring(w, 1, PREFIX)), w)

    return F.array_distinct(F.filter(F.flatten(F.transform(words, stems)), lambda w: w.isNotNull()))


def keys(words: Column) -> Column:
    """Words folded to their first five letters; a set."""
    return F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, PREFIX)))


def expanded(words: Column) -> Column:
    """The words with every synonym group that holds one of them."""
    groups = [F.when(F.arrays_overlap(words, _strings(g)), _strings(g)).otherwise(_empty()) for g in SYNONYMS]
    return F.array_distinct(F.flatten(F.array(words, *groups)))


# ---------------------------------------------------------------- code tokens

#: Quoted parts are possessive: the JVM matches a group in a loop by recursion, which long lines exhaust.
TOKEN = r"""[A-Za-z_$][\w$]*|\d+(?:\.\d+)?|"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|[^\s\w]"""


def lines_of(text: Column) -> Column:
    """Lines, without the empty one after a last line end."""
    return F.split(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n$", ""), "\n")


def code_tokens(text: Column) -> Column:
    """Tokens of all lines that are neither blank nor led by a comment mark."""
    kept = F.filter(lines_of(text), lambda x: ~x.rlike(r"^\s*(?:#|//|\*|/\*|$)"))
    return F.flatten(F.transform(kept, lambda x: F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))))


def normalised(tokens: Column) -> Column:
    """Tokens with ``_`` for every name that is no word of a language."""
    return F.transform(tokens, lambda t: F.when(t.rlike("^[A-Za-z_$]") & ~t.isin(CODE_WORDS), "_").otherwise(t))


def shingles(tokens: Column, n: int = SHINGLE) -> Column:
    """The set of hashes of all runs of n tokens; empty if there are fewer."""

    def of(t: Column) -> Column:
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(t, i, n))))

    return let(tokens, of)


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Overlap over the smaller set."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(0.0)


def line_count(text: Column) -> Column:
    """Lines without a phantom one after the last line end; 0 for null and empty."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n")))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(breaks + F.when(text.endswith("\n"), 0).otherwise(1))


# ---------------------------------------------------------------- ranks


def rank_in(value: Column, order: tuple[str, ...]) -> Column:
    chain = F.when(value == order[0], 0)
    for i, name in enumerate(order[1:], 1):
        chain = chain.when(value == name, i)
    return chain


def named_rank(rank: Column, order: tuple[str, ...]) -> Column:
    return F.element_at(_strings(order), (rank + 1).cast("int"))


def weakest(*values: Column) -> Column:
    """The weakest of several confidences; unknown for none."""
    if not values:
        return F.lit("unknown")
    ranks = [rank_in(v, CONFIDENCES) for v in values]
    return named_rank(F.greatest(*ranks) if len(ranks) > 1 else ranks[0], CONFIDENCES)


def worst(value: Column, order: tuple[str, ...]) -> Column:
    """An aggregate: the highest of the order that occurs; the lowest for no rows."""
    return named_rank(F.coalesce(F.max(rank_in(value, order)), F.lit(0)), order)


# ---------------------------------------------------------------- tools and edits


def matcher_matches(matcher: str, tool: Column) -> Column:
    """Whether a matcher, empty or ``*`` for all, else a full-match pattern, takes a tool; invalid patterns take none."""
    if matcher in ("", "*"):
        return F.lit(True)
    try:
        re.compile(matcher)
    except re.error:
        return F.lit(False)
    return tool.rlike(f"^(?:{matcher})$")


def edit_shape(tool: Column, args: Column, exists: Column) -> Column:
    """(shape, lines) of a tool call whose arguments are JSON: new-file, rewrite, edit or unknown."""

    def field(name: str) -> Column:
        return F.get_json_object(args, f"$.{name}")

    chunk = F.from_json(F.get_json_object(args, "$.ReplacementChunks"), "array<struct<TargetContent:string,ReplacementContent:string>>")
    total = F.aggregate(F.transform(chunk, lambda c: F.greatest(line_count(c["TargetContent"]), line_count(c["ReplacementContent"]))), F.lit(0), lambda a, b: a + b)

    def shape(name: str | Column, lines: Column) -> Column:
        return F.struct((F.lit(name) if isinstance(name, str) else name).alias("shape"), lines.cast("int").alias("lines"))

    return (
        F.when(tool == "write_to_file", shape(F.when(exists, "rewrite").otherwise("new-file"), line_count(field("CodeContent"))))
        .when(tool == "replace_file_content", shape("edit", F.greatest(line_count(field("TargetContent")), line_count(field("ReplacementContent")))))
        .when((tool == "multi_replace_file_content") & chunk.isNotNull(), shape("edit", total))
        .otherwise(shape("unknown", F.lit(0)))
    )


def step_label(argv: Column) -> Column:
    """A command as one would type it; empty for none."""
    head = F.element_at(F.split(F.get(argv, 0), "/"), -1)
    python = F.lower(head).startswith("python")
    return F.when(F.size(argv) > 0, F.array_join(F.concat(F.array(F.when(python, "python").otherwise(head)), F.slice(argv, 2, F.when(python, 3).otherwise(2))), " ")).otherwise("")


def digest_or_missing(content: Column) -> Column:
    return F.coalesce(F.sha1(content), F.lit("missing"))


def symbol_line(file: Column, line: Column, kind: Column, qualname: Column, signature: Column) -> Column:
    return F.concat(file, F.lit(":"), line.cast("string"), F.lit(" "), kind, F.lit(" "), qualname, F.when(F.coalesce(signature, F.lit("")) != "", F.concat(F.lit(" "), signature)).otherwise(""))


def edge_line(src: Column, kind: Column, dst: Column, confidence: Column, line: Column) -> Column:
    """An edge of the graph as one would read it."""
    return F.concat(node_label(src), F.lit(" "), kind, F.lit(" "), node_label(dst), F.lit(" ("), confidence, F.when(line.isNotNull(), F.concat(F.lit(", line "), line.cast("string"))).otherwise(""), F.lit(")"))


# ---------------------------------------------------------------- markers, fences, claims

#: The words of a marker, what opens a comment, and what leads a line of prose.
MARKER_WORDS = ("TODO", "FIXME", "XXX", "HACK")
COMMENT_OPENERS = ("#", "//", "/*", "<!--", "--", ";")
BULLETS = ("-", "*", "+", ">")


def _any_of(words: tuple[str, ...] | list[str]) -> str:
    """A pattern for one of several texts as they stand, longer ones first."""
    return "(?:" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + ")"


_MARK = _any_of(MARKER_WORDS)
#: A marker right behind the opener of a comment, or behind the star that leads a line of one.
CODE_MARKER = rf"(?:{_any_of(COMMENT_OPENERS)}|^\s*\*)\s*{_MARK}(?![\w/-])"
HTML_MARKER = rf"<!--\s*{_MARK}(?!\w)"
QUOTED = "|".join(rf"{q}[^{q}\\]*+(?:\\.[^{q}\\]*+)*+{q}" for q in ('"', "'", "`"))


def prose_marker(line: Column) -> Column:
    """Whether a line of prose, without the signs that lead it, begins with a marker and a colon or bracket."""
    led = F.regexp_replace(line, rf"^\s*+(?:(?:{_any_of(BULLETS)}|#+|\d+[.)])\s++)*+", "")
    bare = F.regexp_replace(led, r"^\[[ xX]\]\s++", "")
    return F.coalesce(bare.rlike(rf"^(?:\*\*)?{_MARK}(?:\*\*)?\s*[:(]") | line.rlike(HTML_MARKER), F.lit(False))


def fenced(lines: Column) -> Column:
    """Which lines are a fence of ``` or ~~~ or lie between one and the next of its kind."""

    def step(state: Column, line: Column) -> Column:
        token = F.when(F.ltrim(line).startswith("```"), "```").when(F.ltrim(line).startswith("~~~"), "~~~")
        opens, closes = token.isNotNull() & (state["fence"] == ""), token == state["fence"]
        fence = F.when(opens, token).when(F.coalesce(closes, F.lit(False)), "").otherwise(state["fence"])
        return F.struct(fence.alias("fence"), F.concat(state["out"], F.array(token.isNotNull() | (state["fence"] != ""))).alias("out"))

    start = F.struct(F.lit("").alias("fence"), F.array().cast("array<boolean>").alias("out"))
    return F.aggregate(lines, start, step, lambda s: s["out"])


def marker_lines(path: Column, text: Column) -> Column:
    """(line, text) of markers such as TODO in comments of code, or as list items and headings of prose."""
    suffix = suffix_of(path)
    skipped = suffix.isin(".json", ".csv", ".tsv", ".lock", ".svg") | path.rlike(r"(?:^|/)(?:fixtures|__fixtures__|testdata|test_data)/")
    prose = suffix.isin(".md", ".markdown", ".rst", ".txt", ".adoc")

    def found(lines: Column) -> Column:
        def row(line: Column, i: Column, hit: Column) -> Column:
            return F.when(hit, F.struct((i + 1).alias("line"), F.trim(line).alias("text")))

        code = F.transform(lines, lambda x, i: row(x, i, F.regexp_replace(x, QUOTED, '""').rlike(CODE_MARKER)))
        text_ = let(fenced(lines), lambda f: F.transform(lines, lambda x, i: row(x, i, prose_marker(x) & ~F.get(f, i))))
        return F.filter(F.when(skipped, F.slice(code, 1, 0)).when(prose, text_).otherwise(code), lambda x: x.isNotNull())

    return let(lines_of(text), found)


#: What parts a command from its status, the states, and how prose claims success.
CLAIM_SEPARATORS = ("-", "—", "–", ":")
CLAIM_STATES = ("NOT VERIFIED", "VERIFIED", "NOT RUN", "PASSED", "PASS", "FAILED", "FAIL")
SUCCESS_CLAIMS = [f"all {a}tests {b}pass{c}" for a in ("", "the ") for b in ("", "now ") for c in ("", "ed")] + [f"tests {a}pass{c}" for a in ("", "all ") for c in ("", "ed")] + ["fully tested", "everything passes"]
#: A separator between blanks with a state behind it; what stands before the first one is the command.
CLAIMED = rf"(?i)\s+{_any_of(CLAIM_SEPARATORS)}\s+({_any_of(CLAIM_STATES)})\b"
PROSE_PASS = rf"(?i)\b{_any_of(SUCCESS_CLAIMS)}\b".replace("\\ ", " ")


def model_claims(text: Column) -> Column:
    """(present, steps, verdict, prose_pass): what the block after a heading ``Verification`` claims of each command."""
    status = lambda s: F.regexp_replace(F.upper(s), "^(PASS|FAIL)ED$", "$1")

    def of(lines: Column) -> Column:
        def step(state: Column, line: Column) -> Column:
            heading = F.lower(F.regexp_replace(F.regexp_replace(F.trim(line), ":+$", ""), r"^[*# ]+|[*# ]+$", "")) == "verification"
            blank = F.trim(line) == ""
            command = F.regexp_replace(F.trim(F.get(F.split(line, CLAIMED, 2), 0)), r"^[-*]\s*", "")
            hit = (state["at"] == 1) & line.rlike(CLAIMED) & (command != "")
            at = F.when((state["at"] == 0) & heading, 1).when((state["at"] == 1) & blank & (F.size(state["rows"]) > 0), 2).otherwise(state["at"])
            row = F.struct(F.regexp_replace(command, "^`+|`+$", "").alias("cmd"), status(F.regexp_extract(line, CLAIMED, 1)).alias("status"))
            return F.struct(at.alias("at"), F.when(hit, F.concat(state["rows"], F.array(row))).otherwise(state["rows"]).alias("rows"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<cmd:string,status:string>>").alias("rows"))
        return F.aggregate(lines, start, step, lambda s: s["rows"])

    def shaped(rows: Column) -> Column:
        ours = F.filter(rows, lambda r: F.lower(r["cmd"]).rlike(r"^\S+ verify"))
        steps = F.filter(rows, lambda r: ~F.lower(r["cmd"]).rlike(r"^\S+ verify"))
        last = F.filter(steps, lambda r: F.element_at(F.filter(steps, lambda q: q["cmd"] == r["cmd"]), -1)["status"] == r["status"])
        return F.struct(
            (F.size(rows) > 0).alias("present"),
            F.map_from_entries(F.transform(F.array_distinct(F.transform(last, lambda r: r["cmd"])), lambda c: F.struct(c, F.element_at(F.filter(steps, lambda q: q["cmd"] == c), -1)["status"]))).alias("steps"),
            F.coalesce(F.try_element_at(ours, F.lit(-1))["status"], F.lit("")).alias("verdict"),
            text.rlike(PROSE_PASS).alias("prose_pass"),
        )

    return let(let(lines_of(text), of), shaped)


#: How tokens of some issuers begin, the letters that follow and the least number of them; names of files
#: that hold secrets, whole, at their end and at their beginning.
SECRET_HEADS = (("AIza", r"[\w-]", 30), ("sk-", "[A-Za-z0-9]", 20), ("ghp_", "[A-Za-z0-9]", 30))
SECRET_FILES = ("credentials.json", "oauth_creds.json", "token.json", "tokens.json", ".env")
SECRET_ENDS = (".pem", ".key", ".p12", ".pfx", ".token")
SECRET_STARTS = (".env.", "id_rsa", "id_ed25519")


def holds_secret(text: Column) -> Column:
    """Whether a text holds a private key or the token of an issuer."""
    found = text.rlike("-----BEGIN [A-Z ]*PRIVATE KEY-----")
    for head, letter, least in SECRET_HEADS:
        found = found | text.rlike(rf"\b{head}{letter}{{{least},}}")
    return found


def secret_name(path: Column) -> Column:
    name = F.lower(name_of(path))
    found = name.isin(*SECRET_FILES)
    for end in SECRET_ENDS:
        found = found | name.endswith(end)
    for start in SECRET_STARTS:
        found = found | name.startswith(start)
    return found


def frontmatter(text: Column) -> Column:
    """The top-level ``key: value`` pairs between the first two ``---`` lines; an empty map without them."""
    block = F.regexp_extract(text, r"(?s)^---\s*\n(.*?)\n---", 1)
    rows = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:"))
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(rows, lambda x: F.substring_index(x, ":", 1))), lambda k: F.struct(k, F.trim(F.regexp_replace(F.element_at(F.filter(rows, lambda x: F.substring_index(x, ":", 1) == k), -1), "^[^:]*:", "")))))

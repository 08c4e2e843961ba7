"""Findings as rows: builders, sinks, checks of notes, and the verdict of a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators import relational as R
from codeloom.runtime import dense_rank

COLUMNS = "section_seq int, seq long, kind string, summary string, severity string, confidence string, evidence array<string>"
#: What a note may be.
CATEGORIES = "decision fact discovery trap convention unresolved verification".split()
STATUSES = "confirmed evidenced inferred temporary unresolved superseded deprecated".split()


def findings(rows: DataFrame, section: int, kind: Column | str, summary: Column, severity: str, confidence: Column | str, evidence: Column, order: Column) -> DataFrame:
    """Rows as findings of one section, numbered by the order; severities and confidences outside the lists raise."""
    if severity not in X.SEVERITIES:
        raise ValueError(f"severity {severity!r} is not one of {X.SEVERITIES}")
    given = F.lit(confidence) if isinstance(confidence, str) else confidence
    sure = F.when(given.isin(*X.CONFIDENCES), given).otherwise(F.raise_error(F.concat(F.lit("confidence "), given)))
    made = rows.select((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), summary.alias("summary"), F.lit(severity).alias("severity"), sure.alias("confidence"), evidence.alias("evidence"), order.alias("_order"))
    ranked = dense_rank(made, ["_order", "kind", "summary"], "seq")
    return ranked.select(F.lit(section).alias("section_seq"), "seq", "kind", "summary", "severity", "confidence", "evidence")


def report(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select("section_seq", "seq", F.to_json(F.struct(*rows.columns)).alias("value"))


def as_markdown(rows: DataFrame) -> DataFrame:
    proof = F.array_join(F.transform("evidence", lambda e: F.concat(F.lit("\n  - "), e)), "")
    return rows.select("section_seq", "seq", F.concat(F.lit("- ["), "severity", F.lit(", "), "confidence", F.lit("] "), "kind", F.lit(": "), "summary", proof).alias("value"))


def unavailable(status: DataFrame, supported: list[str], cap: int = 10) -> DataFrame:
    """(what): languages without an extractor, and the first files that did not parse; absence is never silent."""
    langs = status.filter(~F.col("language").isin(supported)).groupBy("language").agg(F.count("*").alias("n")).select(F.concat("language", F.lit(": "), F.col("n").cast("string"), F.lit(" file(s) without an extractor")).alias("what"))
    broken = status.filter(F.coalesce("error", F.lit("")) != "").orderBy("file").limit(cap).select(F.concat("file", F.lit(": parse error")).alias("what"))
    return langs.unionByName(broken)


def references(uses: DataFrame, imports: DataFrame, lines: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """(section, file, line): confirmed uses, imports that mention the name, and text hits on no line of either and no definition.

    Rows are distinct. A use on the line of a definition is none.
    """
    short = name.rpartition(".")[2]
    defined = R.symbols_named(symbols, name).select("file", "line").distinct()
    sure = uses.filter(F.element_at(F.split("name", r"\."), -1) == short).select(F.lit("use").alias("section"), "file", "line").join(defined, ["file", "line"], "left_anti")
    told = imports.filter(F.exists("bindings", lambda b: (b["name"] == short) | (b["alias"] == short))).select(F.lit("import").alias("section"), "file", "line")
    sure = sure.select("section", "file", "line").unionByName(told).distinct()
    known = sure.select("file", "line").union(defined).distinct()
    text = lines.select(F.col("path").alias("file"), "line").distinct().join(known, ["file", "line"], "left_anti")
    return sure.unionByName(text.select(F.lit("text").alias("section"), "file", "line"))


def dependencies(imports: DataFrame) -> DataFrame:
    """(path, target, names, imports): what each file takes from where; target is null for what no file of the workspace is.

    imports: file, resolved, name.
    """
    return imports.groupBy(F.col("file").alias("path"), F.col("resolved").alias("target")).agg(F.array_sort(F.collect_set("name")).alias("names"), F.count("*").alias("imports"))


def symbols_in(symbols: DataFrame) -> DataFrame:
    """(file, sym_seq, kind, summary): the symbols of files, each in a line with its number."""
    signed = F.when(F.coalesce("signature", F.lit("")) != "", F.concat(F.lit(" "), "signature")).otherwise("")
    return symbols.select("file", "sym_seq", "kind", F.concat(F.coalesce(F.col("line").cast("string"), F.lit("")), F.lit(": "), "qualname", signed).alias("summary"))


def _tests_of(homes: DataFrame, project: DataFrame) -> DataFrame:
    return homes.filter("kind = 'test'").join(F.broadcast(project.select("project")), "project", "left_semi").select("path")


def tests_for_symbol(homes: DataFrame, symbols: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """(path, mentions): test files that mention a symbol, of the project of its first definition.

    homes: path, kind, project; texts: path, text. Where nothing bears the name the project is the root's.
    """
    owner = R.symbols_named(symbols, name).join(homes.select(F.col("path").alias("file")), "file", "left_semi").agg(F.min("file").alias("path"))
    project = owner.join(homes.select("path", "project"), "path", "left").select(F.coalesce("project", F.lit(".")).alias("project"))
    lines = R.identifier_lines(texts, name.rpartition(".")[2], paths=_tests_of(homes, project)).dropDuplicates(["path", "line"])
    return lines.groupBy("path").agg(F.count("*").alias("mentions"))


def importers_in_project(homes: DataFrame, imports: DataFrame, target: str, kind: str | None = None) -> DataFrame:
    """(path, mentions): files of a target's own project that import it; of one kind, if given."""
    project = homes.filter(F.col("path") == target).select("project")
    near = homes.join(F.broadcast(project), "project", "left_semi")
    near = near if kind is None else near.filter(F.col("kind") == kind)
    return imports.filter(F.col("resolved") == target).join(near.select(F.col("path").alias("file")), "file", "left_semi").groupBy(F.col("file").alias("path")).agg(F.count("*").alias("mentions"))


def tests_for_file(homes: DataFrame, imports: DataFrame, symbols: DataFrame, texts: DataFrame, target: str) -> DataFrame:
    """(path, mentions): test files of a file's project that import it or name one of its symbols."""
    project = homes.filter(F.col("path") == target).select("project")
    tests = _tests_of(homes, project)
    names = symbols.filter(F.col("file") == target).select("name")
    said = R.lines_naming(texts.join(tests, "path", "left_semi"), names).distinct().select("path")
    taken = importers_in_project(homes, imports, target, "test")
    return said.groupBy("path").agg(F.count("*").alias("mentions")).unionByName(taken).groupBy("path").agg(F.sum("mentions").alias("mentions"))


def note_rules() -> list[tuple[Column, str]]:
    """The checks of a note: id, category, statement, status, created, updated, expires, superseded_by, evidence."""
    gone = lambda c: F.coalesce(c, F.lit("")) == ""
    date = lambda c: ~gone(F.col(c)) & ~F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$")
    rules = [(gone(F.col(c)), f"missing {c}") for c in ("id", "category", "statement", "status", "created", "updated")]
    rules += [
        (~gone(F.col("id")) & ~F.col("id").rlike(r"^M-\d{4,}$"), "id must look like M-0001"),
        (~F.coalesce(F.col("category").isin(CATEGORIES), F.lit(False)), "unknown category"),
        (~F.coalesce(F.col("status").isin(STATUSES), F.lit(False)), "unknown status"),
        (F.length("statement") > 300, "statement longer than 300 characters"),
        (F.col("statement").contains("\n"), "statement must be a single line"),
        (F.exists("evidence", lambda e: gone(e)), "evidence must be non-empty strings"),
        (F.col("status").isin("confirmed", "evidenced") & (F.coalesce(F.size("evidence"), F.lit(0)) <= 0), "status needs evidence"),
    ]
    rules += [(date(c), f"{c} must be YYYY-MM-DD") for c in ("created", "updated", "expires")]
    return [*rules, ((F.col("status") == "temporary") & gone(F.col("expires")), "temporary items need an expires date"), ((F.col("status") == "superseded") & gone(F.col("superseded_by")), "superseded items need superseded_by")]


def note_problems(notes: DataFrame, today: str) -> DataFrame:
    """(id, problem): invalid, dangling, expired, conflicting, open and weak notes."""
    current = notes.filter(R.is_current(F.col("status"), F.col("expires"), today))
    twice = R.conflicts(current.filter(F.coalesce("key", F.lit("")) != ""), ["key"], "id").select("key")
    parts = [
        notes.select("id", F.explode(R.rule_errors(note_rules())).alias("problem")),
        *[R.dangling(notes, c, notes, "id").select("id", F.lit(f"dangling {c}").alias("problem")) for c in ("supersedes", "superseded_by")],
        notes.filter((F.col("status") == "temporary") & (F.coalesce("expires", F.lit("")) != "") & (F.col("expires") < today)).select("id", F.lit("expired").alias("problem")),
        current.join(twice, "key", "left_semi").select("id", F.lit("conflict").alias("problem")),
        current.filter("status = 'unresolved' or category = 'unresolved'").select("id", F.lit("open").alias("problem")),
        notes.filter((F.col("status") == "inferred") & F.col("category").isin("fact", "convention")).select("id", F.lit("weak fact").alias("problem")),
    ]
    return reduce(DataFrame.unionByName, parts)


def note_scores(notes: DataFrame, today: str, text: str = "", path: str = "", symbol: str = "", category: str = "", tag: str = "", limit: int = 10) -> DataFrame:
    """Current notes by fit: symbol 10, path 6 or 4, each common term 1, tag 4, category 2; then newest, then id."""
    rel, zero = path.replace("\\", "/").strip("/"), F.lit(0)
    rows = notes.filter(R.is_current(F.col("status"), F.col("expires"), today))
    rows = rows.filter(F.col("category") == category) if category else rows
    rows = rows.filter(F.array_contains("tags", tag.lower())) if tag else rows
    by_symbol = F.when(F.exists("symbols", lambda s: (s == symbol) | s.endswith("." + symbol) | s.endswith("::" + symbol)), 10).otherwise(0) if symbol else zero
    near = lambda p: (p == rel) | F.lit(rel).startswith(F.concat(p, F.lit("/"))) | p.startswith(rel + "/")
    first = F.get(F.filter(F.transform("paths", lambda p: F.regexp_replace(p, "^/+|/+$", "")), near), 0)
    by_path = F.when(first == rel, 6).when(first.isNotNull(), 4).otherwise(0) if rel else zero
    have = F.array_union(F.array_union(X.terms(F.col("statement")), F.col("tags")), X.terms(F.array_join("symbols", " ")))
    by_terms = F.size(F.array_intersect(have, X.terms(F.lit(text)))) if text else zero
    asked = by_symbol + by_path + by_terms
    rows = rows.withColumn("score", asked + (4 if tag else 0) + (2 if category else 0))
    rows = rows.filter("score > 0") if symbol or rel or text else rows
    return rows.orderBy(F.desc("score"), F.desc("updated"), "id").limit(limit)


def reconciled(claims: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """(key, status): what ran decides; a claim is only told apart where nothing fresh ran. claims: present, steps, verdict, prose_pass; records: ran, fresh, verdict."""
    met = claims.join(records.select(key, "ran", "fresh", F.col("verdict").alias("determined")), key, "left")
    passes = (F.size("steps") > 0) & F.forall(F.map_values("steps"), lambda s: s == "PASS")
    success = (F.col("verdict") == "VERIFIED") | passes | (~F.col("present") & F.col("prose_pass"))
    fresh = F.coalesce(F.col("ran") & F.col("fresh"), F.lit(False))
    status = F.when(fresh & (F.col("determined") == "verified"), "VERIFIED").when(fresh, "NOT VERIFIED").when(success, "UNVERIFIED CLAIM").otherwise("NO VERIFICATION")
    return met.select(key, status.alias("status"))


def contradictions(claims: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """(key, command, claimed, determined): claimed steps that a recorded step of another status meets.

    claims: steps, a map from command to status; records: ran, fresh, step_results, a map from a step's name to its status.
    A step is met by the first record whose name is part of the command or the other way round; a name counts from its last
    colon on. Only what ran on the tree as it is decides.
    """
    fresh = records.filter(F.coalesce(F.col("ran") & F.col("fresh"), F.lit(False)))
    known = F.transform(F.map_entries("step_results"), lambda e: F.struct(F.trim(F.element_at(F.split(e["key"], ":"), -1)).alias("name"), F.upper(e["value"]).alias("status")))
    met = claims.join(fresh.select(key, known.alias("known")), key).select(key, F.explode("steps").alias("command", "claimed"), "known")
    hit = F.get(F.filter("known", lambda k: (k["name"] != "") & (F.contains(F.col("command"), k["name"]) | F.contains(k["name"], F.col("command")))), 0)
    return met.select(key, "command", "claimed", hit["status"].alias("determined")).filter("determined is not null and determined <> claimed")


def without_root(text: Column, root: str) -> Column:
    """A text with ``<root>`` for the place of a workspace, so that it can be kept and compared elsewhere."""
    return F.replace(F.replace(text, F.lit(root.replace("/", "\\")), F.lit("<root>")), F.lit(root), F.lit("<root>"))


def scoped(rows: DataFrame, text: str, prefix: str) -> DataFrame:
    """Rows whose text names no file, or one below a prefix; what names only files elsewhere is left out."""
    paths = X.mentioned_paths(F.coalesce(text, F.lit("")))
    return rows.filter((F.size(paths) == 0) | F.exists(paths, lambda p: (p == prefix) | p.startswith(f"{prefix}/")))


def record_rules(dimensions: tuple[str, ...], values: tuple[str, ...], tests: tuple[str, ...]) -> list[tuple[Column, str]]:
    """The checks of an evidence record: test, model, date, prompt, scores (a map), observed (a map), final_verdict."""
    rules = [(F.col(c).isNull(), f"missing {c}") for c in ("test", "model", "date", "prompt", "observed", "scores", "final_verdict")]
    exact = F.coalesce(F.array_sort(F.map_keys("scores")) == F.array_sort(F.array(*map(F.lit, dimensions))), F.lit(False))
    bad = F.exists(F.map_values("scores"), lambda v: ~F.coalesce(v.isin(*values), F.lit(False)))
    rules += [
        (~F.coalesce(F.col("test").isin(*tests), F.lit(False)), "unknown test"),
        (~exact, "scores must contain exactly the dimensions"),
        (exact & bad, "invalid score values"),
        (~F.col("final_verdict").isin("", "PASS", "PARTIAL", "FAIL"), "final_verdict must be PASS, PARTIAL, FAIL or empty"),
    ]
    known = F.coalesce(F.map_keys("observed"), F.array().cast("array<string>"))
    rules += [(~F.array_contains(known, k), f"observed.{k} missing") for k in ("files_touched", "lines_added", "lines_removed")]
    return [*rules, (X.holds_secret(F.concat_ws(" ", "prompt", F.to_json("observed"))), "a record must not contain secrets")]


def finding_counts(rows: DataFrame, kind: str = "kind") -> DataFrame:
    """(kind, findings): how many findings there are of each kind."""
    return rows.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("findings"))


def run_verdict(scores: DataFrame, run: str, required: str, score: str, order: tuple[str, ...]) -> DataFrame:
    """(run, verdict): the worst of a run's required scores; the best of the order where none is required."""
    return scores.groupBy(run).agg(X.worst(F.when(F.col(required), F.col(score)), order).alias("verdict"))


def matching_skills(skills: DataFrame, intent: str, limit: int) -> DataFrame:
    """(name, description, overlap): the skills whose description shares most words with an intent; of one name the first.

    skills: seq, name, description. Without an intent the first names, whatever they share.
    """
    one = skills.groupBy("name").agg(F.min_by("description", "seq").alias("description"))
    asked = F.size(F.array_intersect(X.terms(F.coalesce("description", F.lit(""))), X.terms(F.lit(intent)))) if intent else F.lit(0)
    rows = one.withColumn("overlap", asked)
    return (rows.filter("overlap > 0") if intent else rows).orderBy(F.desc("overlap"), "name").limit(limit)


#: Kinds of findings whose evidence shows no file.
NOT_EVIDENCE = ("next", "memory", "handoff", "skills", "rules", "decision")


def surfaced_files(rows: DataFrame, files: DataFrame, text: str, kind: str | None = None) -> DataFrame:
    """(path): files that exist and that the text of findings names; findings of kinds that show none are left out."""
    shown = rows if kind is None else rows.filter(~F.col(kind).isin(*NOT_EVIDENCE))
    return shown.select(F.explode(X.mentioned_paths(F.col(text))).alias("path")).distinct().join(files.select("path"), "path", "left_semi")


#: How many findings of each section a brief keeps, and of each part a context.
BRIEF_CAPS = {"direct-caller": 8, "indirect-caller": 4, "dependent-file": 8, "related-type": 4, "test": 5, "config": 3}
CONTEXT_CAPS = {"handoff": 1, "memory": 6, "brief": 18, "skills": 3, "rules": 3}


def brief(sections: DataFrame, consequences: DataFrame, decision: DataFrame | None = None, changes: DataFrame | None = None) -> DataFrame:
    """(section, rank, item, confidence): what to know before an edit: the sections of an impact within their caps, what they
    come to, whether something can be reused, and how many changes are open already."""
    near = R.capped(sections.filter(F.col("section").isin(*BRIEF_CAPS)), ["section"], [F.col("depth"), F.col("node")], BRIEF_CAPS)
    parts = [
        near.select("section", "rank", F.col("node").alias("item"), "confidence"),
        consequences.select(F.lit("consequence").alias("section"), F.lit(1).alias("rank"), F.concat_ws(" ", "finding", F.col("amount").cast("string")).alias("item"), "confidence"),
    ]
    if decision is not None:
        parts.append(decision.select(F.lit("decision").alias("section"), F.lit(1).alias("rank"), F.col("decision").alias("item"), F.lit("inferred").alias("confidence")))
    if changes is not None:
        open_ = changes.agg(F.count("*").alias("n")).filter("n > 0")
        parts.append(open_.select(F.lit("workspace-state").alias("section"), F.lit(1).alias("rank"), F.concat(F.col("n").cast("string"), F.lit(" uncommitted change(s)")).alias("item"), F.lit("confirmed").alias("confidence")))
    return reduce(DataFrame.unionByName, parts)


def context(parts: dict[str, DataFrame]) -> DataFrame:
    """(part, rank, item): handoff, memory, brief, skills and rules in one table, each within its cap.

    Each part: rank, item. A brief's notes on open changes are left out.
    """
    rows = [d.select(F.lit(name).alias("part"), F.col("rank").alias("_order"), "item") for name, d in parts.items()]
    return R.capped(reduce(DataFrame.unionByName, rows), ["part"], [F.col("_order"), F.col("item")], CONTEXT_CAPS).select("part", "rank", "item")


def verdict(reasons: DataFrame, step_results: DataFrame, markers: DataFrame, uncovered: DataFrame) -> DataFrame:
    """(verdict, outstanding, advisories): verified if a step ran, none failed and nothing is outstanding; advisories never decide.

    step_results: step, status; outstanding are failed steps and added markers, advisories the signals of the change and
    changed code without a test.
    """
    n = lambda d, name: d.agg(F.count("*").alias(name))
    bad = step_results.filter(F.col("status").isin("fail", "timeout"))
    ran = step_results.filter(F.col("status").isin("pass", "fail", "timeout"))
    one = n(bad, "failed").join(n(ran, "ran"), F.lit(True)).join(n(markers, "markers"), F.lit(True)).join(n(reasons, "signals"), F.lit(True)).join(n(uncovered, "uncovered"), F.lit(True))
    ok = (F.col("ran") > 0) & (F.col("failed") == 0) & (F.col("markers") == 0)
    return one.select(F.when(ok, "verified").otherwise("not verified").alias("verdict"), (F.col("failed") + F.col("markers")).alias("outstanding"), (F.col("signals") + F.col("uncovered")).alias("advisories"))


#: The scripts of a package that are checks, and the command that stands where there is no test.
NPM_SCRIPTS, NPM_NO_TEST = ("test", "lint", "typecheck", "build"), "no test specified"


def steps(files: DataFrame, project: str = "project") -> DataFrame:
    """(project, step): the verification steps that the files of each project call for.

    files: project, path, and where they are known kind, language and text: what a manifest configures is read from its text,
    and counts only in the project's own folder. Without texts a manifest calls for the tests that it usually configures.
    """
    have = set(files.columns)
    unread = F.lit("text" not in have)
    of = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    own = F.when(F.col(project) == ".", F.col("path")).otherwise(F.expr(f"substring(path, length({project}) + 2)"))
    rows = files.select(F.col(project).alias("project"), own.alias("name"), of("kind").alias("kind"), of("language").alias("language"), F.coalesce(of("text"), F.lit("")).alias("text"))
    toml, package = F.col("name") == "pyproject.toml", F.col("name") == "package.json"
    script = lambda s: F.get_json_object("text", f"$.scripts.{s}")
    runs = lambda s: package & F.coalesce((script(s) != "") & ~script(s).contains(NPM_NO_TEST), F.lit(False))
    rules = {
        "pytest": (F.col("kind") == "test") & (F.col("language") == "python") | toml & (unread | F.col("text").contains("pytest")) | F.col("name").isin("pytest.ini", "tox.ini"),
        "ruff": (F.col("name") == "ruff.toml") | toml & F.col("text").contains("[tool.ruff"),
        "mypy": (F.col("name") == "mypy.ini") | toml & F.col("text").contains("[tool.mypy"),
        **{f"npm {s}": runs(s) | package & unread & F.lit(s == "test") for s in NPM_SCRIPTS},
        "tsc": F.col("name") == "tsconfig.json",
        "cargo test": F.col("name") == "Cargo.toml",
        "go test": F.col("name") == "go.mod",
    }
    called = rows.select("project", "name", F.explode(F.array(*[F.when(rule, F.lit(step)) for step, rule in rules.items()])).alias("step"), (package & script("typecheck").isNotNull()).alias("_types"), package.alias("_package"))
    found = called.filter("step is not null").select("project", "step").distinct()
    # The compiler alone is a step of a package that has no script for types.
    packages = called.groupBy("project").agg(F.max("_package").alias("_package"), F.max(F.coalesce("_types", F.lit(False))).alias("_types"))
    return found.join(packages, "project").filter((F.col("step") != "tsc") | F.col("_package") & ~F.col("_types")).select("project", "step")


def run_steps(root: str, commands: dict[str, list[str]], timeout: int = 600) -> list[tuple[str, str, int | None]]:
    """(step, status, exit code): commands run on the driver one after the other; never on executors."""
    import shutil
    import subprocess

    results: list[tuple[str, str, int | None]] = []
    for step, argv in commands.items():
        if shutil.which(argv[0]) is None:
            results.append((step, "unavailable", None))
            continue
        try:
            code = subprocess.run(argv, cwd=root, capture_output=True, timeout=timeout).returncode
            results.append((step, "pass" if code == 0 else "fail", code))
        except subprocess.TimeoutExpired:
            results.append((step, "timeout", None))
        except OSError:
            results.append((step, "unavailable", None))
    return results

"""The change surface between two snapshots: totals, signals and their level.

changes: path, status (A, M, D, R), added, removed, whitespace_only, kind, language, old_path, new_symbols.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators.components import components
from codeloom.operators.relational import in_scope

GROWTH_LINES, GROWTH_RATIO, CHURN_SHARE, CHURN_LINES, WIDE, THIN_LINES = 150, 3.0, 0.2, 5, 4, 40


def whitespace_only(added: Column, added_without_blanks: Column) -> Column:
    return F.greatest(F.lit(0), added - F.coalesce(added_without_blanks, F.lit(0)))


def numstat(rows: Column) -> Column:
    """(added, removed, path) of a numstat line; binary files count 0; of a rename the new path."""
    parts = F.split(rows, "\t")
    renamed = F.regexp_replace(F.regexp_replace(F.get(parts, 2), r"\{[^{}]* => ([^{}]*)\}", "$1"), r"^.* => ", "")
    number = lambda i: F.coalesce(F.try_to_number(F.get(parts, i), F.lit("999999999")).cast("int"), F.lit(0))
    return F.struct(number(0).alias("added"), number(1).alias("removed"), F.regexp_replace(renamed, "//", "/").alias("path"))


def added_lines(diff: DataFrame, seq: str = "seq", row: str = "row", doc: str = "diff_id") -> DataFrame:
    """(diff_id, path, line): the added line numbers that the hunk headers of unified diffs name."""
    from pyspark.sql import Window

    so_far = Window.partitionBy(doc).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col(row).startswith("+++ "), F.regexp_replace(F.substring(row, 5, 10_000), r"^b/|\t.*$", ""))
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    rows = diff.withColumn("path", F.last(head, ignorenulls=True).over(so_far)).filter(F.col(row).rlike(hunk))
    start, size = F.regexp_extract(row, hunk, 1).cast("int"), F.coalesce(F.expr(f"try_cast(nullif(regexp_extract({row}, r'{hunk}', 2), '') as int)"), F.lit(1))
    return rows.select(doc, "path", start.alias("s"), size.alias("n")).filter("n > 0 and path is not null and path <> '/dev/null'").select(doc, "path", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("n") - 1)).alias("line"))


def totals(changes: DataFrame) -> DataFrame:
    """One row: files, new, deleted and renamed files, lines added and removed, net growth, folders, whitespace."""
    is_ = lambda s: F.count(F.when(F.col("status") == s, 1))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return changes.agg(F.count("*").alias("files"), is_("A").alias("new_files"), is_("D").alias("deleted_files"), is_("R").alias("renamed_files"), total("added").alias("added"), total("removed").alias("removed"), (total("added") - total("removed")).alias("net"), F.count_distinct(X.top_dir(F.col("path"))).alias("folders"), total("whitespace_only").alias("whitespace"))


def growth_shape(added: Column, removed: Column, new_files: Column) -> Column:
    """additive-heavy, only-additions or null."""
    grown = added - removed >= GROWTH_LINES
    return F.when(grown & (removed > 0) & (added >= GROWTH_RATIO * removed), "additive-heavy").when(grown & (removed == 0) & (new_files == 0), "only-additions")


def is_churn(added: Column, removed: Column, whitespace: Column) -> Column:
    return (added + removed > 0) & (whitespace >= CHURN_SHARE * F.greatest(added, F.lit(1))) & (whitespace >= CHURN_LINES)


def is_code(kind: Column) -> Column:
    return kind.isin("source", "script")


def name_collisions(new_symbols: DataFrame, symbols: DataFrame) -> DataFrame:
    """New exported top-level symbols of code files with the number of equal names of their kind elsewhere in the project.

    Both: file, project, kind, name, qualname, parent, exported, file_kind.
    """
    top = lambda d: d.filter(is_code(F.col("file_kind")) & (F.coalesce("parent", F.lit("")) == ""))
    new = top(new_symbols).filter("exported").select("file", "project", "kind", "name", "qualname").distinct()
    old = top(symbols).select(F.col("file").alias("other"), "project", "kind", "name").distinct()
    return new.join(old, ["project", "kind", "name"]).filter("file <> other").groupBy("file", "project", "kind", "name", "qualname").agg(F.count("*").alias("clashes"))


def unrelated(changes: DataFrame, imports: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Changed paths without a link to the scope, or to the largest group of changed files that import one another."""
    paths = changes.select("path").distinct()
    links = imports.select("file", "resolved").dropna().distinct()
    if scope:
        inside = changes.filter(in_scope(F.col("path"), F.col("new_symbols"), scope)).select("path").distinct()
        near = links.join(inside.withColumnRenamed("path", "resolved"), "resolved", "left_semi").select(F.col("file").alias("path")).union(links.join(inside.withColumnRenamed("path", "file"), "file", "left_semi").select("resolved"))
        return paths.join(inside, "path", "left_anti").join(near.distinct(), "path", "left_anti")
    code = changes.filter(F.col("kind").isin("source", "test", "script") & (F.col("status") != "D")).select("path").distinct()
    met = links.join(code.withColumnRenamed("path", "file"), "file", "left_semi").join(code.withColumnRenamed("path", "resolved"), "resolved", "left_semi")
    group = code.join(components(met.select(F.col("file").alias("a"), F.col("resolved").alias("b"))).withColumnRenamed("node", "path"), "path", "left").withColumn("component", F.coalesce("component", "path"))
    best = group.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return group.join(best, "component", "left_anti").select("path")


def project_scope(changes: DataFrame) -> DataFrame:
    """(projects): the sub-projects of the changed code, as a sorted array; empty if none or if the root's own is among them.

    changes: kind, status, project.
    """
    code = changes.filter(is_code(F.col("kind")) & (F.col("status") != "D"))
    held = code.agg(F.array_sort(F.collect_set("project")).alias("p"))
    return held.select(F.when(F.array_contains("p", "."), F.array().cast("array<string>")).otherwise(F.col("p")).alias("projects"))


def reasons(changes: DataFrame, imports: DataFrame, collisions: DataFrame, bypasses: DataFrame | None = None, resembling: DataFrame | None = None, scope: list[str] | None = None) -> DataFrame:
    """(level, reason): every signal of the change as a row."""
    t = totals(changes)
    say = lambda d, level, reason: d.select((level if isinstance(level, Column) else F.lit(level)).alias("level"), reason.alias("reason"))
    thin = changes.filter((F.col("status") == "A") & is_code(F.col("kind")) & (F.size("new_symbols") == 1) & (F.col("added") <= THIN_LINES))
    wide = changes.filter(is_code(F.col("kind")) & F.col("path").contains("/")).agg(F.count_distinct(X.top_dir(F.col("path"))).alias("n")).filter(F.col("n") >= WIDE)
    apart = unrelated(changes, imports, scope).agg(F.count("*").alias("n")).filter("n > 0")
    parts = [
        say(thin, "elevated", F.concat("path", F.lit(" is a new file holding a single small symbol"))),
        say(collisions, "elevated", F.concat("qualname", F.lit(" duplicates an existing "), "kind", F.lit(" name"))),
        say(t.filter(growth_shape(F.col("added"), F.col("removed"), F.col("new_files")).isNotNull()), "elevated", F.concat(F.lit("growth: "), growth_shape(F.col("added"), F.col("removed"), F.col("new_files")))),
        say(t.filter(is_churn(F.col("added"), F.col("removed"), F.col("whitespace"))), "elevated", F.lit("formatting-only churn")),
        say(apart, "elevated", F.concat(F.col("n").cast("string"), F.lit(" file(s) unrelated to the main change"))),
        say(wide, "elevated", F.concat(F.lit("code changed in "), F.col("n").cast("string"), F.lit(" top-level directories"))),
    ]
    if bypasses is not None:
        parts.append(say(bypasses, "elevated", F.concat("func", F.lit(": "), "kind", F.lit(" of "), "callee")))
    if resembling is not None:
        parts.append(say(resembling, F.when(F.col("exact") >= 0.7, "high").otherwise("elevated"), F.concat(F.lit("new "), F.col("a").cast("string"), F.lit(" resembles "), F.col("b").cast("string"))))
    if scope:
        outside = changes.filter((F.col("kind") == "manifest") & ~in_scope(F.col("path"), F.col("new_symbols"), scope))
        parts.append(say(outside, "elevated", F.concat(F.lit("manifest "), "path", F.lit(" changed outside the stated scope"))))
    return reduce(DataFrame.unionByName, parts)


def level(reasons_: DataFrame) -> DataFrame:
    return reasons_.agg(X.worst(F.col("level"), X.LEVELS).alias("level"), F.count("*").alias("reasons"))


def bypasses(before: DataFrame, after: DataFrame, known: DataFrame) -> DataFrame:
    """(path, func, callee, kind): unconditional calls that are gone, or now hang on a parameter the function did not have.

    before, after: path, func, params, callee, unconditional, guards. known: names of the workspace's functions.
    """
    old = before.filter("unconditional").join(known.select(F.col(known.columns[0]).alias("callee")).distinct(), "callee", "left_semi")
    still = after.groupBy("path", "func").agg(F.first("params").alias("new_params"))
    now = after.filter("callee is not null").groupBy("path", "func", "callee").agg(F.max("unconditional").alias("now_free"), F.flatten(F.collect_set("guards")).alias("now_guards"))
    met = old.join(still, ["path", "func"]).join(now, ["path", "func", "callee"], "left")
    guards = F.array_intersect("now_guards", F.array_except("new_params", "params"))
    kind = F.when(F.col("now_free").isNull(), "shared-call-removed").when(~F.col("now_free") & (F.size(guards) > 0), "invariant-bypass")
    return met.withColumn("kind", kind).filter("kind is not null").select("path", "func", "callee", "kind", F.array_sort(F.coalesce(guards, F.array().cast("array<string>"))).alias("guards")).distinct()


def uncovered(changes: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """Changed code files that no test file imports."""
    tests = files.filter("kind = 'test'").select(F.col("path").alias("file"))
    covered = imports.join(tests, "file", "left_semi").select(F.col("resolved").alias("path")).dropna().distinct()
    return changes.filter(is_code(F.col("kind")) & (F.col("status") != "D")).select("path").distinct().join(covered, "path", "left_anti")

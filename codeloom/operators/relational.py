"""Lookups, joins, aggregates and rankings over tables of any names.

Every operator takes DataFrames and column names, gives a DataFrame, and leaves the physical plan to the
optimizer. Null keys match nothing unless a docstring says otherwise; repeated rows give repeated rows in
filters and projections and count once in sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as X

# ---------------------------------------------------------------- filters


def text_lines(files: DataFrame, path: str, text: str, *keep: str, holding: str | None = None) -> DataFrame:
    """(path, keep..., line, row): every line, counted from 1; only of texts that hold a string, if one is given."""
    rows = files if holding is None else files.filter(F.col(text).contains(holding))
    return rows.select(path, *keep, F.posexplode(X.lines_of(F.col(text))).alias("line", "row")).withColumn("line", F.col("line") + 1)


def identifier_lines(files: DataFrame, name: str, path: str = "path", text: str = "text", keep: tuple[str, ...] = (), paths: DataFrame | None = None) -> DataFrame:
    """Lines that hold an identifier whole; none for a name that is no identifier. paths: a column that limits the files."""
    import re

    if not re.fullmatch(r"[A-Za-z_$][\w$]*", name):
        return text_lines(files.limit(0), path, text, *keep)
    some = files if paths is None else files.join(paths.select(F.col(paths.columns[0]).alias(path)), path, "left_semi")
    rows = text_lines(some, path, text, *keep, holding=name)
    return rows.filter(F.col("row").contains(name) & F.col("row").rlike(rf"(?<![\w$]){re.escape(name)}(?![\w$])"))


def lines_naming(files: DataFrame, names: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, name): lines that hold one of many identifiers whole, by one pass over the texts and one join. names: a column."""
    rows = text_lines(files.filter(F.col(text).isNotNull()), path, text)
    words = rows.select(path, "line", F.explode(F.array_distinct(F.regexp_extract_all("row", F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0)))).alias("name"))
    return words.join(names.select(F.col(names.columns[0]).alias("name")).distinct(), "name", "left_semi").select(path, "line", "name")


def symbols_named(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols by name, qualified name, or dotted end of it."""
    return symbols.filter((F.col("name") == name) | (F.col("qualname") == name) | F.col("qualname").endswith("." + name))


def definition(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols of a name; where there are none, those of the name in any case. tier says which."""
    near = symbols_named(symbols, name).withColumn("tier", F.lit(1))
    far = symbols.filter(F.lower("name") == name.lower()).withColumn("tier", F.lit(2))
    return _least_tier(near.unionByName(far))


def resolve_target(files: DataFrame, symbols: DataFrame, target: str) -> DataFrame:
    """(tier, file, qualname): a file path, else symbols, else symbols in any case."""
    plain = target.replace("\\", "/").removeprefix("./")
    as_file = files.filter(F.col("path") == plain).select(F.lit(0).alias("tier"), F.col("path").alias("file"), F.lit(None).cast("string").alias("qualname"))
    return _least_tier(as_file.unionByName(definition(symbols, target).select("tier", "file", "qualname")))


def _least_tier(rows: DataFrame) -> DataFrame:
    return rows.join(rows.agg(F.min("tier").alias("tier")), "tier", "left_semi")


def in_scope(path: Column, symbols: Column, scope: list[str]) -> Column:
    """Whether a change lies in a scope: by path, folder, part of the path or part of a new symbol, in any case."""
    result = F.lit(False)
    for item in (s.replace("\\", "/").lower() for s in scope):
        low = F.lower(path)
        result = result | (low == item) | low.startswith(item.rstrip("/") + "/") | low.contains(item) | F.coalesce(F.exists(symbols, lambda s: F.lower(s).contains(item)), F.lit(False))
    return result


def is_current(status: Column, expires: Column, today: str) -> Column:
    """Whether a note stands and has not expired; dates compare as ISO strings."""
    return status.isin("confirmed", "evidenced", "inferred", "temporary", "unresolved") & ~((F.coalesce(expires, F.lit("")) != "") & (expires < today))


def distinctive(name: Column) -> Column:
    return (F.length(name) >= 4) & (name.contains("_") | name.rlike("[a-z][A-Z]") | (F.length(name) >= 10))


# ---------------------------------------------------------------- joins


def first_match(rows: DataFrame, candidates: str, known: DataFrame, known_key: str, out: str) -> DataFrame:
    """rows with the first of their candidates that is known, or null. rows need a unique column ``_id``."""
    tried = rows.select("_id", F.posexplode(candidates).alias("_at", known_key))
    hits = tried.join(known.select(known_key).distinct(), known_key, "left_semi").groupBy("_id").agg(F.min_by(known_key, "_at").alias(out))
    return rows.join(hits, "_id", "left")


def module_candidates(path: Column, module: Column, level: Column) -> Column:
    """Paths that a Python import may mean, best first: root, then folders above the file, nearest last; .py before a package."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    parts = F.filter(F.split(module, r"\."), lambda p: p != "")
    above = F.transform(F.sequence(F.lit(0), F.size(folders)), lambda n: F.slice(folders, F.lit(1), n))
    climbed = F.array(F.slice(folders, F.lit(1), F.greatest(F.size(folders) - (level - 1), F.lit(0))))
    bases = F.when(level > 0, climbed).otherwise(above)
    stems = F.transform(bases, lambda b: F.array_join(F.concat(b, parts), "/"))
    return F.array_distinct(F.flatten(F.transform(stems, lambda s: F.when(s == "", F.array(F.lit("__init__.py"))).otherwise(F.array(F.concat(s, F.lit(".py")), F.concat(s, F.lit("/__init__.py")))))))


SCRIPT_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".vue", ".svelte")


def specifier_candidates(path: Column, specifier: Column) -> Column:
    """Paths that a relative script import may mean, best first; none for others."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)

    def step(done: Column, part: Column) -> Column:
        return F.when(part.isin(".", ""), done).when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    base = F.array_join(F.aggregate(F.split(specifier, "/"), folders, step), "/")
    tails = ["", *SCRIPT_SUFFIXES, *[f"/index{s}" for s in SCRIPT_SUFFIXES]]
    return F.when(specifier.startswith("."), F.transform(F.array(*[F.lit(t) for t in tails]), lambda t: F.concat(base, t))).otherwise(F.array().cast("array<string>"))


def longest_prefix(rows: DataFrame, path: str, roots: DataFrame, root: str, out: str, default: str = ".", shortest: bool = False) -> DataFrame:
    """rows with the longest root (or the shortest) that is a folder above the path, by one equi-join over the folders above it.

    A root of one character never wins.
    """
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    up = rows.select(path).distinct().select(path, F.explode(above).alias("_r"))
    known = roots.select(F.col(root).alias("_r")).filter(F.length("_r") > 1).distinct()
    best = up.join(known, "_r", "left_semi").groupBy(path).agg((F.min_by if shortest else F.max_by)("_r", F.length("_r")).alias(out))
    return rows.join(best, path, "left").withColumn(out, F.coalesce(out, F.lit(default)))


def without(rows: DataFrame, taken: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(taken.select(*on).distinct(), on, "left_anti")


def evidence_in_window(events: DataFrame, past: DataFrame, key: str, time: str, seconds: float, level: str, keep: list[str]) -> DataFrame:
    """events, each with the strongest and then latest past row of its key within a window that ends at it, both ends included.

    Time is cut into buckets of the window's length and a past row stands in its own and the next, so an event finds all of
    its window in one bucket of its key, and a key with very many rows stays spread.
    """
    length = int(seconds * 1_000_000)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bucket = F.floor(F.col("_t") / length)
    best = F.struct(F.col(level).alias("l"), F.col(time).alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    e = events.select(F.col(key).alias("_k"), micros(time).alias("_t"), F.struct(*events.columns).alias("_e")).withColumn("_b", bucket)
    p = past.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("_k"), micros(time).alias("_t"), best.alias("_p"))
    p = p.withColumn("_b", F.explode(F.array(bucket, bucket + 1)))
    within = Window.partitionBy("_k", "_b").orderBy("_t").rangeBetween(-length, 0)
    rows = e.unionByName(p, allowMissingColumns=True).withColumn("_m", F.max("_p").over(within)).filter("_e is not null")
    return rows.select("_e.*", F.col("_m.l").alias("evidence"), *[F.col(f"_m.k{i}").alias(f"evidence_{c}") for i, c in enumerate(keep)])


def dangling(rows: DataFrame, link: str, known: DataFrame, key: str) -> DataFrame:
    """rows whose link is set but names no known key."""
    return rows.filter(F.col(link).isNotNull() & (F.col(link) != "")).join(known.select(F.col(key).alias(link)).distinct(), link, "left_anti")


def drift(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """(key, change): added, removed or changed between two snapshots with one row a key; equal nulls are no change."""
    a, b = old.select(F.col(key), F.col(version).alias("_a"), F.lit(True).alias("_old")), new.select(F.col(key), F.col(version).alias("_b"), F.lit(True).alias("_new"))
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full_outer").select(key, state.alias("change")).filter("change is not null")


def renames(changes: DataFrame, old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """(old_key, new_key): removed and added keys of equal content, the least of each content paired with the least."""
    gone = changes.filter("change = 'removed'").join(old, key).dropna(subset=[version])
    made = changes.filter("change = 'added'").join(new, key).dropna(subset=[version])
    rank = Window.partitionBy(version).orderBy(key)
    gone, made = gone.select(F.col(key).alias("old_key"), version, F.row_number().over(rank).alias("_n")), made.select(F.col(key).alias("new_key"), version, F.row_number().over(rank).alias("_n"))
    return gone.join(made, [version, "_n"]).select("old_key", "new_key")


# ---------------------------------------------------------------- aggregates


def inventory_summary(files: DataFrame, kind: str = "kind", language: str = "language", path: str = "path", lines: str = "lines") -> DataFrame:
    """(dimension, value, files, lines): counts by kind, language and top folder in one pass over the rows."""
    rows = files.select(F.coalesce(kind, F.lit("")).alias("kind"), F.coalesce(language, F.lit("")).alias("language"), X.top_dir(F.col(path)).alias("folder"), F.col(lines).alias("n"))
    each = rows.select("n", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("kind", "language", "folder")])).alias("g"))
    return each.groupBy("g.dimension", "g.value").agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("lines"))


def unsupported(files: DataFrame, supported: list[str], analysable: Column) -> DataFrame:
    """(language, files): analysable files of languages without an extractor."""
    return files.filter(analysable & F.col("language").isNotNull() & (F.col("language") != "") & ~F.col("language").isin(supported)).groupBy("language").agg(F.count("*").alias("files"))


def key_frequencies(rows: DataFrame, key: str, words: Column) -> DataFrame:
    """(term, df): in how many rows each folded term stands."""
    return rows.select(key, F.explode(X.keys(words)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def same_name(symbols: DataFrame, project: str, value: str = "signature") -> DataFrame:
    """Names that one project defines in several files, by kind, and whether constants agree on one value."""
    wanted = symbols.filter(F.col("kind").isin("function", "class", "constant", "type", "interface", "enum") & F.coalesce("exported", F.lit(False)))
    held = F.when(F.coalesce(value, F.lit("")) != "", F.col(value))
    groups = wanted.groupBy(project, "kind", "name").agg(F.count_distinct("file").alias("files"), F.count_distinct(held).alias("values"))
    return groups.filter("files > 1").withColumn("verdict", F.when((F.col("kind") == "constant") & (F.col("values") == 1), "same value").when(F.col("kind") == "constant", "different values").otherwise("parallel definitions"))


def same_value(symbols: DataFrame, project: str, value: str = "signature", least: int = 8) -> DataFrame:
    """Values, cut to 80 characters, that stand under several constant names of a project."""
    rows = symbols.filter((F.col("kind") == "constant")).withColumn("value", F.substring(value, 1, 80)).filter(F.length("value") >= least)
    return rows.groupBy(project, "value").agg(F.count_distinct("name").alias("names"), F.min("name").alias("first_name")).filter("names > 1")


def grouped_dependents(links: DataFrame, target: str, source: str, name: str, confidence: str) -> DataFrame:
    """By target and source: the names used and the weakest confidence."""
    return links.groupBy(target, source).agg(F.array_sort(F.collect_set(name)).alias("names"), X.worst(F.col(confidence), X.CONFIDENCES).alias("confidence"))


def conflicts(rows: DataFrame, key: list[str], item: str) -> DataFrame:
    """Keys with more than one current item."""
    return rows.groupBy(*key).agg(F.count_distinct(item).alias("items")).filter("items > 1")


def capped(rows: DataFrame, group: list[str], order: list[Column], cap: int | dict[str, int], default: int = 0) -> DataFrame:
    """The first rows of each group, as many as its cap; a dict caps by the first group column."""
    limit = F.lit(cap) if isinstance(cap, int) else F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in cap.items() for x in kv]), F.col(group[0])), F.lit(default))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= limit)


# ---------------------------------------------------------------- ranking


def related(symbols: DataFrame, query: str, limit: int = 10, test_paths: DataFrame | None = None, key: str = "sym_seq") -> DataFrame:
    """The symbols that fit a query best: rare terms weigh more, names more than documentation, documentation more than paths.

    Document frequency counts all symbols, private variables included, though those are never candidates.
    """
    asked = symbols.sparkSession.range(1).select(X.terms(F.lit(query)).alias("raw")).select(X.keys(F.col("raw")).alias("raw"), X.keys(X.expanded(F.col("raw"))).alias("all")).first()
    raw, wide = asked["raw"], asked["all"]
    strings = lambda words: F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    name_keys = X.keys(X.terms(F.col("qualname")))
    # One pass counts, and its one row of weights goes to every task; a second pass scores. No row is shuffled.
    counts = symbols.select(F.array_intersect(name_keys, strings(wide)).alias("nk")).agg(F.greatest(F.count("*"), F.lit(1)).alias("total"), *[F.count(F.when(F.array_contains("nk", w), 1)).alias(f"w{i}") for i, w in enumerate(wide)])
    weight = lambda i: F.greatest(F.lit(0.2), F.log((F.col("total") + 1) / (F.col(f"w{i}") + 1)) / F.log(F.col("total") + 1))
    weights = counts.select(F.map_from_arrays(strings(wide), F.array(*[weight(i) for i in range(len(wide))]) if wide else F.array().cast("array<double>")).alias("_w"))
    stem = F.regexp_replace(X.name_of(F.col("file")), r"(?<=[^.])\.[^.]+$", "")
    folder = F.coalesce(F.try_element_at(F.split("file", "/"), F.lit(-2)), F.lit(""))
    rows = symbols.filter((F.col("kind") != "variable") | F.coalesce("exported", F.lit(False))).select(
        key, "file", "line", "kind", "qualname", name_keys.alias("nk"), F.array_intersect(X.keys(X.terms(F.coalesce("doc", F.lit("")))), strings(wide)).alias("dk"), F.array_intersect(F.array_union(X.keys(X.terms(stem)), X.keys(X.terms(folder))), strings(wide)).alias("fk")
    )
    rows = rows.withColumn("hits", F.array_intersect("nk", strings(wide))).filter((F.size("hits") > 0) | (F.size("dk") > 0)).join(F.broadcast(weights), F.lit(True))
    total = lambda words, gain: F.aggregate(words, F.lit(0.0), lambda s, t: s + gain(t) * F.element_at(F.col("_w"), t))
    sums = total("hits", lambda t: F.when(F.array_contains(strings(raw), t), 3.0).otherwise(2.0)) + total("dk", lambda t: F.lit(1.0)) + total("fk", lambda t: F.lit(0.5))
    score = sums + F.when(F.size("nk") > 0, 2.0 * F.size("hits") / F.size("nk")).otherwise(0.0) + F.when(F.col("kind").isin("function", "method", "class"), 0.5).otherwise(0.0)
    scored = rows.withColumn("score", score)
    if test_paths is not None:
        tests = test_paths.select(F.col(test_paths.columns[0]).alias("file"), F.lit(0.4).alias("_f")).distinct()
        scored = scored.join(tests, "file", "left").withColumn("score", F.col("score") * F.coalesce("_f", F.lit(1.0))).drop("_f")
    return scored.select(key, "file", "line", "kind", "qualname", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "file", "line", key).limit(limit)


def recent(rows: DataFrame, time: str, seconds: int) -> DataFrame:
    """The rows of the last seconds before the newest one, which is the clock; rows without a time are none of them."""
    newest = rows.agg(F.max(time).alias("_now"))
    return rows.join(F.broadcast(newest), F.lit(True)).filter(F.col(time) >= F.col("_now") - F.make_dt_interval(secs=F.lit(seconds))).drop("_now")


STRONG, WEAK = 4.5, 2.5


def reuse_decision(symbols: DataFrame, query: str, names: list[str], limit: int = 8, test_paths: DataFrame | None = None) -> DataFrame:
    """(decision, exact_hits, strong, candidates): reuse, extend, refactor-or-create or create."""
    best = related(symbols, query, limit, test_paths)
    tiers = best.agg(F.count(F.when(F.col("score") >= STRONG, 1)).alias("strong"), F.count(F.when(F.col("score") >= WEAK, 1)).alias("candidates"))
    named = F.lit(False)
    for n in names:
        named = named | (F.col("name") == n) | (F.col("qualname") == n) | F.col("qualname").endswith("." + n)
    exact = symbols.agg(F.count(F.when(named, 1)).alias("exact_hits"))
    both = tiers.join(exact, F.lit(True))
    return both.select(F.when(F.col("exact_hits") > 0, "reuse").when(F.col("strong") > 0, "extend").when(F.col("candidates") > 0, "refactor-or-create").otherwise("create").alias("decision"), "exact_hits", "strong", "candidates")


def next_id(items: DataFrame, key: str, prefix: str = "M-", digits: int = 4) -> DataFrame:
    """(next_id): the largest number in use, plus one; padded to so many digits, and never cut to them."""
    return items.agg((F.coalesce(F.max(F.expr(f"try_cast(regexp_extract({key}, '([0-9]+)$', 1) as int)")), F.lit(0)) + 1).alias("n")).select(F.concat(F.lit(prefix), F.expr(f"lpad(n, greatest({digits}, length(n)), '0')")).alias("next_id"))


# ---------------------------------------------------------------- sets


def symbol_delta(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the new table whose key is new, and of the old whose key is gone, with ``change``."""
    return without(new, old, key).withColumn("change", F.lit("new")).unionByName(without(old, new, key).withColumn("change", F.lit("removed")))


def append_unique(old: Column, new: Column) -> Column:
    """Array union that keeps the first order; nulls count as empty."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(old, empty), F.coalesce(new, empty)))


# ---------------------------------------------------------------- validation


def rule_errors(rules: list[tuple[Column, str]]) -> Column:
    """The messages of all rules that a row breaks, in their order; a rule that is null is not broken."""
    return F.filter(F.array(*[F.when(broken, F.lit(message)) for broken, message in rules]), lambda m: m.isNotNull())

"""Repetition inside a single document.

The method: a table of thresholds is compiled into one projection of ratios, made of built-in
functions only; no user function and no shuffle. Only the measures that a table names are computed:
``repetitive`` uses the table's first row, ``repetition`` all of them. Runs of ``n`` words are hashed, sorted by hash and
position, and every run after the first of its hash marks its words as repeated. Sorting makes the
work n log n in the length of the document, whole texts included.

Defined results: null, empty and blank texts give zero words and zero shares and are never flagged;
a text shorter than a run has no repetition; ties between equal runs go to the earlier position;
repeated rows give repeated rows; further columns pass through, unless they carry the name of a
measure, which replaces them.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.runtime import let

#: Removed before words are cut: zero-width characters, the soft hyphen and the byte order mark.
INVISIBLE = "[\\u200B\\u200C\\u200D\\u00AD\\uFEFF]"
LETTERS = r"\p{L}+"

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = "the of and to in a is that for it on with as by at from le la les des du et un une der die das und ein eine el los las de y en".split()

#: A row: (measure, comparison, bound, minimum of words); a document breaks a rule if the measure passes the bound.
#: A share of exactly a third counts: both sides are then the same quotient, rounded the same way.
REPEATED = ("repeated_share", ">=", 1 / 3, 50)
#: The stop words are those of four languages: a text in another one breaks the last rule too.
THRESHOLDS = (
    REPEATED,
    ("duplicate_line_share", ">", 0.5, 50),
    ("symbol_share", ">", 0.3, 50),
    ("mean_word_length", ">", 20.0, 50),
    ("stop_word_share", "<", 0.02, 50),
)


def words(text: Column) -> Column:
    """Lower-cased runs of letters, invisible characters removed; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(F.regexp_replace(text, INVISIBLE, "")), F.lit(LETTERS), F.lit(0)), F.array().cast("array<string>"))


def repeated_words(tokens: Column, n: int = 8) -> Column:
    """How many of the words lie in a run of n words that already occurs, starting earlier.

    The words are first replaced by their hashes, and a run by the hash of its n longs, which are
    compared within one document only. Only documents in which a run comes twice are sorted.
    """

    def marked(codes: Column) -> Column:
        ahead = F.transform(codes, lambda c, i: F.xxhash64(*[F.get(codes, i + k) for k in range(n)]))
        runs = F.slice(ahead, 1, F.greatest(F.size(codes) - n + 1, F.lit(0)))
        return F.when(F.size(codes) > n, let(runs, lambda r: F.when(F.size(F.array_distinct(r)) < F.size(r), spans(r)).otherwise(0))).otherwise(0)

    def spans(runs: Column) -> Column:
        placed = F.sort_array(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(order: Column) -> Column:
            before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(order, 1, F.size(order) - 1))
            return F.filter(F.zip_with(order, before, lambda a, b: F.when(a["h"] == b["h"], a["i"])), lambda x: x.isNotNull())

        def covered(at: Column) -> Column:
            after = F.concat(F.slice(at, 2, F.size(at)), F.array(F.lit(2**31 - 1)))
            return F.aggregate(F.zip_with(at, after, lambda a, b: F.least(b - a, F.lit(n))), F.lit(0), lambda s, x: s + x)

        return let(placed, lambda o: let(F.sort_array(positions(o)), covered))

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), marked)


MEASURES = ("repeated_share", "mean_word_length", "stop_word_share", "symbol_share", "duplicate_line_share")


def measures(text: Column, n: int = 8, names: tuple[str, ...] = MEASURES) -> Column:
    """One struct of the number of words and the named ratios of a text."""
    safe = F.coalesce(text, F.lit(""))
    lines = F.filter(F.transform(F.split(safe, "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    def of_words(w: Column) -> Column:
        count = F.size(w)
        ways = {
            "repeated_share": lambda: ratio(repeated_words(w, n), count),
            "mean_word_length": lambda: ratio(F.length(F.array_join(w, "")), count),
            "stop_word_share": lambda: ratio(F.size(F.filter(w, lambda x: F.array_contains(stops, x))), count),
            "symbol_share": lambda: ratio(F.length(F.regexp_replace(safe, r"[\p{L}\p{N}\s]", "")), F.length(safe)),
            "duplicate_line_share": lambda: let(lines, lambda x: ratio(F.size(x) - F.size(F.array_distinct(x)), F.size(x))),
        }
        return F.struct(count.alias("words"), *[ways[name]().alias(name) for name in names])

    return let(words(text), of_words)


def broken_rules(m: Column, thresholds=THRESHOLDS) -> Column:
    """The names of the rules that the measures break, in the order of the table."""

    def breaks(name: str, how: str, bound: float, least: int) -> Column:
        value = m[name]
        test = {">": value > bound, ">=": value >= bound, "<": value < bound}[how]
        return F.when((m["words"] >= least) & test, F.lit(name))

    return F.filter(F.array(*[breaks(*rule) for rule in thresholds]), lambda x: x.isNotNull())


def judged(text: Column, n: int, thresholds) -> Column:
    """(m, broken): the measures that a table names, and the rules of it that a text breaks."""
    names = tuple(dict.fromkeys(rule[0] for rule in thresholds))
    return let(measures(text, n, names), lambda m: F.struct(m.alias("m"), broken_rules(m, thresholds).alias("broken")))


def repetition(docs: DataFrame, text: str = "text", n: int = 8, thresholds=THRESHOLDS) -> DataFrame:
    """Each document with its measures and the rules that it breaks, in one projection."""
    row = docs.withColumn("_r", judged(F.col(text), n, thresholds))
    names = row.schema["_r"].dataType["m"].dataType.names
    kept = [c for c in docs.columns if c not in {*names, "broken"} and c != text]
    return row.select(*kept, *[F.col(f"_r.m.{c}").alias(c) for c in names], F.col("_r.broken").alias("broken"))


def repetitive(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 8, thresholds=(REPEATED,)) -> DataFrame:
    """Keys of the documents that break a rule of the table."""
    # One condition, so that the optimizer does not copy its parts into several filters.
    return docs.filter(F.size(judged(F.col(text), n, thresholds)["broken"]) > 0).select(key).distinct()

"""State over ordered events: once per key, capped counters, level transitions, gates and supersession.

These are the batch forms, by windows over one key; codeloom.streaming holds the same over streams. Rows with
a null key form one group; ties of time are broken by the sequence column, which must be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.runtime import dense_rank


def once(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first event of each key."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def capped_count(events: DataFrame, key: str, order: list[str], counts: Column, cap: int, out: str = "count") -> DataFrame:
    """A running count of some events, held at a cap."""
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn(out, F.least(F.sum(F.when(counts, 1).otherwise(0)).over(so_far), F.lit(cap)))


def transitions(events: DataFrame, key: str, order: list[str], level: str, ranks: tuple[str, ...]) -> DataFrame:
    """Events at which the level rises, each message (key and level) once; the level before the first is the lowest."""
    w = Window.partitionBy(key).orderBy(*order)
    rank = X.rank_in(F.col(level), ranks)
    rows = events.withColumn("_r", rank).withColumn("_before", F.lag("_r", 1, 0).over(w)).filter("_r > _before")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key, level).orderBy(*order))).filter("_n = 1").withColumn("from_level", X.named_rank(F.col("_before"), ranks)).drop("_r", "_before", "_n")


def supersede(items: DataFrame, key: str, order: list[str], item: str) -> DataFrame:
    """Each item with the next of its key as ``superseded_by`` and a status."""
    later = F.lead(item).over(Window.partitionBy(key).orderBy(*order))
    return items.withColumn("superseded_by", later).withColumn("status", F.when(F.col("superseded_by").isNull(), "current").otherwise("superseded"))


TERMINAL = ("superseded", "deprecated")


def superseded_items(items: DataFrame, successors: DataFrame, key: str = "id", inherited: tuple[str, ...] = ()) -> DataFrame:
    """The items after successors have come: all of both, with status and superseded_by.

    A successor names the item that it supersedes, if any, and takes over that item's inherited fields where its own are
    null or empty. An item is superseded by the least successor that names it. Items whose status is terminal stay as they
    are, and what names one, or an unknown item, comes out with status rejected and changes nothing.
    """
    columns = [key, "status", "updated", *inherited]
    named = items.select(F.col(key).alias("_old"), F.col("status").alias("_status"), *[F.col(c).alias(f"_{c}") for c in inherited])
    asked = F.coalesce(F.col("supersedes").cast("string"), F.lit("")) != ""
    met = successors.join(named, F.col("supersedes") == F.col("_old"), "left")
    bad = asked & (F.col("_old").isNull() | F.col("_status").isin(*TERMINAL))

    def filled(c: str) -> Column:
        kind = items.schema[c].dataType.typeName()
        gone = F.col(c).isNull() | (F.size(c) == 0 if kind == "array" else F.col(c).cast("string") == "")
        return F.when(gone & ~bad, F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c)

    fresh = met.select(key, F.when(bad, "rejected").otherwise(F.col("status")).alias("status"), "updated", *[filled(c) for c in inherited], F.lit(None).cast(items.schema[key].dataType).alias("superseded_by"), F.when(asked & ~bad, F.col("_old")).alias("_replaces"))
    by = fresh.filter("_replaces is not null").groupBy(F.col("_replaces").alias(key)).agg(F.min(key).alias("_by"), F.min_by("updated", key).alias("_when"))
    old = items.join(by, key, "left").select(key, F.when(F.col("_by").isNotNull(), "superseded").otherwise(F.col("status")).alias("status"), F.coalesce("_when", "updated").alias("updated"), *inherited, F.col("_by").alias("superseded_by"))
    return old.unionByName(fresh.select(*columns, "superseded_by"))


def task_state(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, assumptions, questions, state): a task frame folded from its changes.

    changes: assumption, material, question, resolve, answer, confirm. A confirmation or resolution settles what was said
    before it and holds its text, in any case; a repeated text counts once. The changes of one key are one task: their
    number is bounded by what one person says.
    """
    row = F.struct(*order, "assumption", "material", "question", "resolve", "answer", "confirm")
    folded = changes.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    assumptions, questions = "array<struct<text:string,material:boolean,confirmed:boolean>>", "array<struct<text:string,resolved:boolean,answer:string>>"
    start = F.struct(F.array().cast(assumptions).alias("a"), F.array().cast(questions).alias("q"))

    def step(state: Column, r: Column) -> Column:
        new_a = r["assumption"].isNotNull() & (r["assumption"] != "") & ~F.exists(state["a"], lambda x: x["text"] == r["assumption"])
        a = F.when(new_a, F.concat(state["a"], F.array(F.struct(r["assumption"].alias("text"), F.coalesce(r["material"], F.lit(False)).alias("material"), F.lit(False).alias("confirmed"))))).otherwise(state["a"])
        settle = lambda word, text: F.coalesce((word != "") & F.contains(F.lower(text), F.lower(word)), F.lit(False))
        a = F.transform(a, lambda x: F.struct(x["text"].alias("text"), x["material"].alias("material"), (x["confirmed"] | settle(r["confirm"], x["text"])).alias("confirmed")))
        new_q = r["question"].isNotNull() & (r["question"] != "") & ~F.exists(state["q"], lambda x: x["text"] == r["question"])
        q = F.when(new_q, F.concat(state["q"], F.array(F.struct(r["question"].alias("text"), F.lit(False).alias("resolved"), F.lit("").alias("answer"))))).otherwise(state["q"])
        q = F.transform(q, lambda x: F.struct(x["text"].alias("text"), (x["resolved"] | settle(r["resolve"], x["text"])).alias("resolved"), F.when(settle(r["resolve"], x["text"]), F.coalesce(r["answer"], F.lit(""))).otherwise(x["answer"]).alias("answer")))
        return F.struct(a.alias("a"), q.alias("q"))

    done = folded.select(key, F.aggregate("rows", start, step).alias("s")).select(key, F.col("s.a").alias("assumptions"), F.col("s.q").alias("questions"))
    return done.withColumn("state", decision_state(F.col("assumptions"), F.col("questions")))


def decision_state(assumptions: Column, questions: Column) -> Column:
    return F.when(F.exists(questions, lambda q: ~q["resolved"]), "blocked").when(F.exists(assumptions, lambda a: a["material"] & ~a["confirmed"]), "awaiting-confirmation").otherwise("clear")


def settled_gates(gates: DataFrame, digests: DataFrame, key: str, time: str, digest: str) -> DataFrame:
    """Gates with the first later digest of their file that differs; settled_at is null where none does."""
    d = digests.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.col(digest).alias("_d"))
    met = gates.join(d, (gates[key] == d["_k"]) & (d["_t"] > gates[time]) & (d["_d"] != gates[digest]), "left")
    return met.groupBy(*gates.columns).agg(F.min("_t").alias("settled_at"))


def fresh_records(records: DataFrame, current: DataFrame, key: str, signature: str) -> DataFrame:
    """Records with ``fresh``: whether their signature is still that of their key; what has none now is not fresh."""
    now = current.select(key, F.col(signature).alias("_now"))
    return records.join(now, key, "left").withColumn("fresh", F.coalesce(F.col(signature) == F.col("_now"), F.lit(False))).drop("_now")


def permissive(calls: DataFrame, decision: str = "decision", default: str = "allow") -> DataFrame:
    """Calls that all have a decision: where none could be made the default, with ``audited`` saying so."""
    return calls.withColumn("audited", F.col(decision).isNull()).withColumn(decision, F.coalesce(decision, F.lit(default)))


def edit_decision(calls: DataFrame, trivial: int = 3) -> DataFrame:
    """Calls with their decision: allow, ask or deny.

    calls: is_write, inside, is_code, open_questions, shape, lines, evidence (target, task or null), evidence_command,
    pending (material assumptions). A new file needs a command that looked for reuse: the one entry found decides.
    """
    trivial_edit = (F.col("shape") == "edit") & (F.col("lines") > 0) & (F.col("lines") <= trivial)
    looked = F.coalesce(F.col("evidence_command").isin("reuse", "brief", "context"), F.lit(False))
    evidence = (
        F.when(trivial_edit, "allow")
        .when(F.col("shape") == "new-file", F.when(looked, "allow").otherwise("deny"))
        .when(F.col("evidence") == "target", "allow")
        .when(F.col("evidence") == "task", "ask")
        .otherwise("deny")
    )
    free = ~F.coalesce("is_write", F.lit(False)) | ~F.coalesce("inside", F.lit(False)) | ~F.coalesce("is_code", F.lit(False))
    decision = F.when(free, "allow").when(F.coalesce("open_questions", F.lit(0)) > 0, "deny").when(evidence == "deny", "deny").when(F.coalesce("pending", F.lit(0)) > 0, "ask").otherwise(evidence)
    return calls.withColumn("decision", decision)


def stop_gate(stops: DataFrame, key: str, order: list[str], cap: int = 2) -> DataFrame:
    """Stops with their decision: continue while outstanding, at most ``cap`` times a conversation; a signature verified once is not verified again."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = stops.withColumn("_asks", F.sum(F.when(F.col("outstanding") > 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("cached", F.coalesce(F.lag("signature").over(w) == F.col("signature"), F.lit(False)))
    return rows.withColumn("decision", F.when((F.col("outstanding") > 0) & (F.col("_asks") <= cap), "continue").otherwise("allow")).drop("_asks")


def trimmed_log(events: DataFrame, order: list[str], limit: int = 1000, keep: int = 500) -> DataFrame:
    """The log as it is, or its newest rows once it has outgrown the limit."""
    total = events.agg(F.count("*").alias("_total"))
    ranked = dense_rank(events, [F.desc(c) for c in order], "_n")
    return ranked.join(F.broadcast(total), F.lit(True)).filter((F.col("_total") <= limit) | (F.col("_n") <= keep)).drop("_n", "_total")

"""What runs of an agent did: discovery, coverage, adoption, call patterns and a diagnosis.

A table of steps has run, step, op (read, map, search, dependencies, expand or pack) and
file: what was read, asked for or delivered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tool calls; reads are the host's own.
CALLS = ("map", "search", "dependencies", "expand", "pack")


def discovery(steps: DataFrame) -> DataFrame:
    """(run, file, read_step, delivered_step): the first of either; null if there was none."""
    first = lambda op: F.min(F.when(F.col("op") == op, F.col("step")))
    return steps.filter("op in ('read', 'pack')").groupBy("run", "file").agg(first("read").alias("read_step"), first("pack").alias("delivered_step"))


def delivered_before_read(found: DataFrame) -> DataFrame:
    """Files whose delivery precedes their first read."""
    return found.filter("delivered_step < read_step")


def packs_after_reads(steps: DataFrame) -> DataFrame:
    """(run, step, file) of deliveries of files that the host had read before."""
    first = F.min(F.when(F.col("op") == "read", F.col("step"))).over(W.partitionBy("run", "file"))
    return steps.withColumn("first_read", first).filter("op = 'pack' and first_read < step").select("run", "step", "file")


def coverage(found: DataFrame, relevant: DataFrame, runs: DataFrame) -> DataFrame:
    """Relevant files surfaced and missed, other files surfaced, and early recall of each run.

    ``relevant`` has file; ``runs`` run and successful. Recall is the share of relevant
    files delivered before they were read; it is unknown for a run that did not succeed.
    """
    total = relevant.agg(F.count_distinct("file").alias("wanted"))
    marked = found.join(relevant.select("file").distinct().withColumn("relevant", F.lit(True)), "file", "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))
    per_run = marked.groupBy("run").agg(
        F.count_if("relevant").alias("surfaced"),
        F.count_if(~F.col("relevant")).alias("others"),
        F.count_if(F.col("relevant") & F.col("read_step").isNull()).alias("unread"),
        F.count_if(F.col("relevant") & F.coalesce(F.col("delivered_step") < F.coalesce("read_step", F.lit(2**31 - 1)), F.lit(False))).alias("early"),
    )
    joined = runs.join(per_run, "run", "left").crossJoin(F.broadcast(total)).na.fill(0, ["surfaced", "others", "unread", "early"])
    recall = F.when(F.col("successful") & (F.col("wanted") > 0), F.round(F.col("early") / F.col("wanted"), 4))
    return joined.select("run", "surfaced", (F.col("wanted") - F.col("surfaced")).alias("missed"), "others", "unread", recall.alias("early_recall"))


def adoption(steps: DataFrame, relevant: DataFrame) -> DataFrame:
    """Whether and how each run used the tool, and if before its first read of a relevant file."""
    called = F.col("op").isin(*CALLS)
    marked = steps.join(relevant.select("file").distinct().withColumn("relevant", F.lit(True)), "file", "left")
    found = marked.groupBy("run").agg(
        F.count_if(called).alias("calls"),
        F.min_by(F.when(called, F.col("op")), F.when(called, F.col("step"))).alias("first_op"),
        F.min(F.when(called, F.col("step"))).alias("first_call"),
        F.min(F.when((F.col("op") == "read") & F.col("relevant"), F.col("step"))).alias("first_read"),
    )
    known = F.col("first_call").isNotNull() & F.col("first_read").isNotNull()
    timing = F.when(~known, "unknown").when(F.col("first_call") < F.col("first_read"), "before").otherwise("after")
    return found.select("run", (F.col("calls") > 0).alias("invoked"), "calls", "first_op", timing.alias("timing"))


def call_patterns(steps: DataFrame, expands: int = 3) -> DataFrame:
    """(run, step, pattern, evidence): sequences of calls that may be redundant.

    A search right after a map; dependencies asked for again, with the earlier step; a
    pack of what was delivered before; and each expand from the third in a row on. The
    steps of a run are walked in order, with frames that only grow.
    """
    order = W.partitionBy("run").orderBy("step")
    calls = steps.filter(F.col("op").isin(*CALLS))
    target = W.partitionBy("run", "op", "file").orderBy("step")
    seen = F.min(F.when(F.col("op") == "pack", F.col("step"))).over(W.partitionBy("run", "file"))
    streak = calls.withColumns({"before": F.lag("op").over(order), "again": F.lag("step").over(target), "seen": seen, "other": F.sum(F.when(F.col("op") == "expand", 0).otherwise(1)).over(order)})
    streak = streak.withColumn("nth", F.sum(F.when(F.col("op") == "expand", 1).otherwise(0)).over(W.partitionBy("run", "other").orderBy("step")))
    evidence = [
        F.when((F.col("op") == "search") & (F.col("before") == "map"), F.struct(F.lit("map_then_search").alias("pattern"), F.col("file").alias("evidence"))),
        F.when((F.col("op") == "dependencies") & F.col("again").isNotNull(), F.struct(F.lit("repeated_dependencies").alias("pattern"), F.col("again").cast("string").alias("evidence"))),
        F.when((F.col("op") == "pack") & (F.col("seen") < F.col("step")), F.struct(F.lit("pack_after_same_source").alias("pattern"), F.col("file").alias("evidence"))),
        F.when((F.col("op") == "expand") & (F.col("nth") >= expands), F.struct(F.lit("multiple_expands").alias("pattern"), F.col("file").alias("evidence"))),
    ]
    return streak.select("run", "step", F.explode(F.filter(F.array(*evidence), lambda x: x.isNotNull())).alias("e")).select("run", "step", "e.*")


def diagnosis(steps: DataFrame, relevant: DataFrame, runs: DataFrame, most_extra: int = 5) -> DataFrame:
    """(run, category, first_relevant_step): the first category that a successful run's evidence allows."""
    wanted = relevant.select("file").distinct().withColumn("relevant", F.lit(True))
    found = discovery(steps).join(wanted, "file", "left")
    per_run = found.groupBy("run").agg(
        F.max(F.coalesce(F.col("relevant") & (F.col("delivered_step") < F.col("read_step")), F.lit(False))).alias("earlier"),
        F.count_if(F.col("relevant").isNull() & F.col("delivered_step").isNotNull()).alias("extra"),
        F.min(F.when(F.col("relevant"), F.least("read_step", "delivered_step"))).alias("first_relevant_step"),
    )
    flags = call_patterns(steps).select("run").unionByName(packs_after_reads(steps).select("run")).distinct().withColumn("flagged", F.lit(True))
    called = steps.filter(F.col("op").isin(*CALLS)).select("run").distinct().withColumn("called", F.lit(True))
    joined = runs.join(per_run, "run", "left").join(flags, "run", "left").join(called, "run", "left")
    category = (
        F.when(~F.col("successful") | F.col("called").isNull(), "inconclusive")
        .when(F.col("earlier"), "context discovered earlier")
        .when(F.col("flagged"), "repeated/redundant exploration")
        .when(F.col("extra") >= most_extra, "excessive context")
        .otherwise("inconclusive")
    )
    return joined.select("run", category.alias("category"), "first_relevant_step")


def item_waits(steps: DataFrame) -> DataFrame:
    """(run, file, finished, wait): from the latest start of an item before its end; null if it never started.

    ``steps`` has run, step, file, phase (started or completed) and at, in microseconds.
    """
    order = W.partitionBy("run", "file").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    begun = F.last(F.when(F.col("phase") == "started", F.col("at")), ignorenulls=True).over(order)
    ended = steps.withColumn("begun", begun).filter("phase = 'completed'")
    return ended.select("run", "file", F.col("step").alias("finished"), F.round((F.col("at") - F.col("begun")) / 1_000_000.0, 3).alias("wait"))


def run_figures(steps: DataFrame) -> DataFrame:
    """Counts of each run by operation, and the file of its last pack."""
    of = lambda op: F.count_if(F.col("op") == op).alias(f"{op}s")
    last = F.max_by(F.when(F.col("op") == "pack", F.col("file")), F.when(F.col("op") == "pack", F.col("step")))
    return steps.groupBy("run").agg(F.count(F.lit(1)).alias("steps"), of("read"), of("search"), of("pack"), last.alias("last_packed"))


def versions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both versions of each task side by side; a difference only where their identity keys agree."""
    a = before.select("task", F.col("identity").alias("identity_before"), F.col("seconds").alias("before"))
    b = after.select("task", F.col("identity").alias("identity_after"), F.col("seconds").alias("after"))
    same = F.col("identity_before").eqNullSafe(F.col("identity_after"))
    return a.join(b, "task", "full_outer").select("task", "before", "after", F.when(same, F.round(F.col("after") - F.col("before"), 6)).alias("difference"))

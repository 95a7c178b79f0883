"""Metrics of operations, sessions and matched runs."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import size_checked, stored


def overview(traces: DataFrame) -> DataFrame:
    """Count, distinct users and latency of each operation; unknown latencies are left out."""
    return traces.groupBy("operation").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("user_id").alias("users"),
        F.round(F.sum("latency"), 2).alias("total_latency"),
        F.round(F.avg("latency"), 6).alias("mean_latency"),
        (F.count(F.lit(1)) - F.count("latency")).alias("unknown"),
    )


def at_ranks(rows: DataFrame, ranks: Mapping[str, Callable[[Column], Column]], bins: int = 4096) -> DataFrame:
    """(key, n, missing, and a column for each rank): the values at these places of each key's known values in order.

    ``rows`` has key and value; a rank is a function of the number of known values. Counts
    of equal bins tell which bin holds each rank; only the distinct values of those bins are
    ordered, so no task sees all values of a frequent key.
    """
    rows = rows.select("key", F.col("value").cast("double").alias("value"))
    ranges = rows.groupBy("key").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("n"), (F.count(F.lit(1)) - F.count("value")).alias("missing"))
    ranges = stored(ranges, "ranges")
    placed = rows.filter("value is not null").join(size_checked(ranges.drop("missing"), 48, ["key"]), "key")
    width = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    placed = placed.select("key", "value", "n", F.coalesce(F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("low")) * bins / width)), F.lit(0)).alias("bin"))
    counts = stored(placed.groupBy("key", "bin", "n").agg(F.count(F.lit(1)).alias("size")), "bin-counts")
    upto = F.sum("size").over(W.partitionBy("key").orderBy("bin"))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("rank")) for name, rank in ranks.items()]))
    held = counts.withColumn("upto", upto).select("*", asked.alias("q")).withColumn("rank", F.col("q.rank"))
    held = held.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("size") < F.col("rank")))
    held = stored(held.select("key", "bin", F.col("q.name").alias("name"), (F.col("rank") - F.col("upto") + F.col("size")).alias("rank")), "rank-bins")
    values = placed.join(size_checked(held, 48, ["key"]), ["key", "bin"]).groupBy("key", "name", "rank", "value").agg(F.count(F.lit(1)).alias("times"))
    within = values.withColumn("upto", F.sum("times").over(W.partitionBy("key", "name").orderBy("value"))).filter(F.col("upto") >= F.col("rank"))
    found = within.groupBy("key").agg(*[F.min(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in ranks])
    return ranges.select("key", "n", "missing").join(found, "key", "left").select("key", "n", "missing", *ranks)


def percentiles(traces: DataFrame, bins: int = 4096) -> DataFrame:
    """Nearest-rank P50 and P95 of each operation, and how many latencies are known and missing."""
    ranks = {"p50": lambda n: F.ceil(n * 0.5), "p95": lambda n: F.ceil(n * 0.95)}
    found = at_ranks(traces.select(F.col("operation").alias("key"), F.col("latency").alias("value")), ranks, bins)
    return found.select(F.col("key").alias("operation"), "p50", "p95", "n", "missing")


def cohort_report(runs: DataFrame) -> DataFrame:
    """A row for each mode, for each mode's clean and other pairs, and for each mode and task.

    ``runs`` has task, mode, success, disrupted, comparable, seconds, observed_files,
    repeated_reads and context_tokens. A task is a clean pair if two modes have one
    comparable run each, all successful and none disrupted. Unknown seconds stay unknown:
    the mean and the median are those of known ones. Files of unsuccessful runs are told
    apart. The result has level (mode, pairs or task), mode, clean, task, and the figures.
    """
    good = F.col("success") & ~F.coalesce("disrupted", F.lit(False)) & F.coalesce("comparable", F.lit(False))
    pairs = runs.groupBy("task").agg((F.count_distinct("mode") == 2).alias("both"), (F.count(F.lit(1)) == 2).alias("two"), F.min(F.coalesce(good, F.lit(False))).alias("good"))
    pairs = stored(pairs.select("task", (F.col("both") & F.col("two") & F.col("good")).alias("clean")), "pairs")
    rows = stored(runs.join(size_checked(pairs, 32), "task"), "cohort-rows")
    level = F.expr("case grouping_id() when 3 then 'mode' when 1 then 'pairs' else 'task' end")
    sets = [[F.col("mode")], [F.col("mode"), F.col("clean")], [F.col("mode"), F.col("task")]]
    known = lambda c: F.coalesce(F.sum(c), F.lit(0))
    figures = rows.groupingSets(sets, F.col("mode"), F.col("clean"), F.col("task")).agg(
        level.alias("level"),
        F.count(F.lit(1)).alias("runs"),
        F.count_if("success").alias("successes"),
        F.count_if(F.coalesce("disrupted", F.lit(False))).alias("disrupted_runs"),
        F.round(F.avg("seconds"), 6).alias("mean_seconds"),
        known(F.when(F.col("success"), F.col("observed_files"))).alias("observed_files_successful"),
        known("observed_files").alias("observed_files"),
        known("repeated_reads").alias("repeated_reads"),
        known("context_tokens").alias("context_tokens"),
    )
    none = F.lit(None)
    named = [
        F.struct(F.lit("mode").alias("level"), "mode", none.cast("boolean").alias("clean"), none.cast(rows.schema["task"].dataType).alias("task")),
        F.struct(F.lit("pairs").alias("level"), "mode", "clean", none.cast(rows.schema["task"].dataType).alias("task")),
        F.struct(F.lit("task").alias("level"), "mode", none.cast("boolean").alias("clean"), "task"),
    ]
    keyed = rows.select(F.explode(F.array(*[F.to_json(k) for k in named])).alias("key"), F.col("seconds").alias("value"))
    middle = at_ranks(keyed, {"low": lambda n: F.floor((n + 1) / 2), "high": lambda n: F.ceil((n + 1) / 2)})
    medians = middle.select("key", F.round((F.col("low") + F.col("high")) / 2, 6).alias("median_seconds"))
    own = figures.withColumn("key", F.to_json(F.struct("level", "mode", "clean", "task")))
    return own.join(medians, "key", "left").drop("key")


def period_change(traces: DataFrame, end: str, days: int) -> DataFrame:
    """Counts of the last ``days`` before ``end`` and of as many before; change in per cent, null from none."""
    age = (F.unix_micros(F.lit(end).cast("timestamp")) - F.unix_micros("ts")) / 86_400_000_000.0
    now = F.count_if((age >= 0) & (age < days))
    before = F.count_if((age >= days) & (age < 2 * days))
    found = traces.groupBy("operation").agg(now.alias("current"), before.alias("previous"))
    return found.withColumn("change", F.when(F.col("previous") > 0, F.floor((F.col("current") - F.col("previous")) * 100.0 / F.col("previous") + 0.5)))


def activity_bars(traces: DataFrame, start: str, end: str, bars: int = 30) -> DataFrame:
    """Operations in equal spans of time from ``start`` to ``end``; empty spans count 0."""
    low, high = (F.unix_micros(F.lit(x).cast("timestamp")) for x in (start, end))
    place = F.least(F.lit(bars - 1), F.greatest(F.lit(0), F.floor((F.unix_micros("ts") - low) * float(bars) / (high - low)))).cast("long")
    counts = traces.groupBy(place.alias("bar")).agg(F.count(F.lit(1)).alias("n"))
    return traces.sparkSession.range(bars).withColumnRenamed("id", "bar").join(counts, "bar", "left").select("bar", F.coalesce("n", F.lit(0)).alias("n"))


def repeated_calls(traces: DataFrame, least: int = 3) -> DataFrame:
    """Runs of at least ``least`` equal operations in a row of one session."""
    order = W.partitionBy("session_id").orderBy("ts", "seq")
    starts = traces.withColumn("start", (~F.col("operation").eqNullSafe(F.lag("operation").over(order))).cast("int"))
    runs = starts.withColumn("run", F.sum("start").over(order))
    found = runs.groupBy("session_id", "run", "operation").agg(F.count(F.lit(1)).alias("length"), F.min("seq").alias("first_seq"))
    return found.filter(F.col("length") >= least).select("session_id", "operation", "length", "first_seq")


def first_reads(reads: DataFrame) -> DataFrame:
    """First step and repeated reads of each file of a session."""
    return reads.groupBy("session_id", "file").agg(F.min("seq").alias("first_seq"), (F.count(F.lit(1)) - 1).alias("repeats"))


def islands(lines: DataFrame) -> DataFrame:
    """Maximal ranges of consecutive line numbers of each owner; ``lines`` has owner and line."""
    order = W.partitionBy("owner").orderBy("line")
    grouped = lines.distinct().withColumn("island", F.col("line") - F.row_number().over(order))
    return grouped.groupBy("owner", "island").agg(F.min("line").alias("low"), F.max("line").alias("high")).select("owner", "low", "high")


def wait_spans(events: DataFrame, begin: str, finish: str) -> DataFrame:
    """Each ``begin`` event with the seconds to the session's next ``finish``; null if there is none."""
    # Backwards, the frame only grows: one pass over a session of any length.
    later = W.partitionBy("session_id").orderBy(F.col("ts").desc(), F.col("seq").desc()).rowsBetween(W.unboundedPreceding, -1)
    ends = F.last(F.when(F.col("operation") == finish, F.unix_micros("ts")), ignorenulls=True).over(later)
    spans = events.withColumn("wait", F.round((ends - F.unix_micros("ts")) / 1_000_000.0, 3))
    return spans.filter(F.col("operation") == begin).select("session_id", "seq", "wait")


def matched_pairs(runs: DataFrame, control: str, treatment: str) -> DataFrame:
    """Mean difference of treatment and control for tasks that have both; unknown stays null."""
    mean = lambda mode: F.avg(F.when(F.col("mode") == mode, F.col("seconds")))
    found = runs.groupBy("task").agg(mean(control).alias("control"), mean(treatment).alias("treatment"))
    found = found.filter("control is not null and treatment is not null")
    return found.select("task", F.round("control", 6).alias("control"), F.round("treatment", 6).alias("treatment"), F.round(F.col("treatment") - F.col("control"), 6).alias("difference"))


def path_tree(paths: DataFrame) -> DataFrame:
    """How many paths lie under each folder."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    spread = paths.filter(F.size(parts) > 1).select(F.explode(folders).alias("folder"))
    return spread.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))


def estimated_cost(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """Cost of each usage row by model; null where tokens or the price are unknown."""
    joined = usage.join(size_checked(pricing, 64, ["model"]), "model", "left")
    cost = ((F.col("input_tokens") - F.col("cached_tokens")) * F.col("input_rate") + F.col("cached_tokens") * F.col("cached_rate") + F.col("output_tokens") * F.col("output_rate")) / 1e6
    return joined.select(*usage.columns, F.round(cost, 6).alias("cost"))


def latest_before(events: DataFrame, asked: str, known: str) -> DataFrame:
    """As-of join within a session: each ``asked`` event with the value of the latest earlier ``known`` one."""
    earlier = W.partitionBy("session_id").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, -1)
    value = F.last(F.when(F.col("operation") == known, F.col("latency")), ignorenulls=True).over(earlier)
    return events.withColumn("known", value).filter(F.col("operation") == asked).select("session_id", "seq", "known")


def after_last(events: DataFrame, mark: str) -> DataFrame:
    """Events of a session after its last ``mark``, and all of one that has none."""
    last = F.max(F.when(F.col("operation") == mark, F.struct("ts", "seq"))).over(W.partitionBy("session_id"))
    return events.withColumn("last", last).filter(F.col("last").isNull() | (F.struct("ts", "seq") > F.col("last"))).select("session_id", "seq")


def mode_comparison(runs: DataFrame, modes: list[str]) -> DataFrame:
    """Counts of each task by mode, side by side, and the first two's difference; null where a mode has none."""
    found = runs.groupBy("task").pivot("mode", modes).agg(F.count(F.lit(1)))
    return found.withColumn("difference", F.col(modes[1]) - F.col(modes[0]))


def similar_pairs(pairs: DataFrame, band: float) -> DataFrame:
    """Outcome of each pair: similar within ``band``, else which side is lower; inconclusive if unknown."""
    d = F.col("difference")
    return pairs.select("task", F.when(d.isNull(), "inconclusive").when(F.abs(d) <= band, "similar").when(d < 0, "lower").otherwise("higher").alias("outcome"))


def suite_aggregates(runs: DataFrame) -> DataFrame:
    """Runs, known and mean seconds of each mode."""
    return runs.groupBy("mode").agg(F.count(F.lit(1)).alias("runs"), F.count("seconds").alias("known"), F.round(F.avg("seconds"), 4).alias("mean"), F.min("seconds").alias("least"), F.max("seconds").alias("most"))


def remaining_ranges(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Ranges of asked lines of each owner that are not known yet; both have owner and line."""
    return islands(asked.join(known, ["owner", "line"], "left_anti"))


def token_savings(units: DataFrame) -> DataFrame:
    """Tokens of each conversation's whole history and of its selected messages, and what is saved."""
    found = units.groupBy("conv_id").agg(F.sum("tokens").alias("full_tokens"), F.coalesce(F.sum(F.when(F.col("selected"), F.col("tokens"))), F.lit(0)).alias("selected_tokens"))
    return found.withColumn("saved", F.col("full_tokens") - F.col("selected_tokens"))


def newest(traces: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of traces, newest first; ties go by id, so pages neither overlap nor leave gaps."""
    return traces.orderBy(F.col("ts").desc(), F.col("seq").desc()).offset(offset).limit(limit)


def outcomes(runs: DataFrame) -> DataFrame:
    """The class of each run: blocked before it could start, unfinished, a success or a completed failure."""
    rule = F.when(F.col("blocked"), "blocked_incomplete").when(F.col("unfinished"), "incomplete").when(F.col("succeeded"), "success").otherwise("completed_failure")
    return runs.select("run", rule.alias("outcome"))


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """(owner, low, high): ranges of each owner, joined where they overlap or touch."""
    order = W.partitionBy("owner").orderBy("low", "high")
    before = F.max("high").over(order.rowsBetween(W.unboundedPreceding, -1))
    begun = ranges.select("owner", "low", "high").distinct().withColumn("begins", F.coalesce((F.col("low") > before + 1).cast("int"), F.lit(1)))
    islands = begun.withColumn("island", F.sum("begins").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy("owner", "island").agg(F.min("low").alias("low"), F.max("high").alias("high")).select("owner", "low", "high")


def by_condition(traces: DataFrame) -> DataFrame:
    """Latency and bytes by size class and by whether an operation came first in its session."""
    first = F.row_number().over(W.partitionBy("session_id", "operation").orderBy("ts", "seq")) == 1
    marked = traces.withColumn("mode", F.when(first, "cold").otherwise("warm"))
    return marked.groupBy("size", "mode").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency"), 6).alias("mean_latency"), F.sum("bytes").alias("bytes"))

"""Queries about runs: the events table read as the log of an agent, a run for each user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import metrics, observation
from .registry import _table, registered

_OPS = {"view": "read", "click": "search", "signup": "map", "purchase": "pack", "error": "expand"}

_STEPS = """
    with steps as (
      select user_id as run, row_number() over (partition by user_id order by ts, event_id) as step, epoch_us(ts) as us,
        case when event_type = 'view' then 'read' when event_type = 'click' then 'search' when event_type = 'purchase' then 'pack' when event_type = 'error' then 'expand'
          when event_id % 2 = 0 then 'map' else 'dependencies' end as op,
        'f' || (cast(json_extract_string(props, '$.k') as bigint) % 25) as file from events
    ), relevant as (select distinct file from steps where cast(substr(file, 2) as bigint) % 3 = 0),
    runs as (select run, sum(step) % 4 <> 0 as successful from steps group by run),
    found as (select run, file, min(step) filter (where op = 'read') as read_step, min(step) filter (where op = 'pack') as delivered_step from steps where op in ('read', 'pack') group by 1, 2),
    late as (select run, step, file from (select *, min(case when op = 'read' then step end) over (partition by run, file) as first_read from steps) where op = 'pack' and first_read < step),
    calls as (select *, lag(op) over (partition by run order by step) as before, lag(step) over (partition by run, op, file order by step) as again,
        min(case when op = 'pack' then step end) over (partition by run, file) as seen, sum(case when op = 'expand' then 0 else 1 end) over (partition by run order by step) as other from steps where op <> 'read'),
    streak as (select *, sum(case when op = 'expand' then 1 else 0 end) over (partition by run, other order by step) as nth from calls),
    patterns as (
      select run, step, 'map_then_search' as pattern, file as evidence from streak where op = 'search' and before = 'map'
      union all select run, step, 'repeated_dependencies', cast(again as varchar) from streak where op = 'dependencies' and again is not null
      union all select run, step, 'pack_after_same_source', file from streak where op = 'pack' and seen < step
      union all select run, step, 'multiple_expands', file from streak where op = 'expand' and nth >= 3
    )
    """


def _steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Steps, relevant files and runs."""
    named = F.create_map(*[F.lit(x) for pair in _OPS.items() for x in pair])[F.col("event_type")]
    op = F.when((named == "map") & (F.col("event_id") % 2 == 1), "dependencies").otherwise(named)
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    file = F.concat(F.lit("f"), F.get_json_object("props", "$.k").cast("long") % 25)
    events = _table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    steps = events.select(F.col("user_id").alias("run"), F.row_number().over(order).cast("long").alias("step"), F.unix_micros("ts").alias("at"), op.alias("op"), file.alias("file"))
    relevant = steps.select("file").distinct().filter(F.substring("file", 2, 9).cast("long") % 3 == 0)
    return steps, relevant, steps.groupBy("run").agg((F.sum("step") % 4 != 0).alias("successful"))


@registered(_STEPS + "select * from found where delivered_step < read_step")
def discovery_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observation.delivered_before_read(observation.discovery(_steps(spark, sf_dir)[0]))


@registered(_STEPS + "select * from late")
def pack_after_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observation.packs_after_reads(_steps(spark, sf_dir)[0])


@registered(
    _STEPS
    + """, m as (select run, count(*) filter (where r.file is not null) as surfaced, count(*) filter (where r.file is null) as others, count(*) filter (where r.file is not null and read_step is null) as unread,
        count(*) filter (where r.file is not null and delivered_step < coalesce(read_step, 2147483647)) as early from found left join relevant r using (file) group by run)
    select run, coalesce(surfaced, 0) as surfaced, (select count(*) from relevant) - coalesce(surfaced, 0) as missed, coalesce(others, 0) as others, coalesce(unread, 0) as unread,
      case when successful then round(coalesce(early, 0) / (select count(*) from relevant), 4) end as early_recall from runs left join m using (run)"""
)
def run_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps, relevant, runs = _steps(spark, sf_dir)
    return observation.coverage(observation.discovery(steps), relevant, runs)


@registered(
    _STEPS
    + """, a as (select run, count(*) filter (where op <> 'read') as calls, arg_min(op, step) filter (where op <> 'read') as first_op, min(step) filter (where op <> 'read') as c,
        min(step) filter (where op = 'read' and file in (select file from relevant)) as r from steps group by run)
    select run, calls > 0 as invoked, calls, first_op, case when c is null or r is null then 'unknown' when c < r then 'before' else 'after' end as timing from a"""
)
def adoption_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps, relevant, _ = _steps(spark, sf_dir)
    return observation.adoption(steps, relevant)


@registered(_STEPS + "select * from patterns")
def sequence_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observation.call_patterns(_steps(spark, sf_dir)[0])


@registered(
    _STEPS
    + """, p as (select run, bool_or(r.file is not null and coalesce(delivered_step < read_step, false)) as earlier, count(*) filter (where r.file is null and delivered_step is not null) as extra,
        min(least(read_step, delivered_step)) filter (where r.file is not null) as first_relevant_step from found left join relevant r using (file) group by run),
    flagged as (select run from patterns union select run from late)
    select run, case when not successful or run not in (select run from steps where op <> 'read') then 'inconclusive' when earlier then 'context discovered earlier'
      when run in (select run from flagged) then 'repeated/redundant exploration' when extra >= 5 then 'excessive context' else 'inconclusive' end as category, first_relevant_step from runs left join p using (run)"""
)
def run_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observation.diagnosis(*_steps(spark, sf_dir))


@registered(
    _STEPS
    + """, w as (select *, last_value(case when op = 'map' then us end ignore nulls) over (partition by run, file order by step rows between unbounded preceding and 1 preceding) as begun from steps)
    select run, file, step as finished, round((us - begun) / 1000000.0, 3) as wait from w where op = 'dependencies'"""
)
def item_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase = F.when(F.col("op") == "map", "started").when(F.col("op") == "dependencies", "completed")
    return observation.item_waits(_steps(spark, sf_dir)[0].withColumn("phase", phase))


@registered(
    _STEPS
    + """select run, count(*) as steps, count(*) filter (where op = 'read') as reads, count(*) filter (where op = 'search') as searchs, count(*) filter (where op = 'pack') as packs,
      arg_max(file, step) filter (where op = 'pack') as last_packed from steps group by run"""
)
def event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observation.run_figures(_steps(spark, sf_dir)[0])


@registered(
    """
    with a as (select o_custkey as task, max(o_orderpriority) as i, round(avg(o_totalprice), 6) as s from orders where o_orderstatus = 'F' group by 1),
    b as (select o_custkey as task, max(o_orderpriority) as i, round(avg(o_totalprice), 6) as s from orders where o_orderstatus = 'O' group by 1)
    select task, a.s as before, b.s as after, case when a.i is not distinct from b.i then round(b.s - a.s, 6) end as difference from a full join b using (task)"""
)
def version_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("task"), "o_orderstatus").agg(F.max("o_orderpriority").alias("identity"), F.round(F.avg("o_totalprice"), 6).alias("seconds"))
    return observation.versions(orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus = 'O'"))


@registered(
    """
    select user_id as session, min(ts) as first_ts, max(ts) as last_ts, arg_min(value, (ts, event_id)) filter (where event_type = 'click') as first_click, arg_max(value, (ts, event_id)) filter (where event_type = 'click') as last_click
    from events group by user_id"""
)
def session_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    order, click = F.struct("ts", "event_id"), F.col("event_type") == "click"
    first, last = F.min_by("value", F.when(click, order)), F.max_by("value", F.when(click, order))
    return events.groupBy(F.col("user_id").alias("session")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), first.alias("first_click"), last.alias("last_click"))


@registered(
    """
    with r as (select distinct l_orderkey as owner, cast(l_linenumber * 3 as bigint) as low, cast(l_linenumber * 3 + floor(l_quantity) % 5 as bigint) as high from lineitem),
    b as (select *, case when low > max(high) over (partition by owner order by low, high rows between unbounded preceding and 1 preceding) + 1 then 1
        when max(high) over (partition by owner order by low, high rows between unbounded preceding and 1 preceding) is null then 1 else 0 end as begins from r),
    i as (select *, sum(begins) over (partition by owner order by low, high rows between unbounded preceding and current row) as island from b)
    select owner, min(low) as low, max(high) as high from i group by owner, island"""
)
def merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _table(spark, sf_dir, "lineitem")
    low = (F.col("l_linenumber") * 3).cast("long")
    return metrics.merged_ranges(line.select(F.col("l_orderkey").alias("owner"), low.alias("low"), (low + F.floor("l_quantity") % 5).cast("long").alias("high")))


@registered(
    """
    with a as (select distinct l_orderkey as owner, cast(l_linenumber as bigint) as line from lineitem),
    k as (select distinct l_orderkey as owner, cast(l_linenumber as bigint) as line from lineitem join orders on o_orderkey = l_orderkey where l_linestatus = 'F' and o_orderstatus <> 'P'),
    d as (select * from a where (owner, line) not in (select owner, line from k)),
    g as (select owner, line, line - row_number() over (partition by owner order by line) as island from d)
    select owner, min(line) as low, max(line) as high from g group by owner, island"""
)
def valid_range_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").cast("long").alias("line"), "l_linestatus")
    # A delivery counts only while what it hangs on still holds.
    holds = _table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("owner"))
    known = line.filter("l_linestatus = 'F'").join(holds, "owner", "left_semi").select("owner", "line")
    return metrics.remaining_ranges(line.select("owner", "line").distinct(), known)


@registered(
    """
    with e as (select *, row_number() over (partition by user_id, event_type order by ts, event_id) = 1 as first from events)
    select case when event_id % 3 = 0 then 'small' else 'large' end as size, case when first then 'cold' else 'warm' end as mode, count(*) as n, round(avg(value), 6) as mean_latency, cast(sum(length(props)) as bigint) as bytes from e group by 1, 2"""
)
def latency_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    traces = events.select(
        F.col("user_id").alias("session_id"), F.col("event_type").alias("operation"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("latency"),
        F.length("props").cast("long").alias("bytes"), F.when(F.col("event_id") % 3 == 0, "small").otherwise("large").alias("size"),
    )
    return metrics.by_condition(traces)


@registered(
    """
    with first as (select * from orders where o_orderstatus in ('F', 'O') and o_custkey % 11 <> 3 qualify row_number() over (partition by o_custkey, o_orderstatus order by o_orderkey) = 1),
    r as (
      select o_custkey as task, o_orderstatus as mode, o_orderpriority not like '1%' as success, o_orderpriority like '5%' as disrupted, o_custkey % 13 <> 5 as comparable, case when o_orderkey % 9 <> 2 then o_totalprice end as seconds,
        o_orderkey % 7 as observed_files, o_orderkey % 3 as repeated_reads, case when o_orderkey % 4 <> 0 then o_orderkey % 1000 end as context_tokens from first
    ), p as (select task, count(distinct mode) = 2 and count(*) = 2 and bool_and(success and not disrupted and comparable) as clean from r group by 1)
    select case grouping_id(mode, clean, task) when 3 then 'mode' when 1 then 'pairs' else 'task' end as level, mode, clean, task, count(*) as runs, count(*) filter (where success) as successes, count(*) filter (where disrupted) as disrupted_runs,
      round(avg(seconds), 6) as mean_seconds, round(median(seconds), 6) as median_seconds, cast(coalesce(sum(observed_files) filter (where success), 0) as bigint) as observed_files_successful, cast(coalesce(sum(observed_files), 0) as bigint) as observed_files,
      cast(coalesce(sum(repeated_reads), 0) as bigint) as repeated_reads, cast(coalesce(sum(context_tokens), 0) as bigint) as context_tokens
    from r join p using (task) group by grouping sets ((mode), (mode, clean), (mode, task))"""
)
def cohort_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").filter("o_orderstatus in ('F', 'O') and o_custkey % 11 <> 3")
    keys = orders.groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderkey").alias("o_orderkey"))
    first, key = orders.join(keys, ["o_custkey", "o_orderstatus", "o_orderkey"], "left_semi"), F.col("o_orderkey")
    runs = first.select(
        F.col("o_custkey").alias("task"),
        F.col("o_orderstatus").alias("mode"),
        (~F.col("o_orderpriority").like("1%")).alias("success"),
        F.col("o_orderpriority").like("5%").alias("disrupted"),
        (F.col("o_custkey") % 13 != 5).alias("comparable"),
        F.when(key % 9 != 2, F.col("o_totalprice")).alias("seconds"),
        (key % 7).alias("observed_files"),
        (key % 3).alias("repeated_reads"),
        F.when(key % 4 != 0, key % 1000).alias("context_tokens"),
    )
    return metrics.cohort_report(runs)

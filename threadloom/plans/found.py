"""Queries that look things up: candidates, targets, bundles, deliveries, orders, maps, and streams of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import content_hash, context_id, in_scope, low_information
from ..operators import lookups, packing, retrieval
from ..shared import shared_dir, size_checked, stored
from ..sources import conversations
from ..streaming import ingest, jobs
from .registry import _PAGES, _UNIT, _WORDS, _page_path, _page_tables, _table, code_graph, registered

_ENDINGS = ", ".join(f"'{e}'" for e in lookups.ENDINGS)


@registered(
    _PAGES
    + rf""", w as (select file, module, regexp_replace(file, '/[^/]*$', '') as folder from links),
    b as (select file, module, unnest(case when starts_with(module, '.') then [folder || '/' || module] else list_distinct([module, folder || '/' || module]) end) as base from w)
    select file, module, array_to_string(list_filter(string_split(base, '/'), lambda x: x not in ('', '.')), '/') || e as candidate from b cross join (select unnest([{_ENDINGS}]) as e)"""
)
def import_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.import_candidates(_page_tables(spark, sf_dir)[2].select("file", "module"))


@registered(
    _PAGES
    + rf"""select distinct query_id, name from (select item_id as query_id, unnest({_WORDS.format("text")}) as name from benchmark) join (select distinct symbol from declared) on symbol = name"""
)
def mentioned_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return lookups.mentioned_entities(queries, _page_tables(spark, sf_dir)[1].select(F.col("symbol").alias("name")))


@registered(
    _PAGES
    + """, t as (select distinct unnest([file || '::' || symbol, symbol, split_part(file, '/', 1), split_part(file, '/', 2), 'nowhere']) as target from declared),
    s as (
      select file || '::' || symbol as target, 1 as stage, file from declared
      union select symbol, 2, file from declared
      union select unnest(list_transform(range(1, len(string_split(file, '/')) + 1), lambda i: array_to_string(string_split(file, '/')[1:i], '/'))), 2, file from (select distinct file from declared)
      union select unnest(string_split(file, '/')), 3, file from (select distinct file from declared)
    ), m as (select *, min(stage) over (partition by target) as first from s where target in (select target from t))
    select distinct target, cast(stage as bigint) as stage, file from m where stage = first"""
)
def target_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = _page_tables(spark, sf_dir)[1]
    symbols = declared.select(F.concat("file", F.lit("::"), "symbol").alias("symbol_id"), F.col("symbol").alias("name"), "file")
    parts = F.split("file", "/")
    targets = symbols.select(F.explode(F.array("symbol_id", "name", parts[0], parts[1], F.lit("nowhere"))).alias("target"))
    return lookups.resolved_targets(targets, symbols)


@registered(
    _PAGES
    + """select split_part(src, '::', 1) as file, kind, src, dst from g union all select split_part(dst, '::', 1), kind, src, dst from g where split_part(dst, '::', 1) <> split_part(src, '::', 1)"""
)
def relation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.relation_index(code_graph(spark, sf_dir))


@registered(
    """
    with d as (select user_id as session, epoch_us(ts) // 86400000000 as trace, event_type as item from events),
    b as (select session, trace, 'ctx_' || sha256(array_to_string(list_sort(list(distinct item)), ',')) as bundle from d group by 1, 2)
    select *, case when row_number() over (partition by session, bundle order by trace) = 1 then 'new' else 'already_supplied' end as status from b"""
)
def bundle_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).cast("long")
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), day.alias("trace"), F.col("event_type").alias("item"))
    return lookups.bundles(rows)


@registered(
    """
    with k as (select user_id as session, event_id, cast(json_extract_string(props, '$.k') as bigint) as tokens, row_number() over (partition by user_id, event_type order by ts, event_id) > 1 as known from events)
    select session, cast(sum(tokens) as bigint) as candidate_tokens, cast(coalesce(sum(tokens) filter (where not known), 0) as bigint) as new_tokens,
      cast(coalesce(sum(tokens) filter (where known and event_id % 5 <> 0), 0) as bigint) as avoided_tokens, cast(coalesce(sum(tokens) filter (where known and event_id % 5 = 0), 0) as bigint) as retransmitted_tokens from k group by session"""
)
def refresh_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    nth = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), (nth > 1).alias("known"), (F.col("event_id") % 5 == 0).alias("forced"), F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    return lookups.refresh_accounting(rows)


@registered(
    """
    with r as (select user_id as trace, 'f' || (cast(json_extract_string(props, '$.k') as bigint) % 40) as path, case when event_id % 3 = 0 then 'map' else 'pack' end as level, event_id, event_type, ts from events),
    l as (select trace, path, level, arg_min(event_id, event_id) as context_id from r where event_type = 'purchase' group by all)
    select event_id, trace, path, level, context_id from r left join l using (trace, path, level) where event_type = 'view'"""
)
def prior_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("f"), F.get_json_object("props", "$.k").cast("long") % 40)
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("trace"), path.alias("path"), F.when(F.col("event_id") % 3 == 0, "map").otherwise("pack").alias("level"), "event_id", "event_type")
    ledger = rows.filter("event_type = 'purchase'").select("trace", "path", "level", F.col("event_id").alias("context_id"), F.col("event_id").alias("seq"))
    return lookups.prior_deliveries(rows.filter("event_type = 'view'").select("event_id", "trace", "path", "level"), ledger)


@registered(
    """
    with d as (select source as context, cast(doc_id as varchar) as path, sha256(text) as h from documents),
    n as (select cast(doc_id as varchar) as path, sha256(case when lang = 'fr' then upper(text) else text end) as now from documents where lang <> 'es')
    select context, path from d left join n using (path) where h is distinct from now"""
)
def invalidated_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("path", F.col("doc_id").cast("string"))
    now = F.when(F.col("lang") == "fr", F.upper("text")).otherwise(F.col("text"))
    return lookups.invalidated(docs.select(F.col("source").alias("context"), "path", content_hash(F.col("text")).alias("content_hash")), docs.filter("lang <> 'es'").select("path", content_hash(now).alias("content_hash")))


@registered(
    """
    with f as (select source as query_id, cast(doc_id as varchar) as path, doc_id % 8 as tier, doc_id % 137 as score, n_chars as tokens from documents),
    o as (select *, row_number() over (partition by query_id order by case when tier <> 0 then 1 else 0 end, tier, score::double / greatest(1, tokens) desc, score desc, path) as place from f)
    select * from o where place <= 20"""
)
def repository_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").cast("string").alias("path"), (F.col("doc_id") % 8).alias("tier"), (F.col("doc_id") % 137).alias("score"), F.col("n_chars").alias("tokens"))
    return lookups.repository_order(files, 20)


@registered("select conv_id, left(arg_min(text, turn), 40) as title, count(*) as messages from conversations group by conv_id order by conv_id limit 24")
def conversation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.conversation_map(_table(spark, sf_dir, "conversations"), 24)


@registered(
    """
    with q as (select item_id as query_id, lower(text) as q from benchmark),
    n as (select query_id, list_filter([case when contains(q, 'that') then 'message' end, case when contains(q, 'rees') then 'src1' end, case when contains(q, 'able') then 'src2' end], lambda x: x is not null) as s from q),
    a as (select query_id, unnest(case when len(s) > 0 then list_distinct(s) else ['message', 'src1', 'src2'] end) as source from n)
    select * from a where source in (select source from documents)"""
)
def source_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return lookups.inferred_sources(queries, [("that", "message"), ("rees", "src1"), ("able", "src2")], _table(spark, sf_dir, "documents"))


@registered(r"""select page_id, path = 'm.example' or starts_with(path, 'blog.ththan.example.net/') as inside from (select page_id, regexp_replace(regexp_extract(url, '^[^?#]*', 0), '^[a-z]+://', '') as path from pages)""")
def path_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", in_scope(_page_path(F.col("url")), "blog.ththan.example.net").alias("inside"))


@registered(f"""select {_UNIT} as unit_id, 'ctx_' || sha256(to_json({{'conv_id': conv_id, 'role': role, 'turn': turn}})) as context_id from conversations""")
def context_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _table(spark, sf_dir, "conversations")
    return messages.select(conversations.message_name(F.col("conv_id"), F.col("turn")).alias("unit_id"), context_id(turn=F.col("turn"), role=F.col("role"), conv_id=F.col("conv_id")).alias("context_id"))


@registered(
    f"""
    with w as (select {_UNIT} as unit_id, {_WORDS.format("array_to_string(string_split(text, ' ')[1:2], ' ') || case when turn % 4 = 1 then '' else ' x' end")} as w, turn from conversations),
    s as (select unit_id, case when turn % 4 = 1 then ['thanks', 'sure'] else w end as w from w)
    select unit_id, len(w) between 1 and 3 and len(list_filter(w, lambda x: x not in ('ok', 'okay', 'thanks', 'thank', 'understood', 'noted', 'confirmed', 'yes', 'sure', 'great'))) = 0 as low from s"""
)
def low_information_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _table(spark, sf_dir, "conversations")
    first = F.concat(F.array_join(F.slice(F.split("text", " "), 1, 2), " "), F.lit(" x"))
    said = F.when(F.col("turn") % 4 == 1, "Thanks, sure!").otherwise(first)
    return messages.select(conversations.message_name(F.col("conv_id"), F.col("turn")).alias("unit_id"), low_information(said).alias("low"))


@registered(
    """
    with c as (select event_id as change_id, 'f' || (cast(json_extract_string(props, '$.k') as bigint) % 40) as path from events where event_type = 'error'),
    d as (select distinct c_custkey as context, 'f' || (c_custkey % 60) as path from customer)
    select change_id, context, path from c join d using (path)"""
)
def invalidation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    delivered = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("context"), F.concat(F.lit("f"), F.col("c_custkey") % 60).alias("path")).distinct()
    delivered = size_checked(stored(delivered, "delivered"), 16, ["path"])
    changes = jobs.event_stream(spark, sf_dir).filter("event_type = 'error'").select(F.col("event_id").alias("change_id"), F.concat(F.lit("f"), F.get_json_object("props", "$.k").cast("long") % 40).alias("path"))
    # Only the changes are written; which contexts each one meets is told as it is read.
    changed = jobs.run_once(changes, "append", "invalidations")
    return changed.join(delivered, "path").select("change_id", "context", "path")


@registered(
    """
    with s as (select user_id as run, event_id as step, case event_type when 'view' then 'map' when 'click' then 'search' when 'purchase' then 'pack' when 'error' then 'expand' else 'dependencies' end as op, ts,
        case when event_type <> 'view' or event_id % 3 = 0 then 'f' || (cast(json_extract_string(props, '$.k') as bigint) % 25) end as target, cast(json_extract_string(props, '$.k') as bigint) as known, event_id % 120 as full_ from events),
    c as (select *, lag(op) over o as before, lag(target) over o as target_before, lag(op, 2) over o as before2, row_number() over o as r, list({'op': op, 'target': target}) over (partition by run order by ts, step rows between 20 preceding and 1 preceding) as held from s window o as (partition by run order by ts, step)),
    p as (
      select run, step, unnest([case when op = 'search' and before = 'map' and target_before is null then 'map_then_search' end, case when op = 'dependencies' and list_contains(held, {'op': op, 'target': target}) then 'repeated_dependencies' end,
        case when op = 'pack' and list_contains(held, {'op': op, 'target': target}) then 'pack_after_same_source' end, case when full_ > 0 and known / full_ >= 0.75 then 'mostly_known_context' end,
        case when op = 'expand' and before = 'expand' and before2 = 'expand' then 'multiple_expands' end]) as pattern from c
    ) select * from p where pattern is not null"""
)
def live_patterns_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.create_map(*[F.lit(x) for pair in {"view": "map", "click": "search", "purchase": "pack", "error": "expand", "signup": "dependencies"}.items() for x in pair])
    k = F.get_json_object("props", "$.k").cast("long")
    target = F.when((F.col("event_type") != "view") | (F.col("event_id") % 3 == 0), F.concat(F.lit("f"), k % 25))
    calls = jobs.event_stream(spark, sf_dir).select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), "ts", named[F.col("event_type")].alias("op"), target.alias("target"), k.alias("known_tokens"), (F.col("event_id") % 120).alias("full_tokens"))
    return jobs.run_once(jobs.live_patterns(calls), "append", "patterns")


@registered(
    f"""
    with a as (select {_UNIT} as unit_id, sha256(text) as h from conversations where conv_id % 3 <> 1), b as (select {_UNIT} as unit_id, sha256(case when turn % 5 = 0 then upper(text) else text end) as h from conversations where conv_id % 3 <> 2)
    select case when a.h is null then 'added' when b.h is null then 'deleted' when a.h = b.h then 'unchanged' else 'changed' end as change, count(*) as n from a full join b using (unit_id) group by 1"""
)
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _table(spark, sf_dir, "conversations").withColumn("unit_id", conversations.message_name(F.col("conv_id"), F.col("turn")))
    now = F.when(F.col("turn") % 5 == 0, F.upper("text")).otherwise(F.col("text"))
    old = messages.filter("conv_id % 3 <> 1").select("unit_id", content_hash(F.col("text")).alias("content_hash"))
    return packing.change_classes(old, messages.filter("conv_id % 3 <> 2").select("unit_id", content_hash(now).alias("content_hash")), "unit_id").groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@registered(
    rf"""
    with p as (select page_id as path_id, regexp_replace(regexp_extract(url, '^[^?#]*', 0), '^[a-z]+://', '') || '#' || page_id as path, lower(html) as said, lower(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) as symbols from pages),
    q as (select item_id as query_id, lower(array_to_string(string_split(text, ' ')[1:4], ' ') || case when item_id % 100 = 0 then ' the of ' else '' end || string_split(text, ' ')[1]) as query from benchmark where item_id % 50 = 0),
    t as (select query_id, unnest({_WORDS.format("query")}) as term from q),
    s as (
      select query_id, path, sum(case when contains(lower(path), term) then 10 else 0 end + case when contains(symbols, term) then 8 else 0 end + least(5, (length(said) - length(replace(said, term, ''))) // length(term))) as n
      from t cross join p group by 1, 2
    ) select query_id, path, cast(n + case when contains(said, query) then 10 else 0 end as bigint) as score from s join q using (query_id) join p using (path) where n + case when contains(said, query) then 10 else 0 end > 0"""
)
def repository_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    files = pages.select(F.concat(_page_path(F.col("url")), F.lit("#"), "page_id").alias("path"), F.lower(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)).alias("symbols"), F.col("html").alias("content"))
    items = _table(spark, sf_dir, "benchmark").filter(F.col("item_id") % 50 == 0)
    w = F.split("text", " ")
    query = F.concat(F.array_join(F.slice(w, 1, 4), " "), F.when(F.col("item_id") % 100 == 0, " the of ").otherwise(""), w[0])
    return retrieval.repository_scores(files, items.select(F.col("item_id").alias("query_id"), query.alias("query")))


MESSAGES = "conv_id long, turn long, role string, text string"
#: Upper case as Spark has it: characters such as "ß" become several, which DuckDB leaves as they are.
_UPPER = "upper(text)"
for _c in filter(lambda c: len(c.upper()) > 1, map(chr, range(0x10000))):
    _UPPER = _UPPER.replace("text", f"replace(text, '{_c}', '{_c.upper()}')", 1)
_INGESTED = f"""
    with old as (select conv_id, turn, {_UNIT} as unit_id, sha256(case when turn % 5 = 0 and conv_id % 2 = 0 then upper(text) else text end) as h from conversations where conv_id % 3 <> 1),
    new as (select conv_id, turn, {_UNIT} as unit_id, sha256(text) as h from conversations where conv_id % 3 <> 2 and not (conv_id % 4 = 0 and turn = 3)),
    convs as (
      select coalesce(a.conv_id, b.conv_id) as conv_id, a.conv_id is null or bool_or(a.h is distinct from b.h) as changed from old a full join new b using (conv_id, turn) where coalesce(a.conv_id, b.conv_id) % 3 <> 2 group by 1, a.conv_id
    ), by_conv as (select conv_id, bool_or(changed) as changed from convs group by 1)
    """


def _ingested(spark: SparkSession, sf_dir: str) -> ingest.Table:
    """Two runs into one table: an earlier state of two thirds of the conversations, then what another two thirds say now."""
    stream = jobs.table_stream(spark, sf_dir, "conversations.parquet", MESSAGES)
    was = F.when((F.col("turn") % 5 == 0) & (F.col("conv_id") % 2 == 0), F.upper("text")).otherwise(F.col("text"))
    earlier = stream.filter("conv_id % 3 <> 1").withColumn("text", was)
    later = stream.filter("conv_id % 3 <> 2 and not (conv_id % 4 = 0 and turn = 3)")
    schema = ingest.message_units(spark.createDataFrame([], MESSAGES))[0].schema
    table = ingest.Table(spark, f"{shared_dir(spark)}/threadloom-units-{uuid.uuid4().hex}", schema)
    for name, part in (("earlier", earlier), ("later", later)):
        ingest.ingest(part, ingest.message_units, table, name)
    return table


@registered(
    _INGESTED.replace("upper(text)", _UPPER)
    + """select unit_id, h as content_hash, case when changed then 2 else 1 end as revision from new join by_conv using (conv_id)
    union all select unit_id, h, 1 from old where conv_id % 3 = 2"""
)
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).rows().select("unit_id", "content_hash", "revision")


@registered(
    _INGESTED
    + """, moved as (select a.unit_id as was, b.unit_id as now, a.h as old, b.h as new from (select * from old where conv_id in (select conv_id from new)) a full join new b using (unit_id))
    select 'earlier-0' as batch, 'added' as change, count(*) as n, 1 as revision from old
    union all select 'later-0', case when was is null then 'added' when now is null then 'deleted' when old = new then 'unchanged' else 'changed' end, count(*), 2 from moved group by 2"""
)
def ingest_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).reports().select("batch", "change", "n", "revision")

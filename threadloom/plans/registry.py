"""Each query by name, with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, content_hash, token_count
from ..operators import context, graph, grading, metrics, packing, relations, retrieval
from ..operators.working_context import DIRECTIVE, NOTICE, SECTIONS, TITLE, Wording, prioritised, rendered
from ..shared import stored
from ..sources import conversations, events
from ..streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Tokens that a pack may hold.
BUDGET = 3000
#: Start, end and period of the activity reports.
START, END, DAYS = "2024-01-01", "2024-01-31", 7
#: Rules in order: pattern, category, priority.
RULES = [
    (r"(?i)licensed under|licen[sc]e", "licence", "required"),
    (r"(?i)(password|token|secret|api_?key)[^\n]{0,3}[=:]", "credential", "critical"),
    (r"[#*$%&]{3}", "noise", "informational"),
    (r"@[a-z0-9-]+\.", "contact", "supporting"),
]
_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
_TOKENS = r"coalesce(len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+|[^\s\p{{L}}\p{{N}}_]')), 0)"


def registered(sql: str | None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            SQL[query.__name__] = sql
        return query

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("operation"), F.col("value").alias("latency"))


@registered(
    rf"""
    select 'conversation:' || conv_id || '/message:' || turn as unit_id, 'message' as source_type, 'conversation:' || conv_id as parent_id, role,
           turn as position, text as content, sha256(text) as content_hash, cast({_TOKENS.format("text")} as bigint) as token_count
    from conversations
    union all
    select 'conversation:' || conv_id, 'conversation', null, null, count(*), null, null, cast(sum({_TOKENS.format("text")}) as bigint)
    from conversations group by conv_id"""
)
def conversation_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.units(_table(spark, sf_dir, "conversations"))


@registered(
    """
    with m as (select conv_id, 'conversation:' || conv_id || '/message:' || turn as unit, 'conversation:' || conv_id as whole,
                      lag(turn) over (partition by conv_id order by turn) as before from conversations)
    select 'member_of' as kind, unit as src_id, whole as dst_id from m
    union all select 'contains', whole, unit from m
    union all select 'follows', 'conversation:' || conv_id || '/message:' || before, unit from m where before is not null"""
)
def conversation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.edges(_table(spark, sf_dir, "conversations"))


@registered(
    """
    select conv_id, turn, case when conv_id is null or turn is null then 'missing_id'
      when count(*) over (partition by conv_id, turn) > 1 then 'duplicate_id'
      when role is null or role not in ('user', 'assistant', 'tool') then 'unknown_role' when text is null then 'missing_content' end as reason
    from conversations"""
)
def conversation_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    strict = ("user", "assistant", "tool")
    checked = conversations.validated(_table(spark, sf_dir, "conversations"), roles=strict)
    return checked.select("conv_id", "turn", "reason")


@registered("select conv_id, turn, '[' || role || '] ' || text as line from conversations")
def conversation_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.transcript(_table(spark, sf_dir, "conversations"))


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"), F.col("text").alias("content"))
    items = _table(spark, sf_dir, "benchmark").filter(F.col("item_id") % 50 == 0)
    queries = items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.search(units, queries)


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _search_sql(units: str, queries: str) -> str:
    """CTEs up to ``found``: the best 30 of ``units`` (unit_id, content) for each of ``queries`` (query_id, query)."""
    return rf"""
    with recursive u as ({units}), asked as ({queries}),
    t as (select * from (select distinct query_id, unnest({_WORDS.format("query")}) as term from asked) where term not in ({_STOP})),
    q as (select query_id, trim(lower(query)) as query, len(string_split_regex(trim(query), '\s+')) > 4 as echo from asked where query_id in (select query_id from t)),
    spoken as (select unit_id, {_WORDS.format("content")} as w from u),
    tokens as (select unit_id, len(w) as len, unnest(w) as term from spoken),
    postings as (select unit_id, len, term, count(*) as tf from tokens where term in (select term from t) group by all),
    df as (select term, count(*) as df from postings group by term),
    total as (select cast(count(*) as double) as n from u),
    lexical as (
      select query_id, unit_id, count(*) as terms, sum(round(10 * least(10.0, (1 + (n - df + 0.5) / (df + 0.5)) * tf / (1 + 0.25 * len / 100)) / 10, 3)) as lexical
      from postings join df using (term) join t using (term) cross join total group by all
    ), met as (
      select q.query_id, u.unit_id, lexical, terms, echo, contains(lower(content), query) as phrase
      from q cross join u left join lexical l on l.query_id = q.query_id and l.unit_id = u.unit_id where len({_WORDS.format("content")}) > 0
    ), scored as (
      select query_id, unit_id, coalesce(terms, 0) as terms, phrase, round(coalesce(lexical, 0) + case when phrase then 30 else 0 end, 3) as score
      from met where not (phrase and echo) and (lexical is not null or phrase)
    ), ranked as (select *, row_number() over (partition by query_id order by score desc, unit_id) as rank from scored),
    found as (select query_id, unit_id, score, terms, rank from ranked where rank <= 30)
    """


_SEARCH = _search_sql("select doc_id as unit_id, text as content from documents", "select item_id as query_id, text as query from benchmark where item_id % 50 = 0")


@registered(_SEARCH + "select * from found")
def doc_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir)


@registered(
    _SEARCH
    + """, bound as (select *, round(greatest(2.0, least(30.0, 0.65 * max(score) over (partition by query_id))), 3) as floor from found)
    select *, score >= floor as kept from bound"""
)
def relevance_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.relevance_floor(_searched(spark, sf_dir))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"), token_count(F.col("text")).alias("cost"))
    return packing.budget_pack(_searched(spark, sf_dir).join(costs, "unit_id").select("query_id", "unit_id", "rank", "cost"), BUDGET)


_PACK = (
    _SEARCH
    + rf""", priced as (select f.query_id, f.unit_id, f.rank, cast({_TOKENS.format("d.text")} as bigint) as cost from found f join documents d on d.doc_id = f.unit_id),
    walk as (
      select query_id, unit_id, rank, cost, cost <= {BUDGET} as taken, case when cost <= {BUDGET} then cost else 0 end as used from priced where rank = 1
      union all
      select p.query_id, p.unit_id, p.rank, p.cost, w.used + p.cost <= {BUDGET}, w.used + case when w.used + p.cost <= {BUDGET} then p.cost else 0 end
      from walk w join priced p on p.query_id = w.query_id and p.rank = w.rank + 1
    )
    """
)


@registered(_PACK + "select query_id, unit_id, rank, cost, case when taken then 'selected' else 'does_not_fit' end as status from walk")
def budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


@registered(
    _PACK
    + f"""select query_id, cast(sum(cost) as bigint) as candidate_tokens, cast(coalesce(sum(cost) filter (where taken), 0) as bigint) as selected_tokens,
      count(*) filter (where taken) as selected_units, round(coalesce(sum(cost) filter (where taken), 0) / {BUDGET}, 4) as utilisation from walk group by query_id"""
)
def budget_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.selection_metrics(_packed(spark, sf_dir), BUDGET)


#: Wording of priorities and sections that the invented prose of the tables has.
WORDING = Wording(critical=("(?i) the of ", "(?i) to the "), required="(?i) de la | in the ", constraint="(?i) die der ", implementation="(?i) et la ", decision="(?i) la de ")


def _message_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Messages as units with metadata, typed edges, queries, and what each query's session has had."""
    messages = _table(spark, sf_dir, "conversations").withColumn("unit_id", conversations.message_name(F.col("conv_id"), F.col("turn")))
    edges = relations.superseded(messages.drop("unit_id")).filter("superseded_by is not null and turn % 5 = 0")
    edges = edges.select(
        F.lit("supersedes").alias("kind"),
        conversations.message_name(F.col("conv_id"), F.col("superseded_by")).alias("src_id"),
        conversations.message_name(F.col("conv_id"), F.col("turn")).alias("dst_id"),
        (F.col("turn") == 5).alias("heuristic"),
    )
    units = messages.select(
        "unit_id",
        F.lit("message").alias("source_type"),
        F.concat(F.lit("src"), "conv_id").alias("source_id"),
        F.concat(F.lit("logs/"), "role").alias("path"),
        "role",
        F.col("text").alias("content"),
        content_hash(F.col("text")).alias("content_hash"),
        token_count(F.col("text")).alias("cost"),
        F.when(F.col("turn") % 11 == 10, "superseded").alias("state"),
        F.when((F.col("conv_id") % 7 == 3) & (F.col("turn") == 1), "Required").alias("declared"),
        (F.col("role") == "system").alias("critical"),
        F.when(F.col("turn") % 13 == 5, "prior_work").alias("category"),
    )
    units = prioritised(units, edges.select(F.col("src_id").alias("unit_id"), "kind"), WORDING)
    broad = F.when(F.col("conv_id") % 100 == 0, " plan").otherwise("")
    queries = messages.filter("conv_id % 50 = 0 and turn = 0").select(F.col("conv_id").alias("query_id"), F.concat(F.array_join(F.slice(F.split("text", " "), 1, 3), " "), broad).alias("query"))
    had = messages.filter("(turn * 31 + conv_id) % 9 = 0").select(
        (F.col("conv_id") - F.col("conv_id") % 50).alias("query_id"),
        "unit_id",
        F.when(F.col("turn") % 2 == 0, content_hash(F.col("text"))).otherwise("old").alias("content_hash"),
        F.when(F.col("turn") % 4 == 2, "map").otherwise("pack").alias("level"),
    )
    return units, edges, queries, had


_UNIT = "'conversation:' || conv_id || '/message:' || turn"
_NORMAL = r"array_to_string(regexp_extract_all(replace(lower(regexp_replace({0}, '(?m)^[ \t]*>[ \t]?', '', 'g')), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+'), ' ')"
_MESSAGES = _search_sql(f"select {_UNIT} as unit_id, text as content from conversations", "select conv_id as query_id, array_to_string(string_split(text, ' ')[1:3], ' ') || case when conv_id % 100 = 0 then ' plan' else '' end as query from conversations where conv_id % 50 = 0 and turn = 0")
_SECTION_CASE = "case " + " ".join(f"when section = '{x}' then {packing.HEADING_TOKENS[x]}" for x in SECTIONS) + " end"
_PRIORITY = rf""", newer as (
      select {_UNIT} as dst_id, 'conversation:' || conv_id || '/message:' || lead(turn) over (partition by conv_id, role order by turn) as src_id, turn from conversations
    ), superseding as (select * from newer where src_id is not null and turn % 5 = 0),
    m as (
      select *, {_UNIT} as unit_id, {_UNIT} in (select src_id from superseding) as owner, contains(lower(text), ' the of ') and contains(lower(text), ' to the ') as boundary from conversations
    ), levelled as (
      select *, case when turn % 11 = 10 then ['informational', 'explicit_superseded_state'] when conv_id % 7 = 3 and turn = 1 then ['required', 'explicit_priority_metadata']
          when role = 'system' then ['critical', 'explicit_critical_metadata'] when boundary then ['critical', 'explicit_rule_text']
          when contains(lower(text), ' de la ') or contains(lower(text), ' in the ') then ['required', 'deterministic_mandatory_language'] else ['supporting', 'default_supporting_context'] end as p,
        case when boundary and turn % 11 <> 10 then (select count(*) filter (where boundary) from m) - 1 else 0 end as corroborated from m
    ), placed as (
      select *, p[1] as priority, p[2] as priority_reason, case when turn % 11 = 10 then ['SUPERSEDED / DO NOT USE', 'explicit_metadata']
          when p[1] in ('critical', 'required') then ['CRITICAL CURRENT CONSTRAINTS', 'deterministic_priority'] when turn % 13 = 5 then ['RELEVANT PRIOR WORK', 'explicit_metadata']
          when owner then ['CURRENT DECISIONS', 'explicit_relationship'] when contains(lower(text), ' die der ') then ['CRITICAL CURRENT CONSTRAINTS', 'deterministic_rule']
          when contains(lower(text), ' et la ') then ['CURRENT IMPLEMENTATION STATE', 'deterministic_rule'] when contains(lower(text), ' la de ') then ['CURRENT DECISIONS', 'deterministic_rule']
          else ['RELEVANT CONTEXT', 'source_default'] end as s from levelled
    ), meta as (
      select unit_id, text as content, sha256(text) as content_hash, cast({_TOKENS.format("text")} as bigint) as cost, priority, priority_reason, corroborated, s[1] as section, s[2] as section_rule,
        {_NORMAL.format("text")} as said from placed
    )"""
_FLOOR = "round(greatest(2.0, least(30.0, 0.65 * coalesce(max(case when lexical_only and not decided then score end) over (partition by query_id), 0))), 3)"
_ALIKE = """k.said <> '' and c.said <> '' and (contains(k.said, c.said) or contains(c.said, k.said) or (least(len(string_split(k.said, ' ')), len(string_split(c.said, ' '))) >= 8 and (
        len(list_intersect(k.w, c.w)) >= 0.7 * len(list_distinct(list_concat(k.w, c.w))) or (len(k.t) + len(c.t) > 0 and len(list_intersect(k.t, c.t)) >= 0.88 * len(list_distinct(list_concat(k.t, c.t)))))))"""
_SETS = """list_distinct(string_split(said, ' ')) as w,
        case when len(string_split(said, ' ')) > 2 then list_distinct(list_transform(range(1, len(string_split(said, ' ')) - 1), lambda i: array_to_string(string_split(said, ' ')[i : i + 2], ' '))) else [] end as t"""
#: Wording of decisions that the invented prose of the tables has.
DECISIONS = context.Signals(decision="(?i) in the | la de ", state="(?i) et la ", final="(?i) of the ", compact="(?i) to the ")
_BROAD = ", ".join(f"'{w}'" for w in context.PLANNING)
_CANDIDATES = rf""", limits as (select query_id, query, len(list_intersect({_WORDS.format("query")}, [{_BROAD}])) > 0 as broad from asked),
    lex as (select r.query_id, unit_id, score as words_score, terms > 0 as lexical, phrase from ranked r join limits using (query_id) where rank <= case when broad then greatest(30, (select count(*) from conversations)) else 30 end),
    deciding as (
      select {_UNIT} as unit_id, role, contains(lower(text), ' in the ') or contains(lower(text), ' la de ') as rules, contains(lower(text), ' et la ') as state, contains(lower(text), ' of the ') as last, contains(lower(text), ' to the ') as compact from conversations
    ), told as (select unit_id, last or state as final, 28 + case when last or state then 55 else 0 end as gain from deciding where (rules or state) and (role = 'user' or compact)),
    s1 as (
      select query_id, unit_id, round(coalesce(words_score, 0) + coalesce(gain, 0), 3) as raised, words_score is not null as lexical_only, coalesce(lexical, false) as lexical, coalesce(phrase, false) as phrase, gain is not null as decision, coalesce(final, false) as final
      from lex full join (select query_id, told.* from told cross join limits where broad) using (query_id, unit_id)
    ), s2 as (
      select s1.* from s1 join limits using (query_id) qualify row_number() over (partition by query_id order by raised desc, unit_id) <= case when any_value(broad) over (partition by query_id) then greatest(30, (select count(*) from conversations)) else 30 end
    ), keys as (select {_UNIT} as unit_id, 'src' || conv_id as source_id, 'logs/' || role as path from conversations),
    tgt as (select distinct query_id, unit_id, true as explicit from (select query_id, unnest(['src' || (query_id + 1), 'conversation:' || query_id || '/message:1', 'nowhere']) as target from asked) join keys on target in (unit_id, source_id, path)),
    s3 as (
      select query_id, unit_id, coalesce(raised, 0) + case when explicit then 100 else 0 end as seeded, coalesce(lexical_only, false) as lexical_only, coalesce(lexical, false) as lexical, coalesce(phrase, false) as phrase,
        coalesce(decision, false) as decision, coalesce(final, false) as final, coalesce(explicit, false) as explicit from s2 full join tgt using (query_id, unit_id)
    ), rel as (
      select src_id as owner, 0 as nth, 'supersedes' as kind, src_id as source, dst_id as target from superseding
      union all select {_UNIT}, 1, 'references', {_UNIT}, 'src' || (conv_id + 7) || '::part' from conversations where turn % 4 = 1
      union all select {_UNIT}, 2, 'related_to', 'src' || (conv_id + 3), {_UNIT} from conversations where turn % 6 = 2
      union all select {_UNIT}, 3, 'follows', {_UNIT}, 'conversation:' || conv_id || '/message:' || (turn + 1) from conversations
    ), latest as (select source_id, max(unit_id) as unit from keys group by 1),
    ends as (select distinct value, coalesce(k.unit_id, a.unit, b.unit) as unit from (select source as value from rel union select target from rel) left join keys k on k.unit_id = value left join latest a on a.source_id = value left join latest b on b.source_id = split_part(value, '::', 1)),
    linked as (select owner, nth, kind, a.unit as x, b.unit as y from rel join ends a on a.value = source join ends b on b.value = target where kind <> 'follows' and a.unit <> b.unit),
    ways as (select owner, nth, kind, x as seed, y as other from linked union all select owner, nth, kind, y, x from linked),
    hop as (
      select s3.query_id, other as unit_id, arg_min(kind, (owner, nth)) as kind from ways join s3 on s3.unit_id = seed left join s3 z on z.query_id = s3.query_id and z.unit_id = other where z.unit_id is null group by 1, 2
    ), every as (
      select query_id, unit_id, seeded, lexical_only, lexical, phrase, decision, final, explicit, cast(null as varchar) as kind from s3
      union all select query_id, h.unit_id, case kind when 'supersedes' then 55 else 5 end, false, false, false, false, false, false, kind from hop h join conversations on {_UNIT} = h.unit_id where trim(text) <> ''
    ), cand as (
      select e.query_id, e.unit_id, round(seeded, 3) as score, lexical_only, decision or final or explicit as decided,
        concat_ws(',', case when lexical then 'lexical_overlap' end, case when phrase then 'exact_phrase' end, case when decision then 'decision_context' end, case when final then 'final_state' end, case when explicit then 'explicit_target' end,
          case kind when 'supersedes' then 'final_state' when 'references' then 'related_unit' when 'related_to' then 'related_unit' end) as signals
      from every e join asked using (query_id) join conversations on {_UNIT} = e.unit_id where not (len(string_split_regex(trim(query), '\s+')) > 4 and contains(lower(text), trim(lower(query))))
    )"""
_COMPILE = (
    _MESSAGES
    + _PRIORITY
    + _CANDIDATES
    + rf""", had as (
      select conv_id - conv_id % 50 as query_id, {_UNIT} as unit_id, case when turn % 2 = 0 then sha256(text) else 'old' end as content_hash, case when turn % 4 = 2 then 'map' else 'pack' end as level
      from conversations where (turn * 31 + conv_id) % 9 = 0
    ), c0 as (
      select f.query_id, f.unit_id, f.score as raw, f.lexical_only, f.decided, f.signals, meta.*, h.unit_id is not null and h.content_hash = meta.content_hash and h.level = 'pack' as known, h.unit_id is not null and h.content_hash <> meta.content_hash as invalidated
      from cand f join meta using (unit_id) left join had h on h.query_id = f.query_id and h.unit_id = f.unit_id
    ), c1 as (
      select *, round(raw - case when known then 35 else 0 end - case when row_number() over (partition by query_id, content_hash order by raw desc, unit_id) > 1 then 18 else 0 end, 3) as score from c0
    ), c2 as (
      select c1.*, {_FLOOR} as floor, (select max(s.src_id) from superseding s join c1 x on x.unit_id = s.src_id where x.query_id = c1.query_id and s.dst_id = c1.unit_id and s.turn <> 5) as superseded_by,
        unit_id in (select src_id from superseding where turn <> 5) as owner from c1
    ), c as (
      select *, {_SECTION_CASE} as heading, {_SETS},
        case when superseded_by is not null then 'superseded' when lexical_only and not decided and not known and score < floor and not owner then 'below_floor'
          when said <> '' and len(string_split(said, ' ')) <= 3 and len(list_filter(string_split(said, ' '), lambda x: x not in ('ok', 'okay', 'thanks', 'thank', 'understood', 'noted', 'confirmed', 'yes', 'sure', 'great'))) = 0 then 'low_information'
          when known then 'referenced' end as rule,
        row_number() over (partition by query_id order by list_position(['critical', 'required', 'supporting', 'informational'], priority), -score, unit_id) as pos from c2
    ), seen as (
      select query_id, list({{'unit_id': unit_id, 'said': said, 'w': w, 't': t}} order by unit_id) as kept from (select distinct had.query_id, meta.unit_id, said, {_SETS} from had join meta using (unit_id, content_hash)) group by query_id
    ), walk as (
      select c.query_id, cast(0 as bigint) as pos, '' as unit_id, cast(0 as bigint) as used, cast([] as varchar[]) as sections,
        coalesce(any_value(seen.kept), cast([] as struct(unit_id varchar, said varchar, w varchar[], t varchar[])[])) as kept, '' as status, cast(null as varchar) as duplicate_of
      from c left join seen using (query_id) group by c.query_id
      union all
      select query_id, pos, unit_id, case when status = 'selected' then total else used end, case when status = 'selected' and not list_contains(sections, section) then list_append(sections, section) else sections end,
        case when status in ('selected', 'referenced') then list_append(kept, {{'unit_id': unit_id, 'said': said, 'w': w, 't': t}}) else kept end, status, duplicate_of
      from (
        select *, coalesce(rule, case when duplicate_of is not null then 'near_duplicate' end, case when total <= {BUDGET} then 'selected' else 'does_not_fit' end) as status
        from (
          select c.query_id, c.pos, c.unit_id, c.section, c.said, c.w, c.t, c.rule, p.used, p.sections, p.kept,
            p.used + c.cost + case when p.used = 0 then {packing.FRAME_TOKENS} else 0 end + case when list_contains(p.sections, c.section) then {packing.BETWEEN_TOKENS} else c.heading end as total,
            case when c.rule is null then list_filter(p.kept, lambda k: k.unit_id <> c.unit_id and {_ALIKE})[1].unit_id end as duplicate_of
          from walk p join c on c.query_id = p.query_id and c.pos = p.pos + 1
        )
      )
    ), packed as (
      select w.query_id, w.unit_id, w.status, w.duplicate_of, w.pos - 1 as place, c.score, c.floor, c.priority, c.section, c.cost, c.known, c.invalidated, c.superseded_by, c.content, c.content_hash, c.signals
      from walk w join c using (query_id, pos)
    )
    """
)


@registered(_MESSAGES + "select * from found")
def message_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, _, queries, _ = _message_parts(spark, sf_dir)
    return retrieval.search(units.select("unit_id", "content"), queries)


@registered(_MESSAGES + _PRIORITY + "select unit_id, priority, priority_reason, corroborated, section, section_rule from meta")
def context_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _message_parts(spark, sf_dir)[0].select("unit_id", "priority", "priority_reason", "corroborated", "section", "section_rule")


def _relations(spark: SparkSession, sf_dir: str, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations of messages, their ends by unit id or by source id, and what queries ask for by name."""
    messages = _table(spark, sf_dir, "conversations").withColumn("unit_id", conversations.message_name(F.col("conv_id"), F.col("turn")))
    source = lambda conv: F.concat(F.lit("src"), conv)
    null = F.lit(None).cast("string")
    after = conversations.message_name(F.col("conv_id"), F.col("turn") + 1)
    made = F.array(
        F.when(F.col("turn") % 4 == 1, F.struct(F.lit(1).alias("nth"), F.lit("references").alias("kind"), null.alias("source"), F.concat(source(F.col("conv_id") + 7), F.lit("::part")).alias("target"))),
        F.when(F.col("turn") % 6 == 2, F.struct(F.lit(2).alias("nth"), F.lit("related_to").alias("kind"), source(F.col("conv_id") + 3).alias("source"), F.col("unit_id").alias("target"))),
        F.struct(F.lit(3).alias("nth"), F.lit("follows").alias("kind"), null.alias("source"), after.alias("target")),
    )
    named = messages.select(F.col("unit_id").alias("owner"), F.explode(F.array_compact(made)).alias("r")).select("owner", "r.*")
    newer = edges.select(F.col("src_id").alias("owner"), F.lit(0).alias("nth"), "kind", null.alias("source"), F.col("dst_id").alias("target"))
    first = messages.filter("conv_id % 50 = 0 and turn = 0")
    targets = F.array(source(F.col("conv_id") + 1), conversations.message_name(F.col("conv_id"), F.lit(1)), F.lit("nowhere"))
    return newer.unionByName(named), first.select(F.col("conv_id").alias("query_id"), F.explode(targets).alias("target"))


def _compiled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Packs and units."""
    units, edges, queries, had = _message_parts(spark, sf_dir)
    units = stored(units, "units")
    named, targets = _relations(spark, sf_dir, edges)
    found = context.candidate_pairs(units, queries, named, targets, signals=DECISIONS)
    return packing.compile_pack(found, units, edges, had, BUDGET), units


@registered(_MESSAGES + _PRIORITY + _CANDIDATES + "select * from cand")
def pack_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, edges, queries, _ = _message_parts(spark, sf_dir)
    named, targets = _relations(spark, sf_dir, edges)
    return context.pack_candidates(stored(units, "units"), queries, named, targets, signals=DECISIONS)


@registered(_COMPILE + "select * exclude (content, content_hash) from packed")
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, _ = _compiled(spark, sf_dir)
    return packed.withColumn("signals", context.signal_names(F.col("made_of"))).drop("made_of")


@registered(
    _COMPILE
    + f"""select query_id, count(*) as candidate_units, cast(sum(cost) as bigint) as candidate_tokens, cast(coalesce(sum(cost) filter (where status = 'selected'), 0) as bigint) as selected_tokens,
      cast(coalesce(sum(cost) filter (where status = 'referenced'), 0) as bigint) as previously_supplied_tokens, cast(coalesce(sum(cost) filter (where invalidated), 0) as bigint) as invalidated_tokens,
      cast(coalesce(sum(cost) filter (where status = 'near_duplicate'), 0) as bigint) as duplicate_tokens, cast(coalesce(sum(cost) filter (where status = 'below_floor'), 0) as bigint) as low_relevance_tokens,
      cast(coalesce(sum(cost) filter (where status = 'low_information'), 0) as bigint) as low_information_tokens, cast(coalesce(sum(cost) filter (where status = 'superseded'), 0) as bigint) as superseded_tokens,
      round(coalesce(sum(cost) filter (where status = 'selected'), 0) / {BUDGET}, 4) as utilisation from packed group by query_id"""
)
def pack_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_metrics(_compiled(spark, sf_dir)[0], BUDGET)


@registered(
    _COMPILE
    + """select query_id, coalesce(list(unit_id order by place) filter (where status = 'selected'), []) as included, coalesce(list(unit_id order by place) filter (where status = 'referenced'), []) as referenced,
      coalesce(list(unit_id order by place) filter (where status not in ('selected', 'referenced')), []) as omitted from packed group by query_id"""
)
def pack_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_lists(_compiled(spark, sf_dir)[0])


@registered(_COMPILE + "select query_id, unit_id, content_hash, 'pack' as level, cost as token_count, priority from packed where status = 'selected'")
def pack_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.deliveries(*_compiled(spark, sf_dir))


@registered(
    _COMPILE
    + """select query_id, unit_id, section, m.section_rule, p.priority, m.priority_reason, m.corroborated + 1 as corroboration from packed p join (select unit_id, section_rule, priority_reason, corroborated from meta) m using (unit_id) where status = 'selected'"""
)
def pack_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, units = _compiled(spark, sf_dir)
    told = units.select("unit_id", "section_rule", "priority_reason", (F.col("corroborated") + 1).alias("corroboration"))
    return packed.filter("status = 'selected'").select("query_id", "unit_id", "section", "priority").join(told, "unit_id")


_ORDERED = ", ".join(f"'{x}'" for x in SECTIONS)


@registered(
    _COMPILE
    + rf""", sections as (
      select query_id, list_position([{_ORDERED}], section) as nth, section || chr(10) || string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by place) as block from packed where status = 'selected' group by query_id, section
      union all select distinct query_id, 9, 'CONTEXT DELTA' || chr(10) || '{NOTICE}' from packed where status = 'referenced' and priority in ('critical', 'required')
    ) select query_id, '{TITLE}' || chr(10) || chr(10) || '{DIRECTIVE}' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) order by nth) as context from sections group by query_id"""
)
def rendered_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, units = _compiled(spark, sf_dir)
    taken = packed.filter("status in ('selected', 'referenced')").join(units.select("unit_id", "content"), "unit_id")
    chosen = F.col("status") == "selected"
    notice = ~chosen & F.col("priority").isin("critical", "required")
    return rendered(taken.select("query_id", "section", "place", F.when(chosen, F.col("content")).alias("content"), notice.alias("notice")))


@registered(
    _search_sql("select doc_id as unit_id, text as content from documents", "select item_id as query_id, array_to_string(string_split(text, ' ')[1:2], ' ') as query from benchmark where item_id % 50 = 0")
    + rf""", c as (select query_id, unit_id, said, {_SETS} from (select query_id, unit_id, {_NORMAL.format("text")} as said from found join documents on doc_id = unit_id))
    select k.query_id, k.unit_id as a, c.unit_id as b from c k join c on k.query_id = c.query_id and k.unit_id < c.unit_id where {_ALIKE}"""
)
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"), F.col("text").alias("content"))
    items = _table(spark, sf_dir, "benchmark").filter(F.col("item_id") % 50 == 0)
    queries = items.select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("query"))
    return packing.near_duplicates(retrieval.search(units, queries).select("query_id", "unit_id"), units)


@registered("select b.item_id, d.doc_id from benchmark b join documents d on contains(d.text, b.text) where b.text <> ''")
def passage_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.contained(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents"))


@registered(
    """select doc_id, sha256(coalesce(text, '')) as content_hash, min(doc_id) over (partition by text) as first_id, count(*) over (partition by text) as n_copies
    from documents"""
)
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.copies(_table(spark, sf_dir, "documents"))


@registered(
    r"""select doc_id,
      case when regexp_matches(text, '(?i)licensed under|licen[sc]e') then 'licence'
           when regexp_matches(text, '(?i)(password|token|secret|api_?key)[^\n]{0,3}[=:]') then 'credential'
           when regexp_matches(text, '[#*$%&]{3}') then 'noise' when regexp_matches(text, '@[a-z0-9-]+\.') then 'contact' else 'evidence' end as category,
      case when regexp_matches(text, '(?i)licensed under|licen[sc]e') then 'required'
           when regexp_matches(text, '(?i)(password|token|secret|api_?key)[^\n]{0,3}[=:]') then 'critical'
           when regexp_matches(text, '[#*$%&]{3}') then 'informational' when regexp_matches(text, '@[a-z0-9-]+\.') then 'supporting' else 'informational' end as priority
    from documents"""
)
def classify_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.classified(_table(spark, sf_dir, "documents").select("doc_id", "text"), RULES).drop("text")


#: What the return flag of an order line stands for as a relation; one kind gives no signal.
_KINDS = {"A": "depends_on", "N": "related_to", "R": "follows"}


@registered(
    """
    with e as (select 'p' || l_partkey as owner, l_orderkey * 10 + l_linenumber as nth, case l_returnflag when 'A' then 'depends_on' when 'N' then 'related_to' else 'follows' end as kind,
                      'p' || l_partkey as s, 's' || l_suppkey as d from lineitem),
    seeds as (select 's' || s_suppkey as u from supplier where s_nationkey = 0),
    met as (select d as unit_id, owner, nth, kind from e where s in (select u from seeds) union all select s, owner, nth, kind from e where d in (select u from seeds)),
    f as (select unit_id, arg_min(kind, (owner, nth)) as kind from met where kind <> 'follows' and unit_id not in (select u from seeds) group by unit_id)
    select unit_id, kind, case kind when 'depends_on' then 'direct_import' else 'related_unit' end as signal, cast(case kind when 'depends_on' then 70 else 5 end as bigint) as weight from f"""
)
def relation_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])[F.col("l_returnflag")]
    part = F.concat(F.lit("p"), "l_partkey")
    edges = _table(spark, sf_dir, "lineitem").select(part.alias("owner"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("nth"), kind.alias("kind"), part.alias("src_id"), F.concat(F.lit("s"), "l_suppkey").alias("dst_id"))
    seeds = _table(spark, sf_dir, "supplier").filter("s_nationkey = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("unit_id"))
    return relations.one_hop(seeds, edges)


def _sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _table(spark, sf_dir, "conversations")
    name = conversations.message_name(F.col("conv_id"), F.col("turn"))
    return messages.select(name.alias("unit_id"), F.concat(F.lit("src"), "conv_id").alias("source_id"), F.concat(F.lit("logs/"), "role").alias("path"), F.col("turn").alias("nth"), "conv_id", "turn")


@registered(
    f"""
    with u as (select {_UNIT} as unit_id, 'src' || conv_id as source_id, turn from conversations), l as (select source_id, arg_max(unit_id, turn) as found from u group by source_id),
    v as (select distinct case when turn % 7 = 6 then 'none' || turn when turn % 3 = 0 then {_UNIT} when turn % 3 = 1 then 'src' || conv_id else 'src' || conv_id || '::' || turn end as value from conversations)
    select value, coalesce(u.unit_id, a.found, b.found) as unit_id from v left join u on u.unit_id = value left join l a on a.source_id = value left join l b on b.source_id = split_part(value, '::', 1)"""
)
def endpoint_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, turn = _sourced(spark, sf_dir), F.col("turn")
    value = F.when(turn % 7 == 6, F.concat(F.lit("none"), "turn")).when(turn % 3 == 0, F.col("unit_id")).when(turn % 3 == 1, F.col("source_id")).otherwise(F.concat("source_id", F.lit("::"), "turn"))
    return relations.resolved(units.select(value.alias("value")), units)


@registered(
    f"""
    with t as (select conv_id as query_id, unnest(['src' || (conv_id + 1), 'conversation:' || conv_id || '/message:1', 'logs/system']) as target from conversations where conv_id % 50 = 0 and turn = 0),
    u as (select {_UNIT} as unit_id, 'src' || conv_id as source_id, 'logs/' || role as path from conversations)
    select distinct query_id, unit_id, cast(100 as bigint) as weight from t join u on target in (unit_id, source_id, path)"""
)
def explicit_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _sourced(spark, sf_dir)
    first = units.filter("conv_id % 50 = 0 and turn = 0")
    named = F.array(F.concat(F.lit("src"), F.col("conv_id") + 1), F.concat(conversations.conversation_name(F.col("conv_id")), F.lit("/message:1")), F.lit("logs/system"))
    return relations.explicit_targets(first.select(F.col("conv_id").alias("query_id"), F.explode(named).alias("target")), units)


@registered("select conv_id, turn, role, lead(turn) over (partition by conv_id, role order by turn) as superseded_by from conversations")
def supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.superseded(_table(spark, sf_dir, "conversations"))


@registered(
    """
    with d as (select event_id, user_id, event_type, md5(props) as h, lag(md5(props)) over (partition by user_id, event_type order by ts, event_id) as before from events)
    select event_id as seq, user_id as session_id, event_type as unit_id, case when before is null then 'new' when before = h then 'already_supplied' else 'changed' end as status from d"""
)
def session_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("unit_id"), F.md5(F.col("props").cast("binary")).alias("content_hash"), F.col("ts").alias("delivered_at"), F.col("event_id").alias("seq"))
    return packing.session_delta(rows).select("seq", "session_id", "unit_id", "status")


@registered("select event_id as seq, user_id as session_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 20")
def session_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _traces(spark, sf_dir).select("seq", "session_id", F.col("ts").alias("delivered_at"))
    return packing.bounded_history(rows, 20).select("seq", "session_id")


@registered(
    """
    with a as (select doc_id, sha256(text) as h from documents where lang <> 'es'),
    b as (select doc_id, sha256(case when lang = 'fr' then upper(text) else text end) as h from documents where lang <> 'de')
    select doc_id, case when a.h is null then 'added' when b.h is null then 'deleted' when a.h = b.h then 'unchanged' else 'changed' end as change
    from a full join b using (doc_id)"""
)
def unit_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    current = docs.filter("lang <> 'es'").select("doc_id", content_hash(F.col("text")).alias("content_hash"))
    text = F.when(F.col("lang") == "fr", F.upper("text")).otherwise(F.col("text"))
    incoming = docs.filter("lang <> 'de'").select("doc_id", content_hash(text).alias("content_hash"))
    return packing.change_classes(current, incoming, "doc_id")


@registered(
    """
    with c as (select distinct l_orderkey as o, p_brand as f from lineitem join part on p_partkey = l_partkey)
    select x.f as a, y.f as b, count(*) as times from c x join c y on x.o = y.o and x.f < y.f group by 1, 2 having count(*) >= 2"""
)
def cochange_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    return relations.cochanges(files.select(F.col("l_orderkey").alias("commit"), F.col("p_brand").alias("file")))


@registered(
    """
    with recursive e as (select distinct 'p' || l_partkey as s, 's' || l_suppkey as d from lineitem), both_ways as (select s, d from e union select d, s from e),
    walk as (
      select 's' || s_suppkey as node, 0 as distance from supplier where s_nationkey = 0
      union select b.d, w.distance + 1 from walk w join both_ways b on b.s = w.node where w.distance < 3
    ) select node, cast(min(distance) as bigint) as distance from walk group by node"""
)
def bfs_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _table(spark, sf_dir, "lineitem")
    edges = line.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    seeds = _table(spark, sf_dir, "supplier").filter("s_nationkey = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return relations.distances(edges, seeds, 3)


@registered(
    r"""
    with p as (select page_id, regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '^[a-z]+://', '') as path from pages),
    named as (select page_id, path, regexp_extract(path, '[^/]*$', 0) as name from p), wanted as (select page_id as owner, replace(name, '.html', '') as path from named),
    files as (select replace(name, '.html', '') as path, page_id as file from named)
    select owner, case when count(file) = 1 then min(file) end as target, count(file) as n from wanted left join files using (path) group by owner"""
)
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.regexp_extract(_page_path(F.col("url")), "[^/]*$", 0)
    pages = _table(spark, sf_dir, "pages").select("page_id", F.replace(name, F.lit(".html"), F.lit("")).alias("path"))
    return relations.unique_targets(pages.select(F.col("page_id").alias("owner"), "path"), pages.select("path", F.col("page_id").alias("file")))


def _page_path(url):
    return F.regexp_replace(F.regexp_extract(url, r"^[^?#]*", 0), r"^[a-z]+://", "")


@registered(
    r"""
    with p as (select string_split(regexp_replace(regexp_extract(url, '^[^?#]*', 0), '^[a-z]+://', ''), '/') as parts from pages),
    f as (select unnest(list_transform(range(1, len(parts)), lambda i: array_to_string(parts[1:i], '/'))) as folder from p)
    select folder, count(*) as n from f group by folder"""
)
def path_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.path_tree(_table(spark, sf_dir, "pages").select(_page_path(F.col("url")).alias("path")))


@registered(
    r"""select page_id, case when octet_length(encode(html)) > 20000 then 'too_large' when contains(html, '<script') and contains(lower(url), 'ads-track') then 'tracker'
      when regexp_matches(url, '\.html$') then 'page' else 'other' end as policy from pages"""
)
def page_policy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    html, url = F.col("html"), F.col("url")
    policy = F.when(F.octet_length(html) > 20000, "too_large").when(F.contains(html, F.lit("<script")) & F.contains(F.lower(url), F.lit("ads-track")), "tracker").when(url.rlike(r"\.html$"), "page").otherwise("other")
    return _table(spark, sf_dir, "pages").select("page_id", policy.alias("policy"))


@registered(
    """select event_type as operation, count(*) as n, count(distinct user_id) as users, round(sum(value), 2) as total_latency, round(avg(value), 6) as mean_latency,
      count(*) - count(value) as unknown from events group by event_type"""
)
def trace_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.overview(_traces(spark, sf_dir))


@registered("select event_type as operation, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, count(value) as n, count(*) - count(value) as missing from events group by 1")
def stage_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.percentiles(_traces(spark, sf_dir))


@registered(
    f"""
    with a as (select event_type, (epoch_us(timestamp '{END}') - epoch_us(ts)) / 86400000000.0 as age from events),
    c as (select event_type as operation, count(*) filter (where age >= 0 and age < {DAYS}) as current, count(*) filter (where age >= {DAYS} and age < {2 * DAYS}) as previous from a group by 1)
    select *, cast(case when previous > 0 then floor((current - previous) * 100.0 / previous + 0.5) end as bigint) as change from c"""
)
def period_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.period_change(_traces(spark, sf_dir), END, DAYS).withColumn("change", F.col("change").cast("long"))


@registered(
    f"""
    with b as (select cast(least(29, greatest(0, floor((epoch_us(ts) - epoch_us(timestamp '{START}')) * 30.0 / (epoch_us(timestamp '{END}') - epoch_us(timestamp '{START}'))))) as bigint) as bar from events),
    c as (select bar, count(*) as n from b group by bar)
    select r.range as bar, coalesce(n, 0) as n from range(30) r left join c on c.bar = r.range"""
)
def activity_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.activity_bars(_traces(spark, sf_dir), START, END)


@registered(
    """
    with s as (select user_id, event_type, ts, event_id, case when event_type is distinct from lag(event_type) over w then 1 else 0 end as start
               from events window w as (partition by user_id order by ts, event_id)),
    r as (select *, sum(start) over (partition by user_id order by ts, event_id) as run from s)
    select user_id as session_id, event_type as operation, count(*) as length, min(event_id) as first_seq from r group by user_id, run, event_type having count(*) >= 3"""
)
def call_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.repeated_calls(_traces(spark, sf_dir))


@registered("select user_id as session_id, event_type as file, min(event_id) as first_seq, count(*) - 1 as repeats from events group by 1, 2")
def first_read_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.first_reads(_traces(spark, sf_dir).withColumnRenamed("operation", "file"))


@registered(
    """
    with d as (select distinct l_orderkey as owner, cast(l_linenumber as bigint) as line from lineitem where l_returnflag <> 'R'),
    g as (select owner, line, line - row_number() over (partition by owner order by line) as island from d)
    select owner, min(line) as low, max(line) as high from g group by owner, island"""
)
def range_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'")
    return metrics.islands(lines.select(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").cast("long").alias("line")))


@registered(
    """
    with e as (select *, min(case when event_type = 'click' then epoch_us(ts) end) over (partition by user_id order by ts, event_id rows between 1 following and unbounded following) as nxt from events)
    select user_id as session_id, event_id as seq, round((nxt - epoch_us(ts)) / 1000000.0, 3) as wait from e where event_type = 'view'"""
)
def wait_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.wait_spans(_traces(spark, sf_dir), "view", "click")


@registered(
    """
    with m as (select o_custkey as task, avg(o_totalprice) filter (where o_orderstatus = 'F') as c, avg(o_totalprice) filter (where o_orderstatus = 'O') as t from orders group by 1)
    select task, round(c, 6) as control, round(t, 6) as treatment, round(t - c, 6) as difference from m where c is not null and t is not null"""
)
def paired_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderstatus").alias("mode"), F.col("o_totalprice").alias("seconds"))
    return metrics.matched_pairs(runs, "F", "O")


@registered(
    """
    with h as (select distinct d.doc_id from benchmark b join documents d on contains(d.text, b.text)),
    f as (select l.doc_id, h.doc_id is not null as retrieved, l.quality = 1 as delivered, l.toxic = 0 as answered from labels l left join h using (doc_id))
    select case when not retrieved then 'retrieval' when not delivered then 'delivery' when not answered then 'answer' else 'none' end as lost_at, count(*) as n from f group by 1"""
)
def utilisation_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = passage_containment(spark, sf_dir).select("doc_id").distinct().withColumn("retrieved", F.lit(True))
    facts = _table(spark, sf_dir, "labels").join(hit, "doc_id", "left")
    flags = facts.select(F.coalesce("retrieved", F.lit(False)).alias("retrieved"), (F.col("quality") == 1).alias("delivered"), (F.col("toxic") == 0).alias("answered"))
    return grading.funnel(flags)


@registered(
    rf"""
    with u as (select conv_id, role as model, sum({_TOKENS.format("text")}) as input_tokens, 0 as cached_tokens, count(*) as output_tokens from conversations group by 1, 2)
    select conv_id, model, cast(input_tokens as bigint) as input_tokens, cast(cached_tokens as bigint) as cached_tokens, output_tokens,
      round(case model when 'user' then (input_tokens * 3.0 + output_tokens * 15.0) / 1e6 when 'assistant' then (input_tokens * 1.0 + output_tokens * 5.0) / 1e6 end, 6) as cost from u"""
)
def estimate_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = _table(spark, sf_dir, "conversations").groupBy("conv_id", F.col("role").alias("model"))
    usage = usage.agg(F.sum(token_count(F.col("text"))).alias("input_tokens"), F.lit(0).cast("long").alias("cached_tokens"), F.count(F.lit(1)).alias("output_tokens"))
    pricing = spark.createDataFrame([("user", 3.0, 0.3, 15.0), ("assistant", 1.0, 0.1, 5.0)], "model string, input_rate double, cached_rate double, output_rate double")
    return metrics.estimated_cost(usage, pricing)


@registered("select date_trunc('day', ts) as window_start, event_type, count(*) as n, round(avg(value), 6) as mean_value from events group by 1, 2 having date_trunc('day', ts) + interval 1 day <= (select max(ts) from events) - interval 10 minutes")
def trace_windows_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run_once(jobs.trace_windows(jobs.event_stream(spark, sf_dir)), "append", "windows")


@registered(
    """
    with s as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as start from events),
    r as (select user_id, ts, sum(start) over (partition by user_id order by ts) as run from s)
    select user_id, min(ts) as session_start, count(*) as n from r group by user_id, run having max(ts) + interval 6 hours <= (select max(ts) from events) - interval 10 minutes"""
)
def session_windows_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run_once(jobs.session_windows(jobs.event_stream(spark, sf_dir)), "append", "sessions")


@registered(
    """
    with recursive e as (select event_id, user_id, event_type, epoch_us(ts) as us, row_number() over (partition by user_id, event_type order by ts, event_id) as r from events),
    walk as (
      select event_id, user_id, event_type, r, us as held, true as kept from e where r = 1
      union all select e.event_id, e.user_id, e.event_type, e.r, case when e.us - w.held >= 300000000 then e.us else w.held end, e.us - w.held >= 300000000
      from walk w join e on e.user_id = w.user_id and e.event_type = w.event_type and e.r = w.r + 1
    ) select event_id, user_id, event_type from walk where kept"""
)
def repeat_ttl_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run_once(jobs.first_requests(jobs.event_stream(spark, sf_dir)), "append", "repeats")


@registered(
    """
    select b.user_id as session_id, b.event_id as begun, f.event_id as finished, round((epoch_us(f.ts) - epoch_us(b.ts)) / 1000000.0, 3) as wait
    from events b join events f on b.user_id = f.user_id and f.ts > b.ts and f.ts <= b.ts + interval 1 hour where b.event_type = 'view' and f.event_type = 'click'"""
)
def wait_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run_once(jobs.stream_waits(jobs.event_stream(spark, sf_dir), "view", "click"), "append", "waits")


_EDGES = "e as (select distinct 'p' || l_partkey as src, 's' || l_suppkey as dst from lineitem), seeds as (select 's' || s_suppkey as node from supplier where s_nationkey = 0)"
_NEAR = f"""
    with {_EDGES},
    m1 as (select dst as node, 'dependency' as reason from e where src in (select node from seeds) union all select src, 'consumer' from e where dst in (select node from seeds)),
    l1 as (select node, max(reason) as reason from m1 where node not in (select node from seeds) group by node),
    m2 as (select dst as node, 'dependency' as reason from e where src in (select node from l1) union all select src, 'consumer' from e where dst in (select node from l1)),
    l2 as (select node, max(reason) as reason from m2 where node not in (select node from seeds) and node not in (select node from l1) group by node),
    near as (select node, 0 as depth, 'explicit' as reason from seeds union all select node, 1, reason from l1 union all select node, 2, reason from l2)
    """


def _parts_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    line = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    return line, _table(spark, sf_dir, "supplier").filter("s_nationkey = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))


@registered(_NEAR + "select node, cast(depth as bigint) as depth, reason from near")
def neighborhood_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighborhood(*_parts_graph(spark, sf_dir), 2)


_TYPED = """
    with recursive line as (
      select distinct case when l_returnflag = 'R' and l_linestatus = 'F' and l_linenumber = 1 then 'related_test' when l_returnflag = 'R' then 'cochanged' when l_returnflag = 'A' then 'imports' else 'references_symbol' end as kind,
        l_partkey, l_suppkey, l_linenumber % 2 as way from lineitem
    ), ends as (
      select kind, p_type || '/' || p_brand || '/p' || p_partkey as p, 'suppliers/' || s_nationkey || '/s' || s_suppkey as s, way
      from line join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey
    ), e as (select distinct kind, case when way = 0 then p else s end as src, case when way = 0 then s else p end as dst from ends),
    files as (
      select p_type || '/' || p_brand || '/p' || p_partkey as node, p_type || '/' || p_brand as folder, p_name as content_hash from part
      union all select 'suppliers/' || s_nationkey || '/s' || s_suppkey, 'suppliers/' || s_nationkey, s_name from supplier
    ), targets as (select node from files where folder = 'suppliers/0' or node in (select p_type || '/' || p_brand || '/p' || p_partkey from part where p_partkey % 97 = 5)),
    changed as (select p_type || '/' || p_brand || '/p' || p_partkey as node, case when p_size % 2 = 0 then 'branch' else 'working' end as scope from part where p_size % 10 < 2)
    """


def _typed_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Files, typed edges, targets and changed files from parts, suppliers and order lines."""
    part, supplier = _table(spark, sf_dir, "part"), _table(spark, sf_dir, "supplier")
    part = part.withColumn("folder", F.concat("p_type", F.lit("/"), "p_brand")).withColumn("node", F.concat("folder", F.lit("/p"), "p_partkey"))
    supplier = supplier.withColumn("folder", F.concat(F.lit("suppliers/"), "s_nationkey")).withColumn("node", F.concat("folder", F.lit("/s"), "s_suppkey"))
    files = part.select("node", "folder", F.col("p_name").alias("content_hash")).unionByName(supplier.select("node", "folder", F.col("s_name").alias("content_hash")))
    flag = F.col("l_returnflag")
    kind = F.when((flag == "R") & (F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1), "related_test").when(flag == "R", "cochanged").when(flag == "A", "imports").otherwise("references_symbol")
    line = _table(spark, sf_dir, "lineitem").select(kind.alias("kind"), "l_partkey", "l_suppkey", (F.col("l_linenumber") % 2).alias("way"))
    ends = line.join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("node").alias("p")), "l_partkey").join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("node").alias("s")), "l_suppkey")
    edges = ends.select("kind", F.when(F.col("way") == 0, F.col("p")).otherwise(F.col("s")).alias("src"), F.when(F.col("way") == 0, F.col("s")).otherwise(F.col("p")).alias("dst"))
    targets = supplier.filter("s_nationkey = 0").select("node").unionByName(part.filter("p_partkey % 97 = 5").select("node"))
    changed = part.filter("p_size % 10 < 2").select("node", F.when(F.col("p_size") % 2 == 0, "branch").otherwise("working").alias("scope"))
    return files, stored(edges, "typed-edges"), targets, changed


@registered(
    _TYPED
    + """, both_ways as (select src, dst from e union select dst, src from e),
    walk as (select node, 0 as distance from targets union select b.dst, w.distance + 1 from walk w join both_ways b on b.src = w.node where w.distance < 2),
    near as (select node, min(distance) as distance from walk group by node),
    tested as (select distinct dst as node from e where kind = 'related_test'),
    steps as (select folder, unnest(list_distinct(string_split(folder, '/'))) as part from (select distinct folder from files)),
    close as (select folder, least(3, max(n)) as n from (select a.folder, b.folder as other, count(*) as n from steps a join steps b using (part) where b.folder in (select folder from files where node in (select node from targets)) group by 1, 2) group by 1),
    signals as (
      select node, 'explicit' as signal, 100 as w from targets
      union all select distinct dst, 'referenced_symbol', 75 from e where kind = 'references_symbol' and src in (select node from targets)
      union all select distinct dst, 'direct_import', 70 from e where kind = 'imports' and src in (select node from targets)
      union all select distinct src, 'consumer', 65 from e where kind in ('imports', 'references_symbol') and dst in (select node from targets) and src not in (select node from tested)
      union all select node, 'related_test', 60 from tested
      union all select distinct dst, 'cochanged', 30 from e where kind = 'cochanged'
      union all select node, case when scope = 'branch' then 'branch_modified' else 'working_modified' end, case when scope = 'branch' then 40 else 20 end from changed
      union all select node, 'same_module', 20 from files where folder in (select folder from files where node in (select node from targets))
      union all select node, 'path_proximity', 5 * n from files join close using (folder)
      union all select node, 'graph_distance', -10 * distance from near where distance > 0
      union all select node, 'duplicate_content', -18 from (select node, row_number() over (partition by content_hash order by node) as r from files) where r > 1
    ) select node, cast(sum(w) as bigint) as score, string_agg(signal || '=' || w, ';' order by signal || '=' || w) as evidence from signals group by node"""
)
def structural_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, edges, targets, changed = _typed_graph(spark, sf_dir)
    return graph.structural_score(files, edges, targets, changed, relations.distances(edges, targets, 2))


@registered(
    _TYPED
    + """, t as (
      select node, 0 as tier from targets union all select dst, 1 from e where kind = 'references_symbol' and src in (select node from targets)
      union all select dst, 2 from e where kind = 'imports' and src in (select node from targets)
      union all select src, 3 from e where kind in ('imports', 'references_symbol') and dst in (select node from targets)
      union all select dst, 4 from e where kind = 'related_test' and src in (select node from targets) union all select node, 5 from changed
      union all select dst, 6 from e where kind = 'cochanged' and src in (select node from targets)
      union all select node, 7 from files where folder in (select folder from files where node in (select node from targets))
    ) select node, cast(min(tier) as bigint) as tier from t group by node"""
)
def structural_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, edges, targets, changed = _typed_graph(spark, sf_dir)
    return graph.tiers(edges, targets, changed, files)


#: Page graph: a page's heading words are its symbols, its links modules, its link texts names.
_PAGES = r"""
    with p as (select page_id, regexp_replace(regexp_extract(url, '^[^?#]*', 0), '^[a-z]+://', '') as path, html from pages),
    files as (select distinct path as file, regexp_replace(path, '/[^/]*$', '') as folder from p),
    declared as (select distinct path as file, unnest(list_distinct(regexp_extract_all(lower(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), '[a-z]{6,}'))) as symbol from p),
    links as (select distinct path as file, unnest(regexp_extract_all(html, '<a href="/([^"]*)">', 1)) as module from p),
    wanted as (select file, module, unnest([regexp_replace(file, '/.*$', '') || '/' || module, module]) as path from links),
    mentioned as (select distinct path as file, unnest(regexp_extract_all(lower(html), '[a-z]{6,}')) as name from p),
    resolved as (select w.file, w.module, count(distinct f.file) as n, min(f.file) as target from wanted w left join files f on f.file = w.path group by 1, 2),
    single as (select symbol, min(file) as home from declared group by symbol having count(*) = 1),
    g as (
      select 'contains' as kind, folder as src, file as dst from files union all select 'defines', file, file || '::' || symbol from declared
      union all select distinct case when n = 1 then 'imports' else 'imports_external' end, file, case when n = 1 then target else 'module:' || module end from resolved
      union all select 'references_symbol', m.file, home || '::' || name from mentioned m join single s on s.symbol = m.name where home <> m.file
    )
    """


def _page_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    pages = _table(spark, sf_dir, "pages").select(_page_path(F.col("url")).alias("file"), "html")
    files = pages.select("file", F.regexp_replace("file", "/[^/]*$", "").alias("folder")).distinct()
    heading = F.lower(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1))
    declared = pages.select("file", F.explode(F.array_distinct(F.regexp_extract_all(heading, F.lit("[a-z]{6,}"), F.lit(0)))).alias("symbol")).distinct()
    links = pages.select("file", F.explode(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)">'), F.lit(1))).alias("module")).distinct()
    wanted = links.select("file", "module", F.explode(F.array(F.concat(F.regexp_replace("file", "/.*$", ""), F.lit("/"), "module"), "module")).alias("path"))
    mentioned = pages.select("file", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("html"), F.lit("[a-z]{6,}"), F.lit(0)))).alias("name"))
    return files, declared, wanted, mentioned


@registered(_PAGES + "select * from g")
def code_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build_graph(*_page_tables(spark, sf_dir))


@registered(_PAGES + "select kind, count(*) as n, count(distinct src) as sources, count(distinct dst) as targets from g group by kind")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_graph(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


@registered(
    _PAGES
    + r""", n as (select distinct node from (select src as node from g union all select dst from g)), shown as (select node from n order by node limit 200),
    inner_edges as (select kind, src, dst from g where src in (select node from shown) and dst in (select node from shown))
    select *, (select count(*) from n) > 200 as truncated from (select * from inner_edges order by kind, src, dst limit 400)"""
)
def graph_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.preview(stored(code_graph(spark, sf_dir), "code-graph"))


@registered(
    _NEAR
    + """select count(*) as files, count(*) filter (where depth = 1 and reason = 'consumer') as direct_consumers, cast(coalesce(sum(t.tokens), 0) as bigint) as source_tokens,
      (select count(*) from (select distinct 's' || l_suppkey as file, l_returnflag as symbol from lineitem) where file in (select node from near)) as symbols
    from near left join (select 'p' || p_partkey as node, p_size as tokens from part) t using (node)"""
)
def inspect_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node"), F.col("p_size").cast("long").alias("tokens"))
    declared = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("file"), F.col("l_returnflag").alias("symbol")).distinct()
    return graph.manifest(neighborhood_2(spark, sf_dir), files, declared)


@registered(
    """
    with e as (select distinct 'p' || l_partkey as src, 's' || l_suppkey as dst from lineitem)
    select src, dst, greatest(count(*) over (partition by src) - 8, 0) as omitted from e qualify row_number() over (partition by src order by dst) <= 8"""
)
def visible_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.capped_edges(_parts_graph(spark, sf_dir)[0].distinct(), 8)


@registered(
    r"""
    with p as (select regexp_replace(regexp_extract(url, '^[^?#]*', 0), '^[a-z]+://', '') as path from pages),
    f as (select path, regexp_replace(path, '/[^/]*$', '') as folder, row_number() over (partition by regexp_replace(path, '/[^/]*$', '') order by path) as place from p)
    select path, folder, place from f where place <= 8"""
)
def nearby_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nearby(_table(spark, sf_dir, "pages").select(_page_path(F.col("url")).alias("path")))


@registered("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P' or o_orderpriority like '1%')")
def planned_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = _table(spark, sf_dir, "customer").select("c_custkey")
    return graph.without_match(planned, _table(spark, sf_dir, "orders").filter("o_orderstatus = 'P' or o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@registered(
    """
    with e as (select *, last_value(case when event_type = 'click' then value end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as known from events)
    select user_id as session_id, event_id as seq, known from e where event_type = 'view'"""
)
def ledger_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latest_before(_traces(spark, sf_dir), "view", "click")


@registered(
    """
    with e as (select *, max(case when event_type = 'purchase' then {'a': ts, 'b': event_id} end) over (partition by user_id) as last from events)
    select user_id as session_id, event_id as seq from e where last is null or (ts, event_id) > (last.a, last.b)"""
)
def after_last_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.after_last(_traces(spark, sf_dir), "purchase")


def _order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderstatus").alias("mode"), F.col("o_totalprice").alias("seconds"))


@registered(
    """
    with c as (select o_custkey as task, nullif(count(*) filter (where o_orderstatus = 'F'), 0) as F, nullif(count(*) filter (where o_orderstatus = 'O'), 0) as O,
      nullif(count(*) filter (where o_orderstatus = 'P'), 0) as P from orders group by 1)
    select *, O - F as difference from c"""
)
def mode_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mode_comparison(_order_runs(spark, sf_dir), ["F", "O", "P"])


@registered(
    """
    with m as (select o_custkey as task, avg(o_totalprice) filter (where o_orderstatus = 'F') as c, avg(o_totalprice) filter (where o_orderstatus = 'O') as t from orders group by 1)
    select task, case when abs(round(t - c, 6)) <= 10000 then 'similar' when t < c then 'lower' else 'higher' end as outcome from m where c is not null and t is not null"""
)
def discovery_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.similar_pairs(paired_compare(spark, sf_dir), 10_000.0)


@registered("select o_orderstatus as mode, count(*) as runs, count(o_totalprice) as known, round(avg(o_totalprice), 4) as mean, min(o_totalprice) as least, max(o_totalprice) as most from orders group by 1")
def suite_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.suite_aggregates(_order_runs(spark, sf_dir))


@registered(
    r"""select page_id, len(regexp_extract_all(html, '<a [^>]*href="[^"]*"')) as links, regexp_extract(html, '<h1>(.*?)</h1>', 1) as heading,
      len(regexp_extract_all(html, '<script')) as scripts from pages"""
)
def page_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return _table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_count(html, F.lit('<a [^>]*href="[^"]*"')).cast("long").alias("links"),
        F.regexp_extract(html, "<h1>(.*?)</h1>", 1).alias("heading"),
        F.regexp_count(html, F.lit("<script")).cast("long").alias("scripts"),
    )


@registered(
    rf"""select conv_id, role, count(*) as messages, cast(sum(octet_length(encode(text))) as bigint) as bytes, cast(sum({_TOKENS.format("text")}) as bigint) as tokens from conversations group by 1, 2"""
)
def payload_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "conversations").groupBy("conv_id", "role")
    return own.agg(F.count(F.lit(1)).alias("messages"), F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.sum(token_count(F.col("text"))).alias("tokens"))


@registered(
    """
    with a as (select doc_id, source, sha256(text) as h, sha256(case when lang = 'fr' then upper(text) else text end) as n from documents)
    select source, count(*) as delivered, count(*) filter (where h <> n) as invalidated from a group by source"""
)
def invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.when(F.col("lang") == "fr", F.upper("text")).otherwise(F.col("text"))
    hashes = _table(spark, sf_dir, "documents").select("source", content_hash(F.col("text")).alias("old"), content_hash(now).alias("new"))
    return hashes.groupBy("source").agg(F.count(F.lit(1)).alias("delivered"), F.count_if(F.col("old") != F.col("new")).alias("invalidated"))


@registered(
    """
    with d as (select event_id, user_id, event_type, row_number() over (partition by user_id, event_type, md5(props) order by ts, event_id) as nth, row_number() over (partition by user_id, event_type order by ts, event_id) as unit_nth from events)
    select event_id as seq, user_id as session_id, event_type as unit_id, case when nth > 1 then 'already_supplied' when unit_nth > 1 then 'invalidated' else 'new' end as status from d"""
)
def ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run_once(jobs.session_ledger(jobs.event_stream(spark, sf_dir)), "append", "ledger")


@registered(
    """
    with s as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as step, try_cast(json_extract_string(props, '$.k') as bigint) as k from events)
    select * from s where k is not null"""
)
def event_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.parsed_events(_table(spark, sf_dir, "events"))


@registered(
    r"""
    with l as (select conv_id, turn, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from conversations)
    select conv_id, turn, cast(line_no as integer) as line_no, line,
      last_value(case when ends_with(line, '.') and len(string_split(line, ' ')) <= 3 then line end ignore nulls) over (partition by conv_id, turn order by line_no rows between unbounded preceding and current row) as section
    from l"""
)
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.sections(_table(spark, sf_dir, "conversations"))


@registered(
    """
    with a as (select distinct l_orderkey as owner, cast(l_linenumber as bigint) as line from lineitem),
    d as (select owner, line from a where (owner, line) not in (select l_orderkey, l_linenumber from lineitem where l_linestatus = 'F')),
    g as (select owner, line, line - row_number() over (partition by owner order by line) as island from d)
    select owner, min(line) as low, max(line) as high from g group by owner, island"""
)
def range_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").cast("long").alias("line"), "l_linestatus")
    return metrics.remaining_ranges(lines.select("owner", "line").distinct(), lines.filter("l_linestatus = 'F'").select("owner", "line"))


@registered(
    r"""
    with p as (select page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host, regexp_extract(url, '^[a-z]+://[^/?#]*(/[^/?#]*)', 1) as folder from pages),
    k as (select *, regexp_replace(host, '^(www|m|blog)\.', '') as base, regexp_matches(host, '^(www|m|blog)\.') as test from p),
    t as (select left(base, 4) as stem, folder, count(*) as n, min(page_id) as twin_id from k where test group by 1, 2)
    select page_id as source_id, twin_id from k join t on t.folder = k.folder and t.stem = left(k.base, 4) where not test"""
)
def source_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, prefix = F.col("url"), r"^(www|m|blog)\."
    pages = _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1).alias("host"), F.regexp_extract(url, r"^[a-z]+://[^/?#]*(/[^/?#]*)", 1).alias("folder"))
    named = pages.select("page_id", "folder", F.left(F.regexp_replace("host", prefix, ""), F.lit(4)).alias("stem"), F.col("host").rlike(prefix).alias("test"))
    return graph.twins(named)


@registered(
    rf"""
    select conv_id, cast(sum({_TOKENS.format("text")}) as bigint) as full_tokens, cast(coalesce(sum({_TOKENS.format("text")}) filter (where role = 'assistant'), 0) as bigint) as selected_tokens,
      cast(sum({_TOKENS.format("text")}) - coalesce(sum({_TOKENS.format("text")}) filter (where role = 'assistant'), 0) as bigint) as saved
    from conversations group by conv_id"""
)
def token_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "conversations").select("conv_id", token_count(F.col("text")).alias("tokens"), (F.col("role") == "assistant").alias("selected"))
    return metrics.token_savings(own)


@registered("select event_id as seq, user_id as session_id from events order by ts desc, event_id desc limit 100 offset 100")
def trace_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.newest(_traces(spark, sf_dir).select("seq", "session_id", "ts"), 100, 100).select("seq", "session_id")


@registered(
    """
    with r as (select o_custkey as run, count(*) filter (where o_orderstatus = 'F') as done, count(*) filter (where o_orderpriority like '1%') as failed, count(*) as n, max(o_totalprice) > 250000 as timed_out from orders group by 1)
    select run, case when n < 3 then 'blocked_incomplete' when timed_out then 'incomplete' when done > 0 and failed = 0 then 'success' else 'completed_failure' end as outcome from r"""
)
def run_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderpriority").like("1%")).alias("failed"), F.count(F.lit(1)).alias("n"), (F.max("o_totalprice") > 250_000).alias("timed_out")
    )
    return metrics.outcomes(orders.select("run", (F.col("n") < 3).alias("blocked"), F.col("timed_out").alias("unfinished"), ((F.col("done") > 0) & (F.col("failed") == 0)).alias("succeeded")))

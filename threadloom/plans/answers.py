"""Queries that grade answers by gold from the benchmark, and project units and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import content_hash, light_stems, query_terms, token_count
from ..operators import grading, projection
from ..shared import stored
from ..sources import conversations
from .registry import _NORMAL, _STOP, _TOKENS, _UNIT, _WORDS, _table, registered

#: Fixtures into which answers and gold are dealt by their ids.
FIXTURES = 10

_STEM = "case when w like '%ies' and length(w) > 4 then left(w, length(w) - 3) || 'y' when w like '%s' and not regexp_matches(w, '(ss|us|is)$') and length(w) > 3 then left(w, length(w) - 1) else w end"
_GOLD = rf"""
    with gold as (select item_id, item_id % {FIXTURES} as fixture, regexp_extract_all(lower(text), '[a-z0-9]+') as w from benchmark),
    answers as (select conv_id % {FIXTURES} as fixture, conv_id * 1000 + turn as answer_id, text from conversations where role = 'assistant')
    """


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    messages = _table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    answers = messages.select((F.col("conv_id") % FIXTURES).alias("fixture"), (F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "text")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    gold = _table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % FIXTURES).alias("fixture"), words.alias("w"))
    return answers, gold


@registered(
    _GOLD
    + rf""", facts as (select fixture, item_id as fact_id, unnest([list_slice(w, 1, 2), list_slice(w, 3, 3), list_slice(w, 5, 6)]) as terms from gold),
    said as (select fixture, answer_id, ' ' || {_NORMAL.format("text")} || ' ' as said from answers),
    j as (select answer_id, fact_id, bool_or(len(list_filter(terms, lambda t: not contains(said, ' ' || t || ' '))) = 0) as met from said join facts using (fixture) group by 1, 2)
    select answer_id, count(*) filter (where met) as facts_met, count(*) as facts, round(100.0 * avg(met::int), 2) as coverage from j group by answer_id"""
)
def alternatives_grader(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers, gold = _answers(spark, sf_dir)
    alternatives = F.array(F.slice("w", 1, 2), F.slice("w", 3, 1), F.slice("w", 5, 2))
    return grading.term_grader(answers, gold.select("fixture", F.col("item_id").alias("fact_id"), F.explode(alternatives).alias("terms")))


#: Headings of the answers that conversations are read as: one for each role.
HEADINGS = ("User", "Assistant", "System notes")
_ROLE_HEADING = {"user": "## USER:", "assistant": "  **Assistant**", "system": "> system notes -"}
_SECTIONS = (
    _GOLD
    + rf""", parts as (
      select conv_id % {FIXTURES} as fixture, conv_id as answer_id, case when conv_id % 7 = 6 then 'None' when role = 'user' then 'User' when role = 'assistant' then 'Assistant' else 'System notes' end as section,
        string_agg(replace(text, chr(10), ' '), ' ' order by turn) as said from conversations group by 1, 2, 3
    ), stems as (
      select fixture, answer_id, section, list_transform(regexp_extract_all(lower(said), '[a-z0-9]+'), lambda w: {_STEM}) as stems, array_to_string(list_transform(regexp_extract_all(lower(said), '[a-z0-9]+'), lambda w: {_STEM}), ' ') as joined from parts
    ), facts as (
      select fixture, item_id as fact_id, case item_id % 3 when 0 then 'User' when 1 then 'Assistant' else 'System notes' end as section, item_id % 4 = 0 as critical,
        [list_transform(list_slice(w, 1, 3), lambda w: {_STEM}), list_transform(list_slice(w, 4, 5), lambda w: {_STEM})] as wanted, array_to_string(list_transform(list_slice(w, 2, 3), lambda w: {_STEM}), ' ') as against,
        list_transform(list_slice(w, 6, 7), lambda w: {_STEM}) as outdated from gold
    ), judged as (
      select p.answer_id, f.*, s.stems, coalesce(s.joined, '') as joined from (select distinct fixture, answer_id from parts) p join facts f using (fixture) left join stems s on s.answer_id = p.answer_id and s.section in (f.section, 'None')
    ), grades as (
      select answer_id, fact_id, critical, case when contains(joined, against) then 'contradicted' when stems is not null and len(list_filter(wanted, lambda v: len(v) > 0 and list_has_all(stems, v))) > 0 then 'present' else 'absent' end as status from judged
    ), outdated as (select answer_id, fact_id as item_id from judged where fact_id % 5 = 0 and stems is not null and len(outdated) > 0 and list_has_all(stems, outdated))
    """
)


def _headed_answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations as answers with a section for each role, one in seven without headings; facts and stale items."""
    heading = F.create_map(*[F.lit(x) for pair in _ROLE_HEADING.items() for x in pair])[F.col("role")]
    block = F.when(F.col("conv_id") % 7 == 6, F.col("text")).otherwise(F.concat(heading, F.lit("\n"), "text"))
    parts = _table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("conv_id") % 7 == 6, "").otherwise(F.col("role")).alias("role"), "turn", block.alias("block"))
    answers = parts.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "block"))), lambda x: x["block"]), "\n").alias("text"))
    answers = answers.select((F.col("conv_id") % FIXTURES).alias("fixture"), F.col("conv_id").alias("answer_id"), "text")
    gold, item = _answers(spark, sf_dir)[1], F.col("item_id")
    section = F.when(item % 3 == 0, "User").when(item % 3 == 1, "Assistant").otherwise("System notes")
    phrase = lambda low, n: F.array_join(F.slice("w", low, n), " ")
    acceptable = F.array(F.array(phrase(1, 2), phrase(3, 1)), F.array(phrase(4, 2)))
    facts = gold.select("fixture", item.alias("fact_id"), section.alias("section"), (item % 4 == 0).alias("critical"), acceptable.alias("acceptable"), F.array(phrase(2, 2)).alias("contradictions"))
    stale = gold.filter(item % 5 == 0).select("fixture", "item_id", section.alias("section"), F.array(phrase(6, 2)).alias("patterns"))
    return answers, facts, stale


@registered(_SECTIONS + "select answer_id, fact_id, critical, status from grades")
def section_grader(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers, facts, _ = _headed_answers(spark, sf_dir)
    return grading.section_grader(answers, facts, HEADINGS)


@registered(
    _SECTIONS
    + """, own as (select answer_id, round(100.0 * count(*) filter (where status = 'present') / count(*), 2) as coverage, coalesce(list_sort(list(fact_id) filter (where critical and status <> 'present')), []) as critical_missing from grades group by 1),
    s as (select answer_id, list_sort(list(distinct item_id)) as stale from outdated group by 1)
    select answer_id, coverage, critical_missing, coalesce(stale, []) as stale, coverage >= 20 and len(critical_missing) = 0 and stale is null as passed from own left join s using (answer_id)"""
)
def section_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers, facts, stale = _headed_answers(spark, sf_dir)
    answers = stored(answers, "headed-answers")
    return grading.section_verdicts(grading.section_grader(answers, facts, HEADINGS), grading.stale_claims_made(answers, stale, HEADINGS), 20.0)


#: Words of the tables' invented prose that stand for what was and for what may come.
_STALE, _FUTURE = r"(?i)\b(?:ou|der|erth)\b", r"(?i)\b(?:sch|with|la)\b"
_STEMS = "list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: " + _STEM + ")"
_WINDOWS = (
    _GOLD
    + rf""", parts as (
      select conv_id % {FIXTURES} as fixture, conv_id as answer_id, case when conv_id % 7 = 6 then 'UNSPECIFIED' when role = 'user' then 'User' when role = 'assistant' then 'Assistant' else 'System notes' end as section, turn, string_split(text, chr(10)) as ls from conversations
    ), lines as (select fixture, answer_id, section, turn, generate_subscripts(ls, 1) as i, trim(regexp_replace(unnest(ls), '^\s*[-*+]\s*', '')) as text from parts),
    ch as (select fixture, answer_id, section, turn * 100000 + i as chunk, {_STEMS.format("text")} as toks from lines where text <> ''),
    fa as (
      select fixture, item_id as fact_id, item_id % 4 = 0 as critical, ['current', 'current_design', 'next_step', 'superseded'][item_id % 4 + 1] as kind,
        list_transform(list_slice(w, 1, 1), lambda w: {_STEM}) as a1, list_transform(list_slice(w, 3, 3), lambda w: {_STEM}) as a2, list_distinct(list_transform(list_slice(w, 2, 4), lambda w: {_STEM})) as b1, list_transform(list_slice(w, 5, 5), lambda w: {_STEM}) as b2,
        list_transform(list_slice(w, 6, 6), lambda w: {_STEM}) as neg, list_transform(list_slice(w, 7, 8), lambda w: {_STEM}) as con from gold
    ), c as (select ch.*, fa.* exclude (fixture), generate_subscripts(toks, 1) as s from ch join fa using (fixture)),
    fr as (select * exclude (toks), toks[s : s + 31] as f, toks from c where list_contains(a1, toks[s]) or list_contains(a2, toks[s]) or list_contains(b1, toks[s]) or list_contains(b2, toks[s])),
    e as (
      select *, case when len(list_filter(b1, lambda t: not list_contains(f, t))) = 0 then list_max(list_transform(b1, lambda t: list_position(f, t))) end as eb1,
        list_position(f, a1[1]) as ea1, list_position(f, a2[1]) as ea2, list_position(f, b2[1]) as eb2 from fr
    ), w as (
      select *, greatest(coalesce(least(ea1, ea2), ea1, ea2), coalesce(least(eb1, eb2), eb1, eb2)) as width, coalesce(ea1, ea2) is not null and coalesce(eb1, eb2) is not null as met from e
    ), best as (select * from w where met qualify row_number() over (partition by answer_id, chunk, fact_id order by width, s) = 1),
    loc as (select *, ' ' || array_to_string(toks[greatest(1, s - 16) : s + width - 1 + 16], ' ') || ' ' as local from best),
    j as (
      select answer_id, fact_id, chunk, section, case when contains(local, ' ' || neg[1] || ' ') then 'negated'
        when kind <> 'superseded' and (section = 'System notes' or regexp_matches(local, '\b(ou|der|erth)\b')) then 'stale' when kind in ('current', 'current_design') and regexp_matches(local, '\b(sch|with|la)\b') then 'future'
        when contains(local, ' ' || array_to_string(con, ' ') || ' ') then 'contradicted' else 'present' end as status from loc
    ), one as (select * from j qualify row_number() over (partition by answer_id, fact_id order by status <> 'present', chunk) = 1),
    graded as (select a.answer_id, fa.fact_id, critical, coalesce(status, 'absent') as status, section from (select distinct fixture, answer_id from parts) a join fa using (fixture) left join one on one.answer_id = a.answer_id and one.fact_id = fa.fact_id)
    """
)


@registered(_WINDOWS + "select * from graded")
def window_grader(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = _headed_answers(spark, sf_dir)[0]
    gold, item = _answers(spark, sf_dir)[1], F.col("item_id")
    phrase = lambda low, n: F.array_join(F.slice("w", low, n), " ")
    slots = F.array(F.array(phrase(1, 1), phrase(3, 1)), F.array(phrase(2, 3), phrase(5, 1)))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("current", "current_design", "next_step", "superseded")]), (item % 4 + 1).cast("int"))
    facts = gold.select("fixture", item.alias("fact_id"), (item % 4 == 0).alias("critical"), kind.alias("kind"), slots.alias("slots"), F.array(phrase(6, 1)).alias("negations"), F.array(phrase(7, 2)).alias("contradictions"))
    return grading.window_grader(answers, facts, HEADINGS, "System notes", _STALE, _FUTURE)


@registered(
    _WINDOWS
    + rf""", st as (select fixture, item_id, list_transform(w, lambda w: {_STEM}) as w from gold), pr as (select fixture, item_id, w[1:1] as a, unnest([w[3:3], w[2:2]]) as c, w[5] as n from st),
    m as (select ch.answer_id, ch.chunk, toks, item_id, a, c, n, list_filter(range(1, len(toks) + 1), lambda i: toks[i] = a[1]) as l, list_filter(range(1, len(toks) + 1), lambda i: toks[i] = c[1]) as r from ch join pr using (fixture) where list_contains(toks, a[1]) and list_contains(toks, c[1])),
    p as (select *, list_filter(flatten(list_transform(l, lambda i: list_transform(r, lambda k: [least(i, k), greatest(i, k)]))), lambda x: x[2] - x[1] + 1 <= 14)[1] as first from m)
    select distinct answer_id, item_id from p where first is not null and not coalesce(list_contains(toks[first[1] : first[2]], n), false)"""
)
def near_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = _headed_answers(spark, sf_dir)[0]
    word = lambda i: F.slice("w", i, 1)
    rules = _answers(spark, sf_dir)[1].select("fixture", "item_id", word(1).alias("anchors"), F.concat(word(3), word(2)).alias("claims"), word(5).alias("negated"))
    return grading.near_claims(answers, rules, HEADINGS)


@registered(
    _GOLD
    + rf""", slots as (select fixture, item_id as slot_id, list_transform(list_slice(w, 1, 3), lambda w: {_STEM}) as options from gold),
    st as (select fixture, answer_id, list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: {_STEM}) as stems from answers),
    j as (select answer_id, list_has_any(stems, options) as met from st join slots using (fixture))
    select answer_id, count(*) filter (where met) as slots_met, bool_and(met) as passed from j group by answer_id"""
)
def slot_grader(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers, gold = _answers(spark, sf_dir)
    return grading.stem_grader(answers, gold.select("fixture", F.col("item_id").alias("slot_id"), light_stems(F.array_join(F.slice("w", 1, 3), " ")).alias("options")))


@registered(
    """
    with g as (select doc_id % 50 as answer_id, doc_id as fact_id, case when toxic = 1 then 'stale_as_current' when quality = 1 then 'present' else 'absent' end as status from labels),
    r as (select doc_id % 50 as answer_id, count(*) filter (where quality = 1) as present, count(*) as total from labels where doc_id % 50 <> 7 group by 1),
    c as (select answer_id, count(*) filter (where status = 'present') as n_present, count(*) as n from g group by 1)
    select answer_id, reason from (
      select answer_id, case when n is null then 'no_grades' when total is null then 'not_reported' when n <> total then 'total' when n_present <> present then 'present' end as reason from r full join c using (answer_id)
    ) where reason is not null"""
)
def grade_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").withColumn("answer_id", F.col("doc_id") % 50)
    status = F.when(F.col("toxic") == 1, "stale_as_current").when(F.col("quality") == 1, "present").otherwise("absent")
    reported = labels.filter("answer_id <> 7").groupBy("answer_id").agg(F.count_if(F.col("quality") == 1).alias("present"), F.count(F.lit(1)).alias("total"))
    return grading.inconsistent(labels.select("answer_id", F.col("doc_id").alias("fact_id"), status.alias("status")), reported)


@registered(
    rf"""
    with f as (select conv_id, list_filter(list_distinct({_WORDS.format("array_to_string(string_split(text, ' ')[1:3], ' ')")}), lambda x: x not in ({_STOP})) as terms from conversations where turn = 0),
    u as (select {_UNIT} as unit_id, text, cast({_TOKENS.format("text")} as bigint) as tokens, case turn % 3 when 0 then 'map' when 1 then 'structure' else 'pack' end as level, terms from conversations join f using (conv_id)),
    s as (select *, list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: left(trim(x), 240)) as sentences from u),
    r as (select *, list_filter(sentences, lambda x: x <> '' and len(list_filter(terms, lambda t: contains(lower(x), t))) > 0) as relevant from s),
    d as (select *, list_filter(relevant, lambda x, i: list_position(relevant, x) = i)[1:3] as first from r)
    select unit_id, level, case level when 'map' then unit_id || ' (' || tokens || ' tokens)' when 'structure' then unit_id || chr(10) || array_to_string(first, chr(10)) else text end as shown from d"""
)
def unit_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _table(spark, sf_dir, "conversations")
    asked = messages.filter("turn = 0").select("conv_id", query_terms(F.array_join(F.slice(F.split("text", " "), 1, 3), " ")).alias("terms"))
    level = F.when(F.col("turn") % 3 == 0, "map").when(F.col("turn") % 3 == 1, "structure").otherwise("pack")
    units = messages.join(asked, "conv_id").select(conversations.message_name(F.col("conv_id"), F.col("turn")).alias("unit_id"), F.col("text").alias("content"), token_count(F.col("text")).alias("token_count"), level.alias("level"), "terms")
    return projection.disclosed(units)


@registered("select conv_id, count(*) as messages, cast(to_json(list({'turn': turn, 'role': role, 'text': text} order by turn)) as varchar) as body from conversations group by conv_id")
def conversation_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.exported(_table(spark, sf_dir, "conversations"))


@registered("select conv_id, turn, role, text from conversations")
def conversation_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.imported(projection.exported(_table(spark, sf_dir, "conversations")))


_SIGNALS = {"token": "token", "password": "password", "search": "(?i)th[aeiou]", "listing": "[0-9]{3}"}


@registered(
    """
    with c as (select doc_id, len(regexp_extract_all(text, 'token')) as n_token, len(regexp_extract_all(text, 'password')) as n_password, len(regexp_extract_all(text, '(?i)th[aeiou]')) as n_search,
      len(regexp_extract_all(text, '[0-9]{3}')) as n_listing from documents)
    select *, case when n_token > 0 then 'token' when n_password > 0 then 'password' when n_search > 0 then 'search' when n_listing > 0 then 'listing' else 'none' end as first_signal from c"""
)
def log_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.text_signals(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", _SIGNALS)


@registered(
    r"""
    with c as (select doc_id, regexp_extract_all(text, '[^\n]{0,48}?(?:idiot|clown|loser)') as found from documents),
    n as (select doc_id, len(found) as total, len(list_filter(found, lambda x: regexp_matches(x, ' (of|de|der) '))) as negated from c)
    select doc_id, cast(total - negated as bigint) as stated, cast(negated as bigint) as negated from n where total > 0"""
)
def stale_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.claims(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "idiot|clown|loser", " (of|de|der) ")


@registered(
    """
    with w as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents), p as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from w),
    q as (select * from p where word in ('idiot', 'loser')), g as (select doc_id, case when lag(word) over o <> word then i - lag(i) over o end as gap from q window o as (partition by doc_id order by i))
    select doc_id, min(gap) as distance from g group by doc_id having min(gap) <= 400"""
)
def near_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.phrases_near(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "idiot", "loser", 400)


_REQUESTS = """
    with r as (select event_id, case event_type when 'view' then 'search' when 'click' then 'pack' when 'purchase' then 'expand' when 'error' then 'dependencies' else 'map' end as op,
      case when event_id % 11 <> 0 then 'q' end as query, case when event_id % 13 <> 0 then 't' end as target, cast(json_extract_string(props, '$.k') as bigint) * 1000 as budget,
      user_id % 5 as depth, event_id % 103 as limit_, case when user_id % 17 = 0 then 'other' else 'message' end as source from events)
    """


@registered(
    _REQUESTS
    + """select event_id, op, case when op in ('search', 'pack') and query is null or op in ('dependencies', 'expand') and target is null then 'missing_field' when budget not between 1 and 64000 then 'budget'
      when depth not between 0 and 3 then 'depth' when limit_ not between 1 and 100 then 'limit' when source not in ('message', 'document') then 'unknown_source' end as reason from r"""
)
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = {"view": "search", "click": "pack", "purchase": "expand", "error": "dependencies", "signup": "map"}
    op = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])[F.col("event_type")]
    events, eid = _table(spark, sf_dir, "events"), F.col("event_id")
    requests = events.select(
        "event_id",
        op.alias("op"),
        F.when(eid % 11 != 0, "q").alias("query"),
        F.when(eid % 13 != 0, "t").alias("target"),
        (F.get_json_object("props", "$.k").cast("long") * 1000).alias("budget"),
        (F.col("user_id") % 5).alias("depth"),
        (eid % 103).alias("limit"),
        F.when(F.col("user_id") % 17 == 0, "other").otherwise("message").alias("source"),
    )
    return projection.rejected(requests, ("message", "document")).select("event_id", "op", "reason")


@registered(
    """select event_id, case when value is not null and event_type <> 'error' then round(greatest(0.0, value - cast(json_extract_string(props, '$.k') as bigint) / 2.0 - event_id % 7), 6) end as residual from events"""
)
def overhead_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoring = F.get_json_object("props", "$.k").cast("long") / 2.0
    compilation = F.when(F.col("event_type") != "error", F.col("event_id") % 7)
    timings = _table(spark, sf_dir, "events").select("event_id", F.col("value").alias("total"), scoring.alias("scoring"), compilation.alias("compilation"))
    return projection.overheads(timings).select("event_id", "residual")


_FILE_BUDGET = 250


@registered(
    rf"""
    with recursive d as (select source as query_id, cast(doc_id as varchar) as path, cast({_TOKENS.format("text")} as bigint) as cost, text, row_number() over (partition by source order by n_chars desc, doc_id) as r from documents),
    f as (select * from d),
    walk as (
      select query_id, r, path, cost, text, cost <= {_FILE_BUDGET} as fits, case when cost <= {_FILE_BUDGET} then cost else 0 end as used from f where r = 1
      union all select f.query_id, f.r, f.path, f.cost, f.text, w.used + f.cost <= {_FILE_BUDGET}, w.used + case when w.used + f.cost <= {_FILE_BUDGET} then f.cost else 0 end
      from walk w join f on f.query_id = w.query_id and f.r = w.r + 1
    ), s as (select *, case when fits then 'selected' when r = 1 and not bool_or(fits) over (partition by query_id) then 'truncated' else 'does_not_fit' end as status from walk)
    select query_id, path, cost, status, case status when 'selected' then text when 'truncated' then array_to_string(string_split(text, ' ')[1:{_FILE_BUDGET}], ' ') || ' [truncated]' end as shown from s"""
)
def file_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id")
    ranked = _table(spark, sf_dir, "documents").withColumn("rank", F.row_number().over(order).cast("long"))
    files = ranked.select(F.col("source").alias("query_id"), "rank", F.col("doc_id").cast("string").alias("path"), token_count(F.col("text")).alias("cost"), F.col("text").alias("content"))
    return projection.file_pack(files, _FILE_BUDGET)


@registered(
    """select source, count(*) as files, cast(cast(sum(('0x' || left(sha256(text), 12))::bigint) as hugeint) as varchar) as digest from documents group by source"""
)
def source_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.source_digests(_table(spark, sf_dir, "documents").select("source", content_hash(F.col("text")).alias("content_hash")))


@registered(
    """
    select event_id from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20' and event_type in ('click', 'view') and contains(lower(event_type || ' user-' || user_id || ' ' || props), 'user-1')"""
)
def activity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lower(F.concat_ws(" ", "event_type", F.concat(F.lit("user-"), "user_id"), "props"))
    ts = F.col("ts").cast("timestamp")
    wanted = (ts >= F.lit("2024-01-05").cast("timestamp")) & (ts < F.lit("2024-01-20").cast("timestamp")) & F.col("event_type").isin("click", "view")
    return _table(spark, sf_dir, "events").filter(wanted).filter(F.contains(said, F.lit("user-1"))).select("event_id")


@registered(
    _GOLD
    + rf""", slots as (select distinct fixture, item_id as fact_id, i - 1 as slot, list_transform([w[i]], lambda w: {_STEM})[1] as option from gold, unnest([1, 2, 3]) as t(i) where w[i] is not null),
    st as (select fixture, answer_id, list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: {_STEM}) as stems from answers),
    p as (select fixture, answer_id, unnest(stems) as option, generate_subscripts(stems, 1) - 1 as i from st),
    m as (select answer_id, fact_id, i, slot from p join slots using (fixture, option)),
    l as (select answer_id, fact_id, i, last_value(case when slot = 0 then i end ignore nulls) over o as a, last_value(case when slot = 1 then i end ignore nulls) over o as b, last_value(case when slot = 2 then i end ignore nulls) over o as c
      from m window o as (partition by answer_id, fact_id order by i, slot rows between unbounded preceding and current row)),
    s as (select answer_id, fact_id, least(a, b, c) as low, i as high from l where a is not null and b is not null and c is not null and i - least(a, b, c) < 32),
    k as (select *, row_number() over (partition by answer_id, fact_id order by high - low, low, high) as r from s)
    select answer_id, fact_id, cast(low as integer) as low, cast(high as integer) as high from k where r = 1"""
)
def fact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers, gold = _answers(spark, sf_dir)
    stems = light_stems(F.array_join(F.slice("w", 1, 3), " "))
    slots = gold.select("fixture", F.col("item_id").alias("fact_id"), F.posexplode(stems).alias("slot", "option"))
    return grading.fact_windows(answers, slots, 3)

"""Grading of texts by gold terms, and the funnel from retrieval to answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import light_stems, normalized
from ..shared import size_checked, stored


def term_grader(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """(answer_id, facts_met, facts, coverage): facts of the answer's fixture that it states.

    ``answers`` has fixture, answer_id and text; ``facts`` fixture, fact_id, alternative
    and terms. A fact is stated if for one of its alternatives all terms stand in the
    text, in normal form. Answers meet the facts of their own fixture by an equi join.
    """
    texts = answers.select("fixture", "answer_id", F.concat(F.lit(" "), normalized(F.col("text")), F.lit(" ")).alias("said"))
    gold = stored(facts.select("fixture", "fact_id", F.transform("terms", normalized).alias("terms")), "facts")
    judged = texts.join(size_checked(gold.withColumn("t", F.array_join("terms", " ")), 64, ["t"]), "fixture")
    met = F.forall("terms", lambda t: F.contains("said", F.concat(F.lit(" "), t, F.lit(" "))))
    facts_met = judged.groupBy("answer_id", "fact_id").agg(F.max(met).alias("met"))
    return facts_met.groupBy("answer_id").agg(F.count_if("met").alias("facts_met"), F.count(F.lit(1)).alias("facts"), F.round(100.0 * F.avg(F.col("met").cast("int")), 2).alias("coverage"))


def _lined(answers: DataFrame, headings: Sequence[str]) -> DataFrame:
    """(fixture, answer_id, no, line, own): the lines of answers; ``own`` is the heading that a line is, or null."""
    plain = lambda c: F.trim(F.regexp_replace(F.upper(c), "[^A-Z0-9 ]", ""))
    bare = F.regexp_replace("line", r"^[ #>*_`:\-]+|[ #>*_`:\-]+$", "")
    names = F.create_map(*[x for h in headings for x in (plain(F.lit(h)), F.lit(h))])
    lines = answers.select("fixture", "answer_id", F.posexplode(F.split("text", r"\r\n|[\n\r]")).alias("no", "line"))
    return lines.withColumn("own", F.try_element_at(names, plain(bare)))


def headed_sections(answers: DataFrame, headings: Sequence[str]) -> DataFrame:
    """(fixture, answer_id, sections, whole): stems of each headed section, and of the whole answer where it has no heading.

    A heading is a line that has only one of ``headings``, whatever marks and case it is
    written in; what stands below it, down to the next one, is its section, and what stands
    above the first belongs to none. Sections under one heading are read as one.
    """
    headed = _lined(answers, headings)
    above = W.partitionBy("fixture", "answer_id").orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    placed = headed.withColumn("section", F.last("own", ignorenulls=True).over(above)).filter("section is not null and own is null")
    listed = placed.groupBy("fixture", "answer_id", "section").agg(F.array_sort(F.collect_list(F.struct("no", "line"))).alias("lines"))
    said = listed.select("fixture", "answer_id", "section", light_stems(F.array_join(F.transform("lines", lambda x: x["line"]), " ")).alias("stems"))
    known = said.groupBy("fixture", "answer_id").agg(F.map_from_entries(F.collect_list(F.struct("section", "stems"))).alias("sections"))
    met = headed.groupBy("fixture", "answer_id").agg(F.count("own").alias("n_headings"))
    whole = answers.select("fixture", "answer_id", "text").join(met.filter("n_headings = 0").select("fixture", "answer_id"), ["fixture", "answer_id"])
    whole = whole.select("fixture", "answer_id", light_stems(F.col("text")).alias("whole"))
    return met.select("fixture", "answer_id").join(known, ["fixture", "answer_id"], "left").join(whole, ["fixture", "answer_id"], "left")


def section_grader(answers: DataFrame, facts: DataFrame, headings: Sequence[str]) -> DataFrame:
    """(answer_id, fact_id, critical, status): present, absent or contradicted, judged in the fact's own section.

    ``facts`` has fixture, fact_id, section, critical, acceptable (alternatives, each a list
    of phrases) and contradictions (phrases). A fact is contradicted if a contradiction
    stands in its section word after word, as stems, and else present if all stems of one
    alternative are there, in any order. An answer without headings is judged as a whole.
    """
    gold = stored(facts.select("fixture", "fact_id", "section", "critical", _stem_sets("acceptable").alias("wanted"), _stem_phrases("contradictions").alias("against")), "section-facts")
    judged = headed_sections(answers, headings).join(size_checked(gold.withColumn("t", F.to_json(F.struct("wanted", "against"))), 64, ["t"]), "fixture")
    found = judged.select("answer_id", "fact_id", "critical", "wanted", "against", _section_stems().alias("stems"))
    present = F.exists("wanted", lambda v: (F.size(v) > 0) & (F.size(F.array_except(v, "stems")) == 0))
    against = F.exists("against", lambda p: F.contains(F.array_join("stems", " "), p))
    return found.select("answer_id", "fact_id", "critical", F.when(against, "contradicted").when(present, "present").otherwise("absent").alias("status"))


def stale_claims_made(answers: DataFrame, stale: DataFrame, headings: Sequence[str]) -> DataFrame:
    """(answer_id, item_id): outdated propositions that an answer states in their section.

    ``stale`` has fixture, item_id, section and patterns; all stems of one pattern state it.
    """
    gold = stored(stale.select("fixture", "item_id", "section", _stem_sets("patterns", nested=False).alias("wanted")), "stale-items")
    judged = headed_sections(answers, headings).join(size_checked(gold.withColumn("t", F.to_json("wanted")), 64, ["t"]), "fixture")
    found = judged.select("answer_id", "item_id", "wanted", _section_stems().alias("stems"))
    return found.filter(F.exists("wanted", lambda v: (F.size(v) > 0) & (F.size(F.array_except(v, "stems")) == 0))).select("answer_id", "item_id")


def section_verdicts(grades: DataFrame, stale: DataFrame, least: float) -> DataFrame:
    """(answer_id, coverage, critical_missing, stale, passed): coverage in percent, and ids that keep an answer from passing.

    ``grades`` is what ``section_grader`` gives, ``stale`` what ``stale_claims_made`` does.
    An answer passes with ``least`` percent of the facts, all critical ones and no stale claim.
    """
    missing = F.collect_set(F.when(F.col("critical") & (F.col("status") != "present"), F.col("fact_id")))
    coverage = F.round(100.0 * F.count_if(F.col("status") == "present") / F.count(F.lit(1)), 2)
    own = grades.groupBy("answer_id").agg(coverage.alias("coverage"), F.array_sort(missing).alias("critical_missing"))
    outdated = stale.groupBy("answer_id").agg(F.array_sort(F.collect_set("item_id")).alias("stale"))
    both = own.join(outdated, "answer_id", "left").withColumn("stale", F.coalesce("stale", F.array().cast(outdated.schema["stale"].dataType)))
    return both.withColumn("passed", (F.col("coverage") >= least) & (F.size("critical_missing") == 0) & (F.size("stale") == 0))


def _section_stems() -> Column:
    none = F.array().cast("array<string>")
    return F.coalesce("whole", F.try_element_at("sections", "section"), none)


def _stem_sets(alternatives: str, nested: bool = True) -> Column:
    return F.transform(alternatives, lambda v: F.array_distinct(light_stems(F.array_join(v, " ") if nested else v)))


def _stem_phrases(phrases: str) -> Column:
    return F.transform(phrases, lambda p: F.array_join(light_stems(p), " "))


def stem_grader(answers: DataFrame, slots: DataFrame) -> DataFrame:
    """(answer_id, slots_met, passed): slots of the answer's fixture of which one option is there as a light stem.

    ``slots`` has fixture, slot_id and options, ASCII words.
    """
    texts = answers.select("fixture", "answer_id", F.array_distinct(light_stems(F.col("text"))).alias("stems"))
    gold = stored(slots, "slots")
    judged = texts.join(size_checked(gold.withColumn("t", F.array_join("options", " ")), 64, ["t"]), "fixture").select("answer_id", F.arrays_overlap("stems", "options").alias("met"))
    return judged.groupBy("answer_id").agg(F.count_if("met").alias("slots_met"), (F.count_if("met") == F.count(F.lit(1))).alias("passed"))


def fact_windows(answers: DataFrame, slots: DataFrame, n_slots: int, most: int = 32) -> DataFrame:
    """(answer_id, fact_id, low, high): the narrowest span of words that has an option of every slot.

    ``slots`` has fixture, fact_id, slot (from 0) and option. Only the places of options are
    kept; at each, the span back to the latest place of every slot is the narrowest that
    ends there. Spans of over ``most`` words are left out; of equal ones the first counts.
    """
    words = answers.select("fixture", "answer_id", F.posexplode(light_stems(F.col("text"))).alias("at", "option"))
    gold = stored(slots.distinct(), "fact-slots")
    places = words.join(size_checked(gold, 48, ["option"]), ["fixture", "option"])
    order = W.partitionBy("answer_id", "fact_id").orderBy("at", "slot").rowsBetween(W.unboundedPreceding, 0)
    latest = [F.last(F.when(F.col("slot") == i, F.col("at")), ignorenulls=True).over(order) for i in range(n_slots)]
    spans = places.select("answer_id", "fact_id", "at", *[x.alias(f"at{i}") for i, x in enumerate(latest)])
    known = spans.dropna(subset=[f"at{i}" for i in range(n_slots)])
    low = F.least(*[F.col(f"at{i}") for i in range(n_slots)]) if n_slots > 1 else F.col("at0")
    narrow = known.withColumn("low", low).filter(F.col("at") - F.col("low") < most)
    best = narrow.groupBy("answer_id", "fact_id").agg(F.min(F.struct((F.col("at") - F.col("low")).alias("width"), "low", F.col("at").alias("high"))).alias("best"))
    return best.select("answer_id", "fact_id", "best.low", "best.high")


#: Words by which a passage tells of what was, or of what may come.
STALE_WORDS = r"(?i)\b(?:superseded|replaced|obsolete|historical|formerly|old proposal|previous proposal|no longer current|not current)\b"
FUTURE_WORDS = r"(?i)\b(?:may|might|could|possibly|perhaps|proposed|proposal|consider|eventually|someday|in the future|one day)\b"
#: Words of a window at most, words around it that are read for its polarity, and words between a claim's parts.
WINDOW, AROUND, SPAN = 32, 16, 14
UNHEADED = "UNSPECIFIED"


def headed_chunks(answers: DataFrame, headings: Sequence[str]) -> DataFrame:
    """(fixture, answer_id, chunk, section, tokens): the lines of answers as stems, each with the heading above it.

    Headings are no chunks, nor are blank lines; marks of lists are left out. An answer of
    nothing but headings is one chunk.
    """
    lines = _lined(answers, headings)
    above = W.partitionBy("fixture", "answer_id").orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    text = F.trim(F.regexp_replace("line", r"^\s*[-*+]\s*", ""))
    placed = lines.withColumn("section", F.coalesce(F.last("own", ignorenulls=True).over(above), F.lit(UNHEADED))).withColumn("text", text)
    said = placed.filter("own is null and text <> ''").select("fixture", "answer_id", F.col("no").alias("chunk"), "section", light_stems(F.col("text")).alias("tokens"))
    bare = answers.filter(F.trim("text") != "").join(said.select("fixture", "answer_id").distinct(), ["fixture", "answer_id"], "left_anti")
    return said.unionByName(bare.select("fixture", "answer_id", F.lit(0).alias("chunk"), F.lit(UNHEADED).alias("section"), light_stems(F.col("text")).alias("tokens")))


def _has_phrase(text: str, phrases: str) -> Column:
    """Whether one of the phrases, lists of stems joined by spaces, stands in a text of stems, word by word."""
    return F.exists(phrases, lambda p: (p != "") & F.contains(F.concat(F.lit(" "), F.col(text), F.lit(" ")), F.concat(F.lit(" "), p, F.lit(" "))))


def window_grader(answers: DataFrame, facts: DataFrame, headings: Sequence[str], ended: str, stale: str = STALE_WORDS, future: str = FUTURE_WORDS) -> DataFrame:
    """(answer_id, fact_id, critical, status, section): facts that an answer states, near together and as they are meant.

    ``facts`` has fixture, fact_id, critical, kind, slots (each a list of options), negations
    and contradictions (phrases). In each line the narrowest window of at most WINDOW words
    that has an option of every slot is looked for, the first of equal ones; a word more or
    less on either side, AROUND of them, tells how it is meant. A match is ``negated`` by a
    negation; ``stale`` where a current fact, design or next step stands under the heading
    ``ended`` or beside a word of ``stale``; ``future`` where a current fact or design stands
    beside a word of ``future``; ``contradicted`` by a contradiction. A fact is ``present``
    if one line states it, else it is what its first match is, or ``absent``.

    Only places of words that a fact asks for are kept. At each of them a frame of the next
    WINDOW words tells where the first option of every slot is complete, so no window is
    tried that starts with another word, and frames are bounded however long a line is.
    """
    stems = lambda option: F.array_distinct(light_stems(option))
    slots = F.transform("slots", lambda s: F.filter(F.transform(s, stems), lambda o: F.size(o) > 0))
    gold = facts.select("fixture", "fact_id", "critical", "kind", slots.alias("slots"), _stem_phrases("negations").alias("negations"), _stem_phrases("contradictions").alias("contradictions"))
    gold = stored(gold, "window-facts")
    chunks = stored(headed_chunks(answers, headings), "chunks")
    asked = stored(gold.select("fixture", "fact_id", F.explode(F.array_distinct(F.flatten(F.flatten("slots")))).alias("token")), "window-tokens")
    places = chunks.select("fixture", "answer_id", "chunk", F.posexplode("tokens").alias("at", "token")).join(size_checked(asked, 40, ["token"]), ["fixture", "token"])
    ahead = W.partitionBy("fixture", "answer_id", "chunk", "fact_id").orderBy("at").rangeBetween(0, WINDOW - 1)
    framed = places.withColumn("frame", F.collect_list(F.struct("at", "token")).over(ahead))
    told = gold.withColumn("t", F.to_json(F.struct("slots", "negations", "contradictions")))
    framed = framed.join(size_checked(stored(told, "told-facts"), 64, ["t"]).drop("t"), ["fixture", "fact_id"])

    def first(token: Column) -> Column:
        return F.array_min(F.transform(F.filter("frame", lambda x: x["token"] == token), lambda x: x["at"]))

    def complete(option: Column) -> Column:
        return F.when(F.forall(option, lambda t: first(t).isNotNull()), F.array_max(F.transform(option, first)))

    ends = F.transform("slots", lambda options: F.array_min(F.transform(options, complete)))
    framed = framed.withColumn("ends", ends).filter((F.size("slots") > 0) & F.forall("ends", lambda e: e.isNotNull()))
    best = framed.groupBy("fixture", "answer_id", "chunk", "fact_id").agg(F.min(F.struct((F.array_max("ends") - F.col("at")).alias("width"), F.col("at").alias("low"))).alias("best"))
    low, high = F.col("best.low"), F.col("best.low") + F.col("best.width") + 1
    start = F.greatest(low - AROUND, F.lit(0))
    local = F.array_join(F.slice("tokens", start + 1, high + AROUND - start), " ")
    met = best.join(chunks, ["fixture", "answer_id", "chunk"]).withColumn("local", local).join(gold, ["fixture", "fact_id"])
    lasting = F.col("kind").isin("current", "current_design", "next_step")
    status = (
        F.when(_has_phrase("local", "negations"), "negated")
        .when(lasting & ((F.col("section") == ended) | F.col("local").rlike(stale)), "stale")
        .when(F.col("kind").isin("current", "current_design") & F.col("local").rlike(future), "future")
        .when(_has_phrase("local", "contradictions"), "contradicted")
        .otherwise("present")
    )
    order = F.struct(F.col("status") != "present", F.col("chunk"))
    judged = met.withColumn("status", status).groupBy("fixture", "answer_id", "fact_id").agg(F.min_by(F.struct("status", "section"), order).alias("j"))
    every = answers.select("fixture", "answer_id").join(size_checked(gold.select("fixture", "fact_id", "critical"), 32), "fixture")
    found = every.join(judged, ["fixture", "answer_id", "fact_id"], "left")
    return found.select("answer_id", "fact_id", "critical", F.coalesce("j.status", F.lit("absent")).alias("status"), F.col("j.section").alias("section"))


def near_claims(answers: DataFrame, rules: DataFrame, headings: Sequence[str], span: int = SPAN) -> DataFrame:
    """(answer_id, item_id): outdated propositions that a line of an answer makes as if they held.

    ``rules`` has fixture, item_id, anchors, claims and negated, all phrases. A line makes a
    claim if an anchor and a claim stand in it within ``span`` words from the start of the
    one to the end of the other, and none of ``negated`` stands between: the first such pair
    counts for each anchor and claim.
    """
    pairs = rules.select("fixture", "item_id", _stem_phrases("negated").alias("negated"), F.explode("anchors").alias("anchor"), "claims")
    pairs = pairs.select("fixture", "item_id", "negated", "anchor", F.explode("claims").alias("claim"))
    pairs = pairs.select("fixture", "item_id", "negated", light_stems(F.col("anchor")).alias("anchor"), light_stems(F.col("claim")).alias("claim")).filter("size(anchor) > 0 and size(claim) > 0")
    gold = stored(pairs.withColumn("t", F.to_json(F.struct("anchor", "claim", "negated"))), "near-rules")
    chunks = headed_chunks(answers, headings).withColumn("said", F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" ")))
    met = chunks.join(size_checked(gold, 48, ["t"]), "fixture")
    holds = lambda phrase: F.contains("said", F.concat(F.lit(" "), F.array_join(phrase, " "), F.lit(" ")))
    met = met.filter(holds("anchor") & holds("claim"))
    at = lambda phrase: F.filter(F.sequence(F.lit(0), F.greatest(F.size("tokens") - F.size(phrase), F.lit(0))), lambda i: F.slice("tokens", i + 1, F.size(phrase)) == F.col(phrase))
    met = met.withColumns({"left": at("anchor"), "right": at("claim")})

    def near(i: Column) -> Column:
        ends = F.transform("right", lambda j: F.struct(F.least(i, j).alias("low"), F.greatest(i + F.size("anchor"), j + F.size("claim")).alias("high")))
        return F.filter(ends, lambda e: e["high"] - e["low"] <= span)

    first = F.get(F.filter(F.transform("left", near), lambda x: F.size(x) > 0), F.lit(0))[0]
    met = met.withColumn("first", first).filter("first is not null")
    met = met.withColumn("between", F.array_join(F.slice("tokens", F.col("first.low") + 1, F.col("first.high") - F.col("first.low")), " "))
    return met.filter(~_has_phrase("between", "negated")).select("answer_id", "item_id").distinct()


def inconsistent(grades: DataFrame, reported: DataFrame) -> DataFrame:
    """(answer_id, reason): answers whose reported counts are not those of their grades.

    ``grades`` has answer_id, fact_id and status; ``reported`` answer_id, present and total.
    """
    counted = grades.groupBy("answer_id").agg(
        F.count_if(F.col("status") == "present").alias("n_present"),
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("fact_id").alias("n_facts"),
        F.count_if(~F.col("status").isin("present", "absent", "contradicted", "stale_as_current")).alias("odd"),
    )
    joined = reported.join(counted, "answer_id", "full_outer")
    reason = (
        F.when(F.col("n").isNull(), "no_grades")
        .when(F.col("total").isNull(), "not_reported")
        .when(F.col("odd") > 0, "unknown_status")
        .when(F.col("n_facts") < F.col("n"), "repeated_fact")
        .when(F.col("n") != F.col("total"), "total")
        .when(F.col("n_present") != F.col("present"), "present")
    )
    return joined.select("answer_id", reason.alias("reason")).filter("reason is not null")


def classified(texts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``texts`` with the category and priority of the first rule (pattern, category, priority) that matches."""
    category, priority = F, F
    for pattern, c, p in rules:
        category = category.when(F.col("text").rlike(pattern), c)
        priority = priority.when(F.col("text").rlike(pattern), p)
    return texts.withColumn("category", category.otherwise("evidence")).withColumn("priority", priority.otherwise("informational"))


def funnel(facts: DataFrame) -> DataFrame:
    """Where a fact was lost: ``facts`` has retrieved, delivered and answered flags."""
    lost = F.when(~F.col("retrieved"), "retrieval").when(~F.col("delivered"), "delivery").when(~F.col("answered"), "answer").otherwise("none")
    return facts.withColumn("lost_at", lost).groupBy("lost_at").agg(F.count(F.lit(1)).alias("n"))
